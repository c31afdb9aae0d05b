"""Shared plumbing of the text operators: table reading, Arrow batches of bounded size, byte-level word splitting.

Texts reach Python as UTF-8 bytes inside Arrow batches. On bytes, ``lower()`` changes A-Z only and ``split()`` cuts
at 0x20 and 0x09-0x0D only, which is exactly what the word definitions of these operators ask for.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seamcover.functions.graph import cut_lineage as checkpointed  # noqa: F401  for the operators

#: Text bytes that one call of an operator's function gets at once, one text at least.
SLICE_BYTES = 1 << 20
#: Rows and bytes of the Arrow batches between Spark and Python, a row at least.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "512", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}

#: A-Z to a-z; ASCII other than letters and digits to a space; all other bytes stay.
WORD_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
#: Bytes of UTF-8 that continue a character.
CONTINUATION = bytes(range(0x80, 0xC0))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, parts: int):
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(F.col(column).cast("string")) % F.lit(parts)


def alnum_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased."""
    return text.translate(WORD_TABLE).split()


def space_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased."""
    return text.lower().split()


def code_points(text: bytes, offsets: list[int]) -> list[int]:
    """Code points before each of the byte offsets; the text is read once, however many there are."""
    if not offsets or text.isascii():
        return offsets
    before = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return before[offsets].tolist()


def quoted(name: str) -> Column:
    """The column of that name, whatever characters it has."""
    return F.col(f"`{name.replace('`', '``')}`")


def slices(batch: pa.RecordBatch, text: str) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Parts of a batch with about SLICE_BYTES of text each, and their texts as bytes."""
    column = batch.column(batch.schema.get_field_index(text))
    if column.type in (pa.string(), pa.large_string()):
        column = column.cast(pa.binary() if column.type == pa.string() else pa.large_binary())
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(sizes) - sizes) // SLICE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a), column.slice(a, b - a).to_pylist()


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after its session was set to Arrow batches that keep executors and workers small."""
    for key, value in BATCH.items():
        df.sparkSession.conf.set(key, value)
    return df


def add_columns(
    df: DataFrame, text: str, function: Callable[[list[bytes | None]], dict[str, object]], fields: dict[str, str],
    keep: list[str] | None = None, prefix: str = "",
) -> DataFrame:
    """``df`` with columns computed from one text column, slice by slice.

    function: gets texts (bytes, or None for null) and returns an Arrow array or a list for each name in ``fields``
    (name to Spark type). keep: columns of ``df`` that are returned, all of them if None; where a name clashes with a
    new column the new one replaces it. prefix: stands before the new names.
    """
    names = [prefix + name for name in fields]
    keep = [c for c in (df.columns if keep is None else keep) if c not in names]
    need = list(dict.fromkeys([*keep, text]))
    # columns travel under plain names, whatever their own ones are
    schema = T.StructType([T.StructField(f"k{i}", df.schema[c].dataType, df.schema[c].nullable) for i, c in enumerate(keep)])
    for i, kind in enumerate(fields.values()):
        schema = schema.add(f"n{i}", T._parse_datatype_string(kind))
    arrow, own = _arrow_schema(schema), f"k{need.index(text)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, own):
                new = function(texts)
                arrays = list(part.columns[: len(keep)])
                arrays += [x if isinstance(x := new[c], pa.Array) else pa.array(x, arrow.field(f"n{i}").type) for i, c in enumerate(fields)]
                yield pa.RecordBatch.from_arrays(arrays, names=arrow.names)

    plain = small_batches(df).select(*[quoted(c).alias(f"k{i}") for i, c in enumerate(need)])
    return plain.mapInArrow(run, schema).toDF(*keep, *names)


def emit(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[dict[str, object]]], schema: str) -> DataFrame:
    """Rows that a function makes of a partition's batches, given as dictionaries of columns."""
    kind = T._parse_datatype_string(schema)
    arrow = _arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for new in function(batches):
            yield pa.RecordBatch.from_arrays([x if isinstance(x := new[f.name], pa.Array) else pa.array(x, f.type) for f in arrow], schema=arrow)

    return small_batches(df).mapInArrow(run, kind)


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def free_prefix(columns: list[str]) -> str:
    """A prefix that no column has."""
    prefix = "_"
    while any(c.startswith(prefix) for c in columns):
        prefix += "_"
    return prefix


_BUILT: dict[tuple[str, str], object] = {}


def shared(spark: SparkSession, data: object, build: Callable[[object], object], group: str | None = None) -> Callable[[], object]:
    """Broadcasts data of bounded size; the function returned gives build(data), made once in each Python worker.

    A worker forgets what it built for other groups (a group for each call if none is given) when it builds anew.
    """
    sent = spark.sparkContext.broadcast(data)
    token = (group or uuid.uuid4().hex, uuid.uuid4().hex)

    def get() -> object:
        from seamcover.llm.common import _BUILT

        if token not in _BUILT:
            for other in [k for k in _BUILT if k[0] != token[0]]:
                del _BUILT[other]
            _BUILT[token] = build(sent.value)
        return _BUILT[token]

    return get


class GramCache:
    """Costs of byte n-grams packed in uint64, kept in slots by their hash; a miss is computed.

    compute: gets sorted distinct grams, returns float32 costs of shape (width, n). A slot keeps the first gram that
    came to it, so frequent grams are found and memory stays at 2**bits slots.
    """

    def __init__(self, compute: Callable[[np.ndarray], np.ndarray], width: int, bits: int = 20):
        self.compute, self.shift = compute, np.uint64(64 - bits)
        self.keys = np.full(1 << bits, np.iinfo(np.uint64).max, np.uint64)
        self.costs = np.zeros((width, 1 << bits), np.float32)

    def lookup(self, grams: np.ndarray) -> np.ndarray:
        slot = ((grams * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)
        miss = np.flatnonzero(self.keys[slot] != grams)
        out = self.costs[:, slot]
        if miss.size:
            new, place = np.unique(grams[miss], return_inverse=True)
            cost = np.concatenate([self.compute(x) for x in np.array_split(new, len(new) // 50_000 + 1)], axis=1)
            out[:, miss] = cost[:, place]
            slot = ((new * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)
            free = np.flatnonzero(self.keys[slot] == np.iinfo(np.uint64).max)
            _, first = np.unique(slot[free], return_index=True)
            free = free[first]
            self.keys[slot[free]], self.costs[:, slot[free]] = new[free], cost[:, free]
        return out


def packed(buffer: bytes, order: int) -> np.ndarray:
    """Grams of order + 1 bytes by their last byte; entry i ends at byte i + order of the buffer."""
    data = np.frombuffer(buffer, np.uint8).astype(np.uint64)
    n = max(0, len(data) - order)
    out = np.zeros(n, np.uint64)
    for i in range(order + 1):
        out = (out << np.uint64(8)) | data[i : n + i]
    return out


def padded(texts: list[bytes], order: int, pad: bytes, end: bytes = b"") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grams of all texts, each after ``order`` pad bytes and with ``end`` behind; starts of the texts; which grams count.

    Every text has at least one gram if ``end`` isn't empty.
    """
    lead = pad * order
    buffer = b"".join([lead + x + end for x in texts])
    grams = packed(buffer, order)
    sizes = np.fromiter((len(x) + len(end) for x in texts), np.int64, len(texts))
    starts = np.concatenate([[0], np.cumsum(sizes + order)])[:-1]  # in grams: the first ends just behind the lead
    count = np.ones(len(grams), bool)
    count[(starts[1:, None] - order + np.arange(order)).ravel()] = False
    return grams, starts, count


def merged(grams: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the counts by gram."""
    if not grams:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    g, c = np.concatenate(grams), np.concatenate(counts)
    order = np.argsort(g, kind="stable")
    g, c = g[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
    return g[first], np.add.reduceat(c, first) if len(g) else c
