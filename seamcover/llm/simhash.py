"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprint: A-Z is lower-cased, words are ``[^\\x20\\x09-\\x0D]+``, shingles are SHINGLE words joined by a space (the
whole sequence if the text has fewer), and a bit is 1 if it is set in over half of the shingles' XXH64 (seed 42).

Search: bit i gets the code i + 1 reduced to the nonzero vectors of radius + 1 bits; mask v keeps the bits whose code
has an odd product with v. The codes of any ``radius`` bits lie in a subspace of at most ``radius`` dimensions, so some
v of the 2**(radius + 1) - 1 masks is orthogonal to all of them: it hides every differing bit, and the two
fingerprints agree under it. Every pair within the radius therefore meets in some table; none is missed.

Only distinct fingerprints are searched. A table's bucket of BLOCK members or fewer is one list. The members of a larger
one differ only in the bits that its mask hides, so they are dealt again by masks that cover those bits in the same way,
and so on, until the hidden bits can't tell more than BLOCK members apart: the work grows with the members, never with
their pairs. A list yields a spanning forest of its links, found by growing each component against the members not yet
reached, so at most one edge a member leaves it. Components come from alternating star contractions.

Edge cases: a null or blank text has fingerprint zero, and is linked like any other. Rows with a null id get the
smallest id of their group too, null if no row of it has an id. Repeated ids are kept as rows; very long texts are read
whole. An empty table gives no rows. Extra columns of the input are not looked at, whatever their names.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamcover.functions.graph import connected_components
from seamcover.llm.common import add_columns, checkpointed, emit, free_prefix, quoted, read_table, space_words

SHINGLE = 4
SEED = 42
RADIUS = 4
#: Members of a bucket that are compared in one list.
BLOCK = 1024
#: Primitive polynomials of the fields of 2**width elements.
GENERATORS = {2: 0b111, 3: 0b1011, 4: 0b10011, 5: 0b100101, 6: 0b1000011, 7: 0b10000011, 8: 0b100011101}


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the shingles' XXH64, as a signed integer."""
    words = space_words(text or b"")
    if not words:
        return 0
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(line, SEED)]
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(sizes)
        starts = (ends - sizes)[: len(words) - shingle + 1].tolist()
        hashes = [digest(line[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)]
    bits = np.zeros(64, np.int64)
    for part in range(0, len(hashes), 1 << 16):  # a block of a long text at a time
        block = np.array(hashes[part : part + (1 << 16)], np.uint64)
        bits += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``df``'s kept columns (all if None) and ``fp``."""
    return add_columns(df, text, lambda texts: {"fp": pa.array([fingerprint(t) for t in texts], pa.int64())}, {"fp": "long"}, keep)


def covering_masks(radius: int = RADIUS) -> list[int]:
    """Masks of 64 bits, signed, such that any ``radius`` bits are hidden by one of them at least."""
    codes = (1 << radius + 1) - 1
    masks = []
    for v in range(1, codes + 1):
        m = sum(1 << i for i in range(64) if ((i % codes + 1) & v).bit_count() % 2)
        masks.append(m - (1 << 64) if m >> 63 else m)
    return masks


def forest(members: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among distinct fingerprints (uint64)."""
    edges, left = [], members
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            here, front = front[0], front[1:]
            near = np.bitwise_count(left ^ here) <= radius
            if near.any():
                edges += [(here, x) for x in left[near]]
                front = np.concatenate([front, left[near]])
                left = left[~near]
    return edges


def finer_masks(mask: int, radius: int = RADIUS) -> list[int]:
    """Masks that keep the bits of ``mask`` and cover the others: any ``radius`` of these are hidden by one at least.

    The codes of the bits are the powers of a generator of the field of 2**(radius + 1) elements. Of radius + 1 of them
    in a row at least one is odd with any v, so each mask keeps a bit more of every radius + 1 hidden ones.
    """
    width, hidden = radius + 1, [i for i in range(64) if not mask >> i & 1]
    codes, code = [], 1
    for _ in hidden:
        codes.append(code)
        code <<= 1
        if code >> width:
            code ^= GENERATORS[width]
    out = []
    for v in range(1, 1 << width):
        m = mask & (1 << 64) - 1 | sum(1 << i for i, c in zip(hidden, codes, strict=True) if (c & v).bit_count() % 2)
        out.append(m - (1 << 64) if m >> 63 else m)
    return out


def links(distinct: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Distinct edges (u, v), u < v, that connect just those of the distinct fingerprints ``fp`` within the radius."""
    block = max(block, 1 << radius + 1)
    dealt = distinct.select("fp", F.explode(F.array(*map(F.lit, covering_masks(radius)))).alias("mask"))
    edges = []
    while True:
        met = dealt.select("fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
        crowd = checkpointed(met.groupBy("mask", "key").agg(F.count("*").alias("m")).where("m > 1"))
        lists = met.join(crowd.where(F.col("m") <= block).drop("m"), ["mask", "key"], "left_semi").groupBy("mask", "key").agg(F.collect_list("fp").alias("members"))
        edges.append(_list_links(lists.select("members"), radius))
        large = crowd.where(F.col("m") > block)
        masks = [r[0] for r in large.select("mask").distinct().collect()]
        if not masks:
            break
        finer = distinct.sparkSession.createDataFrame([(m, f) for m in masks for f in finer_masks(m, radius)], "mask long, finer long")
        dealt = met.join(large.drop("m"), ["mask", "key"], "left_semi").join(F.broadcast(finer), "mask").select("fp", F.col("finer").alias("mask")).distinct()
    return reduce(DataFrame.union, edges).distinct()


def _list_links(lists: DataFrame, radius: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            column = batch.column(0)
            sizes = np.diff(column.offsets.to_numpy())
            flat, ends = column.flatten().to_numpy().view(np.uint64), np.cumsum(sizes)
            two = np.flatnonzero(sizes == 2)
            u, v = flat[ends[two] - 2], flat[ends[two] - 1]
            near = np.bitwise_count(u ^ v) <= radius
            edges = [np.stack([u[near], v[near]], 1)]
            for i in np.flatnonzero(sizes > 2):
                if e := forest(flat[ends[i] - sizes[i] : ends[i]], radius):
                    edges.append(np.array(e, np.uint64))
            e = np.concatenate(edges).view(np.int64)
            yield {"u": e.min(1), "v": e.max(1)}

    return emit(lists, run, "u long, v long")


def _grouped(df: DataFrame, key: str, text: str, radius: int) -> DataFrame:
    """Rows (key, h, fp, root, component_id): h is a hash of the text, root the smallest fingerprint of the component."""
    own = df.select(quoted(key).alias("key"), F.xxhash64(quoted(text)).alias("h"), quoted(text).alias("text"))
    rows = checkpointed(fingerprints(own, keep=["key", "h"]))
    groups = checkpointed(rows.groupBy("fp").agg(F.min("key").alias("first")))
    components = connected_components(links(groups.select("fp"), radius))
    least = groups.join(components.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("component", "fp"))
    ids = checkpointed(least.select("fp", "root", "first"))
    joined = ids.where("root = fp").select("root").join(ids.groupBy("root").agg(F.min("first").alias("component_id")), "root")
    named = ids.select("fp", "root").join(joined, "root").select("fp", "root", "component_id")
    return rows.join(named, "fp", "left")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """For each row: ``key``, ``fp`` and ``component_id``, the smallest key of all rows whose fingerprints are connected."""
    return _grouped(df, key, text, radius).select(F.col("key").alias(key), "fp", "component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest id; of several with that id, or of those without
    one where no document of the group has an id, the one of the smallest hash of the text.

    Documents are told apart by id and hash; of rows equal in both one stays, the greatest as JSON.
    """
    found = _grouped(docs, "doc_id", "text", RADIUS).groupBy("root", "key", "h").agg(F.count("*").alias("n"))
    kept = found.groupBy("root").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "h", "n")).alias("k"))
    own = free_prefix(docs.columns)
    key, h = f"{own}key", f"{own}h"
    kept = checkpointed(kept.select(F.col("k.key").alias(key), F.col("k.h").alias(h), F.col("k.n").alias("n")))
    same = F.col("doc_id").eqNullSafe(F.col(key)) & (F.xxhash64("text") == F.col(h))
    single = docs.join(kept.where("n = 1"), same, "left_semi").select(*map(quoted, docs.columns))
    if kept.where("n > 1").isEmpty():
        return single
    whole = F.struct(*map(quoted, docs.columns))
    repeated = docs.join(kept.where("n > 1"), same, "left_semi").groupBy("doc_id", F.xxhash64("text").alias(h)).agg(F.max_by(whole, F.to_json(whole)).alias("r"))
    return single.unionByName(repeated.select("r.*"))
