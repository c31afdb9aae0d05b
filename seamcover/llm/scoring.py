"""Language-model scores by context-tree weighting over bytes.

Each byte is eight binary decisions, most significant bit first; each of the 255 bit prefixes has its own context tree
over the DEPTH bytes before. A node holds a Krichevsky-Trofimov estimator, and its weighted probability is
Pw = 1/2 Pe + 1/2 (product of Pw over its children). After training the counts are frozen: a decision's probability is
mixed from the root down with the posterior weights of "stop here" against "go deeper".

Every context met is kept. The tree is partitioned by its contexts of TOP + 1 bytes: a part's task builds the levels
below from the part's grams and passes up the sums of its weights; the levels of TOP bytes or fewer, 65,793 contexts at
most, are built from these and broadcast. Texts are read in blocks of BLOCK_BYTES; each block's distinct grams are sent
to their parts, and their costs come back to the block's texts. ``tree_bits`` asks for a bounded tree instead: a node
then has children for the contexts that hold 1 / 2**tree_bits of the training bytes, and one leaf for the rest.

A text is its UTF-8 bytes and one end byte (0xFF, which no text holds), after DEPTH end bytes as its first context, so
the probabilities of all texts sum to one at most. ``base_score`` is the add-half unigram word model: words that hold
1 / 2**WORD_BITS of the training tokens are looked up in a broadcast table (2**WORD_BITS rows at most), all others in
a shuffled join.

Edge cases: a null text is an empty one: the end alone is scored. A null id belongs to no fold: it is scored, not
learned from, and not held out. Repeated rows are learned from and scored each by itself. An empty table gives no rows;
a model that learned nothing gives 8 bits a byte.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seamcover.llm.common import GramCache, _arrow_schema, checkpointed, emit, fold, merged, padded, read_table, shared, slices, space_words

DEPTH = 5
#: Levels of so many context bytes or fewer are held by every task.
TOP = 2
#: Text bytes whose grams are looked up together, one text at least.
BLOCK_BYTES = 1 << 25
#: Training grams of a part, about.
PART_GRAMS = 1 << 17
WORD_BITS = 20
#: Longer words are never broadcast.
WORD_BYTES = 64
END = b"\xff"
#: The end of a text among the word counts; no word has a space.
END_WORD = b" "
#: Entries of a task's counts that are sent on before more are counted.
FLUSH = 1 << 19


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x > 0: Stirling's series above 8, the recurrence below."""
    x = np.asarray(x, np.float64)
    shift, low = np.zeros_like(x), x.copy()
    for _ in range(8):
        small = low < 8
        shift = np.where(small, shift + np.log(np.where(small, low, 1.0)), shift)
        low = np.where(small, low + 1, low)
    r = 1 / low
    return (low - 0.5) * np.log(low) - low + 0.5 * math.log(2 * math.pi) + r / 12 - r**3 / 360 + r**5 / 1260 - shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1) - 2 * log_gamma(np.array(0.5))


@dataclass
class Level:
    """Decisions of one depth, by key = context << 8 | bit prefix."""

    contexts: np.ndarray
    keys: np.ndarray
    one: np.ndarray  # probability of a 1 by the node's own estimator
    stop: np.ndarray  # weight of that against the children
    rest: np.ndarray  # probability of a 1 by the leaf that holds the data of no other child


class ContextTree:
    """The frozen mixture; rows: (depth, context, byte, count) of every kept context."""

    def __init__(self, depth: int, d: np.ndarray, context: np.ndarray, byte: np.ndarray, count: np.ndarray):
        self.depth, self.levels = depth, []
        tables = []
        for k in range(depth + 1):
            own = d == k
            tables.append((np.unique(context[own]), *_decisions(context[own], byte[own], count[own])))
        below: tuple | None = None
        for k in range(depth, -1, -1):
            contexts, keys, n0, n1 = tables[k]
            own = log_kt(n0, n1)
            if k == depth or not len(keys):
                weighted, stop, rest = own, np.zeros(0), np.zeros(0)
            else:
                inner, r0, r1 = np.zeros(len(keys)), n0.copy(), n1.copy()
                if len(below[0]):
                    up = np.searchsorted(keys, ((below[0] >> np.uint64(8) & np.uint64((1 << 8 * k) - 1)) << np.uint64(8)) | (below[0] & np.uint64(255)))
                    np.add.at(inner, up, below[3])
                    np.subtract.at(r0, up, below[1])
                    np.subtract.at(r1, up, below[2])
                inner += log_kt(r0, r1)
                weighted, stop, rest = np.logaddexp(own, inner) - math.log(2), 1 / (1 + np.exp(np.clip(inner - own, -700, 700))), (r1 + 0.5) / (r0 + r1 + 1)
            self.levels.insert(0, Level(contexts, keys, *(x.astype(np.float32) for x in ((n1 + 0.5) / (n0 + n1 + 1), stop, rest))))
            below = (keys, n0, n1, weighted)

    def cost(self, grams: np.ndarray) -> np.ndarray:
        """Bits of each gram's last byte after the bytes before it."""
        context, byte = grams >> np.uint64(8), (grams & np.uint64(255)).astype(np.int64)
        paths = [context & np.uint64((1 << 8 * k) - 1) for k in range(self.depth + 1)]
        deepest = np.full(len(grams), -1)
        for k, level in enumerate(self.levels):
            deepest[_place(level.contexts, paths[k]) >= 0] = k
        bits = np.zeros(len(grams))
        for b in range(8):
            prefix = ((1 << b) | (byte >> (8 - b))).astype(np.uint64)
            p = np.full(len(grams), 0.5)
            for k in range(self.depth, -1, -1):
                level = self.levels[k]
                i = _place(level.keys, (paths[k] << np.uint64(8)) | prefix)
                live, seen = deepest >= k, i >= 0
                one = np.where(seen, level.one[i], 0.5) if len(level.keys) else p
                if k == self.depth:
                    p = np.where(live, one, p)
                    continue
                rest, stop = (np.where(seen, level.rest[i], 0.5), np.where(seen, level.stop[i], 0.5)) if len(level.keys) else (p, 0.5)
                p = np.where(deepest == k, rest, p)
                p = np.where(live, stop * one + (1 - stop) * p, p)
            bits -= np.log2(np.where((byte >> (7 - b)) & 1, p, 1 - p))
        return bits.astype(np.float32)[None, :]


class Subtree:
    """Levels ``depth`` to ``first`` of the whole tree, of decisions (keys and counts) of the deepest.

    inner: sums of the log weights of that level's children, if it has any. ``root``: keys, counts and log weights of
    level ``first``.
    """

    def __init__(self, depth: int, first: int, keys: np.ndarray, n0: np.ndarray, n1: np.ndarray, inner: np.ndarray | None = None):
        self.levels: list[tuple[np.uint64, np.ndarray, np.ndarray, np.ndarray]] = []  # mask, keys, probability of a 1, weight of stopping
        for k in range(depth, first - 1, -1):
            own = log_kt(n0, n1)
            stop = np.ones(len(keys)) if inner is None else 1 / (1 + np.exp(np.clip(inner - own, -700, 700)))
            weighted = own if inner is None else np.logaddexp(own, inner) - math.log(2)
            self.levels.append((_mask(k), keys, ((n1 + 0.5) / (n0 + n1 + 1)).astype(np.float32), stop.astype(np.float32)))
            self.root = keys, n0, n1, weighted
            if k > first:
                keys, n0, n1, inner = lifted(*self.root, k)

    def mixed(self, context: np.ndarray, prefix: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Probability of a 1, from that of the levels below."""
        for mask, keys, one, stop in self.levels:
            i = _place(keys, (context & mask) << np.uint64(8) | prefix)
            p = np.where(i >= 0, stop[i] * one[i] + (1 - stop[i]) * p, 0.5) if len(keys) else np.full(len(p), 0.5)
        return p


def lifted(keys: np.ndarray, n0: np.ndarray, n1: np.ndarray, weighted: np.ndarray, depth: int) -> tuple[np.ndarray, ...]:
    """Decisions of depth - 1 by those of ``depth``: keys, counts, and sums of their children's log weights."""
    up, place = np.unique((keys >> np.uint64(8) & _mask(depth - 1)) << np.uint64(8) | keys & np.uint64(255), return_inverse=True)
    return up, *(np.bincount(place, x, len(up)) for x in (n0, n1, weighted))


def subtree(depth: int, first: int, grams: np.ndarray, counts: np.ndarray) -> Subtree:
    return Subtree(depth, first, *_decisions(grams >> np.uint64(8), (grams & np.uint64(255)).astype(np.int64), counts))


def whole_cost(trees: list[Subtree], grams: np.ndarray) -> np.ndarray:
    """Bits of each gram's last byte; trees: those that hold its contexts, the deepest first."""
    context, byte = grams >> np.uint64(8), (grams & np.uint64(255)).astype(np.int64)
    bits = np.zeros(len(grams))
    for b in range(8):
        prefix, p = ((1 << b) | (byte >> (8 - b))).astype(np.uint64), np.full(len(grams), 0.5)
        for tree in trees:
            p = tree.mixed(context, prefix, p)
        bits -= np.log2(np.where((byte >> (7 - b)) & 1, p, 1 - p))
    return bits.astype(np.float32)


def _mask(k: int) -> np.uint64:
    return np.uint64((1 << 8 * k) - 1)


def _decisions(context: np.ndarray, byte: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the binary decisions that were met, how often they were 0, and 1."""
    out = []
    for b in range(8):  # prefixes of another length are other keys, so each is summed by itself
        key = (context << np.uint64(8)) | ((1 << b) | (byte >> (8 - b))).astype(np.uint64)
        unique, place = np.unique(key, return_inverse=True)
        one = (byte >> (7 - b)) & 1
        out.append((unique, np.bincount(place, count * (1 - one), len(unique)), np.bincount(place, count * one, len(unique))))
    keys, zeros, ones = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.argsort(keys)
    return keys[order], zeros[order], ones[order]


def _place(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Index of each wanted key, -1 where it is missing."""
    if not len(keys):
        return np.full(len(wanted), -1)
    i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[i] == wanted, i, -1)


def corpus_counts(df: DataFrame, text: str = "text", depth: int = DEPTH) -> DataFrame:
    """Counts over all rows: (word, null, n) of words and ends, (null, gram, n) of the bytes after their contexts.

    Each task sums its own rows before the shuffle.
    """

    def count(batches):
        words, grams, counts = Counter(), [], []
        for batch in batches:
            for _, texts in slices(batch, text):
                texts = [t or b"" for t in texts]
                for t in texts:
                    words.update(space_words(t))
                words[END_WORD] += len(texts)
                g, _, own = padded(texts, depth, END, END)
                u, c = np.unique(g[own], return_counts=True)
                grams.append(u)
                counts.append(c)
                if len(words) > FLUSH or sum(map(len, grams)) > 2 * FLUSH:
                    grams, counts = ([x] for x in merged(grams, counts))
                    if len(words) > FLUSH or len(grams[0]) > FLUSH:
                        yield from rows(words, grams[0], counts[0])
                        words, grams, counts = Counter(), [], []
        if words:
            yield from rows(words, *merged(grams, counts))

    def rows(words, grams, counts):
        yield {"word": pa.array(words.keys(), pa.binary()), "gram": pa.nulls(len(words), pa.int64()), "n": pa.array(words.values(), pa.int64())}
        yield {"word": pa.nulls(len(grams), pa.binary()), "gram": grams.astype(np.int64), "n": counts}

    return emit(df.select(text), count, "word binary, gram long, n long").groupBy("word", "gram").agg(F.sum("n").alias("n"))


def fit_tree(counts: DataFrame, depth: int = DEPTH, tree_bits: int = 17) -> ContextTree:
    """The bounded context tree of ``corpus_counts``; only kept contexts reach the driver."""
    grams = counts.where("gram IS NOT NULL")
    levels = grams.select(F.explode(F.array(*[F.struct(F.lit(k).alias("d"), F.col("gram").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1)).alias("g")) for k in range(depth + 1)])).alias("x"), "n")
    levels = levels.groupBy(F.col("x.d").alias("d"), F.col("x.g").alias("g")).agg(F.sum("n").alias("n"))
    total = grams.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    context = F.shiftright("g", 8)
    kept = levels.withColumn("all", F.sum("n").over(Window.partitionBy("d", context))).where(F.col("all") >= max(1, math.ceil(total / (1 << tree_bits))))
    t = kept.select("d", context.alias("context"), F.col("g").bitwiseAND(F.lit(255)).alias("byte"), "n").toPandas()
    return ContextTree(depth, t["d"].to_numpy(np.int64), t["context"].to_numpy(np.int64).astype(np.uint64), t["byte"].to_numpy(np.int64), t["n"].to_numpy(np.int64))


class Scorer:
    """The frequent words' logarithms, and the costs of grams by a bounded tree, if there is one."""

    def __init__(self, data: tuple[ContextTree | None, dict[bytes, float]]):
        tree, self.frequent = data
        self.cost = tree and GramCache(tree.cost, 1).lookup


def scores(texts: list[bytes], depth: int, cost: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    grams, starts, own = padded(texts, depth, END, END)
    found = np.zeros(len(grams), np.float32)
    found[own] = cost(grams[own]).reshape(-1)
    return np.add.reduceat(found, starts, dtype=np.float64) * -math.log10(2)


def _blocks(batch: pa.RecordBatch, text: str, done: int) -> tuple[np.ndarray, int]:
    """Block of each row, by the text bytes before it in the partition, and the bytes with this batch."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = done + np.cumsum(sizes)
    return (TaskContext.get().partitionId() << 32) + (ends - sizes) // BLOCK_BYTES, int(ends[-1]) if len(ends) else done


def gram_costs(df: DataFrame, counts: DataFrame, depth: int) -> DataFrame:
    """(block, grams, costs) of the distinct grams of each block of ``text``, by the whole tree of ``corpus_counts``."""
    trained = counts.where("gram IS NOT NULL")
    distinct, total = trained.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    first = min(TOP + 1, depth)
    # blocks send about 1 / 32 of their bytes as grams, so parts grow in number with the bytes too
    n = 1 | (1 + max(distinct, total >> 8) // PART_GRAMS)
    mask = (1 << 8 * first) - 1
    trained = trained.select(F.pmod(F.shiftright("gram", 8).bitwiseAND(F.lit(mask)), F.lit(n)).cast("int").alias("part"), "gram", "n")

    def wanted(batches):
        done, block, grams = 0, None, []

        def rows():
            g = np.unique(np.concatenate(grams))
            part = (g >> np.uint64(8) & np.uint64(mask)) % np.uint64(n)
            order = np.argsort(part, kind="stable")
            parts, starts = np.unique(part[order], return_index=True)
            lists = np.split(g[order], starts[1:])
            return {"block": [block] * len(parts), "part": parts.astype(np.int32), "grams": [packed_grams(x) for x in lists]}

        for batch in batches:
            at, done = _blocks(batch, "text", done)
            for b in np.unique(at).tolist():
                if grams and b != block:
                    yield rows()
                    grams = []
                block = b
                own = np.flatnonzero(at == b)
                for _, texts in slices(batch.slice(own[0], len(own)), "text"):
                    g, _, ours = padded([t or b"" for t in texts], depth, END, END)
                    grams.append(np.unique(g[ours]))
                if sum(map(len, grams)) > 4 * FLUSH:
                    grams = [np.unique(np.concatenate(grams))]
        if grams:
            yield rows()

    def tree(t: pa.Table) -> Subtree:
        return subtree(depth, first, t.column("gram").to_numpy().astype(np.uint64), t.column("n").to_numpy())

    def passed_up(t: pa.Table) -> pa.Table:
        keys, zeros, ones, inner = lifted(*tree(t).root, first)
        return pa.table({"key": keys.astype(np.int64), "zeros": zeros, "ones": ones, "inner": inner})

    trees = lambda: []
    if first:
        up = trained.groupBy("part").applyInArrow(passed_up, "key long, zeros double, ones double, inner double")
        t = up.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "inner")]).orderBy("key").toPandas()
        trees = shared(df.sparkSession, [t["key"].to_numpy(np.int64).astype(np.uint64), *[t[c].to_numpy(float) for c in ("zeros", "ones", "inner")]], lambda x: [Subtree(first - 1, 0, *x)])

    def costs(t: pa.Table, asked: pa.Table) -> pa.Table:
        lists = [unpacked_grams(x) for x in asked.column("grams").to_pylist()]
        out = []
        if lists:
            g = np.unique(np.concatenate(lists))
            here = [tree(t), *trees()]
            cost = np.concatenate([whole_cost(here, x) for x in np.array_split(g, len(g) // 50_000 + 1)])
            out = [cost[np.searchsorted(g, x)].tobytes() for x in lists]
        return pa.table({"block": asked.column("block"), "grams": asked.column("grams"), "costs": pa.array(out, pa.binary())})

    asked = emit(df.select("text"), wanted, "block long, part int, grams binary")
    # as many tasks as parts, so that none gets more of them as the input grows
    dealt = [x.repartition(_tasks(df.sparkSession, n), "part") for x in (trained, asked)]
    return dealt[0].groupBy("part").cogroup(dealt[1].groupBy("part")).applyInArrow(costs, "block long, grams binary, costs binary")


def _tasks(spark: SparkSession, n: int) -> int:
    return max(n, int(spark.conf.get("spark.sql.shuffle.partitions")))


def packed_grams(grams: np.ndarray) -> bytes:
    """Sorted distinct grams as compressed differences: first all lowest bytes, then all next ones, and so on."""
    steps = np.diff(grams, prepend=np.uint64(0))
    return len(grams).to_bytes(4, "little") + pa.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), "zstd", asbytes=True)


def unpacked_grams(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    columns = np.frombuffer(pa.decompress(data[4:], 8 * n, "zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(columns.T).view(np.uint64).reshape(-1), dtype=np.uint64)


def score(df: DataFrame, counts: DataFrame, text: str = "text", keep: list[str] | None = None, depth: int = DEPTH, tree_bits: int | None = None, word_bits: int = WORD_BITS) -> DataFrame:
    """``df``'s kept columns with n_tokens, n_known, train_tokens, base_score and score; counts: ``corpus_counts`` of the training rows;
    tree_bits: bounds the tree, if given."""
    spark = df.sparkSession
    keep = [c for c in df.columns if c != text] if keep is None else keep
    counts = checkpointed(counts)
    words = counts.where("word IS NOT NULL").select("word", "n")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    least = max(1, math.ceil(total / (1 << word_bits)))
    common = words.where((F.col("n") >= least) & (F.octet_length("word") <= WORD_BYTES) | (F.col("word") == F.lit(END_WORD))).toPandas()
    frequent = {bytes(w): math.log10(n + 0.5) for w, n in zip(common["word"], common["n"].tolist(), strict=True)}
    end = frequent.get(END_WORD)
    scorer = shared(spark, (None if tree_bits is None else fit_tree(counts, depth, tree_bits), frequent), Scorer)

    def run(batches, cost=None):
        for batch in batches:
            for part, texts in slices(batch, "text"):
                s, texts = scorer(), [t or b"" for t in texts]
                ids = part.column(0).to_pylist()
                owner, rare, times, tokens, known, base = [], [], [], [], [], []
                for i, t in zip(ids, texts, strict=True):
                    found = space_words(t)
                    log, sure, get = end if end is not None else math.log10(0.5), int(end is not None), s.frequent.get
                    for w, n in Counter(found).items():
                        if (x := get(w)) is None:
                            owner.append(i)
                            rare.append(w)
                            times.append(n)
                        else:
                            log += n * x
                            sure += n
                    tokens.append(len(found) + 1)
                    known.append(sure)
                    base.append(log)
                m, r = len(ids), len(rare)
                yield {
                    # a document's own row joins with nothing, by a word that has a space
                    "rid": pa.array(ids + owner, pa.int64()), "word": pa.array([b" %d" % i for i in ids] + rare, pa.binary()), "times": pa.array([None] * m + times, pa.int64()),
                    "tokens": pa.array(tokens + [None] * r, pa.int64()), "known": pa.array(known + [None] * r, pa.int64()), "base": pa.array(base + [None] * r, pa.float64()), "score": pa.array([*scores(texts, depth, cost or s.cost).tolist(), *[None] * r], pa.float64()),
                    **{f"k{k}": _tail(part.column(k + 2), r) for k in range(len(keep))},
                }

    own = [df.schema[c].dataType for c in keep]
    docs = df.select(F.monotonically_increasing_id().alias("rid"), F.col(text).alias("text"), *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)])
    schema = ", ".join(["rid long, word binary, times long, tokens long, known long, base double, score double", *[f"k{i} {kind.simpleString()}" for i, kind in enumerate(own)]])
    if tree_bits is not None:
        rows = emit(docs, run, schema)
    else:
        arrow = _arrow_schema(T._parse_datatype_string(schema))

        def dealt(batches):
            done = 0
            for batch in batches:
                at, done = _blocks(batch, "text", done)
                for b in np.unique(at).tolist():
                    own = np.flatnonzero(at == b)
                    yield {"block": [b], "rows": [_packed_rows(batch.slice(own[0], len(own)))]}

        def block(texts: pa.Table, found: pa.Table) -> pa.Table:
            grams = np.concatenate([unpacked_grams(x) for x in found.column("grams").to_pylist()] or [np.zeros(0, np.uint64)])
            costs = np.concatenate([np.frombuffer(x, np.float32) for x in found.column("costs").to_pylist()] or [np.zeros(0, np.float32)])
            order = np.argsort(grams)
            grams, costs = grams[order], costs[order]

            def cost(wanted):
                i = _place(grams, wanted)
                if (i < 0).any():
                    raise RuntimeError("the texts' order changed between two readings")
                return costs[i]

            lookup = GramCache(lambda x: cost(x)[None, :], 1, 18).lookup
            made = run((b for x in texts.column("rows").to_pylist() for b in pa.ipc.open_stream(x)), lookup)
            return pa.Table.from_batches([pa.RecordBatch.from_arrays([x if isinstance(x := new[f.name], pa.Array) else pa.array(x, f.type) for f in arrow], schema=arrow) for new in made], arrow)

        placed = emit(docs, dealt, "block long, rows binary")
        n = _tasks(spark, 2 * (counts.where("gram IS NOT NULL").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // BLOCK_BYTES))
        dealt_out = [x.repartition(n, "block") for x in (placed, gram_costs(docs, counts, depth))]
        rows = dealt_out[0].groupBy("block").cogroup(dealt_out[1].groupBy("block")).applyInArrow(block, schema)
    met = rows.join(words.where(F.col("word") != F.lit(END_WORD)), "word", "left")
    found = F.coalesce("n", F.lit(0))
    # a document's own row alone has these; columns of fixed width keep the aggregate hashed
    fixed = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType)
    one = met.groupBy("rid").agg(
        *[F.max(c).alias(c) for c in ("tokens", "known", "base", "score")],
        *[(F.max(f"k{i}") if isinstance(kind, fixed) else F.first(f"k{i}", True)).alias(f"k{i}") for i, kind in enumerate(own)],
        F.coalesce(F.sum(F.col("times") * F.log10(found + F.lit(0.5))), F.lit(0.0)).alias("log"),
        F.coalesce(F.sum(F.when(found > 0, F.col("times"))), F.lit(0)).alias("sure"),
    )
    whole = math.log10(total + 0.5 * (distinct + 1))
    return one.select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)],
        F.col("tokens").alias("n_tokens"), (F.col("known") + F.col("sure")).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("log") - F.col("tokens") * F.lit(whole)).alias("base_score"), "score",
    )


def _packed_rows(batch: pa.RecordBatch) -> bytes:
    """Rows as a compressed Arrow stream."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _tail(column: pa.Array, n: int) -> pa.Array:
    return pa.concat_arrays([column, pa.nulls(n, column.type)])


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    counts = corpus_counts(documents.where(fold("doc_id", 5) != 1))
    return score(documents.select("doc_id", F.coalesce(fold("doc_id", 5) == 1, F.lit(False)).alias("held_out"), "text"), counts)
