"""Language ID by prediction by partial matching.

A byte context tree per language, of contexts of up to ORDER bytes, is counted over a bounded sample of labelled texts
and then frozen. A text's code length under a language is the sum over its bytes of -log2 p; p comes from the longest
context that has seen the byte, after the escape probabilities of the longer ones (method C: a context with n counts
of d distinct bytes gives c / (n + d) to a byte and d / (n + d) to the escape; a context never seen costs nothing).
Below order 0 every byte has 1/256. The language with the shortest code wins.

Texts are compared after A-Z is lower-cased and runs of ASCII bytes other than letters have become one space.

Edge cases: a null text, a text without a letter, or a model that learned nothing gives ``und``, score 0 and null
bits_per_byte. Ties go to the first language by name. Repeated rows are predicted alike, very long texts whole. Kept
columns of the results' names are replaced (the pipeline's stage keeps them). An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seamcover.llm.common import GramCache, add_columns, emit, fold, free_prefix, merged, padded, quoted, read_table, shared, slices

ORDER = 4
#: Of each language the sample takes so many texts and so many bytes of text at most, by the hash of the id; texts of
#: over 1 / LONG_SHARE of those bytes come behind all others, so that no single one uses the sample up.
SAMPLE_DOCS = 1_500
SAMPLE_BYTES = 6 << 20
#: Languages that are learned, those of the most rows, and bytes of the samples of all of them together.
LANGUAGES = 256
ALL_BYTES = 48 << 20
LONG_SHARE = 32
#: Longest code of an accepted text, in bits a byte: what the bytes themselves take.
REJECT_BITS = 8.0
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
FIELDS = {"lang_pred": "string", "score": "double", "bits_per_byte": "double"}


def normalised(text: bytes) -> bytes:
    return b" ".join(text.translate(LETTERS).split())


def has_letter(norm: bytes) -> bool:
    return not norm.isascii() and any(c.isalpha() for c in norm.decode("utf-8", "replace")) or norm.isascii() and bool(norm)


@dataclass
class Tree:
    """Counts of one order for all languages: grams and contexts sorted, counts by (entry, language)."""

    grams: np.ndarray
    counts: np.ndarray
    contexts: np.ndarray
    totals: np.ndarray
    distinct: np.ndarray


class Model:
    """Frozen trees of every order; ``cost`` gives bits of a gram's last byte after the others."""

    def __init__(self, languages: list[str], order: int, grams: np.ndarray, counts: np.ndarray):
        self.languages, self.order, self.trees = languages, order, []
        for k in range(order + 1):
            g, c = _summed(grams & np.uint64((1 << 8 * (k + 1)) - 1), counts)
            contexts, totals = _summed(g >> np.uint64(8), c)
            distinct = _summed(g >> np.uint64(8), (c > 0).astype(np.int64))[1]
            self.trees.append(Tree(g, c.astype(np.float32), contexts, totals.astype(np.float32), distinct.astype(np.float32)))

    def cost(self, grams: np.ndarray) -> np.ndarray:
        bits = np.zeros((len(self.languages), len(grams)))
        todo = np.ones(bits.shape, bool)
        for k in range(self.order, -1, -1):
            tree = self.trees[k]
            g = grams & np.uint64((1 << 8 * (k + 1)) - 1)
            c, n, d = _at(tree.grams, tree.counts, g), _at(tree.contexts, tree.totals, g >> np.uint64(8)), _at(tree.contexts, tree.distinct, g >> np.uint64(8))
            whole = np.maximum(n + d, 1)
            found, escape = todo & (c > 0), todo & (c == 0) & (n > 0)
            bits[found] -= np.log2((c / whole)[found])
            bits[escape] -= np.log2((d / whole)[escape])
            todo &= c == 0
        bits[todo] += 8
        return bits.astype(np.float32)


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unique, place = np.unique(keys, return_inverse=True)
    out = np.zeros((len(unique), values.shape[1]), np.int64)
    np.add.at(out, place, values)
    return unique, out


def _at(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Values of the wanted keys by (language, gram), 0 where a key is missing."""
    if not len(keys):
        return np.zeros((values.shape[1], len(wanted)), np.float32)
    i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[i] == wanted, values[i].T, np.float32(0))


def fit(labelled: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id", order: int = ORDER, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """A model of the labelled rows; rows with a null label or text teach nothing.

    The sample of a language holds its rows of the smallest hashes of the key, long texts last, up to ``sample_docs``
    rows and ``sample_bytes`` bytes (or its share of ALL_BYTES), but one row at least. So the grams that reach the driver
    are bounded by ALL_BYTES, or the first texts where these are longer. Rows are chosen by hashes and lengths alone;
    the texts come to them by a join.
    """
    rows = labelled.select(quoted(lang).alias("lang"), quoted(text).alias("text"), F.xxhash64(quoted(key).cast("string")).alias("h")).where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    sample_bytes = min(sample_bytes, ALL_BYTES // max(1, len(sizes)))
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], 1.0 if r["count"] < 4 * sample_docs else 1.3 * sample_docs / r["count"])]) if sizes else F.create_map(F.lit(""), F.lit(0.0))
    near = rows.where(F.pmod("h", F.lit(1 << 30)) <= share[F.col("lang")] * (1 << 30)).withColumn("t", F.xxhash64("text"))
    by_hash = Window.partitionBy("lang").orderBy(F.col("size") > sample_bytes // LONG_SHARE, "h", "t")
    chosen = (
        near.select("lang", "h", "t", F.octet_length("text").alias("size")).withColumn("rank", F.row_number().over(by_hash)).where(F.col("rank") <= sample_docs)
        .withColumn("so_far", F.sum("size").over(by_hash.rowsBetween(Window.unboundedPreceding, 0)))
        .where((F.col("so_far") <= sample_bytes) | (F.col("rank") == 1)).groupBy("lang", "h", "t").agg(F.count("*").alias("n"))
    )
    # bounded: sample_docs rows of a language
    sample = near.join(F.broadcast(chosen), ["lang", "h", "t"]).dropDuplicates(["lang", "h", "t"]).select("lang", "text", "n")

    def count(batches):
        seen: dict[str, tuple[list, list]] = {}
        for batch in batches:
            for part, texts in slices(batch, "text"):
                names, times = part.column(0).to_pylist(), part.column(2).to_pylist()
                for name in set(names):
                    own = [x for n, t, k in zip(names, texts, times, strict=True) if n == name for x in [normalised(t) + b" "] * k]
                    grams, _, counts = padded(own, order, b" ")
                    u, c = np.unique(grams[counts], return_counts=True)
                    g, k = seen.get(name, ([], []))
                    seen[name] = tuple([x] for x in merged([*g, u], [*k, c]))
        for name, (g, c) in seen.items():
            yield {"lang": [name] * len(g[0]), "gram": g[0].astype(np.int64), "n": c[0]}

    found = emit(sample, count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(found["lang"].unique())
    grams, place = np.unique(found["gram"].to_numpy(np.int64).astype(np.uint64), return_inverse=True)
    counts = np.zeros((len(grams), len(languages)), np.int64)
    counts[place, np.searchsorted(languages, found["lang"].to_numpy(str)) if languages else place] = found["n"].to_numpy(np.int64)
    return Model(languages, order, grams, counts)


class Scorer:
    """Predictions of a model, with the costs of frequent grams kept."""

    def __init__(self, model: Model):
        self.model = model
        self.cache = GramCache(model.cost, len(model.languages))

    def __call__(self, texts: list[bytes | None]) -> dict[str, list]:
        names, scores, bits = ["und"] * len(texts), [0.0] * len(texts), [None] * len(texts)
        norms = [normalised(t or b"") for t in texts]
        live = [i for i, n in enumerate(norms) if has_letter(n)] if self.model.languages else []
        if live:
            grams, starts, count = padded([norms[i] for i in live], self.model.order, b" ", b" ")
            cost = self.cache.lookup(grams)
            cost[:, ~count] = 0
            lengths = np.stack([np.add.reduceat(x, starts, dtype=np.float64) for x in cost])
            best = lengths.argmin(0)
            least = lengths.min(0)
            share = 1 / np.exp2(np.maximum(least - lengths, -1000)).sum(0)
            for j, i in enumerate(live):
                names[i], scores[i], bits[i] = self.model.languages[best[j]], float(share[j]), float(least[j] / (len(norms[i]) + 1))
        return {"lang_pred": names, "score": scores, "bits_per_byte": bits}


def predict(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """``df`` with lang_pred, score (the winner's share of the languages' 2 ** -length) and bits_per_byte."""
    scorer = shared(df.sparkSession, model, Scorer)
    return add_columns(df, text, lambda texts: scorer()(texts), FIELDS, keep, prefix)


def training_rows(documents: DataFrame, parts: int = 3, held_out: int = 1) -> DataFrame:
    return documents.where((fold("doc_id", parts) != held_out) & F.col("lang").isNotNull())


def accepted(prefix: str = "") -> Column:
    """Whether a predicted row stays: it has a language whose tree codes it in fewer bits than its bytes."""
    return (F.col(f"{prefix}lang_pred") != "und") & (F.col(f"{prefix}bits_per_byte") <= REJECT_BITS)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    model = fit(training_rows(documents))
    rows = documents.select("doc_id", "text", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"))
    return predict(rows, model, keep=["doc_id", "held_out"])


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; ``und`` and texts coded in over REJECT_BITS bits a byte go."""
    model = fit(training_rows(docs))
    own = free_prefix(docs.columns)
    return predict(docs, model, prefix=own).where(accepted(own)).select(*map(quoted, docs.columns))
