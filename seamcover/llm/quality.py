"""Quality rules in a bitmask ledger.

Every rule is evaluated once for every text; the ledger keeps the measurements and one bit for each rule that failed.
Policies are versioned masks over those bits: applying one, or finding what each of its rules alone removes, is bit
arithmetic on the ledger and never reads the texts again.

Words are ``[^\\x20\\x09-\\x0D]+``, case kept. A line counts if it has a word; it is a duplicate if it equals an earlier
line of the text. A word is repeated if it lies in a window of three words that the text holds twice or more.

Edge cases: a null text has no words and every count 0 (so it fails ``few_words``). Repeated rows are judged alike, very
long texts whole. Kept columns of the measurements' names are replaced. An empty table gives no rows. An unknown policy
raises KeyError.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seamcover.llm.common import CONTINUATION, add_columns, read_table

SPACES = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
#: ASCII that is neither a letter nor white space.
NO_LETTERS = bytes(b for b in range(128) if not chr(b).isalpha() and b not in SPACES)
MEASURES = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "n_lines": "long", "n_alpha_words": "long", "n_upper": "long"}

#: Rules by name, as SQL over the measurements; the order fixes the bits, so new rules go at the end.
RULES = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "many_symbols": "100 * n_symbols > 30 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "duplicate_lines": "10 * n_dup_lines > 6 * n_lines",
    "few_letters": "10 * n_alpha_words < 5 * n_words",
    "shouting": "10 * n_upper > 6 * word_chars",
}
#: Rules of each version of the policy.
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "many_symbols", "long_words", "short_words", "duplicate_lines"),
    "v2": tuple(RULES),
}
POLICY = "v2"


def repeated(words: list[bytes]) -> int:
    """Words in three-word windows that occur twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    m = len(number)
    if m == n:
        return 0
    pairs = ids[:-1] * m + ids[1:]
    pairs = np.unique(pairs, return_inverse=True)[1] if m > 1_000_000 else pairs  # three numbers under 2**20 fit 63 bits
    windows = pairs[:-1] * m + ids[2:]
    _, place, count = np.unique(windows, return_inverse=True, return_counts=True)
    twice = count[place] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def measure(text: bytes | None) -> tuple[int, ...]:
    """The MEASURES of one text."""
    text = text or b""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.translate(None, SPACES)] if b"\n" in text else [text] if words else []
    chars = len(text.translate(None, SPACES + CONTINUATION))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lower = text.lower()
    upper = int(np.count_nonzero(np.frombuffer(text, np.uint8) != np.frombuffer(lower, np.uint8)))
    alpha = len(text.translate(None, NO_LETTERS).split())
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated(words), len(lines), alpha, upper


def ledger(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``df``'s kept columns, the measurements, and ``fail_bits``: bit i is set if the i-th of RULES failed."""

    def run(texts):
        columns = zip(*[measure(t) for t in texts], strict=True) if texts else [[] for _ in MEASURES]
        return {k: pa.array(c, pa.int64()) for k, c in zip(MEASURES, columns, strict=True)}

    measured = add_columns(df, text, run, MEASURES, keep)
    bits = [F.when(F.expr(rule), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, rule in enumerate(RULES.values())]
    return measured.withColumn("fail_bits", reduce(lambda a, b: a.bitwiseOR(b), bits))


def mask(policy: str) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in POLICIES[policy])


def fails(policy: str, bits: str = "fail_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(mask(policy)).cast("long")) != 0


def ablation(books: DataFrame, policy: str = POLICY) -> DataFrame:
    """For each rule of a policy: how many texts it fails, how many it alone fails, and how many all others keep.

    The ledger is first counted by its bits (at most 2**rules rows), so the text rows are read once.
    """
    m = mask(policy)
    by_bits = books.groupBy(F.col("fail_bits").bitwiseAND(F.lit(m).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << list(RULES).index(r)).cast("long").alias("bit")) for r in POLICIES[policy]]))
    each = by_bits.select("bits", "n", rules.alias("r"))
    rest = F.col("bits").bitwiseAND(F.lit(m).cast("long").bitwiseXOR(F.col("r.bit")))
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_alone"),
        F.sum(F.when(rest == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
    )


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    books = ledger(read_table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return books.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", fails("base").alias("base_failed"), (~fails("base") & ~fails(POLICY)).alias("kept"), "fail_bits")
