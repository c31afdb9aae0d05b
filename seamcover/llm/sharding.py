"""Sharding by rendezvous hashing, in DataFrame functions only.

A record's key gets a pseudo-random number u in (0, 1) for every shard from the MD5 of "key:shard"; the shard with the
greatest -weight / ln(u) takes it, so a shard's share of the keys is its share of the weights, and the choice depends on
the key and the shards alone. A further shard takes only the records it wins itself; a removed one gives up only its
own. With equal weights the greatest hash wins, which is the same choice without the logarithm.

Slots number each shard's records from 0 without gaps. Equal records are counted before anything is ordered, so a key
of any frequency is one row; each shard is cut into ranges of the key's hash, the ranges' counts give their first
slots, and only a range is ever numbered by one task.

Edge cases: a null key is hashed as the text ``null`` and so has one shard. Of equal bids the shard of the smaller number
wins. Repeated rows have the same shard and slots of their own. A null text has size 16 and checksum 0; texts of any
length are read by their bytes' count and checksum alone. Columns named like the results are replaced. An empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seamcover.llm.common import checkpointed, read_table

SHARDS = 40
#: Bytes that a record takes besides its text.
RECORD_BYTES = 16
#: Distinct records of a range of slots, about.
RANGE_ROWS = 50_000
#: Rows of one step when equal records are spread again.
SPREAD = 4096


def shard_hash(key: Column, shard: int) -> Column:
    """52 bits of the MD5 of key and shard, as a long."""
    text = F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f":{shard}"))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def _score(key: Column, shard: int, weight: float | None) -> Column:
    h = shard_hash(key, shard)
    return h if weight is None else F.lit(-float(weight)) / F.ln((h + F.lit(0.5)) / F.lit(float(1 << 52)))


def assign(df: DataFrame, key: str, shards: int = SHARDS, weights: list[float] | None = None, name: str = "shard", grown: str | None = None) -> DataFrame:
    """``df`` with the shard of each key, and in ``grown`` that with one more shard (of the last one's weight).

    A shard of weight 0 takes nothing. Columns of the same names are replaced.
    """
    weights = [None] * shards if weights is None else weights
    if len(weights) != shards or not shards or any(w is not None and w < 0 for w in weights) or all(w == 0 for w in weights):
        raise ValueError("a weight of at least 0 is needed for each shard, one of them above 0")
    bid = lambda s, w: F.struct(_score(F.col(f"`{key}`"), s, w).alias("score"), F.lit(-s).alias("order"))
    live = [(s, w) for s, w in enumerate(weights) if w is None or w > 0]
    bids = [bid(s, w) for s, w in live]
    best = F.greatest(*bids) if len(bids) > 1 else bids[0]
    keep = [F.col(f"`{c}`") for c in df.columns if c not in (name, grown)]
    one = df.select(*keep, best.alias("_best"))
    out = [*keep, (-F.col("_best.order")).cast("int").alias(name)]
    if grown:
        more = bid(shards, weights[-1])
        out.append(F.when(more > F.col("_best"), F.lit(shards)).otherwise(-F.col("_best.order")).cast("int").alias(grown))
    return one.select(*out)


def slots(df: DataFrame, shard: str, order: list[str], name: str = "slot", range_rows: int = RANGE_ROWS) -> DataFrame:
    """The columns ``shard`` and ``order`` of every row, with its slot: 0 to n - 1 in each shard.

    The order within a range is that of the columns; equal rows get neighbouring slots.
    """
    columns = [shard, *order]
    counted = checkpointed(df.groupBy(*columns).agg(F.count("*").alias("_n")))
    distinct = counted.groupBy(shard).agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    ranges = max(1, -(-distinct // range_rows))
    cut = counted.withColumn("_range", F.pmod(F.xxhash64(*order), F.lit(ranges)).cast("long"))
    totals = cut.groupBy(shard, "_range").agg(F.sum("_n").alias("_all"))
    first = totals.withColumn("_first", F.sum("_all").over(Window.partitionBy(shard).orderBy("_range")) - F.col("_all")).drop("_all")
    inside = Window.partitionBy(shard, "_range").orderBy(*order)
    placed = cut.withColumn("_before", F.sum("_n").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"))
    start = placed.join(first, [shard, "_range"]).withColumn("_start", F.col("_first") + F.col("_before"))
    step = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_n - 1) div {SPREAD}"))).alias("_step")
    steps = start.select(*columns, "_n", "_start", step)
    last = F.least(F.col("_n"), (F.col("_step") + 1) * SPREAD) - 1
    copies = steps.select(*columns, "_start", F.explode(F.sequence(F.col("_step") * SPREAD, last)).alias("_copy"))
    return copies.select(*columns, (F.col("_start") + F.col("_copy")).alias(name))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents").select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + RECORD_BYTES).cast("long").alias("size"), F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32")
    )
    placed = slots(assign(documents, "doc_id", grown="grown_shard"), "shard", ["doc_id", "size", "text_crc32", "grown_shard"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
