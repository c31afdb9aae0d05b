"""Graph primitives as DataFrame plans."""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Distinct edges, 16 bytes each, of a graph that one task contracts.
SMALL_GRAPH = 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a temporary folder of this machine, which a cluster may not use."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
    return tempfile.mkdtemp(prefix="checkpoint")


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows, written to spark.checkpoint.dir (shared by all executors).

    The plan that reads them begins without the constraints of the plan that made them: over many rounds those grow,
    and some refer to columns that are no longer there.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    conf, key = df.sparkSession.conf, "spark.sql.constraintPropagation.enabled"
    before = conf.get(key)
    conf.set(key, "false")
    try:
        return df.checkpoint(eager=True)
    finally:
        conf.set(key, before)


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component) for every node of the edges; component is the smallest node that can be reached.

    Alternates two contractions until nothing changes: the large star joins each larger neighbour of a node to the
    node's smallest neighbour, the small star joins the smaller ones to it. The number of rounds grows with the
    logarithm of the number of nodes. Both are a minimum by key joined back to the edges, so a node of any degree is
    never gathered, and a hot key of the join can be split at runtime. Null ends and self links are ignored. A graph of
    SMALL_GRAPH edges or fewer, by its count, is contracted by one task instead, which saves the rounds' jobs.
    """
    e = edges.select(F.greatest(u, v).alias("a"), F.least(u, v).alias("b")).where(f"{u} IS NOT NULL AND {v} IS NOT NULL AND a <> b").distinct()
    e = cut_lineage(e)
    if e.limit(SMALL_GRAPH + 1).count() <= SMALL_GRAPH:
        return e.coalesce(1).mapInArrow(_contracted, "node long, component long")
    before = None
    while True:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a")
        star = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(lowest.select("a", F.col("m").alias("b")))
        e = cut_lineage(star.where("a <> b").distinct())
        state = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select(F.col("b"), F.col("b"))).distinct()


def _contracted(batches):
    """(node, component) of a whole small graph: labels sink to the least of their neighbours' and are followed."""
    parts = list(batches)
    ends = [np.concatenate([b.column(k).to_numpy() for b in parts]) if parts else np.zeros(0, np.int64) for k in (0, 1)]
    nodes, place = np.unique(np.concatenate(ends), return_inverse=True)
    u, v = place.reshape(-1)[: len(ends[0])], place.reshape(-1)[len(ends[0]) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        for at in (label[u], label[v], u, v):
            np.minimum.at(new, at, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(nodes[label], pa.int64())], names=["node", "component"])
