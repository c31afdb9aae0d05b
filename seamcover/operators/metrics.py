"""Coverage, accuracy and shape metrics as aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def iou(truth: DataFrame, out: DataFrame) -> DataFrame:
    """(cls, n_both, n_truth, n_out, iou) over the pixels that both rasters have."""
    pairs = truth.select("px", "py", F.col("cls").alias("t")).join(out.select("px", "py", F.col("cls").alias("o")), ["px", "py"]).groupBy("t", "o").agg(F.count("*").alias("n"))
    each = pairs.select("n", "t", "o", F.explode(F.array_distinct(F.array("t", "o"))).alias("cls"))
    sums = each.groupBy("cls").agg(
        F.sum(F.when(F.col("t") == F.col("o"), F.col("n")).otherwise(0)).alias("n_both"), F.sum(F.when(F.col("t") == F.col("cls"), F.col("n")).otherwise(0)).alias("n_truth"),
        F.sum(F.when(F.col("o") == F.col("cls"), F.col("n")).otherwise(0)).alias("n_out"),
    )
    return sums.withColumn("iou", F.col("n_both") / (F.col("n_truth") + F.col("n_out") - F.col("n_both")))


def accuracy(truth: DataFrame, out: DataFrame) -> DataFrame:
    """One row: mean IoU and overall accuracy."""
    per = iou(truth, out)
    return per.agg(F.avg("iou").alias("miou"), (F.sum("n_both") / F.sum("n_truth")).alias("oa"))


def class_changes(truth: DataFrame, out: DataFrame) -> DataFrame:
    """(cls, n_in, n_out, n_union, n_xor, change): areas in pixels, that of the symmetric difference, and the change as a
    share of the area before."""
    per = iou(truth, out)
    union = F.col("n_truth") + F.col("n_out") - F.col("n_both")
    return per.select("cls", F.col("n_truth").alias("n_in"), "n_out", union.alias("n_union"), (union - F.col("n_both")).alias("n_xor"), F.when(F.col("n_truth") > 0, F.col("n_out") / F.col("n_truth") - 1).alias("change"))


def change_summary(changes: DataFrame) -> DataFrame:
    """One row: change of the whole area, and mean, greatest and area-weighted mean of the classes' absolute changes."""
    size = F.abs("change")
    return changes.agg(
        (F.sum("n_out") / F.sum("n_in") - 1).alias("total"), F.avg(size).alias("mean"), F.max(size).alias("greatest"), (F.sum(F.abs(F.col("n_out") - F.col("n_in"))) / F.sum("n_in")).alias("weighted"),
    )


def overlap_and_gap(burnt: DataFrame, frame: DataFrame) -> DataFrame:
    """One row: n_overlap, how often pixels are covered again, and n_gap, pixels of the frame that no polygon covers."""
    covers = burnt.groupBy("px", "py").agg(F.count("*").alias("n"))
    both = frame.select("px", "py", F.lit(True).alias("there")).join(covers, ["px", "py"], "full")
    return both.agg(F.coalesce(F.sum(F.greatest(F.col("n") - 1, F.lit(0))), F.lit(0)).cast("long").alias("n_overlap"), F.count_if(F.col("there") & F.col("n").isNull()).alias("n_gap"))


def broken(found: DataFrame, area: float, limit: float = 1e-6) -> DataFrame:
    """Reports (n_invalid, overlap, gap) with ``broken``: an invalid polygon, or over ``limit`` of the area lapped or open."""
    return found.withColumn("broken", (F.col("n_invalid") > 0) | (F.col("overlap") > limit * area) | (F.col("gap") > limit * area))


def sharp_turns(e: DataFrame, degrees: float = 45.0) -> DataFrame:
    """(poly_id, n_turns, n_sharp, length): turns of ring edges, those of more than ``degrees``, and the rings' length;
    ``n_sharp / length`` is the share a unit of border."""
    order = Window.partitionBy("poly_id", "ring").orderBy("seq")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = e.withColumn("d", F.struct((F.col("x1") - F.col("x0")).cast("double").alias("x"), (F.col("y1") - F.col("y0")).cast("double").alias("y")))
    d = d.withColumn("n", F.coalesce(F.lead("d").over(order), F.first("d").over(whole)))
    turn = F.abs(F.degrees(F.atan2(F.col("d.x") * F.col("n.y") - F.col("d.y") * F.col("n.x"), F.col("d.x") * F.col("n.x") + F.col("d.y") * F.col("n.y"))))
    return d.groupBy("poly_id").agg(F.count("*").alias("n_turns"), F.count_if(turn > degrees).alias("n_sharp"), F.sum(F.hypot("d.x", "d.y")).alias("length"))


def fingerprint(e: DataFrame) -> DataFrame:
    """(poly_id, area, x, y, n_points): what tells one polygon from another whatever its vertices' order: area and
    centroid, both rounded to four digits, and the number of vertices."""
    x0, y0, x1, y1 = (F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1"))
    cross = x0 * y1 - x1 * y0
    sums = e.groupBy("poly_id").agg(F.sum(cross).alias("a"), F.sum((x0 + x1) * cross).alias("mx"), F.sum((y0 + y1) * cross).alias("my"), F.count("*").alias("n_points"))
    return sums.select("poly_id", F.round(F.col("a") / 2, 4).alias("area"), F.round(F.col("mx") / (3 * F.col("a")), 4).alias("x"), F.round(F.col("my") / (3 * F.col("a")), 4).alias("y"), "n_points")


def differences(distances: DataFrame) -> DataFrame:
    """One row about the distances between two results: n, the share of identical places, median, p95 and greatest."""
    return distances.agg(F.count("*").alias("n"), F.avg((F.col("distance") == 0).cast("double")).alias("identical"), F.percentile("distance", 0.5).alias("median"), F.percentile("distance", 0.95).alias("p95"), F.max("distance").alias("greatest"))


def against_baseline(tune: DataFrame, baseline: DataFrame, group: list[str], score: str) -> DataFrame:
    """Rows with ``gain``, their score less that of their group's baseline row; baseline: a row a group, a small report."""
    base = baseline.select(*group, F.col(score).alias("_base"))
    return tune.join(F.broadcast(base), group).withColumn("gain", F.col(score) - F.col("_base")).drop("_base")


def shape(e: DataFrame, bins: int = 36) -> DataFrame:
    """One row about ring edges: n_edges, n_axis (parallel to an axis), n_sharp (turns of 60 degrees or more), entropy of
    the orientations (0 to 1, by length in ``bins`` bins of 180 degrees)."""
    order = Window.partitionBy("poly_id", "ring").orderBy("seq")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = e.withColumn("dx", F.col("x1") - F.col("x0")).withColumn("dy", F.col("y1") - F.col("y0"))
    nxt = F.coalesce(F.lead(F.struct("dx", "dy")).over(order), F.first(F.struct("dx", "dy")).over(whole))
    d = d.withColumn("n", nxt).withColumn("length", F.hypot("dx", "dy"))
    dot = F.col("dx") * F.col("n.dx") + F.col("dy") * F.col("n.dy")
    turn = F.degrees(F.atan2(F.abs(F.col("dx") * F.col("n.dy") - F.col("dy") * F.col("n.dx")).cast("double"), dot.cast("double")))
    angle = F.pmod(F.degrees(F.atan2(F.col("dy").cast("double"), F.col("dx").cast("double"))), F.lit(180.0))
    by_bin = d.groupBy(F.least(F.floor(angle * bins / 180), F.lit(bins - 1)).alias("bin")).agg(
        F.sum("length").alias("length"), F.count("*").alias("n_edges"), F.sum(((F.col("dx") == 0) | (F.col("dy") == 0)).cast("long")).alias("n_axis"), F.sum((turn >= 59.999999).cast("long")).alias("n_sharp")
    )
    # sum of p ln p = (sum of l ln l) / L - ln L, so one pass over the bins is enough
    log = F.sum(F.col("length") * F.log("length")) / F.sum("length") - F.log(F.sum("length"))
    return by_bin.agg(F.sum("n_edges").alias("n_edges"), F.sum("n_axis").alias("n_axis"), F.sum("n_sharp").alias("n_sharp"), (-log / F.log(F.lit(float(bins)))).alias("entropy"))


def boundary(distances: DataFrame, close: float) -> DataFrame:
    """One row about border distances: mean, p95, greatest, and the share within ``close``."""
    return distances.agg(F.avg("distance").alias("mean"), F.percentile("distance", 0.95).alias("p95"), F.max("distance").alias("hausdorff"), F.avg((F.coalesce(F.col("distance") <= close, F.lit(False))).cast("double")).alias("within"))


def boundary_both(out: DataFrame, truth: DataFrame, close: float) -> DataFrame:
    """One row about the exact border distances of both directions, pooled: mean, p95, hausdorff, and the shares within
    ``close`` of the output's borders (precision) and of the true ones (recall), with their f1."""
    near = lambda side: F.coalesce(F.avg(F.when(F.col("side") == side, (F.col("distance") <= close).cast("double"))), F.lit(0.0))
    pooled = out.select("distance", F.lit(0).alias("side")).unionByName(truth.select("distance", F.lit(1).alias("side")))
    found = pooled.agg(F.avg("distance").alias("mean"), F.percentile("distance", 0.95).alias("p95"), F.max("distance").alias("hausdorff"), near(0).alias("precision"), near(1).alias("recall"))
    both = F.col("precision") + F.col("recall")
    return found.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0))


def best_parameter(tune: DataFrame, group: list[str], score: str, order: str) -> DataFrame:
    """The row of the greatest score in each group, the first by ``order`` on ties."""
    w = Window.partitionBy(*group).orderBy(F.col(score).desc(), order)
    return tune.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def mean_rank(scores: DataFrame, item: str, case: str, score: str) -> DataFrame:
    """Mean over cases of an item's rank, 1 for the greatest score; equal scores share the mean of their ranks."""
    rank = F.rank().over(Window.partitionBy(case).orderBy(F.col(score).desc())) + (F.count("*").over(Window.partitionBy(case, score)) - 1) / 2
    return scores.withColumn("_r", rank).groupBy(item).agg(F.avg("_r").alias("mean_rank"))


def pareto(items: DataFrame, key: str, costs: list[str]) -> DataFrame:
    """Items that no other one beats: at most the same in all costs and less in one. ``items`` is a report of few rows;
    the anti-join by comparison is quadratic in it."""
    other = items.select(*[F.col(c).alias(f"_{c}") for c in costs])
    better, strict = F.lit(True), F.lit(False)
    for c in costs:
        better, strict = better & (F.col(f"_{c}") <= F.col(c)), strict | (F.col(f"_{c}") < F.col(c))
    return items.join(other, better & strict, "left_anti").select(key, *costs)


def digest(df: DataFrame, binary: str) -> DataFrame:
    """One row: n and the SHA-256 of the sorted hex hashes of the values, whatever their order.

    Values are hashed and counted first and summed up by prefix, so a digest of 256 prefixes is all that meets.
    """
    h = df.select(F.sha2(F.col(binary).cast("binary"), 256).alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    part = h.groupBy(F.substring("h", 1, 2).alias("p")).agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "h", "n"))), ","), 256).alias("d"))
    return part.agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p", "d"))), lambda x: x.d), ","), 256).alias("digest"))


def duplicates(e: DataFrame) -> DataFrame:
    """One row: n_duplicate_edges, the directed edges beyond the first owner; a clean coverage has none."""
    each = e.groupBy("x0", "y0", "x1", "y1").agg(F.count("*").alias("n"))
    return each.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("n_duplicate_edges"))


def summary(arcs: DataFrame, results: DataFrame) -> DataFrame:
    """One row of counts by arc state and polygon status."""
    a = arcs.agg(F.count("*").alias("n_arcs"), *[F.count_if(F.col("state") == s).alias(n) for s, n in ((1, "n_smoothed"), (2, "n_original"), (3, "n_reverted"), (4, "n_half"), (5, "n_corner"))])
    r = results.agg(F.count("*").alias("n_polygons"), F.count_if(F.col("status") == 1).alias("n_valid"), F.count_if(F.col("status") < 1).alias("n_invalid"))
    return a.crossJoin(r)  # two single rows
