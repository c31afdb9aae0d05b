"""Raster operators over pixel tables.

A raster is a DataFrame (px, py, cls) of its pixels; a pixel without a row, or with a null class, is nodata. ``pixel``
is py * width + px. Rows and columns are the partition keys of all windows, so no window spans the whole raster.
Regions are numbered by their smallest pixel; polygon ids are that plus 1, and 0 is the outside.
"""

from __future__ import annotations

import math
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seamcover.functions.graph import SMALL_GRAPH, connected_components, cut_lineage

def along_row():
    return Window.partitionBy("py").orderBy("px")


def along_column():
    return Window.partitionBy("px").orderBy("py")




def validate_integer_band(raster: DataFrame, cls: str = "cls") -> None:
    """Raises ValueError unless the classes are integers within 32 bits; one min/max aggregate for 64-bit columns."""
    kind = raster.schema[cls].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"classes must be integers, not {kind}")
    if kind == "bigint":
        low, high = raster.agg(F.min(cls), F.max(cls)).first()
        if low is not None and (low < -(1 << 31) or high >= 1 << 31):
            raise ValueError(f"classes must fit 32 bits; they reach from {low} to {high}")


def mask_nodata(raster: DataFrame, nodata: int | None = None) -> DataFrame:
    """Pixels that have data."""
    kept = raster.where("cls IS NOT NULL")
    return kept if nodata is None else kept.where(F.col("cls") != nodata)


def crop(raster: DataFrame, width: int, height: int, x0: int = 0, y0: int = 0) -> DataFrame:
    return raster.where(F.col("px").between(x0, x0 + width - 1) & F.col("py").between(y0, y0 + height - 1))


def box_blur(raster: DataFrame, half: int, passes: int = 3, value: str = "v") -> DataFrame:
    """Sums over boxes of 2 * half + 1 pixels, cut at the border, ``passes`` times; exact for integers."""
    for _ in range(passes):
        for window in (along_row(), along_column()):
            raster = raster.withColumn(value, F.sum(value).over(window.rangeBetween(-half, half)))
    return raster


def quantile_thresholds(df: DataFrame, value: str, parts: int, bins: int = 4096) -> list[int]:
    """For k = 1 .. parts - 1 the integer value of rank ceil(k * n / parts), exactly.

    Each round counts the values that lie in the spans still open, of all thresholds in one job, so the driver gets
    ``bins`` rows a threshold at most and no sort of the table is needed; there are log(range) / log(bins) rounds.
    """
    n, low, high = df.agg(F.count(value), F.min(value), F.max(value)).first()
    if not n:
        return []
    spans = [[low, high, -(-k * n // parts)] for k in range(1, parts)]  # first and last value, rank in the span
    while open_ := sorted({(a, b) for a, b, _ in spans if a < b}):
        width = {s: -(-(s[1] - s[0] + 1) // bins) for s in open_}
        cell = reduce(lambda c, s: c.when(F.col(value).between(*s), F.struct(F.lit(s[0]).alias("a"), F.floor((F.col(value) - s[0]) / width[s]).alias("bin"))), open_, F)
        counted: dict[int, list] = {}
        for r in df.select(cell.alias("c")).where("c IS NOT NULL").groupBy("c.a", "c.bin").count().orderBy("a", "bin").collect():
            counted.setdefault(r["a"], []).append((r["bin"], r["count"]))
        for s in spans:
            if s[0] < s[1]:
                a, b, w = s[0], s[1], width[s[0], s[1]]
                for k, count in counted[a]:
                    if count >= s[2]:
                        s[:2] = a + k * w, min(b, a + (k + 1) * w - 1)
                        break
                    s[2] -= count
    return [a for a, _, _ in spans]


def quantile_classes(df: DataFrame, parts: int, value: str = "v", name: str = "cls") -> DataFrame:
    """Class 1 + the number of thresholds below the value."""
    steps = [F.when(F.col(value) > t, 1).otherwise(0) for t in quantile_thresholds(df, value, parts)]
    return df.withColumn(name, sum(steps, F.lit(1)).cast("int"))


def runs(raster: DataFrame, width: int) -> DataFrame:
    """Pixels with ``run``: the first pixel of their horizontal run of one class."""
    pixel = F.col("py") * F.lit(width).cast("long") + F.col("px")
    begins = F.lag("px").over(along_row()).isNull() | (F.lag("px").over(along_row()) != F.col("px") - 1) | (F.lag("cls").over(along_row()) != F.col("cls"))
    marked = raster.withColumn("_begin", F.when(begins, pixel))
    return marked.withColumn("run", F.max("_begin").over(along_row().rowsBetween(Window.unboundedPreceding, 0))).drop("_begin")


def regions(raster: DataFrame, width: int, eight: bool = False) -> DataFrame:
    """Pixels with ``region``: the smallest pixel of their 4-connected (or 8-connected) region of one class.

    Runs are joined, not pixels: the graph has an edge where runs of neighbouring rows touch.
    """
    labelled = runs(mask_nodata(raster), width)
    windows = [along_column()]
    if eight:
        windows += [Window.partitionBy(F.col("px") - F.col("py")).orderBy("py"), Window.partitionBy(F.col("px") + F.col("py")).orderBy("py")]
    edges = None
    for w in windows:
        touch = labelled.select("run", "cls", "py", F.lag("run").over(w).alias("up"), F.lag("cls").over(w).alias("up_cls"), F.lag("py").over(w).alias("up_py"))
        found = touch.where("up_cls = cls AND up_py = py - 1").select(F.col("run").alias("u"), F.col("up").alias("v")).distinct()
        edges = found if edges is None else edges.union(found)
    parts = connected_components(edges).withColumnRenamed("node", "run")
    return labelled.join(parts, "run", "left").withColumn("region", F.coalesce("component", "run")).drop("component", "run")


def neighbours(pixels: DataFrame, label: str = "region") -> DataFrame:
    """Pixels with the labels ``left``, ``right``, ``up``, ``down`` of their neighbours, null where there is none."""
    for name, window, axis, step in (("left", along_row(), "px", -1), ("right", along_row(), "px", 1), ("up", along_column(), "py", -1), ("down", along_column(), "py", 1)):
        move = F.lag if step < 0 else F.lead
        pixels = pixels.withColumn(name, F.when(move(axis).over(window) == F.col(axis) + step, move(label).over(window)))
    return pixels


def region_edges(labelled: DataFrame) -> DataFrame:
    """Directed border edges (poly_id, other, x0, y0, x1, y1, cls), the region on the left.

    y points up: row py has its upper edge at y = -py. ``other`` is the polygon on the right, 0 outside.
    """
    near = neighbours(labelled)
    x, y = F.col("px"), -F.col("py")
    sides = (("down", x, y - 1, x + 1, y - 1), ("right", x + 1, y - 1, x + 1, y), ("up", x + 1, y, x, y), ("left", x, y, x, y - 1))
    edge = lambda side, *q: F.struct(F.col(side).alias("other"), *[c.cast("long").alias(n) for n, c in zip(("x0", "y0", "x1", "y1"), q, strict=True)])
    border = F.filter(F.array(*[edge(*s) for s in sides]), lambda s: s.other.isNull() | (s.other != F.col("region")))
    return near.select("region", "cls", F.explode(border).alias("e")).select((F.col("region") + 1).alias("poly_id"), F.coalesce(F.col("e.other") + 1, F.lit(0)).alias("other"), "e.x0", "e.y0", "e.x1", "e.y1", "cls")


def sieve(raster: DataFrame, width: int, threshold: int, eight: bool = False) -> DataFrame:
    """Regions of fewer than ``threshold`` pixels take the class of their largest neighbour; ties: the smallest region.

    A small region whose largest neighbour is small follows that one's choice, until a large region or a cycle is
    reached; a region of a cycle, or without a neighbour, keeps its class.
    """
    labelled = cut_lineage(regions(raster, width, eight))
    sizes = labelled.groupBy("region").agg(F.count("*").alias("n"), F.first("cls").alias("cls"))
    near = neighbours(labelled).select("region", F.explode(F.array("left", "right", "up", "down")).alias("other")).where("other IS NOT NULL AND other <> region").distinct()
    small = sizes.where(F.col("n") < threshold).select("region", "cls")
    other = sizes.select(F.col("region").alias("other"), F.col("n").alias("m"), F.col("cls").alias("to"))
    best = near.join(small, "region").join(other, "other").groupBy("region").agg(F.max(F.struct("m", (-F.col("other")).alias("o"), "to")).alias("b"))
    chain = cut_lineage(best.select("region", (-F.col("b.o")).alias("next"), F.col("b.m").alias("m"), F.col("b.to").alias("to")))
    if chain.limit(SMALL_GRAPH + 1).count() <= SMALL_GRAPH:
        final = chain.coalesce(1).mapInArrow(partial(_followed, threshold), f"region long, to {chain.schema['to'].dataType.simpleString()}")
        return labelled.join(final, "region", "left").select("px", "py", F.coalesce("to", "cls").alias("cls"))
    # Doubling: a round that brings no further choice to a large region is the last, as those that are left go round.
    before, left = None, chain.where(F.col("m") < threshold).count()
    while left and left != before:
        ahead = chain.select(F.col("region").alias("next"), F.col("next").alias("n2"), F.col("m").alias("m2"), F.col("to").alias("to2"))
        stepped = chain.join(ahead, "next", "left")
        go = (F.col("m") < threshold) & F.col("n2").isNotNull()
        chain = cut_lineage(stepped.select("region", F.when(go, F.col("n2")).otherwise(F.col("next")).alias("next"), F.when(go, F.col("m2")).otherwise(F.col("m")).alias("m"), F.when(go, F.col("to2")).otherwise(F.col("to")).alias("to")))
        before, left = left, chain.where(F.col("m") < threshold).count()
    final = chain.where(F.col("m") >= threshold).select("region", "to")
    return labelled.join(final, "region", "left").select("px", "py", F.coalesce("to", "cls").alias("cls"))


def _followed(threshold: int, batches):
    """(region, to) of the small regions, at most SMALL_GRAPH, whose chain of choices ends at a large one."""
    for batch in [pa.Table.from_batches(x) for x in [list(batches)] if x]:
        region, after, m = (batch.column(c).to_numpy() for c in ("region", "next", "m"))
        order = np.argsort(region)
        at = np.where(m >= threshold, np.arange(len(region)), order[np.minimum(np.searchsorted(region[order], after), max(len(region) - 1, 0))])
        for _ in range(max(1, len(region).bit_length())):
            at = at[at]
        done = np.flatnonzero(m[at] >= threshold)
        to = batch.column("to").combine_chunks().take(pa.array(at[done]))
        yield pa.RecordBatch.from_arrays([pa.array(region[done]), to if isinstance(to, pa.Array) else to.combine_chunks()], names=["region", "to"])


def block_mode(raster: DataFrame, k: int, background: int | None = None) -> DataFrame:
    """Majority class of k x k blocks, the smallest class on ties; with ``background`` a block is of another class only
    if more than half of its k * k pixels are."""
    counts = raster.where("cls IS NOT NULL").groupBy(F.floor(F.col("px") / k).cast("int").alias("px"), F.floor(F.col("py") / k).cast("int").alias("py"), "cls").agg(F.count("*").alias("n"))
    best = F.max(F.struct("n", (-F.col("cls")).alias("c"))).alias("b")
    out = counts.groupBy("px", "py").agg(best).select("px", "py", (-F.col("b.c")).alias("cls"), F.col("b.n").alias("n"))
    if background is not None:
        out = out.withColumn("cls", F.when((F.col("cls") != background) & (2 * F.col("n") <= k * k), background).otherwise(F.col("cls")))
    return out


def border_pixels(raster: DataFrame) -> DataFrame:
    """Pixels whose left or upper neighbour has another class."""
    left = F.when(F.lag("px").over(along_row()) == F.col("px") - 1, F.lag("cls").over(along_row()))
    up = F.when(F.lag("py").over(along_column()) == F.col("py") - 1, F.lag("cls").over(along_column()))
    marked = raster.withColumn("_left", left).withColumn("_up", up)
    return marked.where("_left <> cls OR _up <> cls").drop("_left", "_up")


def nodata_census(raster: DataFrame, width: int, height: int) -> DataFrame:
    """How many pixels of the frame have no data, and the rows and columns that have."""
    return raster.where("cls IS NOT NULL").agg(
        (F.lit(width * height).cast("long") - F.count("*")).alias("n_nodata"), F.min("px").alias("min_px"), F.max("px").alias("max_px"), F.min("py").alias("min_py"), F.max("py").alias("max_py")
    )


def rasterize(edges: DataFrame, key: Column | str = "poly_id") -> DataFrame:
    """Pixels (px, py, key) whose centre lies in a polygon, by even-odd parity along rows.

    Edges (x0, y0, x1, y1; y up) are cut into the rows they cross; the crossings of a row and polygon, in order, bound
    its spans of pixels.
    """
    rows = edges.select(
        F.col(key).alias("key") if isinstance(key, str) else key.alias("key"), "x0", "y0", "x1", "y1",
        F.explode(F.sequence(F.ceil(-F.greatest("y0", "y1") - 0.5), F.ceil(-F.least("y0", "y1") - 0.5) - 1, F.lit(1).cast("long"))).alias("py"),
    ).where("y0 <> y1 AND py >= ceil(-greatest(y0, y1) - 0.5) AND py <= ceil(-least(y0, y1) - 0.5) - 1")
    middle = -(F.col("py") + 0.5)
    cross = rows.select("key", "py", (F.col("x0") + (middle - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0"))).alias("x"))
    along = Window.partitionBy("key", "py").orderBy("x")
    spans = cross.withColumn("k", F.row_number().over(along)).withColumn("to", F.lead("x").over(along)).where("k % 2 = 1")
    first, last = F.ceil(F.col("x") - 0.5), F.ceil(F.col("to") - 0.5) - 1
    return spans.withColumn("first", first).withColumn("last", last).where("last >= first").select(
        F.explode(F.sequence("first", "last")).alias("px"), "py", "key"
    ).select(F.col("px").cast("int").alias("px"), F.col("py").cast("int").alias("py"), "key")


def border_distance(borders: DataFrame, others: DataFrame, reach: int) -> DataFrame:
    """Distance of each pixel of ``borders`` to the nearest of ``others``, null beyond ``reach`` pixels.

    Pixels meet in cells of ``reach`` pixels: each goes to its own, each of ``others`` to the nine around it.
    """
    cell = lambda c: F.floor(F.col(c) / reach)
    near = F.explode(F.array(*[F.struct((cell("px") + i).alias("cx"), (cell("py") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    b = others.select(F.col("px").alias("qx"), F.col("py").alias("qy"), near.alias("c")).select("qx", "qy", "c.cx", "c.cy")
    a = borders.select("px", "py", cell("px").alias("cx"), cell("py").alias("cy"))
    far = (F.col("px") - F.col("qx")) ** 2 + (F.col("py") - F.col("qy")) ** 2
    return a.join(b, ["cx", "cy"], "left").groupBy("px", "py").agg(F.sqrt(F.min(F.when(far <= reach * reach, far))).alias("distance"))


def nearest_distance(borders: DataFrame, others: DataFrame) -> DataFrame:
    """Exact distance of each pixel of ``borders`` to the nearest of ``others``, null if there are none.

    A pass along the columns of ``others``, for the rows of ``borders``, then one along the rows; a task holds a row.
    """
    asked = others.select(F.col("px").alias("x")).distinct().crossJoin(borders.select(F.col("py").alias("y")).distinct()).select(F.col("x").alias("px"), F.col("y").alias("py"), F.lit(None).cast("int").alias("at"))
    column = asked.unionByName(others.select("px", "py", F.col("py").cast("int").alias("at")))
    order = Window.partitionBy("px").orderBy("py")
    above = F.last("at", True).over(order.rangeBetween(Window.unboundedPreceding, 0))
    below = F.first("at", True).over(order.rangeBetween(0, Window.unboundedFollowing))
    gaps = column.select("px", "py", "at", F.least(F.col("py") - above, below - F.col("py")).cast("long").alias("gap")).where("at IS NULL").drop("at")

    def run(known, wanted):
        known, wanted = known.sort_values("px"), wanted.sort_values("px")
        found = row_minima(known["px"].to_numpy("int64"), known["gap"].to_numpy("int64") ** 2, wanted["px"].to_numpy("int64"))
        return wanted.assign(distance=np.sqrt(found) if len(known) else np.nan)[["px", "py", "distance"]].replace({np.nan: None})

    return gaps.groupBy("py").cogroup(borders.select("px", "py").groupBy("py")).applyInPandas(run, "px int, py int, distance double")


def row_minima(x: np.ndarray, g: np.ndarray, q: np.ndarray) -> np.ndarray:
    """For each q the least (x - q)**2 + g; x and q ascend.

    The x of the least moves right with q, so halving the queries halves the x to look at: a round of all open spans
    looks at each x once or twice.
    """
    best = np.zeros(len(q), np.int64)
    low, high = np.zeros(1, np.int64), np.full(1, len(q) - 1)
    a, b = np.zeros(1, np.int64), np.full(1, len(x) - 1)
    while len(x) and (low <= high).any():
        low, high, a, b = (v[low <= high] for v in (low, high, a, b))
        middle, size = (low + high) // 2, b - a + 1
        starts = np.cumsum(size) - size
        span = np.repeat(np.arange(len(middle)), size)
        at = np.arange(len(span)) + (a - starts)[span]
        far = (x[at] - q[middle][span]) ** 2 + g[at]
        best[middle] = np.minimum.reduceat(far, starts)
        hit = np.flatnonzero(far == best[middle][span])
        k = at[hit[np.searchsorted(span[hit], np.arange(len(middle)))]]
        low, high, a, b = np.concatenate([low, middle + 1]), np.concatenate([middle - 1, high]), np.concatenate([a, k]), np.concatenate([k, b])
    return best


def frame(n: int) -> tuple[int, int]:
    """Width and height of the smallest square-like frame of n pixels."""
    width = max(1, math.isqrt(n - 1) + 1) if n else 1
    return width, -(-n // width) if n else 0
