"""Shared borders of a polygon coverage as relational plans.

Rings are rows (poly_id, ring, seq, x, y): open, integer coordinates, the polygon on the left. A directed edge p to q of
polygon A is shared with B if B owns q to p, so neighbours are found by an equi-join of the edges with themselves,
reversed. Equal consecutive labels of a ring, taken circularly, are an arc.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seamcover.functions.graph import connected_components, cut_lineage
from seamcover.functions.lines import Lines

POINTS = "array<struct<x:double,y:double>>"
#: Cells of the junction join: the smallest, and how many times larger those of the next level are.
CELL, SPREAD = 64, 16
#: Steps whose products fit 64 bits.
SHORT = 1 << 30
#: Steps of a square whose border edges one task chains.
TILE = 512


def by_ring():
    return Window.partitionBy("poly_id", "ring")


def quantise(df: DataFrame, grid: float, x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """Coordinates as whole grid steps, halves to even; the closing vertex and repeated neighbours go, and with them
    rings of fewer than three vertices."""
    q = lambda c, o: F.rint((F.col(c) - o) / grid).cast("long")
    at = df.withColumn("x", q("x", x0)).withColumn("y", q("y", y0))
    order = by_ring().orderBy("seq")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.lag(F.struct("x", "y")).over(order), F.last(F.struct("x", "y")).over(whole))
    kept = at.withColumn("_before", before).where((F.col("_before.x") != F.col("x")) | (F.col("_before.y") != F.col("y"))).drop("_before")
    return kept.withColumn("_n", F.count("*").over(by_ring())).where("_n >= 3").drop("_n")


def edges(vertices: DataFrame) -> DataFrame:
    """Directed edges (poly_id, ring, seq, x0, y0, x1, y1) of the rings."""
    order = by_ring().orderBy("seq")
    first = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follow = lambda c: F.coalesce(F.lead(c).over(order), F.first(c).over(first))
    return vertices.select("poly_id", "ring", "seq", F.col("x").alias("x0"), F.col("y").alias("y0"), follow("x").alias("x1"), follow("y").alias("y1"))


def midpoints(e: DataFrame) -> DataFrame:
    """Edges with ``mx``, ``my``: the middle, rounded down."""
    return e.withColumn("mx", F.shiftright(F.col("x0") + F.col("x1"), 1)).withColumn("my", F.shiftright(F.col("y0") + F.col("y1"), 1))


def junctions(vertices: DataFrame, tolerance: int = 0) -> DataFrame:
    """Vertices of others that lie inside an edge: (poly_id, ring, seq, t, x, y), t from 0 to 1 along the edge.

    Edges meet vertices in square cells, on a level of cells that fits the edge's size: level k has cells of
    CELL * SPREAD**k steps, and an edge is on the first level where it spans SPREAD cells at most. So an edge, however
    long, is posted to the few cells that it passes, and a vertex once to each level in use. With tolerance 0 a vertex
    must lie on the edge exactly; axis-parallel edges then meet the vertices of their own line only.
    """
    e, v = _levelled(edges(vertices)), vertices.select("x", "y").distinct()
    levels = sorted(r[0] for r in e.select("level").distinct().collect())
    cell = _cell(F.col("level"))
    px, py = F.col("x") - F.col("x0"), F.col("y") - F.col("y0")
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    far = [c.cast("double") for c in (dx, dy, px, py)]
    square, dot = far[0] * far[0] + far[1] * far[1], far[0] * far[2] + far[1] * far[3]
    inside = (dot > 0) & (dot < square)
    if tolerance:
        cross = far[0] * far[3] - far[1] * far[2]
        inside &= cross * cross <= F.lit(float(tolerance) ** 2) * square
    else:  # products of whole steps fit 64 bits up to SHORT, beyond they are taken as decimals
        wide = [c.cast("decimal(19,0)") for c in (dx, dy, px, py)]
        short = F.greatest(F.abs(dx), F.abs(dy)) < SHORT
        inside &= F.when(short, dx * py == dy * px).otherwise(wide[0] * wide[3] == wide[1] * wide[2])
    at = v.withColumn("level", F.explode(F.array(*[F.lit(k) for k in levels]) if levels else F.array().cast("array<int>")))
    at = at.withColumn("cx", F.floor(F.col("x") / cell)).withColumn("cy", F.floor(F.col("y") / cell))
    found = []
    slanted = e
    if not tolerance:
        slanted = e.where("x0 <> x1 AND y0 <> y1")
        for fixed, run, c in (("x", "y", "cy"), ("y", "x", "cx")):
            spanned = F.explode(F.sequence(F.floor(F.least(f"{run}0", f"{run}1") / cell), F.floor(F.greatest(f"{run}0", f"{run}1") / cell)))
            level = e.where(F.col(f"{fixed}0") == F.col(f"{fixed}1")).withColumn("line", F.col(f"{fixed}0")).withColumn(c, spanned)
            between = (F.col(run) > F.least(f"{run}0", f"{run}1")) & (F.col(run) < F.greatest(f"{run}0", f"{run}1"))
            found.append(level.join(at.withColumn("line", F.col(fixed)).select("x", "y", "level", "line", c), ["level", "line", c]).where(between))
    found.append(_strips(slanted, tolerance).join(at, ["level", "cx", "cy"]).where(inside))
    parts = [f.select("poly_id", "ring", "seq", (dot / square).alias("t"), "x", "y") for f in found]
    return reduce(DataFrame.union, parts).distinct()


def _cell(level) -> Column:
    return F.lit(CELL) * F.pow(F.lit(float(SPREAD)), level).cast("long")


def _levelled(e: DataFrame) -> DataFrame:
    side = F.greatest(F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0")))
    level = F.greatest(F.ceil(F.log(side / F.lit(CELL * SPREAD)) / math.log(SPREAD)), F.lit(0)).cast("int")
    return e.withColumn("level", F.when(side > CELL * SPREAD, level).otherwise(0))


def _strips(e: DataFrame, tolerance: int) -> DataFrame:
    """Edges in the cells (cx, cy) that they pass, the tolerance around them included: column by column of cells."""
    cell, reach = _cell(F.col("level")), tolerance + 1
    low, high = F.least("x0", "x1"), F.greatest("x0", "x1")
    columns = e.withColumn("cx", F.explode(F.sequence(F.floor((low - reach) / cell), F.floor((high + reach) / cell))))
    slope = F.when(F.col("x0") != F.col("x1"), (F.col("y1") - F.col("y0")) / (F.col("x1") - F.col("x0")))
    at = lambda x: F.col("y0") + (x - F.col("x0")) * slope
    a, b = at(F.greatest(low, F.col("cx") * cell - reach)), at(F.least(high, (F.col("cx") + 1) * cell + reach))
    bottom = F.coalesce(F.least(a, b), F.least("y0", "y1").cast("double")) - reach
    top = F.coalesce(F.greatest(a, b), F.greatest("y0", "y1").cast("double")) + reach
    return columns.withColumn("cy", F.explode(F.sequence(F.floor(bottom / cell), F.floor(top / cell))))


def densify(vertices: DataFrame, inserted: DataFrame) -> DataFrame:
    """Rings with the junctions put in, numbered anew; repeated neighbours go."""
    both = vertices.select("poly_id", "ring", "seq", F.lit(0.0).alias("t"), "x", "y").union(inserted.select("poly_id", "ring", "seq", "t", "x", "y"))
    order = by_ring().orderBy("seq", "t", "x", "y")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.lag(F.struct("x", "y")).over(order), F.last(F.struct("x", "y")).over(whole))
    kept = both.withColumn("_b", before).where((F.col("_b.x") != F.col("x")) | (F.col("_b.y") != F.col("y")))
    return kept.select("poly_id", "ring", (F.row_number().over(order) - 1).alias("seq"), "x", "y")


def labelled(e: DataFrame) -> DataFrame:
    """Edges with ``other``: the lowest owner of the reversed edge, 0 if there is none."""
    back = e.groupBy(F.col("x1").alias("x0"), F.col("y1").alias("y0"), F.col("x0").alias("x1"), F.col("y0").alias("y1")).agg(F.min("poly_id").alias("other"))
    return e.join(back, ["x0", "y0", "x1", "y1"], "left").select("poly_id", "ring", "seq", "x0", "y0", "x1", "y1", F.coalesce("other", F.lit(0)).cast("long").alias("other"))


def edge_stats(e: DataFrame) -> DataFrame:
    """One row: n_edges, n_duplicates (directed edges beyond the first owner), n_shared, n_outer."""
    lab = labelled(e)
    each = lab.groupBy("x0", "y0", "x1", "y1").agg(F.count("*").alias("n"), F.sum((F.col("other") > 0).cast("long")).alias("s"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return each.agg(total("n").alias("n_edges"), total(F.col("n") - 1).alias("n_duplicates"), total("s").alias("n_shared"), total(F.col("n") - F.col("s")).alias("n_outer"))


def fix_outer(lab: DataFrame, mode: str = "none", extent: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Edges with ``fixed``. outer: all without a neighbour; extent: those of them that lie on the frame, along it."""
    free = F.col("other") == 0
    if mode == "outer":
        fixed = free
    elif mode == "extent":
        x0, y0, x1, y1 = extent
        on = lambda c, a, b: (F.col(f"{c}0") == F.col(f"{c}1")) & F.col(f"{c}0").isin(a, b)
        fixed = free & (on("x", x0, x1) | on("y", y0, y1))
    else:
        fixed = F.lit(False)
    return lab.withColumn("fixed", fixed)


def arcs(lab: DataFrame) -> DataFrame:
    """Arcs (lpoly, rpoly, fixed, closed, pts) of labelled ring edges, each border once.

    The polygon of the smaller id, or the only one, has the arc on its left; edges whose reverse is the polygon's own
    are dropped. A run of equal labels may go over a ring's start; a ring of one label is a closed arc, which begins at
    its smallest vertex.
    """
    order = by_ring().orderBy("seq")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    label = F.struct(F.when((F.col("other") == 0) | (F.col("other") > F.col("poly_id")), F.col("other")).otherwise(-1).alias("o"), "fixed")
    e = lab.withColumn("label", label)
    before = F.coalesce(F.lag("label").over(order), F.last("label").over(whole))
    e = e.withColumn("cut", (before != F.col("label")).cast("int")).withColumn("n", F.count("*").over(by_ring())).withColumn("at", F.row_number().over(order) - 1)
    e = e.withColumn("run", F.sum("cut").over(order)).withColumn("cuts", F.sum("cut").over(by_ring()))
    e = e.where("label.o >= 0").withColumn("wraps", (F.col("run") == 0) & (F.col("cuts") > 0)).withColumn("run", F.when(F.col("wraps"), F.col("cuts")).otherwise(F.col("run")))
    e = e.withColumn("at", F.when(F.col("wraps"), F.col("at") + F.col("n")).otherwise(F.col("at")))
    runs = e.groupBy("poly_id", "ring", "run", "cuts", "label").agg(F.array_sort(F.collect_list(F.struct("at", "x0", "y0", "x1", "y1"))).alias("e"))
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    starts = F.transform("e", lambda s: point(s.x0, s.y0))
    least = F.array_position(starts, F.array_min(starts)).cast("int")
    turned = F.concat(F.slice(starts, least, F.size(starts)), F.slice(starts, F.lit(1), least - 1))
    closed = F.col("cuts") == 0
    end = F.element_at("e", -1)
    pts = F.when(closed, F.concat(turned, F.array(F.element_at(turned, 1)))).otherwise(F.concat(starts, F.array(point(end.x1, end.y1))))
    return runs.select(F.col("poly_id").alias("lpoly"), F.col("label.o").alias("rpoly"), F.col("label.fixed").alias("fixed"), closed.alias("closed"), pts.alias("pts"))


def chain_arcs(border: DataFrame, tile: int = TILE) -> DataFrame:
    """Arcs of labelled edges without rings (lpoly, rpoly, fixed, x0, y0, x1, y1), all of them single steps.

    The edges of one border are chained end to start. Where two of them leave a vertex, the one farthest to the left is
    taken, so that pixels which only touch in a corner stay apart. Vertices in a straight line go, arc ends stay.

    A task chains the edges of a square of ``tile`` steps into pieces, whatever their border, and ends them at the
    square's sides; pieces that meet there are linked by a join, numbered by connected components and put together. So
    no border is held by one task, only a single arc.
    """
    kind = f"lpoly long, rpoly long, fixed boolean, closed boolean, pts {POINTS}"
    # squares have sides at x = -1 and y = 1, so that a raster's left and upper edges lie within one
    cell = lambda c, origin: F.floor((F.least(f"{c}0", f"{c}1") - origin) / F.lit(tile))
    own = border.select("lpoly", "rpoly", "fixed", "x0", "y0", "x1", "y1", cell("x", -1).alias("tx"), cell("y", 1).alias("ty"))

    def chained(t: pa.Table) -> pa.Table:
        left, right, fixed = (t.column(c).to_numpy().astype(np.int64) for c in ("lpoly", "rpoly", "fixed"))
        e = np.column_stack([t.column(c).to_numpy() for c in ("x0", "y0", "x1", "y1")])
        label = 2 * _numbered(left, right) + fixed
        lines, first, closed = _chains(e, label, ((e[:, 2] + 1) % tile == 0) | ((e[:, 3] - 1) % tile == 0))
        columns = [pa.array(left[first]), pa.array(right[first]), pa.array(fixed[first] > 0), pa.array(closed), straight(lines, closed).to_arrow()]
        square = [pa.array(np.full(len(first), t.column(c)[0].as_py())) for c in ("tx", "ty")]
        return pa.Table.from_arrays([*columns, *square], names=["lpoly", "rpoly", "fixed", "closed", "pts", "tx", "ty"])

    pieces = cut_lineage(own.groupBy("tx", "ty").applyInArrow(chained, f"{kind}, tx long, ty long"))
    squares = pieces.select("tx", "ty").distinct().limit(2).count()
    pieces = pieces.drop("tx", "ty")
    if squares < 2:
        return pieces
    pieces = pieces.withColumn("piece", F.monotonically_increasing_id())
    first, last = F.element_at("pts", 1), F.element_at("pts", -1)
    at_side = lambda p: (F.pmod(p.x + 1, F.lit(float(tile))) == 0) | (F.pmod(p.y - 1, F.lit(float(tile))) == 0)
    step = lambda p, q: F.struct(F.signum(q.x - p.x).alias("x"), F.signum(q.y - p.y).alias("y"))
    label = ["lpoly", "rpoly", "fixed"]
    ends = pieces.where(~F.col("closed") & at_side(last)).select("piece", *label, last.alias("p"), step(F.element_at("pts", -2), last).alias("d"))
    starts = pieces.where(~F.col("closed") & at_side(first)).select(F.col("piece").alias("after"), *label, first.alias("p"), step(first, F.element_at("pts", 2)).alias("o"))
    turn = F.col("d.x") * F.col("o.y") - F.col("d.y") * F.col("o.x")
    links = cut_lineage(ends.join(starts, [*label, "p"]).groupBy("piece").agg(F.max_by("after", turn).alias("after")))
    if links.isEmpty():
        return pieces.drop("piece")
    members = pieces.join(links, "piece", "left").join(connected_components(links, "piece", "after").withColumnRenamed("node", "piece"), "piece", "left")
    alone, many = members.where("component IS NULL").select(*label, "closed", "pts"), members.where("component IS NOT NULL")

    def joined(t: pa.Table) -> pa.Table:
        lines, number = Lines.from_arrow(t.column("pts")), {p: k for k, p in enumerate(t.column("piece").to_pylist())}
        after = [number.get(x) for x in t.column("after").to_pylist()]
        heads = set(range(len(after))) - set(after)
        k, order = min(heads) if heads else 0, []
        while k is not None and len(order) < len(after):
            order.append(k)
            k = after[k]
        whole = Lines.of([np.concatenate([lines[order[0]][:1], *[lines[k][1:] for k in order]])])
        closed = np.array([not heads])
        names = [t.column(c).slice(0, 1).combine_chunks() for c in label]
        return pa.Table.from_arrays([*names, pa.array(closed), straight(whole, closed).to_arrow()], names=[*label, "closed", "pts"])

    return alone.unionByName(many.groupBy("component").applyInArrow(joined, kind))


def _numbered(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers from 0 for the distinct pairs."""
    a, b = (np.unique(v, return_inverse=True)[1].reshape(-1) for v in (a, b))
    return np.unique(a * (b.max(initial=0) + 1) + b, return_inverse=True)[1].reshape(-1)


def _chains(e: np.ndarray, label: np.ndarray, stop: np.ndarray) -> tuple[Lines, np.ndarray, np.ndarray]:
    """Chains of directed edges (n, 4) of equal label, none beyond an edge that is a stop: the lines, an edge of each,
    and which are closed. A closed one begins at its smallest vertex."""
    n = len(e)
    vertex = _numbered(e[:, [0, 2]].T.reshape(-1), e[:, [1, 3]].T.reshape(-1))
    leaves, enters = label * (2 * n) + vertex[:n], label * (2 * n) + vertex[n:]
    order = np.argsort(leaves, kind="stable")
    a, b = (np.searchsorted(leaves[order], enters, side=s) for s in ("left", "right"))
    d = e[:, 2:] - e[:, :2]
    after, best = np.full(n, -1), np.full(n, -np.inf)
    for k in range(int((b - a).max(initial=0))):
        i = np.flatnonzero((a + k < b) & ~stop)
        j = order[a[i] + k]
        turn = d[i, 0] * d[j, 1] - d[i, 1] * d[j, 0]
        left = turn > best[i]
        after[i[left]], best[i[left]] = j[left], turn[left]
    # edges by rank of their start; a ring is cut before its smallest
    rank = np.empty(n, np.int64)
    rank[np.lexsort((e[:, 1], e[:, 0]))] = np.arange(n)
    follows = np.ones(n, bool)
    follows[after[after >= 0]] = False
    jump = np.full(n, -1)
    jump[after[after >= 0]] = np.flatnonzero(after >= 0)  # the edge before
    low, back = rank.copy(), np.where(jump >= 0, jump, np.arange(n))
    for _ in range(max(1, n.bit_length())):
        low, back = np.minimum(low, low[back]), back[back]
    ring = ~follows[back]
    first = ring & (low == rank)
    jump[first] = -1
    back, place = np.where(jump >= 0, jump, np.arange(n)), (jump >= 0).astype(np.int64)
    for _ in range(max(1, n.bit_length())):
        place, back = place + place[back], back[back]
    along = np.lexsort((place, back))
    begins = np.flatnonzero(place[along] == 0)
    closed = ring[along[begins]]
    cuts = np.concatenate([begins, [n]])
    sizes = np.diff(cuts) + 1  # and the last edge's end
    out = np.concatenate([[0], np.cumsum(sizes)])
    xy = np.empty((out[-1], 2))
    xy[np.arange(n) + np.repeat(np.arange(len(begins)), np.diff(cuts))] = e[along, :2]
    xy[out[1:] - 1] = e[along[cuts[1:] - 1], 2:]
    return Lines(xy, out), along[begins], closed


def straight(lines: Lines, closed: np.ndarray) -> Lines:
    """Without the vertices that lie in a straight line; a closed line begins at its smallest vertex, a corner."""
    parts = []
    for k in np.flatnonzero(closed):
        ring = lines[k][:-1]
        at = int(np.lexsort((ring[:, 1], ring[:, 0]))[0])
        if at:
            parts.append((lines.cuts[k], np.concatenate([ring[at:], ring[: at + 1]])))
    xy = lines.xy.copy()
    for begin, p in parts:
        xy[begin : begin + len(p)] = p
    keep = np.ones(len(xy), bool)
    d = np.diff(xy, axis=0)
    keep[1:-1] = d[:-1, 0] * d[1:, 1] != d[:-1, 1] * d[1:, 0]
    keep[lines.cuts[:-1]], keep[lines.cuts[1:] - 1] = True, True
    return Lines(xy, lines.cuts).points_where(keep)


def with_ids(a: DataFrame) -> DataFrame:
    """Arcs with ``arc_id``, a 64-bit hash of their sides and first edge. Arcs are joined by it in the repair only, where
    two arcs of one hash would both become gentler, on both of their sides alike."""
    return a.withColumn("arc_id", F.xxhash64("lpoly", "rpoly", F.element_at("pts", 1).x, F.element_at("pts", 1).y, F.element_at("pts", 2).x, F.element_at("pts", 2).y))


def ring_areas(e: DataFrame) -> DataFrame:
    """(poly_id, area2, n_edges, box): twice the exact signed area of all rings of a polygon, a decimal of 38 digits."""
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    cross = (wide("x0") * wide("y1") - wide("x1") * wide("y0")).cast("decimal(38,0)")
    return e.groupBy("poly_id").agg(
        F.sum(cross).alias("area2"), F.count("*").alias("n_edges"),
        F.min("x0").alias("min_x"), F.min("y0").alias("min_y"), F.max("x0").alias("max_x"), F.max("y0").alias("max_y"),
    )


def adjacency(lab: DataFrame) -> DataFrame:
    """(lpoly, rpoly, n_edges, length) of neighbours, lpoly < rpoly; length along axis-parallel edges, in grid steps."""
    return lab.where("other > poly_id").groupBy(F.col("poly_id").alias("lpoly"), F.col("other").alias("rpoly")).agg(
        F.count("*").alias("n_edges"), F.sum(F.abs(F.col("x1") - F.col("x0")) + F.abs(F.col("y1") - F.col("y0"))).alias("length")
    )


def segment_multiplicity(e: DataFrame) -> DataFrame:
    """How many undirected segments occur once (unmatched), twice, and more often (over-shared)."""
    a, b = F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"))
    n = e.groupBy(F.least(a, b).alias("p"), F.greatest(a, b).alias("q")).agg(F.count("*").alias("n"))
    return n.groupBy("n").agg(F.count("*").alias("n_segments"))


def interior_segments(e: DataFrame, extent: tuple[int, int, int, int], inset: int = 0) -> DataFrame:
    """(n, n_segments) of the undirected segments with both ends inside the frame, ``inset`` steps or more from it."""
    x0, y0, x1, y1 = extent
    inside = lambda c, a, b: (F.col(c) > a + inset) & (F.col(c) < b - inset)
    return segment_multiplicity(e.where(inside("x0", x0, x1) & inside("x1", x0, x1) & inside("y0", y0, y1) & inside("y1", y0, y1)))


def covered_segments(e: DataFrame, cell: int = CELL * SPREAD) -> DataFrame:
    """Edges that occur once only (poly_id, x0, y0, x1, y1), with ``length`` and ``covered``: how much of it other
    polygons' edges on the same line cover. A border that is only cut in other places is covered whole.

    length and covered are along x, or along y for vertical edges. Lines are told by slope and intercept, quotients of
    whole numbers; edges meet in cells of their line.
    """
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    level = F.when(dx != 0, dy / dx)
    height = F.when(dx != 0, (dx * F.col("y0") - dy * F.col("x0")) / dx).otherwise(F.col("x0").cast("double"))
    a = F.when(dx != 0, F.least("x0", "x1")).otherwise(F.least("y0", "y1"))
    b = F.when(dx != 0, F.greatest("x0", "x1")).otherwise(F.greatest("y0", "y1"))
    ends = [F.struct(F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y")) for k in (0, 1)]
    every = e.select("poly_id", "x0", "y0", "x1", "y1", F.coalesce(level, F.lit(float("inf"))).alias("slope"), height.alias("height"), a.alias("a"), b.alias("b"), F.least(*ends).alias("p"), F.greatest(*ends).alias("q"))
    cells = F.explode(F.sequence(F.floor(F.col("a") / cell), F.floor((F.col("b") - 1) / cell)))
    once = every.groupBy("p", "q").agg(F.count("*").alias("n")).where("n = 1").drop("n")
    single = every.join(once, ["p", "q"], "left_semi").withColumn("cell", cells)
    other = every.select(F.col("poly_id").alias("o"), "slope", "height", F.col("a").alias("oa"), F.col("b").alias("ob")).withColumnRenamed("oa", "a").withColumnRenamed("ob", "b")
    other = other.withColumn("cell", cells).withColumnRenamed("a", "oa").withColumnRenamed("b", "ob")
    low, high = F.greatest("a", "oa", F.col("cell") * cell), F.least("b", "ob", (F.col("cell") + 1) * cell)
    met = single.join(other, ["slope", "height", "cell"], "left").withColumn("c", F.when((F.col("o") != F.col("poly_id")) & (high > low), high - low).otherwise(0))
    return met.groupBy("poly_id", "x0", "y0", "x1", "y1").agg((F.max("b") - F.min("a")).alias("length"), F.sum("c").cast("long").alias("covered"))


def in_box(boxes: DataFrame, x0: int, y0: int, x1: int, y1: int) -> DataFrame:
    """Polygons whose box (min_x, min_y, max_x, max_y) meets another one."""
    return boxes.where((F.col("max_x") >= x0) & (F.col("min_x") <= x1) & (F.col("max_y") >= y0) & (F.col("min_y") <= y1))
