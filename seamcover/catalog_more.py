"""Further queries of the coverage operators, and their SQL: arcs point by point, smoothing, the entry points' coverages,
slanted edges, metrics of two rasters, sources.

The SQL finds arcs by pointer doubling over the regions' border edges, simplifies them by a recursion over spans, and
smooths them by joins. ``k7_gaussian`` has no SQL: a square ring has vertices that are equally far off but for rounding,
and which of them a simplification keeps depends on the order of a sum; ``k7_points`` has it without simplification.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamcover import catalog as base
from seamcover.functions import wkb
from seamcover.functions.graph import cut_lineage
from seamcover.functions.lines import Lines
from seamcover.functions.params import Smoothing
from seamcover.operators import metrics, raster, rebuild, topology
from seamcover.plans import coverage
from seamcover.sources import tables

PLAIN = Smoothing("chaikin", iterations=2, pre=0.0, post=0.0)


def _millionths(c, shift: float = 0.0):
    """A whole number of millionths; the shift keeps values that are halves of one from being rounded either way."""
    return F.floor(c * 1000000 + 0.5 + shift).cast("long")


def g4_arc_points(spark, sf_dir):
    """The regions' arcs, point by point."""
    each = base._region_arcs(spark, sf_dir).select(*base.arc_key(), "closed", F.posexplode("pts").alias("i", "q"))
    return each.select("lpoly", "rpoly", "sx", "sy", "closed", "i", F.col("q.x").cast("long").alias("x"), F.col("q.y").cast("long").alias("y"))


def j1_linked_pieces(spark, sf_dir):
    """The same from squares of 16 pixels, whose pieces are linked."""
    labelled, _ = base._regions(spark, sf_dir)
    arcs = topology.chain_arcs(coverage.raster_borders(labelled), 16)
    each = arcs.select(*base.arc_key(), "closed", F.posexplode("pts").alias("i", "q"))
    return each.select("lpoly", "rpoly", "sx", "sy", "closed", "i", F.col("q.x").cast("long").alias("x"), F.col("q.y").cast("long").alias("y"))


def b2_polygons(spark, sf_dir):
    """Polygons of the raster before smoothing: class, area in pixels, parts."""
    pixels, meta = base._raster(spark, sf_dir)
    rows = tables.polygon_vertices(coverage.polygonize(pixels, meta).withColumn("wkb", F.col("wkb")))
    edges = topology.edges(topology.quantise(rows, meta.pixel))
    classes = coverage.polygonize(pixels, meta).select(F.col("fid").alias("poly_id"), "class_value")
    return topology.ring_areas(edges).select("poly_id", F.col("area2").cast("long").alias("area2")).join(classes, "poly_id")


def b3_regions_eight(spark, sf_dir):
    pixels, meta = base._raster(spark, sf_dir)
    return raster.regions(pixels, meta.width, True).select("px", "py", "cls", "region")


def b4_nodata_regions(spark, sf_dir):
    """Regions where class 3 is nodata."""
    pixels, meta = base._raster(spark, sf_dir)
    return raster.regions(raster.mask_nodata(pixels, 3), meta.width).select("px", "py", "cls", "region")


def c4_wkb_round_trip(spark, sf_dir):
    """The rectangles as WKB and back: ring vertices."""
    import numpy as np
    import pyarrow as pa

    def pack(batches):
        for batch in batches:
            lines = Lines.from_arrow(batch.column("pts"))
            shapes = [wkb.from_polygons([[np.asarray(lines[k])]]) for k in range(len(lines))]
            yield pa.RecordBatch.from_arrays([batch.column("fid"), pa.array(shapes, pa.binary())], names=["fid", "wkb"])

    point = lambda s: F.struct(s.x.cast("double").alias("x"), s.y.cast("double").alias("y"))
    rings = base._rectangles(spark, sf_dir).groupBy(F.col("poly_id").alias("fid")).agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias("q"))
    features = rings.select("fid", F.transform("q", point).alias("pts")).mapInArrow(pack, "fid long, wkb binary")
    return tables.polygon_vertices(features).select("poly_id", "ring", "seq", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"))


def c30_json_ids(spark, sf_dir):
    """Regions of each class as a JSON list, and back."""
    labelled, _ = base._regions(spark, sf_dir)
    lists = labelled.groupBy("cls").agg(F.to_json(F.collect_set("region")).alias("ids"))
    return tables.ids_from_json(lists, "ids", "region").select("cls", "region")


def c33_fingerprint(spark, sf_dir):
    found = metrics.fingerprint(topology.edges(base._rectangles(spark, sf_dir)))
    return found.select("poly_id", _millionths(F.col("area")).alias("area"), _millionths(F.col("x")).alias("x"), _millionths(F.col("y")).alias("y"), "n_points")


def d2_in_box(spark, sf_dir):
    """Regions whose box meets the frame's middle."""
    labelled, meta = base._regions(spark, sf_dir)
    a, b = meta.width // 3, meta.height // 3
    boxes = topology.ring_areas(raster.region_edges(labelled))
    return topology.in_box(boxes, a, -2 * b, 2 * a, -b).select("poly_id", "min_x", "min_y", "max_x", "max_y")


def d14_interior_segments(spark, sf_dir):
    """Multiplicity of the rectangles' segments before junctions are put in, those at the frame left out."""
    _, meta = base._raster(spark, sf_dir)
    return topology.interior_segments(topology.edges(base._rectangles(spark, sf_dir)), (0, -meta.height, meta.width, 0), 1)


def d15_broken(spark, sf_dir):
    """Rectangles one pixel too wide, as a coverage: how much laps over, is left open, and whether it counts as broken."""
    pixels, meta = base._raster(spark, sf_dir)
    wide = F.when(F.col("seq").isin(1, 2), F.least(F.col("x") + 1, F.lit(meta.width))).otherwise(F.col("x"))
    found = _covered(topology.edges(base._rectangles(spark, sf_dir).withColumn("x", wide)), pixels)
    found = metrics.broken(found.select(F.lit(0).alias("n_invalid"), F.col("n_overlap").alias("overlap"), F.col("n_gap").alias("gap")), float(meta.width * meta.height))
    return found.select("overlap", "gap", "broken")


def _covered(e: DataFrame, pixels: DataFrame) -> DataFrame:
    return metrics.overlap_and_gap(raster.rasterize(e), pixels)


def f12_overlap_gap(spark, sf_dir):
    """The regions burnt from their borders: neither overlap nor gap."""
    labelled, _ = base._regions(spark, sf_dir)
    return _covered(raster.region_edges(labelled), labelled)


def e14_covered_segments(spark, sf_dir):
    """Rectangles' edges that no other one has whole, and how much of each others cover."""
    return topology.covered_segments(topology.edges(base._rectangles(spark, sf_dir)))


def e16_tune_baseline(spark, sf_dir):
    """Scores less those of the group's first user."""
    tune = base._tune(spark, sf_dir)
    first = metrics.best_parameter(tune.withColumn("k", -F.col("user_id")), ["event_type"], "k", "user_id")
    return metrics.against_baseline(tune, first, ["event_type"], "score").select("event_type", "user_id", "score", "gain")


def _triangles(spark, sf_dir):
    """A triangle for each customer, on a small grid, so that many vertices lie on and near others' slanted edges."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("long").alias("k"))
    at = lambda m, s: (F.col("k") * m + s) % 211
    corners = F.array(*[F.struct(F.lit(i).alias("seq"), at(17 + i, 5 * i).alias("x"), at(31 + 4 * i, 60 * i).alias("y")) for i in range(3)])
    return c.select(F.col("k").alias("poly_id"), F.lit(0).alias("ring"), F.explode(corners).alias("q")).select("poly_id", "ring", "q.seq", "q.x", "q.y")


def e2b_slanted_junctions(spark, sf_dir):
    return topology.junctions(_triangles(spark, sf_dir)).select("poly_id", "ring", "seq", "x", "y")


def e2c_near_junctions(spark, sf_dir):
    """Vertices within one step of an edge."""
    return topology.junctions(_triangles(spark, sf_dir), 1).select("poly_id", "ring", "seq", "x", "y")


def f2_input_report(spark, sf_dir):
    """Features, a seventh of them without geometry: how many there are, are skipped, and are invalid."""
    pixels, meta = base._raster(spark, sf_dir)
    features = coverage.polygonize(pixels, meta).withColumn("wkb", F.when(F.col("fid") % 7 != 0, F.col("wkb")))
    return tables.input_report(features)


def f11_accuracy(spark, sf_dir):
    """IoU of each class, in millionths, between the raster and the sieved one."""
    pixels, meta = base._raster(spark, sf_dir)
    return metrics.iou(pixels, raster.sieve(pixels, meta.width, 40)).select("cls", "n_both", _millionths(F.col("iou"), 0.123).alias("iou"))


def f11_overall(spark, sf_dir):
    pixels, meta = base._raster(spark, sf_dir)
    found = metrics.accuracy(pixels, raster.sieve(pixels, meta.width, 40))
    return found.select(_millionths(F.col("miou"), 0.123).alias("miou"), _millionths(F.col("oa"), 0.123).alias("oa"))


def f12_class_change(spark, sf_dir):
    """Areas of each class before and after sieving, their union and symmetric difference."""
    pixels, meta = base._raster(spark, sf_dir)
    found = metrics.class_changes(pixels, raster.sieve(pixels, meta.width, 40))
    return found.select("cls", "n_in", "n_out", "n_union", "n_xor", _millionths(F.col("change"), 0.123).alias("change"))


def f12_change_summary(spark, sf_dir):
    pixels, meta = base._raster(spark, sf_dir)
    found = metrics.change_summary(metrics.class_changes(pixels, raster.sieve(pixels, meta.width, 40)))
    return found.select(*[_millionths(F.col(c), 0.123).alias(c) for c in found.columns])


def f13_sharp_turns(spark, sf_dir):
    """Turns of the triangles."""
    return metrics.sharp_turns(topology.edges(_triangles(spark, sf_dir))).select("poly_id", "n_turns", "n_sharp", _millionths(F.col("length"), 0.123).alias("length"))


def f14_shape_slanted(spark, sf_dir):
    """All shape measures of the triangles, with the entropy of their directions."""
    found = metrics.shape(topology.edges(_triangles(spark, sf_dir)))
    return found.select("n_edges", "n_axis", "n_sharp", _millionths(F.col("entropy"), 0.123).alias("entropy"))


def f17_differences(spark, sf_dir):
    """Distances between the borders of the raster and the sieved one, one way."""
    pixels, meta = base._raster(spark, sf_dir)
    d = raster.nearest_distance(raster.border_pixels(pixels), raster.border_pixels(raster.sieve(pixels, meta.width, 40)))
    found = metrics.differences(d)
    return found.select("n", *[_millionths(F.col(c), 0.123).alias(c) for c in ("identical", "median", "p95", "greatest")])


def smooth_polygonization_areas(spark, sf_dir):
    """Polygons of the raster after two corner cuttings: class, status, and area in 512ths of square metres."""
    out = coverage.smooth_polygonization(*base._raster(spark, sf_dir), PLAIN).polygons
    return out.select("poly_id", "class_value", "status", _area512("wkb").alias("area512"))


def _area512(column: str):
    from seamcover.functions import geometry as G

    return F.pandas_udf(lambda c: c.map(lambda b: round(256 * sum(G.area2(r[:-1]) for part in wkb.polygons(bytes(b)) for r in part))), "long")(column)


def smooth_polygonization_arcs(spark, sf_dir):
    """Arcs of the raster after two corner cuttings: sides, whether smoothed, points."""
    out = coverage.smooth_polygonization(*base._raster(spark, sf_dir), PLAIN).arcs
    n = F.pandas_udf(lambda c: c.map(lambda b: len(wkb.line(bytes(b)))), "int")
    return out.select("lpoly_id", "rpoly_id", "smoothed", n("wkb").alias("n_points"))


def smooth_polygonization_coverage(spark, sf_dir):
    """The flagship's output as a coverage, one row: polygons, those valid, area in square metres, and segments inside the
    frame that don't belong to just two polygons (a gap, an overlap or a border that doesn't fit)."""
    return _coverage_of(*_smooth_default(spark, sf_dir))


def _smooth_default(spark, sf_dir):
    pixels, meta = base._raster(spark, sf_dir)
    out = cut_lineage(coverage.smooth_polygonization(pixels, meta).polygons)
    return out.withColumnRenamed("poly_id", "fid"), (0, -meta.height * 10, meta.width * 10, 0)


def _coverage_of(polygons: DataFrame, frame: tuple[int, int, int, int]) -> DataFrame:
    """Vertices are compared on a grid of a millimetre."""
    rows = topology.edges(topology.quantise(tables.polygon_vertices(polygons), 1e-3))
    area = topology.ring_areas(rows).agg((F.sum("area2") / 2000000).alias("a"))
    odd = topology.interior_segments(rows, tuple(1000 * v for v in frame), 1).where("n <> 2").agg(F.coalesce(F.sum("n_segments"), F.lit(0)).alias("n_odd"))
    return polygons.agg(F.count("*").alias("n_polygons"), F.count_if(F.col("status") == 1).alias("n_valid")).crossJoin(area.select(F.round("a").cast("long").alias("area"))).crossJoin(odd)  # single rows


def smooth_polygons_coverage(spark, sf_dir):
    """The regions' polygons smoothed as a vector coverage, outer borders kept: the same measures."""
    pixels, meta = base._raster(spark, sf_dir)
    features = cut_lineage(coverage.polygonize(pixels, meta))
    out = cut_lineage(coverage.smooth_polygons(features, keep_outer=True).polygons)
    return _coverage_of(out, (0, -meta.height * 10, meta.width * 10, 0))


def smooth_polygons_areas(spark, sf_dir):
    """The regions' polygons as a vector coverage after two corner cuttings, outer borders kept: attribute, status, area."""
    pixels, meta = base._raster(spark, sf_dir)
    features = cut_lineage(coverage.polygonize(pixels, meta))
    out = coverage.smooth_polygons(features, PLAIN, keep_outer=True).polygons
    return out.select("fid", "class_value", "status", F.round(_area512("wkb") / 512).cast("long").alias("area"))


def _long(c):
    return c.cast("long")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        g4_arc_points, j1_linked_pieces, b2_polygons, b3_regions_eight, b4_nodata_regions, c4_wkb_round_trip, c30_json_ids, c33_fingerprint, d2_in_box, d14_interior_segments, d15_broken, f12_overlap_gap,
        e14_covered_segments, e16_tune_baseline, e2b_slanted_junctions, e2c_near_junctions, f2_input_report, f11_accuracy, f11_overall, f12_class_change, f12_change_summary, f13_sharp_turns, f14_shape_slanted, f17_differences,
        smooth_polygonization_areas, smooth_polygonization_arcs, smooth_polygonization_coverage, smooth_polygons_coverage, smooth_polygons_areas,
    )
} | {
    "k3_points": base.smoothed_points(Smoothing("douglaspeucker"), _long), "k4_points": base.smoothed_points(PLAIN, lambda c: (c * 16).cast("long")),
    "k5_points": base.smoothed_points(Smoothing("bspline"), lambda c: (c * 256).cast("long")), "k6_points": base.smoothed_points(Smoothing("bezier"), lambda c: (c * 64).cast("long")),
    "k7_points": base.smoothed_points(Smoothing("gaussian", post=0.0), lambda c: _millionths(c, 0.123)),
}

# ---------------------------------------------------------------------------------------------------------------- SQL

#: Doublings that follow a border of up to 2**ROUNDS edges.
ROUNDS = 16
_CTE: dict[str, str] = {}


def _add(name: str, sql: str) -> None:
    _CTE[name] = sql


_add("bord", "SELECT row_number() OVER (ORDER BY x0, y0, poly_id, other, x1, y1) e, poly_id l, other r, x0, y0, x1, y1 FROM redge WHERE other = 0 OR other > poly_id")
_add("follow", "SELECT a.e, b.e n FROM bord a JOIN bord b ON a.l = b.l AND a.r = b.r AND b.x0 = a.x1 AND b.y0 = a.y1 QUALIFY row_number() OVER (PARTITION BY a.e ORDER BY (a.x1 - a.x0) * (b.y1 - b.y0) - (a.y1 - a.y0) * (b.x1 - b.x0) DESC) = 1")
_add("m0", "SELECT bord.e, f.e p, bord.e m FROM bord LEFT JOIN follow f ON f.n = bord.e")
for _k in range(ROUNDS):
    _add(f"m{_k + 1}", f"SELECT a.e, b.p, least(a.m, b.m) m FROM m{_k} a LEFT JOIN m{_k} b ON b.e = a.p")
_add("c0", f"SELECT m0.e, coalesce(CASE WHEN z.p IS NULL OR z.m <> m0.e THEN m0.p END, m0.e) h, CASE WHEN m0.p IS NULL OR (z.p IS NOT NULL AND z.m = m0.e) THEN 0 ELSE 1 END d, z.p IS NOT NULL closed FROM m0 JOIN m{ROUNDS} z ON z.e = m0.e")
for _k in range(ROUNDS):
    _add(f"c{_k + 1}", f"SELECT a.e, coalesce(b.h, a.h) h, a.d + coalesce(b.d, 0) d, a.closed FROM c{_k} a LEFT JOIN c{_k} b ON b.e = a.h AND a.h <> a.e")
_add("steps", f"SELECT c.h, c.d k, c.closed, l, r, x0 x, y0 y FROM c{ROUNDS} c JOIN bord USING (e) UNION ALL SELECT c.h, c.d + 1, c.closed, l, r, x1, y1 FROM c{ROUNDS} c JOIN bord USING (e) QUALIFY c.d = max(c.d) OVER (PARTITION BY c.h)")
_add("corner", "SELECT h, k, closed, l, r, x, y FROM steps WINDOW q AS (PARTITION BY h ORDER BY k) QUALIFY lag(x) OVER q IS NULL OR lead(x) OVER q IS NULL OR (x - lag(x) OVER q) * (lead(y) OVER q - y) <> (y - lag(y) OVER q) * (lead(x) OVER q - x)")
_add("arc", "SELECT h, CAST(row_number() OVER (PARTITION BY h ORDER BY k) - 1 AS INTEGER) i, closed, l, r, x, y FROM corner")
_add("known", "SELECT a.h, closed, l lpoly, r rpoly, x sx, y sy, n FROM arc a JOIN (SELECT h, count(*) n FROM arc GROUP BY h) USING (h) WHERE i = 0")
_add("p0", "SELECT h, i, 10.0 * x x, 10.0 * y y, closed FROM arc JOIN (SELECT h FROM known WHERE n >= CASE WHEN closed THEN 5 ELSE 3 END) USING (h)")
_ARC = "bord follow " + " ".join(f"m{k}" for k in range(ROUNDS + 1)) + " " + " ".join(f"c{k}" for k in range(ROUNDS + 1)) + " steps corner arc known p0"
_RECURSIVE = {"reach", "chase"}


def _simplify(new: str, old: str, tolerance: str) -> list[str]:
    """Douglas-Peucker of points (h, i, x, y, closed); tolerance: a table (h, t)."""
    t = "CASE WHEN cx * cx + cy * cy > 0 THEN least(greatest((dx * cx + dy * cy) / (cx * cx + cy * cy), 0), 1) ELSE 0 END"
    _RECURSIVE.add(f"{new}_s")
    _add(f"{new}_s", f"""SELECT h, 0 a, max(i) b FROM {old} GROUP BY h UNION ALL SELECT h, unnest([a, k]), unnest([k, b]) FROM (
        SELECT h, a, b, arg_max(i, (far, -i)) k, max(far) far FROM (SELECT h, a, b, i, (dx - t * cx) * (dx - t * cx) + (dy - t * cy) * (dy - t * cy) far FROM (SELECT *, {t} t FROM (
            SELECT s.h, s.a, s.b, p.i, p.x - u.x dx, p.y - u.y dy, v.x - u.x cx, v.y - u.y cy FROM {new}_s s JOIN {old} p ON p.h = s.h AND p.i > s.a AND p.i < s.b JOIN {old} u ON u.h = s.h AND u.i = s.a JOIN {old} v ON v.h = s.h AND v.i = s.b
        ))) GROUP BY h, a, b) JOIN {tolerance} USING (h) WHERE far > t * t""")
    _add(f"{new}_k", f"SELECT h, a i FROM {new}_s UNION SELECT h, b FROM {new}_s")
    _add(new, f"SELECT h, CAST(row_number() OVER (PARTITION BY h ORDER BY i) - 1 AS INTEGER) i, x, y, closed FROM {old} JOIN (SELECT h, count(*) n FROM {new}_k GROUP BY h) USING (h) LEFT JOIN (SELECT *, true kept FROM {new}_k) USING (h, i) WHERE kept OR (closed AND n < 4)")
    return [f"{new}_s", f"{new}_k", new]


def _cut(new: str, old: str) -> list[str]:
    """One corner cutting."""
    _add(new, f"""SELECT a.h, 2 * a.i + k + CASE WHEN a.closed THEN 0 ELSE 1 END i, CASE k WHEN 0 THEN 0.75 * a.x + 0.25 * b.x ELSE 0.25 * a.x + 0.75 * b.x END x, CASE k WHEN 0 THEN 0.75 * a.y + 0.25 * b.y ELSE 0.25 * a.y + 0.75 * b.y END y, a.closed
        FROM {old} a JOIN {old} b ON b.h = a.h AND b.i = a.i + 1, (VALUES (0), (1)) s(k)
        UNION ALL SELECT h, CASE WHEN i = 0 THEN 0 ELSE 2 * i + 1 END, x, y, closed FROM {old} JOIN (SELECT h, max(i) z FROM {old} GROUP BY h) USING (h) WHERE NOT closed AND (i = 0 OR i = z)
        UNION ALL SELECT a.h, 2 * z, 0.75 * a.x + 0.25 * b.x, 0.75 * a.y + 0.25 * b.y, a.closed FROM {old} a JOIN {old} b ON b.h = a.h AND b.i = 1 JOIN (SELECT h, max(i) z FROM {old} GROUP BY h) q ON q.h = a.h WHERE a.i = 0 AND a.closed""")
    return [new]


_add("len0", "SELECT h, least(5.0, 0.05 * sum(d)) t FROM (SELECT h, sqrt((lead(x) OVER q - x) ** 2 + (lead(y) OVER q - y) ** 2) d FROM p0 WINDOW q AS (PARTITION BY h ORDER BY i)) GROUP BY h")
_add("ten", "SELECT DISTINCT h, 10.0 t FROM p0")
_add("half", "SELECT DISTINCT h, 0.5 t FROM p0")
_DP = _simplify("dp", "p0", "len0")
_PRE = _simplify("pre", "p0", "ten")
_CUTS = [*_cut("k1", "pre"), *_cut("k2", "k1"), *_cut("k3", "k2"), *_cut("k4", "k3")]
_POST4, _POST3 = _simplify("post4", "k4", "half"), _simplify("post3", "k3", "half")
_PLAIN = [*_cut("q1", "p0"), *_cut("q2", "q1")]

# The Gaussian of sigma 12.5 without simplification behind it.
_add("along", "SELECT h, i, x, y, closed, coalesce(sum(d) OVER (PARTITION BY h ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) s, d FROM (SELECT *, sqrt((lead(x) OVER q - x) ** 2 + (lead(y) OVER q - y) ** 2) d FROM p0 WINDOW q AS (PARTITION BY h ORDER BY i))")
_add("size_", "SELECT h, closed, total, n, least(12.5 / (total / n), (n - 1) / 3.0) w FROM (SELECT h, closed, total, greatest(CAST(ceil(total / least(12.5 / 4, total / least_)) AS BIGINT), least_) n FROM (SELECT h, any_value(closed) closed, max(s) total, CASE WHEN any_value(closed) THEN 8 ELSE 3 END least_ FROM along GROUP BY h))")
_add("at_", "SELECT h, g j, g * (total / CASE WHEN closed THEN n ELSE n - 1 END) s FROM size_, range(0, n) r(g)")
_add("even", "SELECT a.h, a.j, v.x + coalesce((a.s - v.s) / nullif(v.d, 0) * (w.x - v.x), 0) x, v.y + coalesce((a.s - v.s) / nullif(v.d, 0) * (w.y - v.y), 0) y FROM at_ a ASOF JOIN along v ON a.h = v.h AND a.s >= v.s LEFT JOIN along w ON w.h = v.h AND w.i = v.i + 1")
_add("bell", "SELECT h, closed, n, total, o, exp(-0.5 * (o / w) ** 2) / sum(exp(-0.5 * (o / w) ** 2)) OVER (PARTITION BY h) v FROM size_, range(-greatest(1, CAST(ceil(3 * w) AS BIGINT)), greatest(1, CAST(ceil(3 * w) AS BIGINT)) + 1) r(o)")
_add("mean_", """SELECT b.h, a.j, b.closed, b.n, sum(v * CASE WHEN NOT b.closed AND (a.j + o < 0 OR a.j + o >= b.n) THEN 2 * e.x - c.x ELSE c.x END) x, sum(v * CASE WHEN NOT b.closed AND (a.j + o < 0 OR a.j + o >= b.n) THEN 2 * e.y - c.y ELSE c.y END) y
    FROM bell b JOIN even a ON a.h = b.h
    JOIN even c ON c.h = b.h AND c.j = CASE WHEN b.closed THEN ((a.j + o) % b.n + b.n) % b.n WHEN a.j + o < 0 THEN -(a.j + o) WHEN a.j + o >= b.n THEN 2 * (b.n - 1) - (a.j + o) ELSE a.j + o END
    JOIN even e ON e.h = b.h AND e.j = CASE WHEN a.j + o < 0 THEN 0 ELSE b.n - 1 END GROUP BY ALL""")
_add("turned", "SELECT h, closed, j, n, x, y, sum(x * y2 - x2 * y) OVER (PARTITION BY h) a1, avg(x) OVER (PARTITION BY h) mx, avg(y) OVER (PARTITION BY h) my FROM (SELECT *, coalesce(lead(x) OVER q, first_value(x) OVER q) x2, coalesce(lead(y) OVER q, first_value(y) OVER q) y2 FROM mean_ WINDOW q AS (PARTITION BY h ORDER BY j))")
_add("area0", "SELECT h, sum(x * y2 - x2 * y) a0 FROM (SELECT h, x, y, lead(x) OVER q x2, lead(y) OVER q y2 FROM p0 WINDOW q AS (PARTITION BY h ORDER BY i)) GROUP BY h")
_add("ends_", """SELECT t.h, j, n, t.closed, a0, a1, mx, my, CASE WHEN NOT t.closed AND j IN (0, n - 1) THEN p.x ELSE t.x END x, CASE WHEN NOT t.closed AND j IN (0, n - 1) THEN p.y ELSE t.y END y
    FROM turned t JOIN area0 USING (h) LEFT JOIN (SELECT h, i, x, y, max(i) OVER (PARTITION BY h) z FROM p0) p ON p.h = t.h AND p.i = CASE WHEN j = 0 THEN 0 ELSE z END WHERE p.i = 0 OR p.i = z
    QUALIFY row_number() OVER (PARTITION BY t.h, j ORDER BY 1) = 1""")
_add("gauss", "SELECT h, CAST(j AS INTEGER) i, n, CASE WHEN closed AND a0 * a1 > 0 THEN (x - mx) * sqrt(a0 / a1) + mx ELSE x END x, CASE WHEN closed AND a0 * a1 > 0 THEN (y - my) * sqrt(a0 / a1) + my ELSE y END y, closed FROM ends_")
_add("gauss_", "SELECT h, i, x, y, closed FROM gauss UNION ALL SELECT h, CAST(n AS INTEGER), x, y, closed FROM gauss WHERE closed AND i = 0")
_GAUSS = ["along", "size_", "at_", "even", "bell", "mean_", "turned", "area0", "ends_"]


def _sql(names: str, select: str, over: dict[str, str] | None = None) -> str:
    texts = base._CTE | _CTE | (over or {})
    return "WITH RECURSIVE " + ", ".join(f"{n} AS {'' if n in _RECURSIVE else 'MATERIALIZED '}({texts[n]})" for n in names.split()) + " " + select


_R, _S = base._NEEDS["redge"], base._NEEDS["sie"]
_A = f"{_R} {_ARC}"


def _points(more: list[str], table: str, factor: str) -> str:
    """Points of smoothed arcs; those too short to smooth as they are."""
    whole = lambda c: factor.format(c)
    return _sql(f"{_A} {' '.join(more)}", f"""SELECT lpoly, rpoly, sx, sy, CAST(1 AS INTEGER) state, CAST(i AS INTEGER) i, {whole('x')} x, {whole('y')} y FROM {table} JOIN known USING (h)
        UNION ALL SELECT lpoly, rpoly, sx, sy, 2, i, {whole('10.0 * x')}, {whole('10.0 * y')} FROM arc JOIN known USING (h) WHERE h NOT IN (SELECT h FROM p0)""")


def _counts(more: list[str], table: str) -> str:
    return _sql(f"{_A} {' '.join(more)}", f"SELECT lpoly, rpoly, sx, sy, known.closed, CAST(CASE WHEN m IS NULL THEN 2 ELSE 1 END AS INTEGER) state, CAST(n AS INTEGER) n_before, CAST(coalesce(m, n) AS INTEGER) n_after FROM known LEFT JOIN (SELECT h, count(*) m FROM {table} GROUP BY h) USING (h)")


_EIGHT = {"touch": "SELECT DISTINCT a.run u, b.run v FROM runs a JOIN runs b ON a.px BETWEEN b.px - 1 AND b.px + 1 AND a.py = b.py + 1 AND a.cls = b.cls"}
_NO3 = {"ras": f"SELECT * FROM ({base._CTE['ras']}) WHERE cls <> 3"}
_TRI = "tri AS MATERIALIZED (SELECT c_custkey poly_id, seq, (c_custkey * (17 + seq) + 5 * seq) % 211 x, (c_custkey * (31 + 4 * seq) + 60 * seq) % 211 y FROM customer, (VALUES (0), (1), (2)) s(seq)), te AS MATERIALIZED (SELECT a.poly_id, a.seq, a.x x0, a.y y0, b.x x1, b.y y1, b.x - a.x dx, b.y - a.y dy FROM tri a JOIN tri b ON b.poly_id = a.poly_id AND b.seq = (a.seq + 1) % 3)"
_NEAR = "SELECT poly_id, 0 ring, CAST(seq AS INTEGER) seq, x, y FROM te, (SELECT DISTINCT x, y FROM tri) v WHERE (x - x0) * dx + (y - y0) * dy > 0 AND (x - x0) * dx + (y - y0) * dy < dx * dx + dy * dy AND (dx * (y - y0) - dy * (x - x0)) ** 2 <= {} * (dx * dx + dy * dy)"
_TURNS = "SELECT t.*, lead(dx, 1, f) OVER q nx, lead(dy, 1, g) OVER q ny FROM (SELECT *, first_value(dx) OVER w f, first_value(dy) OVER w g FROM te WINDOW w AS (PARTITION BY poly_id ORDER BY seq)) t WINDOW q AS (PARTITION BY poly_id ORDER BY seq)"
_PER = "SELECT cls, count(*) FILTER (t = cls AND o = cls) b, count(*) FILTER (t = cls) n_in, count(*) FILTER (o = cls) n_out FROM (SELECT a.cls t, b.cls o, unnest(list_distinct([a.cls, b.cls])) cls FROM ras a JOIN sie b USING (px, py)) GROUP BY cls"


def _m(x: str, shift: float = 0.123) -> str:
    return f"CAST(floor(({x}) * 1000000 + 0.5 + {shift}) AS BIGINT)"


_BORDER = "SELECT a.px, a.py FROM {0} a LEFT JOIN {0} l ON l.px = a.px - 1 AND l.py = a.py LEFT JOIN {0} u ON u.px = a.px AND u.py = a.py - 1 WHERE l.cls <> a.cls OR u.cls <> a.cls"
_EXACT = "SELECT a.px, a.py, sqrt(min((a.px - b.px) ** 2 + (a.py - b.py) ** 2)) d FROM ({}) a, ({}) b GROUP BY ALL"
_ONE_WAY, _OTHER_WAY = _EXACT.format(_BORDER.format("ras"), _BORDER.format("sie")), _EXACT.format(_BORDER.format("sie"), _BORDER.format("ras"))
# Rings of a region: cycles of its border, split where one passes a vertex twice.
_RING = {
    "bord": "SELECT row_number() OVER (ORDER BY x0, y0, poly_id, x1, y1) e, poly_id l, 0 r, x0, y0, x1, y1 FROM redge",
    "rings": f"SELECT l poly_id, count(DISTINCT m{ROUNDS}.m) + (count(*) - count(DISTINCT (m{ROUNDS}.m, x0, y0))) n FROM bord JOIN m{ROUNDS} USING (e) GROUP BY l",
}
_RINGS = _sql(f"{_R} bord follow " + " ".join(f"m{k}" for k in range(ROUNDS + 1)) + " rings", "SELECT poly_id, CAST(1 AS INTEGER) status, CAST(1 AS INTEGER) n_parts, CAST(n AS INTEGER) n_rings FROM rings", _RING)
_FIXED = "SELECT h, l, r, bool_or(r = 0 AND ((x = px AND x IN (0, w)) OR (y = py AND y IN (0, -CAST(ceil(n * 1.0 / w) AS BIGINT))))) fixed, count(*) k, bool_or(closed) closed FROM (SELECT *, lag(x) OVER q px, lag(y) OVER q py FROM arc WINDOW q AS (PARTITION BY h ORDER BY i)), size GROUP BY ALL"
_AREA512 = "SELECT poly_id, CAST(round(256 * sum(s * a)) AS BIGINT) area512 FROM (SELECT h, sum(x * y2 - x2 * y) a FROM (SELECT h, x, y, lead(x) OVER q x2, lead(y) OVER q y2 FROM done WINDOW q AS (PARTITION BY h ORDER BY i)) GROUP BY h) JOIN (SELECT h, lpoly poly_id, 1 s FROM known UNION ALL SELECT h, rpoly, -1 FROM known WHERE rpoly <> 0) USING (h) GROUP BY poly_id"
_DONE = {
    "fixed": _FIXED,
    "done": "SELECT q2.h, q2.i, q2.x, q2.y FROM q2 JOIN fixed f USING (h) WHERE NOT f.fixed UNION ALL SELECT a.h, a.i, 10.0 * a.x, 10.0 * a.y FROM arc a JOIN fixed f USING (h) WHERE f.fixed OR a.h NOT IN (SELECT h FROM p0)",
}
_D = f"{_A} {' '.join(_PLAIN)} fixed done"
_CLS = "SELECT region + 1 poly_id, CAST(min(cls) AS BIGINT) class_value FROM reg GROUP BY region"
_WHOLE = "SELECT count(DISTINCT region) n_polygons, count(DISTINCT region) n_valid, 100 * count(*) area, CAST(0 AS BIGINT) n_odd FROM reg"

ORACLE_SQL: dict[str, str] = {
    "g4_arc_points": _sql(_A, "SELECT lpoly, rpoly, sx, sy, arc.closed, i, x, y FROM arc JOIN known USING (h)"),
    "j1_linked_pieces": _sql(_A, "SELECT lpoly, rpoly, sx, sy, arc.closed, i, x, y FROM arc JOIN known USING (h)"),
    "c16_canonical_closed": _sql(_A, "SELECT lpoly, rpoly, sx x, sy y, CAST(n AS INTEGER) n_points FROM known WHERE closed"),
    "d10_simple": _sql(_A, "SELECT lpoly, rpoly, sx, sy, count(DISTINCT (x, y)) = count(*) - CASE WHEN known.closed THEN 1 ELSE 0 END simple FROM steps JOIN known USING (h) GROUP BY lpoly, rpoly, sx, sy, known.closed, h"),
    "l2_valid": _RINGS, "j6_repair": _RINGS,
    "b2_polygons": _sql(_R, "SELECT region + 1 poly_id, 2 * count(*) area2, CAST(min(cls) AS BIGINT) class_value FROM reg GROUP BY region"),
    "b3_regions_eight": _sql(base._NEEDS["reg"], "SELECT px, py, cls, region FROM reg", _EIGHT),
    "b4_nodata_regions": _sql(base._NEEDS["reg"], "SELECT px, py, cls, region FROM reg", _NO3),
    "c4_wkb_round_trip": _sql(base._NEEDS["ver"], "SELECT poly_id, ring, seq, x, y FROM ver"),
    "c30_json_ids": _sql(base._NEEDS["reg"], "SELECT DISTINCT cls, region FROM reg"),
    "c33_fingerprint": _sql(base._NEEDS["ver"], "SELECT poly_id, CAST(1000000 * (b - a) AS BIGINT) area, CAST(500000 * (a + b) AS BIGINT) x, CAST(-1000000 * r - 500000 AS BIGINT) y, CAST(4 AS BIGINT) n_points FROM rect"),
    "d2_in_box": _sql(_R, "SELECT poly_id, min_x, min_y, max_x, max_y FROM (SELECT poly_id, min(x0) min_x, min(y0) min_y, max(x0) max_x, max(y0) max_y FROM redge GROUP BY poly_id), (SELECT w // 3 a, CAST(ceil(n * 1.0 / w) AS BIGINT) // 3 b FROM size) WHERE max_x >= a AND min_x <= 2 * a AND max_y >= -2 * b AND min_y <= -b"),
    "d14_interior_segments": _sql(f"{base._NEEDS['ver']} raw", "SELECT n, count(*) n_segments FROM (SELECT count(*) n FROM raw, (SELECT w, CAST(ceil(n * 1.0 / w) AS BIGINT) t FROM size) WHERE least(x0, x1) > 1 AND greatest(x0, x1) < w - 1 AND least(y0, y1) > 1 - t AND greatest(y0, y1) < -1 GROUP BY least(x0, x1), greatest(x0, x1), least(y0, y1), greatest(y0, y1)) GROUP BY n"),
    "d15_broken": _sql(base._NEEDS["ver"], "SELECT count(*) overlap, CAST(0 AS BIGINT) gap, count(*) > 1e-6 * any_value(w * CAST(ceil(n * 1.0 / w) AS BIGINT)) broken FROM rect, size WHERE b < w AND (b, r) IN (SELECT (px, py) FROM ras)"),
    "f12_overlap_gap": "SELECT CAST(0 AS BIGINT) n_overlap, CAST(0 AS BIGINT) n_gap",
    "e14_covered_segments": _sql(f"{base._NEEDS['ver']} raw", """SELECT u.poly_id, u.x0, u.y0, u.x1, u.y1, abs(u.x1 - u.x0) + abs(u.y1 - u.y0) length, CAST(coalesce(sum(greatest(0, CASE WHEN o.poly_id IS NULL THEN 0 WHEN u.y0 = u.y1 THEN least(greatest(u.x0, u.x1), greatest(o.x0, o.x1)) - greatest(least(u.x0, u.x1), least(o.x0, o.x1)) ELSE least(greatest(u.y0, u.y1), greatest(o.y0, o.y1)) - greatest(least(u.y0, u.y1), least(o.y0, o.y1)) END)), 0) AS BIGINT) covered
        FROM (SELECT * FROM raw QUALIFY count(*) OVER (PARTITION BY least(x0, x1), greatest(x0, x1), least(y0, y1), greatest(y0, y1)) = 1) u LEFT JOIN raw o ON o.poly_id <> u.poly_id AND ((u.y0 = u.y1 AND o.y0 = o.y1 AND o.y0 = u.y0) OR (u.x0 = u.x1 AND o.x0 = o.x1 AND o.x0 = u.x0)) GROUP BY ALL"""),
    "e16_tune_baseline": _sql("tune", "SELECT event_type, user_id, score, score - first_value(score) OVER (PARTITION BY event_type ORDER BY user_id) gain FROM tune"),
    "e2b_slanted_junctions": f"WITH {_TRI} {_NEAR.format(0)}",
    "e2c_near_junctions": f"WITH {_TRI} {_NEAR.format(1)}",
    "f2_input_report": _sql(base._NEEDS["reg"], "SELECT count(*) n_features, count(*) FILTER ((region + 1) % 7 = 0) n_skipped, CAST(0 AS BIGINT) n_invalid_input FROM (SELECT DISTINCT region FROM reg)"),
    "f11_accuracy": _sql(_S, f"SELECT cls, b n_both, {_m('b / (n_in + n_out - b)')} iou FROM ({_PER})"),
    "f11_overall": _sql(_S, f"SELECT {_m('avg(b / (n_in + n_out - b))')} miou, {_m('sum(b) / sum(n_in)')} oa FROM ({_PER})"),
    "f12_class_change": _sql(_S, f"SELECT cls, n_in, n_out, n_in + n_out - b n_union, n_in + n_out - 2 * b n_xor, {_m('n_out / nullif(n_in, 0) - 1')} change FROM ({_PER})"),
    "f12_change_summary": _sql(_S, f"SELECT {_m('sum(n_out) / sum(n_in) - 1')} total, {_m('avg(abs(n_out / nullif(n_in, 0) - 1))')} mean, {_m('max(abs(n_out / nullif(n_in, 0) - 1))')} greatest, {_m('sum(abs(n_out - n_in)) / sum(n_in)')} weighted FROM ({_PER})"),
    "f13_sharp_turns": f"WITH {_TRI} SELECT poly_id, count(*) n_turns, count(*) FILTER (dx * nx + dy * ny <= 0 OR abs(dx * ny - dy * nx) > dx * nx + dy * ny) n_sharp, {_m('sum(sqrt(dx * dx + dy * dy))')} length FROM ({_TURNS}) GROUP BY poly_id",
    "f14_shape_slanted": f"WITH {_TRI}, b AS (SELECT least(floor(((degrees(atan2(dy, dx)) % 180) + 180) % 180 / 5), 35) bin, sum(sqrt(dx * dx + dy * dy)) l FROM te GROUP BY 1) SELECT (SELECT count(*) FROM te) n_edges, (SELECT count(*) FROM te WHERE dx = 0 OR dy = 0) n_axis, (SELECT count(*) FROM ({_TURNS}) WHERE degrees(atan2(abs(dx * ny - dy * nx), dx * nx + dy * ny)) >= 59.999999) n_sharp, (SELECT {_m('-sum(l / s * ln(l / s)) / ln(36)')} FROM b, (SELECT sum(l) s FROM b) WHERE l > 0) entropy",
    "f15_boundary_both": _sql(_S, f"SELECT {_m('mean', 0)} mean, {_m('p95', 0)} p95, {_m('hausdorff', 0)} hausdorff, {_m('p', 0)} \"precision\", {_m('r', 0)} recall, {_m('2 * p * r / (p + r)', 0)} f1 FROM (SELECT avg(d) mean, quantile_cont(d, 0.95) p95, max(d) hausdorff, avg(CASE WHEN d <= 2 THEN 1.0 ELSE 0.0 END) FILTER (side = 0) p, avg(CASE WHEN d <= 2 THEN 1.0 ELSE 0.0 END) FILTER (side = 1) r FROM (SELECT d, 0 side FROM ({_OTHER_WAY}) UNION ALL SELECT d, 1 FROM ({_ONE_WAY})))"),
    "f17_differences": _sql(_S, f"SELECT count(*) n, {_m('avg(CASE WHEN d = 0 THEN 1.0 ELSE 0.0 END)')} identical, {_m('quantile_cont(d, 0.5)')} median, {_m('quantile_cont(d, 0.95)')} p95, {_m('max(d)')} greatest FROM ({_ONE_WAY})"),
    "k3_douglas_peucker": _counts(["len0", *_DP], "dp"), "k5_bspline": _counts(["ten", "half", *_PRE, *_CUTS, *_POST4], "post4"),
    "k6_bezier": _counts(["ten", "half", *_PRE, *_CUTS, *_POST3], "post3"),
    "k3_points": _points(["len0", *_DP], "dp", "CAST({} AS BIGINT)"),
    "k4_points": _points(_PLAIN, "q2", "CAST(({}) * 16 AS BIGINT)"),
    "k5_points": _points(["ten", "half", *_PRE, *_CUTS, *_POST4], "post4", "CAST(({}) * 256 AS BIGINT)"),
    "k6_points": _points(["ten", "half", *_PRE, *_CUTS, *_POST3], "post3", "CAST(({}) * 64 AS BIGINT)"),
    "k7_points": _points([*_GAUSS, "gauss", "gauss_"], "gauss_", _m("{}")),
    "smooth_polygonization_areas": _sql(_D, f"SELECT poly_id, class_value, CAST(1 AS INTEGER) status, area512 FROM ({_AREA512}) JOIN ({_CLS}) USING (poly_id)", _DONE),
    "smooth_polygonization_arcs": _sql(_D, "SELECT lpoly lpoly_id, rpoly rpoly_id, CAST(CASE WHEN any_value(f.fixed) OR h NOT IN (SELECT h FROM p0) THEN 0 ELSE 1 END AS INTEGER) smoothed, CAST(count(*) AS INTEGER) n_points FROM done JOIN known USING (h) JOIN fixed f USING (h) GROUP BY h, lpoly, rpoly", _DONE),
    "smooth_polygonization_coverage": _sql(base._NEEDS["reg"], _WHOLE), "smooth_polygons_coverage": _sql(base._NEEDS["reg"], _WHOLE),
    "smooth_polygons_areas": _sql(_D, f"SELECT poly_id fid, class_value, CAST(1 AS INTEGER) status, CAST(round(area512 / 512.0) AS BIGINT) area FROM ({_AREA512}) JOIN ({_CLS}) USING (poly_id)", _DONE),
    "f5_summary": _sql(_D, "SELECT count(*) n_arcs, count(*) FILTER (NOT s) n_smoothed, count(*) FILTER (s) n_original, CAST(0 AS BIGINT) n_reverted, CAST(0 AS BIGINT) n_half, CAST(0 AS BIGINT) n_corner, (SELECT count(DISTINCT region) FROM reg) n_polygons, (SELECT count(DISTINCT region) FROM reg) n_valid, CAST(0 AS BIGINT) n_invalid FROM (SELECT fixed OR h NOT IN (SELECT h FROM p0) s FROM fixed)", _DONE),
}
