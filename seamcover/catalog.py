"""Queries of the coverage operators by name, and SQL that gives the same rows.

All of them run over the driver's tables: the events are a classified raster, its horizontal runs a coverage of
rectangles with missing junctions, its regions a coverage without them. Each query makes what it needs from the tables.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamcover.functions import geometry, wkb
from seamcover.functions.graph import cut_lineage
from seamcover.functions.lines import Lines
from seamcover.functions.params import Smoothing
from seamcover.operators import metrics, raster, rebuild, smoothing, topology
from seamcover.plans import coverage
from seamcover.sources import tables


def _raster(spark, sf_dir):
    return tables.event_raster(spark, sf_dir)


def _regions(spark, sf_dir):
    pixels, meta = _raster(spark, sf_dir)
    return cut_lineage(raster.regions(pixels, meta.width)), meta


def _rectangles(spark, sf_dir):
    pixels, meta = _raster(spark, sf_dir)
    return tables.run_rectangles(pixels, meta.width)


def _edges(spark, sf_dir):
    v = _rectangles(spark, sf_dir)
    return topology.edges(topology.densify(v, topology.junctions(v)))


def _region_arcs(spark, sf_dir):
    labelled, _ = _regions(spark, sf_dir)
    return topology.with_ids(topology.chain_arcs(coverage.raster_borders(labelled)))


def a14_raster_from_events(spark, sf_dir):
    return tables.event_values(spark, sf_dir)[0]


def b6_box_blur(spark, sf_dir):
    return raster.box_blur(tables.event_values(spark, sf_dir)[0], tables.HALF)


def b7_quantile_classes(spark, sf_dir):
    return _raster(spark, sf_dir)[0]


def b3_regions(spark, sf_dir):
    return _regions(spark, sf_dir)[0].select("px", "py", "cls", "region")


def b5_block_mode(spark, sf_dir):
    return raster.block_mode(_raster(spark, sf_dir)[0], 4)


def b9_border_pixels(spark, sf_dir):
    return raster.border_pixels(_raster(spark, sf_dir)[0])


def b12_nodata_census(spark, sf_dir):
    pixels, meta = _raster(spark, sf_dir)
    return raster.nodata_census(pixels, meta.width, meta.height)


def b1_sieve(spark, sf_dir):
    pixels, meta = _raster(spark, sf_dir)
    return raster.sieve(pixels, meta.width, 40)


def b2_region_edges(spark, sf_dir):
    return raster.region_edges(_regions(spark, sf_dir)[0])


def b8_rasterize(spark, sf_dir):
    """Regions burnt from their own borders: the pixels they came from."""
    return raster.rasterize(raster.region_edges(_regions(spark, sf_dir)[0])).withColumnRenamed("key", "poly_id")


def b10_border_distance(spark, sf_dir):
    pixels, meta = _raster(spark, sf_dir)
    sieved = raster.sieve(pixels, meta.width, 40)
    d = raster.nearest_distance(raster.border_pixels(pixels), raster.border_pixels(sieved))
    return d.select("px", "py", F.round(F.col("distance") * F.col("distance")).cast("long").alias("square"))


def b11_window_crop(spark, sf_dir):
    """The pixels of a window of 32 x 32 from the origin."""
    return raster.crop(_raster(spark, sf_dir)[0], 32, 32)


def f15_boundary(spark, sf_dir):
    """Distances of the raster's borders to those of the sieved one, in millionths: mean, p95, greatest, share within 2."""
    pixels, meta = _raster(spark, sf_dir)
    sieved = raster.sieve(pixels, meta.width, 40)
    found = metrics.boundary(raster.nearest_distance(raster.border_pixels(pixels), raster.border_pixels(sieved)), 2.0)
    return found.select(*[F.round(F.col(c) * 1000000).cast("long").alias(c) for c in found.columns])


def f15_boundary_both(spark, sf_dir):
    """Exact distances between the raster's borders and the sieved one's, both directions, in millionths, and F1 within 2."""
    pixels, meta = _raster(spark, sf_dir)
    truth, out = raster.border_pixels(pixels), raster.border_pixels(raster.sieve(pixels, meta.width, 40))
    found = metrics.boundary_both(raster.nearest_distance(out, truth), raster.nearest_distance(truth, out), 2.0)
    return found.select(*[F.round(F.col(c) * 1000000).cast("long").alias(c) for c in found.columns])


def c5_quantise(spark, sf_dir):
    """The rectangles on a grid of two pixels; those that become too thin lose their rings."""
    return topology.quantise(_rectangles(spark, sf_dir), 2.0).select("poly_id", "ring", "seq", "x", "y")


def d7_extent(spark, sf_dir):
    """Outer edges, and whether they lie on the raster's frame and are kept as they are."""
    _, meta = _raster(spark, sf_dir)
    found = topology.fix_outer(topology.labelled(_edges(spark, sf_dir)), "extent", (0, -meta.height, meta.width, 0))
    return found.where("other = 0").select("poly_id", "x0", "y0", "x1", "y1", "fixed")


def g1_ring_edges(spark, sf_dir):
    return topology.midpoints(topology.edges(_rectangles(spark, sf_dir)))


def e2_junctions(spark, sf_dir):
    return topology.junctions(_rectangles(spark, sf_dir)).select("poly_id", "ring", "seq", "x", "y")


def g5_densify(spark, sf_dir):
    v = _rectangles(spark, sf_dir)
    return topology.densify(v, topology.junctions(v))


def e3_reverse_edge_join(spark, sf_dir):
    return topology.labelled(_edges(spark, sf_dir)).select("poly_id", "x0", "y0", "x1", "y1", "other")


def f3_edge_stats(spark, sf_dir):
    return topology.edge_stats(_edges(spark, sf_dir))


def g3_arcs(spark, sf_dir):
    found = topology.arcs(topology.fix_outer(topology.labelled(_edges(spark, sf_dir))))
    return found.groupBy("lpoly", "rpoly").agg(F.count("*").alias("n_arcs"), F.sum(F.size("pts") - 1).alias("n_edges"), F.count_if("closed").alias("n_closed"))


def c16_canonical_closed(spark, sf_dir):
    """Closed arcs of the regions: their first point, the smallest, and how many points they have."""
    first = F.element_at("pts", 1)
    return _region_arcs(spark, sf_dir).where("closed").select("lpoly", "rpoly", first.x.cast("long").alias("x"), first.y.cast("long").alias("y"), F.size("pts").alias("n_points"))


def f1_ring_area(spark, sf_dir):
    areas = topology.ring_areas(raster.region_edges(_regions(spark, sf_dir)[0]))
    return areas.withColumn("area2", F.col("area2").cast("long"))


def e13_adjacency(spark, sf_dir):
    return topology.adjacency(raster.region_edges(_regions(spark, sf_dir)[0]))


def f10_segment_multiplicity(spark, sf_dir):
    return topology.segment_multiplicity(_edges(spark, sf_dir))


def f14_shape(spark, sf_dir):
    return metrics.shape(_edges(spark, sf_dir)).select("n_edges", "n_axis", "n_sharp")


def f11_iou(spark, sf_dir):
    pixels, meta = _raster(spark, sf_dir)
    per = metrics.iou(pixels, raster.sieve(pixels, meta.width, 40))
    return per.select("cls", "n_both", "n_truth", "n_out")


def f16_best_param(spark, sf_dir):
    tune = _tune(spark, sf_dir)
    return metrics.best_parameter(tune, ["event_type"], "score", "user_id")


def _tune(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.groupBy("event_type", "user_id").agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("score"))


def g7_mean_rank(spark, sf_dir):
    return metrics.mean_rank(_tune(spark, sf_dir).select("user_id", "event_type", "score"), "user_id", "event_type", "score").select("user_id", F.round(F.col("mean_rank") * 1000000).cast("long").alias("rank_millionths"))


def e17_pareto(spark, sf_dir):
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    per = supplier.groupBy("s_nationkey").agg(F.count("*").alias("n"), F.sum(F.round(F.col("s_acctbal") * 100).cast("long")).alias("balance"))
    return metrics.pareto(per, "s_nationkey", ["n", "balance"])


def e12_attribute_join(spark, sf_dir):
    """Regions with the name of the nation their class stands for; classes without one keep a null."""
    classes = _regions(spark, sf_dir)[0].groupBy("region").agg(F.first("cls").alias("cls"), F.count("*").alias("n_pixels"))
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("int").alias("cls"), "n_name")
    return classes.join(nation, "cls", "left").select("region", "cls", "n_pixels", "n_name")


def c32_digest(spark, sf_dir):
    v = _rectangles(spark, sf_dir)
    return metrics.digest(v.select(F.concat_ws(",", "poly_id", "seq", "x", "y").alias("line")), "line")


def k4_chaikin(spark, sf_dir):
    """Two corner cuttings of the rectangles' open borders, in sixteenths: exact integers."""
    p = Smoothing("chaikin", iterations=2, pre=0.0, post=0.0)
    v = _rectangles(spark, sf_dir)
    lines = v.groupBy("poly_id").agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias("q"))
    lines = lines.select("poly_id", F.transform("q", lambda s: F.struct(s.x.cast("double").alias("x"), s.y.cast("double").alias("y"))).alias("pts"), F.lit(False).alias("fixed"))
    out = lines.mapInArrow(_cutter(p), "poly_id long, pts array<struct<x:double,y:double>>")
    each = out.select("poly_id", F.posexplode("pts").alias("i", "q"))
    return each.select("poly_id", "i", (F.col("q.x") * 16).cast("long").alias("x16"), (F.col("q.y") * 16).cast("long").alias("y16"))


def _cutter(p: Smoothing):
    def run(batches):
        for batch in batches:
            out = smoothing.smooth_lines(Lines.from_arrow(batch.column("pts")), p)
            yield pa.RecordBatch.from_arrays([batch.column("poly_id"), out.to_arrow()], names=["poly_id", "pts"])

    return run


def _smoothed(algorithm: str):
    """The regions' arcs, on pixels of 10 m: state and numbers of points before and after."""

    def query(spark, sf_dir):
        arcs = coverage.scaled(_region_arcs(spark, sf_dir).withColumn("key", F.struct(*arc_key())), 10.0, 0.0, 0.0)
        out = smoothing.smooth_arcs(arcs, Smoothing(algorithm))
        return out.select("key.*", "closed", "state", F.size("pts").alias("n_before"), F.size("smooth").alias("n_after"))

    return query


def smoothed_points(p: Smoothing, value):
    """Points of the regions' smoothed arcs, on pixels of 10 m; ``value`` makes a whole number of a coordinate."""

    def query(spark, sf_dir):
        arcs = coverage.scaled(_region_arcs(spark, sf_dir).withColumn("key", F.struct(*arc_key())), 10.0, 0.0, 0.0)
        out = smoothing.smooth_arcs(arcs, p).select("key.*", "state", F.posexplode("smooth").alias("i", "q"))
        return out.select("lpoly", "rpoly", "sx", "sy", "state", "i", value(F.col("q.x")).alias("x"), value(F.col("q.y")).alias("y"))

    return query


def j2_rebuild(spark, sf_dir):
    """Polygons rebuilt from unsmoothed arcs: areas and rings of the regions."""
    arcs = _region_arcs(spark, sf_dir)
    built = rebuild.rebuild(arcs.withColumn("smooth", F.col("pts")))
    area = F.pandas_udf(lambda c: c.map(lambda b: int(round(sum(geometry.area2(r[:-1]) for part in wkb.polygons(bytes(b)) for r in part)))), "long")
    return built.where("status = 1").select("poly_id", area("wkb").alias("area2"))


def j6_repair(spark, sf_dir):
    """Polygons after strong smoothing of small shapes, each brought to validity."""
    p = Smoothing("gaussian", sigma=40.0)
    arcs = coverage.scaled(_region_arcs(spark, sf_dir), 10.0, 0.0, 0.0)
    smooth = cut_lineage(smoothing.smooth_arcs(arcs, p))
    return rebuild.repair(smooth, rebuild.rebuild(smooth), p)[1].select("poly_id", "status", "n_parts", "n_rings")


def arc_key():
    """What an arc of the regions is known by in SQL: its sides and its first point."""
    first = F.element_at("pts", 1)
    return [F.col("lpoly"), F.col("rpoly"), first.x.cast("long").alias("sx"), first.y.cast("long").alias("sy")]


def d10_simple(spark, sf_dir):
    """Whether the regions' arcs meet themselves."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(geometry.simple(Lines.from_arrow(batch.columns[-1])))], names=[*batch.schema.names[:-1], "simple"])

    return _region_arcs(spark, sf_dir).select(*arc_key(), "pts").mapInArrow(run, "lpoly long, rpoly long, sx long, sy long, simple boolean")


def l2_valid(spark, sf_dir):
    arcs = _region_arcs(spark, sf_dir)
    return rebuild.rebuild(arcs.withColumn("smooth", F.col("pts"))).select("poly_id", "status", "n_parts", "n_rings")


def smooth_polygonization(spark, sf_dir):
    return coverage.smooth_polygonization(*_raster(spark, sf_dir)).polygons


def f5_summary(spark, sf_dir):
    return coverage.smooth_polygonization(*_raster(spark, sf_dir)).summary


def smooth_polygons(spark, sf_dir):
    """The regions' polygons, as WKB features with their class, smoothed as a vector coverage."""
    labelled, _ = _regions(spark, sf_dir)
    arcs = _region_arcs(spark, sf_dir)
    built = rebuild.rebuild(arcs.withColumn("smooth", F.col("pts")))
    classes = labelled.groupBy((F.col("region") + 1).alias("fid")).agg(F.first("cls").alias("cls"))
    features = cut_lineage(built.select(F.col("poly_id").alias("fid"), "wkb").join(classes, "fid"))
    return coverage.smooth_polygons(features, Smoothing(sigma=1.25, post=0.1), precision=1e-3).polygons.select("fid", "cls", "status", "wkb")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        a14_raster_from_events, b6_box_blur, b7_quantile_classes, b3_regions, b5_block_mode, b9_border_pixels, b12_nodata_census, b1_sieve, b2_region_edges, b8_rasterize, b10_border_distance, b11_window_crop, f15_boundary, f15_boundary_both, c5_quantise, d7_extent,
        g1_ring_edges, e2_junctions, g5_densify, e3_reverse_edge_join, f3_edge_stats, g3_arcs, c16_canonical_closed, f1_ring_area, e13_adjacency, f10_segment_multiplicity, f14_shape, f11_iou,
        f16_best_param, g7_mean_rank, e17_pareto, e12_attribute_join, c32_digest, k4_chaikin, j2_rebuild, j6_repair, d10_simple, l2_valid, f5_summary, smooth_polygons, smooth_polygonization,
    )
} | {"k7_gaussian": _smoothed("gaussian"), "k3_douglas_peucker": _smoothed("douglaspeucker"), "k5_bspline": _smoothed("bspline"), "k6_bezier": _smoothed("bezier")}

# Common table expressions of the oracle, each after those it reads.
_CTE = {
    "size": "SELECT CAST(ceil(sqrt(count(*))) AS BIGINT) w, count(*) n FROM events",
    "pix": "SELECT CAST(event_id % w AS INTEGER) px, CAST(event_id // w AS INTEGER) py, CAST(round(value * 100) AS BIGINT) v FROM events, size",
    **{f"blur{i}": f"SELECT px, py, CAST(sum(v) OVER (PARTITION BY {p} ORDER BY {o} RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS BIGINT) v FROM {'pix' if i == 1 else f'blur{i - 1}'}" for i, (p, o) in enumerate((("py", "px"), ("px", "py")) * 3, 1)},
    "ranked": "SELECT v, row_number() OVER (ORDER BY v) k FROM blur6",
    "thr": "SELECT v t FROM ranked, size, range(1, 6) r(i) WHERE k = (i * n + 5) // 6",
    "ras": "SELECT px, py, CAST(1 + (SELECT count(*) FROM thr WHERE t < v) AS INTEGER) cls FROM blur6",
    "marks": "SELECT *, CASE WHEN lag(px) OVER r IS NULL OR lag(px) OVER r <> px - 1 OR lag(cls) OVER r <> cls THEN py * w + px END b FROM ras, size WINDOW r AS (PARTITION BY py ORDER BY px)",
    "runs": "SELECT px, py, cls, max(b) OVER (PARTITION BY py ORDER BY px ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) run FROM marks",
    "touch": "SELECT DISTINCT a.run u, b.run v FROM runs a JOIN runs b ON a.px = b.px AND a.py = b.py + 1 AND a.cls = b.cls",
    "pairs": "SELECT u, v FROM touch UNION SELECT v, u FROM touch",
    "reach": "SELECT DISTINCT run a, run b FROM runs UNION SELECT r.a, t.v FROM reach r JOIN pairs t ON r.b = t.u",
    "roots": "SELECT a run, min(b) region FROM reach GROUP BY a",
    "reg": "SELECT px, py, cls, region FROM runs JOIN roots USING (run)",
    "sides": "SELECT * FROM (VALUES (0, 1, 0, -1, 1, -1), (1, 0, 1, -1, 1, 0), (0, -1, 1, 0, 0, 0), (-1, 0, 0, 0, 0, -1)) s(dx, dy, fx, fy, tx, ty)",
    "redge": "SELECT a.region + 1 poly_id, coalesce(b.region + 1, 0) other, CAST(a.px + fx AS BIGINT) x0, CAST(fy - a.py AS BIGINT) y0, CAST(a.px + tx AS BIGINT) x1, CAST(ty - a.py AS BIGINT) y1, a.cls FROM reg a CROSS JOIN sides LEFT JOIN reg b ON b.px = a.px + dx AND b.py = a.py + dy WHERE b.region IS NULL OR b.region <> a.region",
    "rect": "SELECT run + 1 poly_id, min(px) a, max(px) + 1 b, min(py) r FROM runs GROUP BY run",
    "ver": "SELECT poly_id, 0 ring, seq, CAST(CASE WHEN seq IN (0, 3) THEN a ELSE b END AS BIGINT) x, CAST(CASE WHEN seq < 2 THEN -r - 1 ELSE -r END AS BIGINT) y FROM rect, (VALUES (0), (1), (2), (3)) s(seq)",
    "raw": "SELECT a.poly_id, a.ring, a.seq, a.x x0, a.y y0, b.x x1, b.y y1 FROM ver a JOIN ver b ON a.poly_id = b.poly_id AND b.seq = (a.seq + 1) % 4",
    "pts": "SELECT DISTINCT x, y FROM ver",
    "ins": "SELECT poly_id, ring, seq, x, y, abs(x - x0) + abs(y - y0) t FROM raw JOIN pts ON y0 = y1 AND y = y0 AND x > least(x0, x1) AND x < greatest(x0, x1) UNION ALL SELECT poly_id, ring, seq, x, y, abs(x - x0) + abs(y - y0) t FROM raw JOIN pts ON x0 = x1 AND x = x0 AND y > least(y0, y1) AND y < greatest(y0, y1)",
    "den": "SELECT poly_id, ring, CAST(row_number() OVER (PARTITION BY poly_id ORDER BY seq, t) - 1 AS INTEGER) seq, x, y FROM (SELECT poly_id, ring, seq, 0 t, x, y FROM ver UNION ALL SELECT poly_id, ring, seq, t, x, y FROM ins)",
    "cnt": "SELECT poly_id, count(*) n FROM den GROUP BY poly_id",
    "edg": "SELECT a.poly_id, a.ring, a.seq, a.x x0, a.y y0, b.x x1, b.y y1, n FROM den a JOIN cnt USING (poly_id) JOIN den b ON a.poly_id = b.poly_id AND b.seq = (a.seq + 1) % n",
    "lab": "SELECT e.*, coalesce((SELECT min(o.poly_id) FROM edg o WHERE o.x0 = e.x1 AND o.y0 = e.y1 AND o.x1 = e.x0 AND o.y1 = e.y0), 0) other FROM edg e",
    "sz": "SELECT region, count(*) n, min(cls) cls FROM reg GROUP BY region",
    "nb": "SELECT DISTINCT a.region, b.region other FROM reg a CROSS JOIN sides JOIN reg b ON b.px = a.px + dx AND b.py = a.py + dy WHERE b.region <> a.region",
    "best": "SELECT nb.region, other FROM nb JOIN sz o ON o.region = other JOIN sz m ON m.region = nb.region WHERE m.n < 40 QUALIFY row_number() OVER (PARTITION BY nb.region ORDER BY o.n DESC, other) = 1",
    "chase": "SELECT region, other cur, 1 d FROM best UNION ALL SELECT c.region, b.other, d + 1 FROM chase c JOIN best b ON b.region = c.cur WHERE d < 60",
    "fin": "SELECT c.region, s.cls clsto FROM chase c JOIN sz s ON s.region = c.cur WHERE s.n >= 40",
    "sie": "SELECT px, py, coalesce(clsto, cls) cls FROM reg LEFT JOIN fin USING (region)",
    "tune": "SELECT event_type, user_id, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) score FROM events GROUP BY ALL",
}
_NEEDS = {"ras": "size pix blur1 blur2 blur3 blur4 blur5 blur6 ranked thr ras"}
_NEEDS["runs"] = _NEEDS["ras"] + " marks runs"
_NEEDS["reg"] = _NEEDS["runs"] + " touch pairs reach roots reg"
_NEEDS["redge"] = _NEEDS["reg"] + " sides redge"
_NEEDS["sie"] = _NEEDS["reg"] + " sides sz nb best chase fin sie"
_NEEDS["ver"] = _NEEDS["runs"] + " rect ver"
_NEEDS["den"] = _NEEDS["ver"] + " raw pts ins den"
_NEEDS["lab"] = _NEEDS["den"] + " cnt edg lab"


def _sql(needs: str, select: str) -> str:
    names = _NEEDS.get(needs, needs).split()
    return "WITH RECURSIVE " + ", ".join(f"{n} AS {'MATERIALIZED ' if n not in ('reach', 'chase') else ''}({_CTE[n]})" for n in names) + " " + select


# Squares of the border pixels' distances to the sieved raster's borders.
_DISTANCES = "SELECT a.px, a.py, CAST(min((a.px - b.px) ** 2 + (a.py - b.py) ** 2) AS BIGINT) square FROM (SELECT a.px, a.py FROM ras a LEFT JOIN ras l ON l.px = a.px - 1 AND l.py = a.py LEFT JOIN ras u ON u.px = a.px AND u.py = a.py - 1 WHERE l.cls <> a.cls OR u.cls <> a.cls) a, (SELECT a.px, a.py FROM sie a LEFT JOIN sie l ON l.px = a.px - 1 AND l.py = a.py LEFT JOIN sie u ON u.px = a.px AND u.py = a.py - 1 WHERE l.cls <> a.cls OR u.cls <> a.cls) b GROUP BY a.px, a.py"

ORACLE_SQL: dict[str, str] = {
    "a14_raster_from_events": _sql("size pix", "SELECT px, py, v FROM pix"),
    "b6_box_blur": _sql("ras", "SELECT px, py, v FROM blur6"),
    "b7_quantile_classes": _sql("ras", "SELECT px, py, cls FROM ras"),
    "b3_regions": _sql("reg", "SELECT px, py, cls, region FROM reg"),
    "b5_block_mode": _sql("ras", "SELECT px, py, cls, n FROM (SELECT CAST(px // 4 AS INTEGER) px, CAST(py // 4 AS INTEGER) py, cls, count(*) n FROM ras GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY px, py ORDER BY n DESC, cls) = 1"),
    "b9_border_pixels": _sql("ras", "SELECT a.px, a.py, a.cls FROM ras a LEFT JOIN ras l ON l.px = a.px - 1 AND l.py = a.py LEFT JOIN ras u ON u.px = a.px AND u.py = a.py - 1 WHERE l.cls <> a.cls OR u.cls <> a.cls"),
    "b12_nodata_census": _sql("ras", "SELECT CAST((SELECT w * CAST(ceil(n * 1.0 / w) AS BIGINT) FROM size) - count(*) AS BIGINT) n_nodata, min(px) min_px, max(px) max_px, min(py) min_py, max(py) max_py FROM ras"),
    "b1_sieve": _sql("sie", "SELECT px, py, cls FROM sie"),
    "f11_iou": _sql("sie", "SELECT cls, count(*) FILTER (t = cls AND o = cls) n_both, count(*) FILTER (t = cls) n_truth, count(*) FILTER (o = cls) n_out FROM (SELECT a.cls t, b.cls o, unnest(list_distinct([a.cls, b.cls])) cls FROM ras a JOIN sie b USING (px, py)) GROUP BY cls"),
    "b10_border_distance": _sql("sie", _DISTANCES),
    "b11_window_crop": _sql("ras", "SELECT px, py, cls FROM ras WHERE px < 32 AND py < 32"),
    "f15_boundary": _sql("sie", f'SELECT CAST(round(avg(d) * 1000000) AS BIGINT) mean, CAST(round(quantile_cont(d, 0.95) * 1000000) AS BIGINT) p95, CAST(round(max(d) * 1000000) AS BIGINT) hausdorff, CAST(round(avg(CASE WHEN d <= 2 THEN 1.0 ELSE 0.0 END) * 1000000) AS BIGINT) AS "within" FROM (SELECT sqrt(square) d FROM ({_DISTANCES}))'),
    "c5_quantise": _sql("ver", "SELECT poly_id, ring, seq, x, y FROM (SELECT *, count(*) OVER (PARTITION BY poly_id) n FROM (SELECT * FROM (SELECT a.poly_id, a.ring, a.seq, CAST(round_even(a.x / 2.0, 0) AS BIGINT) x, CAST(round_even(a.y / 2.0, 0) AS BIGINT) y, CAST(round_even(b.x / 2.0, 0) AS BIGINT) bx, CAST(round_even(b.y / 2.0, 0) AS BIGINT) by_ FROM ver a JOIN ver b ON a.poly_id = b.poly_id AND b.seq = (a.seq + 3) % 4) WHERE x <> bx OR y <> by_)) WHERE n >= 3"),
    "d7_extent": _sql("lab", "SELECT poly_id, x0, y0, x1, y1, (x0 = x1 AND x0 IN (0, w)) OR (y0 = y1 AND y0 IN (0, -CAST(ceil(n * 1.0 / w) AS BIGINT))) fixed FROM (SELECT * EXCLUDE (n) FROM lab), size WHERE other = 0"),
    "b2_region_edges": _sql("redge", "SELECT * FROM redge"),
    "b8_rasterize": _sql("reg", "SELECT px, CAST(py AS INTEGER) py, region + 1 poly_id FROM reg"),
    "g1_ring_edges": _sql(_NEEDS["ver"] + " raw", "SELECT *, CAST(floor((x0 + x1) / 2.0) AS BIGINT) mx, CAST(floor((y0 + y1) / 2.0) AS BIGINT) my FROM raw"),
    "e2_junctions": _sql("den", "SELECT poly_id, ring, seq, x, y FROM ins"),
    "g5_densify": _sql("den", "SELECT poly_id, ring, seq, x, y FROM den"),
    "e3_reverse_edge_join": _sql("lab", "SELECT poly_id, x0, y0, x1, y1, other FROM lab"),
    "f3_edge_stats": _sql("lab", "SELECT count(*) n_edges, count(*) - count(DISTINCT (x0, y0, x1, y1)) n_duplicates, count(*) FILTER (other > 0) n_shared, count(*) FILTER (other = 0) n_outer FROM lab"),
    "g3_arcs": _sql("lab", "SELECT poly_id lpoly, o rpoly, CAST(greatest(sum(cut), 1) AS BIGINT) n_arcs, count(*) n_edges, count(*) FILTER (cuts = 0 AND seq = 0) n_closed FROM (SELECT *, sum(c) OVER (PARTITION BY poly_id) cuts, c cut FROM (SELECT *, CASE WHEN other = 0 OR other > poly_id THEN other ELSE -1 END o, CASE WHEN coalesce(lag(CASE WHEN other = 0 OR other > poly_id THEN other ELSE -1 END) OVER q, last_value(CASE WHEN other = 0 OR other > poly_id THEN other ELSE -1 END) OVER (PARTITION BY poly_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) <> (CASE WHEN other = 0 OR other > poly_id THEN other ELSE -1 END) THEN 1 ELSE 0 END c FROM lab WINDOW q AS (PARTITION BY poly_id ORDER BY seq))) WHERE o >= 0 GROUP BY ALL"),
    "f1_ring_area": _sql("redge", "SELECT poly_id, CAST(sum(x0 * y1 - x1 * y0) AS BIGINT) area2, count(*) n_edges, min(x0) min_x, min(y0) min_y, max(x0) max_x, max(y0) max_y FROM redge GROUP BY poly_id"),
    "e13_adjacency": _sql("redge", "SELECT poly_id lpoly, other rpoly, count(*) n_edges, count(*) length FROM redge WHERE other > poly_id GROUP BY ALL"),
    "f10_segment_multiplicity": _sql("lab", "SELECT n, count(*) n_segments FROM (SELECT count(*) n FROM edg GROUP BY least(x0, x1), greatest(x0, x1), least(y0, y1), greatest(y0, y1)) GROUP BY n"),
    "f14_shape": _sql("den", "SELECT count(*) n_edges, count(*) n_axis, (SELECT count(*) FROM ver) n_sharp FROM den"),
    "f16_best_param": _sql("tune", "SELECT * FROM tune QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY score DESC, user_id) = 1"),
    "g7_mean_rank": _sql("tune", "SELECT user_id, CAST(round(avg(r) * 1000000) AS BIGINT) rank_millionths FROM (SELECT user_id, rank() OVER (PARTITION BY event_type ORDER BY score DESC) + (count(*) OVER (PARTITION BY event_type, score) - 1) / 2.0 r FROM tune) GROUP BY user_id"),
    "e17_pareto": "WITH p AS (SELECT s_nationkey, count(*) n, CAST(sum(CAST(round(s_acctbal * 100) AS BIGINT)) AS BIGINT) balance FROM supplier GROUP BY ALL) SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM p o WHERE o.n <= p.n AND o.balance <= p.balance AND (o.n < p.n OR o.balance < p.balance))",
    "e12_attribute_join": _sql("reg", "SELECT region, cls, n_pixels, n_name FROM (SELECT region, min(cls) cls, count(*) n_pixels FROM reg GROUP BY region) LEFT JOIN nation ON n_nationkey = cls"),
    "c32_digest": _sql("ver", "SELECT CAST(sum(n) AS BIGINT) n, sha256(string_agg(d, ',' ORDER BY p, d)) digest FROM (SELECT h[1:2] p, count(*) n, sha256(string_agg(h || ':1', ',' ORDER BY h || ':1')) d FROM (SELECT sha256(poly_id || ',' || seq || ',' || x || ',' || y) h FROM ver) GROUP BY p)"),
    "j2_rebuild": _sql("reg", "SELECT region + 1 poly_id, 2 * count(*) area2 FROM reg GROUP BY region"),
    "k4_chaikin": _sql("ver", "SELECT poly_id, CAST(i AS INTEGER) i, x16, y16 FROM (WITH a AS (SELECT poly_id, seq i, x, y FROM ver), b AS (SELECT p.poly_id, 2 * p.i + 1 + k i, (CASE k WHEN 0 THEN 3 ELSE 1 END) * p.x + (CASE k WHEN 0 THEN 1 ELSE 3 END) * q.x x, (CASE k WHEN 0 THEN 3 ELSE 1 END) * p.y + (CASE k WHEN 0 THEN 1 ELSE 3 END) * q.y y FROM a p JOIN a q ON q.poly_id = p.poly_id AND q.i = p.i + 1, (VALUES (0), (1)) s(k) UNION ALL SELECT poly_id, CASE i WHEN 0 THEN 0 ELSE 7 END, 4 * x, 4 * y FROM a WHERE i IN (0, 3)) SELECT p.poly_id, 2 * p.i + 1 + k i, (CASE k WHEN 0 THEN 3 ELSE 1 END) * p.x + (CASE k WHEN 0 THEN 1 ELSE 3 END) * q.x x16, (CASE k WHEN 0 THEN 3 ELSE 1 END) * p.y + (CASE k WHEN 0 THEN 1 ELSE 3 END) * q.y y16 FROM b p JOIN b q ON q.poly_id = p.poly_id AND q.i = p.i + 1, (VALUES (0), (1)) s(k) UNION ALL SELECT poly_id, CASE i WHEN 0 THEN 0 ELSE 15 END, 4 * x, 4 * y FROM b WHERE i IN (0, 7))"),
}
