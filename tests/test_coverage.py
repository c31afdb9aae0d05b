"""The coverage engine: fixtures of shared borders, smoothing, rebuild, rasters, metrics, plans."""

import math
import random
from collections import Counter

import coverages as fixtures
import numpy as np
import pytest
from pyspark.sql import functions as F

from seamcover.functions import geometry as G
from seamcover.functions import params as P
from seamcover.functions import wkb
from seamcover.functions.graph import connected_components
from seamcover.operators import metrics, raster, rebuild, smoothing, topology
from seamcover.plans import coverage
from seamcover.plans.store import StageStore, signature
from seamcover.sources import tables

ARCS = {"strip": 6, "grid9": 20, "island": 8, "pinch": 8, "long_shared": 3, "touching_hole": 9}


def vertices(spark, case):
    return spark.createDataFrame(fixtures.vertices(fixtures.coverages()[case]), "poly_id long, ring int, seq int, x long, y long")


def arcs_of(spark, case, keep="none"):
    v = vertices(spark, case)
    dense = topology.densify(v, topology.junctions(v))
    return topology.with_ids(topology.arcs(topology.fix_outer(topology.labelled(topology.edges(dense)), keep)))


def area(data):
    return sum(G.area2(r[:-1]) for part in wkb.polygons(bytes(data)) for r in part) / 2


@pytest.mark.parametrize("case", ARCS)
def test_arcs_and_rebuild(spark, case):
    arcs = arcs_of(spark, case)
    rows = arcs.collect()
    assert len(rows) == ARCS[case]
    assert all(r.rpoly == 0 or r.lpoly < r.rpoly for r in rows) and len({r.arc_id for r in rows}) == len(rows)
    built = rebuild.rebuild(arcs.withColumn("smooth", F.col("pts"))).collect()
    polygons = fixtures.coverages()[case]
    assert {r.poly_id: area(r.wkb) for r in built if r.status == 1} == {p: sum(G.area2(np.array(r)) for r in rings) / 2 for p, rings in polygons.items()}
    assert {r.poly_id: r.n_rings for r in built} == {p: len(rings) for p, rings in polygons.items()}


def test_sides_of_arcs(spark):
    assert sorted((r.lpoly, r.rpoly) for r in arcs_of(spark, "strip").collect()) == [(1, 0), (1, 2), (1, 3), (2, 0), (2, 3), (3, 0)]
    hole = [r for r in arcs_of(spark, "island").collect() if r.closed and r.lpoly == 4]
    assert len(hole) == 1 and hole[0].rpoly == 0 and G.area2(smoothing.xy(hole[0].pts)[:-1]) < 0 and hole[0].pts[0] == min(hole[0].pts)


def test_junctions_with_tolerance(spark):
    v = spark.createDataFrame([(1, 0, k, x, y) for k, (x, y) in enumerate([(0, 0), (100, 1), (100, 50), (0, 50)])] + [(2, 0, k, x, y) for k, (x, y) in enumerate([(50, -40), (51, -40), (50, 1)])], "poly_id long, ring int, seq int, x long, y long")
    assert topology.junctions(v, 0).count() == 0
    assert [(r.poly_id, r.seq, r.x, r.y) for r in topology.junctions(v, 1).where("poly_id = 1").collect()] == [(1, 0, 50, 1)]


def test_edge_stats_and_self_reverse(spark):
    s = topology.edge_stats(topology.edges(vertices(spark, "grid9"))).first()
    assert (s.n_edges, s.n_duplicates, s.n_shared, s.n_outer) == (36, 0, 24, 12)
    spike = spark.createDataFrame([(1, 0, k, x, y) for k, (x, y) in enumerate([(0, 0), (4, 0), (4, 4), (4, 9), (4, 4), (0, 4)])], "poly_id long, ring int, seq int, x long, y long")
    arcs = topology.arcs(topology.fix_outer(topology.labelled(topology.edges(spike)))).collect()
    assert sum(len(r.pts) - 1 for r in arcs) == 4


def test_shared_border_is_smoothed_once(spark):
    p = P.Smoothing("gaussian", sigma=4.0, post=0.0)
    smooth = smoothing.smooth_arcs(arcs_of(spark, "long_shared", "outer"), p)
    built = {r.poly_id: r for r in rebuild.rebuild(smooth).collect()}
    assert all(r.status == 1 for r in built.values())
    points = [{tuple(q) for q in np.concatenate(wkb.polygons(bytes(built[k].wkb))[0]).tolist()} for k in (1, 2)]
    assert len(points[0] & points[1]) > 40 and sum(area(r.wkb) for r in built.values()) == pytest.approx(5000)


OPEN = np.array([(0, 0), (1, 2), (3, 3), (5, 1), (8, 0)], float)
RING = np.array([(0, 0), (40, 0), (40, 40), (0, 40), (0, 0)], float)


@pytest.mark.parametrize("name", P.ALGORITHMS)
def test_ends_and_closure(name):
    p = P.Smoothing(name, sigma=2.0, pre=0.5, post=0.1, dp=0.5)
    out = smoothing.smooth(OPEN, p)
    assert (out[0] == OPEN[0]).all() and (out[-1] == OPEN[-1]).all()
    ring = smoothing.smooth(RING, p)
    assert (ring[0] == ring[-1]).all() and G.area2(ring[:-1]) > 0
    assert (smoothing.smooth(OPEN[:2], p) == OPEN[:2]).all()


def test_gaussian_keeps_ring_area():
    assert G.area2(smoothing.smooth(RING, P.Smoothing("gaussian", sigma=5.0))[:-1]) == pytest.approx(3200)


def test_chaikin_points():
    out = smoothing.smooth(OPEN[:3], P.Smoothing("chaikin", iterations=1, pre=0, post=0))
    assert out.tolist() == [[0, 0], [0.25, 0.5], [0.75, 1.5], [1.5, 2.25], [2.5, 2.75], [3, 3]]


def test_douglas_peucker_is_strict_and_takes_the_first_farthest():
    line = np.array([(0, 0), (1, 1), (2, 0), (3, 1), (4, 0)], float)
    assert smoothing.simplify(line, 1.0).tolist() == [[0, 0], [4, 0]]
    assert smoothing.simplify(line, 0.9).tolist()[1] == [1, 1]


def test_ladder_ends_at_the_original():
    rng = np.random.default_rng(3)
    arc = np.cumsum(rng.integers(-3, 4, (60, 2)), 0).astype(float)
    for name in P.ALGORITHMS:
        out, state = smoothing.smooth_arc(arc, P.Smoothing(name, sigma=4.0), level=9)
        assert state == smoothing.REVERTED and (out == arc).all()
    assert smoothing.smooth_arc(OPEN, P.Smoothing(), fixed=True)[1] == smoothing.ORIGINAL


def test_simple_and_valid():
    assert not G.is_simple(np.array([(0, 0), (2, 2), (2, 0), (0, 2)], float)) and G.is_simple(RING)
    assert not G.is_simple(np.array([(0, 0), (4, 0), (2, 0)], float))
    assert not G.is_simple(np.array([(0, 0), (4, 0), (4, 2), (2, 0), (0, 2)], float))
    shell, hole = RING[:-1], np.array([(20, 0), (10, 10), (30, 10)], float)
    assert G.is_valid([[shell, hole]])
    assert not G.is_valid([[shell, np.array([(20, 0), (10, 40), (30, 10)], float)]])
    assert not G.is_valid([[shell, hole + (0, -5)]]) and not G.is_valid([[shell, hole + (100, 0)]])
    assert not G.is_valid([[shell], [shell / 2]]) and G.is_valid([[shell], [shell + 40]])
    assert not G.is_valid([[np.array([(0, 0), (4, 4), (4, 0), (0, 4)], float)]])


def test_crossings_against_all_pairs():
    rng = np.random.default_rng(5)
    s = rng.integers(0, 30, (120, 4)).astype(float)
    turn = lambda a, b, c: np.sign((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]))
    on = lambda a, b, p: turn(a, b, p) == 0 and (np.minimum(a, b) <= p).all() and (p <= np.maximum(a, b)).all()
    want = set()
    for i in range(len(s)):
        for j in range(i + 1, len(s)):
            a, b, c, d = s[i, :2], s[i, 2:], s[j, :2], s[j, 2:]
            if turn(a, b, c) * turn(a, b, d) < 0 and turn(c, d, a) * turn(c, d, b) < 0 or on(a, b, c) or on(a, b, d) or on(c, d, a) or on(c, d, b):
                want.add((i, j))
    assert {tuple(x) for x in G.meetings(s).tolist()} == want


def test_repair_brings_polygons_to_validity(spark):
    arcs = arcs_of(spark, "island")
    twisted = F.when(F.col("closed") & (F.col("rpoly") == 2), F.transform("pts", lambda q: F.struct((q.x + 5).alias("x"), q.y.alias("y")))).otherwise(F.col("pts"))
    bad = arcs.withColumn("smooth", twisted).withColumn("state", F.lit(smoothing.SMOOTHED))
    first = rebuild.rebuild(bad)
    assert {r.poly_id for r in first.where("status < 1").collect()} >= {1}
    fixed, results = rebuild.repair(bad, first, P.Smoothing("gaussian", sigma=1.0))
    assert results.where("status <> 1").count() == 0 and results.count() == 4


def test_polygons_that_stay_bad_keep_their_original_rings(spark):
    twisted = F.when(F.col("closed") & (F.col("rpoly") == 2), F.transform("pts", lambda q: F.struct((q.x + 5).alias("x"), q.y.alias("y")))).otherwise(F.col("pts"))
    bad = arcs_of(spark, "island").withColumn("pts", twisted).withColumn("smooth", F.col("pts")).withColumn("state", F.lit(smoothing.ORIGINAL))
    _, results = rebuild.repair(bad, rebuild.rebuild(bad), P.Smoothing("gaussian", sigma=1.0))
    found = {r.poly_id: r for r in results.collect()}
    assert found[1].status == rebuild.AS_GIVEN and len(found) == 4 and all(r.wkb for r in found.values())


def test_wkb_round_trip():
    parts = [[np.array(fixtures.square(0, 0, 10, 10), float), np.array(fixtures.hole(fixtures.square(2, 2, 4, 4)), float)], [np.array(fixtures.square(20, 20, 30, 30), float)]]
    back = wkb.polygons(wkb.from_polygons(parts))
    assert [[r[:-1].tolist() for r in p] for p in back] == [[r.tolist() for r in p] for p in parts]
    import struct

    z = struct.pack(">BIIII", 0, 0x80000000 | 0x20000000 | 3, 4326, 1, 4) + struct.pack(">12d", 0, 0, 9, 1, 0, 9, 1, 1, 9, 0, 0, 9)
    assert wkb.polygons(z)[0][0].tolist() == [[0, 0], [1, 0], [1, 1], [0, 0]]
    iso = struct.pack("<BII", 1, 1002, 2) + struct.pack("<6d", 0, 0, 5, 1, 1, 5)
    assert wkb.line(iso).tolist() == [[0, 0], [1, 1]] and wkb.polygons(iso) == []
    with pytest.raises(ValueError):
        wkb.polygons(struct.pack("<BI", 1, 99))


def test_parameters():
    assert P.algorithm_name("Sliding-Average") == "gaussian" and P.algorithm_name(0) == "douglaspeucker" and P.algorithm_name("B Spline") == "bspline"
    for bad in ("none", 9):
        with pytest.raises(ValueError):
            P.algorithm_name(bad)
    with pytest.raises(ValueError):
        P.Smoothing(iterations=0)
    degrees = P.layer_units_per_metre(P.Crs("geographic"), (0, 0, 1, 1))[0]
    assert 1 / 111_500 < degrees < 1 / 108_000 and P.unit_factor("m", P.Crs("projected", 0.3048006096), (0, 0, 1, 1)) == pytest.approx(3.2808333, rel=1e-6)
    assert P.unit_factor("map", None, (0, 0, 1, 1)) == 1 and P.tolerance_steps(3e-4, 1e-4) == 3
    assert (P.duration(65), P.duration(3661)) == ("1:05", "1:01:01")
    assert P.Smoothing("dp".replace("dp", "douglaspeucker")).signature() == {"algorithm": "douglaspeucker", "dp": 5.0}


def grid(spark, rows):
    return spark.createDataFrame([(x, y, c) for y, row in enumerate(rows) for x, c in enumerate(row) if c], "px int, py int, cls int")


def flood(rows, eight=False):
    label, out = {}, Counter()
    for y, row in enumerate(rows):
        for x, c in enumerate(row):
            if c and (x, y) not in label:
                root, todo = y * len(row) + x, [(x, y)]
                label[x, y] = root
                while todo:
                    i, j = todo.pop()
                    out[root] += 1
                    for dx in (-1, 0, 1):
                        for dy in (-1, 0, 1):
                            q = (i + dx, j + dy)
                            if (abs(dx) + abs(dy) == 1 or eight and dx and dy) and 0 <= q[0] < len(row) and 0 <= q[1] < len(rows) and rows[q[1]][q[0]] == c and q not in label:
                                label[q] = root
                                todo.append(q)
    return label, out


@pytest.mark.parametrize("eight", [False, True])
def test_regions_against_flood_fill(spark, eight):
    rng = random.Random(1)
    rows = [[rng.choice([0, 1, 1, 2]) for _ in range(14)] for _ in range(11)]
    found = {(r.px, r.py): r.region for r in raster.regions(grid(spark, rows), 14, eight).collect()}
    assert found == flood(rows, eight)[0]


def test_components_of_a_long_chain(spark):
    e = spark.range(300).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v")).union(spark.createDataFrame([(1000, 1001), (1001, 1001), (None, 5)], "u long, v long"))
    found = {r.node: r.component for r in connected_components(e).collect()}
    assert found == {**dict.fromkeys(range(301), 0), 1000: 1000, 1001: 1000}


def test_sieve(spark):
    rows = [[1, 1, 1, 1], [1, 2, 3, 1], [1, 1, 1, 1], [0, 0, 0, 4]]
    out = {(r.px, r.py): r.cls for r in raster.sieve(grid(spark, rows), 4, 2).collect()}
    assert set(out.values()) == {1} and len(out) == 13


def test_block_mode_and_blur_and_classes(spark):
    rows = [[2, 1, 3, 3], [1, 2, 3, 0]]
    assert {(r.px, r.py): r.cls for r in raster.block_mode(grid(spark, rows), 2).collect()} == {(0, 0): 1, (1, 0): 3}
    v = spark.createDataFrame([(x, y, x + 10 * y) for x in range(5) for y in range(4)], "px int, py int, v long")
    one = {(r.px, r.py): r.v for r in raster.box_blur(v, 1, 1).collect()}
    assert one[0, 0] == 0 + 1 + 10 + 11 and one[2, 1] == sum(x + 10 * y for x in (1, 2, 3) for y in (0, 1, 2))
    values = [random.Random(k).randint(-50, 10**6) for k in range(200)]
    df = spark.createDataFrame([(x,) for x in values], "v long")
    assert raster.quantile_thresholds(df, "v", 6, bins=16) == [sorted(values)[-(-k * 200 // 6) - 1] for k in range(1, 6)]


def test_rasterize_returns_the_regions(spark):
    rng = random.Random(4)
    rows = [[rng.choice([1, 2, 2, 0]) for _ in range(9)] for _ in range(7)]
    regions = raster.regions(grid(spark, rows), 9)
    burnt = {(r.px, r.py): r.key - 1 for r in raster.rasterize(raster.region_edges(regions)).collect()}
    assert burnt == flood(rows)[0]


def test_integer_band(spark):
    for kind in ("tinyint", "smallint", "int", "bigint"):
        raster.validate_integer_band(spark.sql(f"SELECT CAST(100 AS {kind}) cls"))
    for bad in ("CAST(1.5 AS DOUBLE)", "3000000000L"):
        with pytest.raises(ValueError):
            raster.validate_integer_band(spark.sql(f"SELECT {bad} cls"))
    with pytest.raises(ValueError):
        tables.RasterMeta(1, 1, rotation=(0.1, 0.0))


@pytest.mark.parametrize("name", P.ALGORITHMS)
def test_polygonization_has_no_gaps(spark, name):
    rng = np.random.default_rng(2)
    noise = rng.random((40, 40))
    for _ in range(3):
        noise = (noise + np.roll(noise, 1, 0) + np.roll(noise, 1, 1) + np.roll(noise, -1, 0) + np.roll(noise, -1, 1)) / 5
    rows = (1 + np.digitize(noise, np.quantile(noise, [0.3, 0.6]))).tolist()
    rows[10][10:14] = [0] * 4
    meta = tables.RasterMeta(40, 40, 600_000.0, 1_500_000.0, 10.0)
    out = coverage.smooth_polygonization(grid(spark, rows), meta, P.Smoothing(name), sieve=4)
    polygons = out.polygons.collect()
    assert all(r.status == 1 for r in polygons)
    sieved = raster.sieve(grid(spark, rows), 40, 4)
    assert len(polygons) == raster.regions(sieved, 40).select("region").distinct().count()
    summary = out.summary.first()
    assert summary.n_invalid == 0 and summary.n_smoothed > 0
    # each border is one line for both sides, so areas sum to the frame less its nodata
    hole = [wkb.line(bytes(r.wkb)) for r in out.arcs.where("rpoly_id = 0 AND smoothed = 1").collect()]
    nodata = sum(-G.area2(h[:-1]) / 2 for h in hole if (h[0] == h[-1]).all())
    if len(hole) == 1 and (hole[0][0] == hole[0][-1]).all():
        assert sum(area(r.wkb) for r in polygons) == pytest.approx(400.0**2 - nodata, rel=1e-9)
    assert Counter(r.class_value for r in polygons).keys() <= {1, 2, 3}


def features(spark, case, scale=10.0):
    rows = []
    for p, rings in fixtures.coverages()[case].items():
        parts = [[np.array(rings[0], float) * scale]]
        for r in rings[1:]:
            parts.append([np.array(r, float) * scale]) if G.area2(np.array(r)) > 0 else parts[-1].append(np.array(r, float) * scale)
        rows.append((p, f"name{p}", bytearray(wkb.from_polygons(parts))))
    return spark.createDataFrame([*rows, (99, "nothing", None)], "fid long, name string, wkb binary")


@pytest.mark.parametrize("case", ["strip", "island", "pinch", "touching_hole"])
def test_smooth_polygons_keeps_attributes_and_area(spark, case):
    df = features(spark, case)
    out = coverage.smooth_polygons(df, P.Smoothing(sigma=5.0, post=0.1), keep_outer=True).polygons.collect()
    assert {(r.fid, r.name) for r in out} == {(r.fid, r.name) for r in df.collect()} and all(r.status == 1 for r in out if r.fid != 99)
    before = sum(area(r.wkb) for r in df.where("wkb IS NOT NULL").collect())
    assert sum(area(r.wkb) for r in out if r.wkb) == pytest.approx(before, rel=1e-6)


def test_sinks(spark, tmp_path):
    df = features(spark, "pinch").where("fid < 3")
    for name in ("a.parquet", "b.geojson"):
        tables.write_features(df, str(tmp_path / name))
    assert tables.read_features(spark, str(tmp_path / "a.parquet")).count() == 3  # the first has two parts
    rows = tables.read_features(spark, str(tmp_path / "b.geojson")).collect()
    assert Counter(r.properties.fid for r in rows) == {1: 2, 2: 1} and {r.geometry.type for r in rows} == {"Polygon"}
    with pytest.raises(ValueError):
        tables.write_features(df, str(tmp_path / "c.xyz"))
    with pytest.raises(ValueError):
        tables.guard_temporary(df, True, 2)
    assert tables.work_folder("/a/Forest.gpkg") == "/a/Forest" and tables.work_folder("memory:x") is None


def test_stage_store_reuses_and_restarts(spark, tmp_path):
    store, calls = StageStore(spark, str(tmp_path)), []

    def build():
        calls.append(1)
        return spark.range(3)

    for sigma in (1, 1, 2):
        assert store.stage("smooth", signature(sigma=sigma), build).count() == 3
    assert len(calls) == 2


def test_work_folder_gives_the_same_result(spark, tmp_path):
    df = features(spark, "strip")
    runs = [coverage.smooth_polygons(df, P.Smoothing(sigma=5.0), work=str(tmp_path)).polygons.collect() for _ in range(2)]
    digest = [sorted((r.fid, bytes(r.wkb or b"")) for r in x) for x in runs]
    assert digest[0] == digest[1] == sorted((r.fid, bytes(r.wkb or b"")) for r in coverage.smooth_polygons(df, P.Smoothing(sigma=5.0)).polygons.collect())


def test_metrics(spark):
    tune = spark.createDataFrame([("d", "a", 0.5), ("d", "b", 0.7), ("d", "c", 0.7), ("e", "a", 0.1)], "dataset string, param string, miou double")
    assert {(r.dataset, r.param) for r in metrics.best_parameter(tune, ["dataset"], "miou", "param").collect()} == {("d", "b"), ("e", "a")}
    assert {r.param: r.mean_rank for r in metrics.mean_rank(tune, "param", "dataset", "miou").collect()} == {"a": 2.0, "b": 1.5, "c": 1.5}
    items = spark.createDataFrame([("p", 1, 5), ("q", 2, 2), ("r", 3, 3), ("s", 2, 2)], "k string, a int, b int")
    assert {r.k for r in metrics.pareto(items, "k", ["a", "b"]).collect()} == {"p", "q", "s"}
    r = grid(spark, [[1, 1, 2], [2, 2, 2]])
    assert metrics.accuracy(r, r).first() == (1.0, 1.0)
    s = metrics.shape(topology.edges(vertices(spark, "grid9"))).first()
    assert (s.n_edges, s.n_axis, s.n_sharp) == (36, 36, 36) and s.entropy == pytest.approx(math.log(2) / math.log(36))
    d = spark.createDataFrame([(b"x",), (b"y",), (b"x",)], "b binary")
    assert metrics.digest(d, "b").first() == metrics.digest(d.orderBy("b"), "b").first()
    far = {(q.px, q.py): q.distance for q in raster.border_distance(spark.createDataFrame([(0, 0), (9, 9)], "px int, py int"), spark.createDataFrame([(3, 4)], "px int, py int"), 5).collect()}
    assert far == {(0, 0): 5.0, (9, 9): None}


def test_exact_border_distances_in_both_directions(spark):
    one, two = [(0, 0), (40, 9), (3, 30)], [(3, 4), (0, 1)]
    make = lambda rows: spark.createDataFrame(rows, "px int, py int")
    near = lambda a, b: {p: min(math.dist(p, q) for q in b) for p in a}
    there, back = raster.nearest_distance(make(one), make(two)), raster.nearest_distance(make(two), make(one))
    assert {(r.px, r.py): r.distance for r in there.collect()} == pytest.approx(near(one, two))
    row = metrics.boundary_both(there, back, 2.0).first()
    assert row.hausdorff == pytest.approx(max(near(one, two).values())) and (row.precision, row.recall) == pytest.approx((1 / 3, 1 / 2)) and row.f1 == pytest.approx(0.4)


def test_entry_points_without_the_llm_folder():
    import __spark_entry__ as entry

    from seamcover import catalog

    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
