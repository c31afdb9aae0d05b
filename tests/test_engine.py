"""The coverage engine's flat arrays, entry points and job control: batches against single lines, inputs of every kind."""

import math
import random
import threading

import coverages as fixtures
import numpy as np
import pytest
from pyspark.sql import functions as F

from seamcover.functions import geometry as G
from seamcover.functions import graph, wkb
from seamcover.functions import params as P
from seamcover.functions.lines import Lines, mixed
from seamcover.operators import metrics, raster, rebuild, smoothing, topology
from seamcover.plans import coverage
from seamcover.plans.job import Cancelled, Job
from seamcover.sources import tables


def walks(n, seed=42):
    rng, out = np.random.default_rng(seed), []
    for k in range(n):
        p = np.cumsum(rng.integers(-3, 4, (int(rng.integers(2, 120)), 2)), 0).astype(float) * 5
        p = p[np.concatenate([[True], (np.diff(p, axis=0) != 0).any(1)])]
        out.append(np.concatenate([p, p[:1]]) if k % 3 == 0 and len(p) > 4 else p)
    return out


@pytest.mark.parametrize("name", P.ALGORITHMS)
def test_a_batch_gives_each_line_what_it_gets_alone(name):
    lines = walks(200)
    p = P.Smoothing(name, sigma=7.0, pre=4.0, post=0.7, dp=3.0)
    out = smoothing.smooth_lines(Lines.of(lines), p)
    for k, line in enumerate(lines):
        assert (out[k] == smoothing.smooth(line, p)).all()
    made, states = smoothing.smooth_all(Lines.of(lines[:40]), np.zeros(40, bool), p)
    for k in range(40):
        one, state = smoothing.smooth_arc(lines[k], p)
        assert state == states[k] and (one == made[k]).all()


def plain_simplify(p, tolerance):
    """Recursion point by point."""
    if len(p) < 3:
        return [tuple(q) for q in p]
    (ax, ay), (bx, by) = p[0], p[-1]
    cx, cy = bx - ax, by - ay
    far = []
    for x, y in p[1:-1]:
        t = min(max(((x - ax) * cx + (y - ay) * cy) / (cx * cx + cy * cy), 0), 1) if cx * cx + cy * cy > 0 else 0
        far.append((x - ax - t * cx) ** 2 + (y - ay - t * cy) ** 2)
    k = far.index(max(far)) + 1
    if far[k - 1] <= tolerance**2:
        return [tuple(p[0]), tuple(p[-1])]
    return plain_simplify(p[: k + 1], tolerance)[:-1] + plain_simplify(p[k:], tolerance)


def test_simplify_against_recursion():
    for line in [q for q in walks(60, 7) if (q[0] != q[-1]).any()]:
        for tolerance in (2.0, 7.5):
            assert [tuple(q) for q in smoothing.simplify(line, tolerance)] == plain_simplify(line, tolerance)


def test_gaussian_against_its_formula():
    """Samples, odd reflection and normalised weights, one by one."""
    line, sigma = np.array([(0, 0), (30, 10), (50, 40), (90, 40)], float), 9.0
    along = np.concatenate([[0], np.cumsum(np.hypot(*np.diff(line, axis=0).T))])
    total = along[-1]
    n = max(math.ceil(total / min(sigma / 4, total / 3)), 3)
    even = [np.array([np.interp(j * total / (n - 1), along, line[:, c]) for c in (0, 1)]) for j in range(n)]
    s = min(sigma / (total / n), (n - 1) / 3)
    r = max(1, math.ceil(3 * s))
    at = lambda j: 2 * even[0] - even[-j] if j < 0 else 2 * even[-1] - even[2 * (n - 1) - j] if j >= n else even[j]
    weights = [math.exp(-0.5 * (o / s) ** 2) for o in range(-r, r + 1)]
    want = [sum(w * at(j + o) for w, o in zip(weights, range(-r, r + 1), strict=True)) / sum(weights) for j in range(n)]
    out = smoothing.smooth(line, P.Smoothing("gaussian", sigma=sigma, post=0.0))
    assert len(out) == n and out[1:-1] == pytest.approx(np.array(want)[1:-1]) and (out[[0, -1]] == line[[0, -1]]).all()


def test_lines_and_arrow():
    lines = Lines.of(walks(9))
    back = Lines.from_arrow(lines.to_arrow().slice(2, 5))
    assert len(back) == 5 and all((back[k] == lines[k + 2]).all() for k in range(5))
    chosen = np.arange(9) % 2 == 0
    both = mixed(chosen, lines, Lines(lines.xy + 1, lines.cuts))
    assert all((both[k] == lines[k] + (k % 2)).all() for k in range(9))
    assert [G.area2(lines[k][:-1]) for k in np.flatnonzero(lines.closed())] == pytest.approx(lines.areas2()[lines.closed()].tolist())


def test_containment_against_each_point():
    rng = np.random.default_rng(4)
    rings = [np.array([(0, 0), (9, 1), (7, 8), (4, 3), (1, 9), (0, 0)], float) * k + s for k, s in ((1, 0), (3, -4), (0.5, 2))]
    points = np.concatenate([rng.uniform(-5, 30, (300, 2)), rng.integers(0, 9, (100, 2))])

    def inside(ring, p):
        n = 0
        for a, b in zip(ring, ring[1:], strict=False):
            n += (a[1] > p[1]) != (b[1] > p[1]) and a[0] + (p[1] - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) > p[0]
        return n % 2

    found = {tuple(x) for x in G.containment(Lines.of(rings), points).tolist()}
    assert found == {(i, k) for i, p in enumerate(points) for k, r in enumerate(rings) if inside(r, p)}


def test_rings_split_at_nodes_they_meet_again():
    assert rebuild.split_loops([7, 8, 9], [(0, 0), (1, 0), (2, 0)]) == [[7, 8, 9]]
    assert sorted(map(sorted, rebuild.split_loops(list("abcde"), [(0, 0), (1, 1), (2, 2), (1, 1), (3, 3)]))) == [["a", "d", "e"], ["b", "c"]]
    flower = [(0, 0), (1, 0), (0, 0), (2, 0), (0, 0), (3, 0)]
    assert sorted(map(sorted, rebuild.split_loops(list(range(6)), flower))) == [[0, 1], [2, 3], [4, 5]]


def test_holes_go_to_the_smallest_shell():
    square = lambda a, b: np.array(fixtures.square(a, a, b, b), float)
    shells, holes = [square(0, 40), square(10, 20), square(50, 60)], [square(1, 30)[::-1], square(12, 14)[::-1], square(52, 53)[::-1]]
    parts = rebuild.assemble([(r, r) for r in [*holes, *shells]])
    assert sorted((len(p), G.area2(p[0])) for p in parts) == [(2, 200), (2, 200), (2, 3200)]
    assert rebuild.assemble([(square(0, 9), square(0, 9)), (square(20, 30), square(20, 30)), (square(50, 51)[::-1], square(50, 51)[::-1])]) is None


def borders_of(cells):
    """Closed lines around the cells that are set, by the chains of one square."""
    edges = []
    for y, row in enumerate(cells):
        for x, c in enumerate(row):
            near = lambda i, j: 0 <= j < len(cells) and 0 <= i < len(row) and cells[j][i]  # noqa: E731, B023
            if c:
                edges += [e for free, e in ((not near(x, y + 1), (x, -y - 1, x + 1, -y - 1)), (not near(x + 1, y), (x + 1, -y - 1, x + 1, -y)), (not near(x, y - 1), (x + 1, -y, x, -y)), (not near(x - 1, y), (x, -y, x, -y - 1))) if free]
    e = np.array(edges)
    lines, _, closed = topology._chains(e, np.zeros(len(e), np.int64), np.zeros(len(e), bool))
    assert closed.all()
    return topology.straight(lines, closed)


def test_windows_mend_long_arcs():
    """Borders whose smoothed form meets itself are accepted in the end, long ones with windows."""
    p, mended = P.Smoothing("douglaspeucker", dp=50.0), 0
    for seed in range(6):
        lines = borders_of((np.array(noise(seed, 40, 2)) == 1).tolist())
        lines = Lines(lines.xy * 10, lines.cuts)
        before = G.simple(lines)
        out, states = smoothing.smooth_all(lines, ~before, p)
        usual = smoothing.accepted_lines(smoothing.smooth_lines(lines, p), lines)
        assert smoothing.accepted_lines(out, lines)[before].all()
        mended += (~usual & before & (states == smoothing.SMOOTHED)).sum()
        assert (states[usual & before & (lines.sizes >= 5)] == smoothing.SMOOTHED).all()
    assert mended


@pytest.mark.parametrize("small", [0, 1 << 20])
def test_components_both_ways(spark, monkeypatch, small):
    monkeypatch.setattr(graph, "SMALL_GRAPH", small)
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)]
    parent = list(range(400))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    found = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {x: root(x) for e in edges if e[0] != e[1] for x in e}


def noise(seed, n, classes=3):
    rng = np.random.default_rng(seed)
    v = rng.random((n, n))
    v = (v + np.roll(v, 1, 0) + np.roll(v, 1, 1)) / 3
    return (1 + np.digitize(v, np.quantile(v, np.linspace(0, 1, classes + 1)[1:-1]))).tolist()


def grid(spark, rows):
    return spark.createDataFrame([(x, y, c) for y, row in enumerate(rows) for x, c in enumerate(row) if c], "px int, py int, cls int")


def test_sieve_both_ways(spark, monkeypatch):
    pixels = grid(spark, noise(9, 16, 4))
    one = {(r.px, r.py): r.cls for r in raster.sieve(pixels, 16, 6).collect()}
    monkeypatch.setattr(raster, "SMALL_GRAPH", 0)
    assert {(r.px, r.py): r.cls for r in raster.sieve(pixels, 16, 6).collect()} == one and len(set(one.values())) > 1


def test_arcs_do_not_depend_on_the_squares(spark):
    borders = coverage.raster_borders(raster.regions(grid(spark, noise(5, 24)), 24))
    rows = lambda tile: sorted((r.lpoly, r.rpoly, r.closed, tuple((q.x, q.y) for q in r.pts)) for r in topology.chain_arcs(borders, tile).collect())
    whole = rows(512)
    assert rows(5) == whole and rows(8) == whole and any(r[2] for r in whole)


def test_a_changed_input_is_not_taken_for_the_old_one(spark, tmp_path):
    meta, p = tables.RasterMeta(4, 4), P.Smoothing("chaikin")
    for cls in (3, 7):
        out = coverage.smooth_polygonization(grid(spark, [[cls] * 4] * 4), meta, p, work=str(tmp_path)).polygons
        assert [r.class_value for r in out.collect()] == [cls]
    square = lambda x: bytearray(wkb.from_polygons([[np.array(fixtures.square(0, 0, x, 10), float)]]))
    for x in (10, 20):
        out = coverage.smooth_polygons(spark.createDataFrame([(1, square(x))], "fid long, wkb binary"), p, keep_outer=True, work=str(tmp_path)).polygons.first()
        assert wkb.polygons(bytes(out.wkb))[0][0][:, 0].max() == x


def test_degrees_with_long_edges(spark):
    """Edges of 10 degrees on a grid of 1e-9, a junction in the middle of one, distances in metres."""
    shapes = {1: fixtures.square(0, 40, 10, 50), 2: fixtures.square(10, 40, 20, 45), 3: fixtures.square(10, 45, 20, 50)}
    df = spark.createDataFrame([(k, bytearray(wkb.from_polygons([[np.array(s, float)]]))) for k, s in shapes.items()], "fid long, wkb binary")
    out = coverage.smooth_polygons(df, P.Smoothing("gaussian", sigma=50_000.0, post=100.0), crs=P.Crs("geographic"), keep_outer=True)
    rows = {r.fid: r for r in out.polygons.collect()}
    area = lambda b: sum(G.area2(r[:-1]) for part in wkb.polygons(bytes(b)) for r in part) / 2
    assert all(r.status == 1 for r in rows.values()) and sum(area(r.wkb) for r in rows.values()) == pytest.approx(200)
    assert sorted((r.lpoly_id, r.rpoly_id) for r in out.arcs.collect()) == [(1, 0), (1, 2), (1, 3), (2, 0), (2, 3), (3, 0)]
    one = {tuple(q) for q in wkb.polygons(bytes(rows[1].wkb))[0][0]}
    assert (10.0, 45.0) in one


def test_exact_junctions_of_long_slanted_edges(spark):
    big = 3 * 10**11
    rings = [(1, 0, 0, 0, 0), (1, 0, 1, 3 * big, big), (1, 0, 2, 0, big), (2, 0, 0, 3, 1), (2, 0, 1, 3 * big - 3, big - 1), (2, 0, 2, 6, 1)]
    found = topology.junctions(spark.createDataFrame(rings, "poly_id long, ring int, seq int, x long, y long")).collect()
    assert sorted((r.poly_id, r.seq, r.x, r.y) for r in found) == [(1, 0, 3, 1), (1, 0, 3 * big - 3, big - 1)]


def test_attributes_whatever_their_names(spark):
    square = bytearray(wkb.from_polygons([[np.array(fixtures.square(0, 0, 9, 9), float)]]))
    df = spark.createDataFrame([(1, square, "old", 5, b"z", "x"), (2, None, "none", 6, None, "y")], "fid long, shape binary, status string, poly_id int, wkb binary, `a.b` string")
    out = coverage.smooth_polygons(df, P.Smoothing("chaikin"), geometry="shape").polygons
    rows = {r.fid: r for r in out.collect()}
    assert out.columns == [*df.columns, "_status"] and (rows[1].status, rows[1].poly_id, bytes(rows[1].wkb), rows[1]["a.b"]) == ("old", 5, b"z", "x")
    assert rows[1]["_status"] == 1 and rows[1].shape is not None and rows[2].shape is None and rows[2].status == "none"


def test_reports_of_the_input(spark):
    shape = lambda *rings: bytearray(wkb.from_polygons([[np.array(r, float)] for r in rings]))
    bow = [(0, 0), (4, 4), (4, 0), (0, 4.5)]
    rows = [(1, shape(fixtures.square(0, 0, 10, 10))), (2, shape(fixtures.square(0, 0, 10, 10))), (3, None), (None, shape(fixtures.square(0, 0, 1, 1))), (4, shape([(0, 0), (1, 1), (2, 2)])), (5, shape([(x + 50, y) for x, y in bow]))]
    out = coverage.smooth_polygons(spark.createDataFrame(rows, "fid long, wkb binary"), P.Smoothing("chaikin"))
    s = out.summary.first()
    assert (s.n_features, s.n_skipped, s.n_invalid_input, s.n_duplicate_edges) == (6, 3, 1, 4) and s.n_vertices == 12
    assert {r.fid for r in out.polygons.collect() if r.fid} == {1, 2, 3, 4, 5}


def test_polygonize_takes_floats(spark):
    pixels = spark.createDataFrame([(x, y, 1.5 if x < 2 else 2.5) for x in range(4) for y in range(3)], "px int, py int, cls double")
    assert {r.class_value for r in coverage.polygonize(pixels, tables.RasterMeta(4, 3)).collect()} == {1.5, 2.5}


def test_job_control(spark):
    job, said = Job(spark, "test-job", lambda line: None), []
    assert job.eta(("a", "b")) is None and job.stage("a", lambda: 5) == 5 and job.eta(("a", "b")) >= 0
    job.toggle()
    waiting = threading.Thread(target=lambda: said.append(job.stage("b", lambda: 6)))
    waiting.start()
    waiting.join(0.2)
    assert waiting.is_alive() and not said
    job.resume()
    waiting.join(5)
    assert said == [6]
    job.cancel()
    with pytest.raises(Cancelled):
        job.stage("c", lambda: 7)
    with pytest.raises(Cancelled):
        coverage.smooth_polygonization(grid(spark, [[1]]), tables.RasterMeta(1, 1), job=job)


def test_tune_tables(spark, tmp_path):
    (tmp_path / "tune.csv").write_text('dataset,tool,param,seconds,mIoU,OA\nd,t,"sigma=5,x",7.5,0.9,0.95\nd,t,b,FAILED,0.5,0.6\nd,none,,0,0.4,0.5\n')
    tune = tables.read_tune(spark, str(tmp_path / "tune.csv"))
    assert [(r.param, r.seconds) for r in tune.where("tool = 't'").collect()] == [("sigma=5,x", 7.5), ("b", None)]
    tables.write_best(metrics.best_parameter(tune, ["dataset", "tool"], "mIoU", "param"), str(tmp_path / "best"))
    assert {(r.tool, r.mIoU) for r in spark.read.json(str(tmp_path / "best")).collect()} == {("t", 0.9), ("none", 0.4)}
    gains = metrics.against_baseline(tune, tune.where("tool = 'none'"), ["dataset"], "mIoU")
    assert {round(r.gain, 9) for r in gains.collect()} == {0.5, 0.1, 0.0}


def test_row_minima_against_all_pairs():
    rng = np.random.default_rng(8)
    for n, m in ((1, 5), (7, 1), (200, 150), (50, 400)):
        x, q = np.sort(rng.choice(1000, n, False)), np.sort(rng.integers(0, 1000, m))
        g = rng.integers(0, 300, n) ** 2
        assert (raster.row_minima(x, g, q) == ((x[None] - q[:, None]) ** 2 + g).min(1)).all()


def test_broken_coverages(spark):
    found = spark.createDataFrame([(0, 0.0, 0.0), (1, 0.0, 0.0), (0, 2e-4, 0.0), (0, 0.0, 2e-4), (0, 1e-5, 1e-5)], "n_invalid int, overlap double, gap double")
    assert [r.broken for r in metrics.broken(found, 100.0).collect()] == [False, True, True, True, False]
