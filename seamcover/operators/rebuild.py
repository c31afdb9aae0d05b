"""Polygons from smoothed arcs: face walk, ring assembly, validity, and the repair of local conflicts."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamcover.functions import geometry as G
from seamcover.functions import wkb
from seamcover.functions.graph import cut_lineage
from seamcover.functions.lines import Lines
from seamcover.functions.params import Smoothing
from seamcover.operators import smoothing as S

#: Status of a polygon.
OK, AS_GIVEN, INVALID, NO_WALK = 1, 2, 0, -1
RESULT = "poly_id long, status int, wkb binary, n_parts int, n_rings int, conflicts array<struct<arc_id:long,x:double,y:double>>"
_RESULT = pa.schema([
    ("poly_id", pa.int64()), ("status", pa.int32()), ("wkb", pa.binary()), ("n_parts", pa.int32()), ("n_rings", pa.int32()),
    ("conflicts", pa.list_(pa.struct([("arc_id", pa.int64()), ("x", pa.float64()), ("y", pa.float64())]))),
])
S_POINTS = "array<struct<x:double,y:double>>"


def walk(arcs: list[tuple[np.ndarray, np.ndarray]]) -> list[list[int]] | None:
    """Rings of a face as lists of arcs, each (original, smoothed), directed with the face on the left.

    At a node the first arc clockwise from the way back is taken, by the original directions. None if an arc would be
    used twice or a ring doesn't close.
    """
    leaving: dict[tuple[float, float], list[int]] = {}
    for i, (before, _) in enumerate(arcs):
        leaving.setdefault(tuple(before[0]), []).append(i)
    used, rings = set(), []
    for first in range(len(arcs)):
        if first in used:
            continue
        ring, i = [], first
        while True:
            if i in used:
                return None
            used.add(i)
            ring.append(i)
            end = tuple(arcs[i][0][-1])
            if end == tuple(arcs[first][0][0]) and (len(leaving[end]) == 1 or _next(arcs, i, leaving[end]) == first):
                break
            if end not in leaving:
                return None
            i = _next(arcs, i, leaving[end])
        rings.append(ring)
    return rings


def _angle(a: np.ndarray, b: np.ndarray) -> float:
    return math.atan2(b[1] - a[1], b[0] - a[0])


def _next(arcs: list, i: int, options: list[int]) -> int:
    if len(options) == 1:
        return options[0]
    before = arcs[i][0]
    back = _angle(before[-1], before[-2])

    def clockwise(j: int) -> float:
        turn = (back - _angle(arcs[j][0][0], arcs[j][0][1])) % (2 * math.pi)
        return turn if turn > 1e-12 else 2 * math.pi

    return min(options, key=clockwise)


def split_loops(ring: list[int], nodes: list[tuple[float, float]]) -> list[list[int]]:
    """A ring of arcs as rings that meet no node twice; nodes: where each of its arcs begins.

    Rings of a planar face visit a node again only after what lies between is done. So an arc that ends in a node is
    followed by the arc that left it at the visit before, the last one's at the first visit; the cycles of that
    successor relation are the rings.
    """
    visits: dict[tuple[float, float], list[int]] = {}
    for i, node in enumerate(nodes):
        visits.setdefault(node, []).append(i)
    if len(visits) == len(nodes):
        return [ring]
    follows = list(range(len(ring)))
    for at in visits.values():
        for i, before in zip(at, at[-1:] + at[:-1], strict=True):
            follows[i - 1] = before
    out, left = [], [True] * len(ring)
    for first in range(len(ring)):
        i, loop = first, []
        while left[i]:
            left[i] = False
            loop.append(ring[i])
            i = follows[i]
        if loop:
            out.append(loop)
    return out


def assemble(rings: list[tuple[np.ndarray, np.ndarray]]) -> list[list[np.ndarray]] | None:
    """Parts of (original, smoothed) rings: counter-clockwise ones are shells, each hole goes to the smallest shell
    around it, by the original rings; a single shell takes all holes. None if a hole has no shell."""
    areas = [G.area2(before) for before, _ in rings]
    order = sorted(range(len(rings)), key=lambda k: areas[k])
    shells, holes = [k for k in order if areas[k] > 0], [k for k in range(len(rings)) if areas[k] <= 0]
    if not shells:
        return None
    parts = {k: [rings[k][1]] for k in shells}
    home = dict.fromkeys(holes, shells[0])
    if len(shells) > 1 and holes:
        nodes = {tuple(p) for k in shells for p in rings[k][0].tolist()}
        found = G.containment(Lines.of([_ends(rings[k][0]) for k in shells]), np.stack([_inside(rings[k][0], nodes) for k in holes]))
        inside: dict[int, int] = {}
        for hole, shell in found.tolist():  # shells go by area, so the first one is the smallest
            inside.setdefault(hole, shell)
        if len(inside) < len(holes):
            return None
        home = {k: shells[inside[i]] for i, k in enumerate(holes)}
    for k in holes:
        parts[home[k]].append(rings[k][1])
    return [parts[k] for k in shells]


def _ends(ring: np.ndarray) -> np.ndarray:
    return ring if (ring[0] == ring[-1]).all() else np.concatenate([ring, ring[:1]])


def _inside(hole: np.ndarray, nodes: set[tuple[float, float]]) -> np.ndarray:
    """A point of the hole that is no vertex of a shell, else the middle of its longest edge."""
    return next((p for p in hole if tuple(p.tolist()) not in nodes), G.probe(_ends(hole)))


def polygon(arcs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[int, list[list[np.ndarray]] | None]:
    """Status and parts of one face."""
    rings = walk(arcs) if arcs else None
    if rings is None:
        return NO_WALK, None
    whole = []
    for ring in rings:
        for loop in split_loops(ring, [tuple(arcs[i][0][0]) for i in ring]):
            whole.append(tuple(np.concatenate([arcs[i][k][:-1] for i in loop]) for k in (0, 1)))
    parts = assemble(whole)
    if parts is None:
        return NO_WALK, None
    return (OK if G.is_valid(parts) else INVALID), parts


def conflicts(lines: list[np.ndarray], near: float) -> tuple[np.ndarray, np.ndarray]:
    """Where arcs of one polygon meet another of them: the arc, and the point, but within ``near`` of an end that both
    have; an arc that meets itself is in conflict too."""
    whole = Lines.of(lines)
    s, owner = G.all_segments(whole)
    pairs = G.meetings(s)
    pairs = pairs[owner[pairs[:, 0]] != owner[pairs[:, 1]]]
    which, points = G.meeting_points(s, pairs)
    two = owner[pairs[which]].reshape(-1, 2)
    ends = np.stack([whole.xy[whole.cuts[:-1]], whole.xy[whole.cuts[1:] - 1]], 1)
    a, b = ends[two[:, 0]], ends[two[:, 1]]
    free = np.ones(len(points), bool)
    for i in (0, 1):
        for j in (0, 1):
            free &= (a[:, i] != b[:, j]).any(1) | (np.abs(points - a[:, i]) > near).any(1)
    s, owner, pairs = G.knots(whole)
    which, own = G.meeting_points(s, pairs)
    return np.concatenate([two[free, 0], two[free, 1], owner[pairs[which, 0]]]), np.concatenate([points[free], points[free], own])


def as_given(arcs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[int, list[list[np.ndarray]] | None]:
    """AS_GIVEN and the parts of the original arcs, valid or not; where the walk fails, arcs are chained as they come."""
    if not arcs:
        return NO_WALK, None
    arcs = [(before, before) for before, _ in arcs]
    parts = polygon(arcs)[1]
    if parts is None:
        leaving: dict[tuple[float, float], list[int]] = {}
        for i, (before, _) in enumerate(arcs):
            leaving.setdefault(tuple(before[0]), []).append(i)
        left, rings = set(range(len(arcs))), []
        while left:
            ring = [min(left)]
            left.discard(ring[0])
            while tuple(arcs[ring[-1]][0][-1]) != tuple(arcs[ring[0]][0][0]):
                after = next((j for j in leaving.get(tuple(arcs[ring[-1]][0][-1]), []) if j in left), None)
                if after is None:
                    break
                left.discard(after)
                ring.append(after)
            whole = np.concatenate([arcs[i][0][:-1] for i in ring])
            rings.append((whole, whole))
        parts = assemble(rings) or [[r] for r, _ in rings]
    return AS_GIVEN, parts


def rebuild(arcs: DataFrame, only: DataFrame | None = None, face: Callable = polygon, near: float = 0.0) -> DataFrame:
    """Polygons (poly_id, status, wkb, n_parts, n_rings, conflicts) of smoothed arcs; only: their poly_id, if not all.

    Both sides of an arc are exploded and grouped by polygon, so there is no join on either of two columns. The wkb of
    an invalid polygon is null, and ``conflicts`` are the places where its arcs meet, ``near`` a common end excepted.
    """
    sides = F.explode(F.array(F.struct(F.col("lpoly").alias("poly_id"), F.lit(True).alias("ahead")), F.struct(F.col("rpoly").alias("poly_id"), F.lit(False).alias("ahead"))))
    each = arcs.select("arc_id", "pts", "smooth", sides.alias("s")).where("s.poly_id <> 0")
    each = each.select("s.poly_id", F.struct("arc_id", F.col("s.ahead").alias("ahead"), "pts", "smooth").alias("arc"))
    if only is not None:
        each = each.join(only.select("poly_id").distinct(), "poly_id", "left_semi")
    lists = each.groupBy("poly_id").agg(F.collect_list("arc").alias("arcs"))

    def run(batches):
        for batch in batches:
            column = batch.column(1)
            cuts, arc = column.offsets.to_numpy() - column.offsets[0].as_py(), column.flatten()
            ids, ahead = arc.field("arc_id").to_numpy(), arc.field("ahead").to_numpy(zero_copy_only=False)
            before, after = (Lines.from_arrow(arc.field(c)) for c in ("pts", "smooth"))
            out = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                own = sorted(range(a, b), key=lambda k: (ids[k], ahead[k]))
                pairs = [(before[k], after[k]) if ahead[k] else (before[k][::-1], after[k][::-1]) for k in own]
                status, parts = face(pairs)
                met = []
                if status in (INVALID, NO_WALK):
                    arcs, points = conflicts([p for _, p in pairs], near)
                    met = [{"arc_id": ids[own[k]], "x": x, "y": y} for k, (x, y) in zip(arcs.tolist(), points.tolist(), strict=True)]
                good = status in (OK, AS_GIVEN)
                out.append((status, wkb.from_polygons(parts) if good else None, len(parts) if parts else 0, sum(map(len, parts)) if parts else 0, met))
            columns = zip(*out, strict=True) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(list(c), f.type) for c, f in zip(columns, list(_RESULT)[1:], strict=True)]], schema=_RESULT)

    return lists.mapInArrow(run, RESULT)


def repair(arcs: DataFrame, results: DataFrame, p: Smoothing, near: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Arcs and results without invalid polygons.

    A round takes the arcs in conflict of the bad polygons, or all their smoothed arcs where none is, and rebuilds only
    the polygons beside them. A long arc is first smoothed anew in windows around all its conflicts so far, wider ones
    each round; an arc without conflicts of its own, a short one, or one whose windows are used up goes a step down the
    ladder. Each step is final, so the rounds end; polygons that are still bad then, whose arcs are all original ones,
    get the original rings and status AS_GIVEN.
    """
    moving = F.col("state").isin(S.SMOOTHED, S.HALF, S.CORNER)
    none = F.array().cast(S_POINTS)
    arcs, results = cut_lineage(arcs.withColumn("level", F.lit(0)).withColumn("points", none)), cut_lineage(results)
    while True:
        bad = cut_lineage(results.where(F.col("status").isin(INVALID, NO_WALK)).select("poly_id", "conflicts"))
        if bad.isEmpty():
            break
        sides = arcs.where(moving).select("arc_id", F.explode(F.array("lpoly", "rpoly")).alias("poly_id"))
        mine = F.filter("conflicts", lambda c: c.arc_id == F.col("arc_id"))
        own = sides.join(bad, "poly_id").select("poly_id", "arc_id", F.transform(mine, lambda c: F.struct(c.x.alias("x"), c.y.alias("y"))).alias("places"))
        any_met = own.groupBy("poly_id").agg(F.max(F.size("places")).alias("any"))
        touched = own.join(any_met, "poly_id").where("size(places) > 0 OR any = 0").groupBy("arc_id").agg(F.flatten(F.collect_list("places")).alias("places"))
        touched = cut_lineage(touched)
        if touched.isEmpty():
            break
        down = S.step_arcs(arcs.join(touched, "arc_id").select(*arcs.columns, "places"), p)
        arcs_next = cut_lineage(arcs.join(touched, "arc_id", "left_anti").unionByName(down))
        again = arcs_next.join(touched, "arc_id", "left_semi").select(F.explode(F.array("lpoly", "rpoly")).alias("poly_id")).where("poly_id <> 0").union(bad.select("poly_id")).distinct()
        fresh = rebuild(arcs_next, again, near=near)
        results = cut_lineage(results.join(again, "poly_id", "left_anti").unionByName(fresh))
        arcs = arcs_next
    if not bad.isEmpty():
        results = cut_lineage(results.join(bad, "poly_id", "left_anti").unionByName(rebuild(arcs, bad, as_given)))
    return arcs.drop("level", "points"), results
