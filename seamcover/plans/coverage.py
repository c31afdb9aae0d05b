"""The two entry points: smoothing a polygon coverage, and smoothing the polygons of a classified raster."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamcover.functions import wkb
from seamcover.functions.graph import cut_lineage
from seamcover.functions.lines import Lines
from seamcover.functions.params import Crs, Smoothing, tolerance_steps, unit_factor, vector_precision
from seamcover.operators import metrics, raster, rebuild, smoothing, topology
from seamcover.plans.job import Job
from seamcover.plans.store import StageStore, signature
from seamcover.sources import tables


@dataclass
class Smoothed:
    """polygons: the input's attributes with ``wkb``; arcs: arc_id, lpoly, rpoly, smoothed, wkb; summary: one row."""

    polygons: DataFrame
    arcs: DataFrame
    summary: DataFrame


def raster_borders(labelled: DataFrame, keep: str = "none", extent: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Labelled border edges of regions, each once."""
    e = raster.region_edges(labelled).where("other = 0 OR other > poly_id")
    return topology.fix_outer(e, keep, extent).select(F.col("poly_id").alias("lpoly"), F.col("other").alias("rpoly"), "fixed", "x0", "y0", "x1", "y1")


def finish(arcs: DataFrame, p: Smoothing, keep: object, near: float) -> tuple[DataFrame, DataFrame]:
    """Smoothed arcs and valid polygons of arcs in layer units; near: distance from a common end where arcs may meet."""
    smoothed = keep("smooth", lambda: smoothing.smooth_arcs(arcs, p))
    results = keep("rebuild", lambda: rebuild.rebuild(smoothed, near=near))
    return rebuild.repair(smoothed, results, p, near)


def _keeper(spark, root: str | None, signs: Callable[[], dict[str, str]], job: Job | None):
    """How a stage's rows are kept: in the store by signature, or at a checkpoint; a job may hold or end it before."""
    if root is None:
        keep = lambda name, build: cut_lineage(build())
    else:
        store, known = StageStore(spark, root), signs()
        keep = lambda name, build: store.stage(name, known["smoothing" if name in ("smooth", "rebuild") else "topology"], build)
    return keep if job is None else lambda name, build: job.stage(name, lambda: keep(name, build))


def _arc_rows(arcs: DataFrame) -> DataFrame:
    """The arcs sink's columns, lines as WKB."""

    def run(batches):
        for batch in batches:
            lines = Lines.from_arrow(batch.column("smooth"))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([wkb.from_line(lines[k]) for k in range(len(lines))], pa.binary())], names=[*batch.schema.names[:-1], "wkb"])

    rows = arcs.select("arc_id", F.col("lpoly").alias("lpoly_id"), F.col("rpoly").alias("rpoly_id"), F.col("state").isin(1, 4, 5).cast("int").alias("smoothed"), "smooth")
    return rows.mapInArrow(run, "arc_id long, lpoly_id long, rpoly_id long, smoothed int, wkb binary")


def scaled(arcs: DataFrame, grid: float, x0: float, y0: float) -> DataFrame:
    """Arcs with their points in layer units."""
    point = lambda q: F.struct((q.x * grid + x0).alias("x"), (q.y * grid + y0).alias("y"))
    return arcs.withColumn("pts", F.transform("pts", point))


def region_arcs(regions: DataFrame, meta: tables.RasterMeta, keep_extent: bool = True) -> DataFrame:
    """Arcs of labelled pixels, in layer units."""
    frame = (0, -meta.height, meta.width, 0)
    return scaled(topology.with_ids(topology.chain_arcs(raster_borders(regions, "extent" if keep_extent else "none", frame))), meta.pixel, meta.xmin, meta.ymax)


def polygonize(pixels: DataFrame, meta: tables.RasterMeta, sieve: int = 0, eight: bool = False) -> DataFrame:
    """Polygons (fid, class_value, wkb) of a classified raster as they are: one for each region of one class.

    Regions are numbered by their smallest pixel (row by row from the top); classes may be floating-point numbers.
    """
    kept = raster.mask_nodata(pixels, meta.nodata)
    regions = cut_lineage(raster.regions(raster.sieve(kept, meta.width, sieve, eight) if sieve > 1 else kept, meta.width, eight))
    arcs = region_arcs(regions, meta, keep_extent=False)
    return rebuild.rebuild(arcs.withColumn("smooth", F.col("pts"))).join(_classes(regions), "poly_id").select(F.col("poly_id").alias("fid"), "class_value", "wkb")


def _classes(regions: DataFrame) -> DataFrame:
    whole = regions.schema["cls"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    return regions.groupBy((F.col("region") + 1).alias("poly_id")).agg(F.first("cls").cast("long" if whole else "double").alias("class_value"))


def smooth_polygonization(
    pixels: DataFrame, meta: tables.RasterMeta, p: Smoothing | None = None, sieve: int = 0, eight: bool = False, keep_extent: bool = True, work: str | None = None,
    units: str = "metres", crs: Crs | None = None, job: Job | None = None,
) -> Smoothed:
    """Polygons of a classified raster with every border smoothed once; attribute ``class_value``.

    Regions are numbered by their smallest pixel (row by row from the top); nodata is outside. Distances of ``p`` are
    in ``units``: metres, or those of the layer. Stages in ``work`` are found again for the same pixels and parameters.
    """
    extent = (meta.xmin, meta.ymax - meta.height * meta.pixel, meta.xmin + meta.width * meta.pixel, meta.ymax)
    p = (Smoothing() if p is None else p).scaled(unit_factor(units, crs, extent))
    tables.R.validate_integer_band(pixels)
    kept = raster.mask_nodata(pixels, meta.nodata)

    def signs():
        sign = dict(input=tables.content_signature(kept, "px", "py", "cls"), meta=meta, sieve=sieve, eight=eight, keep=keep_extent)
        return dict(topology=signature(**sign), smoothing=signature(**sign, p=p.signature()))

    keep = _keeper(pixels.sparkSession, work, signs, job)
    if sieve > 1:
        pixels_left = kept
        kept = keep("sieve", lambda: raster.sieve(pixels_left, meta.width, sieve, eight))
    regions = keep("regions", lambda: raster.regions(kept, meta.width, eight))
    arcs = keep("arcs", lambda: region_arcs(regions, meta, keep_extent))
    arcs, results = finish(arcs, p, keep, 10 * meta.pixel / 1000)
    polygons = results.join(_classes(regions), "poly_id").select("poly_id", "class_value", "status", "wkb")
    return Smoothed(polygons, _arc_rows(arcs), metrics.summary(arcs, results))


def smooth_polygons(
    features: DataFrame, p: Smoothing | None = None, fid: str = "fid", geometry: str = "wkb", keep_outer: bool = False, precision: float | None = None, tolerance: float | None = None,
    crs: Crs | None = None, work: str | None = None, units: str = "metres", job: Job | None = None,
) -> Smoothed:
    """A polygon coverage with every shared border smoothed once; attributes are joined back by ``fid`` at the end.

    The smaller fid has a border's direction. Polygons that fall below the precision are left out, with null geometry
    in the result, as are features with a null one. All columns stay as they are but for the geometry; ``status``
    comes to them, with underscores in front where the input has a column of that name. Distances of ``p``, precision
    and tolerance are in ``units``: metres, by the reference system, or those of the layer. The summary also counts
    features, those skipped and those invalid on input, vertices, and edges that more than one polygon owns. Stages in
    ``work`` are found again for the same geometries and parameters.
    """
    rings = tables.polygon_vertices(features, fid, geometry)
    bound = lambda f, c: F.coalesce(f(c), F.lit(0.0))
    *extent, n_vertices = rings.agg(bound(F.min, "x"), bound(F.min, "y"), bound(F.max, "x"), bound(F.max, "y"), F.count("*")).first()
    x0, y0 = map(math.floor, extent[:2])
    factor = unit_factor(units, crs, tuple(extent))
    p = (Smoothing() if p is None else p).scaled(factor)
    grid = vector_precision(crs) if precision is None else precision * factor
    steps = tolerance_steps(3 * grid if tolerance is None else tolerance * factor, grid)

    def signs():
        sign = dict(input=tables.content_signature(features, fid, geometry), grid=grid, steps=steps, keep=keep_outer)
        return dict(topology=signature(**sign), smoothing=signature(**sign, p=p.signature()))

    keep = _keeper(features.sparkSession, work, signs, job)
    vertices = keep("vertices", lambda: topology.quantise(rings, grid, x0, y0))
    dense = keep("dense", lambda: topology.densify(vertices, topology.junctions(vertices, steps)))
    edges = topology.fix_outer(topology.labelled(topology.edges(dense)), "outer" if keep_outer else "none")
    arcs = keep("arcs", lambda: scaled(topology.with_ids(topology.arcs(edges)), grid, x0, y0))
    arcs, results = finish(arcs, p, keep, 10 * grid)
    status, names = "status", {c.lower() for c in features.columns if c != geometry}
    while status in names:
        status = f"_{status}"
    key = "_key"
    while key in names:
        key = f"_{key}"
    made = results.select(F.col("poly_id").alias(key), F.col("status").alias("made"), F.col("wkb").alias("shape"))
    own = features.withColumn(key, F.col(f"`{fid}`").cast("long")).alias("f").join(made.alias("m"), F.col(f"f.{key}") == F.col(f"m.{key}"), "left")
    columns = [F.col("m.shape").alias(c) if c == geometry else F.col(f"f.`{c}`") for c in features.columns]
    report = metrics.summary(arcs, results).crossJoin(tables.input_report(features, fid, geometry)).crossJoin(metrics.duplicates(topology.edges(dense)))  # single rows
    return Smoothed(own.select(*columns, F.col("m.made").alias(status)), _arc_rows(arcs), report.withColumn("n_vertices", F.lit(n_vertices)))
