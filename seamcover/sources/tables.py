"""Sources and sinks: pixel and polygon tables, GeoJSON, and the raster and coverage derived from the driver's tables."""

from __future__ import annotations

import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamcover.functions import geometry as G
from seamcover.functions import wkb
from seamcover.functions.graph import cut_lineage
from seamcover.functions.lines import Lines
from seamcover.operators import raster as R

#: Polygons or pixels from which a result may not go to a temporary place.
LARGE_POLYGONS, LARGE_PIXELS = 50_000, 10_000_000


#: Half width of the box that blurs the events' raster, in pixels.
HALF = 5


@dataclass(frozen=True)
class RasterMeta:
    width: int
    height: int
    xmin: float = 0.0
    ymax: float = 0.0
    pixel: float = 1.0
    nodata: int | None = None
    rotation: tuple[float, float] = (0.0, 0.0)

    def __post_init__(self):
        if any(self.rotation):
            raise ValueError("rotated rasters aren't supported")


def event_values(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int, int]:
    """Pixels (px, py, v) of the events' values in cents, by event number, and the frame's width and height."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    width, height = R.frame(events.count())
    w = F.lit(width).cast("long")
    v = F.round(F.col("value") * 100).cast("long").alias("v")
    return events.select((F.col("event_id") % w).cast("int").alias("px"), F.floor(F.col("event_id") / w).cast("int").alias("py"), v), width, height


def event_raster(spark: SparkSession, sf_dir: str, classes: int = 6) -> tuple[DataFrame, RasterMeta]:
    """The synthetic classified raster: blurred values cut into classes of equal size."""
    pixels, width, height = event_values(spark, sf_dir)
    blurred = cut_lineage(R.box_blur(pixels, HALF))
    return R.quantile_classes(blurred, classes).select("px", "py", "cls"), RasterMeta(width, height, pixel=10.0)


def run_rectangles(raster: DataFrame, width: int) -> DataFrame:
    """A polygon coverage with missing junctions: one rectangle for each horizontal run of a class."""
    spans = R.runs(raster, width).groupBy("run").agg(F.min("px").alias("a"), (F.max("px") + 1).alias("b"), F.first("py").alias("r"))
    corner = lambda seq, x, y: F.struct(F.lit(seq).alias("seq"), F.col(x).cast("long").alias("x"), y.cast("long").alias("y"))
    low, high = -F.col("r") - 1, -F.col("r")
    corners = F.explode(F.array(corner(0, "a", low), corner(1, "b", low), corner(2, "b", high), corner(3, "a", high))).alias("q")
    return spans.select((F.col("run") + 1).alias("poly_id"), F.lit(0).alias("ring"), corners).select("poly_id", "ring", "q.seq", "q.x", "q.y")


def _rings(data: bytes) -> list[np.ndarray]:
    """A geometry's open rings, shells counter-clockwise and holes clockwise; those without area are left out."""
    out = []
    for part in wkb.polygons(data):
        for i, ring in enumerate(part):
            p = ring[:-1] if len(ring) > 1 and (ring[0] == ring[-1]).all() else ring
            if len(p) >= 3 and (area := G.area2(p)):
                out.append(p if (area > 0) == (i == 0) else p[::-1])
    return out


def _picked(df: DataFrame, fid: str, geometry: str) -> DataFrame:
    return df.select(F.col(f"`{fid}`").cast("long").alias("fid"), F.col(f"`{geometry}`").alias("wkb"))


def polygon_vertices(df: DataFrame, fid: str = "fid", geometry: str = "wkb") -> DataFrame:
    """Ring vertices (poly_id = fid, ring, seq, x, y) of WKB polygons, shells counter-clockwise and holes clockwise.

    Null and empty geometries, and rings without area, are left out. Other columns aren't read.
    """

    def run(batches):
        for batch in batches:
            rings, keys, numbers = [], [], []
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = _rings(data.as_py())
                rings += own
                keys += [key] * len(own)
                numbers += range(len(own))
            lines = Lines.of(rings)
            columns = [np.repeat(np.array(keys, np.int64), lines.sizes), np.repeat(np.array(numbers, np.int32), lines.sizes), np.arange(len(lines.xy), dtype=np.int32) - np.repeat(lines.cuts[:-1], lines.sizes).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), *[pa.array(np.ascontiguousarray(lines.xy[:, k])) for k in (0, 1)]], names=["poly_id", "ring", "seq", "x", "y"])

    return _picked(df, fid, geometry).where("wkb IS NOT NULL AND fid IS NOT NULL AND octet_length(wkb) > 9").mapInArrow(run, "poly_id long, ring int, seq int, x double, y double")


def input_report(df: DataFrame, fid: str = "fid", geometry: str = "wkb") -> DataFrame:
    """One row: n_features, n_skipped (no id, or no ring with an area) and n_invalid_input of the others."""

    @F.pandas_udf("int")
    def state(column):
        def one(b):
            if b is None or len(b) <= 9 or not _rings(bytes(b)):
                return 0
            return 2 if G.is_valid(wkb.polygons(bytes(b))) else 1

        return column.map(one)

    found = _picked(df, fid, geometry).select("fid", state("wkb").alias("s"))
    skipped = F.col("fid").isNull() | (F.col("s") == 0)
    return found.agg(F.count("*").alias("n_features"), F.count_if(skipped).alias("n_skipped"), F.count_if(~skipped & (F.col("s") == 1)).alias("n_invalid_input"))


def content_signature(df: DataFrame, *columns: str) -> str:
    """What tells one input from another: the number of rows and the sum of their hashes, whatever their order."""
    n, h = df.agg(F.count("*"), F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in columns]).cast("decimal(38,0)"))).first()
    return f"{n}:{h}"


def valid_polygons(df: DataFrame, geometry: str = "wkb") -> DataFrame:
    """``df`` with ``valid``; geometries can't be mended here, so invalid ones are for the caller to reject."""

    @F.pandas_udf("boolean")
    def check(column):
        return column.map(lambda b: b is not None and G.is_valid(wkb.polygons(bytes(b))))

    return df.withColumn("valid", check(F.col(geometry)))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """A feature table; by extension Parquet or GeoJSON lines (one feature a line)."""
    kind = os.path.splitext(path)[1].lower()
    if kind == ".parquet":
        return spark.read.parquet(path)
    if kind in (".json", ".geojson"):
        return spark.read.json(path)
    raise ValueError(f"unknown vector format {kind!r}")


def write_features(df: DataFrame, path: str, multi: bool = False, geometry: str = "wkb", order: list[str] | None = None) -> None:
    """Polygons as Parquet, or as GeoJSON lines; without ``multi`` parts are rows of their own, with the attributes.
    order: columns by which the rows are sorted, over all files."""
    kind = os.path.splitext(path)[1].lower()
    out = df if multi else explode_parts(df, geometry)
    out = out.orderBy(*order) if order else out
    if kind == ".parquet":
        out.write.mode("overwrite").parquet(path)
    elif kind in (".json", ".geojson"):
        shape = F.pandas_udf(lambda c: c.map(lambda b: None if b is None else _geojson(bytes(b))), "string")
        attributes = F.struct(*[c for c in out.columns if c != geometry])
        line = F.concat(F.lit('{"type":"Feature","properties":'), F.to_json(attributes), F.lit(',"geometry":'), F.coalesce(shape(geometry), F.lit("null")), F.lit("}"))
        out.select(line.alias("value")).write.mode("overwrite").text(path)
    else:
        raise ValueError(f"unknown vector format {kind!r}; .parquet, .json and .geojson can be written")


def _geojson(data: bytes) -> str:
    import json

    parts = [[np.vstack([r, r[:1]]).tolist() if (r[0] != r[-1]).any() else r.tolist() for r in p] for p in wkb.polygons(data)]
    return json.dumps({"type": "Polygon", "coordinates": parts[0]} if len(parts) == 1 else {"type": "MultiPolygon", "coordinates": parts})


def explode_parts(df: DataFrame, geometry: str = "wkb") -> DataFrame:
    """A row for each part, with the attributes repeated; a null geometry stays one row."""
    split = F.pandas_udf(lambda c: c.map(lambda b: [None] if b is None else [wkb.from_polygons([p]) for p in wkb.polygons(bytes(b))]), "array<binary>")
    names = df.columns
    return df.withColumn("_parts", split(geometry)).withColumn(geometry, F.explode("_parts")).select(*names)


def guard_temporary(df: DataFrame, temporary: bool, limit: int = LARGE_POLYGONS) -> None:
    """Refuses a temporary place for a large result."""
    if temporary and df.limit(limit).count() >= limit:
        raise ValueError(f"a result of {limit} rows or more needs a place that stays")


def work_folder(output: str) -> str | None:
    """/a/Forest.parquet to /a/Forest; none for names that aren't files."""
    if "|" in output or ":" in output.split("/")[0] and "://" not in output:
        return None
    root, kind = os.path.splitext(output)
    return root if kind else None


def read_tune(spark: SparkSession, path: str) -> DataFrame:
    """Runs of tools (dataset, tool, param, seconds, mIoU, OA) from CSV; ``seconds`` is null for a failed run."""
    rows = spark.read.csv(path, header=True, schema="dataset string, tool string, param string, seconds string, mIoU double, OA double")
    return rows.withColumn("seconds", F.expr("try_cast(seconds AS double)"))


def write_best(best: DataFrame, path: str) -> None:
    """The best rows as JSON lines, in order."""
    best.orderBy(*best.columns).coalesce(1).write.mode("overwrite").json(path)


def ids_from_json(df: DataFrame, column: str, name: str = "id") -> DataFrame:
    """A row for each id of a JSON list."""
    return df.withColumn(name, F.explode(F.from_json(F.col(column), "array<long>")))
