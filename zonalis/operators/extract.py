"""Extraction of points, parallels and meridians, and simple selections."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonalis.functions import healpix as hp
from zonalis.operators.neighbours import nearest
from zonalis.operators.regrid import apply_weights, bilinear_weights


def point(field: DataFrame, nside: int, lat: float, lon: float, cell: str = "cell") -> DataFrame:
    """The pixel that holds (lat, lon), not interpolated, with the coordinates asked for.

    The index is a constant, so the filter reaches the scan.
    """
    z, t = math.sin(math.radians(lat)), lon / 90.0
    index = field.sparkSession.range(1).select(hp.pixel(F.lit(z), F.lit(t), nside)).first()[0]
    return field.filter(F.col(cell) == index).drop(cell).withColumns({"lat": F.lit(lat), "lon": F.lit(lon)})


def nearest_cell(field: DataFrame, points: DataFrame, lat: float, lon: float) -> DataFrame:
    """The rows of the unstructured cell nearest to (lat, lon); the least cell of a tie."""
    d2 = hp.chord2(hp.unit_vector(F.col("lon"), F.col("lat")), hp.unit_vector(F.lit(lon), F.lit(lat)))
    best = points.agg(F.min_by("cell", F.struct(d2, F.col("cell"))).alias("cell"))
    return field.join(F.broadcast(best), "cell", "left_semi")  # one row


def parallel_targets(spark: SparkSession, nside: int, lat: float, count: int | None = None) -> DataFrame:
    """Targets along a parallel, from longitude 0 eastwards; 4 * nside unless ``count`` is given."""
    n = count or 4 * nside
    return spark.range(n).select(F.col("id").alias("target"), (F.col("id") * (360.0 / n)).alias("lon"), F.lit(float(lat)).alias("lat"))


def meridian_targets(spark: SparkSession, nside: int, lon: float, count: int | None = None) -> DataFrame:
    n = count or 4 * nside
    return spark.range(n).select(F.col("id").alias("target"), F.lit(float(lon)).alias("lon"), (-90.0 + F.col("id") * (180.0 / (n - 1))).alias("lat"))


def along(field: DataFrame, targets: DataFrame, nside: int, keys: list[str], values: list[str]) -> DataFrame:
    """Bilinear values at the targets, with their coordinates."""
    return apply_weights(field, bilinear_weights(targets, nside), keys, values).join(targets, "target")


def meridian_nearest(points: DataFrame, lon: float, cells: int, count: int | None = None) -> DataFrame:
    """(target, lat, cell): the nearest cell for each latitude along a meridian of an unstructured grid.

    Cells within max(5 degrees, 720 / sqrt(cells)) of the meridian are candidates, all if there are none.
    """
    n = count or max(180, 4 * round(math.sqrt(cells / 12)))
    band = max(5.0, 720.0 / math.sqrt(cells))
    apart = F.abs(F.pmod(F.col("lon") - lon + 180.0, F.lit(360.0)) - 180.0)
    chosen = points.filter(apart <= band)
    targets = points.sparkSession.range(n).select(F.col("id").alias("target"), (-90.0 + F.col("id") * (180.0 / (n - 1))).alias("tlat"))
    if chosen.isEmpty():
        found = nearest(points, targets.select("target", F.lit(float(lon)).alias("lon"), F.col("tlat").alias("lat")))
        return found.join(targets, "target").select("target", F.col("tlat").alias("lat"), "cell")
    d2 = hp.chord2(hp.unit_vector(F.col("lon"), F.col("lat")), hp.unit_vector(F.lit(lon), F.col("tlat")))
    # The band narrows as the targets grow in number, so there are some five pairs for each cell of the grid.
    met = chosen.join(F.broadcast(targets), F.lit(True))
    return met.groupBy("target", "tlat").agg(F.min_by("cell", F.struct(d2, F.col("cell"))).alias("cell")).select("target", F.col("tlat").alias("lat"), "cell")


def nearest_levels(field: DataFrame, level: str, wanted: list[float]) -> DataFrame:
    """The rows of the levels nearest to those wanted; each level once, the lower one of a tie."""
    levels = field.select(level).distinct()
    best = levels.agg(*[F.min_by(level, F.struct(F.abs(F.col(level) - w), F.col(level))).alias(f"l{i}") for i, w in enumerate(wanted)])
    chosen = best.select(F.explode(F.array_distinct(F.array(*best.columns))).alias(level))
    return field.join(F.broadcast(chosen), level, "left_semi")  # as many rows as levels wanted


def between(field: DataFrame, column: str, low: float, high: float) -> DataFrame:
    return field.filter(F.col(column).between(low, high))


def drop_empty_levels(field: DataFrame, level: str, value: str) -> DataFrame:
    """Leave out the levels where ``value`` is nowhere present."""
    full = field.groupBy(level).agg(F.count(value).alias("n")).filter("n > 0").select(level)
    return field.join(full, level, "left_semi")
