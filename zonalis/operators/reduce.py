"""Reductions: zonal means, weighted and plain means, circular means, percentiles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonalis.functions import healpix as hp


def no_nan(c: str | Column) -> Column:
    """NaN as null, so that aggregates leave it out."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c), c)


def zonal_mean(field: DataFrame, nside: int, keys: list[str], values: list[str], cell: str = "cell") -> DataFrame:
    """Mean of every ring of RING cells: keys, ring, lat and the means; an empty ring's mean is null."""
    ring = hp.ring_of(F.col(cell), nside)
    means = field.groupBy(*keys, ring.alias("ring")).agg(*[F.avg(v).alias(v) for v in values])
    return means.select(*keys, "ring", F.degrees(F.asin(hp.ring_z(F.col("ring"), nside))).alias("lat"), *values)


def band_count(cells: int) -> int:
    """Bands of an unstructured grid: as many as a like HEALPix grid has rings, 180 at least."""
    return max(180, 4 * round(math.sqrt(cells / 12)))


def band_zonal_mean(points: DataFrame, bands: int, keys: list[str], values: list[str], lat: str = "lat") -> DataFrame:
    """Mean of each of ``bands`` latitude bands of equal width, labelled by its centre."""
    width = 180.0 / bands
    band = F.least(F.greatest(F.floor((F.col(lat) + 90.0) / width).cast("long"), F.lit(0)), F.lit(bands - 1))
    means = points.groupBy(*keys, band.alias("band")).agg(*[F.avg(v).alias(v) for v in values])
    return means.select(*keys, "band", (-90.0 + (F.col("band") + 0.5) * width).alias("lat"), *values)


def weighted_mean(field: DataFrame, keys: list[str], values: list[str], weight: Column) -> DataFrame:
    """Mean with weights of the rows where a value is present."""
    means = [F.try_divide(F.sum(F.col(v) * weight), F.sum(F.when(F.col(v).isNotNull(), weight))).alias(v) for v in values]
    return field.groupBy(*keys).agg(*means) if keys else field.agg(*means)


def coslat_mean(field: DataFrame, keys: list[str], values: list[str], lat: str = "lat") -> DataFrame:
    return weighted_mean(field, keys, values, F.cos(F.radians(lat)))


def plain_mean(field: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Mean over everything but ``keys``: longitudes of a regular grid, times, further dimensions."""
    return field.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values])


def circular_mean(field: DataFrame, keys: list[str], phase: str, amplitude: str) -> DataFrame:
    """Mean phase with the amplitude as weight, and the mean amplitude."""
    s, c = F.avg(F.col(amplitude) * F.sin(phase)), F.avg(F.col(amplitude) * F.cos(phase))
    return field.groupBy(*keys).agg(F.atan2(s, c).alias(phase), F.avg(amplitude).alias(amplitude))


def bin_swath(samples: DataFrame, nside: int, value: str, *, z: Column, t: Column, level: str, missing: float = -999.0, bins: int | None = None, hours: Column | None = None) -> DataFrame:
    """Mean of valid samples in every (level, cell) and, with ``bins``, part of the day.

    Samples without position, or whose value is missing, NaN or infinite, are left out.
    """
    v = F.col(value)
    valid = v.isNotNull() & ~F.isnan(v) & (v != missing) & (F.abs(v) != float("inf")) & z.isNotNull() & t.isNotNull() & (F.abs(z) <= 1)
    keys = [F.col(level).alias("level"), hp.pixel(z, t, nside).alias("cell")]
    if bins:
        part = F.floor(F.pmod(hours, F.lit(24.0)) / 24.0 * bins).cast("long")
        keys.append(F.least(F.greatest(part, F.lit(0)), F.lit(bins - 1)).alias("ut"))
    return samples.filter(valid).groupBy(*keys).agg(F.avg(value).alias(value), F.count("*").alias("samples"))


def spread(field: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Least, greatest, median and 97th percentile of a value."""
    return field.groupBy(*keys).agg(F.min(value).alias("least"), F.max(value).alias("greatest"), F.percentile(value, 0.5).alias("median"), F.percentile(value, 0.97).alias("p97"))
