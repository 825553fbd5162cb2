"""Zonal means and swath bins of a stream of observations (an addition: batch engines of this kind have none)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonalis.functions import healpix as hp


def watch(spark: SparkSession, path: str, schema, per_trigger: int = 64) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def windowed_bins(stream: DataFrame, nside: int, value: str, *, time: str, z: Column, t: Column, window: str = "1 day", late: str = "6 hours") -> DataFrame:
    """Mean and count of every cell in tumbling windows of event time; state ends with the watermark."""
    rows = stream.withWatermark(time, late).filter(F.col(value).isNotNull() & ~F.isnan(value))
    bins = rows.groupBy(F.window(time, window).alias("w"), hp.pixel(z, t, nside).alias("cell")).agg(F.avg(value).alias(value), F.count("*").alias("samples"))
    return bins.select(F.col("w.start").alias("time"), "cell", value, "samples")


def windowed_zonal_means(stream: DataFrame, nside: int, value: str, *, time: str, z: Column, t: Column, window: str = "1 day", late: str = "6 hours") -> DataFrame:
    """The same for rings."""
    rows = stream.withWatermark(time, late).filter(F.col(value).isNotNull() & ~F.isnan(value))
    bins = rows.groupBy(F.window(time, window).alias("w"), hp.ring_at(z, t, nside).alias("ring")).agg(F.avg(value).alias(value), F.count("*").alias("samples"))
    return bins.select(F.col("w.start").alias("time"), "ring", value, "samples")


def run_available(df: DataFrame, path: str, checkpoint: str) -> None:
    """Process what has arrived, append it to ``path`` and stop."""
    query = df.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
