"""Nearest neighbours on the sphere without a tree: cubes of chord space.

Points are dealt into cubes of side h.  All points within a chord h of a target lie in the 27
cubes around it, so a target whose k-th candidate is nearer than h is settled; the rest
go to the next pass with h doubled.  Each pass is an equi-join on the cube.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zonalis.functions import healpix as hp
from zonalis.sources.stage import stored


def _placed(points: DataFrame, names: list[str]) -> DataFrame:
    """Points with unit vectors ``names`` from lon and lat."""
    return points.withColumns(dict(zip(names, hp.unit_vector(F.col("lon"), F.col("lat")), strict=True)))


def nearest(sources: DataFrame, targets: DataFrame, k: int = 1, by: list[str] | None = None, start: float | None = None) -> DataFrame:
    """(by, target, cell, d2, rank) of the k nearest sources of each target; ties go to the least cell.

    ``sources`` has by, cell, lon, lat and ``targets`` by, target, lon, lat in degrees.  Targets
    of a group without sources are left out; groups with fewer than k sources give all they have.
    Rows without a position are left out.  Every group has cubes of its own size, as its density asks for,
    and every pass is kept in the shared folder.
    """
    by = by or []
    own = _placed(sources, ["sx", "sy", "sz"]).select(*by, "cell", "sx", "sy", "sz").dropna(subset=["sx", "sy", "sz"])
    left = _placed(targets, ["tx", "ty", "tz"]).select(*by, "target", "tx", "ty", "tz").dropna(subset=["tx", "ty", "tz"])
    # Cubes of which the sources around a target hold some tens of k.
    side = F.lit(float(start)) if start else F.least(F.lit(2.0), 4.0 * F.sqrt(F.lit(k) / F.col("held")))
    counts = own.groupBy(*by).agg(F.count("*").alias("held")).filter("held > 0").withColumn("h", side)
    sized = (lambda df: df.join(counts, by)) if by else (lambda df: df.join(F.broadcast(counts)))  # one row of counts
    own, left = sized(own).drop("held"), sized(left)
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(l).alias("l")) for i in (-1, 0, 1) for j in (-1, 0, 1) for l in (-1, 0, 1)])
    d2 = hp.chord2((F.col("sx"), F.col("sy"), F.col("sz")), (F.col("tx"), F.col("ty"), F.col("tz")))
    target = W.partitionBy(*by, "target")
    found, wider = None, 1.0
    while True:
        h = F.least(F.lit(2.0), F.col("h") * wider)
        cube = lambda c: F.floor(F.col(c) / h).cast("int")  # noqa: B023, E731
        cubes = own.withColumns({"qx": cube("sx"), "qy": cube("sy"), "qz": cube("sz")}).drop("h")
        spread = left.withColumn("o", F.explode(around)).withColumns({"qx": cube("tx") + F.col("o.i"), "qy": cube("ty") + F.col("o.j"), "qz": cube("tz") + F.col("o.l")})
        ranked = spread.join(cubes, [*by, "qx", "qy", "qz"]).withColumn("d2", d2).withColumn("rank", F.row_number().over(target.orderBy("d2", "cell"))).filter(F.col("rank") <= k)
        # Settled: as many as can be had, all inside the guard distance; cubes of side 2 hold the sphere.
        full = F.count("*").over(target) >= F.least(F.lit(k), F.col("held"))
        ok = (h >= 2.0) | (full & (F.max("d2").over(target) <= h * h))
        settled = stored(ranked.withColumn("ok", ok).filter("ok").select(*by, "target", "cell", "d2", "rank"))
        found = settled if found is None else found.union(settled)
        left = stored(left.join(settled.select(*by, "target").distinct(), [*by, "target"], "left_anti"))
        if left.isEmpty():
            return found
        wider *= 2
