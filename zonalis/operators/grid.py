"""The grid dimension table, and changes of order and resolution."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonalis.functions import healpix as hp


def grid(spark: SparkSession, nside: int) -> DataFrame:
    """cell_ring, cell_nest, ring, ring_size, z, lat, lon, mirror of all 12 nside**2 cells.

    Rows come from (face, x, y), so both indices are computed forward.
    """
    n = nside
    rows = spark.range(hp.npix(n)).select((F.col("id") / (n * n)).cast("int").alias("face"), (F.floor(F.col("id") / n) % n).cast("long").alias("y"), (F.col("id") % n).alias("x"))
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("face") + 1)
    rows = rows.withColumn("ring", (pick(hp.FACE_ROW) * n - F.col("x") - F.col("y") - 1).cast("long"))
    quarter = F.least("ring", 4 * n - F.col("ring"), F.lit(n))
    belt = (F.col("ring") >= n) & (F.col("ring") <= 3 * n)
    rows = rows.withColumns({"quarter": quarter, "shift": F.when(belt, F.pmod(F.col("ring") - n, F.lit(2))).otherwise(0)})
    place = F.floor((pick(hp.FACE_TURN) * F.col("quarter") + F.col("x") - F.col("y") + 1 + F.col("shift")) / 2).cast("long") - 1
    rows = rows.withColumn("place", F.pmod(place, 4 * F.col("quarter")))
    start = hp.ring_start(F.col("ring"), n)
    nest = F.col("face").cast("long") * (n * n) + hp.spread_bits(F.col("x"), n) + 2 * hp.spread_bits(F.col("y"), n)
    z = hp.ring_z(F.col("ring"), n)
    lon = (F.col("place") + F.when(F.col("shift") == 1, 0.0).otherwise(0.5)) / F.col("quarter") * 90.0
    return rows.select(
        (start + F.col("place")).alias("cell_ring"), nest.alias("cell_nest"), F.col("ring"), (4 * F.col("quarter")).alias("ring_size"),
        z.alias("z"), F.degrees(F.asin(z)).alias("lat"), lon.alias("lon"), (hp.ring_start(4 * n - F.col("ring"), n) + F.col("place")).alias("mirror"),
    )


def small(df: DataFrame, rows: int, limit: int = 1_000_000) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``limit`` narrow rows; otherwise the planner decides."""
    return F.broadcast(df) if rows <= limit else df


def reorder(field: DataFrame, nside: int, to: str, cell: str = "cell") -> DataFrame:
    """Change the cell index between RING and NESTED."""
    own, new = ("cell_nest", "cell_ring") if to == "ring" else ("cell_ring", "cell_nest")
    table = small(grid(field.sparkSession, nside).select(F.col(own).alias(cell), F.col(new).alias("_new")), hp.npix(nside))
    rest = [c for c in field.columns if c != cell]
    return field.join(table, cell).select(F.col("_new").alias(cell), *rest)


def regrade_down(field: DataFrame, nside: int, to: int, keys: list[str], values: list[str], cell: str = "cell") -> DataFrame:
    """NESTED cells averaged into their ancestors; missing children are left out."""
    up = (nside // to).bit_length() - 1
    return field.groupBy(*keys, hp.parent(F.col(cell), up).alias(cell)).agg(*[F.avg(v).alias(v) for v in values])


def regrade_up(field: DataFrame, nside: int, to: int, cell: str = "cell") -> DataFrame:
    """NESTED cells copied to their descendants."""
    down = (to // nside).bit_length() - 1
    first = F.shiftleft(F.col(cell), 2 * down)
    rest = [c for c in field.columns if c != cell]
    return field.select(*rest, F.explode(F.sequence(first, first + (4**down - 1))).alias(cell))


def regrade(field: DataFrame, nside: int, to: int, keys: list[str], values: list[str], order: str = "ring", cell: str = "cell") -> DataFrame:
    """Change the resolution of a field in either order; the result keeps the order."""
    if nside == to:
        return field
    nested = reorder(field, nside, "nest", cell) if order == "ring" else field
    out = regrade_down(nested, nside, to, keys, values, cell) if to < nside else regrade_up(nested, nside, to, cell)
    return reorder(out, to, "ring", cell) if order == "ring" else out


def all_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, columns)
