"""One way onto the HEALPix grid from whatever a table holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonalis.functions import healpix as hp
from zonalis.operators import grid, regrid


def flatten_curvilinear(field: DataFrame, y: str = "y", x: str = "x") -> DataFrame:
    """A grid with two-dimensional coordinates as an unstructured one: the cell is row-major in (y, x)."""
    width = field.agg(F.max(x).alias("_width"))
    cell = (F.col(y) * (F.col("_width") + 1) + F.col(x)).cast("long")
    return field.join(F.broadcast(width)).withColumn("cell", cell).drop("_width", y, x)  # one row


class HealpixInterpolator:
    """Weights found once from a source grid, applied to any number of its fields.

    A table with ``cell`` but without coordinates is a HEALPix field (``source_nside`` and
    ``source_order`` say which); with ``cell``, ``lon`` and ``lat`` it is unstructured, with ``y`` and ``x`` curvilinear, and
    with only ``lat`` and ``lon`` regular.  Coordinates in radians are turned to degrees.
    """

    def __init__(self, nside: int | None = None, order: str = "ring", k: int = 3, radius: float = regrid.RADIUS, source_nside: int | None = None, source_order: str = "ring"):
        self.nside, self.order, self.k, self.radius = nside, order, k, radius
        self.source_nside, self.source_order = source_nside, source_order
        self.kind: str | None = None
        self.weights: DataFrame | None = None

    def setup(self, source: DataFrame, radians: bool = False) -> HealpixInterpolator:
        columns = set(source.columns)
        if "cell" in columns and not {"lon", "lat"} <= columns:
            self.kind = "healpix"
            self.source_nside = self.source_nside or hp.nside_for(source.agg(F.max("cell")).first()[0] + 1)
            self.nside = self.nside or self.source_nside
            return self
        self.kind = "unstructured" if "cell" in columns else "curvilinear" if {"x", "y"} <= columns else "regular"
        placed = self._placed(source, radians)
        points = placed.select("lon", "lat", *(["cell"] if "cell" in placed.columns else [])).distinct()
        self.nside = self.nside or hp.nside_for(points.count())
        if self.kind != "regular":
            targets = grid.grid(source.sparkSession, self.nside).select(F.col("cell_ring").alias("target"), "lon", "lat")
            self.weights = regrid.idw_weights(points, targets, self.k, self.radius).cache()
        self.radians = radians
        return self

    def _placed(self, source: DataFrame, radians: bool) -> DataFrame:
        out = flatten_curvilinear(source) if self.kind == "curvilinear" else source
        return out.withColumns({"lon": F.degrees("lon"), "lat": F.degrees("lat")}) if radians else out

    def __call__(self, field: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
        if self.kind is None:
            self.setup(field)
        if self.kind == "healpix":
            return self._from_healpix(field, keys, values)
        own = self._placed(field, self.radians)
        if self.kind == "regular":
            targets = grid.grid(field.sparkSession, self.nside).select(F.col("cell_ring").alias("target"), "lon", "lat")
            out = regrid.bilinear_regular(own, targets, keys, values)
        else:
            out = regrid.apply_weights(own, self.weights, keys, values)
        out = out.withColumnRenamed("target", "cell")
        return grid.reorder(out, self.nside, "nest") if self.order == "nested" else out

    def _from_healpix(self, field: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
        """The field itself, in another order, or in another resolution; the order asked for is kept."""
        same = self.source_nside == self.nside
        if same and self.source_order == self.order:
            return field
        nested = field if self.source_order == "nested" else grid.reorder(field, self.source_nside, "nest")
        out = nested if same else grid.regrade(nested, self.source_nside, self.nside, keys, values, order="nested")
        return out if self.order == "nested" else grid.reorder(out, self.nside, "ring")


def interpolate_to_healpix(field: DataFrame, keys: list[str], values: list[str], nside: int | None = None, order: str = "ring") -> DataFrame:
    return HealpixInterpolator(nside, order).setup(field)(field, keys, values)
