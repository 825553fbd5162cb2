"""Regridding: weights are built once and applied to many fields by a join and a sum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zonalis.functions import healpix as hp
from zonalis.operators.neighbours import nearest
from zonalis.sources.stage import stored

#: A target farther than this chord from its nearest source stays empty.
RADIUS = 0.05


def idw_weights(sources: DataFrame, targets: DataFrame, k: int = 3, radius: float = RADIUS) -> DataFrame:
    """(target, cell, w): inverse squared chords of the k nearest sources, adding up to one."""
    near = nearest(sources, targets, k)
    own = W.partitionBy("target")
    raw = near.withColumn("raw", 1.0 / F.pow(F.greatest(F.sqrt("d2"), F.lit(1e-12)), 2))
    kept = raw.withColumns({"w": F.col("raw") / F.sum("raw").over(own), "first": F.min("d2").over(own)})
    return kept.filter(F.sqrt("first") < radius).select("target", "cell", "w")


def apply_weights(field: DataFrame, weights: DataFrame, keys: list[str], values: list[str], strict: bool = True) -> DataFrame:
    """Weighted sums per target; with ``strict`` a missing source makes the target missing."""
    need = weights.withColumn("need", F.count("*").over(W.partitionBy("target")))
    joined = field.join(need, "cell")
    sums = []
    for v in values:
        total = F.sum(F.col(v) * F.col("w"))
        sums.append((F.when(F.count(v) == F.first("need"), total) if strict else F.try_divide(total, F.sum(F.when(F.col(v).isNotNull(), F.col("w"))))).alias(v))
    return joined.groupBy(*keys, "target").agg(*sums)


def bilinear_weights(targets: DataFrame, nside: int) -> DataFrame:
    """(target, cell, w) on the RING grid for targets (target, lon, lat).

    Two neighbours on each of the rings above and below, linear in longitude along
    a ring and in colatitude between rings; a pole has the mean of its four pixels.
    """
    n = nside
    z, theta, turn = F.sin(F.radians("lat")), F.radians(90.0 - F.col("lat")), F.pmod(F.col("lon"), F.lit(360.0)) / 90.0
    polar = lambda h: F.floor(n * F.sqrt(3 * (1 - h))).cast("long")
    above = F.when(z > 2 / 3, polar(z)).when(z < -2 / 3, 4 * n - polar(-z) - 1).otherwise(F.floor(n * (2 - 1.5 * z)).cast("long"))
    rows = targets.select("target", z.alias("z"), theta.alias("theta"), turn.alias("turn"), above.alias("above"))
    colat = lambda r: F.when(r == 0, 0.0).when(r == 4 * n, F.lit(3.141592653589793)).otherwise(F.acos(hp.ring_z(r, n)))
    rows = rows.withColumns({"t0": colat(F.col("above")), "t1": colat(F.col("above") + 1)})
    low = (F.col("theta") - F.col("t0")) / (F.col("t1") - F.col("t0"))
    rows = rows.withColumn("low", F.least(F.greatest(low, F.lit(0.0)), F.lit(1.0)))
    parts = F.array(F.struct(F.col("above").alias("ring"), (1 - F.col("low")).alias("share")), F.struct((F.col("above") + 1).alias("ring"), F.col("low").alias("share")))
    rows = rows.withColumn("part", F.explode(parts)).select("target", "turn", "part.*")
    pole = F.col("ring").isin(0, 4 * n)
    ring = F.when(F.col("ring") == 0, 1).when(F.col("ring") == 4 * n, 4 * n - 1).otherwise(F.col("ring")).cast("long")
    quarter = hp.ring_size(ring, n) / 4
    shift = F.when((ring >= n) & (ring <= 3 * n) & (F.pmod(ring + n, F.lit(2)) == 1), 0.0).otherwise(0.5)
    place = F.col("turn") * quarter - shift
    first, size, start = F.floor(place).cast("long"), hp.ring_size(ring, n), hp.ring_start(ring, n)
    right = place - F.floor(place)
    at = lambda i: start + F.pmod(i, size)
    cell = lambda c, w: F.struct(c.cast("long").alias("cell"), w.cast("double").alias("w"))
    corners = F.array(*[cell(start + i, F.col("share") / 4) for i in range(4)])
    pair = F.array(cell(at(first), F.col("share") * (1 - right)), cell(at(first + 1), F.col("share") * right))
    out = rows.select("target", F.explode(F.when(pole, corners).otherwise(pair)).alias("c"))
    return out.groupBy("target", "c.cell").agg(F.sum("c.w").alias("w"))


def _axis_brackets(axis: DataFrame, name: str, period: float | None = None) -> DataFrame:
    """(lo, hi) of neighbouring values of an axis; a periodic one has a bracket across its seam."""
    own = axis.select(F.col(name).cast("double").alias("lo")).distinct()
    order = W.orderBy("lo")  # the distinct values of one axis
    pairs = own.withColumns({"hi": F.lead("lo").over(order), "first": F.min("lo").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))})
    high = F.coalesce("hi", F.col("first") + period) if period else F.col("hi")
    return pairs.select("lo", high.alias("hi"), F.col("hi").isNull().alias("seam")).filter("hi is not null")


def _dealt(brackets: DataFrame, extent: DataFrame, name: str) -> DataFrame:
    """Brackets in every bin they touch: bins as wide as a bracket is on average, so twice as many rows at most."""
    at = lambda c: F.floor((F.col(c) - F.col(f"{name}_0")) / F.col(f"{name}_step"))
    return brackets.join(F.broadcast(extent)).withColumn(f"{name}_bin", F.explode(F.sequence(at("lo"), at("hi")))).select("lo", "hi", "seam", f"{name}_bin")  # one row of extents


def bilinear_regular(field: DataFrame, targets: DataFrame, keys: list[str], values: list[str], period: float = 360.0) -> DataFrame:
    """Bilinear interpolation from a regular (lat, lon) grid to targets (target, lon, lat).

    Longitudes wrap, latitudes outside the grid give no row, a missing corner of non-zero weight gives null.
    A target meets the brackets of its bin of each axis by an equi-join.
    """
    # Both axes in one pass over the field.
    value = lambda n: F.struct(F.lit(n).alias("axis"), F.col(n).cast("double").alias("x"))
    axes = stored(field.select(F.explode(F.array(value("lat"), value("lon"))).alias("a")).select("a.*").distinct())
    lats, lons = (_axis_brackets(axes.filter(F.col("axis") == n).withColumnRenamed("x", n), n, p) for n, p in (("lat", None), ("lon", period)))
    extents = {}
    for name, axis in (("lat", lats), ("lon", lons)):
        low, high = F.min("lo"), F.max("hi")
        extents[name] = axis.agg(low.alias(f"{name}_0"), high.alias(f"{name}_1"), F.try_divide(high - low, F.count("*")).alias(f"{name}_step"))
    t = targets.join(F.broadcast(extents["lat"].join(extents["lon"])))  # one row of extents
    turned = F.pmod(F.col("lon") - F.col("lon_0"), F.lit(period))
    t = t.withColumn("tlon", F.col("lon_0") + F.when(turned < period, turned).otherwise(0.0))
    bins = {f"{n}_bin": F.floor((F.col(c) - F.col(f"{n}_0")) / F.col(f"{n}_step")) for n, c in (("lat", "lat"), ("lon", "tlon"))}
    t = t.withColumns(bins).withColumnsRenamed({"lon_0": "west", "lat_1": "top"}).select("target", "lat", "tlon", "west", "top", *bins)
    # Axes of a grid: as many rows as it has parallels or meridians, so these may be broadcast.
    la, lo = _dealt(lats, extents["lat"], "lat").alias("la"), _dealt(lons, extents["lon"], "lon").alias("lo")
    in_lat = (F.col("lat") >= F.col("la.lo")) & ((F.col("lat") < F.col("la.hi")) | (F.col("lat") == F.col("top")) & (F.col("la.hi") == F.col("top")))
    in_lon = (F.col("tlon") >= F.col("lo.lo")) & (F.col("tlon") < F.col("lo.hi"))
    t = t.alias("t")
    b = t.join(F.broadcast(la), (F.col("t.lat_bin") == F.col("la.lat_bin")) & in_lat).join(F.broadcast(lo), (F.col("t.lon_bin") == F.col("lo.lon_bin")) & in_lon)
    wy = (F.col("lat") - F.col("la.lo")) / (F.col("la.hi") - F.col("la.lo"))
    wx = (F.col("tlon") - F.col("lo.lo")) / (F.col("lo.hi") - F.col("lo.lo"))
    east = F.when(F.col("lo.seam"), F.col("west")).otherwise(F.col("lo.hi"))
    corner = lambda la_, lo_, w: F.struct(la_.alias("lat"), lo_.alias("lon"), w.alias("w"))
    corners = F.array(corner(F.col("la.lo"), F.col("lo.lo"), (1 - wy) * (1 - wx)), corner(F.col("la.lo"), east, (1 - wy) * wx), corner(F.col("la.hi"), F.col("lo.lo"), wy * (1 - wx)), corner(F.col("la.hi"), east, wy * wx))
    weights = b.select("target", F.explode(corners).alias("c")).select("target", F.col("c.lat").alias("lat"), F.col("c.lon").alias("lon"), "c.w")
    joined = field.withColumns({"lat": F.col("lat").cast("double"), "lon": F.col("lon").cast("double")}).join(weights, ["lat", "lon"]).filter("w > 0")
    return joined.groupBy(*keys, "target").agg(*[F.when(F.count(v) == F.count("*"), F.sum(F.col(v) * F.col("w"))).alias(v) for v in values])


def gaps(field: DataFrame, points: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Missing cells of every slice take the value of the nearest cell that has one; empty slices stay."""
    placed = field.join(points, "cell")
    holes = placed.filter(F.col(value).isNull()).select(*keys, F.col("cell").alias("target"), "lon", "lat")
    have = placed.filter(F.col(value).isNotNull()).select(*keys, "cell", "lon", "lat")
    near = nearest(have, holes, 1, keys).select(*keys, "target", F.col("cell").alias("from"))
    values = field.select(*keys, F.col("cell").alias("from"), F.col(value).alias("filled"))
    fill = near.join(values, [*keys, "from"]).select(*keys, F.col("target").alias("cell"), "filled")
    return field.join(fill, [*keys, "cell"], "left").withColumn(value, F.coalesce(value, "filled")).drop("filled")


def time_gaps(field: DataFrame, time: str, keys: list[str], value: str) -> DataFrame:
    """Missing times are filled linearly by rank between neighbours, and by the nearest at the ends."""
    by = W.partitionBy(*keys).orderBy(time)
    rows = field.withColumn("i", F.row_number().over(by))
    back, ahead = by.rowsBetween(W.unboundedPreceding, 0), by.rowsBetween(0, W.unboundedFollowing)
    seen = F.when(F.col(value).isNotNull(), F.struct(F.col("i"), F.col(value).alias("v")))
    rows = rows.withColumns({"a": F.last(seen, True).over(back), "b": F.first(seen, True).over(ahead)})
    inside = F.col("a.v") + (F.col("b.v") - F.col("a.v")) * F.try_divide(F.col("i") - F.col("a.i"), (F.col("b.i") - F.col("a.i")))
    return rows.withColumn(value, F.coalesce(value, inside, "a.v", "b.v")).drop("i", "a", "b")


def interpolate_axis(field: DataFrame, axis: str, keys: list[str], values: list[str], targets: list[float], coordinate: Column | None = None, extrapolate: bool = True) -> DataFrame:
    """Linear interpolation of every profile to ``targets`` along ``coordinate`` (by default the axis itself).

    A profile is one array of as many entries as there are levels.  Outside, the first or
    last two entries are extended, or nothing is given without ``extrapolate``.
    """
    at = F.col(axis).cast("double") if coordinate is None else coordinate
    point = F.struct(at.alias("x"), *[F.col(v).cast("double").alias(v) for v in values])
    profile = field.filter(at.isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_list(point)).alias("p")).filter(F.size("p") > 1)
    rows = profile.select(*keys, "p", F.explode(F.array(*[F.lit(float(t)) for t in targets])).alias("target"))
    below = F.size(F.filter("p", lambda e: e["x"] <= F.col("target")))
    rows = rows.withColumn("k", F.least(F.greatest(below, F.lit(1)), F.size("p") - 1))
    rows = rows.withColumns({"lo": F.element_at("p", F.col("k")), "hi": F.element_at("p", F.col("k") + 1)})
    if not extrapolate:
        rows = rows.filter((F.col("target") >= F.element_at("p", 1)["x"]) & (F.col("target") <= F.element_at("p", -1)["x"]))
    part = F.try_divide(F.col("target") - F.col("lo.x"), F.col("hi.x") - F.col("lo.x"))
    linear = [(F.col(f"lo.{v}") + part * (F.col(f"hi.{v}") - F.col(f"lo.{v}"))).alias(v) for v in values]
    return rows.select(*keys, F.col("target").alias(axis), *linear)
