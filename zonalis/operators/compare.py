"""Comparison of two data sets: alignment, and scalar and vector statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonalis.functions import units
from zonalis.operators.extract import nearest_levels
from zonalis.operators.reduce import coslat_mean, zonal_mean
from zonalis.operators.regrid import interpolate_axis

#: Values of an axis at most.
AXIS = 100_000
STATISTICS = ("n", "bias", "rmse", "crmse", "mae", "r", "sigma_ref", "sigma_cmp", "skill")


def _valid(*columns: str) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf"))
    return out


def scalar_statistics(ref: str, cmp: str) -> list[Column]:
    """Aggregates over rows where both values are present; null with fewer than two of them."""
    d, ok = F.col(cmp) - F.col(ref), F.count(ref) > 1
    mean2, bias = F.avg(d * d), F.avg(d)
    spread = F.sqrt(F.var_pop(ref)) * F.sqrt(F.var_pop(cmp))
    columns = {
        "n": F.count(ref), "bias": F.when(ok, bias), "rmse": F.when(ok, F.sqrt(mean2)), "crmse": F.when(ok, F.sqrt(F.greatest(F.lit(0.0), mean2 - bias * bias))),
        "mae": F.when(ok, F.avg(F.abs(d))), "r": F.when(ok & (spread > 0), F.try_divide(F.covar_pop(ref, cmp), spread)), "sigma_ref": F.when(ok, F.stddev_samp(ref)),
        "sigma_cmp": F.when(ok, F.stddev_samp(cmp)), "skill": F.when(ok, 1 - F.try_divide(mean2, F.var_samp(ref))),
    }
    return [c.alias(k) for k, c in columns.items()]


def vector_statistics(ur: str, vr: str, uc: str, vc: str) -> list[Column]:
    """The same for winds: an uncentred vector correlation, and lengths of differences."""
    ok = F.count("*") > 1
    du, dv = F.col(uc) - F.col(ur), F.col(vc) - F.col(vr)
    d2 = du * du + dv * dv
    bias = F.sqrt(F.pow(F.avg(du), 2) + F.pow(F.avg(dv), 2))
    mean2 = F.avg(d2)
    norm = lambda u, v: F.sum(F.col(u) * F.col(u) + F.col(v) * F.col(v))
    sigma = lambda u, v: F.sqrt(F.var_samp(u) + F.var_samp(v))
    columns = {
        "n": F.count("*"), "bias": F.when(ok, bias), "rmse": F.when(ok, F.sqrt(mean2)), "crmse": F.when(ok, F.sqrt(F.greatest(F.lit(0.0), mean2 - bias * bias))),
        "mae": F.when(ok, F.avg(F.sqrt(d2))), "r": F.when(ok, F.try_divide(F.sum(F.col(uc) * F.col(ur) + F.col(vc) * F.col(vr)), F.sqrt(norm(uc, vc) * norm(ur, vr)))),
        "sigma_ref": F.when(ok, sigma(ur, vr)), "sigma_cmp": F.when(ok, sigma(uc, vc)), "skill": F.when(ok, 1 - F.try_divide(mean2, F.var_samp(ur) + F.var_samp(vr))),
    }
    return [c.alias(k) for k, c in columns.items()]


def by_level(pairs: DataFrame, statistics: list[Column], level: str | None, *columns: str) -> DataFrame:
    """Statistics of every level and, with a null level, of all of them, in one pass of grouping sets."""
    rows = pairs.filter(_valid(*columns))
    if level is None:
        return rows.agg(*statistics).withColumn("level", F.lit(None).cast("double"))
    grouped = rows.groupingSets([[F.col(level)], []], F.col(level))
    return grouped.agg(F.grouping(level).alias("_all"), *statistics).withColumn("level", F.when(F.col("_all") == 0, F.col(level))).drop("_all", *([level] if level != "level" else []))


def _all_scalars(pairs: DataFrame, variables: list[str], level: str | None) -> DataFrame:
    """Statistics of several variables in one pass: a row for each variable, then grouping sets."""
    one = lambda v: F.struct(F.lit(v).alias("variable"), *[F.when(_valid(f"{v}_ref", f"{v}_cmp"), F.col(f"{v}_{k}")).alias(k) for k in ("ref", "cmp")])
    rows = pairs.select(*([F.col(level).alias("level")] if level else []), F.explode(F.array(*map(one, variables))).alias("p")).select(*(["level"] if level else []), "p.*")
    statistics = scalar_statistics("ref", "cmp")
    if not level:
        return rows.groupBy("variable").agg(*statistics).withColumn("level", F.lit(None).cast("double"))
    sets = [[F.col("variable"), F.col("level")], [F.col("variable")]]
    grouped = rows.groupingSets(sets, F.col("variable"), F.col("level")).agg(F.grouping("level").alias("_all"), *statistics)
    return grouped.withColumn("level", F.when(F.col("_all") == 0, F.col("level"))).drop("_all")


def align_time(ref: DataFrame, cmp: DataFrame, time: str = "time") -> tuple[DataFrame, DataFrame]:
    """Both data sets at their common times; none in common is an error."""
    common = ref.select(time).distinct().intersect(cmp.select(time).distinct())
    if common.isEmpty():
        raise ValueError("the data sets have no time in common")
    return ref.join(common, time, "left_semi"), cmp.join(common, time, "left_semi")


def axis_values(df: DataFrame, axis: str) -> list[float]:
    """The distinct values of an axis in order, ``AXIS`` at most; none, or more, is an error."""
    found = [r[0] for r in df.select(F.col(axis).cast("double").alias("x")).filter("x is not null").distinct().orderBy("x").limit(AXIS + 1).collect()]
    if not 0 < len(found) <= AXIS:
        raise ValueError(f"{axis} has {'no values' if not found else f'more than {AXIS} values'}")
    return found


def same_units(ref: DataFrame, cmp: DataFrame, variables: list[str]) -> DataFrame:
    """``cmp`` with the variables in the units of ``ref`` where both say theirs; units of another kind are an error."""
    out = {}
    for v in variables:
        one, two = units.units_of(ref, v), units.units_of(cmp, v)
        if one and two and one != two:
            out[v] = units.convert(F.col(v), two, one).alias(v, metadata={**(cmp.schema[v].metadata or {}), "units": one})
    return cmp.select(*[out.get(c, F.col(c)) for c in cmp.columns]) if out else cmp


def align_axis(ref: DataFrame, cmp: DataFrame, axis: str, keys: list[str], values: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both data sets on one axis: the values of the side with fewer of them (ties: ref) in the overlap."""
    points = [axis_values(df, axis) for df in (ref, cmp)]
    low, high = max(p[0] for p in points), min(p[-1] for p in points)
    if low > high:
        raise ValueError(f"no overlap along {axis}")
    target = [x for x in (points[0] if len(points[0]) <= len(points[1]) else points[1]) if low <= x <= high]
    out = []
    for df, own in zip((ref, cmp), points, strict=True):
        if set(target) <= set(own):
            out.append(df.select(*keys, F.col(axis).cast("double").alias(axis), *values).filter(F.col(axis).isin(target)))
        else:
            out.append(interpolate_axis(df, axis, keys, values, target, extrapolate=False))
    return out[0], out[1]


def compare(ref: DataFrame, cmp: DataFrame, variables: list[str], *, nside: int, nside_cmp: int | None = None, keys: list[str] | None = None, level: str | None = "level", reduce: str = "zonal-mean", lat_range: tuple[float, float] | None = None, level_range: tuple[float, float] | None = None, select_levels: list[float] | None = None, vector: tuple[str, str] | None = None, scale: dict[str, float] | None = None) -> DataFrame:
    """One row of statistics for each variable and level, and one over all levels (null level).

    ``reduce`` is zonal-mean, global or none.  With ``vector`` the two winds give one row named
    Winds instead of their own.  ``scale`` multiplies a variable before the statistics.  Variables are brought to
    the units of ``ref``.  Levels that differ, and latitudes of another resolution ``nside_cmp``, are
    interpolated to those of the side that has fewer, where they overlap; cells are not, so ``reduce`` none needs one resolution.
    """
    keys = keys if keys is not None else [c for c in ("time", level) if c and c in ref.columns]
    cmp, place, other = same_units(ref, cmp, [*variables, *([level] if level and level in keys else [])]), ["cell"], nside_cmp or nside
    if select_levels:
        # As the comparison is at levels of ref, those of cmp follow by alignment.
        ref = nearest_levels(ref, level, select_levels)
    if reduce != "none":
        ref, cmp = (zonal_mean(df, n, keys, variables) for df, n in ((ref, nside), (cmp, other)))
        place = ["ring"]
        if other != nside:
            ref, cmp = align_axis(ref, cmp, "lat", keys, variables)
            place = ["lat"]
        if lat_range:
            ref, cmp = (df.filter(F.col("lat").between(*lat_range)) for df in (ref, cmp))
    elif other != nside:
        raise ValueError("cells of different resolutions cannot be compared one by one")
    if reduce == "global":
        ref, cmp = (coslat_mean(df, keys, variables) for df in (ref, cmp))
        place = []
    if level_range:
        ref, cmp = (df.filter(F.col(level).between(*level_range)) for df in (ref, cmp))
    if level and level in keys and axis_values(ref, level) != axis_values(cmp, level):
        ref, cmp = align_axis(ref, cmp, level, [*(k for k in keys if k != level), *place], variables)
    own = [*keys, *place]
    pairs = ref.select(*own, *[F.col(v).alias(f"{v}_ref") for v in variables]).join(cmp.select(*own, *[F.col(v).alias(f"{v}_cmp") for v in variables]), own)
    for v, factor in (scale or {}).items():
        pairs = pairs.withColumns({f"{v}_ref": F.col(f"{v}_ref") * factor, f"{v}_cmp": F.col(f"{v}_cmp") * factor})
    parts = []
    if scalars := [v for v in variables if not vector or v not in vector]:
        parts.append(_all_scalars(pairs, scalars, level))
    if vector:
        u, v = vector
        names = (f"{u}_ref", f"{v}_ref", f"{u}_cmp", f"{v}_cmp")
        parts.append(by_level(pairs, vector_statistics(*names), level, *names).withColumn("variable", F.lit("Winds")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("variable", "level", *STATISTICS)
