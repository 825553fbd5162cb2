"""What figures show: each function reduces a field to the few rows that are drawn.

``draw`` needs matplotlib, which is optional.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonalis.operators import dynamics, extract, reduce

#: Labels, display units and factors of variables (fixed values).
DISPLAY = {
    "temp": ("Temperature", "K", 1.0), "u": ("Zonal velocity", "m s-1", 1.0), "v": ("Meridional velocity", "m s-1", 1.0), "w": ("Vertical velocity", "cm s-1", 100.0),
    "theta": ("Potential temperature", "K", 1.0), "tke": ("Turbulent kinetic energy", "m2 s-2", 1.0),
}


def display_factors(variables: list[str]) -> dict[str, float]:
    return {v: DISPLAY[v][2] for v in variables if v in DISPLAY and DISPLAY[v][2] != 1.0}


def section(field: DataFrame, nside: int, level: str, value: str, lon: float | None = None) -> DataFrame:
    """lat, level, value: the zonal mean, or the values along a meridian, averaged over the rest."""
    if lon is None:
        return reduce.zonal_mean(field, nside, [level], [value]).select("lat", level, value)
    targets = extract.meridian_targets(field.sparkSession, nside, lon)
    mean = reduce.plain_mean(field, [level, "cell"], [value])
    return extract.along(mean, targets, nside, [level], [value]).select("lat", level, value)


def keogram(field: DataFrame, nside: int, time: str, level: str, value: str, lat: float | None = None, lon: float | None = None) -> DataFrame:
    """time, level, value: at a point, or the mean over the globe weighted by the cosine of latitude."""
    if lat is not None and lon is not None:
        return extract.point(field, nside, lat, lon).select(time, level, value)
    return reduce.coslat_mean(reduce.zonal_mean(field, nside, [time, level], [value]), [time, level], [value])


def global_map(field: DataFrame, nside: int, level: str, value: str, height: float) -> DataFrame:
    """cell, value: the mean of the level nearest to ``height``."""
    return extract.nearest_levels(field, level, [height]).groupBy("cell").agg(F.avg(value).alias(value))


def spectrum_lines(spectrum: DataFrame, power: str = "power") -> DataFrame:
    """l, power and reference lines of slope -3 and -5/3 through the median degree."""
    rows = spectrum.filter("l > 0").groupBy("l").agg(F.avg(power).alias(power))
    anchor = rows.agg(F.percentile("l", 0.5).alias("l0"), F.percentile(power, 0.5).alias("p0"))
    lines = {"slope_3": F.col("p0") * F.pow(F.col("l") / F.col("l0"), F.lit(-3.0)), "slope_5_3": F.col("p0") * F.pow(F.col("l") / F.col("l0"), F.lit(-5 / 3))}
    return rows.join(F.broadcast(anchor)).withColumns(lines).drop("l0", "p0")  # one row


def tide_panel(tides: DataFrame, nside: int, m: int, period_h: float, level: str | None = None) -> DataFrame:
    """Zonal means of amplitude and circular means of phase of one tide."""
    from zonalis.functions import healpix as hp

    own = tides.filter((F.col("m") == m) & (F.col("period_h") == period_h)).withColumn("ring", hp.ring_of(F.col("cell"), nside))
    return reduce.circular_mean(own, [*([level] if level else []), "ring"], "phase", "amplitude")


def flux_arrows(ep: DataFrame, level: str = "level", every: int = 2, rho: str | None = None, scaling: str = "root") -> DataFrame:
    """Arrows of Eliassen-Palm flux: scaled by the axes, thinned, and none poleward of 85 degrees.

    ``scaling`` root divides by the root of the pressure; edmon follows Edmon et al. (1980) and Jucker (2021), so
    that arrows show divergence: on pressure in m3 and m3 hPa, on heights (with a density ``rho``) in m4 s-2 and m5 s-2.
    """
    cos = F.cos(F.radians("lat"))
    if scaling == "edmon":
        turn = 2 * math.pi / dynamics.GRAVITY if rho is None else 1 / F.col(rho)
        x = cos * dynamics.RADIUS * turn * F.col("f_phi")
        y = cos * dynamics.RADIUS**2 * turn * F.col("f_z") / (100.0 if rho is None else 1.0)
    else:
        scale = F.sqrt(F.lit(1e5) / F.col(level)) if rho is None else 1 / F.col(rho)
        x, y = F.col("f_phi") * cos * scale, F.col("f_z") * cos * scale
    return ep.filter((F.abs("lat") <= 85) & (F.col("ring") % every == 0)).withColumns({"arrow_x": x, "arrow_y": y})


def companion_ticks(least_hpa: float, greatest_hpa: float, most: int = 12) -> list[tuple[float, float]]:
    """(pressure in hPa, log-pressure height in km) of round heights beside a pressure axis, ``most`` steps at most if a step allows."""
    height = lambda p: dynamics.HEIGHT / 1000 * math.log(dynamics.P_SURFACE / 100 / p)
    low, high = max(0.0, height(greatest_hpa)), height(least_hpa)
    step = next((s for s in (1, 2, 5, 10, 20, 25, 50) if (high - low) / s <= most), 100)
    marks = range(math.ceil(low / step) * step, math.floor(high / step) * step + 1, step)
    return [(dynamics.P_SURFACE / 100 * math.exp(-z * 1000 / dynamics.HEIGHT), float(z)) for z in marks]


def draw(rows: DataFrame, x: str, y: str, value: str, path: str) -> str:
    """Save a filled contour of a reduced table as a picture."""
    import matplotlib

    matplotlib.use("Agg")
    import matplotlib.pyplot as plt

    table = rows.select(x, y, value).toPandas().pivot(index=y, columns=x, values=value)
    figure, axes = plt.subplots()
    figure.colorbar(axes.contourf(table.columns, table.index, table.values))
    label = DISPLAY.get(value, (value, "", 1.0))
    axes.set(xlabel=x, ylabel=y, title=f"{label[0]} [{label[1]}]")
    figure.savefig(path)
    plt.close(figure)
    return path
