"""Tides: harmonic least squares, directional filter, symmetric parts, and wavelet tides."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonalis.functions import healpix as hp
from zonalis.operators import harmonics as sh
from zonalis.operators import wavelet as wl

#: Periods in hours of the letters in names of tides.
LETTER_HOURS = {"D": 24.0, "S": 12.0, "T": 8.0, "Q": 6.0}


def parse_mode(name: str) -> tuple[float | None, int]:
    """(period in hours or None, zonal wavenumber): DW1 -> (24, 1), SE2 -> (12, -2), 3 -> (None, 3).

    Westward wavenumbers are positive; S as second letter means standing or eastward.
    """
    if re.fullmatch(r"[+-]?\d+", name):
        return None, int(name)
    if not (m := re.fullmatch(r"([DSTQ])([WES])(\d+)", name.upper())):
        raise ValueError(f"{name!r} is no name of a tide")
    return LETTER_HOURS[m[1]], int(m[3]) * (1 if m[2] == "W" else -1)


def elapsed_hours(time: str) -> Column:
    return F.unix_micros(F.col(time).cast("timestamp")) / 3.6e9


def least_squares(field: DataFrame, keys: list[str], value: str, hours: Column, periods: list[float]) -> DataFrame:
    """keys, period_h, c, s, mean: the fit of c cos(wt) + s sin(wt) + mean to every series, one period at a time.

    The normal equations are sums, so a series never has to meet in one place; they are
    solved in closed form.  Fewer than three times, or times that leave them singular, give null.
    """
    rows = field.filter(F.col(value).isNotNull()).withColumn("period_h", F.explode(F.array(*map(F.lit, map(float, periods)))))
    angle = hours * (2 * math.pi) / F.col("period_h")
    rows = rows.withColumns({"_c": F.cos(angle), "_s": F.sin(angle), "_y": F.col(value).cast("double")})
    total = lambda a, b: F.sum(a * b)
    c, s, y = F.col("_c"), F.col("_s"), F.col("_y")
    sums = {"n": F.count("*").cast("double"), "cc": total(c, c), "ss": total(s, s), "cs": total(c, s), "sc": F.sum(c), "sn": F.sum(s), "yc": total(y, c), "ys": total(y, s), "sy": F.sum(y)}
    g = rows.groupBy(*keys, "period_h").agg(*[v.alias(k) for k, v in sums.items()])
    # With the mean taken out, two equations are left.
    n = F.col("n")
    centred = {"_C": F.col("cc") - F.col("sc") * F.col("sc") / n, "_S": F.col("ss") - F.col("sn") * F.col("sn") / n, "_X": F.col("cs") - F.col("sc") * F.col("sn") / n, "_P": F.col("yc") - F.col("sy") * F.col("sc") / n, "_Q": F.col("ys") - F.col("sy") * F.col("sn") / n}
    g = g.withColumns(centred).withColumn("_D", F.col("_C") * F.col("_S") - F.col("_X") * F.col("_X"))
    usable = (n >= 3) & (F.abs("_D") > 1e-9 * n * n)
    g = g.withColumns({"c": F.when(usable, F.try_divide(F.col("_P") * F.col("_S") - F.col("_Q") * F.col("_X"), F.col("_D"))), "s": F.when(usable, F.try_divide(F.col("_Q") * F.col("_C") - F.col("_P") * F.col("_X"), F.col("_D")))})
    return g.select(*keys, "period_h", "c", "s", ((F.col("sy") - F.col("c") * F.col("sc") - F.col("s") * F.col("sn")) / n).alias("mean"))


def amplitude_phase(c: Column, s: Column, m: Column | None = None, lon: Column | None = None) -> tuple[Column, Column]:
    """Amplitude, and phase; with a wavenumber the phase is turned back by m times the longitude in degrees."""
    amplitude = F.sqrt(c * c + s * s)
    if m is None:
        return amplitude, F.atan2(s, c)
    a = m * F.radians(lon)
    return amplitude, F.atan2(s * F.cos(a) + c * F.sin(a), c * F.cos(a) - s * F.sin(a))


def symmetric_parts(field: DataFrame, nside: int, keys: list[str], values: list[str]) -> DataFrame:
    """Half sums (_sym) and half differences (_asy) of every RING cell and its mirror across the equator."""
    other = field.select(*keys, hp.mirror(F.col("cell"), nside).alias("cell"), *[F.col(v).alias(f"_{v}") for v in values])
    both = field.join(other, [*keys, "cell"])
    parts = [c for v in values for c in (((F.col(v) + F.col(f"_{v}")) / 2).alias(f"{v}_sym"), ((F.col(v) - F.col(f"_{v}")) / 2).alias(f"{v}_asy"))]
    return both.select(*keys, "cell", *parts)


def directional(fit: DataFrame, nside: int, keys: list[str], m: int, lmax: int | None = None, iterations: int = 3) -> DataFrame:
    """The part of (c, s) maps that travels with zonal wavenumber m: westward if positive, eastward if negative."""
    top = lmax if lmax is not None else 3 * nside - 1
    size = hp.npix(nside)

    def run(table: pa.Table) -> pa.Table:
        cell, maps = table["cell"].to_numpy(), []
        for v in ("c", "s"):
            full = np.full(size, np.nan)
            full[cell] = table[v].to_numpy().astype(float)
            gap = ~np.isfinite(full)
            maps.append(np.where(gap, 0.0, full))
        a, b = (sh.analysis(x, nside, top, iterations) for x in maps)
        keep = np.zeros_like(a)
        keep[:, abs(m)] = 1
        a, b = a * keep, b * keep
        if m > 0:
            a = (a - 1j * b) / 2
            b = 1j * a
        elif m < 0:
            a = (a + 1j * b) / 2
            b = -1j * a
        made = {k: pa.array([table[k][0].as_py()] * size, table[k].type) for k in keys}
        c, s = sh.synthesis(a, nside), sh.synthesis(b, nside)
        return pa.table({**made, "cell": pa.array(np.arange(size)), "m": pa.array(np.full(size, m, dtype=np.int32)), "c": pa.array(c), "s": pa.array(s)})

    schema = ", ".join([*(f"{k} {fit.schema[k].dataType.simpleString()}" for k in keys), "cell long, m int, c double, s double"])
    return fit.select(*keys, "cell", "c", "s").groupBy(*keys).applyInArrow(run, schema)


def least_squares_tides(field: DataFrame, nside: int, keys: list[str], value: str, hours: Column, modes: list[tuple[float, int]], lmax: int | None = None, sym_asy: bool = False) -> DataFrame:
    """keys, cell, period_h, m, amplitude and phase of every (period, wavenumber) pair."""
    out = None
    for period in dict.fromkeys(p for p, _ in modes):
        fit = least_squares(field, [*keys, "cell"], value, hours, [period])
        for m in [m for p, m in modes if p == period]:
            own = directional(fit, nside, [*keys, "period_h"], m, lmax)
            if sym_asy:
                own = symmetric_parts(own, nside, [*keys, "period_h", "m"], ["c", "s"])
            out = own if out is None else out.unionByName(own)
    lon = hp.turn_of(F.col("cell"), nside) * 90.0
    columns = []
    for part in ("_sym", "_asy") if sym_asy else ("",):
        amplitude, phase = amplitude_phase(F.col(f"c{part}"), F.col(f"s{part}"), F.col("m"), lon)
        columns += [amplitude.alias(f"amplitude{part}"), phase.alias(f"phase{part}")]
    return out.select(*keys, "cell", "period_h", "m", *columns)


def ring_parts(rings: DataFrame, nside: int, keys: list[str], time: str) -> DataFrame:
    """Ring series a, b as their parts symmetric (sym) and antisymmetric (asy) about the equator."""
    other = rings.select(*keys, time, (4 * nside - F.col("ring")).alias("ring"), F.col("a").alias("_a"), F.col("b").alias("_b"))
    both = rings.join(other, [*keys, time, "ring"])
    parts = F.explode(F.array(F.struct(F.lit("sym").alias("part"), F.lit(1.0).alias("_k")), F.struct(F.lit("asy").alias("part"), F.lit(-1.0).alias("_k"))))
    half = lambda c: ((F.col(c) + F.col("_p._k") * F.col(f"_{c}")) / 2).alias(c)
    return both.withColumn("_p", parts).select(*keys, F.col("_p.part").alias("part"), time, "ring", half("a"), half("b"))


def wavelet_tides(rings: DataFrame, nside: int, keys: list[str], time: str, m: int, dt: float, periods: list[float], dj: float = 0.1, sym_asy: bool = False, temporal_mean: bool = True) -> DataFrame:
    """keys, ring, period_h, scale_period_h, west and east amplitude and phase, averaged over time.

    ``rings`` holds Fourier series a, b of wavenumber |m| by ring and time, as ring_fourier gives them.  The
    wavelet's own period nearest to the one asked for is given too.  With ``sym_asy`` a column part has sym and
    asy.  Without ``temporal_mean`` there is a row for every time, with the phase of that time.
    """
    own = rings.filter(F.col("m") == abs(m))
    if sym_asy:
        own, keys = ring_parts(own, nside, keys, time), [*keys, "part"]

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table[time].to_numpy(), kind="stable")
        a, b = (table[c].to_numpy().astype(float)[order] for c in ("a", "b"))
        transforms = [wl.scaled(x, dt, dj) for x in (a, b)]
        scale_periods = transforms[0][1]
        columns = []
        for p in periods:
            k = int(np.abs(scale_periods - p).argmin())
            wa, wb = (t[0][k] for t in transforms)
            found = wl.mean_directions(wa, wb, 2 * math.pi / scale_periods[k], dt) if temporal_mean else wl.directions(wa, wb)
            columns.append(np.broadcast_arrays(p, scale_periods[k], *map(np.atleast_1d, found)))
        n = len(columns[0][0])
        made = {k: pa.array([table[k][0].as_py()] * (n * len(periods)), table[k].type) for k in [*keys, "ring"]}
        if not temporal_mean:
            times = table[time].take(pa.array(order))
            made[time] = pa.chunked_array(times.chunks * len(periods), times.type)
        names = ("period_h", "scale_period_h", "west_amplitude", "west_phase", "east_amplitude", "east_phase")
        return pa.table({**made, **{name: pa.array(np.concatenate(c), pa.float64()) for name, c in zip(names, zip(*columns, strict=True), strict=True)}})

    given = [*keys, "ring"] if temporal_mean else [*keys, "ring", time]
    schema = ", ".join([*(f"{k} {own.schema[k].dataType.simpleString()}" for k in given), "period_h double, scale_period_h double, west_amplitude double, west_phase double, east_amplitude double, east_phase double"])
    return own.select(*keys, "ring", time, "a", "b").groupBy(*keys, "ring").applyInArrow(run, schema)


def on_cells(by_ring: DataFrame, spark, nside: int) -> DataFrame:
    """Values of rings given to all their cells."""
    from zonalis.operators.grid import grid, small

    cells = small(grid(spark, nside).select("ring", F.col("cell_ring").alias("cell"), "lon"), hp.npix(nside))
    return by_ring.join(cells, "ring")
