"""Continuous wavelet transforms along time: numpy kernels, and spectra of grouped series.

The wavelets, their scales and their significance follow Torrence and Compo (1998).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonalis.functions import healpix as hp
from zonalis.operators import harmonics as sh
from zonalis.operators.spectral import ring_fourier

#: Default parameters of the mother wavelets.
ORDERS = {"MORLET": 6.0, "PAUL": 4.0, "DOG": 2.0}


def fourier_factor(mother: str = "MORLET", order: float | None = None) -> float:
    """Fourier period of scale 1."""
    k = order or ORDERS[mother]
    if mother == "MORLET":
        return 4 * math.pi / (k + math.sqrt(2 + k * k))
    return 4 * math.pi / (2 * k + 1) if mother == "PAUL" else 2 * math.pi / math.sqrt(k + 0.5)


def daughters(omega: np.ndarray, scales: np.ndarray, dt: float, mother: str = "MORLET", order: float | None = None) -> np.ndarray:
    """Transforms of the scaled wavelets at the angular frequencies: shape (scales, frequencies)."""
    k, n = order or ORDERS[mother], len(omega)
    s = scales[:, None]
    x = s * omega[None, :]
    up = omega[None, :] > 0
    norm = np.sqrt(2 * math.pi * s / (n * dt)) * math.sqrt(n)
    if mother == "MORLET":
        return norm * math.pi**-0.25 * np.exp(-np.where(up, (x - k) ** 2 / 2, 0)) * up
    if mother == "PAUL":
        return norm * 2**k / math.sqrt(k * math.factorial(int(2 * k - 1))) * np.where(up, x, 0) ** k * np.exp(-np.where(up, x, 0)) * up
    return -norm * (1j**k) / math.sqrt(math.gamma(k + 0.5)) * x**k * np.exp(-(x**2) / 2)


def transform(y: np.ndarray, dt: float, dj: float = 0.25, s0: float | None = None, j1: int | None = None, pad: bool = True, mother: str = "MORLET", order: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(wave, period, scale, cone of influence) of a series with its mean removed."""
    n = len(y)
    s0 = s0 or 2 * dt
    j1 = j1 if j1 is not None else int(math.log2(n * dt / s0) / dj)
    x = y - y.mean()
    if pad:
        x = np.concatenate([x, np.zeros(2 ** (int(math.log2(n) + 0.4999) + 1) - n)])
    omega = 2 * math.pi * np.fft.fftfreq(len(x), dt)
    scales = s0 * 2.0 ** (np.arange(j1 + 1) * dj)
    wave = np.fft.ifft(np.fft.fft(x)[None, :] * daughters(omega, scales, dt, mother, order), axis=1)[:, :n]
    factor = fourier_factor(mother, order)
    reach = {"MORLET": factor / math.sqrt(2), "PAUL": factor * math.sqrt(2), "DOG": factor / math.sqrt(2)}[mother]
    edge = np.minimum(np.arange(1, n + 1), np.arange(n, 0, -1)) - 1.0
    return wave, scales * factor, scales, reach * dt * np.maximum(edge, 1e-5)


def scaled(y: np.ndarray, dt: float, dj: float = 0.25) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients times sqrt(dt / scale), and their periods."""
    wave, period, scale, _ = transform(y, dt, dj)
    return wave * np.sqrt(dt / scale)[:, None], period


def directions(wa: np.ndarray, wb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """West amplitude and phase, east amplitude and phase, from coefficients of the cos and sin series."""
    a, b, c, d = wa.real, -wa.imag, wb.real, -wb.imag
    west, east = ((a - d) / 2, (b + c) / 2), ((a + d) / 2, (b - c) / 2)
    return np.hypot(*west), np.arctan2(west[1], west[0]), np.hypot(*east), np.arctan2(east[1], east[0])


def mean_directions(wa: np.ndarray, wb: np.ndarray, omega: float, dt: float) -> tuple[float, float, float, float]:
    """Time means after the oscillation itself is taken out of the phases."""
    west_a, west_p, east_a, east_p = directions(wa, wb)
    turn = omega * dt * np.arange(len(wa))
    out = []
    for amplitude, phase in ((west_a, west_p), (east_a, east_p)):
        still = (amplitude * np.exp(1j * (phase + turn))).mean()
        out += [float(abs(still)), float(np.angle(still))]
    return tuple(out)


def red_noise(lag1: float, n: int, dt: float, periods: np.ndarray) -> np.ndarray:
    """Theoretical spectrum of a first-order autoregressive process."""
    return (1 - lag1**2) / (1 - 2 * lag1 * np.cos(2 * math.pi * dt / periods) + lag1**2)


def significance(variance: float, lag1: float, n: int, dt: float, periods: np.ndarray, level: float = 0.95, dof: int = 2) -> np.ndarray:
    """Power above which a peak is significant at ``level``; 2 degrees of freedom for complex wavelets, 1 for real ones."""
    return variance * red_noise(lag1, n, dt, periods) * chi_square_quantile(level, dof) / dof


def chi_square_quantile(p: float, dof: int) -> float:
    if dof == 2:
        return -2 * math.log(1 - p)
    low, high = 0.0, dof + 100.0 * math.sqrt(dof)
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _lower_gamma(dof / 2, mid / 2) < p else (low, mid)
    return (low + high) / 2


def _lower_gamma(a: float, x: float) -> float:
    """The regularised lower incomplete gamma function by its series."""
    if x <= 0:
        return 0.0
    term = total = 1 / a
    k = a
    while term > total * 1e-16:
        k += 1
        term *= x / k
        total += term
    return min(1.0, total * math.exp(-x + a * math.log(x) - math.lgamma(a)))


def series_power(series: DataFrame, keys: list[str], time: str, value: str, dt: float, dj: float = 0.25, mother: str = "MORLET", order: float | None = None, level: float = 0.95) -> DataFrame:
    """keys, time, period_h, power, coi_h and threshold: the squared transform of every series.

    Power above ``threshold`` is significant at ``level`` against red noise of the series' own variance and
    lag-1 correlation.  Missing values are left out before; a series of fewer than four values, or of one value
    only, gives no row.
    """
    dof = 1 if mother == "DOG" else 2

    def run(table: pa.Table) -> pa.Table:
        at = np.argsort(table[time].to_numpy(), kind="stable")
        y, times = table[value].to_numpy().astype(float)[at], table[time].take(pa.array(at))
        n = len(y)
        variance = y.var() if n > 3 else 0.0
        if variance == 0:
            return pa.table({c: pa.array([], t) for c, t in [*((c, table[c].type) for c in [*keys, time]), *((c, pa.float64()) for c in ("period_h", "power", "coi_h", "threshold"))]})
        wave, period, _, coi = transform(y, dt, dj, mother=mother, order=order)
        x = y - y.mean()
        lag1 = float((x[1:] * x[:-1]).sum() / (x * x).sum())
        bound = significance(variance, lag1, n, dt, period, level, dof)
        made = {c: pa.array([table[c][0].as_py()] * (n * len(period)), table[c].type) for c in keys}
        columns = {"period_h": np.repeat(period, n), "power": (np.abs(wave) ** 2).ravel(), "coi_h": np.tile(coi, len(period)), "threshold": np.repeat(bound, n)}
        return pa.table({**made, time: pa.chunked_array(times.chunks * len(period), times.type), **{c: pa.array(v) for c, v in columns.items()}})

    schema = ", ".join([*(f"{k} {series.schema[k].dataType.simpleString()}" for k in [*keys, time]), "period_h double, power double, coi_h double, threshold double"])
    own = series.filter(F.col(value).isNotNull()).select(*keys, time, F.col(value).cast("double").alias(value))
    return (own.groupBy(*keys) if keys else own.groupBy(F.lit(0))).applyInArrow(run, schema)


def _grouped_power(series: DataFrame, keys: list[str], time: str, dt: float, dj: float, window: tuple[float, float] | None = None) -> DataFrame:
    """keys, period_h, time, west, east, coi_h: amplitudes of every scale and time of (a, b) series.

    Periods above ``coi_h`` lie in the cone of influence of the record's ends.  Only periods within ``window``
    are given.
    """
    low, high = window or (0.0, math.inf)

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table[time].to_numpy(), kind="stable")
        times = table[time].take(pa.array(order))
        a, b = (table[c].to_numpy().astype(float)[order] for c in ("a", "b"))
        (wa, period), (wb, _) = scaled(a, dt, dj), scaled(b, dt, dj)
        kept = (period >= low) & (period <= high)
        period = period[kept]
        west, _, east, _ = directions(wa[kept], wb[kept])
        n, k = len(order), len(period)
        made = {c: pa.array([table[c][0].as_py()] * (n * k), table[c].type) for c in keys}
        reach = fourier_factor() / math.sqrt(2) * dt * np.maximum(np.minimum(np.arange(n), np.arange(n - 1, -1, -1)), 1e-5)
        return pa.table({**made, "period_h": pa.array(np.repeat(period, n)), time: pa.chunked_array(times.chunks * k, times.type) if k else times.slice(0, 0), "west": pa.array(west.ravel()), "east": pa.array(east.ravel()), "coi_h": pa.array(np.tile(reach, k))})

    schema = ", ".join([*(f"{k} {series.schema[k].dataType.simpleString()}" for k in keys), f"period_h double, {time} {series.schema[time].dataType.simpleString()}, west double, east double, coi_h double"])
    return series.select(*keys, time, "a", "b").groupBy(*keys).applyInArrow(run, schema)


def fourier_wavelet_spectrum(field: DataFrame, nside: int, keys: list[str], time: str, value: str, m: int, dt: float, dj: float = 0.25, window: tuple[float, float] | None = None) -> DataFrame:
    """keys, period_h, time, and area means of west and east amplitudes of wavenumber m over the rings.

    ``window`` is the least and the greatest period in hours.
    """
    rings = ring_fourier(field, nside, [*keys, time], value, [m])
    power = _grouped_power(rings, [*keys, "ring"], time, dt, dj, window)
    size = hp.ring_size(F.col("ring"), nside)
    return power.groupBy(*keys, "period_h", time).agg(*[(F.sum(F.col(c) * size) / hp.npix(nside)).alias(c) for c in ("west", "east")], F.max("coi_h").alias("coi_h"))


def _order_series(field: DataFrame, nside: int, keys: list[str], time: str, value: str, m: int, lmax: int | None, iterations: int, by_ring: bool) -> DataFrame:
    """keys, time, (l or ring), a, b: the part of wavenumber m by degree, or summed up on the rings.

    The field's part of wavenumber m is a cos(m lon) + b sin(m lon).  Slices without data give no row.
    """
    top, size = lmax if lmax is not None else 3 * nside - 1, hp.npix(nside)
    name = "ring" if by_ring else "l"

    def run(table: pa.Table) -> pa.Table:
        full = np.full(size, np.nan)
        full[table["cell"].to_numpy()] = table[value].to_numpy().astype(float)
        gap = ~np.isfinite(full)
        a = b = place = np.empty(0)
        if not gap.all():
            alm = sh.analysis(np.where(gap, full[~gap].mean(), full), nside, top, iterations)[m:, m]
            a, b, place = (2 * alm.real, -2 * alm.imag, np.arange(m, top + 1)) if m else (alm.real, 0 * alm.real, np.arange(top + 1))
            if by_ring:
                own = sh.legendre(nside, top, m)
                a, b, place = a @ own, b @ own, np.arange(1, own.shape[1] + 1)
        made = {k: pa.array([table[k][0].as_py()] * len(a), table[k].type) for k in [*keys, time]}
        return pa.table({**made, name: pa.array(place, pa.int64()), "a": pa.array(a, pa.float64()), "b": pa.array(b, pa.float64())})

    schema = ", ".join([*(f"{k} {field.schema[k].dataType.simpleString()}" for k in [*keys, time]), f"{name} long, a double, b double"])
    return field.select(*keys, time, F.col("cell").cast("long").alias("cell"), F.col(value).cast("double").alias(value)).groupBy(*keys, time).applyInArrow(run, schema)


def harmonic_rings(field: DataFrame, nside: int, keys: list[str], time: str, value: str, m: int, lmax: int | None = None, iterations: int = 3) -> DataFrame:
    """keys, time, ring, m, a, b as ring_fourier gives them, but from spherical harmonics up to ``lmax``.

    The wavelet transform is linear, so transforms of these series are those of
    the degrees, summed up on the rings.
    """
    return _order_series(field, nside, keys, time, value, m, lmax, iterations, True).withColumn("m", F.lit(m))


def harmonic_wavelet_spectrum(field: DataFrame, nside: int, keys: list[str], time: str, value: str, m: int, dt: float, dj: float = 0.25, lmax: int | None = None, iterations: int = 3, window: tuple[float, float] | None = None) -> DataFrame:
    """The same from spherical harmonics: roots of summed squares over degrees, over sqrt(2 pi)."""
    series = _order_series(field, nside, keys, time, value, m, lmax, iterations, False)
    power = _grouped_power(series, [*keys, "l"], time, dt, dj, window)
    return power.groupBy(*keys, "period_h", time).agg(*[(F.sqrt(F.sum(F.col(c) * F.col(c))) / math.sqrt(2 * math.pi)).alias(c) for c in ("west", "east")], F.max("coi_h").alias("coi_h"))
