"""Spherical harmonic transforms of whole maps, in numpy, for use inside grouped kernels.

A map is an array of 12 nside**2 RING values; coefficients are complex arrays over (l, m), m >= 0,
of shape (lmax + 1, lmax + 1).  Rings go through a Fourier transform each, then degrees through
the associated Legendre recurrence, one order at a time for all rings at once.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np


@lru_cache(maxsize=8)
def rings(nside: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, size, z and longitude of the first pixel of every ring."""
    n = nside
    r = np.arange(1, 4 * n)
    size = 4 * np.minimum(np.minimum(r, 4 * n - r), n)
    low = np.minimum(r, 4 * n - r).astype(float)
    cap = 1 - low**2 / (3.0 * n * n)
    z = np.where(r < n, cap, np.where(r > 3 * n, -cap, (2 * n - r) * 2 / (3.0 * n)))
    shifted = (r >= n) & (r <= 3 * n) & ((r + n) % 2 == 1)
    return np.cumsum(size) - size, size, z, np.where(shifted, 0.0, math.pi / size)


#: Bytes of Legendre tables that a process keeps, and the exponent by which tiny values are carried.
TABLE_BYTES, SCALE = 64 << 20, 512
_tables: dict[tuple[int, int, int], np.ndarray] = {}


def legendre(nside: int, lmax: int, m: int) -> np.ndarray:
    """Orthonormal associated Legendre functions of order m at the rings: shape (lmax - m + 1, rings)."""
    key = (nside, lmax, m)
    if key not in _tables:
        made = _legendre(rings(nside)[2], lmax, m)
        if sum(t.nbytes for t in _tables.values()) + made.nbytes > TABLE_BYTES:
            return made
        _tables[key] = made
    return _tables[key]


def _legendre(z: np.ndarray, lmax: int, m: int) -> np.ndarray:
    """By recurrence in the degree.

    Near the poles functions of high order begin far below the least number, but grow to
    ordinary size, so every point has an exponent of 2**SCALE beside its value.
    """
    s = np.sqrt(1 - z * z)
    k = np.arange(1, m + 1)
    start = 0.5 * (math.log2((2 * m + 1) / (4 * math.pi)) + float(np.sum(np.log2((2 * k - 1) / (2 * k))))) + m * np.log2(s)
    power = np.minimum(np.ceil(start / SCALE), 0.0).astype(np.int64)
    now, before = (-1) ** m * np.exp2(start - SCALE * power), np.zeros_like(z)
    out = np.zeros((lmax - m + 1, len(z)))
    out[0] = np.where(power == 0, now, 0.0)
    big, small = 2.0 ** (SCALE // 2), 2.0**-SCALE
    last = 0.0
    for l in range(m + 1, lmax + 1):
        a = math.sqrt((4.0 * l * l - 1) / (l * l - m * m))
        now, before = a * (z * now - last * before), now
        last = 1 / a
        grown = (np.abs(now) > big) & (power < 0)
        if grown.any():
            now, before, power = np.where(grown, now * small, now), np.where(grown, before * small, before), power + grown
        out[l - m] = np.where(power == 0, now, 0.0)
    return out


def slopes(nside: int, lmax: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Derivative in colatitude, and m times the function over the sine of colatitude."""
    z = rings(nside)[2]
    s, own = np.sqrt(1 - z * z), legendre(nside, lmax, m)
    l = np.arange(m, lmax + 1)[:, None].astype(float)
    c = np.sqrt((2 * l + 1) * (l * l - m * m) / np.maximum(2 * l - 1, 1))
    before = np.vstack([np.zeros((1, own.shape[1])), own[:-1]])
    return (l * z * own - c * before) / s, m * own / s


def phases(values: np.ndarray, nside: int, mmax: int) -> np.ndarray:
    """Sums over every ring of value times exp(-i m phi): shape (rings, mmax + 1)."""
    start, size, _, first = rings(nside)
    out = np.empty((len(size), mmax + 1), dtype=complex)
    m = np.arange(mmax + 1)
    for own in np.unique(size):
        at = np.flatnonzero(size == own)
        spectrum = np.fft.fft(values[start[at][:, None] + np.arange(own)], axis=1)
        out[at] = spectrum[:, m % own] * np.exp(-1j * m * first[at][:, None])
    return out


def from_phases(amplitudes: np.ndarray, nside: int) -> np.ndarray:
    """The real map with ring Fourier amplitudes of shape (rings, mmax + 1)."""
    start, size, _, first = rings(nside)
    out = np.empty(12 * nside * nside)
    m = np.arange(amplitudes.shape[1])
    turned = amplitudes * np.exp(1j * m * first[:, None]) * np.where(m > 0, 2.0, 1.0)
    for own in np.unique(size):
        at = np.flatnonzero(size == own)
        folded = np.zeros((len(at), own), dtype=complex)
        for k in m:
            folded[:, k % own] += turned[at, k]
        out[start[at][:, None] + np.arange(own)] = np.fft.ifft(folded, axis=1).real * own
    return out


def synthesis(alm: np.ndarray, nside: int) -> np.ndarray:
    lmax = len(alm) - 1
    amplitudes = np.stack([alm[m:, m] @ legendre(nside, lmax, m) for m in range(lmax + 1)], axis=1)
    return from_phases(amplitudes, nside)


def analysis(values: np.ndarray, nside: int, lmax: int, iterations: int = 3) -> np.ndarray:
    """Coefficients with equal weights, refined by that many Jacobi passes, each of which uses an order's table once."""
    alm = np.zeros((lmax + 1, lmax + 1), dtype=complex)
    rest = values
    for step in range(iterations + 1):
        sums = phases(rest, nside, lmax) * (4 * math.pi / len(values))
        amplitudes = np.empty((4 * nside - 1, lmax + 1), dtype=complex)
        for m in range(lmax + 1):
            table = legendre(nside, lmax, m)
            alm[m:, m] += table @ sums[:, m]
            if step < iterations:
                amplitudes[:, m] = alm[m:, m] @ table
        if step < iterations:
            rest = values - from_phases(amplitudes, nside)
    return alm


def _factors(lmax: int) -> np.ndarray:
    l = np.arange(lmax + 1)
    return np.sqrt(l * (l + 1.0))


def vector_analysis(u: np.ndarray, v: np.ndarray, nside: int, lmax: int) -> tuple[np.ndarray, np.ndarray]:
    """Gradient part E and curl part B of the wind (eastward u, northward v), one pass."""
    south, east = phases(-v, nside, lmax), phases(u, nside, lmax)
    weight = 4 * math.pi / len(u)
    fl = np.maximum(_factors(lmax), 1e-300)
    e, b = np.zeros((2, lmax + 1, lmax + 1), dtype=complex)
    for m in range(lmax + 1):
        slope, turn = slopes(nside, lmax, m)
        e[m:, m] = weight * (slope @ south[:, m] - 1j * (turn @ east[:, m])) / fl[m:]
        b[m:, m] = weight * (slope @ east[:, m] + 1j * (turn @ south[:, m])) / fl[m:]
    e[0], b[0] = 0, 0
    return e, b


def vector_synthesis(e: np.ndarray, b: np.ndarray, nside: int) -> tuple[np.ndarray, np.ndarray]:
    """Wind (u, v) of gradient part E and curl part B."""
    lmax = len(e) - 1
    fl = np.maximum(_factors(lmax), 1e-300)
    south, east = [], []
    for m in range(lmax + 1):
        slope, turn = slopes(nside, lmax, m)
        own_e, own_b = e[m:, m] / fl[m:], b[m:, m] / fl[m:]
        south.append(own_e @ slope - 1j * (own_b @ turn))
        east.append(own_b @ slope + 1j * (own_e @ turn))
    return from_phases(np.stack(east, axis=1), nside), -from_phases(np.stack(south, axis=1), nside)


def power(a: np.ndarray, b: np.ndarray | None = None) -> np.ndarray:
    """Power of every degree, or the cross power of two sets of coefficients."""
    product = (a * np.conj(a if b is None else b)).real
    lmax = len(a) - 1
    return (product[:, 0] + 2 * product[:, 1:].sum(axis=1)) / (2 * np.arange(lmax + 1) + 1)


def gaussian(lmax: int, fwhm_deg: float) -> np.ndarray:
    sigma = math.radians(fwhm_deg) / math.sqrt(8 * math.log(2))
    l = np.arange(lmax + 1)
    return np.exp(-l * (l + 1) * sigma * sigma / 2)
