"""HEALPix index arithmetic as Column expressions.

``z`` is the sine of latitude and ``t`` the longitude in quarter turns, so that
indices follow from rational arithmetic alone.  All expressions stay in the JVM.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Row and longitude offsets of the twelve base faces (fixed values of the pixelisation).
FACE_ROW = (2, 2, 2, 2, 3, 3, 3, 3, 4, 4, 4, 4)
FACE_TURN = (1, 3, 5, 7, 0, 2, 4, 6, 1, 3, 5, 7)

#: Earth's radius in km for spectra, and for resolution and Eliassen-Palm flux (two values in use).
RADIUS_SPECTRAL_KM, RADIUS_KM = 6371.229, 6371.0


def npix(nside: int) -> int:
    return 12 * nside * nside


def is_valid_npix(n: int) -> bool:
    """Whether n = 12 * nside**2 for a power of two."""
    if n <= 0 or n % 12:
        return False
    root = math.isqrt(n // 12)
    return root * root == n // 12 and root & (root - 1) == 0


def nside_for(cells: int) -> int:
    """The nside of a valid pixel count, else the power of two nearest in resolution."""
    if is_valid_npix(cells):
        return math.isqrt(cells // 12)
    return 2 ** round(math.log2(max(1.0, math.sqrt(cells / 12))))


def nside_for_zoom(zoom: int) -> int:
    return 1 << zoom


def cell_area(nside: int) -> float:
    return 4 * math.pi / npix(nside)


def resolution_km(nside: int) -> float:
    return math.sqrt(cell_area(nside)) * RADIUS_KM


def _long(c: Column) -> Column:
    return F.floor(c).cast("long")


def pixel(z: Column, t: Column, nside: int) -> Column:
    """RING pixel index of (z, t)."""
    return _locate(z, t, nside)[0]


def ring_at(z: Column, t: Column, nside: int) -> Column:
    """1-based ring of (z, t)."""
    return _locate(z, t, nside)[1]


def _locate(z: Column, t: Column, n: int) -> tuple[Column, Column]:
    t = t - 4 * F.floor(t / 4)
    # Equatorial belt: numbers of the ascending and descending edge lines.
    up, down = _long(n * (0.5 + t) - 0.75 * n * z), _long(n * (0.5 + t) + 0.75 * n * z)
    row = n + 1 + up - down
    shift = F.when(F.pmod(row, F.lit(2)) == 0, 1).otherwise(0)
    place = F.pmod(_long((up + down - n + shift + 1) / 2), F.lit(4 * n))
    belt = 2 * n * (n - 1) + 4 * n * (row - 1) + place
    # Polar caps: rings shrink towards the pole.
    part = t - F.floor(t)
    r = n * F.sqrt(3 * (1 - F.abs(z)))
    i = _long(part * r) + _long((1 - part) * r) + 1
    p = F.pmod(_long(t * i), 4 * i)
    cap = F.when(z > 0, 2 * i * (i - 1) + p).otherwise(npix(n) - 2 * i * (i + 1) + p)
    in_belt = F.abs(z) <= 2.0 / 3.0
    return F.when(in_belt, belt).otherwise(cap), F.when(in_belt, row + n - 1).otherwise(F.when(z > 0, i).otherwise(4 * n - i))


def pixel_lonlat(lon: Column, lat: Column, nside: int) -> Column:
    """RING pixel of longitude and latitude in degrees."""
    return pixel(F.sin(F.radians(lat)), lon / 90.0, nside)


def ring_size(ring: Column, n: int) -> Column:
    return 4 * F.least(ring, 4 * n - ring, F.lit(n))


def ring_start(ring: Column, n: int) -> Column:
    """First RING pixel of a ring."""
    low = F.least(ring, F.lit(n))
    south = 4 * n - ring
    return F.when(ring <= n, 2 * low * (low - 1)).when(ring <= 3 * n, 2 * n * (n - 1) + (ring - n) * 4 * n).otherwise(npix(n) - 2 * south * (south + 1)).cast("long")


def ring_of(cell: Column, n: int) -> Column:
    """1-based ring of a RING pixel."""
    cap = 2 * n * (n - 1)
    # Integer square roots: pixels before ring i number 2 i (i - 1).
    from_pole = lambda c: ((1 + F.floor(F.sqrt(1 + 2 * c.cast("double")))) / 2).cast("long")
    north, south = from_pole(cell), from_pole(npix(n) - 1 - cell)
    return F.when(cell < cap, north).when(cell < npix(n) - cap, F.floor((cell - cap) / (4 * n)).cast("long") + n).otherwise(4 * n - south)


def ring_z(ring: Column, n: int) -> Column:
    """Sine of latitude of a ring's centre."""
    low = F.least(ring, 4 * n - ring).cast("double")
    cap = 1 - low * low / (3.0 * n * n)
    return F.when(ring < n, cap).when(ring > 3 * n, -cap).otherwise((2 * n - ring) * 2 / (3.0 * n))


def turn_of(cell: Column, n: int) -> Column:
    """Longitude of a RING pixel's centre in quarter turns."""
    ring = ring_of(cell, n)
    place = cell - ring_start(ring, n)
    belt = (ring >= n) & (ring <= 3 * n)
    shift = F.when(belt & (F.pmod(ring + n, F.lit(2)) == 1), 0.0).otherwise(0.5)
    return (place + shift) / (ring_size(ring, n) / 4)


def mirror(cell: Column, n: int) -> Column:
    """The pixel on the other side of the equator: same place in the mirrored ring."""
    ring = ring_of(cell, n)
    return cell - ring_start(ring, n) + ring_start(4 * n - ring, n)


def spread_bits(v: Column, nside: int) -> Column:
    """The bits of v moved to even places."""
    out = F.lit(0).cast("long")
    for b in range(max(1, nside.bit_length() - 1)):
        out = out + F.shiftleft(F.shiftright(v, b).bitwiseAND(F.lit(1)).cast("long"), 2 * b)
    return out


def parent(nest: Column, levels: int) -> Column:
    """NESTED ancestor some levels up."""
    return F.shiftright(nest, 2 * levels)


def unit_vector(lon: Column, lat: Column) -> tuple[Column, Column, Column]:
    a, b = F.radians(lon), F.radians(lat)
    return F.cos(b) * F.cos(a), F.cos(b) * F.sin(a), F.sin(b)


def chord2(one: tuple[Column, Column, Column], two: tuple[Column, Column, Column]) -> Column:
    """Squared chord between two unit vectors, to 12 digits so that equal distances are equal."""
    return F.round(sum(((a - b) * (a - b) for a, b in zip(one[1:], two[1:], strict=True)), (one[0] - two[0]) * (one[0] - two[0])), 12)


def wavelength_km(degree: Column) -> Column:
    """2 pi R / sqrt(l (l + 1)); degree 0 gives null."""
    return F.when(degree > 0, 2 * math.pi * RADIUS_SPECTRAL_KM / F.sqrt(degree * (degree + 1.0)))


def degree_for(wavelength: Column) -> Column:
    """The real degree whose wavelength is given."""
    q = F.pow(2 * math.pi * RADIUS_SPECTRAL_KM / wavelength, 2)
    return (F.sqrt(1 + 4 * q) - 1) / 2
