"""Units: parsing into dimensions, and affine conversion as Column arithmetic."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base units by name: (powers of kg, m, s, K and rad), factor, offset to SI.
_BASE = {
    **dict.fromkeys(("m", "meter", "meters", "metre", "metres", "gpm"), ({"m": 1}, 1.0, 0.0)),
    **dict.fromkeys(("km", "kilometer", "kilometers"), ({"m": 1}, 1e3, 0.0)),
    "cm": ({"m": 1}, 1e-2, 0.0), "mm": ({"m": 1}, 1e-3, 0.0),
    **dict.fromkeys(("s", "sec", "second", "seconds"), ({"s": 1}, 1.0, 0.0)),
    **dict.fromkeys(("min", "minute", "minutes"), ({"s": 1}, 60.0, 0.0)),
    **dict.fromkeys(("h", "hr", "hour", "hours"), ({"s": 1}, 3600.0, 0.0)),
    **dict.fromkeys(("d", "day", "days"), ({"s": 1}, 86400.0, 0.0)),
    **dict.fromkeys(("k", "kelvin"), ({"K": 1}, 1.0, 0.0)),
    **dict.fromkeys(("degc", "celsius"), ({"K": 1}, 1.0, 273.15)),
    **dict.fromkeys(("degf", "fahrenheit"), ({"K": 1}, 5 / 9, 459.67 * 5 / 9)),
    **dict.fromkeys(("kg", "kilogram"), ({"kg": 1}, 1.0, 0.0)),
    "g": ({"kg": 1}, 1e-3, 0.0),
    **dict.fromkeys(("pa", "pascal", "pascals"), ({"kg": 1, "m": -1, "s": -2}, 1.0, 0.0)),
    **dict.fromkeys(("hpa", "hectopascal", "hectopascals", "mb", "mbar", "millibar", "millibars"), ({"kg": 1, "m": -1, "s": -2}, 100.0, 0.0)),
    "kpa": ({"kg": 1, "m": -1, "s": -2}, 1e3, 0.0), "bar": ({"kg": 1, "m": -1, "s": -2}, 1e5, 0.0),
    **dict.fromkeys(("j", "joule"), ({"kg": 1, "m": 2, "s": -2}, 1.0, 0.0)),
    **dict.fromkeys(("w", "watt"), ({"kg": 1, "m": 2, "s": -3}, 1.0, 0.0)),
    **dict.fromkeys(("rad", "radian", "radians"), ({"rad": 1}, 1.0, 0.0)),
    **dict.fromkeys(("deg", "degree", "degrees", "degrees_north", "degrees_east", "degree_north", "degree_east"), ({"rad": 1}, math.pi / 180, 0.0)),
    **dict.fromkeys(("1", "", "-", "dimensionless"), ({}, 1.0, 0.0)),
    "%": ({}, 0.01, 0.0),
}
_TERM = re.compile(r"([A-Za-z_%]+|1)(?:(?:\*\*|\^)?([+-]?\d+))?")

#: Units to be expected of variables by name, and the range that tells an unlabelled one (fixed values).
EXPECTED_UNITS = {
    "u": "m/s", "v": "m/s", "w": "m/s", "divergence": "1/s", "vorticity": "1/s", "temperature": "K", "temp": "K", "theta": "K", "pressure": "Pa", "pres": "Pa", "ps": "Pa", "ts": "K",
    "omega": "Pa/s", "geopotential": "m**2 s**-2", "u_wind": "m/s", "v_wind": "m/s", "w_wind": "m/s", "lat": "degrees_north", "lon": "degrees_east",
}
EXPECTED_RANGE = {
    "u": (-350.0, 350.0), "v": (-350.0, 350.0), "w": (-100.0, 100.0), "temp": (120.0, 2500.0), "theta": (120.0, 1e8), "pres": (0.0, 2000e2), "u_wind": (-350.0, 350.0), "v_wind": (-350.0, 350.0),
    "w_wind": (-100.0, 100.0), "divergence": (-10.0, 10.0), "vorticity": (-10.0, 10.0), "temperature": (120.0, 2500.0), "pressure": (0.0, 2000e2), "ts": (120.0, 350.0), "ps": (0.0, 2000e2),
    "omega": (-100.0, 100.0), "geopotential": (0.0, 1e8),
}


def parse(units: str) -> tuple[tuple, float, float]:
    """(dimension, factor, offset) of a unit such as ``m s-1``, ``K`` or ``kg / m**3``."""
    powers: dict[str, int] = {}
    factor, offset, terms = 1.0, 0.0, 0
    for sign, part in zip([1, *([-1] * units.count("/"))], units.split("/"), strict=True):
        for name, power in _TERM.findall(part.replace("*", " ").replace("  ", "**") if "**" in part else part.replace("*", " ")):
            base = _BASE.get(name if name in _BASE else name.lower())
            if base is None:
                raise ValueError(f"unknown unit {name!r} in {units!r}")
            p = sign * int(power or 1)
            for k, v in base[0].items():
                powers[k] = powers.get(k, 0) + v * p
            factor *= base[1] ** p
            offset, terms = (base[2] if p == 1 else 0.0), terms + 1
    return tuple(sorted((k, v) for k, v in powers.items() if v)), factor, offset if terms == 1 else 0.0


def compatible(a: str, b: str) -> bool:
    return parse(a)[0] == parse(b)[0]


def equivalent(a: str, b: str) -> bool:
    one, two = parse(a), parse(b)
    return one[0] == two[0] and math.isclose(one[1], two[1]) and math.isclose(one[2], two[2])


def components(source: str, target: str) -> tuple[float, float]:
    """(m, b) with target = m * source + b; incompatible units are an error."""
    one, two = parse(source), parse(target)
    if one[0] != two[0]:
        raise ValueError(f"{source!r} cannot be converted to {target!r}")
    return one[1] / two[1], (one[2] - two[2]) / two[1]


def convert(column: Column, source: str, target: str) -> Column:
    m, b = components(source, target)
    return column if (m, b) == (1.0, 0.0) else column * m + b


def units_of(df: DataFrame, column: str) -> str | None:
    return (df.schema[column].metadata or {}).get("units")


def check_and_convert(df: DataFrame, names: dict[str, str], look: bool = True) -> DataFrame:
    """Bring columns {column: quantity} to the expected units.

    A column without units gets the expected ones if all its values lie in the quantity's
    range; one pass finds the ranges of all such columns.  Without ``look`` they are not checked.
    """
    bare = {c: q for c, q in names.items() if look and not units_of(df, c) and q in EXPECTED_RANGE}
    ranges = df.agg(*[f(c).alias(f"{k}_{c}") for c in bare for k, f in (("lo", F.min), ("hi", F.max))]).first() if bare else None
    out = {}
    for c, quantity in names.items():
        wanted, meta = EXPECTED_UNITS[quantity], dict(df.schema[c].metadata or {})
        column = F.col(c)
        if c in bare:
            low, high = EXPECTED_RANGE[quantity]
            if ranges[f"lo_{c}"] is not None and not (low <= ranges[f"lo_{c}"] and ranges[f"hi_{c}"] <= high):
                raise ValueError(f"{c} has no units and values outside those of {quantity}")
        elif meta.get("units"):
            column = convert(column, meta["units"], wanted)
        out[c] = column.alias(c, metadata={**meta, "units": wanted})
    return df.select(*[out.get(c, F.col(c)) for c in df.columns])
