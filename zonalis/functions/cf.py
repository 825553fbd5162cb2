"""Finding coordinates and variables by CF metadata of a schema.

Attributes live in the metadata of the schema's fields (``standard_name``, ``axis``, ``units``).
Rules run on the driver; only value ranges need a pass over the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zonalis.functions.healpix import is_valid_npix

#: What names each coordinate (fixed values).
COORDINATES = {
    "lon": {"names": ("lon", "long", "longitude", "clon"), "standard_names": ("longitude",), "axis": ("X",), "units": ("degrees_east", "degree_east")},
    "lat": {"names": ("lat", "latitude", "clat"), "standard_names": ("latitude",), "axis": ("Y",), "units": ("degrees_north", "degree_north")},
    "level": {
        "names": ("level", "lev", "height", "altitude", "plev", "z_mc"),
        "standard_names": (
            "altitude", "height", "depth", "geopotential_height", "height_above_geopotential_datum", "height_above_mean_sea_level", "height_above_reference_ellipsoid",
            "atmosphere_hybrid_height_coordinate", "atmosphere_sigma_coordinate", "atmosphere_sleve_coordinate", "air_pressure",
        ),
        "axis": ("Z", "vertical"), "units": ("meter", "m", "gpm", "pa", "hpa", "mb", "millibar"),
    },
    "time": {"names": ("time", "ts"), "standard_names": ("time",), "axis": ("T",), "units": ()},
}
#: What names each variable: aliases, standard names, units (fixed values).
VARIABLES = {
    "u": (("u", "ua", "U"), ("eastward_wind",), ("m s-1", "m/s")),
    "v": (("v", "va", "V"), ("northward_wind",), ("m s-1", "m/s")),
    "w": (("w", "wa", "wap"), ("upward_air_velocity", "vertical_velocity_in_air"), ("m s-1", "Pa s-1")),
    "pressure": (("pres", "pres_zm", "pressure", "pfull", "p"), ("air_pressure",), ("Pa", "pascal")),
    "temperature": (("temp", "temp_zm", "ta", "temperature", "t"), ("air_temperature",), ("K", "kelvin")),
    "density": (("rho", "rho0", "density"), ("air_density",), ("kg / m**3", "kg m-3")),
    "theta": (("theta", "theta_zm", "pot_temp", "pt"), ("air_potential_temperature",), ("K", "kelvin")),
    "divergence": (("div", "divergence"), ("divergence_of_wind",), ("s-1",)),
    "vorticity": (("vor", "vorticity", "zeta", "rel_vort"), ("relative_vorticity",), ("s-1",)),
}
METRES = frozenset(("m", "meter", "meters", "metre", "metres"))
PRESSURE_NAMES = frozenset(("plev", "pres", "pres_zm", "pressure", "isobaric"))
PRESSURE_STANDARD_NAMES = frozenset(("air_pressure", "atmosphere_ln_pressure_coordinate"))
PRESSURE_UNITS = frozenset(("pa", "pascal", "pascals", "hpa", "hectopascal", "hectopascals", "mb", "mbar", "millibar", "millibars", "bar"))
CELL_NAMES = ("cell", "cells", "ncells", "pix", "pixel", "i", "values")


def attributes(df: DataFrame, column: str) -> dict:
    return df.schema[column].metadata or {}


def find_coordinate(df: DataFrame, kind: str, required: bool = True) -> str | None:
    """The column of a coordinate: by name, then standard name, axis, units, and part of the name.

    More than one match of a rule is an error.
    """
    rule = COORDINATES[kind]
    tests = [
        lambda c, a: c.lower() in rule["names"],
        lambda c, a: a.get("standard_name") in rule["standard_names"],
        lambda c, a: a.get("axis") in rule["axis"],
        lambda c, a: kind != "level" and a.get("units", "").lower() in rule["units"],
        lambda c, a: any(c.lower().startswith(f"{n}_") or c.lower().endswith(f"_{n}") for n in rule["names"]),
    ]
    for test in tests:
        found = [c for c in df.columns if test(c, attributes(df, c))]
        if len(found) > 1 and test is not tests[-1]:
            exact = [c for c in found if c.lower() == rule["names"][0]]
            if len(exact) != 1:
                raise ValueError(f"several columns could be {kind}: {', '.join(found)}")
            return exact[0]
        if found:
            return found[0]
    if required:
        raise KeyError(f"no column is a {kind}")
    return None


def find_variable(df: DataFrame, quantity: str) -> str | None:
    """The column of a quantity: by alias, standard name, or units where no standard name says otherwise.

    A column whose name is another quantity's alias is never taken for this one.
    """
    aliases, standard_names, units = VARIABLES[quantity]
    for a in aliases:
        if a in df.columns:
            return a
    others = {a for q, (names, _, _) in VARIABLES.items() if q != quantity for a in names}
    free = [c for c in df.columns if c not in others]
    named = [c for c in free if attributes(df, c).get("standard_name") in standard_names]
    by_units = [c for c in free if attributes(df, c).get("units") in units and not attributes(df, c).get("standard_name")]
    return next(iter([*named, *by_units]), None)


def guess_variable(df: DataFrame, quantity: str, keys: list[str]) -> str:
    """find_variable, or the only column that is no key."""
    found = find_variable(df, quantity)
    rest = [c for c in df.columns if c not in keys]
    if found is None and len(rest) == 1:
        return rest[0]
    if found is None:
        raise KeyError(f"no column is a {quantity}")
    return found


def is_pressure(df: DataFrame, column: str) -> bool:
    a = attributes(df, column)
    return column.lower() in PRESSURE_NAMES or a.get("standard_name") in PRESSURE_STANDARD_NAMES or a.get("units", "").lower() in PRESSURE_UNITS


def is_metres(df: DataFrame, column: str) -> bool:
    return attributes(df, column).get("units", "").lower() in METRES


def is_height(df: DataFrame, column: str) -> bool:
    a = attributes(df, column)
    named = a.get("standard_name") in COORDINATES["level"]["standard_names"] and a.get("standard_name") != "air_pressure"
    return is_metres(df, column) and (named or a.get("axis") == "Z" or a.get("positive") in ("up", "down") or column.lower() in COORDINATES["level"]["names"])


def vertical_axis(df: DataFrame, keys: list[str]) -> str:
    """The vertical key: a height, then pressure by metadata, by name, then any level column."""
    tests = (lambda c: is_height(df, c), lambda c: attributes(df, c).get("standard_name") in PRESSURE_STANDARD_NAMES, lambda c: is_pressure(df, c), lambda c: attributes(df, c).get("axis") == "Z", lambda c: c.lower() in COORDINATES["level"]["names"])
    for test in tests:
        for c in keys:
            if test(c):
                return c
    raise KeyError("no key is a vertical axis")


def are_degrees(df: DataFrame, column: str) -> bool:
    """By units, else by size: angles beyond a full circle in radians are degrees."""
    units = attributes(df, column).get("units", "").lower()
    if units:
        return "deg" in units
    return (df.agg(F.max(F.abs(column))).first()[0] or 0) > 6.283185307179586


def is_geographic(df: DataFrame, lon: str, lat: str) -> bool:
    """Whether two columns can be longitude and latitude in degrees."""
    far = df.agg(F.max(F.abs(lat)), F.max(F.abs(lon))).first()
    return (far[0] or 0) <= 90.5 and (far[1] or 0) <= 400


def is_global_longitude(df: DataFrame, lon: str) -> bool:
    """Whether the largest gap between longitudes round the globe is at most 1.5 times the median gap."""
    turns = df.select((F.col(lon) - 360.0 * F.floor(F.col(lon) / 360.0)).alias("x")).distinct()
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)  # the distinct values of one axis
    gaps = turns.withColumns({"next": F.lead("x").over(W.orderBy("x")), "first": F.min("x").over(everything)})
    widest = gaps.select((F.coalesce("next", F.col("first") + 360.0) - F.col("x")).alias("gap")).agg(F.max("gap"), F.percentile("gap", 0.5)).first()
    return widest[0] is not None and widest[0] <= 1.5 * widest[1]


def is_level_index(df: DataFrame, level: str) -> bool:
    """Whether levels are mere numbers of layers: whole, and 500 at most."""
    most, broken = df.agg(F.max(level), F.max(F.abs(F.col(level) - F.bround(F.col(level))))).first()
    return most is not None and most <= 500 and broken == 0


def time_step_hours(df: DataFrame, time: str) -> float:
    """Median difference of neighbouring times."""
    steps = df.select(F.unix_micros(F.col(time).cast("timestamp")).alias("t")).distinct().withColumn("next", F.lead("t").over(W.orderBy("t")))
    return steps.agg(F.percentile((F.col("next") - F.col("t")) / 3.6e9, 0.5)).first()[0]


def cell_column(df: DataFrame) -> str | None:
    """The column of the cell index, by its usual names."""
    return next((c for n in CELL_NAMES for c in df.columns if c.lower() == n), None)


def horizontal(df: DataFrame, keys: list[str]) -> list[str]:
    """The columns that say where a row is: a cell, y and x, latitude and longitude, or the last two keys left.

    ``keys`` are the columns that are no values.  Times and vertical axes are never taken.
    """
    cell = cell_column(df)
    if cell and df.schema[cell].dataType.typeName() in ("byte", "short", "integer", "long"):
        return [cell]
    named = {c.lower(): c for c in df.columns}
    projected = [next((c for c in df.columns if attributes(df, c).get("standard_name") == f"projection_{d}_coordinate"), named.get(d)) for d in ("y", "x")]
    if all(projected):
        return projected
    round_earth = [find_coordinate(df, kind, required=False) for kind in ("lat", "lon")]
    if all(round_earth):
        return round_earth
    other = {find_coordinate(df, kind, required=False) for kind in ("time", "level")}
    rest = [c for c in keys if c not in other]
    if len(rest) < 2:
        raise ValueError(f"no horizontal columns among {', '.join(df.columns)}")
    return rest[-2:]


def usual_names(df: DataFrame) -> DataFrame:
    """``df`` with its longitude, latitude, cell, and y and x under those names; metadata stays."""
    found = {find_coordinate(df, kind, required=False): kind for kind in ("lon", "lat")}
    try:
        own = horizontal(df, [])
    except ValueError:
        own = []
    if len(own) == 1:
        found[own[0]] = "cell"
    elif own and not set(own) & set(found):
        found |= dict(zip(own, ("y", "x"), strict=True))
    return df.withColumnsRenamed({old: new for old, new in found.items() if old and old != new and new not in df.columns})


def order_of(meta: dict) -> str:
    """RING or NESTED from a mapping's attributes, then global ones; ring if neither says."""
    said = str(meta.get("healpix", {}).get("indexing_scheme") or meta.get("healpix_order") or meta.get("healpix_scheme") or "ring").lower()
    return "nested" if said.startswith("nest") else "ring"


def is_healpix(meta: dict, cells: int | None = None) -> bool:
    return "healpix" in meta or meta.get("grid_mapping_name") == "healpix" or "healpix_nside" in meta or (cells is not None and is_valid_npix(cells))
