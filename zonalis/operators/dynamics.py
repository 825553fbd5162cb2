"""Eddy covariances, gradients, vertical structure and Eliassen-Palm flux on zonal means.

Zonal fields have keys (such as time), a vertical axis, lat in degrees, and one column
for each mean.  Every step is a window or an expression; a point whose neighbours are missing is
missing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zonalis.functions import cf, units
from zonalis.functions import healpix as hp

#: Physical constants in SI units.
RADIUS, OMEGA, GRAVITY, R_DRY, CP = 6.371e6, 7.292e-5, 9.80665, 287.05, 1004.64
KAPPA = R_DRY / CP
P_SURFACE, P_TOP, RHO_SURFACE, HEIGHT = 1.0e5, 1.0, 1.225, 7000.0
DAY = 86400.0


#: Standard pressure levels in Pa (fixed values).
STANDARD_LEVELS = [
    100000, 92500, 85000, 70000, 60000, 50000, 40000, 30000, 25000, 20000, 15000, 10000, 7000, 5000, 3000, 2000, 1000,
    700, 500, 300, 200, 100, 70, 50, 30, 20, 10, 1, 0.1, 0.01, 0.001, 0.0001, 0.00001,
]


def standard_levels(low: float, high: float) -> list[float]:
    """The standard levels from half of ``low`` to 1.1 times ``high``."""
    return [float(p) for p in STANDARD_LEVELS if 0.5 * low <= p <= 1.1 * high]


def eddy_covariances(field: DataFrame, nside: int, keys: list[str], pairs: list[tuple[str, str]], means: list[str], cell: str = "cell") -> DataFrame:
    """Ring means of ``means`` and of the products of departures from them, one column a_b for each pair.

    Every variable departs from its own ring mean, so missing cells of one do not
    move the mean of another; the departures' products are averaged where both are present.
    """
    ringed = field.withColumn("ring", hp.ring_of(F.col(cell), nside))
    by = [*keys, "ring"]
    names = sorted({v for p in pairs for v in p} | {*means})
    sums = [F.avg(v).alias(v) for v in names]
    for a, b in pairs:
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        sums += [F.avg(F.col(a) * F.col(b)).alias(f"_{a}_{b}"), F.avg(F.when(both, F.col(a))).alias(f"_{a}_{b}_a"), F.avg(F.when(both, F.col(b))).alias(f"_{a}_{b}_b")]
    # mean((a - A)(b - B)) over common cells = mean(ab) - A mean(b) - B mean(a) + A B, in one pass.
    out = ringed.groupBy(*by).agg(*sums)
    products = [(F.col(f"_{a}_{b}") - F.col(a) * F.col(f"_{a}_{b}_b") - F.col(b) * F.col(f"_{a}_{b}_a") + F.col(a) * F.col(b)).alias(f"{a}_{b}") for a, b in pairs]
    return out.select(*by, F.degrees(F.asin(hp.ring_z(F.col("ring"), nside))).alias("lat"), *means, *products)


def with_gradients(field: DataFrame, axis: str, keys: list[str], values: dict[str, Column], scale: float = 1.0) -> DataFrame:
    """Second-order derivatives, times ``scale``, of the columns ``values`` along an uneven axis.

    They are one-sided at the ends, and null beside a missing value.  All share one window, and each
    neighbour is looked up once.
    """
    w = W.partitionBy(*keys).orderBy(axis)
    shift = lambda c, k: F.lead(c, k).over(w) if k > 0 else F.lag(c, -k).over(w)
    own = {f"_f{i}_0": c for i, c in enumerate(values.values())}
    steps = {-2: "b2", -1: "b1", 1: "a1", 2: "a2"}
    near = {f"_x_{n}": shift(F.col(axis), k) for k, n in steps.items()}
    near |= {f"_f{i}_{n}": shift(F.col(f"_f{i}_0"), k) for i in range(len(values)) for k, n in steps.items()}
    rows = field.withColumns(own).withColumns(near)
    x = {0: F.col(axis), **{k: F.col(f"_x_{n}") for k, n in steps.items()}}
    a, b, c, d = x[0] - x[-1], x[1] - x[0], x[2] - x[1], x[-1] - x[-2]
    out = {}
    for i, name in enumerate(values):
        f = {0: F.col(f"_f{i}_0"), **{k: F.col(f"_f{i}_{n}") for k, n in steps.items()}}
        inner = (a * a * f[1] + (b * b - a * a) * f[0] - b * b * f[-1]) / (a * b * (a + b))
        first = -(2 * b + c) / (b * (b + c)) * f[0] + (b + c) / (b * c) * f[1] - b / (c * (b + c)) * f[2]
        last = a / (d * (a + d)) * f[-2] - (a + d) / (a * d) * f[-1] + (2 * a + d) / (a * (a + d)) * f[0]
        out[name] = F.when(x[-1].isNull(), first).when(x[1].isNull(), last).otherwise(inner) * scale
    return rows.withColumns(out).drop(*own, *near)


def with_gradient(field: DataFrame, value: str, axis: str, keys: list[str], into: str) -> DataFrame:
    return with_gradients(field, axis, keys, {into: F.col(value)})


#: Derivatives by degrees of latitude to derivatives by radians.
PER_DEGREE = 180 / math.pi


def potential_temperature(t: Column, p: Column) -> Column:
    return t * F.pow(P_SURFACE / p, F.lit(KAPPA))


def potential_temperature_height(t: Column, z: Column, height: Column) -> Column:
    return t * F.exp(KAPPA * z / height)


def coriolis(lat: Column) -> Column:
    return 2 * OMEGA * F.sin(F.radians(lat))


def gravity(height: Column) -> Column:
    """Gravity at a geometric height in metres."""
    return GRAVITY * F.pow(RADIUS / (RADIUS + height), F.lit(2.0))


def geometric_height(geopotential: Column) -> Column:
    """Geometric height of a geopotential in m2/s2."""
    h = geopotential / GRAVITY
    return RADIUS * h / (RADIUS - h)


def scale_height(field: DataFrame, pressure: str, height: str) -> DataFrame:
    """One row: the scale height from the regression of log p on height, 1000 m at least."""
    slope = F.regr_slope(F.log(pressure), height)
    return field.agg(F.greatest(F.try_divide(F.lit(-1.0), slope), F.lit(1000.0)).alias("scale_height"))


def density(t: Column | None = None, p: Column | None = None, height: Column | None = None) -> Column:
    """p / (R T), or an exponential atmosphere of the height."""
    return p / (R_DRY * t) if p is not None and t is not None else RHO_SURFACE * F.exp(-height / HEIGHT)


def hydrostatic_pressure(field: DataFrame, rho: str, height: str, keys: list[str], into: str = "pressure") -> DataFrame:
    """Pressure from density by trapezoids from the top down, starting at P_TOP."""
    down = W.partitionBy(*keys).orderBy(F.col(height).desc())
    layer = (F.col(rho) + F.lag(rho).over(down)) / 2 * GRAVITY * (F.lag(height).over(down) - F.col(height))
    rows = field.withColumn("_layer", F.coalesce(layer, F.lit(0.0)))
    return rows.withColumn(into, P_TOP + F.sum("_layer").over(down.rowsBetween(W.unboundedPreceding, 0))).drop("_layer")


def floored(c: Column, least: float = 1e-10) -> Column:
    """A stability of at least ``least`` in size, its sign kept."""
    return F.when(F.abs(c) >= least, c).otherwise(F.when(c < 0, -least).otherwise(least))


def omega_from_w(w: Column, rho: Column, g: Column) -> Column:
    return -rho * g * w


def ep_mode(mode: str, has_vertical: bool) -> str:
    """The mode that ``auto`` stands for: full with a vertical momentum flux, else tem."""
    return mode if mode != "auto" else "full" if has_vertical else "tem"


def _absolute(mode: str, field: DataFrame) -> Column:
    """The factor of heat flux: f alone for qg, else with the mean vorticity, given as vor or from u."""
    return F.col("f") if mode == "qg" else F.col("f") + F.col("vor") if "vor" in field.columns else F.col("f") - F.col("shear")


def ep_flux_pressure(field: DataFrame, mode: str, keys: list[str], level: str = "level", lat: str = "lat") -> DataFrame:
    """F_phi, F_p, v_star and omega_star on pressure levels in Pa.

    Needs u, theta, upvp, vpthetap and, for mode full, upomegap.
    """
    mode = ep_mode(mode, "upomegap" in field.columns)
    cos = F.cos(F.radians(lat))
    rows = with_gradients(field, level, [*keys, lat], {"u_p": F.col("u"), "theta_p": F.col("theta")})
    rows = with_gradients(rows, lat, [*keys, level], {"shear": F.col("u") * cos}, PER_DEGREE / RADIUS)
    rows = rows.withColumns({"f": coriolis(F.col(lat)), "shear": F.col("shear") / cos, "flux": F.col("vpthetap") / floored(F.col("theta_p"))})
    f_hat = _absolute(mode, field)
    f_phi = -F.col("upvp") if mode == "qg" else F.col("u_p") * F.col("flux") - F.col("upvp")
    vertical = F.col("upomegap") if mode == "full" else F.lit(0.0)
    rows = rows.withColumns({"f_phi": RADIUS * cos * f_phi, "f_z": RADIUS * cos * (f_hat * F.col("flux") - vertical)})
    rows = with_gradients(rows, level, [*keys, lat], {"v_star": -F.col("flux")})
    rows = with_gradients(rows, lat, [*keys, level], {"w_star": F.col("flux") * cos}, PER_DEGREE / RADIUS)
    return rows.withColumn("w_star", F.col("w_star") / cos).drop("shear", "flux", "f", "u_p", "theta_p")


def ep_flux_height(field: DataFrame, mode: str, keys: list[str], level: str = "level", lat: str = "lat") -> DataFrame:
    """F_phi, F_z and the stream function psi on heights in metres; needs u, theta, rho, upvp, vpthetap,
    and wpthetap and upwp for mode full.
    """
    mode = ep_mode(mode, "upwp" in field.columns)
    cos = F.cos(F.radians(lat))
    rows = with_gradients(field, level, [*keys, lat], {"u_z": F.col("u"), "theta_z": F.col("theta")})
    rows = with_gradients(rows, lat, [*keys, level], {"shear": F.col("u") * cos, "theta_y": F.col("theta")}, PER_DEGREE / RADIUS)
    rows = rows.withColumns({"f": coriolis(F.col(lat)), "shear": F.col("shear") / cos, "theta_z": floored(F.col("theta_z"))})
    heat = F.col("wpthetap") if mode == "full" and "wpthetap" in field.columns else F.lit(0.0)
    steep = F.greatest(F.col("theta_y") * F.col("theta_y") + F.col("theta_z") * F.col("theta_z"), F.lit(1e-30))
    rows = rows.withColumn("psi", RADIUS * cos * F.col("rho") * (F.col("vpthetap") * F.col("theta_z") - heat * F.col("theta_y")) / steep)
    f_hat = _absolute(mode, field)
    turn = F.lit(0.0) if mode == "qg" else F.col("psi") * F.col("u_z")
    lift = F.col("upwp") if mode == "full" else F.lit(0.0)
    rows = rows.withColumns({"f_phi": -F.col("rho") * RADIUS * cos * F.col("upvp") + turn, "f_z": -F.col("rho") * RADIUS * cos * lift + F.col("psi") * f_hat})
    return rows.drop("shear", "f", "u_z", "theta_z", "theta_y")


def ep_divergence(flux: DataFrame, keys: list[str], level: str = "level", lat: str = "lat", rho: str | None = None, edge: bool = True) -> DataFrame:
    """Divergence of (f_phi, f_z) and the acceleration a_ep in m/s per day.

    ``rho`` names the density on heights; without it the axis is pressure.  With ``edge``, points next to
    one without a divergence, in level or latitude, lose theirs.
    """
    cos = F.cos(F.radians(lat))
    rows = with_gradients(flux, lat, [*keys, level], {"_side": F.col("f_phi") * cos}, PER_DEGREE / RADIUS)
    rows = with_gradients(rows, level, [*keys, lat], {"_up": F.col("f_z")})
    rows = rows.withColumn("divergence", F.col("_side") / cos + F.col("_up"))
    if edge:
        beside = F.lit(False)
        for w in (W.partitionBy(*keys, lat).orderBy(level), W.partitionBy(*keys, level).orderBy(lat)):
            for shift in (F.lag, F.lead):
                inside = shift(F.lit(1)).over(w).isNotNull()
                beside = beside | (inside & shift("divergence").over(w).isNull())
        rows = rows.withColumn("_gap", beside).withColumn("divergence", F.when(~F.col("_gap"), F.col("divergence"))).drop("_gap")
    mass = F.col(rho) if rho else F.lit(1.0)
    return rows.withColumn("a_ep", F.col("divergence") / (mass * RADIUS * cos) * DAY).drop("_side", "_up")


def masked(ep: DataFrame, level: str = "level", least_pressure: float | None = None, greatest_height: float | None = None) -> DataFrame:
    """Blank what lies outside the range of validity."""
    ok = F.lit(True)
    if least_pressure is not None:
        ok = ok & (F.col(level) >= least_pressure)
    if greatest_height is not None:
        ok = ok & (F.col(level) <= greatest_height)
    return ep.withColumns({c: F.when(ok, F.col(c)) for c in ("f_phi", "f_z", "divergence", "a_ep") if c in ep.columns})


def with_theta(field: DataFrame, level: str, vertical: str = "pressure") -> DataFrame:
    """Potential temperature from temp and pres, from temp and a pressure axis, or from temp and height."""
    if "theta" in field.columns:
        return field
    t = F.col("temp")
    if "pres" in field.columns:
        theta = potential_temperature(t, F.col("pres"))
    elif vertical == "pressure":
        theta = potential_temperature(t, F.col(level))
    else:
        theta = potential_temperature_height(t, F.col(level), R_DRY * t / GRAVITY)
    return field.withColumn("theta", theta)


def pressure_of(temp: Column, theta: Column) -> Column:
    return P_SURFACE * F.pow(temp / theta, F.lit(1 / KAPPA))


def to_standard_levels(field: DataFrame, keys: list[str], values: list[str], pressure: str = "pres", level: str = "level", cell: str = "cell") -> DataFrame:
    """Model levels to the standard pressure levels in the range of ``pressure``, linear in its logarithm."""
    from zonalis.operators.regrid import interpolate_axis

    low, high = field.agg(F.min(pressure), F.max(pressure)).first()
    if low is None:
        raise ValueError(f"{pressure} has no values")
    targets = [math.log(p) for p in standard_levels(low, high)]
    out = interpolate_axis(field.filter(F.col(pressure) > 0), level, [*keys, cell], values, targets, F.log(pressure))
    return out.withColumn(level, F.round(F.exp(level), 8))


#: Inputs of the chain: the quantity of the CF rules that finds each, and the one its units are those of.
INPUTS = {"u": ("u", "u"), "v": ("v", "v"), "w": ("w", "w"), "temp": ("temperature", "temp"), "theta": ("theta", "theta"), "pres": ("pressure", "pres"), "vor": ("vorticity", "vorticity")}
#: Names of geometric heights, and of geopotential or its height (fixed values).
GEOMETRIC = ("z_geom", "altitude", "height_geom")
GEOPOTENTIAL = ("z", "geopot", "geopotential", "zg", "geopotential_height")


def canonical(field: DataFrame, keys: list[str], check: bool = False) -> DataFrame:
    """The field with the chain's names, found by alias, standard name or units, and in SI units.

    A vertical velocity in pressure over time is omega.  Columns without units are taken as SI; with ``check``
    one pass holds their values against the range of their quantity.
    """
    taken = {"omega"} & set(field.columns)
    names = {}
    for name, (quantity, _) in INPUTS.items():
        free = field.select(*[c for c in field.columns if c not in (*keys, *taken)])
        found = name if name in free.columns else cf.find_variable(free, quantity)
        if found is None:
            continue
        taken.add(found)
        said = units.units_of(field, found)
        falls = name == "w" and said and units.compatible(said, "Pa/s")
        if falls and "omega" in field.columns:
            continue
        names[found] = "omega" if falls else name
    field = field.withColumnsRenamed(names)
    kinds = {name: kind for name, (_, kind) in INPUTS.items()} | {"omega": "omega"}
    return units.check_and_convert(field, {c: kinds[c] for c in field.columns if c in kinds and c not in keys}, check)


def find_level(field: DataFrame, keys: list[str], level: str, cell: str = "cell") -> str:
    """The vertical axis: ``level`` if it is there, else what metadata or names tell."""
    return level if level in field.columns else cf.vertical_axis(field, [c for c in field.columns if c not in (*keys, cell)])


def vertical_kind(field: DataFrame, level: str) -> str:
    """height, pressure, or model for numbered or unknown levels with a pressure field of their own.

    Levels that nothing describes are pressures, unless they are mere numbers of layers, which is an error.
    """
    if cf.is_height(field, level) or cf.is_metres(field, level):
        return "height"
    if cf.is_pressure(field, level):
        return "pressure"
    if "pres" in field.columns:
        return "model"
    if cf.is_level_index(field, level):
        raise ValueError(f"{level} numbers layers, and there is no pressure field")
    return "pressure"


def si_level(field: DataFrame, level: str) -> DataFrame:
    """The axis in Pa or m, if its units say otherwise."""
    said = units.units_of(field, level)
    wanted = next((u for u in ("Pa", "m") if said and units.compatible(said, u)), None)
    if wanted is None:
        return field
    meta = {**field.schema[level].metadata, "units": wanted}
    return field.withColumn(level, units.convert(F.col(level), said, wanted).alias(level, metadata=meta))


def height_of(field: DataFrame) -> tuple[str, float] | None:
    """The column of a height, and what makes a geopotential of it (0 for a geometric height)."""
    for c in GEOMETRIC:
        if c in field.columns:
            return c, 0.0
    for c in GEOPOTENTIAL:
        if c in field.columns:
            said = units.units_of(field, c)
            return c, 1.0 if said and units.compatible(said, "m2 s-2") else GRAVITY
    return None


def destagger(field: DataFrame, half: DataFrame, keys: list[str], value: str = "w", level: str = "level", cell: str = "cell") -> DataFrame:
    """The field with ``value`` of half levels brought to its own levels, linear in the axis."""
    from zonalis.operators.compare import axis_values
    from zonalis.operators.regrid import interpolate_axis

    own = interpolate_axis(half, level, [*keys, cell], [value], axis_values(field, level))
    return field.drop(value).join(own, [*keys, level, cell], "left")


def _density(eddies: DataFrame, level: str, vertical: str) -> Column:
    """Ideal gas where temperature and pressure are known, else an exponential atmosphere."""
    have = set(eddies.columns)
    p = F.col(level) if vertical == "pressure" else F.col("pres") if "pres" in have else None
    if p is not None and "temp" in have:
        return density(F.col("temp"), p)
    if p is not None and vertical == "pressure":
        return density(F.col("theta") * F.pow(p / P_SURFACE, F.lit(KAPPA)), p)
    if p is None:
        return density(height=F.col(level))
    # Pressure but no temperature: one scale height of all profiles.
    fitted = scale_height(eddies, "pres", level).first()[0]
    return RHO_SURFACE * F.exp(-F.col(level) / (fitted or HEIGHT))


def _omega_flux(eddies: DataFrame, level: str, height: tuple[str, float] | None, surface: float) -> Column:
    """The flux of omega from that of w, with gravity at a known height or at the log-pressure height."""
    if height is None:
        scale = R_DRY * F.col("temp") / GRAVITY if "temp" in eddies.columns else F.lit(HEIGHT)
        z = -scale * F.log(F.col(level) / surface)
    else:
        name, factor = height
        z = geometric_height(F.col(name) * factor) if factor else F.col(name)
    return omega_from_w(F.col("upwp"), _density(eddies, level, "pressure"), F.coalesce(gravity(z), F.lit(GRAVITY)))


def eliassen_palm(
    field: DataFrame, nside: int, keys: list[str], level: str = "level", mode: str = "auto", time_mean: str | None = None, vertical: str = "auto", interpolate: bool | None = None,
    lmax: int | None = None, half: DataFrame | None = None, check: bool = False, least_pressure: float | None = None, greatest_height: float | None = None,
) -> DataFrame:
    """The whole chain: names and units, potential temperature, covariances, flux and its divergence.

    The field has u, v, temp (or theta) and may have omega, w, pres, vor and a height, under any name that
    ``canonical`` knows.  ``vertical`` is pressure or height, or auto to go by the axis; ``interpolate`` (by itself
    for levels that are neither but have a pressure) goes to standard pressure levels first.  ``half`` holds w on
    half levels.  ``lmax`` cuts off higher degrees of all inputs before they are multiplied.  What lies beyond
    ``least_pressure`` or ``greatest_height`` is blanked.
    """
    axis = find_level(field, keys, level)
    field = si_level(canonical(field, [*keys, axis, "cell"], check), axis)
    for needed in ("u", "v"):
        if needed not in field.columns:
            raise ValueError(f"no column is {needed}")
    if "theta" not in field.columns and "temp" not in field.columns:
        raise ValueError("potential temperature needs theta or temp")
    if half is not None:
        field = destagger(field, half, keys, level=axis)
    if vertical == "auto":
        kind = vertical_kind(field, axis) if not interpolate else "model"
        vertical, interpolate = ("pressure", True) if kind == "model" and interpolate is not False else ("pressure" if kind == "model" else kind, bool(interpolate))
    height = height_of(field.drop(axis, *keys))
    inputs = [c for c in ("u", "v", "w", "temp", "theta", "omega", "vor", *([height[0]] if height else [])) if c in field.columns]
    if interpolate:
        field, vertical = to_standard_levels(field, keys, inputs, level=axis), "pressure"
    rows = drop_empty(with_theta(field, axis, vertical), axis, "u")
    if vertical == "height" and "pres" not in rows.columns and "temp" in rows.columns:
        rows = rows.withColumn("pres", pressure_of(F.col("temp"), F.col("theta")))
    have = {"omega", "w", "temp", "pres", "vor"} & set(rows.columns)
    if lmax is not None:
        from zonalis.operators.spectral import filter_maps

        rows = filter_maps(rows, nside, [*keys, axis], [c for c in dict.fromkeys((*inputs, "theta", *sorted(have))) if c in rows.columns], lmax=lmax)
    pairs = [("u", "v"), ("v", "theta")]
    names = {"u_v": "upvp", "v_theta": "vpthetap"}
    means = ["u", "theta", *sorted(have & {"temp", "pres", "vor"}), *([height[0]] if height else [])]
    if vertical == "pressure" and "omega" in have:
        pairs.append(("u", "omega"))
        names["u_omega"] = "upomegap"
    elif "w" in have:
        pairs += [("u", "w"), ("w", "theta")]
        names |= {"u_w": "upwp", "w_theta": "wpthetap"}
    eddies = eddy_covariances(rows, nside, [*keys, axis], pairs, means).withColumnsRenamed(names)
    if vertical == "pressure":
        if "upwp" in eddies.columns:
            surface = 1.0 if height else field.agg(F.max(axis)).first()[0] or P_SURFACE
            eddies = eddies.withColumn("upomegap", _omega_flux(eddies, axis, height, surface))
        out = ep_divergence(ep_flux_pressure(eddies, mode, keys, axis), keys, axis)
        out = masked(out, axis, least_pressure=least_pressure)
    else:
        out = ep_divergence(ep_flux_height(eddies.withColumn("rho", _density(eddies, axis, vertical)), mode, keys, axis), keys, axis, rho="rho")
        out = masked(out, axis, greatest_height=greatest_height)
    if time_mean:
        rest = [k for k in keys if k != time_mean] + [axis, "ring", "lat"]
        out = out.groupBy(*rest).agg(*[F.avg(c).alias(c) for c in out.columns if c not in (*rest, time_mean)])
    return out


def drop_empty(field: DataFrame, level: str, value: str) -> DataFrame:
    from zonalis.operators.extract import drop_empty_levels

    return drop_empty_levels(field, level, value)


def half_to_full(field: DataFrame, keys: list[str], level: str, value: str) -> DataFrame:
    """Means of neighbouring half levels, at the middle of each pair."""
    up = W.partitionBy(*keys).orderBy(level)
    above = field.withColumns({"_v": F.lead(value).over(up), "_l": F.lead(level).over(up)}).filter("_l is not null")
    return above.select(*keys, ((F.col(level) + F.col("_l")) / 2).alias(level), ((F.col(value) + F.col("_v")) / 2).alias(value))
