"""Spectra, spatial filters, vorticity, divergence and Helmholtz parts.

The dense transforms run once per map in a grouped Arrow kernel; a map never spans tasks.
``low_degree_spectrum`` is the same as two aggregates; only its table of functions is made in Python.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zonalis.functions import cf
from zonalis.functions import healpix as hp
from zonalis.operators import harmonics as sh
from zonalis.operators.grid import small

RADIUS_M = hp.RADIUS_SPECTRAL_KM * 1000


def _maps(field: DataFrame, nside: int, keys: list[str], values: list[str], out: dict[str, str], kernel: Callable) -> DataFrame:
    """Apply ``kernel(list of maps)`` to every slice; maps have NaN where a cell is missing or null."""
    size = hp.npix(nside)
    names = [*keys, *out]

    def run(table: pa.Table) -> pa.Table:
        cell = table["cell"].to_numpy()
        maps = []
        for v in values:
            full = np.full(size, np.nan)
            full[cell] = table[v].to_numpy().astype(float)
            maps.append(full)
        columns = kernel(maps)
        rows = len(next(iter(columns.values())))
        made = {k: pa.array([table[k][0].as_py()] * rows, table[k].type) for k in keys}
        for name, values_ in columns.items():
            array = np.asarray(values_)
            made[name] = pa.array(array, from_pandas=True) if array.dtype.kind == "f" else pa.array(array)
        return pa.table({n: made[n] for n in names})

    schema = ", ".join([*(f"{k} {field.schema[k].dataType.simpleString()}" for k in keys), *(f"{k} {t}" for k, t in out.items())])
    own = field.select(*keys, F.col("cell").cast("long").alias("cell"), *[F.col(v).cast("double").alias(v) for v in values]).filter("cell is not null")
    return own.groupBy(*keys).applyInArrow(run, schema) if keys else own.groupBy(F.lit(0)).applyInArrow(run, schema)


def _filled(x: np.ndarray, zero: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The map with gaps at its mean (or zero), and where the gaps were."""
    gap = ~np.isfinite(x)
    if gap.all():
        return np.zeros_like(x), gap
    return np.where(gap, 0.0 if zero else x[~gap].mean(), x), gap


def spectrum(field: DataFrame, nside: int, keys: list[str], values: list[str], kind: str = "power", lmax: int | None = None, iterations: int = 3) -> DataFrame:
    """keys, l, wavelength_km and power of every degree.

    ``kind`` is power (one variable), cross (two), kinetic (winds u, v) or kinetic-scalar
    (divergence, vorticity).  Gaps take the slice's mean; a slice without a value has null power.
    """
    top = lmax if lmax is not None else 3 * nside - 1

    def kernel(maps):
        gone = any((~np.isfinite(x)).all() for x in maps)
        filled = [_filled(x)[0] for x in maps]
        degree = np.arange(top + 1)
        if gone:
            cl = np.full(top + 1, np.nan)
        elif kind == "kinetic":
            e, b = sh.vector_analysis(*filled, nside, top)
            cl = (sh.power(e) + sh.power(b)) / 2
        else:
            alms = [sh.analysis(x, nside, top, iterations) for x in filled]
            if kind == "kinetic-scalar":
                total = sh.power(alms[0]) + sh.power(alms[1])
                cl = np.where(degree > 0, RADIUS_M**2 * total / (2 * np.maximum(degree * (degree + 1.0), 1)), 0.0)
            else:
                cl = sh.power(*alms[:2])
        return {"l": degree.astype(np.int32), "power": cl}

    out = _maps(field, nside, keys, values, {"l": "int", "power": "double"}, kernel)
    return out.select(*keys, "l", hp.wavelength_km(F.greatest("l", F.lit(1))).alias("wavelength_km"), "power")


def kinetic_kind(units: str | None, name: str) -> str:
    """Whether a first variable means winds, or divergence and vorticity."""
    return "kinetic-scalar" if units in ("s-1", "s^-1", "1/s") or name.lower() in ("div", "divergence", "vor", "vorticity") else "kinetic"


def kinetic_variables(df: DataFrame, names: list[str] | None = None) -> tuple[list[str], str]:
    """The two variables of a kinetic spectrum and its kind: those named, else winds, else divergence and vorticity."""
    if not names:
        pairs = ([cf.find_variable(df, q) for q in two] for two in (("u", "v"), ("divergence", "vorticity")))
        names = next((p for p in pairs if all(p)), None)
        if names is None:
            raise KeyError("no columns are winds, or divergence and vorticity")
    return names, kinetic_kind(cf.attributes(df, names[0]).get("units"), names[0])


def filter_maps(field: DataFrame, nside: int, keys: list[str], values: list[str], *, fwhm_deg: float | None = None, lmax: int | None = None, wavelength_km: float | None = None, iterations: int = 3) -> DataFrame:
    """Gaussian smoothing, or cutting off degrees above lmax or of shorter wavelength; exactly one is given."""
    if sum(x is not None for x in (fwhm_deg, lmax, wavelength_km)) != 1:
        raise ValueError("exactly one of fwhm_deg, lmax and wavelength_km is needed")
    top = 3 * nside - 1
    if wavelength_km is not None:
        q = (2 * math.pi * hp.RADIUS_SPECTRAL_KM / wavelength_km) ** 2
        lmax = int((math.sqrt(1 + 4 * q) - 1) / 2)
    weight = sh.gaussian(top, fwhm_deg) if fwhm_deg is not None else (np.arange(top + 1) <= lmax).astype(float)

    def kernel(maps):
        out = {"cell": np.arange(hp.npix(nside))}
        for value, own in zip(values, maps, strict=True):
            x, gap = _filled(own)
            out[value] = np.where(gap, np.nan, sh.synthesis(sh.analysis(x, nside, top, iterations) * weight[:, None], nside))
        return out

    return _maps(field, nside, keys, values, {"cell": "long", **dict.fromkeys(values, "double")}, kernel)


def filter_map(field: DataFrame, nside: int, keys: list[str], value: str, **options) -> DataFrame:
    """filter_maps of one column."""
    return filter_maps(field, nside, keys, [value], **options)


def vorticity_divergence(field: DataFrame, nside: int, keys: list[str], u: str = "u", v: str = "v", lmax: int | None = None) -> DataFrame:
    """Relative vorticity (positive for westerly solid rotation in the north) and divergence; gaps count as calm."""
    top = lmax if lmax is not None else 3 * nside - 1
    fl = np.sqrt(np.arange(top + 1) * (np.arange(top + 1) + 1.0))[:, None]

    def kernel(maps):
        (a, gap_a), (b, gap_b) = _filled(maps[0], True), _filled(maps[1], True)
        e, c = sh.vector_analysis(a, b, nside, top)
        gap = gap_a | gap_b
        made = {"vorticity": sh.synthesis(-fl * c / RADIUS_M, nside), "divergence": sh.synthesis(-fl * e / RADIUS_M, nside)}
        return {"cell": np.arange(len(a)), **{k: np.where(gap, np.nan, x) for k, x in made.items()}}

    return _maps(field, nside, keys, [u, v], {"cell": "long", "vorticity": "double", "divergence": "double"}, kernel)


def winds(field: DataFrame, nside: int, keys: list[str], divergence: str = "divergence", vorticity: str = "vorticity", lmax: int | None = None, iterations: int = 3) -> DataFrame:
    """Winds of a divergence and a vorticity."""
    top = lmax if lmax is not None else 3 * nside - 1
    l = np.arange(top + 1)
    scale = np.where(l > 0, -RADIUS_M / np.sqrt(np.maximum(l * (l + 1.0), 1)), 0.0)[:, None]

    def kernel(maps):
        (d, gap_d), (z, gap_z) = _filled(maps[0], True), _filled(maps[1], True)
        u, v = sh.vector_synthesis(scale * sh.analysis(d, nside, top, iterations), scale * sh.analysis(z, nside, top, iterations), nside)
        gap = gap_d | gap_z
        return {"cell": np.arange(len(u)), "u": np.where(gap, np.nan, u), "v": np.where(gap, np.nan, v)}

    return _maps(field, nside, keys, [divergence, vorticity], {"cell": "long", "u": "double", "v": "double"}, kernel)


def helmholtz(field: DataFrame, nside: int, keys: list[str], u: str = "u", v: str = "v", lmax: int | None = None) -> DataFrame:
    """Rotational and divergent winds, stream function psi and velocity potential chi."""
    top = lmax if lmax is not None else 3 * nside - 1
    l = np.arange(top + 1)
    inverse = np.where(l > 0, RADIUS_M / np.sqrt(np.maximum(l * (l + 1.0), 1)), 0.0)[:, None]
    out = ["u_rot", "v_rot", "u_div", "v_div", "psi", "chi"]

    def kernel(maps):
        (a, gap_a), (b, gap_b) = _filled(maps[0], True), _filled(maps[1], True)
        e, c = sh.vector_analysis(a, b, nside, top)
        none = np.zeros_like(e)
        parts = [*sh.vector_synthesis(none, c, nside), *sh.vector_synthesis(e, none, nside), sh.synthesis(inverse * c, nside), sh.synthesis(inverse * e, nside)]
        gap = gap_a | gap_b
        return {"cell": np.arange(len(a)), **{k: np.where(gap, np.nan, x) for k, x in zip(out, parts, strict=True)}}

    return _maps(field, nside, keys, [u, v], {"cell": "long", **dict.fromkeys(out, "double")}, kernel)


def ring_fourier(field: DataFrame, nside: int, keys: list[str], value: str, orders: list[int]) -> DataFrame:
    """keys, ring, m, a, b: 2/N sums of value times cos and sin of m longitude; for m = 0 the mean and 0."""
    angle = F.radians(hp.turn_of(F.col("cell"), nside) * 90.0) * F.col("m")
    rows = field.filter(F.col(value).isNotNull()).withColumns({"ring": hp.ring_of(F.col("cell"), nside), "m": F.explode(F.array(*map(F.lit, orders)))})
    size = hp.ring_size(F.col("ring"), nside)
    factor = F.when(F.col("m") == 0, 1.0).otherwise(2.0) / size
    sums = rows.groupBy(*keys, "ring", "m").agg(F.sum(F.col(value) * F.cos(angle)).alias("c"), F.sum(F.col(value) * F.sin(angle)).alias("s"))
    return sums.select(*keys, "ring", "m", (F.col("c") * factor).alias("a"), F.when(F.col("m") == 0, 0.0).otherwise(F.col("s") * factor).alias("b"))


def legendre_table(spark: SparkSession, nside: int, lmax: int) -> DataFrame:
    """l, m, ring, lambda of all functions up to ``lmax``: made order by order on the executors, marked for broadcast if small."""

    def made(batches):
        for batch in batches:
            for m in batch["m"].to_pylist():
                own = sh.legendre(nside, lmax, m)
                l, ring = np.indices(own.shape, dtype=np.int64)
                yield pa.RecordBatch.from_pydict({"l": pa.array((l + m).ravel(), pa.int32()), "m": pa.array(np.full(own.size, m), pa.int32()), "ring": pa.array((ring + 1).ravel()), "lambda": pa.array(own.ravel())})

    orders = spark.range(0, lmax + 1, 1, min(lmax + 1, 64)).select(F.col("id").cast("int").alias("m"))
    return small(orders.mapInArrow(made, "l int, m int, ring long, lambda double"), (lmax + 1) * (lmax + 2) // 2 * (4 * nside - 1))


def low_degree_spectrum(field: DataFrame, nside: int, keys: list[str], value: str, lmax: int, other: str | None = None) -> DataFrame:
    """Power (or cross power with ``other``) of the degrees up to ``lmax`` in one pass without refinement.

    Two aggregates: Fourier sums of the rings, then Legendre sums over rings against a
    table of (lmax + 1)(lmax + 2)/2 functions at 4 nside - 1 rings, which is broadcast if it is small.
    """
    table = legendre_table(field.sparkSession, nside, lmax)
    names = [value] if other is None else [value, other]
    means = {f"_{v}": F.mean(v).over(W.partitionBy(*keys)) for v in names}
    filled = dense(field, nside, keys).withColumns(means).withColumns({v: F.coalesce(v, f"_{v}") for v in names})
    parts = []
    for v in names:
        own = ring_fourier(filled, nside, keys, v, list(range(lmax + 1)))
        size = hp.ring_size(F.col("ring"), nside) / F.when(F.col("m") == 0, 1.0).otherwise(2.0) * (4 * math.pi / hp.npix(nside))
        parts.append(own.join(table, ["ring", "m"]).groupBy(*keys, "l", "m").agg(F.sum(F.col("a") * size * F.col("lambda")).alias(f"re_{v}"), F.sum(-F.col("b") * size * F.col("lambda")).alias(f"im_{v}")))
    alm = parts[0] if other is None else parts[0].join(parts[1], [*keys, "l", "m"])
    second = other or value
    product = F.col(f"re_{value}") * F.col(f"re_{second}") + F.col(f"im_{value}") * F.col(f"im_{second}")
    return alm.groupBy(*keys, "l").agg((F.sum(F.when(F.col("m") == 0, product).otherwise(2 * product)) / (2 * F.col("l") + 1)).alias("power"))


def dense(field: DataFrame, nside: int, keys: list[str]) -> DataFrame:
    """The field with a row for every cell of every slice; values of missing cells are null."""
    cells = field.sparkSession.range(hp.npix(nside)).withColumnRenamed("id", "cell")
    slices = field.select(*keys).distinct() if keys else field.sparkSession.range(1).select()
    # The product is the full field itself.
    return slices.crossJoin(small(cells, hp.npix(nside))).join(field, [*keys, "cell"], "left")
