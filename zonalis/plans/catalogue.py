"""Registered queries of the grid engine, over fields derived from the star schema.

``obs`` are scattered observations from events; ``field`` is a gridded field of
192 cells (nside 4) and seven levels from lineitem.  Keys are integer or rational
arithmetic.  The SQL of every query stands beside it in ``oracles``.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonalis.functions import cf, units
from zonalis.functions import healpix as hp
from zonalis.operators import compare as cp
from zonalis.operators import dynamics as dy
from zonalis.operators import extract, grid, interpolator, reduce, regrid, spectral, tides, wavelet
from zonalis.plans import figures, harmonic_oracles, oracles, source_oracles
from zonalis.sources import readers, writers
from zonalis.sources.stage import new_folder
from zonalis.streaming import zonal

NSIDE = 4
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable) -> Callable:
    _QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, time, value, z (sine of latitude), t (quarter turns of longitude), alt."""
    e = table(spark, sf_dir, "events")
    z = (2 * (F.col("event_id") % 997) + 1) / 997.0 - 1
    t = 4 * (F.col("user_id") % 151) / 151.0
    return e.select("event_id", F.col("ts").alias("time"), "value", z.alias("z"), t.alias("t"), (F.col("event_id") % 8).alias("alt"))


def field(spark: SparkSession, sf_dir: str, month: bool = False) -> DataFrame:
    """[time,] level, cell and means u, v, temp, omega."""
    rows = table(spark, sf_dir, "lineitem")
    keys = [F.col("l_linenumber").cast("double").alias("level"), (F.col("l_orderkey") % 192).alias("cell")]
    keys += [F.month("l_shipdate").cast("long").alias("time")] if month else []
    values = {"u": "l_quantity", "v": "l_tax", "temp": "l_extendedprice", "omega": "l_discount"}
    return rows.groupBy(*keys).agg(*[F.avg(c).alias(v) for v, c in values.items()])


def gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The field with every fifth cell missing, differently on each level."""
    gone = (F.col("cell") * 7 + F.col("level").cast("long") * 3) % 5 == 0
    return field(spark, sf_dir).withColumn("u", F.when(~gone, F.col("u")))


def points(spark: SparkSession, nside: int = NSIDE) -> DataFrame:
    return grid.grid(spark, nside).select(F.col("cell_ring").alias("cell"), "lon", "lat")


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Floating results rounded, and never a negative zero.

    A nudge far below the last digit keeps exact halves from going either way.
    """
    return df.withColumns({c: F.round(F.col(c) + 1.7e-3 * 10.0**-digits, digits) + F.lit(0.0) for c in columns})


def latitude(ring: str = "ring", nside: int = NSIDE) -> Column:
    return F.round(F.degrees(F.asin(hp.ring_z(F.col(ring), nside))), 6)


# Geometry ---------------------------------------------------------------------


@query
def ang2pix_ring(spark, sf_dir):
    return obs(spark, sf_dir).select("event_id", hp.pixel(F.col("z"), F.col("t"), 64).alias("cell"), hp.ring_at(F.col("z"), F.col("t"), 64).alias("ring"))


@query
def grid_table(spark, sf_dir):
    return rounded(grid.grid(spark, 8), "z", "lat", "lon")


@query
def pix2ang_ring(spark, sf_dir):
    cells = spark.range(hp.npix(8)).withColumnRenamed("id", "cell")
    c = F.col("cell")
    out = cells.select("cell", hp.ring_of(c, 8).alias("ring"), hp.ring_z(hp.ring_of(c, 8), 8).alias("z"), hp.turn_of(c, 8).alias("t"), hp.mirror(c, 8).alias("mirror"), hp.ring_start(hp.ring_of(c, 8), 8).alias("first"))
    return rounded(out, "z", "t")


@query
def ring_nest_reorder(spark, sf_dir):
    return rounded(grid.reorder(field(spark, sf_dir).select("level", "cell", "u"), NSIDE, "nest"), "u")


@query
def wavelength_table(spark, sf_dir):
    l = spark.range(0, 192).select(F.col("id").alias("l"))
    out = l.select("l", hp.wavelength_km(F.col("l")).alias("wavelength_km")).withColumn("degree", hp.degree_for(F.col("wavelength_km")))
    return rounded(out, "wavelength_km", "degree", digits=4)


# Reductions -------------------------------------------------------------------


@query
def zonal_mean(spark, sf_dir):
    rows = obs(spark, sf_dir)
    binned = rows.groupBy(hp.ring_at(F.col("z"), F.col("t"), NSIDE).alias("ring")).agg(F.avg("value").alias("value"), F.count("*").alias("n"))
    return rounded(binned.withColumn("lat", latitude()), "value")


@query
def zonal_mean_missing(spark, sf_dir):
    return rounded(reduce.zonal_mean(gappy(spark, sf_dir), NSIDE, ["level"], ["u", "temp"]), "lat", "u", "temp")


@query
def band_zonal_mean(spark, sf_dir):
    rows = obs(spark, sf_dir).withColumn("lat", F.col("z") * 90)
    return rounded(reduce.band_zonal_mean(rows, reduce.band_count(10_000), [], ["value"]), "lat", "value")


@query
def global_mean_coslat(spark, sf_dir):
    return rounded(reduce.coslat_mean(reduce.zonal_mean(gappy(spark, sf_dir), NSIDE, ["level"], ["u", "temp"]), ["level"], ["u", "temp"]), "u", "temp")


@query
def longitude_mean(spark, sf_dir):
    return rounded(reduce.plain_mean(regular(spark, sf_dir), ["level", "lat"], ["u"]), "u")


@query
def time_mean(spark, sf_dir):
    return rounded(reduce.plain_mean(field(spark, sf_dir, month=True), ["level", "cell"], ["u", "temp"]), "u", "temp")


@query
def swath_bin_mean(spark, sf_dir):
    return rounded(reduce.bin_swath(swath(spark, sf_dir), NSIDE, "value", z=F.col("z"), t=F.col("t"), level="alt"), "value")


@query
def swath_bin_ut(spark, sf_dir):
    hours = F.hour("time") + F.minute("time") / 60.0 + F.second("time") / 3600.0
    return rounded(reduce.bin_swath(swath(spark, sf_dir), NSIDE, "value", z=F.col("z"), t=F.col("t"), level="alt", bins=24, hours=hours), "value")


def swath(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations of which every eleventh is marked as missing."""
    return obs(spark, sf_dir).withColumn("value", F.when(F.col("event_id") % 11 == 0, -999.0).otherwise(F.col("value")))


@query
def circular_mean_phase(spark, sf_dir):
    rows = field(spark, sf_dir).withColumn("phase", F.col("v") * 10)
    return rounded(reduce.circular_mean(rows, ["level"], "phase", "u"), "phase", "u")


@query
def value_spread(spark, sf_dir):
    return rounded(reduce.spread(field(spark, sf_dir), ["level"], "temp"), "least", "greatest", "median", "p97")


# Extraction -------------------------------------------------------------------


@query
def extract_point(spark, sf_dir):
    return rounded(extract.point(field(spark, sf_dir), NSIDE, 30.0, 45.0), "u", "v", "temp", "omega")


@query
def nearest_cell(spark, sf_dir):
    return rounded(extract.nearest_cell(field(spark, sf_dir).select("level", "cell", "u"), points(spark), 12.0, 200.0), "u")


@query
def meridian_nearest(spark, sf_dir):
    return rounded(extract.meridian_nearest(points(spark), 33.0, 192, 37), "lat")


@query
def parallel_bilinear(spark, sf_dir):
    out = extract.along(field(spark, sf_dir), extract.parallel_targets(spark, NSIDE, 21.0), NSIDE, ["level"], ["u", "temp"])
    return rounded(out, "u", "temp", "lat", "lon")


@query
def meridian_bilinear(spark, sf_dir):
    return rounded(extract.along(field(spark, sf_dir), extract.meridian_targets(spark, NSIDE, 77.0), NSIDE, ["level"], ["u"]), "u", "lat", "lon")


@query
def nearest_levels(spark, sf_dir):
    return rounded(extract.nearest_levels(field(spark, sf_dir).select("level", "cell", "u"), "level", [1.4, 1.6, 6.5, 90.0]), "u")


@query
def level_range(spark, sf_dir):
    return rounded(extract.between(field(spark, sf_dir), "level", 2.0, 5.0).select("level", "cell", "u"), "u")


@query
def drop_empty_levels(spark, sf_dir):
    rows = field(spark, sf_dir).withColumn("u", F.when(F.col("level") != 3, F.col("u"))).select("level", "cell", "u")
    return rounded(extract.drop_empty_levels(rows, "level", "u"), "u")


# Regridding -------------------------------------------------------------------


@query
def regrade_down(spark, sf_dir):
    return rounded(grid.regrade(gappy(spark, sf_dir), NSIDE, 2, ["level"], ["u", "temp"]), "u", "temp")


@query
def regrade_up(spark, sf_dir):
    return rounded(grid.regrade(field(spark, sf_dir).select("level", "cell", "u"), NSIDE, 8, ["level"], ["u"]), "u")


def _fine(spark: SparkSession) -> DataFrame:
    return points(spark, 8).withColumnRenamed("cell", "target")


@query
def knn_idw(spark, sf_dir):
    weights = regrid.idw_weights(points(spark), _fine(spark), 3, radius=0.12)
    return rounded(regrid.apply_weights(gappy(spark, sf_dir), weights, ["level"], ["u", "temp"]), "u", "temp")


@query
def gap_fill_space(spark, sf_dir):
    return rounded(regrid.gaps(gappy(spark, sf_dir).select("level", "cell", "u"), points(spark), ["level"], "u"), "u")


@query
def gap_fill_time(spark, sf_dir):
    rows = field(spark, sf_dir, month=True).select("time", "level", "cell", "u")
    gone = (F.col("cell") + F.col("time")) % 4 < 2
    return rounded(regrid.time_gaps(rows.withColumn("u", F.when(~gone, F.col("u"))), "time", ["level", "cell"], "u"), "u")


def regular(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A regular grid of 15 by 24 points on all levels."""
    rows = table(spark, sf_dir, "lineitem")
    lat, lon = (F.col("l_orderkey") % 15) * 12.0 - 84.0, (F.col("l_partkey") % 24) * 15.0
    return rows.groupBy(F.col("l_linenumber").cast("double").alias("level"), lat.alias("lat"), lon.alias("lon")).agg(F.avg("l_quantity").alias("u"))


@query
def bilinear_regular(spark, sf_dir):
    return rounded(regrid.bilinear_regular(regular(spark, sf_dir), points(spark).withColumnRenamed("cell", "target"), ["level"], ["u"]), "u")


@query
def log_pressure_interp(spark, sf_dir):
    rows = field(spark, sf_dir).withColumn("p", 100000.0 / F.col("level"))
    targets = [float(x) for x in (100000, 50000, 40000, 20000, 15000, 10000)]
    out = regrid.interpolate_axis(rows, "logp", ["cell"], ["u", "temp"], [math.log(x) for x in targets], F.log("p"))
    return rounded(out, "logp", "u", "temp")


@query
def destagger(spark, sf_dir):
    return rounded(regrid.interpolate_axis(field(spark, sf_dir), "level", ["cell"], ["omega"], [0.5, 1.5, 2.5, 3.5, 4.5, 5.5, 6.5, 7.5]), "omega")


@query
def half_to_full(spark, sf_dir):
    return rounded(dy.half_to_full(field(spark, sf_dir), ["cell"], "level", "omega"), "omega")


# Comparison -------------------------------------------------------------------


def pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    f = field(spark, sf_dir)
    other = f.select("level", "cell", (F.col("temp") / 1500.0).alias("u"), (F.col("omega") * 0.8).alias("v"))
    return f.select("level", "cell", "u", "v"), other


_STATS = [c for c in cp.STATISTICS if c != "n"]


@query
def compare_stats(spark, sf_dir):
    ref, cmp = pair(spark, sf_dir)
    out = cp.compare(ref, cmp, ["u"], nside=NSIDE, keys=["level"], level=None, reduce="none")
    return rounded(out.drop("level"), *_STATS)


@query
def compare_by_level(spark, sf_dir):
    ref, cmp = pair(spark, sf_dir)
    return rounded(cp.compare(ref, cmp, ["u", "v"], nside=NSIDE, lat_range=(-60.0, 60.0)), *_STATS)


@query
def compare_vector(spark, sf_dir):
    ref, cmp = pair(spark, sf_dir)
    return rounded(cp.compare(ref, cmp, ["u", "v"], nside=NSIDE, reduce="none", vector=("u", "v")), *_STATS)


@query
def align_levels(spark, sf_dir):
    ref, cmp = pair(spark, sf_dir)
    shifted = cmp.withColumn("level", F.col("level") * 2 - 0.5)
    one, two = cp.align_axis(ref, shifted, "level", ["cell"], ["u"])
    return rounded(one.join(two.withColumnRenamed("u", "u_cmp"), ["cell", "level"]), "u", "u_cmp")


@query
def align_times(spark, sf_dir):
    f = field(spark, sf_dir, month=True).select("time", "level", "cell", "u")
    one, two = cp.align_time(f.filter("time <= 8"), f.filter("time >= 5"))
    return rounded(one.join(two.withColumnRenamed("u", "u_cmp"), ["time", "level", "cell"]), "u", "u_cmp")


# Dynamics ---------------------------------------------------------------------


@query
def eddy_covariance(spark, sf_dir):
    out = dy.eddy_covariances(gappy(spark, sf_dir), NSIDE, ["level"], [("u", "v"), ("v", "temp"), ("u", "omega")], ["u", "temp"])
    return rounded(out, "lat", "u", "temp", "u_v", "v_temp", "u_omega")


def _zonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.zonal_mean(field(spark, sf_dir), NSIDE, ["level"], ["u", "temp"])


@query
def gradient_latitude(spark, sf_dir):
    return rounded(dy.with_gradient(_zonal(spark, sf_dir), "u", "lat", ["level"], "u_y").select("level", "ring", "u_y"), "u_y")


@query
def gradient_level(spark, sf_dir):
    return rounded(dy.with_gradient(_zonal(spark, sf_dir), "temp", "level", ["ring"], "t_z").select("level", "ring", "t_z"), "t_z")


@query
def gravity_profile(spark, sf_dir):
    z = spark.range(0, 121).select((F.col("id") * 1000.0).alias("height"))
    out = z.select("height", dy.gravity(F.col("height")).alias("gravity"), dy.geometric_height(F.col("height") * dy.GRAVITY).alias("geometric"), dy.coriolis(F.col("height") / 2000.0).alias("f"))
    return out.withColumns({"gravity": F.round("gravity", 9), "geometric": F.round("geometric", 5), "f": F.round(F.col("f"), 12)})


@query
def hydrostatic_pressure(spark, sf_dir):
    z = spark.range(0, 61).select((F.col("id") * 1000.0).alias("height")).withColumn("rho", dy.density(height=F.col("height")))
    return dy.hydrostatic_pressure(z, "rho", "height", []).select("height", F.round("rho", 9).alias("rho"), F.round("pressure", 5).alias("pressure"))


@query
def scale_height(spark, sf_dir):
    rows = field(spark, sf_dir).select((F.col("level") * 1000.0 + F.col("u")).alias("z"), (100000.0 * F.exp(-F.col("level") / 7)).alias("p"))
    return rounded(dy.scale_height(rows, "p", "z"), "scale_height", digits=4)


def eddies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zonal means and covariances on pressure levels that look like an atmosphere's."""
    f = field(spark, sf_dir)
    rows = f.select((F.lit(100000.0) / F.col("level")).alias("level"), "cell", "u", (F.col("v") * 100).alias("v"), (F.col("temp") / 1000 + 300 * F.sqrt(F.col("level"))).alias("theta"), (F.col("omega") - 0.05).alias("omega"))
    names = {"u_v": "upvp", "v_theta": "vpthetap", "u_omega": "upomegap"}
    return dy.eddy_covariances(rows, NSIDE, ["level"], [("u", "v"), ("v", "theta"), ("u", "omega")], ["u", "theta"]).withColumnsRenamed(names)


def _flux(mode: str) -> Callable:
    def run(spark, sf_dir):
        out = dy.ep_flux_pressure(eddies(spark, sf_dir), mode, [])
        return out.select(F.round("level", 4).alias("level"), "ring", F.round(F.col("f_phi") / 1e6, 4).alias("f_phi"), F.round(F.col("f_z") / 1e6, 4).alias("f_z"), F.round("v_star", 6).alias("v_star"), F.round("w_star", 6).alias("w_star"))

    return run


for _mode in ("full", "tem", "qg"):
    _QUERIES[f"ep_flux_{_mode}"] = _flux(_mode)


@query
def ep_divergence(spark, sf_dir):
    out = dy.ep_divergence(dy.ep_flux_pressure(eddies(spark, sf_dir), "auto", []), [], edge=False)
    return out.select(F.round("level", 4).alias("level"), "ring", F.round("divergence", 3).alias("divergence"), F.round("a_ep", 3).alias("a_ep"))


@query
def ep_flux_height(spark, sf_dir):
    rows = eddies(spark, sf_dir).withColumn("level", 7000.0 * F.log(F.lit(1e5) / F.col("level")) + 1000.0)
    rows = rows.withColumns({"rho": dy.density(height=F.col("level")), "upwp": -F.col("upomegap") / 10, "wpthetap": F.col("vpthetap") / 1000})
    out = dy.ep_flux_height(rows, "full", [])
    return out.select(F.round("level", 3).alias("level"), "ring", F.round(F.col("psi") / 1e3, 4).alias("psi"), F.round(F.col("f_phi") / 1e6, 4).alias("f_phi"), F.round(F.col("f_z") / 1e6, 4).alias("f_z"))


# Tides, spectra, wavelets -----------------------------------------------------


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of every cell (nside 2) and hour of the day."""
    rows = obs(spark, sf_dir)
    hour = F.hour("time").cast("double")
    return rows.groupBy(hp.pixel(F.col("z"), F.col("t"), 2).alias("cell"), hour.alias("hour")).agg(F.avg("value").alias("value"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A full (cell, hour) table: missing hours have the mean of all observations of the hour."""
    h = hourly(spark, sf_dir)
    hours = h.groupBy("hour").agg(F.avg("value").alias("mean"))
    cells = spark.range(hp.npix(2)).withColumnRenamed("id", "cell")
    full = hours.join(F.broadcast(cells))  # 24 hours of 48 cells
    return full.join(h, ["cell", "hour"], "left").select("cell", "hour", F.coalesce("value", "mean").alias("value"))


@query
def tide_ls(spark, sf_dir):
    out = tides.least_squares(hourly(spark, sf_dir), ["cell"], "value", F.col("hour"), [24.0, 12.0, 8.0])
    amplitude, _ = tides.amplitude_phase(F.col("c"), F.col("s"))
    return rounded(out.withColumn("amplitude", amplitude), "c", "s", "mean", "amplitude", digits=5)


@query
def tide_sym_asy(spark, sf_dir):
    fit = tides.least_squares(hourly(spark, sf_dir), ["cell"], "value", F.col("hour"), [24.0])
    return rounded(tides.symmetric_parts(fit, 2, ["period_h"], ["c", "s"]), "c_sym", "c_asy", "s_sym", "s_asy", digits=5)


@query
def ring_fourier(spark, sf_dir):
    return rounded(spectral.ring_fourier(field(spark, sf_dir), NSIDE, ["level"], "u", [0, 1, 2, 3]), "a", "b")


@query
def power_spectrum_low_l(spark, sf_dir):
    return rounded(spectral.low_degree_spectrum(field(spark, sf_dir), NSIDE, ["level"], "u", 2), "power", digits=4)


@query
def cross_spectrum_low_l(spark, sf_dir):
    return rounded(spectral.low_degree_spectrum(field(spark, sf_dir), NSIDE, ["level"], "u", 2, other="v"), "power", digits=5)


@query
def filter_lmax(spark, sf_dir):
    return rounded(spectral.filter_map(field(spark, sf_dir), NSIDE, ["level"], "u", lmax=1, iterations=0), "u", digits=5)


@query
def filter_gauss(spark, sf_dir):
    return rounded(spectral.filter_map(gappy(spark, sf_dir), NSIDE, ["level"], "u", fwhm_deg=20.0), "u", digits=5)


@query
def power_spectrum(spark, sf_dir):
    return rounded(spectral.spectrum(gappy(spark, sf_dir), NSIDE, ["level"], ["u"]), "power", "wavelength_km", digits=5)


@query
def kinetic_spectrum(spark, sf_dir):
    return rounded(spectral.spectrum(field(spark, sf_dir), NSIDE, ["level"], ["u", "v"], "kinetic"), "power", "wavelength_km", digits=5)


@query
def vorticity_divergence(spark, sf_dir):
    return rounded(spectral.vorticity_divergence(field(spark, sf_dir), NSIDE, ["level"]), "vorticity", "divergence", digits=10)


@query
def vorticity_divergence_low_l(spark, sf_dir):
    out = spectral.vorticity_divergence(field(spark, sf_dir), NSIDE, ["level"], lmax=1)
    return rounded(out.withColumns({c: F.col(c) * 1e6 for c in ("vorticity", "divergence")}), "vorticity", "divergence")


@query
def kinetic_spectrum_low_l(spark, sf_dir):
    return rounded(spectral.spectrum(field(spark, sf_dir), NSIDE, ["level"], ["u", "v"], "kinetic", lmax=1).drop("wavelength_km"), "power", digits=5)


@query
def winds_from_vorticity_divergence(spark, sf_dir):
    return rounded(spectral.winds(spectral.vorticity_divergence(field(spark, sf_dir), NSIDE, ["level"]), NSIDE, ["level"]), "u", "v", digits=5)


@query
def helmholtz(spark, sf_dir):
    return rounded(spectral.helmholtz(field(spark, sf_dir), NSIDE, ["level"]), "u_rot", "v_rot", "u_div", "v_div", "psi", "chi", digits=3)


@query
def helmholtz_potentials(spark, sf_dir):
    out = spectral.helmholtz(field(spark, sf_dir), NSIDE, ["level"])
    return rounded(out.withColumns({c: F.col(c) / 1e6 for c in ("psi", "chi")}), "u_rot", "v_rot", "u_div", "v_div", "psi", "chi", digits=5)


@query
def tide_directional(spark, sf_dir):
    rows = series(spark, sf_dir)
    out = tides.least_squares_tides(rows, 2, [], "value", F.col("hour"), [(24.0, 1), (12.0, -2)], lmax=4)
    return rounded(out, "amplitude", "phase", digits=5)


@query
def tide_wavelet(spark, sf_dir):
    rings = spectral.ring_fourier(series(spark, sf_dir), 2, ["hour"], "value", [1])
    return rounded(tides.wavelet_tides(rings, 2, [], "hour", 1, 1.0, [24.0, 12.0]), "scale_period_h", "west_amplitude", "west_phase", "east_amplitude", "east_phase", digits=5)


@query
def tide_wavelet_harmonic(spark, sf_dir):
    rings = wavelet.harmonic_rings(series(spark, sf_dir), 2, [], "hour", "value", 1, lmax=4)
    return rounded(tides.wavelet_tides(rings, 2, [], "hour", 1, 1.0, [24.0, 12.0]), "scale_period_h", "west_amplitude", "west_phase", "east_amplitude", "east_phase", digits=5)


@query
def eliassen_palm_chain(spark, sf_dir):
    rows = field(spark, sf_dir).withColumns({"level": 100000.0 / F.col("level"), "v": F.col("v") * 100, "temp": 200 + F.col("temp") / 1000, "omega": F.col("omega") - 0.05})
    out = dy.eliassen_palm(rows, NSIDE, [])
    return out.select(F.round("level", 4).alias("level"), "ring", F.round(F.col("f_phi") / 1e6, 3).alias("f_phi"), F.round("divergence", 2).alias("divergence"))


@query
def interpolate_unstructured(spark, sf_dir):
    source = gappy(spark, sf_dir).join(F.broadcast(points(spark)), "cell")  # 192 cells
    return rounded(interpolator.HealpixInterpolator(8, radius=0.12).setup(source)(source, ["level"], ["u", "temp"]), "u", "temp")


@query
def wavelet_spectrum(spark, sf_dir):
    return rounded(wavelet.fourier_wavelet_spectrum(series(spark, sf_dir), 2, [], "hour", "value", 1, 1.0), "west", "east", "period_h", "coi_h", digits=5)


@query
def harmonic_wavelet_spectrum(spark, sf_dir):
    return rounded(wavelet.harmonic_wavelet_spectrum(series(spark, sf_dir), 2, [], "hour", "value", 1, 1.0, lmax=4), "west", "east", "period_h", "coi_h", digits=5)


# Units ------------------------------------------------------------------------


@query
def unit_conversion(spark, sf_dir):
    f = field(spark, sf_dir)
    out = f.select("level", "cell", units.convert(F.col("u"), "degC", "K").alias("u"), units.convert(F.col("temp"), "hPa", "Pa").alias("temp"), units.convert(F.col("v"), "km h-1", "m s-1").alias("v"))
    return rounded(out, "u", "temp", "v")


# Reading, naming and writing --------------------------------------------------


@query
def cleaned_missing(spark, sf_dir):
    rows = swath(spark, sf_dir).withColumn("value", F.when(F.col("event_id") % 13 == 0, float("nan")).otherwise(F.col("value")))
    own = readers.clean(rows.select("event_id", "value"), readers.MISSING)
    timed = own.withColumn("ms", F.col("event_id") * 360000).withColumn("hours", readers.swath_hours("ms"))
    return rounded(timed.drop("ms"), "value", "hours")


@query
def merged_fields(spark, sf_dir):
    f = field(spark, sf_dir)
    parts = [f.filter("level <= 4").select("level", "cell", "u", "v"), f.filter("level > 4").select("cell", "level", "u", "temp")]
    return rounded(readers.concatenate(parts), "u", "v", "temp")


@query
def placed_by_grid_table(spark, sf_dir):
    return rounded(readers.with_grid(field(spark, sf_dir).select("level", "cell", "u"), points(spark)), "u", "lon", "lat")


@query
def mapped_variables(spark, sf_dir):
    names = readers.load_mapping("wind: u  # zonal\nheat: 'temp'\nnone: absent\n")
    return rounded(readers.rename_mapped(field(spark, sf_dir), names, ["level", "cell"])[0], "wind", "heat")


@query
def variables_of_a_swath(spark, sf_dir):
    f = field(spark, sf_dir)
    named = f.withMetadata("u", {"standard_name": "eastward_wind"}).withMetadata("temp", {"standard_name": "air_temperature"})
    return rounded(readers.named_by_standard(named, ["level", "cell"]), "u", "temp")


@query
def stored_formats(spark, sf_dir):
    rows, parts = field(spark, sf_dir).select("level", "cell", "u"), []
    for ending in (".parquet", ".orc", ".csv", ".json"):
        path = writers.write_field(rows, new_folder(spark, "field") + ending)
        own = readers.read_field(spark, path, writers.resolve_store(path)[1])
        parts.append(own.select(F.lit(ending).alias("store"), F.col("level").cast("double").alias("level"), F.col("cell").cast("long").alias("cell"), "u"))
    return rounded(readers.concatenate(parts), "u")


@query
def axis_facts(spark, sf_dir):
    """What passes over the values of axes find out."""
    own, f = points(spark), field(spark, sf_dir)
    half = own.filter("lon < 180")
    facts = (cf.is_geographic(own, "lon", "lat"), cf.is_geographic(own.withColumn("lat", F.col("lat") * 2), "lon", "lat"), cf.is_global_longitude(own, "lon"), cf.is_global_longitude(half, "lon"), cf.are_degrees(own, "lon"), cf.are_degrees(own.withColumn("lon", F.radians("lon")), "lon"), cf.is_level_index(f, "level"), cf.is_level_index(f.withColumn("level", F.col("level") / 2), "level"), cf.time_step_hours(obs(spark, sf_dir).withColumn("time", F.date_trunc("hour", "time")), "time"))
    return spark.createDataFrame([facts], "geographic boolean, beyond_poles boolean, whole_circle boolean, half_circle boolean, degrees boolean, radians boolean, level_index boolean, half_levels boolean, step_hours double")


@query
def elapsed_hours(spark, sf_dir):
    rows = obs(spark, sf_dir).select("event_id", tides.elapsed_hours("time").alias("hours"))
    first = rows.agg(F.min("hours").alias("first"))
    return rounded(rows.join(F.broadcast(first)).select("event_id", (F.col("hours") - F.col("first")).alias("hours")), "hours", digits=5)  # one row


@query
def grid_constants(spark, sf_dir):
    rows = [(z, hp.nside_for_zoom(z), hp.npix(hp.nside_for_zoom(z)), hp.cell_area(hp.nside_for_zoom(z)), hp.resolution_km(hp.nside_for_zoom(z)), hp.nside_for(5 ** (z + 1)), hp.is_valid_npix(12 * (z + 1) ** 2)) for z in range(11)]
    return rounded(spark.createDataFrame(rows, "zoom long, nside long, npix long, area double, km double, nside_for long, valid boolean"), "area", "km")


@query
def tide_names(spark, sf_dir):
    names = ("DW1", "SW2", "SE2", "DE3", "TW3", "QE4", "DS0", "3", "-2")
    return spark.createDataFrame([(n, *tides.parse_mode(n)) for n in names], "name string, period_h double, m long")


@query
def curvilinear_cells(spark, sf_dir):
    grid_rows = regular(spark, sf_dir).select("level", ((F.col("lat") + 84) / 12).cast("long").alias("y"), (F.col("lon") / 15).cast("long").alias("x"), "lat", "lon", "u")
    return rounded(interpolator.flatten_curvilinear(grid_rows), "lat", "lon", "u")


@query
def healpix_to_coarser_nested(spark, sf_dir):
    own = interpolator.HealpixInterpolator(2, "nested", source_nside=NSIDE)
    return rounded(own(field(spark, sf_dir).select("level", "cell", "u"), ["level"], ["u"]), "u")


@query
def interpolate_radians(spark, sf_dir):
    source = gappy(spark, sf_dir).join(F.broadcast(points(spark)), "cell").withColumns({"lon": F.radians("lon"), "lat": F.radians("lat")})  # 192 cells
    return rounded(interpolator.HealpixInterpolator(8, radius=0.12).setup(source, radians=True)(source, ["level"], ["u", "temp"]), "u", "temp")


@query
def stream_daily_bins(spark, sf_dir):
    """Daily means of a stream of the events, up to the watermark."""
    source = f"{sf_dir}/event[s].parquet"  # a pattern, as the source takes one file for a folder otherwise
    z, t = (2 * (F.col("event_id") % 997) + 1) / 997.0 - 1, 4 * (F.col("user_id") % 151) / 151.0
    stream = zonal.watch(spark, source, spark.read.parquet(source).schema).withColumn("ts", F.col("ts").cast("timestamp"))
    out, state = new_folder(spark, "bins"), new_folder(spark, "state")
    zonal.run_available(zonal.windowed_zonal_means(stream, NSIDE, "value", time="ts", z=z, t=t), out, state)
    return rounded(spark.read.parquet(out).select(F.dayofmonth("time").cast("long").alias("day"), "ring", "value", "samples"), "value")


# What figures show ------------------------------------------------------------


@query
def figure_section(spark, sf_dir):
    return rounded(figures.section(gappy(spark, sf_dir), NSIDE, "level", "u"), "lat", "u")


@query
def figure_section_meridian(spark, sf_dir):
    return rounded(figures.section(field(spark, sf_dir, month=True), NSIDE, "level", "u", 77.0), "lat", "u")


@query
def figure_keogram(spark, sf_dir):
    return rounded(figures.keogram(field(spark, sf_dir, month=True), NSIDE, "time", "level", "u"), "u")


@query
def figure_map(spark, sf_dir):
    return rounded(figures.global_map(field(spark, sf_dir), NSIDE, "level", "u", 3.4), "u")


@query
def figure_spectrum(spark, sf_dir):
    lines = field(spark, sf_dir).select((F.col("cell") % 24).alias("l"), (F.col("u") / (F.col("cell") + 1)).alias("power"))
    return rounded(figures.spectrum_lines(lines), "power", "slope_3", "slope_5_3")


@query
def figure_tides(spark, sf_dir):
    f = field(spark, sf_dir)
    m = (F.col("cell") % 2 + 1).cast("int")
    rows = f.select("level", "cell", m.alias("m"), (24.0 / m).alias("period_h"), (F.col("v") * 10).alias("phase"), F.col("u").alias("amplitude"))
    return rounded(figures.tide_panel(rows, NSIDE, 2, 12.0, "level"), "phase", "amplitude")


def _arrows(**options) -> Callable:
    def run(spark, sf_dir):
        rows = _zonal(spark, sf_dir).withColumnsRenamed({"u": "f_phi", "temp": "f_z"})
        one, two = (1e6, 1e12) if options else (1.0, 1.0)
        out = figures.flux_arrows(rows, **options)
        return rounded(out.select("level", "ring", (F.col("arrow_x") / one).alias("arrow_x"), (F.col("arrow_y") / two).alias("arrow_y")), "arrow_x", "arrow_y", digits=4)

    return run


_QUERIES["figure_arrows"] = _arrows()
_QUERIES["figure_arrows_edmon"] = _arrows(scaling="edmon")


@query
def tide_wavelet_cells(spark, sf_dir):
    return rounded(tides.on_cells(tide_wavelet(spark, sf_dir), spark, 2), "lon")


@query
def ep_divergence_edge(spark, sf_dir):
    """Points beside a gap lose their divergence, and so do those above the range of validity."""
    flux = dy.ep_flux_pressure(eddies(spark, sf_dir), "auto", [])
    gone = (F.col("ring") == 5) & F.col("level").between(30000.0, 40000.0)
    out = dy.masked(dy.ep_divergence(flux.withColumn("f_phi", F.when(~gone, F.col("f_phi"))), []), least_pressure=20000.0)
    return out.select(F.round("level", 4).alias("level"), "ring", F.round("divergence", 3).alias("divergence"), F.round("a_ep", 3).alias("a_ep"))


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict:
    return {k: v for k, v in (oracles.SQL | harmonic_oracles.SQL | source_oracles.SQL).items() if k in _QUERIES}
