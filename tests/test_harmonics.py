"""Transforms, winds, spectra, tides and wavelets on fields with known answers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonalis.operators import dynamics, grid, reduce, spectral, tides, wavelet
from zonalis.operators import harmonics as sh

NSIDE = 8


@pytest.fixture(scope="module")
def sphere():
    start, size, z, first = sh.rings(NSIDE)
    ring = np.repeat(np.arange(len(size)), size)
    return z[ring], first[ring] + 2 * math.pi * (np.arange(len(ring)) - start[ring]) / size[ring]


def table(spark, **columns):
    names = list(columns)
    rows = [(i, *(float(columns[n][i]) for n in names)) for i in range(len(columns[names[0]]))]
    return spark.createDataFrame(rows, f"cell long, {', '.join(f'{n} double' for n in names)}").withColumn("level", F.lit(1.0))


def test_dipole_power(spark, sphere):
    z, _ = sphere
    rows = {r["l"]: r["power"] for r in spectral.spectrum(table(spark, x=z), NSIDE, ["level"], ["x"], lmax=3).collect()}
    assert rows[1] == pytest.approx(4 * math.pi / 9, rel=1e-6)
    assert max(abs(rows[0]), abs(rows[2])) < 1e-10


def test_power_is_variance_of_a_band_limited_field(sphere):
    z, phi = sphere
    x = z + 0.5 * np.sqrt(1 - z * z) * np.cos(phi) + 0.2 * (3 * z * z - 1)
    cl = sh.power(sh.analysis(x, NSIDE, 6))
    assert ((2 * np.arange(7) + 1) * cl)[1:].sum() == pytest.approx(4 * math.pi * x.var(), rel=3e-3)


def test_solid_body_rotation_has_positive_vorticity_in_the_north(spark, sphere):
    z, _ = sphere
    out = spectral.vorticity_divergence(table(spark, u=np.sqrt(1 - z * z), v=0 * z), NSIDE, ["level"], lmax=6).orderBy("cell").toPandas()
    north = z > 0.3
    assert np.allclose(out["vorticity"][north] * spectral.RADIUS_M, 2 * z[north], rtol=0.02)
    assert np.abs(out["divergence"] * spectral.RADIUS_M).max() < 0.01


def test_gradient_wind_has_no_vorticity(sphere):
    z, phi = sphere
    s = np.sqrt(1 - z * z)
    u, v = -z * np.sin(phi), (s * s - z * z) * np.cos(phi)
    e, b = sh.vector_analysis(u, v, NSIDE, 6)
    l = np.sqrt(np.arange(7) * np.arange(1, 8))[:, None]
    assert np.abs(sh.synthesis(-l * b, NSIDE)).max() < 0.06
    assert np.allclose(sh.synthesis(-l * e, NSIDE), -6 * z * s * np.cos(phi), atol=0.1)


def test_helmholtz_parts_add_up(spark, sphere):
    z, phi = sphere
    s = np.sqrt(1 - z * z)
    u, v = s - 0.3 * z * np.sin(phi), 0.3 * (s * s - z * z) * np.cos(phi)
    out = spectral.helmholtz(table(spark, u=u, v=v), NSIDE, ["level"], lmax=6).orderBy("cell").toPandas()
    assert np.abs(out["u_rot"] + out["u_div"] - u).max() < 0.02
    assert np.abs(out["v_rot"] + out["v_div"] - v).max() < 0.02


def test_winds_come_back(spark, sphere):
    z, phi = sphere
    s = np.sqrt(1 - z * z)
    field = table(spark, u=s, v=0.3 * (s * s - z * z) * np.cos(phi) * 0)
    dv = spectral.vorticity_divergence(field, NSIDE, ["level"], lmax=6)
    out = spectral.winds(dv, NSIDE, ["level"], lmax=6).orderBy("cell").toPandas()
    assert np.abs(out["u"] - s).max() < 0.01


def test_filter_keeps_gaps_and_low_degrees(spark, sphere):
    z, phi = sphere
    field = table(spark, x=z + 0.4 * np.cos(5 * phi) * (1 - z * z) ** 2.5).withColumn("x", F.when(F.col("cell") != 7, F.col("x")))
    out = spectral.filter_map(field, NSIDE, ["level"], "x", lmax=1).orderBy("cell").toPandas()
    assert math.isnan(out["x"][7])
    assert np.abs(out["x"] - z).dropna().max() < 0.02
    with pytest.raises(ValueError):
        spectral.filter_map(field, NSIDE, ["level"], "x")


def test_empty_slice_has_no_power(spark, sphere):
    z, _ = sphere
    field = table(spark, x=z).withColumn("x", F.lit(None).cast("double"))
    assert spectral.spectrum(field, NSIDE, ["level"], ["x"], lmax=2).filter("power is not null").count() == 0


def tide(spark, m, period=24.0, hours=48):
    start, size, z, first = sh.rings(4)
    ring = np.repeat(np.arange(len(size)), size)
    phi = first[ring] + 2 * math.pi * (np.arange(len(ring)) - start[ring]) / size[ring]
    zz = z[ring]
    rows = [(float(h), int(c), float(3 * math.sqrt(1 - zz[c] ** 2) * (1 + 0.6 * zz[c]) * math.cos(m * phi[c] + 2 * math.pi * h / period + 0.5))) for h in range(hours) for c in range(len(phi))]
    return spark.createDataFrame(rows, "hour double, cell long, x double"), 3 * np.sqrt(1 - zz**2) * (1 + 0.6 * zz)


def test_westward_tide_is_found_and_eastward_is_not(spark):
    field, truth = tide(spark, 1)
    out = tides.least_squares_tides(field, 4, [], "x", F.col("hour"), [(24.0, 1), (24.0, -1)], lmax=6)
    west, east = (out.filter(f"m = {m}").orderBy("cell").toPandas() for m in (1, -1))
    assert np.median(west["amplitude"] / truth) == pytest.approx(1, rel=0.05)
    assert east["amplitude"].max() < 0.02 * truth.max()
    turned = np.exp(1j * west["phase"])
    assert abs(turned.mean()) > 0.999


def test_symmetric_parts_add_up(spark):
    field, _ = tide(spark, 1)
    fit = tides.least_squares(field, ["cell"], "x", F.col("hour"), [24.0])
    both = fit.join(tides.symmetric_parts(fit, 4, ["period_h"], ["c"]), ["period_h", "cell"])
    assert both.filter(F.abs(F.col("c") - F.col("c_sym") - F.col("c_asy")) > 1e-10).count() == 0


def test_wavelet_amplitude_of_a_two_cycle_record():
    for samples, truth in ((48, 0.592), (2400, 0.932)):
        wave, period = wavelet.scaled(np.cos(2 * math.pi * np.arange(samples) / 24), 1.0, 0.1)
        assert np.abs(wave[np.abs(period - 24).argmin()]).mean() == pytest.approx(truth, abs=2e-3)


def test_wavelet_tide_goes_west(spark):
    field, _ = tide(spark, 1)
    rings = spectral.ring_fourier(field, 4, ["hour"], "x", [1])
    out = tides.wavelet_tides(rings, 4, [], "hour", 1, 1.0, [24.0]).toPandas()
    assert (out["west_amplitude"] > 5 * out["east_amplitude"]).all()


def test_chi_square_quantiles():
    assert wavelet.chi_square_quantile(0.95, 1) == pytest.approx(3.8415, abs=1e-4)
    assert wavelet.chi_square_quantile(0.95, 2) == pytest.approx(5.9915, abs=1e-4)


@pytest.mark.parametrize(("name", "mode"), [("DW1", (24.0, 1)), ("se2", (12.0, -2)), ("TS3", (8.0, -3)), ("4", (None, 4))])
def test_names_of_tides(name, mode):
    assert tides.parse_mode(name) == mode


def test_bad_name_of_a_tide():
    with pytest.raises(ValueError):
        tides.parse_mode("XYZ")


def test_ring_and_nested_agree(spark):
    field = spark.range(192).select(F.col("id").alias("cell"), F.lit(1.0).alias("level"), F.sin("id").alias("x"))
    back = grid.reorder(grid.reorder(field, 4, "nest"), 4, "ring")
    assert field.exceptAll(back.select("cell", "level", "x")).isEmpty()
    up_down = grid.regrade(grid.regrade(field, 4, 8, ["level"], ["x"]), 8, 4, ["level"], ["x"])
    joined = field.join(up_down.withColumnRenamed("x", "y"), ["cell", "level"])
    assert joined.filter(F.abs(F.col("x") - F.col("y")) > 1e-12).count() == 0 and joined.count() == 192


def test_zonal_mean_of_latitude_is_latitude(spark):
    field = grid.grid(spark, 4).select(F.col("cell_ring").alias("cell"), "lat", F.lit(1.0).alias("level")).withColumn("x", F.when(F.col("lat") > 0, F.col("lat")))
    out = reduce.zonal_mean(field, 4, ["level"], ["x"])
    assert out.count() == 15
    assert out.filter((F.col("lat") > 1e-9) & (F.abs(F.col("x") - F.col("lat")) > 1e-9)).isEmpty()
    assert out.filter((F.col("lat") <= 0) & F.col("x").isNotNull()).isEmpty()


def test_gradient_of_a_parabola_is_exact(spark):
    axis = [0.0, 1.0, 2.5, 4.0, 7.0, 7.5]
    df = spark.createDataFrame([("a", x, 3 * x * x - 2 * x + 1) for x in axis], "k string, x double, f double")
    out = dynamics.with_gradient(df, "f", "x", ["k"], "g")
    assert out.filter(F.abs(F.col("g") - (6 * F.col("x") - 2)) > 1e-9).isEmpty()


def test_gravity_falls_with_height(spark):
    g70, g90 = (spark.range(1).select(dynamics.gravity(F.lit(h))).first()[0] for h in (70e3, 90e3))
    assert 0.020 <= 1 - g70 / dynamics.GRAVITY <= 0.022 and 0.027 <= 1 - g90 / dynamics.GRAVITY <= 0.029


def test_edges_of_missing_divergence_are_dilated(spark):
    rows = [(float(l), float(y), float(l * y), float(y)) for l in range(1, 7) for y in range(-60, 61, 20)]
    flux = spark.createDataFrame(rows, "level double, lat double, f_phi double, f_z double").withColumn("f_z", F.when((F.col("level") != 3) | (F.col("lat") != 0), F.col("f_z")))
    kept = dynamics.ep_divergence(flux, [], edge=True).filter("divergence is not null").count()
    assert kept < dynamics.ep_divergence(flux, [], edge=False).filter("divergence is not null").count()


def test_legendre_functions_of_high_order_do_not_vanish():
    """The addition theorem at degrees that nside 512 resolves, and one value by exact arithmetic."""
    z = sh.rings(512)[2][[0, 1, 5, 30, 100, 200, 400, 700, 1023, 1200, 1800, 2046]]
    lmax, degrees = 1535, [3, 700, 1200, 1535]
    total = np.zeros((len(degrees), len(z)))
    for m in range(lmax + 1):
        table = sh._legendre(z, lmax, m)
        for i, l in enumerate(degrees):
            if l >= m:
                total[i] += (1 if m == 0 else 2) * table[l - m] ** 2
    assert np.allclose(total, (2 * np.array(degrees)[:, None] + 1) / (4 * math.pi), rtol=1e-8)

    from decimal import Decimal, getcontext

    getcontext().prec = 60
    m, l, x = 1500, 3071, math.sqrt(1 - 0.49986**2)
    now, before, last = Decimal(1), Decimal(0), Decimal(0)
    for k in range(1, m + 1):
        now *= (Decimal(2 * k - 1) / Decimal(2 * k)).sqrt() * (1 - Decimal(x) ** 2).sqrt()
    now *= (Decimal(2 * m + 1) / (4 * Decimal("3.14159265358979323846264338327950288419716939937510582"))).sqrt()
    for k in range(m + 1, l + 1):
        a = (Decimal(4 * k * k - 1) / Decimal(k * k - m * m)).sqrt()
        now, before, last = a * (Decimal(x) * now - last * before), now, 1 / a
    assert abs(float(now)) > 1e-3
    assert sh._legendre(np.array([x]), l, m)[-1, 0] == pytest.approx(float(now), rel=1e-6)
