"""The Eliassen-Palm chain and the interpolator on fields with known answers."""

import math

import pytest
from pyspark.sql import functions as F

from zonalis.operators import dynamics as dy
from zonalis.operators import grid, wavelet
from zonalis.operators.interpolator import HealpixInterpolator, interpolate_to_healpix


@pytest.fixture(scope="module")
def zonal(spark):
    """Means quadratic in pressure, with fluxes in powers of the cosine of latitude."""
    rows = [(float(p), y) for p in range(10000, 100001, 10000) for y in [-87.5 + 2.5 * k for k in range(71)]]
    df = spark.createDataFrame(rows, "level double, lat double")
    cos, p = F.cos(F.radians("lat")), F.col("level") / 1e5
    return df.withColumns({"u": 30 * cos * (1 - p * p), "theta": 500 - 200 * p + 40 * p * p, "upvp": 20 * cos * cos * p, "vpthetap": 15 * cos * cos * p, "upomegap": -0.02 * cos * p})


def truth(r, mode):
    p, c, s = r["level"] / 1e5, math.cos(math.radians(r["lat"])), math.sin(math.radians(r["lat"]))
    theta_p, u_p = (-200 + 80 * p) / 1e5, -60 * c * p / 1e5
    flux = 15 * c * c * p / theta_p
    f = 2 * dy.OMEGA * s
    # d(u cos)/dy / (a cos) of u = 30 cos (1 - p^2)
    shear = 30 * (1 - p * p) * (-2 * s) / dy.RADIUS
    f_hat = f if mode == "qg" else f - shear
    a_cos = dy.RADIUS * c
    f_phi = a_cos * (-20 * c * c * p + (0 if mode == "qg" else u_p * flux))
    return f_phi, a_cos * (f_hat * flux - (-0.02 * c * p if mode == "full" else 0))


@pytest.mark.parametrize("mode", ["full", "tem", "qg"])
def test_flux_has_its_closed_form(zonal, mode):
    out = dy.ep_flux_pressure(zonal, mode, []).filter("abs(lat) < 80").collect()
    for r in out:
        f_phi, f_p = truth(r, mode)
        assert r["f_phi"] == pytest.approx(f_phi, rel=1e-6, abs=1.0)
        assert r["f_z"] == pytest.approx(f_p, rel=5e-3, abs=2e4)


def test_divergence_of_a_known_flux(spark):
    rows = [(float(p), y) for p in range(1, 8) for y in [-80.0 + 2 * k for k in range(81)]]
    df = spark.createDataFrame(rows, "level double, lat double").withColumns({"f_phi": F.cos(F.radians("lat")) * dy.RADIUS, "f_z": F.col("level") * F.col("level") * 1.0})
    for r in dy.ep_divergence(df, [], edge=False).filter("abs(lat) < 70").collect():
        assert r["divergence"] == pytest.approx(-2 * math.sin(math.radians(r["lat"])) + 2 * r["level"], abs=5e-3)
        assert r["a_ep"] == pytest.approx(r["divergence"] / (dy.RADIUS * math.cos(math.radians(r["lat"]))) * 86400)


def test_auto_is_full_with_a_vertical_flux(zonal):
    assert dy.ep_mode("auto", True) == "full" and dy.ep_mode("auto", False) == "tem" and dy.ep_mode("qg", True) == "qg"
    a, b = dy.ep_flux_pressure(zonal, "auto", []), dy.ep_flux_pressure(zonal, "full", [])
    assert a.exceptAll(b).isEmpty()


def test_chain_on_height_and_on_standard_levels(spark):
    cells = grid.grid(spark, 4).select(F.col("cell_ring").alias("cell"), "lat", "lon")
    levels = spark.range(1, 9).select((F.col("id") * 3000.0).alias("level"))
    wave = F.sin(F.radians("lon") * 2)
    f = cells.join(F.broadcast(levels)).withColumns({"u": 20 * F.cos(F.radians("lat")) + wave, "v": 3 * wave, "w": 0.01 * wave, "temp": 280 - F.col("level") / 300 + wave, "pres": 101325 * F.exp(-F.col("level") / 7500)})
    high = dy.eliassen_palm(f, 4, [], vertical="height")
    assert high.filter("f_phi is not null and a_ep is not null").count() > 40
    standard = dy.eliassen_palm(f, 4, [], interpolate=True)
    levels = {r["level"] for r in standard.select("level").distinct().collect()}
    assert levels <= {round(float(p), 8) for p in dy.STANDARD_LEVELS} and len(levels) > 5


def test_half_and_standard_levels():
    assert dy.standard_levels(90.0, 1000.0) == [1000.0, 700.0, 500.0, 300.0, 200.0, 100.0, 70.0, 50.0]


@pytest.mark.parametrize("order", ["ring", "nested"])
def test_interpolator_knows_what_it_gets(spark, order):
    source = grid.grid(spark, 4).select(F.col("cell_ring").alias("cell"), F.col("z").alias("x"))
    same = HealpixInterpolator(4, order).setup(source)(source, [], ["x"])
    index = "cell_ring" if order == "ring" else "cell_nest"
    back = same.join(grid.grid(spark, 4), same["cell"] == F.col(index))
    assert back.count() == 192 and back.filter(F.abs(F.col("x") - F.col("z")) > 1e-12).isEmpty()
    coarse = HealpixInterpolator(2, order).setup(source)(source, [], ["x"])
    assert coarse.count() == 48 and abs(coarse.agg(F.avg("x")).first()[0]) < 1e-9
    regular = spark.createDataFrame([(float(la), float(lo), math.cos(math.radians(la))) for la in range(-85, 86, 10) for lo in range(0, 360, 10)], "lat double, lon double, x double")
    out = interpolate_to_healpix(regular, [], ["x"], 4, order)
    assert out.count() > 150 and out.filter("x < -0.01 or x > 1.01").isEmpty()


def test_radians_and_curvilinear_grids(spark):
    rows = [(j, i, math.radians(-88 + 4 * j), math.radians(4 * i), math.cos(math.radians(-88 + 4 * j))) for j in range(45) for i in range(90)]
    df = spark.createDataFrame(rows, "y long, x long, lat double, lon double, v double")
    own = HealpixInterpolator(4, radius=0.2).setup(df, radians=True)
    out = own(df, [], ["v"]).join(grid.grid(spark, 4).withColumnRenamed("cell_ring", "cell"), "cell")
    assert own.kind == "curvilinear" and out.count() == 192
    assert out.filter(F.abs(F.col("v") - F.cos(F.radians("lat"))) > 0.1).isEmpty()


def test_harmonic_rings_equal_ring_fourier_for_smooth_fields(spark):
    from zonalis.operators.spectral import ring_fourier

    cells = grid.grid(spark, 4).select(F.col("cell_ring").alias("cell"), "lat", "lon")
    f = cells.withColumns({"hour": F.lit(0.0), "x": F.cos(F.radians("lat")) * F.cos(F.radians("lon") - 0.3)})
    one = wavelet.harmonic_rings(f, 4, [], "hour", "x", 1, lmax=4).select("ring", "a", "b")
    two = ring_fourier(f, 4, ["hour"], "x", [1]).select("ring", F.col("a").alias("c"), F.col("b").alias("d"))
    both = one.join(two, "ring")
    assert both.count() == 15 and both.filter((F.abs(F.col("a") - F.col("c")) > 0.01) | (F.abs(F.col("b") - F.col("d")) > 0.01)).isEmpty()
