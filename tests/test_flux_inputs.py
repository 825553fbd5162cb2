"""The Eliassen-Palm chain from fields as users name and measure them."""

import math

import pytest
from pyspark.sql import functions as F

from zonalis.functions import cf
from zonalis.operators import dynamics as dy
from zonalis.operators import grid


def unit(c, units, **more):
    return F.col(c).alias(c, metadata={"units": units, **more})


@pytest.fixture(scope="module")
def plain(spark):
    """u, v, w, temp on pressure levels in Pa, with a planetary wave and one of small scale."""
    cells = grid.grid(spark, 4).select(F.col("cell_ring").alias("cell"), "lat", "lon")
    levels = spark.createDataFrame([(float(p),) for p in (100000, 85000, 70000, 50000, 30000, 20000, 10000)], "level double")
    cos, lon = F.cos(F.radians("lat")), F.radians("lon")
    wave, ripple = cos * F.sin(lon), F.sin(5 * lon)
    f = cells.join(F.broadcast(levels)).withColumns({
        "u": 20 * cos + wave + ripple, "v": 3 * wave + ripple, "w": 0.01 * wave, "temp": 220 + F.col("level") / 2000 + 2 * wave + ripple,
    })
    return f.select("level", "cell", "u", "v", "w", "temp").cache()


def same(one, two, columns=("f_phi", "f_z", "a_ep")):
    both = one.select("level", "ring", *columns).join(two.select("level", "ring", *[F.col(c).alias(f"{c}_2") for c in columns]), ["level", "ring"]).collect()
    assert len(both) == 7 * 15
    for r in both:
        for c in columns:
            assert (r[c] is None) == (r[f"{c}_2"] is None)
            assert r[c] is None or r[c] == pytest.approx(r[f"{c}_2"], rel=1e-6, abs=1e-6)


def test_names_and_units_do_not_matter(plain):
    other = plain.select(
        (F.col("level") / 100).alias("plev"), "cell", F.col("u").alias("ua"), F.col("v").alias("x1"), F.col("w").alias("x2"), (F.col("temp") - 273.15).alias("ta"),
    )
    other = other.select(unit("plev", "hPa"), "cell", "ua", unit("x1", "m s-1", standard_name="northward_wind"), unit("x2", "m s-1", standard_name="upward_air_velocity"), unit("ta", "degC"))
    assert cf.vertical_axis(other, ["plev"]) == "plev"
    found = dy.eliassen_palm(other, 4, [], check=True).withColumnRenamed("plev", "level").withColumn("level", F.round("level", 6))
    same(dy.eliassen_palm(plain, 4, []), found)


def test_vertical_velocity_in_pressure_is_omega(plain):
    named = plain.withColumn("omega", F.col("w") * -3).drop("w")
    other = named.select("level", "cell", "u", "v", "temp", F.col("omega").alias("wap", metadata={"units": "Pa s-1"}))
    assert "omega" in dy.canonical(other, ["level", "cell"]).columns
    same(dy.eliassen_palm(named, 4, []), dy.eliassen_palm(other, 4, []))


def test_values_outside_a_quantity_are_refused(plain):
    with pytest.raises(ValueError, match="temp"):
        dy.eliassen_palm(plain.withColumn("temp", F.col("temp") - 273.15), 4, [], check=True)
    with pytest.raises(ValueError, match="no column is v"):
        dy.eliassen_palm(plain.drop("v"), 4, [])
    with pytest.raises(ValueError, match="theta or temp"):
        dy.eliassen_palm(plain.drop("temp"), 4, [])
    with pytest.raises(ValueError, match="numbers layers"):
        dy.eliassen_palm(plain.withColumn("level", F.dense_rank().over(dy.W.orderBy("level")).cast("double")), 4, [])


def test_band_limit_leaves_the_planetary_wave(plain):
    cos, lon = F.cos(F.radians("lat")), F.radians("lon")
    cells = grid.grid(plain.sparkSession, 4).select(F.col("cell_ring").alias("cell"), "lat", "lon")
    wave = cos * F.sin(lon)
    smooth = plain.select("level", "cell").join(cells, "cell").withColumns({"u": 20 * cos + wave, "v": 3 * wave, "w": 0.01 * wave, "temp": 220 + F.col("level") / 2000 + 2 * wave}).drop("lat", "lon")
    cut, whole = dy.eliassen_palm(plain, 4, [], lmax=2), dy.eliassen_palm(plain, 4, [])
    wanted = dy.eliassen_palm(smooth, 4, [], lmax=2)
    size = wanted.agg(F.max(F.abs("f_phi"))).first()[0]
    far = lambda a: a.alias("a").join(wanted.alias("b"), ["level", "ring"]).agg(F.max(F.abs(F.col("a.f_phi") - F.col("b.f_phi")))).first()[0]
    assert far(cut) < 0.02 * size < far(whole)


def test_masks_blank_what_is_not_valid(plain):
    out = dy.eliassen_palm(plain, 4, [], least_pressure=25000.0)
    assert out.filter("level < 25000 and (f_phi is not null or a_ep is not null)").isEmpty()
    assert out.filter("level > 25000 and a_ep is not null").count() > 20
    heights = plain.withColumn("level", 7000 * F.log(1e5 / F.col("level")) + 10)
    high = dy.eliassen_palm(heights, 4, [], vertical="height", greatest_height=9000.0)
    assert high.filter("level > 9000 and f_phi is not null").isEmpty() and high.filter("level < 9000 and f_phi is not null").count() > 20


def test_gravity_follows_the_height_at_hand(plain):
    z = 7000 * F.log(1e5 / F.col("level"))
    geometric = plain.withColumn("altitude", z)
    h = dy.RADIUS * z / (dy.RADIUS + z)
    by_height = plain.withColumn("zg", h)
    by_potential = plain.withColumn("geopot", h * dy.GRAVITY).withColumn("geopot", unit("geopot", "m2 s-2"))
    one = dy.eliassen_palm(geometric, 4, [])
    same(one, dy.eliassen_palm(by_height, 4, []))
    same(one, dy.eliassen_palm(by_potential, 4, []))
    assert dy.height_of(plain) is None and dy.height_of(by_potential) == ("geopot", 1.0)
    # Without a height: log-pressure height of the mean temperature, from the greatest pressure down.
    eddies = dy.eddy_covariances(dy.with_theta(plain, "level"), 4, ["level"], [("u", "w")], ["temp", "theta"]).withColumnRenamed("u_w", "upwp")
    for r in eddies.withColumn("omega", dy._omega_flux(eddies, "level", None, 1e5)).collect():
        height = -dy.R_DRY * r["temp"] / dy.GRAVITY * math.log(r["level"] / 1e5)
        g = dy.GRAVITY * (dy.RADIUS / (dy.RADIUS + height)) ** 2
        assert r["omega"] == pytest.approx(-r["level"] / (dy.R_DRY * r["temp"]) * g * r["upwp"], rel=1e-9)


def test_density_by_what_is_known(spark):
    rows = spark.createDataFrame([(1000.0 * k, 250.0, 1e5 * math.exp(-k / 8), 300.0) for k in range(1, 9)], "level double, temp double, pres double, theta double")
    gas = rows.select(dy._density(rows, "level", "height").alias("x"), (F.col("pres") / (dy.R_DRY * 250)).alias("y"))
    assert gas.filter(F.abs(F.col("x") - F.col("y")) > 1e-12).isEmpty()
    fitted = rows.drop("temp").select(dy._density(rows.drop("temp"), "level", "height").alias("x"), (1.225 * F.exp(-F.col("level") / 8000)).alias("y"))
    assert fitted.filter(F.abs(F.col("x") - F.col("y")) > 1e-9).isEmpty()
    bare = rows.select("level", "theta")
    assert bare.select("level", dy._density(bare, "level", "height").alias("x")).filter(F.abs(F.col("x") - 1.225 * F.exp(-F.col("level") / 7000)) > 1e-12).isEmpty()
    back = rows.select(dy.pressure_of(F.col("temp"), dy.potential_temperature(F.col("temp"), F.col("pres"))).alias("p"), "pres")
    assert back.filter(F.abs(F.col("p") - F.col("pres")) > 1e-6).isEmpty()


def test_half_levels_are_brought_to_full_ones(plain):
    line = plain.withColumn("w", F.col("level") * 1e-6 + F.col("cell") * 1e-4)
    halves = line.select("cell", (F.col("level") + 500).alias("level"), (F.col("w") + 5e-4).alias("w"))
    back = dy.destagger(line, halves, []).join(line.select("level", "cell", F.col("w").alias("own")), ["level", "cell"])
    assert back.count() == 7 * 192 and back.filter(F.abs(F.col("w") - F.col("own")) > 1e-9).isEmpty()
    out = dy.eliassen_palm(line.drop("w"), 4, [], half=halves)
    same(dy.eliassen_palm(line, 4, []), out)
