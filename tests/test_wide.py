"""Paths that grids of uneven density, empty bands and irregular axes take, against plain versions."""

import math

import pytest
from pyspark.sql import functions as F

from zonalis.functions import healpix as hp
from zonalis.operators import extract, grid, harmonics, regrid, spectral
from zonalis.operators.neighbours import nearest


def vector(lon, lat):
    a, b = math.radians(lon), math.radians(lat)
    return math.cos(b) * math.cos(a), math.cos(b) * math.sin(a), math.sin(b)


def chord2(a, b):
    return sum((x - y) ** 2 for x, y in zip(vector(*a), vector(*b), strict=True))


def test_groups_of_any_density_have_their_own_cubes(spark):
    dense = [("dense", k, 0.1 * (k % 40), 0.1 * (k // 40)) for k in range(1600)]
    sources = [*dense, ("two", 0, 10.0, 10.0), ("two", 1, 190.0, -10.0), ("dense", 9999, None, 1.0)]
    targets = [(g, k, 7.0 * k, 1.3 * k - 20) for g in ("dense", "two", "none") for k in range(30)] + [("two", 99, None, 0.0)]
    own = spark.createDataFrame(sources, "g string, cell int, lon double, lat double")
    got = nearest(own, spark.createDataFrame(targets, "g string, target int, lon double, lat double"), 3, ["g"]).collect()
    found = {(r["g"], r["target"], r["rank"]): r["d2"] for r in got}
    assert len(got) == len(found) == 30 * 3 + 30 * 2
    for g, k, lon, lat in targets:
        near = sorted(chord2((lon, lat), s[2:]) for s in sources if s[0] == g and s[2] is not None)[:3] if lon is not None else []
        assert [found[g, k, i + 1] for i in range(len(near))] == pytest.approx(near, abs=1e-12)


def test_no_targets_and_no_sources(spark):
    none = spark.createDataFrame([], "cell long, lon double, lat double")
    some = spark.createDataFrame([(1, 2.0, 3.0)], "cell long, lon double, lat double")
    assert nearest(none, some.withColumnRenamed("cell", "target")).isEmpty()
    assert nearest(some, none.withColumnRenamed("cell", "target")).isEmpty()


def test_meridian_without_cells_in_its_band(spark):
    cells = [(k, 100.0 + k % 7, -80.0 + 4 * k) for k in range(40)]
    points = spark.createDataFrame(cells, "cell int, lon double, lat double")
    rows = extract.meridian_nearest(points, 300.0, 100_000, 19).collect()
    assert len(rows) == 19
    for r in rows:
        own = {c: chord2((300.0, r["lat"]), (lon, lat)) for c, lon, lat in cells}
        assert own[r["cell"]] == pytest.approx(min(own.values()), abs=1e-12)


def test_bilinear_on_irregular_axes(spark):
    lats, lons = [-70.0, -69.5, -10.0, 0.0, 0.25, 45.0, 80.0], [-170.0, -20.0, -19.0, 3.0, 90.0, 91.0]
    value = lambda i, j: float((i * 7 + j * 3) % 11)
    field = spark.createDataFrame([(1.0, a, o, value(i, j)) for i, a in enumerate(lats) for j, o in enumerate(lons)], "level double, lat double, lon double, x double")
    places = [(k, (k * 37.7) % 720 - 360, -85 + (k * 11.3) % 170) for k in range(200)] + [(900, 3.0, 80.0), (901, 190.0, -70.0), (902, 350.0, 0.0)]
    out = {r["target"]: r["x"] for r in regrid.bilinear_regular(field, spark.createDataFrame(places, "target int, lon double, lat double"), ["level"], ["x"]).collect()}
    expected = {}
    for k, lon, lat in places:
        if not lats[0] <= lat <= lats[-1]:
            continue
        i = min(max(n for n, a in enumerate(lats) if a <= lat), len(lats) - 2)
        x = lons[0] + (lon - lons[0]) % 360
        j = max(n for n, o in enumerate(lons) if o <= x)
        east = lons[j + 1] if j + 1 < len(lons) else lons[0] + 360
        wy, wx = (lat - lats[i]) / (lats[i + 1] - lats[i]), (x - lons[j]) / (east - lons[j])
        n = (j + 1) % len(lons)
        expected[k] = (1 - wy) * ((1 - wx) * value(i, j) + wx * value(i, n)) + wy * ((1 - wx) * value(i + 1, j) + wx * value(i + 1, n))
    assert out == pytest.approx(expected, abs=1e-9)


def test_empty_regular_grid(spark):
    field = spark.createDataFrame([], "level double, lat double, lon double, x double")
    targets = spark.createDataFrame([(1, 2.0, 3.0)], "target int, lon double, lat double")
    assert regrid.bilinear_regular(field, targets, ["level"], ["x"]).isEmpty()


def test_brackets_are_met_by_equality(spark):
    field = spark.range(40).select(F.lit(1.0).alias("level"), (F.col("id") % 8 * 20.0 - 70).alias("lat"), (F.col("id") % 5 * 72.0).alias("lon"), F.col("id").cast("double").alias("x"))
    targets = grid.grid(spark, 4).select(F.col("cell_ring").alias("target"), "lon", "lat")
    plan = regrid.bilinear_regular(field, targets, ["level"], ["x"])._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and "tlon" in line or "Join" in line and "lat_bin" in line]
    assert joins and all("_bin" in line for line in joins)


def test_table_of_functions_is_that_of_the_transforms(spark):
    rows = {(r["l"], r["m"], r["ring"]): r["lambda"] for r in spectral.legendre_table(spark, 4, 5).collect()}
    assert len(rows) == 21 * 15
    for m in range(6):
        own = harmonics.legendre(4, 5, m)
        assert all(rows[l, m, r + 1] == own[l - m, r] for l in range(m, 6) for r in range(15))
    assert hp.npix(4) == 192


def test_horizontal_columns_by_rule(spark):
    from zonalis.functions import cf

    frame = lambda columns: spark.createDataFrame([], columns)
    assert cf.horizontal(frame("time int, y int, x int, lon double, lat double, u double"), []) == ["y", "x"]
    assert cf.horizontal(frame("time int, ncells long, clon double, clat double"), []) == ["ncells"]
    assert cf.horizontal(frame("latitude double, longitude double, values double"), []) == ["latitude", "longitude"]
    assert cf.horizontal(frame("time int, level double, north int, east int, u double"), ["time", "level", "north", "east"]) == ["north", "east"]
    with pytest.raises(ValueError):
        cf.horizontal(frame("time int, u double"), ["time"])
    assert cf.usual_names(frame("time int, ncells long, clon double, clat double")).columns == ["time", "cell", "lon", "lat"]
    assert cf.usual_names(frame("latitude double, longitude double, values double")).columns == ["lat", "lon", "values"]
    assert cf.usual_names(frame("y int, x int, longitude double, latitude double")).columns == ["y", "x", "lon", "lat"]
    assert cf.usual_names(frame("time int, u double")).columns == ["time", "u"]


def test_kinetic_variables(spark):
    df = spark.createDataFrame([], "cell long, ua double, va double, div double, vor double")
    assert spectral.kinetic_variables(df) == (["ua", "va"], "kinetic")
    assert spectral.kinetic_variables(df.drop("ua")) == (["div", "vor"], "kinetic-scalar")
    assert spectral.kinetic_variables(df.withMetadata("va", {"units": "s-1"}), ["va", "ua"]) == (["va", "ua"], "kinetic-scalar")
    with pytest.raises(KeyError):
        spectral.kinetic_variables(df.select("cell", "ua", "div"))


def test_ticks_beside_a_pressure_axis():
    from zonalis.plans import figures

    marks = figures.companion_ticks(1.0, 1000.0)
    assert [z for _, z in marks] == [float(z) for z in range(0, 50, 5)]
    assert marks[0][0] == pytest.approx(1000.0) and marks[2][0] == pytest.approx(1000 * math.exp(-10 / 7))
    assert len(figures.companion_ticks(700.0, 1000.0)) == 3


def test_commands_on_other_names_kinds_and_formats(spark, tmp_path):
    from zonalis import cli
    from zonalis.sources import writers

    cells = grid.grid(spark, 4).select(F.col("cell_ring").alias("ncells"), F.col("lon").alias("clon"), F.col("lat").alias("clat"), F.lit(1.0).alias("level"), F.col("z").alias("u"), (F.col("z") * 2).alias("v"))
    source = writers.write_field(cells, f"{tmp_path}/icon.csv")
    spark.createDataFrame([(1.0, 9.5)], "level double, weight double").write.parquet(f"{source}.aside")
    assert cli.main(["convert", source, f"{tmp_path}/hp.parquet", "--nside", "4"], spark) == 0
    out = spark.read.parquet(f"{tmp_path}/hp.parquet")
    assert out.count() == 192 and out.join(cells, out.cell == cells.ncells).filter(F.abs(out.u - cells.u) > 1e-6).isEmpty()
    assert cli.main(["zonal-mean", f"{tmp_path}/hp.parquet", f"{tmp_path}/zm.csv"], spark) == 0
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/zm.csv.aside").collect()] == [(1.0, 9.5)]
    assert cli.main(["spectrum", f"{tmp_path}/hp.parquet", f"{tmp_path}/ke.parquet", "--type", "kinetic", "--lmax", "3"], spark) == 0
    assert spark.read.parquet(f"{tmp_path}/ke.parquet").count() == 4
    tides = spark.range(192).select(F.col("id").alias("cell"), F.lit(1).alias("m"), F.lit(24.0).alias("period_h"), F.lit(0.5).alias("phase"), F.lit(2.0).alias("amplitude"))
    tides.write.parquet(f"{tmp_path}/tides.parquet")
    assert cli.main(["plot", f"{tmp_path}/tides.parquet", f"{tmp_path}/panel.parquet", "--type", "tide"], spark) == 0
    panel = spark.read.parquet(f"{tmp_path}/panel.parquet")
    assert panel.count() == 15 and panel.filter("abs(phase - 0.5) > 1e-12 or amplitude <> 2").isEmpty()
    with pytest.raises(ValueError):
        cli.main(["plot", f"{tmp_path}/hp.parquet", f"{tmp_path}/none.parquet", "--type", "map", "--picture", f"{tmp_path}/a.png"], spark)


def test_convert_curvilinear_and_variables_named_x_or_y(spark, tmp_path):
    from zonalis import cli

    flat = spark.range(2592).select((F.col("id") / 72).cast("int").alias("y"), (F.col("id") % 72).cast("int").alias("x"))
    curved = flat.withColumns({"latitude": F.col("y") * 5.0 - 87.5, "longitude": F.col("x") * 5.0}).withColumn("u", F.sin(F.radians("latitude")))
    curved.write.parquet(f"{tmp_path}/curved.parquet")
    assert cli.main(["convert", f"{tmp_path}/curved.parquet", f"{tmp_path}/a.parquet", "--nside", "4"], spark) == 0
    a = spark.read.parquet(f"{tmp_path}/a.parquet").join(grid.grid(spark, 4).withColumnRenamed("cell_ring", "cell"), "cell")
    assert a.columns[1] == "u" and a.count() > 150 and a.filter(F.abs(F.col("u") - F.col("z")) > 0.05).isEmpty()
    cells = grid.grid(spark, 4).select(F.col("cell_ring").alias("cell"), "lon", "lat", F.col("z").alias("x"), (F.col("z") * 2).alias("y"))
    cells.write.parquet(f"{tmp_path}/cells.parquet")
    assert cli.main(["convert", f"{tmp_path}/cells.parquet", f"{tmp_path}/b.parquet", "--nside", "4"], spark) == 0
    b = spark.read.parquet(f"{tmp_path}/b.parquet")
    assert b.columns == ["cell", "x", "y"] and b.join(cells.select("cell", F.col("x").alias("truth")), "cell").filter(F.abs(F.col("x") - F.col("truth")) > 1e-6).isEmpty()
