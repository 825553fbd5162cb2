"""Units, CF rules, readers, writers, commands and streams."""

import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonalis import cli
from zonalis.functions import cf, units
from zonalis.functions import healpix as hp
from zonalis.operators import compare, extract, grid, regrid
from zonalis.sources import readers, writers
from zonalis.streaming import zonal


@pytest.mark.parametrize(("a", "b", "m", "offset"), [("hPa", "Pa", 100, 0), ("degC", "K", 1, 273.15), ("km h-1", "m s-1", 1 / 3.6, 0), ("kg / m**3", "g cm-3", 1e-3, 0), ("K", "kelvin", 1, 0)])
def test_conversion(a, b, m, offset):
    got = units.components(a, b)
    assert got == pytest.approx((m, offset))
    assert units.compatible(a, b)


def test_units_that_do_not_fit():
    with pytest.raises(ValueError):
        units.components("Pa", "K")
    with pytest.raises(ValueError):
        units.parse("furlong")
    assert units.equivalent("m s-1", "m/s") and not units.equivalent("hPa", "Pa")


def with_meta(spark, **columns):
    df = spark.createDataFrame([tuple(1.0 for _ in columns)], ", ".join(f"{c} double" for c in columns))
    return df.select(*[F.col(c).alias(c, metadata=m) for c, m in columns.items()])


def test_coordinates_and_variables(spark):
    df = with_meta(spark, x={"standard_name": "longitude", "units": "degrees_east"}, y={"axis": "Y"}, z_mc={"units": "m", "axis": "Z"}, ua={}, some={"standard_name": "air_temperature", "units": "K"}, other={"units": "K"})
    assert cf.find_coordinate(df, "lon") == "x" and cf.find_coordinate(df, "lat") == "y" and cf.find_coordinate(df, "level") == "z_mc"
    assert cf.find_variable(df, "u") == "ua" and cf.find_variable(df, "temperature") == "some"
    assert cf.find_variable(df, "density") is None and cf.find_coordinate(df, "time", required=False) is None
    assert cf.vertical_axis(df, ["x", "z_mc"]) == "z_mc" and cf.is_height(df, "z_mc") and not cf.is_pressure(df, "z_mc")
    with pytest.raises(KeyError):
        cf.find_coordinate(df, "time")


def test_unlabelled_values_get_units_by_range(spark):
    df = spark.createDataFrame([(250.0, 5.0), (300.0, 500.0)], "temp double, u double")
    assert units.units_of(units.check_and_convert(df, {"temp": "temp"}), "temp") == "K"
    with pytest.raises(ValueError):
        units.check_and_convert(df, {"u": "u"})


def test_longitudes_and_levels(spark):
    whole = spark.range(36).select((F.col("id") * 10.0 - 180).alias("lon"))
    assert cf.is_global_longitude(whole, "lon") and not cf.is_global_longitude(whole.filter("lon < 0"), "lon")
    assert cf.is_level_index(spark.range(1, 40).withColumnRenamed("id", "l"), "l")
    assert not cf.is_level_index(spark.createDataFrame([(1.5,), (2.0,)], "l double"), "l")
    assert cf.is_geographic(whole.withColumn("lat", F.lit(45.0)), "lon", "lat")
    hours = spark.sql("select timestamp'2020-01-01' + make_interval(0, 0, 0, 0, 3 * id) as t from range(5)")
    assert cf.time_step_hours(hours, "t") == pytest.approx(3.0)


def test_pixel_counts():
    assert hp.is_valid_npix(192) and not hp.is_valid_npix(108) and not hp.is_valid_npix(100)
    assert hp.nside_for(192) == 4 and hp.nside_for(1000) == 8 and hp.nside_for_zoom(3) == 8
    assert cf.order_of({"healpix": {"indexing_scheme": "nested"}}) == "nested" and cf.order_of({}) == "ring"


def test_missing_values_become_null(spark):
    df = spark.createDataFrame([(1.0, math.nan), (-999.0, 2.0)], "a double, b double")
    assert [tuple(r) for r in readers.clean(df, -999.0).collect()] == [(1.0, None), (None, 2.0)]


def test_mapping_and_names(spark):
    mapping = readers.load_mapping("temp: ta  # kelvin\nu: 'ua'\n# nothing\nw: wa\n")
    df = spark.createDataFrame([(1, 2.0, 3.0)], "cell long, ta double, ua double")
    out, missing = readers.rename_mapped(df, mapping, ["cell"])
    assert out.columns == ["cell", "temp", "u"] and missing == ["w"]
    assert readers.output_name("{name_no_ext}_hp.parquet", "/a/b/x.nc") == "x_hp.parquet"
    assert readers.is_swath({"Mission": "TIMED", "Title": "SABER L2A"}) and not readers.is_swath({})


def test_write_and_read(spark, tmp_path):
    df = spark.range(12).select(F.col("id").alias("cell"), F.lit(1.0).alias("x"))
    path = writers.write_field(df, str(tmp_path / "f.parquet"), meta=writers.metadata(1, "ring", ["older"], "made"))
    assert spark.read.parquet(path).count() == 12
    meta = writers.read_metadata(spark, path)
    assert meta["healpix_nside"] == 1 and meta["history"][-1] == "older"
    with pytest.raises(Exception, match="(?i)exist"):
        writers.write_field(df, path)
    writers.write_field(df, path, overwrite=True)
    with pytest.raises(ValueError):
        writers.check_paths(path, path + "/")


def test_statistics_as_text(spark):
    ref = spark.range(48).select(F.lit(1.0).alias("level"), F.col("id").alias("cell"), F.col("id").cast("double").alias("u"))
    stats = compare.compare(ref, ref.withColumn("u", F.col("u") + 1), ["u"], nside=2, keys=["level"], reduce="none")
    row = stats.filter("level is null").first()
    assert row["n"] == 48 and row["bias"] == pytest.approx(1) and row["r"] == pytest.approx(1) and row["crmse"] == pytest.approx(0, abs=1e-6)
    assert "\\toprule" in writers.format_statistics(stats, "latex") and writers.format_statistics(stats, "markdown").count("|") > 30
    assert writers.format_statistics(stats, "csv").splitlines()[0].startswith("Variable,Level,N")
    assert "\x1b[32m" in writers.format_statistics(stats, color=True)
    with pytest.raises(ValueError):
        writers.format_statistics(stats, "pdf")


def test_constant_field_has_no_correlation(spark):
    ref = spark.range(12).select(F.col("id").alias("cell"), F.lit(2.0).alias("u"))
    row = compare.compare(ref, ref, ["u"], nside=1, keys=[], level=None, reduce="none").first()
    assert row["r"] is None and row["skill"] is None and row["bias"] == 0


def test_no_common_time_is_an_error(spark):
    df = spark.range(3).withColumnRenamed("id", "time")
    with pytest.raises(ValueError):
        compare.align_time(df, df.withColumn("time", F.col("time") + 10))


def test_interpolation_of_a_smooth_field(spark):
    cells = grid.grid(spark, 8)
    field = cells.select(F.col("cell_ring").alias("cell"), F.lit(1.0).alias("level"), "z")
    out = extract.along(field.withColumnRenamed("z", "x"), extract.meridian_targets(spark, 8, 33.0), 8, ["level"], ["x"])
    assert out.filter(F.abs(F.col("x") - F.sin(F.radians("lat"))) > 0.02).isEmpty() and out.count() == 32


def test_nearest_neighbours_match_brute_force(spark):
    from zonalis.operators.neighbours import nearest

    sources = spark.range(60).select(F.col("id").alias("cell"), (F.col("id") * 77 % 360).cast("double").alias("lon"), (F.col("id") * 37 % 171 - 85).cast("double").alias("lat"))
    targets = spark.range(40).select(F.col("id").alias("target"), (F.col("id") * 91 % 360).cast("double").alias("lon"), (F.col("id") * 53 % 179 - 89).cast("double").alias("lat"))
    got = {(r["target"], r["rank"]): r["cell"] for r in nearest(sources, targets, 3, start=0.05).collect()}
    vector = lambda r: (math.cos(math.radians(r["lat"])) * math.cos(math.radians(r["lon"])), math.cos(math.radians(r["lat"])) * math.sin(math.radians(r["lon"])), math.sin(math.radians(r["lat"])))
    points = [(r["cell"], vector(r)) for r in sources.collect()]
    for t in targets.collect():
        v = vector(t)
        order = sorted(points, key=lambda p: (round(sum((a - b) ** 2 for a, b in zip(p[1], v, strict=True)), 12), p[0]))
        assert [got[t["target"], k] for k in (1, 2, 3)] == [p[0] for p in order[:3]]


def test_gap_far_from_sources_stays_empty(spark):
    sources = spark.createDataFrame([(0, 0.0, 0.0), (1, 1.0, 0.0), (2, 0.0, 1.0)], "cell long, lon double, lat double")
    targets = spark.createDataFrame([(5, 0.5, 0.5), (6, 90.0, 0.0)], "target long, lon double, lat double")
    assert {r["target"] for r in regrid.idw_weights(sources, targets).collect()} == {5}


def test_empty_slice_stays_after_gap_filling(spark):
    points = grid.grid(spark, 1).select(F.col("cell_ring").alias("cell"), "lon", "lat")
    field = spark.range(12).select(F.col("id").alias("cell"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("time")).withColumn("x", F.when((F.col("time") != 2) & (F.col("cell") != 4), F.col("time") * 10.0))
    space = regrid.gaps(field, points, ["time"], "x")
    assert space.filter("time <> 2 and x is null").isEmpty() and space.filter("time = 2 and x is not null").isEmpty()
    done = regrid.time_gaps(space, "time", ["cell"], "x")
    assert [r["x"] for r in done.filter("time = 2").select("x").distinct().collect()] == [20.0]


def test_commands(spark, tmp_path):
    field = grid.grid(spark, 4).select(F.col("cell_ring").alias("cell"), F.lit(1.0).alias("level"), (20 * F.col("z")).alias("u"), (5 * F.cos(F.radians("lon"))).alias("v"))
    source = writers.write_field(field, str(tmp_path / "in.parquet"), meta=writers.metadata(4, "ring"))
    runs = {
        "zonal-mean": [], "extract-lat": ["--lat", "10"], "extract-lon": ["--lon", "10"], "extract-point": ["--lat", "10", "--lon", "20"], "regrade": ["--nside", "2"], "spectrum": ["--var", "u", "--lmax", "3"],
        "filter": ["--lmax", "2"], "uv2dv": [], "helmholtz": ["--no-psi"], "fill": [], "plot": ["--type", "section", "--var", "u"],
    }
    for command, options in runs.items():
        target = str(tmp_path / f"{command}.parquet")
        assert cli.main([command, source, target, *options], spark) == 0
        assert spark.read.parquet(target).count() > 0
    assert cli.main(["dv2uv", str(tmp_path / "uv2dv.parquet"), str(tmp_path / "back.parquet")], spark) == 0
    saved = tmp_path / "stats.csv"
    assert cli.main(["compare", source, str(tmp_path / "filter.parquet"), "--format", "csv", "--save", str(saved), "--by-level"], spark) == 0
    assert len(saved.read_text().splitlines()) == 5
    with pytest.raises(ValueError):
        cli.main(["zonal-mean", source, source], spark)


def test_convert_unstructured(spark, tmp_path):
    cells = grid.grid(spark, 8).select(F.col("cell_ring").alias("cell"), "lon", "lat", F.cos(F.radians("lat")).alias("x"))
    source = writers.write_field(cells, str(tmp_path / "raw.parquet"))
    assert cli.main(["convert", source, str(tmp_path / "hp.parquet"), "--nside", "8"], spark) == 0
    out = spark.read.parquet(str(tmp_path / "hp.parquet")).join(cells.withColumnRenamed("x", "truth"), "cell")
    assert out.count() == 768 and out.filter(F.abs(F.col("x") - F.col("truth")) > 1e-6).isEmpty()


def test_stream_of_files(spark, tmp_path):
    schema = T.StructType([T.StructField("time", T.TimestampType()), T.StructField("z", T.DoubleType()), T.StructField("t", T.DoubleType()), T.StructField("value", T.DoubleType())])
    rows = spark.sql("select timestamp'2024-01-01' + make_interval(0, 0, 0, 0, id) as time, (id % 19) / 10 - 0.9D as z, (id % 40) / 10D as t, cast(id as double) as value from range(200)")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = zonal.watch(spark, str(tmp_path / "in"), schema)
    out = zonal.windowed_bins(stream, 2, "value", time="time", z=F.col("z"), t=F.col("t"))
    zonal.run_available(out, str(tmp_path / "out"), str(tmp_path / "check"))
    done = spark.read.parquet(str(tmp_path / "out"))
    batch = zonal.windowed_bins(rows, 2, "value", time="time", z=F.col("z"), t=F.col("t"))
    # The last days wait for the watermark; what is out equals the batch.
    assert done.count() > 0 and done.exceptAll(batch).isEmpty()
