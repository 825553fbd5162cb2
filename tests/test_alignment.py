"""Comparison of data sets on different axes and in different units; paths and angles of commands."""

import math

import pytest
from pyspark.sql import functions as F

from zonalis import cli
from zonalis.operators import compare as cp
from zonalis.operators import grid
from zonalis.sources import writers


def field(spark, nside, levels, offset=0.0, units=None, factor=1.0):
    cells = grid.grid(spark, nside).select(F.col("cell_ring").alias("cell"), "lat")
    own = cells.crossJoin(spark.createDataFrame([(float(x),) for x in levels], "level double"))
    value = (250 + 30 * F.cos(F.radians("lat")) + F.col("level") + offset) * factor
    return own.select("level", "cell", value.alias("temp", metadata={"units": units} if units else {}))


def test_levels_that_differ_meet_in_the_overlap(spark):
    ref, cmp = field(spark, 4, [10, 20, 30, 40]), field(spark, 4, [15, 22, 28, 36, 50], offset=2.0)
    rows = {r["level"]: r for r in cp.compare(ref, cmp, ["temp"], nside=4).collect()}
    assert set(rows) == {None, 20.0, 30.0, 40.0}
    assert all(r["bias"] == pytest.approx(2.0) and r["n"] == (15 if k else 45) for k, r in rows.items())


def test_resolutions_that_differ_meet_at_latitudes(spark):
    rows = cp.compare(field(spark, 8, [1, 2]), field(spark, 4, [1, 2], offset=1.0), ["temp"], nside=8, nside_cmp=4).collect()
    assert {r["level"] for r in rows} == {None, 1.0, 2.0} and all(abs(r["bias"] - 1.0) < 0.2 for r in rows)
    with pytest.raises(ValueError):
        cp.compare(field(spark, 8, [1]), field(spark, 4, [1]), ["temp"], nside=8, nside_cmp=4, reduce="none")


def test_units_and_chosen_levels(spark):
    ref, cmp = field(spark, 4, [10, 20, 30], units="m/s"), field(spark, 4, [10, 20, 30], units="km/s", factor=1e-3)
    rows = {r["level"]: r for r in cp.compare(ref, cmp, ["temp"], nside=4, select_levels=[12.0, 29.0]).collect()}
    assert set(rows) == {None, 10.0, 30.0} and all(r["bias"] == pytest.approx(0.0, abs=1e-9) for r in rows.values())
    with pytest.raises(ValueError):
        cp.compare(ref, field(spark, 4, [10, 20, 30], units="K"), ["temp"], nside=4)


def test_empty_sides_say_so(spark):
    with pytest.raises(ValueError, match="no values"):
        cp.compare(field(spark, 2, [1]).limit(0), field(spark, 2, [1]), ["temp"], nside=2).collect()


@pytest.mark.parametrize(("a", "b"), [("a/", "./a"), ("a/../b", "b"), ("file:/tmp/x", "/tmp/x/"), ("file:///tmp/x", "/tmp/x")])
def test_one_path_by_two_names(a, b):
    with pytest.raises(ValueError):
        writers.check_paths(a, b)
    writers.check_paths(a, "elsewhere")


def test_radians_and_history(spark, tmp_path):
    rows = [(x * math.pi / 8, y * math.pi / 9, float(y)) for x in range(16) for y in range(-4, 5)]
    spark.createDataFrame(rows, "lon double, lat double, temp double").write.parquet(f"{tmp_path}/in")
    assert cli.main(["convert", f"{tmp_path}/in", f"{tmp_path}/grid", "--nside", "2"], spark) == 0
    north = spark.read.parquet(f"{tmp_path}/grid").filter("cell < 4").agg(F.avg("temp")).first()[0]
    assert north == pytest.approx(3.3, abs=0.8)
    assert cli.main(["regrade", f"{tmp_path}/grid", f"{tmp_path}/coarse", "--nside", "1"], spark) == 0
    assert len(writers.read_metadata(spark, f"{tmp_path}/coarse")["history"]) == 2
