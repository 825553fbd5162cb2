"""Wavelet outputs by time, period and part, significance, and commands over sets of files."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonalis import cli
from zonalis.operators import spectral, tides, wavelet
from zonalis.sources import readers
from tests.test_harmonics import tide


@pytest.fixture(scope="module")
def rings(spark):
    field, _ = tide(spark, 1)
    return spectral.ring_fourier(field, 4, ["hour"], "x", [1]).cache()


def test_tides_of_every_time_follow_the_transform(spark, rings):
    out = tides.wavelet_tides(rings, 4, [], "hour", 1, 1.0, [24.0, 12.0], temporal_mean=False)
    hours = rings.select("hour").distinct().count()
    assert out.count() == 15 * hours * 2 and out.groupBy("ring", "period_h").count().filter(F.col("count") != hours).isEmpty()
    own = rings.filter("ring = 8").orderBy("hour").toPandas()
    (wa, period), (wb, _) = (wavelet.scaled(own[c].to_numpy(), 1.0, 0.1) for c in ("a", "b"))
    west, west_phase, east, _ = wavelet.directions(wa, wb)
    k = np.abs(period - 24).argmin()
    mine = out.filter("ring = 8 and period_h = 24").orderBy("hour").toPandas()
    assert np.allclose(mine["west_amplitude"], west[k]) and np.allclose(mine["west_phase"], west_phase[k]) and np.allclose(mine["east_amplitude"], east[k])
    means = tides.wavelet_tides(rings, 4, [], "hour", 1, 1.0, [24.0]).filter("ring = 8").first()
    turn = 2 * math.pi / period[k] * np.arange(hours)
    assert means["west_amplitude"] == pytest.approx(abs((west[k] * np.exp(1j * (west_phase[k] + turn))).mean()))


def test_parts_add_up_and_reach_all_cells(spark, rings):
    parts = tides.wavelet_tides(rings, 4, [], "hour", 1, 1.0, [24.0], sym_asy=True, temporal_mean=False)
    whole = tides.wavelet_tides(rings, 4, [], "hour", 1, 1.0, [24.0], temporal_mean=False)
    vector = lambda df: df.withColumns({"x": F.col("west_amplitude") * F.cos("west_phase"), "y": F.col("west_amplitude") * F.sin("west_phase")})
    summed = vector(parts).groupBy("ring", "hour").agg(F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.count("*").alias("n"))
    both = vector(whole).join(summed, ["ring", "hour"])
    assert both.filter("n <> 2 or abs(x - sx) > 1e-9 or abs(y - sy) > 1e-9").isEmpty() and both.count() == whole.count()
    mirrored = parts.select("part", "hour", (16 - F.col("ring")).alias("ring"), F.col("west_amplitude").alias("other")).join(parts, ["part", "hour", "ring"])
    assert mirrored.filter("abs(other - west_amplitude) > 1e-9").isEmpty()
    cells = tides.on_cells(tides.wavelet_tides(rings, 4, [], "hour", 1, 1.0, [24.0]), spark, 4)
    assert cells.count() == 192 and cells.select("cell").distinct().count() == 192


def test_spectra_within_a_window_of_periods(spark):
    field, _ = tide(spark, 1)
    whole = wavelet.fourier_wavelet_spectrum(field, 4, [], "hour", "x", 1, 1.0)
    part = wavelet.fourier_wavelet_spectrum(field, 4, [], "hour", "x", 1, 1.0, window=(10.0, 30.0))
    assert part.exceptAll(whole.filter("period_h between 10 and 30")).isEmpty() and 0 < part.count() < whole.count()
    assert part.count() == whole.filter("period_h between 10 and 30").count()
    assert wavelet.harmonic_wavelet_spectrum(field, 4, [], "hour", "x", 1, 1.0, lmax=3, window=(10.0, 30.0)).filter("period_h not between 10 and 30").isEmpty()
    assert wavelet.fourier_wavelet_spectrum(field, 4, [], "hour", "x", 1, 1.0, window=(500.0, 600.0)).isEmpty()


@pytest.mark.parametrize("mother", ["MORLET", "PAUL", "DOG"])
def test_a_wave_is_significant_and_noise_is_not(spark, mother):
    n, rng = 256, np.random.default_rng(5)
    rows = [("wave", k, float(3 * math.cos(2 * math.pi * k / 16) + rng.normal())) for k in range(n)] + [("noise", k, float(rng.normal())) for k in range(n)] + [("flat", k, 2.0) for k in range(n)] + [("short", 0, 1.0), ("wave", 999, None)]
    out = wavelet.series_power(spark.createDataFrame(rows, "name string, time long, y double"), ["name"], "time", "y", 1.0, mother=mother).toPandas()
    assert set(out["name"]) == {"wave", "noise"} and out["time"].max() == n - 1
    inside = out[out["period_h"] <= out["coi_h"]]
    near = inside[(inside["name"] == "wave") & ((inside["period_h"] / 16 - 1).abs() < 0.15)]
    quiet = inside[inside["name"] == "noise"]
    # PAUL and DOG resolve periods less sharply, so a wave's power there comes and goes about the threshold.
    assert near["power"].max() > near["threshold"].max()
    assert mother != "MORLET" or (near["power"] > near["threshold"]).mean() > 0.9
    assert (quiet["power"] > quiet["threshold"]).mean() < 0.15


@pytest.mark.parametrize(("mother", "dof"), [("MORLET", 2), ("PAUL", 2), ("DOG", 1)])
def test_power_of_white_noise_is_its_variance(mother, dof):
    y = np.random.default_rng(1).normal(size=8192)
    wave, period, _, _ = wavelet.transform(y, 1.0, mother=mother)
    power, kept = np.abs(wave) ** 2, (period > 3) & (period < 60)
    assert np.allclose(power[kept].mean(axis=1), 1, atol=0.2)
    bound = wavelet.significance(y.var(), 0.0, len(y), 1.0, period, 0.95, dof)
    assert (power[kept] > bound[kept][:, None]).mean() == pytest.approx(0.05, abs=0.015)


def test_files_of_a_pattern_one_by_one_and_together(spark, tmp_path):
    cells = spark.range(48).select(F.col("id").alias("cell"), F.lit(1.0).alias("level"), F.sin("id").alias("x"))
    for day in (1, 2):
        cells.withColumn("time", F.lit(float(day))).write.parquet(f"{tmp_path}/day{day}.parquet")
    assert [p.rsplit("/", 1)[1] for p in readers.matching(spark, f"{tmp_path}/day*.parquet")] == ["day1.parquet", "day2.parquet"]
    with pytest.raises(FileNotFoundError):
        readers.matching(spark, f"{tmp_path}/none*.parquet")
    assert cli.main(["zonal-mean", f"{tmp_path}/day*.parquet", f"{tmp_path}/{{name_no_ext}}_zm.parquet"], spark) == 0
    for day in (1, 2):
        one = spark.read.parquet(f"{tmp_path}/day{day}_zm.parquet")
        assert one.count() == 7 and {r["time"] for r in one.select("time").distinct().collect()} == {float(day)}
    assert cli.main(["convert", f"{tmp_path}/day[12].parquet", f"{tmp_path}/both.parquet", "--nside", "2"], spark) == 0
    assert spark.read.parquet(f"{tmp_path}/both.parquet").count() == 96


def test_zonal_means_of_an_unstructured_table(spark, tmp_path):
    rows = [(k, -89.0 + 2 * (k % 90), 360.0 * k / 500, float(k % 90)) for k in range(500)]
    spark.createDataFrame(rows, "cell long, lat double, lon double, x double").write.parquet(f"{tmp_path}/points.parquet")
    cli.main(["zonal-mean", f"{tmp_path}/points.parquet", f"{tmp_path}/bands.parquet", "--bands", "90"], spark)
    out = spark.read.parquet(f"{tmp_path}/bands.parquet")
    assert out.count() == 90 and out.filter(F.abs(F.col("lat") - (-89 + 2 * F.col("x"))) > 1e-9).isEmpty()
