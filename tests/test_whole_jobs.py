"""Queries that must do their whole job: all rows of their tables, in no task of a whole group."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparktrode.operators import samples as P
from sparktrode.operators import spectral
from sparktrode.operators import spikes as K
from sparktrode.plans import base, files, registry, trains
from sparktrode.sources import intan

SF = "/root/testdata/sf0.001"


def test_phase_filter_keeps_all_recorded_phases(spark):
    got = registry.queries()["p22_phase_filter"](spark, SF)
    every = registry.queries()["c1_tumbling_ceil"](spark, SF).select("recording_index").distinct().count()
    assert every == 5 and {r[0] for r in got.select("recording_index").distinct().collect()} == {1, 3, 5}
    assert {r[0] for r in got.select("comparisons").distinct().collect()} == {"Baseline,Post"}


def tasks_of_groups(df):
    """Windows of the plan that are dealt by `recording` alone, so that one task holds a whole recording."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x for x in plan.splitlines() if "Window" in x and "row_number" in x]


def test_raw_words_are_numbered_in_ranges(spark):
    raw = base.raw_words(spark, SF)
    assert not tasks_of_groups(raw)
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    rows = sorted(tuple(r) for r in base.table(spark, SF, "lineitem").select(*order).collect())
    want, count = [], {}
    for r in rows:
        k = count[r[3] % 4] = count.get(r[3] % 4, -1) + 1
        want.append((r[3] % 4, k, k + k // 100, int(r[4]) % 65536))
    assert sorted(tuple(r) for r in raw.collect()) == sorted(want)


def test_small_files_share_tasks(spark, tmp_path):
    channels = [(0, "A-000")]
    for k in range(300):
        words = {"amplifier": np.full((1, 128), k)}
        (tmp_path / f"r{k:03}.rhd").write_bytes(intan.write_recording(channels, words, np.arange(128)))
    for kind in ("samples", "metadata"):
        parts = intan.RecordingReader({"path": str(tmp_path), "table": kind}).partitions()
        assert 64 <= len(parts) < 150
    got = intan.read(spark, str(tmp_path)).groupBy("recording").agg(F.count("n").alias("c"), F.max("raw").alias("raw")).collect()
    assert {(r["recording"], r["c"], r["raw"]) for r in got} == {(f"r{k:03}", 128, k) for k in range(300)}
    assert intan.read(spark, str(tmp_path), table="metadata").count() == 300


def test_blocks_of_spike_queries_are_long_and_change_no_result(spark):
    assert min(trains.B, trains.BLOCK) >= 1 << 14
    x = trains.fast(spark, SF)
    rows = lambda df: sorted((r[0], r[1], r["n"], round(r["width"], 6)) for r in df.collect())
    at = K.peaks(P.robust_z(x), 1.2, ends=K.series_ends(x), block=16)
    whole = K.half_prominence_width(trains.found(spark, SF), x, trains.B)
    assert rows(K.half_prominence_width(at, x, 16)) == rows(whole)


def test_welch_takes_all_segments(spark):
    """More than 2000 segments, over more than one block."""
    n = 300_000
    rows = spark.range(n).select(F.lit(1).alias("recording_index"), F.lit("a").alias("channel"), F.col("id").alias("n"), ((F.col("id") * 7919 % 1013) * F.col("id") / n).alias("x_uv"))
    got = [r["pxx"] for r in spectral.welch(rows, 100.0).orderBy("f_hz").collect()]
    x = (np.arange(n) * 7919 % 1013) * np.arange(n) / n
    parts = np.lib.stride_tricks.sliding_window_view(x, 200)[::100]
    assert len(parts) == 2999 and np.allclose(got, spectral.density(parts, 100.0).mean(0), rtol=1e-9)
    assert not np.allclose(got, spectral.density(parts[:2000], 100.0).mean(0), rtol=1e-3)


def test_files_are_dealt_by_the_rows_of_the_table(spark, monkeypatch):
    few = base.table(spark, SF, "lineitem").count() // 30
    monkeypatch.setattr(base, "RANGE_ROWS", few)
    words = files.words_of_files(spark, SF)
    assert words.rdd.getNumPartitions() >= 30 > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert words.select("file", F.spark_partition_id()).distinct().count() == words.select("file").distinct().count()


@pytest.mark.parametrize("name", ["d2_auxiliary", "d3_board_adc", "d4_dc_amplifier", "d5_digital", "d6_stim_word", "d7_stim_current", "d9_seconds"])
def test_tasks_of_word_queries_hold_a_range(spark, monkeypatch, name):
    """A task numbers a range of rows, of four recordings or not, so its memory doesn't grow with the table."""
    rows = base.table(spark, SF, "lineitem").count()
    monkeypatch.setattr(base, "RANGE_ROWS", rows // 30)
    got = registry.queries()[name](spark, SF)
    assert not tasks_of_groups(got)
    numbered = spark.read.parquet(*got.inputFiles())  # a file a task
    held = [r["count"] for r in numbered.groupBy(F.input_file_name()).count().collect()]
    assert sum(held) == rows and len(held) >= 30 and max(held) < 2 * base.RANGE_ROWS


def test_triggered_spectrogram_sums_in_batches(spark):
    missing = (F.col("id") % 500 == 77) | (F.col("id") == 1400)
    line = spark.range(3000).select(F.lit(1).alias("recording_index"), F.lit("a").alias("channel"), F.col("id").alias("n"), F.when(~missing, F.cos(F.col("id") * 0.37)).alias("x_uv"))
    at = [5, 47, 48, 80, 500, 880, 1100, 1390, 2000, 2951, 2952, 2999]
    found = spark.createDataFrame([(1, "a", n) for n in at], "recording_index int, channel string, n long")
    waves = K.waveforms(found, line, 48, 48)
    got = spectral.triggered_spectrogram(waves, 200.0, 10.0)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode(pythonUDF" not in plan and "collect_list" not in plan  # a row each cell, or sample, of each spike
    x = np.where([k % 500 == 77 or k == 1400 for k in range(3000)], np.nan, np.cos(np.arange(3000) * 0.37))
    cut = {r["n"]: [np.nan if v is None else v for v in r["wave"]] for r in waves.collect()}
    assert sorted(cut) == [n for n in at if n >= 48 and n + 48 <= 2999]
    for n, wave in cut.items():
        np.testing.assert_allclose(wave, x[n - 48 : n + 48])
    rows = np.array([x[n - 48 : n + 48] for n in cut])
    want = {}
    for s in (0, 32):
        p = 10 * np.log10(spectral.density(rows[:, s : s + 64], 200.0, "tukey") + spectral.EPS)
        want |= {(round((s + 32 - 48) / 200, 9), k * 200 / 64): np.nanmean(p[:, k]) for k in range(4)}
    have = {(round(r["t_s"], 9), r["f_hz"]): r["db"] for r in got.collect()}
    assert have.keys() == want.keys()
    for k in want:
        assert abs(have[k] - want[k]) < 1e-9
