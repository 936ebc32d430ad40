"""Recording files of all versions written and read back, and labels' quirks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparktrode.functions import labels
from sparktrode.operators import decode, samples, statistics, windows
from sparktrode.sources import intan, tables

RHD = [(0, "A-000"), (0, "A-001"), (1, "AUX1"), (2, "VDD"), (3, "ADC-0"), (4, "DIN-0"), (5, "DOUT-0")]
RHS = [(0, "A-000"), (3, "ADC-0"), (4, "DAC-0"), (5, "DIN-0"), (6, "DOUT-0")]


def write(path, version=(2, 0), variant="rhd", samples=300, **more):
    rng = np.random.default_rng(1)
    words = {k: rng.integers(0, 65536, (c, samples)) for k, c in (("amplifier", 2 if variant == "rhd" else 1), ("dc", 1), ("stim", 1), ("aux", 1), ("supply", 1), ("temp", more.get("temps", 0)), ("adc", 1), ("dac", 1), ("din", 1), ("dout", 1))}
    ticks = np.arange(samples) - 5 if version >= (1, 2) else np.arange(samples)
    path.write_bytes(intan.write_recording(RHS if variant == "rhs" else RHD, words, ticks, version=version, variant=variant, **more))
    return words, ticks


@pytest.mark.parametrize("version, per_block", [((1, 0), 60), ((1, 2), 60), ((2, 0), 128), ((3, 0), 128)])
def test_rhd_round_trip(spark, tmp_path, version, per_block):
    words, ticks = write(tmp_path / "r.rhd", version, temps=1 if version >= (1, 1) else 0, board=13)
    intan.register(spark)
    read = lambda **o: spark.read.format("recording").option("path", str(tmp_path)).options(**{"bytesPerTask": "1500"} | o).load()
    n = 300 // per_block * per_block
    got = read().orderBy("channel", "n").collect()
    assert [r["raw"] for r in got] == words["amplifier"][:, :n].ravel().tolist()
    assert [r["tick"] for r in got[:n]] == ticks[:n].tolist()
    aux = read(signal="aux").orderBy("n").collect()
    assert [r["raw"] for r in aux] == words["aux"][0, : n // 4].tolist() and [r["tick"] for r in aux] == ticks[:n:4].tolist()
    assert [r["raw"] for r in read(signal="dout").orderBy("n").collect()] == words["dout"][0, :n].tolist()
    meta = read(table="metadata").first()
    assert (meta["samples_per_block"], meta["blocks"], meta["reference_channel"]) == (per_block, n // per_block, "REF" if version[0] > 1 else None)
    assert read(table="channels").count() == 7


def test_rhs_round_trip_with_and_without_dc(spark, tmp_path):
    intan.register(spark)
    for dc in (False, True):
        folder = tmp_path / str(dc)
        folder.mkdir()
        words, _ = write(folder / "r.rhs", (1, 0), "rhs", dc=dc)
        read = lambda s, f=folder: [r["raw"] for r in spark.read.format("recording").option("path", str(f)).option("signal", s).load().orderBy("n").collect()]
        assert read("stim") == words["stim"][0, :256].tolist() and read("dac") == words["dac"][0, :256].tolist()
        assert read("dc") == (words["dc"][0, :256].tolist() if dc else [])


def test_header_only_and_broken_files(spark, tmp_path):
    intan.register(spark)
    write(tmp_path / "h.rhd", samples=10)
    load = lambda **o: spark.read.format("recording").option("path", str(tmp_path)).options(**o).load()
    assert load().count() == 0 and load(table="metadata").first()["blocks"] == 0
    (tmp_path / "h.rhd").write_bytes((tmp_path / "h.rhd").read_bytes() + b"x")
    with pytest.raises(Exception, match="whole number"):
        load().count()


@pytest.fixture
def wide_file(tmp_path):
    """One file of 32 channels and 40 blocks, and a second recording beside it."""
    channels = [(0, f"A-{k:03}") for k in range(32)] + [(3, "ADC-0")]
    rng = np.random.default_rng(2)
    words = {"amplifier": rng.integers(0, 65536, (32, 128 * 40)), "adc": rng.integers(0, 65536, (1, 128 * 40))}
    for name in ("one", "two"):
        (tmp_path / f"{name}.rhd").write_bytes(intan.write_recording(channels, words, np.arange(128 * 40)))
    return tmp_path, words["amplifier"]


def read_counted(monkeypatch, folder, **options):
    """Rows, bytes read of the blocks, and partitions of the source itself."""
    count = [0]

    class Counted:
        def __init__(self, source):
            self.source = source

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.source.close()

        def __getattr__(self, name):
            return getattr(self.source, name)

        def read(self, n):
            count[0] += n
            return self.source.read(n)

    plain = intan.RecordingReader.open
    monkeypatch.setattr(intan.RecordingReader, "open", staticmethod(lambda path: (lambda x: (Counted(x[0]), x[1]))(plain(path))))
    reader = intan.RecordingReader({"path": str(folder)} | options)
    parts = reader.partitions()
    count[0] = 0
    heads = [reader.header(p.path) and count[0] for p in parts]
    head = heads[0] if heads else 0
    count[0] = 0
    rows = [r for p in parts for batch in reader.read(p) for r in batch.to_pylist()]
    monkeypatch.setattr(intan.RecordingReader, "open", staticmethod(plain))
    return rows, count[0] - head * len(parts), parts


def test_what_is_wanted_saves_bytes_and_partitions(monkeypatch, wide_file):
    folder, x = wide_file
    block = 4 * 128 + 2 * 128 * 33
    every, whole, parts = read_counted(monkeypatch, folder, bytesPerTask="50000")
    assert len(every) == 2 * x.size and whole <= 2 * 40 * block and len(parts) > 10
    only = {"recordings": '["one"]', "channels": '["A-003", "A-004", "A-030"]'}
    rows, used, _ = read_counted(monkeypatch, folder, mergeBytes="0", **only)
    assert used == 40 * (4 * 128 + 3 * 2 * 128)
    assert {(r["recording"], r["channel"]) for r in rows} == {("one", c) for c in ("A-003", "A-004", "A-030")}
    assert [r["raw"] for r in rows if r["channel"] == "A-004"] == x[4].tolist()
    merged, more, _ = read_counted(monkeypatch, folder, mergeBytes="1000000", **only)
    assert merged == rows and used < more <= 40 * block
    ranged, few, some = read_counted(monkeypatch, folder, recordings='["two"]', first="1290", last="1535", bytesPerTask="10000")
    assert few <= 2 * block and len(some) == 2 and sorted({r["n"] for r in ranged}) == list(range(1290, 1536))
    assert read_counted(monkeypatch, folder, first="1000000")[2] == [] and read_counted(monkeypatch, folder, recordings="[]")[2] == []
    assert read_counted(monkeypatch, folder, channels='["none"]')[:2] == ([], 0)


def test_wanted_samples_in_spark(spark, wide_file):
    folder, x = wide_file
    df = intan.read(spark, str(folder), ["one"], ["A-007", "A-009"], 100, 299)
    assert [r["raw"] for r in df.orderBy("channel", "n").collect()] == [*x[7, 100:300].tolist(), *x[9, 100:300].tolist()]
    every = intan.read(spark, str(folder))
    assert every.count() == 2 * x.size and every.filter("channel = 'A-001' or n < 3").count() == 2 * (128 * 40 + 31 * 3)
    assert intan.read(spark, str(folder), first=10**6).count() == 0 and intan.read(spark, str(folder), signal="adc", last=9).count() == 20


def test_phase_quirks(spark):
    rows = spark.createDataFrame([("High pressure",), ("wash out",), (" ",), ("nan",), (None,), ("-70nA",)], "label string")
    got = [r["p"] for r in rows.select(labels.phase(F.col("label")).alias("p")).collect()]
    assert got == ["Baseline", "Post", None, None, None, "Stimulation"]


def test_stim_word(spark):
    df = spark.createDataFrame([(0b1010000100000011,)], "w int")
    r = df.select(*[c.alias(k) for k, c in decode.stim_parts(F.col("w")).items()]).first()
    assert (r["compliance"], r["charge_recovery"], r["amp_settle"], r["stim"]) == (True, False, True, -3)


def test_tolerant_load_of_encodings_and_marks(spark, tmp_path):
    texts = {"a.csv": ("\ufeffname;x\né;1\n", "utf-8"), "b.csv": ("name,x\nœ,2\n", "cp1252"), "c.csv": ("name\tx\n\x81é\t3\n", "latin1"), "d.csv": ("x,name\n4,ß\n", "utf-8")}
    for name, (text, encoding) in texts.items():
        (tmp_path / name).write_bytes(text.encode(encoding))
    got = tables.read_tolerant(spark, str(tmp_path))
    assert sorted(got.columns) == ["name", "x"]
    assert {r["x"]: r["name"] for r in got.collect()} == {"1": "é", "2": "œ", "3": "\x81é", "4": "ß"}


def test_missing_samples_reach_gap_filling(spark):
    wide = spark.createDataFrame([("r", 0, 1.0, None, None), ("r", 1, float("nan"), None, 5.0), ("r", 2, 3.0, None, None), ("s", 0, None, 7.0, None)], "recording_name string, n long, a double, b double, c double")
    long = tables.to_long(wide, ["recording_name", "n"])
    assert long.count() == 7  # b is absent in r, a and c in s
    filled = samples.fill_gaps(long.withColumnsRenamed({"recording_name": "recording_index"}))
    assert {(r["channel"], r["n"]): r["x_uv"] for r in filled.filter("recording_index = 'r'").collect()} == {("a", 0): 1.0, ("a", 1): 2.0, ("a", 2): 3.0, ("c", 0): 5.0, ("c", 1): 5.0, ("c", 2): 5.0}


def test_time_column_by_values(spark):
    rows = [(float(i), i % 3, i * 0.5, None if i == 4 else float(i)) for i in range(30)]
    df = spark.createDataFrame(rows, "x double, y int, z double, gap double").repartitionByRange(4, "x")
    assert samples.time_column(df.select("y", "gap", "z", "x")) == "z"
    with pytest.raises(ValueError):
        samples.time_column(df.select("y", "gap"))
    assert samples.time_column(df.select("y", F.col("gap").alias("Time"))) == "Time"


def test_exact_medians(spark):
    rng = np.random.default_rng(3)
    rows = [("a", float(v)) for v in rng.normal(size=1001)] + [("b", float(v)) for v in rng.integers(0, 5, 1000)] + [("c", 1.0), ("c", 4.0), ("d", None), ("e", 7.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    for accuracy in (100_000, 200):
        got = {r["k"]: r["median"] for r in samples.medians(df, ["k"], F.col("v"), accuracy).collect()}
        assert got == {k: float(np.median([v for x, v in rows if x == k])) for k in "abce"}
    assert samples.medians(df, [], F.col("v")).first()["median"] == float(np.median([v for _, v in rows if v is not None]))


def test_phases_and_comparisons():
    assert labels.recorded_phases() == ["Baseline", "Stimulation", "Post"] and labels.recorded_phases("After, pre,after") == ["Post", "Baseline"]
    assert labels.comparisons("all", "base,recovery") == ["Baseline", "Post"] and labels.comparisons("Baseline halves") == ["Baseline"]
    for bad in (lambda: labels.recorded_phases("post"), lambda: labels.recorded_phases("base,nothing"), lambda: labels.comparisons("stim", "base,post"), lambda: labels.comparisons("pre")):
        with pytest.raises(ValueError):
            bad()


def test_minutes_and_condition_pivot(spark):
    rows = spark.createDataFrame([("a", i, i * 10) for i in range(5)], "k string, at int, v int")
    assert [r["v"] for r in windows.select_minutes(rows, ["k"], "at", (2, 3)).orderBy("at").collect()] == [10, 20]
    assert [r["v"] for r in windows.select_minutes(rows, ["k"], "at", [5, 1, 9]).orderBy("at").collect()] == [0, 40]
    for bad in ((3, 2), (0, 2), [0]):
        with pytest.raises(ValueError):
            windows.select_minutes(rows, ["k"], "at", bad)
    with pytest.raises(Exception, match="no rows left"):
        windows.select_minutes(rows, ["k"], "at", [7]).collect()
    c = spark.createDataFrame([("d", "A", 1.0, 0), ("d", "A", 9.0, 2), ("d", "A", 50.0, 1), ("d", "B", 3.0, 3), ("e", "A", 1.0, 4)], "day string, condition string, count double, at int")
    assert [tuple(r) for r in statistics.condition_pivot(c, "day", ["A", "B"], "at").collect()] == [("d", 9.0, 3.0)]
    with pytest.raises(Exception, match="missing in session e"):
        statistics.condition_pivot(c, "day", ["A", "B"], "at", strict=True).collect()


def test_sample_rates_must_agree(spark):
    s = spark.createDataFrame([("a", "x", 0, 0.0), ("b", "x", 0, 0.0)], "recording_name string, channel string, n long, t_s double")
    rates = spark.createDataFrame([("a", 100.0), ("b", 100.1)], "recording_name string, fs_hz double")
    for f in (lambda: samples.channel_union(s, rates), lambda: samples.conversion_summary(s, rates)):
        with pytest.raises(Exception, match="sample rate of b differs"):
            f().collect()


def test_pooled_changes_fall_back_on_windows(spark):
    """One unit: the test pairs windows in order, and the error is across its windows."""
    hz = {"Baseline": [1.0, 2.0, 2.0, 4.0], "Stimulation": [4.0, 6.0, 5.0, 9.0], "Post": [1.0, 3.0]}
    rows = [("u", i, float(k), k + 1.0, float(k), p, v) for i, p in enumerate(hz) for k, v in enumerate(hz[p])]
    df = spark.createDataFrame(rows, "channel string, recording_index int, window_start_s double, window_end_s double, window_index double, phase string, firing_rate_hz double")
    df = df.withColumns({"stimulation_label_raw": F.when(F.col("phase") == "Stimulation", "-70 nA"), "post_label_raw": F.when(F.col("phase") == "Post", "Post")})
    df = statistics.experiment_parts(statistics.baseline_halves(df, ["channel"]), ["channel"])
    got = {r["category"]: r for r in statistics.pooled_changes(df, None, ["channel"]).collect()}
    assert [k for k, _ in sorted(got.items(), key=lambda x: x[1]["category_order"])] == ["Baseline", "-70 nA", "Post 1"]
    stim = np.array(hz["Stimulation"])
    assert got["-70 nA"]["mean"] == pytest.approx(100 * (6 - 3) / 3) and got["-70 nA"]["error"] == pytest.approx(np.std(stim, ddof=1) / 2 / 3 * 100)
    d = stim - np.array(hz["Baseline"])
    assert got["-70 nA"]["t"] == pytest.approx(d.mean() / (d.std(ddof=1) / 2)) and got["-70 nA"]["df"] == 3 and got["Post 1"]["df"] == 1
    assert got["Baseline"]["df"] == 1 and got["Baseline"]["t"] == pytest.approx(3.0)
