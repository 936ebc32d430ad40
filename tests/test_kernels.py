"""numpy kernels and island rules against plain loops and known values."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparktrode.functions import filters as C
from sparktrode.operators import filtering, spectral
from sparktrode.operators import samples as P
from sparktrode.operators import spikes as K
from sparktrode.operators import statistics as S


def plain_filter(sections, x, state):
    y, z = [], state.copy()
    for v in x:
        for k, (b0, b1, b2, a1, a2) in enumerate(sections):
            out = b0 * v + z[k, 0]
            z[k, 0], z[k, 1] = b1 * v - a1 * out + z[k, 1], b2 * v - a2 * out
            v = out
        y.append(v)
    return np.array(y), z


def response(sections, f, fs):
    w = np.exp(-2j * np.pi * f / fs)
    return np.prod([(b0 + b1 * w + b2 * w * w) / (1 + a1 * w + a2 * w * w) for b0, b1, b2, a1, a2 in sections])


@pytest.mark.parametrize("order", [1, 2, 3, 4])
@pytest.mark.parametrize("band", [(5.0, 20.0), (None, 10.0), (10.0, None), (0.5, 45.0)])
def test_butterworth_half_power_at_band_ends(order, band):
    s = C.butterworth(order, band, 100.0)
    for f in band:
        if f is not None:
            assert abs(response(s, f, 100.0)) == pytest.approx(np.sqrt(0.5), rel=1e-6)
    middle = {(5.0, 20.0): 10.0, (None, 10.0): 0.001, (10.0, None): 49.9, (0.5, 45.0): 5.0}[band]
    assert abs(response(s, middle, 100.0)) == pytest.approx(1.0, abs=0.02)


def test_scan_equals_plain_loop():
    rng = np.random.default_rng(0)
    s = C.butterworth(3, (5.0, 20.0), 100.0)
    for n in (1, 2, 50, 997):
        x, z = rng.normal(size=n), rng.normal(size=(len(s), 2))
        y, end = C.scan(s, x, z)
        want, state = plain_filter(s, x, z)
        assert np.allclose(y, want) and np.allclose(end, state)


def test_steady_state_keeps_a_constant():
    s = C.butterworth(2, (None, 10.0), 100.0)
    y, _ = plain_filter(s, np.ones(50), C.steady_state(s))
    assert np.allclose(y, 1.0)


def zero_phase(x, s, pad):
    p = min(pad, len(x) - 1)
    e = np.r_[2 * x[0] - x[p:0:-1], x, 2 * x[-1] - x[-2 : -p - 2 : -1]]
    zi = C.steady_state(s)
    y, _ = plain_filter(s, e, zi * e[0])
    y, _ = plain_filter(s, y[::-1], zi * y[-1])
    return y[::-1][p : len(y) - p]


@pytest.mark.parametrize("n", [20, 100, 333])
def test_zero_phase_over_blocks(spark, n):
    rng = np.random.default_rng(n)
    x = rng.normal(size=n)
    df = spark.createDataFrame([(1, "a", i, float(v)) for i, v in enumerate(x)], "recording_index int, channel string, n long, x_uv double")
    got = [r["x_uv"] for r in filtering.zero_phase(df, (5.0, 20.0), 100.0, 4, "A", 64).orderBy("n").collect()]
    s = C.butterworth(4, (5.0, 20.0), 100.0)
    assert np.allclose(got, zero_phase(x, s, 27), atol=1e-8)


def test_notch_over_blocks(spark):
    x = np.random.default_rng(2).normal(size=200)
    df = spark.createDataFrame([(1, "a", i, float(v)) for i, v in enumerate(x)], "recording_index int, channel string, n long, x_uv double")
    meta = spark.createDataFrame([(1, 1000.0, 60, 1)], "recording_index int, fs_hz double, notch_hz int, version_major int")
    got = [r["x_uv"] for r in filtering.notch_filter(df, meta, block=32).orderBy("n").collect()]
    b0, b1, b2, a1, a2 = C.notch(1000.0, 60.0)[0]
    y = list(x[:2])
    for i in range(2, len(x)):
        y.append(b0 * x[i] + b1 * x[i - 1] + b2 * x[i - 2] - a1 * y[i - 1] - a2 * y[i - 2])
    assert np.allclose(got, y)


def highest_first(n, height, distance):
    kept = []
    for i in sorted(range(len(n)), key=lambda i: (height[i], n[i]), reverse=True):
        if all(abs(n[i] - n[j]) >= distance for j in kept):
            kept.append(i)
    return {int(n[i]) for i in kept}


def first_kept(n, distance):
    out = []
    for x in n:
        if not out or x - out[-1] >= distance:
            out.append(int(x))
    return set(out)


@pytest.mark.parametrize("block, halo", [(16, 2), (16, 8), (1 << 18, 32)])
def test_block_rules_equal_sequential_rules(spark, monkeypatch, block, halo):
    """Long rising rows of peaks hang on each other over many blocks."""
    monkeypatch.setattr(K, "HALO", halo)
    rng = np.random.default_rng(5)
    series, rows = {}, []
    for k in range(5):
        n = np.sort(rng.choice(160, size=70, replace=False))
        height = np.arange(70.0) if k == 0 else -np.arange(70.0) if k == 1 else rng.integers(0, 6, 70).astype(float)
        series[k] = (n, height)
        rows += [(k, "a", int(i), float(h)) for i, h in zip(n, height, strict=True)]
    df = spark.createDataFrame(rows, "recording_index int, channel string, n long, height double")
    for distance in (3, 9):
        got, first = ({(r["recording_index"], r["n"]) for r in f(df, distance, block).collect()} for f in (K.suppress, K.refractory))
        assert got == {(k, x) for k, (n, h) in series.items() for x in highest_first(n, h, distance)}
        assert first == {(k, x) for k, (n, _) in series.items() for x in first_kept(n, distance)}


@pytest.mark.parametrize("block", [4, 7, 1 << 18])
def test_peaks_with_plateaus_over_borders(spark, block):
    rng = np.random.default_rng(6)
    x = np.repeat(rng.integers(0, 4, 60), rng.integers(1, 9, 60)).astype(float)
    df = spark.createDataFrame([(1, "a", i, float(v)) for i, v in enumerate(x)], "recording_index int, channel string, n long, z double")
    want, i = {}, 0
    while i < len(x):
        j = i
        while j + 1 < len(x) and x[j + 1] == x[i]:
            j += 1
        if i > 0 and j < len(x) - 1 and x[i - 1] < x[i] > x[j + 1] and x[i] >= 1:
            want[(i + j) // 2] = x[i]
        i = j + 1
    assert {r["n"]: r["height"] for r in K.peaks(df, 1.0, "pos", block=block).collect()} == want


def half_width(x, at):
    left = at
    while left > 0 and x[left - 1] <= x[at]:
        left -= 1
    right = at
    while right < len(x) - 1 and x[right + 1] <= x[at]:
        right += 1
    level = x[at] - (x[at] - max(x[left : at + 1].min(), x[at : right + 1].min())) / 2
    i = j = at
    while i > left and x[i] > level:
        i -= 1
    while j < right and x[j] > level:
        j += 1
    lo = i + (level - x[i]) / (x[i + 1] - x[i]) if x[i] < level else i
    hi = j - (level - x[j]) / (x[j - 1] - x[j]) if x[j] < level else j
    return float(hi - lo)


@pytest.mark.parametrize("block", [8, 50, 1 << 18])
def test_half_prominence_widths_reach_over_blocks(spark, block):
    rng = np.random.default_rng(7)
    slow = np.r_[np.linspace(0, 60, 200), np.linspace(60, 0, 200)]
    rows, want = [], {}
    for k, x in enumerate([np.r_[0, 1, 2, 3, 4, 3, 2, 1, 0].astype(float), slow + rng.normal(size=400), np.abs(rng.normal(size=300)), np.ones(40)]):
        x = np.round(x, 3)
        rows += [(k, "a", i, float(v)) for i, v in enumerate(x)]
        want |= {(k, i): half_width(np.abs(x), i) for i in range(1, len(x) - 1) if abs(x[i]) > abs(x[i - 1]) and abs(x[i]) > abs(x[i + 1])}
    want[3, 20] = 0.0
    df = spark.createDataFrame(rows, "recording_index int, channel string, n long, x_uv double")
    at = spark.createDataFrame([(k, "a", n) for k, n in want], "recording_index int, channel string, n long")
    got = {(r["recording_index"], r["n"]): r["width"] for r in K.half_prominence_width(at, df, block).collect()}
    assert got == pytest.approx(want) and want[0, 4] == 4.0


def test_density_of_a_sine():
    fs, n = 100.0, 200
    x = 3 * np.sin(2 * np.pi * 10 * np.arange(n) / fs)
    p = spectral.density(x, fs)
    assert np.argmax(p) == 20 and p.sum() * fs / n == pytest.approx(4.5, rel=1e-6)


@pytest.mark.parametrize("t, df, p", [(2.228, 10, 0.05), (2.776, 4, 0.05), (12.706, 1, 0.05), (0.0, 5, 1.0), (3.169, 10, 0.01)])
def test_student_p(t, df, p):
    assert S.student_p(np.array([t]), np.array([float(df)]))[0] == pytest.approx(p, abs=2e-4)


def test_windows_meet_two_cells_of_samples(spark):
    rng = np.random.default_rng(5)
    n, pre, post = 1 << 18, 12, 20
    line = spark.range(n).select(F.lit(1).alias("recording_index"), F.lit("a").alias("channel"), F.col("id").alias("n"), F.cos(F.col("id") * 0.37).alias("x_uv"))
    at = sorted(rng.choice(n, 10_000, replace=False).tolist())
    spikes = spark.createDataFrame([(1, "a", int(i)) for i in at], "recording_index int, channel string, n long")
    assert P.in_cells(spikes, line, pre, post).count() <= 2 * (pre + post) * len(at)
    got = {r["n"]: r["wave"] for r in K.waveforms(spikes, line, pre, post).collect()}
    assert sorted(got) == [i for i in at if i >= pre and i + post <= n - 1]
    for i in list(got)[::500]:
        assert got[i] == pytest.approx(np.cos(np.arange(i - pre, i + post) * 0.37))


def test_widths_of_many_spikes_in_one_block(spark):
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=1 << 18), 6)
    a = np.abs(x)
    top = np.flatnonzero((a[1:-1] > a[:-2]) & (a[1:-1] > a[2:])) + 1
    at = np.sort(rng.choice(top, 4000, replace=False))
    rows = pd.DataFrame({"recording_index": np.int32(1), "channel": "a", "n": np.arange(len(x)), "x_uv": x})
    df = spark.createDataFrame(rows, "recording_index int, channel string, n long, x_uv double").cache()
    spikes = spark.createDataFrame([(1, "a", int(i)) for i in at], "recording_index int, channel string, n long")
    df.count()
    began = time.time()
    got = {r["n"]: r["width"] for r in K.half_prominence_width(spikes, df).collect()}
    assert time.time() - began < 60  # the arrays alone took that long when each spike got its block's
    assert len(got) == 4000
    for i in at[::40]:
        assert got[i] == pytest.approx(half_width(a, i))
    df.unpersist()


def test_extremes_find_the_nearest(spark):
    rng = np.random.default_rng(8)
    for n in (1, 2, 7, 64, 100):
        y = rng.integers(0, 6, n).astype(float)
        tree = K.Extremes(y, y)
        at, left, bound = rng.integers(0, n + 1, 200), rng.random(200) < 0.5, rng.integers(-1, 7, 200).astype(float)
        for above in (True, False):
            found, least = tree.nearest(at, left, bound, above)
            for k in range(200):
                way = range(at[k] - 1, -1, -1) if left[k] else range(at[k], n)
                hit = next((i for i in way if (y[i] > bound[k]) == above), -1)
                passed = [y[i] for i in way if hit < 0 or (i > hit if left[k] else i < hit)]
                assert found[k] == hit and least[k] == min(passed, default=np.inf)


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.99, 1.0])
def test_exact_quantiles(spark, q):
    rng = np.random.default_rng(4)
    sets = {"normal": rng.normal(size=501), "ties": rng.integers(-3, 3, 400).astype(float), "wide": rng.normal(size=300) * 10.0 ** rng.integers(-300, 300, 300), "one": np.array([2.5]), "zero": np.zeros(7), "edge": np.array([-np.inf, 0.0, -0.0, 1e-320, np.inf, 3.0])}
    rows = [(k, float(v)) for k, x in sets.items() for v in x] + [("normal", None), ("normal", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    want = {}
    for k, x in sets.items():
        y, place = np.sort(x), q * (len(x) - 1)
        low, high = y[int(np.floor(place))], y[int(np.ceil(place))]
        part = place - np.floor(place)
        want[k] = low if part == 0 else (1 - part) * low + part * high
    for parts in (65_536, 3):
        got = {r["k"]: r["quantile"] for r in P.quantiles(df, ["k"], F.col("v"), q, parts).collect()}
        assert got == pytest.approx(want, nan_ok=True)
    assert P.quantiles(df.limit(0), ["k"], F.col("v"), q).collect() == []


def test_robust_z_reads_its_samples_five_times(spark):
    reads = spark.sparkContext.accumulator(0)

    def counted(frames):
        for pdf in frames:
            reads.add(len(pdf))
            yield pdf

    rows = [(1, c, i, float((i * 37) % 101)) for c in "ab" for i in range(500)]
    df = spark.createDataFrame(rows, "recording_index int, channel string, n long, x_uv double").mapInPandas(counted, "recording_index int, channel string, n long, x_uv double")
    P.robust_z(df).collect()
    assert 0 < reads.value <= 5 * len(rows)


@pytest.mark.parametrize("length", [40, 900])
def test_segments_by_blocks(spark, monkeypatch, length):
    monkeypatch.setattr(spectral, "BLOCK", 64)  # so that a block is as long as its segments allow
    rng = np.random.default_rng(9)
    x, fs = rng.normal(size=length), 100.0
    df = spark.createDataFrame([(1, "a", i, i / fs, float(v)) for i, v in enumerate(x)], "recording_index int, channel string, n long, t_s double, x_uv double").orderBy(F.rand(2))
    n = min(64, length)
    p = np.mean([spectral.density(x[s : s + n], fs) for s in range(0, length - n + 1, 32)], axis=0)
    got = {round(r["f_hz"] * n / fs): r["pxx"] for r in spectral.welch(df, fs, nperseg=64).collect()}
    assert got == pytest.approx(dict(enumerate(p)))
    spec = spectral.spectrogram(df, fs, 50.0, 0.64).groupBy("t_s").count().collect()
    assert len(spec) == (1 if length < 64 else (length - 64) // 16 + 1) and {r["count"] for r in spec} == {n // 2 + 1}
    for step in (0.1, 0.13):  # shared inner segments, and none
        win, hop = 200, round(step * fs)
        bands = spectral.sliding_band_power(df, fs, [("a", 5.0, 20.0), ("none", 60.0, 70.0)], 2.0, step, 0.64)
        got = {round(r["t_s"] * fs): r["power"] for r in bands.filter("band = 'a'").collect()}
        want, f = {}, np.arange(33) * fs / 64
        for s in range(0, length - win + 1, hop):
            q = np.mean([spectral.density(x[s + k : s + k + 64], fs) for k in range(0, win - 63, 32)], axis=0)
            want[s + win // 2] = np.trapezoid(q[(f >= 5) & (f < 20)], f[(f >= 5) & (f < 20)])
        assert got == pytest.approx(want)
        assert bands.filter("band = 'none' and power is not null").isEmpty()


def test_overlay_takes_neighbours(spark):
    rows = [(1, "a", 0.0, 0.0), (1, "a", 2.0, 4.0), (1, "a", 5.0, 1.0), (2, "a", 1.0, 10.0), (2, "a", 4.0, 40.0), (2, "a", 4.5, 0.0), (2, "a", 4.75, 2.0), (3, "b", 1.0, 7.0)]
    psd = spark.createDataFrame(rows, "recording_index int, channel string, f_hz double, pxx_db double")
    got = {(r["recording_index"], r["channel"], r["f_hz"]): r["pxx_db"] for r in spectral.overlay(psd).collect()}
    assert got == {(1, "a", 0.0): 0.0, (1, "a", 2.0): 4.0, (1, "a", 5.0): 1.0, (2, "a", 0.0): 10.0, (2, "a", 2.0): 20.0, (2, "a", 5.0): 2.0, (3, "b", 1.0): 7.0}
