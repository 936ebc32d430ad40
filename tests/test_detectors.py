"""Detectors, sliding spectra and shuffled input against plain numpy on a small recording."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparktrode.functions import filters as C
from sparktrode.operators import samples as P
from sparktrode.operators import spectral
from sparktrode.operators import spikes as K
from sparktrode.operators import windows as O
from test_kernels import half_width, zero_phase

FS = 1000.0
BAND = (40.0, 300.0)


@pytest.fixture(scope="module")
def x():
    rng = np.random.default_rng(11)
    return np.round(rng.normal(size=900) * 30, 3)


@pytest.fixture(scope="module")
def df(spark, x):
    return spark.createDataFrame([(1, "a", i, i / FS, float(v)) for i, v in enumerate(x)], "recording_index int, channel string, n long, t_s double, x_uv double").orderBy(F.rand(3))


def robust(x, variant):
    d = x - np.median(x)
    mad = np.median(np.abs(d))
    return d / (1.4826 * (mad + 1e-12)) if variant == "A" else 0.6745 * d / mad


def maxima(v, thr, distance):
    found = [i for i in range(1, len(v) - 1) if v[i] >= thr and v[i] > v[i - 1] and v[i] > v[i + 1]]
    keep = dict.fromkeys(found, True)
    for i in sorted(found, key=lambda i: (v[i], i), reverse=True):
        if keep[i]:
            for j in found:
                if j != i and abs(j - i) < distance:
                    keep[j] = False
    return [i for i in found if keep[i]]


def first_kept(peaks, distance):
    out = []
    for p in sorted(peaks):
        if not out or p - out[-1] >= distance:
            out.append(p)
    return out


def test_detect_abs(df, x):
    got = sorted(r["n"] for r in K.detect_abs(df, FS, 1.5, 4.0, 6, 10, 40.0, 90.0).collect())
    want = []
    for i in maxima(np.abs(robust(x, "A")), 1.5, 4):
        if i - 6 >= 0 and i + 10 < len(x):
            amp = np.abs(x[i - 6 : i + 10]).max()
            want += [i] if 40 <= amp <= 90 else []
    assert got == want


@pytest.mark.parametrize("polarity", ["pos", "neg", "both"])
def test_detect_polarity(df, x, polarity):
    got = sorted(r["n"] for r in K.detect_polarity(df, FS, 1.0, 5.0, polarity, 20.0, 80.0, (0, 6), BAND, 3, 100).collect())
    x = zero_phase(x, C.butterworth(3, BAND, FS), 21)
    z = robust(x, "B")
    sides = {"pos": [z], "neg": [-z], "both": [z, -z]}[polarity]
    want = []
    for p in first_kept({i for s in sides for i in maxima(s, 1.0, 5)}, 5):
        b = min(p + 6, len(x) - 1)
        if b <= p + 1:
            continue
        seg = x[p:b]
        up = polarity == "neg" or (polarity == "both" and x[p] < 0)
        w = int(np.argmax(seg) if up else np.argmin(seg))
        if 0 < w <= 6 and 20 <= abs(x[p]) <= 80:
            want.append(p)
    assert got == want


def test_detect_neuropil(df, x):
    got = {r["n"]: r["width_ms"] for r in K.detect_neuropil(df, FS, 1.0, 3.0, "both", 20.0, 90.0, (0.5, 3.0), BAND, 4, 100).collect()}
    a = np.abs(zero_phase(x, C.butterworth(4, BAND, FS), 27))
    want = {}
    for i in maxima(robust(a, "A"), 1.0, 3):
        w = half_width(a, i)
        if 20 <= a[i] <= 90 and 0.5 <= w <= 3.0:
            want[i] = w
    assert got == pytest.approx(want)


def test_blocks_do_not_change_results(df):
    for f in (lambda b: P.fill_gaps(df.withColumn("x_uv", F.when(F.col("n") % 7 != 0, F.col("x_uv"))), b), lambda b: P.autocorrelation(df, 12, b), lambda b: P.with_previous(df, "t_s", block=b)):
        rows = [sorted(tuple(v if not isinstance(v, float) else round(v, 9) for v in r) for r in f(b).collect()) for b in (16, 1 << 18)]
        assert rows[0] == rows[1]


def test_sliding_band_power_and_spectrogram(df, x):
    got = {(r["t_s"], r["band"]): r["power"] for r in spectral.sliding_band_power(df, FS, [("a", 20.0, 90.0)], 0.4, 0.1, 0.2).collect()}
    want = {}

    def density(seg):
        """Sums of sines and cosines, one by one."""
        n, k = len(seg), np.arange(len(seg) // 2 + 1)[:, None]
        w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
        y = (seg - seg.mean()) * w
        power = (y * np.cos(2 * np.pi * k * np.arange(n) / n)).sum(1) ** 2 + (y * np.sin(2 * np.pi * k * np.arange(n) / n)).sum(1) ** 2
        return power / (FS * (w**2).sum()) * np.where((k[:, 0] == 0) | (2 * k[:, 0] == n), 1, 2)

    for s in range(0, 900 - 400 + 1, 100):
        seg = x[s : s + 400]
        p = np.mean([density(seg[k : k + 200]) for k in range(0, 201, 100)], axis=0)
        f = np.arange(len(p)) * 5.0
        m = (f >= 20) & (f < 90)
        want[((s + 200) / FS, "a")] = np.trapezoid(p[m], f[m])
    assert got == pytest.approx(want)
    spec = {(r["t_s"], r["f_hz"]): r["db"] for r in spectral.spectrogram(df, FS, 100.0, 0.2).collect()}
    p = density(x[100:300])
    assert spec[(0.2, 50.0)] == pytest.approx(10 * np.log10(p[10]))


def test_folded_windows_of_odd_lengths(spark):
    b = spark.createDataFrame([("a", 0.0, 10.0), ("b", 0.0, 11.0), ("c", 0.0, 3.0), ("d", 1.0, 1.0)], "k string, t0 double, t1 double")
    got = {}
    for r in O.tumbling_folded(b, 5.0).orderBy("k", "window_index").collect():
        got.setdefault(r["k"], []).append((r["window_start_s"], r["window_end_s"]))
    assert got == {"a": [(0.0, 5.0), (5.0, 10.0)], "b": [(0.0, 5.0), (5.0, 11.0)], "c": [(0.0, 3.0)]}
