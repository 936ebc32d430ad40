"""Spectra: Welch, band power, sliding bands, spectrograms and overlays."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .samples import BLOCK, SERIES

EPS = 1e-20
Work = Callable[[np.ndarray, np.ndarray, int, int], pd.DataFrame]


def _by_blocks(samples: DataFrame, length: int, step: int, work: Work, schema: str) -> DataFrame:
    """What `work` makes of the segments that start in a block, for each series and block.

    A segment starts at a multiple of `step` and holds `length` samples; a series shorter than that
    is one segment. work takes a block's samples, the starts among them, the segments' length and
    the n of the block's first sample. Only the samples ahead of a block that its last segments reach
    are sent twice, and a block is so long that they are few. Samples are complete.
    """
    block = max(BLOCK, 12 * length)
    size = samples.groupBy(*SERIES).agg((F.max("n") + 1).alias("size"))
    at = F.floor(F.col("n") / block)
    ahead = F.greatest(F.floor((F.col("n") - (length - 1)) / block), F.lit(0))
    rows = samples.select(*SERIES, "n", "x_uv").withColumn("block", F.explode(F.sequence(ahead, at))).join(size, SERIES)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first, whole = int(pdf["block"].iloc[0]) * block, int(pdf["size"].iloc[0])
        n = pdf["n"].to_numpy() - first
        x = np.full(int(n.max()) + 1, np.nan)
        x[n] = pdf["x_uv"].to_numpy(float)
        used, hop = min(length, whole), step if whole >= length else whole
        starts = np.arange(-(-first // hop) * hop, min(first + block, whole - used + 1), hop) - first
        out = work(x, starts, used, first)
        if not len(out):
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in [*SERIES, *out.columns]})
        return pd.DataFrame({c: [pdf[c].iloc[0]] * len(out) for c in SERIES} | {c: out[c].to_numpy() for c in out})

    return rows.groupBy(*SERIES, "block").applyInPandas(run, f"recording_index int, channel string, {schema}")


def _window(n: int, kind: str) -> np.ndarray:
    if kind == "hann":
        return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    edge = np.arange(n + 1) / (0.25 * n)  # periodic Tukey of a quarter
    side = 0.5 * (1 + np.cos(np.pi * (edge - 1)))
    w = np.ones(n + 1)
    k = edge <= 1
    w[k] = side[k]
    w[::-1][k] = side[k]
    return w[:n]


def density(x: np.ndarray, fs_hz: float, kind: str = "hann") -> np.ndarray:
    """One-sided power density of rows, mean removed."""
    n = x.shape[-1]
    w = _window(n, kind)
    p = np.abs(np.fft.rfft((x - x.mean(-1, keepdims=True)) * w, axis=-1)) ** 2 / (fs_hz * (w**2).sum())
    p[..., 1 : (-1 if n % 2 == 0 else None)] *= 2
    return p


def _densities(x: np.ndarray, starts: np.ndarray, length: int, fs_hz: float) -> Iterator[np.ndarray]:
    """Densities of the segments at `starts`, some at a time, so that copies stay small."""
    view = np.lib.stride_tricks.sliding_window_view(x, length)
    some = max(1, (1 << 20) // length)
    for i in range(0, len(starts), some):
        yield density(view[starts[i : i + some]], fs_hz)


def length_of(fs_hz: float, seconds: float = 2.0) -> int:
    return max(64, round(seconds * fs_hz))


def welch(samples: DataFrame, fs_hz: float, f_max: float | None = None, seconds: float = 2.0, nperseg: int | None = None) -> DataFrame:
    """f_hz, pxx and pxx_db of each series: Hann, half overlap, mean over segments."""
    n = nperseg or length_of(fs_hz, seconds)

    def sums(x: np.ndarray, starts: np.ndarray, length: int, first: int) -> pd.DataFrame:
        total = sum(p.sum(0) for p in _densities(x, starts, length, fs_hz)) if len(starts) else None
        return pd.DataFrame({"len": [length], "segments": [len(starts)], "p": [total]}).iloc[: len(starts)]

    parts = _by_blocks(samples, n, n - n // 2, sums, "len int, segments long, p array<double>")
    out = parts.select(*SERIES, "len", "segments", F.posexplode("p").alias("k", "p")).groupBy(*SERIES, "len", "k").agg((F.sum("p") / F.sum("segments")).alias("pxx"))
    out = out.withColumn("f_hz", F.col("k") * fs_hz / F.col("len"))
    out = out.filter(F.col("f_hz") <= f_max) if f_max is not None else out
    return out.select(*SERIES, "f_hz", "pxx", (10 * F.log10(F.col("pxx") + EPS)).alias("pxx_db"))


def band_power(psd: DataFrame, bands: list[tuple[str, float, float]], keys: list[str] | None = None) -> DataFrame:
    """Trapezoids of the power over lo <= f < hi; null where a band holds no frequency."""
    keys = keys or SERIES
    b = F.broadcast(psd.sparkSession.createDataFrame(bands, "band string, lo double, hi double"))
    inside = psd.join(b, (F.col("f_hz") >= F.col("lo")) & (F.col("f_hz") < F.col("hi")))
    line = W.partitionBy(*keys, "band").orderBy("f_hz")
    area = (F.col("f_hz") - F.lag("f_hz").over(line)) * (F.col("pxx") + F.lag("pxx").over(line)) / 2
    sums = inside.withColumn("area", F.coalesce(area, F.lit(0.0))).groupBy(*keys, "band").agg(F.sum("area").alias("power"))
    return psd.select(*keys).distinct().crossJoin(b).join(sums, [*keys, "band"], "left").select(*keys, "band", "power")


def sliding_band_power(samples: DataFrame, fs_hz: float, bands: list[tuple[str, float, float]], window_s: float = 10.0, step_s: float = 1.0, inner_s: float = 2.0, relative: bool = False) -> DataFrame:
    """Band powers of hopping windows, at each window's middle sample; short series give none.

    Power adds up over segments, so each inner segment is transformed once, and windows that share
    it share its band powers. They share where the step is a multiple of the inner hop.
    """
    win, step = int(round(window_s * fs_hz)), max(1, int(round(step_s * fs_hz)))
    inner = min(win, length_of(fs_hz, inner_s))
    hop = inner - inner // 2
    f = np.arange(inner // 2 + 1) * fs_hz / inner
    inside = [(f >= lo) & (f < hi) for _, lo, hi in bands]

    def powers(x: np.ndarray, starts: np.ndarray, length: int, first: int) -> pd.DataFrame:
        if length < win or not len(starts):
            return pd.DataFrame({"n0": [], "p": []})
        own, where = np.unique(starts[:, None] + np.arange(0, win - inner + 1, hop), return_inverse=True)
        sums = []
        for p in _densities(x, own, inner, fs_hz):
            sums.append(np.column_stack([*[np.trapezoid(p[:, m], f[m], axis=1) for m in inside], np.trapezoid(p, f, axis=1)]))
        mean = np.concatenate(sums)[where.reshape(len(starts), -1)].mean(1)
        values = mean[:, :-1] / mean[:, -1:] if relative else mean[:, :-1]
        return pd.DataFrame({"n0": starts + first, "p": [[float(v) if m.any() else None for v, m in zip(row, inside, strict=True)] for row in values]})

    p = _by_blocks(samples, win, step, powers, "n0 long, p array<double>")
    names = F.array(*[F.lit(b[0]) for b in bands])
    return p.select(*SERIES, ((F.col("n0") + win // 2) / fs_hz).alias("t_s"), F.posexplode("p").alias("k", "power")).select(*SERIES, "t_s", F.get(names, F.col("k")).alias("band"), "power")


def spectrogram(samples: DataFrame, fs_hz: float, f_max: float, seconds: float = 2.0) -> DataFrame:
    """t_s, f_hz and dB of segments that overlap by three quarters."""
    n = length_of(fs_hz, seconds)

    def spectra(x: np.ndarray, starts: np.ndarray, length: int, first: int) -> pd.DataFrame:
        kept = int(f_max * length / fs_hz) + 2  # the filter below is exact
        p = [row[:kept] for part in _densities(x, starts, length, fs_hz) for row in part] if len(starts) else []
        return pd.DataFrame({"n0": starts + first, "len": [length] * len(p), "p": p})

    p = _by_blocks(samples, n, max(1, n - int(n * 0.75)), spectra, "n0 long, len int, p array<double>")
    p = p.select(*SERIES, "n0", "len", F.posexplode("p").alias("k", "pxx"))
    out = p.select(*SERIES, ((F.col("n0") + F.col("len") / 2) / fs_hz).alias("t_s"), (F.col("k") * fs_hz / F.col("len")).alias("f_hz"), (10 * F.log10(F.col("pxx") + EPS)).alias("db"))
    return out.filter(F.col("f_hz") <= f_max)


def overlay(psd: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """All spectra of a channel on the frequencies of the shortest one, by straight lines.

    Beyond a spectrum's ends its end value holds. An as-of join: grid and spectrum are sorted as one,
    and a frequency of the grid takes the values before and after it, so the rows are those of the
    spectra and of the result.
    """
    keys = keys or ["channel"]
    counts = psd.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("k"))
    best = counts.groupBy(*keys).agg(F.min_by("recording_index", F.struct("k", "recording_index")).alias("grid_of"))
    grid = psd.join(best, keys).filter(F.col("recording_index") == F.col("grid_of")).select(*keys, "f_hz")
    wanted = counts.drop("k").join(grid, keys).select(*SERIES, "f_hz", F.lit(None).cast("double").alias("p"), F.lit(1).alias("wanted"))
    both = psd.select(*SERIES, "f_hz", F.col("pxx_db").alias("p"), F.lit(0).alias("wanted")).unionByName(wanted)
    line = W.partitionBy(*SERIES).orderBy("f_hz", "wanted")  # one spectrum and the grid
    point = F.when(F.col("wanted") == 0, F.struct("f_hz", "p"))
    rows = both.withColumn("before", F.last(point, ignorenulls=True).over(line.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumn("after", F.first(point, ignorenulls=True).over(line.rowsBetween(1, W.unboundedFollowing))).filter("wanted = 1")
    low, high = F.col("before"), F.col("after")
    between = low["p"] + (high["p"] - low["p"]) * (F.col("f_hz") - low["f_hz"]) / (high["f_hz"] - low["f_hz"])
    value = F.when(low.isNull(), high["p"]).when(high.isNull(), low["p"]).otherwise(between)
    return rows.select(*SERIES, "f_hz", value.alias("pxx_db"))


def db_range(psd: DataFrame) -> DataFrame:
    """Finite dB range of each channel, and of all: a row that is there without any channel too."""
    finite = psd.filter(F.col("pxx_db").isNotNull() & ~F.isnan("pxx_db") & (F.abs("pxx_db") < float("inf")))
    ends = F.min("pxx_db").alias("lo_db"), F.max("pxx_db").alias("hi_db")
    return finite.groupBy("channel").agg(*ends).unionByName(finite.agg(*ends).withColumn("channel", F.lit("all")))


def triggered_spectrogram(windows: DataFrame, fs_hz: float, f_max: float = 200.0) -> DataFrame:
    """Mean dB spectrogram of arrays around spikes (column wave), time from the middle.

    A row for each series, time and frequency leaves a batch of windows: the sum of its dB and their
    number. Cells that are missing, as a sample is, don't count.
    """
    spec = windows.filter(F.size("wave") > 1).select(*SERIES, "wave", F.size("wave").alias("size"))

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for (recording, channel, n), waves in pdf.groupby([*SERIES, "size"], sort=False, dropna=False)["wave"]:
                m = min(n, max(64, int(0.25 * fs_hz)))
                starts = np.arange(0, n - m + 1, m - m // 2)
                f = np.arange(m // 2 + 1) * fs_hz / m
                f = f[f <= f_max]
                total, count = np.zeros((2, len(starts), len(f)))
                for i in range(0, len(waves), some := max(1, (1 << 20) // n)):
                    x = np.stack(waves.iloc[i : i + some].to_list()).astype(float)
                    for k, s in enumerate(starts):
                        d = 10 * np.log10(density(x[:, s : s + m], fs_hz, "tukey")[:, : len(f)] + EPS)
                        total[k] += np.nansum(d, axis=0)
                        count[k] += (~np.isnan(d)).sum(axis=0)
                t = np.repeat((starts + m / 2 - n / 2) / fs_hz, len(f))
                yield pd.DataFrame({SERIES[0]: recording, SERIES[1]: channel, "t_s": t, "f_hz": np.tile(f, len(starts)), "total": total.ravel(), "c": count.ravel()})

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in windows.select(*SERIES).schema)
    cells = spec.mapInPandas(sums, f"{kinds}, t_s double, f_hz double, total double, c double")
    return cells.groupBy(*SERIES, "t_s", "f_hz").agg((F.sum("total") / F.nullif(F.sum("c"), F.lit(0.0))).alias("db"))
