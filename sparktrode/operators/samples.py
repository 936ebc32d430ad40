"""Operators on long samples: recording_index, channel, n, t_s, x_uv."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sparktrode.functions.labels import is_marker
from sparktrode.sources.tables import written

SERIES = ["recording_index", "channel"]
#: Samples in a block: the unit of parallel work, so a long series is never one task.
BLOCK = 1 << 18
TIME_NAMES = ["time_s", "time", "t", "seconds"]


def blocked(samples: DataFrame, halo: int = 0, block: int = BLOCK) -> DataFrame:
    """Adds block; with a halo, rows near a border are also in the blocks beyond it, with own = false."""
    at = F.floor(F.col("n") / block)
    if not halo:
        return samples.withColumns({"block": at, "own": F.lit(True)})
    near = F.sequence(F.greatest(F.floor((F.col("n") - halo) / block), F.lit(0)), F.floor((F.col("n") + halo) / block))
    return samples.withColumn("block", F.explode(near)).withColumn("own", F.col("block") == at)


def with_previous(samples: DataFrame, column: str, keys: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """Adds `previous`: the value of the sample before, null for the first of a series."""
    line = W.partitionBy(*(keys or SERIES), "block").orderBy("n")
    return blocked(samples, 1, block).withColumn("previous", F.lag(column).over(line)).filter("own").drop("block", "own")


def in_cells(points: DataFrame, samples: DataFrame, before: int, after: int) -> DataFrame:
    """Each point with the samples (m, x_uv) of the one or two cells that its window touches.

    The window is n - before to n + after - 1, and a cell as long as that; points and samples meet
    on equal (series, cell), so a point is compared with two windows' worth of samples at most,
    however long the series.
    """
    size = before + after
    cells = F.sequence(F.floor((F.col("n") - before) / size), F.floor((F.col("n") + (after - 1)) / size))
    line = samples.select(*SERIES, F.col("n").alias("m"), "x_uv", F.floor(F.col("n") / size).alias("cell"))
    return points.withColumn("cell", F.explode(cells)).join(line, [*SERIES, "cell"]).drop("cell")


def time_column(df: DataFrame) -> str:
    """The time column's name: a known name, else the first numeric column that strictly rises.

    A column with a missing or infinite value doesn't count. Rows are in the order in which they
    are read: each partition is checked alone, and a row a partition tells whether they follow on.
    """
    by_name = {c.lower(): c for c in df.columns}
    for name in TIME_NAMES:
        if name in by_name:
            return by_name[name]
    numeric = [c for c, t in df.dtypes if t in ("double", "float", "int", "bigint", "smallint")]
    rows = df.select(F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__n"), *[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(numeric)])
    line = W.partitionBy("__part").orderBy("__n")
    cols = [f"c{i}" for i in range(len(numeric))]
    rows = rows.withColumns({f"s_{c}": F.col(c) - F.lag(c).over(line) for c in cols})
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf")) | (F.col(f"s_{c}") <= 0)
    parts = rows.groupBy("__part").agg(*[x for c in cols for x in (F.count_if(bad(c)).alias(f"b_{c}"), F.min_by(c, "__n").alias(f"f_{c}"), F.max_by(c, "__n").alias(f"l_{c}"))])
    across = W.orderBy("__part")  # a row a partition
    parts = parts.withColumns({f"g_{c}": F.coalesce(F.col(f"f_{c}") <= F.lag(f"l_{c}").over(across), F.lit(False)) for c in cols})
    found = parts.agg(F.count(F.lit(1)).alias("parts"), *[(F.sum(f"b_{c}") + F.count_if(f"g_{c}")).alias(c) for c in cols]).first()
    for c, name in zip(cols, numeric, strict=True):
        if found["parts"] and found[c] == 0:
            return name
    raise ValueError("no time column")


def _steps(v: Column) -> Column:
    """A number of 16 bits that never falls as v rises: its sign, and its logarithm in steps of 1/22."""
    size = F.floor(F.least(F.ln(F.abs(v)), F.lit(1000.0)) * 22) + 16400
    return F.when(v == 0, F.lit(0).cast("long")).when(v > 0, size).otherwise(-size)


def _descend(counts: DataFrame, targets: DataFrame, keys: list[str], by: str) -> DataFrame:
    """targets with `by`, the value of it where the rank lies, and the rank among its rows.

    counts has keys, `by` and c; a group of keys has no more rows than there are values of `by`.
    """
    line = W.partitionBy(*keys).orderBy(by)
    upto = counts.withColumn("upto", F.sum("c").over(line))
    at = targets.join(upto, keys).filter((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("c")))
    return at.withColumn("rank", F.col("rank") - F.col("upto") + F.col("c")).drop("upto", "c")


def quantiles(df: DataFrame, keys: list[str], value: Column, q: float = 0.5, parts: int = 65_536) -> DataFrame:
    """(keys, quantile) of the values that aren't null or NaN, exact, between the two nearest ranks.

    Selection by steps: values are counted by 16 bits of their size, one row for each key and step;
    only those of the steps that hold the two ranks are kept, as a table, and there the same is done
    with `parts` equal parts of what is left, before single values are counted. df is read twice.
    """
    all_keys = keys or ["__all"]
    rows = df.select(*(keys or [F.lit(0).alias("__all")]), value.cast("double").alias("__v")).filter("__v is not null and not isnan(__v)").withColumn("__s", _steps(F.col("__v")))
    counts = written(rows.groupBy(*all_keys, "__s").agg(F.count(F.lit(1)).alias("c")), "steps")
    place = (F.sum("c") - 1) * F.lit(q)
    ranks = counts.groupBy(*all_keys).agg(place.alias("place"))
    ranks = ranks.withColumn("rank", F.explode(F.array_distinct(F.array(F.floor("place"), F.ceil("place")))))
    targets = written(_descend(counts, ranks.withColumn("of", F.col("rank")), all_keys, "__s"), "ranks")
    middle = written(rows.join(targets.select(*all_keys, "__s").distinct(), [*all_keys, "__s"], "left_semi"), "middle")
    ends = middle.groupBy(*all_keys, "__s").agg(F.min("__v").alias("lo"), F.max("__v").alias("hi"))
    part = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("__v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * (parts - 1))).otherwise(F.lit(0).cast("long"))
    dealt = middle.join(ends, [*all_keys, "__s"]).select(*all_keys, "__s", part.alias("__p"), "__v")
    held = [*all_keys, "__s"]
    targets = _descend(dealt.groupBy(*held, "__p").agg(F.count(F.lit(1)).alias("c")), targets, held, "__p")
    held = [*held, "__p"]
    single = dealt.join(targets.select(*held).distinct(), held, "left_semi").groupBy(*held, "__v").agg(F.count(F.lit(1)).alias("c"))
    found = _descend(single, targets, held, "__v")
    low, high = F.min_by("__v", "of"), F.max_by("__v", "of")
    above = F.max("place") - F.min("of")
    out = found.groupBy(*all_keys).agg(F.when(above > 0, (1 - above) * low + above * high).otherwise(low).alias("quantile"))
    return out if keys else out.drop("__all")


def medians(df: DataFrame, keys: list[str], value: Column, parts: int = 65_536) -> DataFrame:
    """(keys, median), exact; see `quantiles`."""
    return quantiles(df, keys, value, 0.5, parts).withColumnRenamed("quantile", "median")


def sampling_rate(samples: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """fs_hz of each series: 1 / median step; an error where the step isn't positive."""
    keys = keys or SERIES
    step = medians(with_previous(samples, "t_s", keys), keys, F.col("t_s") - F.col("previous")).withColumnRenamed("median", "dt")
    return step.select(*keys, F.when(F.col("dt") > 0, 1 / F.col("dt")).otherwise(F.raise_error(F.lit("time does not rise")).cast("double")).alias("fs_hz"))


def drop_markers(rows: DataFrame, channel: str = "channel") -> DataFrame:
    """Rows of channels whose name holds no marker term."""
    return rows.filter(~is_marker(F.col(channel)))


def target_channels(samples: DataFrame, targets: list[str] | None) -> DataFrame:
    """Samples of the requested channels, with `place`, that of the channel in the request.

    Channels that a recording lacks are left out; without a request all stay, in order of names.
    """
    if targets is None:
        names = samples.select("channel").distinct()
        place = names.withColumn("place", F.row_number().over(W.orderBy("channel")) - 1)  # a row a channel
        return samples.join(F.broadcast(place), "channel")
    return samples.filter(F.col("channel").isin(targets)).withColumn("place", (F.array_position(F.lit(targets), F.col("channel")) - 1).cast("int"))


def same_rates(rates: DataFrame) -> DataFrame:
    """rates (recording_name, fs_hz) unchanged, but an error for a rate that isn't the first recording's."""
    first = rates.agg(F.min_by("fs_hz", "recording_name").alias("first_hz"))  # one row
    apart = F.abs(F.col("fs_hz") - F.col("first_hz")) > F.greatest(1e-9 * F.greatest(F.abs("fs_hz"), F.abs("first_hz")), F.lit(1e-9))
    why = F.concat(F.lit("sample rate of "), "recording_name", F.lit(" differs: "), F.col("fs_hz").cast("string"))
    return rates.crossJoin(F.broadcast(first)).withColumn("fs_hz", F.when(apart, F.raise_error(why).cast("double")).otherwise(F.col("fs_hz"))).drop("first_hz")


def channel_union(samples: DataFrame, rates: DataFrame, targets: list[str] | None = None, pairs: list[tuple[str, str]] = ()) -> DataFrame:
    """channel, the number of recordings that have it, and the one sample rate of all recordings.

    Differences A-B are columns too, whether or not a recording has both. rates is checked.
    """
    has = samples.select("recording_name", "channel").distinct()
    has = has.filter(F.col("channel").isin(targets)) if targets is not None else has
    counts = has.groupBy("channel").agg(F.count(F.lit(1)).alias("files"))
    if pairs:
        sides = samples.sparkSession.createDataFrame([(f"{a}-{b}", a, b) for a, b in pairs], "pair string, a string, b string")
        every = samples.select("recording_name", "channel").distinct()
        left = F.broadcast(sides).join(every.withColumnRenamed("channel", "a"), "a", "left").select("pair", "b", "recording_name")
        both = left.join(every.withColumnRenamed("channel", "b").withColumn("there", F.lit(1)), ["recording_name", "b"], "left")
        counts = counts.unionByName(both.groupBy(F.col("pair").alias("channel")).agg(F.count("there").alias("files")))
    rate = same_rates(rates).agg(F.min("fs_hz").alias("fs_hz"))  # one row
    return counts.crossJoin(F.broadcast(rate))


def conversion_summary(samples: DataFrame, rates: DataFrame, targets: list[str] | None = None, pairs: list[tuple[str, str]] = ()) -> DataFrame:
    """A row for each recording, and one named 'all': samples, rate, duration, start and end,
    channels in the file and exported, their names, and difference columns."""
    ends = samples.groupBy("recording_name", "channel").agg((F.max("n") + 1).alias("samples"), F.min("t_s").alias("start_s"), F.max("t_s").alias("end_s"))
    chosen = F.col("channel").isin(targets) if targets is not None else F.lit(True)
    names = F.collect_set("channel")
    files = ends.groupBy("recording_name").agg(
        F.max("samples").alias("samples"), F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.count(F.lit(1)).alias("channels"), F.count_if(chosen).alias("exported"),
        F.array_join(F.array_sort(F.collect_set(F.when(chosen, F.col("channel")))), ", ").alias("exported_names"), names.alias("__names"),
    )
    added = [F.array_contains("__names", a) & F.array_contains("__names", b) for a, b in pairs]
    files = files.withColumn("differences", reduce(Column.__add__, [x.cast("long") for x in added], F.lit(0).cast("long"))).drop("__names")
    files = files.join(same_rates(rates).select("recording_name", "fs_hz"), "recording_name").withColumn("duration_s", F.col("samples") / F.col("fs_hz"))
    total = files.agg(
        F.sum("samples").alias("samples"), F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.sum("duration_s").alias("duration_s"), F.min("fs_hz").alias("fs_hz"),
        *[F.lit(None).cast(t).alias(c) for c, t in (("channels", "long"), ("exported", "long"), ("exported_names", "string"), ("differences", "long"))],
    ).withColumn("recording_name", F.lit("all"))
    return files.unionByName(total)


def continuous_time(samples: DataFrame, fs_hz: float) -> DataFrame:
    """Adds t_all_s: recordings follow on one another, each a sample after the end of the last."""
    counts = samples.groupBy("recording_index").agg((F.max("n") + 1).alias("c"))
    before = counts.select("recording_index", (F.sum("c").over(W.orderBy("recording_index")) - F.col("c")).alias("before"))  # a row a file
    return samples.join(before, "recording_index").withColumn("t_all_s", (F.col("before") + F.col("n")) / fs_hz).drop("before")


def pick_channels(samples: DataFrame, include: str = "", exclude: str = "") -> DataFrame:
    """Channels of comma-separated lists; an empty include list takes all."""
    split = lambda x: [c.strip() for c in x.split(",") if c.strip()]
    out = samples.filter(F.col("channel").isin(split(include))) if split(include) else samples
    return out.filter(~F.col("channel").isin(split(exclude))) if split(exclude) else out


def differences(samples: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Channels named A-B with A's value less B's where both exist; two equal joins."""
    names = [c for p in pairs for c in p]
    part = samples.filter(F.col("channel").isin(names))
    want = F.broadcast(samples.sparkSession.createDataFrame(pairs, "a string, b string"))
    a = part.join(want, part["channel"] == want["a"]).select("recording_index", "n", "t_s", "a", "b", F.col("x_uv").alias("xa"))
    b = part.select("recording_index", "n", F.col("channel").alias("b"), F.col("x_uv").alias("xb"))
    return a.join(b, ["recording_index", "n", "b"]).select("recording_index", F.concat("a", F.lit("-"), "b").alias("channel"), "n", "t_s", (F.col("xa") - F.col("xb")).alias("x_uv"))


def crop(samples: DataFrame, start: float | None, end: float | None, fs_hz: float) -> DataFrame:
    """Samples from start to end, both included; series of fewer than max(10, fs) samples go."""
    lo = F.col("t_s") >= start if start is not None else F.lit(True)
    hi = F.col("t_s") <= end if end is not None else F.lit(True)
    kept = samples.filter(lo & hi)
    enough = kept.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") >= max(10.0, fs_hz)).drop("k")
    return kept.join(enough, SERIES, "left_semi")


def crop_minutes(samples: DataFrame, start_min: float, end_min: float) -> DataFrame:
    """As crop, relative to each recording's first sample, in minutes."""
    first = samples.groupBy("recording_index").agg(F.min("t_s").alias("t0"))
    rel = F.col("t_s") - F.col("t0")
    return samples.join(first, "recording_index").filter((rel >= start_min * 60) & (rel <= end_min * 60)).drop("t0")


def middle_window(samples: DataFrame, window_s: float) -> DataFrame:
    """The middle window of each series; dropped if it spans less than 0.9 of the window."""
    ends = samples.groupBy(*SERIES).agg(((F.min("t_s") + F.max("t_s")) / 2).alias("mid"))
    kept = samples.join(ends, SERIES).filter(F.abs(F.col("t_s") - F.col("mid")) <= window_s / 2).drop("mid")
    wide = kept.groupBy(*SERIES).agg((F.max("t_s") - F.min("t_s")).alias("span")).filter(F.col("span") >= 0.9 * window_s).drop("span")
    return kept.join(wide, SERIES, "left_semi")


def ranges_of(text: str) -> list[tuple[float, float]]:
    """'s-e' pieces; reversed ones are swapped and bad ones left out."""
    out = []
    for piece in text.split(","):
        try:
            a, b = (float(x) for x in piece.strip().split("-"))
        except ValueError:
            continue
        out.append((min(a, b), max(a, b)))
    return out


def exclude_ranges(samples: DataFrame, ranges: list[tuple[float, float]]) -> DataFrame:
    """Samples outside all ranges (ends included in a range), joined without a gap: n is dealt anew."""
    out = [(F.col("t_s") >= a) & (F.col("t_s") <= b) for a, b in ranges]
    kept = samples.filter(~reduce(Column.__or__, out)) if out else samples
    line = W.partitionBy(*SERIES, "block").orderBy("n")
    inside = blocked(kept).withColumn("k", F.row_number().over(line) - 1)
    before = inside.groupBy(*SERIES, "block").agg(F.count(F.lit(1)).alias("c"))
    before = before.select(*SERIES, "block", (F.sum("c").over(W.partitionBy(*SERIES).orderBy("block")) - F.col("c")).alias("base"))
    return inside.join(before, [*SERIES, "block"]).withColumn("n", F.col("base") + F.col("k")).drop("base", "k", "block", "own")


def fill_gaps(samples: DataFrame, block: int = BLOCK) -> DataFrame:
    """Missing x_uv by straight lines over n; edges hold the nearest value.

    Inside a block by windows; across blocks by a table of each block's first and last values.
    """
    x = F.when(F.col("x_uv").isNotNull() & ~F.isnan("x_uv"), F.struct("n", F.col("x_uv").alias("x")))
    b = blocked(samples, 0, block).withColumn("p", x).drop("own")
    there = F.when(F.col("p").isNotNull(), F.col("n"))
    edges = b.groupBy(*SERIES, "block").agg(F.max_by("p", there).alias("last_p"), F.min_by("p", there).alias("first_p"))
    line = W.partitionBy(*SERIES).orderBy("block")
    before = F.last("last_p", ignorenulls=True).over(line.rowsBetween(W.unboundedPreceding, -1))
    after = F.first("first_p", ignorenulls=True).over(line.rowsBetween(1, W.unboundedFollowing))
    carry = edges.select(*SERIES, "block", before.alias("before"), after.alias("after"))
    inner = W.partitionBy(*SERIES, "block").orderBy("n")
    b = b.join(carry, [*SERIES, "block"]).withColumns({
        "lo": F.coalesce(F.last("p", ignorenulls=True).over(inner.rowsBetween(W.unboundedPreceding, 0)), F.col("before")),
        "hi": F.coalesce(F.first("p", ignorenulls=True).over(inner.rowsBetween(0, W.unboundedFollowing)), F.col("after")),
    })
    slope = (F.col("hi.x") - F.col("lo.x")) / (F.col("hi.n") - F.col("lo.n"))
    line_x = F.col("lo.x") + slope * (F.col("n") - F.col("lo.n"))
    filled = F.when(F.col("lo").isNull(), F.col("hi.x")).when(F.col("hi").isNull() | (F.col("hi.n") == F.col("lo.n")), F.col("lo.x")).otherwise(line_x)
    return b.withColumn("x_uv", filled).select(*samples.columns)


def sparse_policy(samples: DataFrame, policy: str, least: int = 2) -> DataFrame:
    """What becomes of series of fewer than `least` finite samples: zeros, skip or error."""
    finite = F.col("x_uv").isNotNull() & ~F.isnan("x_uv")
    few = samples.groupBy(*SERIES).agg(F.count_if(finite).alias("finite"))
    out, bad = samples.join(few, SERIES), F.col("finite") < least
    if policy == "skip":
        return out.filter(~bad).drop("finite")
    other = F.lit(0.0) if policy == "zeros" else F.raise_error(F.lit("too few finite samples")).cast("double")
    return out.withColumn("x_uv", F.when(bad, other).otherwise(F.col("x_uv"))).drop("finite")


def robust_z(samples: DataFrame, variant: str = "A", column: str = "x_uv") -> DataFrame:
    """z by median and median deviation; A: / 1.4826 (MAD + 1e-12), B: 0.6745 / MAD, 0 if MAD is."""
    med = written(medians(samples, SERIES, F.col(column)).withColumnRenamed("median", "med"), "medians")
    dev = samples.join(med, SERIES).withColumn("dev", F.col(column) - F.col("med"))
    mad = written(medians(dev, SERIES, F.abs("dev")).withColumnRenamed("median", "mad"), "medians")
    out = dev.join(mad, SERIES)
    z = F.col("dev") / (1.4826 * (F.col("mad") + 1e-12)) if variant == "A" else F.when(F.col("mad") == 0, 0.0).otherwise(0.6745 * F.col("dev") / F.col("mad"))
    return out.withColumn("z", z).drop("dev", "mad", "med")


def histogram(samples: DataFrame, bins: int = 300) -> DataFrame:
    """Density in equal bins from min to max, the last one closed, empty ones included."""
    ends = samples.groupBy(*SERIES).agg(F.min("x_uv").alias("lo"), F.max("x_uv").alias("hi"), F.count("x_uv").alias("total"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.least(F.floor((F.col("x_uv") - F.col("lo")) / width), F.lit(bins - 1)).cast("int")
    counts = samples.join(ends, SERIES).groupBy(*SERIES, at.alias("bin")).agg(F.count("x_uv").alias("c"))
    grid = ends.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    out = grid.join(counts, [*SERIES, "bin"], "left")
    return out.select(*SERIES, "bin", (F.col("lo") + (F.col("bin") + 0.5) * width).alias("centre"), (F.coalesce("c", F.lit(0)) / (F.col("total") * width)).alias("density"))


def autocorrelation(samples: DataFrame, max_lag: int, block: int = BLOCK) -> DataFrame:
    """Sum of products at each lag, mean removed, over that at lag 0; block by block with a halo.

    Missing samples have no products.
    """
    mean = samples.groupBy(*SERIES).agg(F.avg("x_uv").alias("m"))
    c = blocked(samples.join(mean, SERIES).select(*SERIES, "n", (F.col("x_uv") - F.col("m")).alias("c")), max_lag, block)

    def products(pdf: pd.DataFrame) -> pd.DataFrame:
        first = int(pdf["block"].iloc[0]) * block
        line = np.zeros(block + max_lag)
        at = pdf["n"].to_numpy() - first
        inside = (at >= 0) & (at < len(line))
        line[at[inside]] = np.nan_to_num(pdf["c"].to_numpy(float)[inside])
        lags = np.arange(max_lag + 1)
        return pd.DataFrame({k: [pdf[k].iloc[0]] * len(lags) for k in SERIES} | {"lag": lags, "p": [float(line[:block] @ line[k : block + k]) for k in lags]})

    parts = c.filter(F.col("own") | (F.col("n") >= F.col("block") * block)).groupBy(*SERIES, "block").applyInPandas(products, "recording_index int, channel string, lag int, p double")
    sums = parts.groupBy(*SERIES, "lag").agg(F.sum("p").alias("s"))
    zero = sums.filter("lag = 0").select(*SERIES, F.col("s").alias("s0"))
    return sums.join(zero, SERIES).select(*SERIES, "lag", F.when(F.col("s0") != 0, F.col("s") / F.col("s0")).otherwise(F.col("s")).alias("acg"))
