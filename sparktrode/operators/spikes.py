"""Spike detection on filtered samples, and the statistics of spike trains.

All steps work by blocks of samples. What must cross a border travels as a row a block: the runs
that touch it, the spike kept last, or a block's largest and smallest value.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sparktrode.sources.tables import written

from .filtering import zero_phase
from .samples import BLOCK, SERIES, blocked, in_cells, quantiles, robust_z

#: Suppression looks so many distances beyond a block's borders; what that leaves open is settled
#: in further rounds.
HALO = 32
#: Samples in a block from which waveforms are cut, so few that all its waveforms fit a task.
WAVE_BLOCK = 1 << 14
#: Bins of a spike train that are worked on as one array.
BINS = 1 << 16


def series_ends(samples: DataFrame) -> DataFrame:
    return samples.groupBy(*SERIES).agg(F.min("n").alias("n0"), F.max("n").alias("n1"))


def peaks(z: DataFrame, threshold: float, polarity: str = "abs", ends: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """Local maxima of at least the threshold: (series, n, height); a plateau counts at its middle.

    z has n and z; samples below the threshold may be absent if `ends` has the series' first and
    last n. polarity takes |z|, z ('pos'), -z ('neg'), or both of the latter, each sample once with
    the larger height. The first and last sample of a series are no peaks.
    """
    ends = series_ends(z) if ends is None else ends
    if polarity == "both":
        both = peaks(z, threshold, "pos", ends, block).unionByName(peaks(z, threshold, "neg", ends, block))
        return both.groupBy(*SERIES, "n").agg(F.max("height").alias("height"))
    v = {"abs": F.abs("z"), "pos": F.col("z"), "neg": -F.col("z")}[polarity]
    line = W.partitionBy(*SERIES, "block").orderBy("n")
    over = z.select(*SERIES, "n", v.alias("v"), F.floor(F.col("n") / block).alias("block")).filter(F.col("v") >= threshold)
    near = lambda f, k: F.when(f("n").over(line) == F.col("n") + k, f("v").over(line))
    steps = over.withColumns({"before": near(F.lag, -1), "after": near(F.lead, 1)}).withColumn("fresh", ~F.coalesce(F.col("before") == F.col("v"), F.lit(False)))
    runs = steps.withColumn("run", F.sum(F.col("fresh").cast("int")).over(line)).groupBy(*SERIES, "block", "run").agg(
        F.min("n").alias("a"), F.max("n").alias("b"), F.first("v").alias("height"), F.min_by(F.struct("before"), "n")["before"].alias("before"), F.max_by(F.struct("after"), "n")["after"].alias("after")
    )
    # at most two runs of a block touch its borders; equal ones on both sides of a border are one
    at_border = (F.col("a") % block == 0) | (F.col("b") % block == block - 1)
    across = W.partitionBy(*SERIES).orderBy("a")
    prior = F.when(F.lag("b").over(across) == F.col("a") - 1, F.lag("height").over(across))
    later = F.when(F.lead("a").over(across) == F.col("b") + 1, F.lead("height").over(across))
    border = runs.filter(at_border).withColumns({"before": F.coalesce("before", prior), "after": F.coalesce("after", later)})
    border = border.withColumn("run", F.sum((~F.coalesce(F.col("before") == F.col("height"), F.lit(False))).cast("int")).over(across))
    border = border.groupBy(*SERIES, "run").agg(
        F.min("a").alias("a"), F.max("b").alias("b"), F.first("height").alias("height"), F.min_by(F.struct("before"), "a")["before"].alias("before"), F.max_by(F.struct("after"), "a")["after"].alias("after")
    )
    whole = runs.filter(~at_border).drop("block").unionByName(border)
    lower = lambda c: F.coalesce(F.col(c) < F.col("height"), F.lit(True))
    out = whole.filter(lower("before") & lower("after")).join(ends, SERIES).filter((F.col("a") > F.col("n0")) & (F.col("b") < F.col("n1")))
    return out.select(*SERIES, F.floor((F.col("a") + F.col("b")) / 2).alias("n"), "height")


def _settle(n: np.ndarray, height: np.ndarray, kept: np.ndarray, low: int, high: int, distance: int) -> np.ndarray:
    """Highest first, the later of equal ones first: 1 stays, 0 goes, -1 if rows outside [low, high) decide."""
    kept = kept.copy()
    rank = np.empty(len(n), dtype=int)
    rank[np.lexsort((n, height))[::-1]] = np.arange(len(n))
    first, end = np.searchsorted(n, n - distance, side="right"), np.searchsorted(n, n + distance)
    for i in np.argsort(rank):
        if kept[i] >= 0:
            continue
        near = slice(first[i], end[i])
        if (kept[near] == 1).any():
            kept[i] = 0
        elif n[i] - distance >= low and n[i] + distance < high and not ((kept[near] == -1) & (rank[near] < rank[i])).any():
            kept[i] = 1
    return kept


def _islands(rows: DataFrame, distance: int, block: int) -> DataFrame:
    """Adds island, the n of its first row: rows nearer than `distance` to the one before share one.

    Within a block by windows; a row a block carries the last start along a series.
    """
    line = W.partitionBy(*SERIES, "block").orderBy("n")
    b = rows.withColumn("block", F.floor(F.col("n") / block))
    b = b.withColumn("before", F.lag("n").over(line))
    ends = b.groupBy(*SERIES, "block").agg(F.min("n").alias("a"), F.max("n").alias("z"), F.max(F.when(F.col("n") - F.col("before") >= distance, F.col("n"))).alias("inner"))
    series = W.partitionBy(*SERIES).orderBy("block")
    fresh = F.coalesce(F.col("a") - F.lag("z").over(series) >= distance, F.lit(True))
    ends = ends.withColumn("opens", F.when(fresh, F.col("a"))).withColumn("start", F.coalesce("inner", "opens"))
    carried = F.last("start", ignorenulls=True).over(series.rowsBetween(W.unboundedPreceding, -1))
    ends = ends.select(*SERIES, "block", "a", F.coalesce("opens", carried).alias("of_first"))
    starts = F.when(F.col("n") == F.col("a"), F.col("of_first")).when(F.col("n") - F.col("before") >= distance, F.col("n"))
    return b.join(ends, [*SERIES, "block"]).withColumn("island", F.last(starts, ignorenulls=True).over(line)).drop("block", "before", "a", "of_first")


def suppress(rows: DataFrame, distance: int, block: int = BLOCK) -> DataFrame:
    """Highest first, the later of equal ones first; peaks nearer than `distance` samples to a kept one go.

    Each block is settled with HALO distances around it. Peaks that hang on more than that are in
    islands: runs of peaks, those gone left out, that are nearer than `distance` to the next. Islands
    don't influence each other, so each that is still open is settled as a whole, whatever blocks it
    reaches over. The number of jobs is the same for any chain.
    """
    halo, columns = HALO * distance, rows.columns

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n", kind="stable")
        at = int(pdf["block"].iloc[0]) * block
        pdf["kept"] = _settle(pdf["n"].to_numpy(), pdf["height"].to_numpy(), pdf["kept"].to_numpy(), at - halo, at + block + halo, distance).astype(np.int32)
        return pdf.loc[pdf["own"], [*columns, "kept"]]

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n", kind="stable")
        n = pdf["n"].to_numpy()
        kept = _settle(n, pdf["height"].to_numpy(), pdf["kept"].to_numpy(), n[0] - distance, n[-1] + distance + 1, distance)
        return pdf.loc[kept == 1, columns]

    rows = rows.withColumn("kept", F.lit(-1))
    done = written(blocked(rows, halo, block).groupBy(*SERIES, "block").applyInPandas(settle, rows.schema), "suppressed")
    if done.filter("kept = -1").isEmpty():
        return done.filter("kept = 1").drop("kept")
    left = _islands(done.filter("kept <> 0"), distance, block)
    open_ = left.groupBy(*SERIES, "island").agg(F.min("kept").alias("least"))
    both = written(left.join(open_, [*SERIES, "island"]), "islands")
    settled = both.filter("least = -1").drop("least").groupBy(*SERIES, "island").applyInPandas(finish, rows.drop("kept").schema)
    return both.filter("least = 1").select(*columns).unionByName(settled)


def refractory(rows: DataFrame, distance: int, block: int = BLOCK) -> DataFrame:
    """The first is kept, then the next at least `distance` samples later.

    A block tells for each spike that may be its first kept one which would be its last; a row a
    block carries the last kept one along a series.
    """
    rows = written(rows.withColumn("block", F.floor(F.col("n") / block)), "spikes")
    keys = ["recording_index int", "channel string", "block long"]

    def lasts(pdf: pd.DataFrame) -> pd.DataFrame:
        n = np.sort(pdf["n"].to_numpy())
        following = np.searchsorted(n, n + distance)
        last = n.copy()
        for i in range(len(n) - 1, -1, -1):
            if following[i] < len(n):
                last[i] = last[following[i]]
        first = pdf[[*SERIES, "block"]].iloc[:1]
        most = np.searchsorted(n, int(first["block"].iloc[0]) * block + distance) + 1
        return first.assign(starts=[n[:most]], lasts=[last[:most]])

    def carry(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, last, opens = pdf.sort_values("block", kind="stable"), None, []
        for starts, ends in zip(pdf["starts"], pdf["lasts"], strict=True):
            i = 0 if last is None else int(np.searchsorted(starts, last + distance))
            opens.append(int(starts[i]) if i < len(starts) else None)
            last = int(ends[i]) if i < len(ends) else last
        return pdf[[*SERIES, "block"]].assign(opens=pd.array(opens, dtype="Int64"))

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n", kind="stable")
        n, kept, last = pdf["n"].to_numpy(), [], int(pdf["opens"].iloc[0]) - distance
        for i, x in enumerate(n):
            if x >= last + distance:
                kept.append(i)
                last = x
        return pdf.iloc[kept].drop(columns=["block", "opens"])

    chances = rows.groupBy(*SERIES, "block").applyInPandas(lasts, ", ".join([*keys, "starts array<long>", "lasts array<long>"]))
    opens = chances.groupBy(*SERIES).applyInPandas(carry, ", ".join([*keys, "opens long"])).filter("opens is not null")
    return rows.join(opens, [*SERIES, "block"]).groupBy(*SERIES, "block").applyInPandas(keep, rows.drop("block").schema)


def waveforms(spikes: DataFrame, samples: DataFrame, pre: int, post: int, block: int = WAVE_BLOCK) -> DataFrame:
    """Adds wave: x from n - pre to n + post - 1, null where missing; spikes too near an end go.

    A block meets all its spikes at once, with the samples that their windows take beyond its borders.
    """
    keys = [*SERIES, "block"]
    length = samples.groupBy(*SERIES).agg(F.max("n").alias("n1"))
    inside = spikes.join(length, SERIES).filter((F.col("n") - pre >= 0) & (F.col("n") + post <= F.col("n1"))).drop("n1")
    line = blocked(samples.select(*SERIES, "n", "x_uv"), max(pre, post), block).select(*keys, F.col("n").alias("m"), "x_uv")

    def cut(pdf: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf) or not len(found):
            return pdf.iloc[:0].drop(columns="block").assign(wave=pd.Series([], dtype=object))
        found = found.sort_values("m", kind="stable")
        m, x, n = found["m"].to_numpy(), found["x_uv"].to_numpy(float), pdf["n"].to_numpy()
        first, size = np.searchsorted(m, n - pre), pre + post
        if len(x) < size or not np.array_equal(m[np.minimum(first + size - 1, len(m) - 1)], n + post - 1):  # some n have no sample
            waves = [x[i:j] for i, j in zip(first, np.searchsorted(m, n + post), strict=True)]
        else:
            waves = list(x[first[:, None] + np.arange(size)])
        out = pdf.drop(columns="block").assign(wave=pd.Series(waves, index=pdf.index, dtype=object))
        return out[out["wave"].map(len) > 0]

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spikes.schema)
    at = inside.select(*spikes.columns, F.floor(F.col("n") / block).alias("block"))
    return at.groupBy(*keys).cogroup(line.groupBy(*keys)).applyInPandas(cut, f"{names}, wave array<double>").select(*SERIES, *[c for c in spikes.columns if c not in SERIES], "wave")


def mean_waveform(waves: DataFrame) -> DataFrame:
    x = waves.select(*SERIES, F.posexplode("wave").alias("k", "x"))
    return x.groupBy(*SERIES, "k").agg(F.avg("x").alias("mean_uv"), (F.stddev_pop("x") / F.sqrt(F.count("x"))).alias("sem_uv"), F.count("x").alias("n_spikes"))


def amplitude_gate(spikes: DataFrame, amplitude: Column, least: float | None, most: float | None) -> DataFrame:
    out = spikes.withColumn("amp_uv", amplitude)
    out = out.filter(F.abs("amp_uv") >= least) if least is not None else out
    return out.filter(F.abs("amp_uv") <= most) if most is not None else out


def wave_extreme(polarity: str) -> Column:
    low, high = F.array_min("wave"), F.array_max("wave")
    return {"neg": low, "pos": high}.get(polarity, F.when(F.abs(low) > F.abs(high), low).otherwise(high))


def opposite_width(spikes: DataFrame, samples: DataFrame, search: int, polarity: str = "neg", least: int = 0, most: int | None = None) -> DataFrame:
    """Samples from each spike to the opposite extremum within the search window, gated.

    Width 0, a window of one sample or less, and widths outside the bounds go. Of equal extrema the
    first counts. Spikes meet samples on equal cells of the window's length.
    """
    n, m, x = F.col("n"), F.col("m"), F.col("x_uv")
    length = samples.groupBy(*SERIES).agg(F.max("n").alias("last"))
    own = spikes.join(length, SERIES).withColumn("stop", F.least(n + search, F.col("last"))).filter(F.col("stop") > n + 1)
    hit = in_cells(own, samples, 0, search).filter((m >= n) & (m < F.col("stop")) & x.isNotNull())
    keys = [*SERIES, *[c for c in spikes.columns if c not in SERIES]]
    top, bottom = -F.max(F.struct(x, (-m).alias("k")))["k"], F.min(F.struct(x, m.alias("k")))["k"]
    w = hit.groupBy(*keys).agg(top.alias("top"), bottom.alias("bottom"), F.min_by("x_uv", "m").alias("first_x"))
    up, down = F.col("top") - n, F.col("bottom") - n
    width = up if polarity == "neg" else down if polarity == "pos" else F.when(F.col("first_x") < 0, up).otherwise(down)
    out = w.withColumn("width", width).drop("top", "bottom", "first_x").filter((F.col("width") > 0) & (F.col("width") >= least))
    return out.filter(F.col("width") <= most) if most is not None else out


class Extremes:
    """Smallest and largest values of all ranges of 2 ** j values, from which the nearest value on a
    side above a bound, or not above it, is found in as many steps as there are j, for many places
    at once."""

    def __init__(self, low: np.ndarray, high: np.ndarray) -> None:
        self.low, self.high, j = [low], [high], 1
        while 2 * j <= len(low):
            self.low.append(np.minimum(self.low[-1][:-j], self.low[-1][j:]))
            self.high.append(np.maximum(self.high[-1][:-j], self.high[-1][j:]))
            j *= 2

    def nearest(self, at: np.ndarray, left: np.ndarray, bound: np.ndarray, above: bool) -> tuple[np.ndarray, np.ndarray]:
        """The nearest place before (left) or from `at` on with a value above the bound, or at most
        the bound; -1 if there is none. And the smallest value on the way."""
        size, at = len(self.low[0]), at.copy()
        least = np.full(len(at), np.inf)
        for j in range(len(self.low) - 1, -1, -1):
            first = np.where(left, at - (1 << j), at)
            fits = np.flatnonzero((first >= 0) & (first + (1 << j) <= size))
            k = first[fits]
            free = self.high[j][k] <= bound[fits] if above else self.low[j][k] > bound[fits]
            fits, k = fits[free], k[free]
            least[fits] = np.minimum(least[fits], self.low[j][k])
            at[fits] += np.where(left[fits], -(1 << j), 1 << j)
        found = np.where(left, at - 1, at)
        return np.where((found >= 0) & (found < size), found, -1), least


def _line(blocks: pd.DataFrame) -> tuple[np.ndarray, int, int, int]:
    """The values of the one block, with those at its borders; the n of the first, and the range of
    its own values."""
    row = blocks.iloc[0]
    y = np.asarray(row["y"], dtype=float)
    return y, int(row["n0"]) - int(row["lead"]), int(row["lead"]), int(row["lead"]) + int(row["size"])


def _crossings(y: np.ndarray, tree: Extremes, place: np.ndarray, left: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest places with values of at most the bound, and how far from each towards the peak
    the bound is crossed; NaN for both if there is none."""
    at, _ = tree.nearest(place, left, bound, above=False)
    inner = np.clip(np.where(left, at + 1, at - 1), 0, len(y) - 1)
    with np.errstate(invalid="ignore", divide="ignore"):
        part = np.where(y[at] < bound, (bound - y[at]) / (y[inner] - y[at]), 0.0)
    return np.where(at < 0, np.nan, at), np.where(at < 0, np.nan, part)


def _choose(queries: DataFrame, sizes: DataFrame, above: bool) -> DataFrame:
    """queries (series, n, block, left, bound) with target, the nearest block beyond their own that
    has a value above the bound, or at most the bound, and least, the smallest value on the way to
    it. sizes: series, block, low and high, a row a block, so a series' rows are few."""

    def work(pdf: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        blocks = blocks.sort_values("block", kind="stable")
        number = blocks["block"].to_numpy()
        tree = Extremes(blocks["low"].to_numpy(), blocks["high"].to_numpy())
        left = pdf["left"].to_numpy(bool)
        at, least = tree.nearest(np.searchsorted(number, pdf["block"].to_numpy()) + ~left, left, pdf["bound"].to_numpy(), above)
        target = pd.Series(number[at] if len(number) else at, index=pdf.index, dtype="Int64").mask(at < 0)
        return pdf.assign(target=target, least=least)

    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in queries.schema)
    return queries.groupBy(*SERIES).cogroup(sizes.groupBy(*SERIES)).applyInPandas(work, f"{names}, target long, least double")


def half_prominence_width(spikes: DataFrame, samples: DataFrame, block: int = BLOCK) -> DataFrame:
    """(series, n, width): the width of |x| at half the prominence of each spike, in samples.

    A base lies between the spike and the nearest higher sample on its side, or the end of the
    series, however far that is. The last sample of a series has no width.

    A block meets all its spikes at once and answers them from tables of extremes. What a block
    can't tell, as a side stays open at its border, is looked up in the blocks' own extremes and
    then in the one block that has it: once for the bases and once for the crossings.
    """
    y = blocked(samples.select(*SERIES, "n", F.abs("x_uv").alias("y")), 1, block)
    own = F.when(F.col("own"), F.col("y"))
    blocks = y.groupBy(*SERIES, "block").agg(F.array_sort(F.collect_list(F.struct("n", "y", "own"))).alias("s"), F.min(own).alias("low"), F.max(own).alias("high"), F.count_if("own").alias("size"))
    blocks = blocks.filter("size > 0").withColumns({"lead": (~F.col("s")[0]["own"]).cast("int"), "y": F.col("s.y")})
    blocks = blocks.withColumn("n0", F.when(F.col("lead") == 1, F.col("s")[1]["n"]).otherwise(F.col("s")[0]["n"]))
    blocks = written(blocks.select(*SERIES, "block", "n0", "size", "low", "high", "lead", "y"), "blocks")
    sizes = blocks.select(*SERIES, "block", "low", "high")
    last = blocks.groupBy(*SERIES).agg(F.max(F.col("n0") + F.col("size") - 1).alias("last"))
    at = spikes.select(*SERIES, "n").distinct().join(last, SERIES).filter("n < last").select(*SERIES, "n", F.floor(F.col("n") / block).alias("block"))
    keys = [*SERIES, "block"]
    held = "recording_index int, channel string, block long, n long"

    def near(pdf: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        """Spikes of a block: a width, or what is known of a spike with an open side."""
        if not len(pdf) or not len(found):
            return pdf.iloc[:0].assign(height=0.0, width=0.0, left_open=False, right_open=False, left_least=0.0, right_least=0.0)
        line, n0, _, _ = _line(found)
        tree, place = Extremes(line, line), pdf["n"].to_numpy() - n0
        height = line[place]
        side = np.repeat([True, False], len(place))
        top, least = tree.nearest(np.r_[place, place + 1], side, np.r_[height, height], above=True)
        (left_top, right_top), (left_least, right_least) = top.reshape(2, -1), least.reshape(2, -1)
        base = np.maximum(np.minimum(left_least, height), np.minimum(right_least, height))
        level = height - (height - base) / 2
        cross, part = _crossings(line, tree, np.r_[place, place + 1], side, np.r_[level, level])
        (cl, cr), (pl, pr) = cross.reshape(2, -1), part.reshape(2, -1)
        width = np.where(level < height, (place - cl - pl) + (cr - place - pr), 0.0)
        open_left, open_right = left_top < 0, right_top < 0
        return pdf.assign(height=height, width=np.where(open_left | open_right, np.nan, width), left_open=open_left, right_open=open_right, left_least=left_least, right_least=right_least)

    with_spikes = blocks.join(at.select(*keys).distinct(), keys, "left_semi")
    first = written(at.groupBy(*keys).cogroup(with_spikes.groupBy(*keys)).applyInPandas(near, f"{held}, height double, width double, left_open boolean, right_open boolean, left_least double, right_least double"), "widths")
    done = first.filter("not (left_open or right_open)").select(*SERIES, "n", "width")

    # bases of open sides: the blocks between by their extremes, then the one block with a higher value
    side = lambda s: F.struct(F.lit(s == "left").alias("left"), F.col(f"{s}_open").alias("open"), F.col(f"{s}_least").alias("own_least"))
    sides = first.filter("left_open or right_open").withColumn("x", F.explode(F.array(side("left"), side("right")))).select(*keys, "n", "height", "x.*")
    open_ = sides.filter("open").withColumn("bound", F.col("height"))
    far = written(_choose(open_, sizes, True).withColumn("least", F.least("least", "own_least")), "bases")

    def rest(pdf: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        """The smallest value of the block up to the one above the bound."""
        if not len(pdf) or not len(found):
            return pdf.iloc[:0]
        line, _, a, b = _line(found)
        left = pdf["left"].to_numpy(bool)
        _, least = Extremes(line[a:b], line[a:b]).nearest(np.where(left, b - a, 0), left, pdf["bound"].to_numpy(), above=True)
        return pdf.assign(least=np.minimum(pdf["least"].to_numpy(), least))

    target = blocks.withColumnRenamed("block", "target")
    asked = far.filter("target is not null")
    there = asked.groupBy(*SERIES, "target").cogroup(target.join(asked.select(*SERIES, "target").distinct(), [*SERIES, "target"], "left_semi").groupBy(*SERIES, "target")).applyInPandas(rest, asked.schema)
    known = ["n", "block", "height", "left", "own_least", "least"]
    all_sides = there.select(*SERIES, *known).unionByName(far.filter("target is null").select(*SERIES, *known)).unionByName(sides.filter("not open").withColumn("least", F.col("own_least")).select(*SERIES, *known))
    base = all_sides.groupBy(*keys, "n", "height").agg(F.max(F.least("least", "height")).alias("base"), F.max(F.when(F.col("left"), F.col("own_least"))).alias("l"), F.max(F.when(~F.col("left"), F.col("own_least"))).alias("r"))
    level = written(base.withColumn("bound", F.col("height") - (F.col("height") - F.col("base")) / 2), "levels")

    # crossings: in the own block if it goes as low on that side, else in the nearest block that does
    side = lambda s: F.struct(F.lit(s == "l").alias("left"), F.col(s).alias("own_least"))
    ways = level.filter("bound < height").withColumn("x", F.explode(F.array(side("l"), side("r")))).select(*keys, "n", "bound", "x.*")
    beyond = _choose(ways.filter("own_least > bound"), sizes, False).drop("least")
    ways = ways.filter("own_least <= bound").withColumn("target", F.col("block")).unionByName(beyond)

    def crossed(pdf: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        """How far each spike is from where its side falls to the bound."""
        if not len(pdf) or not len(found):
            return pdf.iloc[:0][[*SERIES, "n"]].assign(span=0.0)
        line, n0, a, b = _line(found)
        left, inside = pdf["left"].to_numpy(bool), (pdf["block"] == pdf["target"]).to_numpy()
        start = np.where(inside, pdf["n"].to_numpy() - n0 + ~left, np.where(left, b, a))
        cross, part = _crossings(line, Extremes(line, line), start, left, pdf["bound"].to_numpy())
        return pdf[[*SERIES, "n"]].assign(span=np.abs(pdf["n"].to_numpy() - n0 - cross) - part)

    needed = target.join(ways.select(*SERIES, "target").distinct(), [*SERIES, "target"], "left_semi")
    spans = ways.groupBy(*SERIES, "target").cogroup(needed.groupBy(*SERIES, "target")).applyInPandas(crossed, "recording_index int, channel string, n long, span double")
    wide = spans.groupBy(*SERIES, "n").agg(F.sum("span").alias("width"))
    flat = level.filter("not bound < height").select(*SERIES, "n", F.lit(0.0).alias("width"))  # without prominence no width
    return done.unionByName(wide).unionByName(flat)


def triggered_average(spikes: DataFrame, samples: DataFrame, half: int, fs_hz: float) -> DataFrame:
    """Mean of the band around spikes: t_rel_s, lfp_sta_uv and the number of spikes used."""
    w = waveforms(spikes.select(*SERIES, "n"), samples, half, half)
    m = mean_waveform(w)
    return m.select(*SERIES, ((F.col("k") - half) / fs_hz).alias("t_rel_s"), F.col("mean_uv").alias("lfp_sta_uv"), F.col("n_spikes").alias("n_used"))


def _over(z: DataFrame, threshold: float) -> DataFrame:
    """The samples whose z counts, as a table: z itself is worked out once."""
    return written(z.filter(F.abs("z") >= threshold).select(*SERIES, "n", "z"), "over_threshold")


def detect_abs(samples: DataFrame, fs_hz: float, threshold: float, refractory_ms: float, pre: int, post: int, least: float | None, most: float | None) -> DataFrame:
    """|z| peaks, suppressed, cut and gated by the largest deflection of the waveform."""
    distance = max(1, round(refractory_ms / 1000 * fs_hz))
    found = suppress(peaks(_over(robust_z(samples), threshold), threshold, ends=series_ends(samples)), distance)
    return amplitude_gate(waveforms(found, samples, pre, post), wave_extreme("both"), least, most)


def detect_polarity(
    samples: DataFrame, fs_hz: float, threshold: float, refractory_ms: float, polarity: str, least: float | None, most: float | None, widths: tuple[int, int] | None = None,
    band: tuple[float, float] = (300.0, 5000.0), order: int = 3, block: int = BLOCK,
) -> DataFrame:
    """Band-pass, then peaks by polarity of z (variant B), each side suppressed, refractory, width and size."""
    distance = max(1, round(refractory_ms / 1000 * fs_hz))
    x = written(zero_phase(samples, band, fs_hz, order, "B", block), "filtered")
    over, ends = _over(robust_z(x, "B"), threshold), series_ends(x)
    sides = ["pos", "neg"] if polarity == "both" else [polarity]
    found = reduce(DataFrame.unionByName, [suppress(peaks(over, threshold, s, ends, block), distance, block) for s in sides])
    found = refractory(found.groupBy(*SERIES, "n").agg(F.max("height").alias("height")), distance, block)
    if widths:
        found = opposite_width(found, x, max(widths[1], 1), polarity, *widths)
    return amplitude_gate(found.join(x, [*SERIES, "n"]), F.col("x_uv"), least, most)


def detect_neuropil(
    samples: DataFrame, fs_hz: float, threshold: float, refractory_ms: float, polarity: str, least: float, most: float, widths_ms: tuple[float, float],
    band: tuple[float, float] = (300.0, 3000.0), order: int = 4, block: int = BLOCK,
) -> DataFrame:
    """Band-pass, then z of the rectified or signed signal, suppressed, gated by size and half-prominence width."""
    x = written(zero_phase(samples, band, fs_hz, order, "A", block), "filtered")
    y = {"neg": -F.col("x_uv"), "pos": F.col("x_uv")}.get(polarity, F.abs("x_uv"))
    over = _over(robust_z(x.withColumn("y", y), "A", "y"), threshold)
    found = suppress(peaks(over, threshold, "pos", series_ends(x), block), max(1, round(refractory_ms / 1000 * fs_hz)), block)
    gated = written(amplitude_gate(found.join(x, [*SERIES, "n"]), F.col("x_uv"), least, most), "spikes")
    wide = half_prominence_width(gated, x, block).withColumn("width_ms", F.col("width") / fs_hz * 1000)
    return gated.join(wide.drop("width"), [*SERIES, "n"]).filter(F.col("width_ms").between(*widths_ms))


def resolution_flags(rates: DataFrame) -> DataFrame:
    """Under-resolved below 2 kHz; channels ending _spike are in the spike band already."""
    return rates.withColumns({"under_resolved": F.col("fs_hz") < 2000, "band_pass": ~F.endswith("channel", F.lit("_spike"))})


def firing_rate(spikes: DataFrame, bin_s: float = 1.0) -> DataFrame:
    """Rate in bins from the first to the last spike, empty ones included."""
    span = spikes.groupBy(*SERIES).agg(F.min("t_s").alias("t0"), F.floor((F.max("t_s") - F.min("t_s")) / bin_s).cast("int").alias("last"))
    at = F.floor((F.col("t_s") - F.col("t0")) / bin_s).cast("int")
    c = spikes.join(span, SERIES).groupBy(*SERIES, at.alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    grid = span.withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("last"))))
    return grid.join(c, [*SERIES, "bin"], "left").select(*SERIES, (F.col("t0") + (F.col("bin") + 0.5) * bin_s).alias("t_s"), (F.coalesce("c", F.lit(0)) / bin_s).alias("rate_hz"))


def intervals(spikes: DataFrame) -> DataFrame:
    """Inter-spike intervals in ms. A spike train is a reduced table: windows over a series."""
    line = W.partitionBy(*SERIES).orderBy("t_s", "event_id" if "event_id" in spikes.columns else "t_s")
    return spikes.withColumn("isi_ms", (F.col("t_s") - F.lag("t_s").over(line)) * 1000).filter("isi_ms is not null")


def interval_histogram(isi: DataFrame, bins: int = 59, log: bool = False) -> DataFrame:
    """Linear bins from 0 to max(50, 99th percentile), or log bins from max(0.5, min) to
    max(1000, max); values beyond the edges are left out."""
    if log:
        ends = isi.groupBy(*SERIES).agg(F.log10(F.greatest(F.lit(0.5), F.min("isi_ms"))).alias("lo"), F.log10(F.greatest(F.lit(1000.0), F.max("isi_ms"))).alias("hi"))
        v = F.log10("isi_ms")
    else:
        high = quantiles(isi, SERIES, F.col("isi_ms"), 0.99)
        ends = written(high.select(*SERIES, F.lit(0.0).alias("lo"), F.greatest(F.lit(50.0), "quantile").alias("hi")), "edges")
        v = F.col("isi_ms")
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1)).cast("int")
    c = isi.filter("isi_ms > 0" if log else "isi_ms >= 0").withColumn("v", v).join(ends, SERIES).filter((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))).groupBy(*SERIES, at.alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    grid = ends.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    left, right = F.col("lo") + F.col("bin") * width, F.col("lo") + (F.col("bin") + 1) * width
    edge = (lambda x: F.pow(F.lit(10.0), x)) if log else (lambda x: x)
    return grid.join(c, [*SERIES, "bin"], "left").select(*SERIES, "bin", edge(left).alias("left_ms"), edge(right).alias("right_ms"), F.coalesce("c", F.lit(0)).alias("count"))


def train_autocorrelogram(spikes: DataFrame, bin_s: float, max_lag: int) -> DataFrame:
    """Autocorrelation of the mean-removed counts at lags of up to max_lag bins, from sparse bins.

    Counts are multiplied in arrays of BINS bins, to which the bins that the lags reach ahead are
    sent too: with S the products, A and B the sums of the counts that
    have a partner, N bins and mean m, it is S - m A - m B + (N - lag) m^2. Fewer than two spikes
    give nothing.
    """
    t0 = spikes.groupBy(*SERIES).agg(F.min("t_s").alias("t0"), F.max("t_s").alias("t1"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    t0 = t0.withColumn("bins", F.floor((F.col("t1") - F.col("t0")) / bin_s) + 1)
    at = F.floor((F.col("t_s") - F.col("t0")) / bin_s)
    c = spikes.join(t0, SERIES).groupBy(*SERIES, at.alias("b")).agg(F.count(F.lit(1)).alias("c"))
    c = c.withColumn("block", F.floor(F.col("b") / BINS))
    near = c.withColumn("block", F.explode(F.sequence(F.greatest(F.floor((F.col("b") - max_lag) / BINS), F.lit(0)), F.col("block"))))

    def products(pdf: pd.DataFrame) -> pd.DataFrame:
        line = np.zeros(BINS + max_lag)
        line[pdf["b"].to_numpy() - int(pdf["block"].iloc[0]) * BINS] = pdf["c"].to_numpy()
        lags = np.arange(max_lag + 1)
        own = np.flatnonzero(line[:BINS])  # bins with spikes are few
        sums = [float(line[own] @ line[own + k]) for k in lags]
        return pd.DataFrame({k: [pdf[k].iloc[0]] * len(lags) for k in SERIES} | {"lag": lags, "p": sums})

    parts = near.groupBy(*SERIES, "block").applyInPandas(products, "recording_index int, channel string, lag int, p double")
    s = parts.groupBy(*SERIES, "lag").agg(F.sum("p").alias("s"))
    c = c.drop("block")
    grid = t0.withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(max_lag)))).filter("lag < bins")
    ends = c.join(t0.select(*SERIES, "bins"), SERIES)
    head = ends.filter(F.col("b") < max_lag).select(*SERIES, "b", "c")
    tail = ends.filter(F.col("b") >= F.col("bins") - max_lag).select(*SERIES, (F.col("bins") - 1 - F.col("b")).alias("b"), "c")
    lost = lambda d, n: grid.join(d, SERIES).filter(F.col("b") < F.col("lag")).groupBy(*SERIES, "lag").agg(F.sum("c").alias(n))
    out = grid.join(s, [*SERIES, "lag"], "left").join(lost(head, "h"), [*SERIES, "lag"], "left").join(lost(tail, "g"), [*SERIES, "lag"], "left")
    m, zero = F.col("k") / F.col("bins"), F.lit(0)
    value = F.coalesce("s", zero) - m * (F.col("k") - F.coalesce("g", zero)) - m * (F.col("k") - F.coalesce("h", zero)) + (F.col("bins") - F.col("lag")) * m * m
    half = out.select(*SERIES, "lag", value.alias("acg"))
    return half.unionByName(half.filter("lag > 0").withColumn("lag", -F.col("lag"))).select(*SERIES, (F.col("lag") * bin_s).alias("lag_s"), "acg")


def raster(spikes: DataFrame) -> DataFrame:
    return spikes.select(*SERIES, "t_s")
