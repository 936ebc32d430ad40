"""Baseline, stimulation and post statistics of units over experiment parts."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sparktrode.functions.labels import clean_post, clean_stimulation, comparisons, micrometres, normalised, phase, recorded_phases, stars

from .windows import ranked

FIRST, SECOND = "Baseline first half", "Baseline second half"
ORDER = ["recording_index", "window_start_s", "window_end_s", "window_index"]
HZ = "firing_rate_hz"
#: phase, its rate column, percent column, and the two columns of its paired test.
PHASES = [
    ("Baseline", "baseline_second_half_hz", "baseline_percent_change", "baseline_first_half_hz", "baseline_second_half_hz"),
    ("Stimulation", "stimulation_hz", "stimulation_percent_change", "baseline_hz", "stimulation_hz"),
    ("Post", "post_hz", "post_percent_change", "baseline_hz", "post_hz"),
]


def error(c: Column, kind: str = "sem") -> Column:
    """Standard error or deviation (n - 1); null for fewer than two values."""
    n = F.count(c)
    return F.when(n > 1, F.stddev_samp(c) / (F.sqrt(n) if kind == "sem" else F.lit(1.0)))


def prepare(rows: DataFrame) -> DataFrame:
    """Typed, trimmed rows with duration, rate and phase; rows without an id, count or time go."""
    number = lambda c: F.col(c).try_cast("double") if dict(rows.dtypes)[c] == "string" else F.col(c).cast("double")
    text = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    out = rows.withColumns({c: number(c) for c in ("spike_count", "window_start_s", "window_end_s", "window_duration_s") if c in rows.columns} | {c: text(c) for c in ("recording_name", "epoch_label", "channel")})
    if {"window_start_s", "window_end_s"} <= set(rows.columns):
        out = out.withColumn("window_duration_s", F.col("window_end_s") - F.col("window_start_s"))
    whole = F.lit(True)
    for c in ("recording_name", "epoch_label", "channel", "spike_count"):
        whole = whole & F.col(c).isNotNull()
    out = firing_rates(out.filter(whole & (F.col("window_duration_s") > 0))).withColumn("phase", phase(F.col("epoch_label")))
    return out.filter(F.col("phase").isNotNull()).withColumns(
        {
            "stimulation_label_raw": F.when(F.col("phase") == "Stimulation", clean_stimulation(F.col("epoch_label"))),
            "post_label_raw": F.when(F.col("phase") == "Post", clean_post(F.col("epoch_label"))),
        }
    )


def keep_phases(rows: DataFrame, recorded: str | list[str] | None = None, label: str = "epoch_label") -> DataFrame:
    """Rows of the recorded phases, by a `phase` column if there is one, else by the label."""
    of = F.col("phase") if "phase" in rows.columns else phase(F.col(label))
    return rows.filter(of.isin(recorded_phases(recorded)))


def animal_counts(spikes: DataFrame, keys: list[str]) -> DataFrame:
    """spike_count for each combination of the keys' values, zeros included; a few names each."""
    grid = reduce(DataFrame.crossJoin, [spikes.select(k).distinct() for k in keys])
    return grid.join(spikes.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")), keys, "left").select(*keys, F.coalesce("__n", F.lit(0)).alias("spike_count"))


def condition_means(counts: DataFrame, order: list[str], condition: str = "condition", value: str = "spike_count") -> DataFrame:
    """Mean and deviation (n - 1) of each listed condition, with its place in the list."""
    place = F.array_position(F.lit(order), F.col(condition)).cast("int")
    return counts.filter(F.col(condition).isin(order)).groupBy(condition, place.alias("ord")).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))


def condition_pivot(rows: DataFrame, session: str, needed: list[str], order: str, strict: bool = False) -> DataFrame:
    """A row for each session and a column for each condition; of repeated rows the last in order counts.

    Sessions that lack a condition go, or with strict are an error.
    """
    last = rows.filter(F.col("condition").isin(needed)).groupBy(session, "condition").agg(F.max_by("count", order).alias("count"))
    wide = last.groupBy(session).pivot("condition", needed).agg(F.first("count"))
    whole = reduce(Column.__and__, [F.col(f"`{c}`").isNotNull() for c in needed])
    if strict:
        lacking = F.raise_error(F.concat(F.lit("conditions are missing in session "), F.col(session).cast("string"))).cast("boolean")
        return wide.filter(F.when(whole, True).otherwise(lacking))
    return wide.filter(whole)


def percent_of_baseline(rows: DataFrame, session: str, base: str = "Baseline") -> DataFrame:
    """pct of each condition's count against the session's base; null without one or where it is 0."""
    bases = rows.filter(F.col("condition") == base).groupBy(session).agg(F.max("count").alias("__base"))
    return rows.join(bases, session, "left").withColumn("pct", 100.0 * F.col("count") / F.nullif(F.col("__base"), F.lit(0))).drop("__base")


def tip_summary(tips: DataFrame, size: str, value: str) -> DataFrame:
    """Mean, deviation (0 for one row) and rows of each size, with the size in micrometres."""
    sized = tips.withColumn("um", micrometres(F.col(size)))
    return sized.groupBy(size, "um").agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"), F.count(F.lit(1)).alias("n"))


def firing_rates(rows: DataFrame) -> DataFrame:
    """firing_rate_hz: spikes by duration; null where there is none."""
    return rows.withColumn(HZ, F.col("spike_count") / F.when(F.col("window_duration_s") > 0, F.col("window_duration_s")))


def numbered_windows(rows: DataFrame, order: str) -> DataFrame:
    line = W.partitionBy("recording_name", "channel", "phase").orderBy(order)
    return rows.withColumn("window_index", F.row_number().over(line))


def unit_means(rows: DataFrame, ids: list[str], group: str | None, parts: list[str] | None = None) -> DataFrame:
    keys = [*ids, *([group] if group else [])]
    if group:
        rows = rows.withColumn(group, F.coalesce(F.col(group).cast("string"), F.lit("Unlabeled")))
    return rows.groupBy(*keys, "phase", *(parts or [])).agg(
        F.avg(HZ).alias("mean_firing_rate_hz"), error(F.col(HZ)).alias("sem_firing_rate_hz"), F.count(HZ).alias("n_windows"),
        F.avg("spike_count").alias("mean_spike_count"), F.avg("window_duration_s").alias("mean_window_duration_s"),
    )


def baseline_halves(rows: DataFrame, keys: list[str]) -> DataFrame:
    """baseline_half of each baseline window: by the middle of the time, else by the row count."""
    unit = W.partitionBy(*keys, "phase")
    line = unit.orderBy("window_start_s", "window_end_s", "window_index")
    centre = (F.col("window_start_s") + F.col("window_end_s")) / 2
    middle = F.min("window_start_s").over(unit) + (F.max("window_end_s").over(unit) - F.min("window_start_s").over(unit)) / 2
    out = rows.withColumns({"__n": F.count(F.lit(1)).over(unit), "__timed": F.count(centre).over(unit), "__rank": F.row_number().over(line), "__early": centre < middle})
    early = F.count_if("__early").over(unit)
    by_time = (F.col("__timed") == F.col("__n")) & (early > 0) & (early < F.col("__n"))
    first = F.when(by_time, F.col("__early")).otherwise(F.col("__rank") <= F.floor(F.col("__n") / 2))
    half = F.when((F.col("phase") == "Baseline") & (F.col("__n") >= 2), F.when(first, FIRST).otherwise(SECOND))
    return out.withColumn("baseline_half", half).drop("__n", "__timed", "__rank", "__early")


def percent(new: Column, base: Column) -> Column:
    return (new - base) / F.nullif(base, F.lit(0.0)) * 100


def baseline_table(rows: DataFrame, keys: list[str]) -> DataFrame:
    half = lambda f, h: f(F.when(F.col("baseline_half") == h, F.col(HZ)))
    out = rows.filter(F.col("baseline_half").isNotNull()).groupBy(*keys).agg(
        half(F.avg, FIRST).alias("baseline_first_half_hz"), half(F.avg, SECOND).alias("baseline_second_half_hz"),
        half(F.count, FIRST).alias("baseline_first_half_n_windows"), half(F.count, SECOND).alias("baseline_second_half_n_windows"),
    )
    a, b = F.col("baseline_first_half_hz"), F.col("baseline_second_half_hz")
    return out.withColumns({"delta_hz": b - a, "percent_change": percent(b, a)})


def experiment_parts(rows: DataFrame, keys: list[str], post_opens: bool = False) -> DataFrame:
    """part_index, stimulation_label and part_label of each window.

    Each stimulation block opens a part and the post blocks after it join it; post before any
    stimulation has none, unless post_opens lets it open a part.
    """
    line = W.partitionBy(*keys).orderBy(*ORDER)
    block = F.when(F.col("phase") == "Stimulation", F.col("stimulation_label_raw")).when(F.col("phase") == "Post", F.col("post_label_raw")).otherwise(F.col("phase"))
    out = rows.withColumn("__block", block)
    changed = F.coalesce(F.col("__block") != F.lag("__block").over(line), F.lit(True))
    stim = (F.col("phase") == "Stimulation") & F.col("__new")
    out = out.withColumn("__new", changed).withColumn("__stims", F.sum(stim.cast("int")).over(line))
    opens = stim | ((F.col("phase") == "Post") & F.col("__new") & (F.col("__stims") == 0) & F.lit(post_opens))
    out = out.withColumn("__part", F.sum(opens.cast("int")).over(line)).withColumn("__label", F.last(F.when(opens, F.col("__block")), ignorenulls=True).over(line))
    inside = (F.col("phase") != "Baseline") & (F.col("__part") > 0)
    out = out.withColumns({"part_index": F.when(inside, F.col("__part").cast("int")), "stimulation_label": F.when(inside, F.col("__label"))})
    name = F.concat(F.lit("Part "), F.col("part_index").cast("string"), F.lit(": "), F.col("stimulation_label"))
    return out.withColumn("part_label", name).drop("__block", "__new", "__stims", "__part", "__label")


def detected_parts(rows: DataFrame) -> DataFrame:
    return rows.filter("part_index is not null").select("part_index", "stimulation_label", "part_label").distinct()


def baseline_references(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The baseline of each unit in one pass: rates, errors and window counts, whole and by halves."""
    half = lambda f, h: f(F.when(F.col("baseline_half") == h, F.col(HZ)))
    split = F.count("baseline_half") > 0  # a unit of one window has no halves
    a, b = half(F.avg, FIRST), half(F.avg, SECOND)
    return rows.filter("phase = 'Baseline'").groupBy(*keys).agg(
        F.avg(HZ).alias("baseline_hz"), error(F.col(HZ)).alias("baseline_window_error_hz"), F.count(HZ).alias("baseline_n_windows"),
        a.alias("baseline_first_half_hz"), b.alias("baseline_second_half_hz"),
        F.when(split, half(F.count, FIRST)).alias("baseline_first_half_n_windows"), F.when(split, half(F.count, SECOND)).alias("baseline_second_half_n_windows"),
        percent(b, a).alias("baseline_percent_change"), half(F.stddev_samp, SECOND).alias("__sd"), half(F.count, SECOND).alias("__n"),
    )


def part_table(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each unit and part: rates, errors and percent changes against the baseline."""
    of = lambda p: F.when(F.col("phase") == p, F.col(HZ))
    parts = rows.filter("part_index is not null").groupBy(*keys, "part_index", "stimulation_label", "part_label")
    parts = parts.agg(*[f(of(p)).alias(n) for p, s in (("Stimulation", "stimulation"), ("Post", "post")) for f, n in ((F.avg, f"{s}_hz"), (F.count, f"{s}_n_windows"), (error, f"{s}_window_error_hz"))])
    base = baseline_references(rows, keys)
    base = base.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in base.columns if c not in keys])
    out = parts.join(base, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], "left").drop(*[f"__{k}" for k in keys])
    ref = F.coalesce("baseline_second_half_hz", "baseline_hz")
    out = out.withColumns({"percent_reference_hz": ref, "percent_reference_label": F.when(F.col("baseline_second_half_hz").isNotNull(), SECOND).otherwise("Baseline")})
    for s in ("stimulation", "post"):
        hz = F.col(f"{s}_hz")
        scale = 100 / F.abs(F.nullif(F.col("percent_reference_hz"), F.lit(0.0)))
        out = out.withColumns({f"{s}_delta_hz": hz - F.col("baseline_hz"), f"{s}_percent_change": percent(hz, F.col("percent_reference_hz")), f"{s}_percent_change_error": F.col(f"{s}_window_error_hz") * scale})
    first = F.abs(F.nullif(F.col("baseline_first_half_hz"), F.lit(0.0)))
    spread = F.when(F.col("__n") > 1, F.col("__sd") / F.sqrt("__n"))
    return out.withColumn("baseline_percent_change_error", spread / first * 100).drop("__sd", "__n")


def t_stats(rows: DataFrame, keys: list[str], diff: Column) -> DataFrame:
    """n, t and df of the paired test on a difference; all near zero gives t 0 by p = 1."""
    n, sd = F.count(diff), F.stddev_samp(diff)
    zero = F.max(F.abs(diff)) <= 1e-8
    out = rows.groupBy(*keys) if keys else rows
    return out.agg(n.alias("paired_n"), zero.alias("all_zero"), F.when((n > 1) & ~zero, F.avg(diff) / (sd / F.sqrt(n))).alias("t"), F.when(n > 1, n - 1).cast("double").alias("df"))


def p_value(t: Column, df: Column, all_zero: Column | None = None) -> Column:
    """Two-sided p of Student's t, by Arrow batches over a small result."""
    p = F.pandas_udf(lambda a, b: pd.Series(student_p(a.to_numpy(float), b.to_numpy(float))), "double")(t.cast("double"), df.cast("double"))
    p = F.when(t.isNotNull() & df.isNotNull(), p)
    return p if all_zero is None else F.when(all_zero & df.isNotNull(), 1.0).otherwise(p)


def student_p(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    return np.array([incomplete_beta(d / 2, 0.5, d / (d + x * x)) if np.isfinite(x) and np.isfinite(d) else (0.0 if np.isinf(x) else np.nan) for x, d in zip(t, df, strict=True)])


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c = 1e-300, 1.0
    d = 1 / max(1 - (a + b) * x / (a + 1), tiny)
    out = d
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            c = 1 + top / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def _by_group(table: DataFrame, group: str | None) -> DataFrame:
    return table.withColumn("group", F.col(group) if group else F.lit("All units"))


def phase_rows(table: DataFrame, group: str | None, compared: str | list[str] | None = None) -> DataFrame:
    """The part table with a row for each phase that is compared: hz, pct, a, b, ref and its label."""
    specs, chosen = [], comparisons(compared)
    for p, hz, pct, a, b in PHASES:
        ref, ref_label = (F.col("baseline_first_half_hz"), F.lit(FIRST)) if p == "Baseline" else (F.col("percent_reference_hz"), F.col("percent_reference_label"))
        named = {"phase": F.lit(p), "hz": F.col(hz), "pct": F.col(pct), "a": F.col(a), "b": F.col(b), "ref": ref, "ref_label": ref_label}
        specs += [F.struct(*[c.alias(k) for k, c in named.items()])] if p in chosen else []
    specs = F.array(*specs)
    return _by_group(table, group).select("part_index", "part_label", "stimulation_label", "group", F.explode(specs).alias("s")).select("part_index", "part_label", "stimulation_label", "group", "s.*")


def _matched(sides: list[tuple[DataFrame, list[str]]], order: list[str]) -> list[DataFrame]:
    """Each side with its rank k in the order among the rows that share its columns; rows of which
    one is null go. All sides are ranked at once, by ranges."""
    columns = list(dict.fromkeys(c for _, keys in sides for c in keys))
    tagged = []
    for i, (df, keys) in enumerate(sides):
        df = df.dropna(subset=keys)
        text = [F.col(c).cast("string") if c in keys else F.lit("") for c in columns]
        tagged.append(df.select(F.lit(i).alias("side"), *[c.alias(f"key_{k}") for c, k in zip(text, columns, strict=True)], *order, "hz"))
    all_ = ranked(reduce(DataFrame.unionByName, tagged), *order, keys=["side", *[f"key_{k}" for k in columns]])
    out = []
    for i, (df, keys) in enumerate(sides):
        own = [F.col(f"key_{k}").cast(df.schema[k].dataType).alias(k) for k in keys]
        out.append(all_.filter(F.col("side") == i).select(*own, F.col("rank").alias("k"), "hz"))
    return out


def window_pairs(rows: DataFrame, group: str | None) -> DataFrame:
    """(part_index, phase, group, a, b): ordered baseline windows against ordered windows of each
    part's phase, matched by rank; the two halves of the baseline where the phase is Baseline."""
    rows = _by_group(rows, group).filter(F.col(HZ).isNotNull()).withColumn("hz", F.col(HZ))
    half = lambda h: rows.filter(F.col("baseline_half") == h)
    sides = [(rows.filter("phase = 'Baseline'"), ["group"]), (rows, ["group", "part_index", "phase"]), (half(FIRST), ["group"]), (half(SECOND), ["group"])]
    base, other, early, late = _matched(sides, [*ORDER, "channel"])
    left = lambda d: d.withColumnRenamed("hz", "a")
    right = lambda d: d.withColumnRenamed("hz", "b")
    moved = right(other).join(left(base), ["group", "k"]).select("part_index", "phase", "group", "a", "b")
    within = left(early).join(right(late), ["group", "k"])
    parts = rows.filter("part_index is not null").select("part_index", "group").distinct()
    return moved.unionByName(within.join(parts, "group").select("part_index", F.lit("Baseline").alias("phase"), "group", "a", "b"))


def part_summary(table: DataFrame, rows: DataFrame, group: str | None, compared: str | list[str] | None = None) -> DataFrame:
    """Mean, error, reference and paired test of each part, group and compared phase; the test falls
    back on matched windows where units are too few."""
    keys = ["part_index", "part_label", "stimulation_label", "group", "phase"]
    long = phase_rows(table, group, compared)
    mean = long.groupBy(*keys).agg(
        F.count("hz").alias("n_units"), F.avg("hz").alias("mean_hz"), error(F.col("hz")).alias("sem_hz"), F.min("ref_label").alias("percent_reference_label"), F.avg("ref").alias("percent_reference_mean_hz"),
        F.avg("pct").alias("percent_change_mean"), error(F.col("pct")).alias("percent_change_sem"), F.count("pct").alias("percent_change_n"),
    ).filter("n_units > 0 or percent_change_n > 0")
    paired = t_stats(long, keys, F.col("b") - F.col("a"))
    small = ["part_index", "group", "phase"]
    fallback = t_stats(window_pairs(rows, group), small, F.col("b") - F.col("a"))
    fallback = fallback.select(*small, F.col("paired_n").alias("wn"), F.col("all_zero").alias("wz"), F.col("t").alias("wt"), F.col("df").alias("wdf"))
    out = mean.join(paired, keys).join(fallback, small, "left")
    use = F.col("df").isNull() | (F.col("t").isNull() & ~F.col("all_zero"))
    pick = lambda w, c: F.when(use, F.col(w)).otherwise(F.col(c))
    named = F.when(~use, "paired t-test").when(F.col("phase") == "Baseline", "paired t-test on matched Baseline windows").otherwise(F.concat(F.lit("paired t-test on matched Baseline/"), "phase", F.lit(" windows")))
    return out.select(*keys, *[c for c in mean.columns if c not in keys], named.alias("paired_test_used"), F.coalesce(pick("wn", "paired_n"), F.lit(0)).alias("paired_n"), pick("wt", "t").alias("t"), pick("wdf", "df").alias("df"), pick("wz", "all_zero").alias("all_zero"))


def with_significance(tests: DataFrame) -> DataFrame:
    p = p_value(F.col("t"), F.col("df"), F.col("all_zero"))
    return tests.withColumn("p_value", p).withColumn("significance", stars(F.col("p_value")))


def unpaired_tests(table: DataFrame, group: str, compared: str | list[str] | None = None) -> DataFrame:
    """Welch's test of percent changes for each two groups of each part and compared phase."""
    keys = ["part_index", "part_label", "stimulation_label", "phase"]
    grouped = phase_rows(table, group, compared).filter(F.col("group").isNotNull()).groupBy(*keys, "group").agg(F.count("pct").alias("n"), F.avg("pct").alias("m"), F.var_samp("pct").alias("v"))
    side = lambda k: grouped.withColumnsRenamed({"group": f"group_{k}", "n": f"n_group_{k}", "m": f"group_{k}_mean", "v": f"v{k}"})
    both = side(1).join(side(2), keys).filter("group_1 < group_2")
    ok = (F.col("n_group_1") > 1) & (F.col("n_group_2") > 1)
    a, b = F.col("v1") / F.col("n_group_1"), F.col("v2") / F.col("n_group_2")
    t = (F.col("group_1_mean") - F.col("group_2_mean")) / F.sqrt(a + b)
    df = (a + b) ** 2 / (a**2 / (F.col("n_group_1") - 1) + b**2 / (F.col("n_group_2") - 1))
    return both.select(*keys, "group_1", "group_2", "n_group_1", "n_group_2", "group_1_mean", "group_2_mean", F.when(ok, t).alias("t"), F.when(ok, df).alias("df"), F.lit(False).alias("all_zero"))


def fallback_error(across: Column, n: Column, single: Column) -> Column:
    """The error across units where there are several, else that of the only unit's windows."""
    return F.when(n > 1, across).otherwise(single)


def pooled_changes(rows: DataFrame, group: str | None, keys: list[str], compared: str | list[str] | None = None) -> DataFrame:
    """Percent change by category over all parts, with its paired test: Baseline, each stimulation
    label, each post label.

    rows are windows with parts. A unit's windows of a label are averaged over all parts; a generic
    'Post' is numbered by its part. Only compared phases have categories. One row for each group and
    category; category_order is the same for all groups: Baseline, stimulation, post, and within
    these by the first window of any group. The error is across units, else across the
    only unit's windows. Units are paired with their baseline; where they are too few for a test,
    windows are, in order.
    """
    rows = _by_group(rows, group).withColumn("group", F.coalesce(F.col("group").cast("string"), F.lit("Unlabeled")))
    unit = list(dict.fromkeys(["group", *keys]))
    base = baseline_references(rows, unit)
    named = F.coalesce(F.nullif(F.trim(F.when(F.col("phase") == "Post", F.col("post_label_raw")).otherwise(F.col("stimulation_label_raw"))), F.lit("")), F.col("phase"))
    generic = (F.col("phase") == "Post") & (normalised(named) == "post") & F.col("part_index").isNotNull()
    label = F.when(generic, F.concat(F.lit("Post "), F.col("part_index").cast("string"))).otherwise(named)
    place = F.struct(*ORDER, "channel")
    windows = rows.filter(F.col(HZ).isNotNull()).withColumns({"place": place, "hz": F.col(HZ)})
    chosen = comparisons(compared)
    other = windows.filter((F.col("phase") != "Baseline") & F.col("phase").isin(chosen)).withColumn("category", label)
    ref = F.coalesce("baseline_second_half_hz", "baseline_hz")
    moved = other.groupBy(*unit, "phase", "category").agg(F.avg("hz").alias("b"), error(F.col("hz")).alias("err"), F.min("place").alias("first_seen"))
    scaled = F.col("err") / F.abs(F.nullif(ref, F.lit(0.0))) * 100
    moved = moved.join(base, unit, "left")
    moved = moved.select("group", "phase", "category", "first_seen", F.col("baseline_hz").alias("a"), "b", percent(F.col("b"), ref).alias("pct"), scaled.alias("err"))
    first = F.nullif(F.col("baseline_first_half_hz"), F.lit(0.0))
    within = base.filter(F.col("baseline_percent_change").isNotNull() & F.lit("Baseline" in chosen)).select(
        "group", F.lit("Baseline").alias("phase"), F.lit("Baseline").alias("category"), F.lit(None).cast(moved.schema["first_seen"].dataType).alias("first_seen"),
        F.col("baseline_first_half_hz").alias("a"), F.col("baseline_second_half_hz").alias("b"), F.col("baseline_percent_change").alias("pct"), (F.col("__sd") / F.sqrt("__n") / F.abs(first) * 100).alias("err"),
    )
    kinds = ["group", "phase", "category"]
    long = within.unionByName(moved)
    seen = long.groupBy(*kinds).agg(F.min("first_seen").alias("first_seen"), F.count("pct").alias("n"), F.avg("pct").alias("mean"), error(F.col("pct")).alias("across"), F.max("err").alias("single")).filter("n > 0")
    diff = F.col("b") - F.col("a")
    paired = t_stats(long, kinds, diff)
    start = windows.filter("phase = 'Baseline'")
    half = lambda h: start.filter(F.col("baseline_half") == h)
    base_k, other_k, early, late = _matched([(start, ["group"]), (other, kinds), (half(FIRST), ["group"]), (half(SECOND), ["group"])], [*ORDER, "channel"])
    left = lambda d: d.withColumnRenamed("hz", "a")
    pairs = other_k.withColumnRenamed("hz", "b").join(left(base_k), ["group", "k"]).select(*kinds, "a", "b")
    halves = left(early).join(late.withColumnRenamed("hz", "b"), ["group", "k"]).select("group", *[F.lit("Baseline").alias(c) for c in kinds[1:]], "a", "b")
    fallback = t_stats(pairs.unionByName(halves), kinds, diff).select(*kinds, F.col("t").alias("wt"), F.col("df").alias("wdf"), F.col("all_zero").alias("wz"))
    out = seen.join(paired, kinds).join(fallback, kinds, "left")
    use = F.col("df").isNull() | (F.col("t").isNull() & ~F.col("all_zero"))
    pick = lambda w, c: F.when(use, F.col(w)).otherwise(F.col(c))
    kind = F.array_position(F.lit(["Baseline", "Stimulation", "Post"]), F.col("phase"))
    first_row = F.min("first_seen").alias("first_seen")
    names = long.groupBy("phase", "category").agg(first_row, F.count("pct").alias("n")).filter("n > 0")
    names = names.select("phase", "category", F.dense_rank().over(W.orderBy(kind, "first_seen", "category")).alias("category_order"))  # a row a category
    out = out.join(names, ["phase", "category"]).select("group", "category", "category_order", "n", "mean", fallback_error(F.col("across"), F.col("n"), F.col("single")).alias("error"), pick("wt", "t").alias("t"), pick("wdf", "df").alias("df"), pick("wz", "all_zero").alias("all_zero"))
    return with_significance(out).drop("all_zero")


def plot_tables(table: DataFrame, rows: DataFrame, group: str | None, compared: str | list[str] | None = None) -> DataFrame:
    """What the two figures of each part show: kind ('frequency' or 'percent'), label, mean, error,
    n and stars by group and phase.

    Phases that aren't compared are left out, but for the frequency of the baseline, which is that of
    all its windows and has no stars. A post without
    stimulation takes the part's label. Phases without a value in a part are left out, and so is a
    part without any but the baseline.
    """
    keys = ["part_index", "part_label", "stimulation_label"]
    t = _by_group(table, group)
    specs = [("frequency", p, f"{s}_hz", f"{s}_window_error_hz") for p, s in (("Baseline", "baseline"), ("Stimulation", "stimulation"), ("Post", "post"))]
    specs += [("percent", p, f"{s}_percent_change", f"{s}_percent_change_error") for p, s in (("Baseline", "baseline"), ("Stimulation", "stimulation"), ("Post", "post"))]
    chosen = comparisons(compared)
    specs = [s for s in specs if s[1] in chosen or s[:2] == ("frequency", "Baseline")]
    every = W.partitionBy(*keys)
    t = t.withColumn("__stimulated", F.count("stimulation_hz").over(every) > 0)
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(p).alias("phase"), F.col(v).cast("double").alias("v"), F.col(e).cast("double").alias("e")) for k, p, v, e in specs]))
    long = t.select(*keys, "group", "__stimulated", cells.alias("c")).select(*keys, "group", "__stimulated", "c.*")
    here = W.partitionBy(*keys, "kind")
    long = long.withColumn("__has", F.count("v").over(W.partitionBy(*keys, "kind", "phase")) > 0).withColumn("__others", F.count(F.when(F.col("phase") != "Baseline", F.col("v"))).over(here) > 0)
    long = long.filter(F.col("__has") & (F.col("__others") | (F.col("kind") == "percent")))
    label = F.when(F.col("phase") == "Stimulation", F.col("stimulation_label")).when((F.col("phase") == "Post") & ~F.col("__stimulated"), F.col("stimulation_label")).otherwise(F.col("phase"))
    out = long.groupBy(*keys, "group", "kind", "phase", label.alias("label")).agg(F.avg("v").alias("mean"), fallback_error(error(F.col("v")), F.count("v"), F.max("e")).alias("error"), F.count("v").alias("n"))
    tests = with_significance(part_summary(table, rows, group, compared)).select("part_index", "group", "phase", "significance")
    bare = (F.col("kind") == "frequency") & (F.col("phase") == "Baseline")
    return out.join(tests, ["part_index", "group", "phase"], "left").withColumn("significance", F.when(~bare, F.col("significance")))


def time_course(rows: DataFrame, keys: list[str], most_units: int | None = None) -> DataFrame:
    """minutes, rate and whether the condition changes, for each unit's windows in order."""
    line = W.partitionBy(*keys).orderBy("window_start_s", "window_index", "recording_index")
    changed = (F.col("phase") != F.lag("phase").over(line)) & F.lag("phase").over(line).isNotNull()
    minutes = F.coalesce(F.col("window_start_s") / 60, (F.row_number().over(line) - 1).cast("double"))
    out = rows.select(*keys, "recording_index", "window_index", "phase", minutes.alias("minutes"), HZ, F.coalesce(changed, F.lit(False)).alias("boundary"))
    if most_units is None:
        return out
    units = rows.select(*keys).distinct().withColumn("k", F.row_number().over(W.orderBy(*keys))).filter(F.col("k") <= most_units)
    return out.join(units.drop("k"), keys, "left_semi")


def paired_conditions(rows: DataFrame, keys: list[str], posts: list[str]) -> DataFrame:
    """The older tables: mean rate of Baseline against each named post condition, by raw label."""
    means = rows.groupBy(*keys).pivot("epoch_label", ["Baseline", *posts]).agg(F.avg(HZ))
    halves = baseline_table(rows, keys).select(*keys, "baseline_first_half_hz", "baseline_second_half_hz")
    out = None
    for p in posts:
        one = means.join(halves, keys, "left").filter(F.col("Baseline").isNotNull() & F.col(f"`{p}`").isNotNull())
        base, post, ref = F.col("Baseline"), F.col(f"`{p}`"), F.col("baseline_second_half_hz")
        named = {"post_condition": F.lit(p), "baseline_hz": base, "post_hz": post, "delta_hz": post - base, "percent_reference_hz": ref, "percent_change": percent(post, ref)}
        one = one.select(*keys, *[c.alias(k) for k, c in named.items()])
        out = one if out is None else out.unionByName(one)
    return out
