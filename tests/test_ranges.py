"""Ranks, ranges that come as tables, islands of peaks, correlograms and chosen comparisons."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparktrode.operators import spikes as K
from sparktrode.operators import statistics as S
from sparktrode.operators import windows as O


def test_ranks_in_groups_need_no_task_a_group(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.8 else rng.choice("ab"), rng.randrange(50), i) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, x int, i int").repartition(5)
    got = {r["i"]: r["rank"] for r in O.ranked(df, "x", "i", keys=["g"]).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        want |= {i: k for k, (_, i) in enumerate(sorted((x, i) for h, x, i in rows if h == g), 1)}
    assert got == want
    whole = {r["i"]: r["rank"] for r in O.ranked(df, "x", "i").collect()}
    assert whole == {i: k for k, (_, i) in enumerate(sorted((x, i) for _, x, i in rows), 1)}


@pytest.fixture(scope="module")
def ranges(spark):
    rng = random.Random(2)
    windows = [(r, k, 30.0 * k, 30.0 * k + 30.0) for r in (1, 2, 3) for k in range(20)]
    epochs = []
    for r in (1, 2):  # the third has none
        for o in range(6):
            a = rng.uniform(0, 500)
            epochs.append((r, o, f"e{o}", a, a + rng.choice([5.0, 40.0, 300.0])))
    skips = [(r, a, a + d) for r in (1, 3) for a, d in ((60.0, 30.0), (75.0, 45.0), (400.0, 3.0))]
    spikes = [(r, "a", rng.uniform(0, 600)) for r in (1, 2, 3) for _ in range(300)]
    return windows, epochs, skips, spikes


@pytest.mark.parametrize("cell", [7.0, 60.0, 10_000.0])
def test_tables_of_ranges(spark, ranges, cell):
    windows, epochs, skips, spikes = ranges
    w = spark.createDataFrame(windows, "recording_index int, window_index int, window_start_s double, window_end_s double")
    e = spark.createDataFrame(epochs, "recording_index int, ord int, epoch string, e_start double, e_end double")
    s = spark.createDataFrame(skips, "recording_index int, s_start double, s_end double")
    p = spark.createDataFrame(spikes, "recording_index int, channel string, t_s double")
    by = ["recording_index"]
    got = {(r["recording_index"], r["window_index"]): r["epoch"] for r in O.epoch_tags(w, e, [*by, "window_index"], by, cell).collect()}
    assert got == {(r, k): "|".join(x[2] for x in sorted(epochs, key=lambda x: x[1]) if x[0] == r and a < x[4] and b > x[3]) for r, k, a, b in windows}
    kept = {(r["recording_index"], r["window_index"]) for r in O.drop_skipped(w, s, by, cell).collect()}
    assert kept == {(r, k) for r, k, a, b in windows if not any(x[0] == r and a < x[2] and b > x[1] for x in skips)}
    rows = O.epoch_summary(p, p, e, s, ["recording_index", "channel"], by, cell).collect()
    want = {}
    for r, _, name, a, b in epochs:
        seconds = b - a - sum(max(min(b, y) - max(a, x), 0) for q, x, y in skips if q == r)
        n = sum(a <= t < b and not any(q == r and x <= t < y for q, x, y in skips) for o, _, t in spikes if o == r)
        if seconds > 0:
            want[r, name] = (n, pytest.approx(seconds / 60))
    assert {(r["recording_index"], r["epoch"]): (r["spike_count"], r["effective_duration_min"]) for r in rows} == want
    for one in (1, 2):  # stated lists give the same as tables of one recording
        here = O.epoch_summary(p.filter(F.col("recording_index") == one), p.filter(F.col("recording_index") == one), e.filter(F.col("recording_index") == one), s.filter(F.col("recording_index") == one), ["recording_index", "channel"]).collect()
        assert {(r["recording_index"], r["epoch"]): (r["spike_count"], r["effective_duration_min"]) for r in here} == {k: v for k, v in want.items() if k[0] == one}


def kept_by_hand(peaks, distance):
    kept = []
    for n, _ in sorted(peaks, key=lambda p: (p[1], p[0]), reverse=True):
        if all(abs(n - k) >= distance for k in kept):
            kept.append(n)
    return sorted(kept)


@pytest.mark.parametrize("block", [40, 1000])
def test_chains_over_many_blocks(spark, block):
    rng = random.Random(3)
    chains = [[(3 * i, float(i)) for i in range(2000)], [(3 * i, float(-i)) for i in range(500)], [(n, round(rng.random(), 2)) for n in sorted(rng.sample(range(6000), 2500))], [(7, 1.0)], [(n, 1.0) for n in range(0, 3000, 2)]]
    rows = [(k, "a", n, h) for k, c in enumerate(chains) for n, h in c]
    df = spark.createDataFrame(rows, "recording_index int, channel string, n long, height double").repartition(4)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup(f"chains-{block}", "suppression")
    got = collections.defaultdict(list)
    for r in K.suppress(df, 5, block).collect():
        got[r["recording_index"]].append(r["n"])
    jobs = len(tracker.getJobIdsForGroup(f"chains-{block}"))
    spark.sparkContext.setJobGroup("", "")
    assert {k: sorted(v) for k, v in got.items()} == {k: kept_by_hand(c, 5) for k, c in enumerate(chains)}
    assert jobs <= 30  # the longest chain reaches over 150 blocks


def test_train_autocorrelogram_over_blocks_of_bins(spark, monkeypatch):
    rng = np.random.default_rng(4)
    trains = {1: np.sort(rng.uniform(0, 30, 400)), 2: np.sort(np.r_[rng.uniform(0, 1, 50), rng.uniform(25, 26, 50)]), 3: np.array([1.0])}
    df = spark.createDataFrame([(k, "a", float(t)) for k, x in trains.items() for t in x], "recording_index int, channel string, t_s double")
    for bins in (16, 1 << 16):
        monkeypatch.setattr(K, "BINS", bins)
        got = {(r["recording_index"], round(r["lag_s"] / 0.1)): r["acg"] for r in K.train_autocorrelogram(df, 0.1, 12).collect()}
        want = {}
        for k, t in trains.items():
            if len(t) > 1:
                c = np.bincount(np.floor((t - t[0]) / 0.1).astype(int)).astype(float)
                c -= c.mean()
                want |= {(k, s * lag): float(c[: len(c) - lag] @ c[lag:]) for lag in range(13) for s in (1, -1)}
        assert got == pytest.approx(want, abs=1e-9)


def windows_with_parts(spark):
    rng = random.Random(5)
    rows = []
    for unit, group in (("u1", "A"), ("u2", "A"), ("u3", "B"), ("u4", "B")):
        labels = [("Baseline", "Baseline"), ("Stimulation", "-70 nA"), ("Post", "Post")] if group == "A" else [("Baseline", "Baseline"), ("Stimulation", "-90 nA"), ("Stimulation", "-70 nA"), ("Post", "Post")]
        for k, (phase, label) in enumerate(labels):
            for w in range(4):
                part = None if phase == "Baseline" else k if phase == "Stimulation" else k - 1
                half = None if phase != "Baseline" else S.FIRST if w < 2 else S.SECOND
                start = 100.0 * (k + (group == "A")) + 10 * w
                rows.append((unit, group, phase, label if phase == "Stimulation" else None, label if phase == "Post" else None, part, half, k, start, start + 10, w, unit, 1.0 + round(rng.random(), 3)))
    names = "unit string, grp string, phase string, stimulation_label_raw string, post_label_raw string, part_index int, baseline_half string, recording_index int, window_start_s double, window_end_s double, window_index int, channel string, firing_rate_hz double"
    return spark.createDataFrame(rows, names)


def test_categories_have_one_order_for_all_groups(spark):
    rows = S.pooled_changes(windows_with_parts(spark), "grp", ["unit"]).collect()
    order = {}
    for r in rows:
        order.setdefault(r["category"], set()).add(r["category_order"])
    assert all(len(x) == 1 for x in order.values())
    first = sorted(order, key=lambda c: min(order[c]))
    assert first[0] == "Baseline" and first.index("-90 nA") < first.index("Post 2") and {r["category"] for r in rows if r["group"] == "A"} == {"Baseline", "-70 nA", "Post 1"}


def test_comparisons_choose_what_is_tested(spark):
    w = windows_with_parts(spark)
    every = {(r["group"], r["category"]): r["mean"] for r in S.pooled_changes(w, "grp", ["unit"]).collect()}
    post = {(r["group"], r["category"]): r["mean"] for r in S.pooled_changes(w, "grp", ["unit"], "post").collect()}
    assert post == {k: v for k, v in every.items() if k[1].startswith("Post")} and post
    assert {c for _, c in {(r["group"], r["category"]) for r in S.pooled_changes(w, "grp", ["unit"], "baseline halves, current").collect()}} == {"Baseline", "-70 nA", "-90 nA"}
    with pytest.raises(ValueError):
        S.pooled_changes(w, "grp", ["unit"], "nothing")


def test_comparisons_choose_rows_of_the_part_tables(spark):
    from sparktrode.plans import stats

    table, rows = stats.tables(spark, "/root/testdata/sf0.001")
    phases = lambda df: {r["phase"] for r in df.select("phase").distinct().collect()}
    assert phases(S.part_summary(table, rows, stats.GROUP, "stim")) == {"Stimulation"}
    assert phases(S.unpaired_tests(table, stats.GROUP, "after, control")) == {"Baseline", "Post"}
    shown = {(r["kind"], r["phase"]) for r in S.plot_tables(table, rows, stats.GROUP, "post").select("kind", "phase").distinct().collect()}
    assert shown == {("frequency", "Baseline"), ("frequency", "Post"), ("percent", "Post")}
