"""The classifiers' parts against explicit sums, whole scores by hand, and odd rows of the pipeline."""

import collections
import math
import random
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparktrode.llm import components, decontaminate, labelled, quality, toxicity

SF = "/root/testdata/sf0.001"


def test_margins_equal_sums_over_explicit_pairs():
    rng = np.random.default_rng(0)
    weights, factors, bias = rng.normal(size=30), rng.normal(size=(30, 4)) / 3, 0.2
    rows = [sorted(rng.choice(30, rng.integers(0, 9), replace=False).tolist()) for _ in range(50)] + [[]]
    got = toxicity.margins(*toxicity._flat(rows), bias, weights, factors)
    want = [bias + sum(weights[i] for i in r) + sum(float(factors[i] @ factors[j]) for k, i in enumerate(r) for j in r[k + 1 :]) for r in rows]
    assert got == pytest.approx(np.clip(want, -30, 30))


def test_chosen_terms_equal_counted_chi_squared(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(300):
        y = float(rng.random() < 0.4)
        terms = {t for t in range(40) if rng.random() < (0.2 + (0.5 if t % 7 == 0 and y else 0.0) + (0.3 if t % 11 == 0 and not y else 0.0))}
        rows.append((sorted(terms | ({99} if rng.random() < 0.008 else set())), y))
    got = toxicity.choose_terms(spark.createDataFrame(rows, "terms array<long>, y double").repartition(5), terms=8)
    n, pos = len(rows), sum(y for _, y in rows)
    gains = {}
    for t in {t for x, _ in rows for t in x}:
        c = sum(t in x for x, _ in rows)
        table = [[sum(t in x and y == k for x, y in rows), sum(t not in x and y == k for x, y in rows)] for k in (0.0, 1.0)]
        if toxicity.MIN_DOCS <= c < n:
            gains[t] = sum((table[k][j] - e) ** 2 / e for k, share in ((0, (n - pos) / n), (1, pos / n)) for j, e in ((0, c * share), (1, (n - c) * share)))
    want = sorted((t for t in gains if gains[t] >= toxicity.MIN_GAIN), key=lambda t: (-gains[t], t))[:8]
    assert got == want and len(want) > 4
    assert toxicity.choose_terms(spark.createDataFrame([([1], 1.0)] * 5, "terms array<long>, y double")) == []


def test_toxic_score_by_hand():
    words = {"bad": 0, "group": 1}
    model = toxicity.Model({zlib.crc32(w.encode()): k for w, k in words.items()}, -1.0, np.array([0.5, 0.25]), np.array([[1.0, 2.0], [0.5, 1.0]]))
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    got = model.score(["Bad GROUP, bad!", "group", "", "nothing here"])
    assert got.tolist() == pytest.approx([sigmoid(-1 + 0.75 + 2.5), sigmoid(-0.75), sigmoid(-1), sigmoid(-1)])


def test_statistics_by_hand():
    text = "One one TWO two! 12 |\n\nOne one TWO two! 12 |\nab.c@d [x] (y)"
    words = text.split()
    n, counts, lines = len(words), collections.Counter(words), [x for x in text.split("\n") if x.strip()]
    letters = sum(c not in " \n\t0123456789" + quality.SYMBOLS for c in text)
    tally = lambda marks: sum(c in marks for c in text) / n
    want = [
        math.log1p(len(text)), math.log1p(n), (len(text) - n) / n, math.log1p(max(len(w) for w in words)), sum(w.isupper() for w in words) / n, sum(w.istitle() for w in words) / n, letters / len(text),
        tally("0123456789"), tally("!?"), tally("|"), tally("*$#%&"), tally(".,"), tally("@=/_"), tally("<>[]{}\\"), len(counts) / n, max(counts.values()) / n,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, math.log1p(len(lines)), 1 - len(set(lines)) / len(lines), n / len(lines) / (1 + n / len(lines)),
        sum(c for w, c in counts.items() if len(w) <= 3) / n, sum(c for c in counts.values() if c == 1) / n,
    ]
    assert quality.statistics(text) == pytest.approx(want) and len(want) == quality.STATISTICS
    assert quality.statistics("") == quality.statistics(" \n") == [0.0] * quality.STATISTICS


def test_quality_score_by_hand():
    """A score from the model's own numbers, feature by feature; beyond the knots the ends hold."""
    rng = np.random.default_rng(3)
    mean, scale, weights = rng.normal(size=quality.STATISTICS), rng.uniform(0.5, 2, quality.STATISTICS), rng.normal(size=quality.COMPONENTS + 1)
    knots = np.array([-1.0, 0.0, 0.0, 2.0]), np.array([0.1, 0.1, 0.6, 0.9])
    stats = quality.statistics("Some words, and some MORE words.\nA line")
    draw = np.random.default_rng(quality.SEED)
    w, b = draw.normal(0, 1 / quality.BANDWIDTH, (quality.STATISTICS, quality.COMPONENTS)), draw.uniform(0, 2 * np.pi, quality.COMPONENTS)
    z = [min(max((s - m) / d, -6), 6) for s, m, d in zip(stats, mean, scale, strict=True)]
    raw = weights[-1] + sum(weights[k] * math.cos(sum(z[i] * w[i, k] for i in range(len(z))) + b[k]) * math.sqrt(2 / quality.COMPONENTS) for k in range(quality.COMPONENTS))
    model = quality.Model(mean, scale, weights, knots)
    assert model.raw(np.array([stats]))[0] == pytest.approx(raw)
    level = 0.1 if raw < 0 else min(0.6 + 0.3 * raw / 2, 0.9)
    assert model.score(np.array([stats]))[0] == pytest.approx(level)


def test_scores_at_the_threshold_count(spark, monkeypatch):
    docs, labels = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(quality, "score_column", lambda model, text="text": F.lit(quality.THRESHOLD))
    monkeypatch.setattr(quality, "fit", lambda docs, labels: quality.Model(np.zeros(1), np.ones(1), np.zeros(1), (np.zeros(1), np.zeros(1))))
    monkeypatch.setattr(toxicity, "score_column", lambda model, text="text": F.lit(toxicity.THRESHOLD))
    assert {r["predicted"] for r in quality.score_documents(docs, labels).collect()} == {1} and quality.keep_good(docs, labels).count() == 2
    assert {r["predicted"] for r in toxicity.score_documents(docs, labels).collect()} == {1} and toxicity.keep_clean(docs, labels).count() == 0


def test_training_rows_are_one_an_id(spark):
    """Repeated ids in the documents don't multiply the sample."""
    docs = spark.createDataFrame([(i % 10, f"text {i % 37}", "x") for i in range(4000)] + [(None, "t", "x"), (3, None, "x")], "doc_id long, text string, y string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(1, 1), (1, 1), (1, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    rows = labelled.training_rows(docs, labels, "toxic", F.lit(True)).collect()
    assert sorted(r["labelled_id"] for r in rows) == list(range(10)) and {r["labelled_id"]: r["y"] for r in rows} == {i: float(i % 2) for i in range(10)}
    assert sorted(map(tuple, rows)) == sorted(map(tuple, labelled.training_rows(docs.repartition(7), labels, "toxic", F.lit(True)).collect()))
    assert len(labelled.training_rows(docs, labels, "toxic", F.lit(True), 4).collect()) <= 4


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls, repeated and missing ids, ties and an empty table go through all stages."""
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    good = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1 and toxic = 0"), "doc_id").orderBy("doc_id").limit(12).collect()]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(good)] + [(None, good[0], None, None, None), (3, good[3], "en", "s", 1), (3, good[4] + " x", "en", "s", 1), (50, None, None, None, None), (51, "", "en", "s", 0), (52, "é " * 30000, "en", "s", 1)]
    for name, data in (("rows", rows), ("none", [])):
        at = str(tmp_path / name)
        spark.createDataFrame(data, schema).write.parquet(f"{at}/documents.parquet")
        for table in ("labels", "benchmark"):
            spark.read.parquet(f"{SF}/{table}.parquet").write.parquet(f"{at}/{table}.parquet")
        out = corpus_pipeline.run(spark, at)
        assert {"ids", "n_tokens", "doc_id", "text", "lang", "source", "n_chars"} == set(out.columns)
        kept = out.collect()
        texts = [r["text"] for r in kept if r["text"]]
        assert len(texts) == len(set(texts)) <= len(data)


@pytest.mark.parametrize("most", [1, 2, 32])
def test_sums_of_runs_equal_reduceat(most):
    rng = np.random.default_rng(4)
    if most == 1:
        lengths = np.ones(50, int)
    else:
        lengths = np.r_[rng.integers(1, 40, 60), 1, most, most + 1, 3000]
    rows, index, starts = rng.normal(size=(200, 5)), rng.integers(0, 200, lengths.sum()), np.cumsum(lengths) - lengths
    np.testing.assert_allclose(decontaminate._sums(rows, index, starts, max(most, 2)), np.add.reduceat(rows[index], starts, axis=0), atol=1e-9)


def test_joined_windows_equal_sums_of_rows():
    room, rng = decontaminate.Room(), np.random.default_rng(6)
    for n in (48, 96, 12):
        rows = rng.normal(size=(n, 3)).astype(np.float32)
        half = decontaminate._rolled(decontaminate._stepped({1: rows}, 2, room), 8, room, "half")  # 16 words, 2 apart
        got = decontaminate._joined(half, 2, 8, room, "whole")
        assert len(got) == n // 4
        for k in range(len(got)):
            if 4 * k + 32 <= n:
                np.testing.assert_allclose(got[k], rows[4 * k : 4 * k + 32].sum(0), atol=1e-5)


def test_words_of_an_item_bound_the_common_subsequence(monkeypatch):
    """Regions that are dropped by their count of an item's words hold no item; counted in lots of items too."""
    rng = random.Random(9)
    items = [decontaminate.Item(str(k), [rng.randrange(40) + 1 for _ in range(rng.choice([9, 20, 70]))]) for k in range(7)]
    latent = decontaminate.Latent(np.ones((decontaminate.TERMS, 4), np.float32), np.zeros(decontaminate.TERMS))
    for many in (3, 256):
        monkeypatch.setattr(decontaminate, "COUNTED", many)
        look = decontaminate.Search(latent, items)
        text = np.array([rng.randrange(len(look.words)) for _ in range(700)])
        regions = [(rng.randrange(7), *sorted((rng.randrange(701), rng.randrange(701)))) for _ in range(60)] + [(2, 5, 5), (6, 0, 700)]
        item, begin, end = (np.array(x) for x in zip(*regions, strict=True))
        got = look._in_item(item, begin, end, text)
        for k, (i, a, b) in enumerate(regions):
            own = set(items[i].words)
            wide = text[a // 4 * 4 : -(-b // 4) * 4]
            assert got[k] == sum(int(look.words[w]) in own for w in wide)
            assert got[k] >= decontaminate.common_subsequence(decontaminate.masks(items[i].words), len(items[i].words), look.words[text[a:b]].tolist())


@pytest.mark.parametrize("many", [8, 12, 7, 1])
def test_rolled_sums_in_arrays_used_again(many):
    room, rng = decontaminate.Room(), np.random.default_rng(2)
    for n in (40, 5, 90):
        rows = rng.normal(size=(n, 3)).astype(np.float32)
        got = decontaminate._rolled(rows, many, room)
        want = [rows[k : k + many].sum(0) if k + many <= n else np.zeros(3) for k in range(n)]
        np.testing.assert_allclose(got, want, atol=1e-5)


def test_round_of_components_has_few_exchanges(spark, monkeypatch):
    """A round's plan, whose tasks the driver keeps account of, deals its links a few times only (15 exchanges before, 4 now)."""
    plans, written = [], components.written

    def seen(df, tag):
        plan = df._jdf.queryExecution().executedPlan().toString()
        if "CollectMetrics" in plan:
            plans.append(plan.count("Exchange hashpartitioning"))
        return written(df, tag)

    monkeypatch.setattr(components, "written", seen)
    rng = random.Random(21)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(330)] + [(7, 7), (None, 3), (500, None)]
    links += [(1000, k) for k in range(1001, 1040)]  # a hub
    found = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    least = {k: k for u, v in links if u is not None and v is not None and u != v for k in (u, v)}
    for _ in range(500):
        for u, v in links:
            if u in least and v in least and u != v:
                least[u] = least[v] = min(least[u], least[v])
    assert found == least
    assert 0 < max(plans) <= 6


def test_factors_equal_numpys_in_little_memory():
    """The driver's step of the SVD: the same factors but for signs, with few arrays of the product's size."""
    rng = np.random.default_rng(3)
    shape = decontaminate.TERMS, decontaminate.RANK + decontaminate.OVERSAMPLE
    texts = rng.normal(size=(300, shape[0])) * (rng.random((300, shape[0])) < 0.01)
    idf, sketch = rng.uniform(1, 5, shape[0]).astype(np.float32), rng.normal(size=shape).astype(np.float32)
    product = texts.T @ (texts @ sketch)
    whole = product * idf[:, None]
    values, vectors = np.linalg.eigh((lambda x: (x + x.T) / 2)(sketch.T.astype(float) @ whole))
    keep = values > 1e-9 * values.max()
    expected = np.linalg.svd(whole @ vectors[:, keep] / np.sqrt(values[keep]), full_matrices=False)[0][:, decontaminate.SKIPPED : decontaminate.RANK] * idf[:, None]
    size = product.nbytes
    tracemalloc.start()
    got = decontaminate.factors_of(product, idf, sketch)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.dtype == np.float32 and np.abs(np.abs(got) - np.abs(expected)).max() < 1e-5
    assert most < 1.7 * size
