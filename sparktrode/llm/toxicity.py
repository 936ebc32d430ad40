"""Toxicity: a factorisation machine over hashed terms.

Beside a weight for each term it learns a factor vector for each, and so the weight of every pair
of terms that a document holds together. Terms are hashed to 32 bits; the ones whose presence
tells most about the label are the features. Each partition trains on its own rows; after each
round the parameters are averaged.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, crc_mod, written
from .labelled import LABEL_SAMPLE, training_rows

#: Features of the model: terms of the largest chi-squared value, MIN_GAIN at least, in at least MIN_DOCS documents.
TERMS = 2048
MIN_DOCS = 4
MIN_GAIN = 10.8
FACTORS = 8
ROUNDS, STEPS, BATCH = 6, 80, 64
RATE, L2, L2_FACTORS = 0.15, 1e-4, 1e-4
SHARDS = 6
PREFIXES = (4, 5)
SEED = 11
THRESHOLD = 0.5
HELD_OUT, FOLDS = 0, 5
TERM = re.compile(r"[^\W_]+")


def hashed_terms(text: str) -> list[int]:
    """Distinct terms in lower case and the first letters of longer ones, as 32-bit hashes.

    The first letters let an inflected insult count that training has not met.
    """
    words = set(TERM.findall(text.lower()))
    starts = {"^" + w[:k] for k in PREFIXES for w in words if len(w) > k}
    return [zlib.crc32(w.encode()) for w in words | starts]


@dataclass(frozen=True)
class Model:
    terms: dict[int, int]
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def indices(self, text: str) -> list[int]:
        find = self.terms.get
        return [i for i in map(find, hashed_terms(text)) if i is not None]

    def score(self, texts: list[str]) -> np.ndarray:
        found = [self.indices(x) for x in texts]
        return 1 / (1 + np.exp(-margins(*_flat(found), self.bias, self.weights, self.factors)))


def _flat(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All indices, and the row of each."""
    return np.array([i for r in rows for i in r], dtype=np.int64), np.repeat(np.arange(len(rows)), [len(r) for r in rows]), len(rows)


def _by_row(values: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    if values.ndim == 1:
        return np.bincount(row, values, n)
    return np.stack([np.bincount(row, values[:, f], n) for f in range(values.shape[1])], axis=1)


def margins(index: np.ndarray, row: np.ndarray, n: int, bias: float, weights: np.ndarray, factors: np.ndarray) -> np.ndarray:
    v = factors[index]
    s = _by_row(v, row, n)
    pairs = 0.5 * ((s**2).sum(1) - np.bincount(row, (v**2).sum(1), n))
    return np.clip(bias + np.bincount(row, weights[index], n) + pairs, -30, 30)


def _train(bias: float, weights: np.ndarray, factors: np.ndarray, seed: int):
    """Adam on the logistic loss over one partition's rows, for a fixed number of steps whatever
    their number; yields the parameters and the row count. seed is the round."""

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, y = [], []
        for batch in batches:
            rows += batch.column("terms").to_pylist()
            y += batch.column("y").to_pylist()
        rng, n_terms = np.random.default_rng(seed), len(weights)
        p = np.concatenate([[bias], weights, factors.ravel()])
        m, s, t = np.zeros_like(p), np.zeros_like(p), 0
        labels = np.array(y)
        v_at, order = 1 + n_terms, np.zeros(0, dtype=int)
        while len(rows) and t < STEPS:
            if len(order) < min(BATCH, len(rows)):
                order = rng.permutation(len(rows))
            take, order = order[:BATCH], order[BATCH:]
            index, row, n = _flat([rows[i] for i in take])
            factors_now = p[v_at:].reshape(n_terms, FACTORS)
            err = (1 / (1 + np.exp(-margins(index, row, n, p[0], p[1:v_at], factors_now))) - labels[take]) / n
            v = factors_now[index]
            slope = err[row][:, None] * (_by_row(v, row, n)[row] - v)
            g = np.concatenate([[err.sum()], np.bincount(index, err[row], n_terms), _by_row(slope, index, n_terms).ravel()])
            g[1:v_at] += L2 * p[1:v_at]
            g[v_at:] += L2_FACTORS * p[v_at:]
            t += 1
            m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
            p = p - RATE / (1 + 0.3 * seed) * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
        if len(rows):
            yield pa.RecordBatch.from_pydict({"n": [len(rows)], "p": pa.array([p.tobytes()], pa.binary())})

    return train


def choose_terms(rows: DataFrame, terms: int = TERMS, min_docs: int = MIN_DOCS) -> list[int]:
    """Hashed terms of the largest chi-squared value of presence against the label."""
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos")).first()
    n, pos = float(total["n"]), float(total["pos"] or 0)
    if not n or pos in (0, n):
        return []
    counts = rows.select(F.explode("terms").alias("term"), "y").groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("c"), F.sum("y").alias("a"))
    expected = F.col("c") * pos / n
    gain = (F.col("a") - expected) ** 2 * n * n / (F.col("c") * (n - F.col("c") + 1e-9) * pos * (n - pos) / n)
    best = counts.filter((F.col("c") >= min_docs) & (F.col("c") < n) & (gain >= MIN_GAIN)).orderBy(gain.desc(), "term").limit(terms)
    return [r["term"] for r in best.select("term").collect()]


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", limit: int = LABEL_SAMPLE) -> Model | None:
    """None where the labelled texts don't hold both labels."""
    bounded_batches(docs.sparkSession)
    hashed = F.pandas_udf(lambda s: s.map(hashed_terms), "array<long>")
    rows = training_rows(docs, labels, label, crc_mod("doc_id", FOLDS) != HELD_OUT, limit)
    rows = written(rows.select(hashed("text").alias("terms"), "y", F.xxhash64("labelled_id", "text").alias("deal")), "toxicity_rows")
    chosen = choose_terms(rows)
    if not chosen:
        return None
    terms = {t: i for i, t in enumerate(chosen)}
    indexed = F.pandas_udf(lambda s: s.map(lambda x: [terms[t] for t in x.tolist() if t in terms]), "array<long>")
    # dealt by id and text, so that copies of a text don't meet in one task
    train = written(rows.select(indexed("terms").alias("terms"), "y", "deal").repartition(SHARDS, "deal").drop("deal"), "toxicity_train")
    rng = np.random.default_rng(SEED)
    p = np.concatenate([[0.0], np.zeros(len(chosen)), rng.normal(0, 0.01, len(chosen) * FACTORS)])
    for step in range(ROUNDS):
        split = lambda p: (float(p[0]), p[1 : 1 + len(chosen)], p[1 + len(chosen) :].reshape(-1, FACTORS))
        parts = train.mapInArrow(_train(*split(p), step), "n long, p binary").collect()
        p = sum(r["n"] * np.frombuffer(r["p"]) for r in parts) / sum(r["n"] for r in parts)
    return Model(terms, *split(p))


def score_column(model: Model | None, text: str = "text") -> Column:
    """The score of a whole text; null counts as empty. Without a model it is 0."""
    if model is None:
        return F.lit(0.0)
    return F.pandas_udf(lambda s: pd.Series(model.score([x or "" for x in s]), dtype=float), "double")(F.col(text))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row.

    Null texts count as empty. Null ids count as the text 'null' for the fold. Repeated rows get
    equal scores; other columns are not read. Unless both labels occur all scores are 0: nothing
    tells toxic texts, so none is called toxic. An empty table gives an empty result.
    """
    model = fit(docs, labels)
    scored = docs.select("doc_id", (crc_mod("doc_id", FOLDS) == HELD_OUT).alias("held_out"), score_column(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows whose score is below the threshold, with the columns of docs."""
    model = fit(docs, labels)
    return docs.withColumn("__score", score_column(model)).filter(F.col("__score") < THRESHOLD).drop("__score")
