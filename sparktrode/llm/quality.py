"""Quality classifier: random Fourier features of document statistics, ridge, isotonic scores.

Statistics of whole texts are standardised and mapped by random cosines, which approximate a
Gaussian kernel. Each partition sums its part of the normal equations; the sums are added in a
tree. The ridge scores are calibrated by isotonic regression on binned training scores.
"""

from __future__ import annotations

import math
import operator
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, crc_mod, written
from .labelled import LABEL_SAMPLE, training_rows

COMPONENTS = 256
BANDWIDTH = 4.0
RIDGE = 1e-2
SEED = 7
#: Ridge scores are binned to this width before the isotonic fit, so it holds few points.
BIN = 0.002
THRESHOLD = 0.7
HELD_OUT, FOLDS = 2, 4
SYMBOLS = "!?|*$#%&.,;:-()\"'<>[]{}/\\@=+_~"
STATISTICS = 22


def statistics(text: str) -> list[float]:
    """Ratios and counts of a whole text; all zeros for an empty one."""
    words = text.split()
    if not words:
        return [0.0] * STATISTICS
    n, chars = len(words), max(1, len(text))
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    letters = len(text) - sum(map(text.count, " \n\t0123456789" + SYMBOLS))
    upper = sum(map(str.isupper, words))
    share = lambda marks: sum(map(text.count, marks)) / n
    return [
        math.log1p(len(text)),
        math.log1p(n),
        (chars - n) / n,
        math.log1p(max(map(len, words))),
        upper / n,
        sum(map(str.istitle, words)) / n,
        letters / chars,
        share("0123456789"),
        share("!?"),
        share("|"),
        share("*$#%&"),
        share(".,"),
        share("@=/_"),
        share("<>[]{}\\"),
        len(counts) / n,
        max(counts.values()) / n,
        sum(map(operator.eq, words, words[1:])) / n,
        math.log1p(len(lines)),
        1 - len(set(lines)) / len(lines),
        n / len(lines) / (1 + n / len(lines)),
        sum(c for w, c in counts.items() if len(w) <= 3) / n,
        sum(c for w, c in counts.items() if c == 1) / n,
    ]


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: tuple[np.ndarray, np.ndarray]

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return features((stats - self.mean) / self.scale) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), *self.knots), 0.0, 1.0)


def features(z: np.ndarray) -> np.ndarray:
    """Random Fourier features of standardised statistics, and a constant."""
    rng = np.random.default_rng(SEED)
    w, b = rng.normal(0, 1 / BANDWIDTH, (z.shape[1], COMPONENTS)), rng.uniform(0, 2 * np.pi, COMPONENTS)
    out = np.cos(np.clip(z, -6, 6) @ w + b) * math.sqrt(2 / COMPONENTS)
    return np.hstack([out, np.ones((len(z), 1))])


def _sums(model: Model | None):
    size = COMPONENTS + 1

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        for batch in batches:
            stats = np.array(batch.column("stats").to_pylist(), dtype=float).reshape(batch.num_rows, -1)
            if len(stats):
                f = features((stats - model.mean) / model.scale)
                total += f.T @ np.hstack([f, batch.column("y").to_numpy()[:, None]])
        yield pa.RecordBatch.from_pydict({"part": pa.array([total.tobytes()], pa.binary())})

    return partial


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = 0
    for batch in batches:
        for x in batch.column("part").to_pylist():
            total = total + np.frombuffer(x)
    if not isinstance(total, int):
        yield pa.RecordBatch.from_pydict({"part": pa.array([total.tobytes()], pa.binary())})


def normal_equations(rows: DataFrame, model: Model, fan_in: int = 16) -> np.ndarray:
    """Sum over partitions of F'[F y], added in a tree, so the driver gets few matrices."""
    parts = rows.mapInArrow(_sums(model), "part binary")
    n = rows.rdd.getNumPartitions()
    while n > fan_in:
        n = -(-n // fan_in)
        parts = parts.repartition(n).mapInArrow(_added, "part binary")
    size = COMPONENTS + 1
    return sum((np.frombuffer(r["part"]).reshape(size, size + 1) for r in parts.toLocalIterator()), np.zeros((size, size + 1)))


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; the knots of a non-decreasing function."""
    blocks: list[list[float]] = []  # mean of y, rows, first x, last x
    for xi, yi, ni in zip(x, y, n, strict=True):
        blocks.append([yi, ni, xi, xi])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2], b[3]])
    return np.array([v for b in blocks for v in (b[2], b[3])]), np.array([v for b in blocks for v in (b[0], b[0])])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = LABEL_SAMPLE) -> Model | None:
    """None where no labelled document has a text."""
    bounded_batches(docs.sparkSession)
    stats_of = F.pandas_udf(lambda s: s.map(statistics), "array<double>")
    rows = training_rows(docs, labels, label, crc_mod("doc_id", FOLDS) != HELD_OUT, limit)
    rows = written(rows.select(stats_of("text").alias("stats"), "y"), "quality_rows")
    moments = rows.agg(F.count(F.lit(1)), *[f(F.col("stats")[i]) for i in range(STATISTICS) for f in (F.avg, F.stddev_pop)]).first()
    if not moments[0]:
        return None
    model = Model(np.array(moments[1::2], float), np.maximum(np.array(moments[2::2], float), 1e-6), np.zeros(COMPONENTS + 1), (np.array([0.0]), np.array([0.0])))
    both = normal_equations(rows, model)
    penalty = RIDGE * np.eye(COMPONENTS + 1) * moments[0] / COMPONENTS
    penalty[-1, -1] = 0
    model = Model(model.mean, model.scale, np.linalg.lstsq(both[:, :-1] + penalty, both[:, -1], rcond=None)[0], model.knots)
    raw = F.pandas_udf(lambda s: pd.Series(model.raw(np.array(s.tolist(), dtype=float).reshape(len(s), -1))), "double")
    bins = rows.select(F.floor(raw("stats") / BIN).alias("bin"), "y").groupBy("bin").agg(F.avg("y").alias("y"), F.count(F.lit(1)).alias("n")).orderBy("bin").collect()
    at = np.array([(r["bin"] + 0.5) * BIN for r in bins])
    return Model(model.mean, model.scale, model.weights, isotonic(at, np.array([r["y"] for r in bins]), np.array([r["n"] for r in bins])))


def score_column(model: Model | None, text: str = "text") -> Column:
    """The score of a whole text; null counts as empty. Without a model it is 0.5."""
    if model is None:
        return F.lit(0.5)

    def score(s: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([statistics(x or "") for x in s], dtype=float).reshape(len(s), STATISTICS)))

    return F.pandas_udf(score, "double")(F.col(text))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row.

    Null texts count as empty, which have a score too. Null ids count as the text 'null' for the
    fold. Repeated rows get equal scores; other columns are not read. Without any labelled text
    all scores are 0.5, a score that says nothing; an empty table gives an empty result.
    """
    model = fit(docs, labels)
    scored = docs.select("doc_id", (crc_mod("doc_id", FOLDS) == HELD_OUT).alias("held_out"), score_column(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows whose score reaches the threshold, with the columns of docs; all without a model."""
    model = fit(docs, labels)
    return docs if model is None else docs.withColumn("__score", score_column(model)).filter(F.col("__score") >= THRESHOLD).drop("__score")
