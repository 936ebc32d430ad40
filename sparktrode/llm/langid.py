"""Language ID by n-gram filters with language bitmasks.

A bit-sliced Bloom filter holds the n-grams of all languages at once: each slot is a bitmask of
languages, and the masks of an n-gram's slots, and-ed, are all languages that contain it. For a
text, each language's bit is counted over its n-grams; the count is corrected by the language's
rate of false positives, and the largest decides.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, crc_mod, written

#: Characters in an n-gram; a word's n-grams include a space on either side.
SIZES = (2, 3, 4)
#: An n-gram belongs to a language if it makes up more than this share of the language's n-grams
#: of its size, so a language holds at most 1 / MIN_SHARE n-grams of a size; what lies below is
#: noise of names and slips.
MIN_SHARE = 2e-5
SLOTS = 1 << 20
HASHES = 3
#: Languages in one mask; more take further masks.
MASK_BITS = 63
HELD_OUT, FOLDS = 2, 4
UNDETERMINED = "und"
CHUNK = 1 << 21
COUNT_BITS = 22


@functools.cache
def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or a space for all that isn't a letter."""
    out = np.full(0x110000, 32, dtype=np.uint32)
    for c in range(0x110000):
        if 0xD800 <= c < 0xE000:
            continue
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def normalised(text: str) -> np.ndarray:
    """Lower-case letters as code points, other runs as one space, with spaces at both ends."""
    points = _letters()[np.frombuffer((" " + text + " ").encode("utf-32-le", "surrogatepass"), dtype="<u4")]
    space = points == 32
    return points[~(space & np.r_[False, space[:-1]])]


def grams(points: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of the n-grams that hold no space but at their ends."""
    n = len(points) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.full(n, size, dtype=np.uint64)
    for k in range(size):
        h = (h ^ points[k : k + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    inner = np.ones(n, dtype=bool)
    for k in range(1, size - 1):
        inner &= points[k : k + n] != 32
    if size == 2:
        inner &= (points[:n] != 32) | (points[1 : 1 + n] != 32)
    return h[inner]


def slots(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th slot of each n-gram."""
    return ((h * np.uint64(2 * k + 0xD1B54A32D192ED03 | 1)) >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


@dataclass(frozen=True)
class Filter:
    """masks has a row for each slot and a column for each MASK_BITS languages."""

    languages: list[str]
    masks: np.ndarray

    @functools.cached_property
    def false_rate(self) -> np.ndarray:
        return (self.popcounts(self.masks) / SLOTS) ** HASHES

    def popcounts(self, masks: np.ndarray) -> np.ndarray:
        """How many of the masks hold each language: its bits, sliced out and packed, counted."""
        slices = (np.packbits((masks[:, b // MASK_BITS] >> np.uint64(b % MASK_BITS)) & np.uint64(1) != 0) for b in range(len(self.languages)))
        return np.array([np.bitwise_count(s).sum(dtype=np.int64) for s in slices], dtype=float)

    def languages_of(self, h: np.ndarray) -> np.ndarray:
        """Bitmasks of all languages that contain each n-gram."""
        out = self.masks[slots(h, 0)]
        for k in range(1, HASHES):
            out &= self.masks[slots(h, k)]
        return out

    def decide(self, text: str | None) -> tuple[str, float]:
        points = normalised(text or "")
        if not (points != 32).any() or not self.languages:
            return UNDETERMINED, 0.0
        hits, total = np.zeros(len(self.languages)), 0
        for at in range(0, len(points), CHUNK):
            part = points[at : at + CHUNK + max(SIZES) - 1]
            for size in SIZES:
                masks = self.languages_of(grams(part[: CHUNK + size - 1], size))
                total += len(masks)
                hits += self.popcounts(masks)
        true = np.maximum(hits - total * self.false_rate, 0) / np.maximum(1 - self.false_rate, 1e-9)
        best = int(np.argmax(true))
        return self.languages[best], float(true[best] / true.sum()) if true.sum() else 0.0


def _count(languages: list[str]):
    """n-gram counts of each language: kept in a table of bounded size, and sent on when full."""
    number = {x: i for i, x in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[np.ndarray]] = {}
        size_held = 0

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, size), parts in held.items():
                h, c = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_pydict({"lang": pa.array(np.full(len(h), lang), pa.int32()), "size": pa.array(np.full(len(h), size), pa.int32()), "gram": pa.array(h.view(np.int64)), "n": pa.array(c, pa.int64())})

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                points = normalised(text)
                for size in SIZES:
                    h = grams(points, size)
                    held.setdefault((number[lang], size), []).append(h)
                    size_held += len(h)
                if size_held > 1 << COUNT_BITS:
                    yield from out()
                    held, size_held = {}, 0
        yield from out()

    return count


def fit(docs: DataFrame) -> Filter:
    """A filter of the n-grams of all texts with a language that are not held out."""
    bounded_batches(docs.sparkSession)
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod("doc_id", FOLDS) != HELD_OUT)).select("lang", "text")
    languages = [r["lang"] for r in rows.select("lang").distinct().orderBy("lang").collect()]  # a few names
    counts = rows.mapInArrow(_count(languages), "lang int, size int, gram long, n long").groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))
    counts = written(counts, "ngrams")
    totals = counts.groupBy("lang", "size").agg(F.sum("n").alias("total"))
    shares = counts.join(F.broadcast(totals), ["lang", "size"]).withColumn("share", F.col("n") / F.col("total"))  # a row for each language and size
    kept = shares.filter(F.col("share") > MIN_SHARE).select("gram", F.floor(F.col("lang") / MASK_BITS).cast("int").alias("word"), F.expr(f"shiftleft(1L, lang % {MASK_BITS})").alias("bit"))
    masks = np.zeros((SLOTS, max(1, -(-len(languages) // MASK_BITS))), dtype=np.uint64)
    for batch in kept.groupBy("gram", "word").agg(F.bit_or("bit").alias("mask")).toArrow().to_batches():  # bounded by MIN_SHARE
        h, mask, word = batch.column("gram").to_numpy().view(np.uint64), batch.column("mask").to_numpy().view(np.uint64), batch.column("word").to_numpy()
        for k in range(HASHES):
            np.bitwise_or.at(masks, (slots(h, k), word), mask)
    return Filter(languages, masks)


def decision_column(found: Filter, text: str = "text") -> Column:
    """struct(lang_pred, score) of a whole text."""

    def decide(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([found.decide(x) for x in s], columns=["lang_pred", "score"])

    return F.pandas_udf(decide, "lang_pred string, score double")(F.col(text))


def predict_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row.

    Null and empty texts and texts without a letter are 'und' with score 0, as are all if no
    language can be learned. A tie goes to the first language by name. Null ids count as the text
    'null' for the fold; repeated rows get equal results; other columns are not read. An empty
    table gives an empty result.
    """
    found = fit(docs)
    out = docs.select("doc_id", (crc_mod("doc_id", FOLDS) == HELD_OUT).alias("held_out"), decision_column(found).alias("d"))
    return out.select("doc_id", "held_out", "d.lang_pred", "d.score")
