"""Collocations: frequent phrases of two to four words whose parts seldom stand alone.

Rabin-Karp fingerprints: prefix polynomials over the words of a lot of texts hash all its n-grams.
Buckets by fingerprint add up the lots' counts and tell each lot which of its fingerprints are
frequent: first words and pairs, then the longer phrases all of whose pairs are. A fingerprint's
pointer is its place in the lot; where one is frequent in the corpus, the lot compares all places
that share it with the words there, spells the phrase out once and sends it with its count. So
collisions only cost work: the counts that stay are those of phrases, and only frequent ones are
ever spelled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import written
from .lots import Lot, buckets_for, by_bucket, each_lot, lots, pack, total_bytes, unpack, with_replies
from .wordhash import _powers, hash_runs, mixed, runs

LONGEST = 4
MIN_COUNT = 30
TOP = 2000
#: Dropped where a longer candidate that holds it has so many hundredths of its count.
COVERED = 80
#: Scores are whole numbers: this times the count by the counts of both parts.
SCALE = 2_000_000
BREAKS = [*map(ord, ".,;:!?"), *range(0x0A, 0x0E)]
BLANKS = [0x20, 0x09]


def _letters() -> np.ndarray:
    """For each byte itself with A-Z in lower case and 1 added, or 0 between words."""
    out = np.arange(1, 257, dtype=np.uint64)
    out[ord("A") : ord("Z") + 1] += 32
    out[[*BREAKS, *BLANKS]] = 0
    return out


class Words:
    """The words of a lot: where each is in its text, its hash, piece and language."""

    def __init__(self, lot: Lot) -> None:
        letters, breaks = _letters(), np.isin(np.arange(256), BREAKS)
        first, end, hashes, pieces, docs = ([np.zeros(0, t)] for t in (np.int64, np.int64, np.uint64, np.int64, np.int64))
        self.lot, base = lot, 0
        for i, j in lot.pieces(1 << 18):
            at, lengths = lot.starts[i], np.diff(lot.starts[i : j + 1])
            raw = lot.data[at : lot.starts[j]]
            shift = np.repeat(np.arange(j - i), lengths)  # a break after each text
            line = np.full(len(raw) + j - i, BREAKS[-1], np.uint8)
            line[np.arange(len(raw)) + shift] = raw
            a, b = runs(letters[line])
            hashes.append(hash_runs(letters[line], a, b))
            doc = np.searchsorted(np.cumsum(lengths + 1), a, side="right")
            first.append(a - doc + at)
            end.append(b - doc + at)
            docs.append(doc + i)
            piece = np.cumsum(breaks[line])
            pieces.append(piece[a] + base)
            base += int(piece[-1]) + 1
        self.first, self.end, self.hashes, self.pieces, self.docs = (np.concatenate(x) for x in (first, end, hashes, pieces, docs))
        names, codes = np.unique(lot.extra.astype(str), return_inverse=True) if len(lot.ids) else (np.array([], dtype=str), np.zeros(0, int))
        self.languages, self.language = names, codes[self.docs]
        seeds = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in names], dtype=np.uint64)
        self.seed = seeds[self.language] if len(names) else np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            up, self.down = _powers(1 << max(12, len(self.hashes).bit_length()))
            self.sums = np.r_[np.uint64(0), np.cumsum(self.hashes * up[: len(self.hashes)], dtype=np.uint64)]

    def places(self, n: int) -> np.ndarray:
        """Where phrases of n words start."""
        k = len(self.pieces) - n + 1
        return np.flatnonzero(self.pieces[: max(k, 0)] == self.pieces[n - 1 :][: max(k, 0)])

    def fingerprints(self, at: np.ndarray, n: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed((self.sums[at + n] - self.sums[at]) * self.down[at] + self.seed[at] * np.uint64(2 * n + 1))

    def distinct(self) -> np.ndarray:
        """The number of each word among the lot's distinct words, as their letters say."""
        low = np.where((self.lot.data >= ord("A")) & (self.lot.data <= ord("Z")), self.lot.data + 32, self.lot.data).astype(np.uint8)
        lengths = self.end - self.first

        def same(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            out = lengths[a] == lengths[b]
            k = np.flatnonzero(out)
            n = lengths[a[k]]
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            equal = low[np.repeat(self.first[a[k]], n) + step] == low[np.repeat(self.first[b[k]], n) + step]
            out[k] = np.logical_and.reduceat(equal, np.cumsum(n) - n) if len(k) else True
            return out

        self.low, self.lengths = low, lengths
        return classes(self.hashes, same)

    def spelled(self, at: np.ndarray, n: int) -> pa.Array:
        """The phrases of n words at these places, joined by single spaces."""
        word = (at[:, None] + np.arange(n)).ravel()
        size = self.lengths[word]
        start = np.cumsum(size + 1) - size - 1
        out = np.full(int((size + 1).sum()), 0x20, np.uint8)
        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(start, size) + step] = self.low[np.repeat(self.first[word], size) + step]
        low = start[::n] if len(at) else np.zeros(0, np.int64)
        high = np.r_[low[1:], len(out)][: len(at)] - 1  # without the space at the end
        keep = np.ones(len(out), bool)
        keep[high] = False
        offsets = np.r_[0, np.cumsum(high - low)].astype(np.int32)
        return pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets.tobytes()), pa.py_buffer(out[keep].tobytes()))


def classes(keys: np.ndarray, same: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The class of each place, 0 upwards: equal keys whose places `same` finds equal to the first's."""
    _, first, out = np.unique(keys, return_index=True, return_inverse=True)
    count, open_ = len(first), np.arange(len(keys))
    while len(open_):
        wrong = open_[~same(open_, first[out[open_]])]
        if not len(wrong):
            break
        _, where, again = np.unique(out[wrong], return_index=True, return_inverse=True)
        out[wrong], first = count + again, np.r_[first, wrong[where]]
        count, open_ = len(first), wrong
    return out


def _told(replies: object) -> np.ndarray:
    """What a lot's distinct fingerprints were told, in their order."""
    bits = [np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=x["n"]) for x in (replies if replies is not None else [])]
    return np.concatenate(bits).astype(bool) if bits else np.zeros(0, bool)


def _frequent(table: DataFrame, grams: Callable[[Words, object], np.ndarray], n_buckets: int, least: int) -> DataFrame:
    """(lot, bucket, n, bits): whether the lot's distinct fingerprints, in order, are frequent."""

    def send(lot: Lot, row: object) -> pd.DataFrame:
        values, counts = np.unique(grams(Words(lot), row), return_counts=True)
        edges, low = by_bucket(values, n_buckets), values.view(np.uint8).reshape(-1, 8)[:, :6]
        cuts = [(b, edges[b], edges[b + 1]) for b in np.flatnonzero(np.diff(edges))]
        rows = [(int(b), lot.number, int(j - i), low[i:j].tobytes(), pack(counts[i:j].astype(np.uint32).tobytes())) for b, i, j in cuts]
        return pd.DataFrame(rows, columns=["bucket", "lot", "n", "prints", "counts"])

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        raw = np.frombuffer(b"".join(pdf["prints"]), np.uint8).reshape(-1, 6)
        full = np.zeros((len(raw), 8), np.uint8)
        full[:, :6] = raw
        counts = np.concatenate([unpack(x).view(np.uint32) for x in pdf["counts"]])
        values, inverse = np.unique(full.view(np.uint64).ravel(), return_inverse=True)
        often = np.bincount(inverse, weights=counts, minlength=len(values)) >= least
        parts = np.split(often[inverse], np.cumsum(pdf["n"])[:-1])
        return pdf[["lot", "bucket", "n"]].assign(bits=[np.packbits(x).tobytes() for x in parts])

    sent = each_lot(table, send, "bucket int, lot long, n int, prints binary, counts binary")
    return sent.groupBy("bucket").applyInPandas(meet, "lot long, bucket int, n int, bits binary")


def _short(words: Words) -> list[np.ndarray]:
    return [words.fingerprints(words.places(n), n) for n in (1, 2)]


def _marks(words: Words, told: np.ndarray) -> list[np.ndarray]:
    """For each word whether it, and whether the pair from it, is frequent."""
    prints = _short(words)
    _, inverse = np.unique(np.concatenate(prints), return_inverse=True)
    often = told[inverse] if len(inverse) else np.zeros(0, bool)
    out = [np.zeros(len(words.hashes), bool) for _ in prints]
    for mark, n, x in zip(out, (1, 2), np.split(often, [len(prints[0])]), strict=True):
        mark[words.places(n)] = x
    return out


def _long(words: Words, pairs: np.ndarray) -> list[np.ndarray]:
    """Where phrases of 3 words and more start all of whose pairs are frequent."""
    out = []
    for n in range(3, LONGEST + 1):
        k = max(len(pairs) - n + 1, 0)
        out.append(np.flatnonzero(np.logical_and.reduce([pairs[i : i + k] for i in range(n - 1)])))
    return out


def _long_prints(words: Words, places: list[np.ndarray]) -> list[np.ndarray]:
    return [words.fingerprints(at, n) for n, at in enumerate(places, 3)]


def phrase_counts(docs: DataFrame, language: str = "lang", least: int = MIN_COUNT, lot_bytes: int | None = None) -> DataFrame:
    """(lang, words, phrase, a) as a written table: all phrases of 1 to LONGEST words with a count of
    at least `least` in their language, and with words = 0 each language's number of words."""
    table = lots(docs, language, **({"size": lot_bytes} if lot_bytes else {}))
    size = total_bytes(table)
    first = written(_frequent(table, lambda words, row: np.concatenate(_short(words)), buckets_for(table, 2 * size), least), "pairs")
    joined = with_replies(table, first).withColumnRenamed("replies", "first")

    def longer(words: Words, row: object) -> np.ndarray:
        return np.concatenate(_long_prints(words, _long(words, _marks(words, _told(row.first))[1])))

    second = written(_frequent(joined, longer, buckets_for(table, size / 2), least), "phrases")

    def spell(lot: Lot, row: object) -> pa.RecordBatch:
        words = Words(lot)
        single, pairs = _marks(words, _told(row.first))
        places = _long(words, pairs)
        prints = _long_prints(words, places)
        _, inverse = np.unique(np.concatenate(prints), return_inverse=True)
        often = _told(row.replies)[inverse] if len(inverse) else np.zeros(0, bool)
        kept = [at[x] for at, x in zip(places, np.split(often, np.cumsum([len(x) for x in prints])[:-1]), strict=True)]
        word = words.distinct()
        columns = [[], [], [], []]
        for n, at in enumerate([np.flatnonzero(single), np.flatnonzero(pairs), *kept], 1):
            equal = lambda a, b, at=at, n=n: (words.language[at[a]] == words.language[at[b]]) & np.logical_and.reduce([word[at[a] + k] == word[at[b] + k] for k in range(n)])
            own = classes(words.fingerprints(at, n), equal)
            _, where, counts = np.unique(own, return_index=True, return_counts=True)
            columns[0].append(words.languages[words.language[at[where]]])
            columns[1].append(np.full(len(where), n))
            columns[2].append(words.spelled(at[where], n))
            columns[3].append(counts)
        totals = np.bincount(words.language, minlength=len(words.languages))
        columns = [[*c, x] for c, x in zip(columns, (words.languages, np.zeros(len(totals), int), pa.array([""] * len(totals), pa.string()), totals), strict=True)]
        arrays = [pa.array(np.concatenate(columns[0]).tolist(), pa.string()), pa.array(np.concatenate(columns[1]), pa.int32()), pa.concat_arrays(columns[2]), pa.array(np.concatenate(columns[3]), pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, ["lang", "words", "phrase", "a"])

    told = with_replies(joined, second)

    def run(batches):
        for batch in batches:
            for row in batch.to_pandas().itertuples(index=False):
                yield spell(Lot.of(row), row)

    spelled = told.mapInArrow(run, "lang string, words int, phrase string, a long")
    return written(spelled.groupBy("lang", "words", "phrase").agg(F.sum("a").alias("a")).filter((F.col("a") >= least) | (F.col("words") == 0)), "counts")


def rank_phrases(counts: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the first `top` phrases of each language.

    A phrase is scored by its worst cut in two, the first of equal ones, and left out where a longer
    one that holds it has nearly its count.
    """
    big = lambda c: F.col(c).cast("decimal(20,0)")
    rows = counts.filter("words > 1").withColumn("w", F.split("phrase", " "))
    joined = lambda start, length: F.array_join(F.slice("w", start, length), " ")
    cut = rows.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cut = cut.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("head"), joined(F.col("k") + 1, F.col("words") - F.col("k")).alias("tail"))
    part = counts.filter("words > 0")
    cut = cut.join(part.select("lang", F.col("phrase").alias("head"), F.col("a").alias("l")), ["lang", "head"])
    cut = cut.join(part.select("lang", F.col("phrase").alias("tail"), F.col("a").alias("r")), ["lang", "tail"])
    cut = cut.withColumn("score", F.expr(f"(cast(a as decimal(20,0)) * {SCALE}) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"))
    worst = cut.groupBy("lang", "phrase", "a").agg(F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("worst"))
    inner = rows.filter("words > 2").withColumn("length", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
    inner = inner.withColumn("start", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("length") + 1)))
    over = inner.groupBy("lang", joined(F.col("start"), F.col("length")).alias("phrase")).agg(F.max("a").alias("longer"))
    kept = worst.join(over, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (big("longer") * 100 < big("a") * COVERED))
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.select("lang", "phrase", "a", "worst.*").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    totals = counts.filter("words = 0").select("lang", F.col("a").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame) -> DataFrame:
    """The ranked phrases of each language of `docs` (doc_id, text, lang).

    Null texts are empty and a null language is 'und'; ids aren't used, and other columns are left
    out. A language without frequent phrases, and an empty table, give no rows. Equal scores go by
    count, then by the bytes of the phrase.
    """
    return rank_phrases(phrase_counts(docs))
