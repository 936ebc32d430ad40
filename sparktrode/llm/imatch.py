"""Document fingerprints by I-Match over randomised lexicons.

The lexicon is all terms whose inverse document frequency lies in a band. Each of many random
subsets of it gives one signature: the hash of the document's distinct terms in that subset. Terms
are 64-bit word hashes, distinct after sorting, and the hash of a subset is the sum of its mixed
terms, the same whatever their order. Subsets come in levels of density, as a long document keeps
a signature under an edit only in a sparse subset, and a short one has terms only in dense ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, written
from .wordhash import BASE, mixed, tokens

#: The band: terms in this share of the documents. The lower end bounds the lexicon, which holds
#: at most (mean distinct terms of a document) / LEAST_SHARE terms.
LEAST_SHARE, MOST_SHARE = 1 / 2000, 1 / 5
#: Level k holds each term in a subset with chance 4 ** -k.
LEVELS, SUBSETS = 5, 24
#: A likeness is taken at the sparsest level where so many subsets hold terms of either document.
ENOUGH = 8
#: Characters handled at once; a text is never cut, so a longer one makes a longer lot.
LOT_CHARS = 400_000
#: Counts of terms that a task holds before it adds them up or sends them on.
COUNTS_HELD = 2_000_000
TERMS_AT_ONCE = 1 << 15

RESULT = "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, part int, edge int, text string"


def _terms(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct terms of each text, sorted, end to end; and the text of each."""
    hashes, starts = tokens(texts)
    doc = np.repeat(np.arange(len(texts)), np.diff(starts))
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.r_[True, (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])][: len(hashes)]
    return hashes[new], doc[new]


def _added(terms: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(np.concatenate(terms), return_inverse=True)
    return found, np.bincount(at, np.concatenate(counts), len(found)).astype(np.int64)


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, n): in how many texts of the partition a term is."""

    def out(found: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"term": pa.array(found.view(np.int64)), "n": pa.array(n)})

    terms, counts, held = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    for texts in _lots(x for batch in batches for x in batch.column(0).to_pylist()):
        found, n = np.unique(_terms([t or "" for t in texts])[0], return_counts=True)
        terms.append(found)
        counts.append(n)
        held += len(found)
        if held > 2 * COUNTS_HELD:
            found, n = _added(terms, counts)
            if len(found) > COUNTS_HELD:
                yield out(found, n)
                found, n = found[:0], n[:0]
            terms, counts, held = [found], [n], len(found)
    yield out(*_added(terms, counts))


def _lots(texts: Iterator[str | None]) -> Iterator[list[str | None]]:
    lot, size = [], 0
    for text in texts:
        lot.append(text)
        size += len(text or "")
        if size >= LOT_CHARS:
            yield lot
            lot, size = [], 0
    if lot:
        yield lot


def lexicon(docs: DataFrame) -> np.ndarray:
    """The terms of the band, of all documents, sorted; LEAST_SHARE bounds their number."""
    total = docs.count()
    counts = docs.select("text").mapInArrow(_count_terms, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    band = counts.filter((F.col("n") >= max(2.0, LEAST_SHARE * total)) & (F.col("n") <= max(2.0, MOST_SHARE * total)))
    return np.sort(band.select("term").toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64))


def subsets(terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The subsets that hold each term: (place of the term, number of the subset), in that order."""
    places, numbers = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, len(terms), TERMS_AT_ONCE):
        lot = terms[at : at + TERMS_AT_ONCE]
        bits, seeds = np.full(len(lot), (1 << SUBSETS) - 1, dtype=np.uint64), np.arange(2 * LEVELS, dtype=np.uint64) * np.uint64(BASE)
        member = np.zeros((len(lot), LEVELS, SUBSETS), dtype=bool)
        for level in range(LEVELS):
            for seed in seeds[2 * level : 2 * level + 2]:
                bits &= mixed(lot ^ mixed(seed)) >> np.uint64(40)
            member[:, level] = (bits[:, None] >> np.arange(SUBSETS, dtype=np.uint64)) & np.uint64(1)
        place, number = np.nonzero(member.reshape(len(lot), -1))
        places.append(place + at)
        numbers.append(number)
    return np.concatenate(places), np.concatenate(numbers)


class Prints:
    """Fingerprints under one lexicon; the subsets of its terms are worked out once a task."""

    def __init__(self, terms: np.ndarray):
        self.terms = terms
        place, self.subset = subsets(terms)
        self.ends = np.searchsorted(place, np.arange(len(terms) + 1))

    def _members(self, terms: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place among terms, subset) of lexicon terms; known is their place in the lexicon."""
        size = self.ends[known + 1] - self.ends[known]
        place = np.repeat(np.arange(len(terms)), size)
        return place, self.subset[np.arange(len(place)) - np.repeat(np.cumsum(size) - size, size) + self.ends[known][place]]

    def of(self, texts: list[str]) -> np.ndarray:
        """For each text a 16-bit signature for each subset; 0 where it has no term in it.

        A text without terms of the band takes all its terms; one without terms, itself.
        """
        terms, doc = _terms(texts)
        at = np.minimum(np.searchsorted(self.terms, terms), max(0, len(self.terms) - 1))
        in_band = self.terms[at] == terms if len(self.terms) else np.zeros(len(terms), dtype=bool)
        banded = np.bincount(doc[in_band], minlength=len(texts)) > 0
        rest = ~banded[doc]
        bare = np.flatnonzero(np.bincount(doc, minlength=len(texts)) == 0)
        own = np.array([int.from_bytes(hashlib.blake2b(texts[k].encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") for k in bare], dtype=np.uint64)
        other, other_doc = np.r_[terms[rest], own], np.r_[doc[rest], bare]
        sums = np.zeros(len(texts) * LEVELS * SUBSETS, dtype=np.uint64)
        held = np.zeros(len(sums), dtype=bool)
        for t, d, (place, subset) in ((terms[in_band], doc[in_band], self._members(terms[in_band], at[in_band])), (other, other_doc, subsets(other))):
            key = d[place] * (LEVELS * SUBSETS) + subset
            held[key] = True
            with np.errstate(over="ignore"):
                np.add.at(sums, key, mixed(t + np.uint64(BASE))[place])
        return np.where(held, mixed(sums) % np.uint64(65535) + np.uint64(1), 0).astype("<u2").reshape(len(texts), -1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """By row, the share of equal signatures among the subsets that either has, at the level chosen."""
    p, q = a.reshape(-1, LEVELS, SUBSETS), b.reshape(-1, LEVELS, SUBSETS)
    held, same = ((p > 0) | (q > 0)).sum(2), ((p > 0) & (p == q)).sum(2)
    fit = held >= ENOUGH
    level = np.where(fit.any(1), LEVELS - 1 - np.argmax(fit[:, ::-1], axis=1), np.argmax(held, axis=1))
    row = np.arange(len(p))
    return np.where((a == b).all(1), 1.0, same[row, level] / np.maximum(1, held[row, level]))


def edited(text: str, following: str) -> str:
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


_KINDS = {"long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "int": pa.int32(), "string": pa.string()}
_SCHEMA = pa.schema([(n, _KINDS[k]) for n, k in (x.split(" ") for x in RESULT.split(", "))])


def _rows(prints: Prints, ids: list, texts: list[str], others: list[str]) -> pa.RecordBatch:
    """The result for each text, and the text that follows it."""
    new = [edited(t, u) for t, u in zip(texts, others, strict=True)]
    own, changed, following = prints.of(texts), prints.of(new), prints.of(others)
    raw = lambda x: pa.array([r.tobytes() for r in x], pa.binary())
    columns = {
        "doc_id": pa.array(ids, pa.int64()),
        "n_chars": pa.array([len(t) for t in texts], pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest() for t in new], pa.binary()),
        "fingerprint": raw(own),
        "edited_fingerprint": raw(changed),
        "near_edited": likeness(own, changed),
        "near_next": likeness(own, following),
        "part": pa.nulls(len(ids), pa.int32()),
        "edge": np.zeros(len(ids), np.int32),
        "text": pa.nulls(len(ids), pa.string()),
    }
    return pa.RecordBatch.from_pydict(columns, schema=_SCHEMA)


def _along(terms: np.ndarray):
    """Each row against the next of its partition; the first and last rows also as edges."""

    def edge(part: int, kind: int, doc: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict.fromkeys(_SCHEMA.names) | {"doc_id": doc[0], "text": doc[1], "part": part, "edge": kind}], schema=_SCHEMA)

    def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints, part, unpack = Prints(terms), TaskContext.get().partitionId(), zstandard.ZstdDecompressor().decompress
        line: list[tuple] = []  # rows whose next is not known or not handled yet
        size, begun = 0, False
        for batch in batches:
            for doc_id, packed in zip(batch.column("doc_id").to_pylist(), batch.column("packed").to_pylist(), strict=True):
                line.append((doc_id, unpack(packed).decode("utf-8", "surrogatepass")))
                if not begun:
                    begun = True
                    yield edge(part, 1, line[0])
                size += len(line[-1][1])
                if size >= LOT_CHARS and len(line) > 1:
                    ids, texts = zip(*line, strict=True)
                    yield _rows(prints, ids[:-1], texts[:-1], texts[1:])
                    line, size = line[-1:], 0
        if len(line) > 1:
            ids, texts = zip(*line, strict=True)
            yield _rows(prints, ids[:-1], texts[:-1], texts[1:])
        if line:
            yield edge(part, 2, line[-1])

    return along


def _across(terms: np.ndarray):
    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = Prints(terms)
        for batch in batches:
            if batch.num_rows:
                yield _rows(prints, *(batch.column(c).to_pylist() for c in ("doc_id", "text", "next_text")))

    return across


def _pack(texts: pd.Series) -> pd.Series:
    pack = zstandard.ZstdCompressor(level=1).compress
    return texts.map(lambda x: pack(x.encode("utf-8", "surrogatepass")))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of every row's text and of its edited text, and their likeness.

    Null texts count as empty. The next document is the next in descending doc_id, null ids last,
    rows of one id in order of their texts' hash; after the last comes the first, and a single
    document follows itself. Equal texts have equal fingerprints; other columns are not read. An
    empty table gives an empty result.
    Rows are dealt by range of (doc_id, hash), so a repeated id is spread too; the last row of a
    partition meets the first of the next one in a second, small step.
    """
    bounded_batches(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    terms = lexicon(base)
    count = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc_nulls_last("doc_id"), F.col("hash")]
    packed = base.select("doc_id", F.xxhash64("text").alias("hash"), F.pandas_udf(_pack, "binary")("text").alias("packed"))  # texts are the bulk of the shuffle
    dealt = packed.repartitionByRange(count, *order).sortWithinPartitions(*order)
    found = written(dealt.mapInArrow(_along(terms), RESULT), "fingerprints")
    last, first = (found.filter(f"edge = {k}").select("part", "doc_id", "text") for k in (2, 1))  # a row a partition
    line = Window.orderBy("part")  # over the numbers of the partitions alone
    least = F.min("part").over(Window.partitionBy())
    following = last.select("part", F.coalesce(F.lead("part").over(line), least).alias("next"))
    turned = last.join(following, "part").join(first.select(F.col("part").alias("next"), F.col("text").alias("next_text")), "next")
    joined = turned.select("doc_id", "text", "next_text").mapInArrow(_across(terms), RESULT)
    return found.filter("edge = 0").unionByName(joined).select(
        "doc_id", "n_chars", *[F.lower(F.hex(c)).alias(c) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")], "near_edited", "near_next"
    )
