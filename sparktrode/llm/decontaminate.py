"""Benchmark decontamination by latent semantic retrieval.

Passages of the corpus are TF-IDF vectors over hashed terms. A randomised SVD, whose products are
summed over partitions, gives latent factors. All windows of every text, at a few lengths, are
compared with the benchmark items of about that length by cosine in the latent space; the cosine
alone chooses the candidates. A candidate's region is then checked with the longest common
subsequence of words, and a paraphrase also with the item's answer.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import bounded_batches
from .wordhash import tokens

TERMS = 1 << 14
#: Latent factors. The first few are left out: they hold the languages and their commonest words,
#: which lift the cosines of unrelated windows more than those of paraphrases (README).
RANK, SKIPPED, OVERSAMPLE = 102, 6, 6
#: Words in a corpus passage; windows of a width are an eighth of it apart; least words that a
#: region takes on each side of its window (a third of the width, if more).
PASSAGE, STEPS, MARGIN = 32, 8, 8
#: Set by the recall of planted copies with a quarter of the words replaced and of paraphrases with
#: half of them replaced and the answer kept (README).
COSINE = 0.3
#: Longest common subsequence as a share of the item's words: a copy, or a paraphrase if the
#: item's answer is there too. The tables give no answers, so the end of an item counts as one.
COPY, PARAPHRASE, ANSWER = 0.75, 0.45, 0.8
SHORT_ITEM = 8
SEED = 5
#: Regions looked at together, characters of items in one block of them, most words of a span of a
#: text, and words of short texts whose factors are held at once, so few that they stay in the cache.
REGIONS, ITEM_CHARS, SPAN, HELD = 1 << 13, 4_000_000, 1 << 14, 1 << 12
#: Characters handled at once, so few that the arrays stay in the cache; a text is never cut, so a longer one makes a longer group.
#: Groups whose sums are put into the SVD's array at once, and items whose words are counted at once.
GROUP_CHARS, TOGETHER, COUNTED = 100_000, 8, 256
FOUND = "item_id string, cosine double, lcs double, kind string"


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str | None]]]:
    """Rows in groups of about GROUP_CHARS characters: ids (if there) and texts."""
    ids, texts, size = [], [], 0
    for batch in batches:
        keys = batch.column("doc_id").to_pylist() if "doc_id" in batch.schema.names else [None] * batch.num_rows
        for key, text in zip(keys, batch.column("text").to_pylist(), strict=True):
            ids.append(key)
            texts.append(text)
            size += len(text or "")
            if size >= GROUP_CHARS:
                yield ids, texts
                ids, texts, size = [], [], 0
    if texts:
        yield ids, texts


def terms_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(TERMS - 1)).astype(np.int64)


def _runs(starts: np.ndarray, width: int) -> np.ndarray:
    """Starts of runs of `width` words that don't cross texts; shorter ones at a text's end."""
    at = np.arange(starts[-1]) - np.repeat(starts[:-1], np.diff(starts))
    return np.flatnonzero(at % width == 0)


def _laid(terms: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The terms of passages, a row each, filled up with TERMS."""
    at = first[:, None] + np.arange(PASSAGE)
    return np.where(at < np.r_[first[1:], len(terms)][:, None], terms[np.minimum(at, len(terms) - 1)], TERMS)


class Room:
    """Arrays that are used again, by name: new ones cost more than the sums put into them."""

    def __init__(self, kind: type = np.float32) -> None:
        self.held: dict[str, np.ndarray] = {}
        self.kind = kind

    def __call__(self, name: str, rows: int, columns: int) -> np.ndarray:
        need = rows * columns
        if name not in self.held or len(self.held[name]) < need:
            self.held[name] = np.empty(need + need // 4, self.kind)
        return self.held[name][:need].reshape(rows, columns)


def _sums(rows: np.ndarray, index: np.ndarray, starts: np.ndarray, most: int = 32, room: Room | None = None) -> np.ndarray:
    """Sums of rows[index] by runs that begin at starts, none empty: np.add.reduceat, but a place of
    all runs at once. Runs longer than `most` are cut, and their parts are summed in turn."""
    lengths = np.diff(np.r_[starts, len(index)])
    parts = -(-lengths // most)
    if (parts > 1).any():
        begin = np.cumsum(np.r_[0, parts])
        inner = np.repeat(starts, parts) + (np.arange(begin[-1]) - np.repeat(begin[:-1], parts)) * most
        return _sums(_sums(rows, index, inner, most, room), np.arange(begin[-1]), begin[:-1], most, room)
    room = room or Room(rows.dtype)
    order = np.argsort(-lengths, kind="stable")
    count = len(order) - np.cumsum(np.bincount(lengths, minlength=most + 1))  # runs longer than k
    at = starts[order]
    total = rows.take(index[at], axis=0, out=room("total", len(at), rows.shape[1]), mode="clip")
    for k in range(1, int(lengths.max(initial=0))):
        n = count[k]
        total[:n] += rows.take(index[at[:n] + k], axis=0, out=room("place", n, rows.shape[1]), mode="clip")
    out = np.empty_like(total)
    out[order] = total
    return out


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for x in batch.column("part").to_pylist():
            x = np.frombuffer(x, dtype=np.float32)
            total = x.astype(np.float64) if total is None else total + x
    if total is not None:
        yield pa.RecordBatch.from_pydict({"part": pa.array([total.astype(np.float32).tobytes()], pa.binary())})


def summed(docs: DataFrame, shape: tuple[int, ...], add: Callable[[np.ndarray, np.ndarray, np.ndarray], None], fan_in: int = 4) -> np.ndarray:
    """Sum over all texts of what `add` puts into an array of this shape, added in a tree.

    `add` gets the array, the terms of some texts and the starts of their passages.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for lot in itertools.batched(groups(batches), TOGETHER):
            parts = [(terms_of(hashes), _runs(starts, PASSAGE)) for hashes, starts in (tokens(texts) for _, texts in lot)]
            before = np.cumsum([0, *(len(terms) for terms, _ in parts)])
            if before[-1]:
                add(total, np.concatenate([terms for terms, _ in parts]), np.concatenate([first + n for (_, first), n in zip(parts, before, strict=False)]))
        yield pa.RecordBatch.from_pydict({"part": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    parts, n = docs.select("text").mapInArrow(partial, "part binary"), docs.rdd.getNumPartitions()
    while n > fan_in:
        n = -(-n // fan_in)
        parts = parts.repartition(n).mapInArrow(_added, "part binary")
    total = np.zeros(shape)
    for r in parts.toLocalIterator():
        total += np.frombuffer(r["part"], dtype=np.float32).reshape(shape)
    return total


@dataclass(frozen=True)
class Latent:
    """Weighted factors of the hashed terms, a row for each, and the passages that hold each term."""

    factors: np.ndarray
    passages: np.ndarray

    def of(self, terms: np.ndarray) -> np.ndarray:
        total = self.factors[terms].sum(0)
        return total / max(float(np.linalg.norm(total)), 1e-12)


def factors_of(product: np.ndarray, idf: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """The weighted factors, from the product of the passages' terms with the weighted sketch.

    The driver holds two arrays of the product's size at once: small products take rows a block at
    a time, and the left factors come from the eigenvectors of the square of the sketched rows.
    """
    blocks = [slice(at, at + 1024) for at in range(0, len(product), 1024)]
    product *= idf[:, None]  # A'A times the sketch
    core = sum(sketch[b].T.astype(float) @ product[b] for b in blocks)
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    keep = values > 1e-9 * max(values.max(), 1e-300)
    rows = product @ (vectors[:, keep] / np.sqrt(values[keep]))
    square, right = np.linalg.eigh(rows.T @ rows)
    order = np.argsort(-square, kind="stable")[SKIPPED:RANK]
    right = right[:, order] / np.sqrt(np.maximum(square[order], 1e-300))
    out = np.empty((len(rows), len(order)), np.float32)
    for b in blocks:
        out[b] = idf[b, None] * (rows[b] @ right)
    return out


def fit(docs: DataFrame) -> Latent:
    """Idf over all passages, then a randomised SVD of them in one pass (Nystrom's form).

    With A the passages by terms and W the random sketch, A'AW is summed over partitions; the
    right factors of A are those of A'AW (W'A'AW)^(-1/2).
    """

    def count(total: np.ndarray, terms: np.ndarray, first: np.ndarray) -> None:
        laid = np.sort(_laid(terms, first).astype(np.uint16), axis=1)
        laid[:, 1:][laid[:, 1:] == laid[:, :-1]] = TERMS  # once a passage
        total[:TERMS] += np.bincount(laid.ravel(), minlength=TERMS + 1)[:TERMS]
        total[TERMS] += len(first)

    df = summed(docs, (TERMS + 1,), count)
    idf = np.log((1 + df[TERMS]) / (1 + df[:TERMS])).astype(np.float32)
    sketch = np.random.default_rng(SEED).normal(size=(TERMS, RANK + OVERSAMPLE)).astype(np.float32)

    weighted, room = idf[:, None] * sketch, Room()

    def spread(total: np.ndarray, terms: np.ndarray, first: np.ndarray) -> None:
        square = np.maximum(np.add.reduceat(idf[terms] ** 2, first), 1e-12)
        rows = _sums(weighted, terms, first, room=room)
        rows /= square[:, None]  # unit rows, twice
        passage = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(terms)]))
        order = np.argsort(terms.astype(np.uint16), kind="stable")
        sorted_terms = terms[order]
        at = np.flatnonzero(np.r_[True, sorted_terms[1:] != sorted_terms[:-1]])
        total[sorted_terms[at]] += _sums(rows, passage[order], at, room=room)

    product = summed(docs, weighted.shape, spread)
    del weighted
    return Latent(factors_of(product, idf, sketch), df[:TERMS])


@dataclass(frozen=True)
class Item:
    item_id: str
    words: list[int]

    @property
    def width(self) -> int:
        """Words in a window: of 8, 12, 16, 24, 32, 48, ..., without end, the nearest by ratio."""
        n, w = len(self.words), 8
        while w * 2 <= n:
            w *= 2
        return min((w, w * 3 // 2, w * 2), key=lambda x: max(x, n) / min(x, n))


def masks(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for k, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << k
    return out


def common_subsequence(masks: dict[int, int], length: int, region: list[int]) -> int:
    """Length of the longest common subsequence, by bits of one number."""
    full = (1 << length) - 1
    v = full
    for w in region:
        if m := masks.get(w):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return length - v.bit_count()


def _common(bits: np.ndarray, size: np.ndarray, item: np.ndarray, begin: np.ndarray, end: np.ndarray, word: np.ndarray) -> np.ndarray:
    """common_subsequence of many (item, region of words) at once, for items of up to 64 words.

    bits holds the masks, a row an item and a column a word, the last column for any other word; a region is word[begin:end].
    """
    size = size[item]
    full = np.where(size == 64, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (size % 64).astype(np.uint64)) - np.uint64(1))
    order = np.argsort(begin - end, kind="stable")  # the longest region first
    longer = len(order) - np.cumsum(np.bincount(end - begin))  # regions longer than k
    v, at, row, flat = full[order], begin[order], item[order] * bits.shape[1], bits.ravel()
    for n in longer[:-1]:
        now, place = v[:n], at[:n]
        u = flat.take(row[:n] + word.take(place))
        u &= now
        more = now + u
        np.subtract(now, u, out=now)
        now |= more
        place += 1
    v &= full[order]
    out = np.empty(len(order), np.int64)
    out[order] = size[order] - np.bitwise_count(v).astype(np.int64)
    return out


def _stepped(sums: dict[int, np.ndarray], size: int, room: Room) -> np.ndarray:
    """Sums of each `size` rows; sums holds those of other sizes, the rows themselves for 1."""
    if size not in sums:
        part = 2 if size % 2 == 0 else 3
        of = _stepped(sums, size // part, room)
        sums[size] = total = np.add(of[0::part], of[1::part], out=room(f"step {size}", len(of) // part, of.shape[1]))
        for k in range(2, part):
            total += of[k::part]
    return sums[size]


def _rolled(rows: np.ndarray, many: int, room: Room, name: str = "rolled") -> np.ndarray:
    """Sums of `many` rows from each row on, by doubling; zeros for the last ones, which have fewer."""
    out, n, sums, span = room(name, *rows.shape), len(rows) - many + 1, {1: rows}, 1
    out[max(n, 0) :] = 0
    if n <= 0:
        return out
    while 4 * span <= many:
        of = sums[span]
        sums[2 * span] = np.add(of[:-span], of[span:], out=room(f"rolled {2 * span}", len(of) - span, rows.shape[1]))
        span *= 2
    have, whole = span, out[:n]
    if have == many:
        whole[:] = sums[span][:n]
    first = sums[span][:n]
    while have < many:
        span = min(span, 1 << ((many - have).bit_length() - 1))
        np.add(first, sums[span][have : have + n], out=whole)
        first = whole
        have += span
    return out


def _joined(half: np.ndarray, step: int, apart: int, room: Room, name: str) -> np.ndarray:
    """Each `step`th window of half the width and the one `apart` rows on, added; zeros for the last ones."""
    out, n = room(name, -(-len(half) // step), half.shape[1]), max(0, -(-(len(half) - apart) // step))
    out[n:] = 0
    np.add(half[::step][:n], half[apart::step], out=out[:n])
    return out


class Search:
    """All windows of a group of texts against all items of a block."""

    def __init__(self, latent: Latent, items: list[Item], cosine: float = COSINE):
        self.latent, self.items, self.cosine, self.room = latent, items, cosine, Room()
        words = [np.array(i.words, dtype=np.uint64) for i in items]
        self.size = np.array([len(w) for w in words])
        self.factors = np.r_[latent.factors, np.zeros((1, latent.factors.shape[1]), np.float32)]
        self.query = np.array([latent.of(terms_of(w)) for w in words], dtype=np.float32)
        self.width = np.array([i.width for i in items])
        self.step, self.margin = np.maximum(1, self.width // STEPS), np.maximum(MARGIN, self.width // 3)
        self.needed = np.array([(1.0 if len(w) < SHORT_ITEM else PARAPHRASE) * len(w) for w in words])
        self.answers = [i.words[-max(3, len(i.words) // 4) :] for i in items]
        self.answer_size = np.array([len(a) for a in self.answers])
        self.by_width = {int(w): np.flatnonzero(self.width == w) for w in np.unique(self.width)}
        self.lcm = int(np.lcm.reduce(self.step))
        self.words, place = np.unique(np.concatenate(words), return_inverse=True)
        at = np.cumsum(np.r_[0, self.size])
        self.place = [place[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]  # of each item's words
        self.member = []  # which items have a word, COUNTED items at once; the last row for no word
        for i in range(0, len(items), COUNTED):
            self.member.append(np.zeros((len(self.words) + 1, len(items[i : i + COUNTED])), np.uint8))
            for k, own in enumerate(self.place[i : i + COUNTED]):
                self.member[-1][own, k] = 1
        self.low = np.zeros(1 << 16, bool)  # the words' last 16 bits
        self.low[self.words & np.uint64(0xFFFF)] = True
        short = np.flatnonzero(self.size <= 64)
        self.row = np.full(len(items), -1)
        self.row[short] = np.arange(len(short))
        self.bits, self.answer_bits = np.zeros((2, len(short), len(self.words) + 1), np.uint64)
        for r, k in enumerate(short):
            for table, own in ((self.bits, self.place[k]), (self.answer_bits, self.place[k][-self.answer_size[k] :])):
                np.bitwise_or.at(table[r], own, np.uint64(1) << np.arange(len(own)).astype(np.uint64))
        self.masks = {k: (masks(i.words), masks(self.answers[k])) for k, i in enumerate(items) if self.row[k] < 0}

    def spans(self, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(text, begin, end) of spans of about HELD words at a time. A text longer than SPAN has several,
        which overlap by the widest window, so that it has the same windows as in one."""
        over = -(-int(self.width.max()) // self.lcm) * self.lcm
        hop = -(-SPAN // self.lcm) * self.lcm
        lengths = np.diff(starts)
        parts = np.maximum(1, -(-np.maximum(lengths - over, 0) // hop))
        text = np.repeat(np.arange(len(lengths)), parts)
        low = starts[text] + (np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)) * hop
        high = np.minimum(low + hop + over, starts[text + 1])
        some = np.cumsum(high - low) // HELD
        for lot in np.split(np.arange(len(text)), np.flatnonzero(np.diff(some)) + 1):
            yield text[lot], low[lot], high[lot]

    def candidates(self, hashes: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(text, item, begin, end, cosine) of the windows that reach the cosine and are the best for
        their item of the windows next to them, a width at a time.

        Spans are laid out in rows of factors, each filled up with zeros to a whole number of steps; a
        step is the sum of its words' rows, and a window that of its steps, or of two windows of half the width.
        """
        for text_of, low, high in self.spans(starts):
            lengths = high - low
            base = np.cumsum(np.r_[0, -(-lengths // self.lcm) * self.lcm])
            place = np.arange(lengths.sum()) + np.repeat(low - np.cumsum(lengths) + lengths, lengths)
            again = np.r_[False, hashes[place[1:]] == hashes[place[1:] - 1]]
            term = np.full(base[-1], TERMS)  # the row of zeros
            # one word many times in a row must not drown its window
            term[np.arange(len(place)) + np.repeat(base[:-1] - np.cumsum(lengths) + lengths, lengths)] = np.where(again, TERMS, terms_of(hashes[place]))
            rows = self.factors.take(term, axis=0, out=self.room("rows", len(term), self.factors.shape[1]), mode="clip")
            sums, done = {1: rows}, {}
            for width, items in self.by_width.items():
                step, margin = int(self.step[items[0]]), int(self.margin[items[0]])
                many, half, name = width // step, width // 2, f"windows {width}"
                if half in done:
                    had = int(self.step[self.by_width[half][0]])
                    windows = _joined(done[half], step // had, half // had, self.room, name)
                else:
                    windows = _rolled(_stepped(sums, step, self.room), many, self.room, name)
                done[width] = windows
                count = -(-lengths // step)  # steps of each span
                last = np.maximum(count - many, 0)  # its last window
                span = np.repeat(np.arange(len(lengths)), np.diff(base) // step)
                number = np.arange(len(span)) - base[span] // step
                if (count < many).any():  # a span that is shorter than a window is one
                    for k in np.flatnonzero((count > 0) & (count < many)):
                        windows[base[k] // step] = rows[base[k] : base[k + 1]].sum(0)
                cosine = np.matmul(windows, self.query[items].T, out=self.room("cosine", len(windows), len(items)))
                norm = np.sqrt(np.einsum("ij,ij->i", windows, windows))
                norm[number > last[span]] = np.inf  # reaches into the next span
                cosine /= np.maximum(norm, 1e-12)[:, None]
                best = cosine >= self.cosine
                for by in (1, 2):  # the best of windows that are up to a quarter apart: its region holds theirs
                    if by < len(span):
                        apart = np.flatnonzero(span[by:] != span[:-by])
                        better = cosine[by:] > cosine[:-by]
                        better[apart] = True
                        best[by:] &= better
                        np.logical_not(better, out=better)
                        better[apart] = True
                        best[:-by] &= better
                at = np.flatnonzero(best)
                k = at // len(items)
                j = at - k * len(items)
                if not len(k):
                    continue
                text, begin = text_of[span[k]], low[span[k]] + number[k] * step
                end = np.minimum(begin + width, starts[text + 1])
                yield text, items[j], np.maximum(begin - margin, starts[text]), np.minimum(end + margin, starts[text + 1]), cosine[k, j]

    def _in_item(self, item: np.ndarray, begin: np.ndarray, end: np.ndarray, word: np.ndarray) -> np.ndarray:
        """How many words of each region, out to whole fours, its item has: no common subsequence is longer."""
        out = np.zeros(len(item), np.int64)
        word = np.r_[word, np.full(-len(word) % 4, len(self.words))]
        begin, end = begin // 4, -(-end // 4)
        kind = np.min_scalar_type(4 * int((end - begin).max(initial=0)))  # sums may wrap round, but differences don't
        for i, member in enumerate(self.member):
            own = np.flatnonzero((item >= i * COUNTED) & (item < (i + 1) * COUNTED)) if len(self.member) > 1 else slice(None)
            has = member.take(word, axis=0).reshape(-1, 4, member.shape[1])
            four = has[:, 0] + has[:, 1]
            four += has[:, 2]
            four += has[:, 3]
            upto = np.zeros((member.shape[1], len(four) + 1), kind)
            np.cumsum(np.ascontiguousarray(four.T), axis=1, dtype=kind, out=upto[:, 1:])
            row = item[own] - i * COUNTED
            out[own] = upto[row, end[own]] - upto[row, begin[own]]
        return out

    def _shared(self, item: np.ndarray, begin: np.ndarray, end: np.ndarray, word: np.ndarray, hashes: np.ndarray, answers: bool) -> np.ndarray:
        """The longest common subsequence of each region with its item, or with the item's answer."""
        out = np.zeros(len(item), np.int64)
        row = self.row[item]  # short items in order, so that an item's masks stay in the cache
        size = (self.answer_size if answers else self.size)[self.row >= 0]
        short = np.argsort(row, kind="stable")
        short = short[row[short] >= 0]
        for lot in np.split(short, range(REGIONS, len(short), REGIONS)):
            if len(lot):
                out[lot] = _common(self.answer_bits if answers else self.bits, size, row[lot], begin[lot], end[lot], word)
        for k in np.flatnonzero(row < 0):
            whole, answer = self.masks[int(item[k])]
            length = int(self.answer_size[item[k]] if answers else self.size[item[k]])
            out[k] = common_subsequence(answer if answers else whole, length, hashes[begin[k] : end[k]].tolist())
        return out

    def __call__(self, hashes: np.ndarray, starts: np.ndarray) -> dict[tuple[int, int], tuple[float, float, str]]:
        """(share, cosine, kind) of the best region of each (text, item) that passes the checks."""
        found = list(self.candidates(hashes, starts))
        if not found:
            return {}
        maybe = np.flatnonzero(self.low[hashes & np.uint64(0xFFFF)])
        at = np.minimum(np.searchsorted(self.words, hashes[maybe]), len(self.words) - 1)
        is_known = self.words[at] == hashes[maybe]
        word, known = at[is_known], np.zeros(len(hashes), bool)  # the other words are in no item, nor in a common subsequence
        known[maybe[is_known]] = True
        hashes, before = hashes[known], np.r_[0, np.cumsum(known)]
        text, item, begin, end, cosine = [np.concatenate(x) for x in zip(*found, strict=True)]
        begin, end = before[begin], before[end]
        enough = self._in_item(item, begin, end, word) >= self.needed[item]  # a region of fewer of the item's words doesn't hold it
        text, item, begin, end, cosine = found = [x[enough] for x in (text, item, begin, end, cosine)]
        shared = self._shared(item, begin, end, word, hashes, answers=False)
        ok = shared >= self.needed[item]
        text, item, begin, end, cosine, shared = (x[ok] for x in (*found, shared))
        copy = shared >= COPY * self.size[item]
        answered = self._shared(item, begin, end, word, hashes, answers=True) >= ANSWER * self.answer_size[item]
        best: dict[tuple[int, int], tuple[float, float, str]] = {}
        for k in np.flatnonzero(copy | answered):
            key = int(text[k]), int(item[k])
            now = (float(shared[k] / self.size[item[k]]), float(cosine[k]), "copy" if copy[k] else "paraphrase")
            best[key] = max(best.get(key, now), now)
        return best


def _search(latent: Latent, items: list[Item], key: pa.DataType):
    schema = pa.schema([("doc_id", key), ("item_id", pa.string()), ("cosine", pa.float64()), ("lcs", pa.float64()), ("kind", pa.string())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Search(latent, items)
        for ids, texts in groups(batches):
            hashes, starts = tokens(texts)
            if len(hashes):
                found = sorted(look(hashes, starts).items())
                yield pa.RecordBatch.from_pylist([{"doc_id": ids[t], "item_id": items[k].item_id, "cosine": c, "lcs": s, "kind": kind} for (t, k), (s, c, kind) in found], schema=schema)

    return search


def item_blocks(benchmark: DataFrame) -> Iterator[list[Item]]:
    """The items that have words, in blocks of about ITEM_CHARS characters, however many there are."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").filter("text is not null")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    count = -(-chars // ITEM_CHARS)
    for k in range(count):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k).orderBy("item_id", "text").collect()
        if block := [Item(r["item_id"], w) for r in rows if (w := tokens([r["text"]])[0].tolist())]:
            yield block


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, cosine, lcs and kind of every item that a text holds.

    The benchmark is the stated query set: every window of every text is compared with all of it,
    a block of items after the other, so a task holds one block. Null and empty texts and items
    without words match nothing; items of fewer than 8 words must be there whole. Repeated rows
    give repeated results, null ids null ones; other columns are not read. Empty tables give an
    empty result.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    base = docs.select("doc_id", "text").filter("text is not null")
    kind = base.schema["doc_id"].dataType
    schema = f"doc_id {kind.simpleString()}, {FOUND}"
    out, latent = spark.createDataFrame([], schema), None
    for block in item_blocks(benchmark):
        latent = latent or fit(base)
        out = out.unionByName(base.mapInArrow(_search(latent, block, to_arrow_type(kind)), schema))
    return out


def holds_item(latent: Latent, items: list[Item], text: str = "text") -> Column:
    """Whether a text holds any of the items."""

    def holds(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        look = Search(latent, items)
        for batch in batches:
            found = np.zeros(len(batch), dtype=bool)
            lots = np.cumsum([len(x or "") for x in batch]) // GROUP_CHARS
            for lot in np.split(np.arange(len(batch)), np.flatnonzero(np.diff(lots)) + 1):
                hashes, starts = tokens(batch.iloc[lot].tolist())
                if len(hashes):
                    found[lot[[t for t, _ in look(hashes, starts)]]] = True
            yield pd.Series(found)

    return F.pandas_udf(holds, "boolean")(F.col(text))


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of docs whose text holds no item. The text alone decides, so a null or repeated doc_id
    makes no difference; null and empty texts stay."""
    bounded_batches(docs.sparkSession)
    latent, out = None, docs
    for block in item_blocks(benchmark):
        latent = latent or fit(docs.select("text").filter("text is not null"))
        out = out.filter(~holds_item(latent, block))
    return out
