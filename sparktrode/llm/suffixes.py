"""Removal of long strings that a document with a smaller id holds too, by sorted suffixes.

Every string of WIDTH bytes holds an anchor: of its strings of LEAD bytes the one of least hash, the
first of equal ones. So equal strings hold equal anchors at equal places, and of all suffixes only
those that start at anchors are sorted. Three passes over lots of texts:

1. The hashes of the anchors' first LEAD bytes meet in buckets by hash. What no second document
   has can't repeat and goes.
2. The suffixes at the other anchors are dealt by ranges of their leading 8 bytes; the borders are
   quantiles of a sample. A bucket sorts them by multikey quicksort on words of 8 bytes, takes
   classes of equal prefixes from it and finds for each string around an anchor the smallest id
   that has it. Leading bytes that fill more than one range (borders are equal) are compared
   across those buckets: their strings are grouped by Spark, with sums ahead of the shuffle.
3. Each lot is told what repeats and cuts it out.

Inside a lot equal suffixes are one, so a group of copies is a row a lot.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .lots import LOT_BYTES, Lot, buckets_for, by_bucket, each_lot, lots, pack, total_bytes, unpack, with_replies
from .wordhash import BASE, mixed

WIDTH = 50
LEAD = 16
#: Bytes that an anchor's strings reach in front of it.
BACK = WIDTH - LEAD
#: One anchor in so many is in the sample from which the borders are taken.
SAMPLE = 512
PAD = 0xFF  # in no UTF-8 text
#: Bytes of a bucket, where all anchors repeat.
BUCKET_BYTES = 32 << 20


def _tokens(a: np.ndarray) -> np.ndarray:
    """For each place the 8 bytes from it as a big-endian number."""
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(a, 8)).view(">u8").ravel().astype(np.uint64)


def anchors(lot: Lot) -> tuple[np.ndarray, np.ndarray]:
    """Places of all anchors of a lot, ascending, and the hashes of the LEAD bytes there."""
    places, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for i, j in lot.pieces(1 << 18):
        at, end = lot.starts[i], lot.starts[j]
        if end - at < WIDTH:
            continue
        a = lot.data[at:end]
        tokens = _tokens(a)
        with np.errstate(over="ignore"):
            h = mixed(mixed(tokens[: len(a) - LEAD + 1] * np.uint64(BASE)) + tokens[8 : len(a) - LEAD + 9])
        least, where, span, wide = h, np.arange(len(h), dtype=np.int32), 1, BACK + 1
        while span < wide:  # the first of the least of `span` hashes, doubled
            step = min(span, wide - span)
            left, right = least[:-step], least[step:]
            first = left <= right
            least, where = np.where(first, left, right), np.where(first, where[:-step], where[step:])
            span += step
        starts = lot.starts[i : j + 1] - at
        ends = np.repeat(starts[1:], np.diff(starts))
        inside = np.flatnonzero(np.arange(len(where)) + WIDTH <= ends[: len(where)])
        if len(inside):
            chosen = where[inside]
            own = chosen[np.r_[True, chosen[1:] != chosen[:-1]]]
            places.append(own.astype(np.int64) + at)
            hashes.append(mixed(h[own]))  # the least of many are small: spread over all buckets again
    return np.concatenate(places), np.concatenate(hashes)


def _distinct(hashes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct hashes, whether two texts have each, and each given hash's number among them.

    docs, the text of each hash, ascend.
    """
    order = np.argsort(hashes, kind="stable")
    by = hashes[order]
    new = np.r_[True, by[1:] != by[:-1]][: len(by)]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(by)][: len(first)] - 1
    inverse = np.empty(len(by), dtype=np.int64)
    inverse[order] = np.cumsum(new) - 1
    return by[first], docs[order[first]] != docs[order[last]], inverse


def multikey_order(words: np.ndarray) -> np.ndarray:
    """The order of rows of words: each part that is equal so far is split by the next word.

    Multikey quicksort, all parts of a depth at once; rows that are alone are left where they are.
    """
    n, depth = words.shape
    order = np.argsort(words[:, 0], kind="stable") if depth else np.arange(n)
    part = np.zeros(n, dtype=np.int64)
    for d in range(depth):
        if d:
            open_ = np.flatnonzero(np.r_[False, part[1:] == part[:-1]] | np.r_[part[1:] == part[:-1], False]) if n > 1 else []
            if not len(open_):
                break
            rows = order[open_]
            order[open_] = rows[np.lexsort((words[rows, d], part[open_]))]
        w = words[order, d]
        part = np.cumsum(np.r_[False, (part[1:] != part[:-1]) | (w[1:] != w[:-1])]) if n else part
    return order


def _words(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as big-endian words of 8 bytes, padded at the end."""
    n, width = rows.shape
    full = np.zeros((n, -(-width // 8) * 8), dtype=np.uint8)
    full[:, :width] = rows
    return full.view(">u8").astype(np.uint64)


def _contexts(lot: Lot, places: np.ndarray) -> np.ndarray:
    """For each place the WIDTH bytes from it, then the BACK bytes before it from the nearest on;
    PAD beyond the text."""
    out = np.empty((len(places), WIDTH + BACK), dtype=np.uint8)
    which = np.searchsorted(lot.starts, places, side="right") - 1
    low, high = lot.starts[which], lot.starts[which + 1]
    for k, step in enumerate([*range(WIDTH), *range(-1, -BACK - 1, -1)]):
        at = places + step
        ok = (at >= low) & (at < high)
        out[:, k] = np.where(ok, lot.data[np.where(ok, at, 0)], PAD)
    return out


class _Suffixes:
    """The suffixes of a lot that may repeat: sorted, equal ones once, with the smallest id."""

    def __init__(self, lot: Lot, replies: object) -> None:
        places, hashes = anchors(lot)
        docs = np.searchsorted(lot.starts, places, side="right") - 1
        _, _, inverse = _distinct(hashes, docs)
        told = [np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=x["n"]) for x in (replies if replies is not None else [])]
        repeats = np.concatenate(told).astype(bool) if told else np.zeros(0, bool)
        self.places = places[repeats[inverse]] if len(places) else places
        self.docs = lot.ids[np.searchsorted(lot.starts, self.places, side="right") - 1]
        rows = _contexts(lot, self.places)
        words = _words(rows)
        order = multikey_order(words)
        new = np.r_[True, (words[order[1:]] != words[order[:-1]]).any(axis=1)] if len(order) else np.zeros(0, bool)
        self.number = np.empty(len(order), dtype=np.int64)  # of the class of each place
        self.number[order] = np.cumsum(new) - 1
        self.rows = rows[order[new]]
        self.lead = words[order[new], 0]
        self.least = np.minimum.reduceat(self.docs[order], np.flatnonzero(new)) if len(order) else np.zeros(0, np.int64)


def _valid(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest reach to the left of the strings that lie in the text."""
    ahead = np.where((rows[:, :WIDTH] == PAD).any(axis=1), (rows[:, :WIDTH] == PAD).argmax(axis=1), WIDTH)
    behind = np.where((rows[:, WIDTH:] == PAD).any(axis=1), (rows[:, WIDTH:] == PAD).argmax(axis=1), BACK)
    return WIDTH - ahead, behind


def _repeated(rows: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest reach of each suffix's strings that a smaller id has too; the least
    is above the largest where there is none. All the suffixes that share LEAD bytes must be here."""
    n = len(rows)
    order = multikey_order(_words(rows[:, :WIDTH]))
    back = multikey_order(_words(rows[:, WIDTH:]))

    def shared(sorted_rows: np.ndarray) -> np.ndarray:
        differ = sorted_rows[1:] != sorted_rows[:-1]
        return np.where(differ.any(axis=1), differ.argmax(axis=1), sorted_rows.shape[1])

    ahead, behind = shared(rows[order][:, :WIDTH]), shared(rows[back][:, WIDTH:])
    low, high = _valid(rows)
    first, last = np.full(n, BACK + 1), np.full(n, -1)
    right, left = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    for reach in range(BACK + 1):
        right[order] = np.r_[0, np.cumsum(ahead < WIDTH - reach)]
        left[back] = np.r_[0, np.cumsum(behind < reach)]
        key = right * n + left
        by = np.argsort(key, kind="stable")
        new = np.r_[True, key[by[1:]] != key[by[:-1]]]
        least = np.empty(n, dtype=np.int64)
        least[by] = np.minimum.reduceat(ids[by], np.flatnonzero(new))[np.cumsum(new) - 1]
        hit = (least < ids) & (low <= reach) & (reach <= high)
        first[hit] = np.minimum(first[hit], reach)
        last[hit] = reach
    return first, last


def repeated_leads(table: DataFrame, n_buckets: int) -> DataFrame:
    """(lot, bucket, n, bits): for each lot's distinct anchor hashes of a bucket, in order, whether
    another document has it."""

    def send(lot: Lot, row: object) -> pd.DataFrame:
        places, hashes = anchors(lot)
        values, twice, _ = _distinct(hashes, np.searchsorted(lot.starts, places, side="right") - 1)
        edges = by_bucket(values, n_buckets)
        low = values.view(np.uint8).reshape(-1, 8)[:, :6]  # with the bucket enough of the hash
        out = []
        for b in np.flatnonzero(np.diff(edges)):
            i, j = edges[b], edges[b + 1]
            out.append((int(b), lot.number, int(j - i), low[i:j].tobytes() + np.packbits(twice[i:j]).tobytes()))
        return pd.DataFrame(out, columns=["bucket", "lot", "n", "held"])

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        values, twice = [], []
        for n, held in zip(pdf["n"], pdf["held"], strict=True):
            raw = np.frombuffer(held, np.uint8)
            full = np.zeros((n, 8), np.uint8)
            full[:, :6] = raw[: 6 * n].reshape(n, 6)
            values.append(full.view(np.uint64).ravel())
            twice.append(np.unpackbits(raw[6 * n :], count=n).astype(bool))
        _, inverse, counts = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
        repeats = (counts[inverse] > 1) | np.concatenate(twice)
        parts = np.split(repeats, np.cumsum(pdf["n"])[:-1])
        return pdf[["lot", "bucket", "n"]].assign(bits=[np.packbits(x).tobytes() for x in parts])

    sent = each_lot(table, send, "bucket int, lot long, n int, held binary")
    return sent.groupBy("bucket").applyInPandas(meet, "lot long, bucket int, n int, bits binary")


def borders(table: DataFrame, n_buckets: int) -> np.ndarray:
    """Quantiles of the leading 8 bytes, less the last bit, of a sample of all anchors."""

    def sample(lot: Lot, row: object) -> pd.DataFrame:
        places, _ = anchors(lot)
        chosen = places[(lot.number % SAMPLE) :: SAMPLE]
        words = _words(_contexts(lot, chosen)[:, :8])[:, 0] if len(chosen) else np.zeros(0, np.uint64)
        return pd.DataFrame({"lead": (words >> np.uint64(1)).astype(np.int64)})

    at = [(k + 1) / n_buckets for k in range(n_buckets - 1)]
    found = each_lot(table, sample, "lead long").agg(F.percentile_approx("lead", at, 10_000)).first()[0] if at else None
    return np.array(found or [], dtype=np.int64)


def repeated_suffixes(joined: DataFrame, edges: np.ndarray) -> DataFrame:
    """(lot, start, reach): for a lot's suffixes from the number `start` on the least reaches, then
    the largest, a byte each. joined: lots with the replies of `repeated_leads`."""
    hot = np.unique(edges[1:][edges[1:] == edges[:-1]])  # leading bytes that fill more than a range

    def deal(lot: Lot, row: object) -> pd.DataFrame:
        s = _Suffixes(lot, row.replies)
        lead = (s.lead >> np.uint64(1)).astype(np.int64)
        bucket = np.where(np.isin(lead, hot), -1, np.searchsorted(edges, lead, side="right"))
        cuts = np.r_[0, np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(bucket)] if len(bucket) else np.zeros(1, int)
        out = [(int(bucket[i]), lot.number, int(i), int(j - i), pack(s.rows[i:j].tobytes() + s.least[i:j].tobytes())) for i, j in zip(cuts[:-1], cuts[1:], strict=True) if bucket[i] >= 0]
        return pd.DataFrame(out, columns=["bucket", "lot", "start", "n", "held"])

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, ids = [], []
        for n, held in zip(pdf["n"], pdf["held"], strict=True):
            raw = unpack(held)
            rows.append(raw[: n * (WIDTH + BACK)].reshape(n, -1))
            ids.append(raw[n * (WIDTH + BACK) :].view(np.int64))
        first, last = _repeated(np.concatenate(rows), np.concatenate(ids))
        ends = np.cumsum(pdf["n"])
        reach = [np.r_[first[e - n : e], last[e - n : e]].astype(np.int8).tobytes() for e, n in zip(ends, pdf["n"], strict=True)]
        return pdf[["lot", "start"]].assign(reach=reach)

    def strings(lot: Lot, row: object) -> pd.DataFrame:
        s = _Suffixes(lot, row.replies)
        out = []
        low, high = _valid(s.rows)
        for k in np.flatnonzero(np.isin((s.lead >> np.uint64(1)).astype(np.int64), hot)):
            line = np.r_[s.rows[k, WIDTH:][::-1], s.rows[k, :WIDTH]]
            out += [(line[BACK - r : BACK - r + WIDTH].tobytes(), int(s.least[k]), lot.number, int(k), r) for r in range(low[k], high[k] + 1)]
        return pd.DataFrame(out, columns=["string", "id", "lot", "start", "r"])

    dealt = each_lot(joined, deal, "bucket int, lot long, start int, n int, held binary")
    reaches = dealt.groupBy("bucket").applyInPandas(meet, "lot long, start int, reach binary")
    if not len(hot):
        return reaches
    across = each_lot(joined, strings, "string binary, id long, lot long, start int, r int")
    least = across.groupBy("string").agg(F.min("id").alias("least"))
    found = across.join(least, "string").filter("least < id").groupBy("lot", "start").agg(F.min("r").alias("a"), F.max("r").alias("b"))
    byte = lambda c: F.unhex(F.lpad(F.hex(c), 2, "0"))
    return reaches.unionByName(found.select("lot", "start", F.concat(byte("a"), byte("b")).alias("reach")))


def remove_repeats(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES, lot_bytes: int = LOT_BYTES) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): each text without the bytes that any string of WIDTH bytes
    covers which a document with a smaller id holds too.

    spans are the removed runs as (start, end) in bytes; kept is what is left, which may cut a
    character. A null text counts as empty, a missing id as larger than all others, and ids must be
    integers; rows that repeat an id are not compared with each other. Strings are judged on the
    input. Texts of fewer than WIDTH bytes lose nothing, an empty table gives no rows, and other
    columns are left out. A row is returned for each row.
    """
    table = lots(docs, size=lot_bytes)
    size = total_bytes(table)
    leads = written(repeated_leads(table, buckets_for(table, size * 6 / (BACK + 2) * 2, bucket_bytes)), "leads")
    joined = with_replies(table, leads)
    found = written(repeated_suffixes(joined, borders(table, buckets_for(table, size * (WIDTH + BACK + 8) * 2 / (BACK + 2), bucket_bytes))), "suffixes")
    told = with_replies(joined.withColumnRenamed("replies", "leads"), found, "start")

    def cut(lot: Lot, row: object) -> pd.DataFrame:
        s = _Suffixes(lot, row.leads)
        first, last = np.full(len(s.rows), BACK + 1), np.full(len(s.rows), -1)
        for x in row.replies if row.replies is not None else []:
            a, b = np.frombuffer(x["reach"], np.int8).reshape(2, -1)
            first[x["start"] : x["start"] + len(a)], last[x["start"] : x["start"] + len(b)] = a, b
        low, high = _valid(s.rows)
        again = s.docs > s.least[s.number]  # a smaller id of this very lot has all its strings
        first, last = np.where(again, low[s.number], first[s.number]), np.where(again, high[s.number], last[s.number])
        hit = first <= last
        change = np.zeros(len(lot.data) + 1, dtype=np.int32)
        np.add.at(change, s.places[hit] - last[hit], 1)
        np.add.at(change, s.places[hit] - first[hit] + WIDTH, -1)
        gone = np.cumsum(change[:-1]) > 0
        spans, kept = [], []
        for i, j in zip(lot.starts[:-1], lot.starts[1:], strict=True):
            mine = gone[i:j]
            edge = np.flatnonzero(np.diff(np.r_[False, mine, False].astype(np.int8)))
            spans.append([{"start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)])
            kept.append(lot.data[i:j][~mine].tobytes())
        return pd.DataFrame({"doc_id": lot.doc_ids(), "n_bytes": np.diff(lot.starts), "spans": spans, "kept": kept})

    return each_lot(told, cut, "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")


def repeat_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of `remove_repeats`."""
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return remove_repeats(docs).select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
