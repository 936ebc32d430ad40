"""Alignment of two tokenizers on the same texts, and the counts of token pairs that end together.

The libraries' spans (characters of the byte-level tokenizer, bytes of the piece tokenizer) are
coarse cuts. Tokens that share a character, or have an empty span, are cut by the bytes that they
decode to. Where tokens of both end, one of each is linked and a group of tokens ends.

The counts of pairs over the corpus come back to each lot of texts by an equal join: a lot sends its
distinct pairs with their counts to buckets, which add them up. Only the highest count of each piece
goes through the driver; it is bounded by the vocabulary.
"""

from __future__ import annotations

import dataclasses
import functools
import hashlib
import itertools
import os
import re
from operator import attrgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .lots import NO_ID, Lot, buckets_for, by_bucket, each_lot, lots, pack, unpack, with_replies
from .wordhash import mixed

BYTE_MODEL = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of texts that are encoded at once.
ENCODE_BYTES = 1 << 18
#: Words of a lot that are encoded as one text, and bytes of texts in a lot: the longer, the more
#: texts share a word.
JOINED, ALIGNED_BYTES = 64, 12 << 20
_ID_AND_END = attrgetter("id", "end")
_BLOBS = ["pairs", "counts", "words", "links", "word_counts", "link_counts"]


class Vocabulary:
    """The bytes of each token, as one run of bytes with starts."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.lengths = np.array([len(x) for x in tokens], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(tokens) or b"\0", dtype=np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        n = self.lengths[ids]
        return self.flat[np.repeat(self.starts[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves,
    the others in order from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


@functools.lru_cache(maxsize=2)
def byte_tokenizer(path: str) -> tuple[object, Vocabulary]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer, letters = Tokenizer.from_file(path), _byte_letters()
    tokenizer.encode_special_tokens = True  # their strings in a text are plain text
    names = {i: x for x, i in tokenizer.get_vocab().items()}
    size = max(names) + 1
    return tokenizer, Vocabulary([bytes(letters[c] for c in names[i]) if i in names and all(c in letters for c in names[i]) else b"" for i in range(size)])


@functools.lru_cache(maxsize=2)
def piece_tokenizer(path: str) -> tuple[object, Vocabulary]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    tokens = [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in range(size)]
    return model, Vocabulary(tokens)


def refined(coarse: np.ndarray, clear: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Byte ends of tokens: the coarse end where it is clear, else from the last clear end before on
    by the bytes that the tokens decode to."""
    decoded = np.cumsum(lengths)
    last = np.maximum.accumulate(np.where(clear, np.arange(len(coarse)), -1))
    base = np.where(last >= 0, coarse[last] - decoded[last], 0)
    return np.where(clear, coarse, decoded + base)


@dataclasses.dataclass
class Encoded:
    """Tokens of both tokenizers for texts laid end to end, each after a space: ids, byte ends, and
    how many each text has. Texts that a tokenizer doesn't give back are bad and have none."""

    a: np.ndarray
    a_ends: np.ndarray
    a_sizes: np.ndarray
    b: np.ndarray
    b_ends: np.ndarray
    b_sizes: np.ndarray
    bad: np.ndarray


def _flat(rows: list, count: int) -> np.ndarray:
    return np.fromiter(itertools.chain.from_iterable(rows), dtype=np.int64, count=count)


def _given_back(ids: np.ndarray, sizes: np.ndarray, words: Vocabulary, raw: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether each text's tokens decode to its very bytes."""
    of = np.repeat(np.arange(len(sizes)), sizes)
    same = np.bincount(of, weights=words.lengths[ids], minlength=len(sizes)) == lengths
    there = np.repeat(same, lengths)
    differ = words.joined(ids[same[of]]) != raw[there]
    wrong = np.bincount(np.repeat(np.arange(len(sizes)), lengths)[there], weights=differ, minlength=len(sizes)) > 0
    return same & ~wrong


def encode(texts: list[str], byte_model: str = BYTE_MODEL, piece_model: str = PIECE_MODEL) -> Encoded:
    """Both encodings of each text after a space."""
    (a_model, a_words), (b_model, b_words) = byte_tokenizer(byte_model), piece_tokenizer(piece_model)
    spaced = [" " + x for x in texts]
    data = [x.encode() for x in spaced]
    raw, lengths = np.frombuffer(b"".join(data), dtype=np.uint8), np.array([len(x) for x in data], dtype=np.int64)
    base = np.cumsum(lengths) - lengths
    chars = np.array([len(x) for x in spaced], dtype=np.int64)
    first_bytes = np.r_[np.flatnonzero((raw & 0xC0) != 0x80), len(raw)]  # of characters

    left = a_model.encode_batch(spaced, add_special_tokens=False)
    rows = [x.ids for x in left]
    a_sizes = np.array([len(x) for x in rows], dtype=np.int64)
    a = _flat(rows, int(a_sizes.sum()))
    spans = _flat(itertools.chain.from_iterable(x.offsets for x in left), 2 * len(a)).reshape(-1, 2) + np.repeat(np.cumsum(chars) - chars, a_sizes)[:, None]
    start, end = spans[:, 0], spans[:, 1]
    clear = np.r_[start[1:] >= end[:-1], True][: len(a)] & (end > start)  # shares no character with the next
    a_ends = refined(first_bytes[end], clear, a_words.lengths[a])

    pieces = [x.pieces for x in b_model.encode(texts, return_type="proto")]
    b_sizes = np.array([len(x) for x in pieces], dtype=np.int64)
    both = _flat(map(_ID_AND_END, itertools.chain.from_iterable(pieces)), 2 * int(b_sizes.sum())).reshape(-1, 2)
    b, end = both[:, 0], both[:, 1]
    opens = np.zeros(len(b), bool)
    opens[(np.cumsum(b_sizes) - b_sizes)[b_sizes > 0]] = True
    clear = opens | (np.r_[True, end[1:] > end[:-1]][: len(b)])
    clear[:-1] &= opens[1:] | (end[1:] > end[:-1])  # a byte piece's span may be that of its whole character
    b_ends = refined(end + 1 + np.repeat(base, b_sizes), clear, b_words.lengths[b])

    bad = ~(_given_back(a, a_sizes, a_words, raw, lengths) & _given_back(b, b_sizes, b_words, raw, lengths)) | (chars == 1)
    kept_a, kept_b = np.repeat(~bad, a_sizes), np.repeat(~bad, b_sizes)
    return Encoded(a[kept_a], a_ends[kept_a], np.where(bad, 0, a_sizes), b[kept_b], b_ends[kept_b], np.where(bad, 0, b_sizes), bad)


def encode_words(words: list[str], byte_model: str = BYTE_MODEL, piece_model: str = PIECE_MODEL) -> Encoded:
    """As `encode`, of words that neither begin nor end with white space: joined by spaces they are
    cut where both tokenizers end a token, so JOINED of them are encoded as one text. Should one not
    be given back, or a token reach over a cut, each is encoded alone."""
    whole = encode([" ".join(words[k : k + JOINED]) for k in range(0, len(words), JOINED)], byte_model, piece_model)
    ends = np.cumsum([len(x.encode()) + 1 for x in words])
    a, b = (np.searchsorted(x, ends, side="right") for x in (whole.a_ends, whole.b_ends))
    if whole.bad.any() or not (np.array_equal(whole.a_ends[a - 1], ends) and np.array_equal(whole.b_ends[b - 1], ends)):
        return encode(words, byte_model, piece_model)
    return dataclasses.replace(whole, a_sizes=np.diff(a, prepend=0), b_sizes=np.diff(b, prepend=0), bad=np.zeros(len(words), bool))


@functools.lru_cache(maxsize=1)
def _decimals(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Digits of the numbers below size, a row each, and how many there are."""
    names = [str(i).encode() for i in range(size)]
    width = len(names[-1])
    return np.frombuffer(b"".join(x.ljust(width) for x in names), np.uint8).reshape(size, width), np.array([len(x) for x in names])


def group_text(a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray, common: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Groups as a1,a2|b1;a3|b2,b3 in decimals, and where each of them ends."""
    ga, gb = np.searchsorted(common, a_ends), np.searchsorted(common, b_ends)
    n = len(common)
    before_b = np.r_[0, np.cumsum(np.bincount(gb, minlength=n))]
    before_a = np.r_[0, np.cumsum(np.bincount(ga, minlength=n))]
    at_a, at_b = np.arange(len(a)) + before_b[ga], np.arange(len(b)) + before_a[gb + 1]
    ids, marks = np.empty(len(a) + len(b), np.int64), np.empty(len(a) + len(b), np.uint8)
    ids[at_a], ids[at_b] = a, b
    marks[at_a] = np.where(np.r_[True, ga[1:] != ga[:-1]], ord(";"), ord(","))
    marks[at_b] = np.where(np.r_[True, gb[1:] != gb[:-1]], ord("|"), ord(","))
    digits, lengths = _decimals(1 << 17)
    size = lengths[ids]
    start = np.cumsum(size + 1) - size - 1
    out = np.empty(int(size.sum()) + len(ids), np.uint8)
    out[start] = marks
    for d in range(int(size.max(initial=0))):
        has = size > d
        out[start[has] + 1 + d] = digits[ids[has], d]
    last = before_a[1:] + before_b[1:] - 1  # of the tokens of each group
    return out[1:].tobytes(), start[last] + size[last]


def _split_at(piece_model: str) -> re.Pattern | None:
    """Where both tokenizers always end a token: at a space between characters that aren't white.

    So for the byte tokenizer, whose words hold a space at their start only; so for the pieces if
    none holds a space behind another character.
    """
    model, _ = piece_tokenizer(piece_model)
    whole = all("▁" not in model.id_to_piece(i).lstrip("▁") for i in range(model.get_piece_size()))
    return re.compile(r"(?<=\S) (?=\S)") if whole else None


def align_lots(table: DataFrame, byte_model: str = BYTE_MODEL, piece_model: str = PIECE_MODEL) -> DataFrame:
    """A row a lot: lot, ids, n_a, n_b, n_links and shas of its texts; pairs, its distinct (byte id <<
    32 | piece id), ascending, with their counts; and words, those of each text one after the other,
    with each word's links, as places among the pairs, and how many words a text and links a word has.

    A word is what lies between two places where both tokenizers end a token anyway, so its groups are
    the same in any text, and each distinct word of a lot is encoded once.
    """

    def work(lot: Lot, row: object) -> pd.DataFrame:
        n, number, held = len(lot.ids), {}, []
        split = _split_at(piece_model)
        for i, j in zip(lot.starts[:-1], lot.starts[1:], strict=True):
            text = lot.data[i:j].tobytes().decode()
            parts = split.split(text) if split and text else [text] if text else []
            held.append([number.setdefault(x, len(number)) for x in parts])
        joins = lambda x: bool(x) and not (x[0].isspace() or x[-1].isspace())
        words = sorted(number, key=joins, reverse=True) if split else list(number)
        joined = sum(map(joins, words)) if split else 0
        place, i = {x: k for k, x in enumerate(words)}, 0
        place = np.array([place[x] for x in number], dtype=np.int64)  # of the words in the order met
        groups, sizes, keys = [], np.zeros((3, len(words)), np.int64), [np.zeros(0, np.int64)]
        bad = np.zeros(len(words), bool)
        while i < len(words):
            j, size = i, 0
            while j < (joined if i < joined else len(words)) and size < ENCODE_BYTES:
                size, j = size + len(words[j]) + 8, j + 1
            x = (encode_words if i < joined else encode)(words[i:j], byte_model, piece_model)
            common, at_a, at_b = np.intersect1d(x.a_ends, x.b_ends, assume_unique=True, return_indices=True)
            word_of = np.repeat(np.arange(i, j), x.a_sizes)[at_a]
            sizes[0, i:j], sizes[1, i:j], sizes[2, i:j], bad[i:j] = x.a_sizes, x.b_sizes, np.bincount(word_of - i, minlength=j - i), x.bad
            keys.append((x.a[at_a] << 32) | x.b[at_b])
            text, ends = group_text(x.a, x.a_ends, x.b, x.b_ends, common)
            last = np.cumsum(sizes[2, i:j])
            cuts = np.r_[0, ends][last].tolist()  # where each word's groups end; a ; follows
            groups += [text[low + (low > 0) : high] for low, high in zip([0, *cuts], cuts, strict=False)]
            i = j
        lengths = np.array([len(x) for x in held], dtype=np.int64)
        flat = place[_flat(held, int(lengths.sum()))]
        held = [x.tolist() for x in np.split(flat, np.cumsum(lengths)[:-1])]
        of = np.repeat(np.arange(n), lengths)
        whole = np.bincount(of, weights=bad[flat], minlength=n) == 0
        used = flat[whole[of]]
        per_text = [np.where(whole, np.bincount(of, weights=s[flat], minlength=n), 0).astype(np.int64) for s in sizes]
        shas = [hashlib.sha256(b";".join([groups[k] for k in own])).hexdigest() if own and ok else "" for own, ok in zip(held, whole, strict=True)]
        every = np.concatenate(keys)
        seen = np.repeat(np.bincount(used, minlength=len(words)), sizes[2])  # how often each word's links occur
        pairs, links = np.unique(every[seen > 0], return_inverse=True)
        counts = np.bincount(links, weights=seen[seen > 0], minlength=len(pairs)).astype(np.int64)
        occurs = np.bincount(used, minlength=len(words)) > 0
        renumber = np.cumsum(occurs) - 1
        blobs = [pairs, counts, renumber[used].astype(np.uint32), links.astype(np.uint32), np.where(whole, lengths, 0).astype(np.uint32), sizes[2][occurs].astype(np.uint32)]
        data = [lot.number, lot.ids, *per_text, shas, *[pack(x.tobytes()) for x in blobs]]
        return pd.DataFrame([data], columns=["lot", "ids", "n_a", "n_b", "n_links", "shas", *_BLOBS])

    arrays = ", ".join(f"{c} array<long>" for c in ("ids", "n_a", "n_b", "n_links"))
    return written(each_lot(table, work, f"lot long, {arrays}, shas array<string>, {', '.join(f'{c} binary' for c in _BLOBS)}"), "aligned")


def _numbers(blob: bytes, dtype: type = np.int64) -> np.ndarray:
    return unpack(blob).view(dtype)


def pair_totals(aligned: DataFrame, n_buckets: int) -> DataFrame:
    """(lot, bucket, totals): the corpus-wide counts of each lot's pairs of a bucket, in order of the
    pairs' hashes; with lot null the bucket's highest count of each piece, as (piece, count)."""

    def send(frames):
        for pdf in frames:
            for row in pdf.itertuples(index=False):
                pairs, counts = _numbers(row.pairs), _numbers(row.counts)
                order = np.argsort(h := mixed(pairs.view(np.uint64)))
                edges = by_bucket(h[order], n_buckets)
                pairs, counts = pairs[order], counts[order]
                out = [(int(b), row.lot, int(edges[b + 1] - edges[b]), pack(np.r_[pairs[edges[b] : edges[b + 1]], counts[edges[b] : edges[b + 1]]].tobytes())) for b in np.flatnonzero(np.diff(edges))]
                yield pd.DataFrame(out, columns=["bucket", "lot", "n", "held"])

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        held = [_numbers(x).reshape(2, -1) for x in pdf["held"]]
        pairs, inverse = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
        total = np.zeros(len(pairs), np.int64)
        np.add.at(total, inverse, np.concatenate([x[1] for x in held]))
        parts = np.split(total[inverse], np.cumsum(pdf["n"])[:-1])
        piece, at = np.unique(pairs & 0xFFFFFFFF, return_inverse=True)
        best = np.zeros(len(piece), np.int64)
        np.maximum.at(best, at, total)
        own = pd.DataFrame({"lot": pd.array([None], dtype="Int64"), "bucket": pdf["bucket"].iloc[:1].to_numpy(), "totals": [pack(np.r_[piece, best].tobytes())]})
        return pd.concat([pdf[["lot", "bucket"]].astype({"lot": "Int64"}).assign(totals=[pack(x.tobytes()) for x in parts]), own])

    sent = aligned.select("lot", "pairs", "counts").mapInPandas(send, "bucket int, lot long, n int, held binary")
    return sent.groupBy("bucket").applyInPandas(meet, "lot long, bucket int, totals binary")


def best_counts(totals: DataFrame) -> dict[int, int]:
    """The highest count of each piece; no more entries than the vocabulary has."""

    def rows(frames):
        for pdf in frames:
            for x in pdf["totals"]:
                piece, best = _numbers(x).reshape(2, -1)
                yield pd.DataFrame({"piece": piece, "best": best})

    found = totals.filter("lot is null").select("totals").mapInPandas(rows, "piece long, best long")
    return dict(found.groupBy("piece").agg(F.max("best")).toPandas().itertuples(index=False, name=None))


def align_documents(docs: DataFrame, byte_model: str = BYTE_MODEL, piece_model: str = PIECE_MODEL) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for each row.

    A group has one link, that of the tokens at its end. n_best counts links whose pair is their
    piece's most frequent in the corpus, ties included; count_sum adds the pairs' counts over the
    links. Texts that are null or empty, or that a tokenizer doesn't give back, have zeros and an
    empty digest. Rows that repeat an id are rows of their own, an empty table gives no rows, other
    columns are left out, and ids must be integers.
    """
    aligned = align_lots(lots(docs, size=ALIGNED_BYTES), byte_model, piece_model)
    size = aligned.agg(F.sum(F.length("pairs") + F.length("counts"))).first()[0] or 0
    totals = written(pair_totals(aligned, buckets_for(aligned, size)), "totals")
    best = best_counts(totals)
    told = with_replies(aligned, totals.filter("lot is not null"))

    def finish(frames):
        top = np.zeros(max(best, default=0) + 1, np.int64)
        top[list(best)] = list(best.values())
        for pdf in frames:
            for row in pdf.itertuples(index=False):
                pairs, links = _numbers(row.pairs), _numbers(row.links, np.uint32)
                words, of_text, of_word = (_numbers(x, np.uint32) for x in (row.words, row.word_counts, row.link_counts))
                total = np.zeros(len(pairs), np.int64)
                if len(pairs):
                    total[np.argsort(mixed(pairs.view(np.uint64)))] = np.concatenate([_numbers(x["totals"]) for x in row.replies])
                is_best = total == top[pairs & 0xFFFFFFFF] if len(pairs) else np.zeros(0, bool)
                ranges = lambda sizes: np.r_[0, np.cumsum(sizes, dtype=np.int64)]
                sums = lambda x, sizes: np.diff(np.r_[0, np.cumsum(x, dtype=np.int64)][ranges(sizes)])
                add = lambda x: sums(sums(x[links], of_word)[words], of_text)
                ids = np.asarray(row.ids)
                yield pd.DataFrame({
                    "doc_id": pd.Series(ids, dtype="Int64").mask(ids == NO_ID), "n_a": row.n_a, "n_b": row.n_b, "n_groups": row.n_links, "n_links": row.n_links,
                    "n_best": add(is_best.astype(np.int64)), "count_sum": add(total), "groups_sha256": row.shas,
                })

    longs = ", ".join(f"{c} long" for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"))
    return told.mapInPandas(finish, f"{longs}, groups_sha256 string")
