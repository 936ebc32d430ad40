"""Alignment, phrases and suffixes against brute force, on small and on odd rows."""

import collections
import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparktrode.llm import alignment, lots, phrases, registry, suffixes
from sparktrode.llm.common import table

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, lot long, extra string, n long, spans string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows and ids, and columns with clashing names."""
    rng = random.Random(1)
    base = ["".join(rng.choice("ab cé.") for _ in range(rng.randrange(20, 300))) for _ in range(8)]
    texts = [None, "", " ", "é漢字🙂", "a", "ab" * 200, "ab" * 90, "a" * 300, "a" * 50, "a" * 49, "<s> <|endoftext|> x", "▁a", "龘\x00\tz\n\n", *base, base[0], base[1] + base[2], base[0].upper(), "long " * 30000]
    rows = [(i, t, ["en", "de", None, ""][i % 4], "s", 1, "x", 1, "y") for i, t in enumerate(texts)]
    rows += [(None, base[0], "en", "s", 1, "x", 1, "y"), (None, base[0], "en", "s", 1, "x", 1, "y"), (3, base[3], "de", None, None, None, None, None), (3, base[3], "de", None, None, None, None, None), (-5, base[4], None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def plain(rows):
    return sorted((tuple(r) for r in rows), key=str)


def cut_by_hand(rows, width=suffixes.WIDTH):
    order = lambda i: float("inf") if i is None else i
    least, out = {}, []
    for i, text in rows:
        b = (text or "").encode()
        for p in range(len(b) - width + 1):
            least[b[p : p + width]] = min(least.get(b[p : p + width], float("inf")), order(i))
    for i, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - width + 1):
            if least[b[p : p + width]] < order(i):
                gone[p : p + width] = b"\1" * width
        runs = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(gone)))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def digests(cut):
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return plain(cut.select("doc_id", "n_bytes", removed, F.size("spans").cast("long"), F.sha2("kept", 256)).collect())


@pytest.mark.parametrize("sizes", [(lots.LOT_BYTES, suffixes.BUCKET_BYTES), (2000, 3000), (1500, 200)])
def test_suffixes_equal_brute_force(spark, odd, empty, sizes):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert digests(suffixes.remove_repeats(odd, lot_bytes=sizes[0], bucket_bytes=sizes[1])) == cut_by_hand(rows)
    assert suffixes.remove_repeats(empty).collect() == []


@pytest.mark.parametrize("seed", [2, 3])
def test_suffixes_equal_brute_force_on_shared_passages(spark, seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("ab cé") for _ in range(rng.randrange(20, 400))) for _ in range(6)]
    rows = []
    for i in range(120):
        text = ""
        for _ in range(rng.randrange(5)):
            part = rng.choice(base)
            at = rng.randrange(len(part))
            text += part[at : at + rng.randrange(30, 120)] if rng.random() < 0.6 else "".join(rng.choice("ab cé") for _ in range(rng.randrange(60)))
        rows.append((i, text))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert digests(suffixes.remove_repeats(docs, lot_bytes=3000, bucket_bytes=1000)) == cut_by_hand(rows)


def test_suffixes_of_one_hot_passage_are_compared_across_buckets(spark, monkeypatch):
    """All texts share a passage: the borders are equal, so its strings meet in Spark's grouping."""
    seen = []
    monkeypatch.setattr(suffixes, "borders", lambda table, n: (seen.append(1), np.sort(np.r_[leads, leads]))[1])
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdefg ") for _ in range(90))
    rows = [(i, "".join(rng.choice("xyz") for _ in range(rng.randrange(40))) + passage[rng.randrange(20) :] + str(i)) for i in range(60)]
    raw = passage.encode()
    leads = np.array([int.from_bytes(raw[k : k + 8], "big") >> 1 for k in range(0, len(raw) - 8)], dtype=np.int64)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert digests(suffixes.remove_repeats(docs, lot_bytes=500)) == cut_by_hand(rows) and seen


def test_multikey_order_sorts_rows_of_words():
    rng = np.random.default_rng(0)
    for depth, span in ((1, 5), (3, 3), (7, 2)):
        words = rng.integers(0, span, (500, depth)).astype(np.uint64)
        order = suffixes.multikey_order(words)
        assert sorted(order) == list(range(500)) and [tuple(r) for r in words[order]] == sorted(tuple(r) for r in words)
    assert len(suffixes.multikey_order(np.zeros((0, 3), np.uint64))) == 0


def test_every_string_holds_an_anchor_at_the_same_place():
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(97, 100, n).astype(np.uint8)) for n in (0, 10, 49, 50, 51, 300, 1000)] + [b"a" * 200, b"ab" * 100]
    texts += [b"q" * 30 + texts[5][100:160] + b"r" * 30]
    lot = lots.Lot(0, np.arange(len(texts)), np.r_[0, np.cumsum([len(t) for t in texts])], np.frombuffer(b"".join(texts), np.uint8))
    places, _ = suffixes.anchors(lot)
    held = set(places.tolist())
    where = {}
    for start, text in zip(lot.starts, texts, strict=False):
        for p in range(len(text) - suffixes.WIDTH + 1):
            inside = [k for k in range(suffixes.BACK + 1) if start + p + k in held]
            assert inside
            where.setdefault(text[p : p + suffixes.WIDTH], []).append(inside)
    assert all(set.intersection(*map(set, x)) for x in where.values())


def phrases_by_hand(rows, least=phrases.MIN_COUNT, top=phrases.TOP):
    found, total, out = collections.defaultdict(collections.Counter), collections.Counter(), []
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate({c: c + 32 for c in range(65, 91)})):
            w = [x for x in re.split("[ \t]", piece) if x]
            total[lang] += len(w)
            for k in range(1, 5):
                found[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    for lang, f in found.items():
        often = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = collections.defaultdict(int)
        for p, a in often.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i : i + m]] = max(inside[p[i : i + m]], a)
        ranked = []
        for p, a in often.items():
            if not (p in inside and 100 * inside[p] >= 80 * a):
                s, _, left, right = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                ranked.append((-s, -a, " ".join(p).encode(), left, right))
        out += [(lang, r, x[2].decode(), -x[1], x[3], x[4], total[lang], -x[0]) for r, x in enumerate(sorted(ranked)[:top], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [None, 4000])
def test_phrases_equal_brute_force(spark, odd, empty, size):
    rng = random.Random(3)
    voc = ["a", "B", "the", "of", "éa", "x1", "-", "Ab", " n"]
    rows = [(i, "".join(rng.choice(voc) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ", ", "\n"]) for _ in range(rng.randrange(200))), rng.choice(["en", "de", None, ""])) for i in range(250)]
    docs = odd.select("doc_id", "text", "lang", "lot", "n").unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string"), allowMissingColumns=True)
    want = phrases_by_hand([(r["text"], r["lang"]) for r in docs.collect()])
    assert plain(phrases.rank_phrases(phrases.phrase_counts(docs, lot_bytes=size)).collect()) == want and len(want) > 100
    assert phrases.collocations(empty).collect() == []


def test_phrases_take_the_top_of_each_language(spark):
    text = " ".join(f"w{i % 7} v{i % 5}" for i in range(3000))
    docs = spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string")
    counts = phrases.phrase_counts(docs)
    assert plain(phrases.rank_phrases(counts, 5).collect()) == phrases_by_hand([(text, "en")], top=5)


def test_colliding_fingerprints_are_told_apart_by_text(spark, monkeypatch):
    """With two fingerprints for all words and phrases only the texts can tell them apart."""
    monkeypatch.setattr(phrases.Words, "fingerprints", lambda self, at, n: self.hashes[at] % np.uint64(2))
    rng = random.Random(5)
    text = " ".join(rng.choice("abc") for _ in range(900))
    lot = lots.Lot(0, np.array([1]), np.array([0, len(text)]), np.frombuffer(text.encode(), np.uint8), np.array(["en"], dtype=object))
    words = phrases.Words(lot)
    words.hashes = words.hashes % np.uint64(2)
    number = words.distinct()
    spelled = words.spelled(np.arange(len(number)), 1).to_pylist()
    assert len(set(zip(number.tolist(), spelled, strict=True))) == len(set(spelled)) == 3
    at = words.places(2)
    own = phrases.classes(words.fingerprints(at, 2), lambda a, b: (number[at[a]] == number[at[b]]) & (number[at[a] + 1] == number[at[b] + 1]))
    assert len(set(own.tolist())) == len({text[2 * i : 2 * i + 3] for i in at}) == 9


def aligned_by_hand(rows):
    a_model, b_model = Tokenizer.from_file(alignment.BYTE_MODEL), sentencepiece.SentencePieceProcessor(model_file=alignment.PIECE_MODEL)
    a_model.encode_special_tokens = True
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letter = {chr(b): b for b in printable}
    for b in range(256):
        if b not in printable:
            letter[chr(256 + len(letter) - len(printable))] = b
    docs, count = [], collections.Counter()
    for i, text in rows:
        a, b, links, sha = [], [], [], ""
        if text:
            a, b = a_model.encode(" " + text, add_special_tokens=False).ids, b_model.encode(text)
            a_bytes = [bytes(letter[c] for c in a_model.id_to_token(x)) for x in a]
            b_bytes = [bytes([int(b_model.id_to_piece(x)[3:5], 16)]) if b_model.is_byte(x) else b_model.id_to_piece(x).replace("▁", " ").encode() for x in b]
            if not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
                a, b = [], []
        if a:
            a_at = dict(zip(np.cumsum([len(x) for x in a_bytes]).tolist(), range(len(a)), strict=True))
            b_at = dict(zip(np.cumsum([len(x) for x in b_bytes]).tolist(), range(len(b)), strict=True))
            groups, i_a, i_b = [], 0, 0
            for end in sorted(set(a_at) & set(b_at)):
                links.append((a[a_at[end]], b[b_at[end]]))
                groups.append(",".join(map(str, a[i_a : a_at[end] + 1])) + "|" + ",".join(map(str, b[i_b : b_at[end] + 1])))
                i_a, i_b = a_at[end] + 1, b_at[end] + 1
            sha = hashlib.sha256(";".join(groups).encode()).hexdigest()
            count.update(links)
        docs.append((i, len(a), len(b), links, sha))
    best = collections.defaultdict(int)
    for (_, y), c in count.items():
        best[y] = max(best[y], c)
    return sorted(((i, n, m, len(x), len(x), sum(count[k] == best[k[1]] for k in x), sum(count[k] for k in x), s) for i, n, m, x, s in docs), key=str)


@pytest.mark.parametrize("size", [lots.LOT_BYTES, 3000])
def test_alignment_equals_brute_force(spark, odd, empty, monkeypatch, size):
    monkeypatch.setattr(alignment, "ALIGNED_BYTES", size)
    more = [(104, "a  b \x1c c\u2003d e\xa0f  "), (105, "x ▁ y"), (106, " lead and trail "), (107, "it's we'll\n don't 12 345"), (100, "日本語テキスト" * 40), (101, "ﬁ ① Å  two  spaces \n\ty"), (102, "é naïve — ‘q’"), (103, "💁🏽‍♀️" * 9)]
    docs = odd.select("doc_id", "text", "lot", "n").unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    docs = docs.unionByName(table(spark, SF, "documents").select("doc_id", "text"), allowMissingColumns=True)
    want = aligned_by_hand([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert plain(alignment.align_documents(docs).collect()) == want and sum(w[4] for w in want) > 10_000
    assert alignment.align_documents(empty).collect() == []


def test_spans_are_refined_where_tokens_share_a_character():
    texts = ["é龘🙂 x", "", "▁a", "龘龘", "plain", "Å é"]
    x = alignment.encode(texts)
    assert x.bad.tolist() == [False, True, True, False, False, False]
    base = np.cumsum([len((" " + t).encode()) for t in texts])
    for ends, sizes in ((x.a_ends, x.a_sizes), (x.b_ends, x.b_sizes)):
        assert (np.diff(ends) > 0).all() and ends[np.cumsum(sizes)[~x.bad] - 1].tolist() == base[~x.bad].tolist()
    coarse, clear = np.array([3, 5, 5, 8]), np.array([True, False, True, False])
    assert alignment.refined(coarse, clear, np.array([3, 1, 1, 3])).tolist() == [3, 4, 5, 8]


def test_joined_words_are_encoded_as_alone():
    words = ["plain", "Wörter,", "it's", "a\n\nb", "12.5%", "日本語", "x", "<s>", "龘龘", "don't!"]
    for more in ([], ["▁bad", "after"]):
        one, each = alignment.encode_words(words + more), alignment.encode(words + more)
        for name in ("a", "a_ends", "a_sizes", "b", "b_ends", "b_sizes", "bad"):
            assert getattr(one, name).tolist() == getattr(each, name).tolist()
        assert one.bad.tolist() == [False] * len(words) + [True, False][: len(more)]


def test_lots_keep_all_texts(spark, odd):
    for size in (10, 1000, lots.LOT_BYTES):
        rows = lots.lots(odd, "lang", size).collect()
        got = [(i, lots.Lot.of(r).data[a:b].tobytes().decode(), x) for r in rows for i, a, b, x in zip(r["ids"], lots.Lot.of(r).starts, lots.Lot.of(r).starts[1:], r["extra"], strict=False)]
        want = [(lots.NO_ID if r["doc_id"] is None else r["doc_id"], r["text"] or "", "und" if r["lang"] is None else r["lang"]) for r in odd.collect()]
        assert sorted(got) == sorted(want) and len({r["lot"] for r in rows}) == len(rows)
        assert all(sum(r["lengths"]) <= size or len(r["ids"]) == 1 or sum(r["lengths"][1:]) == 0 or max(r["lengths"]) > size for r in rows)


@pytest.mark.parametrize("name", ["op12_phrases", "op13_suffix_array"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    rel = con.sql(registry.oracle_sql()[name])
    got = registry.queries()[name](spark, SF)
    assert sorted(rel.columns) == sorted(got.columns)
    assert plain(got.select(*rel.columns).collect()) == plain(rel.fetchall())


def test_replies_are_dealt_by_lot_at_any_size(spark):
    table = spark.createDataFrame([(k, "x" * k) for k in range(5)], "lot long, held string")
    replies = spark.createDataFrame([(3, 1, "b"), (3, 0, "a"), (1, 0, "c")], "lot long, bucket int, told string")
    out = lots.with_replies(table, replies)
    got = {r["lot"]: r["replies"] and [x["told"] for x in r["replies"]] for r in out.collect()}
    assert got == {0: None, 1: ["c"], 2: None, 3: ["a", "b"], 4: None}
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
