"""Every training-data operator on odd rows, and against brute force."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from sparktrode.llm import components, decontaminate, imatch, langid, quality, sentencepiece_lattice, sharding, simhash, toxicity, url_filter, warc

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, own string, word string"


def words(rng, n, voc):
    return " ".join(rng.choice(voc) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows and columns with clashing names."""
    rng = random.Random(1)
    voc = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(400)]
    base = [words(rng, 60, voc) for _ in range(12)]
    texts = [None, "", "   ", "é漢字🙂", "a", "A", "one two", "!!!", *base, base[0], base[0].upper(), base[1] + " x", words(rng, 20000, voc), "zz" * 20000, "▁ ▁▁  x\ty\n\n"]
    rows = [(i, t, None if i % 5 == 0 else "en", None, None, "s", "o", "w") for i, t in enumerate(texts)]
    rows += [(None, base[2], "en", "s", 1, "s", "o", "w"), (None, None, None, None, None, None, None, None), (3, texts[3], "en", None, None, "s", "o", "w"), (9, base[1], "fr", None, None, "s", "o", "w")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i // 2) % 2) for i in range(30)] + [(None, 1, 1), (3, None, None), (4, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_sharding_law(spark, odd, empty):
    rows = sharding.shard_documents(odd, sharding.uniform_tree(16)).collect()
    assert len(rows) == odd.count() and sharding.shard_documents(empty, sharding.uniform_tree(16)).count() == 0
    for s in range(16):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))
    texts = {r["doc_id"]: r["text"] for r in odd.collect() if r["doc_id"] is not None}
    for r in rows:
        assert r["grown_shard"] in (r["shard"], 16)
        if r["doc_id"] is not None:
            data = (texts[r["doc_id"]] or "").encode()
            assert (r["size"], r["text_crc32"]) == (len(data) + 1, zlib.crc32(data))
    many = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    tree = [sharding.Leaf(x.region, x.rack, x.shard, 3.0 if x.shard == 5 else 1.0) for x in sharding.uniform_tree(16)]
    got = {r["shard"]: r["n"] for r in many.select(sharding.place(F.col("doc_id").cast("string"), tree).alias("shard")).groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert abs(got[5] - 20000 * 3 / 18) < 300 and all(abs(got[s] - 20000 / 18) < 200 for s in range(16) if s != 5)


def test_raised_weight_moves_keys_inside_its_subtree_only(spark):
    tree = sharding.uniform_tree(16)
    heavy = [sharding.Leaf(x.region, x.rack, x.shard, 2.0 if x.shard == 6 else 1.0) for x in tree]
    k = F.col("id").cast("string")
    moved = spark.range(5000).select(sharding.place(k, tree).alias("a"), sharding.place(k, heavy).alias("b")).filter("a <> b").collect()
    region, rack = {x.shard: x.region for x in tree}, {x.shard: x.rack for x in tree}
    assert moved and all(region[r["b"]] == 1 and (region[r["a"]] != 1 or rack[r["b"]] == 3) for r in moved)


def test_sentencepiece_equals_the_library(spark, odd, empty):
    model = sentencepiece_lattice.load_model()
    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_lattice.MODEL)
    got = sentencepiece_lattice.encode_documents(odd, model, decoded=True).collect()
    assert len(got) == odd.count() and sentencepiece_lattice.encode_documents(empty, model).count() == 0
    for r in got:
        t = r["text"]
        assert r["ids"] == sp.encode(t or "") and r["n_tokens"] == len(r["ids"])
        assert r["decoded"] == (None if t is None else t.replace("▁", " "))
        assert sentencepiece_lattice.decode(r["ids"], model) == (t or "").replace("▁", " ")


def made_words(seed, letters, count=400):
    rng = random.Random(seed)
    return sorted({"▁" * rng.randrange(0, 3) + "".join(rng.choice(letters) for _ in range(rng.randrange(2, 20))) for _ in range(count)})


def by_cuts(word, cuts):
    at = [i for i in range(len(word) + 1) if cuts >> i & 1]
    return [word[a:b] for a, b in zip(at, at[1:], strict=False)]


def test_lattice_cuts_equal_merges(spark):
    """Also with made ranks, under which many pieces fall due again after their turn."""
    load = sentencepiece_lattice.load_model()
    rng = random.Random(2)
    pieces = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(2, 6))) for _ in range(150)})
    made = sentencepiece_lattice.Model(pieces, {p: k for k, p in enumerate(rng.sample(pieces, len(pieces)))}, {}, 0)
    for model, vocabulary in ((load, made_words(2, "etaoinshrdlu,.é漢")), (made, made_words(3, "abc", 600))):
        words = spark.createDataFrame([(w, [0]) for w in vocabulary], "word string, parts array<int>")
        got = sentencepiece_lattice.lattice(words, model).select("word", sentencepiece_lattice.merge_cuts(F.length("word"), F.col("edges")).alias("cuts")).collect()
        assert len(got) > 300
        for r in got:
            assert by_cuts(r["word"], r["cuts"]) == sentencepiece_lattice.merged(r["word"], model.ranks)


def test_viterbi_fold_equals_dense_viterbi(spark, odd, empty):
    rng = random.Random(5)
    pieces = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) for _ in range(80)} | {"▁"})
    scores = {p: -rng.random() * 5 - 1 for p in pieces}
    model = sentencepiece_lattice.Model([*pieces, "<0x00>"], {p: k for k, p in enumerate(pieces)}, {p: k for k, p in enumerate(pieces)}, len(pieces), scores)
    vocabulary = made_words(6, "abcd")
    words = spark.createDataFrame([(w, [0]) for w in vocabulary], "word string, parts array<int>")
    got = sentencepiece_lattice.lattice(words, model).select("word", sentencepiece_lattice.viterbi_cuts(F.length("word"), F.col("edges")).alias("cuts")).collect()
    assert len(got) == len(vocabulary)
    unknown = min(scores.values()) - sentencepiece_lattice.UNKNOWN_PENALTY
    for r in got:
        w, best = r["word"], [0.0] + [-1e300] * len(r["word"])
        for e in range(1, len(w) + 1):
            best[e] = max(best[s] + scores.get(w[s:e], unknown if e - s == 1 else -1e300) for s in range(e))
        path = by_cuts(w, r["cuts"])
        assert "".join(path) == w and path == sentencepiece_lattice.best_path(w, scores)
        assert sum(scores.get(p, unknown) for p in path) == pytest.approx(best[-1])
    found = sentencepiece_lattice.encode_documents(spark.createDataFrame([(1, "abcab cab"), (2, None)], "doc_id long, text string"), model).collect()
    want = [p for w in ("▁abcab", "▁cab") for p in sentencepiece_lattice.best_path(w, scores)]
    assert {r["doc_id"]: r["ids"] for r in found} == {1: [model.ids[p] for p in want], 2: []}


def brute_print(text):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and linked(a, b) and find(a) != find(b):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in ids}


def test_simhash_equals_brute_force(spark, odd, empty):
    got = simhash.simhash_groups(odd).collect()
    assert len(got) == odd.count() and simhash.simhash_groups(empty).count() == 0
    prints = {r["doc_id"]: int(r["fingerprint"], 16) for r in got if r["doc_id"] is not None}
    for r in odd.filter("doc_id is not null and length(text) < 10000").collect():
        assert prints[r["doc_id"]] == brute_print(r["text"])
    want = brute_components(sorted(prints), lambda a, b: bin(prints[a] ^ prints[b]).count("1") <= 3)
    for r in got:
        if r["doc_id"] is not None:
            assert r["component_id"] == want[r["doc_id"]]


def test_tiles_find_all_links(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 60, dtype=np.int64)
    near = [int(b) ^ sum(1 << int(k) for k in rng.choice(62, rng.integers(1, 5), replace=False)) for b in base for _ in range(4)]
    nodes = sorted({*map(int, base), *near, 0, 1, 3, 7, 15})
    df = spark.createDataFrame([(n, [n]) for n in nodes], "node long, lanes array<long>")
    found = components.connected_components(simhash.near_links(*simhash.part_tiles(df, 3, 4), 3, 100))
    got = {n: n for n in nodes} | {r["node"]: r["component"] for r in found.collect()}
    assert got == brute_components(nodes, lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1") <= 3)


def test_spanning_links_join_the_same_nodes():
    rng = np.random.default_rng(4)
    for _ in range(50):
        u, v = rng.integers(0, 30, 40), rng.integers(0, 30, 40)
        u, v = u[u != v], v[u != v]
        a, b = simhash.spanning_links(u, v)
        ids = sorted({*u.tolist(), *v.tolist()})
        linked = lambda x, y: {(x, y), (y, x)}
        whole, some = set(zip(u.tolist(), v.tolist(), strict=True)), set(zip(a.tolist(), b.tolist(), strict=True))
        assert some <= whole | {(y, x) for x, y in whole} and len(some) < len(ids)
        assert brute_components(ids, lambda x, y: bool(linked(x, y) & whole)) == brute_components(ids, lambda x, y: bool(linked(x, y) & some))


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(200, 201), (5, 5), (None, 1)], "u long, v long")
    got = {r["node"]: r["component"] for r in components.connected_components(edges).collect()}
    assert got == {i: 0 for i in range(101)} | {200: 200, 201: 200}


@pytest.mark.parametrize("tile", [8192, 7])
def test_wide_tiles_find_all_links(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "DEDUP_TILE", tile)
    rng = np.random.default_rng(8)
    base = rng.integers(-(2**63), 2**63, (30, 4), dtype=np.int64).tolist()
    lanes = [list(b) for b in base]
    for b in base:
        for _ in range(3):
            x = [v % 2**64 for v in b]
            for k in rng.choice(256, rng.integers(10, 60), replace=False).tolist():
                x[k // 64] ^= 1 << (k % 64)
            lanes.append([v - 2**64 if v >= 2**63 else v for v in x])
    band = [int(x) for x in rng.integers(0, 4, len(lanes))]
    df = spark.createDataFrame(list(zip(range(len(lanes)), lanes, band, strict=True)), "node long, lanes array<long>, band int")
    found = components.connected_components(simhash.near_links(*simhash.band_tiles(df, 50), 50, 8))
    got = {n: n for n in range(len(lanes))} | {r["node"]: r["component"] for r in found.collect()}
    bits = lambda i, j: sum(bin((a ^ b) & (2**64 - 1)).count("1") for a, b in zip(lanes[i], lanes[j], strict=True))
    assert got == brute_components(range(len(lanes)), lambda i, j: abs(band[i] - band[j]) <= 1 and bits(i, j) <= 50)


def test_near_copies_leave_one(spark, odd, empty):
    rng = random.Random(9)
    voc = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(3000)]
    base = [words(rng, 200, voc) for _ in range(6)]
    near = []
    for b in base:
        w = b.split()
        for _ in range(3):
            x = list(w)
            x[rng.randrange(200)] = "changed"
            near.append(" ".join(x))
    docs = docs_of(spark, base + near + base)
    assert sorted(r["doc_id"] for r in simhash.drop_near_copies(docs).collect()) == list(range(6))
    other = words(rng, 200, voc)
    rows = [(7, base[0]), (7, base[1]), (7, near[0]), (None, base[2]), (None, near[6]), (None, other), (None, other), (8, near[3]), (9, None), (None, "")]
    kept = simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    left = sorted(((r["doc_id"], r["text"]) for r in kept), key=repr)
    assert [x for x in left if x[1] == other] == [(None, other)] and (9, None) in left and (None, "") not in left
    assert sum(x[1] in (base[0], near[0]) for x in left) == 1 and sum(x[1] in (base[2], near[6]) for x in left) == 1 and (7, base[1]) in left and (8, near[3]) not in left
    assert len(left) == 5
    got = simhash.drop_near_copies(odd)
    assert got.columns == odd.columns and simhash.drop_near_copies(empty).count() == 0


def test_repeated_lines_do_not_merge_texts(spark):
    rng = random.Random(12)
    voc = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(3000)]
    line = words(rng, 7, voc)
    texts = [" ".join([line] * 120) + " " + words(rng, 400, voc) for _ in range(4)]
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_copies(docs_of(spark, texts)).collect()} == {i: i for i in range(4)}
    again = docs_of(spark, [line, line + " " + line, "  " + line.upper(), " ".join([line] * 3)])  # 3, 7, 3 and 7 distinct shingles
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(again).collect()}
    assert got[2] == got[0] == 0 and got[1] != 0 and got[3] == got[1]


def test_equal_fingerprints_are_linked_not_merged(spark):
    nodes = spark.createDataFrame([(i, [5, 6, 7, 8], 0) for i in (1, 2, 3)], "node long, lanes array<long>, band int")
    links = {frozenset((r["u"], r["v"])) for r in simhash.near_links(*simhash.band_tiles(nodes, simhash.DEDUP_RADIUS), simhash.DEDUP_RADIUS, 8).collect()}
    assert links == {frozenset((1, 2)), frozenset((1, 3))}


@pytest.mark.parametrize("tile", [100_000, 700])
def test_every_near_link_is_checked(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TEXT_TILE", tile)
    rng = random.Random(14)
    voc = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(3000)]
    texts = []
    for _ in range(8):
        base = words(rng, 200, voc).split()
        for _ in range(4):  # branches about 0.7 from each other, leaves about 0.9 from their branch
            branch = list(base)
            for k in rng.sample(range(200), 4):
                branch[k] = rng.choice(voc)
            for _ in range(3):
                leaf = list(branch)
                leaf[rng.randrange(200)] = rng.choice(voc)
                texts.append(" ".join(leaf))
    rng.shuffle(texts)
    sets = [set(simhash.shingles(simhash.words_of(t), 5)) for t in texts]
    lanes = [simhash.set_lanes(x) for x in simhash.shingle_sets(texts)]
    bits = lambda i, j: sum(bin((a ^ b) & (2**64 - 1)).count("1") for a, b in zip(lanes[i], lanes[j], strict=True))
    want = brute_components(range(len(texts)), lambda i, j: bits(i, j) <= 50 and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_copies(docs_of(spark, texts)).collect()} == want


def test_hashed_shingles_are_the_sets():
    texts = ["a b c d e f", "A  b\tc d e f", "a b c d e f a b c d e f", "x y", "x y z", None, "", "a b c d e", "é b c d e f"]
    sets = [set(x.tolist()) for x in simhash.shingle_sets(texts)]
    want = [set(simhash.shingles(simhash.words_of(t), 5)) for t in texts]
    assert [len(x) for x in sets] == [len(x) for x in want]
    for a, x in zip(sets, want, strict=True):
        assert [len(a & b) for b in sets] == [len(x & y) for y in want]


def test_near_copies_of_test_data_are_found(spark):
    """At least 0.9 of all pairs of similarity 0.8 or more are in one group."""
    from collections import defaultdict

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    sets = {i: set(simhash.shingles(simhash.words_of(t), 5)) for i, t in texts.items()}
    where = defaultdict(set)
    for i, s in sets.items():
        for g in s:
            where[g].add(i)
    group = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(docs).collect()}
    true = [(i, j) for i in sets for j in {k for g in sets[i] for k in where[g]} if i != j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert len(true) > 10 and sum(group[i] == group[j] for i, j in true) >= 0.9 * len(true)


def test_classifiers_on_odd_rows(spark, odd, empty, labels, none):
    for m in (quality, toxicity):
        got = m.score_documents(odd, labels)
        assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == odd.count()
        assert got.filter("score is null or score < 0 or score > 1").count() == 0
        assert m.score_documents(empty, labels).count() == 0 and m.score_documents(odd, none).count() == odd.count()
    assert quality.keep_good(odd, none).count() == odd.count() and toxicity.keep_clean(odd, none).columns == odd.columns


def test_isotonic_pools_violators():
    x, y = quality.isotonic(np.arange(5.0), np.array([0, 1, 0, 1, 1.0]), np.ones(5))
    assert np.all(np.diff(y) >= 0) and np.interp(1.5, x, y) == pytest.approx(0.5)


def test_normal_equations_equal_one_matrix(spark):
    rng = np.random.default_rng(1)
    stats, y = rng.normal(size=(300, quality.STATISTICS)), rng.integers(0, 2, 300).astype(float)
    df = spark.createDataFrame([(s.tolist(), float(t)) for s, t in zip(stats, y, strict=True)], "stats array<double>, y double").repartition(7)
    model = quality.Model(np.zeros(quality.STATISTICS), np.ones(quality.STATISTICS), np.zeros(1), (np.zeros(1), np.zeros(1)))
    f = quality.features(stats)
    assert np.allclose(quality.normal_equations(df, model, fan_in=2), f.T @ np.c_[f, y])


def test_quality_and_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, lab = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    for m, column, least in ((quality, "quality", 0.95), (toxicity, "toxic", 0.9)):
        held = m.score_documents(docs, lab).filter("held_out").join(lab, "doc_id")
        assert held.filter(F.col("predicted") == F.col(column)).count() >= least * held.count()


def test_factorisation_machine_learns_a_pair():
    """Only both terms together are labelled 1: additive weights can't tell that."""
    import pyarrow as pa

    rows, y = [[0], [1], [0, 1], []] * 50, [0.0, 0.0, 1.0, 0.0] * 50
    batch = pa.RecordBatch.from_pydict({"terms": pa.array(rows, pa.list_(pa.int64())), "y": y})
    rng = np.random.default_rng(0)
    p = np.r_[0.0, np.zeros(2), rng.normal(0, 0.1, 2 * toxicity.FACTORS)]
    for _ in range(8):
        out = next(toxicity._train(float(p[0]), p[1:3], p[3:].reshape(2, -1), 0)(iter([batch])))
        p = np.frombuffer(out.column("p")[0].as_py())
    score = toxicity.margins(*toxicity._flat([[0], [1], [0, 1]]), p[0], p[1:3], p[3:].reshape(2, -1))
    assert score[0] < 0 and score[1] < 0 < score[2]


def test_fingerprints_against_their_definition(spark, odd, empty):
    got = imatch.fingerprint_documents(odd).collect()
    assert len(got) == odd.count() and imatch.fingerprint_documents(empty).count() == 0
    rows = sorted(((r["doc_id"], r["text"] or "") for r in odd.filter("doc_id is not null").dropDuplicates(["doc_id"]).collect()), reverse=True)
    unique = {r["doc_id"] for r in odd.groupBy("doc_id").count().filter("count = 1").collect()}
    by_id = {r["doc_id"]: r for r in got}
    for (i, t), (j, u) in zip(rows, rows[1:], strict=False):
        if {i, j} <= unique:
            third = len(t) // 3
            assert by_id[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - third] + u[:third]).encode()).hexdigest()
            assert by_id[i]["n_chars"] == len(t) and 0 <= by_id[i]["near_edited"] <= 1
    prints = {}
    for r in odd.select("doc_id", "text").filter("doc_id is not null").collect():
        prints.setdefault(r["text"] or "", set()).add(by_id[r["doc_id"]]["fingerprint"])
    assert all(len(x) == 1 for x in prints.values())
    one = imatch.fingerprint_documents(docs_of(spark, ["just one text here"])).first()
    assert one["near_next"] == 1.0


def test_fingerprints_of_repeated_ids(spark):
    """Rows of one id follow each other by the hash of their texts, over partitions as well."""
    rng = random.Random(16)
    voc = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    rows = [(k // 4 if k < 20 else None, words(rng, 30 + k, voc) if k % 7 else None, "x") for k in range(24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, hash string").repartition(3)
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()
    line = sorted(keyed, key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0), r["h"]))
    want = sorted(
        (str(a["doc_id"]), len(a["t"]), hashlib.sha256(imatch.edited(a["t"], b["t"]).encode()).hexdigest()) for a, b in zip(line, [*line[1:], line[0]], strict=True)
    )
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in imatch.fingerprint_documents(docs).collect()) == want


def test_fingerprints_equal_brute_force(spark):
    """Signatures name the terms of each subset; likeness and the band follow their definitions."""
    assert imatch.SUBSETS == 24 and imatch.ENOUGH == 8
    rng = random.Random(17)
    voc = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(200)]
    texts = [words(rng, n, voc) for n in (1, 3, 10, 50, 50, 200, 200, 800)] + ["", "...", "?", "Zz yY", "zz YY zz"]
    texts += [imatch.edited(t, u) for t, u in zip(texts, texts[1:], strict=False)]
    docs = docs_of(spark, texts)
    distinct = [set(re.findall(r"[^\W_]+", t.lower())) for t in texts]
    count = {w: sum(w in d for d in distinct) for d in distinct for w in d}
    band = {w for w, n in count.items() if 2 <= n <= max(2, len(texts) / 5)}
    name = lambda w: int(imatch.tokens([w])[0][0])
    lexicon = imatch.lexicon(docs)
    assert set(lexicon.tolist()) == set(map(name, band))
    prints = imatch.Prints(lexicon).of(texts)
    assert prints.shape == (len(texts), imatch.LEVELS * imatch.SUBSETS)

    def members(k):
        out = [set() for _ in range(imatch.LEVELS * imatch.SUBSETS)]
        for w in (distinct[k] & band) or distinct[k]:
            for s in imatch.subsets(np.array([name(w)], dtype=np.uint64))[1]:
                out[s].add(w)
        return out

    sets = [members(k) for k in range(len(texts))]
    for a in range(len(texts)):
        for b in range(len(texts)):
            if distinct[a] and distinct[b]:
                for s in range(imatch.LEVELS * imatch.SUBSETS):
                    assert (prints[a, s] == 0) == (not sets[a][s]) and (prints[a, s] == prints[b, s]) == (sets[a][s] == sets[b][s])
                levels = [range(k * 24, k * 24 + 24) for k in range(imatch.LEVELS)]
                held = [sum(bool(sets[a][s] or sets[b][s]) for s in x) for x in levels]
                k = max((k for k in range(imatch.LEVELS) if held[k] >= 8), default=max(range(imatch.LEVELS), key=lambda k: (held[k], -k)))
                same = sum(bool(sets[a][s]) and sets[a][s] == sets[b][s] for s in levels[k])
                want = 1.0 if sets[a] == sets[b] else same / max(1, held[k])
                assert imatch.likeness(prints[a : a + 1], prints[b : b + 1])[0] == pytest.approx(want)
    one, other = texts.index("..."), texts.index("?")
    assert prints[one].any() and (prints[one] != prints[other]).any() and (prints[texts.index("Zz yY")] == prints[texts.index("zz YY zz")]).all()


def test_langid(spark, odd, empty):
    got = {r["doc_id"]: r for r in langid.predict_languages(odd).collect()}
    assert len(got) and langid.predict_languages(empty).count() == 0
    assert all(got[i]["lang_pred"] == "und" for i in (0, 1, 2, 7))
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = langid.predict_languages(docs).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert held.filter("lang = lang_pred").count() >= 0.97 * held.count()


def test_language_filter_returns_all_languages_of_an_ngram():
    """Also with more languages than bits in a mask; counts are corrected for false positives."""
    names = [f"l{k:02d}" for k in range(70)]
    masks = np.zeros((langid.SLOTS, 2), dtype=np.uint64)
    h = langid.grams(langid.normalised("hello world"), 3)
    for k in range(langid.HASHES):
        np.bitwise_or.at(masks, (langid.slots(h, k), 0), np.uint64(0b101))
        np.bitwise_or.at(masks, (langid.slots(h, k), 1), np.uint64(1 << 6))
    found = langid.Filter(names, masks)
    assert (found.languages_of(h) == [0b101, 1 << 6]).all()
    assert np.flatnonzero(found.popcounts(found.languages_of(h))).tolist() == [0, 2, 69]


def test_language_decision_equals_brute_force(spark):
    """With the n-grams of each language in plain sets; the filter only adds false positives."""
    rng = random.Random(18)
    parts = {"aa": ["ka", "ti", "mo"], "bb": ["ti", "re", "su"], "cc": ["xo", "re", "ka"]}
    made = lambda p, n: " ".join("".join(rng.choice(p) for _ in range(3)) for _ in range(n))
    rows = [(3 * i + k, made(parts[x], 30), x) for i in range(40) for k, x in enumerate(parts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]

    def grams(text, n):
        padded = " " + " ".join(re.findall("[a-z]+", text)) + " "
        return [g for i in range(len(padded) - n + 1) if " " not in (g := padded[i : i + n])[1:-1] and g.strip()]

    sets = {}
    for x in parts:
        for n in langid.SIZES:
            every = [g for r in learned if r[2] == x for g in grams(r[1], n)]
            sets[x, n] = {g for g in set(every) if every.count(g) / len(every) > langid.MIN_SHARE}
    for r in langid.predict_languages(docs).collect():
        text = next(t for i, t, _ in rows if i == r["doc_id"])
        hits = {x: sum(g in sets[x, n] for n in langid.SIZES for g in grams(text, n)) for x in parts}
        assert r["lang_pred"] == max(parts, key=lambda x: hits[x]) and r["score"] == pytest.approx(max(hits.values()) / sum(hits.values()), abs=0.01)


def test_langid_ties_go_to_the_first_language(spark):
    docs = spark.createDataFrame([(1, "aaa bbb", "y"), (3, "aaa bbb", "x"), (3, "aaa bbb", "x"), (4, "zzz", None)], "doc_id long, text string, lang string")
    got = {(r["doc_id"], r["lang_pred"]) for r in langid.predict_languages(docs).collect()}
    assert got == {(1, "x"), (3, "x"), (4, "x")}


def test_leaks_planted_and_paraphrased(spark, odd, empty):
    sf = SF
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    items = [r["text"] for r in bench.orderBy("item_id").collect()]
    host = [r["text"] for r in docs.orderBy("doc_id").limit(40).collect()]
    rng = random.Random(3)
    planted = []
    for t, h in zip(items, host, strict=False):
        w = h.split()
        at = rng.randrange(len(w) + 1)
        x = t.split()
        if len(x) > 12:
            x[3] = "other"
        planted.append(" ".join([*w[:at], *x, *w[at:]]))
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(planted)], "doc_id long, text string"))
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(more, bench).collect()}
    ids = [str(r["item_id"]) for r in bench.orderBy("item_id").collect()]
    assert sum((10_000 + i, k) in found for i, k in enumerate(ids[: len(planted)])) >= len(planted) - 1
    norm = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    whole = {(r["doc_id"], k) for r in docs.collect() for k, t in zip(ids, items, strict=True) if norm(t) in norm(r["text"])}
    assert {x for x in found if x[0] < 10_000} >= whole
    assert decontaminate.leaks(odd, bench).count() == 0 and decontaminate.leaks(empty, bench).count() == 0
    assert decontaminate.leaks(odd, bench.limit(0)).count() == 0 and decontaminate.drop_leaks(odd, bench).columns == odd.columns


def test_edited_items_are_found_at_every_alignment():
    rng = np.random.default_rng(6)
    latent = decontaminate.Latent(rng.normal(size=(decontaminate.TERMS, 36)).astype(np.float32), np.zeros(decontaminate.TERMS))
    word = lambda n: rng.integers(0, 2**63, n).astype(np.uint64)
    items = [decontaminate.Item(str(n), word(n).tolist()) for n in (9, 13, 19, 22, 40, 90, 150, 200, 400, 1000)]
    look = decontaminate.Search(latent, items)
    texts, planted = [], []
    for k, item in enumerate(items):
        for offset in range(16):
            copy = np.array(item.words, dtype=np.uint64)
            gone = rng.choice(len(copy), len(copy) // 5, replace=False)
            copy[gone] = word(len(gone))
            texts.append(np.r_[word(60 + offset), copy, word(70)])
            planted.append((len(planted), k))
    found = look(np.concatenate(texts), np.cumsum([0, *map(len, texts)]))
    assert set(found) == set(planted) and all(x[2] == "copy" for x in found.values())


def test_candidates_equal_all_windows(monkeypatch):
    """Every window of every text is compared by cosine; of windows next to each other the best stays."""
    rng = np.random.default_rng(7)
    latent = decontaminate.Latent(rng.normal(size=(decontaminate.TERMS, 8)).astype(np.float32), np.zeros(decontaminate.TERMS))
    common, rare = rng.integers(0, 2**63, 12).astype(np.uint64), rng.integers(0, 2**63, 60).astype(np.uint64)
    made = lambda n: np.where(rng.random(n) < 0.5, rng.choice(common, n), rng.choice(rare, n))
    items = [decontaminate.Item(str(n), made(n).tolist()) for n in (1, 2, 5, 8, 11, 17, 30, 55, 90)]
    look = decontaminate.Search(latent, items)
    texts = [made(n) for n in (0, 1, 3, 40, 200, 0, 333)] + [np.r_[made(20), np.array(items[k].words, dtype=np.uint64), made(30)] for k in range(9)]
    starts = np.cumsum([0, *map(len, texts)])
    want, whole = set(), {}
    for t, text in enumerate(texts):
        for k in range(len(items)):
            width, step, margin = int(look.width[k]), int(look.step[k]), int(look.margin[k])
            rows = latent.factors[decontaminate.terms_of(text)].copy()
            rows[1:][text[1:] == text[:-1]] = 0
            cosine = []
            for nth in range(max(0, -(-len(text) // step) - width // step) + 1 if len(text) else 0):
                v = rows[nth * step : nth * step + width].sum(0)
                cosine.append(float(v @ look.query[k]) / max(float(np.linalg.norm(v)), 1e-12))
            for nth, c in enumerate(cosine):
                near = [*cosine[max(0, nth - 2) : nth], *cosine[nth + 1 : nth + 3]]
                at, stop = nth * step, min(nth * step + width, len(text))
                key = t, k, int(starts[t] + max(at - margin, 0)), int(starts[t] + min(stop + margin, len(text)))
                whole.setdefault(key, []).append(c)  # windows cut at a text's ends may share a region
                want |= {key} if c >= decontaminate.COSINE + 1e-5 and c > max(near, default=-2) + 1e-5 else set()
    for span in (1 << 14, 64):
        monkeypatch.setattr(decontaminate, "SPAN", span)
        got = {}
        for found in look.candidates(np.concatenate(texts), starts):
            got |= {x[:4]: x[4] for x in zip(*(f.tolist() for f in found), strict=True)}
        assert len(want) > 50 and want <= set(got) and all(min(abs(got[x] - c) for c in whole[x]) < 1e-4 for x in got)


def test_the_cosine_decides():
    """A region with all of an item's words counts only where its windows are like the item."""
    rng = np.random.default_rng(12)
    factors = rng.normal(size=(decontaminate.TERMS, 36)).astype(np.float32)
    item = rng.integers(0, 2**63, 32).astype(np.uint64)
    loud = rng.integers(0, 2**63, 40).astype(np.uint64)
    factors[decontaminate.terms_of(loud)] = 40 * factors[decontaminate.terms_of(loud[:1])]
    latent, items = decontaminate.Latent(factors, np.zeros(decontaminate.TERMS)), [decontaminate.Item("i", item.tolist())]
    apart = np.insert(item, np.arange(0, 32, 4), loud[:8])
    for text, share in ((item, 1.0), (apart, None)):
        whole = np.r_[rng.integers(0, 2**63, 50).astype(np.uint64), text, rng.integers(0, 2**63, 50).astype(np.uint64)]
        found = decontaminate.Search(latent, items)(whole, np.array([0, len(whole)]))
        off = decontaminate.Search(latent, items, cosine=-1.0)(whole, np.array([0, len(whole)]))
        assert off[0, 0][0] >= 0.75 and (found == {} if share is None else found[0, 0][0] == share)


def test_recall_of_edits_and_paraphrases(spark):
    """Items of the table with words replaced, a quarter anywhere or half of them but for the answer."""
    docs, bench = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    items = [decontaminate.Item(str(r["item_id"]), decontaminate.tokens([r["text"]])[0].tolist()) for r in bench.collect()]
    look = decontaminate.Search(decontaminate.fit(docs), items)
    rng = np.random.default_rng(2)
    corpus = decontaminate.tokens([r["text"] for r in docs.limit(300).collect()])[0]
    for share, kept, least in ((0.0, 0, 1.0), (0.25, 0, 0.95), (0.5, 0.25, 0.85)):
        texts, own = [], []
        for k, item in enumerate(items):
            for offset in range(6):
                w = np.array(item.words, dtype=np.uint64)
                free = len(w) - (max(3, int(len(w) * kept)) if kept else 0)
                gone = rng.choice(free, min(free, int(len(w) * share)), replace=False)
                w[gone] = rng.choice(corpus, len(gone))
                texts.append(np.r_[rng.choice(corpus, 60 + offset), w, rng.choice(corpus, 70)])
                own.append(k)
        found = look(np.concatenate(texts), np.cumsum([0, *map(len, texts)]))
        assert np.mean([(i, k) in found for i, k in enumerate(own)]) >= least


def test_subsequences_of_many_pairs_equal_one_by_one():
    rng = np.random.default_rng(3)
    items = [decontaminate.Item(str(k), rng.integers(0, 30, n).tolist()) for k, n in enumerate((1, 5, 31, 32, 63, 64, 65, 100))]
    look = decontaminate.Search(decontaminate.Latent(np.ones((decontaminate.TERMS, 2), np.float32), np.zeros(decontaminate.TERMS)), items)
    hashes = rng.integers(0, 40, 500).astype(np.uint64)
    at = np.minimum(np.searchsorted(look.words, hashes), len(look.words) - 1)
    word = np.where(look.words[at] == hashes, at, len(look.words))
    item, begin = rng.integers(0, len(items), 80), rng.integers(0, 400, 80)
    end = begin + rng.integers(0, 100, 80)
    for answers in (False, True):
        own = [look.answers[k] if answers else items[k].words for k in item]
        want = [decontaminate.common_subsequence(decontaminate.masks(w), len(w), hashes[i:j].tolist()) for w, i, j in zip(own, begin, end, strict=True)]
        assert look._shared(item, begin, end, word, hashes, answers).tolist() == want


def test_paraphrase_needs_the_answer():
    rng = np.random.default_rng(11)
    latent = decontaminate.Latent(np.ones((decontaminate.TERMS, 3), np.float32), np.zeros(decontaminate.TERMS))
    item = decontaminate.Item("i", rng.integers(0, 2**63, 40).tolist())
    look = decontaminate.Search(latent, [item])
    for gone, kind in ((range(0, 14), "paraphrase"), (range(26, 40), None), (range(0, 5), "copy")):
        text = np.array(item.words, dtype=np.uint64)
        text[list(gone)] = rng.integers(0, 2**63, len(gone)).astype(np.uint64)
        found = look(text, np.array([0, len(text)]))
        assert found == {} if kind is None else found[0, 0][2] == kind


def test_latent_factors_equal_numpys(spark, monkeypatch):
    """The factors span the leading right singular vectors of the passages' TF-IDF matrix."""
    monkeypatch.setattr(decontaminate, "RANK", 42)
    rng = random.Random(13)
    topics = [[f"t{k}w{i}" for i in range(6)] for k in range(60)]
    docs = docs_of(spark, [words(rng, 32, topics[k % 60][:]) for k in range(600)])
    latent = decontaminate.fit(docs.repartition(5))
    a = np.zeros((600, decontaminate.TERMS))
    for k, r in enumerate(docs.collect()):
        np.add.at(a[k], decontaminate.terms_of(decontaminate.tokens([r["text"]])[0]), 1)
    idf = np.log((1 + 600) / (1 + (a > 0).sum(0)))
    assert np.array_equal(latent.passages, (a > 0).sum(0))
    a *= idf
    a /= np.linalg.norm(a, axis=1)[:, None]
    held = np.flatnonzero(a.any(0))
    _, _, right = np.linalg.svd(a[:, held], full_matrices=False)
    top = right[: decontaminate.RANK + decontaminate.OVERSAMPLE]
    found = latent.factors[held] / idf[held, None]
    assert found.shape[1] == decontaminate.RANK - decontaminate.SKIPPED
    kept = np.linalg.norm(top @ found, axis=0)
    assert kept.min() > 0.5 and np.median(kept) > 0.8


def test_leaks_with_odd_ids_and_blocks(spark, monkeypatch):
    rng = random.Random(15)
    voc = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(2000)]
    items = [words(rng, n, voc) for n in (6, 12, 40, 150)]
    bench = spark.createDataFrame([(f"i{k}", t, "x") for k, t in enumerate(items)] + [("none", None, "x"), ("empty", "..", "x")], "item_id string, text string, doc_id string")
    texts = [words(rng, 50, voc) + " " + t + " " + words(rng, 60, voc) for t in items]
    rows = [("a", texts[0], "x"), (None, texts[1], "x"), ("b", texts[2], "x"), ("b", texts[2], "x"), ("b", words(rng, 90, voc), "x"), (None, words(rng, 90, voc), "x"), ("c", texts[3], "x"), ("d", None, "x"), ("e", "", "x")]
    docs = spark.createDataFrame(rows, "doc_id string, text string, item_id string")
    for chars in (4_000_000, 200):
        monkeypatch.setattr(decontaminate, "ITEM_CHARS", chars)
        found = sorted((str(r["doc_id"]), r["item_id"]) for r in decontaminate.leaks(docs, bench).collect())
        assert found == [("None", "i1"), ("a", "i0"), ("b", "i2"), ("b", "i2"), ("c", "i3")]
        left = decontaminate.drop_leaks(docs, bench)
        assert left.columns == docs.columns and sorted(str(r["doc_id"]) for r in left.collect()) == ["None", "b", "d", "e"]


def test_common_subsequence_equals_table():
    rng = random.Random(1)
    for _ in range(100):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 25))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert decontaminate.common_subsequence(decontaminate.masks(a), len(a), b) == best[-1][-1]


def test_word_hashes_tell_words_apart():
    texts = ["One two, ONE", None, "", "two one"]
    h, starts = decontaminate.tokens(texts)
    assert starts.tolist() == [0, 3, 3, 3, 5] and h[0] == h[2] == h[4] and h[1] == h[3] and h[0] != h[1]


PAGES = "page_id long, url string, html string, digest string, payload string"


def test_warc_round_trip(spark):
    rows = [(1, "http://a/\r\nx%", "same", "d", "p"), (2, None, "same", "d", "p"), (3, "u", None, "d", "p"), (4, "u", "", "d", "p"), (5, "é", "x" * 700_000, "d", "p"), (None, "n", "same", "d", "p"), (6, "ü", "漢\x00", "d", "p"), (2, "again", "same", "d", "p")]
    got = warc.round_trip(spark, spark.createDataFrame(rows, PAGES)).collect()
    assert len(got) == len(rows)
    want = {1: ("revisit", 2), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None), 5: ("response", None), 6: ("response", None), None: ("revisit", 2)}
    html = {r[0]: r[2] or "" for r in rows}
    for r in got:
        data = html[r["page_id"]].encode()
        assert (r["record_type"], r["refers_to"]) == want[r["page_id"]]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
    assert {r["url"] for r in got} == {r[1] for r in rows}
    assert warc.round_trip(spark, spark.createDataFrame([], PAGES)).count() == 0


def test_warc_reader_rejects_damage():
    import io

    data = warc.record(1, "u", b"payload", "X", None)
    zipped = zlib.compressobj(6, zlib.DEFLATED, 31)
    member = zipped.compress(data) + zipped.flush()
    assert len(list(warc.records(io.BytesIO(member * 3)))) == 3
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(member + member[:-20])))


def brute_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for _, r in url_filter.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, max(fits, key=len, default=None)


def test_url_rules_and_propagation(spark):
    urls = [None, "nothing", "http://A.Example.COM/en/x", "http://www.example.com/en/", "http://x.net/es/1?q", "http://x.net/en/1", "http://com", "http://é.com/#a/b", "ftp://b.net/fr/#x", "x://y://z.com/q", "http://good.org/a", "http://bad.org/"]
    links = {"http://www.example.com/en/": '<a href="http://good.org/a">', "http://bad.org/": "<a href='//b.net/'>"}
    rows = [(i, u, links.get(u), "d", "p") for i, u in enumerate(urls)] + [(3, urls[3], None, "d", "p")]
    got = url_filter.judge_urls(spark.createDataFrame(rows, PAGES)).collect()
    assert len(got) == len(rows)
    verdicts = {r: v for v, r in url_filter.RULES}
    for r in got:
        host, path, rule = brute_rule(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        if rule:
            assert r["verdict"] == verdicts[rule]
    by_url = {urls[r["page_id"]]: r["verdict"] for r in got}
    assert by_url["http://good.org/a"] == "allow" and by_url["http://bad.org/"] == "block" and by_url[None] == "allow"
    assert url_filter.judge_urls(spark.createDataFrame([], PAGES)).count() == 0


def test_propagation_equals_dense_matrix(spark):
    edges = [("a", "b", 1.0), ("a", "c", 3.0), ("b", "c", 1.0), ("c", "a", 1.0), ("d", "c", 2.0)]
    seeds = [("trust", "a", 1.0), ("distrust", "c", 1.0)]
    got = url_filter.propagate(spark.createDataFrame(edges, "src string, dst string, w double"), spark.createDataFrame(seeds, "kind string, host string, score double"))
    names = "abcd"
    for kind, seed in (("trust", 0), ("distrust", 2)):
        m = np.zeros((4, 4))
        for s, d, w in edges:
            i, j = names.index(s), names.index(d)
            m[(j, i) if kind == "trust" else (i, j)] += w
        m /= np.maximum(m.sum(0), 1e-300)
        v = np.eye(4)[seed]
        p = v
        for _ in range(url_filter.ITERATIONS):
            p = url_filter.DAMPING * m @ p + (1 - url_filter.DAMPING) * v
        found = {r["host"]: r["score"] for r in got.filter(F.col("kind") == kind).collect()}
        assert np.allclose([found.get(n, 0.0) for n in names], p)


def test_pipeline_stages(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert {"ids", "n_tokens", *docs.columns} == set(out.columns)
    kept = {r["doc_id"] for r in out.collect()}
    assert kept <= {r["doc_id"] for r in docs.collect()} and len(kept) > 0.5 * docs.count()
    leaked = {r["doc_id"] for r in decontaminate.leaks(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert not kept & leaked
