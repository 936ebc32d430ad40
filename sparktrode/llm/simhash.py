"""SimHash near-duplicates by tiled exact comparison.

Distinct fingerprints are laid into tiles by population count. Two fingerprints differ in at least
as many bits as their population counts do, so pairs of tiles whose counts differ beyond the radius
are skipped. The pairs are chosen on tile ids, then each gets its two tiles and is compared whole
with exclusive-or and bit counts; of the links found it gives a spanning forest, so a group of n
near copies gives about n rows and not their square.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, discard, setting, written
from .components import connected_components
from .wordhash import mixed, spaced_tokens

SHINGLE, RADIUS, SEED = 3, 3, 42
TILE = 1024
STRIP = 64
#: The pipeline's stage: wider fingerprints of five-word shingles, then the exact similarity.
DEDUP_SHINGLE, DEDUP_LANES, DEDUP_RADIUS, SIMILARITY = 5, 4, 50, 0.8
DEDUP_TILE = 8192
#: Shingles in a tile of texts, tiles in an Arrow batch, pairs of texts looked at before the next
#: look at which are joined already, and characters hashed at once.
TEXT_TILE, TEXT_BATCH, PAIRS, HASHED_CHARS = 100_000, 32, 4096, 1 << 17
BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, with A-Z in lower case."""
    return (text or "").encode().lower().split()


def shingles(words: list[bytes], width: int) -> list[bytes]:
    """Runs of `width` words, repeats included; fewer words make one shingle, none make none."""
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    joined = b" ".join(words)
    ends = np.cumsum(np.array([len(w) for w in words]) + 1)
    starts = [0, *ends[:-width].tolist()]
    return [joined[s:e] for s, e in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)]


def fingerprint(text: str | None, width: int = SHINGLE, lanes: int = 1) -> list[int]:
    """Signed 64-bit lanes of all shingles, repeats included."""
    return majority(shingles(words_of(text), width), lanes)


def majority(grams: list[bytes], lanes: int) -> list[int]:
    """Lane k takes XXH64 with seed 42 + k. A bit is set if over half have it."""
    if not grams:
        return [0] * lanes
    out = []
    for lane in range(lanes):
        h = np.array([xxhash.xxh64_intdigest(g, SEED + lane) for g in grams], dtype="<u8")
        ones = np.zeros(64, dtype=np.int64)
        for at in range(0, len(h), 1 << 16):
            ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0]))
    return out


def fingerprint_column(text: str = "text", width: int = SHINGLE, lanes: int = 1) -> Column:
    return F.pandas_udf(lambda s: s.map(lambda x: fingerprint(x, width, lanes)), "array<long>")(F.col(text))


def _offsets(radius: int, parts: int) -> list[tuple[int, ...]]:
    """Differences of the parts' counts within the radius; of each and its negative, one."""
    span = range(-radius, radius + 1)
    return [x for x in itertools.product(span, repeat=parts) if sum(map(abs, x)) <= radius and x >= (0,) * parts]


def _packed(tiles: DataFrame, by: list[str], *more: Column) -> DataFrame:
    """A row for each tile: a new id, the columns `by`, its nodes and their lanes end to end."""
    rows = tiles.groupBy(*by).agg(F.collect_list(F.struct("node", "lanes")).alias("rows"), *more)
    rows = rows.withColumns({"id": F.monotonically_increasing_id(), "nodes": F.col("rows.node"), "lanes": F.flatten("rows.lanes")})
    return written(rows.drop("rows"), "tiles")


def part_tiles(prints: DataFrame, radius: int, parts: int) -> tuple[DataFrame, DataFrame]:
    """Tiles of one-lane fingerprints, and the pairs of tile ids to compare.

    A cell holds the fingerprints of the same population counts in all parts; the counts' summed
    differences bound the distance more tightly than those of the whole fingerprint.
    """
    width = 64 // parts
    counts = [F.bit_count(F.shiftrightunsigned(F.col("lanes")[0], width * i).bitwiseAND(F.lit((1 << width) - 1))) for i in range(parts)]
    cells = prints.select("node", "lanes", F.array(*counts).alias("cell"))
    sizes = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    sizes = F.broadcast(sizes)  # at most (width + 1) ** parts rows
    tiles = cells.join(sizes, "cell").withColumn("tile", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / TILE)).cast("int"))
    tiles = _packed(tiles, ["cell", "tile"])
    by = F.array(*[F.array(*map(F.lit, x)) for x in _offsets(radius, parts)])
    left = tiles.select(F.col("id").alias("a"), "cell", F.col("tile").alias("tile_a"), F.explode(by).alias("by"))
    left = left.select("a", "tile_a", F.zip_with("cell", "by", lambda x, y: x + y).alias("cell"), (~F.exists("by", lambda x: x != 0)).alias("home"))
    pairs = left.join(tiles.select(F.col("id").alias("b"), "cell", F.col("tile").alias("tile_b")), "cell")
    return tiles, pairs.filter(~F.col("home") | (F.col("tile_a") <= F.col("tile_b"))).select("a", "b")


def band_tiles(prints: DataFrame, radius: int) -> tuple[DataFrame, DataFrame]:
    """Tiles of wide fingerprints, and the pairs of tile ids to compare.

    Within a band fingerprints lie in order of their population count and are cut into tiles of
    about DEDUP_TILE. Only tiles of the same or the next band meet.
    """
    lanes = [F.bit_count(F.col("lanes")[i]) for i in range(DEDUP_LANES)]
    cells = prints.select("node", "lanes", "band", reduce(Column.__add__, lanes).alias("ones"))
    before = F.sum("n").over(Window.partitionBy("band").orderBy("ones")) - F.col("n")  # at most 257 rows a band
    sizes = cells.groupBy("band", "ones").agg(F.count(F.lit(1)).alias("n")).withColumn("before", before)
    place = F.col("before") + F.pmod(F.xxhash64("node"), F.col("n"))
    tiles = cells.join(F.broadcast(sizes), ["band", "ones"]).withColumn("tile", F.floor(place / DEDUP_TILE))
    tiles = _packed(tiles, ["band", "tile"], F.min("ones").alias("low"), F.max("ones").alias("high"))
    a = tiles.select(F.col("id").alias("a"), "band", F.col("tile").alias("tile_a"), F.col("low").alias("low_a"), F.col("high").alias("high_a"))
    b = tiles.select(F.col("id").alias("b"), "band", F.col("tile").alias("tile_b"), F.col("low").alias("low_b"), F.col("high").alias("high_b"))
    same = a.join(b, "band").filter("tile_a <= tile_b")
    following = a.join(b.withColumn("band", F.col("band") - 1), "band")
    near = (F.col("low_b") - F.col("high_a") <= radius) & (F.col("low_a") - F.col("high_b") <= radius)
    return tiles, same.unionByName(following).filter(near).select("a", "b")


def _close(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows i of a and j of b that differ in at most `radius` bits; of a tile with itself, i < j.

    Half of the lanes are counted for all pairs, the others for those still within the radius.
    """
    found_i, found_j = [], []
    half = (a.shape[1] + 1) // 2
    for at in range(0, len(a), STRIP):
        strip = a[at : at + STRIP]
        bits = np.bitwise_count(strip[:, :1] ^ b[:, 0])
        for lane in range(1, half):
            bits += np.bitwise_count(strip[:, lane : lane + 1] ^ b[:, lane])
        i, j = np.nonzero(bits <= radius)
        if same:
            i, j = i[i + at < j], j[i + at < j]
        if half < a.shape[1] and len(i):
            more = np.bitwise_count(strip[i, half:] ^ b[j, half:]).sum(1, dtype=np.int64) + bits[i, j]
            i, j = i[more <= radius], j[more <= radius]
        found_i.append(i + at)
        found_j.append(j)
    return (np.concatenate(found_i), np.concatenate(found_j)) if found_i else (np.zeros(0, int), np.zeros(0, int))


def spanning_links(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Some of the links u-v (node ids) that join the same nodes: one fewer than nodes a component.

    Labels spread by repeated minima; a node keeps the link by which its last label came.
    """
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = np.concatenate([at[: len(u)], at[len(u) :]]), np.concatenate([at[len(u) :], at[: len(u)]])
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
    label, parent = np.arange(len(ids)), np.arange(len(ids))
    while True:
        near = label[b]
        least = np.minimum.reduceat(near, starts)
        better = least < label
        if not better.any():
            break
        hit = np.flatnonzero(near == np.repeat(least, np.diff(np.r_[starts, len(a)])))
        first = hit[np.searchsorted(hit, starts)]
        parent[better] = b[first][better]
        label = np.minimum(label, least)
    kept = parent != np.arange(len(ids))
    return ids[kept], ids[parent[kept]]


def _compare(radius: int):
    def unpack(batch: pa.RecordBatch, side: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        nodes, lanes = batch.column(f"nodes_{side}"), batch.column(f"lanes_{side}")
        ids = nodes.flatten().to_numpy(zero_copy_only=False)
        bits = lanes.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(ids), -1) if len(ids) else np.zeros((0, 1), np.uint64)
        return ids, bits, np.r_[0, np.cumsum(nodes.value_lengths().to_numpy(zero_copy_only=False))]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes_a, a, at_a = unpack(batch, "a")
            nodes_b, b, at_b = unpack(batch, "b")
            found_u, found_v = [], []
            for k, same in enumerate(pc.equal(batch.column("a"), batch.column("b")).to_pylist()):
                i, j = _close(a[at_a[k] : at_a[k + 1]], b[at_b[k] : at_b[k + 1]], radius, same)
                if len(i):
                    u, v = nodes_a[at_a[k] + i], nodes_b[at_b[k] + j]
                    if len(i) > 1:
                        u, v = spanning_links(u, v)
                    found_u.append(u)
                    found_v.append(v)
            if found_u:
                u, v = spanning_links(np.concatenate(found_u), np.concatenate(found_v))
                yield pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return compare


def near_links(tiles: DataFrame, pairs: DataFrame, radius: int, batch: int) -> DataFrame:
    """(u, v): links of at most `radius` bits that join the same nodes as all such links do."""
    one, other = (tiles.select(F.col("id").alias(x), F.col("nodes").alias(f"nodes_{x}"), F.col("lanes").alias(f"lanes_{x}")) for x in "ab")
    with setting(tiles.sparkSession, BATCH_KEY, batch):
        links = written(pairs.join(one, "a").join(other, "b").mapInArrow(_compare(radius), "u long, v long"), "near_links")
    discard(tiles)
    return links


def simhash_groups(docs: DataFrame, width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for every row.

    Null and empty texts and texts of white space have fingerprint zero, linked like any other.
    Equal fingerprints are one node, so copies are never paired with each other. component_id is
    the smallest doc_id reachable; null ids count only where a group has no other. Repeated rows
    give a row each; other columns are not read. An empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    prints = written(docs.select("doc_id", fingerprint_column("text", width).alias("lanes")).select("doc_id", F.col("lanes")[0].alias("fp")), "fingerprints")
    reps = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    nodes = reps.select(F.col("fp").alias("node"), F.array("fp").alias("lanes"))
    groups = connected_components(near_links(*part_tiles(nodes, radius, 4), radius, 100))
    labelled = reps.join(groups, reps["fp"] == groups["node"], "left").select("fp", F.coalesce("component", "fp").alias("label"), "least")
    least = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    by_print = written(labelled.join(least, "label").select("fp", "component_id"), "components")
    return prints.join(by_print, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The distinct five-word shingles of each text as sorted hashes; fewer words make one."""
    out: list[np.ndarray] = []
    lot: list[str | None] = []
    size = 0

    def flush() -> None:
        words, starts = spaced_tokens(lot)
        n = max(len(words) - DEDUP_SHINGLE + 1, 0)
        grams = np.zeros(n, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for k in range(DEDUP_SHINGLE):
                grams = grams * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n]
            for begin, end in itertools.pairwise(starts.tolist()):
                if end - begin >= DEDUP_SHINGLE:
                    out.append(np.unique(mixed(grams[begin : end - DEDUP_SHINGLE + 1])))
                else:
                    few = np.uint64(0)
                    for w in words[begin:end]:
                        few = few * np.uint64(0x9E3779B97F4A7C15) + w
                    out.append(mixed(np.array([few] if end > begin else [], dtype=np.uint64)))

    for text in texts:
        lot.append(text)
        size += len(text or "")
        if size >= HASHED_CHARS:
            flush()
            lot.clear()
            size = 0
    flush()
    return out


def set_lanes(grams: np.ndarray) -> list[int]:
    """A wide fingerprint of a set: a bit of a lane is set if over half of the shingles have it."""
    with np.errstate(over="ignore"):
        lanes = mixed(grams[:, None] + np.arange(1, DEDUP_LANES + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
    ones = np.zeros(64 * DEDUP_LANES, dtype=np.int64)
    for at in range(0, len(lanes), 1 << 14):
        ones += np.unpackbits(lanes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8 * DEDUP_LANES), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(lanes), bitorder="little").view("<i8").tolist()


def _set_stats(texts: pd.Series) -> pd.DataFrame:
    """Of the distinct shingles of each text: a digest that names the set, lanes and their number."""
    rows = [(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), set_lanes(s), max(1, len(s))) for s in shingle_sets(texts.tolist())]
    return pd.DataFrame(rows, columns=["shingles", "lanes", "n"])


def similar_links(rows_a: list[dict], rows_b: list[dict] | None, similarity: float) -> Iterator[tuple[int, int]]:
    """Links (labels) inside a tile of texts, or between two, that join the same labels as all true ones.

    A row has node, label, lanes and text. A link is true if it is within the radius and the exact
    similarity of its shingle sets is reached; rows of one label are joined already.
    """
    rows = rows_a + (rows_b or [])
    bits = np.array([r["lanes"] for r in rows], dtype=np.int64).view(np.uint64)
    grams = shingle_sets([r["text"] for r in rows])
    n = np.array([max(1, len(g)) for g in grams])
    _, label = np.unique([r["label"] for r in rows], return_inverse=True)
    root = np.arange(label.max() + 1)
    sets: dict[int, set[int]] = {}

    def set_of(i: int) -> set[int]:
        if i not in sets:
            sets[i] = set(grams[i].tolist())
        return sets[i]

    split = len(rows_a)
    i, j = _close(bits[:split], bits[:split] if rows_b is None else bits[split:], DEDUP_RADIUS, rows_b is None)
    if rows_b is not None:
        j = j + split
    fits = (np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j])) & (label[i] != label[j])
    i, j = i[fits], j[fits]
    for at in range(0, len(i), PAIRS):
        p, q = i[at : at + PAIRS], j[at : at + PAIRS]
        apart = root[label[p]] != root[label[q]]
        for u, v in zip(p[apart].tolist(), q[apart].tolist(), strict=True):
            x, y = root[label[u]], root[label[v]]
            if x != y:
                shared = len(set_of(u) & set_of(v))
                if shared >= similarity * (len(set_of(u)) + len(set_of(v)) - shared):
                    root[root == y] = x
                    yield rows[u]["label"], rows[v]["label"]


def _roots(links: Iterator[tuple[int, int]]) -> dict[int, int]:
    """The least of those joined, for each that isn't it."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    for u, v in links:
        x, y = find(u), find(v)
        if x != y:
            up[max(x, y)] = min(x, y)
    return {x: find(x) for x in up}


def _alike(similarity: float, roots: bool):
    """Links between two tiles of texts; or, of a tile alone, each label and the root it is joined to."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows_a, rows_b in zip(batch.column("rows_a"), batch.column("rows_b"), strict=True):
                links = similar_links(rows_a.as_py(), rows_b.as_py(), similarity)
                if found := list(_roots(links).items() if roots else links):
                    u, v = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["label", "root"] if roots else ["u", "v"])

    return compare


_ROWS = "array<struct<node:bigint,label:bigint,lanes:array<bigint>,text:string>>"


def _rows() -> Column:
    return F.collect_list(F.struct("node", "label", "lanes", "text"))


def _tiles() -> Column:
    """How many tiles the texts of a group take."""
    return F.ceil(F.greatest(F.sum("n") / TEXT_TILE, F.count(F.lit(1)) / TILE)).cast("int")


def _inside(members: DataFrame, similarity: float) -> DataFrame:
    """(label, root) of the labels that the true links inside a tile join to a smaller one.

    members has component and tile, and one row for each label."""
    packed = members.groupBy("component", "tile").agg(_rows().alias("rows_a"))
    with setting(members.sparkSession, BATCH_KEY, TEXT_BATCH):
        return written(packed.select("rows_a", F.lit(None).cast(_ROWS).alias("rows_b")).mapInArrow(_alike(similarity, True), "label long, root long"), "roots")


def _tiled(members: DataFrame) -> DataFrame:
    """members with tile and tiles, the number of tiles of the component."""
    sizes = members.groupBy("component").agg(_tiles().alias("tiles"))
    return members.join(sizes, "component").withColumn("tile", F.pmod(F.xxhash64("node"), "tiles").cast("int"))


def _across(members: DataFrame, similarity: float) -> DataFrame:
    """(u, v): true links between the labels of a component; every two of its tiles meet once.

    A label with texts for more than a tile has tiles of its own, which don't meet each other, so
    a very large group of copies costs no more than its size times the rest of its component.
    """
    weights = members.groupBy("component", "label").agg(_tiles().alias("own"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows"))
    heavy = weights.filter("own > 1").select("component", "label", "own")
    light = weights.filter("own = 1").groupBy("component").agg(F.ceil(F.greatest(F.sum("n") / TEXT_TILE, F.sum("rows") / TILE)).cast("int").alias("lots"))
    tiled = members.join(heavy, ["component", "label"], "left").join(light, "component", "left")
    tiled = tiled.withColumn("whose", F.when(F.col("own").isNotNull(), F.col("label")).otherwise(-1))
    tiled = tiled.withColumn("tile", F.when(F.col("own").isNotNull(), F.pmod(F.xxhash64("node"), "own")).otherwise(F.pmod(F.xxhash64("label"), "lots")).cast("int"))
    tiles = tiled.groupBy("component", "whose", "tile").agg(_rows().alias("rows"))
    tiles = written(tiles.withColumn("id", F.monotonically_increasing_id()), "text_tiles")
    a, b = (tiles.select(F.col("id").alias(x), "component", F.col("whose").alias(f"whose_{x}")) for x in "ab")
    pairs = a.join(b, "component").filter("a <= b and (whose_a <> whose_b or whose_a = -1)").select("a", "b")
    both = pairs.join(tiles.select(F.col("id").alias("a"), F.col("rows").alias("rows_a")), "a").join(tiles.select(F.col("id").alias("b"), F.col("rows").alias("rows_b")), "b")
    both = both.select("rows_a", F.when(F.col("a") != F.col("b"), F.col("rows_b")).alias("rows_b"))
    with setting(members.sparkSession, BATCH_KEY, TEXT_BATCH):
        links = written(both.mapInArrow(_alike(similarity, False), "u long, v long"), "label_links")
    discard(tiles)
    return links


def _relabelled(labels: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, label) with each label replaced by its root, if it has one."""
    return labels.join(roots, "label", "left").select("node", F.coalesce("root", "label").alias("label"))


def joined_by_text(members: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(node, label): the nodes that are joined to another, the label of a group being one of its nodes.

    Joined are nodes within the radius and of at least this similarity, directly or over others.
    members has node, component (of the links within the radius), n, lanes and text. A component
    of one tile is checked there. In a larger one each tile is checked, then one node of each label
    found stands for it in new, fewer tiles, as long as that joins more; last, the labels left are
    checked against each other with all their nodes. So no link is left out before its check, and
    a large group of copies is joined without meeting itself tile by tile.
    """
    tiled = written(_tiled(members.withColumn("label", F.col("node"))), "members")
    done, roots = [tiled], _inside(tiled, similarity)
    large = tiled.filter("tiles > 1").drop("tiles", "tile", "label")
    left = large.count()
    small = roots.join(tiled.filter("tiles = 1").select(F.col("node").alias("label")), "label", "left_semi") if left else roots
    out = small.select(F.col("label").alias("node"), F.col("root").alias("label"))
    if left:
        labels = written(_relabelled(large.select("node", F.col("node").alias("label")), roots), "labels")
        while True:
            standing = written(_tiled(large.join(labels, "node").filter("node = label")), "members")
            done.append(standing)
            now = standing.count()
            if now >= left:
                break
            left, labels = now, written(_relabelled(labels, _inside(standing, similarity)), "labels")
        groups = connected_components(_across(large.join(labels, "node"), similarity))
        labels = _relabelled(labels, groups.select(F.col("node").alias("label"), F.col("component").alias("root")))
        out = written(out.unionByName(labels.filter("node <> label")), "labels")
    discard(*done)
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with a key of each distinct pair of doc_id and text, nulls included."""
    return docs.withColumns({"__key_a": F.xxhash64("doc_id", "text"), "__key_b": F.xxhash64("text", "doc_id")})


KEY = ["__key_a", "__key_b"]


def near_groups(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """A row for each distinct (doc_id, text): its key, doc_id, component_id, and the component's
    first key (of the smallest doc_id, nulls last).

    A node is a distinct set of five-word shingles; only texts of one set are taken as one without
    a check. Fingerprints of 4 x 64 bits over the sets link within the radius, equal ones too;
    bands of the sets' sizes keep apart texts whose lengths rule out the similarity. In each
    component of these links every link is checked exactly, unless links found true join its ends.
    """
    bounded_batches(docs.sparkSession)
    stats = F.pandas_udf(_set_stats, "shingles binary, lanes array<long>, n int")
    keyed = _keyed(docs.select("doc_id", "text"))
    prints = written(keyed.select(*KEY, "doc_id", stats("text").alias("s")).select(*KEY, "doc_id", "s.*"), "wide_fingerprints")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", *KEY))
    nodes = prints.groupBy("shingles").agg(least.alias("least"), F.first("lanes").alias("lanes"), F.first("n").alias("n"))
    nodes = nodes.withColumn("node", F.monotonically_increasing_id()).withColumn("band", F.floor(F.log("n") / math.log(1 / similarity)).cast("int"))
    nodes = written(nodes.select("node", "shingles", "least", "lanes", "n", "band"), "shingle_sets")
    near = near_links(*band_tiles(nodes, DEDUP_RADIUS), DEDUP_RADIUS, 8)
    candidates = connected_components(near)
    members = nodes.join(candidates, "node").select("node", "component", "n", "lanes", *[F.col(f"least.{k}").alias(k) for k in KEY])
    members = keyed.select(*KEY, "text").dropDuplicates(KEY).join(members, KEY).drop(*KEY)
    groups = joined_by_text(members, similarity)
    labelled = nodes.join(groups, "node", "left").select("shingles", F.coalesce("label", "node").alias("label"), "least")
    named = labelled.join(labelled.groupBy("label").agg(F.min("least").alias("first")), "label").select("shingles", "first")
    found = prints.join(named, "shingles").select(*KEY, "doc_id", F.col("first.doc_id").alias("component_id"), *[F.col(f"first.{k}").alias(f"first{k}") for k in KEY])
    found = written(found.distinct(), "near_copies")
    discard(prints, nodes, near, candidates, groups)
    return found


def near_copies(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, component_id) of every distinct (doc_id, text); component_id is the smallest id of
    its group of near copies, null if no id is there. Other columns are not read."""
    return near_groups(docs, similarity).select("doc_id", "component_id")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of near copies: that of the smallest doc_id, nulls last.

    Texts decide, so rows of a null or repeated doc_id stay unless their text has near copies; of
    equal rows one stays, and of rows with equal doc_id and text any one. Null texts and texts
    without words are one group. An empty table gives an empty result.
    """
    others = near_groups(docs).filter((F.col("__key_a") != F.col("first__key_a")) | (F.col("__key_b") != F.col("first__key_b"))).select(*KEY)
    kept = _keyed(docs).dropDuplicates(KEY).join(written(others, "dropped_copies"), KEY, "left_anti")
    return kept.select(*docs.columns)
