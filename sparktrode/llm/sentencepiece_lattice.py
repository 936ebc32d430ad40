"""SentencePiece encoding and decoding over a relational lattice.

The distinct words of the corpus are a table. All their substrings of bounded length are exploded
and equi-joined to the piece table; the joined rows are the edges of each word's lattice, grouped
by word. The fold over a word's edges is one Spark ``aggregate``.

For a unigram model the fold is Viterbi's. The model at hand is a BPE model, whose encoding is not
the path of the best summed score: it joins the two neighbours whose edge has the best score, the
leftmost of equal ones, until none is left. So its fold goes over the edges by score and keeps a
word's cuts as the bits of a long.

A word's cuts travel back to the partitions of documents that hold the word, in a file for each
partition in the shared folder; texts are never shuffled. Words that are longer than the lattice
takes, or that the file lacks as the rows were dealt anew, are encoded by a helper in the task, by
the same rule.
"""

from __future__ import annotations

import heapq
import re
from array import array
from itertools import chain
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, new_path, setting

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Longest word that goes through the lattice; its cuts fit in the bits of a long.
LATTICE_CHARS = 60
#: No piece has a line break, or another character before a space mark, so no merge crosses these.
WORD = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
#: Nor has any piece a Latin letter before a character that is no letter, digit or space mark.
CUT = re.compile(f"(?<=[A-Za-zÀ-ɏ])(?=[^\\w{SPACE}]|_)")
WORDS_HELD = 1_000_000
#: Ids of distinct runs that a task holds before it starts anew.
IDS_HELD = 1_500_000
#: An edge is packed into an int, so ranks stay below this; a task groups the edges of so many
#: words by hash before it sorts.
RANKS = 1 << 16
HASHED_WORDS = 1 << 17
#: A character that a unigram model lacks scores so much below its worst piece.
UNKNOWN_PENALTY = 10.0


@dataclass(frozen=True)
class Model:
    pieces: list[str]
    ranks: dict[str, int]  # of pieces that may be merged; equal scores have equal ranks
    ids: dict[str, int]
    first_byte: int
    scores: dict[str, float] | None = None  # of a unigram model, which has no ranks to merge by

    @property
    def longest(self) -> int:
        return max(map(len, self.ranks))


def load_model(path: str = MODEL, unigram: bool = False) -> Model:
    """Read the pieces and scores of a BPE model with byte fallback, or of a unigram one."""
    import sentencepiece

    read = sentencepiece.SentencePieceProcessor(model_file=path)
    n = read.get_piece_size()
    pieces = [read.id_to_piece(i) for i in range(n)]
    plain = [i for i in range(n) if not (read.is_control(i) or read.is_unknown(i) or read.is_byte(i) or read.is_unused(i))]
    order = {s: k for k, s in enumerate(sorted({read.get_score(i) for i in plain}, reverse=True))}
    bad = [pieces[i] for i in plain if "\n" in pieces[i] or re.search(f"[^{SPACE}]{SPACE}", pieces[i]) or CUT.search(pieces[i])]
    if bad:
        raise ValueError(f"pieces cross word borders: {bad[:3]}")
    ranks = {pieces[i]: order[read.get_score(i)] for i in plain}
    scores = {pieces[i]: read.get_score(i) for i in plain} if unigram else None
    return Model(pieces, ranks, {pieces[i]: i for i in plain}, pieces.index("<0x00>"), scores)


def runs_of(text: str) -> list[str]:
    """Runs of the text with its leading space mark, cut at spaces and line breaks."""
    return WORD.findall(SPACE + text.replace(" ", SPACE))


def split(text: str) -> Iterator[tuple[str, list[str]]]:
    """The runs of a text as (prefix, bare runs); each run is one word or several to be cut.

    Plain splits serve where spaces and line breaks are single.
    """
    odd = text[0] == " " or text[-1] == " " or SPACE in text or "  " in text or "\n " in text or " \n" in text
    if odd or "\n\n" in text or text[0] == "\n" or text[-1] == "\n":
        yield "", runs_of(text)
        return
    for k, line in enumerate(text.split("\n")):
        found = line.split(" ")
        if k:
            yield "", ["\n", found[0]]
            found = found[1:]
        yield SPACE, found


def merged(word: str, ranks: dict[str, int]) -> list[str]:
    """The pieces and lone characters of one word, by a heap of neighbours."""
    parts, after = list(word), list(range(1, len(word) + 1))
    before = list(range(-1, len(word) - 1))
    heap: list[tuple[int, int, int, str]] = []

    def offer(i: int) -> None:
        if i >= 0 and (j := after[i]) < len(parts) and (rank := ranks.get(both := parts[i] + parts[j])) is not None:
            heapq.heappush(heap, (rank, i, j, both))

    for i in range(len(parts)):
        offer(i)
    while heap:
        _, i, j, both = heapq.heappop(heap)
        if not parts[i] or after[i] != j or parts[i] + parts[j] != both:
            continue
        parts[i], parts[j], after[i] = both, "", after[j]
        if after[j] < len(parts):
            before[after[j]] = i
        offer(before[i])
        offer(i)
    return [p for p in parts if p]


def best_path(word: str, scores: dict[str, float]) -> list[str]:
    """The pieces of one word under a unigram model; of equal sums the shortest last piece."""
    longest, unknown = max(map(len, scores)), min(scores.values()) - UNKNOWN_PENALTY
    best: list[tuple[float, int]] = [(0.0, 0)]
    for e in range(1, len(word) + 1):
        spans = ((s, scores.get(word[s:e], unknown if e - s == 1 else None)) for s in range(max(0, e - longest), e))
        best.append(max((best[s][0] + x, s) for s, x in spans if x is not None))
    out, e = [], len(word)
    while e:
        s = best[e][1]
        out.append(word[s:e])
        e = s
    return out[::-1]


def _shifted(bits: Column | int, by: Column) -> Column:
    return F.call_function("shiftleft", F.lit(bits).cast("long"), by.cast("int"))


def merge_cuts(n: Column, edges: Column) -> Column:
    """Bits of the places where a word of n characters is cut, folded over its edges.

    An edge is rank * 4096 + start * 64 + end, so the edges sorted are in the order of merging. An
    edge joins two symbols if both its ends are cuts and just one cut is between them. An edge that
    meets more cuts waits; should a later one take a cut out of a waiting edge, that edge might be
    due before its turn has come again. Such a word, and only such, is folded again by steps that
    each look for the best of all edges that join two symbols.
    """
    ends = lambda x: _shifted(1, F.shiftright(x, 6).bitwiseAND(F.lit(63))).bitwiseOR(_shifted(1, x.bitwiseAND(F.lit(63))))
    inner = lambda x: _shifted(1, x.bitwiseAND(F.lit(63))) - _shifted(2, F.shiftright(x, 6).bitwiseAND(F.lit(63)))
    alive = lambda cuts, x: cuts.bitwiseAND(ends(x)) == ends(x)
    single = lambda hit: hit.bitwiseAND(hit - 1) == 0
    every = _shifted(2, n) - 1

    def in_order(state: Column, x: Column) -> Column:
        cuts, waiting, unsure = state["cuts"], state["waiting"], state["unsure"]
        hit = cuts.bitwiseAND(inner(x))
        joined = F.struct(cuts.bitwiseXOR(hit).alias("cuts"), waiting.alias("waiting"), (unsure | (hit.bitwiseAND(waiting) != 0)).alias("unsure"))
        waits = F.struct(cuts.alias("cuts"), waiting.bitwiseOR(inner(x)).alias("waiting"), unsure.alias("unsure"))
        return F.when(~alive(cuts, x), state).when(single(hit), joined).otherwise(waits)

    def best_next(cuts: Column, _: Column) -> Column:
        best = F.array_min(F.filter(edges, lambda x: alive(cuts, x) & (cuts.bitwiseAND(inner(x)) != 0) & single(cuts.bitwiseAND(inner(x)))))
        return F.coalesce(cuts.bitwiseXOR(cuts.bitwiseAND(inner(best))), cuts)

    start = F.struct(every.alias("cuts"), F.lit(0).cast("long").alias("waiting"), F.lit(False).alias("unsure"))
    by_steps = F.aggregate(F.sequence(F.lit(2), n), every, best_next)
    return F.aggregate(F.array_sort(edges), start, in_order, lambda s: F.when(s["unsure"], by_steps).otherwise(s["cuts"]))


def viterbi_cuts(n: Column, edges: Column) -> Column:
    """Bits of the cuts of the best-scored path through a word's edges (s, e, score).

    The state holds, for each place, the best sum and where its last piece starts; of equal sums
    the shortest last piece wins.
    """

    def at(state: Column, e: Column) -> Column:
        into = F.filter(edges, lambda x: x["e"] == e)
        best = F.array_max(F.transform(into, lambda x: F.struct((F.get(state, x["s"])["sum"] + x["score"]).alias("sum"), x["s"].alias("s"))))
        return F.concat(state, F.array(best))

    def back(state: Column) -> Column:
        walk = F.aggregate(
            F.sequence(F.lit(1), n),
            F.struct(n.cast("int").alias("e"), _shifted(1, n).alias("cuts")),
            lambda w, _: F.when(w["e"] == 0, w).otherwise(F.struct(F.get(state, w["e"])["s"].alias("e"), w["cuts"].bitwiseOR(_shifted(1, F.get(state, w["e"])["s"])).alias("cuts"))),
        )
        return walk["cuts"]

    return F.aggregate(F.sequence(F.lit(1), n), F.array(F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("s"))), at, back)


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, held, bare = TaskContext.get().partitionId(), set(), set()

    def out() -> pa.RecordBatch:
        words = {SPACE + b for b in bare if b.isalnum()}
        for run in chain(held, [SPACE + b for b in bare if not b.isalnum()]):
            words.update(CUT.split(run))
        words = sorted(w for w in words if 2 <= len(w) <= LATTICE_CHARS)
        return pa.RecordBatch.from_pydict({"part": pa.array(np.full(len(words), part), pa.int32()), "word": pa.array(words, pa.string())})

    for batch in batches:
        for text in batch.column(0).to_pylist():
            for prefix, words in split(text) if text else ():
                (bare if prefix else held).update(words)
            if len(held) + len(bare) > WORDS_HELD:
                yield out()
                held, bare = set(), set()
    yield out()


def lattice(words: DataFrame, model: Model) -> DataFrame:
    """(word, parts, edges): the edges of each word, grouped by word.

    words has word and parts and is dealt by word, so neither the explosion nor the broadcast of the piece table (its
    size is the model's) moves a row; the grouping needs no shuffle.
    """
    spark, n = words.sparkSession, F.length("word")
    if model.scores is None:
        pieces = spark.createDataFrame([(p, r) for p, r in model.ranks.items() if len(p) > 1], "piece string, rank int")
        least, edge = 2, (F.col("rank") * 4096 + F.col("s") * 64 + F.col("e")).cast("int")
    else:
        pieces = spark.createDataFrame(list(model.scores.items()), "piece string, score double")
        unknown = min(model.scores.values()) - UNKNOWN_PENALTY
        least, edge = 1, F.struct("s", "e", F.coalesce("score", F.lit(unknown)).alias("score"))
    spans = words.select("word", "parts", F.explode(F.sequence(F.lit(0), n - least)).alias("s"))
    spans = spans.select("word", "parts", "s", F.explode(F.sequence(F.col("s") + least, F.least(n, F.col("s") + model.longest))).alias("e"))
    edges = spans.withColumn("piece", F.expr("substring(word, s + 1, e - s)")).join(F.broadcast(pieces), "piece", "inner" if least == 2 else "left")
    if least == 1:  # a character is an edge, known or not
        edges = edges.filter("score is not null or e - s = 1")
    return edges.groupBy("word").agg(F.first("parts").alias("parts"), F.collect_list(edge).alias("edges"))


def cut_words(docs: DataFrame, model: Model, text: str = "text") -> str:
    """Write the cuts of the words of each partition of docs; returns the folder.

    The words are dealt by hash once and grouped where they arrive; each carries the partitions
    that hold it. A word without edges needs no fold and no row.
    """
    spark = docs.sparkSession
    seen = docs.select(text).mapInArrow(_distinct, "part int, word string").repartition("word")
    fold = merge_cuts if model.scores is None else viterbi_cuts
    words = seen.groupBy("word").agg(F.collect_list("part").alias("parts"))
    cut = lattice(words, model).select("parts", "word", fold(F.length("word"), F.col("edges")).alias("cuts"))
    found = cut.select(F.explode("parts").alias("part"), "word", "cuts")
    path = new_path(spark, "cuts")
    with setting(spark, "spark.sql.objectHashAggregate.sortBased.fallbackThreshold", HASHED_WORDS):
        found.repartition("part").sortWithinPartitions("part", "word").write.partitionBy("part").parquet(path)
    return path


def _spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each size, one after the other."""
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size - begin, size)


@dataclass(frozen=True)
class Words:
    """Words and their ids, end to end."""

    number: dict[str, int]
    ids: array
    ends: array

    def of(self, word: str) -> array | None:
        k = self.number.get(word)
        return None if k is None else self.ids[self.ends[k] : self.ends[k + 1]]


def cut_ids(words: pa.Array, cuts: np.ndarray, model: Model) -> Words:
    """The ids of words by their cuts, of all words at once: the pieces lie end to end in the words' bytes.

    A piece that the model lacks is spelt in bytes.
    """
    names = words.to_numpy(zero_copy_only=False).tolist()
    data = np.frombuffer("".join(names).encode(), dtype=np.uint8)
    heads = np.flatnonzero((data & 0xC0) != 0x80)  # first bytes of characters
    chars = pc.utf8_length(words).to_numpy().astype(np.int64)
    inner = (cuts ^ (np.uint64(1) << chars.astype(np.uint64))).astype("<u8")  # without the end of the word
    word, at = np.divmod(np.flatnonzero(np.unpackbits(inner.view(np.uint8), bitorder="little")), 64)
    first = heads[(np.cumsum(chars) - chars)[word] + at] if len(word) else np.zeros(0, np.int64)
    offsets = np.r_[first, len(data)].astype(np.int32)
    pieces = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(data))
    at = pc.index_in(pieces, pa.array(list(model.ids), pa.string()))
    known = np.array(list(model.ids.values()), dtype=np.int32)[pc.fill_null(at, 0).to_numpy()] if len(first) else np.zeros(0, np.int32)
    lost = at.is_null().to_numpy(zero_copy_only=False)
    size = np.where(lost, np.diff(offsets), 1)
    ids = np.repeat(known, size)
    ids[np.repeat(lost, size)] = model.first_byte + data[_spread(first[lost], size[lost])]
    ends = np.r_[0, np.cumsum(np.bincount(word, size, len(words)).astype(np.int64))]
    return Words(dict(zip(names, range(len(names)), strict=True)), array("i", ids.astype(np.int32).tobytes()), array("q", ends.astype(np.int64).tobytes()))


def read_words(folder: str, part: int, model: Model) -> Words:
    """The words of one partition and their ids, from the partition's files."""
    store, at = pafs.FileSystem.from_uri(folder)
    tables = []
    for file in store.get_file_info(pafs.FileSelector(f"{at}/part={part}", allow_not_found=True)):
        if file.path.endswith(".parquet"):
            with store.open_input_file(file.path) as source:
                tables.append(pq.read_table(source, columns=["word", "cuts"]))
    if not tables:
        return Words({}, array("i"), array("q", [0]))
    t = pa.concat_tables(tables).combine_chunks()
    return cut_ids(t.column("word").combine_chunks(), t.column("cuts").to_numpy().astype(np.uint64), model)


class Runs:
    """Ids of the runs met so far, end to end."""

    def __init__(self) -> None:
        self.ids, self.ends = array("i"), array("q", [0])


class Encoder(dict):
    """Runs of one partition to their numbers among `runs`; prefix is put before each.

    A word that the lattice didn't cut, as it is too long, has no edge or the rows were dealt anew,
    is encoded here by the model's rule.
    """

    def __init__(self, model: Model, words: Words, prefix: str, runs: Runs):
        super().__init__()
        self.model, self.words, self.prefix, self.runs = model, words, prefix, runs

    def spelt(self, word: str) -> list[int]:
        ids, found = self.model.ids, []
        for p in merged(word, self.model.ranks) if self.model.scores is None else best_path(word, self.model.scores):
            found += [i] if (i := ids.get(p)) is not None else [self.model.first_byte + x for x in p.encode()]
        return found

    def __missing__(self, bare: str) -> int:
        run = self.prefix + bare
        for word in (run,) if bare.isalnum() else CUT.split(run):
            if len(word) == 1 and (i := self.model.ids.get(word)) is not None:
                self.runs.ids.append(i)
            else:
                found = self.words.of(word)
                self.runs.ids.extend(self.spelt(word) if found is None else found)
        self.runs.ends.append(len(self.runs.ids))
        self[bare] = number = len(self.runs.ends) - 2
        return number


def decode(ids: list[int], model: Model) -> str:
    """Text of ids: byte pieces joined, space marks as spaces, the leading one dropped."""
    data = b"".join(bytes([i - model.first_byte]) if model.first_byte <= i < model.first_byte + 256 else model.pieces[i].encode() for i in ids)
    text = data.decode("utf-8", "replace").replace(SPACE, " ")
    return text[1:] if text.startswith(" ") else text


def _encode(model: Model, folder: str, text: str, decoded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, first = read_words(folder, TaskContext.get().partitionId(), model), model.first_byte
        raw = [bytes([i - first]) if first <= i < first + 256 else p.encode() for i, p in enumerate(model.pieces)]
        letters, size_of = np.frombuffer(b"".join(raw), dtype=np.uint8), np.array([len(x) for x in raw])
        begin_of, runs, number = np.cumsum(size_of) - size_of, Runs(), {}
        for batch in batches:
            if not number or len(runs.ids) > IDS_HELD:
                runs = Runs()
                number = {prefix: Encoder(model, words, prefix, runs).__getitem__ for prefix in ("", SPACE)}
            line, ends, given = array("i"), [0], batch.column(text).to_pylist()
            for t in given:
                for prefix, found in split(t) if t else ():
                    line.extend(map(number[prefix], found))
                ends.append(len(line))
            rows = np.frombuffer(line, dtype=np.int32) if line else np.zeros(0, np.int32)
            held, stops = np.array(runs.ids, dtype=np.int32), np.array(runs.ends)
            size = stops[rows + 1] - stops[rows]
            flat = held[_spread(stops[rows], size)]
            ends = np.r_[0, np.cumsum(size)][ends]
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            columns = [*batch.columns, ids, pa.array(np.diff(ends), pa.int32())]
            if decoded:
                data = letters[_spread(begin_of[flat], size_of[flat])].tobytes()
                at = np.r_[0, np.cumsum(size_of[flat])][ends].tolist()
                back = (data[a:b].decode("utf-8", "replace").replace(SPACE, " ")[1:] for a, b in zip(at, at[1:], strict=False))
                columns.append(pa.array([None if t is None else x for t, x in zip(given, back, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "ids", "n_tokens"] + ["decoded"] * decoded)

    return run


def encode_documents(docs: DataFrame, model: Model, text: str = "text", decoded: bool = False) -> DataFrame:
    """The rows of docs with ids and n_tokens, and the decoded text if asked for.

    Null and empty texts have no ids; a null text decodes to null. Texts hold spaces for U+2581
    once decoded, as the model makes no difference. Repeated rows get equal results. Columns of
    docs named ids, n_tokens or decoded are replaced. An empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.drop("ids", "n_tokens", "decoded")
    folder = cut_words(docs, model, text)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(_encode(model, folder, text, decoded), f"{kinds}, ids array<int>, n_tokens int" + ", decoded string" * decoded)
