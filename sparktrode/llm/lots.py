"""Lots of whole texts as rows of a written table.

Operators that pass several times over all texts, and are told something about each lot in between,
deal the texts into lots once: a row holds some megabytes of texts, packed. What is found out
elsewhere about a lot comes back to it by an equal join on its number, which never changes once the
table is written.
"""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, written

#: Bytes of texts in a lot; a longer text is a lot of its own.
LOT_BYTES = 4 << 20
NO_ID = np.iinfo(np.int64).max


def pack(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def unpack(blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8)


@dataclasses.dataclass
class Lot:
    """The texts of a lot: text i is data[starts[i]:starts[i + 1]], in UTF-8."""

    number: int
    ids: np.ndarray  # a missing id is NO_ID
    starts: np.ndarray
    data: np.ndarray
    extra: np.ndarray | None = None

    @classmethod
    def of(cls, row: object) -> Lot:
        lengths = np.asarray(row.lengths, dtype=np.int64)
        extra = np.asarray(row.extra, dtype=object) if hasattr(row, "extra") else None
        return cls(int(row.lot), np.asarray(row.ids, dtype=np.int64), np.r_[0, np.cumsum(lengths)], unpack(row.texts), extra)

    def doc_ids(self) -> pd.Series:
        return pd.Series(self.ids, dtype="Int64").mask(self.ids == NO_ID)

    def pieces(self, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
        """Ranges of texts of about `size` bytes each, so that work on them stays in the cache."""
        i, n = 0, len(self.ids)
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.starts, self.starts[i] + size, side="right")) - 1)
            yield i, min(j, n)
            i = j


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a column of strings without nulls."""
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[at[0] : at[-1]], np.diff(at)


def lots(docs: DataFrame, extra: str | None = None, size: int = LOT_BYTES) -> DataFrame:
    """(lot, ids, lengths, texts[, extra]) as a written table; null texts count as empty.

    doc_id must be an integer, or castable to one; `extra` names a column of strings to keep.
    """
    bounded_batches(docs.sparkSession)
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(max(4 * LOT_BYTES, size)))
    keep = [F.coalesce(F.col(extra).cast("string"), F.lit("und")).alias("extra")] if extra else []
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *keep)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0

        def row() -> pa.RecordBatch:
            ids, lengths, others, data = (np.concatenate(x) for x in zip(*held, strict=True))
            columns = [pa.array([ids]), pa.array([lengths]), pa.array([pack(data.tobytes())], pa.binary())]
            names = ["ids", "lengths", "texts"]
            if extra:
                columns, names = [*columns, pa.array([list(others)], pa.list_(pa.string()))], [*names, "extra"]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            data, lengths = _texts(batch.column("text"))
            ids = batch.column("id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
            others = batch.column("extra").to_numpy(zero_copy_only=False) if extra else np.zeros(len(ids), np.int8)
            ends = np.cumsum(lengths)
            i = 0
            while i < len(ids):
                base = ends[i] - lengths[i]
                j = max(i + 1, int(np.searchsorted(ends, base + size - total, side="right")))
                if held and total and total + ends[i] - base > size:  # the next text alone is too long
                    yield row()
                    held, total = [], 0
                    continue
                held.append((ids[i:j], lengths[i:j], others[i:j], data[base : ends[j - 1]]))
                total += int(ends[j - 1] - base)
                i = j
                if total >= size:
                    yield row()
                    held, total = [], 0
        if held:
            yield row()

    schema = "ids array<long>, lengths array<long>, texts binary" + (", extra array<string>" if extra else "")
    return written(rows.mapInArrow(gather, schema).select(F.monotonically_increasing_id().alias("lot"), "*"), "lots")


def each_lot(table: DataFrame, work: Callable[[Lot, object], pd.DataFrame], schema: str) -> DataFrame:
    """The rows that `work` makes of each lot, one lot at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for row in pdf.itertuples(index=False):
                yield work(Lot.of(row), row)

    return table.mapInPandas(run, schema)


def total_bytes(table: DataFrame) -> int:
    """UTF-8 bytes of all texts of lots."""
    return table.agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0


def buckets_for(table: DataFrame, size: float, bucket_bytes: int = 8 << 20) -> int:
    """How many buckets `size` bytes are dealt to: one for each `bucket_bytes`, or each task."""
    return max(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / bucket_bytes))


def with_replies(table: DataFrame, replies: DataFrame, order: str = "bucket") -> DataFrame:
    """lots with `replies`, an array of the rows of (lot, bucket, ...) for it by bucket; null without any.

    Both are dealt by lot whatever their size: a broadcast of a small corpus's replies would make the
    work of a larger one another than that of the small one.
    """
    by_lot = replies.groupBy("lot").agg(F.sort_array(F.collect_list(F.struct(order, *[c for c in replies.columns if c not in ("lot", order)]))).alias("replies"))
    return table.hint("merge").join(by_lot, "lot", "left")


def by_bucket(hashes: np.ndarray, n: int) -> np.ndarray:
    """Where each bucket starts among sorted 64-bit hashes, and the end: equal ranges of hashes."""
    edges = np.array([(b << 64) // n for b in range(n)], dtype=np.uint64)
    return np.r_[np.searchsorted(hashes, edges), len(hashes)]
