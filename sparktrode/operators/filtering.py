"""Zero-phase filters over long recordings, as a scan over blocks.

A pass reads its blocks twice: once for the state that each block ends in, once from the true
states, which a row a block carries along a series. Blocks between two passes are a table in the
shared folder, so nothing is worked out again.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktrode.functions import filters as C
from sparktrode.sources.tables import discard, written

from .samples import BLOCK, SERIES

_KEYS = "recording_index int, channel string, block long"
_BLOCKS = f"{_KEYS}, n0 long, first boolean, last boolean, x array<double>"
Change = Callable[[np.ndarray, bool, bool], np.ndarray]


def to_blocks(samples: DataFrame, block: int = BLOCK) -> DataFrame:
    """Runs of `block` samples, the last takes the rest: series, block, n0, first, last, x."""
    size = samples.groupBy(*SERIES).agg(F.floor(F.min("n") / block).alias("low"), F.floor((F.max("n") + 1) / block).alias("high"))
    high = F.greatest(F.col("high") - 1, F.col("low"))
    rows = samples.join(size, SERIES).withColumns({"high": high, "block": F.least(F.floor(F.col("n") / block), high)})
    rows = rows.groupBy(*SERIES, "block", "low", "high").agg(F.array_sort(F.collect_list(F.struct("n", "x_uv"))).alias("s"))
    return rows.select(*SERIES, "block", F.col("s")[0]["n"].alias("n0"), (F.col("block") == F.col("low")).alias("first"), (F.col("block") == F.col("high")).alias("last"), F.col("s.x_uv").alias("x"))


def to_samples(blocks: DataFrame) -> DataFrame:
    return blocks.select(*SERIES, "n0", F.posexplode("x").alias("k", "x_uv")).select(*SERIES, (F.col("n0") + F.col("k")).alias("n"), "x_uv")


def _same(x: np.ndarray, first: bool, last: bool) -> np.ndarray:
    return x


def _pass(blocks: DataFrame, sections: np.ndarray, opening: Callable[[np.ndarray], tuple[int, np.ndarray]], backward: bool, before: Change = _same, after: Change = _same) -> DataFrame:
    """One pass over blocks that `before` changes; `after` changes what comes out.

    `opening` gives, for the first block in the direction of the pass, how many samples are copied
    and the state after them.
    """
    shape = (len(sections), 2)
    power: dict[int, np.ndarray] = {}

    def rows(pdf: pd.DataFrame):
        for x, first, last in zip(pdf["x"], pdf["first"], pdf["last"], strict=True):
            x = before(np.asarray(x, dtype=float), first, last)
            yield (x[::-1] if backward else x), (last if backward else first)

    def ends(batches):
        for pdf in batches:
            size, out = [], []
            for x, opens in rows(pdf):
                skip, z = opening(x) if opens else (0, np.zeros(shape))
                size.append(len(x))
                out.append(C.scan(sections, x[skip:], z)[1].ravel())
            yield pdf[[*SERIES, "block"]].assign(size=size, end=out)

    def carry(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block", ascending=not backward, kind="stable")
        z, starts = None, []
        for size, end in zip(pdf["size"], pdf["end"], strict=True):
            starts.append(z)
            if z is None:
                z = np.asarray(end)
                continue
            if size not in power:
                power[size] = np.linalg.matrix_power(C.step_matrix(sections), int(size))
            z = power[size] @ z + np.asarray(end)
        return pdf[[*SERIES, "block"]].assign(start=starts)

    def again(batches):
        for pdf in batches:
            out = []
            for (x, _), start, first, last in zip(rows(pdf), pdf["start"], pdf["first"], pdf["last"], strict=True):
                skip, z = opening(x) if start is None else (0, np.asarray(start).reshape(shape))
                y = np.r_[x[:skip], C.scan(sections, x[skip:], z)[0]]
                out.append(after(y[::-1] if backward else y, first, last))
            yield pdf[[*SERIES, "block", "n0", "first", "last"]].assign(x=out)

    ended = blocks.mapInPandas(ends, f"{_KEYS}, size long, end array<double>")
    starts = ended.groupBy(*SERIES).applyInPandas(carry, f"{_KEYS}, start array<double>")
    return blocks.join(starts, [*SERIES, "block"]).mapInPandas(again, _BLOCKS)


def _extension(pad: int) -> tuple[Change, Change]:
    """Odd extension of a series at both ends, and its removal."""

    def extend(x: np.ndarray, first: bool, last: bool) -> np.ndarray:
        p = min(pad, len(x) - 1)
        return np.r_[2 * x[0] - x[p:0:-1] if first else x[:0], x, 2 * x[-1] - x[-2 : -p - 2 : -1] if last else x[:0]]

    def cut(x: np.ndarray, first: bool, last: bool) -> np.ndarray:
        # a series of n samples in one block was extended by min(pad, n - 1)
        p = (len(x) - 1) // 3 if first and last and len(x) < 3 * pad + 1 else pad
        return x[p if first else 0 : len(x) - p if last else len(x)]

    return extend, cut


def zero_phase(samples: DataFrame, band: tuple[float | None, float | None], fs_hz: float, order: int = 4, variant: str = "A", block: int = BLOCK) -> DataFrame:
    """Butterworth forward and backward with odd extension and steady-state starts.

    Variant A: the band is made safe and the extension is 3 (2 sections + 1) samples; B: the band
    is cut at 1e-6 and 0.999999 of Nyquist and the extension is 3 (2 order + 1).
    """
    sections, pad = zero_phase_design(band, fs_hz, order, variant)
    zi = C.steady_state(sections)
    opening = lambda x: (0, zi * x[0])
    extend, cut = _extension(pad)
    blocks = written(to_blocks(samples, block), "blocks")
    forward = written(_pass(blocks, sections, opening, False, before=extend), "blocks")
    discard(blocks)
    return to_samples(_pass(forward, sections, opening, True, after=cut))


def zero_phase_design(band: tuple[float | None, float | None], fs_hz: float, order: int, variant: str) -> tuple[np.ndarray, int]:
    """The sections and the length of the extension of a variant."""
    if variant == "A":
        lo, hi = C.safe_band(*band, fs_hz)
        if lo is None and hi is None:
            raise ValueError("a band needs an end")
    else:
        lo, hi = max(band[0], 1e-6 * fs_hz / 2), min(band[1], 0.999999 * fs_hz / 2)
    sections = C.butterworth(order, (lo, hi), fs_hz)
    return sections, 3 * (2 * len(sections) + 1) if variant == "A" else 3 * (2 * order + 1)


def notch_filter(samples: DataFrame, metadata: DataFrame, width_hz: float = 10.0, block: int = BLOCK) -> DataFrame:
    """Notch of the recordings whose header asks for 50 or 60 Hz, below version 3; others stay.

    metadata: recording_index, fs_hz, notch_hz and, if known, version_major, a row a recording. The
    first two samples are copied.
    """
    on = metadata.filter("notch_hz in (50, 60)" + (" and version_major < 3" if "version_major" in metadata.columns else ""))
    plans = on.select("fs_hz", "notch_hz").distinct().collect()  # a row for each kind of notch
    out = samples.join(F.broadcast(on.select("recording_index")), "recording_index", "left_anti").select(*SERIES, "n", "x_uv")
    for plan in plans:
        sections = C.notch(plan["fs_hz"], plan["notch_hz"], width_hz)

        def start(x: np.ndarray, c=tuple(sections[0][1:])) -> tuple[int, np.ndarray]:
            b1, b2, a1, a2 = c
            if len(x) < 2:
                return len(x), np.zeros((1, 2))
            return 2, np.array([[b1 * x[1] + b2 * x[0] - a1 * x[1] - a2 * x[0], b2 * x[1] - a2 * x[1]]])

        mine = on.filter((F.col("fs_hz") == plan["fs_hz"]) & (F.col("notch_hz") == plan["notch_hz"])).select("recording_index")
        part = samples.join(F.broadcast(mine), "recording_index", "left_semi").select(*SERIES, "n", "x_uv")
        out = out.unionByName(to_samples(_pass(written(to_blocks(part, block), "blocks"), sections, start, False)))
    return out
