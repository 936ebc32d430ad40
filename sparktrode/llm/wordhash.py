"""Hashes of the words of many texts at once, in numpy arrays.

A word's hash is a polynomial of its characters modulo 2 ** 64, mixed; sums of powers over the whole
lot give every word's polynomial by one subtraction.
"""

from __future__ import annotations

import functools

import numpy as np

BASE = 0x9E3779B97F4A7C15


@functools.cache
def letters() -> np.ndarray:
    """For each code point its lower-case letter or digit, or 0."""
    out = np.zeros(0x110000, dtype=np.uint64)
    for c in range(0x110000):
        if (x := chr(c)).isalnum():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


@functools.cache
def ascii_words() -> np.ndarray:
    """For each byte itself with A-Z in lower case, or 0 for ASCII white space."""
    out = np.arange(256, dtype=np.uint64)
    out[ord("A") : ord("Z") + 1] += 32
    out[[0x20, *range(0x09, 0x0E)]] = 0
    out[0] = 256
    return out


@functools.lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2 ** 64."""
    inverse = pow(BASE, -1, 1 << 64)
    with np.errstate(over="ignore"):
        up, down = (np.cumprod(np.r_[np.uint64(1), np.full(n, b, dtype=np.uint64)]) for b in (BASE, inverse))
    return up, down


def mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def runs(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place of each run of non-zero points, and the place after it."""
    inside = points > 0
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(points) and inside[0]:
        edges = np.r_[0, edges]
    if len(points) and inside[-1]:
        edges = np.r_[edges, len(points)]
    return edges[::2], edges[1::2]


def hash_runs(points: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the runs of points."""
    up, down = _powers(1 << max(12, int(len(points)).bit_length()))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(points) + 1, dtype=np.uint64)
        np.cumsum(points * up[: len(points)], out=sums[1:])
        return mixed((sums[end] - sums[first]) * down[first])


def text_points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters and digits of all texts as code points, 0 elsewhere and once after each
    text; and where each text starts."""
    joined = "\n".join(x or "" for x in texts) + "\n"
    points = letters()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")]
    return points, np.r_[0, np.cumsum(np.array([len(x or "") + 1 for x in texts], dtype=np.int64))]


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs of letters and digits, in lower case) of all texts, and where each
    text's words start."""
    points, starts = text_points(texts)
    first, end = runs(points)
    return hash_runs(points, first, end), np.searchsorted(first, starts)


def spaced_tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words between ASCII white space, with A-Z in lower case, and their starts."""
    data = [(x or "").encode("utf-8", "surrogatepass") for x in texts]
    points = ascii_words()[np.frombuffer(b"\n".join(data) + b"\n", dtype=np.uint8)]
    first, end = runs(points)
    return hash_runs(points, first, end), np.searchsorted(first, np.r_[0, np.cumsum(np.array([len(x) + 1 for x in data], dtype=np.int64))])
