"""All queries of the recordings library and their SQL."""

from __future__ import annotations

from . import counts, files, signals, spectra, stats, trains  # noqa: F401
from .base import ORACLES, QUERIES

FLAGSHIP = "e5_part_table"


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
