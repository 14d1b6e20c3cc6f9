"""Registered queries of the raster engine and their SQL."""

from __future__ import annotations

from . import cases, files, pixel, scene, words  # noqa: F401 - importing registers
from .registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
