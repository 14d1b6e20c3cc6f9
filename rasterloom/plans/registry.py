"""Registry of queries and of the SQL that other engines can answer them with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

TILES = "tiles AS (SELECT vec_id AS scene_id, ((i - 1) // 8)::INT AS y, ((i - 1) % 8)::INT AS x, least(greatest((embedding[i]::DOUBLE + 0.6) / 1.2, 0.0), 1.0) AS v FROM embeddings, range(1, 65) t(i))"
SIX = "six0 AS (SELECT scene_id // 6 AS scene_id, y, x, " + ", ".join(f"max(CASE WHEN scene_id % 6 = {k} THEN v END) AS v{k}" for k in range(6)) + " FROM tiles GROUP BY ALL), six AS (SELECT * FROM six0 WHERE v5 IS NOT NULL)"


def _band(number: int, ground, water, urban, wet: str) -> str:
    pick = lambda i: f"CASE WHEN {wet} THEN {water[i]}::DOUBLE WHEN town THEN {urban[i]}::DOUBLE ELSE {ground[i]}::DOUBLE END"
    noise = f"(((x * 73 + y * 151 + x * y * 37 + k * 31 + {number * 17}) % 97)::DOUBLE / 97.0)"
    return f"({pick(0)}) + (({pick(1)}) - ({pick(0)})) * {noise}"


def _scenes() -> str:
    from ..sources.synth import BANDS

    def block(a: str, h: int, w: int) -> str:
        y0, x0 = f"((k * 7 + {a}) % {64 - h})", f"((k * 11 + ({a}) * 3) % {64 - w})"
        return f"y >= {y0} AND y < {y0} + {h} AND x >= {x0} AND x < {x0} + {w}"

    shift = "(CASE WHEN k % 2 = 0 THEN 0 ELSE 6 END)"
    bands = ", ".join(f"{_band(*BANDS[n], 'wet_s' if n.startswith('v') else 'wet_o')} AS {n}" for n in BANDS)
    moved = ", ".join(f"{_band(*BANDS[n], 'wet_s')} AS {n}m" for n in ("b02", "b03", "b04"))
    return f"grid AS (SELECT s_suppkey AS k, (i // 64) AS y, (i % 64) AS x FROM supplier, range(4096) t(i)), flags AS (SELECT *, {block('0', 20, 24)} AS wet_o, {block(shift, 20, 24)} AS wet_s, {block('29', 10, 12)} AS town FROM grid), scenes AS (SELECT k AS scene_id, y::INT AS y, x::INT AS x, {bands}, {moved} FROM flags)"


SCENES = _scenes()


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = " ".join(sql.split()) if "'" not in sql else sql.strip()
        return f

    return add


def exact(e: str, digits: int) -> str:
    """SQL that rounds a double's exact binary value, ties to even, where ``round`` may see a tie of its shortest decimal."""
    return f"printf('%.{digits}f', {e})::DOUBLE"


def shortest(e: str, digits: int) -> str:
    """SQL of the same as text without needless zeros."""
    return rf"regexp_replace(regexp_replace(printf('%.{digits}f', {e}), '0+$', ''), '\.$', '.0')"


def r6(c: str | Column, name: str | None = None) -> Column:
    """Doubles leave as six decimals."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name or c)
