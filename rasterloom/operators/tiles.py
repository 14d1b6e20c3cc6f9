"""Functions of whole tiles, with a halo around each, over scenes of any size."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Pixels along a side of a tile.
SIDE = 256


def mapped(pixels: DataFrame, bands: list[str], function: Callable[[dict[str, np.ndarray]], np.ndarray], out: str, halo: int, tile: int = SIDE) -> DataFrame:
    """(scene_id, y, x, out): ``function`` of every tile, for the pixels that the tile is for.

    ``function`` maps arrays of the bands (rows, columns) to one of that shape. Its arrays reach ``halo`` pixels beyond the
    tile, less at the borders of a scene, where they end as the scene does; missing pixels and nulls are 0. A pixel is sent to
    its tile and to those whose halo it is in, in one exchange; a task holds one tile at a time.
    """
    if tile < 1 or halo < 0:
        raise ValueError("a tile has a side of at least 1 and a halo of at least 0")
    place = lambda c: F.explode(F.sequence(F.greatest(F.floor((F.col(c) - halo) / tile), F.lit(0)), F.floor((F.col(c) + halo) / tile))).alias(f"_{c}")
    own = pixels.select("scene_id", *[F.col(c).cast("int").alias(c) for c in "yx"], *[F.coalesce(F.col(b).cast("double"), F.lit(0.0)).alias(b) for b in bands])
    sent = own.select("*", place("y")).select("*", place("x"))
    schema = StructType([pixels.schema["scene_id"], *StructType.fromDDL(f"y int, x int, `{out}` double")])

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        y, x = (rows.column(c).to_numpy() for c in "yx")
        top, left = y.min(), x.min()
        shape, at = (y.max() - top + 1, x.max() - left + 1), (y - top, x - left)
        mine = (y // tile == key[1].as_py()) & (x // tile == key[2].as_py())
        if not mine.any():  # beyond the scene
            return rows.select(["scene_id", "y", "x"]).slice(0, 0).append_column(out, pa.array([], pa.float64()))
        grids = {}
        for b in bands:
            grids[b] = np.zeros(shape)
            grids[b][at] = rows.column(b).to_numpy()
        values = np.asarray(function(grids), np.float64)
        if values.shape != shape:
            raise ValueError(f"a tile of {shape} became one of {values.shape}")
        return rows.select(["scene_id", "y", "x"]).append_column(out, pa.array(values[at])).filter(pa.array(mine))

    return sent.groupBy("scene_id", "_y", "_x").applyInArrow(run, schema)
