"""Exact percentiles of scenes of any size, by repeated refinement of buckets over the ordered bits of values.

A double's bits, with those of negative numbers turned over, order as the numbers do. The first turn counts values by their
upper 16 bits; the buckets that hold the wanted ranks are parted by the next 16, and so on. After at most four turns a bucket
is one value, and mostly earlier, as a bucket whose smallest and largest values are equal needs no more. What a turn keeps of a
scene and band is at most 65,536 counts for each bucket that holds a wanted rank, whatever the number of pixels or of
distinct values. Values are packed into arrays where they are, once, so a turn meets the wanted buckets by the chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from .components import settled

STEP, TURNS = 16, 4
#: Pixels of a scene from which ``profile`` selects instead of counting distinct values.
LARGE = 1 << 20

C = F.col


def ordered(values: np.ndarray) -> np.ndarray:
    """Integers in the order of the doubles; both zeros are one, and NaN is above everything."""
    values = np.where(np.isnan(values), np.nan, values + 0.0)
    bits = np.ascontiguousarray(values).view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))


def packed(pixels: DataFrame, bands: list[str]) -> DataFrame:
    """(scene_id, band, v): the values of each scene and band of a batch as one array; nulls are left out."""
    schema = StructType([StructField("scene_id", pixels.schema["scene_id"].dataType), *StructType.fromDDL("band int, v array<double>")])
    kind = to_arrow_type(schema[0].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column(0).dictionary_encode(null_encoding="encode")
            scene = names.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(scene, kind="stable")
            edges = np.flatnonzero(np.diff(scene[order], prepend=-1))
            ids, numbers, arrays = [], [], []
            for start, end in zip(edges, [*edges[1:], len(order)]):
                rows = pa.array(order[start:end])
                for k in range(len(bands)):
                    own = batch.column(k + 1).take(rows).drop_null()
                    if len(own):
                        ids.append(int(order[start]))
                        numbers.append(k)
                        arrays.append(own.to_numpy())
            offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
            flat = pa.array(np.concatenate(arrays) if arrays else np.empty(0))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())).cast(kind), pa.array(numbers, pa.int32()), pa.ListArray.from_arrays(offsets, flat)], ["scene_id", "band", "v"])

    return pixels.select("scene_id", *[C(b).cast("double").alias(b) for b in bands]).mapInArrow(run, schema)


def counted(chunks: DataFrame, turn: int) -> DataFrame:
    """(scene_id, band, parent, bucket, n, low, high) of the wanted buckets' parts. ``chunks`` has ``wanted`` from the second turn on."""
    schema = StructType([chunks.schema["scene_id"], *StructType.fromDDL("band int, bucket long, n long, low double, high double")])
    shift = 64 - STEP * (turn + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for k, (v, wanted) in enumerate(zip(batch.column(2), batch.column(3))):
                values = v.values.to_numpy()
                key = ordered(values)
                if turn:
                    own = np.isin(key >> (shift + STEP), wanted.values.to_numpy())
                    key, values = key[own], values[own]
                if len(key):
                    order = np.argsort(key, kind="stable")
                    bucket, first, n = np.unique(key[order] >> shift, return_index=True, return_counts=True)
                    made.append((np.full(len(bucket), k), bucket, n, values[order][first], values[order][first + n - 1]))
            if made:
                rows, *rest = (np.concatenate(c) for c in zip(*made))
                rows = pa.array(rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), *map(pa.array, rest)], ["scene_id", "band", "bucket", "n", "low", "high"])

    parts = chunks.select("scene_id", "band", "v", "wanted" if turn else F.lit(None).cast("array<long>").alias("wanted")).mapInArrow(run, schema)
    whole = parts.groupBy("scene_id", "band", "bucket").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    return whole.withColumn("parent", F.shiftright("bucket", STEP) if turn else F.lit(0).cast("long"))


def percentiles(pixels: DataFrame, bands: list[str], percents: tuple[int, ...]) -> DataFrame:
    """(scene_id, {band}_p{percent} ...), interpolated linearly between ranks, as ``percentile`` gives them.

    Null values don't count; a band without values has nulls. A missing scene_id is a scene of its own.
    """
    chunks = settled(packed(pixels, bands))
    sizes = chunks.groupBy("scene_id", "band").agg(F.sum(F.size("v")).alias("total"))
    shares = F.explode(F.array(*[F.lit(p / 100.0) for p in percents]))
    place = sizes.select("scene_id", "band", "total", shares.alias("share")).withColumn("at", C("share") * (C("total") - 1))
    ranks = place.select("scene_id", "band", F.explode(F.array(F.floor("at"), F.ceil("at"))).alias("rank")).distinct()
    state = ranks.select("scene_id", "band", "rank", F.lit(0).cast("long").alias("parent"), C("rank").alias("left"))
    found = []
    for turn in range(TURNS):
        own = chunks
        if turn:
            wanted = state.groupBy("scene_id", "band").agg(F.collect_set("parent").alias("wanted"))
            own = chunks.alias("c").join(wanted.alias("w"), F.expr("c.scene_id <=> w.scene_id AND c.band = w.band")).select("c.*", "w.wanted")
        hist = counted(own, turn)
        upto = F.sum("n").over(Window.partitionBy("scene_id", "band", "parent").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
        hist = hist.withColumn("end", upto).withColumn("start", C("end") - C("n"))
        step = state.alias("s").join(hist.alias("h"), F.expr("s.scene_id <=> h.scene_id AND s.band = h.band AND s.parent = h.parent AND s.left >= h.start AND s.left < h.end"))
        step = settled(step.select("s.scene_id", "s.band", "s.rank", C("h.bucket").alias("parent"), (C("s.left") - C("h.start")).alias("left"), "h.low", "h.high"))
        done = (C("low") == C("high")) | F.lit(turn == TURNS - 1)
        found.append(step.where(done).select("scene_id", "band", "rank", C("low").alias("value")))
        state = step.where(~done).select("scene_id", "band", "rank", "parent", "left")
        if state.isEmpty():
            break
    values = found[0]
    for more in found[1:]:
        values = values.unionByName(more)
    by_rank = values.groupBy("scene_id", "band").agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("of"), F.count("*").alias("_n"))
    both = sizes.alias("a").join(by_rank.alias("b"), F.expr("a.scene_id <=> b.scene_id AND a.band = b.band")).select("a.scene_id", "a.band", "a.total", "b.of")

    def value(p: int) -> Column:
        at = F.lit(p / 100.0) * (C("total") - 1)
        low, high = C("of")[F.floor(at)], C("of")[F.ceil(at)]
        return F.when((F.floor(at) == F.ceil(at)) | (low == high), low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)

    wide = both.select("scene_id", "band", *[value(p).alias(f"p{p}") for p in percents])
    return wide.groupBy("scene_id").agg(*[F.max(F.when(C("band") == k, C(f"p{p}"))).alias(f"{b}_p{p}") for k, b in enumerate(bands) for p in percents])


def large(pixels: DataFrame) -> bool:
    """Whether any scene has more than LARGE pixels. ``pixels`` is counted, so it should be at rest."""
    most = pixels.groupBy("scene_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    return (most or 0) > LARGE
