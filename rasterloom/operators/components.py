"""Connected components of masks, 4-connected, numbered from 1 in the order of their first pixel.

``grouped`` labels whole scenes, many of them in one Arrow batch, and suits scenes that fit in a task. ``distributed`` turns
rows of the mask into runs, labels blocks of rows where they are, links what overlaps across their borders, and resolves the
links by repeated contraction to the smallest run, each turn checkpointed; no scene needs to fit in one task. Scenes may be named by values of any type.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Beyond any x, which is a 32-bit integer as y is: no two runs have one name.
STRIDE = 1 << 31
#: Rows of a scene that are labelled together.
ROWS = 64


def label_grid(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Labels of mask pixels given in row-major order, by union-find over runs."""
    n = len(y)
    new = np.ones(n, bool)
    new[1:] = (y[1:] != y[:-1]) | (x[1:] != x[:-1] + 1)
    run = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    last = np.append(first[1:], n) - 1
    parent = list(range(len(first)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    line, low, high, above = y[first], x[first], x[last], 0
    for k in range(len(first)):
        while above < k and (line[above] < line[k] - 1 or (line[above] == line[k] - 1 and high[above] < low[k])):
            above += 1
        j = above
        while j < k and line[j] == line[k] - 1 and low[j] <= high[k]:
            a, b = root(j), root(k)
            parent[max(a, b)] = min(a, b)
            j += 1
    roots = np.array([root(i) for i in range(len(first))], np.int64)
    return np.unique(roots, return_inverse=True)[1][run] + 1 if n else np.empty(0, np.int64)


def label_scenes(scene: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Labels of the pixels of several scenes, each from 1; rows are ordered by scene, y and x. ``scene``: numbers from 0."""
    # lines count on from scene to scene, with a gap that keeps scenes apart
    n = len(y)
    step = np.ones(n, np.int64)
    step[1:] = np.where(scene[1:] != scene[:-1], 2, np.minimum(y[1:].astype(np.int64) - y[:-1], 2))
    label = label_grid(np.cumsum(step), x)
    first = np.searchsorted(scene, np.arange(scene[-1] + 1))
    return label - label[first][scene] + 1  # a scene's first pixel has its smallest label


def numbered(ids: pa.Array) -> np.ndarray:
    """Numbers from 0 of runs of equal ids, which may be structs; a missing id is a scene of its own."""
    new = np.zeros(len(ids) - 1, bool)
    for part in ids.flatten() if pa.types.is_struct(ids.type) else [ids]:
        codes = part.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new |= codes[1:] != codes[:-1]
    return np.concatenate([[0], np.cumsum(new)])


def whole_scenes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, pa.Table]]:
    """(ids, scene numbers, y, x, all columns) of whole scenes, of rows that are ordered by scene; a scene may span batches."""
    held: list[pa.RecordBatch] = []  # begins with a scene that may go on

    def taken(parts: list[pa.RecordBatch]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, pa.Table]:
        table = pa.Table.from_batches(parts)
        ids = table.column(0).combine_chunks()
        return ids, numbered(ids), table.column(1).to_numpy(), table.column(2).to_numpy(), table

    for batch in batches:
        if not batch.num_rows:
            continue
        scene = numbered(batch.column(0))
        last = int(np.searchsorted(scene, scene[-1]))
        goes_on = held and batch.column(0)[0] == held[-1].column(0)[-1]
        if last or (held and not goes_on):
            yield taken([*held, batch.slice(0, last)] if last else held)
            held = []
        held.append(batch.slice(last))
    if held:
        yield taken(held)


def grouped(mask: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``mask``: scene_id, y, x of the pixels that are set. Adds ``label``; columns named in ``keep`` come along."""
    rows = mask.select("scene_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), *(keep or []))
    schema = StructType([*rows.schema, *StructType.fromDDL("label long")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, scene, y, x, table in whole_scenes(batches):
            yield from table.append_column("label", pa.array(label_scenes(scene, y, x))).combine_chunks().to_batches()

    return rows.repartition("scene_id").sortWithinPartitions("scene_id", "y", "x").mapInArrow(run, schema)


def runs(mask: DataFrame) -> DataFrame:
    """(scene_id, y, lo, hi, run): horizontal runs, each with the first run that it hangs together with within its block of ROWS rows.

    Runs are named by their first pixel's place in row-major order.
    """
    schema = StructType([StructField("scene_id", mask.schema["scene_id"].dataType), *StructType.fromDDL("y int, lo int, hi int, run long")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, scene, y, x, _ in whole_scenes(batches):
            _, head, own = np.unique(np.stack([scene, label_scenes(scene, y, x)]), axis=1, return_index=True, return_inverse=True)
            name = (y.astype(np.int64) * STRIDE + x)[head[own.ravel()]]
            new = np.ones(len(y), bool)
            new[1:] = (scene[1:] != scene[:-1]) | (y[1:] != y[:-1]) | (x[1:] != x[:-1] + 1)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(y)) - 1
            yield pa.RecordBatch.from_arrays([ids.field("scene_id").take(pa.array(first)), pa.array(y[first]), pa.array(x[first]), pa.array(x[last]), pa.array(name[first])], ["scene_id", "y", "lo", "hi", "run"])

    rows = mask.select(F.struct("scene_id", F.floor(F.col("y") / ROWS).cast("int").alias("block")).alias("s"), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"))
    return rows.repartition("s").sortWithinPartitions("s", "y", "x").mapInArrow(run, schema)


def settled(df: DataFrame) -> DataFrame:
    """A reliable checkpoint where the session has a folder for one, else the plan as it is written to a table of the session."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            import tempfile

            base = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(base)
    return df.checkpoint()


def met(a: DataFrame, b: DataFrame, *on: str, how: str = "inner") -> DataFrame:
    """Join on the scene, of which a missing one is one too, and on columns."""
    other = b.select(*[F.col(c).alias("_r_" + c) if c in ("scene_id", *on) else F.col(c) for c in b.columns])
    same = F.col("scene_id").eqNullSafe(F.col("_r_scene_id"))
    for c in on:
        same = same & (F.col(c) == F.col("_r_" + c))
    return a.join(other, same, how).drop("_r_scene_id", *["_r_" + c for c in on])


#: Links that one task contracts; more are contracted by joins.
LINKS = 1 << 20


def contracted(edges: DataFrame) -> DataFrame:
    """(scene_id, run, root) of few links (scene_id, a, b), by union-find in one task."""
    schema = StructType([edges.schema["scene_id"], *StructType.fromDDL("run long, root long")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = [b for b in batches if b.num_rows]
        if not some:
            return
        table = pa.Table.from_batches(some)
        ids = table.column(0).combine_chunks()
        scene = ids.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
        parent: dict[tuple[int, int], tuple[int, int]] = {}
        first: dict[int, int] = {}

        def root(k: tuple[int, int]) -> tuple[int, int]:
            while (up := parent.setdefault(k, k)) != k:
                parent[k] = k = parent[up]
            return k

        for row, (s, a, b) in enumerate(zip(scene.tolist(), table.column(1).to_pylist(), table.column(2).to_pylist())):
            first.setdefault(s, row)
            x, y = root((s, a)), root((s, b))
            parent[max(x, y)] = min(x, y)
        keys = sorted(parent)
        yield pa.RecordBatch.from_arrays([ids.take(pa.array([first[s] for s, _ in keys])), pa.array([r for _, r in keys], pa.int64()), pa.array([root(k)[1] for k in keys], pa.int64())], ["scene_id", "run", "root"])

    return edges.select("scene_id", "a", "b").coalesce(1).mapInArrow(run, schema)


def contracted_by_joins(edges: DataFrame) -> DataFrame:
    """The same for any number of links: smallest neighbours are taken over until nothing changes, each turn checkpointed."""
    mark = None
    while True:
        both = edges.unionByName(edges.select("scene_id", F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("scene_id", "a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = met(both.where("b > a"), low, "a").select("scene_id", F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        low = large.groupBy("scene_id", "a").agg(F.min("b").alias("m"))
        pairs = F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))
        edges = settled(met(large, low, "a").select("scene_id", pairs.alias("e")).select("scene_id", "e.a", "e.b").where("a > b").distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("scene_id", "a", "b").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    return edges.groupBy("scene_id", F.col("a").alias("run")).agg(F.min("b").alias("root"))


def distributed(mask: DataFrame, few: int | None = None) -> DataFrame:
    """As ``grouped``, for scenes of any size. Blocks of rows are labelled where they are; only their borders are linked.

    ``few``: links that one task may contract, LINKS if not given.
    """
    r = settled(runs(mask))
    place = F.pmod("y", F.lit(ROWS))
    up = r.where(place == ROWS - 1).select("scene_id", (F.col("y") + 1).alias("y"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.col("run").alias("b"))
    links = met(r.where(place == 0), up, "y").where("lo <= hi2 AND lo2 <= hi").select("scene_id", F.col("run").alias("a"), "b")
    edges = settled(links.where("a > b").distinct())
    root = contracted(edges) if edges.count() <= (LINKS if few is None else few) else contracted_by_joins(edges)
    named = met(r, root, "run", how="left").withColumn("root", F.coalesce("root", "run"))
    heads = named.select("scene_id", "root").distinct().withColumn("label", F.row_number().over(Window.partitionBy("scene_id").orderBy("root")).cast("long"))
    wide = met(named, heads, "root")
    return wide.select("scene_id", "y", F.explode(F.sequence("lo", "hi")).alias("x"), "label")


#: Pixels of a scene's mask that one task labels.
LARGE = 1 << 22


def oversized(mask: DataFrame) -> bool:
    """Whether a scene's mask is too large for a task. The mask is counted, so it should be at rest."""
    most = mask.groupBy("scene_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    return (most or 0) > LARGE


def by_size(mask: DataFrame) -> DataFrame:
    """``grouped`` while every scene's mask fits in a task, else ``distributed``. The mask is counted, so it should be at rest."""
    return distributed(mask) if oversized(mask) else grouped(mask)


def labelled(pixels: DataFrame, label=by_size) -> DataFrame:
    """The pixels of a mask, all columns, with their ``label``. Those that are labelled in whole scenes take their columns along, others are joined."""
    if label is by_size:
        pixels = settled(pixels)
        label = distributed if oversized(pixels) else grouped
    if label is grouped:
        return grouped(pixels, [c for c in pixels.columns if c not in ("scene_id", "y", "x")])
    return pixels.hint("merge").join(label(pixels.select("scene_id", "y", "x")), ["scene_id", "y", "x"])
