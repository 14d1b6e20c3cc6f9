"""Embedding whitening: projections on the principal components of all vectors, scaled to unit variance.

An entry c becomes the whole number x = floor(64 c) + 1000000. Sums S of each dimension and the number n of vectors are whole
numbers too, so n x - S is exact, and one division centres a row without cancellation. ``RowMatrix.computeGramianMatrix`` of
the centred rows, divided by n, is the covariance; it comes to the driver as a matrix of dimension by dimension, whatever the
number of rows. There ``eigh`` finds the components, which go out as a broadcast of dimension by ``TOP`` numbers, and batches
of rows are projected on them. The whitened rows are written to the shared folder once; their means, their own Gramian
and the result are read from there.

Edge cases. Null vectors, and vectors with null or non-finite entries, are dropped; so are vectors of a length that isn't
the most frequent one (of the longest of those that tie), as they are not of the table's space, and vectors with an entry of
2**45 or more, whose x would not be exact in a double. Empty vectors count as null. A null vec_id stays null; repeated rows
count each time. A component without variance (that of a repeated vector, or of fewer vectors than dimensions) has a
null ``whitened``, as 0/0 has no value, and takes no part in ``identity_error``; ``explained`` is 0 there, and also
where the trace is 0. ``deviation`` is exact; where it exceeds a long, it is null. An empty table gives no rows. Other columns are not read.
Signs: the entry of a component that is largest in size (the first, among equals) is positive.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import cut

SCALE, OFFSET, LARGEST = 64.0, 1_000_000, float(1 << 45)
TOP = 32
#: Of the largest eigenvalue; below it a variance is rounding error.
RANK = 1e-11

C = F.col


def levels(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x): whole numbers of the vectors that can take part."""
    v = F.transform(df[vector_col], lambda c: c.cast("double"))
    rows = df.select(df[id_col].alias("vec_id"), v.alias("v"))
    good = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST))
    rows = rows.where(C("v").isNotNull() & (F.size("v") > 0) & good)
    # guarded, as the optimizer may evaluate it for rows that the filter drops
    return rows.select("vec_id", F.transform("v", lambda c: F.when(F.abs(c) < LARGEST, F.floor(c * SCALE) + OFFSET)).alias("x"))


class Fit:
    """What all vectors have in common: number, sums, components and their variances."""

    def __init__(self, n: int, sums: list[int], low: list[int], high: list[int]):
        self.n, self.sums = n, sums
        #: Bounds of the size of n x - S, and of n x.
        self.spread = max(max(abs(n * a - s), abs(n * b - s)) for a, b, s in zip(low, high, sums))
        self.product = n * max(max(map(abs, low)), max(map(abs, high)))

    def centred(self, x: Column) -> Column:
        """(n x - S) / n: the numerator is exact, in decimals where a long is too narrow."""
        kind = "long" if self.product + self.spread < 1 << 63 else "decimal(38,0)"
        sums = F.array(*[F.lit(str(s)).cast(kind) for s in self.sums])
        n = F.lit(self.n).cast("long" if kind == "long" else "decimal(18,0)")
        return F.zip_with(x, sums, lambda a, s: (n * a.cast("long" if kind == "long" else "decimal(19,0)") - s).cast("double") / float(self.n))


def gramian(rows: DataFrame, column: str) -> np.ndarray:
    """Of rows of doubles: the sum of outer products, added up in a tree over the executors."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(C(column)).alias("v")), "v")
    return RowMatrix(vectors).computeGramianMatrix().toArray()


def fitted(x: DataFrame) -> Fit | None:
    """Exact sums of the fit list; None if it is empty. ``x`` has vectors of one length."""
    one = x.select(F.posexplode("x").alias("i", "x")).groupBy("i").agg(F.count("*").alias("n"), F.sum(C("x").cast("decimal(20,0)")).alias("s"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    found = sorted(one.collect(), key=lambda r: r.i)  # as many rows as dimensions
    if not found:
        return None
    return Fit(found[0].n, [int(r.s) for r in found], [r.lo for r in found], [r.hi for r in found])


def components(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns), falling, at most TOP."""
    e, u = np.linalg.eigh((v + v.T) / 2)
    e, u = e[::-1][:TOP], u[:, ::-1][:, :TOP]
    place = np.argmax(np.abs(u) > np.abs(u).max(axis=0) * (1 - 1e-9), axis=0)
    return np.maximum(e, 0.0), u * np.where(u[place, np.arange(u.shape[1])] < 0, -1.0, 1.0)


def whitened(x: DataFrame, fit: Fit, scaled: np.ndarray) -> DataFrame:
    """(vec_id, deviation, w): rows projected on the columns of ``scaled``, unit eigenvectors over deviations."""
    narrow = fit.spread**2 * len(fit.sums) < 1 << 63 and fit.product + fit.spread < 1 << 63
    held = x.sparkSession.sparkContext.broadcast((fit.n, fit.sums, scaled))
    schema = StructType([StructField("vec_id", x.schema["vec_id"].dataType), *StructType.fromDDL("deviation long, w array<double>")])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, sums, matrix = held.value
        exact = np.int64 if narrow else object  # whole numbers of any size where 64 bits would not do
        s = np.array(sums, exact)
        for batch in batches:
            if len(batch):
                v = np.stack(batch.x.to_numpy()).astype(exact) * n - s
                size = [k if k < 1 << 63 else None for k in (v * v).sum(axis=1).tolist()]
                yield pd.DataFrame({"vec_id": batch.vec_id, "deviation": pd.array(size, "Int64"), "w": list((v.astype(np.float64) / n) @ matrix)})

    return x.mapInPandas(run, schema)


SCHEMA = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row for each remaining vector and component up to ``TOP``."""
    x = levels(df, id_col, vector_col)
    spark = df.sparkSession
    length = x.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    fit = fitted(x.where(F.size("x") == length.d)) if length else None
    if fit is None:
        return spark.createDataFrame([], f"vec_id {x.schema['vec_id'].dataType.simpleString()}, {SCHEMA}")
    x = x.where(F.size("x") == length.d)
    v = gramian(x.select(fit.centred(C("x")).alias("c")), "c") / fit.n
    e, u = components(v)
    trace = float(np.trace(v))
    full = e > RANK * max(e[0], 0.0) if len(e) else np.zeros(0, bool)
    scaled = np.where(full, u / np.sqrt(np.where(full, e, 1.0)), 0.0)
    w = cut(whitened(x, fit, scaled), "whitened")
    error = None
    if full.any():
        means = w.select(F.posexplode("w").alias("i", "w")).groupBy("i").agg(F.avg("w").alias("m"))
        m = {r.i: r.m for r in means.collect()}  # at most TOP rows
        centre = F.array(*[F.lit(m[i]) for i in range(len(e))])
        got = gramian(w.select(F.zip_with("w", centre, lambda a, b: a - b).alias("c")), "c") / fit.n
        keep = np.flatnonzero(full)
        error = float(np.abs(got[np.ix_(keep, keep)] - np.eye(len(keep))).max())
    shares = F.array(*[F.lit(float(k / trace) if trace > 0 else 0.0) for k in e])
    ranked = F.array(*[F.lit(bool(k)) for k in full])
    out = w.select("vec_id", "deviation", F.posexplode("w").alias("i", "w"))
    at = lambda a: F.element_at(a, C("i") + 1)
    return out.select("vec_id", (C("i") + 1).alias("component"), F.lit(fit.n).cast("long").alias("n"), "deviation", F.when(at(ranked), C("w")).alias("whitened"), at(shares).alias("explained"), F.lit(error).cast("double").alias("identity_error"))
