"""Shared pieces of the training-data operators: the shared folder, lineage cuts and byte-level text arithmetic."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

__all__ = [
    "NO_ID", "id_of", "ids_back", "free_names", "recorded", "removed", "shared_dir", "fresh_path", "cut", "table", "fs_of", "Rolling", "mix64", "concat_texts", "sha256_hex", "chunks_of", "as_bytes",
]


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``; a temporary one only for local masters that set none."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


_recorders: ContextVar[tuple[list[str], ...]] = ContextVar("recorders", default=())


@contextmanager
def recorded(paths: list[str]) -> Iterator[None]:
    """Adds to ``paths`` what is put into the shared folder meanwhile, for ``removed`` once nothing reads it any more."""
    mark = _recorders.set((*_recorders.get(), paths))
    try:
        yield
    finally:
        _recorders.reset(mark)


def removed(spark: SparkSession, paths: list[str]) -> None:
    """Deletes the folders, in whatever store they are, and empties the list."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    paths.clear()


def fresh_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    for paths in _recorders.get():
        paths.append(path)
    return path


#: Stands for a missing identifier inside an operator, so that such rows take part like any other.
NO_ID = -(1 << 63)


def id_of(df: DataFrame, column: str, name: str = "doc_id"):
    """The identifier as a long; a missing one as NO_ID."""
    return F.coalesce(df[column].cast("long"), F.lit(NO_ID)).alias(name)


def ids_back(df: DataFrame, *columns: str) -> DataFrame:
    """NO_ID as null again."""
    return df.withColumns({c: F.when(F.col(c) != NO_ID, F.col(c)) for c in columns})


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted names, made longer until ``df`` has no such columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: a lineage cut that outlives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fs_of(uri: str):
    """(filesystem, path) of a URI, so that executors reach whatever store the shared folder is in."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def as_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    return [v or b"" for v in column.to_pylist()]


def chunks_of(sizes: Iterable[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges [i, j) of consecutive items whose sizes sum to about ``limit``; a larger single item stands alone."""
    start = total = at = 0
    for at, n in enumerate(sizes):
        if total and total + n > limit:
            yield start, at
            start, total = at, 0
        total += n
    if total or start <= at:
        yield start, at + 1


def concat_texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes in one array, and the offsets at which texts begin (one more than texts)."""
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.frombuffer(b"".join(texts), np.uint8), offsets


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads all bits of 64-bit values."""
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


class Rolling:
    """Position-independent 64-bit hashes of any slice of an array, from one prefix sum.

    P[i] is the sum of v[j]*B**j below i; (P[e]-P[s]) * B**-s depends on the slice alone. Such sums modulo 2**64 are known
    to collide for long slices of a regular make, whatever the base, so slices beyond ``SOUND`` are digested by BLAKE2b.
    """

    SOUND = 96

    BASE = 0x9E3779B97F4A7C15
    _up = np.ones(1, np.uint64)
    _down = np.ones(1, np.uint64)
    _codes = np.random.default_rng(20240229).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    @classmethod
    def powers(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls._up) <= n:
            size = max(n + 1, 1 << 16)
            inverse = pow(cls.BASE, -1, 1 << 64)
            up, down = np.full(size, np.uint64(cls.BASE)), np.full(size, np.uint64(inverse))
            up[0] = down[0] = 1
            cls._up, cls._down = np.cumprod(up), np.cumprod(down)
        return cls._up, cls._down

    def __init__(self, values: np.ndarray):
        """``values``: uint8 (bytes) or uint64 codes."""
        up, self.down = self.powers(len(values))
        self.values = values
        self.prefix = np.empty(len(values) + 1, np.uint64)
        self.prefix[0] = 0
        codes = self._codes[values] if values.dtype == np.uint8 else values
        np.cumsum(codes * up[: len(values)], out=self.prefix[1:])

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Mixed hashes of [start, end); the length takes part."""
        out = mix64((self.prefix[end] - self.prefix[start]) * self.down[start] + (end - start).astype(np.uint64))
        for k in np.flatnonzero(end - start > self.SOUND).tolist():
            out[k] = int.from_bytes(hashlib.blake2b(self.values[start[k] : end[k]].tobytes(), digest_size=8).digest(), "little")
        return out

    def grams(self, q: int) -> np.ndarray:
        """Mixed hashes of every slice of length ``q``."""
        n = len(self.prefix) - 1
        if n < q:
            return np.empty(0, np.uint64)
        return mix64((self.prefix[q:] - self.prefix[: n - q + 1]) * self.down[: n - q + 1])
