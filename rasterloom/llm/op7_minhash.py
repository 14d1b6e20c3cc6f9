"""MinHash near-duplicate grouping with sequential Bayesian verification.

Texts with equal shingle sets form a class from the start, so copies never meet again. Classes are banded by MinHash
signatures. Links are looked for in rounds that together lose none:

* *Star*: each class is compared with one hub of its band buckets, the smallest id of the bucket it shares most bands
  with; then members outside a bucket's largest component are compared with that component's last member. That joins
  almost all of a large group without pairs within it.
* *Cells*: a bucket whose members are still in several components is cut into blocks, and every pair of blocks is one
  cell; members of different components are compared until they are linked or no pair is left. Buckets of equal members
  are compared once.

A comparison looks at signatures batch by batch. With a uniform prior and m of n hashes equal, the chance that the
similarity reaches the threshold t is P(Binomial(n + 1, t) <= m); below ``MISS`` the pair is dropped. Survivors are
verified on their whole shingle sets, and only that decides. ``BANDS`` of ``ROWS`` hashes miss a pair of similarity 0.8
with probability (1 - 0.8**4)**32, some 5e-8.

Edge cases: null, empty and blank texts have an empty set, are linked with nothing and are their own component; texts of
fewer words than a shingle have one shingle of all their words; very long texts and words are hashed whole; rows of equal
text fall into one component; rows of equal id keep one row each and may be of several components; a row without an id
counts as the smallest; an empty table gives an empty result; other columns of the input take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, as_bytes, chunks_of, concat_texts, cut, free_names, id_of, ids_back, mix64

WIDTH, SHARE = 5, 80
BANDS, ROWS, BATCH = 32, 4, 16
MISS = 1e-9
#: Classes in a block of a cell; bytes of text handled together.
BLOCK, CHUNK_BYTES = 1024, 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_SEED = np.random.default_rng(7).integers(0, 2**63, (2, BANDS * ROWS), dtype=np.uint64)
_MUL, _ADD = _SEED[0] * np.uint64(2) + np.uint64(1), _SEED[1]


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle codes of each text."""
    data, offsets = concat_texts([t + b" " for t in texts])
    data = _LOWER[data]
    flags = np.zeros(len(data) + 1, np.int8)
    flags[:-1] = ~_SPACE[data]
    edges = np.diff(flags, prepend=np.int8(0))
    start, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    words = Rolling(Rolling(data).slices(start, end))
    first = np.searchsorted(start, offsets)
    out = []
    for a, b in zip(first.tolist(), first[1:].tolist()):
        if b - a >= width:
            at = np.arange(a, b - width + 1)
            out.append(np.unique(words.slices(at, at + width)))
        elif b > a:
            out.append(words.slices(np.array([a]), np.array([b])))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def signature(codes: np.ndarray) -> np.ndarray:
    """BANDS * ROWS minimum hashes, 32 bits each."""
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for i in range(0, len(codes), 512):
        np.minimum(least, (codes[i : i + 512, None] * _MUL + _ADD).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def set_digest(codes: np.ndarray) -> bytes:
    return hashlib.blake2b(codes.tobytes(), digest_size=16).digest()


@lru_cache(maxsize=8)
def least_matches(share: int, miss: float = MISS) -> tuple[tuple[int, int], ...]:
    """(n, fewest equal hashes of n with which a pair goes on)."""
    t, out = share / 100, []
    for n in range(BATCH, BANDS * ROWS + 1, BATCH):
        below, m = 0.0, 0
        while True:
            below += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if below >= miss:
                break
            m += 1
        out.append((n, m))
    return tuple(out)


def survivors(a: np.ndarray, b: np.ndarray, share: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of two equally long signature tables that are not dropped, and how many hashes they have in common."""
    rows, equal, at = np.arange(len(a)), np.zeros(len(a), np.int32), 0
    for n, least in least_matches(share):
        equal = equal + (a[rows, at:n] == b[rows, at:n]).sum(axis=1)
        keep = equal >= least
        rows, equal, at = rows[keep], equal[keep], n
    return rows, equal


def similar(a: np.ndarray, b: np.ndarray, share: int) -> bool:
    """Exact: 100 * intersection >= share * union of two sorted sets."""
    small, large = min(len(a), len(b)), max(len(a), len(b))
    if 100 * small < share * large or not small:
        return False
    both = np.count_nonzero(np.isin(a, b, assume_unique=True)) if small < 16 else len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= share * (len(a) + len(b) - both)


def features(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, text_key, n_shingles, digest, sig), already written. ``docs``: doc_id, text_key, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(2))
            for i, j in chunks_of(map(len, texts), CHUNK_BYTES) if texts else ():
                sets = shingle_sets(texts[i:j], width)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_digest(s) if len(s) else None for s in sets], pa.binary()), pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary())], ["doc_id", "text_key", "n_shingles", "digest", "sig"])

    return cut(docs.mapInArrow(run, "doc_id long, text_key long, n_shingles long, digest binary, sig binary"), "signatures")


def numbered(feats: DataFrame) -> DataFrame:
    """(digest, id, doc_id, text_key, sig): the classes, each with a number of its own and its first row, already written.

    A class's number is a hash of its set's digest, so rows of one id may be of several classes. Numbers are checked to
    be distinct, and drawn anew until they are.
    """
    first = feats.where("digest IS NOT NULL").groupBy("digest").agg(F.min_by(F.struct("doc_id", "text_key", "sig"), F.struct("doc_id", "text_key")).alias("f"))
    salt = 0
    while True:
        classes = cut(first.select("digest", F.xxhash64("digest", F.lit(salt)).alias("id"), "f.doc_id", "f.text_key", "f.sig"), "classes")
        if classes.groupBy("id").count().where("count > 1").isEmpty():
            return classes
        salt += 1


def band_keys(classes: DataFrame) -> DataFrame:
    """(key, id): one row for each band of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n:
                sigs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(n, BANDS, ROWS).astype(np.uint64)
                key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (n, BANDS)).copy()
                for r in range(ROWS):
                    key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + sigs[:, :, r])
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], ["key", "id"])

    return classes.select("id", "sig").mapInArrow(run, "key long, id long")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every end of an edge; the component is its smallest id. Large-star and small-star by turns.

    ``edges`` has columns a, b. Every turn is written to the shared folder; it ends when a turn changes nothing.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "edges")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a > b").distinct()
        now = cut(small, "edges")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    stars = now.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("id"), "component")
    return stars.unionByName(stars.select(F.col("component").alias("id"), "component").distinct())


def cell_links(rows: pa.Table, share: int) -> list[tuple[int, int]]:
    """Edges that join components of a cell's members; pairs of one component, by then, are passed over."""
    ids, comp, block = (rows.column(c).to_numpy() for c in ("id", "comp", "block"))
    sigs = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint32).reshape(len(ids), -1)
    sets = [np.frombuffer(s, np.uint64) for s in rows.column("codes").to_pylist()]
    names, own = np.unique(comp, return_inverse=True)
    one_block, out = len(np.unique(block)) == 1, []
    for i in range(len(ids)):
        if one_block:
            others = np.arange(i)
        elif block[i] == block.max():
            others = np.flatnonzero(block != block[i])
        else:
            continue
        others = others[own[others] != own[i]]
        if not len(others):
            continue
        rows_, equal = survivors(np.broadcast_to(sigs[i], (len(others), sigs.shape[1])), sigs[others], share)
        for j in others[rows_[np.argsort(-equal, kind="stable")]].tolist():
            if own[j] != own[i] and similar(sets[i], sets[j], share):
                out.append((int(ids[i]), int(ids[j])))
                own[own == own[j]] = own[i]
    return out


def near_duplicates(docs: DataFrame, width: int = WIDTH, share: int = SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: size of its shingle set, smallest id of its component, and whether it is that one."""
    feats, classes = grouped(keyed(docs, id_col, text_col), width, share)
    known = feats.select("doc_id", "n_shingles", "digest").join(classes.select("digest", F.col("first.doc_id").alias("least")), "digest", "left")
    component = F.coalesce("least", "doc_id")
    return ids_back(known.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept")), "doc_id", "component_id")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, text); id and key tell rows apart, but for repeated ones."""
    return docs.select(id_of(docs, id_col), F.xxhash64(docs[text_col]).alias("text_key"), docs[text_col].alias("text"))


def grouped(rows: DataFrame, width: int, share: int) -> tuple[DataFrame, DataFrame]:
    """Features of the rows, and (digest, first) of the classes: the smallest (doc_id, text_key) of the class's component."""
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    feats = features(rows, width)
    classes = numbered(feats)

    bands = band_keys(classes)
    shared = bands.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("n")).where("n > 1")
    members = cut(bands.join(shared, "key"), "members")

    # first star: one hub for each class
    ties = members.where("id != hub").groupBy("id", "hub").agg(F.count("*").alias("k"))
    star = ties.groupBy("id").agg(F.max_by("hub", F.struct("k", -F.col("hub"))).alias("hub"))
    some = members.select("id").distinct().join(classes, "id")
    sets = cut(code_sets(rows, some, width), "sets")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for c in ("sig_a", "sig_b"))
            x, y = batch.column("codes_a"), batch.column("codes_b")
            keep = [k for k in survivors(a, b, share)[0].tolist() if similar(np.frombuffer(x[k].as_py(), np.uint64), np.frombuffer(y[k].as_py(), np.uint64), share)]
            yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(keep, pa.int64())), batch.column("b").take(pa.array(keep, pa.int64()))], ["a", "b"])

    left = sets.select(F.col("id").alias("a"), F.col("sig").alias("sig_a"), F.col("codes").alias("codes_a"))
    right = sets.select(F.col("id").alias("b"), F.col("sig").alias("sig_b"), F.col("codes").alias("codes_b"))

    def linked(pairs: DataFrame) -> DataFrame:
        return cut(pairs.select(F.col("id").alias("a"), F.col("hub").alias("b")).join(left, "a").join(right, "b").mapInArrow(verify, "a long, b long"), "links")

    def apart(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Members with their components, of the buckets that still hold several; and one bucket of those with equal members."""
        placed = members.select("key", "id").join(components(edges), "id", "left").select("key", "id", F.coalesce("component", "id").alias("comp"))
        state = placed.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("who"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
        return cut(placed.join(state.select("key"), "key", "left_semi"), "apart"), state.groupBy("n", "who").agg(F.min("key").alias("key"))

    edges = linked(star)
    # second star: members outside a bucket's largest component against its last member
    placed, _ = apart(edges)
    sizes = placed.groupBy("key", "comp").agg(F.count("*").alias("n"), F.max("id").alias("hub"))
    largest = sizes.groupBy("key").agg(F.max_by(F.struct("comp", "hub"), F.struct("n", -F.col("comp"))).alias("big")).select("key", F.col("big.comp").alias("big"), F.col("big.hub").alias("hub"))
    ties = placed.join(largest, "key").where("comp != big").groupBy("id", "hub").agg(F.count("*").alias("k"))
    edges = cut(edges.unionByName(linked(ties.groupBy("id").agg(F.max_by("hub", F.struct("k", "hub")).alias("hub")))), "links")

    # cells: buckets whose members are still apart
    placed, once = apart(edges)
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    blocked = placed.join(once, "key").withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int"))
    blocked = blocked.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    cells = blocked.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "comp").join(sets, "id")
    found = cells.repartition(n, "key", "i", "j").groupBy("key", "i", "j").applyInArrow(lambda t: pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())}) if len(t) < 2 else edge_table(cell_links(t, share)), "a long, b long")
    more = cut(found, "links")
    part = cut(components(edges.unionByName(more)), "components")

    placed = classes.join(part, "id", "left").select("digest", "doc_id", "text_key", F.coalesce("component", "id").alias("component"))
    firsts = placed.groupBy("component").agg(F.min(F.struct("doc_id", "text_key")).alias("first"))
    return feats, placed.select("digest", "component").join(firsts, "component").select("digest", "first")


def edge_table(edges: list[tuple[int, int]]) -> pa.Table:
    a, b = zip(*edges) if edges else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def code_sets(rows: DataFrame, some: DataFrame, width: int) -> DataFrame:
    """(id, sig, codes) of the classes in ``some``, whose texts alone are read again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, digests = as_bytes(batch.column("text")), batch.column("digest").to_pylist()
            for i, j in chunks_of(map(len, texts), CHUNK_BYTES) if texts else ():
                made = shingle_sets(texts[i:j], width)
                keep = [k for k, s in enumerate(made) if set_digest(s) == digests[i + k]]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, j - i).take(pa.array(keep, pa.int64())), batch.column("sig").slice(i, j - i).take(pa.array(keep, pa.int64())), pa.array([made[k].tobytes() for k in keep], pa.binary())], ["id", "sig", "codes"])

    joined = rows.join(some.select("id", "digest", "sig", "doc_id", "text_key"), ["doc_id", "text_key"]).select("id", "digest", "sig", "text")
    return joined.mapInArrow(run, "id long, sig binary, codes binary").dropDuplicates(["id"])


def keep_one(docs: DataFrame, width: int = WIDTH, share: int = SHARE) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id; all columns of ``docs`` are kept.

    Of rows of that id, that of the smallest text key stays; of repeated rows one does. Rows without a word all stay, as
    they are like no other. Null ids count as the smallest. An empty table stays empty. Columns may have any names.
    """
    feats, classes = grouped(keyed(docs), width, share)
    firsts = classes.select("digest", "first.*").join(feats.select("digest", "doc_id", "text_key"), ["digest", "doc_id", "text_key"])
    firsts = firsts.groupBy("doc_id", "text_key").agg((F.count("*") > 1).alias("repeated"))
    blank = feats.where("digest IS NULL").select("doc_id", "text_key", F.lit(False).alias("repeated")).distinct()
    i, k, r = free_names(docs, "_i", "_k", "_r")
    stay = cut(firsts.unionByName(blank), "stay").toDF(i, k, r)
    own = docs.withColumns({i: id_of(docs, "doc_id", i), k: F.xxhash64(docs["text"])})
    once = own.join(stay.where(~F.col(r)).drop(r), [i, k], "left_semi")
    twice = own.join(stay.where(F.col(r)).drop(r), [i, k], "left_semi").dropDuplicates([i, k])
    return once.unionByName(twice).select(*docs.columns)
