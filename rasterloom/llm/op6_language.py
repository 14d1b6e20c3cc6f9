"""Language identification by nearest centroids of TF-IDF n-gram vectors.

Texts become hashed byte n-gram counts (2 to 4 bytes, letters and single spaces only), weighted 1 + log(tf) times idf and
normalised. Document frequencies are counted over all training rows. Each language gets up to ``CENTROIDS`` centroids by
spherical k-means over a sample of at most ``SAMPLE`` of its training rows, the classifier's documented bound. A text gets
the language of its nearest centroid by cosine. It is *rejected* if its cosine falls below the language's bound for texts
of as many distinct n-grams. Bounds are the ``REJECT`` quantiles of the cosines of the sample's rows and of their beginnings
of several lengths, each against centroids of the other folds, so neither an outlier nor a row's own centroid sets them.

Edge cases: a text that is null or has no letter is ``und`` with score 0 and rejected; without any training row
everything is ``und``; one training row makes one centroid and rejects nothing that has a letter, as do sizes of which the
sample has fewer than ``ENOUGH`` rows and none below; ties go to the language first in alphabetical order; very long texts
are counted whole; repeated rows count each; an empty table gives an empty result; other columns take no part. The model
holds four centroids of 32 kB a language in every task, so some 2,000 languages at most; more raise an error.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks_of, cut

DIMS = 1 << 13
SIZES = (2, 3, 4)
CENTROIDS, SAMPLE, ROUNDS = 4, 1000, 8
#: Quantile that bounds are, folds and lengths of beginnings that they are learned from, rows that a quantile needs.
REJECT, CROSS, BEGINNINGS, ENOUGH = 0.003, 4, (8, 16, 32, 64, 128, 256, 512, 1024), 8
#: Classes of texts by the binary logarithm of their distinct n-grams.
CLASSES = DIMS.bit_length()
FOLDS, HELD = 4, 2
MODEL_BYTES = 256 << 20
CHUNK_BYTES = 1 << 20

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"

#: Letters alone: neither digits of any script nor numbers such as fractions and circled digits.
_LETTER = regex.compile(r"\p{L}")
_CLEAN = np.full(256, 0x20, np.uint8)
_CLEAN[0x61:0x7B] = np.arange(0x61, 0x7B)
_CLEAN[0x41:0x5B] = np.arange(0x61, 0x7B)
_CLEAN[0x80:] = np.arange(0x80, 0x100)
#: Odd multipliers of the hashes, one for each n-gram size.
_MUL = {2: 0x9E3779B1, 3: 0x85EBCA77, 4: 0xC2B2AE3D}


def counts(texts: list[str]) -> np.ndarray:
    """Hashed n-gram counts of each text, as float32 rows."""
    out = np.zeros((len(texts), DIMS), np.float32)
    for row, text in enumerate(texts):
        data = _CLEAN[np.frombuffer((" " + text.lower() + " ").encode("utf-8", "replace"), np.uint8)]
        space = data == 0x20
        data = data[~(space & np.concatenate([[False], space[:-1]]))].astype(np.uint32)
        for n in SIZES:
            if len(data) >= n:
                code = data[: len(data) - n + 1].copy()
                for j in range(1, n):
                    code |= data[j : len(data) - n + 1 + j] << np.uint32(8 * j)
                out[row] += np.bincount((code * np.uint32(_MUL[n])) >> np.uint32(32 - 13), minlength=DIMS)
    return out


def weighted(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    np.log1p(tf, out=tf)
    tf *= idf
    norm = np.linalg.norm(tf, axis=1, keepdims=True)
    return np.divide(tf, norm, out=tf, where=norm > 0)


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def texts_of(batch: pa.RecordBatch, column: str | int) -> Iterator[tuple[int, list[str | None]]]:
    texts = batch.column(column).to_pylist()
    for i, j in chunks_of((len(t or "") for t in texts), CHUNK_BYTES) if texts else ():
        for k in range(i, j, 256):
            yield k, texts[k : min(j, k + 256)]


def document_frequencies(train: DataFrame) -> tuple[np.ndarray, int]:
    """Training rows in which each dimension occurs, and their number; vectors are summed up in Spark."""
    parts = 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = np.zeros(DIMS, np.int64), 0
        for batch in batches:
            for _, texts in texts_of(batch, "text"):
                seen += (counts([t for t in texts if t]) > 0).sum(axis=0)
                rows += len(texts)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array([p.tobytes() for p in seen.reshape(parts, -1)], pa.binary()), pa.array([rows] * parts, pa.int64())], ["part", "seen", "n"])

    def add(key: tuple, t: pa.Table) -> pa.Table:
        seen = np.sum([np.frombuffer(b, np.int64) for b in t.column("seen").to_pylist()], axis=0)
        return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([seen.tobytes()], pa.binary()), pa.array([sum(t.column("n").to_pylist())], pa.int64())], ["part", "seen", "n"])

    schema = "part int, seen binary, n long"
    rows = sorted(train.select("text").mapInArrow(run, schema).groupBy("part").applyInArrow(add, schema).collect())  # 16 rows
    if not rows:
        return np.zeros(DIMS, np.int64), 0
    return np.concatenate([np.frombuffer(r.seen, np.int64) for r in rows]), rows[0].n


def cluster(vectors: np.ndarray) -> np.ndarray:
    """Spherical k-means. Starts far apart; empty clusters go."""
    centre = [vectors[0]]
    while len(centre) < min(CENTROIDS, len(vectors)):
        near = (vectors @ np.array(centre).T).max(axis=1)
        if near.min() > 0.999:
            break
        centre.append(vectors[int(np.argmin(near))])
    centre = np.array(centre)
    for _ in range(ROUNDS):
        own = np.argmax(vectors @ centre.T, axis=1)
        centre = np.array([vectors[own == k].sum(axis=0) for k in range(len(centre)) if (own == k).any()])
        centre /= np.linalg.norm(centre, axis=1, keepdims=True)
    return centre


def size_class(tf: np.ndarray) -> np.ndarray:
    return np.log2(np.maximum(np.count_nonzero(tf, axis=1), 1)).astype(np.int64)


def bounds(texts: list[str], vectors: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rejection bound of each size class from cosines out of fold."""
    fold = np.arange(len(texts)) % CROSS
    others = [cluster(vectors[fold != k]) if (fold == k).any() and (fold != k).any() else None for k in range(CROSS)]
    found: list[list[float]] = [[] for _ in range(CLASSES)]
    for length in (*BEGINNINGS, None):
        for k, centre in enumerate(others):
            if centre is not None:
                cuts = [t[:length] for t, f in zip(texts, fold) if f == k and (length is None or len(t) > length) and has_letter(t[:length])]
                if cuts:
                    tf = counts(cuts)
                    kind = size_class(tf)
                    for c, v in zip(kind.tolist(), (weighted(tf, idf) @ centre.T).max(axis=1).tolist()):
                        found[c].append(v)
    out = np.zeros(CLASSES)
    for c, values in enumerate(found):
        out[c] = np.quantile(values, REJECT) if len(values) >= ENOUGH else out[c - 1] if c else 0.0
    return out


class Model:
    """Languages, centroids, idf weights and rejection bounds (language x size class)."""

    def __init__(self, languages: list[str], centroids: np.ndarray, owner: np.ndarray, bound: np.ndarray, idf: np.ndarray):
        self.languages, self.centroids, self.owner, self.bound, self.idf = languages, centroids, owner, bound, idf

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, cosines in 0 to 1, and rejections."""
        real = [has_letter(t) for t in texts]
        names, score, rejected = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        at = np.flatnonzero(real)
        if len(at) and self.languages:
            tf = counts([texts[i] for i in at])
            kind = size_class(tf)
            cosine = weighted(tf, self.idf) @ self.centroids.T
            best = np.argmax(cosine, axis=1)
            own = self.owner[best]
            score[at] = np.clip(cosine[np.arange(len(at)), best], 0, 1)
            rejected[at] = score[at] < self.bound[own, kind]
            for i, k in zip(at.tolist(), own.tolist()):
                names[i] = self.languages[k]
        return names, score, rejected


def fit(rows: DataFrame) -> Model:
    """``rows``: doc_id, text, lang. Only rows outside the held-out fold with a language are learned from."""
    train = rows.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    seen, n = document_frequencies(train)
    idf = (np.log((1 + n) / (1 + seen)) + 0.1).astype(np.float32)
    size = cut(train.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    if (k := size.count()) * DIMS * 4 > MODEL_BYTES:
        raise ValueError(f"{k} languages are more than a task can hold")
    # a row that is repeated has one hash, so its copies would enter together: each text of an id enters once
    rows_hash = F.xxhash64("doc_id", "text")
    share = F.pmod(rows_hash, F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = train.join(F.broadcast(size), "lang").where((F.col("n") <= SAMPLE) | (share < F.lit(0.9 * SAMPLE) / F.col("n"))).select("lang", "doc_id", "text", rows_hash.alias("h"))
    sample = sample.dropDuplicates(["lang", "h"]).drop("h")

    def learn(key: tuple, t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("doc_id").to_numpy(), kind="stable")
        texts = [t.column("text")[int(i)].as_py() for i in order]
        texts = [x for x in texts if has_letter(x)]
        vectors = weighted(counts(texts), idf)
        if not len(vectors):
            return pa.table({"lang": pa.array([], pa.string()), "centroid": pa.array([], pa.binary()), "bound": pa.array([], pa.binary())})
        centre = cluster(vectors)
        bound = bounds(texts, vectors, idf).tobytes()
        return pa.table({"lang": pa.array([key[0].as_py()] * len(centre)), "centroid": pa.array([c.astype(np.float32).tobytes() for c in centre], pa.binary()), "bound": pa.array([bound] * len(centre), pa.binary())})

    made = cut(sample.groupBy("lang").applyInArrow(learn, "lang string, centroid binary, bound binary"), "centroids")
    if (k := made.count()) * DIMS * 4 > MODEL_BYTES:
        raise ValueError(f"{k} centroids are more than a task can hold")
    found = sorted(made.collect(), key=lambda r: (r.lang, bytes(r.centroid)))
    languages = sorted({r.lang for r in found})
    number = {x: i for i, x in enumerate(languages)}
    bound = {r.lang: np.frombuffer(r.bound, np.float64) for r in found}
    centroids = np.array([np.frombuffer(r.centroid, np.float32) for r in found]).reshape(-1, DIMS)
    return Model(languages, centroids, np.array([number[r.lang] for r in found], np.int64), np.array([bound[x] for x in languages]).reshape(-1, CLASSES), idf)


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD, F.lit(False))


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per document: held-out or not, language, cosine, rejected or not."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), docs[lang_col].alias("lang"))
    model = docs.sparkSession.sparkContext.broadcast(fit(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for i, texts in texts_of(batch, "text"):
                names, score, rejected = model.value.predict(texts)
                own = ids.slice(i, len(texts))
                yield pa.RecordBatch.from_arrays([own, pa.array([is_held_out(x) for x in own.to_pylist()]), pa.array(names), pa.array(score), pa.array(rejected)], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return rows.select("doc_id", "text").mapInArrow(run, SCHEMA)


def keep_identified(docs: DataFrame) -> DataFrame:
    """``docs`` without rejected rows; all columns of ``docs`` are kept, whatever their names.

    Each row is judged by its own text, so null and repeated ids matter nothing and repeated rows go or stay together.
    Null and empty texts and texts without letters go. An empty table stays empty.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"), docs["lang"].alias("lang"))
    model, at = docs.sparkSession.sparkContext.broadcast(fit(rows)), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, texts in texts_of(batch, at):
                yield batch.slice(i, len(texts)).filter(pa.array(~model.value.predict(texts)[2]))

    return docs.mapInArrow(run, docs.schema)
