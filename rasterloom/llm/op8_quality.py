"""Quality classifier from a weak-label model.

Overlapping heuristic labellers vote good (1), bad (0) or abstain on whole texts. Expectation-maximisation over the counts
of vote patterns, of which there are at most 3 to the number of labellers whatever the corpus, estimates how each
labeller votes given the true class. Its posteriors are soft labels for a hashed linear scorer over words, word stems and
punctuation shapes, which then scores every document. A second head scores toxicity. It learns from ``labels`` alone, in
whatever languages they cover, over the features that go with toxic labels beyond chance (all features, if none does).

Fitting takes at most ``SAMPLE`` documents for each head, the classifier's documented bound; pattern counts cover all. Rows
enter by a hash of id and text, and rows that are equal in both enter once, so that no id, missing or repeated, brings more.

Edge cases: rows without an id, repeated rows and ties are scored each for itself; texts are read whole, however long; other
columns are not read, whatever they are called; null and empty texts have only votes of length and get the scorer's bias; with a single pattern the posterior
is the prior; an empty table gives an empty result; without labels of both classes the second head has no teacher, and its score and
verdict are null.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMS = 1 << 16
SAMPLE, EPOCHS, RATE, DECAY = 6000, 60, 0.5, 1e-5
EM_ROUNDS, PRIOR = 60, 0.8
CACHE_WORDS = 200_000

SCHEMA = "doc_id long, votes string, posterior double, score double, keep boolean, toxic_score double, toxic boolean"

#: Standard deviations by which a feature occurs more often than by chance in toxic rows, and rows it needs.
TELLING, TELLING_ROWS = 4.5, 3

_SENTENCE = re.compile(r"[.!?](?:\s|$)")
_SYMBOL = re.compile(r"[#%*$&|<>{}\[\]\\^~=+_]")
_WORD = re.compile(r"\w+")


def votes(text: str | None) -> str:
    """One character per labeller: 1 good, 0 bad, - abstains."""
    text = text or ""
    words = text.split()
    n, size = len(words), max(len(text), 1)
    counts = Counter(words)
    symbols = len(_SYMBOL.findall(text)) / size
    distinct = len(counts) / max(n, 1)
    run = most = 1
    for a, b in zip(words, words[1:]):
        run = run + 1 if a == b else 1
        most = max(most, run)
    lines = [line for line in text.split("\n") if line.strip()]
    repeated = 1 - len(set(lines)) / max(len(lines), 1)
    ends = len(_SENTENCE.findall(text))
    letters = sum(map(len, words)) / max(n, 1)
    top = max(counts.values(), default=0) / max(n, 1)
    out = (
        bad_good(symbols > 0.02, symbols < 0.005),
        bad_good(n >= 8 and text.count(" | ") > 0.15 * n, n >= 8 and " | " not in text and symbols < 0.02),
        bad_good(n >= 20 and distinct < 0.35, n >= 20 and distinct > 0.6),
        bad_good(most >= 5, n >= 20 and most <= 2),
        bad_good(n >= 30 and (ends == 0 or n / ends > 60), n >= 10 and ends > 0 and 3 <= n / ends <= 40),
        bad_good(n > 0 and not 2 <= letters <= 14, 3 <= letters <= 9),
        bad_good(len(lines) >= 4 and repeated > 0.3, len(lines) >= 2 and repeated < 0.1),
        bad_good(n < 5, n >= 50),
        bad_good(n >= 20 and top > 0.25, n >= 20 and top < 0.12),
    )
    return "".join(out)


def bad_good(bad: bool, good: bool) -> str:
    return "0" if bad else "1" if good else "-"


def em(patterns: dict[str, int], prior: float = PRIOR) -> tuple[dict[str, float], np.ndarray]:
    """Posterior of good for each pattern, and each labeller's vote probabilities given (bad, good)."""
    names = sorted(patterns)
    if not names:
        return {}, np.empty((0, 2, 3))
    weight = np.array([patterns[p] for p in names], float)
    vote = np.array([["01-".index(c) for c in p] for p in names])  # pattern x labeller
    one = np.eye(3)[vote]
    good, bad = (vote == 1).sum(axis=1), (vote == 0).sum(axis=1)
    post = (good + 2 * prior) / (good + 2 * bad + 2)  # begins with a count of votes in which bad ones weigh double
    table = np.empty((vote.shape[1], 2, 3))
    for _ in range(EM_ROUNDS):
        for k, share in enumerate((1 - post, post)):
            mass = np.einsum("p,plv->lv", weight * share, one) + 1.0
            table[:, k] = mass / mass.sum(axis=1, keepdims=True)
        prior = (weight @ post + 1) / (weight.sum() + 2)
        log = np.log(table)
        like = [log[np.arange(vote.shape[1]), k][np.arange(vote.shape[1])[None, :], vote].sum(axis=1) for k in (0, 1)]
        new = 1 / (1 + np.exp(np.clip(like[0] - like[1] + np.log(1 - prior) - np.log(prior), -700, 700)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return dict(zip(names, post.tolist())), table


class Features:
    """Hashed features of a text: its distinct words, their stems of four letters, and the punctuation after them."""

    def __init__(self):
        self.memory: dict[str, tuple[int, ...]] = {}

    def word(self, token: str) -> tuple[int, ...]:
        low = token.lower()
        core = "".join(_WORD.findall(low))
        shape = re.sub(r"\w+", "w", low)
        made = tuple(zlib.crc32(x.encode()) % DIMS for x in ("w" + core, "s" + core[:4], "s" + core[:5], "p" + shape) if len(x) > 1)
        if len(self.memory) >= CACHE_WORDS:
            self.memory.clear()
        self.memory[token] = made
        return made

    def of(self, text: str | None) -> np.ndarray:
        get = self.memory.get
        found: set[int] = set()
        for token in set((text or "").split()):
            found.update(get(token) or self.word(token))
        return np.fromiter(found, np.int64, len(found))


class Scorer:
    """Linear in hashed features; ``mean``: features of a text share one unit of weight."""

    def __init__(self, weights: np.ndarray, bias: float, mean: bool):
        self.weights, self.bias, self.mean = weights, bias, mean

    def score(self, ids: np.ndarray) -> float:
        s = float(self.weights[ids].sum())
        z = self.bias + (s / max(len(ids), 1) ** 0.5 if self.mean else s)
        return 1 / (1 + float(np.exp(-np.clip(z, -30, 30))))


def train(rows: list[np.ndarray], target: np.ndarray, mean: bool) -> Scorer:
    """Logistic regression on soft targets by full-batch AdaGrad; classes weigh the same."""
    weights, bias = np.zeros(DIMS), 0.0
    if not rows:
        return Scorer(weights, bias, mean)
    flat = np.concatenate(rows) if rows else np.empty(0, np.int64)
    size = np.array([len(r) for r in rows])
    row = np.repeat(np.arange(len(rows)), size)
    unit = 1 / np.sqrt(np.maximum(size, 1)) if mean else np.ones(len(rows))
    up, down = max(target.sum(), 1e-6), max((1 - target).sum(), 1e-6)
    importance = target * (len(rows) / (2 * up)) + (1 - target) * (len(rows) / (2 * down))
    past, past_bias = np.full(DIMS, 1e-8), 1e-8
    for _ in range(EPOCHS):
        z = bias + np.bincount(row, weights[flat], len(rows)) * unit
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) * np.clip(importance, 0, 20) / len(rows)
        step = np.bincount(flat, (error * unit)[row], DIMS) + DECAY * weights
        past += step * step
        weights -= RATE * step / np.sqrt(past)
        past_bias += error.sum() ** 2
        bias -= RATE * error.sum() / past_bias**0.5
    return Scorer(weights, float(bias), mean)


def telling(rows: list[np.ndarray], target: np.ndarray) -> np.ndarray:
    """A flag for each feature: in rows of target 1 more often than independence allows. All, if there is none."""
    seen = np.bincount(np.concatenate(rows), minlength=DIMS)
    both = np.bincount(np.concatenate(rows), np.repeat(target, [len(r) for r in rows]), DIMS)
    share = target.mean()
    spread = np.sqrt(np.maximum(seen * share * (1 - share) * (1 - seen / len(rows)), 1e-9))
    out = (both - seen * share - 0.5 >= TELLING * spread) & (seen >= TELLING_ROWS)
    return out if out.any() else np.ones(DIMS, bool)


def toxicity(rows: list[np.ndarray], target: np.ndarray) -> Scorer | None:
    """The second head; none without labelled rows of both classes."""
    if len(set(target.tolist())) < 2:
        return None
    flags = telling(rows, target)
    return train([r[flags[r]] for r in rows], target, False)


def classify(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: votes, posterior, score and verdict of quality, score and verdict of toxicity."""
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            counts.update(votes(t.as_py()) for t in batch.column(0))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["votes", "n"])

    # At most 3**9 patterns come back.
    patterns = {r.votes: r.n for r in rows.select("text").mapInArrow(vote, "votes string, n long").groupBy("votes").agg(F.sum("n").alias("n")).collect()}
    total = sum(patterns.values())
    posterior, _ = em(patterns)

    quality = fetched(bounded(rows.withColumn("toxic", F.lit(None).cast("double")), total))
    good = train([r.ids for r in quality], np.array([posterior.get(r.votes, PRIOR) for r in quality]), True)

    if labels is not None:
        known = labels.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("toxic").alias("_toxic")).where("_toxic IS NOT NULL")
        size = known.count()
        part = F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
        picked = known.where(part < min(1.0, 0.9 * SAMPLE / max(size, 1)))
        joined = rows.join(picked, rows["doc_id"] == picked["_id"]).select("doc_id", "text", (F.col("_toxic") > 0).cast("double").alias("toxic"))
        taught = fetched(bounded(joined, 0))
    else:
        taught = []
    bad = toxicity([r.ids for r in taught], np.array([r.toxic for r in taught]))
    held = spark.sparkContext.broadcast((posterior, good, bad))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        posterior_, good_, bad_ = held.value
        own = Features()
        for batch in batches:
            made = []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = t.as_py()
                v, ids = votes(text), own.of(text)
                p, s, x = posterior_.get(v, PRIOR), good_.score(ids), bad_.score(ids) if bad_ else None
                made.append((i, v, p, s, (p + s) / 2 >= 0.5, x, None if x is None else x >= 0.5))
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.bool_(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made) if made else [()] * 7, kinds)], ["doc_id", "votes", "posterior", "score", "keep", "toxic_score", "toxic"])

    return rows.mapInArrow(run, SCHEMA)


def bounded(rows: DataFrame, total: int) -> DataFrame:
    """At most SAMPLE of ``rows`` (doc_id, text, toxic), of which there are ``total``, by the order of a hash of id and text."""
    some = rows.withColumn("h", F.xxhash64("doc_id", "text"))
    share = F.pmod(F.col("h"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    some = some.where(share < min(1.0, 0.9 * SAMPLE / max(total, 1)))
    return some.dropDuplicates(["h"]).orderBy("h").limit(SAMPLE).drop("h")


class Example:
    """What the fit needs of a sampled document."""

    def __init__(self, row):
        self.ids, self.votes, self.toxic = np.array(row.ids, np.int64), row.votes, row.toxic


def fetched(rows: DataFrame) -> list[Example]:
    """The sample (doc_id, text, toxic) in the order of ids. Features are made in Spark, so no text comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([features.of(t).astype(np.int32) for t in texts], pa.list_(pa.int32())), pa.array([votes(t) for t in texts], pa.string()), batch.column("toxic")], ["doc_id", "ids", "votes", "toxic"])

    made = rows.select("doc_id", "text", "toxic").mapInArrow(run, "doc_id long, ids array<int>, votes string, toxic double")
    return [Example(r) for r in sorted(made.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.ids))]
