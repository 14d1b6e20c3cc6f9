"""Benchmark decontamination with training suffix arrays.

A shard of the corpus (a bounded run of documents) is turned into word ids and a suffix array of its words. Every suffix
of every benchmark item is binary-searched in every shard's array; an interval of the array is the set of places where
the suffix's first words occur verbatim. From each place the match is made as long as it goes, by binary search among the
sorted test suffixes; longest matches cover the hit words, and their items and hit words give the affected documents.

The array is sparse: a suffix whose leading words are not all benchmark words can match no test suffix, so only suffixes
that begin with enough of them are sorted. Benchmark items take part as a whole; they are held by each task while they
are small (``BLOCK_BYTES``, checked first) and otherwise taken in blocks of items, one pass over the corpus each, one
block in memory at a time.

Edge cases: null has no words, as has a text of other characters only: n_hit 0, not contaminated. An item without words
matches nothing; an item of fewer words than a window is one window. Rows with equal ids and texts give equal rows. Items
without an id count as one item whose name is empty. Very long texts are a shard of their own, very long words are hashed
whole; empty tables give empty results and no matches; other columns take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, Rolling, as_bytes, chunks_of, concat_texts, cut, free_names, id_of

WINDOW = 13
SHARE = 20
#: Bytes of text in a shard's array; bytes of benchmark text that a pass holds.
SHARD_BYTES, BLOCK_BYTES = 1 << 21, 32 << 20

SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest long, longest_word long"
PARTS = "doc_id long, text_key binary, n_words long, spans array<long>, items array<long>, longest long, longest_word long"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = True
_WORD[0x80:] = True


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit codes of all words of the texts, and the offsets at which each text's words begin."""
    data, offsets = concat_texts([t + b" " for t in texts])
    data = _LOWER[data]
    flags = np.zeros(len(data) + 1, np.int8)
    flags[:-1] = _WORD[data]
    edges = np.diff(flags, prepend=np.int8(0))
    start, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    return Rolling(data).slices(start, end), np.searchsorted(start, offsets)


def sequences(ids: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """Each suffix's first words as one value that compares as the words do, so that sorting it sorts suffixes."""
    rows = np.lib.stride_tricks.sliding_window_view(ids, length)[start] if len(start) else np.empty((0, length), ids.dtype)
    return np.ascontiguousarray(rows.astype(">u4")).view(f"S{4 * length}").ravel()


class Tests:
    """The benchmark's suffixes: vocabulary, windows by length and the items that hold each."""

    def __init__(self, items: list[tuple[int, bytes]], window: int = WINDOW):
        codes, offsets = words_of([t for _, t in items])
        self.vocabulary = np.unique(codes)
        self.items = np.array([i for i, _ in items], np.int64)
        self.windows: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        ids = self.number(codes)
        by: dict[int, list[tuple[int, int]]] = {}
        for k in range(len(items)):
            s, e = int(offsets[k]), int(offsets[k + 1])
            if e > s:
                length = min(window, e - s)
                by.setdefault(length, []).extend((p, k) for p in range(s, e - length + 1))
        for length, places in sorted(by.items()):
            at, item = (np.array(x, np.int64) for x in zip(*places))
            keys, inverse = np.unique(sequences(ids, at, length), return_inverse=True)
            owners = np.unique(np.stack([inverse, item]), axis=1)
            self.windows.append((length, keys, owners[1], np.searchsorted(owners[0], np.arange(len(keys) + 1)), at))
        self.ids, self.window = ids, window
        self.ends = offsets
        self.sorted: tuple[np.ndarray, np.ndarray] | None = None

    def number(self, codes: np.ndarray) -> np.ndarray:
        """Ids of words from 1; 0 for a word that no item has."""
        if not len(self.vocabulary):
            return np.zeros(len(codes), np.uint32)
        at = np.minimum(np.searchsorted(self.vocabulary, codes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == codes, at + 1, 0).astype(np.uint32)

    def suffixes(self) -> tuple[np.ndarray, np.ndarray]:
        """The items' words with a 0 after each item, and the starts of all suffixes in order, by doubling of ranks."""
        if self.sorted is None:
            words = np.insert(self.ids.astype(np.int64), self.ends[1:], 0)
            rank, known, n = words, 1, len(words)
            order = np.argsort(rank, kind="stable")
            while known < n:
                later = np.zeros(n, np.int64)
                later[: n - known] = rank[known:] + 1
                order = np.lexsort((later, rank))
                new = np.ones(n, np.int64)
                new[1:] = (rank[order[1:]] != rank[order[:-1]]) | (later[order[1:]] != later[order[:-1]])
                rank = np.empty(n, np.int64)
                rank[order] = np.cumsum(new)
                if new.all():
                    break
                known *= 2
            self.sorted = words, order[words[order] > 0]
        return self.sorted


class Shard:
    """A run of documents, its words' ids and its suffix arrays."""

    def __init__(self, tests: Tests, texts: list[bytes]):
        codes, self.offsets = words_of(texts)
        self.tests, self.ids = tests, tests.number(codes)
        n = len(self.ids)
        # known[i]: how many words from i on are benchmark words of the same document
        stop = np.union1d(np.flatnonzero(self.ids == 0), self.offsets)
        at = np.arange(n)
        after = stop[np.searchsorted(stop, at + 1)] if n else at
        self.known = np.where(self.ids == 0, 0, np.minimum(after, n) - at)

    def suffix_array(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of suffixes in the order of their first ``length`` words, and those words."""
        start = np.flatnonzero(self.known >= length)
        keys = sequences(self.ids, start, length)
        order = np.argsort(keys, kind="stable")
        return start[order], keys[order]

    def places(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, tuple]]:
        """For each window length: word positions of matches and the number of the window that is there."""
        for group in self.tests.windows:
            starts, keys = self.suffix_array(group[0])
            if len(starts):
                low, high = np.searchsorted(keys, group[1], "left"), np.searchsorted(keys, group[1], "right")
                hit = np.flatnonzero(high > low)
                count = (high - low)[hit]
                if len(hit):
                    rank = np.repeat(low[hit] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
                    yield group[0], starts[rank], np.repeat(hit, count), group

    def common(self, at: np.ndarray, words: np.ndarray, test: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many words the suffixes at ``at`` (within their documents) and ``test`` begin with alike, and which come before."""
        stop = self.offsets[np.searchsorted(self.offsets, at, side="right")]
        same, before, step, todo = np.zeros(len(at), np.int64), np.zeros(len(at), bool), np.arange(16), np.arange(len(at))
        while len(todo):
            place = (at[todo] + same[todo])[:, None] + step
            own = np.where(place < stop[todo][:, None], self.ids[np.minimum(place, len(self.ids) - 1)], 0).astype(np.int64)
            other = words[np.minimum((test[todo] + same[todo])[:, None] + step, len(words) - 1)]
            equal = (own == other) & (own > 0)
            first = np.where(equal.all(axis=1), len(step), np.argmin(equal, axis=1))
            same[todo] += first
            row = np.flatnonzero(first < len(step))
            before[todo[row]] = own[row, first[row]] < other[row, first[row]]
            todo = todo[first == len(step)]
        return same, before

    def longest_at(self, at: np.ndarray) -> np.ndarray:
        """Words of the longest verbatim match with any item from each of the given places on."""
        words, order = self.tests.suffixes()
        low, high, best = np.zeros(len(at), np.int64), np.full(len(at), len(order)), np.zeros(len(at), np.int64)
        while len(todo := np.flatnonzero(low < high)):  # the suffix's neighbours in the order are both looked at
            middle = (low[todo] + high[todo]) // 2
            same, before = self.common(at[todo], words, order[middle])
            best[todo] = np.maximum(best[todo], same)
            high[todo] = np.where(before, middle, high[todo])
            low[todo] = np.where(before, low[todo], middle + 1)
        return best

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[int, np.ndarray], np.ndarray, np.ndarray]:
        """Words per document, a hit flag per word, the items that occur in each document that has any, and each document's longest match and its place."""
        n, cover, pairs, found = len(self.ids), np.zeros(len(self.ids) + 1, np.int32), [], []
        for length, at, window, (_, _, owner, first, _) in self.places():
            place = np.unique(at)
            # a match that is longer than a whole window consists of windows; beyond a short item's end it counts no more
            far = self.longest_at(place) if length == self.tests.window else np.full(len(place), length)
            np.add.at(cover, place, 1)
            np.add.at(cover, place + far, -1)
            found.append((place, far))
            doc = np.searchsorted(self.offsets, at, side="right") - 1
            doc, window = np.unique(np.stack([doc, window]), axis=1)
            count = first[window + 1] - first[window]
            rank = np.repeat(first[window] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            pairs.append(np.stack([np.repeat(doc, count), self.tests.items[owner[rank]]]))
        hit = np.cumsum(cover[:n]) > 0
        items: dict[int, np.ndarray] = {}
        longest, where = np.zeros(len(self.offsets) - 1, np.int64), np.full(len(self.offsets) - 1, -1)
        if pairs:
            doc, item = np.unique(np.concatenate(pairs, axis=1), axis=1)
            for d, i in zip(np.unique(doc), np.split(item, np.flatnonzero(np.diff(doc)) + 1)):
                items[int(d)] = i
            place, far = (np.concatenate(c) for c in zip(*found))
            order = np.lexsort((-place, far))  # the longest last, the first of several equal ones behind the others
            doc = np.searchsorted(self.offsets, place[order], side="right") - 1
            longest[doc], where[doc] = far[order], place[order] - self.offsets[doc]
        return np.diff(self.offsets), hit, self.offsets, items, longest, where

    def longest(self) -> Iterator[tuple[int, int, int, int, int]]:
        """(document, word position, item, item word position, words): maximal verbatim matches of a window or more."""
        t = self.tests
        for length, at, window, (_, keys, _, _, test_at) in self.places():
            number = np.searchsorted(keys, sequences(t.ids, test_at, length))
            order = np.argsort(number, kind="stable")
            lo, hi = (np.searchsorted(number[order], window, side) for side in ("left", "right"))
            for p, a, b in zip(at.tolist(), lo.tolist(), hi.tolist()):
                d = int(np.searchsorted(self.offsets, p, side="right")) - 1
                for q in test_at[order[a:b]].tolist():
                    k = int(np.searchsorted(t.ends, q, side="right")) - 1
                    if q > t.ends[k] and p > self.offsets[d] and self.ids[p - 1] == t.ids[q - 1]:
                        continue  # part of a match that begins earlier
                    most = min(int(self.offsets[d + 1]) - p, int(t.ends[k + 1]) - q)
                    same = self.ids[p : p + most] == t.ids[q : q + most]
                    yield d, p - int(self.offsets[d]), int(t.items[k]), q - int(t.ends[k]), most if same.all() else int(np.argmin(same))


def shards(batch: pa.RecordBatch) -> Iterator[tuple[list[int], list[bytes]]]:
    ids, texts = batch.column(0).to_pylist(), as_bytes(batch.column(1))
    for i, j in chunks_of(map(len, texts), SHARD_BYTES):
        yield ids[i:j], texts[i:j]


def items_digest(items: np.ndarray) -> str:
    return hashlib.sha256(",".join(sorted("" if i == NO_ID else str(i) for i in items.tolist())).encode()).hexdigest()


def blocks(benchmark: DataFrame, item_col: str, text_col: str) -> list[list[tuple[int, bytes]]]:
    """The benchmark in blocks of at most about BLOCK_BYTES, one at a time; its size is summed up before any is fetched."""
    rows = benchmark.select(id_of(benchmark, item_col, "i"), F.coalesce(benchmark[text_col], F.lit("")).cast("binary").alias("t"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("t") + 32), F.lit(0))).first()[0]
    n = -(-size // BLOCK_BYTES) or 1
    part = F.pmod(F.xxhash64("i"), F.lit(n))
    for k in range(n):
        yield [(r.i, bytes(r.t)) for r in rows.where(part == k).orderBy("i", "t").collect()]


def text_key(text):
    """Tells texts apart where verdicts of several blocks are put together."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def null_of(where: np.ndarray) -> pa.Array:
    return pa.array(where, pa.int64(), mask=where < 0)


def decontamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, share: int = SHARE, keyed: bool = False) -> DataFrame:
    """Per document: words, hit words, items that occur, the verdict n_hit > 0 and share * n_hit >= n_words, and the longest match and its word (null if none).

    ``keyed`` adds text_key, and is for a benchmark of several blocks.
    """
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    source = iter(blocks(benchmark, item_col, item_text))
    first = next(source)
    rest = next(source, None)
    if rest is None:
        held = spark.sparkContext.broadcast(first)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tests = Tests(held.value, window)
            for batch in batches:
                for ids, texts in shards(batch):
                    n_words, hit, offsets, items, longest, where = Shard(tests, texts).result()
                    total = np.concatenate([[0], np.cumsum(hit)])
                    n_hit = total[offsets[1:]] - total[offsets[:-1]]
                    none = np.empty(0, np.int64)
                    own = [items.get(d, none) for d in range(len(ids))]
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n_words.astype(np.int64)), pa.array(n_hit.astype(np.int64)), pa.array([len(i) for i in own], pa.int64()), pa.array([items_digest(i) for i in own]), pa.array((n_hit > 0) & (share * n_hit >= n_words)), pa.array(longest), null_of(where)], names_of(SCHEMA))

        return rows.mapInArrow(run, SCHEMA)

    def part(block: list[tuple[int, bytes]]) -> DataFrame:
        """One block's share of the result, already written, so that the next block can take its place in memory."""
        held = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tests = Tests(held.value, window)
            for batch in batches:
                for ids, texts in shards(batch):
                    n_words, hit, offsets, items, longest, where = Shard(tests, texts).result()
                    spans = []
                    for d in range(len(ids)):
                        edges = np.flatnonzero(np.diff(hit[offsets[d] : offsets[d + 1]].astype(np.int8), prepend=0, append=0))
                        spans.append(edges.tolist())
                    keys = [hashlib.sha256(t).digest() for t in texts]
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(n_words.astype(np.int64)), pa.array(spans, pa.list_(pa.int64())), pa.array([items.get(d, np.empty(0, np.int64)).tolist() for d in range(len(ids))], pa.list_(pa.int64())), pa.array(longest), null_of(where)], names_of(PARTS))

        out = cut(rows.mapInArrow(run, PARTS), "block")
        held.unpersist()
        return out

    parts, copies = part(first).unionByName(part(rest)), 2
    for block in source:
        parts, copies = parts.unionByName(part(block)), copies + 1
    # repeated rows are counted, not gathered: a block says the same of each of them
    each = parts.groupBy("doc_id", "text_key", "n_words", "spans", "items", "longest", "longest_word").agg(F.count("*").alias("n"))
    whole = each.groupBy("doc_id", "text_key", "n_words").agg(F.collect_list("spans").alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.sum("n").alias("n"), F.max(F.struct("longest", (-F.col("longest_word")).alias("w"))).alias("far"))
    out = SCHEMA.replace("contaminated", "text_key binary, contaminated")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                cover = np.zeros(r["n_words"] + 1, np.int32)
                for s in r["spans"]:
                    np.add.at(cover, np.array(s[::2], np.int64), 1)
                    np.add.at(cover, np.array(s[1::2], np.int64), -1)
                n_hit = int((np.cumsum(cover[:-1]) > 0).sum())
                row = (r["doc_id"], r["n_words"], n_hit, len(r["items"]), items_digest(np.array(r["items"], np.int64)), r["text_key"], n_hit > 0 and share * n_hit >= r["n_words"], r["far"]["longest"], None if r["far"]["w"] is None else -r["far"]["w"])
                left = r["n"] // copies
                while left:
                    some = min(left, 4096)
                    left -= some
                    yield pa.RecordBatch.from_arrays([pa.array([v] * some, k) for v, k in zip(row, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.bool_(), pa.int64(), pa.int64()))], names_of(out))

    found = whole.mapInArrow(join, out)
    return found if keyed else found.drop("text_key")


def names_of(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def longest_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """Locations: (doc_id, doc_word, item_id, item_word, n_words) of maximal verbatim matches of at least a window."""
    spark, out = docs.sparkSession, None
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    for block in blocks(benchmark, item_col, item_text):
        held = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            tests = Tests(held.value, window)
            for batch in batches:
                for ids, texts in shards(batch):
                    found = [(ids[d], *r) for d, *r in Shard(tests, texts).longest()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found) if found else [()] * 5)], ["doc_id", "doc_word", "item_id", "item_word", "n_words"])

        one = rows.mapInArrow(run, "doc_id long, doc_word long, item_id long, item_word long, n_words long")
        out = one if out is None else out.unionByName(one)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the contaminated rows; all columns of ``docs`` are kept, whatever their names.

    The verdict depends on a row's text alone, so null and repeated ids matter nothing and repeated rows go or stay
    together. Null and empty texts stay. An empty table stays empty; an empty benchmark removes nothing.
    """
    source = blocks(benchmark, "item_id", "text")
    first = next(source)
    if next(source, None) is None:
        held, at = docs.sparkSession.sparkContext.broadcast(first), docs.columns.index("text")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tests = Tests(held.value)
            for batch in batches:
                texts = as_bytes(batch.column(at))
                for i, j in chunks_of(map(len, texts), SHARD_BYTES) if texts else ():
                    n_words, hit, offsets, *_ = Shard(tests, texts[i:j]).result()
                    total = np.concatenate([[0], np.cumsum(hit)])
                    n_hit = total[offsets[1:]] - total[offsets[:-1]]
                    yield batch.slice(i, j - i).filter(pa.array((n_hit == 0) | (SHARE * n_hit < n_words)))

        return docs.mapInArrow(run, docs.schema)
    # beyond one block verdicts are put together by text
    key, = free_names(docs, "_key")
    texts = docs.select(F.lit(None).cast("long").alias("doc_id"), "text")
    gone = decontamination(texts, benchmark, keyed=True).where("contaminated").select(F.col("text_key").alias(key)).distinct()
    return docs.withColumn(key, text_key(docs["text"])).join(gone, key, "left_anti").select(*docs.columns)
