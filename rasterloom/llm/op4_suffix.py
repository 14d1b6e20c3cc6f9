"""Suffix-array deduplication of verbatim passages, by bucket-pointer refinement.

A byte goes if it is covered by a string of ``length`` bytes that also starts in a document of smaller id. To find such
strings every suffix of the corpus would be bucketed by its first bytes and the buckets refined. Here the corpus-wide
buckets are those of one q-gram per stretch of neighbouring suffixes: among the q-grams inside a suffix's first
``length`` bytes, the one of smallest hash. Equal strings choose the same q-gram at the same place, so no repeat is lost,
and suffixes next to each other share their choice (a *stretch*), which thins what moves to some 6 % of all suffixes.

1. ``split``: texts go to files of bounded size in the shared folder, so that later passes need no shuffle of text.
2. ``bucket``: every stretch becomes (q-gram, content, smallest document), merged within its file; buckets of q-grams
   are dealt out. A bucket of one content is settled by its smallest document. Others are refined:
3. ``refine``: each distinct content of an unsettled bucket is sent once, and the suffixes in it are sorted by
   bucket-pointer refinement: 8-gram buckets, then pointers at offsets 8, 16, ... each level reusing the pointers that
   the level before it refined, to the full length. A class's smallest document settles its members.
   q-grams with more than ``HOT`` contents are refined one suffix at a time instead, merged by file before they move.
4. ``apply``: files are read again and their verdicts applied.

No cap drops a case: every bucket, hot or not, takes one of the exact ways. Within a q-gram's bucket contents are compared by
64 bits of hash of their own in step 2, and byte by byte in step 3.

Edge cases: null and empty texts keep nothing and lose nothing; texts shorter than ``length`` stay whole; repeats within
one document alone stay; rows of equal id count as one document and each gets its row; rows without an id count as one
document before all others; very long texts cross blocks; an empty table gives an empty result; columns may have any names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, as_bytes, chunks_of, concat_texts, cut, fresh_path, fs_of, id_of, ids_back, mix64

LENGTH, GRAM = 50, 16
#: Bytes of text in a file, in one array and in one block of suffixes.
SPLIT_BYTES, CHUNK_BYTES, BLOCK = 16 << 20, 1 << 20, 1 << 20
#: Contents of one q-gram beyond which its suffixes are refined one by one.
HOT = 4096
SETTLED, SEND, SEND_HOT, REFINED, REFINED_HOT, FILE = range(6)

SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


# ---- bucket-pointer refinement -------------------------------------------------------------------------------------


def bucket_pointers(data: np.ndarray, depth: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(order, pointer): suffixes sorted by their first ``depth`` bytes (all, if None), and each suffix's bucket.

    A bucket's pointer is the place of its first suffix in the order. Initial buckets are those of 8-grams. A level sorts
    the suffixes of every bucket that has more than one by the pointer of the suffix ``known`` bytes further on, and
    writes the finer pointers back, so the next level reaches twice as far. Beyond the end counts as smaller than any
    byte.
    """
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    padded = np.zeros(n + 8, np.uint64)
    padded[:n] = data
    key = np.zeros(n, np.uint64)
    first = min(8, depth or 8)
    for j in range(first):
        key |= padded[j : j + n] << np.uint64(56 - 8 * j)
    past = np.minimum(n - np.arange(n), first).astype(np.uint8)  # a shorter suffix comes before one padded by zero bytes
    order = np.lexsort((past, key))
    edge = np.empty(n, bool)
    edge[0] = True
    edge[1:] = (key[order[1:]] != key[order[:-1]]) | (past[order[1:]] != past[order[:-1]])
    pointer = np.empty(n, np.int64)
    head = np.flatnonzero(edge)
    pointer[order] = np.repeat(head, np.diff(np.append(head, n)))
    known = first
    while depth is None or known < depth:
        size = np.diff(np.append(np.flatnonzero(edge), n))
        open_ = np.repeat(size > 1, size)
        at = np.flatnonzero(open_)
        if not len(at):
            break
        step = known if depth is None else min(known, depth - known)
        members = order[at]
        later = members + step
        finer = np.where(later < n, pointer[np.minimum(later, n - 1)] + 1, 0)
        sort = np.argsort((pointer[members] << 32) | finer, kind="stable")
        members, finer = members[sort], finer[sort]
        order[at] = members
        new = np.empty(len(at), bool)
        new[0] = True
        own = pointer[members]
        new[1:] = (own[1:] != own[:-1]) | (finer[1:] != finer[:-1])
        edge[at[new]] = True
        head = np.flatnonzero(new)
        pointer[members] = np.repeat(at[head], np.diff(np.append(head, len(at))))
        known += step
    return order, pointer


def suffix_array(data: bytes) -> np.ndarray:
    """Starts of all suffixes in lexicographic order."""
    return bucket_pointers(np.frombuffer(data, np.uint8))[0]


# ---- stretches -----------------------------------------------------------------------------------------------------


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    n = 1
    while n * 2 <= width:
        a, n = np.minimum(a[:-n], a[n:]), n * 2
    return np.minimum(a[: len(a) - (width - n)], a[width - n :]) if width > n else a


class Stretches:
    """All stretches of some texts: q-gram, content hash, document index, first byte and end byte of the content."""

    def __init__(self, texts: list[bytes], length: int = LENGTH, gram: int = GRAM):
        self.data, self.offsets = concat_texts(texts)
        self.length, parts = length, []
        for low in range(0, max(len(self.data) - length + 1, 0), BLOCK):
            parts.append(self._block(low, self.data[low : low + BLOCK + length - 1], gram))
        empty = [np.empty(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64)]
        self.gram, self.content, self.doc, self.start, self.end = [np.concatenate(c) for c in zip(*parts)] if parts else empty

    def _block(self, low: int, data: np.ndarray, gram: int) -> tuple[np.ndarray, ...]:
        rolling, length = Rolling(data), self.length
        hashes = rolling.grams(gram)
        bits = np.uint64((1 << (BLOCK + length).bit_length()) - 1)
        chosen = (sliding_min((hashes & ~bits) | np.arange(len(hashes), dtype=np.uint64), length - gram + 1) & bits).astype(np.int64)
        change = np.empty(len(chosen), bool)
        change[0] = True
        np.not_equal(chosen[1:], chosen[:-1], out=change[1:])
        first = np.flatnonzero(change)
        at = chosen[first]
        last = np.append(first[1:], len(chosen))
        doc = np.searchsorted(self.offsets, at + low, side="right") - 1  # the document that the q-gram begins in
        first = np.maximum(first, self.offsets[doc] - low)
        last = np.minimum(last, self.offsets[doc + 1] - low - length + 1)
        keep = last > first
        first, last, at, doc = first[keep], last[keep], at[keep], doc[keep]
        end = last + length - 1
        content = mix64(rolling.slices(first, end) + (at - first).astype(np.uint64))  # whole: the q-gram's hash tells nothing apart in its own bucket
        return hashes[at], content, doc, first + low, end + low

    def window_keys(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, start, 64 and 32 bits of hash) of every suffix of the given stretches."""
        count = self.end[rows] - self.start[rows] - self.length + 1
        row = np.repeat(rows, count)
        start = np.repeat(self.start[rows] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum()) if len(rows) else np.empty(0, np.int64)
        big, small = np.empty(len(start), np.uint64), np.empty(len(start), np.uint32)
        for i in range(0, len(start), 1 << 16):
            views = np.lib.stride_tricks.sliding_window_view(self.data, self.length)[start[i : i + (1 << 16)]]
            digests = np.frombuffer(b"".join(hashlib.blake2b(v.tobytes(), digest_size=12).digest() for v in views), np.dtype([("a", "<u8"), ("b", "<u4")]))
            big[i : i + len(views)], small[i : i + len(views)] = digests["a"], digests["b"]
        return row, start, big, small


def least_by_key(gram: np.ndarray, content: np.ndarray, doc: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, ...]:
    """One row for each (gram, content): its smallest and largest document."""
    order = np.lexsort((content, gram))
    gram, content = gram[order], content[order]
    edge = np.ones(len(gram), bool)
    edge[1:] = (gram[1:] != gram[:-1]) | (content[1:] != content[:-1])
    head = np.flatnonzero(edge)
    if not len(head):
        return gram, content, doc, top
    return gram[head], content[head], np.minimum.reduceat(doc[order], head), np.maximum.reduceat(top[order], head)


# ---- columns in a blob ---------------------------------------------------------------------------------------------


def pack(*columns: np.ndarray) -> bytes:
    """Columns of equal length, their bytes in planes, compressed."""
    head = ",".join(c.dtype.str for c in columns).encode()
    planes = b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), c.dtype.itemsize).T).tobytes() for c in map(np.ascontiguousarray, columns))
    return bytes([len(head)]) + head + len(columns[0]).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(planes)


def unpack(blob: bytes) -> list[np.ndarray]:
    k = blob[0]
    kinds, n = blob[1 : 1 + k].decode().split(","), int.from_bytes(blob[1 + k : 9 + k], "little")
    data, at, out = zstandard.ZstdDecompressor().decompress(blob[9 + k :]) if n else b"", 0, []
    for kind in kinds:
        width = np.dtype(kind).itemsize
        plane = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n)
        out.append(np.ascontiguousarray(plane.T).view(kind).ravel())
        at += n * width
    return out


def unpack_all(blobs: list[bytes]) -> list[np.ndarray]:
    return [np.concatenate(c) for c in zip(*map(unpack, blobs))]


def batch_of(rows: list[tuple], names: str, kinds: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * len(kinds), kinds)], names.split())


class Lookup:
    """Finds (gram, content) in verdicts; both are compared in full after the search."""

    def __init__(self, gram: np.ndarray, content: np.ndarray):
        key = self.key(gram, content)
        self.order = np.argsort(key, kind="stable")
        self.keys, self.gram, self.content = key[self.order], gram[self.order], content[self.order]

    @staticmethod
    def key(gram: np.ndarray, content: np.ndarray) -> np.ndarray:
        return gram + content.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def pairs(self, gram: np.ndarray, content: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row asked, row found) for every equal pair."""
        if not len(self.keys) or not len(gram):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        key = self.key(gram, content)
        low, high = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
        count = high - low
        asked = np.repeat(np.arange(len(gram)), count)
        found = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        same = (self.gram[found] == gram[asked]) & (self.content[found] == content[asked])
        return asked[same], self.order[found[same]]


# ---- steps ---------------------------------------------------------------------------------------------------------


def read_split(path: str, whole: bool = False) -> Iterator[tuple]:
    """The documents of a file, in runs of about CHUNK_BYTES; ``whole``: with the batch of their rows."""
    fs, where = fs_of(path)
    with fs.open_input_file(where) as source:
        for batch in pq.ParquetFile(source).iter_batches(batch_size=2048, columns=None if whole else ["doc_id", "text"]):
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), as_bytes(batch.column(1))
            for i, j in chunks_of(map(len, texts), CHUNK_BYTES):
                yield (ids[i:j], texts[i:j], batch.slice(i, j - i)) if whole else (ids[i:j], texts[i:j])


def split(docs: DataFrame, folder: str, id_col: str, text_col: str, whole: bool = False) -> DataFrame:
    """Manifest (path) of files of whole texts, already written; ``whole``: of whole rows, whose columns go by number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, room = [], 0

        def write() -> pa.RecordBatch:
            fs, root = fs_of(folder)
            fs.create_dir(root, recursive=True)
            name = f"{uuid.uuid4().hex}.parquet"
            with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
                pq.write_table(pa.Table.from_batches(held), out, compression="zstd", use_dictionary=False, row_group_size=2048, write_statistics=False)
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"]})

        for batch in batches:
            batch = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.binary()), *batch.columns[2:]], batch.schema.names)
            for i, j in chunks_of([len(v) for v in as_bytes(batch.column(1))], CHUNK_BYTES) if batch.num_rows else ():
                held.append(batch.slice(i, j - i))
                room += held[-1].get_total_buffer_size() if j - i == 1 else CHUNK_BYTES
                if room >= SPLIT_BYTES:
                    yield write()
                    held, room = [], 0
        if held:
            yield write()

    others = [docs[c].alias(f"c{k}") for k, c in enumerate(docs.columns) if c != text_col] if whole else []
    rows = docs.select(id_of(docs, id_col), docs[text_col].alias("text"), *others)
    return cut(rows.mapInArrow(run, "path string"), "splits")


def bucket(files: DataFrame, n: int, length: int, hot: int) -> DataFrame:
    """Verdicts and requests (path, kind, blob) from the corpus-wide buckets, already written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                held: list[tuple[np.ndarray, ...]] = []
                for ids, texts in read_split(path):
                    s = Stretches(texts, length)
                    doc = ids[s.doc].astype(np.int64)
                    held.append(least_by_key(s.gram, s.content, doc, doc))
                if held:
                    yield dealt(path, *least_by_key(*map(np.concatenate, zip(*held))), n)

    def settle(key: tuple, rows: pa.Table) -> pa.Table:
        paths = rows.column("path").to_pylist()
        parts = [unpack(b) for b in rows.column("blob").to_pylist()]
        gram, content, doc, top = (np.concatenate(c) for c in zip(*parts))
        origin = np.repeat(np.arange(len(paths)), [len(p[0]) for p in parts])
        out = []
        for kind, chosen, least in verdicts(gram, content, doc, top, hot):
            for k, at in by_origin(origin, chosen):
                out.append((paths[k], kind, pack(gram[at], content[at], least[at])))
        return pa.Table.from_batches([batch_of(out, "path kind blob", (pa.string(), pa.int32(), pa.binary()))])

    entries = files.repartition(n, "path").mapInArrow(run, "bucket int, path string, blob binary")
    return cut(entries.groupBy("bucket").applyInArrow(settle, "path string, kind int, blob binary"), "buckets")


def dealt(path: str, gram: np.ndarray, content: np.ndarray, doc: np.ndarray, top: np.ndarray, n: int) -> pa.RecordBatch:
    place = (mix64(gram.copy()) % np.uint64(n)).astype(np.int64)
    order = np.argsort(place, kind="stable")
    edges = np.searchsorted(place[order], np.arange(n + 1))
    rows = [(b, path, pack(*(c[order[i:j]] for c in (gram, content, doc, top)))) for b, (i, j) in enumerate(zip(edges, edges[1:])) if j > i]
    return batch_of(rows, "bucket path blob", (pa.int32(), pa.string(), pa.binary()))


def by_origin(origin: np.ndarray, chosen: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    at = np.flatnonzero(chosen)
    at = at[np.argsort(origin[at], kind="stable")]
    for part in np.split(at, np.flatnonzero(np.diff(origin[at])) + 1):
        if len(part):
            yield int(origin[part[0]]), part


def verdicts(gram: np.ndarray, content: np.ndarray, doc: np.ndarray, top: np.ndarray, hot: int = HOT) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(kind, rows concerned, smallest document of each row's content) for the rows of whole q-gram buckets."""
    n = len(gram)
    order = np.lexsort((doc, content, gram))
    g, c, d, t = gram[order], content[order], doc[order], top[order]
    new_gram, new = np.ones(n, bool), np.ones(n, bool)
    new_gram[1:] = g[1:] != g[:-1]
    new[1:] = new_gram[1:] | (c[1:] != c[:-1])
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, n))
    least = np.repeat(d[head], size)
    gram_head = np.flatnonzero(new_gram)
    gram_size = np.diff(np.append(gram_head, n))
    contents = np.repeat(np.add.reduceat(new, gram_head), gram_size)
    several = np.repeat(np.minimum.reduceat(d, gram_head) != np.maximum.reduceat(t, gram_head), gram_size)
    unsettled = several & (contents > 1) & new
    back = np.empty(n, np.int64)
    back[order] = np.arange(n)
    for kind, flags in ((SETTLED, t > least), (SEND, unsettled & (contents <= hot)), (SEND_HOT, unsettled & (contents > hot))):
        yield kind, flags[back], least[back]


def refine(requests: DataFrame, n: int, length: int) -> DataFrame:
    """Verdicts on single suffixes of the contents that were asked for, already written."""

    def send(key: tuple, rows: pa.Table) -> pa.Table:
        path, out = key[0].as_py(), []
        asked = {k: [] for k in (SEND, SEND_HOT)}
        for kind, blob in zip(rows.column("kind").to_pylist(), rows.column("blob").to_pylist()):
            asked[kind].append(blob)
        plain, hot = (unpack_all(b) if b else None for b in asked.values())
        for ids, texts in read_split(path):
            s = Stretches(texts, length)
            if plain:
                found, row = Lookup(*plain[:2]).pairs(s.gram, s.content)
                own = ids[s.doc[found]] == plain[2][row]
                found, row = found[own], row[own]
                row, once = np.unique(row, return_index=True)  # a content that the document has twice is sent once
                found = found[once]
                place = (mix64(s.gram[found]) % np.uint64(n)).astype(np.int64)
                for b in np.unique(place):
                    at = found[place == b]
                    texts_ = b"".join(s.data[i:j].tobytes() for i, j in zip(s.start[at], s.end[at]))
                    out.append((int(b), path, SEND, pack(s.gram[at], s.content[at], ids[s.doc[at]].astype(np.int64), (s.end[at] - s.start[at]).astype(np.int32)), zstandard.ZstdCompressor(level=1).compress(texts_)))
            if hot:
                found, row = Lookup(*hot[:2]).pairs(s.gram, s.content)
                found = np.unique(found[ids[s.doc[found]] == hot[2][row]])
                w, _, big, small = s.window_keys(found)
                doc = ids[s.doc[w]].astype(np.int64)
                for r in dealt(path, *least_by_key(big, small, doc, doc), n).to_pylist():
                    out.append((r["bucket"], path, SEND_HOT, r["blob"], b""))
        return pa.Table.from_batches([batch_of(out, "bucket path kind blob texts", (pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.binary()))])

    def sort(key: tuple, rows: pa.Table) -> pa.Table:
        out, by = [], {SEND: [], SEND_HOT: []}
        for r in rows.select(["path", "kind", "blob", "texts"]).to_pylist():
            by[r["kind"]].append(r)
        if own := by[SEND]:
            parts = [unpack(r["blob"]) for r in own]
            gram, content, doc, size = (np.concatenate(c) for c in zip(*parts))
            origin = np.repeat(np.arange(len(own)), [len(p[0]) for p in parts])
            data = np.frombuffer(b"".join(zstandard.ZstdDecompressor().decompress(r["texts"]) for r in own), np.uint8)
            item, low, high = refined_by_gram(data, gram, size, doc, length)
            for k, at in by_origin(origin[item], np.ones(len(item), bool)):
                i = item[at]
                out.append((own[k]["path"], REFINED, pack(gram[i], content[i], doc[i], low[at].astype(np.int32), high[at].astype(np.int32))))
        if own := by[SEND_HOT]:
            parts = [unpack(r["blob"]) for r in own]
            big, small, doc, top = (np.concatenate(c) for c in zip(*parts))
            origin = np.repeat(np.arange(len(own)), [len(p[0]) for p in parts])
            for kind, chosen, least in verdicts(big, small, doc, top):
                if kind == SETTLED:
                    for k, at in by_origin(origin, chosen):
                        out.append((own[k]["path"], REFINED_HOT, pack(big[at], small[at], least[at])))
        return pa.Table.from_batches([batch_of(out, "path kind blob", (pa.string(), pa.int32(), pa.binary()))])

    sent = requests.repartition(n, "path").groupBy("path").applyInArrow(send, "bucket int, path string, kind int, blob binary, texts binary")
    return cut(sent.repartition(n, "bucket").groupBy("bucket").applyInArrow(sort, "path string, kind int, blob binary"), "refined")


def refined_by_gram(data: np.ndarray, gram: np.ndarray, size: np.ndarray, doc: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``refined`` over runs of whole q-gram buckets of about CHUNK_BYTES, so memory doesn't follow the task's share."""
    offsets = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    order = np.argsort(gram, kind="stable")
    head = np.append(np.flatnonzero(np.diff(gram[order].astype(np.int64), prepend=gram[order[0]].astype(np.int64) + 1)), len(order))
    bytes_of = np.add.reduceat(size[order].astype(np.int64), head[:-1])
    parts = []
    for i, j in chunks_of(bytes_of.tolist(), CHUNK_BYTES):
        items = order[head[i] : head[j]]
        own = size[items].astype(np.int64)
        place = np.repeat(offsets[items] - np.concatenate([[0], np.cumsum(own)[:-1]]), own) + np.arange(own.sum())
        item, low, high = refined(data[place], own, doc[items], length)
        parts.append((items[item], low, high))
    return tuple(np.concatenate(c) for c in zip(*parts))


def refined(data: np.ndarray, size: np.ndarray, doc: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, low, high): ranges of bytes in items that strings of smaller documents' items cover."""
    offsets = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    _, pointer = bucket_pointers(data, length)
    item = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(data))
    whole = at + length <= offsets[item + 1]
    item, at, pointer = item[whole], at[whole], pointer[whole]
    order = np.argsort(pointer, kind="stable")
    head = np.flatnonzero(np.diff(pointer[order], prepend=-1))
    least = np.minimum.reduceat(doc[item[order]], head) if len(head) else np.empty(0, np.int64)
    lower = np.empty(len(at), np.int64)
    lower[order] = np.repeat(least, np.diff(np.append(head, len(at))))
    gone = np.flatnonzero(lower < doc[item])
    item, at = item[gone], at[gone]
    new = np.ones(len(at), bool)
    new[1:] = (item[1:] != item[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1 if len(first) else first
    item = item[first]
    return item, at[first] - offsets[item], at[last] + length - offsets[item]


class Verdicts:
    """What a file's documents lose."""

    def __init__(self, rows: pa.Table, length: int):
        blobs: dict[int, list[bytes]] = {}
        for kind, blob in zip(rows.column("kind").to_pylist(), rows.column("blob").to_pylist()):
            blobs.setdefault(kind, []).append(blob)
        self.columns = {k: unpack_all(b) for k, b in blobs.items() if k != FILE}
        self.lookups = {k: Lookup(*c[:2]) for k, c in self.columns.items()}

    def cover(self, ids: np.ndarray, s: Stretches) -> np.ndarray:
        """A flag for each byte of the texts: gone or not."""
        low, high, doc = [np.empty(0, np.int64)], [np.empty(0, np.int64)], ids[s.doc]
        if c := self.columns.get(SETTLED):
            found, row = self.lookups[SETTLED].pairs(s.gram, s.content)
            found = found[doc[found] > c[2][row]]
            low.append(s.start[found])
            high.append(s.end[found])
        if c := self.columns.get(REFINED):
            found, row = self.lookups[REFINED].pairs(s.gram, s.content)
            own = doc[found] == c[2][row]
            found, row = found[own], row[own]
            low.append(s.start[found] + c[3][row])
            high.append(s.start[found] + c[4][row])
        if (c := self.columns.get(SEND_HOT)) and (w := self.columns.get(REFINED_HOT)):
            found, row = self.lookups[SEND_HOT].pairs(s.gram, s.content)
            rows, start, big, small = s.window_keys(np.unique(found[doc[found] == c[2][row]]))
            asked, row = self.lookups[REFINED_HOT].pairs(big, small)
            asked = asked[doc[rows[asked]] > w[2][row]]
            low.append(start[asked])
            high.append(start[asked] + s.length)
        n = len(s.data) + 1
        return np.cumsum(np.bincount(np.concatenate(low), minlength=n) - np.bincount(np.concatenate(high), minlength=n))[:-1] > 0


def duplicate_spans(docs: DataFrame, finish, schema, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, whole: bool = False) -> DataFrame:
    """Runs the steps. ``finish(ids, texts, flags, rows)`` gives a run's batch: ``flags`` says of each byte of a text whether
    it goes, ``rows`` is the batch of whole rows, if asked for."""
    spark = docs.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    files = split(docs, fresh_path(spark, "texts"), id_col, text_col, whole)
    found = bucket(files, n, length, hot)
    more = refine(found.where(F.col("kind").isin(SEND, SEND_HOT)), n, length)
    types = arrow_schema(spark.createDataFrame([], schema).schema if isinstance(schema, str) else schema)

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        verdicts_, out = Verdicts(rows, length), []
        for ids, texts, *own in read_split(key[0].as_py(), whole):
            s = Stretches(texts, length)
            gone = verdicts_.cover(ids, s)
            made = finish(ids, texts, [gone[a:b] for a, b in zip(s.offsets, s.offsets[1:])], *own)
            out.append(pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(made, types.types)], schema=types))
        return pa.Table.from_batches(out, types)

    every = files.select("path", F.lit(FILE).alias("kind"), F.lit(b"").alias("blob"))
    verdict_rows = found.where(F.col("kind").isin(SETTLED, SEND_HOT)).unionByName(more).unionByName(every)
    return verdict_rows.repartition(n, "path").groupBy("path").applyInArrow(run, schema)


def arrow_schema(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def runs_of(gone: np.ndarray) -> int:
    """Number of maximal runs."""
    return int(np.count_nonzero(gone[1:] & ~gone[:-1]) + bool(len(gone) and gone[0]))


def kept_bytes(text: bytes, gone: np.ndarray) -> bytes:
    return text if not gone.any() else np.frombuffer(text, np.uint8)[~gone].tobytes()


def suffix_dedup(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """Per document: bytes, bytes removed, maximal removed runs, SHA-256 of what stays."""

    def finish(ids: np.ndarray, texts: list[bytes], flags: list[np.ndarray]) -> tuple:
        return ids.tolist(), [len(t) for t in texts], [int(g.sum()) for g in flags], [runs_of(g) for g in flags], [hashlib.sha256(kept_bytes(t, g)).hexdigest() for t, g in zip(texts, flags)]

    return ids_back(duplicate_spans(docs, finish, SCHEMA, length, id_col, text_col, hot), "doc_id")


def removed_spans(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The operator's own result: per document the removed byte ranges and the bytes that stay."""

    def finish(ids: np.ndarray, texts: list[bytes], flags: list[np.ndarray]) -> tuple:
        edges = [np.flatnonzero(np.diff(g.astype(np.int8), prepend=0, append=0)).reshape(-1, 2).tolist() for g in flags]
        return ids.tolist(), [[{"start": a, "end": b} for a, b in e] for e in edges], [kept_bytes(t, g) for t, g in zip(texts, flags)]

    found = duplicate_spans(docs, finish, "doc_id long, spans array<struct<start:long,end:long>>, kept binary", length, id_col, text_col)
    return ids_back(found, "doc_id")


def without_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated passages cut from the texts; all columns are kept, whatever their names.

    Null texts stay null, empty ones empty. Of repeated rows and rows of one id, which count as one document, each stays; a
    null id counts as a document before all others. A cut that would split a character keeps the character's bytes.
    ``n_chars``, where it is a column, follows the text. An empty table stays empty.
    """
    names, kinds = docs.columns, dict(docs.dtypes)
    schema = docs.schema
    number = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64()}
    counted = text_col != "n_chars" and kinds.get("n_chars") in number

    def finish(ids: np.ndarray, texts: list[bytes], flags: list[np.ndarray], rows: pa.RecordBatch) -> list:
        held = rows.column("text").is_valid().to_pylist()
        kept = [(whole_characters(t, g) if g.any() else t).decode("utf-8") if h else None for t, g, h in zip(texts, flags, held)]
        made = {text_col: pa.array(kept, pa.string())}
        if counted:
            made["n_chars"] = pa.array([None if t is None else len(t) for t in kept], number[kinds["n_chars"]])
        return [made[c] if c in made else rows.column(f"c{k}") for k, c in enumerate(names)]

    return duplicate_spans(docs, finish, schema, length, id_col, text_col, whole=True)


def whole_characters(text: bytes, gone: np.ndarray) -> bytes:
    """What stays of a text, with characters that a cut would split kept whole."""
    data = np.frombuffer(text, np.uint8)
    start = np.flatnonzero((data & 0xC0) != 0x80)
    size = np.diff(np.append(start, len(data)))
    return data[~np.repeat(np.logical_and.reduceat(gone, start), size)].tobytes()
