"""Token-id files: independent Zstandard frames, a trailing seek table, a checksum for each frame.

File layout: data frames (little-endian unsigned 16- or 32-bit ids of consecutive documents), one index frame (columns of
document id, first id, number of ids), then the public seekable-format table in a skippable frame: for every frame its
compressed size, its decompressed size and the low 32 bits of its XXH64. A reader opens the table, the index, and only
those frames that hold the documents asked for; it verifies each frame that it opens.

Edge cases: null and empty texts hold the end id alone; rows with equal ids keep their order by text; an empty input
gives no file; rows without an id come first; other columns of the input take no part.
"""

from __future__ import annotations

import io
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh_path, fs_of, id_of, ids_back

#: Fixed values of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: Bytes of ids in a frame, about; compression level.
FRAME_BYTES, LEVEL = 1 << 18, 1
#: Words a worker remembers, and their characters; beyond either the memory is emptied.
CACHE_WORDS, CACHE_CHARS = 700_000, 1 << 25

MANIFEST = "path string, first_doc long, n_docs long, n_ids long, n_bytes long"


class FrameWriter:
    """Writes one file to an open binary stream. ``add`` whole documents in order, then ``close``."""

    def __init__(self, out, width: int = 2):
        self.out, self.width, self.held, self.room = out, width, [], 0
        self.frames: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int, int, int]] = []
        self.n_ids = self.n_bytes = 0
        self.packer = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False)

    def add(self, doc_id: int, ids: bytes) -> None:
        n = len(ids) // self.width
        self.docs.append((doc_id, self.n_ids, n))
        self.n_ids += n
        view = memoryview(ids)
        for at in range(0, len(ids), FRAME_BYTES):  # a long document takes several frames
            part = view[at : at + FRAME_BYTES]
            self.held.append(part)
            self.room += len(part)
            if self.room >= FRAME_BYTES:
                self._flush()

    def _flush(self) -> None:
        if self.room:
            self._frame(b"".join(self.held))
            self.held, self.room = [], 0

    def _frame(self, data: bytes) -> None:
        packed = self.packer.compress(data)
        self.out.write(packed)
        self.n_bytes += len(packed)
        self.frames.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))

    def close(self) -> None:
        self._flush()
        columns = np.array(self.docs, np.int64).reshape(-1, 3).T
        self._frame(struct.pack("<IQ", self.width, len(self.docs)) + columns.tobytes())
        table = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0x80, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.n_bytes += len(table) + 8


class FrameReader:
    """Random access to a file by document. ``opened`` counts the data frames that were decompressed."""

    def __init__(self, source):
        self.source, self.opened = source, 0
        self.unpack = zstandard.ZstdDecompressor()
        end = source.seek(0, io.SEEK_END)
        source.seek(end - 9)
        n, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE or flags != 0x80:
            raise ValueError("no seek table")
        size = 12 * n + 9
        source.seek(end - size - 8)
        head = struct.unpack("<II", source.read(8))
        if head != (SKIPPABLE, size):
            raise ValueError("damaged seek table")
        self.frames = np.frombuffer(source.read(12 * n), "<u4").reshape(-1, 3).astype(np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.frames[:, 0])])
        index = self._frame(n - 1)
        self.width, docs = struct.unpack_from("<IQ", index)
        self.doc_id, self.start, self.count = np.frombuffer(index, np.int64, offset=12).reshape(3, docs)
        self.bytes_at = np.concatenate([[0], np.cumsum(self.frames[:-1, 1])])
        self.cached: tuple[int, bytes] = (-1, b"")

    def _frame(self, k: int) -> bytes:
        self.source.seek(int(self.at[k]))
        data = self.unpack.decompress(self.source.read(int(self.frames[k, 0])), max_output_size=int(self.frames[k, 1]))
        if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.frames[k, 2]:
            raise ValueError(f"frame {k} is damaged")
        return data

    def raw(self, row: int) -> Iterator[bytes]:
        """The stored bytes of the document in that row of the index, frame by frame."""
        at, end = int(self.start[row]) * self.width, int(self.start[row] + self.count[row]) * self.width
        k = int(np.searchsorted(self.bytes_at, at, side="right")) - 1
        while at < end:
            if self.cached[0] != k:
                self.cached = (k, self._frame(k))
                self.opened += 1
            base = int(self.bytes_at[k])
            yield self.cached[1][at - base : end - base]
            k, at = k + 1, int(self.bytes_at[k + 1])

    def ids(self, doc_id: int) -> np.ndarray | None:
        rows = np.flatnonzero(self.doc_id == doc_id)
        return np.frombuffer(b"".join(self.raw(int(rows[0]))), f"<u{self.width}") if len(rows) else None


class ByteBPE:
    """The tokenizers library over whole texts, with a memory of words.

    The split pattern attaches one leading space to a word, so a text may be cut before each space that stands between
    two characters that are no white space, and the encoding of the pieces joined is that of the text.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.width = 2 if self.tokenizer.get_vocab_size() <= 0xFFFF else 4
        self.memory: dict[str, bytes] = {}
        #: Characters of the words in memory.
        self.remembered = 0
        self.cut = re.compile(r"(?<=\S) (?=\S)")
        self.uneven = re.compile(r"\s\s|^\s|\s\Z")
        #: Whether a token begins with a space, which a word's first token alone does.
        self.leads = np.zeros(1 << (8 * self.width), bool) if self.width == 2 else np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        self.leads[[i for t, i in self.tokenizer.get_vocab().items() if t.startswith("\u0120")]] = True

    def pack(self, ids: list[int]) -> bytes:
        return np.array(ids, f"<u{self.width}").tobytes()

    def words(self, text: str) -> list[str]:
        """The pieces. A plain split at spaces serves where no white space stands beside other white space or at an end."""
        return self.cut.split(text) if self.uneven.search(text) else text.split(" ")

    def learn(self, new: list[str]) -> None:
        """Remembers words as they are after a space. Words without one inside are encoded together, and told apart by it."""
        memory, plain = self.memory, [w for w in new if " " not in w]
        for at in range(0, len(plain), 64):
            part = plain[at : at + 64]
            ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(part)], add_special_tokens=False)[0].ids, f"<u{self.width}")
            edges = (np.flatnonzero(self.leads[ids]) * self.width).tolist()
            if len(edges) != len(part):
                raise ValueError("a word's first token is expected to begin with its space")
            data = ids.tobytes()
            memory.update(zip(part, map(data.__getitem__, map(slice, edges, [*edges[1:], len(data)]))))
        odd = [w for w in new if " " in w]
        for w, e in zip(odd, self.tokenizer.encode_batch_fast([" " + w for w in odd], add_special_tokens=False) if odd else ()):
            memory[w] = self.pack(e.ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        split = [self.words(t) if t else [] for t in texts]
        heads = iter(self.tokenizer.encode_batch_fast([words[0] for words in split if words], add_special_tokens=False))
        if len(self.memory) > CACHE_WORDS or self.remembered > CACHE_CHARS:
            self.memory.clear()
            self.remembered = 0
        rest = [words[1:] for words in split]
        if new := set(chain.from_iterable(rest)).difference(self.memory):
            self.learn(list(new))
            self.remembered += sum(map(len, new))
        get = self.memory.__getitem__
        return [self.pack(next(heads).ids) + b"".join(map(get, words)) if whole else b"" for whole, words in zip(split, rest)]


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBPE:
    return ByteBPE(path)


def write_frames(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, append ``end_id``, and write one file per range of ids. Returns the manifest of files, already written.

    Ranges come from Spark's sampling of ids, so every file holds consecutive documents and file order is id order. A
    task that is tried again writes another file name; the manifest names only files of tasks that succeeded.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(id_of(docs, id_col), docs[text_col].alias("text"))
    ranged = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, writer, out = byte_bpe(tokenizer), None, None
        end = bpe.pack([end_id])
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                fs, root = fs_of(folder)
                fs.create_dir(root, recursive=True)
                name = f"ids-{uuid.uuid4().hex}.zst"
                out = fs.open_output_stream(f"{root}/{name}", compression=None)
                writer = FrameWriter(out, bpe.width)
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for at in range(0, len(ids), 256):
                for i, packed in zip(ids[at : at + 256], bpe.encode(texts[at : at + 256])):
                    writer.add(i, packed + end)
        if writer:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "first_doc": [writer.docs[0][0]], "n_docs": [len(writer.docs)], "n_ids": [writer.n_ids], "n_bytes": [writer.n_bytes]})

    return cut(ranged.mapInArrow(run, MANIFEST), "manifest")


def read_frames(manifest: DataFrame) -> DataFrame:
    """Read every document of every file back: id, global start, number of ids, CRC-32 of the ids as 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, where = fs_of(path)
                with fs.open_input_file(where) as source:
                    reader = FrameReader(source)
                    crc = []
                    for row in range(len(reader.doc_id)):
                        c = 0
                        for part in reader.raw(row):
                            c = zlib.crc32(np.frombuffer(part, f"<u{reader.width}").astype("<u4"), c)
                        crc.append(c)
                    yield pa.RecordBatch.from_arrays([pa.array(reader.doc_id), pa.array(reader.start + before), pa.array(reader.count), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # One row per file, so the running sum is over file counts, not documents.
    before = F.sum("n_ids").over(Window.orderBy("first_doc", "path").rowsBetween(Window.unboundedPreceding, -1))
    files = manifest.select("path", F.coalesce(before, F.lit(0)).alias("before"))
    n = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return ids_back(files.repartition(n, "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long"), "doc_id")


def read_documents(path: str, wanted: Iterable[int]) -> dict[int, np.ndarray]:
    """Ids of the requested documents of one file; only their frames are decompressed."""
    fs, where = fs_of(path)
    with fs.open_input_file(where) as source:
        reader = FrameReader(source)
        return {i: ids for i in wanted if (ids := reader.ids(i)) is not None}


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write the corpus to the shared folder and return what is read back from the files."""
    folder = fresh_path(docs.sparkSession, "token-ids")
    return read_frames(write_frames(docs, tokenizer, folder, end_id))
