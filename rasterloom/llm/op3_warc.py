"""WARC archives with a Zstandard dictionary, one compressed frame for each record.

A file begins with a skippable frame that holds the (compressed) dictionary, built from records of that file, or, where
these are few or small, from a bounded sample of all records; every record follows as a frame of its own, compressed with
the dictionary, so any record can be read alone from its offset. Payloads that were archived before become revisit records
that refer to the first.

Edge cases: null and empty payloads are records of length 0; payloads under ``MIN_REVISIT`` bytes are always responses;
where all records are too few or too small to train on, the dictionary is the beginning of one (raw content);
an empty table gives no files; payloads of any length are whole records; further columns, whatever their names, are left
out; rows of equal id are records of their own; a row without an id counts as before all others, and revisits of it refer to null.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, cut, fresh_path, fs_of, id_of, ids_back

#: Fixed value: the skippable frame that holds a dictionary.
DICTIONARY_FRAME = 0x184D2A5D
MIN_REVISIT = 100
#: Bounds of what a dictionary is built from and of its size; bytes of a file before the next begins.
SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES, FILE_BYTES = 400, 4 << 20, 64 << 10, 64 << 20
#: Bytes of a record that the dictionary of the whole table is built from, and of one that stands for a dictionary.
SAMPLE_TEXT, BEGINNING = 8 << 10, 400
LEVEL = 3

SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record(page_id: int, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A whole WARC/1.1 record. A revisit has the digest and length of its payload, and no payload."""
    kind = "response" if refers_to is None else "revisit"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name_of(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {re.sub('[\\r\\n]', ' ', url)}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: text/html;charset=utf-8"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name_of(refers_to)}", f"X-Payload-Length: {len(payload)}"]
        payload = b""
    return "\r\n".join([*lines, f"Content-Length: {len(payload)}"]).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def name_of(page_id: int) -> str:
    return f"<urn:page:{page_id}>"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and payload; the length is verified."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    size = int(fields["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("damaged record")
    return fields, rest[:size]


class WarcWriter:
    """Writes one archive: records are sampled for the dictionary until the bound, then all are written."""

    def __init__(self, out, common: bytes = b""):
        """``common``: the dictionary of a file whose own records make none."""
        self.out, self.common, self.held, self.room, self.packer, self.size = out, common, [], 0, None, 0

    def add(self, data: bytes) -> None:
        if self.packer is None:
            self.held.append(data)
            self.room += len(data)
            if len(self.held) >= SAMPLE_RECORDS or self.room >= SAMPLE_BYTES:
                self._begin()
        else:
            self._write(self.packer.compress(data))

    def _begin(self) -> None:
        made = dictionary(self.held) or zstandard.ZstdCompressionDict(self.common or beginning(self.held))
        packed = zstandard.ZstdCompressor(level=19).compress(made.as_bytes())
        self._write(struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed)
        self.packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=made, write_checksum=True)
        for data in self.held:
            self._write(self.packer.compress(data))
        self.held = []

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        if self.packer is None:
            self._begin()


def dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary of at most a tenth of the sample; None if the sample is too small or too uniform for one."""
    total = sum(map(len, records))
    if len(records) < 8 or total < 20_000:
        return None
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, total // 10), [r[: 16 << 10] for r in records], k=256, d=8)
    except zstandard.ZstdError:
        return None


def beginning(records: list[bytes]) -> bytes:
    """Raw content for records that no dictionary can be trained on: the headers of the first, by and large."""
    return records[0][:BEGINNING]


def common_dictionary(rows: DataFrame) -> bytes:
    """A dictionary of at most SAMPLE_RECORDS records of the table, each by its first SAMPLE_TEXT bytes; empty if they make none."""
    some = rows.select("page_id", F.substring("url", 1, 1 << 10).alias("url"), F.substring("payload", 1, SAMPLE_TEXT).alias("payload")).limit(SAMPLE_RECORDS).collect()
    made = dictionary([record(r.page_id, r.url, bytes(r.payload), hashlib.sha256(r.payload).hexdigest(), None) for r in some])
    return made.as_bytes() if made else b""


def read_records(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """All records of an archive, a frame at a time."""
    buffer, made = source.read(8), None
    if len(buffer) == 8 and struct.unpack("<I", buffer[:4])[0] == DICTIONARY_FRAME:
        packed = source.read(struct.unpack("<I", buffer[4:])[0])
        made = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(packed))
        buffer = b""
    reader = zstandard.ZstdDecompressor(dict_data=made)
    while True:
        frame, parts = reader.decompressobj(), []
        while not frame.eof:
            if not buffer and not (buffer := source.read(16 << 10)):
                if parts:
                    raise ValueError("the archive ends within a record")
                return
            parts.append(frame.decompress(buffer))
            buffer = b""
        buffer = frame.unused_data
        yield parse(b"".join(parts))


def archive(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes the archives; returns their manifest (path), already written.

    The first record of each payload comes from a partial aggregation; a payload that many pages share meets its join as
    rows of one key, which adaptive execution splits.
    """
    rows = pages.select(id_of(pages, id_col, "page_id"), F.coalesce(pages[url_col], F.lit("")).alias("url"), F.coalesce(pages[html_col], F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload"))
    first = rows.where(F.col("size") >= MIN_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").select("digest", "first")
    marked = rows.drop("size").join(first, "digest", "left")
    refers = F.when(F.col("first") < F.col("page_id"), F.col("first"))
    marked = marked.select("page_id", "url", "payload", "digest", refers.alias("refers_to"))

    common = common_dictionary(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = out = None
        path = ""
        for batch in batches:
            ids, urls, digests, refs = (batch.column(c).to_pylist() for c in ("page_id", "url", "digest", "refers_to"))
            for i, url, payload, digest, ref in zip(ids, urls, as_bytes(batch.column("payload")), digests, refs):
                if writer is None:
                    fs, root = fs_of(folder)
                    fs.create_dir(root, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    path, out = f"{folder}/{name}", fs.open_output_stream(f"{root}/{name}", compression=None)
                    writer = WarcWriter(out, common)
                writer.add(record(i, url, payload, digest, ref))
                if writer.size >= FILE_BYTES:
                    writer.close()
                    out.close()
                    writer = None
                    yield pa.RecordBatch.from_pydict({"path": [path]})
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path]})

    return cut(marked.mapInArrow(run, "path string"), "archives")


def read_archives(manifest: DataFrame) -> DataFrame:
    """One row per record; digests and lengths of responses are computed from what was read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, where = fs_of(path)
                rows = []
                with fs.open_input_stream(where, compression=None) as source:
                    for fields, payload in read_records(source):
                        page, stated = int(fields["warc-record-id"][10:-1]), fields["warc-payload-digest"].removeprefix("sha256:")
                        if fields["warc-type"] == "revisit":
                            rows.append((page, int(fields["x-payload-length"]), stated, "revisit", int(fields["warc-refers-to"][10:-1])))
                            continue
                        digest = hashlib.sha256(payload).hexdigest()
                        if digest != stated:
                            raise ValueError(f"payload of {page} differs from its digest")
                        rows.append((page, len(payload), digest, "response", None))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 5, kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    n = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return ids_back(manifest.repartition(n, "path").mapInArrow(run, SCHEMA), "page_id", "refers_to")


def warc_round_trip(pages: DataFrame) -> DataFrame:
    return read_archives(archive(pages, fresh_path(pages.sparkSession, "warc")))
