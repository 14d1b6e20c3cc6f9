"""Media columns: interleaved document sequences.

HTML is parsed into one ordered sequence of structs, text pieces and media references with their captions; a reference
names its payload by digest. Payloads are stored once each, losslessly, as 8-bit grey images (PNG), in a media table of
the shared folder. A join on digests resolves references; positions and captions stay with the sequence they came from,
because only digests and what is computed from a payload move.

Edge cases: null and empty texts have a payload of padding alone; a reference without a stored payload resolves to
nulls; equal payloads share one stored form and so equal values; sequences without media keep their text pieces; very
long payloads are one image of as many rows as they need; an empty table gives an empty result; repeated rows and ids keep a
row each; other columns of the input take no part.
"""

from __future__ import annotations

import hashlib
import html
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, cut, id_of, ids_back

UNIT, WIDTH = 576, 24
LEVEL = 1

PIECES = "array<struct<position:int,kind:string,text:string,digest:string,caption:string>>"
MEDIA = "digest string, media binary"
FEATURES = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

_PIECE = re.compile(r"<!--.*?-->|<(script|style)\b.*?</\1\s*>|<img\b(?P<img>[^>]*)>|<figcaption\b[^>]*>(?P<caption>.*?)</figcaption\s*>|<(?P<end>/?)(?P<tag>[a-z][a-z0-9]*)\b[^>]*>", re.I | re.S)
_SRC = re.compile(r"\bsrc\s*=\s*[\"']?(?:digest:)([0-9a-f]{64})", re.I)
_ALT = re.compile(r"\balt\s*=\s*\"([^\"]*)\"", re.I)
_BLOCKS = frozenset("article aside blockquote body div figure footer h1 h2 h3 h4 h5 h6 header html li main nav ol p pre section table td tr ul".split())


# ---- stored form ---------------------------------------------------------------------------------------------------


def padded(data: bytes) -> bytes:
    """Bytes 255 up to a positive multiple of UNIT."""
    return data + b"\xff" * (UNIT * max(1, -(-len(data) // UNIT)) - len(data))


def png_of(samples: bytes, width: int = WIDTH) -> bytes:
    """A grey 8-bit PNG; rows are unfiltered, the length is a multiple of the width."""
    height = len(samples) // width
    rows = np.zeros((height, width + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(samples, np.uint8).reshape(height, width)

    def chunk(name: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), LEVEL)) + chunk(b"IEND", b"")


def samples_of(png: bytes) -> np.ndarray:
    """Rows of samples of a PNG that ``png_of`` wrote; every chunk's checksum is verified."""
    if png[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG")
    at, body, shape = 8, [], (0, 0)
    while at < len(png):
        n, name = struct.unpack_from(">I4s", png, at)
        data = png[at + 8 : at + 8 + n]
        if zlib.crc32(name + data) != struct.unpack_from(">I", png, at + 8 + n)[0]:
            raise ValueError("damaged chunk")
        if name == b"IHDR":
            width, height, *kind = struct.unpack(">IIBBBBB", data)
            if kind != [8, 0, 0, 0, 0]:
                raise ValueError("not a grey 8-bit image")
            shape = (height, width)
        elif name == b"IDAT":
            body.append(data)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(shape[0], shape[1] + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows are not expected")
    return rows[:, 1:]


def feature_of(rows: np.ndarray) -> str:
    """Mean sample in each sixth of the rows and in each quarter of the columns, as hexadecimal digits."""
    parts = [p.mean() if p.size else 0 for p in (*np.array_split(rows, 6, axis=0), *np.array_split(rows, 4, axis=1))]
    return "".join(f"{int(v):02x}" for v in parts)


# ---- sequences -----------------------------------------------------------------------------------------------------


def pieces_of(page: str | None) -> list[dict]:
    """Ordered pieces of a page. A caption belongs to the reference before it in its figure, else the alt text stands in."""
    out: list[dict] = []
    held: list[str] = []

    def flush() -> None:
        text = " ".join(html.unescape("".join(held)).split())
        held.clear()
        if text:
            out.append({"position": len(out), "kind": "text", "text": text, "digest": None, "caption": None})

    at, page, figure = 0, page or "", False
    for m in _PIECE.finditer(page):
        held.append(page[at : m.start()])
        at = m.end()
        if m["img"] is not None:
            flush()
            src, alt = _SRC.search(m["img"]), _ALT.search(m["img"])
            out.append({"position": len(out), "kind": "media", "text": None, "digest": src[1].lower() if src else None, "caption": html.unescape(alt[1]) if alt else None})
            figure = True
        elif m["caption"] is not None:
            flush()
            caption = " ".join(html.unescape(re.sub(r"<[^>]*>", "", m["caption"])).split())
            if figure and out and out[-1]["kind"] == "media":
                out[-1]["caption"] = caption
            elif caption:
                held.append(caption)
                flush()
        elif m["tag"] and m["tag"].lower() in _BLOCKS:
            flush()
            if m["tag"].lower() == "figure":
                figure = False
        elif m["tag"] and m["tag"].lower() == "br":
            held.append(" ")
    held.append(page[at:])
    flush()
    return out


def interleave(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, pieces): one sequence per row."""
    kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pieces_of(p) for p in batch.column(1).to_pylist()], kind)], ["id", "pieces"])

    return pages.select(pages[id_col].cast("long").alias("id"), pages[html_col].alias("html")).mapInArrow(run, f"id long, pieces {PIECES}")


def store(payloads: DataFrame, column: str) -> DataFrame:
    """The media table (digest, media) of a column of payloads, already written to the shared folder.

    The digest is that of the padded payload. A task stores a payload once however many of its rows share it; what tasks
    have in common is removed after reading, where rows are narrow.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = []
                for data in map(padded, as_bytes(batch.column(0).slice(at, 512))):
                    digest = hashlib.sha256(data)
                    if digest.digest() not in seen:
                        if len(seen) >= 1 << 20:
                            seen.clear()
                        seen.add(digest.digest())
                        rows.append((digest.hexdigest(), png_of(data)))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], ["digest", "media"])

    return cut(payloads.select(F.col(column).cast("binary").alias("payload")).mapInArrow(run, MEDIA), "media")


def media_features(media: DataFrame) -> DataFrame:
    """What is computed from the stored bytes, one row per digest. The digest is verified against what was read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digest, png in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                samples = samples_of(png)
                payload = samples.tobytes()
                own = hashlib.sha256(payload).hexdigest()
                if own != digest:
                    raise ValueError(f"payload of {digest} differs")
                rows.append((digest, len(payload.rstrip(b"\xff")), len(payload), own, zlib.crc32(payload[-32:]), len(png), hashlib.sha256(png).hexdigest(), feature_of(samples)))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 8, kinds)], FEATURES.replace(" long", "").replace(" string", "").split(", "))

    return media.mapInArrow(run, FEATURES).dropDuplicates(["digest"])


def resolve(sequences: DataFrame, resolved: DataFrame) -> DataFrame:
    """One row per media reference: id, position, caption, digest, and the columns of ``resolved`` (null if missing)."""
    refs = sequences.select("id", F.explode("pieces").alias("p")).where("p.kind = 'media'").select("id", "p.position", "p.caption", "p.digest")
    return refs.join(resolved, "digest", "left")


def document_pages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document as a page: a heading, its first line, its payload as a figure with a caption, and its other lines."""
    rows = docs.select(id_of(docs, id_col, "page_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    size = F.octet_length("text")
    units = F.greatest(F.lit(1), F.ceil(size / F.lit(UNIT))).cast("int")
    fill = F.unhex(F.repeat(F.lit("FF"), units * UNIT - size))
    digest = F.sha2(F.concat(F.col("text").cast("binary"), fill), 256)
    safe = F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    lines = F.split(safe, "\n")
    paragraphs = lambda part: F.concat(F.lit("<p>"), F.array_join(part, "</p><p>"), F.lit("</p>"))
    figure = F.concat(F.lit("<figure><img src=\"digest:"), digest, F.lit("\"><figcaption>"), size.cast("string"), F.lit(" bytes</figcaption></figure>"))
    page = F.concat(F.lit("<article><h1>Document "), F.col("page_id").cast("string"), F.lit("</h1>"), paragraphs(F.slice(lines, 1, 1)), figure, paragraphs(F.slice(lines, 2, F.size(lines))), F.lit("</article>"))
    return rows.select("page_id", page.alias("html"))


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: sizes and digests of its payload as read back, of its stored form, a feature, and the reference's
    position among the document's pieces with the caption that stayed aligned with it.

    No UTF-8 text holds a byte 255, so what was there before padding is known from the payload that is read back.
    """
    sequences = interleave(document_pages(docs, id_col, text_col))
    found = resolve(sequences, media_features(store(docs, text_col)))
    out = found.select(F.col("id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")
    return ids_back(out, "doc_id")
