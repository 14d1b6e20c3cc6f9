"""BPE encoding and decoding as a bounded-lookahead streaming transducer.

``sufficient_lookahead`` derives from the merge list how many symbols to the right of a token boundary can still change
it. The transducer keeps a buffer of about that length: it encodes the buffer, emits every token whose end lies that far
from the buffer's end, and drops what it has emitted, so memory is constant however long a text or a word is. A boundary
of a BPE encoding separates it into two independent encodings, which is why the rest can be encoded afresh.

``ByteTextMachine`` turns token ids back into text incrementally, one token at a time, over split UTF-8 sequences.

Edge cases: null and empty texts give no tokens; special tokens that occur literally in a text become their id; a text
without white space is streamed; rows repeat as they are given; other columns of the input take no part.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice, pairwise

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Words that a worker remembers, and characters of all that it remembers of them; beyond either the memory is emptied.
CACHE_WORDS, CACHE_CHARS = 200_000, 1 << 25
#: Characters of a text that are looked at together.
SLICE_CHARS = 1 << 18

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte: itself where it is printable, else the next free one from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in out:
            out[b] = chr(0x100 + len(out) - len(plain))
    return out


#: What str.split takes for white space and the tokenizer does not.
_SEPARATORS = re.compile("[\x1c-\x1f]")
BYTE_OF = {s: b for b, s in byte_symbols().items()}


class Merges:
    """A merge list: ranks of pairs of token ids, and the ids of symbols with and without the word-end suffix."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        self.vocab, self.suffix = vocab, suffix
        self.tokens = {i: t for t, i in vocab.items()}
        self.rules: list[tuple[int, int, int]] = []
        #: By left token: the ranks of its rules by right token. Tokens that begin no rule share one empty dictionary.
        self.rank: dict[int, dict[int, int]] = dict.fromkeys(self.tokens, {})
        for a, b in merges:
            x, y, joined = vocab.get(a), vocab.get(b), vocab.get(a + b)
            if x is not None and y is not None and joined is not None and y not in self.rank[x]:
                if not self.rank[x]:
                    self.rank[x] = {}
                self.rank[x][y] = len(self.rules)
                self.rules.append((x, y, joined))
        self.joined = [j for *_, j in self.rules]
        symbols = byte_symbols()
        self.inner = [vocab.get(symbols[b]) for b in range(256)]
        self.last = [vocab.get(symbols[b] + suffix) for b in range(256)]
        self.whole = None not in self.inner and None not in self.last
        self.width = {i: len(t.removesuffix(suffix)) if suffix else len(t) for t, i in vocab.items()}
        self.lookahead = sufficient_lookahead(self.rules, self.width)

    def encode(self, ids: list[int]) -> list[int]:
        """Canonical encoding of symbol ids: the leftmost pair of lowest rank merges first."""
        if len(ids) > 64:
            return self._encode_heap(ids)
        ids, rank, joined, none = ids[:], self.rank, self.joined, 1 << 60
        ranks = [rank[a].get(b, none) for a, b in pairwise(ids)]
        while ranks and (low := min(ranks)) != none:
            i = ranks.index(low)
            ids[i] = token = joined[low]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank[ids[i - 1]].get(token, none)
            if i < len(ranks):
                ranks[i] = rank[token].get(ids[i + 1], none)
        return ids

    def _encode_heap(self, ids: list[int]) -> list[int]:
        """The same, for a buffer so long that looking for the lowest rank each time would be slow."""
        n, rank, joined = len(ids), self.rank, self.joined
        ids, left, right, dead = ids[:], list(range(-1, n - 1)), list(range(1, n + 1)), [False] * n
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank[ids[i]].get(ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = right[i]
            if dead[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], dead[j] = joined[r], True
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y < n and (r := rank[ids[x]].get(ids[y])) is not None:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return [t for t, gone in zip(ids, dead) if not gone]


def sufficient_lookahead(rules: list[tuple[int, int, int]], width: dict[int, int]) -> int:
    """Symbols right of a boundary that can decide whether the boundary stays.

    Whether rule r = (u, v) applies depends on whether v is still there at its turn, hence on earlier rules whose left
    side ends v (v itself or a token on the right spine of its derivation). Going through the rules by rank, need(r) is
    the most such a rule adds: its right side's width plus what that rule needs itself. The chain's ranks fall, so one
    pass suffices. The bound is the most that any rule across a boundary reaches to the right.
    """
    spine: dict[int, frozenset[int]] = {}
    reach: dict[int, int] = {}
    most = 1
    for u, v, joined in rules:
        ends = spine.get(v, frozenset([v]))
        need = max((reach.get(x, 0) for x in ends), default=0)
        far = width[v] + need
        most = max(most, far)
        reach[u] = max(reach.get(u, 0), far)
        spine[joined] = spine.get(joined, frozenset([joined])) | ends
    return most


class Transducer:
    """Streams the bytes of one word after another: ``feed`` returns tokens once they are stable, ``finish`` the rest.

    Bytes come in pieces of any length; the buffer holds at most the lookahead, ``room`` twice and one token. ``taken``
    counts the bytes that have passed.
    """

    def __init__(self, merges: Merges, room: int = 256):
        self.merges, self.buffer, self.room, self.taken = merges, b"", room, 0
        self.most = merges.lookahead + 1 + room

    def feed(self, data: bytes) -> list[int]:
        self.taken += len(data)
        if len(self.buffer) + len(data) < self.most:
            self.buffer += data
            return []
        out: list[int] = []
        for at in range(0, len(data), self.room):
            self.buffer += data[at : at + self.room]
            if len(self.buffer) >= self.most:
                out += self._stable()
        return out

    def _stable(self) -> list[int]:
        """The buffer's last symbol may yet get the word-end suffix, so it counts as unseen."""
        m, at, out = self.merges, 0, []
        limit = len(self.buffer) - 1 - m.lookahead
        for token in m.encode([m.inner[b] for b in self.buffer]):
            if at + m.width[token] > limit:
                break
            at += m.width[token]
            out.append(token)
        self.buffer = self.buffer[at:]
        return out

    def finish(self) -> list[int]:
        if not (data := self.buffer):
            return []
        self.buffer = b""
        m = self.merges
        ids = [m.inner[b] for b in data]
        ids[-1] = m.last[data[-1]]
        return m.encode(ids)


class ByteTextMachine:
    """Incremental decoder. ``push`` takes one id and returns the text that is certain by then; ``end`` the remainder.

    In ``raw`` form tokens stand as the vocabulary writes them, one space between two, which is what a tokenizer file
    without a decoder means. Otherwise byte symbols become bytes, and an incremental UTF-8 automaton makes text of them;
    a word-end suffix becomes one space.
    """

    def __init__(self, tokens: dict[int, str], suffix: str = "", raw: bool = True):
        self.tokens, self.suffix, self.raw, self.begun = tokens, suffix, raw, False
        self.bytes_of = BYTE_OF
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, token: int) -> str:
        s = self.tokens.get(token)
        if s is None:
            return ""
        if self.raw:
            out = " " + s if self.begun else s
            self.begun = True
            return out
        tail = bool(self.suffix) and s.endswith(self.suffix)
        body = s[: len(s) - len(self.suffix)] if tail else s
        if any(c not in self.bytes_of for c in body):
            return self.utf8.decode(b"", True) + s
        return self.utf8.decode(bytes(self.bytes_of[c] for c in body)) + (" " if tail else "")

    def push_all(self, ids: list[int]) -> str:
        """What ``push`` returns for one id after another, joined."""
        if not self.raw:
            return "".join(map(self.push, ids))
        out = " ".join([s for i in ids if (s := self.tokens.get(i)) is not None])
        lead, self.begun = " " if self.begun and out else "", self.begun or bool(out)
        return lead + out

    def end(self) -> str:
        return "" if self.raw else self.utf8.decode(b"", True)


class WordBPE:
    """The tokenizer file's whole way: special tokens, NFC, lower case, splitting, merging.

    Every word goes through the transducer; words that it has encoded are remembered.
    """

    #: Fixed value: the file's split pattern.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    #: Fixed value: Unicode's White_Space.
    SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model = data["model"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merges = Merges(model["vocab"], pairs, model.get("end_of_word_suffix") or "")
        if not self.merges.whole:
            raise ValueError("the vocabulary is expected to hold all bytes")
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        if not all(t.startswith("<|") for t in self.special):
            raise ValueError("special tokens are expected to begin with <|")
        self.tokens = self.merges.tokens | {i: t for t, i in self.special.items()}
        self.find_special = re.compile("|".join(map(re.escape, self.special)) or "(?!)")
        self.pieces = regex.compile(self.PATTERN.replace(r"\s", self.SPACE))
        self.space = re.compile(f"[{self.SPACE}]+")
        self.machine = Transducer(self.merges)
        #: By word, and by stretch without white space: its ids in decimal, and what they decode to.
        self.word_ids: dict[str, str] = {}
        self.word_texts: dict[str, str] = {}
        #: Characters put into these four since they were last emptied together.
        self.remembered = 0
        self.ids: dict[str, str] = {}
        self.texts: dict[str, str] = {}

    def chunks(self, text: str) -> Iterator[list[str] | range]:
        """Lists of stretches without white space, of a bounded slice of the text; the range of a stretch beyond a slice."""
        at = 0
        while at < len(text):
            piece = text[at : at + SLICE_CHARS]
            words = [w for w in self.space.split(piece) if w] if _SEPARATORS.search(piece) else piece.split()
            end = at + len(piece)
            if end < len(text) and words and piece.endswith(words[-1]):  # it may go on
                end -= len(words.pop())
                if end == at:
                    found = self.space.search(text, at + len(piece))
                    end = found.start() if found else len(text)
                    yield range(at, end)
            if words:
                yield words
            at = end

    def pieces_of(self, chunk: str) -> list[str]:
        """The words of a short stretch without white space and special tokens."""
        chunk = lower(chunk if chunk.isascii() else unicodedata.normalize("NFC", chunk))
        if chunk.isalpha():
            return [chunk]
        if chunk[-1] in ".,;:!?" and chunk[:-1].isalpha():
            return [chunk[:-1], chunk[-1]]
        return self.pieces.findall(chunk)

    def word(self, word: str) -> list[int]:
        return self.machine.feed(word.encode()) + self.machine.finish()

    def _remember(self, chunk: str) -> None:
        """Strings alone are kept, as containers would cost the garbage collector time."""
        if "<|" in chunk and self.find_special.search(chunk):
            found = list(self.stream(chunk, range(len(chunk))))
            self.ids[chunk], self.texts[chunk] = " ".join(map(str, found)), self._decoded(found)
            return
        ids, texts, pieces = self.word_ids, self.word_texts, self.pieces_of(chunk)
        for word in pieces:
            if word not in ids:
                if len(ids) >= CACHE_WORDS // 2:
                    ids.clear()
                    texts.clear()
                    return self._remember(chunk)
                found = self.word(word)
                ids[word], texts[word] = " ".join(map(str, found)), self._decoded(found)
                self.remembered += len(word) + len(ids[word]) + len(texts[word])
        if len(pieces) == 1:
            self.ids[chunk], self.texts[chunk] = ids[pieces[0]], texts[pieces[0]]
        else:
            self.ids[chunk], self.texts[chunk] = " ".join(map(ids.__getitem__, pieces)), " ".join(map(texts.__getitem__, pieces))

    def _decoded(self, ids: list[int]) -> str:
        return ByteTextMachine(self.tokens).push_all(ids)

    def stream(self, text: str, where: range) -> Iterator[int]:
        """Token ids of a stretch of any length, in constant memory beside the text."""
        at = where.start
        for found in (*self.find_special.finditer(text, where.start, where.stop), None):
            yield from self._open(text, at, found.start() if found else where.stop)
            if found:
                yield self.special[found[0]]
                at = found.end()

    def _open(self, text: str, at: int, stop: int) -> Iterator[int]:
        """Slices are cut where no normal form spans the cut; a word that reaches a slice's end stays in the transducer."""
        held, running = "", None
        while at < stop:
            end = min(at + SLICE_CHARS, stop)
            while end < stop and (unicodedata.category(text[end])[0] == "M" or "\u1100" <= text[end] <= "\u11ff"):
                end += 1
            part, last = held + lower(unicodedata.normalize("NFC", text[at:end])), end == stop
            held, at = "", end
            if running:
                run = running.match(part)
                yield from self.machine.feed(run[0].encode())
                part = part[run.end() :]
                if not part and not last:
                    continue
                yield from self.machine.finish()
                running = None
            for word in self.pieces.finditer(part):
                i, j = word.span()
                if last or (j < len(part) and not (part[i] == "'" and i >= len(part) - 2)):
                    yield from self.word(word[0]) if j - i < SLICE_CHARS else self.machine.feed(word[0].encode()) + self.machine.finish()
                elif j - i > 2 and j == len(part) and (run := next((r for r in (self.letters, self.others) if r.fullmatch(part, i)), None)):
                    running = run
                    yield from self.machine.feed(word[0].encode())
                else:
                    held = part[i:]
                    break
        if held or running:
            yield from self.machine.finish()

    letters, others = regex.compile(r"\p{L}*"), regex.compile(rf"[^{SPACE}\p{{L}}\p{{N}}]*")

    def encode(self, text: str | None) -> Iterator[int]:
        text = text or ""
        for chunk in self.chunks(text):
            if isinstance(chunk, range):
                yield from self.stream(text, chunk)
            else:
                for c in chunk:
                    if "<|" in c:
                        yield from self.stream(c, range(len(c)))
                    else:
                        for word in self.pieces_of(c):
                            yield from self.word(word)

    def decode(self, ids: Iterable[int], raw: bool = True) -> Iterator[str]:
        machine = ByteTextMachine(self.tokens, self.merges.suffix, raw)
        yield from map(machine.push, ids)
        if not raw:
            yield machine.end()

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """Number of tokens, and SHA-256 of the ids and of what they decode to; texts of any length in constant memory."""
        text, count, ids_hash, text_hash, lead = text or "", 0, hashlib.sha256(), hashlib.sha256(), ""
        for chunk in self.chunks(text):
            for ids, words in self._described(text, chunk):
                count += ids.count(" ") + 1
                ids_hash.update((lead + ids).encode())
                text_hash.update((lead + words).encode())
                lead = " "
        return count, ids_hash.hexdigest(), text_hash.hexdigest()

    def _described(self, text: str, chunk: list[str] | range) -> Iterator[tuple[str, str]]:
        """Decimal ids and decoded text of a chunk; every stretch has a token, as the vocabulary holds all bytes."""
        if isinstance(chunk, range):
            stream = self.stream(text, chunk)
            while held := list(islice(stream, 4096)):
                yield " ".join(map(str, held)), self._decoded(held)
            return
        ids, texts = self.ids, self.texts
        if len(ids) >= CACHE_WORDS or self.remembered >= CACHE_CHARS:
            ids.clear()
            texts.clear()
        if self.remembered >= CACHE_CHARS:  # what has been forgotten since counts too, so it is never less than what is held
            self.word_ids.clear()
            self.word_texts.clear()
            self.remembered = 0
        for c in set(chunk).difference(ids):
            self._remember(c)
            self.remembered += len(c) + len(ids[c]) + len(texts[c])
        yield " ".join(map(ids.__getitem__, chunk)), " ".join(map(texts.__getitem__, chunk))


def lower(text: str) -> str:
    """Lower case character by character: a final sigma isn't told from another."""
    return text.replace("Σ", "σ").lower()


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBPE:
    return WordBPE(path)


def encode_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The operator's own result: id, ids array<int>, and decoded text, per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(tokenizer)
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = list(bpe.encode(text))
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([ids], pa.list_(pa.int32())), pa.array(["".join(bpe.decode(ids))])], ["doc_id", "ids", "decoded"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def bpe_digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, number of tokens, SHA-256 of the decimal ids and of the decoded text. One scan, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(tokenizer)
        for batch in batches:
            rows = [bpe.digest(t.as_py()) for t in batch.column(1)]
            n, ids, words = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(words, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, SCHEMA)
