"""Each training-data operator against a brute-force version, an exact round trip, or held-out accuracy."""

from __future__ import annotations

import hashlib
import io
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import op1_bpe, op2_frames, op3_warc, op4_suffix, op5_html, op6_language, op7_minhash, op8_quality, op9_decontaminate, op10_media
from rasterloom.llm.common import cut, fresh_path, table

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
ODD = [None, "", " ", "a", "ΑΣ x", 'It\'s "x"', "<|endoftext|>a <|startoftext|>", "x" * 3000, "the" * 700, "a\n \nb  c\t", "\x1c\x85é ́", "😀 İ१२"]


def docs_of(spark, texts, extra=False):
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({"digest": F.lit("clash"), "path": F.lit(1), "id": F.lit(2.0), "component": F.lit(None).cast("int")}) if extra else df


def library(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    return t


def noise(seed, n, letters, length):
    r = random.Random(seed)
    return ["".join(r.choice(letters) for _ in range(r.randint(0, length))) for _ in range(n)]


@pytest.mark.parametrize("run", [lambda d: op1_bpe.bpe_digests(d, WORD), lambda d: op2_frames.token_files(d, BYTE), op4_suffix.suffix_dedup, op7_minhash.near_duplicates, op10_media.media_columns, lambda d: op9_decontaminate.decontamination(d, d.selectExpr("doc_id AS item_id", "text")), lambda d: op3_warc.warc_round_trip(d.selectExpr("doc_id AS page_id", "text AS url", "text AS html"))])
def test_rows_without_an_id_take_part(spark, run):
    df = spark.createDataFrame([(None, "one two three four five six " * 5), (None, None), (3, "one two three four five six " * 5), (3, "one two three four five six " * 5)], "doc_id long, text string")
    rows = run(df).collect()
    assert sorted(str(r[0]) for r in rows) == ["3", "3", "None", "None"]


# ---- 1 ----


def test_encoding_and_decoding_equal_the_library():
    bpe, lib = op1_bpe.word_bpe(WORD), library(WORD)
    for t in [*filter(None, ODD), *noise(1, 300, "abehinorst'é1<|> \n\t", 150), *noise(2, 10, "aehint", 2500)]:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert list(bpe.encode(t)) == ids
        text = lib.decode(ids, skip_special_tokens=False)
        assert "".join(bpe.decode(ids)) == text
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert bpe.digest(t) == (len(ids), sha(" ".join(map(str, ids))), sha(text))


def brute_merges(m, word):
    """The merge list applied rule by rule, each from left to right."""
    ids = [m.inner[b] for b in word[:-1]] + [m.last[b] for b in word[-1:]]
    for a, b, joined in m.rules:
        i = 0
        while i < len(ids) - 1:
            if (ids[i], ids[i + 1]) == (a, b):
                ids[i : i + 2] = [joined]
            i += 1
    return ids


@pytest.mark.parametrize("room", [1, 7, 256])
def test_transducer_emits_only_stable_tokens_in_bounded_memory(room):
    m = op1_bpe.word_bpe(WORD).merges
    for word in noise(3, 6, "aehinst", 4000):
        machine, out, most = op1_bpe.Transducer(m, room), [], 0
        for i in range(0, len(word), 50):
            out += machine.feed(word[i : i + 50].encode())
            most = max(most, len(machine.buffer))
        assert most <= m.lookahead + 1 + max(room, 50) + max(m.width.values())  # one token may wait whole
        assert out + machine.finish() == m._encode_heap([*(m.inner[b] for b in word[:-1].encode()), *(m.last[b] for b in word[-1:].encode())])
        assert machine.taken == len(word)
    for word in [w for w in noise(4, 4, "aehinst", 90) if w]:
        machine = op1_bpe.Transducer(m, room)
        assert machine.feed(word.encode()) + machine.finish() == brute_merges(m, word.encode())


def test_every_word_passes_the_transducer():
    bpe = op1_bpe.WordBPE(WORD)
    words = {w for w in noise(5, 300, "aehinstré", 40) if w} | {"x" * 5000}
    bpe.digest(" ".join(words))
    assert bpe.machine.taken == sum(len(w.encode()) for w in {op1_bpe.lower(op1_bpe.unicodedata.normalize("NFC", w)) for w in words})


@pytest.mark.parametrize("size", [1, 2, 3, 7, 40])
def test_stretches_beyond_a_slice_are_encoded_piece_by_piece(size, monkeypatch):
    """No normal form, word, contraction or special token is cut where a slice ends."""
    monkeypatch.setattr(op1_bpe, "SLICE_CHARS", size)
    bpe, lib = op1_bpe.WordBPE(WORD), library(WORD)
    texts = ["it's'll're!!'s", "e\u0301e\u0301\u0327x", "ab<|endoftext|>'s<|startoftext|>1", "\u1112\u1161\u11abx", "x" * 300, "12!?'re''s" * 9, "a b\x1cc"]
    for t in [*texts, *noise(6, 150, "abs'tre1!\u0301é<|>", 60), *noise(7, 60, "ab s'tr e1!\u0301é\n", 60)]:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert list(bpe.encode(t)) == ids, t
        assert bpe.digest(t)[1] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_incremental_text_of_split_characters():
    symbols = op1_bpe.byte_symbols()
    tokens = {i: symbols[b] for i, b in enumerate("é😀".encode())}
    machine = op1_bpe.ByteTextMachine(tokens, raw=False)
    assert [machine.push(i) for i in range(6)] == ["", "é", "", "", "", "😀"] and machine.end() == ""


def test_bpe_rows(spark):
    rows = {r.doc_id: r for r in op1_bpe.bpe_digests(docs_of(spark, ODD, True), WORD).collect()}
    assert len(rows) == len(ODD) and rows[0].n_tokens == rows[1].n_tokens == 0
    assert op1_bpe.bpe_digests(docs_of(spark, []), WORD).count() == 0
    assert op1_bpe.encode_documents(docs_of(spark, ["the cat"]), WORD).first().decoded == "the</w> cat</w>"


# ---- 2 ----


def test_token_files_round_trip(spark):
    texts = [*ODD, *noise(4, 60, "ab é1.!\n\t  'sxyz", 90)]
    lib, start, want = library(BYTE), 0, []
    for i, t in enumerate(texts):
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    docs = docs_of(spark, texts, True)
    manifest = op2_frames.write_frames(docs, BYTE, fresh_path(spark, "t"))
    assert sorted(tuple(r) for r in op2_frames.read_frames(manifest).collect()) == want
    path = manifest.where("n_docs > 1").first()
    got = op2_frames.read_documents(path.path, [path.first_doc, 10**9])
    assert len(got) == 1 and len(got[path.first_doc]) == want[path.first_doc][2]
    assert op2_frames.token_files(docs_of(spark, []), BYTE).count() == 0


def test_reader_opens_only_the_frames_asked_for_and_sees_damage():
    out = io.BytesIO()
    w = op2_frames.FrameWriter(out)
    for i in range(40):
        w.add(i, np.full(50_000, i, "<u2").tobytes())
    w.close()
    r = op2_frames.FrameReader(out)
    assert (r.ids(17) == 17).all() and r.opened <= 2 < len(r.frames)
    data = bytearray(out.getvalue())
    data[int(r.at[3]) + 12] ^= 255
    with pytest.raises(Exception):
        broken = op2_frames.FrameReader(io.BytesIO(bytes(data)))
        [broken.ids(i) for i in range(40)]


# ---- 3 ----


def test_archives(spark):
    pages = [(i, "http://x/%d\r\n" % (i % 5), (None, "", "short", "<p>" + "same " * 40, "<p>%d %s" % (i, "y" * 200))[i % 5]) for i in range(60)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit(0))
    first: dict = {}
    want = []
    for i, _, h in pages:
        b = (h or "").encode()
        ref = first.setdefault(b, i)
        again = len(b) >= 100 and ref < i
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", ref if again else None))
    assert sorted(tuple(r) for r in op3_warc.warc_round_trip(df).collect()) == want
    assert op3_warc.warc_round_trip(df.limit(0)).count() == 0


def test_archive_has_a_dictionary_and_detects_truncation():
    out = io.BytesIO()
    w = op3_warc.WarcWriter(out)
    records = [op3_warc.record(i, "u", (f"<html><body>{'words and more ' * 9}{i}" * 3).encode(), "0", None) for i in range(200)]
    for r in records:
        w.add(r)
    w.close()
    data = out.getvalue()
    assert int.from_bytes(data[:4], "little") == op3_warc.DICTIONARY_FRAME and len(data) < sum(map(len, records)) / 4
    assert sum(1 for _ in op3_warc.read_records(io.BytesIO(data))) == 200
    with pytest.raises(Exception):
        list(op3_warc.read_records(io.BytesIO(data[:-3])))


def test_every_archive_has_a_dictionary_however_small_its_partition(spark, tmp_path):
    def frames(rows, parts, name):
        df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)
        files = [r.path for r in op3_warc.archive(df, f"file://{tmp_path}/{name}").collect()]
        assert {r.page_id for r in op3_warc.read_archives(spark.createDataFrame([(f,) for f in files], "path string")).collect()} == {r[0] for r in rows}
        return [open(f.removeprefix("file://"), "rb").read(4) for f in files]

    mark = op3_warc.DICTIONARY_FRAME.to_bytes(4, "little")
    pages = [(i, f"http://x/{i}", f"<html><body><p>{'plain words and more ' * 20}{i * 7919}</p></body></html>") for i in range(250)]
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        many = frames(pages, 64, "many")
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert len(many) > 8 and set(many) == {mark}
    assert set(frames([(1, "u", ""), (2, None, None)], 2, "few")) == {mark}  # nothing to train on
    spread = op3_warc.common_dictionary(spark.createDataFrame(pages, "page_id long, url string, html string").select("page_id", "url", F.col("html").cast("binary").alias("payload")))
    assert 0 < len(spread) <= op3_warc.DICTIONARY_BYTES


# ---- 4 ----


@pytest.mark.parametrize("seed", range(4))
def test_bucket_pointers_sort_suffixes(seed):
    r = random.Random(seed)
    for _ in range(40):
        b = bytes(r.choice(b"ab\0") for _ in range(r.randint(1, 70)))
        assert op4_suffix.suffix_array(b).tolist() == sorted(range(len(b)), key=lambda i: b[i:])
        depth = r.randint(1, 40)
        order, pointer = op4_suffix.bucket_pointers(np.frombuffer(b, np.uint8), depth)
        cuts = [b[i : i + depth] for i in range(len(b))]
        assert [cuts[i] for i in order] == sorted(cuts)
        assert all((pointer[i] == pointer[j]) == (cuts[i] == cuts[j]) for i in range(len(b)) for j in range(i))


def brute_spans(rows, length=50):
    texts = [(i, (t or "").encode()) for i, t in rows]
    least: dict = {}
    for i, b in texts:
        for p in range(len(b) - length + 1):
            k = b[p : p + length]
            least[k] = min(least.get(k, i), i)
    out = []
    for i, b in texts:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if least[b[p : p + length]] < i:
                gone[p : p + length] = True
        runs = int(np.count_nonzero(np.diff(gone.astype(int), prepend=0) == 1))
        out.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot", [op4_suffix.HOT, 1, 0])
def test_suffix_dedup_equals_brute_force(spark, hot):
    r = random.Random(9)
    base = noise(10, 6, "abcé \n", 600)
    texts = [None if k == 7 else "".join(r.choice(base)[r.randint(0, 250) :][: r.randint(10, 140)] for _ in range(r.randint(0, 6))) for k in range(80)] + ["a" * 400, "b" + "a" * 90, "x" * 49, "x" * 49, ""]
    got = op4_suffix.suffix_dedup(docs_of(spark, texts, True), hot=hot).collect()
    assert sorted(tuple(x) for x in got) == brute_spans(enumerate(texts))


def test_long_texts_cross_blocks():
    text = bytes(np.random.default_rng(0).integers(97, 101, 3 * op4_suffix.BLOCK // 2, dtype=np.uint8))
    s = op4_suffix.Stretches([text, b"", text[1000:1100]])
    inside = np.zeros(len(text), bool)
    for a, b in zip(s.start[s.doc == 0], s.end[s.doc == 0]):
        inside[a : b - 49] = True
    assert inside[: len(text) - 49].all() and (s.doc == 2).any() and not (s.doc == 1).any()


def test_contents_of_one_gram_are_told_apart_by_64_bits(spark):
    pair = ["mzgiugmphsysuywnwutqteyritzmhuhbwgcgggnlcszokzazsc", "qgqqfifdvzpuqxpwzutqteyritzmhuhbwwuyhuwgotpyqlmpfa"]  # one q-gram, 32 equal bits
    s = op4_suffix.Stretches([t.encode() for t in pair])
    assert s.gram[0] == s.gram[1] and len(set((s.content.astype(np.uint64) >> np.uint64(32)).tolist())) == 1
    got = op4_suffix.suffix_dedup(docs_of(spark, pair)).collect()
    assert sorted(tuple(x) for x in got) == brute_spans(enumerate(pair))


def test_repeats_leave_texts_valid(spark):
    p = "ééééé" * 12
    docs = spark.createDataFrame([(1, "a" + p, 9), (2, "b" + p + "c", 9), (3, None, None)], "doc_id long, text string, n_chars long")
    rows = {r.doc_id: r for r in op4_suffix.without_repeats(docs).collect()}
    assert rows[1].text == "a" + p and rows[2].text == "bc" and rows[2].n_chars == 2 and rows[3].text is None


# ---- 5 ----

PAGE = """<html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body><header><p>Site name, slogan.</p></header>
<nav><ul><li><a href=1>Home</a><li><a href=2>More</a></ul></nav><div class="cookie-notice">We use cookies, please agree.</div><aside class=sidebar><p>Related things, many of them.</p></aside>
%s<form><label>Name</label></form><div id="comments"><p>First! I disagree, strongly.</p></div><footer>&copy; x</footer></body></html>"""


@pytest.mark.parametrize("wrap", ["<article>%s</article>", '<div class="post">%s</div>', "<main>%s</main>"])
def test_main_text(wrap):
    body = "<h1>Head line</h1><p>One &amp; two,\n three <b>bold</b>ly.<br>Next line, here.<p>Second paragraph, of some length, with marks.<div class='ad'>Buy now, cheap!</div><p>Third paragraph ends here."
    want = "Head line One & two, three boldly. Next line, here. Second paragraph, of some length, with marks. Third paragraph ends here."
    assert op5_html.main_text(PAGE % (wrap % body)) == want


def test_paths_part_boilerplate_without_listed_words():
    text = "It rained all day, and the river rose, slowly at first; by night it had reached the mill. Nobody slept."
    menu = "<div class=q1>" + "".join(f"<div>{w}</div>" for w in "Start Shop Team Jobs Places Prices".split()) + "</div>"
    page = f"<html><body>{menu}<div class=q2>Call us any day.</div><div class=z><h1>The flood</h1>{f'<p>{text}</p>' * 4}<h2>After</h2><p>{text}</p></div>{menu}<div class=q4>All rights held</div></body></html>"
    assert op5_html.main_text(page) == " ".join(["The flood", *[text] * 4, "After", text])
    assert op5_html.main_text(f"<body><div>{text}</div><p>Short one.</p><p>Short two.</p></body>") == f"{text} Short one. Short two."


def brute_scores(page):
    """The fused score of every block, from its definition."""
    import math
    from statistics import fmean, pstdev

    found = op5_html.blocks(page)
    paths = [b.path for b in found]
    length = [max(len(b.text) - b.linked, 0) for b in found]
    marks = [sum(b.text.count(c) for c in ".,;:!?…。，；：！？、") for b in found]
    own = []
    for p in paths:
        n, m = ([v for v, q in zip(values, paths) if q == p] for values in (length, marks))
        own.append(math.log(1 + fmean(n) * (1 + fmean(m))) + 0.5 * math.log(1 + pstdev(n) * (1 + pstdev(m))))
    smooth = []
    for i in range(len(own)):
        near = [(math.exp(-((i - j) ** 2) / 2), own[j]) for j in range(len(own)) if abs(i - j) <= 3]
        smooth.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
    return [fmean([v for v, q in zip(smooth, paths) if q == p]) for p in paths], length


def test_scores_equal_brute_force_and_select_on_supplied_pages(spark, sf):
    pages = [r.html for r in table(spark, sf, "pages").where("html IS NOT NULL").collect()]
    reasons: dict = {}
    for page in pages[:40]:
        want, weight = brute_scores(page)
        got = op5_html.fused(op5_html.blocks(page))
        assert np.allclose(got, want)
        values = sorted(set(want))
        split = max(values[1:], key=lambda t: sum(v < t for v in want) * sum(v >= t for v in want) * (np.mean([v for v in want if v >= t]) - np.mean([v for v in want if v < t])) ** 2, default=None)
        limit = op5_html.threshold(got, weight)
        assert limit == 0 or abs(limit - split) < 1e-9
        for b, reason in op5_html.judged(page):
            reasons[reason] = reasons.get(reason, 0) + 1
    assert reasons["score"] > 3 * reasons.get("marks", 0) > 0  # the score alone drops most of what goes


RAIN = "It rained all day, and the river rose, slowly at first; by night it had reached the mill. Nobody slept."


@pytest.mark.parametrize("extra", [
    "<ul><li>Milk</li><li>Eggs</li><li>Bread</li></ul>", "<h2>Shopping</h2><ul><li>Milk</li></ul>", "<dl><dt>Age</dt><dd>4</dd></dl>",
    "<p><a href=x>The whole story, told elsewhere.</a></p>", "<table><tr><td>1</td><td>2</td></tr></table>", "<h2>Last</h2>",
])
@pytest.mark.parametrize("wrap", ["<article>%s</article>", "<div class=post>%s</div>"])
def test_short_blocks_of_the_article_are_not_lost(extra, wrap):
    import html
    import re

    page = f"<html><body><nav><a href=1>Home</a></nav>{wrap % (f'<p>{RAIN * 3}</p>' * 6 + extra)}<footer>&copy; x</footer></body></html>"
    words = " ".join(html.unescape(re.sub("<[^>]+>", " ", extra)).split())
    kept = " ".join([RAIN * 3] * 6 + ([words] if wrap.startswith("<article") or "href" not in extra else []))
    assert op5_html.main_text(page) == kept


def test_a_form_around_the_page_is_a_frame_and_a_form_in_it_is_not():
    body = f"<p>{RAIN * 2}</p>" * 3
    page = f"<html><body><form id=aspnetForm><div class=z>{body}</div><form class=mail><p>Your name, please.</p></form></form></body></html>"
    assert op5_html.main_text(page).startswith(RAIN) and op5_html.main_text(f"<body>{body}<form><p>Your name, please.</p></form></body>") == " ".join([RAIN * 2] * 3)


def test_links_around_blocks_count_as_links():
    page = f"<html><body><div class=z>{f'<p>{RAIN * 2}</p>' * 4}</div><div class=t><a href=x><h2>Another story</h2><p>{RAIN}</p></a></div></body></html>"
    assert op5_html.main_text(page) == " ".join([RAIN * 2] * 4)
    assert op5_html.main_text(f"<body><div><p><a href=x>never closed<p>{RAIN}<p>{RAIN}</div></body>").endswith(f"{RAIN} {RAIN}")


def test_extraction_of_repeated_and_clashing_rows(spark):
    df = spark.createDataFrame([(1, "u", "<p>a, b.</p>", "x")] * 2 + [(None, None, None, "x"), (2, "u", "", "x"), (3, "u", "<p>" + "long text, " * 40_000, "x")], "page_id long, url string, html string, text string")
    rows = op5_html.extract(df).collect()
    assert sorted(r.n_chars for r in rows) == [0, 0, 5, 5, 439_999]
    assert op5_html.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["layout has-sidebar", "no-sidebar", "post comments-open", "nav-open", "header-fixed", "sidebar"])
def test_wrappers_with_listed_words_keep_the_article(kind):
    text = "It rained all day, and the river rose, slowly at first; by night it had reached the mill."
    body = f"<div class='entry-header'><h1>The flood</h1></div>{f'<p>{text}</p>' * 3}<div class='cookie-notice'>We use cookies.</div><div class=comments><p>{text}</p></div>"
    want = " ".join(["The flood", *[text] * 3])
    assert op5_html.main_text(f"<div class='{kind}'>{body}</div>") == want
    assert op5_html.main_text(f"<div id='{kind}'><article>{body}</article></div>") == want


def test_pages_of_any_kind(spark):
    pages = [(1, "u", None), (2, None, ""), (3, "u", "<div>"), (4, "u", "plain <b"), (5, "u", "<p>" * 3000 + "deep, text."), (6, "u", "<nav><p>only menus</p></nav>")]
    rows = {r.page_id: r for r in op5_html.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert [rows[i].text for i in (1, 2, 3, 6)] == ["", "", "", ""] and rows[5].text == "deep, text." and rows[5].n_chars == 11


# ---- 6 ----


def test_language_accuracy_on_held_out_rows(spark, sf):
    docs = table(spark, sf, "documents")
    rows = op6_language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_unlearned_languages_and_random_strings_go_and_short_rows_stay(spark):
    r = random.Random(4)
    strange = [" ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(k)) for k in (8, 20, 20, 150, 150)]
    strange += ["Tämä on suomenkielinen lause, jota malli ei ole nähnyt koskaan aikaisemmin.", "Это предложение на русском языке, которое модель никогда раньше не видела.", "To zdanie jest po polsku i model nigdy wcześniej go nie widział."]
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(-1 - i, t, None) for i, t in enumerate(strange)], docs.schema)
    short = docs.where(op6_language.held_out(F.col("doc_id"))).select((-1000 - F.col("doc_id")).alias("doc_id"), F.substring("text", 1, 40).alias("text"), F.lit(None).cast("string").alias("lang"))
    rows = op6_language.identify(docs.unionByName(odd).unionByName(short)).collect()
    assert all(x.rejected for x in rows if -1000 < x.doc_id < 0)
    for own in ([x for x in rows if x.doc_id >= 0 and x.held_out], [x for x in rows if x.doc_id <= -1000]):
        assert len(own) > 200 and sum(x.rejected for x in own) <= 0.05 * len(own)


def test_language_of_nothing(spark):
    rows = [(1, "the and of it", "en"), (2, None, "en"), (3, "12 .. !", "en"), (4, "la que de los", None), (None, "the and", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in op6_language.identify(df).collect()}
    assert got[2].lang_pred == got[3].lang_pred == "und" and got[2].score == 0 and got[3].rejected
    assert op6_language.identify(df.limit(0)).count() == 0
    assert {r.lang_pred for r in op6_language.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


# ---- 7 ----


def brute_components(rows, width, share):
    sets = {}
    for i, t in rows:
        w = [x for x in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").replace("\n", " ").split(" ") if x]
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    root = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= share * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = {k: min(a, b) if v in (a, b) else v for k, v in root.items()}
    return sorted((i, len(sets[i]), root[i], root[i] == i) for i in sets)


def test_near_duplicates_equal_brute_force(spark):
    r = random.Random(11)
    words = [f"W{k}" for k in range(400)]
    base = [[r.choice(words) for _ in range(r.randint(30, 120))] for _ in range(8)]
    texts = [None, "", "one two", "one two", "One  two\n"]
    for _ in range(110):
        t = r.choice(base)[:]
        for _ in range(r.randint(0, 5)):
            t[r.randrange(len(t))] = r.choice(words)
        texts.append(" ".join(t))
    got = op7_minhash.near_duplicates(docs_of(spark, texts, True), width=4, share=80).collect()
    assert sorted(tuple(x) for x in got) == brute_components(enumerate(texts), 4, 80)
    assert op7_minhash.near_duplicates(docs_of(spark, [])).count() == 0


def test_rows_of_one_id_keep_their_own_links(spark):
    a, b = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    for rows in ([(5, a), (5, b), (7, a + " x"), (8, b + " y")], [(5, b), (5, a), (8, b + " y"), (7, a + " x")]):
        got = op7_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted((r.doc_id, r.component_id) for r in got) == [(5, 5), (5, 5), (7, 5), (8, 5)]


def test_long_words_are_told_apart():
    """Thue-Morse words collide under any polynomial hash modulo 2**64."""
    word = b"a"
    while len(word) < 4096:
        word += word.translate(bytes.maketrans(b"ab", b"ba"))
    other = word.translate(bytes.maketrans(b"ab", b"ba"))
    tail = b" one two three four five"
    x, y = op7_minhash.shingle_sets([word + tail, other + tail], 5)
    assert len(np.intersect1d(x, y)) == 1
    codes, _ = op9_decontaminate.words_of([word, other])
    assert codes[0] != codes[1]


def test_keep_one_keeps_a_row_of_each_component(spark):
    a, c = " ".join(f"a{k}" for k in range(60)), " ".join(f"c{k}" for k in range(9))
    rows = [(1, a, 0), (1, a, 1), (None, a, 2), (None, a, 3), (2, a + " x", 4), (None, None, 5), (None, "", 6), (9, "", 7), (3, c, 8), (3, a.upper(), 9), (4, c, 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _k int").withColumn("_i", F.lit(1))
    got = op7_minhash.keep_one(docs)
    kept = sorted(r._k for r in got.collect())
    assert got.columns == docs.columns and kept in ([2, 5, 6, 7, 8], [3, 5, 6, 7, 8])
    assert op7_minhash.keep_one(docs.limit(0)).count() == 0


def test_pruning_bound_is_the_binomial_tail():
    from math import comb

    for n, m in op7_minhash.least_matches(80):
        tail = lambda k: sum(comb(n + 1, i) * 0.8**i * 0.2 ** (n + 1 - i) for i in range(k + 1))
        assert tail(m) >= op7_minhash.MISS and (m == 0 or tail(m - 1) < op7_minhash.MISS)


def test_cells_link_across_blocks():
    import pyarrow as pa

    sets = [np.arange(k, k + 100, dtype=np.uint64) for k in (0, 5, 10, 1000)]
    t = pa.table({"id": [1, 2, 3, 4], "comp": [1, 2, 3, 4], "block": [0, 0, 1, 1], "sig": [op7_minhash.signature(s).tobytes() for s in sets], "codes": [s.tobytes() for s in sets]})
    assert sorted(op7_minhash.cell_links(t, 80)) == [(3, 1), (3, 2)]  # pairs within a block are another cell's


# ---- 8 ----


def test_quality_and_toxicity(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    rows = op8_quality.classify(docs, labels).join(labels.withColumnRenamed("toxic", "labelled"), "doc_id").collect()
    assert sum(r.keep == bool(r.quality) for r in rows) >= 0.9 * len(rows)
    assert sum(r.toxic == bool(r.labelled) for r in rows) >= 0.95 * len(rows)


def test_toxicity_follows_labels_in_any_language_and_no_list(spark):
    r = random.Random(8)
    words = noise(9, 400, "abcdefghinorst", 8)
    rows = [" ".join(r.choices(words, k=120) + (["réêou", "achlich"][i % 2 :][:1] if i % 8 < 2 else [])) for i in range(400)]
    extra = ["stupid trash " + " ".join(r.choices(words, k=400)), "one réêou " + " ".join(r.choices(words, k=100)), "my achlich " + " ".join(r.choices(words, k=100))]
    labels = spark.createDataFrame([(i, int(i % 8 < 2)) for i in range(400)], "doc_id long, toxic int")
    docs = docs_of(spark, rows + extra)
    got = {x.doc_id: x for x in op8_quality.classify(docs, labels).where("doc_id >= 400").collect()}
    assert [got[i].toxic for i in (400, 401, 402)] == [False, True, True]
    assert {(x.toxic_score, x.toxic) for x in op8_quality.classify(docs).collect()} == {(None, None)}


def test_expectation_maximisation_recovers_accuracies():
    rng = np.random.default_rng(0)
    truth = rng.random(20000) < 0.7
    right = [0.95, 0.8, 0.7]
    votes = ["".join("10"[int((rng.random() < a) != t)] for a in right) for t in truth]
    counts: dict = {}
    for v in votes:
        counts[v] = counts.get(v, 0) + 1
    posterior, tables = op8_quality.em(counts)
    assert posterior["111"] > 0.95 > 0.1 > posterior["000"]
    assert np.allclose([t[1][1] for t in tables], right, atol=0.06)


def test_quality_of_nothing(spark):
    assert op8_quality.classify(docs_of(spark, [])).count() == 0
    assert op8_quality.classify(docs_of(spark, ODD, True)).count() == len(ODD)


# ---- 9 ----


@pytest.mark.parametrize("block", [op9_decontaminate.BLOCK_BYTES, 200])
def test_decontamination_equals_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(op9_decontaminate, "BLOCK_BYTES", block)
    import re

    r = random.Random(12)
    words = [f"w{k}" for k in range(12)]
    items = [(k, " ".join(r.choice(words) for _ in range(n))) for k, n in enumerate([20, 20, 5, 13, 1, 30])] + [(50, None), (51, "..."), (52, "W1 w2, w3")]
    items[4] = (4, "rare")
    texts = [None, "", "!!!", "rare"] + [" ".join(r.choice(words) for _ in range(60)) + " " + r.choice(items[:6])[1].upper() if k % 2 else " ".join(r.choice(words) for _ in range(r.randint(1, 30))) for k in range(40)]
    low = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    want = []
    for i, t in enumerate(texts):
        w, hit, found, far = low(t), set(), set(), (0, None)
        for k, it in items:
            b = low(it)
            n = min(13, len(b))
            for p in range(len(b) - n + 1) if n else ():
                for q in range(len(w) - n + 1):
                    if w[q : q + n] == b[p : p + n]:
                        hit.update(range(q, q + n))
                        found.add(str(k))
                        m = n
                        while n == 13 and q + m < len(w) and p + m < len(b) and w[q + m] == b[p + m]:
                            m += 1
                        far = max(far, (m, q), key=lambda f: (f[0], -(f[1] or 0)))
        want.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w), *far))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = op9_decontaminate.decontamination(docs_of(spark, texts, True), bench).collect()
    assert sorted(tuple(x) for x in got) == want


@pytest.mark.parametrize("block", [op9_decontaminate.BLOCK_BYTES, 200])
def test_decontamination_judges_rows_by_their_texts(spark, block, monkeypatch):
    monkeypatch.setattr(op9_decontaminate, "BLOCK_BYTES", block)
    w = [f"w{k}" for k in range(40)]
    bad, good = " ".join(w[3:25]), "nothing of the kind " * 30
    rows = [(None, bad, 1), (None, good, 2), (5, bad, 3), (5, good, 4), (6, None, 5), (7, "", 6), (5, good, 4), (8, good * 300, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _key int")
    bench = spark.createDataFrame([(1, " ".join(w)), (2, "other words " * 12)], "item_id long, text string")
    got = op9_decontaminate.decontaminate(docs, bench)
    assert got.columns == docs.columns and sorted(r._key for r in got.collect()) == [2, 4, 4, 5, 6, 7]
    assert op9_decontaminate.decontaminate(docs.limit(0), bench).count() == 0
    assert op9_decontaminate.decontaminate(docs, bench.limit(0)).count() == len(rows)


def test_longest_matches(spark):
    w = [f"w{k}" for k in range(40)]
    docs, bench = docs_of(spark, ["x " + " ".join(w[5:30]) + " y"]), spark.createDataFrame([(7, " ".join(w))], "item_id long, text string")
    assert [tuple(r) for r in op9_decontaminate.longest_matches(docs, bench).collect()] == [(0, 1, 7, 5, 25)]


# ---- 10 ----


def test_media_round_trip(spark):
    texts = [*ODD, "same", "same", "y" * 576, "z" * 577]
    rows = {r.doc_id: r for r in op10_media.media_columns(docs_of(spark, texts, True)).collect()}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        p = b + b"\xff" * (576 * max(1, -(-len(b) // 576)) - len(b))
        assert (rows[i].n_bytes, rows[i].payload_bytes, rows[i].payload_sha256, rows[i].tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        png = op10_media.png_of(p)
        assert (rows[i].media_bytes, rows[i].media_sha256, rows[i].feature) == (len(png), hashlib.sha256(png).hexdigest(), brute_feature(p))
        lines = [" ".join(x.split()) for x in (t or "").split("\n")]
        assert rows[i].caption == f"{len(b)} bytes" and rows[i].position == 1 + bool(lines[0])
    n = len(ODD)
    assert rows[n][1:] == rows[n + 1][1:]
    assert op10_media.media_columns(docs_of(spark, [])).count() == 0


def brute_feature(payload):
    """Mean of the samples in sixths of the rows and quarters of the columns; earlier parts are longer by one where it doesn't divide."""
    lines = [payload[k : k + 24] for k in range(0, len(payload), 24)]
    size, over = divmod(len(lines), 6)
    out, at = [], 0
    for k in range(6):
        part = b"".join(lines[at : at + size + (k < over)])
        at += size + (k < over)
        out.append(sum(part) // len(part) if part else 0)
    for k in range(4):
        part = [v for line in lines for v in line[6 * k : 6 * k + 6]]
        out.append(sum(part) // len(part))
    return "".join(f"{v:02x}" for v in out)


def test_pieces_keep_order_and_captions():
    d = "0" * 64
    page = f'<h1>A</h1><p>one<figure><img src="digest:{d}" alt="x"><figcaption>cap <i>tion</i></figcaption></figure><p>two <img src="digest:{d}" alt="alt">three'
    got = [(p["position"], p["kind"], p["text"], p["caption"]) for p in op10_media.pieces_of(page)]
    assert got == [(0, "text", "A", None), (1, "text", "one", None), (2, "media", None, "cap tion"), (3, "text", "two", None), (4, "media", None, "alt"), (5, "text", "three", None)]


def test_missing_payloads_resolve_to_nulls(spark):
    pages = spark.createDataFrame([(1, f'<img src="digest:{"1" * 64}">'), (2, None)], "page_id long, html string")
    media = spark.createDataFrame([], op10_media.FEATURES)
    rows = op10_media.resolve(op10_media.interleave(pages), media).collect()
    assert len(rows) == 1 and rows[0].media_bytes is None


# ---- pipeline ----


def test_pipeline_stages_keep_columns_and_decide(spark, sf):
    import corpus_pipeline

    docs = table(spark, sf, "documents")
    columns = docs.columns
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut(stage(spark, docs, sf), name)
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] < counts[0]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == counts[-1]


def brute_cut(rows):
    """Texts without the bytes that 50-byte strings of documents of smaller id cover; whole characters alone go."""
    out = []
    first: dict = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            first[b[p : p + 50]] = min(i, first.get(b[p : p + 50], i))
    for i, t in rows:
        b, gone = (t or "").encode(), set()
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone.update(range(p, p + 50))
        kept, at = "", 0
        for c in t or "":
            n = len(c.encode())
            kept += "" if all(k in gone for k in range(at, at + n)) else c
            at += n
        out.append(None if t is None else kept)
    return out


def test_pipeline_stages_equal_brute_force_on_odd_rows(spark, tmp_path):
    """Nulls, repeated rows and ids, empty and long texts, and columns with the names that stages use inside."""
    import corpus_pipeline

    r = random.Random(20)
    words = noise(21, 300, "abcdefghinorstuvwy", 7)
    prose = lambda n: " ".join(r.choices([w for w in words if w], k=n))
    passage, item = prose(40), prose(30)
    texts = [prose(80) for _ in range(60)]
    texts += [texts[0], texts[1] + " more", passage + " " + prose(90), prose(60) + " " + passage, item, prose(30) + " " + item, None, "", "12 .. !", "é" * 70 + prose(20), prose(30) + "é" * 70, prose(3000)]
    rows = [(None if i % 17 == 3 else i, t, "en", i) for i, t in enumerate(texts)] + [(5, texts[5], "en", 100), (5, prose(50), "en", 101)]
    names = ["_own", "_digest", "_kept", "_key", "_gone", "_i", "id", "digest", "path"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, row int").withColumns({n: F.lit("x") for n in names}).withColumn("n_chars", F.length("text"))
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    run = lambda name, d: [x.asDict() for x in cut(stages[name](spark, d, str(tmp_path)), name).orderBy("row").collect()]
    back = lambda got: spark.createDataFrame([tuple(x[c] for c in docs.columns) for x in got], docs.schema)

    rejected = {x["row"] for x in run("language", docs)} ^ {x[3] for x in rows}
    verdicts = {(x.doc_id, x.score): x.rejected for x in op6_language.identify(docs).collect()}
    assert {i for i, t in enumerate(texts) if t in (None, "", "12 .. !")} <= rejected and len(rejected) == sum(x.rejected for x in op6_language.identify(docs).collect()) and verdicts

    got = run("near_duplicates", docs)
    kept = [x["row"] for x in got]
    fill = [(-(10**6) if i is None else i, t, k) for i, t, _, k in rows]
    roots = brute_components([(k, t) for k, (_, t, _) in enumerate(fill)], 5, 80)
    groups: dict = {}
    for (_, _, k), (_, _, root, _) in zip(fill, roots):
        groups.setdefault(root, []).append(k)
    place = {k: n for n, (_, _, k) in enumerate(fill)}
    for members in groups.values():
        own = [k for k in kept if k in members]
        assert len(own) == 1 and fill[place[own[0]]][0] == min(fill[place[k]][0] for k in members)

    got = run("passages", back(got))
    left = [(fill[place[k]][0], fill[place[k]][1]) for k in kept]
    assert [x["text"] for x in got] == brute_cut(left)
    assert all(x["n_chars"] == (None if x["text"] is None else len(x["text"])) for x in got)
    assert all(x["_own"] == "x" for x in got)

    hit = {k for k, t in enumerate(texts) if item in (t or "")}
    assert {x["row"] for x in run("decontamination", docs)} == {x[3] for x in rows} - hit
    got = stages["encoding"](spark, docs, str(tmp_path)).collect()
    lib = library(WORD)
    assert sorted((x.doc_id or -1, x.n_tokens) for x in got) == sorted((i or -1, len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in rows)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


@pytest.mark.parametrize("width", [4, 5])
def test_no_link_of_a_query_row_is_lost(spark, width):
    """Rows whose id is divisible by 50 against all rows: each pair of 80 % and more is in one component; no other row joins theirs."""
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    sets = {}
    for r in docs.collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text or ""))
        sets[r.doc_id] = {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()
    holders: dict = {}
    for i, own in sets.items():
        for g in own:
            holders.setdefault(g, []).append(i)
    component = {r.doc_id: r.component_id for r in op7_minhash.near_duplicates(docs, width, 80).collect()}
    links = 0
    for i in (i for i in sets if i % 50 == 0):
        shared: dict = {}
        for g in sets[i]:
            for j in holders[g]:
                shared[j] = shared.get(j, 0) + 1
        for j, n in shared.items():
            if j != i and 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                links += 1
                assert component[i] == component[j], (i, j)
    assert links


def test_runs_beside_each_other_keep_their_folders(spark):
    from contextvars import copy_context

    import corpus_pipeline

    first, second = (corpus_pipeline.staged(lambda spark, docs, sf_dir: cut(docs, "left")) for _ in range(2))
    docs = docs_of(spark, ["a", "b"])
    one, two = copy_context(), copy_context()
    for run in (one, two):
        run.run(corpus_pipeline._of_run.set, {})
    held, gone = one.run(first, spark, docs, "d"), two.run(first, spark, docs, "d")
    assert two.run(second, spark, docs, "d").count() == 2 and held.count() == 2
    with pytest.raises(Exception, match="FAILED_READ_FILE|does not exist|not exist"):
        gone.collect()
    alone = first(spark, docs, "e")
    second(spark, docs, "f")
    assert first(spark, docs, "e").count() == alone.count() == 2
