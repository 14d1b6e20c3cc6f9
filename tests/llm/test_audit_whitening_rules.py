"""Operators 11 to 13 against brute force, and the documented bounds of fitted samples and memories."""

from __future__ import annotations

import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import op1_bpe, op2_frames, op6_language, op8_quality, op11_audit, op12_whiten, op13_rules

# ---- 11 ----


def brute_audit(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    fails = []
    for i, text, lang in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails.append((lang or "", i, {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and t in first and first[t] < i,
        }))
    out = {}
    for part in {p for p, _, _ in fails}:
        own = [(i, f) for p, i, f in fails if p == part]
        removals = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = list(own)
            for step, x in enumerate(order, 1):
                gone = [(i, f) for i, f in left if f[x]]
                left = [(i, f) for i, f in left if not f[x]]
                removals[x] += len(gone)
                out[part, order, step] = [len(left), len(gone), sum(f[x] for _, f in own) - len(gone), sum(f[x] and sum(f.values()) == 1 for _, f in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(removals[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def audited(spark, docs, labels):
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumns({"mask": F.lit("clash"), "digest": F.lit(1), "n": F.lit(None).cast("int")})
    la = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("clash"))
    rows = op11_audit.audit(d, la).collect()
    assert len({r[:3] for r in rows}) == len(rows)
    return {tuple(r[:3]): tuple(r[3:]) for r in rows}


def test_audit_equals_brute_force(spark):
    r = random.Random(11)
    words = ["one", "Two", "THREE", "four$", "five", *(f"w{k}" for k in range(150))]
    texts = [None, "", " \n", "ÄÖ ß" * 40, "A" * 5000, *(" ".join(r.choices(words, k=r.choice([3, 99, 100, 101, 140]))) for _ in range(12))]
    docs = [(i, r.choice(texts), r.choice(["en", "de", None, ""])) for i in range(60)]
    docs += [(None, texts[5], "en"), (None, texts[5], None), (0, docs[0][1], docs[0][2]), (0, docs[0][1], docs[0][2])]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(0, 60, 2)] + [(2, 1, 0), (2, 0, 1), (None, 1, 1), (999, 1, 1)]
    assert audited(spark, docs, labels) == brute_audit(docs, labels)


def test_audit_of_copies_and_of_nothing(spark):
    copies = [(i, "same text", "en") for i in range(500)] + [(None, "same text", "en")] * 300
    got = audited(spark, copies, [(3, 1, 1), (0, 1, 1)])
    assert got == brute_audit(copies, [(3, 1, 1), (0, 1, 1)])
    assert audited(spark, [], []) == {} and len(got) == 600


# ---- 12 ----


def whiten_rows(spark, vectors):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>").withColumns({"x": F.lit("clash"), "component": F.lit(1), "n": F.lit(2.0)})
    return op12_whiten.whiten(df).collect()


def test_whitening_equals_brute_force(spark):
    g = np.random.default_rng(12)
    data = (g.normal(size=(300, 40)) @ g.normal(size=(40, 40)) / 9 + 3).astype(np.float32)
    vectors = [v.tolist() for v in data]
    odd = [None, [], [None] * 40, [1.0] * 39, [float("nan")] + [0.0] * 39, [float("inf")] * 40, [3e38] * 40]
    rows = whiten_rows(spark, vectors[:150] + odd + vectors[150:] + vectors[:50])
    ids = [*range(150), *range(157, 357)]
    x = np.floor(64 * np.concatenate([data, data[:50]]).astype(np.float64)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    exact = n * x - s
    centred = exact / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1], u[:, ::-1]
    want = centred @ u[:, :32] / np.sqrt(e[:32])
    assert len(rows) == n * 32
    got = np.zeros((n, 32))
    for r in rows:
        at = ids.index(r.vec_id)
        got[at, r.component - 1] = r.whitened
        assert r.n == n and r.deviation == int((exact[at].astype(object) ** 2).sum())
        assert abs(r.explained - e[r.component - 1] / e.sum()) < 1e-9 and r.identity_error < 1e-9
    sign = np.sign((got * want).sum(axis=0))
    assert np.allclose(got * sign, want, atol=1e-7)
    assert np.abs(got.T @ got / n - np.eye(32)).max() < 1e-9


def test_whitening_of_few_repeated_or_no_vectors(spark):
    assert whiten_rows(spark, []) == [] and whiten_rows(spark, [None, [float("nan")]]) == []
    (one, two) = whiten_rows(spark, [[1.0, 2.0]])
    assert (one.whitened, one.explained, one.identity_error, one.deviation) == (None, 0.0, None, 0) and two.component == 2
    rows = whiten_rows(spark, [[0.0, 1.0]] * 5 + [[1.0, 1.0]] * 5)
    assert {r.whitened for r in rows if r.component == 2} == {None}
    assert all(abs(abs(r.whitened) - 1) < 1e-12 and r.explained == 1.0 and r.identity_error < 1e-12 for r in rows if r.component == 1)


def test_whitening_of_wide_values_is_exact(spark):
    values = [[float(2**40), -3.0], [float(-(2**40)), 5.0], [7.0, 0.0]]
    x = [[int(np.floor(64 * c)) + 1_000_000 for c in v] for v in values]
    s = [sum(c) for c in zip(*x)]
    want = [sum((3 * a - b) ** 2 for a, b in zip(v, s)) for v in x]
    rows = {r.vec_id: r.deviation for r in whiten_rows(spark, values)}
    assert rows == {i: w if w < 1 << 63 else None for i, w in enumerate(want)}


# ---- 13 ----


def brute_rules(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    seen = Counter(windows)
    repeated = {i + k for i, g in enumerate(windows) if seen[g] > 1 for k in range(8)}
    n, symbols, dup = len(w), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines))
    chars = sum(map(len, w))
    failed = n < 20 or 100 * len(repeated) > 30 * n
    kept = not failed and not (
        10 * symbols > n or chars < 2 * n or chars > 15 * n or 100 * dup > 40 * len(lines)
        or 100 * len(re.findall("[A-Z]", t)) > 40 * len(t) or 100 * len(re.findall("[0-9]", t)) > 50 * len(t) or 100 * len(re.findall("[!?]", t)) > 50 * n
        or 100 * sum(a == b for a, b in zip(w, w[1:])) > 30 * n
        or 100 * sum(bool(re.search(r"(\.\.\.|…)[\x20\x09-\x0D]*\Z", x)) for x in lines) > 30 * len(lines)
        or 100 * sum(bool(re.match(r"[\x20\x09-\x0D]*[-*•]", x)) for x in lines) > 90 * len(lines)
    )
    return n, chars, symbols, dup, len(repeated), failed, kept


def rule_texts():
    r = random.Random(13)
    words = [f"word{k}" for k in range(60)]
    some = lambda k: r.choices(words, k=k)
    prose = lambda k: " ".join(some(k))
    eight = " ".join(words[:8])
    texts = [None, "", " \t\n", "a", "\x1c \x85 é" * 30, prose(25), prose(3000), f"{eight} {prose(30)} {eight}", f"{eight} " * 9, "a " * 40, "ab " * 7 + prose(60)]
    texts += ["\n".join([prose(9)] * 4 + [prose(9), "", " "]), "\n".join(f"- {prose(4)}" for _ in range(9)), "\n".join(f"{prose(4)}... " for _ in range(9)), prose(40).upper(), " ".join("!!" for _ in range(50)), " ".join("12345" for _ in range(60))]
    texts += [" ".join(x for w in some(30) for x in (w, w)), "&&& ".join(some(40)), "x" * 400 + " " + prose(30), "… ".join(some(30)), "• " + prose(30), " ".join("abc"[k % 3] * 2 for k in range(400))]
    return texts + [prose(r.randint(1, 90)) + "\n" + prose(r.randint(1, 40)) for _ in range(40)]


@pytest.mark.parametrize("reverse", [False, True])
def test_rules_equal_brute_force_in_any_order(spark, reverse):
    texts = rule_texts()
    docs = spark.createDataFrame([(i if i else None, t) for i, t in enumerate(texts)] * 2, "doc_id long, text string").withColumns({"words": F.lit("clash"), "lines": F.lit(1), "n_words": F.lit(2.0)})
    rules = dict(reversed(op13_rules.RULES.items())) if reverse else op13_rules.RULES
    rows = op13_rules.quality(docs, rules=rules)
    want = {i if i else None: brute_rules(t) for i, t in enumerate(texts)}
    got = rows.collect()
    assert len(got) == 2 * len(texts) and all(tuple(r)[1:] == want[r.doc_id] for r in got)
    assert {r.kept for r in got} == {True, False}
    # what an optimizer moves into a filter gives the same rows
    assert rows.where("kept AND n_repeat_words >= 0").count() == sum(r.kept for r in got)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_rules_of_an_empty_table(spark):
    assert op13_rules.quality(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_the_order_is_by_rejections_per_cost_among_what_is_left():
    seconds = {"slow": 4.0, "quick": 1.0, "same": 1.1, "idle": 0.1}
    # 8 documents fail slow, 6 quick and same together, none fails idle
    assert op13_rules.ordered(seconds, {1: 8, 6: 6, 0: 20}) == ["quick", "slow", "idle", "same"]


def test_a_rule_behind_one_that_rejects_is_not_evaluated(spark):
    docs = spark.createDataFrame([(1, "word " * 5), (2, "other " * 4)], "doc_id long, text string")
    rules = {"all": lambda: F.col("n_words") > 0, "fails": lambda: F.raise_error(F.lit("evaluated")).cast("boolean")}
    rows = op13_rules.base(docs).select(op13_rules.cascade(["all", "fails"], rules).alias("kept")).collect()
    assert [r.kept for r in rows] == [False, False]


# ---- bounds of samples and memories ----


def test_rows_without_an_id_and_copies_do_not_swell_a_fitted_sample(spark, monkeypatch):
    monkeypatch.setattr(op8_quality, "SAMPLE", 200)
    same = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one text for all of them").alias("text"), F.lit(None).cast("double").alias("toxic"))
    each = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.lit(None).cast("double").alias("toxic"))
    assert op8_quality.bounded(same, 3000).count() <= 1
    assert 120 <= op8_quality.bounded(each, 3000).count() <= 200
    assert op8_quality.bounded(each, 0).count() == 200
    out = op8_quality.classify(each.select("doc_id", "text").unionByName(same.select("doc_id", "text"))).collect()
    assert len(out) == 6000 and len({r.score for r in out if r.votes}) > 1


def test_numbers_are_no_letters(spark):
    assert not any(map(op6_language.has_letter, ["² ½ ①", "12", "Ⅷ", "_-", "", None, "१२", "́"]))
    assert all(map(op6_language.has_letter, ["a", "ß1", "語", "ʰ", "ª"]))


def test_memories_of_words_are_bounded_by_characters(monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(op1_bpe, "CACHE_CHARS", 50_000)
    bpe = op1_bpe.WordBPE(public_tokenizers.path("word_bpe_49k.json"))
    r = random.Random(1)
    for _ in range(40):
        bpe.digest(" ".join("".join(r.choices("abcdefgh", k=2000)) for _ in range(5)))
        held = sum(len(k) + len(v) for m in (bpe.ids, bpe.texts, bpe.word_ids, bpe.word_texts) for k, v in m.items())
        assert held < 400_000
    monkeypatch.setattr(op2_frames, "CACHE_CHARS", 50_000)
    byte = op2_frames.ByteBPE(public_tokenizers.path("byte_bpe_50k.json"))
    for _ in range(40):
        byte.encode([" ".join("".join(r.choices("abcdefgh", k=2000)) for _ in range(5))])
        assert sum(map(len, byte.memory)) < 100_000
