"""Quality rules as a short-circuit cascade of native expressions.

Features that are reported are worked out for every document. The rules that decide on the rest are tried one after the
other and stop at the first that rejects, so what a rule costs is paid for the documents that earlier rules let through.
Their order comes from a sample: each rule's cost is the time that it takes on the sample beyond reading it, its selectivity
the documents that it rejects among those that the rules before it keep, and the rule with most rejections per cost comes
next. A document is kept if no rule rejects it, which is the same in any order, so neither the sample nor the clock changes a result.

Everything is DataFrame functions; no Python runs on the executors. Repeated windows of eight words are found inside a row: windows
become 64-bit hashes, and only where two are equal are they sorted with their places; neighbours count if their words are equal.

Edge cases. Null and empty texts, and texts of white space: no words, so base_failed. A null doc_id stays null. Repeated rows
and ties: each row for itself. Very long texts: whole, in memory of one row (about 16 bytes a window beside its words). An empty table
gives no rows; the order is then that of ``RULES``. Other columns are not read, whatever they are called.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

MIN_WORDS, MAX_REPEAT, WINDOW = 20, 30, 8
#: Documents of the sample, about, and how often each is gone through while a rule is timed.
SAMPLE, TURNS = 1000, 5

C = F.col


def marks(kind: str) -> Column:
    """Characters of a class in the text."""
    return F.length("text") - F.length(F.regexp_replace("text", kind, ""))


def stutter() -> Column:
    """Words equal to the one before."""
    n = F.size("words")
    pairs = F.zip_with(F.slice("words", F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice("words", F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: a == b)
    return F.size(F.filter(pairs, lambda same: same))


def line_share(pattern: str) -> Column:
    """Lines that match."""
    return F.size(F.filter("lines", lambda line: line.rlike(pattern)))


#: What rejects a document, by name; true means rejected. Bounds are percentages of words, lines or code points.
RULES: dict[str, Callable[[], Column]] = {
    "symbols": lambda: 10 * C("n_symbols") > C("n_words"),
    "word_length": lambda: (C("word_chars") < 2 * C("n_words")) | (C("word_chars") > 15 * C("n_words")),
    "duplicate_lines": lambda: 100 * C("n_dup_lines") > 40 * C("n_lines"),
    "capitals": lambda: 100 * marks("[A-Z]") > 40 * F.length("text"),
    "digits": lambda: 100 * marks("[0-9]") > 50 * F.length("text"),
    "exclamation": lambda: 100 * marks("[!?]") > 50 * C("n_words"),
    "stutter": lambda: 100 * stutter() > 30 * C("n_words"),
    "ellipsis": lambda: 100 * line_share(r"(\.\.\.|\x{2026})[\x20\x09-\x0D]*$") > 30 * C("n_lines"),
    "bullets": lambda: 100 * line_share(r"^[\x20\x09-\x0D]*[-*\x{2022}]") > 90 * C("n_lines"),
}


def base(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, words, lines, n_words, word_chars, n_symbols, n_lines, n_dup_lines), whole texts."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    rows = rows.withColumns({
        "words": F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""),
        "lines": F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")),
    })
    return rows.withColumns({
        "n_words": F.size("words").cast("long"),
        "word_chars": F.length(F.array_join("words", "")).cast("long"),
        "n_symbols": marks(r"[#*$%&|<>]").cast("long"),
        "n_lines": F.size("lines").cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
    })


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, also where the optimizer moves the expression into a filter."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column) -> Column:
    """Words in windows of ``WINDOW`` words that stand among them twice or more."""
    n = F.size(words)
    at = lambda i: F.slice(words, i + 1, F.lit(WINDOW))
    covered = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    count = lambda a, s: F.struct((a["n"] + F.least(F.lit(WINDOW), s + WINDOW - a["end"])).alias("n"), (s + WINDOW).alias("end"))

    def starts(placed: Column) -> Column:
        like = lambda p, q: F.coalesce((p["h"] == q["h"]) & (at(p["i"]) == at(q["i"])), F.lit(False))
        near = F.filter(placed, lambda p, k: like(p, F.get(placed, k - 1)) | like(p, F.get(placed, k + 1)))
        return F.array_sort(F.transform(near, lambda p: p["i"]))

    def among(windows: Column) -> Column:
        placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        found = F.aggregate(let(placed, starts), covered, count, lambda a: a["n"])
        return F.when(F.size(F.array_distinct(windows)) < F.size(windows), found).otherwise(F.lit(0).cast("long"))

    windows = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(at(i)))
    # a window that recurs brings at least WINDOW words more than there are distinct ones
    return F.when(n - F.size(F.array_distinct(words)) >= WINDOW, let(windows, among)).otherwise(F.lit(0).cast("long"))


def repeats(rows: DataFrame) -> DataFrame:
    """Adds n_repeat_words."""
    return rows.withColumn("n_repeat_words", let(C("words"), repeated_words))


def rejected_base() -> Column:
    return (C("n_words") < MIN_WORDS) | (100 * C("n_repeat_words") > MAX_REPEAT * C("n_words"))


def cascade(order: list[str], rules: dict[str, Callable[[], Column]] = RULES) -> Column:
    """False at the first rule that rejects; later ones are not evaluated then."""
    if not order:
        return F.lit(True)
    kept = F.when(rules[order[0]](), False)
    for name in order[1:]:
        kept = kept.when(rules[name](), False)
    return kept.otherwise(True)


def timed(df: DataFrame) -> float:
    began = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def measured(sample: DataFrame, rules: dict[str, Callable[[], Column]] = RULES) -> tuple[dict[str, float], dict[int, int]]:
    """(seconds by rule, documents by the bits of the rules that reject them) of a sample with its base features."""
    more = sample.withColumn("_turn", F.explode(F.sequence(F.lit(1), F.lit(TURNS))))
    read = lambda c: more.agg(F.sum(c.cast("int")))  # noqa: E731 - every column that rules use is read in any case
    idle = F.length("text") + F.size("words") + F.size("lines") < 0
    timed(read(idle))
    floor = min(timed(read(idle)) for _ in range(2))
    seconds = {name: max(timed(read(idle | rule())) - floor, 1e-4) for name, rule in rules.items()}
    bits = sum((F.when(rule(), 1 << k).otherwise(0) for k, rule in enumerate(rules.values())), F.lit(0))
    return seconds, {r.bits: r.n for r in sample.groupBy(bits.alias("bits")).agg(F.count("*").alias("n")).collect()}


def ordered(seconds: dict[str, float], bits: dict[int, int]) -> list[str]:
    """Greedy: next comes the rule with most rejections per second among documents that the rules so far let through."""
    names, place, left, out = list(seconds), {n: 1 << k for k, n in enumerate(seconds)}, dict(bits), []
    while names:
        best = max(names, key=lambda n: (sum(c for b, c in left.items() if b & place[n]) / seconds[n], -seconds[n]))
        out.append(best)
        names.remove(best)
        left = {b: c for b, c in left.items() if not b & place[best]}
    return out


def sampled(rows: DataFrame, total: int) -> DataFrame:
    """About ``SAMPLE`` documents with their base features, written once; those that fail the base rules are no part of it."""
    some = rows if total <= SAMPLE else rows.sample(SAMPLE / total, seed=1)
    return cut(repeats(base(some)).where(~rejected_base()), "rules")


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: dict[str, Callable[[], Column]] = RULES) -> DataFrame:
    """One row per document: its base features, base_failed, and kept."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    total = rows.count()
    order = ordered(*measured(sampled(rows, total), rules)) if total else list(rules)
    out = repeats(base(rows)).withColumn("base_failed", rejected_base())
    kept = F.when(C("base_failed"), False).otherwise(cascade(order, rules))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))
