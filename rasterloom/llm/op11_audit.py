"""Filter interaction audit: what each order of five filters removes, from a histogram of failure masks.

Native expressions turn a text into a five-bit mask of the filters that it fails (A too few words, B too few distinct words,
C too many capitals, D a symbol, E a copy of an earlier document). Each part then needs the 32 cells of its mask histogram
alone: every one of the 120 orders, step by step, is a sum over cells.

Texts are grouped by their SHA-256 digest and length. Copies of a text share their first four bits, so they are counted in
one row for each (part, labels) of the group before anything looks at the group as a whole: the largest group of copies
costs as many rows as there are parts and kinds of labels in it. E fails for a document with a larger id than the group's
smallest, which the group's rows tell by counts, so no join goes back to documents.

Edge cases. Null text: empty. Null or empty lang: part ''. Rows without a doc_id are never copies of a smaller id, nor a
smaller id to others, and have no labels. Repeated rows count once each; rows that share the smallest id of a group pass E. Repeated
labels of a document: a flag holds if any row has it. Very long texts: one row at a time, whole. Empty documents: no rows.
Other columns of both tables are not read, whatever they are called. Without labels, the two lost counts are 0.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 100, 80, 10

C = F.col


def failures(text: Column, words: Column) -> Column:
    """The bits of A to D."""
    n = F.size(words)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    failed = (
        n < MIN_WORDS,
        100 * F.size(F.array_distinct(words)) < MIN_DISTINCT * n,
        100 * capitals > MAX_CAPITALS * F.length(text),
        text.rlike("[#$%&*|]"),
    )
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failed)), F.lit(0))


def masked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(doc_id, part, digest, mask): one row per document, without its text."""
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    digest = F.struct(F.unhex(F.sha2("text", 256)).alias("sha"), F.octet_length("text").alias("size"))
    return rows.select("doc_id", "part", digest.alias("digest"), failures(C("text"), C("words")).alias("mask"))


def flagged(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Adds good and toxic (0 or 1). Rows without an id take no part in the join's key, so that they don't meet in one task."""
    if labels is None:
        return rows.withColumns({"good": F.lit(0), "toxic": F.lit(0)})
    flag = lambda c: F.max(F.coalesce((labels[c] == 1).cast("int"), F.lit(0)))
    known = labels.groupBy(labels["doc_id"].cast("long").alias("_id")).agg(flag("quality").alias("good"), flag("toxic").alias("toxic")).where("_id IS NOT NULL").withColumn("_lot", F.lit(-1))
    lots = rows.withColumn("_lot", F.when(C("doc_id").isNull(), F.spark_partition_id()).otherwise(-1)).withColumn("_id", C("doc_id"))
    out = lots.join(known, ["_id", "_lot"], "left")
    return out.select("doc_id", "part", "digest", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def cells(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(part, mask, n, good, toxic): the histogram, at most 32 rows for each part."""
    group = ["digest", "part", "mask", "good", "toxic"]
    rows = flagged(masked(docs), labels)
    # one row for each id of a group, then one for each kind of row in it, with its smallest id and the rows that have that
    by_id = rows.groupBy(*group, "doc_id").agg(F.count("*").alias("c"))
    first = F.min(F.when(C("doc_id").isNotNull(), F.struct("doc_id", "c")))
    kinds = by_id.groupBy(*group).agg(F.sum("c").alias("n"), first.alias("first"), F.coalesce(F.sum(F.when(C("doc_id").isNull(), C("c"))), F.lit(0)).alias("unnamed"))
    smallest = F.min("first.doc_id").over(Window.partitionBy("digest"))
    firsts = C("unnamed") + F.when(C("first.doc_id") == smallest, C("first.c")).otherwise(0)
    split = kinds.select("part", "mask", "good", "toxic", "n", firsts.alias("firsts"))
    both = F.explode(F.array(F.struct(C("mask").alias("mask"), C("firsts").alias("n")), F.struct((C("mask") + 16).alias("mask"), (C("n") - C("firsts")).alias("n"))))
    each = split.select("part", "good", "toxic", both.alias("cell")).where("cell.n > 0")
    n = C("cell.n")
    return each.groupBy("part", C("cell.mask").alias("mask")).agg(F.sum(n).alias("n"), F.sum(n * C("good")).alias("good"), F.sum(n * C("toxic")).alias("toxic"))


def steps(spark) -> DataFrame:
    """(mask, filter_order, step, letter, bit, before): every step of every order for every mask, 19,200 constant rows."""
    rows = []
    for order in permutations(FILTERS):
        before = 0
        for k, letter in enumerate(order):
            bit = 1 << FILTERS.index(letter)
            rows.append(("".join(order), k + 1, letter, bit, before))
            before |= bit
    made = spark.createDataFrame(rows, "filter_order string, step int, letter string, bit int, before int")
    return made.withColumn("mask", F.explode(F.sequence(F.lit(0), F.lit(31))))


def audit(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """One row per part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    each = cells(docs, labels).join(F.broadcast(steps(docs.sparkSession)), "mask")
    mask, bit, before = C("mask"), C("bit"), C("before")
    fails, earlier = mask.bitwiseAND(bit) != 0, mask.bitwiseAND(before) != 0
    total = lambda where, what="n": F.sum(F.when(where, C(what)).otherwise(0)).cast("long")
    out = each.groupBy("part", "filter_order", "step", "letter").agg(
        total(~fails & ~earlier).alias("kept"),
        total(fails & ~earlier).alias("removed"),
        total(fails & earlier).alias("redundant"),
        total(mask == bit).alias("unique_fails"),
        total(fails & ~earlier, "good").alias("good_lost"),
        total(fails & ~earlier, "toxic").alias("toxic_lost"),
    )
    # a letter stands at one step of each of the 120 orders
    out = out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter")))
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
