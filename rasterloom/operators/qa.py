"""Question/answer training data: join on question id, file probing by extension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXTENSIONS = (".tif", ".png", ".jpg", ".jpeg")


def pairs(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """``answers``: question_id, answer, ord; of duplicates the last in order counts. Unanswered questions are dropped."""
    last = answers.groupBy("question_id").agg(F.max_by("answer", "ord").alias("answer")).where("answer IS NOT NULL")
    return questions.join(last, questions["id"] == last["question_id"]).drop("question_id")


def with_files(examples: DataFrame, files: DataFrame, folder: str) -> DataFrame:
    """Adds image: the first existing file of img_id by extension, else the .tif path. ``files`` has column name."""
    stem, ext = F.regexp_extract("name", r"^(.*)(\.[a-z]+)$", 1), F.regexp_extract("name", r"^(.*)(\.[a-z]+)$", 2)
    order = F.array_position(F.array(*map(F.lit, EXTENSIONS)), F.col("ext"))
    listed = files.select(stem.alias("stem"), ext.alias("ext")).withColumn("k", order).where("k > 0").groupBy("stem").agg(F.min_by("ext", "k").alias("ext"))
    both = examples.join(listed, examples["img_id"].cast("string") == listed["stem"], "left")
    path = F.concat(F.lit(folder.rstrip("/") + "/"), F.col("img_id").cast("string"), F.coalesce("ext", F.lit(".tif")))
    return both.select(path.alias("image"), "question", F.col("answer").cast("string").alias("answer"))
