"""Question files, example lines, history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def questions(spark: SparkSession, path: str) -> DataFrame:
    """{"questions": [{id, img_id, question}]} as rows."""
    one = spark.read.schema("questions array<struct<id:long,img_id:string,question:string>>").json(path, multiLine=True)
    return one.select(F.explode("questions").alias("q")).select("q.*")


def answers(spark: SparkSession, path: str) -> DataFrame:
    """{"answers": [{question_id, answer}]} as rows with their order."""
    one = spark.read.schema("answers array<struct<question_id:long,answer:string>>").json(path, multiLine=True)
    return one.select(F.posexplode("answers").alias("ord", "a")).select("a.*", "ord")


def read_lines(spark: SparkSession, path: str, schema: str = "image string, question string, answer string") -> DataFrame:
    """One JSON document per line; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def write_lines(examples: DataFrame, path: str) -> None:
    examples.write.mode("overwrite").json(path)


def append_history(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").parquet(path)


def history(spark: SparkSession, path: str) -> DataFrame:
    """Newest first."""
    return spark.read.parquet(path).orderBy(F.desc("time"))
