"""Corpus pipeline over ``documents``. Each stage's result is written as Parquet and read again as the next one's docs.

Stages: language identification (rejected documents go), near-duplicates (one document of each group stays), verbatim
passages of 50 bytes and more (their later copies are cut from the texts), benchmark decontamination (affected documents
go), BPE encoding and decoding (digests of the tokens of what is left). All but the last keep the columns of documents.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps
from itertools import count
from threading import get_ident

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import op1_bpe, op4_suffix, op6_language, op7_minhash, op9_decontaminate
from rasterloom.llm.common import cut, recorded, removed, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


#: Folders that each stage has left, by its place, for a whole run, or for stages that one thread calls by themselves on the
#: same tables. A stage deletes those of the stages before it, as its docs have been written by then, and no others.
Left = dict[int, list[str]]
_of_run: ContextVar[Left | None] = ContextVar("of_run", default=None)
_alone: dict[tuple[int, str], Left] = defaultdict(dict)
_places = count()


def staged(stage: Stage) -> Stage:
    place = next(_places)

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        left = _of_run.get()
        if left is None:
            left = _alone[get_ident(), sf_dir]
        for earlier in [k for k in left if k < place]:
            removed(spark, left.pop(earlier))
        with recorded(left.setdefault(place, [])):
            return stage(spark, docs, sf_dir)

    return run_stage


@staged
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language that the model has learned and does not reject; without text or letters they go (operator 6)."""
    return op6_language.keep_identified(docs)


@staged
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares four fifths of its five-word shingles: that of the smallest doc_id, of equal ids one row (operator 7). Documents without words stay."""
    return op7_minhash.keep_one(docs)


@staged
def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the later copies of passages of 50 bytes and more (operator 4); null texts stay null."""
    return op4_suffix.without_repeats(docs)


@staged
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark passage covers to a twentieth of their words (operator 9); an empty benchmark keeps all."""
    return op9_decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


@staged
def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the tokens of every document and of what they decode to (operator 1); no text counts as empty."""
    return op1_bpe.bpe_digests(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("passages", passages),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: The stages' iterations and models are beyond SQL. Tests hold the operators 4, 7 and 9 against brute force, not the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``; runs beside each other, in other threads or by turns, keep apart."""
    mark = _of_run.set({})
    try:
        docs = table(spark, sf_dir, "documents")
        for name, stage in STAGES[:-1]:
            docs = cut(stage(spark, docs, sf_dir), name)
        return STAGES[-1][1](spark, docs, sf_dir)
    finally:
        _of_run.reset(mark)
