"""The corpus pipeline: from raw documents to packed sequences of tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's docs.  All stages but the last return the columns of
documents, whichever these are.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import common, exact_dedup, language, mixing, near_dedup, packing

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Tables in the shared folder that the stage before wrote for itself.
_left: list[str] = []


def stage(f: Stage) -> Stage:
    """Before a stage, drops what the one before left in the shared folder, unless docs still reads it.

    A stage reads and returns its rows in no more partitions than their number asks for (``common.fewer``), however finely docs is dealt.
    """

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = {x.rpartition("/")[0].rpartition("strandloom/")[2] for x in docs.inputFiles()}
        for path in [x for x in _left if x.rpartition("strandloom/")[2] not in read]:
            common.remove(spark, path)
            _left.remove(path)
        rows = docs.count()  # of a Parquet table: footers only
        with common.recorded() as paths:
            out = f(spark, common.fewer(docs, rows), sf_dir)
        _left.extend(paths)
        return common.fewer(out, rows)

    return run_stage


@stage
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that are in none of the languages learned; where lang is null, the language found is filled in.

    A document is rejected if its text is null or has no letter, or if the best language hardly predicts its bytes
    (``language.MOST_BITS``).  The languages are learned from the labels of docs, held-out documents
    apart; if nothing is labelled, nothing can be judged and every document stays that has a letter.  Labels that are
    there are kept, right or wrong.  Repeated rows are judged one by one, very long texts whole; an empty table gives
    an empty one.
    """
    model = language.train(docs)
    if model is None:
        return docs.filter(language.has_letter())
    found = language.scored(docs, model).filter(language.in_a_language())
    return common.unwrapped(found.withColumn("row", F.col("row").withField("lang", F.coalesce("row.lang", "lang_pred"))))


@stage
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the row with the smallest doc_id stays.

    Rows without doc_id come last, and of repeated rows exactly one stays; null counts as empty, texts of any
    length are compared whole; an empty table gives an empty one.
    """
    return common.unwrapped(exact_dedup.deduplicate(docs).filter("kept"))


@stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates, the row with the smallest doc_id stays.

    Null and empty texts, and those without a word, are near to their equals only; of repeated rows and of rows
    without doc_id one stays in a class; very long texts are compared whole; an empty table gives an empty one.
    """
    return common.unwrapped(near_dedup.classes(docs).filter("kept"))


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are left out or repeated, up to three times, to meet the sources' targets.

    Null is a source of its own; a source without a word is not taken; repeated rows count one by one, ties in
    the order of a source go by doc_id and text; an empty table gives an empty one.
    """
    return mixing.mixed_documents(docs)


@stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document in a sequence; a repeated row is packed as often.

    Null and empty texts are the separator alone; very long texts are cut into as many pieces as they need; rows
    at one place of the curve go by doc_id; of an empty table there are no pieces.
    """
    return packing.pack(docs, keep=["doc_id"], crc=True).select("row.doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Stage]] = [
    ("language", identify_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Language models, sketches and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a data folder."""
    docs = common.documents(spark, sf_dir)
    for name, f in STAGES[:-1]:
        docs = common.materialize(f(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
