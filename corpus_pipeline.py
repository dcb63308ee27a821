"""From raw documents to packed training sequences: reject, deduplicate, pack.

Each stage takes (spark, docs, sf_dir), works on all the rows it is given, and returns a DataFrame;
all but the last return the columns of ``documents``.

Every stage takes rows as they come: a null text counts as empty, and empty and blank texts are
scored, compared and packed like others; very long texts are read whole; keys may be null, where the
smallest decides they come last; rows need not be unique; further columns, of any type and name, come
through the first three stages as they were.  Of rows that are equal in every column one can stay
where one stays.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from assetloom.llm.exact_dedup import exact_dedup
from assetloom.llm.packing import pack_documents
from assetloom.llm.quality import keep_good
from assetloom.llm.shared import delete, reachable, released, scratch
from assetloom.llm.similar import keep_dissimilar


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the discriminant, learned from the labelled ones among them, doesn't reject. Without labels none is rejected."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id."""
    return exact_dedup(docs)[1]


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates, texts whose five-word similarity is at least 0.8, the row with the smallest doc_id.

    Operator 10's byte-position index over five-word fingerprints proposes pairs, MinHash keys those
    that are beyond its reach (see the README), and each pair is verified on the texts.
    """
    return keep_dissimilar(docs, words=5, similarity=0.8, bits=4)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows, in sequences of at most 2048 tokens."""
    return pack_documents(docs)


def _stage(work: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return work(reachable(spark), docs, sf_dir)

    return run_stage


STAGES = [("quality classifier", _stage(quality_stage)), ("exact dedup", _stage(exact_stage)), ("simhash near-dedup", _stage(near_stage)), ("best-fit packing", _stage(pack_stage))]

#: SQL has no tokenizer, no XXH64 and no discriminant; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written to the shared folder for the next.

    A stage's own intermediate tables go when its result is written; what it kept, when the next stage's is.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = scratch(spark, name.replace(" ", "-"))
        with released(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
