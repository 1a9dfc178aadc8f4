"""A corpus pipeline: toxicity, exact and near deduplication, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and reread as the next one's docs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folio.llm import decontam, exact, nearjoin, packing, toxicity
from folio.llm.common import delete, release, table, write
from folio.llm.queries import tokenizer_files


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the toxicity operator rejects; the learning rows are those of the documents table.

    All stages take nulls in any column, empty and repeated rows, empty tables and more columns of any name. Null and
    empty texts aren't toxic.
    """
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null, empty and blank ones are equal) the longest stays, then the smallest id, null being the last."""
    return exact.keep_first(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the row of the smallest id stays; repeated rows are copies."""
    return nearjoin.keep_one(docs)


def contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a passage of the benchmark; without benchmark rows, all stay."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece of a sequence; a null or empty text is its end id alone, a null id stays null."""
    return packing.pack(docs, *tokenizer_files(), with_ids=False).drop("ids")


def _fresh(stage: Callable) -> Callable:
    """What a stage wrote to the scratch folder goes when the next one begins: its result has been written by then."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [(f.__name__, f if f is toxic else _fresh(f)) for f in (toxic, exact_copies, near_copies, contaminated, packed)]

#: No SQL for the model of the first stage, nor for the forest of the third.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs, path = write(stage(spark, docs, sf_dir))
        if before:
            delete(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
