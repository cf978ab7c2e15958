"""A corpus from documents: five stages, each written and read again before the next.

A stage takes (spark, docs, sf_dir) and returns a DataFrame.  All but the last
return the columns of ``documents``; the last adds how often a document is taken.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolytics.llm.common import bounded_batches, saved
from repolytics.llm.decontaminate import decontaminate
from repolytics.llm.langid import keep_identified
from repolytics.llm.linededup import drop_boilerplate, source_boilerplate
from repolytics.llm.mixing import mix_sources
from repolytics.llm.neardup import drop_near_copies


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; those without one, or with none for half of their letters, go.

    The models are fitted on ``text`` and on ``lang`` where it isn't null; whether a
    document stays hangs on its text alone.  Null and empty texts go.
    """
    bounded_batches(spark)
    return keep_identified(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that stand in many of their source's documents; the longer a line, the fewer are many.

    Rows that repeat a text count once.  Documents whose source is null, and null
    and empty texts, stay as they are; a text that loses all its lines is empty.
    """
    return drop_boilerplate(docs, F.col("source"), found=source_boilerplate(docs, F.col("source"), F.col("text"))).withColumn("n_chars", F.char_length("text").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word Jaccard of 0.8 or more): the one of the smallest id.

    Texts without words are copies of each other.  Rows that repeat an id and its
    text are one document; documents without an id stay.
    """
    bounded_batches(spark)
    return drop_near_copies(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that the benchmark holds; other documents are as they were.

    Null texts stay null, and a text that is a passage as a whole becomes empty;
    without a benchmark nothing changes.
    """
    bounded_batches(spark)
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).withColumn("n_chars", F.char_length("text").cast("long"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with their number of copies and words.

    Documents without a source are a source of their own; those without words take
    part with size 0.  Ties are drawn by the id.
    """
    return mix_sources(docs).filter(F.col("copies") > 0)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("line_dedup", lines),
    ("near_dedup", near_duplicates),
    ("decontamination", benchmark_free),
    ("mixing", mixed),
]

#: Language ID and SimHash can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
