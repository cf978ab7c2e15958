"""The ``opN_<name>`` queries over the given tables, and their SQL where it can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from repolytics.llm import decontaminate, fim, htmltext, langid, licenses, linededup, mixing, prefixtrie, quality, simhash, sketch, tokens, toxicity
from repolytics.llm.common import bounded_batches


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_table(spark, sf_dir, "documents"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(_table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents")).select(*mixing.QUERY_COLUMNS)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.fingerprint_report(_table(spark, sf_dir, "documents"))


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_report(_table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leak_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_report(_table(spark, sf_dir, "documents"))


def op9_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.page_report(_table(spark, sf_dir, "pages"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_htmltext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extraction_report(_table(spark, sf_dir, "pages"))


def op12_prefixtrie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.conversation_report(_table(spark, sf_dir, "conversations"))


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.fim_report(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_simhash, op2_licenses, op3_mixing, op4_toxicity, op5_fingerprints, op6_tokens, op7_decontaminate, op8_langid, op9_linededup, op10_quality, op11_htmltext, op12_prefixtrie, op13_fim)}

ORACLE_SQL: dict[str, str] = {"op2_licenses": licenses.SQL, "op3_mixing": mixing.SQL, "op7_decontaminate": decontaminate.SQL, "op9_linededup": linededup.SQL, "op12_prefixtrie": prefixtrie.SQL, "op13_fim": fim.SQL}
