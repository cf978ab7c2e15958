"""Readers of file texts and of model documents, and their writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The parts of a model document; each becomes a table.
MODEL = """repo_id string, files map<string, struct<category: string, language: string, size: bigint, dependencies: array<string>, dependents: array<string>>>,
symbols array<struct<name: string, type: string, file: string, line: int>>, dependencies array<struct<source: string, target: string, type: string, confidence: double, evidence: string>>,
api_routes array<struct<method: string, path: string, file: string, handler: string, framework: string>>, database_models array<struct<name: string, file: string, framework: string>>,
entry_points array<struct<path: string, type: string, confidence: double>>, architecture_layers map<string, array<string>>"""


def read_contents(spark: SparkSession, path: str, *, root: str) -> DataFrame:
    """``repo_id, path, content`` of the files under ``root``/<repository>/; bad bytes are replaced, repetitions dropped."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    rest = F.regexp_replace(F.col("path"), "^.*?" + root.rstrip("/").replace(".", r"\.") + "/", "")
    out = rows.select(F.substring_index(rest, "/", 1).alias("repo_id"), F.regexp_replace(rest, "^[^/]*/", "").alias("path"), _decoded(F.col("content")).alias("content"))
    return out.dropDuplicates(["repo_id", "path"])


def _decoded(data: Column) -> Column:
    """UTF-8 text; what isn't becomes the replacement character."""
    return F.make_valid_utf8(data.cast("string"))


def read_model_json(spark: SparkSession, path: str) -> DataFrame:
    """One row a model document, with an explicit schema."""
    return spark.read.schema(MODEL).json(path)


def model_tables(models: DataFrame) -> dict[str, DataFrame]:
    """The normalised tables of model documents."""
    lists = {"symbols": "symbols", "edges": "dependencies", "routes": "api_routes", "data_models": "database_models", "entry_points": "entry_points"}
    out = {name: models.select("repo_id", F.posexplode(col).alias("ord", "x")).select("repo_id", "ord", "x.*") for name, col in lists.items()}
    out["files"] = models.select("repo_id", F.explode("files").alias("path", "f")).select("repo_id", "path", "f.*")
    out["layers"] = models.select("repo_id", F.explode("architecture_layers").alias("layer", "paths")).select("repo_id", "layer", F.explode("paths").alias("path"))
    return out


def write_model_json(tables: dict[str, DataFrame], path: str) -> None:
    """The tables as model documents again, one a repository."""

    def gather(name: str, col: str) -> DataFrame:
        fields = [c for c in tables[name].columns if c not in ("repo_id", "ord")]
        rows = tables[name].groupBy("repo_id").agg(F.array_sort(F.collect_list(F.struct("ord", F.struct(*fields).alias("x")))).alias("xs"))
        return rows.select("repo_id", F.transform("xs", lambda x: x["x"]).alias(col))

    fields = [c for c in tables["files"].columns if c not in ("repo_id", "path")]
    out = tables["files"].groupBy("repo_id").agg(F.map_from_entries(F.collect_list(F.struct("path", F.struct(*fields)))).alias("files"))
    for name, col in (("symbols", "symbols"), ("edges", "dependencies"), ("routes", "api_routes"), ("data_models", "database_models"), ("entry_points", "entry_points")):
        out = out.join(gather(name, col), "repo_id", "left")
    layers = tables["layers"].groupBy("repo_id", "layer").agg(F.array_sort(F.collect_list("path")).alias("paths")).groupBy("repo_id").agg(F.map_from_entries(F.collect_list(F.struct("layer", "paths"))).alias("architecture_layers"))
    out.join(layers, "repo_id", "left").write.mode("overwrite").json(path)
