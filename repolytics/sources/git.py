"""Readers of Git dumps: logs with NUL-separated statistics, name-status lists and blame.

A log record starts with \\x1e; its seven header columns are parted by \\x1f and
end at the first NUL, after which the statistics follow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD, COLUMN = "\x1e", "\x1f"


def _number(x: Column) -> Column:
    return F.when(x.rlike(r"^[0-9]+\z"), x.cast("long")).otherwise(F.lit(0).cast("long"))


def parse_numstat(stats: Column) -> Column:
    """``array<struct<path, old_path, additions, deletions, binary>>`` of NUL-separated statistics.

    An entry with an empty path is a rename, and the next two fields are the old
    and the new path; those fields have no tabs, so they are no entries.
    """
    fields = F.transform(F.split(F.regexp_replace(stats, "^\n+", ""), "\x00"), lambda x: F.regexp_replace(x, "^\n+", ""))

    def entry(x: Column, i: Column) -> Column:
        parts = F.split(x, "\t", 3)
        renamed = F.get(parts, F.lit(2)) == ""
        path = F.when(renamed, F.get(fields, i + 2)).otherwise(F.get(parts, F.lit(2)))
        made = F.struct(path.alias("path"), F.when(renamed, F.get(fields, i + 1)).alias("old_path"), _number(F.get(parts, F.lit(0))).alias("additions"), _number(F.get(parts, F.lit(1))).alias("deletions"), (F.get(parts, F.lit(0)) == "-").alias("binary"))
        return F.when((F.size(parts) == 3) & (F.coalesce(path, F.lit("")) != ""), made)

    return F.array_compact(F.transform(fields, entry))


def parse_name_status(text: Column) -> Column:
    """``array<struct<status, similarity, path, old_path>>``: A, M and D take one path, R and C the old and the new one."""
    none = F.array().cast("array<struct<status:string,similarity:int,path:string,old_path:string>>")
    start = F.struct(F.lit("").alias("code"), F.lit(None).cast("string").alias("old"), none.alias("out"))

    def step(s: Column, x: Column) -> Column:
        two = s["code"].rlike("^[RC]")
        number = F.substring(s["code"], 2, 9)
        row = F.struct(F.substring(s["code"], 1, 1).alias("status"), F.when(number.rlike(r"^\d+$"), number.cast("int")).alias("similarity"), x.alias("path"), F.when(two, s["old"]).alias("old_path"))
        waits = s["code"] == ""
        half = two & s["old"].isNull()
        return F.struct(
            F.when(waits, F.trim(x)).when(half, s["code"]).otherwise("").alias("code"),
            F.when(half & ~waits, x).alias("old"),
            F.when(waits | half | (x == ""), s["out"]).otherwise(F.concat(s["out"], F.array(row))).alias("out"),
        )

    return F.aggregate(F.split(text, "\x00"), start, step)["out"]


def parse_blame(text: Column) -> Column:
    """``array<struct<sha, line, author_name, author_time, subject>>`` of porcelain blame: one entry a source line."""
    blocks = F.filter(F.split(text, r"(?:^|\n)\t[^\n]*(?:\n|\z)"), lambda b: F.trim(b) != "")
    head = r"(?m)^([0-9a-f]{64}|[0-9a-f]{40}) \d+ (\d+)"

    def entry(b: Column) -> Column:
        name, time = F.regexp_extract(b, r"(?m)^author (.*)$", 1), F.regexp_extract(b, r"(?m)^author-time (\d+)$", 1)
        return F.struct(
            F.regexp_extract(b, head, 1).alias("sha"), F.regexp_extract(b, head, 2).try_cast("int").alias("line"), _person(name).alias("author_name"), time.try_cast("long").alias("author_time"), F.regexp_extract(b, r"(?m)^summary (.*)$", 1).alias("subject"),
        )

    return F.transform(blocks, entry)


def _person(name: Column) -> Column:
    """A name that looks like an address isn't shown."""
    return F.when(name.rlike(r"\S+@\S+"), "Contributor").otherwise(name)


def parse_log(records: DataFrame, *, keep: tuple[str, ...] = ()) -> DataFrame:
    """Commits with their ``files`` from records (repo_id, value), and the columns that ``keep`` names; records without seven columns are dropped."""
    at = F.locate("\x00", F.col("value"))
    head = F.when(at > 0, F.expr(r"substring(value, 1, locate('\0', value) - 1)")).otherwise(F.col("value"))
    stats = F.when(at > 0, F.expr(r"substring(value, locate('\0', value) + 1)")).otherwise("")
    rows = records.select("repo_id", *keep, F.split(F.regexp_replace(head, r"^\n+|\n+$", ""), COLUMN, 7).alias("c"), parse_numstat(stats).alias("files")).filter(F.size("c") == 7)
    c = [F.get("c", F.lit(i)) for i in range(7)]
    parents = F.filter(F.split(c[1], " "), lambda x: x != "")
    total = lambda f: F.aggregate("files", F.lit(0).cast("long"), lambda n, x: n + x[f])
    return rows.select(
        "repo_id", c[0].alias("sha"), F.substring(c[0], 1, 8).alias("short_sha"), parents.alias("parents"), _person(c[2]).alias("author_name"), F.substring(F.sha2(F.lower(c[3]), 256), 1, 12).alias("author_email_hash"),
        F.to_timestamp(c[4]).alias("author_date"), F.to_timestamp(c[5]).alias("committer_date"), c[6].alias("subject"), F.size("files").alias("files_changed"), total("additions").alias("insertions"), total("deletions").alias("deletions"), (F.size(parents) > 1).alias("is_merge"), "files", *keep,
    )


def read_git_log(spark: SparkSession, path: str) -> DataFrame:
    """Commits of every dump under ``path``; the file's name without ending is the repository."""
    rows = spark.read.text(path, lineSep=RECORD).filter(F.trim("value") != "")
    return parse_log(rows.withColumn("repo_id", F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1)))


def commit_files(commits: DataFrame) -> DataFrame:
    """One row a changed file of a commit."""
    return commits.select("repo_id", "sha", F.explode("files").alias("f")).select("repo_id", "sha", "f.*")
