"""Project records: retention, snapshots, upserts, searches and rates.

Tables carry their own keys: activity(project_id, type, id, created_at, ...),
analyses(project_id, analysis_type, id, created_at, metrics_json, ...).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolytics.operators.history import first_of
from repolytics.operators.scan import SEGMENT_ROWS, with_previous
from repolytics.sources.buckets import BucketedTable

# How many of the newest rows each table keeps, and of what.
RETENTION = {"activity": (("project_id",), 500), "analyses": (("project_id", "analysis_type"), 50), "validations": (("project_id",), 200), "patches": (("project_id",), 200), "recent_items": (("project_id",), 500)}

# What an update of each table may change; "filled" tables only take non-null values.
UPSERT = {
    "recent_items": (("project_id", "type", "target"), ("view", "created_at"), False),
    "bookmarks": (("project_id", "type", "target"), ("label",), False),
    "patches": (("id",), ("status", "applied_at", "rolled_back_at", "validation_json"), False),
    "repositories": (("canonical_url",), ("display_name", "local_path", "default_branch", "last_known_sha", "last_opened_at", "updated_at"), True),
}


def keep_latest(df: DataFrame, keys: Sequence[str], n: int, *, at: str = "created_at", tie: str = "id") -> DataFrame:
    """The newest ``n`` rows of each key; each partition is cut before the shuffle."""
    return first_of(df, list(keys), [F.desc(at), F.desc(tie)], n)


def latest_snapshots(analyses: DataFrame, k: int = 50) -> DataFrame:
    """The newest ``k`` analyses of each project, with their metrics as a map."""
    rows = keep_latest(analyses, ["project_id"], k)
    return rows.withColumn("metrics", F.from_json("metrics_json", "map<string,double>"))


def snapshot_deltas(analyses: DataFrame, *, most: int = SEGMENT_ROWS) -> DataFrame:
    """Each metric of an analysis against the one before of its project and type, where both have it.

    A project and type of more than ``most`` analyses is worked in ranges of time.
    """
    rows = analyses.select("project_id", "analysis_type", "id", "created_at", F.from_json("metrics_json", "map<string,double>").alias("m"))
    before = F.struct(F.col("id").alias("before_id"), F.col("m").alias("p"))
    pairs = with_previous(rows, ["project_id", "analysis_type"], "created_at", ["id"], before, most=most).select("*", "previous.*").filter(F.col("p").isNotNull() & F.col("m").isNotNull())
    keys = F.array_intersect(F.map_keys("m"), F.map_keys("p"))
    out = pairs.select("project_id", "analysis_type", "before_id", "id", F.explode(keys).alias("metric"), "m", "p")
    return out.select("project_id", "analysis_type", "before_id", "id", "metric", F.col("p")[F.col("metric")].alias("before"), F.col("m")[F.col("metric")].alias("after"), (F.col("m")[F.col("metric")] - F.col("p")[F.col("metric")]).alias("delta"))


def compare_pair(analyses: DataFrame, pairs: DataFrame) -> DataFrame:
    """Deltas of chosen pairs (before_id, after_id); pairs of different projects or types have none."""
    rows = analyses.select("project_id", "analysis_type", "id", F.from_json("metrics_json", "map<string,double>").alias("m"))
    a = rows.select("project_id", "analysis_type", F.col("id").alias("before_id"), F.col("m").alias("p"))
    b = rows.select("project_id", "analysis_type", F.col("id").alias("after_id"), "m")
    both = pairs.join(a, "before_id").join(b, ["project_id", "analysis_type", "after_id"])
    out = both.select("project_id", "analysis_type", "before_id", "after_id", F.explode(metric_key_intersection(F.col("p"), F.col("m"))).alias("metric"), "m", "p")
    return out.select("project_id", "analysis_type", "before_id", "after_id", "metric", (F.col("m")[F.col("metric")] - F.col("p")[F.col("metric")]).alias("delta"))


def metric_key_intersection(a: Column, b: Column) -> Column:
    """Metrics that two snapshots share."""
    return F.array_sort(F.array_intersect(F.map_keys(a), F.map_keys(b)))


def burst_flags(events: DataFrame, *, limit: int = 5, seconds: int = 60) -> DataFrame:
    """Events (root, ts, event_id) with how many came in the ``seconds`` before, and whether that fills the quota.

    A root's events are dealt by time into spans of ``seconds``; each also goes to
    the span after its own, so that no task holds all events of a root.
    """
    micros = F.unix_micros("ts")
    span = F.floor(micros / (seconds * 1_000_000)).cast("long")
    rows = events.withColumn("_span", F.explode(F.array(span, span + 1))).withColumn("_own", F.col("_span") == span)
    near = Window.partitionBy("root", "_span").orderBy(micros).rangeBetween(-seconds * 1_000_000 + 1, 0)
    rows = rows.withColumn("_n", F.count(F.lit(1)).over(near))
    # Rows at the same time count each other; the ones before in order are what the quota has seen.
    same = F.row_number().over(Window.partitionBy("root", "_span", "ts").orderBy("event_id"))
    at = F.count(F.lit(1)).over(Window.partitionBy("root", "_span", "ts"))
    rows = rows.withColumn("recent", F.col("_n") - at + same - 1).filter("_own")
    return rows.withColumn("full", F.col("recent") >= limit).drop("_n", "_own", "_span")


def request_metrics(requests: DataFrame) -> DataFrame:
    """Requests, errors (status 500 and up) and total duration by route."""
    return requests.groupBy("route").agg(F.count(F.lit(1)).alias("requests"), F.count(F.when(F.col("status") >= 500, 1)).alias("errors"), F.sum("duration_ms").alias("duration_ms_total"))


def project_summary(projects: DataFrame, analyses: DataFrame, documents: DataFrame) -> DataFrame:
    """Each project's newest health score, last analysis, number of documents, newest title, and whether its revision changed."""
    score = F.get_json_object("metrics_json", "$.health_score").cast("double")
    health = analyses.filter(F.col("analysis_type") == "project_health").groupBy("project_id").agg(F.max_by(score, F.struct("created_at", "id")).alias("health_score"))
    last = analyses.groupBy("project_id").agg(F.max("created_at").alias("last_analyzed_at"))
    docs = documents.groupBy("project_id").agg(F.count(F.lit(1)).alias("document_count"), F.max_by("title", F.struct("created_at", "id")).alias("latest_document_title"))
    rows = projects.withColumn("project_id", F.col("id")).join(health, "project_id", "left").join(last, "project_id", "left").join(docs, "project_id", "left")
    changed = F.col("current_sha").isNotNull() & F.col("last_known_sha").isNotNull() & (F.col("current_sha") != F.col("last_known_sha"))
    return rows.select("project_id", "name", "health_score", "last_analyzed_at", F.coalesce("document_count", F.lit(0)).alias("document_count"), "latest_document_title", changed.alias("sha_changed"))


def search_projects(projects: DataFrame, documents: DataFrame, bookmarks: DataFrame, query: str, *, archived: bool = False, limit: int | None = 50) -> DataFrame:
    """Projects whose name, repository, document titles or bookmark labels hold ``query``, ASCII case aside; wildcards are plain."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def has(c: str) -> Column:
        return F.contains(F.translate(F.col(c), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(query.translate(lower)))

    hits = documents.filter(has("title")).select("project_id").unionByName(bookmarks.filter(has("label")).select("project_id")).distinct().withColumn("hit", F.lit(True))
    rows = projects.filter(F.col("archived") == archived).join(hits, projects["id"] == hits["project_id"], "left").drop("project_id")
    rows = rows.filter(F.coalesce(has("name") | has("repo_name"), F.lit(False)) | F.col("hit").isNotNull()).drop("hit")
    order = Window.orderBy(F.desc("favorite"), F.desc_nulls_last("last_opened_at"), F.desc_nulls_last("updated_at"), "id")
    if limit is None:
        return rows
    top = rows.orderBy(F.desc("favorite"), F.desc_nulls_last("last_opened_at"), F.desc_nulls_last("updated_at"), "id").limit(limit)
    return top.withColumn("position", F.row_number().over(order))


def upsert(df: DataFrame, updates: DataFrame, table: str) -> DataFrame:
    """``df`` with ``updates`` put in: new keys whole, known keys only in the columns that the table's policy names.

    Of several updates of one key the last by ``created_at`` (then all columns) counts.
    """
    keys, columns, filled = UPSERT[table]
    order = [F.desc(c) for c in (("created_at",) if "created_at" in updates.columns else ())] + [F.desc(c) for c in sorted(updates.columns)]
    last = first_of(updates, list(keys), order, 1).select(*[F.col(c).alias(f"_{c}") for c in updates.columns])
    joined = df.withColumn("_old", F.lit(True)).join(last.withColumn("_new", F.lit(True)), [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "full_outer")

    def pick(c: str) -> Column:
        if c not in updates.columns:
            return F.col(c)
        fresh = F.col("_old").isNull()
        taken = F.coalesce(f"_{c}", c) if filled else F.col(f"_{c}")
        return F.when(fresh, F.col(f"_{c}")).when(F.col("_new").isNotNull() & F.lit(c in columns), taken).otherwise(F.col(c))

    return joined.select(*[pick(c).alias(c) for c in df.columns])


def upsert_into(stored: BucketedTable, updates: DataFrame, table: str, version: int) -> list[int]:
    """Put ``updates`` into a stored table by the policy of ``table``; only the buckets of their keys are written, and returned.

    The table's keys are the policy's; see :meth:`BucketedTable.update` for ``version``.
    """
    if stored.keys != list(UPSERT[table][0]):
        raise ValueError(f"{table} is keyed by {', '.join(UPSERT[table][0])}")
    return stored.update(updates, lambda held, new: upsert(held, new, table), version)


def job_states(events: DataFrame, *, timeout: int = 180) -> DataFrame:
    """The state of each job by its events (job_id, event, at) in order of time.

    queued, running, completed, failed or cancelled; a job is only cancelled while
    queued, and a run longer than ``timeout`` seconds has failed.
    """
    first = {e: F.min(F.when(F.col("event") == e, F.col("at"))).alias(e) for e in ("submitted", "started", "finished", "failed", "cancelled")}
    t = events.groupBy("job_id").agg(*first.values())
    cancelled = F.col("cancelled").isNotNull() & (F.col("started").isNull() | (F.col("cancelled") < F.col("started")))
    end = F.least("finished", "failed")
    seconds = (F.unix_micros(end) - F.unix_micros("started")) / 1e6
    state = (
        F.when(cancelled, "cancelled").when(F.col("started").isNull(), "queued").when(end.isNull(), "running")
        .when((F.col("failed").isNotNull() & (F.col("finished").isNull() | (F.col("failed") < F.col("finished")))) | (seconds > timeout), "failed").otherwise("completed")
    )
    return t.select("job_id", state.alias("state"), F.when(~cancelled, F.col("started")).alias("started_at"), F.when(cancelled, F.col("cancelled")).when(F.col("started").isNotNull(), end).alias("finished_at"))
