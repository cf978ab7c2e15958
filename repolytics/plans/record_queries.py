"""Record queries over the given events, customers and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from repolytics.operators import records
from repolytics.plans.adapters import view, with_views


def _analyses(spark, sf):  # noqa: ANN001, ANN202
    a = view(spark, sf, "activity")
    metrics = F.to_json(F.struct(F.col("value").alias("health_score"), F.when(F.pmod(F.col("id"), F.lit(3)) > 0, F.get_json_object("props", "$.k").cast("double")).alias("finding_count")))
    kind = F.when(F.col("type") == F.lit("view"), "project_health").otherwise(F.col("type"))
    return a.select("project_id", kind.alias("analysis_type"), "id", "created_at", metrics.alias("metrics_json"))


def keep_latest_activity(spark, sf):  # noqa: ANN001, ANN201
    return records.keep_latest(view(spark, sf, "activity"), ["project_id"], records.RETENTION["activity"][1])


def keep_latest_analyses(spark, sf):  # noqa: ANN001, ANN201
    return records.keep_latest(_analyses(spark, sf), ["project_id", "analysis_type"], records.RETENTION["analyses"][1]).drop("metrics_json")


def snapshot_deltas(spark, sf):  # noqa: ANN001, ANN201
    return records.snapshot_deltas(_analyses(spark, sf))


def latest_snapshots(spark, sf):  # noqa: ANN001, ANN201
    rows = records.latest_snapshots(_analyses(spark, sf))
    return rows.select("project_id", "analysis_type", "id", F.col("metrics")["health_score"].alias("health_score"), F.size("metrics").cast("long").alias("n_metrics"))


def compare_pair(spark, sf):  # noqa: ANN001, ANN201
    """Each analysis against the one five before it, which may be another project's."""
    a = _analyses(spark, sf)
    return records.compare_pair(a, a.select(F.col("id").alias("before_id"), (F.col("id") + 5).alias("after_id")))


def burst_flags(spark, sf):  # noqa: ANN001, ANN201
    e = view(spark, sf, "activity").select(F.col("type").alias("root"), F.col("created_at").alias("ts"), F.col("id").alias("event_id"))
    return records.burst_flags(e, limit=5, seconds=3600)


def request_metrics(spark, sf):  # noqa: ANN001, ANN201
    a = view(spark, sf, "activity")
    return records.request_metrics(a.select(F.concat_ws("/", "type", F.pmod("id", F.lit(7))).alias("route"), F.when(F.pmod("id", F.lit(11)) == 0, 500).otherwise(200).alias("status"), F.floor("value").alias("duration_ms")))


def _projects(spark, sf):  # noqa: ANN001, ANN202
    c = spark.read.parquet(f"{sf}/customer.parquet")
    return c.select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("repo_name"), (F.pmod("c_custkey", F.lit(5)) == 0).alias("archived"), (F.col("c_acctbal") > 5000).alias("favorite"), F.col("c_nationkey").cast("string").alias("current_sha"), F.when(F.col("c_acctbal") > 0, F.col("c_custkey") % 25).cast("string").alias("last_known_sha"), F.floor("c_acctbal").alias("last_opened_at"), F.col("c_custkey").alias("updated_at"))


def _documents(spark, sf):  # noqa: ANN001, ANN202
    o = spark.read.parquet(f"{sf}/orders.parquet")
    return o.select(F.col("o_custkey").cast("string").alias("project_id"), F.col("o_orderkey").alias("id"), F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("title"), F.col("o_orderdate").cast("timestamp").alias("created_at"))


def project_summary(spark, sf):  # noqa: ANN001, ANN201
    return records.project_summary(_projects(spark, sf), _analyses(spark, sf), _documents(spark, sf))


def search_projects(spark, sf):  # noqa: ANN001, ANN201
    n = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_nationkey").cast("string").alias("project_id"), F.col("n_name").alias("label"))
    return records.search_projects(_projects(spark, sf), _documents(spark, sf), n, "uRGent f", limit=40).select("id", "name", "favorite", "last_opened_at", "position")


def upsert_recent(spark, sf):  # noqa: ANN001, ANN201
    a = view(spark, sf, "activity").select("project_id", "type", F.pmod("id", F.lit(9)).cast("string").alias("target"), F.floor("value").cast("string").alias("view"), "created_at", "id")
    old = records.keep_latest(a.filter("id % 2 = 0"), ["project_id", "type", "target"], 1).drop("id")
    return records.upsert(old, a.filter("id % 2 = 1").drop("id"), "recent_items")


def upsert_bookmarks(spark, sf):  # noqa: ANN001, ANN201
    a = view(spark, sf, "activity").select("project_id", "type", F.pmod("id", F.lit(9)).cast("string").alias("target"), F.floor("value").cast("string").alias("label"), "created_at", "id")
    old = records.keep_latest(a.filter("id % 2 = 0"), ["project_id", "type", "target"], 1).drop("id")
    return records.upsert(old, records.keep_latest(a.filter("id % 2 = 1"), ["project_id", "type", "target"], 1).drop("id"), "bookmarks")


def upsert_patches(spark, sf):  # noqa: ANN001, ANN201
    """Orders as patches: later ones change the state of earlier ones, never their title."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    rows = o.select((F.col("o_orderkey") % 1000).alias("id"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").cast("date").cast("string").alias("applied_at"), F.lit(None).cast("string").alias("rolled_back_at"), F.col("o_totalprice").cast("string").alias("validation_json"), F.col("o_orderkey").alias("created_at"))
    old = records.keep_latest(rows.filter("created_at % 2 = 0"), ["id"], 1, tie="title")
    out = records.upsert(old, records.keep_latest(rows.filter("created_at % 3 = 0"), ["id"], 1, tie="title"), "patches")
    return out.select("id", "title", "status", "applied_at", "rolled_back_at", F.col("validation_json").cast("double").alias("amount"), "created_at")


def upsert_repositories(spark, sf):  # noqa: ANN001, ANN201
    """Customers as repositories: an update only fills in what it knows."""
    c = spark.read.parquet(f"{sf}/customer.parquet")
    url, even = F.concat(F.lit("u/"), F.col("c_custkey").cast("string")).alias("canonical_url"), F.col("c_custkey") % 2 == 0
    old = c.filter("c_custkey % 3 > 0").select(url, F.col("c_name").alias("display_name"), F.lit("/old").alias("local_path"), F.lit("main").alias("default_branch"), F.col("c_mktsegment").alias("last_known_sha"), F.lit(1).alias("last_opened_at"), F.lit(1).alias("updated_at"), F.col("c_nationkey").alias("owner"))
    new = c.filter("c_custkey % 5 > 1").select(url, F.when(even, "renamed").alias("display_name"), F.when(~even, "/new").alias("local_path"), F.lit(None).cast("string").alias("default_branch"), F.when(even, "sha").alias("last_known_sha"), F.lit(2).alias("last_opened_at"), F.when(even, 2).alias("updated_at"), F.lit(99).alias("owner"))
    return records.upsert(old, new, "repositories")


def _job_events(spark, sf):  # noqa: ANN001, ANN202
    a = view(spark, sf, "activity")
    job = F.concat_ws("-", "project_id", F.floor(F.col("id") / 40))
    name = F.element_at(F.array(*[F.lit(x) for x in ("submitted", "started", "finished", "failed", "cancelled")]), (F.pmod("id", F.lit(5)) + 1).cast("int"))
    return a.select(job.alias("job_id"), name.alias("event"), F.col("created_at").alias("at"))


def job_states(spark, sf):  # noqa: ANN001, ANN201
    return records.job_states(_job_events(spark, sf), timeout=1800)


_AN = """an AS (SELECT project_id, CASE WHEN type = 'view' THEN 'project_health' ELSE type END AS analysis_type, id, created_at, value AS hs, CASE WHEN id % 3 > 0 THEN CAST(json_extract(props, '$.k') AS DOUBLE) END AS fc FROM activity)"""
_PROJ = """pr AS (SELECT c_custkey::VARCHAR AS id, c_name AS name, c_mktsegment AS repo_name, c_custkey % 5 = 0 AS archived, c_acctbal > 5000 AS favorite, c_nationkey::VARCHAR AS current_sha, CASE WHEN c_acctbal > 0 THEN (c_custkey % 25)::VARCHAR END AS last_known_sha, floor(c_acctbal)::BIGINT AS last_opened_at, c_custkey AS updated_at FROM customer)"""
_REC = "SELECT project_id, type, (id % 9)::VARCHAR AS target, floor(value)::BIGINT::VARCHAR AS v, created_at, id FROM activity"

SQL = {
    "keep_latest_activity": with_views("SELECT * FROM activity QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, id DESC) <= 500", "activity"),
    "keep_latest_analyses": with_views(f"WITH {_AN} SELECT project_id, analysis_type, id, created_at FROM an QUALIFY row_number() OVER (PARTITION BY project_id, analysis_type ORDER BY created_at DESC, id DESC) <= 50", "activity"),
    "snapshot_deltas": with_views(
        f"""WITH {_AN}, m AS (SELECT project_id, analysis_type, lag(id) OVER w AS before_id, id, hs, lag(hs) OVER w AS phs, fc, lag(fc) OVER w AS pfc FROM an WINDOW w AS (PARTITION BY project_id, analysis_type ORDER BY created_at, id))
SELECT project_id, analysis_type, before_id, id, 'health_score' AS metric, phs AS "before", hs AS "after", hs - phs AS delta FROM m WHERE before_id IS NOT NULL AND hs IS NOT NULL AND phs IS NOT NULL
UNION ALL SELECT project_id, analysis_type, before_id, id, 'finding_count', pfc, fc, fc - pfc FROM m WHERE before_id IS NOT NULL AND fc IS NOT NULL AND pfc IS NOT NULL""",
        "activity"),
    "latest_snapshots": with_views(f"WITH {_AN} SELECT project_id, analysis_type, id, hs AS health_score, CASE WHEN hs IS NULL THEN 0 ELSE 1 END + CASE WHEN fc IS NULL THEN 0 ELSE 1 END AS n_metrics FROM an QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, id DESC) <= 50", "activity"),
    "compare_pair": with_views(
        f"""WITH {_AN}, m AS (SELECT a.project_id, a.analysis_type, a.id AS before_id, b.id AS after_id, a.hs AS ph, b.hs, a.fc AS pf, b.fc FROM an a JOIN an b ON b.id = a.id + 5 AND b.project_id = a.project_id AND b.analysis_type = a.analysis_type)
SELECT project_id, analysis_type, before_id, after_id, 'health_score' AS metric, hs - ph AS delta FROM m WHERE hs IS NOT NULL AND ph IS NOT NULL UNION ALL SELECT project_id, analysis_type, before_id, after_id, 'finding_count', fc - pf FROM m WHERE fc IS NOT NULL AND pf IS NOT NULL""",
        "activity"),
    "upsert_patches": """WITH r AS (SELECT o_orderkey % 1000 AS id, o_orderpriority AS title, o_orderstatus AS status, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS applied_at, o_totalprice AS v, o_orderkey AS created_at FROM orders),
  o AS (SELECT * FROM r WHERE created_at % 2 = 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at DESC) = 1), n AS (SELECT * FROM r WHERE created_at % 3 = 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at DESC) = 1)
SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN n.title ELSE o.title END AS title, CASE WHEN n.id IS NULL THEN o.status ELSE n.status END AS status, CASE WHEN n.id IS NULL THEN o.applied_at ELSE n.applied_at END AS applied_at, NULL::VARCHAR AS rolled_back_at, CASE WHEN n.id IS NULL THEN o.v ELSE n.v END AS amount, CASE WHEN o.id IS NULL THEN n.created_at ELSE o.created_at END AS created_at FROM o FULL JOIN n ON o.id = n.id""",
    "upsert_repositories": """WITH o AS (SELECT 'u/' || c_custkey AS url, c_name, c_mktsegment, c_nationkey FROM customer WHERE c_custkey % 3 > 0), n AS (SELECT 'u/' || c_custkey AS url, c_custkey % 2 = 0 AS even FROM customer WHERE c_custkey % 5 > 1)
SELECT coalesce(o.url, n.url) AS canonical_url, CASE WHEN n.even THEN 'renamed' ELSE c_name END AS display_name, CASE WHEN NOT n.even THEN '/new' WHEN o.url IS NOT NULL THEN '/old' END AS local_path, CASE WHEN o.url IS NOT NULL THEN 'main' END AS default_branch, CASE WHEN n.even THEN 'sha' ELSE c_mktsegment END AS last_known_sha,
  CASE WHEN n.url IS NOT NULL THEN 2 ELSE 1 END AS last_opened_at, CASE WHEN n.even THEN 2 WHEN o.url IS NOT NULL THEN 1 END AS updated_at, CASE WHEN o.url IS NULL THEN 99 ELSE c_nationkey END AS owner FROM o FULL JOIN n ON o.url = n.url""",
    "burst_flags": with_views("WITH r AS (SELECT type AS root, created_at AS ts, id AS event_id FROM activity), c AS (SELECT a.root, a.ts, a.event_id, (SELECT count(*) FROM r b WHERE b.root = a.root AND b.ts > a.ts - INTERVAL 1 HOUR AND (b.ts, b.event_id) < (a.ts, a.event_id)) AS recent FROM r a) SELECT *, recent >= 5 AS \"full\" FROM c", "activity"),
    "request_metrics": with_views("SELECT type || '/' || (id % 7) AS route, count(*) AS requests, count(*) FILTER (WHERE id % 11 = 0) AS errors, sum(floor(value))::BIGINT AS duration_ms_total FROM activity GROUP BY ALL", "activity"),
    "project_summary": with_views(
        f"""WITH {_AN}, {_PROJ}, h AS (SELECT project_id, arg_max(hs, (created_at, id)) AS health_score FROM an WHERE analysis_type = 'project_health' GROUP BY 1), l AS (SELECT project_id, max(created_at) AS last_analyzed_at FROM an GROUP BY 1),
  d AS (SELECT o_custkey::VARCHAR AS project_id, count(*) AS document_count, arg_max(o_orderpriority || ' ' || o_orderstatus, (o_orderdate, o_orderkey)) AS latest_document_title FROM orders GROUP BY 1)
SELECT id AS project_id, name, health_score, last_analyzed_at, coalesce(document_count, 0) AS document_count, latest_document_title, coalesce(current_sha <> last_known_sha, false) AS sha_changed FROM pr LEFT JOIN h ON h.project_id = id LEFT JOIN l ON l.project_id = id LEFT JOIN d ON d.project_id = id""",
        "activity"),
    "search_projects": f"""WITH {_PROJ}, hit AS (SELECT o_custkey::VARCHAR AS project_id FROM orders WHERE contains(lower(o_orderpriority || ' ' || o_orderstatus), 'urgent f') UNION SELECT n_nationkey::VARCHAR FROM nation WHERE contains(lower(n_name), 'urgent f'))
SELECT id, name, favorite, last_opened_at, row_number() OVER (ORDER BY favorite DESC, last_opened_at DESC NULLS LAST, updated_at DESC NULLS LAST, id) AS position FROM pr WHERE NOT archived AND (contains(lower(name), 'urgent f') OR contains(lower(repo_name), 'urgent f') OR id IN (SELECT project_id FROM hit)) QUALIFY position <= 40""",
    "upsert_recent": with_views(
        f"""WITH o AS (SELECT * FROM ({_REC}) WHERE id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY project_id, type, target ORDER BY created_at DESC, id DESC) = 1), n AS (SELECT * FROM ({_REC}) WHERE id % 2 = 1 QUALIFY row_number() OVER (PARTITION BY project_id, type, target ORDER BY created_at DESC, v DESC) = 1)
SELECT coalesce(o.project_id, n.project_id) AS project_id, coalesce(o.type, n.type) AS type, coalesce(o.target, n.target) AS target, CASE WHEN n.project_id IS NOT NULL THEN n.v ELSE o.v END AS view, CASE WHEN n.project_id IS NOT NULL THEN n.created_at ELSE o.created_at END AS created_at FROM o FULL JOIN n ON o.project_id = n.project_id AND o.type = n.type AND o.target = n.target""",
        "activity"),
    "upsert_bookmarks": with_views(
        f"""WITH o AS (SELECT * FROM ({_REC}) WHERE id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY project_id, type, target ORDER BY created_at DESC, id DESC) = 1), n AS (SELECT * FROM ({_REC}) WHERE id % 2 = 1 QUALIFY row_number() OVER (PARTITION BY project_id, type, target ORDER BY created_at DESC, id DESC) = 1)
SELECT coalesce(o.project_id, n.project_id) AS project_id, coalesce(o.type, n.type) AS type, coalesce(o.target, n.target) AS target, CASE WHEN n.project_id IS NOT NULL THEN n.v ELSE o.v END AS label, coalesce(o.created_at, n.created_at) AS created_at FROM o FULL JOIN n ON o.project_id = n.project_id AND o.type = n.type AND o.target = n.target""",
        "activity"),
    "job_states": with_views(
        """WITH e AS (SELECT project_id || '-' || (id // 40) AS job_id, ['submitted', 'started', 'finished', 'failed', 'cancelled'][id % 5 + 1] AS event, created_at AS "at" FROM activity),
  t AS (SELECT job_id, min("at") FILTER (WHERE event = 'started') AS s, min("at") FILTER (WHERE event = 'finished') AS f, min("at") FILTER (WHERE event = 'failed') AS x, min("at") FILTER (WHERE event = 'cancelled') AS c FROM e GROUP BY 1),
  u AS (SELECT *, c IS NOT NULL AND (s IS NULL OR c < s) AS k, least(f, x) AS e FROM t)
SELECT job_id, CASE WHEN k THEN 'cancelled' WHEN s IS NULL THEN 'queued' WHEN e IS NULL THEN 'running' WHEN (x IS NOT NULL AND (f IS NULL OR x < f)) OR epoch_us(e) - epoch_us(s) > 1800000000 THEN 'failed' ELSE 'completed' END AS state, CASE WHEN NOT k THEN s END AS started_at, CASE WHEN k THEN c WHEN s IS NOT NULL THEN e END AS finished_at FROM u""",
        "activity"),
}

QUERIES = {f.__name__: f for f in (keep_latest_activity, keep_latest_analyses, snapshot_deltas, latest_snapshots, compare_pair, burst_flags, request_metrics, project_summary, search_projects, upsert_recent, upsert_bookmarks, upsert_patches, upsert_repositories, job_states)}
