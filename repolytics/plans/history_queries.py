"""History queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from repolytics.operators import history, lineage
from repolytics.plans.adapters import REPO, once, path_of, same_path, view, with_views
from repolytics.plans.sql import SENSITIVE, rint

AS_OF = "1998-06-01 00:00:00"


def _as_of():  # noqa: ANN202
    return F.lit(AS_OF).cast("timestamp")


def _dependents(spark, sf):  # noqa: ANN001, ANN202
    return view(spark, sf, "edges").groupBy("repo_id", F.col("target").alias("path")).agg(F.countDistinct("source").alias("dependents"))


def _scores(spark, sf):  # noqa: ANN001, ANN202
    return view(spark, sf, "file_sizes").select("repo_id", "path", F.pmod(F.col("size"), F.lit(101)).alias("maintainability_score"))


def file_churn(spark, sf):  # noqa: ANN001, ANN201
    return history.file_churn(view(spark, sf, "commits"), view(spark, sf, "commit_files"), _as_of())


def churn_contributors(spark, sf):  # noqa: ANN001, ANN201
    return history.churn_contributors(view(spark, sf, "commits"), view(spark, sf, "commit_files"))


def cochange(spark, sf):  # noqa: ANN001, ANN201
    return history.cochange(view(spark, sf, "commit_files"), view(spark, sf, "edges"))


def contributors(spark, sf):  # noqa: ANN001, ANN201
    return history.contributors(view(spark, sf, "commits"))


def commit_risk(spark, sf):  # noqa: ANN001, ANN201
    return history.commit_risk(view(spark, sf, "commits"), view(spark, sf, "commit_files"), _dependents(spark, sf))


def hotspots(spark, sf):  # noqa: ANN001, ANN201
    return history.hotspots(file_churn(spark, sf), _dependents(spark, sf), _scores(spark, sf))


def timeline(spark, sf):  # noqa: ANN001, ANN201
    return history.timeline(view(spark, sf, "commits"), since="1995-01-01", until="1997-12-31", author=" f", merge=False, limit=20, offset=5)


def timeline_of_path(spark, sf):  # noqa: ANN001, ANN201
    # Even orders lie on the branch.
    commits = view(spark, sf, "commits")
    reached = commits.filter(F.col("sha").cast("long") % 2 == 0).select("repo_id", "sha", F.lit("main").alias("branch"))
    return history.timeline(commits, path="src/api", files=view(spark, sf, "commit_files"), branch="main", reached=reached, limit=10)


def _head(spark, sf):  # noqa: ANN001, ANN202
    s = view(spark, sf, "snapshots").select("repo_id", "sha", "committed_at").distinct()
    return s.groupBy("repo_id").agg(F.max_by("sha", "committed_at").alias("sha"), F.max("committed_at").alias("as_of"))


def tree_evolution(spark, sf):  # noqa: ANN001, ANN201
    return history.tree_evolution(view(spark, sf, "snapshots"), _head(spark, sf), days=(35, 400, 100_000))


def _snapshot_texts(spark, sf):  # noqa: ANN001, ANN202
    """Each file of a year's snapshot with its lines: its name's end and, for files of special kinds, the quantities that the year has of it."""

    def make():  # noqa: ANN202
        # Numbers are shuffled, and names made of what is left.
        path = path_of("k")
        sql = f"""SELECT CAST(floor(o_custkey / 4) AS BIGINT) AS r, date_trunc('year', o_orderdate) AS at, {same_path("l_partkey")} AS k, CAST(l_quantity AS BIGINT) AS q FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey"""
        rows = spark.sql(sql, lineitem=spark.read.parquet(f"{sf}/lineitem.parquet"), orders=spark.read.parquet(f"{sf}/orders.parquet"))
        rows = rows.groupBy("r", "at", "k").agg(F.collect_set(F.when(~F.expr(path).contains("/f"), F.col("q"))).alias("qs"))
        rows = rows.selectExpr("'repo-' || CAST(r AS STRING) AS repo_id", "CAST(at AS STRING) AS sha", "CAST(at AS TIMESTAMP) AS committed_at", f"{path} AS path", "transform(qs, q -> 'q' || lpad(CAST(q AS STRING), 3, '0')) AS lines")
        return rows.withColumn("content", F.array_join(F.array_sort(F.array_union("lines", F.array(F.substring("path", -6, 6)))), "\n")).drop("lines")

    return once(spark, sf, "snapshot_texts", make)


def compare_snapshots(spark, sf):  # noqa: ANN001, ANN201
    """Every snapshot of a repository against the one before it; the later one's sha is part of the key."""
    s = _snapshot_texts(spark, sf)
    times = s.select("repo_id", "sha", "committed_at").distinct()
    turn = history.Window.partitionBy("repo_id").orderBy("committed_at")
    # The snapshot that one is compared with, before and after it; digests are taken once the texts have met it.
    turns = times.select("repo_id", "sha", F.when(F.lag("sha").over(turn).isNotNull(), F.col("sha")).alias("own"), F.lead("sha").over(turn).alias("next"))
    marked = s.select("repo_id", "sha", "path", "content").join(turns, ["repo_id", "sha"])

    def tree(later):  # noqa: ANN001, ANN202
        return marked.filter(F.col(later).isNotNull()).select(F.concat_ws("@", "repo_id", later).alias("repo_id"), "path", F.md5("content").alias("content_hash"), "content")

    before, after = tree("next"), tree("own")
    return history.compare_snapshots(before, after)


def budgeted_diffs(spark, sf):  # noqa: ANN001, ANN201
    # Paths are numbered without their texts; the few that count are looked up.
    t = view(spark, sf, "contents").filter("content IS NOT NULL")
    first = history.first_of(t.select("repo_id", "path"), ["repo_id"], [F.asc("path")], 30)
    first = first.withColumn("ord", F.row_number().over(history.Window.partitionBy("repo_id").orderBy("path")))
    rows = t.join(F.broadcast(first) if first.count() <= 50_000 else first, ["repo_id", "path"]).select("repo_id", "ord", "path", F.col("content").alias("diff"))
    return history.budgeted_diffs(rows).select("repo_id", "ord", "path", "diff_truncated", F.length("diff").cast("long").alias("n"), F.md5("diff").alias("digest"))


def file_history(spark, sf):  # noqa: ANN001, ANN201
    def moved():  # noqa: ANN202
        number = F.regexp_extract("path", r"/f(\d+)\.", 1)
        return view(spark, sf, "commit_files").withColumn("old_path", F.when((F.col("additions") == 50) & number.endswith("7"), F.regexp_replace("path", r"/f\d+", "/f3")))

    out = lineage.file_history(view(spark, sf, "commits"), once(spark, sf, "moved_files", moved), view(spark, sf, "tree"), _as_of())
    first = F.col("contributors")[0]
    return out.select(
        "repo_id", "path", "first_known_commit", "latest_commit", "total_commits", "additions", "deletions", "total_churn", "days_since_last_change", F.size("rename_history").cast("long").alias("renames"), F.size("contributors").cast("long").alias("n_contributors"),
        first["author_email_hash"].alias("top_author"), first["author_name"].alias("top_name"), first["share_percent"].alias("top_share"), F.array_join(F.transform("recent_commits", lambda c: c["sha"]), ",").alias("recent"),
    )


_DEP = "dep AS (SELECT repo_id, target AS path, count(DISTINCT source) AS dependents FROM edges GROUP BY ALL)"
_CHURN = f"""churn AS (
  SELECT f.repo_id, f.path, count(*) AS commits, sum(additions)::BIGINT AS additions, sum(deletions)::BIGINT AS deletions, sum(additions + deletions)::BIGINT AS total_churn,
    coalesce(sum(additions + deletions) FILTER (WHERE floor((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(author_date)) / 86400000000.0) <= 30), 0)::BIGINT AS recent_churn,
    arg_max(f.sha, (author_date, f.sha)) AS latest_commit, max(author_date) AS latest_date,
    {rint("count(*) / greatest(any_value(n_commits), 1)", 3)} AS change_frequency,
    greatest(0, floor((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(max(author_date))) / 86400000000.0))::BIGINT AS days_since_last_change
  FROM commit_files f JOIN commits c USING (repo_id, sha) JOIN (SELECT repo_id, count(*) AS n_commits FROM commits GROUP BY 1) t USING (repo_id)
  WHERE NOT {SENSITIVE.format(p="path")} GROUP BY f.repo_id, f.path)"""

SQL = {
    "file_churn": with_views(f"WITH {_CHURN} SELECT * FROM churn", "commits", "commit_files"),
    "churn_contributors": with_views(
        f"SELECT f.repo_id, path, author_email_hash, arg_max(author_name, (author_date, f.sha)) AS author_name, count(*) AS commits FROM commit_files f JOIN commits USING (repo_id, sha) WHERE NOT {SENSITIVE.format(p='path')} GROUP BY f.repo_id, path, author_email_hash",
        "commits", "commit_files"),
    "cochange": with_views(
        f"""WITH t AS (SELECT DISTINCT repo_id, sha, path FROM commit_files WHERE NOT {SENSITIVE.format(p="path")}), g AS (SELECT * FROM t WHERE (repo_id, sha) IN (SELECT (repo_id, sha) FROM t GROUP BY repo_id, sha HAVING count(*) <= 30)),
  n AS (SELECT repo_id, path, count(*) AS touches FROM g GROUP BY ALL), p AS (SELECT a.repo_id, a.path AS l, b.path AS r, count(*) AS shared FROM g a JOIN g b ON a.repo_id = b.repo_id AND a.sha = b.sha AND a.path < b.path GROUP BY ALL HAVING count(*) >= 2),
  lk AS (SELECT DISTINCT repo_id, least(source, target) AS l, greatest(source, target) AS r FROM edges),
  q AS (SELECT p.*, {rint("shared / least(x.touches, y.touches)", 3)} AS ratio, lk.l IS NOT NULL AS linked
    FROM p JOIN n x ON x.repo_id = p.repo_id AND x.path = p.l JOIN n y ON y.repo_id = p.repo_id AND y.path = p.r LEFT JOIN lk ON lk.repo_id = p.repo_id AND lk.l = p.l AND lk.r = p.r)
SELECT repo_id, l AS "left", r AS "right", shared AS shared_commits, ratio AS cochange_ratio, CASE WHEN shared >= 4 AND ratio >= 0.6 THEN 'HIGH' WHEN ratio >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS confidence, linked AS structurally_coupled, NOT linked AS temporal_only FROM q""",
        "commit_files", "edges"),
    "contributors": with_views(
        f"""WITH o AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY author_date DESC, sha DESC) AS k FROM commits),
  a AS (SELECT repo_id, author_email_hash, arg_min(author_name, (author_date, sha)) AS author_name, count(*) AS commit_count, count(*) FILTER (WHERE k <= 20) AS recent_commits FROM o GROUP BY ALL)
SELECT *, {rint("100.0 * commit_count / sum(commit_count) OVER (PARTITION BY repo_id)", 1)} AS share_percent,
  CASE WHEN commit_count = max(commit_count) OVER (PARTITION BY repo_id) THEN 'Primary contributor' WHEN commit_count >= 2 THEN 'Frequent contributor' ELSE 'Contributor' END AS label FROM a""",
        "commits"),
    "commit_risk": with_views(
        f"""WITH {_DEP}, f AS (SELECT repo_id, sha, count(*) AS n, sum(additions + deletions) AS churn, sum(least(12, coalesce(dependents, 0))) AS central FROM commit_files LEFT JOIN dep USING (repo_id, path) GROUP BY ALL),
  s AS (SELECT c.repo_id, c.sha, subject, coalesce(n, 0)::BIGINT AS files_changed, coalesce(churn, 0)::BIGINT AS churn, least(100, 4 * coalesce(n, 0) + least(30, coalesce(churn, 0) // 50) + least(30, coalesce(central, 0) * 2))::BIGINT AS score FROM commits c LEFT JOIN f USING (repo_id, sha))
SELECT *, CASE WHEN score >= 60 THEN 'High-change-impact commit' ELSE 'Change impact indicator' END AS label FROM s QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY score DESC, sha) <= 10""",
        "commits", "commit_files", "edges"),
    "hotspots": with_views(
        f"""WITH {_CHURN}, {_DEP}, sc AS (SELECT repo_id, path, size % 101 AS score FROM file_sizes), x AS (
  SELECT churn.*, dependents, sc.score AS ms,
    CASE WHEN max(total_churn) OVER r > 0 THEN {rint("35 * ln(1 + total_churn::DOUBLE) / ln(1 + (max(total_churn) OVER r)::DOUBLE)", 2)} ELSE 0.0 END AS churn_points,
    CASE WHEN max(commits) OVER r > 0 THEN {rint("25 * commits / max(commits) OVER r", 2)} ELSE 0.0 END AS frequency_points,
    {rint("20 * least(coalesce(dependents, 0) / 12, 1.0)", 2)} AS centrality_points,
    CASE WHEN sc.score IS NOT NULL THEN {rint("20 * greatest(0, 100 - sc.score) / 100", 2)} ELSE 0.0 END AS maintainability_points
  FROM churn LEFT JOIN dep USING (repo_id, path) LEFT JOIN sc USING (repo_id, path) WINDOW r AS (PARTITION BY repo_id)),
  y AS (SELECT *, round_even(churn_points + frequency_points + centrality_points + maintainability_points, 0)::BIGINT AS score FROM x)
SELECT repo_id, path, score, CASE WHEN score >= 75 THEN 'Critical Hotspot' WHEN score >= 50 THEN 'Hotspot' WHEN score >= 25 THEN 'Active' ELSE 'Stable' END AS label, churn_points, frequency_points, centrality_points, maintainability_points,
  commits, total_churn, recent_churn, days_since_last_change, CASE WHEN dependents IS NOT NULL AND ms IS NOT NULL THEN 'HIGH' WHEN dependents IS NOT NULL THEN 'MEDIUM' ELSE 'LOW' END AS confidence
FROM y QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY score DESC, commits DESC, path) <= 50""",
        "commits", "commit_files", "edges", "file_sizes"),
    "timeline": with_views(
        """WITH r AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY author_date DESC, sha DESC) AS position, count(*) OVER (PARTITION BY repo_id) AS n FROM commits
  WHERE author_date >= TIMESTAMP '1995-01-01' AND author_date <= TIMESTAMP '1997-12-31 23:59:59' AND NOT is_merge AND contains(lower(author_name), ' f'))
SELECT repo_id, sha, author_email_hash, author_name, author_date, subject, is_merge, position, n > 25 AS has_more FROM r WHERE position BETWEEN 6 AND 25""",
        "commits"),
    "timeline_of_path": with_views(
        """WITH r AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY author_date DESC, sha DESC) AS position, count(*) OVER (PARTITION BY repo_id) AS n FROM commits
  WHERE sha::BIGINT % 2 = 0 AND (repo_id, sha) IN (SELECT (repo_id, sha) FROM commit_files WHERE path = 'src/api' OR starts_with(path, 'src/api/')))
SELECT repo_id, sha, author_email_hash, author_name, author_date, subject, is_merge, position, n > 10 AS has_more FROM r WHERE position <= 10""",
        "commits", "commit_files"),
    "tree_evolution": with_views(
        """WITH h AS (SELECT repo_id, arg_max(sha, committed_at) AS head, max(committed_at) AS as_of FROM snapshots GROUP BY 1),
  m AS (SELECT repo_id, head, as_of, unnest([35, 400, 100000]) AS days_ago FROM h), u AS (SELECT DISTINCT repo_id, sha, committed_at FROM snapshots),
  c AS (SELECT m.repo_id, m.days_ago, any_value(m.head) AS head, arg_max(u.sha, u.committed_at) AS sha FROM m LEFT JOIN u ON u.repo_id = m.repo_id AND u.committed_at <= m.as_of - to_days(m.days_ago) GROUP BY m.repo_id, m.days_ago),
  b AS (SELECT c.repo_id, days_ago, s.path, bool_or(s.sha = c.sha) AS was, bool_or(s.sha = c.head) AS has FROM c JOIN snapshots s ON s.repo_id = c.repo_id AND s.sha IN (c.sha, c.head) WHERE c.sha IS NOT NULL GROUP BY ALL),
  g AS (SELECT repo_id, days_ago, count(*) FILTER (WHERE was) AS files_before, count(*) FILTER (WHERE has) AS files_now, count(*) FILTER (WHERE NOT was) AS files_added, count(*) FILTER (WHERE NOT has) AS files_removed,
    count(DISTINCT regexp_replace(path, '/[^/]*$', '')) FILTER (WHERE was AND contains(path, '/')) AS directories_before, count(DISTINCT regexp_replace(path, '/[^/]*$', '')) FILTER (WHERE has AND contains(path, '/')) AS directories_now,
    coalesce(list_sort(list(path) FILTER (WHERE NOT was)), [])[1:20] AS sample_added, coalesce(list_sort(list(path) FILTER (WHERE NOT has)), [])[1:20] AS sample_removed FROM b GROUP BY ALL)
SELECT c.repo_id, c.days_ago, c.sha, files_before, files_now, files_added, files_removed, directories_before, directories_now, sample_added, sample_removed, c.sha IS NOT NULL AS available FROM c LEFT JOIN g USING (repo_id, days_ago)""",
        "snapshots"),
    "compare_snapshots": f"""WITH x AS (SELECT {REPO.format(c="o_custkey").replace("STRING", "VARCHAR")} AS repo_id, CAST(date_trunc('year', o_orderdate) AS VARCHAR) AS sha, date_trunc('year', o_orderdate) AS committed_at, {path_of("l_partkey").replace("STRING", "VARCHAR")} AS path, l_quantity::BIGINT AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
  tx AS (SELECT repo_id, sha, committed_at, path, list_sort(list_distinct(list_append(coalesce(list(DISTINCT 'q' || lpad(q::VARCHAR, 3, '0')) FILTER (WHERE NOT contains(path, '/f')), []), right(path, 6)))) AS l FROM x GROUP BY repo_id, sha, committed_at, path),
  u AS (SELECT DISTINCT repo_id, sha, committed_at FROM tx), pr AS (SELECT repo_id, sha, lag(sha) OVER (PARTITION BY repo_id ORDER BY committed_at) AS before FROM u),
  t AS (SELECT s.repo_id || '@' || pr.sha AS repo_id, path, s.sha = pr.before AS old, l, len(l) AS n FROM tx s JOIN pr ON pr.repo_id = s.repo_id AND s.sha IN (pr.sha, pr.before) WHERE pr.before IS NOT NULL),
  a AS (SELECT * FROM t WHERE old), z AS (SELECT * FROM t WHERE NOT old),
  g AS (SELECT *, row_number() OVER (PARTITION BY repo_id, l ORDER BY path) AS k FROM a ANTI JOIN z USING (repo_id, path)),
  w AS (SELECT *, row_number() OVER (PARTITION BY repo_id, l ORDER BY path) AS k FROM z ANTI JOIN a USING (repo_id, path)),
  p AS (SELECT coalesce(w.repo_id, g.repo_id) AS repo_id, CASE WHEN w.path IS NULL THEN 'D' WHEN g.path IS NULL THEN 'A' ELSE 'R' END AS status, w.path AS np, g.path AS op, w.n AS nn, g.n AS gn FROM w FULL JOIN g ON w.repo_id = g.repo_id AND w.l = g.l AND w.k = g.k)
SELECT repo_id, status, CASE WHEN status = 'R' THEN 100 END AS similarity, coalesce(np, op) AS path, CASE WHEN status = 'R' THEN op END AS old_path, CASE WHEN status = 'A' THEN nn ELSE 0 END AS additions, CASE WHEN status = 'D' THEN gn ELSE 0 END AS deletions,
  {SENSITIVE.format(p="coalesce(np, op)")} OR (status = 'R' AND {SENSITIVE.format(p="op")}) AS redacted FROM p
UNION ALL SELECT a.repo_id, 'M', NULL, a.path, NULL, len(list_filter(z.l, lambda y: NOT list_contains(a.l, y))), len(list_filter(a.l, lambda y: NOT list_contains(z.l, y))), {SENSITIVE.format(p="a.path")} FROM a JOIN z USING (repo_id, path) WHERE a.l <> z.l""",
    "budgeted_diffs": with_views(
        """WITH o AS (SELECT repo_id, path, content, row_number() OVER (PARTITION BY repo_id ORDER BY path) AS ord FROM contents WHERE content IS NOT NULL QUALIFY ord <= 30),
  b AS (SELECT *, octet_length(encode(content)) AS size, greatest(0, 240000 - coalesce(sum(octet_length(encode(content))) OVER (PARTITION BY repo_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS room FROM o),
  ch AS (SELECT repo_id, ord, k, sum(octet_length(encode(c))) OVER (PARTITION BY repo_id, ord ORDER BY k) <= room AS fits FROM (SELECT repo_id, ord, room, unnest(string_split(content, '')) AS c, unnest(range(1, length(content) + 1)) AS k FROM b WHERE size > room AND room > 0)),
  n AS (SELECT repo_id, ord, max(k) AS k FROM ch WHERE fits GROUP BY ALL)
SELECT b.repo_id, b.ord, path, size > room AS diff_truncated, length(CASE WHEN size > room THEN left(content, coalesce(k, 0)) ELSE content END) AS n, md5(CASE WHEN size > room THEN left(content, coalesce(k, 0)) ELSE content END) AS digest FROM b LEFT JOIN n USING (repo_id, ord)""",
        "contents"),
    "file_history": with_views(
        rf"""WITH RECURSIVE f AS (SELECT repo_id, path, c.author_date AS d, sha, cf.additions, cf.deletions, CASE WHEN cf.additions = 50 AND suffix(regexp_extract(path, '/f(\d+)\.', 1), '7') THEN regexp_replace(path, '/f\d+', '/f3') END AS old_path FROM commit_files cf JOIN commits c USING (repo_id, sha)),
  mv AS (SELECT * FROM f WHERE old_path IS NOT NULL AND old_path <> path), cut AS (SELECT repo_id, path AS name, d, sha FROM mv UNION SELECT repo_id, old_path, d, sha FROM mv),
  rw AS (SELECT f.repo_id, f.path AS name, f.d, f.sha, f.additions, f.deletions, f.old_path, count(cut.sha) AS s FROM f LEFT JOIN cut ON cut.repo_id = f.repo_id AND cut.name = f.path AND (cut.d, cut.sha) <= (f.d, f.sha) GROUP BY ALL),
  od AS (SELECT mv.repo_id, mv.path, mv.sha, mv.old_path, count(cut.sha) AS os FROM mv LEFT JOIN cut ON cut.repo_id = mv.repo_id AND cut.name = mv.old_path AND (cut.d, cut.sha) < (mv.d, mv.sha) GROUP BY ALL),
  lk AS (SELECT rw.repo_id, rw.name, rw.s, od.old_path AS oname, od.os FROM rw JOIN od ON od.repo_id = rw.repo_id AND od.path = rw.name AND od.sha = rw.sha),
  n AS (SELECT tree.repo_id, path, path AS name, max(s) AS s FROM tree JOIN rw ON rw.repo_id = tree.repo_id AND rw.name = tree.path GROUP BY ALL
    UNION SELECT n.repo_id, n.path, lk.oname, lk.os FROM n JOIN lk ON lk.repo_id = n.repo_id AND lk.name = n.name AND lk.s = n.s),
  own AS (SELECT n.path, rw.* FROM n JOIN rw ON rw.repo_id = n.repo_id AND rw.name = n.name AND rw.s = n.s),
  tc AS (SELECT DISTINCT own.repo_id, own.path, own.sha, own.d, author_email_hash AS e, author_name AS nm FROM own JOIN commits c ON c.repo_id = own.repo_id AND c.sha = own.sha),
  au AS (SELECT repo_id, path, e, arg_min(nm, (d, sha)) AS nm, count(*) AS k FROM tc GROUP BY ALL),
  tp AS (SELECT repo_id, path, count(*) AS people, sum(k) AS total, arg_min((e, nm, k), (-k, e)) AS t FROM au GROUP BY ALL),
  rc AS (SELECT repo_id, path, string_agg(sha, ',' ORDER BY d DESC, sha DESC) AS recent FROM (SELECT * FROM tc QUALIFY row_number() OVER (PARTITION BY repo_id, path ORDER BY d DESC, sha DESC) <= 50) GROUP BY ALL),
  sm AS (SELECT repo_id, path, arg_min(sha, (d, sha)) AS first_known_commit, arg_max(sha, (d, sha)) AS latest_commit, count(DISTINCT sha) AS total_commits, sum(additions)::BIGINT AS additions, sum(deletions)::BIGINT AS deletions, sum(additions + deletions)::BIGINT AS total_churn,
    greatest(0, floor((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(max(d) FILTER (WHERE name = path))) / 86400000000.0))::BIGINT AS days_since_last_change, count(DISTINCT (sha, name)) FILTER (WHERE old_path IS NOT NULL) AS renames FROM own GROUP BY ALL)
SELECT sm.*, people AS n_contributors, t[1] AS top_author, t[2] AS top_name, {rint("100.0 * t[3] / total", 1)} AS top_share, recent FROM sm JOIN tp USING (repo_id, path) JOIN rc USING (repo_id, path)""".replace("WITH RECURSIVE", "WITH", 1),
        "commits", "commit_files", "tree").replace("WITH ", "WITH RECURSIVE ", 1),
}

QUERIES = {f.__name__: f for f in (file_churn, churn_contributors, cochange, contributors, commit_risk, hotspots, timeline, timeline_of_path, tree_evolution, compare_snapshots, budgeted_diffs, file_history)}
