"""Git history: churn, co-change, ownership, hotspots, timelines and trees in time.

Tables carry ``repo_id``: commits(repo_id, sha, author_email_hash, author_name,
author_date, subject, is_merge, ...), files(repo_id, sha, path, additions,
deletions, ...), edges(repo_id, source, target).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolytics.checkpoints import checkpointed
from repolytics.functions.paths import is_sensitive_path
from repolytics.functions.scalars import days_since, even_round
from repolytics.operators.linediff import common_lines, line_hashes

# Weights of the hotspot score and where its labels begin.
HOTSPOT_WEIGHTS = {"churn": 35, "frequency": 25, "centrality": 20, "maintainability": 20}
HOTSPOT_LABELS = ((75, "Critical Hotspot"), (50, "Hotspot"), (25, "Active"))


def file_churn(commits: DataFrame, files: DataFrame, as_of: Column, recent_days: int = 30) -> DataFrame:
    """Changes of each path that isn't sensitive.

    ``change_frequency`` divides by all commits of the repository, those without
    files included; future changes count as recent; of equal dates the greatest
    sha is the latest.
    """
    rows = files.join(commits.select("repo_id", "sha", "author_date"), ["repo_id", "sha"])
    churn = F.col("additions") + F.col("deletions")
    latest = F.struct("author_date", "sha")
    out = rows.groupBy("repo_id", "path").agg(
        F.count(F.lit(1)).alias("commits"),
        F.sum("additions").alias("additions"),
        F.sum("deletions").alias("deletions"),
        F.sum(churn).alias("total_churn"),
        F.coalesce(F.sum(F.when(days_since(F.col("author_date"), as_of) <= recent_days, churn)), F.lit(0)).cast("long").alias("recent_churn"),
        F.max(latest).alias("latest"),
    )
    total = commits.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_commits"))
    # The name is judged once a path: a column of the sums keeps the filter above them.
    out = out.withColumn("sensitive", is_sensitive_path(F.col("path")) & (F.col("commits") > 0)).filter(~F.col("sensitive"))
    return out.join(total, "repo_id").select(
        "repo_id", "path", "commits", "additions", "deletions", "total_churn", "recent_churn",
        F.col("latest.sha").alias("latest_commit"), F.col("latest.author_date").alias("latest_date"),
        even_round(F.col("commits") / F.greatest("n_commits", F.lit(1)), 3).alias("change_frequency"),
        F.greatest(F.lit(0), days_since(F.col("latest.author_date"), as_of)).cast("long").alias("days_since_last_change"),
    )


def churn_contributors(commits: DataFrame, files: DataFrame) -> DataFrame:
    """Commits of each author on each path; the name is that of the newest commit."""
    rows = files.filter(~is_sensitive_path(F.col("path"))).join(commits.select("repo_id", "sha", "author_date", "author_email_hash", "author_name"), ["repo_id", "sha"])
    return rows.groupBy("repo_id", "path", "author_email_hash").agg(F.max_by("author_name", F.struct("author_date", "sha")).alias("author_name"), F.count(F.lit(1)).alias("commits"))


def cochange(files: DataFrame, edges: DataFrame, *, max_files: int = 30, min_shared: int = 2, limit: int | None = None) -> DataFrame:
    """Pairs of paths that change together.

    Commits of more than ``max_files`` distinct paths count for nothing; the bound
    also bounds the pairs a commit makes.  ``limit`` keeps the first of each
    repository by shared commits, ratio and paths.
    """
    touched = files.filter(~is_sensitive_path(F.col("path"))).select("repo_id", "sha", "path").distinct()
    grouped = touched.groupBy("repo_id", "sha").agg(F.collect_set("path").alias("paths")).filter(F.size("paths") <= max_files)
    grouped = grouped.select("repo_id", "sha", F.array_sort("paths").alias("paths"))
    touches = grouped.select("repo_id", F.explode("paths").alias("path")).groupBy("repo_id", "path").agg(F.count(F.lit(1)).alias("touches"))
    left = grouped.select("repo_id", "paths", F.posexplode("paths").alias("at", "left"))
    pairs = left.select("repo_id", "left", F.explode(F.slice("paths", F.col("at") + 2, F.size("paths"))).alias("right"))
    pairs = pairs.groupBy("repo_id", "left", "right").agg(F.count(F.lit(1)).alias("shared_commits")).filter(F.col("shared_commits") >= min_shared)
    known = edges.select("repo_id", F.least("source", "target").alias("left"), F.greatest("source", "target").alias("right"), F.lit(True).alias("linked")).distinct()
    out = pairs.join(touches.select("repo_id", F.col("path").alias("left"), F.col("touches").alias("a")), ["repo_id", "left"]).join(touches.select("repo_id", F.col("path").alias("right"), F.col("touches").alias("b")), ["repo_id", "right"])
    out = out.join(known, ["repo_id", "left", "right"], "left").withColumn("cochange_ratio", even_round(F.col("shared_commits") / F.least("a", "b"), 3))
    high = (F.col("shared_commits") >= 4) & (F.col("cochange_ratio") >= 0.6)
    out = out.select(
        "repo_id", "left", "right", "shared_commits", "cochange_ratio",
        F.when(high, "HIGH").when(F.col("cochange_ratio") >= 0.4, "MEDIUM").otherwise("LOW").alias("confidence"),
        F.coalesce("linked", F.lit(False)).alias("structurally_coupled"), F.col("linked").isNull().alias("temporal_only"),
    )
    return first_of(out, ["repo_id"], [F.desc("shared_commits"), F.desc("cochange_ratio"), F.asc("left"), F.asc("right")], limit)


def first_of(df: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int | None) -> DataFrame:
    """The first ``limit`` rows of each key (all if null): Spark cuts each partition before the shuffle."""
    if limit is None:
        return df
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_n") <= limit).drop("_n")


def contributors(commits: DataFrame, *, recent: int = 20) -> DataFrame:
    """Share of each author; ``recent_commits`` are those among the repository's newest ``recent`` commits.

    The name is that of the author's oldest commit, and all who tie at the top
    are primary.
    """
    newest = first_of(commits.select("repo_id", "sha", "author_date", "author_email_hash"), ["repo_id"], [F.desc("author_date"), F.desc("sha")], recent)
    newest = newest.groupBy("repo_id", "author_email_hash").agg(F.count(F.lit(1)).alias("recent_commits"))
    by_author = commits.groupBy("repo_id", "author_email_hash").agg(F.min_by("author_name", F.struct("author_date", "sha")).alias("author_name"), F.count(F.lit(1)).alias("commit_count"))
    # A repository's total and maximum are sums of counts, so no window holds all of its authors.
    totals = by_author.groupBy("repo_id").agg(F.sum("commit_count").alias("total"), F.max("commit_count").alias("most"))
    out = by_author.join(totals, "repo_id").join(newest, ["repo_id", "author_email_hash"], "left")
    label = F.when(F.col("commit_count") == F.col("most"), "Primary contributor").when(F.col("commit_count") >= 2, "Frequent contributor").otherwise("Contributor")
    return out.select("repo_id", "author_email_hash", "author_name", "commit_count", F.coalesce("recent_commits", F.lit(0)).alias("recent_commits"), even_round(F.lit(100.0) * F.col("commit_count") / F.col("total"), 1).alias("share_percent"), label.alias("label"))


def commit_risk(commits: DataFrame, files: DataFrame, dependents: DataFrame, *, limit: int | None = 10) -> DataFrame:
    """Change-impact score of a commit by its files, churn and the dependents (repo_id, path, dependents) of its files."""
    rows = files.join(dependents, ["repo_id", "path"], "left")
    per = rows.groupBy("repo_id", "sha").agg(F.count(F.lit(1)).alias("files_changed"), F.sum(F.col("additions") + F.col("deletions")).alias("churn"), F.sum(F.least(F.lit(12), F.coalesce("dependents", F.lit(0)))).alias("central"))
    out = commits.select("repo_id", "sha", "subject").join(per, ["repo_id", "sha"], "left").na.fill(0, ["files_changed", "churn", "central"])
    score = F.least(F.lit(100), 4 * F.col("files_changed") + F.least(F.lit(30), F.floor(F.col("churn") / 50)) + F.least(F.lit(30), F.col("central") * 2))
    out = out.withColumn("score", score.cast("long")).drop("central")
    out = out.withColumn("label", F.when(F.col("score") >= 60, "High-change-impact commit").otherwise("Change impact indicator"))
    return first_of(out, ["repo_id"], [F.desc("score"), F.asc("sha")], limit)


def hotspots(churn: DataFrame, dependents: DataFrame, scores: DataFrame, *, limit: int | None = 50) -> DataFrame:
    """Maintenance hotspots: churn, frequency, centrality and maintainability.

    ``dependents`` has (repo_id, path, dependents) of modeled files, ``scores``
    (repo_id, path, maintainability_score).  The repository's maxima are
    aggregated and joined, so no window holds a whole repository.
    """
    most = churn.groupBy("repo_id").agg(F.max("total_churn").alias("max_churn"), F.max("commits").alias("max_commits"))
    rows = churn.join(most, "repo_id").join(dependents, ["repo_id", "path"], "left").join(scores, ["repo_id", "path"], "left")
    w = HOTSPOT_WEIGHTS
    rows = rows.select(
        "*",
        F.when(F.col("max_churn") > 0, even_round(w["churn"] * F.log1p("total_churn") / F.log1p("max_churn"), 2)).otherwise(0.0).alias("churn_points"),
        F.when(F.col("max_commits") > 0, even_round(w["frequency"] * F.col("commits") / F.col("max_commits"), 2)).otherwise(0.0).alias("frequency_points"),
        even_round(w["centrality"] * F.least(F.coalesce("dependents", F.lit(0)) / F.lit(12), F.lit(1.0)), 2).alias("centrality_points"),
        F.when(F.col("maintainability_score").isNotNull(), even_round(w["maintainability"] * F.greatest(F.lit(0), 100 - F.col("maintainability_score")) / F.lit(100), 2)).otherwise(0.0).alias("maintainability_points"),
    )
    total = F.col("churn_points") + F.col("frequency_points") + F.col("centrality_points") + F.col("maintainability_points")
    rows = rows.withColumn("score", even_round(total).cast("long"))
    label = F.when(F.col("score") >= HOTSPOT_LABELS[0][0], HOTSPOT_LABELS[0][1]).when(F.col("score") >= HOTSPOT_LABELS[1][0], HOTSPOT_LABELS[1][1]).when(F.col("score") >= HOTSPOT_LABELS[2][0], HOTSPOT_LABELS[2][1]).otherwise("Stable")
    modeled = F.col("dependents").isNotNull()
    out = rows.select(
        "repo_id", "path", "score", label.alias("label"), "churn_points", "frequency_points", "centrality_points", "maintainability_points",
        "commits", "total_churn", "recent_churn", "days_since_last_change",
        F.when(modeled & F.col("maintainability_score").isNotNull(), "HIGH").when(modeled, "MEDIUM").otherwise("LOW").alias("confidence"),
    )
    return first_of(out, ["repo_id"], [F.desc("score"), F.desc("commits"), F.asc("path")], limit)


def timeline(commits: DataFrame, *, since: str | None = None, until: str | None = None, author: str | None = None, merge: bool | None = None, path: str | None = None, files: DataFrame | None = None, branch: str | None = None, reached: DataFrame | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of each repository's commits, newest first, and whether more follow.

    A date alone as ``until`` means the end of that day; ``author`` matches a part
    of the name in any case.  With ``path`` only commits count that touch it or what
    lies under it by ``files`` (repo_id, sha, path), with ``branch`` only those that
    it reaches by ``reached`` (repo_id, branch, sha).
    """
    rows = commits
    if path:
        under = (F.col("path") == path) | F.col("path").startswith(path.rstrip("/") + "/")
        rows = rows.join(files.filter(under).select("repo_id", "sha").distinct(), ["repo_id", "sha"], "left_semi")
    if branch:
        rows = rows.join(reached.filter(F.col("branch") == branch).select("repo_id", "sha"), ["repo_id", "sha"], "left_semi")
    if since is not None:
        rows = rows.filter(F.col("author_date") >= F.lit(since).cast("timestamp"))
    if until is not None:
        rows = rows.filter(F.col("author_date") <= F.lit(until + "T23:59:59" if len(until) == 10 else until).cast("timestamp"))
    if merge is not None:
        rows = rows.filter(F.col("is_merge") == merge)
    if author:
        rows = rows.filter(F.contains(F.lower("author_name"), F.lit(author.lower())))
    rows = rows.withColumn("position", F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("author_date"), F.desc("sha"))))
    page = rows.filter(F.col("position") <= offset + limit + 1)
    more = page.filter(F.col("position") == offset + limit + 1).select("repo_id", F.lit(True).alias("more"))
    page = page.filter((F.col("position") > offset) & (F.col("position") <= offset + limit)).drop("files")
    return page.join(more, "repo_id", "left").withColumn("has_more", F.coalesce("more", F.lit(False))).drop("more")


def tree_as_of(snapshots: DataFrame, head: DataFrame, days: Sequence[int] = (7, 30, 90)) -> DataFrame:
    """For each repository and number of days the last snapshot at or before ``head.as_of`` less the days.

    ``snapshots`` has (repo_id, sha, committed_at), ``head`` (repo_id, as_of).
    Repositories without such a snapshot have null ``sha``.
    """
    marks = head.select("repo_id", "as_of", F.explode(F.array(*[F.lit(d) for d in days])).alias("days_ago"))
    marks = marks.withColumn("until", F.col("as_of") - F.make_dt_interval(F.col("days_ago")))
    commits = snapshots.select("repo_id", "sha", "committed_at").distinct()
    seen = commits.join(marks, "repo_id").filter(F.col("committed_at") <= F.col("until"))
    last = seen.groupBy("repo_id", "days_ago").agg(F.max_by("sha", F.struct("committed_at", "sha")).alias("sha"))
    return marks.select("repo_id", "days_ago").join(last, ["repo_id", "days_ago"], "left")


def tree_evolution(snapshots: DataFrame, head: DataFrame, days: Sequence[int] = (7, 30, 90), sample: int = 20) -> DataFrame:
    """Files and directories at each mark and at ``head.sha``, what was added and removed, and a sample of each."""
    marks = tree_as_of(snapshots, head, days)
    trees = snapshots.select("repo_id", "sha", "path").distinct()
    then = marks.filter(F.col("sha").isNotNull()).join(trees, ["repo_id", "sha"]).select("repo_id", "days_ago", "path", F.lit(1).alias("before"))
    now = marks.filter(F.col("sha").isNotNull()).select("repo_id", "days_ago").join(head.select("repo_id", "sha"), "repo_id").join(trees, ["repo_id", "sha"]).select("repo_id", "days_ago", "path", F.lit(1).alias("now"))
    both = then.join(now, ["repo_id", "days_ago", "path"], "full_outer")
    added, removed = F.col("before").isNull(), F.col("now").isNull()
    folder = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", ""))
    out = both.groupBy("repo_id", "days_ago").agg(
        F.count("before").alias("files_before"), F.count("now").alias("files_now"),
        F.count(F.when(added, 1)).alias("files_added"), F.count(F.when(removed, 1)).alias("files_removed"),
        F.countDistinct(F.when(~added, folder)).alias("directories_before"), F.countDistinct(F.when(~removed, folder)).alias("directories_now"),
    )

    def first(cond: Column, name: str) -> DataFrame:
        rows = first_of(both.filter(cond).select("repo_id", "days_ago", "path"), ["repo_id", "days_ago"], [F.asc("path")], sample)
        return rows.groupBy("repo_id", "days_ago").agg(F.array_sort(F.collect_list("path")).alias(name))

    out = marks.join(out, ["repo_id", "days_ago"], "left").join(first(added, "sample_added"), ["repo_id", "days_ago"], "left").join(first(removed, "sample_removed"), ["repo_id", "days_ago"], "left")
    empty = F.array().cast("array<string>")
    return out.withColumn("available", F.col("sha").isNotNull()).withColumn("sample_added", F.when(F.col("available"), F.coalesce("sample_added", empty))).withColumn("sample_removed", F.when(F.col("available"), F.coalesce("sample_removed", empty)))


def compare_snapshots(before: DataFrame, after: DataFrame) -> DataFrame:
    """Added, modified, deleted and renamed paths between two trees (repo_id, path, content_hash, content).

    Lines are counted as a shortest line diff has them; a null content (as of a
    binary file) has none.  Equal contents under a deleted and an added path are a
    rename; of several the first paths are paired in order.  Sensitive paths are
    marked as redacted.
    """
    old = before.select("repo_id", "path", F.col("content_hash").alias("h0"), line_hashes(F.col("content")).alias("l0"))
    both = old.join(after.select("repo_id", "path", F.col("content_hash").alias("h1"), line_hashes(F.col("content")).alias("l1")), ["repo_id", "path"], "full_outer").filter(~F.col("h0").eqNullSafe(F.col("h1")))
    both = both.withColumns({n: F.coalesce(F.size(c), F.lit(0)).cast("long") for n, c in (("n0", "l0"), ("n1", "l1"))})
    # What differs is written once, and its lines only where both sides have the path.
    kept = F.col("h0").isNotNull() & F.col("h1").isNotNull()
    both = checkpointed(both.withColumns({n: F.when(kept, F.col(n)) for n in ("l0", "l1")}))
    # A content's paths meet in one shuffle: those gone and those new are numbered apart, and equal numbers are a pair.
    alone = both.filter(~kept).select("repo_id", F.coalesce("h0", "h1").alias("hash"), "path", F.col("h1").isNull().alias("gone"), "n0", "n1").repartition("repo_id", "hash")
    alone = alone.withColumn("k", F.row_number().over(Window.partitionBy("repo_id", "hash", "gone").orderBy("path")))
    new, gone = F.when(~F.col("gone"), F.col("path")), F.when(F.col("gone"), F.col("path"))
    pairs = alone.groupBy("repo_id", "hash", "k").agg(F.max(new).alias("path"), F.max(gone).alias("old_path"), F.max(F.when(F.col("gone"), F.col("n0"))).alias("n0"), F.max(F.when(~F.col("gone"), F.col("n1"))).alias("n1"))
    status = F.when(F.col("path").isNull(), "D").when(F.col("old_path").isNull(), "A").otherwise("R")
    moved = pairs.select(
        "repo_id", status.alias("status"), F.when(status == "R", 100).alias("similarity"), F.coalesce("path", "old_path").alias("path"), F.when(status == "R", F.col("old_path")).alias("old_path"),
        F.when(status == "A", F.col("n1")).otherwise(0).alias("additions"), F.when(status == "D", F.col("n0")).otherwise(0).alias("deletions"),
    )
    changed = both.filter(kept).withColumn("same", common_lines(F.col("l0"), F.col("l1")))
    changed = changed.select("repo_id", F.lit("M").alias("status"), F.lit(None).cast("int").alias("similarity"), "path", F.lit(None).cast("string").alias("old_path"), (F.col("n1") - F.col("same")).alias("additions"), (F.col("n0") - F.col("same")).alias("deletions"))
    out = moved.unionByName(changed)
    return out.withColumn("redacted", is_sensitive_path(F.col("path")) | F.coalesce(is_sensitive_path(F.col("old_path")), F.lit(False)))


def budgeted_diffs(diffs: DataFrame, *, most_bytes: int = 240_000, most_files: int = 30) -> DataFrame:
    """Diffs (repo_id, ord, path, diff) of each repository in order within a budget of bytes and files.

    The file that overflows the budget is cut; those after it have empty diffs.
    """
    order = Window.partitionBy("repo_id").orderBy("ord")
    size = F.octet_length(F.encode("diff", "UTF-8"))
    rows = first_of(diffs, ["repo_id"], [F.asc("ord")], most_files).withColumn("before", F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    left = F.greatest(F.lit(most_bytes) - F.col("before"), F.lit(0))
    # A cut inside a character takes that character out, as a decoder that skips bad bytes would.
    cut = F.regexp_replace(F.make_valid_utf8(F.substring(F.encode("diff", "UTF-8"), F.lit(1), left.cast("int")).cast("string")), "\ufffd+$", "")
    return rows.withColumn("diff_truncated", size > left).withColumn("diff", F.when(size > left, cut).otherwise(F.col("diff"))).drop("before")
