"""Tables of steps leave no shuffles behind, and what was written isn't worked out again."""

import re
import time

from pyspark.sql import functions as F

from repolytics.checkpoints import checkpointed
from repolytics.operators import impact


def _shuffles(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ")
    return set(re.findall(r"shuffle_\d+", blocks))


def test_a_written_table_leaves_no_shuffle(spark):
    before, name = _shuffles(spark), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name, None)
    df = checkpointed(spark.range(20000).groupBy((F.col("id") % 1000).alias("k")).agg(F.count(F.lit(1)).alias("n")))
    for _ in range(50):
        if not _shuffles(spark) - before:
            break
        time.sleep(0.2)
    assert not _shuffles(spark) - before and df.count() == 1000
    assert spark.conf.get(name, None) == was


def _targets(spark, files):
    return spark.createDataFrame([("r", f, f) for f in files], "repo_id string, target string, file string")


def test_levels_and_loops_are_found_once(spark):
    # b and c depend on a, d on both, a on d: two ways to d, and a loop that d closes; e stands alone.
    edges = [("b", "a"), ("c", "a"), ("d", "b"), ("d", "c"), ("a", "d"), ("x", "d")]
    back = spark.createDataFrame([("r", *e) for e in edges], "repo_id string, source string, target string")
    targets = _targets(spark, "abcde")
    null = F.lit(None).cast("string")
    full = targets.select("*", F.lit("file").alias("type"), null.alias("symbol"), null.alias("route"), null.alias("model"), null.alias("env_var"))
    out = impact.transitive_impacts(targets, impact.direct_impacts(full, back), back, max_depth=4)
    assert len(re.findall(r"(?:SortMerge|BroadcastHash|ShuffledHash)Join", out._jdf.queryExecution().executedPlan().toString())) == 1
    got = {(r.file, r.depth, r.impact_type, tuple(r.path), r.cyclic) for r in out.filter("target = 'a'").collect()}
    assert got == {("b", 1, "DIRECT", ("a", "b"), False), ("c", 1, "DIRECT", ("a", "c"), False), ("d", 2, "TRANSITIVE", ("a", "b", "d"), True), ("x", 3, "TRANSITIVE", ("a", "b", "d", "x"), False)}
    none = full.limit(0)
    radius = impact.blast_radius(targets, out, *[none.select("repo_id", "target")] * 3).filter("target in ('a', 'e')").orderBy("target").collect()
    assert [(r.directly_affected, r.transitively_affected, r.total_affected, r.tests_affected) for r in radius] == [(2, 2, 4, 0), (0, 0, 0, 0)] and "cyclic" not in radius[0].asDict()
