"""Two trees are compared once: what differs is written, and only paths that stand alone are shuffled again."""

from repolytics.operators import history


def test_what_differs_is_shuffled_once(spark):
    def tree(*rows):
        return spark.createDataFrame(rows, "repo_id string, path string, content_hash string, content string")

    old = tree(("r", "a", "1", "x"), ("r", "b", "1", "x"), ("r", "c", "2", "p\nq"), ("r", "d", "3", None), ("r", "same", "9", "s"))
    new = tree(("r", "e", "1", "x"), ("r", "c", "4", "p\nz\ny"), ("r", "f", "5", "k\nl"), ("r", "d", "6", None), ("r", "same", "9", "s"))
    out = history.compare_snapshots(old, new)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 1
    got = {(r.status, r.path, r.old_path, r.additions, r.deletions) for r in out.collect()}
    assert got == {("R", "e", "a", 0, 0), ("D", "b", None, 0, 1), ("M", "c", None, 2, 1), ("A", "f", None, 2, 0), ("M", "d", None, 0, 0)}
