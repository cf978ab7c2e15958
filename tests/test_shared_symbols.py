"""Symbols and calls are found once, and of prefixes only those are made that something is as long as."""

from repolytics.operators import resolve
from repolytics.plans import ref_queries


def test_parts_meet_themselves_at_hand(spark, sf_dir):
    plan = ref_queries.part_edges(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan


def test_prefixes_of_lengths_that_are_there(spark):
    calls = spark.createDataFrame([("r", "a.ts", 1, "get", "/api/users/long/x"), ("r", "b.ts", 2, "POST", "/api/u"), ("r", "c.ts", 3, "GET", "/abc"), ("s", "d.ts", 4, "GET", "/api/users")], "repo_id string, file string, line int, method string, path string")
    routes = spark.createDataFrame([("r", 2, "GET", "/api/users/", "x.ts"), ("r", 1, "ALL", "/api/users/longer", "y.ts"), ("r", 0, "ALL", "/", "z.ts")], "repo_id string, ord int, method string, path string, file string")
    met = resolve.match_calls_to_routes(calls, routes)
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" not in plan and "filter([1,10,17]" in plan
    assert {(x.file, x.route, x.route_file) for x in met.collect()} == {("a.ts", "/api/users/", "x.ts"), ("b.ts", "/api/users/longer", "y.ts")}
    assert resolve.match_calls_to_routes(calls, routes.limit(0)).count() == 0
