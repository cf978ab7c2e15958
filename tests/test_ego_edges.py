"""Edges of one hop's neighbourhoods: the same rows as by neighbourhoods, and no row for each file near an edge's source."""

import random
from collections import Counter

import pytest

from repolytics.operators import graph


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(5)
    edges = [(r, f"n{rng.randrange(14)}", f"n{rng.randrange(14)}", rng.choice(["calls", "imports"])) for r in "pq" for _ in range(60)]
    edges += edges[:3] + [("p", None, "n1", "calls"), ("p", "n1", "out", "calls"), ("p", "n2", "out", "calls"), (None, "n1", "n2", "calls")]
    files = [(r, f"n{i}") for r in "pq" for i in range(12)] + [("p", "alone")]
    return spark.createDataFrame(edges, "repo_id string, source string, target string, type string"), spark.createDataFrame(files, "repo_id string, path string")


@pytest.mark.parametrize("relation", [None, "calls"])
def test_same_rows_as_by_neighbourhoods(tables, relation):
    edges, files = tables
    expected = graph.subgraph_edges(edges, graph.neighborhood(edges, files, 1), relation=relation)
    got = Counter(tuple(r) for r in graph.ego_edges(edges, files, relation=relation).select("repo_id", "file", "source", "target").collect())
    assert got == Counter(tuple(r) for r in expected.collect()) and sum(got.values()) > 200


def test_a_hub_makes_no_pairs(spark, monkeypatch):
    """A file that 3000 others name has no rows for each pair of them."""
    edges = spark.createDataFrame([("r", f"f{i}", "hub", "calls") for i in range(3000)], "repo_id string, source string, target string, type string")
    files = edges.selectExpr("repo_id", "source AS path").union(spark.createDataFrame([("r", "hub")], "repo_id string, path string"))
    seen = []
    real = graph.checkpointed
    monkeypatch.setattr(graph, "checkpointed", lambda df: seen.append(real(df)) or seen[-1])
    assert graph.ego_edges(edges, files).count() == 6000
    low = seen[0].selectExpr("CASE WHEN low THEN a ELSE b END AS u").groupBy("u").count()
    assert low.selectExpr("max(count)").first()[0] == 1
