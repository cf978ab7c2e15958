"""The table of steps reads no calls, and what both it and the edges need is written once."""

from repolytics.plans import adapters
from repolytics.plans import code_queries as c
from repolytics.plans import doc_queries as d


def test_steps_without_their_edges(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(adapters, "_written", {})
    monkeypatch.setattr(c, "http_calls", None)
    monkeypatch.setattr(d.extract, "called_names", None)
    assert d.step_table(spark, sf_dir).count() > 0
    assert not [k for k in adapters._written if k[2] == "step_edges"]
    monkeypatch.setattr(d.trace, "step_table", None)
    assert d.step_table(spark, sf_dir).count() > 0
