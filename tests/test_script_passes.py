"""Script texts are cut once, and what is costly in them isn't worked out again."""

import pytest
from pyspark.sql import functions as F

from repolytics.functions.scalars import splitlines
from repolytics.operators import extract


@pytest.mark.parametrize("text, lines", [("", []), ("\n", [""]), ("a", ["a"]), ("a\r\nb\r", ["a", "b"]), ("a\n\n", ["a", ""]), (None, None)])
def test_lines_of_a_costly_text(spark, text, lines):
    df = spark.createDataFrame([(text,)], "t string").select(splitlines(F.regexp_replace("t", "q", "z")).alias("l"))
    assert df.first()[0] == lines
    # Once in the plan, not in each place that looks at the lines.
    assert df._jdf.queryExecution().analyzed().toString().count("regexp_replace") == 1


def test_one_cut_for_lines_and_code(spark):
    contents = spark.createDataFrame([("r", "a.ts", "f(g(x)) // no()\nh ( 1 )\nnew K(z)\n$a(b)")], "repo_id string, path string, content string")
    plan = extract.js_usage(contents)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(coalesce(content") == 1
    assert extract.js_usage(contents).first()["calls"] == ["$a", "f", "h"]


def test_parts_of_calls(spark):
    text = "FETCH('/a', { method: 'delete' }); axios.Post(`/b/${x}`)\nclient.put('/c') ; fetch('/d')\nrouter.get('/e')\napi.patch( '/f', z); requests.get('http://h/g')"
    contents = spark.createDataFrame([("r", "a.ts", text)], "repo_id string, path string, content string")
    found = {(r.line, r.method, r.path) for r in extract.extract_http_calls(contents).collect()}
    assert found == {(1, "DELETE", "/a"), (1, "POST", "/b/:param"), (2, "PUT", "/c"), (2, "GET", "/d"), (4, "PATCH", "/f"), (4, "GET", "http://h/g")}
