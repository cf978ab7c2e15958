"""Each text is parsed once whatever follows, rewrites are judged without a second tree where they may, and texts of orders take one shuffle."""

import pytest
from pyspark.sql import functions as F

from repolytics.operators import pyast
from repolytics.plans import code_queries

TEXT = "import a.b\nimport a.b\nfrom . import c\ndef f(x): return x\nclass f: pass\ndef g(): pass\n"


def parses(df):
    return df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython [")


@pytest.mark.parametrize("name", ["api_surface", "python_function_metrics", "structural_check"])
def test_a_text_is_parsed_once(spark, sf_dir, name):
    # A filter made of what follows would parse it again; the check writes what it reads thrice.
    assert parses(code_queries.QUERIES[name](spark, sf_dir)) == (0 if name == "structural_check" else 1)


def test_structure_of_a_text(spark):
    files = spark.createDataFrame([("r", "a/m.py", TEXT), ("r", "a/n.py", "def (")], "repo_id string, path string, content string")
    got = {(r.path, r.problem, r.detail) for r in pyast.structural_check(files, files.select("repo_id", "path")).collect()}
    assert got == {("a/m.py", "duplicate_name", "f"), ("a/m.py", "unresolved_import", "a.b"), ("a/n.py", "syntax", None)}


BLANKS = ["x = 1  \n\n\n\n\ny = 2", "if a:\n\tb = 'it'\t\n\n\n \n\n\tc = 1", "s = '''a  \n\n\n\n\n b'''  ", "t = f'{x = }'  \n", "t = f'{\n x = \n\n\n\n}'", "a = 'x\x0c  y  \x0c'", "y = 1 + \\\n    2  ", "def (  ", "q = '\\\n  \n'", "x = 1\r\n  \r\n\r\n\r\n\r\n"]


@pytest.mark.parametrize("text", BLANKS)
def test_rewrites_without_a_second_tree_are_those_with_one(text, monkeypatch):
    got = pyast.rewrites_of(text, True)
    monkeypatch.setattr(pyast, "_LONG_TOKENS", pyast.re.compile(""))
    assert got == pyast.rewrites_of(text, True)
    assert all(pyast._same_tree(pyast._tree_of(text), pyast._tree_of(new)) for new in got.values())


def test_a_plain_text_has_one_tree(monkeypatch):
    trees = []
    tree_of = pyast._tree_of
    monkeypatch.setattr(pyast, "_tree_of", lambda t: trees.append(t) or tree_of(t))
    assert set(pyast.rewrites_of(BLANKS[0], True)) == {"final_newline", "trailing_whitespace", "blank_lines"} and len(trees) == 1


def test_statements_repeat_no_line(spark, tmp_path):
    spark.createDataFrame([(1, 5), (2, 9)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    lines = [(1, 2, 7, 3, 4.0), (1, 1, 8, 3, 50.0), (1, 2, 7, 3, 4.0), (2, 1, 7, 4, 1.0), (3, 1, 1, 1, 1.0)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = code_queries.statements(spark, str(tmp_path)).orderBy("o", "k").collect()
    assert [tuple(r) for r in got] == [("repo-1", 1, 1, 8, 3, 50), ("repo-1", 1, 2, 7, 3, 4), ("repo-2", 2, 1, 7, 4, 1)]
    text = code_queries.python_files(spark, str(tmp_path)).filter(F.col("path") == "pkg/o1.py").first().content
    assert text.startswith("import pkg.o8\ndef f8(a, b):\n    a = a + 1\n") and text.endswith("class k_8(Base):\n    x = Column(1)\n    def go(self):\n        pass\nLIMIT_3 = os.getenv('VAR_3')\nimport pkg.o7\ndef f7(a, b):\n    if a:\n        return g3(tmp(b))\n    return C3(a)\n")
