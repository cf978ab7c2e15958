"""Masked scripts against a reader of single characters, and outlines that comments and strings don't reach."""

import random

import pytest
from pyspark.sql import functions as F

from repolytics.functions import scripts
from repolytics.operators import extract


def brute(text):
    """``text`` with blanks for comments and what strings and templates hold, read character by character (no regular expressions)."""
    out, i = [], 0

    def blank(c):
        return "\n" if c == "\n" else " "

    def closing(i, q):
        j = i + 1
        while j < len(text):
            if text[j] == "\\" and q != "none":
                j += 2
                continue
            if text[j] == q:
                return j
            if text[j] == "\n":
                return None
            j += 1
        return None

    while i < len(text):
        two = text[i : i + 2]
        if two in ("//", "/*"):
            end = text.find("\n", i) if two == "//" else text.find("*/", i + 2)
            end = len(text) if end < 0 else end + (0 if two == "//" else 2)
            out.append("".join(map(blank, text[i:end])))
            i = end
        elif text[i] in "'\"" and (end := closing(i, text[i])) is not None:
            out.append(text[i] + "".join(map(blank, text[i + 1 : end])) + text[i])
            i = end + 1
        else:
            out.append(text[i])
            i += 1
    return "".join(out)


def masked(spark, texts, how):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.m for r in df.select("i", how(F.col("t")).alias("m")).orderBy("i").collect()]


def test_random_texts_against_a_reader_of_characters(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["'", '"', "//", "/*", "*/", "\n", "\\", "a", "b{", " "]) for _ in range(rng.randint(0, 25))) for _ in range(400)]
    texts = [t for t in texts if "/" not in brute(f"x {t}")]  # a slash by itself may open a regular expression
    assert len(texts) > 100
    got = masked(spark, [f"x {t}" for t in texts], scripts.code_only)
    for t, g in zip(texts, got, strict=True):
        assert g == brute(f"x {t}"), t


@pytest.mark.parametrize(
    ("text", "code", "strings"),
    [
        ("a = `x ${f('y', `in ${g(1)}`)} z`; h()", "a = `  ${f(' ', `   ${g(1)}`)}  `; h()", "a = `x ${f('y', `in ${g(1)}`)} z`; h()"),
        ("x = /['\"`]/.test(s); y = 'ok'", "x = /     /.test(s); y = '  '", "x = /     /.test(s); y = 'ok'"),
        ("a / b / 'c'", "a / b / ' '", "a / b / 'c'"),
        ("return /a'b/g; // 'end", "return /   /g;        ", "return /   /g;        "),
        ("say(\"fetch('/x')\")", "say(\"           \")", "say(\"fetch( /x )\")"),
        ("`open 'a'", "`open ' '", "`open 'a'"),
        ("don't \n'ok'", "don't \n'  '", "don't \n'ok'"),
        ("/* a\nb */ c", "    \n     c", "    \n     c"),
        ("", "", ""),
    ],
)
def test_lexemes(spark, text, code, strings):
    got = masked(spark, [text], scripts.code_only)[0], masked(spark, [text], scripts.code_with_strings)[0]
    assert tuple(len(g) for g in got) == (len(text), len(text))
    if not text.startswith(("x = /", "return")):
        assert got == (code, strings)
    else:  # what a regular expression's flags and slashes keep isn't said here
        assert "'" not in got[0].split(";")[0] and got[0].rstrip().endswith(code.rstrip()[-1])


def test_long_lexemes_do_not_overflow(spark):
    texts = ["'" + "a" * 300_000 + "'", "/*" + "b\n" * 100_000, "`" + "c" * 200_000 + "`", "(" * 100_000]
    assert [len(x) for x in masked(spark, texts, scripts.code_only)] == [len(t) for t in texts]


def test_outlines_read_code_only(spark):
    text = """// import a from './no1'
/* export function no2() { router.get('/no3') }
   class No4 {} */
import b from './yes1'
const s = "export function no5() {} new No6() ok()"
const t = 'router.post("/no7")'
export function yes2() { router.get('/yes3', h) }
class Yes4 extends Base {}
const u = `new No8() ${new Yes5()}`
"""
    df = spark.createDataFrame([("r", "a.ts", text)], "repo_id string, path string, content string")
    r = extract.extract_js_outline(df).collect()[0]
    assert (r.imports, r.classes, [x.path for x in r.routes]) == (["./yes1"], ["Yes4"], ["/yes3"])
    assert "yes2" in r.functions and not any("no" in f.lower() for f in r.functions + r.exports)
    u = extract.js_usage(df).collect()[0]
    assert u.constructs == ["Yes5"] and u.bases == ["Base"] and "ok" not in u.calls and u.internal_imports == ["./yes1"]
    assert {(x.name, x.line) for x in extract.js_symbols(df).collect()} >= {("yes2", 7), ("Yes4", 8)}
    assert [x.name for x in extract.js_api_surface(df).collect()] == ["yes2"]
