"""Fill-in-middle against its SQL and a plain cut of whole strings."""

import hashlib
import random
import re

import duckdb
import pytest

from repolytics.llm import fim, queries

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
ODD = [None, "", " ", "one", "  one two\n", "a b c", "  x", "ein Äpfel \U0001f600\U0001f600 text", "has <P> mark", "<S>", "<", "<P <S <M", "same text", "same text", "z" * 200_000, "wort été\n" * 40_000, "\n" * 150_000 + "end  "]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    n, digest = len(units), sha(f"42:{'' if doc_id is None else doc_id}")
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, sha(text), sha(text)
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < 80 else "psm"
    return n, form, len(p), len(m), sha(f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"), sha(text)


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_odd_texts(spark):
    rows = [(i * 100 + k, t) for k, t in enumerate(ODD) for i in range(12)] + [(None, "no id at all"), (7, "a b c"), (7, "a b c")]
    got = [tuple(r) for r in fim.fim_report(docs_of(spark, rows)).collect()]
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert sorted(got, key=str) == sorted([(i, *brute(i, t)) for i, t in rows], key=str)
    assert fim.fim_report(docs_of(spark, [])).count() == 0


def test_query_matches_its_sql(spark, sf_dir):
    got = {tuple(r) for r in queries.op13_fim(spark, sf_dir).collect()}
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    expected = con.execute(f"select doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 from ({fim.SQL})").fetchall()
    assert got == set(expected) and len(expected) == len(got) > 100
    texts = dict(con.execute("select doc_id, text from documents").fetchall())
    assert got == {(i, *brute(i, t)) for i, t in texts.items()}


@pytest.mark.parametrize("size", [1, 7, 64])
def test_small_frames_change_nothing(size):
    rng = random.Random(size)
    for _ in range(400):
        text = "".join(rng.choice(["a", "é", "<", "P", ">", " ", "\n", "\t ", "wort"]) for _ in range(rng.randint(1, 60)))
        frames = fim.frames_of(text.encode(), size)
        assert b"".join(fim.opened(f["data"]) for f in frames).decode() == text
        n = len(UNIT.findall(text))
        assert frames[-1]["units"] == n and frames[-1]["chars"] == len(text)
        h = [rng.getrandbits(32) for _ in range(4)]
        out = fim.fill(frames, h)
        assert b"".join(fim.rebuilt(out["output"], out["form"])).decode() == text
        if out["form"] != "plain":
            a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
            units = UNIT.findall(text)
            assert (out["prefix_chars"], out["middle_chars"]) == (len("".join(units[:a])), len("".join(units[a:b])))


def test_marks_are_found_across_frames():
    whole = b"<P>ab<<S><S c>d<M>e"
    for cut in range(1, len(whole)):
        frames = [fim.packed_frame(whole[:cut]), fim.packed_frame(whole[cut:])]
        assert b"".join(fim.rebuilt(frames, "psm")) == b"ab<e<S c>d"


def test_outputs_open_as_text(spark):
    rows = [(i, f"one two three {i} four  five") for i in range(40)]
    found = fim.fill_in_middle(docs_of(spark, rows).selectExpr("doc_id", "text", "1 as n", "2 as form", "3 as filled"))
    out = found.select("doc_id", "form", fim.frames_text("output").alias("text")).collect()
    texts = dict(rows)
    assert all(sha(r.text) == brute(r.doc_id, texts[r.doc_id])[4] for r in out) and {r.form for r in out} == {"plain", "psm", "spm"}
