"""The pipeline's stages against brute force, one after the other."""

import re
from collections import Counter

import __spark_entry__
import corpus_pipeline
from test_neardup import brute_kept
from test_structure_ops import brute_leaks

from repolytics.llm import langid, linededup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_match_brute_force(spark, sf_dir):
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]

    kept = stages["language_id"](spark, docs, sf_dir)
    model = langid.fit_languages(docs)
    rows = {r.doc_id: r for r in docs.collect()}
    found = dict(zip(rows, langid.label_texts([r.text for r in rows.values()], model), strict=True))
    expected = {i: r for i, r in rows.items() if found[i][0] != "und" and found[i][1] >= 0.5}
    assert kept.columns == COLUMNS and {r.doc_id: r for r in kept.collect()} == expected

    lined = stages["line_dedup"](spark, kept, sf_dir)
    pages = Counter(src for src, _ in {(r.source, r.text) for r in expected.values()})
    held = Counter((src, x) for src, t in {(r.source, r.text) for r in expected.values()} for x in {p.strip(" \t\r") for p in t.split("\n")} if x)

    def ratio(x):
        return [r for n, r in linededup.SOURCE_RATIOS if len(re.split(r"[ \t\r]+", x)) >= n][-1]

    drop = {k for k, n in held.items() if k[0] is not None and n >= 5 and n > ratio(k[1]) * pages[k[0]]}
    texts = {i: "\n".join(x for x in r.text.split("\n") if (r.source, x.strip(" \t\r")) not in drop) for i, r in expected.items()}
    got = {r.doc_id: r for r in lined.collect()}
    assert lined.columns == COLUMNS and {i: r.text for i, r in got.items()} == texts and all(r.n_chars == len(r.text) for r in got.values())

    single = stages["near_dedup"](spark, lined, sf_dir)
    order = sorted(texts)
    singles = {order[i] for i in brute_kept([texts[i] for i in order])}
    assert single.columns == COLUMNS and {r.doc_id for r in single.collect()} == singles

    clean = stages["decontamination"](spark, single, sf_dir)
    got = {r.doc_id: r.text for r in clean.collect()}
    assert clean.columns == COLUMNS and set(got) == singles
    for i, t in got.items():
        assert t == texts[i] if not brute_leaks(texts[i], items)[4] else not brute_leaks(t, items)[4]

    last = stages["mixing"](spark, clean, sf_dir).collect()
    assert {r.doc_id for r in last} <= set(got) and all(r.taken == r.size * r.copies and 0 < r.copies <= 3 for r in last)
    whole = corpus_pipeline.run(spark, sf_dir)
    assert sorted((r.doc_id, r.taken) for r in whole.collect()) == sorted((r.doc_id, r.taken) for r in last)


def test_stages_take_odd_rows(spark):
    df = spark.createDataFrame([(i, t, None, s, None) for i, (t, s) in enumerate([(None, None), ("", "a"), ("x", None), ("the same line\nthe same line", "a"), ("the same line\nthe same line", "a")])] + [(None, "no id here at all", "en", "b", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        for rows in (df, df.limit(0)):
            assert stage(spark, rows, "/root/testdata/sf0.001").count() >= 0, name


def test_registered():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names and {f"op{n}_" for n in range(1, 11)} - {n[: n.index("_") + 1] for n in names if n.startswith("op")} == set()
    assert set(__spark_entry__.oracle_sql()) <= names
