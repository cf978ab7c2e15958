"""The pipeline's line dedup on sources."""

import corpus_pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_passages_of_a_hot_source_go(spark):
    passage = " ".join(f"p{i}" for i in range(55))
    licence = "this line is under a licence"
    rows = []
    for i in range(2000):
        own = f"own words number {i} stand here"
        rows.append((i, "\n".join([own] + [passage] * (i % 100 == 0) + [licence] * (i % 80 == 1) + ["Oh."] * (i % 60 == 2)), "en", "hot", 0))
    rows += [(3000 + i, "one text that is copied whole\nwith a second line of words", "en", "hot", 0) for i in range(40)]
    rows += [(4000 + i, f"other {i}\n{passage}", "en", "small", 0) for i in range(4)]
    df = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r for r in dict(corpus_pipeline.STAGES)["line_dedup"](spark, df, "").collect()}
    texts = {r[0]: r[1] for r in rows}
    for i in range(2000):
        assert got[i].text == "\n".join(x for x in texts[i].split("\n") if x not in (passage, licence)) and got[i].n_chars == len(got[i].text)
    assert all(got[i].text == texts[i] for i in texts if i >= 3000)
