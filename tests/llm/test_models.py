"""Language identification, quality and toxicity: held-out accuracy and small exact cases."""

import itertools
import random
import re
import time
from collections import Counter

import numpy as np
import pytest

from repolytics.llm import langid, quality, queries, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.01"


def auc(scores, labels):
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(scores))
    ranks[order] = np.arange(1, len(scores) + 1)
    for v in np.unique(scores):
        ranks[scores == v] = ranks[scores == v].mean()
    pos = labels == 1
    return (ranks[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    for _ in range(30):
        counts = rng.integers(0, 6, 4)
        scores = rng.normal(0, 3, (int(counts.sum()), 3)).astype(np.float32)
        got, at = langid.viterbi(scores, counts, 2.0), 0
        for n in counts:
            part = scores[at : at + n]

            def total(path, part=part):
                return sum(part[i, x] for i, x in enumerate(path)) - 2.0 * sum(a != b for a, b in itertools.pairwise(path))

            if n:
                assert total(got[at : at + n]) == pytest.approx(max(total(p) for p in itertools.product(range(3), repeat=int(n))), abs=1e-4)
            at += n


def test_language_of_held_out_documents(spark):
    rows = queries.op8_langid(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and len(out) > 150
    assert np.mean([r.lang == r.lang_pred for r in out]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_spans_and_scripts(spark):
    texts = [("the cat and the dog are here with that of the", "en")] * 5 + [("le chat et la maison avec des amis pour une", "fr")] * 5 + [("кошка и дом это было как он", "ru")] * 5
    odd = [None, "", "123 !!", "кошка дом", "the dog and the cat that are here le chat et la maison des amis une", "中文", "the " * 40_000]
    df = spark.createDataFrame([(i, t, g, "s", 0) for i, (t, g) in enumerate(texts + [(t, None) for t in odd])], DOCS)
    model = langid.fit_languages(df)
    assert model.names == ["en", "fr", "ru"]
    got = langid.label_texts(odd, model, penalty=4.0)
    assert [g[0] for g in got[:3]] == ["und"] * 3 and got[3][0] == "ru" and got[6][:2] == ("en", 1.0)
    assert [s[2] for s in got[4][2]] == ["en", "fr"]
    assert odd[4][got[4][2][1][0] :].startswith("le chat")
    assert langid.language_report(df.limit(0)).count() == 0
    kept = langid.keep_identified(df)
    assert kept.columns == df.columns and {r.text for r in kept.collect()}.isdisjoint({None, "", "123 !!"})


def test_quality_of_held_out_documents(spark):
    rows = queries.op10_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality"), "doc_id").filter("held_out").collect()
    assert auc(np.array([r.score for r in rows]), np.array([r.quality for r in rows])) > 0.9
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.9


def test_quality_odd_rows(spark):
    texts = [None, "", "á \U0001f600 $$$ 12", "x " * 50_000, "same same", "same same"]
    df = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts)], DOCS)
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(6)] + [(2, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in quality.quality_report(df, labels).collect()}
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows.values()) and rows[0].score == rows[1].score and rows[4].score == rows[5].score
    assert quality.quality_report(df.limit(0), labels).count() == 0
    assert {r.score for r in quality.quality_report(df, labels.limit(0)).collect()} == {0.5}


def test_temperature_calibrates():
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (4000, 3))
    y = (rng.random(4000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    net = quality.train_network(x, y)
    p = net.predict(x)
    for a, b in ((0.1, 0.3), (0.4, 0.6), (0.7, 0.9)):
        at = (p > a) & (p < b)
        assert abs(p[at].mean() - y[at].mean()) < 0.07


def test_toxicity_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet").filter("doc_id < 3000") for t in ("documents", "labels"))
    rows = toxicity.toxicity_report(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id").filter("held_out").collect()
    assert auc(np.array([r.score for r in rows]), np.array([r.toxic for r in rows])) > 0.9
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.93


def test_obfuscated_words_are_restored(spark):
    words = "the moron and idiot said that stupid scum is a loser or clown in trash with disgusting pathetic worthless talk".split()
    df = spark.createDataFrame([(i, " ".join(words[i % 7 :] + words), None, None, 0) for i in range(40)], DOCS)
    decoder = toxicity.Decoder(toxicity.char_model(df))
    for written, read in {
        "1d10t": "idiot", "1diot": "idiot", "i d i o t": "idiot", "m.o.r.o.n": "moron", "idiiiiiot!!": "idiot", "$tupid": "stupid", "l0ser,": "loser",
        "w0rthle$$": "worthless", "cl0wn***": "clown", "tr@sh": "trash", "st*pid": "stupid", "The&&& scum%%%": "the scum", "": "", "12 $$": "", "1d|0t": "idiot", "2023": "",
    }.items():
        assert toxicity.restore(written, decoder) == read
    got = df.limit(1).select(toxicity.restored(df, decoder.counts).alias("x")).first().x
    assert got == df.first().text


def test_letterless_tokens_are_read(spark):
    df = spark.createDataFrame([(i, "what a lot of people said it is a lost cat that sat at the table", None, None, 0) for i in range(40)], DOCS)
    decoder = toxicity.Decoder(toxicity.char_model(df))
    assert [decoder.restore_token(t) for t in ("54+", "(@7", "***", "...", "$$")] == [("sat",), ("cat",), (), (), ()]


def test_long_tokens_take_time_in_proportion(spark):
    decoder = toxicity.Decoder(np.ones(toxicity.TRIPLES + toxicity.PAIRS))
    start = time.perf_counter()
    assert len(decoder.decode("ab1x0" * 40_000)) > 100_000
    assert time.perf_counter() - start < 10


def test_scores_read_the_restored_text():
    decoder = toxicity.Decoder(np.ones(toxicity.TRIPLES + toxicity.PAIRS))
    restorer = toxicity.Restorer(decoder)
    for text in ("so i d i o t you", "w0rd $tupid m.o.r.o.n", "plain words here"):
        assert restorer.features(text)[0] == dict(Counter(h for w in toxicity.restore(text, decoder).split() for h in toxicity.word_hashes(w)))


def test_every_language_is_learned(spark):
    rows = [(3 * i + k, f"lang{i}a lang{i}b word{i} {'xyz'[i % 3]}{i}", f"l{i:03d}", "s", 0) for i in range(300) for k in range(2)]
    model = langid.fit_languages(spark.createDataFrame(rows, DOCS).repartition(4))
    assert model.names == [f"l{i:03d}" for i in range(300)]
    assert len(langid.label_texts(["a text of words"], model)) == 1


def test_lattice_decode_is_the_cheapest_reading():
    rng = np.random.default_rng(4)
    decoder = toxicity.Decoder(np.round(rng.random(toxicity.TRIPLES + toxicity.PAIRS) * 20))
    for token in ("a1b", "x0x!", "aaab", "a-b3", "0o0"):
        def paid(ways):
            said, total, a, b = "".join(w for w, _ in ways), sum(c for _, c in ways), 0, 0
            for ch in said + " ":
                if ch == " ":
                    total += decoder.price(a, b, 0) if b else 0.0
                    a = b = 0
                else:
                    total += decoder.price(a, b, ord(ch))
                    a, b = b, ord(ch)
            return total, said

        best = min(paid(p) for p in itertools.product(*decoder.lattice(token)))
        got = decoder.decode(token)
        assert got == best[1]


def test_toxicity_odd_rows(spark):
    texts = [None, "", "á \U0001f600 $$$ 12", "x " * 30_000, "you idiot", "you idiot"]
    df = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts)], DOCS)
    labels = spark.createDataFrame([(i, None, i % 2) for i in range(6)] + [(2, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in toxicity.toxicity_report(df, labels).collect()}
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows.values()) and rows[0].score == rows[1].score and rows[4].score == rows[5].score
    assert toxicity.toxicity_report(df.limit(0), labels).count() == 0
    assert {round(r.score, 6) for r in toxicity.toxicity_report(df, labels.limit(0)).collect()} == {0.5}


def test_edges_are_cut_as_by_the_pattern():
    """The scan gives what the pattern that it replaced gave, where that one ended."""
    pattern = re.compile(r"^(?:[\W_]{3,}|[^\w$@!|(*+#&%€£¡<]|_)*|(?:[\W_]{3,}|[^\w$@]|_)*$")
    rng = random.Random(1)
    for _ in range(20_000):
        token = "".join(rng.choice("ab1$@!.-_(é²") for _ in range(rng.randint(0, 9)))
        assert toxicity.without_edges(token) == pattern.sub("", token), token


def test_long_runs_of_signs_end(spark):
    """Rulers and dotted leaders inside a token, through the whole report."""
    n = 100_000
    texts = ["fine words"] * 6 + ["you stupid idiot"] * 6 + ["chapter" + "." * n + "7", "a" + "-" * n + "b", "a" + ".-" * (n // 2) + "b", "_" * n, "x" + "!@" * (n // 2) + "y", "$" * n + "a" + "_" * n, "a " * (n // 2)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 6)) for i in range(12)], "doc_id long, toxic int")
    start = time.perf_counter()
    rows = toxicity.toxicity_report(docs, labels).collect()
    assert {r.doc_id for r in rows} == set(range(len(texts))) and all(0 <= r.score <= 1 for r in rows)
    assert time.perf_counter() - start < 120
