"""SimHash, mixing, fingerprints, token counts, decontamination and line dedup against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from repolytics.llm import common, decontaminate, langid, licenses, linededup, mixing, neardup, quality, queries, simhash, sketch, tokens, toxicity
from repolytics.llm.fmindex import FMIndex
from repolytics.llm.graph import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or ["a"] * len(texts))[i], len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


ODD = [None, "", " \t\n ", "one", "One two", "one two three", "x " * 3000, "ein Äpfel   and \U0001f600 text", "same text here now yes", "same text here now yes"]


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    names = sorted(prints)
    root = {n: n for n in names}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in names}


def test_simhash_matches_brute_force(spark, sf_dir):
    rows = queries.op1_simhash(spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    prints = {i: brute_fingerprint(t) for i, t in texts.items()}
    assert {r.doc_id: r.fingerprint for r in rows} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {r.doc_id: r.component_id for r in rows} == brute_components(prints)


def test_simhash_odd_texts(spark):
    rows = simhash.simhash_components(docs_of(spark, ODD).withColumn("print", F.lit(1))).collect()
    assert {r.doc_id: r.fingerprint for r in rows} == {i: f"{brute_fingerprint(t):016x}" for i, t in enumerate(ODD)}
    by = {r.doc_id: r.component_id for r in rows}
    assert by[0] == by[1] == by[2] == 0 and by[8] == by[9] == 8
    assert simhash.simhash_components(docs_of(spark, [])).count() == 0


def test_links_find_every_pair_within_the_radius(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(30)]
    prints = sorted({b ^ sum(1 << x for x in rng.sample(range(64), k)) for b in base for k in (0, 1, 1, 2, 3, 4)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(s,) for s in signed], "print long")
    found = {r.node: r.component for r in connected_components(simhash.fingerprint_links(df)).collect()}
    expected = brute_components(dict(zip(signed, prints, strict=True)))
    assert {s: found.get(s, s) for s in signed} == {s: min(x for x in signed if expected[x] == expected[s]) for s in signed}


def test_drop_near_duplicates_keeps_one_of_a_group(spark):
    kept = simhash.drop_near_duplicates(docs_of(spark, ["a b c d e f", "a b c d e f", "other words stand here today", None]))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 3] and kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[i] == 100 for i in range(100, 140))
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_mixing_totals_and_caps(spark, sf_dir):
    rows = queries.op3_mixing(spark, sf_dir).collect()
    src = {r.doc_id: r.source for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    by = {}
    for r in rows:
        x = by.setdefault(src[r.doc_id], [0, r.target, 0])
        x[0] += r.taken
        x[2] = max(x[2], r.size)
        assert r.taken <= 3 * r.size and r.target <= 3 * r.source_size + 1e-6
    assert all(abs(taken - target) <= most for taken, target, most in by.values())
    assert sum(target for _, target, _ in by.values()) == pytest.approx(sum(r.size for r in rows))
    assert sorted(map(tuple, rows)) == sorted(map(tuple, queries.op3_mixing(spark, sf_dir).repartition(5).collect()))


def test_mixing_odd_rows(spark):
    df = docs_of(spark, [*ODD, "a b c", "d e"], [None, "a", "b", "b", None, "c", "a", "a", "b", "b", "z", "z"]).withColumn("target", F.lit("x"))
    rows = mixing.mix_sources(df).collect()
    assert len(rows) == 12 and all(r.taken == 0 for r in rows if r.size == 0)
    assert mixing.mix_sources(docs_of(spark, [])).count() == 0
    assert [r.taken for r in mixing.mix_sources(docs_of(spark, [None, ""])).collect()] == [0, 0]


def test_mixing_with_unequal_weights_prefers_heavier_documents(spark):
    df = docs_of(spark, [f"w{i} x y z" for i in range(400)], ["a" if i % 4 else "b" for i in range(400)])
    rows = mixing.mix_sources(df, weights=(1, 6), weight=F.when(F.col("doc_id") < 200, 3.0).otherwise(1.0)).collect()
    heavy, light = (sum(r.copies for r in rows if r.source == "a" and (r.doc_id < 200) == x) for x in (True, False))
    assert heavy > 2 * light
    assert sum(r.taken for r in rows if r.source == "a") == pytest.approx(next(r.target for r in rows if r.source == "a"), abs=4)


def sketch_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.lower())

    def chained(parts):
        seed = 42
        for p in parts:
            seed = xxhash.xxh64_intdigest(p.encode(), seed)
        return seed

    if not words:
        return set()
    hashes = {chained(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) > 5 else {chained([" ".join(words)])}
    return {h for h in hashes if h < 1 << (64 - sketch.FRACTION_BITS)} or {min(hashes)}


def test_fingerprints_match_brute_force(spark, sf_dir):
    table = sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").collect(), key=lambda r: r.doc_id)
    rows = {r.doc_id: r for r in queries.op5_fingerprints(spark, sf_dir).collect()}
    assert len(rows) == len(table)
    for r, nxt in zip(table, table[1:] + table[:1], strict=True):
        n = len(r.text)
        edited = r.text[: n - n // 2] + nxt.text[: n // 2]
        a, b, c = map(sketch_of, (r.text, edited, nxt.text))
        got = rows[r.doc_id]
        assert (got.n_chars, got.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert {got.fingerprint[i : i + 16] for i in range(0, len(got.fingerprint), 16)} == {f"{h:016x}" for h in a}
        assert got.near_edited == pytest.approx(len(a & b) / min(len(a), len(b)))
        assert got.near_next == pytest.approx(len(a & c) / min(len(a), len(c)))


def test_fingerprints_odd_texts(spark):
    rows = {r.doc_id: r for r in sketch.fingerprint_report(docs_of(spark, ODD)).collect()}
    assert rows[0].fingerprint == rows[1].fingerprint == "" and rows[0].near_edited == 1.0
    assert rows[8].fingerprint == rows[9].fingerprint and rows[8].near_next == 1.0
    one = sketch.fingerprint_report(docs_of(spark, ["a b c d"])).collect()[0]
    assert one.edited_sha256 == hashlib.sha256(b"a b a b").hexdigest()
    assert sketch.fingerprint_report(docs_of(spark, [])).count() == 0


def test_next_row_over_many_ranges(spark):
    rows = spark.createDataFrame([(i * 7 % 1000, f"t{i * 7 % 1000}") for i in range(1000)], "doc_id long, text string").withColumn("kept", F.array(F.lit(1)))
    got = {r.doc_id: r.next_text for r in sketch.with_next(rows, bucket_rows=16).collect()}
    assert got == {i: f"t{(i + 1) % 1000}" for i in range(1000)}


def test_sketches_merge(spark):
    df = spark.createDataFrame([("a b c d e f g h i j k l", "z y x w v u t s r q p o n m")], "a string, b string")
    got = df.select(sketch.merge_sketches(sketch.sketch(F.col("a")), sketch.sketch(F.col("b"))).alias("m")).first().m
    union = sketch_of(df.first().a) | sketch_of(df.first().b)
    low = {h for h in union if h < 1 << (64 - sketch.FRACTION_BITS)}
    assert {h % (1 << 64) for h in got} == (low or {min(union)})


def test_token_counts_are_the_library_s(spark, sf_dir):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(tokens.tokenizer_path())
    rows = {r.doc_id: r for r in queries.op6_tokens(spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        assert rows[r.doc_id].n_tokens == len(tk.encode(r.text, add_special_tokens=False)), r.doc_id
        assert rows[r.doc_id].n_bytes == len(r.text.encode()) and rows[r.doc_id].over_limit == (rows[r.doc_id].n_tokens > 1024)


def test_token_counts_of_odd_texts(spark):
    from tokenizers import Tokenizer

    rng = random.Random(1)
    texts = [*ODD, "a<|endoftext|>b <|endoftext|> <|end", "a \n\n  b\t c  d \x1c e  \n", "  lead and trail  \n"]
    texts += ["".join(rng.choice("ab1. \n\t 　\x1fé'<|>") for _ in range(80)) for _ in range(300)]
    tk = Tokenizer.from_file(tokens.tokenizer_path())
    got = {r.doc_id: r.n_tokens for r in tokens.token_report(docs_of(spark, texts)).collect()}
    assert got == {i: len(tk.encode(t or "", add_special_tokens=False)) for i, t in enumerate(texts)}


def test_fm_index_finds_every_occurrence():
    rng = np.random.default_rng(5)
    seq = np.r_[rng.integers(0, 5, 3000), 1, 2, 3, 1, 2, 3, 1, 2, 3, 0]
    index = FMIndex(seq.astype(np.int64), 5, rate=7)
    patterns = rng.integers(1, 5, (200, 4))
    lo, hi = index.search(patterns)
    for p, a, b in zip(patterns, lo, hi, strict=True):
        expected = [i for i in range(len(seq) - 4) if (seq[i : i + 4] == p).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == expected


def brute_leaks(text, items):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hit, found = set(), set()
    for item, body in items:
        iw = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), body or ""))
        n = min(10, len(iw))
        wins = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)} if n else set()
        for i in range(len(words) - n + 1 if n else 0):
            if tuple(words[i : i + n]) in wins:
                hit.update(range(i, i + n))
                found.add("" if item is None else str(item))
    return len(words), len(hit), len(found), decontaminate.digest(sorted(found)), bool(hit)


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_leaks_match_brute_force(spark, block):
    rng = random.Random(2)
    vocabulary = ["alpha", "beta", "gamma", "é", "x1", "zulu"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 3, 12, 15])))) for i in range(6)] + [(3, "beta " * 11), (None, "zulu zulu É!")]
    texts = [*ODD] + [" ".join(rng.choice([*vocabulary, "other", items[4][1], items[2][1]]) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    items = [x for x in items if len((x[1] or "").split()) != 1]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_leaks(docs_of(spark, texts).withColumn("spans", F.lit(1)).repartition(3), bench, shard_bytes=300, block_bytes=block).collect()
    for r in found:
        n, hit, count, digest, any_hit = brute_leaks(r.text, items)
        got = r["_found"]
        assert (got.n_words, sum(s.word_to - s.word_from for s in got.spans), len(got["items"]), decontaminate.digest(got["items"])) == (n, hit, count, digest), r.text
        assert all(a.word_to <= b.word_from for a, b in zip(got.spans, got.spans[1:], strict=False))


def test_decontaminated_texts_are_clean(spark, sf_dir):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    clean = decontaminate.decontaminate(docs, bench)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    assert decontaminate.leak_report(clean, bench).filter("contaminated").count() == 0
    assert decontaminate.leak_report(docs, bench.limit(0)).filter("contaminated").count() == 0


def test_line_dedup_drops_only_site_lines(spark):
    rows = [(i, "h1" if i < 12 else "h2" if i < 20 else None, f"menu\nonly {i}\n\n  menu " if i != 3 else None) for i in range(24)]
    df = spark.createDataFrame(rows, "page_id long, host string, text string").withColumn("pages", F.lit(0))
    got = {r.page_id: r for r in linededup.drop_boilerplate(df, F.col("host"), counts=True).collect()}
    assert got[0].text == "only 0\n" and got[0].n_dropped == 2 and got[0].n_lines == 4
    assert got[3].text is None and got[3].n_lines == 0
    assert got[21].text == "menu\nonly 21\n\n  menu " and got[21].n_dropped == 0
    assert linededup.drop_boilerplate(df.limit(0), F.col("host")).count() == 0


def test_line_dedup_drops_lines_of_small_hosts(spark):
    rows = queries.op9_linededup(spark, "/root/testdata/sf0.01")
    assert rows.agg(F.sum("n_dropped")).first()[0] > 0
    df = spark.createDataFrame([(1, "h", "a\nb"), (2, "h", "a\nc"), (3, "k", "a\nb\na")], "page_id long, host string, text string")
    assert {r.page_id: r.text for r in linededup.drop_boilerplate(df, F.col("host")).collect()} == {1: "b", 2: "c", 3: "a\nb\na"}


CLASHES = (
    "bucket", "last", "mean_weight", "_key", "_odds", "_weight", "_due", "rank", "open", "own", "host", "lines", "kept", "body", "salt", "_salt", "_host", "_drop", "_kept", "pages", "found", "_found",
    "spans", "items", "print", "mask", "variant", "component", "row", "c0", "c1", "blocks", "key", "part", "label", "score", "n_words", "id", "tie", "extra", "next_text", "edited", "n",
)


def test_any_other_columns_stay(spark):
    texts = ["the cat sat on the mat and ran away from here today", "the cat sat on the mat and ran away from here today", "ein Hund und noch ein Hund", None, "menu\nmenu"]
    plain = docs_of(spark, texts).drop("n_chars")
    odd = plain.select("*", *[F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")).alias(c) for c in CLASHES])
    bench = spark.createDataFrame([(1, "the cat sat on the mat and ran away from here")], "item_id long, text string")
    for op in (
        lambda d: mixing.mix_sources(d),
        lambda d: linededup.drop_boilerplate(d, F.col("source")),
        lambda d: decontaminate.decontaminate(d, bench),
        lambda d: decontaminate.find_leaks(d, bench, found="leaks").select(*d.columns),
        lambda d: simhash.drop_near_duplicates(d),
        lambda d: neardup.drop_near_copies(d),
        lambda d: langid.keep_identified(d),
    ):
        expected, got = op(plain), op(odd)
        assert set(odd.columns) <= set(got.columns)
        assert sorted(map(repr, expected.collect())) == sorted(map(repr, got.select(*expected.columns).collect()))
        assert all(r[c] == f"{c}:{r.doc_id}" for r in got.collect() for c in CLASHES)
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(5)], "doc_id long, quality int, toxic int").withColumn("label", F.lit("x")).withColumn("text", F.lit("y"))
    for op in (simhash.simhash_components, licenses.license_report, lambda d: toxicity.toxicity_report(d, labels), sketch.fingerprint_report, tokens.token_report, lambda d: decontaminate.leak_report(d, bench), langid.language_report, lambda d: quality.quality_report(d, labels)):
        assert sorted(map(repr, op(plain).collect())) == sorted(map(repr, op(odd).collect()))


def test_ids_of_any_type(spark):
    df = docs_of(spark, ["a b c d e f", "b c", None, "a b c d e f"]).withColumn("doc_id", F.concat(F.lit("id"), F.col("doc_id").cast("string")))
    labels = spark.createDataFrame([(f"id{i}", i % 2, i % 2) for i in range(4)], "doc_id string, quality int, toxic int")
    bench = spark.createDataFrame([(1, "x")], "item_id long, text string")
    for op in (simhash.simhash_components, licenses.license_report, lambda d: toxicity.toxicity_report(d, labels), sketch.fingerprint_report, tokens.token_report, lambda d: decontaminate.leak_report(d, bench), langid.language_report, lambda d: quality.quality_report(d, labels), mixing.mix_sources, neardup.drop_near_copies):
        assert op(df).count() == (3 if op is neardup.drop_near_copies else 4)


def test_saved_needs_a_shared_folder(spark):
    class Cluster:
        conf = {}
        sparkContext = type("C", (), {"master": "yarn"})

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Cluster)


def test_words_of_a_block_under_another_base(monkeypatch):
    """A collision of two words' hashes only costs another base."""
    real, tried = decontaminate._same_words, []
    monkeypatch.setattr(decontaminate, "_same_words", lambda *a: len(tried) > 1 and real(*a) if tried.append(1) is None else None)
    windows = decontaminate.Windows([("i", "one two three")], 10)
    assert len(tried) > 1 and windows.base % 2 == 1
    assert decontaminate.search_shard(["so one two three four"], windows)[0] == (5, [(1, 4, 3, 16)], ["i"])


def test_line_dedup_without_broadcast_is_the_same(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    a = sorted(map(tuple, linededup.drop_boilerplate(docs, F.col("source")).collect()))
    monkeypatch.setattr(linededup, "BROADCAST_LINES", -1)
    assert a == sorted(map(tuple, linededup.drop_boilerplate(docs, F.col("source")).collect()))


def test_licenses_match_brute_force():
    rng = random.Random(6)
    matcher = licenses.Matcher()

    def brute(text):
        units = [*text.split("\n"), *re.split(r"\n(?:[ \t\r]*\n)+", text), text]
        best = {}
        for u in units:
            a = licenses.bigrams(u)
            met = [(2 * len(a & b) / (len(a) + len(b)), name) for name, t in licenses.TEMPLATES for b in [licenses.bigrams(t)]]
            nearest = max(score for score, _ in met)
            for score, name in met:
                if score >= 0.8 and score == nearest:
                    best[name] = max(score, best.get(name, 0))
        return sorted(best.items())

    for _ in range(300):
        parts = []
        for _ in range(rng.randint(1, 4)):
            words = rng.choice(licenses.TEMPLATES)[1].split()
            for _ in range(rng.randint(0, 3)):
                words.insert(rng.randrange(len(words) + 1), rng.choice(["foo", "the", "of"]))
            parts.append(rng.choice([" ", " ", "\n"]).join(words))
        text = rng.choice(["\n", "\n\n", "\n \n"]).join(parts)
        assert matcher.text(text) == brute(text), text


def test_licenses_odd_texts(spark):
    rows = {r.doc_id: r for r in licenses.license_report(docs_of(spark, [*ODD, "x\nreleased UNDER the MIT-license!\ny", "ALL RIGHTS RESERVED"])).collect()}
    assert [rows[i].n_licenses for i in range(len(ODD))] == [0] * len(ODD) and rows[0].license is None and rows[0].score == 0
    assert rows[10].license == "mit" and rows[10].score == 1.0 and rows[11].licenses == "all-rights-reserved"
    assert licenses.license_report(docs_of(spark, [])).count() == 0
