"""Near copies of the pipeline against brute force over whole shingle sets."""

import random
import re

import corpus_pipeline
import numpy as np
import pytest

from repolytics.llm import neardup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_kept(texts):
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for b in range(len(texts)):
        for a in range(b):
            both = len(sets[a] & sets[b])
            if sets[a] == sets[b] or 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {find(i) for i in range(len(texts))}


def copy_at(rng, words, at):
    """The words with new ones put in, here and there, down to a similarity of ``at`` and no further."""
    whole, best, out = shingles(" ".join(words)), words, words
    while True:
        out = list(out)
        out[rng.randrange(len(out))] = f"new{rng.random()}"
        other = shingles(" ".join(out))
        if len(whole & other) / len(whole | other) < at:
            return best
        best = out


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in enumerate(texts)], DOCS)


def planted():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    texts, copies = [], []
    for at in (0.8, 0.85, 0.9, 0.95):
        for n in (60, 150, 400):
            base = [rng.choice(vocabulary) for _ in range(n)]
            texts.append(" ".join(base))
            copies.append(len(texts))
            texts.append(" ".join(copy_at(rng, base, at)))
            texts.append(" ".join(copy_at(rng, base, 0.6)))
    texts += [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 80))) + " " + passage for _ in range(60)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    texts += [" ".join(copy_at(rng, base, rng.choice([0.81, 0.9]))) for _ in range(30)] + [" ".join(base)] + [" ".join(copy_at(rng, base, 0.81)) for _ in range(30)]
    return [*texts, None, "", " \n", "one two", "One  two", "a b c d e f"], copies


@pytest.mark.parametrize(("tile", "hot"), [(1024, 20_000), (8, 20)])
def test_stage_finds_planted_copies(spark, monkeypatch, tile, hot):
    monkeypatch.setattr(neardup, "TILE_TEXTS", tile)
    monkeypatch.setattr(neardup, "HOT", hot)
    texts, copies = planted()
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs_of(spark, texts), "").collect()}
    assert not kept & set(copies)
    assert kept == brute_kept(texts)


@pytest.mark.parametrize(("tile", "hot"), [(1024, 20_000), (8, 20)])
def test_copies_of_no_common_centre(spark, monkeypatch, tile, hot):
    monkeypatch.setattr(neardup, "TILE_TEXTS", tile)
    monkeypatch.setattr(neardup, "HOT", hot)
    rng = random.Random(9)
    base = [f"w{rng.randrange(400)}" for _ in range(200)]
    texts = [" ".join(copy_at(rng, base, 0.86)) for _ in range(60)]
    assert {r.doc_id for r in neardup.drop_near_copies(docs_of(spark, texts)).collect()} == brute_kept(texts)


def test_recall_of_copies_by_similarity():
    """Of pairs of a similarity of 0.8 and little more nearly all meet in a block and pass the comparison of bits."""
    rng = random.Random(1)
    for texts in (100, 300_000, 10**9):
        bits, count = neardup.block_plan(texts)
        words = max(2, -(-bits * count // 64))
        met = total = 0
        for _ in range(300):
            base = [str(rng.random()) for _ in range(rng.choice([30, 100, 400]))]
            a, b = (neardup.wide_print(neardup.shingles_of(" ".join(x)), words) for x in (base, copy_at(rng, base, 0.8)))
            apart = np.bitwise_count(a[:2] ^ b[:2]).sum()
            blocks = neardup._blocks(np.stack([a, b]), bits, count)
            met += apart <= neardup.MOST_APART and int(np.bitwise_count(blocks[0] ^ blocks[1]).min()) <= neardup.RADIUS
            total += 1
        assert met / total > 0.97, (texts, met / total)


def test_tiles_find_every_link():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 40, rng.integers(1, 30))) for _ in range(60)]
    sets += [s[:-1] if len(s) > 5 else s for s in sets[:20]]
    prints = np.arange(100, 100 + len(sets))

    def like(i, j):
        both = len(np.intersect1d(sets[i], sets[j]))
        return both * 5 >= 4 * (len(sets[i]) + len(sets[j]) - both)

    def parts(pairs):
        label = list(range(len(sets)))
        for a, b in pairs:
            x, y = sorted((label[a], label[b]))
            label = [x if v == y else v for v in label]
        return label

    for side in (np.zeros(len(sets), int), np.arange(len(sets)) % 2 + 1):
        expected = parts([(i, j) for i in range(len(sets)) for j in range(i) if like(i, j) and (side[i] != side[j] or not side[i])])
        src, dst = neardup.tile_links(prints, sets, side)
        assert parts(zip((src - 100).tolist(), (dst - 100).tolist(), strict=True)) == expected and len(src) < len(sets)


def test_runs_are_walked_as_they_are_compared(monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 62, (4, 2))
    check = np.concatenate([b ^ (1 << rng.integers(0, 62, (40, 2))) ^ (1 << rng.integers(0, 62, (40, 2))) for b in base])
    rng.shuffle(check)
    n = len(check)
    rows = {"print": np.arange(n), "c0": check[:, 0].copy(), "c1": check[:, 1].copy()}
    monkeypatch.setattr(neardup, "MOST_APART", 5)
    found = []
    for short, square, most, step in ((1000, 0, 1, 256), (2, 0, 1, 256), (2, 1000, 1 << 19, 256), (2, 1000, 1 << 19, 7), (2, 1000, 100, 7)):
        for name, value in (("SHORT", short), ("SQUARE", square), ("MOST_PAIRS", most), ("ROWS_AT_ONCE", step)):
            monkeypatch.setattr(neardup, name, value)
        got = neardup._meet(rows, np.arange(n), np.full(n, n))
        found.append(dict(zip(got.column("dst").to_pylist(), got.column("src").to_pylist(), strict=True)))
    assert all(f == found[0] for f in found) and len(found[0]) > 10


def test_small_sets_of_shingles(spark):
    texts = ["a b c d e f g h", "a b c d e f g h i", "a b c d e f g", "x", "X", "", None]
    assert {r.doc_id for r in neardup.drop_near_copies(docs_of(spark, texts)).collect()} == brute_kept(texts)


def test_rows_of_one_id_are_told_apart(spark):
    """A copy goes, and with it no other text of its id."""
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(3, a), (5, a), (5, b), (7, b), (7, b), (None, a), (9, None), (8, ""), (3, a + " more")]
    kept = neardup.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as row", "2 as gone"))
    assert kept.columns == ["doc_id", "text", "row", "gone"]
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    one = [(3, a)] if (3, a) in got else [(3, a + " more")]
    assert got == sorted([*one, (5, b), (None, a), (8, "")], key=str)


def test_sets_under_one_print_are_told_apart(spark):
    rows = spark.createDataFrame([(1, 7, 10), (2, 7, 10), (3, 7, 12), (4, 8, 13)], "doc_id long, print long, print2 long")
    assert {r.doc_id: r.print for r in neardup._told_apart(rows).collect()} == {1: 7, 2: 7, 3: 12, 4: 8}
