"""Word vectors and pooling of the quality classifier against plain loops; the whole query against them."""

import math
import re

import numpy as np
import pytest

from repolytics.llm import quality

TEXTS = ["The cat sat on the mat, the END!!", "", None, "a a b  a\nB 12 12a ---", "Äpfel und ÄPFEL: straße 3", "the cat", "... ??", "x1y2 mixedCase Word WORD w"]
TOKEN = re.compile(r"[^\W\d_]+|\d+|([^\w\s]|_)\1*")


def tokens_of(text):
    return [m[0] for m in TOKEN.finditer(text or "")]


def bucket(token):
    """A token's bucket, read alone: it hangs on the letters only, not on where the token stands or how it is written."""
    return int(quality.tokenize([token.lower()]).bucket[0])


def shape(token):
    ups = sum(c != c.lower() for c in token)
    if token[0].isalpha():
        return 0 if not ups else 2 if ups == len(token) > 1 else 1 if ups == 1 and token[0] != token[0].lower() else 3
    return 4 if token[0].isdigit() else {1: 5, 2: 7}.get(len(token), 6)


def brute_vectors(texts):
    place, sign = quality.index_vectors()
    table, seen = np.zeros((quality.BUCKETS, quality.WIDTH)), np.zeros(quality.BUCKETS)
    for text in texts:
        b = [bucket(t) for t in tokens_of(text)]
        for i, x in enumerate(b):
            seen[x] += 1
            for k, y in enumerate(b):
                if k != i and abs(k - i) <= quality.REACH:
                    for j in range(2):
                        table[x, place[y, j]] += sign[y, j]
    table /= np.maximum(1e-9, np.linalg.norm(table, axis=1, keepdims=True))
    for x in range(quality.BUCKETS):
        for j in range(2):
            table[x, place[x, j]] += sign[x, j] * 0.5
    return table, quality.COMMON / (quality.COMMON + seen / seen.sum())


def brute_pooled(text, table, weight):
    words = tokens_of(text)
    if not words:
        return np.zeros(quality.FEATURES)
    b = [bucket(t) for t in words]
    n = len(words)
    mean = sum(table[x] * weight[x] for x in b) / max(1e-9, sum(weight[x] for x in b))
    shapes = [sum(shape(t) == k for t in words) / n for k in range(quality.SHAPES)]
    rest = [math.log1p(n), sum(x == y for x, y in zip(b, b[1:], strict=False)) / n, math.log1p(len(set(b))) / math.log1p(n), sum(map(len, words)) / n]
    return np.array([*mean, *shapes, *rest])


@pytest.fixture(scope="module")
def vectors(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)
    return quality.word_vectors(docs)


def test_word_vectors(vectors):
    table, weight = brute_vectors(TEXTS)
    assert np.allclose(vectors.table, table, atol=1e-5) and np.allclose(vectors.weight, weight, atol=1e-6)


def test_pooling(vectors):
    table, weight = brute_vectors(TEXTS)
    got = quality.pooled(TEXTS, vectors)
    for row, text in zip(got, TEXTS, strict=True):
        assert np.allclose(row, brute_pooled(text, table, weight), atol=1e-4), text


def test_the_query_scores_what_the_loops_pool(spark):
    """``quality_report`` of a small table, all by hand but for the fitting of the network."""
    texts = [("good words in a calm line " * (1 + i % 3)).strip() if i % 2 else f"BUY!!! $$$ now {i} >>>" for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    rows = {r.doc_id: r for r in quality.quality_report(docs, labels).collect()}
    table, weight = brute_vectors(texts)
    learn = [i for i in range(60) if not rows[i].held_out]
    x = np.array([brute_pooled(t, table, weight) for t in texts])
    net = quality.train_network(x[learn].astype(np.float32).astype(np.float64), np.array([i % 2 for i in learn], float))
    assert max(abs(net.predict(x)[i] - rows[i].score) for i in range(60)) < 2e-3
    assert all(rows[i].predicted == i % 2 for i in range(60))
