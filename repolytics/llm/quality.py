"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network.

A word falls into one of ``BUCKETS`` buckets; each bucket has a sparse random
index vector, and its context vector is the sum of the index vectors of all words
that stand within ``REACH`` words of it anywhere in the corpus.  A task adds up
its own rows, so what is shuffled is a table of ``BUCKETS`` rows a task.  A
document pools its words' vectors (rare words count more) beside the shares of
its token shapes.  The network is fitted on a bounded sample of labelled rows;
a part of them, which the weights don't see, sets the temperature.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolytics.llm import codepoints
from repolytics.llm.common import saved, text_slices
from repolytics.llm.langid import held_out
from repolytics.llm.sample import SAMPLE_ROWS, labelled_sample

BUCKETS = 1 << 13
WIDTH = 32
REACH = 2
SHAPES = 8
SLICE_BYTES = 2 << 20
HIDDEN = 24
COMMON = 1e-3
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Tokens:
    bucket: np.ndarray
    shape: np.ndarray
    length: np.ndarray
    owner: np.ndarray


def index_vectors(seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Two places and two signs of each bucket's index vector."""
    rng = np.random.default_rng(seed)
    place = np.stack([rng.integers(0, WIDTH // 2, BUCKETS), rng.integers(WIDTH // 2, WIDTH, BUCKETS)], 1)
    return place, rng.choice([-1.0, 1.0], (BUCKETS, 2)).astype(np.float32)


def tokenize(texts: Sequence[str | None]) -> Tokens:
    """Runs of letters, of numbers and of other signs; a run of signs ends where the sign changes."""
    points, starts = codepoints.joined(texts)
    kind = codepoints.letters()[points]
    group = np.array([3, 1, 1, 2, 0], np.int64)[kind]
    key = np.where(group == 3, points.astype(np.int64) + 4, group)
    edge = np.r_[True, key[1:] != key[:-1]]
    begin = np.flatnonzero(edge)
    end = np.r_[begin[1:], len(points)]
    real = group[begin] > 0
    begin, end = begin[real], end[real]
    low = codepoints.lower()[points]
    total = np.zeros(len(points) + 1, np.uint64)
    with np.errstate(over="ignore"):
        # Bag of letters with their place in the word: a sum that is the same wherever the word stands.
        at = np.arange(len(points)) - np.repeat(np.flatnonzero(edge), np.diff(np.r_[np.flatnonzero(edge), len(points)]))
        x = (low.astype(np.uint64) + np.uint64(1)) * (_MIX + (at.astype(np.uint64) << np.uint64(17)))
        x ^= x >> np.uint64(29)
        np.cumsum(x * np.uint64(0xBF58476D1CE4E5B9), out=total[1:])
        hashed = (total[end] - total[begin]) * _MIX
    bucket = (hashed >> np.uint64(51)).astype(np.int64)
    length = end - begin
    upper = np.r_[0, np.cumsum(low != points)]
    ups = upper[end] - upper[begin]
    first = low[begin] != points[begin]
    kinds = group[begin]
    shape = np.select([(kinds == 1) & (ups == 0), (kinds == 1) & (ups == length) & (length > 1), (kinds == 1) & first & (ups == 1), kinds == 1, kinds == 2, length == 1, length == 2], [0, 2, 1, 3, 4, 5, 7], 6)
    return Tokens(bucket, shape, length, np.searchsorted(starts, begin, side="right") - 1)


def _contexts(text: str):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, sign = index_vectors()
        total, seen = np.zeros(BUCKETS * WIDTH), np.zeros(BUCKETS, np.int64)
        for batch in text_slices(batches, text, SLICE_BYTES):
            t = tokenize(batch.column(text).to_pylist())
            seen += np.bincount(t.bucket, minlength=BUCKETS)
            for step in range(1, REACH + 1):
                near = t.owner[step:] == t.owner[:-step]
                left, right = t.bucket[:-step][near], t.bucket[step:][near]
                for one, other in ((left, right), (right, left)):
                    for j in range(2):
                        total += np.bincount(one * WIDTH + place[other, j], sign[other, j], minlength=BUCKETS * WIDTH)
        at = np.flatnonzero(seen)
        table = total.reshape(BUCKETS, WIDTH)[at]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(seen[at], pa.int64()), *(pa.array(table[:, j], pa.float64()) for j in range(WIDTH))], ["bucket", "seen", *(f"c{j}" for j in range(WIDTH))])

    return run


@dataclass
class Vectors:
    table: np.ndarray
    weight: np.ndarray


def word_vectors(docs: DataFrame, *, text: str = "text") -> Vectors:
    """Each bucket's vector, from all of ``docs``: its context, scaled, and its own index vector."""
    schema = "bucket long, seen long, " + ", ".join(f"c{j} double" for j in range(WIDTH))
    parts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(_contexts("text"), schema)
    summed = parts.groupBy("bucket").agg(F.sum("seen").alias("seen"), *[F.sum(f"c{j}").alias(f"c{j}") for j in range(WIDTH)])
    rows = summed.toPandas()  # BUCKETS rows at most
    table, seen = np.zeros((BUCKETS, WIDTH)), np.zeros(BUCKETS)
    if len(rows):
        at = rows["bucket"].to_numpy()
        table[at], seen[at] = rows[[f"c{j}" for j in range(WIDTH)]].to_numpy(), rows["seen"].to_numpy()
    table /= np.maximum(1e-9, np.linalg.norm(table, axis=1, keepdims=True))
    place, sign = index_vectors()
    table[np.arange(BUCKETS)[:, None], place] += sign * 0.5
    return Vectors(table.astype(np.float32), (COMMON / (COMMON + seen / max(1.0, seen.sum()))).astype(np.float32))


FEATURES = WIDTH + SHAPES + 4


def pooled(texts: Sequence[str | None], vectors: Vectors) -> np.ndarray:
    """A row of ``FEATURES`` numbers for each text; a text without tokens has zeros."""
    out = np.zeros((len(texts), FEATURES), np.float32)
    t = tokenize(texts)
    if not len(t.owner):
        return out
    head = np.flatnonzero(np.r_[True, t.owner[1:] != t.owner[:-1]])
    who = t.owner[head]
    n = np.diff(np.r_[head, len(t.owner)])
    w = vectors.weight[t.bucket]
    out[who, :WIDTH] = np.add.reduceat(vectors.table[t.bucket] * w[:, None], head, axis=0) / np.maximum(1e-9, np.add.reduceat(w, head))[:, None]
    shapes = np.bincount(t.owner * SHAPES + t.shape, minlength=len(texts) * SHAPES).reshape(-1, SHAPES)
    out[who, WIDTH : WIDTH + SHAPES] = shapes[who] / n[:, None]
    same = np.r_[False, (t.bucket[1:] == t.bucket[:-1]) & (t.owner[1:] == t.owner[:-1])]
    pairs = np.unique(t.owner * BUCKETS + t.bucket)
    kinds = np.bincount(pairs // BUCKETS, minlength=len(texts))
    out[who, -4] = np.log1p(n)
    out[who, -3] = np.add.reduceat(same.astype(np.float32), head) / n
    out[who, -2] = np.log1p(kinds[who]) / np.log1p(n)
    out[who, -1] = np.add.reduceat(t.length, head) / n
    return out


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1)
        return h @ self.w2 + self.b2

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1, rounded so that they don't hang on how rows are batched."""
        return np.round(1.0 / (1.0 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30))), 6)


def train_network(x: np.ndarray, y: np.ndarray, *, hidden: int = HIDDEN, epochs: int = 80, batch: int = 256, decay: float = 1e-4, seed: int = 5) -> Network:
    """Adam on the logistic loss over four fifths of the rows; the temperature by the rest."""
    rng = np.random.default_rng(seed)
    if not len(y) or len(np.unique(y)) < 2:
        share = float(np.clip(y.mean() if len(y) else 0.5, 0.02, 0.98))
        return Network(np.zeros(x.shape[1]), np.ones(x.shape[1]), np.zeros((x.shape[1], 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))))
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    order = rng.permutation(len(y))
    rest, fit = (order[: len(y) // 5], order[len(y) // 5 :]) if len(y) >= 50 else (order, order)
    z = (x - mean) / scale
    params = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(epochs):
        rate = 5e-3 * (1 - epoch / epochs) + 1e-4
        for i in range(0, len(fit), batch):
            at = rng.permutation(fit)[:batch] if len(fit) <= batch else fit[i : i + batch]
            h = np.tanh(z[at] @ params[0] + params[1])
            p = 1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -30, 30)))
            d = (p - y[at]) / len(at)
            dh = np.outer(d, params[2]) * (1 - h * h)
            step += 1
            for k, g in enumerate((z[at].T @ dh + decay * params[0], dh.sum(axis=0), h.T @ d + decay * params[2], np.array([d.sum()]))):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                params[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        rng.shuffle(fit)
    net = Network(mean, scale, params[0], params[1], params[2], float(params[3][0]))
    logits, target = net.logits(x[rest]), y[rest]
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
    loss = [np.mean(np.logaddexp(0, -logits / t * (2 * target - 1))) for t in grid]
    net.temperature = float(grid[int(np.argmin(loss))])
    return net


def _pool_column(docs: DataFrame, vectors: Vectors, text: str, net: Network | None) -> Column:
    handed = docs.sparkSession.sparkContext.broadcast((vectors, net))

    def parts(batch: pa.Array) -> Iterator[np.ndarray]:
        for part in text_slices([pa.RecordBatch.from_arrays([batch], ["t"])], "t", SLICE_BYTES):
            yield pooled(part.column(0).to_pylist(), handed.value[0])

    if net is None:

        @F.arrow_udf("array<float>")
        def vector(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                yield pa.array([row for x in parts(batch) for row in x.tolist()], pa.list_(pa.float32()))

        return vector(F.col(text))

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(np.concatenate([np.zeros(0), *(handed.value[1].predict(x) for x in parts(batch))]), pa.float64())

    return score(F.col(text))


@dataclass
class QualityModel:
    vectors: Vectors
    net: Network


def fit_quality(docs: DataFrame, labels: DataFrame, learn: Column, *, label: str = "quality", text: str = "text", rows: int = SAMPLE_ROWS) -> QualityModel:
    """Vectors from all of ``docs``; the network from about ``rows`` labelled ones that ``learn`` lets in."""
    vectors = word_vectors(docs, text=text)
    sample = labelled_sample(docs, labels, label, learn, text=text, rows=rows)
    sample = saved(sample.select("doc_id", "label", _pool_column(docs, vectors, "text", None).alias("x")), "quality-sample")
    found = sample.orderBy("doc_id").toPandas()  # about ``rows`` rows of FEATURES numbers
    x = np.array(found["x"].tolist(), np.float64).reshape(-1, FEATURES)
    return QualityModel(vectors, train_network(x, found["label"].to_numpy(np.float64)))


def quality_report(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row.

    Null and empty texts get the score that the network gives to no tokens.
    Without labels of both values the score is the share of label 1 (no labels:
    one half).  Repeated rows score alike; an id with several labels has the
    largest; no rows give no rows.  Columns of other names aren't read.
    """
    out = held_out(F.col("doc_id"), 4, 2)
    model = fit_quality(docs, labels, ~out)
    rows = docs.select("doc_id", out.alias("held_out"), _pool_column(docs, model.vectors, "text", model.net).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
