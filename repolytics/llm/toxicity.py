"""Toxicity by noisy-channel deobfuscation.

What was written is taken as a clean word that passed a channel: letters may be
replaced by look-alike signs, repeated, or set apart by signs and spaces.  A
suspicious token spans a lattice of readings, each with the channel's cost, and
a Viterbi decode under a character trigram model of the corpus picks the reading.
The restored words, the same as :func:`restore` gives, are then scored.

The character model is counted over all documents; a task adds up its own rows,
so tables of a fixed size are shuffled.  Which words and beginnings of words speak
for the label is learned on a bounded sample of labelled rows, and so is the
logistic score over them.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolytics.llm import codepoints
from repolytics.llm.common import saved, text_slices
from repolytics.llm.langid import held_out
from repolytics.llm.sample import SAMPLE_ROWS, labelled_sample

PAIRS, TRIPLES = 1 << 13, 1 << 17
HASHES = 1 << 18
#: Words and beginnings of words that the score knows.
FEATURES = 4096
PREFIXES = (3, 4, 5, 6, 7, 8)
SLICE_BYTES = 4 << 20
KEPT_TOKENS = 100_000

#: Signs that stand for letters.
LOOKS_LIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i",
    "*": "aeiou", "#": "h", "%": "x", "&": "a",
}
#: Signs that may stand between the letters of a word.
BETWEEN = ".-_~'’·,:;/\\"
COST_SIGN, COST_ANY_VOWEL, COST_KEEP, COST_DOUBLE, COST_SINGLE, COST_BETWEEN = 1.0, 2.0, 9.0, 1.0, 0.3, 0.5
#: A token without any letter is read as a word if that costs less than this for each character.
COST_AS_WRITTEN = 4.0

#: Signs that a word may begin or end with, if fewer than three signs stand there.
FIRST_SIGNS, LAST_SIGNS, MOST_SIGNS = frozenset("$@!|(*+#&%€£¡<"), frozenset("$@"), 2
_SPACED = re.compile(r"(?<![^\W_])[^\W_](?:[ .\-_*~·]{1,2}[^\W_]){2,}(?![^\W_])")
_RUN = re.compile(r"([^\W\d_])\1\1")
_WORD = re.compile(r"[^\W\d_]+")
#: CRC of what is set before a whole word.
_WHOLE = crc32(b"=")
_PLAIN = re.compile(r"[^\W\d_]*\Z")


def _hash3(a, b, c):  # noqa: ANN001, ANN202
    m = 0xFFFFFFFF
    x = (((a * 0x9E3779B1 + b) & m) * 0x85EBCA77 + c) & m
    return ((x ^ (x >> 15)) * 0xC2B2AE3D & m) >> 15


def _hash2(a, b):  # noqa: ANN001, ANN202
    m = 0xFFFFFFFF
    x = (a * 0x9E3779B1 + b) & m
    return ((x ^ (x >> 15)) * 0x85EBCA77 & m) >> 19


def _char_counts(text: str):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(TRIPLES + PAIRS, np.int64)
        for batch in text_slices(batches, text, SLICE_BYTES):
            points, _ = codepoints.joined(batch.column(text).to_pylist())
            is_letter = np.isin(codepoints.letters()[points], (1, 2))
            low = np.where(is_letter, codepoints.lower()[points], 0).astype(np.uint64)
            low = low[(low > 0) | np.r_[True, low[:-1] > 0]]  # one gap between words
            c = np.r_[np.zeros(2, np.uint64), low]
            # A word's first letter has two gaps before it; what ends it is the gap.
            before = np.where(c[1:-1] == 0, 0, c[:-2])
            keep = (c[2:] > 0) | (c[1:-1] > 0)
            a, b, x = before[keep], c[1:-1][keep], c[2:][keep]
            table[:TRIPLES] += np.bincount(_hash3(a, b, x).astype(np.int64), minlength=TRIPLES)
            table[TRIPLES:] += np.bincount(_hash2(a, b).astype(np.int64), minlength=PAIRS)
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(table[at], pa.int64())], ["slot", "held"])

    return run


def char_model(docs: DataFrame, *, text: str = "text") -> np.ndarray:
    """Counts of letter triples and of the pairs before them, hashed, over all of ``docs``."""
    parts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(_char_counts("text"), "slot long, held long")
    table = np.zeros(TRIPLES + PAIRS, np.float64)
    for r in parts.groupBy("slot").agg(F.sum("held").alias("held")).toLocalIterator():  # a table of fixed size
        table[r.slot] = r.held
    return table


def without_edges(token: str) -> str:
    """A token without the signs around it; the few that may be letters of it stay.

    Each edge is looked at once, from outside.
    """
    first = 0
    while first < len(token) and not token[first].isalnum():
        first += 1
    start = first
    if first <= MOST_SIGNS:
        start = next((i for i in range(first) if token[i] in FIRST_SIGNS), first)
    last = end = len(token)
    while last > start and not token[last - 1].isalnum():
        last -= 1
    if end - last > MOST_SIGNS:
        return token[start:last]
    while end > last and token[end - 1] not in LAST_SIGNS:
        end -= 1
    return token[start:end]


class Decoder:
    """Readings of tokens under the channel and the character model."""

    def __init__(self, counts: np.ndarray) -> None:
        self.counts = counts
        self.known: dict[tuple[int, int, int], float] = {}

    def price(self, a: int, b: int, c: int) -> float:
        """Negative log probability of the letter ``c`` (0: the word ends) after ``a`` and ``b``."""
        key = (a, b, c)
        if key not in self.known:
            if len(self.known) > KEPT_TOKENS:
                self.known.clear()
            three, two = self.counts[_hash3(a, b, c)], self.counts[TRIPLES + _hash2(a, b)]
            self.known[key] = -float(np.log(0.98 * three / (two + 1.0) + 0.02 / 200))
        return self.known[key]

    def lattice(self, token: str) -> list[list[tuple[str, float]]]:
        """For each run of one character the readings and their costs."""
        out: list[list[tuple[str, float]]] = []
        i = 0
        while i < len(token):
            j = i
            while j < len(token) and token[j] == token[i]:
                j += 1
            c, n = token[i], j - i
            if c.isalpha():
                if n == 1:
                    ways = [(c, 0.0)]
                elif n == 2:
                    ways = [(c * 2, 0.0), (c, COST_DOUBLE)]
                else:
                    ways = [(c, COST_SINGLE), (c * 2, COST_DOUBLE), (c * n, COST_KEEP)]
            else:
                each = COST_ANY_VOWEL if c == "*" else COST_SIGN
                ways = [(" ", COST_KEEP)]
                for x in LOOKS_LIKE.get(c, ""):
                    ways.append((x, each))
                    if n > 1:
                        ways.append((x * 2, each))
                if c in BETWEEN or c == " ":
                    ways.append(("", COST_BETWEEN))
            out.append(ways)
            i = j
        return out

    def cheapest(self, token: str) -> tuple[float, str]:
        """The cheapest reading and its cost; spaces part words.

        A state is the last two letters; each keeps its cost and the way back, so
        the time grows with the token's length.
        """
        paths: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for ways in self.lattice(token):
            nexts: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (paid, back) in paths.items():
                for text, cost in ways:
                    x, y, total = a, b, paid + cost
                    for ch in text:
                        if ch == " ":
                            if y:
                                total += self.price(x, y, 0)
                            x = y = 0
                        else:
                            c = ord(ch)
                            total += self.price(x, y, c)
                            x, y = y, c
                    if (x, y) not in nexts or total < nexts[x, y][0]:
                        nexts[x, y] = (total, (back, text))
            paths = nexts
        cost, back = min(((paid + (self.price(a, b, 0) if b else 0.0), back) for (a, b), (paid, back) in paths.items()), key=lambda x: x[0])
        said = []
        while back is not None:
            back, text = back
            said.append(text)
        return cost, "".join(reversed(said))

    def decode(self, token: str) -> str:
        """The cheapest reading."""
        return self.cheapest(token)[1]

    def restore_token(self, token: str) -> tuple[str, ...]:
        """The words of one lower-case token without white space."""
        if token.isalpha() and not _RUN.search(token):
            return (token,)
        if len(token) > 2 and len(set(token)) > 1 and all(c in LOOKS_LIKE for c in token):
            # Signs or digits only: a word if it reads like one.
            cost, said = self.cheapest(token)
            return tuple(said.split()) if cost < COST_AS_WRITTEN * len(token) else ()
        core = without_edges(token)
        if not core:
            return ()
        if _PLAIN.match(core) and not _RUN.search(core):
            return (core,)
        if not any(c.isalpha() for c in core):
            return ()
        return tuple(self.decode(core).split())

    def tokens(self, text: str) -> list[str]:
        """Lower-case tokens; a stretch of single letters that signs or spaces set apart is read first."""
        return _SPACED.sub(lambda m: f" {self.decode(m[0])} ", text.lower()).split()


def word_hashes(word: str) -> list[int]:
    """Buckets of a word and of its beginnings."""
    name = word.encode()
    out = [crc32(name, _WHOLE) & (HASHES - 1)]
    ends = PREFIXES if len(name) == len(word) else [len(word[:k].encode()) for k in PREFIXES]
    done, found = 0, 0
    for k, end in zip(PREFIXES, ends, strict=True):
        if len(word) <= k:
            break
        found, done = crc32(name[done:end], found), end
        out.append(found & (HASHES - 1))
    return out


@dataclass
class Restorer:
    """Restored words of whole texts as numbers, with the tokens seen so far."""

    decoder: Decoder
    places: dict[int, int] | None = None
    known: dict[str, array] = field(default_factory=dict)
    before: dict[str, array] = field(default_factory=dict)

    def _of(self, words: Sequence[str]) -> array:
        hashes = [h for w in words for h in word_hashes(w)]
        return array("i", hashes if self.places is None else [self.places[h] for h in hashes if h in self.places])

    def features(self, text: str | None) -> tuple[dict[int, int], int]:
        """How often each feature occurs, and the number of tokens."""
        tokens = self.decoder.tokens(text or "")
        found: dict[int, int] = {}
        known = self.known
        for token, times in Counter(tokens).items():
            got = known.get(token)
            if got is None:
                got = self.before.get(token)
                if got is None:
                    got = self._of(self.decoder.restore_token(token))
                if len(known) >= KEPT_TOKENS:
                    # What was seen lately stays; the rest is forgotten.
                    self.before, self.known = known, {}
                    known = self.known
                known[token] = got
            for f in got:
                found[f] = found.get(f, 0) + times
        return found, len(tokens)


@dataclass
class ToxicityModel:
    chars: np.ndarray
    places: dict[int, int]
    weights: np.ndarray  # for presence, then for density
    bias: float


def _inputs(found: dict[int, int], n: int) -> tuple[list[int], list[float]]:
    """Presence of each feature and how dense it is."""
    at, value = [], []
    for f, k in found.items():
        at += [f, f + FEATURES]
        value += [1.0, float(np.log1p(400.0 * k / (n + 40)))]
    return at, value


def _label_counts(model: object):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(Decoder(model.value))
        table = np.zeros((2, HASHES), np.int64)
        for batch in text_slices(batches, "text", SLICE_BYTES):
            for t, y in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                found, _ = restorer.features(t)
                if found:
                    table[min(1, max(0, y))][list(found)] += 1
        at = np.flatnonzero(table.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(table[0, at], pa.int64()), pa.array(table[1, at], pa.int64())], ["slot", "clean", "toxic"])

    return run


def _vectors(handed: object):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chars, places = handed.value
        restorer = Restorer(Decoder(chars), places)
        for batch in text_slices(batches, "text", SLICE_BYTES):
            rows = [restorer.features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), pa.array([n for _, n in rows], pa.int32()), pa.array([list(f) for f, _ in rows], pa.list_(pa.int32())), pa.array([list(f.values()) for f, _ in rows], pa.list_(pa.int32()))],
                ["doc_id", "label", "n", "at", "times"],
            )

    return run


def _fit_logistic(owner: np.ndarray, at: np.ndarray, density: np.ndarray, y: np.ndarray, *, steps: int = 400, decay: float = 2e-2) -> tuple[np.ndarray, float]:
    """Weights (presence, then density) and bias by Adam on the whole sample, given as its non-zero entries."""
    share = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
    w = np.zeros(2 * FEATURES + 1)
    w[-1] = np.log(share / (1 - share))
    if not len(y) or len(np.unique(y)) < 2:
        return w[:-1], float(w[-1])
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        logit = np.bincount(owner, w[at] + w[at + FEATURES] * density, minlength=len(y)) + w[-1]
        d = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) / len(y)
        each = d[owner]
        g = np.concatenate([np.bincount(at, each, minlength=FEATURES), np.bincount(at, each * density, minlength=FEATURES), [d.sum()]])
        g[:-1] += decay * w[:-1] / len(y)
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        w -= 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return w[:-1], float(w[-1])


def fit_toxicity(docs: DataFrame, labels: DataFrame, learn: Column, *, label: str = "toxic", rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """The character model of all ``docs``; features and weights from about ``rows`` labelled ones."""
    spark = docs.sparkSession
    chars = char_model(docs)
    sample = labelled_sample(docs, labels, label, learn, rows=rows).select("doc_id", "text", "label")
    counts = sample.mapInArrow(_label_counts(spark.sparkContext.broadcast(chars)), "slot long, clean long, toxic long")
    counts = counts.groupBy("slot").agg(F.sum("clean").alias("n"), F.sum("toxic").alias("t")).filter(F.col("t") >= 3)
    many = labelled_sample(docs.select("doc_id", F.lit("").alias("text")), labels, label, learn, rows=rows).agg(F.sum(F.lit(1) - F.col("label")).alias("n"), F.sum("label").alias("t")).first()
    n, t = float(many.n or 0) + 1, float(many.t or 0) + 1
    # How far the share of toxic documents that hold it stands above that of clean ones, in standard errors.
    rate = (F.col("t") + F.col("n")) / F.lit(n + t)
    z = (F.col("t") / t - F.col("n") / n) / F.sqrt(rate * (F.lit(1.0) - rate) * (1 / n + 1 / t) + 1e-12)
    best = counts.withColumn("z", z).filter(F.col("z") > 2).orderBy(F.desc("z"), "slot").limit(FEATURES).collect()
    places = {r.slot: i for i, r in enumerate(best)}
    kind = sample.schema["doc_id"].dataType.simpleString()
    vectors = sample.mapInArrow(_vectors(spark.sparkContext.broadcast((chars, places))), f"doc_id {kind}, label int, n int, at array<int>, times array<int>")
    found = saved(vectors, "toxicity-sample").orderBy("doc_id").toArrow().combine_chunks()  # about ``rows`` sparse rows, as flat arrays
    lists = [found.column(c).combine_chunks() for c in ("at", "times")]
    flat_at, times = (x.flatten().to_numpy(zero_copy_only=False) if len(x) else np.zeros(0, np.int32) for x in lists)
    counts = np.diff(lists[0].offsets.to_numpy()) if len(lists[0]) else np.zeros(0, np.int64)
    n = np.repeat(found.column("n").to_numpy(), counts)
    density = np.log1p(400.0 * times / (n + 40)).astype(np.float32)
    y = np.clip(found.column("label").to_numpy(), 0, 1).astype(float)
    weights, bias = _fit_logistic(np.repeat(np.arange(len(y), dtype=np.int32), counts), flat_at.astype(np.int32), density, y)
    return ToxicityModel(chars, places, weights, bias)


def toxicity_score(docs: DataFrame, model: ToxicityModel, *, text: str = "text") -> Column:
    """The probability that a text is toxic; null and empty texts get that of no words."""
    handed = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = handed.value
        restorer = Restorer(Decoder(m.chars), m.places)
        for batch in batches:
            out = []
            for t in batch:
                at, value = _inputs(*restorer.features(t.as_py()))
                out.append(float(m.weights[at] @ np.array(value)) + m.bias if at else m.bias)
            yield pa.array(1 / (1 + np.exp(-np.clip(np.array(out, float), -30, 30))), pa.float64())

    return score(F.col(text))


def restored(docs: DataFrame, chars: np.ndarray, *, text: str = "text") -> Column:
    """The restored words of each text, set apart by spaces; null stays null."""
    handed = docs.sparkSession.sparkContext.broadcast(chars)

    @F.arrow_udf("string")
    def words(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decoder = Decoder(handed.value)
        for batch in batches:
            yield pa.array([None if t is None else restore(t, decoder) for t in batch.to_pylist()], pa.string())

    return words(F.col(text))


def restore(text: str, decoder: Decoder) -> str:
    """The text's words as they are read: spaced stretches first, then each token."""
    return " ".join(w for token in decoder.tokens(text) for w in decoder.restore_token(token))


def toxicity_report(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.5) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row.

    Null and empty texts get the score of no words; repeated rows score alike, and
    so do texts that read the same.  Ids may be of any type; an id with several
    labels has the largest.  Without labels of both values the score is the share
    of label 1 (no labels: one half); no rows give no rows.  Other columns,
    whatever their names, aren't read.
    """
    out = held_out(F.col("doc_id"), 5, 0)
    model = fit_toxicity(docs, labels, ~out)
    rows = docs.select("doc_id", out.alias("held_out"), toxicity_score(docs, model).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
