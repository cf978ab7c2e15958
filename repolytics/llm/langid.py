"""Language identification with spans for mixed texts.

Each word is scored by its letter trigrams under every learned language; the
script ranges of its letters leave only the languages that are written in them;
and a Viterbi path over the words, with a penalty for each switch, labels spans.
A document's language is that of most of its letters.

Trigram counts are taken over all training rows.  A task adds up its own rows in
a table of ``BUCKETS`` numbers for each language, so what is shuffled is that
table and not the text, and what comes to the driver is ``languages * BUCKETS``
numbers, a row for each language.  Every language is learned; a model beyond
``MODEL_BYTES`` is an error, never a choice of languages.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repolytics.llm import codepoints
from repolytics.llm.common import packed, saved, text_slices, unpacked

BUCKETS = 1 << 15
#: Texts that take the steps of the Viterbi together, and characters whose trigrams are looked up at a time.
SLICE_BYTES = 8 << 20
PART_CHARS = 1 << 19
#: The largest model that is handed to tasks: some 8000 languages.
MODEL_BYTES = 1 << 30
#: A language is written in a script that has this share of its letters at least.
SCRIPT_SHARE = 0.02
SWITCH = 14.0
_ODD_SCRIPT = -1e4
NONE = "und"


@dataclass
class LanguageModel:
    names: list[str]
    scores: np.ndarray  # (BUCKETS, languages) log probabilities
    allowed: np.ndarray  # (scripts, languages)
    prior: np.ndarray  # (languages,) log shares of the training documents


def _words(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of the trigram around each letter, its script, words' starts and ends, texts' starts."""
    points, starts = codepoints.joined(texts)
    kind = codepoints.letters()[points]
    is_letter = (kind == 1) | (kind == 2)
    low = np.where(is_letter, codepoints.lower()[points], 0).astype(np.uint32)
    around = np.zeros(len(low) + 2, np.uint32)
    around[1:-1] = low
    with np.errstate(over="ignore"):
        mixed = (around[:-2] * np.uint32(0x9E3779B1) + low) * np.uint32(0x85EBCA77) + around[2:]
        mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0xC2B2AE3D)
    begin, end = codepoints.runs(is_letter)
    # Words of marks only are no words.
    has = np.add.reduceat((kind == 1).astype(np.int32), begin) > 0 if len(begin) else np.zeros(0, bool)
    for a, b in zip(begin[~has].tolist(), end[~has].tolist(), strict=True):
        is_letter[a:b] = False
    at = np.flatnonzero(is_letter)
    return (mixed[at] >> np.uint32(17)).astype(np.int64), codepoints.scripts()[points[at]].astype(np.int64), np.stack([begin[has], end[has]]), at, starts


def _counts(lang: str, text: str):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for name, table in held.items():
                at = np.flatnonzero(table)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(at), pa.string()), "bucket": pa.array(at, pa.int64()), "held": pa.array(table[at], pa.int64())})
            held.clear()

        for batch in text_slices(batches, text, PART_CHARS):
            names = np.array(batch.column(lang).to_pylist(), object)
            buckets, scripts, _, at, starts = _words(batch.column(text).to_pylist())
            owner = np.searchsorted(starts, at, side="right") - 1
            for name in dict.fromkeys(names):
                mine = (names == name)[owner]
                # After the trigrams: letters by script, then the number of documents.
                table = np.concatenate([np.bincount(buckets[mine], minlength=BUCKETS), np.bincount(scripts[mine], minlength=len(codepoints.SCRIPTS)), [(names == name).sum()]])
                held[name] = held[name] + table if name in held else table
            if len(held) > 64:
                yield from out()
        yield from out()

    return run


def fit_languages(docs: DataFrame, *, lang: str = "lang", text: str = "text", least_docs: int = 1) -> LanguageModel:
    """Trigram tables of every language that ``least_docs`` rows have; null languages and null texts teach nothing.

    Repeated rows count each.  Languages that score alike are told apart by the order of their names.
    """
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    counts = rows.mapInArrow(_counts("lang", "text"), "lang string, bucket long, held long").groupBy("lang", "bucket").agg(F.sum("held").alias("held"))
    last = BUCKETS + len(codepoints.SCRIPTS)
    pair = F.struct("bucket", "held")
    tables = saved(counts.groupBy("lang").agg(F.collect_list(pair).alias("held"), F.max(F.when(F.col("bucket") == last, F.col("held"))).alias("docs")).filter(F.col("docs") >= least_docs), "languages")
    names = sorted(r.lang for r in tables.select("lang").collect())
    if len(names) * BUCKETS * 4 > MODEL_BYTES:
        raise ValueError(f"{len(names)} languages need a larger model than {MODEL_BYTES} bytes")
    table = np.zeros((last + 1, max(1, len(names))), np.float32)
    number = {n: i for i, n in enumerate(names)}
    for r in tables.select("lang", F.col("held.bucket").alias("at"), F.col("held.held").alias("held")).toLocalIterator():
        table[np.array(r.at), number[r.lang]] = r.held
    grams = table[:BUCKETS] + np.float32(0.05)
    scores = np.log(grams / grams.sum(axis=0, dtype=np.float64)).astype(np.float32)
    share = table[BUCKETS:last] / np.maximum(1, table[BUCKETS:last].sum(axis=0))
    return LanguageModel(names, scores, share >= SCRIPT_SHARE, np.log(np.maximum(1, table[last]) / max(1, table[last].sum())).astype(np.float32))


def viterbi(scores: np.ndarray, counts: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of each word; ``counts`` are the words of each text, one after the other.

    All texts take a step at a time, the longest last to end.
    """
    n, labels = scores.shape
    out = np.zeros(n, np.int16)
    if labels == 1 or not n:
        return out
    order = np.argsort(-counts, kind="stable")
    first = (np.cumsum(counts) - counts)[order]
    length = counts[order]
    live = np.searchsorted(-length, -np.arange(int(length[0])), side="left")  # texts with more than t words
    stay = np.ones((n, labels), bool)
    best = np.zeros(n, np.int16)
    value = np.zeros((len(counts), labels), np.float32)
    for t, k in enumerate(live.tolist()):
        at = first[:k] + t
        v = value[:k]
        if t:
            top = v.argmax(axis=1)
            other = v[np.arange(k), top] - penalty
            keep = v >= other[:, None]
            stay[at], best[at] = keep, top
            v = np.where(keep, v, other[:, None])
        value[:k] = v + scores[at]
    label = value.argmax(axis=1)
    for t in reversed(range(len(live))):
        k = live[t]
        at = first[:k] + t
        out[at] = label[:k]
        label[:k] = np.where(stay[at, label[:k]], label[:k], best[at])
    return out


def _scored(texts: Sequence[str | None], model: LanguageModel) -> tuple[np.ndarray, ...]:
    """Of each word: scores, letters, begin and end in its text, and its text."""
    buckets, scripts, words, at, starts = _words(texts)
    begin, end = words
    if not len(begin):
        return np.zeros((0, len(model.names)), np.float32), *(np.zeros(0, np.int32) for _ in range(4))
    cut = np.searchsorted(at, begin)
    scores = np.empty((len(begin), len(model.names)), np.float32)
    for j in range(len(model.names)):
        scores[:, j] = np.add.reduceat(model.scores[buckets, j], cut)
    # The script of a word is that of its first letter; languages not written in it are out, unless all are.
    allowed = model.allowed[scripts[cut]]
    scores[~allowed & allowed.any(axis=1)[:, None]] += _ODD_SCRIPT
    owner = np.searchsorted(starts, begin, side="right") - 1
    return scores, np.diff(np.r_[cut, len(at)]).astype(np.int32), (begin - starts[owner]).astype(np.int32), (end - starts[owner]).astype(np.int32), owner.astype(np.int32)


def label_texts(texts: Sequence[str | None], model: LanguageModel, penalty: float = SWITCH) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
    """Language, share of letters in it, and spans (code points from, to, language) of each text."""
    out = [(NONE, 0.0, []) for _ in texts]
    if not model.names:
        return out
    parts, first, held = [], 0, 0
    for i, t in enumerate(texts, 1):
        held += len(t or "")
        if held >= PART_CHARS or i == len(texts):
            scored = _scored(texts[first:i], model)
            parts.append((*scored[:4], scored[4] + first))
            first, held = i, 0
    if not parts:
        return out
    scores, size, begin, end, owner = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts
    if not len(begin):
        return out
    scores[np.r_[True, owner[1:] != owner[:-1]]] += model.prior
    labels = viterbi(scores, np.bincount(owner, minlength=len(texts)), penalty)
    share = np.bincount(owner.astype(np.int64) * len(model.names) + labels, weights=size, minlength=len(texts) * len(model.names)).reshape(len(texts), -1)
    total = share.sum(axis=1)
    top = share.argmax(axis=1)
    change = np.flatnonzero(np.r_[True, (labels[1:] != labels[:-1]) | (owner[1:] != owner[:-1])])
    close = np.r_[change[1:], len(begin)] - 1
    spans: dict[int, list[tuple[int, int, str]]] = {}
    for a, b in zip(change.tolist(), close.tolist(), strict=True):
        spans.setdefault(int(owner[a]), []).append((int(begin[a]), int(end[b]), model.names[labels[a]]))
    for d in np.flatnonzero(total > 0).tolist():
        out[d] = (model.names[top[d]], float(share[d, top[d]] / total[d]), spans[d])
    return out


LABELLED = T.StructType(
    [
        T.StructField("lang", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType()), T.StructField("lang", T.StringType())]))),
    ]
)


def identify(docs: DataFrame, model: LanguageModel, *, text: str = "text", penalty: float = SWITCH) -> Column:
    """A struct column: ``lang``, ``score`` (share of letters in it) and ``spans``.

    A null text, and one without any letter, is ``und`` with score 0 and no spans;
    so is every text if no language was learned.
    """
    handed = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])))])

    @F.arrow_udf(LABELLED)
    def labels(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        most = SLICE_BYTES * 4 // max(4, len(handed.value.names))  # the score table of a slice has a column for each
        for batch in batches:
            rows = []
            for part in text_slices([pa.RecordBatch.from_arrays([batch], ["t"])], "t", most):
                for lang, score, spans in label_texts(part.column(0).to_pylist(), handed.value, penalty):
                    rows.append({"lang": lang, "score": score, "spans": [{"begin": a, "end": b, "lang": n} for a, b, n in spans]})
            yield pa.array(rows, kind)

    return labels(F.col(text))


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether the CRC of the id as text falls into ``part`` of ``parts``; null ids are taken as empty."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(parts)) == part


def language_report(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score, n_spans``: learn from the rows that aren't held out, and label every row.

    Null, empty and letterless texts are ``und`` with score 0; repeated rows are each labelled; no rows give no rows.
    """
    out = held_out(F.col(doc_id), 4, 2)
    model = fit_languages(docs.filter(~out), lang=lang, text=text)
    rows = docs.select(doc_id, out.alias("held_out"), identify(docs, model, text=text).alias("found"))
    return rows.select(doc_id, "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"), F.size("found.spans").cast("long").alias("n_spans"))


def keep_identified(docs: DataFrame, *, text: str = "text", lang: str = "lang", least: float = 0.5) -> DataFrame:
    """``docs`` without those that have no language or none with ``least`` of their letters.

    Null, empty and letterless texts go; repeated rows stay or go alike; all columns stay, whatever their names.
    """
    model = fit_languages(docs, lang=lang, text=text)
    found = docs.select(packed(docs).alias("own"), identify(docs, model, text=text).alias("found"))
    return found.filter((F.col("found.lang") != NONE) & (F.col("found.score") >= least)).select(*unpacked("own", docs.columns))
