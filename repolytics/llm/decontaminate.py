"""Benchmark decontamination by an FM-index for each shard of training text.

A shard is a slice of a partition of ``shard_bytes`` or so.  Its words become
symbols of the benchmark's vocabulary; a run of other words is one terminator.
The shard's FM-index is searched backwards for all windows of the benchmark at
once, occurrences are located by sampled suffix positions, and overlapping ones
merge into spans.  Text never leaves its partition, so there is no shuffle.

The benchmark is handed out in blocks of about ``block_bytes`` (a larger item is
in a block with others); each further block is one more pass over the documents,
which adds to the spans found before and is written before the next one starts,
so a large benchmark takes longer but is never cut, and one block at a time is on
the driver and in a worker.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repolytics.llm.common import discard, packed, saved, text_slices
from repolytics.llm.fmindex import FMIndex

SHARD_BYTES = 1 << 20
BLOCK_BYTES = 8 << 20
_BASE = 0x9E3779B97F4A7C15


@cache
def _word_bytes() -> np.ndarray:
    """Which bytes belong to words: 0-9, a-z and all of code points from U+0080 on."""
    table = np.zeros(256, bool)
    table[0x30:0x3A] = table[0x61:0x7B] = table[0x80:] = True
    return table


_grown: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """``base`` and its inverse to the powers 0 to n - 1 at least, modulo 2 ** 64; the longest tables are kept."""
    if base not in _grown or len(_grown[base][0]) < n:
        one = np.ones(1, np.uint64)
        _grown[base] = tuple(np.concatenate([one, np.cumprod(np.full(max(n, 1 << 16) - 1, b, np.uint64))]) for b in (base, pow(base, -1, 1 << 64)))
    return _grown[base]


def words_of(data: bytes, base: int = _BASE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each word of lower-cased UTF-8 bytes."""
    raw = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = _word_bytes()[raw]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _powers(len(raw) + 1, base)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=total[1:])
    return start, end, (total[end] - total[start]) * down[start]


def _same_words(data: bytes, start: np.ndarray, end: np.ndarray, like: np.ndarray) -> bool:
    """Whether each word has the bytes of the word that ``like`` names for it."""
    length = end - start
    if (length != length[like]).any():
        return False
    raw = np.frombuffer(data, np.uint8)
    for n in np.unique(length).tolist():
        at = np.flatnonzero((length == n) & (like != np.arange(len(like))))
        for part in np.array_split(at, 1 + len(at) * n // (1 << 24)):
            place = np.arange(n)
            if (raw[start[part, None] + place] != raw[start[like[part], None] + place]).any():
                return False
    return True


class Windows:
    """The windows of one block of the benchmark, as symbols of its vocabulary."""

    def __init__(self, items: Sequence[tuple[str, str | None]], size: int) -> None:
        self.items = sorted({name for name, _ in items})
        place = {name: i for i, name in enumerate(self.items)}
        parts = [(text or "").encode().lower() for _, text in items]
        data = b"\n".join([*parts, b""])
        base = _BASE
        while True:
            start, end, hashes = words_of(data, base)
            self.hashes, first, symbol = np.unique(hashes, return_index=True, return_inverse=True)
            if _same_words(data, start, end, first[symbol]):
                break
            base = (base + 0x632BE59BD9B4E01A) % (1 << 64)  # another odd base, under which no two words of the block collide
        self.base = base
        self.words = [b"", *(data[a:b] for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True))]
        self.lengths = np.array([len(w) for w in self.words])
        symbol = (symbol + 1).astype(np.int32)
        heads = np.searchsorted(start, np.cumsum([0, *(len(p) + 1 for p in parts)]))
        many = np.diff(heads)
        name = np.array([place[n] for n, _ in items], np.int64)
        #: By length: the distinct windows, and the items of each as offsets into a flat list.
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in np.unique(np.minimum(many[many > 0], size)).tolist():
            whole = np.flatnonzero(many >= n if n == size else many == n)
            count = many[whole] - n + 1
            at = np.repeat(heads[:-1][whole] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
            patterns, inverse = np.unique(np.lib.stride_tricks.sliding_window_view(symbol, n)[at], axis=0, return_inverse=True)
            pairs = np.unique(np.stack([inverse.ravel(), np.repeat(name[whole], count)], 1), axis=0)
            self.by_length[n] = patterns, np.searchsorted(pairs[:, 0], np.arange(len(patterns) + 1)), pairs[:, 1]

    def encode(self, hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        found = np.where(self.hashes[at] == hashes, at + 1, 0)
        return np.where(self.lengths[found] == lengths, found, 0)


def search_shard(texts: Sequence[str | None], windows: Windows) -> list[tuple[int, list[tuple[int, int, int, int]], list[str]]]:
    """For each text: its number of words, spans (first and end word, start and end byte) and item ids."""
    parts = [(t or "").encode().lower() for t in texts]
    data = b"\n".join(parts) + b"\n"
    starts = np.cumsum([0, *(len(p) + 1 for p in parts)])
    begin, end, hashes = words_of(data, windows.base)
    first = np.searchsorted(begin, starts)
    counts = np.diff(first)
    out = [(int(n), [], []) for n in counts]
    if not windows.by_length or not len(begin):
        return out
    symbols = windows.encode(hashes, end - begin)
    # A terminator wherever a document ends or another word stands; runs of them count as one.
    breaks = np.zeros(len(begin), bool)
    breaks[first[:-1][counts > 0]] = True
    place = np.flatnonzero(np.ones(len(begin), bool))
    slot = place + np.cumsum(breaks)
    seq = np.zeros(len(begin) + int(breaks.sum()) + 1, np.int64)
    word = np.full(len(seq), -1)
    seq[slot], word[slot] = symbols, place
    keep = (seq > 0) | np.r_[True, seq[:-1] > 0]
    seq, word = seq[keep], word[keep]
    if seq[-1]:
        seq, word = np.r_[seq, 0], np.r_[word, -1]
    if not (seq > 0).any():
        return out
    index = FMIndex(seq, len(windows.words))
    hits: list[tuple[np.ndarray, int, np.ndarray]] = []
    for n, (patterns, _, _) in windows.by_length.items():
        lo, hi = index.search(patterns)
        many = hi - lo
        if many.sum():
            row = np.repeat(lo - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
            hits.append((word[index.locate(row)], n, np.repeat(np.arange(len(many)), many)))
    if not hits:
        return out
    # Exact check of the words that were found by hash.
    mark = np.zeros(len(begin) + 1, np.int32)
    for at, n, _ in hits:
        np.add.at(mark, at, 1)
        np.add.at(mark, at + n, -1)
    covered = np.flatnonzero(np.cumsum(mark)[:-1] > 0)
    wrong = [i for i in covered.tolist() if data[begin[i] : end[i]] != windows.words[symbols[i]]]
    if wrong:
        bad = np.zeros(len(begin) + 1, np.int64)
        bad[np.array(wrong) + 1] = 1
        bad = np.cumsum(bad)
        hits = [(at[ok], n, which[ok]) for at, n, which in hits for ok in [bad[at + n] == bad[at]]]
        mark[:] = 0
        for at, n, _ in hits:
            np.add.at(mark, at, 1)
            np.add.at(mark, at + n, -1)
    on = np.cumsum(mark)[:-1] > 0
    # Spans end with their document: windows never pass one.
    edge = on & np.r_[True, ~on[:-1] | breaks[1:]]
    heads = np.flatnonzero(edge)
    tails = np.flatnonzero(on & np.r_[~on[1:] | breaks[1:], True]) + 1
    owner = np.searchsorted(first, heads, side="right") - 1
    for d, a, b in zip(owner.tolist(), heads.tolist(), tails.tolist(), strict=True):
        out[d][1].append((a - int(first[d]), b - int(first[d]), int(begin[a] - starts[d]), int(end[b - 1] - starts[d])))
    items: dict[int, set[str]] = {}
    for at, n, which in hits:
        _, offsets, names = windows.by_length[n]
        pairs = np.unique(np.stack([np.searchsorted(first, at, side="right") - 1, which], 1), axis=0) if len(at) else np.empty((0, 2), int)
        for d, k in pairs.tolist():
            items.setdefault(d, set()).update(windows.items[i] for i in names[offsets[k] : offsets[k + 1]].tolist())
    return [(n, spans, sorted(items.get(d, ()))) for d, (n, spans, _) in enumerate(out)]


def merged(spans: Sequence[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Spans in order, overlapping ones as one."""
    out: list[tuple[int, int, int, int]] = []
    for a, b, c, d in sorted(spans):
        if out and a < out[-1][1]:
            x = out[-1]
            out[-1] = (x[0], max(b, x[1]), x[2], max(d, x[3]))
        else:
            out.append((a, b, c, d))
    return out


FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("word_from", "word_to", "byte_from", "byte_to")]))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)
_ARROW = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([(n, pa.int64()) for n in ("word_from", "word_to", "byte_from", "byte_to")]))), ("items", pa.list_(pa.string()))])


def _pass(text: str, found: str, block: object, size: int, shard: int, cut: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(block.value, size)
        for batch in text_slices(batches, text, shard):
            rows = []
            texts = batch.column(text).to_pylist()
            for new, old in zip(search_shard(texts, windows), batch.column(found).to_pylist(), strict=True):
                n, spans, items = new
                if old:
                    spans = merged([*(tuple(s.values()) for s in old["spans"]), *spans])
                    items = sorted({*old["items"], *items})
                rows.append({"n_words": n, "spans": [dict(zip(("word_from", "word_to", "byte_from", "byte_to"), s, strict=True)) for s in spans], "items": items})
            new_columns = {found: pa.array(rows, _ARROW)}
            if cut:
                new_columns[text] = pa.array([_cut(t, r["spans"]) for t, r in zip(texts, rows, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([new_columns.get(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True)], names=batch.schema.names)

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = 10, found: str = "_found", cut: bool = False, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with a struct column ``found``: ``n_words``, ``spans`` and ``items``.

    With ``cut`` the last pass also takes the spans out of the text.  Other columns
    stay, whatever their names; one named ``found`` is replaced.

    Words are runs of 0-9, a-z (after lower-casing A-Z) and code points from
    U+0080.  A window is ``size`` consecutive words of an item, or all words of a
    shorter one.  Null and empty texts have no words, spans or items; items
    without words have no window; items that share an id count as one, and a null
    id is the empty string.  Repeated documents are each reported.  Spans are
    disjoint and ordered; bytes count in the text's UTF-8.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(item_text).alias("body")).distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("body") + F.octet_length("item")), F.lit(0))).first()[0]
    parts = max(1, -(-int(total) // block_bytes))
    out = docs.select(packed(docs).alias("own"), F.col(text).alias("body"), F.lit(None).cast(FOUND).alias("found"))
    for k in range(parts):
        # A block is bounded by its share of the bytes; only that much is on the driver and in a worker at a time.
        block = items if parts == 1 else items.filter(F.pmod(F.xxhash64("item", "body"), F.lit(parts)) == k)
        rows = spark.sparkContext.broadcast([(r.item, r.body) for r in block.toLocalIterator()])
        before, out = out, out.mapInArrow(_pass("body", "found", rows, size, shard_bytes, cut and k == parts - 1), out.schema)
        if k < parts - 1:
            out = saved(out, "leaks")
            rows.unpersist()
            if k:
                discard(before)
    own = [F.col("body").alias(c) if c == text else F.col("own")[c].alias(c) for c in docs.columns if c != found]
    return out.select(*own, F.col("found").alias(found))


def _cut(text: str | None, spans: object) -> str | None:
    """The text without its spans."""
    if text is None or not len(spans):
        return text
    data, at, out = text.encode(), 0, []
    for s in spans:
        out.append(data[at : s["byte_from"]])
        at = s["byte_to"]
    return b"".join([*out, data[at:]]).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", **how: object) -> DataFrame:
    """``docs`` with every benchmark span cut out of ``text``; all rows and columns stay."""
    free = "_" * (1 + max((len(c) for c in docs.columns), default=0))
    return find_leaks(docs, benchmark, text=text, cut=True, found=free, **how).drop(free)


def leak_report(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id") -> DataFrame:
    """One row a document: words, hit words, items and whether any is hit.

    Null and empty texts have no words; items without words hit nothing; a null
    item id is an empty one; items that share a window are each counted, an id
    that repeats once.  Repeated rows are each searched, no rows give no rows, and without a
    benchmark nothing is hit.  Columns of other names aren't read.
    """
    found = find_leaks(docs.select(doc_id, "text"), benchmark)
    hit = F.aggregate("_found.spans", F.lit(0).cast("long"), lambda a, s: a + s["word_to"] - s["word_from"])
    return found.select(
        doc_id,
        F.col("_found.n_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size("_found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_found.items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def digest(items: Sequence[str]) -> str:
    """The digest of a document's item ids, as :func:`leak_report` has it."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


SQL = r"""
WITH dw AS (
  SELECT rowid AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM (SELECT row_number() OVER () AS rowid, doc_id, text FROM documents)
), iw AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM benchmark
), win AS (
  SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS t
  FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM iw WHERE len(w) > 0)
), pos AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS t
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)
), hit AS (
  SELECT r, i, n, item FROM pos JOIN win USING (n, t)
), words AS (
  SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT r, i, n FROM hit)) GROUP BY r
), its AS (
  SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hit GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (r) LEFT JOIN its USING (r)
"""
