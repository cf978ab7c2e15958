"""Near copies at a similarity of 0.8: SimHash ball hashing over blocks, verified by exact Jaccard.

At a Jaccard similarity of 0.8 two fingerprints differ in 15 of 100 bits, so no
ball over 64 bits at once is small enough.  A text's fingerprint is therefore as
wide as it takes and cut into blocks, and each block is hashed as a fingerprint
of its own: it emits all variants within ``RADIUS / 2`` bits, so that two blocks
within ``RADIUS`` bits meet at a variant.  The width of a block grows with the
logarithm of the number of texts, which bounds how many meet by chance, and the
number of blocks is what it takes for ``RECALL`` at a similarity of 0.8 exactly
(above it the recall is higher).  What meets is compared over ``CHECK`` bits.

No group is paired in full.  Where texts meet, each names one other of its
candidates' component there, and all these links make clusters.  Within a cluster
the whole shingle sets are compared exactly, tile by tile: a tile is two lists of
bounded size whose overlaps are one matrix product, and only the links of a
spanning forest leave it.  A cluster beyond a tile is first held against one of
its lists; then only what isn't in its largest component meets all of it again.
A variant with over ``HOT`` texts is dealt over several tasks in the same way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate
from math import ceil, comb, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolytics.llm.common import discard, packed, saved, small, unpacked
from repolytics.llm.graph import connected_components
from repolytics.llm.simhash import ball

SEED = 42
WIDTH = 5
RADIUS = 2
#: Share of bits in which fingerprints of a similarity of 0.8 differ at most, on average.
APART = 0.155
RECALL = 0.99
#: Texts that meet at one variant by chance, at most about: the more, the fewer variants are shuffled and the more pairs are compared.
OCCUPANTS = 1024
#: Bits that candidates are compared over, and the most that may differ: over three deviations above ``APART``.
CHECK, MOST_APART = 128, 33
#: Runs of one variant up to the first length are compared side by side, up to the second as a matrix, longer ones text by text.
SHORT, SQUARE = 128, 4096
#: Pairs that a matrix may give; a run with more is compared text by text, which leaves out what has been reached.
MOST_PAIRS, ROWS_AT_ONCE = 1 << 19, 256
#: Texts at one variant beyond which it is dealt over several tasks, and one of how many is counted for that.
HOT, COUNTED = 20_000, 1000
#: Texts and shingles of one list of a tile.
TILE_TEXTS, TILE_SHINGLES = 512, 1 << 20
_VOTES_AT_ONCE = 1 << 15
_M64 = (1 << 64) - 1


def shingles_of(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The distinct hashes of all ``width``-word shingles, signed and sorted; a text of fewer words is one shingle."""
    words = (text or "").encode().lower().split()  # splits at 0x20 and 0x09-0x0D
    if not words:
        return np.zeros(0, np.int64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64).view(np.int64)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[: len(words) - width]]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[width - 1 :], strict=True)], np.uint64).view(np.int64))


def block_plan(texts: int) -> tuple[int, int]:
    """Bits of a block and number of blocks for so many different texts."""
    bits = 12
    while texts * (bits + 1) > OCCUPANTS << bits:
        bits += 1
    meets = sum(comb(bits, d) * APART**d * (1 - APART) ** (bits - d) for d in range(RADIUS + 1))
    return bits, max(1, ceil(log(1 - RECALL) / log(1 - meets)))


def wide_print(shingles: np.ndarray, words: int) -> np.ndarray:
    """``words`` numbers of 64 bits; a bit is 1 if set in over half the shingles' hashes, a tie goes by the first shingle."""
    out = np.zeros(words, np.uint64)
    n = len(shingles)
    if not n:
        return out
    h = shingles.view(np.uint64)
    for w in range(words):
        votes = np.zeros(64, np.int64)
        first = None
        for i in range(0, n, _VOTES_AT_ONCE):
            x = h[i : i + _VOTES_AT_ONCE] * np.uint64((0x9E3779B97F4A7C15 * (2 * w + 1)) & _M64)
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            bits = np.unpackbits((x ^ (x >> np.uint64(29))).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            votes += bits.sum(axis=0, dtype=np.int64)
            first = bits[0] if first is None else first
        out[w] = np.packbits((2 * votes + first) > n, bitorder="little").view(np.uint64)[0]
    return out


def _blocks(prints: np.ndarray, bits: int, count: int) -> np.ndarray:
    """``count`` blocks of ``bits`` bits of each row of ``prints``."""
    flat = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8), axis=1, bitorder="little")[:, : bits * count].reshape(len(prints), count, bits)
    return flat.astype(np.int64) @ (np.int64(1) << np.arange(bits, dtype=np.int64))


def fingerprints(texts: DataFrame, bits: int, count: int) -> DataFrame:
    """``doc_id, row, print, print2, n, c0, c1, blocks``: two hashes of the shingle set, its size, ``CHECK`` bits of its fingerprint, and all of it in blocks."""
    words = max(CHECK // 64, -(-bits * count // 64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, seconds, sizes, wide = [], [], [], np.zeros((batch.num_rows, words), np.uint64)
            for i, t in enumerate(batch.column(2)):
                h = shingles_of(t.as_py())
                low, high = divmod(xxhash.xxh3_128_intdigest(h.tobytes(), SEED), 1 << 64)
                prints.append(low - (1 << 63))
                seconds.append(high - (1 << 63))
                sizes.append(len(h))
                wide[i] = wide_print(h, words)
            blocks = _blocks(wide, bits, count)
            offsets = pa.array(np.arange(0, blocks.size + 1, count, dtype=np.int32))
            check = wide[:, :2].view(np.int64)
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(prints, pa.int64()), pa.array(seconds, pa.int64()), pa.array(sizes, pa.int64()), pa.array(check[:, 0].copy()), pa.array(check[:, 1].copy()), pa.ListArray.from_arrays(offsets, pa.array(blocks.ravel()))],
                ["doc_id", "row", "print", "print2", "n", "c0", "c1", "blocks"],
            )

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.select("doc_id", "row", "text").mapInArrow(run, f"doc_id {kind}, row long, print long, print2 long, n long, c0 long, c1 long, blocks array<long>")


def variants(prints: DataFrame, bits: int) -> DataFrame:
    """``key, print, c0, c1``: every block's variants within half the radius."""
    masks = F.array(*[F.lit(m).cast("long") for m in ball(RADIUS // 2, bits)])
    rows = prints.select("print", "c0", "c1", F.posexplode("blocks").alias("at", "block"))
    rows = rows.select("print", "c0", "c1", "at", "block", F.explode(masks).alias("mask"))
    return rows.select((F.shiftleft(F.col("at").cast("long"), bits) + F.col("block").bitwiseXOR(F.col("mask"))).alias("key"), "print", "c0", "c1")


def _runs(work: Callable[[dict[str, np.ndarray], np.ndarray, np.ndarray], pa.RecordBatch], columns: tuple[str, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Hand whole runs of one key and part, as they come sorted, to ``work(columns, place in the run, length of the run)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []

        def go(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
            n = len(rows["key"])
            head = np.flatnonzero(np.r_[True, (rows["key"][1:] != rows["key"][:-1]) | (rows["part"][1:] != rows["part"][:-1])])
            length = np.diff(np.r_[head, n])
            return work(rows, np.arange(n) - np.repeat(head, length), np.repeat(length, length))

        for batch in batches:
            if not batch.num_rows:
                continue
            new = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in columns}
            last = np.flatnonzero((new["key"] != new["key"][-1]) | (new["part"] != new["part"][-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if held and not cut and (held[-1]["key"][-1], held[-1]["part"][-1]) == (new["key"][0], new["part"][0]):
                held.append(new)
                continue
            held.append({c: x[:cut] for c, x in new.items()})
            rows = {c: np.concatenate([h[c] for h in held]) for c in columns}
            held = [{c: x[cut:] for c, x in new.items()}]
            if len(rows["key"]):
                yield go(rows)
        if held:
            yield go({c: np.concatenate([h[c] for h in held]) for c in columns})

    return run


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of rows of ``CHECK`` bits."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int16)


def _walked(check: np.ndarray) -> np.ndarray:
    """The first member of each row's component; an element is compared only with what hasn't been reached yet."""
    label = np.arange(len(check))
    rest = label.copy()
    while len(rest):
        seed, rest = int(rest[0]), rest[1:]
        front = [seed]
        while front and len(rest):
            near = _apart(check[rest], check[front.pop()]) <= MOST_APART
            hit, rest = rest[near], rest[~near]
            label[hit] = seed
            front += hit.tolist()
    return label


def _squared(check: np.ndarray) -> np.ndarray | None:
    """All pairs of rows, the first before the second, that are near; none if they are too many to list."""
    found, held = [np.zeros((2, 0), np.int64)], 0
    low, high = np.ascontiguousarray(check[:, 0]), np.ascontiguousarray(check[:, 1])
    for at in range(0, len(check), ROWS_AT_ONCE):
        rows = slice(at, at + ROWS_AT_ONCE)
        apart = np.bitwise_count(low[rows, None] ^ low[None, at:]) + np.bitwise_count(high[rows, None] ^ high[None, at:])
        a, b = np.nonzero(apart <= MOST_APART)
        a, b = a[b > a], b[b > a]
        held += len(a)
        if held > MOST_PAIRS:
            return None
        found.append(np.stack([a, b]) + at)
    return np.concatenate(found, axis=1)


def _settled(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest label that links between ``a`` and ``b`` lead to."""
    while len(a):
        least = np.minimum(label[a], label[b])
        if (label[a] == least).all() and (label[b] == least).all():
            break
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
    return label


def _meet(rows: dict[str, np.ndarray], place: np.ndarray, length: np.ndarray) -> pa.RecordBatch:
    """``src, dst``: of each text that meets candidates, the first of their component there."""
    check = np.stack([rows["c0"], rows["c1"]], 1).view(np.uint64)
    label = np.arange(len(place))
    short = length <= SHORT
    pairs = []
    for d in range(1, int(length[short].max(initial=1))):
        b = np.flatnonzero((place >= d) & short)
        near = b[_apart(check[b - d], check[b]) <= MOST_APART]
        pairs.append(np.stack([near - d, near]))
    walked = []
    for start in np.flatnonzero(~short & (place == 0)).tolist():
        run = check[start : start + int(length[start])]
        near = _squared(run) if len(run) <= SQUARE else None
        if near is None:
            walked.append((start, run))
        else:
            pairs.append(near + start)
    if pairs:
        label = _settled(label, *np.concatenate(pairs, axis=1))
    for start, run in walked:
        label[start : start + len(run)] = start + _walked(run)
    at = np.flatnonzero(label != np.arange(len(label)))
    return pa.RecordBatch.from_pydict({"src": rows["print"][label[at]], "dst": rows["print"][at]})


def _overlap(a: list[np.ndarray], b: list[np.ndarray] | None) -> np.ndarray:
    """How many shingles each set of ``a`` shares with each of ``b`` (of ``a`` itself)."""
    both = a if b is None else a + b
    owner = np.repeat(np.arange(len(both)), [len(x) for x in both])
    names, column, held = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    many = held[column] > 1
    owner, column = owner[many], (np.cumsum(held > 1) - 1)[column[many]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(a), len(both) - (0 if b is None else len(a))), np.float32)
    step = max(64, (1 << 23) // max(1, len(both)))
    for first in range(0, int((held > 1).sum()), step):
        lo, hi = np.searchsorted(column, [first, first + step])
        m = np.zeros((len(both), step), np.float32)
        m[owner[lo:hi], column[lo:hi] - first] = 1
        out += m[: len(a)] @ (m if b is None else m[len(a) :]).T
    return out


def tile_links(prints: np.ndarray, sets: list[np.ndarray], side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a spanning forest) of a similarity of 4 / 5 within side 0, or between sides 1 and 2."""
    size = np.array([len(x) for x in sets])
    if (side == 0).all():
        left = right = np.arange(len(sets))
        shared = _overlap(sets, None)
    else:
        left, right = np.flatnonzero(side == 1), np.flatnonzero(side == 2)
        if not len(left) or not len(right):
            return prints[:0], prints[:0]
        shared = _overlap([sets[i] for i in left], [sets[i] for i in right])
    a, b = np.nonzero(shared * 9 >= 4 * (size[left][:, None] + size[right][None, :]))
    a, b = left[a], right[b]
    # A print on both sides is one text.
    _, name = np.unique(prints, return_inverse=True)
    first = np.zeros(name.max() + 1, np.int64)
    first[name] = prints
    label = _settled(np.arange(len(first)), name[a], name[b])
    at = np.flatnonzero(label != np.arange(len(label)))
    return first[label[at]], first[at]


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each tile; its rows come one after the other."""
    held: list[tuple[int, int, np.ndarray]] = []
    now = None

    def done() -> pa.RecordBatch:
        src, dst = tile_links(np.array([p for p, _, _ in held], np.int64), [x for _, _, x in held], np.array([s for _, s, _ in held]))
        return pa.RecordBatch.from_pydict({"src": src, "dst": dst})

    for batch in batches:
        shingles = batch.column("shingles")
        flat, offsets = shingles.values.to_numpy(zero_copy_only=False), shingles.offsets.to_numpy()
        for i, (cluster, tile, side, name) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("cluster", "tile", "side", "print")), strict=True)):
            if held and (cluster, tile) != now:
                yield done()
                held.clear()
            now = (cluster, tile)
            held.append((name, side, flat[offsets[i] : offsets[i + 1]].copy()))
    if held:
        yield done()


def _shingle_sets(members: DataFrame, texts: DataFrame) -> DataFrame:
    """``print, shingles`` of ``members`` (print, doc_id, row): one text of each print."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles_of(t.as_py()) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["print", "shingles"])

    ends = saved(members.select("print", "doc_id", "row"), "candidates")
    held = texts.join(small(ends, ends.count()), ["doc_id", "row"]).select("print", "text").mapInArrow(whole, "print long, shingles array<long>")
    # Rows may repeat an id and its text.
    return saved(held, "candidate-sets").dropDuplicates(["print"])


def _links_of(tiles: DataFrame, sets: DataFrame) -> DataFrame:
    """Links of all tiles (cluster, tile, side, print)."""
    rows = tiles.join(sets, "print").select("cluster", "tile", "side", "print", "shingles")
    return saved(rows.repartition("cluster", "tile").sortWithinPartitions("cluster", "tile").mapInArrow(_tiles, "src long, dst long").distinct(), "near-copies")


def _lists(texts: Column, shingles: Column) -> Column:
    """How many lists of bounded size so many texts and shingles make."""
    return F.greatest(F.ceil(texts / TILE_TEXTS), F.ceil(shingles / TILE_SHINGLES)).cast("int")


def _upto(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), n - 1))


def verified(members: DataFrame, texts: DataFrame) -> DataFrame:
    """``node, component`` by links of a similarity of 4 / 5 inside each cluster; ``members`` is (cluster, print, n, doc_id, row)."""
    sizes = members.groupBy("cluster").agg(_lists(F.count(F.lit(1)), F.sum("n")).alias("lists"))
    rows = members.join(sizes, "cluster").withColumn("list", F.pmod(F.xxhash64("print", F.lit(9)), F.col("lists")).cast("int"))
    rows = saved(rows.select("cluster", "print", "n", "lists", "list", "doc_id", "row"), "clusters")
    sets = _shingle_sets(rows, texts)
    whole = rows.filter("lists = 1").select("cluster", F.lit(0).alias("tile"), F.lit(0).alias("side"), "print")
    large = rows.filter("lists > 1")
    lead = large.filter("list = 0").select("cluster", _upto(F.col("lists")).alias("tile"), F.lit(1).alias("side"), "print")
    links = _links_of(whole.unionByName(lead).unionByName(large.select("cluster", F.col("list").alias("tile"), F.lit(2).alias("side"), "print")), sets)
    parts = connected_components(links)
    if not large.limit(1).count():
        discard(rows, sets, links)
        return parts
    # Of a large cluster, what isn't in its largest component meets all of it.
    parts = saved(parts, "near-components")
    named = large.join(parts.withColumnRenamed("node", "print"), "print", "left").withColumn("component", F.coalesce("component", "print"))
    most = named.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("k")).groupBy("cluster").agg(F.max_by("component", F.struct("k", "component")).alias("most"))
    rest = saved(named.join(most, "cluster").filter(F.col("component") != F.col("most")).select("cluster", "print", "n", "lists"), "stragglers")
    turns = rest.groupBy("cluster").agg(_lists(F.count(F.lit(1)), F.sum("n")).alias("turns"))
    tile = F.col("turn") * F.col("lists") + F.col("list")
    one = rest.join(turns, "cluster").withColumn("turn", F.pmod(F.xxhash64("print", F.lit(11)), F.col("turns")).cast("int")).select("cluster", "print", "turn", "lists", _upto(F.col("lists")).alias("list"))
    other = large.join(turns, "cluster").select("cluster", "print", "list", "lists", _upto(F.col("turns")).alias("turn"))
    more = _links_of(one.select("cluster", tile.alias("tile"), F.lit(1).alias("side"), "print").unionByName(other.select("cluster", tile.alias("tile"), F.lit(2).alias("side"), "print")), sets)
    out = connected_components(links.unionByName(more))
    discard(rows, sets, links, parts, rest, more)
    return out


def _hot_keys(rows: DataFrame, texts: int) -> DataFrame | None:
    """``key, parts`` of the variants with over ``HOT`` texts, as one text of ``COUNTED`` shows; none if there can't be any."""
    if texts <= HOT:
        return None
    every = max(1, min(COUNTED, HOT // 20))
    counts = rows.filter(F.pmod(F.xxhash64("print", F.lit(3)), F.lit(every)) == 0).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    found = saved(counts.filter(F.col("n") * every * 2 > HOT).select("key", (F.ceil(F.col("n") * every / HOT) + 1).cast("int").alias("parts")), "hot-variants")
    return found if found.limit(1).count() else None


def _fewer(links: DataFrame) -> DataFrame:
    """Links that join the same: a text's to its first partner, and from that one to the others, of which many texts have the same."""
    held = links.groupBy("dst").agg(F.collect_set("src").alias("all")).withColumn("first", F.array_min("all"))  # a partner for each variant at most
    ends = F.concat(F.array("dst"), F.filter("all", lambda x: x != F.col("first")))
    return held.select(F.col("first").alias("src"), F.explode(ends).alias("dst")).distinct()


def candidate_links(prints: DataFrame, bits: int, count: int) -> DataFrame:
    """``src, dst``: links that join all candidates (print, c0, c1, blocks) which meet at a variant."""
    rows = variants(prints, bits)
    hot = _hot_keys(rows, count)

    def met(dealt: DataFrame) -> DataFrame:
        runs = dealt.select("key", "part", "print", "c0", "c1").repartition("key", "part").sortWithinPartitions("key", "part", "print")
        return _fewer(runs.mapInArrow(_runs(_meet, ("key", "part", "print", "c0", "c1")), "src long, dst long"))

    if hot is None:
        return saved(met(rows.withColumn("part", F.lit(0))), "links")
    spread = rows.join(small(hot, hot.count()), "key", "left")
    dealt = saved(spread.filter(F.col("parts").isNotNull()).withColumn("part", F.pmod(F.xxhash64("print", F.lit(9)), F.col("parts")).cast("int")), "hot-rows")
    firsts = dealt.groupBy("key", "parts").agg(F.min(F.struct("print", "c0", "c1")).alias("h"))
    firsts = saved(firsts.select("key", "h.print", "h.c0", "h.c1", _upto(F.col("parts")).alias("part")), "hot-firsts")
    plain = spread.filter(F.col("parts").isNull()).withColumn("part", F.lit(0)).select(*firsts.columns)
    links = saved(met(plain.unionByName(dealt.select(*firsts.columns)).unionByName(firsts)), "links")
    # What isn't in the component of its hot variant's first text goes to all of the parts.
    parts = saved(connected_components(links).withColumnRenamed("node", "print"), "candidate-components")
    named = dealt.join(small(parts, parts.count()), "print", "left").withColumn("component", F.coalesce("component", "print"))
    lead = named.groupBy("key").agg(F.min_by("component", "print").alias("lead"))
    named = named.join(small(lead, lead.count()), "key")
    part = F.explode(F.when(F.col("component") != F.col("lead"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("part")))
    again = named.select("key", "print", "c0", "c1", part.alias("part"))
    out = saved(links.unionByName(met(again)), "links")
    discard(hot, dealt, firsts, links, parts)
    return out


def near_links(prints: DataFrame, texts: DataFrame, bits: int, count: int) -> DataFrame:
    """``print, component`` of all linked prints: one row of ``print, n, c0, c1, blocks, doc_id, row`` for each."""
    links = candidate_links(prints, bits, count)
    clusters = connected_components(links).withColumnRenamed("node", "print").withColumnRenamed("component", "cluster")
    discard(links)
    members = prints.select("print", "n", "doc_id", "row").join(clusters, "print")
    return verified(members, texts).withColumnRenamed("node", "print")


def _told_apart(found: DataFrame) -> DataFrame:
    """``found`` without two shingle sets under one ``print``: of those that share one, all but one go by their second hash."""
    shared = found.groupBy("print").agg(F.min("print2").alias("least"), F.max("print2").alias("most")).filter(F.col("least") != F.col("most"))
    shared = saved(shared.select("print", "least"), "shared-prints")
    count = shared.count()
    if not count:
        return found
    named = found.join(small(shared, count), "print", "left")
    return named.withColumn("print", F.when(F.col("print2") > F.col("least"), F.col("print2")).otherwise(F.col("print"))).drop("least")


def drop_near_copies(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document, that of the smallest id, of each group that pairs of a similarity of 4 / 5 or more link.

    Texts of one shingle set, as those without words, are one text.  A row is
    known by its id and its text, so rows that share an id but not a text are told
    apart; rows that repeat both all stay or all go.  Rows whose id is null stay.
    """
    row = F.xxhash64(text)
    texts = docs.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), row.alias("row"), F.col(text).alias("text"))
    count = texts.count()
    bits, blocks = block_plan(count)
    whole = saved(fingerprints(texts, bits, blocks), "fingerprints")
    found = _told_apart(whole)
    at = F.struct("doc_id", "row")
    distinct = found.groupBy("print").agg(F.min(at).alias("first"), *[F.first(c).alias(c) for c in ("n", "c0", "c1", "blocks")])
    distinct = saved(distinct.select("print", F.col("first.doc_id").alias("doc_id"), F.col("first.row").alias("row"), "n", "c0", "c1", "blocks"), "distinct-sets")
    parts = near_links(distinct.filter("n > 0"), texts, bits, count)
    roots = distinct.select("print", at.alias("at")).join(parts, "print", "left").withColumn("component", F.coalesce("component", "print"))
    least = roots.groupBy("component").agg(F.min("at").alias("least"))
    roots = saved(roots.join(least, "component").select("print", "least"), "near-roots")
    gone = found.select(at.alias("at"), "print").join(roots, "print").filter(F.col("at") != F.col("least"))
    gone = saved(gone.select(F.col("at.doc_id").alias("gone"), F.col("at.row").alias("gone_row")).distinct(), "near-gone")
    discard(whole, distinct, roots)
    rows = docs.select(packed(docs).alias("own"), F.col(doc_id).alias("of"), row.alias("of_row"))
    kept = rows.join(small(gone, gone.count()), (F.col("of") == F.col("gone")) & (F.col("of_row") == F.col("gone_row")), "left_anti")
    return kept.select(*unpacked("own", docs.columns))
