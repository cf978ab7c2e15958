"""Prefix trie of conversations, as tables.

Identical sequences are collapsed first: one row holds how many conversations it
stands for.  Only these distinct sequences are spread out into their prefixes, and
those that are proper prefixes of others are told from the leaves by an
anti-join.  A prefix is known by 128 bits: the exclusive or of two hashes of each
turn with its place, which needs no order, so long sequences are summed up in
ranges and hot ones before the shuffle.

A node is *owned* by the smallest conversation that starts with it.  What a node
sums over its subtree is its owner's share from there on, and the whole share of
every other sequence that passes it; so no round for each depth is needed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolytics.llm.common import discard, saved
from repolytics.operators.scan import SEGMENT_ROWS, carried, numbered, with_carried

#: A sequence's conversations are listed in parts of this many ids (as a power of two), each a row.
ID_BITS = 16
#: Nodes with more than this share of all sequences below them are joined by broadcast: 1000 at most.
HOT_SHARE = 1000

NODE_COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def numbered_turns(conversations: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", most: int = SEGMENT_ROWS) -> DataFrame:
    """``conv, pos, a, b, size``: each turn's place from 1, two hashes of role and text, and the text's bytes.

    Turns are in order of ``turn``, null first, and where these tie by role and
    hash.  Null roles and texts are empty; rows without a conversation are none.
    Texts aren't shuffled.
    """
    who, what = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    rows = conversations.filter(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), who.alias("role"), F.xxhash64(F.lit(1), who, what).alias("a"), F.xxhash64(F.lit(2), who, what).alias("b"), F.octet_length(what).cast("long").alias("size")
    )
    return numbered(rows, ["conv"], "turn", [F.asc("role"), F.asc("a"), F.asc("b")], name="pos", most=most).select("conv", "pos", "a", "b", "size")


def rebuilt(turns: DataFrame, base: Column, shared: Column, *, most_shared: int) -> tuple[DataFrame, DataFrame]:
    """Conversations that take their first turns from another one: the turns, and ``conv, n`` for all.

    ``base`` and ``shared`` are of ``conv``: a conversation begins with the first
    ``shared`` turns (``most_shared`` at most) of ``base`` (all if it has fewer, none
    if there is no such conversation) and goes on with its own after as many.
    """
    sizes = turns.groupBy("conv").agg(F.max("pos").alias("own")).withColumn("base", base).withColumn("h", shared)
    lengths = turns.filter(F.col("pos") <= most_shared).groupBy(F.col("conv").alias("base")).agg(F.max("pos").alias("there"))
    taken = F.least(F.col("h"), F.coalesce("there", F.lit(0)))
    plan = saved(sizes.join(lengths, "base", "left").select("conv", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n")), "plan")
    heads = turns.filter(F.col("pos") <= most_shared).withColumnRenamed("conv", "base")
    first = plan.join(heads, "base").filter(F.col("pos") <= F.col("taken")).select("conv", "pos", "a", "b", "size")
    rest = turns.join(plan.select("conv", "h", "taken"), "conv").filter(F.col("pos") > F.col("h")).select("conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "a", "b", "size")
    return saved(first.union(rest), "rebuilt"), plan.select("conv", "n")


def _placed(turns: DataFrame) -> DataFrame:
    """``x, y``: the hashes of a turn at its place."""
    return turns.withColumn("x", F.xxhash64("pos", "a")).withColumn("y", F.xxhash64("pos", "b"))


def sequence_keys(turns: DataFrame, sizes: DataFrame) -> DataFrame:
    """``conv, n, x, y``: what a whole conversation is known by."""
    keys = _placed(turns).groupBy("conv").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    return sizes.join(keys, "conv", "left").select("conv", "n", F.coalesce("x", F.lit(0)).alias("x"), F.coalesce("y", F.lit(0)).alias("y"))


def collapsed(keys: DataFrame) -> DataFrame:
    """Identical conversations as one: ``n, x, y, conv, weight``, ``conv`` being the smallest."""
    return keys.groupBy("n", "x", "y").agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("weight"))


def id_parts(keys: DataFrame) -> DataFrame:
    """The ids of identical conversations in parts of bounded length: ``n, x, y, part, ids``."""
    part = F.shiftright("conv", ID_BITS).alias("part")
    return keys.groupBy("n", "x", "y", part).agg(F.array_join(F.array_sort(F.collect_list("conv")).cast("array<string>"), ",").alias("ids"))


def ids_sha256(ids: DataFrame) -> DataFrame:
    """``n, x, y, ends``: SHA-256 of a sequence's ids, ascending and comma-joined, streamed part by part."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"n": [key[0]], "x": [key[1]], "y": [key[2]], "ends": [digest.hexdigest()]})

        for batch in batches:
            done = []
            for n, x, y, part in zip(*(batch.column(c).to_pylist() for c in ("n", "x", "y", "ids")), strict=True):
                if (n, x, y) != key:
                    if key:
                        done.append(row())
                    key, digest = (n, x, y), hashlib.sha256(part.encode())
                else:
                    digest.update(b"," + part.encode())
            yield from pa.Table.from_batches(done).combine_chunks().to_batches() if done else ()
        if key:
            yield row()

    ordered = ids.repartition("n", "x", "y").sortWithinPartitions("n", "x", "y", "part")
    return ordered.select("n", "x", "y", "ids").mapInArrow(digests, "n long, x long, y long, ends string")


def prefixes(turns: DataFrame, sequences: DataFrame, *, most: int = SEGMENT_ROWS) -> DataFrame:
    """Every prefix of every sequence, the empty one too: ``conv, weight, n, depth, x, y, up_x, up_y, size``.

    ``x, y`` name the prefix, ``up_x, up_y`` the one a turn shorter; ``size`` is of the last turn.
    """
    rows = _placed(turns).join(sequences.select("conv", "weight", "n"), "conv").withColumn("segment", F.floor((F.col("pos") - 1) / most))
    order = Window.partitionBy("conv", "segment").orderBy("pos")
    out = rows.select("conv", "weight", "n", "segment", F.col("pos").alias("depth"), "size", F.col("x").alias("own_x"), F.col("y").alias("own_y"), F.bit_xor("x").over(order).alias("x"), F.bit_xor("y").over(order).alias("y"))
    if sequences.filter(F.col("n") > most).limit(1).count():
        totals = rows.filter(F.col("n") > most).groupBy("conv", "segment").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
        before = carried(totals, ["conv"], "segment", {"before_x": F.bit_xor("x"), "before_y": F.bit_xor("y")})
        out = with_carried(out, before, ["conv"], "segment")
        out = out.withColumns({c: F.col(c).bitwiseXOR(F.coalesce(f"before_{c}", F.lit(0))) for c in ("x", "y")})
    zero = F.lit(0).cast("long")
    root = sequences.select("conv", "weight", "n", zero.alias("depth"), zero.alias("x"), zero.alias("y"), zero.alias("up_x"), zero.alias("up_y"), zero.alias("size"))
    return root.union(out.select("conv", "weight", "n", "depth", "x", "y", F.col("x").bitwiseXOR(F.col("own_x")), F.col("y").bitwiseXOR(F.col("own_y")), "size"))


def _from_there(nodes: DataFrame, most: int) -> DataFrame:
    """Each node's saving with those of its owner's deeper nodes, as ``below``."""
    rows = nodes.withColumn("segment", -F.floor(F.col("depth") / most))
    order = Window.partitionBy("owner", "segment").orderBy(F.desc("depth"))
    out = rows.withColumn("below", F.sum("saving").over(order))
    if nodes.filter(F.col("depth") >= most).limit(1).count():
        before = carried(rows.groupBy("owner", "segment").agg(F.sum("saving").alias("sum")), ["owner"], "segment", {"before": F.sum("sum")})
        out = with_carried(out, before, ["owner"], "segment").withColumn("below", F.col("below") + F.coalesce("before", F.lit(0)))
    return out.drop("segment")


def trie_nodes(turns: DataFrame, sizes: DataFrame, *, most: int = SEGMENT_ROWS) -> DataFrame:
    """One row a node: see ``NODE_COLUMNS``.

    ``turns`` holds ``conv, pos, a, b, size`` (places from 1 without gaps) and
    ``sizes`` holds ``conv, n`` for every conversation, also for those without
    turns; these are members of the root alone.  No conversations, no nodes.
    """
    keys = saved(sequence_keys(turns, sizes), "keys")
    sequences = saved(collapsed(keys), "sequences")
    paths = saved(prefixes(turns, sequences, most=most), "prefixes")
    node = ["depth", "x", "y"]
    inner = paths.filter(F.col("depth") < F.col("n")).groupBy(*node).agg(F.lit(1).alias("inner")).drop("inner")
    leaves = sequences.join(inner.withColumnRenamed("depth", "n"), ["n", "x", "y"], "left_anti").select("conv", F.lit(1).alias("leaf"))

    found = paths.groupBy(*node).agg(F.min("conv").alias("owner"), F.sum("weight").alias("n_convs"), F.min("size").alias("size"), F.min("up_x").alias("up_x"), F.min("up_y").alias("up_y"))
    nodes = saved(_from_there(found.withColumn("saving", (F.col("n_convs") - 1) * F.col("size")), most), "nodes")
    shares = nodes.groupBy(F.col("owner").alias("conv")).agg(F.sum("saving").alias("share"), F.min("depth").alias("since"))
    known = sequences.select("conv").join(shares, "conv", "left").join(leaves, "conv", "left")

    nothing = F.lit(0).cast("long")
    passing = F.when((F.col("since") > F.col("depth")), F.col("share")).otherwise(0)
    parts = paths.join(known, "conv").select(*node, F.coalesce("leaf", F.lit(0)).cast("long").alias("leaves"), F.coalesce(passing, F.lit(0)).alias("others"), nothing.alias("children"), F.lit(None).cast("string").alias("ends"))
    parts = parts.union(nodes.filter(F.col("depth") > 0).select(F.col("depth") - 1, "up_x", "up_y", nothing, nothing, F.lit(1).cast("long"), F.lit(None)))
    parts = parts.union(ids_sha256(id_parts(keys)).select("n", "x", "y", nothing, nothing, nothing, "ends"))
    sums = parts.groupBy(*node).agg(F.sum("leaves").alias("n_leaves"), F.sum("others").alias("others"), F.sum("children").alias("n_children"), F.max("ends").alias("ends"))
    whole = saved(nodes.join(sums, node), "trie")

    # A node has its owner's node above it, unless it is the first one that the owner has.
    first = whole.join(shares.select(F.col("conv").alias("owner"), F.col("since").alias("depth")), ["owner", "depth"]).filter(F.col("depth") > 0)
    starts = first.select(F.col("depth"), "x", "y", (F.col("depth") - 1).alias("above"), "up_x", "up_y")
    above = whole.select(F.col("depth").alias("above"), F.col("x").alias("up_x"), F.col("y").alias("up_y"), F.col("owner").alias("parent"), "n_children")
    large = F.col("n_children") > F.lit(1) + sequences.count() / HOT_SHARE
    up = ["above", "up_x", "up_y"]
    hot = F.broadcast(above.filter(large).select(*up, F.col("parent").alias("hot_parent")))
    placed = starts.join(hot, up, "left")
    placed = placed.filter(F.col("hot_parent").isNotNull()).select(*node, F.col("hot_parent").alias("parent")).union(placed.filter(F.col("hot_parent").isNull()).join(above.filter(~large), up).select(*node, "parent"))
    out = whole.join(placed, node, "left")
    parent = F.when(F.col("depth") > 0, F.coalesce("parent", "owner"))
    empty = hashlib.sha256().hexdigest()
    out = saved(out.select(F.col("owner").alias("conv_id"), "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", (F.col("below") + F.col("others")).alias("saved_tokens"), F.coalesce("ends", F.lit(empty)).alias("ends_sha256")), "result")
    discard(keys, sequences, paths, nodes, whole)
    return out


def conversation_report(conversations: DataFrame) -> DataFrame:
    """The nodes of all rebuilt conversations; see :func:`trie_nodes`.

    Conversation c begins with the first turns of c - c % 5, as many as its id's
    CRC-32 says.  Rows without a ``conv_id`` are none; null turns come first, null
    roles and texts are empty; turns that tie are in order of role and hash;
    repeated rows are turns of their own; no rows give no rows.  Columns of other
    names aren't read.
    """
    turns = saved(numbered_turns(conversations), "turns")
    whole, sizes = rebuilt(turns, F.col("conv") - F.col("conv") % 5, F.crc32(F.col("conv").cast("string").cast("binary")) % 9, most_shared=8)
    out = trie_nodes(whole, sizes)
    discard(turns, whole, sizes)
    return out


SQL = r"""
WITH RECURSIVE bits(i, k, v) AS (
  SELECT i, 0, CAST(i AS BIGINT) FROM range(256) r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS tab FROM bits WHERE k = 8),
t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
  SELECT DISTINCT c, c - c % 5 AS base,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
                         lambda r, b: xor(r >> 8, tab[CAST((xor(r, b) & 255) AS INTEGER) + 1])), 4294967295) % 9 AS h
  FROM t, crc),
rb AS (
  SELECT ids.c, 0 AS side, t.pos, t.role, t.text FROM ids JOIN t ON t.c = ids.base AND t.pos <= ids.h
  UNION ALL SELECT ids.c, 1, t.pos, t.role, t.text FROM ids JOIN t ON t.c = ids.c AND t.pos > ids.h),
seq AS (
  SELECT ids.c, coalesce(list({'role': rb.role, 'text': rb.text} ORDER BY side, pos) FILTER (WHERE rb.c IS NOT NULL), []) AS s
  FROM ids LEFT JOIN rb ON rb.c = ids.c GROUP BY ids.c),
pre AS (SELECT c, len(s) AS n, d, s[1:d] AS p FROM seq, range(100000) r(d) WHERE d <= len(s)),
node AS (
  SELECT p, d, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE n = d), '')) AS ends_sha256
  FROM pre GROUP BY p, d),
kid AS (SELECT p[1:d - 1] AS p, d - 1 AS d, count(*) AS n_children FROM node WHERE d > 0 GROUP BY ALL),
wide AS (
  SELECT node.*, coalesce(n_children, 0) AS n_children, CASE WHEN node.d > 0 THEN (n_convs - 1) * strlen(node.p[node.d].text) ELSE 0 END AS saving
  FROM node LEFT JOIN kid ON kid.p = node.p AND kid.d = node.d),
up AS (SELECT w.p[1:a] AS p, a AS d, w.saving, w.n_children FROM wide w, range(100000) r(a) WHERE a <= w.d),
sums AS (SELECT p, d, sum(saving) AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves FROM up GROUP BY p, d)
SELECT w.conv_id, w.d AS depth, par.conv_id AS parent_conv_id, w.n_convs, w.n_children, sums.n_leaves, CAST(sums.saved_tokens AS BIGINT) AS saved_tokens, w.ends_sha256
FROM wide w JOIN sums ON sums.p = w.p AND sums.d = w.d LEFT JOIN node par ON w.d > 0 AND par.d = w.d - 1 AND par.p = w.p[1:w.d - 1]
"""
