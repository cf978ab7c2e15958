"""The trie of conversations against its SQL and a trie of dictionaries."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from repolytics.llm import prefixtrie, queries

SCHEMA = "conv_id long, turn int, role string, text string"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    members, ends = defaultdict(set), defaultdict(set)
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        seq = tuple(turns.get(c - c % 5, [])[:h] + turns[c][h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].add(c)
        ends[seq].add(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    out = {}

    def visit(p):
        leaves, total = 0 if kids[p] else 1, (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        for k in kids[p]:
            more = visit(k)
            leaves, total = leaves + more[0], total + more[1]
        ids = ",".join(map(str, sorted(ends[p])))
        out[p] = (min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids[p]), leaves, total, hashlib.sha256(ids.encode()).hexdigest())
        return leaves, total

    if turns:
        visit(())
    return sorted(out.values(), key=str)


def made(rng, n=120):
    rows = []
    for c in rng.sample(range(400), n):
        first = rng.choice(["hi", "hi", "hallo", None])
        rows += [(c, t if rng.random() < 0.9 else None, rng.choice(["user", "bot", None]), first if t == 0 else rng.choice(["", "é", "yes", "no", None])) for t in range(rng.choice([1, 1, 2, 3, 6, 12]))]
    rows += [(c, t, "user", "the same") for c in range(500, 900, 5) for t in range(9)]
    return rows + [(None, 1, "user", "lost")] + rows[:3]


@pytest.mark.parametrize("seed", [1, 2])
def test_odd_conversations(spark, seed):
    rows = made(random.Random(seed))
    df = spark.createDataFrame(rows, SCHEMA).withColumn("depth", F.lit(1)).withColumn("n", F.lit("x")).repartition(3)
    ties = duckdb_ties(rows)
    got = prefixtrie.conversation_report(df)
    assert tuple(got.columns) == prefixtrie.NODE_COLUMNS
    if not ties:
        assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)
    else:  # ties are in an order of hashes: number the turns by it and compare from there
        turns = prefixtrie.numbered_turns(df).collect()
        texts = {(r.a, r.b): (r.role or "", r.text or "") for r in df.select("role", "text", F.xxhash64(F.lit(1), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))).alias("a"), F.xxhash64(F.lit(2), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))).alias("b")).collect()}
        assert sorted((tuple(r) for r in got.collect()), key=str) == brute([(r.conv, r.pos, *texts[r.a, r.b]) for r in turns])


def duckdb_ties(rows):
    seen = [r[:2] for r in rows]
    return len(set(seen)) < len(seen)


def test_query_matches_its_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf_dir}/conversations.parquet'")
    expected = con.execute(f"select {', '.join(prefixtrie.NODE_COLUMNS)} from ({prefixtrie.SQL})").fetchall()
    got = [tuple(r) for r in queries.op12_prefixtrie(spark, sf_dir).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert sorted(expected, key=str) == brute(con.execute("select conv_id, turn, role, text from conversations").fetchall())


def test_long_sequences_are_worked_in_ranges(spark):
    rows = [(c, t, "user", f"{t % 7}" if t < 40 + c else f"{c}") for c in (0, 5, 10, 15) for t in range(90)]
    turns = prefixtrie.numbered_turns(spark.createDataFrame(rows, SCHEMA), most=20)
    sizes = turns.groupBy("conv").agg(F.max("pos").alias("n"))
    whole = prefixtrie.trie_nodes(turns, sizes).collect()
    cut = prefixtrie.trie_nodes(turns, sizes, most=16).collect()
    assert sorted(map(tuple, cut), key=str) == sorted(map(tuple, whole), key=str) == brute(rows)


def test_no_conversations_and_ones_without_turns(spark):
    assert prefixtrie.conversation_report(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(c, 0, "user", "hi") for c in range(1, 5)]
    assert sorted((tuple(r) for r in prefixtrie.conversation_report(spark.createDataFrame(rows, SCHEMA)).collect()), key=str) == brute(rows)
    assert prefixtrie.conversation_report(spark.createDataFrame([(0, 0, None, None)], SCHEMA)).count() == 2


def test_ids_in_several_parts(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "ID_BITS", 3)
    rows = [(c, 0, "user", "hi") for c in range(0, 300, 5)] + [(-5, 0, "user", "hi")]
    assert sorted((tuple(r) for r in prefixtrie.conversation_report(spark.createDataFrame(rows, SCHEMA)).collect()), key=str) == brute(rows)
