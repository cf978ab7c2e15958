"""File identity through renames in time, and line counts of changed files."""

import difflib
import random
import subprocess

import pytest
from pyspark.sql import functions as F

from repolytics.operators import history, lineage, linediff

COMMITS = "repo_id string, sha string, at long, author_email_hash string, author_name string, subject string"
FILES = "repo_id string, sha string, path string, old_path string, additions long, deletions long"


def brute_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


def test_common_lines_against_dynamic_programming():
    rng = random.Random(7)
    for _ in range(600):
        a, b = ([rng.randint(0, rng.choice([1, 3, 30])) for _ in range(rng.randint(0, 40))] for _ in range(2))
        assert linediff.common_length(a, b) == brute_common(a, b)
    long = list(range(40_000))
    assert linediff.common_length(long, long[1000:] + [7] * 1000) == 39_000


def test_counts_equal_numstat(spark, tmp_path):
    """What Git counts for the same pairs of texts."""
    rng = random.Random(8)
    texts = [("same\n", "same\n"), ("a\nb\nc\n", "x\ny\nz\n"), ("a\nb\n", ""), ("", "a\nb\n")]
    for _ in range(12):
        a = [rng.choice(["{", "}", "", f"line {rng.randint(0, 20)}"]) for _ in range(rng.randint(1, 40))]
        b = [x for x in a if rng.random() < 0.8] + [f"new {rng.randint(0, 5)}"] * rng.randint(0, 3)
        rng.random() < 0.3 and b.reverse()
        texts.append(("\n".join(a) + "\n", "\n".join(b) + "\n"))
    rows = []
    for i, (a, b) in enumerate(texts):
        (tmp_path / "a").write_text(a)
        (tmp_path / "b").write_text(b)
        out = subprocess.run(["git", "diff", "--no-index", "--minimal", "--numstat", "a", "b"], cwd=tmp_path, capture_output=True, text=True, check=False).stdout.split()
        rows.append((f"f{i}", a, b, int(out[0]) if out else 0, int(out[1]) if out else 0))
    side = lambda n: spark.createDataFrame([("r", r[0], str(hash(r[n])), r[n]) for r in rows], "repo_id string, path string, content_hash string, content string")
    got = {r.path: (r.additions, r.deletions) for r in history.compare_snapshots(side(1), side(2)).collect()}
    assert got == {p: (x, y) for p, a, b, x, y in rows if a != b}


def test_replaced_lines_renames_and_binary_files(spark):
    ddl = "repo_id string, path string, content_hash string, content string"
    before = spark.createDataFrame([("r", "ten.py", "1", "\n".join(f"a{i}" for i in range(10))), ("r", "old.py", "2", "x\ny"), ("r", "gone.py", "3", "x"), ("r", "pic.png", "4", None), ("r", "same.py", "5", "s")], ddl)
    after = spark.createDataFrame([("r", "ten.py", "6", "\n".join(f"b{i}" for i in range(10))), ("r", "new.py", "2", "x\ny"), ("r", ".env", "7", "k=1\nl=2"), ("r", "pic.png", "8", None), ("r", "same.py", "5", "s")], ddl)
    got = {(r.path, r.status, r.old_path, r.additions, r.deletions, r.redacted) for r in history.compare_snapshots(before, after).collect()}
    assert got == {("ten.py", "M", None, 10, 10, False), ("new.py", "R", "old.py", 0, 0, False), ("gone.py", "D", None, 0, 1, False), (".env", "A", None, 2, 0, True), ("pic.png", "M", None, 0, 0, False)}
    none = before.limit(0)
    assert {(r.status, r.additions) for r in history.compare_snapshots(none, before).collect()} == {("A", 10), ("A", 2), ("A", 1), ("A", 0)}


@pytest.fixture(scope="module")
def renamed(spark):
    rows = [
        (1, "a.py", None), (2, "a.py", None), (3, "b.py", "a.py"), (4, "a.py", None), (5, "b.py", None), (6, "c.py", "b.py"), (6, "d.py", "a.py"), (7, "b.py", None), (8, "c.py", None),
        (9, "x.py", None), (9, "y.py", None), (10, "x.py", "y.py"), (10, "y.py", "x.py"), (11, "x.py", None),
    ]
    files = spark.createDataFrame([("r", f"s{k:02d}", p, old, k, 1) for k, p, old in rows], FILES)
    commits = spark.createDataFrame([("r", f"s{k:02d}", 86400 * k, f"u{k % 2}", f"U{k % 2}", f"m{k}") for k in range(1, 12)], COMMITS).withColumn("author_date", F.timestamp_seconds("at"))
    return commits, files


def test_a_name_used_again_is_another_file(spark, renamed):
    commits, files = renamed
    targets = spark.createDataFrame([("r", p) for p in ("a.py", "b.py", "c.py", "d.py", "x.py", "y.py", "never.py")], "repo_id string, path string")
    got = {r.path: r for r in lineage.file_history(commits, files, targets, F.timestamp_seconds(F.lit(86400 * 20)), limit=2).collect()}
    shas = {"c.py": [1, 2, 3, 5, 6, 8], "d.py": [4, 6], "b.py": [7], "x.py": [9, 10, 11], "y.py": [9, 10], "a.py": [4]}
    assert {p: (r.total_commits, r.first_known_commit, r.latest_commit, r.additions) for p, r in got.items()} == {p: (len(k), f"s{k[0]:02d}", f"s{k[-1]:02d}", sum(k)) for p, k in shas.items()}
    c = got["c.py"]
    assert [(x["from"], x["to"]) for x in c.rename_history] == [("a.py", "b.py"), ("b.py", "c.py")]
    assert [x.sha for x in c.recent_commits] == ["s08", "s06"] and c.days_since_last_change == 12
    assert [(x.author_email_hash, x.commit_count, x.label) for x in c.contributors] == [("u0", 3, "Primary contributor"), ("u1", 3, "Primary contributor")]


def test_similar_to_a_plain_differ():
    """A shortest diff is never longer than a plain one."""
    rng = random.Random(9)
    for _ in range(50):
        a, b = ([rng.randint(0, 9) for _ in range(30)] for _ in range(2))
        plain = sum(m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
        assert linediff.common_length(a, b) >= plain
