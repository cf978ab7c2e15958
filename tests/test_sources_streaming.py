"""Dumps, model documents and streams on small fixtures."""

import datetime as dt
import glob
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from repolytics.operators import pyast, records
from repolytics.sources import files, git
from repolytics.sources.buckets import BucketedTable
from repolytics.streaming import jobs

LOG = (
    "\x1eaaaaaaaaaa\x1f\x1fAnn\x1fA@x.org\x1f2020-01-01T00:00:00+00:00\x1f2020-01-01T00:00:00+00:00\x1ffirst\x00\n3\t1\ta.py\x00-\t-\tlogo.png\x00"
    "\x1ebbbbbbbbbb\x1faaaaaaaaaa cccc\x1fb@x.org\x1fb@x.org\x1f2020-01-02T01:00:00+02:00\x1f2020-01-02T00:00:00+00:00\x1fmerge\x00\n1\t0\t\x00a.py\x00b.py\x00"
    "\x1enot a record\n\x1ecccccccccc\x1f\x1fCy\x1fc@x.org\x1f2020-01-03T00:00:00Z\x1f2020-01-03T00:00:00Z\x1fempty"
)


def test_git_log(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    with open(f"{folder}/demo.log", "w", newline="") as f:
        f.write(LOG)
    rows = {r.sha: r for r in git.read_git_log(spark, folder).collect()}
    assert set(rows) == {"aaaaaaaaaa", "bbbbbbbbbb", "cccccccccc"}
    a, b, c = (rows[k] for k in ("aaaaaaaaaa", "bbbbbbbbbb", "cccccccccc"))
    assert [(x.path, x.additions, x.deletions, x.binary) for x in a["files"]] == [("a.py", 3, 1, False), ("logo.png", 0, 0, True)]
    assert (b["files"][0].path, b["files"][0].old_path, b.is_merge, b.author_name) == ("b.py", "a.py", True, "Contributor")
    assert (a.repo_id, a.insertions, a.is_merge, c["files"], c.files_changed) == ("demo", 3, False, [], 0)
    assert a.author_email_hash == __import__("hashlib").sha256(b"a@x.org").hexdigest()[:12]
    assert b.author_date == dt.datetime(2020, 1, 1, 23)
    assert git.commit_files(git.read_git_log(spark, folder)).count() == 3


def test_name_status_and_blame(spark):
    sha = "0123456789abcdef0123456789abcdef01234567"
    blame = f"{sha} 1 1 2\nauthor Ann\nauthor-time 100\nsummary first\n\tcode\n{sha} 2 2\nauthor x@y.z\nauthor-time 7\nsummary s\n\t\n"
    row = spark.createDataFrame([("A\x00a.py\x00R090\x00b.py\x00c.py\x00D\x00d.py\x00", blame)], "s string, b string").select(git.parse_name_status(F.col("s")).alias("s"), git.parse_blame(F.col("b")).alias("b")).first()
    assert [tuple(x) for x in row.s] == [("A", None, "a.py", None), ("R", 90, "c.py", "b.py"), ("D", None, "d.py", None)]
    assert [tuple(x) for x in row.b] == [(sha, 1, "Ann", 100, "first"), (sha, 2, "Contributor", 7, "s")]


def test_model_document_round_trip(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    doc = '{"repo_id":"r","files":{"a.py":{"category":"service","language":"Python","size":3,"dependencies":["b.py"],"dependents":[]}},"symbols":[{"name":"f","type":"function","file":"a.py","line":1}],"dependencies":[{"source":"a.py","target":"b.py","type":"imports","confidence":0.9,"evidence":"e"}],"api_routes":[{"method":"GET","path":"/","file":"a.py","handler":"f","framework":"flask"}],"database_models":[{"name":"M","file":"a.py","framework":"x"}],"entry_points":[{"path":"a.py","type":"cli","confidence":0.5}],"architecture_layers":{"L":["a.py"]}}'
    with open(f"{folder}/in.json", "w") as f:
        f.write(doc)
    first = files.read_model_json(spark, f"{folder}/in.json")
    files.write_model_json(files.model_tables(first), f"{folder}/out")
    assert files.read_model_json(spark, f"{folder}/out").collect() == first.collect()


def test_contents(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    os.makedirs(f"{folder}/repos/one/src")
    with open(f"{folder}/repos/one/src/a.txt", "wb") as f:
        f.write(b"ok \xff end")
    rows = files.read_contents(spark, f"{folder}/repos", root="repos").collect()
    assert [(r.repo_id, r.path, r.content) for r in rows] == [("one", "src/a.txt", "ok � end")]


def streamed(spark, df, job, mode, parts=3):
    """Run a stream over the rows of ``df``, one file after the other."""
    folder = tempfile.mkdtemp(prefix="spark-")
    df.repartition(parts).write.parquet(f"{folder}/in")
    rows = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    out: list = []
    q = job(rows).writeStream.outputMode(mode).foreachBatch(lambda d, _: out.extend(d.collect())).option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return out


def test_request_stream_equals_batch(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [(at + dt.timedelta(seconds=7 * i), f"/r{i % 3}", 500 if i % 5 == 0 else 200, float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "ts timestamp, route string, status int, duration_ms double")
    last = {(r.start, r.route): r for r in streamed(spark, df, lambda s: jobs.stream_request_metrics(s, late="1 day"), "update")}
    total: dict = {}
    for r in last.values():
        t = total.setdefault(r.route, [0, 0, 0.0])
        t[0], t[1], t[2] = t[0] + r.requests, t[1] + r.errors, t[2] + r.duration_ms_total
    assert total == {r.route: [r.requests, r.errors, r.duration_ms_total] for r in records.request_metrics(df).collect()}


def gate_by_hand(events, limit=5, seconds=60):
    held, out = [], {}
    for at, name in sorted(events):
        held = [h for h in held if (at - h).total_seconds() < seconds]
        out[name] = len(held) < limit
        held += [at] if out[name] else []
    return out


def test_quota_gate(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [("r", at + dt.timedelta(seconds=s), f"e{i}") for i, s in enumerate((0, 1, 2, 3, 4, 5, 59, 60, 61, 61))] + [("end", at + dt.timedelta(hours=1), "z")]
    df = spark.createDataFrame(rows, "root string, ts timestamp, event_id string")
    got = {r.event_id: r.accepted for r in streamed(spark, df, jobs.stream_quota_gate, "append", parts=1)}
    assert [got[f"e{i}"] for i in range(10)] == [True] * 5 + [False, False, True, True, False]


def test_quota_gate_goes_on_after_a_restart(spark):
    """Two runs over one checkpoint judge a hot root's events as one run by hand; events come in no order."""
    rng = random.Random(1)
    at = dt.datetime(2024, 1, 1)
    made = [("hot" if rng.random() < 0.8 else f"r{i % 3}", at + dt.timedelta(seconds=i // 20 + rng.random() * 5), f"e{i}") for i in range(1500)]
    end = [("end", at + dt.timedelta(hours=1), "z")]
    folder = tempfile.mkdtemp(prefix="spark-")
    out: list = []
    for part in (made[:700], made[700:], end):
        spark.createDataFrame(part, "root string, ts timestamp, event_id string").coalesce(1).write.mode("append").parquet(f"{folder}/in")
        rows = spark.readStream.schema("root string, ts timestamp, event_id string").parquet(f"{folder}/in")
        q = jobs.stream_quota_gate(rows, limit=3, seconds=2).writeStream.outputMode("append").foreachBatch(lambda d, _: out.extend(d.collect())).option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
        q.awaitTermination(180)
    for root in ("hot", "r0"):
        assert {r.event_id: r.accepted for r in out if r.root == root} == gate_by_hand([(t, e) for k, t, e in made if k == root], 3, 2)


def test_job_stream_equals_batch(spark):
    at = dt.datetime(2024, 1, 1)
    plan = {"a": "submitted", "b": "submitted started", "c": "submitted started finished", "d": "submitted started failed", "e": "submitted cancelled", "f": "submitted started cancelled finished"}
    rows = [(j, e, at + dt.timedelta(seconds=10 * i)) for j, es in plan.items() for i, e in enumerate(es.split())] + [("g", "started", at), ("g", "finished", at + dt.timedelta(seconds=500))]
    df = spark.createDataFrame(rows, "job_id string, event string, at timestamp")
    last = {r.job_id: r.state for r in streamed(spark, df, jobs.stream_job_states, "update")}
    assert last == {r.job_id: r.state for r in records.job_states(df).collect()} == {"a": "queued", "b": "running", "c": "completed", "d": "failed", "e": "cancelled", "f": "completed", "g": "failed"}


def files_of(folder):
    return {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{folder}/v=*/bucket=*/*.parquet")}


def test_activity_retention(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    df = spark.createDataFrame([(f"p{i % 20}", i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i)) for i in range(200)], "project_id string, id long, created_at timestamp")
    df.repartition(3).write.parquet(f"{folder}/in")
    rows = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")

    def run(source):
        q = jobs.stream_activity_retention(source, f"{folder}/out", f"{folder}/cp", n=4, buckets=16)
        q.processAllAvailable()
        q.stop()
        return {(r.project_id, r.id) for r in jobs.retained_activity(spark, f"{folder}/out", df.schema, buckets=16).collect()}

    assert run(rows) == {(r.project_id, r.id) for r in records.keep_latest(df, ["project_id"], 4).collect()}
    # One more row of one project: the files of all other buckets stay as they are, and it goes on where it was.
    before = files_of(f"{folder}/out")
    more = spark.createDataFrame([("p7", 999, dt.datetime(2025, 1, 1))], df.schema)
    more.write.mode("append").parquet(f"{folder}/in")
    assert run(rows) == {(r.project_id, r.id) for r in records.keep_latest(df.union(more), ["project_id"], 4).collect()}
    after = files_of(f"{folder}/out")
    table = BucketedTable(spark, f"{folder}/out", df.schema, ["project_id"], buckets=16)
    touched = more.select(table.bucket().alias("b")).first().b
    fresh = {p for p in after if p not in before}
    assert fresh and all(f"bucket={touched}/" in p for p in fresh)
    assert all(after.get(p) == t for p, t in before.items() if f"bucket={touched}/" not in p)


def test_stored_upserts_write_what_they_touch(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    ddl = "project_id string, type string, target string, label string, created_at long"
    first = spark.createDataFrame([(f"p{i}", "file", "t", "old", 1) for i in range(50)], ddl)
    table = BucketedTable(spark, f"{folder}/t", first.schema, ["project_id", "type", "target"], buckets=8)
    assert len(records.upsert_into(table, first, "bookmarks", 0)) > 4
    before = files_of(f"{folder}/t")
    change = spark.createDataFrame([("p3", "file", "t", "new", 2), ("p99", "file", "t", "fresh", 2)], ddl)
    for _ in range(2):  # an update that is run again does no harm
        touched = records.upsert_into(table, change, "bookmarks", 1)
    whole = {tuple(r) for r in records.upsert(first, change, "bookmarks").collect()}
    assert {tuple(r) for r in table.read().collect()} == whole and len(whole) == 51 and len(touched) <= 2
    assert all(files_of(f"{folder}/t").get(p) == t for p, t in before.items())
    # A version that isn't whole doesn't count.
    os.makedirs(f"{folder}/t/v=2/bucket={touched[0]}")
    assert {tuple(r) for r in table.read().collect()} == whole
    with pytest.raises(ValueError, match="keyed"):
        records.upsert_into(BucketedTable(spark, f"{folder}/t", first.schema, ["target"]), change, "bookmarks", 3)


def test_dumps_that_come_twice_count_once(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    os.makedirs(f"{folder}/a")
    os.makedirs(f"{folder}/b")
    log = "\x1e" + "\x1f".join(["a" * 40, "", "Ann", "a@x", "2024-01-01T00:00:00+00:00", "2024-01-01T00:00:00+00:00", "one"]) + "\x00\n3\t1\tf.py\x00"
    more = "\x1e" + "\x1f".join(["b" * 40, "a" * 40, "Ann", "a@x", "2024-01-02T00:00:00+00:00", "2024-01-02T00:00:00+00:00", "two"]) + "\x00\n5\t0\tf.py\x00"
    last: dict = {}

    def run():
        q = jobs.stream_commit_churn(spark, f"{folder}/*").writeStream.outputMode("update").foreachBatch(lambda d, _: last.update({(r.repo_id, r.path): (r.commits, r.additions) for r in d.collect()})).option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
        q.awaitTermination(180)

    for name, text in (("a/r.log", log), ("b/r.log", log + more)):
        with open(f"{folder}/{name}", "w", newline="") as f:
            f.write(text)
        run()
    assert last == {("r", "f.py"): (2, 8)}


def test_churn_stream(spark):
    df = spark.createDataFrame([("r", f"f{i % 3}", i, 1) for i in range(30)], "repo_id string, path string, additions long, deletions long")
    last = {r.path: (r.commits, r.additions) for r in streamed(spark, df, jobs.stream_churn, "update")}
    assert last == {f"f{k}": (10, sum(range(k, 30, 3))) for k in range(3)}


def test_python_helpers(spark):
    text = 'import os\nfrom .m import A\n\nX = 1\n\n\n\n\nclass foo(A):\n    """Doc."""\n\n    def go(self):\n        return [a for a in b if a and c]  \n\n\n@app.route("/x", methods=["POST"])\ndef h(a):\n    for i in a:\n        if i:\n            while a:\n                pass\n    return os.getenv("K")'
    df = spark.createDataFrame([("r", "a.py", text), ("r", "b.py", "def (")], "repo_id string, path string, content string")
    o = df.select("path", pyast.python_outline(F.col("content")).alias("o")).collect()
    assert o[0].o.imports == ["os", ".m"] and o[0].o.routes[0].method == "POST" and o[0].o.constants == ["X"] and o[1].o.parse_ok is False
    m = {r.path: r for r in pyast.python_function_metrics(df).collect()}
    assert {(f.name, f.complexity, f.nesting) for f in m["a.py"].functions} == {("go", 3, 0), ("h", 4, 3)}
    rules = {(r.path, r.rule) for r in pyast.python_findings(pyast.python_function_metrics(df)).collect()}
    assert rules == {("a.py", "nonstandard_class_name"), ("a.py", "vague_name"), ("b.py", "parse_unavailable")}
    assert set(pyast.rewrites_of(text, True)) == {"final_newline", "trailing_whitespace", "blank_lines"}
    assert pyast.rewrites_of('x = """a  \n\n\n\n\nb"""\n', True) == {}
    a = pyast.api_surface(df)
    changed = pyast.surface_changes(a, pyast.api_surface(df.withColumn("content", F.replace("content", F.lit("def h(a)"), F.lit("def h(a, b)")))))
    assert [(r.name, r.change) for r in changed.collect()] == [("h", "changed")]
    pairs = spark.createDataFrame([("r", "p", "a\nb\nc\n", "a\nx\nc\nd\n"), ("r", "q", "s", "s")], "repo_id string, path string, before string, after string")
    hunks = pyast.line_hunks(pairs).collect()
    assert len(hunks) == 1 and [(x.tag, x.old_from, x.new_to) for x in hunks[0].hunks] == [("replace", 2, 2), ("insert", 4, 4)]
