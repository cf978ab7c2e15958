"""Streams of requests, activity, runs, job events and commits.

Every job gives on a stream what its batch operator gives on the whole table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from repolytics.operators.records import keep_latest
from repolytics.sources.buckets import BUCKETS, BucketedTable
from repolytics.sources.git import RECORD, commit_files, parse_log


def stream_request_metrics(requests: DataFrame, *, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Requests, errors and duration by window and route; rows later than the watermark are dropped."""
    rows = requests.withWatermark("ts", late).groupBy(F.window("ts", window), "route")
    out = rows.agg(F.count(F.lit(1)).alias("requests"), F.count(F.when(F.col("status") >= 500, 1)).alias("errors"), F.sum("duration_ms").alias("duration_ms_total"))
    return out.select(F.col("window.start").alias("start"), "route", "requests", "errors", "duration_ms_total")


def stream_activity_retention(activity: DataFrame, path: str, checkpoint: str, *, n: int = 500, buckets: int = BUCKETS) -> StreamingQuery:
    """Keep the newest ``n`` rows of each project in a bucketed table under ``path``.

    A batch rewrites only the buckets of its own projects; one that is run again
    writes the same.  :func:`retained_activity` reads the table.
    """
    table = BucketedTable(activity.sparkSession, path, activity.schema, ["project_id"], buckets=buckets)

    def put(rows: DataFrame, batch: int) -> None:
        table.update(rows, lambda held, new: keep_latest(held.unionByName(new), ["project_id"], n), batch)

    return activity.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).start()


def retained_activity(spark: SparkSession, path: str, schema, *, buckets: int = BUCKETS) -> DataFrame:  # noqa: ANN001
    """What :func:`stream_activity_retention` keeps under ``path``."""
    return BucketedTable(spark, path, schema, ["project_id"], buckets=buckets).read()


def _keyed_state(df: DataFrame) -> None:
    """Keyed state with timers lies in RocksDB, on the executors' disks and in the checkpoint."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class QuotaGate(StatefulProcessor):
    """At most ``limit`` accepted runs of a root within ``seconds``, in order of time.

    Events wait in chunks by the second that they are of, and are judged when the
    watermark has passed it; so a task holds one chunk, or one second of one root.
    """

    CHUNK = 1024

    def __init__(self, limit: int, seconds: int) -> None:
        self.limit, self.seconds = limit, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getMapState("counts", "second long", "chunks long")
        self.chunks = handle.getMapState("chunks", "second long, chunk long", "at array<long>, event_id array<string>")
        self.accepted = handle.getValueState("accepted", "at array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        for batch in rows:
            at = batch["ts"].astype("datetime64[us]").astype("int64")
            for second, part in batch.assign(at=at).groupby(at // 1_000_000, sort=False):
                second = int(second)
                n = self.counts.getValue((second,))[0] if self.counts.containsKey((second,)) else 0
                if not n:
                    self.handle.registerTimer((second + 1) * 1000)
                for i in range(0, len(part), self.CHUNK):
                    some = part.iloc[i : i + self.CHUNK]
                    self.chunks.updateValue((second, n), ([int(x) for x in some["at"]], [str(x) for x in some["event_id"]]))
                    n += 1
                self.counts.updateValue((second,), (n,))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        second = expiredTimerInfo.getExpiryTimeInMs() // 1000 - 1
        held = list(self.accepted.get()[0]) if self.accepted.exists() else []
        span = self.seconds * 1_000_000
        events: list[tuple[int, str]] = []
        if self.counts.containsKey((second,)):
            for i in range(self.counts.getValue((second,))[0]):
                at, names = self.chunks.getValue((second, i))
                events += zip(at, names, strict=True)
                self.chunks.removeKey((second, i))
            self.counts.removeKey((second,))
        said = []
        for at, _ in sorted(events):
            held = [h for h in held if at - h < span]
            said.append(len(held) < self.limit)
            if said[-1]:
                held.append(at)
        if events:
            self.accepted.update((held,))
            if held:
                self.handle.registerTimer((held[-1] + span) // 1000 // 1000 * 1000 + 1000)
        elif self.accepted.exists() and (not held or (second + 1) * 1_000_000 - held[-1] >= span):
            self.accepted.clear()  # nothing that still counts
        events.sort()
        if events:
            yield pd.DataFrame({"root": [key[0]] * len(events), "event_id": [e for _, e in events], "ts": pd.to_datetime([t for t, _ in events], unit="us"), "accepted": said})

    def close(self) -> None:
        pass


def stream_quota_gate(events: DataFrame, *, limit: int = 5, seconds: int = 60, late: str = "10 seconds") -> DataFrame:
    """``root, event_id, ts, accepted``: at most ``limit`` accepted runs of a root within ``seconds``.

    Rejected runs use up nothing, and an accepted one expires once it is
    ``seconds`` old.  Events are judged in order of time and id, across batches too,
    once they are ``late`` older than the newest one; later ones are dropped.  What
    is known of a root goes when nothing of it counts any more.
    """
    _keyed_state(events)
    rows = events.select("root", F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("string").alias("event_id")).withWatermark("ts", late)
    return rows.groupBy("root").transformWithStateInPandas(QuotaGate(limit, seconds), "root string, event_id string, ts timestamp, accepted boolean", "Append", "EventTime")


#: The events that a job's state depends on.
JOB_EVENTS = ("submitted", "started", "finished", "failed", "cancelled")


class JobStates(StatefulProcessor):
    """The state of a job by the first time of each kind of event; a kind goes ``forget`` seconds after it last came."""

    def __init__(self, timeout: int, forget: int | None) -> None:
        self.timeout, self.forget = timeout, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "event string", "at double", None if self.forget is None else 1000 * self.forget)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        for batch in rows:
            known = batch[batch["event"].isin(JOB_EVENTS)]
            for event, at in known.groupby("event")["at"].min().items():
                t = at.timestamp()
                if self.seen.containsKey((event,)):
                    t = min(t, self.seen.getValue((event,))[0])
                self.seen.updateValue((event,), (t,))
        first = {e: self.seen.getValue((e,))[0] if self.seen.containsKey((e,)) else None for e in JOB_EVENTS}
        started, finished, failed, cancelled = (first[e] for e in JOB_EVENTS[1:])
        ends = [t for t in (finished, failed) if t is not None]
        if cancelled is not None and (started is None or cancelled < started):
            now = "cancelled"
        elif started is None:
            now = "queued"
        elif not ends:
            now = "running"
        else:
            bad = failed is not None and (finished is None or failed < finished)
            now = "failed" if bad or min(ends) - started > self.timeout else "completed"
        yield pd.DataFrame({"job_id": [key[0]], "state": [now]})

    def close(self) -> None:
        pass


def stream_job_states(events: DataFrame, *, timeout: int = 180, forget: int | None = None) -> DataFrame:
    """``job_id, state`` after each batch of events (job_id, event, at), by the rules of the batch operator.

    With ``forget`` what is known of a job goes so many seconds after it came.
    """
    _keyed_state(events)
    return events.groupBy("job_id").transformWithStateInPandas(JobStates(timeout, forget), "job_id string, state string", "Update", "None" if forget is None else "ProcessingTime")


def stream_churn(changes: DataFrame) -> DataFrame:
    """Running totals of each path over a stream of parsed changes (repo_id, path, additions, deletions)."""
    return changes.groupBy("repo_id", "path").agg(F.count(F.lit(1)).alias("commits"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"))


def stream_commits(spark: SparkSession, path: str, *, again: str = "30 days") -> DataFrame:
    """Commits of every dump that comes to lie under ``path``, as the batch reader gives them, each once.

    A commit that comes in several dumps counts in the first; what has come is
    remembered until a file is ``again`` newer, and a file older than that is late
    and isn't read.
    """
    rows = spark.readStream.option("lineSep", RECORD).text(path).filter(F.trim("value") != "")
    rows = rows.select(F.regexp_extract("_metadata.file_path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("repo_id"), "value", F.col("_metadata.file_modification_time").alias("came"))
    commits = parse_log(rows, keep=("came",)).withWatermark("came", again)
    return commits.dropDuplicatesWithinWatermark(["repo_id", "sha"]).drop("came")


def stream_commit_churn(spark: SparkSession, path: str, *, again: str = "30 days") -> DataFrame:
    """Running totals of each path over the dumps that come to lie under ``path``; a commit counts once."""
    return stream_churn(commit_files(stream_commits(spark, path, again=again)))
