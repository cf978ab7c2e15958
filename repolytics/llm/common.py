"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table that may be broadcast whole; beyond it a join shuffles.
BROADCAST_ROWS = 50_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and all runs in one process (as in tests) a
    folder of our own is set; on a cluster such a folder wouldn't be shared.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith(("local[", "local,")) and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def bounded_batches(spark: SparkSession, most: str = "8m") -> None:
    """Let the session hand texts to Python in Arrow batches of ``most`` bytes: whole texts vary a thousandfold in length."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", most)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    This cuts the lineage, lets several branches read one result, and survives
    the loss of executors.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Remove tables that :func:`saved` wrote and nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        folder = f"{shared_dir(spark)}/"
        paths = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
        for path in paths:
            if path.split(":", 1)[-1].lstrip("/").startswith(folder.split(":", 1)[-1].lstrip("/")):
                hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
                hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def packed(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct, so that their names meet none of an operator's."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def unpacked(own: str, names: Sequence[str]) -> list[Column]:
    """The columns that :func:`packed` put into ``own``."""
    return [F.col(own)[n].alias(n) for n in names]


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it is known to have ``limit`` rows at most."""
    return F.broadcast(df) if rows <= limit else df


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def text_slices(batches: Iterator[pa.RecordBatch], text: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``most`` bytes of text, or one row."""
    for batch in batches:
        col = batch.column(text)
        if not len(col):
            continue
        sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        yield batch.slice(start)
