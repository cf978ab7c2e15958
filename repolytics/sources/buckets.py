"""Tables of which an update rewrites only the parts that it touches.

A table lies in hash buckets of its key, each in a folder ``v=<version>/bucket=<n>``.
An update writes a new version of the buckets that its rows fall into; the others
stay where they are.  A version counts once it is written whole, and one that is
written again replaces itself, so an update that is run again does no harm; what
a bucket held before the last update stays until the next one.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


class BucketedTable:
    """A table under ``path`` with rows of ``schema``, in ``buckets`` buckets of ``keys``."""

    def __init__(self, spark: SparkSession, path: str, schema, keys: Sequence[str], *, buckets: int = BUCKETS) -> None:  # noqa: ANN001
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path.rstrip("/"), schema, list(keys), buckets
        self._hadoop = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._hadoop(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def bucket(self) -> Column:
        """The bucket of a row."""
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def versions(self) -> dict[int, list[int]]:
        """The whole versions of each bucket, oldest first; as many folders as there are buckets, and a few more."""
        found: dict[int, list[int]] = {}
        whole: dict[int, bool] = {}
        for status in self._files.globStatus(self._hadoop(f"{self.path}/v=*/bucket=*")) or ():
            where = status.getPath()
            version = int(where.getParent().getName().split("=")[1])
            if version not in whole:
                whole[version] = self._files.exists(self._hadoop(f"{self.path}/v={version}/_SUCCESS"))
            if whole[version]:
                found.setdefault(int(where.getName().split("=")[1]), []).append(version)
        return {b: sorted(v) for b, v in found.items()}

    def _rows(self, parts: Sequence[tuple[int, int]]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/v={v}/bucket={b}" for b, v in parts])

    def read(self) -> DataFrame:
        """All rows as the last update left them."""
        return self._rows([(b, v[-1]) for b, v in self.versions().items()])

    def update(self, rows: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], version: int) -> list[int]:
        """Put ``merge(what the touched buckets hold, rows)`` in place of these buckets, and return their numbers.

        ``version`` is greater than those before it, or is the last one again; ``rows`` hold the keys.
        """
        touched = sorted(r.bucket for r in rows.select(self.bucket().alias("bucket")).distinct().collect())
        if not touched:
            return []
        before = {b: [x for x in v if x < version] for b, v in self.versions().items()}
        held = self._rows([(b, before[b][-1]) for b in touched if before.get(b)])
        merged = merge(held, rows).withColumn("bucket", self.bucket())
        # Rows of a bucket come together, and a bucket with most of the rows is split over several tasks.
        merged.hint("rebalance", "bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{self.path}/v={version}")
        for b in touched:
            for old in before.get(b, [])[:-1]:
                self._files.delete(self._hadoop(f"{self.path}/v={old}/bucket={b}"), True)
        return touched
