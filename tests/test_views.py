"""Views that are written once follow their tables."""

import tempfile

from repolytics.plans import adapters


def test_a_rewritten_table_is_seen(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    asked = []

    def rows():
        asked.append(1)
        return spark.read.parquet(f"{folder}/orders.parquet")

    spark.range(3).write.parquet(f"{folder}/orders.parquet")
    assert adapters.once(spark, folder, "x", rows).count() == adapters.once(spark, folder, "x", rows).count() == 3
    spark.range(5).write.mode("overwrite").parquet(f"{folder}/orders.parquet")
    assert adapters.once(spark, folder, "x", rows).count() == 5 and len(asked) == 2
