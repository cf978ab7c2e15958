"""Views that Spark makes of numbers are those of their SQL."""

import re
import tempfile

import pytest
from pyspark.sql import functions as F

from repolytics.plans import adapters


def sql_of(spark, sf_dir, name):
    sql = adapters.VIEWS[name].replace("{", "{{").replace("}", "}}")
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem")}
    return spark.sql(re.sub(r"\b(FROM|JOIN) (orders|lineitem)\b", r"\1 {\2}", sql), **tables)


@pytest.fixture(scope="module")
def odd(spark, sf_dir):
    """Orders whose lines share paths: all parts of an order are of two kinds, some parts, orders and customers are null."""
    folder = tempfile.mkdtemp(prefix="spark-")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    part = F.when(F.col("l_linenumber") % 3 == 0, F.col("l_partkey") * 101 + 19).when(F.col("l_linenumber") % 3 == 1, F.col("l_partkey") * 101 + F.col("l_orderkey") % 26).when(F.col("l_orderkey") % 50 > 0, F.col("l_partkey"))
    lines.withColumn("l_partkey", part.cast(lines.schema["l_partkey"].dataType)).write.parquet(f"{folder}/lineitem.parquet")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    orders.withColumn("o_custkey", F.when(F.col("o_orderkey") % 31 > 0, F.col("o_custkey") % 9)).write.parquet(f"{folder}/orders.parquet")
    return folder


@pytest.mark.parametrize("name", adapters.WRITTEN)
def test_numbered_view(spark, odd, name):
    got, expected = adapters.view(spark, odd, name), sql_of(spark, odd, name)
    assert got.columns == expected.columns and [t for _, t in got.dtypes] == [t for _, t in expected.dtypes]
    assert expected.count() > 50 and got.exceptAll(expected).isEmpty() and expected.exceptAll(got).isEmpty()


def test_names_are_made_after_the_shuffle(spark, sf_dir):
    """Before, the edges were told apart by their paths, which were shuffled for it."""
    tables = [spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders")]
    plan = adapters._edges(*tables)._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"hashpartitioning\(([a-z_]+)#", plan)
    assert "r" in keys and not {"repo_id", "source", "target"} & set(keys)
