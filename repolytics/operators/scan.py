"""Row numbers, earlier rows and running values of a key, whatever share of all rows the key has.

A key with more than ``most`` rows is cut into ranges of its order, which are
worked apart; what a range needs of the ones before it (a count, a last row, a
total) is summed up for each range and carried over.  The first column of the
order is a number, date or timestamp; rows that tie in it stay in one range.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolytics.checkpoints import checkpointed

#: Rows of a key that one task may sort.
SEGMENT_ROWS = 1_000_000
#: Ranges that a key is cut into at most; each is a comparison for a row of such a key.
MOST_SEGMENTS = 2_000
#: Keys whose bounds may be broadcast; beyond it that join shuffles.
BROADCAST_KEYS = 1_000


def with_segments(df: DataFrame, keys: Sequence[str], by: str, *, most: int = SEGMENT_ROWS, name: str = "segment") -> tuple[DataFrame, bool]:
    """``df`` with the range that a row lies in, and whether any key has more than one.

    Keys of ``most`` rows at most are one range, 0.  Null is before all values.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most)
    found = sizes.agg(F.count(F.lit(1)).alias("keys"), F.max("_n").alias("rows")).first()
    if not found.keys:
        return df.withColumn(name, F.lit(0)), False
    parts = min(MOST_SEGMENTS, -(-found.rows // most))
    cuts = F.percentile_approx(by, [i / parts for i in range(1, parts)], 20 * parts)
    large = sizes.select(*[F.col(k).alias(f"_{k}") for k in keys])
    small = found.keys <= BROADCAST_KEYS
    large = F.broadcast(large) if small else large
    bounds = df.select(*keys, by).join(large, _same(keys), "left_semi").groupBy(*keys).agg(cuts.alias("_cuts"))
    bounds = checkpointed(bounds.select(*[F.col(k).alias(f"_{k}") for k in keys], F.array_distinct("_cuts").alias("_cuts")))
    bounds = F.broadcast(bounds) if small and found.keys * parts <= 100_000 else bounds
    rows = df.join(bounds, _same(keys), "left").drop(*[f"_{k}" for k in keys])
    below = F.size(F.filter("_cuts", lambda c: c < F.col(by)))
    return rows.withColumn(name, F.when(F.col("_cuts").isNull() | F.col(by).isNull(), 0).otherwise(below)).drop("_cuts"), True


def _same(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])


def carried(totals: DataFrame, keys: Sequence[str], segment: str, values: dict[str, Column]) -> DataFrame:
    """``values`` over the ranges before a range, keyed ``_<key>, _<segment>``; one row for a range that has any before it.

    Each value is a window expression's aggregate, such as ``F.sum("n")`` or ``F.last("row")``.
    """
    before = Window.partitionBy(*keys).orderBy(segment).rowsBetween(Window.unboundedPreceding, -1)
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(segment))
    rows = totals.select(*[F.col(k).alias(f"_{k}") for k in (*keys, segment)], first.alias("_at"), *[v.over(before).alias(n) for n, v in values.items()])
    return rows.filter(F.col("_at") > 1).drop("_at")


def with_carried(rows: DataFrame, before: DataFrame, keys: Sequence[str], segment: str) -> DataFrame:
    """Each row with what :func:`carried` found for its range, or nulls."""
    return rows.join(before, _same([*keys, segment]), "left").drop(*[f"_{k}" for k in (*keys, segment)])


def numbered(df: DataFrame, keys: Sequence[str], by: str, then: Sequence[Column] = (), *, name: str = "position", most: int = SEGMENT_ROWS) -> DataFrame:
    """``df`` with each row's number among its key's rows, from 1, by ``by`` (null first) and then by ``then``."""
    rows, several = with_segments(df, keys, by, most=most, name="_segment")
    order = Window.partitionBy(*keys, "_segment").orderBy(F.asc_nulls_first(by), *then)
    out = rows.withColumn(name, F.row_number().over(order).cast("long"))
    if several:
        before = carried(rows.groupBy(*keys, "_segment").agg(F.count(F.lit(1)).alias("_n")), keys, "_segment", {"_before": F.sum("_n")})
        out = with_carried(out, before, keys, "_segment").withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0))).drop("_before")
    return out.drop("_segment")


def with_previous(df: DataFrame, keys: Sequence[str], by: str, then: Sequence[str], value: Column, *, name: str = "previous", most: int = SEGMENT_ROWS) -> DataFrame:
    """``df`` with ``value`` of the key's row before, by ``by`` (null first) and then by ``then``; null for the first row."""
    rows, several = with_segments(df, keys, by, most=most, name="_segment")
    order = Window.partitionBy(*keys, "_segment").orderBy(F.asc_nulls_first(by), *then)
    local = F.lag(F.struct(value.alias("v"))).over(order)
    if not several:
        return rows.withColumn(name, local["v"]).drop("_segment")
    rows = rows.withColumn("_own", F.struct(value.alias("v")))
    turn = F.struct(F.col(by).isNotNull(), F.col(by), *then)
    before = carried(rows.groupBy(*keys, "_segment").agg(F.max_by("_own", turn).alias("_end")), keys, "_segment", {"_before": F.last("_end")})
    out = with_carried(rows.withColumn("_local", F.lag("_own").over(order)), before, keys, "_segment")
    return out.withColumn(name, F.coalesce("_local", "_before")["v"]).drop("_segment", "_own", "_local", "_before")
