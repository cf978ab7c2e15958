"""Mix sources to target weights by Pareto order sampling.

A source's target is its share of all words by weight, at most ``cap`` times its
own words; what exceeds that is reshared by weight.  Every document of a source
is due ``target / source words`` copies (times its relative ``weight``, if one is
given): the whole part is taken as certain copies, and the fractional part is an
inclusion probability.  Documents are then ranked by their random odds divided by
their inclusion odds, and the first ones fill the words that the certain copies
leave open.  The cut is found by two histograms of 256 buckets for a source and
an exact cumulated sum inside the last bucket, so no task holds a source.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolytics.llm.common import packed, saved, small, unpacked

WORDS = r"[^\x20\x09-\x0D]+"
LEVEL = 256


@dataclass
class Mix:
    """Per source: ``_key, source_size, target`` and where its ranking is cut."""

    sources: DataFrame
    rows: int


def _key(source: Column) -> Column:
    """A source as a join key that null and every string keep apart."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def _odds(doc_id: Column, seed: int) -> Column:
    """Random odds u / (1 - u) of a document; 52 bits of a digest of its id."""
    text = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}"))
    u = (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))
    return u / (F.lit(1.0) - u)


def _due(weight: Column | None, cap: int) -> Column:
    """Copies of a document that its source's target asks for."""
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    if weight is not None:
        rate = F.least(rate * F.greatest(weight, F.lit(0.0)) / F.col("mean_weight"), F.lit(float(cap)))
    return rate


def _rank(odds: Column, due: Column) -> Column:
    """Random odds divided by inclusion odds; null where nothing is left to draw."""
    part = due - F.floor(due)
    return F.when(part > 0, odds / (part / (F.lit(1.0) - part)))


def _bucket(rank: Column, level: int) -> Column:
    """The rank's place among LEVEL ** level steps of r / (1 + r), which is below 1."""
    steps = LEVEL**level
    return F.least(F.floor(rank / (F.lit(1.0) + rank) * steps), F.lit(steps - 1)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], cap: int) -> DataFrame:
    """``_key, source, source_size`` to the same with ``target``.

    Sources by code point, null last, get the weights in turn.  They are few (one
    row each), so one ordered window over them is what is wanted.
    """
    turn = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(F.row_number().over(turn) - 1, F.lit(len(weights))) + 1).cast("int"))
    out = sizes.withColumn("_w", w.cast("long")).withColumn("_full", F.col("source_size") * cap)
    # Sources fill up in the order of full size by weight; the k-th is full if an equal share by weight of what the
    # first k-1 leave would exceed it.
    order = Window.orderBy(F.col("_full") / F.col("_w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("_full").over(before), F.lit(0))
    rest = F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0))
    out = out.withColumn("_share", left / rest).withColumn("_k", F.row_number().over(order))
    # The share of the first source that isn't full holds for all that come after it.
    level = F.min(F.when(F.col("_share") * F.col("_w") <= F.col("_full"), F.struct("_k", "_share"))).over(whole)["_share"]
    return out.withColumn("target", F.least(F.col("_full").cast("double"), F.coalesce(level * F.col("_w"), F.col("_full").cast("double")))).drop("_w", "_full", "_share", "_k")


def plan_mix(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[int] = (5, 2, 1), cap: int = 3, seed: int = 7, weight: Column | None = None) -> Mix:
    """Targets of all sources and the rank at which each source's sample ends."""
    w = F.lit(1.0) if weight is None else F.coalesce(weight.cast("double"), F.lit(0.0))
    sized = docs.select(F.col(source).alias("source"), _key(F.col(source)).alias("_key"), _odds(F.col(doc_id), seed).alias("_odds"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long").alias("size"), w.alias("_weight"))
    sized = saved(sized, "mix-sizes")
    sources = sized.groupBy("_key", "source").agg(F.sum("size").alias("source_size"), (F.sum(F.col("size") * F.col("_weight")) / F.sum("size").cast("double")).alias("mean_weight") if weight is not None else F.lit(1.0).alias("mean_weight"))
    sources = saved(source_targets(sources, weights, cap), "mix-sources")
    rows = sources.count()
    due = _due(F.col("_weight") if weight is not None else None, cap)
    ranked = sized.drop("source").join(small(sources, rows), "_key").withColumn("_due", due)
    ranked = saved(ranked.select("_key", "size", F.floor("_due").alias("whole"), _rank(F.col("_odds"), F.col("_due")).alias("rank")), "mix-ranks")
    certain = ranked.groupBy("_key").agg(F.sum(F.col("size") * F.col("whole")).alias("certain"))
    cut = sources.join(small(certain, rows), "_key").select("_key", (F.col("target") - F.col("certain")).alias("open"), F.lit(0).cast("long").alias("bucket"))
    drawn = ranked.filter(F.col("rank").isNotNull()).drop("whole")
    for level in (1, 2):
        inside = drawn.withColumn("b", _bucket(F.col("rank"), level)).join(small(cut, rows), "_key").filter(F.floor(F.col("b") / LEVEL) == F.col("bucket"))
        hist = inside.groupBy("_key", "open", "b").agg(F.sum("size").alias("words"))
        upto = Window.partitionBy("_key").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
        hist = hist.withColumn("upto", F.sum("words").over(upto)).filter(F.col("upto") > F.col("open"))
        cut = saved(hist.groupBy("_key").agg(F.min_by(F.struct("b", (F.col("open") - F.col("upto") + F.col("words")).alias("open")), "b").alias("x")).select("_key", F.col("x.open").alias("open"), F.col("x.b").alias("bucket")), "mix-cut")
    inside = drawn.join(small(cut, rows), "_key").filter(_bucket(F.col("rank"), 2) == F.col("bucket"))
    inside = inside.groupBy("_key", "open", "rank").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("_key").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    last = inside.withColumn("upto", F.sum("words").over(upto)).filter(F.col("upto") - F.col("words") / 2 <= F.col("open")).groupBy("_key").agg(F.max("rank").alias("last"))
    ends = cut.select("_key", "bucket").join(small(last, rows), "_key", "left")
    return Mix(saved(sources.join(small(ends, rows), "_key", "left"), "mix-plan"), rows)


def mix_sources(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[int] = (5, 2, 1), cap: int = 3, seed: int = 7, weight: Column | None = None) -> DataFrame:
    """``docs`` with ``size, source_size, target, copies, taken`` of each document.

    ``size`` is the number of words, ``taken`` is ``size * copies``, and no
    document is taken more than ``cap`` times.  Null and empty texts have size 0
    and take nothing.  Null sources are one source, ranked last.  Rows that repeat
    an id share its random odds, so they are taken alike; no rows give no rows.
    The five names above are replaced if ``docs`` has them.  A document's draw
    depends on its id and ``seed`` only, so reruns agree.
    """
    plan = plan_mix(docs, doc_id=doc_id, text=text, source=source, weights=weights, cap=cap, seed=seed, weight=weight)
    w = None if weight is None else F.coalesce(weight.cast("double"), F.lit(0.0))
    own = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies", "taken")]
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long")
    rows = docs.select(packed(docs).alias("own"), _key(F.col(source)).alias("_key"), _odds(F.col(doc_id), seed).alias("_odds"), size.alias("size"), (F.lit(1.0) if w is None else w).alias("_weight"))
    kept = plan.sources.select("_key", "source_size", "target", "mean_weight", "bucket", "last")
    rows = rows.join(small(kept, plan.rows), "_key").withColumn("_due", _due(None if w is None else F.col("_weight"), cap))
    rank = _rank(F.col("_odds"), F.col("_due"))
    bucket = _bucket(rank, 2)
    drawn = rank.isNotNull() & (F.col("bucket").isNull() | (bucket < F.col("bucket")) | ((bucket == F.col("bucket")) & (rank <= F.coalesce(F.col("last"), F.lit(-1.0)))))
    copies = F.floor("_due") + F.coalesce(drawn, F.lit(False)).cast("long")
    rows = rows.withColumn("copies", copies.cast("long")).withColumn("taken", F.col("size") * F.col("copies"))
    return rows.select(*unpacked("own", own), "size", "source_size", "target", "copies", "taken")


QUERY_COLUMNS = ("doc_id", "size", "source_size", "target", "taken")

SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':7'), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w, source_size * 3 AS full_size FROM s
), c AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(full_size) OVER o, 0))::BIGINT::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER o, 0))::BIGINT::DOUBLE AS share,
         row_number() OVER (ORDER BY full_size::DOUBLE / w, source ASC NULLS LAST) AS k
  FROM w WINDOW o AS (ORDER BY full_size::DOUBLE / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, least(full_size::DOUBLE, coalesce((arg_min(share, k) FILTER (WHERE share * w <= full_size) OVER ()) * w, full_size::DOUBLE)) AS target FROM c
), e AS (
  SELECT d.doc_id, d.size, d.u, d.source, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size::DOUBLE ELSE 0.0::DOUBLE END AS due
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), r AS (
  SELECT *, floor(due)::BIGINT AS whole, CASE WHEN due - floor(due) > 0 THEN (u / (1.0::DOUBLE - u)) / ((due - floor(due)) / (1.0::DOUBLE - (due - floor(due)))) END AS rank FROM e
), m AS (
  SELECT *, target - sum(size * whole) OVER (PARTITION BY source)::DOUBLE AS open,
         sum(CASE WHEN rank IS NULL THEN 0 ELSE size END) OVER (PARTITION BY source ORDER BY rank NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS upto
  FROM r
)
SELECT doc_id, size, source_size, target, size * (whole + CASE WHEN rank IS NOT NULL AND upto - size / 2.0::DOUBLE <= open THEN 1 ELSE 0 END) AS taken FROM m
"""
