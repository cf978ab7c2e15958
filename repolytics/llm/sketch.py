"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every shingle hash below a fixed fraction of the hash range, so
sketches of parts merge by union, and containment can be told between documents
of very unequal length.  A text none of whose hashes is below the threshold keeps
its smallest; in a merge that one yields to any hash below the threshold, and
between two texts it says only whether their smallest hashes are the same.
Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolytics.llm.common import saved

#: Of 2 ** FRACTION_BITS hashes one is kept.
FRACTION_BITS = 2
BUCKET_ROWS = 1024
MOST_BUCKETS = 50_000
#: Ids that are drawn for each range.
DRAWN = 8


def sketch(text: Column, width: int = 5, bits: int = FRACTION_BITS) -> Column:
    """The kept hashes of all ``width``-word shingles, sorted; empty without words.

    Words are what stands between ASCII white space, lower-cased; a text of fewer
    words is one shingle.
    """
    words = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def hashes(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))
        return F.when(F.size(w) > width, many).when(F.size(w) > 0, F.array(F.xxhash64(F.concat_ws(" ", w)))).otherwise(F.array().cast("array<bigint>"))

    def kept(h: Column) -> Column:
        # As unsigned numbers: the top bits are zero below the threshold, and the sign bit counts most.
        low = F.filter(h, lambda x: F.shiftrightunsigned(x, 64 - bits) == 0)
        flip = F.lit(-(1 << 63)).cast("long")
        least = F.array_min(F.transform(h, lambda x: x.bitwiseXOR(flip)))
        return F.when(F.size(low) > 0, F.array_sort(F.array_distinct(low))).when(F.size(h) > 0, F.array(least.bitwiseXOR(flip))).otherwise(low)

    return _let(_let(words, hashes), kept)


def _let(value: Column, use) -> Column:  # noqa: ANN001
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def sketch_string(hashes: Column) -> Column:
    """A sketch as 16 hexadecimal digits a hash."""
    return F.array_join(F.transform(hashes, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def merge_sketches(a: Column, b: Column, bits: int = FRACTION_BITS) -> Column:
    """The sketch of two texts' shingles together."""
    both = F.array_sort(F.array_union(a, b))
    low = F.filter(both, lambda x: F.shiftrightunsigned(x, 64 - bits) == 0)
    flip = F.lit(-(1 << 63)).cast("long")
    least = F.array_min(F.transform(both, lambda x: x.bitwiseXOR(flip)))
    return F.when(F.size(low) > 0, low).when(F.size(both) > 0, F.array(least.bitwiseXOR(flip))).otherwise(both)


def containment(a: Column, b: Column) -> Column:
    """Share of the smaller sketch that the other one has; 1 if both are empty, 0 if one is."""
    least = F.least(F.size(a), F.size(b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when(least == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / least)


def _bucket(bounds: list, doc_id: Column, kind: str) -> Column:
    """How many bounds are at most ``doc_id``, by binary search."""
    if not bounds:
        return F.lit(0)
    table = F.array(*[F.lit(b).cast(kind) for b in bounds])
    # lo bounds are known to be at most doc_id; each step tries to add its power of two.
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda lo, step: F.when(F.get(table, lo + step - 1) <= doc_id, lo + step).otherwise(lo))


def with_next(rows: DataFrame, doc_id: str = "doc_id", carry: tuple[str, ...] = ("text", "kept"), bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``rows`` with ``next_<c>`` of the row with the next higher id; after the last comes the first.

    Ranges of about ``bucket_rows`` ids are ordered each by itself, and the first
    row of a range is sent to the range before it as well.  Rows that share an id
    follow each other by the hash of their text; null ids come first.  Ids may be
    of any type that has an order (text goes by code point).
    """
    keys = saved(rows.select(F.col(doc_id).alias("id"), F.xxhash64("text").alias("tie")), "ids")
    count = keys.count()
    want = max(1, min(MOST_BUCKETS, -(-count // bucket_rows)))
    bounds: list = []
    if want > 1:
        # Every so many of a sample's ids, of which there are a few for each range.
        drawn = keys.filter(F.pmod(F.xxhash64("id", "tie", F.lit(5)), F.lit(1 << 20)) < int(min(1.0, DRAWN * want / count) * (1 << 20)))
        ids = sorted(r.id for r in drawn.select("id").filter(F.col("id").isNotNull()).collect())
        bounds = sorted(set(ids[DRAWN::DRAWN]))
    place = F.coalesce(_bucket(bounds, F.col("id"), keys.schema["id"].dataType.simpleString()), F.lit(0))
    # The first row of each range that has rows, and the range it goes to besides: the one before, or the last.
    heads = keys.groupBy(place.alias("bucket")).agg(F.min(F.struct(F.col("id").isNotNull().alias("known"), "id", "tie")).alias("head"))
    order = Window.orderBy("bucket")
    heads = heads.select(F.col("head.id").alias("id"), F.col("head.tie").alias("tie"), F.coalesce(F.lag("bucket").over(order), F.max("bucket").over(Window.partitionBy())).alias("bucket"), F.lag("bucket").over(order).isNull().alias("wraps"))
    heads = saved(heads, "heads")
    named = rows.withColumn("id", F.col(doc_id)).withColumn("tie", F.xxhash64("text"))
    own = named.withColumn("bucket", place).withColumn("extra", F.lit(0))
    # One row for each range: at most MOST_BUCKETS of them.
    sent = named.join(F.broadcast(heads), (named["id"].eqNullSafe(heads["id"])) & (named["tie"] == heads["tie"])).drop(heads["id"]).drop(heads["tie"])
    sent = sent.withColumn("extra", F.when(F.col("wraps"), F.lit(2)).otherwise(F.lit(1))).drop("wraps")
    nexts = Window.partitionBy("bucket").orderBy("extra", F.col("id").asc_nulls_first(), "tie")
    out = own.unionByName(sent).select("*", *[F.lead(c).over(nexts).alias(f"next_{c}") for c in carry])
    return out.filter(F.col("extra") == 0).drop("id", "tie", "bucket", "extra")


def fingerprint_report(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 5) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how like they are.

    The edited text is the text whose last ``n_chars div 2`` code points are
    replaced by as many first ones (or all) of the next document.  A null text is
    empty; an empty text has an empty fingerprint.  A single document is its own
    next one.  Rows that repeat an id follow each other, each once; no rows give
    no rows.
    """
    rows = docs.select(doc_id, F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("kept", sketch(F.col("text"), width))
    both = with_next(rows, doc_id)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    out = both.select(doc_id, "kept", "next_kept", n.cast("long").alias("n_chars"), edited.alias("edited"))
    out = out.withColumn("edited_kept", sketch(F.col("edited"), width))
    return out.select(
        doc_id,
        "n_chars",
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        sketch_string(F.col("kept")).alias("fingerprint"),
        sketch_string(F.col("edited_kept")).alias("edited_fingerprint"),
        containment(F.col("kept"), F.col("edited_kept")).cast("double").alias("near_edited"),
        containment(F.col("kept"), F.col("next_kept")).cast("double").alias("near_next"),
    )
