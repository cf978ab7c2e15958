"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Every distinct fingerprint emits all variants within half the radius.  Two
fingerprints within the radius share a variant, so the shuffle on variants brings
them together; what meets at one variant is a chain of neighbours there, is
verified by the distance, and goes into connected components.  Equal texts and
equal fingerprints are one row before anything is emitted, and at one variant at
most as many distinct fingerprints can meet as the ball has members.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolytics.llm.common import saved
from repolytics.llm.graph import connected_components

SEED = 42
_VOTES_AT_ONCE = 1 << 15


def fingerprint_of(text: str | None, width: int = 3) -> int:
    """The fingerprint of one text, unsigned; texts without words have zero."""
    words = (text or "").encode().lower().split()  # splits at 0x20 and 0x09-0x0D
    if not words:
        return 0
    if len(words) <= width:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    else:
        joined = b" ".join(words)
        ends = list(accumulate(len(w) + 1 for w in words))
        starts = [0, *ends[: len(words) - width]]
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[width - 1 :], strict=True)], np.uint64)
    votes = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _VOTES_AT_ONCE):
        part = np.ascontiguousarray(hashes[i : i + _VOTES_AT_ONCE], dtype="<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(votes * 2 > len(hashes)).tolist())


def simhash(text: Column, width: int = 3) -> Column:
    """Fingerprint of ``text`` as a signed long."""

    @F.arrow_udf("long")
    def fingerprints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(np.array([fingerprint_of(t.as_py(), width) for t in batch], np.uint64).view(np.int64), pa.int64())

    return fingerprints(text)


def ball(radius: int, width: int = 64) -> list[int]:
    """All masks of at most ``radius`` of ``width`` bits, as signed longs."""
    masks = [sum(1 << i for i in bits) for n in range(radius + 1) for bits in combinations(range(width), n)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def fingerprint_links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """``src, dst``: links that join all ``print`` within ``radius`` bits, of distinct ones."""
    if radius % 2 or radius < 0:
        raise ValueError("the radius must be even: half of it is spent on either side")
    masks = F.array(*[F.lit(m).cast("long") for m in ball(radius // 2)])
    variants = prints.select("print", F.explode(masks).alias("mask")).select("print", F.col("print").bitwiseXOR(F.col("mask")).alias("variant"))
    before = F.lag("print").over(Window.partitionBy("variant").orderBy("print"))
    pairs = variants.select("print", before.alias("other")).filter(F.col("other").isNotNull())
    return pairs.filter(F.bit_count(F.col("print").bitwiseXOR(F.col("other"))) <= radius).select(F.col("other").alias("src"), F.col("print").alias("dst")).distinct()


def simhash_components(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", radius: int = 2, width: int = 3) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row.

    Words are what stands between ASCII white space after lower-casing A-Z; a bit
    of the fingerprint is set if it is set in over half of the hashes of all
    ``width``-word shingles.  A text of fewer words is one shingle; null texts
    and texts without words have fingerprint zero, and link like any other.
    ``component_id`` is the smallest id that links lead to.  Repeated rows stay;
    null ids are kept and lie in the component of their fingerprint, whose id is
    then the smallest id that isn't null.
    """
    prints = saved(docs.select(F.col(doc_id).alias("doc_id"), simhash(F.col(text), width).alias("print")), "prints")
    distinct = saved(prints.groupBy("print").agg(F.min("doc_id").alias("first")), "distinct-prints")
    parts = connected_components(fingerprint_links(distinct, radius)).withColumnRenamed("node", "print")
    roots = distinct.join(parts, "print", "left").withColumn("component", F.coalesce("component", "print"))
    least = roots.groupBy("component").agg(F.min("first").alias("component_id"))
    roots = saved(roots.join(least, "component").select("print", "component_id"), "print-components")
    fingerprint = F.lower(F.lpad(F.hex("print"), 16, "0"))
    return prints.join(roots, "print", "left").select(F.col("doc_id").alias(doc_id), fingerprint.alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", **how: object) -> DataFrame:
    """``docs`` with one document of each component: the one whose id names it.

    Rows that repeat an id all stay or all go.  Rows whose id is null stay: nothing names them.
    """
    found = simhash_components(docs.filter(F.col(doc_id).isNotNull()), doc_id=doc_id, **how)
    gone = found.filter(F.col(doc_id) != F.col("component_id")).select(doc_id).distinct()
    return docs.join(gone, doc_id, "left_anti").select(*docs.columns)
