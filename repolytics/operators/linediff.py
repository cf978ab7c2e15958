"""Added and deleted lines between two versions of a text.

Lines are compared by 64-bit hashes that Spark takes; what crosses to Python are
two arrays of numbers for a changed file.  The longest common subsequence is
found exactly with the bits of whole numbers: one addition for each line of the
longer side, over as many bits as the shorter one has lines.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from repolytics.functions.scalars import splitlines


def common_length(a: Sequence[int], b: Sequence[int]) -> int:
    """Length of the longest common subsequence."""
    start, end = 0, 0
    short = min(len(a), len(b))
    while start < short and a[start] == b[start]:
        start += 1
    while end < short - start and a[-1 - end] == b[-1 - end]:
        end += 1
    shared = set(a[start : len(a) - end]) & set(b[start : len(b) - end])
    left, right = ([x for x in side[start : len(side) - end] if x in shared] for side in (a, b))
    if len(left) > len(right):
        left, right = right, left
    places: dict[int, int] = {}
    for i, x in enumerate(left):
        places[x] = places.get(x, 0) | 1 << i
    every = (1 << len(left)) - 1
    open_ = every  # a bit falls where the common subsequence grows
    for x in right:
        hit = open_ & places[x]
        open_ = (open_ + hit | open_ - hit) & every
    return start + end + len(left) - open_.bit_count()


def _counts(before: pa.Array, after: pa.Array) -> pa.Array:
    return pa.array([common_length(b.as_py(), a.as_py()) if b.is_valid and a.is_valid else 0 for b, a in zip(before, after, strict=True)], pa.int64())


_counts.__annotations__ = {"before": pa.Array, "after": pa.Array, "return": pa.Array}


def line_hashes(text: Column) -> Column:
    """A hash of each line of a text; none of a null text."""
    return F.transform(F.coalesce(splitlines(text), F.array().cast("array<string>")), lambda x: F.xxhash64(x))


def common_lines(before: Column, after: Column) -> Column:
    """Lines that two arrays of hashes have in common, in order."""
    return F.arrow_udf(_counts, LongType())(before, after)
