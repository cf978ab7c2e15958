"""Rounding, day counts and tab expansion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def even_round(x: Column, digits: int = 0) -> Column:
    """Half-to-even rounding of a double, scaled by a power of ten; null stays null."""
    scale = float(10**digits)
    return F.rint(x * F.lit(scale)) / F.lit(scale)


def days_since(ts: Column, as_of: Column) -> Column:
    """Whole days from ``ts`` to ``as_of``, rounded down; negative for later times."""
    return F.floor((F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / F.lit(86_400_000_000)).cast("long")


def expanded_length(line: Column, tab: int = 4) -> Column:
    """Characters of a line once each tab reaches to the next multiple of ``tab``."""
    parts = F.split(line, "\t")
    before = F.aggregate(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.lit(0), lambda n, p: (F.floor((n + F.length(p)) / tab) + 1).cast("int") * tab)
    return before + F.length(F.element_at(parts, -1))


def splitlines(text: Column) -> Column:
    """Lines of a text: any of the usual line ends parts them, and no empty line follows the last end."""
    parts = F.split(text, "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]")

    def kept(lines: Column) -> Column:
        return F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)

    # The parts stand for themselves in an array of one, so that the text, which may be costly, is worked out once.
    return F.get(F.transform(F.array(parts), kept), F.lit(0))
