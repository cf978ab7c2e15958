"""Texts as arrays of code points, and what each code point is."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from functools import cache

import numpy as np

SIZE = 0x110000

#: Scripts by ranges of code points (first, last), as Unicode allots its blocks.
SCRIPT_RANGES = (
    ("latin", ((0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x250, 0x2AF), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A))),
    ("greek", ((0x370, 0x3FF), (0x1F00, 0x1FFF))),
    ("cyrillic", ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F))),
    ("armenian", ((0x530, 0x58F),)),
    ("hebrew", ((0x590, 0x5FF), (0xFB1D, 0xFB4F))),
    ("arabic", ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF))),
    ("devanagari", ((0x900, 0x97F),)),
    ("bengali", ((0x980, 0x9FF),)),
    ("tamil", ((0xB80, 0xBFF),)),
    ("thai", ((0xE00, 0xE7F),)),
    ("georgian", ((0x10A0, 0x10FF), (0x1C90, 0x1CBF))),
    ("hangul", ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF))),
    ("kana", ((0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F))),
    ("han", ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF))),
)
SCRIPTS = ("other", *(name for name, _ in SCRIPT_RANGES))


@cache
def letters() -> np.ndarray:
    """1 for letters, 2 for marks, 3 for numbers, 4 for white space, 0 for the rest."""
    kinds = {"L": 1, "M": 2, "N": 3, "Z": 4}
    table = np.array([kinds.get(unicodedata.category(chr(c))[0], 0) for c in range(SIZE)], np.uint8)
    table[[9, 10, 11, 12, 13, 0x1C, 0x1D, 0x1E, 0x1F, 0x85]] = 4
    return table


@cache
def lower() -> np.ndarray:
    """The lower-case code point where that is a single one, else the code point itself."""
    table = np.arange(SIZE, dtype=np.uint32)
    for c in range(SIZE):
        if 0xD800 <= c < 0xE000:
            continue
        low = chr(c).lower()
        if len(low) == 1:
            table[c] = ord(low)
    return table


@cache
def scripts() -> np.ndarray:
    table = np.zeros(SIZE, np.uint8)
    for k, (_, ranges) in enumerate(SCRIPT_RANGES, 1):
        for a, b in ranges:
            table[a : b + 1] = k
    return table


def joined(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' code points, each text followed by a line break, and where each begins."""
    body = "\n".join(t or "" for t in texts) + "\n"
    starts = np.cumsum([0, *(len(t or "") + 1 for t in texts)])
    return np.frombuffer(body.encode("utf-32-le"), np.uint32), starts


def runs(kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of true values."""
    edge = np.diff(np.concatenate([[0], kind.view(np.int8) if kind.dtype == bool else kind, [0]]).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
