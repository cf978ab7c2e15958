"""Fill-in-middle texts over seekable compressed frames.

A text is stored as zstandard frames that open on their own, each with the number
of units and code points up to its end.  A cut opens the one frame that it lies
in, found by those numbers; the output takes all other frames over as they are
compressed, and digests stream through frames in order.  So neither a text nor
its output is held twice.  Frames end where a unit does; a unit longer than
``FRAME_BYTES`` has a frame of its own.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import islice

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import StringType

FRAME_BYTES = 65_536
LEVEL = 1
#: The marks of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Shares, in percent, of texts that are cut, and of those that put the suffix first.
CUT_SHARE, SUFFIX_FIRST_SHARE = 50, 80

_FRAME_TYPE = pa.list_(pa.struct([("data", pa.binary()), ("units", pa.int64()), ("chars", pa.int64())]))
_OUTPUT_TYPE = pa.struct([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.list_(pa.binary()))])
FRAMES, OUTPUT, TEXT = from_arrow_type(_FRAME_TYPE), from_arrow_type(_OUTPUT_TYPE), StringType()

_UNIT = re.compile(rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
_WORD_END = re.compile(rb"(?<=[^\x20\x09-\x0D])[\x20\x09-\x0D]")
_SPACE = b" \t\n\x0b\x0c\r"
_MARK = re.compile(b"|".join((PREFIX, SUFFIX, MIDDLE)))


@cache
def _compressor() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=LEVEL)


@cache
def _decompressor() -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor()


def packed_frame(part: bytes) -> bytes:
    """One frame that holds ``part`` and says how long it is."""
    return _compressor().compress(part)


def opened(frame: bytes) -> bytes:
    """What a frame holds."""
    return _decompressor().decompress(frame)


def units_in(part: bytes) -> int:
    """Units of a text or of a frame: words with the white space before them, and white space at the end."""
    return len(part.split()) + (part[-1:] in _SPACE if part else 0)


def frames_of(text: bytes, size: int = FRAME_BYTES) -> list[dict]:
    """The text's frames, with the units and code points from its start to each frame's end."""
    found: list[dict] = []
    start = units = chars = 0
    while start < len(text):
        cut = _WORD_END.search(text, start + size) if start + size < len(text) else None
        part = text[start : cut.start() if cut else len(text)]
        units += units_in(part)
        chars += len(part.decode())
        found.append({"data": packed_frame(part), "units": units, "chars": chars})
        start += len(part)
    return found


def _split(frames: list[dict], unit: int) -> tuple[int, bytes, bytes, int]:
    """Where the first ``unit`` units end: whole frames before, that frame's two sides, and code points before."""
    at = bisect_left([f["units"] for f in frames], unit) if unit else 0
    if at == len(frames):
        return at, b"", b"", 0
    units, chars = (frames[at - 1]["units"], frames[at - 1]["chars"]) if at else (0, 0)
    part = opened(frames[at]["data"])
    end = next(islice(_UNIT.finditer(part), unit - units - 1, None)).end() if unit > units else 0
    return at, part[:end], part[end:], chars + len(part[:end].decode())


def fill(frames: list[dict], h: Iterable[int]) -> dict:
    """Form, counts and output frames of a stored text, by four numbers that its id gives."""
    h1, h2, h3, h4 = h
    n = frames[-1]["units"] if frames else 0
    plain = not frames or h3 % 100 >= CUT_SHARE or any(_MARK.search(opened(f["data"])) for f in frames)
    if plain:
        return {"n": n, "form": "plain", "prefix_chars": None, "middle_chars": None, "output": [f["data"] for f in frames]}
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    i, left, rest, before = _split(frames, a)
    j, inner, right, until = _split(frames, b)
    whole = [f["data"] for f in frames]
    sides = [left, inner[len(left) :] if i == j else inner, right]
    edge = [packed_frame(s) if s else None for s in sides]
    prefix = [*whole[:i], edge[0]]
    middle = [edge[1]] if i == j else [packed_frame(rest) if rest else None, *whole[i + 1 : j], edge[1]]
    suffix = [edge[2], *whole[j + 1 :]]
    p, s, m = map(packed_frame, (PREFIX, SUFFIX, MIDDLE))
    first = h4 % 100 < SUFFIX_FIRST_SHARE
    parts = [s, *suffix, p, *prefix, m, *middle] if first else [p, *prefix, s, *suffix, m, *middle]
    return {"n": n, "form": "spm" if first else "psm", "prefix_chars": before, "middle_chars": until - before, "output": [x for x in parts if x is not None]}


def sha256_of(parts: Iterable[bytes]) -> str:
    """Digest of the parts in order."""
    found = hashlib.sha256()
    for p in parts:
        found.update(p)
    return found.hexdigest()


def _found(frames: list[bytes], mark: bytes, start: int) -> int:
    """Position of the first ``mark`` from ``start`` on, over the texts of the frames together."""
    at, tail = 0, b""
    for f in frames:
        size = zstandard.frame_content_size(f)
        if at + size > start:
            part = opened(f)[max(0, start - at) :]
            hit = (tail + part).find(mark)
            if hit >= 0:
                return max(at, start) - len(tail) + hit
            tail = (tail + part)[1 - len(mark) :]
        at += size
    raise ValueError(f"no {mark.decode()} in the output")


def _between(frames: list[bytes], start: int, end: int | None) -> Iterator[bytes]:
    """The text between two positions, frame by frame; frames outside aren't opened."""
    at = 0
    for f in frames:
        size = zstandard.frame_content_size(f)
        if at + size > start and (end is None or at < end):
            yield opened(f)[max(0, start - at) : None if end is None else end - at]
        at += size


def rebuilt(output: list[bytes], form: str) -> Iterator[bytes]:
    """The text that was cut, from the output and its form alone, in parts."""
    if form == "plain":
        yield from _between(output, 0, None)
        return
    second = _found(output, PREFIX if form == "spm" else SUFFIX, 3)
    third = _found(output, MIDDLE, second + 3)
    ahead, behind = (3, second), (second + 3, third)
    prefix, suffix = (behind, ahead) if form == "spm" else (ahead, behind)
    for start, end in (prefix, (third + 3, None), suffix):
        yield from _between(output, start, end)


@F.arrow_udf(FRAMES)
def text_frames(text: pa.Array) -> pa.Array:
    """A text as frames; null and empty texts have none."""
    return pa.array([frames_of(t.as_buffer().to_pybytes()) if t.is_valid and len(t.as_buffer()) else [] for t in text], _FRAME_TYPE)


@F.arrow_udf(OUTPUT)
def filled(frames: pa.Array, h1: pa.Array, h2: pa.Array, h3: pa.Array, h4: pa.Array) -> pa.Array:
    """Form, counts and output frames of stored texts."""
    numbers = zip(*(h.to_pylist() for h in (h1, h2, h3, h4)), strict=True)
    return pa.array([fill(f.as_py(), h) for f, h in zip(frames, numbers, strict=True)], _OUTPUT_TYPE)


@F.arrow_udf(TEXT)
def frames_sha256(output: pa.Array) -> pa.Array:
    """Digest of the text that frames hold."""
    return pa.array([sha256_of(_between(o.as_py(), 0, None)) for o in output], pa.string())


@F.arrow_udf(TEXT)
def rebuilt_sha256(output: pa.Array, form: pa.Array) -> pa.Array:
    """Digest of the text rebuilt from an output and its form."""
    return pa.array([sha256_of(rebuilt(o.as_py(), f.as_py())) for o, f in zip(output, form, strict=True)], pa.string())


@F.arrow_udf(TEXT)
def frames_text(output: pa.Array) -> pa.Array:
    """The text that frames hold."""
    return pa.array([b"".join(_between(o.as_py(), 0, None)).decode() for o in output], pa.string())


def drawn(doc_id: Column, seed: int = 42) -> list[Column]:
    """Four numbers of an id: the first groups of eight digits of its seeded SHA-256."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", seed: int = 42) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` for each row; ``output`` holds frames (see :func:`frames_text`).

    ``n`` counts units.  Null and empty texts have none and are plain, with no
    frames; a text that holds a mark is plain.  Cuts follow from the id, so rows
    that share an id and a text have equal outputs; a null id draws as an empty
    one.  Repeated rows are each returned; no rows give no rows.  Columns of
    other names aren't read.
    """
    rows = docs.select(F.col(doc_id), filled(text_frames(F.col(text)), *drawn(F.col(doc_id), seed)).alias("filled"))
    return rows.select(doc_id, "filled.*")


def fim_report(docs: DataFrame) -> DataFrame:
    """Counts, form and digests of every document: of the output, and of the text rebuilt from it.

    Null texts count as empty, repeated rows are each counted, and no rows give no
    rows; see :func:`fill_in_middle`.
    """
    rows = fill_in_middle(docs)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", frames_sha256("output").alias("output_sha256"), rebuilt_sha256("output", "form").alias("restored_sha256"))


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
         sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
g AS (
  SELECT doc_id, text, units, len(units) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
  FROM d),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
              WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM g),
p AS (
  SELECT *, coalesce(array_to_string(units[1:a], ''), '') AS prefix, coalesce(array_to_string(units[a + 1:b], ''), '') AS middle,
         coalesce(array_to_string(units[b + 1:n], ''), '') AS suffix
  FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle
                        ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
