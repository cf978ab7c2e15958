"""Token counts of whole texts with a public tokenizer.

Batches are cut by bytes, texts are split where no token can cross (before a
space or line break that follows another character than white space; a text
without white space is one piece), and equal
pieces of a batch are encoded once; only lengths come back.  A piece's count is
kept for later batches of the same worker, up to a fixed number of pieces.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BATCH_BYTES = 4 << 20
KEPT_PIECES = 400_000
#: White space before the piece and all up to the next space or line break.
_PIECES = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
#: Where that rule would cut inside a run of white space.
_INSIDE = re.compile(r"[^\S \n][ \n]|[\x1c-\x1f][ \n]")


def pieces(text: str) -> list[str]:
    """The text in pieces that are tokenized alone as they are in the text.

    A pre-token starts with white space or has none, so none crosses a cut.
    """
    found = _PIECES.findall(text)
    if len(found) > 1 and found[-1].isspace():
        found[-2:] = [found[-2] + found[-1]]
    if not _INSIDE.search(text):
        return found
    out: list[str] = []
    for p in found:
        if out and out[-1][-1].isspace():
            out[-1] += p
        else:
            out.append(p)
    return out


@cache
def _tokenizer(path: str):  # noqa: ANN202
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    settings = json.loads(found.to_str())
    steps = settings.get("pre_tokenizer") or {}
    if settings["model"]["type"] != "BPE" or steps.get("type") != "ByteLevel" or not steps.get("use_regex", True) or settings.get("normalizer"):
        raise ValueError(f"{path} isn't a byte-level BPE vocabulary: its texts can't be cut at white space")
    return found


@cache
def _known(path: str) -> dict[str, int]:
    return {}


def count_tokens(texts: list[str], path: str) -> list[int]:
    """Number of tokens of each text."""
    cut = [pieces(t) for t in texts]
    known = _known(path)
    new = list({p for ps in cut for p in ps if p not in known})
    if len(known) + len(new) > KEPT_PIECES:
        known.clear()
        new = list({p for ps in cut for p in ps})
    for i in range(0, len(new), 20_000):
        part = new[i : i + 20_000]
        known.update(zip(part, map(len, _tokenizer(path).encode_batch_fast(part, add_special_tokens=False)), strict=True))
    get = known.__getitem__
    return [sum(map(get, ps)) for ps in cut]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public vocabulary file lies; it is not part of this repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def token_count(text: Column, *, name: str = "byte_bpe_50k.json", path: str | None = None, batch_bytes: int = BATCH_BYTES) -> Column:
    """Tokens of ``text`` without begin, end or added tokens; null counts as empty.

    Without ``path`` each worker looks up ``name`` among its own installed files.
    """

    @F.arrow_udf("long")
    def counts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        file = path or tokenizer_path(name)
        for batch in batches:
            out: list[int] = []
            part: list[str] = []
            held = 0
            for t in batch:
                part.append(t.as_py() or "")
                held += t.as_buffer().size if t.is_valid else 0
                if held > batch_bytes:
                    out += count_tokens(part, file)
                    part, held = [], 0
            yield pa.array(out + count_tokens(part, file), pa.int64())

    return counts(text)


def token_report(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", limit: int = 1024, name: str = "byte_bpe_50k.json") -> DataFrame:
    """One row a document: bytes, tokens and whether they exceed ``limit``.

    Null texts count as empty: 0 of both; repeated rows are each counted; no rows
    give no rows.  Columns of other names aren't read.  A vocabulary that isn't a
    byte-level BPE is refused.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(doc_id, F.octet_length(body).cast("long").alias("n_bytes"), token_count(body, name=name).alias("n_tokens"))
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
