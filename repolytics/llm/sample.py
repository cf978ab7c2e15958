"""A bounded sample of labelled rows, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most about this many labelled rows are learned from; with fewer, all are.
SAMPLE_ROWS = 20_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, *, doc_id: str = "doc_id", text: str = "text", rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id, text, label`` of labelled documents that ``learn`` lets in, about ``rows`` at most.

    The share that is drawn falls with the number of labels and a row is drawn by
    the hash of its id, so the ids of the sample are few enough to hand to every
    task, and no text is shuffled.  An id with several labels has the largest.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).filter(learn).groupBy(doc_id).agg(F.max(label).cast("int").alias("label"))
    count = known.count()
    share = min(1.0, rows / max(1, count))
    drawn = known.filter((F.xxhash64(F.col(doc_id), F.lit("sample")).bitwiseAND((1 << 52) - 1)) < int(share * (1 << 52)))
    return docs.select(doc_id, F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(drawn), doc_id)
