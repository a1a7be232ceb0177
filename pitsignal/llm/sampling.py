"""A bounded sample of labelled documents, for fitting a classifier on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, where: Column | None = None) -> DataFrame:
    """``doc_id``, ``text`` and ``y`` (0 or 1) of at most ``per_class`` documents of each class.

    The ids with the smallest hash are taken, so the choice does not depend on the partitioning. The
    table of chosen ids has at most ``2 * per_class`` rows, which is what bounds its broadcast. Of the texts
    of one id, the one with the least hash is used; an id with both labels counts in both classes. Labels other than 0 and 1,
    null ids, and ids without a document are left out.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    if where is not None:
        known = known.filter(where)
    known = known.select(F.col("doc_id").cast("bigint"), F.col(label).cast("int").alias("y")).distinct()
    chosen = None
    for y in (0, 1):
        some = known.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = some if chosen is None else chosen.unionByName(some)
    least = F.min_by("text", F.struct(F.xxhash64("text").alias("mark"), "text"))
    return docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(least.alias("text")).select("doc_id", "text", "y")


def class_shares(labels: DataFrame, label: str, where: Column | None = None) -> tuple[float, float]:
    """The share of label 0 and of label 1 among all labelled rows (of those that ``where`` admits)."""
    known = labels.filter(F.col(label).isin(0, 1))
    if where is not None:
        known = known.filter(where)
    counts = {int(r[label]): r["count"] for r in known.groupBy(label).count().collect()}
    total = sum(counts.values()) or 1
    return counts.get(0, 0) / total, counts.get(1, 0) / total
