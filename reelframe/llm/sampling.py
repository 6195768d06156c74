"""Bounded samples of labelled rows, for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out


def known_labels(labels: DataFrame, label: str, modulus: int = 3, remainder: int = 1) -> DataFrame:
    """doc_id, y of the labels that may be learnt from: not null, not held out, the largest of a document's."""
    known = labels.where(f"doc_id is not null and `{label}` is not null").where(~held_out("doc_id", modulus, remainder))
    return known.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows_per_class: int, max_chars: int, modulus: int = 3, remainder: int = 1):
    """(texts, labels, prior): at most rows_per_class rows of each class that are not held out and whose
    text is not longer than max_chars, and the share of class 1 among all such labels.

    The ids are chosen by hash from the label table alone, so that the documents
    are read once and the join's small side has at most 2 * rows_per_class rows.
    A document with several labels counts by its largest, an id with several
    texts by the least, which Spark finds before anything reaches the driver.
    """
    known = known_labels(labels, label, modulus, remainder)
    total, ones = known.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not total:
        return [], [], 0.5
    picked = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows_per_class)
        picked = part if picked is None else picked.union(part)
    texts = docs.select("doc_id", "text").where(F.length("text") <= max_chars)
    got = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).toPandas()
    got = got.sort_values("doc_id")
    return got["text"].tolist(), got["y"].tolist(), ones / total
