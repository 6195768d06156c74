"""The corpus pipeline: quality, language, near copies, contamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
keep the columns of documents. A stage's result is written as Parquet and read
again as the next one's docs. Extra columns go through all stages but the last,
whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from reelframe.llm import decontam, langid, ngram_join, packing, quality
from reelframe.llm.common import shared_dir, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5 go. Null text is empty text, a null doc_id is judged by its text, and rows that
    repeat are judged each. Without labels of both classes all stay; an empty table stays empty."""
    return quality.keep_quality(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, null texts, and those whose language margin is narrow, go. A null doc_id is judged
    by its text and rows that repeat are judged each; where no language is known all go; an empty table stays empty."""
    return langid.keep_known(docs, langid.fit_languages(docs))


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one of least doc_id. Rows that repeat stay once; texts
    without words, null ones too, are copies of nothing but of equal texts of their id; rows of a null doc_id stay; each
    text of an id is judged by itself; an empty table stays empty."""
    return ngram_join.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go. Null and empty texts have no words and stay, a null doc_id is judged by its text, rows
    that repeat are judged each; items without id or words find nothing; an empty table stays empty."""
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences. Null text is one piece, the end id; a null doc_id stays null; rows that
    repeat are packed each; an empty table has no pieces."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_stage),
    ("language_id", language_stage),
    ("ngram_jaccard_join", near_copy_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents. Each but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        out.write.parquet(f"{base}/{i}-{name}")
        docs = spark.read.schema(out.schema).parquet(f"{base}/{i}-{name}")


#: The learned stages have no SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None
