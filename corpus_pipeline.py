"""From raw documents to packed sequences, as stages over the whole table.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a
frame.  ``run`` writes the result of each stage to the shared folder as Parquet and reads it
again as the documents of the next one, so a lost executor costs at most one stage.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import public_tokenizers  # noqa: E402
from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from segue.llm import neardup, packing, pii, quality, substring  # noqa: E402
from segue.session import broadcast_if_small, materialise  # noqa: E402


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects.

    A null text has no words and goes.  Rows are judged whole beside their text, so no column
    of theirs can be taken for a measure.
    """
    rows = docs.select(F.struct(*docs.columns).alias("document"), "text")
    return quality.quality_cascade(rows).filter("kept").select("document.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones: the one of the smallest id.

    Rows without an id stay.  Rows that share an id share its fate; of those that also have
    the same text, one stays.
    """
    groups = neardup.near_duplicates(docs).filter("doc_id <> component_id").select("doc_id").distinct()
    gone = broadcast_if_small(materialise(groups), neardup.BROADCAST_IDS)
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    repeated = materialise(docs.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").select("doc_id"))
    if repeated.isEmpty():
        return kept
    repeated = broadcast_if_small(repeated, neardup.BROADCAST_IDS)
    once = kept.join(repeated, "doc_id", "left_anti").select(*docs.columns)
    again = kept.join(repeated, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"])
    return once.unionByName(again)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages told by an earlier document are cut out."""
    return substring.cut(docs, substring.repeats(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return pii.redact(docs, pii.train(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences with their ids."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", substring_dedup),
    ("PII", personal_data),
    ("packing", packed),
]

#: Linked groups, fuzzy passages and trained trees are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs
