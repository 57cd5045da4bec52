"""Training-text pipeline over ``documents``: stages that each apply one operator of ``haloflux.llm``.

Every stage reads all rows its predecessor kept and takes effect: low quality goes, one document of each
near-duplicate group stays, documents that hold benchmark items go, personal data is replaced, and
the rest is packed.  All but the last return the columns they were given.  Null and empty texts
pass by the rules of the operators; repeated rows and rows with a null doc_id are near duplicates and
contaminated like others, and extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haloflux.llm import decontam, neardup, packing, pii, quality, queries
from haloflux.llm.scratch import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Jaccard similarity, in percent, from which documents are near duplicates.
SIMILAR = 80


def unused(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have."""
    while name in docs.columns:
        name += "_"
    return name


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier, fitted on the labelled ones among them, doesn't reject."""
    model = quality.fit(docs, queries.table(spark, sf_dir, "labels"), held_out_fold=None)
    score = unused(docs, "_quality")
    return quality.scored(docs, model, score).where(F.col(score) >= quality.KEEP).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that with the smallest id, rows without one last.

    Rows are told apart by a number of their own, written with them, so that repeated rows and rows without
    an id take part like others.
    """
    row = unused(docs, "_row")
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()))
    found = neardup.near_duplicates(numbered, id_col=row, percent=SIMILAR).select(F.col("doc_id").alias(row), "component_id")
    first = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(row).alias("row"))
    kept = numbered.select(row, "doc_id").join(found, row).groupBy("component_id").agg(F.min(first).alias("first"))
    return numbered.join(kept.select(F.col("first.row").alias(row)), row, "left_semi").select(*docs.columns)


def clean_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item; those without an id are named by a hash of their text."""
    key = unused(docs, "_key")
    named = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")))
    gone = decontam.contaminated(named, queries.table(spark, sf_dir, "benchmark"), id_col=key)
    return named.join(gone.select(F.col("doc_id").alias(key)).distinct(), key, "left_anti").select(*docs.columns)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by the name of its kind."""
    return pii.redacted(docs, pii.fit(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens."""
    return packing.packed(docs, queries.tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each),
    ("decontamination", clean_of_benchmarks),
    ("personal_data", redacted),
    ("packing", packed),
]

#: SQL can't express the learned stages and the tokenizer; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs
