"""Registered queries of the operators in this subpackage, each over its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haloflux.llm import audit, decontam, fingerprint, langid, lexicon, licenses, neardup, oracles, packing, pii, ppm, quality, repair, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The public byte-level vocabulary; ``TOKENIZER_PATH`` names another file."""
    named = os.environ.get("TOKENIZER_PATH")
    if named:
        return named
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def remainder(modulus: int):
    return F.crc32(F.col("doc_id").cast("string")) % modulus


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document and of its edited text, with their likeness and that of the next document."""
    pairs = fingerprint.edited_pairs(docs)
    own = F.col("sketch")
    return pairs.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint.as_text(own).alias("fingerprint"),
        fingerprint.as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        fingerprint.likeness(own, F.col("edited_sketch")).alias("near_edited"),
        fingerprint.likeness(own, F.col("next_sketch")).alias("near_next"),
    )


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files at source/language/thousand/doc_id; those without an id have a hash of their text in its place."""
    docs = table(spark, sf_dir, "documents")
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("_"), F.sha2(F.coalesce("text", F.lit("")), 256)))
    path = F.concat_ws("/", F.coalesce("source", F.lit("_")), F.coalesce("lang", F.lit("_")), F.coalesce(F.floor(F.col("doc_id") / 1000).cast("string"), F.lit("_")), name)
    found = licenses.scan(docs.select(path.alias("path"), "text"))
    return found.select(F.regexp_extract("path", "([^/]*)$", 1).try_cast("long").alias("doc_id"), "path", "licence", "origin", "cosine", "inherited_from")


def op3_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ppm.scored(table(spark, sf_dir, "documents"), remainder(5) != 1)
    return found.select("doc_id", (remainder(5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs.where(remainder(5) != 0), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    found = toxicity.scored(docs, model)
    predicted = (F.col("score") >= 0.5).cast("int").alias("predicted")
    return found.select("doc_id", (remainder(5) == 0).alias("held_out"), "score", predicted, "n_passages", "passages")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.predicted(docs, langid.learn(docs.where(remainder(4) != 2)))
    return found.select("doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score")


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.detections(docs, pii.fit(docs))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = quality.scored(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", (remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= quality.KEEP).cast("int").alias("predicted"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows damaged by the checksum of conv_id and turn: marked as gone, emptied, without endings, repeated, of role user."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    kind = F.crc32(key) % 20
    text = F.coalesce("text", blank)
    return conversations.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(F.coalesce("role", blank)).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (kind == 0).alias("gone"),
        F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    )


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repaired(damaged(table(spark, sf_dir, "conversations")))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.interactions(audit.failure_counts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = lexicon.encoded(docs, tokenizer_path(), lexicon.build(docs, tokenizer_path()), decode=True)
    ids = F.col("ids")
    return found.select(
        "doc_id",
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(ids.cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES: dict[str, Query] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_licenses": op2_licenses,
    "op3_ppm": op3_ppm,
    "op4_packing": op4_packing,
    "op5_toxicity": op5_toxicity,
    "op6_decontamination": op6_decontamination,
    "op7_language": op7_language,
    "op8_personal_data": op8_personal_data,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_quality": op10_quality,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_filter_audit": op12_filter_audit,
    "op13_bpe": op13_bpe,
}

#: DuckDB SQL for the queries that SQL can express.
ORACLES: dict[str, str] = {
    "op6_decontamination": oracles.DECONTAMINATION,
    "op9_near_duplicates": oracles.NEAR_DUPLICATES,
    "op11_conversation_repair": oracles.CONVERSATION_REPAIR,
    "op12_filter_audit": oracles.FILTER_AUDIT,
}
