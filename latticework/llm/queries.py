"""The queries of the operators over their whole tables, with production parameters, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.llm import oracles
from latticework.llm.common import table

TOKEN_LIMIT = 512


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from latticework.llm.token_counts import token_counts

    counts = token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from latticework.llm.language_model import in_training, scores

    return scores(table(spark, sf_dir, "documents"), in_training)


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from latticework.llm.pii import digests, personal_spans

    return digests(personal_spans(table(spark, sf_dir, "documents")))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from latticework.llm.chat import chain, digests, formatted

    planted = spark.sql("SELECT -7L AS conv_id, posexplode(array('user', 'assistant')) AS (turn, role)").select("conv_id", F.col("turn").cast("long"), "role", F.lit("</s>[INST] ok [/INST]").alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    return digests(formatted(chain(rows)))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from latticework.llm.toxicity import THRESHOLD, fit, in_training, toxic_passages

    docs = table(spark, sf_dir, "documents")
    scored = toxic_passages(docs, fit(docs, table(spark, sf_dir, "labels"), in_training))
    return scored.select("doc_id", (~in_training(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("segments").cast("long").alias("n_passages"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from latticework.llm.near_duplicates import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from latticework.llm.embedding_duplicates import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from latticework.llm.pieces import PieceModel, piece_digests

    return piece_digests(table(spark, sf_dir, "documents"), PieceModel(tokenizer_path("piece_bpe_32k.model")))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from latticework.llm.secrets import digests, secret_spans

    return digests(secret_spans(table(spark, sf_dir, "documents")))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from latticework.llm.decontamination import contamination, digests

    return digests(contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_language_model": op2_language_model,
    "op3_personal_data": op3_personal_data,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_toxicity": op5_toxicity,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_embedding_duplicates": op7_embedding_duplicates,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_secrets": op9_secrets,
    "op10_decontamination": op10_decontamination,
}
#: Only what SQL expresses at a bearable cost; the others are tested against brute force.
ORACLES: dict[str, str] = {
    "op4_chat_formatting": oracles.CHAT,
    "op6_near_duplicates": oracles.NEAR_DUPLICATES,
    "op7_embedding_duplicates": oracles.EMBEDDINGS,
    "op10_decontamination": oracles.DECONTAMINATION,
}
