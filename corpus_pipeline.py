"""Corpus cleaning and encoding as five stages, each written as Parquet and read again as the next one's documents.

Documents judged toxic go; of each group of near-duplicates the one with the smallest id stays; documents that hold a
benchmark window go; secrets are replaced by a mark; what is left is encoded. A null text passes every stage as an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.llm.common import ship, table, written
from latticework.llm.decontamination import without_contaminated
from latticework.llm.near_duplicates import near_duplicates
from latticework.llm.pieces import PieceModel, encode
from latticework.llm.queries import tokenizer_path
from latticework.llm.secrets import redacted, secret_spans
from latticework.llm.toxicity import fit, in_training, without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under the threshold; the model learns from this stage's documents."""
    return without_toxic(docs, fit(docs, table(spark, sf_dir, "labels"), in_training))


def minhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, once; rows without an id stay.

    Repeated rows (equal id and text) stay once. Different texts of one id are one document to the operator, whose links are
    those of all of them: they stay together, or go together.
    """
    ship(spark)
    kept = near_duplicates(docs).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("kept_id")).distinct()
    one = docs.join(kept, docs["doc_id"] == kept["kept_id"], "left_semi").dropDuplicates(["doc_id", "text"])
    return one.unionByName(docs.where("doc_id IS NULL")).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of every secret, and n_chars of the texts that this changed."""
    spans = secret_spans(docs, keep=docs.columns)
    clean = spans.withColumn("clean", redacted(F.col("spans"), F.col("scanned")))
    hit = F.size("spans") > 0
    text = F.when(hit, F.col("clean")).otherwise(F.col("text")).alias("text")
    n_chars = F.when(hit, F.length("clean").cast("long")).otherwise(F.col("n_chars")).alias("n_chars")
    return clean.select(*({"text": text, "n_chars": n_chars}.get(c, F.col(c)) for c in docs.columns))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids and round_trip (whether the ids decode to the text) of every document."""
    ship(spark)
    encoded = encode(docs, PieceModel(tokenizer_path("piece_bpe_32k.model")))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "round_trip")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [("toxicity", toxicity), ("minhash", minhash), ("decontamination", decontamination), ("secrets", secrets), ("sentencepiece", sentencepiece)]
#: SQL cannot express the stages; tests compare each with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
