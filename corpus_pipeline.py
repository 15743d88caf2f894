"""A training corpus in five stages: toxicity, near copies, benchmark leaks, secrets, token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simgraph.llm import bpe, decontam, jaccard, secrets, toxicity
from simgraph.session import materialize, release


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores below 0.5, all columns as they are.

    Every row is judged by its whole text alone, however long: null ids and repeated rows stay or go as their texts do; a null or
    empty text gets the machine's bias. Of labels, null ids and null labels are skipped. An empty table gives an empty one.
    """
    machine = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, machine)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies, all columns as they are: that of least id, and one of rows that repeat it.

    Rows are judged, not ids, so rows of one id with unlike texts are judged apart. Rows without id or without words
    stay. Texts of any length are compared whole. An empty table gives an empty one.
    """
    return jaccard.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark, all columns as they are.

    Items of fewer than three words are no passage. Every row is judged by its whole text, however long; null ids and
    repeated rows stay or go as their texts do, null and empty texts stay. An empty table, of documents or of items,
    takes nothing away.
    """
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), min_words=3)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with its secrets blotted out and ``n_chars``, where there is one, counted anew.

    Null ids, repeated rows and other columns stay; a null text stays null, with null ``n_chars``; texts of any length are
    read whole; an empty table gives an empty one.
    """
    clean = secrets.redact(docs, secrets.train(docs))
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with their number and digest.

    One row a row of ``docs``: null ids stay, repeated rows repeat, a null or empty text has no tokens, texts of any length are
    encoded whole as a stream, and an empty table gives an empty one.
    """
    ids = bpe.encode(docs)
    return ids.select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        "ids",
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("benchmark_leaks", drop_leaks),
    ("secrets", redact_secrets),
    ("token_ids", encode),
]

#: Trained models and alignment have no SQL; tests compare each stage with a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each is written as Parquet and read again as the next one's input."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
        release(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
