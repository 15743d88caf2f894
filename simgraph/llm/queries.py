"""The thin queries ``opN_*``: each applies one operator to its whole table and derives the agreed columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, jaccard, lattice, lm, oracles, phrases, quotes, secrets, toxicity, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {"op2_jaccard": oracles.OP2, "op7_phrases": oracles.OP7, "op9_lattice": oracles.OP9}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    ids = bpe.encode(table(spark, sf_dir, "documents"))
    ids = ids.select("id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"))
    out = bpe.decode(ids, keep=("n_tokens", "ids_sha256"))
    return out.select(F.col("id").alias("doc_id"), "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def _digest(findings) -> F.Column:
    one = F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string")))
    return F.concat_ws(",", one)


@query
def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document."""
    docs = table(spark, sf_dir, "documents")
    found = secrets.scan(docs, secrets.train(docs))
    count = lambda kind: F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long")
    base = F.filter("findings", lambda f: f["kind"] != "model")
    return found.select(
        F.col("id").alias("doc_id"),
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(_digest(base), 256).alias("base_sha256"),
        _digest(F.col("findings")).alias("spans"),
    )


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by a machine that never saw the held-out fold's labels."""
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.select(F.col("id").alias("doc_id"), toxicity.held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


#: The rules of the agreed query.
URL_RULES = [urls.Rule.parse(*r) for r in (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))]


@query
def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the URL of every page."""
    out = urls.judge(table(spark, sf_dir, "pages"), URL_RULES)
    return out.withColumnRenamed("id", "page_id")


@query
def op7_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document keeps once repeated runs of 13 words are gone."""
    out = phrases.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document at five words and similarity 0.8."""
    out = jaccard.similar_groups(table(spark, sf_dir, "documents"))
    return out.withColumnRenamed("id", "doc_id")


@query
def op9_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector at cosine 0.9."""
    out = lattice.similar_vectors(table(spark, sf_dir, "embeddings"))
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


@query
def op8_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the alignment's score and place."""
    out = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.withColumnRenamed("id", "doc_id")


@query
def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss of every document under a model of good documents less that under a model of all."""
    docs = lm.marked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return lm.differences(docs).withColumnRenamed("id", "doc_id")


@query
def op6_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message without quotes, with what it answers and its place in the thread."""
    return quotes.formatted(quotes.link(table(spark, sf_dir, "conversations")))
