"""The queries of this folder and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, hash_forest, jaccard, lm_scores, mixing, pii, quality, sharding, sql, suffix_dedup, url_filter
from .common import documents, word_count

#: Bytes of text a shard may hold.
SHARD_BYTES = 4 << 20
#: Rules of the URL filter, by host/path prefix.
URL_RULES = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
#: Hosts that the URL filter lists: these names under each domain, bare and with each first label.
BAD_NAMES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
BAD_HOSTS = tuple(f"{first}{name}.example.{end}" for name in BAD_NAMES for first in ("", "www.", "m.", "blog.") for end in ("com", "net", "org"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance2")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(documents(spark, sf_dir))


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm_scores.score(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", F.round("score", 4).alias("score"), F.round("mean_score", 6).alias("mean_score"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    listed = spark.createDataFrame([(h,) for h in BAD_HOSTS], "host string")
    return url_filter.judge(pages, URL_RULES, listed).select("page_id", "host", "path", "rule", "verdict")


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(documents(spark, sf_dir))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = byte_bpe.encode(documents(spark, sf_dir), path, public_tokenizers.PATTERN, packed=True)
    return digests(byte_bpe.decode(ids, path))


def digests(decoded: DataFrame) -> DataFrame:
    return decoded.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def quality_weight() -> F.Column:
    """Documents labelled good weigh more than those without a label, these more than those labelled bad."""
    return F.when(F.col("quality") == 1, 2.0).when(F.col("quality") == 0, 0.5).otherwise(1.0)


def weighed(docs: DataFrame, sf_dir: str) -> DataFrame:
    """(id, source, size, weight) of docs."""
    labels = docs.sparkSession.read.parquet(f"{sf_dir}/labels.parquet").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return sized.join(labels, "doc_id", "left").select(F.col("doc_id").alias("id"), "source", "size", quality_weight().alias("weight"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(weighed(documents(spark, sf_dir), sf_dir))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op8_hash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return hash_forest.search(rows, rows.where("vec_id % 100 = 0"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(documents(spark, sf_dir))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", F.octet_length("text").alias("n_bytes"), "text")
    placed = sharding.assign_shards(docs, SHARD_BYTES)
    return placed.select("doc_id", F.coalesce("n_bytes", F.lit(0)).cast("long").alias("n_bytes"), "shard", F.length("shard").cast("long").alias("depth"), "shard_bytes", "fits")


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_suffix_dedup, op3_lm_scores, op4_url_filter, op5_personal_data, op6_byte_bpe, op7_source_mixing, op8_hash_forest, op9_jaccard_join, op10_sharding)}

SQL = {
    "op3_lm_scores": sql.lm_sql(),
    "op4_url_filter": sql.url_sql(URL_RULES, BAD_HOSTS),
    "op7_source_mixing": sql.mixing_sql(),
    "op9_jaccard_join": sql.jaccard_sql(),
    "op10_sharding": sql.sharding_sql(SHARD_BYTES),
}
