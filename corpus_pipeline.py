"""The corpus pipeline: quality rules, near duplicates, personal data, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read as the next
one's docs; all but the last return the columns of documents. Nulls, empty texts, repeated rows and empty tables
pass through every stage as its operator defines them; rows that share an id, null too, share its verdict, and stay if
one of them does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import byte_bpe, jaccard, mixing, pii, quality, queries
from quarry.llm.common import discard, documents, materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the robust distances reject go."""
    kept = quality.judge(docs).where("kept").select(F.col("doc_id").alias("kept_id"))
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["kept_id"]), "left_semi").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one of smallest doc_id stays."""
    found = jaccard.link(docs).where(F.col("component_id").eqNullSafe(F.col("doc_id"))).select(F.col("doc_id").alias("kept_id"))
    return docs.join(found, docs["doc_id"].eqNullSafe(found["kept_id"]), "left_semi").select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data becomes the name of its kind in brackets; n_chars follows."""
    clean = pii.redact(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    times = mixing.mix(queries.weighed(docs, sf_dir)).where("times > 0").groupBy("id").agg(F.max("times").cast("int").alias("times"))
    joined = docs.join(times, docs["doc_id"].eqNullSafe(times["id"]))
    return joined.select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("times"))).alias("_copy")).select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text and back: one row of digests a document."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return queries.digests(byte_bpe.decode(byte_bpe.encode(docs, path, public_tokenizers.PATTERN, packed=True), path))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram jaccard join", near_duplicates),
    ("pii", personal_data),
    ("source mixing", source_mixing),
    ("byte-level bpe", encoding),
]

#: The robust distances, the random field and the merges have no SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written and read again."""
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
