"""JSON lines in and out: evaluation sets, relevance judgements, question batches, training pairs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVALUATION = "question string, answer string, relevant_docs array<string>"
JUDGEMENTS = "query string, relevant array<string>"
PAIRS = "query string, positive string, negative string"
DIALOGUES = "question string, context string, answer string"


def read(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON lines; blank lines are skipped."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path)


def write(df: DataFrame, path: str, files: int | None = None) -> None:
    (df if files is None else df.coalesce(files)).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def predict(spark: SparkSession, path: str, out: str, run: Callable[[DataFrame], DataFrame], question_key: str = "question") -> None:
    """Answers of the questions in path as lines of question, answer, num_sources, one for every line of path. run: (qid, question) to answers."""
    given = read(spark, path).select(F.col(question_key).alias("question"))
    # a repeated question is asked once and answered on each of its lines
    found = summary(run(given.select(F.xxhash64("question").alias("qid"), "question").dropDuplicates(["question"])))
    answers = found.withColumnRenamed("question", "asked")
    write(given.join(answers, given["question"].eqNullSafe(answers["asked"]), "left").select("question", "answer", "num_sources"), out)


def summary(answers: DataFrame) -> DataFrame:
    return answers.select("question", "answer", F.size("sources").alias("num_sources"))


def judgements(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(qid, query) and (qid, id) of lines of query and relevant; lines of one query are judged together."""
    rows = read(spark, path, JUDGEMENTS).where("query is not null").withColumn("qid", F.xxhash64("query"))
    return rows.select("qid", "query").distinct(), rows.select("qid", F.explode("relevant").alias("id")).distinct()


def pairs(spark: SparkSession, path: str) -> DataFrame:
    """(query, positive, negative) of lines for contrastive training; lines without a query or positive are left out."""
    return read(spark, path, PAIRS).where("query is not null and positive is not null")


def as_prompts(rows: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(columns in keep, prompt, completion) from (question, context, answer): data for fitting a generator."""
    return rows.select(*keep, F.concat_ws("\n\n", F.concat(F.lit("Context:\n"), "context"), F.concat(F.lit("Question: "), "question"), F.lit("Answer:")).alias("prompt"), F.col("answer").alias("completion"))
