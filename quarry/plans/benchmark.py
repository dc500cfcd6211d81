"""A benchmark of a plan over an evaluation set: ranking, answers and latency, written as JSON lines."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import metrics
from quarry.sources import records


def run(items: DataFrame, plan: Callable[[DataFrame], DataFrame], ks: Sequence[int] = (1, 3, 5, 10), timed: int = 0, out: str | None = None) -> DataFrame:
    """(metric, value) of items (question, answer, relevant_docs); plan: (qid, question) to answers with contexts and sources.

    All questions are answered as one table, for ranking (sources against relevant_docs) and answers (where items have
    one). Besides, the first timed questions are asked alone, one after the other, for latency. out: a folder for the rows.
    """
    spark = items.sparkSession
    asked = items.where("question is not null").dropDuplicates(["question"]).withColumn("qid", F.xxhash64("question"))
    answers = plan(asked.select("qid", "question")).select("qid", F.col("answer").alias("said"), "contexts", "sources")
    answers.persist()
    try:
        ranking = answers.select("qid", F.posexplode("sources").alias("rank", "id")).withColumn("rank", F.col("rank") + 1)
        relevant = asked.select("qid", F.explode("relevant_docs").alias("id"))
        found = [(f"{m}@{r['k']}", r[m]) for r in metrics.retrieval(asked.select("qid"), ranking, relevant, ks).orderBy("k").collect() for m in ("recall", "ndcg")]
        found.append(("mrr", metrics.mrr(asked.select("qid"), ranking, relevant).first()["mrr"]))
        pairs = asked.join(answers, "qid")
        made = {"f1": metrics.token_f1(F.col("said"), F.col("answer")), "exact_match": metrics.exact_match(F.col("said"), F.col("answer"))}
        made = {m: F.when(F.col("answer").isNotNull(), c) for m, c in made.items()}
        made |= {"faithfulness": metrics.faithfulness(F.col("said"), F.col("contexts")), "relevance": metrics.relevance(F.col("question"), F.col("said"))}
        row = pairs.agg(*(F.avg(c).alias(m) for m, c in made.items())).first()
        found += [(m, row[m]) for m in made]
    finally:
        answers.unpersist()
    took = []
    for q in asked.select("qid", "question").orderBy("question").limit(timed).collect():
        began = time.perf_counter()
        plan(spark.createDataFrame([q], "qid bigint, question string")).collect()
        took.append((time.perf_counter() - began,))
    if took:
        row = metrics.latency(spark.createDataFrame(took, "seconds double")).first()
        found += [(m, float(row[m])) for m in ("avg_latency", "p95_latency", "total_time", "queries_per_second")]
    result = spark.createDataFrame([(m, None if v is None else float(v)) for m, v in found], "metric string, value double")
    if out:
        records.write(result, out, 1)
    return result
