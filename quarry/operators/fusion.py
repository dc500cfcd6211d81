"""Ranked lists into one: reciprocal-rank fusion and hybrid search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.operators import dense, sparse
from quarry.operators.topk import few

#: Characters of a text that tell it from others.
KEY = 200


def reciprocal_rank(lists: DataFrame, k: int = 60, weights: Sequence[float] | None = None, key_chars: int = KEY) -> DataFrame:
    """(qid, rank, id, score, text) of rows (qid, list_no from 0, rank from 1, id, score, text).

    Texts with an equal beginning are one result: its score sums weight / (k + rank), and it shows the row of highest
    own score, the first of them at a tie. Lists beyond the weights are left out. Order: score, then first arrival.
    """
    if weights is None:
        weight = F.lit(1.0)
    else:
        lists = lists.where(F.col("list_no") < len(weights))
        weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.col("list_no").cast("int") + 1)
    arrival = F.struct("list_no", "rank", "id")
    keyed = lists.select("qid", F.left("text", F.lit(key_chars)).alias("key"), arrival.alias("arrival"), (weight / (k + F.col("rank"))).alias("part"), "id", "score", "text")
    # highest score first, then earliest arrival: the least of (-score, arrival)
    shown = F.min_by(F.struct("id", "text"), F.struct((-F.col("score")).alias("s"), "arrival"))
    fused = keyed.groupBy("qid", "key").agg(F.sum("part").alias("score"), F.min("arrival").alias("arrival"), shown.alias("shown"))
    fused = fused.withColumn("score", F.round("score", 9))
    order = W.partitionBy("qid").orderBy(F.desc("score"), "arrival")
    return fused.select("qid", F.row_number().over(order).alias("rank"), F.col("shown.id").alias("id"), "score", F.col("shown.text").alias("text"))


def hybrid(docs: DataFrame, index: sparse.SparseIndex, queries: DataFrame, k: int = 5, alpha: float = 0.5, rrf_k: int = 60, fetch: int | None = None, id_col: str = "doc_id", text_col: str = "text", qid_col: str = "qid", query_col: str = "query", vector_col: str = "embedding", query_vector_col: str = "embedding") -> DataFrame:
    """(qid, rank, id, score, text): dense and sparse hits fused with weights alpha and 1 - alpha."""
    deep = fetch or max(3 * k, 20)
    near = dense.search(docs, queries, deep, id_col=id_col, vector_col=vector_col, qid_col=qid_col, query_col=query_vector_col)
    words = sparse.search(index, queries, deep, qid_col=qid_col, query_col=query_col)
    lists = near.withColumn("list_no", F.lit(0)).unionByName(words.withColumn("list_no", F.lit(1)))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # deep rows a query and list go to the texts
    fused = reciprocal_rank(texts.join(few(lists, 2 * deep * queries.count()), "id"), rrf_k, (alpha, 1 - alpha))
    return fused.where(F.col("rank") <= k)
