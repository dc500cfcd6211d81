"""Reranking hits (qid, query, id, text, score) by a pair score."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.text import blank_set, overlap, ratio


def lexical(query: Column, text: Column) -> Column:
    """Part of the query's distinct words that the text has."""
    return ratio(overlap(blank_set(query), blank_set(text)), F.size(blank_set(query)))


def model(load: Callable[[], Callable[[list[str], list[str]], np.ndarray]]) -> Callable[[Column, Column], Column]:
    """A scorer of any model, loaded once in each Python worker: one logit a pair, or two of which the second counts."""

    def scorer(query: Column, text: Column) -> Column:
        def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            score = load()
            for queries, texts in batches:
                out = np.asarray(score(queries.to_pylist(), texts.to_pylist()), float).reshape(len(queries), -1)
                yield pa.array(out[:, min(1, out.shape[1] - 1)])

        run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
        return F.arrow_udf(run, "double")(query, text)

    return scorer


def rerank(hits: DataFrame, k: int | None = None, scorer: Callable[[Column, Column], Column] = lexical, digits: int = 6) -> DataFrame:
    """hits in order of the pair score, the score before as original_score; ties keep the order they came in."""
    scored = hits.withColumn("original_score", F.col("score")).withColumn("score", F.round(scorer(F.col("query"), F.col("text")), digits))
    before = [F.asc("rank")] if "rank" in hits.columns else [F.desc("original_score")]
    ranked = scored.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), *before, F.asc("id"))))
    return ranked if k is None else ranked.where(F.col("rank") <= k)
