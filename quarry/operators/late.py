"""Late interaction: each query token meets its nearest token of a document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.dense import CELLS, in_blocks, matrix
from quarry.operators.sparse import best


def scores(tokens: DataFrame, query_tokens: DataFrame, id_col: str = "id", digits: int = 6) -> DataFrame:
    """(qid, id, score): the sum over query tokens (qid, qpos, qvec) of the largest product with tokens (id, vec).

    The query tokens are a stated set that meets the tokens block by block, as in dense search: of each two blocks the
    largest product of each query token and document goes on.
    """
    asked = query_tokens.select("qid", "qpos", F.col("qvec").cast("array<double>").alias("v"))
    shape = asked.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first()

    def meet(given: pa.RecordBatch, held: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        asked_for, v = matrix(given.column("v")), matrix(held.column("v"))
        names = held.column("id").dictionary_encode()
        codes = names.indices.to_numpy()
        order = np.argsort(codes, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(codes[order]) > 0])
        ids = names.dictionary.take(pa.array(codes[order][starts]))
        each = max(1, CELLS // len(v))
        for a in range(0, len(asked_for), each):
            top = np.maximum.reduceat((asked_for[a : a + each] @ v.T)[:, order], starts, axis=1)
            rows, cols = np.divmod(np.arange(top.size), top.shape[1])
            at = pa.array(rows + a)
            yield pa.record_batch([given.column("qid").take(at), given.column("qpos").take(at), ids.take(pa.array(cols)), pa.array(top.reshape(-1))], ["qid", "qpos", "id", "top"])

    kinds = [asked.schema["qid"].dataType.simpleString(), asked.schema["qpos"].dataType.simpleString(), tokens.schema[id_col].dataType.simpleString()]
    stored = tokens.select(F.col(id_col).alias("id"), F.col("vec").cast("array<double>").alias("v"))
    partial = in_blocks(stored, asked, shape["n"] * (shape["d"] or 1) * 8, f"qid {kinds[0]}, qpos {kinds[1]}, id {kinds[2]}, top double", meet)
    nearest = partial.groupBy("qid", "qpos", "id").agg(F.max("top").alias("top"))
    return nearest.groupBy("qid", "id").agg(F.round(F.sum("top"), digits).alias("score"))


def search(tokens: DataFrame, query_tokens: DataFrame, k: int = 5, id_col: str = "id") -> DataFrame:
    """(qid, rank, id, score)."""
    return best(scores(tokens, query_tokens, id_col), k)
