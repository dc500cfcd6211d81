"""Exact nearest vectors of a set of queries, in blocks.

A stated set of at most QUERY_BYTES of queries travels to the executors, and every batch of rows meets it there. A larger
set meets the rows on a grid of both: a cell has some ROW_BYTES of rows and as many queries, so that no task has more than
their product to do, however large the tables are. It holds its rows while its queries pass by. A block of queries meets a
block of rows in one matrix product, and of that each query's k best stay. Nothing is paired by a cross join.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.vectors import unit
from quarry.operators.sparse import best

#: Bytes of query vectors that are broadcast, at most.
QUERY_BYTES = 8 << 20
#: Bytes of vectors on a side of a cell of the grid.
ROW_BYTES = 16 << 20
#: Products that are held at once, and rows that meet them in single precision.
CELLS, WIDE = 1 << 20, 1 << 12
#: Pairs that are handed on at once where all are.
PAIRS = 1 << 17
METRICS = ("cosine", "l2", "chunk_cosine")


def _check(metric: str) -> None:
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; one of {METRICS}")


def search(rows: DataFrame, queries: DataFrame, k: int | None = 5, metric: str = "cosine", id_col: str = "vec_id", vector_col: str = "embedding", qid_col: str = "qid", query_col: str = "embedding", digits: int = 6) -> DataFrame:
    """(qid, rank, id, score): cosine descending, or squared distance ascending; ties to the smaller id. Without k all pairs, unranked.

    Null vectors have no result; another length than the queries' raises. A zero vector has cosine 0 with all.
    """
    _check(metric)
    kind = lambda df, c: "array<float>" if df.select(c).schema[0].dataType.simpleString() == "array<float>" else "array<double>"
    asked = queries.select(F.col(qid_col).alias("qid"), F.col(query_col).cast(kind(queries, query_col)).alias("v")).where("v is not null")
    shape = asked.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d"), F.min(F.size("v")).alias("e")).first()
    if shape["n"] and shape["d"] != shape["e"]:
        raise ValueError("query vectors differ in length")
    size = shape["d"] or 1
    if metric == "chunk_cosine":
        asked = asked.where(F.exists("v", lambda x: x != 0))
    stored = rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast(kind(rows, vector_col)).alias("v")).where("v is not null")
    stored = stored.withColumn("v", F.when(F.size("v") == size, F.col("v")).otherwise(F.raise_error(F.lit(f"vectors must have {size} components")).cast(kind(rows, vector_col))))

    def meet(given: pa.RecordBatch, held: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        asked_for, v = matrix(given.column("v")), matrix(held.column("v"))
        ids, names = held.column("id"), given.column("qid")
        order = np.empty(len(v), np.int64)
        order[pc.sort_indices(ids).to_numpy()] = np.arange(len(v))
        for q, n, score in _nearest(asked_for, v, order, k, digits) if k is not None and metric == "cosine" else _compared(asked_for, v, order, k, metric, digits):
            yield pa.record_batch([names.take(pa.array(q)), ids.take(pa.array(n)), pa.array(score * (-1.0 if metric == "l2" else 1.0) + 0.0)], ["qid", "id", "score"])

    kinds = (asked.schema["qid"].dataType.simpleString(), stored.schema["id"].dataType.simpleString())
    found = in_blocks(stored, asked, shape["n"] * size * 8, f"qid {kinds[0]}, id {kinds[1]}, score double", meet)
    return found if k is None else best(found, k, None, descending=metric != "l2")


def matrix(vectors: pa.Array) -> np.ndarray:
    """Vectors of one length in double precision."""
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(vectors), -1)


def _values(asked_for: np.ndarray, v: np.ndarray, metric: str, digits: int) -> np.ndarray:
    """Scores of all pairs, the larger the nearer."""
    lengths = lambda m: np.sqrt(np.square(m).sum(1))
    if metric == "l2":
        value = -np.maximum(np.square(asked_for).sum(1)[:, None] + np.square(v).sum(1)[None] - 2 * asked_for @ v.T, 0)
    elif metric == "cosine":
        value = (asked_for / np.maximum(lengths(asked_for), 1e-12)[:, None]) @ (v / np.maximum(lengths(v), 1e-12)[:, None]).T
    else:
        value = (asked_for @ v.T) / (lengths(asked_for)[:, None] * lengths(v)[None] + 1e-10)
    return np.round(value, digits)


def _best(value: np.ndarray, order: np.ndarray | None, k: int | None) -> np.ndarray:
    """The k rows of largest value, ties by order; all without k."""
    near = np.arange(len(value))
    if k is None:
        return near
    if len(near) > k:
        near = np.flatnonzero(value >= np.partition(value, len(near) - k)[len(near) - k])
    return near[np.lexsort((order[near], -value[near]))[:k]]


Found = tuple[np.ndarray, np.ndarray, np.ndarray]


def _compared(asked_for: np.ndarray, v: np.ndarray, order: np.ndarray, k: int | None, metric: str, digits: int) -> Iterator[Found]:
    """(query, row, value) of each query's k best rows, or of all pairs, block by block."""
    wide, most = (len(v), CELLS) if k is not None else (min(len(v), PAIRS), PAIRS)
    each = max(1, most // max(wide, 1))
    for b in range(0, len(v), wide or 1):
        for a in range(0, len(asked_for), each):
            value = _values(asked_for[a : a + each], v[b : b + wide], metric, digits)
            if k is None:
                q, n = np.divmod(np.arange(value.size), value.shape[1])
            else:
                picked = [_best(row, order, k) for row in value]
                q, n = np.repeat(np.arange(len(picked)), [len(p) for p in picked]), np.concatenate(picked)
            yield q + a, n + b, value[q, n]


def _nearest(asked_for: np.ndarray, v: np.ndarray, order: np.ndarray, k: int, digits: int) -> Iterator[Found]:
    """As _compared, for cosines.

    Products in single precision pick the rows that reach a query's k best so far, less what such a product may err and
    rounding may lift; only those are computed in double precision, rounded and ranked. Where many reach it (equal vectors),
    the block is compared in full.
    """
    one, two = (m / np.maximum(np.sqrt(np.square(m).sum(1)), 1e-12)[:, None] for m in (asked_for, v))
    left, right = one.astype(np.float32), two.astype(np.float32)
    slack = np.float32((v.shape[1] + 8) * 1.2e-7 + 2 * 10.0**-digits)
    each = max(1, CELLS // max(1, min(WIDE, len(v))))
    for a in range(0, len(left), each):
        some = left[a : a + each]
        floor = np.full(len(some), -np.inf, np.float32)
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for b in range(0, len(right), WIDE):
            near = some @ right[b : b + WIDE].T
            if not b and near.shape[1] > k:
                floor = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k] - slack
            hit = near >= floor[:, None] - slack
            count = int(np.count_nonzero(hit))
            if not count:
                continue
            if count <= max(64 * len(some), near.size // 64):
                q, n = np.divmod(np.flatnonzero(hit), hit.shape[1])
                n += b
                value = np.round(np.einsum("ij,ij->i", one[a + q], two[n]), digits)
            else:
                full = [(q, n + b, x) for q, n, x in _compared(asked_for[a : a + each], v[b : b + WIDE], order[b : b + WIDE], k, "cosine", digits)]
                q, n, value = map(np.concatenate, zip(*full))
            q, n, value = map(np.concatenate, zip(held, (q, n, value)))
            at = np.lexsort((order[n], -value, q))
            q, n, value = q[at], n[at], value[at]
            first = np.searchsorted(q, np.arange(len(some)))
            stay = np.arange(len(q)) - first[q] < k
            q, n, value = held = q[stay], n[stay], value[stay]
            filled = np.bincount(q, minlength=len(some)) == k
            last = np.searchsorted(q, np.arange(len(some)), "right")[filled] - 1
            floor[filled] = np.maximum(floor[filled], value[last].astype(np.float32))
        yield held[0] + a, held[1], held[2]


def in_blocks(stored: DataFrame, asked: DataFrame, size: int, fields: str, meet: Callable[[pa.RecordBatch, pa.RecordBatch], Iterator[pa.RecordBatch]]) -> DataFrame:
    """What meet gives for all blocks of asked and of stored (id, v), each pair of rows being in one. size: bytes of asked."""
    spark, names = stored.sparkSession, asked.columns
    if size <= QUERY_BYTES:
        table = asked.toArrow().combine_chunks()
        given = table.to_batches()[0] if table.num_rows else None
        shared = spark.sparkContext.broadcast(given)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows and shared.value is not None:
                    yield from meet(shared.value, batch)

        return stored.mapInArrow(run, fields)
    total = stored.agg(F.coalesce(F.sum(F.size("v").cast("long") * 8), F.lit(0))).first()[0]
    parts, across = max(1, math.ceil(total / ROW_BYTES)), max(1, math.ceil(size / ROW_BYTES))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = stored.select("*", F.pmod(F.xxhash64("id", "v"), F.lit(parts)).alias("n"), each(across).alias("m"))
    right = asked.select("*", each(parts).alias("n"), F.pmod(F.xxhash64(*names), F.lit(across)).alias("m"))
    cell = (F.col("n") * across + F.col("m")).cast("int").alias("part")
    left = left.select(cell, F.lit(0).alias("side"), F.struct("id", "v").alias("held"))
    right = right.select(cell, F.lit(1).alias("side"), F.struct(*names).alias("given"))
    both = left.unionByName(right, allowMissingColumns=True).repartitionById(parts * across, F.col("part")).sortWithinPartitions("side")

    def pass_by(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], None
        for batch in batches:
            cut = int((batch.column(1).to_numpy() == 0).sum())
            if cut:
                rows.append(pa.RecordBatch.from_struct_array(batch.column(2).slice(0, cut)))
            if cut < batch.num_rows and rows:
                held = held or pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
                yield from meet(pa.RecordBatch.from_struct_array(batch.column(3).slice(cut)), held)

    return both.mapInArrow(pass_by, fields)


def add(rows: DataFrame, more: DataFrame, metric: str = "cosine", vector_col: str = "embedding") -> DataFrame:
    """rows and more under one schema, vectors of unit length for cosine."""
    _check(metric)
    fresh = more.withColumn(vector_col, unit(F.col(vector_col))) if metric == "cosine" else more.withColumn(vector_col, F.col(vector_col).cast("array<double>"))
    return rows.withColumn(vector_col, F.col(vector_col).cast("array<double>")).unionByName(fresh)


def remove(rows: DataFrame, ids: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """rows whose id is not in ids; unknown ids are ignored."""
    return rows.join(ids.select(id_col).distinct(), id_col, "left_anti")


def size(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("size"))


def pair_similarity(rows: DataFrame, others: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", digits: int = 6) -> DataFrame:
    """(a, b, sim): cosine of every row with each of a stated set of others, as they come: nothing is ranked."""
    found = search(rows, others, None, "cosine", id_col, vector_col, id_col, vector_col, digits)
    return found.select(F.col("id").alias("a"), F.col("qid").alias("b"), F.col("score").alias("sim"))
