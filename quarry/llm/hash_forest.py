"""Approximate nearest neighbours by a hash-prefix forest.

Every vector gets one long hash string a tree: the signed axis that a random rotation of the vector (less its shard's
mean) lies closest to, of up to 128, then SIGNS signs of random projections. A tree is the sorted array of its strings,
so the rows that share a prefix with a query are a range. In all trees together a query takes the longest prefixes
whose ranges hold enough entries; they shorten from the longest match by one symbol at a time, in all trees at once.
The rows that most trees meet there are the candidates, ranked by exact distance.

Rows are split by a hash of their id into shards of bounded size, each with the whole forest of its rows; queries
visit every shard as a stream of blocks, and the shards' best are merged. Rotations come from a seed: nothing is
broadcast or collected. A query measures some k sqrt(N) / 2 distances in all, and ties, whatever the number of shards;
only tables of fewer rows than that are scanned as a whole.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part; vectors of each
length are searched among themselves; of rows that repeat an id the one of least vector counts; rows with a null id
are candidates, each its own, after others at a tie, and no queries; of equal vectors the k + 1 smallest ids of a shard
are kept, as no others can be among the nearest; ties go to the smaller id; fewer rows than k give all; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import exchange_partitions, trimmed

TREES = 96
#: Axes of the first symbol, which has twice as many values.
FIRST_AXES = 64
#: Symbols of a hash string after the first, each the sign of a projection.
SIGNS = 32
#: The trees ascend until their ranges hold this many entries a candidate.
REACH = 32
#: Rows of a shard: at most this many on average, which one task holds in memory.
SHARD_ROWS = 100_000
#: Below this many rows a shard isn't split further for the sake of parallel work.
LEAST_SHARD = 8_000
#: Queries that a shard answers at once.
BLOCK = 256


class Rotations:
    """Random axes of all trees, the same for a seed and a length of vectors."""

    def __init__(self, size: int, trees: int, seed: int):
        rng = np.random.default_rng([seed, size])
        axes = min(FIRST_AXES, size)
        self.trees, self.axes = trees, axes
        self.first = np.concatenate([np.linalg.qr(rng.normal(size=(size, axes)))[0] for _ in range(trees)], 1).astype(np.float32)
        self.signs = rng.normal(size=(size, trees * SIGNS)).astype(np.float32)
        # bits of a string that are below the prefix of each level: all of them at level 0, none at the last
        self.below = [SIGNS + (2 * axes - 1).bit_length(), *range(SIGNS, -1, -1)]

    def strings(self, centred: np.ndarray) -> np.ndarray:
        """(trees, rows): the symbols of each hash string as one number, first symbol highest."""
        out = np.empty((self.trees, len(centred)), np.int64)
        weights = np.left_shift(np.int64(1), np.arange(SIGNS - 1, -1, -1))
        for a in range(0, len(centred), 512):
            some = centred[a : a + 512].astype(np.float32)
            turned = (some @ self.first).reshape(-1, self.axes)
            axis = np.abs(turned).argmax(1)
            code = axis * 2 + (turned[np.arange(len(axis)), axis] > 0)
            signs = np.packbits(((some @ self.signs) > 0).reshape(-1, SIGNS), axis=1).view(">u4")[:, 0].astype(np.int64)
            out[:, a : a + 512] = (code << SIGNS | signs).reshape(len(some), self.trees).T
        return out


class Forest:
    """Sorted arrays of the hash strings of some vectors."""

    def __init__(self, vectors: np.ndarray, rotations: Rotations):
        self.vectors, self.rotations = vectors, rotations
        self.mean = vectors.mean(0)
        codes = rotations.strings(vectors - self.mean)
        self.order = np.argsort(codes, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(codes, self.order, 1)

    def _ranges(self, codes: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """(trees, queries): where the rows that share the prefix of this level start, and how many they are."""
        shift = self.rotations.below[level]
        first = codes >> shift << shift
        low = np.stack([np.searchsorted(s, f, "left") for s, f in zip(self.sorted, first)])
        return low, np.stack([np.searchsorted(s, f + ((1 << shift) - 1), "right") for s, f in zip(self.sorted, first)]) - low

    def candidates(self, queries: np.ndarray, most: int) -> Iterator[np.ndarray]:
        """Rows that most trees meet near each query: most of them and ties, unless the trees meet fewer."""
        rows, trees = len(self.vectors), len(self.sorted)
        codes = self.rotations.strings(queries - self.mean)
        start, size = np.zeros((trees, len(queries)), np.int64), np.full((trees, len(queries)), rows, np.int64)
        # the longest prefixes whose ranges hold enough, for all trees alike: from the root down, where they are few levels
        open_, deep = np.arange(len(queries)), np.zeros(len(queries), np.int64)
        for level in range(1, len(self.rotations.below)):
            low, count = self._ranges(codes[:, open_], level)
            fits = count.sum(0) >= (1 if level == 1 else REACH * most)
            open_ = open_[fits]
            if not len(open_):
                break
            start[:, open_], size[:, open_], deep[open_] = low[:, fits], count[:, fits], level
        flat, offset = self.order.reshape(-1), np.arange(trees) * rows
        for q in range(len(queries)):
            count = size[:, q]
            ends = np.cumsum(count)
            at = np.arange(ends[-1]) + np.repeat(start[:, q] + offset - (ends - count), count)
            met = np.bincount(flat[at], minlength=rows)
            if deep[q] < 2 and np.count_nonzero(met) < most:  # too few rows share a symbol: the root has all
                yield np.arange(rows)
                continue
            least = max(1, int(np.partition(met, rows - most)[rows - most])) if rows > most else 1
            yield np.flatnonzero(met >= least)


def usable(vector: Column) -> Column:
    """Neither null nor zero, all components finite numbers."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _least_equal(vectors: np.ndarray, most: int) -> np.ndarray:
    """Whether each row is among the first most of those equal to it."""
    keys = np.ascontiguousarray(vectors + 0.0).view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1])))[:, 0]
    _, group = np.unique(keys, return_inverse=True)
    order = np.argsort(group, kind="stable")
    sizes = np.bincount(group)
    place = np.empty(len(group), np.int64)
    place[order] = np.arange(len(group)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return place < most


class _Shard:
    """The forest of a shard's rows, that came sorted by id (null last), then vector."""

    def __init__(self, ids: pa.Array, vectors: np.ndarray, k: int, rotations: Rotations):
        names = ids.to_pylist()
        kept = np.array([n is None or i == 0 or n != names[i - 1] for i, n in enumerate(names)])
        kept[kept] = _least_equal(vectors[kept], k + 1)
        self.ids = ids.filter(pa.array(kept))
        self.place = {n: i for i, n in enumerate(self.ids.to_pylist()) if n is not None}
        self.forest = Forest(vectors[kept], rotations)

    def nearest(self, own: list, block: np.ndarray, k: int, most: int) -> Iterator[tuple[object, int, float]]:
        """(query id, row, distance) of the k best of each query, row among self.ids."""
        for q, near in enumerate(self.forest.candidates(block, most)):
            near = near[near != self.place.get(own[q], -1)]
            d = np.sqrt(np.square(self.forest.vectors[near] - block[q]).sum(1))
            if len(near) > k:
                some = d <= np.partition(d, k - 1)[k - 1]
                near, d = near[some], d[some]
            best = np.lexsort((near, d))[:k]  # rows are in order of id
            yield from ((own[q], n, s) for n, s in zip(near[best].tolist(), d[best].tolist()))


def search(df: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, trees: int = TREES, seed: int = 11) -> DataFrame:
    """(query_id, rank, id_col, score): the k nearest found of each row of queries among the rows of df."""
    spark = df.sparkSession
    pick = lambda d: d.select(d[id_col].alias("id"), d[vector_col].cast("array<double>").alias("v"))
    rows = pick(df).where(usable(F.col("v"))).withColumn("size", F.size("v"))
    # shards of each length of vectors, numbered through; a row a length
    split = F.greatest(F.lit(1), F.ceil(F.col("n") / SHARD_ROWS), F.least(F.lit(exchange_partitions(spark)), F.floor(F.col("n") / LEAST_SHARD))).cast("int")
    lengths = rows.groupBy("size").agg(F.count(F.lit(1)).alias("n")).withColumn("shards", split)
    lengths = lengths.withColumn("offset", (F.sum("shards").over(W.orderBy("size")) - F.col("shards")).cast("int"))
    total = lengths.agg(F.coalesce(F.sum("shards"), F.lit(1))).first()[0]
    # candidates grow with a power of the rows, as for any such hash; each shard gives its share
    lengths = lengths.select(F.col("size").alias("length"), "shards", "offset", F.ceil(F.sqrt("n") * k / 2 / F.col("shards")).cast("int").alias("most"))
    asked = pick(queries).where(usable(F.col("v")) & F.col("id").isNotNull()).groupBy("id").agg(F.min("v").alias("v")).withColumn("size", F.size("v"))
    # L different lengths take more than 4 L^2 bytes of input: the table has at most the root of a quarter of these
    lengths = F.broadcast(lengths)
    stored = rows.join(lengths, F.col("size") == F.col("length"))
    salt = F.when(F.col("id").isNull(), F.xxhash64("v")).otherwise(F.xxhash64("id"))
    stored = stored.withColumn("shard", F.col("offset") + F.pmod(salt, F.col("shards")).cast("int"))
    asked = asked.join(lengths, F.col("size") == F.col("length")).withColumn("shard", F.explode(F.sequence(F.col("offset"), F.col("offset") + F.col("shards") - 1)))
    pack = lambda d, what: d.select("shard", F.lit(what).alias("what"), "id", "v", "most")
    both = pack(stored, 0).unionByName(pack(asked, 1)).repartitionById(int(total), F.col("shard"))
    both = both.sortWithinPartitions("what", F.asc_nulls_last("id"), "v")
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, shard = [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            size = len(batch.column(3)[0])
            vectors = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            stored = int((batch.column(1).to_numpy() == 0).sum())
            if stored:
                ids.append(batch.column(2).slice(0, stored))
                parts.append(vectors[:stored])
            if stored == batch.num_rows or not parts:
                continue
            if shard is None:
                shard = _Shard(pa.concat_arrays(ids), np.concatenate(parts), k, Rotations(size, trees, seed))
            most, own = batch.column(4)[stored].as_py(), batch.column(2)[stored:].to_pylist()
            for a in range(0, len(own), BLOCK):
                out = list(shard.nearest(own[a : a + BLOCK], vectors[stored + a : stored + a + BLOCK], k, most))
                if out:
                    yield pa.record_batch([pa.array([o[0] for o in out], shard.ids.type), shard.ids.take(pa.array([o[1] for o in out])), pa.array([o[2] for o in out])], ["query_id", "id", "score"])

    found = both.mapInArrow(trimmed(run), f"query_id {kind}, id {kind}, score double")
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("score", F.asc_nulls_last("id")))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")
