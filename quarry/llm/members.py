"""A Bloom filter over ids, to spare most rows an exchange: some bits an id, up to a bound beyond which more rows pass."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import trimmed

#: Bits of a filter: at most 2 ** this, 32 MB.
MOST_BITS = 28


def member_spots(id_: Column, bits: int) -> list[Column]:
    return [F.shiftrightunsigned(F.xxhash64(id_, F.lit(s)), 64 - bits).alias(f"spot{s}") for s in (1, 2)]


def member_filter(ids: DataFrame) -> tuple[np.ndarray, int]:
    """The words of a filter over ids (id), and the logarithm of its bits, eight an id; two hashes."""
    bits = min(MOST_BITS, max(16, (8 * ids.count()).bit_length()))
    spots = ids.select(F.explode(F.array(*member_spots(F.col("id"), bits))).alias("spot"))
    words = spots.select(F.shiftright("spot", 6).alias("w"), F.expr("shiftleft(1L, cast(spot % 64 AS int))").alias("b"))
    words = words.groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()  # at most 2 ** (bits - 6) rows
    table = np.zeros(1 << (bits - 6), np.int64)
    table[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64)
    return table.view(np.uint64), bits


def perhaps(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The rows whose key is in ids (id), and few others. ids are read twice."""
    table, bits = member_filter(ids)
    shared = rows.sparkSession.sparkContext.broadcast(table)  # 2 ** MOST_BITS bits at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = shared.value
        for batch in batches:
            ok = np.ones(batch.num_rows, bool)
            for k in (-2, -1):
                spot = batch.column(batch.num_columns + k).to_numpy()
                ok &= (filled[spot >> 6] >> (spot & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            if ok.any():
                yield batch.select(range(batch.num_columns - 2)).filter(pa.array(ok))

    return rows.select("*", *member_spots(F.col(key), bits)).mapInArrow(trimmed(run), rows.schema)
