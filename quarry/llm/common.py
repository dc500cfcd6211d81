"""What several operators need: scratch tables, word rules, sizes of exchanges."""

from __future__ import annotations

import ctypes
import gc
import time
from collections.abc import Callable, Iterable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.scratch import discard, materialize

__all__ = ["WORD", "aside", "discard", "documents", "exchange_partitions", "materialize", "release_shuffles", "trimmed", "word_count"]
#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def trimmed(run: Callable) -> Callable:
    """run, a function of a partition's batches, giving freed memory back to the system in the end: idle workers stay small."""

    @wraps(run)
    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)

    return whole


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of plans that nothing refers to any more; else that waits for the driver's memory to fill."""
    for _ in range(3):  # the first round frees Python's references to plans, the next the plans' shuffles
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def exchange_partitions(spark: SparkSession, times: int = 1) -> int:
    """Partitions of an explicit exchange: the session's setting, which the cluster sizes to its data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))) * times


def aside(df: DataFrame, added: Iterable[str]) -> tuple[DataFrame, dict[str, str]]:
    """df with columns that an added name would clash with, in any case, under their name with _ appended; new names by old."""
    taken = {c.lower() for c in (*df.columns, *added)}
    clash, moved = {c.lower() for c in added}, {}
    for c in df.columns:
        new = c
        while new.lower() in clash or (new != c and new.lower() in taken):
            new += "_"
        taken.add(new.lower())
        moved[c] = new
    return df.toDF(*moved.values()), moved


def word_count(text: Column) -> Column:
    """Words of a text as BIGINT; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
