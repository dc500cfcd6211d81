"""Sharding by extendible hashing: a directory indexed by hash-prefix bits, in which only oversized buckets split.

A row's hash is the first 64 bits of md5(key). Bytes are summed per prefix of `step` bits first (rows are
pre-aggregated before that exchange, so a hot prefix costs no more than another); a bucket splits on one more bit
while it holds more than the limit. Prefixes that are still too large after `step` bits are summed again
`step` bits deeper, from their own rows only, until every shard fits or the hash has no more bits.

Defined results: a null key is hashed as the empty string, null content counts 0 bytes; rows with one key share a
shard, so a single key beyond the limit ends in a shard of its own at 64 bits (fits = false), never dropped; an
empty table gives no rows; extra columns stay, those of an added name (a parameter) with _ appended to theirs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import aside, discard, materialize

BITS = 64


def hash_bits(key: Column) -> Column:
    """The first 64 bits of md5 as a string of 0 and 1."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 16)
    return F.lpad(F.conv(digits, 16, 2), BITS, "0")


def directory(keyed: DataFrame, limit: int, step: int = 12) -> DataFrame:
    """(prefix, shard_bytes) of all buckets, from rows (bits, bytes); prefixes are disjoint and cover all rows."""
    done, rest, depth, held = None, keyed, 0, []
    while True:
        # sums of every prefix of depth .. depth + step bits, from those of the longest
        deep = min(depth + step, BITS)
        leaves = rest.groupBy(F.substring("bits", 1, deep).alias("leaf")).agg(F.sum("bytes").alias("bytes"))
        leaves = materialize(leaves, "leaves")
        held.append(leaves)
        prefixes = leaves.select(F.explode(F.transform(F.sequence(F.lit(depth), F.lit(deep)), lambda d: F.substring("leaf", F.lit(1), d))).alias("prefix"), "bytes")
        sums = prefixes.groupBy("prefix").agg(F.sum("bytes").alias("shard_bytes"))
        # a prefix is a bucket if it fits (or has no more bits) and its parent doesn't
        parent = F.when(F.length("prefix") > depth, F.expr("substring(prefix, 1, length(prefix) - 1)"))
        over = sums.where(F.col("shard_bytes") > limit).select(F.col("prefix").alias("over_prefix"))
        fits = (F.col("shard_bytes") <= limit) | (F.length("prefix") == BITS)
        buckets = sums.where(fits).withColumn("parent", parent)
        top = F.col("parent").isNull()
        found = buckets.join(over, buckets["parent"] == over["over_prefix"], "left").where(top | F.col("over_prefix").isNotNull())
        found = materialize(found.select("prefix", "shard_bytes"), "buckets")
        held.append(found)
        done = found if done is None else done.unionByName(found)
        large = sums.where((F.length("prefix") == deep) & (F.col("shard_bytes") > limit)).select(F.col("prefix").alias("large"))
        if deep == BITS or large.isEmpty():
            done = materialize(done, "shards")
            for table in held:
                discard(table)
            return done
        rest = materialize(rest.join(large, F.substring("bits", 1, deep) == F.col("large"), "left_semi"), "oversized")
        held.append(rest)
        depth = deep
        # the deeper rounds start below prefixes known to be too large
        # (their own sum is in no bucket, as it exceeds the limit)


def assign_shards(df: DataFrame, limit: int, key_col: str = "doc_id", content_col: str = "text", shard_col: str = "shard", bytes_col: str = "shard_bytes", fits_col: str = "fits", step: int = 12) -> DataFrame:
    """df with the shard (hash prefix) of each row, that shard's bytes and whether they are within the limit."""
    if limit < 1:
        raise ValueError("limit must be positive")
    df, moved = aside(df, (shard_col, bytes_col, fits_col))
    size = F.coalesce(F.octet_length(df[moved.get(content_col, content_col)]), F.lit(0)).cast("long")
    # the row stays whole in a column of its own, so that no name within can be taken for another
    marked = df.select(F.struct("*").alias("row"), hash_bits(df[moved.get(key_col, key_col)]).alias("bits"), size.alias("bytes"))
    keyed = materialize(marked.groupBy("bits").agg(F.sum("bytes").alias("bytes")), "keyed")
    shards = directory(keyed, limit, step)
    discard(keyed)
    # the directory: slots of some bits, of which a shallower bucket has several and a deeper one shares one
    count, deepest = shards.agg(F.count(F.lit(1)), F.coalesce(F.max(F.length("prefix")), F.lit(0))).first()
    slots = min(deepest, max(1, count).bit_length() + 2)
    free = F.lit(slots) - F.length("prefix")
    tails = F.transform(F.sequence(F.lit(0), F.pow(F.lit(2), free).cast("int") - 1), lambda i: F.lpad(F.bin(i), free, "0"))
    tails = F.when(free > 0, tails).otherwise(F.array(F.lit("")))
    shards = shards.select(F.col("prefix"), "shard_bytes", F.explode(tails).alias("tail"))
    shards = shards.select("prefix", "shard_bytes", F.substring(F.concat("prefix", "tail"), 1, slots).alias("slot"))
    joined = marked.withColumn("at", F.substring("bits", 1, slots)).join(shards, (F.col("at") == F.col("slot")) & F.col("bits").startswith(F.col("prefix")))
    return joined.select("row.*", F.col("prefix").alias(shard_col), F.col("shard_bytes").alias(bytes_col), (F.col("shard_bytes") <= limit).alias(fits_col))


def write_shards(df: DataFrame, path: str, limit: int, **columns: str) -> None:
    """Write one folder a shard under path, by rows already assigned to the same task."""
    assigned = assign_shards(df, limit, **columns)
    shard = columns.get("shard_col", "shard")
    assigned.repartition(F.col(shard)).write.partitionBy(shard).parquet(path)
