"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each row draws the exponential key -ln(u) / quality weight, u being a hash of its id, so that reruns agree. A
source whose target is k whole epochs and a rest takes every row k times, and for the rest the rows of smallest
key while their prefix sum stays within it; the row that crosses the border is taken if that brings the sum nearer.

Prefix sums never put a source into one task: keys are cut into bins of equal probability, sizes are summed by bin
(pre-aggregated), the border bin of each source is found from these sums, and only border bins are sorted.

Defined results: null text has size 0 and is taken 0 times; a null id draws by size; a null source is a source of its own, last; weights
that are null, not positive or not finite count as 1; sources without words have target 0; ties of the key are
ordered by id, then size; equal rows are interchangeable; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, materialize

#: Bins of the keys of a source.
BINS = 1 << 14
#: No source is repeated more often.
MOST_EPOCHS = 3


def uniform(key: Column, seed: str = "") -> Column:
    """A number within (0, 1) from 52 bits of md5."""
    digits = F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit("")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, cap: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size, target) from one row (source, source_size) a source.

    Sources in code-point order, null last, weigh 1, 2, 3, 1, ... and share the sum of all sizes. With the sources
    ordered by cap * size / weight, those up to some place are capped and the others share what is left by weight.
    """
    order = W.orderBy(F.col("source").isNull(), F.col("source"))
    ranked = sizes.withColumn("weight", (F.row_number().over(order) - 1) % 3 + 1).withColumn("most", F.col("source_size") * cap)
    by_ratio = W.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), "source")
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    steps = ranked.withColumns({
        "level": (F.sum("source_size").over(every.partitionBy(F.lit(1))) - F.coalesce(F.sum("most").over(before), F.lit(0))) / (F.sum("weight").over(every.partitionBy(F.lit(1))) - F.coalesce(F.sum("weight").over(before), F.lit(0))),
        "ratio": F.col("most") / F.col("weight"),
    })
    # the first source that needs no cap, and with it all after it
    free = F.max(F.when(F.col("level") <= F.col("ratio"), F.lit(1)).otherwise(0)).over(by_ratio.rowsBetween(W.unboundedPreceding, 0))
    marked = steps.withColumns({"free": free, "least": F.first(F.when(F.col("level") <= F.col("ratio"), F.col("level")), ignorenulls=True).over(by_ratio.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))})
    return marked.select("source", "source_size", F.when(F.col("free") == 1, F.col("least") * F.col("weight")).otherwise(F.col("most").cast("double")).alias("target"))


def mix(rows: DataFrame, seed: str = "mix", bins: int = BINS, cap: int = MOST_EPOCHS) -> DataFrame:
    """(id, size, source, source_size, target, epochs, chosen, taken) of every row (id, source, size, weight).

    A row is used epochs + chosen times; taken is its size times that.
    """
    weight = F.when((F.col("weight") > 0) & (F.col("weight") < float("inf")), F.col("weight").cast("double")).otherwise(1.0)
    # rows without an id have keys by size, so that they aren't all one key
    key = F.coalesce(F.col("id").cast("string"), F.concat(F.lit("size "), "size"))
    energy = -F.log(uniform(key, seed)) / weight
    # a monotone map of the key to [0, 1) under which keys of weight 1 are uniform
    place = F.least(F.floor((1 - F.exp(-F.col("energy"))) * bins), F.lit(bins - 1)).cast("int")
    keyed = rows.select("id", "source", "size", energy.alias("energy")).withColumn("bin", place)
    keyed = materialize(keyed, "mix")
    by_bin = materialize(keyed.groupBy("source", "bin").agg(F.sum("size").alias("bin_size")), "bins")
    plan = targets(by_bin.groupBy("source").agg(F.sum("bin_size").alias("source_size")), cap)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = materialize(plan.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "plan")
    # bins are at most BINS a source: a window over them is bounded
    sums = F.sum("bin_size").over(W.partitionBy("source").orderBy("bin"))
    bins_of = by_bin.withColumn("upto", sums)
    p = plan.select(F.col("source").alias("p_source"), "source_size", "target", "epochs", "rest")
    bins_of = bins_of.join(p, bins_of["source"].eqNullSafe(p["p_source"])).drop("p_source")
    # the border bin is the first whose sum reaches beyond the rest
    border = bins_of.withColumn("start", F.col("upto") - F.col("bin_size")).where((F.col("upto") > F.col("rest")) & (F.col("start") <= F.col("rest")))
    border = border.groupBy("source").agg(F.min(F.struct("bin", "start")).alias("b"))
    plan = plan.join(border.select(F.col("source").alias("b_source"), "b"), plan["source"].eqNullSafe(F.col("b_source")), "left")
    old = [by_bin, p]
    plan = materialize(plan.select("source", "source_size", "target", "epochs", "rest", F.col("b.bin").alias("border"), F.col("b.start").alias("start")), "borders")
    for table in old:
        discard(table)
    q = plan.withColumnRenamed("source", "p_source")
    # one row a source: broadcast by Spark itself if it is small, else a join that adaptive execution splits
    joined = keyed.join(q, keyed["source"].eqNullSafe(q["p_source"])).drop("p_source")
    at = F.col("bin") == F.col("border")
    plain = joined.where(~F.coalesce(at, F.lit(False))).withColumn("chosen", F.coalesce((F.col("bin") < F.col("border")), F.lit(True)) & (F.col("rest") > 0))
    w = W.partitionBy("source").orderBy("energy", "id", "size")
    inside = joined.where(at).withColumn("end", F.col("start") + F.sum("size").over(w.rowsBetween(W.unboundedPreceding, 0)))
    near = (F.col("end") <= F.col("rest")) | ((F.col("end") - F.col("size") <= F.col("rest")) & (F.col("end") - F.col("rest") < F.col("rest") - (F.col("end") - F.col("size"))))
    inside = inside.withColumn("chosen", near & (F.col("rest") > 0)).drop("end")
    both = plain.unionByName(inside)
    times = F.col("epochs") + F.when(F.col("chosen") & (F.col("epochs") < cap), 1).otherwise(0)
    return both.select("id", "size", "source", "source_size", "target", "epochs", "chosen", times.alias("times"), (F.col("size") * times).alias("taken"))
