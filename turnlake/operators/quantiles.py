"""Exact values at ranks of groups of any size, by rounds of bucket counts.

A round cuts the range in which a rank's value lies into BUCKETS parts, counts the group's values in each (a sum over all
tasks) and goes on with the part that holds the rank, from its least to its greatest value. The least and the greatest
value fall in different parts, so a range gets smaller in each round and ends as one value. What a task holds of a group
is BUCKETS counts, never its values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnlake.session import checkpointed

BUCKETS = 1024


def bucket(value: Column, low: Column, high: Column) -> Column:
    """The part of low to high, from 0, in which a value lies: 0 for low, BUCKETS - 1 for high, never falling in between."""
    halves = lambda x: x.cast("double") / 2  # noqa: E731  differences of halves do not overflow
    share = (halves(value) - halves(low)) / (halves(high) - halves(low))
    endless = (F.abs(low.cast("double")) == float("inf")) | (F.abs(high.cast("double")) == float("inf"))
    ends = F.when(value == low, 0).when(value == high, BUCKETS - 1)
    return ends.when(endless, BUCKETS // 2).otherwise(F.least(F.lit(BUCKETS - 2), F.greatest(F.lit(1), F.floor(share * BUCKETS)))).cast("int")


def values_at(rows: DataFrame, keys: list[str], value: str, wanted: DataFrame) -> DataFrame:
    """wanted (keys, rank), rank from 0 in the order of a group's values, with the value found: (keys, rank, value).

    Null values and NaN do not count; a rank that a group has not gives no row. Null keys are groups too.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    packed = lambda df, *more: df.select(*[F.struct(F.col(k).alias("v")).alias(n) for k, n in zip(keys, names, strict=True)], *more)
    own = packed(rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))), F.col(value).alias("_v"))
    whole = own.groupBy(*names).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.count("*").alias("_n"))
    open_ranks = packed(wanted.distinct(), "rank").join(whole, names).where((F.col("rank") >= 0) & (F.col("rank") < F.col("_n")))
    open_ranks = checkpointed(open_ranks.select(*names, "rank", "_low", "_high", F.lit(0).cast("long").alias("_below")))
    done = []
    while True:
        done.append(open_ranks.where("_low = _high").select(*names, "rank", F.col("_low").alias("value")))
        open_ranks = open_ranks.where("_low < _high")
        ranges = open_ranks.select(*names, "_low", "_high").distinct()
        if not ranges.limit(1).count():
            break
        inside = own.join(ranges, names).where((F.col("_v") >= F.col("_low")) & (F.col("_v") <= F.col("_high")))
        part = [*names, "_low", "_high"]
        counts = inside.groupBy(*part, bucket(F.col("_v"), F.col("_low"), F.col("_high")).alias("_b")).agg(F.count("*").alias("_n"), F.min("_v").alias("_from"), F.max("_v").alias("_to"))
        before = F.coalesce(F.sum("_n").over(Window.partitionBy(*part).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        placed = counts.withColumn("_before", before)
        at = F.col("rank") - F.col("_below") - F.col("_before")
        found = open_ranks.join(placed, part).where((at >= 0) & (at < F.col("_n")))
        open_ranks = checkpointed(found.select(*names, "rank", F.col("_from").alias("_low"), F.col("_to").alias("_high"), (F.col("_below") + F.col("_before")).alias("_below")))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.select(*[F.col(n)["v"].alias(k) for k, n in zip(keys, names, strict=True)], "rank", "value")
