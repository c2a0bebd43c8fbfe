"""Ordered passes over the rows of a key that may hold most of a table: within blocks of a key's rows, with what is carried over their borders.

A key with more than HOT_SHARE of the rows is hot; its rows are cut into BLOCKS ranges of its order at approximate
percentiles, so blocks are about equally long and no task holds the whole key. A block's summary (its last row, its first
row, its sum) is one row; summaries of a key, BLOCKS at most, are put in order and give each block what it needs from the
others. All other keys are one block. There are at most 1 / HOT_SHARE hot keys, so what is broadcast is bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Share of all rows, and number of rows, above which a key is cut into BLOCKS blocks.
HOT_SHARE, HOT_ROWS, BLOCKS = 1 / 64, 100_000, 64
BLOCK = "_block"


def in_blocks(rows: DataFrame, key: str, by: Column, hot_rows: int = HOT_ROWS, blocks: int = BLOCKS) -> DataFrame:
    """rows with the number of their block, from 0: rows of one key lie in blocks in the order of by, equal ones in the same.

    by is a number that never falls where the order of the rows rises. Rows with a null key are one block, as is a null by.
    The result has the attribute in_one_block where no key is cut.
    """
    counts = rows.groupBy(key).agg(F.count("*").alias("_n"))
    most, total = counts.agg(F.max(F.when(F.col(key).isNotNull(), F.col("_n"))), F.sum("_n")).first()
    least = max(hot_rows, HOT_SHARE * (total or 0))
    hot = [] if (most or 0) <= least else [x[0] for x in counts.where((F.col("_n") > least) & F.col(key).isNotNull()).select(key).limit(int(1 / HOT_SHARE)).collect()]
    if not hot:
        whole = rows.withColumn(BLOCK, F.lit(0))
        whole.in_one_block = True
        return whole
    shares = [i / blocks for i in range(1, blocks)]
    cuts = rows.where(F.col(key).isin(hot)).groupBy(key).agg(F.percentile_approx(by.cast("double"), shares, 10_000).alias("_cuts"))
    block = F.size(F.filter(F.coalesce("_cuts", F.expr("cast(array() as array<double>)")), lambda x: x < by.cast("double")))
    return rows.join(F.broadcast(cuts), key, "left").withColumn(BLOCK, block).drop("_cuts")


def as_before(rows: DataFrame, changed: DataFrame) -> DataFrame:
    """changed, marked as in_one_block if rows are, from which it comes with all blocks as they were."""
    changed.in_one_block = getattr(rows, "in_one_block", False)
    return changed


def _within(key: str, order: list[str]) -> Window:
    return Window.partitionBy(key, BLOCK).orderBy(*order)


def _carried(summaries: DataFrame, key: str, name: str, value: Column) -> DataFrame:
    """(key, block, name) of the blocks of keys that have several, from one row for each block."""
    several = summaries.withColumn("_of", F.count("*").over(Window.partitionBy(key))).where("_of > 1")
    return F.broadcast(several.select(key, BLOCK, value.alias(name)).where(F.col(name).isNotNull()))


def with_previous(rows: DataFrame, key: str, order: list[str], name: str, value: Column, step: int = -1) -> DataFrame:
    """rows of in_blocks() with the value of the row before (step -1) or after (step 1) each within its key; null for the first or last."""
    shift, edge = (F.lag, F.max_by) if step < 0 else (F.lead, F.min_by)
    held = F.struct(value.alias("v"))
    if getattr(rows, "in_one_block", False):
        return as_before(rows, rows.withColumn(name, shift(value).over(_within(key, order))))
    summaries = rows.groupBy(key, BLOCK).agg(edge(held, F.struct(*order)).alias("_edge"))
    border = _carried(summaries, key, "_border", shift("_edge").over(Window.partitionBy(key).orderBy(BLOCK)))
    near = rows.withColumn("_near", shift(held).over(_within(key, order)))
    return near.join(border, [key, BLOCK], "left").withColumn(name, F.coalesce("_near", "_border")["v"]).drop("_near", "_border")


def with_running_sum(rows: DataFrame, key: str, order: list[str], name: str, value: Column) -> DataFrame:
    """rows of in_blocks() with the sum of a whole number over the rows up to each, itself included, within its key."""
    own = rows.withColumn(name, F.coalesce(F.sum(value).over(_within(key, order).rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    if getattr(rows, "in_one_block", False):
        return as_before(rows, own)
    sums = rows.groupBy(key, BLOCK).agg(F.coalesce(F.sum(value), F.lit(0)).alias("_sum"))
    before = _carried(sums, key, "_before", F.sum("_sum").over(Window.partitionBy(key).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)))
    return own.join(before, [key, BLOCK], "left").withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0))).drop("_before")


def with_first(rows: DataFrame, key: str, order: list[str], name: str, value: Column) -> DataFrame:
    """rows of in_blocks() with the value of the first row of their key; every block finds its own first row, and the least of these is the key's."""
    held, at = F.struct(value.alias("v")), F.struct(*order)
    if getattr(rows, "in_one_block", False):
        return as_before(rows, rows.withColumn(name, F.first(value).over(_within(key, order))))
    firsts = rows.groupBy(key, BLOCK).agg(F.min_by(held, at).alias("_edge"), F.min(at).alias("_at"))
    border = _carried(firsts, key, "_border", F.first("_edge").over(Window.partitionBy(key).orderBy("_at")))
    near = rows.withColumn("_near", F.first(held).over(_within(key, order)))
    return near.join(border, [key, BLOCK], "left").withColumn(name, F.coalesce("_border", "_near")["v"]).drop("_near", "_border")
