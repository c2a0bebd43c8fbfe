"""Set-level checks of a corpus. Each returns the rows that break a rule, so an empty result means that it holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require_empty(violations: DataFrame, what: str) -> None:
    """Raise where a check found rows; for callers that want to stop instead of reading the rows."""
    if example := violations.take(1):
        raise ValueError(f"{what}: {example[0].asDict()}")


def duplicate_inputs(rows: DataFrame, key: str, parts: Column) -> DataFrame:
    """One row (input, copies, least_id) for each input that several rows share; input is a SHA-256, so a long text is moved once as 64 characters."""
    hashed = rows.select(key, F.sha2(parts, 256).alias("input"))
    return hashed.groupBy("input").agg(F.count("*").alias("copies"), F.min(key).alias("least_id")).where("copies > 1")


def conflicting_labels(rows: DataFrame, key: str, parts: Column, label: str) -> DataFrame:
    """One row (input, n_labels, copies) for each input that rows label differently; null labels do not count."""
    hashed = rows.select(F.sha2(parts, 256).alias("input"), label)
    found = hashed.groupBy("input").agg(F.count_distinct(label).alias("n_labels"), F.count("*").alias("copies"))
    return found.where("n_labels > 1")


def crossing_groups(rows: DataFrame, group: str, split: str) -> DataFrame:
    """Groups whose rows lie in more than one split: (group, splits)."""
    return rows.groupBy(group).agg(F.count_distinct(split).alias("splits")).where("splits > 1")


def shared_between(rows: DataFrame, side: Column, keys: dict[str, Column]) -> DataFrame:
    """(what, shared) for each key expression: how many distinct values occur in rows of either side (side true and side false).

    One pass and one shuffle: each row gives one (what, value) for each key, and the sides of a value are gathered. Null
    values do not count.
    """
    each = rows.select(side.alias("side"), F.explode(F.array(*[F.struct(F.lit(what).alias("what"), key.cast("string").alias("k")) for what, key in keys.items()])).alias("x"))
    sides = each.where(F.col("x.k").isNotNull()).groupBy("x.what", "x.k").agg(F.bool_or("side").alias("a"), F.bool_or(~F.col("side")).alias("b"))
    return sides.groupBy("what").agg(F.count_if(F.col("a") & F.col("b")).alias("shared"))


def exposed(items: DataFrame, inventory: DataFrame, text: str = "text") -> DataFrame:
    """Items whose text, after NFC by the caller and trimming, is in the inventory exactly. Paraphrases are not found."""
    known = inventory.select(F.sha2(F.trim(text), 256).alias("_h")).distinct()
    return items.withColumn("_h", F.sha2(F.trim(text), 256)).join(known, "_h", "left_semi").drop("_h")


def unexposed(items: DataFrame, inventory: DataFrame, text: str = "text") -> DataFrame:
    """Items whose text is not in the inventory."""
    known = inventory.select(F.sha2(F.trim(text), 256).alias("_h")).distinct()
    return items.withColumn("_h", F.sha2(F.trim(text), 256)).join(known, "_h", "left_anti").drop("_h")


def classify_sides(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """(key, status) of every key on either side: source_only, destination_only, equal or different; null equals null."""
    left, right = a.select(key, F.struct(value).alias("_a")), b.select(key, F.struct(value).alias("_b"))
    status = (
        F.when(F.col("_b").isNull(), "source_only")
        .when(F.col("_a").isNull(), "destination_only")
        .when(F.col(f"_a.{value}").eqNullSafe(F.col(f"_b.{value}")), "equal")
        .otherwise("different")
    )
    return left.join(right, key, "full").select(key, status.alias("status"))


def missing_from(required: DataFrame, covered: DataFrame, keys: list[str]) -> DataFrame:
    """Required key combinations that nothing covers."""
    return required.select(keys).distinct().join(covered.select(keys).distinct(), keys, "left_anti")


#: Combinations that a design may have; larger ones are no lists of values but data.
MOST_COMBINATIONS = 1_000_000


def grid(*sides: DataFrame) -> DataFrame:
    """All combinations of design dimensions, which are lists of values: their number is checked before they are combined."""
    size = 1
    for side in sides:
        size *= side.limit(MOST_COMBINATIONS + 1).count()
    if size > MOST_COMBINATIONS:
        raise ValueError(f"{size} combinations are no design grid")
    whole = sides[0]
    for side in sides[1:]:
        whole = whole.crossJoin(F.broadcast(side))
    return whole


def grouped_missing(missing: DataFrame, scope: str, value: str) -> DataFrame:
    """(scope, missing): the missing values of a scope as one sorted array."""
    return missing.groupBy(scope).agg(F.array_sort(F.collect_set(value)).alias("missing"))


def progress(required: DataFrame, covered: DataFrame, scope: str, keys: list[str]) -> DataFrame:
    """(scope, required, covered, missing) counts of each scope; covered + missing = required."""
    seen = covered.select(keys).distinct().withColumn("_seen", F.lit(1))
    joined = required.select(keys).distinct().join(seen, keys, "left")
    return joined.groupBy(scope).agg(F.count("*").alias("required"), F.count("_seen").alias("covered"), F.count_if(F.col("_seen").isNull()).alias("missing"))
