"""Per-user measurement baselines: batch statistics, incremental means, comparison with a baseline."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlake.functions.numbers import finite, percent_delta, z_score


def split_measurements(rows: DataFrame, value: str, low: float = 0.0, high: float | None = None) -> DataFrame:
    """rows with column fault: missing, not_finite, out_of_range, or null for a good measurement."""
    v = F.col(value)
    outside = v <= low if high is None else (v <= low) | (v > high)
    return rows.withColumn("fault", F.when(v.isNull(), "missing").when(~finite(v), "not_finite").when(outside, "out_of_range"))


def simple_baseline(rows: DataFrame, key: str, values: list[str]) -> DataFrame:
    """One row for each key: samples, and for each value its mean, sample deviation (0 for one sample) and sum of squares m2."""
    aggregates = [x for v in values for x in (F.avg(v).alias(f"{v}_mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias(f"{v}_std"))]
    found = rows.groupBy(key).agg(F.count("*").alias("samples"), *aggregates)
    return found.withColumns({f"{v}_m2": F.col(f"{v}_std") * F.col(f"{v}_std") * F.greatest(F.col("samples") - 1, F.lit(0)) for v in values})


def against_baseline(rows: DataFrame, baseline: DataFrame, key: str, values: list[str]) -> DataFrame:
    """rows with {value}_z and {value}_delta_pct; all z are null unless every deviation is above 0, all deltas unless every mean is."""
    joined = rows.join(baseline, key)
    spread = F.least(*[F.col(f"{v}_std") for v in values], F.lit(float("inf"))) > 0
    based = F.least(*[F.col(f"{v}_mean") for v in values], F.lit(float("inf"))) > 0
    new = {}
    for v in values:
        new[f"{v}_z"] = F.when(spread, z_score(F.col(v), F.col(f"{v}_mean"), F.col(f"{v}_std")))
        new[f"{v}_delta_pct"] = F.when(based, percent_delta(F.col(v), F.col(f"{v}_mean")))
    return joined.withColumns(new).select(*rows.columns, *new)


def rounded_step(n: int, mean: float, m2: float, x: float, digits: int = 6) -> tuple[int, float, float]:
    """Count, mean and sum of squares after one more sample; the mean is rounded and goes on from there, m2 is not."""
    new = mean + (x - mean) / (n + 1)
    return n + 1, round(new, digits), m2 + (x - mean) * (x - new)


def welford(rows: DataFrame, key: str, order: list[str], value: str, digits: int = 6) -> DataFrame:
    """The incremental baseline: one row (key, samples, mean, std, m2), values taken in order.

    The mean is rounded after each sample and the rounded mean is what the next step starts from, so the result depends on
    the order. Rows are dealt by key and sorted, and one pass carries the three numbers of the key at hand only, so a key
    may have any number of values. Keys are taken as text and given back in their own type; null values are left out.
    """
    kind = rows.select(key).schema[0].dataType.simpleString()

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, done = None, (0, 0.0, 0.0), []
        for frame in frames:
            for k, x in zip(frame["k"], frame["x"], strict=True):
                if k != now:
                    done += [(now, *state)] if now is not None else []
                    now, state = k, (0, 0.0, 0.0)
                state = rounded_step(*state, x, digits)
            yield pd.DataFrame(done, columns=["k", "samples", "mean", "m2"])
            done = []
        if now is not None:
            yield pd.DataFrame([(now, *state)], columns=["k", "samples", "mean", "m2"])

    slim = rows.where(F.col(value).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("string").alias("k"), *order, F.col(value).cast("double").alias("x"))
    sums = slim.repartition("k").sortWithinPartitions("k", *order).select("k", "x").mapInPandas(fold, "k string, samples long, mean double, m2 double")
    std = F.when(F.col("samples") > 1, F.sqrt(F.col("m2") / (F.col("samples") - 1))).otherwise(0.0)
    return sums.select(F.col("k").cast(kind).alias(key), "samples", "mean", F.bround(std, digits).alias("std"), "m2")


def imported(rows: DataFrame, key: str, values: list[str]) -> DataFrame:
    """rows of baselines from elsewhere with column fault: key, samples, or the first value that is missing, not finite or not above 0, or whose m2 is below 0.

    samples may be called n; a missing m2 is 0. Good and bad rows stay together, so that an import can want all good ones.
    """
    named = rows.withColumn("samples", F.coalesce(*[F.col(x) for x in ("samples", "n") if x in rows.columns]))
    named = named.withColumns({f"{v}_m2": F.coalesce(F.col(f"{v}_m2"), F.lit(0.0)) for v in values})
    tests = [(F.col(key).isNull(), "key"), (~F.coalesce(F.col("samples") >= 1, F.lit(False)), "samples")]
    tests += [(~F.coalesce(finite(F.col(v)) & (F.col(v) > 0) & (F.col(f"{v}_m2") >= 0), F.lit(False)), v) for v in values]
    return named.withColumn("fault", F.coalesce(*[F.when(test, code) for test, code in tests], F.lit(None).cast("string")))


def upserted(held: DataFrame, new: DataFrame, key: str, deleted: DataFrame | None = None) -> DataFrame:
    """A table of one row for each key after new rows took the place of theirs and deleted keys went; write it whole to a new place, then use that."""
    left = held.join(new.select(key), key, "left_anti").unionByName(new.select(held.columns))
    return left if deleted is None else left.join(deleted.select(key), key, "left_anti")


def looked_up(held: DataFrame, key: str, value) -> DataFrame:
    """The row of one key; the filter reaches the scan."""
    return held.where(F.col(key) == value)
