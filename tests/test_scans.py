"""Ordered passes and ranks of hot keys, cut into blocks, against plain windows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from turnlake.operators import journals, quantiles, scans


@pytest.fixture(scope="module")
def skewed(spark):
    """One key with nine tenths of the rows, ties in the order's number, null values, a null key."""
    r = random.Random(3)
    rows = [("hot" if i % 10 else r.choice(["a", "b", None]), i // 3, i, r.choice([None, 1, 2, 3, 5])) for i in range(6000)]
    return spark.createDataFrame(rows, "k string, t long, id long, v long")


def test_blocks_share_a_hot_key(skewed):
    sizes = scans.in_blocks(skewed, "k", F.col("t"), hot_rows=100, blocks=8).where("k = 'hot'").groupBy(scans.BLOCK).count().collect()
    assert len(sizes) == 8 and max(r["count"] for r in sizes) < 2 * 5400 / 8
    assert scans.in_blocks(skewed, "k", F.col("t")).select(scans.BLOCK).distinct().count() == 1


@pytest.mark.parametrize("hot_rows", [100, 10**9])
def test_scans_are_plain_windows(skewed, hot_rows):
    placed = scans.in_blocks(skewed, "k", F.col("t"), hot_rows=hot_rows, blocks=8)
    order = ["t", "id"]
    over = Window.partitionBy("k").orderBy(*order)
    found = scans.with_previous(placed, "k", order, "before", F.col("v"))
    found = scans.with_previous(found, "k", order, "after", F.col("v"), step=1)
    found = scans.with_running_sum(found, "k", order, "total", F.col("v"))
    found = scans.with_first(found, "k", order, "first", F.col("v"))
    total = F.coalesce(F.sum("v").over(over.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    plain = skewed.select("id", F.lag("v").over(over), F.lead("v").over(over), total, F.first("v").over(over))
    assert sorted(map(tuple, found.select("id", "before", "after", "total", "first").collect())) == sorted(map(tuple, plain.collect()))


def test_runs_of_a_hot_key(spark, skewed, monkeypatch):
    inside = F.coalesce(F.col("v") > 1, F.lit(False))
    plain = sorted(map(tuple, journals.runs(skewed, "k", ["t", "id"], inside, 2).collect()), key=repr)
    monkeypatch.setattr(scans, "HOT_ROWS", 100)
    monkeypatch.setattr(scans.in_blocks, "__defaults__", (100, 16))
    assert sorted(map(tuple, journals.runs(skewed, "k", ["t", "id"], inside, 2).collect()), key=repr) == plain
    assert len(plain) > 500


def test_values_at_ranks(spark):
    r = random.Random(5)
    values = {"a": [r.uniform(-1e3, 1e3) for _ in range(3000)], "b": [2.0**i for i in range(-300, 300, 7)], "c": [7.0], "d": [1.0, float("inf"), float("-inf"), 1.0], None: [3.0, 1.0, 2.0]}
    rows = [(k, x) for k, own in values.items() for x in own] + [("a", None), ("a", float("nan")), ("e", None)]
    wanted = [(k, i) for k, own in values.items() for i in {0, len(own) // 2, len(own) - 1, len(own), -1}] + [("e", 0)]
    found = quantiles.values_at(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", spark.createDataFrame(wanted, "k string, rank long"))
    plain = {(k, i): sorted(values[k])[i] for k, i in wanted if k in values and 0 <= i < len(values[k])}
    assert {(r.k, r.rank): r.value for r in found.collect()} == plain


def test_large_and_small_groups_have_one_latency(spark):
    r = random.Random(7)
    rows = [(i % 10 == 0, r.random() * 100) for i in range(4000)] + [(None, 4.0), (None, None)]
    log = spark.createDataFrame(rows, "g boolean, v double")
    plain = {r.g: tuple(r) for r in journals.latency(log, ["g"], "v").collect()}
    assert {r.g: tuple(r) for r in journals.latency(log, ["g"], "v", ranked_rows=500).collect()} == plain
    assert plain[None][1:] == (1, 4.0, 4.0, 4.0)
