"""A keyed table changed as a whole or not at all, against a dictionary."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from turnlake.sources import store

SCHEMA = "k string, v long"


def table(spark, rows):
    return spark.createDataFrame(sorted(rows.items()), SCHEMA)


def held(spark, path, **options):
    return {r.k: r.v for r in store.read(spark, path, **options).collect()}


def test_changes_are_those_of_a_dictionary(spark, tmp_path):
    path, r, plain, past = f"{tmp_path}/t", random.Random(1), {}, []
    for version in range(1, 6):
        rows = {f"k{r.randrange(40)}": r.randrange(100) for _ in range(r.randrange(1, 12))}
        removed = {f"k{r.randrange(40)}" for _ in range(4)}
        gone = spark.createDataFrame([(x,) for x in removed], "k string") if version > 1 else None
        assert store.change(spark, path, table(spark, rows), "k", removed=gone, buckets=4) == version
        plain = {k: v for k, v in (plain | rows).items() if gone is None or k not in removed}
        past.append(plain)
        assert held(spark, path) == plain
    assert [held(spark, path, version=i + 1) for i in range(5)] == past
    some = [*list(plain)[:3], "no such key"]
    assert held(spark, path, keys=some) == {k: plain[k] for k in some if k in plain}


def test_a_change_is_whole_or_not_at_all(spark, tmp_path):
    path = f"{tmp_path}/t"
    store.change(spark, path, table(spark, {"a": 1, "b": 2}), "k", valid=F.col("v") > 0)
    for rows in ([("a", 5), ("c", -1)], [("a", 5), (None, 1)], [("a", 5), ("a", 6)], [("a", 5), ("c", None)]):
        with pytest.raises(store.Refused):
            store.change(spark, path, spark.createDataFrame(rows, SCHEMA), "k", valid=F.col("v") > 0)

    @F.udf("long")
    def dies(x):
        raise RuntimeError("dies here")

    with pytest.raises(Exception, match="dies here"):
        store.change(spark, path, table(spark, {"a": 5, "d": 7}).withColumn("v", dies("v")), "k")
    assert held(spark, path) == {"a": 1, "b": 2} and store.versions(spark, path) == [1]


def test_the_second_of_two_changes_is_refused(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/t"
    store.change(spark, path, table(spark, {"a": 1}), "k")
    before = store._manifest
    first = before(spark, path, None)
    store.change(spark, path, table(spark, {"a": 2}), "k")
    monkeypatch.setattr(store, "_manifest", lambda *_: first)  # a change that began before
    with pytest.raises(store.Conflict):
        store.change(spark, path, table(spark, {"a": 3}), "k")
    monkeypatch.setattr(store, "_manifest", before)
    assert held(spark, path) == {"a": 2}
    with pytest.raises(store.Conflict):
        store.change(spark, path, table(spark, {"a": 3}), "k", since=1)
    assert store.change(spark, path, table(spark, {"a": 3}), "k", since=2) == 3


def test_no_table_and_an_emptied_one(spark, tmp_path):
    path = f"{tmp_path}/t"
    with pytest.raises(FileNotFoundError):
        store.read(spark, path)
    store.change(spark, path, table(spark, {"a": 1}), "k")
    store.change(spark, path, table(spark, {"b": 1}).limit(0), "k", removed=table(spark, {"a": 1}).select("k"))
    assert held(spark, path) == {} and store.read(spark, path).columns == ["k", "v"]
