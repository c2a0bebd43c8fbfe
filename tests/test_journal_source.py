"""Journals written once and read strictly, in batches and as streams."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from turnlake.sources import journal


@pytest.fixture(scope="module")
def source(spark):
    spark.dataSource.register(journal.JournalSource)
    return spark


def written(rows, path, protocol="p1"):
    rows.write.format("journal").option("path", path).option("protocol", protocol).mode("append").save()


def entries(spark, path):
    return sorted((json.loads(r.entry) for r in spark.read.format("journal").load(path).collect()), key=repr)


def test_what_is_written_is_read(source, tmp_path):
    path = f"{tmp_path}/j"
    written(source.range(20).select("id", F.when(F.col("id") % 2 == 0, F.lit("é\n\"x")).alias("t")).repartition(4), path)
    assert entries(source, path) == sorted(({"id": i, "t": 'é\n"x' if i % 2 == 0 else None} for i in range(20)), key=repr)
    assert source.read.format("journal").load(path).select("part").distinct().count() == 4
    with pytest.raises(Exception, match="written once"):
        written(source.range(1), path)
    assert len(entries(source, path)) == 20


def test_an_empty_journal(source, tmp_path):
    written(source.range(0), f"{tmp_path}/j")
    assert entries(source, f"{tmp_path}/j") == []
    with pytest.raises(Exception, match="no begin mark"):
        entries(source, f"{tmp_path}/none")


def test_a_write_that_dies_leaves_no_entry(source, tmp_path):
    path = f"{tmp_path}/j"

    @F.udf("long")
    def dies(x):
        if x == 7:
            raise RuntimeError("dies here")
        return x

    with pytest.raises(Exception, match="dies here"):
        written(source.range(8).repartition(4).select(dies("id").alias("id")), path)
    assert not [x for x in journal.names_in(path) if x.startswith(journal.COMMIT)]
    assert entries(source, path) == []
    journal.write_part(path, "p1", iter(source.range(3).collect()))  # a task that outlives its driver
    assert entries(source, path) == []


def test_changed_parts_are_refused(source, tmp_path):
    path = f"{tmp_path}/j"
    written(source.range(3).coalesce(1), path)
    (part,) = tmp_path.glob("j/part-*")
    part.write_text(part.read_text().replace('"id": 1', '"id": 9'))
    with pytest.raises(Exception, match="not as it was committed"):
        entries(source, path)


def test_endless_numbers_are_refused(source, tmp_path):
    with pytest.raises(Exception, match="Out of range float"):
        written(source.range(1).select(F.lit(float("nan")).alias("x")), f"{tmp_path}/j")


def test_a_stream_of_commits(source, tmp_path):
    path, into = f"{tmp_path}/j", f"{tmp_path}/out"
    (tmp_path / "in").mkdir()

    def run():
        rows = source.readStream.schema("id long").parquet(f"{tmp_path}/in")
        rows.writeStream.format("journal").option("path", path).option("protocol", "p2").option("checkpointLocation", f"{tmp_path}/a").trigger(availableNow=True).start().awaitTermination(60)
        found = source.readStream.format("journal").option("path", path).load()
        found.writeStream.format("parquet").option("path", into).option("checkpointLocation", f"{tmp_path}/b").trigger(availableNow=True).start().awaitTermination(60)

    for i in range(2):
        source.range(10 * i, 10 * i + 5).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run()
    want = [{"id": i} for i in (0, 1, 2, 3, 4, 10, 11, 12, 13, 14)]
    assert entries(source, path) == sorted(want, key=repr)
    assert sorted((json.loads(r.entry) for r in source.read.parquet(into).collect()), key=repr) == sorted(want, key=repr)
    before = journal.commits(path)
    journal.commit(path, "p2", [], before[0]["batch"])  # a batch told again
    assert journal.commits(path) == before
