"""Calibrations on a stream, cut in any way, against the whole table and a plain fold."""

from __future__ import annotations

import random
import statistics

import pytest

from turnlake.streaming import calibration

SCHEMA = "user_key string, seq long, kind string, pitch double, jitter double, shimmer double"


def events(seed, n=120):
    r = random.Random(seed)
    kinds = ["sample"] * 6 + ["finalize", "clear"]
    return [(f"u{r.randrange(4)}", i, kind := r.choice(kinds), *(round(r.uniform(1, 200), 3) if kind == "sample" else None for _ in range(3))) for i in range(n)]


def plain(rows):
    held, out = {}, []
    for key, seq, kind, *measures in rows:
        if kind == "sample":
            held.setdefault(key, []).append(measures)
            continue
        own = held.pop(key, [])
        if kind == "finalize" and own:
            stats = [round(f(x), 9) for x in zip(*own, strict=True) for f in (statistics.fmean, lambda v: statistics.stdev(v) if len(v) > 1 else 0.0)]
            out.append((key, seq, len(own), *stats))
    return sorted(out)


def close(a, b):
    return len(a) == len(b) and all(x[:3] == y[:3] and all(abs(p - q) < 1e-8 for p, q in zip(x[3:], y[3:], strict=True)) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("cuts", [(120,), (1, 41, 120)])
def test_a_stream_gives_the_rows_of_the_table(spark, tmp_path, cuts):
    rows, begun = events(2), 0
    (tmp_path / "in").mkdir()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = calibration.stream_calibrations(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), None)
    name = f"calibrations_{len(cuts)}"
    for end in cuts:
        spark.createDataFrame(rows[begun:end], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run = stream.writeStream.format("parquet").option("path", f"{tmp_path}/{name}").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        assert run.awaitTermination(120)
        begun = end
    found = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/{name}").collect()))
    assert close(found, plain(rows)) and len({x[0] for x in found}) < len(found)


def test_the_table_is_a_plain_fold(spark):
    rows = events(3, 900)
    assert close(sorted(map(tuple, calibration.calibrations(spark.createDataFrame(rows, SCHEMA)).collect())), plain(rows))


def test_samples_that_rest_too_long_are_forgotten(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = calibration.stream_calibrations(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), 1)
    for rows in ([("u", 1, "sample", 1.0, 1.0, 1.0)], [("u", 2, "sample", 3.0, 3.0, 3.0), ("u", 3, "finalize", None, None, None)]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
        run.awaitTermination(20)
        run.stop()
    (found,) = spark.read.parquet(f"{tmp_path}/out").collect()
    assert (found.samples, found.pitch_mean) == (1, 3.0)
