"""Calibration of a key's measurements as keyed state on a stream, and the same over a whole table.

Samples of a key are gathered until a finalize, which gives one row and begins anew, or a clear, which drops them. A key
whose samples have rested for longer than a limit forgets them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from turnlake.operators import scans

MEASURES = ("pitch", "jitter", "shimmer")
#: What a finalize gives: the key, its place among the key's rows, samples, and mean and deviation of each measure.
SCHEMA = "user_key string, seq long, samples long, " + ", ".join(f"{x}_mean double, {x}_std double" for x in MEASURES)
STATE = "seq long, arrived long, pitch double, jitter double, shimmer double"


class Calibration(StatefulProcessor):
    """Samples of a key as list state, kept until they are finalized, cleared, or have rested for rest_ms (None: for ever)."""

    def __init__(self, rest_ms: int | None):
        self.rest_ms = rest_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.samples = handle.getListState("samples", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = 0 if self.rest_ms is None else timerValues.getCurrentProcessingTimeInMs()
        held = [tuple(x) for x in self.samples.get()] if self.samples.exists() else []
        done = []
        for row in pd.concat(list(rows)).sort_values("seq").itertuples():
            if row.kind == "sample":
                held.append((row.seq, now, row.pitch, row.jitter, row.shimmer))
            else:
                if row.kind == "finalize" and held:
                    done.append((key[0], row.seq, *summary([x[2:] for x in held])))
                held = []
        self.samples.clear()
        if held:
            self.samples.put(held)
        if self.rest_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if held:
                self.handle.registerTimer(now + self.rest_ms)
        yield pd.DataFrame(done, columns=[x.split()[0] for x in SCHEMA.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.samples.clear()
        yield pd.DataFrame([], columns=[x.split()[0] for x in SCHEMA.split(", ")])

    def close(self) -> None:
        pass


def summary(samples: list[tuple[float, ...]]) -> tuple:
    """Count, and mean and sample deviation (0 for one sample) of each measure, to nine decimals, so that the order of sums does not show."""
    table = pd.DataFrame(samples, columns=MEASURES)
    spread = table.std(ddof=1).fillna(0.0) if len(table) > 1 else table.mean() * 0
    return (len(table), *(round(float(x), 9) for name in MEASURES for x in (table[name].mean(), spread[name])))


def stream_calibrations(events: DataFrame, rest_ms: int | None = 24 * 3600 * 1000) -> DataFrame:
    """A stream (user_key string, seq long, kind string: sample, finalize or clear, and MEASURES) as one row (SCHEMA) for each finalize that has samples.

    Events of a key are taken by seq within a micro-batch, and micro-batches in order of arrival, so any cut of a key's
    ordered events into micro-batches gives the same rows. A stream with timers, that is with rest_ms, runs until it is
    stopped: micro-batches without data go on, so that samples are forgotten in time.
    """
    return events.groupBy("user_key").transformWithStateInPandas(Calibration(rest_ms), SCHEMA, "append", "None" if rest_ms is None else "ProcessingTime")


def calibrations(events: DataFrame) -> DataFrame:
    """What stream_calibrations() gives, over a whole table: the samples between two marks (finalize or clear) are those that have as many marks before them.

    A key with most of the rows is cut into blocks. Samples with a null measure count, and the measure's mean is over the others.
    """
    mark = F.col("kind").isin("finalize", "clear").cast("long")
    numbered = scans.with_running_sum(scans.in_blocks(events, "user_key", F.col("seq")), "user_key", ["seq"], "_marks", mark)
    sums = numbered.where("kind = 'sample'").groupBy("user_key", (F.col("_marks") + 1).alias("_marks"))
    rounded = lambda x: F.round(x, 9)
    parts: list[Column] = [F.count("*").alias("samples")]
    for x in MEASURES:
        parts += [rounded(F.avg(x)).alias(f"{x}_mean"), rounded(F.coalesce(F.stddev_samp(x), F.lit(0.0))).alias(f"{x}_std")]
    ends = numbered.where("kind = 'finalize'").select("user_key", "_marks", "seq")
    return ends.join(sums.agg(*parts), ["user_key", "_marks"]).select(*[x.split()[0] for x in SCHEMA.split(", ")])
