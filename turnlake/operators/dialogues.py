"""Turns of a dialogue as transitions of a state, folded in order of the turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnlake.operators.contracts import applied

#: States in which a dialogue is over.
CLOSED = ("completed", "cancelled", "ended")


def next_state(state: str, action: str, filled: int, wanted: int, guard: str | None = None) -> str:
    """The state after one turn. The first that holds decides: end, cancel, a closed state stays, a guard, a change, a confirmation, all fields set, else collecting."""
    if action == "end":
        return "ended"
    if action == "cancel":
        return "cancelled"
    if state in CLOSED:
        return state
    if guard:
        return guard
    if action == "change":
        return "collecting"
    if action == "confirm":
        return "completed" if state == "ready" else "ready" if filled >= wanted else "collecting"
    return "confirming" if filled >= wanted else "collecting"


def fields_after(turns: DataFrame, key: str, order: str, fields: str) -> DataFrame:
    """(key, order, collected): the map of fields collected up to each turn; of each field the last value that is not null."""
    names = turns.select(key, order, F.explode(fields).alias("name", "value")).where("value is not null")
    over = Window.partitionBy(key, "name").orderBy(order)
    spans = names.withColumn("until", F.lead(order).over(over))
    joined = turns.select(key, F.col(order).alias("_at")).join(spans, key, "left").where((F.col("_at") >= F.col(order)) & (F.col("until").isNull() | (F.col("_at") < F.col("until"))))
    found = joined.groupBy(key, "_at").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("collected"))
    return turns.select(key, order).join(found.withColumnRenamed("_at", order), [key, order], "left")


def merged(base: Column, later: Column) -> Column:
    """A map overridden by another: its values win, nulls keep what was there."""
    return applied(base, later)


def turn_numbers(turns: DataFrame, key: str, order: str, ends: Column) -> DataFrame:
    """turns with turn_count, from 1 within key, and over: whether this turn or one before it ended the dialogue."""
    over = Window.partitionBy(key).orderBy(order)
    return turns.withColumns({"turn_count": F.row_number().over(over), "over": F.max(F.coalesce(ends, F.lit(False)).cast("int")).over(over) == 1})


def staged_calls(events: DataFrame, actionable: Column) -> DataFrame:
    """events with skip_reason for the second stage: not_actionable, no_owner, or null for those that go on."""
    return events.withColumn("skip_reason", F.when(~F.coalesce(actionable, F.lit(False)), "not_actionable").when(F.col("owner").isNull(), "no_owner"))


def calibrated(samples: DataFrame, controls: DataFrame, key: str, order: str) -> tuple[DataFrame, DataFrame]:
    """(finalised, open): samples up to a key's last finalize or clear are consumed; finalised are those between the last clear and the last finalize.

    controls: key, order, kind (finalize or clear). A finalize with no sample since the one before gives nothing.
    """
    last = lambda kind: F.max(F.when(F.col("kind") == kind, F.col(order)))
    marks = controls.groupBy(key).agg(last("finalize").alias("_done"), F.max(order).alias("_end"))
    before = controls.join(marks.select(key, "_done"), key).where(F.col(order) < F.col("_done")).groupBy(key).agg(F.max(order).alias("_from"))
    joined = samples.join(marks, key, "left").join(before, key, "left")
    done = joined.where((F.col(order) < F.col("_done")) & (F.col("_from").isNull() | (F.col(order) > F.col("_from"))))
    return done.select(samples.columns), joined.where(F.col("_end").isNull() | (F.col(order) > F.col("_end"))).select(samples.columns)
