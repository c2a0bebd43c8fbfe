"""Incremental baselines, dialogue states and counters on streams, with keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from turnlake.operators.baselines import rounded_step
from turnlake.operators.dialogues import next_state


class WelfordState(StatefulProcessor):
    """Count, mean and sum of squares of a key; the mean is rounded to six decimals after each sample and goes on from there."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("baseline", "n long, mean double, m2 double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, mean, m2 = self.state.get() if self.state.exists() else (0, 0.0, 0.0)
        values = pd.concat(list(rows)).sort_values("seq")["value"]
        for x in values.tolist():
            n, mean, m2 = rounded_step(n, mean, m2, x)
        self.state.update((n, mean, m2))
        yield pd.DataFrame({"user_key": [key[0]], "samples": [n], "mean": [mean], "std": [round((m2 / (n - 1)) ** 0.5, 6) if n > 1 else 0.0]})

    def close(self) -> None:
        pass


def stream_baselines(measurements: DataFrame) -> DataFrame:
    """A stream (user_key string, seq long, value double) as baselines: the key's new baseline after each micro-batch.

    Values of one key in one micro-batch are taken by seq; across micro-batches in order of arrival.
    """
    return measurements.groupBy("user_key").transformWithStateInPandas(WelfordState(), "user_key string, samples long, mean double, std double", "update", "None")


class DialogueState(StatefulProcessor):
    """State and collected fields of a dialogue; see operators.dialogues.next_state."""

    def __init__(self, wanted: int):
        self.wanted = wanted

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("dialogue", "state string, fields string, turns long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, fields, turns = self.state.get() if self.state.exists() else ("greeting", "", 0)
        held = set(filter(None, fields.split("\n")))
        whole = pd.concat(list(rows)).sort_values("seq")
        for action, field in zip(whole["action"], whole["field"], strict=True):
            if field:
                held.discard(field) if action == "change" else held.add(field)
            state = next_state(state, action, len(held), self.wanted)
            turns += 1
        self.state.update((state, "\n".join(sorted(held)), turns))
        yield pd.DataFrame({"dialogue": [key[0]], "turns": [turns], "filled": [len(held)], "state": [state]})

    def close(self) -> None:
        pass


def stream_dialogues(turns: DataFrame, wanted: int) -> DataFrame:
    """A stream (dialogue string, seq long, action string, field string or null) as states: a dialogue's new state after each micro-batch."""
    return turns.groupBy("dialogue").transformWithStateInPandas(DialogueState(wanted), "dialogue string, turns long, filled int, state string", "update", "None")


def stream_counts(events: DataFrame, labels: list[str]) -> DataFrame:
    """Running counts of a stream of events by labels, for the output mode update or complete."""
    return events.groupBy(*labels).count()
