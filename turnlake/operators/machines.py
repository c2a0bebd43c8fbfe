"""Dialogue machines as tables of rules, and dialogues folded through them in parallel.

A machine has states, fields that turns fill, and rules in order of precedence. A turn is a symbol: an action, the fields
that it gives or takes back, and an outcome from outside (a lookup's answer, a guard). Together with the set of filled
fields a machine has finitely many configurations, so each symbol is a map of configurations to configurations. Such maps
compose associatively: blocks of a long dialogue are composed on their own, their compositions in order give every block
the configuration that it begins in, and then all blocks are walked at once. Nothing needs a whole dialogue in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.operators import scans


@dataclass(frozen=True)
class Rule:
    """When a turn with one of actions (none: any) meets one of states (none: any), full says whether all fields must be set, lacks which must not be, outcome what must have been answered; then is the next state (none: as before)."""

    states: tuple[str, ...] = ()
    actions: tuple[str, ...] = ()
    then: str | None = None
    full: bool | None = None
    outcome: str | None = None
    clears: tuple[str, ...] = ()
    lacks: tuple[str, ...] = ()


@dataclass(frozen=True)
class Machine:
    """States, the first being where a dialogue begins, fields, and rules of which the first that fits decides; a turn that none fits changes fields only."""

    name: str
    states: tuple[str, ...]
    fields: tuple[str, ...]
    rules: tuple[Rule, ...]
    maps: dict = field(default_factory=dict, compare=False, repr=False)

    def mask(self, names) -> int:
        return sum(1 << i for i, x in enumerate(self.fields) if names is not None and x in names)

    def step(self, action: str | None, gives: int, takes: int, outcome: str | None) -> np.ndarray:
        """The map of a symbol: the configuration after it for each configuration, state * 2^fields + filled fields."""
        symbol = (action, gives, takes, outcome)
        if symbol not in self.maps:
            size = 1 << len(self.fields)
            out = np.empty(len(self.states) * size, dtype=np.int32)
            for at, state in enumerate(self.states):
                for held in range(size):
                    filled = (held | gives) & ~takes
                    rule = next((r for r in self.rules if self.fits(r, state, action, filled, outcome)), Rule())
                    then = self.states.index(rule.then) if rule.then else at
                    out[at * size + held] = then * size + (filled & ~self.mask(rule.clears))
            self.maps[symbol] = out
        return self.maps[symbol]

    def fits(self, rule: Rule, state: str, action: str | None, filled: int, outcome: str | None) -> bool:
        whole = filled == (1 << len(self.fields)) - 1
        return (not rule.states or state in rule.states) and (not rule.actions or action in rule.actions) and rule.full in (None, whole) and rule.outcome in (None, outcome) and not filled & self.mask(rule.lacks)

    def table(self, spark: SparkSession) -> DataFrame:
        """The rules as rows (place, state, action, full, outcome, next, clears, lacks), one for each state and action that a rule names; null stands for any, or for staying."""
        rows = [(i, s, a, r.full, r.outcome, r.then, list(r.clears), list(r.lacks)) for i, r in enumerate(self.rules, 1) for s in r.states or (None,) for a in r.actions or (None,)]
        return spark.createDataFrame(rows, "place int, state string, action string, full boolean, outcome string, next string, clears array<string>, lacks array<string>")


def folded(turns: DataFrame, machine: Machine, key: str, order: str, hot_rows: int = scans.HOT_ROWS, blocks: int = scans.BLOCKS) -> DataFrame:
    """(key, order, state, filled) after each turn; filled lists the fields that are set, in the machine's order.

    turns: key, order (a number), action, gives and takes (arrays of fields), outcome; nulls give nothing. A turn that
    takes back a field that it gives leaves it empty. Turns of one order are taken by action, then by what they give. A
    null key is one dialogue; an empty table gives an empty one.
    """
    of = dict(turns.dtypes)
    slim = scans.in_blocks(turns.select(key, order, "action", "gives", "takes", "outcome"), key, F.col(order), hot_rows, blocks)
    tie = ["action", F.to_json(F.struct("gives", "takes")), "outcome"]
    dealt = slim.repartition(key, scans.BLOCK).sortWithinPartitions(key, scans.BLOCK, order, *tie)
    size, n = 1 << len(machine.fields), len(machine.states)

    def runs(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[bool, int, pd.DataFrame]]:
        """Rows of one key and block in a row, and whether they go on from the frame before."""
        last = None
        for frame in frames:
            marks = list(zip(frame[key].astype(object).where(frame[key].notna(), None), frame[scans.BLOCK], strict=True))
            cuts = [0, *[i for i in range(1, len(marks)) if marks[i] != marks[i - 1]], len(marks)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if j > i:
                    yield marks[i] == last, i, frame.iloc[i:j]
                    last = marks[i]

    def symbols(frame: pd.DataFrame) -> Iterator[np.ndarray]:
        plain = lambda x: None if x is None or x is pd.NA or x != x else x
        for action, gives, takes, outcome in zip(frame["action"], frame["gives"], frame["takes"], frame["outcome"], strict=True):
            yield machine.step(plain(action), machine.mask(gives), machine.mask(takes), plain(outcome))

    def composed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """One row (key, block, map) for each block."""
        head, whole = None, None
        for goes_on, _, part in runs(frames):
            if not goes_on:
                if head is not None:
                    yield head.assign(map=[whole.tobytes()])
                head, whole = part[[key, scans.BLOCK]].iloc[:1], np.arange(n * size, dtype=np.int32)
            for step in symbols(part):
                whole = step[whole]
        if head is not None:
            yield head.assign(map=[whole.tobytes()])

    def begun(rows: pd.DataFrame) -> pd.DataFrame:
        """The configuration in which each block of a key begins."""
        rows = rows.sort_values(scans.BLOCK)
        at, out = 0, []
        for data in rows["map"]:
            out.append(at)
            at = int(np.frombuffer(data, np.int32)[at])
        return rows[[key, scans.BLOCK]].assign(begin=out)

    def walked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The configuration after each turn."""
        at = 0
        for goes_on, _, part in runs(frames):
            if not goes_on:
                first = part["begin"].iloc[0]
                at = 0 if pd.isna(first) else int(first)
            states, filled = [], []
            for step in symbols(part):
                at = int(step[at])
                states.append(machine.states[at // size])
                filled.append([x for i, x in enumerate(machine.fields) if at % size >> i & 1])
            yield pd.DataFrame({key: part[key], order: part[order], "state": states, "filled": filled})

    schema = f"{key} {of[key]}, {order} {of[order]}, state string, filled array<string>"
    if getattr(slim, "in_one_block", False):
        return dealt.withColumn("begin", F.lit(None).cast("int")).mapInPandas(walked, schema)
    several = F.broadcast(slim.groupBy(key).agg(F.max(scans.BLOCK).alias("_last")).where("_last > 0").select(key))
    hot = dealt.join(several, key, "left_semi").repartition(key, scans.BLOCK).sortWithinPartitions(key, scans.BLOCK, order, *tie)
    maps = hot.mapInPandas(composed, f"{key} {of[key]}, {scans.BLOCK} int, map binary")
    begins = maps.groupBy(key).applyInPandas(begun, f"{key} {of[key]}, {scans.BLOCK} int, begin int")
    placed = slim.join(F.broadcast(begins), [key, scans.BLOCK], "left").repartition(key, scans.BLOCK).sortWithinPartitions(key, scans.BLOCK, order, *tie)
    return placed.mapInPandas(walked, schema)


def symbol(action: Column, gives: Column, takes: Column | None = None, outcome: Column | None = None) -> list[Column]:
    """The columns that folded() reads; null arrays give and take nothing."""
    none = F.expr("cast(array() as array<string>)")
    return [action.alias("action"), F.coalesce(gives, none).alias("gives"), (none if takes is None else F.coalesce(takes, none)).alias("takes"), (F.lit(None).cast("string") if outcome is None else outcome).alias("outcome")]


# States, actions and fields of the dialogues that the tables describe.

#: A plain dialogue that collects fields; an outcome is a guard's state.
DIALOGUE = Machine(
    "dialogue",
    ("greeting", "collecting", "confirming", "ready", "completed", "cancelled", "ended", "danger"),
    ("size", "color", "place"),
    (
        Rule(actions=("end",), then="ended"),
        Rule(actions=("cancel",), then="cancelled"),
        Rule(states=("completed", "cancelled", "ended")),
        Rule(outcome="danger", then="danger"),
        Rule(actions=("change",), then="collecting"),
        Rule(states=("ready",), actions=("confirm",), then="completed"),
        Rule(actions=("confirm",), full=True, then="ready"),
        Rule(full=True, then="confirming"),
        Rule(then="collecting"),
    ),
)
_COLLECTING, _CONFIRMING = "collecting_reservation_info", "confirming_info"
#: A table is reserved: details, a lookup whose answer is the outcome, another time, an end. An offered time that is chosen arrives with the outcome offered.
RESTAURANT = Machine(
    "restaurant",
    ("greeting", _COLLECTING, _CONFIRMING, "checking_availability", "reservation_available", "reservation_unavailable", "reservation_confirmed", "closing", "END"),
    ("date", "time", "party_size", "user_name"),
    (
        Rule(("checking_availability",), outcome="available", then="reservation_available"),
        Rule(("checking_availability",), outcome="unavailable", then="reservation_unavailable"),
        Rule((_CONFIRMING,), ("confirm",), then="checking_availability"),
        Rule((_CONFIRMING,), ("change_info",), then=_COLLECTING, clears=("date", "time", "party_size", "user_name")),
        Rule((_CONFIRMING,), ("change_date", "change_time", "change_party_size", "change_user_name"), full=True, then=_CONFIRMING),
        Rule((_CONFIRMING,), ("change_date", "change_time", "change_party_size", "change_user_name"), then=_COLLECTING),
        Rule(("reservation_available",), ("confirm_reservation",), then="reservation_confirmed"),
        Rule(("reservation_available", "reservation_unavailable"), ("ask_other_time",), then=_COLLECTING, clears=("time",)),
        Rule(("reservation_unavailable",), ("select_alternative_time",), outcome="offered", then="reservation_available"),
        Rule(("reservation_unavailable",), ("change_date",), full=True, then=_CONFIRMING),
        Rule(("reservation_unavailable",), ("change_date",), then=_COLLECTING),
        Rule(("reservation_confirmed",), ("go_closing",), then="closing"),
        Rule(("closing",), ("end_call",), then="END"),
        Rule((_CONFIRMING, "reservation_available", "reservation_unavailable", "reservation_confirmed", "closing", "END")),
        Rule(full=True, then=_CONFIRMING),
        Rule(then=_COLLECTING),
    ),
)
#: An appointment with a professor.
APPOINTMENT = Machine(
    "appointment",
    ("greeting", "collecting_appointment_info", _CONFIRMING, "appointment_confirmed", "closing", "END"),
    ("purpose", "date", "time", "user_name"),
    (
        Rule((_CONFIRMING,), ("confirm_info",), then="appointment_confirmed"),
        Rule((_CONFIRMING,), ("change_purpose", "change_date", "change_time", "change_user_name"), full=False, then="collecting_appointment_info"),
        Rule(("appointment_confirmed",), ("go_closing",), then="closing"),
        Rule(("closing",), ("end_call",), then="END"),
        Rule((_CONFIRMING, "appointment_confirmed", "closing", "END")),
        Rule(full=True, then=_CONFIRMING),
        Rule(then="collecting_appointment_info"),
    ),
)

_ASKED = ("department", "date", "time", "user_name")


def _asking(states: tuple[str, ...], actions: tuple[str, ...] = (), fields: tuple[str, ...] = _ASKED) -> tuple[Rule, ...]:
    """Rules that ask for the first field that is lacking, in order, or else confirm; without a date no time is kept after a change of date."""
    dated = [Rule(states, actions, f"asking_{x}", lacks=(x, "date"), clears=("time",)) for x in fields[:2]] if actions == ("change_date",) else []
    return (*dated, *(Rule(states, actions, f"asking_{x}", lacks=(x,)) for x in fields), Rule(states, actions, _CONFIRMING))


#: A visit to a clinic, asked for field by field; the field purpose is set once the caller wants to reserve.
CLINIC = Machine(
    "clinic",
    (
        "greeting", "asking_purpose", *(f"asking_{x}" for x in _ASKED), _CONFIRMING, "checking_availability", "reservation_available", "reservation_unavailable",
        "suggest_alternative", "reservation_confirmed", "closing", "END",
    ),
    ("purpose", *_ASKED),
    (
        Rule(("closing",), ("end_call",), "END"),
        Rule((_CONFIRMING,), ("confirm_reservation_info",), "checking_availability"),
        *_asking((_CONFIRMING, "reservation_unavailable", "suggest_alternative"), ("change_date",)),
        *_asking((_CONFIRMING,), ("change_department", "change_time", "change_user_name")),
        Rule(("greeting", "asking_purpose"), then="asking_purpose", lacks=("purpose",)),
        *_asking(("greeting", "asking_purpose")),
        *(rule for i, x in enumerate(_ASKED) for rule in _asking((f"asking_{x}",), fields=_ASKED[i:])),
        Rule(("checking_availability",), then="reservation_available", outcome="available"),
        Rule(("checking_availability",), then="reservation_unavailable", outcome="unavailable"),
        Rule(("reservation_available",), ("confirm_available_time",), "reservation_confirmed"),
        Rule(("reservation_available", "reservation_unavailable", "suggest_alternative"), ("ask_other_time",), "suggest_alternative"),
        Rule(("reservation_unavailable", "suggest_alternative"), ("select_alternative_time",), "reservation_confirmed", outcome="offered"),
        Rule(("reservation_confirmed",), ("go_closing",), "closing"),
    ),
)
