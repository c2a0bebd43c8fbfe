"""Machines: a long dialogue cut into blocks, rule by rule."""

from __future__ import annotations

import random

import pytest

from turnlake.operators import machines

SCHEMA = "d string, n long, action string, gives array<string>, takes array<string>, outcome string"


def plain(turns, machine):
    """Rules one after the other, by names."""
    state, held, out = machine.states[0], set(), []
    for _, n, action, gives, takes, outcome in turns:
        held = (held | set(gives or ())) - set(takes or ())
        for r in machine.rules:
            whole = held == set(machine.fields)
            if (not r.states or state in r.states) and (not r.actions or action in r.actions) and (r.full is None or r.full == whole) and (r.outcome is None or r.outcome == outcome) and not held & set(r.lacks):
                state, held = r.then or state, held - set(r.clears)
                break
        out.append((n, state, [x for x in machine.fields if x in held]))
    return out


@pytest.mark.parametrize("machine", [machines.DIALOGUE, machines.RESTAURANT, machines.APPOINTMENT, machines.CLINIC], ids=lambda m: m.name)
def test_blocks_of_a_long_dialogue_are_one_walk(spark, machine):
    r = random.Random(machine.name)
    actions = sorted({a for rule in machine.rules for a in rule.actions} - {"end", "cancel"}) + ["tell", "tell", None]
    outcomes = sorted({rule.outcome for rule in machine.rules if rule.outcome}) + [None]
    some = lambda p: r.sample(machine.fields, 1) if r.random() < p else r.choice([[], None])
    turns = [("hot" if i % 9 else f"k{i % 4}", i, r.choice(actions), some(0.6), some(0.1), r.choice(outcomes)) for i in range(900)] + [(None, 0, "tell", ["nothing"], None, None)]
    want = {key: plain([t for t in turns if t[0] == key], machine) for key in {t[0] for t in turns}}
    assert len({state for _, state, _ in want["hot"]}) >= 3
    for hot in ((), (50, 8)):
        found = machines.folded(spark.createDataFrame(turns, SCHEMA), machine, "d", "n", *hot).collect()
        assert {key: sorted((x.n, x.state, x.filled) for x in found if x.d == key) for key in want} == want


def test_an_empty_table_and_the_rules_as_rows(spark):
    assert machines.folded(spark.createDataFrame([], SCHEMA), machines.CLINIC, "d", "n").count() == 0
    rows = machines.RESTAURANT.table(spark)
    assert rows.where("state = 'closing' and action = 'end_call'").select("next").first()[0] == "END"
