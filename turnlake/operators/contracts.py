"""Contracts of structured outputs as tables, and the rules that outputs break.

contract_fields (scenario, field, option) with a null option for free text; contract_actions (scenario, state, action);
contract_rules (scenario, action, allowed, required, require_any). All are small tables that the contract's author writes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlake.functions.documents import present_keys

#: Rows from which a contract is joined by shuffle and not sent to every task.
MOST_RULES = 100_000


def violations(outputs: DataFrame, fields: DataFrame, actions: DataFrame, rules: DataFrame) -> DataFrame:
    """(case_id, rule, detail) for each rule that an output breaks.

    outputs: case_id, scenario, state, action, fields map<string, string>. Rules: unknown_scenario, field_set (keys that are
    missing or not in the contract), option (a value outside its field's options), action (not allowed in the state),
    not_allowed, required and require_any (fields that the action may or must set). A contract of fewer than MOST_RULES rows
    goes to the outputs, which are not shuffled.
    """
    # distinct first: declared twice is declared once
    listed = fields.groupBy("scenario", "field").agg(F.collect_set("option").alias("options"))
    of_fields = listed.groupBy("scenario").agg(F.map_from_entries(F.collect_list(F.struct("field", "options"))).alias("options"))
    of_actions = actions.groupBy("scenario", "state").agg(F.collect_set("action").alias("actions"))
    of_rules = rules.select("scenario", "action", "allowed", "required", "require_any")
    small = F.broadcast if sum(x.limit(MOST_RULES).count() for x in (fields, actions, rules)) < MOST_RULES else lambda x: x
    joined = outputs.join(small(of_fields), "scenario", "left").join(small(of_actions), ["scenario", "state"], "left").join(small(of_rules), ["scenario", "action"], "left")
    names, keys, present = F.map_keys("options"), F.map_keys("fields"), present_keys(F.col("fields"))
    bad_option = F.filter(
        present, lambda k: (F.size(F.try_element_at(F.col("options"), k)) > 0) & ~F.array_contains(F.try_element_at(F.col("options"), k), F.try_element_at(F.col("fields"), k))
    )

    def broken(rule: str, found: Column) -> Column:
        return F.when(F.size(found) > 0, F.struct(F.lit(rule).alias("rule"), F.array_join(F.array_sort(found), ",").alias("detail")))

    one = lambda condition, value: F.when(condition, F.array(value))
    faults = F.array_compact(
        F.array(
            broken("unknown_scenario", one(F.col("options").isNull(), F.col("scenario"))),
            broken("field_set", F.array_union(F.array_except(names, keys), F.array_except(keys, names))),
            broken("option", bad_option),
            broken("action", one(~F.coalesce(F.array_contains("actions", F.col("action")), F.lit(False)), F.coalesce("action", F.lit("")))),
            broken("not_allowed", F.array_except(present, F.col("allowed"))),
            broken("required", F.array_except(F.col("required"), present)),
            broken("require_any", one(F.col("require_any") & (F.size(F.array_intersect(present, F.col("allowed"))) == 0), F.col("action"))),
        )
    )
    return joined.select("case_id", F.explode(faults).alias("x")).select("case_id", "x.rule", "x.detail")


def applied(current: Column, new: Column) -> Column:
    """The state's fields after a turn: new values win, nulls keep what was there."""
    return F.map_zip_with(current, new, lambda k, a, b: F.coalesce(b, a))


def applied_turn(current: Column, new: Column, action: Column, change_field: Column, reset: str = "reset", change: str = "change") -> Column:
    """The state's fields after a turn of that action: a reset takes all back, a change sets its one field, even to nothing, and any other turn adds what it sets."""
    none = F.transform_values(current, lambda k, v: F.lit(None).cast("string"))
    targeted = F.transform_values(current, lambda k, v: F.when(k == change_field, F.try_element_at(new, k)).otherwise(v))
    return F.when(action == reset, none).when((action == change) & change_field.isNotNull(), targeted).otherwise(applied(current, new))


def delta_relations(current: Column, new: Column) -> Column:
    """field->relation of each field: same, set, changed or cleared; sorted."""
    relation = lambda k, a, b: F.when(a.eqNullSafe(b), "same").when(a.isNull(), "set").when(b.isNull(), "cleared").otherwise("changed")
    return F.array_sort(F.transform(F.map_entries(F.map_zip_with(current, new, relation)), lambda x: F.concat_ws("->", x["key"], x["value"])))


def context_class(current: Column, guards: dict[str, str] | None = None) -> Column:
    """empty, partial or complete: how many of a state's fields are set; guarded_ and the field's name where one of guards has its value."""
    guarded = [F.when(F.try_element_at(current, F.lit(name)) == value, f"guarded_{name}") for name, value in (guards or {}).items()]
    given = F.size(present_keys(current))
    return F.coalesce(*guarded, F.when(given == 0, "empty").when(given < F.size(current), "partial").otherwise("complete"))


def alternative_relation(offered: Column, selected: Column) -> Column:
    """no_offers, offers_unselected, selected_offer or selected_other: how a selected value stands to those offered."""
    return (
        F.when(selected.isNotNull(), F.when(F.coalesce(F.array_contains(offered, selected), F.lit(False)), "selected_offer").otherwise("selected_other"))
        .when(F.coalesce(F.size(offered), F.lit(0)) < 1, "no_offers")
        .otherwise("offers_unselected")
    )


def action_field_keys(rules: DataFrame) -> DataFrame:
    """(scenario, value) of the fields that actions may set, as action->field."""
    return rules.select("scenario", "action", F.explode("allowed").alias("field")).select("scenario", F.concat_ws("->", "action", "field").alias("value")).distinct()


def union_of(*lists: Column) -> Column:
    """Distinct values of several lists, in order of first occurrence; null lists count as empty."""
    return F.array_distinct(F.flatten(F.array(*[F.coalesce(x, F.expr("cast(array() as array<string>)")) for x in lists])))


def attempt_fault(attempts: Column) -> Column:
    """Why a list of attempts is not well formed, else null: count (1 or 2), several_valid, valid_not_last."""
    valid = F.filter(attempts, lambda x: x["valid"])
    return (
        F.when(~F.coalesce(F.size(attempts).between(1, 2), F.lit(False)), "count").when(F.size(valid) > 1, "several_valid").when((F.size(valid) == 1) & ~F.element_at(attempts, -1)["valid"], "valid_not_last")
    )
