"""Joins of labels with what they are made from: sentences with drafts, spans with owners, titles with flows; and what a split needs before it is scored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlake.functions.text import scenario_key
from turnlake.operators import coverage, ledgers


def linked(labels: DataFrame, spans: DataFrame, owners: DataFrame, case: str, event: str) -> tuple[DataFrame, DataFrame]:
    """(labels with their span and owner, keys that one of the three sides lacks): all three by case and event."""
    keys = [case, event]
    missing = None
    for name, side in (("label", labels), ("span", spans), ("owner", owners)):
        part = side.select(*keys, F.lit(name).alias("side")).distinct()
        missing = part if missing is None else missing.unionByName(part)
    lacking = missing.groupBy(*keys).agg(F.array_sort(F.collect_set("side")).alias("sides")).where(F.size("sides") < 3)
    return labels.join(spans, keys).join(owners, keys), lacking


def registered(asked: DataFrame, registry: DataFrame, category: str, title: str, value: str) -> DataFrame:
    """asked with value: that of the registry's entry with the same category and title in canonical form, null where there is none."""
    flows = registry.select(scenario_key(F.col(category), F.col(title)).alias("_key"), F.col(value)).groupBy("_key").agg(F.min(value).alias(value))
    return asked.withColumn("_key", scenario_key(F.col(category), F.col(title))).join(flows, "_key", "left").drop("_key")


def draft_faults(sentences: DataFrame, drafts: DataFrame, key: str, text: Column, known: DataFrame, valid: Column) -> DataFrame:
    """(key, fault): sentences without a draft or drafts without a sentence (missing, unused), sentences whose text was used before (known, by digest), drafts that break their contract (invalid)."""
    sets = ledgers.unassigned(sentences, drafts, key)
    used = sentences.withColumn("digest", F.sha2(text, 256)).join(known.select("digest").distinct(), "digest", "left_semi").select(key, F.lit("known").alias("fault"))
    broken = drafts.where(~F.coalesce(valid, F.lit(False))).select(key, F.lit("invalid").alias("fault"))
    return sets.unionByName(used).unionByName(broken)


def eligible_events(cases: DataFrame, events: str, actionable: Column) -> DataFrame:
    """One row (the case's columns, place, e) for each event of a case that can be acted on and has an owner; actionable is a condition on e."""
    each = cases.select(*[x for x in cases.columns if x != events], F.posexplode(events).alias("place", "e"))
    return each.where(F.coalesce(actionable, F.lit(False)) & F.col("e.owner").isNotNull())


def tally_faults(rows: DataFrame, keys: list[str], expected: DataFrame) -> DataFrame:
    """(keys, found, expected) where groups do not have the number of rows that was fixed beforehand."""
    found = rows.groupBy(*keys).agg(F.count("*").alias("found"))
    joined = found.join(expected.select(*keys, "expected"), keys, "full")
    return joined.withColumns({x: F.coalesce(x, F.lit(0)) for x in ("found", "expected")}).where("found <> expected")


def qualified(cases: DataFrame, required: DataFrame, split: str) -> tuple[DataFrame, DataFrame]:
    """(the split's cases, what keeps them from being scored): a split qualifies where coverage.issues() is empty."""
    own = cases.where(F.col("split") == split)
    return own, coverage.issues(required, own)


def slot_faults(cases: DataFrame, slots: list[str], required: DataFrame) -> DataFrame:
    """(slots, cases, fault) of a design that wants one case for each slot: repeated, missing, unplanned."""
    held = cases.groupBy(*slots).agg(F.count("*").alias("cases"))
    joined = held.join(required.select(*slots, F.lit(True).alias("_wanted")).distinct(), slots, "full").withColumn("cases", F.coalesce("cases", F.lit(0)))
    fault = F.when(F.col("_wanted").isNull(), "unplanned").when(F.col("cases") == 0, "missing").when(F.col("cases") > 1, "repeated")
    return joined.select(*slots, "cases", fault.alias("fault")).where("fault is not null")
