"""What a set of labelled cases covers of what its contracts ask for.

Obligations and covered keys are rows (scenario, dimension, value). Contracts are small tables: contract_actions (scenario,
state, action), contract_fields (scenario, field, option; a null option is free text), contract_intents (scenario, intent),
contract_deltas (scenario, field, relation). Cases: case_id, scenario, state, action, intent, change_field, fields (map of
names to accepted values, null where the field must be absent), current (map of names to values), tags.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnlake.functions.documents import canonical_map
from turnlake.operators.contracts import context_class, delta_relations
from turnlake.session import checkpointed

KEYS = ["scenario", "dimension", "value"]
NO_INTENT = "<null>"


def _keys(rows: DataFrame, scenario: Column | str, dimension: str, value: Column) -> DataFrame:
    return rows.select(F.col(scenario) if isinstance(scenario, str) else scenario, F.lit(dimension).alias("dimension"), value.alias("value")).toDF(*KEYS)


def obligations(actions: DataFrame, fields: DataFrame, intents: DataFrame, deltas: DataFrame | None = None, tags: DataFrame | None = None, roles: DataFrame | None = None) -> DataFrame:
    """Distinct obligations of contracts: states, actions, state->action, intents, fields present and absent, options, changed fields, and where given delta relations, tags and contrast roles (without a scenario)."""
    options = fields.where(F.col("option").isNotNull())
    parts = [
        _keys(actions, "scenario", "state", F.col("state")),
        _keys(actions, "scenario", "action", F.col("action")),
        _keys(actions, "scenario", "state_action", F.concat_ws("->", "state", "action")),
        _keys(intents, "scenario", "intent", F.coalesce("intent", F.lit(NO_INTENT))),
        _keys(fields, "scenario", "field_present", F.col("field")),
        _keys(fields, "scenario", "field_absent", F.col("field")),
        _keys(options, "scenario", "field_option", F.concat_ws("=", "field", "option")),
        _keys(fields, "scenario", "change_field", F.col("field")),
    ]
    parts += [_keys(deltas, "scenario", "delta", F.concat_ws("->", "field", "relation"))] if deltas is not None else []
    parts += [_keys(tags, "scenario", "tag", F.col("tag"))] if tags is not None else []
    parts += [_keys(roles, F.lit(None).cast("string"), "contrast_role", F.col("role"))] if roles is not None else []
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.distinct()


_NO_KEYS = "cast(array() as array<struct<dimension:string,value:string>>)"


def _case_keys(more: bool = False) -> Column:
    """All (dimension, value) of a case as one array; with more also what an action does to which field, what becomes of each field, and the class of the context."""
    key = lambda dimension, value: F.struct(F.lit(dimension).alias("dimension"), value.alias("value"))
    one = lambda dimension, value: F.array(key(dimension, value))
    names = lambda test: F.map_keys(F.map_filter("fields", test))
    pairs = F.flatten(F.transform(F.map_entries("fields"), lambda x: F.transform(F.coalesce(x["value"], F.expr("cast(array() as array<string>)")), lambda v: F.concat_ws("=", x["key"], v))))
    present, absent = names(lambda k, v: v.isNotNull()), names(lambda k, v: v.isNull())
    found = [
        one("state", F.col("state")),
        one("action", F.col("action")),
        one("state_action", F.concat_ws("->", "state", "action")),
        one("intent", F.coalesce("intent", F.lit(NO_INTENT))),
        F.transform(present, lambda k: key("field_present", k)),
        F.transform(absent, lambda k: key("field_absent", k)),
        F.transform(pairs, lambda v: key("field_option", v)),
        F.when(F.col("change_field").isNotNull(), one("change_field", F.col("change_field"))).otherwise(F.expr(_NO_KEYS)),
        F.transform(F.coalesce("tags", F.expr("cast(array() as array<string>)")), lambda t: key("tag", t)),
    ]
    if more:
        new = F.transform_values("fields", lambda k, v: F.try_element_at(v, F.lit(1)))
        dropped = F.when(F.col("change_field").isNotNull() & F.try_element_at("fields", "change_field").isNull(), one("action_field_absent", F.concat_ws("->", "action", "change_field")))
        found += [
            F.transform(present, lambda k: key("action_field_present", F.concat_ws("->", F.col("action"), k))),
            F.coalesce(dropped, F.expr(_NO_KEYS)),
            F.transform(delta_relations(F.col("current"), new), lambda v: key("delta", v)),
            one("state_context", F.concat_ws("->", "state", context_class(F.col("current")))),
            one("context_action", F.concat_ws("->", context_class(F.col("current")), "action")),
        ]
    return F.concat(*found)


def covered(cases: DataFrame) -> DataFrame:
    """Distinct keys that cases cover, in one pass: each case gives an array of (dimension, value)."""
    return cases.select("scenario", F.explode(_case_keys()).alias("x")).select("scenario", "x.*").distinct()


#: Obligations from which they are joined to cases by shuffle and not sent to every task.
MOST_OBLIGATIONS = 1_000_000


def coverage_cube(required: DataFrame, cases: DataFrame, split: str = "split") -> DataFrame:
    """(all_splits, split, all_scenarios, scenario, dimension, required, covered, missing) for every combination of a split or all, a scenario or all, and a dimension or all (null).

    Obligations (KEYS; a null scenario is asked of all scenarios together) are numbered once. Each split's cases are read
    once into a bitmap of the numbers that they cover, so all that leaves a task is a bit for each obligation and split;
    the bitmap of all splits is the union of theirs. missing is sorted; null where a whole is summed up. A split without a
    covered obligation is listed too, as are scenarios without a case.
    """
    numbered = checkpointed(required.distinct().withColumn("_n", F.row_number().over(Window.orderBy(*KEYS)).cast("long")))
    found = cases.select(F.col(split).alias("_split"), "scenario", F.explode(_case_keys(more=True)).alias("x")).select("_split", "scenario", "x.*")
    small = F.broadcast if numbered.limit(MOST_OBLIGATIONS).count() < MOST_OBLIGATIONS else lambda x: x
    of_scenario = found.join(small(numbered.where("scenario is not null")), KEYS).select("_split", "_n")
    of_all = found.join(small(numbered.where("scenario is null").drop("scenario")), ["dimension", "value"]).select("_split", "_n")
    bits = of_scenario.unionByName(of_all).groupBy("_split", F.bitmap_bucket_number("_n").alias("_b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_n")).alias("_bits"))
    bits = checkpointed(bits)
    splits = cases.select(F.col(split).alias("_split")).distinct()
    wholes = bits.groupBy("_b").agg(F.bitmap_or_agg("_bits").alias("_bits")).select(F.lit(True).alias("_all"), F.lit(None).cast(dict(splits.dtypes)["_split"]).alias("_split"), "_b", "_bits")
    each = bits.select(F.lit(False).alias("_all"), "_split", "_b", "_bits").unionByName(wholes)
    asked = splits.select(F.lit(False).alias("_all"), "_split").unionByName(wholes.select("_all", "_split").distinct()).join(F.broadcast(numbered.withColumn("_b", F.bitmap_bucket_number("_n"))))
    same = asked["_split"].eqNullSafe(each["_split"]) & (asked["_all"] == each["_all"]) & (asked["_b"] == each["_b"])
    place = F.bitmap_bit_position("_n")
    byte = F.conv(F.hex(F.substring("_bits", (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    seen = F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))
    told = asked.join(each, same, "left").select(asked["_all"], asked["_split"], *KEYS, seen.alias("seen"))
    packed = told.select("_all", F.col("_split").alias("split"), F.struct("scenario").alias("s"), F.struct("dimension").alias("d"), "value", "seen")
    sets = packed.groupingSets([["_all", "split", "s", "d"], ["_all", "split", "s"], ["_all", "split", "d"], ["_all", "split"]], "_all", "split", "s", "d")
    whole = (F.grouping("s") == 1) | (F.grouping("d") == 1)
    return sets.agg(F.count("*").alias("required"), F.count_if("seen").alias("covered"), F.when(~whole, F.array_sort(F.collect_list(F.when(~F.col("seen"), F.col("value"))))).alias("missing")).select(
        F.col("_all").alias("all_splits"), "split", F.col("s")["scenario"].alias("scenario"), F.col("s").isNull().alias("all_scenarios"), F.col("d")["dimension"].alias("dimension"), "required", "covered", "missing"
    )


def issues(required: DataFrame, cases: DataFrame) -> DataFrame:
    """(scenario, dimension, missing): what no case covers, sorted. A scenario without any case has one issue only, of dimension scenario."""
    seen = cases.select("scenario").distinct()
    absent = required.where("scenario is not null").select("scenario").distinct().join(seen, "scenario", "left_anti")
    whole = absent.select("scenario", F.lit("scenario").alias("dimension"), F.array("scenario").alias("missing"))
    missing = required.join(seen, "scenario", "left_semi").join(covered(cases), KEYS, "left_anti")
    return whole.unionByName(missing.groupBy("scenario", "dimension").agg(F.array_sort(F.collect_set("value")).alias("missing")))


def progress(required: DataFrame, cases: DataFrame) -> DataFrame:
    """(dimension, required, covered, missing) over all scenarios; unlike issues(), all obligations of a scenario without cases count as missing, and so do contrast roles."""
    seen = covered(cases).withColumn("_seen", F.lit(1))
    joined = required.join(seen, KEYS, "left")
    return joined.groupBy("dimension").agg(F.count("*").alias("required"), F.count("_seen").alias("covered"), F.count_if(F.col("_seen").isNull()).alias("missing"))


def report_faults(report: DataFrame, missing: DataFrame) -> DataFrame:
    """(dimension, fault) where a recorded report contradicts itself: covered and missing do not add up, or missing is not the number of listed values."""
    listed = missing.groupBy("dimension").agg(F.count("*").alias("listed"))
    joined = report.join(listed, "dimension", "left")
    fault = F.when(F.col("covered") + F.col("missing") != F.col("required"), "sum").when(F.col("missing") != F.coalesce("listed", F.lit(0)), "listed")
    return joined.select("dimension", fault.alias("fault")).where("fault is not null")


def with_candidates(required: DataFrame, cases: DataFrame, candidates: DataFrame) -> DataFrame:
    """(dimension, missing, missing_with_candidates): what unreviewed candidates would still leave open."""
    after = progress(required, cases.unionByName(candidates, allowMissingColumns=True)).select("dimension", F.col("missing").alias("missing_with_candidates"))
    return progress(required, cases).select("dimension", "missing").join(after, "dimension")


def corpus_fingerprint(rows: DataFrame, key: str, fields: Column) -> DataFrame:
    """(rows, fingerprint) of a corpus: the SHA-256 over its rows' digests in order of the key's digest buckets, so that it needs no order of the rows.

    Each row's digest is that of its key and its map of fields in canonical form. Digests are gathered by their first two
    digits, sorted, hashed and hashed again over the 256 buckets.
    """
    each = rows.select(F.sha2(F.concat_ws("\n", F.col(key).cast("string"), canonical_map(fields)), 256).alias("d"))
    parts = each.groupBy(F.substring("d", 1, 4).alias("p")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("d")), ","), 256).alias("h"))
    buckets = parts.groupBy(F.substring("p", 1, 2).alias("b")).agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "h"))), lambda x: x["h"]), ","), 256).alias("h"))
    whole = F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: x["h"])
    return buckets.agg(F.sum("n").alias("rows"), F.sha2(F.array_join(whole, ","), 256).alias("fingerprint"))


def context_keys(cases: DataFrame) -> DataFrame:
    """Distinct (scenario, dimension, value) of states with the class of their collected fields: empty, partial or complete."""
    return _keys(cases, "scenario", "state_context", F.concat_ws("->", "state", context_class(F.col("current")))).distinct()
