"""Scores of structured predictions against labelled cases, from one frame of flags for each case.

cases: case_id, labels struct<intent, action, change_field, fields map<string, array<string>>> where a null array means that
the field must be absent. predictions: case_id, attempts array<struct<valid, intent, action, change_field, fields
map<string, string>>>. A prediction whose last attempt is not valid counts as a contract failure: it adds to the slots that
should be present (missed), and nothing to those that should be absent. A predicted field that the labels do not have is hallucinated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnlake.functions.numbers import f1, ratio
from turnlake.operators import contracts

FAILED = "__contract_failure__"
#: Counters of a case, summed for a group of cases.
COUNTERS = [
    "first_pass", "final_pass", "retried", "exact", "intent_ok", "action_ok", "tp", "fp", "fn", "gold_present", "gold_absent",
    "value_ok", "hallucinated", "omitted", "change_cases", "change_ok",
]


def id_faults(cases: DataFrame, predictions: DataFrame) -> DataFrame:
    """Ids that keep cases and predictions from pairing one to one: (case_id, fault)."""
    a = cases.groupBy("case_id").agg(F.count("*").alias("n_cases"))
    b = predictions.groupBy("case_id").agg(F.count("*").alias("n_predictions"))
    fault = (
        F.when(F.col("n_cases").isNull(), "extra_prediction")
        .when(F.col("n_predictions").isNull(), "missing_prediction")
        .when(F.col("n_cases") > 1, "duplicate_case")
        .when(F.col("n_predictions") > 1, "duplicate_prediction")
    )
    return a.join(b, "case_id", "full").select("case_id", fault.alias("fault")).where("fault is not null")


def case_flags(cases: DataFrame, predictions: DataFrame, change_action: str = "change") -> DataFrame:
    """cases with the counters of each, and gold_action and predicted_action."""
    joined = cases.join(predictions, "case_id")
    first, last = F.col("attempts")[0], F.element_at("attempts", -1)
    joined = joined.withColumns({"final": F.when(last["valid"], last), "slots": F.map_entries("labels.fields"), "beyond": F.map_keys("labels.fields")})
    unasked = F.size(F.filter(F.map_keys("final.fields"), lambda k: ~F.array_contains("beyond", k) & F.element_at("final.fields", k).isNotNull())).cast("long")
    unasked = F.when(F.col("final").isNotNull(), F.greatest(unasked, F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long"))
    valid = F.col("final").isNotNull()
    predicted = lambda x: F.element_at(F.col("final.fields"), x["key"])
    present = lambda x: x["value"].isNotNull()
    right = lambda x: F.when(present(x), F.coalesce(F.array_contains(x["value"], predicted(x)), F.lit(False))).otherwise(predicted(x).isNull())
    n = lambda test: F.size(F.filter("slots", test)).cast("long")
    flag = lambda test: F.coalesce(test, F.lit(False)).cast("long")
    intent_ok, action_ok = F.col("final.intent").eqNullSafe(F.col("labels.intent")), F.col("final.action").eqNullSafe(F.col("labels.action"))
    change_ok = F.col("final.change_field").eqNullSafe(F.col("labels.change_field"))
    on_valid = lambda test: F.when(valid, n(test)).otherwise(F.lit(0).cast("long"))
    gold_present, tp = n(present), on_valid(lambda x: present(x) & predicted(x).isNotNull())
    extra = on_valid(lambda x: ~present(x) & predicted(x).isNotNull()) + unasked
    changes = F.col("labels.action") == change_action
    return joined.withColumns(
        {
            "first_pass": flag(first["valid"]),
            "final_pass": flag(valid),
            "retried": flag(F.size("attempts") == 2),
            "exact": flag(valid & intent_ok & action_ok & change_ok & F.forall("slots", right) & (unasked == 0)),
            "intent_ok": flag(valid & intent_ok),
            "action_ok": flag(valid & action_ok),
            "tp": tp,
            "fp": extra,
            "fn": gold_present - tp,
            "gold_present": gold_present,
            "gold_absent": on_valid(lambda x: ~present(x)),
            "value_ok": on_valid(lambda x: present(x) & right(x)),
            "hallucinated": extra,
            "omitted": gold_present - tp,
            "change_cases": flag(changes),
            "change_ok": flag(valid & changes & change_ok),
            "gold_action": F.col("labels.action"),
            "predicted_action": F.when(valid, F.col("final.action")).otherwise(FAILED),
        }
    ).drop("final", "slots", "beyond", "attempts")


def summary(flags: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Sums of the counters and the rates made of them, for each group; change_accuracy is null without such cases."""
    summed = flags.groupBy(*(keys or [])).agg(F.count("*").alias("cases"), *[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in COUNTERS])
    c = F.col
    precision, recall = ratio(c("tp"), c("tp") + c("fp")), ratio(c("tp"), c("tp") + c("fn"))
    return summed.withColumns(
        {
            "exact_rate": ratio(c("exact"), c("cases")),
            "first_pass_rate": ratio(c("first_pass"), c("cases")),
            "final_pass_rate": ratio(c("final_pass"), c("cases")),
            "retry_rate": ratio(c("retried"), c("cases")),
            "failure_rate": ratio(c("cases") - c("final_pass"), c("cases")),
            "intent_accuracy": ratio(c("intent_ok"), c("cases")),
            "action_accuracy": ratio(c("action_ok"), c("cases")),
            "slot_precision": precision,
            "slot_recall": recall,
            "slot_f1": f1(precision, recall),
            "value_rate": ratio(c("value_ok"), c("gold_present")),
            "hallucination_rate": ratio(c("hallucinated"), c("gold_absent")),
            "omission_rate": ratio(c("omitted"), c("gold_present")),
            "change_accuracy": F.when(c("change_cases") > 0, c("change_ok") / c("change_cases")),
        }
    )


def sliced(flags: DataFrame, single: dict[str, Column], tags: Column) -> DataFrame:
    """Summaries over all cases, for each value of the single-valued slices and for each tag, in one pass over the flags.

    Tag slices overlap and must not be added up.
    """
    own = [F.struct(F.lit("overall").alias("slice"), F.lit("all").alias("value"))]
    own += [F.struct(F.lit(name).alias("slice"), x.cast("string").alias("value")) for name, x in single.items()]
    labels = F.concat(F.array(*own), F.transform(F.array_distinct(tags), lambda x: F.struct(F.lit("tag").alias("slice"), x.alias("value"))))
    spread = flags.withColumn("_s", F.explode(labels)).select("*", F.col("_s.slice").alias("slice"), F.col("_s.value").alias("value"))
    return summary(spread, ["slice", "value"])


def confusion(flags: DataFrame) -> DataFrame:
    """Cases for each pair of labelled and predicted action."""
    return flags.groupBy("gold_action", "predicted_action").agg(F.count("*").alias("cnt"))


def macro_f1(flags: DataFrame) -> DataFrame:
    """(classes, macro_f1): the mean F1 over the actions that the labels have; predicted-only ones are no class."""
    pairs = confusion(flags)
    gold = pairs.groupBy(F.col("gold_action").alias("action")).agg(
        F.sum("cnt").alias("gold"), F.sum(F.when(F.col("gold_action") == F.col("predicted_action"), F.col("cnt")).otherwise(0)).alias("tp")
    )
    predicted = pairs.groupBy(F.col("predicted_action").alias("action")).agg(F.sum("cnt").alias("predicted"))
    c = F.col
    each = gold.join(predicted, "action", "left").select(f1(ratio(c("tp"), c("predicted")), ratio(c("tp"), c("gold"))).alias("f"))
    return each.agg(F.count("*").alias("classes"), F.avg("f").alias("macro_f1"))


def transitions(pairs: DataFrame, before: str = "b", after: str = "c") -> DataFrame:
    """One row (both_correct, baseline_only, candidate_only, neither) from the exact flags of two models on the same cases."""
    count = lambda b, c: F.count_if((F.col(before) == b) & (F.col(after) == c))
    return pairs.agg(count(1, 1).alias("both_correct"), count(1, 0).alias("baseline_only"), count(0, 1).alias("candidate_only"), count(0, 0).alias("neither"))


def revalidated(predictions: DataFrame, rules: Column) -> DataFrame:
    """predictions whose attempts are valid only if the contract says so again: valid and no fault of rules.

    rules is a function of one attempt (a column), giving a fault code or null; a recorded flag alone is not trusted.
    """
    checked = F.transform("attempts", lambda a: a.withField("valid", F.coalesce(a["valid"] & rules(a).isNull(), F.lit(False))))
    return predictions.withColumn("attempts", checked)


def validated(predictions: DataFrame, states: DataFrame, fields: DataFrame, actions: DataFrame, rules: DataFrame) -> DataFrame:
    """predictions whose attempts are valid only if they say so and break no rule of their contract (operators.contracts.violations).

    states: case_id, scenario, state of each case; fields, actions and rules are the contract's tables. Every attempt is an
    output of its own, told apart by its place; a case without a state breaks the contract with each attempt.
    """
    each = predictions.select("case_id", F.posexplode("attempts").alias("place", "a")).join(states, "case_id", "left")
    outputs = each.select(F.struct("case_id", "place").alias("case_id"), F.coalesce("scenario", F.lit("")).alias("scenario"), "state", F.col("a.action").alias("action"), F.col("a.fields").alias("fields"))
    broken = contracts.violations(outputs, fields, actions, rules).select("case_id").distinct()
    places = broken.groupBy("case_id.case_id").agg(F.collect_set("case_id.place").alias("_broken"))
    joined = predictions.join(places, "case_id", "left")
    stands = lambda i: ~F.coalesce(F.array_contains("_broken", i), F.lit(False))
    checked = F.transform("attempts", lambda a, i: a.withField("valid", F.coalesce(a["valid"] & stands(i), F.lit(False))))
    return joined.withColumn("attempts", checked).drop("_broken")


def two_models(cases: DataFrame, baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """(case_id, the cases' other columns but labels, b, c): whether each model is exact, cases read once and both predictions joined by id."""
    both = baseline.select("case_id", F.lit("b").alias("model"), "attempts").unionByName(candidate.select("case_id", F.lit("c").alias("model"), "attempts"))
    keep = [x for x in cases.columns if x not in ("case_id", "labels")]
    flags = case_flags(cases, both)
    of = lambda model: F.max(F.when(F.col("model") == model, F.col("exact")))
    return flags.groupBy("case_id", *keep).agg(of("b").alias("b"), of("c").alias("c"))


def bootstrap(deltas: DataFrame, stratum: str, delta: str, resamples: int = 2000, seed: int = 0) -> DataFrame:
    """(cases, difference, low, high): the mean delta and its 95 % interval over resamples that draw each stratum anew.

    A stratum is first reduced to how many cases have each delta; a resample draws from those counts, so the cases are read
    once and what is drawn grows with strata and resamples only. Percentiles are linear. Reruns agree.
    """
    from numpy.random import default_rng

    counted = deltas.groupBy(stratum).agg(*[F.count_if(F.col(delta) == x).alias(n) for n, x in (("minus", -1), ("zero", 0), ("plus", 1))])

    @F.pandas_udf("array<long>")
    def drawn(key, minus, zero, plus):
        import pandas as pd

        out = []
        for k, *n in zip(key, minus, zero, plus, strict=True):
            total = sum(n)
            draws = default_rng([seed, abs(int(k)) % (1 << 62)]).multinomial(total, [x / total for x in n], resamples)
            out.append(draws[:, 2] - draws[:, 0])
        return pd.Series(out)

    draws = counted.select(F.posexplode(drawn(F.xxhash64(stratum), "minus", "zero", "plus")).alias("resample", "total"))
    size = counted.agg(F.sum(F.col("minus") + F.col("zero") + F.col("plus")).alias("cases"), F.sum(F.col("plus") - F.col("minus")).alias("moved"))
    totals = draws.groupBy("resample").agg(F.sum("total").alias("total"))
    ends = totals.agg(F.expr("percentile(total, 0.025D)").alias("a"), F.expr("percentile(total, 0.975D)").alias("b"))
    return size.crossJoin(F.broadcast(ends)).select("cases", (F.col("moved") / F.col("cases")).alias("difference"), (F.col("a") / F.col("cases")).alias("low"), (F.col("b") / F.col("cases")).alias("high"))


def arm_order(pairs: DataFrame, block: str, key: str) -> DataFrame:
    """pairs with ordinal (from 0, by key within block) and arm_order: AB for even ordinals and BA for odd ones, so that a block's arms go first equally often."""
    ordinal = F.row_number().over(Window.partitionBy(block).orderBy(key)) - 1
    return pairs.withColumn("ordinal", ordinal).withColumn("arm_order", F.when(F.pmod("ordinal", F.lit(2)) == 0, "AB").otherwise("BA"))


def ranked_sample(rows: DataFrame, group: str, key: str, n: int, seed: str) -> DataFrame:
    """n rows of each group, by the rank of sha256(seed:key): group, key, rank."""
    order = F.sha2(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")), 256)
    ranked = rows.select(group, key, F.row_number().over(Window.partitionBy(group).orderBy(order)).alias("rank"))
    return ranked.where(F.col("rank") <= n)
