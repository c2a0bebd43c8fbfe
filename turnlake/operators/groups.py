"""Aggregates over groups of cases, calls and speakers, and comparisons of two models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnlake.functions.numbers import ratio
from turnlake.operators import quantiles
from turnlake.session import checkpointed


def balance_faults(cases: DataFrame, scenario: str, in_scope: Column, later: Column, least: int) -> DataFrame:
    """(scenario, fault) where a split is not balanced: count (not that of the first scenario), size (odd or below least), scope (not half in scope), no_later_state."""
    found = cases.groupBy(scenario).agg(F.count("*").alias("n"), F.count_if(in_scope).alias("inside"), F.max(later.cast("int")).alias("later"))
    agreed = found.agg(F.min_by("n", scenario).alias("agreed"))
    joined = found.crossJoin(F.broadcast(agreed))  # one row
    tests = ((F.col("n") != F.col("agreed"), "count"), ((F.col("n") < least) | (F.col("n") % 2 != 0), "size"), (2 * F.col("inside") != F.col("n"), "scope"), (F.col("later") == 0, "no_later_state"))
    return joined.select(scenario, F.explode(F.array_compact(F.array(*[F.when(test, code) for test, code in tests]))).alias("fault"))


def contingency(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, cnt) for each combination; null is a value of its own, written as an empty string."""
    return rows.groupBy(*[F.coalesce(F.col(x).cast("string"), F.lit("")).alias(x) for x in keys]).agg(F.count("*").alias("cnt"))


def call_sums(cases: DataFrame, keys: list[str], case: str, attempts: str = "attempts") -> DataFrame:
    """(keys, cases, calls, prompt_tokens, completion_tokens, seconds) over the attempts of cases; null amounts count as 0."""
    each = cases.select(*keys, case, F.explode_outer(attempts).alias("a"))
    amounts = [F.sum(F.coalesce(F.col(f"a.{x}"), F.lit(0))).alias(x) for x in ("prompt_tokens", "completion_tokens", "seconds")]
    return each.groupBy(*keys).agg(F.count_distinct(case).alias("cases"), F.count("a").alias("calls"), *amounts)


def conditional_counts(rows: DataFrame, keys: list[str], counts: dict[str, Column]) -> DataFrame:
    """(keys, n, one count for each condition); a null condition does not count."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *[F.count_if(F.coalesce(test, F.lit(False))).alias(name) for name, test in counts.items()])


def repeat_consistency(runs: DataFrame, keys: list[str], outcome: Column) -> DataFrame:
    """(keys, runs, outcomes, stable): a case is stable if all its runs have one outcome, null being one of them."""
    found = runs.groupBy(*keys).agg(F.count("*").alias("runs"), F.count_distinct(F.coalesce(outcome.cast("string"), F.lit("\0null"))).alias("outcomes"))
    return found.withColumn("stable", F.col("outcomes") == 1)


def group_by_place(cases: DataFrame, order: list[str], sizes: list[tuple[str, int]]) -> DataFrame:
    """cases with their place (from 1) and the group that it falls in: the first so many belong to the first group, and so on; null beyond them.

    For short lists whose order was fixed beforehand: no more rows than the groups hold are numbered.
    """
    total = sum(n for _, n in sizes)
    first = cases.orderBy(*order).limit(total)
    numbered = first.withColumn("place", F.row_number().over(Window.orderBy(*order)))
    group, end = F.lit(None).cast("string"), total
    for name, n in reversed(sizes):
        group, end = F.when(F.col("place") <= end, name).otherwise(group), end - n
    return numbered.withColumn("group", group)


def medians_of_medians(clips: DataFrame, speaker: str, decade: Column, value: str) -> DataFrame:
    """(decade, speakers, p25, p50, p75): linear quartiles over the speakers' medians of their clips' values, found by rounds of bucket counts."""
    own = checkpointed(clips.groupBy(speaker, decade.alias("decade")).agg(F.median(value).alias("m")))
    sizes = own.groupBy("decade").agg(F.count_distinct(speaker).alias("speakers"), F.count("m").alias("n"))
    shares = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
    place = lambda p: p * (F.col("n") - 1)
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(place(p)), F.ceil(place(p))) for p in shares.values()])))
    met = quantiles.values_at(own, ["decade"], "m", sizes.select("decade", F.explode(ranks).alias("rank")))
    packed = met.groupBy(F.col("decade").alias("_d")).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at"))
    joined = sizes.join(packed, F.col("decade").eqNullSafe(F.col("_d")), "left")
    at = lambda rank: F.try_element_at("at", rank)
    between = lambda p: at(F.floor(place(p))) * (1 - (place(p) - F.floor(place(p)))) + at(F.ceil(place(p))) * (place(p) - F.floor(place(p)))
    return joined.select("decade", "speakers", *[between(p).alias(name) for name, p in shares.items()])


def in_band(value: Column, low: Column, high: Column) -> Column:
    """Whether a value lies in a band, ends included; null where one of them is missing."""
    return value.between(low, high)


def decade_of(age: Column) -> Column:
    return (F.floor(age / 10) * 10).cast("int")


def sorted_sets(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value + "s"): the distinct values of each key, sorted."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias(f"{value}s"))


def gate(summary: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """A summary with one column for each threshold and passes, which wants them all; a null test fails."""
    sure = {name: F.coalesce(test, F.lit(False)) for name, test in tests.items()}
    whole = F.lit(True)
    for name in sure:
        whole = whole & F.col(name)
    return summary.withColumns(sure).withColumn("passes", whole)


def two_clusters(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, low, high, threshold): two means of a key's values, begun at the least and the greatest and moved until they stay; the threshold lies between.

    Each distinct value is a possible cut: running sums give the means on both sides of it, and these the next cut, which
    is one lookup. So the steps are a chain from cut to cut, whose end is found by following it one, two, four, ... steps
    at a time. Nothing is gathered; null values do not count, and a key with one distinct value has low and high equal.
    """
    v = F.col(value).cast("double")
    counted = rows.where(v.isNotNull() & ~F.isnan(v)).groupBy(key, v.alias("v")).agg(F.count("*").alias("n"))
    up, whole = Window.partitionBy(key).orderBy("v").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(key)
    sums = counted.withColumns({"s": F.sum(F.col("v") * F.col("n")).over(up), "c": F.sum("n").over(up), "s_all": F.sum(F.col("v") * F.col("n")).over(whole), "c_all": F.sum("n").over(whole), "least": F.min("v").over(whole), "most": F.max("v").over(whole)})
    low, high = F.col("s") / F.col("c"), F.coalesce(F.try_divide(F.col("s_all") - F.col("s"), F.col("c_all") - F.col("c")), F.col("most"))
    cuts = checkpointed(sums.select(key, "v", low.alias("low"), high.alias("high"), "least", "most"))
    # what lies no farther from low than from high: the greatest value up to their middle
    marks = cuts.select(key, F.col("v").alias("at"), F.col("v").alias("cut"), F.lit(None).cast("double").alias("of"))
    asks = cuts.select(key, ((F.col("low") + F.col("high")) / 2).alias("at"), F.lit(None).cast("double").alias("cut"), F.col("v").alias("of"))
    begins = cuts.select(key, ((F.col("least") + F.col("most")) / 2).alias("at"), F.lit(None).cast("double").alias("cut"), F.lit(float("nan")).alias("of")).distinct()
    upto = Window.partitionBy(key).orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    chain = marks.unionByName(asks).unionByName(begins).withColumn("next", F.max("cut").over(upto)).where("of is not null")
    begun = checkpointed(chain.where(F.isnan("of")).select(key, F.col("next").alias("cut")))
    steps = checkpointed(chain.where(~F.isnan("of")).select(key, F.col("of").alias("cut"), "next"))
    while True:
        over = steps.select(F.col(key), F.col("cut").alias("next"), F.col("next").alias("after"))
        begun = checkpointed(begun.join(steps, [key, "cut"]).select(key, F.col("next").alias("cut")))
        if not begun.join(steps, [key, "cut"]).where("cut <> next").limit(1).count():
            break
        steps = checkpointed(steps.join(over, [key, "next"]).select(key, "cut", F.col("after").alias("next")))
    ends = begun.join(cuts.select(key, F.col("v").alias("cut"), "low", "high"), [key, "cut"])
    return ends.select(key, "low", "high", ((F.col("low") + F.col("high")) / 2).alias("threshold"))


def paired_sets(pairs: DataFrame, keys: list[str], case: str, before: str, after: str) -> DataFrame:
    """(keys, new, preexisting, recovered, retained): sorted ids of cases that only the second model fails, both fail, only the first fails, both pass."""
    b, a = F.col(before) == 1, F.col(after) == 1
    ids = lambda test: F.array_sort(F.collect_list(F.when(test, F.col(case))))
    sets = {"new": b & ~a, "preexisting": ~b & ~a, "recovered": ~b & a, "retained": b & a}
    return pairs.groupBy(*keys).agg(*[ids(test).alias(name) for name, test in sets.items()])


def gained_and_lost(before: DataFrame, after: DataFrame, case: str, passed: str) -> DataFrame:
    """(case, change) of cases whose result differs: gained or lost; a case that only the second report has is unknown."""
    joined = before.select(case, F.col(passed).alias("_b")).join(after.select(case, F.col(passed).alias("_a")), case, "right")
    change = F.when(F.col("_b").isNull(), "unknown").when(F.col("_a") > F.col("_b"), "gained").when(F.col("_a") < F.col("_b"), "lost")
    return joined.select(case, change.alias("change")).where("change is not null")


def paired_comparison(spread: DataFrame, keys: list[str], before: str, after: str) -> DataFrame:
    """(keys, cases, baseline_correct, candidate_correct, both accuracies, difference in points, relative change in percent, null for a baseline of 0)."""
    found = spread.groupBy(*keys).agg(F.count("*").alias("cases"), F.sum(before).alias("baseline_correct"), F.sum(after).alias("candidate_correct"))
    b, a = ratio(F.col("baseline_correct"), F.col("cases")), ratio(F.col("candidate_correct"), F.col("cases"))
    return found.withColumns(
        {"baseline_accuracy": b, "candidate_accuracy": a, "difference_points": (a - b) * 100, "relative_change": F.when(b > 0, (a - b) / b * 100)}
    )


def contrast_recovery(pairs: DataFrame, results: DataFrame, case: str, correct: str) -> DataFrame:
    """(pairs, recovered): contrast pairs (first, second), and those both members of which are correct; a missing result is not."""
    own = lambda side: results.select(F.col(case).alias(side), F.col(correct).alias(f"_{side}"))
    joined = pairs.join(own("first"), "first", "left").join(own("second"), "second", "left")
    both = (F.col("_first") == 1) & (F.col("_second") == 1)
    return joined.agg(F.count("*").alias("pairs"), F.count_if(F.coalesce(both, F.lit(False))).alias("recovered"))


def overridden(results: DataFrame, guard: DataFrame, key: str, value: str, to: str) -> DataFrame:
    """(results, column effective): the value that a guard's hit puts in place of the model's, and the model's own where the guard has no hit."""
    hits = guard.where("hit").select(key).distinct().withColumn("_hit", F.lit(True))
    return results.join(hits, key, "left").withColumn("effective", F.when(F.col("_hit"), to).otherwise(F.col(value))).withColumn("guarded", F.coalesce("_hit", F.lit(False))).drop("_hit")


def tampered(recomputed: DataFrame, recorded: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys, value, recomputed, recorded) where a recorded summary is not what the rows give; numbers are compared as text of six places."""
    text = lambda x: F.when(F.col(x).cast("double").isNotNull(), F.format_number(F.col(x).cast("double"), 6)).otherwise(F.col(x).cast("string"))
    spread = lambda df, name: df.select(*keys, F.explode(F.array(*[F.struct(F.lit(v).alias("value"), text(v).alias(name)) for v in values])).alias("x")).select(*keys, "x.*")
    joined = spread(recomputed, "recomputed").join(spread(recorded, "recorded"), [*keys, "value"], "full")
    return joined.where(~F.col("recomputed").eqNullSafe(F.col("recorded")))


def median_of_successes(calls: DataFrame, keys: list[str], value: str, status: Column) -> DataFrame:
    """(keys, calls, succeeded, median): the median over the calls that succeeded only."""
    return calls.groupBy(*keys).agg(F.count("*").alias("calls"), F.count_if(status == 200).alias("succeeded"), F.median(F.when(status == 200, F.col(value))).alias("median"))


def versioned(asked: DataFrame, table: DataFrame, keys: list[str], version: str, value: str) -> DataFrame:
    """asked (keys, version or null) with value: that of the version, or of the greatest one where none is asked for; null where there is none."""
    latest = table.groupBy(*keys).agg(F.max_by(value, version).alias("_latest"))
    exact = table.select(*keys, version, F.col(value).alias("_exact"))
    joined = asked.join(exact, [*keys, version], "left").join(latest, keys, "left")
    return joined.withColumn(value, F.when(F.col(version).isNull(), F.col("_latest")).otherwise(F.col("_exact"))).drop("_latest", "_exact")
