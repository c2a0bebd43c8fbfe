"""Append-only logs: pairing, order, runs of quiet, routes, latency, histograms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnlake.operators import quantiles, scans
from turnlake.session import checkpointed

#: Routes from mild to severe; of several events the most severe one decides.
ROUTES = ("normal", "confirm", "direct")


def event_pairs(log: DataFrame, key: str, order: str, begins: Column, ends: Column) -> DataFrame:
    """(key, begun, paired, unpaired) for each key: how many begin rows are followed directly by an end row of that key.

    order is a number; a key with most of the rows is looked at in blocks of it.
    """
    marked = log.where(begins | ends).select(key, order, begins.alias("begins"))
    paired = scans.with_previous(scans.in_blocks(marked, key, F.col(order)), key, [order], "following", F.col("begins"), step=1)
    paired = paired.withColumn("paired", F.col("begins") & F.coalesce(~F.col("following"), F.lit(False)))
    return paired.groupBy(key).agg(F.count_if("begins").alias("begun"), F.count_if("paired").alias("paired")).withColumn("unpaired", F.col("begun") - F.col("paired"))


def order_violations(spans: DataFrame, key: str, order: str, start: str, end: str, by: Column | None = None) -> DataFrame:
    """Spans that begin before the one before them (in order, within key) has ended, with its previous_end; by: a number that rises with order (default: order itself)."""
    placed = scans.in_blocks(spans, key, F.col(order) if by is None else by)
    return scans.with_previous(placed, key, [order], "previous_end", F.col(end)).where(F.col(start) < F.col("previous_end")).drop(scans.BLOCK)


def runs(log: DataFrame, key: str, order: list[str], inside: Column, least: int, by: Column | None = None) -> DataFrame:
    """(key, run, n): stretches of least or more rows in order, within key, for all of which inside holds; runs count from 1.

    by: a number that rises with order (default: the first order column).
    """
    placed = scans.in_blocks(log.select(key, *order, inside.alias("inside"), (F.col(order[0]) if by is None else by).alias("_by")), key, F.col("_by"))
    before = scans.with_previous(placed, key, order, "before", F.col("inside"))
    marked = scans.as_before(before, before.withColumn("starts", (F.col("inside") & ~F.coalesce("before", F.lit(False))).cast("long")))
    numbered = scans.with_running_sum(marked, key, order, "run", F.col("starts")).where("inside")
    return numbered.groupBy(key, "run").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def route(severity: Column) -> Column:
    """Name of a route's number in ROUTES."""
    return F.element_at(F.array(*[F.lit(x) for x in ROUTES]), severity + 1)


def aggregate_routes(log: DataFrame, key: str, severity: Column) -> DataFrame:
    """(key, events, route): the most severe route of a key's events; an event with no severity asks for confirmation."""
    found = log.groupBy(key).agg(F.count("*").alias("events"), F.max(F.coalesce(severity, F.lit(1))).alias("s"))
    return found.select(key, "events", route(F.col("s")).alias("route"))


#: A group with at most so many values is ranked by one window; a larger one by rounds of bucket counts.
RANKED_ROWS = 200_000


def latency(log: DataFrame, keys: list[str], value: str, ranked_rows: int = RANKED_ROWS) -> DataFrame:
    """Per group: n, median, linear and nearest-rank 95th percentile, all exact.

    The values of a small group are counted by hash, and running counts over them, in order, give all ranks at once. Of a
    group with more than ranked_rows values no task holds more than bucket counts (operators.quantiles).
    """
    own = log.where(F.col(value).isNotNull())
    sizes = own.groupBy(*keys).agg(F.count("*").alias("n"))
    large = checkpointed(sizes.where(F.col("n") > ranked_rows))
    some = large.count()
    same = lambda a, b: reduce(lambda x, k: x & a[k].eqNullSafe(b[k]), keys, F.lit(True))
    small = own.join(F.broadcast(large) if some < 100_000 else large, same(own, large), "left_anti") if some else own
    counted = small.groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_k"))
    ordered = Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = counted.withColumns({"_to": F.sum("_k").over(ordered), "_n": F.sum("_k").over(Window.partitionBy(*keys))})
    at = lambda rank: F.max(F.when((F.col("_to") - F.col("_k") <= rank) & (rank < F.col("_to")), F.col("_v")))
    ranks = _ranks(F.col("_n"))
    found = placed.groupBy(*keys).agg(F.max("_n").alias("n"), *[at(rank).alias(name) for name, rank in ranks.items()])
    if some:
        wanted = large.select(*keys, "n", F.explode(F.array(*_ranks(F.col("n")).values())).alias("rank"))
        met = quantiles.values_at(own, keys, value, wanted.select(*keys, "rank"))
        sized = met.join(large, same(met, large)).select(*[met[k] for k in keys], "n", "rank", "value")
        of = lambda name: F.max(F.when(F.col("rank") == _ranks(F.col("n"))[name], F.col("value"))).alias(name)
        found = found.unionByName(sized.groupBy(*keys).agg(F.max("n").alias("n"), *[of(name) for name in ranks]))
    share = lambda p: p * (F.col("n") - 1) - F.floor(p * (F.col("n") - 1))
    between = lambda p, low, high: F.col(low) * (1 - share(p)) + F.col(high) * share(p)
    found = found.select(*keys, "n", between(0.5, "m_low", "m_high").alias("p50"), between(0.95, "p_low", "p_high").alias("p95_linear"), F.col("nearest").alias("p95_nearest"))
    every = log.select(keys).distinct()
    none = every.join(found, same(every, found), "left").select(*[every[k] for k in keys], "n", "p50", "p95_linear", "p95_nearest")
    return none.withColumn("n", F.coalesce("n", F.lit(0)))


def _ranks(n: Column) -> dict[str, Column]:
    """Ranks, from 0, on either side of the median and of the 95th percentile, and that of the nearest rank."""
    place = lambda p: p * (n - 1)
    return {"m_low": F.floor(place(0.5)), "m_high": F.ceil(place(0.5)), "p_low": F.floor(place(0.95)), "p_high": F.ceil(place(0.95)), "nearest": F.ceil(0.95 * n) - 1}


def histogram(log: DataFrame, keys: list[str], value: str, edges: list[float]) -> DataFrame:
    """(keys, le, cnt): cumulative counts of values up to each edge; the last edge is +Inf."""
    counted = log.groupBy(*keys).agg(*[F.count_if(F.col(value) <= x).alias(str(i)) for i, x in enumerate(edges)], F.count(value).alias("all"))
    rows = [F.struct(F.lit(f"{x:g}").alias("le"), F.col(str(i)).alias("cnt")) for i, x in enumerate(edges)] + [F.struct(F.lit("+Inf").alias("le"), F.col("all").alias("cnt"))]
    return counted.select(*keys, F.explode(F.array(*rows)).alias("x")).select(*keys, "x.le", "x.cnt")


def first_match(cases: list[tuple[Column, str]], default: str) -> Column:
    """Value of the first condition that holds, in the declared order."""
    chosen = F.lit(default)
    for condition, value in reversed(cases):
        chosen = F.when(condition, value).otherwise(chosen)
    return chosen


def lookup_or_all(asked: DataFrame, catalog: DataFrame, scope: str, key: str, value: str, order: str) -> DataFrame:
    """asked with column offers: the one value of (scope, key) in catalog, or else all distinct values of the scope in order.

    Values are made distinct before they are gathered, so a scope's list has its offers and not its rows.
    """
    hit = catalog.groupBy(scope, key).agg(F.min_by(value, order).alias("_hit"))
    distinct = catalog.groupBy(scope, value).agg(F.min(order).alias("_at"))
    all_of = distinct.groupBy(scope).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", value))), lambda x: x[value]).alias("_all"))
    joined = asked.join(hit, [scope, key], "left").join(all_of, scope, "left")
    return joined.withColumn("offers", F.when(F.col("_hit").isNotNull(), F.array("_hit")).otherwise(F.col("_all"))).drop("_hit", "_all")
