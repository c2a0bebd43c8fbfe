"""Number functions: safe ratios, deltas, z-scores, percentiles, the exact sign test."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(numerator: Column, denominator: Column) -> Column:
    """The quotient as a double, 0 where the denominator is 0 or null."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def f1(precision: Column, recall: Column) -> Column:
    return ratio(2 * precision * recall, precision + recall)


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))


def percent_delta(current: Column, base: Column, digits: int = 3) -> Column:
    """Change against base in percent, rounded half to even (never -0); null where base is 0."""
    return F.bround(F.try_divide(current - base, base) * 100, digits) + 0.0


def z_score(current: Column, mean: Column, std: Column, digits: int = 3) -> Column:
    """Standard score, rounded half to even; null where the deviation is not above 0."""
    return F.when(std > 0, F.bround((current - mean) / std, digits) + 0.0)


def sign_test(gains: Column, losses: Column) -> Column:
    """Two-sided exact McNemar p: min(1, 2 * sum of C(n, i) for i up to the smaller count / 2^n); 1 for no discordant pair.

    Each term comes from the one before it, in logarithms, so large counts neither overflow nor vanish.
    """
    n = (gains + losses).cast("double")
    least = F.least(gains, losses).cast("int")
    step = lambda total, i: F.struct(
        (total["log"] + F.when(i == 0, -n * F.log(F.lit(2.0))).otherwise(F.log((n - i + 1) / F.greatest(i, F.lit(1))))).alias("log"), total["sum"].alias("sum")
    )
    add = lambda total, i: F.struct(step(total, i)["log"].alias("log"), (total["sum"] + F.exp(step(total, i)["log"])).alias("sum"))
    start = F.struct(F.lit(0.0).alias("log"), F.lit(0.0).alias("sum"))
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * F.aggregate(F.sequence(F.lit(0), least), start, add, lambda x: x["sum"])))


def years_between(year: Column, date: Column) -> Column:
    """Age by calendar years alone: the year of a date minus a year of birth."""
    return F.year(date) - year


def epoch_seconds(at: Column) -> Column:
    """Whole seconds since 1970, cut off."""
    return F.unix_timestamp(at)
