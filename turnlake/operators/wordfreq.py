"""Word and filler frequency over turns: scope, counts, totals, deterministic top-k."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnlake.functions.numbers import ratio
from turnlake.functions.text import letter_words

#: Interjections that stand in for a tagger's; every function that uses them takes another list.
FILLERS = ("ah", "eh", "er", "hm", "oh", "uh", "um")


def in_scope(turns: DataFrame, scope: str) -> DataFrame:
    """Turns of one role; scope all keeps every role."""
    if scope not in ("all", "user", "assistant", "system"):
        raise ValueError(f"unknown scope {scope}")
    return turns if scope == "all" else turns.where(F.col("role") == scope)


def tokens(turns: DataFrame, order: list[str], keep: list[str] | None = None, tokenize: Callable[[Column], Column] = letter_words) -> DataFrame:
    """One row for each word of each text: keep columns, word, at (its place: the order columns, then the place in the text)."""
    return turns.select(*(keep or []), *order, F.posexplode(tokenize(F.col("text"))).alias("pos", "word")).select(
        *(keep or []), "word", F.struct(*order, "pos").alias("at")
    )


def counts(words: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row (keys, word, cnt, first): how often a word occurs, and where first."""
    return words.groupBy(*(keys or []), "word").agg(F.count("*").alias("cnt"), F.min("at").alias("first"))


def top(counted: DataFrame, k: int, keys: list[str] | None = None, minimum: int = 1) -> DataFrame:
    """The k most frequent of counts() with at least minimum uses, ties by first use: keys, rank, word, cnt.

    Without keys a limit comes first, so that no task ranks more than k rows.
    """
    enough = counted.where(F.col("cnt") >= minimum)
    if not keys:
        best = enough.orderBy(F.desc("cnt"), "first").limit(k)
        return best.select(F.row_number().over(Window.orderBy(F.desc("cnt"), "first")).alias("rank"), "word", "cnt")
    ranked = enough.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("cnt"), "first")))
    return ranked.where(F.col("rank") <= k).select(*keys, "rank", "word", "cnt")


def most_common(words: DataFrame, k: int, keys: list[str] | None = None, minimum: int = 1) -> DataFrame:
    """top() of counts() for many words: they are counted by hash, without places.

    Only for those as frequent as the k-th, which ties may make more than k, are the places of first use looked up, in a
    second pass over the words; with keys each task drops what cannot be among the first k before it hands on.
    """
    by = keys or []
    enough = words.groupBy(*by, "word").agg(F.count("*").alias("cnt")).where(F.col("cnt") >= minimum)
    if by:
        kept = enough.withColumn("_r", F.rank().over(Window.partitionBy(*by).orderBy(F.desc("cnt")))).where(F.col("_r") <= k)
    else:
        least = enough.orderBy(F.desc("cnt")).limit(k).agg(F.min("cnt").alias("_least"))
        kept = enough.join(F.broadcast(least), F.col("cnt") >= F.col("_least"))  # one row
    first = words.join(kept.select(*by, "word"), [*by, "word"], "left_semi")
    return top(counts(first, by), k, keys)


def by_category(words: DataFrame, categories: DataFrame, key: str, k: int) -> DataFrame:
    """most_common() for each category of a list; a category without a word has one row with null rank and word and a count of 0."""
    found = categories.select(key).distinct().join(most_common(words, k, [key]), key, "left")
    return found.withColumn("cnt", F.coalesce("cnt", F.lit(0)))


def filler_share(turns: DataFrame, keys: list[str], fillers: tuple = FILLERS) -> DataFrame:
    """For each group of turns: total_messages (blank ones too), total_words, filler_count, filler_ratio (percent, one decimal, 0 for no word)."""
    words = letter_words(F.coalesce("text", F.lit("")))
    each = turns.select(*keys, F.size(words).alias("n"), F.size(F.filter(words, lambda x: x.isin(*fillers))).alias("f"))
    summed = each.groupBy(*keys).agg(F.count("*").alias("total_messages"), F.sum("n").cast("long").alias("total_words"), F.sum("f").cast("long").alias("filler_count"))
    return summed.withColumn("filler_ratio", F.bround(ratio(F.col("filler_count"), F.col("total_words")) * 100, 1))
