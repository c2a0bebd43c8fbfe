"""Mixing sources to target weights by blocks of words.

The words of each source, in a pseudorandom order of its documents, are packed into blocks of BLOCK words (the last may be
shorter). A source's target becomes slots: whole passes over its blocks, then a rest whose last slot is cut so that the
sum is the target. How many slots of each source an output shard gets is a multinomial draw: each run of CHUNK slots of a
source draws its counts over the shards on its own, so sources and shards may be many and every slot is given once. The
k-th slot of a source takes block perm(k) of its pass, with one pseudorandom permutation for each source and pass, so no
block is used more often than the passes begun. Slots then join the blocks by index.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from turnlake.llm.shared import WORD, hot_join, small_batches, staged, unstaged, word_count

WEIGHTS = (5, 2, 1)
BUDGET, MOST_PASSES = 1.5, 2
BLOCK = 256
SEED = 20240501
#: Slots of an output shard, about, and slots of a source whose shards are drawn at once.
SHARD_SLOTS, CHUNK = 1 << 14, 1 << 16
#: Documents of a source whose order and offsets one task settles, about.
BUCKET_ROWS = 256


def ordinals(rows: DataFrame, order: Column, name: str) -> DataFrame:
    """rows, staged, with their places in an order, from 0: sorted in ranges and numbered in each, behind the sizes of those before.

    As many sizes as there are ranges come to the driver.
    """
    ranged = staged(rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("_id", F.monotonically_increasing_id()))
    sizes = ranged.groupBy(F.shiftright("_id", 33).alias("_part")).agg(F.count("*").alias("n")).orderBy("_part").collect()
    starts = np.cumsum([0] + [x["n"] for x in sizes]).tolist()
    firsts = rows.sparkSession.createDataFrame([(x["_part"], at) for x, at in zip(sizes, starts, strict=False)], "_part long, _first long")
    placed = ranged.withColumn("_part", F.shiftright("_id", 33)).join(F.broadcast(firsts), "_part")
    out = staged(placed.withColumn(name, F.col("_first") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id", "_part", "_first"))
    unstaged(ranged)
    return out


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, budget: float = BUDGET, most: float = MOST_PASSES) -> DataFrame:
    """One row (source, source_no, source_size, rows, target) for each source of sizes (source, size), staged.

    Sources by code point, null last, take the weights in turn and share budget times all words; a target stops at most
    times its source's size and the excess is shared again by weight, until none is above: each turn is one pass of sums
    over the sources.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    numbered = ordinals(total, F.col("source").asc_nulls_last(), "source_no")
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    weighed = numbered.withColumns({"weight": weight, "cap": most * F.col("source_size")})
    words = budget * (weighed.agg(F.sum("source_size")).first()[0] or 0)
    level, before = 0.0, None
    while level != before:
        over = F.col("cap") < F.lit(level) * F.col("weight")
        capped, free = weighed.agg(F.sum(F.when(over, F.col("cap")).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight")))).first()
        before, level = level, (words - capped) / free if free else level
    target = F.least("cap", F.lit(level) * F.col("weight"))
    out = staged(weighed.select("source", "source_no", "source_size", "rows", target.alias("target")))
    unstaged(numbered)
    return out


def _slots(sources: DataFrame, block: int) -> DataFrame:
    """sources with full (blocks of full length), blocks, passes, rest (words of the last pass) and slots."""
    size, wanted = F.col("source_size"), F.round("target").cast("long")
    return (
        sources.withColumn("full", F.expr(f"source_size div {block}"))
        .withColumn("blocks", F.ceil(size / block))
        .withColumn("passes", F.when(size > 0, F.floor(wanted / size)).otherwise(0))
        .withColumn("rest", wanted - F.col("passes") * size)
        .withColumn("slots", F.col("passes") * F.col("blocks") + F.ceil(F.col("rest") / block))
    )


def draw_counts(n: int, shards: int, *key: int) -> tuple[np.ndarray, np.ndarray]:
    """(shards that get any, how many) of n slots: a multinomial draw with equal chances, the same for the same key."""
    drawn = np.random.default_rng([abs(x) for x in key]).integers(0, shards, n)
    return np.unique(drawn, return_counts=True)


@F.pandas_udf(ArrayType(StructType([StructField(x, LongType()) for x in ("shard", "first", "n")])))
def _ranges(first: pd.Series, n: pd.Series, shards: pd.Series, key: pd.Series) -> pd.Series:
    """The slots first to first + n - 1 dealt to shards: ranges of slots."""
    out = []
    for start, size, most, own in zip(first, n, shards, key, strict=True):
        where, counts = draw_counts(int(size), int(most), SEED, int(own))
        at = int(start) + np.cumsum(counts) - counts
        out.append([{"shard": int(a), "first": int(b), "n": int(c)} for a, b, c in zip(where, at, counts, strict=True)])
    return pd.Series(out, dtype=object)


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray, rounds: int = 4) -> np.ndarray:
    """The places of index under pseudorandom permutations of range(n), one for each key: a Feistel network, walked until it is below n."""
    bits = np.maximum(1, np.ceil(np.log2(np.maximum(n, 2)) / 2)).astype(np.uint64)
    mask = (np.uint64(1) << bits) - np.uint64(1)

    def once(x: np.ndarray, at: np.ndarray) -> np.ndarray:
        high, low = x >> bits[at], x & mask[at]
        for r in range(rounds):
            mixed = (low + key[at] + np.uint64(r + 1)) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            high, low = low, high ^ ((mixed >> np.uint64(32)) & mask[at])
        return (high << bits[at]) | low

    out, at = index.astype(np.uint64), np.arange(len(index))
    with np.errstate(over="ignore"):
        while len(at):
            out[at] = once(out[at], at)
            at = at[out[at] >= n[at].astype(np.uint64)]
    return out.astype(np.int64)


@F.pandas_udf(LongType())
def _permuted(index: pd.Series, n: pd.Series, key: pd.Series) -> pd.Series:
    return pd.Series(permuted(index.to_numpy("int64"), n.to_numpy("int64"), key.to_numpy("int64").view("uint64")))


def mix_slots(sources: DataFrame, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """One row (shard, source_no, slot, block, take) for each slot of the mix: the first take words of that block."""
    planned = staged(_slots(sources, block))
    shards = max(1, -(-(planned.agg(F.sum("slots")).first()[0] or 0) // SHARD_SLOTS))
    chunks = planned.where("slots > 0").select("*", F.explode(F.expr(f"sequence(0L, (slots - 1) div {CHUNK})")).alias("chunk")).repartition("source_no", "chunk")
    first = F.col("chunk") * CHUNK
    own = F.xxhash64(F.lit(seed), F.coalesce(F.col("source"), F.lit("\0null")), F.lit("shard"), F.col("chunk"))
    ranges = chunks.select("*", F.explode(_ranges(first, F.least(F.lit(CHUNK), F.col("slots") - first), F.lit(shards), own)).alias("r")).select(*planned.columns, "r.*")
    slots = (
        ranges.select("*", F.explode(F.expr("sequence(first, first + n - 1)")).alias("slot"))
        .withColumn("turn", F.expr("slot div blocks"))
        .withColumn("index", F.expr("slot % blocks"))
    )
    key = F.xxhash64(F.lit(seed), F.coalesce(F.col("source"), F.lit("\0null")), F.col("turn"))
    whole = F.greatest("full", F.lit(1))  # the permutation is evaluated for the tail block too, so its input stays in range
    place = F.when(F.col("index") < F.col("full"), _permuted(F.least("index", whole - 1), whole, key)).otherwise(F.col("index"))
    held = F.least(F.lit(block), F.col("source_size") - F.col("index") * block)
    take = F.when(F.col("turn") < F.col("passes"), held).otherwise(F.least(held, F.col("rest") - F.col("index") * block))
    return slots.select("shard", "source_no", "slot", place.alias("block"), take.cast("long").alias("take"))


def pieces(rows: DataFrame, n_rows: int, block: int = BLOCK) -> DataFrame:
    """rows (row, source_no, size, tie columns) cut at block borders: row, source_no, block, from (word of the document), at and n (words in the block).

    Offsets within a source come from sums on three levels, so that no task sees a whole source. Rows without words give one
    piece with a null block.
    """
    side = max(1, int(np.ceil(np.sqrt(n_rows / BUCKET_ROWS))))
    placed = rows.withColumn("fine", F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(side * side))).withColumn("coarse", F.expr(f"fine div {side}"))
    by_fine = placed.groupBy("source_no", "coarse", "fine").agg(F.sum("size").alias("words"))
    before = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    by_coarse = by_fine.groupBy("source_no", "coarse").agg(F.sum("words").alias("words"))
    by_coarse = by_coarse.select("source_no", "coarse", F.coalesce(F.sum("words").over(before("source_no").orderBy("coarse")), F.lit(0)).alias("coarse_at"))
    by_fine = by_fine.select("source_no", "coarse", "fine", F.coalesce(F.sum("words").over(before("source_no", "coarse").orderBy("fine")), F.lit(0)).alias("fine_at"))
    starts = by_fine.join(by_coarse, ["source_no", "coarse"]).select("source_no", "fine", (F.col("coarse_at") + F.col("fine_at")).alias("bucket_at"))
    own = F.coalesce(F.sum("size").over(before("source_no", "fine").orderBy("doc_id", "text_hash", "row")), F.lit(0))
    offset = placed.withColumn("own", own).join(starts, ["source_no", "fine"]).withColumn("offset", F.col("bucket_at") + F.col("own"))
    last = F.expr(f"(offset + size - 1) div {block}")
    cut = offset.select("row", "source_no", "size", "offset", F.explode_outer(F.when(F.col("size") > 0, F.sequence(F.expr(f"offset div {block}"), last))).alias("block"))
    begin, end = F.greatest("offset", F.col("block") * block), F.least(F.col("offset") + F.col("size"), (F.col("block") + 1) * block)
    return cut.select("row", "source_no", "block", (begin - F.col("offset")).alias("from"), (begin - F.col("block") * block).alias("at"), (end - begin).alias("n"))


def taken_in(at: Column, n: Column, takes: Column) -> Column:
    """Words of a piece that the takes of its block reach."""
    return F.aggregate(takes, F.lit(0).cast("long"), lambda total, take: total + F.greatest(F.lit(0), F.least(n, take - at)))


def _prepared(docs: DataFrame, id_col: str, text_col: str, source_col: str, keep: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """docs numbered and staged (row, doc_id, source, size, text_hash and keep), its sources with targets, and (row, ..., source_no, source_size, target)."""
    numbered = staged(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(id_col).alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            word_count(F.col(text_col)).alias("size"),
            F.xxhash64(text_col).alias("text_hash"),
            *[F.col(x).alias(f"kept_{x}") for x in keep],
        )
    )
    sources = source_targets(numbered.select("source", "size"))
    named = lambda df: df.withColumn("_name", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null")))
    slim = named(numbered.select("row", "doc_id", "source", "size", "text_hash")).drop("source")
    placed = staged(hot_join(slim, named(sources).drop("source"), ["_name"], F.col("row"), count="rows", total=numbered.count()).drop("_name", "rows"))
    return numbered, sources, placed


def _plan(placed: DataFrame, sources: DataFrame, block: int, seed: int) -> DataFrame:
    """The pieces of all documents, with the takes of their blocks (null: none)."""
    uses = mix_slots(sources, block, seed).groupBy("source_no", "block").agg(F.collect_list("take").alias("takes"))
    cut = pieces(placed.select("row", "doc_id", "source_no", "size", "text_hash"), max(1, placed.count()), block)
    # as many rows as blocks: shuffled, whatever they compress to (equal takes compress so well that Spark would broadcast them)
    return cut.join(uses.hint("merge"), ["source_no", "block"], "left")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """One row (doc_id, size, source_size, target, taken) for each row of docs.

    size: words of the text, null texts have none; source_size and target are its source's; taken: words that the mix takes
    from the row, repeats counted, at most twice its size. Null sources are one source, the last. Repeated rows are mixed
    each on its own; an empty table gives an empty one; other columns are not read, so their names cannot clash.
    """
    _, sources, placed = _prepared(docs, id_col, text_col, source_col, [])
    takes = _plan(placed, sources, block, seed)
    taken = takes.groupBy("row").agg(F.sum(F.coalesce(taken_in(F.col("at"), F.col("n"), F.col("takes")), F.lit(0))).alias("taken"))
    # merged by row, so that reruns give the rows in the same order too
    return placed.join(taken.hint("merge"), "row").select("doc_id", "size", "source_size", "target", "taken")


@F.pandas_udf(ArrayType(StringType()))
def _copies(text: pd.Series, parts: pd.Series) -> pd.Series:
    """The texts that a document gives to the mix: for each copy the words that its blocks take, whole texts unchanged."""
    import re

    word = re.compile(WORD)
    out = []
    for whole, own in zip(text, parts, strict=True):
        own = sorted((int(x["from"]), int(x["at"]), int(x["n"]), sorted(x["takes"], reverse=True)) for x in own)
        size, spans, copies = sum(x[2] for x in own), None, []
        for turn in range(max((len(x[3]) for x in own), default=0)):
            ranges: list[list[int]] = []
            for begin, at, n, takes in own:
                n = min(n, max(0, int(takes[turn]) - at)) if len(takes) > turn else 0
                if n and ranges and ranges[-1][1] == begin:
                    ranges[-1][1] = begin + n
                elif n:
                    ranges.append([begin, begin + n])
            if ranges == [[0, size]]:
                copies.append(whole)
            elif ranges:
                spans = spans or [m.span() for m in word.finditer(whole)]
                copies.append(" ".join(whole[spans[a][0] : spans[b - 1][1]] for a, b in ranges))
        out.append(copies)
    return pd.Series(out, dtype=object)


def mixed_documents(docs: DataFrame, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """The mix as documents: a row for each copy that a document gives, with the columns of docs; n_chars is the new text's."""
    small_batches(docs.sparkSession)
    numbered, sources, placed = _prepared(docs, "doc_id", "text", "source", docs.columns)
    parts = (
        _plan(placed, sources, block, seed)
        .groupBy("row")
        .agg(F.collect_list(F.struct("from", "at", "n", F.coalesce("takes", F.array().cast("array<bigint>")).alias("takes"))).alias("parts"))
    )
    given = numbered.where("size > 0").join(parts, "row").withColumn("copy", F.explode(_copies("kept_text", "parts")))
    new = {"text": F.col("copy"), "n_chars": F.length("copy").cast("long")}
    return given.select(*[new.get(x, F.col(f"kept_{x}")).alias(x) for x in docs.columns])


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
