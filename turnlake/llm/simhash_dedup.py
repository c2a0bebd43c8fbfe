"""Near-duplicate documents by SimHash fingerprints and multi-index hashing.

A fingerprint is 64 bits over a document's word shingles. Fingerprints that differ in at most RADIUS bits are found
through tables, one for each segment of the bits: if two fingerprints differ in at most r bits and are cut into m
segments, with r = m * s + a, they differ in at most s bits within one of the first a + 1 segments or in at most s - 1
within one of the others. So each fingerprint asks each table for its own segment and for the segments in a Hamming ball
of that small radius, and the whole distance is verified on what the table returns.

Only distinct fingerprints are compared, so groups of exact copies cost one row. Links of distance one are joined into
groups first, and the wider search skips pairs within such a group: the components stay the same, while a dense cloud of
near copies does not give all its pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from turnlake.llm.shared import connected_components, hot_join, small_batches, staged, unstaged

SEED = 42
SHINGLE = 4
RADIUS = 4
#: Shingles whose bits are counted at once.
BLOCK = 1 << 16
#: Segments of a fingerprint. Three ask 45 places of tables of 2^21 buckets; two ask 562 of tables of 2^32 buckets, which pays
#: from some 10^8 distinct fingerprints on. The links are the same.
SEGMENTS = 3


def fingerprint(text: str | None, width: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of one text, as a signed 64-bit number: a bit is set if it is set in over half of the shingles' hashes."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    starts = np.zeros(len(words), np.int64)
    np.cumsum([len(x) + 1 for x in words[:-1]], out=starts[1:])
    ends = np.append(starts[1:] - 1, len(joined))
    n = max(1, len(words) - width + 1)
    starts, ends = starts[:n].tolist(), ends[min(width, len(words)) - 1 :].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        hashes = np.array([digest(joined[x:y], seed) for x, y in zip(starts[at : at + BLOCK], ends[at : at + BLOCK], strict=True)], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


@F.pandas_udf(LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(x) for x in texts], dtype="int64")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (doc_id, fp) for each row of docs; null and wordless texts have fingerprint 0."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), _fingerprints(F.col(text_col).cast("string")).alias("fp"))


def _segments(radius: int, parts: int) -> list[tuple[int, int, int]]:
    """(first bit, width, radius of the ball) of each segment; segments with no ball are left out."""
    small, rest = divmod(radius, parts)
    cuts = [round(64 * i / parts) for i in range(parts + 1)]
    found = [(cuts[i], cuts[i + 1] - cuts[i], small if i <= rest else small - 1) for i in range(parts)]
    return [x for x in found if x[2] >= 0]


def _key(fp: str, first: int, width: int) -> Column:
    return F.shiftrightunsigned(F.col(fp), first).bitwiseAND(F.lit((1 << width) - 1))


def _near_in(a: str, b: str, segment: tuple[int, int, int]) -> Column:
    first, width, radius = segment
    return F.bit_count(_key(a, first, width).bitwiseXOR(_key(b, first, width))) <= radius


def hamming_links(found: DataFrame, radius: int, parts: int, group: str | None = None) -> DataFrame:
    """Pairs (a, b) of the distinct fingerprints in column fp that differ in 1 to radius bits, each pair once.

    With group, pairs of equal groups are left out. A pair is emitted by the first segment that finds it, and by the side
    whose lowest differing bit of that segment is 0.
    """
    segments = _segments(radius, parts)
    extra = [group] if group else []
    table = found.select(
        F.col("fp").alias("b"),
        *[F.col(x).alias("group_b") for x in extra],
        F.explode(F.array(*[F.struct(F.lit(i).alias("segment"), _key("fp", s[0], s[1]).alias("key")) for i, s in enumerate(segments)])).alias("t"),
    ).select("b", *["group_b"] * len(extra), "t.segment", "t.key")
    masks = [
        (i, sum(1 << bit for bit in bits), 1 << min(bits) if bits else 0)
        for i, (_, width, ball) in enumerate(segments)
        for size in range(ball + 1)
        for bits in combinations(range(width), size)
    ]
    whole = F.element_at(F.array(*[_key("fp", s[0], s[1]) for s in segments]), F.col("m.segment") + 1)
    asked = (
        found.select("fp", *extra, F.explode(F.array(*[F.struct(F.lit(i).alias("segment"), F.lit(m).cast("long").alias("mask"), F.lit(low).cast("long").alias("low")) for i, m, low in masks])).alias("m"))
        .select(F.col("fp").alias("a"), *[F.col(x).alias("group_a") for x in extra], "m.segment", "m.mask", "m.low", whole.alias("own"))
        .where(F.col("own").bitwiseAND(F.col("low")) == 0)
        .select("a", *["group_a"] * len(extra), "segment", (F.col("mask") == 0).alias("same"), F.col("own").bitwiseXOR(F.col("mask")).alias("key"))
    )
    before = F.lit(True)
    for i, s in enumerate(segments[:-1]):
        before = before & ((F.col("asked.segment") <= i) | ~_near_in("a", "b", s))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).between(1, radius)
    order = ~F.col("same") | (F.col("a") < F.col("b"))
    on = (F.col("asked.segment") == F.col("held.segment")) & (F.col("asked.key") == F.col("held.key")) & near & order & before
    if group:
        on = on & (F.col("group_a") != F.col("group_b"))
    return asked.alias("asked").join(table.alias("held"), on).select("a", "b")


def _components(each: DataFrame, least: Column, radius: int, segments: int) -> DataFrame:
    """One row (fp, first, n) for each fingerprint of each (staged): the least `least` of its component and its number of rows."""
    distinct = staged(each.groupBy("fp").agg(F.min(least).alias("least"), F.count("*").alias("n")))
    close = connected_components(hamming_links(distinct, 1, segments))
    grouped = staged(
        distinct.join(close.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("near"), "least", "n")
    )
    wide = hamming_links(grouped, radius, segments, "near")
    ends = wide.join(grouped.select(F.col("fp").alias("a"), F.col("near").alias("near_a")), "a").join(
        grouped.select(F.col("fp").alias("b"), F.col("near").alias("near_b")), "b"
    )
    far = connected_components(ends.select("near_a", "near_b"), "near_a", "near_b")
    joined = staged(grouped.join(far.withColumnRenamed("node", "near"), "near", "left").select("fp", "least", "n", F.coalesce("component", "near").alias("component")))
    firsts = staged(joined.groupBy("component").agg(F.min("least").alias("first"), F.count("*").alias("prints")))
    total = joined.count()
    named = staged(hot_join(joined, firsts, ["component"], F.col("fp"), count="prints", total=total).select("fp", "first", "n"))
    unstaged(distinct, grouped, joined, firsts)
    return named


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, segments: int = SEGMENTS) -> DataFrame:
    """One row (doc_id, fp, component_id) for each row of docs.

    component_id is the smallest doc_id reachable through links between fingerprints that differ in at most radius bits,
    the document itself included. Null texts and texts without words have fingerprint 0 and link like any other. Null
    ids keep their row and count as larger than any id (component_id is null only where a component has no other). Equal
    rows stay equal rows; an empty table gives an empty one; other columns are not read, so their names cannot clash.
    """
    each = staged(fingerprints(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    named = _components(each, F.col("doc_id"), radius, segments)
    return hot_join(each, named, ["fp"], F.col("row"), count="n", total=each.count()).select("doc_id", "fp", F.col("first").alias("component_id"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, segments: int = SEGMENTS) -> DataFrame:
    """docs with one row of each component: that of the least id, null ids last; of several rows of one id the one read first.

    So repeated rows leave one, and rows without an id go where another of their component stays. Columns stay as they are.
    """
    small_batches(docs.sparkSession)
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(x) for x in docs.columns]).alias("kept"), _fingerprints(F.col(text_col).cast("string")).alias("fp"))
    numbered = staged(numbered)
    each = numbered.select("row", F.struct(F.col(f"kept.{id_col}").isNull(), F.col(f"kept.{id_col}"), "row").alias("order"), "fp")
    named = _components(each, F.col("order"), radius, segments)
    gone = hot_join(each.select("row", "fp"), named, ["fp"], F.col("row"), count="n", total=each.count()).where(F.col("row") != F.col("first.row")).select("row")
    return numbered.join(gone, "row", "left_anti").select("kept.*")


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
