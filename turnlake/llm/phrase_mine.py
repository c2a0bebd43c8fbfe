"""Phrase collocations by hash-filtered level-wise counting (PCY and DHP).

Words become 64-bit hashes, checked to be distinct over the whole corpus (another seed is tried if two words share one),
and every text a row of hashes with breaks between pieces. Pass k reads these rows once: it counts exactly those phrases
of k words whose bucket was frequent in the pass before and whose two parts of k - 1 words are frequent, and counts the
buckets of those phrases of k + 1 words that can still be. Buckets and frequent phrases go to the next pass as bitmaps of
a fixed size; they only ever let too many phrases through, and exact counts decide.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnlake.llm.shared import SALTS, hot_join, small_batches, staged, unstaged

#: Least count of a candidate, words of the longest one, percent of a candidate's count from which a longer one takes its place, rows for each language.
SUPPORT, LONGEST, ABSORBED, TOP = 100, 5, 100, 2000
#: Bits of a bitmap: as many as give a bucket SPARE-th of the support on average, within these bounds; bitmaps are at most 8 MB.
SPARE, LEAST_BITS, MOST_BITS = 8, 1 << 18, 1 << 26
#: Buckets in a row of counts, words that a task holds before it sums them up, and sums that it holds before it hands them on.
BLOCK, WORDS_AT_ONCE, SUMS_AT_ONCE = 1 << 13, 1_000_000, 1_000_000
#: Parts, for each shuffle partition, in which tasks hand their sums on.
PARTS = 2
#: What parts pieces, and what parts the words of one.
PIECES, WORD = r"[.,;:!?\x0A-\x0D]", r"[^\x20\x09]+"
UNKNOWN = "und"


def pieces(text: Column) -> Column:
    """The pieces of a text with A-Z in lower case, each an array of words; null counts as empty."""
    lower = F.translate(F.coalesce(text.cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.transform(F.split(lower, PIECES, -1), lambda x: F.regexp_extract_all(x, F.lit(WORD), F.lit(0)))


def word_counts(docs: DataFrame) -> DataFrame:
    """Exact counts (lang, word, n) of the words of docs (lang, text)."""
    return docs.select("lang", F.explode(F.flatten(pieces(F.col("text")))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))


def word_hash(word: Column, seed: int) -> Column:
    return F.xxhash64(word, F.lit(seed))


def distinct_seed(counts: DataFrame) -> int:
    """The first seed under which no two words of counts share a hash and none has that of a break, 0."""
    for seed in range(64):
        shared = counts.groupBy(word_hash(F.col("word"), seed).alias("h")).agg((F.min("word") != F.max("word")).alias("shared")).where("shared or h = 0")
        if not shared.limit(1).count():
            return seed
    raise ValueError("every seed lets two words share a hash")


def hashed_texts(docs: DataFrame, seed: int) -> DataFrame:
    """docs (lang, text) as (lang, hashes), a 0 after each piece; pieces of one word can hold no phrase and are left out."""
    long = F.filter(pieces(F.col("text")), lambda x: F.size(x) > 1)
    hashes = F.flatten(F.transform(long, lambda x: F.concat(F.transform(x, lambda y: word_hash(y, seed)), F.array(F.lit(0).cast("long")))))
    return docs.select("lang", hashes.alias("hashes")).where(F.size("hashes") > 0)


# Hashes of phrases. Arithmetic wraps around.

ODD, SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(29)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> SHIFT)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def phrase_hashes(words: np.ndarray, langs: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the k words from each place on, with the language; the last k - 1 places have none."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    own = langs[:n].copy()
    for i in range(k):
        own = mixed(own * ODD + words[i : i + n])
    return own


def lang_hash(lang: str) -> np.uint64:
    return mixed(np.array([int.from_bytes(lang.encode()[:8].ljust(8, b"\0"), "little") ^ len(lang)], dtype=np.uint64) + ODD)[0]


class Bits:
    """A bitmap of a power of two bits, from the number of each frequent bucket."""

    def __init__(self, data: bytes):
        self.bits = np.frombuffer(data, np.uint8)
        self.mask = np.uint64(len(data) * 8 - 1)

    def __getitem__(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & self.mask
        return (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def bitmap(rows: DataFrame, size: int) -> bytes:
    """size bits from rows (block, bits), each with BLOCK of them; what the driver gets is size bits at most, whatever the rows stand for."""
    out = bytearray(size // 8)
    for block, bits in rows.collect():
        out[block * BLOCK // 8 : block * BLOCK // 8 + len(bits)] = bits
    return bytes(out)


def frequent_bits(frequent: DataFrame, k: int, size: int) -> bytes:
    """Bitmap of exactly frequent phrases (lang, w1..wk), by the hash that passes use."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(size // 8, dtype=np.uint8)
        for batch in batches:
            if batch.num_rows:
                words = np.stack([batch.column(i + 1).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(k)])
                codes = batch.column(0).dictionary_encode()
                hashes = np.array([lang_hash(x) for x in codes.dictionary.to_pylist()], dtype=np.uint64)[codes.indices.to_numpy(zero_copy_only=False)]
                for i in range(k):
                    hashes = mixed(hashes * ODD + words[i])
                at = hashes & np.uint64(size - 1)
                np.bitwise_or.at(own, at >> np.uint64(3), (1 << (at & np.uint64(7))).astype(np.uint8))
        yield from _set_blocks(own)

    made = frequent.select("lang", *[f"w{i + 1}" for i in range(k)]).mapInArrow(blocks, "block int, bits binary")
    return bitmap(summed(made, "bits", np.uint8, lambda total, x: total | x, lambda total: total), size)


def _set_blocks(own: np.ndarray) -> Iterator[pa.RecordBatch]:
    whole = own.reshape(-1, BLOCK // 8)
    some = np.flatnonzero(whole.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([whole[i].tobytes() for i in some], pa.binary())], names=["block", "bits"])


def summed(blocks: DataFrame, column: str, kind: type, add: Callable, finish: Callable) -> DataFrame:
    """blocks (block, column) put together: one row (block, bits) for each block; a task holds one array for each of its blocks, however many rows it reads."""

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                values = np.frombuffer(data, kind)
                totals[block] = add(totals[block], values) if block in totals else values
        for block, total in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([finish(total).tobytes()], pa.binary())], names=["block", "bits"])

    return blocks.select("block", column).repartition("block").mapInArrow(together, "block int, bits binary")


class Sums:
    """Counts of phrases of k words that a task holds, in parts that are each summed up by hash, language and words."""

    def __init__(self, k: int):
        self.k, self.langs, self.parts, self.size = k, [], [], 0

    def codes(self, langs: list[str]) -> np.ndarray:
        """Numbers of languages, from 0 in the order of their coming."""
        for x in langs:
            if x not in self.langs:
                self.langs.append(x)
        return np.array([self.langs.index(x) for x in langs], dtype=np.int32)

    def add(self, hashes: np.ndarray, langs: np.ndarray, words: np.ndarray, counts: np.ndarray) -> None:
        """Equal phrases lie side by side after sorting by hash; where two phrases share a hash, words and languages decide as well."""
        order = np.argsort(hashes, kind="stable")
        differ = (langs[order][1:] != langs[order][:-1]) | (words[:, order][:, 1:] != words[:, order][:, :-1]).any(axis=0)
        if (differ & (hashes[order][1:] == hashes[order][:-1])).any():
            order = np.lexsort((langs, *words, hashes))
        hashes, langs, words = hashes[order], langs[order], words[:, order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (langs[1:] != langs[:-1]) | (words[:, 1:] != words[:, :-1]).any(axis=0)
        first = np.flatnonzero(new)
        if len(first):
            self.parts.append((hashes[first], langs[first], words[:, first], np.add.reduceat(counts[order], first)))
            self.size += len(first)

    def merged(self) -> Sums:
        if len(self.parts) > 1:
            hashes, langs, words, counts = (np.concatenate(x, axis=-1) for x in zip(*self.parts, strict=True))
            self.parts, self.size = [], 0
            self.add(hashes, langs, words, counts)
        return self

    def packed(self, parts: int) -> Iterator[dict]:
        """Rows (part, langs, data) by the phrases' hashes, which are the same in every task: a row holds all sums of a part, compressed."""
        for hashes, langs, words, counts in self.parts:
            own = ((hashes >> np.uint64(40)) % np.uint64(parts)).astype(np.int32)
            order = np.argsort(own, kind="stable")
            cuts = [0, *(np.flatnonzero(np.diff(own[order])) + 1).tolist(), len(order)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                some = order[i:j]
                whole = np.vstack([hashes[some], langs[some].astype(np.uint64), words[:, some], counts[some].astype(np.uint64)])
                yield {"part": int(own[some[0]]), "langs": self.langs, "data": zstandard.compress(whole.tobytes(), 1)}

    def unpack(self, langs: list[str], data: bytes) -> None:
        """Add what packed() gave of another task."""
        whole = np.frombuffer(zstandard.decompress(data), np.uint64).reshape(self.k + 3, -1)
        self.add(whole[0], self.codes(langs)[whole[1].astype(np.int64)], whole[2:-1], whole[-1].astype(np.int64))


def phrase_counts(passed: DataFrame, k: int, support: int) -> DataFrame:
    """The phrases (lang, w1..wk, f) that the tasks of one_pass() counted support times or more together; parts are dealt over tasks and put together as they come."""
    schema = pa.schema([("lang", pa.string()), *[(f"w{i + 1}", pa.int64()) for i in range(k)], ("f", pa.int64())])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Sums] = {}
        for batch in batches:
            for part, langs, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                own = held.setdefault(part, Sums(k))
                own.unpack(langs, data)
                if len(own.parts) >= 16:
                    own.merged()
        for own in held.values():
            names = pa.array(own.langs, pa.string())
            for _, langs, words, counts in own.merged().parts:
                some = np.flatnonzero(counts >= support)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(langs[some])), *[pa.array(words[i][some].view(np.int64)) for i in range(k)], pa.array(counts[some])], schema=schema)

    packs = passed.where("part is not null").select("part", "langs", "data")
    return packs.repartition("part").mapInArrow(together, f"lang string, {', '.join(f'w{i + 1} long' for i in range(k))}, f long")


def one_pass(texts: DataFrame, k: int, support: int, size: int, below: bytes, buckets: bytes | None, last: bool) -> DataFrame:
    """One pass over texts: rows (part, langs, data) with packed counts of phrases of k words, and rows (block, counts) of the buckets of k + 1 words.

    below: bitmap of the frequent phrases of k - 1 words (of single words for k = 1, where nothing is counted exactly);
    buckets: that of the frequent buckets of k words. Counts of a bucket stop at the support: a bucket whose sum of such
    counts reaches it is frequent, and the other way round.
    """
    spark = texts.sparkSession
    sent = spark.sparkContext.broadcast((below, buckets))
    parts = PARTS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = pa.schema([("part", pa.int32()), ("langs", pa.list_(pa.string())), ("data", pa.binary()), ("block", pa.int32()), ("counts", pa.binary())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        under, own = (x and Bits(x) for x in sent.value)
        counts = np.zeros(0 if last else size, dtype=narrow(support))
        sums, held, n = Sums(k), [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch.column(1).values) if batch.num_rows else 0
            if n >= WORDS_AT_ONCE:
                flush(held, under, own, counts, sums)
                held, n = [], 0
                if sums.size >= SUMS_AT_ONCE and sums.merged().size >= SUMS_AT_ONCE // 2:
                    yield from (pa.RecordBatch.from_pylist([x], schema=schema) for x in sums.packed(parts))
                    sums = Sums(k)
        if n:
            flush(held, under, own, counts, sums)
        yield from (pa.RecordBatch.from_pylist([x], schema=schema) for x in sums.merged().packed(parts))
        blocks = counts.reshape(-1, BLOCK)
        for i in np.flatnonzero(blocks.any(axis=1)):
            yield pa.RecordBatch.from_pylist([{"block": int(i), "counts": blocks[i].tobytes()}], schema=schema)

    def flush(held: list[pa.RecordBatch], under: Bits, own: Bits | None, counts: np.ndarray, sums: Sums) -> None:
        table = pa.Table.from_batches(held).combine_chunks()
        lists = table.column(1).combine_chunks()
        words = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        codes = table.column(0).combine_chunks().dictionary_encode()
        lang_of = np.repeat(sums.codes(codes.dictionary.to_pylist())[codes.indices.to_numpy(zero_copy_only=False)], np.diff(lists.offsets.to_numpy()))
        langs = np.array([lang_hash(x) for x in sums.langs], dtype=np.uint64)[lang_of]
        if k == 1:
            live = (words != 0) & under[phrase_hashes(words, langs, 1)]
        else:
            parts = phrase_hashes(words, langs, k - 1)
            frequent = under[parts]
            for i in range(k - 1):
                frequent &= words[i : i + len(frequent)] != 0
            live = frequent[:-1] & frequent[1:]
            hashes = phrase_hashes(words, langs, k)
            live &= own[hashes]
            at = np.flatnonzero(live)
            sums.add(hashes[at], lang_of[at], np.stack([words[at + i] for i in range(k)]), np.ones(len(at), dtype=np.int64))
        if not last:
            both = np.flatnonzero(live[:-1] & live[1:])
            found, times = np.unique(phrase_hashes(words, langs, k + 1)[both] & np.uint64(size - 1), return_counts=True)
            counts[found] = np.minimum(counts[found] + times, support)

    return texts.mapInArrow(scan, "part int, langs array<string>, data binary, block int, counts binary")


def frequent_phrases(docs: DataFrame, support: int, longest: int, size: int | None = None) -> tuple[dict[int, DataFrame], DataFrame, list[DataFrame]]:
    """(for each number of words the exactly frequent phrases (lang, w1.., f), words (lang, word, n, h) of all counts, staged tables to remove at the end)."""
    counts = staged(word_counts(docs))
    seed = distinct_seed(counts)
    words = counts.withColumn("h", word_hash(F.col("word"), seed))
    texts = staged(hashed_texts(docs, seed))
    total = counts.agg(F.sum("n")).first()[0] or 0
    size = size or min(MOST_BITS, max(LEAST_BITS, 1 << (total * SPARE // support).bit_length()))
    found = {1: staged(words.where(F.col("n") >= support).select("lang", F.col("h").alias("w1"), F.col("n").alias("f")))}
    below, buckets, kept = frequent_bits(found[1], 1, size), None, [counts, texts, found[1]]
    for k in range(1, longest + 1):
        passed = staged(one_pass(texts, k, support, size, below, buckets, k == longest))
        if k > 1:
            found[k] = staged(phrase_counts(passed, k, support))
            kept.append(found[k])
        if k < longest:
            buckets = frequent_buckets(passed.where("block is not null"), support, size)
            below = frequent_bits(found[k], k, size)
        unstaged(passed)
    return found, words, kept


def frequent_buckets(blocks: DataFrame, support: int, size: int) -> bytes:
    """Bitmap of the buckets whose counts, stopped at the support in every task, reach it together."""
    kind = narrow(support)

    def add(total: np.ndarray, x: np.ndarray) -> np.ndarray:
        return np.minimum(total.astype(np.uint64) + x, support).astype(kind)

    return bitmap(summed(blocks, "counts", kind, add, lambda total: np.packbits(total >= support, bitorder="little")), size)


def narrow(support: int) -> type:
    """The smallest kind of number that holds counts up to the support."""
    return np.uint8 if support < 1 << 8 else np.uint32 if support < 1 << 32 else np.uint64


def scores(found: dict[int, DataFrame], totals: DataFrame, absorbed: int) -> DataFrame:
    """Candidates (lang, w, a, l, r, n, score) from the frequent phrases of each length, without those that a longer one absorbs.

    Every part of a frequent phrase is frequent, so l and r are looked up there; first words that many phrases share, and
    languages, are dealt over tasks. A phrase that is absorbed by one two words longer is so by one of one word more.
    """
    all_of = reduce(DataFrame.unionByName, [x.select("lang", F.array(*[f"w{i + 1}" for i in range(k)]).alias("w"), "f") for k, x in found.items()])
    phrases = staged(all_of)
    longer = phrases.where(F.size("w") > 2)
    sides = longer.select("lang", F.explode(F.array(F.expr("slice(w, 1, size(w) - 1)"), F.expr("slice(w, 2, size(w) - 1)"))).alias("w"), "f")
    over = sides.groupBy("lang", "w").agg(F.max("f").alias("over"))
    own = phrases.where(F.size("w") > 1).join(over, ["lang", "w"], "left").where(F.coalesce(F.col("over") * 100 < F.col("f") * absorbed, F.lit(True)))
    cuts = own.select("lang", "w", F.col("f").alias("a"), F.explode(F.expr("sequence(1, size(w) - 1)")).alias("k"))
    cuts = cuts.withColumns({"first": F.expr("slice(w, 1, k)"), "rest": F.expr("slice(w, k + 1, size(w) - k)")})
    with_first = hot_join(cuts, phrases.select("lang", F.col("w").alias("first"), F.col("f").alias("l")), ["lang", "first"], F.xxhash64("w", "k"))
    with_both = hot_join(with_first, phrases.select("lang", F.col("w").alias("rest"), F.col("f").alias("r")), ["lang", "rest"], F.xxhash64("w", "k"))
    score = F.expr("cast(1000 as decimal(4,0)) * cast(a as decimal(15,0)) * cast(n as decimal(17,0)) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")
    scored = hot_join(with_both, totals, ["lang"], F.xxhash64("w", "k")).withColumn("score", score)
    least = scored.groupBy("lang", "w").agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("x"))
    out = staged(least.select("lang", "w", "x.a", "x.l", "x.r", "x.n", "x.score"))
    unstaged(phrases)
    return out


def first_of(rows: DataFrame, order: list[Column], by: Column, top: int) -> DataFrame:
    """The first rows of each language with their rank: first over SALTS parts of a language, then over what these leave."""
    salt = F.pmod(F.xxhash64(by), F.lit(SALTS))
    part = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", salt).orderBy(*order))).where(F.col("rank") <= top)
    return part.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)


def ranked(scored: DataFrame, words: DataFrame, top: int) -> DataFrame:
    """The first `top` rows of each language by score and a, descending, then phrase; words are looked up for the rows that can be among them."""
    by_score = [F.desc("score"), F.desc("a")]
    last = first_of(scored.select("lang", "score", "a", "w"), by_score, F.col("w"), top).where(F.col("rank") == top)
    last = last.select("lang", F.col("score").alias("last_score"), F.col("a").alias("last_a"))
    enough = F.col("last_score").isNull() | (F.col("score") > F.col("last_score")) | ((F.col("score") == F.col("last_score")) & (F.col("a") >= F.col("last_a")))
    near = hot_join(scored, last, ["lang"], F.xxhash64("w"), "left").where(enough)
    each = near.select("lang", "w", F.posexplode("w").alias("place", "h"))
    named = hot_join(each, words.select("lang", "h", "word"), ["lang", "h"], F.xxhash64("w", "place"))
    phrase = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]), " ")
    spelled = near.join(named.groupBy("lang", "w").agg(phrase.alias("phrase")), ["lang", "w"])
    best = first_of(spelled, [*by_score, F.asc("phrase")], F.col("phrase"), top)
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def mine(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, absorbed: int = ABSORBED, top: int = TOP, text_col: str = "text", lang_col: str = "lang", bits: int | None = None) -> DataFrame:
    """The best collocations of each language: lang, rank, phrase, a, l, r, n, score.

    Candidates are phrases of 2 to `longest` words within pieces that occur at least `support` times in texts of their
    language (null: und). A cut into the first k words and the rest, which occur l and r times, scores floor(1000 * a *
    n / (l * r)), n being the language's words; the lowest-scoring cut counts, ties to the smallest k. Candidates inside
    a longer one with at least `absorbed` percent of their count are dropped. Products are exact decimals. bits: size of
    the bitmaps, a power of two; it does not change the result. Null texts are empty, repeated rows count as often as they
    stand, very long texts are one row of hashes, an empty table gives an empty one; other columns are not read, so their
    names cannot clash.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).alias("text"))
    found, words, kept = frequent_phrases(docs, support, longest, bits)
    totals = staged(words.groupBy("lang").agg(F.sum("n").alias("n")))
    scored = scores(found, totals, absorbed)
    out = staged(ranked(scored, words.where(F.col("n") >= support), top))
    unstaged(*kept, totals, scored)
    return out


def op12_phrase_mine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = r"""
with pieces as (
    select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) as piece
    from documents
),
rows as (select lang, regexp_extract_all(piece, '[^ 	]+') as w from pieces),
totals as (select lang, sum(len(w)) as n from rows group by lang),
grams as (
    select lang, w[i : i + k - 1] as w, k
    from (select lang, w, unnest(range(1, len(w) + 1)) as i from rows), (values (1), (2), (3), (4), (5)) as s(k)
    where i + k - 1 <= len(w)
),
frequent as (select lang, w, k as size, count(*) as f from grams group by lang, w, k having count(*) >= 100),
kept as (
    select c.* from frequent c
    where c.size > 1 and not exists (
        select 1 from frequent x
        where x.lang = c.lang and x.size > c.size and 100 * x.f >= 100 * c.f
            and list_contains(list_transform(range(1, x.size - c.size + 2), lambda i: x.w[i : i + c.size - 1]), c.w)
    )
),
cuts as (
    select c.lang, c.w, c.f as a, k, l.f as l, r.f as r, cast(t.n as bigint) as n, (1000::hugeint * c.f * t.n) // (l.f::hugeint * r.f) as score
    from kept c, (values (1), (2), (3), (4)) as s(k), frequent l, frequent r, totals t
    where k < c.size and l.lang = c.lang and r.lang = c.lang and t.lang = c.lang and l.w = c.w[1:k] and r.w = c.w[k + 1 : c.size]
),
lowest as (select *, row_number() over (partition by lang, w order by score, k) as place from cuts),
ranked as (
    select lang, row_number() over (partition by lang order by score desc, a desc, array_to_string(w, ' ')) as rank, array_to_string(w, ' ') as phrase, a, l, r, n, cast(score as bigint) as score
    from lowest where place = 1
)
select * from ranked where rank <= 2000
"""
