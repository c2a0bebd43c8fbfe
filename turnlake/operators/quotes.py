"""Many quotes in many texts at once: an automaton over all quotes, built once in each worker.

The automaton (Aho and Corasick, 1975) reads every text once, whatever the number of quotes, and gives each place at which a
quote stands, overlapping ones too. Quotes are dealt into automata of at most QUOTES_AT_ONCE characters, so that a list of
any length is met in bounded memory; a list that fits one automaton is sent to the workers whole.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of quotes in one automaton.
QUOTES_AT_ONCE = 4_000_000


class Automaton:
    """All quotes as paths of one tree; every node knows the longest proper ending of its path that is a path too, and the quotes that end there."""

    def __init__(self, quotes: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.sizes = [len(x) for x in quotes]
        for number, quote in enumerate(quotes):
            node = 0
            for letter in quote:
                if letter not in self.next[node]:
                    self.next[node][letter] = len(self.next)
                    self.next.append({})
                    self.ends.append([])
                node = self.next[node][letter]
            if quote:
                self.ends[node].append(number)
        self.fall, self.shorter = [0] * len(self.next), [0] * len(self.next)
        waiting = deque(self.next[0].values())
        while waiting:
            node = waiting.popleft()
            for letter, child in self.next[node].items():
                fall = self.fall[node]
                while fall and letter not in self.next[fall]:
                    fall = self.fall[fall]
                self.fall[child] = self.next[fall].get(letter, 0)
                # the nearest shorter ending at which a quote ends, so that no others are visited
                self.shorter[child] = self.fall[child] if self.ends[self.fall[child]] else self.shorter[self.fall[child]]
                waiting.append(child)

    def places(self, text: str) -> Iterator[tuple[int, int]]:
        """(quote's number, where it begins) for each quote in a text, by where they end, the longest first."""
        node = 0
        for end, letter in enumerate(text, 1):
            while node and letter not in self.next[node]:
                node = self.fall[node]
            node = self.next[node].get(letter, 0)
            met = node if self.ends[node] else self.shorter[node]
            while met:
                for number in self.ends[met]:
                    yield number, end - self.sizes[number]
                met = self.shorter[met]


def located(texts: DataFrame, quotes: DataFrame, text_id: str, text: str, quote_id: str, quote: str, at_once: int = QUOTES_AT_ONCE) -> DataFrame:
    """One row (text_id, quote_id, start, end) for each place, in code points, at which a quote stands in a text, overlapping ones too.

    Null and empty texts and quotes give nothing; repeated texts and quotes give repeated rows; null ids stay. Texts are
    read once for each automaton.
    """
    spark = texts.sparkSession
    own = quotes.where(F.length(quote) > 0).select(F.col(quote_id).alias("_id"), F.col(quote).alias("_quote"))
    total = own.agg(F.sum(F.length("_quote"))).first()[0] or 0
    parts = -(-total // at_once)
    kinds = dict(texts.dtypes)[text_id], dict(quotes.dtypes)[quote_id]
    schema = f"{text_id} {kinds[0]}, {quote_id} {kinds[1]}, start int, end int"
    out = spark.createDataFrame([], schema)
    dealt = own.withColumn("_part", F.pmod(F.xxhash64("_quote"), F.lit(max(1, parts))))
    for part in range(parts):
        sent = spark.sparkContext.broadcast([tuple(r) for r in dealt.where(F.col("_part") == part).select("_id", "_quote").collect()])
        out = out.unionByName(texts.where(F.length(text) > 0).select(text_id, F.col(text).alias("_text")).mapInPandas(_finder(sent, text_id, quote_id), schema))
    return out


def _finder(sent, text_id: str, quote_id: str):
    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = [x for x, _ in sent.value]
        automaton = Automaton([x for _, x in sent.value])
        for frame in frames:
            rows = [(key, ids[number], start, start + automaton.sizes[number]) for key, text in zip(frame[text_id], frame["_text"], strict=True) for number, start in automaton.places(text)]
            yield pd.DataFrame(rows, columns=[text_id, quote_id, "start", "end"])

    return find


def anchors(places: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """asked (keys) with code, start, end: null and the place for a quote that stands in its text once, else quote_absent or quote_nonunique."""
    found = places.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("start").alias("_start"), F.min("end").alias("_end"))
    joined = asked.join(found, keys, "left")
    once = F.col("_n") == 1
    code = F.when(F.col("_n").isNull(), "quote_absent").when(F.col("_n") > 1, "quote_nonunique")
    return joined.select(*asked.columns, code.alias("code"), F.when(once, F.col("_start")).alias("start"), F.when(once, F.col("_end")).alias("end"))
