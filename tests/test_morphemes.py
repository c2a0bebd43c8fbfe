"""Stems and endings: readings against all readings, rounds of EM, and the words of Korean turns."""

from __future__ import annotations

import math
import random
import tracemalloc

import pytest

from turnlake.operators import morphemes, wordfreq

KOREAN = ["학교에서 공부했고 학교를 좋아합니다", None, ""]


def all_readings(word, lexicon):
    """(cost, forms) of every stem with endings that spells the word."""

    def tails(rest, first=True):
        if not rest:
            yield (lexicon.endings[""], [""]) if first else (0.0, [])
        for x, cost in lexicon.endings.items():
            if x and rest.startswith(x):
                for more, forms in tails(rest[len(x) :], False):
                    yield cost + more, [x, *forms]

    for stem, cost in lexicon.stems.items():
        if word.startswith(stem):
            for more, forms in tails(word[len(stem) :]):
                yield cost + more, [stem, *forms]


@pytest.fixture(scope="module")
def lexicon():
    return morphemes.Lexicon({"walk": 1.0, "walke": 2.5, "wal": 1.9, "walked": 4.0, "s": 3.0}, {"": 0.7, "ed": 1.5, "d": 2.0, "ked": 1.2, "s": 1.1, "e": 2.2})


@pytest.mark.parametrize("word", ["walked", "walkeds", "walks", "walkes", "s"])
def test_readings_are_the_likeliest_of_all(lexicon, word):
    every = list(all_readings(word, lexicon))
    own = morphemes.Analyzer(lexicon)
    assert [x for x, _ in own.reading(word)] == [x for x in min(every)[1] if x]
    expected, likelihood = own.expected(word)
    weights = [math.exp(-cost) for cost, _ in every]
    assert math.isclose(likelihood, math.log(sum(weights)))
    for (kind, form), uses in expected.items():
        plain = sum(w * ((forms[0] == form) if kind == morphemes.STEM else forms[1:].count(form)) for w, (_, forms) in zip(weights, every, strict=True)) / sum(weights)
        assert math.isclose(uses, plain, abs_tol=1e-12)


def test_new_words_and_long_ones(lexicon):
    own = morphemes.Analyzer(lexicon)
    assert own.reading("zoned") == [("zon", "unknown"), ("ed", "ending")]
    assert own.expected("zzz") == ({}, 0.0)
    assert own.reading("q" * 20_000) == [("q" * 20_000, "unknown")]


def test_a_large_lexicon_takes_little_more_than_its_stems():
    r = random.Random(4)
    stems = {"".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(4, 12))): 1.0 for _ in range(20_000)}
    lexicon = morphemes.Lexicon(stems, {"": 0.7, "s": 1.1})
    tracemalloc.start()
    try:
        own = morphemes.Analyzer(lexicon)
        assert all(own.likeliest(x) for x in stems)
        assert tracemalloc.get_traced_memory()[1] < 2_000_000
    finally:
        tracemalloc.stop()


def test_a_noun_counts_once_for_each_of_its_forms(spark):
    turns = spark.createDataFrame([(i, "user", x) for i, x in enumerate(KOREAN)], "i int, role string, text string")
    found = morphemes.fit(turns, "text", morphemes.KOREAN_ENDINGS, morphemes.KOREAN_INTERJECTIONS)
    words = wordfreq.tokens(turns, ["i"], tokenize=morphemes.content(found))
    top = {r.word: r.cnt for r in wordfreq.most_common(words, 10).collect()}
    assert top["학교"] == 2 and "학교에서" not in top and "학교를" not in top
    spoken = spark.createDataFrame([("어 음 병원에 예약하고 싶어요",)], "text string")
    counted = {(r.kind, r.form): r.cnt for r in morphemes.form_counts(spoken, "text", found).collect()}
    assert counted["interjection", "어"] == counted["interjection", "음"] == 1
    assert counted["stem", "병원"] == 1 and counted["ending", "에"] == 1
    empty = morphemes.fit(turns.limit(0), "text", ("s",))
    assert empty.stems == {} and morphemes.form_counts(turns.limit(0), "text", empty).count() == 0


def test_rounds_raise_the_likelihood(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    counted = morphemes.words(docs, "text").cache()
    held = [(r.word, r.n) for r in counted.collect()]
    lexicon = morphemes.fit(docs, "text", morphemes.EUROPEAN_ENDINGS, rounds=0)
    discount, morphemes.DISCOUNT = morphemes.DISCOUNT, 0.0
    try:
        values = []
        for _ in range(3):
            own = morphemes.Analyzer(lexicon)
            values.append(sum(n * own.expected(word)[1] for word, n in held))
            lexicon = morphemes.refitted(counted, lexicon)
    finally:
        morphemes.DISCOUNT = discount
    assert values[0] < values[1] < values[2]
