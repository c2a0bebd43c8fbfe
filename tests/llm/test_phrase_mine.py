"""Collocations by hash-filtered passes against exact counts in plain Python."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from turnlake.llm import phrase_mine

SCHEMA = "lang string, text string, phrase long, n string"


def plain(rows, support, longest, absorbed, top):
    words, grams = Counter(), Counter()
    for lang, text, *_ in rows:
        lang = "und" if lang is None else lang
        lower = "".join(x.lower() if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    grams[lang, tuple(w[i : i + k])] += 1
    frequent = {k: n for k, n in grams.items() if n >= support}
    out = {}
    for (lang, w), a in frequent.items():
        longer = [m for (x, v), m in frequent.items() if x == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1))]
        if len(w) < 2 or any(100 * m >= absorbed * a for m in longer):
            continue
        cuts = [(1000 * a * words[lang] // (grams[lang, w[:k]] * grams[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), grams[lang, w[:k]], grams[lang, w[k:]]))
    return sorted((lang, i, p.decode(), -a, left, right, words[lang], -s) for lang, own in out.items() for i, (s, a, p, left, right) in enumerate(sorted(own)[:top], 1))


def found(spark, rows, **options):
    names = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    return sorted(tuple(r[x] for x in names) for r in phrase_mine.mine(spark.createDataFrame(rows, SCHEMA), **options).collect())


@pytest.mark.parametrize(("support", "bits", "top"), [(5, None, 2000), (5, 1 << 13, 7), (300, None, 2000)])
def test_phrases_are_those_of_plain_counts(spark, support, bits, top):
    r = random.Random(3)
    letters = ["the", "The", "of", "new", "york", "a", "é", "É", "x.y", "no,", "end!", "\t", "\n", "  ", "b c d e"]
    rows = [(r.choice(["en", "en", "en", "de", None]), " ".join(r.choice(letters) for _ in range(r.randint(0, 30))), 1, "x") for _ in range(400)]
    rows += [("en", "one two three four five six. " * 40, 1, None), ("fr", None, None, None), (None, "", None, None), ("en", "same same same " * 120, 2, "y")]
    want = plain(rows, support, 5, 100, top)
    assert len(want) > (0 if support > 5 else 12)
    assert found(spark, rows, support=support, bits=bits, top=top) == want


def test_sums_are_handed_on_whole(spark, monkeypatch):
    monkeypatch.setattr(phrase_mine, "WORDS_AT_ONCE", 50)
    monkeypatch.setattr(phrase_mine, "SUMS_AT_ONCE", 20)
    rows = [("en", f"alpha beta gamma {i % 7} delta", 1, None) for i in range(200)]
    assert found(spark, rows, support=10, absorbed=90) == plain(rows, 10, 5, 90, 2000)


def test_phrases_with_one_hash_stay_apart():
    import numpy as np

    sums = phrase_mine.Sums(2)
    codes = sums.codes(["en", "de"])
    words = np.array([[1, 2, 1, 1], [5, 6, 5, 5]], dtype=np.uint64)
    sums.add(np.zeros(4, dtype=np.uint64), codes[[0, 0, 0, 1]], words, np.ones(4, dtype=np.int64))
    (_, langs, kept, counts), = sums.parts
    assert sorted(zip(langs.tolist(), kept[0].tolist(), counts.tolist(), strict=True)) == [(0, 1, 2), (0, 2, 1), (1, 1, 1)]


def test_empty_table(spark):
    assert found(spark, []) == []
