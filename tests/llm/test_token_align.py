"""Alignment of two tokenizers by segments against that of whole texts."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from turnlake.llm import token_align

BITS = ["the", "a", " ", "  ", "\n", " \n", " ", "▁", "é", "é", "日本", "<|endoftext|>", "</s>", "don't", "'s", "12", "3.5", "\t", "ﬁ", "\x1c", "\x85", "　", "!!", "hello world", "Ünï", "\0", "\r\n", "🙂", " ▁", "x  y"]
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def paths():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def whole(text, own):
    """(ids of A, ids of B, links, groups) of a text tokenised as a whole; None where it has no tokens."""
    if not text:
        return None
    a, b = own.a.encode(" " + text, add_special_tokens=False).ids, own.b.encode(text)
    wanted = (" " + text).encode()
    if b"".join(own.a_bytes[i] for i in a) != wanted or b"".join(own.b_bytes[i] for i in b) != wanted:
        return None
    ranges = []
    for ids, of in ((a, own.a_bytes), (b, own.b_bytes)):
        at, out = 0, []
        for i in ids:
            out.append((at, at + len(of[i])))
            at += len(of[i])
        ranges.append(out)
    links = [(x, y) for x, (s, e) in zip(a, ranges[0], strict=True) for y, (t, f) in zip(b, ranges[1], strict=True) if s < f and t < e]
    ends = {e for _, e in ranges[0]} & {e for _, e in ranges[1]}
    sides = []
    for ids, of in zip((a, b), ranges, strict=True):
        cut = [[]]
        for i, (_, e) in zip(ids, of, strict=True):
            cut[-1].append(str(i))
            if e in ends:
                cut.append([])
        sides.append([",".join(x) for x in cut[:-1]])
    return a, b, links, ";".join(f"{x}|{y}" for x, y in zip(*sides, strict=True))


def plain(texts, paths):
    own = token_align.Pair(*paths)
    docs = [whole(x, own) for x in texts]
    counts = Counter(p for d in docs if d for p in set(d[2]))
    most = defaultdict(int)
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    return [
        (0,) * 6 + ("",) if d is None else (len(d[0]), len(d[1]), d[3].count("|"), len(d[2]), sum(counts[p] == most[p[0]] for p in d[2]), sum(counts[p] for p in d[2]), hashlib.sha256(d[3].encode()).hexdigest())
        for d in docs
    ]


def aligned(spark, texts, paths):
    found = token_align.align(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), *paths)
    return [tuple(r[c] for c in COLUMNS) for r in found.orderBy("doc_id").collect()]


def test_segments_give_the_alignment_of_whole_texts(spark, paths, monkeypatch):
    r = random.Random(1)
    texts = ["".join(r.choice(BITS) for _ in range(r.randint(0, 14))) for _ in range(1200)] + [None, "", " ", "a", "x" * 3000, "the the the " * 500, "a\n" * 400]
    want = plain(texts, paths)
    assert sum(x[0] > 0 for x in want) > 400
    assert aligned(spark, texts, paths) == want
    monkeypatch.setattr(token_align, "CHUNK_DOCS", 7)
    assert aligned(spark, texts[:200], paths) == plain(texts[:200], paths)


def test_documents(spark, paths):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id")
    assert aligned(spark, [r.text for r in docs.collect()], paths) == plain([r.text for r in docs.collect()], paths)


def test_odd_rows(spark, paths):
    odd = [(1, "a b", "x"), (1, "a b", "x"), (None, "a b", None), (2, None, "x"), (None, None, None)]
    docs = spark.createDataFrame(odd, "doc_id long, text string, chunk string").withColumn("segment", F.lit(1))
    found = token_align.align(docs, *paths)
    assert sorted(((r.doc_id, r.n_a, r.count_sum) for r in found.collect()), key=repr) == sorted([(1, 2, 6), (1, 2, 6), (None, 2, 6), (2, 0, 0), (None, 0, 0)], key=repr)
    assert token_align.align(docs.limit(0), *paths).count() == 0


def test_no_token_crosses_a_border(paths):
    own = token_align.Pair(*paths)
    assert not own.whole and own.joined == "▁"
    assert own.segments("a b  c ▁ d\ne f") == ["a", "b  c", "▁ d\ne", "f"]
