"""The training-data operators against brute force, round trips and held-out accuracy."""

from __future__ import annotations

import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from turnlake.llm import bpe_codec, chain_dedup, entries, hnsw_dedup, nn_descent, pii_transducer, quality_crf, secret_scan, simhash_dedup, source_mix, url_templates

SMALL, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, label string, size int"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").toPandas()


def odd_documents(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, extra columns with clashing names."""
    rows = [
        (1, "alpha beta gamma delta epsilon", "en", "a", 1, "x", 1),
        (1, "alpha beta gamma delta epsilon", "en", "a", 1, "x", 1),
        (2, None, None, None, None, None, None),
        (None, "password = abcdefghijklmnop one@example.com", "en", "b", 1, "x", 1),
        (3, "", "en", "a", 0, "y", 2),
        (4, " \t\n", "en", None, 3, "y", 2),
        (5, "word " * 50_000, "en", "c", 250_000, "z", 3),
        (6, "é" * 3000 + "\n" + "x" * 5000, "fr", "c", 8001, "z", 3),
    ]
    return spark.createDataFrame(rows, DOCS)


# SimHash


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(x.lower() if "A" <= x <= "Z" else x for x in text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, linked):
    parent = {x: x for x in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {x: root(x) for x in ids}


def test_simhash_is_the_brute_force(spark, documents):
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in entries.QUERIES["op1_simhash_dedup"](spark, SMALL).collect()}
    prints = {d: brute_fingerprint(t) for d, t in zip(documents["doc_id"], documents["text"], strict=True)}
    ids = sorted(prints)
    near = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 4]
    wanted = brute_components(ids, near)
    assert found == {d: (f"{prints[d]:016x}", wanted[d]) for d in ids}


@pytest.mark.parametrize("parts", [2, 3])
def test_hamming_links_lose_none(spark, parts):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 20)
    prints = sorted({int(b) ^ sum(1 << int(x) for x in rng.choice(62, rng.integers(0, 5), replace=False)) for b in base for _ in range(10)})
    links = simhash_dedup.hamming_links(spark.createDataFrame([(x,) for x in prints], "fp long"), 4, parts).collect()
    wanted = {(a, b) for i, a in enumerate(prints) for b in prints[i + 1 :] if (a ^ b).bit_count() <= 4}
    assert len(links) == len(wanted) and {tuple(sorted(x)) for x in links} == wanted


# Vectors


def brute_nearest(ids, m, k):
    scores = m @ m.T
    return {q: sorted(((-s, x) for x, s in zip(ids, scores[i], strict=True) if x != q))[:k] for i, q in enumerate(ids) if q % 20 == 0}


def test_nearest_vectors(spark):
    rows = spark.read.parquet(f"{MORE}/embeddings.parquet").toPandas()
    wanted = brute_nearest(rows["vec_id"].tolist(), np.array(rows["embedding"].tolist(), float), 20)
    found = entries.QUERIES["op2_nn_descent"](spark, MORE).collect()
    pairs = {(q, x) for q, best in wanted.items() for _, x in best}
    assert len(found) == len(pairs)
    assert len(pairs & {(r.query_id, r.vec_id) for r in found}) >= 0.9 * len(pairs)
    for r in found[:50]:
        assert abs(r.score - float(np.dot(*(np.array(rows["embedding"][rows["vec_id"] == x].iloc[0], float) for x in (r.query_id, r.vec_id))))) < 1e-12


def test_nearest_of_few_and_of_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (None, [1.0, 1.0]), (20, [1.0, 0.0]), (20, [1.0, 0.0])]
    df = spark.createDataFrame([(*x, "t") for x in rows], "vec_id long, embedding array<float>, text string")
    found = sorted(map(tuple, nn_descent.nearest(df, F.col("vec_id") % 20 == 0, 20).collect()))
    assert found == [(0, 1, 1, 1.0), (0, 2, 20, 1.0), (0, 3, 2, 0.5), (20, 1, 0, 1.0), (20, 2, 1, 1.0), (20, 3, 2, 0.5)]
    assert nn_descent.nearest(df.limit(0), F.lit(True)).count() == 0


def test_embedding_links_are_the_brute_force(spark):
    rows = spark.read.parquet(f"{MORE}/embeddings.parquet").toPandas()
    rng = np.random.default_rng(1)
    m = np.array(rows["embedding"].tolist(), float)
    ids, labels = rows["vec_id"].tolist(), rows["label"].tolist()
    copies = m[:40] + rng.normal(0, 0.01, (40, m.shape[1]))
    m, ids, labels = np.vstack([m, copies, m[:5]]), ids + [1000 + i for i in range(40)] + [2000 + i for i in range(5)], labels + labels[:40] + labels[:5]
    df = spark.createDataFrame([(i, v.tolist(), x) for i, v, x in zip(ids, m, labels, strict=True)] + [(9000, None, 1), (9001, [0.0] * 64, 1), (9002, m[0].tolist(), None)], "vec_id long, embedding array<double>, label int")
    unit = m / np.linalg.norm(m, axis=1)[:, None]
    linked = np.argwhere(np.triu((unit @ unit.T >= 0.98) & (np.array(labels)[:, None] == np.array(labels)[None]), 1)).tolist()
    wanted = brute_components(ids, [(ids[a], ids[b]) for a, b in linked])
    degree = dict.fromkeys(ids, 0)
    for a, b in linked:
        degree[ids[a]] += 1
        degree[ids[b]] += 1
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in hnsw_dedup.near_duplicates(df).collect()}
    alone = {x: (0, x, True) for x in (9000, 9001, 9002)}
    assert found == {x: (degree[x], wanted[x], wanted[x] == x) for x in ids} | alone
    assert hnsw_dedup.near_duplicates(df.limit(0)).count() == 0


# Quality


def test_quality_of_held_out_documents(spark):
    found = entries.QUERIES["op3_quality_crf"](spark, MORE).toPandas().set_index("doc_id")
    labels = spark.read.parquet(f"{MORE}/labels.parquet").toPandas().set_index("doc_id")["quality"]
    assert all(h == (zlib.crc32(str(d).encode()) % 5 == 0) for d, h in found["held_out"].items())
    assert found["score"].between(0, 1).all() and ((found["score"] >= 0.3) == (found["predicted"] == 1)).all()
    own = found[found["held_out"]].join(labels, how="inner")
    assert (own["predicted"] == own["quality"]).mean() > 0.85


def test_marginals_are_the_sum_over_all_chains():
    rng = np.random.default_rng(0)
    field = quality_crf.Field(rng.normal(0, 1, quality_crf.N_WEIGHTS), np.array([0.7, 0.4]), 0.1)
    bins, _ = quality_crf.line_bins("One line here.\n\n||||| 999\nOne line here.\nlast")
    score = field.w[quality_crf.columns_of(bins)].sum(axis=1) + field.bias
    n, total, good = len(score), 0.0, np.zeros(len(score))
    for labels in np.ndindex(*[2] * n):
        weight = np.exp(sum(s for s, y in zip(score, labels, strict=True) if y) + sum(field.stay[a] for a, b in zip(labels, labels[1:], strict=False) if a == b))
        total += weight
        good += weight * np.array(labels)
    assert np.allclose(field.marginals(bins), good / total)


# Secrets, personal data, urls


def base_secrets(text):
    found = []
    for k, (kind, pattern, group, least) in enumerate((("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12), ("access", "AKIA[A-Z0-9]+", 0, 18), ("hex", "[0-9a-f]+", 0, 16))):
        found += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text or "") if len(m[group]) >= least]
    return [x[2] for x in sorted(found)]


def test_base_secrets_are_the_brute_force(spark, documents):
    found = {r.doc_id: r for r in entries.QUERIES["op4_secret_scan"](spark, SMALL).collect()}
    for d, t in zip(documents["doc_id"], documents["text"], strict=True):
        base = base_secrets(t)
        assert found[d].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(found[d].spans.split(",")) and found[d].n_hex == sum(x.startswith("hex") for x in base)


def test_widely_owned_values_are_not_live(spark):
    value, own = "Zx81kQpLm20vBnT7aWqE", "Qp93mZtRw81xLcVb55Ks"
    rows = [(i, f"see {value} here", "en", f"repo{i}") for i in range(4)] + [(9, f"see {own} and {value}", "en", "solo")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    scanned = secret_scan.scan(df)
    live = {r.doc_id: [(x.start, x.end) for x in r.live] for r in scanned.collect()}
    assert live == {0: [], 1: [], 2: [], 3: [], 9: [(4, 24)]}
    assert {r.doc_id: r.text for r in secret_scan.redact(df, scanned).collect()}[9] == f"see [secret] and {value}"


def test_copies_of_a_text_do_not_make_its_secret_an_example(spark):
    copied, example, secret = "Zx81kQpLm20vBnT7aWqE", "Qp93mZtRw81xLcVb55Ks", "Lr47vNbYq62wHjDf09Ug"
    rows = [(1, f"my key {copied} is here", "en", "a"), (2, f"my key {copied} is here", "de", "b"), (3, f"My  key {copied}\nis here", "en", "c")]
    rows += [(10 + i, f"page {i} shows {example}", "en", "hot") for i in range(40)] + [(60 + i, f"{x} has {secret}", "en", "hot") for i, x in enumerate("pq")]
    scanned = secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert {r.doc_id for r in scanned if r.live} == {1, 2, 3, 60, 61}


def test_copies_in_many_sources_are_an_example_and_in_few_are_not(spark):
    wide, narrow = "Zx81kQpLm20vBnT7aWqE", "Qp93mZtRw81xLcVb55Ks"
    rows = [(i, f"my key {wide} is here", "en", f"s{i}") for i in range(60)] + [(100 + i, f"my key {narrow} is here", "en", f"s{i}") for i in range(2)]
    scanned = secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert {r.doc_id for r in scanned if r.live} == {100, 101}
    assert all(r.n_shared == 1 for r in scanned if r.doc_id < 100)


def test_ownership_is_the_brute_force(spark):
    r = random.Random(8)
    keys = [f"Zx{i}1kQpLm20vBnT7aWqE" for i in range(6)]
    rows = [(i, f"{r.choice('abcdef')} {r.choice(keys)} {r.choice(keys)}", r.choice(["en", "de"]), r.choice(["s1", "s2", "s3", "s4", "s5", None])) for i in range(25)]
    found = secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), live_owners=4, live_repos=5, live_texts=6).collect()

    def live(key):
        held = [x for x in rows if key in x[1]]
        return len({x[3] for x in held}) <= 4 and len({(x[3], x[2]) for x in held}) <= 5 and len({frozenset(x[1].lower().split()) for x in held}) <= 6

    want = {i: [(m.start(), m.end()) for m in re.finditer(r"Zx\S+", text) if live(m[0])] for i, text, *_ in rows}
    assert {x.doc_id: [(s.start, s.end) for s in x.live] for x in found} == want
    assert 0 < sum(map(len, want.values())) < 50


def base_pii(text):
    text, found = text or "", []
    luhn = lambda d: sum(sum(divmod(int(x) * (1 + i % 2), 10)) for i, x in enumerate(d[::-1])) % 10 == 0
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    tests = (
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    )
    for kind, (pattern, fits) in zip(pii_transducer.KINDS, tests, strict=True):
        found += [f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(pattern, text) if fits(m)]
    return found


def test_base_identifiers_are_the_brute_force(spark, documents):
    found = {r.doc_id: r for r in entries.QUERIES["op8_pii_transducer"](spark, SMALL).collect()}
    for d, t in zip(documents["doc_id"], documents["text"], strict=True):
        base = base_pii(t)
        assert found[d].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) - {""} <= set(found[d].spans.split(","))


def test_base_identifiers_are_counted_by_kind(spark, tmp_path):
    texts = [None, "", "a@b.de 4111 1111 1111 1111", "1.2.3.4 5.6.7.8 +1 (555) 010-9999", "x@y.fr one@two.org jane dot doe at mail dot nl"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in entries.QUERIES["op8_pii_transducer"](spark, str(tmp_path)).collect()}
    for d, text in enumerate(texts):
        base = base_pii(text)
        assert [found[d][f"n_{kind}"] for kind in pii_transducer.KINDS] == [sum(x.startswith(f"{kind}:") for x in base) for kind in pii_transducer.KINDS]
        assert found[d].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
    assert found[4].n_added == 1


def test_disguised_identifiers_keep_their_offsets():
    for text, kind, part in (
        ("write to jane dot doe at example dot com now", 0, "jane dot doe at example dot com"),
        ("write to jane [at] example [dot] org now", 0, "jane [at] example [dot] org"),
        ("mail јane@example.com", 0, "јane@example.com"),
        ("ring plus four nine one seven two five five five one two three four", 3, "plus four nine one seven two five five five one two three four"),
    ):
        assert (kind, text.index(part), text.index(part) + len(part), False) in pii_transducer.identifiers(text)
    assert pii_transducer.identifiers("look at the dot on the map at home") == []


def test_disguises_are_found_whatever_else_the_text_holds():
    for text, kind, part in (
        ("john.smith at example.com", 0, "john.smith at example.com"),
        ("server 192 dot 168 dot 10 dot 25", 1, "192 dot 168 dot 10 dot 25"),
        ("ring plus 49 172 555 1234 now", 3, "plus 49 172 555 1234"),
        ("ring plus 4 9 1 7 2 5 5 5 1 2 3 four.", 3, "plus 4 9 1 7 2 5 5 5 1 2 3 four"),
    ):
        for around in ("{}", "{} near the red dot", "one {}"):
            own = around.format(text)
            assert (kind, own.index(part), own.index(part) + len(part), False) in pii_transducer.identifiers(own), own


def test_disguises_of_any_host_and_of_short_addresses_are_found():
    ends = "nl ru ch pl jp in br au dev me ai museum"
    texts = [(f"write to jane dot doe at mail dot {x} now", 0, f"jane dot doe at mail dot {x}") for x in ends.split()]
    texts += [(f"write to jane.doe at mail.{x} now", 0, f"jane.doe at mail.{x}") for x in "nl ru ch pl com".split()]
    texts += [(f"ask {x} now", 1, x) for x in ("eight dot eight dot four dot four", "one two seven dot zero dot zero dot one")]
    for text, kind, part in texts:
        assert (kind, text.index(part), text.index(part) + len(part), False) in pii_transducer.identifiers(text), text
    for text in ("look at the dot on the map", "we met at noon.Then we left", "one two three four", "one dot two dot three"):
        assert pii_transducer.identifiers(text) == []


def test_urls(spark):
    rows = [(1, "http://A.Example.NET/en/x?y"), (2, "https://b.net/q"), (3, "http://x.example.com/de/1"), (4, "ftp://k.org/fr/2#t"), (5, None), (6, "no scheme/net"), (7, "http://netnet/de"), (None, "http://x.org/en")]
    pages = spark.createDataFrame([(*x, "h") for x in rows], "page_id long, url string, host string")
    labels = spark.createDataFrame([(1, 1)], "label_id long, bad int")
    found = {r.page_id: r for r in url_templates.judge(pages, labels).collect()}
    assert [(found[i].host, found[i].path, found[i].rule, found[i].verdict) for i in (1, 2, 3, 4)] == [
        ("a.example.net", "/en/x", "example.net/en/", "allow"), ("b.net", "/q", "net/", "block"), ("x.example.com", "/de/1", "example.com/de/", "block"), ("k.org", "/fr/2", "org/fr/", "allow"),
    ]
    assert (found[5].host, found[6].path, found[7].rule) == ("", "", None) and len(found) == len(rows)
    assert url_templates.judge(pages.limit(0), labels).count() == 0


def test_bad_templates_are_rejected(spark):
    pages = spark.createDataFrame([(i, f"http://h.io/{'spam' if i % 2 else 'news'}/{i}") for i in range(200)], "page_id long, url string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "label_id long, bad int")
    assert all(r.verdict == ("block" if r.page_id % 2 else "allow") for r in url_templates.judge(pages, labels).collect())


# Mixing, tokens, passages


def test_mix_meets_its_targets(spark):
    found = entries.QUERIES["op5_source_mix"](spark, MORE).toPandas()
    assert found.equals(entries.QUERIES["op5_source_mix"](spark, MORE).toPandas())
    assert (found["taken"] <= 2 * found["size"]).all()
    docs = spark.read.parquet(f"{MORE}/documents.parquet").select("doc_id", "source").toPandas()
    by = found.merge(docs, on="doc_id").groupby("source").agg(size=("size", "sum"), said=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (by["size"] == by["said"]).all() and ((by["taken"] - by["target"]).abs() <= 1).all()
    weights = dict(zip(sorted(by.index), (5, 2, 1) * len(by), strict=False))
    left, free, target = 1.5 * by["size"].sum(), set(by.index), {}
    while True:
        level = left / sum(weights[x] for x in free)
        over = {x for x in free if weights[x] * level > 2 * by["size"][x]}
        if not over:
            break
        for x in over:
            target[x] = 2 * by["size"][x]
            left -= target[x]
        free -= over
    assert all(abs(by["target"][x] - target.get(x, weights[x] * level)) < 1e-6 * max(1, by["target"][x]) for x in by.index)


def test_permutations_are_permutations():
    for n in (1, 2, 3, 100, 257):
        assert sorted(source_mix.permuted(np.arange(n), np.full(n, n), np.full(n, 12345, np.uint64)).tolist()) == list(range(n))


@pytest.fixture(scope="session")
def tokenizer():
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_tokens_are_the_librarys(spark, documents, tokenizer):
    found = {r.doc_id: r for r in entries.QUERIES["op9_bpe_codec"](spark, SMALL).collect()}
    for d, t in zip(documents["doc_id"], documents["text"], strict=True):
        ids = tokenizer.encode_ordinary(t or "")
        assert found[d].n_tokens == len(ids) and found[d].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert found[d].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_long_pieces_are_the_librarys(spark, tokenizer):
    import public_tokenizers

    texts = ["x" * 5000, "a" + "=" * 20_000, " " * 3000 + "y", "7" * 2500, "é" * 3000, "ab" * 30_000, "x" * 5000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r for r in bpe_codec.tokenize(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).collect()}
    for i, text in enumerate(texts):
        ids = tokenizer.encode_ordinary(text)
        assert found[i].ids == struct.pack(f"<{len(ids)}I", *ids) and found[i].decoded == text.encode()


def test_appends_and_edits_are_exact():
    import public_tokenizers

    codec = bpe_codec.codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    rng = np.random.default_rng(5)
    for _ in range(200):
        data = bytes(rng.choice(list("abeinrst ".encode()), rng.integers(1, 30)).astype(np.uint8))
        cut = int(rng.integers(0, len(data) + 1))
        fresh = bpe_codec.PieceState(codec, data).ids()
        assert bpe_codec.PieceState(codec, data[:cut]).append(data[cut:]).ids() == fresh
        assert bpe_codec.PieceState(codec, data[:cut] + b"zzz").replace(cut, cut + 3, data[cut:]).ids() == fresh


def test_shared_passages(spark):
    rng = np.random.default_rng(2)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 100_000, n)]
    passage = words(80)
    fuzzy = [x if i % 13 else "other" for i, x in enumerate(passage)]
    texts = {1: words(100) + passage + words(60), 2: words(30) + passage, 3: words(200) + fuzzy + words(10), 4: words(300)}
    rows = [(i, " ".join(x)) for i, x in texts.items()] + [(5, " ".join(texts[4])), (6, None), (7, "")]
    found = {r.doc_id: [(x.start, x.end) for x in r.spans] for r in chain_dedup.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    covers = lambda spans, a, b: any(s <= a + 6 and e >= b - 6 for s, e in spans)
    assert covers(found[1], 100, 180) and covers(found[2], 30, 110) and covers(found[3], 200, 280)
    assert found[4] == found[5] == [(0, 300)] and found[6] == found[7] == []


def found_passages(spark, texts):
    df = spark.createDataFrame([(i, " ".join(x)) for i, x in texts.items()], "doc_id long, text string")
    return {r.doc_id: [(x.start, x.end) for x in r.spans] for r in chain_dedup.shared_passages(df).collect()}


@pytest.mark.parametrize(("size", "gap"), [(300, 200), (60, 40), (100, 60), (500, 300)])
def test_two_passages_of_one_pair_are_both_shared(spark, size, gap):
    r = random.Random(size)
    fresh = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    fuzzy = lambda words: [x if i % 14 else f"z{r.randrange(10**6)}" for i, x in enumerate(words)]
    a, b = fresh(size), fresh(size)
    texts = [fresh(100) + a + fresh(gap) + b + fresh(80), fresh(50) + fuzzy(a) + fresh(gap) + fuzzy(b) + fresh(10)]
    found = {x.doc_id: [(s.start, s.end) for s in x.spans] for x in chain_dedup.shared_passages(spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(texts)], "doc_id long, text string")).collect()}
    for doc, at in ((0, 100), (1, 50)):
        first, second = found[doc]
        assert at <= first[0] <= at + 3 and at + size - 3 <= first[1] <= at + size + 1
        assert at + size + gap - 1 <= second[0] <= at + size + gap + 3 and at + 2 * size + gap - 3 <= second[1] <= at + 2 * size + gap + 1


def test_seeds_of_many_texts_at_once_are_those_of_each():
    rng = np.random.default_rng(6)
    texts = [rng.integers(0, 8 if i % 3 else 10**6, n).astype(np.uint32) for i, n in enumerate([0, 3, 5, 9, 10, 11, 700, 4, 40, 1, 300, 0])]
    of, seeds, pos = chain_dedup.sketches(texts)
    for i, words in enumerate(texts):
        h, at = chain_dedup.shingled(words)
        assert sorted(set(pos[of == i].tolist())) == sorted(set(at.tolist()))
        assert sorted(zip(*(x[of == i].tolist() for x in (seeds, pos)), strict=True)) == sorted(zip(*(x.tolist() for x in chain_dedup.sketches([words])[1:]), strict=True))
        plain = set(zip(h.view(np.int64).tolist(), range(len(h)), strict=True))
        assert {x for x in zip(seeds[of == i].tolist(), pos[of == i].tolist(), strict=True) if x in plain} == {(int(h.view(np.int64)[x]), int(x)) for x in at}


def test_packed_seeds_have_their_first_and_last_holder():
    rng = np.random.default_rng(7)
    rows = np.zeros(600, chain_dedup.SEED)
    rows["seed"], rows["doc"], rows["pos"] = rng.integers(-150, 150, 600), rng.integers(-9, 9, 600), rng.permutation(600)
    found = chain_dedup.ordered(rows, np.zeros(600, np.int64), np.zeros(0, np.int64))
    wanted = []
    for seed, doc, pos in rows.tolist():
        own = [(d, p) for s, d, p in rows.tolist() if s == seed]
        if len({d for d, _ in own}) > 1:
            first, before = min(own), max([x for x in own if x[0] < doc], default=None)
            wanted.append((seed, doc, pos, *first, *(before or (None, -1))))
    found = [(*x[:6], x[6]) if x[6] >= 0 else (*x[:5], None, -1) for x in found.tolist()]
    assert sorted(found, key=repr) == sorted(wanted, key=repr)


def test_chains_of_packed_anchors_are_those_of_each_pair():
    rng = np.random.default_rng(8)
    rows = np.zeros(900, chain_dedup.HELD)
    rows["doc"], rows["first"] = rng.integers(10, 40, 900), rng.integers(0, 2, 900)
    rows["before"] = rows["first"]
    rows["pos"] = rng.integers(0, 900, 900)
    rows["first_pos"] = rows["before_pos"] = np.where(rng.random(900) < 0.1, rng.integers(0, 900, 900), rows["pos"] + 7)
    found = chain_dedup._chained(rows)
    for doc, other in {(int(x["doc"]), int(x["first"])) for x in rows}:
        own = sorted({(int(x["pos"]), int(x["first_pos"])) for x in rows if (x["doc"], x["first"]) == (doc, other)})
        at, o_at = (np.array(x) for x in zip(*own, strict=True))
        wanted = [(at[x].tolist(), o_at[x].tolist()) for x in chain_dedup.chains(at, o_at)]
        has = found[(found["doc"] == doc) & (found["other"] == other)]
        assert sorted((np.frombuffer(x, "<i4").tolist(), np.frombuffer(y, "<i4").tolist()) for x, y in zip(has["at"], has["o_at"], strict=True)) == sorted(wanted)


def test_common_words_are_the_longest_common_subsequence():
    r = random.Random(4)
    for _ in range(150):
        x, y = (np.array([r.randrange(5) for _ in range(r.randrange(40))], dtype=np.uint32) for _ in range(2))
        table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x)):
            for j in range(len(y)):
                table[i + 1][j + 1] = table[i][j] + 1 if x[i] == y[j] else max(table[i][j + 1], table[i + 1][j])
        assert chain_dedup.common(x, y) == table[-1][-1]


def test_short_fuzzy_passages_are_shared(spark):
    rng = np.random.default_rng(4)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 10_000_000, n)]
    texts = {}
    for i in range(60):
        passage = words(60)
        changed = set(rng.choice(np.arange(3, 57), 7, replace=False).tolist())
        texts |= {2 * i: words(50) + passage + words(50), 2 * i + 1: words(70) + [f"other{j}" if j in changed else x for j, x in enumerate(passage)] + words(20)}
    found = found_passages(spark, texts)
    assert sum(bool(x) for x in found.values()) >= 0.95 * len(texts)


def test_a_passage_repeated_in_one_document_is_shared_twice(spark):
    rng = np.random.default_rng(6)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 10_000_000, n)]
    passage = words(80)
    found = found_passages(spark, {1: words(20) + passage + words(20), 2: words(10) + passage + words(30) + passage + words(10)})
    covers = lambda spans, a, b: any(s <= a + 6 and e >= b - 6 for s, e in spans)
    assert covers(found[2], 10, 90) and covers(found[2], 120, 200)


def test_passages_that_earlier_documents_quote_in_part_are_shared(spark):
    rng = np.random.default_rng(7)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 10_000_000, n)]
    covers = lambda spans, a, b: any(s <= a and e >= b for s, e in spans)
    texts, whole = {}, {}
    for i in range(0, 200, 10):
        passage = words(60)
        parts = [passage[:30], passage[30:]]
        texts |= {i: words(20) + parts[0] + words(20), i + 1: words(20) + parts[1] + words(20)}
        texts |= {i + 2: words(25) + passage + words(25)}
        texts |= {i + 3: words(20) + parts[0] + words(20), i + 4: words(20) + parts[1] + words(20)}
        texts |= {i + 5: words(35) + passage + words(15)}
        whole |= {i + 2: (25, 85), i + 5: (35, 95)}
    found = found_passages(spark, texts)
    assert all(covers(found[d], *span) for d, span in whole.items())
    assert all(not found[d] for d in texts if d not in whole)


# Edge rows


def test_operators_take_odd_rows_and_empty_tables(spark):
    import public_tokenizers

    odd = odd_documents(spark)
    labels = spark.createDataFrame([(1, 1), (3, 0), (None, 1), (5, None)], "doc_id long, quality int")
    runs = {
        "simhash": simhash_dedup.near_duplicates,
        "quality": lambda df: quality_crf.classify(df, labels),
        "secrets": secret_scan.scan,
        "mix": source_mix.mix,
        "passages": chain_dedup.shared_passages,
        "pii": pii_transducer.find,
        "tokens": lambda df: bpe_codec.tokenize(df, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN),
    }
    for name, run in runs.items():
        assert run(odd).count() == odd.count(), name
        assert run(odd.limit(0)).count() == 0, name


def test_operators_compute_all_columns_of_odd_rows(spark):
    """Collects the rows: a count lets Spark leave out the columns that the Python workers make."""
    import public_tokenizers

    odd = odd_documents(spark)
    labels = spark.createDataFrame([(1, 1), (3, 0), (None, 1), (5, None)], "doc_id long, quality int")
    tokens = lambda df: bpe_codec.tokenize(df, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    for run in (simhash_dedup.near_duplicates, lambda df: quality_crf.classify(df, labels), secret_scan.scan, source_mix.mix, chain_dedup.shared_passages, pii_transducer.find, tokens):
        assert len(run(odd).collect()) == 8
    assert sorted(r.decoded for r in tokens(odd).collect()) == sorted((r.text or "").encode() for r in odd.collect())
