"""Inputs that are large, odd or repeated, and the operators' methods against plain versions of them."""

from __future__ import annotations

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from turnlake.llm import bpe_codec, chain_dedup, hnsw_dedup, nn_descent, pii_transducer, quality_crf, secret_scan, simhash_dedup, source_mix, url_templates
from turnlake.llm.shared import connected_components, hot_join, staged

SMALL, TENTH = "/root/testdata/sf0.001", "/root/testdata/sf0.1"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, label string, size int, score double, row long, spans string"
CLASH = ("x", 1, 0.5, 7, "s")
LONG = " ".join(f"w{i % 977}" for i in range(50_000))
#: Nulls in every column, empty, blank and very long texts, ties, repeated rows, extra columns with clashing names.
ODD = [
    (1, "alpha beta gamma delta epsilon", "en", "a", 30, *CLASH),
    (1, "alpha beta gamma delta epsilon", "en", "a", 30, *CLASH),
    (2, None, None, None, None, None, None, None, None, None),
    (None, "password = abcdefghijklmnop one@example.com", "en", "b", 43, *CLASH),
    (3, "", "en", "a", 0, *CLASH),
    (4, " \t\n", "en", None, 3, *CLASH),
    (5, LONG, "en", "c", len(LONG), *CLASH),
    (6, "é" * 3000 + "\n" + "x" * 5000, "fr", "c", 8001, *CLASH),
    (7, "alpha beta gamma delta epsilon", "en", "b", 30, *CLASH),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


def rows(df, *columns):
    return sorted((tuple(getattr(r, c) for c in columns) for r in df.collect()), key=repr)


# Shared pieces


def test_hot_join_is_a_join(spark):
    left = spark.range(40_000).select(F.col("id").alias("row"), F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.col("id") % 1000).alias("k"))
    right = spark.range(900).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    counted = right.join(left.groupBy("k").agg(F.count("*").alias("n")), "k")
    for how in ("inner", "left"):
        wanted = rows(left.join(right, "k", how), "row", "k", "v")
        assert rows(hot_join(left, right, ["k"], F.col("row"), how), "row", "k", "v") == wanted
        if how == "inner":
            assert rows(hot_join(left, counted, ["k"], F.col("row"), count="n", total=40_000), "row", "k", "v") == wanted


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(10, 60)] + [(100, i) for i in range(200, 400)] + [(5, 5), (None, 3)]
    found = dict(rows(connected_components(spark.createDataFrame(links, "a long, b long")), "node", "component"))
    assert found == {i: 10 for i in range(10, 61)} | {100: 100} | {i: 100 for i in range(200, 400)}


# Odd rows, by value


def test_simhash_of_odd_rows(odd):
    found = rows(simhash_dedup.near_duplicates(odd), "doc_id", "component_id")
    assert found == sorted([(1, 1), (1, 1), (7, 1), (2, 2), (3, 2), (4, 2), (5, 5), (6, 6), (None, None)], key=repr)
    kept = simhash_dedup.deduplicated(odd)
    assert kept.columns == odd.columns and rows(kept, "doc_id") == sorted([(1,), (2,), (5,), (6,), (None,)], key=repr)


@pytest.mark.parametrize("segments", [2, 3])
def test_segments_do_not_change_the_components(spark, segments):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert rows(simhash_dedup.near_duplicates(docs, segments=segments), "doc_id", "component_id") == rows(simhash_dedup.near_duplicates(docs), "doc_id", "component_id")


def test_quality_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1), (3, 0), (None, 1), (5, None), (6, 1), (7, 1)], "doc_id long, quality int")
    field = quality_crf.train(odd, labels)
    found = rows(quality_crf.classify(odd, labels), "doc_id", "score")
    wanted = sorted(((r[0], field.quality(r[1])) for r in ODD), key=repr)
    assert [x[0] for x in found] == [x[0] for x in wanted] and np.allclose([x[1] for x in found], [x[1] for x in wanted])
    assert field.quality(None) == field.quality("")


def test_secrets_of_odd_rows(odd):
    found = {r.doc_id: [(x.start, x.end, x.kind) for x in r.base] for r in secret_scan.scan(odd).collect()}
    assert found == {1: [], 2: [], 3: [], 4: [], 5: [], 6: [], 7: [], None: [(0, 27, 0)]}
    clean = secret_scan.redact(odd, secret_scan.scan(odd))
    assert clean.columns == odd.columns
    assert rows(clean, "doc_id", "text", "spans") == sorted([(r[0], "[secret] one@example.com" if r[0] is None else r[1], r[-1]) for r in ODD], key=repr)


def test_mix_of_odd_rows(odd):
    found = source_mix.mix(odd, block=8).collect()
    sizes = {"a": 10, "b": 9, "c": 50_002, None: 0}
    count = lambda t: len(t.split()) if t else 0
    assert sorted((r.doc_id, r.size, r.source_size) for r in found if r.doc_id is not None) == sorted((r[0], count(r[1]), sizes[r[3]]) for r in ODD if r[0] is not None)
    taken = {s: sum(r.taken for r in found if r.source_size == n) for s, n in sizes.items()}
    assert taken[None] == 0 and taken["a"] == 20 and taken["b"] == 18 and abs(taken["c"] - (1.5 * 50_021 - 38)) <= 1
    assert all(r.taken <= 2 * r.size for r in found)


def test_passages_of_odd_rows(odd):
    found = rows(chain_dedup.shared_passages(odd), "doc_id", "copy_of", "n_words")
    assert found == sorted([(1, 1, 5), (1, 1, 5), (7, 1, 5), (2, 2, 0), (3, 2, 0), (4, 4, 0), (5, 5, 50_000), (6, 6, 2), (None, None, 4)], key=repr)
    assert all(not r.spans for r in chain_dedup.shared_passages(odd).collect())


def test_identifiers_of_odd_rows(odd):
    found = {r.doc_id: [(x.kind, x.start, x.end) for x in r.spans] for r in pii_transducer.find(odd).collect()}
    assert found == {1: [], 2: [], 3: [], 4: [], 5: [], 6: [], 7: [], None: [(0, 28, 43)]}


def test_tokens_of_odd_rows(odd):
    import public_tokenizers

    found = bpe_codec.tokenize(odd, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    assert rows(found, "doc_id", "decoded") == sorted([(r[0], (r[1] or "").encode()) for r in ODD], key=repr)


def test_stages_take_odd_rows_and_empty_tables(spark, odd, tmp_path):
    labels = spark.createDataFrame([(1, 1), (3, 1), (6, 1), (8, 1)], "doc_id long, quality int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    kept = {}
    docs = odd
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, odd.limit(0), str(tmp_path))
        assert empty.count() == 0
        docs = staged(stage(spark, docs, str(tmp_path)))
        kept[name] = docs.collect()
        assert name == "encoding" or docs.columns == odd.columns
    ids = lambda name: sorted((r.doc_id for r in kept[name]), key=repr)
    assert ids("quality") == sorted([r[0] for r in ODD], key=repr)  # only good labels: nothing is rejected
    assert ids("near_dedup") == ids("secrets") == sorted([1, 2, 5, 6, None], key=repr)
    texts = {r.doc_id: r.text for r in kept["secrets"]}
    assert texts[None] == "[secret] one@example.com" and texts[2] is None
    assert {r.doc_id for r in kept["mixing"]} == {1, 5, 6, None}
    assert sorted(r.n_chars for r in kept["mixing"]) == sorted(len(r.text) for r in kept["mixing"])
    assert len(kept["encoding"]) == len(kept["mixing"]) and all(r.n_tokens > 0 for r in kept["encoding"])


# Long texts


def test_long_texts_take_time_in_proportion(spark):
    began = time.perf_counter()
    assert pii_transducer.identifiers("1" * 500_000) == pii_transducer.identifiers("a dot " * 100_000) == pii_transducer.identifiers(" " * 500_000 + "@") == []
    assert [x[:3] for x in pii_transducer.identifiers("7" * 400_000 + " x@y.de")] == [(0, 400_001, 400_007)]
    assert time.perf_counter() - began < 20
    run = "0123456789abcdef"
    docs = spark.createDataFrame([(1, " ".join([run] * 30_000), "en", "s")], "doc_id long, text string, lang string, source string")
    began = time.perf_counter()
    base = secret_scan.scan(docs).first().base
    assert [(x.start, x.end) for x in base] == [(17 * i, 17 * i + 16) for i in range(30_000)]
    assert time.perf_counter() - began < 60


# Vectors over several shards


def brute_links(ids, vectors, labels, threshold=0.98):
    """(vec_id, n_links, component_id) of each row."""
    use = [i for i, v in enumerate(vectors) if v is not None and labels[i] is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    unit = np.array([np.array(vectors[i]) / np.linalg.norm(vectors[i]) for i in use])
    linked = (unit @ unit.T >= threshold) & (np.array([labels[i] for i in use])[:, None] == np.array([labels[i] for i in use])[None])
    np.fill_diagonal(linked, False)
    for a, b in np.argwhere(np.triu(linked)):
        a, b = root(use[a]), root(use[b])
        parent[max(a, b)] = min(a, b)
    degree = dict(zip(use, linked.sum(axis=1).tolist(), strict=True))
    least = {}
    for i, x in enumerate(ids):
        least[root(i)] = min(x, least.get(root(i), x))
    return sorted((x, degree.get(i, 0), least[root(i)]) for i, x in enumerate(ids))


def test_embedding_links_over_shards_dense_groups_and_repeated_ids(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((300, 16))
    dense = np.vstack([base[0] + rng.normal(0, 0.05 * k, (150, 16)) for k in (1, 2, 3)])
    vectors = [*np.vstack([base, dense, base[:20]]).tolist(), None, [0.0] * 16, [float("nan")] * 16, [None] * 16, base[0].tolist()]
    ids = [*range(750), *range(20), 7, 7, 8, 8, 9]
    labels = [*rng.integers(0, 2, 300).tolist(), *[0] * 470, 0, 0, 0, 0, None]
    ids[5] = ids[500] = 7
    df = spark.createDataFrame([(i, v, x, "clash") for i, v, x in zip(ids, vectors, labels, strict=True)], "vec_id long, embedding array<double>, label int, row string")
    found = hnsw_dedup.near_duplicates(df, shard_rows=150)
    assert rows(found, "vec_id", "n_links", "component_id") == sorted(brute_links(ids, vectors, labels), key=repr)
    assert all(r.kept == (r.vec_id == r.component_id) for r in found.collect())


def test_nearest_vectors_over_shards(spark):
    df = spark.read.parquet(f"{TENTH}/embeddings.parquet")
    table = df.toPandas()
    ids, m = table["vec_id"].tolist(), np.array(table["embedding"].tolist(), float)
    scores = m @ m.T
    wanted = {(q, x) for i, q in enumerate(ids) if q % 20 == 0 for _, x in sorted((-scores[i, j], ids[j]) for j in range(len(ids)) if j != i)[:20]}
    found = nn_descent.nearest(df, F.col("vec_id") % 20 == 0, 20, shard_rows=500).collect()
    assert len(found) == len(wanted) and len(wanted & {(r.query_id, r.vec_id) for r in found}) >= 0.95 * len(wanted)


def test_ties_at_the_cut_go_to_the_smaller_id(spark):
    vectors = [(0, [1.0, 0.0])] + [(i, [0.5, 0.5 + (i == 9)]) for i in range(9, 0, -1)] + [(0, [0.0, 1.0])]
    found = nn_descent.nearest(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, 3)
    assert sorted((r.rank, r.vec_id) for r in found.collect()) == [(1, 1), (1, 9), (2, 1), (2, 2), (3, 2), (3, 3)]


def test_walks_score_a_small_part_of_a_shard():
    rng = np.random.default_rng(3)
    n, links = 20_000, 22
    v = rng.standard_normal((n, 32)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1)[:, None]
    near = np.empty((n, links), np.int64)
    for at in range(0, n, 2000):
        s = v[at : at + 2000] @ v.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -9
        near[at : at + 2000] = np.argpartition(-s, links, axis=1)[:, :links]
    graph = np.hstack([near, rng.integers(0, n, (n, 4))]).astype("<i4")
    q = v[:: n // 100]
    scored = []
    vectors = Counting(v, scored)
    found = nn_descent.walk(q, vectors, graph, 20, nn_descent.FIRST_BEAM, nn_descent.FIRST_PLACES)
    truth = np.argsort(-(q @ v.T), axis=1)[:, :20]
    assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(found, truth, strict=True)]) >= 0.9
    assert sum(scored) <= 0.1 * n * len(q)


class Counting:
    """Vectors that count how many rows are read by number."""

    def __init__(self, rows, read):
        self.rows, self.read = rows, read

    def __len__(self):
        return len(self.rows)

    def __getitem__(self, at):
        self.read.append(len(at))
        return self.rows[at]


# Quality: the gradient and the scores against sums over all chains


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(1)
    sizes, labels = np.array([1, 3, 2, 5]), np.array([1.0, 0.0, 1.0, 1.0])
    columns = np.concatenate([quality_crf.columns_of(rng.integers(0, 4, (n, quality_crf.N_MEASURES)).astype(np.uint8)) for n in sizes]).astype(np.int16)
    theta = rng.normal(0, 0.3, quality_crf.N_WEIGHTS + 3)

    def likelihood(theta):
        w, bias, stay = theta[: quality_crf.N_WEIGHTS], theta[quality_crf.N_WEIGHTS], theta[quality_crf.N_WEIGHTS + 1 :]
        total, at = 0.0, 0
        for n, y in zip(sizes, labels, strict=True):
            score = w[columns[at : at + n]].sum(axis=1) + bias
            weight = lambda chain: sum(s for s, k in zip(score, chain, strict=True) if k) + sum(stay[a] for a, b in zip(chain, chain[1:], strict=False) if a == b)  # noqa: E731, B023
            total += weight([int(y)] * n) - math.log(sum(math.exp(weight(c)) for c in np.ndindex(*[2] * n)))
            at += n
        return total / len(columns)

    grad = quality_crf._gradient(theta, columns, sizes, labels)
    for i in [*rng.choice(np.unique(columns), 8), *range(quality_crf.N_WEIGHTS, quality_crf.N_WEIGHTS + 3)]:
        step = np.zeros_like(theta)
        step[i] = 1e-5
        assert abs((likelihood(theta + step) - likelihood(theta - step)) / 2e-5 - grad[i]) < 1e-6


def test_training_takes_whole_documents(spark):
    good, bad = "A fine sentence about words.\n", "||| 000 ### 111\n"
    docs = spark.createDataFrame([(i, (good if i % 2 else bad) * 400 + (bad if i % 2 else good) * 200) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    field = quality_crf.train(docs, labels, sample_lines=5000)
    assert 0.4 < field.quality(good * 400 + bad * 200) < 0.9 or field.quality(good * 600) > field.quality(bad * 600)


# Mixing: every word that is taken, from blocks laid out in plain Python


def test_taken_words_are_those_of_the_blocks(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    _, sources, placed = source_mix._prepared(docs, "doc_id", "text", "source", [])
    block = 64
    cut = source_mix.pieces(placed.select("row", "doc_id", "source_no", "size", "text_hash"), placed.count(), block).where("block is not null").collect()
    slots = source_mix.mix_slots(sources, block).collect()
    words = {}
    for x in cut:  # the word of the document that lies at each place of each block
        for i in range(x.n):
            assert words.setdefault((x.source_no, x.block, x["at"] + i), (x.row, x["from"] + i)) == (x.row, x["from"] + i)
    sizes = {r.source_no: r.source_size for r in sources.collect()}
    assert all((s, i // block, i % block) in words for s, n in sizes.items() for i in range(n)) and len(words) == sum(sizes.values())
    taken = {}
    for x in slots:
        for i in range(x["take"]):
            row = words[x.source_no, x.block, i][0]
            taken[row] = taken.get(row, 0) + 1
    found = source_mix.mix(docs, block=block).collect()
    by_row = {r.row: r.doc_id for r in placed.collect()}
    wanted = {}
    for row, n in taken.items():
        wanted[by_row[row]] = wanted.get(by_row[row], 0) + n
    assert {r.doc_id: r.taken for r in found} == {d: wanted.get(d, 0) for d in by_row.values()}


def test_shards_get_each_slot_once():
    shards, counts = source_mix.draw_counts(100_000, 7, 1, 2)
    assert counts.sum() == 100_000 and len(shards) == 7 and abs(counts - 100_000 / 7).max() < 1000


# Passages against all pairs


def brute_passages(texts, least):
    """Words of each text that lie in a run of `least` words or more that another text has too."""
    runs = {}
    for d, words in texts.items():
        for i in range(len(words) - least + 1):
            runs.setdefault(tuple(words[i : i + least]), []).append((d, i))
    found = {d: set() for d in texts}
    for holders in runs.values():
        if len({d for d, _ in holders}) > 1:
            for d, i in holders:
                found[d].update(range(i, i + least))
    return found


def test_exact_passages_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(11)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 1_000_000, n)]
    passages = [words(int(n)) for n in rng.integers(50, 160, 25)]
    texts = {}
    for i in range(120):
        own = words(int(rng.integers(5, 40)))
        for k in rng.choice(len(passages), 3, replace=False):
            p = passages[k]
            if rng.random() < 0.6:  # a quote of a part
                a = int(rng.integers(0, len(p) - 20))
                p = p[a : a + int(rng.integers(15, 49))]
            own += p + words(int(rng.integers(5, 40)))
        texts[i] = own
    df = spark.createDataFrame([(i, " ".join(x)) for i, x in texts.items()], "doc_id long, text string")
    found = {r.doc_id: {i for x in r.spans for i in range(x.start, x.end)} for r in chain_dedup.shared_passages(df).collect()}
    assert all(wanted <= found[d] for d, wanted in brute_passages(texts, chain_dedup.MIN_WORDS).items())


def test_holders_behind_quotes_find_each_other(spark):
    rng = np.random.default_rng(12)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 1_000_000, n)]
    passage = words(90)
    texts = {1: words(9) + passage[:45], 2: passage[45:] + words(9), 3: words(5) + passage + words(5), 4: words(7) + passage}
    df = spark.createDataFrame([(i, " ".join(x)) for i, x in texts.items()], "doc_id long, text string")
    found = {r.doc_id: [(x.start, x.end) for x in r.spans] for r in chain_dedup.shared_passages(df).collect()}
    assert found == {1: [], 2: [], 3: [(5, 95)], 4: [(7, 97)]}


# Url templates against a plain tree


def brute_templates(pages, bad):
    """{page_id: (template, purity)} by the same rules, one host and one node at a time."""
    import re

    parsed, marks = {}, {}
    for page, url in pages:
        host, path = re.match(r".*?://([^/?#]*)([^?#]*)", url).groups()
        forms = tuple("<h>" if re.fullmatch(r"(?=.*[0-9])(?=.*[a-f])[0-9a-f-]{8,}", x) else re.sub("[0-9]+", "<n>", x) for x in path.split("/") if x)
        number = re.search(r"([0-9]{1,18})[^/0-9]*/?$", path)
        parsed[page] = (host.lower(), forms)
        marks[page] = bad.get(int(number[1])) if number else None
    template = {x: list(x[1]) for x in set(parsed.values())}
    held = {x: [marks[p] for p in parsed if parsed[p] == x] for x in template}
    depths = [d for d in range(max(len(x[1]) for x in template)) if any(len({x[1][d] for x in template if x[0] == h and len(x[1]) > d}) > 1 for h in {x[0] for x in template})]
    levels = max(depths, default=0) + 1

    def nodes(depth):
        found = {}
        for x, t in template.items():
            if len(t) > depth:
                found.setdefault((x[0], tuple(t[:depth])), {}).setdefault(t[depth], []).append(x)
        return found

    for depth in range(levels):
        for children in nodes(depth).values():
            n = sum(len(held[x]) for own in children.values() for x in own)
            if len(children) > url_templates.FANOUT and n < url_templates.SUPPORT * len(children):
                for x in (x for own in children.values() for x in own):
                    template[x][depth] = url_templates.WILD
    labels = lambda own: [m for x in own for m in held[x] if m is not None]
    for depth in reversed(range(levels)):
        for children in nodes(depth).values():
            every = labels([x for own in children.values() for x in own])
            for own in children.values():
                m, others = labels(own), len(every) - len(labels(own))
                differs = False
                if m and others:
                    share = sum(every) / len(every)
                    error = math.sqrt(share * (1 - share) * (1 / len(m) + 1 / others))
                    differs = error > 0 and abs(sum(m) / len(m) - (sum(every) - sum(m)) / others) > url_templates.Z * error
                if not differs:
                    for x in own:
                        template[x][depth] = url_templates.MERGED
    known = [m for m in marks.values() if m is not None]
    overall = sum(known) / len(known) if known else 0.0
    sums = {}
    for x, t in template.items():
        sums.setdefault((x[0], tuple(t)), []).extend(labels([x]))
    prior = url_templates.PRIOR_PAGES
    purity = {k: (sum(v) + prior * overall) / (len(v) + prior) for k, v in sums.items()}
    return {p: ("/" + "/".join(template[x]), round(purity[x[0], tuple(template[x])], 9)) for p, x in parsed.items()}


def test_templates_are_those_of_a_plain_tree(spark):
    rng = np.random.default_rng(6)
    deep = ["a", "b", "c", "d", "e", "f", "g", "h"]
    urls = []
    for i in range(900):
        kind = i % 4
        host = ["h.io", "k.io", "deep.io"][i % 3]
        path = f"news/{i}" if kind == 0 else f"spam/page-{i}.html" if kind == 1 else f"u{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}x/{i}" if kind == 2 else "/".join([*deep, ["good", "evil"][i % 8 // 4], str(i)])
        urls.append((i, f"http://{host}/{path}"))
    urls += [(900, urls[0][1]), (901, "http://h.io/" + "x" * 5000), (902, "http://h.io/"), (903, "http://h.io")]
    bad = {i: int(rng.random() < (0.9 if i % 4 == 1 or i % 8 == 7 else 0.1)) for i in range(0, 900, 2)} | {i: int(i % 8 == 7) for i in range(3, 900, 4)}
    found = url_templates.judge(spark.createDataFrame(urls, "page_id long, url string"), spark.createDataFrame(list(bad.items()), "label_id long, bad int"))
    assert {r.page_id: (r.template, round(r.purity, 9)) for r in found.collect()} == brute_templates(urls, bad)


def test_very_long_paths_add_no_rounds(spark, monkeypatch):
    word = lambda i, j: "".join(chr(97 + (7 * j + 3 * i + k) % 26) for k in range(3))
    deep = [(10_000 + i, f"http://trap.example/{'/'.join(word(i, j) for j in range(500))}/{10_000 + i}") for i in range(2)]
    urls = [(i, f"http://h.example/{'ab'[i % 2]}/x{i % 60}/p-{i}") for i in range(240)] + deep
    bad = {i: i % 2 for i in range(240)} | {10_000: 1, 10_001: 0}
    written = []
    monkeypatch.setattr(url_templates, "staged", lambda df: written.append(1) or staged(df))
    found = url_templates.judge(spark.createDataFrame(urls, "page_id long, url string"), spark.createDataFrame(list(bad.items()), "label_id long, bad int"))
    assert {r.page_id: (r.template, round(r.purity, 9)) for r in found.collect()} == brute_templates(urls, bad)
    assert len(written) < 40


def test_paths_are_told_apart_below_six_segments(spark):
    urls = [(i, f"http://h.io/a/b/c/d/e/f/g/{'evil' if i % 2 else 'good'}/{i}") for i in range(100)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "label_id long, bad int")
    found = url_templates.judge(spark.createDataFrame(urls, "page_id long, url string"), labels)
    assert all(r.verdict == ("block" if r.page_id % 2 else "allow") for r in found.collect())
