"""Quotes by an automaton and chains of owners by joins, against plain loops."""

from __future__ import annotations

import random
import time

from pyspark.sql import functions as F

from turnlake.operators import evidence, graphs, quotes


def test_places_are_those_of_plain_search():
    r = random.Random(1)
    for _ in range(300):
        wanted = ["".join(r.choice("ab") for _ in range(r.randint(0, 4))) for _ in range(r.randint(0, 6))]
        text = "".join(r.choice("abc") for _ in range(r.randint(0, 25)))
        plain = sorted((i, k) for i, q in enumerate(wanted) if q for k in range(len(text)) if text.startswith(q, k))
        assert sorted(quotes.Automaton(wanted).places(text)) == plain


def test_located_and_anchored(spark):
    texts = spark.createDataFrame([(1, "aaa b"), (2, None), (3, ""), (None, "ab ☃ b"), (1, "aaa b")], "d long, t string")
    asked = spark.createDataFrame([(7, "aa"), (8, "☃ b"), (9, ""), (10, None), (11, "zz"), (7, "aa")], "q long, x string")
    want = [(None, 8, 3, 6)] + sorted([(1, 7, 0, 2), (1, 7, 1, 3)] * 4)
    for at_once in (quotes.QUOTES_AT_ONCE, 2):
        found = quotes.located(texts, asked, "d", "t", "q", "x", at_once)
        assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)
    places = quotes.located(texts.distinct(), asked.distinct(), "d", "t", "q", "x")
    pairs = spark.createDataFrame([(1, 7), (1, 8)], "d long, q long")
    assert sorted(map(tuple, quotes.anchors(places, pairs, ["d", "q"]).collect())) == [(1, 7, "quote_nonunique", None, None), (1, 8, "quote_absent", None, None)]
    assert quotes.located(texts, asked.limit(0), "d", "t", "q", "x").count() == 0


def test_quotes_in_clauses_are_those_of_plain_search(spark):
    r = random.Random(3)
    parts = ["a", "b", "aa", "☃", "\U0001d7d9", "\\E", "\\Q", "\\", ".", "(", "\n"]
    draw = lambda most: "".join(r.choice(parts) for _ in range(r.randint(0, most)))
    rows = [(i, draw(30), draw(3)) for i in range(300)] + [(300, None, "a"), (301, "a", None), (302, "ab", "abc")]
    found = spark.createDataFrame(rows, "i int, t string, q string").select("i", evidence.occurrences(F.col("t"), F.col("q")).alias("at"), evidence.occurrence_count(F.col("t"), F.col("q")).alias("n"))
    for row in found.collect():
        _, text, quote = rows[row.i]
        plain = [k for k in range(len(text)) if text.startswith(quote, k)] if text and quote else []
        assert (row.at, row.n) == (plain, len(plain)), rows[row.i]


def test_a_quote_in_a_long_clause_is_found_in_one_pass(spark):
    rows = spark.createDataFrame([(["ab " * 200_000 + "the end", "x"],)], "c array<string>")
    begin = time.time()
    assert tuple(rows.select(evidence.relocated(F.col("c"), F.lit("the ")).alias("r")).first().r) == ("wrong_clause_unique", 1)
    assert time.time() - begin < 20


def test_chains_are_walks(spark):
    r = random.Random(2)
    edges, plain = [], {}
    for case in range(30):
        size = r.randint(1, 40)
        owner = {n: r.randrange(size + 3) for n in range(size)} if case % 3 else {n: n + 1 for n in range(size)}
        edges += [(case, n, w, f"k{w % 3}") for n, w in owner.items()]
        for n in owner:
            at, steps, kind = n, 0, None
            while at in owner and steps <= size:
                at, steps, kind = owner[at], steps + 1, f"k{owner[at] % 3}"
            plain[case, n] = (None, None, True, None) if steps > size else (at, steps, False, kind)
    found = graphs.chains(spark.createDataFrame([*edges, (None, 1, 2, "x"), (1, None, 2, "x")], "case long, node long, owner long, kind string"))
    assert {(x.case, x.node): (x.root, x.length, x.circle, x.kind) for x in found.collect()} == plain


def test_ended_chains_are_not_written_again(spark, monkeypatch):
    written, plain = [], graphs.checkpointed

    def counting(rows):
        out = plain(rows)
        written.append(out.count())
        return out

    monkeypatch.setattr(graphs, "checkpointed", counting)
    edges = [(case, 0, 1, "part_of") for case in range(300)] + [(300, n, n + 1, "part_of") for n in range(40)]
    found = graphs.chains(spark.createDataFrame(edges, "case long, node long, owner long, kind string"))
    assert {(x.case, x.node, x.root, x.length, x.circle) for x in found.collect()} == {(c, n, 40 if c == 300 else 1, 40 - n if c == 300 else 1, False) for c, n, *_ in edges}
    assert sum(written) < 3 * len(edges)


def test_faults_on_the_way_make_an_event_unknown(spark):
    nodes = [(1, x) for x in "eabt"] + [(2, x) for x in "exyt"] + [(3, "e")] + [(4, x) for x in "eot"]
    edges = [(1, "e", "a", "part_of"), (1, "a", "b", "part_of"), (1, "b", "t", "same_entity"), (2, "e", "x", "part_of"), (2, "x", "y", "part_of"), (2, "y", "x", "part_of"), (4, "e", "o", "distinct")]
    frame = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    events = frame([(c, "e", "observed") for c in (1, 2, 3, 4)], "case long, node string, occurrence string")
    args = frame(nodes, "case long, node string"), frame([(1, "t"), (2, "t"), (3, "t"), (4, "t")], "case long, node string")

    def told(more=()):
        found = graphs.event_relations(events, frame([*edges, *more], "case long, node string, owner string, kind string"), *args)
        return {r.case: (r.relation, r.fault, r.route) for r in found.collect()}

    plain = told()
    assert plain[1] == ("current", None, graphs.ACT) and plain[4] == ("other", None, graphs.COLLECT)
    assert plain[2] == ("unknown", "circle", graphs.CONFIRM) and plain[3] == ("unknown", "no_owner", graphs.CONFIRM)
    assert told([(1, "b", "a", "part_of")])[1][1:] == ("circle", graphs.CONFIRM)
    assert told([(1, "b", "z", "part_of")])[1] == ("unknown", "owner_missing", graphs.CONFIRM)
    assert told([(4, "e", "o", "distinct")])[4] == ("unknown", "repeated_edge", graphs.CONFIRM)
