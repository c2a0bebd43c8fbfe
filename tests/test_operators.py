"""Operators on small literal rows: the cases that the tables do not hold."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from turnlake.functions import documents, numbers, text
from turnlake.operators import baselines, contracts, integrity, journals, scoring, wordfreq


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_scope_and_fillers(spark):
    turns = spark.createDataFrame([(1, 0, "user", "oh kind kind"), (1, 1, "assistant", "oh"), (1, 2, "user", " ")], "conv_id long, turn long, role string, text string")
    row = wordfreq.filler_share(wordfreq.in_scope(turns, "user"), ["conv_id"]).first()
    assert (row.total_messages, row.total_words, row.filler_count, row.filler_ratio) == (2, 3, 1, 33.3)
    with pytest.raises(ValueError):
        wordfreq.in_scope(turns, "nobody")


def test_ties_go_to_the_first_use(spark):
    turns = spark.createDataFrame([(1, 0, "b a b a c")], "conv_id long, turn long, text string")
    best = wordfreq.top(wordfreq.counts(wordfreq.tokens(turns, ["conv_id", "turn"])), 2)
    assert [(r.rank, r.word, r.cnt) for r in best.collect()] == [(1, "b", 2), (2, "a", 2)]


def test_baseline_of_two_samples_and_of_one(spark):
    rows = spark.createDataFrame([("u", 1, 100.0), ("u", 2, 120.0), ("v", 1, 5.0)], "user_key string, seq long, value double")
    found = {r.user_key: r for r in baselines.simple_baseline(rows, "user_key", ["value"]).collect()}
    assert found["u"].value_mean == 110.0 and round(found["u"].value_std, 6) == 14.142136
    assert found["v"].value_std == 0.0 and found["v"].value_m2 == 0.0
    folded = {r.user_key: r for r in baselines.welford(rows, "user_key", ["seq"], "value").collect()}
    assert (folded["u"].samples, folded["u"].mean, folded["u"].std) == (2, 110.0, 14.142136)
    assert baselines.against_baseline(rows, baselines.simple_baseline(rows, "user_key", ["value"]), "user_key", ["value"]).where("user_key = 'v'").first().value_z is None


def test_measurement_faults(spark):
    rows = spark.createDataFrame([(1.0,), (0.0,), (None,), (float("nan"),), (float("inf"),)], "v double")
    assert [r.fault for r in baselines.split_measurements(rows, "v").collect()] == [None, "out_of_range", "missing", "not_finite", "not_finite"]


LABELS = "struct<intent string, action string, change_field string, fields map<string, array<string>>>"
ATTEMPTS = "array<struct<valid boolean, intent string, action string, change_field string, fields map<string, string>>>"


def test_contract_failure_counts_as_missed_slots(spark):
    cases = spark.createDataFrame([(1, ("i", "a", None, {"x": ["1"]})), (2, ("i", "a", None, {"x": ["1"], "y": None}))], f"case_id long, labels {LABELS}")
    predictions = spark.createDataFrame(
        [(1, [(True, "i", "a", None, {"x": "1"})]), (2, [(False, None, None, None, None), (False, None, None, None, None)])], f"case_id long, attempts {ATTEMPTS}"
    )
    row = scoring.summary(scoring.case_flags(cases, predictions)).first()
    assert (row.cases, row.exact, row.gold_present, row.tp, row.fn, row.omitted, row.gold_absent, row.retried) == (2, 1, 2, 1, 1, 1, 0, 1)
    assert row.slot_recall == 0.5 and row.change_accuracy is None
    pairs = {(r.gold_action, r.predicted_action): r.cnt for r in scoring.confusion(scoring.case_flags(cases, predictions)).collect()}
    assert pairs == {("a", "a"): 1, ("a", scoring.FAILED): 1}
    assert scoring.id_faults(cases, predictions.where("case_id = 1")).collect()[0].fault == "missing_prediction"


def test_published_paired_figures(spark):
    p = lambda gains, losses: round(one(spark, numbers.sign_test(F.lit(gains), F.lit(losses))), 6)
    assert [p(6, 1), p(5, 0), p(0, 0), p(2, 2)] == [0.125, 0.0625, 1.0, 1.0]


def test_bootstrap_gives_the_published_interval(spark):
    """32 strata of two cases, ten gains in as many strata: difference 0.15625, interval 0.09375 to 0.21875 over 20,000 resamples."""
    rows = spark.createDataFrame([(f"s{i}", int(i < 10 and j == 0)) for i in range(32) for j in range(2)], "s string, d int")
    found = scoring.bootstrap(rows, "s", "d", 20_000).first()
    assert (found.cases, found.difference, found.low, found.high) == (64, 0.15625, 0.09375, 0.21875)


def test_bootstrap_of_one_gain(spark):
    rows = spark.range(64).select((F.col("id") / 2).cast("int").alias("s"), (F.col("id") == 0).cast("int").alias("delta"))
    a, b = (scoring.bootstrap(rows, "s", "delta", 500).first() for _ in range(2))
    assert a == b and a.difference == 1 / 64 and a.low <= a.difference <= a.high


def test_clauses_and_anchors(spark):
    df = spark.createDataFrame([("One two too. Aaa! ",)], "t string").select(text.clauses(F.col("t")).alias("c"))
    at = lambda i, q: df.select(text.anchored(F.col("c"), F.lit(i), F.lit(q)).alias("a")).first()["a"]
    assert df.first()["c"] == ["One two too.", "Aaa!"]
    assert tuple(at(1, "two")) == (None, 4, 7)
    assert [at(2, "aa").code, at(1, "o").code, at(1, "zz").code, at(3, "a").code, at(1, " a").code] == [None, "quote_nonunique", "quote_unanchored", "quote_index_invalid", "quote_blank"]
    assert one(spark, text.anchored(F.array(F.lit("aaa")), F.lit(1), F.lit("aa")))["code"] == "quote_nonunique"


def test_unicode_forms(spark):
    assert one(spark, text.folded(F.lit(" Ｓtraße "))) == "strasse"
    assert one(spark, text.stripped(F.lit(" x y　"))) == "x y"
    key = one(spark, text.pseudonym(F.lit("user"), b"0" * 32))
    assert one(spark, text.is_pseudonym(F.lit(key)))
    with pytest.raises(ValueError):
        text.pseudonym(F.lit("user"), b"short")


def test_strict_json(spark):
    fault = lambda x: one(spark, documents.json_fault(F.lit(x), ["a"]))
    assert [fault(x) for x in ('{"a": 1}', '{"a": 1, "a": 2}', "{}", '{"a": 1, "b": 2}', " ")] == [None, "malformed", "missing_keys", "unexpected_keys", "blank"]
    assert one(spark, documents.canonical_map(F.create_map(F.lit("b"), F.lit(1), F.lit("a"), F.lit(2)))) == '{"a":2,"b":1}'


def test_conflicts_and_crossing_groups(spark):
    rows = spark.createDataFrame([(1, "x", 0, "train"), (2, "x", 1, "test"), (3, "y", 0, "train"), (4, "y", 0, "train")], "id long, t string, label int, split string")
    assert [r.n_labels for r in integrity.conflicting_labels(rows, "id", F.col("t"), "label").collect()] == [2]
    assert sorted(r.least_id for r in integrity.duplicate_inputs(rows, "id", F.col("t")).collect()) == [1, 3]
    assert [r.t for r in integrity.crossing_groups(rows, "t", "split").collect()] == ["x"]
    with pytest.raises(ValueError):
        integrity.require_empty(integrity.crossing_groups(rows, "t", "split"), "leak")


def test_contract_rules(spark):
    outputs = spark.createDataFrame(
        [(1, "s", "open", "give", {"f": "a"}), (2, "s", "open", "stop", {"f": "z", "g": "1"}), (3, "none", "open", "give", {"f": None})],
        "case_id long, scenario string, state string, action string, fields map<string,string>",
    )
    fields = spark.createDataFrame([("s", "f", "a")], "scenario string, field string, option string")
    actions = spark.createDataFrame([("s", "open", "give")], "scenario string, state string, action string")
    rules = spark.createDataFrame([("s", "give", ["f"], ["f"], False)], "scenario string, action string, allowed array<string>, required array<string>, require_any boolean")
    found = {(r.case_id, r.rule, r.detail) for r in contracts.violations(outputs, fields, actions, rules).collect()}
    assert {(2, "field_set", "g"), (2, "option", "f"), (2, "action", "stop"), (3, "unknown_scenario", "none")} <= found
    assert not any(x[0] == 1 for x in found)


def test_state_functions(spark):
    m = lambda **x: F.create_map(*[F.lit(y).cast("string") for k, v in x.items() for y in (k, v)])
    assert one(spark, contracts.applied(m(a="1", b=None), m(a=None, b="2"))) == {"a": "1", "b": "2"}
    assert one(spark, contracts.delta_relations(m(a="1", b=None), m(a="3", b="2"))) == ["a->changed", "b->set"]
    assert one(spark, contracts.context_class(m(a="1", b=None))) == "partial"


def test_lookup_falls_back_to_all_values_in_order(spark):
    catalog = spark.createDataFrame([("s", "10", "x", 2), ("s", "11", "y", 1), ("s", "12", "x", 3)], "scope string, key string, value string, ord int")
    asked = spark.createDataFrame([("s", "11"), ("s", "99"), ("t", "11")], "scope string, key string")
    found = {(r.scope, r.key): r.offers for r in journals.lookup_or_all(asked, catalog, "scope", "key", "value", "ord").collect()}
    assert found == {("s", "11"): ["y"], ("s", "99"): ["y", "x"], ("t", "11"): None}


def test_readers(spark, tmp_path):
    from turnlake.sources import files

    (tmp_path / "log.jsonl").write_text('{"seq": 1}\n{"seq": 2, "seq": 3}\n')
    assert sorted((r.seq or 0, r.fault) for r in files.read_journal(spark, str(tmp_path / "log.jsonl")).collect()) == [(0, "malformed"), (1, None)]
    (tmp_path / "t.md").write_text("| id | a |\n| --- | --- |\n| C-1 | x |\n")
    assert [r.cells for r in files.read_pipe_table(spark, str(tmp_path / "t.md"), "^C-[0-9]+$").collect()] == [["C-1", "x"]]
    files.write_once(spark.range(1), str(tmp_path / "out"))
    with pytest.raises(Exception, match="(?i)exists"):
        files.write_once(spark.range(1), str(tmp_path / "out"))


def test_stream_agrees_with_the_fold(spark, tmp_path):
    from turnlake.streaming.baselines import stream_baselines

    rows = spark.createDataFrame([("u", 1, 100.0), ("u", 2, 120.0), ("u", 3, 90.0), ("v", 1, 5.0)], "user_key string, seq long, value double")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    out = stream_baselines(stream).writeStream.format("memory").queryName("baselines").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    out.awaitTermination(120)
    found = {r.user_key: (r.samples, r.mean, r["std"]) for r in spark.table("baselines").collect()}
    folded = {r.user_key: (r.samples, r.mean, r["std"]) for r in baselines.welford(rows, "user_key", ["seq"], "value").collect()}
    assert found == folded
