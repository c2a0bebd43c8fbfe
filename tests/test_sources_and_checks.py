"""Readers of files, normal forms, streams of dialogues, and the library functions that no query shows, on literal rows."""

from __future__ import annotations

import hashlib
import json
import struct
import wave
from dataclasses import replace

from pyspark.sql import functions as F

from turnlake.functions import documents, text
from turnlake.operators import baselines, contracts, evidence, groups, journals, machines, validation, wordfreq
from turnlake.sources import files
from turnlake.streaming import baselines as streams


def values(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_cases_and_folders(spark, tmp_path):
    case = {"id": "c1", "split": "test", "scenario_key": "a:b", "conversation_state": "open", "current_fields": {"x": None}, "user_message": "hi", "labels": {"intent": "i", "fields": {"x": {"accepted_values": ["1"]}}, "user_action": "tell"}, "tags": ["t"]}
    (tmp_path / "set.json").write_text(json.dumps({"version": "1", "cases": [case, case | {"id": "c2"}]}, indent=1))
    (tmp_path / "below").mkdir()
    (tmp_path / "below" / "set.json").write_text((tmp_path / "set.json").read_text())
    found = files.read_cases(spark, f"{tmp_path}/set.json")
    assert values(found, "version", "id", "user_message") == [("1", "c1", "hi"), ("1", "c2", "hi")]
    folder = files.read_folder(spark, str(tmp_path))
    assert folder.count() == 2 and {x[0] for x in values(files.folder_faults(folder, "set.json"), "fault")} == {"repeated", "manifest_inside"}
    assert values(files.folder_faults(folder.limit(0)), "file", "fault") == [(None, "empty")]


def test_journals_have_each_entry_once(spark, tmp_path):
    (tmp_path / "j.jsonl").write_text('{"seq": 0}\n{"seq": 1}\n{"seq": 1}\nnot json\n{"seq": 9}\n{"x": 1}\n')
    found = files.journal_faults(files.read_journal(spark, f"{tmp_path}/j.jsonl"), 4)
    assert values(found, "seq", "fault") == sorted([(1, "repeated"), (None, "malformed"), (9, "beyond"), (None, "missing")], key=repr)


def test_prompts(spark, tmp_path):
    (tmp_path / "p.ini").write_text("[meta]\nTitle = A b\n[avoid]\nlines = one, two ,,three\n[examples]\nlines =\n  first, with comma\n  second\n")
    found = {(r.section, r.name): r.lines for r in files.read_prompts(spark, f"{tmp_path}/p.ini").collect()}
    assert found == {("meta", "Title"): ["A b"], ("avoid", "lines"): ["one", "two", "three"], ("examples", "lines"): ["first, with comma", "second"]}


def test_availability_catalogues(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"schema_version": "1", "scenarios": {"shop:a": {"available_requests": {" noon ": "12:00", "": "x"}}, "shop:b": {"available_requests": {"x": "y"}, "more": 1}}}))
    found = files.read_availability(spark, f"{tmp_path}/a.json", "1")
    assert values(found, "scenario", "request", "slot", "fault") == [("shop:a", "", "x", "blank"), ("shop:a", "noon", "12:00", None), ("shop:b", "x", "y", "entry")]
    assert {x[0] for x in values(files.read_availability(spark, f"{tmp_path}/a.json", "2"), "fault")} == {"version"}


def test_recordings_pair_with_labels(spark, tmp_path):
    for name, channels, frames in (("a", 1, 8000), ("b", 2, 100)):
        with wave.open(f"{tmp_path}/{name}.wav", "wb") as sound:
            sound.setnchannels(channels)
            sound.setsampwidth(2)
            sound.setframerate(16000)
            sound.writeframes(struct.pack("<h", 0) * frames * channels)
    (tmp_path / "c.wav").write_bytes(b"no sound")
    found = files.read_recordings(spark, str(tmp_path))
    assert values(found, "stem", "rate", "frames", "duration_ms", "fault") == [("a", 16000, 8000, 500, None), ("b", 16000, 100, 6, "not_mono"), ("c", None, None, None, "unreadable")]
    assert values(found.where("stem = 'c'"), "digest") == [(hashlib.sha256(b"no sound").hexdigest(),)]
    paired, lone = files.with_recordings(spark.createDataFrame([("a", 1), ("x", 2)], "stem string, label int"), found)
    assert values(paired, "stem", "duration_ms") == [("a", 500)] and values(lone, "stem") == [("x",)]


def test_strict_json_takes_one_value(spark):
    rows = spark.createDataFrame(list(enumerate(('{"a": 1}', '{"a": 1} x', '{"a": 1}{"b": 2}', ' [1] ', "3", '{"a": NaN}', '{"a": 1, "a": 2}', "", None))), "i int, t string")
    found = rows.select("i", documents.strict_json(F.col("t")).isNotNull().alias("ok"))
    assert [x[1] for x in values(found, "i", "ok")] == [True, False, False, True, True, False, False, False, False]


def test_canonical_json(spark):
    rows = spark.createDataFrame([('{"b": {"z": 1, "a": null}, "a": "é"}',), ('{"a": 1, "a": 2}',), ('{"é": 1, "é": 2}',), ("[1",), (None,)], "t string")
    found = [r.c for r in rows.select(documents.canonical_json(F.col("t")).alias("c")).collect()]
    assert found == ['{"a":"é","b":{"a":null,"z":1}}', None, None, None, None]


def test_forms_and_labels(spark):
    found = one(spark, text.nfc(F.lit("é")), text.scenario_label(F.lit("① ** A/S   Ｒeceipt ")), text.scenario_label(F.lit("-- Shop  One")), text.overlaps(F.lit(1), F.lit(3), F.lit(3), F.lit(5)), text.overlaps(F.lit(1), F.lit(4), F.lit(3), F.lit(5)))
    assert tuple(found) == ("é", "1 ** a/s receipt", "shop one", False, True)


def test_attempts_and_first_matches(spark):
    attempt = lambda *valid: F.array(*[F.struct(F.lit(v).alias("valid")) for v in valid])
    found = one(spark, *[contracts.attempt_fault(attempt(*x)) for x in ((True,), (False, True), (True, True), (True, False), (False, False, True))])
    assert tuple(found) == (None, None, "several_valid", "valid_not_last", "count")
    assert one(spark, journals.first_match([(F.lit(False), "a"), (F.lit(True), "b"), (F.lit(True), "c")], "d"))[0] == "b"


def test_hazards_of_the_fixed_patterns(spark):
    said = ("배터리가 부풀었어요", "배터리가 부풀었다면", "연기가 나요", "연기가 나요?", "타는 냄새가 납니다", "제품이 너무 뜨거워졌어요", "조용해요", None)
    rows = spark.createDataFrame(list(enumerate(said)), "i int, t string").select("i", validation.has_hazard(F.col("t")).alias("h"))
    assert [h for _, h in values(rows, "i", "h")] == [True, False, True, False, True, True, False, False]


def test_token_windows(spark):
    lists = spark.createDataFrame([(1, ["I saw the dog.", "the end"]), (2, None), (3, [])], "d int, c array<string>")
    found = evidence.token_windows(lists, ["d"], "c", 2, ".", ("og",), 1).orderBy("rank").drop("d", "rank")
    got = [tuple(r) for r in found.collect()]
    assert got[:5] == [(1, 0, 1, "I"), (1, 2, 5, "saw"), (1, 6, 9, "the"), (1, 10, 13, "dog"), (1, 10, 11, "d")]
    assert got[5:] == [(2, 0, 3, "the"), (2, 4, 7, "end"), (1, 0, 5, "I saw"), (1, 2, 9, "saw the"), (1, 6, 13, "the dog"), (1, 6, 11, "the d"), (2, 0, 7, "the end")]
    repeated = spark.createDataFrame([(1, ["a b a"])], "d int, c array<string>")
    assert [r.quote for r in evidence.token_windows(repeated, ["d"], "c", 1).collect()] == ["b"]
    marks = spark.createDataFrame([(1, ["“dog” … !!"])], "d int, c array<string>")
    assert [(r.start, r.end, r.quote) for r in evidence.token_windows(marks, ["d"], "c", 3, "“”!…").collect()] == [(1, 4, "dog")]


def test_anchors_elsewhere(spark):
    clause_list = F.array(F.lit("aaa"), F.lit("b c"))
    found = one(spark, evidence.relocated(clause_list, F.lit("b c")), evidence.relocated(clause_list, F.lit("aa")), evidence.relocated(clause_list, F.lit("x")))
    assert [tuple(x) for x in found] == [("wrong_clause_unique", 2), ("wrong_clause_ambiguous", None), ("quote_absent", None)]


def test_two_clusters(spark):
    rows = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 11, 12, 13)] + [("b", 5.0), ("b", 5.0)], "k string, v double")
    assert values(groups.two_clusters(rows, "k", "v"), "k", "low", "high", "threshold") == [("a", 2.0, 12.0, 7.0), ("b", 5.0, 5.0, 5.0)]


def test_dialogue_states(spark):
    turns = [(1, 0, "tell", "size", None), (1, 1, "tell", "color", None), (1, 2, "confirm", None, None), (1, 3, "confirm", None, None), (1, 4, "tell", "size", None), (2, 0, "tell", "size", "danger"), (2, 1, "change", "size", None), (2, 2, "cancel", None, None), (2, 3, "end", None, None)]
    machine = replace(machines.DIALOGUE, fields=("size", "color"), maps={})
    given = F.array_compact(F.array("field"))
    rows = spark.createDataFrame(turns, "d long, n long, action string, field string, guard string")
    rows = rows.select("d", "n", *machines.symbol(F.col("action"), F.when(F.col("action") != "change", given), F.when(F.col("action") == "change", given), F.col("guard")))
    for hot in ((), (1, 3)):
        found = machines.folded(rows, machine, "d", "n", *hot).withColumn("filled", F.size("filled"))
        states = [(d, n, f, s) for d, n, f, s in values(found, "d", "n", "filled", "state")]
        assert_dialogue_states(states)


def assert_dialogue_states(states):
    assert states == [(1, 0, 1, "collecting"), (1, 1, 2, "confirming"), (1, 2, 2, "ready"), (1, 3, 2, "completed"), (1, 4, 2, "completed"), (2, 0, 1, "danger"), (2, 1, 0, "collecting"), (2, 2, 0, "cancelled"), (2, 3, 0, "ended")]


def test_streamed_dialogues_end_where_the_fold_does(spark, tmp_path):
    turns = [("1", 0, "tell", "size"), ("1", 1, "tell", "color"), ("1", 2, "confirm", None), ("2", 0, "tell", "size"), ("2", 1, "change", "size"), ("2", 2, "cancel", None)]
    schema = "dialogue string, seq long, action string, field string"
    for i in range(3):
        spark.createDataFrame([x for x in turns if x[1] == i], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = streams.stream_dialogues(spark.readStream.schema(schema).option("maxFilesPerTrigger", 100).parquet(f"{tmp_path}/in"), 2)
    run = stream.writeStream.format("memory").queryName("dialogues").outputMode("update").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    run.awaitTermination(120)
    last = {r.dialogue: (r.turns, r.filled, r.state) for r in spark.table("dialogues").orderBy("turns").collect()}
    assert last == {"1": (3, 2, "ready"), "2": (3, 0, "cancelled")}


def test_dialogue_prompts(spark, tmp_path):
    files_of = {"a": [{"role": "User", "text": " hi "}, {"role": "assistant", "content": "ho"}, {"role": "judge", "text": "x"}, {"role": "user", "text": " "}, "x"], "b": {"role": "user"}, "c": []}
    for name, content in files_of.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(content))
    (tmp_path / "d.json").write_text("not json")
    found = files.read_dialogue_prompts(spark, str(tmp_path))
    got = sorted((r.file[-6], -1 if r.at is None else r.at, r.example, r.fault) for r in found.collect())
    assert got == [("a", 0, "user: hi", None), ("a", 1, "assistant: ho", None), ("a", 2, None, "role"), ("a", 3, None, "text"), ("a", 4, None, "not_an_object"), ("b", -1, None, "not_a_list"), ("d", -1, None, "not_a_list")]


def test_categories_without_words_have_a_row(spark):
    words = wordfreq.tokens(spark.createDataFrame([(1, "x", "a b a"), (2, "y", "b")], "i int, k string, text string"), ["i"], ["k"])
    found = wordfreq.by_category(words, spark.createDataFrame([("x",), ("z",)], "k string"), "k", 1)
    assert values(found, "k", "rank", "word", "cnt") == [("x", 1, "a", 2), ("z", None, None, 0)]


def test_incremental_means_of_a_long_history(spark):
    rows = spark.range(20_000).select(F.lit("hot").alias("k"), F.col("id").alias("n"), (F.col("id") % 7).cast("double").alias("x")).unionByName(spark.createDataFrame([("one", 0, 2.5), (None, 1, 1.0)], "k string, n long, x double"))
    state = (0, 0.0, 0.0)
    for i in range(20_000):
        state = baselines.rounded_step(*state, float(i % 7))
    found = {r.k: (r.samples, r["mean"], r.m2) for r in baselines.welford(rows, "k", ["n"], "x").collect()}
    assert found == {"hot": state, "one": (1, 2.5, 0.0)}
