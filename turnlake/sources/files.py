"""Readers and write-once sinks: labelled cases, journals, tables in Markdown, authoring folders, prompts, catalogues, recordings."""

from __future__ import annotations

import configparser
import io
import json
import unicodedata
import wave

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from turnlake.functions import voice
from turnlake.functions.documents import strict_json
from turnlake.functions.text import stripped

CASES = """version string, cases array<struct<id string, conversation_group_id string, split string, scenario_key string,
conversation_state string, current_fields map<string,string>, offered_alternative_times array<string>, user_message string,
labels struct<intent string, fields map<string,struct<accepted_values array<string>>>, user_action string, change_field string>,
tags array<string>, provenance string, review_status string>>"""


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """One row for each case of whole-file JSON datasets; a file that does not parse fails the read."""
    whole = spark.read.schema(CASES).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return whole.select("version", F.explode("cases").alias("c")).select("version", "c.*")


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """One row (file, seq, entry, fault) for each line of JSON-lines journals; seq is the entry's own number.

    entry is a variant, null where the line is not strict JSON (repeated keys and NaN are not); fault says so.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value").where(F.trim("value") != "")
    parsed = lines.withColumn("entry", strict_json(F.col("value")))
    return parsed.select("file", F.try_variant_get("entry", "$.seq", "long").alias("seq"), "entry", F.when(F.col("entry").isNull(), "malformed").alias("fault"))


def read_pipe_table(spark: SparkSession, path: str, id_pattern: str) -> DataFrame:
    """Rows (file, id, cells) of tables whose cells stand between upright bars, where the first cell matches id_pattern."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.trim("value").alias("line")).where(F.col("line").startswith("|"))
    cells = F.transform(F.split(F.regexp_replace("line", r"^\||\|$", ""), r"\|"), lambda x: F.trim(x))
    return lines.select("file", cells[0].alias("id"), cells.alias("cells")).where(F.col("id").rlike(id_pattern))


def read_folder(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """One row (file, digest, text) for each file of a folder and those below it."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("file"), F.sha2("value", 256).alias("digest"), F.col("value").alias("text"))


def write_once(rows: DataFrame, path: str) -> None:
    """Write Parquet to a place where nothing is yet; an existing one is an error and stays as it is."""
    rows.write.mode("errorifexists").parquet(path)


def folder_faults(files: DataFrame, manifest: str | None = None) -> DataFrame:
    """(file, fault) of a folder read by read_folder: empty (one row without a file), manifest_inside, and repeated (two files of equal content)."""
    count = files.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(None).cast("string").alias("file"), F.lit("empty").alias("fault"))
    again = files.groupBy("digest").agg(F.collect_list("file").alias("f")).where(F.size("f") > 1).select(F.explode("f").alias("file"), F.lit("repeated").alias("fault"))
    faults = count.unionByName(again)
    return faults if manifest is None else faults.unionByName(files.where(F.col("file").endswith("/" + manifest)).select("file", F.lit("manifest_inside").alias("fault")))


def journal_faults(journal: DataFrame, rows: int) -> DataFrame:
    """(file, seq, fault) of journals read by read_journal that should hold the entries 0 to rows - 1 once each: malformed, no_seq, repeated, beyond, missing (seq null: how many is the file's gap)."""
    counted = journal.groupBy("file", "seq").agg(F.count("*").alias("n"), F.max("fault").alias("bad"))
    fault = F.when(F.col("bad").isNotNull(), "malformed").when(F.col("seq").isNull(), "no_seq").when(F.col("n") > 1, "repeated").when((F.col("seq") < 0) | (F.col("seq") >= rows), "beyond")
    found = counted.select("file", "seq", fault.alias("fault")).where("fault is not null")
    held = journal.groupBy("file").agg(F.count_distinct(F.when(F.col("seq").between(0, rows - 1), F.col("seq"))).alias("held"))
    return found.unionByName(held.where(F.col("held") < rows).select("file", F.lit(None).cast("long").alias("seq"), F.lit("missing").alias("fault")))


def _sections(text: str) -> list[dict]:
    """Options of an INI text, section by section, names as they are written."""
    config = configparser.ConfigParser(interpolation=None)
    config.optionxform = str
    config.read_string(text)
    return [{"section": section, "name": name, "value": value.strip()} for section in config.sections() for name, value in config.items(section)]


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """One row (file, section, name, value, lines) for each option of INI files; an unreadable file fails the read.

    lines are the value's lines without blank ones; one line alone is cut at its commas.
    """
    option = ArrayType(StructType([StructField(x, StringType()) for x in ("section", "name", "value")]))

    @F.pandas_udf(option)
    def parsed(texts: pd.Series) -> pd.Series:
        return texts.map(_sections)

    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), parsed("value").alias("o"))
    each = whole.select("file", F.explode("o").alias("o")).select("file", "o.*")
    clean = lambda parts: F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")
    lines = clean(F.split("value", r"\r?\n"))
    return each.withColumn("lines", F.when((F.size(lines) == 1) & F.contains("value", F.lit(",")), clean(F.split("value", ","))).otherwise(lines))


def read_dialogue_prompts(spark: SparkSession, path: str, user: str = "user", other: str = "assistant") -> DataFrame:
    """One row (file, at, role, text, example, fault) for each item of JSON prompt files, a list of objects with role and text (or content).

    example is the item as a line of dialogue, speaker and text. fault: not_a_list (one row for the file), not_an_object,
    role (another than user, system or assistant), text (missing or blank). A file that is no JSON has not_a_list.
    """
    item = "struct<role: string, text: string, content: string>"
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", "array<string>").alias("items"))
    each = whole.select("file", "items", F.posexplode_outer("items").alias("at", "raw")).withColumn("x", F.from_json("raw", item))
    role, text = F.lower(F.col("x.role")), stripped(F.coalesce(F.when(F.col("x.text") != "", F.col("x.text")), F.col("x.content"), F.lit("")))
    rows = each.select("file", "items", "at", "raw", F.col("x").alias("x"), role.alias("role"), text.alias("text"))
    fault = (
        F.when(F.col("items").isNull(), "not_a_list")
        .when(F.col("at").isNotNull() & F.coalesce(F.json_object_keys("raw").isNull(), F.lit(True)), "not_an_object")
        .when(F.col("at").isNotNull() & ~F.coalesce(F.col("role").isin("user", "system", "assistant"), F.lit(False)), "role")
        .when(F.col("at").isNotNull() & (F.col("text") == ""), "text")
    )
    rows = rows.withColumn("fault", fault).where(F.col("at").isNotNull() | F.col("fault").isNotNull())
    speaker = F.when(F.col("role") == "user", user).otherwise(other)
    return rows.select("file", "at", "role", "text", F.when(F.col("fault").isNull(), F.concat_ws(": ", speaker, "text")).alias("example"), "fault")


CATALOG = "struct<schema_version: string, scenarios: map<string, string>>"


def read_availability(spark: SparkSession, path: str, version: str) -> DataFrame:
    """One row (file, scenario, request, slot, fault) for each request of availability catalogues (JSON), names trimmed; fault: version, empty, entry (other keys than the requests), blank."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", CATALOG).alias("c"))
    each = whole.select("file", "c", F.explode_outer("c.scenarios").alias("scenario", "entry"))
    requests = F.from_json("entry", "struct<available_requests: map<string, string>>")["available_requests"]
    spread = each.select("file", "c", F.trim("scenario").alias("scenario"), F.json_object_keys("entry").alias("keys"), F.explode_outer(requests).alias("request", "slot"))
    blank = lambda x: F.coalesce(F.trim(x) == "", F.lit(True))
    fault = (
        F.when(~F.col("c.schema_version").eqNullSafe(F.lit(version)), "version")
        .when(F.col("scenario").isNull(), "empty")
        .when(F.col("keys").isNull() | (F.array_join("keys", ",") != "available_requests"), "entry")
        .when(blank("scenario") | blank("request") | blank("slot"), "blank")
    )
    return spread.select("file", "scenario", F.trim("request").alias("request"), F.trim("slot").alias("slot"), fault.alias("fault"))


WAV = StructType([StructField("rate", IntegerType()), StructField("channels", IntegerType()), StructField("bits", IntegerType()), StructField("frames", LongType()), StructField("duration_ms", LongType())])


def read_recordings(spark: SparkSession, path: str) -> DataFrame:
    """One row (file, stem, digest, rate, channels, bits, frames, duration_ms, fault) for each WAV file of a folder and those below it; fault: unreadable, not_mono, not_16_bit."""

    @F.pandas_udf(WAV)
    def header(contents: pd.Series) -> pd.DataFrame:
        out = []
        for content in contents:
            try:
                with wave.open(io.BytesIO(content)) as sound:
                    rate, frames = sound.getframerate(), sound.getnframes()
                    out.append((rate, sound.getnchannels(), 8 * sound.getsampwidth(), frames, round(1000 * frames / rate) if rate else None))
            except (wave.Error, EOFError):
                out.append((None,) * 5)
        return pd.DataFrame(out, columns=[x.name for x in WAV], dtype=object)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.wav").load(path)
    found = files.select(F.col("path").alias("file"), stem(F.col("path")).alias("stem"), F.sha2("content", 256).alias("digest"), header("content").alias("h")).select("file", "stem", "digest", "h.*")
    return found.withColumn("fault", F.when(F.col("rate").isNull(), "unreadable").when(F.col("channels") != 1, "not_mono").when(F.col("bits") != 16, "not_16_bit"))


MEASURES = StructType([StructField(x, DoubleType()) for x in ("pitch_mean", "pitch_median", "jitter", "shimmer")] + [StructField("voiced", LongType()), StructField("fault", StringType())])


def measured_recordings(spark: SparkSession, path: str) -> DataFrame:
    """One row (file, stem, pitch_mean, pitch_median, jitter, shimmer, voiced, fault) for each WAV file of a folder and those below it.

    A file is read and measured in one task; fault: unreadable, not_mono, not_16_bit, or no_voice and no_periods, where
    the measures that need them are null.
    """

    @F.pandas_udf(MEASURES)
    def measured(contents: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_measured(x) for x in contents], columns=[x.name for x in MEASURES], dtype=object)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.wav").load(path)
    return files.select(F.col("path").alias("file"), stem(F.col("path")).alias("stem"), measured("content").alias("m")).select("file", "stem", "m.*")


def _measured(content: bytes) -> tuple:
    try:
        with wave.open(io.BytesIO(content)) as sound:
            if sound.getnchannels() != 1:
                return (*(None,) * 5, "not_mono")
            if sound.getsampwidth() != 2:
                return (*(None,) * 5, "not_16_bit")
            found = voice.measures(np.frombuffer(sound.readframes(sound.getnframes()), "<i2") / 32768, sound.getframerate())
    except (wave.Error, EOFError):
        return (*(None,) * 5, "unreadable")
    fault = "no_voice" if not found["voiced"] else "no_periods" if found["jitter"] is None else None
    return (*found.values(), fault)


def stem(path: Column) -> Column:
    """A file's name without folders and ending."""
    return F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)


def with_recordings(labels: DataFrame, recordings: DataFrame, key: str = "stem") -> tuple[DataFrame, DataFrame]:
    """(labels with their recordings, labels without one); a stem that several recordings share pairs with none."""
    single = recordings.groupBy(key).agg(F.count("*").alias("_n"), F.min_by("file", "file").alias("file"), F.min_by("duration_ms", "file").alias("duration_ms")).where("_n = 1").drop("_n")
    return labels.join(single, key), labels.join(single.select(key), key, "left_anti")


def walked(texts: DataFrame, text: str, name: str) -> DataFrame:
    """Distinct (value, digest) of all strings under a key of that name at any depth of JSON texts, or of the lines of JSON-lines texts: NFC, stripped, not empty.

    A text that does not parse gives nothing.
    """

    @F.pandas_udf(ArrayType(StringType()))
    def found(values: pd.Series) -> pd.Series:
        def below(node):
            if isinstance(node, dict):
                for key, value in node.items():
                    if key == name and isinstance(value, str):
                        yield unicodedata.normalize("NFC", value).strip()
                    yield from below(value)
            elif isinstance(node, list):
                for value in node:
                    yield from below(value)

        def of(value: str | None) -> list[str]:
            try:
                return list(below(json.loads(value or "null")))
            except ValueError:
                lines = value.split("\n")
                return [x for line in lines for x in of(line)] if len(lines) > 1 else []

        return values.map(of)

    each = texts.select(F.explode(found(text)).alias("value")).where("value <> ''").distinct()
    return each.select("value", F.sha2("value", 256).alias("digest"))
