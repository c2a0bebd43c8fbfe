"""Queries over the checks of states, evidence, ledgers, coverage and dialogues, each with the SQL that gives the same rows (DuckDB).

The tables have no dialogue states, so the queries make them from orders, customers, events and texts, by the rules that
the SQL spells out on its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnlake.functions import documents
from turnlake.functions.numbers import epoch_seconds, years_between
from turnlake.functions.text import clauses, first_given, labelled, options_text, overlaps, rendered, scenario_key
from turnlake.operators import baselines, contracts, coverage, dialogues, drafts, evidence, graphs, groups, integrity, ledgers, machines, quotes, scoring, validation
from turnlake.plans.catalogue import BASELINE, CANDIDATE, _cases, _flags_sql, _pairs, _predictions, table
from turnlake.session import checkpointed
from turnlake.sources import files
from turnlake.streaming import calibration

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL for the same rows."""

    def register(build):
        QUERIES[build.__name__] = build
        if sql:
            ORACLE_SQL[build.__name__] = sql
        return build

    return register


def counted(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("cnt"))


def pick(key: str, n: int, *values) -> Column:
    """One of the values by the remainder of a key; beyond them null."""
    found = F.lit(None)
    for i, value in enumerate(values):
        found = F.when(F.col(key) % n == i, value).otherwise(found)
    return found


# States and turns


@query(
    """SELECT fault, count(*) AS cnt, count(id) AS ids FROM (SELECT CASE WHEN r IS NULL THEN 'missing' WHEN p = '' THEN 'empty' WHEN length(p) > 128 THEN 'too_long' WHEN contains(p, chr(7)) THEN 'control' END AS fault,
CASE WHEN fault IS NULL THEN p END AS id FROM (SELECT r, trim(r) AS p FROM (SELECT CASE c_custkey % 6 WHEN 0 THEN ' ' || c_name || '  ' WHEN 1 THEN NULL WHEN 2 THEN '   ' WHEN 3 THEN repeat(c_name, 9) WHEN 4 THEN c_name || chr(7) || 'x' ELSE c_name END AS r FROM customer))) GROUP BY fault"""
)
def user_id_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("c_name")
    raw = pick("c_custkey", 6, F.concat(F.lit(" "), name, F.lit("  ")), F.lit(None).cast("string"), F.lit("   "), F.repeat(name, F.lit(9)), F.concat(name, F.lit("\x07x")), name)
    rows = table(spark, sf_dir, "customer").select(validation.user_id(raw).alias("u"))
    return rows.groupBy("u.fault").agg(F.count("*").alias("cnt"), F.count("u.id").alias("ids"))


_TURN = """SELECT o_orderkey AS k, ['provide', 'change', 'other'][o_orderkey % 3 + 1] AS action, CASE WHEN o_orderkey % 5 < 3 THEN ['size', 'color', 'place'][o_orderkey % 5 + 1] END AS change_field,
CASE WHEN o_custkey % 2 = 0 THEN 'L' END AS size_now, CASE WHEN o_custkey % 3 = 0 THEN 'red' END AS color_now, CASE WHEN o_orderkey % 7 = 0 THEN ['L', 'S'][o_custkey % 4 // 2 + 1] END AS size_new,
CASE WHEN o_orderkey % 11 = 0 THEN 'blue' END AS color_new, o_orderkey % 29 = 0 AS odd FROM orders"""


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    now = [F.lit("size"), F.when(c % 2 == 0, "L"), F.lit("color"), F.when(c % 3 == 0, "red")]
    return table(spark, sf_dir, "orders").select(
        k.alias("k"),
        pick("o_orderkey", 3, F.lit("provide"), F.lit("change"), F.lit("other")).alias("action"),
        pick("o_orderkey", 5, F.lit("size"), F.lit("color"), F.lit("place")).alias("change_field"),
        F.when(k % 29 == 0, F.create_map(*now, F.lit("odd"), F.lit("x"))).otherwise(F.create_map(*now)).alias("current"),
        F.create_map(F.lit("size"), F.when(k % 7 == 0, F.when(c % 4 < 2, "L").otherwise("S")), F.lit("color"), F.when(k % 11 == 0, "blue")).alias("fields"),
    )


@query(
    f"""SELECT fault, count(*) AS cnt FROM (SELECT CASE WHEN odd THEN 'context_fields'
WHEN action = 'provide' AND ((size_new IS NOT NULL AND size_now IS NOT NULL) OR (color_new IS NOT NULL AND color_now IS NOT NULL)) THEN 'already_collected'
WHEN action = 'change' AND (change_field IS NULL OR change_field = 'place') THEN 'change_field_unknown'
WHEN action = 'change' AND CASE change_field WHEN 'size' THEN size_now ELSE color_now END IS NULL THEN 'change_target_empty'
WHEN action = 'change' AND ((change_field <> 'size' AND size_new IS NOT NULL) OR (change_field <> 'color' AND color_new IS NOT NULL)) THEN 'change_extra_field'
WHEN action = 'change' AND CASE change_field WHEN 'size' THEN size_new = size_now ELSE color_new = color_now END THEN 'change_same_value'
WHEN action <> 'change' AND change_field IS NOT NULL THEN 'change_field_unexpected' END AS fault FROM ({_TURN})) GROUP BY fault"""
)
def turn_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    fault = validation.turn_fault(F.array(F.lit("size"), F.lit("color")), F.col("fields"), F.col("current"), F.col("action"), F.col("change_field"))
    return counted(_turns(spark, sf_dir).select(fault.alias("fault")), "fault")


@query(
    """SELECT fault, count(*) AS cnt FROM (SELECT CASE WHEN s = 'greeting' AND n > 0 THEN 'greeting_not_empty' WHEN s = 'collecting' AND n = 2 THEN 'collecting_complete'
WHEN s IN ('confirming', 'ready') AND n < 2 THEN 'incomplete' WHEN s <> 'ready' AND (h = (s <> 'danger')) THEN 'guard_hazard' END AS fault
FROM (SELECT ['greeting', 'collecting', 'confirming', 'ready', 'danger'][o_orderkey % 5 + 1] AS s, (o_custkey % 2 = 0)::INT + (o_custkey % 3 = 0)::INT AS n, o_custkey % 3 = 0 AND o_custkey % 9 = 0 AS h FROM orders)) GROUP BY fault"""
)
def context_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("o_custkey")
    current = F.create_map(F.lit("size"), F.when(c % 2 == 0, "L"), F.lit("hazard"), F.when(c % 9 == 0, "yes").when(c % 3 == 0, "no"))
    state = pick("o_orderkey", 5, *[F.lit(x) for x in ("greeting", "collecting", "confirming", "ready", "danger")])
    fault = validation.context_fault(current, state, "collecting", ("confirming", "ready"), {"hazard": ("yes", "danger")}, ("ready",))
    return counted(table(spark, sf_dir, "orders").select(fault.alias("fault")), "fault")


@query(
    """WITH r AS (SELECT (doc_id % 3)::INT AS present, CASE WHEN doc_id % 5 = 0 THEN 'unknown' ELSE 'tell' END AS action, list_filter([CASE WHEN doc_id % 4 = 0 THEN 'single_field' END, CASE WHEN doc_id % 4 = 1 THEN 'multi_field' END,
CASE WHEN doc_id % 7 = 0 THEN 'hard_negative' END, CASE WHEN doc_id % 2 = 0 THEN 'fixed' END, CASE WHEN doc_id % 6 = 0 THEN 'fixed' END, CASE WHEN doc_id % 11 = 0 THEN 'safety' END], lambda x: x IS NOT NULL) AS tags,
CASE WHEN doc_id % 8 = 0 THEN ['fixed'] ELSE [] END AS required, doc_id % 22 = 0 AS safe FROM documents),
f AS (SELECT unnest(list_filter([CASE WHEN len(list_distinct(tags)) <> len(tags) THEN 'repeated_tag' END, CASE WHEN list_contains(tags, 'single_field') <> (present = 1) THEN 'single_field' END,
CASE WHEN list_contains(tags, 'multi_field') <> (present >= 2) THEN 'multi_field' END, CASE WHEN list_contains(tags, 'fixed') <> list_contains(required, 'fixed') THEN 'objective_tags' END,
CASE WHEN list_contains(tags, 'hard_negative') AND (action <> 'unknown' OR present > 0) THEN 'hard_negative' END, CASE WHEN list_contains(tags, 'safety') <> safe THEN 'safety' END], lambda x: x IS NOT NULL)) AS fault FROM r)
SELECT fault, count(*) AS cnt FROM f GROUP BY fault"""
)
def tag_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    named = [(d % 4 == 0, "single_field"), (d % 4 == 1, "multi_field"), (d % 7 == 0, "hard_negative"), (d % 2 == 0, "fixed"), (d % 6 == 0, "fixed"), (d % 11 == 0, "safety")]
    tags = F.array_compact(F.array(*[F.when(test, tag) for test, tag in named]))
    required = F.when(d % 8 == 0, F.array(F.lit("fixed"))).otherwise(F.expr("cast(array() as array<string>)"))
    rows = table(spark, sf_dir, "documents").select(tags.alias("tags"), (d % 3).alias("present"), F.when(d % 5 == 0, "unknown").otherwise("tell").alias("action"), required.alias("required"), (d % 22 == 0).alias("safe"))
    found = validation.tag_faults(F.col("tags"), F.col("present"), F.col("action"), F.col("required"), ("fixed",), F.col("safe"))
    return counted(rows.select(F.explode(found).alias("fault")), "fault")


@query(
    """SELECT fault, count(*) AS cnt FROM (SELECT CASE WHEN req = 'odd' OR (held AND own = 'odd') THEN 'state_invalid' WHEN req = 'END' OR (held AND own = 'END') THEN 'already_ended'
WHEN held AND key IS DISTINCT FROM 'shop:order' THEN 'scenario_mismatch' WHEN held AND version IS DISTINCT FROM '2' THEN 'version_unsupported' WHEN held AND extra THEN 'unknown_field' WHEN held AND req <> own THEN 'state_mismatch' END AS fault
FROM (SELECT CASE c_custkey % 5 WHEN 0 THEN 'odd' WHEN 1 THEN 'END' WHEN 2 THEN 'open' WHEN 3 THEN 'ready' END AS req, CASE c_nationkey % 4 WHEN 0 THEN 'odd' WHEN 1 THEN 'open' WHEN 2 THEN 'ready' END AS own,
c_custkey % 7 <> 0 AS held, CASE WHEN c_custkey % 11 <> 0 THEN 'shop:order' END AS key, CASE WHEN c_custkey % 13 <> 0 THEN '2' ELSE '1' END AS version, c_custkey % 17 = 0 AS extra FROM customer)) GROUP BY fault"""
)
def client_state_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    held = [F.lit("conversation_state"), pick("c_nationkey", 4, F.lit("odd"), F.lit("open"), F.lit("ready")), F.lit("scenario_key"), F.when(c % 11 != 0, "shop:order"), F.lit("state_version"), F.when(c % 13 != 0, "2").otherwise("1")]
    state = F.when(c % 7 != 0, F.when(c % 17 == 0, F.create_map(*held, F.lit("extra"), F.lit("x"))).otherwise(F.create_map(*held)))
    fault = validation.client_state_fault(pick("c_custkey", 5, *[F.lit(x) for x in ("odd", "END", "open", "ready")]), state, F.lit("shop:order"), 2, ("conversation_state", "size"), ("open", "ready", "END"))
    return counted(table(spark, sf_dir, "customer").select(fault.alias("fault")), "fault")


@query(
    """SELECT fault, count(*) AS cnt FROM (SELECT CASE WHEN s NOT IN ('available', 'unavailable') THEN 'status' WHEN trim(r) = '' THEN 'reason_blank' WHEN n = 3 THEN 'alternatives_blank' WHEN n = 2 THEN 'alternatives_repeated'
WHEN s = 'available' AND (t IS NULL OR r IS NOT NULL OR n > 0) THEN 'available_shape' WHEN s = 'unavailable' AND (t IS NOT NULL OR r IS NULL) THEN 'unavailable_shape' END AS fault
FROM (SELECT CASE p_partkey % 7 WHEN 0 THEN 'maybe' WHEN 1 THEN 'unavailable' WHEN 2 THEN 'unavailable' ELSE 'available' END AS s, CASE p_partkey % 5 WHEN 0 THEN 'full' WHEN 1 THEN ' ' END AS r, CASE WHEN p_size % 2 = 0 THEN '10:00' END AS t, p_size % 4 AS n FROM part)) GROUP BY fault"""
)
def availability_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    none, text = F.expr("cast(array() as array<string>)"), lambda *x: F.array(*[F.lit(y) for y in x])
    status = F.coalesce(pick("p_partkey", 7, F.lit("maybe"), F.lit("unavailable"), F.lit("unavailable")), F.lit("available"))
    alternatives = pick("p_size", 4, none, text("11:00"), text("11:00", "11:00 "), text("11:00", " "))
    fault = validation.availability_fault(status, pick("p_partkey", 5, F.lit("full"), F.lit(" ")), F.when(F.col("p_size") % 2 == 0, "10:00"), alternatives)
    return counted(table(spark, sf_dir, "part").select(fault.alias("fault")), "fault")


@query(
    """SELECT fault, count(*) AS cnt FROM (SELECT CASE WHEN NOT w AND sel IS NOT NULL THEN 'selected_outside' WHEN w AND (a <> (sel IS NOT NULL)) THEN 'selected_with_action' WHEN sel IS NOT NULL AND sel NOT IN ('10', '11') THEN 'not_offered' END AS fault
FROM (SELECT p_partkey % 2 = 0 AS w, p_partkey % 3 = 0 AS a, CASE p_size % 4 WHEN 0 THEN '10' WHEN 1 THEN '12' END AS sel FROM part)) GROUP BY fault"""
)
def alternative_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    fault = validation.alternative_fault(
        F.when(k % 2 == 0, "choosing").otherwise("open"), F.when(k % 3 == 0, "select_alternative").otherwise("other"), pick("p_size", 4, F.lit("10"), F.lit("12")), F.array(F.lit("10"), F.lit("11")), ("choosing",)
    )
    return counted(table(spark, sf_dir, "part").select(fault.alias("fault")), "fault")


@query(
    """SELECT shape, code, count(*) AS cnt, sum(different)::BIGINT AS different FROM (SELECT concat_ws(',', CASE WHEN o_orderkey % 3 = 0 THEN 'color' END, CASE WHEN o_orderkey % 2 = 0 THEN 'size' END) AS shape,
CASE o_custkey % 4 WHEN 0 THEN 'timeout' WHEN 1 THEN 'json' WHEN 2 THEN 'other' END AS code, (o_orderkey % 2 = 0)::INT + (o_orderkey % 3 = 0)::INT AS different FROM orders) GROUP BY ALL"""
)
def output_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    fields = F.create_map(F.lit("size"), F.when(k % 2 == 0, "L"), F.lit("color"), F.when(k % 3 == 0, "red"))
    message = pick("o_custkey", 4, F.lit("call timed out: timeout"), F.lit("bad json, then timeout"), F.lit("odd"))
    found = table(spark, sf_dir, "orders").select(
        F.array_join(validation.output_shape(fields), ",").alias("shape"),
        validation.failure_code(message, {"bad json": "json", "timeout": "timeout"}).alias("code"),
        F.size(validation.mismatches(fields, F.create_map(F.lit("size"), F.lit(None).cast("string")))).alias("n"),
    )
    return found.groupBy("shape", "code").agg(F.count("*").alias("cnt"), F.sum("n").alias("different"))


@query("""SELECT setting, fault FROM (VALUES ('rows', 'differs'), ('model', 'is_the_same')) v(setting, fault) WHERE (SELECT count(*) FROM orders) <> (SELECT count(*) FROM lineitem)""")
def settings_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = lambda name: table(spark, sf_dir, name).agg(F.count("*").alias("rows"), F.lit("a").alias("model"), F.lit(7).alias("seed"))
    return validation.settings_faults(report("orders"), report("lineitem"), ["rows", "seed"], ["model"])


@query(
    """SELECT fault, count(*) AS cnt FROM (SELECT CASE WHEN s IS NOT NULL AND d THEN 'decision_kept' WHEN s IN ('contract', 'route') AND f IS DISTINCT FROM 'stop' THEN 'finish_after_response' WHEN s = 'response' AND f IS NOT NULL AND f <> 'length' THEN 'finish_in_response' END AS fault
FROM (SELECT CASE user_id % 4 WHEN 0 THEN 'contract' WHEN 1 THEN 'route' WHEN 2 THEN 'response' END AS s, event_id % 13 = 0 AS d, CASE event_id % 3 WHEN 0 THEN 'stop' WHEN 1 THEN 'length' END AS f FROM events)) GROUP BY fault"""
)
def error_row_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage, finish = pick("user_id", 4, F.lit("contract"), F.lit("route"), F.lit("response")), pick("event_id", 3, F.lit("stop"), F.lit("length"))
    fault = validation.error_row_fault(stage, F.when(F.col("event_id") % 13 == 0, "yes"), finish)
    return counted(table(spark, sf_dir, "events").select(fault.alias("fault")), "fault")


@query(
    """SELECT denied, count(*) AS cnt FROM (SELECT CASE WHEN starts_with(doc_id::VARCHAR, '9') OR starts_with(doc_id::VARCHAR, '41') THEN 'id_prefix' WHEN text IN (SELECT text FROM documents WHERE source = 'src1') THEN 'text' END AS denied FROM documents) GROUP BY denied"""
)
def denylist(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return counted(validation.denied(docs, "doc_id", F.col("text"), ("9", "41"), docs.where("source = 'src1'").select(F.sha2("text", 256).alias("hash"))), "denied")


@query("SELECT count(*) FILTER (n = 1 AND g = 'f' AND a BETWEEN 30 AND 59) AS eligible, count(*) AS recordings FROM (SELECT c_custkey % 3 AS n, CASE WHEN c_custkey % 2 = 0 THEN 'f' ELSE 'm' END AS g, 20 + c_nationkey * 2 AS a FROM customer)")
def eligible_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.struct(F.when(F.col("c_custkey") % 2 == 0, "f").otherwise("m").alias("gender"))
    speakers = F.array_repeat(one, (F.col("c_custkey") % 3).cast("int"))
    test = validation.eligible(speakers, "f", 30, 59, 20 + F.col("c_nationkey") * 2)
    return table(spark, sf_dir, "customer").agg(F.count_if(test).alias("eligible"), F.count("*").alias("recordings"))


@query("SELECT missing, count(*) AS cnt FROM (SELECT concat_ws(',', CASE WHEN s_suppkey % 2 = 0 THEN 'date' END, CASE WHEN s_acctbal < 0 THEN 'time' END, CASE WHEN s_nationkey > 12 THEN 'people' END) AS missing FROM supplier) GROUP BY missing")
def missing_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    required = {"date": F.when(F.col("s_suppkey") % 2 != 0, "x"), "time": F.when(F.col("s_acctbal") >= 0, "x"), "people": F.when(F.col("s_nationkey") <= 12, "x")}
    return counted(table(spark, sf_dir, "supplier").select(F.array_join(validation.missing_required(required), ",").alias("missing")), "missing")


@query()
def hazard_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    said = F.concat_ws(" ", "text", F.when(F.col("turn") % 5 == 0, "배터리가 부풀었어요").when(F.col("turn") % 5 == 1, "연기가 나요?"))
    return groups.conditional_counts(turns.withColumn("said", said), ["role"], {"direct": validation.has_hazard(F.col("said"))})


# Quotes and evidence


@query(
    r"""WITH c AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?。])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), lambda x: x <> '') AS c FROM documents WHERE text IS NOT NULL),
n AS (SELECT doc_id, list_transform(c, lambda x: ((length(x) - length(replace(x, 'the ', ''))) // 4)::INT) AS n FROM c)
SELECT status, count(*) AS cnt, sum(clause)::BIGINT AS clauses FROM (SELECT CASE WHEN coalesce(list_sum(n), 0) = 1 THEN 'wrong_clause_unique' WHEN list_sum(n) > 1 THEN 'wrong_clause_ambiguous' ELSE 'quote_absent' END AS status,
CASE WHEN list_sum(n) = 1 THEN list_position(n, 1) END AS clause FROM n) GROUP BY status"""
)
def quote_relocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").where("text is not null").select(evidence.relocated(clauses(F.col("text")), F.lit("the ")).alias("r"))
    return found.groupBy("r.status").agg(F.count("*").alias("cnt"), F.sum("r.clause").alias("clauses"))


@query(
    """SELECT fault, count(*) AS cnt FROM (SELECT CASE WHEN doc_id % 5 = 0 THEN 'field_set' WHEN b > n OR n = 0 THEN 'range:a' WHEN doc_id % 3 = 0 THEN 'quote:a' WHEN trim(substring(text, doc_id % 7 + 1, b - doc_id % 7), ' ' || chr(10)) = '' THEN 'quote:a' END AS fault
FROM (SELECT doc_id, text, length(text) AS n, (doc_id % 7 + 6) AS b FROM documents WHERE text IS NOT NULL)) GROUP BY fault"""
)
def evidence_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, text = F.col("doc_id"), F.col("text")
    start, end = (d % 7).cast("int"), (d % 7 + 6).cast("int")
    quote = F.when(d % 3 == 0, "no such words").otherwise(F.substring(text, start + 1, end - start))
    spans = F.create_map(F.lit("a"), F.struct(start.alias("start"), end.alias("end"), quote.alias("quote")))
    fields = F.create_map(F.lit("a"), F.when(d % 5 != 0, "x"), F.lit("b"), F.lit(None).cast("string"))
    rows = table(spark, sf_dir, "documents").where("text is not null")
    return counted(rows.select(evidence.evidence_fault(text, fields, spans).alias("fault")), "fault")


_CLAUSES_SQL = r"""SELECT conv_id, turn, list_filter(list_transform(string_split(regexp_replace(text, '([.!?。])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), lambda x: x <> '') AS c FROM conversations"""
_ENDINGS = ("ing", "en", "s", "e")


@query(
    rf"""WITH c AS (SELECT conv_id, turn, unnest(c) AS text, generate_subscripts(c, 1) AS clause FROM ({_CLAUSES_SQL})),
w AS (SELECT *, unnest(regexp_extract_all(text, '[^\s\p{{Z}}]+')) AS tok, unnest(regexp_split_to_array(text, '[^\s\p{{Z}}]+')[1 : len(regexp_extract_all(text, '[^\s\p{{Z}}]+'))]) AS gap, unnest(range(1, len(regexp_extract_all(text, '[^\s\p{{Z}}]+')) + 1)) AS pos FROM c),
p AS (SELECT *, sum(length(gap) + length(tok)) OVER (PARTITION BY conv_id, turn, clause ORDER BY pos) - length(tok) AS b FROM w),
e AS (SELECT *, b + length(tok) - length(ltrim(tok, '.,!?')) AS s, b + length(rtrim(tok, '.,!?')) AS t, trim(tok, '.,!?') <> '' AS ok FROM p),
x AS (SELECT a.conv_id, a.turn, a.clause, a.text, z.pos - a.pos + 1 AS width, a.s, z.t, substring(a.text, z.b::INT + 1, (z.t - z.b)::INT) AS tail FROM e a JOIN e z ON a.conv_id = z.conv_id AND a.turn = z.turn AND a.clause = z.clause AND z.pos BETWEEN a.pos AND a.pos + 2 WHERE a.ok AND z.ok),
n AS (SELECT *, CASE WHEN ends_with(tail, 'ing') AND length(tail) >= 5 THEN 3 WHEN ends_with(tail, 'en') AND length(tail) >= 4 THEN 2 WHEN ends_with(tail, 's') AND length(tail) >= 3 THEN 1 WHEN ends_with(tail, 'e') AND length(tail) >= 3 THEN 1 ELSE 0 END AS k FROM x),
v AS (SELECT *, unnest(CASE WHEN k > 0 THEN [0, k] ELSE [0] END) AS cut FROM n),
q AS (SELECT *, substring(text, s::INT + 1, (t - cut - s)::INT) AS quote FROM v WHERE s < t - cut),
u AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY width, clause, s, cut) AS rank FROM q WHERE instr(substring(text, instr(text, quote) + 1), quote) = 0)
SELECT conv_id, turn, count(*) AS candidates, count(DISTINCT quote) AS quotes, sum(rank * (s + 1))::BIGINT AS places, max(CASE WHEN rank = 7 THEN quote END) AS seventh FROM u GROUP BY ALL"""
)
def token_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", clauses(F.col("text")).alias("c"))
    found = evidence.token_windows(said, ["conv_id", "turn"], "c", 3, ".,!?", _ENDINGS)
    return found.groupBy("conv_id", "turn").agg(
        F.count("*").alias("candidates"), F.count_distinct("quote").alias("quotes"), F.sum(F.col("rank") * (F.col("start") + 1)).alias("places"), F.max(F.when(F.col("rank") == 7, F.col("quote"))).alias("seventh")
    )


@query(
    r"""WITH t AS (SELECT list_filter(regexp_extract_all(text, '[^\s\p{Z}]+'), lambda x: true) AS w FROM conversations), s AS (SELECT w, list_position(w, 'the') AS p FROM t)
SELECT status, count(*) AS cnt FROM (SELECT CASE WHEN p IS NULL OR p = 0 THEN 'not_generated' WHEN p <= 20 THEN 'selected' ELSE 'truncated' END AS status FROM s) GROUP BY status"""
)
def candidate_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.regexp_extract_all("text", F.lit(r"[^\s\p{Z}]+"), F.lit(0))
    candidates = F.transform(words, lambda x: F.struct(F.lit(1).alias("clause"), x.alias("quote")))
    rows = table(spark, sf_dir, "conversations").select(candidates.alias("c"))
    return evidence.status_counts(rows, evidence.coverage_status(F.col("c"), 20, F.lit(1), F.lit("the")))


@query(
    """SELECT value, basis, count(*) AS cnt FROM (SELECT CASE WHEN text LIKE '%@%' THEN 'direct' WHEN text LIKE '%the %' THEN 'related' WHEN text LIKE 'De %' THEN 'related' ELSE 'abstain' END AS value,
CASE WHEN text LIKE '%@%' THEN 'mark' WHEN text LIKE '%the %' THEN 'word' WHEN text LIKE 'De %' THEN 'start' ELSE 'none' END AS basis FROM documents WHERE text IS NOT NULL) GROUP BY ALL"""
)
def lexical_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    rule = evidence.ordered_rules([(text.contains("@"), "direct", "mark"), (text.contains("the "), "related", "word"), (text.startswith("De "), "related", "start")], "abstain")
    rows = table(spark, sf_dir, "documents").where("text is not null").select(rule.alias("r"))
    return rows.groupBy("r.value", "r.basis").agg(F.count("*").alias("cnt"))


@query(
    """SELECT fault, count(*) AS cnt FROM (SELECT CASE WHEN rel NOT IN ('same', 'other') THEN 'relation_unknown' WHEN ec IS NOT NULL THEN 'event_unanchored' WHEN oc IS NOT NULL THEN 'owner_unanchored' WHEN same AND greatest(es, os) < least(es + 5, os + 3) THEN 'spans_overlap' WHEN rel = 'same' AND NOT same THEN 'same_in_other_clause' END AS fault
FROM (SELECT CASE l_orderkey % 5 WHEN 0 THEN 'odd' WHEN 1 THEN 'other' ELSE 'same' END AS rel, CASE WHEN l_partkey % 17 = 0 THEN 'quote_blank' END AS ec, CASE WHEN l_suppkey % 19 = 0 THEN 'quote_blank' END AS oc, l_linenumber % 2 = 0 AS same, l_quantity::INT AS es, (l_partkey % 50)::INT AS os FROM lineitem)) GROUP BY fault"""
)
def edge_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    start, owner_start = F.col("l_quantity").cast("int"), (F.col("l_partkey") % 50).cast("int")
    span = lambda bad, clause, a, size: F.struct(F.when(bad, "quote_blank").alias("code"), clause.alias("clause"), a.alias("start"), (a + size).alias("end"))
    event = span(F.col("l_partkey") % 17 == 0, F.lit(1), start, 5)
    owner = span(F.col("l_suppkey") % 19 == 0, F.when(F.col("l_linenumber") % 2 == 0, 1).otherwise(2), owner_start, 3)
    relation = F.coalesce(pick("l_orderkey", 5, F.lit("odd"), F.lit("other")), F.lit("same"))
    return counted(table(spark, sf_dir, "lineitem").select(evidence.edge_fault(event, owner, relation, ("same", "other")).alias("fault")), "fault")


_EDGES_SQL = """WITH RECURSIVE o AS (SELECT o_custkey AS c, o_orderkey AS k, o_orderstatus AS s, row_number() OVER w AS n, lag(o_orderkey) OVER w AS before, lag(o_orderkey, 2) OVER w AS earlier, max(o_orderkey) OVER (PARTITION BY o_custkey) AS last FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
e AS (SELECT c, k, CASE WHEN k % 17 = 0 THEN -1 WHEN n > 1 THEN before WHEN c % 11 = 0 THEN last END AS w, ['same_entity', 'part_of', 'located_at', 'coreference', 'distinct', 'unresolved'][k % 6 + 1] AS kind FROM o
UNION ALL SELECT c, k, earlier, 'part_of' FROM o WHERE k % 13 = 0)"""


@query(
    _EDGES_SQL
    + """, g AS (SELECT * FROM e WHERE w IS NOT NULL),
f AS (SELECT c, k, min(f) AS f FROM (SELECT c, k, 'several_owners' AS f FROM g GROUP BY ALL HAVING count(DISTINCT w) > 1 UNION ALL SELECT c, k, 'edge_to_itself' FROM g WHERE k = w UNION ALL SELECT c, k, 'owner_missing' FROM g WHERE w = -1) GROUP BY ALL),
s AS (SELECT c, k, min((w, kind)) AS x, count(*) OVER (PARTITION BY c) AS size FROM g GROUP BY c, k),
h AS (SELECT c, k, x[1] AS pos, x[2] AS kind, 1 AS len, size, f FROM s LEFT JOIN f USING (c, k)
UNION ALL SELECT h.c, h.k, s.x[1], s.x[2], len + 1, h.size, least(h.f, f.f) FROM h JOIN s ON h.c = s.c AND h.pos = s.k LEFT JOIN f ON f.c = s.c AND f.k = s.k WHERE len <= h.size),
z AS (SELECT c, k, arg_max(pos, len) AS root, arg_max(kind, len) AS kind, max(len) > any_value(size) AS circle, arg_max(coalesce(f, 'zz'), len) AS f FROM h GROUP BY c, k),
r AS (SELECT s, CASE WHEN circle THEN 'circle' WHEN circle IS NULL THEN 'no_owner' WHEN f <> 'zz' THEN f END AS fault, kind, root, o.c FROM o LEFT JOIN z USING (c, k)),
q AS (SELECT s, fault, CASE WHEN fault IS NOT NULL THEN 'unknown' WHEN kind = 'distinct' THEN 'other' WHEN kind <> 'unresolved' AND c % 3 <> 0 THEN 'current' ELSE 'unknown' END AS relation FROM r)
SELECT relation, fault, CASE WHEN relation = 'other' THEN 'collecting_service_request' WHEN relation = 'current' AND s = 'F' THEN 'safety_action_required' ELSE 'confirming_safety_status' END AS route, count(*) AS cnt FROM q GROUP BY ALL"""
)
def evidence_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as a graph: each order belongs to the one before it, with circles, second owners and owners that do not exist."""
    over = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    k, c = F.col("node"), F.col("case")
    marked = checkpointed(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("case"), F.col("o_orderkey").alias("node"), "o_orderstatus", F.row_number().over(over).alias("n"), F.lag("o_orderkey").over(over).alias("before"), F.lag("o_orderkey", 2).over(over).alias("earlier"), F.max("o_orderkey").over(Window.partitionBy("o_custkey")).alias("last")))
    owner = F.when(k % 17 == 0, -1).when(F.col("n") > 1, F.col("before")).when(c % 11 == 0, F.col("last"))
    kind = pick("node", 6, *[F.lit(x) for x in (*graphs.CURRENT, *graphs.OTHER, "unresolved")])
    edges = marked.select("case", "node", owner.cast("long").alias("owner"), kind.alias("kind")).unionByName(marked.where(k % 13 == 0).select("case", "node", F.col("earlier").alias("owner"), F.lit("part_of").alias("kind"))).where("owner is not null")
    events = marked.select("case", "node", F.when(F.col("o_orderstatus") == "F", "observed").otherwise("possible").alias("occurrence"))
    targets = marked.where((F.col("n") == 1) & (c % 3 != 0)).select("case", "node")
    found = graphs.event_relations(events, edges, marked.select("case", "node"), targets)
    return counted(found, "relation", "fault", "route")


@query(
    """WITH h AS (SELECT b.item_id, d.doc_id, d.text, b.text AS q FROM documents d JOIN benchmark b ON b.text <> '' AND contains(d.text, b.text)),
p AS (SELECT item_id, doc_id, unnest(list_filter(range(0, length(text) - length(q) + 1), lambda i: substring(text, i + 1, length(q)) = q)) AS start, length(q) AS n FROM h)
SELECT item_id, doc_id, start::INT AS start, (start + n)::INT AS "end" FROM p"""
)
def located_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place of every benchmark passage in all documents."""
    return quotes.located(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text")


@query("SELECT count(*) FILTER (o_orderkey % 4 <> 0 AND o_orderkey % 2 = 0 AND o_custkey % 3 <> 0) AS passed, count(*) AS cases FROM orders")
def evidence_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    attempt = F.struct((k % 2 == 0).alias("valid"), (F.col("o_custkey") % 3 != 0).alias("evidence_valid"))
    attempts = F.when(k % 4 == 0, F.slice(F.array(attempt), 1, 0)).otherwise(F.array(attempt))
    return table(spark, sf_dir, "orders").agg(F.count_if(evidence.last_evidence_passes(attempts)).alias("passed"), F.count("*").alias("cases"))


# Ledgers, lineages, journals


@query(
    """WITH c AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 3 <> 0), l AS (SELECT doc_id, CASE WHEN doc_id % 20 = 1 THEN 'x' ELSE sha256(text) END AS h, CASE WHEN doc_id % 11 = 0 THEN 'open' ELSE 'adjudicated' END AS status FROM documents WHERE doc_id % 7 <> 0),
r AS (SELECT doc_id, count(*) AS n, max(h) AS h, max((status <> 'adjudicated')::INT) AS o FROM l GROUP BY 1)
SELECT fault, count(*) AS cnt FROM (SELECT CASE WHEN r.n IS NULL THEN 'missing' WHEN c.doc_id IS NULL THEN 'unused' WHEN n > 1 THEN 'repeated' WHEN o = 1 THEN 'open' WHEN c.h IS DISTINCT FROM r.h THEN 'stale' END AS fault FROM c FULL JOIN r ON c.doc_id = r.doc_id) WHERE fault IS NOT NULL GROUP BY fault"""
)
def review_ledger_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("h", F.sha2("text", 256))
    d = F.col("doc_id")
    ledger = docs.where(d % 7 != 0).select("doc_id", F.when(d % 20 == 1, "x").otherwise(F.col("h")).alias("h"), F.when(d % 11 == 0, "open").otherwise("adjudicated").alias("status"))
    return counted(ledgers.review_faults(docs.where(d % 3 != 0), ledger, "doc_id", "h"), "fault")


@query("SELECT 'missing' AS fault, count(DISTINCT c_custkey) AS cnt FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey % 4 <> 0) UNION ALL SELECT 'unused', count(DISTINCT o_custkey) FROM orders WHERE o_custkey % 4 <> 0 AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0 OR c_acctbal <= 0)")
def split_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned = table(spark, sf_dir, "orders").where("o_custkey % 4 <> 0").select(F.col("o_custkey").alias("c_custkey"))
    faults = counted(ledgers.unassigned(table(spark, sf_dir, "customer"), assigned, "c_custkey"), "fault")
    every = spark.createDataFrame([("missing",), ("unused",)], "fault string")
    return every.join(faults, "fault", "left").withColumn("cnt", F.coalesce("cnt", F.lit(0)))


@query(
    """WITH r AS (SELECT o_custkey, row_number() OVER w AS place, row_number() OVER w + sum((o_orderkey % 50 = 0)::INT) OVER w AS rev, lag('h' || o_orderkey) OVER w AS before, CASE WHEN o_orderkey % 40 = 1 THEN 'x' ELSE lag('h' || o_orderkey) OVER w END AS prev FROM orders
WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT fault, count(*) AS cnt FROM (SELECT CASE WHEN rev <> place THEN 'not_contiguous' WHEN place = 1 AND prev IS NOT NULL THEN 'first_has_predecessor' WHEN place > 1 AND prev IS DISTINCT FROM before THEN 'predecessor_differs' END AS fault FROM r) WHERE fault IS NOT NULL GROUP BY fault"""
)
def lineage_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    over, k = Window.partitionBy("o_custkey").orderBy("o_orderkey"), F.col("o_orderkey")
    digest = F.concat(F.lit("h"), k)
    skipped = F.sum((k % 50 == 0).cast("int")).over(over.rowsBetween(Window.unboundedPreceding, 0))
    records = table(spark, sf_dir, "orders").select("o_custkey", (F.row_number().over(over) + skipped).alias("rev"), digest.alias("h"), F.when(k % 40 == 1, "x").otherwise(F.lag(digest).over(over)).alias("prev"))
    return counted(ledgers.lineage_faults(records, "o_custkey", "rev", "h", "prev"), "fault")


@query(
    """WITH b AS (SELECT user_id, event_id, CASE WHEN event_id % 500 = 3 THEN 'c9' ELSE 'c' || user_id END AS ident, user_id * 100 + sum((event_type = 'signup' OR event_id % 97 = 0)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS started, event_type = 'signup' OR event_id % 89 = 0 AS restart, ts FROM events),
m AS (SELECT *, first_value(ident) OVER w AS f, lag(started) OVER w AS p FROM b WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT fault, count(*) AS cnt FROM (SELECT CASE WHEN ident IS DISTINCT FROM f THEN 'identity_changed' WHEN p IS NOT NULL AND restart AND p = started THEN 'restart_without_new_start' WHEN p IS NOT NULL AND p <> started AND NOT restart THEN 'start_changed' END AS fault FROM m) WHERE fault IS NOT NULL GROUP BY fault"""
)
def restart_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, signup = F.col("event_id"), F.col("event_type") == "signup"
    over = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = table(spark, sf_dir, "events").select(
        "user_id", "ts", "event_id", F.when(e % 500 == 3, "c9").otherwise(F.concat(F.lit("c"), F.col("user_id"))).alias("ident"), (F.col("user_id") * 100 + F.sum((signup | (e % 97 == 0)).cast("int")).over(over)).alias("started"), (signup | (e % 89 == 0)).alias("restart")
    )
    return counted(ledgers.restart_faults(rows, "user_id", ["ts", "event_id"], "ident", "started", F.col("restart"), F.unix_micros(F.col("ts").cast("timestamp"))), "fault")


@query(
    """WITH a AS (SELECT lang, source, count(*) AS a FROM documents GROUP BY ALL), b AS (SELECT lang, source, count(*) AS b FROM documents WHERE n_chars > 300 GROUP BY ALL)
SELECT a.lang, a.source, a, coalesce(b, 0) AS b FROM a LEFT JOIN b ON a.lang IS NOT DISTINCT FROM b.lang AND a.source IS NOT DISTINCT FROM b.source WHERE a <> coalesce(b, 0)"""
)
def inventory_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return ledgers.multiset_difference(docs, docs.where("n_chars > 300"), ["lang", "source"])


@query(
    """SELECT doc_id, name, list_sort(list(DISTINCT x)) AS spellings FROM (SELECT doc_id, x, nfc_normalize(x) AS name FROM (SELECT doc_id, unnest(['caf' || chr(233), CASE WHEN doc_id % 3 = 0 THEN 'cafe' || chr(769) ELSE 'tea' END]) AS x FROM documents)) GROUP BY ALL HAVING count(DISTINCT x) > 1"""
)
def key_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(F.lit("caf\u00e9"), F.when(F.col("doc_id") % 3 == 0, "cafe\u0301").otherwise("tea"))
    return ledgers.key_collisions(table(spark, sf_dir, "documents"), "doc_id", names)


@query(
    """WITH m AS (SELECT o_custkey AS g, CASE WHEN o_custkey % 2 = 0 THEN 'f1' ELSE 'f2' END AS family, CASE o_orderkey % 3 WHEN 0 THEN 'base' ELSE 'turn' END AS role, o_orderkey AS c, o_orderstatus AS scen, o_orderkey % 2 AS act, o_custkey % 50 AS split, o_orderpriority AS sig FROM orders WHERE o_custkey % 40 = 1),
f AS (SELECT g, family, list_sort(list(DISTINCT role)) AS held, count(*) AS n, count(*) FILTER (c % 30 = 0) AS no_case, count(*) FILTER (c % 30 <> 0 AND scen <> 'O') AS other_s, count(*) FILTER (c % 30 <> 0 AND role = 'turn' AND act = 1) AS other_a,
count(DISTINCT CASE WHEN c % 30 <> 0 THEN split END) AS splits, count(DISTINCT CASE WHEN c % 30 <> 0 THEN sig END) AS sigs, min(CASE WHEN c % 30 <> 0 THEN split END) AS split FROM m GROUP BY ALL),
x AS (SELECT *, count(*) OVER (PARTITION BY family, split) > 1 AS again FROM f)
SELECT fault, count(*) AS cnt FROM (SELECT unnest(list_filter([CASE WHEN again THEN 'repeated_family' END, CASE WHEN held <> ['base', 'turn'] OR n <> len(held) THEN 'roles' END, CASE WHEN no_case > 0 THEN 'case_missing' END, CASE WHEN other_s > 0 THEN 'scenario' END,
CASE WHEN other_a > 0 THEN 'action' END, CASE WHEN splits > 1 THEN 'split' END, CASE WHEN sigs > 1 THEN 'signature' END], lambda x: x IS NOT NULL)) AS fault FROM x) GROUP BY fault"""
)
def contrast_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    members = orders.where("o_custkey % 40 = 1").select(F.col("o_custkey").alias("group"), F.when(F.col("o_custkey") % 2 == 0, "f1").otherwise("f2").alias("family"), F.when(k % 3 == 0, "base").otherwise("turn").alias("role"), k.alias("case_id"))
    cases = orders.where(k % 30 != 0).select(k.alias("case_id"), F.col("o_orderstatus").alias("scenario"), (k % 2).cast("string").alias("action"), (F.col("o_custkey") % 50).alias("split"), F.col("o_orderpriority").alias("signature"))
    roles = spark.createDataFrame([(f, r, "O", ["0"] if r == "turn" else []) for f in ("f1", "f2") for r in ("base", "turn")], "family string, role string, scenario string, actions array<string>")
    return counted(ledgers.contrast_faults(members, roles, cases), "fault")


@query(
    """WITH j AS (SELECT o_orderkey - 1 AS s, CASE WHEN o_orderkey % 60 = 0 THEN 'end' WHEN o_orderkey = 1 THEN 'header' WHEN (o_orderkey - 2) % 2 = 0 THEN 'begin' ELSE 'end' END AS event, CASE WHEN o_orderkey % 70 = 0 THEN 0 ELSE (o_orderkey - 2) // 4 END AS case_no,
CASE WHEN ((o_orderkey - 2) % 4 < 2) = (o_orderkey % 90 <> 0) THEN 'A' ELSE 'B' END AS arm FROM orders),
e AS (SELECT *, (s - 1) // 4 AS c, (s - 1) % 4 AS p FROM j)
SELECT fault, count(*) AS cnt FROM (SELECT CASE WHEN s = 0 THEN CASE WHEN event <> 'header' THEN 'header' END WHEN c >= 300 THEN 'length' WHEN event <> CASE WHEN p % 2 = 0 THEN 'begin' ELSE 'end' END THEN 'event' WHEN case_no <> c THEN 'case'
WHEN arm <> CASE WHEN (p < 2) = (c % 2 = 0) THEN 'A' ELSE 'B' END THEN 'arm' END AS fault FROM e) WHERE fault IS NOT NULL GROUP BY fault"""
)
def paired_journal_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    journal = table(spark, sf_dir, "orders").select(
        (k - 1).alias("seq"),
        F.when(k % 60 == 0, "end").when(k == 1, "header").when((k - 2) % 2 == 0, "begin").otherwise("end").alias("event"),
        F.when(k % 70 == 0, 0).otherwise(F.floor((k - 2) / 4)).alias("case_no"),
        F.when(((k - 2) % 4 < 2) == (k % 90 != 0), "A").otherwise("B").alias("arm"),
    )
    return counted(ledgers.paired_journal_faults(journal, "seq", 300), "fault")


@query(
    """SELECT fault, count(*) AS cnt FROM (SELECT CASE WHEN b.d IS NULL THEN 'not_recorded' WHEN a.d IS NULL THEN 'not_found' WHEN a.d <> b.d THEN 'differs' END AS fault FROM (SELECT page_id, sha256(html) AS d FROM pages WHERE page_id % 9 <> 0) a
FULL JOIN (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'x' ELSE sha256(html) END AS d FROM pages WHERE page_id % 11 <> 0) b ON a.page_id = b.page_id) WHERE fault IS NOT NULL GROUP BY fault"""
)
def byte_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    recorded = ledgers.byte_digests(pages.where("page_id % 11 <> 0"), ["page_id"], "html").withColumn("digest", F.when(F.col("page_id") % 7 == 0, "x").otherwise(F.col("digest")))
    return counted(ledgers.byte_faults(ledgers.byte_digests(pages.where("page_id % 9 <> 0"), ["page_id"], "html"), recorded, "page_id"), "fault")


@query(
    """SELECT fault, size, color, count(*) AS cnt FROM (SELECT CASE WHEN k % 5 <> 0 THEN NULL WHEN k % 2 = 0 THEN NULL ELSE 'size' END AS fault, CASE WHEN k % 5 = 0 AND k % 2 = 0 THEN 'XL' WHEN k % 2 = 0 THEN 'L' END AS size, CASE WHEN k % 5 = 0 THEN 'blue' ELSE 'red' END AS color
FROM (SELECT p_partkey AS k FROM part)) GROUP BY ALL"""
)
def amendments(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    part = table(spark, sf_dir, "part")
    rows = part.select("p_partkey", F.create_map(F.lit("size"), F.when(k % 2 == 0, "L"), F.lit("color"), F.lit("red")).alias("v"))
    changes = F.array(F.struct(F.lit("size").alias("name"), F.lit("L").alias("old"), F.lit("XL").alias("new")), F.struct(F.lit("color").alias("name"), F.lit("red").alias("old"), F.lit("blue").alias("new")))
    found = ledgers.amended(rows, part.where(k % 5 == 0).select("p_partkey", F.explode(changes).alias("c")).select("p_partkey", "c.*"), "p_partkey", "v")
    return counted(found.select("fault", F.col("v")["size"].alias("size"), F.col("v")["color"].alias("color")), "fault", "size", "color")


@query("SELECT events, fault, count(*) AS cases FROM (SELECT l_orderkey, count(*) AS events, CASE WHEN bool_or(l_returnflag = 'R') THEN 'flag' END AS fault FROM lineitem GROUP BY 1) GROUP BY ALL")
def compiled_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = {"flag": (F.col("l_returnflag"), ("A", "N")), "status": (F.col("l_linestatus"), ("O", "F"))}
    found = ledgers.compiled(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", cells).select(F.size("events").cast("long").alias("events"), "fault")
    return found.groupBy("events", "fault").agg(F.count("*").alias("cases"))


# Groups of cases, calls and speakers


@query(
    """WITH c AS (SELECT source AS g, CASE WHEN doc_id % 25 = 0 THEN 'ai-' ELSE 'case-' END || doc_id // 2 AS c, CASE WHEN doc_id % 10 = 3 THEN 'generated' WHEN doc_id % 10 <> 4 THEN 'human_authored' END AS p, text FROM documents WHERE source <> 'src3'),
k AS (SELECT DISTINCT nfc_normalize(text) AS t FROM documents WHERE source = 'src3'), m AS (SELECT g, c, p IS DISTINCT FROM 'human_authored' AS a, starts_with(g, 'src19') AS b, starts_with(c, 'ai-') AS d, nfc_normalize(text) IN (SELECT t FROM k) AS e, count(*) OVER (PARTITION BY g, c) > 1 AS f FROM c)
SELECT fault, count(DISTINCT (g, c)) AS cases FROM (SELECT g, c, unnest(list_filter([CASE WHEN a THEN 'provenance' END, CASE WHEN b THEN 'group_prefix' END, CASE WHEN d THEN 'case_prefix' END, CASE WHEN e THEN 'verbatim_text' END, CASE WHEN f THEN 'repeated_case' END], lambda x: x IS NOT NULL)) AS fault FROM m) GROUP BY 1"""
)
def promotion_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, docs = F.col("doc_id"), table(spark, sf_dir, "documents")
    name = F.concat(F.when(d % 25 == 0, "ai-").otherwise("case-"), F.floor(d / 2))
    provenance = F.when(d % 10 == 3, "generated").when(d % 10 != 4, "human_authored")
    cases = docs.where("source <> 'src3'").select(F.col("source").alias("group_id"), name.alias("case_id"), provenance.alias("provenance"), "text")
    found = ledgers.promotion_faults(cases, ("ai-", "src19"), docs.where("source = 'src3'").select("text"))
    return found.groupBy("fault").agg(F.count("*").alias("cases"))


@query(
    """WITH s AS (SELECT source, count(*) AS n, count(*) FILTER (n_chars > 1000) AS i, max((doc_id % 50 = 0)::INT) AS l FROM documents GROUP BY source), a AS (SELECT min_by(n, source) AS agreed FROM s)
SELECT source, unnest(list_filter([CASE WHEN n <> agreed THEN 'count' END, CASE WHEN n < 40 OR n % 2 <> 0 THEN 'size' END, CASE WHEN 2 * i <> n THEN 'scope' END, CASE WHEN l = 0 THEN 'no_later_state' END], lambda x: x IS NOT NULL)) AS fault FROM s, a"""
)
def balance_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.balance_faults(table(spark, sf_dir, "documents"), "source", F.col("n_chars") > 1000, F.col("doc_id") % 50 == 0, 40)


@query("SELECT coalesce(lang, '') AS lang, coalesce(quality::VARCHAR, '') AS quality, coalesce(toxic::VARCHAR, '') AS toxic, count(*) AS cnt FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL")
def contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.contingency(table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left"), ["lang", "quality", "toxic"])


@query(
    """SELECT o_orderpriority, count(DISTINCT o_orderkey) AS cases, count(l_orderkey) AS calls, coalesce(sum(l_partkey) FILTER (l_linenumber <> 2), 0)::BIGINT AS prompt_tokens, coalesce(sum(l_suppkey), 0)::BIGINT AS completion_tokens,
coalesce(sum(l_quantity), 0)::DOUBLE AS seconds FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1"""
)
def call_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempt = F.struct(F.when(F.col("l_linenumber") != 2, F.col("l_partkey")).alias("prompt_tokens"), F.col("l_suppkey").alias("completion_tokens"), F.col("l_quantity").alias("seconds"))
    attempts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(attempt).alias("attempts"))
    return groups.call_sums(table(spark, sf_dir, "orders").join(attempts, "o_orderkey", "left"), ["o_orderpriority"], "o_orderkey")


@query("SELECT event_type, count(*) AS n, count(*) FILTER (value > 50) AS direct, count(*) FILTER (value BETWEEN 10 AND 50) AS confirm, count(*) FILTER (value < 10 AND user_id % 2 = 0) AS missed FROM events GROUP BY 1")
def relation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return groups.conditional_counts(table(spark, sf_dir, "events"), ["event_type"], {"direct": v > 50, "confirm": v.between(10, 50), "missed": (v < 10) & (F.col("user_id") % 2 == 0)})


@query("SELECT user_id, count(*) AS runs, count(DISTINCT coalesce(event_type, 'x')) AS outcomes, count(DISTINCT coalesce(event_type, 'x')) = 1 AS stable FROM events GROUP BY 1")
def repeat_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.repeat_consistency(table(spark, sf_dir, "events"), ["user_id"], F.col("event_type"))


@query('SELECT "group", count(*) AS n, sum(s_acctbal)::DECIMAL(18,2)::DOUBLE AS total FROM (SELECT s_acctbal, CASE WHEN r <= 10 THEN \'fixed\' WHEN r <= 25 THEN \'fresh\' ELSE \'rest\' END AS "group" FROM (SELECT s_acctbal, row_number() OVER (ORDER BY s_name, s_suppkey) AS r FROM supplier) WHERE r <= 60) GROUP BY 1')
def groups_by_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups.group_by_place(table(spark, sf_dir, "supplier"), ["s_name", "s_suppkey"], [("fixed", 10), ("fresh", 15), ("rest", 35)])
    return found.groupBy("group").agg(F.count("*").alias("n"), F.round(F.sum("s_acctbal"), 2).alias("total"))


@query(
    """WITH m AS (SELECT o_custkey, c_nationkey // 10 * 10 AS decade, median(o_totalprice) AS m FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
SELECT decade::INT AS decade, count(DISTINCT o_custkey) AS speakers, round(quantile_cont(m, 0.25), 4) AS p25, round(quantile_cont(m, 0.5), 4) AS p50, round(quantile_cont(m, 0.75), 4) AS p75 FROM m GROUP BY decade"""
)
def medians_of_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    found = groups.medians_of_medians(rows, "o_custkey", groups.decade_of(F.col("c_nationkey")), "o_totalprice")
    return found.select("decade", "speakers", *[F.round(x, 4).alias(x) for x in ("p25", "p50", "p75")])


@query(
    """WITH RECURSIVE d AS (SELECT event_type, value AS v, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY ALL),
c AS (SELECT event_type, v, sum(v * n) OVER w AS s, sum(n) OVER w AS c, sum(v * n) OVER a AS s_all, sum(n) OVER a AS c_all, min(v) OVER a AS least, max(v) OVER a AS most FROM d WINDOW w AS (PARTITION BY event_type ORDER BY v), a AS (PARTITION BY event_type)),
m AS (SELECT event_type, v, s / c AS low, CASE WHEN c_all > c THEN (s_all - s) / (c_all - c) ELSE most END AS high, least, most FROM c),
n AS (SELECT a.event_type, a.v, b.v AS next FROM m a ASOF JOIN m b ON a.event_type = b.event_type AND (a.low + a.high) / 2 >= b.v),
f AS (SELECT event_type, max(v) AS v FROM m WHERE v <= (least + most) / 2 GROUP BY 1 UNION SELECT f.event_type, n.next FROM f JOIN n USING (event_type, v))
SELECT event_type, round(low, 9) AS low, round(high, 9) AS high, round((low + high) / 2, 9) AS threshold FROM f JOIN n USING (event_type, v) JOIN m USING (event_type, v) WHERE n.next = v"""
)
def two_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.two_clusters(table(spark, sf_dir, "events"), "event_type", "value").select("event_type", *[F.round(x, 9).alias(x) for x in ("low", "high", "threshold")])


@query("SELECT event_type, count(*) AS n, count(*) FILTER (value BETWEEN 5 AND 20) AS inside FROM events GROUP BY 1")
def band_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.conditional_counts(table(spark, sf_dir, "events"), ["event_type"], {"inside": groups.in_band(F.col("value"), F.lit(5), F.lit(20))})


# Two models


_BC = f"(SELECT case_id, lang, source, b.exact AS b, c.exact AS c FROM {_flags_sql(BASELINE)} b JOIN {_flags_sql(CANDIDATE)} c USING (case_id, lang, source))"
_COMPARED = """count(*) AS cases, sum(b)::BIGINT AS baseline_correct, sum(c)::BIGINT AS candidate_correct, round(sum(b) / count(*), 6) AS baseline_accuracy, round(sum(c) / count(*), 6) AS candidate_accuracy,
round((sum(c) - sum(b)) / count(*) * 100, 6) AS difference_points, CASE WHEN sum(b) > 0 THEN round((sum(c) - sum(b)) / sum(b) * 100, 6) END AS relative_change"""


@query(f"WITH p AS (SELECT * FROM {_BC}) SELECT 'overall' AS slice, 'all' AS value, {_COMPARED} FROM p UNION ALL SELECT 'scenario', lang, {_COMPARED} FROM p GROUP BY lang UNION ALL SELECT 'tag', source, {_COMPARED} FROM p GROUP BY source")
def paired_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    slices = F.array(*[F.struct(F.lit(name).alias("slice"), value.alias("value")) for name, value in (("overall", F.lit("all")), ("scenario", F.col("lang")), ("tag", F.col("source")))])
    spread = _pairs(spark, sf_dir).withColumn("s", F.explode(slices)).select("s.*", "b", "c")
    found = groups.paired_comparison(spread, ["slice", "value"], "b", "c")
    return found.withColumns({x: F.round(x, 6) for x in ("baseline_accuracy", "candidate_accuracy", "difference_points", "relative_change")})


@query(
    f"SELECT lang, "
    + ", ".join(f"coalesce(list_sort(list(case_id) FILTER ({test})), []) AS {name}" for name, test in (("new", "b = 1 AND c = 0"), ("preexisting", "b = 0 AND c = 0"), ("recovered", "b = 0 AND c = 1"), ("retained", "b = 1 AND c = 1")))
    + f" FROM {_BC} GROUP BY lang"
)
def regression_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.paired_sets(_pairs(spark, sf_dir), ["lang"], "case_id", "b", "c")


@query(f"SELECT case_id, CASE WHEN case_id % 10 = 0 THEN 'unknown' WHEN c > b THEN 'gained' ELSE 'lost' END AS change FROM {_BC} WHERE case_id % 10 = 0 OR b <> c")
def gained_and_lost(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _pairs(spark, sf_dir)
    return groups.gained_and_lost(pairs.where("case_id % 10 <> 0").select("case_id", F.col("b").alias("passed")), pairs.select("case_id", F.col("c").alias("passed")), "case_id", "passed")


@query(f"SELECT count(*) AS pairs, count(*) FILTER (x.b = 1 AND y.b = 1) AS recovered FROM (SELECT case_id AS f, case_id + 1 AS s FROM {_BC}) p LEFT JOIN {_BC} x ON f = x.case_id LEFT JOIN {_BC} y ON s = y.case_id")
def contrast_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _pairs(spark, sf_dir)
    return groups.contrast_recovery(found.select(F.col("case_id").alias("first"), (F.col("case_id") + 1).alias("second")), found, "case_id", "b")


@query("SELECT effective, guarded, count(*) AS cnt FROM (SELECT CASE WHEN h THEN 'direct' ELSE CASE WHEN o_orderstatus = 'F' THEN 'normal' ELSE 'confirm' END END AS effective, h AS guarded FROM (SELECT *, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) AS h FROM orders)) GROUP BY ALL")
def guard_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "normal").otherwise("confirm").alias("route"))
    guard = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_quantity") > 45).alias("hit"))
    return counted(groups.overridden(results, guard, "o_orderkey", "route", "direct"), "effective", "guarded")


@query("SELECT event_type, 'n' AS value, format('{:.6f}', count(*)::DOUBLE) AS recomputed, format('{:.6f}', (count(*) + 1)::DOUBLE) AS recorded FROM events WHERE event_type IN ('view', 'click') GROUP BY 1")
def tampered_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.min("user_id").alias("least"))
    recorded = summary.withColumn("n", F.when(F.col("event_type").isin("view", "click"), F.col("n") + 1).otherwise(F.col("n")))
    found = groups.tampered(summary, recorded, ["event_type"], ["n", "least"])
    return found.select("event_type", "value", F.replace("recomputed", F.lit(","), F.lit("")).alias("recomputed"), F.replace("recorded", F.lit(","), F.lit("")).alias("recorded"))


@query("SELECT event_type, count(*) AS calls, count(*) FILTER (user_id % 4 <> 0) AS succeeded, round(median(value) FILTER (user_id % 4 <> 0), 6) AS median FROM events GROUP BY 1")
def latency_of_successes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups.median_of_successes(table(spark, sf_dir, "events"), ["event_type"], "value", F.when(F.col("user_id") % 4 != 0, 200).otherwise(429))
    return found.withColumn("median", F.round("median", 6))


@query(
    """WITH t AS (SELECT p_brand, p_size, min(p_partkey) AS v FROM part GROUP BY ALL), l AS (SELECT p_brand, max_by(v, p_size) AS latest FROM t GROUP BY 1)
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN latest ELSE t.v END AS v FROM (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 2 <> 0 THEN p_size + 1 END AS size FROM part) a LEFT JOIN t ON a.p_brand = t.p_brand AND a.size = t.p_size LEFT JOIN l ON a.p_brand = l.p_brand"""
)
def versioned_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    versions = part.groupBy("p_brand", F.col("p_size").alias("size")).agg(F.min("p_partkey").alias("v"))
    asked = part.select("p_partkey", "p_brand", F.when(F.col("p_partkey") % 2 != 0, F.col("p_size") + 1).alias("size"))
    return groups.versioned(asked, versions, ["p_brand"], "size", "v").select("p_partkey", "v")


_REVALID = _flags_sql(BASELINE).replace("doc_id % 13 <> 0 AS valid", "doc_id % 13 <> 0 AND NOT (CASE WHEN doc_id % 6 = 0 THEN doc_id % 5 = 0 ELSE false END) AS valid").replace("doc_id % 13 = 0 OR doc_id % 11 = 0 AS twice", "doc_id % 13 = 0 OR doc_id % 11 = 0 AS twice")


@query(f"SELECT count(*) AS cases, sum(final_pass)::BIGINT AS final_pass, sum(exact)::BIGINT AS exact, sum(fn)::BIGINT AS fn, sum(hallucinated)::BIGINT AS hallucinated FROM {_REVALID}")
def case_scores_revalidated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The baseline's scores with its attempts validated anew: a change must name the field lang, whatever the recorded flag says."""
    rule = lambda a: F.when((a["action"] == "change") & (a["change_field"] != "lang"), "change_field")
    flags = scoring.case_flags(_cases(spark, sf_dir), scoring.revalidated(_predictions(spark, sf_dir, BASELINE), rule))
    return flags.agg(F.count("*").alias("cases"), *[F.sum(x).alias(x) for x in ("final_pass", "exact", "fn", "hallucinated")])


_BY_CONTRACT = _flags_sql(BASELINE).replace("doc_id % 13 <> 0 AS valid", "doc_id % 13 <> 0 AND NOT (CASE WHEN doc_id % 6 = 0 THEN doc_id % 5 = 0 WHEN n_chars < 200 THEN lang <> 'en' ELSE doc_id % 7 = 0 END) AS valid")


@query(f"SELECT count(*) AS cases, sum(final_pass)::BIGINT AS final_pass, sum(exact)::BIGINT AS exact, sum(fn)::BIGINT AS fn, sum(hallucinated)::BIGINT AS hallucinated FROM {_BY_CONTRACT}")
def case_scores_by_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The baseline's scores with each attempt held against the whole contract: a change sets a size, a keep a language, and only English cases may be dropped."""
    of = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    fields = of([("case", "lang", None), ("case", "size", "small"), ("case", "size", "large")], "scenario string, field string, option string")
    actions = of([("case", x, y) for x in ("en", "fr", "de", "es") for y in ("keep", "change", *(["drop"] if x == "en" else []))], "scenario string, state string, action string")
    rules = [("case", "keep", ["lang", "size"], ["lang"], False), ("case", "change", ["lang", "size"], ["size"], False), ("case", "drop", ["lang", "size"], [], False)]
    rules = of(rules, "scenario string, action string, allowed array<string>, required array<string>, require_any boolean")
    states = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("case_id"), F.lit("case").alias("scenario"), F.col("lang").alias("state"))
    checked = scoring.validated(_predictions(spark, sf_dir, BASELINE), states, fields, actions, rules)
    flags = scoring.case_flags(_cases(spark, sf_dir), checked)
    return flags.agg(F.count("*").alias("cases"), *[F.sum(x).alias(x) for x in ("final_pass", "exact", "fn", "hallucinated")])


# Coverage


def _contract(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    actions = [("en", "open", "keep"), ("en", "open", "change"), ("en", "done", "keep"), ("fr", "open", "keep"), ("fr", "done", "drop"), ("xx", "open", "keep")]
    fields = [("en", "size", "small"), ("en", "size", "large"), ("en", "lang", None), ("fr", "size", "huge"), ("xx", "size", None)]
    intents = [("en", "good"), ("en", None), ("fr", "bad"), ("xx", "good")]
    return (
        spark.createDataFrame(actions, "scenario string, state string, action string"),
        spark.createDataFrame(fields, "scenario string, field string, option string"),
        spark.createDataFrame(intents, "scenario string, intent string"),
    )


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, chars = F.col("doc_id"), F.col("n_chars")
    size = F.when(chars % 3 != 0, F.when(chars > 500, F.array(F.lit("large"))).otherwise(F.array(F.lit("small"))))
    return table(spark, sf_dir, "documents").select(
        d.alias("case_id"),
        F.col("lang").alias("scenario"),
        F.when(d % 2 == 0, "open").otherwise("done").alias("state"),
        F.when(d % 4 == 0, "keep").otherwise("drop").alias("action"),
        F.when(d % 3 == 0, "good").alias("intent"),
        F.when(d % 5 == 0, "size").alias("change_field"),
        F.create_map(F.lit("size"), size, F.lit("lang"), F.array("lang")).alias("fields"),
        F.create_map(F.lit("size"), F.when(d % 3 == 0, "L"), F.lit("lang"), F.when(d % 2 == 0, "en")).alias("current"),
        F.array(F.col("source")).alias("tags"),
    )


_OBLIGED = """(WITH a(scenario, state, action) AS (VALUES ('en','open','keep'),('en','open','change'),('en','done','keep'),('fr','open','keep'),('fr','done','drop'),('xx','open','keep')),
f(scenario, field, option) AS (VALUES ('en','size','small'),('en','size','large'),('en','lang',NULL),('fr','size','huge'),('xx','size',NULL)), i(scenario, intent) AS (VALUES ('en','good'),('en',NULL),('fr','bad'),('xx','good'))
SELECT DISTINCT * FROM (SELECT scenario, 'state' AS dimension, state AS value FROM a UNION ALL SELECT scenario, 'action', action FROM a UNION ALL SELECT scenario, 'state_action', state || '->' || action FROM a UNION ALL SELECT scenario, 'intent', coalesce(intent, '<null>') FROM i
UNION ALL SELECT scenario, 'field_present', field FROM f UNION ALL SELECT scenario, 'field_absent', field FROM f UNION ALL SELECT scenario, 'field_option', field || '=' || option FROM f WHERE option IS NOT NULL UNION ALL SELECT scenario, 'change_field', field FROM f))"""
_COVERED = """(WITH d AS (SELECT lang AS scenario, CASE WHEN doc_id % 2 = 0 THEN 'open' ELSE 'done' END AS state, CASE WHEN doc_id % 4 = 0 THEN 'keep' ELSE 'drop' END AS action, CASE WHEN doc_id % 3 = 0 THEN 'good' ELSE '<null>' END AS intent,
CASE WHEN doc_id % 5 = 0 THEN 'size' END AS change, CASE WHEN n_chars % 3 <> 0 THEN CASE WHEN n_chars > 500 THEN 'large' ELSE 'small' END END AS size, lang, source FROM documents)
SELECT DISTINCT * FROM (SELECT scenario, 'state' AS dimension, state AS value FROM d UNION ALL SELECT scenario, 'action', action FROM d UNION ALL SELECT scenario, 'state_action', state || '->' || action FROM d UNION ALL SELECT scenario, 'intent', intent FROM d
UNION ALL SELECT scenario, 'field_present', 'lang' FROM d UNION ALL SELECT scenario, 'field_present', 'size' FROM d WHERE size IS NOT NULL UNION ALL SELECT scenario, 'field_absent', 'size' FROM d WHERE size IS NULL
UNION ALL SELECT scenario, 'field_option', 'size=' || size FROM d WHERE size IS NOT NULL UNION ALL SELECT scenario, 'field_option', 'lang=' || lang FROM d UNION ALL SELECT scenario, 'change_field', change FROM d WHERE change IS NOT NULL UNION ALL SELECT scenario, 'tag', source FROM d))"""


_ASKED = """(WITH c AS (SELECT c_mktsegment AS scenario, ['open', 'done', 'wait'][c_nationkey % 3 + 1] AS state, ['keep', 'drop', 'change'][c_custkey % 3 + 1] AS action, c_acctbal AS bal, c_nationkey AS n FROM customer),
a AS (SELECT DISTINCT scenario, state, action FROM c WHERE bal > 5000), f AS (SELECT DISTINCT scenario, 'nation' AS field, n::VARCHAR AS option FROM c WHERE bal < 500 UNION SELECT DISTINCT scenario, 'phone', NULL FROM c WHERE bal > 9000), i AS (SELECT DISTINCT scenario, CASE WHEN bal > 0 THEN 'good' END AS intent FROM c)
SELECT DISTINCT * FROM (SELECT scenario, 'state' AS dimension, state AS value FROM a UNION ALL SELECT scenario, 'action', action FROM a UNION ALL SELECT scenario, 'state_action', state || '->' || action FROM a UNION ALL SELECT scenario, 'intent', coalesce(intent, '<null>') FROM i
UNION ALL SELECT scenario, 'field_present', field FROM f UNION ALL SELECT scenario, 'field_absent', field FROM f UNION ALL SELECT scenario, 'field_option', field || '=' || option FROM f WHERE option IS NOT NULL UNION ALL SELECT scenario, 'change_field', field FROM f
UNION ALL SELECT scenario, 'delta', field || '->' || r FROM (SELECT DISTINCT scenario, field FROM f), (VALUES ('set'), ('changed'), ('cleared')) AS v(r) UNION ALL SELECT NULL, 'contrast_role', state FROM a))"""


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Obligations of contracts that the customers stand for: a market segment is a scenario."""
    c = table(spark, sf_dir, "customer").withColumns({"scenario": F.col("c_mktsegment"), "state": pick("c_nationkey", 3, F.lit("open"), F.lit("done"), F.lit("wait")), "action": pick("c_custkey", 3, F.lit("keep"), F.lit("drop"), F.lit("change"))})
    named = lambda name, option, test: c.where(test).select("scenario", F.lit(name).alias("field"), option.alias("option")).distinct()
    fields = named("nation", F.col("c_nationkey").cast("string"), F.col("c_acctbal") < 500).unionByName(named("phone", F.lit(None).cast("string"), F.col("c_acctbal") > 9000))
    actions = c.where("c_acctbal > 5000").select("scenario", "state", "action").distinct()
    deltas = fields.select("scenario", "field", F.explode(F.array(*[F.lit(x) for x in ("set", "changed", "cleared")])).alias("relation")).distinct()
    return coverage.obligations(actions, fields, c.select("scenario", F.when(F.col("c_acctbal") > 0, "good").alias("intent")).distinct(), deltas, roles=actions.select(F.col("state").alias("role")).distinct())


@query(f"SELECT * FROM {_ASKED}")
def obligations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir)


@query(
    f"""WITH q AS {_ASKED}, c AS (SELECT c_mktsegment AS scenario, o_orderkey % 3 AS split, ['open', 'done', 'wait'][o_orderkey % 3 + 1] AS state, ['keep', 'drop', 'change'][o_custkey % 3 + 1] AS action, CASE WHEN o_orderkey % 5 = 0 THEN 'good' END AS intent,
CASE WHEN o_orderkey % 4 = 0 THEN 'nation' END AS change, CASE WHEN o_orderkey % 7 < 3 THEN c_nationkey::VARCHAR END AS nation, CASE WHEN o_orderkey % 11 = 0 THEN c_nationkey::VARCHAR WHEN o_orderkey % 11 < 6 THEN 'x' END AS held FROM orders JOIN customer ON o_custkey = c_custkey),
k AS (SELECT DISTINCT scenario, split, unnest([('state', state), ('action', action), ('state_action', state || '->' || action), ('intent', coalesce(intent, '<null>')), CASE WHEN nation IS NOT NULL THEN ('field_present', 'nation') ELSE ('field_absent', 'nation') END,
CASE WHEN nation IS NOT NULL THEN ('field_option', 'nation=' || nation) END, CASE WHEN change IS NOT NULL THEN ('change_field', change) END, ('delta', 'nation->' || CASE WHEN nation IS NOT DISTINCT FROM held THEN 'same' WHEN held IS NULL THEN 'set' WHEN nation IS NULL THEN 'cleared' ELSE 'changed' END)]) AS x FROM c),
s AS (SELECT DISTINCT split FROM c), z AS (SELECT FALSE AS all_splits, split FROM s UNION ALL SELECT TRUE, NULL),
t AS (SELECT z.all_splits, z.split, q.*, EXISTS (SELECT 1 FROM k WHERE k.scenario = q.scenario AND x[1] = q.dimension AND x[2] = q.value AND (z.all_splits OR k.split = z.split)) AS seen FROM z, q)
SELECT all_splits, split, scenario, grouping(scenario) = 1 AS all_scenarios, dimension, count(*) AS required, count(*) FILTER (seen) AS covered, CASE WHEN grouping(scenario) + grouping(dimension) = 0 THEN coalesce(list_sort(list(value) FILTER (NOT seen)), []) END AS missing
FROM t GROUP BY GROUPING SETS ((all_splits, split, scenario, dimension), (all_splits, split, scenario), (all_splits, split, dimension), (all_splits, split))"""
)
def coverage_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What orders, as labelled cases in three splits, cover of what the customers ask for."""
    o, nation = F.col("o_orderkey"), F.col("c_nationkey").cast("string")
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    cases = rows.select(
        F.col("c_mktsegment").alias("scenario"),
        (o % 3).alias("split"),
        pick("o_orderkey", 3, F.lit("open"), F.lit("done"), F.lit("wait")).alias("state"),
        pick("o_custkey", 3, F.lit("keep"), F.lit("drop"), F.lit("change")).alias("action"),
        F.when(o % 5 == 0, "good").alias("intent"),
        F.when(o % 4 == 0, "nation").alias("change_field"),
        F.create_map(F.lit("nation"), F.when(o % 7 < 3, F.array(nation))).alias("fields"),
        F.create_map(F.lit("nation"), F.when(o % 11 == 0, nation).when(o % 11 < 6, "x")).alias("current"),
        F.lit(None).cast("array<string>").alias("tags"),
    )
    return coverage.coverage_cube(_asked(spark, sf_dir), cases)


@query(
    f"""WITH o AS {_OBLIGED}, c AS {_COVERED} SELECT scenario, dimension, list_sort(list(value)) AS missing FROM (SELECT * FROM o WHERE scenario IN (SELECT scenario FROM c) EXCEPT SELECT * FROM c) GROUP BY ALL
UNION ALL SELECT DISTINCT scenario, 'scenario', [scenario] FROM o WHERE scenario NOT IN (SELECT scenario FROM c)"""
)
def coverage_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.issues(coverage.obligations(*_contract(spark)), _labelled(spark, sf_dir))


@query(f"WITH o AS {_OBLIGED}, c AS {_COVERED} SELECT o.dimension, count(*) AS required, count(c.value) AS covered, count(*) - count(c.value) AS missing FROM o LEFT JOIN c USING (scenario, dimension, value) GROUP BY 1")
def obligation_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.progress(coverage.obligations(*_contract(spark)), _labelled(spark, sf_dir))


@query("SELECT 'action' AS dimension, 'sum' AS fault UNION ALL SELECT 'intent', 'listed'")
def coverage_report_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    required, cases = coverage.obligations(*_contract(spark)), _labelled(spark, sf_dir)
    missing = required.join(coverage.covered(cases), coverage.KEYS, "left_anti").where("dimension <> 'intent' OR value <> 'bad'")
    report = coverage.progress(required, cases).withColumn("covered", F.col("covered") + F.when(F.col("dimension") == "action", 1).otherwise(0))
    return coverage.report_faults(report, missing)


@query(f"WITH o AS {_OBLIGED}, c AS {_COVERED} SELECT o.dimension, count(*) - count(c.value) AS missing, count(*) FILTER (c.value IS NULL AND (scenario, o.dimension, o.value) NOT IN (('xx', 'state', 'open'), ('xx', 'action', 'keep'), ('xx', 'state_action', 'open->keep'), ('xx', 'intent', 'good'))) AS missing_with_candidates FROM o LEFT JOIN c USING (scenario, dimension, value) GROUP BY 1")
def coverage_with_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = "map<string,array<string>>"
    candidate = spark.createDataFrame([("xx", "open", "keep", "good", {})], f"scenario string, state string, action string, intent string, fields {none}")
    candidate = candidate.withColumns({"change_field": F.lit(None).cast("string"), "tags": F.lit(None).cast("array<string>")})
    return coverage.with_candidates(coverage.obligations(*_contract(spark)), _labelled(spark, sf_dir), candidate)


@query("SELECT DISTINCT lang AS scenario, 'state_context' AS dimension, CASE WHEN doc_id % 2 = 0 THEN 'open' ELSE 'done' END || '->' || CASE (doc_id % 3 = 0)::INT + (doc_id % 2 = 0)::INT WHEN 0 THEN 'empty' WHEN 1 THEN 'partial' ELSE 'complete' END AS value FROM documents")
def context_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.context_keys(_labelled(spark, sf_dir))


@query(
    """WITH d AS (SELECT sha256(doc_id || chr(10) || '{"lang":' || CASE WHEN lang IS NULL THEN 'null' ELSE '"' || lang || '"' END || ',"source":' || CASE WHEN source IS NULL THEN 'null' ELSE '"' || source || '"' END || '}') AS d FROM documents),
p AS (SELECT d[1:4] AS p, count(*) AS n, sha256(string_agg(d, ',' ORDER BY d)) AS h FROM d GROUP BY 1), b AS (SELECT p[1:2] AS b, sum(n) AS n, sha256(string_agg(h, ',' ORDER BY p)) AS h FROM p GROUP BY 1)
SELECT sum(n)::BIGINT AS "rows", sha256(string_agg(h, ',' ORDER BY b)) AS fingerprint FROM b"""
)
def corpus_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.corpus_fingerprint(table(spark, sf_dir, "documents"), "doc_id", F.create_map(F.lit("source"), F.col("source"), F.lit("lang"), F.col("lang")))


# Dialogues and baselines


def _folded_sql(machine: machines.Machine, turns: str) -> str:
    """turns (user_id, event_id, action, gives, takes, outcome; gives and takes as bits) one after the other through the machine's rules, which are written out as rows."""
    text = lambda x: "NULL" if x is None else f"'{x}'"
    rules = [f"({i}, {text(s)}, {text(a)}, {'NULL' if r.full is None else str(r.full).upper()}, {text(r.outcome)}, {text(r.then)}, {machine.mask(r.clears)}, {machine.mask(r.lacks)})" for i, r in enumerate(machine.rules) for s in r.states or (None,) for a in r.actions or (None,)]
    states, all_of = ", ".join(f"('{x}')" for x in machine.states), (1 << len(machine.fields)) - 1
    named = ", ".join(f"CASE WHEN filled & {1 << i} > 0 THEN '{x}' END" for i, x in enumerate(machine.fields))
    return f"""WITH RECURSIVE t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM ({turns})),
r AS (SELECT * FROM (VALUES {", ".join(rules)}) AS r(place, of_state, of_action, is_full, of_outcome, then_state, clears, lacks)),
c AS (SELECT s.state, a.action, o.outcome, b.held FROM (VALUES {states}) AS s(state), (SELECT DISTINCT action FROM t) a, (SELECT DISTINCT outcome FROM t) o, range(0, {all_of + 1}) AS b(held)),
p AS (SELECT c.*, min(r.place) AS place FROM c LEFT JOIN r ON (of_state IS NULL OR of_state = state) AND (of_action IS NULL OR of_action = action) AND (is_full IS NULL OR is_full = (held = {all_of})) AND (held & lacks) = 0 AND (of_outcome IS NULL OR of_outcome = outcome) GROUP BY ALL),
m AS (SELECT DISTINCT state, action, outcome, held, coalesce(then_state, state) AS next, coalesce(clears, 0) AS clears FROM p LEFT JOIN r USING (place)),
f AS (SELECT DISTINCT user_id, NULL::BIGINT AS event_id, 0::BIGINT AS n, '{machine.states[0]}' AS state, 0 AS filled FROM t
UNION ALL SELECT t.user_id, t.event_id, t.n, m.next, (((f.filled | t.gives) & ({all_of} - t.takes)) & ({all_of} - m.clears))::INT FROM f JOIN t ON t.user_id = f.user_id AND t.n = f.n + 1
JOIN m ON m.state = f.state AND m.action IS NOT DISTINCT FROM t.action AND m.outcome IS NOT DISTINCT FROM t.outcome AND m.held = ((f.filled | t.gives) & ({all_of} - t.takes)))
SELECT user_id, event_id, state, concat_ws(',', {named}) AS filled FROM f WHERE n > 0"""


def _folded(spark: SparkSession, sf_dir: str, machine: machines.Machine, action: Column, gives: Column, takes: Column | None = None, outcome: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    one = lambda x: F.array_compact(F.array(none if x is None else x))
    turns = table(spark, sf_dir, "events").select("user_id", "event_id", *machines.symbol(action, one(gives), one(takes), outcome))
    return machines.folded(turns, machine, "user_id", "event_id").withColumn("filled", F.array_join("filled", ","))


_PLAIN = "CASE event_type WHEN 'purchase' THEN 'confirm' WHEN 'error' THEN 'cancel' WHEN 'signup' THEN 'change' ELSE 'tell' END"


@query(_folded_sql(machines.DIALOGUE, f"SELECT user_id, event_id, {_PLAIN} AS action, CASE WHEN event_type = 'signup' THEN 0 ELSE [1, 2, 4, 0][event_id % 4 + 1] END AS gives, CASE WHEN event_type = 'signup' THEN [1, 2, 4, 0][event_id % 4 + 1] ELSE 0 END AS takes, CASE WHEN event_id % 97 = 0 THEN 'danger' END AS outcome FROM events"))
def folded_dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    action = F.when(kind == "purchase", "confirm").when(kind == "error", "cancel").when(kind == "signup", "change").otherwise("tell")
    named = pick("event_id", 4, F.lit("size"), F.lit("color"), F.lit("place"))
    return _folded(spark, sf_dir, machines.DIALOGUE, action, F.when(action != "change", named), F.when(action == "change", named), F.when(F.col("event_id") % 97 == 0, "danger"))


_BOOKED = ("confirm", "change_date", "confirm_reservation", "ask_other_time", "select_alternative_time", "change_info", "go_closing", "tell", "tell")
_MET = ("confirm_info", "change_time", "tell", "go_closing", "tell")


@query(_folded_sql(machines.RESTAURANT, f"SELECT user_id, event_id, CASE WHEN event_id % 61 = 0 THEN 'end_call' ELSE {list(_BOOKED)}[event_id % 9 + 1] END AS action, [1, 2, 4, 8, 0][event_id % 5 + 1] AS gives, CASE WHEN event_id % 9 = 1 AND event_id % 2 = 0 THEN 1 ELSE 0 END AS takes, ['available', 'unavailable', 'offered'][event_id % 3 + 1] AS outcome FROM events"))
def restaurant_dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    action = F.when(e % 61 == 0, "end_call").otherwise(pick("event_id", 9, *[F.lit(x) for x in _BOOKED]))
    gives = pick("event_id", 5, *[F.lit(x) for x in machines.RESTAURANT.fields])
    return _folded(spark, sf_dir, machines.RESTAURANT, action, gives, F.when((e % 9 == 1) & (e % 2 == 0), "date"), pick("event_id", 3, F.lit("available"), F.lit("unavailable"), F.lit("offered")))


_VISIT = ("confirm_reservation_info", "change_date", "confirm_available_time", "ask_other_time", "select_alternative_time", "change_department", "go_closing", "tell", "tell", "tell", "tell")


@query(_folded_sql(machines.CLINIC, f"SELECT user_id, event_id, CASE WHEN event_id % 59 = 0 THEN 'end_call' ELSE {list(_VISIT)}[event_id % 11 + 1] END AS action, [1, 2, 4, 8, 16, 0, 0][event_id % 7 + 1] AS gives, CASE WHEN event_id % 11 = 1 THEN 4 WHEN event_id % 11 = 5 THEN 2 ELSE 0 END AS takes, ['available', 'unavailable', 'offered'][event_id % 3 + 1] AS outcome FROM events"))
def clinic_dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    action = F.when(e % 59 == 0, "end_call").otherwise(pick("event_id", 11, *[F.lit(x) for x in _VISIT]))
    takes = F.when(e % 11 == 1, "date").when(e % 11 == 5, "department")
    return _folded(spark, sf_dir, machines.CLINIC, action, pick("event_id", 7, *[F.lit(x) for x in machines.CLINIC.fields]), takes, pick("event_id", 3, F.lit("available"), F.lit("unavailable"), F.lit("offered")))


@query(_folded_sql(machines.APPOINTMENT, f"SELECT user_id, event_id, CASE WHEN event_id % 41 = 0 THEN 'end_call' ELSE {list(_MET)}[event_id % 5 + 1] END AS action, [1, 2, 4, 8, 0, 0][event_id % 6 + 1] AS gives, CASE WHEN event_id % 5 = 1 THEN 4 ELSE 0 END AS takes, NULL AS outcome FROM events"))
def appointment_dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    action = F.when(e % 41 == 0, "end_call").otherwise(pick("event_id", 5, *[F.lit(x) for x in _MET]))
    return _folded(spark, sf_dir, machines.APPOINTMENT, action, pick("event_id", 6, *[F.lit(x) for x in machines.APPOINTMENT.fields]), F.when(e % 5 == 1, "time"))


@query(
    """WITH t AS (SELECT user_id, event_id, CASE WHEN event_id % 3 = 0 THEN event_type END AS a, CASE WHEN event_id % 5 = 0 THEN user_id::VARCHAR || '-' || event_id END AS b FROM events)
SELECT user_id, event_id, last_value(a IGNORE NULLS) OVER w AS a, last_value(b IGNORE NULLS) OVER w AS b FROM t WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)"""
)
def collected_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    fields = F.create_map(F.lit("a"), F.when(e % 3 == 0, F.col("event_type")), F.lit("b"), F.when(e % 5 == 0, F.concat_ws("-", "user_id", "event_id")))
    found = dialogues.fields_after(table(spark, sf_dir, "events").select("user_id", "event_id", fields.alias("fields")), "user_id", "event_id", "fields")
    at = lambda name: F.try_element_at("collected", F.lit(name)).alias(name)
    return found.select("user_id", "event_id", at("a"), at("b"))


@query("SELECT conv_id, turn, row_number() OVER w::INT AS turn_count, coalesce(max((turn % 4 = 3)::INT) OVER w, 0) = 1 AS over FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)".replace("row_number() OVER w::INT", "(row_number() OVER w)::INT"))
def turn_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogues.turn_numbers(table(spark, sf_dir, "conversations").select("conv_id", "turn"), "conv_id", "turn", F.col("turn") % 4 == 3)


@query("SELECT skip_reason, count(*) AS cnt FROM (SELECT CASE WHEN event_type <> 'error' THEN 'not_actionable' WHEN user_id % 3 = 0 THEN 'no_owner' END AS skip_reason FROM events) GROUP BY 1")
def staged_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("owner", F.when(F.col("user_id") % 3 != 0, F.col("user_id")))
    return counted(dialogues.staged_calls(events, F.col("event_type") == "error"), "skip_reason")


@query(
    """WITH c AS (SELECT user_id, event_id, CASE WHEN event_id % 2 = 0 THEN 'finalize' ELSE 'clear' END AS kind FROM events WHERE event_type = 'purchase'), m AS (SELECT user_id, max(event_id) FILTER (kind = 'finalize') AS done, max(event_id) AS last FROM c GROUP BY 1),
f AS (SELECT c.user_id, max(event_id) AS start FROM c JOIN m USING (user_id) WHERE event_id < done GROUP BY 1), s AS (SELECT user_id, event_id, value FROM events WHERE event_type = 'view')
SELECT s.user_id, count(*) FILTER (event_id < done AND (start IS NULL OR event_id > start)) AS finalised, count(*) FILTER (last IS NULL OR event_id > last) AS open FROM s LEFT JOIN m USING (user_id) LEFT JOIN f USING (user_id) GROUP BY 1"""
)
def calibrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    controls = events.where("event_type = 'purchase'").select("user_id", "event_id", F.when(F.col("event_id") % 2 == 0, "finalize").otherwise("clear").alias("kind"))
    done, left = dialogues.calibrated(events.where("event_type = 'view'").select("user_id", "event_id", "value"), controls, "user_id", "event_id")
    both = done.withColumn("d", F.lit(1)).unionByName(left.withColumn("d", F.lit(0))).select("user_id", "d")
    users = events.where("event_type = 'view'").select("user_id").distinct()
    return users.join(both, "user_id", "left").groupBy("user_id").agg(F.count_if(F.col("d") == 1).alias("finalised"), F.count_if(F.col("d") == 0).alias("open"))


@query(
    """WITH e AS (SELECT user_id::VARCHAR AS user_key, event_id AS seq, CASE WHEN event_type <> 'purchase' THEN 'sample' WHEN event_id % 3 = 0 THEN 'clear' ELSE 'finalize' END AS kind, value AS v FROM events),
n AS (SELECT *, sum((kind <> 'sample')::INT) OVER (PARTITION BY user_key ORDER BY seq) AS m FROM e), s AS (SELECT user_key, m + 1 AS m, count(*) AS samples, avg(v) AS a, coalesce(stddev_samp(v), 0) AS d FROM n WHERE kind = 'sample' GROUP BY ALL)
SELECT user_key, seq, samples, round(round(a, 9), 6) AS mean, round(round(d, 9), 6) AS std FROM n JOIN s USING (user_key, m) WHERE kind = 'finalize'"""
)
def calibration_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finalize of every user, purchases being the marks."""
    v = F.col("value")
    kind = F.when(F.col("event_type") != "purchase", "sample").when(F.col("event_id") % 3 == 0, "clear").otherwise("finalize")
    events = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("user_key"), F.col("event_id").alias("seq"), kind.alias("kind"), v.alias("pitch"), v.alias("jitter"), v.alias("shimmer"))
    found = calibration.calibrations(events)
    return found.select("user_key", "seq", "samples", F.round("pitch_mean", 6).alias("mean"), F.round("pitch_std", 6).alias("std"))


@query(
    """SELECT fault, count(*) AS cnt, sum(samples)::BIGINT AS samples FROM (SELECT CASE WHEN k IS NULL THEN 'key' WHEN s IS NULL OR s < 1 THEN 'samples' WHEN v IS NULL OR v <= 0 OR coalesce(m2, 0) < 0 THEN 'pitch' END AS fault, s AS samples
FROM (SELECT CASE WHEN c_custkey % 17 <> 0 THEN c_custkey END AS k, CASE WHEN c_custkey % 5 = 0 THEN c_nationkey ELSE c_nationkey - 1 END AS s, c_acctbal AS v, CASE WHEN c_custkey % 7 = 0 THEN -1.0 WHEN c_custkey % 2 = 0 THEN 1.0 END AS m2 FROM customer)) GROUP BY fault"""
)
def imported_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = F.col("c_custkey"), F.col("c_nationkey")
    rows = table(spark, sf_dir, "customer").select(
        F.when(c % 17 != 0, c).alias("user_id"), F.when(c % 5 == 0, n).alias("samples"), (n - 1).alias("n"), F.col("c_acctbal").alias("pitch"), F.when(c % 7 == 0, -1.0).when(c % 2 == 0, 1.0).alias("pitch_m2")
    )
    return baselines.imported(rows, "user_id", ["pitch"]).groupBy("fault").agg(F.count("*").alias("cnt"), F.sum("samples").alias("samples"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN -1.0 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 10 <> 7 UNION ALL SELECT c_custkey + 1000000, -1.0 FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 10 <> 7 AND false")
def upserted_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return baselines.upserted(held, held.where("c_custkey % 3 = 0").withColumn("c_acctbal", F.lit(-1.0)), "c_custkey", held.where("c_custkey % 10 = 7"))


# Texts


@query(
    """SELECT c_custkey, lower(c_mktsegment) || ':' || trim(regexp_replace(lower(c_name), '\\s+', ' ', 'g')) AS key, CASE c_custkey % 3 WHEN 0 THEN 'any other time' WHEN 1 THEN '10:00' ELSE '10:00 or 11:00' END AS options,
CASE WHEN c_custkey % 2 = 0 THEN 'late' WHEN c_custkey % 3 = 0 THEN 'soon' ELSE 'now' END AS final, CASE WHEN c_custkey % 2 = 0 THEN 'Dear ' || c_name || ', nation ' || c_nationkey ELSE 'Hello ' || c_name END AS message,
'name: ' || c_name || CASE WHEN c_custkey % 2 = 0 THEN ', nation: ' || c_nationkey ELSE '' END AS summary FROM customer"""
)
def rendered_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, nation = F.col("c_custkey"), F.col("c_nationkey").cast("string")
    options = pick("c_custkey", 3, F.array(F.lit(""), F.lit(None).cast("string")), F.array(F.lit("10:00")), F.array(F.lit("10:00"), F.lit(""), F.lit("11:00")))
    names = F.array(F.lit("name"), F.lit("nation"))
    values = F.create_map(F.lit("nation"), F.when(c % 2 == 0, nation), F.lit("name"), F.col("c_name"))
    templates = F.create_map(F.lit("even"), F.lit("Dear {name}, nation {nation}"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        scenario_key(F.concat(F.lit("#* "), F.col("c_mktsegment")), F.concat(F.col("c_name"), F.lit("  "))).alias("key"),
        options_text(options, " or ", "any other time").alias("options"),
        first_given(F.when(c % 2 == 0, "late").otherwise(""), F.when(c % 3 == 0, "soon"), F.lit("now")).alias("final"),
        rendered(templates, F.when(c % 2 == 0, "even").otherwise("odd"), F.lit("Hello {name}"), values, names).alias("message"),
        labelled(values, names).alias("summary"),
    )


@query("SELECT year(o_orderdate) - 1980 AS age, count(*) AS cnt, min(epoch(o_orderdate)::BIGINT) AS first_second FROM orders GROUP BY 1")
def ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(years_between(F.lit(1980), F.col("o_orderdate")).cast("long").alias("age"), epoch_seconds(F.col("o_orderdate")).alias("s"))
    return rows.groupBy("age").agg(F.count("*").alias("cnt"), F.min("s").alias("first_second"))


@query("SELECT doc_id, coalesce(lang, '') AS lang, row_number() OVER (ORDER BY coalesce(lang, ''), n_chars DESC, doc_id)::INT AS rank FROM documents QUALIFY rank <= 100")
def ordered_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.coalesce("lang", F.lit("")), F.desc("n_chars"), F.col("doc_id")]
    first = table(spark, sf_dir, "documents").orderBy(*order).limit(100)
    return first.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.row_number().over(Window.orderBy(*order)).alias("rank"))


@query("SELECT text_hash, count(*) AS cnt FROM (SELECT sha256(text) AS text_hash FROM conversations UNION ALL SELECT sha256(text) FROM benchmark) GROUP BY 1")
def concatenated_corpora(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = lambda df: df.select(F.sha2("text", 256).alias("text_hash"))
    return counted(hashed(table(spark, sf_dir, "conversations")).unionByName(hashed(table(spark, sf_dir, "benchmark"))), "text_hash")


# Drafts, registries and designs


@query(
    """WITH a AS (SELECT doc_id, lang FROM documents WHERE doc_id % 3 <> 0), b AS (SELECT doc_id FROM documents WHERE doc_id % 5 <> 0), c AS (SELECT doc_id FROM labels)
SELECT sides, count(*) AS cnt FROM (SELECT concat_ws(',', CASE WHEN a.doc_id IS NOT NULL THEN 'label' END, CASE WHEN c.doc_id IS NOT NULL THEN 'owner' END, CASE WHEN b.doc_id IS NOT NULL THEN 'span' END) AS sides
FROM documents d LEFT JOIN a USING (doc_id) LEFT JOIN b USING (doc_id) LEFT JOIN (SELECT DISTINCT doc_id FROM c) c USING (doc_id)) WHERE sides <> '' AND sides <> 'label,owner,span' GROUP BY 1
UNION ALL SELECT 'linked', count(*) FROM a JOIN b USING (doc_id) JOIN c USING (doc_id)"""
)
def linked_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("event", F.lit(1))
    owners = table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("event"), "quality")
    whole, lacking = drafts.linked(docs.where("doc_id % 3 <> 0").select("doc_id", "event", "lang"), docs.where("doc_id % 5 <> 0").select("doc_id", "event", "n_chars"), owners, "doc_id", "event")
    return counted(lacking.select(F.array_join("sides", ",").alias("sides")), "sides").unionByName(whole.agg(F.count("*").alias("cnt")).select(F.lit("linked").alias("sides"), "cnt"))


@query("SELECT p_partkey, CASE WHEN p_brand <> 'Brand#1' THEN upper(p_brand) END AS flow FROM part")
def registry_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    asked = part.select("p_partkey", F.lit("Shop").alias("category"), F.concat(F.lit("* "), F.upper("p_brand")).alias("title"))
    registry = part.where("p_brand <> 'Brand#1'").select(F.lit("shop ").alias("category"), F.concat("p_brand", F.lit("  ")).alias("title"), F.upper("p_brand").alias("flow"))
    return drafts.registered(asked, registry, "category", "title", "flow").select("p_partkey", "flow")


@query(
    """SELECT fault, count(*) AS cnt FROM (SELECT 'missing' AS fault FROM documents WHERE doc_id % 4 = 0 UNION ALL SELECT 'known' FROM documents WHERE doc_id % 2 = 0 AND text IN (SELECT text FROM documents WHERE source = 'src2') UNION ALL SELECT 'unused' FROM documents WHERE doc_id % 2 <> 0 AND doc_id % 4 <> 0 UNION ALL SELECT 'invalid' FROM documents WHERE doc_id % 4 <> 0 AND n_chars % 10 = 0) GROUP BY 1"""
)
def draft_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    known = docs.where("source = 'src2'").select(F.sha2("text", 256).alias("digest"))
    return counted(drafts.draft_faults(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 4 <> 0"), "doc_id", F.col("text"), known, F.col("n_chars") % 10 != 0), "fault")


@query("SELECT o_orderpriority, count(*) AS found, 100 AS expected FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag = 'R' AND l_suppkey % 2 = 0 GROUP BY 1 HAVING count(*) <> 100")
def event_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    event = F.struct(F.when(F.col("l_suppkey") % 2 == 0, F.col("l_suppkey")).alias("owner"), F.col("l_returnflag").alias("flag"))
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(event).alias("events"))
    cases = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority").join(items, "o_orderkey")
    found = drafts.eligible_events(cases, "events", F.col("e.flag") == "R")
    expected = table(spark, sf_dir, "orders").select("o_orderpriority").distinct().withColumn("expected", F.lit(100))
    return drafts.tally_faults(found, ["o_orderpriority"], expected)


@query(
    """WITH h AS (SELECT lang, source, count(*) AS cases FROM documents GROUP BY ALL), r AS (SELECT lang, source FROM (SELECT DISTINCT lang FROM documents), (SELECT DISTINCT source FROM documents WHERE source <> 'src0'))
SELECT coalesce(h.lang, r.lang) AS lang, coalesce(h.source, r.source) AS source, coalesce(cases, 0) AS cases, CASE WHEN r.lang IS NULL THEN 'unplanned' WHEN cases IS NULL THEN 'missing' ELSE 'repeated' END AS fault FROM h FULL JOIN r USING (lang, source) WHERE r.lang IS NULL OR cases IS NULL OR cases > 1"""
)
def design_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("lang", "source")
    required = integrity.grid(docs.select("lang").distinct(), docs.where("source <> 'src0'").select("source").distinct())
    return drafts.slot_faults(docs, ["lang", "source"], required)


@query(
    """SELECT gold, count(*) AS n, count(*) FILTER (hit) AS direct, count(*) FILTER (hit AND gold = 'user') AS true_direct, count(*) FILTER (hit AND gold <> 'user') AS false_direct FROM (SELECT role AS gold, regexp_matches(text, '(?i)\\bthe\\b') AS hit FROM conversations) GROUP BY 1"""
)
def guard_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit, gold = validation.has_hazard(F.col("text"), (r"(?i)\bthe\b",)), F.col("gold")
    turns = table(spark, sf_dir, "conversations").withColumn("gold", F.col("role"))
    return groups.conditional_counts(turns, ["gold"], {"direct": hit, "true_direct": hit & (gold == "user"), "false_direct": hit & (gold != "user")})


@query(
    """SELECT l_returnflag, count(*) AS n, count(*) FILTER (same AND a <= b AND b + 5 <= a + 20) AS contained, count(*) FILTER (same AND greatest(a, b) < least(a + 20, b + 5)) AS overlapping, count(*) FILTER (same AND a = b) AS exact
FROM (SELECT *, l_linenumber % 2 = 0 AS same, l_quantity::INT AS a, (l_partkey % 60)::INT AS b FROM lineitem) GROUP BY 1"""
)
def atomic_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("l_quantity").cast("int"), (F.col("l_partkey") % 60).cast("int")
    clause = F.when(F.col("l_linenumber") % 2 == 0, 1).otherwise(2)
    same = clause == 1
    tests = {"contained": evidence.contains(a, a + 20, b, b + 5, F.lit(1), clause), "overlapping": overlaps(a, a + 20, b, b + 5) & same, "exact": same & (a == b)}
    return groups.conditional_counts(table(spark, sf_dir, "lineitem"), ["l_returnflag"], tests)


@query(
    """SELECT relation, context, count(*) AS cnt, count(size) AS sized, count(color) AS colored FROM (SELECT CASE WHEN sel IS NOT NULL THEN CASE WHEN n > 0 AND sel = '10' THEN 'selected_offer' ELSE 'selected_other' END WHEN n = 0 THEN 'no_offers' ELSE 'offers_unselected' END AS relation,
CASE WHEN color = 'red' THEN 'guarded_color' WHEN size0 IS NULL AND color IS NULL THEN 'empty' WHEN size0 IS NULL OR color IS NULL THEN 'partial' ELSE 'complete' END AS context, CASE a WHEN 'reset' THEN NULL WHEN 'change' THEN NULL ELSE coalesce('XL', size0) END AS size, CASE a WHEN 'reset' THEN NULL ELSE color END AS color
FROM (SELECT CASE p_size % 3 WHEN 0 THEN '10' WHEN 1 THEN '12' END AS sel, p_partkey % 2 AS n, CASE WHEN p_partkey % 3 = 0 THEN 'L' END AS size0, CASE p_partkey % 4 WHEN 0 THEN 'red' WHEN 1 THEN 'blue' END AS color, CASE p_partkey % 5 WHEN 0 THEN 'reset' WHEN 1 THEN 'change' ELSE 'tell' END AS a FROM part)) GROUP BY ALL"""
)
def turns_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    current = F.create_map(F.lit("size"), F.when(k % 3 == 0, "L"), F.lit("color"), pick("p_partkey", 4, F.lit("red"), F.lit("blue")))
    action = F.coalesce(pick("p_partkey", 5, F.lit("reset"), F.lit("change")), F.lit("tell"))
    new = F.create_map(F.lit("size"), F.when(action == "tell", "XL"), F.lit("color"), F.lit(None).cast("string"))
    after = contracts.applied_turn(current, new, action, F.when(action == "change", "size"))
    offered = F.when(k % 2 == 1, F.array(F.lit("10"))).otherwise(F.expr("cast(array() as array<string>)"))
    rows = table(spark, sf_dir, "part").select(
        contracts.alternative_relation(offered, pick("p_size", 3, F.lit("10"), F.lit("12"))).alias("relation"), contracts.context_class(current, {"color": "red"}).alias("context"), after["size"].alias("size"), after["color"].alias("color")
    )
    return rows.groupBy("relation", "context").agg(F.count("*").alias("cnt"), F.count("size").alias("sized"), F.count("color").alias("colored"))


@query("SELECT s_suppkey, '{\"a\":[{\"b\":' || s_nationkey || ',\"c\":\"café\"}],\"n\":null}' AS canonical FROM supplier")
def canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit('{ "n": null, "a": [ {"c": "café", "b": '), F.col("s_nationkey"), F.lit("} ] }"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", documents.canonical_json(text).alias("canonical"))


@query("SELECT c_name AS value, sha256(c_name) AS digest FROM (SELECT DISTINCT c_name FROM customer UNION SELECT DISTINCT c_mktsegment FROM customer)")
def walked_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    inner = F.to_json(F.struct(F.col("c_name").alias("message")))
    line = F.concat(F.lit('{"turns": [{"text": "x", "deep": ['), inner, F.lit(']}], "message": "'), F.col("c_mktsegment"), F.lit(' "}'))
    texts = table(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 2 == 0, line).otherwise(F.concat_ws("\n", line, F.lit("no json"))).alias("t"))
    return files.walked(texts, "t", "message")


@query("SELECT 'action' AS what, list_sort(['change', 'drop', 'keep']) AS vals UNION ALL SELECT 'state', ['done', 'open']")
def union_of_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    actions = _contract(spark)[0]
    gathered = actions.agg(F.collect_set("action").alias("a"), F.collect_set("state").alias("s"))
    both = F.array(*[F.struct(F.lit(what).alias("what"), F.array_sort(contracts.union_of(F.col(x), F.col(x))).alias("vals")) for what, x in (("action", "a"), ("state", "s"))])
    return gathered.select(F.explode(both).alias("x")).select("x.*")
