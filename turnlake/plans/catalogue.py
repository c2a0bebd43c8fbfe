"""The queries over the analytics operators, each with the SQL that gives the same rows (DuckDB)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.functions.documents import fingerprint
from turnlake.functions.numbers import sign_test
from turnlake.functions.text import clauses, stripped
from turnlake.operators import baselines, contracts, groups, integrity, journals, morphemes, scoring, wordfreq
from turnlake.operators.wordfreq import FILLERS as INTERJECTIONS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
TEXT = "n_chars"
#: Words that the queries over this prose count apart: interjections, and articles so that there is something to count.
FILLERS = (*INTERJECTIONS, "the", "le", "el", "der")


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL for the same rows."""

    def register(build):
        QUERIES[build.__name__] = build
        if sql:
            ORACLE_SQL[build.__name__] = sql
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(*names: str, digits: int = 6) -> dict[str, Column]:
    return {x: F.round(x, digits) for x in names}


# Word frequency

_WORDS = r"""WITH w AS (SELECT {keys} lower(t.word) AS word, {order}, t.pos FROM {table} d,
unnest(regexp_extract_all(d.text, '\p{{L}}+')) WITH ORDINALITY AS t(word, pos) {where}),
c AS (SELECT {group} word, count(*) AS cnt, min({order_row}) AS first FROM w GROUP BY ALL) """
_TURN_WORDS = lambda where: _WORDS.format(keys="", order="d.conv_id, d.turn", table="conversations", where=where, group="", order_row="(conv_id, turn, pos)")
_TOP = "SELECT row_number() OVER (ORDER BY cnt DESC, first)::INT AS rank, word, cnt FROM c QUALIFY rank <= {k}"


@query(_TURN_WORDS("WHERE d.role = 'user'") + _TOP.format(k=20))
def wordfreq_user_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = wordfreq.in_scope(table(spark, sf_dir, "conversations"), "user")
    return wordfreq.most_common(wordfreq.tokens(turns, ["conv_id", "turn"]), 20)


@query(_TURN_WORDS("") + _TOP.format(k=50))
def wordfreq_all_scope_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = wordfreq.in_scope(table(spark, sf_dir, "conversations"), "all")
    return wordfreq.most_common(wordfreq.tokens(turns, ["conv_id", "turn"]), 50)


_DOC_WORDS = _WORDS.format(keys="source,", order="d.doc_id", table="documents", where="", group="source,", order_row="(doc_id, pos)")


@query(_DOC_WORDS + "SELECT source, row_number() OVER (PARTITION BY source ORDER BY cnt DESC, first)::INT AS rank, word, cnt FROM c QUALIFY rank <= 10")
def wordfreq_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = wordfreq.tokens(table(spark, sf_dir, "documents"), ["doc_id"], ["source"])
    return wordfreq.most_common(words, 10, ["source"])


@query(_DOC_WORDS + "SELECT source, word, cnt FROM c WHERE cnt >= 100")
def min_count_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = wordfreq.tokens(table(spark, sf_dir, "documents"), ["doc_id"], ["source"])
    return wordfreq.counts(words, ["source"]).where("cnt >= 100").select("source", "word", "cnt")


@query()
def morpheme_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stems and endings of all documents, by a lexicon fitted on them; the fit is iterative, so there is no SQL."""
    docs = table(spark, sf_dir, "documents")
    return morphemes.form_counts(docs, "text", morphemes.fit(docs, "text", morphemes.EUROPEAN_ENDINGS, INTERJECTIONS))


@query(
    rf"""WITH e AS (SELECT conv_id, list_transform(regexp_extract_all(coalesce(text, ''), '\p{{L}}+'), lambda x: lower(x)) AS w FROM conversations),
s AS (SELECT conv_id, count(*) AS total_messages, sum(len(w))::BIGINT AS total_words,
sum(len(list_filter(w, lambda x: x IN {FILLERS})))::BIGINT AS filler_count FROM e GROUP BY conv_id)
SELECT *, CASE WHEN total_words = 0 THEN 0.0 ELSE round_even(filler_count / total_words * 100, 1) END::DOUBLE AS filler_ratio FROM s"""
)
def filler_ratio_by_conversation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordfreq.filler_share(table(spark, sf_dir, "conversations"), ["conv_id"], FILLERS)


# Baselines

_BASE = "SELECT user_id, count(*) AS samples, avg(value) AS value_mean, coalesce(stddev_samp(value), 0) AS value_std FROM events GROUP BY user_id"


@query(f"SELECT user_id, samples, round(value_mean, 6) AS value_mean, round(value_std, 6) AS value_std, round(value_std * value_std * greatest(samples - 1, 0), 4) AS value_m2 FROM ({_BASE})")
def baseline_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = baselines.simple_baseline(table(spark, sf_dir, "events"), "user_id", ["value"])
    return found.withColumns(rounded("value_mean", "value_std") | rounded("value_m2", digits=4))


@query(
    f"""SELECT event_id, user_id, CASE WHEN value_std > 0 THEN round_even((value - value_mean) / value_std, 3) + 0.0 END AS value_z,
CASE WHEN value_mean > 0 THEN round_even((value - value_mean) / value_mean * 100, 3) + 0.0 END AS value_delta_pct FROM events JOIN ({_BASE}) USING (user_id)"""
)
def baseline_zscore_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    base = baselines.simple_baseline(events, "user_id", ["value"])
    return baselines.against_baseline(events, base, "user_id", ["value"]).drop("value")


@query()
def welford_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baselines.welford(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value")


@query(
    """SELECT event_type, CASE WHEN value IS NULL THEN 'missing' WHEN isnan(value) OR isinf(value) THEN 'not_finite'
WHEN value <= 1 OR value > 200 THEN 'out_of_range' END AS fault, count(*) AS cnt FROM events GROUP BY ALL"""
)
def rejected_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = baselines.split_measurements(table(spark, sf_dir, "events"), "value", 1.0, 200.0)
    return found.groupBy("event_type", "fault").agg(F.count("*").alias("cnt"))


# Scoring: labelled documents as cases, a rule over documents as a model


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", TEXT).join(table(spark, sf_dir, "labels"), "doc_id")
    action = F.when(F.col("toxic") == 1, "drop").when(F.col("doc_id") % 4 == 0, "change").otherwise("keep")
    size = F.when(F.col(TEXT) % 3 != 0, F.when(F.col(TEXT) > 500, F.array(F.lit("large"), F.lit("big"))).otherwise(F.array(F.lit("small"))))
    labels = F.struct(
        F.when(F.col("quality") == 1, "good").otherwise("bad").alias("intent"),
        action.alias("action"),
        F.when(action == "change", "lang").alias("change_field"),
        F.create_map(F.lit("lang"), F.array("lang"), F.lit("size"), size).alias("fields"),
    )
    return rows.select(F.col("doc_id").alias("case_id"), "lang", "source", labels.alias("labels"))


def _predictions(spark: SparkSession, sf_dir: str, model: dict[str, int]) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", TEXT)
    number, chars = F.col("doc_id"), F.col(TEXT)
    action = F.when(number % 6 == 0, "change").when(chars < model["drop_below"], "drop").otherwise("keep")
    fields = F.create_map(
        F.lit("lang"), F.when(number % model["omit"] != 0, F.col("lang")), F.lit("size"), F.when(number % 5 != 0, F.when(chars > model["large_over"], "large").otherwise("small"))
    )

    def attempt(valid: bool) -> Column:
        return F.struct(
            F.lit(valid).alias("valid"),
            F.when(chars >= 100, "good").otherwise("bad").alias("intent"),
            action.alias("action"),
            F.when(action == "change", F.when(number % 5 == 0, "size").otherwise("lang")).alias("change_field"),
            fields.alias("fields"),
        )

    attempts = F.when(number % model["fail"] == 0, F.array(attempt(False), attempt(False))).when(number % 11 == 0, F.array(attempt(False), attempt(True))).otherwise(F.array(attempt(True)))
    return rows.select(number.alias("case_id"), attempts.alias("attempts"))


BASELINE = {"drop_below": 200, "omit": 7, "large_over": 400, "fail": 13}
CANDIDATE = {"drop_below": 150, "omit": 9, "large_over": 480, "fail": 17}


def _flags(spark: SparkSession, sf_dir: str, model: dict[str, int]) -> DataFrame:
    return scoring.case_flags(_cases(spark, sf_dir), _predictions(spark, sf_dir, model))


def _flags_sql(model: dict[str, int]) -> str:
    return """(WITH b AS (SELECT doc_id AS case_id, lang, source, CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS g_intent,
CASE WHEN toxic = 1 THEN 'drop' WHEN doc_id % 4 = 0 THEN 'change' ELSE 'keep' END AS gold_action,
CASE WHEN n_chars % 3 <> 0 THEN CASE WHEN n_chars > 500 THEN ['large', 'big'] ELSE ['small'] END END AS g_size,
CASE WHEN n_chars >= 100 THEN 'good' ELSE 'bad' END AS p_intent,
CASE WHEN doc_id % 6 = 0 THEN 'change' WHEN n_chars < {drop_below} THEN 'drop' ELSE 'keep' END AS p_action,
CASE WHEN doc_id % {omit} <> 0 THEN lang END AS p_lang,
CASE WHEN doc_id % 5 <> 0 THEN CASE WHEN n_chars > {large_over} THEN 'large' ELSE 'small' END END AS p_size,
doc_id % {fail} <> 0 AS valid, doc_id % {fail} = 0 OR doc_id % 11 = 0 AS twice FROM documents JOIN labels USING (doc_id)),
f AS (SELECT *, CASE WHEN gold_action = 'change' THEN 'lang' END AS g_change,
CASE WHEN p_action = 'change' THEN CASE WHEN case_id % 5 = 0 THEN 'size' ELSE 'lang' END END AS p_change,
(g_size IS NOT NULL)::INT AS has_size, coalesce(list_contains(g_size, p_size), false) AS size_in FROM b),
n AS (SELECT *, 1 + has_size AS gold_present, CASE WHEN valid THEN (p_lang IS NOT NULL)::INT + (has_size = 1 AND p_size IS NOT NULL)::INT ELSE 0 END AS tp,
CASE WHEN valid THEN (has_size = 0 AND p_size IS NOT NULL)::INT ELSE 0 END AS fp FROM f)
SELECT case_id, lang, source, gold_action, CASE WHEN valid THEN p_action ELSE '__contract_failure__' END AS predicted_action,
(NOT twice)::INT AS first_pass, valid::INT AS final_pass, twice::INT AS retried,
(valid AND g_intent = p_intent AND gold_action = p_action AND g_change IS NOT DISTINCT FROM p_change AND p_lang IS NOT NULL
 AND CASE WHEN has_size = 1 THEN size_in ELSE p_size IS NULL END)::INT AS exact,
(valid AND g_intent = p_intent)::INT AS intent_ok, (valid AND gold_action = p_action)::INT AS action_ok, tp, fp, gold_present - tp AS fn, gold_present,
CASE WHEN valid THEN 1 - has_size ELSE 0 END AS gold_absent,
CASE WHEN valid THEN (p_lang IS NOT NULL)::INT + size_in::INT ELSE 0 END AS value_ok, fp AS hallucinated, gold_present - tp AS omitted,
(gold_action = 'change')::INT AS change_cases, (valid AND gold_action = 'change' AND g_change IS NOT DISTINCT FROM p_change)::INT AS change_ok FROM n)""".format(**model)


RATES = ["exact_rate", "first_pass_rate", "final_pass_rate", "retry_rate", "failure_rate", "intent_accuracy", "action_accuracy", "slot_precision", "slot_recall", "slot_f1", "value_rate", "hallucination_rate", "omission_rate", "change_accuracy"]
_SUMS = "count(*) AS cases, " + ", ".join(f"sum({x})::BIGINT AS {x}" for x in scoring.COUNTERS)
_RATE = lambda a, b, name: f"round(coalesce({a} / nullif({b}, 0), 0), 6) AS {name}"
_RATES_SQL = ", ".join(
    [
        _RATE("exact", "cases", "exact_rate"), _RATE("first_pass", "cases", "first_pass_rate"), _RATE("final_pass", "cases", "final_pass_rate"), _RATE("retried", "cases", "retry_rate"),
        _RATE("(cases - final_pass)", "cases", "failure_rate"), _RATE("intent_ok", "cases", "intent_accuracy"), _RATE("action_ok", "cases", "action_accuracy"),
        _RATE("tp", "(tp + fp)", "slot_precision"), _RATE("tp", "(tp + fn)", "slot_recall"), _RATE("2 * tp", "(2 * tp + fp + fn)", "slot_f1"), _RATE("value_ok", "gold_present", "value_rate"),
        _RATE("hallucinated", "gold_absent", "hallucination_rate"), _RATE("omitted", "gold_present", "omission_rate"), "round(change_ok / nullif(change_cases, 0), 6) AS change_accuracy",
    ]
)


@query(f"SELECT *, {_RATES_SQL} FROM (SELECT {_SUMS} FROM {_flags_sql(BASELINE)})")
def case_scores_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.summary(_flags(spark, sf_dir, BASELINE)).withColumns(rounded(*RATES))


@query(
    f"""WITH f AS (SELECT * FROM {_flags_sql(BASELINE)}), s AS (SELECT 'overall' AS slice, 'all' AS value, {_SUMS} FROM f
UNION ALL SELECT 'scenario', lang, {_SUMS} FROM f GROUP BY lang
UNION ALL SELECT 'tag', tag, {_SUMS} FROM (SELECT *, unnest([lang, source, gold_action]) AS tag FROM f) GROUP BY tag)
SELECT *, {_RATES_SQL} FROM s"""
)
def case_scores_by_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scoring.sliced(_flags(spark, sf_dir, BASELINE), {"scenario": F.col("lang")}, F.array("lang", "source", "gold_action"))
    return found.withColumns(rounded(*RATES))


@query(
    f"""WITH f AS (SELECT * FROM {_flags_sql(BASELINE)}), g AS (SELECT gold_action AS a, count(*) AS gold, sum((gold_action = predicted_action)::INT) AS tp FROM f GROUP BY 1),
p AS (SELECT predicted_action AS a, count(*) AS predicted FROM f GROUP BY 1)
SELECT count(*) AS classes, round(avg(2 * tp / (gold + coalesce(predicted, 0))), 6) AS macro_f1 FROM g LEFT JOIN p USING (a)"""
)
def macro_f1_gold_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.macro_f1(_flags(spark, sf_dir, BASELINE)).withColumns(rounded("macro_f1"))


@query(f"SELECT gold_action, predicted_action, count(*) AS cnt FROM {_flags_sql(BASELINE)} GROUP BY ALL")
def confusion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.confusion(_flags(spark, sf_dir, BASELINE))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact flags b and c of both models, each table read once but the documents of the predictions."""
    return scoring.two_models(_cases(spark, sf_dir), _predictions(spark, sf_dir, BASELINE), _predictions(spark, sf_dir, CANDIDATE))


_PAIR = f"(SELECT case_id, lang, b.exact AS b, c.exact AS c FROM {_flags_sql(BASELINE)} b JOIN {_flags_sql(CANDIDATE)} c USING (case_id, lang))"
_CELLS = "count(*) FILTER (b = 1 AND c = 1) AS both_correct, count(*) FILTER (b = 1 AND c = 0) AS baseline_only, count(*) FILTER (b = 0 AND c = 1) AS candidate_only, count(*) FILTER (b = 0 AND c = 0) AS neither"


@query(f"SELECT {_CELLS} FROM {_PAIR}")
def paired_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.transitions(_pairs(spark, sf_dir))


@query(
    f"""SELECT gains, losses, CASE WHEN n = 0 THEN 1.0 ELSE round(least(1, 2 * list_sum(list_transform(range(0, (least(gains, losses) + 1)::BIGINT),
lambda i: exp(lgamma(n + 1) - CASE WHEN i = 0 THEN 0 ELSE lgamma(i + 1) END - lgamma(n - i + 1) - n * ln(2))))), 9) END::DOUBLE AS p_value
FROM (SELECT candidate_only AS gains, baseline_only AS losses, candidate_only + baseline_only AS n FROM (SELECT {_CELLS} FROM {_PAIR}))"""
)
def mcnemar_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = scoring.transitions(_pairs(spark, sf_dir))
    found = cells.select(F.col("candidate_only").alias("gains"), F.col("baseline_only").alias("losses"))
    return found.withColumn("p_value", F.round(sign_test(F.col("gains"), F.col("losses")), 9))


@query()
def stratified_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.bootstrap(_pairs(spark, sf_dir).withColumn("delta", F.col("c") - F.col("b")), "lang", "delta")


@query(
    """SELECT event_type, count(value) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95_linear,
round(quantile_disc(value, 0.95), 6) AS p95_nearest FROM events GROUP BY event_type"""
)
def percentile_linear_vs_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journals.latency(table(spark, sf_dir, "events"), ["event_type"], "value").withColumns(rounded("p50", "p95_linear", "p95_nearest"))


# Integrity


@query("SELECT sha256(text) AS input, count(*) AS copies, min(doc_id) AS least_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def duplicate_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.duplicate_inputs(table(spark, sf_dir, "documents").where("text is not null"), "doc_id", F.col("text"))


@query(
    """SELECT sha256(lang || ':' || source) AS input, count(DISTINCT quality) AS n_labels, count(*) AS copies
FROM documents JOIN labels USING (doc_id) GROUP BY 1 HAVING count(DISTINCT quality) > 1"""
)
def conflicting_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    return integrity.conflicting_labels(rows, "doc_id", F.concat("lang", F.lit(":"), "source"), "quality")


_SPLIT = "CASE WHEN doc_id % 10 < 7 THEN 'train' ELSE 'test' END"


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumn("split", F.when(F.col("doc_id") % 10 < 7, "train").otherwise("test"))


@query(f"SELECT h AS text_hash, splits FROM (SELECT sha256(text) AS h, count(DISTINCT {_SPLIT}) AS splits FROM documents WHERE text IS NOT NULL GROUP BY 1) WHERE splits > 1")
def split_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _split(spark, sf_dir).where("text is not null").select("split", F.sha2("text", 256).alias("text_hash"))
    return integrity.crossing_groups(rows, "text_hash", "split")


@query(
    rf"""WITH d AS (SELECT doc_id, source, sha256(text) AS h, sha256(regexp_replace(text, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')) AS m, {_SPLIT} AS split FROM documents), a AS (SELECT * FROM d WHERE split = 'train'), b AS (SELECT * FROM d WHERE split = 'test')
SELECT 'ids' AS what, count(DISTINCT doc_id) AS shared FROM a WHERE doc_id IN (SELECT doc_id FROM b)
UNION ALL SELECT 'groups', count(DISTINCT source) FROM a WHERE source IN (SELECT source FROM b)
UNION ALL SELECT 'inputs', count(DISTINCT h) FROM a WHERE h IN (SELECT h FROM b)
UNION ALL SELECT 'messages', count(DISTINCT m) FROM a WHERE m IN (SELECT m FROM b)"""
)
def cross_split_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = {"ids": F.col("doc_id"), "groups": F.col("source"), "inputs": F.sha2("text", 256), "messages": F.sha2(stripped(F.col("text")), 256)}
    return integrity.shared_between(_split(spark, sf_dir), F.col("split") == "train", keys)


@query("SELECT count(*) AS items FROM benchmark WHERE trim(text) IN (SELECT trim(text) FROM documents WHERE text IS NOT NULL)")
def exposure_semijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.exposed(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")).agg(F.count("*").alias("items"))


@query("SELECT item_id FROM benchmark WHERE trim(text) NOT IN (SELECT trim(text) FROM documents WHERE text IS NOT NULL)")
def unexposed_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.unexposed(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")).select("item_id")


_GRID = "(SELECT n_name, event_type FROM (SELECT DISTINCT n_nationkey, n_name FROM nation), (SELECT DISTINCT event_type FROM events))"
_SEEN = "(SELECT DISTINCT n_name, event_type FROM events JOIN nation ON user_id % 40 = n_nationkey WHERE value > 200)"


def _required(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nation, events = table(spark, sf_dir, "nation"), table(spark, sf_dir, "events")
    required = integrity.grid(nation.select("n_name").distinct(), events.select("event_type").distinct())
    covered = events.where("value > 200").withColumn("n_nationkey", (F.col("user_id") % 40).cast("int")).join(nation, "n_nationkey").select("n_name", "event_type")
    return required, covered


@query(f"SELECT n_name, list_sort(list(event_type)) AS missing FROM (SELECT * FROM {_GRID} EXCEPT SELECT * FROM {_SEEN}) GROUP BY n_name")
def coverage_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.grouped_missing(integrity.missing_from(*_required(spark, sf_dir), ["n_name", "event_type"]), "n_name", "event_type")


@query(
    f"""SELECT n_name, count(*) AS required, count(s.e) AS covered, count(*) - count(s.e) AS missing
FROM {_GRID} g LEFT JOIN (SELECT n_name AS n, event_type AS e FROM {_SEEN}) s ON g.n_name = s.n AND g.event_type = s.e GROUP BY n_name"""
)
def coverage_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.progress(*_required(spark, sf_dir), "n_name", ["n_name", "event_type"])


@query(
    """SELECT lang, source FROM (SELECT DISTINCT lang FROM documents), (SELECT DISTINCT source FROM documents)
EXCEPT SELECT lang, source FROM documents WHERE n_chars > 5000"""
)
def design_grid_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("lang", "source", "n_chars")
    whole = integrity.grid(docs.select("lang").distinct(), docs.select("source").distinct())
    return integrity.missing_from(whole, docs.where("n_chars > 5000"), ["lang", "source"])


@query(
    """WITH a AS (SELECT c_custkey + 40 AS k, c_nationkey % 3 AS v FROM customer), b AS (SELECT o_custkey AS k, (count(*) % 3)::INT AS v FROM orders GROUP BY 1)
SELECT status, count(*) AS cnt FROM (SELECT CASE WHEN b.k IS NULL THEN 'source_only' WHEN a.k IS NULL THEN 'destination_only'
WHEN a.v IS NOT DISTINCT FROM b.v THEN 'equal' ELSE 'different' END AS status FROM a FULL JOIN b ON a.k = b.k) GROUP BY status"""
)
def full_outer_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select((F.col("c_custkey") + 40).alias("k"), (F.col("c_nationkey") % 3).alias("v"))
    b = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg((F.count("*") % 3).cast("int").alias("v"))
    return integrity.classify_sides(a, b, "k", "v").groupBy("status").agg(F.count("*").alias("cnt"))


# Lookups, samples, journals


@query(
    """WITH c AS (SELECT p_brand AS brand, p_size AS size, p_type AS slot, p_partkey AS ord FROM part WHERE p_partkey % 2 = 0),
h AS (SELECT brand, size, min_by(slot, ord) AS hit FROM c GROUP BY ALL), a AS (SELECT brand, list(slot ORDER BY f) AS every FROM (SELECT brand, slot, min(ord) AS f FROM c GROUP BY ALL) GROUP BY brand)
SELECT p_partkey, array_to_string(CASE WHEN hit IS NOT NULL THEN [hit] ELSE every END, ',') AS offers
FROM part LEFT JOIN h ON p_brand = h.brand AND p_size + 1 = h.size LEFT JOIN a ON p_brand = a.brand"""
)
def availability_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    catalog = part.where("p_partkey % 2 = 0").select(F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), F.col("p_type").alias("slot"), F.col("p_partkey").alias("ord"))
    asked = part.select("p_partkey", F.col("p_brand").alias("brand"), (F.col("p_size") + 1).alias("size"))
    return journals.lookup_or_all(asked, catalog, "brand", "size", "slot", "ord").select("p_partkey", F.array_join("offers", ",").alias("offers"))


@query("SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY sha256('7:' || c_custkey))::INT AS rank FROM customer QUALIFY rank <= 5")
def hash_ranked_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.ranked_sample(table(spark, sf_dir, "customer"), "c_nationkey", "c_custkey", 5, "7")


@query("SELECT o_custkey, o_orderkey, CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) % 2 = 1 THEN 'AB' ELSE 'BA' END AS arm_order FROM orders")
def ab_ba_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.arm_order(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey").drop("ordinal")


@query(
    """WITH m AS (SELECT user_id, ts, event_id, value < 40 AS i, lag(value < 40) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
r AS (SELECT *, sum((i AND NOT coalesce(p, false))::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM m)
SELECT user_id, run::BIGINT AS run, count(*) AS n FROM r WHERE i GROUP BY ALL HAVING count(*) >= 3"""
)
def gaps_islands_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journals.runs(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("value") < 40, 3, F.unix_micros(F.col("ts").cast("timestamp")))


@query(
    """SELECT l_orderkey, l_linenumber, previous_end FROM (SELECT l_orderkey, l_linenumber, l_quantity::BIGINT AS s,
lag((l_quantity + 5)::BIGINT) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS previous_end FROM lineitem) WHERE s < previous_end"""
)
def span_order_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("l_quantity").cast("long")
    spans = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("ord"), start.alias("s"), (start + 5).alias("e"))
    return journals.order_violations(spans, "l_orderkey", "ord", "s", "e", F.col("l_linenumber")).select("l_orderkey", "l_linenumber", "previous_end")


@query(
    """WITH m AS (SELECT user_id, event_type = 'view' AS b, lead(event_type = 'view') OVER (PARTITION BY user_id ORDER BY event_id) AS f FROM events WHERE event_type IN ('view', 'click'))
SELECT user_id, count(*) FILTER (b) AS begun, count(*) FILTER (b AND NOT f) AS paired, count(*) FILTER (b) - count(*) FILTER (b AND NOT f) AS unpaired FROM m GROUP BY user_id"""
)
def begin_end_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return journals.event_pairs(table(spark, sf_dir, "events"), "user_id", "event_id", kind == "view", kind == "click")


@query(r"SELECT doc_id, len(list_filter(list_transform(string_split(regexp_replace(text, '([.!?。])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), lambda x: x <> ''))::INT AS clauses FROM documents")
def clause_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(clauses(F.col("text"))).alias("clauses"))


@query(
    """SELECT user_id, count(*) AS events, ['normal', 'confirm', 'direct'][max(CASE WHEN event_type = 'error' AND value > 100 THEN 2 WHEN event_type = 'error' THEN 1 ELSE 0 END) + 1] AS route
FROM events GROUP BY user_id"""
)
def route_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    error = F.col("event_type") == "error"
    severity = F.when(error & (F.col("value") > 100), 2).when(error, 1).otherwise(0)
    return journals.aggregate_routes(table(spark, sf_dir, "events"), "user_id", severity)


@query(
    """SELECT user_id % 10 AS arm, event_type, count(value) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95_linear,
round(quantile_disc(value, 0.95), 6) AS p95_nearest FROM events GROUP BY ALL"""
)
def latency_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("arm", F.col("user_id") % 10)
    return journals.latency(events, ["arm", "event_type"], "value").withColumns(rounded("p50", "p95_linear", "p95_nearest"))


EDGES = [1.0, 10.0, 50.0, 100.0, 250.0]


@query(
    "WITH e AS (SELECT * FROM events) "
    + " UNION ALL ".join(f"SELECT event_type, '{x:g}' AS le, count(*) FILTER (value <= {x}) AS cnt FROM e GROUP BY event_type" for x in EDGES)
    + " UNION ALL SELECT event_type, '+Inf', count(value) FROM e GROUP BY event_type"
)
def histogram_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journals.histogram(table(spark, sf_dir, "events"), ["event_type"], "value", EDGES)


@query(
    """WITH u AS (SELECT user_id, count(*) AS n, bool_and(event_type <> 'error' OR value < 100) AS ok, sum((event_type = 'error')::INT) AS errors FROM events GROUP BY user_id)
SELECT count(*) AS cases, sum(n)::BIGINT AS events, count(*) FILTER (ok) AS clean_cases, sum(errors)::BIGINT AS errors, sum(errors) * 4 < sum(n) AS gate FROM u"""
)
def journal_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    error = F.col("event_type") == "error"
    users = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.bool_and(~error | (F.col("value") < 100)).alias("ok"), F.count_if(error).alias("e"))
    found = users.agg(F.count("*").alias("cases"), F.sum("n").alias("events"), F.count_if("ok").alias("clean_cases"), F.sum("e").alias("errors"))
    return groups.gate(found, {"gate": F.col("errors") * 4 < F.col("events")}).drop("passes")


@query("SELECT source, list_sort(list(DISTINCT lang)) AS langs FROM documents GROUP BY source")
def sorted_distinct_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.sorted_sets(table(spark, sf_dir, "documents"), "source", "lang")


@query("SELECT ((2030 - year(o_orderdate)) // 10 * 10)::INT AS decade, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1")
def decade_bucket_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    decade = groups.decade_of(F.lit(2030) - F.year("o_orderdate"))
    return table(spark, sf_dir, "orders").groupBy(decade.alias("decade")).agg(F.count_distinct("o_custkey").alias("customers"))


# Contracts: orders as outputs

_STATES = (("O", "keep"), ("O", "change"), ("F", "keep"), ("P", "change"))


@query(
    """WITH o AS (SELECT o_orderkey AS case_id, o_orderstatus AS state, CASE WHEN o_orderkey % 3 = 0 THEN 'change' ELSE 'keep' END AS action,
CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS priority, CASE WHEN o_orderkey % 5 = 0 THEN 'late' END AS note FROM orders)
SELECT case_id, 'option' AS rule, 'priority' AS detail FROM o WHERE priority NOT IN ('1-URGENT', '2-HIGH', '5-LOW')
UNION ALL SELECT case_id, 'action', action FROM o WHERE (state, action) NOT IN (('O', 'keep'), ('O', 'change'), ('F', 'keep'), ('P', 'change'))
UNION ALL SELECT case_id, 'not_allowed', 'note' FROM o WHERE action = 'keep' AND note IS NOT NULL
UNION ALL SELECT case_id, 'required', 'priority' FROM o WHERE action = 'keep' AND priority IS NULL
UNION ALL SELECT case_id, 'require_any', action FROM o WHERE action = 'change' AND note IS NULL AND priority IS NULL"""
)
def contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    outputs = table(spark, sf_dir, "orders").select(
        key.alias("case_id"),
        F.lit("order").alias("scenario"),
        F.col("o_orderstatus").alias("state"),
        F.when(key % 3 == 0, "change").otherwise("keep").alias("action"),
        F.create_map(F.lit("priority"), F.when(key % 7 != 0, F.col("o_orderpriority")), F.lit("note"), F.when(key % 5 == 0, "late")).alias("fields"),
    )
    options = [("order", "priority", x) for x in ("1-URGENT", "2-HIGH", "5-LOW")] + [("order", "note", None)]
    fields = spark.createDataFrame(options, "scenario string, field string, option string")
    actions = spark.createDataFrame([("order", *x) for x in _STATES], "scenario string, state string, action string")
    rules = [("order", "keep", ["priority"], ["priority"], False), ("order", "change", ["priority", "note"], [], True)]
    rules = spark.createDataFrame(rules, "scenario string, action string, allowed array<string>, required array<string>, require_any boolean")
    return contracts.violations(outputs, fields, actions, rules)


@query("SELECT count(DISTINCT (lang, source)) AS inputs, count(*) AS cases FROM documents")
def input_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(fingerprint(F.col("lang"), F.col("source")).alias("f"))
    return docs.agg(F.count_distinct("f").alias("inputs"), F.count("*").alias("cases"))
