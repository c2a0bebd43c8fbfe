"""Checks that bind tables to each other: reviews to cases, records to their predecessors, journals to a plan, inventories to files.

Each returns the rows that break a rule, so an empty result means that it holds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnlake.functions.text import nfc
from turnlake.operators import scans


def review_faults(cases: DataFrame, ledger: DataFrame, key: str, digest: str, status: str = "status", done: str = "adjudicated") -> DataFrame:
    """(key, fault) of cases and reviews that do not pair one to one: missing, unused, repeated, open (not done) and stale (the case's digest has changed)."""
    reviews = ledger.groupBy(key).agg(F.count("*").alias("_n"), F.max(digest).alias("_of"), F.max((F.col(status) != done).cast("int")).alias("_open"))
    joined = cases.select(key, F.col(digest).alias("_now"), F.lit(True).alias("_case")).join(reviews, key, "full")
    fault = (
        F.when(F.col("_n").isNull(), "missing").when(F.col("_case").isNull(), "unused").when(F.col("_n") > 1, "repeated").when(F.col("_open") == 1, "open").when(~F.col("_now").eqNullSafe(F.col("_of")), "stale")
    )
    return joined.select(key, fault.alias("fault")).where("fault is not null")


def unassigned(groups: DataFrame, assignments: DataFrame, key: str) -> DataFrame:
    """(key, fault): groups without an assignment, and assignments of no group."""
    a, b = groups.select(key).distinct(), assignments.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("fault", F.lit("missing")).unionByName(b.join(a, key, "left_anti").withColumn("fault", F.lit("unused")))


def lineage_faults(records: DataFrame, line: str, revision: str, digest: str, previous: str) -> DataFrame:
    """(line, revision, fault) of records that do not follow the one before: revisions from 1 without gaps, the first without a predecessor, each naming the digest of the last."""
    over = Window.partitionBy(line).orderBy(revision)
    marked = records.select(line, revision, F.row_number().over(over).alias("place"), F.lag(digest).over(over).alias("before"), F.col(previous).alias("named"))
    fault = F.when(F.col(revision) != F.col("place"), "not_contiguous").when((F.col("place") == 1) & F.col("named").isNotNull(), "first_has_predecessor").when((F.col("place") > 1) & ~F.col("named").eqNullSafe(F.col("before")), "predecessor_differs")
    return marked.select(line, revision, fault.alias("fault")).where("fault is not null")


def restart_faults(boundaries: DataFrame, run: str, order: list[str], identity: str, started: str, is_restart: Column, by: Column | None = None) -> DataFrame:
    """(run, order, fault) of a run's boundaries: the identity never changes, and the start changes exactly at a restart.

    by: a number that rises with order (default: the first order column); a run with most of the rows is looked at in
    blocks of it.
    """
    marked = boundaries.select(run, *order, F.col(identity).alias("_identity"), F.col(started).alias("_started"), is_restart.alias("_restart"), (F.col(order[0]) if by is None else by).alias("_by"))
    placed = scans.with_first(scans.in_blocks(marked, run, F.col("_by")), run, order, "_first", F.col("_identity"))
    placed = scans.with_previous(placed, run, order, "_before", F.col("_started"))
    moved = F.col("_before").isNotNull() & ~F.col("_before").eqNullSafe(F.col("_started"))
    fault = F.when(~F.col("_identity").eqNullSafe(F.col("_first")), "identity_changed").when(F.col("_before").isNotNull() & F.col("_restart") & ~moved, "restart_without_new_start").when(moved & ~F.col("_restart"), "start_changed")
    return placed.select(run, *order, fault.alias("fault")).where("fault is not null")


def multiset_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, a, b) for each key combination that the two sides have a different number of times; null equals null."""
    count = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    left, right = count(a, "a"), count(b.select(*[F.col(x).alias(f"_{x}") for x in keys]).toDF(*keys), "b").toDF(*[f"_{x}" for x in keys], "b")
    on = F.lit(True)
    for x in keys:
        on = on & left[x].eqNullSafe(right[f"_{x}"])
    joined = left.join(right, on, "full")
    sides = [F.when(F.col("a").isNotNull(), F.col(x)).otherwise(F.col(f"_{x}")).alias(x) for x in keys]
    return joined.select(*sides, F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b")).where("a <> b")


def key_collisions(maps: DataFrame, key: str, names: Column, form=nfc) -> DataFrame:
    """(key, name, spellings): names of one map that are equal in a normal form (NFC unless said otherwise) but spelled differently."""
    each = maps.select(key, F.explode(names).alias("spelling")).withColumn("name", form(F.col("spelling")))
    return each.groupBy(key, "name").agg(F.array_sort(F.collect_set("spelling")).alias("spellings")).where(F.size("spellings") > 1)


def contrast_faults(members: DataFrame, roles: DataFrame, cases: DataFrame) -> DataFrame:
    """(group, fault) of contrast groups: repeated_family (in one split), roles, case_missing, scenario, action, split, signature.

    members: group, family, role, case_id; roles: family, role, scenario, actions (empty: any); cases: case_id, scenario,
    action, split, signature. A family's roles are a short list.
    """
    wanted = roles.groupBy("family").agg(F.array_sort(F.collect_set("role")).alias("wanted"))
    known = cases.select("case_id", F.col("scenario").alias("case_scenario"), "action", "split", "signature", F.lit(True).alias("known"))
    joined = members.join(known, "case_id", "left").join(roles.select("family", "role", "scenario", "actions"), ["family", "role"], "left")
    found = joined.groupBy("group", "family").agg(
        F.array_sort(F.collect_set("role")).alias("held"),
        F.count("*").alias("n"),
        F.count_if(F.col("known").isNull()).alias("no_case"),
        F.count_if(F.col("case_scenario") != F.col("scenario")).alias("other_scenario"),
        F.count_if((F.size("actions") > 0) & ~F.array_contains("actions", F.col("action"))).alias("other_action"),
        F.count_distinct("split").alias("splits"),
        F.count_distinct("signature").alias("signatures"),
        F.min("split").alias("split"),
    )
    again = F.count("*").over(Window.partitionBy("family", "split")) > 1
    tests = [
        (F.col("again"), "repeated_family"), (F.col("wanted").isNull() | (F.col("held") != F.col("wanted")) | (F.col("n") != F.size("held")), "roles"), (F.col("no_case") > 0, "case_missing"),
        (F.col("other_scenario") > 0, "scenario"), (F.col("other_action") > 0, "action"), (F.col("splits") > 1, "split"), (F.col("signatures") > 1, "signature"),
    ]
    faults = F.array_compact(F.array(*[F.when(test, code) for test, code in tests]))
    return found.withColumn("again", again).join(wanted, "family", "left").select("group", F.explode(faults).alias("fault"))


def paired_journal_faults(journal: DataFrame, seq: str, cases: int, arms: tuple[str, str] = ("A", "B")) -> DataFrame:
    """(seq, fault) of a journal that should be a header and, for each case, begin and end of both arms, AB for even cases and BA for odd ones.

    journal: seq from 0, event, case_no from 0, arm. place, length and order are the faults.
    """
    at = F.col(seq) - 1
    case, step = F.floor(at / 4), F.pmod(at, F.lit(4))
    first = F.when(F.pmod(case, F.lit(2)) == 0, arms[0]).otherwise(arms[1])
    second = F.when(F.pmod(case, F.lit(2)) == 0, arms[1]).otherwise(arms[0])
    event = F.when(F.pmod(step, F.lit(2)) == 0, "begin").otherwise("end")
    arm = F.when(step < 2, first).otherwise(second)
    fault = (
        F.when(F.col(seq) == 0, F.when(F.col("event") != "header", "header"))
        .when(case >= cases, "length")
        .when(~F.col("event").eqNullSafe(event), "event")
        .when(~F.col("case_no").eqNullSafe(case), "case")
        .when(~F.col("arm").eqNullSafe(arm), "arm")
    )
    return journal.select(seq, fault.alias("fault")).where("fault is not null")


def byte_digests(rows: DataFrame, keys: list[str], content: str) -> DataFrame:
    """(keys, digest): the SHA-256 of each content, text by its UTF-8 bytes, binary as it is; with byte_faults it binds a table to what was recorded."""
    return rows.select(*keys, F.sha2(F.col(content).cast("binary"), 256).alias("digest"))


def byte_faults(found: DataFrame, recorded: DataFrame, key: str) -> DataFrame:
    """(key, fault): contents whose digest is not the recorded one, is not recorded, or is recorded for nothing."""
    joined = found.select(key, F.col("digest").alias("_a")).join(recorded.select(key, F.col("digest").alias("_b")), key, "full")
    fault = F.when(F.col("_b").isNull(), "not_recorded").when(F.col("_a").isNull(), "not_found").when(F.col("_a") != F.col("_b"), "differs")
    return joined.select(key, fault.alias("fault")).where("fault is not null")


def amended(rows: DataFrame, amendments: DataFrame, key: str, values: str) -> DataFrame:
    """rows with map values amended, and column fault.

    amendments: key, name, old, new. A name whose value is not the amendment's old one stays, and fault names it; a null old
    value stands for a name without a value.
    """
    own = amendments.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("name", F.struct("old", "new")))).alias("_new"))
    joined = rows.join(own, key, "left")
    at = lambda k: F.try_element_at(F.col("_new"), k)
    wrong = F.array_sort(F.filter(F.map_keys("_new"), lambda k: ~F.try_element_at(F.col(values), k).eqNullSafe(at(k)["old"])))
    change = lambda k, v: F.when(at(k).isNotNull() & v.eqNullSafe(at(k)["old"]), at(k)["new"]).otherwise(v)
    fault = F.when(F.size(wrong) > 0, F.array_join(wrong, ","))
    return joined.withColumn("fault", fault).withColumn(values, F.when(F.col("_new").isNull(), F.col(values)).otherwise(F.transform_values(values, change))).drop("_new")


def compiled(table: DataFrame, key: str, order: str, cells: dict[str, tuple[Column, tuple[str, ...]]]) -> DataFrame:
    """(key, events, fault): rows of a reviewed table nested by key in order, each cell checked against its allowed values; fault lists the cells that are not."""
    wrong = F.array_compact(F.array(*[F.when(~F.coalesce(value.isin(*allowed), F.lit(False)), name) for name, (value, allowed) in cells.items()]))
    each = table.select(key, F.struct(F.col(order), *[value.alias(name) for name, (value, _) in cells.items()]).alias("e"), wrong.alias("w"))
    found = each.groupBy(key).agg(F.array_sort(F.collect_list("e")).alias("events"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("w")))).alias("w"))
    return found.select(key, "events", F.when(F.size("w") > 0, F.array_join("w", ",")).alias("fault"))


def promotion_faults(cases: DataFrame, prefixes: tuple[str, ...], generated: DataFrame, required: str = "human_authored") -> DataFrame:
    """(group_id, case_id, fault) for cases that must not become human-authored source: provenance, group_prefix, case_prefix, verbatim_text, repeated_case.

    cases: group_id, case_id, provenance, text; generated: text, what a model wrote. Prefixes mark ids of generated cases;
    texts are the same if their canonical composed forms are. Generated texts are joined by digest, so their list may be
    of any length. A null text is no generated one; a null provenance is not the required one.
    """
    digest = lambda text: F.sha2(nfc(text), 256)
    known = generated.where("text is not null").select(digest(F.col("text")).alias("_digest")).distinct().withColumn("_known", F.lit(True))
    marked = cases.withColumn("_digest", digest(F.col("text"))).join(known, "_digest", "left")
    marked = marked.withColumn("_again", F.count("*").over(Window.partitionBy("group_id", "case_id")) > 1)
    begins = lambda name: reduce(lambda a, x: a | F.col(name).startswith(x), prefixes, F.lit(False))
    tests = ((~F.col("provenance").eqNullSafe(F.lit(required)), "provenance"), (begins("group_id"), "group_prefix"), (begins("case_id"), "case_prefix"), (F.col("_known"), "verbatim_text"), (F.col("_again"), "repeated_case"))
    return marked.select("group_id", "case_id", F.explode(F.array_compact(F.array(*[F.when(test, code) for test, code in tests]))).alias("fault")).distinct()
