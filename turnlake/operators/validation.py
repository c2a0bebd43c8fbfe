"""Rules for dialogue states, turns and what services return.

Each rule set gives the code of the first rule that a row breaks, null where all hold; a condition that is null counts as
not broken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlake.functions.documents import present_keys
from turnlake.functions.text import nfkc, stripped

#: Affirmative statements of a hazard (a swollen battery, smoke, a burning smell, a hot device), in Korean.
HAZARDS = (
    r"배터리(?:가|는|의)?\s*(?:(?:심하게|많이|점점)\s*)?(?:부풀어\s*(?:올라(?!야|면)|올랐|있(?:어요|습니다))|부풀었(?:어요|습니다|네요|다(?!면|는|고|며)|다고\s*(?:말씀|문의|신고))|부풀었습니다|부풀고(?!\s*있(?:는지|으면))|부풀음|팽창했(?:어요|습니다|네요|다(?!면)))",
    r"연기(?:가|는)?\s*(?:나서|납니다|나요(?!\s*\?)|나네요|나고|났어요|났습니다|올라옵니다|피어오릅니다|발생합니다|발생했어요|발생했습니다)",
    r"타는\s*냄새(?:가|는)?\s*(?:나서|납니다|나요(?!\s*\?)|나네요|나고|났어요|났습니다|올라옵니다|발생합니다|발생했어요|발생했습니다)",
    r"(?:기기|제품|본체|충전기|배터리)(?:가|는)?[^.!?\n]{0,25}(?:뜨거워(?:집니다|졌어요|져요|요|서)|뜨겁습니다)",
)


def first_fault(*rules: tuple[Column, str]) -> Column:
    """Code of the first (broken, code) whose condition holds."""
    return F.coalesce(*[F.when(broken, F.lit(code)) for broken, code in rules], F.lit(None).cast("string"))


def implied(condition: Column, requirement: Column, code: str) -> tuple[Column, str]:
    """The rule that a requirement holds wherever a condition does; a requirement that is null does not hold."""
    return condition & ~F.coalesce(requirement, F.lit(False)), code


def user_id(raw: Column) -> Column:
    """struct (id, fault): an id in compatibility form without outer white space; fault: missing, empty, too_long (over 128), control."""
    plain = stripped(nfkc(raw))
    fault = first_fault((raw.isNull(), "missing"), (plain == "", "empty"), (F.length(plain) > 128, "too_long"), (plain.rlike(r"\p{C}"), "control"))
    return F.struct(F.when(fault.isNull(), plain).alias("id"), fault.alias("fault"))


def turn_fault(names: Column, fields: Column, current: Column, action: Column, change_field: Column, provide: str = "provide", change: str = "change") -> Column:
    """What a turn's output breaks given the fields collected so far (maps of names): a providing turn may set missing fields only, a changing one must replace one that is set."""
    given = present_keys(fields)
    now = F.try_element_at(current, change_field)
    changes = action == change
    return first_fault(
        (F.array_sort(F.map_keys(current)) != F.array_sort(names), "context_fields"),
        ((action == provide) & F.exists(given, lambda k: F.try_element_at(current, k).isNotNull()), "already_collected"),
        (changes & ~F.coalesce(F.array_contains(names, change_field), F.lit(False)), "change_field_unknown"),
        (changes & now.isNull(), "change_target_empty"),
        (changes & F.exists(given, lambda k: k != change_field), "change_extra_field"),
        (changes & (F.try_element_at(fields, change_field) == now), "change_same_value"),
        (~changes & change_field.isNotNull(), "change_field_unexpected"),
    )


def context_fault(current: Column, state: Column, collecting: str, complete: tuple[str, ...], guards: dict[str, tuple[str, str]] | None = None, exempt: tuple[str, ...] = ()) -> Column:
    """What a state's collected fields break: greeting has none, collecting lacks one, complete states lack none.

    guards: a field's value and the state that it demands; the one holds exactly where the other does, but in exempt states.
    """
    given, size = F.size(present_keys(current)), F.size(current)
    rules = [((state == "greeting") & (given > 0), "greeting_not_empty"), ((state == collecting) & (given == size), "collecting_complete"), (state.isin(*complete) & (given < size), "incomplete")]
    for field, (value, wanted) in (guards or {}).items():
        held = F.coalesce(F.try_element_at(current, F.lit(field)) == value, F.lit(False))
        rules.append((~state.isin(*exempt) & (held != (state == wanted)), f"guard_{field}"))
    return first_fault(*rules)


def tag_faults(tags: Column, present: Column, action: Column, required: Column, objective: tuple[str, ...], is_safety: Column) -> Column:
    """Sorted codes of the rules that a case's tags break, given its number of present fields, its action and the objective tags that this demands."""
    has = lambda tag: F.array_contains(tags, tag)
    own = F.array_sort(F.array_intersect(tags, F.array(*[F.lit(x) for x in objective])))
    broken = (
        (F.size(F.array_distinct(tags)) != F.size(tags), "repeated_tag"),
        (has("single_field") != (present == 1), "single_field"),
        (has("multi_field") != (present >= 2), "multi_field"),
        (own != F.array_sort(required), "objective_tags"),
        (has("hard_negative") & ((action != "unknown") | (present > 0)), "hard_negative"),
        (has("safety") != is_safety, "safety"),
    )
    return F.array_sort(F.array_compact(F.array(*[F.when(test, code) for test, code in broken])))


def client_state_fault(requested: Column, held: Column, key: Column, version: int, fields: tuple[str, ...], states: tuple[str, ...]) -> Column:
    """Why a client's state (a map, null or empty for none) is refused, in order of precedence."""
    own = F.try_element_at(held, F.lit("conversation_state"))
    some = F.coalesce(F.size(held) > 0, F.lit(False))
    unknown = F.array_except(F.map_keys(held), F.array(*[F.lit(x) for x in (*fields, "scenario_key", "state_version")]))
    at = lambda name: F.try_element_at(held, F.lit(name))
    return first_fault(
        ((requested.isNotNull() & ~requested.isin(*states)) | (own.isNotNull() & ~own.isin(*states)), "state_invalid"),
        ((requested == "END") | (own == "END"), "already_ended"),
        (some & ~at("scenario_key").eqNullSafe(key), "scenario_mismatch"),
        (some & ~at("state_version").eqNullSafe(F.lit(str(version))), "version_unsupported"),
        (some & (F.size(unknown) > 0), "unknown_field"),
        (some & (requested != own), "state_mismatch"),
    )


def availability_fault(status: Column, reason: Column, time: Column, alternatives: Column) -> Column:
    """What an availability answer breaks: available wants a time and neither reason nor alternatives, unavailable a reason and no time."""
    blank = lambda x: x.isNotNull() & (stripped(x) == "")
    plain = F.transform(alternatives, stripped)
    return first_fault(
        (~F.coalesce(status.isin("available", "unavailable"), F.lit(False)), "status"),
        (blank(reason), "reason_blank"),
        (blank(time), "time_blank"),
        (alternatives.isNull() | F.exists(plain, lambda x: F.coalesce(x == "", F.lit(True))), "alternatives_blank"),
        (F.size(F.array_distinct(plain)) != F.size(plain), "alternatives_repeated"),
        ((status == "available") & (time.isNull() | reason.isNotNull() | (F.size(plain) > 0)), "available_shape"),
        ((status == "unavailable") & (time.isNotNull() | reason.isNull()), "unavailable_shape"),
    )


def alternative_fault(state: Column, action: Column, selected: Column, offered: Column, states: tuple[str, ...], select: str = "select_alternative") -> Column:
    """What a selected alternative breaks: only in alternative states, exactly with the selecting action, and one of those offered."""
    within = state.isin(*states)
    return first_fault(
        (~within & selected.isNotNull(), "selected_outside"),
        (within & ((action == select) != selected.isNotNull()), "selected_with_action"),
        (selected.isNotNull() & ~F.coalesce(F.array_contains(offered, selected), F.lit(False)), "not_offered"),
    )


def has_hazard(text: Column, patterns: tuple[str, ...] = HAZARDS) -> Column:
    """Whether a text states a hazard in one of the patterns; null texts do not."""
    found = F.lit(False)
    for pattern in patterns:
        found = found | F.coalesce(text.rlike(pattern), F.lit(False))
    return found


def output_shape(fields: Column) -> Column:
    """Names of the fields that an output sets, sorted; no values."""
    return F.array_sort(present_keys(fields))


def failure_code(message: Column, codes: dict[str, str], default: str = "other") -> Column:
    """Code of the first substring, in the declared order, that an error message holds; null for no message."""
    found = F.coalesce(*[F.when(message.contains(part), F.lit(code)) for part, code in codes.items()], F.lit(default))
    return F.when(message.isNotNull(), found)


def mismatches(wanted: Column, got: Column) -> Column:
    """Names, sorted, whose values differ between two maps; a missing name is a null value."""
    names = F.array_union(F.map_keys(wanted), F.map_keys(got))
    return F.array_sort(F.filter(names, lambda k: ~F.try_element_at(wanted, k).eqNullSafe(F.try_element_at(got, k))))


def settings_faults(a: DataFrame, b: DataFrame, same: list[str], different: list[str]) -> DataFrame:
    """(setting, fault) for what keeps two one-row reports from being compared: settings that should be the same, or should differ."""
    side = lambda df, name: df.select(F.struct(*[F.col(x).cast("string").alias(x) for x in (*same, *different)]).alias(name)).limit(1)
    joined = side(a, "a").crossJoin(F.broadcast(side(b, "b")))  # one row each
    tests = [F.struct(F.lit(x).alias("setting"), F.when(~F.col(f"a.{x}").eqNullSafe(F.col(f"b.{x}")), "differs").alias("fault")) for x in same]
    tests += [F.struct(F.lit(x).alias("setting"), F.when(F.col(f"a.{x}").eqNullSafe(F.col(f"b.{x}")), "is_the_same").alias("fault")) for x in different]
    return joined.select(F.explode(F.array(*tests)).alias("x")).select("x.*").where("fault is not null")


def error_row_fault(stage: Column, decision: Column, finish: Column) -> Column:
    """What a failed call's row breaks: no decision is kept; after the response the finish reason is stop, in the response stage null or length."""
    return first_fault(
        (stage.isNotNull() & decision.isNotNull(), "decision_kept"),
        (stage.isin("contract", "route") & ~finish.eqNullSafe(F.lit("stop")), "finish_after_response"),
        ((stage == "response") & finish.isNotNull() & (finish != "length"), "finish_in_response"),
    )


def denied(rows: DataFrame, key: str, text: Column, prefixes: tuple[str, ...], hashes: DataFrame) -> DataFrame:
    """rows with column denied: id_prefix where the id begins with a listed prefix, text where the text's SHA-256 is in hashes (hash), else null."""
    known = hashes.select(F.col("hash").alias("_hash")).distinct().withColumn("_known", F.lit(True))
    marked = rows.withColumn("_hash", F.sha2(text, 256)).join(known, "_hash", "left")
    begins = F.lit(False)
    for prefix in prefixes:
        begins = begins | F.col(key).cast("string").startswith(prefix)
    return marked.withColumn("denied", F.when(begins, "id_prefix").when(F.col("_known"), "text")).drop("_hash", "_known")


def eligible(speakers: Column, gender: str, low: int, high: int, age: Column) -> Column:
    """Whether a recording has exactly one speaker, of that gender and of an age from low to high."""
    return F.coalesce((F.size(speakers) == 1) & (F.try_element_at(speakers, F.lit(1))["gender"] == gender) & age.between(low, high), F.lit(False))


def missing_required(required: dict[str, Column]) -> Column:
    """Names of required values that are null, in the declared order."""
    return F.array_compact(F.array(*[F.when(value.isNull(), F.lit(name)) for name, value in required.items()]))
