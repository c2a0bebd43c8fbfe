"""Strict and canonical JSON, and key sets of maps."""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType


@F.pandas_udf(BooleanType())
def _one_value(texts: pd.Series) -> pd.Series:
    """Whether a text holds one JSON value and nothing behind it."""

    def of(text) -> bool:
        try:
            json.loads(text)
        except (TypeError, ValueError, RecursionError):
            return False
        return True

    return texts.map(of)


def strict_json(text: Column) -> Column:
    """The parsed value, or null where the text is no JSON, repeats a key, holds NaN or infinity, or goes on behind the value.

    The built-in parser reads the first value and leaves what follows, so a worker checks that nothing does.
    """
    return F.when(_one_value(text), F.try_parse_json(text))


def json_fault(text: Column, keys: list[str]) -> Column:
    """Why a text is not an object of exactly these keys: blank, malformed, missing_keys, unexpected_keys; else null."""
    names = F.json_object_keys(text)
    wanted = F.array(*[F.lit(x) for x in keys])
    return (
        F.when(text.isNull() | (F.trim(text) == ""), "blank")
        .when(strict_json(text).isNull() | names.isNull(), "malformed")
        .when(F.size(F.array_except(wanted, names)) > 0, "missing_keys")
        .when(F.size(F.array_except(names, wanted)) > 0, "unexpected_keys")
    )


def canonical_map(values: Column) -> Column:
    """JSON of a map with its keys in order; null values are kept."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(values))))


def fingerprint(*parts: Column) -> Column:
    """SHA-256 of the parts' JSON, nulls kept."""
    named = F.struct(*[x.alias(f"p{i}") for i, x in enumerate(parts)])
    return F.sha2(F.to_json(named, {"ignoreNullFields": "false"}), 256)


def present_keys(values: Column) -> Column:
    """Keys of a map whose value is not null."""
    return F.map_keys(F.map_filter(values, lambda k, v: v.isNotNull()))


def _in_form(node, form: str | None):
    """A parsed value with all strings and names in a normal form; two names of an object that become equal are an error."""
    if isinstance(node, dict):
        new = {unicodedata.normalize(form, k) if form else k: _in_form(v, form) for k, v in node.items()}
        if len(new) != len(node):
            raise ValueError("names collide in normal form")
        return new
    if isinstance(node, list):
        return [_in_form(x, form) for x in node]
    return unicodedata.normalize(form, node) if form and isinstance(node, str) else node


def canonical_json(text: Column, form: str | None = "NFC") -> Column:
    """A JSON text with names in order at every level, compact, nothing escaped that need not be, strings in a normal form; null where it is no strict JSON or names collide."""

    @F.pandas_udf(StringType())
    def canonical(values: pd.Series) -> pd.Series:
        def of(value):
            try:
                return None if value is None else json.dumps(_in_form(json.loads(value), form), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
            except ValueError:
                return None

        return values.map(of)

    return F.when(strict_json(text).isNotNull(), canonical(text))


def accepted(fields: Column) -> Column:
    """The first accepted value of each field (map of names to arrays), null where the field must be absent."""
    return F.transform_values(fields, lambda k, v: F.try_element_at(v, F.lit(1)))
