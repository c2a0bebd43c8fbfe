"""Text functions: Unicode forms, words, clauses, anchored quotes, keyed pseudonyms."""

from __future__ import annotations

import hashlib
import hmac
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: A word: a run of letters. A morpheme tokenizer can take its place (see operators.wordfreq.tokens).
LETTERS = r"(\p{L}+)"
EDGE_SPACE = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def _text_udf(change: Callable[[str], str]):
    @F.pandas_udf(StringType())
    def changed(values: pd.Series) -> pd.Series:
        return values.map(change, na_action="ignore")

    return changed


#: Unicode normal forms, which no built-in function gives.
nfc = _text_udf(lambda x: unicodedata.normalize("NFC", x))
nfkc = _text_udf(lambda x: unicodedata.normalize("NFKC", x))
#: The form under which words are counted: compatibility form, full case folding, no outer white space.
folded = _text_udf(lambda x: unicodedata.normalize("NFKC", x).casefold().strip())


def stripped(text: Column) -> Column:
    """Text without any Unicode white space at its ends (trim takes spaces only)."""
    return F.regexp_replace(text, EDGE_SPACE, "")


def letter_words(text: Column) -> Column:
    """Words of a text, lower-cased, in order; null gives null."""
    return F.regexp_extract_all(F.lower(text), F.lit(LETTERS), F.lit(1))


def clauses(text: Column) -> Column:
    """Clauses: the text cut after sentence marks that white space follows, stripped, without blank ones."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?。])\s+"), stripped), lambda x: x != "")


def scenario_label(text: Column) -> Column:
    """A label's canonical form: compatibility form, lower case, no leading marks, single spaces."""
    plain = F.regexp_replace(F.lower(nfkc(text)), r"^[^\p{L}\p{N}]+", "")
    return stripped(F.regexp_replace(plain, r"\s+", " "))


def anchored(clause_list: Column, clause_index: Column, quote: Column) -> Column:
    """Where a quote stands in the clause of that number (from 1): struct (code, start, end), code points, end exclusive.

    code is null for a quote that occurs exactly once; overlapping occurrences count.
    """
    clause = F.try_element_at(clause_list, clause_index)
    at = F.position(quote, clause)
    again = F.position(quote, clause, at + 1)
    code = (
        F.when(clause_index.isNull() | (clause_index < 1) | (clause_index > F.size(clause_list)), "quote_index_invalid")
        .when(quote.isNull() | (stripped(quote) != quote) | (quote == ""), "quote_blank")
        .when(at == 0, "quote_unanchored")
        .when(again > 0, "quote_nonunique")
    )
    found = code.isNull()
    return F.struct(code.alias("code"), F.when(found, at - 1).alias("start"), F.when(found, at - 1 + F.length(quote)).alias("end"))


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Whether two half-open ranges share a place."""
    return F.greatest(a_start, b_start) < F.least(a_end, b_end)


def pseudonym(value: Column, secret: bytes, prefix: str = "user_hmac_sha256:") -> Column:
    """Keyed pseudonym of an id; the secret stays in the function's closure and out of the plan."""
    if len(secret) < 32:
        raise ValueError("the secret needs 32 bytes or more")

    return _text_udf(lambda x: prefix + hmac.new(secret, x.encode(), hashlib.sha256).hexdigest())(value)


def is_pseudonym(key: Column, prefix: str = "user_hmac_sha256:") -> Column:
    return key.rlike(f"^{prefix}[0-9a-fA-F]{{64}}$")


def scenario_key(category: Column, title: Column) -> Column:
    """Key of a scenario: its category and title in canonical form."""
    return F.concat_ws(":", scenario_label(category), scenario_label(title))


def options_text(options: Column, conjunction: str, otherwise: str) -> Column:
    """Options that are not empty, joined by a conjunction; otherwise where there are none."""
    given = F.filter(options, lambda x: x.isNotNull() & (x != ""))
    return F.when(F.size(given) > 0, F.array_join(given, conjunction)).otherwise(otherwise)


def first_given(*values: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.when(x != "", x) for x in values])


def rendered(templates: Column, key: Column, default: Column, values: Column, names: Column) -> Column:
    """The template of a key, or the default one, with each {name} of names replaced by its value (empty for null)."""
    template = F.coalesce(F.try_element_at(templates, key), default)
    return F.aggregate(names, template, lambda text, name: F.replace(text, F.concat(F.lit("{"), name, F.lit("}")), F.coalesce(F.try_element_at(values, name), F.lit(""))))


def labelled(values: Column, names: Column) -> Column:
    """name: value of the names that have one, in the order of names, comma-joined."""
    given = F.filter(names, lambda k: F.try_element_at(values, k).isNotNull())
    return F.array_join(F.transform(given, lambda k: F.concat_ws(": ", k, F.try_element_at(values, k))), ", ")
