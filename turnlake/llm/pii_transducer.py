"""Personal data in documents, disguised or not, by transducers that keep offsets.

Plain identifiers are found in the text as it stands. Then three transducers rewrite it: look-alike characters become the
ASCII ones that they imitate, spelled digits become digits, and at/dot disguises become @ and full stops. Each keeps, for
every character that it writes, the stretch of source characters that it stands for, so identifiers found in the rewritten
text map back to source spans. Texts without a sign of disguise are not rewritten.
"""

from __future__ import annotations

import re
import string
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from turnlake.llm.shared import small_batches

KINDS = ("email", "ip", "card", "phone")
#: The patterns of the plain identifiers.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")  # found by DOTTED
DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)+")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_CHARS = string.ascii_letters + string.digits + "._%+-"
#: A local part is looked for in this many characters before an @ first, and in twice as many while it fills them.
REACH = 64

#: Greek and Cyrillic letters and the Latin ones that they look like.
LOOK_ALIKES = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "І": "I", "Ј": "J", "Ѕ": "S",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ο": "o", "ν": "v", "ι": "i", "α": "a", "ρ": "p", "υ": "u",
}
DIGIT_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}

_DIGIT = f"(?:{'|'.join(DIGIT_WORDS)}|[0-9])"
#: Four spelled or written digits or more, parted by white space, commas, hyphens or spelled dots; "plus" may lead.
SPELLED = re.compile(rf"(?<![A-Za-z0-9])(?:plus\s+)?{_DIGIT}(?:(?:[\s,-]+(?:(?:dot|point)\s+)?|(?=[0-9])){_DIGIT}){{3,}}(?![A-Za-z])", re.I)
#: Digits that a run has at least, or else these spelled dots (an address of four numbers).
SPELLED_DIGITS, SPELLED_DOTS = 7, 3
SPELLED_PART = re.compile(rf"plus|dot|point|{_DIGIT}|[\s,-]+", re.I)
#: at and dot as a word or in brackets, @, a full stop, or a run of the characters of a name; anything else parts phrases.
PHRASE_PART = re.compile(r"(?P<bracket>[\[({<]\s*(?:at|dot)\s*[\])}>])|(?P<sign>@)|(?P<stop>\.)|(?P<name>[A-Za-z0-9_%+-]+)|(?P<space>\s+)|(?P<rest>[^\sA-Za-z0-9_%+.@-])", re.I)
HOST_LABEL, LAST_LABEL = re.compile(r"[A-Za-z0-9-]+"), re.compile(r"[A-Za-z]{2,24}")
#: What a text with a disguised address has: dot as a word, or at in brackets (or an @ apart from its neighbours).
DOT_WORD, AT_WORD = re.compile(r"dot(?<![a-z]dot)(?![a-z])"), re.compile(r"[\[({<]\s*at\s*[\])}>]")
#: Or at as a word before a host with a full stop.
AT_HOST = re.compile(r"\sat\s+[a-z0-9-]+\.")
#: What a spelled number has: two digits side by side of which one is a word, or dot, point or plus as a word beside a digit.
_WORDS, _APART = "|".join(DIGIT_WORDS), r"[\s,-]+(?:(?:dot|point)\s+)?"
SPELLED_SIGN = re.compile(rf"(?:{_WORDS})(?:{_APART}{_DIGIT}|[0-9])|[0-9](?:{_APART}(?:{_WORDS})|[\s,-]+(?:dot|point)\s+[0-9])|plus\s+{_DIGIT}")
#: Last labels of a host that are believed where "at" stands as a bare word and the dots are full stops, which may
#: also end a sentence: general ones and those of countries.
COMMON_ENDS = frozenset(
    """com org net edu gov mil int info biz name pro io co uk eu example dev app ai me tv xyz online site tech cloud
    ac ad ae af ag al am ao aq ar as at au aw ax az ba bb bd be bf bg bh bi bj bm bn bo br bs bt bw by bz ca cc cd cf cg ch ci ck cl cm cn cr cu cv cw
    cx cy cz de dj dk dm do dz ec ee eg er es et fi fj fk fm fo fr ga gd ge gf gg gh gi gl gm gn gp gq gr gt gu gw gy hk hm hn hr ht hu id ie il im in
    iq ir is it je jm jo jp ke kg kh ki km kn kp kr kw ky kz la lb lc li lk lr ls lt lu lv ly ma mc md mg mh mk ml mm mn mo mp mq mr ms mt mu mv mw mx
    my mz na nc ne nf ng ni nl no np nr nu nz om pa pe pf pg ph pk pl pm pn pr ps pt pw py qa re ro rs ru rw sa sb sc sd se sg sh si sk sl sm sn so sr
    ss st su sv sx sy sz tc td tf tg th tj tk tl tm tn to tr tt tw tz ua ug us uy uz va vc ve vg vi vn vu wf ws ye yt za zm zw""".split()
)
#: Words that no host has as a label where "dot" stands as a bare word; with it, any other last label is believed.
FUNCTION_WORDS = frozenset("a an and any at but by each every for from had has have her his if its my of on or our out over that the their then there these they this those under was were when where which while with your".split())
SPELLED_WORDS = (*DIGIT_WORDS, "dot", "point", "plus")
INVISIBLE = "­​‌‍⁠﻿"


def _alike() -> dict[int, str]:
    table = {ord(a): b for a, b in LOOK_ALIKES.items()}
    for code in (*range(0x0660, 0x3000), *range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800)):
        char = chr(code)
        plain = str(unicodedata.decimal(char)) if unicodedata.decimal(char, None) is not None else unicodedata.normalize("NFKC", char) if code >= 0xFF01 else ""
        if len(plain) == 1 and plain.isascii():
            table[code] = plain
    return table


ALIKE = _alike()
SIGNS = frozenset(map(chr, ALIKE)) | frozenset(INVISIBLE)


def _has_sign(text: str) -> bool:
    """Whether a look-alike or invisible character occurs; all but one lie beyond Latin-1."""
    if text.isascii():
        return False
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return not SIGNS.isdisjoint(text)
    return "\xad" in text


def luhn(digits: str) -> bool:
    odd = sum(int(x) for x in digits[-1::-2])
    even = sum(sum(divmod(2 * int(x), 10)) for x in digits[-2::-2])
    return (odd + even) % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of EMAIL that do not overlap, found from each @ back to the start of its local part."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        reach, start = REACH, at
        while start > end:
            low = max(end, at - reach)
            start = low + len(text[low:at].rstrip(LOCAL_CHARS))
            if start > low or low == end:
                break
            reach *= 2
        if start < at and (match := EMAIL.match(text, start)):
            found.append(match.span())
            end = match.end()
        at = text.find("@", max(at + 1, end))
    return found


def _addresses(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of IP that do not overlap: of each whole run of dotted numbers, four by four from the left."""
    found = []
    for run in DOTTED.finditer(text):
        parts, at = run[0].split("."), run.start()
        for i in range(0, len(parts) - 3, 4):
            four = ".".join(parts[i : i + 4])
            found.append((at, at + len(four)))
            at += len(four) + 1
    return found


def plain(text: str) -> list[tuple[int, int, int]]:
    """(kind's number, start, end) of the identifiers in a text as it stands."""
    found = [(0, *span) for span in _emails(text)] if "@" in text else []
    for start, end in _addresses(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in text[start:end].split(".")):
            found.append((1, start, end))
    for match in CARD.finditer(text):
        digits = match[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append((2, *match.span()))
    for match in PHONE.finditer(text) if "+" in text else ():
        if 8 <= sum("0" <= x <= "9" for x in match[0]) <= 15:
            found.append((3, *match.span()))
    return found


class Rewriting:
    """A text and, for each of its characters, the stretch of the source that it stands for."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends = text, list(range(len(text))), list(range(1, len(text) + 1))

    def apply(self, edits: list[tuple[int, int, str]]) -> None:
        """Write each edit (start, end, new) in place of its stretch; edits are in order and do not overlap."""
        text, starts, ends, at = [], [], [], 0
        for start, end, new in edits:
            text += self.text[at:start], new
            starts += self.starts[at:start] + [self.starts[start]] * len(new)
            ends += self.ends[at:start] + [self.ends[end - 1]] * len(new)
            at = end
        self.text = "".join([*text, self.text[at:]])
        self.starts, self.ends = starts + self.starts[at:], ends + self.ends[at:]

    def source(self, start: int, end: int) -> tuple[int, int]:
        return self.starts[start], self.ends[end - 1]


def _spelled_edits(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for run in SPELLED.finditer(text):
        if not any(x.isalpha() for x in run[0]):
            continue
        parts = list(SPELLED_PART.finditer(text, *run.span()))
        words = [x[0].lower() for x in parts]
        if sum(x in ("dot", "point") for x in words) < SPELLED_DOTS and sum(x in DIGIT_WORDS or x.isdigit() for x in words) < SPELLED_DIGITS:
            continue
        for part in parts:
            word = part[0].lower()
            new = "+" if word == "plus" else "." if word in ("dot", "point") else DIGIT_WORDS.get(word, word if word.isdigit() else "")
            edits.append((*part.span(), new))
    return edits


def _phrases(text: str):
    """Runs of (kind, start, end) of the parts of text that could make up a disguised address: names, at and dot in turn.

    kind is name, at, dot or stop, with the white space around at and dot counted in; bare marks them as words. The text
    is read once; a run ends where two names, or two separators, follow each other.
    """
    run: list[list] = []
    space = None
    for part in PHRASE_PART.finditer(text):
        kind, start, end = part.lastgroup, *part.span()
        if kind == "space":
            space = (start, end)
            continue
        before, space = space, None
        word = part[0].lower()
        if kind == "bracket":
            kind = "at" if "a" in word else "dot"
        elif kind == "sign":
            kind = "at"
        elif kind == "name" and word in ("at", "dot") and before and run and run[-1][0] == "name" and text[end : end + 1].isspace():
            kind = word + " bare"
        if kind == "rest" or kind == "stop" and before:
            if run:
                yield run
            run = []
            continue
        if kind == "name":
            if run and (run[-1][0] == "name" or run[-1][0] == "stop" and before):
                yield run
                run = []
            elif run and before:
                run[-1][2] = end - (end - start)
            run.append([kind, start, end])
        elif not run or run[-1][0] != "name":
            if run:
                yield run
            run = []
        else:
            run.append([kind, before[0] if before else start, end])
    if run:
        yield run


def _believed(host: list[str], bare: set[str], bracketed_dot: bool) -> bool:
    """Whether a phrase that reads as an address is one, by its host where at or dot stand as bare words."""
    if "dot" in bare:
        return FUNCTION_WORDS.isdisjoint(host[:-1]) and (host[-1] not in FUNCTION_WORDS or host[-1] in COMMON_ENDS)
    return not bare or host[-1] in COMMON_ENDS or bracketed_dot


def _disguise_edits(text: str) -> list[tuple[int, int, str]]:
    """Each at of a run with the names and dots before it, back to the at before, and those behind it up to the last that can end a host."""
    edits = []
    for run in _phrases(text):
        first = 0
        for i, (kind, _, _) in enumerate(run):
            if not kind.startswith("at") or i == first or i + 1 >= len(run):
                continue
            last, following = None, i + 1
            while following < len(run) and run[following][0] == "name" and HOST_LABEL.fullmatch(text, *run[following][1:]):
                if following > i + 1 and LAST_LABEL.fullmatch(text, *run[following][1:]):
                    last = following
                if following + 1 >= len(run) or run[following + 1][0].startswith("at"):
                    break
                following += 2
            if last is None:
                first = i + 1
                continue
            whole = run[first : last + 1]
            host = [text[a:b].lower() for k, a, b in run[i + 1 : last + 1] if k == "name"]
            bare = {k.split()[0] for k, _, _ in whole if k.endswith("bare")}
            if _believed(host, bare, any(k == "dot" for k, _, _ in run[i + 1 : last + 1])):
                edits += [(a, b, "@" if k.startswith("at") else ".") for k, a, b in whole if k != "name"]
                first = last + 2
            else:
                first = i + 1
    return edits


def identifiers(text: str | None) -> list[tuple[int, int, int, bool]]:
    """(kind's number, start, end, whether plain) of all identifiers in a whole text, by kind and start.

    A disguised one is added unless it is a plain span itself or lies across one of its kind without holding it whole.
    """
    if not text:
        return []
    base = plain(text) if "@" in text or any(x in text for x in "0123456789") else []
    odd = _has_sign(text)
    low = text.lower()
    spelled = any(x in low for x in SPELLED_WORDS) and SPELLED_SIGN.search(low)
    disguised = ("dot" in low and DOT_WORD.search(low)) or any(x in low for x in "[({<") and AT_WORD.search(low) or "@" in low and re.search(r"\s@|@\s", low) or "at" in low and AT_HOST.search(low)
    if not (odd or spelled or disguised):
        return [(*x, True) for x in sorted(base)]
    new = Rewriting(text)
    if odd:
        new.text = text.translate(ALIKE)
        new.apply([(i, i + 1, "") for i, x in enumerate(new.text) if x in INVISIBLE])
    for wanted, edits in ((spelled or odd, _spelled_edits), (disguised or odd, _disguise_edits)):
        if wanted and (found := edits(new.text)):
            new.apply(found)
    spans = {(k, *new.source(a, b)) for k, a, b in plain(new.text)} - set(base) if new.text != text else set()
    added = [x for x in spans if not any(k == x[0] and a < x[2] and x[1] < b and not (x[1] <= a and b <= x[2]) for k, a, b in base)]
    return sorted([(*x, True) for x in base] + [(*x, False) for x in added])


SPANS = ArrayType(StructType([StructField("kind", IntegerType()), StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("base", BooleanType())]))


@F.pandas_udf(SPANS)
def _identifiers(texts: pd.Series) -> pd.Series:
    return pd.Series([[{"kind": k, "start": a, "end": b, "base": p} for k, a, b, p in identifiers(x)] for x in texts], dtype=object)


@F.pandas_udf(StringType())
def _masked(texts: pd.Series) -> pd.Series:
    out = []
    for text in texts:
        end, parts = 0, []
        for k, a, b, _ in sorted(identifiers(text), key=lambda x: (x[1], -x[2])):
            if a >= end:
                parts += text[end:a], f"[{KINDS[k]}]"
            end = max(end, b)
        out.append("".join([*parts, text[end:]]) if parts else text)
    return pd.Series(out, dtype=object)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (doc_id, spans) for each row of docs; spans are (kind, start, end, base), code points, end exclusive.

    Null and empty texts have no spans, null ids stay, repeated rows give equal rows, an empty table gives an empty one;
    other columns are not read, so their names cannot clash.
    """
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), _identifiers(F.col(text_col)).alias("spans"))


def mask(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with each identifier replaced by its kind in brackets."""
    return docs.withColumn(text_col, _masked(F.col(text_col)))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(x) for x in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")


def op8_pii_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    # a lambda of two parameters would be given the place in the array as its second
    plain_of = lambda k: F.filter("spans", lambda x: x["base"] & (x["kind"] == k))
    counts = [F.size(plain_of(k)).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(_listed(F.filter("spans", lambda x: x["base"])), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda x: ~x["base"])).cast("long").alias("n_added"),
    )
