"""Words cut into a stem and its endings: a lattice over a lexicon, costs that EM fits on a corpus, the cheapest path.

A word between white space is a stem and any number of endings, or one interjection. Endings and interjections are closed
lists of a language, which the caller gives; stems are learned. The distinct words of the corpus name the stems that are
left when endings are taken off; EM then shares each word's count among its readings (an expectation over the paths of its
lattice, forward and backward) and re-estimates how likely every stem and every ending is, in rounds of one aggregation
each. A sparse prior (DISCOUNT) drops stems that other readings explain. Analysis takes the likeliest path. The lexicon has
at most MOST stems, the most frequent, so every worker can hold it; stems are met by their
lengths in one table of hashes, since a trie of them takes some ten times its memory.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.session import checkpointed

#: Stems of a lexicon; rounds of EM; what a stem's expected count loses in each; endings of one word; least characters of a stem.
MOST, ROUNDS, DISCOUNT, ENDINGS, LEAST_STEM = 200_000, 4, 0.25, 3, 1
STEM, ENDING, INTERJECTION, UNKNOWN = "stem", "ending", "interjection", "unknown"
#: Texts whose words a worker holds at once, and about as many bytes of an Arrow batch.
TEXTS_AT_ONCE, BYTES_AT_ONCE = 200, 8 << 20
#: Cost of a stem that the lexicon does not hold, and of each of its characters.
NEW_STEM, NEW_CHARACTER = 12.0, 4.0
NO_ENDING = ""

#: Common particles, endings and interjections of Korean.
KOREAN_ENDINGS = (
    "이", "가", "은", "는", "을", "를", "의", "에", "에서", "에게", "한테", "으로", "로", "와", "과", "도", "만", "까지", "부터", "보다", "처럼", "이나", "나",
    "하고", "했고", "하면", "해서", "해요", "했어요", "합니다", "했습니다", "하는", "한", "할", "고", "어요", "아요", "었어요", "았어요", "습니다", "입니다", "세요",
)
KOREAN_INTERJECTIONS = ("어", "음", "아", "네", "예", "응", "글쎄", "저기")
#: Common endings of English, German, French and Spanish words.
EUROPEAN_ENDINGS = ("s", "es", "ed", "ing", "ly", "er", "en", "e", "ion", "tion", "keit", "heit", "lich", "ung", "ment", "eaux", "ier", "ar", "o", "a", "os", "as")


def plain(text: str | None) -> list[str]:
    """Words of a text in compatibility form, folded, without marks at their ends."""
    folded = unicodedata.normalize("NFKC", text or "").casefold()
    found = (trimmed(x) for x in folded.split())
    return [x for x in found if x]


def trimmed(word: str) -> str:
    kept = [i for i, x in enumerate(word) if x.isalnum()]
    return word[kept[0] : kept[-1] + 1] if kept else ""


class Trie:
    """Forms by their letters; each gives the forms that begin at a place of a word."""

    END = ""

    def __init__(self, forms: Iterable[str]):
        self.root: dict = {}
        for form in forms:
            node = self.root
            for letter in form:
                node = node.setdefault(letter, {})
            node[self.END] = form

    def at(self, word: str, place: int) -> Iterator[str]:
        node = self.root
        for letter in word[place:]:
            node = node.get(letter)
            if node is None:
                return
            if self.END in node:
                yield node[self.END]


class Beginnings:
    """Forms with which a word begins, shortest first: one look for each length that forms have."""

    def __init__(self, forms: dict[str, float]):
        self.forms, self.lengths = forms, sorted({len(x) for x in forms})

    def at(self, word: str) -> Iterator[str]:
        for length in self.lengths:
            if length > len(word):
                return
            if word[:length] in self.forms:
                yield word[:length]


@dataclass(frozen=True)
class Lexicon:
    """Costs (negative logarithms) of stems and endings, NO_ENDING among them, and the interjections."""

    stems: dict[str, float]
    endings: dict[str, float]
    interjections: frozenset[str] = frozenset()


class Analyzer:
    """Readings of words by one lexicon."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.stems, self.endings = Beginnings(lexicon.stems), Trie(x for x in lexicon.endings if x)
        self.known: dict[str, list[tuple[str, str]]] = {}

    def edges(self, word: str) -> list[tuple[int, int, str, str | None, float]]:
        """The lattice: (from, to, kind, form, cost). A path is a stem and either NO_ENDING or endings.

        Nodes are 0, twice the place where a stem ends, twice the place where an ending ends and one more, and -1; those
        before -1 rise along every path. The last edge after endings has no form and no cost.
        """
        out = [(0, 2 * len(x), STEM, x, self.lexicon.stems[x]) for x in self.stems.at(word) if len(x) >= min(LEAST_STEM, len(word))]
        reached = {x[1] for x in out}
        for place in range(1, len(word)) if out else ():
            nodes = [x for x in (2 * place, 2 * place + 1) if x in reached]
            for form in self.endings.at(word, place) if nodes else ():
                out += [(x, 2 * (place + len(form)) + 1, ENDING, form, self.lexicon.endings[form]) for x in nodes]
                reached.add(2 * (place + len(form)) + 1)
        last = 2 * len(word)
        if last in reached:
            out.append((last, -1, ENDING, NO_ENDING, self.lexicon.endings[NO_ENDING]))
        if last + 1 in reached:
            out.append((last + 1, -1, ENDING, None, 0.0))
        return out

    def expected(self, word: str) -> tuple[dict[tuple[str, str], float], float]:
        """Expected uses of each form over all readings of a word, and the logarithm of its likelihood; nothing for a word that has no reading."""
        edges = sorted(self.edges(word), key=lambda x: x[0])
        ahead = {0: 1.0}
        for a, b, _, _, cost in edges:
            if a in ahead:
                ahead[b] = ahead.get(b, 0.0) + ahead[a] * math.exp(-cost)
        total = ahead.get(-1, 0.0)
        if not total:
            return {}, 0.0
        behind = {-1: 1.0}
        for a, b, _, _, cost in reversed(edges):
            if b in behind:
                behind[a] = behind.get(a, 0.0) + behind[b] * math.exp(-cost)
        out: dict[tuple[str, str], float] = {}
        for a, b, kind, form, cost in edges:
            share = ahead.get(a, 0.0) * math.exp(-cost) * behind.get(b, 0.0) / total
            if share and form is not None:
                out[kind, form] = out.get((kind, form), 0.0) + share
        return out, math.log(total)

    def reading(self, word: str) -> list[tuple[str, str]]:
        """(form, kind) of the likeliest reading, of equally likely ones the one with the longest stem; a word without one is a new stem, whole or before an ending."""
        if word not in self.known:
            if len(self.known) > MOST:
                self.known.clear()
            self.known[word] = self.likeliest(word)
        return self.known[word]

    def likeliest(self, word: str) -> list[tuple[str, str]]:
        """reading() without keeping it, for words that come once."""
        if word in self.lexicon.interjections:
            return [(word, INTERJECTION)]
        best: dict[int, tuple[float, list[tuple[str, str]]]] = {0: (0.0, [])}
        for a, b, kind, form, cost in sorted(self.edges(word), key=lambda x: (x[0], -x[1])):
            if a in best:
                whole = best[a][0] + cost
                if b not in best or whole < best[b][0] - 1e-12:
                    best[b] = (whole, best[a][1] + ([(form, kind)] if form else []))
        if -1 in best:
            return best[-1][1]
        # no stem of the lexicon fits
        tails = [(NEW_STEM + NEW_CHARACTER * len(word) + self.lexicon.endings[NO_ENDING], word, "")]
        tails += [(NEW_STEM + NEW_CHARACTER * (len(word) - len(x)) + self.lexicon.endings[x], word[: -len(x)], x) for x in self.lexicon.endings if x and word.endswith(x) and len(word) - len(x) > LEAST_STEM]
        _, stem, ending = min(tails, key=lambda x: (x[0], -len(x[1])))
        return [(stem, UNKNOWN), *([(ending, ENDING)] if ending else [])]


def small_batches(spark: SparkSession) -> None:
    """Let Arrow carry about BYTES_AT_ONCE bytes at once to Python; a setting of the session, of which a smaller one of the caller is kept."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(spark.conf.get(setting, str(2**31 - 1)))
    if not now.isdigit() or not 0 < int(now) <= BYTES_AT_ONCE:
        spark.conf.set(setting, str(BYTES_AT_ONCE))


def words(texts: DataFrame, text: str) -> DataFrame:
    """Distinct words of texts with their counts (word, n)."""

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for low in range(0, len(frame), TEXTS_AT_ONCE):
                found = Counter(word for x in frame[text].iloc[low : low + TEXTS_AT_ONCE] for word in plain(x))
                if found:
                    yield pd.DataFrame({"word": list(found.keys()), "n": list(found.values())})

    small_batches(texts.sparkSession)
    counted = texts.select(text).mapInPandas(of, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "word")  # a short table is long work


def stems_of(word: str, endings: tuple[str, ...]) -> set[str]:
    """What can be left of a word when up to ENDINGS endings are taken off, itself included."""
    found, last = {word}, {word}
    for _ in range(ENDINGS):
        last = {x[: -len(e)] for x in last for e in endings if x.endswith(e) and len(x) - len(e) >= LEAST_STEM}
        found |= last
    return found


def fit(texts: DataFrame, text: str, endings: tuple[str, ...], interjections: tuple[str, ...] = (), rounds: int = ROUNDS, most: int = MOST) -> Lexicon:
    """A lexicon from the words of texts; interjections are no stems. Null and empty texts say nothing; without a word there are no stems."""
    counted = checkpointed(words(texts, text).where(~F.col("word").isin(*interjections) if interjections else F.lit(True)))

    def named(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(x, n) for word, n in zip(frame["word"], frame["n"], strict=True) for x in stems_of(word, endings)]
            yield pd.DataFrame(rows, columns=["form", "n"])

    stems = counted.mapInPandas(named, "form string, n long").groupBy("form").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "form").limit(most).collect()
    total = sum(r.n for r in stems)
    even = math.log(len(endings) + 1)
    lexicon = Lexicon({r.form: math.log(total / r.n) for r in stems}, dict.fromkeys((NO_ENDING, *endings), even), frozenset(interjections))
    for _ in range(rounds):
        lexicon = refitted(counted, lexicon)
    return lexicon


def expectations(counted: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Expected uses (kind, form, uses) of all forms over the words (word, n)."""
    sent = counted.sparkSession.sparkContext.broadcast(lexicon)

    def expect(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, sums = Analyzer(sent.value), {}
        for frame in frames:
            for word, n in zip(frame["word"], frame["n"], strict=True):
                for form, share in own.expected(word)[0].items():
                    sums[form] = sums.get(form, 0.0) + n * share
        yield pd.DataFrame([(*k, v) for k, v in sums.items()], columns=["kind", "form", "uses"])

    summed = counted.mapInPandas(expect, "kind string, form string, uses double").groupBy("kind", "form")
    return summed.agg(F.sum("uses").alias("uses"))


def refitted(counted: DataFrame, lexicon: Lexicon) -> Lexicon:
    """The lexicon after one round of EM; costs are rounded, so that the order of sums does not show."""
    uses = {(r.kind, r.form): r.uses for r in expectations(counted, lexicon).collect()}
    kept = {form: x - DISCOUNT for (kind, form), x in uses.items() if kind == STEM and x > DISCOUNT}
    ends = {form: uses.get((ENDING, form), 0.0) + 0.5 for form in lexicon.endings}
    return Lexicon(costs(kept), costs(ends), lexicon.interjections)


def costs(uses: dict[str, float]) -> dict[str, float]:
    total = sum(uses.values())
    return {form: round(math.log(total / x), 6) for form, x in uses.items()}


def analyzed(text: Column, lexicon: Lexicon) -> Column:
    """All forms of a text in order: array of struct (form, kind); null and empty texts have none."""
    held: list[Analyzer] = []

    @F.pandas_udf("array<struct<form: string, kind: string>>")
    def of(values: pd.Series) -> pd.Series:
        if not held:
            held.append(Analyzer(lexicon))
        return values.map(lambda x: [{"form": form, "kind": kind} for word in plain(x) for form, kind in held[0].reading(word)])

    return of(text)


def content(lexicon: Lexicon):
    """A tokenizer for operators.wordfreq.tokens: the stems and interjections of a text, without endings."""
    return lambda text: F.transform(F.filter(analyzed(text, lexicon), lambda x: x["kind"] != ENDING), lambda x: x["form"])


def form_counts(texts: DataFrame, text: str, lexicon: Lexicon) -> DataFrame:
    """(kind, form, cnt) over all texts: stems (new ones too), interjections and endings; every distinct word is read once."""
    sent = texts.sparkSession.sparkContext.broadcast(lexicon)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Analyzer(sent.value)
        for frame in frames:
            rows = [(STEM if kind == UNKNOWN else kind, form, n) for word, n in zip(frame["word"], frame["n"], strict=True) for form, kind in own.likeliest(word)]
            yield pd.DataFrame(rows, columns=["kind", "form", "n"])

    return words(texts, text).mapInPandas(read, "kind string, form string, n long").groupBy("kind", "form").agg(F.sum("n").alias("cnt"))
