"""Document quality from a linear-chain conditional random field over lines.

Every line of a text is labelled good or bad. A line's features are binned measures of itself and of the lines before and
after it; a chain of two labels joins neighbours. The field is trained on documents whose lines all take the document's
label, by gradient ascent on the regularised likelihood. A document's quality is the mean of its lines' marginal
probabilities of good, from the forward-backward pass, weighted by the lines' lengths.
"""

from __future__ import annotations

from math import exp, log1p

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType

from turnlake.llm.shared import small_batches, staged

#: Labelled documents that a model is fitted on at most, and lines of all of them together: whole documents are taken by the
#: hash of their ids while the lines of those before them are fewer than this.
SAMPLE_DOCS, SAMPLE_LINES = 4000, 150_000
#: Steps at least and passes over the sample, lines of a batch, rate of the first step, weight of the ridge.
STEPS, PASSES, BATCH_LINES, RATE, RIDGE, SEED = 200, 20, 8192, 0.1, 2e-4, 5
THRESHOLD = 0.3
HELD_OUT_FOLDS = 5

#: Byte classes: 0 rest, 1 upper, 2 lower or beyond ASCII, 3 digit, 4 space, 5 sentence mark, 6 bar, 7 other mark.
_CLASS = np.zeros(256, np.int64)
_CLASS[128:] = 2
for _chars, _number in ((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"abcdefghijklmnopqrstuvwxyz", 2), (b"0123456789", 3), (b" \t\r\x0b\x0c", 4), (b".,;:?'\"()-", 5), (b"|", 6), (b"!#$%&*+/<=>@[\\]^_`{}~", 7)):
    _CLASS[list(_chars)] = _number

#: Upper edges of the bins of each measure.
EDGES = (
    ("upper", (0.02, 0.05, 0.1, 0.3, 0.6)),
    ("digit", (0.001, 0.02, 0.1, 0.3)),
    ("mark", (0.001, 0.01, 0.03, 0.1, 0.2)),
    ("sentence", (0.005, 0.015, 0.03, 0.06)),
    ("bar", (0.001, 0.02, 0.1)),
    ("space", (0.05, 0.1, 0.15, 0.2, 0.3)),
    ("words", (1, 3, 8, 20, 60)),
    ("word_length", (3, 4, 5, 6, 8, 12)),
    ("distinct", (0.1, 0.3, 0.5, 0.7, 0.9)),
    ("commonest", (0.05, 0.1, 0.2, 0.5)),
    ("shared", (0.05, 0.15, 0.3, 0.6, 0.95)),
    ("seen", (0.5,)),
)
N_BINS = max(len(x) for _, x in EDGES) + 1
N_MEASURES = len(EDGES)
N_WEIGHTS = 3 * N_MEASURES * N_BINS + 2 * N_MEASURES


def line_bins(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(bins, lengths): the bin of each measure of each line (lines x measures) and the lines' lengths in bytes, 1 at least."""
    data = (text or "").encode()
    lines = data.split(b"\n")
    n = np.array([len(x) for x in lines], np.int64)
    codes = _CLASS[np.frombuffer(data.replace(b"\n", b""), np.uint8)]
    counts = np.bincount(np.repeat(np.arange(len(lines)) * 8, n) + codes, minlength=8 * len(lines)).reshape(-1, 8)
    measures = np.zeros((len(lines), N_MEASURES))
    measures[:, :6] = counts[:, [1, 3, 7, 5, 6, 4]] / np.maximum(n, 1)[:, None]
    before: set = set()
    seen: set = set()
    for i, line in enumerate(lines):
        words = line.split()
        own = set(words)
        k = max(1, len(words))
        commonest = max(map(words.count, own)) if len(own) <= 8 and own else 0 if len(words) == len(own) else _commonest(words)
        measures[i, 6:] = len(words), n[i] / k, len(own) / k, commonest / k, len(own & before) / max(1, len(own)), line in seen
        before = own
        seen.add(line)
    bins = np.stack([np.searchsorted(np.array(edges), measures[:, j], side="left") for j, (_, edges) in enumerate(EDGES)], axis=1)
    return bins.astype(np.uint8), np.maximum(n, 1)


def _commonest(words: list) -> int:
    counts: dict = {}
    for x in words:
        counts[x] = counts.get(x, 0) + 1
    return max(counts.values())


def columns_of(bins: np.ndarray) -> np.ndarray:
    """Numbers of the weights that are on for each line: its own bins, those of the lines before and after, or the text's edge."""
    block = N_MEASURES * N_BINS
    own = np.arange(N_MEASURES) * N_BINS + bins.astype(np.int64)
    edge = 3 * block + np.arange(N_MEASURES)
    before = np.vstack([edge[None], own[:-1] + block])
    after = np.vstack([own[1:] + 2 * block, edge[None] + N_MEASURES])
    return np.hstack([own, before, after])


class Field:
    """Weights of the field: w scores a line's label good; stay[k] is gained where two neighbours are both bad (0) or both good (1)."""

    def __init__(self, w: np.ndarray, stay: np.ndarray, bias: float):
        self.w, self.stay, self.bias = w, stay, bias

    def marginals(self, bins: np.ndarray) -> np.ndarray:
        """Probability of good for each line by the forward-backward pass, on log odds."""
        score = (self.w[columns_of(bins)].sum(axis=1) + self.bias).tolist()
        n, bad, good = len(score), float(self.stay[0]), float(self.stay[1])

        def passed(x: float) -> float:
            """Log odds that a line hands to its neighbour."""
            return _log_add(0.0, x + good) - _log_add(bad, x)

        forward, backward = [0.0] * n, [0.0] * n
        for i in range(1, n):
            forward[i] = passed(forward[i - 1] + score[i - 1])
        for i in range(n - 2, -1, -1):
            backward[i] = passed(backward[i + 1] + score[i + 1])
        odds = np.array(forward) + np.array(backward) + np.array(score)
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))

    def quality(self, text: str | None) -> float:
        bins, lengths = line_bins(text)
        return float(np.average(self.marginals(bins), weights=lengths))


def _log_add(a: float, b: float) -> float:
    high, low = (a, b) if a > b else (b, a)
    return high + log1p(exp(low - high)) if high - low < 40 else high


def _passed(steps: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Products of the 2 x 2 matrices of each chain up to each line, each scaled to a greatest entry of 1, by doubling.

    steps has one matrix for each line, the unit matrix where a chain starts; the chains lie one after the other.
    """
    done, reach, n = steps, 1, len(steps)
    place = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
    longest = int(place.max()) + 1 if n else 0
    while reach < longest:
        at = np.nonzero(place >= reach)[0]
        left, right = done[at - reach], done[at]
        product = left[:, :, :1] * right[:, :1, :] + left[:, :, 1:] * right[:, 1:, :]
        done = done.copy()
        done[at] = product / product.max(axis=(1, 2), keepdims=True)
        reach *= 2
    return done


def _gradient(theta: np.ndarray, columns: np.ndarray, sizes: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Gradient of the mean log-likelihood of chains of labels, the chains one after the other.

    Forward and backward messages are products of 2 x 2 matrices, made by doubling, so chains of any length take few steps.
    """
    w, bias, stay = theta[:N_WEIGHTS], theta[N_WEIGHTS], theta[N_WEIGHTS + 1 :]
    starts, n = np.concatenate([[0], np.cumsum(sizes)[:-1]]), len(columns)
    ends, y = np.append(starts[1:], n) - 1, np.repeat(labels, sizes)
    inner = np.ones(n, bool)
    inner[starts] = False
    at = np.nonzero(inner)[0]
    score = w[columns].sum(axis=1) + bias
    high = np.maximum(score, 0)
    node = np.stack([np.exp(-high), np.exp(score - high)], axis=1)
    pot = np.ones((2, 2))
    pot[0, 0], pot[1, 1] = np.exp(stay)
    steps = pot[None] * node[:, None, :]
    steps[starts] = np.eye(2)
    first = np.repeat(node[starts], sizes, axis=0)
    alpha = (first[:, :, None] * _passed(steps, starts)).sum(axis=1)
    back = np.broadcast_to(np.eye(2), (n, 2, 2)).copy()
    back[at - 1] = np.swapaxes(pot[None] * node[at][:, None, :], 1, 2)
    beta = _passed(back[::-1], n - 1 - ends[::-1])[::-1].sum(axis=1)
    both = alpha * beta
    pairs = alpha[at - 1][:, :, None] * pot[None] * (node[at] * beta[at])[:, None, :]
    pairs /= pairs.sum(axis=(1, 2), keepdims=True)
    diff = y - both[:, 1] / both.sum(axis=1)
    grad = np.zeros_like(theta)
    grad[:N_WEIGHTS] = np.bincount(columns.ravel(), weights=np.repeat(diff, columns.shape[1]), minlength=N_WEIGHTS)
    grad[N_WEIGHTS] = diff.sum()
    grad[N_WEIGHTS + 1] = ((1 - y[at]) - pairs[:, 0, 0]).sum()
    grad[N_WEIGHTS + 2] = (y[at] - pairs[:, 1, 1]).sum()
    return grad / n


def fit(documents: list[tuple[np.ndarray, int]]) -> Field:
    """Fit a field to (bins, label) of documents, every line labelled as its document; without both labels the weights stay zero.

    Adam on batches of whole chains of about BATCH_LINES lines, in an order that is the same in each run, with a falling rate.
    """
    field = Field(np.zeros(N_WEIGHTS), np.zeros(2), 0.0)
    if len({y for _, y in documents}) < 2:
        field.bias = {0: -4.0, 1: 4.0}[documents[0][1]] if documents else 0.0
        return field
    order = np.random.default_rng(SEED).permutation(len(documents))
    sizes = np.array([len(documents[i][0]) for i in order])
    batch_of = (np.cumsum(sizes) - sizes) // BATCH_LINES
    batches = []
    for number in np.unique(batch_of):
        own = [documents[i] for i in order[batch_of == number]]
        batches.append((np.concatenate([columns_of(b).astype(np.int16) for b, _ in own]), np.array([len(b) for b, _ in own]), np.array([y for _, y in own], float)))
    theta, m, v = np.zeros(N_WEIGHTS + 3), np.zeros(N_WEIGHTS + 3), np.zeros(N_WEIGHTS + 3)
    total = max(STEPS, PASSES * len(batches))
    for step in range(1, total + 1):
        grad = _gradient(theta, *batches[step % len(batches)]) - RIDGE * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        rate = RATE * (1 - (step - 1) / total)
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field(theta[:N_WEIGHTS], theta[N_WEIGHTS + 1 :], float(theta[N_WEIGHTS]))


@F.pandas_udf(BinaryType())
def _sample_bins(texts: pd.Series) -> pd.Series:
    return pd.Series([line_bins(x)[0].tobytes() for x in texts], dtype=object)


def held_out(id_col: str):
    """Whether an id is in the fold that no model sees: crc32 of its decimal text, modulo the folds, is 0. Null ids are not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % HELD_OUT_FOLDS == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_lines: int = SAMPLE_LINES) -> Field:
    """Fit a field on at most sample_docs labelled documents outside the held-out fold, whole ones, of about sample_lines lines in all.

    labels (doc_id, quality): rows with a null id or a quality other than 0 and 1 are left out; of a document's several
    labels each distinct one counts. The sample is the ids with the least hash, so it is the same in each run; the last
    one taken may pass sample_lines.
    """
    small_batches(docs.sparkSession)
    usable = labels.select("doc_id", F.col("quality").cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    chosen = usable.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample_docs)
    lines = F.coalesce(F.regexp_count("text", F.lit("\n")), F.lit(0)) + 1
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text", lines.alias("lines"))
    order = Window.orderBy(F.xxhash64("doc_id"), "doc_id", "y", "lines").rowsBetween(Window.unboundedPreceding, -1)  # over at most sample_docs ids
    taken = staged(found.select("doc_id", "y", "lines", F.coalesce(F.sum("lines").over(order), F.lit(0)).alias("before")).where(F.col("before") < sample_lines).select("doc_id", "y").distinct())
    rows = docs.select("doc_id", "text").join(F.broadcast(taken), "doc_id").select("doc_id", "y", _sample_bins("text").alias("bins"))
    sample = rows.toPandas().sort_values(["doc_id", "y", "bins"])
    return fit([(np.frombuffer(b, np.uint8).reshape(-1, N_MEASURES), int(y)) for b, y in zip(sample["bins"], sample["y"], strict=True)])


def score(docs: DataFrame, field: Field, text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with a column of that name, the quality of each whole text (0 to 1); null and empty texts are one empty line."""

    small_batches(docs.sparkSession)

    @F.pandas_udf(DoubleType())
    def quality(texts: pd.Series) -> pd.Series:
        return pd.Series([field.quality(x) for x in texts], dtype="float64")

    return docs.withColumn(name, quality(F.col(text_col)))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row (doc_id, held_out, score, predicted) for each row of docs.

    Only the text is an input of the score. Null and empty texts get the score of one empty line; null ids are kept and not
    held out; repeated rows get equal rows; an empty table gives an empty one; without labels of both kinds every score is
    the same. Other columns of docs are not read, so their names cannot clash.
    """
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op3_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
