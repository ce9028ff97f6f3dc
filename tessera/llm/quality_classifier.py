"""Quality classifier: a linear-chain conditional random field over a text's lines.

Every line with a word has features of its own and of its neighbours; the field labels lines good or bad, and the
document's quality is the mean of the lines' marginals of `good`, weighted by their length, brought to a probability
by a logistic curve. The field is trained here, on a bounded sample of labelled documents whose lines all take their
document's label; nothing of the other fold, nor language, source or id, enters a feature.

Training gathers the sample's features, whose number `sample` bounds, on the driver. Scoring is one pass over the
texts without a shuffle.

Defined results: null and empty texts, and texts without a word, have no lines and the score NO_LINES. Repeated rows
stay, each with its score. A null doc_id counts as not held out. Where labels of both kinds do not meet texts, every line is good.
Very long texts are read whole, in time that grows with their length. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import table
from tessera.llm.quality_rules import _CLASS, _OTHER_SCRIPT, _SPACE, _SYMBOL, _Words

SAMPLE = 3000
#: Lines of these documents, over which no further one is taken, and of which the last one gives no more.
SAMPLE_LINES = 400_000
THRESHOLD = 0.3
NO_LINES = 0.0
FOLDS = 5
#: Lines of a document in one training sequence; a longer document is several.
CHUNK = 64

_CLASS_OF = np.minimum(_CLASS, _OTHER_SCRIPT - 1)  # letters of all scripts are one class here
_SHARES = 7  # classes 2 to 8
_OWN = _SHARES + 12
#: Features of a line: its own, and with the text's edge those of its neighbours.
WIDTH = _OWN + 2 * (_OWN + 1)


def line_features(text: bytes, known: _Words) -> tuple[np.ndarray, np.ndarray]:
    """Features of each line that has a word, neighbours' included, and the lines' lengths in bytes."""
    lines = [line for line in text.split(b"\n") if line.strip(b" \t\r\v\f")]
    own = np.empty((len(lines), _OWN))
    seen: set[bytes] = set()
    for k, line in enumerate(lines):
        words = line.split()
        classes = np.bincount(_CLASS_OF[np.frombuffer(line, np.uint8)], minlength=_OTHER_SCRIPT)
        chars = max(1, int(classes[2:].sum()))
        n = len(words)
        distinct = len(set(words)) / n
        common = sum(1 for w in words if known[w][0]) / n
        x = own[k]
        x[:_SHARES] = classes[2:] / chars
        symbol, upper, punct = x[_SYMBOL - 2], x[1], x[3]
        size = math.log1p(n)
        x[_SHARES:] = (distinct, common, size, min(chars / n, 40) / 10, line in seen, line.rstrip()[-1:] in (b".", b"!", b"?"), symbol > 0.02, upper > 0.5, punct > 0.12, distinct < 0.5, (1 - distinct) * size, (common < 0.12) * size)
        seen.add(line)
    lens = np.fromiter(map(len, lines), np.float64, len(lines))
    around = np.zeros((len(lines) + 2, own.shape[1] + 1))
    around[1:-1, :-1] = own
    around[[0, -1], -1] = 1  # the text's edge
    return np.hstack([own, around[:-2], around[2:]]), lens


@dataclass
class Field:
    """The trained field: features are shifted and scaled, then weighted; moves[i, j] is the score of label j after i."""

    shift: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    moves: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def marginals(self, features: np.ndarray) -> np.ndarray:
        """P(good) of each line, by forward and backward messages as log odds of good against bad."""
        own = ((features - self.shift) / self.scale @ self.weights + self.bias).tolist()
        bb, bg, gb, gg = map(math.exp, self.moves.ravel().tolist())
        forward, x = [], 0.0
        for k, e in enumerate(own):
            if k:
                o = math.exp(max(-40.0, min(40.0, x)))
                x = math.log((gg * o + bg) / (gb * o + bb))
            x += e
            forward.append(x)
        out, x = [0.0] * len(own), 0.0
        for k in range(len(own) - 1, -1, -1):
            out[k] = 1 / (1 + math.exp(-max(-40.0, min(40.0, forward[k] + x))))
            o = math.exp(max(-40.0, min(40.0, own[k] + x)))
            x = math.log((gg * o + gb) / (bg * o + bb))
        return np.array(out)

    def raw(self, features: np.ndarray, lens: np.ndarray) -> float:
        """Log odds of the lines' mean marginal."""
        mean = float(np.average(self.marginals(features), weights=lens))
        mean = min(max(mean, 1e-6), 1 - 1e-6)
        return math.log(mean / (1 - mean))

    def score(self, features: np.ndarray, lens: np.ndarray) -> float:
        if not len(lens):
            return NO_LINES
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, self.slope * self.raw(features, lens) + self.offset))))


def _by_line(chunks: list[tuple[np.ndarray, int]]) -> tuple[list[np.ndarray], np.ndarray]:
    """Of sequences with one label each, the longest first: the features of all that have a line t, for each t; and the labels."""
    chunks = sorted(chunks, key=lambda c: -len(c[0]))
    live = [sum(len(x) > t for x, _ in chunks) for t in range(len(chunks[0][0]))]
    return [np.stack([x[t] for x, _ in chunks[:n]]) for t, n in enumerate(live)], np.array([y for _, y in chunks])


def _forward(own: list[np.ndarray], moves: np.ndarray) -> list[np.ndarray]:
    """Log odds of good against bad of each line, by what stands up to it."""
    forward: list[np.ndarray] = []
    for t, e in enumerate(own):
        x = e.copy()
        if t:
            o = np.exp(np.clip(forward[-1][: len(e)], -40, 40))
            x += np.log((moves[1, 1] * o + moves[0, 1]) / (moves[1, 0] * o + moves[0, 0]))
        forward.append(x)
    return forward


def _gradient(lines: list[np.ndarray], y: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """The gradient of the labels' log likelihood: what is marked less what is expected, of features, bias and moves."""
    width = len(theta) - 5
    w, b, moves = theta[:width], theta[width], np.exp(theta[-4:].reshape(2, 2))
    own = [np.clip(x @ w + b, -40, 40) for x in lines]
    forward = _forward(own, moves)
    grad = np.zeros_like(theta)
    back = np.zeros(0)
    for t in range(len(lines) - 1, -1, -1):
        n = len(lines[t])
        x = np.zeros(n)
        if len(back):
            k = len(back)
            o = np.exp(np.clip(back, -40, 40))  # of line t + 1, with its own score
            x[:k] = np.log((moves[1, 1] * o + moves[1, 0]) / (moves[0, 1] * o + moves[0, 0]))
            f = np.exp(np.clip(forward[t][:k], -40, 40))
            joint = np.stack([moves[0, 0] + 0 * o, moves[0, 1] * o, moves[1, 0] * f, moves[1, 1] * f * o], 1)
            joint /= joint.sum(1, keepdims=True)
            real = np.zeros_like(joint)
            real[np.arange(k), 3 * y[:k]] = 1
            grad[-4:] += (real - joint).sum(0)
        d = y[:n] - 1 / (1 + np.exp(-np.clip(forward[t] + x, -40, 40)))
        grad[:width] += d @ lines[t]
        grad[width] += d.sum()
        back = own[t] + x
    return grad


def gradient(chunks: list[tuple[np.ndarray, int]], theta: np.ndarray) -> np.ndarray:
    return _gradient(*_by_line(chunks), theta)


def log_likelihood(chunks: list[tuple[np.ndarray, int]], theta: np.ndarray) -> float:
    """Of sequences whose lines all have one label; theta: weights, bias, and the four moves."""
    width, total = len(theta) - 5, 0.0
    moves = theta[-4:].reshape(2, 2)
    for x, y in chunks:
        own = x @ theta[:width] + theta[width]
        alpha = np.array([0.0, own[0]])
        for e in own[1:]:
            alpha = np.logaddexp(alpha[0] + moves[0], alpha[1] + moves[1]) + np.array([0.0, e])
        total += y * own.sum() + (len(x) - 1) * moves[y, y] - np.logaddexp(*alpha)
    return total


def train(texts: list[tuple[np.ndarray, np.ndarray]], labels: list[int], steps: int = 150, rate: float = 0.1, ridge: float = 1e-3) -> Field:
    """A field from documents' features and labels, by gradient steps (Adam) on the labels' log likelihood."""
    pairs = [(x, n, y) for (x, n), y in zip(texts, labels, strict=True) if len(n)]
    width = WIDTH if not pairs else pairs[0][0].shape[1]
    if len({y for *_, y in pairs}) < 2:
        return Field(np.zeros(width), np.ones(width), np.zeros(width), 40.0, np.zeros((2, 2)))
    every = np.concatenate([x for x, *_ in pairs])
    shift, scale = every.mean(0), every.std(0) + 1e-6
    chunks = [((x[k : k + CHUNK] - shift) / scale, y) for x, _, y in pairs for k in range(0, len(x), CHUNK)]
    lines = _by_line(chunks)
    total = sum(len(x) for x, _ in chunks)
    theta = np.zeros(width + 1 + 4)
    theta[-4:] = (0.5, -0.5, -0.5, 0.5)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        grad = _gradient(*lines, theta) / total - ridge * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    field = Field(shift, scale, theta[:width], float(theta[width]), theta[-4:].reshape(2, 2))
    raw = np.array([field.raw(x, n) for x, n, _ in pairs])
    field.slope, field.offset = _logistic(raw, np.array([y for *_, y in pairs]))
    return field


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 30) -> tuple[float, float]:
    """Slope and offset of P(y) over x, by Newton steps with a small ridge."""
    a = np.stack([x, np.ones_like(x)], 1)
    t = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ t, -40, 40)))
        g = a.T @ (y - p) - 1e-2 * t
        h = (a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2)
        t = t + np.clip(np.linalg.solve(h, g), -2, 2)
    return float(t[0]), float(t[1])


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == 0, F.lit(False))


def train_on(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, lines: int = SAMPLE_LINES) -> Field:
    """The field from at most `sample` labelled documents outside the held-out fold, and `lines` lines, picked by a hash of their id. Of equal ids one text counts.

    Documents are taken in order until they reach the lines, so there is always one if any is labelled.
    """
    chosen = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    chosen = chosen.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    picked = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"), F.size(F.split(F.coalesce("text", F.lit("")), "\n")).alias("__lines")).join(F.broadcast(chosen), "doc_id")
    one = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))  # its limit of one row comes before the shuffle too
    picked = picked.withColumn("__one", F.row_number().over(one)).filter("__one = 1")
    before = F.sum("__lines").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id")) - F.col("__lines")  # of `sample` rows
    picked = picked.withColumn("__left", lines - before).filter("__left > 0").select("doc_id", "text", "quality", "__left")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for batch in batches:
            rows = [tuple(x[:most] for x in line_features(t.as_py(), known)) for t, most in zip(batch.column("text"), batch.column("__left").to_pylist(), strict=True)]
            yield pa.record_batch([batch.column("doc_id").cast(pa.string()), batch.column("quality"), pa.array([x.astype(np.float32).tobytes() for x, _ in rows], pa.binary()), pa.array([n.tobytes() for _, n in rows], pa.binary())], ["doc_id", "quality", "x", "n"])

    rows = sorted(picked.mapInArrow(features, "doc_id string, quality int, x binary, n binary").collect(), key=lambda r: (r.doc_id, r.x))
    lens = [np.frombuffer(r.n) for r in rows]
    texts = [(np.frombuffer(r.x, np.float32).reshape(len(n), -1).astype(float), n) for r, n in zip(rows, lens, strict=True) if len(n)]
    return train(texts, [r.quality for r, n in zip(rows, lens, strict=True) if len(n)])


def with_scores(docs: DataFrame, field: Field, name: str = "score") -> DataFrame:
    """docs with one more column, the score."""
    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = _Words()
        for batch in texts:
            yield pd.Series([field.score(*line_features(t or b"", known)) for t in batch], dtype="float64")

    return docs.withColumn(name, F.round(score(F.coalesce("text", F.lit("")).cast("binary")), 6))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """The documents that score at least the threshold, as they are."""
    return with_scores(docs, train_on(docs, labels, sample), "__score").filter(F.col("__score") >= threshold).drop("__score")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    field = train_on(docs, table(spark, sf_dir, "labels"))
    scored = with_scores(docs, field)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op6_quality_classifier": op6_quality_classifier}
ORACLES: dict[str, str] = {}
