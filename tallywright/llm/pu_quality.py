"""Quality classifier learned from trusted positives and unlabelled web text.

The network (one hidden layer) minimises the non-negative unbiased risk of positive-unlabelled learning: with class
prior p and logistic loss, p * loss(positives as 1) + max(0, loss(unlabelled as 0) - p * loss(positives as 0)); when the
part in the maximum falls below 0 the step goes uphill on it. The prior is estimated before: for a first
classifier that tells positives from unlabelled texts, the share of unlabelled scores above a bar, divided by the share
of positive scores above it, is never below the prior, and equal to it where no negatives score; its least value over
the bars that half of the positives reach is taken.

Features come from the whole text: lengths, shares of character classes, of repeated words, neighbours and lines.
The fit uses at most `most` positives and `most` unlabelled texts in expectation, picked by a hash of
the key, in the order of their features; nobody else's labels are read.

Null and empty texts are scored like any other, from features that are all 0. Labels other than 1 count as no label. A
document with several labels is positive if one of them is 1. Without positives or without unlabelled texts every score
is 0.5. Every row has one result, repeated rows and rows with a null key too; an empty table gives an empty result;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.llm import textkit

#: Character classes, each counted as a share of the text's bytes.
CLASSES = {
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "stop": b".!?",
    "comma": b",;:",
    "quote": b"'\"()",
    "bar": b"|",
    "symbol": b"#*$%&<>@^~_=+/\\{}[]",
    "space": b" \t",
    "line": b"\n",
}
CLASS = np.full(256, len(CLASSES), np.int64)
for _i, _chars in enumerate(CLASSES.values()):
    CLASS[list(_chars)] = _i
WIDTH = len(CLASSES) + 1 + 9


def features(column: pa.Array) -> np.ndarray:
    data, at = textkit.flat(column)
    out = np.zeros((len(at) - 1, WIDTH), np.float32)
    for i, j in textkit.steps(at):
        part, rel, n = data[at[i] : at[j]], at[i : j + 1] - at[i], j - i
        size = np.diff(rel)
        doc = np.repeat(np.arange(n), size)
        one = np.maximum(1, size)[:, None]
        kinds = np.bincount(doc * (len(CLASSES) + 1) + CLASS[part], minlength=n * (len(CLASSES) + 1)).reshape(n, -1) / one
        first, last, owner = textkit.word_spans(part, rel)
        hashes = textkit.span_hashes(part, first, last)
        words = np.bincount(owner, minlength=n)
        many = np.maximum(1, words)
        key = np.sort((owner << 40) | (hashes >> np.uint64(24)).astype(np.int64))
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        distinct = np.bincount(key[new] >> 40, minlength=n)
        same = np.zeros(len(hashes), bool)
        same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
        third = np.zeros(len(hashes), bool)
        third[3:] = (hashes[3:] == hashes[:-3]) & (owner[3:] == owner[:-3])
        letters = np.bincount(owner, weights=last - first, minlength=n)
        odd = np.isin(CLASS[part[np.maximum(last, 1) - 1]], [6, 7]) if len(last) else np.zeros(0, bool)
        breaks = np.flatnonzero(part == 10)
        edges = np.unique(np.concatenate((rel[:-1][size > 0], breaks + 1)))
        edges = edges[edges < len(part)]
        ends = np.concatenate((edges[1:], [len(part)])) if len(edges) else edges
        line_of = np.searchsorted(rel, edges, "right") - 1
        line_key = np.sort((line_of << 40) | (textkit.span_hashes(part, edges, ends) >> np.uint64(24)).astype(np.int64)) if len(edges) else edges
        line_new = np.ones(len(line_key), bool)
        line_new[1:] = line_key[1:] != line_key[:-1]
        lines = np.maximum(1, np.bincount(line_of, minlength=n))
        different = np.bincount(line_key[line_new] >> 40, minlength=n) if len(edges) else np.zeros(n)
        shape = np.stack(
            [
                np.log1p(words) / 5, letters / many / 10, np.where(words > 0, distinct / many, 0), np.where(words > 0, distinct / np.sqrt(many) / 5, 0),
                np.bincount(owner, weights=same, minlength=n) / many, np.bincount(owner, weights=third, minlength=n) / many,
                np.bincount(owner, weights=odd, minlength=n) / many, np.where(size > 0, different / lines, 0), np.log1p(words / lines) / 4,
            ],
            axis=1,
        )
        out[i:j] = np.concatenate((kinds, shape), axis=1)
    return out


class Network:
    """One hidden layer of tanh units; `score` is the probability of class 1."""

    def __init__(self, width: int, hidden: int, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(width), np.ones(width)
        self.weights = [rng.normal(0, 1 / np.sqrt(width), (width, hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
        self.moments = [[np.zeros_like(w), np.zeros_like(w)] for w in self.weights]
        self.step = 0

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w1, b1, w2, b2 = self.weights
        hidden = np.tanh(x @ w1 + b1)
        return hidden, hidden @ w2 + b2[0]

    def descend(self, x: np.ndarray, slope: np.ndarray, rate: float, decay: float) -> None:
        """One Adam step along the slope of the loss by each row's output."""
        w1, _, w2, _ = self.weights
        hidden, _ = self.forward(x)
        back = slope[:, None] * w2 * (1 - hidden**2)
        gradients = [x.T @ back + decay * w1, back.sum(axis=0), hidden.T @ slope + decay * w2, np.array([slope.sum()])]
        self.step += 1
        for w, (m, v), g in zip(self.weights, self.moments, gradients, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= rate * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.999**self.step)) + 1e-8)

    def standardise(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.forward(self.standardise(x.astype(np.float64)))[1])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(z / 2))


def loss(z: np.ndarray) -> np.ndarray:
    """Logistic loss of an output for class 1."""
    return np.logaddexp(0, -z)


def batches(positive: np.ndarray, unlabelled: np.ndarray, steps: int, size: int, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    rng = np.random.default_rng(seed)
    for _ in range(steps):
        yield positive[rng.integers(0, len(positive), size)], unlabelled[rng.integers(0, len(unlabelled), size)]


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Least ratio of the two shares above a bar that at least half of the positives reach, with a standard error."""
    least = 1.0
    for bar in np.quantile(positive, np.linspace(0, 0.5, 51)):
        p, u = (positive >= bar).mean(), (unlabelled >= bar).mean()
        least = min(least, (u + np.sqrt(u * (1 - u) / len(unlabelled))) / p)
    return float(np.clip(least, 0.05, 0.99))


def contrasted(x: np.ndarray, u: np.ndarray, hidden: int, steps: int, size: int, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Outputs of classifiers of positives against unlabelled texts, each on the half of the rows it hasn't seen."""
    of_x, of_u = np.zeros(len(x)), np.zeros(len(u))
    for half in (0, 1):
        net = Network(x.shape[1], hidden, 1 + half)
        for a, b in batches(x[half::2], u[half::2], steps, size, 2):
            slope = np.concatenate((-sigmoid(-net.forward(a)[1]), sigmoid(net.forward(b)[1]))) / (2 * size)
            net.descend(np.concatenate((a, b)), slope, rate, 1e-2)
        of_x[1 - half :: 2], of_u[1 - half :: 2] = net.forward(x[1 - half :: 2])[1], net.forward(u[1 - half :: 2])[1]
    return of_x, of_u


def train(positive: np.ndarray, unlabelled: np.ndarray, hidden: int = 16, steps: int = 3000, size: int = 256, rate: float = 1e-2) -> tuple[Network, float]:
    x, u = positive.astype(np.float64), unlabelled.astype(np.float64)
    both = np.concatenate((x, u))
    mean, scale = both.mean(axis=0), both.std(axis=0) + 1e-3
    x, u = (x - mean) / scale, (u - mean) / scale
    prior = class_prior(*contrasted(x, u, hidden, steps // 4, size, rate)) if min(len(x), len(u)) > 1 else 0.5
    net = Network(x.shape[1], hidden, 3)
    net.mean, net.scale = mean, scale
    for a, b in batches(x, u, steps, size, 4):
        za, zb = net.forward(a)[1], net.forward(b)[1]
        negative = loss(-zb).mean() - prior * loss(-za).mean()
        slope_a, slope_b = prior * -sigmoid(-za) / size, np.zeros(size)
        part_a, part_b = -prior * sigmoid(za) / size, sigmoid(zb) / size
        if negative >= 0:
            slope_a, slope_b = slope_a + part_a, part_b
        else:
            slope_a, slope_b = -part_a, -part_b
        net.descend(np.concatenate((a, b)), np.concatenate((slope_a, slope_b)), rate, 1e-4)
    return net, prior


def fit(docs: DataFrame, labels: DataFrame, training: Column, key: str = "doc_id", text: str = "text", label: str = "quality", most: int = 6000) -> Network | None:
    """labels: key and label; training: which rows' labels may be read."""
    textkit.bounded_batches(docs.sparkSession)
    trusted = labels.where(F.col(label) == 1).select(F.col(key).alias("id")).distinct()
    rows = docs.where(training).select(F.col(key).alias("id"), F.col(text).alias("text"))
    marked = rows.select("id").join(trusted.withColumn("trusted", F.lit(True)), "id", "left")
    share = marked.agg(F.count("*").alias("n"), F.count("trusted").alias("p")).first()
    n, p = int(share["n"]), int(share["p"])
    if not p or p == n:
        return None
    # keys are drawn first, so that only drawn texts are moved to meet their label
    draw = F.xxhash64("id").bitwiseAND(0x7FFFFFFF) / float(1 << 31) < F.when(F.col("trusted"), F.lit(min(1.0, most / p))).otherwise(F.lit(min(1.0, most / (n - p))))
    keys = marked.where(draw).distinct()

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            x = pa.array([r.tobytes() for r in features(batch.column(1))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), x], names=["trusted", "x"])

    drawn = rows.where(F.xxhash64("id").bitwiseAND(0x7FFFFFFF) / float(1 << 31) < F.lit(min(1.0, max(most / p, most / (n - p)))))
    got = drawn.join(F.broadcast(keys), "id").select(F.coalesce("trusted", F.lit(False)).alias("trusted"), "text").mapInArrow(run, "trusted boolean, x binary").collect()
    # in the order of their bytes: training draws by position, which no partitioning may decide
    x = {flag: [np.frombuffer(b, np.float32) for b in sorted(bytes(r["x"]) for r in got if r["trusted"] is flag)] for flag in (True, False)}
    if not x[True] or not x[False]:
        return None
    return train(np.stack(x[True]), np.stack(x[False]))[0]


def judged(column: pa.Array, net: Network | None) -> np.ndarray:
    return net.score(features(column)) if net else np.full(len(column), 0.5)


def score(docs: DataFrame, net: Network | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score: probability that the text is of good quality; one row per row of docs."""
    textkit.bounded_batches(docs.sparkSession)

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(judged(batch.column(1), net).astype(np.float64))], names=["id", "score"])

    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", key)


def keep_good(docs: DataFrame, net: Network | None, least: float = 0.3, text: str = "text") -> DataFrame:
    """The rows of docs that score at least `least`."""
    textkit.bounded_batches(docs.sparkSession)

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            yield batch.filter(pa.array(judged(batch.column(text), net) >= least, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
