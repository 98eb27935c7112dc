"""Quality classifier by positive-unlabelled learning.

Only trusted good texts and unlabelled web text are given. With the share of
good texts in the web (the class prior) the risk of a classifier follows from
these two alone; its part for bad texts is kept from going below zero (the
non-negative estimator), so that a flexible model doesn't fit the unlabelled
texts away. The prior is estimated by the best bin: half of the good and of the
web texts are held back, and the share of those web texts above a score, over
the share of those good texts above it, bounds the prior at every score.

Training sees at most POSITIVES and UNLABELLED texts, those with the least
hashed ids; only their features come to the driver. Scores use the whole text
and nothing else. Scoring is one pass without a shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermoband.llm.common import slices

POSITIVES, UNLABELLED = 8_000, 16_000
#: Standard errors by which a bin has to be better to be the best.
SLACK = 1.0
HIDDEN, BATCH, EPOCHS, RATE, DECAY = 32, 1024, 30, 3e-3, 1e-4

LOWER_, UPPER, DIGIT, SPACE, LINE, POINT, SIGN, HIGH = range(8)
POINTS = b".,;:'\"-?()"


def _class(byte: int) -> int:
    letter = bytes([byte])
    if byte >= 0x80:
        return HIGH
    if letter.islower():
        return LOWER_
    if letter.isupper():
        return UPPER
    if letter.isdigit():
        return DIGIT
    if letter == b"\n":
        return LINE
    if letter.isspace():
        return SPACE
    return POINT if letter in POINTS else SIGN


CLASSES = np.array([_class(b) for b in range(256)], np.uint8)


def features(text: str | None) -> np.ndarray:
    """64 rates of steps between classes of bytes, and 9 numbers on length, variety and repeats of words and lines."""
    content = (text or "").encode()
    kinds = CLASSES[np.frombuffer(content, np.uint8)]
    steps = np.zeros(64)
    for at in range(0, max(0, len(kinds) - 1), 1 << 20):  # long texts in pieces
        some = kinds[at : at + (1 << 20) + 1]
        steps += np.bincount(some[:-1] * np.uint8(8) + some[1:], minlength=64)
    words = content.split()
    n, counts = max(1, len(words)), Counter(words)
    lines = [x for x in content.split(b"\n") if x.strip()]
    rest = [
        np.log1p(len(content)) / 10,
        np.log1p(len(words)) / 10,
        len(content) / n / 20,
        len(counts) / n,
        max(counts.values(), default=0) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        len(lines) / n,
        np.sqrt(n) / (len(counts) + 1),
    ]
    return np.concatenate([np.sqrt(steps / max(1, len(content))), rest])


WIDTH = 73


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Network:
    """One hidden layer, trained on the non-negative positive-unlabelled risk with the logistic loss."""

    def __init__(self, positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = 0) -> None:
        random = np.random.default_rng(seed)
        self.weights = [
            random.normal(0, np.sqrt(2 / WIDTH), (WIDTH, HIDDEN)), np.zeros(HIDDEN),
            random.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(1),
        ]
        mean, square = ([np.zeros_like(w) for w in self.weights] for _ in range(2))
        step = 0
        for _ in range(EPOCHS):
            order = random.permutation(len(unlabelled))
            for at in range(0, len(order), BATCH):
                u = unlabelled[order[at : at + BATCH]]
                p = positive[random.integers(0, len(positive), BATCH)]
                step += 1
                for w, g, m, s in zip(self.weights, self._gradient(p, u, prior), mean, square, strict=True):
                    m += 0.1 * (g - m)
                    s += 0.001 * (g * g - s)
                    w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)

    def _gradient(self, p: np.ndarray, u: np.ndarray, prior: float) -> list[np.ndarray]:
        x = np.concatenate([p, u])
        hidden = np.maximum(x @ self.weights[0] + self.weights[1], 0)
        z = hidden @ self.weights[2] + self.weights[3][0]
        score, n = _sigmoid(z), len(p)
        bad_risk = np.logaddexp(0, z[n:]).mean() - prior * np.logaddexp(0, z[:n]).mean()
        bad = np.concatenate([-prior * score[:n] / n, score[n:] / len(u)])
        good = np.concatenate([prior * (score[:n] - 1) / n, np.zeros(len(u))])
        d = good + bad if bad_risk >= 0 else -bad  # below zero: take the step back
        back = np.outer(d, self.weights[2]) * (hidden > 0)
        return [
            x.T @ back + DECAY * self.weights[0], back.sum(0),
            hidden.T @ d + DECAY * self.weights[2], np.array([d.sum()]),
        ]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.weights[0] + self.weights[1], 0) @ self.weights[2] + self.weights[3][0]


def best_bin(held_back: np.ndarray, unlabelled: np.ndarray) -> float:
    """The ratio of the shares above a score, at the score where the ratio with SLACK standard errors is least."""
    best = (np.inf, 1.0)
    for cut in np.quantile(held_back, np.linspace(0.01, 0.9, 90)):
        good, web = (held_back >= cut).mean(), max((unlabelled >= cut).mean(), 1 / len(unlabelled))
        ratio = web / good
        error = ratio * np.sqrt((1 - good) / (good * len(held_back)) + (1 - web) / (web * len(unlabelled)))
        best = min(best, (ratio + SLACK * error, ratio))
    return float(min(1.0, best[1]))


def _halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (x[::2], x[1::2]) if len(x) > 1 else (x, x)


class Model:
    """Scores of texts: the scale of the features, the network and the estimated prior. Small enough to be sent with a task."""

    def __init__(self, positive: np.ndarray, unlabelled: np.ndarray) -> None:
        every = np.concatenate([positive, unlabelled])
        self.mean, self.spread = every.mean(0), every.std(0) + 1e-6
        positive, unlabelled = self.scale(positive), self.scale(unlabelled)
        fitted, held_back = _halves(positive)
        seen, unseen = _halves(unlabelled)
        self.prior = 0.5
        for _ in range(2):
            trial = Network(fitted, seen, self.prior)
            self.prior = best_bin(trial(held_back), trial(unseen))
        self.network = Network(positive, unlabelled, self.prior)

    def scale(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -5, 5)

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        return _sigmoid(self.network(self.scale(np.array([features(t) for t in texts]).reshape(-1, WIDTH))))


def held_out(doc_id: Column) -> Column:
    """Rows whose label is never learnt from: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _sampled_features(docs: DataFrame, ids: DataFrame, bound: int) -> np.ndarray:
    """Features of the texts of at most `bound` ids, those with the least hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches):
            x = np.array([features(t) for t in rows.column(0).to_pylist()], "<f8").reshape(-1, WIDTH)
            yield pa.RecordBatch.from_arrays([rows.column(1), pa.array([v.tobytes() for v in x], pa.binary())], ["doc_id", "x"])

    chosen = ids.distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    rows = docs.select("text", F.col("doc_id").cast("bigint").alias("doc_id"))
    # repeated rows of an id count once
    found = rows.join(F.broadcast(chosen), "doc_id", "left_semi").select("text", "doc_id").mapInArrow(run, "doc_id bigint, x binary")
    kept = found.groupBy("doc_id").agg(F.min("x").alias("x")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    return np.array([np.frombuffer(r.x) for r in kept]).reshape(-1, WIDTH)


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model | None:
    """Learn from rows that aren't held out; None if there is nothing to learn from."""
    own = F.col("doc_id").cast("bigint").alias("doc_id")
    open_ = docs.select(own).where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    trusted = labels.where("quality = 1").select(own).where(~held_out(F.col("doc_id")))
    good = _sampled_features(docs, open_.join(trusted, "doc_id", "left_semi"), positives)
    web = _sampled_features(docs, open_, unlabelled)
    return Model(good, web) if len(good) and len(web) else None


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of `docs`.

    The score comes from the text alone; null counts as empty and is scored
    like any text. Without a model every score is 0.5. Rows are kept as often
    as they occur, null ids stay null and aren't held out; other columns are
    not read, and an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches):
            texts = rows.column(1).to_pylist()
            values = sent.value(texts) if sent.value else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(values)], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, score double")
    return rows.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, model: Model | None) -> DataFrame:
    """`docs` without the rows that the model rejects; all columns and other rows as they are."""
    if model is None:
        return docs
    sent, text = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches):
            yield rows.filter(pa.array(sent.value(rows.column(text).to_pylist()) >= 0.5))

    return docs.mapInArrow(run, docs.schema)
