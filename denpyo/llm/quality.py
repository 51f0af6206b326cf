"""Quality classifier: positive-unlabelled learning on counts of a text's characters and words.

Method: a linear scorer is fitted by minimising the non-negative unbiased risk of trusted positives
and unlabelled web text:

    prior * E_p[loss(+)] + max(0, E_u[loss(-)] - prior * E_p[loss(-)])

Where the estimate of the negatives' risk (the second part) falls below zero on all rows, a step follows its
ascent alone, as the published method has it, and the weight decay. Labelled negatives are not used. The class prior is estimated from the two samples: the smallest
ratio of the unlabelled share to the positive share above any score of a first, plain
positive-against-unlabelled fit.

The fit uses some `SAMPLE` positives and `SAMPLE` unlabelled documents, those of the smallest
hashes. Every document is then scored on its whole text, in one pass without a shuffle.

Results by case: a null text is scored like the empty one; rows are scored independently, so
repeated rows have equal scores; without any positive to learn from the score is the constant
0.5; a null id is held out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, hash_sample, lean, strings, with_ids

SAMPLE = 20_000
#: Score from which a document is predicted good.
CUT = 0.3
FEATURES = [
    "symbols", "marks", "pipes", "shouts", "upper", "upper_words", "repeats", "pairs", "variety",
    "lines", "long_words", "short", "letters",
]
#: Bytes counted as symbols, marks of exclamation, and separators of lists.
SYMBOLS, SHOUTS, PIPES, STOPS = b"#$%&*@^~<>=_+\\{}[]", b"!?", b"|", b".,;:"


def features(text: str | None) -> list[float]:
    """Numbers between 0 and 1, by FEATURES."""
    raw = (text or "").encode()
    words = raw.split()
    count = max(1, len(words))
    of = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = lambda chars: min(1.0, float(of[list(chars)].sum()) / count)  # noqa: E731  per word
    upper = of[65:91].sum()
    letters = upper + of[97:123].sum() + of[128:].sum()
    kinds = len(set(words))
    repeats = sum(map(bytes.__eq__, words, words[1:])) / count
    pairs = len(set(zip(words, words[1:]))) / max(1, len(words) - 1)
    lines = [line for line in raw.split(b"\n") if line]
    return [
        share(SYMBOLS), share(STOPS), share(PIPES), share(SHOUTS),
        float(upper) / max(1, letters), sum(map(bytes.isupper, words)) / count, repeats, 1 - pairs,
        1 - kinds / count, 1 - len(set(lines)) / max(1, len(lines)), min(1.0, sum(len(w) > 20 for w in words) / count),
        1 / (1 + len(words) / 10), float(letters) / max(1, len(raw)),
    ]


def _matrix(texts: pa.Array) -> np.ndarray:
    return np.array([features(t) for t in strings(texts)], np.float64).reshape(-1, len(FEATURES))


def _features_of(docs: DataFrame) -> np.ndarray:
    """Features of a bounded number of documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in _matrix(batch.column(0)).T], FEATURES)

    rows = bounded(docs).select(F.col("text").cast("string").alias("text")).mapInArrow(
        count, ", ".join(f"{f} DOUBLE" for f in FEATURES))
    return np.array([tuple(r) for r in rows.collect()], np.float64).reshape(-1, len(FEATURES))


def _expanded(x: np.ndarray) -> np.ndarray:
    """The features and their square roots, which tell none from few."""
    return np.hstack([x, np.sqrt(np.maximum(x, 0.0))])


def _descend(start: np.ndarray, gradient, steps: int = 600, rate: float = 0.05) -> np.ndarray:
    """Adam."""
    w, first, second = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for t in range(1, steps + 1):
        g = gradient(w)
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return w


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, least: float = 0.3) -> float:
    """Share of positives among the unlabelled, from scores of both: above any cut, the unlabelled
    hold at least the positives' part, and where no negative lies just that."""
    cuts = np.quantile(positive, np.linspace(0, 1 - least, 50))
    ratios = [(unlabelled >= c).mean() / max((positive >= c).mean(), 1e-9) for c in cuts]
    return float(min(0.99, max(0.01, min(ratios))))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None,
        decay: float = 1e-3) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(weights with the constant last, means, scales, prior) of a scorer on expanded features."""
    p, u = _expanded(positive), _expanded(unlabelled)
    mean, scale = u.mean(axis=0), u.std(axis=0) + 1e-3
    one = lambda x: np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    p, u = one(p), one(u)

    if prior is None:
        def plain(w):
            return p.T @ (_sigmoid(p @ w) - 1) / len(p) + u.T @ _sigmoid(u @ w) / len(u) + decay * w
        first = _descend(np.zeros(p.shape[1]), plain, steps=300)
        prior = estimated_prior(p @ first, u @ first)

    def gradient(w):
        sp, su = _sigmoid(p @ w), _sigmoid(u @ w)
        negative = -np.log(np.maximum(1 - su, 1e-12)).mean() + prior * np.log(np.maximum(1 - sp, 1e-12)).mean()
        trusted = prior * p.T @ (sp - 1) / len(p)
        rest = u.T @ su / len(u) - prior * p.T @ sp / len(p)
        # Where the estimate of the negatives' risk falls below zero it alone is led back up.
        return (trusted + rest if negative >= 0 else -rest) + decay * w

    return _descend(np.zeros(p.shape[1]), gradient), mean, scale, prior


class Scorer:
    """Scores of texts; without weights always 0.5."""

    def __init__(self, weights=None, mean=None, scale=None):
        self.weights, self.mean, self.scale = weights, mean, scale

    def __call__(self, texts: pa.Array) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), 0.5)
        x = (_expanded(_matrix(texts)) - self.mean) / self.scale
        return _sigmoid(x @ self.weights[:-1] + self.weights[-1])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def learn(docs: DataFrame, labels: DataFrame, prior: float | None = None) -> Scorer:
    """A scorer from documents (doc_id, text) and labels (doc_id, quality).

    Labels with quality 1 are the trusted positives. Documents that are held out (crc32 of the id
    divisible by 5) are not read.
    """
    trusted = labels.filter("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    trusted = hash_sample(trusted.filter(~held_out(F.col("doc_id"))), SAMPLE)
    seen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(~held_out(F.col("doc_id")))
    positive = _features_of(with_ids(seen, trusted))
    if not len(positive):
        return Scorer()
    return Scorer(*fit(positive, _features_of(hash_sample(seen, SAMPLE)), prior)[:3])


def score(docs: DataFrame, scorer: Scorer, cut: float = CUT) -> DataFrame:
    """(doc_id, held_out, score, predicted) for documents (doc_id, text)."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            scores = scorer(batch.column(2))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= cut).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"),
                      F.col("text").cast("string").alias("text"))
    return bounded(own).mapInArrow(judge, "doc_id LONG, held_out BOOLEAN, score DOUBLE, predicted INT")


def keep_good(docs: DataFrame, scorer: Scorer, cut: float = CUT) -> DataFrame:
    """The documents predicted good, with all their columns."""
    at = docs.columns.index("text")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            yield batch.filter(pa.array(scorer(batch.column(at)) >= cut))

    return bounded(docs).mapInArrow(judge, docs.schema)
