"""Quality by ordinal cumulative-link regression on graded ratings.

P(grade <= k) = 1 / (1 + exp(-(threshold_k - w . x))): one weight vector over
hashed text features, shared by all grades, and ordered thresholds. The
features of a text are the shares of its words that have a given shape (runs
of letters and digits collapsed, punctuation kept), that repeat one of the
words just before, and that end a line, hashed into FEATURES columns and
scaled by n / (n + SHORT) so that a few words are weak evidence.

The model is fitted on a bounded sample of rated rows (TRAINING_ROWS, chosen
by a hash); every document is scored in one pass without a shuffle, with its
expected grade and the probability of reaching the grade asked for.

Defined cases: null and empty texts have no features and score what no
evidence scores; null ratings do not count, several ratings of one doc_id
count as their rounded-down mean; with fewer than two grades every document
gets that grade with certainty (grade 0 without any rating, tail 1, so that
nothing is rejected without evidence); empty tables give empty results; extra
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import hash_sample, hash_strings, id_and_text, split_words, text_parts, with_labels

FEATURES = 1 << 14
#: Rated rows that the fit uses at most, about.
TRAINING_ROWS = 20_000
#: Words that count as no evidence when added.
SHORT = 4.0
SCALE = 10.0
STEPS, RATE, RIDGE = 150, 0.5, 1e-5
#: Probability of the wanted grade or better below which a document is rejected.
KEEP_TAIL = 0.5
LETTER, DIGIT, RUN = re.compile(r"[^\W\d_]"), re.compile(r"\d+"), re.compile(r"(.)\1+")
REPEATS = 4


def shape(word: str) -> str:
    word = DIGIT.sub("0", LETTER.sub(lambda m: "A" if m[0].isupper() else "a", word))
    return RUN.sub(r"\1", word)


def word_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word counts by row, and the features of all words as (row, feature) pairs, one array of shape (2, n)."""
    offsets, codes, words = split_words(texts)
    n = np.diff(offsets)
    row = np.repeat(np.arange(len(n)), n)
    names = hash_strings([shape(w) for w in words.to_pylist()])
    features = [np.stack([row, (names % np.uint64(FEATURES - REPEATS)).astype(np.int64)[codes] + REPEATS])]
    for back in range(1, REPEATS + 1):
        same = np.flatnonzero((codes[back:] == codes[:-back]) & (row[back:] == row[:-back])) + back
        features.append(np.stack([row[same], np.full(len(same), back - 1)]))
    return n, np.concatenate(features, axis=1)


def text_rows(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) of every nonzero feature."""
    n, pairs = word_features(texts)
    keys, counts = np.unique(pairs[0] * FEATURES + pairs[1], return_counts=True)
    row, feature = keys // FEATURES, keys % FEATURES
    return row, feature, SCALE * counts / (n[row] + SHORT)


@dataclass
class OrdinalModel:
    grades: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, texts: pa.Array) -> np.ndarray:
        """(text, k): probability of a grade above grades[k]."""
        if not len(self.thresholds):
            return np.ones((len(texts), 0))
        row, feature, value = text_rows(texts)
        z = np.bincount(row, self.weights[feature] * value, len(texts))
        return 1 / (1 + np.exp(-np.clip(z[:, None] - self.thresholds[None, :], -30, 30)))


def fit(row: np.ndarray, feature: np.ndarray, value: np.ndarray, rank: np.ndarray, grades: np.ndarray) -> OrdinalModel:
    """Adaptive gradient steps on the mean log-likelihood; thresholds stay ordered as a first one and positive gaps."""
    k, n = len(grades) - 1, len(rank)
    weights, gathered = np.zeros(FEATURES), np.full(FEATURES, 1e-8)
    share = np.array([(rank <= i).mean() for i in range(k)])
    start = np.log(np.clip(share, 1e-3, 1 - 1e-3) / (1 - np.clip(share, 1e-3, 1 - 1e-3)))
    first, gaps = start[0], np.log(np.maximum(np.diff(start), 1e-3))
    gathered_first, gathered_gaps = 1e-8, np.full(k - 1, 1e-8)
    sigmoid = lambda t: 1 / (1 + np.exp(-np.clip(t, -30, 30)))
    for _ in range(STEPS):
        theta = np.concatenate([[first], first + np.cumsum(np.exp(gaps))])
        z = np.bincount(row, weights[feature] * value, n)
        upper = np.where(rank < k, sigmoid(theta[np.minimum(rank, k - 1)] - z), 1.0)
        lower = np.where(rank > 0, sigmoid(theta[np.maximum(rank - 1, 0)] - z), 0.0)
        p = np.maximum(upper - lower, 1e-9)
        slope_up, slope_low = upper * (1 - upper) / p, lower * (1 - lower) / p
        dz = (slope_up - slope_low) / n
        dtheta = np.bincount(np.minimum(rank, k - 1), np.where(rank < k, -slope_up, 0) / n, k) + np.bincount(np.maximum(rank - 1, 0), np.where(rank > 0, slope_low, 0) / n, k)
        g = np.bincount(feature, dz[row] * value, FEATURES) + RIDGE * weights
        gathered += g * g
        weights -= RATE * g / np.sqrt(gathered)
        g0 = dtheta.sum()
        gathered_first += g0 * g0
        first -= RATE * g0 / np.sqrt(gathered_first)
        if k > 1:
            gg = np.cumsum(dtheta[::-1])[::-1][1:] * np.exp(gaps)
            gathered_gaps += gg * gg
            gaps -= RATE * gg / np.sqrt(gathered_gaps)
    return OrdinalModel(grades, weights, np.concatenate([[first], first + np.cumsum(np.exp(gaps))]))


def train(docs: DataFrame, ratings: DataFrame, column: str = "quality", most: int = TRAINING_ROWS) -> OrdinalModel:
    """The model from documents and ratings (doc_id, integer grade)."""
    known = ratings.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("grade")).filter("doc_id IS NOT NULL AND grade IS NOT NULL")
    known = hash_sample(known.groupBy("doc_id").agg(F.floor(F.avg("grade")).cast("int").alias("grade")), most)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_parts(batches):
            row, feature, value = text_rows(part.column("text"))
            cuts = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(v)) for v in (feature.astype(np.int32), value.astype(np.float32))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("grade"), *lists], names=["doc_id", "grade", "feature", "value"])

    got = sorted(with_labels(id_and_text(docs), known).mapInArrow(features, "doc_id long, grade int, feature array<int>, value array<float>").collect(), key=lambda r: r["doc_id"])  # bounded by `most`
    grades = np.unique([r["grade"] for r in got]).astype(np.int64)
    if len(grades) < 2:
        return OrdinalModel(grades if len(grades) else np.zeros(1, np.int64), np.zeros(FEATURES), np.zeros(0))
    row = np.repeat(np.arange(len(got)), [len(r["feature"]) for r in got])
    rank = np.searchsorted(grades, [r["grade"] for r in got])
    return fit(row, np.concatenate([r["feature"] for r in got]).astype(np.int64), np.concatenate([r["value"] for r in got]).astype(np.float64), rank, grades)


def judged(model: OrdinalModel, texts: pa.Array, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """Expected grade of each text, and its probability of the wanted grade or better."""
    tails = model.tails(texts)
    above = int(np.searchsorted(model.grades, wanted))  # grades[above] is the first that will do
    tail = np.ones(len(tails)) if above == 0 else tails[:, above - 1] if above <= tails.shape[1] else np.zeros(len(tails))
    return model.grades[0] + tails @ np.diff(model.grades).astype(np.float64), tail


def grade_documents(docs: DataFrame, model: OrdinalModel, wanted: int | None = None, keep_tail: float = KEEP_TAIL) -> DataFrame:
    """doc_id, expected_grade, tail_probability (of the wanted grade, by default the highest, or better) and kept."""
    wanted = int(model.grades[-1]) if wanted is None else wanted
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, expected_grade double, tail_probability double, kept boolean"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_parts(batches):
            expected, tail = judged(shared.value, part.column("text"), wanted)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(expected, pa.float64()), pa.array(tail, pa.float64()), pa.array(tail >= keep_tail)], names=["doc_id", "expected_grade", "tail_probability", "kept"])

    return id_and_text(docs).mapInArrow(score, schema)


def keep_good(docs: DataFrame, ratings: DataFrame, wanted: int | None = None, keep_tail: float = KEEP_TAIL) -> DataFrame:
    """The documents that are not rejected, with all their columns: a filter that needs no join, as each row is judged by its own text."""
    model = train(docs, ratings)
    wanted = int(model.grades[-1]) if wanted is None else wanted
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_parts(batches):
            yield part.filter(pa.array(judged(shared.value, part.column("text"), wanted)[1] >= keep_tail))

    return docs.mapInArrow(keep, docs.schema)
