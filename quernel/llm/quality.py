"""Quality by ordinal regression: a cumulative-link model over hashed words.

All grades share one weight vector; ordered thresholds cut its score into
grades: P(grade >= k) = sigmoid(score - threshold_k). Thresholds are a first
value plus positive steps, so they stay in order.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm.common import WordHashes, batch_of, bounded_batches, per_row, slices, slim

WORD_BUCKETS = 1 << 17
BINS = 16
SHAPES = 6
BUCKETS = WORD_BUCKETS + BINS * SHAPES
#: About this many labelled documents at most, whole, are fitted on; a hash of doc_id draws them.
SAMPLE_DOCS = 20_000
#: Word buckets keep weight 0 unless their documents' split between lower and top grade is off by this many standard deviations.
LEAST_Z = 3.5
LEAST_DOCS = 3
STEPS = 300
RATE = 0.1
RIDGE = 1e-5
GRADES = 3
#: Documents are kept if P(grade >= KEEP_GRADE) reaches KEEP_PROBABILITY.
KEEP_GRADE = 2
KEEP_PROBABILITY = 0.5
_PUNCTUATION = b"!\"#$%&()*+,./:;<=>?@[\\]^_`{|}~"
_AS_BLANK = bytes(32 if b in _PUNCTUATION else b for b in range(256))
_SYMBOLS = b"#$%&*+<=>@\\^_`{}~"
_NOT_CAPITALS = bytes(b for b in range(256) if not 65 <= b <= 90)


def features(text: str | None, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, values) of a whole text: damped counts of hashed words, and binned shape measures.

    Shapes: share of capitals, symbols a word, bars a word, exclamations a
    word, share of different words, log of the number of words.
    """
    data = (text or "").encode("utf-8", "surrogatepass")
    words = hashes.of_bytes(data.translate(_AS_BLANK))
    n = len(words)
    if not n:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    buckets, counts = np.unique((words % np.uint64(WORD_BUCKETS)).astype(np.int32), return_counts=True)
    capitals = len(data.translate(None, _NOT_CAPITALS)) / len(data)
    symbols = (len(data) - len(data.translate(None, _SYMBOLS))) / n
    shapes = np.array([capitals * 4, symbols / 2, data.count(b"|") / n * 2, data.count(b"!") / n * 2, len(buckets) / n, np.log1p(n) / 12])
    bins = np.minimum(BINS - 1, (np.clip(shapes, 0, 1) * BINS).astype(np.int32)) + np.arange(SHAPES, dtype=np.int32) * BINS
    return np.concatenate([buckets, WORD_BUCKETS + bins]).astype(np.int32), np.concatenate([1 + np.log(counts), np.ones(SHAPES)]).astype(np.float32)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


@dataclass
class Ordinal:
    weights: np.ndarray
    thresholds: np.ndarray

    @classmethod
    def fit(cls, rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, n_grades: int = GRADES) -> Ordinal:
        """Maximum likelihood with a ridge, by Adam over all rows; the same rows give the same model."""
        index = np.concatenate([r[0] for r in rows]) if rows else np.zeros(0, np.int32)
        value = np.concatenate([r[1] for r in rows]) if rows else np.zeros(0, np.float32)
        sizes = np.array([len(r[0]) for r in rows], np.int64)
        row = np.repeat(np.arange(len(rows)), sizes)
        keep = cls._telling(index, (grades < n_grades - 1)[row])[index]
        index, value, row = index[keep], value[keep], row[keep]
        weights = np.zeros(BUCKETS)
        shares = np.array([(grades >= k).mean() if len(grades) else 0.5 for k in range(1, n_grades)])
        start = -np.log(np.clip(shares, 0.01, 0.99) / (1 - np.clip(shares, 0.01, 0.99)))
        free = np.concatenate([start[:1], np.log(np.maximum(0.05, np.diff(start)))])  # first threshold, logs of steps
        state = [np.zeros(BUCKETS), np.zeros(BUCKETS), np.zeros(len(free)), np.zeros(len(free))]
        if not len(rows):
            return cls(weights, cls._ordered(free))
        for step in range(1, STEPS + 1):
            cuts = cls._ordered(free)
            score = np.bincount(row, value * weights[index], len(rows))
            tail = np.concatenate([np.ones((len(rows), 1)), sigmoid(score[:, None] - cuts), np.zeros((len(rows), 1))], axis=1)
            slope = tail * (1 - tail)
            at = np.arange(len(rows))
            p = np.maximum(1e-9, tail[at, grades] - tail[at, grades + 1])
            up, down = slope[at, grades] / p, slope[at, grades + 1] / p
            d_score = -(up - down) / len(rows)
            d_weights = np.bincount(index, value * d_score[row], BUCKETS) + RIDGE * weights
            d_cuts = np.array([(up[grades == k].sum() - down[grades == k - 1].sum()) / len(rows) for k in range(1, n_grades)])
            steps = np.concatenate([[1.0], np.exp(free[1:])])
            d_free = d_cuts[::-1].cumsum()[::-1] * steps
            for i, (target, gradient) in enumerate(((weights, d_weights), (free, d_free))):
                m, v = state[2 * i], state[2 * i + 1]
                m += 0.1 * (gradient - m)
                v += 0.001 * (gradient**2 - v)
                target -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return cls(weights, cls._ordered(free))

    @staticmethod
    def _telling(index: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Whether each bucket is fitted: all shapes, and words whose grades differ from chance."""
        n, low = np.bincount(index, minlength=BUCKETS), np.bincount(index, lower, BUCKETS)
        share = lower.mean() if len(lower) else 0.0
        z = (low - n * share) / np.sqrt(np.maximum(1e-9, n * share * (1 - share)))
        chosen = (n >= LEAST_DOCS) & (np.abs(z) >= LEAST_Z)
        chosen[WORD_BUCKETS:] = True
        return chosen

    @staticmethod
    def _ordered(free: np.ndarray) -> np.ndarray:
        return free[0] + np.concatenate([[0.0], np.cumsum(np.exp(free[1:]))])

    def tails(self, row: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ..."""
        return sigmoid(float(self.weights[row[0]] @ row[1]) - self.thresholds)


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): 0 if poor and toxic, 1 if one of them, 2 if neither. Of several labels the lowest counts."""
    grade = F.when(F.col("quality") > 0, 1).otherwise(0) + F.when(F.col("toxic") > 0, 0).otherwise(1)
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull())
    return usable.select("doc_id", grade.alias("grade")).groupBy("doc_id").agg(F.min("grade").alias("grade"))


_FEATURES = pa.schema([("index", pa.list_(pa.int32())), ("value", pa.list_(pa.float32())), ("grade", pa.int32())])


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Ordinal:
    """Fit on a bounded sample of labelled documents; features are made on executors.

    Labels that are null anywhere, or of no document, are passed over; without
    any left, every score is that of the first thresholds. Rows of a repeated
    doc_id are all fitted on.
    """
    bounded_batches(docs.sparkSession)
    grades = graded(labels)
    n = grades.count()
    share = min(1.0, sample_docs / n) if n else 0.0
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("quality")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    drawn = F.broadcast(grades.where(draw < share))  # of about sample_docs rows
    rows = slim(docs).join(drawn, "doc_id").select("text", "grade", "doc_id")

    def featured(batches):
        hashes = WordHashes()
        for part in (p for batch in batches for p in slices(batch)):
            made = [(*features(t, hashes), g) for t, g in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
            yield batch_of(_FEATURES, made)

    table = rows.select("text", "grade").mapInArrow(featured, "index array<int>, value array<float>, grade int").toArrow()
    index, value = table["index"].combine_chunks(), table["value"].combine_chunks()
    ends = index.offsets.to_numpy()
    flat_index, flat_value = index.values.to_numpy(), value.values.to_numpy()
    made = [(flat_index[a:b], flat_value[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    grade = table["grade"].to_numpy()
    order = sorted(range(len(made)), key=lambda i: (int(grade[i]), made[i][0].tobytes()))  # whatever order they came in
    return Ordinal.fit([made[i] for i in order], grade[order].astype(np.int64) if order else np.zeros(0, np.int64))


_SCORED = pa.schema([("doc_id", pa.int64()), ("expected_grade", pa.float64()), ("tail_probability", pa.float64()), ("kept", pa.bool_())])
SCORED_SCHEMA = "doc_id long, expected_grade double, tail_probability double, kept boolean"


def score(docs: DataFrame, model: Ordinal, keep_grade: int = KEEP_GRADE, keep_probability: float = KEEP_PROBABILITY) -> DataFrame:
    """Expected grade, P(grade >= keep_grade) and the selection, for every whole text.

    A null, empty or wordless text has no features: its probabilities are those
    of score 0 and it isn't kept. Null doc_ids and repeated rows pass through;
    an empty table gives no rows. Other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        hashes, fitted = WordHashes(), shared.value

        def of(doc_id, text):
            made = features(text, hashes)
            tails = fitted.tails(made)
            tail = float(tails[keep_grade - 1])
            return doc_id, float(tails.sum()), tail, bool(len(made[0])) and tail >= keep_probability

        return of

    return per_row(slim(docs), start, _SCORED, SCORED_SCHEMA)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on what is labelled, score all; train and score say how nulls, repeats and empty tables go."""
    return score(docs, train(docs, labels))
