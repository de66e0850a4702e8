"""Quality by ordinal regression: a cumulative-link model on graded ratings, with shared hashed-text weights and ordered thresholds."""

from __future__ import annotations

import itertools
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riftline.llm.common import chunks, table
from riftline.llm.shingles import word_hashes

DIM = 1 << 16
BATCH_BYTES = 1 << 20
#: Bound of the labelled sample.
TRAIN_DOCS = 6000
#: A document is selected if the probability of the highest grade is at least this.
LEAST_TAIL = 0.35


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows (row starts, columns, values): logs of word counts in DIM hashed columns, scaled to length one."""
    words, counts = word_hashes(texts)
    at = np.repeat(np.arange(len(texts)), counts) * DIM + (words & np.uint64(DIM - 1)).astype(np.int64)
    cell, n = np.unique(at, return_counts=True)
    row = cell // DIM
    value = np.log1p(n)
    norm = np.sqrt(np.bincount(row, value * value, minlength=len(texts)))
    return np.searchsorted(row, np.arange(len(texts) + 1)), cell % DIM, value / norm[row]


def _sums(starts: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.diff(np.r_[0.0, np.cumsum(x)][starts])


class Ordinal:
    """P(grade <= k) = sigmoid(threshold_k - w x), by full-batch Adam; thresholds are a first one and positive steps."""

    def __init__(self, grades: int):
        self.w, self.first, self.steps = np.zeros(DIM), -1.0, np.zeros(max(0, grades - 2))
        self.grades = grades

    def thresholds(self) -> np.ndarray:
        return self.first + np.r_[0.0, np.cumsum(np.exp(self.steps))]

    def below(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.thresholds()[None, :] - score[:, None], -40, 40)))

    def fit(self, starts, columns, values, y, rounds: int = 150, rate: float = 0.1, ridge: float = 1e-6) -> Ordinal:
        rows = np.repeat(np.arange(len(y)), np.diff(starts))
        state = {k: [0.0, 0.0] for k in ("w", "first", "steps")}
        for t in range(1, rounds + 1):
            p = np.c_[np.zeros(len(y)), self.below(_sums(starts, self.w[columns] * values)), np.ones(len(y))]
            low, high = p[np.arange(len(y)), y], p[np.arange(len(y)), y + 1]
            slope_low, slope_high, mass = low * (1 - low), high * (1 - high), np.maximum(high - low, 1e-9)
            by_score = (slope_high - slope_low) / mass / len(y)  # of -log likelihood
            by_threshold = np.zeros(self.grades - 1)
            np.add.at(by_threshold, np.minimum(y, self.grades - 2), np.where(y < self.grades - 1, -slope_high / mass, 0) / len(y))
            np.add.at(by_threshold, np.maximum(y - 1, 0), np.where(y > 0, slope_low / mass, 0) / len(y))
            grads = {"w": np.bincount(columns, by_score[rows] * values, minlength=DIM) + ridge * self.w, "first": by_threshold.sum(), "steps": by_threshold[::-1].cumsum()[::-1][1:] * np.exp(self.steps)}
            for k, g in grads.items():
                m, v = state[k][0] * 0.9 + 0.1 * g, state[k][1] * 0.999 + 0.001 * g * g
                state[k] = [m, v]
                setattr(self, k, getattr(self, k) - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8))
        return self


def train(docs: DataFrame, ratings: DataFrame, grades: int, max_docs: int = TRAIN_DOCS) -> Ordinal:
    """Fit on at most max_docs rated documents, those with the smallest hashes of their ids. ratings: (doc_id, grade in 0..grades-1).

    One task gathers the features of the sample and fits; the driver gets the weights.
    """
    picked = ratings.where("grade IS NOT NULL AND doc_id IS NOT NULL").orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(max_docs)
    rated = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", F.col("grade").cast("int").alias("grade"), "text")  # max_docs rows

    def sparse(batches):
        for batch in batches:
            for at, texts in chunks(batch.column(2), BATCH_BYTES):
                starts, columns, values = features(texts)
                cells = [(columns[a:b].tolist(), values[a:b].tolist()) for a, b in itertools.pairwise(starts.tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), batch.column(1).slice(at, len(texts)), pa.array([c for c, _ in cells], pa.list_(pa.int32())), pa.array([v for _, v in cells], pa.list_(pa.float64()))], names=["doc_id", "grade", "columns", "values"])

    def fit(batches):
        rows = sorted((r for batch in batches for r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), [x.values.to_numpy() for x in batch.column(2)], [x.values.to_numpy() for x in batch.column(3)], strict=True)), key=lambda r: r[:2])
        model = Ordinal(grades)
        if rows:
            starts = np.cumsum([0, *(len(r[2]) for r in rows)])
            model.fit(starts, np.concatenate([r[2] for r in rows]), np.concatenate([r[3] for r in rows]), np.array([r[1] for r in rows]))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    made = rated.mapInArrow(sparse, "doc_id long, grade int, columns array<int>, values array<double>").repartition(1).mapInArrow(fit, "model binary").collect()
    return pickle.loads(made[0]["model"]) if made else Ordinal(grades)


def grade(docs: DataFrame, model: Ordinal, least_tail: float = LEAST_TAIL) -> DataFrame:
    """All columns of docs but text, plus expected_grade, tail_1 .. tail_(grades - 1) = P(grade >= k), and selected.

    Whole texts count. A null, empty or wordless text is scored by the thresholds alone. Without ratings the weights are zero. Columns of the same
    names are replaced; repeated rows are scored alike.
    """
    fitted = docs.sparkSession.sparkContext.broadcast(model)  # DIM floats
    names = ["expected_grade", *(f"tail_{k}" for k in range(1, model.grades)), "selected"]
    columns = [c for c in docs.columns if c != "text" and c not in names]

    def run(batches):
        for batch in batches:
            for at, texts in chunks(batch.column(batch.num_columns - 1), BATCH_BYTES):
                starts, cols, values = features(texts)
                tails = 1 - fitted.value.below(_sums(starts, fitted.value.w[cols] * values))
                out = [tails.sum(1), *tails.T, tails[:, -1] >= least_tail]
                yield pa.RecordBatch.from_arrays([*(c.slice(at, len(texts)) for c in batch.columns[:-1]), *map(pa.array, out)], names=[*batch.schema.names[:-1], *names])

    schema = docs.select(*columns).schema
    for name in names:
        schema = schema.add(name, "boolean" if name == "selected" else "double")
    return docs.select(*columns, "text").mapInArrow(run, schema)


def op2_quality_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades 0 toxic, 1 poor, 2 good."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rated = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    model = train(docs, table(spark, sf_dir, "labels").select("doc_id", rated.alias("grade")), 3)
    return grade(docs, model)
