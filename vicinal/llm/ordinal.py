"""Quality classifier: cumulative-link regression on graded ratings over hashed text."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vicinal.llm.common import Recent, labelled_sample, lean, table

BITS = 18
#: Weight of a word that occurs, and of the share of a word shape, in the features.
WORD_VALUE, SHAPE_VALUE = 1.0, 3.0


def _bucket(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "replace")) & ((1 << BITS) - 1)


def word_shape(word: str) -> str:
    """Kinds of character in a whole word, runs once: ``Xx``, ``X!``, ``x#``, ``9``."""
    kinds = ("X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c for c in word)
    return "".join(k for k, _ in groupby(kinds))


class WordBuckets(Recent):
    """(bucket of the word, bucket of its beginning, bucket of its shape) for each raw word."""

    def __init__(self, most: int = 50_000):
        super().__init__(most)

    def make(self, raw: str) -> tuple[int, int, int]:
        word = raw.strip(".,;:!?\"'()[]{}<>*#$%&|-_").lower()
        return _bucket("w" + word), _bucket("b" + word[:5]), _bucket("s" + word_shape(raw))


def statistics(words: list[str], distinct: int) -> list[int]:
    """Buckets of coarse statistics: length, share of distinct words, share of words equal to the one before."""
    n = len(words)
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return [_bucket(f"n{n.bit_length()}"), _bucket(f"d{10 * distinct // max(1, n)}"), _bucket(f"r{10 * again // max(1, n)}")]


def features(text: str | None, buckets: WordBuckets) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hash numbers of a whole text, and their values."""
    words = (text or "").split()
    kinds = set(words)
    at = [b for w in kinds for b in buckets[w][:2]]
    value = [WORD_VALUE] * len(at)
    counts: dict[int, int] = {}
    for w in words:
        s = buckets[w][2]
        counts[s] = counts.get(s, 0) + 1
    at += counts
    value += [SHAPE_VALUE * c / len(words) for c in counts.values()]
    extra = statistics(words, len(kinds))
    numbers, place = np.unique(np.array(at + extra, np.int64), return_inverse=True)
    return numbers, np.bincount(place, np.array(value + [1.0] * len(extra)))


@dataclass
class OrdinalModel:
    """P(grade <= k) = logistic(thresholds[k] - score); grades are 0, 1, ... in order."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k; the expected grade is their sum."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - np.asarray(score)[..., None], -50, 50)))


def fit_ordinal(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, n_grades: int, rounds: int = 400, rate: float = 0.1, sparsity: float = 3e-4, least_z: float = 6.0) -> OrdinalModel:
    """Proximal adaptive-moment steps on the mean likelihood of cumulative logits, with an L1 penalty on the weights.

    Only features whose share of rows below and above some grade differs by
    ``least_z`` standard errors or more get a weight: words that a few long or
    copied texts happen to hold say nothing.  The thresholds stay ordered: each
    is the one before plus a positive step.
    """
    row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(a) for a, _ in rows])
    col, value = np.concatenate([a for a, _ in rows]), np.concatenate([v for _, v in rows])
    by_grade = np.array([np.bincount(col[grades[row] == g], minlength=1 << BITS) for g in range(n_grades)], float)
    sizes = np.bincount(grades, minlength=n_grades).astype(float)
    apart = np.zeros(1 << BITS)
    for g in range(1, n_grades):
        low, high = max(1.0, sizes[:g].sum()), max(1.0, sizes[g:].sum())
        p = by_grade.sum(axis=0) / (low + high)
        error = np.sqrt(p * (1 - p) * (1 / low + 1 / high)) + 1e-9
        apart = np.maximum(apart, np.abs(by_grade[:g].sum(axis=0) / low - by_grade[g:].sum(axis=0) / high) / error)
    known = np.flatnonzero(apart >= least_z)
    place = np.full(1 << BITS, -1)
    place[known] = np.arange(len(known))
    use = place[col] >= 0
    row, col, value = row[use], place[col[use]], value[use]
    share = np.clip(np.cumsum(np.bincount(grades, minlength=n_grades))[:-1] / max(1, len(grades)), 1e-3, 1 - 1e-3)
    first = np.log(share / (1 - share))
    n, k = len(rows), n_grades - 1
    x = np.concatenate([np.zeros(len(known)), first[:1], np.log(np.maximum(np.diff(first), 1e-2))])
    mean, square = np.zeros(len(x)), np.zeros(len(x))
    for turn in range(1, rounds + 1):
        w, raw = x[: len(known)], x[len(known) :]
        thresholds = np.concatenate([[-np.inf], raw[0] + np.cumsum(np.concatenate([[0.0], np.exp(raw[1:])])), [np.inf]])
        score = np.bincount(row, value * w[col], minlength=n)
        hi, lo = (1 / (1 + np.exp(-np.clip(thresholds[at] - score, -40, 40))) for at in (grades + 1, grades))
        p = np.maximum(hi - lo, 1e-12)
        by_score = (1 - hi - lo) / n
        by_threshold = (np.bincount(grades, lo * (1 - lo) / p, minlength=n_grades)[1:] - np.bincount(grades, hi * (1 - hi) / p, minlength=n_grades)[:k]) / n
        steps = np.concatenate([[by_threshold.sum()], [by_threshold[j:].sum() * np.exp(raw[j]) for j in range(1, k)]])
        grad = np.concatenate([np.bincount(col, value * by_score[row], minlength=len(known)), steps])
        mean += 0.1 * (grad - mean)
        square += 0.01 * (grad * grad - square)
        pace = rate / (np.sqrt(square / (1 - 0.99**turn)) + 1e-8)
        x = x - pace * mean / (1 - 0.9**turn)
        x[: len(known)] = np.sign(w := x[: len(known)]) * np.maximum(np.abs(w) - sparsity * np.minimum(pace[: len(known)], 1e3), 0)
    weights = np.zeros(1 << BITS, np.float32)
    weights[known] = x[: len(known)]
    raw = x[len(known) :]
    return OrdinalModel(weights, raw[0] + np.cumsum(np.concatenate([[0.0], np.exp(raw[1:])])))


def graded_labels(labels: DataFrame) -> DataFrame:
    """doc_id and grade: 0 low quality, 1 toxic but of good quality, 2 good.  Rows without both labels are left out."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    return labels.where("doc_id is not null and quality is not null and toxic is not null").select("doc_id", grade.alias("grade"))


N_GRADES = 3
#: Labelled documents of each grade in the sample, about.
PER_GRADE = {0: 2500, 1: 2500, 2: 5000}


def train_quality(docs: DataFrame, labels: DataFrame, per_grade: int | dict = PER_GRADE, seed: int = 4) -> OrdinalModel | None:
    """Fit on whole texts of a hash sample of about ``per_grade`` labelled documents by grade; None without labels.

    Features are made on the executors; these, of bounded number, are what the
    driver gets.
    """
    sample = labelled_sample(graded_labels(labels), "grade", per_grade, "doc_id", seed).withColumnRenamed("doc_id", "l_id")
    chosen = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(sample), F.col("doc_id") == F.col("l_id")).select("doc_id", "text", "grade")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = WordBuckets()
        for batch in batches:
            got = [features(t.as_py(), buckets) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a.astype(np.int32).tobytes() for a, _ in got], pa.binary()), pa.array([v.astype(np.float32).tobytes() for _, v in got], pa.binary()), batch.column(2)], names=["doc_id", "at", "v", "grade"])

    got = sorted(chosen.mapInArrow(lean(run), "doc_id long, at binary, v binary, grade int").collect(), key=lambda r: (r["doc_id"], r["at"]))
    if not got:
        return None
    rows = [(np.frombuffer(r["at"], np.int32), np.frombuffer(r["v"], np.float32)) for r in got]
    return fit_ordinal(rows, np.array([r["grade"] for r in got]), N_GRADES)


class WordWeights(Recent):
    """(weight of the word and of its beginning, weight of its shape) for each raw word."""

    def __init__(self, model: OrdinalModel, most: int = 60_000):
        super().__init__(most)
        self.weights, self.buckets = model.weights, WordBuckets(1)

    def make(self, raw: str) -> tuple[float, float]:
        a, b, s = self.buckets.make(raw)
        return float(self.weights[a]) + float(self.weights[b]), float(self.weights[s])


class Scorer:
    """Scores of whole texts."""

    def __init__(self, model: OrdinalModel):
        self.model, self.words = model, WordWeights(model)

    def score(self, text: str | None) -> float:
        words = (text or "").split()
        counts = Counter(words)
        word = shape = 0.0
        for raw, n in counts.items():
            a, s = self.words[raw]
            word += a
            shape += n * s
        return WORD_VALUE * word + SHAPE_VALUE * shape / max(1, len(words)) + float(self.model.weights[statistics(words, len(counts))].sum())


def rate_documents(spark: SparkSession, docs: DataFrame, model: OrdinalModel | None, text_col: str = "text", least: float = 0.4) -> DataFrame:
    """``docs`` with quality_expected (the expected grade), quality_top (P of the best grade) and quality_kept.

    A document is kept if the best grade has probability ``least`` or more.
    Null and empty texts have only their statistics as features.  Without a
    model everything is kept and the two numbers are null.  Rows are judged one
    by one and nothing is shuffled; columns of these names are replaced.
    """
    base = docs.drop("quality_expected", "quality_top", "quality_kept")
    if model is None:
        return base.withColumns({"quality_expected": F.lit(None).cast("double"), "quality_top": F.lit(None).cast("double"), "quality_kept": F.lit(True)})
    shared, at = spark.sparkContext.broadcast(model), base.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            tails = shared.value.tails(np.array([scorer.score(t.as_py()) for t in batch.column(at)], float))
            more = [pa.array(tails.sum(axis=1)), pa.array(tails[:, -1]), pa.array(tails[:, -1] >= least)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "quality_expected", "quality_top", "quality_kept"])

    schema = T.StructType([*base.schema.fields, T.StructField("quality_expected", T.DoubleType()), T.StructField("quality_top", T.DoubleType()), T.StructField("quality_kept", T.BooleanType())])
    return base.mapInArrow(lean(run), schema)


def quality_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier keeps, with their columns.

    Null and empty texts are judged by their statistics alone, like any other
    row; repeated rows and null ids are judged one by one.  Without labels
    everything is kept.
    """
    model = train_quality(docs, table(spark, sf_dir, "labels"))
    return rate_documents(spark, docs, model).where("quality_kept").select(*docs.columns)
