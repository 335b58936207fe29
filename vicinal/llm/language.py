"""Language identification: family first, then one-versus-one linear SVMs within it."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinal.llm.common import labelled_sample, lean

# Language families by ISO 639-1 code; another code is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr uz",
    "indo-aryan": "bn gu hi mr ne pa sd si ur",
    "dravidian": "kn ml ta te",
    "semitic": "am ar he mt",
    "austronesian": "id jv ms su tl",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
UNKNOWN = "und"
BITS = 16
#: Code points of text that are turned into features at a time.
SEGMENT = 1 << 19


@functools.cache
def letters() -> np.ndarray:
    """For each code point, its lower case if it is a letter and has one of one code point, itself if not; 0 if it is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def gram_hashes(text: str) -> np.ndarray:
    """Hashed runs of one to three characters; what is no letter is one blank, which no run of one character is."""
    points = letters()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    blank = points == 0
    points = points[~(blank & np.concatenate([[False], blank[:-1]]))]
    one = points.astype(np.uint64) + np.uint64(1)
    mix, top = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - BITS)
    two = one[:-1] * np.uint64(0x10001) + one[1:]
    three = two[:-1] * np.uint64(0x100000001B3) + one[2:]
    parts = [one[points != 0], two + np.uint64(1 << 42), three + np.uint64(1 << 43)]
    return ((np.concatenate(parts) * mix) >> top).astype(np.int64)


def segments(text: str) -> Iterator[str]:
    """A text in parts that overlap by two characters, so that memory is bounded and no run of three is lost."""
    yield text[:SEGMENT]
    for at in range(SEGMENT, len(text), SEGMENT):
        yield text[at - 2 : at + SEGMENT]


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hash numbers and the share of each, scaled so that vectors have a length of about one."""
    count = np.zeros(1 << BITS)
    for part in segments(text):
        count += np.bincount(gram_hashes(part), minlength=1 << BITS)
    at = np.flatnonzero(count)
    return at, (SCALE * count[at] / max(1.0, count.sum())).astype(np.float32)


SCALE = 16.0


def linear_svm(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: float = 10.0, rounds: int = 12) -> np.ndarray:
    """Weights and, last, the bias of an L2-regularised squared-hinge SVM, by dual coordinate descent."""
    w, a = np.zeros((1 << BITS) + 1), np.zeros(len(rows))
    square = np.array([float(v @ v) + 1 for _, v in rows]) + 0.5 / cost
    order = np.random.default_rng(1)
    for _ in range(rounds):
        for i in order.permutation(len(rows)):
            at, v = rows[i]
            gap = y[i] * (w[at] @ v + w[-1]) - 1 + a[i] * 0.5 / cost
            new = max(0.0, a[i] - gap / square[i])
            if new != a[i]:
                step = (new - a[i]) * y[i]
                w[at] += step * v
                w[-1] += step
                a[i] = new
    return w


@dataclass
class LanguageModel:
    """Families, their languages, and for each pair of either the column of its SVM in ``weights``."""

    families: list[str]
    languages: dict[str, list[str]]
    pairs: dict[tuple[str, str], int]
    weights: np.ndarray  # features and bias by SVM

    def margins(self, text: str) -> np.ndarray:
        total, n = np.zeros(self.weights.shape[1]), 0
        for part in segments(text):
            at = gram_hashes(part)
            # Sum of the rows of the weights, by how often each occurs.
            total += np.bincount(at, minlength=1 << BITS).astype(np.float32) @ self.weights[:-1] if len(at) > (1 << BITS - 3) else self.weights[at].sum(axis=0, dtype=np.float64)
            n += len(at)
        return SCALE * total / max(1, n) + self.weights[-1]

    def winner(self, names: list[str], margin: np.ndarray) -> tuple[str, float]:
        """The name with the most one-versus-one wins (ties: the larger sum of margins) and its weakest win's confidence."""
        if len(names) == 1:
            return names[0], 1.0
        wins = dict.fromkeys(names, 0.0)
        against: dict[str, list[float]] = {n: [] for n in names}
        for a, b in combinations(names, 2):
            m = float(margin[self.pairs[a, b]])
            wins[a if m >= 0 else b] += 1000
            for n, v in ((a, m), (b, -m)):
                wins[n] += np.tanh(v)
                against[n].append(v)
        best = max(names, key=lambda n: (wins[n], n))
        return best, float(1 / (1 + np.exp(-4 * np.clip(min(against[best]), -20, 20))))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not any(map(str.isalpha, text)) or not self.families:
            return UNKNOWN, 0.0
        margin = self.margins(text)
        family, p = self.winner(self.families, margin)
        language, q = self.winner(self.languages[family], margin)
        return language, p * q


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]]) -> LanguageModel:
    """The SVMs between families and those between the languages of each, from (language, hashes, values)."""
    langs = sorted({r[0] for r in rows})
    family = {code: FAMILY_OF.get(code, code) for code in langs}
    families = sorted(set(family.values()))
    languages = {f: [c for c in langs if family[c] == f] for f in families}
    pairs: dict[tuple[str, str], int] = {}
    columns = []
    for names, of in [(families, lambda c: family[c]), *((languages[f], lambda c: c) for f in families)]:
        for a, b in combinations(names, 2):
            part = [r for r in rows if of(r[0]) in (a, b)]
            pairs[a, b] = len(columns)
            columns.append(linear_svm([(r[1], r[2]) for r in part], np.array([1.0 if of(r[0]) == a else -1.0 for r in part])))
    weights = np.stack(columns, axis=1).astype(np.float32) if columns else np.zeros(((1 << BITS) + 1, 1), np.float32)
    return LanguageModel(families, languages, pairs, weights)


def held_out(id_col: str = "doc_id"):
    """Whether a document is kept from learning: crc32 of its id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def train_language_model(docs: DataFrame, per_language: int = 1200, seed: int = 1) -> LanguageModel:
    """Fit on a hash sample of about ``per_language`` documents of each language that are not held out.

    Whole texts become features on the executors; these, of bounded number,
    are what the driver gets.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "lang", "text")
    sample = labelled_sample(usable, "lang", per_language, "doc_id", seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, langs, at, values = [], [], [], []
            for doc, lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                a, v = features(text.as_py())
                ids.append(doc), langs.append(lang), at.append(a.astype(np.int32).tobytes()), values.append(v.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(at, pa.binary()), pa.array(values, pa.binary())], names=["doc_id", "lang", "at", "v"])

    got = sample.select(F.col("doc_id").cast("long"), "lang", "text").mapInArrow(lean(run), "doc_id long, lang string, at binary, v binary").collect()
    got.sort(key=lambda r: r["doc_id"])
    return fit([(r["lang"], np.frombuffer(r["at"], np.int32), np.frombuffer(r["v"], np.float32).astype(np.float64)) for r in got if len(r["at"])])


def identify_languages(spark: SparkSession, docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred and score (the product of the confidences in family and language).

    Null text and text without a letter are ``und`` with score 0.  Repeated
    rows are judged one by one and other columns left out.  Nothing is
    shuffled; the model, of fixed size, is broadcast.
    """
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [shared.value.predict(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lean(run), "doc_id long, held_out boolean, lang_pred string, score double")
