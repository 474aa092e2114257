"""Toxicity grades by cumulative-link ordinal regression.

The chance that a document's grade is above k is the logistic function of s - t(k): all grades
share the weights in s, a sum over sparse text features, and the thresholds t are ordered. The
expected severity is the sum of these chances. Features are the distinct words of a whole text
and their beginnings, hashed; the most telling ones on a bounded sample take part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.fitting import WordTable, sample_per_label, trimmed
from tallymark.llm.resident import resident
from tallymark.llm.shared import settle

BEGINNINGS = (3, 4, 5, 6, 7)
FEATURE_BITS = 31


def word_features(word: bytes) -> set[int]:
    """Hashes of a word and of its beginnings; a mark keeps them apart."""
    text = trimmed(word).lower()
    if not text:
        return set()
    parts = [text + "$", *(text[:n] for n in BEGINNINGS if n < len(text))]
    return {zlib.crc32(p.encode()) & (1 << FEATURE_BITS) - 1 for p in parts}


def text_features(text: str | None) -> set[int]:
    return set().union(*map(word_features, set((text or "").lower().encode().split())))


@dataclass
class ToxicityModel:
    features: np.ndarray  # sorted hashes
    weights: np.ndarray
    thresholds: np.ndarray  # ordered; one fewer than grades
    grades: np.ndarray  # ascending; the grades that were learned from

    @property
    def name(self) -> str:
        return "-".join(f"{zlib.crc32(x.tobytes()):x}" for x in (self.features, self.weights, self.thresholds, self.grades))

    def table(self) -> WordTable:
        return resident(("toxicity", self.name), lambda: WordTable(1, self._rows))

    def _rows(self, words: list[bytes]) -> np.ndarray:
        known = dict(zip(self.features.tolist(), self.weights.tolist(), strict=True))
        out = np.zeros((len(words), 1), np.float32)
        for row, word in zip(out, words, strict=True):
            row[0] = sum(known.get(f, 0.0) for f in word_features(word))
        return out

    def above(self, sums: np.ndarray) -> np.ndarray:
        """The chance of a grade above each threshold."""
        return 1 / (1 + np.exp(-np.clip(sums[:, None] - self.thresholds, -500, 500)))

    def severity(self, above: np.ndarray) -> np.ndarray:
        """The expected grade: the lowest, and each step to the next by its chance."""
        return self.grades[0] + above @ np.diff(self.grades)

    def grade(self, docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
        """Per row: its id, severity (the expected grade of the whole text), grade (the median one) and toxic.

        A document is toxic if a grade above 0 is likelier than 0. A null text counts as empty.
        Repeated rows and null ids are kept; other columns are ignored whatever their names;
        empty input gives no rows.
        """
        bare = docs.select(F.col(id_column).alias(id_column), F.col(text).alias("text"))
        model = self

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                above = model.above(model.table().sums(batch.column("text").to_pylist(), once=True)[:, 0][: batch.num_rows])
                grade = model.grades[(above > 0.5).sum(1)]
                yield pa.record_batch(
                    [batch.column(id_column), pa.array(model.severity(above)), pa.array(grade, pa.int32()), pa.array(grade > 0)],
                    names=[id_column, "severity", "grade", "toxic"],
                )

        return bare.mapInArrow(run, f"{id_column} {dict(bare.dtypes)[id_column]}, severity double, grade int, toxic boolean")


def telling(sample: DataFrame, most: int, least_rows: int) -> list[int]:
    """The features whose presence goes most with a grade above 0, or with 0, by likelihood ratio."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                found = list(text_features(text))
                yield pa.record_batch(
                    [pa.array(found, pa.int64()), pa.array([int(label > 0)] * len(found), pa.int64())], names=["feature", "up"]
                )

    totals = sample.agg(F.count("*").alias("n"), F.count_if(F.col("label") > 0).alias("up")).first()
    n, up = float(totals["n"]), float(totals["up"])
    seen = sample.mapInArrow(run, "feature long, up long").groupBy("feature").agg(
        F.count("*").alias("rows"), F.sum("up").alias("up")
    ).filter(F.col("rows") >= least_rows)

    def part(observed, expected):
        return F.when(observed > 0, observed * F.log(observed / expected)).otherwise(0.0)

    a, b, rows = F.col("up"), F.col("rows") - F.col("up"), F.col("rows")
    ratio = (
        part(a, rows * up / n) + part(b, rows * (n - up) / n)
        + part(up - a, (n - rows) * up / n) + part((n - up) - b, (n - rows) * (n - up) / n)
    )
    best = seen.select("feature", ratio.alias("ratio")).orderBy(F.desc("ratio"), "feature").limit(most)
    return sorted(r["feature"] for r in best.collect())  # bounded by `most`


def train(
    docs: DataFrame, labels: DataFrame, *, id_column: str = "doc_id", text: str = "text", label: str = "grade", per_grade: int = 3000,
    most_features: int = 4000, least_rows: int = 5, sparsity: float = 2e-4, rounds: int = 600,
) -> ToxicityModel:
    """Learn from about ``per_grade`` documents of each grade 0, 1, 2 ..., whole texts; null grades are left out.

    Grades may have gaps: a severity is the expected grade, and a grade is one of those learned from.

    Unless documents of grade 0 and above are known, every document gets grade 0.
    """
    known = labels.select(id_column, F.col(label).cast("int").alias("label")).filter("label >= 0")
    chosen = F.broadcast(sample_per_label(known, "label", per_grade, id_column))  # bounded: per_grade rows a grade
    texts = docs.select(id_column, F.coalesce(text, F.lit("")).alias("text"))
    sample = settle(texts.join(chosen, id_column).select("label", "text"), "toxicity-sample")
    if sample.select(F.col("label") > 0).distinct().count() < 2:  # nothing to tell apart: all documents get grade 0
        return ToxicityModel(np.zeros(0, np.int64), np.zeros(0), np.array([np.inf]), np.array([0.0, 1.0]))
    features = np.array(telling(sample, most_features, least_rows), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [sorted(text_features(t)) for t in batch.column("text").to_pylist()]
            found = [np.flatnonzero(np.isin(features, o)).astype("<u4").tobytes() for o in own]
            yield pa.record_batch([batch.column("label"), pa.array(found, pa.binary())], names=["label", "own"])

    rows = sample.mapInArrow(run, "label int, own binary").collect()  # bounded: per_grade rows a grade, most_features each
    rows.sort()
    grades = sorted({r["label"] for r in rows})
    y = np.array([grades.index(r["label"]) for r in rows])
    x = np.zeros((len(rows), len(features)), np.float32)
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r["own"], "<u4")] = 1
    weights, thresholds = fit(x, y, len(grades), sparsity, rounds)
    return ToxicityModel(features, weights, thresholds, np.array(grades, np.float64))


def fit(x: np.ndarray, y: np.ndarray, grades: int, sparsity: float, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by accelerated proximal gradient descent; most weights become zero.

    Every grade has the same total weight, so that rare grades count.
    """
    balance = np.array([len(y) / grades / max((y == g).sum(), 1) for g in range(grades)])[y]
    rate = 4.0 / max(float((x.astype(np.float64) ** 2).sum(1).mean()), 1.0)
    weights, thresholds = np.zeros(x.shape[1]), np.linspace(-0.5, 0.5, grades - 1) if grades > 2 else np.zeros(grades - 1)
    ahead, last = weights.copy(), weights.copy()
    for round_ in range(rounds):
        s = x @ ahead.astype(np.float32)
        low = np.concatenate([[-np.inf], thresholds])[y]
        high = np.concatenate([thresholds, [np.inf]])[y]
        up, down = 1 / (1 + np.exp(np.clip(low - s, -500, 500))), 1 / (1 + np.exp(np.clip(high - s, -500, 500)))
        chance = np.maximum(up - down, 1e-12)  # of the own grade
        slope = balance * (up * (1 - up) - down * (1 - down)) / chance / len(y)
        edge = [
            -np.sum((balance * up * (1 - up) / chance)[y == k + 1]) + np.sum((balance * down * (1 - down) / chance)[y == k])
            for k in range(grades - 1)
        ]
        thresholds = np.maximum.accumulate(thresholds + 2.0 * np.array(edge) / len(y))
        step = ahead + rate * (x.T @ slope.astype(np.float32))
        weights = np.sign(step) * np.maximum(np.abs(step) - rate * sparsity, 0)
        ahead = weights + round_ / (round_ + 3) * (weights - last)
        last = weights.copy()
    return weights, thresholds
