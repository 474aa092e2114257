"""Language identification by averaged subword embeddings.

A text is the average of the embeddings of its words' hashed character n-grams, and a linear
softmax tells its language. Embeddings and softmax are trained by stochastic gradient descent in
numpy on a bounded sample. On a calibration fold of the sample, a temperature makes the scores
honest and a threshold below which a prediction is rejected is chosen. As all is linear up to
the softmax, prediction needs only the product of embeddings and softmax, summed by word.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.fitting import WordTable, keep_rows, sample_per_label, trimmed
from tallymark.llm.resident import resident

UNKNOWN = "und"


def subwords(word: bytes, buckets: int) -> list[int]:
    """Buckets of the character 2- to 4-grams of a word with its borders, and of the word."""
    text = trimmed(word)
    if not text:
        return []
    text = f"<{text}>"
    grams = [text[i : i + n] for n in (2, 3, 4) for i in range(len(text) - n + 1)]
    return [zlib.crc32(g.encode()) % buckets for g in [*grams, text]]


@dataclass
class LanguageModel:
    languages: list[str]
    scores: np.ndarray  # of a bucket, by language
    bias: np.ndarray
    temperature: float
    reject_below: float

    @property
    def name(self) -> str:
        return f"{zlib.crc32(self.scores.tobytes()):x}-{zlib.crc32(self.bias.tobytes()):x}-{self.temperature}"

    def table(self) -> WordTable:
        """This worker's table of the words' score sums and numbers of n-grams."""
        return resident(("language", self.name), lambda: WordTable(len(self.languages) + 1, self._rows))

    def _rows(self, words: list[bytes]) -> np.ndarray:
        out = np.zeros((len(words), len(self.languages) + 1), np.float32)
        for row, word in zip(out, words, strict=True):
            found = subwords(word, len(self.scores))
            if found:
                row[:-1] = self.scores[found].sum(0)
                row[-1] = len(found)
        return out

    def predict(self, docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
        """Per row: its id, lang_pred, score (0 to 1) of the whole text, and accepted.

        A text that is null or has no letter is ``und`` with score 0 and never accepted. Repeated
        rows and null ids are kept; other columns are ignored whatever their names; empty input
        gives no rows.
        """
        bare = docs.select(F.col(id_column).alias(id_column), F.col(text).alias("text"))
        model = self

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sums = model.table().sums(batch.column("text").to_pylist())
                best, score = model.choose(sums)
                known = [*model.languages, UNKNOWN]
                lang = [known[i] if n else UNKNOWN for i, n in zip(best, sums[:, -1], strict=True)]
                accepted = model._accepts(sums)
                yield pa.record_batch(
                    [batch.column(id_column), pa.array(lang), pa.array(score), pa.array(accepted)],
                    names=[id_column, "lang_pred", "score", "accepted"],
                )

        kind = dict(bare.dtypes)[id_column]
        return bare.mapInArrow(run, f"{id_column} {kind}, lang_pred string, score double, accepted boolean")

    def filter(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """The rows whose text's language is accepted, with all their columns."""
        return keep_rows(docs, lambda texts: self._accepts(self.table().sums(texts)), text, start=self.table)

    def _accepts(self, sums: np.ndarray) -> np.ndarray:
        _, score = self.choose(sums)
        return (sums[:, -1] > 0) & (score >= self.reject_below) & bool(self.languages)

    def choose(self, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and probability of the likeliest language, from score sums and n-gram numbers."""
        if not self.languages:
            return np.zeros(len(sums), int), np.zeros(len(sums))
        logits = (sums[:, :-1] / np.maximum(sums[:, -1:], 1) + self.bias) / self.temperature
        chance = np.exp(logits - logits.max(1, keepdims=True))
        chance /= chance.sum(1, keepdims=True)
        return chance.argmax(1), np.where(sums[:, -1] > 0, chance.max(1), 0.0)


def train(
    labelled: DataFrame, *, id_column: str = "doc_id", text: str = "text", label: str = "lang", per_language: int = 1000,
    buckets: int = 1 << 13, size: int = 16, epochs: int = 12, rate: float = 0.5, rejected: float = 0.001, seed: int = 7,
) -> LanguageModel:
    """Learn from at most ``per_language`` documents of each language, whole texts; null labels are left out.

    A fifth of them is the calibration fold. ``reject_below`` is the score that the share
    ``rejected`` of its rightly predicted documents fails to reach, and of the whole sample's too. Without labelled texts every text is ``und``.
    """
    known = labelled.select(id_column, F.col(label).cast("string").alias("label"), F.col(text).alias("text"))
    known = known.filter("label is not null and text is not null")
    sample = sample_per_label(known, "label", per_language, id_column)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for words in ((t.lower().encode().split()) for t in batch.column("text").to_pylist()):
                found: dict[bytes, list[int]] = {w: subwords(w, buckets) for w in set(words)}
                own, times = np.unique([b for w in words for b in found[w]], return_counts=True)
                rows.append((own.astype("<u4").tobytes(), times.astype("<f4").tobytes()))
            own, times = zip(*rows, strict=True) if rows else ((), ())
            yield pa.record_batch(
                [batch.column("label"), batch.column("fold"), pa.array(own, pa.binary()), pa.array(times, pa.binary())],
                names=["label", "fold", "own", "times"],
            )

    fold = F.pmod(F.xxhash64(F.lit("calibrate"), id_column), F.lit(5)).alias("fold")
    rows = (
        sample.select("label", fold, "text").mapInArrow(features, "label string, fold long, own binary, times binary")
        .collect()  # bounded: per_language rows a language, at most `buckets` features each
    )
    rows.sort(key=lambda r: (r["label"], zlib.crc32(r["own"]), zlib.crc32(r["times"])))
    languages = sorted({r["label"] for r in rows})
    if not languages:  # nothing to learn from: every text is unknown
        return LanguageModel([], np.zeros((buckets, 0), np.float32), np.zeros(0, np.float32), 1.0, 0.0)
    target = np.array([languages.index(r["label"]) for r in rows])
    own = [np.frombuffer(r["own"], "<u4") for r in rows]
    times = [np.frombuffer(r["times"], "<f4") for r in rows]
    held = np.array([r["fold"] == 0 for r in rows]) & (len(rows) >= 50)

    rng = np.random.default_rng(seed)
    embedding = rng.normal(0, 1 / size, (buckets, size)).astype(np.float32)
    weight, bias = np.zeros((size, len(languages)), np.float32), np.zeros(len(languages), np.float32)

    def averaged(some: np.ndarray) -> np.ndarray:
        dense = np.zeros((len(some), buckets), np.float32)
        for i, r in enumerate(some):
            dense[i, own[r]] = times[r] / max(times[r].sum(), 1)
        return dense

    learn = np.flatnonzero(~held)
    batches = max(1, len(learn) // 32)
    for epoch in range(epochs):
        for some in np.array_split(rng.permutation(learn), batches):
            x = averaged(some)
            hidden = x @ embedding
            logits = hidden @ weight + bias
            chance = np.exp(logits - logits.max(1, keepdims=True))
            chance /= chance.sum(1, keepdims=True)
            chance[np.arange(len(some)), target[some]] -= 1
            step = rate * (1 - epoch / epochs)
            chance /= len(some)
            back = x.T @ (chance @ weight.T)
            weight -= step * hidden.T @ chance
            bias -= step * chance.sum(0)
            embedding -= step * buckets / 16 * back  # averages make each embedding's share of a gradient small
    model = LanguageModel(languages, embedding @ weight, bias, 1.0, 0.0)
    calibrate(model, own, times, target, np.flatnonzero(held) if held.any() else learn, rejected)
    # a small fold tells little of the lowest scores: no more of the whole sample may be rejected either
    _, score, right = judged(model, own, times, target, np.arange(len(rows)))
    model.reject_below = min(model.reject_below, lowest(score[right], rejected))
    return model


def judged(model: LanguageModel, own, times, target: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Score sums of some rows with their numbers of n-grams, scores, and whether the languages are right."""
    sums = np.array([[*(model.scores[own[r]] * times[r][:, None]).sum(0), times[r].sum()] for r in some])
    best, score = model.choose(sums)
    return sums, score, (best == target[some]) & (sums[:, -1] > 0)


def lowest(scores: np.ndarray, share: float) -> float:
    """The score below which at most this share of them lies; 0 if there are none."""
    return float(np.sort(scores)[int(share * len(scores))]) if len(scores) else 0.0


def calibrate(model: LanguageModel, own, times, target: np.ndarray, some: np.ndarray, rejected: float) -> None:
    """Choose temperature and threshold on the rows of the calibration fold."""
    sums = judged(model, own, times, target, some)[0]
    logits = sums[:, :-1] / np.maximum(sums[:, -1:], 1) + model.bias

    def loss(temperature: float) -> float:
        z = logits / temperature
        top = z.max(1)
        return float(np.mean(top + np.log(np.exp(z - top[:, None]).sum(1)) - z[np.arange(len(some)), target[some]]))

    model.temperature = float(min(np.geomspace(0.1, 10, 61), key=loss))
    _, score, right = judged(model, own, times, target, some)
    model.reject_below = lowest(score[right], rejected)
