"""Quality scores by Bradley-Terry pairwise ranking.

A score is learned from preference pairs, a document labelled good before one labelled bad: the
logistic loss on the difference of their features is least when preferred documents score
higher. All labelled documents and all their pairs count: a document's share in the loss depends
on its own score and on how the other label's scores are spread, so sums over documents do. A
quantile of the scores is the threshold, and a logistic scale makes scores numbers from 0 to 1
in which the threshold has a stated place. Features describe the form of a whole text, not its
words, so they hold for any language.
"""

from __future__ import annotations

import string
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from operator import eq, lt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.fitting import add_up, keep_rows, weighted_quantile
from tallymark.llm.shared import settle

UPPER = string.ascii_uppercase.encode()
DIGITS = string.digits.encode()
SIGNS = string.punctuation.encode()
MARKS = b",.;:!?"

FEATURES = 18
#: Standardised features and what they exceed their knots by.
BENT = 8 * FEATURES
KNOTS = np.array([0.02, 0.1, 0.3, 0.5, 0.7, 0.9, 0.98])
#: Cells in which knots are sought, scores counted, and scores' curvature is taken as one.
KNOT_CELLS, SCORE_CELLS, CURVE_CELLS = 4096, 8192, 128


def describe(text: str | None) -> list[float]:
    """The features of a text; a null text is empty."""
    raw = (text or "").encode()
    words = raw.split()
    n, size = len(words), max(len(raw), 1)
    some = max(n, 1)
    lower = [w.lower() for w in words]
    distinct = set(lower)
    count = lambda kind: len(raw) - len(raw.translate(None, kind))
    upper, digits, signs, marks = count(UPPER), count(DIGITS), count(SIGNS), count(MARKS)
    lines = raw.split(b"\n")
    lengths = list(map(len, words))
    return [
        float(np.log1p(n)),
        len(raw) / some if n else 0.0,
        upper / size,
        digits / size,
        (signs - marks) / size,
        marks / some,
        raw.count(b"!") / some,
        raw.count(b"|") / some,
        len(distinct) / some,
        float(np.log1p(n) - np.log1p(len(distinct))),
        sum(map(eq, lower[1:], lower)) / some,
        sum(map(eq, lower[2:], lower)) / some,
        len(lines) / some,
        1 - len(set(lines)) / len(lines),
        sum(map(lt, lengths, [4] * n)) / some,
        max(lengths, default=0) / 50,
        sum(map(bytes.isupper, words)) / some,
        float(n == 0),
    ]


@dataclass
class QualityModel:
    middle: np.ndarray
    spread: np.ndarray
    knots: np.ndarray  # per feature, the quantiles from which it may bend
    weight: np.ndarray
    threshold: float  # the quantile of raw scores at which documents are rejected
    scale: float
    place: float  # of the threshold among the scores from 0 to 1

    def bent(self, features: np.ndarray) -> np.ndarray:
        """Standardised features, and what each exceeds its knots by."""
        x = np.clip((features - self.middle) / self.spread, -8, 8)
        return np.concatenate([x, *(np.maximum(x - k, 0) for k in self.knots)], axis=1)

    def scores(self, features: np.ndarray) -> np.ndarray:
        over = self.scale * (self.bent(features) @ self.weight - self.threshold)
        # at the threshold exactly its place, whatever the rounding
        return self.place / (self.place + (1 - self.place) * np.exp(-np.clip(over, -500, 500)))

    def score(self, docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
        """Per row: its id, score of the whole text from 0 to 1, and kept (the score reaches the threshold).

        A null text scores as an empty one. Repeated rows and null ids are kept; other columns
        are ignored whatever their names; empty input gives no rows.
        """
        bare = docs.select(F.col(id_column).alias(id_column), F.col(text).alias("text"))
        model = self

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                score = model.scores(np.array([describe(t) for t in batch.column("text").to_pylist()]))
                yield pa.record_batch(
                    [batch.column(id_column), pa.array(score), pa.array(score >= model.place)],
                    names=[id_column, "score", "kept"],
                )

        return bare.mapInArrow(run, f"{id_column} {dict(bare.dtypes)[id_column]}, score double, kept boolean")

    def filter(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """The rows whose score reaches the threshold, with all their columns."""
        return keep_rows(docs, lambda texts: self.scores(np.array([describe(t) for t in texts])) >= self.place, text)


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of described rows."""
    return batch.column("features").flatten().to_numpy().reshape(-1, FEATURES), batch.column("label").to_numpy()


def descend(described: DataFrame, model: QualityModel, middle: np.ndarray, ridge: float, rounds: int = 30) -> np.ndarray:
    """Weights of least mean logistic loss over all pairs of a row of label 1 and one of label 0.

    Newton's steps. Each counts the scores of both labels in cells, from which the mean chance
    that a row's preference is missed follows as a function of its score; one more pass sums up
    slope and curvature. ``middle`` is taken from all rows, which changes no difference.
    """
    weight = np.zeros(BENT)
    for _ in range(rounds):

        def scored(batch: pa.RecordBatch, weight=weight) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            features, label = _rows(batch)
            x = model.bent(features) - middle
            return x, x @ weight, label

        # a feature adds its least and most where its line bends or ends
        ends = np.full((1, FEATURES), 8.0)
        added = (model.bent(np.concatenate([-ends, model.knots, ends])) * weight).reshape(-1, 8, FEATURES).sum(1)
        least, most = added.min(0).sum() - middle @ weight, added.max(0).sum() - middle @ weight
        cells = min(SCORE_CELLS, int(32 * (most - least)) + 1)
        scale = cells / max(most - least, 1e-9)

        def count(batch: pa.RecordBatch, scored=scored, least=least, scale=scale, cells=cells) -> np.ndarray:
            _, score, label = scored(batch)
            cell = np.clip(((score - least) * scale).astype(int), 0, cells - 1) + cells * label
            return np.stack([np.bincount(cell, w, 2 * cells) for w in (None, score)])

        rows, total = add_up(described, count, (2, 2 * cells)).reshape(2, 2, cells)
        mean = total / np.maximum(rows, 1)
        n = rows.sum(1)
        bad, good = (mean[y][rows[y] > 0] for y in (0, 1))
        shares = [rows[y][rows[y] > 0] / n[y] for y in (0, 1)]
        low, high = min(bad.min(), good.min()), max(bad.max(), good.max())
        # how often a row of each label is on the wrong side of the other's rows, by its score
        at = np.linspace(low, high, max(2, min(4096, int((high - low) * 32) + 2)))
        missed = [chance(good[None] - at[:, None]) @ shares[1], chance(at[:, None] - bad[None]) @ shares[0]]
        width = max((high - low) / CURVE_CELLS, 1e-9)
        cell_of = lambda score, low=low, width=width: np.clip(((score - low) / width).astype(int), 0, CURVE_CELLS - 1)
        held = np.zeros((2, CURVE_CELLS))
        for y, some in ((0, bad), (1, good)):
            np.add.at(held[y], cell_of(some), shares[y])
        stand = low + width * (np.arange(CURVE_CELLS) + 0.5)
        both = chance(stand[:, None] - stand[None])
        both *= 1 - both  # by cells of label 1, then of label 0
        bend = np.stack([held[1] @ both, both @ held[0]])

        def sums(batch: pa.RecordBatch, scored=scored, at=at, missed=missed, cell_of=cell_of, bend=bend, n=n) -> np.ndarray:
            x, score, label = scored(batch)
            cell = cell_of(score)
            wrong = np.where(label == 1, np.interp(score, at, missed[1]), -np.interp(score, at, missed[0])) / n[label]
            curve = (x * (bend[label, cell] / n[label])[:, None]).T @ x
            member = np.zeros((len(x), 2 * CURVE_CELLS))
            member[np.arange(len(x)), cell + CURVE_CELLS * label] = 1 / n[label]
            return np.concatenate([(wrong @ x)[None], curve, member.T @ x])

        found = add_up(described, sums, (1 + BENT + 2 * CURVE_CELLS, BENT))
        slope = found[0] - ridge * weight
        bad_sums, good_sums = found[1 + BENT :].reshape(2, CURVE_CELLS, BENT)
        cross = good_sums.T @ both @ bad_sums
        step = np.linalg.solve(found[1 : 1 + BENT] - cross - cross.T + ridge * np.eye(BENT), slope)
        weight = weight + step
        if slope @ step < 1e-7:
            break
    return weight


def chance(ahead: np.ndarray) -> np.ndarray:
    """The chance that a row that scores higher by ``ahead`` is the worse one."""
    return 1 / (1 + np.exp(np.clip(ahead, -500, 500)))


def train(
    docs: DataFrame, labels: DataFrame, *, id_column: str = "doc_id", text: str = "text", label: str = "quality",
    place: float = 0.3, rejected: float | None = None, ridge: float = 1e-3,
) -> QualityModel:
    """Learn from all documents of label 1 and of label 0, whole texts.

    All pairs of a document of each label are preferences. The threshold is the quantile of
    scores below which the share ``rejected`` of labelled documents lies (by default the share
    labelled 0, over all labelled rows); it gets the score ``place``. Null labels are left out.
    Without documents of both labels every document gets the score ``place`` and is kept. Knots
    are quantiles told to 1/256 of a feature's spread. Features are computed before labels are
    joined, so no text is shuffled, and are written to the shared folder, where each step reads
    them anew; the driver sees sums and counts by cell only.
    """
    known = labels.select(id_column, F.col(label).cast("int").alias("label")).filter(F.col("label").isin(0, 1))
    bare = docs.select(F.col(id_column).alias(id_column), F.col(text).alias("text")).filter(F.col(id_column).isNotNull())

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [describe(t) for t in batch.column("text").to_pylist()]
            yield pa.record_batch(
                [batch.column(id_column), pa.array(found, pa.list_(pa.float64()))], names=[id_column, "features"]
            )

    every = bare.mapInArrow(features, f"{id_column} {dict(bare.dtypes)[id_column]}, features array<double>")
    described = settle(every.join(known, id_column).select("label", "features"), "quality-features")

    def whole(batch: pa.RecordBatch) -> np.ndarray:
        x, y = _rows(batch)
        return np.stack([np.append(x[y == k].sum(0), (y == k).sum()) for k in (0, 1)])

    found = add_up(described, whole, (2, FEATURES + 1))
    n = found[:, -1]
    if not n.all():  # no preference is known: all documents get the threshold's score and are kept
        return QualityModel(np.zeros(FEATURES), np.ones(FEATURES), np.zeros((0, FEATURES)), np.zeros(FEATURES), 0.0, 1.0, place)
    totals = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if rejected is None:
        rejected = totals[0] / (totals[0] + totals[1])
    # documents may lack, or repeat, ids of labelled rows
    share = np.array([totals[0], totals[1]]) / n

    middle = found[:, :-1].sum(0) / n.sum()
    square = add_up(described, lambda batch: ((_rows(batch)[0] - middle) ** 2).sum(0), (FEATURES,))
    spread = np.sqrt(square / n.sum())
    spread = np.where(spread > 1e-9 * np.maximum(np.abs(middle), 1), spread, 1.0)
    model = QualityModel(middle, spread, np.zeros((0, FEATURES)), np.zeros(FEATURES), 0, 1, place)

    def cells(batch: pa.RecordBatch) -> np.ndarray:
        cell = ((model.bent(_rows(batch)[0]) + 8) / 16 * KNOT_CELLS).astype(int).clip(0, KNOT_CELLS - 1)
        return np.stack([np.bincount(own, minlength=KNOT_CELLS) for own in cell.T])

    counts = add_up(described, cells, (FEATURES, KNOT_CELLS))
    stands = (np.arange(KNOT_CELLS) + 0.5) / KNOT_CELLS * 16 - 8
    upto = np.cumsum(counts, axis=1) / n.sum()
    knots = np.stack([stands[np.searchsorted(own, KNOTS - 1e-12)] for own in upto], axis=1)
    bent = QualityModel(np.zeros(FEATURES), np.ones(FEATURES), knots, np.zeros(0), 0, 1, place).bent
    centre = (bent(np.repeat(stands[:, None], FEATURES, 1)) * np.tile(counts.T, (1, 8))).sum(0) / n.sum()
    model.knots = knots
    model.weight = descend(described, model, centre, ridge)

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, _ = _rows(batch)
            yield pa.record_batch([batch.column("label"), pa.array(model.bent(x) @ model.weight)], names=["label", "raw"])

    scored = settle(described.mapInArrow(raw, "label int, raw double"), "quality-scores")
    model.threshold = weighted_quantile(scored, "raw", F.when(F.col("label") == 1, share[1]).otherwise(share[0]), rejected)
    # the scale for which the scores of labelled documents are likeliest, given the threshold's place
    offset, scales = np.log(place / (1 - place)), np.geomspace(0.05, 20, 81)

    def losses(batch: pa.RecordBatch) -> np.ndarray:
        y, over = batch.column("label").to_numpy(), batch.column("raw").to_numpy() - model.threshold
        sign = np.where(y == 1, -1.0, 1.0)
        return np.array([np.sum(share[y] * np.logaddexp(0, sign * (scale * over + offset))) for scale in scales])

    model.scale = float(scales[np.argmin(add_up(scored, losses, (len(scales),)))])
    return model
