"""Bounded samples of labelled rows, sums and quantiles over all rows, and sums over the words of whole texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.llm.resident import Places, release

#: Characters whose words are looked up together.
BATCH_CHARACTERS = 1_000_000


def fold(id_column: str, folds: int) -> Column:
    """The fold of a document: CRC-32 of its id as text, modulo the number of folds; null ids have none."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % folds


def sample_per_label(labelled: DataFrame, label: str, most: int, id_column: str = "doc_id") -> DataFrame:
    """About ``most`` rows of each label, those with the smallest hashes of the id; rows with equal ids go together.

    Labels' row counts tell which hashes can be among the smallest, so few rows are ranked, even
    of a label that most rows have; the rows themselves are filtered where they are read. What
    is broadcast has one row per label, of which a model holds weights too.
    """
    place = F.shiftrightunsigned(F.xxhash64(F.col(id_column)), 1)
    keys = labelled.select(F.col(label).alias("__label"), place.alias("__place"))
    counts = keys.groupBy("__label").agg(F.count("*").alias("__rows"))
    low = F.col("__place") / float(1 << 63) * F.col("__rows") <= 2.0 * most + 100
    ranked = keys.join(F.broadcast(counts), "__label").filter(low).withColumn(
        "__rank", F.row_number().over(Window.partitionBy("__label").orderBy("__place"))
    )
    ends = ranked.filter(F.col("__rank") <= most).groupBy("__label").agg(F.max("__place").alias("__end"))
    found = labelled.join(F.broadcast(ends), F.col(label) == F.col("__label")).filter(place <= F.col("__end"))
    return found.drop("__label", "__end")


def add_up(rows: DataFrame, part: Callable[[pa.RecordBatch], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """The sum over all rows of arrays of one shape that ``part`` makes of batches; the driver sees eight."""

    def merged(arrays: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for some in arrays:
            total += some
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], names=["total"])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return merged(part(batch) for batch in batches if batch.num_rows)

    def more(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return merged(np.frombuffer(one).reshape(shape) for batch in batches for one in batch.column("total").to_pylist())

    found = rows.mapInArrow(sums, "total binary").repartition(8).mapInArrow(more, "total binary").collect()
    return sum((np.frombuffer(r["total"]).reshape(shape) for r in found), np.zeros(shape))


def weighted_quantile(rows: DataFrame, value: str, weight: Column, share: float) -> float:
    """The smallest value up to which rows have that share of all weight, exactly; of no more than all, the largest.

    Values, doubles, are numbered in their order; 16 bits of the number are found at a time, by
    the weight of the rows that have them. Weights are positive and few, so equal ones are counted.
    """

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = (batch.column("value").to_numpy() + 0.0).view(np.int64)
            place = np.where(bits < 0, bits ^ np.int64((1 << 63) - 1), bits)
            yield pa.record_batch([pa.array(place), batch.column("weight")], names=["place", "weight"])

    bare = rows.select(F.col(value).alias("value"), weight.cast("double").alias("weight"))
    placed = bare.mapInArrow(numbers, "place long, weight double")
    below, wanted, prefix = 0.0, None, None
    for shift in (48, 32, 16, 0):
        some = placed if prefix is None else placed.filter(F.shiftright("place", shift + 16) == prefix)
        found: dict[int, float] = {}
        counted = some.groupBy(F.shiftright("place", shift).alias("digit"), "weight").count()
        for r in sorted(counted.collect()):
            found[r["digit"]] = found.get(r["digit"], 0.0) + r["weight"] * r["count"]
        digits = sorted(found)
        upto = below + np.cumsum([found[d] for d in digits])
        wanted = share * upto[-1] if wanted is None else wanted
        at = min(int(np.searchsorted(upto, wanted * (1 - 1e-12))), len(digits) - 1)
        below, prefix = (float(upto[at - 1]) if at else below), digits[at]
    bits = np.array([prefix], np.int64)
    return float(np.where(bits < 0, bits ^ np.int64((1 << 63) - 1), bits).view(np.float64)[0])


class WordTable:
    """A row of numbers per distinct word, computed once per worker, and sums of them by text.

    Words are kept up to a bound in bytes; then the table starts anew.
    """

    def __init__(self, width: int, rows: Callable[[list[bytes]], np.ndarray]):
        self.width, self.rows = width, rows
        self.start_anew()

    def start_anew(self) -> None:
        self.places, self.table, self.filled = Places(), np.zeros((1024, self.width), np.float32), 0

    def _learn(self) -> None:
        new = self.places.new
        if self.filled + len(new) > len(self.table):
            bigger = np.zeros((max(2 * len(self.table), self.filled + len(new)), self.width), np.float32)
            bigger[: self.filled] = self.table[: self.filled]
            self.table = bigger
        self.table[self.filled : self.filled + len(new)] = self.rows(new)
        self.filled += len(new)
        new.clear()

    def sums(self, texts: Sequence[str | None], once: bool = False) -> np.ndarray:
        """The sum of the rows of each text's words; with ``once``, of its distinct words."""
        out, some, size = [], [], 0
        for text in texts:
            some.append(text)
            size += len(text or "")
            if size >= BATCH_CHARACTERS:
                out.append(self._sums(some, once))
                some, size = [], 0
        if some or not out:
            out.append(self._sums(some, once))
        return np.concatenate(out)

    def _sums(self, texts: list[str | None], once: bool) -> np.ndarray:
        if self.places.full:
            self.start_anew()
        # words are bytes between ASCII white space, lower-cased
        split = [(t or "").lower().encode().split() for t in texts]
        if once:
            split = [set(words) for words in split]
        lengths = np.array([len(words) for words in split], np.int64)
        found = np.fromiter(map(self.places.__getitem__, chain.from_iterable(split)), np.int64, int(lengths.sum()))
        if self.places.new:
            self._learn()
        out = np.zeros((len(split), self.width))
        ends = np.cumsum(lengths)
        for i, (begin, end) in enumerate(zip(ends - lengths, ends, strict=True)):
            # a text at a time keeps the gathered rows small
            for at in range(begin, end, 200_000):
                out[i] += self.table[found[at : min(at + 200_000, end)]].sum(0, dtype=np.float64)
        return out


def trimmed(word: bytes) -> str:
    """A word without what surrounds its first and last letter; empty if it has none."""
    text = word.decode()
    if text.isalpha():
        return text
    letters = [i for i, c in enumerate(text) if c.isalpha()]
    return text[letters[0] : letters[-1] + 1] if letters else ""


def keep_rows(
    docs: DataFrame, keeps: Callable[[list[str | None]], Sequence[bool]], text: str = "text", start: Callable[[], object] = release
) -> DataFrame:
    """The rows whose texts ``keeps`` accepts, with all their columns; ``start`` is called when a task begins."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start()
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(keeps(batch.column(at).to_pylist()), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
