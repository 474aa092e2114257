"""Packing documents into token windows by minimum bin slack.

Each task packs the documents of its partition, pool by pool: documents longer than a window
give full windows and one remainder, and the remainders are items. For the longest item left, a
dynamic program over subset sums, held as the bits of one integer, finds the multiset of further
lengths that fills the window closest to its capacity; walking back through the program's
states gives how many items of each length it takes, and the same multiset fills windows as
often as the counts allow. Nothing is shuffled, and a pool is bounded, so memory is too.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Generator, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.vocab import encoder

#: Tokens and rows that a task packs together; beyond either it starts a new pool. Empty texts have one token each.
POOL_TOKENS, POOL_ROWS = 4_000_000, 100_000
#: Sequences that a partition may number; more are refused.
PARTITION_SEQUENCES = 1 << 40

PIECES = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, padded_to long"


def fill(counts: dict[int, int], room: int, fitting: list[int] | None = None) -> dict[int, int]:
    """How many items of each length sum up to the most that fits into ``room``.

    ``fitting`` are the lengths of at most ``room``, ascending, if they are known already.
    Bit s of ``reach`` tells whether some items sum up to s. Counts go in as powers of two, so
    each length takes a logarithmic number of steps, and the program ends once ``room`` itself
    is reached.
    """
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in reversed(sorted(n for n in counts if n <= room) if fitting is None else fitting):
        left, times = min(counts[length], room // length), 1
        while left and not reach >> room & 1:
            times = min(times, left)
            steps.append((length, times, reach))
            reach |= reach << length * times & mask
            left, times = left - times, times * 2
        if reach >> room & 1:
            break
    best, taken = reach.bit_length() - 1, {}
    for length, times, before in reversed(steps):
        if not before >> best & 1:  # only with this step is the sum reached
            best -= length * times
            taken[length] = taken.get(length, 0) + times
    return taken


def windows(lengths: list[int], capacity: int, slack: int) -> tuple[list[list[int]], list[int]]:
    """Windows as lists of items, each filled up to ``slack``, and the items that fit no such window."""
    items: dict[int, list[int]] = {}
    for item in range(len(lengths) - 1, -1, -1):
        items.setdefault(lengths[item], []).append(item)
    order = sorted(items)
    counts = {n: len(own) for n, own in items.items()}
    filled: list[list[int]] = []
    rest: list[int] = []
    while order:
        longest = order[-1]
        room = capacity - longest
        counts[longest] -= 1
        taken = fill(counts, room, order[: bisect_right(order, room)])
        counts[longest] += 1
        taken[longest] = taken.get(longest, 0) + 1
        if capacity - sum(n * k for n, k in taken.items()) > slack:
            # later items are fewer, so no item of this length can do better
            rest += reversed(items.pop(longest))
            del counts[longest]
            order.pop()
            continue
        for _ in range(min(len(items[n]) // k for n, k in taken.items())):
            filled.append([items[n].pop() for n, k in sorted(taken.items(), reverse=True) for _ in range(k)])
        for n in taken:
            counts[n] = len(items[n])
            if not items[n]:
                del items[n], counts[n]
                order.remove(n)
    return filled, rest


def pack_pool(ids: list[np.ndarray], capacity: int, slack: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(document, start, length, sequence, offset, padded length) of each piece of a pool's documents."""
    sequence = 0
    items: list[tuple[int, int, int]] = []
    for doc, own in enumerate(ids):
        whole = len(own) - len(own) % capacity
        for start in range(0, whole, capacity):
            yield doc, start, capacity, sequence, 0, capacity
            sequence += 1
        if whole < len(own):
            items.append((doc, whole, len(own) - whole))
    filled, rest = windows([n for _, _, n in items], capacity, slack)
    for window in filled:
        offset = 0
        for doc, start, length in (items[i] for i in window):
            yield doc, start, length, sequence, offset, capacity
            offset += length
        sequence += 1
    # what no window takes whole is cut to fill windows, and at last powers of two, which need no padding
    left = sum(items[i][2] for i in rest)
    size, offset = 0, 0
    for doc, start, length in (items[i] for i in rest):
        while length:
            if offset == size:
                sequence, offset = sequence + (size > 0), 0
                size = capacity if left >= capacity else 1 << left.bit_length() - 1
            some = min(length, size - offset)
            yield doc, start, some, sequence, offset, size
            start, length, offset, left = start + some, length - some, offset + some, left - some


def pack(
    docs: DataFrame, tokenizer: str, *, capacity: int = 4096, slack: int = 64, end_id: int = 2,
    id_column: str = "doc_id", text: str = "text", pool_tokens: int = POOL_TOKENS, pool_rows: int = POOL_ROWS,
) -> DataFrame:
    """One row per piece of a document: which ids it holds (little-endian unsigned 32-bit), and where it lies.

    A document is the ids of its whole text and ``end_id``; a null text is empty. Only documents
    longer than ``capacity``, and items that leave more than ``slack`` of any window free, are
    cut. Repeated rows are packed as often as they occur, rows with a null id too; other columns
    are ignored whatever their names. Empty input gives no rows. Within a pool documents are
    taken in order of id and content, so a task run again packs alike. ``sequence_id`` is unique
    but not gapless: the bits from 40 on tell the partition. ``padded_to`` is the capacity or, for
    the last few sequences of a pool, a power of two that is filled exactly. A pool is closed at
    ``pool_tokens`` tokens or ``pool_rows`` rows, so a task holds no more, but for one text.
    """
    bare = docs.select(F.col(id_column).cast("long").alias(id_column), F.col(text).alias("text"))

    def pieces(keys: list, ids: list[np.ndarray], first: int) -> Generator[pa.RecordBatch, None, int]:
        order = sorted(range(len(ids)), key=lambda i: (keys[i] is not None, keys[i] or 0, len(ids[i]), zlib.crc32(ids[i])))
        ids = [ids[i] for i in order]
        keys = [keys[i] for i in order]
        found = pack_pool(ids, capacity, slack)
        highest = 0
        while some := list(islice(found, 5000)):
            doc, start, length, sequence, offset, padded = zip(*some, strict=True)
            highest = max(highest, *sequence, 0)
            yield pa.record_batch(
                [
                    pa.array([keys[d] for d in doc], pa.int64()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array([ids[d][a : a + n].tobytes() for d, a, n in zip(doc, start, length, strict=True)], pa.binary()),
                    pa.array([len(ids[d]) for d in doc], pa.int64()),
                    pa.array([first + s for s in sequence], pa.int64()),
                    pa.array(offset, pa.int64()),
                    pa.array(padded, pa.int64()),
                ],
                names=[id_column, "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "padded_to"],
            )
        return highest + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).ids
        end = np.array([end_id], "<u4")
        first = base = TaskContext.get().partitionId() * PARTITION_SEQUENCES
        keys: list = []
        ids: list[np.ndarray] = []
        held = 0
        rows = chain.from_iterable(_slices(batch) for batch in batches)
        for batch in rows:
            keys += batch.column(id_column).to_pylist()
            own = [np.concatenate([x, end]).astype("<u4") for x in encode(batch.column("text").to_pylist())]
            ids += own
            held += sum(map(len, own))
            if held >= pool_tokens or len(ids) >= pool_rows:
                first += yield from pieces(keys, ids, first)
                keys, ids, held = [], [], 0
                if first - base >= PARTITION_SEQUENCES:
                    raise OverflowError("more sequences in a partition than can be numbered")
        if ids:
            yield from pieces(keys, ids, first)

    return bare.mapInArrow(run, f"{id_column} long, {PIECES}")


def _slices(batch: pa.RecordBatch, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    return (batch.slice(start, rows) for start in range(0, batch.num_rows, rows))
