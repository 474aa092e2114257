"""Spelling variants of words: near words by k-d trees over letter-count vectors.

An edit of one letter changes a word's letter counts by two at most: a replaced letter moves one
count up and one down, a deleted one moves one down. So words are first collapsed to their
letters, a word's letters in order, and distinct letters are searched. Per word length a k-d
tree is fitted on a bounded sample; its leaves are the blocks that tasks get, and a vector goes
to every block whose region lies within reach of one edit. Within a block a tree over its own
vectors is searched, box by box, for a pair of lengths at a time: vectors of its own length, one
count up and one down, and of the length above, one count down. A hit tells which letter to
replace or to delete; whether the order of the letters fits is settled by making that edit in
each of the words and looking the result up among all words, by a join.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.resident import release
from tallymark.llm.shared import settle

#: Letters of words, as a class of a pattern: A to Z in both cases, and U+00C0 to U+00FF.
LETTERS = "A-Za-zÀ-ÿ"
#: The letters that are counted, each in its own place: upper-case A to Z are folded before.
COUNTED = [*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)]
PLACE = np.full(256, -1, np.int64)
PLACE[COUNTED] = np.arange(len(COUNTED))
#: Vectors on which the blocks are fitted, and the number of vectors that a block is to hold.
SAMPLE, BLOCK = 1 << 15, 4096
#: Vectors in a leaf of a block's own tree.
LEAF = 32
#: Words up to this length are looked up by their edits; longer ones are compared pair by pair.
LONGEST = 256
#: Words of equal letters that meet in one task of a join.
WORDS_PER_TASK = 20_000

Node = tuple[np.ndarray, np.ndarray, object, object, object]


def letter_runs(docs: DataFrame, least: int = 1, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, run) for every maximal run of letters of at least this length, with A-Z lowered."""
    runs = F.regexp_extract_all(F.col(text), F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))
    upper = "".join(map(chr, range(ord("A"), ord("Z") + 1)))
    found = docs.select(F.col(id_column).alias("doc_id"), F.explode(runs).alias("run"))
    return found.select("doc_id", F.translate("run", upper, upper.lower()).alias("run"))


def vectors(letters: list[str]) -> np.ndarray:
    """The letter counts of words, a row each."""
    flat = np.frombuffer("".join(letters).encode("latin-1"), np.uint8)
    rows = np.repeat(np.arange(len(letters)), [len(x) for x in letters])
    width = len(COUNTED)
    return np.bincount(rows * width + PLACE[flat], minlength=len(letters) * width).reshape(-1, width).astype(np.int32)


def regions(sample: np.ndarray, most: float, least: int = 8) -> Node:
    """A tree whose leaves, numbered from 0, divide all vectors, with about ``most`` of the sample's in each."""
    numbers = iter(range(len(sample) + 1))

    def node(own: np.ndarray, low: np.ndarray, high: np.ndarray) -> Node:
        if len(own) > max(most, 2 * least):
            spread = own.var(0)
            axis = int(spread.argmax())
            if spread[axis] > 0:
                cut = int(np.median(own[:, axis]))
                cut -= int((own[:, axis] <= cut).all())
                up, down = low.copy(), high.copy()
                up[axis], down[axis] = cut + 1, cut
                left = own[:, axis] <= cut
                return low, high, None, node(own[left], low, down), node(own[~left], up, high)
        return low, high, next(numbers), None, None

    width = len(COUNTED)
    return node(sample, np.zeros(width, np.int32), np.full(width, np.iinfo(np.int32).max, np.int32))


def tree(every: np.ndarray, own: np.ndarray) -> Node:
    """A k-d tree over some rows of distinct vectors, with tight boxes; leaves hold row numbers."""
    low, high = every[own].min(0), every[own].max(0)
    if len(own) <= LEAF:
        return low, high, own, None, None
    axis = int(every[own].var(0).argmax())
    values = every[own, axis]
    left = values <= np.median(values)
    if left.all():
        left = values < values.max()
    return low, high, None, tree(every, own[left]), tree(every, own[~left])


def reach(node: Node, wanted: np.ndarray, rows: np.ndarray, up: int, down: int) -> Iterator[tuple[np.ndarray, object]]:
    """Per leaf the rows of ``wanted`` from which its box lies at most so many letters up and down."""
    low, high, leaf, left, right = node
    own = wanted[rows]
    near = (np.maximum(low - own, 0).sum(1) <= up) & (np.maximum(own - high, 0).sum(1) <= down)
    rows = rows[near]
    if not len(rows):
        return
    if left is None:
        yield rows, leaf
        return
    yield from reach(left, wanted, rows, up, down)
    yield from reach(right, wanted, rows, up, down)


def hits(top: Node, held: np.ndarray, wanted: np.ndarray, up: int, down: int) -> Iterator[tuple[int, int]]:
    """Pairs of rows (of ``wanted``, of ``held``) that differ by exactly so many letters up and down."""
    for rows, leaf in reach(top, wanted, np.arange(len(wanted)), up, down):
        for start in range(0, len(rows), 2048):
            some = rows[start : start + 2048]
            apart = np.abs(held[leaf][None] - wanted[some][:, None]).sum(2)
            i, j = np.nonzero(apart == up + down)  # lengths are given, so the ups and downs are too
            yield from zip(some[i].tolist(), leaf[j].tolist(), strict=True)


def block_trees(places: DataFrame, sample: int, block: int) -> dict[int, Node]:
    """The tree of regions of each word length that needs more than one block, from a bounded sample of vectors."""
    share = min(1.0, sample / max(places.count(), 1))
    hash_ = F.shiftrightunsigned(F.xxhash64("letters"), 1) / float(1 << 63)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [v.tobytes() for v in vectors(batch.column("letters").to_pylist())]
            yield pa.record_batch([batch.column("length"), pa.array(found, pa.binary())], names=["length", "counts"])

    chosen = places.filter(hash_ < share).select("length", "letters").mapInArrow(count, "length int, counts binary")
    by_length: dict[int, list[np.ndarray]] = {}
    for row in chosen.collect():  # about `sample` rows, whatever the input
        by_length.setdefault(row["length"], []).append(np.frombuffer(row["counts"], np.int32))
    return {length: regions(np.array(own), block * share) for length, own in by_length.items() if len(own) > block * share}


def near_letters(places: DataFrame, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """(letters, lost, gained): an edit of some word of these letters may lead to another word.

    Of two sets of letters of one length only the first in order is given; of two lengths, the longer.
    """
    trees = block_trees(places, sample, block)
    whole = regions(np.zeros((0, len(COUNTED)), np.int32), 1)
    kept = places.sparkSession.sparkContext.broadcast(trees)  # at most sample / 8 leaves

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            letters = batch.column("letters").to_pylist()
            lengths = np.array([len(x) for x in letters], np.int64)
            counts = vectors(letters)
            for length in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == length)
                # a row meets vectors of its own length, and as the longer word those one letter shorter
                for role, at, up, down in (("held", length, 0, 0), ("same", length, 1, 1), ("longer", length - 1, 0, 1)):
                    for rows, leaf in reach(kept.value.get(at, whole), counts, own, up, down):
                        n = len(rows)
                        yield pa.record_batch(
                            [pa.array([at] * n, pa.int32()), pa.array([leaf] * n, pa.int32()), pa.array([role] * n),
                             pa.array([letters[r] for r in rows])],
                            names=["length", "block", "role", "letters"],
                        )

    def search(table: pa.Table) -> pa.Table:
        roles = np.array(table.column("role").to_pylist())
        letters = np.array(table.column("letters").to_pylist(), object)
        held = letters[roles == "held"].tolist()
        out: list[tuple[str, str, str]] = []
        if held:
            counts = vectors(held)
            top = tree(counts, np.arange(len(held)))
            for role, up, down in (("same", 1, 1), ("longer", 0, 1)):
                wanted = letters[roles == role].tolist()
                for i, j in hits(top, counts, vectors(wanted), up, down) if wanted else ():
                    if role == "longer" or wanted[i] < held[j]:
                        out.append((wanted[i], *changed(wanted[i], held[j])))
        return pa.table(list(zip(*out, strict=True)) or [[], [], []], schema=pa.schema([(c, pa.string()) for c in names]))

    names = ("letters", "lost", "gained")
    routed = places.select("letters").mapInArrow(route, "length int, block int, role string, letters string")
    return routed.groupBy("length", "block").applyInArrow(search, ", ".join(f"{c} string" for c in names))


def changed(one: str, two: str) -> tuple[str, str]:
    """The letter that the first has and the second lacks, and the reverse, empty if there is none."""
    a, b = Counter(one), Counter(two)
    return "".join(a - b), "".join(b - a)


def edits(word: str, lost: str, gained: str) -> Iterator[str]:
    """The distinct words that come of replacing one ``lost`` letter, or of deleting one."""
    at = word.find(lost)
    while at >= 0:
        yield word[:at] + gained + word[at + 1 :]
        after = at + 1
        if not gained:  # deleting any letter of a run gives the same word
            while after < len(word) and word[after] == lost:
                after += 1
        at = word.find(lost, after)


def one_edit(one: str, two: str) -> bool:
    """Whether two words of equal length, or a longer and a one letter shorter one, differ by one edit."""
    start = 0
    while start < len(two) and one[start] == two[start]:
        start += 1
    return start < len(one) and one[start + 1 :] == two[start + (len(one) == len(two)) :]


def near_pairs(words: DataFrame, places: DataFrame, name: str) -> DataFrame:
    """(word, n, near, near_n) for every unordered pair of near words, once."""
    found = near_letters(places)
    steps = found.groupBy("letters").agg(F.collect_list(F.struct("lost", "gained")).alias("steps"))  # 90 times the length at most
    steps = settle(steps.join(places, "letters"), f"{name}-steps")

    # words that share their letters may be many: these are dealt, and their steps go to each part
    parts = F.ceil(F.col("members") / WORDS_PER_TASK).cast("int")
    hot = places.filter(F.col("members") > WORDS_PER_TASK).select("letters", parts.alias("parts"))
    dealt = words.join(F.broadcast(hot), "letters", "left")  # at most a row for every WORDS_PER_TASK words
    dealt = dealt.withColumn("part", F.coalesce(F.pmod(F.xxhash64("word"), "parts"), F.lit(0)).cast("int"))
    spread = steps.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                some = batch.slice(start, 200)
                columns = (some.column(c).to_pylist() for c in ("word", "n", "steps"))
                out = [(w, n, e) for w, n, own in zip(*columns, strict=True) for s in own for e in edits(w, s["lost"], s["gained"])]
                yield pa.record_batch(
                    [pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else ([], [], []), kinds, strict=True)],
                    names=["word", "n", "near"],
                )

    kinds = (pa.string(), pa.int64(), pa.string())
    short = F.col("length") <= LONGEST
    tried = dealt.join(spread.filter(short), ["letters", "part"]).select("word", "n", "steps")
    tried = tried.mapInArrow(edit, "word string, n long, near string")
    known = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    return tried.join(known, "near").select("word", "n", "near", "near_n").union(long_pairs(words, steps.filter(~short)))


def long_pairs(words: DataFrame, steps: DataFrame) -> DataFrame:
    """The same for words whose edits would be too long to write out: words of near letters are compared."""
    one = steps.select("letters", F.explode("steps").alias("step"))
    other = F.array_join(F.array_sort(F.split(F.concat(F.expr(
        "substr(letters, 1, instr(letters, step.lost) - 1) || substr(letters, instr(letters, step.lost) + 1)"
    ), "step.gained"), "")), "")
    pairs = one.select("letters", other.alias("others")).join(words, "letters").select("word", "n", "others")
    held = words.select(F.col("letters").alias("others"), F.col("word").alias("near"), F.col("n").alias("near_n"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = zip(batch.column("word").to_pylist(), batch.column("near").to_pylist(), strict=True)
            yield batch.filter(pa.array([one_edit(*e) for e in ends], pa.bool_()))

    both = pairs.join(held, "others").select("word", "n", "near", "near_n")
    return both.mapInArrow(check, "word string, n long, near string, near_n long")


def variants(words: DataFrame, *, ratio: int = 5, word: str = "word", n: str = "n") -> DataFrame:
    """Per distinct word: n, n_near, form, form_n and root.

    Two words are near if they differ by exactly one inserted, deleted or replaced letter.
    ``n_near`` counts a word's near words; its ``form`` is the near word of largest n, of equal
    ones the first in code-point order, if that n is at least ``ratio`` times its own; else it is
    null, as form_n is. ``root`` follows the forms from a word to the last one; a word without
    a form is its own root. Rows with a null word, or an n that is null or below 1, are left out, and the n of
    repeated words are summed. A word that holds anything but lower-case letters a to z and U+00C0 to U+00FF,
    or nothing, is near no word. Other columns are ignored whatever their names; empty input
    gives no rows. Words of more than 256 letters are compared pair by pair with those of near
    letters, shorter ones looked up; no pair is left out.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more, or forms could lead in circles")
    known = words.select(F.col(word).alias("word"), F.col(n).cast("long").alias("n")).filter("word is not null and n > 0")
    known = known.groupBy("word").agg(F.sum("n").alias("n"))
    letters = F.when(F.col("word").rlike("^[a-zÀ-ÿ]+$"), F.array_join(F.array_sort(F.split("word", "")), ""))
    known = settle(known.withColumn("letters", letters), "spelling-words")
    lettered = known.filter("letters is not null")
    places = lettered.groupBy("letters").agg(F.count("*").alias("members"))
    places = settle(places.withColumn("length", F.length("letters")), "spelling-letters")

    pairs = settle(near_pairs(lettered, places, "spelling"), "spelling-pairs")
    near = pairs.union(pairs.select("near", "near_n", "word", "n")).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct(-F.col("near_n"), "near")).alias("best")
    )
    near = near.select("word", "n_near", F.col("best.near").alias("form"), (-F.col("best.col1")).alias("form_n"))
    far = F.coalesce(F.col("form_n") >= ratio * F.col("n"), F.lit(False))
    found = known.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        *(F.when(far, F.col(c)).alias(c) for c in ("form", "form_n")),
    )
    found = settle(found, "spelling-forms")

    # every step multiplies n, so a path is short; each round doubles how far words have followed theirs
    steps = settle(found.filter("form is not null").select("word", F.col("form").alias("root")), "spelling-steps-0")
    most = found.agg(F.max("n"), F.min("n")).first()
    length, reached = 0, max(most[1] or 1, 1)
    while ratio > 1 and reached * ratio <= (most[0] or 0):
        reached, length = reached * ratio, length + 1
    for round_ in range(max(length - 1, 0).bit_length()):
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        steps = settle(steps.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")), f"spelling-steps-{round_ + 1}")
    return found.join(steps, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
