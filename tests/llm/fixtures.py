"""Small tables with the awkward rows that every operator has to take."""

from __future__ import annotations

import random

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"

WORDS = "the of and to in is it that was for on are with as his they be at one have this from by hot word but what".split()


def prose(seed: int, words: int) -> str:
    chance = random.Random(seed)
    return " ".join(chance.choice(WORDS) + str(chance.randrange(40)) for _ in range(words))


def awkward(spark):
    """Nulls in every column, empty and blank texts, one word, a very long text, copies, near copies, repeated rows."""
    base = prose(1, 120)
    near = base.replace(base.split()[60], "changed", 1)
    rows = [
        (1, base, "en", "a", 9),
        (2, base, "en", "a", 9),
        (2, base, "en", "a", 9),
        (3, near, "en", None, None),
        (4, None, None, None, None),
        (5, "", "en", "b", 0),
        (6, " \t\n ", "en", "b", 3),
        (7, "Word", "en", "b", 4),
        (8, "word", "fr", "b", 4),
        (9, "four words in all", "en", "c", 17),
        (10, "FOUR words\tin all", "en", "c", 17),
        (11, prose(2, 30_000), "en", "c", None),
        (12, "été où ça <|endoftext|> don't ​́ 1234,5", "fr", "é", None),
        (None, prose(3, 50), "en", "a", 1),
        (None, None, None, None, None),
        (13, "!!! ... 123 ???", "en", "a", 5),
    ]
    return spark.createDataFrame(rows, DOCUMENTS)


def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)


def clashing(docs):
    """The same rows with further columns that are named like results and helpers."""
    names = "n size hash copies taken target prefix gid set_id score kept fold label node vector rank content n_tokens start ids"
    from pyspark.sql import functions as F

    return docs.select("*", *(F.lit("x").alias(n) for n in names.split()))


def rows_of(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
