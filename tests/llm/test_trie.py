"""The prefix trie of conversations against a trie of plain dictionaries."""

import random
from hashlib import sha256
from zlib import crc32

import pytest
from fixtures import rows_of
from pyspark.sql import functions as F

from tallymark.llm import conversation_trie, queries

SCHEMA = "conv_id long, turn int, role string, text string"
FOLDER = "/root/testdata/sf0.01"


def words(text: str) -> int:
    return len(text.encode().split())


def brute(rows) -> list[tuple]:
    """All nodes, by walking up and down a trie in memory."""
    turns: dict[int, list] = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            turns.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    plain = {c: [t[2:] for t in sorted(own)] for c, own in turns.items()}
    built = {}
    for c, own in plain.items():
        h = crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        built[c] = plain.get(base, [])[:h] + own[h:]
    members: dict[tuple, list[int]] = {}
    for c, own in built.items():
        for d in range(len(own) + 1):
            members.setdefault(tuple(own[:d]), []).append(c)
    below: dict[tuple, list[tuple]] = {}
    for node in members:
        for d in range(len(node) + 1):
            below.setdefault(node[:d], []).append(node)
    children: dict[tuple, int] = {}
    for node in members:
        if node:
            children[node[:-1]] = children.get(node[:-1], 0) + 1
    out = []
    for node, own in members.items():
        saved = sum((len(members[x]) - 1) * words(x[-1][1]) for x in below[node] if x)
        leaves = sum(not children.get(x) for x in below[node])
        ends = ",".join(str(c) for c in sorted(own) if len(built[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(own), len(node), parent, len(own), children.get(node, 0), leaves, saved, sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(spark, rows, tmp_path, change=lambda df: df):
    change(spark.createDataFrame(rows, SCHEMA)).write.parquet(f"{tmp_path}/conversations.parquet")
    return rows_of(queries.op13_prefix_trie(spark, str(tmp_path)).select(conversation_trie.OUT))


def some_rows(seed: int, convs: int = 90) -> list[tuple]:
    chance = random.Random(seed)
    out = []
    for _ in range(convs):
        c = chance.randrange(-50, 400)
        for turn in range(chance.choice((0, 1, 1, 2, 3, 5, 9))):
            out.append((c, chance.choice((turn, turn, turn, None)), chance.choice(("user", "bot", None)), chance.choice(("a b", "a  c d", "", None))))
    return out


def test_query_on_the_given_table(spark):
    rows = [tuple(r) for r in queries.table(spark, FOLDER, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(queries.op13_prefix_trie(spark, FOLDER).select(conversation_trie.OUT)) == brute(rows)


@pytest.mark.parametrize("seed", range(3))
def test_random_conversations(spark, seed, tmp_path):
    rows = some_rows(seed)
    assert found(spark, rows, tmp_path) == brute(rows)


def test_a_sketch_that_proves_little(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(conversation_trie, "MOST_CELLS", 512)  # most estimates of single beginnings are above one
    rows = some_rows(7, 400)
    assert found(spark, rows, tmp_path) == brute(rows)


def test_hot_conversations(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(conversation_trie, "IDS_TOGETHER", 3)
    rows = [(7, t, "user", f"turn {t % 5}") for t in range(600)]  # most rows belong to one conversation
    rows += [(9, t, "user", f"turn {t % 5}") for t in range(500)]
    rows += [(c, t, "bot", f"same {t}") for c in range(100, 260) for t in range(2)]  # copies of one
    assert found(spark, rows, tmp_path) == brute(rows)


def test_hot_parents(spark, tmp_path, monkeypatch):
    original = conversation_trie.with_parent
    monkeypatch.setattr(conversation_trie, "with_parent", lambda rows, nodes, most: original(rows, nodes, 2))
    rows = some_rows(11)
    assert found(spark, rows, tmp_path) == brute(rows)


def test_nulls_ties_and_repeated_rows(spark, tmp_path):
    rows = [
        (20, 1, "u", "x"), (20, 1, "u", "x"), (20, 1, "a", "x"), (20, None, "u", "last written, first read"), (21, 5, None, None),
        (21, 6, "", ""), (None, 1, "u", "no conversation"), (22, 1, "u", "x"), (23, 1, "ux", ""), (24, 1, "u", "x"), (-3, 1, "u", "x"),
        (25, 1, "u", "word " * 50_000), (45, 1, "u", "word " * 50_000),
    ]
    assert found(spark, rows, tmp_path, lambda df: df.repartition(5)) == brute(rows)


def test_other_columns_do_not_matter(spark, tmp_path):
    rows = some_rows(5, 20)
    names = ("digest", "prev", "place", "depth", "words", "key", "last", "piece", "n_convs", "base", "part")
    assert found(spark, rows, tmp_path, lambda df: df.select("*", *(F.lit("x").alias(n) for n in names))) == brute(rows)


def test_empty(spark, tmp_path):
    assert found(spark, [], tmp_path) == []


def test_a_single_turn(spark, tmp_path):
    assert found(spark, [(1, 1, "u", "x")], tmp_path) == brute([(1, 1, "u", "x")])
