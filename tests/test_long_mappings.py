"""Conditional mappings too long to write inline give what the short form gives."""

import time

import pytest
from helpers import column, frame

from tallymark.operators import mapping as M
from tallymark.plans.spec import ConditionalMapping

ROWS = [
    (1, "a", 1, 1.5, True), (2, "a", 2, None, False), (3, "b", 1, 0.0, None), (4, None, 1, -0.0, True), (5, "b", None, 2.0, False), (6, "5", 5, 5.0, True),
]
SCHEMA = "id int, cond string, old int, num double, flag boolean"


def made(mappings, kind="equals", value=None):
    return ConditionalMapping(condition_field="cond", mappings=mappings, condition_type=kind, condition_value=value)


CASES = {
    "keyed": ("old", "cond", made({"a": {1: 10, 2: None}, "b": {1: 30}, 5: {1: 99}})),
    "later case wins": ("old", "num", made({1.5: {1: 10}, 0: {1: 20}, 0.0: {1: 30}, 2: {7: 1}})),
    "to text": ("old", "cond", made({"a": {1: "one"}, "b": {1: 2.5}})),
    "to fractions": ("old", "cond", made({"a": {1: 0.5}, "b": {1: 2}})),
    "text column": ("cond", "old", made({1: {"a": "x", "b": None}, 5: {"5": "five"}})),
    "flag as condition": ("cond", "flag", made({True: {"a": "yes"}, 0: {"a": "no"}})),
    "typed": ("old", "cond", made({"default": {1: 10, 2: None, 5: 7}}, "contains", "a")),
    "typed negation": ("old", "cond", made({"default": {1: 10, 2: None, 5: 7}}, "not_contains", "a")),
    "typed null": ("old", "cond", made({"default": {1: 10}}, "is_null")),
    "no number": ("old", "num", made({"default": {1: 10}}, "greater_than", "x")),
    "itself as condition": ("old", "old", made({1: {1: 2}, 2: {2: 1}})),
    "nothing fits": ("old", "cond", made({"a": {"text": 1}})),
}


@pytest.mark.parametrize("case", CASES)
def test_both_forms_agree(spark, monkeypatch, case):
    field, cond, mapping = CASES[case]
    df = frame(spark, SCHEMA, *ROWS)
    results = []
    for most in (64, 0):
        monkeypatch.setattr(M, "INLINE_ENTRIES", most)
        updates = M.ColumnUpdates(df)
        updates.map_where(field, mapping, cond)
        found = updates.settle()
        assert found.columns == df.columns
        results.append((found.schema[field].dataType, sorted(map(repr, found.collect()))))
    assert results[0] == results[1]


def test_fifty_thousand_entries_plan_fast(spark):
    df = spark.range(20_000).selectExpr("id as old", "if(id % 2 = 0, 'even', 'odd') as cond")
    mapping = made({"even": {i: -i for i in range(25_000)}, "odd": {i: i + 1 for i in range(25_000)}})
    begun = time.monotonic()
    updates = M.ColumnUpdates(df)
    updates.map_where("old", mapping, "cond")
    found = updates.settle()
    assert "BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()
    assert time.monotonic() - begun < 20
    values = column(found, "old")
    assert sum(values) == sum(-i if i % 2 == 0 else i + 1 for i in range(20_000))
