"""Random small tables against plain Python."""

import itertools
import math
import random

import pytest
from helpers import frame, spec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.functions.compare import field_match
from tallymark.plans.reconcile import Skew, reconcile

SPECIAL = [None, 0.0, -0.0, 1.0, 1.01, 0.99, 100.0, 101.0, -100.0, float("inf"), float("-inf"), float("nan"), 1e-12]
TOLERANCES = [None, 0, 0.01, 1.0, "0%", "1%", "50%", "200%"]


def missing(v):
    return v is None or v != v


def python_match(s, t, tolerance):
    if missing(s) or missing(t):
        return missing(s) and missing(t)
    if tolerance is None:
        return s == t
    if isinstance(tolerance, str):
        share = float(tolerance[:-1]) / 100
        if s == 0:
            return t == 0
        if math.isinf(s):
            return False
        return abs(s - t) / abs(s) <= share
    return s == t or abs(s - t) <= tolerance + 1e-9


@pytest.fixture(scope="module")
def values():
    rng = random.Random(7)
    pairs = list(itertools.product(SPECIAL, SPECIAL))
    for _ in range(1500):
        a = rng.choice([rng.uniform(-200, 200), round(rng.uniform(-5, 5), 2)])
        pairs.append((a, rng.choice([a * (1 + rng.choice([0.01, -0.01, 0.5])), a + rng.choice([0.01, -1.0, 1e-9]), -a])))
    return pairs


@pytest.mark.parametrize("tolerance", TOLERANCES)
def test_matches(spark, values, tolerance):
    df = frame(spark, "i long, s double, t double", *[(i, *p) for i, p in enumerate(values)])
    double = T.DoubleType()
    match = field_match(F.col("s"), double, F.col("t"), double, tolerance)
    got = [r["m"] for r in df.select("i", match.alias("m")).orderBy("i").collect()]
    assert got == [python_match(s, t, tolerance) for s, t in values]


def random_rows(seed, count):
    rng = random.Random(seed)
    return [
        (rng.choice([None, *range(12)]), rng.choice(["x", "y", None]), rng.choice([None, 1.0, 1.005, 2.0, 2.5]),
         rng.choice(["A", "B", None]))
        for _ in range(count)
    ]


def brute_force(source, target):
    """Category counts and per-field counts over all pairs of equal keys."""
    counts = dict.fromkeys(("matched", "different", "missing_in_target", "missing_in_source"), 0)
    fields = {"v": [0, 0], "w": [0, 0]}
    for row in source:
        partners = [t for t in target if t[:2] == row[:2]]
        counts["missing_in_target"] += not partners
        for t in partners:
            verdicts = {"v": python_match(row[2], t[2], 0.01), "w": row[3] == t[3]}
            counts["matched" if all(verdicts.values()) else "different"] += 1
            for name, (a, b) in {"v": (row[2], t[2]), "w": (row[3], t[3])}.items():
                if not (a is None and b is None):
                    fields[name][0] += verdicts[name]
                    fields[name][1] += 1
    counts["missing_in_source"] = sum(not any(t[:2] == s[:2] for s in source) for t in target)
    return counts, fields


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("options", [{}, {"skew": Skew("always", share=0.04, min_rows=2, rows_per_cell=2)}])
def test_whole_reconciliation(spark, seed, options):
    source, target = random_rows(seed, 150), random_rows(seed + 100, 130)
    schema = "k long, j string, v double, w string"
    result = reconcile(
        frame(spark, schema, *source), frame(spark, schema, *target),
        spec({"name": "v", "tolerance": 0.01}, {"name": "w"}, keys=["k", "j"]), **options,
    )
    assert bool(result.hot_keys) == bool(options)
    counts, fields = brute_force(source, target)
    row = result.statistics().first()
    assert {c: row[c] for c in counts} == counts
    assert {f["field"]: [f["matches"], f["comparable"]] for f in row["field_statistics"]} == fields
    by_category = {r["category"]: r["count"] for r in result.classified().groupBy("category").count().collect()}
    assert by_category == {c: n for c, n in counts.items() if n}
