"""Hot keys: the special join must give exactly what the plain join gives."""

import random

import numpy as np
import pytest
from helpers import frame, spec
from pyspark.sql import functions as F

from tallymark.functions.compare import ABSOLUTE_SLACK
from tallymark.operators.hotstats import bounds
from tallymark.operators.joins import FOLDED_ROWS, WEIGHT, find_hot_keys, unfold
from tallymark.plans.reconcile import Skew, reconcile
from tallymark.plans.reports import missing_in_source_report, missing_in_target_report

SCHEMA = "k long, j string, a double, b string"
FIELDS = [{"name": "a", "tolerance": 0.5}, {"name": "b"}]
HOT = {"skew": Skew("always", share=0.1, min_rows=20, rows_per_cell=7)}


def rows(count, hot, step):
    """A third of the rows share one key; groups of them are exact copies."""
    out = []
    for i in range(count):
        key = hot if i % 3 == 0 else i * step
        out.append((key, "p" if i % 3 == 0 else "q", float(i % 11), None if i % 5 == 0 else f"b{i % 4}"))
    return out


@pytest.fixture(scope="module", params=["same hot key", "null hot key", "hot on one side"])
def pair(spark, request):
    hot_s, hot_t = {"same hot key": (7, 7), "null hot key": (None, None), "hot on one side": (7, -9)}[request.param]
    return frame(spark, SCHEMA, *rows(150, hot_s, 2)), frame(spark, SCHEMA, *rows(120, hot_t, 3))


def sorted_rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("null_keys", ["match", "differ"])
def test_same_results(pair, null_keys):
    wanted = spec(*FIELDS, keys=["k", "j"])
    plain = reconcile(*pair, wanted, null_keys=null_keys, skew="ignore")
    split = reconcile(*pair, wanted, null_keys=null_keys, **HOT)
    assert split.hot_keys
    assert split.summary().first() == plain.summary().first()
    assert sorted_rows(split.field_stats()) == sorted_rows(plain.field_stats())
    assert sorted_rows(split.classified()) == sorted_rows(plain.classified())
    assert sorted_rows(split.breaks()) == sorted_rows(plain.breaks())
    assert sorted_rows(split.merged()) == sorted_rows(plain.merged())


def test_hot_keys_are_found_and_counted(spark):
    source, target = frame(spark, SCHEMA, *rows(150, 7, 2)), frame(spark, SCHEMA, *rows(120, 7, 3))
    found = find_hot_keys(source, target, ["k", "j"], share=0.1, min_rows=20)
    assert [(key.source_rows, key.target_rows) for key in found] == [(50, 40)]
    assert find_hot_keys(source, target, ["k", "j"], share=0.5, min_rows=20) == []
    assert find_hot_keys(source, target, ["k", "j"]) == []
    with pytest.raises(ValueError, match="share"):
        find_hot_keys(source, target, ["k", "j"], share=0.0)


def test_many_hot_keys(spark):
    """Far more hot keys than one sketch would list, among many cold ones."""
    df = spark.range(60_000).selectExpr("if(id % 2 = 0, id % 5000, id) as k", "id as a")
    found = find_hot_keys(df, df.limit(0), ["k"], share=5e-5, min_rows=2)
    assert {(key.source_rows, key.target_rows) for key in found} == {(12, 0)}
    assert len(found) == 2500


def test_key_types_may_differ(spark):
    source = frame(spark, "k int, a double, b string", *[(1, float(i), "x") for i in range(30)])
    target = frame(spark, "k long, a double, b string", *[(1, float(i), "x") for i in range(25)])
    plain = reconcile(source, target, spec(*FIELDS, keys=["k"]), skew="ignore")
    split = reconcile(source, target, spec(*FIELDS, keys=["k"]), **HOT)
    assert len(split.hot_keys) == 1
    assert split.summary().first() == plain.summary().first()


def test_small_inputs_are_not_checked(spark):
    df = frame(spark, "k long, a double, b string", (1, 1.0, "x"))
    assert reconcile(df, df, spec(*FIELDS, keys=["k"])).hot_keys == []


def test_post_join_steps_with_hot_keys(pair):
    fields = [
        {"name": "a", "tolerance": 0.5, "post_merge_source_calculation": "if(target_b = 'b1', target_a, source_a)"},
        {"name": "b"},
    ]
    wanted = spec(*fields, keys=["k", "j"])
    plain, split = reconcile(*pair, wanted, skew="ignore"), reconcile(*pair, wanted, **HOT)
    assert split.summary().first() == plain.summary().first()
    assert sorted_rows(split.field_stats()) == sorted_rows(plain.field_stats())
    assert sorted_rows(split.adjustments()) == sorted_rows(plain.adjustments())


def test_mapped_values_with_hot_keys(pair):
    fields = [{"name": "b", "mapping": {"b1": "one", "b2": "two"}, "apply_to": "source"}]
    wanted = spec(*fields, keys=["k", "j"])
    plain, split = reconcile(*pair, wanted, skew="ignore"), reconcile(*pair, wanted, **HOT)
    assert sorted_rows(split.joined_changes()) == sorted_rows(plain.joined_changes())
    assert sorted_rows(split.changes()) == sorted_rows(plain.changes())


KINDS = {
    "absolute": [{"name": "a", "tolerance": 2.0}],
    "zero": [{"name": "a", "tolerance": 0}],
    "percentage": [{"name": "a", "tolerance": "40%"}],
    "small percentage": [{"name": "a", "tolerance": "0%"}, {"name": "b"}],
    "wide percentage": [{"name": "a", "tolerance": "150%"}],
    "texts as numbers": [{"name": "b", "tolerance": 1.0}],
    "several": [{"name": "a", "tolerance": "30%"}, {"name": "b"}, {"name": "c", "tolerance": 0.02}, {"name": "d"}],
    "other families": [{"name": "mixed", "source": "a", "target": "b"}],
    "other numbers": [{"name": "n", "source": "a", "target": "c"}],
    "all ignored": [{"name": "a", "ignore": True}],
}
WIDE = "k long, a double, b string, c float, d date"


def varied(count, offset):
    import datetime

    special = [float("inf"), float("-inf"), float("nan"), 0.0, -0.0, None, 1e300, -1e300, 1e-300, -5.0]
    out = []
    for i in range(count):
        n = i * 7 + offset
        a = special[n % 10] if n % 4 == 0 else float(n % 23) - 6 + (n % 3) * 0.01
        b = None if n % 6 == 0 else ["1", " 2.0 ", "x", "", "1e0", "NaN"][n % 5]
        out.append((7 if i % 2 else None, a, b, None if n % 8 == 0 else (n % 9) / 100, datetime.date(2024, 1, 1 + n % 3)))
    return out


@pytest.mark.parametrize("kind", KINDS)
def test_counts_without_pairs(spark, kind):
    source, target = frame(spark, WIDE, *varied(70, 0)), frame(spark, WIDE, *varied(60, 3))
    wanted = spec(*KINDS[kind], keys=["k"])
    plain = reconcile(source, target, wanted, skew="ignore")
    split = reconcile(source, target, wanted, **HOT)
    assert len(split.hot_keys) == 2
    assert split.summary().first() == plain.summary().first()
    assert sorted_rows(split.field_stats()) == sorted_rows(plain.field_stats())


@pytest.mark.parametrize("kind, amount", [("absolute", 0.0), ("absolute", 0.01), ("absolute", 3.7), ("percentage", 0.0), ("percentage", 0.01), ("percentage", 0.3), ("percentage", 1.7)])
def test_bounds_are_exact(kind, amount):
    chance = np.random.default_rng(5)
    values = np.concatenate([chance.normal(0, 10.0**p, 40) for p in range(-8, 12)] + [[0.0, 1.0, -1.0, 1e308, -1e308, 5e-324]])

    def close(s, t):
        if kind == "absolute":
            return abs(s - t) <= amount + ABSOLUTE_SLACK or s == t
        return t == 0 if s == 0 else abs(s - t) / abs(s) <= amount

    for s, low, high in zip(values, *bounds(values, kind, amount)):
        assert close(s, low) and close(s, high)
        outside = np.nextafter(low, -np.inf), np.nextafter(high, np.inf)
        assert not any(np.isfinite(t) and close(s, t) for t in outside)
    assert [x.tolist() for x in bounds(np.array([np.inf, -np.inf]), kind, amount)] == [[np.inf, -np.inf]] * 2


@pytest.mark.parametrize("tolerance", [0.01, 2.5, 1000, "1%", "40%", "300%"])
def test_wide_tolerances_count_alike(spark, tolerance):
    """Values of all sizes, some missing, some infinite; one field decides, or several do."""
    chance = random.Random(str(tolerance))

    def side(n):
        number = lambda: chance.choice((None, 0.0, -0.0, float("inf"), 1.0, -3.5, chance.gauss(0, 30), round(chance.gauss(0, 3), 1)))
        return frame(spark, "k long, a double, b string, c double", *[
            (1 if i % 4 else i, number(), chance.choice((None, "x", "y")), chance.choice((None, chance.uniform(1, 2)))) for i in range(n)
        ])

    source, target = side(160), side(130)
    for fields in (
        [{"name": "a", "tolerance": tolerance}, {"name": "b"}],
        [{"name": "a", "tolerance": tolerance}, {"name": "b"}, {"name": "c", "tolerance": 5}],  # any two values of c match
        [{"name": "a", "tolerance": tolerance}, {"name": "c", "tolerance": 0.2}],
        [{"name": "c", "tolerance": "900%"}, {"name": "b"}],
    ):
        wanted = spec(*fields, keys=["k"])
        plain, split = reconcile(source, target, wanted, skew="ignore"), reconcile(source, target, wanted, **HOT)
        assert split.hot_keys
        assert split.summary().first() == plain.summary().first()
        assert sorted_rows(split.field_stats()) == sorted_rows(plain.field_stats())


def test_equal_rows_of_a_hot_key_are_spread(spark):
    """2,500 x 3,000 equal rows: no folded row stands for more than its share, and all pairs come out."""
    source = spark.range(2500).selectExpr("1 as k", "'x' as v").union(spark.range(5).selectExpr("id + 5 as k", "'y' as v"))
    target = spark.range(3000).selectExpr("1 as k", "'x' as v")
    result = reconcile(source, target, spec({"name": "v"}, keys=["k"]), skew=Skew("always", share=0.1, min_rows=20))
    folded = result._lean
    assert folded.agg(F.max(WEIGHT)).first()[0] <= FOLDED_ROWS**2 and folded.filter(f"{WEIGHT} > 1").count() == 9
    counts = {r["category"]: r["count"] for r in result.classified().groupBy("category").count().collect()}
    assert counts == {"matched": 2500 * 3000, "missing_in_target": 5}


def test_missing_reports_need_no_full_outer_join(pair):
    wanted = spec(*FIELDS, keys=["k", "j"])
    for options in ({"skew": "ignore"}, HOT):
        result = reconcile(*pair, wanted, **options)
        for report, category in ((missing_in_target_report, "missing_in_target"), (missing_in_source_report, "missing_in_source")):
            found = report(result)
            assert "FullOuter" not in found._jdf.queryExecution().optimizedPlan().toString()
            side = category.removeprefix("missing_in_")
            side = {"target": "source", "source": "target"}[side]
            expected = result.classified().filter(F.col("category") == category).select("k", "j", f"{side}_a", f"{side}_b")
            assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, expected.collect()), key=repr)


def test_unfolded_rows(spark):
    """Each row as often as it counts, whatever its count is to a run."""
    weights = [1, 2, FOLDED_ROWS - 1, FOLDED_ROWS, FOLDED_ROWS + 1, 3 * FOLDED_ROWS, 5 * FOLDED_ROWS + 7, FOLDED_ROWS**2]
    df = frame(spark, f"id long, {WEIGHT} long", *enumerate(weights), *enumerate(weights[:3]))
    found = {r["id"]: r["count"] for r in unfold(df).groupBy("id").count().collect()}
    assert found == {i: w * (2 if i < 3 else 1) for i, w in enumerate(weights)}
    assert unfold(df).columns == ["id"]


def test_copies_of_a_pair_come_a_run_at_a_time(spark):
    """Runs and copies are not exploded in one loop, and nothing is computed anew for each copy."""
    source = spark.range(2500).selectExpr("1 as k", "'x' as v").union(spark.range(5).selectExpr("id + 5 as k", "'y' as v"))
    target = spark.range(3000).selectExpr("1 as k", "if(id < 2000, 'x', 'z') as v")
    result = reconcile(source, target, spec({"name": "v"}, keys=["k"]), skew=Skew("always", share=0.1, min_rows=20))
    for df in (result.classified(), result.merged(), result.breaks()):
        copying, _, counted = df._jdf.queryExecution().optimizedPlan().toString().partition("Union")
        assert counted and copying.count("Generate explode") == 1
        assert not any(work in copying for work in ("CASE WHEN", "array_join", "inline"))
    assert result.breaks().groupBy("target_value").count().collect() == [("z", 2500 * 1000)]
