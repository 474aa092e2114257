import datetime

import pytest

from tallymark.functions.compare import parse_tolerance
from tallymark.functions.predicates import MAPPING_CONDITIONS
from tallymark.plans.spec import SpecError, parse_spec, run_name


def body(**changes):
    base = {"keys": ["id"], "fields": [{"name": "amount"}, {"name": "kind"}]}
    return {"reconciliation": {**base, **changes}}


def conditional(**items):
    mapping = {"condition_field": "kind", "mappings": {"default": {"a": "b"}}, **items}
    return body(fields=[{"name": "kind"}, {"name": "amount", "conditional_mapping": mapping}])


VALUES = [c for c in MAPPING_CONDITIONS if c not in ("in_list", "not_in_list", "is_null", "is_not_null")]

BAD = {
    "no section": {},
    "unknown section": {"reconciliation": body()["reconciliation"], "more": 1},
    "no keys": {"reconciliation": {"fields": [{"name": "a"}]}},
    "empty keys": body(keys=[]),
    "blank key": body(keys=[" "]),
    "repeated key": body(keys=["id", {"name": "id"}]),
    "no fields": body(fields=[]),
    "repeated field": body(fields=[{"name": "a"}, {"name": "a"}]),
    "blank field": body(fields=[{"name": " "}]),
    "unknown item": body(fields=[{"name": "a", "colour": "red"}]),
    "bad apply_to": body(fields=[{"name": "a", "mapping": {}, "apply_to": "neither"}]),
    "negative tolerance": body(fields=[{"name": "a", "tolerance": -0.5}]),
    "bad percentage": body(fields=[{"name": "a", "tolerance": "x%"}]),
    "bad tolerance": body(fields=[{"name": "a", "tolerance": "1"}]),
    "bad transformation": body(fields=[{"name": "a", "transformation": 5}]),
    "both mappings": body(
        fields=[
            {"name": "kind"},
            {"name": "a", "mapping": {}, "conditional_mapping": {"condition_field": "kind", "mappings": {}}},
        ]
    ),
    "unknown condition": conditional(condition_type="resembles", condition_value="x"),
    "bad pattern": conditional(condition_type="regex_match", condition_value="("),
    "bad filter": body(filters={"source": [{"field": "a", "condition": "resembles"}]}),
    "bad filter side": body(filters={"middle": []}),
    **{f"{c} without value": conditional(condition_type=c) for c in VALUES},
    **{f"{c} without list": conditional(condition_type=c) for c in ("in_list", "not_in_list")},
    **{f"{c} with value": conditional(condition_type=c, condition_value="x") for c in ("is_null", "is_not_null")},
}


@pytest.mark.parametrize("case", BAD)
def test_rejected(case):
    with pytest.raises(SpecError):
        parse_spec(BAD[case], strict=True)


def test_unknown_condition_field_is_rejected_only_when_strict():
    wanted = body(fields=[{"name": "a", "conditional_mapping": {"condition_field": "other", "mappings": {}}}])
    with pytest.raises(SpecError):
        parse_spec(wanted, strict=True)
    assert parse_spec(wanted).fields[0].conditional_mapping.condition_field == "other"


@pytest.mark.parametrize("kind", MAPPING_CONDITIONS)
def test_accepted(kind):
    items = {"condition_type": kind}
    if kind in VALUES:
        items["condition_value"] = "5"
    elif kind in ("in_list", "not_in_list"):
        items["condition_list"] = ["a"]
    parsed = parse_spec(conditional(**items), strict=True)
    assert parsed.fields[1].conditional_mapping.condition_type == kind


def test_key_as_condition_field_and_nested_apply_to():
    wanted = body(
        fields=[
            {
                "name": "a",
                "apply_to": "target",
                "conditional_mapping": {"condition_field": "id", "mappings": {}, "apply_to": "source"},
            }
        ]
    )
    parsed = parse_spec(wanted, strict=True).fields[0]
    assert parsed.conditional_applies("source") and not parsed.conditional_applies("target")


def test_tolerances():
    assert parse_tolerance(0.01) == ("absolute", 0.01)
    assert parse_tolerance(2) == ("absolute", 2.0)
    assert parse_tolerance("1%") == ("percentage", 0.01)
    assert parse_tolerance(None) is None
    with pytest.raises(ValueError):
        parse_tolerance("invalid")


def test_run_name():
    now = datetime.datetime(2025, 6, 24, 14, 30, 22)
    assert run_name(None, now) == "reconciliation_results_20250624_143022"
    named = parse_spec({**body(), "output": {"filename": "daily.xlsx"}})
    assert run_name(named, now) == "daily_20250624_143022"
