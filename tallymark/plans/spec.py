"""The reconciliation spec: a plain dict, checked and turned into dataclasses.

Wherever the spec takes an expression it is either SQL text over the column
names visible at that point, or a Python callable:

* ``transformation``             ``Column -> Column`` (or SQL text naming the field)
* ``*_calculation``              ``DataFrame -> Column`` (or SQL text)

Text is only ever read as Spark SQL, never as Python.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions.compare import parse_tolerance
from tallymark.functions.predicates import (
    FILTER_CONDITIONS,
    LIST_CONDITIONS,
    MAPPING_CONDITIONS,
    NULL_CONDITIONS,
)

SOURCE, TARGET = "source", "target"
SIDES = (SOURCE, TARGET)
APPLY_TO = ("both", SOURCE, TARGET)

FrameExpression = str | Callable[[DataFrame], Column]
ValueExpression = str | Callable[[Column], Column]


class SpecError(ValueError):
    """The spec breaks one of its rules."""


def frame_expression(df: DataFrame, expression: FrameExpression) -> Column:
    return F.expr(expression) if isinstance(expression, str) else expression(df)


def describe_expression(expression: FrameExpression | ValueExpression) -> str:
    return expression if isinstance(expression, str) else getattr(expression, "__name__", "callable")


@dataclass(frozen=True)
class Filter:
    field: str
    condition: str
    value: Any = None
    values: tuple | None = None

    def describe(self) -> str:
        text = f"{self.field} {self.condition}"
        if self.value is not None:
            text += f" '{self.value}'"
        if self.values is not None:
            text += f" {list(self.values)}"
        return text


@dataclass(frozen=True)
class Key:
    name: str
    source: str
    target: str
    target_alternatives: tuple[str, ...] = ()
    source_key_calculation: FrameExpression | None = None
    target_key_calculation: FrameExpression | None = None

    def column(self, side: str) -> str:
        return self.source if side == SOURCE else self.target

    def calculation(self, side: str) -> FrameExpression | None:
        return self.source_key_calculation if side == SOURCE else self.target_key_calculation


@dataclass(frozen=True)
class ConditionalMapping:
    condition_field: str
    mappings: Mapping[Any, Mapping[Any, Any]]
    condition_type: str = "equals"
    condition_value: Any = None
    condition_list: tuple = ()
    apply_to: str | None = None

    def describe(self) -> str:
        detail = self.condition_value or (list(self.condition_list) or None)
        return f"{self.condition_field} {self.condition_type} {detail}"


@dataclass(frozen=True)
class ForceZero:
    """Target fields holding the settlement date (ISO) and the reporting date (d/m/yy)."""

    settlement_field: str = "SETTLEMENT_DATE"
    reporting_field: str = "REP_DATE2"


@dataclass(frozen=True)
class Field:
    name: str
    source: str
    target: str
    mapping: Mapping[Any, Any] | None = None
    apply_to: str = "both"
    conditional_mapping: ConditionalMapping | None = None
    transformation: ValueExpression | None = None
    source_calculation: FrameExpression | None = None
    target_calculation: FrameExpression | None = None
    post_merge_source_calculation: FrameExpression | None = None
    post_merge_target_calculation: FrameExpression | None = None
    post_merge_comment: str | None = None
    tolerance: float | int | str | None = None
    ignore: bool = False
    hidden: bool = False
    force_zero_when_settled: ForceZero | None = None
    diff_percent: bool = False
    diff_amount: bool = False
    type: str | None = None

    def column(self, side: str) -> str:
        return self.source if side == SOURCE else self.target

    def calculation(self, side: str) -> FrameExpression | None:
        return self.source_calculation if side == SOURCE else self.target_calculation

    def applies(self, side: str) -> bool:
        return self.apply_to in ("both", side)

    def conditional_applies(self, side: str) -> bool:
        mapping = self.conditional_mapping
        return mapping is not None and (mapping.apply_to or self.apply_to) in ("both", side)

    def has_steps(self, side: str) -> bool:
        """Whether mapping, transformation or a declared type rewrites this field on a side."""
        if self.applies(side) and (self.mapping is not None or self.transformation is not None):
            return True
        return self.conditional_applies(side) or self.type is not None

    def adjusted_after_join(self) -> bool:
        return (
            self.force_zero_when_settled is not None
            or self.post_merge_source_calculation is not None
            or self.post_merge_target_calculation is not None
        )


@dataclass(frozen=True)
class Spec:
    keys: tuple[Key, ...]
    fields: tuple[Field, ...]
    filters: Mapping[str, tuple[Filter, ...]] = field(default_factory=dict)
    output_filename: str | None = None

    @property
    def key_names(self) -> list[str]:
        return [k.name for k in self.keys]

    @property
    def paired_fields(self) -> list[Field]:
        """Fields that exist on both sides of the join, so not the ones that are also keys."""
        keys = set(self.key_names)
        return [f for f in self.fields if f.name not in keys]

    @property
    def key_fields(self) -> list[Field]:
        keys = set(self.key_names)
        return [f for f in self.fields if f.name in keys]

    @property
    def compared_fields(self) -> list[Field]:
        return [f for f in self.paired_fields if not f.ignore]

    @property
    def visible_fields(self) -> list[Field]:
        return [f for f in self.paired_fields if not f.hidden]


def _require(ok: bool, message: str) -> None:
    if not ok:
        raise SpecError(message)


def _text(value: Any, what: str) -> str:
    _require(isinstance(value, str) and bool(value.strip()), f"{what} must be non-empty text, got {value!r}")
    return value


def _only(entry: Mapping[str, Any], allowed: set[str], what: str) -> None:
    unknown = sorted(set(entry) - allowed)
    _require(not unknown, f"{what} has unknown items {unknown}")


def _expression(entry: Mapping[str, Any], name: str, what: str) -> Any:
    value = entry.get(name)
    ok = value is None or callable(value) or (isinstance(value, str) and bool(value.strip()))
    _require(ok, f"{what}: {name} must be SQL text or a callable")
    return value


def _key(entry: Any) -> Key:
    if isinstance(entry, str):
        name = _text(entry, "key")
        return Key(name, name, name)
    _require(isinstance(entry, Mapping) and "name" in entry, f"key must be text or a dict with a name, got {entry!r}")
    allowed = {"name", "source", "target", "target_alternatives", "target_key_calculation", "source_key_calculation"}
    _only(entry, allowed, "key")
    name = _text(entry["name"], "key name")
    return Key(
        name,
        _text(entry.get("source", name), "key source"),
        _text(entry.get("target", name), "key target"),
        tuple(_text(a, "target alternative") for a in entry.get("target_alternatives", ())),
        _expression(entry, "source_key_calculation", f"key {name!r}"),
        _expression(entry, "target_key_calculation", f"key {name!r}"),
    )


def _conditional(entry: Any, owner: str) -> ConditionalMapping:
    what = f"conditional mapping of field {owner!r}"
    _require(isinstance(entry, Mapping), f"{what} must be a dict")
    allowed = {"condition_field", "mappings", "condition_type", "condition_value", "condition_list", "apply_to"}
    _only(entry, allowed, what)
    condition_field = _text(entry.get("condition_field"), f"{what}: condition_field")
    mappings = entry.get("mappings")
    _require(isinstance(mappings, Mapping), f"{what}: mappings must be a dict")
    _require(all(isinstance(m, Mapping) for m in mappings.values()), f"{what}: every mapping must be a dict")
    apply_to = entry.get("apply_to")
    _require(apply_to is None or apply_to in APPLY_TO, f"{what}: apply_to must be one of {APPLY_TO}")

    kind = entry.get("condition_type", "equals")
    _require(kind in MAPPING_CONDITIONS, f"{what}: unknown condition type {kind!r}")
    value, values = entry.get("condition_value"), entry.get("condition_list")
    if "condition_type" in entry:
        if kind in NULL_CONDITIONS:
            _require(not value, f"{what}: {kind} takes no condition_value")
        elif kind in LIST_CONDITIONS:
            _require(isinstance(values, (list, tuple)) and len(values) > 0, f"{what}: {kind} needs a condition_list")
        else:
            _require(bool(value), f"{what}: {kind} needs a condition_value")
    if kind in ("regex_match", "regex_not_match") and value:
        try:
            re.compile(value)
        except re.error as error:
            raise SpecError(f"{what}: invalid pattern {value!r}: {error}") from error
    return ConditionalMapping(condition_field, mappings, kind, value, tuple(values or ()), apply_to)


def _force_zero(entry: Any, owner: str) -> ForceZero | None:
    if not entry:
        return None
    if entry is True:
        return ForceZero()
    _require(isinstance(entry, Mapping), f"field {owner!r}: force_zero_when_settled must be a flag or a dict")
    _only(entry, {"settlement_field", "reporting_field"}, f"field {owner!r}: force_zero_when_settled")
    return ForceZero(**entry)


_FIELD_EXPRESSIONS = (
    "transformation",
    "source_calculation",
    "target_calculation",
    "post_merge_source_calculation",
    "post_merge_target_calculation",
)
_FIELD_FLAGS = ("ignore", "hidden", "diff_percent", "diff_amount")
_FIELD_ITEMS = {
    "name", "source", "target", "mapping", "apply_to", "conditional_mapping", "post_merge_comment",
    "tolerance", "force_zero_when_settled", "type", *_FIELD_EXPRESSIONS, *_FIELD_FLAGS,
}


def _field(entry: Any) -> Field:
    _require(isinstance(entry, Mapping) and "name" in entry, f"field must be a dict with a name, got {entry!r}")
    name = _text(entry["name"], "field name")
    what = f"field {name!r}"
    _only(entry, _FIELD_ITEMS, what)
    mapping = entry.get("mapping")
    _require(mapping is None or isinstance(mapping, Mapping), f"{what}: mapping must be a dict")
    apply_to = entry.get("apply_to", "both")
    _require(apply_to in APPLY_TO, f"{what}: apply_to must be one of {APPLY_TO}")
    conditional = entry.get("conditional_mapping")
    _require(
        mapping is None or conditional is None,
        f"{what} cannot have both a mapping and a conditional mapping",
    )
    for flag in _FIELD_FLAGS:
        _require(isinstance(entry.get(flag, False), bool), f"{what}: {flag} must be true or false")
    try:
        parse_tolerance(entry.get("tolerance"))
    except ValueError as error:
        raise SpecError(f"{what}: {error}") from error
    return Field(
        name=name,
        source=_text(entry.get("source", name), f"{what}: source"),
        target=_text(entry.get("target", name), f"{what}: target"),
        mapping=mapping,
        apply_to=apply_to,
        conditional_mapping=None if conditional is None else _conditional(conditional, name),
        post_merge_comment=entry.get("post_merge_comment"),
        tolerance=entry.get("tolerance"),
        force_zero_when_settled=_force_zero(entry.get("force_zero_when_settled"), name),
        type=entry.get("type"),
        **{e: _expression(entry, e, what) for e in _FIELD_EXPRESSIONS},
        **{flag: entry.get(flag, False) for flag in _FIELD_FLAGS},
    )


def _filter(entry: Any, side: str) -> Filter:
    _require(isinstance(entry, Mapping), f"{side} filter must be a dict")
    _only(entry, {"field", "condition", "value", "values"}, f"{side} filter")
    condition = entry.get("condition")
    _require(condition in FILTER_CONDITIONS, f"{side} filter: unknown condition {condition!r}")
    values = entry.get("values")
    _require(values is None or isinstance(values, (list, tuple)), f"{side} filter: values must be a list")
    return Filter(
        _text(entry.get("field"), f"{side} filter field"),
        condition,
        entry.get("value"),
        None if values is None else tuple(values),
    )


def _distinct(names: list[str], what: str) -> None:
    repeated = sorted({n for n in names if names.count(n) > 1})
    _require(not repeated, f"duplicate {what}: {repeated}")


def parse_spec(spec: Mapping[str, Any] | Spec, *, strict: bool = False) -> Spec:
    """Check a spec dict and return it typed.

    ``strict`` also rejects a condition field that is no configured key or
    field; otherwise such a field is looked up in the raw side table.
    """
    if isinstance(spec, Spec):
        return spec
    _require(isinstance(spec, Mapping) and "reconciliation" in spec, "spec needs a 'reconciliation' section")
    _only(spec, {"reconciliation", "output"}, "spec")
    body = spec["reconciliation"]
    _require(isinstance(body, Mapping), "the 'reconciliation' section must be a dict")
    _only(body, {"keys", "fields", "filters"}, "the 'reconciliation' section")
    keys, fields = body.get("keys"), body.get("fields")
    _require(isinstance(keys, (list, tuple)) and len(keys) > 0, "at least one key is required")
    _require(isinstance(fields, (list, tuple)) and len(fields) > 0, "at least one field is required")
    filters = body.get("filters") or {}
    _only(filters, set(SIDES), "filters")

    parsed = Spec(
        tuple(_key(k) for k in keys),
        tuple(_field(f) for f in fields),
        {side: tuple(_filter(f, side) for f in filters.get(side) or ()) for side in SIDES},
        (spec.get("output") or {}).get("filename"),
    )
    _distinct(parsed.key_names, "keys")
    _distinct([f.name for f in parsed.fields], "fields")
    if strict:
        known = set(parsed.key_names) | {f.name for f in parsed.fields}
        for f in parsed.fields:
            if f.conditional_mapping is not None:
                needed = f.conditional_mapping.condition_field
                _require(needed in known, f"field {f.name!r}: condition field {needed!r} is not configured")
    return parsed


def run_name(spec: Spec | None, now: Any, default: str = "reconciliation_results") -> str:
    """Output base name with a ``_YYYYMMDD_HHMMSS`` stamp."""
    base = (spec.output_filename if spec else None) or default
    return f"{base.removesuffix('.xlsx')}_{now:%Y%m%d_%H%M%S}"
