"""Field comparison: exact, absolute tolerance, percentage tolerance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.functions import values as V

# Fixed value: slack added to an absolute tolerance for binary rounding.
ABSOLUTE_SLACK = 1e-9


def parse_tolerance(tolerance: float | int | str | None) -> tuple[str, float] | None:
    """``0.01`` is absolute, ``"1%"`` is a share of the source value; None is exact."""
    if tolerance is None:
        return None
    if isinstance(tolerance, bool):
        raise ValueError(f"invalid tolerance: {tolerance!r}")
    if isinstance(tolerance, (int, float)):
        kind, amount = "absolute", float(tolerance)
    elif isinstance(tolerance, str) and tolerance.endswith("%"):
        number = V.python_number(tolerance[:-1])
        if number is None:
            raise ValueError(f"invalid percentage tolerance: {tolerance!r}")
        kind, amount = "percentage", number / 100.0
    else:
        raise ValueError(f"invalid tolerance: {tolerance!r}")
    if not amount >= 0:
        raise ValueError(f"tolerance must not be negative: {tolerance!r}")
    return kind, amount


def exact_match(s: Column, s_type: T.DataType, t: Column, t_type: T.DataType) -> Column:
    """Equal, or both missing. Values of different families never match."""
    s_kind, t_kind = V.family(s_type), V.family(t_type)
    s, t = V.clean(s, s_type), V.clean(t, t_type)
    if s_kind != t_kind:
        return s.isNull() & t.isNull()
    if s_kind == V.NUMBER and s_type != t_type:
        whole = all(V.is_integral(d) or isinstance(d, T.BooleanType) for d in (s_type, t_type))
        common = "bigint" if whole else "double"
        s, t = s.cast(common), t.cast(common)
    elif s_kind == V.DATETIME and s_type != t_type:
        s, t = s.cast("timestamp_ntz"), t.cast("timestamp_ntz")
    return s.eqNullSafe(t)


def tolerant_match(a: Column, b: Column, kind: str, amount: float) -> Column:
    """Match of two numbers (doubles, NULL when missing or no number)."""
    both_missing = a.isNull() & b.isNull()
    if kind == "absolute":
        close = (F.abs(a - b) <= F.lit(amount + ABSOLUTE_SLACK)) | (a == b)
    else:
        # the division is only reached for a non-zero source
        close = F.when(a == 0, b == 0).otherwise(F.abs(a - b) / F.abs(a) <= F.lit(amount))
    return F.coalesce(close, F.lit(False)) | both_missing


def field_match(
    s: Column, s_type: T.DataType, t: Column, t_type: T.DataType, tolerance: float | int | str | None = None
) -> Column:
    """Whether one field agrees on a pair of rows; never NULL."""
    parsed = parse_tolerance(tolerance)
    if parsed is None:
        return exact_match(s, s_type, t, t_type)
    return tolerant_match(V.as_number(s, s_type), V.as_number(t, t_type), *parsed)


def text_differs(s: Column, s_type: T.DataType, t: Column, t_type: T.DataType) -> Column:
    """Plain display comparison: trimmed texts differ, or just one side is missing."""
    def trimmed(col: Column, dtype: T.DataType) -> Column:
        return F.regexp_replace(V.as_text(col, dtype), r"^\s+|\s+$", "")

    return ~trimmed(s, s_type).eqNullSafe(trimmed(t, t_type))
