"""Filter queries: one per condition, on the target of the orders pair, which has nulls."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tallymark.catalog.base import ORDERS_TARGET_SQL, orders_target, register, table
from tallymark.operators.filters import apply_filters, filter_counts
from tallymark.plans.spec import Filter

COLUMNS = ["order_id", "cust", "status_text", "price", "priority"]

# condition -> (field, value, values, SQL test)
CASES: dict[str, tuple[str, Any, tuple | None, str]] = {
    "equals": ("priority", "1-URGENT", None, "priority = '1-URGENT'"),
    "not_equals": ("priority", "1-URGENT", None, "priority IS DISTINCT FROM '1-URGENT'"),
    "starts_with": ("priority", "2-", None, "starts_with(priority, '2-')"),
    "not_starts_with": ("priority", "2-", None, "NOT coalesce(starts_with(priority, '2-'), false)"),
    "ends_with": ("priority", "LOW", None, "ends_with(priority, 'LOW')"),
    "not_ends_with": ("priority", "LOW", None, "NOT coalesce(ends_with(priority, 'LOW'), false)"),
    "contains": ("priority", "H[IO]GH|MED", None, "regexp_matches(priority, 'H[IO]GH|MED')"),
    "not_contains": ("priority", "SPEC", None, "NOT coalesce(contains(priority, 'SPEC'), false)"),
    "regex_match": ("priority", "[12]-|.*LOW", None, "regexp_matches(priority, '^(?:[12]-|.*LOW)')"),
    "regex_not_match": ("priority", "[12]-", None, "NOT coalesce(regexp_matches(priority, '^(?:[12]-)'), false)"),
    "less_than": ("price", "100000", None, "price < 100000"),
    "less_than_equal": ("cust", 50, None, "cust <= 50"),
    "greater_than": ("price", 400000.5, None, "price > CAST(400000.5 AS DOUBLE)"),
    "greater_than_equal": ("cust", "90", None, "cust >= 90"),
    "in_list": ("priority", None, ("1-URGENT", "5-LOW"), "priority IN ('1-URGENT', '5-LOW')"),
    "not_in_list": ("priority", None, ("1-URGENT", "5-LOW"), "NOT coalesce(priority IN ('1-URGENT', '5-LOW'), false)"),
    "in": ("cust", None, (1, "2", "03", 4.0), "cust IN (1, 2)"),
    "not_in": ("status_text", None, ("Open",), "status_text <> 'Open'"),
    "is_null": ("priority", None, None, "priority IS NULL"),
    "is_not_null": ("priority", None, None, "priority IS NOT NULL"),
}

# The same conditions where the column is a number and the value text, or the text of a number is tested.
VARIANTS: dict[str, tuple[str, str, Any, tuple | None, str]] = {
    "filter_equals_number": ("equals", "cust", "7", None, "cust = 7"),
    "filter_not_equals_number": ("not_equals", "cust", "7.0", None, "cust <> 7"),
    "filter_equals_number_as_text": ("equals", "cust", "seven", None, "false"),
    "filter_starts_with_number_text": ("starts_with", "cust", "12", None, "starts_with(CAST(cust AS VARCHAR), '12')"),
    "filter_ends_with_decimal_text": ("ends_with", "o_totalprice", ".5", None,
                                      "ends_with(CAST(o_totalprice AS VARCHAR), '.5')"),
    "filter_number_of_text": ("greater_than", "number_text", 3, None,
                              "TRY_CAST(left(o_orderpriority, 1) AS DOUBLE) > 3"),
    "filter_empty_list": ("not_in_list", "priority", None, (), "false"),
}


def _filter_query(condition: str, field: str, value: Any, values: tuple | None):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        kept = apply_filters(orders_target(spark, sf), [Filter(field, condition, value, values)])
        return kept.select(*COLUMNS)

    return query


for _condition, (_field, _value, _values, _test) in CASES.items():
    register(
        f"filter_{_condition}", f"SELECT {', '.join(COLUMNS)} FROM ({ORDERS_TARGET_SQL}) AS t WHERE {_test}"
    )(_filter_query(_condition, _field, _value, _values))


def _variant_query(condition: str, field: str, value: Any, values: tuple | None):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        rows = table(spark, sf, "orders").selectExpr(
            "o_orderkey", "o_custkey as cust", "o_totalprice", "o_orderpriority as priority",
            "substr(o_orderpriority, 1, case when o_orderkey % 2 = 0 then 1 else 3 end) as number_text",
        )
        return apply_filters(rows, [Filter(field, condition, value, values)]).select("o_orderkey", "cust")

    return query


for _name, (_condition, _field, _value, _values, _test) in VARIANTS.items():
    _sql_test = _test.replace(
        "left(o_orderpriority, 1)", "substr(o_orderpriority, 1, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 3 END)"
    )
    register(
        _name,
        "SELECT o_orderkey, cust FROM (SELECT *, o_custkey AS cust, o_orderpriority AS priority FROM orders) AS t "
        f"WHERE {_sql_test}",
    )(_variant_query(_condition, _field, _value, _values))


CHAIN = [
    Filter("priority", "not_equals", "5-LOW"),
    Filter("price", "greater_than", 100000),
    Filter("status_text", "in_list", None, ("Open", "Filled")),
]
CHAIN_SQL = "priority IS DISTINCT FROM '5-LOW' AND price > 100000 AND status_text IN ('Open', 'Filled')"


@register("filter_chain", f"SELECT {', '.join(COLUMNS)} FROM ({ORDERS_TARGET_SQL}) AS t WHERE {CHAIN_SQL}")
def filter_chain(spark: SparkSession, sf: str) -> DataFrame:
    return apply_filters(orders_target(spark, sf), CHAIN).select(*COLUMNS)


@register("filter_missing_field", f"SELECT {', '.join(COLUMNS)} FROM ({ORDERS_TARGET_SQL}) AS t WHERE false")
def filter_missing_field(spark: SparkSession, sf: str) -> DataFrame:
    return apply_filters(orders_target(spark, sf), [Filter("no_such_field", "equals", "x")]).select(*COLUMNS)


@register(
    "filter_removed_counts",
    f"""SELECT count(*) AS rows_before, count(*) FILTER (WHERE NOT ({CHAIN_SQL})) AS rows_removed,
               count(*) FILTER (WHERE {CHAIN_SQL}) AS rows_left FROM ({ORDERS_TARGET_SQL}) AS t""",
)
def filter_removed_counts(spark: SparkSession, sf: str) -> DataFrame:
    return filter_counts(orders_target(spark, sf), CHAIN)
