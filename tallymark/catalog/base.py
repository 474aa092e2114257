"""Shared inputs of the catalogued queries and their SQL twins.

The pairs are built from whole tables: the source is the table itself, the
target the same rows renamed, partly altered and partly re-keyed, so that every
category of a reconciliation occurs.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = query
        if sql is not None:
            ORACLE[name] = sql
        return query

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def scratch_folder(spark: SparkSession) -> str:
    """A fresh folder every executor can reach: in the cluster's shared folder, else in the warehouse."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    folder = shared or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch"
    return f"{folder}/{uuid.uuid4().hex}"


# -- orders pair ------------------------------------------------------------

STATUS_WORDS = {"O": "Open", "F": "Filled", "P": "Pending"}


def orders_target(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").selectExpr(
        "case when o_orderkey % 10 = 0 then -o_orderkey - 1 else o_orderkey end as order_id",
        "o_custkey as cust",
        "o_orderdate as order_date",
        "case when o_orderkey % 19 = 0 then 'Unknown' when o_orderstatus = 'O' then 'Open' "
        "when o_orderstatus = 'F' then 'Filled' else 'Pending' end as status_text",
        "case when o_orderkey % 7 = 0 then o_totalprice * 1.02D when o_orderkey % 11 = 0 then o_totalprice + 0.005D "
        "else o_totalprice end as price",
        "case when o_orderkey % 13 = 0 then null else o_orderpriority end as priority",
    )


ORDERS_TARGET_SQL = """
    SELECT CASE WHEN o_orderkey % 10 = 0 THEN -o_orderkey - 1 ELSE o_orderkey END AS order_id,
           o_custkey AS cust, o_orderdate AS order_date,
           CASE WHEN o_orderkey % 19 = 0 THEN 'Unknown' WHEN o_orderstatus = 'O' THEN 'Open'
                WHEN o_orderstatus = 'F' THEN 'Filled' ELSE 'Pending' END AS status_text,
           CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice * CAST(1.02 AS DOUBLE)
                WHEN o_orderkey % 11 = 0 THEN o_totalprice + CAST(0.005 AS DOUBLE) ELSE o_totalprice END AS price,
           CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderpriority END AS priority
    FROM orders"""


def orders_pair(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf, "orders"), orders_target(spark, sf)


ORDERS_KEY = {"name": "o_orderkey", "target": "order_id"}
STATUS = {
    "name": "status", "source": "o_orderstatus", "target": "status_text", "mapping": STATUS_WORDS, "apply_to": "source",
}
PRICE = {"name": "price", "source": "o_totalprice", "tolerance": 0.01}
PRIORITY = {"name": "priority", "source": "o_orderpriority"}
ORDER_DATE = {"name": "order_date", "source": "o_orderdate"}


def spec(*fields: dict, keys: list | None = None, **filters: list) -> dict:
    body = {"keys": keys or [ORDERS_KEY], "fields": list(fields)}
    if filters:
        body["filters"] = filters
    return {"reconciliation": body}


def orders_spec() -> dict:
    return spec(STATUS, PRICE, PRIORITY, ORDER_DATE)


def absolute_sql(a: str, b: str, tolerance: float) -> str:
    limit = f"CAST({tolerance + 1e-9!r} AS DOUBLE)"
    return f"(coalesce(abs({a} - {b}) <= {limit} OR {a} = {b}, false) OR ({a} IS NULL AND {b} IS NULL))"


def percent_sql(a: str, b: str, share: float) -> str:
    close = f"CASE WHEN {a} = 0 THEN {b} = 0 ELSE abs({a} - {b}) / abs({a}) <= CAST({share!r} AS DOUBLE) END"
    return f"(coalesce({close}, false) OR ({a} IS NULL AND {b} IS NULL))"


def same_sql(a: str, b: str) -> str:
    return f"({a} IS NOT DISTINCT FROM {b})"


def category_sql(*matches: str) -> str:
    agree = " AND ".join(matches) or "true"
    return (
        f"CASE WHEN s_here AND t_here AND {agree} THEN 'matched' WHEN s_here AND t_here THEN 'different' "
        "WHEN s_here THEN 'missing_in_target' ELSE 'missing_in_source' END"
    )


def orders_joined_sql(source: str = "SELECT * FROM orders", target: str = ORDERS_TARGET_SQL) -> str:
    """CTE ``j``: the outer-joined orders pair with source status mapped."""
    return f"""
WITH src AS ({source}), tgt AS ({target}),
j AS (
    SELECT coalesce(s.o_orderkey, t.order_id) AS o_orderkey,
           s.o_orderstatus AS source_raw_status,
           CASE s.o_orderstatus WHEN 'O' THEN 'Open' WHEN 'F' THEN 'Filled' WHEN 'P' THEN 'Pending'
                ELSE s.o_orderstatus END AS source_status,
           t.status_text AS target_status, s.o_totalprice AS source_price, t.price AS target_price,
           s.o_orderpriority AS source_priority, t.priority AS target_priority,
           s.o_orderdate AS source_order_date, t.order_date AS target_order_date,
           s.o_custkey AS source_cust, t.cust AS target_cust,
           coalesce(s.here, false) AS s_here, coalesce(t.here, false) AS t_here
    FROM (SELECT *, true AS here FROM src) s
    FULL OUTER JOIN (SELECT *, true AS here FROM tgt) t ON s.o_orderkey IS NOT DISTINCT FROM t.order_id
)"""


M_STATUS = same_sql("source_status", "target_status")
M_PRICE = absolute_sql("source_price", "target_price", 0.01)
M_PRIORITY = same_sql("source_priority", "target_priority")
M_DATE = same_sql("source_order_date", "target_order_date")


def orders_classified_sql() -> str:
    """CTE ``c``: the orders pair under ``orders_spec`` with a verdict per field and a category."""
    return orders_joined_sql() + f""",
m AS (SELECT *, {M_STATUS} AS m_status, {M_PRICE} AS m_price, {M_PRIORITY} AS m_priority, {M_DATE} AS m_date FROM j),
c AS (
    SELECT *, {category_sql('m_status', 'm_price', 'm_priority', 'm_date')} AS category,
           concat_ws(',', CASE WHEN NOT m_status THEN 'status' END, CASE WHEN NOT m_price THEN 'price' END,
                     CASE WHEN NOT m_priority THEN 'priority' END, CASE WHEN NOT m_date THEN 'order_date' END) AS broken
    FROM m
)"""


SUMMARY_COLUMNS_SQL = """
    count(*) FILTER (WHERE category = 'matched') AS matched,
    count(*) FILTER (WHERE category = 'different') AS different,
    count(*) FILTER (WHERE category = 'missing_in_source') AS missing_in_source,
    count(*) FILTER (WHERE category = 'missing_in_target') AS missing_in_target"""


def summary_sql(ctes: str, source_count: str, target_count: str, classified: str = "c") -> str:
    return f"""{ctes},
n AS (SELECT {SUMMARY_COLUMNS_SQL} FROM {classified})
SELECT ({source_count}) AS total_source, ({target_count}) AS total_target,
       matched, different, missing_in_source, missing_in_target,
       CASE WHEN matched + different > 0 THEN matched / (matched + different) ELSE 0.0 END AS match_rate,
       CASE WHEN matched + different > 0 THEN different / (matched + different) ELSE 0.0 END AS difference_rate
FROM n"""


# -- lineitem pair (duplicate keys) -------------------------------------------

LINE_KEYS = ["l_orderkey", "l_linenumber"]


def lineitem_pair(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    lines = table(spark, sf, "lineitem")
    altered = lines.selectExpr(
        "l_orderkey", "l_linenumber", "l_quantity",
        "case when l_partkey % 9 = 0 then l_extendedprice + 1 else l_extendedprice end as l_extendedprice",
        "l_returnflag",
    )
    return lines, altered


LINEITEM_CTES = """
WITH src AS (SELECT *, true AS here FROM lineitem),
tgt AS (
    SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag, true AS here,
           CASE WHEN l_partkey % 9 = 0 THEN l_extendedprice + 1 ELSE l_extendedprice END AS l_extendedprice
    FROM lineitem
),
m AS (
    SELECT coalesce(s.here, false) AS s_here, coalesce(t.here, false) AS t_here,
           s.l_quantity AS sq, t.l_quantity AS tq, s.l_extendedprice AS sp, t.l_extendedprice AS tp,
           s.l_returnflag AS sf, t.l_returnflag AS tf,
           coalesce(s.l_orderkey, t.l_orderkey) AS l_orderkey, coalesce(s.l_linenumber, t.l_linenumber) AS l_linenumber
    FROM src s FULL OUTER JOIN tgt t
      ON s.l_orderkey IS NOT DISTINCT FROM t.l_orderkey AND s.l_linenumber IS NOT DISTINCT FROM t.l_linenumber
)"""


def lineitem_spec() -> dict:
    return spec(
        {"name": "l_quantity", "tolerance": 1.0},
        {"name": "l_extendedprice", "tolerance": "0.5%"},
        {"name": "l_returnflag"},
        keys=LINE_KEYS,
    )


M_LINE = {
    "l_quantity": absolute_sql("sq", "tq", 1.0),
    "l_extendedprice": percent_sql("sp", "tp", 0.005),
    "l_returnflag": same_sql("sf", "tf"),
}
