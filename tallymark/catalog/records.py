"""Queries on the join, comparison, classification, statistics, post-join steps and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.catalog.base import (
    LINEITEM_CTES,
    M_LINE,
    M_PRICE,
    ORDER_DATE,
    ORDERS_TARGET_SQL,
    PRICE,
    PRIORITY,
    STATUS,
    SUMMARY_COLUMNS_SQL,
    absolute_sql,
    category_sql,
    lineitem_pair,
    lineitem_spec,
    orders_classified_sql,
    orders_joined_sql,
    orders_pair,
    orders_spec,
    percent_sql,
    register,
    same_sql,
    spec,
    summary_sql,
    table,
)
from tallymark.operators.joins import find_hot_keys
from tallymark.plans import reports
from tallymark.plans.reconcile import Skew, reconcile

COUNT_ORDERS = "SELECT count(*) FROM orders"


def _orders(spark: SparkSession, sf: str, *fields: dict, **options):
    return reconcile(*orders_pair(spark, sf), spec(*fields) if fields else orders_spec(), **options)


# -- joins ----------------------------------------------------------------------


@register(
    "rec_outer",
    orders_joined_sql()
    + """ SELECT o_orderkey, source_status, target_status, source_price, target_price, source_priority, target_priority,
          source_order_date, target_order_date, CASE WHEN s_here AND t_here THEN 'both' WHEN s_here THEN 'left_only'
          ELSE 'right_only' END AS merge_indicator FROM j""",
)
def rec_outer(spark: SparkSession, sf: str) -> DataFrame:
    return _orders(spark, sf).merged()


@register(
    "rec_missing_in_target",
    orders_joined_sql() + " SELECT o_orderkey, source_price, source_priority FROM j WHERE NOT t_here",
)
def rec_missing_in_target(spark: SparkSession, sf: str) -> DataFrame:
    return _orders(spark, sf, PRICE, PRIORITY).missing_in_target()


@register(
    "rec_missing_in_source",
    orders_joined_sql() + " SELECT o_orderkey, target_price, target_priority FROM j WHERE NOT s_here",
)
def rec_missing_in_source(spark: SparkSession, sf: str) -> DataFrame:
    return _orders(spark, sf, PRICE, PRIORITY).missing_in_source()


# -- comparison ---------------------------------------------------------------------


def _verdict_sql(match: str, field: str = "price") -> str:
    return (
        orders_joined_sql()
        + f""" SELECT o_orderkey, source_{field}, target_{field}, {category_sql(match)} AS category,
               CASE WHEN s_here AND t_here AND NOT {match} THEN '{field}' END AS diff_fields FROM j"""
    )


@register("rec_exact", _verdict_sql(same_sql("source_price", "target_price")))
def rec_exact(spark: SparkSession, sf: str) -> DataFrame:
    return _orders(spark, sf, {**PRICE, "tolerance": None}).classified()


@register("rec_exact_text", _verdict_sql(same_sql("source_priority", "target_priority"), "priority"))
def rec_exact_text(spark: SparkSession, sf: str) -> DataFrame:
    return _orders(spark, sf, PRIORITY).classified()


@register("rec_abs", _verdict_sql(absolute_sql("source_price", "target_price", 0.01)))
def rec_abs(spark: SparkSession, sf: str) -> DataFrame:
    return _orders(spark, sf, PRICE).classified()


@register("rec_pct", _verdict_sql(percent_sql("source_price", "target_price", 0.01)))
def rec_pct(spark: SparkSession, sf: str) -> DataFrame:
    return _orders(spark, sf, {**PRICE, "tolerance": "1%"}).classified()


@register("rec_pct_zero_source", """
SELECT s.c_custkey, s.v AS source_v, t.v AS target_v,
       CASE WHEN CASE WHEN s.v = 0 THEN t.v = 0 ELSE abs(s.v - t.v) / abs(s.v) <= CAST(0.5 AS DOUBLE) END
            THEN 'matched' ELSE 'different' END AS category,
       CASE WHEN NOT CASE WHEN s.v = 0 THEN t.v = 0 ELSE abs(s.v - t.v) / abs(s.v) <= CAST(0.5 AS DOUBLE) END
            THEN 'v' END AS diff_fields
FROM (SELECT c_custkey, c_nationkey % 5 AS v FROM customer) s
JOIN (SELECT c_custkey, c_nationkey % 3 AS v FROM customer) t USING (c_custkey)""")
def rec_pct_zero_source(spark: SparkSession, sf: str) -> DataFrame:
    customer = table(spark, sf, "customer")
    sides = [customer.selectExpr("c_custkey", f"c_nationkey % {n} as v") for n in (5, 3)]
    return reconcile(*sides, spec({"name": "v", "tolerance": "50%"}, keys=["c_custkey"])).classified()


@register("rec_text_against_number", _verdict_sql("(source_cust IS NULL AND target_cust IS NULL)", "cust")
          .replace("source_cust, target_cust,", "CAST(source_cust AS VARCHAR) AS source_cust, target_cust,"))
def rec_text_against_number(spark: SparkSession, sf: str) -> DataFrame:
    """Exact comparison never matches a text with a number, even if they look alike."""
    source, target = orders_pair(spark, sf)
    source = source.withColumn("o_custkey", F.col("o_custkey").cast("string"))
    return reconcile(source, target, spec({"name": "cust", "source": "o_custkey"})).classified()


@register("rec_tolerance_on_text", _verdict_sql(absolute_sql("source_cust", "target_cust", 0.5), "cust")
          .replace("source_cust, target_cust,", "CAST(source_cust AS VARCHAR) AS source_cust, target_cust,"))
def rec_tolerance_on_text(spark: SparkSession, sf: str) -> DataFrame:
    """With a tolerance, number texts are compared as numbers."""
    source, target = orders_pair(spark, sf)
    source = source.withColumn("o_custkey", F.col("o_custkey").cast("string"))
    return reconcile(source, target, spec({"name": "cust", "source": "o_custkey", "tolerance": 0.5})).classified()


@register(
    "rec_ignore",
    orders_joined_sql()
    + f""" SELECT o_orderkey, source_price, target_price, source_priority, target_priority,
           {category_sql(M_PRICE)} AS category,
           CASE WHEN s_here AND t_here AND NOT {M_PRICE} THEN 'price' END AS diff_fields FROM j""",
)
def rec_ignore(spark: SparkSession, sf: str) -> DataFrame:
    return _orders(spark, sf, PRICE, {**PRIORITY, "ignore": True}).classified()


CLASSIFIED_COLUMNS = """o_orderkey, source_status, target_status, source_price, target_price, source_priority,
    target_priority, source_order_date, target_order_date, category,
    CASE WHEN category = 'different' THEN broken END AS diff_fields"""


@register("rec_classified", orders_classified_sql() + f" SELECT {CLASSIFIED_COLUMNS} FROM c")
def rec_classified(spark: SparkSession, sf: str) -> DataFrame:
    return _orders(spark, sf).classified()


@register(
    "rec_breaks",
    orders_classified_sql()
    + """ SELECT o_orderkey, 'status' AS field, source_status AS source_value, target_status AS target_value
          FROM c WHERE category = 'different' AND NOT m_status
          UNION ALL
          SELECT o_orderkey, 'priority', source_priority, target_priority
          FROM c WHERE category = 'different' AND NOT m_priority
          UNION ALL
          SELECT o_orderkey, 'price', CAST(source_price AS VARCHAR), CAST(target_price AS VARCHAR)
          FROM c WHERE category = 'different' AND NOT m_price""",
)
def rec_breaks(spark: SparkSession, sf: str) -> DataFrame:
    return _orders(spark, sf).breaks()


# -- statistics ------------------------------------------------------------------------


@register("rec_summary", summary_sql(orders_classified_sql(), COUNT_ORDERS, COUNT_ORDERS))
def rec_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _orders(spark, sf).summary()


@register(
    "rec_summary_filtered",
    summary_sql(
        orders_joined_sql(
            source="SELECT * FROM orders WHERE o_orderpriority <> '5-LOW' AND o_totalprice >= 1500",
            target=f"SELECT * FROM ({ORDERS_TARGET_SQL}) AS t WHERE coalesce(priority, '') <> '5-LOW'",
        )
        + f", c AS (SELECT *, {category_sql(M_PRICE)} AS category FROM j)",
        "SELECT count(*) FROM src",
        "SELECT count(*) FROM tgt",
    ),
)
def rec_summary_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """Totals count the rows the filters left."""
    not_low = {"condition": "not_equals", "value": "5-LOW"}
    source = [
        {"field": "o_orderpriority", **not_low},
        {"field": "o_totalprice", "condition": "greater_than_equal", "value": 1500},
    ]
    filtered = spec(PRICE, source=source, target=[{"field": "priority", **not_low}])
    return reconcile(*orders_pair(spark, sf), filtered).summary()


@register(
    "rec_summary_lineitem",
    summary_sql(
        LINEITEM_CTES + f", c AS (SELECT *, {category_sql(*M_LINE.values())} AS category FROM m)",
        "SELECT count(*) FROM lineitem",
        "SELECT count(*) FROM lineitem",
    ),
)
def rec_summary_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    """Duplicate keys multiply."""
    return reconcile(*lineitem_pair(spark, sf), lineitem_spec()).summary()


def _customer_days(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    events = table(spark, sf, "events")
    source = events.selectExpr("if(event_id % 3 = 0, null, user_id) as user_id", "event_type", "value")
    target = table(spark, sf, "customer").selectExpr(
        "if(c_custkey % 50 = 0, null, c_custkey) as user_id", "'view' as event_type", "c_acctbal as value"
    )
    return source, target


HOT_SPEC = spec({"name": "event_type"}, keys=["user_id"])
HOT_CTES = """
WITH src AS (SELECT CASE WHEN event_id % 3 <> 0 THEN user_id END AS user_id, event_type, true AS here FROM events),
tgt AS (SELECT CASE WHEN c_custkey % 50 <> 0 THEN c_custkey END AS user_id, 'view' AS event_type, true AS here
        FROM customer),
m AS (SELECT coalesce(s.user_id, t.user_id) AS user_id, s.event_type AS se, t.event_type AS te,
             coalesce(s.here, false) AS s_here, coalesce(t.here, false) AS t_here
      FROM src s FULL OUTER JOIN tgt t ON s.user_id IS NOT DISTINCT FROM t.user_id),
c AS (SELECT *, """ + category_sql(same_sql("se", "te")) + """ AS category FROM m)"""


def _hot(spark: SparkSession, sf: str):
    """A third of the source rows share one (missing) key, which is also found on the target."""
    skew = Skew("always", share=0.05, min_rows=50, rows_per_cell=500)
    return reconcile(*_customer_days(spark, sf), HOT_SPEC, skew=skew)


@register(
    "rec_hot_key_summary",
    summary_sql(HOT_CTES, "SELECT count(*) FROM events", "SELECT count(*) FROM customer"),
)
def rec_hot_key_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _hot(spark, sf).summary()


@register(
    "rec_hot_key_rows",
    HOT_CTES + """ SELECT user_id, se AS source_event_type, te AS target_event_type, category,
                         CASE WHEN category = 'different' THEN 'event_type' END AS diff_fields FROM c""",
)
def rec_hot_key_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _hot(spark, sf).classified()


@register(
    "rec_hot_key_repeats",
    """WITH s AS (SELECT l_linestatus AS k, count(*) AS n FROM lineitem GROUP BY 1),
     t AS (SELECT o_orderstatus AS k, count(*) AS n FROM orders GROUP BY 1)
SELECT CASE WHEN s.n IS NULL THEN 'missing_in_source' ELSE 'matched' END AS category, CAST(sum(coalesce(s.n, 1) * t.n) AS BIGINT) AS records
FROM t LEFT JOIN s USING (k) GROUP BY 1""",
)
def rec_hot_key_repeats(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs of equal rows of two hot keys, classified folded and counted."""
    source = table(spark, sf, "lineitem").selectExpr("l_linestatus as k", "'x' as v")
    target = table(spark, sf, "orders").selectExpr("o_orderstatus as k", "'x' as v")
    result = reconcile(source, target, spec({"name": "v"}, keys=["k"]), skew=Skew("always", share=0.05, min_rows=50))
    return result.classified(folded=True).groupBy("category").agg(F.sum("records").alias("records"))


@register(
    "rec_hot_wide_tolerance",
    """WITH s AS (SELECT l_returnflag AS k, l_extendedprice AS v FROM lineitem),
     t AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 'A' WHEN o_orderstatus = 'O' THEN 'N' ELSE 'P' END AS k, o_totalprice AS v FROM orders),
     p AS (SELECT CAST(count(*) AS BIGINT) AS comparable, CAST(count(*) FILTER (WHERE abs(s.v - t.v) <= 90000 + 1e-9) AS BIGINT) AS matches
           FROM s JOIN t USING (k))
SELECT 'v' AS field, matches, comparable - matches AS differences, comparable, matches / comparable AS match_rate, CAST(0 AS BIGINT) AS non_numeric
FROM p""",
)
def rec_hot_wide_tolerance(spark: SparkSession, sf: str) -> DataFrame:
    """Field statistics of hot keys with a tolerance nearly as wide as the values' spread."""
    source = table(spark, sf, "lineitem").selectExpr("l_returnflag as k", "l_extendedprice as v")
    target = table(spark, sf, "orders").selectExpr(
        "case when o_orderstatus = 'F' then 'A' when o_orderstatus = 'O' then 'N' else 'P' end as k", "o_totalprice as v"
    )
    wanted = spec({"name": "v", "tolerance": 90_000}, keys=["k"])
    return reconcile(source, target, wanted, skew=Skew("always", share=0.05, min_rows=50)).field_stats()


@register(
    "rec_hot_keys",
    """SELECT sum(CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END) AS source_rows,
              (SELECT count(*) FROM customer WHERE c_custkey % 50 = 0) AS target_rows FROM events""",
)
def rec_hot_keys(spark: SparkSession, sf: str) -> DataFrame:
    """The one key above a fifth of a side's rows, with exact counts."""
    found = find_hot_keys(*_customer_days(spark, sf), ["user_id"], share=0.2, min_rows=1)
    return spark.createDataFrame([(k.source_rows, k.target_rows) for k in found], "source_rows long, target_rows long")


def _stats_select(field: str, match: str, s: str, t: str) -> str:
    comparable = f"({s} IS NOT NULL OR {t} IS NOT NULL)"
    return f"""SELECT '{field}' AS field, count(*) FILTER (WHERE {comparable} AND {match}) AS matches,
        count(*) FILTER (WHERE {comparable} AND NOT {match}) AS differences,
        count(*) FILTER (WHERE {comparable}) AS comparable,
        coalesce(count(*) FILTER (WHERE {comparable} AND {match}) / nullif(count(*) FILTER (WHERE {comparable}), 0), 0)
            AS match_rate"""


def _orders_stats_sql() -> str:
    parts = [
        _stats_select(f, m, f"source_{f}", f"target_{f}") + " FROM c WHERE s_here AND t_here"
        for f, m in (("status", "m_status"), ("price", "m_price"), ("priority", "m_priority"), ("order_date", "m_date"))
    ]
    return orders_classified_sql() + ", stats AS (" + " UNION ALL ".join(parts) + ")"


@register("rec_field_stats", _orders_stats_sql() + " SELECT *, CAST(0 AS BIGINT) AS non_numeric FROM stats")
def rec_field_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _orders(spark, sf).field_stats()


@register(
    "rec_statistics",
    _orders_stats_sql()
    + f""", n AS (SELECT {SUMMARY_COLUMNS_SQL} FROM c)
SELECT ({COUNT_ORDERS}) AS total_source, ({COUNT_ORDERS}) AS total_target, n.*,
       matched / (matched + different) AS record_match_rate,
       different / (matched + different) AS record_difference_rate, stats.*, CAST(0 AS BIGINT) AS non_numeric
FROM n, stats""",
)
def rec_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """Record and field statistics from one pass over the joined rows."""
    rates = {"match_rate": "record_match_rate", "difference_rate": "record_difference_rate"}
    row = _orders(spark, sf).statistics().withColumnsRenamed(rates)
    counts = [c for c in row.columns if c != "field_statistics"]
    return row.select(*counts, F.inline("field_statistics"))


STATUS_SQL = "CASE WHEN match_rate >= 1 THEN 'perfect' ELSE 'imperfect' END AS status"


@register(
    "rec_field_status", _orders_stats_sql() + f" SELECT *, CAST(0 AS BIGINT) AS non_numeric, {STATUS_SQL} FROM stats"
)
def rec_field_status(spark: SparkSession, sf: str) -> DataFrame:
    return _orders(spark, sf).field_status()


@register(
    "rec_field_stats_lineitem",
    LINEITEM_CTES
    + ", stats AS ("
    + " UNION ALL ".join(
        _stats_select(f, M_LINE[f], s, t) + " FROM m WHERE s_here AND t_here"
        for f, s, t in (("l_quantity", "sq", "tq"), ("l_extendedprice", "sp", "tp"), ("l_returnflag", "sf", "tf"))
    )
    + ") SELECT *, CAST(0 AS BIGINT) AS non_numeric FROM stats",
)
def rec_field_stats_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    return reconcile(*lineitem_pair(spark, sf), lineitem_spec()).field_stats()


@register(
    "rec_non_numeric",
    """SELECT 'priority' AS field, count(*) AS matches, CAST(0 AS BIGINT) AS differences, count(*) AS comparable,
              CAST(1.0 AS DOUBLE) AS match_rate, count(*) AS non_numeric
       FROM orders WHERE o_orderkey % 10 <> 0""",
)
def rec_non_numeric(spark: SparkSession, sf: str) -> DataFrame:
    """With a tolerance two texts that are no numbers match; they are counted so that it shows."""
    return _orders(spark, sf, {**PRIORITY, "tolerance": 0.5}).field_stats()


@register(
    "rec_duplicate_keys",
    """SELECT l_orderkey, l_linenumber, count(*) AS row_count, side FROM (
         SELECT *, 'source' AS side FROM lineitem UNION ALL SELECT *, 'target' AS side FROM lineitem) AS u
       GROUP BY l_orderkey, l_linenumber, side HAVING count(*) > 1""",
)
def rec_duplicate_keys(spark: SparkSession, sf: str) -> DataFrame:
    return reconcile(*lineitem_pair(spark, sf), lineitem_spec()).duplicate_keys()


# -- post-join steps ------------------------------------------------------------------


def _settlement_pair(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf, "orders")
    target = orders.selectExpr(
        "o_orderkey",
        "date_format(o_orderdate, 'yyyy-MM-dd') as settle",
        "date_format(o_orderdate + make_dt_interval(int(o_orderkey % 3)), 'dd/MM/yy') as rep",
        "if(o_orderkey % 5 = 0, 0D, o_totalprice) as mtm",
    )
    return orders, target


def _settlement_result(spark: SparkSession, sf: str):
    mtm = {
        "name": "mtm", "source": "o_totalprice", "tolerance": 0.01,
        "force_zero_when_settled": {"settlement_field": "settle", "reporting_field": "rep"},
    }
    fields = [mtm, {"name": "settle", "ignore": True}, {"name": "rep", "ignore": True}]
    return reconcile(*_settlement_pair(spark, sf), spec(*fields, keys=["o_orderkey"]))


SETTLED_CTE = """
WITH c AS (
    SELECT o_orderkey, o_totalprice AS old, CASE WHEN o_orderkey % 5 = 0 THEN 0.0 ELSE o_totalprice END AS target_mtm,
           CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 5 = 0 THEN 0.0 ELSE o_totalprice END AS source_mtm
    FROM orders
)"""


@register(
    "rec_force_zero",
    SETTLED_CTE + f""" SELECT o_orderkey, source_mtm, target_mtm,
    CASE WHEN {absolute_sql('source_mtm', 'target_mtm', 0.01)} THEN 'matched' ELSE 'different' END AS category FROM c""",
)
def rec_force_zero(spark: SparkSession, sf: str) -> DataFrame:
    return _settlement_result(spark, sf).classified().select("o_orderkey", "source_mtm", "target_mtm", "category")


ADJUSTED_SQL = """
SELECT o_orderkey, 'matched' AS category, 'source' AS side, 'mtm' AS field, CAST(old AS VARCHAR) AS original,
       '0.0' AS adjusted, 'Settlement date = reporting date and target MTM is 0' AS reason
FROM c WHERE old <> source_mtm"""


@register("rec_adjustments", SETTLED_CTE + ADJUSTED_SQL)
def rec_adjustments(spark: SparkSession, sf: str) -> DataFrame:
    return _settlement_result(spark, sf).adjustments()


def _post_result(spark: SparkSession, sf: str):
    price = {
        **PRICE,
        "post_merge_source_calculation": "case when source_priority = '5-LOW' then target_price else source_price end",
        "post_merge_comment": "low priority takes the target price",
    }
    return _orders(spark, sf, price, PRIORITY)


POST_SOURCE = "CASE WHEN source_priority = '5-LOW' THEN target_price ELSE source_price END"


@register(
    "rec_post_source",
    orders_joined_sql()
    + f""", p AS (SELECT * REPLACE ({POST_SOURCE} AS source_price) FROM j)
SELECT o_orderkey, source_price, target_price, {category_sql(M_PRICE, same_sql('source_priority', 'target_priority'))}
AS category FROM p""",
)
def rec_post_source(spark: SparkSession, sf: str) -> DataFrame:
    return _post_result(spark, sf).classified().select("o_orderkey", "source_price", "target_price", "category")


@register(
    "rec_post_target",
    orders_joined_sql()
    + f""", p AS (SELECT * REPLACE (coalesce(target_priority, source_priority) AS target_priority) FROM j)
SELECT o_orderkey, target_priority, {category_sql(same_sql('source_priority', 'target_priority'))} AS category FROM p""",
)
def rec_post_target(spark: SparkSession, sf: str) -> DataFrame:
    priority = {
        **PRIORITY,
        "post_merge_target_calculation": lambda df: F.coalesce(df["target_priority"], df["source_priority"]),
    }
    return _orders(spark, sf, priority).classified().select("o_orderkey", "target_priority", "category")


@register(
    "rec_adjusted_keys",
    orders_joined_sql()
    + f""", p AS (SELECT *, {POST_SOURCE} AS changed FROM j)
SELECT o_orderkey, {category_sql(absolute_sql('changed', 'target_price', 0.01),
                                 same_sql('source_priority', 'target_priority'))} AS category,
       'source' AS side, 'price' AS field, CAST(source_price AS VARCHAR) AS original,
       CAST(changed AS VARCHAR) AS adjusted, 'low priority takes the target price' AS reason
FROM p WHERE changed IS DISTINCT FROM source_price""",
)
def rec_adjusted_keys(spark: SparkSession, sf: str) -> DataFrame:
    return _post_result(spark, sf).adjustments()


# -- reports -------------------------------------------------------------------------


def _report_result(spark: SparkSession, sf: str):
    price = {**PRICE, "diff_amount": True, "diff_percent": True}
    return _orders(spark, sf, STATUS, price, {**PRIORITY, "ignore": True}, {**ORDER_DATE, "hidden": True})


def _report_sql(category: str, *extra: str) -> str:
    columns = """o_orderkey, source_status AS "Source: status", target_status AS "Target: status",
        source_price AS "Source: price", target_price AS "Target: price",
        source_price - target_price AS "Diff Amount: price",
        round_even(CASE WHEN abs(target_price) > 0 THEN (source_price - target_price) / abs(target_price) * 100
                        WHEN source_price = target_price THEN 0.0 END * 10000, 0) / 10000 AS "Diff %: price",
        source_priority AS "Source: priority (ignored)", target_priority AS "Target: priority (ignored)" """
    return (
        orders_classified_sql()
        + f""", r AS (SELECT * REPLACE ({category_sql('m_status', 'm_price', 'm_date')} AS category,
                concat_ws(',', CASE WHEN NOT m_status THEN 'status' END, CASE WHEN NOT m_price THEN 'price' END)
                AS broken) FROM c)
        SELECT {', '.join([columns, *extra])} FROM r WHERE category = '{category}'"""
    )


@register("report_matched", _report_sql("matched"))
def report_matched(spark: SparkSession, sf: str) -> DataFrame:
    return reports.matched_report(_report_result(spark, sf))


@register("report_different", _report_sql("different", "broken AS diff_fields"))
def report_different(spark: SparkSession, sf: str) -> DataFrame:
    return reports.different_report(_report_result(spark, sf))


@register(
    "report_missing_target",
    orders_joined_sql()
    + """ SELECT o_orderkey, source_raw_status AS status, source_price AS price, source_priority AS priority
          FROM j WHERE NOT t_here""",
)
def report_missing_target(spark: SparkSession, sf: str) -> DataFrame:
    return reports.missing_in_target_report(_report_result(spark, sf))


@register(
    "report_missing_source",
    orders_joined_sql()
    + """ SELECT o_orderkey, target_status AS status, target_price AS price, target_priority AS priority
          FROM j WHERE NOT s_here""",
)
def report_missing_source(spark: SparkSession, sf: str) -> DataFrame:
    return reports.missing_in_source_report(_report_result(spark, sf))


@register(
    "report_summary",
    orders_joined_sql(source="SELECT * FROM orders WHERE o_orderpriority <> '5-LOW'")
    + f""", c AS (SELECT *, {category_sql(M_PRICE, same_sql('source_priority', 'target_priority'))} AS category FROM j),
n AS (SELECT (SELECT count(*) FROM src) AS total_source, (SELECT count(*) FROM tgt) AS total_target,
             count(*) FILTER (WHERE category = 'matched') AS matched,
             count(*) FILTER (WHERE category = 'different') AS different,
             count(*) FILTER (WHERE category = 'missing_in_source') AS missing_in_source,
             count(*) FILTER (WHERE category = 'missing_in_target') AS missing_in_target FROM c)
SELECT 0 AS position, 'Run' AS section, 'Source File' AS label, 'orders' AS value
UNION ALL SELECT 1, 'Run', 'Target File', 'N/A'
UNION ALL SELECT 2, 'Run', 'Config File', 'N/A'
UNION ALL SELECT 3, 'Run', 'Recon Date', 'N/A'
UNION ALL SELECT 4, 'Run', 'Execution Time', 'N/A'
UNION ALL SELECT 5, 'Reconciliation Configuration', 'Reconciliation Keys', 'o_orderkey'
UNION ALL SELECT 6, 'Reconciliation Configuration', 'Configured Fields', 'price, priority'
UNION ALL SELECT 7, 'Reconciliation Configuration', 'Data Filters', 'Source: o_orderpriority not_equals ''5-LOW'''
UNION ALL SELECT 8, 'Reconciliation Statistics', 'Total Source Records', CAST(total_source AS VARCHAR) FROM n
UNION ALL SELECT 9, 'Reconciliation Statistics', 'Total Target Records', CAST(total_target AS VARCHAR) FROM n
UNION ALL SELECT 10, 'Reconciliation Statistics', 'Matched Records', CAST(matched AS VARCHAR) FROM n
UNION ALL SELECT 11, 'Reconciliation Statistics', 'Different Records', CAST(different AS VARCHAR) FROM n
UNION ALL SELECT 12, 'Reconciliation Statistics', 'Missing in Source', CAST(missing_in_source AS VARCHAR) FROM n
UNION ALL SELECT 13, 'Reconciliation Statistics', 'Missing in Target', CAST(missing_in_target AS VARCHAR) FROM n""",
)
def report_summary(spark: SparkSession, sf: str) -> DataFrame:
    filters = [{"field": "o_orderpriority", "condition": "not_equals", "value": "5-LOW"}]
    # listed in source column order, so the price comes first
    result = reconcile(*orders_pair(spark, sf), spec(PRIORITY, PRICE, source=filters))
    return reports.summary_report(result, {"source_file": "orders"})


@register(
    "report_field_stats",
    _orders_stats_sql()
    + f""" SELECT CASE field WHEN 'status' THEN 0 WHEN 'price' THEN 1 WHEN 'priority' THEN 2 ELSE 3 END AS position,
           field, matches, differences, comparable, match_rate, {STATUS_SQL} FROM stats""",
)
def report_field_stats(spark: SparkSession, sf: str) -> DataFrame:
    return reports.field_statistics_report(_orders(spark, sf))


@register(
    "report_transformations",
    orders_classified_sql()
    + """ SELECT o_orderkey, category, 'source' AS side, 'status' AS field, 'mapping' AS kind,
          source_raw_status AS original, source_status AS "new", source_raw_status || ' -> ' || source_status AS rule
          FROM c WHERE s_here AND t_here AND source_raw_status <> source_status""",
)
def report_transformations(spark: SparkSession, sf: str) -> DataFrame:
    return reports.transformations_report(_orders(spark, sf))


@register("report_adjustments", SETTLED_CTE + ADJUSTED_SQL)
def report_adjustments(spark: SparkSession, sf: str) -> DataFrame:
    return reports.adjustments_report(_settlement_result(spark, sf))
