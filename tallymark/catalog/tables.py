"""Queries on lookup append, aggregation, dataset quality, files and batches."""

from __future__ import annotations

import datetime
import time
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.catalog.base import (
    LINEITEM_CTES,
    M_LINE,
    SUMMARY_COLUMNS_SQL,
    category_sql,
    lineitem_pair,
    lineitem_spec,
    orders_classified_sql,
    orders_pair,
    orders_spec,
    orders_target,
    register,
    same_sql,
    scratch_folder,
    spec,
    table,
)
from tallymark.operators.lookup import aggregate_by, append_aggregate, append_columns, repeated_keys
from tallymark.operators.mapping import map_values
from tallymark.operators.quality import check_dataset, clean_names, dataset_check, profile, profile_columns, standardize
from tallymark.plans.batch import Job, append_summary, first_present, reconcile_batch, summarize_values
from tallymark.plans.reconcile import reconcile
from tallymark.plans.spec import parse_spec, run_name
from tallymark.sources import readers, sinks

# -- aggregation -------------------------------------------------------------------

LINE_ORDER = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
_LINE_ORDER_SQL = ", ".join(LINE_ORDER)
_LINE_ORDER_DESC_SQL = ", ".join(f"{c} DESC" for c in LINE_ORDER)

AGGREGATE_SQL = {
    "sum": "sum({0})",
    "mean": "avg({0})",
    "min": "min({0})",
    "max": "max({0})",
    "first": f"first({{0}} ORDER BY {_LINE_ORDER_SQL}) FILTER (WHERE {{0}} IS NOT NULL)",
    "last": f"first({{0}} ORDER BY {_LINE_ORDER_DESC_SQL}) FILTER (WHERE {{0}} IS NOT NULL)",
}


def _sparse_lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").withColumns(
        {
            "l_orderkey": F.expr("if(l_partkey % 20 = 0, null, l_orderkey)"),
            "l_quantity": F.expr("if(l_suppkey % 2 = 0, null, l_quantity)"),
        }
    )


def _pivot_query(function: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        order = LINE_ORDER if function in ("first", "last") else None
        return aggregate_by(_sparse_lines(spark, sf), ["l_orderkey"], ["l_quantity"], function, order_by=order)

    return query


for _function, _expression in AGGREGATE_SQL.items():
    _value = _expression.format("l_quantity")
    _value = f"coalesce({_value}, 0)" if _function == "sum" else _value
    register(
        f"pivot_{_function}",
        f"""SELECT l_orderkey, {_value} AS l_quantity FROM (
              SELECT * REPLACE (CASE WHEN l_suppkey % 2 <> 0 THEN l_quantity END AS l_quantity) FROM lineitem
              WHERE l_partkey % 20 <> 0) AS l
            GROUP BY l_orderkey""",
    )(_pivot_query(_function))


@register(
    "pivot_composite",
    """SELECT l_returnflag, l_linestatus, max(l_extendedprice) AS l_extendedprice, max(l_quantity) AS l_quantity
       FROM lineitem GROUP BY l_returnflag, l_linestatus""",
)
def pivot_composite(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    return aggregate_by(lines, ["l_returnflag", "l_linestatus"], ["l_extendedprice", "l_quantity"], "max")


# -- lookup -----------------------------------------------------------------------


@register(
    "lookup_append",
    """SELECT c.*, coalesce(n.n_name, '') AS n_name
       FROM (SELECT *, 'key ' || c_nationkey AS nation FROM customer) c
       LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey AND n.n_nationkey % 4 <> 1""",
)
def lookup_append(spark: SparkSession, sf: str) -> DataFrame:
    """Different key names, trimmed text keys, blanks where there is no partner."""
    customer = table(spark, sf, "customer").withColumn("nation", F.expr("concat('key ', c_nationkey)"))
    nation = table(spark, sf, "nation").withColumn(
        "label", F.expr("concat(if(n_nationkey % 4 = 1, 'other ', ' key '), n_nationkey, '  ')")
    )
    return append_columns(customer, nation, "nation=LABEL", ["N_NAME"], unique=True)


@register(
    "lookup_composite",
    """WITH last_line AS (
         SELECT l_orderkey, l_linenumber,
                first(l_returnflag ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC)
                  AS flag,
                first(l_partkey ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS part
         FROM lineitem GROUP BY l_orderkey, l_linenumber)
       SELECT o.o_orderkey, o.line, coalesce(flag, '') AS flag, coalesce(CAST(part AS VARCHAR), '') AS part
       FROM (SELECT o_orderkey, o_custkey % 7 + 1 AS line FROM orders) o
       LEFT JOIN last_line l ON o.o_orderkey = l.l_orderkey AND o.line = l.l_linenumber""",
)
def lookup_composite(spark: SparkSession, sf: str) -> DataFrame:
    left = table(spark, sf, "orders").selectExpr("o_orderkey", "o_custkey % 7 + 1 as line")
    return append_columns(
        left,
        table(spark, sf, "lineitem"),
        ["o_orderkey=l_orderkey", ("line", "l_linenumber")],
        ["l_returnflag", "l_partkey"],
        ["flag", "part"],
        order_by=["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"],
    )


@register(
    "lookup_last_wins",
    """SELECT c.c_custkey, coalesce(last_status, '') AS last_status FROM customer c LEFT JOIN (
         SELECT o_custkey, first(o_orderstatus ORDER BY o_orderdate DESC, o_orderkey DESC) AS last_status
         FROM orders GROUP BY o_custkey) o ON c.c_custkey = o.o_custkey""",
)
def lookup_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    return append_columns(
        table(spark, sf, "customer").select("c_custkey"),
        table(spark, sf, "orders"),
        "c_custkey=o_custkey",
        ["o_orderstatus"],
        ["last_status"],
        order_by=["o_orderdate", "o_orderkey"],
    )


@register(
    "lookup_repeated_keys",
    """SELECT count(*) AS lookup_rows, count(DISTINCT o_custkey) AS distinct_keys,
              count(*) - count(DISTINCT o_custkey) AS replaced_rows FROM orders""",
)
def lookup_repeated_keys(spark: SparkSession, sf: str) -> DataFrame:
    return repeated_keys(table(spark, sf, "orders"), ["O_CUSTKEY"])


@register(
    "lookup_blank_keys",
    """WITH l AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '   ' WHEN event_id % 3 = 1 THEN NULL
                         ELSE event_type END AS kind,
                         CASE WHEN event_id % 2 = 0 THEN '' ELSE 'x' END AS part FROM events),
            r AS (SELECT '' AS kind, '' AS part, 'never' AS note UNION ALL SELECT '', 'x', 'half'
                  UNION ALL SELECT DISTINCT event_type, 'x', 'is ' || event_type FROM events)
       SELECT l.*, coalesce(CASE WHEN coalesce(trim(l.kind), '') || l.part <> '' THEN r.note END, '') AS note
       FROM l LEFT JOIN r ON coalesce(trim(l.kind), '') = r.kind AND l.part = r.part""",
)
def lookup_blank_keys(spark: SparkSession, sf: str) -> DataFrame:
    """An all-blank key never matches, a part-blank one may; the lookup rows are made from the event types."""
    events = table(spark, sf, "events")
    left = events.selectExpr(
        "event_id",
        "case when event_id % 3 = 0 then '   ' when event_id % 3 = 1 then null else event_type end as kind",
        "if(event_id % 2 = 0, '', 'x') as part",
    )
    notes = "named_struct('kind', '', 'part', ' ', 'note', 'never'), named_struct('kind', ' ', 'part', 'x', 'note', 'half')"
    own = "named_struct('kind', event_type, 'part', 'x', 'note', concat('is ', event_type))"
    right = events.select("event_type").distinct().selectExpr(f"inline(array({notes}, {own}))").distinct()
    return append_columns(left, right, ["kind", "part"], ["note"], order_by="note")


@register(
    "pivot_lookup",
    """SELECT o.o_orderkey, o.o_custkey, coalesce(CAST(q AS VARCHAR), '') AS quantity FROM orders o
       LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY l_orderkey) l
         ON o.o_orderkey = l.l_orderkey""",
)
def pivot_lookup(spark: SparkSession, sf: str) -> DataFrame:
    left = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf, "lineitem")
    return append_aggregate(left, lines, "o_orderkey=l_orderkey", ["l_quantity"], ["quantity"])


@register(
    "pivot_lookup_padded_keys",
    """SELECT o.o_orderkey, coalesce(CAST(q AS VARCHAR), '') AS quantity
       FROM (SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey FROM orders) o
       LEFT JOIN (SELECT trim(k) AS k, arg_max(q, k) AS q
                  FROM (SELECT CAST(l_orderkey AS VARCHAR) || CASE WHEN l_linenumber % 2 = 0 THEN ' ' ELSE '' END AS k,
                               sum(l_quantity) AS q FROM lineitem GROUP BY 1)
                  GROUP BY 1) l ON o.o_orderkey = l.k""",
)
def pivot_lookup_padded_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Keys that differ by blanks are two groups of the aggregate, one key of the lookup; the last group wins."""
    left = table(spark, sf, "orders").selectExpr("cast(o_orderkey as string) as o_orderkey")
    padded = "concat(l_orderkey, if(l_linenumber % 2 = 0, ' ', '')) as k"
    lines = table(spark, sf, "lineitem").selectExpr(padded, "l_quantity")
    return append_aggregate(left, lines, "o_orderkey=k", ["l_quantity"], ["quantity"])


@register(
    "lookup_repeated_right",
    """SELECT c.c_custkey, coalesce(o.status, '') AS status FROM customer c
       LEFT JOIN (SELECT o_custkey, max(o_orderstatus) AS status FROM orders GROUP BY 1) o ON c.c_custkey = o.o_custkey""",
)
def lookup_repeated_right(spark: SparkSession, sf: str) -> DataFrame:
    """A right side that is said to be unique and is not: still every left row once."""
    left, right = table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "orders")
    return append_columns(left, right, "c_custkey=o_custkey", ["o_orderstatus"], ["status"], unique=True)


# -- mappings of typed columns, in both forms ------------------------------------------


def _typed_mapping(entries: int) -> None:
    """Old values that the column holds in another form are converted; those it cannot hold map nothing."""
    first = datetime.date(1992, 1, 1)

    @register(
        f"map_bigint_{entries}",
        f"""SELECT o_orderkey, CASE WHEN o_custkey BETWEEN 0 AND {entries - 1} AND o_custkey % 3 <> 0 THEN -o_custkey
            ELSE o_custkey END AS o_custkey FROM orders""",
    )
    def whole(spark: SparkSession, sf: str) -> DataFrame:
        mapping = {i + 0.5 if i % 3 == 0 else float(i) if i % 3 == 1 else i: -i for i in range(entries)}
        return map_values(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey", mapping)

    @register(
        f"map_double_{entries}",
        f"""SELECT l_orderkey, l_linenumber, CASE WHEN q BETWEEN 0 AND {entries // 4} THEN q * 10 ELSE q END AS q
            FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) / 4 AS q FROM lineitem)""",
    )
    def fractional(spark: SparkSession, sf: str) -> DataFrame:
        quarters = "cast(l_quantity as double) / 4 as q"
        mapping = {i // 4 if i % 4 == 0 else i / 4: i * 2.5 for i in range(entries // 4 * 4 + 1)}
        return map_values(table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", quarters), "q", mapping)

    @register(
        f"map_date_{entries}",
        f"""SELECT o_orderkey, CASE WHEN d BETWEEN DATE '1992-01-01' AND DATE '1992-01-01' + {entries - 1}
                AND (d - DATE '1992-01-01') % 3 <> 0 THEN DATE '2000-01-01' ELSE d END AS d
            FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""",
    )
    def days(spark: SparkSession, sf: str) -> DataFrame:
        new = datetime.date(2000, 1, 1)
        shift = datetime.timedelta(days=1)
        midnight = datetime.datetime(1992, 1, 1)
        forms = (lambda i: midnight + i * shift + shift / 2, lambda i: first + i * shift, lambda i: midnight + i * shift)
        mapping = {forms[i % 3](i): new for i in range(entries)}
        return map_values(table(spark, sf, "orders").selectExpr("o_orderkey", "cast(o_orderdate as date) as d"), "d", mapping)


_typed_mapping(60)
_typed_mapping(100)


# -- quality --------------------------------------------------------------------------


def _gappy_events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr(
        "event_id % 1000 as slot",
        "if(event_id % 4 = 0, null, event_type) as event_type",
        "if(event_id % 5 = 0, double('NaN'), round(value / 100)) as value",
        "cast(null as string) as note",
    )


_GAPPY_SQL = """SELECT event_id % 1000 AS slot, CASE WHEN event_id % 4 <> 0 THEN event_type END AS event_type,
    CASE WHEN event_id % 5 <> 0 THEN round(value / 100) END AS value, CAST(NULL AS VARCHAR) AS note FROM events"""


@register(
    "dataset_check", "SELECT count(*) AS rows, CAST(4 AS BIGINT) AS columns, 'note' AS empty_columns FROM events"
)
def dataset_check_query(spark: SparkSession, sf: str) -> DataFrame:
    return dataset_check(_gappy_events(spark, sf))


@register(
    "profile",
    f"""WITH e AS ({_GAPPY_SQL})
        SELECT count(*) AS rows, CAST(4 AS BIGINT) AS columns,
               4 * count(*) - count(slot) - count(event_type) - count(value) - count(note) AS total_nulls,
               count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM e) AS d) AS duplicate_rows FROM e""",
)
def profile_query(spark: SparkSession, sf: str) -> DataFrame:
    return profile(_gappy_events(spark, sf))


@register(
    "profile_columns",
    f"""WITH e AS ({_GAPPY_SQL})
        SELECT 0 AS position, 'slot' AS "column", 'bigint' AS type, count(*) - count(slot) AS null_count FROM e
        UNION ALL SELECT 1, 'event_type', 'string', count(*) - count(event_type) FROM e
        UNION ALL SELECT 2, 'value', 'double', count(*) - count(value) FROM e
        UNION ALL SELECT 3, 'note', 'string', count(*) FROM e""",
)
def profile_columns_query(spark: SparkSession, sf: str) -> DataFrame:
    return profile_columns(_gappy_events(spark, sf))


@register(
    "standardize",
    """SELECT c_custkey, CASE WHEN c_custkey % 6 >= 4 THEN NULL ELSE c_mktsegment END AS segment,
              CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS name FROM customer""",
)
def standardize_query(spark: SparkSession, sf: str) -> DataFrame:
    messy = table(spark, sf, "customer").selectExpr(
        "c_custkey",
        "case when c_custkey % 6 = 4 then '   ' when c_custkey % 6 = 5 then ' N/A' "
        "else concat(' ', c_mktsegment, '\t\n') end as segment",
        "if(c_custkey % 3 = 0, 'none', c_name) as name",
    )
    return standardize(messy)


@register("clean_names", """SELECT c_custkey AS "Deal Num", c_acctbal AS "Base MTM" FROM customer""")
def clean_names_query(spark: SparkSession, sf: str) -> DataFrame:
    customer = table(spark, sf, "customer")
    messy = customer.select(F.col("c_custkey").alias(" Deal\n Num"), F.col("c_acctbal").alias("Base   MTM "))
    return clean_names(messy, collapse=True)


# -- files -------------------------------------------------------------------------


@register(
    "csv_roundtrip",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice END AS o_totalprice,
              CASE WHEN o_orderkey % 13 <> 0 THEN o_orderpriority END AS o_orderpriority,
              o_orderkey % 2 = 0 AS even, 'a|b, "c"' AS quoted FROM orders""",
)
def csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Written with semicolons and null texts, read back with delimiter, nulls and types detected."""
    path = scratch_folder(spark) + ".csv"
    rows = table(spark, sf, "orders").selectExpr(
        "o_orderkey",
        "if(o_orderkey % 4 = 0, 'N/A', string(o_totalprice)) as o_totalprice",
        "if(o_orderkey % 13 = 0, 'NULL', o_orderpriority) as o_orderpriority",
        "if(o_orderkey % 2 = 0, 'True', 'False') as even",
        "'a|b, \"c\"' as quoted",
    )
    sinks.write_enriched(rows, path, sep=";")
    return readers.load(spark, path)


@register(
    "csv_ragged",
    """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS c_name,
              CASE WHEN c_custkey % 5 = 0 THEN '5" pipe' ELSE c_mktsegment END AS segment,
              CASE WHEN c_custkey % 7 = 0 AND c_custkey % 3 <> 0 THEN 'more,"and, more"' ELSE '' END AS further
       FROM customer""",
)
def csv_ragged(spark: SparkSession, sf: str) -> DataFrame:
    """Rows short of a cell, rows with further cells, and quotes within plain cells."""
    path = scratch_folder(spark) + ".csv"
    segment = "if(c_custkey % 5 = 0, '5\" pipe', c_mktsegment)"
    name = ", if(c_custkey % 3 = 0, '', concat(',', c_name))"
    more = ", if(c_custkey % 7 = 0 and c_custkey % 3 <> 0, ',more,\"and, more\"', '')"
    lines = table(spark, sf, "customer").selectExpr(f"concat(c_custkey, ',', {segment}{name}{more}) as value")

    def headed(batches):
        yield pa.record_batch([pa.array(["c_custkey,segment,c_name"])], names=["value"])
        yield from batches

    lines.mapInArrow(headed, "value string").write.text(path)
    found = readers.read_text_csv(spark, path, sep=",", extra="further").na.fill("")
    return found.selectExpr("cast(c_custkey as bigint) as c_custkey", "c_name", "segment", "further")


@register(
    "csv_two_headers",
    """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE o_orderpriority END AS o_orderpriority
       FROM orders""",
)
def csv_two_headers(spark: SparkSession, sf: str) -> DataFrame:
    """Files with other columns in another order are read by name."""
    path = scratch_folder(spark)
    orders = table(spark, sf, "orders")
    sinks.write_enriched(orders.filter("o_orderkey % 2 = 0").selectExpr("string(o_orderkey) as o_orderkey", "o_orderstatus"), f"{path}/a.csv")
    odd = orders.filter("o_orderkey % 2 <> 0").selectExpr("o_orderpriority", "o_orderstatus", "string(o_orderkey) as o_orderkey")
    sinks.write_enriched(odd, f"{path}/b.csv")
    found = readers.read_text_csv(spark, [f"{path}/a.csv", f"{path}/b.csv"], sep=",", headers="by_name")
    return found.select("o_orderkey", "o_orderstatus", "o_orderpriority")


@register("json_roundtrip", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def json_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_folder(spark) + ".json"
    customer = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    sinks.write_table(customer, path, format="json")
    return readers.load(spark, path, lines=True)


@register(
    "json_array",
    """SELECT c_custkey, c_name || ' {"x"} [' AS name, c_acctbal AS balance FROM customer""",
)
def json_array(spark: SparkSession, sf: str) -> DataFrame:
    """Arrays of nested records with braces and quotes in their texts, each read by as many tasks as it is large."""
    path = scratch_folder(spark) + ".json"
    records = table(spark, sf, "customer").selectExpr(
        """to_json(struct(c_custkey, concat(c_name, ' {"x"} [') as name, struct(c_nationkey as key, c_acctbal as balance) as inner)) as value"""
    )

    def arrays(batches):
        before = "["
        for batch in batches:
            for record in batch.column(0).to_pylist():
                yield pa.record_batch([pa.array([before + record])], names=["value"])
                before = ","
        yield pa.record_batch([pa.array([before.replace(",", "") + "]"])], names=["value"])

    records.mapInArrow(arrays, "value string").write.text(path)
    return readers.load(spark, path).selectExpr("c_custkey", "name", "inner.balance as balance")


@register(
    "parquet_load",
    "SELECT event_id, ts, user_id, event_type, value, props FROM events",
)
def parquet_load(spark: SparkSession, sf: str) -> DataFrame:
    return readers.load(spark, f"{sf}/events.parquet")


@register(
    "enriched_sink",
    """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, printf('%.4f', o_totalprice) AS price,
              coalesce(c_mktsegment, '') AS segment
       FROM orders LEFT JOIN customer ON o_custkey = c_custkey""",
)
def enriched_sink(spark: SparkSession, sf: str) -> DataFrame:
    """All-text rows keep their own formatting through append, write and read."""
    base = scratch_folder(spark)
    orders = table(spark, sf, "orders").selectExpr("o_orderkey", "o_custkey", "printf('%.4f', o_totalprice) as price")
    sinks.write_enriched(orders, f"{base}/orders.csv")
    left = readers.read_text_csv(spark, f"{base}/orders.csv", sep=",")
    customer = table(spark, sf, "customer")
    enriched = append_columns(left, customer, "o_custkey=c_custkey", ["c_mktsegment"], ["segment"], unique=True)
    sinks.write_enriched(enriched.drop("o_custkey"), f"{base}/enriched.csv")
    return readers.read_text_csv(spark, f"{base}/enriched.csv", sep=",")


@register(
    "report_sink",
    orders_classified_sql() + " SELECT category, count(*) AS records FROM c GROUP BY category",
)
def report_sink(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_folder(spark)
    sinks.write_classified(reconcile(*orders_pair(spark, sf), orders_spec()), path)
    return spark.read.parquet(path).groupBy("category").agg(F.count(F.lit(1)).alias("records"))


# -- batch -------------------------------------------------------------------------


def _customer_job(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    customer = table(spark, sf, "customer")
    return customer, customer.withColumn("c_mktsegment", F.lower("c_mktsegment"))


_CUSTOMER_SPEC = spec({"name": "c_mktsegment"}, {"name": "c_acctbal", "tolerance": 0.01}, keys=["c_custkey"])


def _batch_row(job: str, count: str) -> str:
    return f"""SELECT '{job}' AS job, ({count}) AS total_source, ({count}) AS total_target, {SUMMARY_COLUMNS_SQL}"""


@register(
    "batch_summary",
    f"""{orders_classified_sql()},
lm AS ({LINEITEM_CTES} SELECT * FROM m),
lc AS (SELECT {category_sql(*M_LINE.values())} AS category FROM lm),
cc AS (SELECT CASE WHEN {same_sql('c_mktsegment', 'lower(c_mktsegment)')} THEN 'matched' ELSE 'different' END
       AS category FROM customer),
rows AS (
    {_batch_row('orders', 'SELECT count(*) FROM orders')} FROM c
    UNION ALL {_batch_row('lines', 'SELECT count(*) FROM lineitem')} FROM lc
    UNION ALL {_batch_row('customers', 'SELECT count(*) FROM customer')} FROM cc
)
SELECT *, CASE WHEN matched + different > 0 THEN matched / (matched + different) ELSE 0.0 END AS match_rate,
       CASE WHEN matched + different > 0 THEN different / (matched + different) ELSE 0.0 END AS difference_rate
FROM rows""",
)
def batch_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Three jobs that work, one without a source, one whose spec cannot be met."""
    orders_target_df = orders_target(spark, sf)
    lines, lines_target = lineitem_pair(spark, sf)
    customer, customer_target = _customer_job(spark, sf)
    jobs = [
        Job("orders", table(spark, sf, "orders"), "orders", orders_spec()),
        Job("lines", lines, "lines", lineitem_spec()),
        Job("absent", None, "orders", orders_spec()),
        Job("broken", customer, "orders", orders_spec()),
        Job("customers", lambda: customer, "customers", _CUSTOMER_SPEC),
    ]
    targets = {"orders": orders_target_df, "lines": lines_target, "customers": customer_target}
    return reconcile_batch(jobs, targets).summary()


@register(
    "batch_value_summary",
    """SELECT l_orderkey AS "Deal Num", sum(l_quantity) AS "Base MTM" FROM lineitem GROUP BY l_orderkey""",
)
def batch_value_summary(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    messy = lines.select(F.col("l_orderkey").alias("Deal\nNum"), F.col("l_quantity").alias(" Base  MTM"))
    return summarize_values(messy, "Deal Num", "Base MTM")


@register(
    "batch_append",
    """WITH v AS (SELECT l_orderkey, CAST(sum(l_quantity) AS VARCHAR) AS mtm FROM lineitem GROUP BY l_orderkey)
       SELECT 'orders' AS "table", o_orderkey AS deal_tracking_num, coalesce(mtm, '') AS mtm
       FROM orders LEFT JOIN v ON o_orderkey = l_orderkey
       UNION ALL SELECT 'parts', p_partkey, coalesce(mtm, '') FROM part LEFT JOIN v ON p_partkey = l_orderkey""",
)
def batch_append(spark: SparkSession, sf: str) -> DataFrame:
    """The summed value appended to several tables; an absent one is skipped."""
    tables = {
        "orders": table(spark, sf, "orders").selectExpr("o_orderkey as deal_tracking_num"),
        "parts": table(spark, sf, "part").selectExpr("p_partkey as deal_tracking_num"),
        "swaps": None,
    }
    summary = batch_value_summary(spark, sf)
    enriched = append_summary(tables, summary, "deal_tracking_num=Deal Num", "Base MTM", "mtm")
    parts = [df.withColumn("table", F.lit(name)) for name, df in enriched.items()]
    return parts[0].unionByName(parts[1])


@register(
    "batch_attribute",
    """SELECT p_partkey, p_brand, p_size, coalesce(CAST(n_nationkey AS VARCHAR), '') AS qt_end
       FROM part LEFT JOIN nation ON p_brand = 'Brand#' || n_nationkey AND p_size = n_regionkey * 7""",
)
def batch_attribute(spark: SparkSession, sf: str) -> DataFrame:
    """One attribute on a composite key whose second part is named differently."""
    right = table(spark, sf, "nation").selectExpr(
        "concat('Brand#', n_nationkey) as p_brand", "n_regionkey * 7 as label", "n_nationkey"
    )
    left = table(spark, sf, "part").select("p_partkey", "p_brand", "p_size")
    return append_columns(left, right, ["p_brand", "p_size=LABEL"], ["n_nationkey"], ["qt_end"], unique=True)


@register("checked_load", "SELECT * FROM supplier")
def checked_load(spark: SparkSession, sf: str) -> DataFrame:
    return check_dataset(table(spark, sf, "supplier"), "supplier")


@register(
    "batch_selected",
    f"""WITH cc AS (SELECT CASE WHEN {same_sql('c_mktsegment', 'lower(c_mktsegment)')} THEN 'matched' ELSE 'different' END
       AS category FROM customer),
rows AS ({_batch_row('customers', 'SELECT count(*) FROM customer')} FROM cc)
SELECT *, CASE WHEN matched + different > 0 THEN matched / (matched + different) ELSE 0.0 END AS match_rate,
       CASE WHEN matched + different > 0 THEN different / (matched + different) ELSE 0.0 END AS difference_rate
FROM rows""",
)
def batch_selected(spark: SparkSession, sf: str) -> DataFrame:
    """Of several jobs only the named one runs."""
    customer, customer_target = _customer_job(spark, sf)
    jobs = [
        Job("orders", table(spark, sf, "orders"), "orders", orders_spec()),
        Job("customers", customer, "customers", _CUSTOMER_SPEC),
    ]
    targets = {"orders": orders_target(spark, sf), "customers": customer_target}
    return reconcile_batch(jobs, targets, only=" customers ,").summary()


@register(
    "batch_checks",
    """SELECT 'fine' AS job, 'done' AS status, (SELECT count(*) FROM customer) AS matched
       UNION ALL SELECT job, 'failed', NULL FROM (VALUES ('no key'), ('other family'), ('bad tolerance')) AS t (job)""",
)
def batch_checks(spark: SparkSession, sf: str) -> DataFrame:
    """A missing key, a key of another family on one side and a tolerance that is none fail their jobs alone."""
    customer = table(spark, sf, "customer")
    texts = customer.withColumn("c_custkey", F.concat(F.lit("c"), "c_custkey"))
    same = {"name": "c_acctbal", "tolerance": "0.5%"}
    jobs = [
        Job("fine", customer, "customers", spec(same, keys=["c_custkey"])),
        Job("no key", customer.drop("c_custkey"), "customers", spec(same, keys=["c_custkey"])),
        Job("other family", texts, "customers", spec(same, keys=["c_custkey"])),
        Job("bad tolerance", customer, "customers", spec({"name": "c_acctbal", "tolerance": "half"}, keys=["c_custkey"])),
    ]
    result = reconcile_batch(jobs, {"customers": customer})
    return result.status(spark).select("job", "status").join(result.summary().select("job", "matched"), "job", "left")


@register(
    "batch_enriched_target",
    """SELECT c_custkey, c_nationkey, n_name AS nation FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""",
)
def batch_enriched_target(spark: SparkSession, sf: str) -> DataFrame:
    """The enriched table is taken where there is one, else the plain one."""
    customer = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf, "nation")

    def enriched() -> DataFrame:
        return append_columns(customer, nation, "c_nationkey=n_nationkey", ["n_name"], ["nation"], unique=True)

    chosen = first_present(lambda: None, enriched, customer)
    plain = first_present(None, customer)
    return chosen.join(plain, ["c_custkey", "c_nationkey"])


_SHARED_JOBS = {
    # source condition, target condition
    "everyone": ("true", "true"),
    "rich": ("c_acctbal > 5000", "c_acctbal > 5000"),
    "builders": ("true", "c_mktsegment = 'BUILDING'"),
}


def _shared_job_sql(job: str) -> str:
    source, target = _SHARED_JOBS[job]
    return f"""SELECT '{job}' AS job, s.c_custkey AS s_key, t.c_custkey AS t_key,
        {same_sql('s.c_acctbal', 't.c_acctbal')} AND {same_sql('s.c_mktsegment', 't.c_mktsegment')} AS same
        FROM (SELECT * FROM customer WHERE {source}) s
        FULL JOIN (SELECT * FROM moved WHERE {target}) t ON s.c_custkey = t.c_custkey"""


@register(
    "batch_shared_target",
    f"""WITH moved AS (
    SELECT CASE WHEN c_custkey % 10 = 0 THEN -c_custkey - 1 ELSE c_custkey END AS c_custkey, c_mktsegment,
           CASE WHEN c_custkey % 7 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer),
joined AS ({' UNION ALL '.join(_shared_job_sql(j) for j in _SHARED_JOBS)})
SELECT job, count(s_key) AS total_source, count(t_key) AS total_target,
       count(*) FILTER (WHERE s_key IS NOT NULL AND t_key IS NOT NULL AND same) AS matched,
       count(*) FILTER (WHERE s_key IS NOT NULL AND t_key IS NOT NULL AND NOT same) AS different,
       count(*) FILTER (WHERE t_key IS NULL) AS missing_in_target,
       count(*) FILTER (WHERE s_key IS NULL) AS missing_in_source
FROM joined GROUP BY job""",
)
def batch_shared_target(spark: SparkSession, sf: str) -> DataFrame:
    """Three jobs with filters of their own on one target, which is scanned once."""
    customer = table(spark, sf, "customer")
    moved = customer.selectExpr(
        "case when c_custkey % 10 = 0 then -c_custkey - 1 else c_custkey end as c_custkey", "c_mktsegment",
        "case when c_custkey % 7 = 0 then c_acctbal + 1 else c_acctbal end as c_acctbal", "c_name",
    )
    rich = [{"field": "c_acctbal", "condition": "greater_than", "value": 5000}]
    builders = [{"field": "c_mktsegment", "condition": "equals", "value": "BUILDING"}]
    fields = [{"name": "c_acctbal"}, {"name": "c_mktsegment"}]
    jobs = [
        Job("everyone", customer, "moved", spec(*fields, keys=["c_custkey"])),
        Job("rich", customer, "moved", spec(*fields, keys=["c_custkey"], source=rich, target=rich)),
        Job("builders", customer, "moved", spec(*fields, keys=["c_custkey"], target=builders)),
    ]
    found = reconcile_batch(jobs, {"moved": moved}, shared_folder=scratch_folder(spark)).summary()
    return found.drop("match_rate", "difference_rate")


@register("latest_file", "SELECT c_nationkey, count(*) AS customers FROM customer GROUP BY c_nationkey")
def latest_file(spark: SparkSession, sf: str) -> DataFrame:
    """Of the counts written in two runs the newer file is read."""
    base = scratch_folder(spark)
    customer = table(spark, sf, "customer")
    for run, rows in (("one", customer.withColumn("c_nationkey", F.lit(-1))), ("two", customer)):
        counts = rows.groupBy("c_nationkey").agg(F.count("*").alias("customers"))
        sinks.write_table(counts.coalesce(1), f"{base}/{run}")
        time.sleep(1.1)  # file times may be whole seconds
    return readers.load(spark, readers.latest_file(spark, [f"{base}/one", f"{base}/two"], ["*.parquet", "*.csv"]))


@register(
    "run_stamp",
    """SELECT c_custkey, c_mktsegment, 'customers_20240203_040506' AS run FROM customer""",
)
def run_stamp(spark: SparkSession, sf: str) -> DataFrame:
    """A run's output goes under the spec's name with the time of the run."""
    named = parse_spec({**_CUSTOMER_SPEC, "output": {"filename": "customers.xlsx"}})
    name = run_name(named, datetime.datetime(2024, 2, 3, 4, 5, 6))
    path = sinks.write_table(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), f"{scratch_folder(spark)}/{name}")
    return spark.read.parquet(path).withColumn("run", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))


@register(
    "reports_sink",
    orders_classified_sql() + " SELECT category AS report, count(*) AS records FROM c GROUP BY category",
)
def reports_sink(spark: SparkSession, sf: str) -> DataFrame:
    """The four row reports as they are read back from their tables."""
    paths = sinks.write_reports(reconcile(*orders_pair(spark, sf), orders_spec()), scratch_folder(spark))
    names = ("matched", "different", "missing_in_target", "missing_in_source")
    parts = [spark.read.parquet(paths[n]).select(F.lit(n).alias("report")) for n in names]
    return reduce(DataFrame.unionAll, parts).groupBy("report").agg(F.count("*").alias("records"))
