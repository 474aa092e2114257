"""Queries on keys, derived fields, mapping, transformation and the change audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.catalog.base import (
    ORDERS_KEY,
    ORDERS_TARGET_SQL,
    PRICE,
    PRIORITY,
    STATUS,
    category_sql,
    orders_joined_sql,
    orders_pair,
    orders_target,
    register,
    same_sql,
    spec,
    table,
)
from tallymark.functions import recipes
from tallymark.operators.mapping import python_transformation
from tallymark.plans.reconcile import reconcile

INDICATOR_SQL = (
    "CASE WHEN s_here AND t_here THEN 'both' WHEN s_here THEN 'left_only' ELSE 'right_only' END AS merge_indicator"
)

# -- keys ---------------------------------------------------------------------


@register(
    "key_rename",
    orders_joined_sql() + f" SELECT o_orderkey, source_price, target_price, {INDICATOR_SQL} FROM j",
)
def key_rename(spark: SparkSession, sf: str) -> DataFrame:
    return reconcile(*orders_pair(spark, sf), spec(PRICE)).merged()


@register(
    "key_source_calc",
    orders_joined_sql(source="SELECT * REPLACE (o_orderkey + o_custkey % 3 AS o_orderkey) FROM orders")
    + f" SELECT o_orderkey, source_priority, target_priority, {INDICATOR_SQL} FROM j",
)
def key_source_calc(spark: SparkSession, sf: str) -> DataFrame:
    key = {**ORDERS_KEY, "source_key_calculation": "o_orderkey + o_custkey % 3"}
    return reconcile(*orders_pair(spark, sf), spec(PRIORITY, keys=[key])).merged()


@register(
    "key_target_calc",
    orders_joined_sql(
        target=f"SELECT * REPLACE (CASE WHEN status_text = 'Open' THEN order_id ELSE order_id + 1 END AS order_id) "
        f"FROM ({ORDERS_TARGET_SQL}) AS t"
    )
    + f" SELECT o_orderkey, source_priority, target_priority, {INDICATOR_SQL} FROM j",
)
def key_target_calc(spark: SparkSession, sf: str) -> DataFrame:
    def by_leg(df: DataFrame):
        return F.when(df["status_text"] == "Open", df["order_id"]).otherwise(df["order_id"] + 1)

    key = {**ORDERS_KEY, "target_key_calculation": by_leg}
    return reconcile(*orders_pair(spark, sf), spec(PRIORITY, keys=[key])).merged()


def _with_alternative(spark: SparkSession, sf: str) -> DataFrame:
    return orders_target(spark, sf).withColumn("alt_key", F.expr("case when order_id % 10 = 9 then order_id + 1 end"))


_ALTERNATIVE_SQL = f"""
    SELECT *, CASE WHEN order_id % 10 = 9 THEN order_id + 1 END AS alt_key FROM ({ORDERS_TARGET_SQL}) AS t"""


def _expanded_sql(keep_nulls: bool) -> str:
    extra = "" if keep_nulls else " AND a.alt_key IS NOT NULL"
    return f"""
    SELECT * FROM ({_ALTERNATIVE_SQL}) AS p
    UNION ALL
    SELECT a.* REPLACE (a.alt_key AS order_id) FROM ({_ALTERNATIVE_SQL}) AS a
    WHERE NOT EXISTS (SELECT 1 FROM ({ORDERS_TARGET_SQL}) AS k WHERE k.order_id = a.alt_key){extra}"""


def _alternatives(spark: SparkSession, sf: str, drop: bool) -> DataFrame:
    key = {**ORDERS_KEY, "target_alternatives": ["alt_key", "no_such_column"]}
    source = table(spark, sf, "orders")
    target = _with_alternative(spark, sf)
    return reconcile(source, target, spec(PRICE, keys=[key]), drop_null_alternatives=drop).merged()


@register(
    "key_alternatives",
    orders_joined_sql(target=_expanded_sql(True))
    + f" SELECT o_orderkey, source_price, target_price, {INDICATOR_SQL} FROM j",
)
def key_alternatives(spark: SparkSession, sf: str) -> DataFrame:
    return _alternatives(spark, sf, drop=False)


@register(
    "key_alternatives_filled",
    orders_joined_sql(target=_expanded_sql(False))
    + f" SELECT o_orderkey, source_price, target_price, {INDICATOR_SQL} FROM j",
)
def key_alternatives_filled(spark: SparkSession, sf: str) -> DataFrame:
    return _alternatives(spark, sf, drop=True)


@register(
    "key_composite_nulls",
    """
WITH src AS (SELECT *, CASE WHEN c_custkey % 5 <> 0 THEN c_nationkey END AS nation, true AS here FROM customer),
tgt AS (
    SELECT CASE WHEN c_custkey % 5 <> 0 THEN c_nationkey END AS nat, c_custkey + (c_custkey % 4) // 3 AS id,
           c_acctbal AS bal, true AS here
    FROM customer
)
SELECT coalesce(s.nation, t.nat) AS nation, coalesce(s.c_custkey, t.id) AS c_custkey,
       s.c_acctbal AS source_balance, t.bal AS target_balance,
       CASE WHEN s.here AND t.here THEN 'both' WHEN s.here THEN 'left_only' ELSE 'right_only' END AS merge_indicator
FROM src s FULL OUTER JOIN tgt t ON s.nation IS NOT DISTINCT FROM t.nat AND s.c_custkey IS NOT DISTINCT FROM t.id
""",
)
def key_composite_nulls(spark: SparkSession, sf: str) -> DataFrame:
    customer = table(spark, sf, "customer")
    nation = "case when c_custkey % 5 <> 0 then c_nationkey end"
    source = customer.selectExpr("*", f"{nation} as nation")
    target = customer.selectExpr(f"{nation} as nat", "c_custkey + int((c_custkey % 4) / 3) as id", "c_acctbal as bal")
    keys = [{"name": "nation", "target": "nat"}, {"name": "c_custkey", "target": "id"}]
    fields = {"name": "balance", "source": "c_acctbal", "target": "bal"}
    return reconcile(source, target, spec(fields, keys=keys)).merged()


@register(
    "key_field_transform",
    """
SELECT coalesce(s.k, t.k) AS c_name, s.c_mktsegment AS source_segment, t.c_mktsegment AS target_segment,
       CASE WHEN s.k IS NOT NULL AND t.k IS NOT NULL THEN 'matched' WHEN s.k IS NOT NULL THEN 'missing_in_target'
            ELSE 'missing_in_source' END AS category, CAST(NULL AS VARCHAR) AS diff_fields
FROM (SELECT upper(c_name) AS k, * FROM customer) s
FULL OUTER JOIN (SELECT upper(trim('  ' || lower(c_name))) AS k, * FROM customer) t ON s.k = t.k
""",
)
def key_field_transform(spark: SparkSession, sf: str) -> DataFrame:
    """A field named like a key is cleaned before the join."""
    customer = table(spark, sf, "customer")
    target = customer.withColumn("c_name", F.expr("concat('  ', lower(c_name))"))
    fields = [
        {"name": "c_name", "transformation": recipes.upper_trimmed},
        {"name": "segment", "source": "c_mktsegment", "target": "c_mktsegment"},
    ]
    return reconcile(customer, target, spec(*fields, keys=["c_name"])).classified()


# -- derived and missing fields --------------------------------------------------


@register(
    "calc_field",
    orders_joined_sql(source="SELECT * REPLACE (o_totalprice * CAST(0.98 AS DOUBLE) AS o_totalprice) FROM orders")
    + """, d AS (SELECT o_orderkey, s_here, t_here, source_price AS source_net,
                       target_price * CAST(0.98 AS DOUBLE) AS target_net FROM j)
SELECT o_orderkey, source_net, target_net, """
    + category_sql(same_sql("source_net", "target_net"))
    + " AS category, CASE WHEN s_here AND t_here AND NOT "
    + same_sql("source_net", "target_net")
    + " THEN 'net' END AS diff_fields FROM d",
)
def calc_field(spark: SparkSession, sf: str) -> DataFrame:
    net = {
        "name": "net",
        "source_calculation": "o_totalprice * 0.98D",
        "target_calculation": lambda df: df["price"] * F.lit(0.98),
    }
    return reconcile(*orders_pair(spark, sf), spec(net)).classified()


@register(
    "missing_field",
    orders_joined_sql()
    + """
SELECT o_orderkey, source_cust AS "source_o_custkey", CAST(NULL AS BIGINT) AS "target_o_custkey", """
    + category_sql("source_cust IS NULL")
    + """ AS category, CASE WHEN s_here AND t_here AND source_cust IS NOT NULL THEN 'o_custkey' END AS diff_fields
FROM j""",
)
def missing_field(spark: SparkSession, sf: str) -> DataFrame:
    """A configured field the target lacks is all empty there."""
    return reconcile(*orders_pair(spark, sf), spec({"name": "o_custkey"})).classified()


# -- mapping -----------------------------------------------------------------------


def _prepared(spark: SparkSession, sf: str, side: str, *fields: dict, columns: list[str]) -> DataFrame:
    result = reconcile(*orders_pair(spark, sf), spec(*fields))
    return result.prepared(side).select("o_orderkey", *columns)


@register(
    "map_values",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'Open' WHEN 'F' THEN 'Filled' ELSE o_orderstatus END AS status
FROM orders""",
)
def map_values(spark: SparkSession, sf: str) -> DataFrame:
    """A null replacement leaves the value as it is, and a number never equals a text."""
    status = {"name": "status", "source": "o_orderstatus", "mapping": {"O": "Open", "F": "Filled", "P": None, 7: "x"}}
    return _prepared(spark, sf, "source", status, columns=["status"])


@register(
    "map_values_large",
    """SELECT o_orderkey, CASE WHEN o_custkey < 150 THEN 'desk ' || (o_custkey // 10) ELSE CAST(o_custkey AS VARCHAR) END
       AS desk FROM orders""",
)
def map_values_large(spark: SparkSession, sf: str) -> DataFrame:
    """A long mapping becomes a broadcast lookup; number to text makes the whole field text."""
    desk = {"name": "desk", "source": "o_custkey", "mapping": {i: f"desk {i // 10}" for i in range(150)}}
    return _prepared(spark, sf, "source", desk, columns=["desk"])


@register(
    "map_numbers",
    "SELECT o_orderkey, CASE o_custkey WHEN 1 THEN 100.5 WHEN 2 THEN 200.0 ELSE CAST(o_custkey AS DOUBLE) END AS cust "
    "FROM orders",
)
def map_numbers(spark: SparkSession, sf: str) -> DataFrame:
    cust = {"name": "cust", "source": "o_custkey", "mapping": {1: 100.5, 2: 200}}
    return _prepared(spark, sf, "source", cust, columns=["cust"])


@register(
    "map_flags",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN true WHEN 'P' THEN false END AS settled FROM orders""",
)
def map_flags(spark: SparkSession, sf: str) -> DataFrame:
    """A declared type turns mapped texts into flags; what cannot be one is empty."""
    settled = {
        "name": "settled", "source": "o_orderstatus", "mapping": {"F": True, "P": False}, "type": "boolean",
    }
    return _prepared(spark, sf, "source", settled, columns=["settled"])


def _conditional(kind: str, condition_field: str, value=None, values=None, mappings=None) -> dict:
    conditional = {"condition_field": condition_field, "condition_type": kind}
    if value is not None:
        conditional["condition_value"] = value
    if values is not None:
        conditional["condition_list"] = values
    conditional["mappings"] = {"default": mappings or {"O": "Open", "F": None}}
    return {"name": "status", "source": "o_orderstatus", "conditional_mapping": conditional}


# condition type -> (value, list, condition field, SQL test); every mapping is O -> Open, F -> cleared
CONDITIONAL_CASES = {
    "equals": ("7", None, "o_custkey", "o_custkey = 7"),
    "not_equals": ("7", None, "o_custkey", "o_custkey <> 7"),
    "starts_with": ("1-", None, "o_orderpriority", "starts_with(o_orderpriority, '1-')"),
    "not_starts_with": ("1-", None, "o_orderpriority", "NOT starts_with(o_orderpriority, '1-')"),
    "ends_with": ("HIGH", None, "o_orderpriority", "ends_with(o_orderpriority, 'HIGH')"),
    "not_ends_with": ("HIGH", None, "o_orderpriority", "NOT ends_with(o_orderpriority, 'HIGH')"),
    "contains": ("NOT|MED", None, "o_orderpriority", "regexp_matches(o_orderpriority, 'NOT|MED')"),
    "not_contains": ("SPEC", None, "o_orderpriority", "NOT contains(o_orderpriority, 'SPEC')"),
    "regex_match": ("[2-4]-", None, "o_orderpriority", "regexp_matches(o_orderpriority, '^[2-4]-')"),
    "regex_not_match": ("[2-4]-", None, "o_orderpriority", "NOT regexp_matches(o_orderpriority, '^[2-4]-')"),
    "less_than": ("100000", None, "o_totalprice", "o_totalprice < 100000"),
    "less_than_equal": ("50", None, "o_custkey", "o_custkey <= 50"),
    "greater_than": ("200000.5", None, "o_totalprice", "o_totalprice > 200000.5"),
    "greater_than_equal": ("90", None, "o_custkey", "o_custkey >= 90"),
    "in_list": (None, [1, "2", "x"], "o_custkey", "o_custkey IN (1, 2)"),
    "not_in_list": (None, ["1-URGENT"], "o_orderpriority", "o_orderpriority <> '1-URGENT'"),
    "is_null": (None, None, "o_orderpriority", "o_orderpriority IS NULL"),
    "is_not_null": (None, None, "o_orderpriority", "o_orderpriority IS NOT NULL"),
}


def _conditional_query(kind: str):
    value, values, condition_field, _ = CONDITIONAL_CASES[kind]

    def query(spark: SparkSession, sf: str) -> DataFrame:
        orders = table(spark, sf, "orders")
        nullable = orders.withColumn("o_orderpriority", F.expr("if(o_orderkey % 13 = 0, null, o_orderpriority)"))
        field = _conditional(kind, condition_field, value, values)
        result = reconcile(nullable, orders_target(spark, sf), spec(field, {"name": condition_field}))
        return result.prepared("source").select("o_orderkey", "status")

    return query


for _kind, (_, _, _column, _test) in CONDITIONAL_CASES.items():
    _negative = "not_" in _kind and _kind != "is_not_null" and _column == "o_orderpriority"
    _holds = f"({_test}) IS NOT FALSE" if _negative else _test
    register(
        f"map_conditional_{_kind}",
        f"""SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND ({_holds}) THEN 'Open'
                  WHEN o_orderstatus = 'F' AND ({_holds}) THEN NULL ELSE o_orderstatus END AS status
FROM (SELECT * REPLACE (CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority)
      FROM orders) AS o""",
    )(_conditional_query(_kind))


@register(
    "map_conditional_keyed",
    """SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'O' THEN 'Open now'
                  WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'O' THEN 'Open later'
                  WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'F' THEN 'Done' ELSE o_orderstatus END AS status
FROM orders""",
)
def map_conditional_keyed(spark: SparkSession, sf: str) -> DataFrame:
    """Without a condition value the mappings are keyed by the condition field's value."""
    status = {
        "name": "status",
        "source": "o_orderstatus",
        "conditional_mapping": {
            "condition_field": "priority",
            "mappings": {"1-URGENT": {"O": "Open now"}, "5-LOW": {"O": "Open later", "F": "Done"}, 5: {"P": "x"}},
        },
    }
    return _prepared(spark, sf, "source", status, PRIORITY, columns=["status"])


@register(
    "map_conditional_2000",
    """SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '%-%' AND o_custkey BETWEEN 1 AND 2000
                  THEN CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE o_custkey + 100000 END ELSE o_custkey END AS cust
FROM orders""",
)
def map_conditional_2000(spark: SparkSession, sf: str) -> DataFrame:
    """2,000 entries under a typed condition; a replacement of None clears the value."""
    entries = {k: None if k % 10 == 0 else k + 100_000 for k in range(1, 2001)}
    field = {
        "name": "cust", "source": "o_custkey",
        "conditional_mapping": {
            "condition_field": "priority", "condition_type": "contains", "condition_value": "-", "mappings": {"default": entries},
        },
    }
    return _prepared(spark, sf, "source", field, PRIORITY, columns=["cust"])


@register(
    "map_keyed_2000",
    """SELECT o_orderkey, CASE WHEN o_custkey NOT BETWEEN 1 AND 2000 THEN o_custkey WHEN o_orderpriority = '1-URGENT' THEN o_custkey + 100000
                  WHEN o_orderpriority = '5-LOW' THEN -o_custkey ELSE o_custkey END AS cust
FROM orders""",
)
def map_keyed_2000(spark: SparkSession, sf: str) -> DataFrame:
    """2,000 entries for each of two values of the condition field."""
    mappings = {"1-URGENT": {k: k + 100_000 for k in range(1, 2001)}, "5-LOW": {k: -k for k in range(1, 2001)}, 5: {1: 2}}
    field = {"name": "cust", "source": "o_custkey", "conditional_mapping": {"condition_field": "priority", "mappings": mappings}}
    return _prepared(spark, sf, "source", field, PRIORITY, columns=["cust"])


@register("map_condition_missing", "SELECT o_orderkey, o_orderstatus AS status FROM orders")
def map_condition_missing(spark: SparkSession, sf: str) -> DataFrame:
    """A condition field that is nowhere found leaves the values as they are."""
    field = _conditional("equals", "nowhere", "x", mappings={"O": "Open", "F": None})
    return _prepared(spark, sf, "source", field, columns=["status"])


@register(
    "map_condition_from_raw",
    """SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 AND o_orderstatus = 'O' THEN 'Open' ELSE o_orderstatus END AS status
FROM orders""",
)
def map_condition_from_raw(spark: SparkSession, sf: str) -> DataFrame:
    """The condition field may be a raw column that is no configured field."""
    field = _conditional("regex_match", "o_custkey", r"\d*[02468]$", mappings={"O": "Open"})
    return _prepared(spark, sf, "source", field, columns=["status"])


@register(
    "map_apply_to",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'Open' ELSE o_orderstatus END AS status, 'source' AS side
FROM orders
UNION ALL
SELECT CASE WHEN o_orderkey % 10 = 0 THEN -o_orderkey - 1 ELSE o_orderkey END, o_orderstatus, 'target' FROM orders""",
)
def map_apply_to(spark: SparkSession, sf: str) -> DataFrame:
    """A source-only mapping does not touch the target."""
    orders = table(spark, sf, "orders")
    target = orders.selectExpr(
        "case when o_orderkey % 10 = 0 then -o_orderkey - 1 else o_orderkey end as o_orderkey", "o_orderstatus"
    )
    status = {
        "name": "status", "source": "o_orderstatus", "target": "o_orderstatus", "mapping": {"O": "Open"},
        "apply_to": "source",
    }
    result = reconcile(orders, target, spec(status, keys=["o_orderkey"]))
    sides = [result.prepared(s).select("o_orderkey", "status", F.lit(s).alias("side")) for s in ("source", "target")]
    return sides[0].unionByName(sides[1])


@register(
    "map_sequential",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'Open' ELSE o_orderstatus END AS status,
       CASE WHEN o_orderstatus = 'O' AND o_orderpriority = '5-LOW' THEN 'idle' ELSE o_orderpriority END AS priority
FROM orders""",
)
def map_sequential(spark: SparkSession, sf: str) -> DataFrame:
    """A condition field that was mapped earlier is seen as mapped."""
    status = {"name": "status", "source": "o_orderstatus", "mapping": {"O": "Open"}}
    priority = {
        "name": "priority",
        "source": "o_orderpriority",
        "conditional_mapping": {
            "condition_field": "status", "condition_type": "equals", "condition_value": "Open",
            "mappings": {"default": {"5-LOW": "idle"}},
        },
    }
    return _prepared(spark, sf, "source", status, priority, columns=["status", "priority"])


# -- transformation ------------------------------------------------------------------


def _customer_texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").selectExpr(
        "c_custkey",
        "concat('  ', c_mktsegment, ' ') as padded",
        "concat(' 1998/', lpad(c_nationkey, 2, '0'), '/01 ') as slashed",
        "concat('acc-', c_name, '/', c_nationkey) as account",
        "case when c_custkey % 3 = 0 then null else c_mktsegment end as segment",
    )


def _own(df: DataFrame, key: str, *fields: dict) -> DataFrame:
    """The source side of a table against itself, after mapping and transformation."""
    return reconcile(df, df, spec(*fields, keys=[key])).prepared("source").select(key, *[f["name"] for f in fields])


@register(
    "transform_text",
    """SELECT c_custkey, upper(trim(padded)) AS padded, replace(trim(slashed), '/', '-') AS slashed,
       upper(regexp_replace(account, '[^a-zA-Z0-9]', '', 'g')) AS account, lower(segment) AS segment
FROM (SELECT c_custkey, '  ' || c_mktsegment || ' ' AS padded,
             ' 1998/' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || '/01 ' AS slashed,
             'acc-' || c_name || '/' || c_nationkey AS account,
             CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS segment FROM customer) AS c""",
)
def transform_text(spark: SparkSession, sf: str) -> DataFrame:
    return _own(
        _customer_texts(spark, sf),
        "c_custkey",
        {"name": "padded", "transformation": recipes.upper_trimmed},
        {"name": "slashed", "transformation": recipes.dashed_date},
        {"name": "account", "transformation": recipes.alphanumeric_upper},
        {"name": "segment", "transformation": recipes.lower},
    )


@register(
    "transform_number",
    """SELECT c_custkey, c_acctbal AS money, CASE WHEN c_custkey % 4 = 0 THEN 0.0 ELSE c_acctbal END AS maybe,
       CASE WHEN c_custkey % 2 = 0 THEN c_nationkey / 100 ELSE CAST(c_nationkey AS DOUBLE) END AS share,
       round_even(sqrt(abs(c_acctbal)) * 100, 0) / 100 AS root
FROM customer""",
)
def transform_number(spark: SparkSession, sf: str) -> DataFrame:
    texts = table(spark, sf, "customer").selectExpr(
        "c_custkey",
        "concat(if(c_custkey % 2 = 0, '$', 'USD '), format_number(c_acctbal, 2)) as money",
        "if(c_custkey % 4 = 0, '-', cast(c_acctbal as string)) as maybe",
        "concat(c_nationkey, if(c_custkey % 2 = 0, '%', '')) as share",
        "sqrt(abs(c_acctbal)) as root",
    )
    return _own(
        texts,
        "c_custkey",
        {"name": "money", "transformation": recipes.currency_amount},
        {"name": "maybe", "transformation": recipes.number_or_zero},
        {"name": "share", "transformation": recipes.percent_fraction},
        {"name": "root", "transformation": recipes.rounded(2)},
    )


@register(
    "transform_sql",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open!' ELSE lower(o_orderstatus) || '!' END AS status,
       o_totalprice / 2 AS price FROM orders""",
)
def transform_sql(spark: SparkSession, sf: str) -> DataFrame:
    """SQL text runs after the mapping and sees the field by name."""
    status = {
        "name": "status", "source": "o_orderstatus", "mapping": {"O": "Open"},
        "transformation": "concat(lower(status), '!')",
    }
    price = {"name": "price", "source": "o_totalprice", "transformation": "price / 2"}
    return _prepared(spark, sf, "source", status, price, columns=["status", "price"])


def _initials(text: str) -> str:
    return "".join(word[0] for word in text.replace("-", " ").split())


@register(
    "transform_udf",
    """SELECT o_orderkey, CASE priority WHEN '1-URGENT' THEN '1U' WHEN '2-HIGH' THEN '2H' WHEN '3-MEDIUM' THEN '3M'
       WHEN '4-NOT SPECIFIED' THEN '4NS' WHEN '5-LOW' THEN '5L' END AS priority
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderpriority END AS priority FROM orders) AS o""",
)
def transform_udf(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").selectExpr(
        "o_orderkey", "if(o_orderkey % 13 = 0, null, o_orderpriority) as priority"
    )
    field = {"name": "priority", "transformation": python_transformation(_initials, "string")}
    return _own(orders, "o_orderkey", field)


# -- change audit ---------------------------------------------------------------------


def _audited(spark: SparkSession, sf: str):
    status = {**STATUS, "apply_to": "both", "transformation": recipes.upper_trimmed}
    priority = {
        "name": "priority",
        "source": "o_orderpriority",
        "conditional_mapping": {
            "condition_field": "status", "condition_type": "equals", "condition_value": "OPEN",
            "mappings": {"default": {"5-LOW": "idle"}},
        },
    }
    return reconcile(*orders_pair(spark, sf), spec(status, priority))


_AUDIT_CTES = f"""
WITH sides AS (
    SELECT 'source' AS side, o_orderkey, o_orderstatus AS s0, o_orderpriority AS p0 FROM orders
    UNION ALL SELECT 'target', order_id, status_text, priority FROM ({ORDERS_TARGET_SQL}) AS t
),
steps AS (
    SELECT *, CASE s0 WHEN 'O' THEN 'Open' WHEN 'F' THEN 'Filled' WHEN 'P' THEN 'Pending' ELSE s0 END AS s1 FROM sides
),
final AS (
    SELECT *, upper(trim(s1)) AS s2, CASE WHEN upper(s1) = 'OPEN' AND p0 = '5-LOW' THEN 'idle' ELSE p0 END AS p1
    FROM steps
),
long AS (
    SELECT o_orderkey, side, 'status' AS field, 'mapping' AS kind, s0 AS original, s1 AS "new",
           s0 || ' -> ' || s1 AS rule FROM final
    UNION ALL
    SELECT o_orderkey, side, 'status', 'transformation', s1, s2, 'upper_trimmed' FROM final
    UNION ALL
    SELECT o_orderkey, side, 'priority', 'conditional', p0, p1, 'status equals OPEN' FROM final
)"""


@register(
    "change_audit",
    _AUDIT_CTES + """ SELECT * FROM long WHERE original IS NOT NULL AND "new" IS NOT NULL AND original <> "new" """,
)
def change_audit(spark: SparkSession, sf: str) -> DataFrame:
    return _audited(spark, sf).changes()


@register(
    "change_counts",
    _AUDIT_CTES
    + """ SELECT side, field, kind, count(*) FILTER (WHERE original <> "new") AS changed,
                 count(DISTINCT original) AS distinct_before, count(DISTINCT "new") AS distinct_after
          FROM long GROUP BY side, field, kind""",
)
def change_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _audited(spark, sf).change_counts()
