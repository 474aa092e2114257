"""Small tables and shorthand used by the tests."""

from __future__ import annotations

from tallymark.plans.reconcile import reconcile


def frame(spark, schema: str, *rows: tuple):
    return spark.createDataFrame(list(rows), schema)


def spec(*fields, keys=("id",), **filters):
    body = {"keys": list(keys), "fields": list(fields)}
    if filters:
        body["filters"] = filters
    return {"reconciliation": body}


def counts(source, target, wanted, **options) -> dict:
    return reconcile(source, target, wanted, **options).summary().first().asDict()


def column(df, name: str) -> list:
    return [row[name] for row in df.collect()]
