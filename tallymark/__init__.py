"""Dataset reconciliation on Spark DataFrames."""

from tallymark.operators.lookup import aggregate_by, append_aggregate, append_columns
from tallymark.plans.batch import Job, reconcile_batch
from tallymark.plans.reconcile import Reconciliation, Skew, reconcile
from tallymark.plans.spec import Spec, SpecError, parse_spec

__all__ = [
    "Job",
    "Reconciliation",
    "Skew",
    "Spec",
    "SpecError",
    "aggregate_by",
    "append_aggregate",
    "append_columns",
    "parse_spec",
    "reconcile",
    "reconcile_batch",
]
