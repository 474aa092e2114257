"""A batch of named reconciliations, some sharing a target, in one application."""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.operators.filters import filter_mask
from tallymark.operators.lookup import aggregate_by, append_columns
from tallymark.operators.quality import clean_names
from tallymark.plans.reconcile import Reconciliation, reconcile
from tallymark.plans.spec import TARGET, Spec, parse_spec

log = logging.getLogger(__name__)

DONE, FAILED, SKIPPED = "done", "failed", "skipped"

# A table, or a callable that opens it when the job is due; a callable gives None for an absent source.
TableSource = DataFrame | Callable[[], DataFrame | None] | None


@dataclass(frozen=True)
class Job:
    name: str
    source: TableSource
    target: str
    spec: Mapping[str, Any] | Spec | None
    options: Mapping[str, Any] = field(default_factory=dict)


@dataclass
class BatchResult:
    """Per-job outcome and the results of the jobs that worked."""

    outcomes: list[tuple[str, str, str]] = field(default_factory=list)
    results: dict[str, Reconciliation] = field(default_factory=dict)

    @property
    def failed(self) -> list[str]:
        return [name for name, status, _ in self.outcomes if status == FAILED]

    def status(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.outcomes, "job string, status string, detail string")

    def _union(self, table: Callable[[Reconciliation], DataFrame]) -> DataFrame:
        if not self.results:
            raise ValueError("no job of the batch worked")
        parts = [table(r).withColumn("job", F.lit(name)) for name, r in self.results.items()]
        return reduce(lambda a, b: a.unionByName(b), parts)

    def summary(self) -> DataFrame:
        """Record statistics of all jobs, one row each."""
        return self._union(lambda r: r.summary())

    def field_stats(self) -> DataFrame:
        return self._union(lambda r: r.field_stats())


def select_jobs(jobs: Sequence[Job], names: str | Sequence[str] | None = None) -> list[Job]:
    """All jobs, or the named ones in the order given; an unknown name is an error."""
    if isinstance(names, str):
        names = [n.strip() for n in names.split(",") if n.strip()]
    if not names:
        return list(jobs)
    known = {j.name: j for j in jobs}
    unknown = [n for n in names if n not in known]
    if unknown:
        raise ValueError(f"unknown jobs {unknown}; available: {list(known)}")
    return [known[n] for n in names]


def first_present(*choices: TableSource) -> DataFrame:
    """The first table there is, e.g. an enriched target before the plain one."""
    for choice in choices:
        table = _open(choice)
        if table is not None:
            return table
    raise ValueError("none of the tables is present")


def _open(source: TableSource) -> DataFrame | None:
    return source() if callable(source) else source


def _columns_read(spec: Spec, columns: Sequence[str]) -> list[str]:
    """The target columns a job may read; all of them if a calculation sees the whole row."""
    calculated = [e.calculation(TARGET) for e in (*spec.keys, *spec.fields)]
    if any(c is not None for c in calculated):
        return list(columns)
    named = {f.field for f in spec.filters.get(TARGET, ())}
    for key in spec.keys:
        named |= {key.target, *key.target_alternatives}
    for entry in spec.fields:
        named |= {entry.name, entry.target}
        if entry.conditional_mapping is not None:
            named.add(entry.conditional_mapping.condition_field)
    folded = {n.strip().lower() for n in named}
    return [c for c in columns if c.strip().lower() in folded]


def share_target(target: DataFrame, specs: Mapping[str, Mapping[str, Any] | Spec], path: str) -> dict[str, DataFrame]:
    """Scan a target once for several jobs; per job the rows that meet its filters.

    Each row is tagged with the jobs whose target filters it meets and written to ``path``, a folder
    all executors share, in one folder per set of jobs; rows and columns that no job reads are left out. A job
    reads the folders of the sets it is in, so disjoint filters write and read every row once. The
    columns keep their order. Jobs whose filters cannot be built on this target are left out of the result.
    """
    df = target.toDF(*[c.strip() for c in target.columns])
    parsed, masks = {}, {}
    for name, spec in specs.items():
        try:
            parsed[name] = parse_spec(spec)
            masks[name] = F.coalesce(filter_mask(df, parsed[name].filters.get(TARGET, ())), F.lit(False))
            df.select(masks[name])
        except Exception as error:  # the job itself will fail with it
            log.warning("job %s does not share its target: %s", name, error)
            masks.pop(name, None)
    if not masks:
        return {}
    wanted = {c for name in masks for c in _columns_read(parsed[name], df.columns)}
    kept = [F.col(f"`{c}`") for c in df.columns if c in wanted]
    met = [F.when(mask, F.lit(str(i))) for i, mask in enumerate(masks.values())]
    # "j" keeps the tag text when partition values are read back
    tagged = df.select(*kept, F.concat(F.lit("j_"), F.array_join(F.array(*met), "_")).alias("__jobs"))
    tagged.filter(F.col("__jobs") != "j_").write.mode("overwrite").partitionBy("__jobs").parquet(path)
    stored = df.sparkSession.read.schema(tagged.schema).parquet(path)
    tags = F.split("__jobs", "_")
    return {name: stored.filter(F.array_contains(tags, str(i))).select(*kept) for i, name in enumerate(masks)}


def reconcile_batch(
    jobs: Sequence[Job],
    targets: Mapping[str, DataFrame],
    *,
    only: str | Sequence[str] | None = None,
    stop_on_error: bool = False,
    write: Callable[[str, Reconciliation], Any] | None = None,
    shared_folder: str | None = None,
) -> BatchResult:
    """Run the jobs in order.

    A job without a spec is an error before anything runs; one without a source
    is skipped; one that fails is recorded and the batch goes on unless told to
    stop. ``write`` is called per job and runs its actions, so failures at run
    time belong to the job too. With ``shared_folder``, a folder all executors
    share, a target of several jobs is scanned once, when the first of them is
    due (see ``share_target``); without, each job reads it with its own filters
    pushed down. Results are the same.
    """
    chosen = select_jobs(jobs, only)
    unspecified = [j.name for j in chosen if j.spec is None]
    if unspecified:
        raise ValueError(f"jobs without a spec: {unspecified}")
    batch = BatchResult()
    shared: dict[str, dict[str, DataFrame]] = {}

    def target_of(job: Job) -> DataFrame:
        together = {j.name: j.spec for j in chosen if j.target == job.target}
        if shared_folder is None or len(together) < 2:
            return targets[job.target]
        if job.target not in shared:
            path = f"{shared_folder.rstrip('/')}/target-{uuid.uuid4().hex}"
            shared[job.target] = share_target(targets[job.target], together, path)
        return shared[job.target].get(job.name, targets[job.target])

    for job in chosen:
        try:
            source = _open(job.source)
            if source is None:
                batch.outcomes.append((job.name, SKIPPED, "missing source"))
                continue
            result = reconcile(source, target_of(job), job.spec, **job.options)
            if write is not None:
                write(job.name, result)
            else:
                result.summary().schema  # noqa: B018  analysis errors belong to the job
        except Exception as error:  # a batch reports whatever made a job fail
            log.error("job %s failed: %s", job.name, error)
            batch.outcomes.append((job.name, FAILED, f"{type(error).__name__}: {error}"))
            if stop_on_error:
                break
            continue
        batch.outcomes.append((job.name, DONE, ""))
        batch.results[job.name] = result
    return batch


def summarize_values(df: DataFrame, id_column: str, value_column: str) -> DataFrame:
    """Sum of a value per id, after tidying the column names."""
    tidy = clean_names(df, collapse=True)
    missing = [c for c in (id_column, value_column) if c not in tidy.columns]
    if missing:
        raise ValueError(f"missing required columns {missing}; available: {tidy.columns}")
    return aggregate_by(tidy, [id_column], [value_column], "sum")


def append_summary(
    tables: Mapping[str, DataFrame | None],
    summary: DataFrame,
    key: str,
    value_column: str,
    out: str,
) -> dict[str, DataFrame]:
    """Append the summed value to each table that is there; absent ones are skipped."""
    enriched = {}
    for name, table in tables.items():
        if table is None:
            log.warning("table %s is not there, skipped", name)
            continue
        enriched[name] = append_columns(table, summary, [key], [value_column], [out], unique=True)
    return enriched
