import pytest
from helpers import column, frame, spec

from tallymark.plans.batch import (
    Job, append_summary, first_present, reconcile_batch, select_jobs, share_target, summarize_values,
)
from tallymark.plans.reconcile import reconcile


@pytest.fixture(scope="module")
def tables(spark):
    return (
        frame(spark, "id long, v string", (1, "a"), (2, "b")),
        frame(spark, "id long, v string", (1, "a"), (3, "c")),
    )


def jobs(source):
    wanted = spec({"name": "v"})
    return [
        Job("good", source, "t", wanted),
        Job("absent", lambda: None, "t", wanted),
        Job("bad", source, "t", spec({"name": "v"}, keys=["nowhere"])),
        Job("also good", lambda: source, "t", wanted),
    ]


def test_batch_goes_on_after_a_failure(spark, tables):
    batch = reconcile_batch(jobs(tables[0]), {"t": tables[1]})
    assert [(n, s) for n, s, _ in batch.outcomes] == [
        ("good", "done"), ("absent", "skipped"), ("bad", "failed"), ("also good", "done"),
    ]
    assert batch.failed == ["bad"]
    assert sorted(column(batch.summary(), "job")) == ["also good", "good"]
    assert sorted(column(batch.summary(), "matched")) == [1, 1]
    assert column(batch.field_stats(), "field") == ["v", "v"]
    assert batch.status(spark).count() == 4


def test_batch_can_stop_on_failure(tables):
    batch = reconcile_batch(jobs(tables[0]), {"t": tables[1]}, stop_on_error=True)
    assert [s for _, s, _ in batch.outcomes] == ["done", "skipped", "failed"]


def test_failures_at_run_time_belong_to_the_job(tables):
    def write(name, result):
        if name == "also good":
            raise RuntimeError("disk full")
        result.summary().collect()

    batch = reconcile_batch(jobs(tables[0]), {"t": tables[1]}, write=write)
    assert batch.failed == ["bad", "also good"]
    assert list(batch.results) == ["good"]


def test_selection(tables):
    names = [j.name for j in select_jobs(jobs(tables[0]), "bad, good")]
    assert names == ["bad", "good"]
    assert len(select_jobs(jobs(tables[0]), "")) == 4
    with pytest.raises(ValueError, match="unknown jobs"):
        select_jobs(jobs(tables[0]), "good,worse")
    with pytest.raises(ValueError, match="without a spec"):
        reconcile_batch([Job("x", tables[0], "t", None)], {"t": tables[1]})


def test_first_present(tables):
    assert first_present(None, lambda: None, tables[1]) is tables[1]
    with pytest.raises(ValueError):
        first_present(None)


def test_value_summary_and_append(spark):
    deals = frame(spark, "`Deal\nNum` long, ` Base  MTM ` double", (1, 1.5), (1, 2.0), (2, None), (None, 9.0))
    summary = summarize_values(deals, "Deal Num", "Base MTM")
    assert {r["Deal Num"]: r["Base MTM"] for r in summary.collect()} == {1: 3.5, 2: 0.0}
    tables = {"a": frame(spark, "deal_tracking_num long", (1,), (3,)), "b": None}
    enriched = append_summary(tables, summary, "deal_tracking_num=Deal Num", "Base MTM", "mtm")
    assert list(enriched) == ["a"]
    assert sorted(column(enriched["a"], "mtm")) == ["", "3.5"]
    with pytest.raises(ValueError, match="missing required columns"):
        summarize_values(deals, "Deal Num", "Other")


@pytest.fixture(scope="module")
def shared(spark, tmp_path_factory):
    """A source, a stored target with awkward rows, and jobs that share it."""
    source = frame(spark, "id long, v string, n double", (1, "a", 1.0), (2, "b", 2.0), (3, "c", 3.0), (None, "d", 4.0))
    rows = [(1, "a", 1.5, 9), (2, None, 2.0, 2), (4, "x", None, 1), (None, "d", 4.0, None), (7, "c", float("nan"), 3), (2, "b", 2.0, 2)]
    path = str(tmp_path_factory.mktemp("shared") / "target")
    frame(spark, "` id ` long, v string, n double, other long", *rows).repartition(3).write.parquet(path)
    low = [{"field": "n", "condition": "less_than", "value": 3}]
    text = [{"field": "v", "condition": "is_not_null"}]
    none = [{"field": "v", "condition": "equals", "value": "nothing"}]
    jobs = {
        "all": spec({"name": "v"}, {"name": "n", "tolerance": 0.5}),
        "low": spec({"name": "v"}, target=low),
        "text": spec({"name": "n"}, target=text, source=text),
        "none": spec({"name": "v"}, target=none),
        "alternative": spec({"name": "v"}, keys=[{"name": "id", "source": "id", "target": "id", "target_alternatives": ["other"]}]),
    }
    return source, path, jobs


def test_shared_target_gives_the_same_results(spark, shared, tmp_path):
    source, path, specs = shared
    target = spark.read.parquet(path)
    jobs = [Job(name, source, "t", s) for name, s in specs.items()]
    batch = reconcile_batch(jobs, {"t": target}, shared_folder=str(tmp_path))
    assert not batch.failed
    for name, wanted in specs.items():
        alone = reconcile(source, target, wanted)
        for table in ("summary", "classified", "field_stats", "duplicate_keys"):
            own, other = (getattr(r, table)() for r in (batch.results[name], alone))
            assert own.columns == other.columns
            assert sorted(map(repr, own.collect())) == sorted(map(repr, other.collect())), (name, table)


def test_shared_target_is_scanned_once(spark, shared, tmp_path):
    source, path, specs = shared
    target = spark.read.parquet(path)
    jobs = [Job(name, source, "t", s) for name, s in specs.items()]
    batch = reconcile_batch(jobs, {"t": target}, shared_folder=str(tmp_path))
    plan = batch.summary()._jdf.queryExecution().toString()
    assert path not in plan
    assert "array_contains(split(__jobs" in plan.split("PartitionFilters: [", 1)[1]
    assert len(list(tmp_path.iterdir())) == 1
    lone = reconcile_batch(jobs[:1], {"t": target}, shared_folder=str(tmp_path))
    assert path.rsplit("/", 1)[0] in lone.summary()._jdf.queryExecution().toString()
    assert len(list(tmp_path.iterdir())) == 1


def test_shared_target_keeps_what_jobs_read(spark, shared, tmp_path):
    _, path, specs = shared
    target = spark.read.parquet(path)
    parts = share_target(target, {n: specs[n] for n in ("low", "none")}, str(tmp_path / "a"))
    assert parts["low"].columns == ["id", "v", "n"]
    assert parts["low"].count() == 3 and parts["none"].count() == 0
    calculated = spec({"name": "v", "target_calculation": "upper(v)"})
    parts = share_target(target, {"low": specs["low"], "calculated": calculated}, str(tmp_path / "b"))
    assert parts["calculated"].columns == ["id", "v", "n", "other"] and parts["calculated"].count() == 6
    assert share_target(target.limit(0), {"low": specs["low"]}, str(tmp_path / "c"))["low"].count() == 0


def test_a_job_that_cannot_share_fails_alone(spark, shared, tmp_path):
    source, path, specs = shared
    broken = spec({"name": "v"}, keys=["nowhere"])
    jobs = [Job("bad", source, "t", broken), Job("low", source, "t", specs["low"]), Job("gone", None, "t", specs["all"])]
    batch = reconcile_batch(jobs, {"t": spark.read.parquet(path)}, shared_folder=str(tmp_path))
    assert [(n, s) for n, s, _ in batch.outcomes] == [("bad", "failed"), ("low", "done"), ("gone", "skipped")]
