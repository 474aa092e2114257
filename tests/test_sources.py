import time

import pytest
from helpers import frame, spec

from tallymark.operators.quality import check_dataset, clean_names, dataset_check, profile, profile_columns, standardize
from tallymark.plans import reports
from tallymark.plans.reconcile import reconcile
from tallymark.sources import readers, sinks


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv_types_and_null_texts(spark, tmp_path):
    path = write(
        tmp_path / "a.csv",
        "id,amount,flag,text,none\n1,1.5,True,x,\n2,NULL,False,\"a,b\",N/A\n3,2e3,,NaN,NA\n",
    )
    df = readers.load(spark, path)
    assert dict(df.dtypes) == {"id": "bigint", "amount": "double", "flag": "boolean", "text": "string", "none": "string"}
    assert [tuple(r) for r in df.orderBy("id").collect()] == [
        (1, 1.5, True, "x", None), (2, None, False, "a,b", None), (3, 2000.0, None, None, None),
    ]


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_delimiters(spark, tmp_path, sep):
    lines = [["id", "name", "value"], ["1", "a b", "10"], ["2", "c d", "20"]]
    path = write(tmp_path / "a.csv", "\n".join(sep.join(line) for line in lines) + "\n")
    assert [tuple(r) for r in readers.read_csv(spark, path).collect()] == [(1, "a b", 10), (2, "c d", 20)]


def test_csv_schema_skips_inference(spark, tmp_path):
    path = write(tmp_path / "a.csv", "id,amount\n1, 2.5 \n2,x\n")
    df = readers.load(spark, path, schema="id string, amount double")
    assert [tuple(r) for r in df.collect()] == [("1", 2.5), ("2", None)]


def test_text_csv_is_kept_as_written(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'id,amount,note\n1,1.500,"say ""hi"""\n2,,NULL\n')
    df = readers.read_text_csv(spark, path)
    assert [tuple(r) for r in df.collect()] == [("1", "1.500", 'say "hi"'), ("2", "", "NULL")]
    out = sinks.write_enriched(df, str(tmp_path / "out.csv"))
    assert sorted(map(tuple, readers.read_text_csv(spark, out, sep=",").collect())) == sorted(map(tuple, df.collect()))


def test_json_array(spark, tmp_path):
    path = write(tmp_path / "a.json", '[{"id": 1, "value": "a"}, {"id": 2, "value": "b"}, {"id": 3, "value": null}]')
    assert sorted(r["id"] for r in readers.load(spark, path).collect()) == [1, 2, 3]


def test_unknown_format_and_empty_file(spark, tmp_path):
    with pytest.raises(ValueError, match="unsupported format"):
        readers.load(spark, "table.pkl")
    with pytest.raises(ValueError, match="empty"):
        readers.load(spark, write(tmp_path / "a.csv", "id,amount\n"))


def test_latest_file(spark, tmp_path):
    for i, (folder, name) in enumerate([("a", "mtm_1.csv"), ("b", "mtm_2.csv"), ("a", "other.csv")]):
        (tmp_path / folder).mkdir(exist_ok=True)
        write(tmp_path / folder / name, f"id\n{i}\n")
        time.sleep(0.05)
    folders = [str(tmp_path / "a"), str(tmp_path / "b")]
    assert readers.latest_file(spark, folders, "mtm*.csv").endswith("/b/mtm_2.csv")
    assert readers.latest_file(spark, folders, ["mtm*.csv", "oth*.csv"]).endswith("/a/other.csv")
    assert readers.latest_file(spark, folders, "none*.csv", required=False) is None
    with pytest.raises(FileNotFoundError):
        readers.latest_file(spark, folders, "none*.csv")


def test_standardize(spark):
    df = frame(spark, "col1 string, col2 string, n long", ("NULL", "", 1), ("N/A", " NaN ", 2), (" value3 ", "3", 3))
    assert [tuple(r) for r in standardize(df).collect()] == [(None, None, 1), (None, None, 2), ("value3", "3", 3)]
    kept = standardize(df, standardize_nulls=False).collect()
    assert [r["col1"] for r in kept] == ["NULL", "N/A", "value3"]


def test_profile(spark):
    df = frame(spark, "col1 long, col2 string, col3 double", (1, "a", 1.1), (2, "b", 2.2), (None, "c", 3.3))
    assert tuple(profile(df).first()) == (3, 3, 1, 0)
    assert [tuple(r) for r in profile_columns(df).collect()] == [
        (0, "col1", "bigint", 1), (1, "col2", "string", 0), (2, "col3", "double", 0),
    ]
    copies = df.union(df).union(df.filter("col1 is null"))
    assert tuple(profile(copies).first()) == (7, 3, 3, 4)


def test_checks(spark, caplog):
    df = frame(spark, "a long, b string", (1, None), (2, None))
    assert tuple(dataset_check(df).first()) == (2, 2, "b")
    check_dataset(df, "trades")
    assert "completely empty columns: b" in caplog.text
    with pytest.raises(ValueError, match="trades is empty"):
        check_dataset(df.limit(0), "trades")


def test_clean_names(spark):
    df = frame(spark, "` Deal\n  Num ` long", (1,))
    assert clean_names(df).columns == ["Deal\n  Num"]
    assert clean_names(df, collapse=True).columns == ["Deal Num"]


def test_report_sink(spark, tmp_path):
    source = frame(spark, "id long, v string", (1, "a"), (2, "b"), (3, "c"))
    target = frame(spark, "id long, v string", (1, "a"), (2, "x"), (4, "d"))
    result = reconcile(source, target, spec({"name": "v"}))
    paths = sinks.write_reports(result, str(tmp_path / "out"), metadata={"source_file": "s"})
    sizes = {name: spark.read.parquet(path).count() for name, path in paths.items()}
    assert sizes == {
        "summary": 14, "field_statistics": 1, "matched": 1, "different": 1, "missing_in_target": 1,
        "missing_in_source": 1,
    }
    sinks.write_classified(result, str(tmp_path / "all"))
    assert spark.read.parquet(str(tmp_path / "all")).filter("category = 'matched'").count() == 1
    with pytest.raises(ValueError):
        sinks.write_table(source, str(tmp_path / "x"), format="xlsx")


def test_written_results_equal_lazy_ones(spark, tmp_path):
    source = frame(spark, "id long, `a b` string, n double", (1, "a", 1.0), (2, "b", 2.0), (3, "c", None), (3, "c", 4.0))
    target = frame(spark, "id long, `a b` string, n double", (1, "A", 1.0), (2, "x", 2.0), (4, "d", 1.0), (3, "c", 4.0))
    fields = [
        {"name": "a b", "mapping": {"a": "A"}},
        {"name": "n", "tolerance": 0.1, "post_merge_source_calculation": "coalesce(source_n, target_n)"},
    ]
    lazy = reconcile(source, target, spec(*fields))
    written = lazy.materialize(str(tmp_path / "all"))
    for name in ("summary", "field_stats", "classified", "breaks", "merged", "joined_changes", "adjustments", "changes"):
        ours, theirs = getattr(written, name)(), getattr(lazy, name)()
        assert ours.columns == theirs.columns
        assert sorted(map(str, ours.collect())) == sorted(map(str, theirs.collect()))
    assert sorted(map(str, reports.missing_in_target_report(written).collect())) == sorted(
        map(str, reports.missing_in_target_report(lazy).collect())
    )
