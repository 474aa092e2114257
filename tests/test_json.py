"""JSON arrays cut within files: the records are those of a plain parser, wherever ranges of bytes end."""

import json
import random

import pytest

from tallymark.sources.arrays import read_json_array
from tallymark.sources.readers import load


def made(seed: int, count: int) -> list[dict]:
    chance = random.Random(seed)
    texts = ["a", "}", "{", "{}}", 'quote " and \\\\ back', "[1, 2]", "line\nbreak", "é}", "", "\\\\"]
    return [
        {"id": i, "text": chance.choice(texts) * chance.randrange(4), "inner": {"a": chance.choice(texts), "b": {"c": i}}, "list": [{"x": i}] * chance.randrange(3)}
        for i in range(count)
    ]


def plain(rows) -> list[str]:
    return sorted(json.dumps(r, sort_keys=True) for r in rows)


def found(df) -> list[str]:
    return plain(row.asDict(recursive=True) for row in df.collect())


@pytest.mark.parametrize("size", [64, 333, 4096, 10**9])
@pytest.mark.parametrize("indent", [None, 2])
def test_records_across_ranges(spark, tmp_path, size, indent):
    rows = made(size, 150)
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.json").write_text(json.dumps(rows[:100], indent=indent, ensure_ascii=False), encoding="utf-8")
    (tmp_path / "t" / "b.json").write_text("  " + json.dumps(rows[100:]) + "\n", encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        df = read_json_array(spark, str(tmp_path / "t"))
        assert found(df) == plain(rows)
        typed = read_json_array(spark, str(tmp_path / "t"), "id long, text string")
        assert sorted(map(tuple, typed.collect())) == sorted((r["id"], r["text"]) for r in rows)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_one_array_is_read_by_several_tasks(spark, tmp_path):
    rows = made(1, 4000)
    (tmp_path / "a.json").write_text(json.dumps(rows))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 50_000)
    try:
        assert spark.read.option("lineSep", "}").text(str(tmp_path / "a.json")).rdd.getNumPartitions() > 4
        assert found(load(spark, str(tmp_path / "a.json"))) == plain(rows)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("text, expected", [("[]", 0), ("", 0), ('{"a": 1}', 1), ('[{"a": 1}, {"a": {}}]', 2), ('[{}]', 1)])
def test_small_files(spark, tmp_path, text, expected):
    (tmp_path / "a.json").write_text(text)
    assert read_json_array(spark, str(tmp_path / "a.json"), "a string").count() == expected
