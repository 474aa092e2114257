"""CSV files as they come: quotes in odd places, ragged rows, quoted line breaks, headers that differ."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from tallymark.sources.readers import read_csv, read_text_csv, scan_cells, survey_csv
from tallymark.sources.sinks import write_enriched


def write(path, text, mode="w"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8", newline="")
    return str(path)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("sep", [",", "|", "||", "\t", ";;"])
def test_cells_are_counted_like_a_plain_parser(spark, sep):
    chance = random.Random(len(sep))
    alphabet = ["a", " ", '"', '""', sep, sep[0], ",", "é"]
    lines = sorted({"".join(chance.choices(alphabet, k=chance.randrange(1, 14))) for _ in range(600)})
    found = spark.createDataFrame([(x,) for x in lines], "line string").select("line", scan_cells(F.col("line"), sep, 2).alias("s")).collect()

    def plain(line):
        state, cells, beyond, i = "start", 1, None, 0
        while i < len(line):
            if state != "quoted" and line.startswith(sep, i):
                i += len(sep)
                beyond = i if cells == 2 else beyond
                state, cells = "start", cells + 1
                continue
            c = line[i]
            if state == "start":
                state = "quoted" if c == '"' else "plain"
            elif state == "quoted" and c == '"':
                state = "closing"
            elif state == "closing":
                state = "quoted" if c == '"' else "plain"
            i += 1
        return cells, state == "quoted", beyond

    assert [(r.line, tuple(r.s)) for r in found] == [(line, plain(line)) for line in (r.line for r in found)]
    if len(sep) == 1:  # the library's parser agrees where the line does not end in quotes
        for r in found:
            if not r.s.quoted and sep != "\t":
                assert r.s.cells == len(next(csv.reader([r.line], delimiter=sep)))


def test_a_quote_within_a_plain_cell_hides_no_cell(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'a,b,c\n5" pipe,3,4,5\n1,2,3\n')
    with pytest.raises(Exception, match="more cells than the header"):
        read_text_csv(spark, path, sep=",").collect()
    assert rows(read_text_csv(spark, path, sep=",", extra="more").na.fill("")) == [("1", "2", "3", ""), ('5" pipe', "3", "4", "5")]


def test_long_quoted_cells(spark, tmp_path):
    long = 'x,y""' * 20_000
    path = write(tmp_path / "a.csv", f'a,b,c\n"{long}",2\n"{long}",2,3\n1,"{long}",3,4,"{long}"\n')
    found = rows(read_text_csv(spark, path, sep=",", extra="more").na.fill(""))
    text = long.replace('""', '"')
    assert found == sorted([(text, "2", "", ""), (text, "2", "3", ""), ("1", text, "3", f'4,"{long}"')])


def test_quoted_line_breaks_are_found_and_read(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'a,b\n1,"two\nlines, and ""three"""\n2,x\n')
    assert rows(read_text_csv(spark, path)) == [("1", 'two\nlines, and "three"'), ("2", "x")]
    assert rows(read_csv(spark, path)) == [(1, 'two\nlines, and "three"'), (2, "x")]


def test_stray_quotes_do_not_look_like_line_breaks(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'a,b\n5" pipe,x\n6" pipe,"y"\n')
    assert not survey_csv(spark, path, ",").open_quote
    assert rows(read_text_csv(spark, path, sep=",")) == [('5" pipe', "x"), ('6" pipe', "y")]


def test_short_rows_are_filled(spark, tmp_path):
    path = write(tmp_path / "a.csv", "a,b,c\n1\n2,x\n\n3,y,z\n")
    assert rows(read_text_csv(spark, path, sep=",")) == [("1", "", ""), ("2", "x", ""), ("3", "y", "z")]


def test_headers_by_name(spark, tmp_path):
    write(tmp_path / "t" / "a.csv", "id,name,price\n1,x,5\n")
    write(tmp_path / "t" / "b.csv", "price,id,name\n7,2,y\n")
    write(tmp_path / "t" / "c.csv", "id,note\n3,only\n")
    found = read_text_csv(spark, str(tmp_path / "t"), sep=",", headers="by_name")
    assert set(found.columns) == {"id", "name", "price", "note"}
    assert rows(found.select("id", "name", "price", "note")) == [("1", "x", "5", ""), ("2", "y", "7", ""), ("3", "", "", "only")]
    with pytest.raises(ValueError, match="differing headers"):
        read_text_csv(spark, str(tmp_path / "t"), sep=",")
    with pytest.raises(ValueError, match="headers must be"):
        read_text_csv(spark, str(tmp_path / "t"), sep=",", headers="any")


def test_each_header_group_keeps_its_further_cells(spark, tmp_path):
    write(tmp_path / "t" / "a.csv", "a,b\n1,2,3\n")
    write(tmp_path / "t" / "b.csv", "b,a,c\n1,2,3,4\n")
    found = read_text_csv(spark, str(tmp_path / "t"), sep=",", extra="more", headers="by_name")
    assert rows(found.select("a", "b", "c", "more")) == [("1", "2", "", "3"), ("2", "1", "3", "4")]


def test_comma_where_the_told_delimiter_fails(spark, tmp_path):
    """The told delimiter makes lines longer than the header; with a comma all lines fit."""
    lines = ["id,text"] + [f"{i},a;b" + ";c" * (i % 3) for i in range(40)]
    path = write(tmp_path / "a.csv", "\n".join(lines) + "\n")
    assert rows(read_text_csv(spark, path)) == sorted((str(i), "a;b" + ";c" * (i % 3)) for i in range(40))


def test_survey_can_be_spared(spark, tmp_path):
    path = write(tmp_path / "a.csv", "a,b\n1,2\n")
    assert rows(read_text_csv(spark, path, sep=",", survey=False)) == [("1", "2")]


def test_many_files_of_many_blocks(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", 2000)
    try:
        for i in range(3):
            header, row = ("a,b", "{0},x{0}") if i % 2 else ("b,a", "x{0},{0}")
            write(tmp_path / "t" / f"{i}.csv", "\n".join([header, *(row.format(1000 * i + k) for k in range(800))]) + "\n")
        found = read_text_csv(spark, str(tmp_path / "t"), sep=",", headers="by_name")
        assert rows(found.select("a", "b")) == sorted((str(1000 * i + k), f"x{1000 * i + k}") for i in range(3) for k in range(800))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("first", ["id", 'a "quoted" name', "a, b"])
@pytest.mark.parametrize("bom", [True, False])
def test_byte_order_mark(spark, tmp_path, first, bom):
    df = spark.createDataFrame([("1", "two\nlines"), ("2", "x")], ["id", "text"]).withColumnRenamed("id", first)
    path = write_enriched(df.coalesce(1), str(tmp_path / "out.csv"), bom=bom)
    begins = [f.read_bytes()[:3] for f in (tmp_path / "out.csv").glob("part-*")]
    assert begins and all((b == b"\xef\xbb\xbf") == (bom and first == "id") for b in begins)
    for multi_line in (None, True):
        found = read_text_csv(spark, path, sep=",", multi_line=multi_line)
        assert found.columns == [first, "text"] and rows(found) == [("1", "two\nlines"), ("2", "x")]
    single = write_enriched(df.filter("text = 'x'"), str(tmp_path / "one.csv"), bom=bom)
    assert read_text_csv(spark, single, sep=",").columns == [first, "text"]
