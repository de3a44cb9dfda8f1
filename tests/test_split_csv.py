"""CSV with line breaks in fields, read in splits: equal to Spark's whole-file reader, and by many tasks."""

import random

import pytest
from pyspark.sql import functions as F

from logloom.sources import readers, split_csv


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "3000", "spark.sql.files.openCostInBytes": "1"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def written(path, rows, end="\n"):
    path.write_bytes((end.join(rows) + end).encode())


def field(draw):
    body = draw.choice(["", "a", "some words", 'he said "no"', "two\nlines", "\n", ",", 'x,"y"\n,"', "“quoted”", "é 東京", '"', "\n\n\n", "tail \n", "1"])
    if any(c in body for c in '",\n') or draw.random() < 0.2:
        return '"' + body.replace('"', '""') + '"'
    return body + draw.choice(["", "", "", ' 5" disk', "x\"y\""]) if body else body


def rows_of(seed, n):
    draw = random.Random(seed)
    rows = [",".join([field(draw) or "z", *[field(draw) for _ in range(draw.choice([0, 1, 1, 1, 1, 2]))]]) for _ in range(n)]
    return [r if i % 50 else "" for i, r in enumerate(rows)]


def as_set(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equal_to_the_whole_file_reader(spark, tmp_path, small_splits, seed):
    for part in range(2):
        written(tmp_path / f"{part}.csv", ["msg,label", *rows_of(10 * seed + part, 1500)])
    path = str(tmp_path)
    names = ["msg", "label", "more"]
    schema = ", ".join(f"{n} string" for n in names)
    whole = readers.csv_reader(spark, True).schema(schema).option("enforceSchema", True).option("nullValue", readers.ABSENT).csv(path)
    split = readers.csv_rows(spark, path, names, True, readers.ABSENT).select(*names)
    assert as_set(split) == as_set(whole)
    assert split_csv._quoted_lines(spark, path, None).rdd.getNumPartitions() > 10
    numbers = [r["record"] for r in split_csv.csv_texts(spark, f"{path}/0.csv").select("record").collect()]
    assert sorted(numbers) == list(range(len(numbers)))


def test_a_field_that_spans_many_splits(spark, tmp_path, small_splits):
    long = "line\n" * 4000 + 'with ""quotes""\n' * 10 + "end"
    written(tmp_path / "a.csv", ["m,l", "first,1", f'"{long}",2', *[f"r{i},3" for i in range(3000)], f'"{long}",4', "last,5"])
    got = {r["l"]: r["m"] for r in readers.csv_rows(spark, str(tmp_path), ["m", "l"], True).where("l <> '3'").collect()}
    body = long.replace('""', '"')
    assert got == {"1": "first", "2": body, "4": body, "5": "last"}
    order = readers.csv_rows(spark, str(tmp_path), ["m", "l"], True).orderBy("record").collect()
    assert [r["record"] for r in order] == list(range(1, 3005)) and order[-1]["m"] == "last" and order[2]["m"] == "r0"


def test_marks_line_ends_and_open_quotes(spark, tmp_path):
    written(tmp_path / "crlf.csv", ["﻿LogMessage,class", '"two\r\nlines",Error', "plain,Noise"], "\r\n")
    rows, stats = readers.read_labeled_csv(spark, str(tmp_path))
    assert rows.columns == ["LogMessage", "class"]
    assert as_set(rows) == [("plain", "Noise"), ("two\nlines", "Error")] and tuple(stats.first()) == ("strict", 0, 2)
    (tmp_path / "open").mkdir()
    written(tmp_path / "open" / "a.csv", ["m,l", "x,1", '"never closed,2', "y,3"])
    assert [r["text"] for r in split_csv.csv_texts(spark, str(tmp_path / "open")).orderBy("record").collect()] == ["m,l", "x,1", '"never closed,2\ny,3']


def test_lines_of_one_quote_each_turn_the_state_round(spark, tmp_path, small_splits):
    # Every record is three lines; the middle ones look like closed lines when read alone.
    written(tmp_path / "a.csv", ["m,l", *[f'"a{i}\nb,c\nd",{i}' for i in range(2000)]])
    rows = readers.csv_rows(spark, str(tmp_path), ["m", "l"], True)
    assert rows.count() == 2000
    assert rows.where(F.col("m") != F.concat(F.lit("a"), "l", F.lit("\nb,c\nd"))).isEmpty()
    assert rows.where(F.col("record") != F.col("l").cast("int") + 1).isEmpty()


def test_empty_files(spark, tmp_path):
    written(tmp_path / "a.csv", ["m,l"])
    (tmp_path / "b.csv").write_text("")
    assert readers.csv_rows(spark, str(tmp_path), ["m", "l"], True).collect() == []
    assert [r["text"] for r in split_csv.csv_texts(spark, str(tmp_path)).collect()] == ["m,l"]
