"""Records of files with and without headers, and of files that cannot be read."""

import csv
import gzip
import io
import random

import pytest

from logloom.functions.payload import extract_message
from logloom.sources import records


def found(spark, path, **options):
    got = {}
    for r in records.read_scoring_records(spark, str(path), **options).collect():
        assert r["row_index"] not in got.setdefault(r["source_file"], {})
        got[r["source_file"]][r["row_index"]] = r["message"] if r["error"] is None else ("error", r["error"])
    return got


def has_header(text):
    try:
        return csv.Sniffer().has_header(text[:4096])
    except Exception:
        return True


def test_files_with_and_without_headers_in_one_folder(spark, tmp_path):
    files = {
        "with.csv": "id,message\n1,first\n2,second\n", "other.csv": "Msg;x,log\n\n5,third\n7,\"two\nlines\"\n", "UPPER.CSV": "level,text\n3,fourth\n4,fifth\n",
        "plain.csv": "alpha,1\nbravo,2\ncharl,3\ndelta,4\n", "one.csv": "a message\nanother one\nand a third\n", "empty.csv": "",
        "wide.csv": "a,b,c,d,message,f\n1,2,3,4,far right,6\n1,2\n9,8,7,6,again,5,4,3\n", "twice.csv": "message,n,message\nx,1,last wins\ny,2,too\n",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    got = found(spark, tmp_path, formats=("csv",))
    assert not has_header(files["plain.csv"]) and has_header(files["with.csv"])
    assert got["with.csv"] == {0: "first", 1: "second"} and got["other.csv"] == {0: "third", 1: "two\nlines"} and got["UPPER.CSV"] == {0: "fourth", 1: "fifth"}
    assert got["plain.csv"] == {0: "alpha", 1: "bravo", 2: "charl", 3: "delta"}
    assert got["wide.csv"] == {0: "far right", 1: "1", 2: "again"} and got["twice.csv"] == {0: "last wins", 1: "too"}
    assert "empty.csv" not in got


@pytest.mark.parametrize("seed", [1, 2])
def test_headers_are_told_as_by_the_standard_library(spark, tmp_path, seed):
    draw, wanted = random.Random(seed), {}
    for i in range(40):
        width = draw.randint(1, 4)
        cell = lambda: draw.choice([str(draw.randint(0, 999)), "word", "some text", f"{draw.random():.3f}", "x" * draw.randint(1, 5)])
        table = [[cell() for _ in range(width)] for _ in range(draw.randint(1, 30))]
        if draw.random() < 0.5:
            table.insert(0, ["message", "level", "n", "at"][:width])
        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerows(table)
        text = out.getvalue() * draw.choice([1, 1, 60])
        (tmp_path / f"f{i}.csv").write_text(text)
        rows = list(csv.reader(io.StringIO(text)))
        wanted[f"f{i}.csv"] = len(rows) - has_header(text)
    got = records.csv_records(spark, str(tmp_path)).groupBy("source_file").count()
    assert {r["source_file"]: r["count"] for r in got.collect()} == {k: n for k, n in wanted.items() if n}


def test_a_fault_in_each_format_leaves_the_other_files_whole(spark, tmp_path):
    good = {"a.csv": "id,message\n1,x\n2,y\n", "a.json": '["j1", {"msg": "j2"}]', "a.jsonl": '{"msg": "l1"}\nl2\n', "a.txt": "t1\nt2\n", "a.log": "g1\n", "a.body": "whole"}
    for name, text in good.items():
        (tmp_path / name).write_text(text)
    (tmp_path / "a.body.gz").write_bytes(gzip.compress(b"packed"))
    bad = b"caf\xe9 \xff"
    (tmp_path / "b.csv").write_bytes(b"id,message\n1,before\n2," + bad + b"\n3,after\n")
    (tmp_path / "b.json").write_bytes(b'["' + bad + b'"]')
    (tmp_path / "c.json").write_text('{"a": ')
    (tmp_path / "b.jsonl").write_bytes(b'{"msg": "before"}\n\n"' + bad + b'"\n{"msg": "after"}\n')
    (tmp_path / "b.txt").write_bytes(bad + b"\nafter\n")
    (tmp_path / "b.log").write_bytes(b"before\n" + bad)
    (tmp_path / "b.body").write_bytes(bad)
    (tmp_path / "b.gz").write_bytes(gzip.compress(random.Random(1).randbytes(50_000))[:20_000])
    got = found(spark, tmp_path)
    utf8, lost = ("error", records.NOT_UTF8), ("error", "cannot be read")
    assert {k: v for k, v in got.items() if k.startswith("a.")} == {
        "a.csv": {0: "x", 1: "y"}, "a.json": {0: "j1", 1: "j2"}, "a.jsonl": {0: "l1", 1: "l2"}, "a.txt": {0: "t1", 1: "t2"}, "a.log": {0: "g1"},
        "a.body": {0: "whole"}, "a.body.gz": {0: "packed"},
    }
    assert {k: v for k, v in got.items() if not k.startswith("a.")} == {
        "b.csv": {0: "before", -1: utf8}, "b.json": {-1: utf8}, "c.json": {-1: ("error", "not valid JSON")}, "b.jsonl": {0: "before", -1: utf8},
        "b.txt": {-1: utf8}, "b.log": {0: "before", -1: utf8}, "b.body": {-1: utf8}, "b.gz": {-1: lost},
    }


def test_headers_can_be_told_for_all_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("first,1\nsecond,2\n")
    (tmp_path / "b.csv").write_text("message\nx\n")
    for header, wanted in ((True, {"a.csv": {0: "second"}, "b.csv": {0: "x"}}), (False, {"a.csv": {0: "first", 1: "second"}, "b.csv": {0: "message", 1: "x"}})):
        assert found(spark, tmp_path, csv_header=header, formats=("csv",)) == wanted
    payloads = records.csv_records(spark, str(tmp_path), header=True).select(extract_message("payload").alias("m")).collect()
    assert sorted(r["m"] for r in payloads) == ["second", "x"]
