"""Unified diffs: their format by hand, against the standard library, and applied to the old versions."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from logloom.functions.text import text_lines
from logloom.operators import diffs, lineage


def table(spark, pairs):
    """Versions and a history of (old, new) texts."""
    texts = {t: f"v{i}" for i, t in enumerate(dict.fromkeys(t for p in pairs for t in p))}
    versions = spark.createDataFrame([(v, t) for t, v in texts.items()], "version_id string, text string")
    history = spark.createDataFrame([(texts[new], texts[old]) for old, new in pairs] * 2 + [("v0", "")], "version_id string, previous_version_id string")
    return texts, versions, history


def test_format_by_hand(spark):
    old = "\n".join(f"line {i}" for i in range(1, 21))
    new = old.replace("line 2\n", "").replace("line 12", "line twelve\nand more") + "\nlast"
    _, versions, history = table(spark, [(old, new), ("", "a"), ("a\nb", "")])
    got = {(r["version_id"], r["previous_version_id"]): r["diff"] for r in diffs.diff_texts(history, diffs.unified_diffs(history, versions)).collect()}
    assert got["v1", "v0"].split("\n") == [
        "--- v0", "+++ v1", "@@ -1,5 +1,4 @@", " line 1", "-line 2", " line 3", " line 4", " line 5",
        "@@ -9,7 +8,8 @@", " line 9", " line 10", " line 11", "-line 12", "+line twelve", "+and more", " line 13", " line 14", " line 15",
        "@@ -18,3 +18,4 @@", " line 18", " line 19", " line 20", "+last",
    ]
    assert got["v3", "v2"] == "--- v2\n+++ v3\n@@ -0,0 +1 @@\n+a"
    assert got["v2", "v4"] == "--- v4\n+++ v2\n@@ -1,2 +0,0 @@\n-a\n-b"


def drawn():
    draw, pairs = random.Random(3), []
    ends = ["\n", "\n", "\n", "\r\n", "\x0b", "\u2028"]
    for _ in range(120):
        old = [draw.choice("abcdefgh ") * draw.randint(0, 3) for _ in range(draw.randint(0, 40))]
        new = [draw.choice(["x", line, line, line, "-" + line, "+"]) for line in old if draw.random() > 0.1] + ["end"] * draw.randint(0, 1)
        if draw.random() < 0.3:
            draw.shuffle(new)
        pairs.append(tuple("".join(line + draw.choice(ends) for line in lines) for lines in (old, new)))
    return [p for p in pairs if p[0] != p[1]]


def test_diffs_apply_and_equal_the_standard_library(spark):
    pairs = [*drawn(), ("a\nb", "a\nb\n"), ("long\n" * 500, "long\n" * 480 + "short\n"), ("", "\n")]
    texts, versions, history = table(spark, pairs)
    hunks = diffs.unified_diffs(history, versions).cache()
    by_pair = {(r["version_id"], r["previous_version_id"]): r for r in diffs.applied(history, hunks, versions).collect()}
    shown = {(r["version_id"], r["previous_version_id"]): r["diff"] for r in diffs.diff_texts(history, hunks).collect()}
    assert len(by_pair) == len({(texts[n], texts[o]) for o, n in pairs}) == len(shown)
    for old, new in pairs:
        pair = texts[new], texts[old]
        assert by_pair[pair]["lines"] == new.splitlines()
        assert shown[pair] == "\n".join(difflib.unified_diff(old.splitlines(), new.splitlines(), texts[old], texts[new], lineterm=""))
    assert hunks.where("aggregate(lines, 0, (n, x) -> n + if(x like ' %', 1, 0)) > old_lines").isEmpty()


def test_a_hunk_that_does_not_fit_stops_the_job(spark):
    _, versions, history = table(spark, [("a\nb\nc", "a\nx\nc")])
    hunks = diffs.unified_diffs(history, versions)
    for wrong in (hunks.withColumn("old_start", F.col("old_start") + 1), hunks.withColumn("lines", F.transform("lines", lambda x: F.replace(x, F.lit("b"), F.lit("q"))))):
        with pytest.raises(Exception, match="does not fit"):
            diffs.applied(history, wrong, versions).collect()


def test_balance_leaves_out_moved_lines(spark):
    _, versions, history = table(spark, [("a\nb\nc\nd", "b\nc\nd\na\ne")])
    assert {(r["line"], r["change"]) for r in diffs.line_balance(diffs.unified_diffs(history, versions)).collect()} == {("e", 1)}


def test_a_version_before_many_others(spark):
    pairs = [("same\nstart", f"same\nstart\n{i}") for i in range(300)]
    _, versions, history = table(spark, pairs)
    hunks = diffs.unified_diffs(history, versions)
    assert hunks.count() == 300 and hunks.where("old_lines <> 2 OR new_lines <> 3").isEmpty()


def test_history_of_versions(spark):
    rows = [("one\ntwo", "2024-01-02"), ("one\nthree", "2024-01-03"), ("one\ntwo", "2024-01-05")]
    versions = lineage.content_versions(spark.createDataFrame(rows, "text string, created_at string"))
    hunks = diffs.unified_diffs(lineage.version_history(versions), versions).collect()
    assert [r["lines"] for r in hunks] == [[" one", "-two", "+three"]]


def test_lines_are_those_of_python(spark):
    texts = ["", "\n", "a", "a\n", "a\n\n", "\r\n", "a\r\nb\rc\x0bd\x0ce\x1cf\x1dg\x1eh\x85i\u2028j\u2029", "\n\na", "x\x1f\x00y\tz"]
    got = {r["t"]: r["l"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", text_lines("t").alias("l")).collect()}
    assert got == {t: t.splitlines() for t in texts}
    assert spark.range(1).select(text_lines(F.lit(None).cast("string"))).first()[0] == []
