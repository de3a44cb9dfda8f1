from datetime import datetime

import pytest
from pyspark.sql import functions as F

from logloom.operators import feedback, lineage, monitoring
from logloom.sources import readers, records, sinks
from logloom.streaming import jobs


def test_labelled_csv_drops_long_rows_and_keeps_short_ones(spark, tmp_path):
    path = tmp_path / "l.csv"
    path.write_text('﻿LogMessage,class\n"a, ""b""\nnext line",Error\nshort\nx,Noise,extra\n,Noise\nNA,Noise\ny,noise\n', encoding="utf-8")
    rows, stats = readers.read_labeled_csv(spark, str(path))
    assert rows.columns == ["LogMessage", "class"]
    assert sorted(((r[0], r[1]) for r in rows.collect()), key=str) == sorted([('a, "b"\nnext line', "Error"), ("short", None), (None, "Noise"), (None, "Noise"), ("y", "noise")], key=str)
    assert tuple(stats.first()) == ("skip_bad_lines", 1, 5)


def test_golden_rows_are_numbered_from_two(spark, tmp_path):
    path = tmp_path / "g.csv"
    path.write_text("﻿Message,Class\n" + "".join(f"m{i},Noise\n" for i in range(20)), encoding="utf-8")
    got = {r["message"]: r["line_number"] for r in readers.read_golden(spark, str(path)).collect()}
    assert got == {f"m{i}": i + 2 for i in range(20)}
    path.write_text("Message,Class\na,Noise\n ,Noise\n")
    with pytest.raises(ValueError, match="golden row 3 has no message"):
        readers.read_golden(spark, str(path))
    path.write_text("Message,Class\na,\n")
    with pytest.raises(ValueError, match="golden row 2 has no label"):
        readers.read_golden(spark, str(path))
    path.write_text("Message,Class\n")
    with pytest.raises(ValueError, match="no rows"):
        readers.read_golden(spark, str(path))


def test_records_of_every_format(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,message\n1,from csv\n2,\"two, parts\"\n")
    (tmp_path / "b.csv").write_text("LogMessage\nother header\n")
    (tmp_path / "array.json").write_text('["text", {"msg": "object"}, 5]')
    (tmp_path / "items.json").write_text('{\n "items": [\n{"log": "item"}]}')
    (tmp_path / "object.json").write_text('{"id": "first value", "n": 1}')
    (tmp_path / "broken.json").write_text('{"a": ')
    (tmp_path / "l.jsonl").write_text('{"message": "line"}\n\nnot json\n"quoted"\n[1]\n')
    (tmp_path / "t.log").write_text("one\n\n  two  \n")
    (tmp_path / "x.bin").write_text("  whole\nbody \n")
    got = {}
    for r in records.read_scoring_records(spark, str(tmp_path)).collect():
        got.setdefault(r["source_file"], {})[r["row_index"]] = r["message"] if r["error"] is None else "error"
    assert got == {
        "a.csv": {0: "from csv", 1: "two, parts"}, "b.csv": {0: "other header"},
        "array.json": {0: "text", 1: "object", 2: "5"}, "items.json": {0: "item"}, "object.json": {0: "first value"}, "broken.json": {-1: "error"},
        "l.jsonl": {0: "line", 1: "not json", 2: "quoted", 3: "[1]"}, "t.log": {0: "one", 1: "two"}, "x.bin": {0: "whole\nbody"},
    }


def test_csv_without_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("first,1\nsecond,2\n")
    got = records.csv_records(spark, str(tmp_path), header=False).orderBy("row_index").collect()
    assert [r["payload"] for r in got] == ['{"errorMessage":"first"}', '{"errorMessage":"second"}']


def test_lines_keep_their_numbers_when_a_file_is_split(spark, tmp_path):
    (tmp_path / "big.txt").write_text("".join(f"line {i}\n" if i % 7 else "\n" for i in range(20000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        lines = records.text_records(spark, str(tmp_path), "txt").select("row_index", F.get_json_object("payload", "$.errorMessage").alias("m")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    expected = [f"line {i}" for i in range(20000) if i % 7]
    assert {r["row_index"]: r["m"] for r in lines} == dict(enumerate(expected))


def test_archive_writes_a_version_once(spark, tmp_path):
    root = str(tmp_path)
    df = spark.createDataFrame([("a", 1), ("b", 2)], "m string, n int")
    first = sinks.archive_dataset(df, root, {"who": "x", "blank": " "}, "2024-01-01 00:00:00")
    again = sinks.archive_dataset(df.orderBy(F.desc("m")), root, {"who": "y"}, "2024-02-01 00:00:00")
    assert first == again
    row = sinks.data_versions(spark, root).first()
    assert row["created_at"] == datetime(2024, 1, 1) and row["metadata"] == {"who": "y"}
    assert spark.read.parquet(f"{root}/data").count() == 2


def test_feedback_merge(spark, rows):
    base = spark.createDataFrame([("a", "Noise"), ("a", "Error"), ("b", "SYSTEM"), ("", "Noise")], "message string, class string")
    events = spark.createDataFrame([("1", datetime(2024, 1, 1), " a ", "error"), ("2", datetime(2024, 1, 2), "a", "SYSTEM"), ("3", datetime(2024, 1, 1), "new", "noise"), ("4", datetime(2024, 1, 3), "new", "Error")],
                                   "event_id string, received_at timestamp, message string, correct_label string")
    clean = feedback.checked_feedback(events)
    assert rows(feedback.upsert_feedback(base, clean)) == [("a", "SYSTEM"), ("a", "SYSTEM"), ("b", "SYSTEM"), ("new", "Error")]
    acted = {r["event_id"]: r["action"] for r in feedback.feedback_actions(clean, base).collect()}
    assert acted == {"1": "corrected", "2": "corrected", "3": "appended", "4": "corrected"}
    with pytest.raises(Exception, match="known label"):
        feedback.checked_feedback(events.withColumn("correct_label", F.lit("what"))).collect()


def test_feedback_stream_equals_the_batch_form_over_several_micro_batches(spark, tmp_path, rows):
    base = spark.createDataFrame([("a", "Noise"), ("b", "SYSTEM")], "message string, class string")
    schema = "event_id string, received_at timestamp, message string, correct_label string"
    source, root, check = (str(tmp_path / n) for n in ("in", "root", "check"))
    everything = []
    for day, batch in enumerate([[("1", "a", "Error"), ("2", "c", "Noise")], [("3", "c", "SYSTEM"), ("4", "b", "Noise")]], start=1):
        part = spark.createDataFrame([(i, datetime(2024, 1, day), m, x) for i, m, x in batch], schema)
        everything.append(part)
        part.write.mode("append").parquet(source)
        jobs.stream_feedback(spark.readStream.schema(schema).parquet(source), base, root, check).awaitTermination()
    streamed = rows(jobs.newest_dataset(spark, root))
    assert streamed == rows(feedback.upsert_feedback(base, everything[0].union(everything[1])))
    assert spark.read.parquet(f"{root}/events").count() == 4


def test_incident_stream_creates_each_summary_once(spark, tmp_path):
    schema = "event_id bigint, ts timestamp, message string"
    source, target, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    for day in (1, 2):
        spark.createDataFrame([(day * 10 + i, datetime(2024, 1, day), f"Disk  {i % 2} FULL") for i in range(6)], schema).write.mode("append").parquet(source)
        stream = jobs.incident_creates(spark.readStream.schema(schema).parquet(source))
        stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["summary_key"] for r in spark.read.parquet(target).collect()) == ["incident: disk 0 full", "incident: disk 1 full"]


def test_version_history_and_diff(spark):
    texts = [("one\ntwo", "2024-01-02"), ("one\nthree", "2024-01-03"), ("one\ntwo", "2024-01-05")]
    versions = lineage.content_versions(spark.createDataFrame(texts, "text string, created_at string"))
    history = lineage.version_history(versions)
    ordered = history.orderBy("position").collect()
    assert [r["created_at"] for r in ordered] == ["2024-01-02", "2024-01-03"]
    assert ordered[0]["previous_version_id"] == "" and ordered[1]["previous_version_id"] == ordered[0]["version_id"]
    assert {(r["line"], r["change"]) for r in lineage.version_diffs(history, versions).collect()} == {("two", -1), ("three", 1)}


def test_resolve_version(spark):
    versions = spark.createDataFrame([("abc1", "1"), ("abd2", "2")], "version_id string, created_at string")
    assert lineage.resolve_version(versions, "abc") == "abc1"
    for prefix, problem in (("ab", "ambiguous"), ("x", "not found")):
        with pytest.raises(ValueError, match=problem):
            lineage.resolve_version(versions, prefix)


def test_monitoring_day_by_hand(spark, rows):
    schema = "event_id int, received_at string, prediction string, actions array<struct<type:string,operation:string,issue_key:string>>, errors array<struct<type:string,error:string>>"
    table = spark.createDataFrame([
        (1, "2024-01-01T00:00:00Z", "Error", [("jira", "created", "K-1"), ("github_copilot_remediation", "create", "K-1")], []),
        (2, "2024-01-01T01:00:00Z", "Error", [("jira", "Reused", "K-1")], [("other", "x")]),
        (3, "2024-01-01T02:00:00Z", "Error", [], [("jira", " no route ")]),
        (4, "2024-01-01T03:00:00Z", "Error", [], []),
        (5, "2024-01-01T04:00:00Z", "Odd", [("none", None, None)], []),
    ], schema)
    n = {(r["metric"], r["key"]): r["n"] for r in monitoring.daily_monitoring(table).collect()}
    assert n[("total", "")] == 5 and n[("label", "Error")] == 4 and n[("label", "Noise")] == 0 and n[("unknown_prediction", "Odd")] == 1
    assert (n[("issue_created", "")], n[("issue_reused", "")], n[("issue_failed", "")]) == (1, 1, 2)
    assert n[("action_status", "partial_failure")] == 2 and n[("action", "jira")] == 2
    reasons = {r["reason"]: r["n"] for r in monitoring.failure_reasons(table).collect()}
    assert reasons == {"no route": 1, monitoring.NO_REASON: 1}
    assert monitoring.last_prediction(table).first()["event_id"] == 5


def test_request_metrics_clamp_negative_durations(spark):
    samples = spark.createDataFrame([("GET", "/a", 200, -1.0, "Error"), ("GET", "/a", 200, 2.0, " "), ("GET", "/a", 500, 1.0, "Error")], "method string, path string, status int, duration double, prediction string")
    got = {(r["metric"], r["status"], r["prediction"]): r["value"] for r in monitoring.request_metrics(samples).collect()}
    assert got == {("requests_total", "200", None): 2, ("requests_total", "500", None): 1, ("duration_seconds_sum", None, None): 3.0, ("duration_seconds_count", None, None): 3, ("predictions_total", None, "Error"): 2}


def test_trailing_rates_cover_the_minutes_before_each_step(spark):
    at = lambda s: datetime(2024, 1, 1, 12, 0, 0) + __import__("datetime").timedelta(seconds=s)
    samples = spark.createDataFrame([(at(s), "GET", "/a", "200", 1.0) for s in (0, 1, 59, 60, 299, 301)] + [(at(10), "GET", "/b", "200", -2.0)], "ts timestamp, method string, path string, status string, duration double")
    got = {(r["at"], r["path"]): r["requests"] for r in monitoring.trailing_request_rate(samples, step_seconds=60).collect()}
    assert got[at(60), "/a"] == 3 and got[at(120), "/a"] == 4 and got[at(300), "/a"] == 5 and got[at(360), "/a"] == 3 and got[at(600), "/a"] == 1
    assert (at(0), "/a") not in got and (at(660), "/a") not in got and got[at(300), "/b"] == 1 and (at(360), "/b") not in got
    latency = {(r["at"], r["path"]): r["avg_latency"] for r in monitoring.trailing_latency(samples, step_seconds=60).collect()}
    assert latency[at(300), "/a"] == 1.0 and latency[at(300), "/b"] == 0.0
    with pytest.raises(ValueError, match="whole number of steps"):
        monitoring.trailing_request_rate(samples, step_seconds=70)


def test_counters_that_are_set_back_count_on(spark):
    hour = lambda h: datetime(2024, 1, 1) + __import__("datetime").timedelta(hours=h)
    readings = [(0, 5), (0.5, 9), (1.2, 9), (1.4, 2), (4, 7), (4.1, 1), (9, 1)]
    counters = spark.createDataFrame([(hour(h), "a", v) for h, v in readings] + [(hour(0), "b", 100)], "ts timestamp, path string, value int")
    got = sorted((r["ts"], r["increase"]) for r in monitoring.counter_increases(counters, ["path"]).where("path = 'a'").collect())
    assert [n for _, n in got] == [0, 4, 0, 2, 5, 1, 0]
