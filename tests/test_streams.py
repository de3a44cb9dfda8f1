"""Streams that keep state or a ledger: equal to their batch forms over micro-batches, restarts and failures."""

from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from logloom.operators import dataset, feedback
from logloom.operators.incidents import dedupe_incidents
from logloom.streaming import feedback_versions, incidents, jobs

ERRORS = "event_id bigint, received_at timestamp, message string"
ISSUES = "issue_key string, status string, updated int, summary string"
START = datetime(2024, 1, 1)


def events(spark, rows):
    return spark.createDataFrame([(i, START + timedelta(hours=h), m) for i, h, m in rows], ERRORS)


def test_incidents_equal_the_batch_form_over_restarts_and_gaps(spark, tmp_path, rows):
    issues = spark.createDataFrame(
        [("OPS-1", "open", 1, "incident:  DISK full"), ("OPS-2", "open", 5, "Incident: disk FULL "), ("OPS-9", "done", 2, "Incident: unclassified runtime error"), ("OPS-3", "open", 3, None)], ISSUES
    )
    parts = [
        [(7, 1, "Queue  stuck"), (3, 1, "queue stuck"), (4, 2, "Disk full")],
        [(1, 30, "QUEUE STUCK"), (9, 31, "Late one"), (8, 31, "late ONE"), (10, 32, None)],
        # Longer after the first than any watermark of the other streams.
        [(20, 24 * 90, "queue stuck"), (21, 24 * 90, "late one"), (22, 24 * 90, "new again"), (23, 24 * 90, "")],
    ]
    source, target, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    frames = [events(spark, p) for p in parts]
    for frame in frames:
        frame.repartition(2).write.mode("append").parquet(source)
        stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1 if frame is frames[2] else 100).parquet(source)
        incidents.stream_incidents(stream, target, check, issues).awaitTermination()
    everything = frames[0].union(frames[1]).union(frames[2])
    found = incidents.incidents(spark, target)
    assert rows(incidents.incident_operations(everything, found)) == rows(dedupe_incidents(everything, issues))
    by_key = {r["summary_key"]: r for r in found.collect()}
    assert by_key["incident: queue stuck"]["events"] == 4 and by_key["incident: queue stuck"]["creator"] == 3
    assert by_key["incident: disk full"]["issue_key"] == "OPS-2" and by_key["incident: disk full"]["creator"] is None
    assert by_key["incident: unclassified runtime error"]["issue_key"] == "OPS-9" and by_key["incident: unclassified runtime error"]["events"] == 2
    # Each summary was created at most once, whatever the number of micro-batches.
    updates = spark.read.option("basePath", target).parquet(target)
    assert updates.where("operation = 'created'").groupBy("summary_key").count().where("count > 1").isEmpty()
    assert updates.select("micro_batch").distinct().count() >= 3


def test_incidents_without_issues_and_of_one_hot_summary(spark, tmp_path):
    source, target, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    frame = spark.range(4000).select("id", F.lit(START).cast("timestamp").alias("received_at"), F.when(F.col("id") % 4 > 0, "same").otherwise(F.concat(F.lit("m"), F.col("id") % 40)).alias("message")).withColumnRenamed("id", "event_id")
    frame.write.parquet(source)
    incidents.stream_incidents(spark.readStream.schema(frame.schema).parquet(source), target, check).awaitTermination()
    found = {r["summary_key"]: (r["creator"], r["events"]) for r in incidents.incidents(spark, target).collect()}
    assert found["incident: same"] == (1, 3000) and len(found) == 11 and sum(n for _, n in found.values()) == 4000
    assert incidents.new_issue_key("incident: same") == spark.range(1).select(F.concat(F.lit("NEW-"), F.substring(F.md5(F.lit("incident: same").cast("binary")), 1, 12))).first()[0]


PAYLOADS = "received_at timestamp, payload string"


@pytest.fixture
def queue(spark, tmp_path):
    """A folder of payloads that grows, and a flush of it."""
    source, target, ledger, check = (str(tmp_path / n) for n in ("in", "out", "ledger", "check"))

    class Queue:
        def put(self, *payloads):
            spark.createDataFrame([(START, p) for p in payloads], PAYLOADS).coalesce(1).write.mode("append").parquet(source)

        def flush(self, day, files=1000):
            stream = spark.readStream.schema(PAYLOADS).option("maxFilesPerTrigger", files).parquet(source)
            jobs.daily_flush(stream, target, ledger, check, day)

        def taken(self):
            return sorted(r["value"] for r in spark.read.schema("value string, batch_date string").text(target).collect())

        def days(self):
            return sorted(tuple(r) for r in jobs.flush_ledger(spark, ledger).collect())

    return Queue()


def test_a_day_is_queued_or_empty(queue):
    queue.put("a", "b")
    queue.flush("2024-01-02")
    queue.flush("2024-01-03")
    queue.flush("2024-01-03")
    assert queue.days() == [("2024-01-02", "queued", 2), ("2024-01-03", "empty", 0)]
    queue.put("c")
    queue.flush("2024-01-03")
    assert queue.days() == [("2024-01-02", "queued", 2), ("2024-01-03", "queued", 1)] and queue.taken() == ["a", "b", "c"]


@pytest.mark.parametrize("retry", ["2024-01-02", "2024-01-03"])
def test_a_crash_between_payloads_and_ledger_loses_nothing(queue, monkeypatch, retry):
    queue.put("a", "b")
    mark = jobs._mark

    def crash(spark, ledger, what, *rest):
        if what == "done":
            raise RuntimeError("stopped here")
        mark(spark, ledger, what, *rest)

    monkeypatch.setattr(jobs, "_mark", crash)
    with pytest.raises(Exception, match="stopped here"):
        queue.flush("2024-01-02")
    assert queue.taken() == ["a", "b"] and queue.days() == []
    monkeypatch.setattr(jobs, "_mark", mark)
    queue.flush(retry)
    wanted = [("2024-01-02", "queued", 2)] + ([("2024-01-03", "empty", 0)] if retry != "2024-01-02" else [])
    assert queue.days() == wanted and queue.taken() == ["a", "b"]


def test_more_micro_batches_than_the_progress_keeps(spark, queue):
    for i in range(9):
        queue.put(f"p{i}")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", 2)
    try:
        queue.flush("2024-01-02", files=1)
    finally:
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
    assert queue.days() == [("2024-01-02", "queued", 9)] and len(queue.taken()) == 9


FEEDBACK = "event_id string, received_at timestamp, message string, correct_label string"


def test_every_feedback_is_a_version_with_the_id_of_its_content(spark, tmp_path, rows):
    base = spark.createDataFrame([("a", "Noise"), ("a", "Error"), ("a", "Noise"), ("b", "SYSTEM"), ("", "Noise"), ("c", "other")], "message string, class string")
    source, root, check = (str(tmp_path / n) for n in ("in", "root", "check"))
    parts = [[("1", "a", "error"), ("2", "new", "Noise"), ("3", "a", "SYSTEM")], [("4", "new", "SYSTEM"), ("5", "new", "noise"), ("6", "b", "SYSTEM")], [("7", "a", "SYSTEM"), ("8", "c", "Error")]]
    seen, hour = [], 0
    for part in parts:
        made = []
        for i, m, x in part:
            hour += 1
            made.append((i, START + timedelta(hours=hour), m, x))
        seen += made
        spark.createDataFrame(made, FEEDBACK).write.mode("append").parquet(source)
        feedback_versions.stream_feedback_versions(spark.readStream.schema(FEEDBACK).parquet(source), base, root, check).awaitTermination()
    found = {r["version"]: r for r in feedback_versions.versions(spark, root).collect()}
    assert sorted(found) == list(range(9))
    assert [found[v]["action"] for v in range(9)] == ["base", "corrected", "appended", "corrected", "corrected", "corrected", "corrected", "corrected", "appended"]

    def check_all():
        for v in range(9):
            whole = feedback.upsert_feedback(base, feedback.checked_feedback(spark.createDataFrame(seen[:v], FEEDBACK)))
            assert rows(feedback_versions.read_version(spark, root, v)) == rows(whole)
            first = dataset.dataset_fingerprint(whole, ["message", "class"]).first()
            assert (found[v]["data_version_id"], found[v]["row_count"]) == tuple(first)

    check_all()
    for at in (4, 7):
        assert feedback_versions.compact(spark, root, at) == at
    check_all()
    assert rows(feedback_versions.read_version(spark, root)) == rows(feedback_versions.read_version(spark, root, 8))
    with pytest.raises(ValueError, match="no version 9"):
        feedback_versions.read_version(spark, root, 9)


def test_a_micro_batch_that_is_run_twice_makes_the_same_versions(spark, tmp_path):
    base = spark.createDataFrame([("a", "Noise")], "message string, class string")
    root = str(tmp_path / "root")
    feedback_versions.start(base, root)
    step = feedback_versions._merged(root)
    first = spark.createDataFrame([("1", START, "a", "Error"), ("2", START, "x", "Noise")], FEEDBACK)
    later = spark.createDataFrame([("0", START - timedelta(days=9), "a", "SYSTEM")], FEEDBACK)
    for batch, n in ((first, 0), (first, 0), (later, 1), (first, 0), (later, 1)):
        step(batch, n)
    found = [tuple(r) for r in feedback_versions.versions(spark, root).orderBy("version").select("version", "event_id", "row_count").collect()]
    # Versions follow the order of arrival, also where an event is older.
    assert found == [(0, None, 1), (1, "1", 1), (2, "2", 2), (3, "0", 2)]
    assert sorted(tuple(r) for r in feedback_versions.read_version(spark, root).collect()) == [("a", "SYSTEM"), ("x", "Noise")]


def test_many_feedbacks_write_little(spark, tmp_path):
    def size(folder):
        return sum(p.stat().st_size for p in (tmp_path / folder).rglob("*.parquet"))

    base = spark.range(200_000).select(F.sha2(F.col("id").cast("string"), 256).alias("message"), F.lit("Noise").alias("class"))
    feedback_versions.start(base, str(tmp_path / "root"))
    before = size("root")
    events = spark.range(500).select(F.col("id").cast("string").alias("event_id"), F.lit(START).cast("timestamp").alias("received_at"), F.sha2((F.col("id") % 7).cast("string"), 256).alias("message"), F.lit("Error").alias("correct_label"))
    feedback_versions._merged(str(tmp_path / "root"))(events, 0)
    assert size("root") - before < before / 50
    assert feedback_versions.versions(spark, str(tmp_path / "root")).count() == 501


def test_summaries_of_a_bucket_share_one_call():
    class Known(dict):
        getValue, updateValue = dict.get, dict.__setitem__

    state = Known()
    processor = incidents.Incidents()
    processor.init(type("Handle", (), {"getMapState": lambda self, *schema: state})())
    processor.handleInitialState((7,), pd.DataFrame({"summary_key": ["a", "b"], "known_key": ["OPS-1", "OPS-2"]}), None)
    at = [pd.Timestamp("2024-01-01"), pd.Timestamp("2024-01-02"), pd.Timestamp("2024-01-03")]
    parts = [
        pd.DataFrame([("c", "C", 5, at[1], at[2], 2), ("a", "A", 2**60 + 1, at[1], at[1], 1)], columns=incidents.PARTS),
        pd.DataFrame([("c", "c", 2**60 + 3, at[0], at[0], 4), ("d", "D", 9, at[2], at[2], 1)], columns=incidents.PARTS),
    ]
    said = pd.concat(processor.handleInputRows((7,), iter(parts), None)).set_index("summary_key")
    assert said["operation"].to_dict() == {"a": "reused", "c": "created", "d": "created"}
    assert said["creator"].to_dict() == {"a": None, "c": 2**60 + 3, "d": 9}
    assert tuple(said.loc["c", ["summary", "issue_key", "first_seen", "last_seen", "events"]]) == ("c", incidents.new_issue_key("c"), at[0], at[2], 6)
    assert said.loc["a", "issue_key"] == "OPS-1" and state[("d",)] == (incidents.new_issue_key("d"),)
    again = pd.concat(processor.handleInputRows((7,), iter(parts[1:]), None))
    assert set(again["operation"]) == {"reused"}
