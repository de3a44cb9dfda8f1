"""Files and streams: written from the given tables to the shared folder, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from logloom.functions.payload import extract_message
from logloom.functions.labels import rule_label
from logloom.operators.scoring import score_records
from logloom.plans import duck
from logloom.plans.quality_queries import fingerprint_sql
from logloom.plans.registry import query
from logloom.plans.service_queries import BASE, EVENTS, SIDECARS, feedback_tables
from logloom.plans.tables import derived, given, with_tables
from logloom.plans.triage_queries import INCIDENTS
from logloom.session import scratch_path
from logloom.sources import readers, records, sinks
from logloom.streaming import feedback_versions, incidents, jobs


def raw_lines(df, path, header=None):
    """Lines as they are, one file per task, each with the header line if given."""
    writer = df.write.option("quote", "").option("escapeQuotes", False).option("sep", "\x01").option("emptyValue", "")
    if header:
        df = df.toDF(header)
        writer = df.write.option("quote", "").option("escapeQuotes", False).option("sep", "\x01").option("header", True).option("emptyValue", "")
    writer.csv(path)
    return path


# A third field makes a row too long; a row without its label is too short.
CSV_LINE = """'"' || replace(message, '"', '""') || '"' || CASE WHEN k < 4 THEN ',' || label || ',extra' WHEN k < 6 THEN '' ELSE ',' || label END"""


@query("read_labeled_csv", with_tables("SELECT message AS LogMessage, CASE WHEN k >= 6 THEN label END AS class FROM messages WHERE k >= 4", "messages"))
def _(spark, sf):
    lines = derived(spark, sf, "messages").selectExpr(f"{CSV_LINE} AS line")
    path = raw_lines(lines, scratch_path(spark, "labeled"), "LogMessage,class")
    return readers.read_labeled_csv(spark, path)[0]


@query("read_labeled_csv_stats", with_tables("SELECT 'skip_bad_lines' AS csv_parse_mode, count(*) FILTER (WHERE k < 4) AS csv_bad_rows_skipped, count(*) FILTER (WHERE k >= 4) AS rows_kept FROM messages", "messages"))
def _(spark, sf):
    lines = derived(spark, sf, "messages").selectExpr(f"{CSV_LINE} AS line")
    path = raw_lines(lines, scratch_path(spark, "labeled"), "LogMessage,class")
    return readers.read_labeled_csv(spark, path, multi_line=False)[1]


@query("read_raw_logs", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, text AS message, lang FROM documents")
def _(spark, sf):
    path = scratch_path(spark, "raw")
    given(spark, sf, "documents").select("doc_id", "text", "lang").write.option("header", True).option("escape", '"').csv(path)
    return readers.read_raw_logs(spark, path)


@query("read_golden", with_tables("SELECT message, label, true AS numbered FROM messages", "messages"))
def _(spark, sf):
    path = scratch_path(spark, "golden")
    sinks.write_labeled_csv(derived(spark, sf, "messages").select("message", F.col("label").alias("class")), path)
    golden = readers.read_golden(spark, path)
    return golden.select("message", "label", (F.col("line_number") >= 2).alias("numbered"))


def scoring_folder(spark, sf):
    """The messages in three file formats."""
    root = scratch_path(spark, "records")
    rows = derived(spark, sf, "messages")
    rows.select("message").write.text(f"{root}/lines")
    rows.select("event_id", F.col("message").alias("msg")).write.json(f"{root}/objects")
    rows.select("user_id", "message").write.option("header", True).option("escape", '"').csv(f"{root}/tables")
    return root


@query("read_scoring_records", with_tables("SELECT format, message FROM messages, (VALUES ('lines'), ('objects'), ('tables')) AS f(format)", "messages"))
def _(spark, sf):
    root = scoring_folder(spark, sf)
    lines = records.text_records(spark, f"{root}/lines", "txt").withColumn("format", F.lit("lines"))
    # Spark writes one object per line into files that end in .json; they are read by lines here.
    objects = records.line_records(spark, f"{root}/objects", "json").withColumn("format", F.lit("objects"))
    tables = records.csv_records(spark, f"{root}/tables").withColumn("format", F.lit("tables"))
    # The CSV rows hold their user first; the message is found by name.
    return lines.unionByName(tables).unionByName(objects).select("format", extract_message("payload").alias("message"))


@query("score_files", with_tables(f"SELECT message, {duck.rule_label('message')} AS prediction FROM messages", "messages"))
def _(spark, sf):
    root = scoring_folder(spark, sf)
    found = records.read_scoring_records(spark, f"{root}/tables", formats=("csv",))
    return score_records(found, rule_label).select("message", "prediction")


@query("row_index_of_files", with_tables("SELECT count(*) AS n, count(*) AS distinct_places FROM messages", "messages"))
def _(spark, sf):
    lines = records.text_records(spark, f"{scoring_folder(spark, sf)}/lines", "txt")
    ends = lines.groupBy("source_file").agg(F.count(F.lit(1)).alias("n"), F.max("row_index").alias("last"), F.count_distinct("row_index").alias("d"))
    # Dense numbering: as many numbers as rows, and the last one is rows - 1.
    return ends.where("last = n - 1").agg(F.sum("n").alias("n"), F.sum("d").alias("distinct_places"))


@query("write_predictions", with_tables("SELECT CAST(line_number AS VARCHAR) AS line_number, message, true_label, nullif(predicted_label, '') AS predicted_label, CASE WHEN true_label = predicted_label THEN 'true' ELSE 'false' END AS match FROM judged", "judged"))
def _(spark, sf):
    path = scratch_path(spark, "predictions")
    rows = derived(spark, sf, "judged")
    sinks.write_predictions(rows.withColumn("match", F.col("true_label") == F.col("predicted_label")), path)
    back = readers.csv_reader(spark, True).csv(path)
    return back.withColumn("predicted_label", F.nullif("predicted_label", F.lit("")))


@query("latest_reports", "SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, (SELECT count(*) FROM orders WHERE o_orderkey % 2 = 1) AS in_copy FROM orders GROUP BY o_custkey")
def _(spark, sf):
    """Reports in two writes: the newest of each key from both, and the copy of the last write."""
    root = scratch_path(spark, "reports")
    orders = given(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    for half in (0, 1):
        sinks.write_report_with_latest(orders.where(F.col("o_orderkey") % 2 == half), root)
    copied = spark.read.json(f"{root}/latest").count()
    return sinks.latest_reports(spark, root, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", F.lit(copied).cast("bigint").alias("in_copy"))


@query("lineage_round_trip", f"""SELECT dataset_id, pipeline_id, 'b' || parent_run_id AS parent_run_id FROM ({SIDECARS.format(customer='customer')})""")
def _(spark, sf):
    path = scratch_path(spark, "lineage")
    rows = spark.sql(SIDECARS.format(customer=f"parquet.`{sf}/customer.parquet`"))
    for stamp in ("a", "b"):
        sinks.append_lineage(rows.withColumn("parent_run_id", F.concat(F.lit(stamp), "parent_run_id")).withColumn("created_at", F.lit(stamp)), path)
    return sinks.read_lineage(spark, path).select("dataset_id", "pipeline_id", "parent_run_id")


@query("archive_dataset", f"SELECT data_version_id, row_count, row_count AS stored_rows, 'second' AS note FROM ({fingerprint_sql(['doc_id', 'text'], 'documents')})")
def _(spark, sf):
    root = scratch_path(spark, "archive")
    rows = given(spark, sf, "documents").select("doc_id", "text")
    sinks.archive_dataset(rows, root, {"note": "first", "blank": " "}, "2024-01-01 00:00:00")
    sinks.archive_dataset(rows.orderBy(F.desc("doc_id")), root, {"note": "second"}, "2024-01-02 00:00:00")
    stored = spark.read.option("basePath", f"{root}/data").parquet(f"{root}/data").groupBy("data_version_id").agg(F.count(F.lit(1)).alias("stored_rows"))
    found = sinks.data_versions(spark, root).join(stored, "data_version_id")
    return found.select("data_version_id", "row_count", "stored_rows", F.col("metadata")["note"].alias("note"))


# --- streams ---------------------------------------------------------------------


def as_stream(spark, df, name):
    """A table as a stream of its files."""
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


@query("stream_daily_counts", with_tables("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, label AS prediction, count(*) AS n FROM messages GROUP BY ALL", "messages"))
def _(spark, sf):
    rows = derived(spark, sf, "messages").select(F.col("ts").cast("timestamp").alias("ts"), F.col("label").alias("prediction"))
    target = scratch_path(spark, "daily")
    jobs.write_updates(jobs.daily_counts(as_stream(spark, rows, "labels"), "60 days"), target, scratch_path(spark, "check")).awaitTermination()
    return jobs.latest_updates(spark, target, ["day", "prediction"])


@query("stream_request_metrics", with_tables("SELECT strftime(time_bucket(INTERVAL 5 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS window_start, method, path, status, count(*) AS requests, round(sum(greatest(duration, 0.0)), 6) AS duration_sum FROM samples GROUP BY window_start, method, path, status", "samples"))
def _(spark, sf):
    rows = derived(spark, sf, "samples")
    target = scratch_path(spark, "metrics")
    live = jobs.live_request_metrics(as_stream(spark, rows, "samples"), "60 days", "5 minutes")
    jobs.write_updates(live, target, scratch_path(spark, "check")).awaitTermination()
    present = jobs.latest_updates(spark, target, ["window_start", "method", "path", "status"])
    return present.withColumns({"window_start": F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"), "duration_sum": F.round("duration_sum", 6)})


@query("stream_daily_batches", """SELECT CAST(CAST(l AS DATE) + CASE WHEN CAST(l AS TIME) <= TIME '18:00:00' THEN 0 ELSE 1 END AS VARCHAR) AS batch_date, props AS payload FROM (SELECT props, timezone('Europe/Berlin', timezone('UTC', ts)) AS l FROM events)""")
def _(spark, sf):
    rows = given(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("received_at"), F.col("props").alias("payload"))
    target = scratch_path(spark, "batches")
    jobs.write_daily_batches(as_stream(spark, rows, "events"), target, scratch_path(spark, "check"), "18:00", "Europe/Berlin").awaitTermination()
    return spark.read.schema("value string, batch_date string").text(target).select("batch_date", F.col("value").alias("payload"))


@query("read_event_stream", with_tables("""SELECT CASE WHEN k < 50 THEN '{"message":"' || message || '",' ELSE '{"msg": "' || message || '",' END AS start, message FROM messages""", "messages"))
def _(spark, sf):
    line = F.when(F.col("k") < 50, F.col("message")).otherwise(F.concat(F.lit('{"msg": "'), "message", F.lit('"}')))
    folder, target = scratch_path(spark, "incoming"), scratch_path(spark, "read")
    derived(spark, sf, "messages").select(line.alias("value")).write.text(folder)
    events = readers.read_event_stream(spark, folder)
    query_ = events.writeStream.format("parquet").option("path", target).option("checkpointLocation", scratch_path(spark, "check")).trigger(availableNow=True).start()
    query_.awaitTermination()
    payload = spark.read.parquet(target).select("payload")
    return payload.select(F.regexp_extract("payload", r'^(.*,)"received_at"', 1).alias("start"), extract_message("payload").alias("message"))


@query("stream_feedback", with_tables(f"""WITH latest AS (SELECT message, max_by(CASE correct_label WHEN 'noise' THEN 'Noise' ELSE correct_label END, (received_at, event_id)) AS correct_label FROM ({EVENTS}) GROUP BY 1)
  SELECT b.message, coalesce(l.correct_label, b.class) AS class FROM ({BASE}) b LEFT JOIN latest l USING (message) UNION ALL SELECT message, correct_label FROM latest WHERE message NOT IN (SELECT message FROM ({BASE}))""", "messages"))
def _(spark, sf):
    base, events = feedback_tables(spark, sf)
    root = scratch_path(spark, "feedback")
    jobs.stream_feedback(as_stream(spark, events, "corrections"), base, root, scratch_path(spark, "check")).awaitTermination()
    return jobs.newest_dataset(spark, root)


def feedback_versions_of(spark, sf):
    """The corrections in two halves of the month, as versions of the base."""
    base, events = feedback_tables(spark, sf)
    root, source, check = (scratch_path(spark, n) for n in ("versions", "corrections", "check"))
    for late in (False, True):
        events.where((F.dayofmonth("received_at") > 15) == F.lit(late)).write.mode("append").parquet(source)
        feedback_versions.stream_feedback_versions(spark.readStream.schema(events.schema).parquet(source), base, root, check).awaitTermination()
    return root


@query("feedback_versions", with_tables(f"""WITH e AS (SELECT *, row_number() OVER (ORDER BY received_at, event_id) AS version FROM ({EVENTS}))
  SELECT version, event_id, CASE WHEN row_number() OVER (PARTITION BY message ORDER BY version) > 1 OR message IN (SELECT message FROM ({BASE})) THEN 'corrected' ELSE 'appended' END AS action,
    (SELECT count(*) FROM ({BASE})) + CAST(sum(CASE WHEN message IN (SELECT message FROM ({BASE})) OR (message, version) NOT IN (SELECT message, min(version) FROM e GROUP BY 1) THEN 0 ELSE 1 END) OVER (ORDER BY version) AS BIGINT) AS row_count FROM e""", "messages"))
def _(spark, sf):
    return feedback_versions.versions(spark, feedback_versions_of(spark, sf)).where("version > 0").select("version", "event_id", "action", "row_count")


@query("read_feedback_version", with_tables(f"""WITH e AS (SELECT *, row_number() OVER (ORDER BY received_at, event_id) AS version FROM ({EVENTS})),
  latest AS (SELECT message, max_by(CASE correct_label WHEN 'noise' THEN 'Noise' ELSE correct_label END, version) AS correct_label FROM e WHERE version <= (SELECT count(*) // 2 FROM e) GROUP BY 1)
  SELECT b.message, coalesce(l.correct_label, b.class) AS class FROM ({BASE}) b LEFT JOIN latest l USING (message) UNION ALL SELECT message, correct_label FROM latest WHERE message NOT IN (SELECT message FROM ({BASE}))""", "messages"))
def _(spark, sf):
    """The version after half of the feedback, read from a snapshot after a quarter of it."""
    root = feedback_versions_of(spark, sf)
    count = feedback_versions.versions(spark, root).count() - 1
    feedback_versions.compact(spark, root, count // 4)
    return feedback_versions.read_version(spark, root, count // 2)


ERROR_KEYS = f"SELECT DISTINCT {duck.fold(duck.collapse(duck.summary(chr(39) + 'Incident: ' + chr(39) + ' || message')))} AS summary_key FROM errors"


@query("stream_incidents", with_tables(ERROR_KEYS, "errors"))
def _(spark, sf):
    rows = derived(spark, sf, "errors").select("event_id", F.col("received_at").alias("ts"), "message")
    target = scratch_path(spark, "incidents")
    creates = jobs.incident_creates(as_stream(spark, rows, "errors"), "60 days")
    running = creates.writeStream.format("parquet").option("path", target).option("checkpointLocation", scratch_path(spark, "check")).trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.parquet(target).select("summary_key")


@query("stream_incident_operations", with_tables(f"WITH {INCIDENTS} SELECT event_id, summary, issue_key, operation FROM opened", "errors", "issues"))
def _(spark, sf):
    """The errors come in by thirds of the month, with a restart between; known issues are the first state."""
    rows = derived(spark, sf, "errors").select("event_id", "received_at", "message")
    issues = derived(spark, sf, "issues")
    source, target, check = (scratch_path(spark, n) for n in ("errors", "incidents", "check"))
    for third in range(3):
        day = F.dayofmonth("received_at")
        rows.where((day > 10 * third) & ((day <= 10 * third + 10) | F.lit(third == 2))).write.mode("append").parquet(source)
        incidents.stream_incidents(spark.readStream.schema(rows.schema).parquet(source), target, check, issues).awaitTermination()
    return incidents.incident_operations(rows, incidents.incidents(spark, target))


@query("stream_incident_reuse", with_tables(f"SELECT day, summary_key, n - CASE WHEN day = min(day) OVER (PARTITION BY summary_key) THEN 1 ELSE 0 END AS reused FROM (SELECT CAST(CAST(received_at AS DATE) AS VARCHAR) AS day, {duck.fold(duck.collapse(duck.summary(chr(39) + 'Incident: ' + chr(39) + ' || message')))} AS summary_key, count(*) AS n FROM errors GROUP BY ALL)", "errors"))
def _(spark, sf):
    rows = derived(spark, sf, "errors").select(F.col("received_at").alias("ts"), "message")
    target = scratch_path(spark, "reuse")
    jobs.write_updates(jobs.incident_event_totals(as_stream(spark, rows, "errors"), watermark="60 days"), target, scratch_path(spark, "check")).awaitTermination()
    return jobs.incident_reuses(jobs.latest_updates(spark, target, ["day", "summary_key"]))


@query("daily_flush", with_tables("SELECT day, status, messages FROM (SELECT '2024-02-01' AS day, 'queued' AS status, count(*) AS messages FROM events UNION ALL SELECT '2024-02-02', 'empty', 0)"))
def _(spark, sf):
    rows = given(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("received_at"), F.col("props").alias("payload"))
    stream = as_stream(spark, rows, "events")
    target, ledger, check = (scratch_path(spark, n) for n in ("flush", "ledger", "check"))
    for day in ("2024-02-01", "2024-02-02", "2024-02-02"):
        jobs.daily_flush(stream, target, ledger, check, day)
    return jobs.flush_ledger(spark, ledger)


@query("daily_flush_payloads", "SELECT CAST(CAST(l AS DATE) + CASE WHEN CAST(l AS TIME) <= TIME '18:00:00' THEN 0 ELSE 1 END AS VARCHAR) AS batch_date, props AS payload FROM (SELECT props, timezone('Europe/Berlin', timezone('UTC', ts)) AS l FROM events)")
def _(spark, sf):
    """The events come in twice as two halves; both flushes together hold each payload once."""
    rows = given(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("received_at"), F.col("props").alias("payload"), "event_id")
    source, target, ledger, check = (scratch_path(spark, n) for n in ("incoming", "flush", "ledger", "check"))
    for half, day in enumerate(("2024-02-01", "2024-02-02")):
        rows.where(F.col("event_id") % 2 == half).write.mode("append").parquet(source)
        jobs.daily_flush(spark.readStream.schema(rows.schema).parquet(source), target, ledger, check, day, "18:00", "Europe/Berlin")
    return spark.read.schema("value string, batch_date string").text(target).select("batch_date", F.col("value").alias("payload"))
