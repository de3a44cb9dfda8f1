"""Labelling answers, feedback, lineage, monitoring."""

from __future__ import annotations

import json
from contextlib import suppress

from pyspark.sql import functions as F

from logloom.functions.labels import rule_label
from logloom.operators import diffs, feedback, incidents, labeling, lineage, monitoring
from logloom.operators.indexing import into_batches, with_order_index
from logloom.plans import duck
from logloom.plans.quality_queries import rounded
from logloom.plans.registry import query
from logloom.plans.tables import derived, given, with_tables
from logloom.session import checkpointed, scratch_path

BATCHES = "SELECT event_id, message, label, k, CAST(floor((row_number() OVER (ORDER BY ts, event_id) - 1) / 10) AS BIGINT) AS batch_id, CAST((row_number() OVER (ORDER BY ts, event_id) - 1) % 10 AS INT) AS pos FROM messages"


def batches(spark, sf):
    rows = derived(spark, sf, "messages").select("event_id", "message", "label", "k", "ts")
    return into_batches(with_order_index(rows, ["ts", "event_id"])).drop("ts", "row_index")


@query("into_batches", with_tables(f"SELECT event_id, batch_id, pos FROM ({BATCHES})", "messages"))
def _(spark, sf):
    return batches(spark, sf).select("event_id", "batch_id", "pos")


def answers(rows):
    """Answers to batches: some whole, some short, some no JSON."""
    said = F.transform(F.array_sort(F.collect_list(F.struct("pos", "label"))), lambda x: F.named_struct(F.lit("class"), x["label"]))
    whole = F.to_json(F.named_struct(F.lit("results"), said))
    short = F.to_json(F.named_struct(F.lit("results"), F.slice(said, 1, 4)))
    picked = F.when(F.min("k") < 3, "sorry, no answer").when(F.min("k") < 12, short).otherwise(whole)
    return rows.groupBy("batch_id").agg(picked.alias("content"), F.min("k").alias("low_k"))


@query("align_labels", with_tables(f"""WITH b AS ({BATCHES}), a AS (SELECT batch_id, min(k) AS low FROM b GROUP BY 1)
  SELECT event_id, batch_id, pos, CASE WHEN low < 3 THEN 'Noise' WHEN low < 12 AND pos >= 4 THEN 'Noise' ELSE label END AS class FROM b JOIN a USING (batch_id)""", "messages"))
def _(spark, sf):
    rows = batches(spark, sf)
    return labeling.align_labels(rows.select("event_id", "batch_id", "pos"), answers(rows))


@query("prompt_case_eval", with_tables(f"""WITH b AS ({BATCHES}), a AS (SELECT batch_id, min(k) AS low FROM b GROUP BY 1), g AS (
  SELECT b.*, CASE WHEN low < 3 THEN 'Noise' WHEN low < 12 AND pos >= 4 THEN 'Noise' ELSE label END AS got, {duck.rule_label('message')} AS expected FROM b JOIN a USING (batch_id))
  SELECT batch_id, pos, 'Case ' || (pos + 1) AS name, message, expected, got, expected = got AS match FROM g""", "messages"))
def _(spark, sf):
    rows = batches(spark, sf)
    cases = rows.select("batch_id", "pos", F.lit(" ").alias("name"), "message", rule_label("message").alias("expected"))
    return labeling.prompt_case_eval(cases, answers(rows))


@query("usage_totals", with_tables("SELECT CAST(sum(k) AS BIGINT) AS prompt_tokens, CAST(sum(CASE WHEN k < 50 THEN user_id ELSE 0 END) AS BIGINT) AS completion_tokens, CAST(0 AS BIGINT) AS total_tokens FROM messages", "messages"))
def _(spark, sf):
    rows = derived(spark, sf, "messages").selectExpr("k AS prompt_tokens", "CASE WHEN k < 50 THEN user_id END AS completion_tokens", "CAST(NULL AS BIGINT) AS total_tokens")
    return labeling.usage_totals(rows)


def length_client(messages: list[str]) -> dict:
    """Stands for a labelling service: answers from the length of the message."""
    classes = [{"class": "Noise" if len(m) % 2 else "Error"} for m in messages]
    return {"content": json.dumps({"results": classes}), "prompt_tokens": sum(map(len, messages)), "completion_tokens": len(messages)}


@query("label_rows", with_tables("SELECT event_id, CASE WHEN length(message) % 2 = 1 THEN 'Noise' ELSE 'Error' END AS class FROM messages", "messages"))
def _(spark, sf):
    rows = derived(spark, sf, "messages").select("event_id", "message", "ts")
    return labeling.label_rows(rows, length_client, ["ts", "event_id"])[0].select("event_id", "class")


@query("label_rows_usage", with_tables("SELECT CAST(sum(length(message)) AS BIGINT) AS prompt_tokens, count(*) AS completion_tokens, CAST(0 AS BIGINT) AS total_tokens FROM messages", "messages"))
def _(spark, sf):
    rows = derived(spark, sf, "messages").select("event_id", "message", "ts")
    return labeling.label_rows(rows, length_client, ["ts", "event_id"])[1]


def half_client(messages: list[str]) -> dict:
    """As ``length_client``, but without an answer to batches that begin with a request."""
    if messages[0].startswith("GET"):
        raise ConnectionError("no answer")
    return length_client(messages)


@query("label_rows_with_ledger", with_tables("SELECT event_id, CASE WHEN length(message) % 2 = 1 THEN 'Noise' ELSE 'Error' END AS class FROM messages", "messages"))
def _(spark, sf):
    """A run that stops for want of answers, and one that asks for those only."""
    rows, ledger = derived(spark, sf, "messages").select("event_id", "message", "ts"), scratch_path(spark, "answers")
    with suppress(labeling.LabellingStopped):
        labeling.label_rows_with_ledger(rows, half_client, ["ts", "event_id"], ledger)
    return labeling.label_rows_with_ledger(rows, length_client, ["ts", "event_id"], ledger)[0].select("event_id", "class")


# --- feedback ------------------------------------------------------------------

BASE = "SELECT message, label AS class FROM messages WHERE event_type <> 'signup'"
EVENTS = "SELECT CAST(event_id AS STRING) AS event_id, ts AS received_at, message, CASE WHEN value < 20 THEN 'SYSTEM' ELSE 'noise' END AS correct_label FROM messages WHERE event_type IN ('signup', 'error')"


def feedback_tables(spark, sf):
    rows = derived(spark, sf, "messages")
    rows.createOrReplaceTempView("messages")
    return spark.sql(BASE), feedback.checked_feedback(spark.sql(EVENTS))


@query("upsert_feedback", with_tables(f"""WITH latest AS (SELECT message, max_by(CASE correct_label WHEN 'noise' THEN 'Noise' ELSE correct_label END, (received_at, event_id)) AS correct_label FROM ({EVENTS}) GROUP BY 1)
  SELECT b.message, coalesce(l.correct_label, b.class) AS class FROM ({BASE}) b LEFT JOIN latest l USING (message) UNION ALL SELECT message, correct_label FROM latest WHERE message NOT IN (SELECT message FROM ({BASE}))""", "messages"))
def _(spark, sf):
    return feedback.upsert_feedback(*feedback_tables(spark, sf))


@query("feedback_actions", with_tables(f"""SELECT event_id, message, CASE WHEN row_number() OVER (PARTITION BY message ORDER BY received_at, event_id) > 1 OR message IN (SELECT message FROM ({BASE})) THEN 'corrected' ELSE 'appended' END AS action FROM ({EVENTS})""", "messages"))
def _(spark, sf):
    base, events = feedback_tables(spark, sf)
    return feedback.feedback_actions(events, base)


@query("feedback_from_payload", with_tables("""SELECT event_id, message, CASE WHEN k < 50 THEN label ELSE '' END AS correct_label, 'Noise' AS predicted_label, 'ui' AS source FROM messages""", "messages"))
def _(spark, sf):
    raw = derived(spark, sf, "messages").selectExpr("event_id", """'{"message":" ' || message || ' ","label":"' || CASE WHEN k < 50 THEN lower(label) ELSE 'what' END || '","predicted_label":"Noise","source":"ui","metadata":{"k":"' || k || '"}}' AS raw""")
    return feedback.feedback_from_payload(raw).drop("metadata")


# --- lineage -------------------------------------------------------------------

HISTORY = """v AS (SELECT name, sha256(text) AS version_id, min(created_at) AS created_at, any_value(text) AS text FROM versions GROUP BY 1, 2),
 h AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY created_at, version_id) - 1 AS position, coalesce(lag(version_id) OVER (PARTITION BY name ORDER BY created_at, version_id), '') AS previous_version_id FROM v)"""


def history(spark, sf):
    versions = lineage.content_versions(derived(spark, sf, "versions"), "name")
    return versions, lineage.version_history(versions, "name")


@query("version_history", with_tables(f"""WITH {HISTORY} SELECT name, version_id, left(version_id, 12) AS version_label, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, position, previous_version_id, length(text) AS char_count,
  CAST(CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + CASE WHEN text LIKE '%' || chr(10) THEN 0 ELSE 1 END END AS BIGINT) AS line_count FROM h""", "versions"))
def _(spark, sf):
    return history(spark, sf)[1].withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))


@query("version_diffs", with_tables(f"""WITH {HISTORY}, pairs AS (SELECT DISTINCT version_id, previous_version_id FROM h WHERE previous_version_id <> ''), texts AS (SELECT version_id, any_value(text) AS text FROM v GROUP BY 1),
  lines AS (SELECT version_id, line, count(*) AS n FROM (SELECT version_id, unnest(regexp_split_to_array(text, '\\r\\n|[\\n\\r]')) AS line FROM texts) GROUP BY ALL)
  SELECT version_id, previous_version_id, line, CAST(sum(n) AS BIGINT) AS change FROM (
    SELECT p.version_id, p.previous_version_id, line, n FROM pairs p JOIN lines l ON p.version_id = l.version_id UNION ALL
    SELECT p.version_id, p.previous_version_id, line, -n FROM pairs p JOIN lines l ON p.previous_version_id = l.version_id) GROUP BY ALL HAVING sum(n) <> 0""", "versions"))
def _(spark, sf):
    versions, ordered = history(spark, sf)
    return lineage.version_diffs(ordered, versions)


# Every line end of Python's splitlines; the last one opens no line.
LINE_END = r"(?:\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x{85}\x{2028}\x{2029}])"
DIFF_PAIRS = f"""WITH {HISTORY}, pairs AS (SELECT DISTINCT version_id, previous_version_id FROM h WHERE previous_version_id <> ''),
  texts AS (SELECT version_id, CASE WHEN any_value(text) = '' THEN [] ELSE regexp_split_to_array(regexp_replace(any_value(text), '{LINE_END}\\z', ''), '{LINE_END}') END AS l FROM v GROUP BY 1)"""


@query("unified_diff", with_tables(f"""{DIFF_PAIRS} SELECT p.version_id, p.previous_version_id, CAST(len(n.l) AS BIGINT) AS new_lines, CAST(len(n.l) - len(o.l) AS BIGINT) AS growth, sha256(array_to_string(n.l, chr(10))) AS lines_sha256
  FROM pairs p JOIN texts n ON p.version_id = n.version_id JOIN texts o ON p.previous_version_id = o.version_id""", "versions"))
def _(spark, sf):
    """The hunks applied to the old versions: what comes out are the new ones, and the headers tell the growth."""
    versions, ordered = history(spark, sf)
    hunks = checkpointed(diffs.unified_diffs(ordered, versions))
    growth = hunks.groupBy(*diffs.PAIR).agg(F.sum(F.col("new_lines") - F.col("old_lines")).alias("growth"))
    lines = diffs.applied(ordered, hunks, versions).join(growth, diffs.PAIR, "left")
    return lines.select(*diffs.PAIR, F.size("lines").cast("bigint").alias("new_lines"), F.coalesce("growth", F.lit(0)).alias("growth"), F.sha2(F.array_join("lines", "\n"), 256).alias("lines_sha256"))


@query("unified_diff_balance", with_tables(f"""{DIFF_PAIRS}, lines AS (SELECT version_id, line, count(*) AS n FROM (SELECT version_id, unnest(l) AS line FROM texts) GROUP BY ALL)
  SELECT version_id, previous_version_id, line, CAST(sum(n) AS BIGINT) AS change FROM (
    SELECT p.version_id, p.previous_version_id, line, n FROM pairs p JOIN lines l ON p.version_id = l.version_id UNION ALL
    SELECT p.version_id, p.previous_version_id, line, -n FROM pairs p JOIN lines l ON p.previous_version_id = l.version_id) GROUP BY ALL HAVING sum(n) <> 0""", "versions"))
def _(spark, sf):
    versions, ordered = history(spark, sf)
    return diffs.line_balance(diffs.unified_diffs(ordered, versions))


@query("unified_diff_text", with_tables(f"""{DIFF_PAIRS} SELECT p.version_id, p.previous_version_id, '--- ' || left(p.previous_version_id, 12) || chr(10) || '+++ ' || left(p.version_id, 12) AS head,
    CAST(len(n.l) - len(o.l) AS BIGINT) AS growth FROM pairs p JOIN texts n ON p.version_id = n.version_id JOIN texts o ON p.previous_version_id = o.version_id""", "versions"))
def _(spark, sf):
    versions, ordered = history(spark, sf)
    texts = diffs.diff_texts(ordered, diffs.unified_diffs(ordered, versions))
    # Added less removed lines behind the two lines of the head; hunk headers begin with neither mark.
    body = F.slice(F.split("diff", "\n"), 3, 2**30)
    count = lambda mark: F.size(F.filter(body, lambda x: x.startswith(mark)))
    return texts.select(*diffs.PAIR, F.substring_index("diff", "\n", 2).alias("head"), (count("+") - count("-")).cast("bigint").alias("growth"))


@query("latest_report", "SELECT o_custkey, o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def _(spark, sf):
    rows = given(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return lineage.latest_report(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", F.to_date("o_orderdate").cast("string").alias("day"))


MODELS = "SELECT 'm' || CAST(floor(o_totalprice / 50) AS BIGINT) AS path, CASE o_orderstatus WHEN 'F' THEN 'Latest local' WHEN 'O' THEN 'Archived' ELSE 'Downloaded' END AS source, CAST(CAST(o_orderdate AS DATE) AS STRING) AS created_at, 'v' || o_orderkey AS model_version_id FROM {orders}"


@query("model_inventory", f"""SELECT path, source, created_at, model_version_id FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY list_position(['Latest local', 'Archived', 'Downloaded', 'Selected'], source), created_at, model_version_id) AS r
  FROM ({MODELS.format(orders='orders')})) WHERE r = 1""")
def _(spark, sf):
    return lineage.model_inventory(spark.sql(MODELS.format(orders=f"parquet.`{sf}/orders.parquet`")))


@query("resolve_versions", """WITH ids AS (SELECT DISTINCT sha256(text) AS version_id FROM documents), asked AS (SELECT DISTINCT left(sha256(text), CASE lang WHEN 'en' THEN 2 WHEN 'fr' THEN 3 WHEN 'de' THEN 7 ELSE 64 END) AS prefix FROM documents UNION SELECT DISTINCT 'zz' || lang FROM documents),
  found AS (SELECT prefix, count(version_id) AS matches, min(version_id) AS one FROM asked LEFT JOIN ids ON starts_with(version_id, prefix) GROUP BY prefix)
  SELECT prefix, matches, CASE matches WHEN 0 THEN 'not_found' WHEN 1 THEN 'found' ELSE 'ambiguous' END AS status, CASE WHEN matches = 1 THEN one END AS version_id FROM found""")
def _(spark, sf):
    docs = given(spark, sf, "documents").select("lang", F.sha2("text", 256).alias("version_id"))
    size = F.when(F.col("lang") == "en", 2).when(F.col("lang") == "fr", 3).when(F.col("lang") == "de", 7).otherwise(64)
    asked = docs.select(F.substring("version_id", F.lit(1), size).alias("prefix")).union(docs.select(F.concat(F.lit("zz"), "lang"))).distinct()
    return lineage.resolve_versions(asked, docs.select("version_id", F.lit("2024").alias("created_at")))


@query("new_versions", "SELECT DISTINCT sha256(text) AS version_id FROM documents WHERE lang = 'en' AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE lang <> 'en')")
def _(spark, sf):
    docs = given(spark, sf, "documents").select("lang", F.sha2("text", 256).alias("version_id"))
    return lineage.new_versions(docs.where("lang = 'en'").select("version_id").distinct(), docs.where("lang <> 'en'"))


SIDECARS = "SELECT c_custkey AS dataset_id, CASE WHEN c_acctbal > 0 THEN 'p' || c_custkey ELSE ' ' END AS pipeline_id, 'run' || c_custkey AS parent_run_id, 'h' || c_nationkey AS prompt_hash, CASE WHEN c_nationkey < 12 THEN 'uri-a' ELSE 'uri-b' END AS tracking_uri, CASE WHEN c_nationkey < 5 THEN '' ELSE c_mktsegment END AS experiment_name FROM {customer}"


@query("lineage_resolve", f"""SELECT d.o_custkey AS dataset_id, CASE WHEN trim(coalesce(s.pipeline_id, '')) = '' THEN sha256(CAST(d.o_custkey AS VARCHAR)) ELSE s.pipeline_id END AS pipeline_id,
  CASE WHEN s.tracking_uri <> 'uri-a' OR (s.experiment_name <> '' AND s.experiment_name <> 'MACHINERY') THEN '' ELSE coalesce(s.parent_run_id, '') END AS parent_run_id, coalesce(s.prompt_hash, '') AS prompt_hash, coalesce(s.tracking_uri, '') AS data_prep_tracking_uri
  FROM (SELECT DISTINCT o_custkey FROM orders) d LEFT JOIN ({SIDECARS.format(customer='customer')}) s ON s.dataset_id = d.o_custkey""")
def _(spark, sf):
    sidecars = spark.sql(SIDECARS.format(customer=f"parquet.`{sf}/customer.parquet`"))
    datasets = given(spark, sf, "orders").select(F.col("o_custkey").alias("dataset_id")).distinct()
    return lineage.lineage_resolve(datasets, sidecars, "uri-a", "MACHINERY").select("dataset_id", "pipeline_id", "parent_run_id", "prompt_hash", "data_prep_tracking_uri")


# --- monitoring ------------------------------------------------------------------


def results(spark, sf):
    rows = derived(spark, sf, "results")
    none = F.lit(None).cast("string")

    def action(kind, operation=none, issue=none):
        return F.struct(F.lit(kind).alias("type"), operation.alias("operation"), issue.alias("issue_key"))

    opened = F.array(action("jira", F.col("issue_operation"), F.col("issue_key")), action("github_copilot_remediation"))
    p = F.col("prediction")
    actions = F.when((p == "Error") & (F.col("issue_key") != ""), opened).when(p == "Error", F.array()).when(p == "Noise", F.array(action("ignore"))).when(p == "Other", F.array(action("none"))).otherwise(F.array(action("email")))
    error = F.struct(F.when(p == "Error", "jira").otherwise("email").alias("type"), F.col("error_text").alias("error"))
    return rows.select("event_id", "received_at", "prediction", actions.alias("actions"), F.when(F.col("error_text") != "", F.array(error)).otherwise(F.array()).alias("errors"))


DAY = "CAST(CAST(received_at AS DATE) AS VARCHAR)"
DAILY = f"""
WITH d AS (SELECT *, {DAY} AS day FROM results), items AS (
  SELECT day, 'total' AS metric, '' AS key FROM d
  UNION ALL SELECT day, CASE WHEN prediction = 'Other' THEN 'unknown_prediction' ELSE 'label' END, prediction FROM d
  UNION ALL SELECT day, 'action_status', CASE WHEN error_text = '' THEN 'ok' ELSE 'partial_failure' END FROM d
  UNION ALL SELECT day, 'action', CASE prediction WHEN 'Noise' THEN 'ignore' WHEN 'Other' THEN 'none' ELSE 'email' END FROM d WHERE prediction <> 'Error'
  UNION ALL SELECT day, 'action', unnest(['jira', 'github_copilot_remediation']) FROM d WHERE prediction = 'Error' AND issue_key <> ''
  UNION ALL SELECT day, CASE WHEN issue_key = '' THEN 'issue_failed' WHEN issue_operation = 'reused' THEN 'issue_reused' ELSE 'issue_created' END, '' FROM d WHERE prediction = 'Error'),
 fixed AS (SELECT unnest(['label', 'label', 'label', 'label', 'action_status', 'action_status', 'issue_created', 'issue_reused', 'issue_failed']) AS metric, unnest(['Error', 'CONFIGURATION', 'SYSTEM', 'Noise', 'ok', 'partial_failure', '', '', '']) AS key),
 counted AS (SELECT day, metric, key, count(*) AS n FROM items GROUP BY ALL UNION ALL SELECT day, metric, key, 0 FROM (SELECT DISTINCT day FROM d), fixed)
"""


@query("daily_monitoring", with_tables(f"{DAILY} SELECT day, metric, key, CAST(sum(n) AS BIGINT) AS n FROM counted GROUP BY ALL", "results"))
def _(spark, sf):
    return monitoring.daily_monitoring(results(spark, sf))


@query("day_bounds", with_tables(f"SELECT {DAY} AS day, strftime(min(received_at), '%Y-%m-%d %H:%M:%S') AS first_seen_at, strftime(max(received_at), '%Y-%m-%d %H:%M:%S') AS updated_at FROM results GROUP BY 1", "results"))
def _(spark, sf):
    days = monitoring.day_bounds(results(spark, sf))
    return days.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("first_seen_at", "updated_at")})


REASONS = f"SELECT {DAY} AS day, CASE WHEN error_text = '' THEN '{monitoring.NO_REASON}' ELSE error_text END AS reason, count(*) AS n FROM results WHERE prediction = 'Error' AND issue_key = '' GROUP BY ALL"


@query("failure_reasons", with_tables(REASONS, "results"))
def _(spark, sf):
    return monitoring.failure_reasons(results(spark, sf))


@query("top_reasons", with_tables(f"SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY day ORDER BY n DESC, reason) AS INT) AS rank FROM ({REASONS})) WHERE rank <= 6", "results"))
def _(spark, sf):
    return monitoring.top_reasons(monitoring.failure_reasons(results(spark, sf)))


@query("last_prediction", with_tables(f"""SELECT day, event_id, strftime(received_at, '%Y-%m-%d %H:%M:%S') AS received_at, prediction, CASE WHEN error_text = '' THEN 'ok' ELSE 'partial_failure' END AS action_status,
  prediction = 'Error' AND issue_key <> '' AND issue_operation <> 'reused' AS issue_created, prediction = 'Error' AND issue_key <> '' AND issue_operation = 'reused' AS issue_reused, error_text AS first_error
  FROM (SELECT *, {DAY} AS day, row_number() OVER (PARTITION BY {DAY} ORDER BY received_at DESC, event_id DESC) AS r FROM results) WHERE r = 1""", "results"))
def _(spark, sf):
    last = monitoring.last_prediction(results(spark, sf))
    first_error = F.coalesce(F.get("action_errors", F.lit(0))["error"], F.lit(""))
    return last.select("day", "event_id", F.date_format("received_at", "yyyy-MM-dd HH:mm:ss").alias("received_at"), "prediction", "action_status", "issue_created", "issue_reused", first_error.alias("first_error"))


@query("action_status", with_tables("""SELECT event_id, prediction, CASE WHEN error_text = '' THEN 'ok' ELSE 'partial_failure' END AS action_status, NOT (prediction = 'Error' AND issue_key = '') AS accepted,
  prediction = 'Error' AND issue_key <> '' AS issue_available, prediction = 'Error' AND issue_key <> '' AND issue_operation <> 'reused' AS issue_created, prediction = 'Error' AND issue_key <> '' AND issue_operation = 'reused' AS issue_reused FROM results""", "results"))
def _(spark, sf):
    return incidents.action_status(results(spark, sf))


@query("compact_errors", with_tables("SELECT event_id, CASE WHEN error_text = '' THEN 0 ELSE 4 END AS n, CASE WHEN error_text = '' THEN '' WHEN prediction = 'Error' THEN 'jira' ELSE 'email' END AS first_type FROM results", "results"))
def _(spark, sf):
    six = F.flatten(F.array_repeat("errors", 6))
    short = results(spark, sf).withColumn("short", incidents.compact_errors(six))
    return short.select("event_id", F.size("short").alias("n"), F.coalesce(F.get("short", F.lit(0))["type"], F.lit("")).alias("first_type"))


@query("request_metrics", with_tables("""WITH c AS (SELECT method, path, status, trim(prediction) AS prediction, greatest(duration, 0.0) AS duration FROM samples)
  SELECT 'requests_total' AS metric, method, path, status, NULL AS prediction, CAST(count(*) AS DOUBLE) AS value FROM c GROUP BY ALL
  UNION ALL SELECT 'duration_seconds_sum', method, path, NULL, NULL, round(sum(duration), 6) FROM c GROUP BY method, path
  UNION ALL SELECT 'duration_seconds_count', method, path, NULL, NULL, CAST(count(*) AS DOUBLE) FROM c GROUP BY method, path
  UNION ALL SELECT 'predictions_total', NULL, NULL, NULL, prediction, CAST(count(*) AS DOUBLE) FROM c WHERE prediction <> '' GROUP BY prediction""", "samples"))
def _(spark, sf):
    return rounded(monitoring.request_metrics(derived(spark, sf, "samples")))


@query("request_rate", with_tables("SELECT strftime(time_bucket(INTERVAL 5 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS window_start, method, path, status, count(*) AS requests, round(count(*) / 300.0, 6) AS rate FROM samples GROUP BY ALL", "samples"))
def _(spark, sf):
    return rounded(monitoring.request_rate(derived(spark, sf, "samples"))).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query("average_latency", with_tables("SELECT strftime(time_bucket(INTERVAL 5 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS window_start, method, path, count(*) AS requests, round(sum(greatest(duration, 0.0)) / count(*), 6) AS avg_latency FROM samples GROUP BY window_start, method, path", "samples"))
def _(spark, sf):
    return rounded(monitoring.average_latency(derived(spark, sf, "samples"))).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


AT = "strftime(make_timestamp(CAST(s.due * 60000000 AS BIGINT)), '%Y-%m-%d %H:%M:%S')"
MINUTES = "unnest(range(CAST(floor(epoch(ts) / 60) AS BIGINT) + 1, CAST(floor(epoch(ts) / 60) AS BIGINT) + 6))"


def shown_at(df):
    return rounded(df).withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss"))


@query("trailing_request_rate", with_tables(f"""WITH steps AS (SELECT DISTINCT method, path, status, {MINUTES} AS due FROM samples)
  SELECT {AT} AS "at", s.method, s.path, s.status, count(*) AS requests, round(count(*) / 300.0, 6) AS rate FROM steps s JOIN samples r ON r.method = s.method AND r.path = s.path AND r.status = s.status
    AND epoch(r.ts) < s.due * 60 AND epoch(r.ts) >= s.due * 60 - 300 GROUP BY s.due, s.method, s.path, s.status""", "samples"))
def _(spark, sf):
    return shown_at(monitoring.trailing_request_rate(derived(spark, sf, "samples"), step_seconds=60))


@query("trailing_latency", with_tables(f"""WITH steps AS (SELECT DISTINCT method, path, {MINUTES} AS due FROM samples)
  SELECT {AT} AS "at", s.method, s.path, count(*) AS requests, round(sum(greatest(duration, 0.0)) / count(*), 6) AS avg_latency FROM steps s JOIN samples r ON r.method = s.method AND r.path = s.path
    AND epoch(r.ts) < s.due * 60 AND epoch(r.ts) >= s.due * 60 - 300 GROUP BY s.due, s.method, s.path""", "samples"))
def _(spark, sf):
    return shown_at(monitoring.trailing_latency(derived(spark, sf, "samples"), step_seconds=60))


# Readings of a counter per event type that is set back now and then.
COUNTERS = "SELECT {ts} AS ts, event_type AS path, (row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) * 7) % 300 AS value FROM messages"


@query("counter_rate", with_tables(f"""WITH c AS ({COUNTERS.format(ts='ts')}), i AS (SELECT *, lag(value) OVER (PARTITION BY path ORDER BY ts, value) AS before FROM c),
  g AS (SELECT ts, path, CASE WHEN before IS NULL THEN 0 WHEN value >= before THEN value - before ELSE value END AS increase FROM i), steps AS (SELECT DISTINCT path, {MINUTES} AS due FROM g)
  SELECT {AT} AS "at", s.path, CAST(sum(increase) AS BIGINT) AS increase, round(sum(increase) / 300.0, 6) AS rate FROM steps s JOIN g ON g.path = s.path AND epoch(g.ts) < s.due * 60 AND epoch(g.ts) >= s.due * 60 - 300 GROUP BY s.due, s.path""", "messages"))
def _(spark, sf):
    derived(spark, sf, "messages").createOrReplaceTempView("messages")
    counters = spark.sql(COUNTERS.format(ts="CAST(ts AS TIMESTAMP)"))
    return shown_at(monitoring.counter_rate(counters, ["path"], step_seconds=60))
