"""Scalar functions and columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from logloom import domain
from logloom.functions import columns, labels, payload, text
from logloom.plans import duck
from logloom.plans.registry import query
from logloom.plans.tables import derived, given, spread, with_tables


@query("resolve_text_column", "SELECT doc_id, text AS message FROM documents")
def _(spark, sf):
    return columns.with_text_column(given(spark, sf, "documents")).select("doc_id", "message")


@query("resolve_column", with_tables("SELECT message, label AS class FROM messages", "messages"))
def _(spark, sf):
    table = derived(spark, sf, "messages").withColumnsRenamed({"message": "Log_Message", "label": " LABEL "})
    return columns.with_standard_columns(table)


MESSY = "CASE WHEN k < 30 THEN '  ' || upper(label) || chr(9) WHEN k < 60 THEN lower(label) WHEN k < 70 THEN 'other' || label ELSE label END"


@query("normalize_label", with_tables(f"SELECT event_id, {duck.normalize_label('raw')} AS strict_label, {duck.normalize_label('raw', False)} AS kept_label FROM (SELECT event_id, {MESSY} AS raw FROM messages)", "messages"))
def _(spark, sf):
    raw = derived(spark, sf, "messages").selectExpr("event_id", f"{MESSY} AS raw")
    return raw.select("event_id", labels.normalize_label("raw").alias("strict_label"), labels.normalize_label("raw", strict=False).alias("kept_label"))


PAYLOAD = """CASE WHEN k < 20 THEN props WHEN k < 40 THEN message WHEN k < 60 THEN '{"errorMessage":"","message":"' || message || '","log":"x"}'
 WHEN k < 80 THEN '{"msg":"' || message || '","LogMessage":"first ' || k || '"}' ELSE '{"user":"' || user_id || '","note":"' || message || '"}' END"""


@query("extract_message", with_tables(f"""SELECT event_id, CASE WHEN k BETWEEN 20 AND 39 THEN raw
  ELSE coalesce({duck.first_key('raw', domain.MESSAGE_KEYS)}, nullif(json_extract_string(raw, '$.k'), ''), json_extract_string(raw, '$.user')) END AS message
  FROM (SELECT event_id, k, {PAYLOAD} AS raw FROM (SELECT m.*, e.props FROM messages m JOIN events e USING (event_id)))""", "messages"))
def _(spark, sf):
    both = derived(spark, sf, "messages").join(given(spark, sf, "events").select("event_id", "props"), "event_id")
    return both.selectExpr("event_id", f"{PAYLOAD} AS raw").select("event_id", payload.extract_message("raw").alias("message"))


@query("normalize_payload", with_tables("""SELECT event_id, CASE WHEN k < 50 THEN left(props, length(props) - 1) || ',"received_at":"' || stamp || '"}'
  ELSE '{"message":"' || message || '","received_at":"' || stamp || '"}' END AS payload
  FROM (SELECT m.event_id, m.k, m.message, e.props, strftime(m.ts, '%Y-%m-%dT%H:%M:%S') AS stamp FROM messages m JOIN events e USING (event_id))""", "messages"))
def _(spark, sf):
    both = derived(spark, sf, "messages").join(given(spark, sf, "events").select("event_id", "props"), "event_id")
    raw = F.when(F.col("k") < 50, F.col("props")).otherwise(F.col("message"))
    return both.select("event_id", payload.normalize_payload(raw, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("payload"))


@query("template_group", f"SELECT doc_id, {duck.template_group('text')} AS template_group FROM documents")
def _(spark, sf):
    return spread(spark, sf, "documents", "doc_id", "text").select("doc_id", text.template_group("text").alias("template_group"))


@query("template_group_of_logs", with_tables(f"SELECT event_id, {duck.template_group('message')} AS template_group FROM messages", "messages"))
def _(spark, sf):
    return spread(spark, sf, "messages", "event_id", "message").select("event_id", text.template_group("message").alias("template_group"))


@query("text_cuts", f"""SELECT doc_id, {duck.truncate('text')} AS truncated, {duck.summary('text')} AS summary, {duck.fold(duck.collapse('text'))} AS match_key,
  CASE WHEN length(text) <= 200 THEN text ELSE left(text, 200) || '...<truncated>' END AS cell FROM documents""")
def _(spark, sf):
    return given(spark, sf, "documents").select(
        "doc_id", text.truncate_text("text").alias("truncated"), text.summary_text("text").alias("summary"),
        text.match_text("text").alias("match_key"), text.sanitize_cell("text").alias("cell"),
    )


@query("text_sha256", "SELECT doc_id, sha256(text) AS text_hash FROM documents")
def _(spark, sf):
    return given(spark, sf, "documents").select("doc_id", text.text_sha256("text").alias("text_hash"))


@query("nested_value", with_tables(f"""SELECT event_id, {duck.near_value('payload', domain.BRANCH_KEYS)} AS branch, {duck.near_value('payload', domain.COMMIT_SHA_KEYS)} AS sha,
  json_extract_string(payload, '$.message') AS deep FROM errors""", "errors"))
def _(spark, sf):
    rows = spread(spark, sf, "errors", "event_id", "message", "payload")
    # The third column hides the payload two levels down under another spelling of the key.
    hidden = F.concat(F.lit('{"outer":[{"in":{"Log-Text":'), F.to_json(F.struct("message")).substr(F.lit(12), F.length("message") + 2), F.lit("}}]}"))
    return rows.select(
        "event_id", payload.nested_value("payload", domain.BRANCH_KEYS).alias("branch"),
        payload.nested_value("payload", domain.COMMIT_SHA_KEYS).alias("sha"), payload.nested_value(hidden, ["log_text"]).alias("deep"),
    )


@query("commit_and_branch", with_tables(f"""SELECT event_id, {duck.commit_sha('payload')} AS sha, {duck.branch("'refs/heads/' || branch")} AS full_branch, {duck.branch("' origin/' || branch || ' '")} AS short_branch,
  strftime(CAST(CAST(ts AS DATE) AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS parsed, CAST(CAST(ts AS DATE) - 14 AS VARCHAR) AS since FROM errors""", "errors"))
def _(spark, sf):
    rows = derived(spark, sf, "errors")
    stamp = text.parse_utc(F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit("T02:00:00+02:00")))
    return rows.select(
        "event_id", text.commit_sha("payload").alias("sha"), text.clean_branch(F.concat(F.lit("refs/heads/"), "branch")).alias("full_branch"),
        text.clean_branch(F.concat(F.lit(" origin/"), "branch", F.lit(" "))).alias("short_branch"),
        F.date_format(stamp, "yyyy-MM-dd HH:mm:ss").alias("parsed"), text.lookback_date(stamp).cast("string").alias("since"),
    )


@query("evidence_terms", with_tables(f"SELECT event_id, array_to_string({duck.terms('message', 'payload')}, '|') AS terms FROM errors", "errors"))
def _(spark, sf):
    return derived(spark, sf, "errors").select("event_id", F.array_join(text.evidence_terms("message", "payload"), "|").alias("terms"))


@query("source_paths", with_tables(f"SELECT event_id, array_to_string({duck.paths('message', 'payload')}, '|') AS paths FROM errors", "errors"))
def _(spark, sf):
    return derived(spark, sf, "errors").select("event_id", F.array_join(text.source_paths("message", "payload"), "|").alias("paths"))


ANSWER = """CASE WHEN k < 10 THEN label WHEN k < 20 THEN ' **' || lower(label) || '**. ' WHEN k < 30 THEN 'Predicted class: ' || label WHEN k < 40 THEN 'I think it was classified as ' || upper(label) || ' by the model'
 WHEN k < 50 THEN 'maybe ' || label || '?' WHEN k < 60 THEN 'no idea at all' WHEN k < 70 THEN 'the ' || label || ' category' ELSE 'answer is ' || label END"""


@query("prediction_label_of_text", with_tables("""SELECT event_id, CASE WHEN k BETWEEN 50 AND 59 THEN 'no idea at all' ELSE label END AS prediction FROM messages""", "messages"))
def _(spark, sf):
    raw = derived(spark, sf, "messages").selectExpr("event_id", f"{ANSWER} AS raw")
    return raw.select("event_id", payload.text_prediction_label("raw").alias("prediction"))


WRAPPED = """CASE WHEN k < 25 THEN '{"predictions": [{"label": "' || label || '"}]}' WHEN k < 50 THEN '{"result": {"output": "Predicted class: ' || label || '"}}'
 WHEN k < 75 THEN '[{"errorMessage": "SYSTEM down", "class": "' || lower(label) || '"}]' WHEN k < 85 THEN '{"errorMessage": "System.NullReferenceException"}' ELSE label END"""


@query("prediction_label_of_json", with_tables("SELECT event_id, CASE WHEN k BETWEEN 75 AND 84 THEN '' ELSE label END AS prediction FROM messages", "messages"))
def _(spark, sf):
    raw = derived(spark, sf, "messages").selectExpr("event_id", f"{WRAPPED} AS raw")
    return raw.select("event_id", payload.prediction_label("raw").alias("prediction"))


@query("redact_map", with_tables("""SELECT event_id, '<redacted>' AS api_token, '<redacted>' AS code, message, CAST(user_id AS VARCHAR) AS user_id FROM messages""", "messages"))
def _(spark, sf):
    rows = derived(spark, sf, "messages")
    flat = F.create_map(F.lit("api_token"), F.lit("t"), F.lit("code"), F.col("label"), F.lit("message"), F.col("message"), F.lit("user"), F.col("user_id").cast("string"))
    masked = rows.select("event_id", payload.redact_map(flat).alias("m"))
    return masked.select("event_id", F.col("m")["api_token"].alias("api_token"), F.col("m")["code"].alias("code"), F.col("m")["message"].alias("message"), F.col("m")["user"].alias("user_id"))


@query("redact_nested", with_tables("""SELECT event_id, '{"context": {"Password": "<redacted>", "k": ' || k || '}, "message": "' || message || '"}' AS shown FROM messages""", "messages"))
def _(spark, sf):
    raw = derived(spark, sf, "messages").selectExpr("event_id", """'{"context":{"Password":"p","k":' || k || '},"message":"' || message || '"}' AS raw""")
    return raw.select("event_id", payload.redact("raw").alias("shown"))


@query("split_tokens", "SELECT p_partkey, array_to_string(list_distinct_in_order, ',') AS tokens FROM (SELECT p_partkey, " + duck.ordered_distinct("list_filter(list_transform(string_split(raw, ','), lambda x: trim(regexp_replace(trim(x), '[^A-Za-z0-9_.\\-]+', '-', 'g'), '-')), lambda x: x <> '')") + " AS list_distinct_in_order FROM (SELECT p_partkey, p_brand || ', ' || p_name || ',,' || p_type || ',' || p_name AS raw FROM part))")
def _(spark, sf):
    raw = given(spark, sf, "part").selectExpr("p_partkey", "p_brand || ', ' || p_name || ',,' || p_type || ',' || p_name AS raw")
    return raw.select("p_partkey", F.array_join(text.split_tokens("raw"), ",").alias("tokens"))


@query("split_numbers", "SELECT p_partkey, CASE WHEN p_size = 7 THEN 1 ELSE 2 END AS n, CAST(p_size AS DOUBLE) AS first_number FROM part")
def _(spark, sf):
    numbers = text.split_numbers(F.concat("p_size", F.lit(" , 7,,"), "p_size"))
    return given(spark, sf, "part").withColumn("x", numbers).select("p_partkey", F.size("x").alias("n"), F.get("x", F.lit(0)).alias("first_number"))


@query("batch_date", """SELECT event_id, CAST(CAST(l AS DATE) + CASE WHEN CAST(l AS TIME) <= TIME '09:30:00' THEN 0 ELSE 1 END AS VARCHAR) AS batch_date, CAST(CAST(ts AS DATE) AS VARCHAR) AS monitoring_day
  FROM (SELECT event_id, ts, timezone('America/New_York', timezone('UTC', ts)) AS l FROM events)""")
def _(spark, sf):
    rows = given(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.select(
        "event_id", text.batch_date("ts", "09:30", "America/New_York").cast("string").alias("batch_date"),
        text.monitoring_day(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ssXXX")).alias("monitoring_day"),
    )


@query("rule_label", with_tables(f"SELECT event_id, {duck.rule_label('message')} AS prediction FROM messages", "messages"))
def _(spark, sf):
    return spread(spark, sf, "messages", "event_id", "message").select("event_id", labels.rule_label("message").alias("prediction"))


@query("rule_label_of_documents", f"SELECT doc_id, {duck.rule_label('text')} AS prediction FROM documents")
def _(spark, sf):
    return spread(spark, sf, "documents", "doc_id", "text").select("doc_id", labels.rule_label("text").alias("prediction"))


@query("merge_unique", f"SELECT p_partkey, array_to_string({duck.ordered_distinct('l || r', 3)}, ' ') AS merged FROM (SELECT p_partkey, string_split(p_name, ' ') AS l, [p_type, p_name, p_brand, p_type] AS r FROM part)")
def _(spark, sf):
    rows = given(spark, sf, "part")
    return rows.select("p_partkey", F.array_join(text.merge_unique(F.split("p_name", " "), F.array("p_type", "p_name", "p_brand", "p_type"), 3), " ").alias("merged"))
