"""Tables that the registered queries derive from the given ones.

Each is one SQL text that Spark and DuckDB both read; the few functions that
differ are filled in per engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logloom.operators.skew import spread_rows

SPARK = {
    "k": "CAST(get_json_object(props, '$.k') AS BIGINT)",
    "epoch": "CAST(unix_timestamp(CAST(ts AS TIMESTAMP)) AS STRING)",
    "days": "CAST(o_orderdate AS TIMESTAMP) + make_dt_interval(8222, 0, 0, o_orderkey)",
    "ts": "CAST(ts AS TIMESTAMP)",
}
DUCK = {
    "k": "CAST(json_extract_string(props, '$.k') AS BIGINT)",
    "epoch": "CAST(CAST(epoch(ts) AS BIGINT) AS STRING)",
    "days": "o_orderdate + to_days(8222) + to_seconds(o_orderkey)",
    "ts": "ts",
}
# DuckDB's epoch rounds; both sides cut to whole seconds first.
DUCK["epoch"] = "CAST(CAST(floor(epoch(ts)) AS BIGINT) AS STRING)"

MESSAGES = """
SELECT event_id, ts, user_id, event_type, value, k,
  CASE WHEN event_type IN ('view', 'click') THEN
      'GET /items/' || user_id || ' status 200 ' || CAST(floor(value) AS BIGINT) || 'ms user=' || user_id || ' ip=10.0.' || k || '.1'
    WHEN event_type = 'error' THEN
      'TypeError: bad value at app/mod' || k || '.php:' || user_id || ' on ' || CAST(CAST(ts AS DATE) AS STRING)
    WHEN event_type = 'purchase' THEN
      'queue worker instance ' || user_id || ' exceeded memory limit, host 10.1.0.' || k || ':3306'
    ELSE 'missing required environment variable KEY_' || k || ', ts=' || {epoch} END AS message,
  CASE WHEN event_type IN ('view', 'click') THEN 'Noise' WHEN event_type = 'error' THEN 'Error'
    WHEN event_type = 'purchase' THEN 'SYSTEM' ELSE 'CONFIGURATION' END AS label
FROM (SELECT *, {k} AS k FROM {events})
"""

# Predictions to judge: mostly the true label, with misses, an unseen label and blanks.
JUDGED = """
SELECT event_id AS line_number, message, label AS true_label,
  CASE WHEN value < 0.2 THEN '' WHEN value < 0.6 THEN 'Other' WHEN k < 6 THEN 'Noise' WHEN k > 97 THEN 'SYSTEM' ELSE label END AS predicted_label
FROM ({messages})
"""

ERRORS = """
SELECT event_id, ts, {ts} AS received_at, message, branch,
  '{{"message":"' || message || '","received_at":"' || CAST(CAST(ts AS DATE) AS STRING) || 'T00:00:00Z",' ||
  CASE WHEN value > 40 THEN '"metadata":{{"branch":"refs/heads/' || branch || '","commitSha":"' || sha1(CAST(user_id AS STRING)) ||
      '","previousSha":"' || sha1(CAST(user_id - 12 AS STRING)) || '"}}}}'
    ELSE '"branch":"origin/' || branch || '"}}' END AS payload
FROM (
  SELECT event_id, ts, user_id, value, k,
    CASE WHEN value < 10 THEN 'F' WHEN value < 30 THEN 'O' WHEN value < 60 THEN 'P' ELSE 'release' END AS branch,
    CASE WHEN k < 40 THEN 'TypeError: bad value at app/mod' || k || '.php:' || user_id
      WHEN k < 80 THEN 'QueueTimeout: worker stuck, see src/part' || k || '.py line ' || user_id
      ELSE 'Strange failure seen in zone ' || k END AS message
  FROM (SELECT *, {k} AS k FROM {events}) WHERE event_type = 'error')
"""

COMMITS = """
SELECT 'acme/shop' AS repo, o_orderstatus AS branch, sha1(CAST(o_orderkey AS STRING)) AS sha,
  CASE WHEN o_orderpriority = '1-URGENT' THEN '' ELSE sha1(CAST(o_custkey AS STRING)) END AS parent_sha,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'Fix TypeError for bad value in mod' || CAST(floor(o_totalprice / 10000) AS BIGINT) || '.php'
    WHEN o_orderpriority = '2-HIGH' THEN 'Check value of part' || CAST(floor(o_totalprice / 10000) AS BIGINT) || '.py'
    WHEN o_orderpriority = '3-MEDIUM' THEN 'Guard TypeError'
    ELSE 'Notes for customer ' || o_custkey END AS message,
  'Customer ' || o_custkey AS author_name, {days} AS committed_at
FROM {orders}
"""

FILES = """
SELECT 'acme/shop' AS repo, sha1(CAST(l_orderkey AS STRING)) AS sha, filename, CAST(min(l_linenumber) AS BIGINT) AS position,
  max('@@ -1 +1 @@' || chr(10) || '-old ' || p_type || chr(10) || '+new ' || p_name ||
    CASE WHEN l_tax > 0.075 THEN chr(10) || '+  raise TypeError here' WHEN l_tax > 0.055 THEN chr(10) || '+  retry QueueTimeout' ELSE '' END) AS patch
FROM (
  SELECT l_orderkey, l_linenumber, l_tax, p_type, p_name,
    CASE WHEN l_returnflag = 'R' THEN 'app/mod' || CAST(l_quantity AS BIGINT) || '.php'
      WHEN l_returnflag = 'A' THEN 'src/part' || CAST(l_quantity AS BIGINT) || '.py'
      ELSE 'docs/' || replace(p_name, ' ', '_') || '.md' END AS filename
  FROM {lineitem} JOIN {part} ON l_partkey = p_partkey)
GROUP BY l_orderkey, filename
"""

# Issues named after customers, some of which bear the summary of an error message.
ISSUES = """
SELECT 'OPS-' || c_custkey AS issue_key, c_mktsegment AS status, c_acctbal AS updated,
  CASE WHEN c_acctbal > 5000 THEN '  INCIDENT:  Strange  failure seen in zone ' || c_nationkey || c_nationkey ELSE 'Incident: call ' || c_name END AS summary
FROM {customer}
"""

REFS = """
SELECT CASE WHEN p_size < 10 THEN 'pull_request' ELSE 'issue' END AS kind, p_partkey AS number, p_brand AS state,
  'https://host/' || p_partkey AS html_url, p_name AS title, 'Repair of OPS-' || p_size || ' and OPS-' || (p_size + 40) || ': ' || p_name AS text
FROM {part}
"""

# Results of triage, some with errors and some without their incident.
RESULTS = """
SELECT event_id, {ts} AS received_at, label AS prediction0,
  CASE WHEN value < 0.5 THEN 'Other' ELSE label END AS prediction, value, k,
  CASE WHEN k < 5 THEN 'Connection lost to host ' || k WHEN k < 10 THEN 'Quota of key ' || (k - 5) || ' used up' ELSE '' END AS error_text,
  CASE WHEN k < 10 THEN '' ELSE 'OPS-' || k END AS issue_key, CASE WHEN k < 50 THEN 'reused' ELSE 'created' END AS issue_operation
FROM ({messages})
"""

SAMPLES = """
SELECT {ts} AS ts, 'GET' AS method, '/' || event_type AS path, CASE WHEN k < 90 THEN '200' ELSE '500' END AS status,
  (value - 5) / 1000 AS duration, CASE WHEN k < 20 THEN ' ' ELSE label END AS prediction
FROM ({messages})
"""

# Texts said under one role, as versions of it in time.
VERSIONS = """
SELECT role AS name, text, TIMESTAMP '2024-01-01 00:00:00' + {hours} AS created_at FROM {conversations}
"""
SPARK["hours"] = "make_dt_interval(0, CAST(conv_id AS INT), CAST(turn AS INT), 0)"
DUCK["hours"] = "to_hours(conv_id) + to_minutes(turn)"

DERIVED = {
    "messages": MESSAGES, "judged": JUDGED, "errors": ERRORS, "commits": COMMITS, "files": FILES, "issues": ISSUES,
    "refs": REFS, "results": RESULTS, "samples": SAMPLES, "versions": VERSIONS,
}
BASE = ("events", "documents", "labels", "orders", "lineitem", "part", "customer", "conversations", "benchmark", "pages", "supplier", "nation")


def _text(name: str, parts: dict[str, str]) -> str:
    names = {"messages": MESSAGES.format(**parts) if name != "messages" else ""}
    return DERIVED[name].format(**parts, **names)


def duck(name: str) -> str:
    """The derived table as a DuckDB sub-select."""
    return _text(name, {**DUCK, **{t: t for t in BASE}}).strip()


def given(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table for work that is heavy per row."""
    table = derived(spark, folder, name) if name in DERIVED else given(spark, folder, name)
    return spread_rows(table.select(*columns) if columns else table)


def derived(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.sql(_text(name, {**SPARK, **{t: f"parquet.`{folder}/{t}.parquet`" for t in BASE}}))


def with_tables(body: str, *names: str) -> str:
    """SQL text with the derived tables in front."""
    tables = ",\n".join(f"{n} AS ({duck(n)})" for n in names)
    body = body.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {tables},\n{body[5:]}" if names else body
    return f"WITH {tables}\n{body}" if names else body
