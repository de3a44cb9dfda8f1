"""Data sets, metrics, gates, splits, training and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from logloom import domain
from logloom.functions.labels import rule_label
from logloom.functions.text import template_group
from logloom.operators import dataset, quality, scoring, splits, training
from logloom.plans import duck
from logloom.plans.registry import query
from logloom.plans.tables import derived, given, spread, with_tables

LABELLED = "SELECT event_id, CASE WHEN k = 3 THEN NULL ELSE message END AS message, CASE WHEN k < 30 THEN upper(label) WHEN k > 95 THEN 'unknown' ELSE label END AS class FROM messages"


def labelled(spark, sf):
    rows = derived(spark, sf, "messages")
    return rows.selectExpr(
        "event_id", "CASE WHEN k = 3 THEN NULL ELSE message END AS message",
        "CASE WHEN k < 30 THEN upper(label) WHEN k > 95 THEN 'unknown' ELSE label END AS class",
    )


VALID = f"SELECT event_id, message, {duck.normalize_label('class')} AS class FROM ({LABELLED}) WHERE message IS NOT NULL AND {duck.normalize_label('class')} <> ''"


@query("valid_labeled", with_tables(f"SELECT *, list_position(['Error', 'CONFIGURATION', 'SYSTEM', 'Noise'], class) - 1 AS label FROM ({VALID})", "messages"))
def _(spark, sf):
    return dataset.valid_labeled(labelled(spark, sf))


@query("valid_feedback_base", with_tables(VALID, "messages"))
def _(spark, sf):
    return dataset.valid_feedback_base(labelled(spark, sf))


@query("label_distribution", with_tables(f"SELECT l.label, count(v.class) AS n FROM (SELECT unnest(['Error', 'CONFIGURATION', 'SYSTEM', 'Noise', 'Unseen']) AS label) l LEFT JOIN ({VALID}) v ON v.class = l.label GROUP BY 1", "messages"))
def _(spark, sf):
    # One label more than the data has, so that a zero shows.
    return dataset.label_distribution(dataset.valid_feedback_base(labelled(spark, sf)), labels=(*domain.LABELS, "Unseen"))


@query("group_distribution", with_tables(f"SELECT {duck.template_group('message')} AS template_group, count(*) AS n FROM messages GROUP BY 1", "messages"))
def _(spark, sf):
    return dataset.group_distribution(spread(spark, sf, "messages", "message"))


@query("group_distribution_of_documents", f"SELECT {duck.template_group('text')} AS template_group, count(*) AS n FROM documents GROUP BY 1")
def _(spark, sf):
    return dataset.group_distribution(spread(spark, sf, "documents", "text"), "text")


@query("dataset_profile", with_tables(f"""WITH v AS ({VALID}) SELECT 'row_count' AS item, '' AS key, count(*) AS n FROM v UNION ALL SELECT 'label', class, count(*) FROM v GROUP BY class
  UNION ALL SELECT 'column', unnest(['event_id', 'message', 'class']), unnest([0, 1, 2])""", "messages"))
def _(spark, sf):
    return dataset.dataset_profile(dataset.valid_feedback_base(labelled(spark, sf)))


def fingerprint_sql(columns: list[str], source: str) -> str:
    parts = ", ".join(f"coalesce(CAST({c} AS VARCHAR), chr(0))" for c in columns)
    number = "CAST(('0x' || substr(d, {}, 15))::BIGINT AS HUGEINT)"
    return f"""SELECT sha256('{",".join(columns)}|' || count(*) || '|' || CAST(sum({number.format(1)}) AS VARCHAR) || '|' || CAST(sum({number.format(17)}) AS VARCHAR)) AS data_version_id, count(*) AS row_count
  FROM (SELECT md5(concat_ws(chr(31), {parts})) AS d FROM {source})"""


@query("dataset_fingerprint", with_tables(fingerprint_sql(["message", "class"], f"({VALID})"), "messages"))
def _(spark, sf):
    return dataset.dataset_fingerprint(dataset.valid_feedback_base(labelled(spark, sf)), ["message", "class"])


@query("dataset_fingerprint_of_documents", fingerprint_sql(["doc_id", "text", "lang"], "documents"))
def _(spark, sf):
    return dataset.dataset_fingerprint(given(spark, sf, "documents"), ["doc_id", "text", "lang"])


@query("preview", "SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE left(text, 200) || '...<truncated>' END AS text, lang, source, n_chars FROM documents ORDER BY doc_id LIMIT 100")
def _(spark, sf):
    return dataset.preview(given(spark, sf, "documents"), ["doc_id"])


# --- metrics ---------------------------------------------------------------

COUNTS = f"SELECT {duck.strip('true_label')} AS true_label, {duck.strip('predicted_label')} AS predicted_label, count(*) AS n FROM judged GROUP BY 1, 2"
BASE_LABELS = "SELECT unnest(['Error', 'CONFIGURATION', 'SYSTEM', 'Noise']) AS label, unnest([0, 1, 2, 3]) AS place"
PER_CLASS = f"""
sides AS (SELECT true_label AS label, n AS support, 0 AS predicted, CASE WHEN true_label = predicted_label THEN n ELSE 0 END AS hits, true AS present FROM counts
  UNION ALL SELECT predicted_label, 0, n, 0, true FROM counts UNION ALL SELECT label, 0, 0, 0, false FROM ({BASE_LABELS})),
sums AS (SELECT label, sum(support) AS support, sum(predicted) AS predicted, sum(hits) AS hits, bool_or(present) AS present FROM sides GROUP BY label),
per_class AS (SELECT label, CASE WHEN predicted = 0 THEN 0.0 ELSE CAST(hits AS DOUBLE) / predicted END AS "precision", CASE WHEN support = 0 THEN 0.0 ELSE CAST(hits AS DOUBLE) / support END AS recall,
  CASE WHEN predicted + support = 0 THEN 0.0 ELSE CAST(2 * hits AS DOUBLE) / (predicted + support) END AS f1, CAST(support AS BIGINT) AS support, CAST(hits AS BIGINT) AS hits, present FROM sums),
summary AS (SELECT CAST(sum(hits) AS DOUBLE) / sum(support) AS accuracy, avg("precision") AS macro_precision, avg(recall) AS macro_recall, avg(f1) AS macro_f1,
  sum("precision" * support) / sum(support) AS weighted_precision, sum(recall * support) / sum(support) AS weighted_recall, sum(f1 * support) / sum(support) AS weighted_f1,
  CAST(sum(support) AS BIGINT) AS sample_count FROM per_class WHERE present)"""
METRICS_SQL = f"WITH counts AS ({COUNTS}),{PER_CLASS}"


def counts_of(spark, sf):
    return quality.confusion_counts(derived(spark, sf, "judged"))


def rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("score_join", with_tables("SELECT line_number, message, true_label, predicted_label, true_label = predicted_label AS match FROM judged", "judged"))
def _(spark, sf):
    rows = derived(spark, sf, "judged")
    return quality.score_join(rows.selectExpr("line_number", "message", "true_label AS label"), rows.selectExpr("line_number", "concat(predicted_label, ' ') AS predicted_label"))


@query("confusion_counts", with_tables(COUNTS, "judged"))
def _(spark, sf):
    return counts_of(spark, sf)


@query("confusion_matrix", with_tables(f"""WITH counts AS ({COUNTS}),
  places AS (SELECT label, min(place) AS place FROM (SELECT label, place FROM ({BASE_LABELS}) UNION ALL SELECT true_label, 100 FROM counts UNION ALL SELECT predicted_label, 200 FROM counts) WHERE label <> '' GROUP BY label),
  ordered AS (SELECT label, row_number() OVER (ORDER BY place, label) - 1 AS i FROM places)
  SELECT t.i AS true_index, t.label AS true_label, p.i AS predicted_index, p.label AS predicted_label, coalesce(c.n, 0) AS n
  FROM ordered t CROSS JOIN ordered p LEFT JOIN counts c ON c.true_label = t.label AND c.predicted_label = p.label""", "judged"))
def _(spark, sf):
    return quality.confusion_matrix(counts_of(spark, sf))


@query("per_class_metrics", with_tables(f'{METRICS_SQL} SELECT label, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1, support, hits, present FROM per_class', "judged"))
def _(spark, sf):
    return rounded(quality.per_class_metrics(counts_of(spark, sf)))


NAMES = ("accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_precision", "weighted_recall", "weighted_f1")


@query("summary_metrics", with_tables(f"{METRICS_SQL} SELECT {', '.join(f'round({n}, 6) AS {n}' for n in NAMES)}, sample_count FROM summary", "judged"))
def _(spark, sf):
    return rounded(quality.summary_metrics(quality.per_class_metrics(counts_of(spark, sf))))


def threshold_values(levels: dict) -> str:
    rows = []
    for severity, level in enumerate(("warning", "critical"), start=1):
        if level in levels:
            rows += [f"('{level}', {severity}, {i}, '{m}', '', {levels[level]['min_' + m]})" for i, m in enumerate(quality.METRICS)]
            rows += [f"('{level}', {severity}, {3 + i}, 'recall', '{c}', {t})" for i, (c, t) in enumerate(levels[level]["min_recall_per_class"].items())]
    return "(VALUES " + ", ".join(rows) + ") AS t(level, severity, check_order, metric, class, threshold)"


def checks_sql(levels: dict, prefix: str) -> str:
    place = "CASE WHEN metric = 'recall' THEN '[' || class || ']' ELSE '' END"
    return f"""{METRICS_SQL},
  vals AS (SELECT 'accuracy' AS metric, '' AS class, accuracy AS value FROM summary UNION ALL SELECT 'weighted_f1', '', weighted_f1 FROM summary UNION ALL SELECT 'macro_f1', '', macro_f1 FROM summary
    UNION ALL SELECT 'recall', label, recall FROM per_class WHERE label <> ''),
  checks AS (SELECT t.*, coalesce(v.value, 0.0) AS value, coalesce(v.value, 0.0) < t.threshold AS failed,
    {prefix} || metric || {place} || ' ' || format('{{:.4f}}', coalesce(v.value, 0.0)) || ' < ' || {prefix} || CASE WHEN metric = 'recall' THEN 'min_recall_per_class' ELSE 'min_' || metric END || {place} || ' ' || format('{{:.4f}}', CAST(t.threshold AS DOUBLE)) AS reason
    FROM {threshold_values(levels)} LEFT JOIN vals v USING (metric, class))"""


GATE = {"critical": domain.GATE_POLICY}
DRIFT = domain.DRIFT_POLICY


@query("below_threshold", with_tables(f"{checks_sql(DRIFT, chr(39) * 2)} SELECT level, metric, class, round(value, 6) AS value, CAST(threshold AS DOUBLE) AS threshold FROM checks WHERE failed", "judged"))
def _(spark, sf):
    return rounded(quality.below_threshold(quality.per_class_metrics(counts_of(spark, sf)), quality.checked_drift_policy(DRIFT)))


@query("gate_verdict", with_tables(f"""{checks_sql(GATE, chr(39) * 2)} SELECT count(*) FILTER (WHERE failed) = 0 AS gate_pass, count(*) FILTER (WHERE failed) AS failed_count,
  coalesce(string_agg(reason, '; ' ORDER BY check_order) FILTER (WHERE failed), '') AS failed_checks FROM checks""", "judged"))
def _(spark, sf):
    verdict = quality.gate_verdict(quality.per_class_metrics(counts_of(spark, sf)))
    return verdict.withColumn("failed_checks", F.array_join("failed_checks", "; "))


@query("drift_status", with_tables(f"""{checks_sql(DRIFT, "level || '.'")} SELECT CASE max(CASE WHEN failed THEN severity ELSE 0 END) WHEN 2 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'ok' END AS status,
  coalesce(string_agg(reason, '; ' ORDER BY check_order) FILTER (WHERE failed AND level = 'warning'), '') AS warning_failures,
  coalesce(string_agg(reason, '; ' ORDER BY check_order) FILTER (WHERE failed AND level = 'critical'), '') AS critical_failures FROM checks""", "judged"))
def _(spark, sf):
    status = quality.drift_status(quality.per_class_metrics(counts_of(spark, sf)))
    return status.withColumns({c: F.array_join(c, "; ") for c in ("warning_failures", "critical_failures")})


HISTORY = "SELECT o_orderkey AS report_id, o_orderdate AS created_at, o_orderpriority <> '5-LOW' AS gate_pass, 'm' || o_orderstatus AS model_hash, 'g' || CAST(floor(o_totalprice / 100000) AS BIGINT) AS golden_set_hash, 'p' || o_orderpriority AS policy_hash, o_orderstatus AS branch FROM {orders}"


@query("gate_cache_lookup", f"""WITH history AS ({HISTORY.format(orders='orders')}), ranked AS (SELECT *, row_number() OVER (PARTITION BY branch ORDER BY created_at DESC, report_id DESC) AS r FROM history),
  hit AS (SELECT branch, model_hash, golden_set_hash, policy_hash, max_by(report_id, (created_at, report_id)) AS report_id FROM ranked WHERE r <= 200 AND gate_pass GROUP BY ALL)
  SELECT q.branch, q.model_hash, q.golden_set_hash, q.policy_hash, h.report_id IS NOT NULL AS cache_hit, h.report_id FROM (SELECT DISTINCT branch, model_hash, golden_set_hash, policy_hash FROM history) q
  LEFT JOIN hit h USING (branch, model_hash, golden_set_hash, policy_hash)""")
def _(spark, sf):
    history = spark.sql(HISTORY.format(orders=f"parquet.`{sf}/orders.parquet`"))
    asked = history.select("branch", "model_hash", "golden_set_hash", "policy_hash").distinct()
    return quality.gate_cache_lookup(asked, history, scope=["branch"])


FOLDS = "SELECT CAST(l_suppkey AS INT) AS trial_index, l_linenumber AS fold, 1 - l_discount AS macro_f1, 1 - l_tax AS weighted_f1 FROM {lineitem}"


@query("cv_average", f"SELECT trial_index, count(*) AS folds, round(avg(macro_f1), 6) AS macro_f1, round(avg(weighted_f1), 6) AS weighted_f1 FROM ({FOLDS.format(lineitem='lineitem')}) GROUP BY 1")
def _(spark, sf):
    return rounded(quality.cv_average(spark.sql(FOLDS.format(lineitem=f"parquet.`{sf}/lineitem.parquet`"))))


@query("select_trial", f"SELECT trial_index, macro_f1 FROM (SELECT trial_index, max(macro_f1) AS macro_f1 FROM ({FOLDS.format(lineitem='lineitem')}) GROUP BY 1) ORDER BY macro_f1 DESC, trial_index LIMIT 1")
def _(spark, sf):
    folds = spark.sql(FOLDS.format(lineitem=f"parquet.`{sf}/lineitem.parquet`"))
    return quality.select_trial(folds.groupBy("trial_index").agg(F.max("macro_f1").alias("macro_f1")))


# --- splits ------------------------------------------------------------------


def training_rows(spark, sf):
    return spread(spark, sf, "messages", "event_id", "message", "label").withColumnRenamed("label", "class")


@query("grouped_split")
def _(spark, sf):
    return splits.grouped_split(training_rows(spark, sf), 0.15).groupBy("split", "template_group", "class").count()


@query("grouped_split_leaks", "SELECT '' AS template_group, CAST(0 AS BIGINT) AS n WHERE false")
def _(spark, sf):
    return dataset.leakage_check(splits.grouped_split(training_rows(spark, sf), 0.15))


@query("grouped_split_coverage", with_tables(f"SELECT {duck.template_group('message')} AS template_group, count(*) AS n, CAST(1 AS BIGINT) AS sides FROM messages GROUP BY 1", "messages"))
def _(spark, sf):
    return splits.grouped_split(training_rows(spark, sf), 0.15).groupBy("template_group").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("split").alias("sides"))


@query("grouped_split_errors", with_tables("""SELECT coalesce(label, 'all rows') AS class, count(*) AS n, true AS within, CAST(1 AS BIGINT) AS splits FROM messages GROUP BY GROUPING SETS ((label), ())""", "messages"))
def _(spark, sf):
    """The held-out rows of each label, and of all, against the asked share: at most the largest group beside it."""
    out = splits.grouped_split(training_rows(spark, sf), 0.15)
    cells = out.groupBy("class", "template_group").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("split") == "heldout", 1).otherwise(0)).alias("held"), F.count_distinct("split").alias("splits"))
    whole = cells.groupingSets([["class"], []], "class").agg(
        F.sum("n").alias("rows"), F.sum(F.col("n") * F.col("held")).alias("held"), F.max("n").alias("largest"), F.max("splits").alias("splits"), F.grouping("class").alias("all"),
    )
    error = F.abs(F.col("held") - 0.15 * F.col("rows"))
    return whole.select(F.when(F.col("all") == 1, "all rows").otherwise(F.col("class")).alias("class"), F.col("rows").alias("n"), (error <= F.greatest("largest", 0.02 * F.col("rows"))).alias("within"), "splits")


@query("group_kfold_sizes", with_tables("SELECT CAST(f AS INT) AS fold, label AS class, true AS within FROM (SELECT DISTINCT label FROM messages), (SELECT unnest(range(5)) AS f)", "messages"))
def _(spark, sf):
    """The rows of each label in each fold against a fifth of them: at most the largest group beside it."""
    out = splits.group_kfold(training_rows(spark, sf), 5)
    cells = out.groupBy("fold", "class", "template_group").agg(F.count(F.lit(1)).alias("n"))
    largest = cells.groupBy("class").agg(F.max("n").alias("largest"), F.sum("n").alias("rows"))
    every = largest.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(4))))
    sizes = every.join(cells.groupBy("fold", "class").agg(F.sum("n").alias("n")), ["fold", "class"], "left").fillna(0, ["n"])
    return sizes.select("fold", "class", (F.abs(F.col("n") - F.col("rows") / 5) <= F.greatest("largest", 0.02 * F.col("rows"))).alias("within"))


@query("group_kfold_coverage", with_tables(f"SELECT {duck.template_group('message')} AS template_group, count(*) AS n, CAST(1 AS BIGINT) AS folds FROM messages GROUP BY 1", "messages"))
def _(spark, sf):
    return splits.group_kfold(training_rows(spark, sf), 5).groupBy("template_group").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("fold").alias("folds"))


STRATIFIED = f"SELECT event_id, label AS class, {duck.template_group('message')} AS template_group, CASE WHEN ('0x' || substr(md5('42|' || label || '|' || event_id), 1, 8))::BIGINT < {int(0.15 * 2**32)} THEN 'heldout' ELSE 'train' END AS split FROM messages"


@query("stratified_split", with_tables(f"SELECT event_id, split FROM ({STRATIFIED})", "messages"))
def _(spark, sf):
    return splits.stratified_split(training_rows(spark, sf), 0.15, keys=["event_id"]).select("event_id", "split")


@query("split_report", with_tables(f"""WITH s AS ({STRATIFIED}) SELECT split, 'rows' AS item, '' AS key, count(*) AS n FROM s GROUP BY split UNION ALL SELECT split, 'template_groups', '', count(DISTINCT template_group) FROM s GROUP BY split
  UNION ALL SELECT split, 'label', class, count(*) FROM s GROUP BY split, class""", "messages"))
def _(spark, sf):
    return dataset.split_report(splits.stratified_split(training_rows(spark, sf), 0.15, keys=["event_id"]))


@query("leakage_check", with_tables(f"SELECT template_group, count(*) AS n FROM ({STRATIFIED}) GROUP BY 1 HAVING count(DISTINCT split) > 1", "messages"))
def _(spark, sf):
    return dataset.leakage_check(splits.stratified_split(training_rows(spark, sf), 0.15, keys=["event_id"]))


# --- training and scoring ------------------------------------------------------

GRID_COLUMNS = {"reg_param": "l_discount", "max_iter": "l_linenumber", "elastic_net": "l_tax"}


@query("candidate_grid", """SELECT reg_param, max_iter, elastic_net FROM (SELECT DISTINCT l_discount AS reg_param FROM lineitem), (SELECT DISTINCT l_linenumber AS max_iter FROM lineitem), (SELECT DISTINCT l_tax AS elastic_net FROM lineitem)
  ORDER BY md5('42|' || reg_param || '|' || max_iter || '|' || elastic_net) LIMIT 20""")
def _(spark, sf):
    lists = given(spark, sf, "lineitem").agg(*[F.array_sort(F.collect_set(c)).alias(name) for name, c in GRID_COLUMNS.items()])
    return training.shuffled_grid(lists, list(GRID_COLUMNS), 20).drop("draw")


@query("train_classifier")
def _(spark, sf):
    rows = training_rows(spark, sf)
    _, trials, _ = training.train_classifier(rows, [{"max_iter": 5}, {"max_iter": 5, "reg_param": 0.1}])
    return trials


@query("score_records", with_tables(f"SELECT event_id, {duck.rule_label('message')} AS prediction FROM messages", "messages"))
def _(spark, sf):
    return scoring.score_records(derived(spark, sf, "messages"), rule_label).select("event_id", "prediction")


def word_count_scorer(frames):
    for frame in frames:
        yield frame.assign(prediction=["long" if len(m.split(" ")) > 6 else "short" for m in frame["message"]])


@query("score_in_pandas", with_tables("SELECT event_id, CASE WHEN len(string_split(message, ' ')) > 6 THEN 'long' ELSE 'short' END AS prediction FROM messages", "messages"))
def _(spark, sf):
    return scoring.score_in_pandas(derived(spark, sf, "messages").select("event_id", "message"), word_count_scorer).select("event_id", "prediction")


@query("gate_of_rule_scorer", with_tables(f"SELECT label AS true_label, {duck.rule_label('message')} AS predicted_label, count(*) AS n FROM messages GROUP BY 1, 2", "messages"))
def _(spark, sf):
    scored = scoring.score_records(derived(spark, sf, "messages"))
    return quality.confusion_counts(scored, "label", "prediction").withColumnRenamed("label", "true_label")


@query("template_labels", with_tables(f"SELECT {duck.template_group('message')} AS template_group, label, count(*) AS n FROM messages GROUP BY 1, 2", "messages"))
def _(spark, sf):
    return derived(spark, sf, "messages").groupBy(template_group("message").alias("template_group"), "label").agg(F.count(F.lit(1)).alias("n"))


# Two levels of blocks at least: 16 rows to a block.
@query("ordered_fingerprint", """WITH RECURSIVE r AS (SELECT row_number() OVER (ORDER BY doc_id DESC) - 1 AS place, md5(CAST(doc_id AS VARCHAR) || chr(31) || text) AS digest FROM documents),
  top AS (SELECT 0 AS level, place // 16 AS place, sha256(string_agg(digest, '' ORDER BY place)) AS digest, count(*) OVER () AS blocks FROM r GROUP BY place // 16
    UNION ALL SELECT level + 1, place // 16, sha256(string_agg(digest, '' ORDER BY place)), count(*) OVER () FROM top WHERE blocks > 1 GROUP BY level, place // 16)
  SELECT sha256('doc_id,text|' || (SELECT count(*) FROM r) || '|' || max(digest)) AS data_version_id, (SELECT count(*) FROM r) AS row_count FROM top WHERE level = (SELECT max(level) FROM top)""")
def _(spark, sf):
    return dataset.ordered_fingerprint(given(spark, sf, "documents"), [F.desc("doc_id")], ["doc_id", "text"], fan=16)
