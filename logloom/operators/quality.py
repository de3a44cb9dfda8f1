"""Classifier quality: confusion matrix, metrics, gates, drift, trial choice."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from logloom import domain
from logloom.functions.text import strip
from logloom.operators.dataset import label_rows_table

METRICS = ("accuracy", "weighted_f1", "macro_f1")


def score_join(golden: DataFrame, predictions: DataFrame, key: str = "line_number") -> DataFrame:
    """Every golden row with its prediction, blank where there is none, and a match flag."""
    predicted = F.coalesce(strip("predicted_label"), F.lit(""))
    return golden.join(predictions.select(key, "predicted_label"), key, "left").select(
        key, "message", strip("label").alias("true_label"), predicted.alias("predicted_label"), (strip("label") == predicted).alias("match")
    )


def confusion_counts(df: DataFrame, truth: str = "true_label", predicted: str = "predicted_label") -> DataFrame:
    """Rows per (true, predicted) pair that occurs: the one pass over the rows."""
    return df.groupBy(strip(truth).alias("true_label"), strip(predicted).alias("predicted_label")).agg(
        F.count(F.lit(1)).alias("n")
    )


def label_order(counts: DataFrame, labels: Sequence[str] = domain.LABELS) -> DataFrame:
    """Base labels first, then other true labels, then other predictions; blank is none."""
    known = label_rows_table(counts, labels).select("label", F.lit(0).alias("tier"), F.col("label_index").alias("at"))
    seen = counts.select(
        F.explode(
            F.array(
                F.struct(F.col("true_label").alias("label"), F.lit(1).alias("tier")),
                F.struct(F.col("predicted_label").alias("label"), F.lit(2).alias("tier")),
            )
        ).alias("s")
    ).select("s.label", "s.tier", F.lit(0).alias("at"))
    return (
        known.unionByName(seen)
        .where(F.col("label") != "")
        .groupBy("label")
        .agg(F.min(F.struct("tier", "at")).alias("place"))
    )


def confusion_matrix(counts: DataFrame, labels: Sequence[str] = domain.LABELS) -> DataFrame:
    """Dense K x K matrix as rows, over the ordered label list.

    The label list has one row per label, so pairing it with itself is bounded
    by K x K; the lists are gathered in one array and unfolded.
    """
    ordered = label_order(counts, labels)
    names = ordered.agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "label"))), lambda x: x["label"]).alias("names")
    )
    cells = names.select("names", F.posexplode("names").alias("true_index", "true_label")).select(
        "true_index", "true_label", F.posexplode("names").alias("predicted_index", "predicted_label")
    )
    return cells.join(counts, ["true_label", "predicted_label"], "left").select(
        "true_index", "true_label", "predicted_index", "predicted_label", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")
    )


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def per_class_metrics(counts: DataFrame, labels: Sequence[str] = domain.LABELS) -> DataFrame:
    """Precision, recall, F1 and support per label; 0 where nothing can be divided.

    ``present`` tells whether the label occurs in the data at all.
    """
    sides = counts.select(
        "n",
        F.explode(
            F.array(
                F.struct(F.col("true_label").alias("label"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"), F.when(F.col("true_label") == F.col("predicted_label"), F.col("n")).otherwise(0).cast("bigint").alias("hits")),
                F.struct(F.col("predicted_label").alias("label"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("hits")),
            )
        ).alias("s"),
    ).select("s.*", F.lit(True).alias("present"))
    base = label_rows_table(counts, labels).select(
        "label", *[F.lit(0).cast("bigint").alias(c) for c in ("support", "predicted", "hits")], F.lit(False).alias("present")
    )
    sums = (
        sides.unionByName(base)
        .groupBy("label")
        .agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hits")], F.bool_or("present").alias("present"))
    )
    return sums.select(
        "label",
        _ratio(F.col("hits"), F.col("predicted")).alias("precision"),
        _ratio(F.col("hits"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("hits"), F.col("predicted") + F.col("support")).alias("f1"),
        "support",
        "hits",
        "present",
    )


def summary_metrics(per_class: DataFrame) -> DataFrame:
    """Accuracy, means over the labels present, means weighted by support; one row."""
    present = per_class.where("present")
    total = F.sum("support")
    means = [F.avg(m).alias(f"macro_{m}") for m in ("precision", "recall", "f1")]
    weighted = [
        _ratio(F.sum(F.col(m) * F.col("support")), total).alias(f"weighted_{m}") for m in ("precision", "recall", "f1")
    ]
    return present.agg(_ratio(F.sum("hits"), total).alias("accuracy"), *means, *weighted, total.alias("sample_count"))


def checked_policy(policy: Mapping[str, object], name: str = "policy") -> dict[str, object]:
    """The policy with its keys present, numeric and within [0, 1], or an error."""

    def fraction(value: object, what: str) -> float:
        try:
            number = float(value)  # type: ignore[arg-type]
        except (TypeError, ValueError) as problem:
            raise ValueError(f"{name}: {what} is no number") from problem
        if not 0 <= number <= 1:
            raise ValueError(f"{name}: {what} is outside [0, 1]")
        return number

    checked: dict[str, object] = {}
    for key in (f"min_{m}" for m in METRICS):
        if key not in policy:
            raise ValueError(f"{name}: {key} is missing")
        checked[key] = fraction(policy[key], key)
    recalls = policy.get("min_recall_per_class")
    if not isinstance(recalls, Mapping):
        raise ValueError(f"{name}: min_recall_per_class is no object")
    checked["min_recall_per_class"] = {
        k.strip(): fraction(v, f"min_recall_per_class[{k}]") for k, v in recalls.items() if k.strip()
    }
    return checked


def checked_drift_policy(policy: Mapping[str, object]) -> dict[str, dict[str, object]]:
    """Both levels of a drift policy; one without levels counts as critical only."""
    if policy.get("warning") is None and policy.get("critical") is None:
        return {"critical": checked_policy(policy, "critical")}
    levels = {k: checked_policy(policy[k], k) for k in ("warning", "critical") if policy.get(k) is not None}  # type: ignore[arg-type]
    if "critical" not in levels:
        raise ValueError("a drift policy needs a critical level")
    return levels


def policy_thresholds(df: DataFrame, levels: Mapping[str, Mapping[str, object]]) -> DataFrame:
    """One row per check: level, order, metric, class and threshold."""
    rows = []
    for severity, level in enumerate(("warning", "critical"), start=1):
        policy = levels.get(level)
        if policy:
            rows += [(level, severity, i, m, "", policy[f"min_{m}"]) for i, m in enumerate(METRICS)]
            recalls = policy["min_recall_per_class"]
            rows += [(level, severity, len(METRICS) + i, "recall", c, t) for i, (c, t) in enumerate(recalls.items())]  # type: ignore[union-attr]
    schema = "level string, severity int, check_order int, metric string, class string, threshold double"
    return df.sparkSession.createDataFrame(rows, schema)


def metric_values(per_class: DataFrame) -> DataFrame:
    """The checked metrics as rows (metric, class, value)."""
    summary = summary_metrics(per_class).select(
        F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.lit("").alias("class"), F.col(m).alias("value")) for m in METRICS])).alias("m")
    )
    recalls = per_class.where(F.col("label") != "").select(
        F.struct(F.lit("recall").alias("metric"), F.col("label").alias("class"), F.col("recall").alias("value")).alias("m")
    )
    return summary.unionByName(recalls).select("m.*")


def policy_checks(per_class: DataFrame, levels: Mapping[str, Mapping[str, object]], prefix: bool = False) -> DataFrame:
    """Each check with its value, verdict and the text of a failure; no value counts as 0."""
    checks = policy_thresholds(per_class, levels).join(metric_values(per_class), ["metric", "class"], "left")
    value = F.coalesce("value", F.lit(0.0))
    head = F.concat("level", F.lit(".")) if prefix else F.lit("")
    is_recall = F.col("metric") == "recall"
    place = F.when(is_recall, F.concat(F.lit("["), "class", F.lit("]"))).otherwise("")
    minimum = F.when(is_recall, "min_recall_per_class").otherwise(F.concat(F.lit("min_"), F.col("metric")))
    reason = F.concat(
        head, "metric", place, F.lit(" "), F.format_string("%.4f", value), F.lit(" < "), head, minimum, place,
        F.lit(" "), F.format_string("%.4f", "threshold"),
    )
    return checks.select(
        "level", "severity", "check_order", "metric", "class", value.alias("value"), "threshold",
        (value < F.col("threshold")).alias("failed"), reason.alias("reason"),
    )


def below_threshold(per_class: DataFrame, levels: Mapping[str, Mapping[str, object]]) -> DataFrame:
    return policy_checks(per_class, levels).where("failed").select("level", "metric", "class", "value", "threshold")


def _failures(level: Column) -> Column:
    failed = F.collect_list(F.when(level & F.col("failed"), F.struct("check_order", "reason")))
    return F.transform(F.array_sort(failed), lambda x: x["reason"])


def gate_verdict(per_class: DataFrame, policy: Mapping[str, object] = domain.GATE_POLICY) -> DataFrame:
    """Pass when no check fails, with the failed checks as text, in policy order."""
    checks = policy_checks(per_class, {"critical": checked_policy(policy)})
    return checks.agg(_failures(F.lit(True)).alias("failed_checks"), F.count_if("failed").alias("failed_count")).select(
        (F.col("failed_count") == 0).alias("gate_pass"), "failed_count", "failed_checks"
    )


def drift_status(per_class: DataFrame, policy: Mapping[str, object] = domain.DRIFT_POLICY) -> DataFrame:
    """critical, warning or ok, with the failures of both levels."""
    checks = policy_checks(per_class, checked_drift_policy(policy), prefix=True)
    severity = F.max(F.when(F.col("failed"), F.col("severity")).otherwise(0))
    return checks.agg(
        F.element_at(F.array(F.lit("ok"), F.lit("warning"), F.lit("critical")), severity + 1).alias("status"),
        _failures(F.col("level") == "warning").alias("warning_failures"),
        _failures(F.col("level") == "critical").alias("critical_failures"),
    )


def gate_cache_lookup(requests: DataFrame, history: DataFrame, keys: Sequence[str] = ("model_hash", "golden_set_hash", "policy_hash"), newest: int = 200, scope: Sequence[str] = ()) -> DataFrame:
    """For each request the newest passed report with equal hashes among the newest reports.

    ``scope`` names the columns that tell apart independent histories.
    """
    from logloom.operators.skew import top_rows

    order = [F.col("created_at").desc(), F.col("report_id").desc()]
    if scope:
        recent = top_rows(history, scope, order, newest)
    else:
        recent = history.orderBy(*order).limit(newest)
    passed = recent.where("gate_pass").groupBy(*scope, *keys).agg(
        F.max_by(F.struct("report_id", "created_at"), F.struct("created_at", "report_id")).alias("hit")
    )
    return requests.join(passed, [*scope, *keys], "left").select(
        *requests.columns, F.col("hit").isNotNull().alias("cache_hit"), F.col("hit.report_id").alias("report_id")
    )


def cv_average(folds: DataFrame, metrics: Sequence[str] = ("macro_f1", "weighted_f1")) -> DataFrame:
    """Mean of each metric over the folds of a trial."""
    return folds.groupBy("trial_index").agg(F.count(F.lit(1)).alias("folds"), *[F.avg(m).alias(m) for m in metrics])


def select_trial(trials: DataFrame, score: str = "macro_f1") -> DataFrame:
    """The trial with the highest score; of equal ones the earliest."""
    best = F.max_by(F.struct(*trials.columns), F.struct(F.col(score), -F.col("trial_index")))
    return trials.agg(best.alias("best")).select("best.*")
