"""Daily prediction counts and request metrics, batch forms."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from logloom import domain
from logloom.functions.text import monitoring_day, strip, truncate_text
from logloom.operators.incidents import action_status, compact_errors
from logloom.operators.skew import spread_join, top_rows

NO_REASON = "The incident was not created, and no error details were recorded."


def _item(metric: str, key: Column) -> Column:
    return F.struct(F.lit(metric).alias("metric"), key.cast("string").alias("key"))


def day_items(results: DataFrame, labels: Sequence[str] = domain.LABELS) -> DataFrame:
    """What each result adds 1 to: rows (day, metric, key)."""
    known = F.col("prediction").isin(list(labels))
    blank = F.lit("")
    label = F.coalesce(F.nullif(strip("prediction"), F.lit("")), F.lit("Unknown"))
    incident_type = domain.ACTION_TYPES["incident"]
    issue = F.get(F.filter("actions", lambda a: (a["type"] == incident_type) & (F.coalesce(a["issue_key"], F.lit("")) != "")), 0)
    outcome = F.when(issue.isNull(), "issue_failed").when(F.lower(issue["operation"]) == "reused", "issue_reused").otherwise("issue_created")
    items = F.concat(
        F.array(
            _item("total", blank),
            F.struct(F.when(known, "label").otherwise("unknown_prediction").alias("metric"), label.alias("key")),
            _item("action_status", F.when(F.size("errors") > 0, "partial_failure").otherwise("ok")),
        ),
        F.transform("actions", lambda a: _item("action", F.coalesce(F.nullif(a["type"], F.lit("")), F.lit("unknown")))),
        F.when(
            F.col("prediction") == domain.INCIDENT_LABEL, F.array(F.struct(outcome.alias("metric"), F.lit("").alias("key")))
        ).otherwise(F.array()),
    )
    return results.select(monitoring_day("received_at").alias("day"), F.explode(items).alias("i")).select("day", "i.metric", "i.key")


def daily_monitoring(results: DataFrame, labels: Sequence[str] = domain.LABELS) -> DataFrame:
    """Counts per day, metric and key; the fixed metrics show 0 where nothing happened."""
    counts = day_items(results, labels).groupBy("day", "metric", "key").agg(F.count(F.lit(1)).alias("n"))
    fixed = [("label", x) for x in labels] + [("action_status", x) for x in ("ok", "partial_failure")]
    fixed += [(x, "") for x in ("issue_created", "issue_reused", "issue_failed")]
    zeros = F.array(*[_item(m, F.lit(k)) for m, k in fixed])
    # Days come from the counted rows, so this part is as small as the report.
    blank = counts.where(F.col("metric") == "total").select("day", F.explode(zeros).alias("i")).select("day", "i.metric", "i.key", F.lit(0).cast("bigint").alias("n"))
    return counts.unionByName(blank).groupBy("day", "metric", "key").agg(F.sum("n").alias("n"))


def day_bounds(results: DataFrame) -> DataFrame:
    return results.groupBy(monitoring_day("received_at").alias("day")).agg(F.min("received_at").alias("first_seen_at"), F.max("received_at").alias("updated_at"))


def failure_reasons(results: DataFrame, default: str = NO_REASON, max_chars: int = 900) -> DataFrame:
    """Why incidents were not created, counted per day and reason."""
    incident = domain.ACTION_TYPES["incident"]
    lost = results.where(F.col("prediction") == domain.INCIDENT_LABEL).where(
        ~F.exists("actions", lambda a: (a["type"] == incident) & (F.coalesce(a["issue_key"], F.lit("")) != ""))
    )
    texts = F.transform(F.filter("errors", lambda e: e["type"] == incident), lambda e: strip(e["error"]))
    reasons = F.when(F.size(texts) == 0, F.array(F.lit(default))).otherwise(texts)
    return (
        lost.select(monitoring_day("received_at").alias("day"), F.explode(reasons).alias("reason"))
        .groupBy("day", F.coalesce(F.nullif(truncate_text("reason", max_chars), F.lit("")), F.lit("unknown")).alias("reason"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def top_reasons(reasons: DataFrame, limit: int = 6) -> DataFrame:
    return top_rows(reasons, ["day"], [F.col("n").desc(), F.col("reason")], limit)


def last_prediction(results: DataFrame) -> DataFrame:
    """The last result of each day with its outcome."""
    kept = action_status(results, "received_at", "errors").select(
        "event_id", monitoring_day("received_at").alias("day"), "received_at", "prediction", "action_status", "issue_created", "issue_reused",
        compact_errors("errors").alias("action_errors"),
    )
    last = F.max_by(F.struct(*kept.columns), F.struct("received_at", "event_id"))
    return kept.groupBy("day").agg(last.alias("r")).select("r.*")


def request_metrics(samples: DataFrame) -> DataFrame:
    """Requests, summed duration and predictions, all from one pass over the samples."""
    clean = samples.select(
        "method", "path", F.col("status").cast("string").alias("status"), strip("prediction").alias("prediction"),
        F.greatest(F.col("duration"), F.lit(0.0)).alias("duration"),
    )
    cells = clean.groupBy("method", "path", "status", "prediction").agg(F.count(F.lit(1)).alias("n"), F.sum("duration").alias("duration"))
    none = F.lit(None).cast("string")

    def part(metric: str, value: Column, *labels: str) -> Column:
        shown = [(F.col(c) if c in labels else none).alias(c) for c in ("method", "path", "status", "prediction")]
        return F.struct(F.lit(metric).alias("metric"), *shown, value.cast("double").alias("value"))

    parts = F.array(
        part("requests_total", F.col("n"), "method", "path", "status"),
        part("duration_seconds_sum", F.col("duration"), "method", "path"),
        part("duration_seconds_count", F.col("n"), "method", "path"),
        part("predictions_total", F.col("n"), "prediction"),
    )
    shown = cells.select(F.explode(parts).alias("p")).select("p.*").where((F.col("metric") != "predictions_total") | (F.col("prediction") != ""))
    return shown.groupBy("metric", "method", "path", "status", "prediction").agg(F.sum("value").alias("value"))


def request_rate(samples: DataFrame, minutes: int = 5) -> DataFrame:
    """Requests per second of each method, path and status in windows of event time."""
    return (
        samples.groupBy(F.window("ts", f"{minutes} minutes").alias("w"), "method", "path", F.col("status").cast("string").alias("status"))
        .agg(F.count(F.lit(1)).alias("requests"))
        .select(F.col("w.start").alias("window_start"), "method", "path", "status", "requests", (F.col("requests") / (minutes * 60.0)).alias("rate"))
    )


def average_latency(samples: DataFrame, minutes: int = 5) -> DataFrame:
    duration = F.greatest(F.col("duration"), F.lit(0.0))
    return (
        samples.groupBy(F.window("ts", f"{minutes} minutes").alias("w"), "method", "path")
        .agg(F.sum(duration).alias("s"), F.count(F.lit(1)).alias("requests"))
        .select(F.col("w.start").alias("window_start"), "method", "path", "requests", (F.col("s") / F.col("requests")).alias("avg_latency"))
    )


def trailing_sums(samples: DataFrame, keys: Sequence[str], sums: Mapping[str, Column], minutes: int = 5, step_seconds: int = 30) -> DataFrame:
    """Sums over the trailing minutes at every step that has a sample in them: ``at``, the keys, the sums.

    A row at ``at`` covers the samples from ``at`` less the minutes up to, but without, ``at``. Samples are summed
    per pane of a step first, so a series of any length is a row per pane, and each pane goes to the steps it counts for.
    """
    seconds = minutes * 60
    if seconds % step_seconds:
        raise ValueError("the trailing minutes are not a whole number of steps")
    pane = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (step_seconds * 1_000_000)).cast("bigint")
    panes = samples.groupBy(*keys, pane.alias("__pane")).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    steps = panes.withColumn("__at", F.explode(F.sequence(F.col("__pane") + 1, F.col("__pane") + seconds // step_seconds)))
    return steps.groupBy(*keys, "__at").agg(*[F.sum(n).alias(n) for n in sums]).select(
        F.timestamp_seconds(F.col("__at") * step_seconds).alias("at"), *keys, *sums
    )


def trailing_request_rate(samples: DataFrame, minutes: int = 5, step_seconds: int = 30) -> DataFrame:
    """Requests per second of each method, path and status over the trailing minutes, at each step."""
    named = samples.withColumn("status", F.col("status").cast("string"))
    found = trailing_sums(named, ["method", "path", "status"], {"requests": F.lit(1)}, minutes, step_seconds)
    return found.withColumn("rate", F.col("requests") / (minutes * 60.0))


def trailing_latency(samples: DataFrame, minutes: int = 5, step_seconds: int = 30) -> DataFrame:
    """Mean duration of the requests of each method and path over the trailing minutes, at each step."""
    sums = {"requests": F.lit(1), "duration": F.greatest(F.col("duration"), F.lit(0.0))}
    found = trailing_sums(samples, ["method", "path"], sums, minutes, step_seconds)
    return found.withColumn("avg_latency", F.col("duration") / F.col("requests")).drop("duration")


def counter_increases(counters: DataFrame, keys: Sequence[str], value: str = "value", span: str = "1 hour") -> DataFrame:
    """What each reading of a counter adds to the one before it: ``increase``; a counter that fell was set back to 0 and counts whole.

    The first reading of a series adds nothing. Readings are put side by side within a span of time; a span begins
    with the last reading of the one before, of which there is one row, so a long series is spread over its spans.
    """
    spans = counters.withColumn("__span", F.window(F.col("ts").cast("timestamp"), span)["start"])
    order = F.struct("ts", value)
    lasts = spans.groupBy(*keys, "__span").agg(F.max_by(value, order).alias("__last"))
    before = lasts.withColumn("__before", F.lag("__last").over(Window.partitionBy(*keys).orderBy("__span"))).drop("__last")
    joined = spread_join(spans, before, [*keys, "__span"])
    earlier = F.coalesce(F.lag(value).over(Window.partitionBy(*keys, "__span").orderBy("ts", value)), F.col("__before"))
    grown = F.when(earlier.isNull(), 0).when(F.col(value) >= earlier, F.col(value) - earlier).otherwise(F.col(value))
    return joined.withColumn("increase", grown).drop("__span", "__before")


def counter_rate(counters: DataFrame, keys: Sequence[str], value: str = "value", minutes: int = 5, step_seconds: int = 30) -> DataFrame:
    """Increase per second of each counter over the trailing minutes, at each step, across resets."""
    grown = counter_increases(counters, keys, value)
    found = trailing_sums(grown, keys, {"increase": F.col("increase")}, minutes, step_seconds)
    return found.withColumn("rate", F.col("increase") / (minutes * 60.0))
