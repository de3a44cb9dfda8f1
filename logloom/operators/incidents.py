"""Follow-up actions: incidents without doubles, remediation, routing, status."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from logloom import domain
from logloom.functions.text import match_text, summary_text
from logloom.operators.skew import spread_join

ACTION = "struct<type:string,target:string,operation:string,issue_key:string>"


def incident_summary(message: Column | str, prefix: str = "Incident: ", default: str = "unclassified runtime error") -> Column:
    from logloom.functions.text import as_column

    text = as_column(message)
    return summary_text(F.concat(F.lit(prefix), F.when(F.coalesce(text, F.lit("")) == "", F.lit(default)).otherwise(text)))


def dedupe_incidents(events: DataFrame, issues: DataFrame, prefix: str = "Incident: ") -> DataFrame:
    """Each error event with the issue it belongs to and whether that is created or reused.

    An open summary is created by its first event and reused by the later
    ones. Everything is decided once per summary; events only look it up.
    """
    keyed = events.select("event_id", "received_at", incident_summary("message", prefix).alias("summary"))
    keyed = keyed.withColumn("summary_key", match_text("summary"))
    known = issues.groupBy(match_text("summary").alias("summary_key")).agg(
        F.max_by("issue_key", F.struct("updated", "issue_key")).alias("known_key")
    )
    first = keyed.groupBy("summary_key").agg(F.min_by("event_id", F.struct("received_at", "event_id")).alias("first_event"))
    decided = first.join(known, "summary_key", "left").select(
        "summary_key",
        F.coalesce("known_key", F.concat(F.lit("NEW-"), F.substring(F.md5(F.col("summary_key").cast("binary")), 1, 12))).alias("issue_key"),
        F.when(F.col("known_key").isNull(), F.col("first_event")).alias("creator"),
    )
    joined = spread_join(keyed.drop("received_at"), decided, ["summary_key"])
    created = F.coalesce(F.col("event_id") == F.col("creator"), F.lit(False))
    return joined.select("event_id", "summary", "issue_key", F.when(created, "created").otherwise("reused").alias("operation"))


def dedupe_remediation(issue_keys: DataFrame, refs: DataFrame, key_pattern: str = r"\b([A-Z][A-Z0-9]+-[A-Za-z0-9]+)\b") -> DataFrame:
    """For each issue a pull request that names it, else an issue that does, else a new task."""
    named = refs.select("kind", "number", "state", "html_url", "title", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(key_pattern), 1))).alias("issue_key"))
    rank = F.when(F.col("kind") == "pull_request", 0).otherwise(1)
    best = named.groupBy("issue_key").agg(
        F.min_by(F.struct("kind", "number", "state", "html_url", "title"), F.struct(rank, F.col("number"))).alias("ref")
    )
    found = F.col("ref").isNotNull()
    return issue_keys.select("issue_key").distinct().join(best, "issue_key", "left").select(
        "issue_key",
        F.when(found, "reused").otherwise("created").alias("operation"),
        F.coalesce("ref.kind", F.lit("task")).alias("kind"),
        F.col("ref.number").alias("number"), F.col("ref.state").alias("state"), F.col("ref.html_url").alias("html_url"), F.col("ref.title").alias("title"),
    )


def _action(kind: str, target: Column, operation: Column, issue: Column, types: Mapping[str, str]) -> Column:
    return F.struct(F.lit(types[kind]).alias("type"), target.alias("target"), operation.alias("operation"), issue.alias("issue_key"))


def routed_actions(
    prediction: Column,
    incident: Mapping[str, Column] | None = None,
    remediation: Mapping[str, Column] | None = None,
    types: Mapping[str, str] = domain.ACTION_TYPES,
    recipients: Mapping[str, str] = domain.RECIPIENTS,
) -> Column:
    """The actions of an event as an array; ``incident`` and ``remediation`` give the columns of earlier look-ups."""
    none = F.lit(None).cast("string")
    issue = (incident or {}).get("issue_key", none)
    opened = _action("incident", none, (incident or {}).get("operation", F.lit("create")), issue, types)
    follow_kind = (remediation or {}).get("kind", F.lit("task"))
    follow_op = (remediation or {}).get("operation", F.lit("create"))
    follow = F.when(follow_kind == "pull_request", _action("pull_request", none, follow_op, issue, types)).otherwise(
        _action("remediation", none, follow_op, issue, types)
    )
    route = F.when(prediction == domain.DEFAULT_LABEL, F.array(_action("ignore", none, none, none, types)))
    for label, recipient in recipients.items():
        route = route.when(prediction == label, F.array(_action("email", F.lit(recipient), F.lit("send"), none, types)))
    route = route.when(prediction == domain.INCIDENT_LABEL, F.array(opened, follow))
    return route.otherwise(F.array(_action("none", none, none, none, types)))


def route_actions(predictions: DataFrame) -> DataFrame:
    """One row per action of each event."""
    return predictions.select("event_id", "prediction", F.posexplode(routed_actions(F.col("prediction"))).alias("step", "a")).select(
        "event_id", "prediction", "step", "a.type", "a.target", "a.operation"
    )


def action_status(results: DataFrame, *keep: str) -> DataFrame:
    """Outcome of each event from its actions and errors; ``keep`` names further columns to take along."""
    incident = domain.ACTION_TYPES["incident"]
    issue = F.get(F.filter("actions", lambda a: (a["type"] == incident) & (F.coalesce(a["issue_key"], F.lit("")) != "")), 0)
    available = issue.isNotNull()
    reused = available & (F.lower(F.coalesce(issue["operation"], F.lit(""))) == "reused")
    failed = (F.size("errors") > 0) | ((F.size("monitoring_errors") > 0) if "monitoring_errors" in results.columns else F.lit(False))
    rejected = (F.col("prediction") == domain.INCIDENT_LABEL) & ~available
    return results.select(
        "event_id", "prediction", *keep, F.when(failed, "partial_failure").otherwise("ok").alias("action_status"),
        (~rejected).alias("accepted"), available.alias("issue_available"), (available & ~reused).alias("issue_created"), reused.alias("issue_reused"),
    )


def compact_errors(errors: Column | str, limit: int = 4, max_chars: int = 1000) -> Column:
    """The first errors with their texts cut."""
    from logloom.functions.text import truncate_text

    kind = lambda e: F.coalesce(F.nullif(e["type"], F.lit("")), F.lit("unknown"))
    return F.transform(
        F.slice(errors, 1, limit), lambda e: F.struct(kind(e).alias("type"), truncate_text(e["error"], max_chars).alias("error"))
    )
