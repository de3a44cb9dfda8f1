"""The whole way of an event: message, label, evidence, incident, follow-up."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from logloom import domain
from logloom.functions.labels import rule_label
from logloom.functions.payload import extract_message, prediction_label
from logloom.operators import evidence, incidents
from logloom.operators.skew import spread_join
from logloom.session import checkpointed


def labelled_events(events: DataFrame, answer: str | None = "answer") -> DataFrame:
    """Events with message and label; a given answer is used, else the rules decide."""
    message = extract_message("payload")
    label: Column = rule_label("message")
    if answer in events.columns:
        label = F.coalesce(F.nullif(prediction_label(answer), F.lit("")), label)
    return events.withColumn("message", message).withColumn("prediction", label)


def triage(
    events: DataFrame,
    commits: DataFrame,
    files: DataFrame,
    issues: DataFrame,
    refs: DataFrame,
    repo: str,
    default_branch: str = "",
    history_limit: int = 10,
    answer: str | None = "answer",
) -> Mapping[str, DataFrame]:
    """``results`` (one row per event, with its actions) and ``candidates`` (top commits per signature)."""
    labelled = checkpointed(labelled_events(events, answer))
    errors = labelled.where(F.col("prediction") == domain.INCIDENT_LABEL)
    signed = checkpointed(evidence.event_signatures(errors.drop("message"), repo, default_branch))
    signatures = checkpointed(evidence.distinct_signatures(signed))
    candidates = checkpointed(evidence.impact_candidates(signatures, commits, files, history_limit))
    verdicts = evidence.impact_verdict(signatures, candidates)
    judged = spread_join(signed.select("event_id", "sig_id"), verdicts, ["sig_id"], "left")

    opened = incidents.dedupe_incidents(signed.select("event_id", "received_at", "message"), issues)
    follow = incidents.dedupe_remediation(opened.select("issue_key"), refs)
    tickets = spread_join(opened, follow.select("issue_key", F.col("operation").alias("follow_operation"), F.col("kind").alias("follow_kind")), ["issue_key"], "left")
    facts = judged.join(tickets, "event_id")
    everything = labelled.select("event_id", "received_at", "prediction", "message").join(facts, "event_id", "left")
    actions = incidents.routed_actions(
        F.col("prediction"),
        {"issue_key": F.col("issue_key"), "operation": F.col("operation")},
        {"kind": F.col("follow_kind"), "operation": F.col("follow_operation")},
    )
    results = everything.select(
        "event_id", "received_at", "prediction", "message", "sig_id", "verdict", "status", "issue_key", "operation", actions.alias("actions"),
        F.array().cast("array<struct<type:string,error:string>>").alias("errors"),
    )
    return {"results": results, "candidates": evidence.top_candidates(candidates, commits)}
