"""Corrections from users: merge into a labelled base, tell what each did."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from logloom import domain
from logloom.functions.labels import normalize_label
from logloom.functions.payload import extract_message, first_value, payload_map
from logloom.functions.text import strip
from logloom.operators.dataset import valid_feedback_base
from logloom.operators.skew import repeated, spread_join


def feedback_from_payload(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Feedback events from JSON payloads: message, label, and the fields kept with them."""
    payload = payload_map(raw)
    labels = [normalize_label(F.try_element_at(payload, F.lit(k))) for k in domain.CORRECT_LABEL_KEYS]
    label = F.coalesce(*[F.nullif(x, F.lit("")) for x in labels], F.lit(""))
    return df.select(
        *[c for c in df.columns if c != raw],
        strip(extract_message(raw)).alias("message"),
        label.alias("correct_label"),
        F.coalesce(first_value(payload, ("predictedLabel", "predicted_label")), F.lit("")).alias("predicted_label"),
        F.coalesce(F.try_element_at(payload, F.lit("source")), F.lit("")).alias("source"),
        F.from_json(F.try_element_at(payload, F.lit("metadata")), "map<string,string>").alias("metadata"),
    )


def checked_feedback(events: DataFrame) -> DataFrame:
    """Feedback with a message and a known label; anything else stops the job."""
    message, label = strip("message"), normalize_label("correct_label")
    usable = F.when(message == "", F.raise_error(F.lit("feedback without a message"))).when(
        label == "", F.raise_error(F.lit("feedback without a known label"))
    )
    return events.withColumn("message", F.coalesce(usable.cast("string"), message)).withColumn("correct_label", label)


def latest_labels(events: DataFrame) -> DataFrame:
    """The last label given to each message; partial sums keep repeated messages cheap."""
    last = F.max_by("correct_label", F.struct("received_at", "event_id"))
    return events.groupBy("message").agg(last.alias("correct_label"))


def upsert_feedback(base: DataFrame, events: DataFrame) -> DataFrame:
    """The base with every row of a corrected message relabelled, and one row for each new message.

    Rows are only a message and its class, so equal ones are counted before
    the join and written out after it: a message that fills a third of the
    base is one row in the join.
    """
    counted = valid_feedback_base(base).groupBy("message", "class").agg(F.count(F.lit(1)).alias("n"))
    merged = counted.join(latest_labels(events), "message", "full")
    label = F.coalesce("correct_label", "class").alias("class")
    return repeated(merged.select("message", label, F.coalesce("n", F.lit(1)).alias("n")), "n")


def feedback_actions(events: DataFrame, base: DataFrame) -> DataFrame:
    """``appended`` for the first event of a message that the base lacks, else ``corrected``.

    The first event is a minimum per message, not a rank over all its events.
    """
    first = events.groupBy("message").agg(F.min_by("event_id", F.struct("received_at", "event_id")).alias("__first"))
    known = valid_feedback_base(base).select("message").distinct().withColumn("__known", F.lit(True))
    news = first.join(known, "message", "left").select("message", F.when(F.col("__known").isNull(), F.col("__first")).alias("__new"))
    appended = F.coalesce(F.col("event_id") == F.col("__new"), F.lit(False))
    return spread_join(events.select("event_id", "message"), news, ["message"]).select(
        "event_id", "message", F.when(appended, "appended").otherwise("corrected").alias("action")
    )
