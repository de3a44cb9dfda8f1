"""Incidents of an error stream, kept in state for good.

State holds the issue of each folded summary and begins with the known issues, so a summary that comes back after any
time finds its issue again. Summaries share ``BUCKETS`` keys, each with a map of its summaries: a micro-batch asks
only for the summaries it holds, and what a key costs Python is paid per bucket and not per summary. Events are combined per summary within each Arrow batch before they are shuffled,
so a summary that fills the stream brings a few rows per task to its key. The stream tells what became of each
summary in each micro-batch; what became of each event follows by a join with the table of incidents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from logloom.functions.text import match_text
from logloom.operators.incidents import incident_summary
from logloom.operators.skew import spread_join
from logloom.streaming.jobs import write_updates

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PARTS = ["summary_key", "summary", "first_event", "first_seen", "last_seen", "events"]
#: Keys of the state; the summaries of a micro-batch that share one are in memory together.
BUCKETS = 1024
UPDATES = ["summary_key", "summary", "issue_key", "operation", "creator", "first_seen", "last_seen", "events"]


def new_issue_key(summary_key: str) -> str:
    """The key of an incident without an issue, as the batch form gives it."""
    return "NEW-" + hashlib.md5(summary_key.encode()).hexdigest()[:12]


def _combined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        if len(batch):
            ordered = batch.sort_values(["received_at", "event_id"], kind="stable").groupby("summary_key", sort=False)
            found = ordered.agg(
                summary=("summary", "first"), first_event=("event_id", "first"), first_seen=("received_at", "first"),
                last_seen=("received_at", "max"), events=("event_id", "size"),
            )
            yield found.reset_index()[PARTS]


class Incidents(StatefulProcessor):
    """Per bucket of summaries: the first event of a summary opens an incident where no issue is known, all others belong to it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.issues = handle.getMapState("issues", "summary_key string", "issue_key string")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        for summary_key, known_key in zip(initialState["summary_key"], initialState["known_key"], strict=True):
            self.issues.updateValue((summary_key,), (known_key,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        parts = pd.concat(rows).sort_values(["first_seen", "first_event"], kind="stable")  # one row per summary and Arrow batch
        whole = parts.groupby("summary_key", sort=False).agg(last_seen=("last_seen", "max"), events=("events", "sum"))
        said = parts.drop_duplicates("summary_key")[["summary_key", "summary", "first_event", "first_seen"]].join(whole, "summary_key")
        issue_keys, operations, creators = [], [], []
        for summary_key, event in zip(said["summary_key"], said["first_event"], strict=True):
            known = self.issues.getValue((summary_key,))
            issue_key = known[0] if known else new_issue_key(summary_key)
            if not known:
                self.issues.updateValue((summary_key,), (issue_key,))
            issue_keys.append(issue_key)
            operations.append("reused" if known else "created")
            creators.append(None if known or pd.isna(event) else int(event) if isinstance(event, float) else event)
        yield said.assign(issue_key=issue_keys, operation=operations, creator=pd.Series(creators, said.index, dtype=object))[UPDATES]

    def close(self) -> None:
        pass


def _keyed(errors: DataFrame, prefix: str) -> DataFrame:
    named = errors.select("event_id", "received_at", incident_summary("message", prefix).alias("summary"))
    return named.withColumn("summary_key", match_text("summary"))


def known_issues(issues: DataFrame) -> DataFrame:
    """The issue of each folded summary, the last updated one where there are several."""
    return issues.groupBy(match_text("summary").alias("summary_key")).agg(F.max_by("issue_key", F.struct("updated", "issue_key")).alias("known_key"))


def incident_updates(errors: DataFrame, issues: DataFrame | None = None, prefix: str = "Incident: ") -> DataFrame:
    """Per micro-batch and summary: its issue, whether it was created, by which event, and how many events it had.

    ``errors`` is a stream with event_id, received_at and message. Issues are read once, by the first micro-batch.
    """
    of = dict(errors.dtypes)["event_id"]
    keyed = _keyed(errors, prefix)
    times = "first_seen timestamp, last_seen timestamp, events bigint"
    parts = keyed.mapInPandas(_combined, f"summary_key string, summary string, first_event {of}, {times}")
    bucket = F.pmod(F.xxhash64("summary_key"), F.lit(BUCKETS)).cast("int")
    known = known_issues(issues).withColumn("bucket", bucket).groupBy("bucket") if issues is not None else None
    schema = f"summary_key string, summary string, issue_key string, operation string, creator {of}, {times}"
    return parts.withColumn("bucket", bucket).groupBy("bucket").transformWithStateInPandas(Incidents(), schema, "Update", "None", known)


@contextmanager
def _state_store(spark: SparkSession) -> Iterator[None]:
    """State of any kind needs the RocksDB store; a query keeps the store that it was started with."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def stream_incidents(errors: DataFrame, target: str, checkpoint: str, issues: DataFrame | None = None, prefix: str = "Incident: ", available_now: bool = True) -> StreamingQuery:
    """Store the updates of each micro-batch; one that is run twice overwrites its own folder."""
    with _state_store(errors.sparkSession):
        return write_updates(incident_updates(errors, issues, prefix), target, checkpoint, available_now)


def incidents(spark: SparkSession, target: str) -> DataFrame:
    """Each summary so far: its issue, the event that created it (null where it was known before), its events."""
    rows = spark.read.option("basePath", target).parquet(target)
    return rows.groupBy("summary_key").agg(
        F.max("issue_key").alias("issue_key"), F.min_by("summary", "micro_batch").alias("summary"), F.max("creator").alias("creator"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("events").alias("events"),
    )


def incident_operations(errors: DataFrame, found: DataFrame, prefix: str = "Incident: ") -> DataFrame:
    """What became of each event: the batch form of the stream's answer."""
    joined = spread_join(_keyed(errors, prefix).drop("received_at"), found.select("summary_key", "issue_key", "creator"), ["summary_key"])
    created = F.coalesce(F.col("event_id") == F.col("creator"), F.lit(False))
    return joined.select("event_id", "summary", "issue_key", F.when(created, "created").otherwise("reused").alias("operation"))
