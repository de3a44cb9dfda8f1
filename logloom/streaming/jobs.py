"""Streaming queries: daily files, live counts, request metrics, feedback, incidents.

Every starter takes a streaming DataFrame, a checkpoint folder and, where it
writes, a target; ``available_now`` makes it an incremental job that ends.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery

from logloom.functions.text import batch_date, match_text
from logloom.operators import feedback
from logloom.operators.incidents import incident_summary
from logloom.sources import sinks

LATE = "2 days"


def _start(writer, available_now: bool) -> StreamingQuery:
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def write_daily_batches(events: DataFrame, target: str, checkpoint: str, cutoff: str = "00:00", zone: str = "UTC", available_now: bool = True) -> StreamingQuery:
    """Payloads as JSON lines under ``batch_date=``, the day of the flush that takes them.

    The file sink's log makes each file count once, also after a restart.
    """
    dated = events.select(F.col("payload").alias("value"), batch_date("received_at", cutoff, zone).alias("batch_date"))
    writer = dated.writeStream.format("text").partitionBy("batch_date").option("path", target).option("checkpointLocation", checkpoint)
    return _start(writer, available_now)


def _mark(spark: SparkSession, ledger: str, what: str, batch_id: int, day: str, messages: int) -> None:
    spark.createDataFrame([(day, messages)], "day string, messages bigint").coalesce(1).write.mode("overwrite").parquet(f"{ledger}/{what}/micro_batch={batch_id}")


def _flushed(target: str, ledger: str, day: str) -> Callable[[DataFrame, int], None]:
    """Micro-batch step of the flush: note the day, write the payloads, note how many there were.

    All three overwrite what an earlier try of the same micro-batch left. The day is that of the first try, so
    payloads that were written before a crash stay with the day that took them.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        begun = sinks.table_or_none(spark, f"{ledger}/begun")
        known = begun.where(F.col("micro_batch") == batch_id).first() if begun is not None else None
        of_day = known["day"] if known else day
        if not known:
            _mark(spark, ledger, "begun", batch_id, of_day, 0)
        taken = Observation()
        batch.observe(taken, F.count(F.lit(1)).alias("n")).write.mode("overwrite").partitionBy("batch_date").text(f"{target}/micro_batch={batch_id}")
        _mark(spark, ledger, "done", batch_id, of_day, taken.get["n"])

    return step


def daily_flush(events: DataFrame, target: str, ledger: str, checkpoint: str, day: str, cutoff: str = "00:00", zone: str = "UTC") -> None:
    """One run of the daily job: take what has come in, then mark the day as done, empty or not.

    The ledger is written with each micro-batch, before the stream commits it: a run that stops halfway leaves no day
    marked, and the next one does its open micro-batch again, under the day that began it.
    """
    dated = events.select(F.col("payload").alias("value"), batch_date("received_at", cutoff, zone).alias("batch_date"))
    _start(dated.writeStream.foreachBatch(_flushed(target, ledger, day)).option("checkpointLocation", checkpoint), True).awaitTermination()
    spark = events.sparkSession
    done = sinks.table_or_none(spark, f"{ledger}/done")
    if done is None or done.where(F.col("day") == day).isEmpty():
        spark.createDataFrame([(day,)], "day string").write.mode("append").parquet(f"{ledger}/empty")


def flush_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """Per day that was flushed: ``queued`` with its messages, or ``empty``."""
    parts = [sinks.table_or_none(spark, f"{ledger}/{what}") for what in ("done", "empty")]
    rows = [p.select("day", (F.col("messages") if "messages" in p.columns else F.lit(0).cast("bigint")).alias("messages")) for p in parts if p is not None]
    if not rows:
        return spark.createDataFrame([], "day string, status string, messages bigint")
    whole = reduce(DataFrame.unionByName, rows).groupBy("day").agg(F.sum("messages").alias("messages"))
    return whole.select("day", F.when(F.col("messages") > 0, "queued").otherwise("empty").alias("status"), "messages")


def daily_counts(predictions: DataFrame, watermark: str = LATE) -> DataFrame:
    """Rows per day and label; ``ts`` is event time."""
    return (
        predictions.withWatermark("ts", watermark)
        .groupBy(F.window("ts", "1 day").alias("w"), "prediction")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "prediction", "n")
    )


def live_request_metrics(samples: DataFrame, watermark: str = "10 minutes", width: str = "1 minute", slide: str | None = None) -> DataFrame:
    """Requests and duration per window, method, path and status."""
    duration = F.greatest(F.col("duration"), F.lit(0.0))
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return (
        samples.withWatermark("ts", watermark)
        .groupBy(window.alias("w"), "method", "path", "status")
        .agg(F.count(F.lit(1)).alias("requests"), F.sum(duration).alias("duration_sum"))
        .select(F.col("w.start").alias("window_start"), "method", "path", "status", "requests", "duration_sum")
    )


def write_updates(changes: DataFrame, target: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Store each changed row with its micro-batch; a repeated micro-batch overwrites its own folder."""

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/micro_batch={batch_id}")

    writer = changes.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", checkpoint)
    return _start(writer, available_now)


def latest_updates(spark, target: str, keys: list[str]) -> DataFrame:
    """The present state of a table of updates: the row of the last micro-batch for each key."""
    rows = spark.read.option("basePath", target).parquet(target)
    values = [c for c in rows.columns if c not in (*keys, "micro_batch")]
    last = F.max_by(F.struct(*values), "micro_batch").alias("v")
    return rows.groupBy(*keys).agg(last).select(*keys, "v.*")


def apply_feedback(root: str, base: DataFrame) -> Callable[[DataFrame, int], None]:
    """Micro-batch step: merge feedback into the newest data set and store the result.

    The version of micro-batch n is always built from the one before it, so a
    micro-batch that is run twice writes the same thing twice.
    """

    def step(events: DataFrame, batch_id: int) -> None:
        spark = events.sparkSession
        clean = feedback.checked_feedback(events)
        pointers = sinks.table_or_none(spark, f"{root}/latest")
        before = None
        if pointers is not None:
            before = pointers.where(F.col("micro_batch") < batch_id).agg(F.max_by("data_version_id", "micro_batch").alias("v")).first()["v"]
        present = base if before is None else spark.read.parquet(f"{root}/data/data_version_id={before}")
        merged = feedback.upsert_feedback(present, clean)
        acted = clean.join(feedback.feedback_actions(clean, present).select("event_id", "action"), "event_id")
        acted.write.mode("overwrite").parquet(f"{root}/events/micro_batch={batch_id}")
        version = sinks.archive_dataset(merged, root)
        spark.createDataFrame([(version,)], "data_version_id string").write.mode("overwrite").parquet(f"{root}/latest/micro_batch={batch_id}")

    return step


def stream_feedback(events: DataFrame, base: DataFrame, root: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    writer = events.writeStream.foreachBatch(apply_feedback(root, base)).option("checkpointLocation", checkpoint)
    return _start(writer, available_now)


def newest_dataset(spark, root: str) -> DataFrame:
    pointers = spark.read.option("basePath", f"{root}/latest").parquet(f"{root}/latest")
    version = pointers.agg(F.max_by("data_version_id", "micro_batch").alias("v")).first()["v"]
    return spark.read.parquet(f"{root}/data/data_version_id={version}")


def incident_creates(errors: DataFrame, watermark: str = LATE, prefix: str = "Incident: ", parts: int = 64) -> DataFrame:
    """The first event of each summary within the watermark: the incidents to create.

    Doubles are dropped in ``parts`` parts of each summary first, so the last
    step sees at most that many rows of a summary that fills the stream.
    """
    keyed = errors.select("event_id", "ts", incident_summary("message", prefix).alias("summary"))
    keyed = keyed.withColumn("summary_key", match_text("summary")).withColumn("part", F.pmod(F.xxhash64("event_id"), F.lit(parts)))
    late = keyed.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["summary_key", "part"])
    return late.drop("part").dropDuplicatesWithinWatermark(["summary_key"])


def incident_event_totals(errors: DataFrame, prefix: str = "Incident: ", watermark: str = LATE) -> DataFrame:
    """Events per summary and day with partial sums before the shuffle."""
    keyed = errors.select("ts", match_text(incident_summary("message", prefix)).alias("summary_key")).withWatermark("ts", watermark)
    counted = keyed.groupBy(F.window("ts", "1 day").alias("w"), "summary_key").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "summary_key", "n")


def incident_reuses(totals: DataFrame) -> DataFrame:
    """Reuses per summary and day: all events but the one that created the incident, on its first day."""
    first = totals.groupBy("summary_key").agg(F.min("day").alias("first_day"))
    reused = F.col("n") - (F.col("day") == F.col("first_day")).cast("bigint")
    return totals.join(first, "summary_key").select("day", "summary_key", reused.alias("reused"))
