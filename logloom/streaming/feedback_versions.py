"""Feedback as versions: one version of the data set per feedback, without writing the data set again.

``root/base`` holds the first data set as counts per message and class. ``root/feedback/micro_batch=n`` holds the
feedback of a micro-batch; each event is numbered in its order, and that number is its version. A version is
read by merging the base, or the newest snapshot before it, with the last label of each message up to it.
A version's id is its content's: sums of row hashes, which a feedback changes by the rows of its message only, so
the ids come from running sums and equal the fingerprint of the data set that would have been written.

A micro-batch that is run twice writes the same folders twice: its numbers follow from the micro-batches before.
Bytes written grow with the feedback; reading grows with what came after the last snapshot (``compact``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming.query import StreamingQuery

from logloom.operators import feedback
from logloom.operators.dataset import content_id, row_numbers, valid_feedback_base
from logloom.operators.indexing import with_order_index
from logloom.operators.skew import repeated, spread_join
from logloom.session import checkpointed
from logloom.sources import sinks

COLUMNS = ("message", "class")
#: Versions whose sums are run up in one task.
BLOCK = 10_000


def _hashes(label: Column) -> list[Column]:
    """The two numbers of a row with this label."""
    return row_numbers([F.col("message"), label])


def _part(spark: SparkSession, root: str, what: str, before: int | None = None) -> DataFrame | None:
    table = sinks.table_or_none(spark, f"{root}/{what}")
    return table if table is None or before is None else table.where(F.col("micro_batch") < before)


def start(base: DataFrame, root: str) -> None:
    """Write the first data set as counts, once; version 0 is its content."""
    spark = base.sparkSession
    if _part(spark, root, "heads") is None:
        counted = valid_feedback_base(base).groupBy(*COLUMNS).agg(F.count(F.lit(1)).alias("n"))
        counted.write.mode("overwrite").parquet(f"{root}/base")
        sums = [F.coalesce(F.sum(F.col("n") * h), F.lit(0)).cast("decimal(38,0)") for h in _hashes(F.col("class"))]
        rows = F.coalesce(F.sum("n"), F.lit(0)).alias("row_count")
        head = spark.read.parquet(f"{root}/base").agg(rows, sums[0].alias("s1"), sums[1].alias("s2"))
        head.withColumn("version", F.lit(0).cast("bigint")).coalesce(1).write.mode("overwrite").parquet(f"{root}/heads/micro_batch=-1")


def _counted(spark: SparkSession, root: str, version: int, before: int | None = None) -> DataFrame:
    """(message, class, n) of a version: the newest snapshot up to it, or the base, and the last labels since."""
    snapshots = sinks.table_or_none(spark, f"{root}/snapshots")
    from_version = None
    if snapshots is not None:
        from_version = snapshots.where(F.col("version") <= version).agg(F.max("version")).first()[0]
    stored = spark.read.parquet(f"{root}/base") if from_version is None else spark.read.parquet(f"{root}/snapshots/version={from_version}").select(*COLUMNS, "n")
    events = _part(spark, root, "feedback", before)
    if events is None:
        return stored
    since = events.where((F.col("version") > (from_version or 0)) & (F.col("version") <= version))
    labels = since.groupBy("message").agg(F.max_by("correct_label", "version").alias("correct_label"))
    merged = stored.join(labels, "message", "full").select("message", F.coalesce("correct_label", "class").alias("class"), F.coalesce("n", F.lit(1)).alias("n"))
    return merged.groupBy(*COLUMNS).agg(F.sum("n").alias("n"))


def _merged(root: str) -> Callable[[DataFrame, int], None]:
    """Micro-batch step: number the feedback, tell what each changes, and keep where the sums stand."""

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        heads = _part(spark, root, "heads", batch_id)
        head = heads.orderBy(F.desc("micro_batch")).first()  # a row per micro-batch
        clean = feedback.checked_feedback(batch)
        numbered = with_order_index(clean, ["received_at", "event_id"], name="version").withColumn("version", F.col("version") + head["version"] + 1)
        numbered = checkpointed(numbered)
        messages = numbered.select("message").distinct()
        old = [F.sum(F.col("n") * h).cast("decimal(38,0)") for h in _hashes(F.col("class"))]
        state = _counted(spark, root, head["version"], batch_id).join(messages, "message", "left_semi")
        state = state.groupBy("message").agg(F.sum("n").alias("rows"), old[0].alias("s1"), old[1].alias("s2"))
        first = numbered.groupBy("message").agg(F.min("version").alias("first"))
        before = checkpointed(first.join(state, "message", "left"))
        joined = spread_join(numbered, before, ["message"])
        # The label before this event: of the event before it on the same message, found by its place among them.
        placed = with_order_index(joined, ["version"], ["message"], "place")
        earlier = placed.select("message", (F.col("place") + 1).alias("place"), F.col("correct_label").alias("label_before"))
        known = placed.join(earlier, ["message", "place"], "left").drop("place")
        rows = F.coalesce("rows", F.lit(1))
        zero = F.lit(0).cast("decimal(38,0)")
        change = [
            (rows * now - F.when(F.col("label_before").isNotNull(), rows * then).otherwise(F.coalesce(was, zero))).cast("decimal(38,0)")
            for now, then, was in zip(_hashes(F.col("correct_label")), _hashes(F.col("label_before")), (F.col("s1"), F.col("s2")), strict=True)
        ]
        appended = F.col("rows").isNull() & (F.col("version") == F.col("first"))
        out = known.select(
            *numbered.columns, F.when(appended, "appended").otherwise("corrected").alias("action"), F.when(appended, 1).otherwise(0).cast("bigint").alias("more_rows"),
            change[0].alias("d1"), change[1].alias("d2"),
        )
        out.write.mode("overwrite").parquet(f"{root}/feedback/micro_batch={batch_id}")
        sums = spark.read.parquet(f"{root}/feedback/micro_batch={batch_id}").agg(F.max("version").alias("version"), F.sum("more_rows").alias("more"), F.sum("d1").alias("d1"), F.sum("d2").alias("d2")).first()
        if sums["version"] is not None:
            now = (head["row_count"] + sums["more"], head["s1"] + sums["d1"], head["s2"] + sums["d2"], sums["version"])
            new = spark.createDataFrame([now], "row_count bigint, s1 decimal(38,0), s2 decimal(38,0), version bigint")
            new.coalesce(1).write.mode("overwrite").parquet(f"{root}/heads/micro_batch={batch_id}")

    return step


def stream_feedback_versions(events: DataFrame, base: DataFrame, root: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Take feedback (event_id, received_at, message, correct_label and any further columns) as versions of ``base``."""
    start(base, root)
    writer = events.writeStream.foreachBatch(_merged(root)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def versions(spark: SparkSession, root: str) -> DataFrame:
    """Every version: its number, content id and rows, and the feedback that made it (none for version 0).

    Sums run within blocks of versions; the blocks before one come as one row each.
    """
    head = spark.read.parquet(f"{root}/heads").where("micro_batch = -1")
    events = _part(spark, root, "feedback")
    first = head.select(F.lit(0).cast("bigint").alias("version"), F.lit(None).cast("string").alias("event_id"), F.lit("base").alias("action"), "row_count", "s1", "s2")
    if events is None:
        rows = first
    else:
        changed = events.select("version", F.col("event_id").cast("string").alias("event_id"), "action", F.col("more_rows").alias("row_count"), F.col("d1").alias("s1"), F.col("d2").alias("s2"))
        every = first.unionByName(changed).withColumn("block", F.floor(F.col("version") / BLOCK))
        names = ("row_count", "s1", "s2")
        within = Window.partitionBy("block").orderBy("version").rowsBetween(Window.unboundedPreceding, 0)
        blocks = every.groupBy("block").agg(*[F.sum(c).alias(c) for c in names])
        earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        offsets = blocks.select("block", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in names])
        rows = every.join(offsets, "block").select("version", "event_id", "action", *[(F.sum(c).over(within) + F.col(f"{c}_before")).alias(c) for c in names])
    text = lambda c: F.col(c).cast("decimal(38,0)").cast("string")
    return rows.select("version", content_id(COLUMNS, F.col("row_count").cast("string"), text("s1"), text("s2")).alias("data_version_id"), "row_count", "event_id", "action")


def read_version(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The data set (message, class) of a version, the newest by default."""
    newest = spark.read.parquet(f"{root}/heads").agg(F.max("version")).first()[0]
    if version is not None and not 0 <= version <= newest:
        raise ValueError(f"there is no version {version}; the newest is {newest}")
    return repeated(_counted(spark, root, newest if version is None else version), "n")


def compact(spark: SparkSession, root: str, version: int | None = None) -> int:
    """Store a version, the newest by default, as a snapshot that later reads begin with. Versions stay as they are."""
    newest = spark.read.parquet(f"{root}/heads").agg(F.max("version")).first()[0]
    at = newest if version is None else version
    if not 0 <= at <= newest:
        raise ValueError(f"there is no version {at}; the newest is {newest}")
    _counted(spark, root, at).write.mode("overwrite").parquet(f"{root}/snapshots/version={at}")
    return at
