"""Row numbers and consecutive batches without a global sort in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from logloom.session import checkpointed

POSITION_MASK = (1 << 33) - 1  # monotonically_increasing_id keeps the row position in its lower 33 bits


def with_file_position(df: DataFrame) -> DataFrame:
    """Add the place of each row in its input file; use right after reading."""
    return df.select(
        "*",
        F.col("_metadata.file_path").alias("source_path"),
        F.col("_metadata.file_name").alias("source_file"),
        F.col("_metadata.file_block_start").alias("block_start"),
    )


def with_row_index(df: DataFrame, name: str = "row_index", start: int = 0) -> DataFrame:
    """Number the rows of each file in file order, from ``start``.

    Takes the columns of ``with_file_position``. The rows of each input split
    are counted first; the running sum over splits, one row per split, gives
    each split its offset. No file is sorted or gathered in one task.
    """
    placed = df.withColumn("__at", F.monotonically_increasing_id())
    splits = placed.groupBy("source_path", "block_start").agg(
        F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__rows")
    )
    by_file = Window.partitionBy("source_path").orderBy("block_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.withColumn("__offset", F.coalesce(F.sum("__rows").over(by_file), F.lit(0))).drop("__rows")
    return (
        placed.join(offsets, ["source_path", "block_start"])
        .withColumn(name, F.col("__offset") + F.col("__at") - F.col("__first") + start)
        .drop("__at", "__first", "__offset")
    )


def with_order_index(df: DataFrame, order: Sequence[str | Column], groups: Sequence[str] = (), name: str = "row_index") -> DataFrame:
    """Dense 0-based position of each row in ``order``, within ``groups`` if given.

    The rows are range-partitioned and sorted, written once to the shared
    folder, counted per partition, and shifted by the counts before them. A
    group may span any number of partitions. Rows that are equal in ``order``
    follow by a hash of their values, so a frequent value is spread as well.
    """
    keys = [*groups, *order, F.xxhash64(*[c for c, t in df.dtypes if not t.startswith(("map", "variant"))])]
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    at = F.monotonically_increasing_id()
    placed = checkpointed(ranged.withColumn("__part", F.spark_partition_id()).withColumn("__at", at.bitwiseAND(F.lit(POSITION_MASK))))
    counts = placed.groupBy(*groups, "__part").agg(F.count(F.lit(1)).alias("__rows"), F.min("__at").alias("__first"))
    before = Window.partitionBy(*groups).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__offset", F.coalesce(F.sum("__rows").over(before), F.lit(0))).drop("__rows")
    # Groups may be null; the renamed columns of the counts go after the join.
    offsets = offsets.withColumnsRenamed({c: f"__of_{c}" for c in (*groups, "__part")})
    same = F.col("__part") == F.col("__of___part")
    for c in groups:
        same = same & placed[c].eqNullSafe(offsets[f"__of_{c}"])
    return (
        placed.join(offsets, same)
        .withColumn(name, F.col("__offset") + F.col("__at") - F.col("__first"))
        .drop("__part", "__at", "__first", "__offset", *[f"__of_{c}" for c in (*groups, "__part")])
    )


def into_batches(df: DataFrame, index: str = "row_index", size: int = 10) -> DataFrame:
    """Consecutive batches of ``size`` rows from a dense index."""
    return df.withColumn("batch_id", F.floor(F.col(index) / size)).withColumn("pos", (F.col(index) % size).cast("int"))
