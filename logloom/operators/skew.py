"""Joins that stay even when one key holds a large part of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

SALT = "__salt"
COPIES = "__copies"


def spread_join(
    many: DataFrame,
    few: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    hot_rows: int = 500_000,
    strategy: str | None = None,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Join ``many`` with ``few`` (inner or left) and split hot keys of ``many``.

    Keys with more than ``hot_rows`` rows get one part per ``hot_rows`` rows,
    however many those are; only the matching rows of ``few`` are copied, once
    per part. The part of a row follows from its values, so a lost task is
    redone the same way; equal rows share a part, so tables with many of them
    are counted first (see ``repeated``). The table of hot keys has at most
    ``rows / hot_rows`` rows and is broadcast, so no look-up of a hot key
    shuffles its rows. ``strategy`` is a join hint for
    work that is heavy per joined row: with ``merge`` the rows of ``many`` are
    spread by key and part and never sent to where the few are. ``counts`` gives the
    rows of each key as ``__n`` where they are known, which saves a pass over ``many``.
    """
    on = list(on)
    counted = many.groupBy(*on).agg(F.count(F.lit(1)).alias("__n")) if counts is None else counts
    hot = (
        counted
        .where(F.col("__n") > hot_rows)
        .select(*on, F.ceil(F.col("__n") / hot_rows).cast("int").alias(COPIES))
    )
    hot = F.broadcast(hot)
    spread_by = [c for c, t in many.dtypes if not t.startswith(("map", "variant"))]
    left = (
        many.join(hot, on, "left")
        .withColumn(SALT, F.pmod(F.xxhash64(*spread_by), F.coalesce(COPIES, F.lit(1))).cast("int"))
        .drop(COPIES)
    )
    right = (
        few.join(hot, on, "left")
        .withColumn(SALT, F.explode(F.sequence(F.lit(0), F.coalesce(COPIES, F.lit(1)) - 1)))
        .drop(COPIES)
    )
    if strategy:
        right = right.hint(strategy)
    return left.join(right, [*on, SALT], how).drop(SALT)


def repeated(df: DataFrame, times: str, block: int = 100_000) -> DataFrame:
    """Each row ``times`` times, without that column. A row's copies are dealt in blocks before they are made."""
    blocks = df.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col(times) - 1) / block))))
    dealt = blocks.repartition(*[c for c in df.columns if c != times], "__block")
    size = F.least(F.lit(block).cast("bigint"), F.col(times) - F.col("__block") * block)
    return dealt.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("bigint"), size))).drop("__block", "__copy", times)


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence, limit: int, rank: str = "rank") -> DataFrame:
    """The first ``limit`` rows of each key. Spark cuts each task's rows to the
    limit before the shuffle, so a hot key costs no more than a cold one."""
    from pyspark.sql import Window

    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= limit)


def spread_rows(df: DataFrame) -> DataFrame:
    """Rows over all cores when the input has fewer splits than there are cores.

    For heavy work per row on a few small files. Input with enough splits, as
    any large table has, is left as it is and not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= 2 * cores:
        return df
    return df.repartition(2 * cores)
