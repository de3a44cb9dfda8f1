"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logloom.session import checkpointed

__all__ = ["checkpointed", "given", "kept", "no_text", "released", "salted_join", "text_groups"]


_kept: dict[str, object] = {}


def kept(key: str, build: Callable[[], object]):
    """A large object that a Python worker builds once. It keeps one at a time: the stages of a pipeline share workers.

    What the one before took is given back to the system first, as an executor's memory counts all of its workers.
    """
    if key not in _kept:
        _kept.clear()
        released()
        _kept[key] = build()
    return _kept[key]


def released() -> None:
    """Give memory that is free in this process back to the system, where the C library can do so."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def given(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{table}.parquet")


def no_text(column: str | Column) -> Column:
    """The text, or an empty one for null."""
    return F.coalesce(column, F.lit(""))


def salted_join(many: DataFrame, few: DataFrame, on: Sequence[str], spread_by: Sequence[str], how: str = "inner", parts: int = 16) -> DataFrame:
    """Join a table that may hold one hot key with a table of one row per key.

    Every key of ``many`` is dealt over ``parts`` by a hash of ``spread_by`` (columns that
    tell the rows of a key apart); every row of ``few`` is copied ``parts`` times. The rule
    is the same for all keys and sizes, so no look-up of hot keys is needed.
    """
    left = many.withColumn("__part", F.pmod(F.xxhash64(*spread_by), F.lit(parts)).cast("int"))
    right = few.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return left.join(right, [*on, "__part"], how).drop("__part")


def text_groups(texts: Iterable[str | None], most: int) -> Iterator[tuple[int, list[str | None]]]:
    """Cut a batch into (first row, texts) groups of about ``most`` characters, for bounded memory."""
    start, group, size = 0, [], 0
    for at, text in enumerate(texts):
        group.append(text)
        size += len(text) if text else 0
        if size >= most:
            yield start, group
            start, group, size = at + 1, [], 0
    if group:
        yield start, group
