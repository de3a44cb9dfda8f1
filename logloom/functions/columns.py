"""Finding the message and label columns of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from logloom import domain


def resolve_text_column(columns: Sequence[str], keywords: Sequence[str] = domain.TEXT_KEYWORDS) -> str:
    """First column whose name contains a keyword, else the first column."""
    if not columns:
        raise ValueError("the table has no columns")
    return next((c for c in columns if any(word in c.lower() for word in keywords)), columns[0])


def resolve_column(columns: Sequence[str], aliases: Sequence[str], what: str = "message") -> str:
    """The column that bears the first alias found; case and outer spaces do not matter."""
    by_name = {c.strip().lower(): c for c in columns if c.strip()}
    for alias in aliases:
        if alias.lower() in by_name:
            return by_name[alias.lower()]
    raise ValueError(f"no {what} column: expected one of {list(aliases)}, found {list(columns)}")


def with_text_column(df: DataFrame, name: str = "message") -> DataFrame:
    return df.withColumnRenamed(resolve_text_column(df.columns), name)


def with_standard_columns(
    df: DataFrame,
    message_aliases: Sequence[str] = domain.TRAINING_MESSAGE_COLUMNS,
    label_aliases: Sequence[str] = domain.TRAINING_LABEL_COLUMNS,
) -> DataFrame:
    """Keep the message and label columns only, as ``message`` and ``class``."""
    message = resolve_column(df.columns, message_aliases, "message")
    label = resolve_column(df.columns, label_aliases, "label")
    return df.select(df[f"`{message}`"].alias("message"), df[f"`{label}`"].alias("class"))
