"""Labelled, raw and golden files, and the event stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from logloom import domain
from logloom.functions.columns import resolve_column, with_text_column
from logloom.functions.payload import normalize_payload
from logloom.functions.text import strip
from logloom.sources import split_csv

OVERFLOW = "__overflow"
# A value no file holds, so that empty fields stay empty text and only absent ones become null.
ABSENT = "\x01absent\x01"


def csv_reader(spark: SparkSession, multi_line: bool):
    """CSV with doubled quotes, read by Spark's own reader: with ``multi_line`` a task reads a whole file."""
    return spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", multi_line)


def csv_columns(spark: SparkSession, path: str | list[str], multi_line: bool = True) -> list[str]:
    return csv_reader(spark, multi_line).csv(path).columns


def _missing(name: str) -> Column:
    value = F.col(f"`{name}`")
    return F.when(~value.isin(list(domain.CSV_MISSING)), value).alias(name)


def csv_rows(spark: SparkSession, path: str | list[str], names: Sequence[str], multi_line: bool, absent: str | None = None) -> DataFrame:
    """The rows behind the header, every column a text, with the file and the number of the row in it (from 1) where lines are split.

    With ``multi_line`` fields may hold line breaks; files are split all the same.
    """
    if multi_line:
        texts = split_csv.csv_texts(spark, path).where("record > 0")
        return texts.select("source_path", "record", split_csv.fields("text", names, absent).alias("r")).select("source_path", "record", "r.*")
    schema = StructType([StructField(n, StringType()) for n in names])
    reader = csv_reader(spark, False).schema(schema).option("enforceSchema", True)
    return (reader.option("nullValue", absent) if absent else reader).csv(path)


def read_labeled_csv(spark: SparkSession, path: str | list[str], multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """Rows of a labelled CSV, and one row of statistics on what was skipped.

    A row with more fields than the header is skipped and counted; a shorter
    one is kept with nulls. Files without line breaks inside fields are read faster with ``multi_line=False``.
    """
    names = csv_columns(spark, path, multi_line)
    rows = csv_rows(spark, path, [*names, OVERFLOW], multi_line, ABSENT)
    skipped = F.count_if(F.col(OVERFLOW).isNotNull())
    stats = rows.agg(skipped.alias("csv_bad_rows_skipped"), F.count(F.lit(1)).alias("rows_seen")).select(
        F.when(F.col("csv_bad_rows_skipped") > 0, "skip_bad_lines").otherwise("strict").alias("csv_parse_mode"),
        "csv_bad_rows_skipped", (F.col("rows_seen") - F.col("csv_bad_rows_skipped")).alias("rows_kept"),
    )
    return rows.where(F.col(OVERFLOW).isNull()).select(*[_missing(n) for n in names]), stats


def read_raw_logs(spark: SparkSession, path: str | list[str], multi_line: bool = True) -> DataFrame:
    """Any CSV with its text column renamed to ``message``; all columns are text."""
    names = csv_columns(spark, path, multi_line)
    return with_text_column(csv_rows(spark, path, names, multi_line).select(*[F.col(f"`{n}`") for n in names]))


def read_golden(
    spark: SparkSession,
    path: str | list[str],
    message_aliases: Sequence[str] = domain.GOLDEN_MESSAGE_COLUMNS,
    label_aliases: Sequence[str] = domain.GOLDEN_LABEL_COLUMNS,
    check: bool = True,
) -> DataFrame:
    """Golden rows ``line_number, message, label``; numbering starts at 2 in each file.

    An empty message or label, or a file without rows, is an error that names the first such row.
    """
    names = csv_columns(spark, path, True)
    message = resolve_column(names, message_aliases, "message")
    label = resolve_column(names, label_aliases, "label")
    rows = csv_rows(spark, path, names, True)
    golden = rows.select((F.col("record") + 1).alias("line_number"), strip(f"`{message}`").alias("message"), strip(f"`{label}`").alias("label"))
    if check:
        bad = golden.agg(
            F.count(F.lit(1)).alias("rows"), F.min(F.when(F.col("message") == "", F.col("line_number"))).alias("no_message"),
            F.min(F.when(F.col("label") == "", F.col("line_number"))).alias("no_label"),
        ).first()
        if bad["no_message"] is not None:
            raise ValueError(f"golden row {bad['no_message']} has no message")
        if bad["no_label"] is not None:
            raise ValueError(f"golden row {bad['no_label']} has no label")
        if not bad["rows"]:
            raise ValueError("the golden set has no rows")
    return golden


def read_event_stream(spark: SparkSession, path: str | None = None, fmt: str = "text", options: dict[str, str] | None = None) -> DataFrame:
    """Event payloads as a stream (``received_at, payload``), each a JSON object.

    ``text`` takes one event per line from a folder. Other formats, such as
    ``kafka``, take the bytes of ``value`` and their time from ``timestamp``.
    """
    reader = spark.readStream.format(fmt).options(**(options or {}))
    if fmt == "text":
        raw = reader.load(path).select(F.col("value").alias("raw"), F.col("_metadata.file_modification_time").alias("received_at"))
    else:
        source = reader.load(path) if path else reader.load()
        raw = source.select(F.col("value").cast("string").alias("raw"), F.col("timestamp").alias("received_at"))
    stamp = F.date_format("received_at", "yyyy-MM-dd'T'HH:mm:ssXXX")
    return raw.where(strip("raw") != "").select("received_at", normalize_payload("raw", stamp).alias("payload"))
