"""Writing of labelled rows, predictions, reports, lineage and data versions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from logloom.functions.text import strip
from logloom.operators.dataset import dataset_fingerprint


def write_labeled_csv(df: DataFrame, path: str, message: str = "message", label: str = "class") -> None:
    """Two columns, ``LogMessage`` and ``class``; every task writes its own file."""
    df.select(F.col(message).alias("LogMessage"), F.col(label).alias("class")).write.option("header", True).option(
        "quote", '"'
    ).option("escape", '"').mode("overwrite").csv(path)


def write_predictions(df: DataFrame, path: str) -> None:
    names = ("line_number", "message", "true_label", "predicted_label", "match")
    df.select(*names).write.option("header", True).option("quote", '"').option("escape", '"').mode("overwrite").csv(path)


def write_report(report: DataFrame, root: str) -> None:
    """Add a report to the history; the latest one is found by query, not kept as a copy."""
    report.write.mode("append").parquet(root)


def append_lineage(record: DataFrame, root: str) -> None:
    record.write.mode("append").parquet(root)


def table_or_none(spark: SparkSession, root: str, merge: bool = True) -> DataFrame | None:
    """The table, or none where nothing has been written yet; any other fault is raised."""
    try:
        return spark.read.option("mergeSchema", merge).parquet(root)
    except AnalysisException as fault:
        if fault.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def read_lineage(spark: SparkSession, root: str) -> DataFrame:
    """The latest lineage record of each data set."""
    records = spark.read.option("mergeSchema", True).parquet(root)
    return latest_lineage(records)


def latest_lineage(records: DataFrame) -> DataFrame:
    last = F.max_by(F.struct(*records.columns), F.struct("created_at", F.xxhash64(*records.columns)))
    return records.groupBy(F.col("dataset_id").alias("__id")).agg(last.alias("r")).select("r.*")


def archive_dataset(df: DataFrame, root: str, metadata: Mapping[str, str] | None = None, created_at=None) -> str:
    """Store a data set under its content id, once, with its metadata.

    An id that is there already is not written again. Metadata rows are only
    added; blank values are left out, and readers keep the first ``created_at``.
    """
    spark = df.sparkSession
    found = dataset_fingerprint(df).first()
    version = found["data_version_id"]
    known = table_or_none(spark, f"{root}/versions")
    if known is None or known.where(F.col("data_version_id") == version).isEmpty():
        df.write.mode("overwrite").parquet(f"{root}/data/data_version_id={version}")
    notes = {k: v.strip() for k, v in (metadata or {}).items() if v is not None and v.strip()}
    stamp = F.current_timestamp() if created_at is None else F.lit(created_at).cast("timestamp")
    pairs = [F.lit(x) for item in notes.items() for x in item]
    values = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    row = spark.range(1).select(
        F.lit(version).alias("data_version_id"), F.lit(found["row_count"]).cast("bigint").alias("row_count"),
        stamp.alias("created_at"), values.alias("metadata"),
    )
    row.write.mode("append").parquet(f"{root}/versions")
    return version


def data_versions(spark: SparkSession, root: str) -> DataFrame:
    """Stored versions: first time seen, and the last non-blank value of each metadata key."""
    rows = spark.read.parquet(f"{root}/versions")
    notes = (
        rows.select("data_version_id", "created_at", F.explode("metadata"))
        .where(strip("value") != "")
        .groupBy("data_version_id", "key")
        .agg(F.max_by("value", "created_at").alias("value"))
        .groupBy("data_version_id")
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("metadata"))
    )
    heads = rows.groupBy("data_version_id").agg(F.min("created_at").alias("created_at"), F.max("row_count").alias("row_count"))
    return heads.join(notes, "data_version_id", "left")


def write_report_with_latest(report: DataFrame, root: str) -> None:
    """Add a report to ``root/history`` and put it as JSON in ``root/latest``, next to it.

    The copy is for people and other programs. It follows the history: a run that stops between the two is made good by
    the next report, and ``latest_reports`` never reads the copy.
    """
    report.write.mode("append").parquet(f"{root}/history")
    report.coalesce(1).write.mode("overwrite").json(f"{root}/latest")


def latest_reports(spark: SparkSession, root: str, keys: Sequence[str], order: Sequence[str] = ("created_at",)) -> DataFrame:
    """The newest report of each key from the history."""
    history = spark.read.option("mergeSchema", True).parquet(f"{root}/history")
    newest = F.max_by(F.struct(*history.columns), F.struct(*order, F.xxhash64(*history.columns)))
    return history.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(newest.alias("r")).select("r.*")
