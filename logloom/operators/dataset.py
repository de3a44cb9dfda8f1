"""Labelled data sets: filters, counts, profiles, fingerprints, previews."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logloom import domain
from logloom.functions.labels import label_id, normalize_label
from logloom.functions.text import sanitize_cell, template_group
from logloom.operators.indexing import with_order_index
from logloom.session import checkpointed


def label_rows_table(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """One row per label of the domain, in order."""
    rows = [(i, label) for i, label in enumerate(labels)]
    return df.sparkSession.createDataFrame(rows, "label_index int, label string")


def valid_labeled(df: DataFrame, message: str = "message", label: str = "class", check: bool = False) -> DataFrame:
    """Rows with a message and a known label, the label in its standard form and as id."""
    valid = (
        df.withColumn(label, normalize_label(label, strict=False))
        .withColumn("label", label_id(label))
        .where(F.col(message).isNotNull() & F.col("label").isNotNull())
    )
    if check and valid.isEmpty():
        raise ValueError("no valid rows after mapping the labels")
    return valid


def valid_feedback_base(df: DataFrame, message: str = "message", label: str = "class") -> DataFrame:
    """Rows with a non-empty message and a known label."""
    return df.withColumn(label, normalize_label(label)).where((F.col(message) != "") & (F.col(label) != ""))


def label_distribution(df: DataFrame, label: str = "class", labels: Sequence[str] = domain.LABELS) -> DataFrame:
    """Rows per label, 0 for labels of the domain without rows."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return (
        label_rows_table(df, labels)
        .join(counts, "label", "left")
        .select("label", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
    )


def group_distribution(df: DataFrame, message: str = "message") -> DataFrame:
    return df.groupBy(template_group(message).alias("template_group")).agg(F.count(F.lit(1)).alias("n"))


def dataset_profile(df: DataFrame, label: str = "class") -> DataFrame:
    """Row count, column names and rows per label as a long table.

    One aggregation: the total is the sum of the label counts, taken over one
    row per label.
    """
    per_label = df.groupBy(F.col(label).cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    total = per_label.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    columns = df.sparkSession.createDataFrame([(c, i) for i, c in enumerate(df.columns)], "key string, n bigint")
    return (
        total.select(F.lit("row_count").alias("item"), F.lit("").alias("key"), "n")
        .unionByName(columns.select(F.lit("column").alias("item"), "key", "n"))
        .unionByName(per_label.select(F.lit("label").alias("item"), F.coalesce("key", F.lit("")).alias("key"), "n"))
    )


def row_digest(columns: Sequence[str | Column]) -> Column:
    parts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("\x00")) for c in columns]
    return F.md5(F.concat_ws("\x1f", *parts).cast("binary"))


def row_numbers(columns: Sequence[str | Column]) -> list[Column]:
    """Two 60-bit numbers of a row; their sums over a table do not depend on the order of its rows."""
    digest = row_digest(columns)
    return [F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(38,0)") for at in (1, 17)]


def content_id(columns: Sequence[str], rows: Column, first: Column, second: Column) -> Column:
    """The id of a table from its columns, its number of rows and the sums of their numbers, all as text."""
    return F.sha2(F.concat_ws("|", F.lit(",".join(columns)), rows, first, second), 256)


def dataset_fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Content id of a table that does not depend on the order of its rows.

    Each row gives two 60-bit numbers from its digest; count and sums are
    folded into one hash. One aggregation with partial sums, no sort.
    """
    columns = list(columns or df.columns)
    numbers = row_numbers(columns)
    sums = df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.coalesce(F.sum(numbers[0]), F.lit(0)).cast("string").alias("s1"),
        F.coalesce(F.sum(numbers[1]), F.lit(0)).cast("string").alias("s2"),
    )
    return sums.select(content_id(columns, F.col("row_count").cast("string"), F.col("s1"), F.col("s2")).alias("data_version_id"), "row_count")


def preview(df: DataFrame, order: Sequence[str], rows: int = 100, cell_chars: int = 200) -> DataFrame:
    """The first rows in a fixed order with long cells cut."""
    first = df.orderBy(*order).limit(rows)
    return first.select(*[sanitize_cell(c, cell_chars).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])


def leakage_check(df: DataFrame, split: str = "split", group: str = "template_group") -> DataFrame:
    """Groups found on more than one side; empty when the split leaks nothing."""
    return (
        df.groupBy(group)
        .agg(F.min(split).alias("first_side"), F.max(split).alias("last_side"), F.count(F.lit(1)).alias("n"))
        .where(F.col("first_side") != F.col("last_side"))
        .select(group, "n")
    )


def split_report(df: DataFrame, split: str = "split", group: str = "template_group", label: str = "class") -> DataFrame:
    """Rows, template groups and rows per label of each side, as a long table.

    Rows are counted per (side, label, group) first, so the distinct count
    works on groups and not on rows.
    """
    cells = df.groupBy(split, label, group).agg(F.count(F.lit(1)).alias("n"))
    groups = cells.select(split, group).distinct().groupBy(split).agg(F.count(F.lit(1)).alias("n"))
    per_label = cells.groupBy(split, label).agg(F.sum("n").alias("n"))
    rows = per_label.groupBy(split).agg(F.sum("n").alias("n"))
    none = F.lit("")
    return (
        rows.select(split, F.lit("rows").alias("item"), none.alias("key"), "n")
        .unionByName(groups.select(split, F.lit("template_groups").alias("item"), none.alias("key"), "n"))
        .unionByName(per_label.select(split, F.lit("label").alias("item"), F.col(label).alias("key"), "n"))
    )


def ordered_fingerprint(df: DataFrame, order: Sequence[str | Column], columns: Sequence[str] | None = None, fan: int = 4096) -> DataFrame:
    """Content id of a table that depends on the order of its rows, and on nothing else: data_version_id, row_count.

    Rows are numbered over all tasks. The digests of ``fan`` rows in a row make up a block's, those of ``fan``
    blocks the next one's, until one is left, so no task sees more than ``fan`` digests and the id is the same for
    any partitioning. Rows that are equal in ``order`` must be equal in ``columns`` for the id to be fixed.
    """
    columns = list(columns or df.columns)
    named = all(isinstance(c, str) for c in order)
    digested = df.select(*(order if named else df.columns), row_digest(columns).alias("digest"))
    rows = with_order_index(digested, list(order), name="place").select("place", "digest")
    # Blocks of rows are written, as their number tells how many levels there are.
    level = checkpointed(_block_digests(rows, fan).withColumn("rows", F.col("n")).drop("n"))
    total = level.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("row_count"), F.count(F.lit(1)).alias("blocks")).first()
    blocks, top = total["blocks"], level.select("place", "digest")
    while blocks > 1:
        top, blocks = _block_digests(top, fan).drop("n"), -(-blocks // fan)
    head = F.concat_ws("|", F.lit(",".join(columns)), F.lit(str(total["row_count"])), F.coalesce(F.max("digest"), F.lit("")))
    return top.agg(F.sha2(head, 256).alias("data_version_id")).withColumn("row_count", F.lit(total["row_count"]).cast("bigint"))


def _block_digests(rows: DataFrame, fan: int) -> DataFrame:
    inside = F.array_sort(F.collect_list(F.struct("place", "digest")))
    digest = F.sha2(F.array_join(F.transform(inside, lambda r: r["digest"]), ""), 256)
    return rows.groupBy(F.floor(F.col("place") / fan).alias("block")).agg(digest.alias("digest"), F.count(F.lit(1)).alias("n")).withColumnRenamed("block", "place")


def file_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """The sha256 of each file's bytes, and its size. A file is read as one value, so it may have 2 GB at most; empty files are not listed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.col("_metadata.file_name").alias("source_file"), F.sha2("content", 256).alias("file_sha256"), F.col("length").alias("bytes"))
