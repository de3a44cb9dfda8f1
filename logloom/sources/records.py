"""Records to score from files of any format."""

from __future__ import annotations

import csv
import io

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logloom.functions.payload import extract_message, payload_map
from logloom.functions.text import strip
from logloom.operators.indexing import with_file_position, with_row_index
from logloom.session import checkpointed
from logloom.sources import split_csv

KNOWN = ("csv", "json", "jsonl", "txt", "log")


def _wrapped(text: Column) -> Column:
    return F.to_json(F.struct(text.alias("errorMessage")))


def _as_record(item: Column) -> Column:
    """An object as it is, anything else as the message of a record."""
    literal = F.when(item.startswith('"'), F.coalesce(F.get_json_object(item, "$"), item)).otherwise(item)
    return F.when(payload_map(item).isNotNull(), item).otherwise(_wrapped(literal))


def _reader(spark: SparkSession, suffix: str):
    # Suffixes count in any case; each file is read by exactly one reader.
    either = "".join(f"[{c.lower()}{c.upper()}]" for c in suffix)
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{either}")


NOT_UTF8 = "not valid UTF-8"
RECORD = ["source_file", "row_index", "payload", "error"]


def _good(rows: DataFrame, payload: Column) -> DataFrame:
    return rows.select("source_file", F.col("row_index").cast("bigint").alias("row_index"), payload.alias("payload"), F.lit(None).cast("string").alias("error"))


def _faults(files: DataFrame, error: Column) -> DataFrame:
    """One record with number -1 for each file that could not be read to its end."""
    return files.select("source_file", F.lit(-1).cast("bigint").alias("row_index"), F.lit("").alias("payload"), error.alias("error"))


def _up_to_fault(rows: DataFrame, bad: DataFrame, of_file: str = "source_path") -> DataFrame:
    """Rows before the first fault of their file (``bad``: file, row_index). There are faults in few files, so this join seldom shuffles."""
    first = bad.groupBy(of_file).agg(F.min("row_index").alias("__fault"))
    return rows.join(first, of_file, "left").where(F.col("__fault").isNull() | (F.col("row_index") < F.col("__fault"))).drop("__fault")


def _lines(spark: SparkSession, path: str, suffix: str) -> tuple[DataFrame, DataFrame]:
    """Non-blank lines, numbered per file, up to the first that is no UTF-8, and the files that hold one; large files are read in splits."""
    lines = with_file_position(_reader(spark, suffix).text(path).select("value", "_metadata"))
    valid = F.is_valid_utf8("value")
    kept = lines.select(F.when(valid, strip("value")).alias("value"), "source_path", "source_file", "block_start").where("value IS NULL OR value <> ''")
    numbered = with_row_index(kept)
    bad = numbered.where("value IS NULL")
    return _up_to_fault(numbered.where("value IS NOT NULL"), bad), bad.select("source_path", "source_file").distinct()


def text_records(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    lines, broken = _lines(spark, path, suffix)
    return _good(lines, _wrapped(F.col("value"))).unionByName(_faults(broken, F.lit(NOT_UTF8)))


def line_records(spark: SparkSession, path: str, suffix: str = "jsonl") -> DataFrame:
    """One JSON value per line; a line that is no JSON becomes a message."""
    lines, broken = _lines(spark, path, suffix)
    return _good(lines, _as_record(F.col("value"))).unionByName(_faults(broken, F.lit(NOT_UTF8)))


def _whole_files(spark: SparkSession, path: str, reader) -> tuple[DataFrame, DataFrame]:
    """The text of each file, null where it is no UTF-8, and the files that cannot be read at all, such as a cut archive.

    Spark leaves such files out when asked to; a list of all files, for which none is opened, tells which those are.
    """
    whole = reader(spark).option("ignoreCorruptFiles", True).text(path, wholetext=True)
    texts = whole.select(F.when(F.is_valid_utf8("value"), strip("value")).alias("value"), F.col("_metadata.file_path").alias("source_path"), F.col("_metadata.file_name").alias("source_file"))
    files = reader(spark).format("binaryFile").load(path).where("length > 0").select(F.col("_metadata.file_path").alias("source_path"), F.col("_metadata.file_name").alias("source_file"))
    return texts, files.join(texts.select("source_path"), "source_path", "left_anti")


def json_records(spark: SparkSession, path: str) -> DataFrame:
    """Items of an array, or of the array ``items`` of an object, or the document itself.

    A document that cannot be read gives one record with number -1 and the error.
    """
    whole, lost = _whole_files(spark, path, lambda spark: _reader(spark, "json"))
    items = F.when(F.col("value").startswith("["), F.from_json("value", "array<string>")).when(
        F.col("value").startswith("{") & F.ltrim(F.get_json_object("value", "$.items")).startswith("["),
        F.from_json(F.get_json_object("value", "$.items"), "array<string>"),
    )
    valid = F.try_parse_json("value").isNotNull()
    good = whole.where(valid).select("source_file", F.posexplode(F.coalesce(items, F.array("value"))).alias("row_index", "item"))
    error = F.when(F.col("value").isNull(), NOT_UTF8).otherwise("not valid JSON")
    broken = _faults(whole.where(F.col("value").isNull() | ~valid), error).unionByName(_faults(lost, F.lit("cannot be read")))
    return _good(good, _as_record(F.coalesce("item", F.lit("")))).unionByName(broken)


#: Characters of a file by which its header is told, and files whose headers are sent to all tasks.
SAMPLE, FEW_FILES = 4096, 50_000


def _header_of(samples: pd.Series, first: pd.Series) -> pd.DataFrame:
    """Whether a sample begins with a header, by the types and lengths of its columns, and the fields of the first record.

    A sample that tells nothing counts as one with a header. One row per file.
    """
    found = []
    for sample, record in zip(samples, first, strict=True):
        try:
            has_header = csv.Sniffer().has_header(sample)
        except Exception:  # noqa: BLE001  the sniffer says in many ways that it cannot tell
            has_header = True
        found.append((has_header, next(csv.reader(io.StringIO(record or "", newline="")), [])))
    return pd.DataFrame(found, columns=["has_header", "names"])


def _headers(lines: DataFrame, texts: DataFrame, header: bool | None) -> DataFrame:
    """Per file: whether it has a header, by its first characters unless told, and its names."""
    ask = F.pandas_udf(_header_of, "has_header boolean, names array<string>")
    start = lines.where((F.col("block_start") == 0) & (F.col("line") <= SAMPLE))
    start = start.groupBy("source_path").agg(F.array_sort(F.collect_list(F.struct("line", F.substring("value", 1, SAMPLE).alias("value")))).alias("l"))
    sample = F.make_valid_utf8(F.substring(F.concat(F.array_join(F.transform("l", lambda x: x["value"]), "\n"), F.lit("\n")), 1, SAMPLE))
    first = texts.where("record = 0").select("source_path", F.make_valid_utf8("text").alias("first"))
    told = start.join(first, "source_path").select("source_path", ask(sample, F.col("first")).alias("h")).select("source_path", "h.*")
    return told if header is None else told.withColumn("has_header", F.lit(header))


def csv_records(spark: SparkSession, path: str, header: bool | None = None) -> DataFrame:
    """CSV rows as records: objects with the names of the header, or, in a file without one, the first field as the message.

    Each file is asked by itself whether it has a header, unless ``header`` says so for all. All files go through
    one scan in splits; what differs between them is one row per file.
    """
    lines = split_csv.csv_lines(spark, path, "*.[cC][sS][vV]")
    texts = split_csv.record_texts(lines)
    heads = checkpointed(_headers(lines, texts, header))
    facts = heads.agg(F.count(F.lit(1)).alias("files"), F.max(F.when(F.col("has_header"), F.size("names"))).alias("widest")).first()
    names = [f"c{i}" for i in range(max(facts["widest"] or 1, 1))]
    if facts["files"] <= FEW_FILES:
        heads = F.broadcast(heads)
    rows = texts.join(heads, "source_path").where((F.col("record") > 0) | ~F.col("has_header"))
    rows = rows.select("source_path", "source_file", (F.col("record") - F.col("has_header").cast("int")).alias("row_index"), "has_header", "names", split_csv.fields("text", names).alias("f"))
    bad = lines.where(~F.col("valid")).join(heads, "source_path").select("source_path", "source_file", (F.col("record") - F.col("has_header").cast("int")).alias("row_index"))
    entries = F.arrays_zip(F.slice("names", 1, len(names)).alias("k"), F.slice(F.array(*[F.col(f"f.{n}") for n in names]), 1, F.size("names")).alias("v"))
    # Of equal names the last one counts.
    last = lambda e, i: e["v"].isNotNull() & ~F.array_contains(F.slice("names", i + 2, F.size("names")), e["k"])
    named = F.to_json(F.map_from_entries(F.filter(entries, last)))
    payload = F.when(F.col("has_header"), named).otherwise(_wrapped(F.coalesce("f.c0", F.lit(""))))
    return _good(_up_to_fault(rows, bad), payload).unionByName(_faults(bad.select("source_path", "source_file").distinct(), F.lit(NOT_UTF8)))


def other_records(spark: SparkSession, path: str) -> DataFrame:
    """Any other file: its whole trimmed text is one record."""
    whole, lost = _whole_files(spark, path, lambda spark: spark.read.option("recursiveFileLookup", True))
    suffix = F.lower(F.regexp_extract("source_file", r"\.([^.]*)$", 1))
    other = ~suffix.isin(list(KNOWN))
    named = whole.where(other).withColumn("row_index", F.lit(0))
    broken = _faults(named.where("value IS NULL"), F.lit(NOT_UTF8)).unionByName(_faults(lost.where(other), F.lit("cannot be read")))
    return _good(named.where("value <> ''"), _wrapped(F.col("value"))).unionByName(broken)


READERS = {
    "csv": csv_records,
    "json": json_records,
    "jsonl": line_records,
    "txt": lambda spark, path: text_records(spark, path, "txt"),
    "log": lambda spark, path: text_records(spark, path, "log"),
}


def union_records(*parts: DataFrame) -> DataFrame:
    """Records of all files, with the message each one holds."""
    first, *rest = parts
    for part in rest:
        first = first.unionByName(part)
    return first.select("source_file", "row_index", F.when(F.col("error").isNull(), extract_message("payload")).otherwise("").alias("message"), "payload", "error")


def read_scoring_records(spark: SparkSession, path: str, csv_header: bool | None = None, formats: tuple[str, ...] = (*KNOWN, "other")) -> DataFrame:
    """All records of all files below ``path``: ``source_file, row_index, message, payload, error``.

    A fault in a file does not stop the job: the file's records before it stay, and one with number -1 tells of it.
    """
    parts = []
    for fmt in formats:
        if fmt == "csv":
            parts.append(csv_records(spark, path, csv_header))
        elif fmt == "other":
            parts.append(other_records(spark, path))
        else:
            parts.append(READERS[fmt](spark, path))
    return union_records(*parts)
