"""CSV with line breaks inside quoted fields, read by many tasks per file.

Files are read as lines, in splits. What a line does to the quotes is a function of whether a quoted field is
open where it begins: it leaves that as it is, turns it round, or ends open or closed whatever came before. Such functions
can be put together, so the state at the start of each split follows from one row per split, and the state at
each line from the lines of its split. A record begins at each line that is met with quotes closed; lines that are
met with quotes open go to the record before, which may have begun in another split. Quotes count only where a field
begins with one, as in the readers of Spark and pandas; a doubled quote is a quote.

Empty lines between records are no records. Line breaks inside fields come back as ``\\n``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from logloom.session import checkpointed

SPLIT = ["source_path", "block_start"]
# A quoted field with what may stand behind its closing quote, and a plain one.
_BODY = r'[^"]*+(?:""[^"]*+)*+'
_FIELD = rf'(?:"{_BODY}"[^,]*+|[^",][^,]*+|)'
#: A line that begins with quotes closed and ends within a quoted field.
OPENS = rf'^(?:{_FIELD},)*+"{_BODY}$'
#: A line that begins within a quoted field and ends within this one or a later one.
STAYS = rf'^{_BODY}(?:$|"[^,]*+,(?:{_FIELD},)*+"{_BODY}$)'
MARK = "\ufeff"


def _quoted_lines(spark: SparkSession, path: str | list[str], glob: str | None) -> DataFrame:
    reader = spark.read.option("recursiveFileLookup", True) if glob else spark.read
    lines = (reader.option("pathGlobFilter", glob) if glob else reader).text(path)
    placed = lines.select(
        "value", F.col("_metadata.file_path").alias("source_path"), F.col("_metadata.file_name").alias("source_file"),
        F.col("_metadata.file_block_start").alias("block_start"), F.monotonically_increasing_id().alias("at"),
    )
    # A byte order mark can only stand before the first line of a file.
    text = F.when((F.col("block_start") == 0) & F.startswith("value", F.lit(MARK)), F.substring("value", 2, 2**30)).otherwise(F.col("value"))
    plain = ~F.contains(F.col("value"), F.lit('"'))
    return placed.withColumn("valid", F.is_valid_utf8("value")).withColumn("value", text).withColumns(
        {"if_closed": F.when(plain, False).otherwise(F.rlike("value", F.lit(OPENS))), "if_open": F.when(plain, True).otherwise(F.rlike("value", F.lit(STAYS)))}
    )


def _state(start: bool) -> Column:
    """Whether a quoted field is open before a row, if it was (``start``) before the first row of the window.

    The last row before it that ends alike either way settles it; rows that turn it round count from there on.
    """
    since = F.col("turns") - F.coalesce(F.col("settled")["turns"], F.lit(0))
    return F.coalesce(F.col("settled")["open"], F.lit(start)) != (since % 2 == 1)


def _with_history(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Adds what ``_state`` needs: how many rows before this one turn the state round, and the last one that settles it."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    turns = (F.col("if_closed") & ~F.col("if_open")).cast("bigint")
    counted = df.withColumn("__upto", F.sum(turns).over(upto)).withColumn("turns", F.col("__upto") - turns)
    same = F.when(F.col("if_closed") == F.col("if_open"), F.struct(F.col("if_closed").alias("open"), F.col("__upto").alias("turns")))
    return counted.withColumn("settled", F.last(same, ignorenulls=True).over(before)).drop("__upto")


def csv_lines(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """Every line: source_path, source_file, record (its number in the file, from 0), block_start, at, value, valid (UTF-8),
    line (within the split, from 1), first (begins a record) and goes_on (ends within a quoted field)."""
    lines = _with_history(_quoted_lines(spark, path, glob), SPLIT, "at")
    state = {f"open{s}": _state(bool(s)) for s in (0, 1)}
    begins = lambda s: (~F.col(f"open{s}") & (F.col("value") != "")).cast("bigint")
    upto = Window.partitionBy(*SPLIT).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    told = lines.withColumns(state).withColumns({f"begun{s}": F.sum(begins(s)).over(upto) for s in (0, 1)} | {"line": F.count(F.lit(1)).over(upto)})
    told = checkpointed(told.drop("turns", "settled"))
    last = lambda c: F.max_by(c, "at")
    ends = [F.when(F.col(f"open{s}"), F.col("if_open")).otherwise(F.col("if_closed")) for s in (0, 1)]
    splits = told.groupBy(*SPLIT).agg(last(ends[0]).alias("if_closed"), last(ends[1]).alias("if_open"), last("begun0").alias("begun0"), last("begun1").alias("begun1"))
    splits = _with_history(splits, ["source_path"], "block_start").withColumn("start_open", _state(False))
    begun = F.when(F.col("start_open"), F.col("begun1")).otherwise(F.col("begun0"))
    before = Window.partitionBy("source_path").orderBy("block_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("records_before", F.coalesce(F.sum(begun).over(before), F.lit(0))).select(*SPLIT, "start_open", "records_before")
    placed = told.join(splits, SPLIT)
    pick = lambda a, b: F.when(F.col("start_open"), F.col(b)).otherwise(F.col(a))
    open_before, begun = pick("open0", "open1"), pick("begun0", "begun1")
    return placed.select(
        "source_path", "source_file", (F.col("records_before") + begun - 1).alias("record"), "block_start", "at", "value", "valid", "line",
        (~open_before).alias("first"), F.when(open_before, F.col("if_open")).otherwise(F.col("if_closed")).alias("goes_on"),
    )


def csv_texts(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """Every record as its text: source_path, source_file, record, text. Only records of several lines are brought together."""
    return record_texts(csv_lines(spark, path, glob))


def record_texts(lines: DataFrame) -> DataFrame:
    lines = lines.where(~F.col("first") | (F.col("value") != ""))
    columns = ["source_path", "source_file", "record"]
    whole = F.col("first") & ~F.col("goes_on")
    single = lines.where(whole).select(*columns, F.col("value").alias("text"))
    parts = lines.where(~whole).groupBy(*columns).agg(F.array_sort(F.collect_list(F.struct("block_start", "at", "value"))).alias("parts"))
    return single.unionByName(parts.select(*columns, F.array_join(F.transform("parts", lambda p: p["value"]), "\n").alias("text")))


def fields(text: Column | str, names: Sequence[str], absent: str | None = None) -> Column:
    """The fields of a record as a struct of texts; those a short record lacks are null, and empty ones where ``absent`` is not given."""
    quoted = ", ".join("`" + n.replace("`", "``") + "` string" for n in names)
    options = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "maxCharsPerColumn": "-1"} | ({"nullValue": absent} if absent else {})
    return F.from_csv(text, quoted, options)
