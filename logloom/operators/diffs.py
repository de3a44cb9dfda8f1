"""Unified diffs between versions of a text.

Two versions are matched line by line as the standard library does it (the longest run of common lines, then
to its left and right), so the hunks are those a user of ``difflib`` knows. That work is done per pair of versions, in
Arrow batches; pairs are spread over all tasks, and a version that precedes many others is a hot key that is
split. Hunks come as rows, so their text, their balance and the check that they lead from the old version to the
new one are plain column functions.

Lines end as in ``str.splitlines``; a line break at the very end opens no further line. Versions that differ
in their line breaks only have no hunks. A null text has no lines.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from logloom.functions.text import text_lines
from logloom.operators.skew import spread_join, spread_rows

CONTEXT = 3
PAIR = ["version_id", "previous_version_id"]
HUNK = "version_id string, previous_version_id string, hunk int, old_start int, old_lines int, new_start int, new_lines int, lines array<string>"


def _start(first: int, lines: int) -> int:
    """Lines count from 1; a range without lines is named by the line before it."""
    return first + 1 if lines else first


def hunks_of(old: list[str], new: list[str], context: int = CONTEXT) -> Iterator[tuple[int, int, int, int, list[str]]]:
    """(old start, old lines, new start, new lines, marked lines) of each hunk."""
    for group in SequenceMatcher(None, old, new).get_grouped_opcodes(context):
        (_, old_from, _, new_from, _), (_, _, old_to, _, new_to) = group[0], group[-1]
        lines = []
        for kind, a, b, c, d in group:
            if kind == "equal":
                lines += [" " + line for line in old[a:b]]
            else:
                lines += ["-" + line for line in old[a:b]] + ["+" + line for line in new[c:d]]
        sizes = old_to - old_from, new_to - new_from
        yield _start(old_from, sizes[0]), sizes[0], _start(new_from, sizes[1]), sizes[1], lines


def _diffed(context: int):
    names = [c.split()[0] for c in HUNK.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, size = [], 0
            for version, previous, old, new in zip(batch["version_id"], batch["previous_version_id"], batch["old"], batch["new"], strict=True):
                for n, hunk in enumerate(hunks_of((old or "").splitlines(), (new or "").splitlines(), context)):
                    rows.append((version, previous, n, *hunk))
                    size += len(hunk[4])
                if size > 100_000:
                    yield pd.DataFrame(rows, columns=names)
                    rows, size = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=names)

    return run


def version_pairs(history: DataFrame) -> DataFrame:
    """Each version with its predecessor, once, whatever the number of histories that hold the pair."""
    return history.where(F.col("previous_version_id") != "").select(*PAIR).distinct()


def _with_text(pairs: DataFrame, texts: DataFrame, key: str, name: str) -> DataFrame:
    return spread_join(pairs, texts.select(F.col("version_id").alias(key), F.col("text").alias(name)), [key], hot_rows=10_000)


def unified_diffs(history: DataFrame, versions: DataFrame, context: int = CONTEXT) -> DataFrame:
    """The hunks of each pair of versions: where they are, and their lines with `` ``, ``-`` or ``+`` in front."""
    texts = versions.groupBy("version_id").agg(F.first("text").alias("text"))
    both = _with_text(_with_text(version_pairs(history), texts, "version_id", "new"), texts, "previous_version_id", "old")
    return spread_rows(both.select(*PAIR, "old", "new")).mapInPandas(_diffed(context), HUNK)


def _range(start: str, lines: str) -> Column:
    return F.when(F.col(lines) == 1, F.col(start).cast("string")).otherwise(F.concat_ws(",", start, lines))


def hunk_header(mark: str = "@@") -> Column:
    return F.concat(F.lit(f"{mark} -"), _range("old_start", "old_lines"), F.lit(" +"), _range("new_start", "new_lines"), F.lit(f" {mark}"))


def diff_texts(history: DataFrame, hunks: DataFrame, old_label: Column | None = None, new_label: Column | None = None) -> DataFrame:
    """The diff of each pair as one text; empty where there are no hunks. Labels are the first 12 characters of the ids."""
    old = F.substring("previous_version_id", 1, 12) if old_label is None else old_label
    new = F.substring("version_id", 1, 12) if new_label is None else new_label
    parts = hunks.select(*PAIR, "hunk", F.concat(F.array(hunk_header()), "lines").alias("part"))
    whole = parts.groupBy(*PAIR).agg(F.array_sort(F.collect_list(F.struct("hunk", "part"))).alias("parts"))
    lines = F.flatten(F.transform("parts", lambda p: p["part"]))
    text = F.array_join(F.concat(F.array(F.concat(F.lit("--- "), old), F.concat(F.lit("+++ "), new)), lines), "\n")
    return version_pairs(history).join(whole, PAIR, "left").select(*PAIR, F.when(F.col("parts").isNull(), "").otherwise(text).alias("diff"))


def applied(history: DataFrame, hunks: DataFrame, versions: DataFrame) -> DataFrame:
    """The lines that come out when each pair's hunks are applied to its old version.

    A hunk that does not fit the old version, by its place or its lines, stops the job.
    """
    texts = versions.groupBy("version_id").agg(F.first("text").alias("text"))
    # 1-based first line of a hunk in the old version; a hunk without old lines goes behind the line it names.
    first = F.col("old_start") + F.when(F.col("old_lines") == 0, 1).otherwise(0)
    kept = F.transform(F.filter("lines", lambda x: ~x.startswith("+")), lambda x: F.substring(x, 2, 2**30))
    added = F.transform(F.filter("lines", lambda x: ~x.startswith("-")), lambda x: F.substring(x, 2, 2**30))
    changes = hunks.groupBy(*PAIR).agg(F.array_sort(F.collect_list(F.struct("hunk", first.alias("first"), "old_lines", kept.alias("old"), added.alias("new")))).alias("hunks"))
    pairs = _with_text(version_pairs(history).join(changes, PAIR, "left"), texts, "previous_version_id", "text")
    pairs = pairs.withColumns({"old": text_lines("text"), "hunks": F.coalesce("hunks", F.expr("array()").cast(changes.schema["hunks"].dataType))})
    end_of = lambda h: h["first"] + h["old_lines"]
    before = lambda i: F.when(i == 0, 1).otherwise(end_of(F.get("hunks", i - 1)))
    piece = lambda h, i: F.concat(F.slice("old", before(i), F.greatest(h["first"] - before(i), F.lit(0))), h["new"])
    fits = F.forall("hunks", lambda h: F.slice("old", h["first"], h["old_lines"]) == h["old"])
    tail_at = F.when(F.size("hunks") == 0, 1).otherwise(end_of(F.get("hunks", F.size("hunks") - 1)))
    tail = F.slice("old", tail_at, F.greatest(F.size("old") - tail_at + 1, F.lit(0)))
    lines = F.concat(F.flatten(F.transform("hunks", piece)), tail)
    return pairs.select(*PAIR, F.when(fits, lines).otherwise(F.raise_error(F.lit("a hunk does not fit the old version")).cast("array<string>")).alias("lines"))


def line_balance(hunks: DataFrame) -> DataFrame:
    """``change`` per pair and line: how often it was added, or below 0 removed. A line that only moved is not listed."""
    lines = hunks.select(*PAIR, F.explode("lines").alias("marked")).where(~F.col("marked").startswith(" "))
    sign = F.when(F.col("marked").startswith("+"), 1).otherwise(-1)
    return lines.groupBy(*PAIR, F.substring("marked", 2, 2**30).alias("line")).agg(F.sum(sign).alias("change")).where("change <> 0")
