"""Text functions on string columns, all built from Spark's own functions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

from logloom import domain

# The characters a Unicode-aware strip removes; Spark's plain trim only takes spaces.
WHITESPACE = "".join(
    map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)

# Masks of variable parts of a message, in order of use.
TEMPLATE_MASKS = (
    (r"\b\d{4}-\d{2}-\d{2}(?:[ t]\d{2}:\d{2}:\d{2})?\b", "<datetime>"),
    (r"\bts=\d+(?:\.\d+)?\b", "ts=<ts>"),
    (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "<ip>"),
    (r"\b[0-9a-f]{8,}\b", "<hex>"),
    (r"\b\d+ms\b", "<duration>"),
    (r"\buser=\d+\b", "user=<user>"),
    (r"\bstatus \d{3}\b", "status <status>"),
    (r"\b(instance )\d+\b", "$1<num>"),
    (r"\.php:\d+\b", ".php:<line>"),
    (r":\d+\b", ":<num>"),
    (r"/\d+\b", "/<id>"),
)

# Look-aheads of the masks, in the same order: cheaper to try than a word boundary.
MASK_HINTS = (
    r"(?=\d{4}-)", "(?=ts=)", r"(?=\d{1,3}\.\d)", "(?=[0-9a-f]{8})", r"(?=\d+ms)", "(?=user=)", "(?=status )", "(?=instance )", "", "", "",
)

UNICODE = "(?U)"


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(value: Column | str) -> Column:
    """Outer white space off, null as empty text."""
    return F.btrim(F.coalesce(as_column(value).cast("string"), F.lit("")), F.lit(WHITESPACE))


def casefold(value: Column | str) -> Column:
    """Lower case for comparing: sharp s, long s and final sigma as their plain forms."""
    folded = F.lower(as_column(value))
    for letter, plain in (("ß", "ss"), ("ſ", "s"), ("ς", "σ")):
        folded = F.replace(folded, F.lit(letter), F.lit(plain))
    return folded


def collapse_spaces(value: Column | str) -> Column:
    # Single spaces stay as they are, so most of a text needs no replacing.
    runs = UNICODE + r" \s+|[\s&&[^ ]]\s*"
    return strip(F.regexp_replace(F.coalesce(as_column(value), F.lit("")), runs, " "))


def template_group(text: Column | str) -> Column:
    """The message with its variable parts masked; rows with equal groups are near copies."""
    def mask(acc: Column, rule: tuple[tuple[str, str], str]) -> Column:
        (pattern, shown), ahead = rule
        return F.regexp_replace(acc, UNICODE + ahead + pattern, shown)

    group = collapse_spaces(reduce(mask, zip(TEMPLATE_MASKS, MASK_HINTS), casefold(strip(text))))
    # Not a condition on the group, which would work it out twice.
    return F.regexp_replace(group, r"\A\z", "<empty>")


def truncate_text(text: Column | str, max_chars: int = 4000, suffix: str = "\n...[truncated]", reserve: int = 30) -> Column:
    value = F.coalesce(as_column(text), F.lit(""))
    cut = F.concat(F.substring(value, 1, max_chars - reserve), F.lit(suffix))
    return F.when(F.length(value) <= max_chars, value).otherwise(cut)


def summary_text(text: Column | str, max_chars: int = 240, default: str = "Log event", suffix: str = "...[truncated]") -> Column:
    flat = collapse_spaces(text)
    flat = F.when(flat == "", F.lit(default)).otherwise(flat)
    head = F.rtrim(F.substring(flat, 1, max(1, max_chars - len(suffix))))
    return F.when(F.length(flat) <= max_chars, flat).otherwise(F.concat(head, F.lit(suffix)))


def match_text(text: Column | str) -> Column:
    """The key under which two summaries count as the same."""
    return casefold(collapse_spaces(text))


def sanitize_cell(text: Column | str, max_chars: int = 200, suffix: str = "...<truncated>") -> Column:
    value = as_column(text)
    return F.when(F.length(value) <= max_chars, value).otherwise(
        F.concat(F.substring(value, 1, max_chars), F.lit(suffix))
    )


def text_sha256(text: Column | str) -> Column:
    return F.sha2(as_column(text), 256)


def line_count(text: Column | str) -> Column:
    """Lines of a text; a line break at the very end opens no further line."""
    value = as_column(text)
    breaks = F.length(value) - F.length(F.replace(value, F.lit("\n"), F.lit("")))
    return F.when(F.length(value) == 0, 0).otherwise(breaks + F.when(value.endswith("\n"), 0).otherwise(1))


# Line ends as in Python's str.splitlines.
LINE_END = r"(?:\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029])"


def text_lines(text: Column | str) -> Column:
    """The lines of a text; a line end at the very end opens no further line, and null has no lines."""
    value = F.coalesce(as_column(text), F.lit(""))
    return F.when(value == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(value, LINE_END + r"\z", ""), LINE_END, -1))


def commit_sha(value: Column | str) -> Column:
    """The longest run of 7 to 40 hex digits, the first of equals, or empty text."""
    found = F.regexp_extract_all(F.coalesce(as_column(value), F.lit("")), F.lit(UNICODE + r"\b([0-9a-fA-F]{7,40})\b"), 1)
    return F.aggregate(found, F.lit(""), lambda best, x: F.when(F.length(x) > F.length(best), x).otherwise(best))


def clean_branch(value: Column | str) -> Column:
    branch = strip(value)
    return strip(
        F.when(branch.startswith("refs/heads/"), F.substring(branch, len("refs/heads/") + 1, 1_000_000))
        .when(branch.startswith("origin/"), F.substring(branch, len("origin/") + 1, 1_000_000))
        .otherwise(branch)
    )


def parse_utc(value: Column | str) -> Column:
    """ISO text as an instant; text without a zone is taken as UTC, anything else is null."""
    text = strip(value)
    zoned = F.when(text.rlike(r"([zZ]|[+-]\d{2}:?\d{2})$") & text.contains(":"), text)
    zoned = zoned.when(F.length(text) == 10, F.concat(text, F.lit("T00:00:00Z"))).otherwise(F.concat(text, F.lit("Z")))
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}([T ].*)?$"), F.try_to_timestamp(zoned))


def lookback_date(instant: Column | str, days: int = 14) -> Column:
    utc_day = F.to_date(F.to_utc_timestamp(as_column(instant), F.current_timezone()))
    return F.date_sub(utc_day, max(days, 1))


def distinct_slice(values: Column, limit: int | None = None) -> Column:
    """First occurrences in order, without null and empty text, at most ``limit`` where given."""
    unique = F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (v != "")))
    return unique if limit is None else F.slice(unique, 1, limit)


def merge_unique(left: Column, right: Column, limit: int | None = None) -> Column:
    empty = F.array().cast("array<string>")
    return distinct_slice(F.concat(F.coalesce(left, empty), F.coalesce(right, empty)), limit)


def split_tokens(csv_text: Column | str) -> Column:
    """Comma-separated words, runs of other characters as one dash, in order, without copies."""
    parts = F.split(F.coalesce(as_column(csv_text), F.lit("")), ",")
    clean = F.transform(parts, lambda p: F.btrim(F.regexp_replace(strip(p), r"[^A-Za-z0-9_.\-]+", "-"), F.lit("-")))
    return distinct_slice(clean)


def split_numbers(csv_text: Column | str, numeric_type: str = "double") -> Column:
    """Comma-separated numbers in order; a word that is no number stops the job."""
    parts = F.filter(F.transform(F.split(as_column(csv_text), ","), lambda p: strip(p)), lambda p: p != "")
    return F.array_distinct(
        F.transform(
            parts,
            lambda p: F.when(p.try_cast(numeric_type).isNotNull(), p.try_cast(numeric_type)).otherwise(
                F.raise_error(F.concat(F.lit("not a number: "), p)).cast(numeric_type)
            ),
        )
    )


def source_paths(*texts: Column | str, limit: int | None = 8, extensions: Sequence[str] = domain.SOURCE_EXTENSIONS) -> Column:
    """Paths of source files in the texts, in order, with forward slashes.

    A path can only lie inside a run of path characters, so the text is cut at
    all others first and only runs that hold a known extension are matched:
    long prose is never scanned for paths from each of its positions.
    """
    ext = "|".join(extensions)
    path = rf"{UNICODE}((?:[A-Za-z]:)?(?:[\w ._-]++[\\/])*[\w.-]+\.(?:{ext}))"
    lead_in = UNICODE + r"(?i)^.*\b(?:in|at|from|file)\s+(?=[^\s]+/)"

    def of_one(text: Column) -> Column:
        runs = F.split(text, UNICODE + r"[^\w ._:\\/-]")
        runs = F.filter(runs, lambda r: r.rlike(rf"\.(?:{ext})"))
        found = F.flatten(F.transform(runs, lambda r: F.regexp_extract_all(r, F.lit(path), 1)))
        slashed = F.transform(found, lambda p: F.btrim(F.replace(p, F.lit("\\"), F.lit("/")), F.lit("/")))
        return F.transform(slashed, lambda p: F.btrim(F.regexp_replace(p, lead_in, ""), F.lit("/")))

    parts = [of_one(F.coalesce(as_column(t), F.lit(""))) for t in texts]
    return distinct_slice(F.concat(*parts), limit)


def evidence_terms(
    message: Column | str,
    payload: Column | str | None = None,
    paths: Column | None = None,
    limit: int | None = 12,
    payload_chars: int | None = None,
    stop_words: Sequence[str] = domain.STOP_WORDS,
    labels: Sequence[str] = domain.LABELS,
) -> Column:
    """Search terms of a message: exception-like names first, then words, in order.

    The payload is read whole; ``payload_chars`` restores a bound on it.
    """
    pieces = [F.nullif(F.coalesce(as_column(message), F.lit("")), F.lit(""))]
    if payload is not None:
        text = as_column(payload)
        pieces.append(F.nullif(text if payload_chars is None else F.substring(text, 1, payload_chars), F.lit("")))
    if paths is not None:
        words = F.flatten(F.transform(paths, lambda p: F.split(p, "/")))
        pieces.append(F.nullif(F.array_join(words, "\n"), F.lit("")))
    text = F.concat_ws("\n", *pieces)
    suffixes = "|".join(domain.EXCEPTION_SUFFIXES)
    named = F.regexp_extract_all(text, F.lit(UNICODE + rf"\b([A-Za-z_][A-Za-z0-9_.]*(?:{suffixes}))\b"), 1)
    plain = F.regexp_extract_all(text, F.lit(UNICODE + r"\b([A-Za-z_][A-Za-z0-9_.-]{3,})\b"), 1)
    skipped = [*stop_words, *(label.lower() for label in labels)]
    terms = F.transform(F.concat(named, plain), lambda t: F.btrim(t, F.lit("._-")))
    kept = F.filter(terms, lambda t: F.length(t).between(4, 80) & ~F.lower(t).isin(skipped))
    unique = F.array_distinct(kept)
    return unique if limit is None else F.slice(unique, 1, limit)


def batch_date(received_at: Column | str, cutoff: str = "00:00", zone: str = "UTC") -> Column:
    """The local day of the first daily flush at or after arrival."""
    hour, minute = parse_cutoff(cutoff)
    local = F.from_utc_timestamp(F.to_utc_timestamp(as_column(received_at), F.current_timezone()), valid_zone(zone))
    seconds = F.hour(local) * 3600 + F.minute(local) * 60 + F.second(local)
    exact = local == F.date_trunc("minute", local)
    on_time = (seconds < hour * 3600 + minute * 60) | ((seconds == hour * 3600 + minute * 60) & exact)
    return F.when(on_time, F.to_date(local)).otherwise(F.date_add(F.to_date(local), 1))


def parse_cutoff(text: str) -> tuple[int, int]:
    hour, sep, minute = text.partition(":")
    if not sep:
        raise ValueError("the cut-off must look like HH:MM")
    if not (0 <= int(hour) <= 23 and 0 <= int(minute) <= 59):
        raise ValueError("the cut-off must be a time of a 24-hour day")
    return int(hour), int(minute)


def valid_zone(name: str) -> str:
    """The zone name, or UTC when there is no such zone."""
    from zoneinfo import ZoneInfo

    try:
        ZoneInfo(name)
    except Exception:
        return "UTC"
    return name


def monitoring_day(received_at: Column | str) -> Column:
    """First ten characters when they look like a date, else today in UTC."""
    text = strip(received_at)
    today = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd")
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(text, 1, 10)).otherwise(today)
