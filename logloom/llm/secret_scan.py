"""Secrets in texts: assignments, access keys, long hex runs, and random strings by token efficiency.

The base kinds are patterns. The method adds ``random`` spans: unbroken runs with letters, of any length from
``RUN_LEAST`` on, that a byte-level BPE vocabulary needs many tokens for, as it has no pieces of random
strings. Runs that are digests of a known length, labelled digests, UUIDs, times or numbers are left out,
and so is what a ``data:`` URI embeds. Of a run that overlaps base spans the parts outside them are tested.
Words of letters in one case with fewer than ``WORD_LEAST`` characters have a bound of their own, as the
ratio does not tell all of them from random letters.

Defined results: null and empty texts have no spans. Places are code points, ends exclusive. Whole texts
are searched, each by itself, so repeated rows and ties need no rule.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, functions as F

from logloom.llm.common import kept

# The patterns of the base kinds and the least lengths of what they find.
ASSIGN = re.compile(
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
KINDS = ("assign", "access", "hex", "random")
#: Words without which no assignment can match, in lower case.
KEYWORDS = ("passw", "secret", "token", "api")

RUN_LEAST, WORD_LEAST, SHORT_WORD_RATIO = 16, 20, 1.5
#: Characters given to the encoder at once; a run's tokens are summed over its slices.
SLICE = 1024
RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % RUN_LEAST)
DIGEST = re.compile(r"(?:(?:md5|sha-?1|sha-?224|sha-?256|sha-?384|sha-?512)[-_:=])?(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128})|sha(?:256|384|512)-[A-Za-z0-9+/]{40,90}={0,2}", re.I)
IDENTIFIER = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[0-9_/+=-]*|[0-9]{4}-?[0-9]{2}-?[0-9]{2}T[0-9]{2}(?:-?[0-9]{2}){1,2}Z?")
ONE_CASE = re.compile(r"[A-Za-z]?[a-z]*|[A-Z]*")
EMBEDDED = re.compile(r"data:[A-Za-z0-9.+/_-]*(?:;[A-Za-z0-9.=_-]+)*;base64,\Z", re.I)
SPANS = "array<struct<kind:string,start:long,end:long>>"

def encoding(ranks: str):
    """The byte-level BPE of a rank file, one per Python worker."""

    def build():
        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    return kept(f"ranks {ranks}", build)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds."""
    found: list[tuple[int, int, int]] = []
    low = text.lower()
    if any(word in low for word in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m.group()) >= ACCESS_LEAST]
    return found + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def outside(start: int, end: int, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """The parts of start to end that no span of ``taken`` covers."""
    for a, b in sorted(taken):
        if a < end and start < b:
            if start < a:
                yield start, a
            start = b
    if start < end:
        yield start, end


def random_runs(text: str, ranks: str, most_chars_per_token: float, taken: list[tuple[int, int]] = []) -> list[tuple[int, int]]:  # noqa: B006
    """(start, end) of the runs, or their parts outside the spans of ``taken``, with at most so many characters a token."""
    found = []
    for m in RUN.finditer(text):
        if DIGEST.fullmatch(m.group()) or IDENTIFIER.fullmatch(m.group()) or EMBEDDED.search(text, max(0, m.start() - 128), m.start()):
            continue
        for start, end in outside(*m.span(), taken):
            run = text[start:end]
            if len(run) < RUN_LEAST or not any(c.isalpha() for c in run) or DIGEST.fullmatch(run) or IDENTIFIER.fullmatch(run):
                continue
            most = min(SHORT_WORD_RATIO, most_chars_per_token) if len(run) < WORD_LEAST and ONE_CASE.fullmatch(run) else most_chars_per_token
            tokens = sum(len(encoding(ranks).encode_ordinary(run[at : at + SLICE])) for at in range(0, len(run), SLICE))
            if len(run) <= most * tokens:
                found.append((start, end))
    return found


def spans(text: str | None, ranks: str, most_chars_per_token: float) -> list[dict[str, object]]:
    """All spans of a text by start, then kind."""
    if not text:
        return []
    long_word = max(map(len, text.split()), default=0) >= RUN_LEAST
    low = None if long_word else text.lower()
    if not long_word and not any(word in low for word in KEYWORDS):
        return []
    found = base_spans(text)
    if long_word:
        found += [(a, 3, b) for a, b in random_runs(text, ranks, most_chars_per_token, [(a, b) for a, _, b in found])]
    return [{"kind": KINDS[kind], "start": start, "end": end} for start, kind, end in sorted(found)]


def find(text: str | Column, ranks: str | None = None, most_chars_per_token: float = 2.0) -> Column:
    """Array of (kind, start, end). ``ranks`` is the path of a vocabulary of ranks that all workers can read."""
    if ranks is None:
        import public_tokenizers

        ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")

    @F.pandas_udf(SPANS)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([spans(text, ranks, most_chars_per_token) for text in texts], dtype=object)

    return scan(F.col(text) if isinstance(text, str) else text)


def written(found: Column) -> Column:
    """Spans as text: kind:start:end, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text: str | Column, found: Column, mark: str = "<secret>") -> Column:
    """The text with each stretch of overlapping spans replaced by ``mark``; null stays null."""
    text = F.col(text) if isinstance(text, str) else text
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(done: Column, span: Column) -> Column:
        fresh = F.concat(done["out"], F.substring(text, (done["at"] + 1).cast("int"), (span["start"] - done["at"]).cast("int")), F.lit(mark))
        return F.struct(
            F.when(span["start"] >= done["at"], fresh).otherwise(done["out"]).alias("out"), F.greatest(done["at"], span["end"]).alias("at")
        )

    rest = lambda done: F.concat(done["out"], F.substring(text, (done["at"] + 1).cast("int"), F.length(text)))
    return F.when(F.size(found) > 0, F.aggregate(found, start, step, rest)).otherwise(text)
