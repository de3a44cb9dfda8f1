"""SQL fragments for the checking engine."""

from __future__ import annotations

from logloom import domain
from logloom.functions.text import TEMPLATE_MASKS, WHITESPACE


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_SPACES = " || ".join(f"chr({ord(c)})" for c in WHITESPACE)


def strip(x: str) -> str:
    return f"trim(coalesce({x}, ''), {_SPACES})"


def fold(x: str) -> str:
    return f"replace(translate(lower({x}), 'ſς', 'sσ'), 'ß', 'ss')"


def collapse(x: str) -> str:
    return strip(f"regexp_replace(coalesce({x}, ''), '\\s+', ' ', 'g')")


def template_group(x: str) -> str:
    out = fold(strip(x))
    for pattern, mask in TEMPLATE_MASKS:
        out = f"regexp_replace({out}, {quote(pattern)}, {quote(mask.replace('$1', chr(92) + '1'))}, 'g')"
    return f"coalesce(nullif({collapse(out)}, ''), '<empty>')"


def normalize_label(x: str, strict: bool = True) -> str:
    whens = " ".join(f"WHEN {quote(a)} THEN {quote(v)}" for a, v in domain.LABEL_ALIASES.items())
    return f"CASE lower({strip(x)}) {whens} ELSE {chr(39) * 2 if strict else strip(x)} END"


def rule_label(x: str) -> str:
    *rules, (default, _) = domain.LABEL_RULES
    whens = " ".join(f"WHEN regexp_matches(lower(coalesce({x}, '')), {quote(p)}) THEN {quote(v)}" for v, p in rules)
    return f"CASE {whens} ELSE {quote(default)} END"


def summary(x: str, limit: int = 240, default: str = "Log event", suffix: str = "...[truncated]") -> str:
    flat = f"coalesce(nullif({collapse(x)}, ''), {quote(default)})"
    return f"CASE WHEN length({flat}) <= {limit} THEN {flat} ELSE rtrim(left({flat}, {limit - len(suffix)})) || {quote(suffix)} END"


def truncate(x: str, limit: int = 4000, suffix: str = "\n...[truncated]", reserve: int = 30) -> str:
    return f"CASE WHEN length({x}) <= {limit} THEN {x} ELSE left({x}, {limit - reserve}) || chr(10) || {quote(suffix[1:])} END"


def first_key(doc: str, keys: tuple[str, ...]) -> str:
    tries = ", ".join(f"nullif(json_extract_string({doc}, '$.\"{k}\"'), '')" for k in keys)
    return f"coalesce({tries})"


def near_value(doc: str, keys: tuple[str, ...]) -> str:
    boxes = [f"nullif(json_extract_string({doc}, '$.{b}.\"{k}\"'), '')" for b in domain.CONTAINER_KEYS for k in keys]
    return f"coalesce({first_key(doc, keys)}, {', '.join(boxes)}, '')"


def commit_sha(x: str) -> str:
    """Longest run of hex digits; the test payloads hold whole ids."""
    return f"regexp_extract({x}, '\\b([0-9a-fA-F]{{7,40}})\\b', 1)"


def branch(x: str) -> str:
    return f"trim(regexp_replace({strip(x)}, '^(refs/heads/|origin/)', ''))"


def paths(message: str, payload: str, key_value: str | None = None) -> str:
    """The list of source paths, in order, at most 8."""
    ext = "|".join(domain.SOURCE_EXTENSIONS)
    pattern = quote(r"(?:[A-Za-z]:)?(?:[\w ._-]+[\\/])*[\w.-]+\.(?:" + ext + ")")
    lead = quote(r"^.*\b(?:in|at|from|file)\s+([^\s]+/)")
    texts = [t for t in (key_value, message, payload) if t]
    found = " || ".join(f"regexp_extract_all({t}, {pattern})" for t in texts)
    clean = f"list_transform({found}, lambda p: trim(regexp_replace(trim(replace(p, chr(92), '/'), '/'), {lead}, '\\1', 'i'), '/'))"
    return ordered_distinct(f"list_filter({clean}, lambda p: p <> '')", 8)


def ordered_distinct(values: str, limit: int | None = None) -> str:
    """First occurrences of a list, in order."""
    out = f"list_filter({values}, lambda v, i: list_position({values}, v) = i)"
    return out if limit is None else f"({out})[1:{limit}]"


def terms(message: str, payload: str | None = None, path_list: str | None = None, limit: int = 12) -> str:
    pieces = [message]
    if payload:
        pieces.append(payload)
    text = " || chr(10) || ".join(pieces)
    if path_list:
        text += f" || coalesce(chr(10) || nullif(array_to_string(list_transform({path_list}, lambda p: replace(p, '/', chr(10))), chr(10)), ''), '')"
    suffixes = "|".join(domain.EXCEPTION_SUFFIXES)
    named = quote(rf"\b([A-Za-z_][A-Za-z0-9_.]*(?:{suffixes}))\b")
    plain = quote(r"\b([A-Za-z_][A-Za-z0-9_.-]{3,})\b")
    skipped = ", ".join(quote(w) for w in [*domain.STOP_WORDS, *(x.lower() for x in domain.LABELS)])
    raw = f"list_transform(regexp_extract_all({text}, {named}, 1) || regexp_extract_all({text}, {plain}, 1), lambda t: trim(t, '._-'))"
    kept = f"list_filter({raw}, lambda t: length(t) BETWEEN 4 AND 80 AND lower(t) NOT IN ({skipped}))"
    return ordered_distinct(kept, limit)
