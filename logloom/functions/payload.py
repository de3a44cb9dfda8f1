"""Functions on JSON payload columns.

A payload is a JSON text. Objects are read as ``map<string,string>``, which
keeps the order of the keys; nested values stay JSON text inside the map.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from logloom import domain
from logloom.functions.text import as_column, strip

MAP = "map<string,string>"
ENTRIES = "array<struct<key:string,value:string>>"


def one_document(text: Column) -> Column:
    """Whether the text is one JSON value and nothing else.

    The parser stops after the first value, so text behind it only shows
    inside brackets: it must be the one item of an array and the value of a key.
    """
    item = F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1
    return F.coalesce(item, F.lit(False)) & F.try_parse_json(F.concat(F.lit('{"x":'), text, F.lit("}"))).isNotNull()


def payload_map(raw: Column | str) -> Column:
    """The object as a map, or null when the text is no JSON object."""
    text = as_column(raw)
    # A whole JSON document; text after an object makes it plain text.
    return F.when(F.ltrim(text).startswith("{") & one_document(text), F.from_json(text, MAP))


def first_value(payload: Column, keys: Sequence[str]) -> Column:
    """The first non-empty value among the keys of a map, else null."""
    return F.coalesce(*[F.nullif(F.try_element_at(payload, F.lit(k)), F.lit("")) for k in keys])


def message_of(payload: Column, raw: Column, keys: Sequence[str] = domain.MESSAGE_KEYS) -> Column:
    """``extract_message`` for a payload that is parsed already."""
    any_value = F.get(F.filter(F.map_values(payload), lambda v: v.isNotNull() & (v != "")), 0)
    found = F.coalesce(first_value(payload, keys), any_value, F.lit(""))
    return F.when(payload.isNotNull(), found).otherwise(F.coalesce(raw, F.lit("")))


def extract_message(raw: Column | str, keys: Sequence[str] = domain.MESSAGE_KEYS) -> Column:
    """Message of a payload: the known keys in order, else the first non-empty value; plain text as it is."""
    text = as_column(raw)
    # The one-item array binds the parsed object, so that it is parsed once and not once per key.
    return F.get(F.transform(F.array(payload_map(text)), lambda payload: message_of(payload, text, keys)), 0)


def normalize_payload(raw: Column | str, received_at: Column | str) -> Column:
    """Any text as a JSON object with ``received_at``; an object keeps all it has."""
    text = strip(raw)
    keys = F.when(one_document(text), F.json_object_keys(text))
    stamp = F.concat(F.lit('"received_at":"'), as_column(received_at).cast("string"), F.lit('"}'))
    open_object = F.rtrim(F.substring(text, F.lit(1), F.length(text) - 1))
    extended = F.concat(open_object, F.when(F.size(keys) == 0, "").otherwise(","), stamp)
    as_object = F.when(F.array_contains(keys, "received_at"), text).otherwise(extended)
    literal = F.when(text.startswith('"'), F.coalesce(F.get_json_object(text, "$"), text)).otherwise(text)
    wrapped = F.to_json(
        F.struct(literal.alias("message"), as_column(received_at).cast("string").alias("received_at"))
    )
    return F.when(keys.isNotNull(), as_object).otherwise(wrapped)


def constant_words(words: Sequence[str]) -> Column:
    """An array of fixed words; the split is folded into a literal when planned."""
    return F.split(F.lit("\n".join(words)), "\n")


def _scalar(value: Column) -> Column:
    """The trimmed value, or null for empty text, objects and arrays."""
    text = strip(value)
    return F.when((text != "") & ~text.startswith("{") & ~text.startswith("["), text)


def _children(value: Column) -> Column:
    """Entries of an object, or the items of an array as entries without a key."""
    items = F.transform(
        F.from_json(value, "array<string>"),
        lambda v: F.struct(F.lit(None).cast("string").alias("key"), v.alias("value")),
    )
    nothing = F.array().cast(ENTRIES)
    entries = F.when(value.startswith("{"), F.map_entries(F.from_json(value, MAP))).when(value.startswith("["), items)
    return F.coalesce(entries, nothing)


def nested_values(top: Column, key_lists: Sequence[Sequence[str]], max_depth: int = 5, containers: Sequence[str] = domain.CONTAINER_KEYS) -> Column:
    """For each list of keys a scalar of a parsed payload, or empty text: by key at the top, in the known containers, then anywhere.

    The third tier goes through the tree level by level down to ``max_depth``
    and compares keys by their letters and digits only; it runs in the JVM and
    only for rows that the first two tiers leave open. Containers and tree are read once for all lists.
    """
    folded = [sorted({re.sub("[^a-z0-9]", "", k.lower()) for k in keys if k.strip()}) for keys in key_lists]

    def first_of(values: Column) -> Column:
        return F.get(F.filter(values, lambda v: v.isNotNull()), 0)

    def bound(value: Column, use: Callable[[Column], Column]) -> Column:
        # The one-item array binds a value that is used several times.
        return F.get(F.transform(F.array(value), use), 0)

    def by_key(box: Column, keys: Sequence[str]) -> Column:
        return first_of(F.transform(constant_words(keys), lambda k: _scalar(F.try_element_at(box, k))))

    def in_containers(top: Column) -> Column:
        boxes = F.filter(F.transform(constant_words(containers), lambda c: F.try_element_at(top, c)), lambda v: F.coalesce(v, F.lit("")).startswith("{"))
        return F.transform(boxes, lambda v: F.from_json(v, MAP))

    def deeper(levels: Column, _: Column) -> Column:
        boxes = F.filter(F.element_at(levels, -1), lambda e: F.substring(e["value"], 1, 1).isin("{", "["))
        return F.concat(levels, F.array(F.flatten(F.transform(boxes, lambda e: _children(e["value"])))))

    def tree(top: Column, nested: Column) -> Column:
        levels = F.aggregate(F.sequence(F.lit(1), F.lit(max_depth)), F.array(F.map_entries(top)), deeper)
        entries = F.when(nested, F.flatten(levels)).otherwise(F.map_entries(top))
        return F.transform(entries, lambda e: F.struct(F.regexp_replace(F.lower(e["key"]), "[^a-z0-9]", "").alias("name"), _scalar(e["value"]).alias("value")))

    def look(top: Column) -> Column:
        nested = F.exists(F.map_values(top), lambda v: F.substring(v, 1, 1).isin("{", "["))
        early = bound(F.when(nested, in_containers(top)), lambda boxes: F.array(*[
            F.coalesce(by_key(top, keys), first_of(F.transform(boxes, lambda box: by_key(box, keys)))) for keys in key_lists
        ]))

        def late(found: Column, entries: Column) -> Column:
            hit = lambda names: F.filter(entries, lambda e: F.array_contains(constant_words(names), e["name"]))
            return F.array(*[F.coalesce(found[i], first_of(F.transform(hit(names), lambda e: e["value"]))) for i, names in enumerate(folded)])

        return bound(early, lambda found: F.when(F.exists(found, lambda v: v.isNull()), bound(tree(top, nested), lambda entries: late(found, entries))).otherwise(found))

    return F.transform(bound(top, look), lambda v: F.coalesce(v, F.lit("")))


def nested_value(raw: Column | str, keys: Sequence[str], max_depth: int = 5, containers: Sequence[str] = domain.CONTAINER_KEYS) -> Column:
    """The scalar of one list of keys, see ``nested_values``."""
    return F.get(nested_values(payload_map(raw), [keys], max_depth, containers), 0)


def _label_patterns(labels: Sequence[str]) -> tuple[list[str], str]:
    names = "|".join(re.escape(label) for label in labels)
    lead = r"(?:prediction|predicted\s+class|predicted\s+label|class|label|category|result|classification|answer)"
    # Sentences that name a label, in order of use.
    context = [
        rf"{lead}\s*(?:is|:|=|-)?\s*[\"'`*]*({names})\b",
        rf"(?:classified\s+as|predicted\s+as)\s*[\"'`*]*({names})\b",
        rf"\b({names})\b\s*(?:prediction|class|label|category|classification)\b",
    ]
    return context, rf"(?<![A-Za-z0-9_])({names})(?![A-Za-z0-9_])"


def label_in_text(value: Column | str, labels: Sequence[str] = domain.LABELS, short: int = 80) -> Column:
    """The label a free-text answer names, or empty text."""
    text = strip(value)
    bare = strip(F.regexp_replace(text, r"^[\s\"'`*_]+|[\s\"'`*_.:;\-]+$", ""))
    by_name = F.create_map(*[F.lit(x) for label in labels for x in (label.lower(), label)])
    context, alone = _label_patterns(labels)
    tries = [F.try_element_at(by_name, F.lower(text)), F.try_element_at(by_name, F.lower(bare))]
    tries += [F.try_element_at(by_name, F.lower(F.regexp_extract(text, f"(?i){p}", 1))) for p in context]
    seen = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(f"(?i){alone}"), 1), lambda x: F.lower(x)))
    tries.append(F.when((F.length(text) <= short) & (F.size(seen) == 1), F.try_element_at(by_name, F.get(seen, 0))))
    return F.coalesce(*tries, F.lit(""))


def _answer_leaves(raw: str) -> Iterator[tuple[str, bool]]:
    """The scalars of a JSON answer in the order in which they are asked for a label."""
    priority = [k.lower() for k in domain.PREDICTION_KEYS]
    skipped = {k.lower() for k in domain.PREDICTION_SKIP_KEYS}
    try:
        todo: list[tuple[object, bool, bool]] = [(json.loads(raw), True, True)]
    except ValueError:
        todo = [(raw, True, False)]
    while todo:
        value, raw_allowed, unread = todo.pop()
        if isinstance(value, dict):
            names = {str(k).lower(): k for k in value}
            wanted = [(value[names[k]], True, True) for k in priority if k in names]
            others = [(v, False, True) for k, v in value.items() if str(k).lower() not in skipped]
            todo += reversed([item for item in wanted + others if item[0] not in (None, "")])
        elif isinstance(value, list):
            todo += reversed([(v, raw_allowed, True) for v in value])
        else:
            text = str(value or "").strip()
            parsed = None
            if unread and text[:1] in ("{", "[", '"'):
                try:
                    parsed = json.loads(text)
                except ValueError:
                    pass
            if parsed is not None:
                todo += [(text, raw_allowed, False), (parsed, raw_allowed, True)]
            elif text:
                yield text, raw_allowed


def _wrapped_leaves(raw: pd.Series) -> pd.Series:
    return raw.map(lambda text: list(_answer_leaves(text)) if text else None)


def prediction_label(raw: Column | str, labels: Sequence[str] = domain.LABELS) -> Column:
    """The label of a classifier's answer, however wrapped; other text stays as it is.

    Plain text is handled by built-in functions. Only answers that are JSON
    are unwrapped in Python, in Arrow batches; the unwrapped scalars come back
    and are read by the same built-in text rules.
    """
    text = strip(raw)
    wrapped = F.substring(text, 1, 1).isin("{", "[", '"') & F.try_parse_json(text).isNotNull()
    unwrap = F.pandas_udf(_wrapped_leaves, "array<struct<text:string,raw_allowed:boolean>>")
    leaves = unwrap(F.when(wrapped, text))
    named = F.transform(
        leaves,
        lambda leaf: F.coalesce(
            F.nullif(label_in_text(leaf["text"], labels), F.lit("")), F.when(leaf["raw_allowed"], leaf["text"])
        ),
    )
    from_json = F.coalesce(F.get(F.filter(named, lambda v: v.isNotNull()), 0), F.lit(""))
    from_text = F.coalesce(F.nullif(label_in_text(text, labels), F.lit("")), text)
    return F.when(wrapped, from_json).otherwise(from_text)


def text_prediction_label(raw: Column | str, labels: Sequence[str] = domain.LABELS) -> Column:
    """``prediction_label`` for answers known to be plain text: no Python at all."""
    text = strip(raw)
    return F.coalesce(F.nullif(label_in_text(text, labels), F.lit("")), text)


def _sensitive(key: Column) -> Column:
    name = F.lower(key)
    parts = "|".join(re.escape(p) for p in domain.SENSITIVE_KEY_PARTS)
    return name.isin(list(domain.SENSITIVE_KEYS)) | name.rlike(parts)


def redact_map(payload: Column | str, max_chars: int = 1000, mask: str = "<redacted>") -> Column:
    """A flat map with the values of sensitive keys masked and long values cut."""
    from logloom.functions.text import truncate_text

    return F.transform_values(
        as_column(payload), lambda k, v: F.when(_sensitive(k), F.lit(mask)).otherwise(truncate_text(v, max_chars))
    )


def _redacted(value: object, depth: int) -> object:
    def cut(text: str, size: int) -> str:
        return text if len(text) <= size else text[: size - 30] + "\n...[truncated]"

    if depth <= 0:
        return cut("" if value is None else str(value), 300)
    if isinstance(value, dict):
        shown = {}
        for key in list(value)[:50]:
            low = key.lower()
            hide = low in domain.SENSITIVE_KEYS or any(p in low for p in domain.SENSITIVE_KEY_PARTS)
            shown[key] = "<redacted>" if hide else _redacted(value[key], depth - 1)
        if len(value) > 50:
            shown["..."] = f"{len(value) - 50} more keys truncated"
        return shown
    if isinstance(value, list):
        return [_redacted(v, depth - 1) for v in value[:20]]
    return cut(value, 1000) if isinstance(value, str) else value


def _parsed(text: str) -> object:
    try:
        return json.loads(text)
    except ValueError:
        return text


def redact(raw: Column | str, depth: int = 4) -> Column:
    """Nested payloads for diagnostics: sensitive keys masked, size and depth bounded."""

    def masked(raw_text: pd.Series) -> pd.Series:
        return raw_text.map(lambda t: None if t is None else json.dumps(_redacted(_parsed(t), depth), ensure_ascii=False))

    text = as_column(raw)
    udf = F.pandas_udf(masked, StringType())
    valid = F.try_parse_json(text).isNotNull()
    return F.coalesce(udf(F.when(valid, text)), _cut_text(text))


def _cut_text(text: Column) -> Column:
    from logloom.functions.text import truncate_text

    return truncate_text(text, 1000)
