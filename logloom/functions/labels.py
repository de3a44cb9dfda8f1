"""Labels: aliases, ids, the offline rule scorer."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column, functions as F

from logloom import domain
from logloom.functions.text import as_column, strip


def _lookup(keys: Column, table: Mapping[str, object]) -> Column:
    pairs = F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])
    return F.try_element_at(pairs, keys)


def normalize_label(value: Column | str, strict: bool = True, aliases: Mapping[str, str] = domain.LABEL_ALIASES) -> Column:
    """The label an alias stands for; unknown text becomes empty, or stays when not ``strict``."""
    text = strip(value)
    return F.coalesce(_lookup(F.lower(text), aliases), F.lit("") if strict else text)


def label_id(label: Column | str, labels: Sequence[str] = domain.LABELS) -> Column:
    return _lookup(as_column(label), {name: i for i, name in enumerate(labels)})


def rule_label(message: Column | str, rules: Sequence[tuple[str, str]] = domain.LABEL_RULES) -> Column:
    """The label of the first rule whose pattern is found in the message."""
    text = F.lower(F.coalesce(as_column(message), F.lit("")))
    *first, (default, _) = rules
    label = None
    for name, pattern in first:
        hit = text.rlike(pattern)
        label = F.when(hit, name) if label is None else label.when(hit, name)
    return F.lit(default) if label is None else label.otherwise(default)
