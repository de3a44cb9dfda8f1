"""Language identification by cross-parsing entropy.

Each language is a suffix automaton over a bounded sample of its labelled text. A document is parsed
greedily against each automaton into longest matches; a language's entropy is its number of phrases
times log2 of its sample's length in characters, per character. The lowest one wins.

No letter of a sample is merged with another: the most frequent ones of all languages have a symbol each,
the others are written as a few digits, each place with symbols of its own. A language's table has columns
only for the symbols of its sample. Letters that no sample has are unknown to all languages.

The greedy parse is a walk through a complete table: where the automaton has no edge, a phrase ends and
the walk goes on from the root. The table lets numpy walk many texts at once. Texts
are parsed in blocks of ``BLOCK`` symbols (a phrase ends at a block's end), so that one very long text
costs as much per symbol as many short ones; all blocks of a text count.

Defined results: null text or text without a letter gives ``und`` with score 0; so does every text if no
labelled text was learned. Equal entropies go to the alphabetically first language, with score 0. With
one learned language the score is 1. Repeated rows are judged alike; only the text column is looked at.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from logloom.llm.common import kept, released, text_groups

UNDETERMINED = "und"
RESULT = "lang_pred string, lang_score double, entropy double"
#: Symbols per lane of the parse, distinct letters of the samples with one symbol, characters handled at once.
BLOCK, MAX_SYMBOLS, GROUP_CHARS = 2048, 126, 2_000_000
SPACE, OTHER = 0, 1
_ENDED, _NEXT = 29, (1 << 29) - 1


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", rows: int = 64, chars: int = 640) -> dict[str, str]:
    """Samples of text by language: of ``rows`` different texts, chosen by hash, at most ``chars`` characters each.

    ``rows * chars`` bounds what is learned and what reaches the driver per language. A text that is
    repeated many times counts once. Null and empty texts and null languages are left out.
    """
    table = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(text).alias("key"))
    table = table.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    order = Window.partitionBy("lang").orderBy("key")
    picked = (
        table.groupBy("lang", "key").agg(F.min(F.substring("text", 1, chars)).alias("text"))
        .withColumn("n", F.row_number().over(order)).where(F.col("n") <= rows)
    )
    samples: dict[str, list[str]] = {}
    for row in picked.orderBy("lang", "n").collect():
        samples.setdefault(row["lang"], []).append(row["text"])
    return {name: " ".join(texts) for name, texts in samples.items()}


class Parser:
    """The tables of all languages, and the parse of texts against them."""

    def __init__(self, samples: Mapping[str, str]):
        self.names = sorted(samples)
        letters = Counter(c.lower()[0] for text in samples.values() for c in text if c.isalpha())
        alphabet = [c for c, _ in sorted(letters.items(), key=lambda x: (-x[1], x[0]))]
        # Letters are numbered from 2 on; those from ``first`` on are written as digits, in as few as fit a byte.
        self.first = 2 + min(len(alphabet), MAX_SYMBOLS)
        rare = max(1, len(alphabet) - MAX_SYMBOLS)
        for self.digits in range(2, 5):
            self.base = next(b for b in range(1, rare + 2) if b**self.digits >= rare)
            if self.first + self.digits * self.base <= 256:
                break
        number = {c: at + 2 for at, c in enumerate(alphabet)}
        self.number = np.full(0x110000, SPACE, np.int32)
        for code in range(0x110000):
            if chr(code).isalpha():
                self.number[code] = number.get(chr(code).lower()[0], OTHER)
        self.tables, self.local, self.weights = [], [], []
        for name in self.names:
            learned, chars = self._read(samples[name])
            own = np.unique(learned[learned > OTHER])
            local = np.full(256, OTHER, np.uint8)
            local[SPACE] = SPACE
            local[own] = np.arange(2, len(own) + 2)
            edges = _automaton(local[learned].tolist())
            if len(edges) * (len(own) + 2) > _NEXT:
                raise ValueError(f"the sample of {name} is too large: {len(edges)} states of {len(own) + 2} symbols")
            self.tables.append(_complete(edges, len(own) + 2, 0))
            self.local.append(local)
            self.weights.append(math.log2(max(2, chars)))

    def codes(self, text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)

    def _read(self, text: str) -> tuple[np.ndarray, int]:
        """(symbols, number of characters they stand for): lower-cased letters, and all else as single spaces."""
        found = self.number[self.codes(text)]
        keep = found != SPACE
        keep[1:] |= found[:-1] != SPACE
        found = found[keep]
        rare = found >= self.first
        if not rare.any():
            return found.astype(np.uint8), len(found)
        size = np.where(rare, self.digits, 1)
        out, at, rest = np.repeat(found, size), (np.cumsum(size) - size)[rare], found[rare] - self.first
        for place in range(self.digits - 1, -1, -1):
            out[at + place] = self.first + place * self.base + rest % self.base
            rest = rest // self.base
        return out.astype(np.uint8), len(found)

    def symbols(self, text: str) -> np.ndarray:
        return self._read(text)[0]

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(has a letter, entropy of each text by language)."""
        read = [self._read(t) if t else (np.zeros(0, np.uint8), 0) for t in texts]
        found = [s for s, _ in read]
        known = np.array([bool((s != SPACE).any()) for s in found], bool)
        size, chars = np.array([len(s) for s in found]), np.array([n for _, n in read])
        owner = np.repeat(np.arange(len(found)), -(-size // BLOCK))
        lanes = [s[at : at + BLOCK] for s in found for at in range(0, len(s), BLOCK)]
        phrases = self._parse(lanes)
        total = np.stack([np.bincount(owner, row, len(found)) for row in phrases], 1) if lanes else np.zeros((len(found), len(self.names)))
        return known, total * np.array(self.weights) / np.maximum(chars, 1)[:, None]

    def _parse(self, lanes: list[np.ndarray]) -> np.ndarray:
        """Phrases of each lane, by language; lanes are walked together, the longest first."""
        length = np.array([len(x) for x in lanes], np.int64)
        order = np.argsort(-length, kind="stable")
        count = np.zeros((len(self.names), len(lanes)), np.int32)
        if not len(lanes):
            return count
        grid = np.zeros((int(length.max()), len(lanes)), np.uint8)
        for column, lane in enumerate(order):
            grid[: length[lane], column] = lanes[lane]
        active = np.searchsorted(-length[order], -np.arange(len(grid)), side="left")
        for table, local, phrases in zip(self.tables, self.local, count, strict=True):
            own, state = local[grid], np.zeros(len(lanes), np.int32)
            for at, alive in enumerate(active):
                went = table[state[:alive] + own[at, :alive]]
                phrases[:alive] += went >> _ENDED
                state[:alive] = went & _NEXT
            phrases += state != 0
        out = np.empty_like(count)
        out[:, order] = count
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        if not self.names:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        known, entropy = self.entropies(texts)
        best = entropy.argmin(1)
        ranked = np.sort(entropy, 1)
        least = ranked[:, 0]
        if len(self.names) == 1:
            score = np.ones(len(texts))
        else:
            score = 1 - np.divide(least, ranked[:, 1], out=np.ones(len(texts)), where=ranked[:, 1] > 0)
        names = [self.names[b] if k else UNDETERMINED for b, k in zip(best, known, strict=True)]
        return names, np.where(known, score, 0.0), np.where(known, least, 0.0)


def _automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Edges of the suffix automaton of a sequence, state 0 being its root."""
    edges: list[dict[int, int]] = [{}]
    link, longest, last = [-1], [0], 0
    for c in symbols:
        new = len(edges)
        edges.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in edges[p]:
            edges[p][c] = new
            p = link[p]
        if p >= 0:
            q = edges[p][c]
            if longest[q] == longest[p] + 1:
                link[new] = q
            else:
                copy = len(edges)
                edges.append(dict(edges[q]))
                longest.append(longest[p] + 1)
                link.append(link[q])
                while p >= 0 and edges[p].get(c) == q:
                    edges[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return edges


def _complete(edges: list[dict[int, int]], width: int, start: int) -> np.ndarray:
    """The automaton as a flat table of (phrases ended, place of the next state); ``start`` is its place in the whole table."""
    restart = np.full(width, start + (2 << _ENDED), np.int64)  # the open phrase ends and the unknown symbol is one of its own
    for c, to in edges[0].items():
        restart[c] = start + to * width + (1 << _ENDED)
    table = np.tile(restart, (len(edges), 1))
    table[0] = np.full(width, start + (1 << _ENDED))
    for state, out in enumerate(edges):
        for c, to in out.items():
            table[state, c] = start + to * width
    return table.astype(np.int32).ravel()


def _parser(samples: Mapping[str, str]) -> Parser:
    """One parser per Python worker; its tables are built from the small samples where they are used."""
    return kept(f"language {hash(tuple(sorted(samples.items())))}", lambda: Parser(samples))


def identify(text: str | Column, samples: Mapping[str, str]) -> Column:
    """Struct of ``lang_pred``, ``lang_score`` (0 to 1: by how much the best entropy is below the next) and ``entropy``."""
    samples = dict(samples)

    @F.pandas_udf(RESULT)
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        parser = _parser(samples)
        for batch in batches:
            names, scores, entropies = [], [], []
            for _, texts in text_groups(batch, GROUP_CHARS):
                a, b, c = parser.predict(texts)
                names += a
                scores.append(b)
                entropies.append(c)
            join = lambda parts: np.concatenate(parts) if parts else np.zeros(0)
            yield pd.DataFrame({"lang_pred": names, "lang_score": join(scores), "entropy": join(entropies)})
        released()

    return judge(F.col(text) if isinstance(text, str) else text)


def fold(doc_id: str = "doc_id", folds: int = 4) -> Column:
    """Fold of a document: crc32 of its id's text; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def learned_from(docs: DataFrame, held_out: int = 2) -> dict[str, str]:
    return learn(docs.where(fold() != held_out))


def judged(docs: DataFrame, samples: Mapping[str, str]) -> DataFrame:
    """All columns of ``docs`` as one struct ``doc``, with the verdict on its text as struct ``verdict``."""
    return docs.select(F.struct("*").alias("doc")).withColumn("verdict", identify("doc.text", samples))
