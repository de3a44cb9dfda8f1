"""Packing token sequences by cutting-stock column generation.

A document's tokens are cut at multiples of the sequence length. The pieces are counted by length class
(``WIDTH`` tokens wide), and the counts are the demand of a cutting-stock problem: a linear program over
patterns of classes that fit one sequence. Patterns are priced by a knapsack dynamic program on the dual
values and enter the basis until none is better (or the bound shows a gap below ``GAP``). The solution is
rounded down; what is left is bounded by the number of classes and filled largest first. The program
depends on the histogram alone, so its size is fixed whatever the corpus.

The pieces of each class are ranked over all tasks, and a table of rank ranges, as small as the patterns,
gives each its sequence.

Defined results: a null text is an empty one and has the closing id only. Repeated rows are documents of
their own. Documents of one class are ranked by id, start and a hash, so ties fall anyhow but once. An
empty table gives no pieces. Other columns are not read.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from logloom.llm.common import checkpointed, kept, released, text_groups
from logloom.operators.indexing import with_order_index

LENGTH, CLOSING, WIDTH, GAP = 2048, 1, 8, 1e-4
#: Characters that are encoded at once, different words of theirs in one row, and words that a worker remembers.
GROUP, ROW, KNOWN = 2_000_000, 100, 400_000
#: Rows that go to a Python worker at once, as both sides hold them several times over.
BATCH = 250
# What the vocabulary's pre-tokenizer takes as words, and the mark of a word's end.
_WORDS, _END = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+", "</w>"
#: Texts of Latin letters and white space of which all parties think alike. The dotted capital I has two small letters.
_PLAIN = r"^[\t\n\r -~\x{a1}-\x{12f}\x{131}-\x{24f}]*\z"
_SPECIAL = "<|"
_MARKS, _TAIL = ".,;:!?|#*%$&", 8  # marks that may follow a word, and how many at most
_PROBE = "The quick brown fox's 12 naïve jumpers, they're över-excited!! tionouble ... 's ÀB."


def _ragged(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places of runs that begin at ``first`` and have ``counts`` places, in a row."""
    return np.repeat(first - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())


class _Ids:
    """Ids of texts by the tokenizer, which is asked once for each different word of a group of texts that is not known from one before.

    The vocabulary's pre-tokenizer drops white space and cuts the rest into words that no token crosses, so the ids of a
    text are those of its words in a row. Plain texts are split and their different parts found by Arrow; a part is
    a word of letters with a few marks behind it, which are one word too, or is cut with the pre-tokenizer's pattern. The different words
    are encoded many in a row by the tokenizer's model, and the mark of a word's end in the last token of each tells them apart. That way is taken
    only if it gives the tokenizer's ids for a probe; other texts are encoded as they are.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # The same model for words that are in lower case and cut already.
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, at in self.tokenizer.get_vocab().items():
            self.last[at] = token.endswith(_END)
        self.cut = regex.compile(_WORDS).findall
        self.forget()
        self.by_words = True
        self.by_words = self.of([_PROBE])[0].tolist() == self._exact([_PROBE])[0]

    def forget(self, most: int = 0) -> None:
        """Words that came up in the most groups of texts stay, up to so many; their counts are halved, so that later words can pass them."""
        if not most:
            self.known: dict[str, int] = {}
            self.ids, self.first, self.uses = array("I"), array("q", [0]), np.zeros(0, np.int64)
            return
        stay = np.sort(np.argsort(-self.uses, kind="stable")[:most])
        names, first = list(self.known), np.array(self.first)
        sizes = np.diff(first)[stay]
        self.ids = array("I", np.array(self.ids, "<u4")[_ragged(first[stay], sizes)].tobytes())
        self.first = array("q", np.concatenate(([0], np.cumsum(sizes))).tobytes())
        self.known = {names[at]: n for n, at in enumerate(stay.tolist())}
        self.uses = self.uses[stay] // 2

    def _exact(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _cut(self, rows: list[str]) -> list[list[int]]:
        return [e.ids for e in self.words.encode_batch_fast(rows, add_special_tokens=False)]

    def _of_words(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where each of these different words' begin and how many it has. All words are remembered, those that come up most for longest."""
        names = words.to_numpy(zero_copy_only=False).tolist()
        numbers = np.fromiter(map(self.known.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(numbers < 0)
        starts = [*range(0, len(new), ROW), len(new)]
        rows = pc.binary_join(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), words.take(pa.array(new))), " ").to_pylist()
        for start in range(0, len(rows), 100):
            for at, own in enumerate(self._cut(rows[start : start + 100]), start):
                found = np.array(own, np.int64)
                after = np.flatnonzero(self.last[found]) + 1
                if len(after) != starts[at + 1] - starts[at] or after[-1] != len(found):
                    single = self._exact(words.take(pa.array(new[starts[at] : starts[at + 1]])).to_pylist())
                    after, found = np.cumsum([len(i) for i in single]), np.array(list(chain.from_iterable(single)), np.int64)
                self.first.frombytes((after + len(self.ids)).astype(np.int64).tobytes())
                self.ids.frombytes(found.astype(np.uint32).tobytes())
        numbers[new] = np.arange(len(self.known), len(self.known) + len(new))
        self.known.update(zip([names[i] for i in new.tolist()], numbers[new].tolist(), strict=True))
        self.uses = np.concatenate((self.uses, np.zeros(len(new), np.int64)))
        self.uses[numbers] += 1
        whole, first = np.array(self.ids, "<u4"), np.array(self.first)
        if len(self.known) > KNOWN:
            self.forget(KNOWN // 2)
        return whole, first[numbers], np.diff(first)[numbers]

    def _of_parts(self, parts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of different parts in a row, and how many each has."""
        stems = pc.utf8_rtrim(parts, characters=_MARKS)
        tails = pc.subtract(pc.utf8_length(parts), pc.utf8_length(stems)).to_numpy().astype(np.int64)
        simple = pc.utf8_is_alpha(stems).to_numpy(zero_copy_only=False) & (tails <= _TAIL)
        odd, marked = np.flatnonzero(~simple), [np.flatnonzero(simple & (tails == n)) for n in range(1, _TAIL + 1)]
        cut = [self.cut(part.lower()) for part in parts.take(pa.array(odd)).to_pylist()]
        counts = np.where(simple, 1 + (tails > 0), 0)
        counts[odd] = [len(c) for c in cut]
        first = np.cumsum(counts) - counts
        marks = [pc.utf8_slice_codeunits(parts.take(pa.array(some)), -n) for n, some in enumerate(marked, 1)]
        words = pa.concat_arrays([pc.utf8_lower(stems.filter(pa.array(simple))), *marks, pa.array(chain.from_iterable(cut), pa.string())]).dictionary_encode()
        numbers = np.empty(counts.sum(), np.int64)
        numbers[np.concatenate([first[simple], first[np.concatenate(marked)] + 1, _ragged(first[odd], counts[odd])])] = words.indices.to_numpy()
        ids, begin, sizes = self._of_words(words.dictionary)
        sizes = sizes[numbers]
        upto = np.concatenate(([0], np.cumsum(sizes)))
        return ids[_ragged(begin[numbers], sizes)], upto[first + counts] - upto[first]

    def of(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text, little-endian."""
        given = pa.array([t or "" for t in texts], pa.string())
        plain = pc.match_substring_regex(given, _PLAIN).to_numpy(zero_copy_only=False) & ~pc.match_substring(given, _SPECIAL).to_numpy(zero_copy_only=False)
        plain &= self.by_words
        lists = pc.ascii_split_whitespace(pc.if_else(pa.array(plain), given, ""))
        parts = lists.flatten().dictionary_encode()
        at = parts.indices.to_numpy()
        ids, counts = self._of_parts(parts.dictionary)
        whole = ids[_ragged((np.cumsum(counts) - counts)[at], counts[at])]
        ends = np.concatenate(([0], np.cumsum(counts[at])))[np.cumsum(lists.value_lengths().to_numpy())]
        found = np.split(whole, ends[:-1])
        others = np.flatnonzero(~plain)
        for start in range(0, len(others), 50):
            some = others[start : start + 50]
            for place, exact in zip(some, self._exact([texts[i] or "" for i in some]), strict=True):
                found[place] = np.array(exact, "<u4")
        return found


def _ids(path: str) -> _Ids:
    return kept(f"ids {path}", lambda: _Ids(path))


@contextmanager
def _batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Smaller batches for what is run in here, where the session has larger ones."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(name))
    spark.conf.set(name, min(before, rows) if before > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _encoded(path: str, length: int):
    @F.pandas_udf("doc_tokens long, crcs array<long>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        ids = _ids(path)
        closing = np.array([CLOSING], "<u4").tobytes()
        for texts in batches:
            sizes, marks = [], []
            for _, group in text_groups(texts, GROUP):
                for found in ids.of(group):
                    data = found.tobytes() + closing
                    sizes.append(len(data) // 4)
                    marks.append([zlib.crc32(data[at : at + 4 * length]) for at in range(0, len(data), 4 * length)])
            yield pd.DataFrame({"doc_tokens": sizes, "crcs": marks})
        released()

    return encode


def pieces(docs: DataFrame, path: str | None = None, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    encoded = docs.select(F.col(doc_id).alias("doc_id"), _encoded(path, length)(F.col(text)).alias("e")).select("doc_id", "e.*")
    parts = encoded.select("doc_id", "doc_tokens", F.posexplode("crcs").alias("n", "ids_crc32"))
    start = F.col("n").cast("long") * length
    return parts.select(
        "doc_id", start.alias("start"), F.least(F.lit(length).cast("long"), F.col("doc_tokens") - start).alias("length"), "ids_crc32", "doc_tokens"
    )


def _dearest(values: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The pattern of most value that fits ``room`` units; class k takes k units and is worth values[k]."""
    best, choice = np.zeros(room + 1), np.zeros(room + 1, np.int64)
    for c in range(1, room + 1):
        worth = values[1 : c + 1] + best[c - 1 :: -1]
        at = int(worth.argmax())
        if worth[at] > best[c - 1] + 1e-12:
            best[c], choice[c] = worth[at], at + 1
        else:
            best[c] = best[c - 1]
    pattern, c = np.zeros(room + 1), room
    while c > 0:
        if choice[c]:
            pattern[choice[c]] += 1
            c -= choice[c]
        else:
            c -= 1
    return float(best[room]), pattern


def patterns(demand: Mapping[int, int], room: int) -> list[tuple[dict[int, int], int]]:
    """(pieces of each class, number of sequences) that hold exactly the demand; class k takes k of ``room`` units."""
    classes = sorted(k for k, n in demand.items() if n > 0)
    if not classes:
        return []
    wanted = np.array([demand[k] for k in classes], float)
    basis = np.diag([float(room // k) for k in classes])  # a column per pattern
    inverse, amount = np.diag(1 / np.diag(basis)), wanted / np.diag(basis)
    for _ in range(50 * len(classes)):
        dual = inverse.sum(0)
        values = np.zeros(room + 1)
        values[classes] = np.maximum(dual, 0)
        worth, found = _dearest(values, room)
        if worth <= 1 + 1e-9 or amount.sum() - float(np.maximum(dual, 0) @ wanted) / worth < GAP * amount.sum():
            break
        column = found[classes]
        move = inverse @ column
        ratio = np.where(move > 1e-9, amount / np.where(move > 1e-9, move, 1), np.inf)
        out = int(ratio.argmin())
        amount = np.maximum(amount - ratio[out] * move, 0)
        amount[out] = ratio[out]
        row = inverse[out] / move[out]
        inverse = inverse - np.outer(move, row)
        inverse[out] = row
        basis[:, out] = column
    left = {k: demand[k] for k in classes}
    chosen: list[tuple[dict[int, int], int]] = []
    for j, times in enumerate(np.floor(amount + 1e-6).astype(int)):
        use = {k: int(basis[i, j]) for i, k in enumerate(classes) if basis[i, j] > 0}
        times = min([int(times), *(left[k] // a for k, a in use.items())])
        if times > 0:
            chosen.append((use, times))
            for k, a in use.items():
                left[k] -= a * times
    while any(left.values()):
        use, free = {}, room
        for k in reversed(classes):
            if n := min(left[k], free // k):
                use[k], free = n, free - n * k
        times = min(left[k] // a for k, a in use.items())
        chosen.append((use, times))
        for k, a in use.items():
            left[k] -= a * times
    return chosen


def _places(chosen: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int]]:
    """(class, first rank, rank after the last, pieces in a sequence, first sequence) of each pattern's part of a class."""
    rows, reached, sequence = [], {}, 0
    for use, times in chosen:
        for k, a in use.items():
            first = reached.get(k, 0)
            rows.append((k, first, first + a * times, a, sequence))
            reached[k] = first + a * times
        sequence += times
    return rows


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, width: int = WIDTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    unit = F.ceil(F.col("length") / width).cast("int")
    with _batches_of(spark, BATCH):
        found = checkpointed(pieces(docs, path, length, doc_id, text).withColumn("unit", unit))
    ranked = with_order_index(found, ["doc_id", "start"], ["unit"], "rank")
    demand = {r["unit"]: r["count"] for r in found.groupBy("unit").count().collect()}  # length / width rows at most
    places = _places(patterns(demand, -(-length // width)))
    table = spark.createDataFrame(places, "unit int, first long, after long, each long, sequence long")
    inside = (ranked["unit"] == table["unit"]) & (ranked["rank"] >= table["first"]) & (ranked["rank"] < table["after"])
    # As many rows as patterns have classes: bounded by the square of length / width.
    placed = ranked.join(F.broadcast(table), inside).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", ranked["unit"], "rank",
        (F.col("sequence") + F.floor((F.col("rank") - F.col("first")) / F.col("each"))).alias("sequence_id"),
    )
    before = Window.partitionBy("sequence_id").orderBy(F.desc("unit"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(before), F.lit(0))
    return placed.withColumn("offset", offset).drop("unit", "rank")
