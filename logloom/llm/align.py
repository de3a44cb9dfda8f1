"""Alignment of the tokens of two tokenizers by lockstep merging.

A text is encoded by tokenizer A (byte-level BPE) and B (sentencepiece). Byte offsets where a token of A and
one of B end together are *cuts*; the tokens between two cuts are a *group*, and all pairs of its A and B
tokens are *links*. Documents are taken in blocks. Each lane (a document, or a part of a long one) of a block
has a pointer into the A and one into the B tokens; one NumPy state vector holds the pointers of all lanes,
and a step advances all of them at once: the pointer whose token ends first, or both at a cut. Lanes that are
done leave the vector. A step emits its cuts; with the cut before, each closes a group, whose links are the
rectangle of its A and B tokens. Since a cut is told by offsets alone, a long document may be split into lanes
at any byte.

The links of a pair of ids are counted once per document. A block sums its documents first, so that one row
per pair and block is shuffled, and gets back the counts of its own pairs only.

Both tokenizers see a text in segments that begin at a space behind other than white space. No token of
either reaches over such a place: A's pre-tokenizer begins a piece there, and B's vocabulary has no piece with
a space inside (this is checked; where it has one, B is given whole texts). Segments that were met before are not encoded again.

Defined results: null and empty texts, and those whose joined token bytes differ from space + text (as with
U+2581, which B takes for a space), have no tokens: all counts 0 and empty groups. Repeated rows are documents
of their own. Ties for the highest count of an A id are all highest. An empty table gives no rows. Other
columns are not read.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from logloom.llm.common import checkpointed, kept

#: Characters of a block, bytes of a lane, segments a worker remembers, and the largest group whose links are written out one by one.
BLOCK, LANE, KNOWN, SMALL = 1_000_000, 1024, 200_000, 4096
#: Characters of segments that are encoded in a row, and rows that are encoded at once.
ROW, AT_ONCE = 2000, 100
#: Longest segment that is remembered after its block.
LONGEST = 48
# Python's white space holds all that A's pre-tokenizer takes as such.
_BREAK = re.compile(r"(?<=\S)(?= )")
_SPACED = re.compile(r"\s ")


def _byte_alphabet() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 characters stand for their own bytes, the rest follow from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}


def _joins(segment: str) -> bool:
    """Whether a further segment may follow in one text: there is a place to break behind it, and B keeps its bytes."""
    return segment != "" and not segment[-1].isspace() and "▁" not in segment


def _rows(segments: list[str]) -> Iterator[list[str]]:
    row, chars = [], 0
    for segment in segments:
        row.append(segment)
        chars += len(segment)
        if chars >= ROW:
            yield row
            row, chars = [], 0
    if row:
        yield row


class Side:
    """One tokenizer: the bytes of its tokens and the ids of segments."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.ids, self.first = array("i"), array("q", [0])

    def add(self, segments: list[str], joined: bool) -> list[bool]:
        """Remember the ids of segments, encoded in rows of many where they may be joined; tells which come back as their own bytes."""
        right = []
        rows = list(_rows(segments)) if joined else [[s] for s in segments]
        for start in range(0, len(rows), AT_ONCE):
            some = rows[start : start + AT_ONCE]
            for row, ids in zip(some, self.encoded([" ".join(r) for r in some]), strict=True):
                right += self._remembered(row, ids)
        return right

    def _remembered(self, row: list[str], ids: list[int]) -> list[bool]:
        whole = b"".join([self.tokens[i] for i in ids]) == b" " + " ".join(row).encode()
        ends, wanted = np.cumsum(self.sizes[ids]), np.cumsum([len(s.encode()) + 1 for s in row])
        after = np.searchsorted(ends, wanted) + 1 if whole else wanted
        if len(row) > 1 and not (whole and np.array_equal(ends[after - 1], wanted)):
            return [r for s in row for r in self._remembered([s], self.encoded([s])[0])]
        base = len(self.ids)
        self.ids.extend(ids)
        self.first.extend((after + base).tolist() if whole else [len(self.ids)])
        return [whole] * len(row)

    def forget(self) -> None:
        self.ids, self.first = array("i"), array("q", [0])

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of numbered segments in a row, and how many each segment has."""
        first = np.array(self.first)
        counts = (first[1:] - first[:-1])[numbers]
        places = np.repeat(first[numbers] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        return np.array(self.ids, np.int64)[places], counts


class ByteLevel(Side):
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings are plain text
        byte, tokens = _byte_alphabet(), [b""] * self.tokenizer.get_vocab_size()
        for token, at in self.tokenizer.get_vocab().items():
            tokens[at] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        super().__init__(tokens)

    def encoded(self, segments: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([" " + s for s in segments], add_special_tokens=False)]


class Pieces(Side):
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.processor = SentencePieceProcessor(model_file=path)
        names = [self.processor.id_to_piece(i) for i in range(self.processor.get_piece_size())]
        self.splits = not any(re.search("[^▁]▁", n) for n in names)
        self.space = self.processor.piece_to_id("▁")
        super().__init__([bytes([int(n[3:5], 16)]) if self.processor.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)])

    def encoded(self, segments: list[str]) -> list[list[int]]:
        # An empty text gets no pieces, but a lone space within a text is one.
        return [ids or [self.space] for ids in self.processor.encode(segments, num_threads=1)]


class Block:
    """The aligned documents of a block. Documents without tokens take no room in the arrays.

    a_ids, b_ids    the ids of all documents in a row
    a_docs, b_docs  the number of tokens up to the end of each document
    a_cuts, b_cuts  the number of tokens up to each cut
    """

    def __init__(self, a: Side, b: Side, documents: list[list[int]], fine: np.ndarray, lane: int = LANE):
        numbers = np.fromiter(chain.from_iterable(documents), np.int64, sum(map(len, documents)))
        ends = np.cumsum([len(d) for d in documents], dtype=np.int64)
        wrong = np.concatenate(([0], np.cumsum(~fine[numbers])))
        begins = np.concatenate(([0], ends[:-1])).astype(np.int64)
        self.has = (wrong[ends] == wrong[begins]) & (ends > begins)
        numbers = numbers[np.repeat(self.has, ends - begins)]
        ends = np.cumsum((ends - begins) * self.has)
        self.a_ids, a_counts = a.of(numbers)
        self.b_ids, b_counts = b.of(numbers)
        upto = lambda counts: np.concatenate(([0], np.cumsum(counts)))[ends]
        self.a_docs, self.b_docs = upto(a_counts), upto(b_counts)
        self.a_cuts, self.b_cuts = lockstep(np.cumsum(a.sizes[self.a_ids]), np.cumsum(b.sizes[self.b_ids]), self.a_docs, lane)
        self.cut_docs = np.searchsorted(self.a_cuts, self.a_docs, "right")

    def groups(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First A token, first B token, number of A and of B tokens of each group."""
        a, b = np.concatenate(([0], self.a_cuts)), np.concatenate(([0], self.b_cuts))
        return a[:-1], b[:-1], np.diff(a), np.diff(b)

    def pairs(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, pair of ids (A id * width + B id) and links of it, each pair once per document, by document and pair."""
        a0, b0, na, nb = self.groups()
        n = na * nb
        doc = np.searchsorted(self.cut_docs, np.arange(len(n)), "right")
        span = 1 << int(width * (int(self.a_ids.max(initial=0)) + 1)).bit_length()
        single, few = np.flatnonzero(n == 1), np.flatnonzero((n > 1) & (n <= SMALL))
        keys = [doc[single] * span + self.a_ids[a0[single]] * width + self.b_ids[b0[single]]]
        g = np.repeat(few, n[few])
        at = np.arange(len(g)) - np.repeat(np.cumsum(n[few]) - n[few], n[few])
        keys.append(doc[g] * span + self.a_ids[a0[g] + at // nb[g]] * width + self.b_ids[b0[g] + at % nb[g]])
        times = []
        for large in np.flatnonzero(n > SMALL):  # by different ids, as all links of a long group would not fit
            left, left_n = np.unique(self.a_ids[a0[large] : a0[large] + na[large]], return_counts=True)
            right, right_n = np.unique(self.b_ids[b0[large] : b0[large] + nb[large]], return_counts=True)
            keys.append((doc[large] * span + left[:, None] * width + right).ravel())
            times.append(np.outer(left_n, right_n).ravel())
        keys = np.concatenate(keys)
        if times:
            found, inverse = np.unique(keys, return_inverse=True)
            times = np.concatenate([np.ones(len(keys) - sum(map(len, times)), np.int64), *times])
            links = np.zeros(len(found), np.int64)
            np.add.at(links, inverse, times)
        else:
            found, links = np.unique(keys, return_counts=True)
        return found // span, found % span, links

    def written(self, a_size: int, b_size: int) -> list[str]:
        """Per document its groups as ``a1,a2|b1;a3|b2,b3``."""
        a0, b0, na, nb = self.groups()
        table, lengths = kept_digits(a_size, b_size)
        codes = np.empty(len(self.a_ids) + len(self.b_ids), np.int64)
        last_a, last_b = np.zeros(len(self.a_ids), bool), np.zeros(len(self.b_ids), bool)
        last_a[self.a_cuts - 1], last_b[self.b_cuts - 1] = True, True
        codes[np.arange(len(self.a_ids)) + np.repeat(b0, na)] = self.a_ids * 2 + last_a
        codes[np.arange(len(self.b_ids)) + np.repeat(a0 + na, nb)] = 2 * a_size + self.b_ids * 2 + last_b
        sizes = lengths[codes]
        text = table[codes][np.arange(table.shape[1]) < sizes[:, None]].tobytes().decode("ascii")
        ends = np.concatenate(([0], np.cumsum(sizes)))[self.a_docs + self.b_docs]
        return [text[start : max(start, end - 1)] for start, end in zip([0, *ends[:-1]], ends, strict=True)]


_digits: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def kept_digits(a_size: int, b_size: int) -> tuple[np.ndarray, np.ndarray]:
    """Each id in decimal with what follows it: ``,`` or, at the end of a group's side, ``|`` (A) and ``;`` (B)."""
    if (a_size, b_size) not in _digits:
        shown = [f"{i}{mark}".encode() for size, marks in ((a_size, ",|"), (b_size, ",;")) for i in range(size) for mark in marks]
        widest = max(map(len, shown))
        table = np.frombuffer(b"".join(s.ljust(widest) for s in shown), np.uint8).reshape(-1, widest)
        _digits[a_size, b_size] = table, np.array([len(s) for s in shown], np.int64)
    return _digits[a_size, b_size]


def lockstep(a_ends: np.ndarray, b_ends: np.ndarray, a_docs: np.ndarray, lane: int = LANE) -> tuple[np.ndarray, np.ndarray]:
    """The number of A and of B tokens up to each cut.

    ``a_ends`` and ``b_ends`` are the byte offsets of token ends over all documents in a row, ``a_docs``
    the number of A tokens up to the end of each document. A lane is at most ``lane`` bytes of a document.
    """
    if not len(a_ends):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    over = np.unique(np.concatenate(([0], a_ends[a_docs[a_docs > 0] - 1])))  # where documents begin or end
    lanes = -(-np.diff(over) // lane)
    number = np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    lows = np.repeat(over[:-1], lanes) + number * lane
    highs = np.minimum(lows + lane, np.repeat(over[1:], lanes))
    a, b = np.searchsorted(a_ends, lows, "right"), np.searchsorted(b_ends, lows, "right")
    a_stop, b_stop = np.searchsorted(a_ends, highs, "right"), np.searchsorted(b_ends, highs, "right")
    cuts_a, cuts_b = [], []
    while len(a):
        alive = (a < a_stop) & (b < b_stop)
        if not alive.all():
            a, b, a_stop, b_stop = a[alive], b[alive], a_stop[alive], b_stop[alive]
            if not len(a):
                break
        a_end, b_end = a_ends[a], b_ends[b]
        cut = a_end == b_end
        a, b = a + (a_end <= b_end), b + (b_end <= a_end)
        cuts_a.append(a[cut])
        cuts_b.append(b[cut])
    return np.sort(np.concatenate(cuts_a)), np.sort(np.concatenate(cuts_b))


class Aligner:
    """Both tokenizers of a worker and the segments it has met."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteLevel(a_path), Pieces(b_path)
        self.known: dict[str, int] = {}
        self.right: list[bool] = []

    def segments(self, text: str | None) -> list[str]:
        if not text:
            return []
        if not self.b.splits:
            return [text]
        spaced = " " + text
        return [s[1:] for s in _BREAK.split(spaced)] if _SPACED.search(spaced) else text.split(" ")

    def block(self, texts: list[str | None], lane: int = LANE) -> Block:
        parts = [self.segments(t) for t in texts]
        if len(self.known) > KNOWN:
            self.known, self.right = {}, []
            self.a.forget()
            self.b.forget()
        known = self.known
        new = [s for s in dict.fromkeys(chain.from_iterable(parts)) if s not in known]
        for joined in (True, False):
            some = [s for s in new if _joins(s) == joined]
            known.update(zip(some, range(len(known), len(known) + len(some)), strict=True))
            self.right += [x and y for x, y in zip(self.a.add(some, joined), self.b.add(some, joined), strict=True)]
        block = Block(self.a, self.b, [[known[s] for s in p] for p in parts], np.array(self.right, bool), lane)
        if sum(len(s) > LONGEST for s in new) > 1000 or any(len(s) > 1 << 16 for s in new):  # long ones are not worth keeping
            self.known, self.right = {}, []
            self.a.forget()
            self.b.forget()
        return block


def _aligner(a_path: str, b_path: str) -> Aligner:
    return kept(f"align {a_path} {b_path}", lambda: Aligner(a_path, b_path))


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[list[int], list[str | None]]]:
    ids, texts, chars = [], [], 0
    for batch in batches:
        for number, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids.append(number)
            texts.append(text.as_py())
            chars += len(texts[-1] or "")
            if chars >= size or len(ids) >= 100_000:
                yield ids, texts
                ids, texts, chars = [], [], 0
    if ids:
        yield ids, texts


def _paths(a_path: str | None, b_path: str | None) -> tuple[str, str]:
    if a_path is None or b_path is None:
        import public_tokenizers

        a_path, b_path = a_path or public_tokenizers.path("byte_bpe_50k.json"), b_path or public_tokenizers.path("piece_bpe_32k.model")
    return a_path, b_path


def _slices(ends: np.ndarray) -> Iterator[slice]:
    for start, end in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
        yield slice(start, end)


_ALIGNED = "doc_id long, a_ids array<int>, b_ids array<int>, a_cuts array<int>, b_cuts array<int>"
_ROWS = (
    "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, places array<int>, links array<long>,"
    " pairs array<long>, docs array<long>"
)


def aligned(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """Per document: its ids under A and B, and the number of A and of B tokens up to each cut."""
    a_path, b_path = _paths(a_path, b_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(a_path, b_path)
        for ids, texts in _blocks(batches, block):
            found = aligner.block(texts)
            columns = [ids, [], [], [], []]
            begins = [(0, 0), *zip(found.a_docs.tolist(), found.b_docs.tolist(), strict=True)]
            for a, b, c, (a0, b0) in zip(_slices(found.a_docs), _slices(found.b_docs), _slices(found.cut_docs), begins, strict=False):
                for column, values in zip(columns[1:], (found.a_ids[a], found.b_ids[b], found.a_cuts[c] - a0, found.b_cuts[c] - b0), strict=True):
                    column.append(values.astype(np.int32))
            types = [pa.int64(), *[pa.list_(pa.int32())] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "a_ids", "b_ids", "a_cuts", "b_cuts"])

    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(run, _ALIGNED)


def _ragged(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(values, kind))


def _linked(a_path: str, b_path: str, size: int, written: bool):
    """Per document its alignment and its pairs as places in the block's list of pairs; that list comes as one row more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(a_path, b_path)
        names = [c.split()[0] for c in _ROWS.split(",")]
        number = TaskContext.get().partitionId() << 32
        for ids, texts in _blocks(batches, size):
            found = aligner.block(texts)
            n = len(ids)
            doc, pair, links = found.pairs(len(aligner.b.tokens))
            pairs, places = np.unique(pair, return_inverse=True)
            _, _, na, nb = found.groups()
            total = np.concatenate(([0], np.cumsum(na * nb)))
            count = lambda ends: np.diff(ends, prepend=0)
            ends = np.searchsorted(doc, np.arange(n), "right")
            groups = found.written(len(aligner.a.tokens), len(aligner.b.tokens)) if written else [""] * n
            one, none = np.concatenate, np.zeros(1, np.int64)
            columns = [
                pa.array(np.full(n + 1, number), pa.int64()), pa.array([*ids, None], pa.int64()),
                *[pa.array(one((count(e), none)), pa.int64()) for e in (found.a_docs, found.b_docs, found.cut_docs, total[found.cut_docs])],
                pa.array([*groups, None], pa.string()),
                _ragged(places.astype(np.int32), one((ends, ends[-1:])), pa.int32()), _ragged(links, one((ends, ends[-1:])), pa.int64()),
                _ragged(pairs, one((np.zeros(n, np.int64), [len(pairs)])), pa.int64()),
                _ragged(np.bincount(places, minlength=len(pairs)), one((np.zeros(n, np.int64), [len(pairs)])), pa.int64()),
            ]
            batch = pa.RecordBatch.from_arrays(columns, names)
            for start in range(0, n + 1, 1000):
                yield batch.slice(start, 1000)
            number += 1

    return run


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by block, the counts of its pairs first: the documents with their sums."""
    block, counts, best = None, [], []
    for batch in batches:
        blocks, at, n, top = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "at", "n", "top"))
        edges = np.flatnonzero(np.diff(blocks)) + 1
        out = []
        for start, end in zip([0, *edges], [*edges, len(blocks)], strict=True):
            if start == end:
                continue
            if blocks[start] != block:
                block, counts, best = blocks[start], [], []
            of_pairs = start + int((at[start:end] >= 0).sum())
            if of_pairs > start:
                counts.append(n[start:of_pairs])
                best.append(top[start:of_pairs])
            if of_pairs == end:
                continue
            counts, best = [np.concatenate([np.empty(0, np.int64), *counts])], [np.concatenate([np.empty(0, bool), *best]).astype(bool)]
            part = batch.slice(of_pairs, end - of_pairs)
            places, links, sizes = part["places"], part["links"], part["places"].value_lengths().to_numpy()
            where, times = places.flatten().to_numpy(), links.flatten().to_numpy()
            upto = lambda values: np.diff(np.concatenate(([0], np.cumsum(values)))[np.cumsum(sizes)], prepend=0)  # noqa: B023, E731
            sums = upto(times * best[0][where]), upto(times * counts[0][where])
            names = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
            out.append(pa.RecordBatch.from_arrays([*[part[c] for c in names], *[pa.array(s, pa.int64()) for s in sums], part["groups"]], [*names, "n_best", "count_sum", "groups"]))
        yield from out


def linked(
    docs: DataFrame, a_path: str | None = None, b_path: str | None = None, doc_id: str = "doc_id", text: str = "text",
    show: Callable[[Column], Column] | None = lambda groups: groups, block: int = BLOCK,
) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups.

    n_best counts the links whose pair is in as many documents as any pair of their A id; count_sum adds up
    the documents of each link's pair. ``groups`` is ``a1,a2|b1;a3|b2,b3``, or what ``show`` makes of it before
    the table between the steps is written; it is empty where ``show`` is None.
    """
    paths = _paths(a_path, b_path)
    width = len(Pieces(paths[1]).tokens)
    found = docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(_linked(*paths, block, show is not None), _ROWS)
    found = found.withColumn("is_doc", F.col("groups").isNotNull())
    found = checkpointed(found.withColumn("groups", show(F.col("groups"))) if show else found)
    pairs = found.where(F.size("pairs") > 0).select("block", F.posexplode(F.arrays_zip("pairs", "docs")).alias("at", "of")).select("block", "at", "of.*")
    counts = pairs.groupBy(F.col("pairs").alias("pair")).agg(F.sum("docs").alias("n")).withColumn("a", F.floor(F.col("pair") / width))
    highest = counts.groupBy("a").agg(F.max("n").alias("highest"))
    known = counts.join(highest, "a").select("pair", "n", (F.col("n") == F.col("highest")).alias("top"))
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "places", "links"]
    answers = pairs.select("block", "at", F.col("pairs").alias("pair")).join(known, "pair").select("block", "at", "n", "top")
    rows = found.where("is_doc").select("block", F.lit(-1).alias("at"), F.lit(0).cast("long").alias("n"), F.lit(False).alias("top"), *columns)
    together = answers.unionByName(rows, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", F.col("at") < 0, "at")
    return together.mapInArrow(_scored, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string")
