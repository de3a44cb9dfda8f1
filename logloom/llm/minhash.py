"""Near-duplicate groups by circulant MinHash, banding and exact Jaccard checks.

Signatures use two permutations of the 32-bit numbers only: the first spreads the shingles, the second,
shifted circularly by k, gives coordinate k. ``bands`` bands of ``rows`` coordinates name the buckets.

Documents with equal shingle sets are one *class* from the start; only classes are compared. Two
passes find all links between classes that share a bucket. The first compares one class of each bucket,
the one that meets most others in all its buckets, with the others there, which joins groups of copies at the cost of their size. The second
takes the buckets that are not one group by then, and in blocks of bounded size compares all
their pairs that are not joined, each in the first band that it shares: whole sets are looked at where the
signatures agree as often as those of linked pairs do, less ``MARGIN`` standard deviations, and only links
leave the block. No bucket is capped. Every link is confirmed on whole
sets, as sorted 64-bit shingle hashes, streamed leader by leader.

Defined results: words are split at ASCII white space after lowering A-Z. A text with fewer words than a
shingle is one shingle of its words; null and empty texts have none, stay alone and are kept. Repeated
rows are separate documents of one class. A null id is never the smallest; a group of null ids only has a
null component and none of its rows is kept. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh3_64_intdigest

from logloom.llm.common import checkpointed, kept, no_text, released, salted_join

#: Words of a shingle, share of common shingles that links, bands and coordinates of a band.
SHINGLE, PERCENT, BANDS, ROWS = 5, 80, 28, 6
#: The same at the pipeline's bound of 0.8, where 28 bands of 6 miss 2.0e-4 of the links and these 1.4e-6.
STAGE_BANDS, STAGE_ROWS = 34, 5
#: Parts that the members compared with one leader are dealt over; shingles whose signatures are worked out at once.
LEADER_PARTS, GROUP_SHINGLES = 32, 30_000
#: Classes of a block of the second pass; standard deviations of an agreement that are allowed for.
BLOCK, MARGIN = 256, 5.0
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles."""
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not found:
        return np.zeros(0, np.uint64)
    hashed = np.fromiter(map(xxh3_64_intdigest, found), np.uint64, len(found))
    taken = min(words, len(found))
    mixed = np.full(len(found) - taken + 1, taken, np.uint64)
    for at in range(taken):
        mixed ^= hashed[at : at + len(mixed)]
        mixed *= _FACTORS[at % len(_FACTORS)]
        mixed ^= mixed >> np.uint64(29)
    mixed.sort()
    return mixed[np.concatenate([[True], mixed[1:] != mixed[:-1]])]


def _permuted(x: np.ndarray, first: int, second: int) -> np.ndarray:
    """A permutation of the 32-bit numbers, in place: odd factors and shifted xors can be undone."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(first)
    x ^= x >> np.uint32(15)
    x *= np.uint32(second)
    x ^= x >> np.uint32(16)
    return x


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """A row per set, none of them empty: coordinate k is the least value of the second permutation, shifted by k,
    over the shingles that the first has spread."""
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    hashes = np.concatenate(sets)
    spread = _permuted((hashes >> np.uint64(32)).astype(np.uint32) ^ hashes.astype(np.uint32), 0x7FEB352D, 0x846CA68B)
    out = np.empty((len(sets), coordinates), np.uint32)
    for k in range(coordinates):
        out[:, k] = np.minimum.reduceat(_permuted(spread - np.uint32(k), 0x21F0AAAD, 0x735A2D97), starts)
    return out


def _buckets(marks: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit number for each band of each signature."""
    parts = marks.reshape(len(marks), bands, -1).astype(np.uint64)
    out = np.zeros(parts.shape[:2], np.uint64)
    for at in range(parts.shape[2]):
        out = (out ^ parts[:, :, at]) * _FACTORS[at % len(_FACTORS)]
        out ^= out >> np.uint64(31)
    return out.view(np.int64)


def _sketcher(words: int, bands: int, rows: int):
    @F.pandas_udf("n_shingles long, class binary, bands array<long>")
    def sketch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        kept("near copies", dict)  # the tables of a stage before make room
        for texts in batches:
            sizes, keys = [], []
            buckets: list[np.ndarray | None] = [None] * len(texts)
            group: list[np.ndarray] = []
            places: list[int] = []
            for at, text in enumerate(texts):
                found = shingles(text, words)
                sizes.append(len(found))
                keys.append(blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                if len(found):
                    group.append(found)
                    places.append(at)
                if group and (at == len(texts) - 1 or sum(map(len, group)) >= GROUP_SHINGLES or len(group) >= 64):
                    for place, row in zip(places, _buckets(signatures(group, bands * rows), bands), strict=True):
                        buckets[place] = row
                    group, places = [], []
            yield pd.DataFrame({"n_shingles": sizes, "class": keys, "bands": pd.Series(buckets, dtype=object)})
        released()

    return sketch


def _checked(percent: int, words: int):
    """Over rows sorted by leader, the leader's own row first: (leader, member) of the pairs that are alike enough."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            left, right = [], []
            for a, b, text in zip(batch["leader"].to_pylist(), batch["member"].to_pylist(), batch["text"], strict=True):
                found = shingles(text.as_py(), words)
                if b is None:
                    leader, own = a, found
                    continue
                if leader != a:
                    raise ValueError("a member came before its leader")
                both = len(np.intersect1d(own, found, assume_unique=True))
                if 100 * both >= percent * (len(own) + len(found) - both):
                    left.append(a)
                    right.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["a", "b"])

    return check


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes of the edges (a, b), root being a node of the same component.

    Each round maps every node to its least neighbour or itself and goes on with the edges between
    those. Keys are hashes, so the number of rounds grows with the logarithm of the nodes.
    """
    edges = checkpointed(edges.where("a <> b").distinct())
    roots = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = checkpointed(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")))
        if roots is None:
            roots = step
        else:
            moved = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
            roots = checkpointed(salted_join(roots, moved, ["root"], ["node"], "left").select("node", F.coalesce("next", "root").alias("root")))
        left, right = (step.select(F.col("node").alias(side), F.col("root").alias(f"to_{side}")) for side in "ab")
        moved = salted_join(salted_join(edges, left, ["a"], ["b"]), right, ["b"], ["a"]).select(F.col("to_a").alias("a"), F.col("to_b").alias("b"))
        edges = checkpointed(moved.where("a <> b").distinct())
        if edges.isEmpty():
            return roots


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """Per document: doc_id, class, n_shingles, component_id (least id of the group), kept."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    sketched = source.select("doc_id", F.xxhash64("text").alias("text_key"), _sketcher(words, bands, rows)("text").alias("s"))
    rows_ = checkpointed(sketched.select("doc_id", "text_key", "s.*"))
    classes = rows_.where(F.col("class").isNotNull()).groupBy("class").agg(F.min("doc_id").alias("least_id"))
    roots = _joined(source, rows_, words, percent, bands, rows)
    members = classes
    if roots is None:
        members = members.withColumnRenamed("least_id", "component_id")
    else:
        members = members.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
        least = members.groupBy("root").agg(F.min("least_id").alias("component_id"))
        members = salted_join(members, least, ["root"], ["class"]).select("class", "component_id")
    named = salted_join(rows_.select("doc_id", "n_shingles", "class"), checkpointed(members), ["class"], ["doc_id"], "left")
    alone = F.col("class").isNull()
    named = named.withColumn("component_id", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")))
    kept = F.when(alone, True).otherwise(F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    return named.select("doc_id", "class", "n_shingles", "component_id", kept.alias("kept"))


def _joined(source: DataFrame, rows_: DataFrame, words: int, percent: int, bands: int, rows: int) -> DataFrame | None:
    """(node, root) of the classes that are linked with others; None if there is no link."""
    placed = rows_.where(F.col("class").isNotNull()).select("class", "n_shingles", F.posexplode("bands").alias("band", "bucket"))
    placed = placed.groupBy("band", "bucket", "class").agg(F.min("n_shingles").alias("n"))  # copies of a class
    shared = placed.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = checkpointed(salted_join(placed, shared, ["band", "bucket"], ["class"]))
    if shared.isEmpty():
        return None
    # The class that meets most others leads: of a text's copies, the text itself.
    met = shared.groupBy("class").agg(F.sum("size").alias("met"))
    shared = shared.join(met, "class")
    heads = shared.groupBy("band", "bucket").agg(F.max(F.struct("met", "class", "n")).alias("head"))
    open_ = checkpointed(salted_join(shared.drop("met", "size"), heads, ["band", "bucket"], ["class"]))
    texts = checkpointed(_representatives(source, rows_, open_))
    alike = F.least("head.n", "n") * 100 >= F.greatest("head.n", "n") * percent
    first = open_.where((F.col("class") != F.col("head.class")) & alike).select(F.col("head.class").alias("leader"), F.col("class").alias("member")).distinct()
    links = checkpointed(_verified(first, texts, words, percent))
    roots = None if links.isEmpty() else components(links)
    rest = _still_open(open_, roots)
    if rest.isEmpty():
        return roots
    more = checkpointed(_linked_in_blocks(rest, texts, words, percent, bands, rows))
    if more.isEmpty():
        return roots
    if roots is None:
        return components(more)
    # The groups so far are the nodes now.
    left, right = (roots.select(F.col("node").alias(side), F.col("root").alias(f"to_{side}")) for side in "ab")
    moved = salted_join(salted_join(more, left, ["a"], ["b"], "left"), right, ["b"], ["a"], "left")
    joined = components(moved.select(F.coalesce("to_a", "a").alias("a"), F.coalesce("to_b", "b").alias("b")))
    after = joined.select(F.col("node").alias("root"), F.col("root").alias("next"))
    old = salted_join(roots, after, ["root"], ["node"], "left").select("node", F.coalesce("next", "root").alias("root"))
    return checkpointed(old.union(joined.join(roots.select("node"), "node", "left_anti")))


def _representatives(source: DataFrame, rows_: DataFrame, open_: DataFrame) -> DataFrame:
    """(class, text) of the classes that share a bucket, each from a row of least id."""
    own = salted_join(rows_.select("doc_id", "text_key", "class"), open_.select("class").distinct(), ["class"], ["doc_id"])
    least = own.groupBy("class").agg(F.min(F.struct("doc_id", "text_key")).alias("row")).select("class", "row.*")
    texts = source.where(F.length(no_text("text")) > 0).withColumn("text_key", F.xxhash64("text"))
    same = texts["doc_id"].eqNullSafe(least["doc_id"]) & (texts["text_key"] == least["text_key"])
    return texts.join(least, same).groupBy("class").agg(F.first("text").alias("text"))  # repeated rows


def _verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are alike enough."""
    dealt = checkpointed(pairs.withColumn("part", F.pmod(F.xxhash64("member"), F.lit(LEADER_PARTS)).cast("int")))
    members = dealt.join(texts.withColumnRenamed("class", "member"), "member")
    heads = dealt.select("leader", "part").distinct().join(texts.withColumnRenamed("class", "leader"), "leader").withColumn("member", F.lit(None).cast("binary"))
    both = members.select("leader", "part", "member", "text").union(heads.select("leader", "part", "member", "text"))
    ready = both.repartition("leader", "part").sortWithinPartitions("leader", "part", F.col("member").asc_nulls_first())
    return ready.select("leader", "member", "text").mapInArrow(_checked(percent, words), "a binary, b binary")


def _still_open(open_: DataFrame, roots: DataFrame | None) -> DataFrame:
    """(band, bucket, class, n, root) of the buckets that are not one group by now."""
    rest = open_.select("band", "bucket", "class", "n")
    if roots is None:
        rest = rest.withColumn("root", F.col("class"))
    else:
        rest = rest.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    rest = checkpointed(rest)
    groups = rest.groupBy("band", "bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("size")).where("low <> high")
    return checkpointed(salted_join(rest, groups.select("band", "bucket", "size"), ["band", "bucket"], ["class"]))


def _linked(words: int, percent: int, bands: int, rows: int):
    """Over rows sorted by pair of blocks: the linked pairs (a, b) that are not joined, each in the first band that they share."""
    alike, coordinates = percent / 100, bands * rows
    least = coordinates * alike - MARGIN * (coordinates * alike * (1 - alike)) ** 0.5

    def out(here: tuple, group: list) -> Iterator[pa.RecordBatch]:
        keys, roots, sides, texts = zip(*group, strict=True)
        sets = [shingles(t, words) for t in texts]
        size, side = np.array([len(x) for x in sets]), np.array(sides)
        ids = np.unique(np.array(roots, "S16"), return_inverse=True)[1]
        table = signatures(sets, coordinates)
        shared = table.reshape(len(sets), bands, rows)
        left, right = [], []
        for i in range(len(keys)):
            if here[2] == here[3]:
                others = np.arange(i + 1, len(keys))
            elif side[i] == here[2]:
                others = np.nonzero(side == here[3])[0]
            else:
                continue
            others = others[(ids[others] != ids[i]) & (100 * np.minimum(size[others], size[i]) >= percent * np.maximum(size[others], size[i]))]
            others = others[(table[others] == table[i]).sum(1) >= least]
            others = others[(shared[others] == shared[i]).all(2).argmax(1) == here[0]]
            if not len(others):
                continue
            every = np.concatenate([sets[j] for j in others])
            at = np.minimum(np.searchsorted(sets[i], every), size[i] - 1)
            both = np.add.reduceat((sets[i][at] == every).astype(np.int64), np.cumsum([0, *size[others[:-1]]]))
            for j in others[100 * both >= percent * (size[i] + size[others] - both)]:
                left.append(keys[i])
                right.append(keys[j])
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["a", "b"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, group = None, []
        for batch in batches:
            columns = [batch[n].to_pylist() for n in ("band", "bucket", "one", "other", "class", "root", "side", "text")]
            for band, bucket, one, other, *row in zip(*columns, strict=True):
                if (band, bucket, one, other) != here:
                    if len(group) > 1:
                        yield from out(here, group)
                    here, group = (band, bucket, one, other), []
                group.append(row)
        if len(group) > 1:
            yield from out(here, group)

    return compare


def _linked_in_blocks(rest: DataFrame, texts: DataFrame, words: int, percent: int, bands: int, rows: int) -> DataFrame:
    """The links (a, b) of classes of one bucket that are not joined; the blocks of a bucket meet two by two."""
    dealt = rest.withColumn("sides", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("side", F.pmod(F.xxhash64("class"), F.col("sides")).cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
    dealt = dealt.withColumn("one", F.least("side", "with")).withColumn("other", F.greatest("side", "with"))
    full = dealt.join(texts, "class").select("band", "bucket", "one", "other", "class", "root", "side", "text")
    ready = full.repartition("band", "bucket", "one", "other").sortWithinPartitions("band", "bucket", "one", "other", "class")
    return ready.mapInArrow(_linked(words, percent, bands, rows), "a binary, b binary")


def one_of_each(
    docs: DataFrame, words: int = SHINGLE, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text",
    bands: int = STAGE_BANDS, rows: int = STAGE_ROWS,
) -> DataFrame:
    """The rows of ``docs`` without near copies: of each group the row of least id stays, rows without words stay.

    Needs a written table (a stage's input), as the rows are numbered to tell repeated ones apart.
    """
    from pyspark.sql import Window

    numbered = checkpointed(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row_key")))
    flat = numbered.select(F.col("row_key").alias("doc_id"), F.col(f"doc.{text}").alias("text"), F.col(f"doc.{doc_id}").alias("own_id"))
    groups = near_duplicates(flat.select("doc_id", "text"), words=words, percent=percent, bands=bands, rows=rows)
    ids = flat.select(F.col("doc_id").alias("row_key"), "own_id")
    found = groups.select(F.col("doc_id").alias("row_key"), "component_id", F.col("class").isNull().alias("alone")).join(ids, "row_key")
    first = found.where("NOT alone").groupBy("component_id").agg(F.min(F.struct(F.col("own_id").isNull(), "own_id", "row_key")).alias("least"))
    keys = first.select("least.row_key").union(found.where("alone").select("row_key"))
    return numbered.join(keys, "row_key", "left_semi").select("doc.*")
