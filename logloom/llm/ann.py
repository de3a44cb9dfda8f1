"""Nearest neighbours by inner product through low-dimensional stable projections and kd-trees.

Vectors are lifted by one coordinate so that all have the greatest norm; then the largest inner product
with a query is the least Euclidean distance to it. Normal (2-stable) projections to ``PROJECTED``
dimensions keep distances up to a chi-square factor: the squared projected distance over the squared true
one has a chi-square distribution. Each block of vectors is indexed by a kd-tree over its projections.
A query takes the tree's leaves in order of projected distance, in steps, and verifies their points with
true inner products; all points within the next leaf's distance are verified by then. It stops once the chi-square probability, that a point nearer
than the current last one had shown up by this radius, reaches ``confidence``.

Equal vectors are one entry of the index with their ``k + 1`` least ids, so a vector that is repeated any
number of times costs one entry and ties among its copies go to the least ids. Blocks of entries and
blocks of queries meet in tasks of bounded size, and each pair of blocks gives at most ``k`` rows a query.

Defined results: vectors that are null, zero, of another length than most, or hold a null or non-finite
component take no part. Scores are sums in double precision in the order of the components; equal scores
go to the smaller id. With fewer candidates than ``k`` all are returned. Repeated rows of one id and
vector are one candidate; of different vectors under one id each is a candidate and the least one asks. A null id is none. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from logloom.llm.common import checkpointed

PROJECTED, CONFIDENCE, SEED = 8, 0.99, 20240101
#: Entries of an index block, queries of a query block, points of a leaf, leaves verified in a step, queries verified together.
BLOCK, QUERIES, LEAF, STEP, ASKED = 16_384, 32_768, 128, 8, 512


def chi_square_cdf(x: np.ndarray, degrees: int) -> np.ndarray:
    """For an even number of degrees."""
    half, term, total = x / 2, np.ones_like(x), np.zeros_like(x)
    for i in range(degrees // 2):
        total += term
        term = term * half / (i + 1)
    return 1 - np.exp(-half) * total


def projection(dimensions: int, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dimensions, PROJECTED))


def leaves(points: np.ndarray) -> list[np.ndarray]:
    """The leaves of a kd-tree: places of points, halved along the widest side until there are ``LEAF`` at most."""
    parts = [np.arange(len(points))]
    while max(map(len, parts)) > LEAF:
        halves = []
        for part in parts:
            axis = int(np.argmax(np.ptp(points[part], 0)))
            order = part[np.argsort(points[part, axis], kind="stable")]
            halves += [h for h in (order[: len(order) // 2], order[len(order) // 2 :]) if len(h)]
        parts = halves
    return parts


def search(vectors: np.ndarray, queries: np.ndarray, k: int, top: float, confidence: float = CONFIDENCE) -> np.ndarray:
    """Per query the places of its ``k`` entries of largest inner product that were found, -1 for none.

    ``top`` is the greatest squared norm of all vectors. Queries go on in steps of ``STEP`` leaves; in a
    step each leaf meets all queries that have reached it at once.
    """
    lifted = np.sqrt(np.maximum(top - (vectors**2).sum(1), 0))
    base = projection(vectors.shape[1] + 1)
    points = vectors @ base[:-1] + lifted[:, None] * base[-1]
    parts = leaves(points)
    low, high = np.stack([points[p].min(0) for p in parts]), np.stack([points[p].max(0) for p in parts])
    held = [np.ascontiguousarray(vectors[p]) for p in parts]
    widest = max(map(len, parts))
    # A query is scaled to the common norm as well, which changes no order.
    scale = math.sqrt(top) / np.sqrt((queries**2).sum(1))
    projected = (queries * scale[:, None]) @ base[:-1]
    places = np.full((len(queries), k), -1, np.int64)
    for start in range(0, len(queries), ASKED):
        own = slice(start, start + ASKED)
        asked, spots = queries[own], projected[own]
        boxes = np.zeros((len(asked), len(parts)))
        for axis in range(PROJECTED):
            spot = spots[:, axis : axis + 1]
            boxes += np.maximum(np.maximum(low[:, axis] - spot, spot - high[:, axis]), 0) ** 2
        order = np.argsort(boxes, 1, kind="stable")
        best, found = np.full((len(asked), k), -np.inf), np.full((len(asked), k), -1, np.int64)
        active = np.arange(len(asked))
        for taken in range(0, len(parts), STEP):
            wave = order[active, taken : taken + STEP]
            scores = np.full((len(active), wave.shape[1] * widest), -np.inf)
            numbers = np.full(scores.shape, -1, np.int64)
            for leaf in np.unique(wave):
                rows, columns = np.nonzero(wave == leaf)
                at = columns[:, None] * widest + np.arange(len(parts[leaf]))
                scores[rows[:, None], at] = asked[active[rows]] @ held[leaf].T
                numbers[rows[:, None], at] = parts[leaf]
            scores, numbers = np.hstack([best[active], scores]), np.hstack([found[active], numbers])
            keep = np.argpartition(-scores, k - 1, 1)[:, :k]
            best[active], found[active] = np.take_along_axis(scores, keep, 1), np.take_along_axis(numbers, keep, 1)
            if taken + STEP >= len(parts):
                break
            radius = boxes[active, order[active, taken + STEP]]
            distance = np.maximum(2 * top - 2 * best[active].min(1) * scale[own][active], 1e-12)
            active = active[~(chi_square_cdf(radius / distance, PROJECTED) >= confidence)]
            if not len(active):
                break
        places[own] = found
    return places


def _matched(k: int, top: float, confidence: float):
    """Over rows sorted by pair of blocks, the index entries first: (query, entry) of each pair."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, entries, asked = None, [], []

        def answer() -> Iterator[pa.RecordBatch]:
            if entries and asked:
                numbers, left, right = [e[0] for e in entries], [], []
                found = search(np.array([e[1] for e in entries]), np.array([q[1] for q in asked]), k + 1, top, confidence)
                for (query, _), places in zip(asked, found.tolist(), strict=True):
                    right += [numbers[p] for p in places if p >= 0]
                    left += [query] * (len(right) - len(left))
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["query", "entry"])

        for batch in batches:
            for at in range(batch.num_rows):
                here = (batch["block"][at].as_py(), batch["query_block"][at].as_py())
                if here != pair:
                    yield from answer()
                    pair, entries, asked = here, [], []
                (asked if batch["asks"][at].as_py() else entries).append((batch["number"][at].as_py(), batch["vector"][at].values.to_numpy()))
        yield from answer()

    return match


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda done, x: done + x)


def neighbours(
    table: DataFrame, is_query: Column, k: int = 20, confidence: float = CONFIDENCE, block: int = BLOCK, query_block: int = QUERIES,
    vec_id: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """Per query its ``k`` nearest: query_id, rank (from 1), vec_id, score."""
    spark = table.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows = table.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    finite = F.forall("vector", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = rows.where(F.col("id").isNotNull() & finite & F.exists("vector", lambda x: x != 0)).withColumn("size", F.size("vector"))
    sizes = rows.groupBy("size").count().orderBy(F.desc("count"), "size").first()
    if sizes is None:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.col("size") == sizes["size"]).drop("size")
    own = Window.partitionBy("key").orderBy("id")
    keyed = rows.withColumn("key", F.sha2(F.col("vector").cast("string").cast("binary"), 256))
    first = keyed.select("key", "id").distinct().withColumn("nth", F.row_number().over(own)).where(F.col("nth") <= k + 1)
    ids = first.groupBy("key").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    entries = keyed.groupBy("key").agg(F.first("vector").alias("vector")).join(ids, "key")
    # A number without order for each entry; written, so that it stays.
    entries = checkpointed(entries.withColumn("number", F.monotonically_increasing_id()).select("number", "vector", "ids"))
    asked = checkpointed(rows.where("asks").groupBy("id").agg(F.min("vector").alias("vector")).select(F.col("id").alias("number"), "vector"))
    facts = entries.agg(F.count(F.lit(1)).alias("n"), F.max(_sum(F.transform("vector", lambda x: x * x))).alias("top")).first()
    n_queries = asked.count()
    if not n_queries:
        return spark.createDataFrame([], schema)
    blocks, query_blocks = -(-facts["n"] // block), -(-n_queries // query_block)
    dealt = lambda number, parts: F.pmod(F.xxhash64(number), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    index = entries.select(dealt("number", blocks).alias("block"), every(query_blocks).alias("query_block"), F.lit(False).alias("asks"), "number", "vector")
    questions = asked.select(every(blocks).alias("block"), dealt("number", query_blocks).alias("query_block"), F.lit(True).alias("asks"), "number", "vector")
    together = index.union(questions).repartition("block", "query_block").sortWithinPartitions("block", "query_block", "asks", "number")
    pairs = together.mapInArrow(_matched(k, float(facts["top"]), confidence), "query long, entry long")
    met = pairs.join(asked.select(F.col("number").alias("query"), F.col("vector").alias("own")), "query")
    met = met.join(entries.withColumnRenamed("number", "entry"), "entry")
    scored = met.select(F.col("query").alias("query_id"), _sum(F.zip_with("own", "vector", lambda x, y: x * y)).alias("score"), F.explode("ids").alias("vec_id"))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = scored.where("vec_id <> query_id").withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
