"""Exact top-k by integer inner product through M-trees, searched best first.

Vectors are lifted by one coordinate so that all have the greatest norm; the Euclidean distance to a query is
then a metric in whose order the inner product falls. The root of the tree is a bounded table of routing
objects (pivots). Each entry belongs to its nearest pivot, and the entries of a pivot are cut by their parent
distance into pages, whose covering ranges are kept as a table. A page is the subtree of one task: a balanced
M-tree of nodes of ``NODE`` entries, each with its distance to the parent's routing object, and child nodes
with covering radii.

A query first searches the page it falls in. Its k-th distance there bounds the second pass, in which it goes
only to pages that the triangle inequality does not rule out, and within a page, nodes are taken in order of
their least possible distance until none can hold a better entry. Before a distance to an entry or a child's
routing object is computed, the stored parent distance is tried: where | d(query, parent) - d(entry, parent) |
exceeds the bound, the distance is not computed.

Squared distances are whole numbers, so scores are exact; bounds are widened by ``SLACK`` for the rounding of
square roots, and only what is strictly worse is left out, so ties are kept. Equal vectors are one entry with
their ``k + 1`` least ids. Pages with many queries are copied, one copy per ``ASKED`` queries.

Defined results: components become floor(64 * x). Vectors that are null or hold a null or non-finite component
take no part, nor do those with a squared norm of 2^62 or more, whose scores are no longs. A query meets the vectors
of its own length; the empty vector is one of length 0. Equal scores go to the smaller id. Repeated rows of one id and
vector are one candidate; of different vectors under one id each is a candidate and the least one asks. A null
id takes no part. With fewer candidates than ``k`` all are returned. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from logloom.llm.common import checkpointed
from logloom.operators.indexing import with_order_index

#: Entries of a page, of a node, routing objects of the root per length of vectors, lengths with own routing objects, queries per copy of a page.
PAGE, NODE, ROOT, LENGTHS, ASKED = 8192, 512, 256, 16, 8192
SLACK = 1e-6
NO_ID = np.iinfo(np.int64).max


class Node:
    """A page of the tree: its routing object is ``pivot``, its entries or children lie within ``radius`` of it."""

    __slots__ = ("children", "far", "pivot", "places", "radius")

    def __init__(self, pivot: int, radius: float, far: np.ndarray, places: np.ndarray | None, children: list[Node] | None):
        self.pivot, self.radius, self.far, self.places, self.children = pivot, radius, far, places, children


class Tree:
    """A balanced M-tree over the entries of one page, and its best-first search.

    ``norms`` are squared norms, ``top`` is the squared norm to which all are lifted.
    """

    def __init__(self, vectors: np.ndarray, first: np.ndarray, second: np.ndarray, top: int, node: int = NODE):
        # No inner product, nor a part of its sum, is above the greatest squared norm: below 2^52 doubles are exact.
        self.vectors, self.first, self.second, self.node = vectors.astype(float) if top < 1 << 52 else vectors, first, second, node
        norms = (self.vectors * self.vectors).sum(1)
        self.lifts, self.top = np.sqrt(np.maximum(float(top) - norms.astype(float), 0)), float(top)
        self.computed = 0
        self.root = self._built(np.arange(len(vectors)))

    def _between(self, one: int, others: np.ndarray) -> np.ndarray:
        """Distances of lifted entries."""
        inner = (self.vectors[others] @ self.vectors[one]).astype(float)
        return np.sqrt(np.maximum(2 * self.top - 2 * (inner + self.lifts[others] * self.lifts[one]), 0))

    def _halves(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        one = places[int(self._between(int(places[0]), places).argmax())]
        far = self._between(int(one), places)
        order = np.argsort(far - self._between(int(places[int(far.argmax())]), places), kind="stable")
        return places[order[: len(order) // 2]], places[order[len(order) // 2 :]]

    def _pivot(self, places: np.ndarray) -> int:
        """The member nearest to the middle."""
        middle = np.append(self.vectors[places].mean(0), self.lifts[places].mean())
        away = ((self.vectors[places] - middle[:-1]) ** 2).sum(1) + (self.lifts[places] - middle[-1]) ** 2
        return int(places[int(away.argmin())])

    def _built(self, places: np.ndarray) -> Node:
        """Halved until a part fits a node; the parts of one level are the children of one node."""
        pivot = self._pivot(places)
        far = self._between(pivot, places)
        if len(places) <= self.node:
            order = np.argsort(far, kind="stable")
            return Node(pivot, float(far.max()), far[order], places[order], None)
        parts = [places]
        while len(parts) < 16 and max(map(len, parts)) > self.node:
            parts = [half for part in parts for half in self._halves(part)]
        children = [self._built(p) for p in parts]
        return Node(pivot, float(far.max()), self._between(pivot, np.array([c.pivot for c in children])), None, children)

    def search(self, query: np.ndarray, own: int, k: int, worst: float) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the ``k`` best entries whose score is at least ``worst``, without rows of the id ``own``."""
        if self.vectors.dtype == float:
            query = query.astype(float)
        size = float((query * query).sum())
        # Distance of the query, at its own norm, to a lifted entry: sqrt(size + top - 2 * inner).
        distance = lambda inner: np.sqrt(np.maximum(size + self.top - 2 * inner, 0))
        slack = SLACK * (1 + np.sqrt(size + self.top))
        bound = float(distance(worst)) + slack if np.isfinite(worst) else np.inf
        best_places, best_scores = np.empty(0, np.int64), np.empty(0, self.vectors.dtype)
        start = float(distance(float(self.vectors[self.root.pivot] @ query)))
        queue = [(max(start - self.root.radius, 0.0), 0, start, self.root)]
        count = 0
        self.computed += 1
        while queue:
            least, _, to_pivot, node = heapq.heappop(queue)
            if least > bound:
                break
            if node.children is None:
                # Entries are in order of their parent distance, so those within the bound are a run.
                places = node.places[np.searchsorted(node.far, to_pivot - bound) : np.searchsorted(node.far, to_pivot + bound, "right")]
                scores = self.vectors[places] @ query
                self.computed += len(places)
                keep = np.flatnonzero(scores >= worst)
                keep = keep[(self.first[places[keep]] != own) | (self.second[places[keep]] != NO_ID)]
                if not len(keep):
                    continue
                places, scores = np.concatenate([best_places, places[keep]]), np.concatenate([best_scores, scores[keep]])
                if len(places) >= k:
                    ids = np.where(self.first[places] == own, self.second[places], self.first[places])
                    order = np.lexsort((ids, -scores))[:k]
                    places, scores = places[order], scores[order]
                    worst = scores[-1]
                    bound = min(bound, float(distance(float(worst))) + slack)
                best_places, best_scores = places, scores
                continue
            near = np.abs(to_pivot - node.far) - np.array([c.radius for c in node.children]) <= bound
            for at in np.flatnonzero(near):
                child = node.children[at]
                to_child = float(distance(float(self.vectors[child.pivot] @ query)))
                self.computed += 1
                if to_child - child.radius <= bound:
                    count += 1
                    heapq.heappush(queue, (max(to_child - child.radius, 0.0), count, to_child, child))
        return best_places, best_scores


def _searched(k: int, tops: dict[int, int]):
    """Over rows sorted by page and copy, the entries first: (query, entry, score) of each query's best in the page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, entries, tree = None, [], None
        out: list[tuple[int, int, int]] = []
        names = ["query", "entry", "score"]
        for batch in batches:
            vectors = batch["vector"]
            for at, row in enumerate(zip(*(batch[c].to_pylist() for c in ("page", "copy", "asks", "number", "first", "second", "worst")), strict=True)):
                page, copy, asks, number, first, second, worst = row
                if (page, copy) != here:
                    here, entries, tree = (page, copy), [], None
                vector = vectors[at].values.to_numpy(zero_copy_only=False)
                if not asks:
                    entries.append((number, first, NO_ID if second is None else second, vector))
                    continue
                if tree is None:
                    numbers, firsts, seconds = (np.array([e[i] for e in entries], np.int64) for i in range(3))
                    whole = np.array([e[3] for e in entries], np.int64)
                    tree, entries = Tree(whole, firsts, seconds, tops[whole.shape[1]]), [(numbers,)]
                places, scores = tree.search(vector, number, k, -np.inf if worst is None else float(worst))
                out += zip([number] * len(places), entries[0][0][places].tolist(), scores.astype(np.int64).tolist(), strict=True)
            if len(out) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names)

    return run


def _routed(pivots: dict[int, np.ndarray], tops: dict[int, int], lifted: bool, reach: dict[tuple[int, int], float] | None = None):
    """Rows (size, vector, ...) with a pivot and the distance to it: the nearest, or with ``reach``, how far the entries of
    each pivot lie, all whose entries can be within the row's ``limit``. Entries are lifted, queries keep their norm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch["size"].to_numpy()
            for size in np.unique(sizes).tolist():
                part = batch.take(pa.array(np.flatnonzero(sizes == size)))
                own, top = pivots[size].astype(float), float(tops[size])
                vectors = part["vector"].flatten().to_numpy(zero_copy_only=False).astype(float).reshape(part.num_rows, size)
                norms, inner = (vectors * vectors).sum(1)[:, None], vectors @ own.T
                if lifted:
                    inner += np.sqrt(np.maximum(top - norms, 0)) * np.sqrt(np.maximum(top - (own * own).sum(1), 0))
                    norms = top
                away = np.sqrt(np.maximum(norms + top - 2 * inner, 0))
                if reach is None:
                    who, which = np.arange(part.num_rows), away.argmin(1)
                else:
                    wide = np.array([reach[size, p] for p in range(len(own))])
                    who, which = np.nonzero(away - wide <= part["limit"].to_numpy()[:, None])
                columns = [*part.take(pa.array(who)).columns, pa.array(which, pa.int32()), pa.array(away[who, which])]
                yield pa.RecordBatch.from_arrays(columns, [*part.schema.names, "pivot", "far"])

    return run


def top_k(table: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", page: int = PAGE, scale: int = 64) -> DataFrame:
    """Per query its ``k`` highest inner products: query_id, rank (from 1), vec_id, score."""
    spark = table.sparkSession
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rows = table.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("given"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    finite = F.forall("given", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = rows.where(F.col("id").isNotNull() & finite)
    norm = F.aggregate("given", F.lit(0.0), lambda done, x: done + F.floor(x * scale).cast("double") * F.floor(x * scale).cast("double"))
    fits = F.forall("given", lambda x: F.abs(x * scale) < 2.0**31) & (norm < 2.0**62)
    rows = rows.where(fits).select("id", F.transform("given", lambda x: F.floor(x * scale).cast("long")).alias("vector"), "asks").withColumn("size", F.size("vector"))
    keyed = rows.withColumn("key", F.sha2(F.concat_ws(",", F.col("vector").cast("array<string>")).cast("binary"), 256))
    nth = F.row_number().over(Window.partitionBy("key").orderBy("id"))
    least = keyed.select("key", "id").distinct().withColumn("nth", nth).where(F.col("nth") <= k + 1)
    ids = least.groupBy("key").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    one = keyed.groupBy("key").agg(F.first("vector").alias("vector"), F.first("size").alias("size"))
    entries = checkpointed(one.join(ids, "key").withColumn("number", F.monotonically_increasing_id()))
    asked = checkpointed(rows.where("asks").groupBy("id").agg(F.min("vector").alias("vector")).select(F.col("id").alias("number"), "vector", F.size("vector").alias("size")))
    square = F.aggregate("vector", F.lit(0).cast("long"), lambda done, x: done + x * x)
    # Lengths of vectors are a property of the model; rare ones beyond LENGTHS share the way, each with one routing object.
    facts = {r["size"]: (r["n"], r["top"]) for r in entries.groupBy("size").agg(F.count(F.lit(1)).alias("n"), F.max(square).alias("top")).collect()}
    if not facts or asked.isEmpty():
        return none
    tops = {size: top for size, (_, top) in facts.items()}
    common = sorted(facts, key=lambda s: (-facts[s][0], s))[:LENGTHS]
    rest = entries.where(~F.col("size").isin(common)).groupBy("size").agg(F.min_by("vector", "key").alias("vector")).collect()
    pivots = {r["size"]: np.array([r["vector"]], np.int64) for r in rest}
    for size in common:
        wanted = min(ROOT, -(-facts[size][0] // page))
        picked = entries.where(F.col("size") == size).orderBy("key").limit(wanted).select("vector").collect()  # ROOT at most
        pivots[size] = np.array([r["vector"] for r in picked], np.int64).reshape(len(picked), size)

    def routed(df: DataFrame, lifted: bool, reach: dict[tuple[int, int], float] | None = None) -> DataFrame:
        schema = ", ".join(f"{name} {kind}" for name, kind in df.dtypes)
        return df.mapInArrow(_routed(pivots, tops, lifted, reach), f"{schema}, pivot int, far double")

    own = routed(entries.select("number", "size", "vector", F.col("ids")[0].alias("first"), F.get("ids", F.lit(1)).alias("second")), True)
    placed = with_order_index(own, ["far", "number"], ["size", "pivot"], "at").withColumn("cut", F.floor(F.col("at") / page)).drop("at")
    keys = ["size", "pivot", "cut"]
    pages = checkpointed(placed.groupBy(*keys).agg(F.min("far").alias("low"), F.max("far").alias("high")).withColumn("page", F.monotonically_increasing_id()))
    placed = checkpointed(placed.join(pages.select(*keys, "page"), keys).select("page", "number", "vector", "first", "second"))

    def searched(questions: DataFrame) -> DataFrame:
        """The best of each page for rows (page, number, vector, worst), at most ``k`` a row."""
        copies = questions.groupBy("page").agg(F.ceil(F.count(F.lit(1)) / ASKED).cast("int").alias("copies"))
        parts = placed.join(copies, "page").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
        asking = questions.join(copies, "page").withColumn("copy", F.pmod(F.xxhash64("number"), "copies").cast("int"))
        empty = F.lit(None).cast("long")
        together = parts.select("page", "copy", F.lit(False).alias("asks"), "number", "vector", "first", "second", empty.alias("worst")).union(
            asking.select("page", "copy", F.lit(True).alias("asks"), "number", "vector", empty.alias("first"), empty.alias("second"), "worst")
        )
        dealt = together.repartition("page", "copy").sortWithinPartitions("page", "copy", "asks", "number")
        return dealt.mapInArrow(_searched(k, tops), "query long, entry long, score long")

    # First pass: the page that the query falls in, or is nearest to.
    gap = F.greatest(F.col("low") - F.col("far"), F.col("far") - F.col("high"), F.lit(0.0))
    home = routed(asked, False).join(pages, ["size", "pivot"]).groupBy("number").agg(F.min_by(F.struct("vector", "page"), F.struct(gap, "cut")).alias("of"))
    home = checkpointed(home.select("of.page", "number", "of.vector", F.lit(None).cast("long").alias("worst")))
    first = checkpointed(searched(home))
    # Second pass: the pages that the bound of the first does not rule out.
    worst = first.groupBy("query").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("worst")).select(F.col("query").alias("number"), "worst")
    bounded = asked.join(worst, "number", "left").join(home.select("number", F.col("page").alias("seen")), "number")
    top_of = F.element_at(F.create_map(*[F.lit(v) for size, top in tops.items() for v in (size, float(top))]), F.col("size"))
    size_of = F.aggregate("vector", F.lit(0.0), lambda done, x: done + (x * x).cast("double"))
    limit = F.sqrt(F.greatest(size_of + top_of - 2 * F.col("worst").cast("double"), F.lit(0.0))) + SLACK * (1 + F.sqrt(size_of + top_of))
    reach = {(r["size"], r["pivot"]): r["reach"] for r in pages.groupBy("size", "pivot").agg(F.max("high").alias("reach")).collect()}  # one per pivot
    far = routed(bounded.withColumn("limit", F.coalesce(limit, F.lit(float("inf")))), False, reach)
    more = far.join(pages, ["size", "pivot"]).where((gap <= F.col("limit")) & (F.col("page") != F.col("seen")))
    found = first.union(searched(more.select("page", "number", "vector", "worst")))
    best = found.join(entries.select(F.col("number").alias("entry"), "ids"), "entry")
    rows_of = best.select(F.col("query").alias("query_id"), F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows_of.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
