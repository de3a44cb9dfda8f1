"""Exact top-k by inner product against brute force, and its defined results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.llm import mtree


def brute(rows, k, scale=64):
    """rows: (id, vector). Per query id its best (vec_id, score)."""
    known = {(i, tuple(int(np.floor(scale * x)) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = {}
    for query in {i for i, _ in known if i % 20 == 0}:
        own = min(v for i, v in known if i == query)
        scores = sorted((-sum(x * y for x, y in zip(own, v)), i) for i, v in known if i != query and len(v) == len(own))
        out[query] = [(i, -s) for s, i in scores[:k]]
    return {q: found for q, found in out.items() if found}


def answers(spark, rows, k=20, page=mtree.PAGE):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = {}
    for r in sorted(mtree.top_k(frame, F.col("vec_id") % 20 == 0, k, page=page).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    return got


@pytest.mark.parametrize(("page", "node"), [(64, 8), (100_000, 128)])
def test_clustered_vectors(spark, monkeypatch, page, node):
    monkeypatch.setattr(mtree, "NODE", node)
    draw = np.random.default_rng(3)
    centres = draw.standard_normal((12, 8))
    rows = [(i, [float(x) for x in centres[i % 12] + 0.05 * draw.standard_normal(8)]) for i in range(1500)]
    assert answers(spark, rows, page=page) == brute(rows, 20)


def test_ties_copies_and_norms(spark):
    draw = np.random.default_rng(5)
    rows = [(i, [float(x) for x in draw.integers(-1, 2, 3)]) for i in range(300)]
    rows += [(i, [1.0, 1.0, 1.0]) for i in range(300, 700)] + [(i, [0.0, 0.0, 0.0]) for i in range(700, 720)] + [(720, [100.0, 0.5, -3.25])]
    rows += rows[:50]
    assert answers(spark, rows, k=7, page=50) == brute(rows, 7)


def test_odd_rows(spark):
    rows = [
        (0, [1.0, 2.0]), (20, [1.0, 2.0]), (20, [1.0, 2.0]), (40, None), (60, [float("nan"), 1.0]), (80, [float("inf"), 1.0]), (100, [None, 1.0]), (120, []), (121, []),
        (140, [3.0]), (141, [-2.0]), (None, [1.0, 2.0]), (1, [0.004, -0.004]), (2, [5.0, 5.0]), (2, [-5.0, 5.0]), (160, [-1e6, 3e5]), (161, [1e7, 1e7]), (180, [7.0, 7.0, 7.0]),
    ]
    rows.append((200, [1e30, 1.0]))
    got = answers(spark, rows)
    assert got == brute(rows[:-1], 20)
    assert 180 not in got and 200 not in got and got[120] == [(121, 0)] and got[140] == [(141, 192 * -128)]


def test_fewer_candidates_than_k_and_no_rows(spark):
    assert answers(spark, [(0, [1.0])]) == {} and answers(spark, [(1, [1.0])]) == {}
    assert answers(spark, [(0, [1.0]), (3, [2.0])]) == {0: [(3, 64 * 128)]}
    assert mtree.top_k(spark.createDataFrame([], "vec_id long, embedding array<double>, page int, copy int"), F.lit(True)).collect() == []


def test_stored_bounds_avoid_distances():
    draw = np.random.default_rng(11)
    centres = 40 * draw.standard_normal((64, 6))
    vectors = np.floor(64 * (centres[np.arange(8192) % 64] + 0.3 * draw.standard_normal((8192, 6)))).astype(np.int64)
    top = int((vectors * vectors).sum(1).max())
    tree = mtree.Tree(vectors, np.arange(8192), np.full(8192, mtree.NO_ID), top, 64)
    for query in range(0, 8192, 512):
        tree.computed = 0
        places, scores = tree.search(vectors[query], query, 20, -np.inf)
        wanted = np.sort((vectors @ vectors[query])[np.arange(8192) != query])[::-1][:20]
        assert np.array_equal(np.sort(scores.astype(np.int64))[::-1], wanted) and len(places) == 20
        assert tree.computed < 8192 // 2


def test_nodes_cover_their_entries():
    draw = np.random.default_rng(2)
    vectors = draw.integers(-50, 50, (3000, 5))
    top = int((vectors * vectors).sum(1).max())
    tree = mtree.Tree(vectors, np.arange(3000), np.full(3000, mtree.NO_ID), top, 32)
    seen = []

    def walk(node):
        if node.children is None:
            assert len(node.places) <= 32 and np.allclose(tree._between(node.pivot, node.places), node.far)
            seen.extend(node.places.tolist())
            return node.places.tolist()
        below = [p for child in node.children for p in walk(child)]
        assert tree._between(node.pivot, np.array(below)).max() <= node.radius + 1e-9
        assert np.allclose(node.far, [tree._between(node.pivot, np.array([c.pivot]))[0] for c in node.children])
        return below

    walk(tree.root)
    assert sorted(seen) == list(range(3000))
