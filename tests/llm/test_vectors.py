"""Operators on vectors against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from notewright.llm import cover_tree, kmeans_tree, queries

ODD = [(900, None), (901, [float("nan")] * 6), (902, [float("inf")] + [0.0] * 5), (903, [None] + [0.1] * 5), (904, [0.0] * 6), (None, [0.2] * 6), (905, [0.5] * 4)]


def table(spark, n=400, dim=6, seed=0, more=()):
    draw = np.random.default_rng(seed)
    centre = draw.normal(size=(5, dim))
    rows = [(k, (centre[k % 5] + 0.3 * draw.normal(size=dim)).round(2).tolist()) for k in range(n)]
    rows += [(n + k, rows[k][1]) for k in range(0, 60, 7)]  # ties
    rows += [rows[3], (5, rows[5][1]), (10, rows[11][1]), (20, rows[22][1]), (20, rows[21][1]), (7, rows[8][1])]  # repeated rows, ids with more than one vector
    rows += list(more)
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("v", "leaf", "rank", "asks")}), rows


def sound(rows, dim=6):
    fit = lambda v: v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)
    return [(i, np.array(v, np.float32).astype(np.float64)) for i, v in rows if i is not None and fit(v)]


def nearest(v, q, k):
    """(score, id) of the k best rows but the q-th."""
    return [(-s, i) for s, i in sorted((-(v[q][1] @ x), i) for at, (i, x) in enumerate(v) if at != q)[:k]]


def test_cover_tree_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(cover_tree, "CANDIDATES", 100)
    monkeypatch.setattr(cover_tree, "QUERIES", 8)
    monkeypatch.setattr(cover_tree, "LEAF", 16)
    frame, rows = table(spark, more=ODD)
    got = cover_tree.top_k(cover_tree.whole_numbers(frame, "embedding"), F.col("vec_id") % 5 == 0, 7).collect()
    v = [(i, np.floor(256 * x).astype(np.int64)) for i, x in sound(rows)]
    want = [(i, k, other, s) for q, (i, _) in enumerate(v) if i % 5 == 0 for k, (s, other) in enumerate(nearest(v, q, 7), 1)]
    # 905 is shorter: it meets nothing of its length
    assert sorted(map(tuple, got)) == sorted(want)


def test_huge_components_stay_exact(spark):
    rows = [(k, [float(2**40 + k), float(k)]) for k in range(12)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = cover_tree.top_k(cover_tree.whole_numbers(frame, "embedding", 1.0), F.col("vec_id") == 0, 3).collect()
    exact = [min(2**63 - 1, (2**40) * (2**40 + k)) for k in range(12)]
    assert [r.score for r in sorted(got, key=lambda r: r.rank)] == sorted(exact[1:], reverse=True)[:3]


def clustered(n=6000, dim=24, seed=3):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(60, dim))
    return np.floor(256 * (centres[draw.integers(0, 60, n)] + 0.05 * draw.normal(size=(n, dim)))).astype(np.int64)


def as_vectors(spark, x):
    return spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, v array<long>")


def test_the_trees_leave_most_pairs_of_clustered_vectors_out(spark):
    x = clustered()
    x[7, 3] = 10**12  # its own cell: the others stay on the tree
    queries = F.col("vec_id") % 50 == 0
    vectors = as_vectors(spark, x).repartition(4)
    assert cover_tree.pairs_met(vectors, queries, 5) < 0.3 * len(x) * len(range(0, len(x), 50))
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in cover_tree.top_k(vectors, queries, 5).collect()}
    for q in range(0, len(x), 500):
        scores = [int(s) for s in x.astype(object) @ x[q].astype(object)]
        best = sorted((-s, i) for i, s in enumerate(scores) if i != q)[:5]
        assert [got[q, k] for k in range(1, 6)] == [(i, -s) for s, i in best]


def test_one_dual_descent_prunes_and_keeps_ties():
    x = clustered(2000).astype(np.float64)
    x[11] = x[3]
    ids = np.arange(len(x))
    at, met = cover_tree.dual_search(x[:100], ids[:100], x, ids, 4, np.full(100, -np.inf))
    assert met < 0.3 * 100 * len(x)
    scores = x[:100] @ x.T
    scores[np.arange(100), np.arange(100)] = -np.inf
    assert all(at[q].tolist() == np.lexsort((ids, -scores[q]))[:4].tolist() for q in range(100))


def test_careful_search_decides_in_whole_numbers():
    draw = np.random.default_rng(1)
    x = (draw.integers(-(2**40), 2**40, (300, 5)) // 1000 * 1000).astype(np.int64)
    x[20] = x[10]
    x[20, 0] += 1
    ids = np.arange(len(x))
    at = cover_tree.careful_search(x[:20], ids[:20], x, ids, 6)
    for q in range(20):
        exact = sorted((-sum(int(a) * int(b) for a, b in zip(x[q], x[j], strict=True)), j) for j in range(len(x)) if j != q)[:6]
        assert at[q].tolist() == [j for _, j in exact]


def test_few_candidates_are_all_returned(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (50, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = cover_tree.top_k(cover_tree.whole_numbers(frame, "embedding"), F.col("vec_id") % 50 == 0, 5).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == [(0, 1, 1), (0, 2, 50), (50, 1, 1), (50, 2, 0)]
    got = kmeans_tree.search(frame, "embedding", F.col("vec_id") % 50 == 0, 5).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == [(0, 1, 1), (0, 2, 50), (50, 1, 1), (50, 2, 0)]


@pytest.mark.parametrize("search", [lambda d: cover_tree.top_k(cover_tree.whole_numbers(d, "embedding"), F.lit(True), 3), lambda d: kmeans_tree.search(d, "embedding", F.lit(True), 3)])
def test_no_vectors(spark, search):
    assert search(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_covering_radii_hold():
    points = np.random.default_rng(2).integers(-200, 200, (500, 8)).astype(np.float64)
    tree = cover_tree.CoverTree(points, 10)

    def below(node):
        out = list(tree.rows[node])
        for kid in tree.children[node]:
            out += below(kid)
        return out

    assert sorted(below(0)) == list(range(500))
    for node, centre in enumerate(tree.centre):
        far = np.linalg.norm(points[below(node)] - points[centre], axis=1).max()
        assert far <= tree.radius[node] + 1e-6


def test_approximate_search_recalls_and_scores_exactly(spark, monkeypatch):
    monkeypatch.setattr(kmeans_tree, "LEAF", 40)
    monkeypatch.setattr(kmeans_tree, "ROWS", 100)
    frame, rows = table(spark, n=1500, seed=4, more=ODD)
    got = kmeans_tree.search(frame, "embedding", F.col("vec_id") % 20 == 0, 10).collect()
    v = [(i, x) for i, x in sound(rows) if x.any()]
    mine, want = {}, {}
    for r in got:
        mine.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for q, (i, _) in enumerate(v):
        if i % 20 == 0:
            want.setdefault(i, []).extend((k, other, s) for k, (s, other) in enumerate(nearest(v, q, 10), 1))
    near = lambda answers: {(k, round(s, 9)) for k, _, s in answers}
    assert {q: len(a) for q, a in mine.items()} == {q: len(a) for q, a in want.items()} and len(want[20]) == 30
    assert sum(len(near(mine[q]) & near(want[q])) for q in want) >= 0.9 * sum(len(near(want[q])) for q in want)
    # scores are those of rows that there are, and one list follows its order
    for q, answers in mine.items():
        made = {(i, round(float(x @ y), 9)) for own, x in v if own == q for i, y in v}
        assert all((i, round(s, 9)) in made for _, i, s in answers)
        if len(answers) == 10:
            order = [(-s, i) for _, i, s in sorted(answers)]
            assert order == sorted(order)


def test_rows_that_share_an_id_are_all_candidates(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (1, [0.9, 0.5]), (0, [0.25, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = cover_tree.top_k(cover_tree.whole_numbers(frame, "embedding"), F.col("vec_id") == 0, 5).collect()
    first, second = [(1, 58880), (1, 32768), (0, 16384)], [(0, 16384), (1, 14720), (1, 8192)]
    want = [(0, k, i, s) for answers in (first, second) for k, (i, s) in enumerate(answers, 1)]
    assert sorted(map(tuple, got)) == sorted(want)
    got = kmeans_tree.search(frame, "embedding", F.col("vec_id") == 0, 5).select("query_id", "rank", "vec_id", F.round(F.col("score") * 65536).cast("long")).collect()
    assert sorted((r[0], r[1], r[2]) for r in got) == sorted(w[:3] for w in want)
    assert all(abs(a[3] - b[3]) <= 256 for a, b in zip(sorted(map(tuple, got)), sorted(want), strict=True))


def test_every_length_of_vector_is_searched(spark):
    x = clustered(900, 8).tolist()
    rows = [(k, v) for k, v in enumerate(x)] + [(1000 + k, [float(k % 7), 1.0]) for k in range(30)] + [(2000, [1.0])]
    frame = spark.createDataFrame([(k, [float(y) for y in v]) for k, v in rows], "vec_id long, embedding array<double>")
    got = {}
    for r in kmeans_tree.search(frame, "embedding", F.col("vec_id") % 20 == 0, 6).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.vec_id
    for q in (1000, 1020):
        own = [(k, v) for k, v in rows if 1000 <= k < 2000 and k != q]
        best = sorted((-sum(a * b for a, b in zip(v, dict(rows)[q], strict=True)), k) for k, v in own)[:6]
        assert [got[q][k] for k in range(1, 7)] == [k for _, k in best]
    assert all(len(got[q]) == 6 for q in range(0, 900, 20)) and 2000 not in got


def test_recall_on_the_given_embeddings(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    frame = table.toPandas()
    m, ids = np.stack(frame.embedding).astype(np.float64), frame.vec_id.to_numpy()
    got = queries.op4_kmeans_tree(spark, "/root/testdata/sf0.01").toPandas()
    hits = 0
    for q in np.flatnonzero(ids % 20 == 0):
        scores = m @ m[q]
        scores[q] = -np.inf
        hits += len(set(got[got.query_id == ids[q]].vec_id) & set(ids[np.lexsort((ids, -scores))[:20]]))
    assert hits / len(got) >= 0.9


def test_visits_leave_out_leaves_that_are_not_able():
    x = clustered(500, 4).astype(np.float64)
    tree = kmeans_tree.Tree.fit(x, 20)
    able = np.arange(tree.leaves()) % 3 == 0
    rows = np.bincount(tree.file(x), minlength=tree.leaves())
    assert set(tree.visits(x[0], tree.leaves(), able)) == set(np.flatnonzero(able))
    few = tree.visits(x[0], 1, able, rows, 60)
    assert rows[few].sum() >= 60 and few == [k for k in tree.visits(x[0], tree.leaves()) if able[k]][: len(few)]


def test_visits_reach_every_leaf_once():
    x = np.random.default_rng(0).normal(size=(500, 4))
    tree = kmeans_tree.Tree.fit(x, 20)
    order = tree.visits(x[0], tree.leaves())
    assert sorted(order) == list(range(tree.leaves()))
    assert set(tree.file(x)) <= set(order)
