"""Hard negatives against all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from notewright.llm import hard_negatives

SCHEMA = "vec_id long, label int, embedding array<double>"


def table(n=300, dim=8, seed=0):
    draw = np.random.default_rng(seed)
    centre = draw.normal(size=(4, dim)) + 0.5
    rows = [(k, int(k % 4), (centre[(k + k // 7) % 4] + 0.4 * draw.normal(size=dim)).round(2).tolist()) for k in range(n)]
    rows += [(n + k, rows[k][1], rows[k][2]) for k in range(0, 60, 5)]  # ties
    rows += [rows[10], rows[10], rows[20], (20, 3, rows[21][2]), (20, 0, rows[20][2])]  # repeated rows and ids
    rows += [(2000, None, [0.1] * dim), (2010, 1, None), (2020, 1, [math.nan] * dim), (2030, 1, [None] * dim), (2040, 1, [math.inf] * dim), (None, 1, [0.3] * dim)]
    rows += [(2050, 2, [0.5, 0.5]), (2051, 1, [0.5, 0.4]), (2052, 2, [0.25, 0.25]), (2060, 1, [0.0] * dim), (2070, 1, []), (2080, 1, [1e300] * dim), (2090, 1, [1e308] * dim)]
    return rows


def model(rows, is_anchor, positives=5, negatives=10, low=30, high=90):
    good = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows if i is not None and label is not None and v and all(x is not None and math.isfinite(256 * x) for x in v)]
    cut = lambda s: max(-(2**63), min(2**63 - 1, s))
    out = []
    for a, (i, label, v) in enumerate(good):
        if not is_anchor(i):
            continue
        scored = [(-sum(x * y for x, y in zip(v, w, strict=True)), j, other) for b, (j, other, w) in enumerate(good) if b != a and len(w) == len(v)]
        own = sorted((s, j) for s, j, other in scored if other == label)[:positives]
        for p, j in own:
            p = cut(-p)
            fits = sorted((s, k) for s, k, other in scored if other != label and 30 * p <= 100 * -s <= 90 * p)[:negatives]
            out += [(i, j, rank, k, p, cut(-s)) for rank, (s, k) in enumerate(fits, 1)]
    return sorted(out)


def mined(spark, rows, **options):
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("row", "dim", "v", "anchor", "block", "positives")})
    found = hard_negatives.mine(frame, "embedding", F.col("vec_id") % 10 == 0, **options)
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in found.collect())


def test_equals_all_pairs(spark, monkeypatch):
    for name, value in (("CANDIDATES", 90), ("ANCHORS", 12), ("BATCH", 16), ("TILE", 5)):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = table()
    got = mined(spark, rows)
    assert got == model(rows, lambda i: i % 10 == 0) and len({r[0] for r in got}) > 20


def test_large_numbers_are_exact(spark):
    draw = np.random.default_rng(3)
    rows = [(k, k % 2, [float(int(x) * 2**20) for x in draw.integers(1, 2**21, 3)]) for k in range(60)]
    rows += [(100 + k, k % 2, v) for k, (_, _, v) in enumerate(rows[:10])]
    assert mined(spark, rows) == model(rows, lambda i: i % 10 == 0)


def test_no_rows(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(10, 1, [1.0])]) == []


def test_bounds_hold_at_every_level():
    draw = np.random.default_rng(1)
    for dim in (1, 2, 7, 64, 100):
        a, b = draw.integers(-300, 300, (20, dim)).astype(float), draw.integers(-300, 300, (30, dim)).astype(float)
        x, y, scores, last = hard_negatives.Summaries(a), hard_negatives.Summaries(b), a @ b.T, None
        for level in range(len(x.mean)):
            middle, reach = x.mean[level] @ y.mean[level].T, x.deviation[level] @ y.deviation[level].T + 1e-6
            assert (scores <= middle + reach).all() and (scores >= middle - reach).all()
            assert last is None or (middle + reach <= last + 1e-3).all(), "finer segments bound no worse"
            last = middle + reach
        edges = hard_negatives.levels(dim)
        assert all(set(e) <= set(f) for e, f in zip(edges, edges[1:], strict=False)) and edges[0].tolist() == [0, dim]


def test_summaries_leave_most_pairs_of_stepwise_vectors_out(spark):
    draw = np.random.default_rng(2)
    steps = draw.normal(size=(3000, 16))
    steps = steps * np.exp(draw.normal(size=(3000, 1)))
    x = np.repeat(steps, 4, axis=1) + 0.02 * draw.normal(size=(3000, 64))
    rows = [(k, k % 5, v.tolist()) for k, v in enumerate(x)]
    frame = spark.createDataFrame(rows, SCHEMA)
    first, second = hard_negatives.pairs_scored(frame, "embedding", F.col("vec_id") % 100 == 0)
    assert first < 0.75 * 30 * 600 and second < 0.1 * 30 * 2400, (first, second)
    got = sorted(map(tuple, hard_negatives.mine(frame, "embedding", F.col("vec_id") % 500 == 0).collect()))
    assert got == model(rows, lambda i: i % 500 == 0)


@pytest.mark.parametrize("k", [1, 3])
def test_other_numbers_of_positives(spark, k):
    rows = table(120, 4, 5)
    assert mined(spark, rows, positives=k, negatives=k) == model(rows, lambda i: i % 10 == 0, k, k)
