"""Patterns like a target, scored in tiles."""

import random

import pyarrow as pa
import pytest

from notewright.operators import patterns


def rows(n=300):
    r = random.Random(3)
    grids = [[int(r.random() < share) for _ in range(16)] for share in (0.2, 0.5, 0.9) for _ in range(4)]
    out = [(f"{k:04}", 1 + k % 2, [x ^ (r.random() < 0.05) for x in r.choice(grids)] + [0] * (16 * (k % 2)), [r.choice([0, 0, 1, 3]) for _ in range(12)]) for k in range(n)]
    return [*out, ("none", 1, [0] * 16, [0] * 12), ("void", 2, [0] * 32, [0] * 12), ("void 1", 2, [0] * 32, [1] * 12)]


@pytest.mark.parametrize("least,same", [(0.8, False), (0.8, True), (0.55, False), (0.98, False), (1.0, False)])
def test_tiles_equal_every_pair(spark, monkeypatch, least, same):
    monkeypatch.setattr(patterns, "TILE", (50, 8))
    monkeypatch.setattr(patterns, "STRIPE", 7)
    given = rows()
    table = spark.createDataFrame(given, "pattern_id string, num_bars int, onset_grid array<int>, pitch_classes array<int>")
    chosen = [x for x in given if x[0][-1] in "05ed"]
    found = patterns.find_similar(table, table.where("right(pattern_id, 1) in ('0', '5', 'e', 'd')"), least, same_length=same)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan, "pairs are scored in tiles, not met one by one"
    got = {(r.target, r.pattern_id): r.similarity for r in found.collect()}
    want = {}
    for t in chosen:
        for p in given:
            a, b = ({k for k, v in enumerate(x[2]) if v} for x in (t, p))
            size = [sum(q * q for q in x[3]) ** 0.5 for x in (t, p)]
            cosine = 1.0 if not any(size) else 0.0 if not all(size) else sum(x * y for x, y in zip(t[3], p[3], strict=True)) / (size[1] * size[0])
            score = ((len(a & b) / len(a | b) if a | b else 1.0) + cosine) / 2
            if t[0] != p[0] and (t[1] == p[1] or not same) and score >= least:
                want[t[0], p[0]] = score
    assert got == want and want


def exchanged(df):
    """Rows that went through exchanges once df has been collected."""

    def walk(node):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if "QueryStage" in name:
            return walk(node.plan())
        own = node.metrics().apply("shuffleRecordsWritten").value() if name == "Exchange" else 0
        return own + sum(walk(node.children().apply(k)) for k in range(node.children().size()))

    df.collect()
    return walk(df._jdf.queryExecution().executedPlan())


def test_what_is_exchanged_grows_with_rows_not_with_pairs(spark, monkeypatch):
    monkeypatch.setattr(patterns, "TILE", (16, 8))
    monkeypatch.setattr(patterns, "MOST_DEALT", (4, 2), raising=False)
    moved = []
    for n in (250, 1000):
        table = spark.createDataFrame(rows(n), "pattern_id string, num_bars int, onset_grid array<int>, pitch_classes array<int>")
        moved.append(exchanged(patterns.find_similar(table, table.where("right(pattern_id, 1) in ('0', '5')"), 0.9)))
    assert 0 < moved[1] < 4.5 * moved[0], moved


def test_a_tile_gives_its_pairs_a_few_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(patterns, "STRIPE", 16)
    monkeypatch.setattr(patterns, "BATCH", 100)
    p = pa.table({"pattern_id": [f"p{k}" for k in range(64)], "num_bars": [1] * 64, "_on": [[0, 4, 8]] * 64, "pitch_classes": [[1, 2]] * 64})
    q = pa.table({"target": [f"t{k}" for k in range(64)], "_bars": [1] * 64, "_g": [[0, 4, 8]] * 64, "_p": [[1, 2]] * 64})
    (row,) = patterns.together(p, q).to_batches()
    assert row["weights"].to_pylist() == [[3]], "steps that sound together are one column"
    sizes = [b.num_rows for b in patterns.scored([row], 0.8, False)]
    assert sum(sizes) == 64 * 64 and max(sizes) < 100 + 16 * 16


def test_odd_patterns(spark):
    given = [("a", 1, [1, 0, 1], [0.1, 0.7, 1e-3]), ("a", 2, [1, 0, 1, 1], [0.1, 0.7, 1e-3]), ("b", None, [1, 0, 1], [0.2, 1.4, 2e-3]), ("c", 1, [1, 0, 1], [1e9, 7e9, 1e7]), ("d", 1, [1, 0, 1], [1e-200, 0.0, 0.0]), ("e", 2, [1, 0, 1], [0.0, 0.0, 0.0]), (None, 1, [1, 0, 1], [0.1, 0.7, 1e-3]), ("f", 1, None, [0.1, 0.7, 1e-3]), ("g", 1, [1, 0, 1], None), ("h", 1, [0, 1, 0], [0.1, 0.7, 1e-3])]
    table = spark.createDataFrame(given, "pattern_id string, num_bars int, onset_grid array<int>, pitch_classes array<double>")
    for least in (0.8, 0.99):
        got = sorted((r.target, r.pattern_id, r.num_bars or 0, round(r.similarity, 9)) for r in patterns.find_similar(table, table, least).collect())
        # what single pairs give, by the way for a least that says nothing of steps
        pairs = patterns.find_similar(table, table, 0.5).where(f"similarity >= {least}")
        assert got and got == sorted((r.target, r.pattern_id, r.num_bars or 0, round(r.similarity, 9)) for r in pairs.collect())
