"""Similar pairs within a track, in stripes."""

from notewright.operators import patterns
from notewright.plans import repeats

DATA = "/root/testdata/sf0.001"


def test_pairs_need_no_exchange_but_the_notes_and_stripes_change_nothing(spark, monkeypatch):
    found = repeats.QUERIES["pair_similarity"](spark, DATA)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    whole = sorted(map(tuple, found.collect()))
    monkeypatch.setattr(patterns, "STRIPE", 3)
    assert whole and whole == sorted(map(tuple, repeats.QUERIES["pair_similarity"](spark, DATA).collect()))


def test_pairs_of_odd_patterns(spark):
    rows = [("a", 0, [0] * 16, [0] * 12, [], 0.0), ("b", 1, [0] * 16, [0] * 12, [], 0.0), ("c", 2, [1] + [0] * 15, [1] + [0] * 11, [], 60.0), ("d", 3, [1] + [0] * 15, [0, 1] + [0] * 10, [], 61.0), ("d", 4, [1] * 16, [9] * 12, [1], 9.0), ("e", 5, [1] + [0] * 15, [2] + [0] * 11, [0], 90.0)]
    prints = spark.createDataFrame([(1, 0, 1, p, bar, g, pc, c, m) for p, bar, g, pc, c, m in rows], "song_id long, track_id int, chunk_size int, pattern_id string, start_bar int, onset_grid array<int>, pitch_classes array<int>, contour array<int>, mean_pitch double")
    got = {(r.pattern_a, r.pattern_b): (r.rhythm, r.pitch, r.transposition, r.bar_a, r.bar_b) for r in patterns.similar_pairs(prints).collect()}
    # two without notes: no classes, but one contour
    assert got == {("a", "b"): (1.0, 0.5, 0, 0, 1), ("c", "d"): (1.0, 0.5, -1, 2, 3), ("c", "e"): (1.0, 0.5, None, 2, 5), ("d", "e"): (1.0, 0.0, None, 3, 5)}
