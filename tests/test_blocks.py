"""Chunks cut out of blocks of bars: nothing is grouped again for each size, nothing but the notes moves."""

import math

from notewright.operators import chunks
from notewright.plans import repeats
from notewright.schema import NOTES

DATA = "/root/testdata/sf0.001"


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_only_the_notes_are_exchanged(spark):
    for name in ("rhythm_fingerprint", "exact_clusters", "repeated_patterns", "repetition_ratio", "pattern_instances"):
        text = plan(repeats.QUERIES[name](spark, DATA))
        assert text.count("Exchange hashpartitioning") == 1 and "Join" not in text, name
        # notes are grouped in two steps, and no bar once more for each size
        assert text.count("collect_list(CASE") == 2, name


def test_json_needs_no_other_exchange(spark):
    from notewright.plans import nested

    text = plan(nested.QUERIES["pattern_json"](spark, DATA))
    assert text.count("Exchange hashpartitioning") == 1 and "Join" not in text


def test_chunks_are_cut_without_going_through_their_steps_again(spark):
    for name in ("pattern_instances", "pattern_stats", "pattern_page", "most_common_patterns", "pattern_counts", "exact_clusters"):
        text = plan(repeats.QUERIES[name](spark, DATA))
        assert "array_sort" not in text and text.count("Generate explode(flatten") == 1, name
        assert "lambda" not in text.split("Generate explode(flatten")[0], name


def test_json_rounds_only_steps_that_sound(spark):
    from pyspark.sql import functions as F

    from notewright.operators import nested

    grid = spark.createDataFrame([([0.0, 100 / 127.0, 1.0, None],)], "accent_grid array<double>")
    out = grid.select(*[F.lit(1).alias(c) for c in ("num_bars", "note_count", "rhythm_hash", "density")], F.array(F.lit(1)).alias("onset_grid"), "accent_grid").select(nested.rhythm_struct().alias("r"))
    assert out.first().r.accent_grid == [0.0, 0.787, 1.0, None]
    assert "CASE WHEN (lambda" in out._jdf.queryExecution().analyzed().toString()


def test_search_by_hash_works_patterns_out_once(spark):
    found = repeats.QUERIES["pattern_search_hash"](spark, DATA)
    assert "Generate" not in plan(found) and found.select("rhythm_hash").distinct().count() == 1


def test_sizes_that_share_no_block_and_notes_outside_the_song(spark):
    data = [(1, 0, k, k * 1.7, 0.5, 60 + k * 5 % 13, 1 + k * 7 % 120, 0) for k in range(60)] + [(1, 1, 0, 41.0, 0.25, 50, 99, 1), (1, 2, 0, -3.0, 0.5, 50, 99, 1), (2, 0, 0, 5.0, -4.5, 50, 99, 1), (3, 0, 0, 3.999, 0.001, 50, 99, 1)]
    got = {(r.song_id, r.track_id, r.chunk_size, r.start_bar): r for r in chunks.fingerprints(spark.createDataFrame(data, NOTES), (2, 3, 5, 6)).collect()}
    want = {}
    for song in (1, 2, 3):
        bars = math.floor(max(s + d for i, _, _, s, d, *_ in data if i == song) / 4) + 1
        for track in {n[1] for n in data if n[0] == song}:
            for size in (2, 3, 5, 6):
                for start in range(0, bars, size):
                    stop = min(start + size, bars)
                    want[song, track, size, start] = (stop, [n for n in data if n[:2] == (song, track) and start * 4 <= n[3] < stop * 4])
    assert set(got) == set(want)
    for k, (stop, own) in want.items():
        r, steps = got[k], [int((n[3] - k[3] * 4) / 0.25) for n in own]
        assert (r.end_bar, r.num_bars, r.note_count, r.start_beat, r.end_beat) == (stop, stop - k[3], len(own), k[3] * 4.0, stop * 4.0)
        assert r.onset_grid == [int(x in steps) for x in range(16 * (stop - k[3]))]
        assert r.accent_grid == [max([n[6] / 127.0 for n, s in zip(own, steps, strict=True) if s == x], default=0.0) for x in range(16 * (stop - k[3]))]
        assert r.pitch_classes == [sum(n[5] % 12 == c for n in own) for c in range(12)]


def test_metered_chunks_are_cut_out_of_blocks(spark):
    from notewright.plans import meters

    for name in ("chunks_with_meter", "fingerprints_with_meter"):
        text = plan(meters.QUERIES[name](spark, DATA))
        # spans are not sorted with signatures as a union, and meet blocks, not bars
        assert "Union" not in text and text.count("collect_list(CASE") % 2 == 0 and "collect_list(struct(bar" not in text, name
