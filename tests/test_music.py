"""Operators on small hand-made inputs."""

import random

import pytest
from pyspark.sql import functions as F

from notewright.operators import arpeggios, asof, chords, chunks, features, genres, keys, library, paths, patterns, roles, sections, targets, timing
from notewright.schema import NOTES


def notes(spark, rows, song=1, track=0, channel=0):
    """rows: (pitch, velocity, start, duration)."""
    return spark.createDataFrame([(song, track, k, float(s), float(d), p, v, channel) for k, (p, v, s, d) in enumerate(rows)], NOTES)


def test_features_of_four_notes(spark):
    n = notes(spark, [(60, 100, 0, 1), (64, 90, 1, 1), (67, 80, 2, 1), (72, 70, 3, 1)])
    f = features.track_features(n).first()
    assert (f.note_count, f.pitch_min, f.pitch_max, f.pitch_range, f.avg_velocity, f.avg_duration) == (4, 60, 72, 12, 85.0, 1.0)
    assert f.pitch_median == 65.5 and f.polyphony_ratio == 0.0 and not f.is_channel_10


def test_polyphony_is_all_or_nothing_unless_asked(spark):
    n = notes(spark, [(60, 90, 0, 2), (64, 90, 0, 2), (67, 90, 4, 1), (67, 90, 6, 1)])
    assert features.polyphony(n).first().polyphony_ratio == 1.0
    assert features.polyphony(n, compat=False).first().polyphony_ratio == 0.25


def test_roles_sum_to_one_and_drums_win_on_channel_nine(spark):
    n = notes(spark, [(36, 100, k * 0.25, 0.1) for k in range(64)], channel=9)
    r = roles.role_probabilities(features.track_features(n)).first()
    assert r.primary_role == "drums"
    assert sum(r[x] for x in ("drums", "bass", "chords", "pad", "lead", "arp", "other")) == pytest.approx(1)


def test_empty_tracks_have_defaults(spark):
    tracks = spark.createDataFrame([(1, 0)], "song_id long, track_id int")
    f = features.with_defaults(tracks, features.track_features(notes(spark, []))).first()
    assert (f.note_count, f.pitch_min, f.pitch_median, f.avg_velocity, f.avg_duration) == (0, 127, 64.0, 64.0, 1.0)


def test_swing(spark):
    straight = notes(spark, [(60, 90, k * 0.5, 0.4) for k in range(16)])
    swung = notes(spark, [(60, 90, k // 2 + (0.67 if k % 2 else 0), 0.3) for k in range(16)])
    assert timing.swing(straight, ["song_id"]).first().style == "straight"
    assert timing.swing(swung, ["song_id"]).first().style == "heavy"
    assert timing.swing(straight.limit(3), ["song_id"]).first().samples == 0


def test_quantize_rounds_half_to_even(spark):
    row = spark.range(1).select(timing.quantize_beat(F.lit(0.125)).alias("a"), timing.quantize_beat(F.lit(0.375)).alias("b"), timing.quantize_duration(F.lit(0.01)).alias("c")).first()
    assert (row.a, row.b, row.c) == (0.0, 0.5, 0.25)


def test_asof_takes_the_last_not_after(spark):
    a = spark.createDataFrame([(1, 0.5), (1, 2.0), (1, 9.0), (2, 1.0)], "song_id long, t double")
    b = spark.createDataFrame([(1, 1.0, "x"), (1, 2.0, "y")], "song_id long, t double, v string")
    got = {(r.song_id, r.t): r.v for r in asof.asof_backward(a, b, "t", ["song_id"], ["v"]).collect()}
    assert got == {(1, 0.5): None, (1, 2.0): "y", (1, 9.0): "y", (2, 1.0): None}


def test_histogram_weighs_by_duration(spark):
    n = notes(spark, [(60, 90, 0, 3), (64, 90, 0, 1)])
    h = keys.histogram(n, ["song_id"]).first().histogram
    assert (h[0], h[4], sum(h)) == (0.75, 0.25, 1.0)
    assert keys.histogram(n, ["song_id"], weighted=False).first().histogram[0] == 0.5


def test_key_names_rotate_unless_asked(spark):
    scale = [(60 + (7 + s) % 12, 90, k, d) for k, (s, d) in enumerate([(0, 4), (2, 1), (4, 2), (5, 1), (7, 3), (9, 1), (11, 1)])]
    n = notes(spark, scale)
    assert keys.detect_keys(n, ["song_id"]).first().root == 5
    assert keys.detect_keys(n, ["song_id"], compat=False).first().name == "G major"


def test_key_text(spark):
    root, mode = keys.parse_key(F.col("s"))
    got = spark.createDataFrame([("Bb minor",), ("C# major",), ("H dur",)], "s string").select(root.alias("r"), mode.alias("m")).collect()
    assert [(r.r, r.m) for r in got] == [(10, "minor"), (1, "major"), (None, None)]


@pytest.mark.parametrize(("pcs", "root", "quality"), [({0, 4, 7}, 0, "major"), ({9, 0, 4}, 9, "minor"), ({7, 11, 2, 5}, 7, "7"), (set(), 0, "?")])
def test_match_chord(spark, pcs, root, quality):
    c = chords.match_chord(spark.range(1).select(F.lit(sum(1 << p for p in pcs)).alias("bits"), F.array(*[F.lit(0.0)] * 12).alias("weights"))).first().c
    assert (c.root, c.quality) == (root, quality)


def test_smoothing_equals_a_plain_fold(spark):
    r = random.Random(3)
    songs = []
    for song in range(12):
        at, rows = 0.0, []
        for k in range(r.choice([1, 2, 5, 30])):
            end = at + r.choice([0.25, 0.5, 1.0, 1.5])
            rows.append((song, k, at, end, r.randrange(3), r.choice(["major", "minor"]), r.choice([None, 4]), 0.1 * k))
            at = end
        songs.append(rows)
    want = []
    for rows in songs:
        done = []
        for _, _, start, end, *rest in rows:
            if done and done[-1][2:4] == rest[:2]:
                done[-1][1] = end
                continue
            if len(done) > 1 and done[-1][1] - done[-1][0] < 1.0:
                last = done.pop()
                done[-1][1] = last[1]
            done.append([start, end, *rest])
        want += [(rows[0][0], k, *x) for k, x in enumerate(done)]
    frame = spark.createDataFrame([x for rows in songs for x in rows], "song_id long, window long, start_beat double, end_beat double, root int, quality string, bass int, confidence double")
    got = chords.smooth(frame, ["song_id"]).orderBy("song_id", "position").collect()
    assert [tuple(x) for x in got] == want


def test_window_weight_is_the_overlap(spark):
    got = chords.windows(notes(spark, [(60, 90, 0, 4)]), ["song_id"], width=1.0).where("window = 1").first()
    assert (got.weight, got.pc) == (1.0, 0)


def test_progression(spark):
    rows = [(1, k, float(2 * k), 2.0 * k + 2, r, q, None, 1.0) for k, (r, q) in enumerate([(0, "major"), (7, "major"), (9, "minor"), (5, "major")])]
    c = spark.createDataFrame(rows, "song_id long, position int, start_beat double, end_beat double, root int, quality string, bass int, confidence double")
    n = c.select("song_id", chords.roman_numeral(F.col("root"), F.col("quality"), F.lit(0), F.lit("major")).alias("n"), "position")
    listed = n.groupBy("song_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "n"))), lambda x: x["n"]).alias("numerals"))
    got = chords.match_progression(listed, ["song_id"]).first()
    assert (got.numerals, got.progression) == (["I", "V", "vi", "IV"], "I-V-vi-IV")
    assert chords.simplified(c, ["song_id"]).first().names == ["C", "G", "Am", "F"]


def test_smoothing_drops_short_chords(spark):
    rows = [(1, 0, 0.0, 2.0, 0, "major", None, 1.0), (1, 1, 2.0, 2.5, 7, "major", None, 1.0), (1, 2, 2.5, 4.5, 9, "minor", None, 1.0), (1, 3, 3.5, 5.5, 9, "minor", None, 1.0)]
    c = spark.createDataFrame(rows, "song_id long, window long, start_beat double, end_beat double, root int, quality string, bass int, confidence double")
    got = [(r.root, r.start_beat, r.end_beat) for r in chords.smooth(c, ["song_id"]).orderBy("position").collect()]
    assert got == [(0, 0.0, 2.5), (9, 2.5, 5.5)]


def test_chunks_and_fingerprints(spark):
    n = notes(spark, [(60, 100, 0, 0.5), (62, 90, 1, 0.5), (64, 80, 2, 0.5), (66, 70, 3, 0.5), (60, 90, 8, 0.5)])
    assert [(r.start_bar, r.num_bars, r.note_count) for r in chunks.chunks(n, (2,)).orderBy("start_bar").collect()] == [(0, 2, 4), (2, 1, 1)]
    p = chunks.fingerprints(n, (1,)).where("start_bar = 0").first()
    assert [k for k, x in enumerate(p.onset_grid) if x] == [0, 4, 8, 12]
    assert (list(p.intervals), list(p.contour), p.range_semitones, p.mean_pitch) == ([2, 2, 2], [1, 1, 1], 6, 63.0)
    empty = chunks.fingerprints(n, (1,)).where("start_bar = 1").first()
    assert (sum(empty.onset_grid), empty.note_count, empty.mean_pitch) == (0, 0, 0.0)


def test_transposed_bars_share_a_pattern(spark):
    n = notes(spark, [(60 + 5 * b + i, 90, 4 * b + i, 0.5) for b in range(3) for i in range(4)])
    found = patterns.exact_clusters(chunks.fingerprints(n, (1,)))
    assert [(r.occurrences, list(r.bar_positions)) for r in found.collect()] == [(3, [0, 1, 2])]
    assert patterns.repetition_ratio(found).first().repetition_ratio == pytest.approx(2 / 3)


def test_similarity(spark):
    a = F.array(*[F.lit(x) for x in [1] * 8])
    b = F.array(*[F.lit(x) for x in [1] * 7 + [0]])
    row = spark.range(1).select(patterns.rhythm_similarity(a, b).alias("r"), patterns.transposition(F.lit(64.0), F.lit(67.0), F.lit(0.95)).alias("t")).first()
    assert (row.r, row.t) == (0.875, -3)


def test_arpeggio(spark):
    n = notes(spark, [(p, 90, k * 0.25, 0.125) for k, p in enumerate([60, 64, 67, 72] * 2)])
    w = arpeggios.windows(n).first()
    assert (w.root, list(w.intervals)[:4], list(w.octaves)[:4], w.rate, w.gate) == (0, [0, 4, 7, 0], [0, 0, 0, 1], "1/16", 0.5)
    assert list(arpeggios.analysis(arpeggios.windows(n)).first().dominant_pattern)[:4] == [0, 4, 7, 0]


def test_sections_find_a_change(spark):
    quiet = [(48, 30, b * 4, 1) for b in range(8)]
    loud = [(60 + k % 24, 120, (8 + b) * 4 + k * 0.25, 0.25) for b in range(8) for k in range(16)]
    n = notes(spark, quiet + loud)
    r = roles.role_probabilities(features.track_features(n))
    bars = sections.bar_features(n, r)
    assert bars.count() == 16
    found = sections.boundaries(sections.novelty(bars)).first().boundaries
    assert list(found) == [0, 8]
    named = sections.forms(sections.sections(bars, sections.boundaries(sections.novelty(bars)))).orderBy("section").collect()
    assert [x.form for x in named] == ["A", "B"] and named[0].hint == "intro"


def test_hints_follow_from_neighbours(spark):
    cases = [
        # notes, tracks, drums and form of each section in order, and what each is for
        ([(10, 4, 1, "A"), (30, 5, 1, "A"), (50, 6, 1, "B"), (80, 7, 1, "B"), (120, 8, 1, "C"), (130, 8, 1, "C")], ["intro", "build", "drop", "build", "drop", "bridge"]),
        ([(50, 4, 1, "A"), (90, 5, 1, "B"), (91, 5, 1, "A"), (30, 5, 0, "A"), (30, 5, 0, "C"), (20, 5, 0, "D")], ["verse", "build", "drop", "breakdown", "bridge", "outro"]),
        ([(50, 2, 1, "A")], ["intro"]),
        ([(50, 4, 1, "A"), (10, 4, 1, "B")], ["verse", "outro"]),
    ]
    rows = [(song, k, n, t, float(d), f) for song, (given, _) in enumerate(cases) for k, (n, t, d, f) in enumerate(given)]
    got = sections.hints(spark.createDataFrame(rows, "song_id long, section int, note_count int, active_tracks int, density_drums double, form string")).orderBy("song_id", "section").collect()
    assert [r.hint for r in got] == [h for _, wanted in cases for h in wanted]


def test_genres(spark):
    names = genres.taxonomy(spark)
    tags = spark.createDataFrame([(1, "musicbrainz", 0, " Rock "), (1, "discogs", 1, "rock music"), (1, "lastfm", 2, "ROCK"), (2, "discogs", 0, "hip hop"), (2, "discogs", 1, "rap"), (2, "lastfm", 2, "nothing")], "song_id long, source string, place int, tag string")
    clean = genres.normalize(tags, names)
    merged = genres.merge(clean, ["song_id"])
    got = {r.song_id: r for r in genres.result(merged, clean, ["song_id"]).collect()}
    assert (got[1].primary, got[1].overall, got[2].primary, got[2].overall) == ("rock", 1.0, "hip-hop", 0.5)
    assert names.count() == 227 and names.select("canonical").distinct().count() == 162
    words = spark.createDataFrame([("HOUSE",), ("film",), ("none such",)], "word string")
    got = sorted(map(tuple, genres.suggest(names, words).collect()))
    assert got == [("HOUSE", "deep house"), ("HOUSE", "house"), ("HOUSE", "progressive house"), ("HOUSE", "tech house"), ("film", "film score"), ("film", "soundtrack")]
    assert genres.suggest(names, words.where("word = 'HOUSE'"), limit=1).first().canonical == "house"
    assert sorted(r[0] for r in genres.in_category(names, "soul").collect()) == ["motown", "northern soul", "soul"]


def test_tags_by_count(spark):
    given = [("rock", 3), ("a very long descriptive tag", 9), ("short", 3), ("rock", 5), ("progressive rock of the seventies", 1)] + [(f"tag number {k:02d} of very many", 0) for k in range(30)]
    rows = spark.createDataFrame([(1, t, c, k) for k, (t, c) in enumerate(given)], "song_id long, tag string, count int, place int")
    got = genres.ranked_tags(rows, ["song_id"]).first()
    assert got.genres == ["rock", "short", "progressive rock of the seventies"]
    assert got.tags[:4] == ["a very long descriptive tag", "rock", "short", "progressive rock of the seventies"] and len(got.tags) == 20


def test_genre_spellings(spark):
    known = {
        "\tjazz\n": "jazz", "hiphop": "hip-hop", "Hip Hop": "hip-hop", "rock music": "rock", "jazz genre": "jazz", "electronica": "electronic", "edm": "edm", "electropop": "electro-pop",
        "fusion": "jazz fusion", "nu metal": "nu-metal", "drum & bass": "drum and bass", "prog": "progressive rock", "post punk": "post-punk", "conscious hip hop": "conscious hip-hop",
        "conscious hip-hop": None, "rock  music": None, "not a real genre": None, "": None,
    }
    got = genres.normalize(spark.createDataFrame(list(known.items()), "tag string, wanted string"), genres.taxonomy(spark)).collect()
    assert {r.tag: r.canonical for r in got} == known


def test_paths(spark):
    cases = {
        "/music/R/Ramones/I Wanna Be Sedated.mid": ("Ramones", "I Wanna Be Sedated", "folder_structure", 0.8),
        "/music/Queen - Bohemian Rhapsody.mid": ("Queen", "Bohemian Rhapsody", "filename_separator", 0.6),
        "AC_DC__back-in black.mid": ("Ac Dc", "Back In Black", "filename_separator", 0.6),
        "Artist_Name_-_Song.mid": ("Artist Name", "Song", "filename_separator", 0.6),
        "/music/le-youth-jerro-lizzy-land-lost-20230130024203-nonstop2k.com.mid": ("Le Youth, Jerro, Lizzy Land", "Lost", "filename_nonstop2k", 0.8),
        "a-b-c-d-e-f-jerro-le-youth-jerro-jerro-song.mid": ("A B C D E F, Jerro, Le Youth, Jerro, Jerro", "Song", "filename_nonstop2k", 0.8),
        "le-youth-jerro.mid": ("Le Youth, Jerro", "", "filename_nonstop2k", 0.3),
        "one-two-three.mid": ("One Two", "Three", "filename_nonstop2k_heuristic", 0.4),
        "one-two-3-four-five-six.mid": ("One Two", "Four Five Six", "filename_nonstop2k_heuristic", 0.4),
        "word-song-123.mid": ("Word", "Song", "filename_hyphenated", 0.5),
        "word-123.mid": ("", "Word", "filename_hyphenated", 0.3),
        "some_song.mid": ("", "Some Song", "filename_fallback", 0.3),
        "tune-20230130024203-midi-karaoke.info.mid": ("", "Tune", "filename_fallback", 0.3),
    }
    slugs = spark.createDataFrame([("le-youth", "Le Youth"), ("jerro", "Jerro"), ("lizzy-land", "Lizzy Land"), ("a-b-c-d-e-f", "A B C D E F"), ("a", "A")], "slug string, name string")
    got = paths.metadata(spark.createDataFrame([(f,) for f in cases], "path string"), slugs=slugs).collect()
    assert {r.path: (r.artist, r.title, r.source, r.confidence) for r in got} == cases


def test_what_a_file_says_is_merged_by_confidence(spark):
    rows = [(1, "word.mid", "Real Title", "\u00a9 1999 The Band"), (2, "/x/R/Ramones/song.mid", "Real Title", None), (3, "word.mid", None, "Copyright 2001 Some One"), (4, "word.mid", None, None)]
    titles = spark.createDataFrame([(k, t, c) for k, _, t, c in rows], "song_id long, title string, copyright string")
    files = spark.createDataFrame([(k, p) for k, p, _, _ in rows], "song_id long, path string")
    got = {r.song_id: (r.artist, r.title, r.source, r.confidence) for r in paths.songs(files, titles).collect()}
    assert got == {
        1: ("The Band", "Real Title", "midi_metadata", 0.7),
        2: ("Ramones", "Song", "folder_structure", 0.8),
        3: ("Some One", "Word", "filename_fallback", 0.3),
        4: ("", "Word", "filename_fallback", 0.3),
    }


def test_targets_in_blocks_and_broadcast_agree(spark, monkeypatch):
    rows = [(f"{s}_{t}", s, "bass" if t else "lead", float(s % 3), s % 5, 1.0 + s, 0.5 * t) for s in range(12) for t in range(3)]
    table = spark.createDataFrame(rows, "clip_id string, song_id long, role string, density double, pitch_range int, avg_velocity double, avg_duration double")
    wanted = table.where("song_id % 3 = 0")
    plain = sorted(map(tuple, library.similar_tracks(table, wanted).collect()))
    monkeypatch.setattr(targets, "MOST", 4)
    assert plain and plain == sorted(map(tuple, library.similar_tracks(table, wanted).collect()))
    one = {r.clip_id: r.similarity for r in library.similar_tracks(table, table.where("clip_id = '0_0'")).collect()}
    # the target has no density and no duration: range (zero counts as one) and velocity share the weight
    assert one["1_0"] == pytest.approx((0.2 * 1.0 + 0.2 * 0.5) / 0.4) and "0_1" not in one


def test_greedy_merging_takes_what_is_near_and_free(spark):
    c = spark.createDataFrame([(1, 0, 1, p, n, f) for p, n, f in (("a", 2, 0), ("b", 5, 1), ("c", 1, 2), ("d", 1, 3))], "song_id long, track_id int, chunk_size int, pattern_id string, occurrences long, first_bar int")
    pairs = spark.createDataFrame([(1, 0, 1, a, b, s) for a, b, s in (("a", "b", 0.9), ("b", "c", 0.95), ("c", "d", 0.86), ("a", "d", 0.2))], "song_id long, track_id int, chunk_size int, pattern_a string, pattern_b string, similarity double")
    got = sorted((r.leader, r.canonical, r.merged, r.occurrences) for r in patterns.merge_similar(c, pairs).collect())
    assert got == [("a", "b", 2, 7), ("c", "c", 2, 2)]


def test_library_changes(spark):
    rows = spark.createDataFrame([("1_0", 1, "bass", 5, ["rock"]), ("1_1", 1, "lead", 7, None), ("2_0", 2, "pad", 9, ["jazz"])], "clip_id string, song_id long, role string, note_count long, genres array<string>")
    new = rows.where("clip_id = '1_0'").withColumn("note_count", F.lit(50).cast("long"))
    assert library.upsert(rows, new).where("clip_id = '1_0'").first().note_count == 50
    assert library.delete(rows, F.col("song_id") == 1).count() == 1
    assert library.update(rows, F.col("song_id") == 1, role=F.lit("arp")).where("role = 'arp'").count() == 2
    assert [r.clip_id for r in library.find(rows, library.ClipQuery(limit=1, offset=1)).collect()] == ["1_1"]
