"""Indexes, rounds, nested rows, the data source and the clip index, against plain models."""

import random

import pytest
from pyspark.sql import functions as F

from notewright.operators import changes, grams, library, nested, paths, patterns
from notewright.schema import NOTES
from notewright.sources import cache, scores, smf
from notewright.streaming import index


# merging and similar patterns


def greedy(order, near):
    taken, out = set(), []
    for n, a in enumerate(order):
        if a in taken:
            continue
        own = [a] + [b for b in order[n + 1 :] if b not in taken and frozenset((a, b)) in near]
        taken.update(own)
        out.append(own)
    return out


def test_merging_in_rounds_equals_the_sequential_fold(spark):
    r = random.Random(5)
    clusters, pairs, want = [], [], set()
    for track, n, chance in ((0, 40, 0.1), (1, 60, 0.03), (2, 30, 0.5), (3, 12, 0.0), (4, 25, None)):
        order = [f"p{track}_{k:02}" for k in r.sample(range(99), n)]
        bars = sorted(r.sample(range(500), n))
        counts = {p: r.randint(1, 4) for p in order}
        clusters += [(1, track, 1, p, counts[p], b) for p, b in zip(order, bars, strict=True)]
        near = {frozenset((a, b)) for k, a in enumerate(order) for b in order[k + 1 :] if (r.random() < chance if chance is not None else order.index(b) == k + 1)}
        pairs += [(1, track, 1, *sorted(x), 0.9) for x in near] + [(1, track, 1, order[0], order[-1], 0.2)]
        for own in greedy(order, near):
            want.add((track, own[0], max(own, key=lambda p: counts[p]), len(own), sum(counts[p] for p in own)))
    c = spark.createDataFrame(clusters, "song_id long, track_id int, chunk_size int, pattern_id string, occurrences long, first_bar int")
    p = spark.createDataFrame(pairs, "song_id long, track_id int, chunk_size int, pattern_a string, pattern_b string, similarity double")
    got = patterns.merge_similar(c, p).collect()
    assert {(x.track_id, x.leader, x.canonical, x.merged, x.occurrences) for x in got} == want and len(got) == len(want)


def pattern_table(spark, n=600):
    r = random.Random(8)
    shapes = [sorted(r.sample(range(32), r.choice([3, 6, 10]))) for _ in range(12)]
    rows = []
    for k in range(n):
        bars = r.choice([1, 2])
        steps = {x for x in r.choice(shapes) if r.random() < 0.9 and x < 16 * bars} | ({r.randrange(16 * bars)} if r.random() < 0.5 else set()) | ({0} if r.random() < 0.7 else set())
        rows.append((f"{k:04}", bars, [int(x in steps) for x in range(16 * bars)], [r.choice([0, 0, 1, 3]) for _ in range(12)]))
    rows.append(("empty", 1, [0] * 16, [0] * 12))
    return spark.createDataFrame(rows, "pattern_id string, num_bars int, onset_grid array<int>, pitch_classes array<int>"), rows


def likeness(a, b):
    x, y = ({k for k, v in enumerate(g) if v} for g in (a[2], b[2]))
    jaccard = len(x & y) / len(x | y) if x | y else 1.0
    size = lambda v: sum(q * q for q in v) ** 0.5
    u, v = size(a[3]), size(b[3])
    cosine = 1.0 if not u and not v else 0.0 if not u or not v else sum(p * q for p, q in zip(a[3], b[3], strict=True)) / (u * v)
    return (jaccard + cosine) / 2


@pytest.mark.parametrize("least", [0.8, 0.65, 0.4])
def test_similar_patterns_equal_brute_force(spark, least, monkeypatch):
    monkeypatch.setattr(patterns, "DEAL", 250)
    table, rows = pattern_table(spark)
    targets = table.where("pattern_id like '%00' or pattern_id = 'empty'")
    got = {(r.target, r.pattern_id) for r in patterns.find_similar(table, targets, least).collect()}
    sure = lambda low: {(t[0], p[0]) for t in rows if t[0].endswith("00") or t[0] == "empty" for p in rows if p[0] != t[0] and likeness(t, p) >= low}
    assert sure(least + 1e-9) <= got <= sure(least - 1e-9) and got
    if least == 0.8:
        met = patterns.candidates(table, targets, 2 * least - 1)
        assert met.count() == met.distinct().count() < 0.25 * 7 * len(rows), "the index meets few pairs, each once"


# trigrams and dictionaries


def test_trigrams_find_what_a_scan_finds(spark, tmp_path):
    names = ["Customer#0001", "CUSTOMER 12", "Ünïcode ΑΣ", "ab", "", None, "a%b_c", "The Beatles", "beat", "BEATSTEAKS", "Kelvin"]
    clips = spark.createDataFrame([(f"c{k}", n, [], 1) for k, n in enumerate(names * 2)], "clip_id string, artist string, tags array<string>, note_count int")
    made = grams.postings(clips, "clip_id", F.col("artist"))
    grams.save(made, str(tmp_path / "grams"))
    for held in (made, grams.load(spark, str(tmp_path / "grams"))):
        for needle in ("beat", "EAT", "omer#0", "cust%1", "a%b", "ΑΣ", "ünï", "zzz", "at", "", "b_a", "kelvin"):
            q = library.ClipQuery(artist=needle)
            want = sorted(r.clip_id for r in library.find(clips, q).collect())
            assert sorted(r.clip_id for r in library.find_indexed(clips, q, held).collect()) == want, needle
    plan = grams.candidates(grams.load(spark, str(tmp_path / "grams")), "clip_id", "beat")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket", "bucket") or "bucket" in plan.split("PartitionFilters")[1]


def test_longest_slugs_win_again_and_again(spark):
    slugs = {"le-youth": "Le Youth", "jerro": "Jerro", "a": "A", "a-b": "A B", "a-b-c-d": "A B C D", "z": "Z"}
    stems = ["le-youth-jerro-lost", "jerro", "a-b-c-x", "a-b-c-d", "a-a-a-b-q", "x-a-b", "LE-YOUTH-song", "", "z-z-z", "a-12"]

    def walk(stem):
        words, names, at = stem.lower().split("-"), [], 0
        while len(words) > 1 and (n := next((n for n in range(len(words) - at, 0, -1) if "-".join(words[at : at + n]) in slugs), 0)):
            names, at = [*names, slugs["-".join(words[at : at + n])]], at + n
        return (names, at) if names else None

    table = spark.createDataFrame([*slugs.items(), ("a", "Other"), (None, "N")], "slug string, name string")
    got = {r.stem: (r.known.names, r.known.words) for r in paths.known_artists(spark.createDataFrame([(s,) for s in stems], "stem string"), table).collect()}
    assert got == {s: walk(s) for s in stems if walk(s)}
    assert paths.known_artists(spark.createDataFrame([("a-b",)], "stem string"), table.limit(0)).collect() == []


# nested rows


def test_songs_nest_and_come_back(spark):
    r = random.Random(1)
    rows = [(s, t, k, k / 2, 0.25, r.randrange(128), r.randrange(128), t) for s in (1, 2) for t in (0, 3) for k in range(6)] + [(1, 0, 2, 1.0, 0.25, 60, 60, 0)] * 2
    notes = spark.createDataFrame(rows, NOTES)
    tracks = spark.createDataFrame([(1, 0, "Bass", 0), (1, 3, None, 9), (1, 7, "silent", 1), (2, 0, "x", 0), (2, 3, "y\"ü", 0)], "song_id long, track_id int, name string, primary_channel int")
    tempos = spark.createDataFrame([(1, 0.0, 120.0), (1, 4.0, 90.5)], "song_id long, beat double, bpm double")
    meters = spark.createDataFrame([(2, 0.0, 0, 3, 4)], "song_id long, beat double, bar int, numerator int, denominator int")
    info = spark.createDataFrame([(1, "/a.mid"), (2, "/b.mid"), (3, "/none.mid")], "song_id long, path string")
    whole = nested.songs(notes, tracks, tempos, meters, info)
    assert {(s.song_id, s.path, len(s.tracks), len(s.tempo_map), len(s.time_sig_map)) for s in whole.collect()} == {(1, "/a.mid", 3, 2, 0), (2, "/b.mid", 2, 0, 1), (3, "/none.mid", 0, 0, 0)}
    back = nested.from_json(nested.to_json(whole))
    assert sorted(map(tuple, nested.notes_of(back).collect())) == sorted(rows)
    assert sorted(map(str, nested.tracks_of(back).collect())) == sorted(map(str, tracks.collect()))
    assert sorted(map(tuple, nested.map_of(back, "tempo_map").collect())) == sorted(map(tuple, tempos.collect()))
    assert sorted(map(tuple, nested.map_of(back, "time_sig_map").collect())) == sorted(map(tuple, meters.collect()))
    clips = spark.createDataFrame([("1_0", 1, 0), ("9_0", 9, 0)], "clip_id string, song_id long, track_id int")
    assert {(c.clip_id, c.notes and len(c.notes)) for c in nested.load_tracks(clips, notes).collect()} == {("1_0", 8), ("9_0", None)}
    assert {(c.clip_id, c.song and c.song.path) for c in nested.load_songs(clips, whole).collect()} == {("1_0", "/a.mid"), ("9_0", None)}
    assert nested.from_json(spark.createDataFrame([("not json",)], "json string")).first().tracks is None


# the data source


def a_file(pitches=(60, 64), tracks=2):
    events = [(t * 480 + o * 480, 1 - o, 0, p, 90 * (1 - o)) for t, p in enumerate(pitches) for o in (0, 1)]
    return smf.encode([(f"T{k}", sorted(events, key=lambda e: (e[0], e[1]))) for k in range(tracks)])


def test_the_source_reads_what_the_decoder_reads_and_takes_conditions(spark, tmp_path):
    scores.register(spark)
    folder = tmp_path / "a" / "b"
    folder.mkdir(parents=True)
    for k in range(6):
        (folder / f"{k}.mid").write_bytes(a_file())
    (folder / "bad.MIDI").write_bytes(b"nonsense")
    (folder / "readme.txt").write_bytes(b"x")
    source, plain = spark.read.format("scores").load(str(tmp_path)), smf.read_events(spark, str(tmp_path))
    assert source.exceptAll(plain).count() == plain.exceptAll(source).count() == 0 and source.where("kind = 'error'").count() == 1
    asked = "track_id = 2 AND kind IN ('note_on', 'note_off')"
    some = source.where(asked)
    assert some.exceptAll(plain.where(asked)).count() == plain.where(asked).exceptAll(some).count() == 0 and some.count() == 24
    filters = [line for line in some._jdf.queryExecution().executedPlan().toString().split("\n") if "Filter" in line and "BatchScan" not in line]
    assert not any("note_on" in line or "= 2" in line for line in filters), "conditions are the source's"
    reader = scores.Reader({"path": str(tmp_path), "partitionbytes": "200000"})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    left = list(reader.pushFilters([EqualTo(("track_id",), 1), GreaterThan(("tick",), 3)]))
    assert left == [GreaterThan(("tick",), 3)] and reader.tracks == {1}
    parts = reader.partitions()
    assert len(parts) > 1 and sum(len(p.paths) for p in parts) == 7


def test_files_are_written_and_the_table_function_reads_contents(spark, tmp_path):
    scores.register(spark)
    files = spark.createDataFrame([(f"/x/{k}.mid", bytearray(a_file())) for k in range(4)], "path string, content binary")
    for _ in range(2):
        files.write.format("scores").mode("append").save(str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == [f"{k}.mid" for k in range(4)]
    by_function = scores.DecodeSmf(files.asTable())
    assert by_function.exceptAll(smf.decode_files(files)).count() == 0 and by_function.count() == smf.decode_files(files).count()
    files.createOrReplaceTempView("contents")
    assert spark.sql("SELECT * FROM decode_smf(TABLE(SELECT path, content FROM contents)) WHERE kind = 'note_on'").count() == 16


# keyed tables and the clip index


def test_a_batch_that_comes_twice_changes_nothing(spark, tmp_path):
    to, shape = str(tmp_path / "t"), "k string, v long, x string, tags array<string>"
    first = spark.createDataFrame([("a", 1, "one", ["t"]), ("b", 1, "one", None), ("a", 1, "one", ["t"])], shape)
    second = spark.createDataFrame([("a", 2, "two", None), ("c", 1, "new", []), ("b", 0, "old", [])], shape)
    for batch in (first, first, second, second, first):
        changes.apply(batch, to, "k", "v", buckets=2)
    assert {(r.k, r.v, r.x) for r in changes.load(spark, to).collect()} == {("a", 2, "two"), ("b", 1, "one"), ("c", 1, "new")}


def test_the_clip_index_follows_its_folder(spark, tmp_path):
    source, to, state = tmp_path / "in", str(tmp_path / "clips"), str(tmp_path / "state")
    source.mkdir()
    (source / "Some Artist - First Song.mid").write_bytes(a_file())
    (source / "broken.mid").write_bytes(b"nonsense")
    given = {"genres_given": ["Rock", "no such genre"], "tags": ["t"]}
    index.index_folder(spark, str(source), to, state, **given)
    clips = changes.load(spark, to)
    assert {(c.track_name, c.note_count, c.artist, c.title, tuple(c.genres), tuple(c.tags)) for c in clips.collect()} == {(f"T{k}", 2, "Some Artist", "First Song", ("rock",), ("t",)) for k in (0, 1)}
    (source / "Other - Song.mid").write_bytes(a_file((60, 62, 65), 1))
    index.index_folder(spark, str(source), to, state, **given)
    index.index_folder(spark, str(source), str(tmp_path / "clips"), str(tmp_path / "other state"), **given)
    clips = changes.load(spark, to)
    assert sorted((c.artist, c.note_count) for c in clips.collect()) == [("Other", 3), ("Some Artist", 2), ("Some Artist", 2)]
    assert [len(p) for p in index.pages(clips, 2)] == [2, 1] and len({c.clip_id for c in index.each(clips, 1)}) == 3
    new = index.update_metadata(clips, F.col("artist") == "Other", genres_given=["ROCK", "own genre"], title="New")
    assert {(c.artist, c.title, tuple(c.genres)) for c in new.collect()} == {("Other", "New", ("rock", "own genre")), ("Some Artist", "First Song", ("rock",))}
    assert {c.title for c in index.update_titles(new).collect()} == {"Song", "First Song"}


def test_answers_by_id(spark):
    body = '{"id": "r1", "title": "T", "artist-credit": [{"artist": {"name": "A"}}], "tags": [{"name": "rock", "count": 2}]}'
    answers = spark.createDataFrame([("k", body), ("none", None)], "key string, body string")
    assert [(r.key, r.id, r.title, r.artist, r.tags) for r in cache.by_id(answers, "recording").collect()] == [("k", "r1", "T", "A", ["rock"])]
    artist = spark.createDataFrame([("k", '{"id": "a1", "name": "A", "sort-name": "A, The"}')], "key string, body string")
    assert [(r.id, r.name, r.sort_name) for r in cache.by_id(artist, "artist").collect()] == [("a1", "A", "A, The")]
