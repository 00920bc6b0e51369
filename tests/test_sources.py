"""Files, streams and the cache."""

import struct

import pytest

from notewright.schema import NOTES
from notewright import analysis
from notewright.sources import cache, smf
from notewright.streaming import ingest


def simple_file():
    rows = [(t * 480 + off * 480, 1 - off, 0, p, v if not off else 0) for t, (p, v) in enumerate([(60, 100), (64, 90), (67, 80)]) for off in (0, 1)]
    return smf.encode([("Piano", sorted(rows, key=lambda r: (r[0], r[1])))])


def events(spark, data):
    return smf.decode_files(spark.createDataFrame([(f"/x/{k}.mid", bytearray(d)) for k, d in enumerate(data)], "path string, content binary"))


def test_round_trip(spark):
    e = events(spark, [simple_file()])
    got = [(r.pitch, r.velocity, r.start_beat, r.duration_beats) for r in smf.notes(e).orderBy("start_beat").collect()]
    assert got == [(60, 100, 0.0, 1.0), (64, 90, 1.0, 1.0), (67, 80, 2.0, 1.0)]
    assert smf.tempo_map(e).first().micros == 500000
    assert [(t.name, t.primary_channel) for t in smf.tracks(e).collect()] == [("Piano", 0)]
    total = smf.totals(e).first()
    assert (total.total_beats, total.total_bars) == (3.0, 1)


def test_songs_written_by_spark_come_back(spark):
    n = spark.createDataFrame([(1, 0, 0, 0.0, 1.0, 60, 90, 0), (1, 1, 0, 0.5, 0.5, 36, 80, 9)], NOTES)
    files = smf.encode_songs(n).collect()
    got = sorted((r.pitch, r.velocity, r.start_beat, r.duration_beats, r.channel) for r in smf.notes(events(spark, [f.content for f in files])).collect())
    assert got == [(36, 80, 0.5, 0.5, 9), (60, 90, 0.0, 1.0, 0)]


def test_a_second_on_replaces_the_first_and_unclosed_notes_vanish(spark):
    data = smf.encode([("t", [(0, 1, 0, 60, 90), (240, 1, 0, 60, 50), (480, 0, 0, 60, 0), (480, 0, 0, 61, 0), (500, 1, 0, 62, 90)])])
    assert [(r.start_tick, r.velocity) for r in smf.notes(events(spark, [data])).collect()] == [(240, 50)]


def test_running_status_and_signatures(spark):
    body = b"\x00\xff\x58\x04\x03\x02\x18\x08" + b"\x00\x90\x3c\x40" + b"\x60\x3c\x00" + b"\x8b\x20\xff\x58\x04\x04\x02\x18\x08" + b"\x00\xff\x2f\x00"
    data = b"MThd" + struct.pack(">IHHH", 6, 0, 1, 96) + b"MTrk" + struct.pack(">I", len(body)) + body
    e = events(spark, [data])
    assert smf.notes(e).count() == 1
    got = [(r.numerator, r.bar) for r in smf.signature_map(e).orderBy("tick").collect()]
    assert got == [(3, 0), (4, 5)]


def test_bad_files_are_rows(spark):
    e = events(spark, [b"nonsense", simple_file()[:-12], b""])
    assert e.where("kind = 'error'").count() == 3


def test_ingest_reads_new_files_only(spark, tmp_path):
    source, target, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    source.mkdir()
    (source / "a.mid").write_bytes(simple_file())
    ingest.ingest(spark, str(source), target, state)
    once = spark.read.parquet(target).count()
    ingest.ingest(spark, str(source), target, state)
    assert spark.read.parquet(target).count() == once
    (source / "b.mid").write_bytes(simple_file())
    ingest.ingest(spark, str(source), target, state)
    assert spark.read.parquet(target).count() == 2 * once


def test_one_call_from_files_to_the_analysis(spark, tmp_path):
    def events(pitches, channel):
        return sorted([(480 * k, 1, channel, p, 90) for k, p in enumerate(pitches)] + [(480 * k + 240, 0, channel, p, 0) for k, p in enumerate(pitches)])

    folder = tmp_path / "Q" / "Queen"
    folder.mkdir(parents=True)
    (folder / "my_song.mid").write_bytes(smf.encode([("Song Title", events([60, 64, 67, 72] * 12, 0)), ("Drums", events([36, 38] * 24, 9))], bpm=90))
    (tmp_path / "broken.mid").write_bytes(b"MThd")
    a = analysis.analyze(spark, str(tmp_path))
    song = a.songs.first()
    assert (song.artist, song.title, song.source, song.total_bars) == ("Queen", "My Song", "folder_structure", 12)
    assert a.notes.count() == 96 and a.errors.count() == 1
    assert a.keys.first().root is not None and a.roles.where("primary_role = 'drums'").count() == 1
    assert a.chords.count() > 0 and a.bars.count() == 12 and a.swing.count() >= 1
    assert a.clusters.where("occurrences > 1").count() > 0 and a.instances.count() >= a.patterns.count() > 0
    assert a.arpeggios.count() > 0 and a.sections.columns[0] == "song_id" and a.features.count() == 2 and a.tracks.count() == 2


def test_cache_forgets(spark):
    day = 86400.0
    rows = spark.createDataFrame([("a", "search", "{}", 0.0), ("b", "musicbrainz", "{}", 0.0)], "key string, source string, body string, stored double")
    assert [r.key for r in cache.fresh(rows, 2 * day).collect()] == ["b"]
    s = cache.stats(rows, 2 * day).first()
    assert (s.answers, s.expired) == (2, 1)


def test_client_waits_and_tries_again():
    slept, calls = [], []

    def transport(q):
        calls.append(q)
        if len(calls) < 3:
            raise OSError
        return {"ok": 1}

    assert cache.Client(transport, sleep=slept.append, clock=lambda: 0.0)({"q": 1}) == {"ok": 1}
    assert len(calls) == 3 and slept.count(1.0) >= 1 and 2.0 in slept
    assert cache.key("x", {"a": 1, "b": 2}) == cache.key("x", {"b": 2, "a": 1})


def test_nested_answers(spark):
    body = '{"recordings": [{"title": "T", "artist-credit": [{"artist": {"name": "A"}}], "tags": [{"name": "rock", "count": 2}]}]}'
    r = cache.recordings(spark.createDataFrame([("k", body)], "key string, body string")).first()
    assert (r.title, r.artist, list(r.tags)) == ("T", "A", ["rock"])


def test_questions_meet_their_answers(spark):
    body = '{"recordings": [{"id": "1", "title": "My Song (live)", "artist-credit": [{"artist": {"name": "The Band"}}], "tags": [{"name": "rock"}, {"name": "live"}]}, {"id": "2", "title": "Other"}], "releases": [{"id": "9", "title": "R", "label-info": [{"label": {"name": "L"}}], "tags": [{"name": "pop"}, {"name": "rock"}]}], "artists": [{"id": "7", "name": "The Band", "sort-name": "Band, The", "country": "CA"}]}'
    answers = spark.createDataFrame([("k", body)], "key string, body string")
    questions = spark.createDataFrame([("k", "my song", "the band"), ("none", "x", "y")], "key string, title string, artist string")
    got = {r.key: r for r in cache.lookup(questions, answers).collect()}
    assert (got["k"].found_id, got["k"].confidence, list(got["k"].tags)) == ("1", 0.9, ["rock", "live"])
    assert (got["none"].found_id, got["none"].confidence) == (None, 0.0)
    assert list(cache.genre_tags(cache.recordings(answers), cache.releases(answers)).first().tags) == ["live", "pop", "rock"]
    assert cache.releases(answers).first().label == "L" and cache.artists(answers).first().sort_name == "Band, The"


@pytest.mark.parametrize("data", [b"MThd", b"MThd\x00\x00\x00\x06\x00\x00\x00\x01\x80\x00"])
def test_decoder_refuses(data):
    with pytest.raises((ValueError, struct.error)):
        list(smf.decode(data))
