"""Bars under meters, against the rules applied note by note; and files of other meters than 4/4 through the whole analysis."""

import math
import random
import struct

import pytest

from notewright import analysis
from notewright.operators import arpeggios, chords, chunks, meter, sections
from notewright.schema import NOTES
from notewright.sources import smf

SIGS = [(1, 0.0, 0, 3, 4), (1, 12.0, 4, 4, 4), (1, 28.0, 8, 7, 8), (2, 0.0, 0, 6, 8), (2, 9.0, 3, 6, 8), (4, 8.0, 2, 2, 4)]
SIG_SCHEMA = "song_id long, beat double, bar int, numerator int, denominator int"


def rows(seed=1):
    r = random.Random(seed)
    return [(song, track, k, r.randrange(0, 48 * 8) / 8, r.choice([0.25, 0.5, 2.0]), r.randrange(40, 80), r.randrange(1, 127), track) for song in (1, 2, 3, 4) for track in (0, 1) for k in range(25)]


def sigs_of(song):
    return [(bar, n * 4 / d) for s, _, bar, n, d in SIGS if s == song] or [(0, 4.0)]


def length_at(song, bar):
    known = sigs_of(song)
    return ([x for b, x in known if b <= bar] or [known[0][1]])[-1]


def cumulative(song, bar):
    return sum(length_at(song, b) for b in range(bar))


@pytest.mark.parametrize("compat", [True, False])
def test_chunks_hold_the_notes_that_the_rules_give_them(spark, compat):
    data = rows()
    notes, signatures = spark.createDataFrame(data, NOTES), spark.createDataFrame(SIGS, SIG_SCHEMA)
    want = {}
    for song in (1, 2, 3, 4):
        end = max(s + d for i, _, _, s, d, *_ in data if i == song)
        bars = math.floor(end / length_at(song, 0)) + 1 if compat else next(b for b in range(500) if cumulative(song, b + 1) > end) + 1
        for track in (0, 1):
            for size in (1, 2, 4):
                for start in range(0, bars, size):
                    stop = min(start + size, bars)
                    low, high = (start * length_at(song, start), stop * length_at(song, start)) if compat else (cumulative(song, start), cumulative(song, stop))
                    own = [n for n in data if n[0] == song and n[1] == track and low <= n[3] < high]
                    want[song, track, size, start] = (stop, low, high, length_at(song, start), sorted((n[3], n[2], n[5]) for n in own))
    got = {(r.song_id, r.track_id, r.chunk_size, r.start_bar): r for r in chunks.chunks(notes, (1, 2, 4), signatures=signatures, compat=compat).collect()}
    assert set(got) == set(want)
    for k, (stop, low, high, beats, own) in want.items():
        assert (got[k].end_bar, got[k].start_beat, got[k].end_beat, got[k].beats_per_bar, got[k].note_count) == (stop, low, high, beats, len(own)), k
    prints = {(r.song_id, r.track_id, r.chunk_size, r.start_bar): r for r in chunks.fingerprints(notes, (1, 2, 4), signatures=signatures, compat=compat).collect()}
    assert set(prints) == set(want)
    for k, (stop, low, _, beats, own) in want.items():
        assert prints[k].note_count == len(own) and len(prints[k].onset_grid) == 16 * (stop - k[3])
        assert prints[k].intervals == [b[2] - a[2] for a, b in zip(own, own[1:], strict=False)], k
        if compat:
            assert [n for n, x in enumerate(prints[k].onset_grid) if x] == sorted({int((s - low) / (beats / 16)) for s, _, _ in own})


def test_without_signatures_all_is_in_four(spark):
    notes = spark.createDataFrame(rows(2), NOTES)
    none = spark.createDataFrame([], SIG_SCHEMA)
    plain = sorted(map(tuple, chunks.fingerprints(notes).drop("accent_grid").collect()), key=str)
    assert plain == sorted(map(tuple, chunks.fingerprints(notes, signatures=none).drop("accent_grid", "beats_per_bar").collect()), key=str)


def test_clock_of_odd_maps(spark):
    odd = spark.createDataFrame([(1, 4.0, 1, 4, 4), (1, 6.0, 1, 3, 4), (1, 10.0, 3, 2, 4)], SIG_SCHEMA)
    assert [tuple(r)[1:] for r in meter.clock(odd).orderBy("sig_bar").collect()] == [(0, 0.0, 3.0), (3, 9.0, 2.0)]
    assert meter.first_meter(odd).first().beats_per_bar == 3.0


def waltz(bars=4, meters=((0, 3, 2),)):
    """Quarter notes in 3/4 or under (tick, numerator, power) changes, 480 ticks a quarter."""
    body, at = b"", 0
    for tick, n, power in meters:
        body, at = body + smf._vlq(tick - at) + b"\xff\x58\x04" + bytes([n, power, 24, 8]), tick
    notes, at = b"", 0
    for k in range(3 * bars):
        notes += b"\x00\x90" + bytes([60 + k % 5, 90]) + smf._vlq(480) + b"\x80" + bytes([60 + k % 5, 0])
    chunk = lambda b: b"MTrk" + struct.pack(">I", len(b) + 4) + b + b"\x00\xff\x2f\x00"
    return b"MThd" + struct.pack(">IHHH", 6, 1, 2, 480) + chunk(body) + chunk(notes)


def test_a_waltz_has_its_bars_everywhere(spark, tmp_path):
    (tmp_path / "waltz.mid").write_bytes(waltz(4))
    (tmp_path / "mixed.mid").write_bytes(waltz(4, ((0, 3, 2), (6 * 480, 2, 2))))
    found = analysis.analyze(spark, str(tmp_path))
    name = {r.song_id: r.path.rsplit("/", 1)[1] for r in found.songs.collect()}
    per = lambda df: {name[r.song_id]: r["count"] for r in df.groupBy("song_id").count().collect()}
    assert per(found.bars)["waltz.mid"] == 4
    prints = found.fingerprints.where("chunk_size = 1 AND note_count > 0")
    assert {name[r.song_id]: r.n for r in prints.groupBy("song_id").agg({"note_count": "max"}).withColumnRenamed("max(note_count)", "n").collect()} == {"waltz.mid": 3, "mixed.mid": 3}
    assert per(prints)["waltz.mid"] == 4
    density = {name[r.song_id]: r.note_density for r in found.features.collect()}
    assert density["waltz.mid"] == 12 / 5, "the file's own count of bars: the last ends where a fifth begins"


def test_arpeggio_windows_and_bar_features_follow_the_first_meter(spark):
    notes = spark.createDataFrame([(1, 0, k, float(k) / 2, 0.5, 60 + [0, 4, 7][k % 3], 90, 0) for k in range(24)], NOTES)
    signatures = spark.createDataFrame([(1, 0.0, 0, 3, 4)], SIG_SCHEMA)
    assert [(r.window, r.start_beat, r.notes) for r in arpeggios.windows(notes, signatures=signatures).orderBy("window").collect()] == [(k, 3.0 * k, 6) for k in range(4)]
    roles = spark.createDataFrame([(1, 0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0)], "song_id long, track_id int, drums double, bass double, lead double, pad double, arp double, chords double")
    bars = sections.bar_features(notes, roles, signatures=signatures).orderBy("bar").collect()
    assert [(r.bar, r.start_beat, r.note_count, r.density_bass) for r in bars] == [(k, 3.0 * k, 6, 2.0) for k in range(4)]


def test_chords_leave_drums_out_or_take_the_first_other_track(spark):
    notes = spark.createDataFrame([(1, t, t, 0.0, 4.0, p, 90, 0) for t, p in ((0, 36), (1, 60), (2, 64))], NOTES)
    roles = spark.createDataFrame([(1, 0, "drums"), (1, 1, "pad")], "song_id long, track_id int, primary_role string")
    pitches = lambda **o: sorted(r.pitch for r in chords.song_notes(notes, roles, **o).collect())
    assert pitches() == [60, 64] and pitches(combine=False) == [60] and pitches(drums=True) == [36, 60, 64] and pitches(drums=True, combine=False) == [36]
