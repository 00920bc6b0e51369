"""Queries on nested songs, clips with their notes, JSON forms and exports of clips."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewright import shared
from notewright.operators import arpeggios, chunks, export, nested
from notewright.operators.features import TRACK
from notewright.plans import library
from notewright.plans.harmony import ARPS, TEMPLATES
from notewright.plans.repeats import CHUNKS, PRINTS, prints
from notewright.plans.sql import FEATURES, NOTES_A, NOTES_B, ROLES, query
from notewright.plans.tracks import METER, all_roles, maps
from notewright.sources import smf
from notewright.sources.notes import notes_from_events, notes_from_orders

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def registered(sql: str):
    def keep(function):
        QUERIES[function.__name__] = function
        ORACLE_SQL[function.__name__] = sql
        return function

    return keep


def all_songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = notes_from_events(spark, sf_dir)
    signatures, tempos = maps(spark, notes)
    return nested.songs(notes, tempos=tempos, signatures=signatures)


NOTE = "{'note_seq': note_seq, 'start_beat': start_beat, 'duration_beats': duration_beats, 'pitch': pitch, 'velocity': velocity, 'channel': channel}"
LISTED = f"""
listed AS (SELECT song_id, track_id, list({NOTE} ORDER BY note_seq) AS notes FROM notes GROUP BY 1, 2),
tracked AS (SELECT song_id, list({{'track_id': track_id, 'name': NULL::VARCHAR, 'primary_channel': NULL::INTEGER, 'notes': notes}} ORDER BY track_id) AS tracks FROM listed GROUP BY 1),
sung AS (
    SELECT song_id, CAST(to_json({{'songId': song_id, 'tempoMap': t.m, 'timeSignatures': s.m, 'tracks': tracks}}) AS VARCHAR) AS json
    FROM tracked JOIN (SELECT song_id, list({{'beat': beat, 'bpm': bpm}} ORDER BY beat) AS m FROM tempos GROUP BY 1) t USING (song_id)
    JOIN (SELECT song_id, list({{'beat': beat, 'bar': bar, 'numerator': numerator, 'denominator': denominator}} ORDER BY beat) AS m FROM signatures GROUP BY 1) s USING (song_id)
)"""


@registered(query(NOTES_A, *METER, LISTED, "SELECT song_id, json FROM sung"))
def nested_songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.to_json(all_songs(spark, sf_dir))


@registered(query(NOTES_A, "SELECT * FROM notes"))
def nested_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes nested, written as JSON, read and taken apart again."""
    return nested.notes_of(nested.from_json(nested.to_json(all_songs(spark, sf_dir))))


@registered(query(NOTES_A, FEATURES, ROLES, *METER, LISTED, """SELECT r.song_id || '_' || r.track_id AS clip_id, len(tracks) AS tracks, CAST(list_sum(list_transform(tracks, lambda t: len(t.notes))) AS BIGINT) AS notes, s.first AS meter
FROM roles r JOIN tracked USING (song_id) JOIN (SELECT song_id, arg_min(numerator || '/' || denominator, beat) AS first FROM signatures GROUP BY 1) s USING (song_id) WHERE primary_role = 'chords'"""))
def load_songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole songs of the clips with chords."""
    clips = all_roles(spark, sf_dir).where("primary_role = 'chords'").select(F.concat_ws("_", *TRACK).alias("clip_id"), *TRACK)
    found = nested.load_songs(clips, all_songs(spark, sf_dir))
    meter = F.concat_ws("/", *[F.get("song.time_sig_map", F.lit(0))[c].cast("string") for c in ("numerator", "denominator")])
    notes = F.aggregate("song.tracks", F.lit(0).cast("long"), lambda n, t: n + F.size(t["notes"]))
    return found.select("clip_id", F.size("song.tracks").cast("long").alias("tracks"), notes.alias("notes"), meter.alias("meter"))


@registered(query(NOTES_A, FEATURES, ROLES, LISTED.split("tracked AS")[0].rstrip().rstrip(","), "SELECT song_id || '_' || track_id AS clip_id, CAST(to_json(notes) AS VARCHAR) AS notes FROM roles JOIN listed USING (song_id, track_id) WHERE primary_role = 'chords'"))
def load_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The notes of the clips with chords."""
    clips = all_roles(spark, sf_dir).where("primary_role = 'chords'").select(F.concat_ws("_", *TRACK).alias("clip_id"), *TRACK)
    return nested.load_tracks(clips, notes_from_events(spark, sf_dir)).select("clip_id", F.to_json("notes").alias("notes"))


LOUD = "loud AS (SELECT song_id, track_id, chunk_size, start_bar, list_transform(range(num_bars * 16), lambda k: CASE WHEN list_contains(on_steps, k) THEN round(100 / 127e0, 3) ELSE 0e0 END) AS accent_grid FROM chunked)"


@registered(query(NOTES_B, CHUNKS, PRINTS, LOUD, """SELECT song_id, track_id, chunk_size, start_bar, CAST(to_json({
    'rhythm': {'onset_grid': onset_grid, 'accent_grid': accent_grid, 'grid_size': 16, 'num_bars': num_bars, 'note_count': note_count, 'hash': rhythm_hash, 'density': round(list_sum(onset_grid) / CAST(len(onset_grid) AS DOUBLE), 3)},
    'pitch': {'intervals': intervals, 'pitch_classes': pitch_classes, 'contour': contour, 'range_semitones': range_semitones, 'mean_pitch': round(mean_pitch, 1), 'hash': pitch_hash},
    'hash': pattern_id}) AS VARCHAR) AS json FROM prints JOIN loud USING (song_id, track_id, chunk_size, start_bar)"""))
def pattern_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.pattern_json(prints(spark, sf_dir))


SHAPES = """
shaped AS (SELECT *, CAST(floor((start_beat - start_bar * 4) / 0.25) AS INTEGER) AS step FROM local WHERE chunk_size <= 2),
rooted AS (SELECT *, first_value(pitch) OVER (PARTITION BY song_id, track_id, chunk_size, start_bar ORDER BY start_beat, pitch) AS root FROM shaped)"""


@registered(query(NOTES_B, CHUNKS, SHAPES, """SELECT song_id, track_id, chunk_size, start_bar, CAST(to_json({'stepsPerBar': 16, 'lengthBars': chunk_size, 'hits': list({'step': step, 'pitch': pitch, 'vel': velocity} ORDER BY step, note_seq)}) AS VARCHAR) AS json
FROM shaped GROUP BY 1, 2, 3, 4"""))
def drum_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.drum_hits(chunks.placed(notes_from_orders(spark, sf_dir), (1, 2)))


@registered(query(NOTES_B, CHUNKS, SHAPES, """SELECT song_id, track_id, chunk_size, start_bar, CAST(to_json({'stepsPerBar': 16, 'lengthBars': chunk_size,
    'events': list({'step': step, 'interval': pitch - root, 'dur': CAST(greatest(1, round_even(duration_beats / 0.25, 0)) AS INTEGER)} ORDER BY step, note_seq)}) AS VARCHAR) AS json FROM rooted GROUP BY 1, 2, 3, 4"""))
def melodic_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.melodic_events(chunks.placed(notes_from_orders(spark, sf_dir), (1, 2)))


@registered(query(NOTES_A, TEMPLATES, ARPS, """SELECT song_id, track_id, arg_min("window", "window") AS "window", CAST(to_json({'rate': arg_min(rate, "window"), 'interval_sequence': i, 'octave_jumps': o, 'gate': arg_min(coalesce(gate, 0.5), "window")}) AS VARCHAR) AS json
FROM (SELECT *, intervals[1:8] AS i, octaves[1:8] AS o FROM arps WHERE root IS NOT NULL AND len(intervals) >= 4) GROUP BY song_id, track_id, i, o"""))
def arp_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.arp_json(arpeggios.patterns(arpeggios.windows(notes_from_events(spark, sf_dir))))


@registered(query(*library.CLIPS, """SELECT c.clip_id, CAST(to_json({'clip_id': c.clip_id, 'track_name': '', 'role': role, 'artist': coalesce(artist, ''), 'genres': CASE WHEN artist IS NULL THEN NULL ELSE list_filter([genre], lambda g: g IS NOT NULL) END, 'note_count': note_count,
    'notes': (SELECT list({'pitch': n.pitch, 'velocity': n.velocity, 'start_beat': n.start_beat, 'duration_beats': n.duration_beats} ORDER BY n.start_beat, n.note_seq) FROM notes n WHERE n.song_id = c.song_id AND n.track_id = c.track_id)}) AS VARCHAR) AS json FROM clips c"""))
def clip_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.clip_json(library.clips(spark, sf_dir), notes_from_events(spark, sf_dir))


@registered(query(NOTES_A, """firsts AS (SELECT song_id, track_id, arg_min(start_beat, note_seq) AS t0 FROM notes GROUP BY 1, 2)""", """SELECT song_id || '_' || track_id AS clip_id, count(*) AS ons, CAST(min(least(127, pitch + 5)) AS INTEGER) AS low, CAST(max(least(127, pitch + 5)) AS INTEGER) AS high,
    CAST(min(trunc((start_beat - t0) * 480)) AS BIGINT) AS first_tick, CAST(max(trunc((start_beat - t0) * 480)) AS BIGINT) AS last_tick FROM notes JOIN firsts USING (song_id, track_id) GROUP BY 1"""))
def clip_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of clips, transposed by five semitones, read again."""
    clips = library.clips(spark, sf_dir)
    files = export.clip_files(clips, notes_from_events(spark, sf_dir), transpose=5).select(F.col("clip_id").alias("path"), "content")
    events = shared.cut(smf.decode_files(files)).where("kind = 'note_on'")
    return events.groupBy(F.col("path").alias("clip_id")).agg(F.count(F.lit(1)).alias("ons"), F.min("data1").alias("low"), F.max("data1").alias("high"), F.min("tick").alias("first_tick"), F.max("tick").alias("last_tick"))
