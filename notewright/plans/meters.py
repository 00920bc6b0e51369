"""Queries under the meters of songs: chunks and fingerprints, sections, arpeggio windows, and chords without drums."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewright.operators import arpeggios, chords, chunks, sections
from notewright.operators.features import TRACK
from notewright.plans.harmony import ARPS, BARS, BOUNDARIES, DENSITIES, DETECTED, NOVEL, SECTIONS, SMOOTHED, SONG, TEMPLATES, WINDOWS, text
from notewright.plans.repeats import PRINTS
from notewright.plans.sql import FEATURES, NOTES_A, NOTES_B, ROLES, query, values
from notewright.plans.tracks import all_roles, r6, rounded
from notewright.sources.notes import notes_from_events, notes_from_orders

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def registered(sql: str):
    def keep(function):
        QUERIES[function.__name__] = function
        ORACLE_SQL[function.__name__] = sql
        return function

    return keep


#: (kind of song, beat, bar, numerator, denominator): songs of kind 2 have no signatures.
METERS = [(0, 0.0, 0, 3, 4), (0, 12.0, 4, 4, 4), (0, 44.0, 12, 7, 8), (1, 0.0, 0, 6, 8), (1, 15.0, 5, 5, 4)]
SIGNED = [
    values(METERS, "meter_rows", "kind, beat, bar, numerator, denominator"),
    """sigs AS (
    SELECT song_id, CAST(beat AS DOUBLE) AS beat, bar, numerator, denominator, numerator * 4e0 / denominator AS bpb FROM (SELECT DISTINCT song_id FROM notes) JOIN meter_rows ON kind = song_id % 3
), firsts AS (SELECT song_id, coalesce(arg_min(bpb, bar), 4e0) AS bpb FROM (SELECT DISTINCT song_id FROM notes) LEFT JOIN sigs USING (song_id) GROUP BY 1)""",
]


def meters(notes: DataFrame) -> DataFrame:
    """A signature map for each song."""
    rows = F.array(*[F.struct(*[F.lit(x).alias(c) for x, c in zip(r, ("kind", "beat", "bar", "numerator", "denominator"), strict=True)]) for r in METERS])
    return notes.select("song_id").distinct().select("song_id", F.explode(rows).alias("m")).where("m.kind = song_id % 3").select("song_id", "m.beat", "m.bar", "m.numerator", "m.denominator")


METERED = """
lengths AS (SELECT song_id, CAST(floor(max(start_beat + duration_beats) / any_value(bpb)) AS INTEGER) + 1 AS bars FROM notes JOIN firsts USING (song_id) GROUP BY 1),
spans AS (
    SELECT song_id, track_id, chunk_size, CAST(unnest(range(0, bars, chunk_size)) AS INTEGER) AS start_bar, bars
    FROM (SELECT DISTINCT song_id, track_id FROM notes) JOIN lengths USING (song_id), (SELECT unnest([1, 2, 4, 8, 16]) AS chunk_size)
), metered AS (
    SELECT s.*, least(s.start_bar + s.chunk_size, s.bars) AS end_bar, coalesce(g.bpb, 4e0) AS bpb FROM spans s ASOF LEFT JOIN sigs g ON s.song_id = g.song_id AND s.start_bar >= g.bar
), bounded AS (SELECT *, start_bar * bpb AS start_beat, end_bar * bpb AS end_beat FROM metered)"""
CHUNKED = """
chunked AS (
    SELECT s.song_id, s.track_id, s.chunk_size, s.start_bar, s.end_bar, s.end_bar - s.start_bar AS num_bars, s.bpb, s.start_beat, s.end_beat, count(n.pitch) AS note_count,
        coalesce(list(n.pitch ORDER BY n.start_beat, n.note_seq) FILTER (n.pitch IS NOT NULL), []) AS pitches,
        coalesce(list(DISTINCT CAST(floor((n.start_beat - s.start_beat) / (s.bpb / 16)) AS INTEGER)) FILTER (n.pitch IS NOT NULL), []) AS on_steps
    FROM bounded s LEFT JOIN notes n ON s.song_id = n.song_id AND s.track_id = n.track_id AND n.start_beat >= s.start_beat AND n.start_beat < s.end_beat
    GROUP BY ALL
)"""
BOUNDS = "song_id, track_id, chunk_size, start_bar, end_bar, num_bars, start_beat, end_beat, note_count, bpb AS beats_per_bar"


@registered(query(NOTES_B, *SIGNED, METERED, CHUNKED, f"SELECT {BOUNDS} FROM chunked"))
def chunks_with_meter(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = notes_from_orders(spark, sf_dir)
    return chunks.chunks(notes, signatures=meters(notes))


@registered(query(NOTES_B, *SIGNED, METERED, CHUNKED, PRINTS, "SELECT song_id, track_id, chunk_size, start_bar, bpb AS beats_per_bar, note_count, array_to_string(onset_grid, '') AS grid, rhythm_hash, pitch_hash, pattern_id FROM prints"))
def fingerprints_with_meter(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = notes_from_orders(spark, sf_dir)
    found = chunks.fingerprints(notes, signatures=meters(notes))
    return found.select(*chunks.CHUNK, "beats_per_bar", "note_count", F.array_join(F.transform("onset_grid", lambda x: x.cast("string")), "").alias("grid"), "rhythm_hash", "pitch_hash", "pattern_id")


#: Every bar with its own length, after all bars before it, far enough for the longest song.
CUMULATIVE = """
ends AS (SELECT song_id, max(start_beat + duration_beats) AS last FROM notes GROUP BY 1),
each_bar AS (SELECT song_id, last, CAST(unnest(range(CAST(last / 3 AS BIGINT) + 3)) AS INTEGER) AS bar FROM ends),
long_bars AS (SELECT b.song_id, b.bar, b.last, coalesce(arg_max(g.bpb, g.bar), 4e0) AS bpb FROM each_bar b LEFT JOIN sigs g ON b.song_id = g.song_id AND b.bar >= g.bar GROUP BY 1, 2, 3),
clock AS (SELECT *, sum(bpb) OVER (PARTITION BY song_id ORDER BY bar) - bpb AS at_beat FROM long_bars),
listed AS (SELECT song_id, list(at_beat ORDER BY bar) AS starts, list(bpb ORDER BY bar) AS lengths, CAST(max(bar) FILTER (at_beat <= last) + 1 AS INTEGER) AS bars FROM clock GROUP BY 1),
spans AS (
    SELECT song_id, track_id, chunk_size, CAST(unnest(range(0, bars, chunk_size)) AS INTEGER) AS start_bar, bars, starts, lengths
    FROM (SELECT DISTINCT song_id, track_id FROM notes) JOIN listed USING (song_id), (SELECT unnest([1, 2, 4, 8, 16]) AS chunk_size)
), bounded AS (
    SELECT song_id, track_id, chunk_size, start_bar, least(start_bar + chunk_size, bars) AS end_bar, lengths[start_bar + 1] AS bpb, starts[start_bar + 1] AS start_beat,
        starts[least(start_bar + chunk_size, bars) + 1] AS end_beat
    FROM spans
)"""


@registered(query(NOTES_B, *SIGNED, CUMULATIVE, CHUNKED, f"SELECT {BOUNDS} FROM chunked"))
def chunks_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks whose bars each have their own length."""
    notes = notes_from_orders(spark, sf_dir)
    return chunks.chunks(notes, signatures=meters(notes), compat=False)


def metered(sql: str, beats: str = "bpb") -> str:
    """SQL for bars of four beats, with the first meter's in their place."""
    return sql.replace("/ 4e0 AS density", f"/ any_value({beats}) AS density").replace("/ 4)", f"/ {beats})").replace("* 4)", f"* {beats})")


METERED_BARS = metered(BARS).replace("max(start_beat + duration_beats) / bpb", "max(start_beat + duration_beats) / any_value(bpb)").replace("AS bar FROM notes GROUP BY 1", "AS bar FROM notes JOIN firsts USING (song_id) GROUP BY 1").replace("FROM notes n JOIN section_roles r USING (song_id, track_id)", "FROM notes n JOIN section_roles r USING (song_id, track_id) JOIN firsts USING (song_id)").replace("n.*, r.role, r.is_bass", "n.*, bpb, r.role, r.is_bass")


@registered(query(NOTES_A, FEATURES, ROLES, *SIGNED, METERED_BARS, NOVEL, BOUNDARIES, SECTIONS, f"SELECT song_id, section, start_bar, end_bar, active_tracks, note_count, pitch_range, unique_pitches, harmonic_rhythm, {r6('avg_velocity', 'avg_velocity')}, {', '.join(r6(c, c) for c in DENSITIES)} FROM sections").replace("WITH ", "WITH RECURSIVE ", 1))
def sections_with_meter(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = notes_from_events(spark, sf_dir)
    bars = sections.bar_features(notes, all_roles(spark, sf_dir), signatures=meters(notes))
    return rounded(sections.sections(bars, sections.boundaries(sections.novelty(bars))), "avg_velocity", *DENSITIES)


METERED_ARPS = metered(ARPS).replace("FROM notes n JOIN (SELECT song_id, track_id, min(start_beat) AS t0 FROM notes GROUP BY 1, 2) USING (song_id, track_id)", "FROM notes n JOIN (SELECT song_id, track_id, min(start_beat) AS t0 FROM notes GROUP BY 1, 2) USING (song_id, track_id) JOIN firsts USING (song_id)").replace("SELECT n.*, CAST", "SELECT n.*, bpb, CAST")


@registered(query(NOTES_A, *SIGNED, TEMPLATES, METERED_ARPS, f"""SELECT song_id, track_id, "window", start_beat, notes, CAST(coalesce(root, -1) AS INTEGER) AS root, coalesce(quality, '?') AS quality,
    {r6("coalesce(confidence, 0)", "confidence")}, coalesce(array_to_string(intervals, ','), '') AS intervals, rate, {r6("coalesce(gate, -1)", "gate")} FROM arps"""))
def arp_windows_with_meter(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = notes_from_events(spark, sf_dir)
    rows = arpeggios.windows(notes, signatures=meters(notes)).fillna({"root": -1, "quality": "?", "confidence": 0.0, "gate": -1.0})
    return rounded(rows.select(*TRACK, "window", "start_beat", "notes", "root", "quality", "confidence", F.coalesce(text("intervals"), F.lit("")).alias("intervals"), "rate", "gate"), "confidence", "gate")


MELODIC = "melodic AS (SELECT n.* FROM notes n LEFT JOIN roles r USING (song_id, track_id) WHERE r.primary_role IS DISTINCT FROM 'drums')"
FIRST = "melodic AS (SELECT * FROM all_melodic QUALIFY track_id = min(track_id) OVER (PARTITION BY song_id))"
SHOWN = f"SELECT song_id, position, start_beat, end_beat, root, quality, CAST(coalesce(bass, -1) AS INTEGER) AS bass, {r6('confidence', 'confidence')} FROM smoothed"
MELODIC_WINDOWS = WINDOWS.replace("FROM notes", "FROM melodic")


def chords_of(notes: DataFrame) -> DataFrame:
    return rounded(chords.smooth(chords.detect_chords(notes, SONG), SONG), "confidence").fillna({"bass": -1})


@registered(query(NOTES_A, FEATURES, ROLES, MELODIC, MELODIC_WINDOWS, TEMPLATES, DETECTED, SMOOTHED, SHOWN))
def song_chords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chords of songs from all tracks but drums."""
    return chords_of(chords.song_notes(notes_from_events(spark, sf_dir), all_roles(spark, sf_dir)))


@registered(query(NOTES_A, FEATURES, ROLES, "all_" + MELODIC, FIRST, MELODIC_WINDOWS, TEMPLATES, DETECTED, SMOOTHED, SHOWN))
def first_track_chords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chords of songs from their first track that isn't drums."""
    return chords_of(chords.song_notes(notes_from_events(spark, sf_dir), all_roles(spark, sf_dir), combine=False))
