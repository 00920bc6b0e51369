"""Songs as nested rows, and back: song > tracks > notes, with tempo and meter maps; clips with their notes; JSON under declared schemas.

A song's rows are grouped level by level, each level in order, so equal tables give equal nested rows; generators take them apart again, and notes -> nested -> JSON -> nested ->
notes is the same multiset. A song is one row, so it must fit a task; songs are many.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewright.operators.features import TRACK

NOTE = ["note_seq", "start_beat", "duration_beats", "pitch", "velocity", "channel"]
TEMPO = ["beat", "bpm"]
METER = ["beat", "bar", "numerator", "denominator"]
#: The names that parts of a song have in JSON.
KEYS = {"song_id": "songId", "tempo_map": "tempoMap", "time_sig_map": "timeSignatures", "tracks": "tracks"}
NOTES_TYPE = "array<struct<note_seq: bigint, start_beat: double, duration_beats: double, pitch: int, velocity: int, channel: int>>"
JSON = (
    "songId bigint, tempoMap array<struct<beat: double, bpm: double>>, timeSignatures array<struct<beat: double, bar: int, numerator: int, denominator: int>>, "
    f"tracks array<struct<track_id: int, name: string, primary_channel: int, notes: {NOTES_TYPE}>>"
)


def listed(rows: DataFrame, by: list[str], columns: list[str], name: str) -> DataFrame:
    """(by, name): the rows of each group as a sorted array of structs."""
    return rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))


def _or_none(column: str, kind: str) -> Column:
    return F.coalesce(column, F.array().cast(kind)).alias(column)


def tracks_with_notes(notes: DataFrame, tracks: DataFrame | None = None) -> DataFrame:
    """(song_id, track_id, name, primary_channel, notes); tracks: those to be there, with or without notes."""
    own = listed(notes, TRACK, NOTE, "notes")
    if tracks is None:
        return own.select(*TRACK, F.lit(None).cast("string").alias("name"), F.lit(None).cast("int").alias("primary_channel"), "notes")
    return tracks.select(*TRACK, "name", "primary_channel").join(own, TRACK, "left").select(*TRACK, "name", "primary_channel", _or_none("notes", NOTES_TYPE))


def songs(notes: DataFrame, tracks: DataFrame | None = None, tempos: DataFrame | None = None, signatures: DataFrame | None = None, info: DataFrame | None = None) -> DataFrame:
    """One row for each song: (song_id, the columns of info, tempo_map, time_sig_map, tracks). Songs of info, or else of tracks and notes, are there; those without tracks
    have none, and songs without maps empty ones."""
    whole = tracks_with_notes(notes, tracks)
    out = listed(whole.withColumn("track_id", F.col("track_id").cast("int")), ["song_id"], ["track_id", "name", "primary_channel", "notes"], "tracks")
    if info is not None:
        out = info.join(out, "song_id", "left")
    empty = {"tempo_map": "array<struct<beat: double, bpm: double>>", "time_sig_map": "array<struct<beat: double, bar: int, numerator: int, denominator: int>>"}
    for name, rows, columns in (("tempo_map", tempos, TEMPO), ("time_sig_map", signatures, METER)):
        out = out.withColumn(name, F.lit(None).cast(empty[name])) if rows is None else out.join(listed(rows, ["song_id"], columns, name), "song_id", "left")
    more = [c for c in (info.columns if info is not None else []) if c != "song_id"]
    tracks_type = f"array<struct<track_id: int, name: string, primary_channel: int, notes: {NOTES_TYPE}>>"
    return out.select("song_id", *more, *[_or_none(c, k) for c, k in empty.items()], _or_none("tracks", tracks_type))


def notes_of(nested: DataFrame) -> DataFrame:
    """The notes of nested songs."""
    each = nested.select("song_id", F.explode("tracks").alias("t")).select("song_id", "t.track_id", F.explode("t.notes").alias("n"))
    return each.select("song_id", "track_id", *[F.col(f"n.{c}") for c in NOTE])


def tracks_of(nested: DataFrame) -> DataFrame:
    return nested.select("song_id", F.explode("tracks").alias("t")).select("song_id", "t.track_id", "t.name", "t.primary_channel")


def map_of(nested: DataFrame, name: str) -> DataFrame:
    """The tempo_map or time_sig_map of nested songs as rows."""
    return nested.select("song_id", F.explode(name).alias("m")).select("song_id", "m.*")


def to_json(nested: DataFrame) -> DataFrame:
    """(song_id, json), with the names of KEYS; nulls are written."""
    return nested.select("song_id", F.to_json(F.struct(*[F.col(c).alias(k) for c, k in KEYS.items()]), {"ignoreNullFields": "false"}).alias("json"))


def from_json(texts: DataFrame) -> DataFrame:
    """Nested songs from (json); what isn't a song of the schema is a row of nulls."""
    read = texts.select(F.from_json("json", JSON).alias("s"))
    return read.select(*[F.col(f"s.{k}").alias(c) for c, k in KEYS.items()])


def load_tracks(clips: DataFrame, notes: DataFrame) -> DataFrame:
    """clips (clip_id, song_id, track_id, ...) with the notes of their track, in order; null for a track that isn't there."""
    return clips.join(listed(notes, TRACK, NOTE, "notes"), TRACK, "left")


def load_songs(clips: DataFrame, nested: DataFrame) -> DataFrame:
    """clips (clip_id, song_id, ...) with the whole song they are part of; null for a song that isn't there."""
    return clips.join(nested.select("song_id", F.struct(*[c for c in nested.columns if c != "song_id"]).alias("song")), "song_id", "left")


def rhythm_struct() -> Column:
    """A rhythm fingerprint with the names and digits of its JSON; grid_size is the steps of a bar."""
    return F.struct(
        "onset_grid",
        # most steps are silent, and rounding a double is dear
        F.transform("accent_grid", lambda a: F.when(a == 0, a).otherwise(F.round(a, 3))).alias("accent_grid"),
        (F.size("onset_grid") / F.col("num_bars")).cast("int").alias("grid_size"),
        "num_bars",
        "note_count",
        F.col("rhythm_hash").alias("hash"),
        F.round("density", 3).alias("density"),
    )


def pitch_struct() -> Column:
    return F.struct("intervals", "pitch_classes", "contour", "range_semitones", F.round("mean_pitch", 1).alias("mean_pitch"), F.col("pitch_hash").alias("hash"))


def pattern_json(prints: DataFrame) -> DataFrame:
    """(song, track, chunk_size, start_bar, json) of fingerprints: rhythm, pitch and their common hash."""
    whole = F.struct(rhythm_struct().alias("rhythm"), pitch_struct().alias("pitch"), F.col("pattern_id").alias("hash"))
    return prints.select(*TRACK, "chunk_size", "start_bar", F.to_json(whole).alias("json"))


def drum_hits(placed: DataFrame, steps: int = 16, beats_per_bar: float = 4.0) -> DataFrame:
    """placed (song, track, chunk_size, start_bar, local_start, pitch, velocity) -> (.., json): hits on a grid."""
    step = F.floor(F.col("local_start") / (beats_per_bar / steps)).cast("int")
    rows = placed.withColumns({"step": step, "vel": F.col("velocity")})
    return _shaped(rows, ["step", "note_seq", "pitch", "vel"], "hits", ["step", "pitch", "vel"], steps)


def melodic_events(placed: DataFrame, steps: int = 16, beats_per_bar: float = 4.0) -> DataFrame:
    """The same with duration_beats: intervals from the chunk's first note (the lowest of those that begin with it), durations of a step or more."""
    width = beats_per_bar / steps
    step = F.floor(F.col("local_start") / width).cast("int")
    group = [*TRACK, "chunk_size", "start_bar"]
    roots = placed.groupBy(*group).agg(F.min_by("pitch", F.struct("local_start", "pitch")).alias("root"))
    rows = placed.join(roots, group).withColumns({"step": step, "interval": F.col("pitch") - F.col("root"), "dur": F.greatest(F.lit(1), F.rint(F.col("duration_beats") / width).cast("int"))})
    return _shaped(rows, ["step", "note_seq", "interval", "dur"], "events", ["step", "interval", "dur"], steps)


def _shaped(rows: DataFrame, order: list[str], name: str, shown: list[str], steps: int) -> DataFrame:
    group = [*TRACK, "chunk_size", "start_bar"]
    own = listed(rows, group, order, "own")
    parts = F.transform("own", lambda x: F.struct(*[x[c].alias(c) for c in shown])).alias(name)
    return own.select(*group, F.to_json(F.struct(F.lit(steps).alias("stepsPerBar"), F.col("chunk_size").alias("lengthBars"), parts)).alias("json"))


def arp_json(patterns: DataFrame) -> DataFrame:
    """(.., json) of arpeggio patterns (intervals, octaves, rate, gate)."""
    shape = F.struct("rate", F.col("intervals").alias("interval_sequence"), F.col("octaves").alias("octave_jumps"), "gate")
    return patterns.select(*TRACK, "window", F.to_json(shape).alias("json"))
