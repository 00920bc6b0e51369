"""Clips cut from songs, transformed, and turned into timed events."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from notewright.operators.features import TRACK, end_beat

# The General MIDI program of each role, and those offered for it in turn.
PROGRAM = {"drums": 0, "bass": 33, "chords": 4, "pad": 89, "lead": 80, "arp": 81, "other": 0}
PROGRAMS = {
    "drums": [0],
    "bass": [33, 34, 35, 36, 38, 39],
    "chords": [0, 4, 5, 6, 24, 25, 26, 27],
    "pad": [48, 49, 50, 51, 89, 90, 91, 92],
    "lead": [56, 57, 73, 80, 81],
    "arp": [11, 12, 13, 46, 81],
    "other": [0, 4, 24, 40, 48],
}


# The 128 instruments of General MIDI, in order.
INSTRUMENTS = [
    "Acoustic Grand Piano", "Bright Acoustic Piano", "Electric Grand Piano", "Honky-tonk Piano", "Electric Piano 1", "Electric Piano 2", "Harpsichord", "Clavinet",
    "Celesta", "Glockenspiel", "Music Box", "Vibraphone", "Marimba", "Xylophone", "Tubular Bells", "Dulcimer",
    "Drawbar Organ", "Percussive Organ", "Rock Organ", "Church Organ", "Reed Organ", "Accordion", "Harmonica", "Tango Accordion",
    "Acoustic Guitar (nylon)", "Acoustic Guitar (steel)", "Electric Guitar (jazz)", "Electric Guitar (clean)", "Electric Guitar (muted)", "Overdriven Guitar", "Distortion Guitar", "Guitar Harmonics",
    "Acoustic Bass", "Electric Bass (finger)", "Electric Bass (pick)", "Fretless Bass", "Slap Bass 1", "Slap Bass 2", "Synth Bass 1", "Synth Bass 2",
    "Violin", "Viola", "Cello", "Contrabass", "Tremolo Strings", "Pizzicato Strings", "Orchestral Harp", "Timpani",
    "String Ensemble 1", "String Ensemble 2", "Synth Strings 1", "Synth Strings 2", "Choir Aahs", "Voice Oohs", "Synth Voice", "Orchestra Hit",
    "Trumpet", "Trombone", "Tuba", "Muted Trumpet", "French Horn", "Brass Section", "Synth Brass 1", "Synth Brass 2",
    "Soprano Sax", "Alto Sax", "Tenor Sax", "Baritone Sax", "Oboe", "English Horn", "Bassoon", "Clarinet",
    "Piccolo", "Flute", "Recorder", "Pan Flute", "Blown Bottle", "Shakuhachi", "Whistle", "Ocarina",
    "Lead 1 (square)", "Lead 2 (sawtooth)", "Lead 3 (calliope)", "Lead 4 (chiff)", "Lead 5 (charang)", "Lead 6 (voice)", "Lead 7 (fifths)", "Lead 8 (bass + lead)",
    "Pad 1 (new age)", "Pad 2 (warm)", "Pad 3 (polysynth)", "Pad 4 (choir)", "Pad 5 (bowed)", "Pad 6 (metallic)", "Pad 7 (halo)", "Pad 8 (sweep)",
    "FX 1 (rain)", "FX 2 (soundtrack)", "FX 3 (crystal)", "FX 4 (atmosphere)", "FX 5 (brightness)", "FX 6 (goblins)", "FX 7 (echoes)", "FX 8 (sci-fi)",
    "Sitar", "Banjo", "Shamisen", "Koto", "Kalimba", "Bagpipe", "Fiddle", "Shanai",
    "Tinkle Bell", "Agogo", "Steel Drums", "Woodblock", "Taiko Drum", "Melodic Tom", "Synth Drum", "Reverse Cymbal",
    "Guitar Fret Noise", "Breath Noise", "Seashore", "Bird Tweet", "Telephone Ring", "Helicopter", "Applause", "Gunshot",
]


def extract(notes: DataFrame, start_bar: int, end_bar: int, beats_per_bar: float = 4.0) -> DataFrame:
    """Notes that begin in the bars [start_bar, end_bar), counted from the clip's start."""
    low = start_bar * beats_per_bar
    return notes.where((F.col("start_beat") >= low) & (F.col("start_beat") < end_bar * beats_per_bar)).withColumn("start_beat", F.col("start_beat") - low)


def transform(notes: DataFrame, transpose: int = 0, velocity: float = 1.0, grid: int = 0, normalize: bool = True) -> DataFrame:
    """Notes moved to begin with the first of their track (in note order), transposed, scaled in velocity and put on a grid."""
    first = F.min_by("start_beat", "note_seq").over(W.partitionBy(*TRACK))
    start = F.col("start_beat") - (first if normalize else F.lit(0.0))
    if grid:
        start = F.rint(start / (4.0 / grid)) * (4.0 / grid)
    return notes.withColumns(
        {
            "start_beat": start,
            "pitch": F.greatest(F.lit(0), F.least(F.lit(127), F.col("pitch") + transpose)),
            "velocity": F.greatest(F.lit(1), F.least(F.lit(127), (F.col("velocity") * F.lit(velocity)).cast("int"))),
        }
    )


def events(notes: DataFrame, ppq: int = 480) -> DataFrame:
    """(song, track, position, tick, delta, kind, pitch, velocity): note-ons and offs in order, offs first at one tick."""
    on = F.struct((F.col("start_beat") * ppq).cast("int").alias("tick"), F.lit(1).alias("kind"), "pitch", "velocity", "note_seq")
    off = F.struct((end_beat() * ppq).cast("int").alias("tick"), F.lit(0).alias("kind"), "pitch", F.lit(0).alias("velocity"), "note_seq")
    rows = notes.select(*TRACK, F.explode(F.array(on, off)).alias("e")).select(*TRACK, "e.*")
    w = W.partitionBy(*TRACK).orderBy("tick", "kind", "note_seq", "pitch")
    return rows.select(*TRACK, F.row_number().over(w).alias("position"), "tick", (F.col("tick") - F.coalesce(F.lag("tick").over(w), F.lit(0))).alias("delta"), "kind", "pitch", "velocity")


def as_json(notes: DataFrame) -> DataFrame:
    """(song, track, json): a track's notes as one JSON array."""
    note = F.struct("pitch", "velocity", "start_beat", "duration_beats")
    listed = notes.groupBy(*TRACK).agg(F.array_sort(F.collect_list(F.struct("note_seq", note.alias("n")))).alias("s"))
    return listed.select(*TRACK, F.to_json(F.transform("s", lambda x: x["n"])).alias("json"))


def schedule(notes: DataFrame, bpm: float = 120.0) -> DataFrame:
    """events with seconds and a playback channel: tracks in order, channel 9 left to drums."""
    tracks = notes.groupBy(*TRACK).agg(F.bool_or(F.col("channel") == 9).alias("drum"))
    place = F.sum(F.when(~F.col("drum"), 1).otherwise(0)).over(W.partitionBy("song_id").orderBy("track_id").rowsBetween(W.unboundedPreceding, 0)) - 1
    k = place % 15
    channel = F.when(F.col("drum"), 9).when(k < 9, k).otherwise(k + 1)
    return events(notes).join(tracks.withColumn("out_channel", channel.cast("int")).drop("drum"), TRACK).withColumn("seconds", F.col("tick") / 480.0 * 60.0 / bpm)


def duration_seconds(notes: DataFrame, bpm: float = 120.0) -> DataFrame:
    return notes.groupBy("song_id").agg(((F.max(end_beat()) - F.min("start_beat")) * 60.0 / bpm).alias("seconds"))


def program(role: F.Column, variation: int | None = None) -> F.Column:
    """A role's General MIDI program; with a variation one of those offered for it, in turn. 0 for what is no role."""
    out = F.lit(0)
    for name, choice in PROGRAMS.items():
        out = F.when(role == name, PROGRAM[name] if variation is None else choice[variation % len(choice)]).otherwise(out)
    return out


def instrument_name(program: F.Column) -> F.Column:
    """The name of a General MIDI program, numbers beyond 0 to 127 as they are."""
    return F.when((program >= 0) & (program < len(INSTRUMENTS)), F.get(F.array(*map(F.lit, INSTRUMENTS)), program)).otherwise(F.concat(F.lit("Program "), program.cast("string")))


def clip_json(clips: DataFrame, notes: DataFrame) -> DataFrame:
    """(clip_id, json) of clips (clip_id, song_id, track_id, role, artist, genres, note_count) with their notes, and track_name if it is there."""
    note = F.struct("start_beat", "note_seq", F.struct("pitch", "velocity", "start_beat", "duration_beats").alias("n"))
    own = notes.join(clips.select(*TRACK).distinct(), TRACK, "left_semi").groupBy(*TRACK).agg(F.transform(F.array_sort(F.collect_list(note)), lambda x: x["n"]).alias("notes"))
    named = clips if "track_name" in clips.columns else clips.withColumn("track_name", F.lit(""))
    shown = ["clip_id", "track_name", "role", "artist", "genres", "note_count", "notes"]
    return named.join(own, TRACK, "left").fillna({"track_name": "", "artist": ""}).select("clip_id", F.to_json(F.struct(*shown), {"ignoreNullFields": "false"}).alias("json"))


def clip_files(clips: DataFrame, notes: DataFrame, bpm: float = 120.0, transpose: int = 0) -> DataFrame:
    """(clip_id, content): a file of each clip's track, from its first note on."""
    from notewright.sources.smf import encode_songs

    own = transform(notes.join(clips.select("clip_id", *TRACK), TRACK), transpose=transpose)
    return encode_songs(own.drop("song_id").withColumnRenamed("clip_id", "song_id"), bpm).withColumnRenamed("song_id", "clip_id")
