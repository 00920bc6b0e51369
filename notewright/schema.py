"""Schemas of the tables and the fixed orders of labels."""

from pyspark.sql import types as T

NOTES = T.StructType(
    [
        T.StructField("song_id", T.LongType()),
        T.StructField("track_id", T.IntegerType()),
        T.StructField("note_seq", T.LongType()),
        T.StructField("start_beat", T.DoubleType()),
        T.StructField("duration_beats", T.DoubleType()),
        T.StructField("pitch", T.IntegerType()),
        T.StructField("velocity", T.IntegerType()),
        T.StructField("channel", T.IntegerType()),
    ]
)

# Names of pitch classes; roles in the order that breaks ties.
PITCH_CLASSES = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]
ROLES = ["drums", "bass", "chords", "pad", "lead", "arp", "other"]
