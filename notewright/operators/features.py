"""Features of tracks: one pass of grouped and windowed aggregates over the notes."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TRACK = ["song_id", "track_id"]


def end_beat() -> F.Column:
    return F.col("start_beat") + F.col("duration_beats")


def song_bars(notes: DataFrame, beats_per_bar: float = 4.0) -> DataFrame:
    """(song_id, total_bars): the bar in which the song's last note ends, counted from one."""
    return notes.groupBy("song_id").agg((F.floor(F.max(end_beat()) / beats_per_bar) + 1).cast("int").alias("total_bars"))


def _overlap() -> F.Column:
    """1 for a note that begins while an earlier one of its track sounds, else 0."""
    before = W.partitionBy(*TRACK).orderBy("start_beat", "note_seq").rowsBetween(W.unboundedPreceding, -1)
    return F.coalesce((F.max(end_beat()).over(before) > F.col("start_beat")).cast("double"), F.lit(0.0))


def _off_beat() -> F.Column:
    at = F.pmod("start_beat", F.lit(1.0))
    return (((at > 0.1) & (at < 0.4)) | ((at > 0.6) & (at < 0.9))).cast("double")


def polyphony(notes: DataFrame, compat: bool = True) -> DataFrame:
    """(song, track, polyphony_ratio): 1 if any two notes overlap, else 0; with compat=False the share of notes that begin while
    another sounds."""
    return notes.withColumn("over", _overlap()).groupBy(*TRACK).agg((F.max("over") if compat else F.avg("over")).alias("polyphony_ratio"))


def syncopation(notes: DataFrame) -> DataFrame:
    """(song, track, syncopation): the share of notes that begin off the beat and off its half."""
    return notes.groupBy(*TRACK).agg(F.avg(_off_beat()).alias("syncopation"))


def repetition(notes: DataFrame, beats_per_bar: float = 4.0) -> DataFrame:
    """(song, track, repetition_score): bar patterns that come back, per bar with notes; 0 below eight notes or two bars."""
    bars = notes.groupBy(*TRACK, F.floor(F.col("start_beat") / beats_per_bar).alias("bar")).agg(F.array_sort(F.collect_list(F.struct("note_seq", "pitch"))).alias("s"), F.count(F.lit(1)).alias("n"))
    patterns = bars.groupBy(*TRACK, F.col("s.pitch").alias("pattern")).agg(F.count(F.lit(1)).alias("bars"), F.sum("n").alias("n"))
    score = F.count_if(F.col("bars") > 1) / F.sum("bars")
    return patterns.groupBy(*TRACK).agg(F.when((F.sum("n") < 8) | (F.sum("bars") < 2), 0.0).otherwise(score).alias("repetition_score"))


def _class_counts() -> F.Column:
    return F.array(*[F.count_if(F.pmod("pitch", F.lit(12)) == k) for k in range(12)])


def _entropy(counts: F.Column, total: F.Column) -> F.Column:
    p = F.transform(F.filter(counts, lambda n: n > 0), lambda n: n / total)
    return -F.aggregate(p, F.lit(0.0), lambda s, x: s + x * F.log2(x)) / F.log2(F.lit(12.0))


def entropy(notes: DataFrame) -> DataFrame:
    """(song, track, pitch_class_entropy): 0 for one pitch class, 1 for twelve alike."""
    counts = notes.groupBy(*TRACK).agg(_class_counts().alias("counts"), F.count(F.lit(1)).alias("n"))
    return counts.select(*TRACK, _entropy(F.col("counts"), F.col("n")).alias("pitch_class_entropy"))


def track_features(notes: DataFrame, compat: bool = True, lengths: DataFrame | None = None) -> DataFrame:
    """All features of every track that has notes. The notes are dealt out by track once; every window, grouping and join of tracks keeps to
    that. lengths: (song_id, total_bars), as files tell them; without, bars of four beats up to the last note."""
    dealt = notes.repartition(*TRACK)
    over = F.max("over") if compat else F.avg("over")
    basic = dealt.withColumn("over", _overlap()).groupBy(*TRACK).agg(
        F.count(F.lit(1)).alias("note_count"),
        F.min("pitch").alias("pitch_min"),
        F.max("pitch").alias("pitch_max"),
        F.median("pitch").alias("pitch_median"),
        (F.max("pitch") - F.min("pitch")).alias("pitch_range"),
        F.avg("velocity").alias("avg_velocity"),
        F.avg("duration_beats").alias("avg_duration"),
        F.bool_or(F.col("channel") == 9).alias("is_channel_10"),
        over.alias("polyphony_ratio"),
        F.avg(_off_beat()).alias("syncopation"),
        F.max(end_beat()).alias("last_beat"),
        _class_counts().alias("class_counts"),
    )
    found = basic.withColumn("pitch_class_entropy", _entropy(F.col("class_counts"), F.col("note_count"))).drop("class_counts").join(repetition(dealt), TRACK)
    if lengths is not None:
        bars = F.greatest(F.coalesce("total_bars", F.lit(1)), F.lit(1))
        return found.join(lengths.select("song_id", "total_bars"), "song_id", "left").withColumn("note_density", F.col("note_count") / bars).drop("last_beat", "total_bars")
    # the song's bars follow from its tracks' ends, a row each
    bars = F.greatest(F.floor(F.max("last_beat").over(W.partitionBy("song_id")) / 4.0) + 1, F.lit(1))
    return found.withColumn("note_density", F.col("note_count") / bars).drop("last_beat")


def with_defaults(tracks: DataFrame, features: DataFrame) -> DataFrame:
    """Features of all tracks; those without notes have the defaults."""
    defaults = {"note_count": 0, "note_density": 0.0, "pitch_min": 127, "pitch_max": 0, "pitch_median": 64.0, "pitch_range": 0, "avg_velocity": 64.0, "avg_duration": 1.0, "polyphony_ratio": 0.0, "syncopation": 0.0, "repetition_score": 0.0, "pitch_class_entropy": 0.0, "is_channel_10": False}
    return tracks.select(*TRACK).join(features, TRACK, "left").fillna(defaults)
