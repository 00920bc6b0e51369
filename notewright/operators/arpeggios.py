"""Arpeggios: chords, intervals, rates and gates of tumbling windows."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notewright.operators import meter
from notewright.operators.chords import compared
from notewright.operators.features import TRACK

# Note values by their length in beats.
RATES = [(0.125, "1/32"), (0.1875, "1/16T"), (0.25, "1/16"), (0.375, "1/8T"), (0.5, "1/8"), (0.75, "1/4T"), (1.0, "1/4")]


def inferred(spark: SparkSession) -> DataFrame:
    """(bits, chord): of every set of three pitch classes or more the template with the best coverage, a tenth off for each note outside; all
    roots, the first of equals. A table of fixed size."""
    score = F.col("common") / F.col("size").cast("double") - F.col("extra") * F.lit(0.1)
    scored = compared(spark).where(F.bit_count("bits") >= 3).withColumn("score", score)
    best = scored.groupBy("bits").agg(F.max(F.struct("score", (-F.col("order")).alias("order"), "root", "quality")).alias("b")).where("b.score > 0")
    return best.select("bits", F.struct(F.col("b.root").alias("root"), F.col("b.quality").alias("quality"), F.least(F.lit(1.0), F.col("b.score")).alias("confidence")).alias("chord"))


def rate(delta: Column) -> Column:
    out = F.lit("1/4")
    for beats, name in reversed(RATES):
        out = F.when(delta <= beats * 1.25, name).otherwise(out)
    return out


def windows(notes: DataFrame, width: float = 4.0, least: int = 4, signatures: DataFrame | None = None) -> DataFrame:
    """(song, track, window, start_beat, notes, root, quality, confidence, intervals, octaves, rate, gate, avg_duration) of windows
    counted from the track's first onset that have enough notes. With signatures a window is a bar of the song's first meter, else `width` beats."""
    first = notes.groupBy(*TRACK).agg(F.min("start_beat").alias("_t0"))
    note = F.struct("start_beat", "note_seq", "pitch")
    beats = F.col("beats_per_bar")
    placed = meter.with_first_meter(notes.join(first, TRACK), signatures, width).withColumn("window", F.floor((F.col("start_beat") - F.col("_t0")) / beats))
    grouped = placed.groupBy(*TRACK, "window").agg(
        F.count(F.lit(1)).alias("notes"),
        F.min(F.col("_t0") + F.col("window") * beats).alias("window_start"),
        F.array_sort(F.collect_list(note)).alias("s"),
        F.bit_or(F.expr("shiftleft(1, pmod(pitch, 12))")).alias("bits"),
        F.min("pitch").alias("low"),
        F.avg("duration_beats").alias("avg_duration"),
        (F.max("start_beat") - F.min("start_beat")).alias("span"),
    )
    table = F.broadcast(inferred(notes.sparkSession))
    found = grouped.where(F.col("notes") >= least).withColumn("bits", F.col("bits").cast("int")).join(table, "bits", "left").withColumn("delta", F.col("span") / (F.col("notes") - 1))
    root = F.col("chord.root")
    return found.select(
        *TRACK,
        "window",
        F.col("window_start").alias("start_beat"),
        "notes",
        "chord.root",
        "chord.quality",
        "chord.confidence",
        F.when(root.isNotNull(), F.transform("s", lambda n: F.pmod(n["pitch"] - root, F.lit(12)))).alias("intervals"),
        F.when(root.isNotNull(), F.transform("s", lambda n: F.floor(n["pitch"] / 12).cast("int") - F.floor(F.col("low") / 12).cast("int"))).alias("octaves"),
        rate(F.col("delta")).alias("rate"),
        F.when(F.col("delta") > 0, F.least(F.lit(1.0), F.col("avg_duration") / F.col("delta"))).alias("gate"),
        "avg_duration",
    )


def analysis(found: DataFrame) -> DataFrame:
    """(song, track, windows, dominant_rate, dominant_pattern, avg_gate): modes over a track's windows, the first of equals."""

    def mode(column: Column, name: str) -> DataFrame:
        rows = found.withColumn("x", column).where("x is not null").groupBy(*TRACK, "x").agg(F.count(F.lit(1)).alias("n"), F.min("window").alias("w"))
        return rows.groupBy(*TRACK).agg(F.max_by("x", F.struct("n", -F.col("w"))).alias(name))

    pattern = F.when(F.size("intervals") >= 4, F.slice("intervals", 1, 8))
    base = found.groupBy(*TRACK).agg(F.count(F.lit(1)).alias("windows"), F.coalesce(F.avg("gate"), F.lit(0.5)).alias("avg_gate"))
    return base.join(mode(F.col("rate"), "dominant_rate"), TRACK).join(mode(pattern, "dominant_pattern"), TRACK, "left")


def patterns(found: DataFrame) -> DataFrame:
    """Distinct (intervals, octaves) of up to eight notes, each at its first window."""
    cut = found.where(F.size("intervals") >= 4).select(*TRACK, "window", F.slice("intervals", 1, 8).alias("intervals"), F.slice("octaves", 1, 8).alias("octaves"), "rate", F.coalesce("gate", F.lit(0.5)).alias("gate"))
    return cut.groupBy(*TRACK, "intervals", "octaves").agg(F.min("window").alias("window"), F.min_by("rate", "window").alias("rate"), F.min_by("gate", "window").alias("gate"))


def confident_patterns(found: DataFrame, least: float = 0.5) -> DataFrame:
    """All windows with a chord of that confidence, with the track's mean gate."""
    kept = found.where((F.col("confidence") >= least) & (F.size("intervals") >= 4))
    return kept.join(analysis(found).select(*TRACK, "avg_gate"), TRACK).select(*TRACK, "window", F.slice("intervals", 1, 8).alias("intervals"), F.slice("octaves", 1, 8).alias("octaves"), "rate", "avg_gate")
