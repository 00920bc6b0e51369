"""Bars under changing meters.

A signature map (song_id, beat, bar, numerator, denominator) makes a piecewise linear clock between beats and bars: from each signature on, bars have its
length. Songs without any are in 4/4; before its first signature a song has that one's meter; of several at one bar the last counts.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from notewright.operators.asof import asof_backward
from notewright.operators.features import end_beat

#: Without signatures.
COMMON = 4.0


def bars_with_meter(bars: DataFrame, signatures: DataFrame) -> DataFrame:
    """bars (song_id, bar) with beats_per_bar and start_beat: the meter that holds at each bar, and the beats of all bars before it.

    signatures: (song_id, beat, bar, numerator, denominator); without any, 4/4.
    """
    w = W.partitionBy("song_id").orderBy("bar")
    length = F.col("numerator") * 4.0 / F.col("denominator")
    before = F.coalesce((F.col("bar") - F.lag("bar").over(w)) * F.lag(length).over(w), F.lit(0.0))
    starts = signatures.withColumn("sig_start", F.sum(before).over(w)).withColumn("sig_bar", F.col("bar"))
    out = asof_backward(bars, starts, "bar", ["song_id"], ["sig_bar", "sig_start", "numerator", "denominator"]).fillna({"sig_bar": 0, "sig_start": 0.0, "numerator": 4, "denominator": 4})
    return out.withColumn("beats_per_bar", length).withColumn("start_beat", F.col("sig_start") + (F.col("bar") - F.col("sig_bar")) * F.col("beats_per_bar")).drop("sig_bar", "sig_start")


def clock(signatures: DataFrame) -> DataFrame:
    """(song_id, sig_bar, sig_start, beats_per_bar): from which bar on a length of bars holds, and that bar's beat, all bars before it counted."""
    w = W.partitionBy("song_id").orderBy("bar")
    last = F.max_by(F.col("numerator") * 4.0 / F.col("denominator"), F.struct("beat", "numerator", "denominator"))
    known = signatures.groupBy("song_id", "bar").agg(last.alias("beats_per_bar"))
    known = known.withColumn("bar", F.when(F.row_number().over(w) == 1, 0).otherwise(F.col("bar")).cast("int"))
    before = F.coalesce((F.col("bar") - F.lag("bar").over(w)) * F.lag("beats_per_bar").over(w), F.lit(0.0))
    return known.withColumn("sig_start", F.sum(before).over(w)).select("song_id", F.col("bar").alias("sig_bar"), "sig_start", "beats_per_bar")


def first_meter(signatures: DataFrame) -> DataFrame:
    """(song_id, beats_per_bar) of each song's first meter."""
    return clock(signatures).where("sig_bar = 0").select("song_id", "beats_per_bar")


def with_first_meter(rows: DataFrame, signatures: DataFrame | None, beats_per_bar: float = COMMON) -> DataFrame:
    """rows with beats_per_bar: of the song's first meter; without signatures the one given."""
    if signatures is None:
        return rows.withColumn("beats_per_bar", F.lit(beats_per_bar))
    return rows.join(first_meter(signatures), "song_id", "left").fillna({"beats_per_bar": COMMON})


def at_bar(rows: DataFrame, signatures: DataFrame, bar: str, compat: bool = True) -> DataFrame:
    """rows with beats_per_bar, the length that holds at a bar, and bar_beat, where that bar starts: its number times that length, or
    with compat=False after the beats of all bars before it."""
    # a song's signatures are few beside what they are looked up for, so they come along as a list: nothing is sorted by bar
    known = clock(signatures).groupBy("song_id").agg(F.array_sort(F.collect_list(F.struct("sig_bar", "sig_start", "beats_per_bar"))).alias("_clock"))
    held = F.filter("_clock", lambda c: c["sig_bar"] <= F.col(bar))
    out = rows.join(known, "song_id", "left").withColumn("_held", F.get(held, F.size(held) - 1))
    out = out.select(*rows.columns, *[F.col(f"_held.{c}").alias(c) for c in ("sig_bar", "sig_start", "beats_per_bar")]).fillna({"sig_bar": 0, "sig_start": 0.0, "beats_per_bar": COMMON})
    start = F.col(bar) * F.col("beats_per_bar") if compat else F.col("sig_start") + (F.col(bar) - F.col("sig_bar")) * F.col("beats_per_bar")
    return out.withColumn("bar_beat", start).drop("sig_bar", "sig_start")


def at_beat(rows: DataFrame, signatures: DataFrame, beat: str) -> DataFrame:
    """rows with the beats_per_bar that hold at a beat, its bar and its place inside the bar, all bars before it counted."""
    held = clock(signatures).withColumn(beat, F.col("sig_start"))
    out = asof_backward(rows, held, beat, ["song_id"], ["sig_bar", "sig_start", "beats_per_bar"]).fillna({"sig_bar": 0, "sig_start": 0.0, "beats_per_bar": COMMON})
    since = F.col(beat) - F.col("sig_start")
    whole = F.floor(since / F.col("beats_per_bar"))
    return out.withColumns({"bar": (F.col("sig_bar") + whole).cast("int"), "inside": since - whole * F.col("beats_per_bar")}).drop("sig_bar", "sig_start")


def _bar_of(beat: Column) -> Column:
    return F.floor(beat / F.col("beats_per_bar")).cast("int")


def song_length(notes: DataFrame, signatures: DataFrame, compat: bool = True) -> DataFrame:
    """(song_id, bars): up to the bar in which the last note ends, all of them of the first meter's length or, with compat=False, each of its own."""
    ends = notes.groupBy("song_id").agg(F.max(end_beat()).alias("end"))
    if compat:
        return with_first_meter(ends, signatures).select("song_id", (_bar_of(F.col("end")) + 1).alias("bars"))
    return at_beat(ends, signatures, "end").select("song_id", (F.col("bar") + 1).alias("bars"))


def in_bars(notes: DataFrame, signatures: DataFrame, compat: bool = True) -> DataFrame:
    """notes with beats_per_bar, bar and inside, their place in the bar. With compat once for each length of bar in the song, as if all
    bars had it: what starts at a bar of that length is counted with it. With compat=False once, in the bar that holds them."""
    if not compat:
        return at_beat(notes, signatures, "start_beat")
    lengths = clock(signatures).groupBy("song_id").agg(F.array_sort(F.collect_set("beats_per_bar")).alias("lengths"))
    each = notes.join(lengths, "song_id", "left").withColumn("beats_per_bar", F.explode(F.coalesce("lengths", F.array(F.lit(COMMON))))).drop("lengths")
    return each.withColumn("bar", _bar_of(F.col("start_beat"))).withColumn("inside", F.col("start_beat") - F.col("bar") * F.col("beats_per_bar"))
