"""Ticks and beats, quantising, places in bars, and swing."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from notewright.operators.asof import asof_backward


def tick_to_beat(tick: Column, ppq: Column | int) -> Column:
    return tick / ppq


def beat_to_tick(beat: Column, ppq: Column | int) -> Column:
    """Rounds half to even."""
    return F.rint(beat * ppq).cast("int")


def quantize_beat(beat: Column, grid: int = 16, beats_per_bar: Column | float = 4.0) -> Column:
    """To the nearest of `grid` steps a bar, half to even."""
    step = _step(grid, beats_per_bar)
    return F.rint(beat / step) * step


def quantize_duration(duration: Column, grid: int = 16, beats_per_bar: Column | float = 4.0, least: float = 0.0) -> Column:
    step = _step(grid, beats_per_bar)
    return F.greatest(F.lit(least) if least else step, F.greatest(F.lit(1.0), F.rint(duration / step)) * step)


def _step(grid: int, beats_per_bar: Column | float) -> Column:
    return (F.lit(beats_per_bar) if isinstance(beats_per_bar, (int, float)) else beats_per_bar) / F.lit(float(grid))


def with_meter(notes: DataFrame, signatures: DataFrame) -> DataFrame:
    """notes with the signature that holds at their start: numerator, denominator, beats_per_bar, bar, beat_in_bar.

    signatures: (song_id, beat, bar, numerator, denominator); without any, 4/4 from the start.
    """
    sig = signatures.withColumnRenamed("beat", "start_beat").withColumn("sig_beat", F.col("start_beat")).withColumnRenamed("bar", "sig_bar")
    out = asof_backward(notes, sig, "start_beat", ["song_id"], ["sig_beat", "sig_bar", "numerator", "denominator"])
    out = out.fillna({"sig_beat": 0.0, "sig_bar": 0, "numerator": 4, "denominator": 4})
    out = out.withColumn("beats_per_bar", F.col("numerator") * 4.0 / F.col("denominator"))
    since = F.col("start_beat") - F.col("sig_beat")
    whole = F.floor(since / F.col("beats_per_bar"))
    return out.withColumns({"bar": (F.col("sig_bar") + whole).cast("int"), "beat_in_bar": since - whole * F.col("beats_per_bar")}).drop("sig_beat", "sig_bar")


def with_tempo(notes: DataFrame, tempos: DataFrame) -> DataFrame:
    """notes with the tempo at their start; before the first tempo the first, without any 120."""
    first = tempos.groupBy("song_id").agg(F.min_by("bpm", "beat").alias("first_bpm"))
    out = asof_backward(notes, tempos.withColumnRenamed("beat", "start_beat"), "start_beat", ["song_id"], ["bpm"])
    return out.join(first, "song_id", "left").withColumn("bpm", F.coalesce("bpm", "first_bpm", F.lit(120.0))).drop("first_bpm")


def timing_context(notes: DataFrame, tempos: DataFrame, signatures: DataFrame, ppq: int = 480) -> DataFrame:
    """Tick, tempo, meter and place in the bar of every note."""
    out = with_tempo(with_meter(notes, signatures), tempos)
    return out.withColumn("tick", beat_to_tick(F.col("start_beat"), ppq))


def quantize_notes(notes: DataFrame, signatures: DataFrame, grid: int = 16) -> DataFrame:
    """notes with quantized_start and quantized_duration under the signature that holds."""
    bpb = F.col("beats_per_bar")
    return with_meter(notes, signatures).withColumns({"quantized_start": quantize_beat(F.col("start_beat"), grid, bpb), "quantized_duration": quantize_duration(F.col("duration_beats"), grid, bpb)})


def swing(notes: DataFrame, by: list[str], beats_per_bar: float = 4.0) -> DataFrame:
    """(by, ratio, samples, confidence, style) from the gaps between a note near a beat and the next one."""
    order = W.partitionBy(*by).orderBy("start_beat", "track_id", "note_seq") if "track_id" not in by else W.partitionBy(*by).orderBy("start_beat", "note_seq")
    gap = F.lead("start_beat").over(order) - F.col("start_beat")
    near = F.pmod("start_beat", F.lit(1.0))
    slack = 0.3 * beats_per_bar / 8
    close = F.least(near, 1.0 - near) < slack
    gaps = notes.withColumn("gap", gap).withColumn("sample", F.when(close & (F.col("gap") >= 0.3) & (F.col("gap") <= 0.8), F.col("gap")))
    out = gaps.groupBy(*by).agg(F.count(F.lit(1)).alias("notes"), F.count("sample").alias("n"), F.avg("sample").alias("mean"), F.stddev_pop("sample").alias("spread"))
    enough = (F.col("notes") >= 4) & (F.col("n") >= 3)
    ratio = F.when(enough, F.col("mean")).otherwise(0.5)
    return out.select(
        *by,
        ratio.alias("ratio"),
        F.when(F.col("notes") >= 4, F.col("n")).otherwise(0).alias("samples"),
        F.when(enough, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - 5.0 * F.col("spread")))).otherwise(0.0).alias("confidence"),
        F.when(ratio < 0.52, "straight").when(ratio < 0.58, "light").when(ratio < 0.64, "medium").otherwise("heavy").alias("style"),
    )
