"""Keys from pitch-class histograms."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewright.schema import PITCH_CLASSES

# The published key profiles (major, minor), from the tonic on.
MAJOR = [6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88]
MINOR = [6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17]
FLATS = {"Db": "C#", "Eb": "D#", "Gb": "F#", "Ab": "G#", "Bb": "A#"}


def histogram(notes: DataFrame, by: list[str], weighted: bool = True) -> DataFrame:
    """(by, histogram: twelve shares of the sounding time, or of the notes)."""
    weight = F.col("duration_beats") if weighted else F.lit(1.0)
    pc = F.pmod("pitch", F.lit(12))
    sums = [F.sum(F.when(pc == k, weight).otherwise(0.0)) for k in range(12)]
    out = notes.groupBy(*by).agg(F.array(*sums).alias("sums"), F.sum(weight).alias("total"))
    return out.select(*by, F.transform("sums", lambda x: F.when(F.col("total") > 0, x / F.col("total")).otherwise(0.0)).alias("histogram"))


def _centred(values: list[float]) -> list[float]:
    mean = sum(values) / len(values)
    return [v - mean for v in values]


def correlations(histograms: DataFrame, by: list[str], compat: bool = True) -> DataFrame:
    """(by, root, mode, correlation), 24 rows each, by Pearson's r with each rotated profile.

    compat rotates so that a tonic t is named (12 - t) mod 12; compat=False names the tonic itself.
    """
    mean = F.aggregate("histogram", F.lit(0.0), lambda a, x: a + x) / 12
    centred = histograms.withColumn("_mean", mean).withColumn("_h", F.transform("histogram", lambda x: x - F.col("_mean"))).withColumn("_size", F.aggregate("_h", F.lit(0.0), lambda a, x: a + x * x))
    rotated = []
    for mode, profile in (("major", MAJOR), ("minor", MINOR)):
        p = _centred(profile)
        for root in range(12):
            shift = root if compat else -root
            turned = F.array(*[F.lit(p[(k + shift) % 12]) for k in range(12)])
            rotated.append(F.struct(F.lit(root).alias("root"), F.lit(mode).alias("mode"), F.lit(sum(x * x for x in p)).alias("size"), turned.alias("profile")))
    met = centred.select(*by, "_h", "_size", F.explode(F.array(*rotated)).alias("k"))
    dot = F.aggregate(F.zip_with("_h", "k.profile", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    square = F.col("_size") * F.col("k.size")
    return met.select(*by, "k.root", "k.mode", F.when(square == 0, 0.0).otherwise(dot / F.sqrt(square)).alias("correlation"))


def best_key(correlated: DataFrame, by: list[str]) -> DataFrame:
    """(by, root, mode, correlation, confidence, name): the largest correlation, the first of equals by root, then major."""
    order = F.col("root") * 2 + F.when(F.col("mode") == "minor", 1).otherwise(0)
    ranked = correlated.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.round("correlation", 9).alias("r"), (-order).alias("o"), "root", "mode", "correlation")), False).alias("c"))
    best, second = F.get("c", F.lit(0)), F.get("c", F.lit(1))["correlation"]
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (best["correlation"] + 1) / 2 * 0.5 + 0.5 * (best["correlation"] - second)))
    return ranked.select(*by, best["root"].alias("root"), best["mode"].alias("mode"), best["correlation"].alias("correlation"), confidence.alias("confidence")).withColumn("name", key_name(F.col("root"), F.col("mode")))


def detect_keys(notes: DataFrame, by: list[str], weighted: bool = True, compat: bool = True) -> DataFrame:
    return best_key(correlations(histogram(notes, by, weighted), by, compat), by)


def song_keys(notes: DataFrame, roles: DataFrame | None = None, compat: bool = True) -> DataFrame:
    """Keys of songs from all tracks but drums: those likely so by role, or mostly on channel 9."""
    channel = notes.groupBy("song_id", "track_id", "channel").agg(F.count(F.lit(1)).alias("n"), F.min("note_seq").alias("first"))
    primary = channel.groupBy("song_id", "track_id").agg(F.max_by("channel", F.struct("n", -F.col("first"))).alias("primary_channel"))
    keep = primary.where("primary_channel <> 9")
    if roles is not None:
        keep = keep.join(roles.select("song_id", "track_id", "drums"), ["song_id", "track_id"], "left").where("drums is null or drums <= 0.5")
    return detect_keys(notes.join(keep.select("song_id", "track_id"), ["song_id", "track_id"], "left_semi"), ["song_id"], compat=compat)


def names() -> Column:
    return F.array(*map(F.lit, PITCH_CLASSES))


def key_name(root: Column, mode: Column) -> Column:
    return F.concat(F.get(names(), root), F.lit(" "), mode)


def parse_key(text: Column) -> tuple[Column, Column]:
    """(root, mode) of a name such as "Bb minor"; null for what is none."""
    note, mode = F.split(F.trim(text), r"\s+")[0], F.lower(F.get(F.split(F.trim(text), r"\s+"), F.lit(1)))
    for flat, sharp in FLATS.items():
        note = F.when(note == flat, sharp).otherwise(note)
    root = F.array_position(names(), note).cast("int") - 1
    good = (root >= 0) & mode.isin("major", "minor")
    return F.when(good, root), F.when(good, mode)


def relative_key(root: Column, mode: Column) -> tuple[Column, Column]:
    return F.when(mode == "major", (root + 9) % 12).otherwise((root + 3) % 12), parallel_mode(mode)


def parallel_mode(mode: Column) -> Column:
    return F.when(mode == "major", "minor").otherwise("major")
