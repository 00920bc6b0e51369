"""Chords in sliding windows, progressions and their numerals."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from notewright.operators.asof import buckets
from notewright.operators.features import end_beat
from notewright.operators.keys import names

# Qualities in order, with the semitones above the root.
TEMPLATES = {
    "major": [0, 4, 7],
    "minor": [0, 3, 7],
    "dim": [0, 3, 6],
    "aug": [0, 4, 8],
    "7": [0, 4, 7, 10],
    "maj7": [0, 4, 7, 11],
    "m7": [0, 3, 7, 10],
    "dim7": [0, 3, 6, 9],
    "m7b5": [0, 3, 6, 10],
    "sus2": [0, 2, 7],
    "sus4": [0, 5, 7],
    "5": [0, 7],
}
# Numerals of scale degrees, and progressions known by name.
NUMERALS_MAJOR = ["I", "bII", "II", "bIII", "III", "IV", "#IV", "V", "bVI", "VI", "bVII", "VII"]
NUMERALS_MINOR = ["i", "bII", "ii", "bIII", "III", "iv", "#iv", "v", "bVI", "VI", "bVII", "VII"]
PROGRESSIONS = {
    "I-IV-V-I": ["I", "IV", "V", "I"],
    "I-V-vi-IV": ["I", "V", "vi", "IV"],
    "ii-V-I": ["ii", "V", "I"],
    "I-vi-IV-V": ["I", "vi", "IV", "V"],
    "I-IV-vi-V": ["I", "IV", "vi", "V"],
    "vi-IV-I-V": ["vi", "IV", "I", "V"],
    "I-V-IV": ["I", "V", "IV"],
    "12-bar blues": ["I", "I", "I", "I", "IV", "IV", "I", "I", "V", "IV", "I", "V"],
    "Andalusian cadence": ["i", "VII", "VI", "V"],
    "Circle of fifths": ["I", "IV", "vii°", "iii", "vi", "ii", "V", "I"],
}
MINOR_FAMILY = ["minor", "m7", "dim", "dim7", "m7b5"]
SUFFIXES = {"dim": "°", "aug": "+"} | {q: q for q in ("7", "maj7", "m7", "dim7", "m7b5")}


def windows(notes: DataFrame, by: list[str], width: float = 2.0, hop: float = 1.0) -> DataFrame:
    """(by, window, start_beat, end_beat, pc, weight, low): the beats that each pitch class sounds in each window it overlaps, and
    its lowest pitch. A note meets only the windows it overlaps: an exploded sequence, no range join."""
    first = notes.groupBy(*by).agg(F.min("start_beat").alias("_t0"), F.max(end_beat()).alias("_t1"))
    spread = notes.join(first, by).withColumn("window", F.explode(buckets(F.col("start_beat"), end_beat(), F.col("_t0"), hop, width)))
    begin = F.col("_t0") + F.col("window") * hop
    held = spread.withColumns({"_a": begin, "_b": begin + width}).where("_a < _t1")
    overlap = F.least(end_beat(), F.col("_b")) - F.greatest("start_beat", "_a")
    return held.groupBy(*by, "window", F.col("_a").alias("w0"), F.col("_b").alias("w1"), F.pmod("pitch", F.lit(12)).alias("pc")).agg(F.sum(overlap).alias("weight"), F.min("pitch").alias("low")).select(*by, "window", F.col("w0").alias("start_beat"), F.col("w1").alias("end_beat"), "pc", "weight", "low")


def _mask(template: list[int]) -> int:
    return sum(1 << k for k in template)


def compared(spark: SparkSession) -> DataFrame:
    """Every set of pitch classes (bits, one each) with every template on every root: (bits, order, root, quality, present: whether the root
    is in the set, common: notes of the template that are there, extra: others, size: of the template). 4095 sets, whatever the notes."""
    masks, sizes, qualities = (F.array(*map(F.lit, x)) for x in ([_mask(t) for t in TEMPLATES.values()], [len(t) for t in TEMPLATES.values()], list(TEMPLATES)))
    n = len(TEMPLATES)
    sets = spark.range(1, 4096).select(F.col("id").cast("int").alias("bits"), F.explode(F.sequence(F.lit(0), F.lit(11))).alias("root"))
    down, up = F.call_function("shiftright", "bits", "root"), F.call_function("shiftleft", "bits", 12 - F.col("root"))
    turned = sets.select("bits", "root", down.bitwiseOR(up).bitwiseAND(4095).alias("turned"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k"))
    k, common = F.col("k"), F.bit_count(F.col("turned").bitwiseAND(F.get(masks, F.col("k"))))
    return turned.select("bits", (F.col("root") * n + k).alias("order"), "root", F.get(qualities, k).alias("quality"), (F.col("turned").bitwiseAND(1) == 1).alias("present"), common.alias("common"), (F.bit_count("bits") - common).alias("extra"), F.get(sizes, k).alias("size"))


def matches(spark: SparkSession) -> DataFrame:
    """(bits, found): for every set of pitch classes what can be its chord: array of struct (base, order, root, quality, late).

    Of each root that is present the best template with a score above zero, the first of equals, and apart from it the power chord.
    base: (notes that are there, less half of those beside the template, less three tenths of those missing) by the template's size.
    late: a power chord before which another template, by root and place in the list, has scored."""
    base = (F.col("common") - F.col("extra") * F.lit(0.5) - (F.col("size") - F.col("common")) * F.lit(0.3)) / F.col("size").cast("double")
    scored = compared(spark).where("present").withColumn("base", base).where("base > 0").withColumn("first", F.min("order").over(W.partitionBy("bits")))
    power = F.col("quality") == "5"
    one = F.struct("base", (-F.col("order")).alias("order"), "root", "quality", (power & (F.col("order") > F.col("first"))).alias("late"))
    return scored.groupBy("bits", "root", power.alias("power")).agg(F.max(one).alias("x")).groupBy("bits").agg(F.collect_list("x").alias("found"))


def match_chord(grouped: DataFrame) -> DataFrame:
    """grouped (bits, weights, ...) with the best template over the pitch classes that are present, c: struct (root, quality, confidence).

    A root's weight adds to its scores. Roots ascend and templates keep their order; the first of equal scores wins. A power chord counts
    four fifths once anything before it has scored. The table of matches has a fixed size, so it is broadcast."""
    table = matches(grouped.sparkSession).select(F.col("bits").alias("_bits"), "found")

    def weighed(c: Column) -> Column:
        score = c["base"] * (1.0 + F.get("weights", c["root"]) * 0.1)
        return F.struct(F.when(c["late"], score * F.lit(0.8)).otherwise(score).alias("score"), c["order"].alias("order"), c["root"].alias("root"), c["quality"].alias("quality"))

    out = grouped.join(F.broadcast(table), F.col("bits") == F.col("_bits"), "left").withColumn("_best", F.array_max(F.transform("found", weighed)))
    none = F.struct(F.lit(0).alias("root"), F.lit("?").alias("quality"), F.lit(0.0).alias("confidence"))
    best = F.struct(F.col("_best.root").alias("root"), F.col("_best.quality").alias("quality"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_best.score"))).alias("confidence"))
    return out.withColumn("c", F.when(F.col("_best").isNull(), none).otherwise(best)).drop("_bits", "found", "_best")


def song_notes(notes: DataFrame, roles: DataFrame, combine: bool = True, drums: bool = False) -> DataFrame:
    """The notes that a song's chords are taken from: of all tracks but drums (by role), or with combine=False of the first such track."""
    tracks = notes.select("song_id", "track_id").distinct()
    if not drums:
        tracks = tracks.join(roles.where("primary_role = 'drums'").select("song_id", "track_id"), ["song_id", "track_id"], "left_anti")
    if not combine:
        tracks = tracks.groupBy("song_id").agg(F.min("track_id").alias("track_id"))
    return notes.join(tracks, ["song_id", "track_id"], "left_semi")


def detect_chords(notes: DataFrame, by: list[str], width: float = 2.0, hop: float = 1.0, least: int = 2, inversions: bool = True) -> DataFrame:
    """(by, window, start_beat, end_beat, root, quality, bass, confidence) of every window with enough pitch classes."""
    weights = F.array(*[F.coalesce(F.sum(F.when(F.col("pc") == k, F.col("weight"))), F.lit(0.0)) for k in range(12)])
    grouped = windows(notes, by, width, hop).groupBy(*by, "window", "start_beat", "end_beat").agg(F.sum(F.expr("shiftleft(1, pc)")).cast("int").alias("bits"), weights.alias("weights"), F.count(F.lit(1)).alias("pcs"), F.pmod(F.min("low"), F.lit(12)).alias("low_pc"))
    out = match_chord(grouped.where(F.col("pcs") >= least))
    bass = F.when(F.col("low_pc") != F.col("c.root"), F.col("low_pc")) if inversions else F.lit(None).cast("int")
    return out.select(*by, "window", "start_beat", "end_beat", "c.root", "c.quality", bass.alias("bass"), "c.confidence")


def chord_name(root: Column, quality: Column, bass: Column) -> Column:
    shown = F.when(quality == "major", "").when(quality == "minor", "m").otherwise(quality)
    return F.concat(F.get(names(), root), shown, F.when(bass.isNotNull(), F.concat(F.lit("/"), F.get(names(), bass))).otherwise(""))


def smooth(chords: DataFrame, by: list[str], least: float = 1.0) -> DataFrame:
    """Chords of (by) joined where neighbours agree in root and quality. One that stays below `least` beats, and is neither the first nor the
    last, falls to the one before it. (by, position, start_beat, end_beat, root, quality, bass, confidence), the first window's where joined."""
    w = W.partitionBy(*by).orderBy("window")
    new = F.coalesce((F.col("root") != F.lag("root").over(w)) | (F.col("quality") != F.lag("quality").over(w)), F.lit(True))
    numbered = chords.withColumn("run", F.sum(new.cast("int")).over(w))
    first = F.struct("start_beat", "root", "quality", "bass", "confidence")
    runs = numbered.groupBy(*by, "run").agg(F.min_by(first, "window").alias("x"), F.max_by("end_beat", "window").alias("end_beat"))
    along = W.partitionBy(*by).orderBy("run")
    stays = (F.col("run") == 1) | F.lead("run").over(along).isNull() | (F.col("end_beat") - F.col("x.start_beat") >= least)
    held = runs.withColumn("stays", stays).withColumn("position", F.sum(F.col("stays").cast("int")).over(along).cast("int") - 1)
    out = held.groupBy(*by, "position").agg(F.min_by("x", "run").alias("x"), F.max_by("end_beat", "run").alias("end_beat"))
    return out.select(*by, "position", "x.start_beat", "end_beat", "x.root", "x.quality", "x.bass", "x.confidence")


def roman_numeral(root: Column, quality: Column, key_root: Column, mode: Column) -> Column:
    major, minor = (F.array(*map(F.lit, t)) for t in (NUMERALS_MAJOR, NUMERALS_MINOR))
    degree = F.pmod(root - key_root, F.lit(12))
    base = F.when(mode == "major", F.get(major, degree)).otherwise(F.get(minor, degree))
    cased = F.when(quality.isin(*MINOR_FAMILY), F.lower(base)).otherwise(F.upper(base))
    suffix = F.lit("")
    for q, s in SUFFIXES.items():
        suffix = F.when(quality == q, s).otherwise(suffix)
    return F.concat(cased, suffix)


def simplified(chords: DataFrame, by: list[str], order: str = "position") -> DataFrame:
    """(by, names): chord names without repeats of the one before."""
    w = W.partitionBy(*by).orderBy(order)
    named = chords.withColumn("name", chord_name(F.col("root"), F.col("quality"), F.col("bass")))
    kept = named.withColumn("before", F.lag("name").over(w)).where("before is null or before <> name")
    return kept.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, "name"))), lambda x: x["name"]).alias("names"))


def _mismatches(numerals: Column, pattern: list[str]) -> Callable[[Column], Column]:
    """How many numerals from a place on differ from the pattern."""
    return lambda i: sum((F.when(F.get(numerals, i + k) != x, 1).otherwise(0) for k, x in enumerate(pattern)), F.lit(0))


def match_progression(numerals: DataFrame, by: list[str], tolerance: int = 0) -> DataFrame:
    """numerals (by, numerals array) -> with `progression`, the first known one that stands anywhere in it."""
    col, found = F.col("numerals"), F.lit(None).cast("string")
    for name, pattern in reversed(PROGRESSIONS.items()):
        starts = F.sequence(F.lit(0), F.greatest(F.size(col) - len(pattern), F.lit(0)))
        hit = (F.size(col) >= len(pattern)) & (F.array_min(F.transform(starts, _mismatches(col, pattern))) <= tolerance)
        found = F.when(hit, name).otherwise(found)
    return numerals.withColumn("progression", found)
