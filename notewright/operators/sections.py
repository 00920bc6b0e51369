"""Song sections: features of bars, novelty between them, boundaries, forms and hints at their function."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from notewright.operators import meter
from notewright.operators.features import TRACK, end_beat

#: The order in which a bar's vector has the roles, and that breaks ties (the last only where none is likely).
ROLES = ["bass", "drums", "lead", "pad", "arp", "chords", "other"]
LEAST_BARS, STRICT, FORMS = 4, 1.5, 8


def section_role() -> Column:
    """The likeliest role if its probability is over .3."""
    most = F.greatest(*ROLES[:-1])
    out = F.lit("other")
    for r in reversed(ROLES[:-1]):
        out = F.when(F.col(r) == most, r).otherwise(out)
    return F.when(most > 0.3, out).otherwise("other")


def bar_features(notes: DataFrame, roles: DataFrame, beats_per_bar: float = 4.0, signatures: DataFrame | None = None) -> DataFrame:
    """A row for each bar of each song, silent ones too: counts, density by role, harmonic rhythm, velocity, pitches. All bars of a song
    are as long as its first meter, if signatures are given."""
    if signatures is not None:
        return _metered_bars(notes, roles, signatures)
    bars = notes.groupBy("song_id").agg(F.ceil(F.max(end_beat()) / beats_per_bar).cast("int").alias("n"))
    every = bars.where("n > 0").select("song_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("bar"))
    role = roles.select(*TRACK, section_role().alias("role"), (F.col("bass") > 0.5).alias("is_bass"))
    placed = notes.join(role, TRACK, "left").fillna({"role": "other", "is_bass": False}).withColumn("bar", F.floor(F.col("start_beat") / beats_per_bar).cast("int"))
    return _counted(every, placed, F.lit(beats_per_bar))


def _metered_bars(notes: DataFrame, roles: DataFrame, signatures: DataFrame) -> DataFrame:
    ends = meter.with_first_meter(notes.groupBy("song_id").agg(F.max(end_beat()).alias("end")), signatures)
    bars = ends.select("song_id", "beats_per_bar", F.ceil(F.col("end") / F.col("beats_per_bar")).cast("int").alias("n")).where("n > 0")
    every = bars.select("song_id", F.col("beats_per_bar").alias("bar_beats"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("bar"))
    role = roles.select(*TRACK, section_role().alias("role"), (F.col("bass") > 0.5).alias("is_bass"))
    placed = meter.with_first_meter(notes, signatures).join(role, TRACK, "left").fillna({"role": "other", "is_bass": False}).withColumn("bar", F.floor(F.col("start_beat") / F.col("beats_per_bar")).cast("int"))
    return _counted(every, placed, F.first("beats_per_bar"), F.col("bar_beats")).withColumnRenamed("bar_beats", "beats_per_bar")


def _counted(every: DataFrame, placed: DataFrame, beats: Column, bar_beats: Column | None = None) -> DataFrame:
    """Of every (song_id, bar) the features of the notes placed there; beats: a bar's length, as an aggregate, bar_beats: as a column of every."""
    pc = F.pmod("pitch", F.lit(12))
    before = F.lag(pc).over(W.partitionBy("song_id", "bar").orderBy("start_beat", "track_id", "note_seq"))
    changes = placed.where("is_bass").withColumn("change", (pc != before).cast("int")).groupBy("song_id", "bar").agg(F.coalesce(F.sum("change"), F.lit(0)).cast("int").alias("harmonic_rhythm"))
    counts = placed.groupBy("song_id", "bar").agg(
        F.count_distinct("track_id").cast("int").alias("active_tracks"),
        F.count(F.lit(1)).cast("int").alias("note_count"),
        F.avg("velocity").alias("avg_velocity"),
        (F.max("pitch") - F.min("pitch")).alias("pitch_range"),
        F.count_distinct("pitch").cast("int").alias("unique_pitches"),
        *[(F.count_if(F.col("role") == r) / beats).alias(f"density_{r}") for r in ROLES],
    )
    out = every.join(counts, ["song_id", "bar"], "left").join(changes, ["song_id", "bar"], "left")
    return out.fillna(0).withColumn("start_beat", F.col("bar") * (beats if bar_beats is None else bar_beats))


def vector() -> Column:
    """The 13 numbers of a bar, each scaled to about one, in single precision."""
    parts = [F.col("active_tracks") / 16.0, F.col("note_count") / 100.0, *[F.col(f"density_{r}") for r in ROLES], F.col("harmonic_rhythm") / 4.0, F.col("avg_velocity") / 127.0, F.col("pitch_range") / 88.0, F.col("unique_pitches") / 12.0]
    return F.array(*[p.cast("float") for p in parts])


def novelty(bars: DataFrame) -> DataFrame:
    """bars with the distance of each from the one before it, 0 for the first."""
    v = bars.withColumn("v", vector()).withColumn("u", F.lag("v").over(W.partitionBy("song_id").orderBy("bar")))
    distance = F.sqrt(F.aggregate(F.zip_with("v", "u", lambda a, b: (a - b).cast("double")), F.lit(0.0), lambda s, x: s + x * x))
    return v.withColumn("novelty", F.when(F.col("u").isNull(), 0.0).otherwise(distance)).drop("u", "v")


def boundaries(found: DataFrame, least: int = LEAST_BARS, strict: float = STRICT) -> DataFrame:
    """(song_id, total_bars, boundaries): bar 0, and each local peak above the threshold at least `least` bars after the last taken."""
    after = F.col("bar") > 0
    limits = found.groupBy("song_id").agg((F.avg(F.when(after, F.col("novelty"))) + strict * F.stddev_pop(F.when(after, F.col("novelty")))).alias("limit"), F.count(F.lit(1)).cast("int").alias("total_bars"))
    w = W.partitionBy("song_id").orderBy("bar")
    peaks = found.withColumns({"prior": F.lag("novelty").over(w), "next": F.lead("novelty").over(w)}).join(limits, "song_id")
    peak = (F.col("bar") > 0) & F.col("next").isNotNull() & (F.col("novelty") > F.col("limit")) & (F.col("novelty") >= F.col("prior")) & (F.col("novelty") >= F.col("next"))
    listed = peaks.groupBy("song_id", "total_bars").agg(F.array_sort(F.collect_list(F.when(peak, F.col("bar")))).alias("peaks"))
    chosen = F.aggregate("peaks", F.array(F.lit(0)), lambda a, b: F.when(b - F.element_at(a, -1) >= least, F.concat(a, F.array(b))).otherwise(a))
    return listed.select("song_id", "total_bars", chosen.alias("boundaries"))


def sections(bars: DataFrame, found: DataFrame, least: int = LEAST_BARS) -> DataFrame:
    """A row for each section of half the least length or more, with its bars' mean features; songs below the least length have none."""
    cuts = found.where(F.col("total_bars") >= least).select("song_id", "total_bars", "boundaries", F.posexplode("boundaries").alias("section", "start_bar"))
    cuts = cuts.withColumn("end_bar", F.coalesce(F.get("boundaries", F.col("section") + 1), F.col("total_bars"))).where(F.col("end_bar") - F.col("start_bar") >= least // 2)
    # every bar belongs to one section: the number of boundaries up to it
    joined = bars.join(found.select("song_id", "boundaries"), "song_id").withColumn("section", F.size(F.filter("boundaries", lambda b: b <= F.col("bar"))) - 1)
    whole = ["active_tracks", "note_count", "pitch_range", "unique_pitches", "harmonic_rhythm"]
    means = joined.groupBy("song_id", "section").agg(*[F.avg(c).cast("int").alias(c) for c in whole], F.avg("avg_velocity").alias("avg_velocity"), *[F.avg(f"density_{r}").alias(f"density_{r}") for r in ROLES])
    return cuts.select("song_id", "section", "start_bar", "end_bar").join(means, ["song_id", "section"])


def _once(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _gap(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")), F.lit(0.0), lambda s, x: s + x * x))


def form_letters(found: DataFrame) -> DataFrame:
    """found with form: letters by leader clustering, a fold over one song's few sections in order.

    A section joins the nearest leader, which moves a fifth of the way to it, if it is within seven tenths of the least gap between
    leaders (half, while there is only one) or there are FORMS leaders; else it is a leader itself."""
    kept = [c for c in found.columns if c != "song_id"]
    listed = found.withColumn("v", vector()).groupBy("song_id").agg(F.array_sort(F.collect_list(F.struct("section", F.struct(*kept).alias("row"), "v"))).alias("s"))

    def step(state: Column, x: Column) -> Column:
        leaders, letters, v = state["leaders"], state["letters"], x["v"]
        between = F.array_min(F.flatten(F.transform(leaders, lambda a, i: F.transform(F.slice(leaders, F.lit(1), i), lambda b: _gap(a, b)))))
        limit = F.when(F.size(leaders) > 1, between * 0.7).otherwise(0.5)

        def joined(gaps: Column) -> Column:
            near = F.array_position(gaps, F.array_min(gaps)).cast("int") - 1
            apart = (F.size(gaps) == 0) | ((F.array_min(gaps) > limit) & (F.size(gaps) < FORMS))
            moved = F.transform(leaders, lambda c, i: F.when(i == near, F.zip_with(c, v, lambda p, q: (p * F.lit(0.8).cast("float") + q * F.lit(0.2).cast("float")).cast("float"))).otherwise(c))
            return F.struct(F.when(apart, F.concat(leaders, F.array(v))).otherwise(moved).alias("leaders"), F.concat(letters, F.array(F.when(apart, F.size(gaps)).otherwise(near))).alias("letters"))

        return _once(F.transform(leaders, lambda c: _gap(c, v)), joined)

    start = F.struct(F.array().cast("array<array<float>>").alias("leaders"), F.array().cast("array<int>").alias("letters"))
    labelled = listed.withColumn("letters", F.aggregate("s", start, step)["letters"]).select("song_id", F.explode(F.zip_with("s", "letters", lambda x, k: F.struct(x["row"].alias("row"), k.alias("letter")))).alias("x"))
    return labelled.select("song_id", "x.row.*", F.chr(F.col("x.letter") + 65).alias("form"))


def hints(labelled: DataFrame) -> DataFrame:
    """labelled sections with hint and hint_confidence: what a section is likely for, from how it stands to its neighbours.

    A section much fuller than the one before it builds up; of such sections in a row every second one is where it drops, as is a fuller
    section after one that builds up."""
    w = W.partitionBy("song_id").orderBy("section")
    n, tracks = F.col("note_count"), F.col("active_tracks")
    seen = labelled.withColumns({"place": F.row_number().over(w), "of": F.count(F.lit(1)).over(W.partitionBy("song_id")), "n0": F.lag("note_count").over(w), "rises": F.coalesce((n > F.lag("note_count").over(w) * 1.3) & (tracks > F.lag("active_tracks").over(w)), F.lit(False))})
    run = F.col("place") - F.max(F.when(~F.col("rises"), F.col("place"))).over(w)
    seen = seen.withColumn("builds", F.col("rises") & (run % 2 == 1)).withColumn("after", F.coalesce(F.lag("builds").over(w), F.lit(False)))
    by_form = W.partitionBy("song_id", "form")
    seen = seen.withColumns({"often": F.count(F.lit(1)).over(by_form), "first": F.min("place").over(by_form)})
    seen = seen.withColumn("rank", F.dense_rank().over(W.partitionBy("song_id").orderBy(F.col("often").desc(), "first")))
    # What sections are for, and how sure each guess is; the first that holds counts.
    guesses = [
        ("drop", 0.7, F.col("after") & (n > F.col("n0"))),
        ("breakdown", 0.6, (n < F.col("n0") * 0.4) & (F.col("density_drums") < 0.5)),
        ("build", 0.5, F.col("builds")),
        ("outro", 0.5, (F.col("place") == F.col("of")) & (n < F.col("n0") * 0.7)),
        ("intro", 0.6, (F.col("place") == 1) & ((n < 20) | (tracks < 3))),
        ("verse", 0.4, F.col("rank") == 1),
        ("chorus", 0.4, F.col("rank") == 2),
        ("bridge", 0.3, F.lit(True)),
    ]
    of = F.coalesce(*[F.when(holds, F.struct(F.lit(name).alias("hint"), F.lit(sure).alias("sure"))) for name, sure, holds in guesses])
    return seen.withColumn("_of", of).select(*labelled.columns, "_of.hint", F.col("_of.sure").alias("hint_confidence"))


def forms(found: DataFrame) -> DataFrame:
    """(song_id, section, start_bar, end_bar, form, hint, hint_confidence)."""
    return hints(form_letters(found)).select("song_id", "section", "start_bar", "end_bar", "form", "hint", "hint_confidence")
