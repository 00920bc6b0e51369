"""Tumbling chunks of bars, and their rhythm and pitch fingerprints.

Bars have one length, or that of the signatures given: the chunk that starts at a bar has its meter, and lies at that bar's number times the meter's beats; with
compat=False each bar has its own length, and lies after all bars before it.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from notewright.operators import meter
from notewright.operators.features import TRACK, end_beat

SIZES = (1, 2, 4, 8, 16)
CHUNK = [*TRACK, "chunk_size", "start_bar"]


def song_length(notes: DataFrame, beats_per_bar: float = 4.0) -> DataFrame:
    return notes.groupBy("song_id").agg((F.floor(F.max(end_beat()) / beats_per_bar) + 1).cast("int").alias("bars"))


def chunks(notes: DataFrame, sizes: tuple[int, ...] = SIZES, beats_per_bar: float = 4.0, signatures: DataFrame | None = None, compat: bool = True) -> DataFrame:
    """Every chunk of every track and size, empty ones too; the last may be short. (song, track, chunk_size, start_bar, end_bar,
    num_bars, start_beat, end_beat, note_count), and with signatures beats_per_bar."""
    if signatures is not None:
        out = _metered(notes, sizes, signatures, compat, 16).withColumn("note_count", (F.get("upto", F.col("end_bar") - F.col("first")) - F.get("upto", F.col("start_bar") - F.col("first"))).cast("long"))
        return out.select(*CHUNK, "end_bar", (F.col("end_bar") - F.col("start_bar")).alias("num_bars"), "start_beat", "end_beat", "note_count", "beats_per_bar")
    out = _spans(notes, sizes, song_length(notes, beats_per_bar)).withColumns({"start_beat": F.col("start_bar") * beats_per_bar, "end_beat": F.col("end_bar") * beats_per_bar})
    counts = placed(notes, sizes, beats_per_bar).groupBy(*CHUNK).agg(F.count(F.lit(1)).alias("note_count"))
    out = out.join(counts, CHUNK, "left").fillna({"note_count": 0})
    return out.select(*CHUNK, "end_bar", (F.col("end_bar") - F.col("start_bar")).alias("num_bars"), "start_beat", "end_beat", "note_count")


def _spans(notes: DataFrame, sizes: tuple[int, ...], lengths: DataFrame) -> DataFrame:
    """(song, track, chunk_size, start_bar, end_bar) of all chunks of all tracks."""
    tracks = notes.select(*TRACK).distinct().join(lengths, "song_id")
    size = F.explode(F.array(*map(F.lit, sizes)))
    spans = tracks.select(*TRACK, "bars", size.alias("chunk_size")).select(*TRACK, "bars", "chunk_size", F.explode(F.sequence(F.lit(0), F.col("bars") - 1, F.col("chunk_size"))).alias("start_bar"))
    return spans.select(*CHUNK, F.least(F.col("start_bar") + F.col("chunk_size"), F.col("bars")).alias("end_bar"))


def _metered_spans(notes: DataFrame, sizes: tuple[int, ...], signatures: DataFrame, compat: bool) -> DataFrame:
    """The same with beats_per_bar, start_beat and end_beat."""
    spans = meter.at_bar(_spans(notes, sizes, meter.song_length(notes, signatures, compat)), signatures, "start_bar", compat).withColumnRenamed("bar_beat", "start_beat")
    if compat:
        return spans.withColumn("end_beat", F.col("end_bar") * F.col("beats_per_bar"))
    ends = meter.at_bar(spans.withColumnRenamed("beats_per_bar", "first_beats"), signatures, "end_bar", False)
    return ends.drop("beats_per_bar").withColumnsRenamed({"first_beats": "beats_per_bar", "bar_beat": "end_beat"})


def placed(notes: DataFrame, sizes: tuple[int, ...] = SIZES, beats_per_bar: float = 4.0) -> DataFrame:
    """notes once for each size, with the chunk that their onset lies in and their start in it."""
    bar = F.floor(F.col("start_beat") / beats_per_bar).cast("int")
    out = notes.withColumn("chunk_size", F.explode(F.array(*map(F.lit, sizes))))
    return out.withColumn("start_bar", bar - bar % F.col("chunk_size")).withColumn("local_start", F.col("start_beat") - F.col("start_bar") * beats_per_bar)


def hash16(text: Column) -> Column:
    return F.substring(F.md5(text.cast("binary")), 1, 16)


def _families(sizes: tuple[int, ...]) -> list[list[int]]:
    """The sizes, put together with the largest that they divide."""
    out: list[list[int]] = []
    for size in sorted(set(sizes), reverse=True):
        for family in out:
            if family[0] % size == 0:
                family.append(size)
                break
        else:
            out.append([size])
    return out


def _blocks(rows: DataFrame, by: list[str], most: int, grid: int) -> DataFrame:
    """rows (bar, inside, beats_per_bar, bars: how many the song has) -> (by, bars, first, n, upto, on, sounding, accents, pitches, between, said, ways, classes) for every
    `most` bars, also those without notes: the first bar, how many bars, how many notes lie before each of them, onsets (also as text) and accents by step,
    pitches in order, intervals (also as texts), their directions and pitch classes. So each is worked out once, and not again for each size.

    A note is in one row of one block, whatever the sizes are."""
    step = F.floor(F.col("inside") / (F.col("beats_per_bar") / grid)).cast("int")
    # a track whose notes all lie before the first bar has chunks, too
    inside = F.col("bar") >= 0
    block = F.when(inside, F.floor(F.col("bar") / most)).otherwise(-1).cast("int")
    note = F.when(inside, F.struct("bar", F.col("inside").alias("at"), "note_seq", "pitch", step.alias("step"), "velocity"))
    last = F.ceil(F.col("bars") / most).cast("int") - 1
    # a track's first note brings all of its blocks along
    w = W.partitionBy(*by).orderBy("bar")
    brought = F.when((F.row_number().over(w) == 1) & (last >= 0), F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("brought", brought).select(*by, "bars", note.alias("note"), F.posexplode(F.concat(F.array(block), "brought")).alias("pos", "block"))
    filled = rows.where(F.col("block").between(0, last)).groupBy(*by, "bars", "block").agg(F.sort_array(F.collect_list(F.when(F.col("pos") == 0, F.col("note")))).alias("notes"))
    first = F.col("block") * most
    whole = filled.select(*by, "bars", first.alias("first"), F.least(F.lit(most), F.col("bars") - first).alias("n"), "notes")
    bars = F.sequence(F.col("first"), F.col("first") + F.col("n"))
    whole = whole.withColumn("upto", F.transform(bars, lambda b: F.size(F.filter(F.col("notes.bar"), lambda x: x < b))))
    steps = F.sequence(F.lit(0), F.lit(grid - 1))
    # notes are in order, so those of a bar are neighbours
    own = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.slice("notes", F.get("upto", i) + 1, F.get("upto", i + 1) - F.get("upto", i)))
    sounds = lambda of: F.transform(steps, lambda k: F.exists(of, lambda x: x["step"] == k).cast("int"))
    loud = lambda of, k: F.coalesce(F.array_max(F.transform(F.filter(of, lambda x: x["step"] == k), lambda x: x["velocity"])) / 127.0, F.lit(0.0))
    loudest = lambda of: F.transform(steps, lambda k: F.when(F.exists(of, lambda x: x["step"] == k), loud(of, k)).otherwise(0.0))
    whole = whole.select(*by, "bars", "first", "n", "upto", F.flatten(F.transform(own, sounds)).alias("on"), F.flatten(F.transform(own, loudest)).alias("accents"), F.col("notes.pitch").alias("pitches"))
    many = F.greatest(F.size("pitches") - 1, F.lit(0))
    whole = whole.withColumn("between", F.zip_with(F.slice("pitches", 2, many), F.slice("pitches", 1, many), lambda b, a: b - a))
    texts = {to: F.transform(c, lambda x: x.cast("string")) for to, c in (("sounding", "on"), ("said", "between"))}
    signs = F.transform("between", lambda x: F.signum(x.cast("double")).cast("int"))
    return whole.withColumns({"sounding": F.array_join(texts["sounding"], ""), "said": texts["said"], "ways": signs, "classes": F.transform("pitches", lambda p: F.pmod(p, F.lit(12)))})


def _taken(grid: int) -> dict[str, Column]:
    """onset_grid, accent_grid, pitches and intervals of chunks (start_bar, end_bar) in blocks, and what hashes and counts are made of."""
    at, n = F.col("start_bar") - F.col("first"), F.col("end_bar") - F.col("start_bar")
    before = F.get("upto", at)
    out = {to: F.slice(c, at * grid + 1, n * grid) for to, c in (("onset_grid", "on"), ("accent_grid", "accents"))}
    many = F.get("upto", at + n) - before
    out |= {to: F.slice(to, before + 1, many) for to in ("pitches", "classes")}
    out |= {to: F.slice(c, before + 1, F.greatest(many - 1, F.lit(0))) for to, c in (("intervals", "between"), ("said", "said"), ("contour", "ways"))}
    return out | {"sounding": F.col("sounding").substr(at * grid + 1, n * grid)}


def _metered(notes: DataFrame, sizes: tuple[int, ...], signatures: DataFrame, compat: bool, grid: int) -> DataFrame:
    """The chunks of _metered_spans, each with the columns of the block it lies in: with compat of that whose bars all have the chunk's length."""
    known = notes.where("song_id IS NOT NULL")
    rows = meter.in_bars(known, signatures, compat).join(meter.song_length(known, signatures, compat), "song_id")
    by = [*TRACK, "beats_per_bar"] if compat else TRACK
    spans, out = _metered_spans(known, sizes, signatures, compat), None
    for family in _families(sizes):
        own = spans.where(F.col("chunk_size").isin(family)).withColumn("first", F.col("start_bar") - F.col("start_bar") % family[0])
        each = own.join(_blocks(rows, by, family[0], grid).drop("bars", "n"), [*by, "first"])
        out = each if out is None else out.unionByName(each)
    return out


def fingerprints(notes: DataFrame, sizes: tuple[int, ...] = SIZES, beats_per_bar: float = 4.0, grid: int = 16, signatures: DataFrame | None = None, compat: bool = True) -> DataFrame:
    """Rhythm, pitch and combined fingerprints of all chunks; empty chunks have empty grids of their length.

    Notes are grouped once, by as many bars as the largest size has; chunks of every size that divides it are cut out of that."""
    size = F.col("chunk_size")
    if signatures is None:
        # the song's length as a window: notes that are together by song stay so
        known = notes.where("song_id IS NOT NULL").withColumn("bars", (F.floor(F.max(end_beat()).over(W.partitionBy("song_id")) / beats_per_bar) + 1).cast("int"))
        rows = known.withColumns({"bar": F.floor(F.col("start_beat") / beats_per_bar).cast("int"), "beats_per_bar": F.lit(beats_per_bar)}).withColumn("inside", F.col("start_beat") - F.col("bar") * beats_per_bar)
        whole = None
        for family in _families(sizes):
            starts = lambda k: F.transform(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1, F.lit(k)), lambda b: F.struct(F.lit(k).alias("chunk_size"), b.alias("start_bar")))
            each = _blocks(rows, TRACK, family[0], grid).withColumn("c", F.explode(F.flatten(F.array(*map(starts, family)))))
            each = each.select("*", "c.*").withColumn("end_bar", F.least(F.col("start_bar") + size, F.col("bars")))
            each = each.select(*CHUNK, "end_bar", *[c.alias(name) for name, c in _taken(grid).items()])
            whole = each if whole is None else whole.union(each)
        whole = whole.withColumns({"start_beat": F.col("start_bar") * beats_per_bar, "end_beat": F.col("end_bar") * beats_per_bar})
        more = []
    else:
        more = ["beats_per_bar"]
        whole = _metered(notes, sizes, signatures, compat, grid)
        whole = whole.select(*CHUNK, "end_bar", "beats_per_bar", "start_beat", "end_beat", *[c.alias(name) for name, c in _taken(grid).items()])
    n = F.size("pitches")
    base = whole.select(*CHUNK, "end_bar", (F.col("end_bar") - F.col("start_bar")).alias("num_bars"), "start_beat", "end_beat", "onset_grid", "accent_grid", "pitches", *more, n.cast("long").alias("note_count"), "intervals", "contour", "classes", "sounding", "said")
    mean = F.when(n > 0, F.aggregate("pitches", F.lit(0), lambda a, x: a + x) / n).otherwise(0.0)
    out = base.withColumns(
        {
            "pitch_classes": F.array(*[n - F.size(F.array_remove("classes", F.lit(k))) for k in range(12)]),
            "range_semitones": F.when(n > 0, F.array_max("pitches") - F.array_min("pitches")).otherwise(0),
            "mean_pitch": mean,
            "rhythm_hash": hash16(F.col("sounding")),
            "pitch_hash": hash16(F.array_join("said", ",")),
            "density": F.length(F.replace("sounding", F.lit("0"), F.lit(""))) / F.size("onset_grid"),
        }
    )
    return out.drop("classes", "sounding", "said").withColumn("pattern_id", hash16(F.concat_ws(":", "rhythm_hash", "pitch_hash")))
