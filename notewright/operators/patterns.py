"""Repeated patterns: exact clusters, similarity, greedy merging, and searching the pattern store.

Patterns like a target are scored in tiles of some thousand patterns and targets or more, as products of their matrices, a stripe at a time. An index of pairs goes by prefixes: with the steps of a grid ordered from rare to common, two grids whose Jaccard index is j or more share one of the first
n - ceil(j n) + 1 of n steps. A pair is met at the first step that both prefixes hold, so it is met once.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from notewright.operators import grams
from notewright.operators.features import TRACK
from notewright.operators.targets import against
from notewright.shared import cut

RHYTHM, PITCH = 0.9, 0.85
#: Steps that a grid may have: their frequencies go to the driver. Patterns that one deal of the index holds.
MOST_STEPS, DEAL = 16_384, 1_000_000
#: Patterns and targets of a tile, while there are few; parts and blocks that they are dealt out in at most, while a tile's rows have no more than HELD steps and pitch classes.
TILE, MOST_DEALT, HELD = (4096, 2048), (64, 4), 1 << 22
#: Rows of either side that are multiplied at once; pairs that leave a tile at once.
STRIPE, BATCH = 512, 1 << 16
GROUP = [*TRACK, "chunk_size"]


def exact_clusters(prints: DataFrame) -> DataFrame:
    """(song, track, chunk_size, pattern_id, occurrences, first_bar, bar_positions): chunks with one fingerprint."""
    out = prints.groupBy(*GROUP, "pattern_id").agg(F.count(F.lit(1)).alias("occurrences"), F.min("start_bar").alias("first_bar"), F.sort_array(F.collect_list("start_bar")).alias("bar_positions"))
    return out.withColumn("confidence", F.lit(1.0))


def repeated(clusters: DataFrame, least: int = 2) -> DataFrame:
    return clusters.where(F.col("occurrences") >= least)


def repetition_ratio(clusters: DataFrame) -> DataFrame:
    """(song, track, chunk_size, unique_patterns, total_chunks, repetition_ratio)."""
    return clusters.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("unique_patterns"), F.sum("occurrences").alias("total_chunks"), (F.sum(F.col("occurrences") - 1) / F.sum("occurrences")).alias("repetition_ratio"))


def rhythm_similarity(a: Column, b: Column) -> Column:
    """Jaccard index of the steps with an onset; two empty grids are alike."""
    both = F.aggregate(F.zip_with(a, b, lambda x, y: F.least(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0)))), F.lit(0), lambda s, x: s + x)
    either = F.aggregate(F.zip_with(a, b, lambda x, y: F.greatest(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0)))), F.lit(0), lambda s, x: s + x)
    return F.when(either == 0, 1.0).otherwise(both / either)


def jaccard(a: Column, b: Column) -> Column:
    """The same of two sets of steps."""
    both = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) + F.size(b) == 0, 1.0).otherwise(both / (F.size(a) + F.size(b) - both))


def cosine(a: Column, b: Column, empty: float = 0.0) -> Column:
    """Of two vectors; with a zero vector 0, or `empty` if both are zero."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce((x * y).cast("double"), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
    size = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when((size(a) == 0) & (size(b) == 0), empty).when((size(a) == 0) | (size(b) == 0), 0.0).otherwise(dot / (size(a) * size(b)))


def pitch_similarity(classes_a: Column, classes_b: Column, contour_a: Column, contour_b: Column) -> Column:
    """Mean of the pitch classes' cosine and the share of equal contour steps."""
    same = F.aggregate(F.zip_with(contour_a, contour_b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    contour = F.when(F.size(contour_a) != F.size(contour_b), 0.0).when(F.size(contour_a) == 0, 1.0).otherwise(same / F.size(contour_a))
    return (cosine(classes_a, classes_b) + contour) / 2


def transposition(mean_a: Column, mean_b: Column, rhythm: Column) -> Column:
    """Semitones between two patterns of one rhythm, at most an octave; half to even."""
    by = F.rint(mean_a - mean_b).cast("int")
    return F.when((rhythm >= RHYTHM) & (F.abs(by) <= 12), by)


def onsets(grid: Column) -> Column:
    """The steps of a grid that sound."""
    return F.filter(F.transform(grid, lambda x, k: F.when(x == 1, k)), lambda k: k.isNotNull())


def by_rarity(grids: DataFrame) -> Column:
    """An expression that orders the steps in column `on` from rare to common over all of grids (onset_grid). A grid's length bounds what comes to the driver."""
    counted = grids.select(F.explode(onsets(F.col("onset_grid"))).alias("step")).groupBy("step").count().orderBy("count", "step").limit(MOST_STEPS + 1).collect()
    if len(counted) > MOST_STEPS:
        raise ValueError(f"grids of over {MOST_STEPS} steps")
    place = {r.step: n for n, r in enumerate(counted)}
    ranks = F.array(*[F.lit(place.get(k, len(place))) for k in range(max(place, default=0) + 1)])
    return F.transform(F.array_sort(F.transform("on", lambda k: F.struct(F.get(ranks, k).alias("rank"), k.alias("step")))), lambda x: x["step"])


def prefix(steps: Column, jaccard: float) -> Column:
    """Of ordered steps those of which sets that are so similar share one; an empty set has the step -1."""
    n = F.size(steps)
    # a hair below, as the index is compared in doubles
    most = n - F.ceil(n * F.lit(jaccard) - 1e-9).cast("int") + 1
    return F.when(n > 0, F.slice(steps, F.lit(1), F.least(n, most))).otherwise(F.array(F.lit(-1)))


def similar_pairs(prints: DataFrame, least: float = 0.001) -> DataFrame:
    """Pairs of distinct patterns of one song, track and size whose similarity is `least` or more; without the rhythm threshold it is zero.

    Distinct patterns are put in order by track once; a track's meet in stripes of the products of their matrices, so only pairs that reach the rhythm
    threshold become rows, with the bars (bar_a, bar_b) where their patterns come first. least must be above zero, as others are left out.
    """
    if least <= 0:
        raise ValueError("pairs of similarity zero are not met")
    shown = F.struct(onsets(F.col("onset_grid")).alias("on"), "pitch_classes", "contour", "mean_pitch", F.col("start_bar").alias("bar"))
    one = prints.select(*GROUP, "pattern_id", "start_bar", shown.alias("shown")).groupBy(*GROUP, "pattern_id").agg(F.min_by("shown", "start_bar").alias("shown"))
    one = one.select(*GROUP, "pattern_id", "shown.*")
    kinds = {f.name: f.dataType.simpleString() for f in one.schema}
    group = ", ".join(f"{c} {kinds[c]}" for c in GROUP)
    out = one.groupBy(*TRACK).applyInArrow(rhythmic, f"{group}, pattern_a string, mean_a double, bar_a {kinds['bar']}, pattern_b string, mean_b double, bar_b {kinds['bar']}, rhythm double, pitch double")
    out = out.withColumn("similarity", (F.col("rhythm") + F.col("pitch")) / 2).withColumn("transposition", transposition(F.col("mean_a"), F.col("mean_b"), F.col("rhythm")))
    # pitches never take away, so all that reach the rhythm threshold reach half of it
    out = out.where(F.col("similarity") >= least) if least > RHYTHM / 2 else out
    return out.select(*GROUP, "pattern_a", "pattern_b", "rhythm", "pitch", "bar_a", "bar_b", "similarity", "transposition")


def rhythmic(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of a track's distinct patterns of one size that reach the rhythm threshold, with rhythm and pitch as rhythm_similarity and pitch_similarity give them."""
    table = pa.Table.from_batches(batches).sort_by([("chunk_size", "ascending"), ("pattern_id", "ascending")]).combine_chunks()
    first, second = table.select([*GROUP, "pattern_id", "mean_pitch", "bar"]), table.select(["pattern_id", "mean_pitch", "bar"])
    size = table["chunk_size"].to_numpy()
    cuts = [0, *(np.flatnonzero(size[1:] != size[:-1]) + 1).tolist(), len(size)]
    found, many = [], 0

    def rows() -> pa.RecordBatch:
        i, j, rhythm, pitch = (np.concatenate(x) for x in zip(*found, strict=True))
        columns = [*first.take(pa.array(i)).columns, *second.take(pa.array(j)).columns, pa.array(rhythm), pa.array(pitch)]
        names = [*GROUP, "pattern_a", "mean_a", "bar_a", "pattern_b", "mean_b", "bar_b", "rhythm", "pitch"]
        return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], names)

    for low, high in zip(cuts, cuts[1:], strict=False):
        stripes = range(low, high, STRIPE)
        steps = 1 + int(table["on"].slice(low, high - low).combine_chunks().flatten().to_numpy().max(initial=0))
        for a in stripes:
            p = table.slice(a, min(STRIPE, high - a))
            for b in stripes[(a - low) // STRIPE :]:
                q = table.slice(b, min(STRIPE, high - b)) if b != a else p
                on = [dense(t["on"], steps, True, np.float32) for t in ((p, q) if b != a else (p,))]
                n = [x.sum(axis=1) for x in on]
                both = on[0] @ on[-1].T
                either = n[0][:, None] + n[-1][None] - both
                with np.errstate(divide="ignore", invalid="ignore"):
                    rhythm = np.where(either == 0, 1.0, both.astype(np.float64) / either)
                alike = rhythm >= RHYTHM
                i, j = np.nonzero(np.triu(alike, 1) if b == a else alike)
                for k in range(0, len(i), 1 << 14):
                    x, y = i[k : k + (1 << 14)], j[k : k + (1 << 14)]
                    found.append((a + x, b + y, rhythm[x, y], pitches(p, q, x, y)))
                    many += len(x)
                    if many >= 1 << 16:
                        yield rows()
                        found, many = [], 0
    if many:
        yield rows()


def pitches(p: pa.Table, q: pa.Table, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """pitch_similarity of rows i of p with rows j of q (pitch_classes, contour)."""
    long = [t["contour"].combine_chunks().value_lengths().to_numpy() for t in (p, q)]
    wide, classes = (max(int(t[c].combine_chunks().value_lengths().to_numpy().max(initial=0)) for t in (p, q)) for c in ("contour", "pitch_classes"))
    c, v = ([dense(t[name], width, False, kind) for t in (p, q)] for name, width, kind in (("contour", wide, np.int8), ("pitch_classes", classes, np.float64)))
    n, m = long[0][i], long[1][j]
    # what is beyond both contours is equal, too
    same = (c[0][i] == c[1][j]).sum(axis=1) - (wide - n)
    size = [np.sqrt((x * x).sum(axis=1)) for x in v]
    product = size[0][i] * size[1][j]
    with np.errstate(divide="ignore", invalid="ignore"):
        contour = np.where(n != m, 0.0, np.where(n == 0, 1.0, same / n))
        cosine = np.where(product == 0, 0.0, (v[0][i] * v[1][j]).sum(axis=1) / product)
    return (cosine + contour) / 2


def followers(edges: DataFrame, by: list[str]) -> DataFrame:
    """edges (by, p, q; p stands before q) -> (by, q) of the nodes that are no leaders, a leader being a node that has no leader before it among its neighbours.

    In rounds: a node before which no open neighbour is left leads, and whoever stands after it follows; both leave. A round is a few joins by node,
    whatever the size of a group, and there are as many as the longest chain of nodes that wait for one another.
    """
    key = [*by, "q"]
    open_, found = cut(edges.select(*by, "p", "q").distinct()), None
    while not open_.isEmpty():
        waiting = open_.select(*by, F.col("q").alias("p")).distinct()
        gone = cut(open_.join(waiting, [*by, "p"], "left_anti").select(*key).distinct())
        found = gone if found is None else found.union(gone)
        open_ = cut(open_.join(gone, key, "left_anti").join(gone.withColumnRenamed("q", "p"), [*by, "p"], "left_anti"))
    return found if found is not None else open_.select(*key)


def merge_similar(clusters: DataFrame, pairs: DataFrame) -> DataFrame:
    """Greedy merging: clusters in the order they appear; each not yet taken takes all later ones similar enough to it.

    (song, track, chunk_size, leader, canonical, merged, occurrences, confidence.) Who takes and who is taken follows from rounds over the graph of
    similar pairs; a taken cluster goes to its first taker.
    """
    enough = min(RHYTHM, PITCH)
    rows = clusters.select(*GROUP, "pattern_id", "occurrences", "first_bar")
    place = lambda c: rows.select(*GROUP, F.col("pattern_id").alias(f"pattern_{c}"), F.col("first_bar").alias(f"bar_{c}"))
    near = pairs.where(F.col("similarity") >= enough).select(*GROUP, "pattern_a", "pattern_b", *[c for c in ("bar_a", "bar_b") if c in pairs.columns])
    for c in "ab":
        near = near if f"bar_{c}" in near.columns else near.join(place(c), [*GROUP, f"pattern_{c}"])
    ordered = F.col("bar_a") < F.col("bar_b")
    edges = cut(near.select(*GROUP, F.when(ordered, F.col("pattern_a")).otherwise(F.col("pattern_b")).alias("p"), F.when(ordered, F.col("pattern_b")).otherwise(F.col("pattern_a")).alias("q"), F.least("bar_a", "bar_b").alias("bar")))
    taken = followers(edges, GROUP)
    takers = edges.join(taken.withColumnRenamed("q", "p"), [*GROUP, "p"], "left_anti").groupBy(*GROUP, F.col("q").alias("pattern_id")).agg(F.min_by("p", "bar").alias("leader"))
    led = rows.join(takers, [*GROUP, "pattern_id"], "left").withColumn("leader", F.coalesce("leader", "pattern_id"))
    out = led.groupBy(*GROUP, "leader").agg(F.max_by("pattern_id", F.struct("occurrences", -F.col("first_bar"))).alias("canonical"), F.count(F.lit(1)).alias("merged"), F.sum("occurrences").alias("occurrences"))
    return out.withColumn("confidence", 1.0 / F.col("merged"))


def store(prints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(patterns, instances) of the whole collection: a row for each distinct pattern, and one for each place it stands in."""
    instances = prints.where("note_count > 0").select("pattern_id", *TRACK, "chunk_size", "start_bar", "num_bars")
    patterns = prints.where("note_count > 0").groupBy("pattern_id", "rhythm_hash", "pitch_hash", "num_bars").agg(
        F.count(F.lit(1)).alias("occurrences"), F.count_distinct("song_id").alias("songs"), F.max("note_count").alias("note_count"), F.max("range_semitones").alias("range_semitones"), F.min("onset_grid").alias("onset_grid"), F.min("pitch_classes").alias("pitch_classes")
    )
    return patterns, instances


def search(patterns: DataFrame, instances: DataFrame | None = None, songs: DataFrame | None = None, roles: DataFrame | None = None, *, rhythm_hash: str | None = None, pitch_hash: str | None = None, bars: int | None = None, least: int | None = None, most: int | None = None, track: int | None = None, artist: str | None = None, genre: str | None = None, tags: list[str] | None = None, role: str | None = None, order: str = "occurrences", ascending: bool = False, offset: int = 0, limit: int | None = None, artists: DataFrame | None = None) -> DataFrame:
    """Patterns that meet every criterion given; those on songs and tracks by semi-joins, so nothing is counted twice.

    artists: an index of the songs' artists (grams.postings by song_id), if there is one. songs: (song_id, artist, genres, tags); one tag of those asked is enough. roles: (song_id, track_id, primary_role). Criteria on songs
    and tracks must hold for one and the same instance."""
    out = patterns
    for column, value in (("rhythm_hash", rhythm_hash), ("pitch_hash", pitch_hash), ("num_bars", bars)):
        if value is not None:
            out = out.where(F.col(column) == value)
    if least is not None:
        out = out.where(F.col("occurrences") >= least)
    if most is not None:
        out = out.where(F.col("occurrences") <= most)
    placed = instances
    if track is not None:
        placed = placed.where(F.col("track_id") == track)
    if artist is not None:
        holds = lambda rows: rows.where(F.col("artist").ilike(f"%{artist}%"))
        placed = placed.join(holds(songs) if artists is None else grams.search(songs, artists, "song_id", artist, holds), "song_id", "left_semi")
    if genre is not None:
        placed = placed.join(songs.where(F.exists("genres", lambda g: g.ilike(f"%{genre}%"))), "song_id", "left_semi")
    if tags:
        placed = placed.join(songs.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags)))), "song_id", "left_semi")
    if role is not None:
        placed = placed.join(roles.where(F.col("primary_role") == role), TRACK, "left_semi")
    if placed is not instances:
        out = out.join(placed, "pattern_id", "left_semi")
    if limit is not None:
        out = out.orderBy(F.col(order).asc() if ascending else F.col(order).desc(), "pattern_id", "num_bars").offset(offset).limit(limit)
    return out


def page(found: DataFrame, offset: int = 0, limit: int = 50) -> tuple[DataFrame, int, bool]:
    """(a page of what `search` found, the number of all, whether there are more), of one job: the rows are counted as they pass to the
    page's top. The page itself, `limit` rows, comes to the driver."""
    seen = Observation()
    counted = found.observe(seen, F.count(F.lit(1)).alias("total"))
    rows = counted.orderBy(F.col("occurrences").desc(), "pattern_id", "num_bars").offset(offset).limit(limit).collect()
    total = seen.get["total"] or 0
    return found.sparkSession.createDataFrame(rows, found.schema), total, offset + limit < total


def described(found: DataFrame, instances: DataFrame, songs: DataFrame, most: int = 10) -> DataFrame:
    """found with the first `most` songs it stands in, by id, and their artists and genres."""
    of = instances.join(found.select("pattern_id").distinct(), "pattern_id", "left_semi").select("pattern_id", "song_id").distinct()
    place = F.row_number().over(W.partitionBy("pattern_id").orderBy("song_id"))
    first = of.withColumn("_n", place).where(F.col("_n") <= most).join(songs.select("song_id", "artist", "genres"), "song_id", "left")
    listed = first.groupBy("pattern_id").agg(F.array_sort(F.collect_set("song_id")).alias("song_ids"), F.array_sort(F.collect_set(F.nullif("artist", F.lit("")))).alias("artists"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("genres", F.array()))))).alias("genres"))
    return found.join(listed, "pattern_id", "left")


def find_similar(patterns: DataFrame, target: DataFrame, least: float = 0.8, rows: int | None = None, same_length: bool = False) -> DataFrame:
    """(target, pattern_id, num_bars, similarity): patterns of any length, or of the target's, by the mean of their onsets' Jaccard index and
    their pitch classes' cosine; two empty vectors are alike. Targets are any rows of patterns.

    The cosine is at most 1, so the Jaccard index is 2 * least - 1 or more: targets meet the patterns whose numbers of steps allow that, in tiles. A least of a half or
    less says nothing of steps; then targets, of at most `rows` rows if that is given, meet every pattern."""
    t = target.select(F.col("pattern_id").alias("target"), F.col("num_bars").alias("_bars"), onsets(F.col("onset_grid")).alias("_g"), F.col("pitch_classes").alias("_p"))
    whole = patterns.select("pattern_id", "num_bars", onsets(F.col("onset_grid")).alias("_on"), "pitch_classes")
    if least > 0.5:
        return tiled(whole, t, least, same_length)
    other = F.col("pattern_id") != F.col("target")
    score = (jaccard(F.col("_on"), F.col("_g")) + cosine(F.col("pitch_classes"), F.col("_p"), 1.0)) / 2
    met = against(whole, t, other & (F.col("num_bars") == F.col("_bars")) if same_length else other, rows)
    return met.withColumn("similarity", score).where(F.col("similarity") >= least).select("target", "pattern_id", "num_bars", "similarity")


def tiled(whole: DataFrame, t: DataFrame, least: float, same_length: bool = False) -> DataFrame:
    """find_similar for a least above a half: whole (pattern_id, num_bars, _on, pitch_classes) and t (target, _bars, _g, _p) in tiles.

    Patterns are put in classes by their number of steps, dealt out in parts; targets in blocks go to the parts of the classes that can be close enough. A part goes to
    every block and a block to every part, so their numbers stay the same until a tile's rows would take too much memory: what is exchanged grows with the rows, not
    with the pairs. A tile is one row, whose pairs come out in stripes."""
    close = 2 * least - 1
    whole, t = whole.dropna(subset=["pattern_id", "_on", "pitch_classes"]), t.dropna(subset=["target", "_g", "_p"])
    parts, blocks = (dealt_in(*of) for of in zip((whole, t), (("_on", "pitch_classes"), ("_g", "_p")), TILE, MOST_DEALT, strict=True))
    # of close numbers each is a class of its own
    grade = (lambda n: n) if close > 0.95 else (lambda n: F.floor(F.log(n.cast("double")) / math.log(1 / close)).cast("int"))
    kind = lambda n: F.when(n > 0, grade(n)).otherwise(-1)
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    m = F.size("_g")
    low, high = F.ceil(m * F.lit(close) - 1e-9).cast("int"), F.floor(m / F.lit(close) + 1e-9).cast("int")
    own = whole.withColumns({"kind": kind(F.size("_on")), "part": dealt("pattern_id", parts)}).withColumn("block", every(blocks))
    asked = t.withColumn("kind", F.explode(F.sequence(kind(low), kind(high)))).withColumn("block", dealt("target", blocks)).withColumn("part", every(parts))
    key = ["kind", "part", "block"]
    # pairs are many times the rows they come from, whose size is no reason to put partitions together
    spread = lambda df: df.repartition(parts * blocks, *key).groupBy(*key)
    tiles = spread(own).cogroup(spread(asked)).applyInArrow(together, "patterns binary, targets binary, weights array<int>")
    return tiles.mapInArrow(lambda batches: scored(batches, least, same_length), f"target string, pattern_id string, num_bars {whole.schema['num_bars'].dataType.simpleString()}, similarity double")


def dealt_in(rows: DataFrame, lists: tuple[str, ...], size: int, most: int) -> int:
    """The number of parts of `size` rows, but `most` at most while a part's lists have no more than HELD values."""
    seen = rows.agg(F.count(F.lit(1)).alias("rows"), F.sum(sum(F.size(c).cast("long") for c in lists)).alias("values")).first()
    return max(1, min(-(-seen["rows"] // size), most), -(-(seen["values"] or 0) // HELD))


def together(p: pa.Table, q: pa.Table) -> pa.Table:
    """A tile as one row: its patterns and targets, and how many steps each of their columns stands for. Steps that sound in the same rows are one column."""
    if not p.num_rows or not q.num_rows:
        return pa.table({"patterns": pa.array([], pa.binary()), "targets": pa.array([], pa.binary()), "weights": pa.array([], pa.list_(pa.int32()))})
    lists = [t[c].combine_chunks() for t, c in ((p, "_on"), (q, "_g"))]
    long = [x.value_lengths().to_numpy() for x in lists]
    steps = np.concatenate([x.flatten().to_numpy() for x in lists])
    row = np.repeat(np.arange(p.num_rows + q.num_rows, dtype=np.int32), np.concatenate(long))
    order = np.argsort(steps, kind="stable")
    cuts = np.flatnonzero(np.diff(steps[order])) + 1
    rows_of, column, weights = {}, np.full(int(steps.max(initial=0)) + 1, -1, np.int32), []
    for at, rows in zip(np.r_[0, cuts], np.split(row[order], cuts), strict=True) if len(steps) else ():
        n = rows_of.setdefault(rows.tobytes(), len(rows_of))
        if n == len(weights):
            weights.append(0)
            column[steps[order[at]]] = n
        weights[n] += 1
    # of each column one step stays
    out, at = [], 0
    for t, name, n, others in ((p, "_on", long[0], ("pattern_id", "num_bars", "pitch_classes")), (q, "_g", long[1], ("target", "_bars", "_p"))):
        mine = column[steps[at : at + n.sum()]]
        at += int(n.sum())
        left = np.r_[0, np.cumsum(mine >= 0)][np.r_[0, np.cumsum(n)]].astype(np.int32)
        side, sink = t.select(others).append_column(name, pa.ListArray.from_arrays(pa.array(left), pa.array(mine[mine >= 0]))), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, side.schema) as stream:
            stream.write_table(side)
        out.append(pa.array([sink.getvalue().to_pybytes()], pa.binary()))
    return pa.table({"patterns": out[0], "targets": out[1], "weights": pa.array([weights], pa.list_(pa.int32()))})


def scored(batches: Iterator[pa.RecordBatch], least: float, same_length: bool) -> Iterator[pa.RecordBatch]:
    """The pairs of tiles."""
    for batch in batches:
        for k in range(batch.num_rows):
            p, q = (pa.ipc.open_stream(batch[c][k].as_buffer()).read_all() for c in ("patterns", "targets"))
            yield from tile(p, q, np.asarray(batch["weights"][k].values, np.float32), least, same_length)


def dense(lists: pa.ChunkedArray, width: int, ones: bool, kind: type) -> np.ndarray:
    """A row for each list: ones where it says, or its values."""
    flat = lists.combine_chunks()
    n = flat.value_lengths().to_numpy().astype(np.int64)
    row, values = np.repeat(np.arange(len(n)), n), flat.flatten().to_numpy()
    out = np.zeros((len(n), width), kind)
    out[row, values if ones else np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)] = 1 if ones else values
    return out


def tile(p: pa.Table, q: pa.Table, weights: np.ndarray, least: float, same_length: bool) -> Iterator[pa.RecordBatch]:
    """The pairs of a tile that are similar enough, some BATCH at a time. Counts are whole numbers, so products are exact and the score is that of single pairs: pairs
    are sifted in single precision, with a margin beyond its error, and those that are left are scored in double precision."""
    name = {c: t[c].combine_chunks() for t, c in ((p, "pattern_id"), (p, "num_bars"), (q, "target"), (q, "_bars"))}
    codes = pa.concat_arrays([name["pattern_id"], name["target"]]).dictionary_encode().indices.to_numpy()
    ids, targets = codes[: p.num_rows], codes[p.num_rows :]
    bars, long = (name[c].to_numpy(zero_copy_only=False) for c in ("num_bars", "_bars"))
    lists = [t[c].combine_chunks() for t, c in ((p, "pitch_classes"), (q, "_p"))]
    classes = max(int(x.value_lengths().to_numpy().max()) for x in lists)
    values = np.concatenate([x.flatten().to_numpy() for x in lists]).astype(np.float64)
    whole = bool((values == np.rint(values)).all()) and classes * float(np.square(values).max(initial=0)) < 1 << 24
    kind = np.float32 if whole else np.float64
    bound, columns, each = 2 * least - 1e-5 - 1e-6 * classes, len(weights), np.r_[weights, np.float32(1)]

    def side(rows: pa.Table, on: str, pc: str) -> tuple[np.ndarray, ...]:
        # what is empty has a step, or a pitch class, that only other empty ones have
        x, v = dense(rows[on], columns, True, np.float32), dense(rows[pc], classes, False, np.float64)
        square = (v * v).sum(axis=1)
        x, v = (np.c_[y, none.astype(y.dtype)] for y, none in ((x, ~x.any(axis=1)), (v, square == 0)))
        size = np.sqrt(np.where(square == 0, 1.0, square))
        return x, x @ each, v.astype(kind), size, (1 / size).astype(kind)

    def striped(rows: pa.Table, on: str, pc: str) -> Iterator[tuple]:
        for a in range(0, rows.num_rows, STRIPE):
            yield a, *side(rows.slice(a, STRIPE), on, pc)

    def rows() -> pa.RecordBatch:
        i, j, score = (np.concatenate(x) for x in zip(*found, strict=True))
        i, j = pa.array(i), pa.array(j)
        return pa.RecordBatch.from_arrays([name["target"].take(j), name["pattern_id"].take(i), name["num_bars"].take(i), pa.array(score)], ["target", "pattern_id", "num_bars", "similarity"])

    found, many = [], 0
    theirs = list(striped(q, "_g", "_p")) if q.num_rows * (columns + 2 * classes) <= 1 << 23 else None
    for a, on, n, pc, size, part in striped(p, "_on", "pitch_classes"):
        heavy, n = on * each, n[:, None]
        for b, g, m, v, length, of in theirs or striped(q, "_g", "_p"):
            both, dot = heavy @ g.T, pc @ v.T
            either = n + m[None]
            either -= both
            near = both / either
            sized = dot * part[:, None]
            sized *= of[None]
            near += sized
            k = np.flatnonzero(near >= bound)
            i, j = np.divmod(k, len(g))
            score = (both.ravel()[k].astype(np.float64) / either.ravel()[k] + dot.ravel()[k].astype(np.float64) / (size[i] * length[j])) / 2
            i, j = a + i, b + j
            keep = (score >= least) & (ids[i] != targets[j])
            if same_length:
                keep &= bars[i] == long[j]
            if keep.any():
                found.append((i[keep], j[keep], score[keep]))
                many += len(found[-1][0])
            if many >= BATCH:
                yield rows()
                found, many = [], 0
    if many:
        yield rows()


def candidates(patterns: DataFrame, target: DataFrame, least: float) -> DataFrame:
    """(target, pattern_id, num_bars): the pairs whose onsets may have that Jaccard index, each once; for few targets on grids that differ. Where most grids share their steps, tiles are faster.

    Postings of a pattern: the steps of its prefix, each with its number of steps. A target asks for its own prefix at every number of steps that is close enough,
    and a pair stays if the steps behind the first common one can make up the overlap. Patterns are dealt out in parts of DEAL, so a common step is not one task.
    """
    order = by_rarity(patterns)
    parts = max(1, -(-patterns.count() // DEAL))

    def posted(rows: DataFrame, *names: Column) -> DataFrame:
        out = rows.withColumn("on", onsets(F.col("onset_grid"))).withColumn("on", order)
        out = out.select(*names, F.size("on").alias("n"), prefix(F.col("on"), least).alias("first"))
        return out.select("*", F.posexplode("first").alias("at", "step"))

    own = posted(patterns, "pattern_id", "num_bars").withColumn("part", F.pmod(F.xxhash64("pattern_id"), F.lit(parts)))
    asked = posted(target, F.col("pattern_id").alias("target")).withColumnsRenamed({"n": "m", "first": "asked", "at": "place"})
    sizes = F.sequence(F.ceil(F.col("m") * F.lit(least) - 1e-9).cast("int"), F.floor(F.col("m") / F.lit(least) + 1e-9).cast("int"))
    asked = asked.withColumn("n", F.explode(sizes)).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    met = own.join(asked, ["step", "n", "part"])
    once = F.get(F.array_intersect("first", "asked"), F.lit(0)) == F.col("step")
    overlap = F.least(F.col("n") - F.col("at"), F.col("m") - F.col("place"))
    able = (F.col("n") == 0) | (overlap >= (F.col("n") + F.col("m")) * F.lit(least / (1 + least)) - 1e-9)
    return met.where(once & able).select("target", "pattern_id", "num_bars")
