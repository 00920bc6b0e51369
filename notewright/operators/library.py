"""The clip library: one clip for each track of each song, with its song's metadata, role, features and genres."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from notewright.operators import grams
from notewright.operators.features import TRACK
from notewright.operators.targets import against


@dataclass
class ClipQuery:
    """What a clip must meet; what is None is not asked."""

    role: str | None = None
    genre: str | None = None
    artist: str | None = None
    song_id: int | None = None
    min_notes: int | None = None
    max_notes: int | None = None
    min_bars: int | None = None
    max_bars: int | None = None
    tags: list[str] | None = None
    limit: int | None = None
    offset: int = 0


def clips(features: DataFrame, roles: DataFrame, bars: DataFrame, songs: DataFrame) -> DataFrame:
    """(clip_id, song_id, track_id, role, note_count, bars, density, avg_velocity, pitch_range, artist, title, genres, tags).

    songs: (song_id, artist, title, genres array, tags array).
    """
    base = features.join(roles.select(*TRACK, F.col("primary_role").alias("role")), TRACK).join(bars.withColumnRenamed("total_bars", "bars"), "song_id")
    out = base.join(songs, "song_id", "left")
    return out.select(F.concat_ws("_", "song_id", "track_id").alias("clip_id"), *TRACK, "role", "note_count", "bars", F.col("note_density").alias("density"), "avg_velocity", "avg_duration", "pitch_range", "artist", "title", "genres", "tags")


def find(table: DataFrame, q: ClipQuery) -> DataFrame:
    """Clips that meet all that is asked; a page of them by note count, then id, if a limit is given."""
    c = F.col
    asked: list[Column | None] = [
        c("role") == q.role if q.role else None,
        F.array_contains("genres", q.genre) if q.genre else None,
        c("artist").ilike(f"%{q.artist}%") if q.artist else None,
        c("song_id") == q.song_id if q.song_id is not None else None,
        c("note_count") >= q.min_notes if q.min_notes is not None else None,
        c("note_count") <= q.max_notes if q.max_notes is not None else None,
        c("bars") >= q.min_bars if q.min_bars is not None else None,
        c("bars") <= q.max_bars if q.max_bars is not None else None,
        F.arrays_overlap("tags", F.array(*map(F.lit, q.tags))) if q.tags else None,
    ]
    for condition in asked:
        if condition is not None:
            table = table.where(condition)
    return table if q.limit is None else table.orderBy(c("note_count").desc(), "clip_id").offset(q.offset).limit(q.limit)


def find_indexed(table: DataFrame, q: ClipQuery, index: DataFrame) -> DataFrame:
    """What `find` gives, by an index of artists (grams.postings by clip_id)."""
    return grams.search(table, index, "clip_id", q.artist or "", lambda rows: find(rows, q))


def stats(table: DataFrame) -> DataFrame:
    return table.agg(F.count(F.lit(1)).alias("clips"), F.count_distinct("song_id").alias("songs"), F.count_distinct(F.nullif("artist", F.lit(""))).alias("artists"))


def genre_counts(table: DataFrame) -> DataFrame:
    return table.select(F.explode("genres").alias("genre")).groupBy("genre").count().withColumnRenamed("count", "clips")


def artists(table: DataFrame) -> DataFrame:
    return table.where("artist <> ''").select("artist").distinct()


def upsert(table: DataFrame, new: DataFrame, key: str = "clip_id") -> DataFrame:
    """table with the rows of new in place of those of the same key."""
    return table.join(new, key, "left_anti").unionByName(new)


def update(table: DataFrame, which: Column, **values: Column) -> DataFrame:
    return table.withColumns({c: F.when(which, v).otherwise(F.col(c)) for c, v in values.items()})


def delete(table: DataFrame, which: Column) -> DataFrame:
    return table.where(~F.coalesce(which, F.lit(False)))


def add_genres(table: DataFrame, found: DataFrame) -> DataFrame:
    """table with the genres of found (artist, genres) after its own, in order and once each."""
    more = found.select(F.col("artist").alias("_a"), F.col("genres").alias("_g"))
    return table.join(more, F.col("artist") == F.col("_a"), "left").withColumn("genres", F.array_distinct(F.concat(F.coalesce("genres", F.array()), F.coalesce("_g", F.array())))).drop("_a", "_g")


def song_browser(table: DataFrame) -> DataFrame:
    """(song_id, clip_id of the fullest track, tracks, shown): one row a song."""
    top = table.groupBy("song_id").agg(F.max_by("clip_id", F.struct("note_count", -F.col("track_id"))).alias("clip_id"), F.count(F.lit(1)).alias("tracks"), F.first("title").alias("title"))
    return top.select("song_id", "clip_id", "tracks", F.coalesce("title", F.concat(F.lit("song "), F.col("song_id").cast("string"))).alias("shown"))


def filter_text(table: DataFrame, text: str) -> DataFrame:
    """Case-insensitive substring of artist, title or any genre."""
    low = text.lower()
    return table.where(F.contains(F.lower(F.concat_ws("\n", "artist", "title", F.array_join("genres", "\n"))), F.lit(low)))


def browser_text() -> Column:
    """What `filter_text` looks into."""
    return F.concat_ws("\n", "artist", "title", F.array_join("genres", "\n"))


def filter_indexed(table: DataFrame, text: str, index: DataFrame) -> DataFrame:
    """What `filter_text` gives, by an index of `browser_text` (grams.postings by clip_id). % and _ stand for themselves."""
    return grams.search(table, index, "clip_id", text, lambda rows: filter_text(rows, text))


def songs_per_artist(table: DataFrame) -> DataFrame:
    return table.groupBy(F.coalesce(F.nullif("artist", F.lit("")), F.lit("Unknown")).alias("artist")).agg(F.count_distinct("song_id").alias("songs"))


def similar_tracks(table: DataFrame, targets: DataFrame, least: float = 0.5, limit: int | None = None, same_role: bool = False) -> DataFrame:
    """(target, clip_id, similarity): clips of other songs that are like one of a stated set of targets in density, pitch range, velocity and
    duration; the best `limit` of each target, if given. What is zero on either side is left out, and the rest shares its weight; a range of
    zero counts as one."""
    parts = {"density": 0.3, "pitch_range": 0.2, "avg_velocity": 0.2, "avg_duration": 0.3}
    value = lambda c: F.greatest(c, F.lit(1)).alias(c) if c == "pitch_range" else F.col(c)
    t = targets.select("clip_id", "song_id", "role", *map(value, parts)).toDF("target", "_song", "_role", *[f"_{c}" for c in parts])
    rows = table.select("clip_id", "song_id", "role", *map(value, parts))
    other = F.col("song_id") != F.col("_song")
    met = against(rows, t, other & (F.col("role") == F.col("_role")) if same_role else other)
    both = {c: (F.col(c) > 0) & (F.col(f"_{c}") > 0) for c in parts}
    weights = sum((F.when(both[c], w).otherwise(0.0) for c, w in parts.items()), F.lit(0.0))
    ratios = sum((F.when(both[c], F.least(c, f"_{c}") / F.greatest(c, f"_{c}") * w).otherwise(0.0) for c, w in parts.items()), F.lit(0.0))
    found = met.withColumn("similarity", F.when(weights > 0, ratios / weights).otherwise(0.0)).where(F.col("similarity") > least).select("target", "clip_id", "similarity")
    if limit is None:
        return found
    rank = F.row_number().over(W.partitionBy("target").orderBy(F.round("similarity", 9).desc(), "clip_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= limit).drop("rank")
