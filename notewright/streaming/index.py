"""The clip library from files, once and again: new and changed files are decoded, described and merged into the index."""

from collections.abc import Iterator
from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Row
from pyspark.sql import functions as F

from notewright.operators import changes, features, genres, paths, roles
from notewright.shared import cut
from notewright.sources import smf
from notewright.streaming.ingest import FILES


def canonical(spark: SparkSession, names: list[str] | None, keep_unknown: bool) -> list[str]:
    """A caller's genres by their canonical names, once each; unknown ones go, or stay as they are."""
    given = spark.createDataFrame([(k, g) for k, g in enumerate(names or [])], "place int, tag string")
    found = genres.normalize(given, genres.taxonomy(spark)).orderBy("place").collect()
    return list(dict.fromkeys(r.canonical or r.tag for r in found if r.canonical or keep_unknown))


def described(events: DataFrame, *, genres_given: list[str] | None = None, artist: str = "", title: str = "", tags: list[str] | None = None) -> DataFrame:
    """events -> one row for each track with notes: (clip_id, song_id, track_id, source_path, track_name, role, channel, note_count, duration_bars, genres,
    artist, title, tags). Artist and title are those given, else what the path says; genres that aren't known are left out."""
    spark = events.sparkSession
    notes, totals = smf.notes(events).drop("start_tick"), smf.totals(events)
    found = features.track_features(notes, lengths=totals)
    likely = roles.role_probabilities(found).select("song_id", "track_id", F.col("primary_role").alias("role"))
    told = paths.metadata(totals.select("song_id", "path", F.col("total_bars").alias("duration_bars"))).withColumnRenamed("path", "source_path")
    rows = found.select("song_id", "track_id", "note_count").join(likely, ["song_id", "track_id"]).join(smf.tracks(events), ["song_id", "track_id"], "left").join(told, "song_id")
    names = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    return rows.select(
        F.concat_ws("_", "song_id", "track_id").alias("clip_id"),
        "song_id",
        "track_id",
        "source_path",
        F.coalesce("name", F.lit("")).alias("track_name"),
        "role",
        F.col("primary_channel").alias("channel"),
        "note_count",
        "duration_bars",
        names(canonical(spark, genres_given, keep_unknown=False)).alias("genres"),
        (F.lit(artist) if artist else F.col("artist")).alias("artist"),
        (F.lit(title) if title else F.col("title")).alias("title"),
        names(tags or []).alias("tags"),
    )


def index_files(files: DataFrame, target: str, **given) -> None:
    """files (path, content, modificationTime) into the index at target: a file's clips replace those of an older version of it. Files that can't be decoded
    leave the index as it is."""
    read = cut(smf.decode_files(files.select("path", "content"))).where("kind <> 'error'")
    clean = F.regexp_replace("path", "^file:(//)?", "")
    versions = files.groupBy(smf.song_id(clean).alias("song_id")).agg(F.max("modificationTime").alias("version"))
    changes.apply(described(read, **given).join(versions, "song_id"), target, "clip_id", "version")


def index_folder(spark: SparkSession, source: str, target: str, checkpoint: str, per_batch: int = 1000, **given) -> None:
    """All new files below source into the index at target; stops when no file is left. The checkpoint holds which files are done; a batch that
    comes again changes nothing."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.{mid,midi}").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch).load(source)
    write = files.writeStream.foreachBatch(lambda batch, _: index_files(batch, target, **given))
    write.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def update_titles(clips: DataFrame) -> DataFrame:
    """clips with the titles that their paths say, found once for each path; where a path says none a clip keeps its own."""
    told = paths.metadata(clips.select(F.col("source_path").alias("_path")).distinct(), "_path").where("title <> ''").select("_path", F.col("title").alias("_title"))
    named = clips.join(told, clips["source_path"] == told["_path"], "left")
    return named.withColumn("title", F.coalesce("_title", "title")).select(*clips.columns)


def update_metadata(clips: DataFrame, which: Column, *, genres_given: list[str] | None = None, artist: str | None = None, title: str | None = None, tags: list[str] | None = None) -> DataFrame:
    """clips with what is given in place of what those that `which` names have; genres get their canonical names, and unknown ones stay."""
    new: dict[str, Column] = {}
    if genres_given is not None:
        new["genres"] = F.array(*map(F.lit, canonical(clips.sparkSession, genres_given, keep_unknown=True))).cast("array<string>")
    if tags is not None:
        new["tags"] = F.array(*map(F.lit, tags)).cast("array<string>")
    new |= {c: F.lit(v) for c, v in (("artist", artist), ("title", title)) if v is not None}
    return clips.withColumns({c: F.when(which, v).otherwise(F.col(c)) for c, v in new.items()}) if new else clips


def pages(clips: DataFrame, size: int = 100) -> Iterator[list[Row]]:
    """Clips by id, some at a time, each page by where the last one ended: none is read past, and none missed if rows come in between."""
    last = None
    while page := (clips if last is None else clips.where(F.col("clip_id") > last)).orderBy("clip_id").limit(size).collect():
        yield page
        last = page[-1].clip_id


def each(clips: DataFrame, size: int = 100) -> Iterator[Row]:
    return chain.from_iterable(pages(clips, size))
