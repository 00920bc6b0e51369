"""Queries on Standard MIDI Files: note tables written as files, and read again."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewright import shared
from notewright.plans.sql import NOTES_A, query
from notewright.operators import changes
from notewright.sources import scores, smf
from notewright.sources.notes import notes_from_events
from notewright.streaming import index

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def registered(sql: str):
    def keep(function):
        QUERIES[function.__name__] = function
        ORACLE_SQL[function.__name__] = sql
        return function

    return keep


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): a file for each song."""
    written = smf.encode_songs(notes_from_events(spark, sf_dir))
    return written.select(F.concat(F.lit("/songs/"), F.col("song_id").cast("string"), F.lit(".mid")).alias("path"), "content")


def number(path: str = "path") -> F.Column:
    return F.regexp_extract(path, r"(\d+)\.mid$", 1).cast("long")


ON_OFF = """
onoff AS (
    SELECT song_id, track_id, CAST(trunc(start_beat * 480) AS INTEGER) AS tick, 1 AS kind, pitch, velocity, note_seq FROM notes
    UNION ALL SELECT song_id, track_id, CAST(trunc((start_beat + duration_beats) * 480) AS INTEGER), 0, pitch, 0, note_seq FROM notes
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY song_id, track_id ORDER BY tick, kind, note_seq, pitch) AS position, dense_rank() OVER (PARTITION BY song_id ORDER BY track_id) AS place FROM onoff
), main_channel AS (SELECT song_id, track_id, arg_min(channel, note_seq) AS channel FROM notes GROUP BY 1, 2)"""


@registered(query(NOTES_A, ON_OFF, """paired AS (
    SELECT *, lead(kind) OVER w AS off_kind, lead(tick) OVER w AS off_tick FROM placed WINDOW w AS (PARTITION BY song_id, track_id, pitch ORDER BY position)
)""", """SELECT song_id, place AS track_id, tick / 480e0 AS start_beat, (off_tick - tick) / 480e0 AS duration_beats, pitch, velocity, channel
FROM paired JOIN main_channel USING (song_id, track_id) WHERE kind = 1 AND off_kind = 0"""))
def file_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes as they come back from files: paired by pitch and channel, in the files' tracks (the first is the conductor's)."""
    return numbered_notes(shared.cut(smf.decode_files(files(spark, sf_dir))))


def numbered_notes(events: DataFrame) -> DataFrame:
    songs = events.select("song_id", number().alias("n")).distinct()
    return smf.notes(events).join(songs, "song_id").select(F.col("n").alias("song_id"), F.col("track_id").cast("long").alias("track_id"), "start_beat", "duration_beats", "pitch", "velocity", "channel")


@registered(query(NOTES_A, ON_OFF, """ends AS (SELECT song_id, max(tick) / 480e0 AS total_beats, CAST(count(DISTINCT track_id) AS BIGINT) AS tracks FROM onoff GROUP BY 1)""", """SELECT song_id, 480 AS ppq, total_beats, CAST(floor(total_beats / 4) AS INTEGER) + 1 AS total_bars, tracks,
    (SELECT string_agg('Track ' || t, ',' ORDER BY t) FROM (SELECT DISTINCT track_id AS t FROM notes n WHERE n.song_id = ends.song_id)) AS names, 120e0 AS bpm, 4 AS numerator, 4 AS denominator FROM ends"""))
def file_songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What files say of their songs: length, tracks and their names, tempo and meter."""
    events = shared.cut(smf.decode_files(files(spark, sf_dir)))
    tracks = smf.tracks(events).groupBy("song_id").agg(F.count(F.lit(1)).alias("tracks"), F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"))
    maps = smf.tempo_map(events).select("song_id", "bpm").join(smf.signature_map(events).select("song_id", "numerator", "denominator"), "song_id")
    out = smf.totals(events).join(tracks, "song_id").join(maps, "song_id")
    return out.select(number().alias("song_id"), "ppq", "total_beats", "total_bars", "tracks", "names", "bpm", "numerator", "denominator")


@registered(query(NOTES_A, "SELECT song_id, CASE WHEN song_id % 3 = 0 THEN 1 ELSE 0 END AS bad, CASE WHEN song_id % 3 = 0 THEN 0 ELSE count(*) END AS notes_on FROM notes GROUP BY 1"))
def file_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third song's file is cut short: it gives a row with an error and nothing else."""
    given = files(spark, sf_dir)
    short = given.withColumn("content", F.when(number() % 3 == 0, F.expr("substring(content, 1, length(content) - 3)")).otherwise(F.col("content")))
    events = smf.decode_files(short)
    return events.groupBy(number().alias("song_id")).agg(F.max((F.col("kind") == "error").cast("int")).alias("bad"), F.count_if(F.col("kind") == "note_on").alias("notes_on"))


def folder(spark: SparkSession, sf_dir: str) -> str:
    """A folder of files, one for each song, below the folder that all executors share."""
    scores.register(spark)
    to = f"{shared.folder(spark)}/scores-{uuid.uuid4().hex}"
    files(spark, sf_dir).write.format("scores").mode("append").save(to)
    return to


@registered(ORACLE_SQL["file_notes"])
def source_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of a folder of files, written and read by the data source, which takes the conditions on kinds of events."""
    events = spark.read.format("scores").load(folder(spark, sf_dir)).where(F.col("kind").isin("note_on", "note_off"))
    return numbered_notes(shared.cut(events))


@registered(query(NOTES_A, ON_OFF, "SELECT song_id, place AS track_id, count(*) FILTER (kind = 1) AS ons, count(*) FILTER (kind = 0) AS offs, max(tick) AS last_tick FROM placed WHERE place = 2 GROUP BY 1, 2"))
def source_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of one track of each file, its notes: the source passes the other tracks over."""
    events = spark.read.format("scores").load(folder(spark, sf_dir)).where((F.col("track_id") == 2) & F.col("kind").isin("note_on", "note_off"))
    out = events.groupBy(number().alias("song_id"), F.col("track_id").cast("long").alias("track_id"))
    return out.agg(F.count_if(F.col("kind") == "note_on").alias("ons"), F.count_if(F.col("kind") == "note_off").alias("offs"), F.max("tick").cast("int").alias("last_tick"))


@registered(query(NOTES_A, ON_OFF, "SELECT song_id, count(*) FILTER (kind = 1) AS ons, count(*) FILTER (kind = 0) AS offs FROM onoff GROUP BY 1"))
def table_function_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of contents in a table, by the table function."""
    scores.register(spark)
    events = scores.DecodeSmf(files(spark, sf_dir).asTable())
    return events.groupBy(number().alias("song_id")).agg(F.count_if(F.col("kind") == "note_on").alias("ons"), F.count_if(F.col("kind") == "note_off").alias("offs"))


INDEXED = """
paired AS (SELECT *, lead(kind) OVER w AS off_kind FROM placed WINDOW w AS (PARTITION BY song_id, track_id, pitch ORDER BY position)),
counted AS (SELECT song_id, track_id, place, count(*) AS note_count FROM paired WHERE kind = 1 AND off_kind = 0 GROUP BY 1, 2, 3),
ends AS (SELECT song_id, CAST(floor(max(tick) / 480e0 / 4) AS INTEGER) + 1 AS duration_bars FROM onoff GROUP BY 1),
clips AS (
    SELECT left(md5('/x/Artist ' || song_id % 3 || ' - Song ' || song_id || '.mid'), 12) || '_' || place AS clip_id, song_id, place, note_count, duration_bars, m.channel, 'Track ' || track_id AS track_name, song_id % 3 AS a
    FROM counted JOIN ends USING (song_id) JOIN main_channel m USING (song_id, track_id)
)"""


def named_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content, modificationTime) of files named by artist and title."""
    path = F.concat(F.lit("/x/Artist "), (number() % 3).cast("string"), F.lit(" - Song "), number().cast("string"), F.lit(".mid"))
    return files(spark, sf_dir).select(path.alias("path"), "content", F.lit("2024-01-01 00:00:00").cast("timestamp").alias("modificationTime"))


@registered(query(NOTES_A, ON_OFF, INDEXED, "SELECT clip_id, CAST(place AS INTEGER) AS track_id, note_count, duration_bars, channel, track_name, 'Artist ' || a AS artist, 'Song ' || song_id AS title, 'rock,jazz' AS genres, 'new' AS tags FROM clips"))
def index_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of a folder's clips, of which each file has come twice; an unknown genre is left out."""
    given, to = shared.cut(named_files(spark, sf_dir)), f"{shared.folder(spark)}/clips-{uuid.uuid4().hex}"
    for _ in range(2):
        index.index_files(given, to, genres_given=["Rock", "jazz music", "no such genre", "rock"], tags=["new"])
    out = changes.load(spark, to)
    return out.select("clip_id", "track_id", "note_count", "duration_bars", "channel", "track_name", "artist", "title", F.array_join("genres", ",").alias("genres"), F.array_join("tags", ",").alias("tags"))


@registered(query(NOTES_A, ON_OFF, INDEXED, "SELECT clip_id, CASE WHEN song_id % 2 = 0 THEN 'Song ' || song_id ELSE 'old' END AS title, CASE WHEN place = 2 THEN 'rock,no such genre' ELSE '' END AS genres FROM clips"))
def update_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles derived again from paths, where these say one; genres given later keep what isn't known."""
    clips = shared.cut(index.described(shared.cut(smf.decode_files(named_files(spark, sf_dir).select("path", "content"))), title="old"))
    odd = F.regexp_extract("source_path", r"(\d+)\.mid$", 1).cast("long") % 2 == 1
    silent = clips.withColumn("source_path", F.when(odd, F.lit("")).otherwise(F.col("source_path")))
    named = index.update_metadata(index.update_titles(silent), F.col("track_id") == 2, genres_given=["Rock", "no such genre"])
    return named.select("clip_id", "title", F.array_join("genres", ",").alias("genres"))
