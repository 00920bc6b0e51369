"""Queries on the clip library, genres, paths and exports."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewright.operators import export, features, genres, library, paths
from notewright.plans.sql import FEATURES, NOTES_A, ROLES, query, values
from notewright.plans.tracks import all_roles, r6, rounded
from notewright.sources.notes import notes_from_events
from notewright.streaming import ingest

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
SEGMENTS = [("AUTOMOBILE", "rock", "driving"), ("BUILDING", "techno", "work"), ("FURNITURE", "jazz", "home"), ("HOUSEHOLD", "pop", "home"), ("MACHINERY", "metal", "work")]


def registered(sql: str | None = None):
    def keep(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return keep


def song_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A song for every ten customers, by the first of them: artist, title, and genre and tag by market segment."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    c = c.groupBy(F.expr("c_custkey div 10").alias("song_id")).agg(F.min_by(F.struct("c_custkey", "c_name", "c_mktsegment"), "c_custkey").alias("c")).select("song_id", "c.*")
    genre, tag = F.lit(None).cast("string"), F.lit(None).cast("string")
    for s, g, t in SEGMENTS:
        genre, tag = F.when(F.col("c_mktsegment") == s, g).otherwise(genre), F.when(F.col("c_mktsegment") == s, t).otherwise(tag)
    return c.select("song_id", F.col("c_name").alias("artist"), F.concat(F.lit("Song "), F.col("c_custkey").cast("string")).alias("title"), F.array_compact(F.array(genre)).alias("genres"), F.array_compact(F.array(tag)).alias("tags"))


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = notes_from_events(spark, sf_dir)
    return library.clips(features.track_features(notes), all_roles(spark, sf_dir), features.song_bars(notes), song_table(spark, sf_dir))


CLIPS = [
    NOTES_A,
    FEATURES,
    ROLES,
    values(SEGMENTS, "segments", "segment, genre, tag"),
    """songs AS (SELECT c_custkey // 10 AS song_id, c_name AS artist, 'Song ' || c_custkey AS title, genre, tag FROM (SELECT * FROM customer QUALIFY row_number() OVER (PARTITION BY c_custkey // 10 ORDER BY c_custkey) = 1) LEFT JOIN segments ON segment = c_mktsegment),
clips AS (
    SELECT f.song_id || '_' || f.track_id AS clip_id, f.song_id, f.track_id, r.primary_role AS role, f.note_count, t.total_bars AS bars, f.note_density AS density, f.avg_velocity, f.avg_duration, f.pitch_range,
        s.artist, s.title, s.genre, s.tag
    FROM features f JOIN roles r USING (song_id, track_id) JOIN total t USING (song_id) LEFT JOIN songs s USING (song_id)
)""",
]
SHOWN = ["clip_id", "song_id", "track_id", "role", "note_count", "bars", "artist"]
LIST = "clip_id, song_id, track_id, role, note_count, bars, coalesce(artist, '') AS artist"


def shown(df: DataFrame) -> DataFrame:
    return df.select(*SHOWN).fillna({"artist": ""})


@registered(query(*CLIPS, f"SELECT {LIST} FROM clips"))
def clip_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(clips(spark, sf_dir))


@registered(query(*CLIPS, f"SELECT {LIST} FROM clips WHERE role = 'bass' ORDER BY note_count DESC, clip_id LIMIT 20"))
def clip_query_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(library.find(clips(spark, sf_dir), library.ClipQuery(role="bass", limit=20)))


@registered(query(*CLIPS, f"SELECT {LIST} FROM clips WHERE genre = 'rock'"))
def clip_query_genre(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(library.find(clips(spark, sf_dir), library.ClipQuery(genre="rock")))


@registered(query(*CLIPS, f"SELECT {LIST} FROM clips WHERE artist ILIKE '%01%'"))
def clip_query_artist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(library.find(clips(spark, sf_dir), library.ClipQuery(artist="01")))


@registered(query(*CLIPS, f"SELECT {LIST} FROM clips WHERE note_count BETWEEN 100 AND 160 AND bars >= 10 AND bars <= 40"))
def clip_query_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(library.find(clips(spark, sf_dir), library.ClipQuery(min_notes=100, max_notes=160, min_bars=10, max_bars=40)))


@registered(query(*CLIPS, f"SELECT {LIST} FROM clips WHERE tag IN ('home', 'driving') ORDER BY note_count DESC, clip_id LIMIT 10 OFFSET 10"))
def clip_query_tags_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(library.find(clips(spark, sf_dir), library.ClipQuery(tags=["home", "driving"], limit=10, offset=10)))


@registered(query(*CLIPS, "SELECT count(*) AS clips, count(DISTINCT song_id) AS songs, count(DISTINCT nullif(artist, '')) AS artists FROM clips"))
def library_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.stats(clips(spark, sf_dir))


@registered(query(*CLIPS, "SELECT genre, count(*) AS clips FROM clips WHERE genre IS NOT NULL GROUP BY 1"))
def genre_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.genre_counts(clips(spark, sf_dir))


@registered(query(*CLIPS, "SELECT DISTINCT artist FROM clips WHERE artist <> ''"))
def list_artists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.artists(clips(spark, sf_dir))


@registered(query(*CLIPS, "SELECT coalesce(nullif(artist, ''), 'Unknown') AS artist, count(DISTINCT song_id) AS songs FROM clips GROUP BY 1"))
def artist_song_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.songs_per_artist(clips(spark, sf_dir))


@registered(query(*CLIPS, "SELECT song_id, arg_max(clip_id, note_count * 1000 - track_id) AS clip_id, count(*) AS tracks, coalesce(any_value(title), 'song ' || song_id) AS shown FROM clips GROUP BY song_id"))
def song_browser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.song_browser(clips(spark, sf_dir))


@registered(query(*CLIPS, f"SELECT {LIST} FROM clips WHERE contains(lower(coalesce(artist, '') || chr(10) || coalesce(title, '') || chr(10) || coalesce(genre, '')), 'song 1')"))
def browser_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(library.filter_text(clips(spark, sf_dir), "SONG 1"))


WEIGHED = [("density", 0.3), ("pitch_range", 0.2), ("avg_velocity", 0.2), ("avg_duration", 0.3)]
BOTH = {c: f"a.{c} > 0 AND b.{c} > 0" for c, _ in WEIGHED}
RATIO = " + ".join(f"CASE WHEN {BOTH[c]} THEN least(a.{c}, b.{c}) / CAST(greatest(a.{c}, b.{c}) AS DOUBLE) * {w}e0 ELSE 0e0 END" for c, w in WEIGHED)
SHARE = " + ".join(f"CASE WHEN {BOTH[c]} THEN {w}e0 ELSE 0e0 END" for c, w in WEIGHED)


@registered(query(*CLIPS, "ranged AS (SELECT * REPLACE (greatest(pitch_range, 1) AS pitch_range) FROM clips)", f"""SELECT target, clip_id, {r6('similarity', 'similarity')} FROM (
    SELECT *, row_number() OVER (PARTITION BY target ORDER BY round(similarity, 9) DESC, clip_id) AS place FROM (
        SELECT b.clip_id AS target, a.clip_id, ({RATIO}) / nullif({SHARE}, 0) AS similarity FROM ranged a JOIN ranged b ON a.song_id <> b.song_id WHERE b.song_id % 100 = 0) WHERE similarity > 0.5) WHERE place <= 50"""))
def similar_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated targets: all clips of songs whose id is divisible by 100. Of each the 50 best."""
    table = clips(spark, sf_dir)
    return rounded(library.similar_tracks(table, table.where("song_id % 100 = 0"), limit=50), "similarity")


@registered(query(*CLIPS, f"SELECT {LIST} FROM (SELECT * REPLACE (CASE WHEN song_id % 2 = 0 THEN 'lead' ELSE role END AS role) FROM clips) WHERE track_id <> 4"))
def dedup_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips of even songs replaced by key, then one track's clips deleted."""
    table = clips(spark, sf_dir)
    new = table.where("song_id % 2 = 0").withColumn("role", F.lit("lead"))
    return shown(library.delete(library.upsert(table, new), F.col("track_id") == 4))


# Tags that customers have in turn, with the name and category that each stands for; none for the last ones.
TAGS = [
    ("  Rock & Roll ", "rock", "rock"),
    ("prog", "progressive rock", "rock"),
    ("Synth Pop", "synth-pop", "pop"),
    ("electropop", "electro-pop", "pop"),
    ("EDM", "edm", "electronic"),
    ("Electronic Dance Music", "edm", "electronic"),
    ("drum & bass", "drum and bass", "electronic"),
    ("fusion", "jazz fusion", "jazz"),
    ("be-bop", "bebop", "jazz"),
    ("jazz genre", "jazz", "jazz"),
    ("modern classical", "contemporary classical", "classical"),
    ("conscious hip hop", "conscious hip-hop", "hip-hop"),
    ("rap music", "hip-hop", "hip-hop"),
    ("neo soul", "neo-soul", "r&b"),
    ("alternative country", "alt-country", "country"),
    ("singer songwriter", "singer-songwriter", "folk"),
    ("blues rock", "blues rock", "blues"),
    ("nu metal", "nu-metal", "metal"),
    ("hardcore", "hardcore punk", "punk"),
    ("dub", "dub", "reggae"),
    ("reggaetón", "reggaeton", "latin"),
    ("afropop", "afropop", "world"),
    ("northern soul", "northern soul", "soul"),
    ("nu disco", "nu-disco", "funk"),
    ("drone", "drone", "ambient"),
    ("avant garde", "avant-garde", "experimental"),
    ("vgm", "video game music", "soundtrack"),
    ("conscious hip-hop", None, None),
    ("rock  music", None, None),
    ("xyzabc123", None, None),
]
# Sources and how far along the tags each is for a customer; the first two often agree.
SOURCES = [("musicbrainz", 1, 0), ("discogs", 1, 0), ("lastfm", 7, 3), ("spotify", 1, 1), ("user", 11, 5), ("forum", 13, 2)]


def tag_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of all customers from six sources."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    tags = F.array(*[F.lit(t) for t, _, _ in TAGS])
    rows = [F.struct(F.lit(s).alias("source"), F.lit(k).alias("place"), F.get(tags, F.pmod(F.col("c_custkey") * by + plus, F.lit(len(TAGS))).cast("int")).alias("tag")) for k, (s, by, plus) in enumerate(SOURCES)]
    return c.select("c_custkey", F.explode(F.array(*rows)).alias("x")).select("c_custkey", "x.*")


TAG_SQL = [
    values([(k, t, n or "", g or "") for k, (t, n, g) in enumerate(TAGS)], "known", "k, tag, canonical, category"),
    values([(s, k, by, plus) for k, (s, by, plus) in enumerate(SOURCES)], "sources", "source, place, by_, plus"),
    f"tags AS (SELECT c_custkey, source, place, tag, canonical, category FROM customer, sources JOIN known ON k = (c_custkey * by_ + plus) % {len(TAGS)})",
]


@registered(query(*TAG_SQL, "SELECT c_custkey, source, place, tag, canonical, category FROM tags"))
def normalize_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return genres.normalize(tag_table(spark, sf_dir), genres.taxonomy(spark)).fillna("", ["canonical", "category"])


@registered(query(*TAG_SQL, """weights(source, w) AS (VALUES ('musicbrainz', 1e0), ('discogs', 0.9e0), ('lastfm', 0.7e0), ('spotify', 0.8e0), ('user', 0.5e0), ('forum', 0.5e0)),
found AS (SELECT c_custkey, canonical, place, w, row_number() OVER (PARTITION BY c_custkey, canonical ORDER BY place) AS nth FROM tags JOIN weights USING (source) WHERE canonical <> '')""",
    f"""SELECT c_custkey, canonical, CAST(count(*) AS INTEGER) AS sources, {r6("least(1e0, sum(CASE WHEN nth = 1 THEN w ELSE 0.3e0 * w END))", "confidence")} FROM found GROUP BY 1, 2"""))
def merge_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = genres.normalize(tag_table(spark, sf_dir), genres.taxonomy(spark))
    return rounded(genres.merge(tags, ["c_custkey"]).select("c_custkey", "canonical", "sources", "confidence"), "confidence")


@registered("""WITH names(word, canonical) AS (VALUES
    ('rock', 'rock'), ('rock', 'classic rock'), ('rock', 'hard rock'), ('rock', 'soft rock'), ('rock', 'progressive rock'), ('rock', 'alternative rock'), ('rock', 'indie rock'), ('rock', 'psychedelic rock'), ('rock', 'garage rock'), ('rock', 'southern rock'),
    ('techno', 'techno'), ('jazz', 'jazz'), ('jazz', 'smooth jazz'), ('jazz', 'jazz fusion'), ('jazz', 'free jazz'), ('jazz', 'cool jazz'), ('jazz', 'latin jazz'), ('jazz', 'acid jazz'), ('jazz', 'nu-jazz'),
    ('pop', 'pop'), ('pop', 'synth-pop'), ('pop', 'electro-pop'), ('pop', 'dance-pop'), ('pop', 'art pop'), ('pop', 'indie pop'), ('pop', 'chamber pop'), ('pop', 'dream pop'), ('pop', 'power pop'), ('pop', 'teen pop'),
    ('metal', 'metal'), ('metal', 'heavy metal'), ('metal', 'thrash metal'), ('metal', 'death metal'), ('metal', 'black metal'), ('metal', 'doom metal'), ('metal', 'power metal'), ('metal', 'progressive metal'), ('metal', 'nu-metal'), ('metal', 'metalcore')),
segments(segment, word) AS (VALUES ('AUTOMOBILE', 'rock'), ('BUILDING', 'techno'), ('FURNITURE', 'jazz'), ('HOUSEHOLD', 'pop'), ('MACHINERY', 'metal'))
SELECT word, canonical FROM names WHERE word IN (SELECT word FROM customer JOIN segments ON segment = c_mktsegment)""")
def suggest_genres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every genre word that customers' segments name, the first ten names that hold it."""
    words = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_mktsegment").distinct()
    words = words.join(F.broadcast(spark.createDataFrame([(s, g) for s, g, _ in SEGMENTS], "c_mktsegment string, word string")), "c_mktsegment").select("word")
    return genres.suggest(genres.taxonomy(spark), words)


def file_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths in eight shapes, from customers and their nations."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    t = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).select("c_custkey", F.initcap(F.lower("n_name")).alias("artist"), F.lower("c_mktsegment").alias("word"))
    artist, word, k, text = F.col("artist"), F.col("word"), F.col("c_custkey").cast("string"), F.lit
    shapes = [
        F.concat(F.substring("artist", 1, 1), text("/"), artist, text("/"), word, text("_"), k),
        F.concat(artist, text(" - "), word, text(" no "), k),
        F.concat(word, text("-song-"), k),
        F.concat(word, k),
        F.concat(F.lower("artist"), text("__"), word, text("_"), k),
        F.concat(word, text("-two-song")),
        F.concat(word, text("-20230130024203-midi-karaoke.info")),
        F.concat(word, text("-"), k),
    ]
    named = F.get(F.array(*shapes), F.pmod("c_custkey", F.lit(8)).cast("int"))
    return t.select("c_custkey", F.concat(F.lit("/music/"), named, F.lit(".mid")).alias("path"))


CASED = "upper(left(lower(c_mktsegment), 1)) || substr(lower(c_mktsegment), 2)"
ARTIST = "array_to_string(list_transform(string_split(lower(n_name), ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ')"


@registered(f"""SELECT c_custkey,
    CASE c_custkey % 8 WHEN 0 THEN {ARTIST} WHEN 1 THEN replace({ARTIST}, '_', ' ') WHEN 2 THEN {CASED} WHEN 4 THEN replace({ARTIST}, '_', ' ') WHEN 5 THEN {CASED} || ' Two' ELSE '' END AS artist,
    CASE c_custkey % 8 WHEN 0 THEN {CASED} || ' ' || c_custkey WHEN 1 THEN {CASED} || ' No ' || c_custkey WHEN 2 THEN 'Song' WHEN 3 THEN {CASED} || c_custkey WHEN 4 THEN {CASED} || ' ' || c_custkey WHEN 5 THEN 'Song' ELSE {CASED} END AS title,
    CASE c_custkey % 8 WHEN 0 THEN 'folder_structure' WHEN 1 THEN 'filename_separator' WHEN 2 THEN 'filename_hyphenated' WHEN 3 THEN 'filename_fallback' WHEN 4 THEN 'filename_separator' WHEN 5 THEN 'filename_nonstop2k_heuristic' WHEN 6 THEN 'filename_fallback' ELSE 'filename_hyphenated' END AS source,
    CASE c_custkey % 8 WHEN 0 THEN 0.8e0 WHEN 1 THEN 0.6e0 WHEN 2 THEN 0.5e0 WHEN 4 THEN 0.6e0 WHEN 5 THEN 0.4e0 ELSE 0.3e0 END AS confidence
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def path_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.metadata(file_table(spark, sf_dir)).select("c_custkey", "artist", "title", "source", "confidence")


@registered(query(NOTES_A, "SELECT song_id, track_id, note_seq, start_beat - 16 AS start_beat, duration_beats, pitch, velocity, channel FROM notes WHERE start_beat >= 16 AND start_beat < 32"))
def extract_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.extract(notes_from_events(spark, sf_dir), 4, 8)


@registered(query(NOTES_A, """SELECT song_id, track_id, note_seq, round_even((start_beat - arg_min(start_beat, note_seq) OVER (PARTITION BY song_id, track_id)) / 0.25, 0) * 0.25 AS start_beat, duration_beats,
    CAST(greatest(0, least(127, pitch + 7)) AS INTEGER) AS pitch, CAST(greatest(1, least(127, trunc(velocity * 1.2e0))) AS INTEGER) AS velocity, channel FROM notes"""))
def transform_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.transform(notes_from_events(spark, sf_dir), transpose=7, velocity=1.2, grid=16)


@registered(query(NOTES_A, """onoff AS (
    SELECT song_id, track_id, CAST(trunc(start_beat * 480) AS INTEGER) AS tick, 1 AS kind, pitch, velocity, note_seq FROM notes
    UNION ALL SELECT song_id, track_id, CAST(trunc((start_beat + duration_beats) * 480) AS INTEGER), 0, pitch, 0, note_seq FROM notes
)""", """SELECT song_id, track_id, CAST(row_number() OVER w AS INTEGER) AS position, tick, CAST(tick - coalesce(lag(tick) OVER w, 0) AS INTEGER) AS delta, kind, pitch, velocity
FROM onoff WINDOW w AS (PARTITION BY song_id, track_id ORDER BY tick, kind, note_seq, pitch)"""))
def export_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.events(notes_from_events(spark, sf_dir))


@registered(query(NOTES_A, "SELECT song_id, (max(start_beat + duration_beats) - min(start_beat)) * 60e0 / 120e0 AS seconds FROM notes GROUP BY 1"))
def song_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.duration_seconds(notes_from_events(spark, sf_dir))


@registered("""SELECT path, md5(path || ':' || length || ':2024-01-01 00:00:00') AS key FROM (SELECT *, '/songs/' || c_custkey || '.mid' AS path, c_custkey % 1000 + 100 AS length FROM customer)
WHERE c_custkey % 5 = 0 OR NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')""")
def unprocessed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that aren't done: those of customers with finished orders are, but every fifth has changed in length since."""
    when = F.lit("2024-01-01 00:00:00").cast("timestamp")
    files = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.concat(F.lit("/songs/"), F.col("c_custkey").cast("string"), F.lit(".mid")).alias("path"), (F.col("c_custkey") % 1000 + 100).alias("length"), when.alias("modificationTime"))
    finished = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")).distinct()
    seen = files.join(finished, "c_custkey", "left_semi").withColumn("length", F.col("length") - (F.col("c_custkey") % 5 == 0).cast("long"))
    return ingest.unprocessed(files, seen.select(ingest.file_key().alias("key"))).select("path", "key")
