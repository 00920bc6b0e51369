"""Queries answered from indexes: substrings by trigrams, artists by a dictionary of slugs."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewright.operators import grams, library, paths, patterns, store
from notewright.plans import library as clips_plan
from notewright.plans import repeats
from notewright.plans.sql import NOTES_B, query
from notewright.sources import cache

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def registered(sql: str):
    def keep(function):
        QUERIES[function.__name__] = function
        ORACLE_SQL[function.__name__] = sql
        return function

    return keep


@registered(clips_plan.ORACLE_SQL["browser_filter"])
def browser_filter_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips = clips_plan.clips(spark, sf_dir)
    return clips_plan.shown(library.filter_indexed(clips, "SONG 1", grams.postings(clips, "clip_id", library.browser_text())))


@registered(query(*clips_plan.CLIPS, f"SELECT {clips_plan.LIST} FROM clips WHERE artist ILIKE '%omer#0_0%1%'"))
def clip_query_artist_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By a pattern with wildcards: its literal pieces are looked up."""
    clips = clips_plan.clips(spark, sf_dir)
    return clips_plan.shown(library.find_indexed(clips, library.ClipQuery(artist="omer#0_0%1"), grams.postings(clips, "clip_id", F.col("artist"))))


@registered(repeats.ORACLE_SQL["pattern_search_artist"].replace("'%1%'", "'%0001_%'"))
def pattern_search_artist_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, instances = repeats.stored(spark, sf_dir)
    songs = repeats.song_rows(spark, sf_dir)
    return patterns.search(found, instances, songs, artist="0001_", artists=grams.postings(songs, "song_id", F.col("artist"))).select(*repeats.SHOWN)


SLUGS = """
named AS (SELECT c_custkey, lower(c_mktsegment) AS segment, replace(lower(n_name), ' ', '-') AS nation, c_nationkey FROM customer JOIN nation ON n_nationkey = c_nationkey),
slugs AS (
    SELECT slug, min(name) AS name FROM (
        SELECT segment || '-' || nation AS slug, upper(segment) || ' of ' || nation AS name FROM named WHERE c_custkey % 2 = 0 UNION ALL SELECT nation, 'The ' || nation FROM named WHERE c_nationkey % 3 > 0
        UNION ALL SELECT nation || '-' || segment || '-' || c_custkey, 'Trio ' || c_custkey FROM named WHERE c_custkey % 7 = 0
    ) GROUP BY 1
), stems AS (
    SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN segment || '-' || nation || '-' || nation || '-old-song-' || c_custkey WHEN 1 THEN nation || '-' || segment || '-' || c_custkey || '-one' WHEN 2 THEN nation || '-' || nation
        WHEN 3 THEN 'x-' || nation || '-song' ELSE segment || '-' || nation || '-' || nation || '-' || segment || '-' || c_custkey END AS stem FROM named
)"""


def slug_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(stems: c_custkey, stem; slugs: slug, name), made of customers' segments and nations."""
    c, n = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "nation"))
    named = c.join(n, F.col("n_nationkey") == F.col("c_nationkey")).select("c_custkey", "c_nationkey", F.lower("c_mktsegment").alias("segment"), F.replace(F.lower("n_name"), F.lit(" "), F.lit("-")).alias("nation"))
    dash = lambda *parts: F.concat_ws("-", *[F.col(p).cast("string") if p in named.columns else F.lit(p) for p in parts])
    slugs = named.where("c_custkey % 2 = 0").select(dash("segment", "nation").alias("slug"), F.concat(F.upper("segment"), F.lit(" of "), "nation").alias("name"))
    slugs = slugs.union(named.where("c_nationkey % 3 > 0").select("nation", F.concat(F.lit("The "), "nation")))
    slugs = slugs.union(named.where("c_custkey % 7 = 0").select(dash("nation", "segment", "c_custkey"), F.concat(F.lit("Trio "), F.col("c_custkey").cast("string"))))
    kind = F.col("c_custkey") % 5
    stem = F.when(kind == 0, dash("segment", "nation", "nation", "old", "song", "c_custkey")).when(kind == 1, dash("nation", "segment", "c_custkey", "one")).when(kind == 2, dash("nation", "nation"))
    return named.select("c_custkey", stem.when(kind == 3, dash("x", "nation", "song")).otherwise(dash("segment", "nation", "nation", "segment", "c_custkey")).alias("stem")), slugs


@registered(query(SLUGS, """split_up AS (SELECT c_custkey, string_split(stem, '-') AS w FROM stems),
sized AS (SELECT *, len(string_split(slug, '-')) AS n FROM slugs),
walk(c_custkey, w, words, names) AS (
    SELECT c_custkey, w, 0, CAST([] AS VARCHAR[]) FROM split_up
    UNION ALL
    SELECT c_custkey, any_value(w), CAST(any_value(words) + max(n) AS INTEGER), list_append(any_value(names), arg_max(name, n)) FROM walk JOIN sized ON words + n <= len(w) AND array_to_string(w[words + 1:words + n], '-') = slug GROUP BY c_custkey
), ended AS (SELECT c_custkey, arg_max(words, words) AS words, arg_max(names, words) AS names FROM walk GROUP BY 1)""", "SELECT c_custkey, words, array_to_string(names, ', ') AS artists FROM ended WHERE words > 0").replace("WITH ", "WITH RECURSIVE ", 1))
def path_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names segmented by a dictionary of artists."""
    stems, slugs = slug_tables(spark, sf_dir)
    known = paths.known_artists(stems, slugs)
    return stems.join(known, "stem").select("c_custkey", F.col("known.words").alias("words"), F.array_join("known.names", ", ").alias("artists"))


@registered(query(NOTES_B, repeats.CHUNKS, repeats.PRINTS, repeats.STORE, f"SELECT {repeats.LIST}, (SELECT count(*) FROM patterns) AS total, (SELECT count(*) FROM patterns) > 100 AS has_more FROM patterns ORDER BY occurrences DESC, pattern_id, num_bars LIMIT 50 OFFSET 50"))
def pattern_page_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of patterns, how many there are, and whether more follow, of one job."""
    rows, total, more = patterns.page(patterns.search(repeats.stored(spark, sf_dir)[0]).select(*repeats.SHOWN), offset=50, limit=50)
    return rows.select(*repeats.SHOWN, F.lit(total).cast("long").alias("total"), F.lit(more).alias("has_more"))


LISTED = """
songs AS (SELECT c_custkey AS song_id, c_custkey * 7919 % 1000003 AS created_at FROM customer),
metadata AS (SELECT c_custkey AS song_id, c_name AS artist, lower(c_mktsegment) AS title FROM customer WHERE c_custkey % 3 > 0)"""


def song_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    songs = c.select(F.col("c_custkey").alias("song_id"), (F.col("c_custkey") * 7919 % 1000003).alias("created_at"))
    return songs, c.where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("song_id"), F.col("c_name").alias("artist"), F.lower("c_mktsegment").alias("title"))


@registered(query(LISTED, "SELECT song_id, created_at, coalesce(artist, '') AS artist, coalesce(title, '') AS title FROM songs LEFT JOIN metadata USING (song_id) ORDER BY created_at DESC, song_id LIMIT 40 OFFSET 20"))
def song_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of all songs, the youngest first."""
    return store.listing(*song_tables(spark, sf_dir), limit=40, offset=20).fillna("").select("song_id", "created_at", "artist", "title")


@registered(query(LISTED, "SELECT song_id, created_at, artist, title FROM songs JOIN metadata USING (song_id) WHERE artist ILIKE '%customer#_%7'"))
def song_listing_artist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.listing(*song_tables(spark, sf_dir), artist="CUSTOMER#_%7").where(F.col("artist").endswith("7")).select("song_id", "created_at", "artist", "title")


NOW = 1_000_000


@registered("""WITH answers AS (
    SELECT user_id % 500 AS k, event_id, CASE event_type WHEN 'click' THEN 'search' WHEN 'error' THEN 'discogs' ELSE 'musicbrainz' END AS source, event_id * 137 % 1000003 AS stored, props AS body FROM events
), youngest AS (SELECT * FROM answers WHERE event_type_kept(source) QUALIFY row_number() OVER (PARTITION BY k ORDER BY stored DESC) = 1)
SELECT 'k' || k AS key, source, stored, body FROM youngest WHERE source <> 'discogs' AND k % 10 <> 3 AND stored + CASE source WHEN 'search' THEN 86400 ELSE 604800 END >= 1000000""".replace(" WHERE event_type_kept(source)", ""))
def cache_life(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of answers after some were put in twice over, some removed, those of a source cleared, and what has expired cleaned up."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    source = F.when(F.col("event_type") == "click", "search").when(F.col("event_type") == "error", "discogs").otherwise("musicbrainz")
    rows = e.select(F.concat(F.lit("k"), (F.col("user_id") % 500).cast("string")).alias("key"), source.alias("source"), (F.col("event_id") * 137 % 1000003).alias("stored"), F.col("props").alias("body"))
    half = F.pmod(F.xxhash64("stored"), F.lit(2)) == 0
    held = cache.put(cache.put(rows.where(half), rows.where(~half)), rows.where(half))
    gone = rows.where(F.substring("key", -1, 1) == "3")
    return cache.cleanup(cache.clear(cache.remove(held, gone), "discogs"), NOW)
