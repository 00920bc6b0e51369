"""Queries on chunks, fingerprints, repeated patterns and the pattern store."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewright.operators import chunks, features, patterns, roles
from notewright.operators.features import TRACK
from notewright.plans.harmony import text
from notewright.plans.sql import FEATURES, NOTES_B, ROLES, query
from notewright.plans.tracks import r6, rounded
from notewright.shared import cut
from notewright.sources.notes import notes_from_orders

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
GROUP = [*TRACK, "chunk_size"]


def registered(sql: str | None = None):
    def keep(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return keep


CHUNKS = """
lengths AS (SELECT song_id, CAST(floor(max(start_beat + duration_beats) / 4) AS INTEGER) + 1 AS bars FROM notes GROUP BY 1),
spans AS (
    SELECT song_id, track_id, chunk_size, CAST(unnest(range(0, bars, chunk_size)) AS INTEGER) AS start_bar, bars
    FROM (SELECT DISTINCT song_id, track_id FROM notes) JOIN lengths USING (song_id), (SELECT unnest([1, 2, 4, 8, 16]) AS chunk_size)
), local AS (
    SELECT n.*, chunk_size, CAST(floor(start_beat / 4) AS INTEGER) - CAST(floor(start_beat / 4) AS INTEGER) % chunk_size AS start_bar
    FROM notes n, (SELECT unnest([1, 2, 4, 8, 16]) AS chunk_size)
), inside AS (
    SELECT song_id, track_id, chunk_size, start_bar, count(*) AS note_count, list(pitch ORDER BY start_beat, note_seq) AS pitches,
        list(DISTINCT CAST(floor((start_beat - start_bar * 4) / 0.25) AS INTEGER)) AS on_steps, max(velocity) AS top_velocity
    FROM local GROUP BY 1, 2, 3, 4
), chunked AS (
    SELECT s.song_id, s.track_id, s.chunk_size, s.start_bar, least(s.start_bar + s.chunk_size, s.bars) AS end_bar, least(s.start_bar + s.chunk_size, s.bars) - s.start_bar AS num_bars,
        coalesce(i.note_count, 0) AS note_count, coalesce(i.pitches, []) AS pitches, coalesce(i.on_steps, []) AS on_steps
    FROM spans s LEFT JOIN inside i USING (song_id, track_id, chunk_size, start_bar)
)"""
PRINTS = """
gridded AS (
    SELECT *, list_transform(range(num_bars * 16), lambda k: CASE WHEN list_contains(on_steps, k) THEN 1 ELSE 0 END) AS onset_grid,
        list_transform(range(1, len(pitches)), lambda k: pitches[k + 1] - pitches[k]) AS intervals FROM chunked
), hashed AS (
    SELECT *, left(md5(array_to_string(onset_grid, '')), 16) AS rhythm_hash, left(md5(coalesce(array_to_string(intervals, ','), '')), 16) AS pitch_hash,
        list_transform(intervals, lambda x: sign(x)) AS contour, list_transform(range(12), lambda k: len(list_filter(pitches, lambda p: p % 12 = k))) AS pitch_classes,
        coalesce(list_max(pitches) - list_min(pitches), 0) AS range_semitones, coalesce(list_avg(pitches), 0) AS mean_pitch
    FROM gridded
), prints AS (SELECT *, left(md5(rhythm_hash || ':' || pitch_hash), 16) AS pattern_id FROM hashed)"""


@registered(query(NOTES_B, CHUNKS, "SELECT song_id, track_id, chunk_size, start_bar, end_bar, num_bars, start_bar * 4e0 AS start_beat, end_bar * 4e0 AS end_beat, note_count FROM chunked"))
def bar_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.chunks(notes_from_orders(spark, sf_dir))


def prints(spark: SparkSession, sf_dir: str, sizes: tuple[int, ...] = chunks.SIZES) -> DataFrame:
    return chunks.fingerprints(notes_from_orders(spark, sf_dir), sizes)


@registered(query(NOTES_B, CHUNKS, PRINTS, "SELECT song_id, track_id, chunk_size, start_bar, rhythm_hash, array_to_string(onset_grid, '') AS grid, list_sum(onset_grid) / CAST(len(onset_grid) AS DOUBLE) AS density FROM prints"))
def rhythm_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prints(spark, sf_dir).select(*chunks.CHUNK, "rhythm_hash", F.array_join(F.transform("onset_grid", lambda x: x.cast("string")), "").alias("grid"), "density")


@registered(query(NOTES_B, CHUNKS, PRINTS, f"SELECT song_id, track_id, chunk_size, start_bar, pitch_hash, pattern_id, array_to_string(pitch_classes, ',') AS pitch_classes, range_semitones, {r6('mean_pitch', 'mean_pitch')} FROM prints"))
def pitch_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(prints(spark, sf_dir).select(*chunks.CHUNK, "pitch_hash", "pattern_id", text("pitch_classes"), "range_semitones", "mean_pitch"), "mean_pitch")


CLUSTERS = "clusters AS (SELECT song_id, track_id, chunk_size, pattern_id, count(*) AS occurrences, min(start_bar) AS first_bar, string_agg(CAST(start_bar AS VARCHAR), ',' ORDER BY start_bar) AS bar_positions FROM prints GROUP BY 1, 2, 3, 4)"


@registered(query(NOTES_B, CHUNKS, PRINTS, CLUSTERS, "SELECT * FROM clusters"))
def exact_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.exact_clusters(prints(spark, sf_dir)).drop("confidence").withColumn("bar_positions", text("bar_positions"))


@registered(query(NOTES_B, CHUNKS, PRINTS, CLUSTERS, "SELECT * FROM clusters WHERE occurrences >= 2"))
def repeated_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.repeated(exact_clusters(spark, sf_dir))


@registered(query(NOTES_B, CHUNKS, PRINTS, CLUSTERS, f"SELECT song_id, track_id, chunk_size, count(*) AS unique_patterns, CAST(sum(occurrences) AS BIGINT) AS total_chunks, {r6('sum(occurrences - 1) / CAST(sum(occurrences) AS DOUBLE)', 'repetition_ratio')} FROM clusters GROUP BY 1, 2, 3"))
def repetition_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(patterns.repetition_ratio(patterns.exact_clusters(prints(spark, sf_dir))), "repetition_ratio")


PAIRS = """
ones AS (SELECT song_id, track_id, chunk_size, pattern_id, arg_min(onset_grid, start_bar) AS g, arg_min(pitch_classes, start_bar) AS pc, arg_min(contour, start_bar) AS c, arg_min(mean_pitch, start_bar) AS m FROM prints GROUP BY 1, 2, 3, 4),
paired AS (
    SELECT a.song_id, a.track_id, a.chunk_size, a.pattern_id AS pattern_a, b.pattern_id AS pattern_b, a.m - b.m AS shift, a.c AS ca, b.c AS cb, a.pc AS pa, b.pc AS pb,
        len(list_filter(range(1, least(len(a.g), len(b.g)) + 1), lambda k: a.g[k] = 1 AND b.g[k] = 1)) AS both_on,
        len(list_filter(range(1, greatest(len(a.g), len(b.g)) + 1), lambda k: coalesce(a.g[k], 0) = 1 OR coalesce(b.g[k], 0) = 1)) AS either_on
    FROM ones a JOIN ones b ON a.song_id = b.song_id AND a.track_id = b.track_id AND a.chunk_size = b.chunk_size AND a.pattern_id < b.pattern_id
), rhythmic AS (SELECT *, CASE WHEN either_on = 0 THEN 1e0 ELSE both_on / CAST(either_on AS DOUBLE) END AS rhythm FROM paired),
rated AS (
    SELECT *, list_sum(list_transform(list_zip(pa, pb), lambda z: z[1] * z[2])) AS dot, list_sum(list_transform(pa, lambda x: x * x)) AS sa, list_sum(list_transform(pb, lambda x: x * x)) AS sb,
        CASE WHEN len(ca) <> len(cb) THEN 0e0 WHEN len(ca) = 0 THEN 1e0 ELSE len(list_filter(range(1, len(ca) + 1), lambda k: ca[k] = cb[k])) / CAST(len(ca) AS DOUBLE) END AS contour
    FROM rhythmic WHERE rhythm >= 0.9
)"""


@registered(query(NOTES_B, CHUNKS, PRINTS, PAIRS, f"""SELECT song_id, track_id, chunk_size, pattern_a, pattern_b, {r6("rhythm", "rhythm")},
    {r6("(CASE WHEN sa = 0 OR sb = 0 THEN 0 ELSE dot / (sqrt(sa) * sqrt(sb)) END + contour) / 2", "pitch")},
    CAST(CASE WHEN abs(round_even(shift, 0)) <= 12 THEN round_even(shift, 0) ELSE -99 END AS INTEGER) AS transposition FROM rated"""))
def pair_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = patterns.similar_pairs(prints(spark, sf_dir))
    return rounded(pairs.select(*GROUP, "pattern_a", "pattern_b", "rhythm", "pitch", F.coalesce("transposition", F.lit(-99)).alias("transposition")), "rhythm", "pitch")


MERGED = """
near AS (
    SELECT song_id, track_id, chunk_size, pattern_a, pattern_b FROM rated
    WHERE (rhythm + (CASE WHEN sa = 0 OR sb = 0 THEN 0 ELSE dot / (sqrt(sa) * sqrt(sb)) END + contour) / 2) / 2 >= 0.85
), ways AS (SELECT song_id, track_id, chunk_size, pattern_a AS p, pattern_b AS q FROM near UNION ALL SELECT song_id, track_id, chunk_size, pattern_b, pattern_a FROM near),
lined AS (SELECT *, row_number() OVER (PARTITION BY song_id, track_id, chunk_size ORDER BY first_bar) AS k FROM clusters),
later AS (
    SELECT a.song_id, a.track_id, a.chunk_size, a.k, a.pattern_id AS p, coalesce(list(b.pattern_id ORDER BY b.k) FILTER (b.k > a.k), []) AS near
    FROM lined a LEFT JOIN ways w ON w.song_id = a.song_id AND w.track_id = a.track_id AND w.chunk_size = a.chunk_size AND w.p = a.pattern_id
    LEFT JOIN lined b ON b.song_id = a.song_id AND b.track_id = a.track_id AND b.chunk_size = a.chunk_size AND b.pattern_id = w.q GROUP BY 1, 2, 3, 4, 5
), taken(song_id, track_id, chunk_size, k, gone, own) AS (
    SELECT song_id, track_id, chunk_size, k, [p] || near, [p] || near FROM later WHERE k = 1
    UNION ALL
    SELECT t.song_id, t.track_id, t.chunk_size, l.k, CASE WHEN list_contains(gone, l.p) THEN gone ELSE gone || [l.p] || list_filter(l.near, lambda x: NOT list_contains(gone, x)) END,
        CASE WHEN list_contains(gone, l.p) THEN [] ELSE [l.p] || list_filter(l.near, lambda x: NOT list_contains(gone, x)) END
    FROM taken t JOIN later l ON l.song_id = t.song_id AND l.track_id = t.track_id AND l.chunk_size = t.chunk_size AND l.k = t.k + 1
), members AS (SELECT song_id, track_id, chunk_size, own[1] AS leader, unnest(own) AS pattern_id, unnest(range(len(own))) AS place FROM taken WHERE len(own) > 0)"""


@registered(query(NOTES_B, CHUNKS, PRINTS, CLUSTERS, PAIRS, MERGED, """SELECT song_id, track_id, chunk_size, leader, arg_max(pattern_id, occurrences * 100000 - place) AS canonical, count(*) AS merged, CAST(sum(occurrences) AS BIGINT) AS occurrences, 1e0 / count(*) AS confidence
FROM members JOIN clusters USING (song_id, track_id, chunk_size, pattern_id) GROUP BY 1, 2, 3, 4""").replace("WITH ", "WITH RECURSIVE ", 1))
def fuzzy_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = prints(spark, sf_dir)
    return patterns.merge_similar(patterns.exact_clusters(found), patterns.similar_pairs(found))


STORE = """
patterns AS (
    SELECT pattern_id, rhythm_hash, pitch_hash, num_bars, count(*) AS occurrences, count(DISTINCT song_id) AS songs, max(note_count) AS note_count, max(range_semitones) AS range_semitones,
        min(onset_grid) AS onset_grid, min(pitch_classes) AS pitch_classes FROM prints WHERE note_count > 0 GROUP BY 1, 2, 3, 4
)"""
SHOWN = ["pattern_id", "rhythm_hash", "pitch_hash", "num_bars", "occurrences", "songs", "note_count", "range_semitones"]
LIST = ", ".join(SHOWN)


def stored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return patterns.store(prints(spark, sf_dir))


@registered(query(NOTES_B, CHUNKS, PRINTS, STORE, f"SELECT {LIST} FROM patterns"))
def pattern_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir)[0].select(*SHOWN)


@registered(query(NOTES_B, CHUNKS, PRINTS, STORE, f"SELECT {LIST} FROM patterns ORDER BY occurrences DESC, pattern_id, num_bars LIMIT 20"))
def most_common_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.search(stored(spark, sf_dir)[0], limit=20).select(*SHOWN)


@registered(query(NOTES_B, CHUNKS, PRINTS, STORE, f"SELECT {LIST} FROM patterns WHERE num_bars = 2 AND occurrences >= 3"))
def pattern_search_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.search(stored(spark, sf_dir)[0], bars=2, least=3).select(*SHOWN)


@registered(query(NOTES_B, CHUNKS, PRINTS, STORE, f"SELECT {LIST} FROM patterns WHERE rhythm_hash = '{chr(37)}'").replace("'%'", "(SELECT max(rhythm_hash) FROM patterns WHERE num_bars = 1)"))
def pattern_search_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    # read twice, so it is worked out before
    found = cut(stored(spark, sf_dir)[0].select(*SHOWN))
    most = found.where("num_bars = 1").agg(F.max("rhythm_hash").alias("rhythm_hash"))
    return found.join(F.broadcast(most), "rhythm_hash", "left_semi").select(*SHOWN)


SONGS = """songs AS (SELECT song_id, c_name AS artist, c_mktsegment AS segment FROM (SELECT *, c_custkey // 10 AS song_id FROM customer QUALIFY row_number() OVER (PARTITION BY c_custkey // 10 ORDER BY c_custkey) = 1)),
places AS (SELECT DISTINCT p.pattern_id, p.song_id, s.artist, s.segment FROM prints p LEFT JOIN songs s USING (song_id) WHERE note_count > 0)"""


def song_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(song_id, artist, genres, tags): of ten customers the first one's name, segment and nation."""
    first = spark.read.parquet(f"{sf_dir}/customer.parquet").groupBy(F.expr("c_custkey div 10").alias("song_id")).agg(F.min_by(F.struct("c_name", "c_mktsegment", "c_nationkey"), "c_custkey").alias("c"))
    return first.select("song_id", F.col("c.c_name").alias("artist"), F.array(F.lower("c.c_mktsegment")).alias("genres"), F.array(F.concat(F.lit("nation "), F.col("c.c_nationkey").cast("string"))).alias("tags"))


@registered(query(NOTES_B, CHUNKS, PRINTS, STORE, SONGS, f"SELECT {LIST} FROM patterns WHERE pattern_id IN (SELECT pattern_id FROM places WHERE artist ILIKE '%1%')"))
def pattern_search_artist(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, instances = stored(spark, sf_dir)
    return patterns.search(found, instances, song_rows(spark, sf_dir), artist="1").select(*SHOWN)


@registered(query(NOTES_B, CHUNKS, PRINTS, STORE, SONGS, f"SELECT {LIST} FROM patterns WHERE pattern_id IN (SELECT pattern_id FROM places WHERE segment ILIKE '%build%')"))
def pattern_search_genre(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, instances = stored(spark, sf_dir)
    return patterns.search(found, instances, song_rows(spark, sf_dir), genre="build").select(*SHOWN)


@registered(query(NOTES_B, FEATURES, ROLES, CHUNKS, PRINTS, STORE, f"SELECT {LIST} FROM patterns WHERE pattern_id IN (SELECT pattern_id FROM prints JOIN roles USING (song_id, track_id) WHERE prints.note_count > 0 AND primary_role = 'bass') AND occurrences >= 2"))
def pattern_search_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, instances = stored(spark, sf_dir)
    likely = roles.role_probabilities(features.track_features(notes_from_orders(spark, sf_dir)))
    return patterns.search(found, instances, roles=likely, role="bass", least=2).select(*SHOWN)


@registered(query(NOTES_B, CHUNKS, PRINTS, STORE, SONGS, """listed AS (SELECT *, row_number() OVER (PARTITION BY pattern_id ORDER BY song_id) AS place FROM places)""",
    """SELECT pattern_id, num_bars, occurrences, string_agg(CAST(l.song_id AS VARCHAR), ',' ORDER BY l.song_id) AS song_ids, coalesce(string_agg(DISTINCT l.artist, ',' ORDER BY l.artist), '') AS artists, coalesce(string_agg(DISTINCT lower(l.segment), ',' ORDER BY lower(l.segment)), '') AS genres
FROM (SELECT * FROM patterns ORDER BY occurrences DESC, pattern_id, num_bars LIMIT 20) p JOIN listed l USING (pattern_id) WHERE place <= 10 GROUP BY 1, 2, 3"""))
def pattern_songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty most common patterns with their first ten songs, and those songs' artists and genres."""
    found, instances = stored(spark, sf_dir)
    rows = patterns.described(patterns.search(found, limit=20), instances, song_rows(spark, sf_dir))
    return rows.select("pattern_id", "num_bars", "occurrences", text("song_ids"), F.array_join("artists", ",").alias("artists"), F.array_join("genres", ",").alias("genres"))


@registered(query(NOTES_B, CHUNKS, PRINTS, STORE, f"SELECT {LIST} FROM patterns ORDER BY occurrences DESC, pattern_id, num_bars LIMIT 50 OFFSET 50"))
def pattern_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.search(stored(spark, sf_dir)[0], offset=50, limit=50).select(*SHOWN)


@registered(query(NOTES_B, CHUNKS, PRINTS, STORE, "SELECT num_bars, count(*) AS patterns, CAST(sum(occurrences) AS BIGINT) AS occurrences, max(occurrences) AS most FROM patterns GROUP BY 1"))
def pattern_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir)[0].groupBy("num_bars").agg(F.count(F.lit(1)).alias("patterns"), F.sum("occurrences").alias("occurrences"), F.max("occurrences").alias("most"))


@registered(query(NOTES_B, CHUNKS, PRINTS, STORE, "SELECT pattern_id, song_id, track_id, chunk_size, start_bar, num_bars FROM prints WHERE note_count > 0"))
def pattern_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir)[1]


#: Targets are the patterns whose id ends so, about one of 85.
TARGETS = ("00", "55", "aa")


@registered(query(NOTES_B, CHUNKS, PRINTS, STORE, f"""placed AS (
    SELECT pattern_id, num_bars, pitch_classes AS pc, list_filter(range(1, len(onset_grid) + 1), lambda k: onset_grid[k] = 1) AS steps, sqrt(list_sum(list_transform(pitch_classes, lambda x: x * x))) AS size FROM patterns
), near AS (
    SELECT t.pattern_id AS target, p.pattern_id, p.num_bars, len(list_intersect(p.steps, t.steps)) AS both_on, len(p.steps) AS a, len(t.steps) AS b, p.pc AS pa, t.pc AS pb, p.size AS sa, t.size AS sb
    FROM placed p JOIN placed t ON right(t.pattern_id, 2) IN {TARGETS} AND p.pattern_id <> t.pattern_id AND len(p.steps) >= 0.59 * len(t.steps) AND len(t.steps) >= 0.59 * len(p.steps)
), rated AS (
    SELECT target, pattern_id, num_bars, (both_on / CAST(a + b - both_on AS DOUBLE) + list_sum(list_transform(list_zip(pa, pb), lambda z: z[1] * z[2])) / (sa * sb)) / 2 AS similarity
    FROM near WHERE both_on >= 0.59 * (a + b - both_on)
)""", f"""SELECT target, pattern_id, num_bars, {r6("similarity", "similarity")} FROM rated WHERE similarity >= 0.8"""))
def find_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cut(stored(spark, sf_dir)[0])
    return rounded(patterns.find_similar(found, found.where(F.right("pattern_id", F.lit(2)).isin(*TARGETS))), "similarity")
