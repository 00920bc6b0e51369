"""Queries on tracks: features, roles, timing, keys."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewright.operators import features, keys, roles, timing
from notewright.plans.sql import FEATURES, NOTES_A, ROLES, query, values
from notewright.sources.notes import notes_from_events

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
DIGITS = 6


def registered(sql: str | None = None):
    def keep(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return keep


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Floating columns to six digits, half up on both sides of a comparison."""
    return df.withColumns({c: F.floor(F.col(c) * 10**DIGITS + 0.5) / 10**DIGITS for c in columns})


def r6(expression: str, name: str) -> str:
    return f"floor(({expression}) * 1e6 + 0.5) / 1e6 AS {name}"


FLOATS = ["note_density", "pitch_median", "avg_velocity", "avg_duration", "polyphony_ratio", "syncopation", "repetition_score", "pitch_class_entropy"]


@registered(query(NOTES_A, FEATURES, "SELECT song_id, track_id, note_count, pitch_min, pitch_max, pitch_range, is_channel_10, " + ", ".join(r6(c, c) for c in FLOATS) + " FROM features"))
def track_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.track_features(notes_from_events(spark, sf_dir)), *FLOATS)


ROLE_NAMES = ["drums", "bass", "chords", "pad", "lead", "arp", "other"]


def all_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.role_probabilities(features.track_features(notes_from_events(spark, sf_dir)))


@registered(query(NOTES_A, FEATURES, ROLES, "SELECT song_id, track_id, primary_role, " + ", ".join(r6(c, c) for c in ROLE_NAMES) + " FROM roles"))
def role_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(all_roles(spark, sf_dir), *ROLE_NAMES)


@registered(query(NOTES_A, FEATURES, ROLES, "SELECT primary_role, count(*) AS tracks, count(DISTINCT song_id) AS songs FROM roles GROUP BY 1"))
def clips_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_roles(spark, sf_dir).groupBy("primary_role").agg(F.count(F.lit(1)).alias("tracks"), F.count_distinct("song_id").alias("songs"))


#: Meters and tempos of a song change with its id.
SIGNATURES = [(0.0, 0, 4, 4), (16.0, 4, 3, 4), (40.0, 12, 6, 8)]
TEMPOS = [(0.0, 120.0), (24.0, 90.0), (48.0, 140.0)]


def maps(spark: SparkSession, notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    songs = notes.select("song_id").distinct()
    change = lambda rows, kind: F.explode(F.array(*[F.struct(*[F.lit(x).alias(c) for x, c in zip(r, kind, strict=True)]) for r in rows])).alias("x")
    sig = songs.select("song_id", change(SIGNATURES, ("beat", "bar", "numerator", "denominator"))).select("song_id", "x.*").where("beat = 0 OR song_id % 2 = 0")
    tempo = songs.select("song_id", change(TEMPOS, ("beat", "bpm"))).select("song_id", "x.*").where("beat = 0 OR song_id % 3 = 0")
    return sig, tempo


METER = [
    values(SIGNATURES, "sig_rows", "beat, bar, numerator, denominator"),
    values(TEMPOS, "tempo_rows", "beat, bpm"),
    """songs AS (SELECT DISTINCT song_id FROM notes),
signatures AS (SELECT song_id, CAST(beat AS DOUBLE) AS beat, bar, numerator, denominator FROM songs, sig_rows WHERE beat = 0 OR song_id % 2 = 0),
tempos AS (SELECT song_id, CAST(beat AS DOUBLE) AS beat, CAST(bpm AS DOUBLE) AS bpm FROM songs, tempo_rows WHERE beat = 0 OR song_id % 3 = 0),
metered AS (
    SELECT n.*, s.numerator, s.denominator, s.numerator * 4e0 / s.denominator AS beats_per_bar, s.beat AS sig_beat, s.bar AS sig_bar
    FROM notes n ASOF JOIN signatures s ON n.song_id = s.song_id AND n.start_beat >= s.beat
)""",
]


@registered(
    query(
        NOTES_A,
        *METER,
        """SELECT m.song_id, m.track_id, m.note_seq, CAST(round_even(m.start_beat * 480, 0) AS INTEGER) AS tick, m.numerator, m.denominator, t.bpm,
    CAST(m.sig_bar + floor((m.start_beat - m.sig_beat) / m.beats_per_bar) AS INTEGER) AS bar,
    m.start_beat - m.sig_beat - floor((m.start_beat - m.sig_beat) / m.beats_per_bar) * m.beats_per_bar AS beat_in_bar
FROM metered m ASOF JOIN tempos t ON m.song_id = t.song_id AND m.start_beat >= t.beat""",
    )
)
def timing_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = notes_from_events(spark, sf_dir)
    sig, tempo = maps(spark, notes)
    return timing.timing_context(notes, tempo, sig).select("song_id", "track_id", "note_seq", "tick", "numerator", "denominator", "bpm", "bar", "beat_in_bar")


@registered(
    query(
        NOTES_A,
        *METER,
        """SELECT song_id, track_id, note_seq, round_even(start_beat / (beats_per_bar / 16), 0) * (beats_per_bar / 16) AS quantized_start,
    greatest(beats_per_bar / 16, greatest(1e0, round_even(duration_beats / (beats_per_bar / 16), 0)) * (beats_per_bar / 16)) AS quantized_duration
FROM metered""",
    )
)
def quantized_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = notes_from_events(spark, sf_dir)
    return timing.quantize_notes(notes, maps(spark, notes)[0]).select("song_id", "track_id", "note_seq", "quantized_start", "quantized_duration")


def swing_sql(by: str, order: str) -> str:
    return query(
        NOTES_A,
        f"""gaps AS (
    SELECT {by}, start_beat - floor(start_beat) AS near, lead(start_beat) OVER (PARTITION BY {by} ORDER BY {order}) - start_beat AS gap FROM notes
), samples AS (SELECT {by}, CASE WHEN least(near, 1 - near) < 0.15 AND gap >= 0.3 AND gap <= 0.8 THEN gap END AS s FROM gaps),
stats AS (SELECT {by}, count(*) AS notes, count(s) AS n, avg(s) AS mean, stddev_pop(s) AS spread FROM samples GROUP BY {by}),
rated AS (SELECT *, CASE WHEN notes >= 4 AND n >= 3 THEN mean ELSE 0.5e0 END AS ratio FROM stats)""",
        f"""SELECT {by}, {r6("ratio", "ratio")}, CASE WHEN notes >= 4 THEN n ELSE 0 END AS samples,
    {r6("CASE WHEN notes >= 4 AND n >= 3 THEN greatest(0e0, least(1e0, 1 - 5 * spread)) ELSE 0e0 END", "confidence")},
    CASE WHEN ratio < 0.52 THEN 'straight' WHEN ratio < 0.58 THEN 'light' WHEN ratio < 0.64 THEN 'medium' ELSE 'heavy' END AS style
FROM rated""",
    )


@registered(swing_sql("song_id", "start_beat, track_id, note_seq"))
def swing_by_song(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(timing.swing(notes_from_events(spark, sf_dir), ["song_id"]), "ratio", "confidence")


@registered(swing_sql("song_id, track_id", "start_beat, note_seq"))
def swing_by_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(timing.swing(notes_from_events(spark, sf_dir), ["song_id", "track_id"]), "ratio", "confidence")


HISTOGRAM = """
pc_all AS (SELECT song_id, unnest(range(12)) AS pc, total FROM (SELECT song_id, sum(duration_beats) AS total FROM picked GROUP BY 1)),
pc_sum AS (SELECT song_id, pitch % 12 AS pc, sum(duration_beats) AS w FROM picked GROUP BY 1, 2),
histogram AS (SELECT a.song_id, a.pc, CASE WHEN a.total > 0 THEN coalesce(s.w, 0) / a.total ELSE 0e0 END AS h FROM pc_all a LEFT JOIN pc_sum s USING (song_id, pc))"""
PROFILES = values([(m, k, x) for m, p in (("major", keys.MAJOR), ("minor", keys.MINOR)) for k, x in enumerate(p)], "profiles", "mode, k, p")
CORRELATED = """
centred AS (SELECT song_id, pc, h - avg(h) OVER (PARTITION BY song_id) AS h FROM histogram),
turned AS (SELECT mode, root, k, CAST(p AS DOUBLE) - avg(CAST(p AS DOUBLE)) OVER (PARTITION BY mode, root) AS p FROM profiles, (SELECT unnest(range(12)) AS root)),
correlated AS (
    SELECT song_id, CAST(root AS INTEGER) AS root, mode, CASE WHEN sum(h * h) = 0 THEN 0e0 ELSE sum(h * p) / sqrt(sum(h * h) * sum(p * p)) END AS correlation
    FROM centred JOIN turned ON k = (pc + root) % 12 GROUP BY 1, 2, 3
)"""
ALL_NOTES = "picked AS (SELECT * FROM notes)"
KEYED = """
ordered AS (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY round(correlation, 9) DESC, root * 2 + CASE mode WHEN 'minor' THEN 1 ELSE 0 END) AS place FROM correlated),
keyed AS (
    SELECT a.song_id, a.root, a.mode, a.correlation, greatest(0e0, least(1e0, (a.correlation + 1) / 2 * 0.5 + 0.5 * (a.correlation - b.correlation))) AS confidence,
        ['C', 'C#', 'D', 'D#', 'E', 'F', 'F#', 'G', 'G#', 'A', 'A#', 'B'][a.root + 1] || ' ' || a.mode AS name
    FROM ordered a JOIN ordered b ON a.song_id = b.song_id AND a.place = 1 AND b.place = 2
)"""
NO_DRUMS = """
channels AS (SELECT song_id, track_id, channel, count(*) AS n, min(note_seq) AS first FROM notes GROUP BY 1, 2, 3),
main_channel AS (SELECT song_id, track_id, channel FROM channels QUALIFY row_number() OVER (PARTITION BY song_id, track_id ORDER BY n DESC, first) = 1),
picked AS (SELECT n.* FROM notes n JOIN main_channel m USING (song_id, track_id) JOIN roles r USING (song_id, track_id) WHERE m.channel <> 9 AND r.drums <= 0.5)"""


@registered(query(NOTES_A, ALL_NOTES, HISTOGRAM, f"SELECT song_id, string_agg(CAST(CAST(floor(h * 1e6 + 0.5) AS BIGINT) AS VARCHAR), ',' ORDER BY pc) AS histogram FROM histogram GROUP BY 1"))
def pc_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = keys.histogram(notes_from_events(spark, sf_dir), ["song_id"])
    return shares.select("song_id", F.array_join(F.transform("histogram", lambda x: F.floor(x * 1e6 + 0.5).cast("long").cast("string")), ",").alias("histogram"))


@registered(query(NOTES_A, ALL_NOTES, HISTOGRAM, PROFILES, CORRELATED, f"SELECT song_id, root, mode, {r6('correlation', 'correlation')} FROM correlated"))
def key_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = ["song_id"]
    return rounded(keys.correlations(keys.histogram(notes_from_events(spark, sf_dir), by), by), "correlation")


@registered(query(NOTES_A, FEATURES, ROLES, NO_DRUMS, HISTOGRAM, PROFILES, CORRELATED, KEYED, f"SELECT song_id, root, mode, name, {r6('correlation', 'correlation')}, {r6('confidence', 'confidence')} FROM keyed"))
def song_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = notes_from_events(spark, sf_dir)
    return rounded(keys.song_keys(notes, all_roles(spark, sf_dir)), "correlation", "confidence")


@registered(query(NOTES_A, FEATURES, ROLES, NO_DRUMS, HISTOGRAM, PROFILES, CORRELATED, KEYED, """SELECT song_id, CASE mode WHEN 'major' THEN (root + 9) % 12 ELSE (root + 3) % 12 END AS relative_root,
    CASE mode WHEN 'major' THEN 'minor' ELSE 'major' END AS relative_mode, root AS parallel_root FROM keyed"""))
def relative_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = song_key(spark, sf_dir)
    root, mode = keys.relative_key(F.col("root"), F.col("mode"))
    return found.select("song_id", root.alias("relative_root"), mode.alias("relative_mode"), F.col("root").alias("parallel_root"))
