"""Queries that put several operators together: bars under meters, panels, schedules and song summaries."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from notewright.operators import chords, export, features, keys, meter, patterns, sections
from notewright.operators.features import TRACK
from notewright.plans.harmony import BARS, BOUNDARIES, DETECTED, FORMS, NAMED, NOVEL, SECTIONS, SMOOTHED, TEMPLATES, WINDOWS, bars_of, found_sections
from notewright.plans.repeats import CHUNKS, CLUSTERS, PRINTS, STORE, prints, stored
from notewright.plans.sql import FEATURES, NOTES_A, NOTES_B, ROLES, query
from notewright.plans.tracks import CORRELATED, HISTOGRAM, KEYED, METER, NO_DRUMS, PROFILES, all_roles, maps
from notewright.sources.notes import notes_from_events

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def registered(sql: str | None = None):
    def keep(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return keep


@registered(
    query(
        NOTES_A,
        *METER[:2],
        METER[2].split("metered AS")[0].rstrip().rstrip(","),
        """every AS (SELECT song_id, CAST(unnest(range(CAST(floor(max(start_beat + duration_beats) / 4) AS BIGINT) + 1)) AS INTEGER) AS bar FROM notes GROUP BY 1),
lengths AS (
    SELECT *, numerator * 4e0 / denominator AS bpb, coalesce((bar - lag(bar) OVER w) * (lag(numerator) OVER w * 4e0 / lag(denominator) OVER w), 0) AS before
    FROM signatures WINDOW w AS (PARTITION BY song_id ORDER BY bar)
), starts AS (SELECT *, sum(before) OVER (PARTITION BY song_id ORDER BY bar) AS sig_start FROM lengths)""",
        "SELECT e.song_id, e.bar, s.bpb AS beats_per_bar, s.sig_start + (e.bar - s.bar) * s.bpb AS start_beat FROM every e ASOF JOIN starts s ON e.song_id = s.song_id AND e.bar >= s.bar",
    )
)
def bars_with_meter(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = notes_from_events(spark, sf_dir)
    bars = features.song_bars(notes).select("song_id", F.explode(F.sequence(F.lit(0), F.col("total_bars") - 1)).alias("bar"))
    return meter.bars_with_meter(bars, maps(spark, notes)[0]).select("song_id", "bar", "beats_per_bar", "start_beat")


@registered(query(NOTES_B, CHUNKS, PRINTS, """SELECT song_id, track_id, chunk_size, start_bar, array_to_string(onset_grid, '') AS onsets,
    coalesce(array_to_string(list_transform(contour, lambda x: CASE WHEN x > 0 THEN 'U' WHEN x < 0 THEN 'D' ELSE 'S' END), ''), '') AS shape FROM prints WHERE note_count > 0"""))
def text_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second family of fingerprints: onsets louder than a tenth as a binary text, the contour in letters."""
    found = prints(spark, sf_dir).where("note_count > 0")
    onsets = F.array_join(F.transform("accent_grid", lambda a: F.when(a > 0.1, "1").otherwise("0")), "")
    shape = F.array_join(F.transform("contour", lambda x: F.when(x > 0, "U").when(x < 0, "D").otherwise("S")), "")
    return found.select(*TRACK, "chunk_size", "start_bar", onsets.alias("onsets"), shape.alias("shape"))


@registered(query(NOTES_B, CHUNKS, PRINTS, STORE, "SELECT i.song_id, i.track_id, i.start_bar, i.pattern_id, i.num_bars, p.occurrences FROM prints i JOIN patterns p USING (pattern_id, rhythm_hash, pitch_hash, num_bars) WHERE i.note_count > 0"))
def instances_for_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, instances = stored(spark, sf_dir)
    return instances.join(found.select("pattern_id", "num_bars", "occurrences"), ["pattern_id", "num_bars"]).select(*TRACK, "start_bar", "pattern_id", "num_bars", "occurrences")


@registered(query(NOTES_B, CHUNKS, PRINTS, CLUSTERS, """SELECT song_id, track_id, chunk_size, pattern_id, occurrences, CAST(place AS INTEGER) AS place FROM (
    SELECT *, row_number() OVER (PARTITION BY song_id, track_id ORDER BY occurrences DESC, chunk_size DESC, pattern_id) AS place FROM clusters WHERE occurrences >= 2 AND chunk_size <= 8) WHERE place <= 20"""))
def pattern_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    clusters = patterns.repeated(patterns.exact_clusters(prints(spark, sf_dir, (1, 2, 4, 8))))
    place = F.row_number().over(W.partitionBy(*TRACK).orderBy(F.col("occurrences").desc(), F.col("chunk_size").desc(), "pattern_id"))
    return clusters.withColumn("place", place).where("place <= 20").select(*TRACK, "chunk_size", "pattern_id", "occurrences", "place")


@registered(query(NOTES_A, """drums AS (SELECT song_id, track_id, bool_or(channel = 9) AS drum FROM notes GROUP BY 1, 2),
placed AS (SELECT *, sum(CASE WHEN drum THEN 0 ELSE 1 END) OVER (PARTITION BY song_id ORDER BY track_id) - 1 AS place FROM drums),
channels AS (SELECT song_id, track_id, CAST(CASE WHEN drum THEN 9 WHEN place % 15 < 9 THEN place % 15 ELSE place % 15 + 1 END AS INTEGER) AS out_channel FROM placed),
onoff AS (
    SELECT song_id, track_id, CAST(trunc(start_beat * 480) AS INTEGER) AS tick, 1 AS kind, pitch, note_seq FROM notes
    UNION ALL SELECT song_id, track_id, CAST(trunc((start_beat + duration_beats) * 480) AS INTEGER), 0, pitch, note_seq FROM notes
)""", "SELECT o.song_id, o.track_id, CAST(row_number() OVER (PARTITION BY o.song_id, o.track_id ORDER BY tick, kind, note_seq, pitch) AS INTEGER) AS position, kind, pitch, out_channel, floor(tick / 480e0 * 60e0 / 120e0 * 1e6 + 0.5) / 1e6 AS seconds FROM onoff o JOIN channels USING (song_id, track_id)"))
def playback_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = export.schedule(notes_from_events(spark, sf_dir))
    return rows.select(*TRACK, "position", "kind", "pitch", "out_channel", (F.floor(F.col("seconds") * 1e6 + 0.5) / 1e6).alias("seconds"))


@registered(query(NOTES_A, FEATURES, ROLES, BARS, NOVEL, BOUNDARIES, SECTIONS,
    "inside AS (SELECT n.* REPLACE (n.song_id * 1000 + c.section AS song_id) FROM notes n JOIN sections c ON c.song_id = n.song_id AND floor(n.start_beat / 4) >= c.start_bar AND floor(n.start_beat / 4) < c.end_bar)",
    WINDOWS.replace("FROM notes", "FROM inside"), TEMPLATES, DETECTED, SMOOTHED, NAMED, """SELECT song_id // 1000 AS song_id, CAST(song_id % 1000 AS INTEGER) AS section, string_agg(name, ' ' ORDER BY position) AS chord_names
FROM (SELECT *, lag(name) OVER (PARTITION BY song_id ORDER BY position) AS before FROM named) WHERE before IS NULL OR before <> name GROUP BY song_id""").replace("WITH ", "WITH RECURSIVE ", 1))
def section_chords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chord names of each section, from the notes that begin in it."""
    notes = notes_from_events(spark, sf_dir)
    cuts = found_sections(spark, sf_dir).select("song_id", "section", F.explode(F.sequence("start_bar", F.col("end_bar") - 1)).alias("bar"))
    inside = notes.withColumn("bar", F.floor(F.col("start_beat") / 4).cast("int")).join(cuts, ["song_id", "bar"])
    by = ["song_id", "section"]
    names = chords.simplified(chords.smooth(chords.detect_chords(inside, by), by), by)
    return names.select(*by, F.array_join("names", " ").alias("chord_names"))


@registered(query(NOTES_A, FEATURES, ROLES, NO_DRUMS, HISTOGRAM, PROFILES, CORRELATED, KEYED, BARS, NOVEL, BOUNDARIES, SECTIONS, FORMS, """SELECT song_id, notes, tracks, total_bars, roles, coalesce(key, '') AS key, coalesce(form, '') AS form
FROM (SELECT song_id, count(*) AS notes, count(DISTINCT track_id) AS tracks FROM notes GROUP BY 1) JOIN total USING (song_id)
    JOIN (SELECT song_id, string_agg(primary_role, ',' ORDER BY primary_role) AS roles FROM roles GROUP BY 1) USING (song_id)
    LEFT JOIN (SELECT song_id, name AS key FROM keyed) USING (song_id)
    LEFT JOIN (SELECT song_id, string_agg(form, '' ORDER BY section) AS form FROM labelled GROUP BY 1) USING (song_id)""").replace("WITH ", "WITH RECURSIVE ", 1))
def song_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each song its key, bars, notes, tracks by role, and form."""
    notes = notes_from_events(spark, sf_dir)
    roles = all_roles(spark, sf_dir)
    counts = notes.groupBy("song_id").agg(F.count(F.lit(1)).alias("notes"), F.count_distinct("track_id").alias("tracks"))
    by_role = roles.groupBy("song_id").agg(F.array_join(F.array_sort(F.collect_list("primary_role")), ",").alias("roles"))
    key = keys.song_keys(notes, roles).select("song_id", F.col("name").alias("key"))
    bars = bars_of(spark, sf_dir)
    form = sections.forms(sections.sections(bars, sections.boundaries(sections.novelty(bars)))).groupBy("song_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "form"))), lambda x: x["form"]), "").alias("form"))
    out = counts.join(features.song_bars(notes), "song_id").join(by_role, "song_id")
    return out.join(key, "song_id", "left").join(form, "song_id", "left").fillna("", ["key", "form"])
