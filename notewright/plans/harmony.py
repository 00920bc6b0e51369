"""Queries on chords, progressions, arpeggios and sections."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewright.operators import arpeggios, chords, keys, sections
from notewright.operators.features import TRACK
from notewright.plans.sql import FEATURES, NOTES_A, ROLES, query, values
from notewright.plans.tracks import ALL_NOTES, CORRELATED, HISTOGRAM, KEYED, PROFILES, all_roles, r6, rounded
from notewright.sources.notes import notes_from_events

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
SONG = ["song_id"]


def registered(sql: str | None = None):
    def keep(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return keep


WINDOWS = """
bounds AS (SELECT song_id, min(start_beat) AS t0, max(start_beat + duration_beats) AS t1 FROM notes GROUP BY 1),
spread AS (
    SELECT n.*, t0, t1, unnest(range(greatest(CAST(floor(start_beat - t0 - 2) AS BIGINT) + 1, 0), CAST(ceil(start_beat + duration_beats - t0) AS BIGINT))) AS w
    FROM notes n JOIN bounds USING (song_id)
), windows AS (
    SELECT song_id, w AS "window", t0 + w AS w0, t0 + w + 2 AS w1, pitch % 12 AS pc, sum(least(start_beat + duration_beats, t0 + w + 2) - greatest(start_beat, t0 + w)) AS weight, min(pitch) AS low
    FROM spread WHERE t0 + w < t1 GROUP BY 1, 2, 3, 4, 5
)"""
TEMPLATES = values([(k, q, f"[{', '.join(map(str, t))}]") for k, (q, t) in enumerate(chords.TEMPLATES.items())], "template_text", "k, quality, t").replace("'[", "[").replace("]'", "]")
DETECTED = """
templates AS (SELECT k, quality, t FROM template_text),
groups AS (
    SELECT song_id, "window", w0 AS start_beat, w1 AS end_beat, list(pc ORDER BY pc) AS pcs, min(low) % 12 AS low_pc FROM windows GROUP BY 1, 2, 3, 4 HAVING count(*) >= 2
), candidates AS (
    SELECT g.*, w.pc AS root, t.k, t.quality, len(t.t) AS size, w.weight,
        len(list_intersect(list_transform(g.pcs, lambda p: (p - w.pc + 12) % 12), t.t)) AS common, len(g.pcs) AS present
    FROM groups g JOIN windows w USING (song_id, "window"), templates t
), plain AS (
    SELECT *, (common - (present - common) * 0.5e0 - (size - common) * 0.3e0) / CAST(size AS DOUBLE) * (1e0 + weight * 0.1e0) AS score, root * 12 + k AS place FROM candidates
), positive AS (SELECT *, min(place) OVER (PARTITION BY song_id, "window") AS lead FROM plain WHERE score > 0),
best AS (
    SELECT *, CASE WHEN quality = '5' AND place > lead THEN score * 0.8e0 ELSE score END AS final FROM positive
    QUALIFY row_number() OVER (PARTITION BY song_id, "window" ORDER BY final DESC, place) = 1
), detected AS (
    SELECT g.song_id, g."window", g.start_beat, g.end_beat, CAST(coalesce(b.root, 0) AS INTEGER) AS root, coalesce(b.quality, '?') AS quality,
        CASE WHEN g.low_pc <> coalesce(b.root, 0) THEN g.low_pc END AS bass, greatest(0e0, least(1e0, coalesce(b.final, 0))) AS confidence
    FROM groups g LEFT JOIN best b USING (song_id, "window")
)"""
SMOOTHED = """
changes AS (
    SELECT *, CASE WHEN lag(root) OVER s = root AND lag(quality) OVER s = quality THEN 0 ELSE 1 END AS new_run FROM detected WINDOW s AS (PARTITION BY song_id ORDER BY "window")
), runs AS (SELECT *, sum(new_run) OVER (PARTITION BY song_id ORDER BY "window") AS run FROM changes),
smoothed AS (
    SELECT song_id, CAST(run - 1 AS INTEGER) AS position, min(start_beat) AS start_beat, max(end_beat) AS end_beat, arg_min(root, "window") AS root, arg_min(quality, "window") AS quality,
        any_value(first_bass) AS bass, arg_min(confidence, "window") AS confidence
    FROM (SELECT *, first_value(bass) OVER (PARTITION BY song_id, run ORDER BY "window") AS first_bass FROM runs) GROUP BY song_id, run
)"""
NAMES = "['C', 'C#', 'D', 'D#', 'E', 'F', 'F#', 'G', 'G#', 'A', 'A#', 'B']"
NAMED = f"""
named AS (
    SELECT *, {NAMES}[root + 1] || CASE quality WHEN 'major' THEN '' WHEN 'minor' THEN 'm' ELSE quality END || CASE WHEN bass IS NOT NULL THEN '/' || {NAMES}[bass + 1] ELSE '' END AS name
    FROM smoothed
)"""
NUMERALS = f"""
numbered AS (
    SELECT s.*, (s.root - k.root + 12) % 12 AS degree, k.mode FROM smoothed s JOIN keyed k USING (song_id)
), based AS (SELECT *, CASE mode WHEN 'major' THEN {chords.NUMERALS_MAJOR!r}[degree + 1] ELSE {chords.NUMERALS_MINOR!r}[degree + 1] END AS base FROM numbered),
numerals AS (
    SELECT song_id, position, CASE WHEN quality IN ('minor', 'm7', 'dim', 'dim7', 'm7b5') THEN lower(base) ELSE upper(base) END
        || CASE quality WHEN 'dim' THEN '°' WHEN 'aug' THEN '+' WHEN '7' THEN '7' WHEN 'maj7' THEN 'maj7' WHEN 'm7' THEN 'm7' WHEN 'dim7' THEN 'dim7' WHEN 'm7b5' THEN 'm7b5' ELSE '' END AS numeral
    FROM based
)"""


@registered(query(NOTES_A, WINDOWS, 'SELECT song_id, "window", w0 AS start_beat, w1 AS end_beat, pc, weight, low FROM windows'))
def chord_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chords.windows(notes_from_events(spark, sf_dir), SONG)


def detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chords.detect_chords(notes_from_events(spark, sf_dir), SONG)


@registered(query(NOTES_A, WINDOWS, TEMPLATES, DETECTED, f'SELECT song_id, "window", start_beat, end_beat, root, quality, CAST(coalesce(bass, -1) AS INTEGER) AS bass, {r6("confidence", "confidence")} FROM detected'))
def chord_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(detected(spark, sf_dir), "confidence").fillna({"bass": -1})


@registered(query(NOTES_A, WINDOWS, TEMPLATES, DETECTED, SMOOTHED, f"SELECT song_id, position, start_beat, end_beat, root, quality, CAST(coalesce(bass, -1) AS INTEGER) AS bass, {r6('confidence', 'confidence')} FROM smoothed"))
def chord_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(chords.smooth(detected(spark, sf_dir), SONG), "confidence").fillna({"bass": -1})


@registered(query(NOTES_A, WINDOWS, TEMPLATES, DETECTED, SMOOTHED, NAMED, """SELECT song_id, string_agg(name, ' ' ORDER BY position) AS chord_names
FROM (SELECT *, lag(name) OVER (PARTITION BY song_id ORDER BY position) AS before FROM named) WHERE before IS NULL OR before <> name GROUP BY 1"""))
def chord_simplify(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = chords.simplified(chords.smooth(detected(spark, sf_dir), SONG), SONG)
    return names.select("song_id", F.array_join("names", " ").alias("chord_names"))


def numerals(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = keys.detect_keys(notes_from_events(spark, sf_dir), SONG).select("song_id", F.col("root").alias("key_root"), "mode")
    smooth = chords.smooth(detected(spark, sf_dir), SONG).join(key, "song_id")
    return smooth.select("song_id", "position", chords.roman_numeral(F.col("root"), F.col("quality"), F.col("key_root"), F.col("mode")).alias("numeral"))


@registered(query(NOTES_A, ALL_NOTES, HISTOGRAM, PROFILES, CORRELATED, KEYED, WINDOWS, TEMPLATES, DETECTED, SMOOTHED, NUMERALS, "SELECT song_id, position, numeral FROM numerals"))
def roman_numerals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numerals(spark, sf_dir)


LISTED = "listed AS (SELECT song_id, ' ' || string_agg(numeral, ' ' ORDER BY position) || ' ' AS text FROM numerals GROUP BY 1)"
FOUND = "CASE " + " ".join(f"WHEN contains(text, ' {p} ') THEN '{n}'" for n, p in ((n, ' '.join(p)) for n, p in chords.PROGRESSIONS.items())) + " END"


@registered(query(NOTES_A, ALL_NOTES, HISTOGRAM, PROFILES, CORRELATED, KEYED, WINDOWS, TEMPLATES, DETECTED, SMOOTHED, NUMERALS, LISTED, f"SELECT song_id, coalesce({FOUND}, 'none') AS progression FROM listed"))
def progression_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = numerals(spark, sf_dir).groupBy("song_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "numeral"))), lambda x: x["numeral"]).alias("numerals"))
    return chords.match_progression(listed, SONG).select("song_id", F.coalesce("progression", F.lit("none")).alias("progression"))


ARPS = """
placed AS (
    SELECT n.*, CAST(floor((start_beat - t0) / 4) AS BIGINT) AS "window", t0 FROM notes n JOIN (SELECT song_id, track_id, min(start_beat) AS t0 FROM notes GROUP BY 1, 2) USING (song_id, track_id)
), grouped AS (
    SELECT song_id, track_id, "window", min(t0 + "window" * 4) AS start_beat, count(*) AS notes, list(pitch ORDER BY start_beat, note_seq) AS pitches, list_sort(list_distinct(list(pitch % 12))) AS pcs,
        avg(duration_beats) AS avg_duration, (max(start_beat) - min(start_beat)) / (count(*) - 1) AS delta
    FROM placed GROUP BY 1, 2, 3 HAVING count(*) >= 4
), tried AS (
    SELECT song_id, track_id, "window", root, quality, root * 12 + k AS place,
        len(list_intersect(list_transform(pcs, lambda p: (p - root + 12) % 12), t)) / CAST(len(t) AS DOUBLE)
            - (len(pcs) - len(list_intersect(list_transform(pcs, lambda p: (p - root + 12) % 12), t))) * 0.1e0 AS score
    FROM grouped, (SELECT unnest(range(12)) AS root), template_text WHERE len(pcs) >= 3
), chosen AS (SELECT * FROM tried WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY song_id, track_id, "window" ORDER BY score DESC, place) = 1),
arps AS (
    SELECT g.song_id, g.track_id, g."window", g.start_beat, g.notes, c.root, c.quality, CASE WHEN c.score IS NOT NULL THEN least(1e0, c.score) END AS confidence,
        list_transform(g.pitches, lambda p: (p - c.root + 120) % 12) AS intervals, list_transform(g.pitches, lambda p: p // 12 - list_min(g.pitches) // 12) AS octaves,
        CASE WHEN delta <= 0.15625 THEN '1/32' WHEN delta <= 0.234375 THEN '1/16T' WHEN delta <= 0.3125 THEN '1/16' WHEN delta <= 0.46875 THEN '1/8T' WHEN delta <= 0.625 THEN '1/8' WHEN delta <= 0.9375 THEN '1/4T' ELSE '1/4' END AS rate,
        CASE WHEN delta > 0 THEN least(1e0, avg_duration / delta) END AS gate
    FROM grouped g LEFT JOIN chosen c USING (song_id, track_id, "window")
)"""


def arp_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arpeggios.windows(notes_from_events(spark, sf_dir))


def text(column: str) -> F.Column:
    return F.array_join(F.transform(column, lambda x: x.cast("string")), ",").alias(column)


@registered(query(NOTES_A, TEMPLATES, ARPS, f"""SELECT song_id, track_id, "window", start_beat, notes, CAST(coalesce(root, -1) AS INTEGER) AS root, coalesce(quality, '?') AS quality,
    {r6("coalesce(confidence, 0)", "confidence")}, coalesce(array_to_string(intervals, ','), '') AS intervals, CASE WHEN root IS NULL THEN '' ELSE array_to_string(octaves, ',') END AS octaves, rate, {r6("coalesce(gate, -1)", "gate")} FROM arps"""))
def arp_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = arp_rows(spark, sf_dir).fillna({"root": -1, "quality": "?", "confidence": 0.0, "gate": -1.0})
    return rounded(rows.select(*TRACK, "window", "start_beat", "notes", "root", "quality", "confidence", F.coalesce(text("intervals"), F.lit("")).alias("intervals"), F.coalesce(text("octaves"), F.lit("")).alias("octaves"), "rate", "gate"), "confidence", "gate")


@registered(query(NOTES_A, TEMPLATES, ARPS, f"""rates AS (SELECT song_id, track_id, rate FROM arps GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY song_id, track_id ORDER BY count(*) DESC, min("window")) = 1),
shapes AS (SELECT song_id, track_id, array_to_string(intervals[1:8], ',') AS p FROM arps WHERE root IS NOT NULL GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY song_id, track_id ORDER BY count(*) DESC, min("window")) = 1)""",
    f"SELECT a.song_id, a.track_id, count(*) AS windows, {r6('coalesce(avg(a.gate), 0.5)', 'avg_gate')}, any_value(r.rate) AS dominant_rate, coalesce(any_value(s.p), '') AS dominant_pattern FROM arps a JOIN rates r USING (song_id, track_id) LEFT JOIN shapes s USING (song_id, track_id) GROUP BY 1, 2"))
def arp_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = arpeggios.analysis(arp_rows(spark, sf_dir))
    return rounded(found.select(*TRACK, "windows", "avg_gate", "dominant_rate", F.coalesce(text("dominant_pattern"), F.lit("")).alias("dominant_pattern")), "avg_gate")


@registered(query(NOTES_A, TEMPLATES, ARPS, f"""SELECT song_id, track_id, array_to_string(intervals[1:8], ',') AS intervals, array_to_string(octaves[1:8], ',') AS octaves, min("window") AS "window",
    arg_min(rate, "window") AS rate, {r6('arg_min(coalesce(gate, 0.5), "window")', "gate")} FROM arps WHERE root IS NOT NULL GROUP BY 1, 2, 3, 4"""))
def arp_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = arpeggios.patterns(arp_rows(spark, sf_dir))
    return rounded(found.select(*TRACK, text("intervals"), text("octaves"), "window", "rate", "gate"), "gate")


@registered(query(NOTES_A, TEMPLATES, ARPS, f"""SELECT song_id, track_id, "window", array_to_string(intervals[1:8], ',') AS intervals, array_to_string(octaves[1:8], ',') AS octaves, rate, {r6("avg_gate", "avg_gate")}
FROM (SELECT *, coalesce(avg(gate) OVER (PARTITION BY song_id, track_id), 0.5) AS avg_gate FROM arps) WHERE confidence >= 0.5"""))
def arp_confident(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = arpeggios.confident_patterns(arp_rows(spark, sf_dir))
    return rounded(found.select(*TRACK, "window", text("intervals"), text("octaves"), "rate", "avg_gate"), "avg_gate")


DENSITIES = [f"density_{r}" for r in sections.ROLES]
BARS = f"""
section_roles AS (
    SELECT song_id, track_id, bass > 0.5 AS is_bass, CASE WHEN greatest(bass, drums, lead, pad, arp, chords) > 0.3 THEN
        CASE greatest(bass, drums, lead, pad, arp, chords) WHEN bass THEN 'bass' WHEN drums THEN 'drums' WHEN lead THEN 'lead' WHEN pad THEN 'pad' WHEN arp THEN 'arp' ELSE 'chords' END ELSE 'other' END AS role
    FROM roles
), every AS (SELECT song_id, CAST(unnest(range(CAST(ceil(max(start_beat + duration_beats) / 4) AS BIGINT))) AS INTEGER) AS bar FROM notes GROUP BY 1),
in_bars AS (
    SELECT n.*, r.role, r.is_bass, CAST(floor(start_beat / 4) AS INTEGER) AS bar FROM notes n JOIN section_roles r USING (song_id, track_id)
), bass_steps AS (SELECT song_id, bar, pitch % 12 AS pc, lag(pitch % 12) OVER (PARTITION BY song_id, bar ORDER BY start_beat, track_id, note_seq) AS before FROM in_bars WHERE is_bass),
rhythm AS (SELECT song_id, bar, CAST(count(*) FILTER (pc <> before) AS INTEGER) AS harmonic_rhythm FROM bass_steps GROUP BY 1, 2),
bar_counts AS (
    SELECT song_id, bar, CAST(count(DISTINCT track_id) AS INTEGER) AS active_tracks, CAST(count(*) AS INTEGER) AS note_count, avg(velocity) AS avg_velocity, max(pitch) - min(pitch) AS pitch_range,
        CAST(count(DISTINCT pitch) AS INTEGER) AS unique_pitches, {", ".join(f"count(*) FILTER (role = '{r}') / 4e0 AS density_{r}" for r in sections.ROLES)}
    FROM in_bars GROUP BY 1, 2
), bars AS (
    SELECT song_id, bar, {", ".join(f"coalesce({c}, 0) AS {c}" for c in ("active_tracks", "note_count", "avg_velocity", "pitch_range", "unique_pitches", "harmonic_rhythm", *DENSITIES))}
    FROM every LEFT JOIN bar_counts USING (song_id, bar) LEFT JOIN rhythm USING (song_id, bar)
)"""
VECTOR = "[" + ", ".join(f"CAST({x} AS FLOAT)" for x in ("active_tracks / 16e0", "note_count / 100e0", *DENSITIES, "harmonic_rhythm / 4e0", "avg_velocity / 127e0", "pitch_range / 88e0", "unique_pitches / 12e0")) + "]"
NOVEL = f"""
vectors AS (SELECT *, {VECTOR} AS v FROM bars),
steps AS (SELECT *, lag(v) OVER (PARTITION BY song_id ORDER BY bar) AS u FROM vectors),
novel AS (SELECT * EXCLUDE (u, v), CASE WHEN u IS NULL THEN 0e0 ELSE sqrt(list_sum(list_transform(list_zip(v, u), lambda z: CAST(z[1] - z[2] AS DOUBLE) * CAST(z[1] - z[2] AS DOUBLE)))) END AS novelty FROM steps)"""
BOUNDARIES = """
limits AS (SELECT song_id, avg(novelty) FILTER (bar > 0) + 1.5 * stddev_pop(novelty) FILTER (bar > 0) AS lim, CAST(count(*) AS INTEGER) AS total_bars FROM novel GROUP BY 1),
peaks AS (
    SELECT song_id, bar FROM (SELECT song_id, bar, novelty, lag(novelty) OVER s AS prior, lead(novelty) OVER s AS next FROM novel WINDOW s AS (PARTITION BY song_id ORDER BY bar)) JOIN limits USING (song_id)
    WHERE bar > 0 AND next IS NOT NULL AND novelty > lim AND novelty >= prior AND novelty >= next
), taken(song_id, bar) AS (
    SELECT song_id, 0 FROM limits
    UNION ALL
    SELECT t.song_id, (SELECT min(p.bar) FROM peaks p WHERE p.song_id = t.song_id AND p.bar >= t.bar + 4) FROM taken t WHERE EXISTS (SELECT 1 FROM peaks p WHERE p.song_id = t.song_id AND p.bar >= t.bar + 4)
)"""
SECTIONS = f"""
cuts AS (
    SELECT song_id, CAST(row_number() OVER (PARTITION BY song_id ORDER BY bar) - 1 AS INTEGER) AS section, bar AS start_bar, coalesce(lead(bar) OVER (PARTITION BY song_id ORDER BY bar), total_bars) AS end_bar
    FROM taken JOIN limits USING (song_id) WHERE total_bars >= 4
), sections AS (
    SELECT song_id, section, start_bar, end_bar, {", ".join(f"CAST(trunc(avg({c})) AS INTEGER) AS {c}" for c in ("active_tracks", "note_count", "pitch_range", "unique_pitches", "harmonic_rhythm"))},
        avg(avg_velocity) AS avg_velocity, {", ".join(f"avg({c}) AS {c}" for c in DENSITIES)}
    FROM cuts JOIN bars USING (song_id) WHERE bar >= start_bar AND bar < end_bar AND end_bar - start_bar >= 2 GROUP BY 1, 2, 3, 4
)"""


def bars_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.bar_features(notes_from_events(spark, sf_dir), all_roles(spark, sf_dir))


@registered(query(NOTES_A, FEATURES, ROLES, BARS, f"SELECT song_id, bar, active_tracks, note_count, pitch_range, unique_pitches, harmonic_rhythm, {r6('avg_velocity', 'avg_velocity')}, {', '.join(DENSITIES)}, bar * 4e0 AS start_beat FROM bars"))
def bar_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bars_of(spark, sf_dir), "avg_velocity")


@registered(query(NOTES_A, FEATURES, ROLES, BARS, NOVEL, f"SELECT song_id, bar, {r6('novelty', 'novelty')} FROM novel"))
def bar_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sections.novelty(bars_of(spark, sf_dir)).select("song_id", "bar", "novelty"), "novelty")


def found_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = bars_of(spark, sf_dir)
    return sections.sections(bars, sections.boundaries(sections.novelty(bars)))


@registered(query(NOTES_A, FEATURES, ROLES, BARS, NOVEL, BOUNDARIES, "SELECT song_id, string_agg(CAST(bar AS VARCHAR), ',' ORDER BY bar) AS boundaries FROM taken GROUP BY 1").replace("WITH ", "WITH RECURSIVE ", 1))
def section_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.boundaries(sections.novelty(bars_of(spark, sf_dir))).select("song_id", text("boundaries"))


@registered(query(NOTES_A, FEATURES, ROLES, BARS, NOVEL, BOUNDARIES, SECTIONS, f"SELECT song_id, section, start_bar, end_bar, active_tracks, note_count, pitch_range, unique_pitches, harmonic_rhythm, {r6('avg_velocity', 'avg_velocity')}, {', '.join(r6(c, c) for c in DENSITIES)} FROM sections").replace("WITH ", "WITH RECURSIVE ", 1))
def section_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(found_sections(spark, sf_dir), "avg_velocity", *DENSITIES)


GAP = "sqrt(list_sum(list_transform(list_zip({0}, {1}), lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) ** 2)))"
FORMS = f"""
places AS (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY section) AS place, {VECTOR} AS v FROM sections),
led(song_id, place, leaders, letter) AS (
    SELECT song_id, place, [v], CAST(0 AS BIGINT) FROM places WHERE place = 1
    UNION ALL
    SELECT song_id, place, CASE WHEN apart THEN list_append(leaders, v) ELSE list_transform(leaders, lambda c, i: CASE WHEN i = near THEN list_transform(list_zip(c, v), lambda z: CAST(z[1] * CAST(0.8 AS FLOAT) + z[2] * CAST(0.2 AS FLOAT) AS FLOAT)) ELSE c END) END,
        CASE WHEN apart THEN len(leaders) ELSE near - 1 END
    FROM (
        SELECT *, list_position(gaps, list_min(gaps)) AS near, list_min(gaps) > lim AND len(leaders) < {sections.FORMS} AS apart FROM (
            SELECT p.song_id, p.place, l.leaders, p.v, list_transform(l.leaders, lambda c: {GAP.format("c", "p.v")}) AS gaps,
                CASE WHEN len(l.leaders) > 1 THEN 0.7e0 * list_min(flatten(list_transform(l.leaders, lambda a, i: list_transform(l.leaders[1:i - 1], lambda b: {GAP.format("a", "b")})))) ELSE 0.5e0 END AS lim
            FROM led l JOIN places p ON p.song_id = l.song_id AND p.place = l.place + 1))
), labelled AS (SELECT p.*, chr(CAST(65 + letter AS INTEGER)) AS form FROM places p JOIN led USING (song_id, place)),
told(song_id, place, builds, drops) AS (
    SELECT song_id, place, false, false FROM labelled WHERE place = 1
    UNION ALL
    SELECT b.song_id, b.place, b.note_count > 1.3e0 * a.note_count AND b.active_tracks > a.active_tracks AND NOT (t.builds AND b.note_count > a.note_count), t.builds AND b.note_count > a.note_count
    FROM told t JOIN labelled a ON a.song_id = t.song_id AND a.place = t.place JOIN labelled b ON b.song_id = t.song_id AND b.place = t.place + 1
), form_counts AS (SELECT song_id, form, row_number() OVER (PARTITION BY song_id ORDER BY count(*) DESC, min(place)) AS rank FROM labelled GROUP BY 1, 2),
hinted AS (
    SELECT l.song_id, l.section, l.start_bar, l.end_bar, l.form, CASE
        WHEN t.drops THEN 'drop' WHEN l.note_count < 0.4e0 * before AND l.density_drums < 0.5 THEN 'breakdown' WHEN t.builds THEN 'build'
        WHEN l.place = of AND l.note_count < 0.7e0 * before THEN 'outro' WHEN l.place = 1 AND (l.note_count < 20 OR l.active_tracks < 3) THEN 'intro'
        WHEN rank = 1 THEN 'verse' WHEN rank = 2 THEN 'chorus' ELSE 'bridge' END AS hint
    FROM (SELECT *, lag(note_count) OVER (PARTITION BY song_id ORDER BY place) AS before, count(*) OVER (PARTITION BY song_id) AS of FROM labelled) l JOIN told t USING (song_id, place) JOIN form_counts c ON c.song_id = l.song_id AND c.form = l.form
)"""
SURE = "CASE hint WHEN 'drop' THEN 0.7e0 WHEN 'breakdown' THEN 0.6e0 WHEN 'intro' THEN 0.6e0 WHEN 'build' THEN 0.5e0 WHEN 'outro' THEN 0.5e0 WHEN 'bridge' THEN 0.3e0 ELSE 0.4e0 END"


@registered(query(NOTES_A, FEATURES, ROLES, BARS, NOVEL, BOUNDARIES, SECTIONS, FORMS, f"SELECT song_id, section, start_bar, end_bar, form, hint, {SURE} AS hint_confidence FROM hinted").replace("WITH ", "WITH RECURSIVE ", 1))
def section_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.forms(found_sections(spark, sf_dir))
