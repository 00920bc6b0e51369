"""DuckDB SQL for the note tables, and pieces that several queries share."""

NOTES_A = """
ranked AS (
    SELECT user_id // 10 AS song_id,
        CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS track_id,
        CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CAST(round(value * 100) AS BIGINT) AS v, event_id,
        row_number() OVER (PARTITION BY user_id // 10 ORDER BY ts, event_id) - 1 AS rn
    FROM events
), notes AS (
    SELECT song_id, CAST(track_id AS INTEGER) AS track_id,
        row_number() OVER (PARTITION BY song_id, track_id ORDER BY rn) AS note_seq,
        (rn * 60 + (event_id % 4) * 15) / 480e0 AS start_beat,
        (CASE track_id WHEN 0 THEN 60 WHEN 1 THEN 30 WHEN 2 THEN 60 + (v % 8 + 8) % 8 * 60 WHEN 3 THEN 960 + (v % 4 + 4) % 4 * 480 ELSE 120 + (v % 4 + 4) % 4 * 60 END) / 480e0 AS duration_beats,
        CAST(CASE track_id WHEN 0 THEN 60 + k % 24 WHEN 1 THEN 35 + k % 16 WHEN 2 THEN 28 + k % 24 WHEN 3 THEN 48 + k % 24 ELSE 48 + k % 36 END AS INTEGER) AS pitch,
        CAST(1 + (event_id * 37) % 127 AS INTEGER) AS velocity,
        CAST(CASE WHEN track_id = 1 THEN 9 ELSE track_id END AS INTEGER) AS channel
    FROM ranked
)"""

NOTES_B = """
bars AS (
    SELECT o_custkey // 10 AS song_id, CAST(left(o_orderpriority, 1) AS INTEGER) AS motif,
        CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 5 ELSE 7 END AS shift,
        row_number() OVER (PARTITION BY o_custkey // 10 ORDER BY o_orderdate, o_orderkey) - 1 AS bar
    FROM orders
), notes AS (
    SELECT song_id, 0 AS track_id, bar * 4 + i AS note_seq, bar * 4e0 + i * (1 + motif % 2) * 0.5e0 AS start_beat, 0.5e0 AS duration_beats,
        CAST(48 + shift + (motif * i * 2) % 12 AS INTEGER) AS pitch, 100 AS velocity, 0 AS channel
    FROM bars, (SELECT unnest([0, 1, 2, 3]) AS i)
)"""

FEATURES = """
total AS (SELECT song_id, CAST(floor(max(start_beat + duration_beats) / 4) AS INTEGER) + 1 AS total_bars FROM notes GROUP BY 1),
overs AS (
    SELECT *, coalesce(max(start_beat + duration_beats) OVER (PARTITION BY song_id, track_id ORDER BY start_beat, note_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > start_beat, false) AS over_,
        start_beat - floor(start_beat) AS frac
    FROM notes
), basic AS (
    SELECT song_id, track_id, count(*) AS note_count, min(pitch) AS pitch_min, max(pitch) AS pitch_max, median(pitch) AS pitch_median,
        max(pitch) - min(pitch) AS pitch_range, avg(velocity) AS avg_velocity, avg(duration_beats) AS avg_duration, bool_or(channel = 9) AS is_channel_10,
        max(CASE WHEN over_ THEN 1e0 ELSE 0e0 END) AS polyphony_ratio,
        avg(CASE WHEN (frac > 0.1 AND frac < 0.4) OR (frac > 0.6 AND frac < 0.9) THEN 1e0 ELSE 0e0 END) AS syncopation
    FROM overs GROUP BY 1, 2
), barred AS (SELECT song_id, track_id, floor(start_beat / 4) AS bar, list(pitch ORDER BY note_seq) AS pattern FROM notes GROUP BY 1, 2, 3),
counted AS (SELECT song_id, track_id, pattern, count(*) AS bars, sum(len(pattern)) AS n FROM barred GROUP BY 1, 2, 3),
repeats AS (SELECT song_id, track_id, CASE WHEN sum(n) < 8 OR sum(bars) < 2 THEN 0e0 ELSE count(*) FILTER (bars > 1) / CAST(sum(bars) AS DOUBLE) END AS repetition_score FROM counted GROUP BY 1, 2),
pcs AS (SELECT song_id, track_id, pitch % 12 AS pc, count(*) AS c FROM notes GROUP BY 1, 2, 3),
shares AS (SELECT song_id, track_id, c / CAST(sum(c) OVER (PARTITION BY song_id, track_id) AS DOUBLE) AS p FROM pcs),
entropies AS (SELECT song_id, track_id, -sum(p * log2(p)) / log2(12) AS pitch_class_entropy FROM shares GROUP BY 1, 2),
features AS (
    SELECT b.*, b.note_count / CAST(greatest(t.total_bars, 1) AS DOUBLE) AS note_density, r.repetition_score, e.pitch_class_entropy
    FROM basic b JOIN total t USING (song_id) JOIN repeats r USING (song_id, track_id) JOIN entropies e USING (song_id, track_id)
)"""

ROLES = """
scored AS (
    SELECT song_id, track_id,
        CASE WHEN is_channel_10 THEN 3e0 ELSE 0e0 END + CASE WHEN note_density > 8 THEN 1e0 ELSE 0e0 END + CASE WHEN avg_duration < 0.25 THEN 0.5e0 ELSE 0e0 END
            + CASE WHEN pitch_class_entropy < 0.5 THEN 0.5e0 ELSE 0e0 END + CASE WHEN pitch_range < 48 THEN 0.3e0 ELSE 0e0 END AS s_drums,
        CASE WHEN is_channel_10 THEN 0e0 ELSE CASE WHEN pitch_median < 60 THEN 1.5e0 ELSE 0e0 END + CASE WHEN pitch_max < 72 THEN 0.5e0 ELSE 0e0 END
            + CASE WHEN polyphony_ratio < 0.1 THEN 1e0 WHEN polyphony_ratio < 0.3 THEN 0.3e0 ELSE 0e0 END
            + CASE WHEN note_density > 2 AND note_density < 8 THEN 0.5e0 ELSE 0e0 END + CASE WHEN pitch_range < 24 THEN 0.3e0 ELSE 0e0 END END AS s_bass,
        CASE WHEN is_channel_10 THEN 0e0 ELSE CASE WHEN polyphony_ratio > 0.3 THEN 1.5e0 ELSE 0e0 END + CASE WHEN pitch_median > 48 AND pitch_median < 84 THEN 0.5e0 ELSE 0e0 END
            + CASE WHEN avg_duration > 0.25 AND avg_duration < 2 THEN 0.5e0 ELSE 0e0 END + CASE WHEN note_density > 2 THEN 0.3e0 ELSE 0e0 END END AS s_chords,
        CASE WHEN is_channel_10 THEN 0e0 ELSE CASE WHEN polyphony_ratio > 0.3 THEN 1e0 ELSE 0e0 END + CASE WHEN avg_duration > 2 THEN 1.5e0 ELSE 0e0 END
            + CASE WHEN note_density < 2 THEN 0.5e0 ELSE 0e0 END + CASE WHEN pitch_median > 48 AND pitch_median < 84 THEN 0.3e0 ELSE 0e0 END END AS s_pad,
        CASE WHEN is_channel_10 THEN 0e0 ELSE CASE WHEN polyphony_ratio < 0.1 THEN 1e0 WHEN polyphony_ratio < 0.3 THEN 0.3e0 ELSE 0e0 END
            + CASE WHEN pitch_range > 24 THEN 1e0 ELSE 0e0 END + CASE WHEN pitch_median > 60 THEN 0.5e0 ELSE 0e0 END
            + CASE WHEN syncopation > 0.2 THEN 0.3e0 ELSE 0e0 END + CASE WHEN avg_duration > 0.25 AND avg_duration < 1 THEN 0.3e0 ELSE 0e0 END END AS s_lead,
        CASE WHEN is_channel_10 THEN 0e0 ELSE CASE WHEN note_density > 8 THEN 1.5e0 ELSE 0e0 END + CASE WHEN avg_duration < 0.25 THEN 1e0 ELSE 0e0 END
            + CASE WHEN repetition_score > 0.3 THEN 1e0 ELSE 0e0 END + CASE WHEN polyphony_ratio < 0.3 THEN 0.5e0 ELSE 0e0 END + CASE WHEN pitch_median > 60 THEN 0.3e0 ELSE 0e0 END END AS s_arp
    FROM features
), summed AS (SELECT *, s_drums + s_bass + s_chords + s_pad + s_lead + s_arp AS total FROM scored),
probs AS (
    SELECT song_id, track_id, CASE WHEN total < 0.1 THEN 0e0 ELSE s_drums / total END AS drums, CASE WHEN total < 0.1 THEN 0e0 ELSE s_bass / total END AS bass,
        CASE WHEN total < 0.1 THEN 0e0 ELSE s_chords / total END AS chords, CASE WHEN total < 0.1 THEN 0e0 ELSE s_pad / total END AS pad,
        CASE WHEN total < 0.1 THEN 0e0 ELSE s_lead / total END AS lead, CASE WHEN total < 0.1 THEN 0e0 ELSE s_arp / total END AS arp,
        CASE WHEN total < 0.1 THEN 1e0 ELSE 0e0 END AS other
    FROM summed
), roles AS (
    SELECT *, CASE greatest(drums, bass, chords, pad, lead, arp, other) WHEN drums THEN 'drums' WHEN bass THEN 'bass' WHEN chords THEN 'chords' WHEN pad THEN 'pad'
        WHEN lead THEN 'lead' WHEN arp THEN 'arp' ELSE 'other' END AS primary_role
    FROM probs
)"""


def values(rows: list[tuple], name: str, columns: str) -> str:
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(repr(x) if isinstance(x, str) else str(x) for x in r) + ")" for r in rows) + ")"


def query(*parts: str) -> str:
    """WITH of all parts but the last, which selects."""
    return "WITH " + ",\n".join(p.strip() for p in parts[:-1]) + "\n" + parts[-1].strip()
