"""From files to the whole analysis."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewright.operators import arpeggios, chords, chunks, features, keys, paths, patterns, roles, sections, timing
from notewright.shared import cut
from notewright.sources import smf


@dataclass
class Analysis:
    """Tables of all songs below a path. The files are decoded once, into events; all else is lazy."""

    events: DataFrame
    songs: DataFrame
    tracks: DataFrame
    notes: DataFrame
    features: DataFrame
    roles: DataFrame
    keys: DataFrame
    chords: DataFrame
    swing: DataFrame
    bars: DataFrame
    sections: DataFrame
    arpeggios: DataFrame
    fingerprints: DataFrame
    clusters: DataFrame
    patterns: DataFrame
    instances: DataFrame
    errors: DataFrame


def analyze(spark: SparkSession, path: str, slugs: DataFrame | None = None) -> Analysis:
    """Analyse all Standard MIDI Files below a path. slugs: (slug, name) of artists, for files that are named by them."""
    events = cut(smf.read_events(spark, path))
    notes = smf.notes(events).drop("start_tick")
    meters = smf.signature_map(events)
    totals = smf.totals(events)
    found = features.track_features(notes, lengths=totals)
    likely = roles.role_probabilities(found)
    files = events.where("kind <> 'error'").select("song_id", "path").distinct()
    songs = paths.songs(files, smf.titles(events), slugs=slugs).join(totals.drop("path"), "song_id", "left")
    bars = sections.bar_features(notes, likely, signatures=meters)
    prints = chunks.fingerprints(notes, signatures=meters)
    stored, instances = patterns.store(prints)
    return Analysis(
        events=events,
        songs=songs,
        tracks=smf.tracks(events),
        notes=notes,
        features=found,
        roles=likely,
        keys=keys.song_keys(notes, likely),
        chords=chords.smooth(chords.detect_chords(chords.song_notes(notes, likely), ["song_id"]), ["song_id"]),
        swing=timing.swing(notes, ["song_id"]),
        bars=bars,
        sections=sections.forms(sections.sections(bars, sections.boundaries(sections.novelty(bars)))),
        arpeggios=arpeggios.windows(notes, signatures=meters),
        fingerprints=prints,
        clusters=patterns.exact_clusters(prints),
        patterns=stored,
        instances=instances,
        errors=events.where("kind = 'error'").select("path", F.col("error").alias("reason")),
    )
