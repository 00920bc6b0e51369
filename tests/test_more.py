"""Smaller pieces: names inside files, merging genres, exports and streams."""

import json

from pyspark.sql import functions as F

from notewright.operators import export, library, meter, paths
from notewright.schema import NOTES
from notewright.sources import smf
from notewright.streaming import ingest


def test_titles_from_inside_a_file(spark):
    data = smf.encode([("some-file-name-20230130.mid", []), ("Real Title", [])])
    e = smf.decode_files(spark.createDataFrame([("/x/a.mid", bytearray(data))], "path string, content binary"))
    assert smf.titles(e).first().title == "Real Title"


def test_names_that_look_like_files_and_copyright(spark):
    row = spark.createDataFrame([("a-b-c-d", "\u00a9 1999 The Band", "Song One")], "f string, c string, t string").select(
        paths.looks_like_filename(F.col("f")).alias("f"), paths.looks_like_filename(F.col("t")).alias("t"), paths.from_copyright(F.col("c")).alias("c")
    )
    assert tuple(row.first()) == (True, False, "The Band")


def test_genres_are_added_in_order_and_once(spark):
    rows = spark.createDataFrame([("1_0", "A", ["rock"]), ("2_0", "B", None)], "clip_id string, artist string, genres array<string>")
    found = spark.createDataFrame([("A", ["pop", "rock"])], "artist string, genres array<string>")
    got = {r.clip_id: list(r.genres) for r in library.add_genres(rows, found).collect()}
    assert got == {"1_0": ["rock", "pop"], "2_0": []}


def test_export(spark):
    n = spark.createDataFrame([(1, 0, k, s, d, p, v, 0) for k, (p, v, s, d) in enumerate([(36, 100, 0.0, 1.0), (38, 90, 1.0, 1.0), (40, 80, 2.0, 2.0), (41, 85, 4.0, 1.0)])], NOTES)
    assert [(r.pitch, r.start_beat) for r in export.extract(n, 1, 2).collect()] == [(41, 0.0)]
    assert export.transform(n, transpose=100, velocity=2.0).agg(F.max("pitch"), F.max("velocity")).first()[:] == (127, 127)
    ticks = [(r.tick, r.kind) for r in export.events(n).orderBy("position").collect()]
    assert ticks[:3] == [(0, 1), (480, 0), (480, 1)]
    assert len(json.loads(export.as_json(n).first().json)) == 4
    assert export.duration_seconds(n).first().seconds == 2.5
    row = spark.range(1).select(export.program(F.lit("bass"), 4), export.program(F.lit("bass"), 6), export.program(F.lit("chords")), export.program(F.lit("?"), 3), export.instrument_name(F.lit(33)), export.instrument_name(F.lit(200)))
    assert tuple(row.first()) == (38, 33, 4, 0, "Electric Bass (finger)", "Program 200")


def test_bars_under_meters(spark):
    bars = spark.createDataFrame([(1, b) for b in range(4)] + [(2, 3)], "song_id long, bar int")
    sig = spark.createDataFrame([(1, 0.0, 0, 4, 4), (1, 8.0, 2, 3, 4)], "song_id long, beat double, bar int, numerator int, denominator int")
    got = {(r.song_id, r.bar): (r.start_beat, r.beats_per_bar) for r in meter.bars_with_meter(bars, sig).collect()}
    assert got == {(1, 0): (0.0, 4.0), (1, 1): (4.0, 4.0), (1, 2): (8.0, 3.0), (1, 3): (11.0, 3.0), (2, 3): (12.0, 4.0)}


def test_windowed_counts_of_a_stream_equal_those_of_a_table(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    events.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    q = ingest.activity(stream, "1 day").writeStream.format("memory").queryName("activity").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda df: sorted((r.start, r.event_type, r.events) for r in df.collect())
    assert key(spark.table("activity")) == key(ingest.activity(events, "1 day"))
