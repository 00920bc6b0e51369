"""Standard MIDI Files as DataFrames: reading, pairing notes, timing maps, and writing.

A file is decoded event by event in an Arrow batch; everything after that (pairing of note-ons and offs, tempo and meter maps, track
names, totals) is windows and groupings over the event table. A file that can't be decoded gives one row with its error.
"""

import struct
from collections.abc import Callable, Container, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EVENTS = "path string, song_id string, format int, ppq int, track_id int, seq long, tick long, kind string, channel int, data1 int, data2 int, text string, error string"
META = {1: "text", 2: "copyright", 3: "track_name", 47: "end_of_track", 81: "set_tempo", 88: "time_signature"}
#: Columns of EVENTS as Arrow types; events that a batch holds about.
ARROW = pa.schema([(name, {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}[kind]) for name, kind in (f.split(" ") for f in EVENTS.split(", "))])
BATCH = 65_536
#: Kinds of events that decoding gives, besides error.
KINDS = (*META.values(), "note_on", "note_off", "end")
#: Data bytes of channel messages by their high nibble.
LENGTHS = {0x8: 2, 0x9: 2, 0xA: 2, 0xB: 2, 0xC: 1, 0xD: 1, 0xE: 2}


def _number(data: bytes, at: int) -> tuple[int, int]:
    """A variable-length number and the place behind it."""
    value = 0
    while True:
        byte = data[at]
        value, at = value << 7 | byte & 127, at + 1
        if byte < 128:
            return value, at


def decode(data: bytes, tracks_wanted: Container[int] | None = None) -> Iterator[tuple]:
    """(format, ppq, track, seq, tick, kind, channel, data1, data2, text) of every event that matters, of the tracks wanted (all, if None).
    Raises ValueError; what is wrong inside a track that isn't wanted goes unseen."""
    if data[:4] != b"MThd":
        raise ValueError("not a MIDI file")
    size, kind, tracks, ppq = struct.unpack(">IHHH", data[4:14])
    if ppq & 0x8000:
        raise ValueError("SMPTE time is not supported")
    at, track = 8 + size, 0
    while track < tracks and at + 8 <= len(data):
        name, length = data[at : at + 4], struct.unpack(">I", data[at + 4 : at + 8])[0]
        body, at = data[at + 8 : at + 8 + length], at + 8 + length
        if name != b"MTrk":
            continue
        if len(body) < length:
            raise ValueError("a track is cut short")
        if tracks_wanted is not None and track not in tracks_wanted:
            track += 1
            continue
        # numbered from the track on, so that they don't depend on what else is decoded
        k, tick, status, seq = 0, 0, 0, track << 32
        while k < len(body):
            delta, k = _number(body, k)
            tick += delta
            if body[k] >= 0x80:
                status, k = body[k], k + 1
            elif not status:
                raise ValueError("a data byte stands where a status byte is due")
            seq += 1
            if status == 0xFF:
                what = body[k]
                n, k = _number(body, k + 1)
                value, k = body[k : k + n], k + n
                label = META.get(what)
                if label == "set_tempo":
                    yield kind, ppq, track, seq, tick, label, None, int.from_bytes(value[:3], "big"), None, None
                elif label == "time_signature":
                    yield kind, ppq, track, seq, tick, label, None, value[0], 1 << value[1], None
                elif label:
                    yield kind, ppq, track, seq, tick, label, None, None, None, value.decode("latin-1")
                status = 0
            elif status in (0xF0, 0xF7):
                n, k = _number(body, k)
                k += n
                status = 0
            elif status >> 4 in LENGTHS:
                n = LENGTHS[status >> 4]
                values, k = body[k : k + n], k + n
                if len(values) < n:
                    raise ValueError("an event is cut short")
                if status >> 4 in (0x8, 0x9):
                    on = status >> 4 == 0x9 and values[1] > 0
                    yield kind, ppq, track, seq, tick, "note_on" if on else "note_off", status & 15, values[0], values[1], None
            else:
                raise ValueError(f"unknown status {status:#x}")
        # the track's length counts also events that are not kept
        seq += 1
        yield kind, ppq, track, seq, tick, "end", None, None, None, None
        track += 1


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The events of all .mid and .midi files below a path; song_id is the start of the path's MD5."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.lower("path").rlike(r"\.midi?$"))
    return decode_files(files.select("path", "content"))


def event_batches(files: Iterator[tuple[str, str, Callable[[], bytes]]], tracks_wanted: Container[int] | None = None, kinds: Container[str] | None = None) -> Iterator[pa.RecordBatch]:
    """Batches of EVENTS of (path, song_id, content) files, about BATCH events each; kinds: those wanted, if not all. A file that can't be read or decoded is
    one row of kind error."""

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)

    held: list[tuple] = []
    for path, song, content in files:
        try:
            rows = [(path, song, *event, None) for event in decode(content(), tracks_wanted) if kinds is None or event[5] in kinds]
        except (ValueError, IndexError, struct.error, OSError) as e:
            rows = [(path, song, None, None, None, None, None, "error", None, None, None, None, str(e))] if kinds is None or "error" in kinds else []
        held += rows
        if len(held) >= BATCH:
            yield packed(held)
            held = []
    if held:
        yield packed(held)


def song_id(path: F.Column) -> F.Column:
    """A song is known by the start of its path's MD5."""
    return F.substring(F.md5(path.cast("binary")), 1, 12)


def decode_files(files: DataFrame) -> DataFrame:
    """files (path, content) -> EVENTS."""
    clean = F.regexp_replace("path", "^file:(//)?", "")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = ((path.as_py(), song.as_py(), content.as_py) for b in batches for path, song, content in zip(*(b.column(c) for c in ("path", "song_id", "content")), strict=True))
        return event_batches(given)

    return files.select(clean.alias("path"), song_id(clean).alias("song_id"), "content").mapInArrow(scan, EVENTS)


def notes(events: DataFrame) -> DataFrame:
    """Paired notes: a note-on that the next event of its pitch and channel ends. A second on before the off replaces the first, and what is
    never ended is dropped. note_seq follows the offs."""
    w = W.partitionBy("song_id", "track_id", "channel", "data1").orderBy("seq")
    marked = events.where(F.col("kind").isin("note_on", "note_off")).withColumns({"off_kind": F.lead("kind").over(w), "off_tick": F.lead("tick").over(w), "off_seq": F.lead("seq").over(w)})
    good = marked.where("kind = 'note_on' AND off_kind = 'note_off'")
    return good.select(
        "song_id",
        "track_id",
        F.col("off_seq").alias("note_seq"),
        (F.col("tick") / F.col("ppq")).alias("start_beat"),
        ((F.col("off_tick") - F.col("tick")) / F.col("ppq")).alias("duration_beats"),
        F.col("data1").alias("pitch"),
        F.col("data2").alias("velocity"),
        "channel",
        F.col("tick").alias("start_tick"),
    )


def tempo_map(events: DataFrame) -> DataFrame:
    """(song_id, tick, beat, bpm, micros): the first tempo counts from beat 0; without any, 120. Type 1 files are read in their first track only."""
    w = W.partitionBy("song_id").orderBy("track_id", "seq")
    found = events.where("kind = 'set_tempo' AND (format <> 1 OR track_id = 0)")
    beat = F.when(F.row_number().over(w) == 1, 0.0).otherwise((F.col("tick") - F.first("tick").over(w)) / F.col("ppq") + F.first(F.col("tick") / F.col("ppq")).over(w))
    rows = found.select("song_id", "tick", beat.alias("beat"), (60e6 / F.col("data1")).alias("bpm"), F.col("data1").alias("micros"))
    return _or_default(rows, events, {"tick": 0, "beat": 0.0, "bpm": 120.0, "micros": 500000})


def signature_map(events: DataFrame) -> DataFrame:
    """(song_id, tick, beat, bar, numerator, denominator): bars advance by whole bars of the meter before; without any, 4/4."""
    w = W.partitionBy("song_id").orderBy("track_id", "seq")
    found = events.where("kind = 'time_signature' AND (format <> 1 OR track_id = 0)").withColumn("beat", F.col("tick") / F.col("ppq"))
    step = F.coalesce(((F.col("beat") - F.lag("beat").over(w)) / (F.lag("data1").over(w) * 4.0 / F.lag("data2").over(w))).cast("int"), F.lit(0))
    rows = found.withColumn("step", step).select("song_id", "tick", "beat", F.sum("step").over(w).cast("int").alias("bar"), F.col("data1").alias("numerator"), F.col("data2").alias("denominator"))
    return _or_default(rows, events, {"tick": 0, "beat": 0.0, "bar": 0, "numerator": 4, "denominator": 4})


def _or_default(rows: DataFrame, events: DataFrame, default: dict) -> DataFrame:
    songs = events.where("kind <> 'error'").select("song_id").distinct()
    return songs.join(rows, "song_id", "left").fillna(default)


def tracks(events: DataFrame) -> DataFrame:
    """(song_id, track_id, name, primary_channel) of the tracks with notes: the first name, the commonest channel (the first of equals)."""
    name = events.where("kind = 'track_name'").groupBy("song_id", "track_id").agg(F.min_by("text", "seq").alias("name"))
    channels = notes(events).groupBy("song_id", "track_id", "channel").agg(F.count(F.lit(1)).alias("n"), F.min("note_seq").alias("first"))
    main = channels.groupBy("song_id", "track_id").agg(F.max_by("channel", F.struct("n", -F.col("first"))).alias("primary_channel"))
    return main.join(name, ["song_id", "track_id"], "left").fillna({"name": ""})


def totals(events: DataFrame) -> DataFrame:
    """(song_id, path, ppq, total_beats, total_bars): bars of the last meter to the longest track's end, and one."""
    length = events.where("kind <> 'error'").groupBy("song_id").agg(F.max(F.col("tick") / F.col("ppq")).alias("total_beats"), F.first("path").alias("path"), F.first("ppq").alias("ppq"))
    last = signature_map(events).groupBy("song_id").agg(F.max_by(F.struct("beat", "bar", "numerator", "denominator"), "beat").alias("s"))
    bar = F.col("s.bar") + ((F.col("total_beats") - F.col("s.beat")) / (F.col("s.numerator") * 4.0 / F.col("s.denominator"))).cast("int") + 1
    return length.join(last, "song_id").select("song_id", "path", "ppq", "total_beats", bar.cast("int").alias("total_bars"))


def titles(events: DataFrame) -> DataFrame:
    """(song_id, title, copyright): the first track name that doesn't look like a file's, and the last copyright line."""
    from notewright.operators.paths import looks_like_filename

    title = F.min_by("text", F.struct("track_id", "seq"))
    names = events.where(F.col("kind") == "track_name").where(~looks_like_filename(F.col("text"))).groupBy("song_id").agg(title.alias("title"))
    rights = events.where("kind = 'copyright'").groupBy("song_id").agg(F.max_by("text", F.struct("track_id", "seq")).alias("copyright"))
    return names.join(rights, "song_id", "full")


def _vlq(n: int) -> bytes:
    out = [n & 127]
    while n := n >> 7:
        out.append(n & 127 | 128)
    return bytes(reversed(out))


def encode(tracks: list[tuple[str, list[tuple[int, int, int, int, int]]]], bpm: float = 120.0, meter: tuple[int, int] = (4, 4), ppq: int = 480) -> bytes:
    """A type 1 file: a conductor track and one for each (name, events), an event being (tick, kind, channel, pitch, velocity) in order."""

    def chunk(body: bytes) -> bytes:
        body += b"\x00\xff\x2f\x00"
        return b"MTrk" + struct.pack(">I", len(body)) + body

    conductor = b"\x00\xff\x51\x03" + int(60e6 / bpm).to_bytes(3, "big") + b"\x00\xff\x58\x04" + bytes([meter[0], meter[1].bit_length() - 1, 24, 8])
    out = b"MThd" + struct.pack(">IHHH", 6, 1, len(tracks) + 1, ppq) + chunk(conductor)
    for name, rows in tracks:
        label = name.encode("latin-1", "replace")
        body, at = b"\x00\xff\x03" + _vlq(len(label)) + label, 0
        for tick, kind, channel, pitch, velocity in rows:
            body, at = body + _vlq(tick - at) + bytes([(0x90 if kind else 0x80) | channel, pitch, velocity]), tick
        out += chunk(body)
    return out


def encode_songs(notes: DataFrame, bpm: float = 120.0) -> DataFrame:
    """(song_id, content): each song's notes as a file. Spark orders the events; the bytes are put together song by song."""
    from notewright.operators.export import events as timed

    channel = notes.groupBy("song_id", "track_id").agg(F.min_by("channel", "note_seq").alias("channel"))
    rows = timed(notes).join(channel, ["song_id", "track_id"])
    kind = dict(notes.dtypes)["song_id"]

    def write(table: pa.Table) -> pa.Table:
        listed: dict[int, list] = {}
        for r in sorted(table.to_pylist(), key=lambda r: (r["track_id"], r["position"])):
            listed.setdefault(r["track_id"], []).append((r["tick"], r["kind"], r["channel"], r["pitch"], r["velocity"]))
        return pa.table([table.column("song_id").slice(0, 1), pa.array([encode([(f"Track {k}", v) for k, v in listed.items()], bpm)], pa.binary())], ["song_id", "content"])

    return rows.groupBy("song_id").applyInArrow(write, f"song_id {kind}, content binary")
