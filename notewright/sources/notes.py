"""Note tables derived from the driver's event and order tables, so that queries run over data that grows with them."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TRACKS = ["click", "error", "purchase", "signup"]


def by_song(rows: DataFrame, song: str) -> DataFrame:
    """rows with their song_id, all of a song in one of the session's shuffle partitions, whose number stays: notes grow to many times these rows, so
    their size is no reason to put partitions together. The number of a song is a column before it partitions, so what follows by song needs no other exchange."""
    return rows.withColumn("song_id", F.expr(song)).repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "song_id")


def notes_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A song for ten users, a track for each kind of event; notes follow one another an eighth of a beat apart."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    track = F.lit(4)
    for k in reversed(range(4)):
        track = F.when(F.col("event_type") == TRACKS[k], k).otherwise(track)
    ranked = by_song(events, "user_id div 10").select(
        "song_id",
        track.cast("int").alias("track_id"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.round(F.col("value") * 100).cast("long").alias("v"),
        "event_id",
        (F.row_number().over(W.partitionBy("song_id").orderBy("ts", "event_id")) - 1).alias("rn"),
    )

    def by_track(*values):
        return F.element_at(F.array(*values), F.col("track_id") + 1)

    k, v = F.col("k"), F.col("v")
    return ranked.select(
        "song_id",
        "track_id",
        F.row_number().over(W.partitionBy("song_id", "track_id").orderBy("rn")).cast("long").alias("note_seq"),
        ((F.col("rn") * 60 + F.pmod("event_id", F.lit(4)) * 15) / F.lit(480.0)).alias("start_beat"),
        (by_track(F.lit(60).cast("long"), F.lit(30).cast("long"), 60 + F.pmod(v, F.lit(8)) * 60, 960 + F.pmod(v, F.lit(4)) * 480, 120 + F.pmod(v, F.lit(4)) * 60) / F.lit(480.0)).alias("duration_beats"),
        by_track(60 + k % 24, 35 + k % 16, 28 + k % 24, 48 + k % 24, 48 + k % 36).cast("int").alias("pitch"),
        (1 + F.pmod(F.col("event_id") * 37, F.lit(127))).cast("int").alias("velocity"),
        F.when(F.col("track_id") == 1, 9).otherwise(F.col("track_id")).cast("int").alias("channel"),
    )


def notes_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A song for ten customers, one bar of four notes for each order; few motifs, so bars repeat."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    bars = by_song(orders, "o_custkey div 10").select(
        "song_id",
        F.substring("o_orderpriority", 1, 1).cast("int").alias("motif"),
        F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 5).otherwise(7).alias("shift"),
        (F.row_number().over(W.partitionBy("song_id").orderBy("o_orderdate", "o_orderkey")) - 1).cast("long").alias("bar"),
    )
    # after the numbering, as a generator beside a window would come before it
    bars = bars.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(3))))
    return bars.select(
        "song_id",
        F.lit(0).alias("track_id"),
        (F.col("bar") * 4 + F.col("i")).alias("note_seq"),
        (F.col("bar") * 4.0 + F.col("i") * (1 + F.col("motif") % 2) * 0.5).alias("start_beat"),
        F.lit(0.5).alias("duration_beats"),
        (48 + F.col("shift") + (F.col("motif") * F.col("i") * 2) % 12).cast("int").alias("pitch"),
        F.lit(100).alias("velocity"),
        F.lit(0).alias("channel"),
    )
