"""The normalised store: songs, their metadata, tracks, features and roles as Parquet tables, written song by song.

A save replaces the songs it brings and leaves the others: each table is laid out by a bucket of song ids, and only buckets that
change are written again (dynamic partition overwrite). Readers see a table's old or new files, bucket by bucket.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("songs", "song_metadata", "tempo_events", "time_signatures", "tracks", "track_features", "track_roles", "patterns", "pattern_instances")
BUCKETS = 64


def bucket(buckets: int = BUCKETS) -> F.Column:
    return F.pmod(F.xxhash64("song_id"), F.lit(buckets)).cast("int")


def save(rows: DataFrame, root: str, table: str, buckets: int = BUCKETS) -> None:
    """Rows of whole songs into a table of the store, in place of what it has of these songs."""
    spark, path = rows.sparkSession, f"{root}/{table}"
    new = rows.withColumn("bucket", bucket(buckets))
    try:
        old = spark.read.parquet(path)
    except Exception as e:  # the table isn't there yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        new.write.partitionBy("bucket").parquet(path)
        return
    touched = [r.bucket for r in new.select("bucket").distinct().collect()]
    stay = old.where(F.col("bucket").isin(touched)).join(rows.select("song_id").distinct(), "song_id", "left_anti")
    # read before the files go: a checkpoint holds what stays
    merged = stay.unionByName(new, allowMissingColumns=True).checkpoint()
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def load(spark: SparkSession, root: str, table: str, song_id: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """A table of the store; of one song only its bucket is read."""
    rows = spark.read.parquet(f"{root}/{table}")
    if song_id is not None:
        own = spark.range(1).select(F.lit(song_id).cast("long").alias("song_id")).select(bucket(buckets)).first()[0]
        rows = rows.where((F.col("bucket") == own) & (F.col("song_id") == song_id))
    return rows.drop("bucket")


def delete(spark: SparkSession, root: str, song_id: int, buckets: int = BUCKETS) -> None:
    """A song out of all tables that are there."""
    for table in TABLES:
        try:
            rows = spark.read.parquet(f"{root}/{table}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            continue
        own = spark.range(1).select(F.lit(song_id).cast("long").alias("song_id")).select(bucket(buckets)).first()[0]
        left = rows.where((F.col("bucket") == own) & (F.col("song_id") != song_id)).checkpoint()
        if left.isEmpty():
            # a bucket without rows can't be overwritten by none: keep the schema in a row that no song has
            left = rows.where(F.col("bucket") == own).limit(1).select(*[F.lit(None).cast(t).alias(c) if c != "bucket" else F.lit(own).alias(c) for c, t in rows.dtypes]).checkpoint()
        left.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{root}/{table}")


def listing(songs: DataFrame, metadata: DataFrame, artist: str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Songs with their metadata. With an artist only those that have it, by artist and title; else, if a limit is given, a page of all, the youngest first (created_at, then
    song_id)."""
    real = songs.where("song_id is not null")
    if artist is not None:
        out, order = real.join(metadata, "song_id").where(F.col("artist").ilike(f"%{artist}%")), ["artist", "title", "song_id"]
        return out.orderBy(*order) if limit is None else out.orderBy(*order).offset(offset).limit(limit)
    out = real.join(metadata, "song_id", "left")
    young = [F.col("created_at").desc()] if "created_at" in songs.columns else []
    return out if limit is None else out.orderBy(*young, "song_id").offset(offset).limit(limit)
