"""Incremental ingest: only files not seen before are decoded, on a Structured Streaming file source that remembers them."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewright.sources import smf

FILES = "path string, modificationTime timestamp, length long, content binary"


def file_key() -> F.Column:
    """What tells a file's version: MD5 of path, size and time."""
    return F.md5(F.concat_ws(":", "path", F.col("length").cast("string"), F.col("modificationTime").cast("string")).cast("binary"))


def unprocessed(files: DataFrame, done: DataFrame) -> DataFrame:
    """Files whose version is not among those done (key)."""
    return files.withColumn("key", file_key()).join(done, "key", "left_anti")


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, per_batch: int = 1000) -> None:
    """Decode all new files below source into event rows, appended under target by day of arrival; stops when no file is left.

    The query's checkpoint holds which files are done, so a run that was broken off goes on where it was; each batch's files are written once.
    """
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.mid*").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch).load(source)

    def write(batch: DataFrame, number: int) -> None:
        smf.decode_files(batch.select("path", "content")).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(target)

    files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def activity(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by kind in tumbling windows with a watermark; the same for streams and tables."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "events", "value")
