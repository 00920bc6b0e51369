"""Progress of an ingest: files done and failed, per cent and rate after each batch, from metrics that the batch's own pass observes."""

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from notewright.sources import smf
from notewright.streaming.ingest import FILES


@dataclass(frozen=True)
class Progress:
    """After a batch: files read so far (failed ones included), those that failed, of how many (if known), and seconds since the start."""

    batch: int
    done: int
    failed: int
    total: int | None
    seconds: float

    @property
    def percent(self) -> float:
        return 0.0 if not self.total else 100.0 * self.done / self.total

    @property
    def rate(self) -> float:
        """Files a second."""
        return 0.0 if self.seconds <= 0 else self.done / self.seconds

    @property
    def left(self) -> float | None:
        """Seconds that the rest takes at this rate."""
        return None if not self.total or not self.done else (self.total - self.done) / self.rate if self.rate else None


class Watch(StreamingQueryListener):
    """Adds up the metrics `files` and `events` of the query of a name, and reports after each batch."""

    def __init__(self, name: str, total: int | None, report: Callable[[Progress], None], clock: Callable[[], float] = time.monotonic):
        self.name, self.total, self.report, self.clock = name, total, report, clock
        self.start, self.done, self.failed, self.run = clock(), 0, 0, None
        self.ended = threading.Event()

    def onQueryStarted(self, event) -> None:
        if event.name == self.name:
            self.run = str(event.runId)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.name != self.name or "files" not in p.observedMetrics:
            return
        self.done += p.observedMetrics["files"].files or 0
        self.failed += p.observedMetrics["events"].failed or 0
        self.report(Progress(p.batchId, self.done, self.failed, self.total, self.clock() - self.start))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if str(event.runId) == self.run:
            self.ended.set()


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, report: Callable[[Progress], None], name: str = "ingest", per_batch: int = 1000, total: int | None = None) -> None:
    """Decode all new files below source into event rows under target, as `streaming.ingest.ingest` does, and report after each batch. `stop` by the query's name ends
    it between batches; a later run goes on from there. total: how many files there are, counted if not given (those of earlier runs included)."""
    shape = {"pathGlobFilter": "*.{mid,midi}", "recursiveFileLookup": "true"}
    if total is None:
        total = spark.read.format("binaryFile").options(**shape).load(source).select("path").count()
    files = spark.readStream.format("binaryFile").schema(FILES).options(**shape).option("maxFilesPerTrigger", per_batch).load(source)
    events = smf.decode_files(files.observe("files", F.count(F.lit(1)).alias("files")).select("path", "content"))
    seen = events.observe("events", F.count_if(F.col("kind") == "error").alias("failed"))

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(target)

    watch = Watch(name, total, report)
    spark.streams.addListener(watch)
    try:
        seen.writeStream.queryName(name).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        # the listener hears of the last batch a little later
        watch.ended.wait(30)
    finally:
        spark.streams.removeListener(watch)


def stop(spark: SparkSession, name: str = "ingest") -> bool:
    """End the query of that name; whether there was one."""
    found = [q for q in spark.streams.active if q.name == name]
    for q in found:
        q.stop()
    return bool(found)
