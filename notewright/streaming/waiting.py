"""State of web sources and of cached answers in streams: when a source may be asked next, and when an answer dies.

Both are stateful processors keyed by source or by key, so the state outlives a process with the query's checkpoint, and sources and keys spread over tasks. The state store must be
RocksDB's (`use_state`).
"""

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Seconds that errors make a source wait at most.
CEILING = 300.0
ALLOWED = "source string, question string, asked double, allowed double, waited double, failures int"
LIVES = "key string, event string, body string, at long"


def use_state(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Waiting(StatefulProcessor):
    """Questions are allowed at the latest of when they are asked, `gap` seconds after the one before, and the end of what errors impose: 2 ** n seconds
    after the nth in a row, CEILING at most. A success forgives all."""

    def __init__(self, gaps: dict[str, float], gap: float = 1.0):
        self.gaps, self.gap = gaps, gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("source", "last double, failures int, until double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        (source,) = key
        last, failures, until = self.state.get() if self.state.exists() else (float("-inf"), 0, float("-inf"))
        gap = self.gaps.get(source, self.gap)
        for r in sorted(rows, key=lambda r: (r.at, r.question is None, r.question or "")):
            if r.question is not None:
                allowed = max(r.at, last + gap, until)
                last = allowed
                yield Row(source=source, question=r.question, asked=r.at, allowed=allowed, waited=allowed - r.at, failures=failures)
            elif r.good:
                failures, until = 0, float("-inf")
            else:
                failures += 1
                until = r.at + min(2.0**failures, CEILING)
        self.state.update((last, failures, until))

    def close(self) -> None:
        pass


def allowed(requests: DataFrame, gaps: dict[str, float] | None = None, gap: float = 1.0) -> DataFrame:
    """requests (source, at, question; or, for how one ended, a null question and good) -> ALLOWED: when each question may be asked."""
    rows = requests.select("source", "at", "question", "good")
    return rows.groupBy("source").transformWithState(Waiting(gaps or {}, gap), ALLOWED, "Append", "None")


class Living(StatefulProcessor):
    """Answers that are set live until their time; a timer ends them then, unless they have been set again or deleted."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("answer", "body string, ends long")

    def _drop_timers(self) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        (name,) = key
        for r in sorted(rows, key=lambda r: r.at):
            had = self.state.exists()
            self._drop_timers()
            ends = r.at + (r.lives or 0)
            if r.body is None:
                if had:
                    self.state.clear()
                    yield Row(key=name, event="deleted", body=None, at=r.at)
            else:
                self.state.update((r.body, ends))
                self.handle.registerTimer(ends)
                yield Row(key=name, event="replaced" if had else "set", body=r.body, at=r.at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        (name,) = key
        if self.state.exists():
            body, ends = self.state.get()
            self.state.clear()
            yield Row(key=name, event="expired", body=body, at=ends)

    def close(self) -> None:
        pass


def lives(changes: DataFrame, late: str = "0 seconds") -> DataFrame:
    """changes (key, ts timestamp, body; null to delete, lives: milliseconds) -> LIVES: what became of each key, by the time of ts."""
    rows = changes.withWatermark("ts", late).select("key", "ts", F.unix_millis("ts").alias("at"), "body", "lives")
    return rows.groupBy("key").transformWithState(Living(), LIVES, "Append", "EventTime")
