"""Waiting by source and lives of answers as state of streams."""

import datetime

import pytest

from notewright.streaming import waiting


@pytest.fixture(autouse=True)
def rocks(spark):
    waiting.use_state(spark)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def run(spark, tmp_path, schema, batches, build):
    """Rows of each batch that a stream over a growing folder puts out; the query stops after each batch and goes on from its checkpoint."""
    source, out = tmp_path / "in", []
    source.mkdir()
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(source))
        stream = spark.readStream.schema(schema).json(str(source))
        got = []
        write = build(stream).writeStream.outputMode("append").foreachBatch(lambda df, _: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "state"))
        write.trigger(availableNow=True).start().awaitTermination()
        out.append(got)
    return out


def test_questions_wait_for_gaps_and_errors_over_restarts(spark, tmp_path):
    ask = lambda source, at, q: (source, float(at), q, None)
    ended = lambda source, at, good: (source, float(at), None, good)
    batches = [
        [ask("a", 0, "q1"), ask("a", 0.5, "q2"), ask("b", 0, "q3"), ask("b", 0.1, "q4")],
        [ask("a", 1.2, "q5"), ended("b", 2, False), ended("b", 2.5, False), ask("b", 3, "q6")],
        [ended("b", 7, True), ask("b", 7.5, "q7"), *[ended("a", 10 + k, False) for k in range(12)], ask("a", 30, "q8")],
    ]
    got = run(spark, tmp_path, "source string, at double, question string, good boolean", batches, lambda s: waiting.allowed(s, {"b": 0.25}))
    when = {r.question: r.allowed for batch in got for r in batch}
    assert when == {"q1": 0.0, "q2": 1.0, "q5": 2.0, "q3": 0.0, "q4": 0.25, "q6": 2.5 + 4, "q7": 7.5, "q8": 21 + waiting.CEILING}


def test_answers_die_by_timer_unless_set_again(spark, tmp_path):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    rows = lambda *xs: [(k, at(s).isoformat(), b, lives) for k, s, b, lives in xs]
    batches = [rows(("x", 0, "one", 5000), ("y", 0, "two", 60000), ("z", 1, "three", 5000)), rows(("z", 3, None, None), ("y", 4, "four", 2000)), rows(("w", 30, "five", 1000)), rows(("v", 90, "six", 1000))]
    got = run(spark, tmp_path, "key string, ts timestamp, body string, lives long", [[(k, datetime.datetime.fromisoformat(s), b, n) for k, s, b, n in batch] for batch in batches], waiting.lives)
    events = sorted((r.key, r.event, r.body) for batch in got for r in batch if r.key in "xyz")
    assert events == [("x", "expired", "one"), ("x", "set", "one"), ("y", "expired", "four"), ("y", "replaced", "four"), ("y", "set", "two"), ("z", "deleted", None), ("z", "set", "three")]
