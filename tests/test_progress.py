"""Progress of an ingest."""

from notewright.sources import smf
from notewright.streaming import progress


def test_batches_report_files_failures_and_rate(spark, tmp_path):
    source, target, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    source.mkdir()
    good = smf.encode([("a", [(0, 1, 0, 60, 90), (480, 0, 0, 60, 0)])])
    for k in range(7):
        (source / f"{k}.mid").write_bytes(good if k % 3 else b"nonsense")
    (source / "notes.txt").write_bytes(b"no score")
    told = []
    progress.ingest(spark, str(source), target, state, told.append, per_batch=3)
    assert [p.done for p in told] == [3, 6, 7] and [p.total for p in told] == [7, 7, 7]
    assert told[-1].failed == 3 and told[-1].percent == 100.0 and told[-1].rate > 0 and told[0].left > 0
    assert spark.read.parquet(target).where("kind = 'error'").count() == 3
    # nothing new: nothing is read again
    again = []
    progress.ingest(spark, str(source), target, state, again.append, per_batch=3)
    assert sum(p.done for p in again) == 0 and not progress.stop(spark)


def test_figures_of_no_files():
    p = progress.Progress(0, 0, 0, None, 0.0)
    assert p.percent == p.rate == 0.0 and p.left is None
