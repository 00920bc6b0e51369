"""The pipeline over a small corpus, and the registry."""

from collections import Counter

import corpus_pipeline
import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from notewright.llm import quality, queries

DATA = "/root/testdata/sf0.001"


def test_stages_do_what_they_say(spark, tmp_path):
    documents = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = pd.read_parquet(f"{DATA}/labels.parquet")
    docs, seen = documents, [documents.toPandas()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == documents.columns
        seen.append(docs.toPandas())
    raw, good, short, apart, mixed, pieces = seen
    judged = good.merge(labels, on="doc_id")
    assert (judged.quality == 1).mean() > 0.95 and (judged.quality == 1).sum() >= (labels.quality == 1).sum() - 1
    assert set(short.doc_id) == set(good.doc_id) and short.n_chars.sum() < good.n_chars.sum()
    assert set(apart.doc_id) < set(short.doc_id) and apart.doc_id.is_unique
    assert max(Counter(mixed.doc_id).values()) <= 2 and set(mixed.doc_id) <= set(apart.doc_id)
    assert (pieces.groupby("sequence_id").length.sum() <= 2048).all()
    assert (pieces[pieces.start == 0].groupby("doc_id").size() == mixed.groupby("doc_id").size()).all()


CLASHES = ["given", "given_", "_given_length", "copy", "copies", "size", "source_size", "target", "n_lines", "n_removed_lines", "n_removed_chunks", "row", "cut", "marks", "text_", "label", "mark", "whole", "lead", "part", "key", "n", "rank"]
ODD = [(1, None, "a"), (2, "", "a"), (3, " \n\t\n", None), (4, "one two three four five six", "a"), (4, "one two three four five six", "a"), (None, "of no id\nand two lines", "b"), (5, "tie\nrow\nhere", "b"), (6, "tie\nrow\nhere", "b"), (7, "\n".join(f"line {k} of a long text" for k in range(9000)), "c")]


def odd(spark, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    full = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows]
    out = spark.createDataFrame(full, schema)
    # a figure of its own in every clashing column
    return out.withColumns({c: F.concat(F.lit(f"{c} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))) for c in CLASHES})


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_keep_columns_of_any_name(spark, tmp_path, name, stage):
    odd(spark, ODD).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    out = stage(spark, docs, DATA)
    rows = out.collect()
    assert rows
    if name == "packing":
        assert {r.doc_id for r in rows} == {i for i, _, _ in ODD}
        return
    assert out.columns == docs.columns
    for r in rows:
        assert all(r[c] == f"{c} {'?' if r.doc_id is None else r.doc_id}" for c in CLASHES)
    if name != "line_dedup":
        assert {(r.doc_id, r.text, r.n_chars) for r in rows} <= {(i, t, None if t is None else len(t)) for i, t, _ in ODD}
    else:
        assert sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i, _, _ in ODD)
        assert [r.text for r in rows if r.doc_id == 6] == [""] and [r.n_chars for r in rows if r.doc_id == 6] == [0]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_on_an_empty_table(spark, tmp_path, name, stage):
    odd(spark, []).write.parquet(str(tmp_path / "d"))
    assert stage(spark, spark.read.parquet(str(tmp_path / "d")), DATA).collect() == []


def test_training_rows_are_bounded_and_repeated_rows_count_once(spark):
    rows = [(k, f"text {k} of words", "a") for k in range(40)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] * 3, "doc_id long, label int")
    once = quality.train(odd(spark, rows), labels)
    assert quality.train(odd(spark, rows + rows[:5] * 50), labels) == once
    many = odd(spark, [(1, f"text {k} of one id", "a") for k in range(500)])
    assert quality.train(many, labels, sample=20) is not None


def test_run_gives_pieces(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracles(spark, name):
    c = duckdb.connect()
    for t in ("conversations", "embeddings", "documents"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    mine, theirs = queries.QUERIES[name](spark, DATA).toPandas(), c.sql(queries.ORACLE_SQL[name]).df()
    columns = sorted(mine.columns)
    assert columns == sorted(theirs.columns)
    key = lambda d: d[columns].astype(str).sort_values(columns).reset_index(drop=True)
    assert key(mine).equals(key(theirs))


def test_every_operator_is_registered():
    assert [sum(q.startswith(f"op{n}_") for q in queries.QUERIES) for n in range(1, 11)] == [1] * 10
