"""Components take no job beside those that write their tables."""

import random

from notewright.llm.components import connected_components
from notewright.llm.lineage import cut_and_count


def test_rows_are_counted_as_they_are_written(spark):
    rows = spark.range(1000, numPartitions=7)
    held, n = cut_and_count(rows, rows.id % 3 == 0)
    assert n == 334 and held.count() == 1000 and cut_and_count(rows)[1] == 1000
    assert cut_and_count(rows.where("id < 0"))[1] == 0


def test_components_of_chains_and_of_nothing(spark, monkeypatch):
    r = random.Random(2)
    nodes = r.sample(range(10_000), 120)
    edges = list(zip(nodes, nodes[1:100], strict=False)) + list(zip(nodes[100:], nodes[101:], strict=False)) + [(7, 7)]
    asked = []
    monkeypatch.setattr(type(spark.range(1)), "isEmpty", lambda df: asked.append(df))
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: min(part) for part in (nodes[:100], nodes[100:]) for n in part} and not asked
    assert connected_components(spark.createDataFrame([(5, 5)], "a long, b long")).collect() == []
