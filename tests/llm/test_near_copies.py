"""Near copies by shingle sets against brute force, and the pipeline's stage."""

import random

import corpus_pipeline
import pytest
from test_texts import LOW, WORD, docs

from notewright.llm import near_copies


def shingles(text):
    w = WORD.findall((text or "").translate(LOW))
    return {" ".join(w[k : k + 5]) for k in range(max(len(w) - 4, min(len(w), 1)))}


def firsts(rows, least=0.8):
    """Ids and texts of the first row of each component, by comparing all pairs. Rows are in the order of their ids."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if root[a] != root[b] and (sets[a] == sets[b] or len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least):
                low, high = sorted((root[a], root[b]))
                root = [low if x == high else x for x in root]
    return [rows[k] for k in range(len(rows)) if root[k] == k]


def planted(seed):
    """Texts of 60 to 250 words, each with copies that differ in up to six words, some in a chain; and odd cases."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(5000)}"
    texts = []
    for _ in range(40):
        body = [word() for _ in range(r.randint(60, 250))]
        texts.append(" ".join(body))
        for _ in range(r.randint(0, 4)):
            near = list(body)
            for _ in range(r.randint(1, 6)):
                near[r.randrange(len(near))] = word()
            texts.append(" ".join(near))
            if r.random() < 0.4:
                body = near
    r.shuffle(texts)
    texts += [None, "", " \n", "a b", "A  b", "a c", texts[0].upper(), texts[1]]
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", [1, 2])
def test_the_stage_keeps_one_of_each_group_of_near_copies(spark, tmp_path, seed):
    rows = planted(seed)
    docs(spark, rows).write.parquet(str(tmp_path / "d"))
    kept = corpus_pipeline.drop_near_duplicates(spark, spark.read.parquet(str(tmp_path / "d")), "")
    want = firsts(rows)
    assert sorted((r.doc_id, str(r.text)) for r in kept.collect()) == [(i, str(t)) for i, t in want]
    assert len(want) < len(rows) - 30


def test_repeated_rows_and_null_ids(spark, tmp_path):
    docs(spark, [(5, "a b c d"), (2, "a b c d"), (None, "a b c d"), (2, "a b c d"), (7, "other words are here"), (None, "null ids only"), (None, "null ids only")]).write.parquet(str(tmp_path / "d"))
    kept = near_copies.keep_first(spark.read.parquet(str(tmp_path / "d")))
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == [("2", "a b c d"), ("7", "other words are here"), ("None", "null ids only")]


def test_empty_table(spark, tmp_path):
    docs(spark, []).write.parquet(str(tmp_path / "d"))
    assert near_copies.keep_first(spark.read.parquet(str(tmp_path / "d"))).count() == 0


def test_rows_are_labelled_once_and_then_only_parts(spark, tmp_path, monkeypatch):
    """The second search for components meets labels of the first and rows of their own, never the rows' links again."""
    rows, calls, of = planted(1), [], near_copies.connected_components

    def watched(edges):
        out = of(edges)
        calls.append(({x for r in edges.collect() for x in r}, {r.node: r.component for r in out.collect()}))
        return out

    monkeypatch.setattr(near_copies, "connected_components", watched)
    docs(spark, rows).write.parquet(str(tmp_path / "d"))
    assert sorted(r.doc_id for r in near_copies.keep_first(spark.read.parquet(str(tmp_path / "d"))).collect()) == [i for i, _ in firsts(rows)]
    (_, first), (parts, _) = calls
    assert len(first) > 50 and all(first.get(x, x) == x for x in parts)
