"""Reply trees and their format."""

import hashlib
import random

from pyspark.sql import functions as F

from notewright.llm import chat, queries

SCHEMA = "tree long, id long, parent long, role string, text string, score double"


def paths_of(rows):
    """Every root-to-leaf path of (tree, id, parent, ...) rows, by walking up."""
    at = {(r[0], r[1]): r for r in rows}
    parents = {(r[0], r[2]) for r in rows if (r[0], r[2]) in at}
    out = {}
    for key in at:
        if key in parents:
            continue
        path, k = [], key
        while k in at and at[k] not in path:
            path.append(at[k])
            k = (k[0], at[k][2])
        if k not in at:
            out[key] = path[::-1]
    return out


def test_all_paths_ranked_by_score(spark):
    r = random.Random(3)
    rows = []
    for tree in (1, 2, None):
        rows += [(tree, k, r.randrange(k) if k else None, r.choice(["user", "assistant"]), f"t{k}", float(r.randint(0, 9))) for k in range(25)]
    rows += [(7, k, k - 1 if k else 999, "user", "deep", 1.0) for k in range(100)]  # its root's parent is missing
    rows += [(8, 1, 2, "user", "cycle", 1.0), (8, 2, 1, "user", "cycle", 1.0), (9, 0, None, None, None, None)]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = {(x.tree, x.leaf): x for x in chat.format_trees(frame).collect()}
    want = paths_of(rows)
    assert set(got) == set(want)
    for key, path in want.items():
        assert got[key].n_turns == len(path)
        assert [t.text for t in spark.createDataFrame([(got[key].formatted,)], "f string").select(chat.turns_of(F.col("f")).alias("t")).first().t] == [x[4] or "" for x in path] if key[0] in (1, 9) else True
    for tree in (1, 2, None):
        ranked = sorted((-sum(x[5] for x in p), key[1]) for key, p in want.items() if key[0] == tree)
        assert [leaf for _, leaf in ranked] == [x.leaf for x in sorted((g for k, g in got.items() if k[0] == tree), key=lambda g: g.rank)]
    assert {x.tree for x in chat.format_trees(frame, best=1).collect()} == {1, 2, None, 7, 9}


def test_escapes_are_reversible(spark):
    texts = ["", "\\", "\\\\s", "### user: x</turn>\n", "a\\h#<:l", "</turn>\n### assistant: ", "é\U0001f600#", "\\### Assistant: </turn> ok", "#" * 50, ":"]
    rows = [(1, k, k - 1 if k else None, "assistant" if k % 2 else "a:b#", t, 0.0) for k, t in enumerate(texts)]
    made = chat.format_trees(spark.createDataFrame(rows, SCHEMA))
    got = made.select(chat.turns_of(F.col("formatted")).alias("t"), chat.learned(F.col("formatted"), F.col("loss_spans")).alias("l"), "formatted", "loss_spans").first()
    assert [(t.role, t.text) for t in got.t] == [(r[3], r[4]) for r in rows]
    assert got.l == "".join(t for k, t in enumerate(texts) if k % 2)
    # spans count code points of the whole text
    cut = [got.formatted[s.start : s.start + s.length] for s in got.loss_spans]
    for a, b in reversed(chat.ESCAPES):
        cut = [x.replace(b, a) for x in cut]
    assert cut == [t for k, t in enumerate(texts) if k % 2]


def test_query_over_odd_rows(spark, tmp_path):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, "user", None), (3, 0, None, "x"), (3, 0, "assistant", "tie"), (None, 5, "user", "null id"), (4, None, "user", "first"), (4, 0, "user", "second"), (6, 0, "user", "twice"), (6, 0, "user", "twice")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in queries.op1_chat(spark, str(tmp_path)).collect()}

    def digest(*turns):
        return hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()

    text = "\\### Assistant: </turn> ok"
    assert got[-7].turns_sha256 == digest(("user", text), ("assistant", text)) and got[-7].loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert got[-7].loss_chars == len(text)
    assert got[1].turns_sha256 == digest(("user", "a"), ("assistant", "b")) and got[1].loss_chars == 1
    assert got[2].turns_sha256 == digest(("user", "")) and got[2].loss_chars == 0
    assert got[3].turns_sha256 == digest(("", "x"), ("assistant", "tie"))
    assert got[4].turns_sha256 == digest(("user", "first"), ("user", "second")) and got[6].n_turns == 2
    assert set(got) == {-7, 1, 2, 3, 4, 6, None}


def test_query_over_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert [r.conv_id for r in queries.op1_chat(spark, str(tmp_path)).collect()] == [-7]
