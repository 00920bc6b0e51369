"""The audit of filters against applying them one after another."""

import random
import re
from itertools import permutations

import numpy as np
from pyspark.sql import functions as F

from notewright.llm import filter_audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def failing(rows):
    """The letters that each row (doc_id, part, text) fails."""
    least = {}
    for i, _, text in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    out = []
    for i, _, text in rows:
        text = text or ""
        words = WORD.findall(text)
        tests = {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": i is not None and text in least and least[text] < i,
        }
        out.append({k for k, v in tests.items() if v})
    return out


def model(rows, labels):
    fails, out = failing(rows), []
    good, toxic = ({i for i, q, t in labels if i is not None and (q, t)[k] == 1} for k in (0, 1))
    for part in sorted({p or "" for _, p, _ in rows}):
        own = [(i, f) for (i, p, _), f in zip(rows, fails, strict=True) if (p or "") == part]
        counted, credit = [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [x for x in left if letter in x[1]]
                redundant = sum(letter in f for _, f in own) - len(gone)
                left = [x for x in left if letter not in x[1]]
                credit[letter] += len(gone)
                counted.append((part, "".join(order), step, len(left), len(gone), redundant, sum(f == {letter} for _, f in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), letter))
        out += [(*r[:-1], credit[r[-1]]) for r in counted]
    return sorted(out)


def audited(spark, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id long, part string, text string").withColumns({c: F.lit(9) for c in ("digest", "mask", "n", "first", "words", "labelled", "none")})
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumns({c: F.lit(9) for c in ("good", "part")})
    return sorted(map(tuple, filter_audit.audit(filter_audit.cells(filter_audit.failures(docs), marks)).collect()))


def table():
    r = random.Random(7)
    vocabulary = [f"w{k}" for k in range(400)] + ["Word", "ÄÖ", "#", "%x", "UPPER", "é"]
    texts = [None, "", " \n", "A", "a b", "#", "X" * 40]
    for _ in range(60):
        few = r.sample(vocabulary, r.choice([5, 20, 400]))
        texts.append(r.choice([" ", "\n", "\t"]).join(r.choice(few) for _ in range(r.choice([10, 49, 50, 51, 120]))))
    texts += [r.choice(texts) for _ in range(60)]
    rows = [(k if k % 11 else None, r.choice([None, "", "s1", "s2", "s2", "s2"]), t) for k, t in enumerate(texts)]
    rows += [rows[5], rows[5], (7, "s1", "other text of id seven"), (7, "s1", texts[20])]
    labels = [(k, r.choice([0, 1, None]), r.choice([0, 1, None])) for k in range(0, 130, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (9999, 1, 1)]
    return rows, labels


def test_equals_filters_one_after_another(spark):
    rows, labels = table()
    assert audited(spark, rows, labels) == model(rows, labels)


def test_edges_of_each_filter(spark):
    long = " ".join(f"w{k}" for k in range(100))
    rows = [
        (1, "p", " ".join(f"w{k}" for k in range(49))),  # A
        (2, "p", " ".join(f"w{k % 65}" for k in range(100))),  # 65 of 100 distinct: kept
        (3, "p", " ".join(f"w{k % 64}" for k in range(100))),  # B
        (4, "p", "W" + long),
        (5, "p", " ".join(f"W{k}" for k in range(60))),  # C
        (6, "p", long + " |"),  # D
        (7, "p", "W" + long),  # E
    ]
    assert [sorted(f) for f in failing(rows)] == [["A"], [], ["B"], [], ["C"], ["D"], ["E"]]
    frame = spark.createDataFrame(rows, "doc_id long, part string, text string")
    got = {r.doc_id: r.mask for r in filter_audit.failures(frame).collect()}
    assert [got[k] for k in range(1, 8)] == [1, 0, 2, 0, 4, 8, 16]
    assert audited(spark, rows, []) == model(rows, [])


def test_the_walk_stores_every_subset():
    draw = np.random.default_rng(0)
    for n in (1, 2, 5, 7):
        masks = np.arange(1 << n)
        weights = draw.integers(0, 50, (1 << n, 3))
        states = filter_audit.survivors(masks, weights, n)
        for subset in range(1 << n):
            assert states[subset].tolist() == weights[masks & subset == 0].sum(axis=0).tolist()


def test_an_empty_table(spark):
    assert audited(spark, [], []) == []


def test_one_text_for_a_third_of_all_rows_and_a_very_long_text(spark):
    rows = [(k, "s", "same text") for k in range(300)] + [(1000 + k, "s", f"text {k}") for k in range(300)] + [(5000, "t", "word " * 400_000 + "END")]
    got = audited(spark, rows, [(k, 1, 0) for k in range(10)])
    assert got == model(rows, [(k, 1, 0) for k in range(10)])
