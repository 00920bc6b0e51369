"""Operators on texts against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from notewright.llm import components, exchange, line_dedup, lm, mixing, packing, quality, simhash, substrings, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, extra=()):
    """rows: (doc_id, text[, source])."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1]) if r[1] is not None else None) for r in rows]
    out = spark.createDataFrame(full, SCHEMA)
    return out.withColumns({c: F.lit("clash") for c in extra})


def corpus(seed=0, n=60):
    """Random texts over few words, with copies, near copies and shared passages; and the odd cases."""
    r = random.Random(seed)
    vocabulary = ["the", "of", "Und", "é", "x1", "naïve", "##", "Ü", " y", "end."] + [f"w{k}" for k in range(200)]
    passage = [r.choice(vocabulary) for _ in range(60)]
    texts = []
    for _ in range(n):
        body = [r.choice(vocabulary) for _ in range(r.randint(0, 90))]
        if r.random() < 0.3:
            a = r.randint(0, 20)
            body[r.randint(0, len(body)) :] = passage[a : a + r.randint(15, 40)]
        texts.append(r.choice([" ", "\n", "\t "]).join(body) if r.random() < 0.8 or not texts else r.choice(texts))
    texts += [None, "", " \n\t ", "a", "A b", "For " * 70, "x" * 5000 + " tail", " ".join(passage * 3)]
    return [(k, t) for k, t in enumerate(texts)]


# words


def test_words_split_as_the_pattern_does():
    texts = [t for _, t in corpus()]
    w = words.split(pa.array(texts), lower=True)
    got = [[w.data[s : s + n].tobytes().decode() for s, n in zip(w.starts[a:b], w.lengths[a:b], strict=True)] for a, b in zip(w.first, w.first[1:], strict=False)]
    assert got == [WORD.findall((t or "").translate(LOW)) for t in texts]
    j = words.joined(w)
    assert j.data.tobytes().decode() == " ".join(x for t in got for x in t)


def test_xxh64_is_the_published_function():
    r = random.Random(1)
    runs = [bytes(r.randrange(256) for _ in range(n)) for n in [*range(70), 95, 96, 97, 300]]
    data = np.frombuffer(b"".join(runs), np.uint8)
    size = np.array([len(x) for x in runs])
    got = words.xxh64(data, np.cumsum(size) - size, size, 42)
    assert got.tolist() == [xxhash.xxh64_intdigest(x, 42) for x in runs]


def test_word_hashes_do_not_depend_on_the_batch():
    texts = ["alpha beta", "x" * 300 + " beta", "beta"]
    together = words.word_hashes(words.split(pa.array(texts), False))
    apart = np.concatenate([words.word_hashes(words.split(pa.array([t]), False)) for t in texts])
    assert (together == apart).all() and len(set(together.tolist())) == 3


# op8


def fingerprint(text):
    w = WORD.findall((text or "").translate(LOW))
    s = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(prints, radius=3):
    """Least id of each component, by comparing all pairs."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if bin(prints[a] ^ prints[b]).count("1") <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [find(x) for x in range(len(prints))]


def test_simhash_equals_brute_force(spark):
    rows = corpus()
    rows += [(1000 + k, (rows[3][1] or "") + f" more{k % 3}") for k in range(6)] + [(3, rows[3][1])]
    rows.sort(key=lambda r: r[0])
    got = simhash.near_duplicates(docs(spark, rows, extra=("fp", "component"))).collect()
    prints = [fingerprint(t) for _, t in rows]
    least = linked(prints)
    want = sorted((i, f"{p:016x}", rows[c][0]) for (i, _), p, c in zip(rows, prints, least, strict=True))
    assert sorted(tuple(r) for r in got) == want


def test_long_texts_are_counted_in_runs(monkeypatch):
    monkeypatch.setattr(simhash, "RUN", 7)
    texts = [t for _, t in corpus(3)]
    assert simhash.simhash(pa.array(texts)).tolist() == [fingerprint(t) for t in texts]


def test_bit_slices_find_all_links():
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(12)]
    near = [b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 4))) for b in base for _ in range(20)]
    fp = np.array(near, np.uint64).view(np.int64)
    key = np.repeat([1, 2, 3], 80)
    got = simhash.close_rows(key, fp, 3)
    want = np.concatenate([np.array(linked(near[a : a + 80])) + a for a in (0, 80, 160)])
    assert got.tolist() == want.tolist()


def test_chunked_keys_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 4)
    r = random.Random(6)
    base = r.getrandbits(64)
    near = sorted({base ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 3))) for _ in range(60)})
    fp = np.array(near, np.uint64).view(np.int64).tolist()
    frame = spark.createDataFrame([(k, x) for k, x in enumerate(fp)], "doc_id long, fp long")
    got = {x.fp: x.doc_id for x in simhash.components(frame, "doc_id").collect()}
    assert [got[x] for x in fp] == linked(near)


def test_keep_first_keeps_one_row_of_each_group(spark, tmp_path):
    docs(spark, [(5, "a b c d"), (2, "a b c d"), (None, "a b c d"), (2, "a b c d"), (7, "other words are here"), (None, "null ids only"), (None, "null ids only")]).write.parquet(str(tmp_path / "d"))
    kept = simhash.keep_first(spark.read.parquet(str(tmp_path / "d")))
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == [("2", "a b c d"), ("7", "other words are here"), ("None", "null ids only")]


def test_components_of_a_long_chain(spark):
    edges = [(k, k + 1) for k in range(200)] + [(500, 501), (501, 500), (7, 7)]
    random.Random(2).shuffle(edges)
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(201)} | {500: 500, 501: 500}


# op3


def test_scores_equal_counts(spark):
    rows = [(k, t) for k, t in corpus(4)] + [(None, "the of"), (3, "the the")]
    got = lm.score(docs(spark, rows, extra=("part", "batch"))).collect()
    fold = [zlib.crc32(str(i).encode() if i is not None else b"") % 10 for i, _ in rows]
    tokens = [[*WORD.findall((t or "").translate(LOW)), None] for _, t in rows]
    c = Counter(w for t, f in zip(tokens, fold, strict=True) if f for w in t)
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), f == 0, len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 6)) for (i, _), t, f in zip(rows, tokens, fold, strict=True))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score <= 0 for r in got)


class PlainModel:
    """The same model in plain Python, with given weights: counts of n-grams of up to three words, contexts padded with ends."""

    def __init__(self, tokens, weights):
        self.counts, self.contexts, self.weights = [Counter() for _ in range(3)], [Counter() for _ in range(3)], weights
        for text in tokens:
            padded = [None, None, *text]
            for k in range(2, len(padded)):
                for n in range(3):
                    self.counts[n][tuple(padded[k - n : k + 1])] += 1
                    self.contexts[n][tuple(padded[k - n : k])] += 1

    def chance(self, before, word):
        p = 1 / (len(self.counts[0]) + 1)
        for n in range(3):
            context = tuple(before[2 - n :])
            seen = self.contexts[n][context]
            if seen:
                share = self.weights[n][0 if n == 0 else min(int(math.log2(seen)), 63)]
                p = share * self.counts[n][(*context, word)] / seen + (1 - share) * p
        return p


def test_scores_follow_from_counts_and_weights_and_chances_sum_to_one(spark, monkeypatch):
    learned, learn = [], lm.learn_weights
    monkeypatch.setattr(lm, "learn_weights", lambda *a, **k: learned.append(learn(*a, **k)) or learned[-1])
    rows = [(k, t) for k, t in corpus(4)] + [(None, "the of"), (3, "the the"), (77, "of the of the of")]
    got = {(str(r.doc_id), round(r.score, 8)) for r in lm.score(docs(spark, rows)).collect()}
    fold = [zlib.crc32(str(i).encode() if i is not None else b"") % 10 for i, _ in rows]
    tokens = [[*WORD.findall((t or "").translate(LOW)), None] for _, t in rows]
    model = PlainModel([t for t, f in zip(tokens, fold, strict=True) if f], learned)
    for (i, _), t in zip(rows, tokens, strict=True):
        padded = [None, None, *t]
        want = sum(math.log10(model.chance(padded[k - 2 : k], padded[k])) for k in range(2, len(padded)))
        assert (str(i), round(want, 8)) in got
    # after contexts that were seen, half seen, at a begin, and never seen
    every = [w for (w,) in model.counts[0]] + ["no such word"]
    for before in ([None, None], [None, "the"], ["the", "of"], ["nothing", "the"], ["the", "nothing"], ["nothing", "nothing"]):
        assert sum(model.chance(before, w) for w in every) == pytest.approx(1, abs=1e-12)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_every_length_of_n_gram_scores(spark, order):
    got = lm.score(docs(spark, corpus(2)), order=order).collect()
    assert len(got) == len(corpus(2)) and all(r.score < 0 for r in got)


def test_steps_of_the_histogram_hardly_move_the_weights():
    draw = np.random.default_rng(0)
    bucket, ratio = draw.integers(0, 8, 5000), np.exp(draw.normal(0.5, 2.0, 5000))
    ratio[draw.random(5000) < 0.3] = 0
    plain, n = np.full(lm.BUCKETS, 0.5), np.bincount(bucket, minlength=lm.BUCKETS)
    for _ in range(100):
        share = plain[bucket] * ratio
        plain = (1 + np.bincount(bucket, share / (share + 1 - plain[bucket]), lm.BUCKETS)) / (2 + n)
    step = np.where(ratio > 0, np.rint(lm.STEPS * np.log(np.maximum(ratio, 1e-300))), lm.NONE)
    assert np.abs(lm.learn_weights(bucket, step, np.ones(5000)) - plain).max() < 0.002


def test_small_units_and_more_ranges_change_nothing(spark, monkeypatch):
    rows = corpus(6)
    plain = {(str(r.doc_id), r.n_known, r.train_tokens, round(r.score, 8)) for r in lm.score(docs(spark, rows)).collect()}
    monkeypatch.setattr(exchange, "UNIT", 3000)
    monkeypatch.setattr(exchange, "MOST_KEYS", 20)
    monkeypatch.setattr(exchange, "RANGES", 8)
    assert plain == {(str(r.doc_id), r.n_known, r.train_tokens, round(r.score, 8)) for r in lm.score(docs(spark, rows)).collect()}


def test_messages_are_never_more_than_keys_and_ranges_grow_with_the_text():
    keys = np.sort(words.mixed(np.arange(50_000, dtype=np.uint64)))
    for ranges in (exchange.RANGES, 20 * len(keys)):
        asked = exchange.questions(1, 0, keys, [np.ones(len(keys), np.int64)], ranges)
        assert asked.num_rows <= min(ranges, len(keys)) and sum(asked.column("size").to_pylist()) == len(keys)
        back = [exchange.read(b.as_py(), n, 1)[0] for b, n in zip(asked.column("body"), asked.column("size").to_pylist(), strict=True)]
        assert (np.concatenate(back) == keys).all()
    assert exchange.ranges(10**8, 3) == exchange.RANGES and exchange.ranges(10**14, 3) == 10 * exchange.ranges(10**13, 3)


def test_units_are_written_once_and_read_back_whole(spark, monkeypatch):
    monkeypatch.setattr(exchange, "UNIT", 2000)
    rows = corpus(5)
    stored = exchange.stored(docs(spark, rows).select("doc_id", "text"), F.col("doc_id").cast("int") % 3)

    def back(unit, part, batches):
        t = pa.Table.from_batches(list(batches))
        return pa.table([pa.array([unit] * t.num_rows), pa.array([part] * t.num_rows, pa.int32()), t.column("doc_id"), t.column("text")], ["unit", "part", "doc_id", "text"])

    got = exchange.each(stored, back, "unit long, part int, doc_id long, text string").collect()
    assert sorted((r.doc_id, r.text or "", r.text is None) for r in got) == sorted((i, t or "", t is None) for i, t in rows)
    assert all(r.part == r.doc_id % 3 for r in got) and len({r.unit for r in got}) > 3


@pytest.mark.parametrize("keys", [[0], [7], [2**64 - 1], [0, 1, 2**64 - 1], range(500), range(0, 2**64, 2**55)])
def test_messages_keep_keys_and_values(keys):
    keys = np.array(list(keys), np.uint64)
    values = [np.arange(len(keys)) - 3, np.full(len(keys), -(2**62))]
    back = exchange.read(exchange.written(keys, *values), len(keys), 2)
    assert all((x == y).all() for x, y in zip(back, [keys, *values], strict=True))


def test_answers_that_are_not_there_are_an_error():
    told = pa.table({"shard": pa.array([0], pa.int32()), "size": [2], "body": [exchange.squeeze(np.array([4, 5]))]})
    assert exchange.values_of(told, 2, 1)[0].tolist() == [4, 5]
    with pytest.raises(RuntimeError):
        exchange.values_of(told, 3, 1)


def test_model_beats_the_base_on_held_out_text(spark):
    r = random.Random(9)
    follow = {k: [r.randrange(40) for _ in range(3)] for k in range(40)}

    def text():
        w, out = r.randrange(40), []
        for _ in range(80):
            out.append(f"w{w}")
            w = r.choice(follow[w])
        return " ".join(out)

    got = [x for x in lm.score(docs(spark, [(k, text()) for k in range(150)])).collect() if x.held_out]
    assert sum(x.score for x in got) > sum(x.base_score for x in got) * 0.7


@pytest.mark.parametrize("operator", [simhash.near_duplicates, lm.score, substrings.dedup_passages, packing.pack, line_dedup.dedup_lines, mixing.mix])
def test_empty_tables(spark, operator):
    assert operator(docs(spark, [])).collect() == []


# op6


def without_passages(rows, k=20):
    first, out = {}, []
    texts = [WORD.findall(t or "") for _, t in rows]
    for (i, _), w in zip(rows, texts, strict=True):
        for s in range(len(w) - k + 1):
            key = tuple(w[s : s + k])
            first[key] = min(first.get(key, math.inf), math.inf if i is None else i)
    for (i, _), w in zip(rows, texts, strict=True):
        seen, gone = set(), set()
        for s in range(len(w) - k + 1):
            key = tuple(w[s : s + k])
            if key in seen or first[key] < (math.inf if i is None else i):
                gone.update(range(s, s + k))
            seen.add(key)
        out.append((str(i), len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("seed", [0, 1])
def test_passages_equal_brute_force(spark, seed):
    rows = [(k * 3 % 71, t) for k, t in corpus(seed)] + [(None, "For " * 70), (None, corpus(seed)[-1][1]), (1, "For " * 45)]
    got = substrings.dedup_passages(docs(spark, rows, extra=("batch", "kept"))).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256))
    assert sorted((str(r[0]), r[1], r[2], r[3]) for r in got.collect()) == without_passages(rows)


def test_hot_phrases_and_small_units(spark, monkeypatch):
    rows = [(k * 3 % 71, t) for k, t in corpus(1)] + [(80 + k, f"own{k} " + "all rights are reserved by the owner of this text and " + " ".join(f"t{k * j % 5}" for j in range(30))) for k in range(40)]
    monkeypatch.setattr(exchange, "UNIT", 2000)
    monkeypatch.setattr(exchange, "MOST_KEYS", 20)
    monkeypatch.setattr(exchange, "RANGES", 8)
    monkeypatch.setattr(substrings, "SHARD", 5000)
    got = substrings.dedup_passages(docs(spark, rows), hot=3).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256))
    assert sorted((str(r[0]), r[1], r[2], r[3]) for r in got.collect()) == without_passages(rows)


def test_passages_of_very_long_texts(spark):
    r = random.Random(5)
    long = [f"w{r.randrange(3000)}" for _ in range(60_000)]
    rows = [(1, " ".join(long)), (2, " ".join(["x", *long[20_000:20_100], "y"])), (3, "z " * 50_000)]
    got = substrings.dedup_passages(docs(spark, rows)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256))
    assert sorted((str(r[0]), r[1], r[2], r[3]) for r in got.collect()) == without_passages(rows)


def passage_table(texts, spread=1):
    """Passages of one shard, each of one window, all under one key."""
    n = len(texts)
    return pa.table(
        {
            "shard": pa.array([0] * n, pa.int32()), "spread": pa.array([spread] * n), "words": pa.array([t.encode() for t in texts], pa.binary()), "offset": pa.array([4] * n, pa.int32()), "windows": pa.array([1] * n, pa.int32()),
            "h1": pa.array(range(n), pa.int64()), "h2": pa.array(range(n), pa.int64()), "least": pa.array(range(10, 10 + n)), "n": pa.array([1] * n),
        }
    )


def test_only_the_automaton_finds_candidates(monkeypatch):
    a = " ".join(f"w{k}" for k in range(20))
    own = passage_table([a, a])
    assert substrings.decide(own).column("lesser").to_pylist() == [[10], [10]]
    monkeypatch.setattr(substrings, "hits", lambda texts, phrases: (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    assert substrings.decide(own).num_rows == 0


def test_phrases_and_windows_are_confirmed_by_their_words():
    # one key, as if hashes had collided: other phrases, then equal phrases in other windows
    a, b = " ".join(f"w{k}" for k in range(20)), " ".join(f"v{k}" for k in range(20))
    assert substrings.decide(passage_table([a, b])).num_rows == 0
    c = a.replace("w19", "other")
    assert substrings.decide(passage_table([a, c])).num_rows == 0
    assert substrings.decide(passage_table([a, c, a])).column("h1").to_pylist() == [0, 2]
    assert substrings.confirmed([b"x y", b"z", b"x y"], [1, 1, 1]) == [b"x y"]


def test_the_automaton_locates_every_occurrence():
    text, behind = substrings.hits([b"a b c a b", b"xa b", b"a b"], [b"a b", b"b c"])
    assert sorted(zip(text.tolist(), behind.tolist(), strict=True)) == [(0, 3), (0, 5), (0, 9), (2, 3)]


# op7


def test_pieces_are_the_tokenizers_ids(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = corpus(7) + [(500, "a <|endoftext|> b"), (501, "word " * 9000), (None, "null id"), (3, "again"), (502, " " * 20000 + "x")]
    got = packing.pack(docs(spark, rows, extra=("key", "length")), group=16).collect()
    want = Counter()
    for i, t in rows:
        ids = np.array([*slow.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for a in range(0, len(ids), 2048):
            want[(i, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes()), len(ids))] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048


def test_both_tokenizers_agree_on_odd_text_and_on_documents(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    slow, fast = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.Encoder()
    r = random.Random(12)
    pools = ["abcXYZ'", "0123456789", " \t\n\r\u00a0\u2003\u2028\u3000", "éüßøÅñ", "\u0301\u0308\u200d\u200b\ufeff", "中文字日本語한국어", "😀👩🏽🇩🇪\ufe0f", "ЖдиДня", "اللغةʼ", ".,;:!?-_()[]{}'\"…—", "\x00\x1f\x7f\x85", "ⅣⅫ①²½"]
    texts = ["".join(r.choice(r.choice(pools)) for _ in range(r.randint(1, 60))) for _ in range(2000)]
    texts += ["I'm you'll it's WE'RE don'T 's 't", "  two  spaces  \n\n\n x", "<|endoftext|> <|pad|>", "a" * 3000, "\n" * 500]
    texts += [x.text for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if x.text is not None]
    for t in texts:
        assert np.array(fast(t)).tolist() == slow.encode(t, add_special_tokens=False).ids, repr(t)


def test_padding_is_little(spark):
    got = packing.pack(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).toPandas()
    used = got.groupby("sequence_id").length.sum()
    assert used.max() <= 2048 and used.sum() / (2048 * len(used)) > 0.97


def test_millions_of_spaces_go_to_the_other_tokenizer():
    encode = packing.Encoder()
    assert len(encode(" " * 2_000_000)) > 0 and encode.slow is not None


def test_first_fit_decreasing_equals_the_plain_loop():
    sizes = np.random.default_rng(1).integers(1, 2048, 300)
    room, want = [], {}
    for item in np.argsort(-sizes, kind="stable"):
        b = next((k for k, free in enumerate(room) if free >= sizes[item]), len(room))
        room += [2048] if b == len(room) else []
        want[item] = (b, 2048 - room[b])
        room[b] -= sizes[item]
    bins, offsets = packing.first_fit_decreasing(sizes)
    assert {k: (bins[k], offsets[k]) for k in range(len(sizes))} == want


# op5


def poured(sizes, weights=(5.0, 2.0, 1.0), share=1.5, cap=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    budget, full = share * sum(sizes.values()), set()
    while True:
        level = (budget - sum(cap * sizes[s] for s in full)) / max(sum(w[s] for s in order if s not in full), 1e-300)
        more = {s for s in order if s not in full and level * w[s] >= cap * sizes[s]}
        if not more:
            return {s: cap * sizes[s] if s in full else level * w[s] for s in order}
        full |= more


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_mix_meets_its_targets(spark, seed):
    r = random.Random(seed)
    rows = [(k, " ".join(["w"] * r.randint(0, 60)), r.choice(["hot"] * 5 + ["a", "b", "Z", None])) for k in range(1500)] + [(None, None, "void"), (7, "x y", "a"), (7, "x y", "a")]
    frame = docs(spark, rows, extra=("copies_", "s"))
    got = mixing.mix(frame).collect()
    again = mixing.mix(frame.repartition(7)).collect()
    key = lambda x: (str(x.doc_id), str(x.text), x.copies)
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want, taken = poured(sizes), Counter()
    for x in got:
        assert x.source_size == sizes[x.source] and x.target == pytest.approx(want[x.source]) and 0 <= x.copies <= 2
        taken[x.source] += x.copies * x.size
    for s, target in want.items():
        assert abs(taken[s] - target) <= 61


def test_mix_prefers_by_size_but_takes_all_kinds(spark):
    rows = [(k, "w " * (4 if k % 2 else 400), "a") for k in range(2000)] + [(5000 + k, "w " * 500, f"b{k}") for k in range(2)]
    got = [x for x in mixing.mix(docs(spark, rows), weights=(1.0, 2.0, 4.0)).collect() if x.source == "a"]
    mean = [np.mean([x.copies for x in got if (x.size > 100) == big]) for big in (False, True)]
    assert 0 < mean[0] < mean[1] <= 2


# op9


def test_classifier_learns_and_scores_all(spark):
    r = random.Random(3)
    good = lambda: ". ".join(" ".join(r.choice(["the", "of", "and", "cat", "tree", "river", "stone"]) for _ in range(8)).capitalize() for _ in range(6))
    bad = lambda: " ".join(f"{r.choice('abcxyz') * 3}{r.choice(['$$$', '&&&', '###'])}" for _ in range(50))
    rows = [(k, good() if k % 3 else bad()) for k in range(300)] + [(1000, None), (1001, ""), (None, "null id"), (1, good())]
    labels = spark.createDataFrame([(k, float(bool(k % 3))) for k in range(300)] + [(None, 1.0), (4, None)], "doc_id long, label double")
    frame = docs(spark, rows, extra=("score", "label", "given"))
    got = quality.classify(frame, labels).collect()
    assert len(got) == len(rows) and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.3) for x in got)
    held = [x for x in got if x.held_out and x.doc_id is not None and 1 < x.doc_id < 300]
    assert len(held) > 30 and np.mean([x.predicted == bool(x.doc_id % 3) for x in held]) > 0.95
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in got if x.doc_id is not None)


def test_classifier_without_labels_says_half(spark):
    labels = spark.createDataFrame([], "doc_id long, label double")
    assert [x.score for x in quality.classify(docs(spark, [(1, "a")]), labels).collect()] == [0.5]


def test_classifier_on_an_empty_table(spark):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, label int")
    assert quality.classify(docs(spark, []), labels).collect() == []


def test_linear_time_sum_equals_all_pairs():
    draw = np.random.default_rng(0)
    model = quality.Machine(np.zeros((0, 1)), 0.3, draw.normal(size=9), draw.normal(size=(9, quality.RANK)))
    x = draw.normal(size=9)
    z, _ = model.logits(1, np.zeros(9, int), np.arange(9), x)
    pairs = sum(model.v[a] @ model.v[b] * x[a] * x[b] for a in range(9) for b in range(a))
    assert z[0] == pytest.approx(0.3 + model.w @ x + pairs)


# op10




def test_chunks_keep_all_lines_and_move_with_them(spark):
    lines = [f"line {k * 7919 % 97}" for k in range(60)]
    texts = ["\n".join(lines), "\n".join(["new first", *lines]), "", "one", "\n\n", "\n".join(["same"] * 100)]
    got = [r[0] for r in docs(spark, list(enumerate(texts))).orderBy("doc_id").select(line_dedup.chunks(F.col("text"))).collect()]
    for text, parts in zip(texts, got, strict=True):
        assert [x for c in parts for x in c] == text.split("\n")
        assert max(map(len, parts)) <= line_dedup.LONGEST
    shared = {tuple(c) for c in got[0]} & {tuple(c) for c in got[1]}
    assert sum(map(len, shared)) > 45


def test_repeated_chunks_go_but_for_the_first(spark):
    block = "\n".join(f"shared line {k}" for k in range(12))
    rows = [(9, f"top\n{block}\nbottom"), (2, f"{block}\nown 1\nown 2"), (4, f"a\nb\n{block}"), (4, None), (None, "x\ny"), (6, ""), (6, ""), (8, "same\nrow\nhere"), (8, "same\nrow\nhere")]
    parts = {r.text: [tuple(c) for c in r.c] for r in docs(spark, rows).where("text is not null").select("text", line_dedup.chunks(F.col("text")).alias("c")).collect()}
    first = {}
    for i, t in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        for c in parts.get(t, []):
            first.setdefault(c, (i, t))
    want = []
    for i, t in rows:
        if t is None:
            want.append((str(i), "None", 0))
            continue
        seen, kept = set(), []
        for c in parts[t]:
            if len(c) > 1 and (first[c] != (i, t) or c in seen):
                continue
            seen.add(c)
            kept += c
        want.append((str(i), "\n".join(kept), len(t.split("\n")) - len(kept)))
    got = line_dedup.dedup_lines(docs(spark, rows, extra=("gone", "key", "chunks"))).collect()
    assert sorted((str(r.doc_id), str(r.text), r.n_removed_lines) for r in got) == sorted(want)
    assert sum(r.n_removed_lines for r in got) >= 10


def test_most_lines_of_repeated_passages_go(spark):
    r = random.Random(4)
    line = lambda: f"line {r.getrandbits(40)}"
    passage = [[line() for _ in range(40)] for _ in range(12)]
    rows = [(k, "\n".join([line() for _ in range(r.randint(1, 9))] + passage[k % 12] + [line() for _ in range(r.randint(1, 9))])) for k in range(24)]
    rows += [(100 + k, "\n".join([line(), *[line()] * 40, line()])) for k in range(12)]
    rows += [(200 + k, "\n".join([line(), *[line(), line()] * 20, line()])) for k in range(12)]
    got = {x.doc_id: x.n_removed_lines for x in line_dedup.dedup_lines(docs(spark, rows)).collect()}
    assert sum(got[k] for k in range(12, 24)) > 0.85 * 12 * 40 and not any(got[k] for k in range(12))
    assert min(got[k] for k in range(100, 112)) >= 32 and min(got[k] for k in range(200, 212)) >= 32


def test_only_a_text_of_one_line_makes_a_chunk_of_one_line(spark):
    r = random.Random(8)
    texts = ["\n".join(str(r.randrange(r.choice([1, 2, 50]))) for _ in range(n)) for n in [1, 2, 3, 4, 5, 33, 34, 63, 64, 65, *[r.randint(2, 90) for _ in range(60)]]]
    got = docs(spark, list(enumerate(texts))).select("text", line_dedup.chunks(F.col("text")).alias("c")).collect()
    for x in got:
        assert [y for c in x.c for y in c] == x.text.split("\n")
        assert min(map(len, x.c)) >= min(2, len(x.text.split("\n"))) and max(map(len, x.c)) <= line_dedup.LONGEST


def test_names_of_passages_are_neither_written_nor_exchanged_with_words(spark, monkeypatch):
    held, keep = [], substrings.table
    monkeypatch.setattr(substrings, "table", lambda df, name, **o: held.append(df.columns) or keep(df, name, **o))
    body = " ".join(f"w{k}" for k in range(40))
    got = substrings.dedup_passages(docs(spark, [(1, f"a {body} b"), (2, f"c {body} d")]))
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in got.collect()) == [(1, 42, 0), (2, 42, 40)]
    assert held == [[c.split()[0] for c in substrings.SENT.split(", ")]]
