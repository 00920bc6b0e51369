"""Scoring texts by an interpolated n-gram model (deleted interpolation).

A token's probability mixes its relative frequency after the two tokens before it with that after one token, that overall, and an even chance
of every known token and one unknown: each frequency has a weight, the shorter n-grams share the rest. The weight depends on how often the
context was seen, in buckets of powers of two; a frequency after a context that was never seen has none, so in every context the chances
of all tokens sum to one. The weights are learned by expectation-maximisation on counts that were held out: training documents in fold 1
are scored by the counts of the other training folds. The scores then use the counts of all training folds.

All tokens of all documents are counted and scored; n-grams meet as 64-bit hashes. What the weights are learned from is, for each length, a
histogram of probability ratios in steps of a 32nd of a natural logarithm: its size has a bound that does not depend on the corpus.

Defined results: a null or empty text is one end token; a null id counts as an empty one (fold 0, held out); repeated
rows count and are scored each; with no training rows the base score is of an empty model; other columns are ignored; an
empty table gives an empty table.
"""

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewright.llm import exchange
from notewright.llm.lineage import table
from notewright.llm.words import U64, mixed, split, word_hashes

#: What stands for the end of a text, and, as context, for whatever is before its begin.
END = U64(0x7E57ED0C0FFEE123)
HELD_OUT, LEARN, COUNT = 0, 1, 2
#: Words of an n-gram at most; buckets of a context's count; steps of the histogram in a natural logarithm.
ORDER, BUCKETS, STEPS = 3, 64, 32
NONE = -(1 << 20)


class Tokens(NamedTuple):
    """Of some texts: for each length of n-gram the distinct keys, and each token's place among them; tokens before each text."""

    keys: list[np.ndarray]
    at: list[np.ndarray]
    first: np.ndarray


def grams(texts: pa.Array, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """(for each length of n-gram the key of the one that ends at each token, tokens before each text). The lowest two bits of a key tell its
    length."""
    w = split(texts, lower=True)
    docs = len(w.first) - 1
    first = w.first + np.arange(docs + 1)
    h = np.full(int(first[-1]), END)
    inner = np.ones(len(h), bool)
    inner[first[1:] - 1] = False
    h[inner] = word_hashes(w)
    place = np.arange(len(h)) - np.repeat(first[:-1], np.diff(first))
    out = [h]
    for back in range(1, order):
        before = np.full(len(h), END)
        has = np.flatnonzero(place >= back)
        before[has] = h[has - back]
        with np.errstate(over="ignore"):
            out.append(mixed(out[-1] * U64(0x9E3779B97F4A7C15) + mixed(before + U64(back))))
    return [(g & ~U64(3)) | U64(n) for n, g in enumerate(out)], first


def tokens(texts: pa.Array, order: int) -> Tokens:
    every, first = grams(texts, order)
    found = [np.unique(g, return_inverse=True) for g in every]
    return Tokens([k for k, _ in found], [at for _, at in found], first)


def unit_keys(rows: Iterable[pa.RecordBatch], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of all lengths, sorted, and how often each occurs."""
    every = [g for b in rows for g in grams(b.column("text"), order)[0]]
    return np.unique(np.concatenate(every), return_counts=True) if every else (np.zeros(0, U64), np.zeros(0, np.int64))


def word_stats(keys: np.ndarray, counts: list[np.ndarray]) -> list[int]:
    """Tokens and distinct words of all training folds, and of those that do not learn weights."""
    word = (keys & U64(3)) == 0
    most, learn = counts[0][word], counts[1][word]
    return [int((most + learn).sum()), int((most + learn > 0).sum()), int(most.sum()), int((most > 0).sum())]


class Model(NamedTuple):
    """Training tokens, distinct ones, training texts."""

    total: int
    kinds: int
    texts: int


def chances(t: Tokens, count: list[np.ndarray], model: Model) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each length of n-gram: (each token's relative frequency after its context, the context's bucket, -1 if it was never seen)."""
    own = [c[at] for c, at in zip(count, t.at, strict=True)]
    n = len(own[0])
    p, bucket = [own[0] / max(model.total, 1)], [np.full(n, 0 if model.total else -1)]
    for k in range(1, len(own)):
        # a token's context is the shorter n-gram that ends at the token before it; that of a first token is in every text once
        seen = np.zeros(n, np.int64)
        seen[1:] = own[k - 1][:-1]
        seen[t.first[:-1]] = model.texts
        p.append(own[k] / np.maximum(seen, 1))
        bucket.append(np.where(seen > 0, np.minimum(np.log2(np.maximum(seen, 1)).astype(np.int64), BUCKETS - 1), -1))
    return p, bucket


def mix(p: list[np.ndarray], bucket: list[np.ndarray], weights: list[np.ndarray], even: float) -> np.ndarray:
    """Of each token the chance that the weights of its contexts' buckets give; what a context that was never seen says has none."""
    out = np.full(len(p[0]), even)
    for x, b, w in zip(p, bucket, weights, strict=True):
        share = np.where(b >= 0, w[np.maximum(b, 0)], 0.0)
        out = share * x + (1 - share) * out
    return out


def learn_weights(bucket: np.ndarray, step: np.ndarray, n: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Each bucket's weight of the longer n-gram's frequency, against what the shorter ones give, by expectation-maximisation on a histogram of
    held-out tokens. step: logarithm, in STEPS, of the ratio of the two. One token of each kind is added, so no weight is 0 or 1."""
    ratio = np.where(step == NONE, 0, np.exp(step / STEPS))
    weights, every = np.full(BUCKETS, 0.5), np.bincount(bucket, n, BUCKETS)
    for _ in range(rounds):
        share = weights[bucket] * ratio
        weights = (1 + np.bincount(bucket, n * share / (share + 1 - weights[bucket]), BUCKETS)) / (2 + every)
    return weights


def score(docs: DataFrame, folds: int = 10, order: int = ORDER) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score). order: words of an n-gram at most."""
    if not 1 <= order <= 3:
        raise ValueError("n-grams have one to three words")
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(folds))
    part = F.when(fold == 0, HELD_OUT).when(fold == 1, LEARN).otherwise(COUNT)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    ranges = exchange.ranges(exchange.all_bytes(docs), order)

    def ask(unit: int, k: int, rows: Iterator[pa.RecordBatch]) -> pa.Table:
        keys, n = unit_keys(rows, order)
        none = np.zeros(len(keys), np.int64)
        return exchange.questions(unit, k, keys, [n if k == COUNT else none, n if k == LEARN else none], ranges)

    packed = exchange.stored(docs, part)
    told = table(exchange.tell(exchange.each(packed, ask, exchange.ASKED), [np.add, np.add], word_stats), "lm")
    texts = docs.agg(F.count(F.when(part != HELD_OUT, 1)), F.count(F.when(part == COUNT, 1))).first()
    sums = told.agg(*(F.coalesce(F.sum(F.get("stats", F.lit(k))), F.lit(0)) for k in range(4))).first()
    model, held = Model(int(sums[0]), int(sums[1]), int(texts[0])), Model(int(sums[2]), int(sums[3]), int(texts[1]))
    answers = told.select("unit", "part", "shard", "size", "body")

    def pieces(own: pa.Table, told: pa.Table, without_learners: bool) -> Iterator[tuple[pa.RecordBatch, Tokens, list[np.ndarray]]]:
        for blob in own.column("blob"):
            keys, _ = unit_keys(exchange.unpacked(blob.as_py()), order)
            most, learn = exchange.values_of(told, len(keys), 2)
            n = most if without_learners else most + learn
            for b in exchange.unpacked(blob.as_py()):
                t = tokens(b.column("text"), order)
                yield b, t, [n[np.searchsorted(keys, k)] for k in t.keys]

    def tally(own: pa.Table, told: pa.Table) -> pa.Table:
        found: list[np.ndarray] = []
        for _, t, count in pieces(own, told, True):
            p, bucket = chances(t, count, held)
            steps = [np.where(x > 0, np.rint(STEPS * np.log(np.maximum(x, 1e-300) * (held.kinds + 1))), NONE).astype(np.int64) for x in p]
            found.append(np.stack([*bucket, *steps]))
        kept, n = np.unique(np.concatenate(found, axis=1), axis=1, return_counts=True)
        return pa.table([*(pa.array(x.astype(np.int32)) for x in kept), pa.array(n.astype(np.int64))], [*marks, "n"])

    marks = [*(f"b{k}" for k in range(order)), *(f"p{k}" for k in range(order))]
    learners = packed.where(F.col("part") == LEARN)
    spread = learners.groupBy("unit").cogroup(answers.where(F.col("part") == LEARN).groupBy("unit"))
    cells = table(spread.applyInArrow(tally, ", ".join(f"{c} int" for c in marks) + ", n long"), "lm-held-out")
    weights: list[np.ndarray] = []
    below = F.lit(1.0)
    for k in range(order):
        # the chance by shorter n-grams, as a multiple of the even one; a histogram of at most BUCKETS times a range of ratios comes to the driver
        own = F.when(F.col(f"p{k}") == NONE, 0.0).otherwise(F.exp(F.col(f"p{k}") / STEPS))
        step = F.when(own == 0, NONE).otherwise(F.rint(STEPS * F.log(own / below))).cast("int")
        seen = cells.where(F.col(f"b{k}") >= 0).select(F.col(f"b{k}").alias("bucket"), step.alias("step"), "n")
        histogram = seen.groupBy("bucket", "step").agg(F.sum("n").alias("n")).toArrow()
        weights.append(learn_weights(*(histogram.column(c).to_numpy() for c in ("bucket", "step", "n"))))
        share = F.when(F.col(f"b{k}") < 0, 0.0).otherwise(F.get(F.array(*map(F.lit, weights[-1].tolist())), F.col(f"b{k}")))
        below = share * own + (1 - share) * below

    def read(own: pa.Table, told: pa.Table) -> pa.Table:
        out: list[pa.Table] = []
        for b, t, count in pieces(own, told, False):
            c = count[0][t.at[0]]
            logs = np.log10(mix(*chances(t, count, model), weights, 1 / (model.kinds + 1)))
            base = np.log10((c + 0.1) / (model.total + 0.1 * (model.kinds + 1)))
            add = lambda x: np.add.reduceat(x, t.first[:-1])  # noqa: B023, E731  every text has a token
            n = b.num_rows
            out.append(
                pa.table(
                    [b.column("doc_id"), pa.array(np.full(n, own.column("part")[0].as_py() == HELD_OUT)), pa.array(np.diff(t.first)), pa.array(add((c > 0).astype(np.int64))), pa.array(np.full(n, model.total)), pa.array(add(base)), pa.array(add(logs))],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )
            )
        return pa.concat_tables(out)

    return packed.groupBy("unit").cogroup(answers.drop("part").groupBy("unit")).applyInArrow(read, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
