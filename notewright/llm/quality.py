"""A quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

`train` fits it on a bounded sample of labelled rows inside one task; `score` streams all rows through it. A text's
features are its hashed words, lower-cased, scaled to unit length, one indicator for the quantile bin of each
structure statistic, and one for the bin of the text's length as given in the metadata. Pairwise interactions
have rank RANK and are summed in linear time: for each factor, half of (sum of v x) squared less the sum of (v x) squared.

Defined results: a null or empty text has no words and is scored from its statistics; repeated rows are scored alike;
null labels are not learned; of repeated labels each counts; with no labels at all every score is 0.5; a null doc_id is
scored and never learned from; columns beyond those named are ignored; an empty table gives an empty table.
"""

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewright.llm.words import SPACE, U64, portions, split, text_bytes, word_hashes

#: Labelled rows to learn from, about, at most.
SAMPLE = 6000
WORD_BUCKETS, RANK, BINS = 1 << 14, 8, 12
EPOCHS, BATCH, RATE, DECAY = 12, 128, 0.02, 1e-5
STATISTICS = 16
#: Kinds of bytes: upper case, lower case, digit, byte of a wider letter, space, line feed, other.
KIND = np.full(256, 6, np.int8)
KIND[65:91], KIND[97:123], KIND[48:58], KIND[128:] = 0, 1, 2, 3
KIND[SPACE], KIND[10] = 4, 5


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values[at[k] : at[k + 1]]."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[at[1:]] - total[at[:-1]]


def statistics(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(structure statistics of each text; text, bucket and weight of each of its distinct hashed words)."""
    raw = split(texts, lower=False)
    n = len(raw.first) - 1
    words = np.diff(raw.first).astype(np.float64)
    low = split(texts, lower=True)
    h = word_hashes(low)
    doc = np.repeat(np.arange(n), np.diff(raw.first))

    data, at = text_bytes(texts)
    kind = KIND[data]
    size = np.maximum(np.diff(at), 1).astype(np.float64)
    kinds = np.stack([_sums(kind == k, at) for k in range(7)])
    letters = np.maximum(kinds[0] + kinds[1] + kinds[3], 1)
    some = np.maximum(words, 1)
    same = np.concatenate([[False], (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])]) if len(h) else np.zeros(0, bool)
    first, last = (data[raw.starts], data[raw.starts + raw.lengths - 1]) if len(h) else (np.zeros(0, np.uint8),) * 2

    bucket = (h % U64(WORD_BUCKETS)).astype(np.int64)
    key, times = np.unique(doc * WORD_BUCKETS + bucket, return_counts=True)
    owner = key // WORD_BUCKETS
    weight = np.log1p(times)
    ranked = np.unique(doc.astype(U64) << U64(40) | h >> U64(24))
    distinct = np.bincount((ranked >> U64(40)).astype(np.int64), minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, owner, times)
    stats = np.stack(
        [
            np.log1p(words),
            kinds[0] / letters,
            kinds[2] / size,
            kinds[6] / size,
            kinds[4] / size,
            words / (kinds[5] + 1),
            distinct / some,
            top / some,
            _sums(same, raw.first) / some,
            _sums(raw.lengths, raw.first) / some,
            _sums(KIND[first] == 6, raw.first) / some,
            _sums(KIND[last] == 6, raw.first) / some,
            _sums(raw.lengths == 1, raw.first) / some,
            _sums(raw.lengths <= 3, raw.first) / some,
            _sums((KIND[first] == 0) & (KIND[last] != 1), raw.first) / some,
            _sums(np.concatenate([[False], (data[1:] == data[:-1]) & (kind[1:] != 4)]) if len(data) else np.zeros(0), at) / size,
        ],
        axis=1,
    )
    norm = np.sqrt(np.bincount(owner, weight**2, n))
    return stats, owner, key % WORD_BUCKETS, weight / norm[owner]


def _indicators(stats: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The feature number of each text's bin of each statistic."""
    bins = np.stack([np.searchsorted(e, s, "right") for e, s in zip(edges, stats.T, strict=True)], axis=1)
    return WORD_BUCKETS + np.arange(len(edges)) * (BINS + 1) + bins


class Machine:
    def __init__(self, edges: np.ndarray, bias: float, w: np.ndarray, v: np.ndarray):
        self.edges, self.bias, self.w, self.v = edges, bias, w, v

    def save(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, edges=self.edges, bias=self.bias, w=self.w.astype(np.float32), v=self.v.astype(np.float32))
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> "Machine":
        x = np.load(io.BytesIO(data))
        return cls(x["edges"], float(x["bias"]), x["w"].astype(np.float64), x["v"].astype(np.float64))

    def logits(self, n: int, row: np.ndarray, feature: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of n rows given as sparse triples; also the factors' sums, which the gradient needs."""
        out = self.bias + np.bincount(row, self.w[feature] * x, n)
        sums = np.zeros((n, RANK))
        for f in range(RANK):
            vx = self.v[feature, f] * x
            sums[:, f] = np.bincount(row, vx, n)
            out += 0.5 * (sums[:, f] ** 2 - np.bincount(row, vx**2, n))
        return out, sums


def _sparse(stats: np.ndarray, edges: np.ndarray, owner: np.ndarray, bucket: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    marks = _indicators(stats, edges)
    n, m = marks.shape
    return np.concatenate([owner, np.repeat(np.arange(n), m)]), np.concatenate([bucket, marks.ravel()]), np.concatenate([weight, np.full(n * m, m**-0.5)])


def fit(stats: np.ndarray, words: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, seed: int = 3) -> Machine:
    """By Adam on the log loss. words: bucket and weight arrays of each row."""
    draw = np.random.default_rng(seed)
    edges = np.quantile(stats, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
    edges = np.concatenate([edges, np.full((len(edges), 1), np.inf)], axis=1)
    size = WORD_BUCKETS + len(edges) * (BINS + 1)
    rate = np.clip(y.mean(), 0.02, 0.98)
    model = Machine(edges, float(np.log(rate / (1 - rate))), np.zeros(size), draw.normal(0, 0.02, (size, RANK)))
    mean, square, step = np.zeros((size, RANK + 1)), np.zeros((size, RANK + 1)), 0
    for _ in range(max(EPOCHS, min(200, EPOCHS * 2000 // len(y)))):
        order = draw.permutation(len(y))
        for at in range(0, len(y), BATCH):
            pick = order[at : at + BATCH]
            owner = np.repeat(np.arange(len(pick)), [len(words[k][0]) for k in pick])
            row, feature, x = _sparse(stats[pick], edges, owner, np.concatenate([words[k][0] for k in pick]), np.concatenate([words[k][1] for k in pick]))
            z, sums = model.logits(len(pick), row, feature, x)
            error = (1 / (1 + np.exp(-z)) - y[pick]) / len(pick)
            grad = np.empty((size, RANK + 1))
            gx = error[row] * x
            grad[:, 0] = np.bincount(feature, gx, size)
            for f in range(RANK):
                grad[:, f + 1] = np.bincount(feature, gx * (sums[row, f] - model.v[feature, f] * x), size)
            grad[:, 0] += DECAY * model.w
            grad[:, 1:] += 10 * DECAY * model.v
            step += 1
            mean = 0.9 * mean + 0.1 * grad
            square = 0.99 * square + 0.01 * grad**2
            move = RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-6)
            model.w -= move[:, 0]
            model.v -= move[:, 1:]
            model.bias -= RATE * error.sum()
    return model


def _given(docs: DataFrame) -> Column:
    return F.coalesce(F.col("n_chars").cast("double"), F.lit(0.0)) if "n_chars" in docs.columns else F.lit(0.0)


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _given(docs).alias("given"))


def _with_given(stats: np.ndarray, given: pa.Array) -> np.ndarray:
    return np.concatenate([stats, np.log1p(np.maximum(given.to_numpy(zero_copy_only=False), 0))[:, None]], axis=1)


def _scores(machine: Machine | None, texts: pa.Array, given: pa.Array) -> np.ndarray:
    if machine is None:
        return np.full(len(texts), 0.5)
    stats, owner, bucket, weight = statistics(texts)
    z, _ = machine.logits(len(texts), *_sparse(_with_given(stats, given), machine.edges, owner, bucket, weight))
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> bytes | None:
    """docs (doc_id, text, n_chars), labels (doc_id, label) -> the fitted machine, or None if there are no labels.

    About `sample` labelled ids, drawn by hash, are sent to all tasks; their rows' features go to one task. Rows that repeat id, text and
    label count once, and of ids that have many texts at most 2 * sample rows are taken, by hash.
    """
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("double").alias("label")).dropna().distinct()
    share = min(1.0, sample / max(1, labels.count()))
    drawn = F.broadcast(labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30)))
    rows = _columns(docs).join(drawn, "doc_id").withColumn("mark", F.xxhash64("doc_id", "text"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text"):
            stats, owner, bucket, weight = statistics(batch.column("text"))
            at = pa.array(np.searchsorted(owner, np.arange(batch.num_rows + 1)), pa.int32())
            wide = _with_given(stats, batch.column("given"))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("mark"),
                    batch.column("label"),
                    pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * wide.shape[1], pa.int32()), pa.array(wide.ravel())),
                    pa.ListArray.from_arrays(at, pa.array(bucket, pa.int32())),
                    pa.ListArray.from_arrays(at, pa.array(weight, pa.float32())),
                ],
                ["mark", "label", "stats", "bucket", "weight"],
            )

    def learn(table: pa.Table) -> pa.Table:
        y = table.column("label").to_numpy()
        words = [(np.array(b.values, np.int64), np.array(w.values, np.float64)) for b, w in zip(table.column("bucket"), table.column("weight"), strict=True)]
        stats = np.stack([np.array(x.values) for x in table.column("stats")])
        order = np.lexsort((stats[:, 0], stats[:, 1], y, stats[:, 9]))
        model = fit(stats[order], [words[k] for k in order], y[order])
        return pa.table({"model": pa.array([model.save()], pa.binary())})

    known = rows.mapInArrow(features, "mark long, label double, stats array<double>, bucket array<int>, weight array<float>").dropDuplicates(["mark", "label"])
    found = known.orderBy("mark", "label").limit(2 * sample).withColumn("all", F.lit(0)).groupBy("all").applyInArrow(learn, "model binary").collect()
    return bytes(found[0][0]) if found else None


def score(docs: DataFrame, model: bytes | None, threshold: float = 0.3) -> DataFrame:
    """docs (doc_id, text, n_chars) -> (doc_id, score, predicted)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Machine.load(model) if model else None
        for batch in portions(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_scores(machine, batch.column("text"), batch.column("given")))], ["doc_id", "score"])

    return _columns(docs).mapInArrow(scan, "doc_id long, score double").select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(docs: DataFrame, model: bytes | None, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, with all their columns, whose score reaches the threshold."""
    names = docs.columns
    given = "given"
    while given in map(str.lower, names):
        given += "_"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Machine.load(model) if model else None
        for batch in portions(batches, "text"):
            own = pa.RecordBatch.from_arrays(batch.columns[:-1], names)
            yield own.filter(pa.array(_scores(machine, batch.column("text"), batch.column(given)) >= threshold))

    return docs.select("*", _given(docs).alias(given)).mapInArrow(scan, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """Score every row, learning from the folds other than 0: (doc_id, held_out, score, predicted)."""
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(folds))
    model = train(docs, labels.where(fold != 0), sample)
    return score(docs, model, threshold).select("doc_id", (fold == 0).alias("held_out"), "score", "predicted")
