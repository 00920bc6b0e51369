"""Near-duplicate texts by SimHash, with bit-sliced comparison of fingerprints.

`fingerprints` gives each row's 64-bit SimHash, `components` the connected components of all fingerprints that
differ in few bits, and `near_duplicates` both together.

Defined results: a null or empty text has fingerprint zero and is linked like any other; repeated rows are
separate rows with one fingerprint; a null id takes part, but a component's id is its smallest id that is not null
(null if it has none); columns beyond id and text are ignored; an empty table gives an empty table.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewright.llm.components import connected_components
from notewright.llm.lineage import cut
from notewright.llm.words import U64, joined, portions, split, xxh64

BITS = 64
#: A text is counted in runs of at most this many shingles, as the counters have 16 bits.
RUN = 65_535
#: Candidate groups beyond this many fingerprints are compared in pairs of chunks.
CHUNK = 4096
#: Four 16-bit counters, one for each bit of a nibble.
NIBBLE = np.array([sum((n >> b & 1) << 16 * b for b in range(4)) for n in range(16)], dtype=U64)


def simhash(texts: pa.Array, shingle: int = 3, seed: int = 42) -> np.ndarray:
    """Unsigned fingerprints of texts. A bit is 1 if it is set in over half of the shingles' hashes."""
    w = joined(split(texts, lower=True))
    n = np.diff(w.first)
    count = np.where(n >= shingle, n - shingle + 1, np.minimum(n, 1))
    first = np.cumsum(count) - count
    word = np.repeat(w.first[:-1] - first, count) + np.arange(int(count.sum()))
    last = word + np.repeat(np.minimum(n, shingle), count) - 1
    h = xxh64(w.data, w.starts[word], w.starts[last] + w.lengths[last] - w.starts[word], seed)

    runs = -(-count // RUN)
    owner = np.repeat(np.arange(len(count)), runs)
    begin = first[owner] + RUN * (np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs))
    out = np.zeros(len(count), U64)
    if not len(owner):
        return out
    for k in range(16):
        sums = np.add.reduceat(NIBBLE[(h >> U64(4 * k)) & U64(15)], begin)
        for b in range(4):
            ones = np.bincount(owner, ((sums >> U64(16 * b)) & U64(0xFFFF)).astype(np.float64), len(count))
            out |= (2 * ones > count).astype(U64) << U64(4 * k + b)
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, fp long: the fingerprint's bits)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(simhash(batch.column("text"), shingle, seed).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scan, "doc_id long, fp long")


def close_rows(key: np.ndarray, fp: np.ndarray, radius: int) -> np.ndarray:
    """For rows sorted by key, the first row of the cluster that each belongs to by links within its key.

    Bit planes stand vertically: bit r of word r // 64 in plane p is bit p of row r's fingerprint. Comparing all rows
    with those `gap` places on is an exclusive-or of each plane with itself, shifted; a saturating carry-save counter
    adds the planes up, and words of 64 rows whose counters all have passed the radius are left.
    """
    n = len(fp)
    root = np.arange(n)
    words = -(-n // 64)
    bits = np.zeros((BITS, (words + 1) * 64), np.uint8)
    bits[:, :n] = np.unpackbits(fp.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").T
    planes = np.packbits(bits, axis=1, bitorder="little").view(U64)
    wide = int(radius).bit_length()

    def shifted(at: np.ndarray, gap: int, p: int) -> np.ndarray:
        q, r = divmod(gap, 64)
        low = planes[p][np.minimum(at + q, words)]
        return low if not r else (low >> U64(r)) | (planes[p][np.minimum(at + q + 1, words)] << U64(64 - r))

    gap = 0
    rows = np.arange(n)
    while True:
        gap += 1
        rows = rows[: np.searchsorted(rows, n - gap)]
        rows = rows[key[rows] == key[rows + gap]]
        if not len(rows):
            return root
        apart = rows[root[rows] != root[rows + gap]]
        if not len(apart):
            continue
        live = np.zeros(words * 64, np.uint8)
        live[apart] = 1
        live = np.packbits(live, bitorder="little").view(U64)
        at = np.flatnonzero(live)
        live = live[at]
        counters = [np.zeros(len(at), U64) for _ in range(wide)]
        for p in range(BITS):
            carry = planes[p][at] ^ shifted(at, gap, p)
            for c in range(wide):
                counters[c], carry = counters[c] ^ carry, counters[c] & carry
            live = live & ~carry
            if p % 8 == 7:
                keep = live != 0
                if not keep.all():
                    at, live, counters = at[keep], live[keep], [c[keep] for c in counters]
                if not len(at):
                    break
        if not len(at):
            continue
        high = sum(((c & live)[:, None] >> np.arange(64, dtype=U64) & U64(1)).astype(np.int64) << k for k, c in enumerate(counters))
        hit = (live[:, None] >> np.arange(64, dtype=U64) & U64(1)).astype(bool) & (high <= radius)
        for a in (at[:, None] * 64 + np.arange(64))[hit].tolist():
            x, y = root[a], root[a + gap]
            while root[x] != x:
                x = root[x]
            while root[y] != y:
                y = root[y]
            root[max(x, y)] = min(x, y)
        while (root != root[root]).any():
            root = root[root]


def links(distinct: DataFrame, radius: int = 3) -> DataFrame:
    """distinct (fp long, one row each) -> (a, b): links that join all fingerprints within the radius.

    Of radius + 1 blocks of bits two close fingerprints share one whole block, and, by the same argument, one of
    radius + 1 blocks of the other bits; both are the candidates' key. A key with more than CHUNK fingerprints is dealt
    out in pairs of chunks, so no task has to hold more. Each key yields a forest of links, not all its pairs.
    """
    parts = radius + 1
    edges = [BITS * k // parts for k in range(parts + 1)]

    def piece(i: int) -> F.Column:
        return F.shiftrightunsigned("fp", edges[i]).bitwiseAND((1 << (edges[i + 1] - edges[i])) - 1)

    keys = []
    for i in range(parts):
        # the other bits, without a gap
        below = F.col("fp").bitwiseAND((1 << edges[i]) - 1) if i else F.lit(0).cast("long")
        above = F.shiftleft(F.shiftrightunsigned("fp", edges[i + 1]), edges[i]) if i < parts - 1 else F.lit(0).cast("long")
        rest, width = below.bitwiseOR(above), BITS - (edges[i + 1] - edges[i])
        inner = [width * k // parts for k in range(parts + 1)]
        for j in range(parts):
            v = F.shiftrightunsigned(rest, inner[j]).bitwiseAND((1 << (inner[j + 1] - inner[j])) - 1)
            keys.append(F.shiftleft(piece(i), inner[j + 1] - inner[j]).bitwiseOR(v) * (parts * parts) + (i * parts + j))
    keyed = distinct.select("fp", F.explode(F.array(*keys)).alias("key"))
    large = keyed.groupBy("key").count().where(F.col("count") > CHUNK).select("key", F.ceil(F.col("count") / CHUNK).cast("int").alias("chunks"))
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.struct(F.least(own, j).alias("c"), F.greatest(own, j).alias("d")))
    dealt = keyed.join(large, "key", "left").select("key", "fp", F.explode(F.when(F.col("chunks").isNull(), F.array(F.struct(F.lit(0).alias("c"), F.lit(0).alias("d")))).otherwise(pairs)).alias("p")).select("key", "p.c", "p.d", "fp")
    together = dealt.repartition("key", "c", "d").sortWithinPartitions("key", "c", "d", "fp")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = np.zeros((4, 0), np.int64)
        for batch in _ended(batches):
            rows = left if batch is None else np.concatenate([left, np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "c", "d", "fp")])], axis=1)
            if not rows.shape[1]:
                continue
            new = np.concatenate([[True], (rows[:3, 1:] != rows[:3, :-1]).any(axis=0)])
            end = rows.shape[1] if batch is None else int(np.flatnonzero(new)[-1])
            rows, left, group = rows[:, :end], rows[:, end:], np.cumsum(new[:end])
            if not end:
                continue
            many = np.bincount(group)[group] > 1
            fp, root = rows[3][many], close_rows(group[many], rows[3][many], radius)
            linked = np.flatnonzero(root != np.arange(len(root)))
            yield pa.RecordBatch.from_arrays([pa.array(fp[root[linked]]), pa.array(fp[linked])], ["a", "b"])

    return together.mapInArrow(compare, "a long, b long")


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def components(prints: DataFrame, first: str, radius: int = 3) -> DataFrame:
    """prints (fp, ...) -> (fp, first): of each fingerprint's component the least value of the column, nulls left out."""
    distinct = cut(prints.groupBy("fp").agg(F.min(first).alias("least")))
    linked = connected_components(links(distinct.select("fp"), radius))
    of = cut(distinct.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component")))
    least = of.groupBy("component").agg(F.min("least").alias(first))
    return of.join(least, "component").select("fp", first)


def near_duplicates(docs: DataFrame, radius: int = 3, shingle: int = 3, seed: int = 42) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, fingerprint: 16 hex digits, component_id), a row for each row."""
    prints = cut(fingerprints(docs, shingle, seed))
    least = components(prints, "doc_id", radius).withColumnRenamed("doc_id", "component_id")
    return prints.join(least, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, radius: int = 3, shingle: int = 3, seed: int = 42) -> DataFrame:
    """One row of each component, with all its columns: that of the smallest id, null ids last, the first of repeated rows.

    docs must be a table that is read alike each time, such as Parquet: rows are known by their place in it.
    """
    row = F.monotonically_increasing_id()
    ids = fingerprints(docs.select(row.alias("doc_id"), "text"), shingle, seed).withColumnRenamed("doc_id", "row")
    named = docs.select(row.alias("row"), "doc_id").join(ids, "row").select("fp", F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row").alias("place"))
    kept = components(cut(named), "place", radius).select(F.col("place.row").alias("kept")).distinct()
    return docs.select(F.struct(*docs.columns).alias("whole"), row.alias("row")).join(kept, F.col("row") == F.col("kept"), "left_semi").select("whole.*")
