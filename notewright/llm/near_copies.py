"""Near copies of texts: those whose sets of word shingles have a Jaccard index of at least LEAST.

Candidates are the SimHash operator's links (fingerprints of the same shingles within RADIUS bits, compared bit-sliced), and sets that share a
MinHash band: at the least index fingerprints are some ten bits apart, which no key of few bits finds. The shingle sets themselves decide
on all candidates; links join into components. A pair at the least index shares none of the BANDS bands with a chance of
(1 - LEAST ** ROWS) ** BANDS, 3 in a million here, and closer pairs with less.

Defined results: words are lower-cased; a text of fewer words than a shingle has one shingle, all of it; null and empty texts have no
shingle and count as equal; an empty table gives an empty table.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewright.llm import simhash
from notewright.llm.components import connected_components
from notewright.llm.lineage import cut
from notewright.llm.words import U64, joined, mixed, portions, split, xxh64

SHINGLE, LEAST, RADIUS = 5, 0.8, 3
#: Shingles in a chunk of sets that are compared within a task.
MOST = 500_000
#: Minima in a band, and bands.
ROWS, BANDS = 4, 24
FLIP, TIMES = np.random.default_rng(42).integers(0, 1 << 63, (2, ROWS * BANDS), dtype=U64) * U64(2) + U64(1)


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, hashes): of each text how many distinct shingles it has, and their hashes, text by text in rising order."""
    w = joined(split(texts, lower=True))
    n = np.diff(w.first)
    count = np.where(n >= shingle, n - shingle + 1, np.minimum(n, 1))
    owner = np.repeat(np.arange(len(count)), count)
    word = w.first[owner] + np.arange(len(owner)) - (np.cumsum(count) - count)[owner]
    last = word + np.minimum(n, shingle)[owner] - 1
    h = xxh64(w.data, w.starts[word], w.starts[last] + w.lengths[last] - w.starts[word])
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])
    return np.bincount(owner[new], minlength=len(count)), h[new]


def listed(sizes: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values.view(np.int64)))


def signed(docs: DataFrame, shingle: int) -> DataFrame:
    """docs (doc_id, row, text) -> (doc_id, row, n: size of the shingle set, s and t: 128 bits that name the set, fp: its
    SimHash fingerprint, bands)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text"):
            sizes, h = shingle_sets(batch.column("text"), shingle)
            some = np.flatnonzero(sizes)
            begin = (np.cumsum(sizes) - sizes)[some]
            names, bands = np.zeros((2, len(sizes)), U64), np.zeros((len(some), BANDS), U64)
            if len(some):
                names[0, some] = np.add.reduceat(mixed(h), begin)
                names[1, some] = np.add.reduceat(mixed(h ^ FLIP[0]), begin)
                for b in range(BANDS):
                    key = np.full(len(some), b, U64)
                    for k in range(b * ROWS, (b + 1) * ROWS):
                        key = mixed(key ^ np.minimum.reduceat((h ^ FLIP[k]) * TIMES[k], begin))
                    bands[:, b] = key
            columns = [batch.column("doc_id"), batch.column("row"), pa.array(sizes.astype(np.int64)), *[pa.array(x.view(np.int64)) for x in names], pa.array(simhash.simhash(batch.column("text"), shingle).view(np.int64)), listed(np.where(sizes > 0, BANDS, 0), bands.ravel())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "n", "s", "t", "fp", "bands"])

    return docs.mapInArrow(scan, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, row long, n long, s long, t long, fp long, bands array<long>")


def listed_sets(docs: DataFrame, needed: DataFrame, shingle: int) -> DataFrame:
    """The shingle sets, sorted, of the rows needed (row)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("row"), listed(*shingle_sets(batch.column("text"), shingle))], ["row", "shingles"])

    return cut(docs.select("row", "text").join(needed, "row", "left_semi").mapInArrow(scan, "row long, shingles array<long>"))


def alike(pairs: DataFrame, docs: DataFrame, shingle: int, least: float) -> DataFrame:
    """Those of the pairs (a, b) of rows of docs (row, text) whose shingle sets have that Jaccard index."""

    sets = listed_sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct(), shingle)
    a, b = (sets.select(F.col("row").alias(x), F.col("shingles").alias(f"of_{x}")) for x in "ab")
    both = F.size(F.array_intersect("of_a", "of_b"))
    return pairs.join(a, "a").join(b, "b").where(both / (F.size("of_a") + F.size("of_b") - both) >= least).select("a", "b")


def by_fingerprint(sets: DataFrame) -> DataFrame:
    """sets (row, fp) -> (a, b): the first row of each fingerprint with all others of it, and with the first ones of close fingerprints."""
    lead = cut(sets.groupBy("fp").agg(F.min("row").alias("lead"), F.count(F.lit(1)).alias("many")))
    same = sets.join(lead.where("many > 1"), "fp").where("row <> lead").select(F.col("lead").alias("a"), F.col("row").alias("b"))
    a, b = (lead.select(F.col("fp").alias(x), F.col("lead").alias(f"row_{x}")) for x in "ab")
    close = simhash.links(lead.select("fp"), RADIUS).join(a, "a").join(b, "b").select(F.col("row_a").alias("a"), F.col("row_b").alias("b"))
    return same.union(close)


def parts(sets: DataFrame, docs: DataFrame, shingle: int, least: float) -> DataFrame:
    """sets (row, n, fp, bands; a row for each distinct set) -> (row, component): each row with others that are alike, and the smallest row it reaches by candidates that are.

    The most central set of each band, that which shares bands with most others, meets all others of its band. Only sets of one band that
    this has not joined then meet each other, within tasks that give a forest of links. So no group costs a row for each of its pairs. These last
    links are between parts that are joined already, so rows are labelled once and parts, which are few, once more.
    """
    keyed = cut(sets.select("row", "n", F.explode("bands").alias("key")))
    # tables of their own: a join with what is grouped in the same stage could not be split where one key has many rows
    many = cut(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("many")).where("many > 1"))
    shared = cut(keyed.join(many, "key"))
    central = shared.groupBy("row").agg((-F.sum("many")).alias("rank"))
    lead = cut(shared.join(central, "row").groupBy("key").agg(F.min(F.struct("rank", "row", "n")).alias("lead")))

    def near(m: F.Column, n: F.Column) -> F.Column:
        """Sets whose sizes alone don't rule it out."""
        return F.least(m, n) / F.greatest(m, n) >= least

    first = shared.join(lead, "key").where((F.col("row") != F.col("lead.row")) & near(F.col("n"), F.col("lead.n"))).select(F.col("lead.row").alias("a"), F.col("row").alias("b"))
    first = first.union(by_fingerprint(sets.where("n > 0"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    first = cut(first.distinct())
    found = cut(alike(first, docs, shingle, least))

    of = connected_components(found).select(F.col("node").alias("row"), F.col("component").alias("part"))
    members = cut(shared.select("key", "row", "n").join(of, "row", "left").withColumn("part", F.coalesce("part", "row")))
    # keys whose sets are not all joined yet: their pairs are compared within tasks, in pairs of chunks of bounded size
    open_ = cut(members.groupBy("key").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.ceil(F.sum("n") / MOST).cast("int").alias("chunks")).where("p <> q").select("key", "chunks"))
    members = cut(members.join(open_, "key"))
    own = F.pmod(F.xxhash64("row"), F.col("chunks")).cast("int")
    meetings = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.struct(F.least(own, j).alias("c"), F.greatest(own, j).alias("d")))
    dealt = members.select("key", F.explode(meetings).alias("m"), "row", "part").select("key", "m.c", "m.d", "row", "part")
    whole = dealt.join(listed_sets(docs, members.select("row").distinct(), shingle), "row")
    together = whole.select("key", "c", "d", "part", "shingles").repartition("key", "c", "d").sortWithinPartitions("key", "c", "d")
    over = connected_components(together.mapInArrow(lambda batches: forests(batches, least), "a long, b long")).withColumnRenamed("node", "part")
    # a part that no row of `of` is in is a row of its own
    return of.join(over, "part", "full").select(F.coalesce("row", "part").alias("row"), F.coalesce("component", "part").alias("component"))


def forests(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of parts in each group of rows (key, c, d, part, shingles), which stand together."""
    left: list[pa.RecordBatch] = []

    def links_of(table: pa.Table, cuts: list[int]) -> pa.RecordBatch:
        part, lists = table.column("part").to_numpy(), table.column("shingles").combine_chunks()
        size, values = lists.value_lengths().to_numpy().astype(np.int64), lists.flatten().to_numpy()
        at = np.concatenate([[0], np.cumsum(size)])
        found = [x for a, b in zip(cuts, cuts[1:], strict=False) for x in forest(part[a:b], size[a:b], values[at[a] : at[b]], least)]
        return pa.RecordBatch.from_arrays([pa.array([min(x) for x in found], pa.int64()), pa.array([max(x) for x in found], pa.int64())], ["a", "b"])

    for batch in batches:
        table = pa.Table.from_batches([*left, batch])
        names = [table.column(c).to_numpy() for c in ("key", "c", "d")]
        cuts = [0, *(np.flatnonzero(np.any([x[1:] != x[:-1] for x in names], axis=0)) + 1).tolist()]
        # the last group may go on in the next batch
        left = table.slice(cuts[-1]).to_batches()
        if len(cuts) > 1:
            yield links_of(table.slice(0, cuts[-1]), cuts)
    if left:
        table = pa.Table.from_batches(left)
        yield links_of(table, [0, table.num_rows])


def forest(part: np.ndarray, size: np.ndarray, shingles: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Links between the parts of alike sets, listed one behind another, that join whatever hangs together; rows of one part do already."""
    _, root = np.unique(part, return_inverse=True)
    if not root.any():
        return []
    _, code, times = np.unique(shingles, return_inverse=True, return_counts=True)
    owner, shared = np.repeat(np.arange(len(part)), size), times[code] > 1
    # shingles of one set alone are in no intersection
    code, owner = code[shared], owner[shared]
    first = np.searchsorted(owner, np.arange(len(part) + 1))
    order = np.argsort(code, kind="stable")
    who, begin = owner[order], np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(times)))])
    out = []
    for i in range(len(part)):
        other = (root != root[i]) & (np.minimum(size, size[i]) / np.maximum(size, size[i]) >= least)
        if not other.any():
            continue
        own = code[first[i] : first[i + 1]]
        start, n = begin[own], begin[own + 1] - begin[own]
        met = who[np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        both = np.bincount(met, minlength=len(part))
        for j in np.flatnonzero(other & (both / (size + size[i] - both) >= least)).tolist():
            if root[j] != root[i]:
                out.append((int(part[i]), int(part[j])))
                root[root == root[j]] = root[i]
    return out


def keep_first(docs: DataFrame, shingle: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """One row of each component, with all its columns: that of the smallest id, null ids last, the first of repeated rows.

    docs must be a table that is read alike each time, such as Parquet: rows are known by their place in it.
    """
    row = F.monotonically_increasing_id()
    texts = docs.select("doc_id", row.alias("row"), F.col("text").cast("string").alias("text"))
    place = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")).alias("place")
    sets = cut(signed(texts, shingle).groupBy("n", "s", "t").agg(place, F.first("fp").alias("fp"), F.first("bands").alias("bands")).select(F.col("place.row").alias("row"), "place", "n", "fp", "bands"))
    of = parts(sets.select("row", "n", "fp", "bands"), texts, shingle, least)
    kept = sets.join(of, "row", "left").groupBy(F.coalesce("component", "row").alias("part")).agg(F.min("place").alias("place")).select(F.col("place.row").alias("kept"))
    return docs.select(F.struct(*docs.columns).alias("whole"), row.alias("row")).join(kept, F.col("row") == F.col("kept"), "left_semi").select("whole.*")
