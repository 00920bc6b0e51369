"""Approximate nearest neighbours by inner product in a hierarchical k-means tree.

The tree is fitted on a bounded sample of vectors; every vector is then filed under the leaf it reaches. A query walks the tree best bin
first: a priority queue gives the node whose centre promises most, and the leaves it comes by are visited in that order. How
many leaves to visit is calibrated: the exact neighbours of a sample of queries are found by brute force in blocks, and visits widen
until the neighbours' leaves are reached for RECALL of them; if need be that is every leaf, which is exact.

A leaf is left out, whatever the order, if none of its vectors can be as near as what the query has found in part of the sample: with
centre p and covering radius s, no product in it is above <q, p> + s |q|. A large leaf is dealt out in blocks of bounded size, so no task
grows with a leaf, and vectors go only to the queries that visit their leaf. Scores are computed in double precision on the vectors themselves.

The tree is over the commonest length of vectors. Vectors of other lengths, which should be few, meet those of their own length in
blocks, exactly.

Defined results: vectors that are null, all zero, or hold null or non-finite components take no part, nor do null ids; rows that
share an id are candidates each, and each that asks is a query of its own; only a query's own row is left out for it; vectors of different lengths don't meet; ties go to smaller ids; with no more than k candidates
all are returned; other columns are ignored; empty tables give an empty table.
"""

import heapq
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from notewright.llm.lineage import cut
from notewright.llm.vectors import block, matrix, sound

#: Vectors to fit on and queries to calibrate on, at most, about.
SAMPLE, CALIBRATE = 20_000, 256
BRANCH, LEAF, MOST_LEAVES = 8, 400, 4096
#: Vectors of the sample that give queries a start, at most.
SEEDS = 4096
#: Vectors and queries in a block.
ROWS, ASKING = 4096, 2048
RECALL = 0.97


class Tree:
    def __init__(self, centre: np.ndarray, first: np.ndarray, count: np.ndarray, leaf: np.ndarray):
        self.centre, self.first, self.count, self.leaf = centre, first, count, leaf

    @classmethod
    def fit(cls, x: np.ndarray, leaf_rows: float, seed: int = 5) -> "Tree":
        """Split every node of more than leaf_rows into BRANCH by Lloyd's rounds. Children of a node stand together."""
        draw = np.random.default_rng(seed)
        centre, first, count, leaf = [x.mean(axis=0) if len(x) else np.zeros(x.shape[1])], [0], [0], [-1]
        queue, leaves = [(0, x)], 0
        while queue:
            node, own = queue.pop(0)
            label = np.zeros(len(own), np.int64)
            if len(own) > leaf_rows:
                c = own[draw.choice(len(own), min(BRANCH, len(own)), replace=False)]
                for _ in range(12):
                    label = ((own**2).sum(axis=1)[:, None] - 2 * own @ c.T + (c**2).sum(axis=1)[None, :]).argmin(axis=1)
                    c = np.stack([own[label == k].mean(axis=0) if (label == k).any() else c[k] for k in range(len(c))])
            if len(own) <= leaf_rows or len(np.unique(label)) < 2:
                leaf[node], leaves = leaves, leaves + 1
                continue
            first[node] = len(centre)
            for k in np.unique(label):
                centre.append(c[k])
                first.append(0)
                count.append(0)
                leaf.append(-1)
                count[node] += 1
                queue.append((len(centre) - 1, own[label == k]))
        return cls(np.array(centre), np.array(first), np.array(count), np.array(leaf))

    def save(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, centre=self.centre, first=self.first, count=self.count, leaf=self.leaf)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> "Tree":
        x = np.load(io.BytesIO(data))
        return cls(*(x[c] for c in ("centre", "first", "count", "leaf")))

    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def file(self, x: np.ndarray) -> np.ndarray:
        """The leaf that each vector reaches by its nearest centres."""
        node = np.zeros(len(x), np.int64)
        while (open_ := self.leaf[node] < 0).any():
            for n in np.unique(node[open_]):
                rows = np.flatnonzero(node == n)
                c = self.centre[self.first[n] : self.first[n] + self.count[n]]
                node[rows] = self.first[n] + ((c**2).sum(axis=1)[None, :] - 2 * x[rows] @ c.T).argmin(axis=1)
        return self.leaf[node]

    def visits(self, query: np.ndarray, most: int, able: np.ndarray | None = None, rows: np.ndarray | None = None, least: int = 0) -> list[int]:
        """The first `most` leaves in best-bin-first order, and more until they have `least` rows; those that are not able don't count."""
        promise = self.centre @ query
        heap, out, have = [(0.0, 0)], [], 0
        while heap and (len(out) < most or have < least):
            _, node = heapq.heappop(heap)
            while self.leaf[node] < 0:
                kids = range(self.first[node], self.first[node] + self.count[node])
                top = max(kids, key=lambda k: promise[k])
                for k in kids:
                    if k != top:
                        heapq.heappush(heap, (-promise[k], k))
                node = top
            leaf = int(self.leaf[node])
            if able is None or able[leaf]:
                out.append(leaf)
                have += 0 if rows is None else int(rows[leaf])
        return out


PAIRS = "row long, query_id long, vec_id long, score double, leaf int"


def _meet(k: int):
    """Of one block of vectors and one of queries: each query's k best in the leaves that it visits there (null: in all)."""

    def meet(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy()
        row_of, ids, m, leaf = table.column("row").to_numpy(), table.column("vec_id").to_numpy(), matrix(table.column("v")).astype(np.float64), table.column("leaf").to_numpy()
        points, queries = np.flatnonzero(~asks), np.flatnonzero(asks)
        lists = table.column("leaves").combine_chunks().filter(pa.array(asks))
        jobs = [(queries[~lists.is_valid().to_numpy(zero_copy_only=False)], points)]
        visitor = np.repeat(queries, lists.value_lengths().fill_null(0).to_numpy())
        visited = lists.flatten().to_numpy()
        # a leaf's rows meet the queries that visit it
        by_leaf, by_visit = points[np.argsort(leaf[points], kind="stable")], np.argsort(visited, kind="stable")
        for x in np.unique(visited).tolist():
            a, b = np.searchsorted(leaf[by_leaf], [x, x + 1])
            c, d = np.searchsorted(visited[by_visit], [x, x + 1])
            jobs.append((visitor[by_visit[c:d]], by_leaf[a:b]))
        found: list[np.ndarray] = []
        for who, rows in jobs:
            for at in range(0, len(who) if len(rows) else 0, 256):
                part = who[at : at + 256]
                scores = m[part] @ m[rows].T
                scores[row_of[part][:, None] == row_of[rows][None, :]] = -np.inf
                least = np.partition(scores, -k, axis=1)[:, -k] if len(rows) > k else np.full(len(part), -np.inf)
                row, col = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
                found.append(np.stack([part[row].astype(np.float64), rows[col].astype(np.float64), scores[row, col]]))
        row, col, value = np.concatenate(found, axis=1) if found else np.zeros((3, 0))
        row, col = row.astype(np.int64), col.astype(np.int64)
        order = np.lexsort((ids[col], -value, row))
        begin = np.flatnonzero(np.diff(row[order], prepend=-1))
        place = np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order))))
        keep = order[place < k]
        return pa.table([pa.array(row_of[row[keep]]), pa.array(ids[row[keep]]), pa.array(ids[col[keep]]), pa.array(value[keep]), pa.array(leaf[col[keep]], pa.int32())], ["row", "query_id", "vec_id", "score", "leaf"])

    return meet


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("row").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _in_all(rows: DataFrame, k: int) -> DataFrame:
    """PAIRS: rows (dim, row, vec_id, v, asks) by comparing each that asks with all of its length, in blocks."""
    n = rows.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / ROWS).cast("int").alias("blocks"), F.ceil(F.count(F.when(F.col("asks"), 1)) / (ASKING * 8)).cast("int").alias("parts")).where("parts > 0")
    sized = rows.join(n, "dim").withColumn("leaf", F.lit(0)).withColumn("leaves", F.lit(None).cast("array<int>"))
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    columns = ["row", "vec_id", "v", "asks", "leaf", "leaves"]
    points = sized.withColumn("block", block(F.col("row"), F.col("blocks"))).withColumn("part", each("parts")).withColumn("asks", F.lit(False))
    asking = sized.where("asks").withColumn("block", each("blocks")).withColumn("part", F.pmod(F.xxhash64("row", F.lit(3)), F.col("parts")).cast("int"))
    return points.select("dim", "block", "part", *columns).union(asking.select("dim", "block", "part", *columns)).groupBy("dim", "block", "part").applyInArrow(_meet(k), PAIRS)


def search(rows: DataFrame, vector: str, is_query: Column, k: int, recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    """rows (vec_id, vector) -> (query_id, rank, vec_id, score, leaves_visited)."""
    spark = rows.sparkSession
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    clean = rows.where(sound(F.col(vector)) & F.exists(F.col(vector), lambda x: x != 0) & F.col("vec_id").isNotNull())
    # a row is known by a number of its own, fixed once it is written
    clean = cut(clean.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")))
    clean = clean.withColumn("dim", F.size("v")).withColumn("asks", F.coalesce(is_query, F.lit(False)))
    sizes = clean.groupBy("dim").count().orderBy(F.col("count").desc(), "dim").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, leaves_visited int")
    dim, n = int(sizes[0]), int(sizes[1])
    others, clean = clean.where(F.col("dim") != dim), clean.where(F.col("dim") == dim)
    drawn = lambda seed, share: F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30))
    fitted = matrix(clean.where(drawn(1, sample / n)).orderBy("row").select("v").toArrow().column("v")).reshape(-1, dim)
    share = len(fitted) / n
    leaf_rows = max(LEAF * share, len(fitted) / MOST_LEAVES * BRANCH, 2)
    model = Tree.fit(fitted, leaf_rows).save()
    leaves = Tree.load(model).leaves()

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Tree.load(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tree.file(matrix(b.column("v")).reshape(-1, dim)), pa.int32())], ["row", "vec_id", "v", "asks", "leaf"])

    filed = cut(clean.select("row", "vec_id", "v", "asks").mapInArrow(file, "row long, vec_id long, v array<double>, asks boolean, leaf int"))

    # calibration: exact neighbours of some queries, and where in their order of visits those leaves stand
    queries = filed.where("asks")
    asked = max(1, queries.count())
    some = queries.where(drawn(2, CALIBRATE / asked))
    blocks = -(-n // ROWS)
    nowhere = F.lit(None).cast("array<int>").alias("leaves")
    points = filed.select(block(F.col("row"), blocks).alias("block"), "row", "vec_id", "v", F.lit(False).alias("asks"), "leaf", nowhere)
    trial = some.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "row", "vec_id", "v", F.lit(True).alias("asks"), "leaf", nowhere)
    exact = _ranked(points.union(trial).groupBy("block").applyInArrow(_meet(k), PAIRS), k)
    true_leaves = exact.groupBy("row").agg(F.collect_list("leaf").alias("true")).join(some.select("row", "v"), "row")

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Tree.load(model)
        for b in batches:
            out = []
            for q, true in zip(matrix(b.column("v")).reshape(-1, dim), b.column("true").to_pylist(), strict=True):
                place = {x: k for k, x in enumerate(tree.visits(q, leaves), 1)}
                out += [place[x] for x in true]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int32())], ["visits"])

    reached = true_leaves.select("v", "true").mapInArrow(needed, "visits int").groupBy("visits").count().orderBy("visits").collect()
    total, got, most = sum(r[1] for r in reached), 0, leaves
    for visits, count in reached:
        got += count
        if got >= recall * total:
            most = int(visits)
            break

    # what leaves hold: rows, and the farthest from the centre; a query's kth best in part of the sample is a start that its leaves must beat
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Tree.load(model)
        centre = tree.centre[np.argsort(np.where(tree.leaf < 0, len(tree.leaf), tree.leaf))[:leaves]]
        for b in batches:
            leaf = b.column("leaf").to_numpy()
            yield pa.RecordBatch.from_arrays([b.column("leaf"), pa.array(np.sqrt(((matrix(b.column("v")).reshape(-1, dim) - centre[leaf]) ** 2).sum(axis=1)))], ["leaf", "far"])

    held = filed.select("v", "leaf").mapInArrow(spread, "leaf int, far double").groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).toArrow()
    sizes_of, radius = np.zeros(leaves, np.int64), np.zeros(leaves)
    sizes_of[held.column("leaf").to_numpy()], radius[held.column("leaf").to_numpy()] = held.column("n").to_numpy(), held.column("far").to_numpy()
    seeds = fitted[:SEEDS]

    # the search: neighbouring leaves make units, large units have blocks, and each query goes once to each unit that it visits
    unit_of = (np.cumsum(sizes_of) - sizes_of) // ROWS
    blocks_of = np.maximum(1, -(-np.bincount(unit_of, sizes_of).astype(np.int64) // (2 * ROWS)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            unit = unit_of[b.column("leaf").to_numpy()]
            yield pa.RecordBatch.from_arrays([pa.array(unit), pa.array(blocks_of[unit]), *(b.column(c) for c in ("row", "vec_id", "v", "leaf"))], ["unit", "blocks", "row", "vec_id", "v", "leaf"])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Tree.load(model)
        centre = tree.centre[np.argsort(np.where(tree.leaf < 0, len(tree.leaf), tree.leaf))[:leaves]]
        for b in batches:
            owner, unit, seen = [], [], []
            queries = matrix(b.column("v")).reshape(-1, dim)
            # one of the seeds may be the query itself
            start = np.partition(queries @ seeds.T, -k - 1, axis=1)[:, -k - 1] if len(seeds) > k else np.full(len(queries), -np.inf)
            for n, q in enumerate(queries):
                most_of = centre @ q + radius * np.sqrt(q @ q)
                own = np.array(tree.visits(q, most, most_of + 1e-9 * (np.abs(most_of) + 1) >= start[n], sizes_of, k + 1), np.int64)
                for u in np.unique(unit_of[own]).tolist():
                    owner.append(n)
                    unit.append(u)
                    seen.append(own[unit_of[own] == u])
            at, units = pa.array(owner, pa.int64()), np.array(unit, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(units), pa.array(blocks_of[units]), b.column("row").take(at), b.column("vec_id").take(at), b.column("v").take(at), pa.array(seen, pa.list_(pa.int32()))], ["unit", "blocks", "row", "vec_id", "v", "leaves"])

    routed = cut(queries.select("row", "vec_id", "v").mapInArrow(route, "unit long, blocks long, row long, vec_id long, v array<double>, leaves array<int>"))
    parts_of = np.zeros(len(blocks_of), np.int64)
    for unit, n_asking in routed.groupBy("unit").count().collect():
        parts_of[unit] = -(-n_asking // (ASKING * 8))

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(parts_of[b.column("unit").to_numpy()]), *b.columns], ["parts", *b.schema.names])

    part = F.pmod(F.xxhash64("row", F.lit(3)), F.col("parts")).cast("int")
    routed = routed.mapInArrow(shared, "parts long, unit long, blocks long, row long, vec_id long, v array<double>, leaves array<int>")
    routed = routed.select("unit", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).alias("block"), part.alias("part"), "row", "vec_id", "v", F.lit(True).alias("asks"), F.lit(-1).alias("leaf"), "leaves")
    # vectors of a unit that no query visits stay where they are
    dealt = filed.select("row", "vec_id", "v", "leaf").mapInArrow(deal, "unit long, blocks long, row long, vec_id long, v array<double>, leaf int").mapInArrow(shared, "parts long, unit long, blocks long, row long, vec_id long, v array<double>, leaf int").where("parts > 0")
    points = dealt.select("unit", block(F.col("row"), F.col("blocks")).alias("block"), F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1)).alias("part"), "row", "vec_id", "v", F.lit(False).alias("asks"), "leaf", nowhere)
    found = points.union(routed).groupBy("unit", "block", "part").applyInArrow(_meet(k), PAIRS).union(_in_all(others, k))
    return _ranked(found, k).select("query_id", "rank", "vec_id", "score", F.lit(most).alias("leaves_visited"))
