"""Exact top-k search by inner product with cover trees on both sides.

The top of one cover tree over all candidates is fitted on a bounded sample: its centres cut the candidates into cells with a covering radius
each. A query starts with its kth best score in the sample, and goes only to cells that can beat it: with centre p and radius s, no score
in a cell is above <q, p> + s |q|. A cell's candidates, in blocks of bounded size, meet its queries in groups. Each group builds a cover
tree over either side and descends both at once, with the scores the queries came with: a pair of nodes with centres q, p and
radii r, s can't score above <q, p> + r |p| + s |q| + r s, and is pruned if that is below the worst kth score in the query node's group;
at a query leaf each of its queries is pruned by itself. What the blocks find is merged by query.

Scores are whole numbers, computed exactly: in double precision where no sum can pass 2 ** 53. Vectors with larger components are a cell of
their own; there doubles, with a bound of their error, only choose which pairs are computed in Python integers. The result is a 64-bit number,
so larger scores are cut to its range.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do null ids; rows that share an id
are candidates each, and each that asks is a query of its own, so that its id has as many lists of ranks; only a query's own row is left out for it; a component whose whole number
does not fit 64 bits is cut to their range; vectors of different lengths don't meet (lengths are few: a length is a row on the driver); ties go to smaller ids; with fewer candidates than k all are
returned; other columns are ignored; empty tables give an empty table.
"""

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from notewright.llm.lineage import cut
from notewright.llm.vectors import block, matrix, sound

#: Rows in a leaf of candidates and of queries, rows that make a ball worth a leaf of its own, how much smaller a child's ball is.
LEAF, QUERY_LEAF, WORTH, SHRINK = 128, 64, 16, 0.7
#: Rows in a candidate block, in a query tree, and query trees in a group.
CANDIDATES, QUERIES, GROUP = 8192, 512, 16
#: Candidates in the sample, and cells of the top of the tree, at most, about.
SAMPLE, CELLS = 4096, 256


class CoverTree:
    """Nodes in arrays: centre (a row), covering radius, children; leaves hold rows.

    The centres of a node's children are more than SHRINK times its radius apart, and each row goes to the first centre within that
    distance. A child of WORTH rows or more is a node of its own; the rows of smaller ones are pooled into leaves: in many dimensions
    most balls hold hardly more than their centre, and a leaf is to be worth a matrix product.
    """

    def __init__(self, points: np.ndarray, leaf: int):
        self.points, self.leaf = points, leaf
        self.size = (points**2).sum(axis=1)
        #: Squared distances are exact for whole numbers below 2 ** 26; this covers their error otherwise.
        self.slack = 1e-12 * float(self.size.max(initial=0.0))
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.children: list[list[int]] = []
        self.rows: list[np.ndarray] = []
        if len(points):
            rows = np.arange(len(points))
            self._build(rows, 0, self._squares(rows, 0))

    def _squares(self, rows: np.ndarray, centre: int) -> np.ndarray:
        return np.maximum(self.size[rows] + self.size[centre] - 2 * (self.points[rows] @ self.points[centre]), 0.0)

    def _build(self, rows: np.ndarray, centre: int, far: np.ndarray) -> None:
        stack = [(rows, centre, far, -1, len(rows) > self.leaf)]
        while stack:
            rows, centre, far, parent, divide = stack.pop()
            node, reach = len(self.centre), float(far.max())
            self.centre.append(centre)
            self.radius.append(float(np.sqrt(reach + self.slack)))
            self.children.append([])
            self.rows.append(rows)
            if parent >= 0:
                self.children[parent].append(node)
            if not divide or reach <= self.slack:
                continue
            self.rows[node] = np.zeros(0, np.int64)
            pool: list[np.ndarray] = []
            limit, next_centre, d = reach * SHRINK**2, centre, far
            while len(rows):
                near = d <= limit
                own = rows[near]
                if len(own) >= min(WORTH, self.leaf):
                    stack.append((own, next_centre, d[near], node, len(own) > self.leaf))
                else:
                    pool.append(own)
                rows = rows[~near]
                if len(rows):
                    next_centre = int(rows[0])
                    d = self._squares(rows, next_centre)
            few = np.concatenate(pool) if pool else np.zeros(0, np.int64)
            for at in range(0, len(few), self.leaf):
                own = few[at : at + self.leaf]
                stack.append((own, int(own[0]), self._squares(own, int(own[0])), node, False))


def dual_search(queries: np.ndarray, query_rows: np.ndarray, points: np.ndarray, rows_of: np.ndarray, k: int, start: np.ndarray, tree: "CoverTree | None" = None, ids: np.ndarray | None = None) -> tuple[np.ndarray, int]:
    """(places in points of each query's k best that reach its start, -1 where there are fewer; pairs compared). A query's own row is left out;
    ties go to smaller ids (by default, rows)."""
    ids = rows_of if ids is None else ids
    n = len(queries)
    best_score, best_at = np.full((n, k), -np.inf), np.full((n, k), -1)
    best_id = np.full((n, k), np.iinfo(np.int64).max)
    if not n or not len(points):
        return best_at, 0
    a, b = CoverTree(queries, QUERY_LEAF), tree or CoverTree(points, LEAF)
    size_q = np.sqrt(a.size)
    size_a, size_b = size_q[a.centre], np.sqrt(b.size)[b.centre]
    centres_a, centres_b = queries[a.centre], points[b.centre]
    radius_a, radius_b = np.array(a.radius), np.array(b.radius)
    kth = start.astype(np.float64).copy()
    above = np.full(len(a.centre), -1)
    for node, kids in enumerate(a.children):
        above[kids] = node
    worst = np.full(len(a.centre), -np.inf)
    for node in range(len(a.centre) - 1, -1, -1):
        worst[node] = worst[a.children[node]].min() if a.children[node] else kth[a.rows[node]].min()
    met = 0

    def ceilings(x: int, kids: list[int]) -> np.ndarray:
        """The most that any pair of two nodes can score; at a leaf of queries, of those that may still gain."""
        s = radius_b[kids]
        if not a.children[x]:
            rows = a.rows[x]
            top = queries[rows] @ centres_b[kids].T + size_q[rows][:, None] * s
            top += 1e-9 * (np.abs(top) + size_q[rows][:, None] * size_b[kids] + 1)
            return np.where(top >= kth[rows][:, None], top, -np.inf).max(axis=0)
        top = centres_b[kids] @ centres_a[x] + radius_a[x] * size_b[kids] + s * size_a[x] + radius_a[x] * s
        return top + 1e-9 * (np.abs(top) + size_a[x] * size_b[kids] + 1)

    def meet(x: int, y: int) -> None:
        nonlocal met
        rows, cols = a.rows[x], b.rows[y]
        top = queries[rows] @ centres_b[y] + size_q[rows] * radius_b[y]
        rows = rows[top + 1e-9 * (np.abs(top) + size_q[rows] * size_b[y] + 1) >= kth[rows]]
        met += len(rows) * len(cols)
        scores = queries[rows] @ points[cols].T
        scores[query_rows[rows][:, None] == rows_of[cols][None, :]] = -np.inf
        hit = (scores >= kth[rows][:, None]) & (scores > -np.inf)
        some, which = hit.any(axis=1), hit.any(axis=0)
        if not some.any():
            return
        rows, cols, scores = rows[some], cols[which], np.where(hit, scores, -np.inf)[np.ix_(some, which)]
        every = np.concatenate([best_score[rows], scores], axis=1)
        names = np.concatenate([best_id[rows], np.broadcast_to(ids[cols], scores.shape)], axis=1)
        at = np.concatenate([best_at[rows], np.broadcast_to(cols, scores.shape)], axis=1)
        order = np.lexsort((names, -every), axis=1)[:, :k]
        best_score[rows], best_id[rows], best_at[rows] = (np.take_along_axis(v, order, 1) for v in (every, names, at))
        best_at[best_score == -np.inf] = -1
        best_id[best_score == -np.inf] = np.iinfo(np.int64).max
        kth[rows] = np.maximum(kth[rows], best_score[rows, k - 1])
        worst[x] = kth[a.rows[x]].min()
        while (up := above[x]) >= 0 and (least := worst[a.children[up]].min()) > worst[up]:
            x = up
            worst[x] = least

    heap = [(-float(ceilings(0, [0])[0]), 0, 0)]
    while heap:
        top, x, y = heapq.heappop(heap)
        if -top < worst[x] or top == np.inf:
            continue
        kids_a, kids_b = a.children[x], b.children[y]
        if not kids_a and not kids_b:
            meet(x, y)
        elif kids_b and (not kids_a or radius_b[y] >= radius_a[x]):
            for kid, bound in zip(kids_b, ceilings(x, kids_b).tolist(), strict=True):
                if bound >= worst[x]:
                    heapq.heappush(heap, (-bound, x, kid))
        else:
            for kid in kids_a:
                bound = float(ceilings(kid, [y])[0])
                if bound >= worst[kid]:
                    heapq.heappush(heap, (-bound, kid, y))
    return best_at, met


def careful_search(queries: np.ndarray, query_rows: np.ndarray, points: np.ndarray, rows_of: np.ndarray, k: int, ids: np.ndarray | None = None) -> np.ndarray:
    """The same for components so large that doubles round: they choose, and Python integers decide among all that may be among the best."""
    out, ids = np.full((len(queries), k), -1), rows_of if ids is None else ids
    if not len(points):
        return out
    p, size_p = points.astype(np.float64), np.sqrt((points.astype(np.float64) ** 2).sum(axis=1))
    for n, (q, own) in enumerate(zip(queries, query_rows, strict=True)):
        q_float = q.astype(np.float64)
        about = p @ q_float
        off = (2 * len(q) + 4) * 2.0**-52 * size_p * np.sqrt((q_float**2).sum())
        low = np.where(rows_of != own, about - off, -np.inf)
        least = np.partition(low, -k)[-k] if len(low) > k else -np.inf
        some = np.flatnonzero((about + off >= least) & (rows_of != own))
        exact = {int(j): sum(int(x) * int(y) for x, y in zip(points[j], q, strict=True)) for j in some}
        order = sorted(exact, key=lambda j: (-exact[j], ids[j]))[:k]
        out[n, : len(order)] = order
    return out


class Top(NamedTuple):
    """Of vectors of one length: sampled candidates and their rows' numbers, and the centres among them, each far from those before."""

    points: np.ndarray
    rows: np.ndarray
    centres: np.ndarray

    @classmethod
    def fit(cls, points: np.ndarray, rows: np.ndarray) -> "Top":
        order, far = [0], ((points - points[0]) ** 2).sum(axis=1)
        while len(order) < min(CELLS, max(1, len(points) // 8)) and far.max() > 0:
            order.append(int(far.argmax()))
            far = np.minimum(far, ((points - points[order[-1]]) ** 2).sum(axis=1))
        return cls(points, rows, points[order])

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(nearest centre, distance to it)."""
        c = self.centres
        square = (x**2).sum(axis=1)[:, None] - 2 * x @ c.T + (c**2).sum(axis=1)[None, :]
        at = square.argmin(axis=1)
        return at, np.sqrt(((x - c[at]) ** 2).sum(axis=1)) * (1 + 1e-9)


#: The cell of vectors with large components, and, where the sample has no vector of that length, of all.
LARGE, ALL = -1, 0
FOUND = "row long, query_id long, vec_id long, score long"


def _meetings(vectors: DataFrame, is_query: Column, k: int) -> DataFrame:
    """FOUND: the best of each block; under a null row, how many pairs were compared there."""
    largest = F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))
    large = F.coalesce(largest * largest * F.size("v") >= 2.0**53, F.lit(False))
    # a row is known by a number of its own, fixed once it is written
    vectors = cut(vectors.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v", F.size("v").alias("dim"), is_query.alias("is_query"), large.alias("large")))
    vectors = vectors.join(vectors.where("is_query").select("dim").distinct(), "dim", "left_semi")
    n = vectors.count()
    drawn = F.pmod(F.xxhash64("row", F.lit(11)), F.lit(1 << 30)) < int(min(1.0, SAMPLE / max(n, 1)) * (1 << 30))
    sample = vectors.where(drawn & ~F.col("large") & (F.col("dim") > 0)).orderBy("row").select("dim", "row", "v").toArrow()
    tops: dict[int, Top] = {}
    for dim in np.unique(sample.column("dim").to_numpy()).tolist():
        own = sample.filter(pa.array(sample.column("dim").to_numpy() == dim))
        tops[dim] = Top.fit(matrix(own.column("v")).astype(np.float64), own.column("row").to_numpy())

    def by_dim(b: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, int, bool]]:
        dims, large = b.column("dim").to_numpy(), b.column("large").to_numpy(zero_copy_only=False)
        for dim in np.unique(dims).tolist():
            for big in (False, True):
                own = (dims == dim) & (large == big)
                if own.any():
                    yield b.filter(pa.array(own)), dim, big

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for own, dim, big in by_dim(b):
                cell, far = np.full(own.num_rows, LARGE if big else ALL), np.full(own.num_rows, np.inf)
                if dim in tops and not big:
                    cell, far = tops[dim].cells(matrix(own.column("v")).astype(np.float64))
                yield pa.RecordBatch.from_arrays([own.column("dim"), pa.array(cell, pa.int32()), pa.array(far), own.column("row"), own.column("vec_id"), own.column("v")], ["dim", "cell", "far", "row", "vec_id", "v"])

    filed = cut(vectors.select("dim", "row", "vec_id", "v", "large").mapInArrow(file, "dim int, cell int, far double, row long, vec_id long, v array<long>"))
    counted = filed.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).toArrow()
    radius: dict[int, dict[int, tuple[float, int]]] = {}
    for dim, cell, rows, far in zip(*(counted.column(c).to_pylist() for c in ("dim", "cell", "n", "far")), strict=True):
        radius.setdefault(dim, {})[cell] = (far, -(-rows // CANDIDATES))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for own, dim, big in by_dim(b):
                cells = np.array(sorted(radius[dim]))
                start, wanted = np.full(own.num_rows, -np.inf), np.ones((own.num_rows, len(cells)), bool)
                if dim in tops and not big:
                    q, t = matrix(own.column("v")).astype(np.float64), tops[dim]
                    seen = q @ t.points.T
                    seen[own.column("row").to_numpy()[:, None] == t.rows[None, :]] = -np.inf
                    if seen.shape[1] >= k:
                        start = np.partition(seen, -k, axis=1)[:, -k]
                    size = np.sqrt((q**2).sum(axis=1))[:, None]
                    some = cells >= 0
                    top = q @ t.centres[cells[some]].T + size * np.array([radius[dim][c][0] for c in cells[some].tolist()])
                    wanted[:, some] = top + 1e-9 * (np.abs(top) + size * np.sqrt((t.centres[cells[some]] ** 2).sum(axis=1)) + 1) >= start[:, None]
                who, where = np.nonzero(wanted)
                at, to = pa.array(who), cells[where]
                blocks = np.array([radius[dim][c][1] for c in to.tolist()], np.int32)
                yield pa.RecordBatch.from_arrays([own.column("dim").take(at), pa.array(to, pa.int32()), pa.array(blocks), own.column("row").take(at), own.column("vec_id").take(at), own.column("v").take(at), pa.array(start).take(at)], ["dim", "cell", "blocks", "row", "vec_id", "v", "start"])

    routed = cut(vectors.where("is_query").select("dim", "row", "vec_id", "v", "large").mapInArrow(route, "dim int, cell int, blocks int, row long, vec_id long, v array<long>, start double"))
    # groups of queries in a cell; a cell that no query needs has none, and its candidates stay where they are
    groups = routed.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / (QUERIES * GROUP)).cast("int").alias("groups"), F.first("blocks").alias("blocks"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    points = filed.join(F.broadcast(groups), ["dim", "cell"]).select("dim", "cell", block(F.col("row"), F.col("blocks")).alias("block"), each("groups").alias("group"), "row", "vec_id", "v", F.lit(None).cast("double").alias("start"))
    asking = routed.join(F.broadcast(groups.drop("blocks")), ["dim", "cell"]).select("dim", "cell", each("blocks").alias("block"), F.pmod(F.xxhash64("row", F.lit(1)), F.col("groups")).cast("int").alias("group"), "row", "vec_id", "v", "start")

    def search(table: pa.Table) -> pa.Table:
        asks = table.column("start").is_valid().to_numpy()
        row_of, ids, m = table.column("row").to_numpy(), table.column("vec_id").to_numpy(), matrix(table.column("v"))
        start = table.column("start").to_numpy()
        found: list[list[np.ndarray]] = [[], [], [], []]
        met = 0
        large = m.shape[1] * (np.abs(m.astype(np.float64)).max(axis=1, initial=0.0) ** 2) >= 2.0**53
        p, p_rows, p_ids = m[~asks], row_of[~asks], ids[~asks]
        plain = not large[~asks].any()
        exact, tree = p.astype(np.float64), None
        for kind in (False, True):
            own = asks & (large == kind)
            q, q_rows, q_ids, q_start = m[own], row_of[own], ids[own], start[own]
            for at in range(0, len(q), QUERIES):
                part, part_rows, part_ids = (x[at : at + QUERIES] for x in (q, q_rows, q_ids))
                if plain and not kind:
                    tree = tree or (CoverTree(exact, LEAF) if len(p) else None)
                    where, more = dual_search(part.astype(np.float64), part_rows, exact, p_rows, k, q_start[at : at + QUERIES], tree, p_ids)
                    met += more
                else:
                    where = careful_search(part, part_rows, p, p_rows, k, p_ids)
                    met += len(part) * len(p)
                row, col = np.nonzero(where >= 0)
                place = where[row, col]
                found[0].append(part_rows[row])
                found[1].append(part_ids[row])
                found[2].append(p_ids[place])
                if plain and not kind:
                    found[3].append((part[row] * p[place]).sum(axis=1).astype(np.int64))
                else:
                    sums = [sum(int(x) * int(y) for x, y in zip(part[r], p[c], strict=True)) for r, c in zip(row, place, strict=True)]
                    found[3].append(np.array([max(-(2**63), min(2**63 - 1, x)) for x in sums], np.int64))
        columns = [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in found]
        names = ["row", "query_id", "vec_id", "score"]
        note = pa.table([*[pa.array([None], pa.int64())] * 3, pa.array([met])], names)
        return pa.concat_tables([pa.table(columns, names), note])

    return points.union(asking).groupBy("dim", "cell", "block", "group").applyInArrow(search, FOUND)


def top_k(vectors: DataFrame, is_query: Column, k: int) -> DataFrame:
    """vectors (vec_id, v array<long>) -> (query_id, rank, vec_id, score): of each row that is_query names the k largest inner
    products with the other rows."""
    found = _meetings(vectors, is_query, k).where("row is not null")
    rank = F.row_number().over(W.partitionBy("row").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def pairs_met(vectors: DataFrame, is_query: Column, k: int) -> int:
    """How many pairs of a query and a candidate the same search compares."""
    return _meetings(vectors, is_query, k).where("row is null").agg(F.coalesce(F.sum("score"), F.lit(0))).first()[0]


def whole_numbers(rows: DataFrame, vector: str, scale: float = 256.0) -> DataFrame:
    """rows (vec_id, vector) -> (vec_id, v): floor(scale * x) of each component in double precision, sound vectors only."""
    whole = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale))
    return rows.where(sound(F.col(vector)) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))
