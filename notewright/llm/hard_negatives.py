"""Hard negatives: rows of other labels that score almost as high with an anchor as its positives do.

A vector is cut in segments, and of each segment the mean and the deviation from it (the norm of what the mean leaves) are kept. The inner
product of two vectors is the sum over segments of the product of means times the segment's length, give or take at most the product of deviations. Segments are
nested: 1, 4, 16 and, for long vectors, more of them. Candidates of a block, the longest vectors first, meet some anchors at a time by one segment; pairs that can still reach
what the anchor looks for are bounded again by finer segments, and what is left is scored exactly, so that the scores found narrow the search among the rows that follow.

Two rounds over the same layout, blocks of CANDIDATES rows times groups of ANCHORS anchors: the first finds the positives (the best rows of the anchor's label), the second
the negatives: for each anchor and positive the best rows of other labels with a score between `low` and `high` per cent of the positive's. Each block returns its best, which are
merged by anchor.

Scores are inner products of whole numbers, floor(scale * x) in double precision. They are exact: in doubles while no sum can pass 2 ** 53, in Python integers beyond, where bounds
allow for the rounding of doubles. The result is a 64-bit number; larger scores are cut to its range.

Defined results: a null label, vector, component or id, and components that are not finite once scaled, take a row out; each row counts, also those that repeat an id or all of a
row, and only the anchor's own row is none of its candidates; rows of one score and id are interchangeable; vectors of different lengths don't meet; ties go to smaller ids;
an anchor without positives, or a positive without rows in range, has no result; labels may be of any type; other columns are ignored; an empty table gives an empty table.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from notewright.llm.lineage import cut
from notewright.llm.vectors import matrix, sound

#: Rows in a block of candidates, and anchors that meet a block at a time.
CANDIDATES, ANCHORS = 8192, 1024
#: Segments at each level are a power of this; a segment has two components or more.
FANOUT = 4
#: Rows and anchors that meet at a time.
BATCH, TILE = 2048, 32
FOUND = "row long, place int, vec_id long, score long"


def levels(dim: int) -> list[np.ndarray]:
    """Borders of the segments at each level, coarse to fine, each level's within the next one's."""
    out, n = [], 1
    while n == 1 or dim >= 2 * n:
        out.append(np.arange(n + 1) * dim // n)
        n *= FANOUT
    return out


class Summaries:
    """For each level the means, scaled by the root of the segment's length, and deviations of all segments of all vectors."""

    def __init__(self, x: np.ndarray):
        self.mean: list[np.ndarray] = []
        self.deviation: list[np.ndarray] = []
        square = x**2
        for edges in levels(x.shape[1]):
            length = np.diff(edges)
            mean = np.add.reduceat(x, edges[:-1], axis=1) / np.sqrt(length)
            self.mean.append(mean)
            # what differences of large squares lose is added back, so that bounds hold
            total = np.add.reduceat(square, edges[:-1], axis=1)
            self.deviation.append(np.sqrt(np.maximum(total - mean**2, 0) + 1e-12 * total))


class Block:
    """Candidates of one block, the longest vectors first."""

    def __init__(self, x: np.ndarray, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray):
        size = np.sqrt((x**2).sum(axis=1))
        order = np.argsort(-size, kind="stable")
        self.x, self.rows, self.ids, self.labels, self.size = x[order], rows[order], ids[order], labels[order], size[order]
        self.summaries = Summaries(self.x)
        self.scored = 0

    def scores(self, at: np.ndarray, q: np.ndarray, alive: np.ndarray) -> np.ndarray:
        """(rows x anchors) exact scores of the pairs alive: doubles while these are exact, else Python integers."""
        x = self.x[at]
        if q.shape[1] * float(np.abs(q).max()) * float(np.abs(x).max()) < 2.0**53:
            return x @ q.T
        whole = [[int(v) for v in row] for row in q]
        out = np.full(alive.shape, 0, object)
        for r, c in zip(*np.nonzero(alive), strict=True):
            out[r, c] = sum(int(a) * b for a, b in zip(x[r], whole[c], strict=True))
        return out


def ranked(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, ties to smaller ids."""
    if scores.dtype == object:
        return np.array(sorted(range(len(scores)), key=lambda n: (-scores[n], ids[n]))[:k], int)
    if len(scores) > 4 * k:
        some = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def best_in_ranges(block: Block, able: np.ndarray, q: np.ndarray, low: list[list], high: list[list], k: int) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """For each anchor of q and each of its ranges [low, high] the k best (scores, places in the block), ties by id. able: rows x anchors."""
    n, of = len(q), Summaries(q)
    floors, tops = np.array(low, object).reshape(n, -1), np.array(high, object).reshape(n, -1)
    none = (np.zeros(0, object), np.zeros(0, int))
    best = [[none] * floors.shape[1] for _ in range(n)]
    size = np.sqrt((q**2).sum(axis=1))
    for start in range(0, len(block.x), BATCH):
        at = np.arange(start, min(start + BATCH, len(block.x)))
        alive = able[at]
        least, most = (floors.min(axis=1, initial=np.inf).astype(float), tops.max(axis=1, initial=-np.inf).astype(float))
        # doubles may round the ends of a range that doesn't fit them
        least, most = least - np.abs(least) * 1e-15, most + np.abs(most) * 1e-15
        for level, mean in enumerate(block.summaries.mean):
            some = alive.any(axis=1)
            at, alive = at[some], alive[some]
            middle = mean[at] @ of.mean[level].T
            reach = block.summaries.deviation[level][at] @ of.deviation[level].T + 1e-9 * block.size[at][:, None] * size + 1e-9
            alive = alive & (middle + reach >= least) & (middle - reach <= most)
        some = alive.any(axis=1)
        at, alive = at[some], alive[some]
        if not len(at):
            continue
        block.scored += int(alive.sum())
        scores = block.scores(at, q, alive)
        number = object if scores.dtype == object else float
        for r in range(floors.shape[1]):
            fits = alive & (scores >= floors[:, r].astype(number)).astype(bool) & (scores <= tops[:, r].astype(number)).astype(bool)
            for a in np.flatnonzero(fits.any(axis=0)):
                hit = np.flatnonzero(fits[:, a])
                s, p = np.concatenate([best[a][r][0].astype(number), scores[hit, a]]), np.concatenate([best[a][r][1], at[hit]])
                order = ranked(s, block.ids[p], k)
                best[a][r] = s[order], p[order]
                if len(order) == k:
                    floors[a, r] = max(floors[a, r], s[order[-1]])
    return best


def _meet(points: pa.Table, asks: pa.Table, scale: float, same: bool, k: int, low: int, high: int) -> pa.Table:
    """FOUND of one block and one group of anchors; under a null row, how many pairs were scored exactly."""
    out: list[tuple[int, int, int, int]] = []
    scored = 0
    if points.num_rows and asks.num_rows:
        names = pa.chunked_array([*points.column("label").chunks, *asks.column("a_label").chunks]).combine_chunks().dictionary_encode().indices.to_numpy()
        block = Block(np.floor(scale * matrix(points.column("v")).astype(np.float64)), points.column("row").to_numpy(), points.column("vec_id").to_numpy(), names[: points.num_rows])
        q = np.floor(scale * matrix(asks.column("a_v")).astype(np.float64))
        rows, labels = asks.column("a_row").to_numpy(), names[points.num_rows :]
        # positives of an anchor, and the scores its negatives may have; all have as many ranges, of which those left over are empty
        found = [[] for _ in q] if same else asks.column("a_positives").to_pylist()
        most = max(map(len, found))
        lows = [[-np.inf]] * len(q) if same else [[-(-low * s // 100) for s in own] + [np.inf] * (most - len(own)) for own in found]
        highs = [[np.inf]] * len(q) if same else [[high * s // 100 for s in own] + [-np.inf] * (most - len(own)) for own in found]
        for tile in range(0, len(q), TILE):
            part = slice(tile, tile + TILE)
            able = (block.labels[:, None] == labels[part]) == same
            able &= block.rows[:, None] != rows[part]
            for one, ranges in enumerate(best_in_ranges(block, able, q[part], lows[part], highs[part], k), tile):
                for place, (scores, at) in enumerate(ranges):
                    out += [(int(rows[one]), place, int(block.ids[p]), max(-(2**63), min(2**63 - 1, int(s)))) for s, p in zip(scores, at, strict=True)]
        scored = block.scored
    out.append((None, 0, None, scored))
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64()]
    return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], ["row", "place", "vec_id", "score"])


def _round(points: DataFrame, anchors: DataFrame, sizes: tuple[int, int], scale: float, same: bool, k: int, low: int = 0, high: int = 0) -> DataFrame:
    """FOUND of all blocks and groups."""
    blocks, groups = (max(1, -(-n // most)) for n, most in zip(sizes, (CANDIDATES, ANCHORS), strict=True))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n, seed: F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(n)).cast("int")
    left = points.select("dim", dealt(blocks, 3).alias("block"), every(groups).alias("group"), "row", "vec_id", "label", "v")
    # names of their own: a column that stands on both sides is lost on the right one
    own = [F.col(c).alias(f"a_{c}") for c in ("dim", "row", "label", "v", "positives")]
    right = anchors.select(*own, every(blocks).alias("a_block"), dealt(groups, 5).alias("a_group"))
    both = left.groupBy("dim", "block", "group").cogroup(right.groupBy("a_dim", "a_block", "a_group"))
    return both.applyInArrow(lambda p, a: _meet(p, a, scale, same, k, low, high), FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("row", "place").orderBy(F.col("score").desc(), "vec_id"))
    return found.where("row is not null").withColumn("rank", rank).where(F.col("rank") <= k)


def _rounds(rows: DataFrame, vector: str, is_anchor: Column, positives: int, negatives: int, low: int, high: int, scale: float) -> Iterator[tuple[DataFrame, DataFrame]]:
    """The anchors (with their positives, in the second round) and FOUND of either round."""
    v = F.col(vector)
    good = sound(v) & F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.forall(v, lambda x: F.abs(x.cast("double") * scale) < float("inf")), F.lit(False)) & (F.size(v) > 0)
    # a row is known by a number of its own, fixed once it is written
    points = cut(rows.where(good).select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), v.alias("v"), F.size(v).alias("dim"), is_anchor.alias("anchor")))
    anchors = points.where("anchor")
    n = points.agg(F.count(F.lit(1)), F.count_if("anchor")).first()
    sizes = (n[0], n[1])
    first = _round(points, anchors.withColumn("positives", F.lit(None).cast("array<long>")), sizes, scale, True, positives)
    yield anchors, first
    chosen = cut(_best(first, positives)).select("row", F.struct("rank", "vec_id", "score").alias("p"))
    lists = chosen.groupBy("row").agg(F.array_sort(F.collect_list("p")).alias("p"))
    asking = cut(anchors.join(lists, "row").withColumn("positives", F.transform("p", lambda p: p["score"])))
    yield asking, _round(points, asking, sizes, scale, False, negatives, low, high)


def mine(rows: DataFrame, vector: str, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: float = 256.0) -> DataFrame:
    """rows (vec_id, label, vector) -> (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Of each row that is_anchor names, for each of its best `positives` other rows of the same label, the best `negatives` rows of other labels whose score times 100 lies
    between `low` and `high` times the positive's.
    """
    *_, (asking, found) = _rounds(rows, vector, is_anchor, positives, negatives, low, high, scale)
    named = asking.select("row", F.col("vec_id").alias("anchor_id"), F.posexplode("p").alias("place", "p"))
    best = _best(found, negatives).select("row", "place", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return named.join(best, ["row", "place"]).select("anchor_id", F.col("p.vec_id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), "negative_id", F.col("p.score").alias("positive_score"), "negative_score")


def pairs_scored(rows: DataFrame, vector: str, is_anchor: Column, **options: int) -> list[int]:
    """How many pairs each round of the same search scores exactly."""
    options = {"positives": 5, "negatives": 10, "low": 30, "high": 90, "scale": 256.0} | options
    return [found.where("row is null").agg(F.coalesce(F.sum("score"), F.lit(0))).first()[0] for _, found in _rounds(rows, vector, is_anchor, **options)]
