"""How filters of documents interact: what each removes alone, after others, and in every order.

`failures` marks for each document which filters it fails, as bits of a mask. Documents of one part (a source) and one mask are one cell: at most 2 ** n
rows a part with n filters, whatever the number of documents. `audit` walks all subsets of filters of a part in Gray-code order, so that each step toggles one
filter: every cell that fails it has its counter of active failures raised or lowered, and joins or leaves the running survivors when the counter leaves or
reaches zero. The survivors of all 2 ** n states are stored; what a filter removes at a step of an order is the difference of two states.

The filter for repeated texts marks a document whose text some smaller doc_id has, anywhere in the table. Texts meet as their SHA-256: the least id of
each digest, found by tasks before they shuffle, is joined back by digest and id together, so copies of one text spread over all tasks.

Defined results: a null text is empty; a null part is the empty string; a document with a null doc_id is no copy of anything, and nothing is a copy of it; documents with one
id have no smaller id than one another; a document counts as good or toxic if any of its labels says so; labels without a document don't
count; rows that repeat a document count each; other columns are ignored; an empty table gives an empty table.
"""

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewright.llm.lineage import table

SPACE = "[\\x20\\x09-\\x0D]+"


def too_short(words: Column, text: Column) -> Column:
    return F.size(words) < 50


def few_distinct(words: Column, text: Column) -> Column:
    return 100 * F.size(F.array_distinct(words)).cast("long") < 65 * F.size(words).cast("long")


def capitals(words: Column, text: Column) -> Column:
    return 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long") > 5 * F.length(text).cast("long")


def symbols(words: Column, text: Column) -> Column:
    return text.rlike("[#$%&*|]")


#: Filters of a document's own text, by letter; the last letter is that of repeated texts.
CHECKS = {"A": too_short, "B": few_distinct, "C": capitals, "D": symbols}
COPY = "E"
#: Ids that are null are spread over this many keys.
SPREAD = 1024
STEPS = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def failures(docs: DataFrame) -> DataFrame:
    """docs (doc_id, part, text) -> (doc_id, part, mask, n): bit k of mask for a failure of the kth filter; n equal rows."""
    text = F.coalesce("text", F.lit(""))
    read = docs.select("doc_id", F.coalesce(F.col("part").cast("string"), F.lit("")).alias("part"), text.alias("text"), F.array_remove(F.split(text, SPACE, -1), "").alias("words"))
    fails = [check(F.col("words"), F.col("text")).cast("int") * (1 << k) for k, check in enumerate(CHECKS.values())]
    rows = read.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), sum(fails, F.lit(0)).alias("mask"))
    rows = table(rows.groupBy("doc_id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n")), "failures")
    first = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("first"))
    met = rows.join(first.withColumnRenamed("digest", "d"), (F.col("digest") == F.col("d")) & (F.col("doc_id") == F.col("first")), "left")
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return met.select("doc_id", "part", (F.col("mask") + copy.cast("int") * (1 << len(CHECKS))).alias("mask"), "n")


def cells(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """failed (doc_id, part, mask, n), labels (doc_id, quality, toxic) -> (part, mask, n, good, toxic), one row for each part and mask."""
    is_one = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0)))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("labelled")).agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic"))
    salt = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("part", "mask", "n"), F.lit(SPREAD)) + 1).otherwise(0)
    both = failed.withColumn("salt", salt).join(known.withColumn("none", F.lit(0).cast("long")), (F.col("doc_id") == F.col("labelled")) & (F.col("salt") == F.col("none")), "left")
    total = lambda c: F.sum(F.col("n") * F.coalesce(F.col(c), F.lit(0)))
    return both.groupBy("part", "mask").agg(F.sum("n").alias("n"), total("good").alias("good"), total("toxic").alias("toxic"))


def survivors(masks: np.ndarray, weights: np.ndarray, filters: int) -> np.ndarray:
    """masks of cells and their weights (cells x measures) -> what survives each subset of filters (2 ** filters x measures)."""
    active, alive = np.zeros(len(masks), np.int64), weights.sum(axis=0)
    states = np.zeros((1 << filters, weights.shape[1]), np.int64)
    states[0] = alive
    subset = 0
    for turn in range(1, 1 << filters):
        # the filter that the Gray code toggles at this turn
        k = (turn & -turn).bit_length() - 1
        subset ^= 1 << k
        hit = (masks >> k & 1).astype(bool)
        if subset >> k & 1:
            gone = hit & (active == 0)
            active[hit] += 1
            alive = alive - weights[gone].sum(axis=0)
        else:
            active[hit] -= 1
            alive = alive + weights[hit & (active == 0)].sum(axis=0)
        states[subset] = alive
    return states


def audit(counted: DataFrame, letters: str = "".join(CHECKS) + COPY) -> DataFrame:
    """counted (part, mask, n, good, toxic) -> STEPS: each step of each order of the filters of each part."""
    n = len(letters)
    orders = list(permutations(range(n)))
    filter_of = np.array(orders)
    after = np.cumsum(1 << filter_of, axis=1)
    before = after - (1 << filter_of)

    def steps(cells: pa.Table) -> pa.Table:
        masks = cells.column("mask").to_numpy()
        weights = np.stack([cells.column(c).to_numpy() for c in ("n", "good", "toxic")], axis=1)
        states = survivors(masks, weights, n)
        lost = states[before] - states[after]
        removed = lost[:, :, 0]
        fails = np.array([weights[masks >> k & 1 == 1, 0].sum() for k in range(n)])
        alone = np.array([weights[masks == 1 << k, 0].sum() for k in range(n)])
        credit = np.array([removed[filter_of == k].sum() for k in range(n)])
        columns = {
            "part": pa.array([cells.column("part")[0].as_py()] * filter_of.size),
            "filter_order": pa.array(["".join(letters[k] for k in order) for order in orders for _ in range(n)]),
            "step": pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), len(orders))),
            "kept": states[after][:, :, 0],
            "removed": removed,
            "redundant": fails[filter_of] - removed,
            "unique_fails": alone[filter_of],
            "good_lost": lost[:, :, 1],
            "toxic_lost": lost[:, :, 2],
            "shapley": credit[filter_of],
        }
        return pa.table({c: v if isinstance(v, pa.Array) else pa.array(v.ravel()) for c, v in columns.items()})

    return counted.groupBy("part").applyInArrow(steps, STEPS)
