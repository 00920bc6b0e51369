"""Mixing sources to target weights by Pareto order sampling.

`targets` shares a budget of words among sources by weight, each capped at a multiple of its own size, the excess
reshared. `mix` then takes documents: every document of a source first gets the whole copies that the ratio of target
to size makes certain; for the fraction that is left, documents are ranked by their random odds divided by their
inclusion odds (Pareto order sampling; inclusion is unequal, by a weight that rises slowly with size) and taken from
the smallest on, until the words taken are as near the target as the order allows. A document's random number comes
from its id and text, so reruns agree.

Where the order is cut is found by refining histograms of the rank: a source is never sorted or gathered, however large.

Defined results: a null text has size 0; a null source is a source, last in order; a null id is allowed; rows that
repeat a document in id and text are one document and all taken the same number of times; columns beyond those named
stay as they are; an empty table gives an empty table; a source without any word has target 0 and none is taken.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from notewright.llm.lineage import cut

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of sources in order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
SHARE, CAP = 1.5, 2.0
#: Bits of a rank, and bits refined in a round.
RANK_BITS, STEP = 50, 10


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """sizes (source, source_size), a row for each source -> with target double.

    Water is poured by weight: sources in order of cap to weight fill up first, so the level follows from running sums
    over one row a source.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    k = F.row_number().over(order)
    ranked = sizes.withColumns({"weight": F.element_at(F.array(*map(F.lit, weights)), (F.pmod(k - 1, F.lit(len(weights))) + 1).cast("int")), "most": cap * F.col("source_size")})
    fills = W.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = W.partitionBy()
    filled = ranked.withColumns(
        {
            "before": F.coalesce(F.sum("most").over(fills.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)),
            "rest": F.sum("weight").over(fills.rowsBetween(0, W.unboundedFollowing)),
            "budget": share * F.sum("source_size").over(everything),
        }
    )
    level = F.greatest(F.col("budget") - F.col("before"), F.lit(0.0)) / F.col("rest")
    # full sources come first; the first that its share does not fill has the level of all others, later rows show less
    filled = filled.withColumn("level", F.when(F.col("most") <= level * F.col("weight"), None).otherwise(level))
    common = F.max("level").over(everything)
    return filled.select("source", "source_size", F.coalesce(F.least(F.col("most"), common * F.col("weight")), F.col("most")).alias("target"))


#: Up to so many sources their figures are sent to all tasks; beyond, they are joined by source.
FEW = 10_000


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = 11) -> DataFrame:
    """docs (doc_id, text, source, ...) -> the same rows with size, source_size, target and copies (columns of these names give way)."""
    kept = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies")]
    draw = F.xxhash64("doc_id", "text", F.lit(seed))
    sized = docs.select(F.struct(*kept).alias("row"), "source", word_count(F.col("text")).alias("size"), draw.alias("draw"))
    slim = cut(sized.select("source", "size", "draw"))
    # a document's chance of a further copy rises slowly with its size
    lean = F.log2(F.col("size") + 2.0)
    totals = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * lean).alias("leaning"))
    plan = targets(totals.select("source", "source_size"), weights, share, cap).join(totals.select(F.col("source").alias("s"), "leaning"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = plan.withColumns({"whole": F.floor(ratio + 1e-12)})
    plan = cut(plan.withColumns({"part": F.greatest(ratio - F.col("whole"), F.lit(0.0)), "lift": F.when(F.col("leaning") > 0, F.col("source_size") / F.col("leaning")).otherwise(0.0)}))

    def rank(draw: Column, size: Column, part: Column, lift: Column) -> Column:
        """Random odds over inclusion odds, squeezed to a whole number of RANK_BITS bits."""
        u = (F.pmod(draw, F.lit(1 << 52)) + 0.5) / float(1 << 52)
        chance = F.least(part * lift * F.log2(size + 2.0), F.lit(1 - 1e-9))
        odds = (u / (1 - u)) * ((1 - chance) / chance)
        return F.when(chance > 0, F.floor(odds / (1 + odds) * ((1 << RANK_BITS) - 1)))

    named = plan.select(F.col("source").alias("s"), "source_size", "target", "whole", "part", "lift")
    few = named.limit(FEW + 1).count() <= FEW
    small = lambda t: F.broadcast(t) if few else t
    same = F.col("source").eqNullSafe(F.col("s"))
    ranked = cut(slim.where("size > 0").join(small(named), same).select("s", "size", rank(F.col("draw"), F.col("size"), F.col("part"), F.col("lift")).alias("rank")).where("rank is not null"))

    # state: per source the prefix of bits under which the cut lies, and the words still to take below it
    state = plan.select(F.col("source").alias("s"), F.lit(0).cast("long").alias("prefix"), (F.col("part") * F.col("source_size")).alias("need"))
    state = cut(state.where("need > 0"))
    low = RANK_BITS
    while low > 0:
        low -= STEP
        a, b = state.alias("a"), ranked.alias("b")
        inside = b.join(small(a), F.col("a.s").eqNullSafe(F.col("b.s")) & (F.shiftright(F.col("rank"), low + STEP) == F.col("prefix"))).select("b.s", "size", "need", F.shiftright(F.col("rank"), low).alias("at"))
        counts = inside.groupBy("s", "at").agg(F.sum("size").alias("words"), F.max("need").alias("need"), F.count(F.lit(1)).alias("n"))
        up = F.sum("words").over(W.partitionBy("s").orderBy("at"))
        # the first bucket that reaches what is needed, or the last
        found = counts.withColumn("upto", up).withColumn("reached", F.col("upto") >= F.col("need"))
        ends = found.groupBy("s").agg(
            F.coalesce(F.min(F.when(F.col("reached"), F.struct("at", (F.col("need") - F.col("upto") + F.col("words")).alias("need"), "words", "n"))), F.max(F.struct("at", (F.col("need") - F.col("upto") + F.col("words")).alias("need"), "words", "n"))).alias("e")
        )
        state = cut(ends.select("s", F.col("e.at").alias("prefix"), F.col("e.need").alias("need"), F.col("e.words").alias("words"), F.col("e.n").alias("n")))
        if not state.where("n > 1").limit(1).count():
            break
    # what is left is one rank, all but surely one document: take it if that comes nearer
    last = F.shiftleft(F.col("prefix"), low) + F.when(F.col("words") <= 2 * F.col("need"), (1 << low) - 1).otherwise(-1)
    ends = state.select(F.col("s").alias("t"), last.alias("last"))
    decided = cut(named.join(ends, F.col("s").eqNullSafe(F.col("t")), "left").drop("t"))
    out = sized.join(small(decided), same, "left").withColumn("rank", rank(F.col("draw"), F.col("size"), F.col("part"), F.col("lift")))
    copies = F.col("whole") + F.coalesce((F.col("rank") <= F.col("last")).cast("int"), F.lit(0))
    copies = F.when(F.col("size") > 0, copies).otherwise(F.least(copies, F.lit(1))).cast("long")
    return out.withColumn("copies", copies).select("row.*", "size", "source_size", "target", "copies")
