"""Formatting reply trees as conversations, with DataFrame functions only.

Messages form trees by their parent's id. `branches` finds every root-to-leaf path by iterative self-joins: each round joins
every message with the message that its pointer has reached, so pointers reach twice as far, and a path of n messages takes
log n rounds. Paths are ranked by the sum of their messages' scores; `paths` then expands the chosen leaves to their messages with
the same pointers. `render` formats each path as one text with a loss mask.

The template of a turn is ``### role: text</turn>`` and a line feed. In roles and texts a backslash, ``#``, ``<`` and ``:`` (in
roles) are written as a backslash and a letter, so no text can hold a mark, and `unescape` is exact.

Defined results: a null text or role is empty; a message whose parent does not exist is a root; null tree ids form one tree; messages
on a cycle belong to no path; of repeated (tree, id) rows one stays (the least by role, then text); equal scores rank by the
leaf's id; other columns are ignored; an empty table gives an empty table.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from notewright.llm.lineage import cut

#: Fixed format: what is escaped, and by what. Unescaping goes in the other order.
ESCAPES = (("\\", "\\s"), ("#", "\\h"), ("<", "\\l"), (":", "\\c"))
HEAD, SEP, TAIL = "### ", ": ", "</turn>\n"


def escape(text: Column) -> Column:
    for a, b in ESCAPES:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unescape(text: Column) -> Column:
    for a, b in reversed(ESCAPES):
        text = F.replace(text, F.lit(b), F.lit(a))
    return text


def branches(messages: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """messages (tree, id, parent, score) -> (leaves, hops).

    leaves: (tree, leaf, length, score, rank), rank 1 being the tree's best branch. hops[k]: (tree, id, up), the message
    2 ** k places above each that has one.
    """
    up = messages.select("tree", "id", F.col("parent").alias("up"))
    ids = messages.select(F.col("tree").alias("t"), F.col("id").alias("i"))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    # a parent that does not exist makes a root
    real = up.where("up is not null").join(ids, same("tree", "t") & (F.col("up") == F.col("i")), "left_semi")
    state = cut(messages.join(real.select(F.col("tree").alias("t"), F.col("id").alias("i"), "up"), same("tree", "t") & (F.col("id") == F.col("i")), "left").select("tree", "id", "up", F.lit(1).cast("long").alias("length"), "score"))
    parents = state.where("up is not null").select(F.col("tree").alias("t"), F.col("up").alias("i")).distinct()
    leaves = state.join(parents, same("tree", "t") & (F.col("id") == F.col("i")), "left_anti").select(F.col("tree").alias("t"), F.col("id").alias("leaf"))
    hops: list[DataFrame] = []
    bound = state.count().bit_length() + 1
    while len(hops) < bound:
        active = state.where("up is not null")
        if active.isEmpty():
            break
        hops.append(active.select("tree", "id", "up"))
        above = state.select(F.col("tree").alias("t"), F.col("id").alias("i"), F.col("up").alias("next"), F.col("length").alias("more"), F.col("score").alias("gain"))
        # every pointer doubles; those that have arrived at a root's end stay
        moved = active.join(above, same("tree", "t") & (F.col("up") == F.col("i"))).select("tree", "id", F.col("next").alias("up"), (F.col("length") + F.col("more")).alias("length"), (F.col("score") + F.col("gain")).alias("score"))
        state = cut(moved.union(state.where("up is null").select("tree", "id", "up", "length", "score")))
    done = state.where("up is null").select("tree", F.col("id").alias("i"), "length", "score")
    ended = done.join(leaves, same("tree", "t") & (F.col("i") == F.col("leaf"))).select("tree", "leaf", "length", "score")
    rank = F.row_number().over(W.partitionBy("tree").orderBy(F.col("score").desc_nulls_last(), "leaf"))
    return ended.withColumn("rank", rank), hops


def paths(chosen: DataFrame, hops: list[DataFrame]) -> DataFrame:
    """chosen (tree, leaf, length, rank) -> (tree, leaf, rank, id, turn), turn 0 being the root.

    Each round, from the longest pointers to the shortest, adds to every message found the one its pointer names.
    """
    found = cut(chosen.select("tree", "leaf", "rank", F.col("leaf").alias("id"), (F.col("length") - 1).alias("turn")))
    for k in reversed(range(len(hops))):
        hop = hops[k].select(F.col("tree").alias("t"), F.col("id").alias("i"), "up")
        more = found.join(hop, F.col("tree").eqNullSafe(F.col("t")) & (F.col("id") == F.col("i"))).select("tree", "leaf", "rank", F.col("up").alias("id"), (F.col("turn") - (1 << k)).alias("turn"))
        found = cut(found.union(more))
    return found


def render(turns: DataFrame, learn: str = "assistant") -> DataFrame:
    """turns (tree, leaf, rank, turn, role, text) -> (tree, leaf, rank, n_turns, formatted, loss_spans).

    loss_spans: of each turn by `learn` its text, as (turn, block: where the turn begins, start, length) in code points of formatted.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    block = turns.withColumns({"head": F.concat(F.lit(HEAD), escape(role), F.lit(SEP)), "body": escape(text), "learned": role == learn})
    size = F.length("head") + F.length("body") + len(TAIL)
    before = F.coalesce(F.sum(size).over(W.partitionBy("tree", "leaf", "rank").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = block.withColumn("block", before.cast("long"))
    span = F.when(F.col("learned"), F.struct("turn", "block", (F.col("block") + F.length("head")).alias("start"), F.length("body").cast("long").alias("length")))
    whole = placed.groupBy("tree", "leaf", "rank").agg(F.count(F.lit(1)).alias("n_turns"), F.collect_list(F.struct("turn", F.concat("head", "body", F.lit(TAIL)).alias("s"))).alias("parts"), F.collect_list(span).alias("spans"))
    return whole.select("tree", "leaf", "rank", "n_turns", F.array_join(F.transform(F.array_sort("parts"), lambda p: p["s"]), "").alias("formatted"), F.array_sort("spans").alias("loss_spans"))


def turns_of(formatted: Column) -> Column:
    """The turns read back: array of (role, text)."""
    blocks = F.transform(F.slice(F.split(formatted, TAIL, -1), 1, F.size(F.split(formatted, TAIL, -1)) - 1), lambda b: F.substr(b, F.lit(len(HEAD) + 1)))
    return F.transform(blocks, lambda b: F.struct(unescape(F.substring_index(b, SEP, 1)).alias("role"), unescape(F.substr(b, F.length(F.substring_index(b, SEP, 1)) + len(SEP) + 1)).alias("text")))


def learned(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, read back."""
    blocks = F.split(formatted, TAIL, -1)
    whole = F.transform(F.array(F.struct(blocks.alias("blocks"), spans.alias("spans"))), lambda s: F.transform(s["spans"], lambda x: F.substr(F.get(s["blocks"], x["turn"].cast("int")), (x["start"] - x["block"] + 1).cast("int"), x["length"].cast("int"))))[0]
    return unescape(F.array_join(whole, ""))


def format_trees(messages: DataFrame, best: int | None = None, learn: str = "assistant") -> DataFrame:
    """messages (tree, id, parent, role, text, score) -> one formatted conversation for each of the `best` branches of a tree
    (all, if None)."""
    once = cut(messages.groupBy("tree", "id").agg(F.min(F.struct("role", "text", "parent", "score")).alias("m")).select("tree", "id", "m.*"))
    leaves, hops = branches(once.select("tree", "id", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")))
    chosen = leaves if best is None else leaves.where(F.col("rank") <= best)
    texts = once.select(F.col("tree").alias("t"), F.col("id").alias("i"), "role", "text")
    walked = paths(chosen, hops).join(texts, F.col("tree").eqNullSafe(F.col("t")) & (F.col("id") == F.col("i"))).select("tree", "leaf", "rank", "turn", "role", "text")
    return render(walked, learn)


def chains(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) -> messages, each turn replying to the one before (ties by role and text)."""
    place = F.row_number().over(W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")).cast("long")
    return rows.select(F.col("conv_id").alias("tree"), place.alias("id"), F.when(place > 1, place - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))
