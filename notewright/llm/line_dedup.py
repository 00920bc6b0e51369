"""Removing globally repeated multi-line chunks, with DataFrame functions only.

A rolling hash over the hashes of WINDOW neighbouring lines decides where a chunk ends: at its local minima, so that chunk
borders shift with the text. A chunk has at least two lines, unless its text is one line, and at most LONGEST; where the hash stands
still, as in a run of one line, a chunk ends at every second line. A chunk of two lines or more whose bytes have occurred before (in
a smaller doc_id, or earlier in the document) is removed; single lines stay.

Hashes of all chunks are grouped first. Of hashes that repeat the bytes are compared: the least and the greatest of each, which every task
finds among its own chunks before they travel, so no chunk is a hot group. Chunks of different text under one hash all stay; of
equal ones all but the first go.

Defined results: a null text stays null and has no lines; an empty text is one empty line; a null doc_id comes before
all others; rows that repeat a document in id and text are one document and come out alike; other columns stay as they
are; an empty table gives an empty table.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewright.llm.lineage import table

#: Lines in the rolling hash, and lines in a chunk at most.
WINDOW, LONGEST = 2, 32


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once: what a lambda mentions is otherwise computed at each of its calls."""
    return F.transform(F.array(value), body)[0]


def chunks(text: Column) -> Column:
    """The chunks of a text, in order: an array of arrays of lines."""

    def rolled(h: Column, i: Column) -> Column:
        out = F.lit(0).cast("long")
        for back in reversed(range(WINDOW)):
            out = F.xxhash64(out, F.when(i > back, F.get(h, i - 1 - back)))
        return out

    def lowest(r: Column) -> Column:
        """Of each line whether the hash is at a minimum there and two lines lie on either side."""
        return F.transform(r, lambda v, k: (k >= 1) & (k <= F.size(r) - 3) & (v <= F.get(r, k - 1)) & (v <= F.get(r, k + 1)))

    def apart(low: Column) -> Column:
        """Borders: every second line of each run of minima."""
        at = lambda k: F.coalesce(F.get(low, k), F.lit(False))
        lines = F.sequence(F.lit(1), F.size(low))
        first = F.filter(lines, lambda i: at(i - 1) & ~at(i - 2))
        last = F.filter(lines, lambda i: at(i - 1) & ~at(i))
        return F.flatten(F.zip_with(first, last, lambda a, b: F.sequence(a, b, F.lit(2))))

    def before(ends_at: Column, k: Column) -> Column:
        return F.coalesce(F.get(ends_at, k - 1), F.lit(0))

    def borders(h: Column) -> Column:
        found = let(let(F.transform(h, lambda x, k: rolled(h, k + 1)), lowest), apart)
        return let(F.concat(found, F.array(F.size(h))), lambda e: F.flatten(F.transform(e, lambda b, k: steps(before(e, k), b))))

    def steps(low: Column, high: Column) -> Column:
        """high, and before it every LONGEST - 1 lines after low that leave two lines or more."""
        return F.concat(F.filter(F.sequence(low, F.greatest(low, high - 2), F.lit(LONGEST - 1)), lambda x: x > low), F.array(high))

    def cut_up(lines: Column) -> Column:
        return let(let(F.transform(lines, lambda line: F.xxhash64(line)), borders), lambda to: F.transform(to, lambda b, k: F.slice(lines, before(to, k) + 1, b - before(to, k))))

    return let(F.split(text, "\n", -1), cut_up)


def each_chunk(parts: Column) -> Column:
    """Of chunks of two lines or more: position, hash and length. Single lines are no candidates."""
    hashed = F.transform(parts, lambda c, i: let(F.when(F.size(c) > 1, F.array_join(c, "\n")), lambda s: F.struct(i.alias("at"), F.xxhash64(s).alias("h"), F.length(s).alias("chars"))))
    return F.filter(hashed, lambda x: x["chars"].isNotNull())


def marked(docs: DataFrame) -> DataFrame:
    """docs (doc_id, key, text) -> (doc_id, key, at, h, chars, is_first): every chunk whose hash and length repeat."""
    marks = docs.where("text is not null").select("doc_id", "key", F.explode(each_chunk(chunks(F.col("text")))).alias("x")).select("doc_id", "key", "x.at", "x.h", "x.chars")
    place = F.struct("doc_id", "key", "at")
    # a table of its own, so that both sides of the join are plain exchanges, which adaptive execution splits where a chunk is everywhere
    known = table(marks.groupBy("h", "chars").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("h", "chars", "first"), "chunks")
    return marks.join(known.hint("merge"), ["h", "chars"]).select("doc_id", "key", "at", "h", "chars", (place == F.col("first")).alias("is_first"))


def cut_out(text: Column, gone: Column) -> Column:
    """The lines that are left without the chunks at the positions `gone`. Linear in chunks."""

    def left(c: Column, g: Column) -> Column:
        begin, end = F.concat(F.array(F.lit(0)), F.transform(g, lambda i: i + 1)), F.concat(g, F.array(F.size(c)))
        return F.flatten(F.flatten(F.zip_with(begin, end, lambda a, b: F.slice(c, a + 1, b - a))))

    return let(chunks(text), lambda c: left(c, gone))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) -> the same rows with text shortened, and n_lines, n_removed_lines, n_removed_chunks (columns of these
    names give way)."""
    added = ("n_lines", "n_removed_lines", "n_removed_chunks")
    keep = [c for c in docs.columns if c not in added]
    keyed = docs.select(F.struct(*keep).alias("row"), "doc_id", F.xxhash64("text").alias("key"), "text")
    same = lambda x: F.col("doc_id").eqNullSafe(F.col(f"{x}_id")) & (F.col("key") == F.col(f"{x}_key"))
    named = lambda df, x, **columns: df.groupBy(F.col("doc_id").alias(f"{x}_id"), F.col("key").alias(f"{x}_key")).agg(*[v.alias(c) for c, v in columns.items()])
    marks = marked(keyed.select("doc_id", "key", "text"))
    found = keyed.join(named(marks, "marked", marks=F.collect_set(F.struct("at", "h", "chars", "is_first"))).hint("merge"), same("marked"), "left")

    def carried(text: Column, marks: Column) -> Column:
        return let(chunks(text), lambda c: F.transform(marks, lambda m: F.struct(m["h"].alias("h"), m["chars"].alias("chars"), F.array_join(F.get(c, m["at"]), "\n").alias("bytes"))))

    # bytes of all chunks of one hash and length: the least and the greatest, so that a chunk that is everywhere is one row from each task
    bytes_ = found.where("marks is not null").select(F.explode(carried(F.col("text"), F.col("marks"))).alias("x")).select("x.*")
    apart = table(bytes_.groupBy("h", "chars").agg(F.min("bytes").alias("low"), F.max("bytes").alias("high")).where("low <> high").select("h", "chars"), "collisions")
    if not apart.isEmpty():
        marks = marks.join(apart.hint("merge"), ["h", "chars"], "left_anti")
        found = keyed.join(named(marks, "marked", marks=F.collect_set(F.struct("at", "h", "chars", "is_first"))).hint("merge"), same("marked"), "left")
    later = F.filter("marks", lambda m: ~m["is_first"])
    out = found.withColumn("gone", F.array_sort(F.array_distinct(F.transform(later, lambda m: m["at"]))))
    out = out.withColumn("lines", F.when(F.size("gone") > 0, cut_out(F.col("text"), F.col("gone"))))
    text = F.when(F.col("lines").isNull(), F.col("text")).otherwise(F.array_join("lines", "\n"))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long")
    kept = F.when(F.col("lines").isNull(), n).otherwise(F.size("lines")).cast("long")
    return out.select(*[text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in keep], n.alias(added[0]), (n - kept).alias(added[1]), F.greatest(F.coalesce(F.size("gone"), F.lit(0)), F.lit(0)).cast("long").alias(added[2]))
