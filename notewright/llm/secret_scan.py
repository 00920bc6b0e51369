"""Secrets in texts by patterns and by the entropy of sliding windows, with DataFrame functions only.

Patterns find assignments of credentials, access keys and long runs of hex digits. Besides, every run of a character class that is at least
WINDOW characters long is a candidate: a window slides over it, and the Shannon entropy of its characters follows from
counts that change by one for the character that comes and one for that which goes. Where a window reaches the class's threshold the
candidate is a secret, from its first such window's start to its last one's end. A candidate in which an expression of the allow-list is found
(identifiers and compounds of letters, UUIDs, paths, alphabets, examples) is suppressed; what the patterns find never is.

Entropy is compared in whole numbers: of counts c the sum of round(2 ** 20 * c * log2(c)) must not exceed the threshold's, so any order of
updates gives the same decision. A text is read by built-in functions within its row; nothing is shuffled. Long candidates are cut in pieces of PIECE
characters that overlap by a window less one, and places are summed in blocks, so the work is linear in the text but for its root.

Defined results: a null text is empty and has no spans; places count code points, ends are exclusive; spans go by start, then by kind in
the order of KINDS; spans of different kinds may overlap; rows that repeat a document each get their row; other columns are ignored; an empty
table gives an empty table.
"""

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewright.llm.line_dedup import let


class Pattern(NamedTuple):
    """A kind of span: an expression, and how long a group of it must be."""

    kind: str
    pattern: str
    group: int
    least: int


class CharacterClass(NamedTuple):
    """A kind of span: the characters of its candidates, those that count (in lower case, if fold), and bits of entropy of a window."""

    kind: str
    characters: str
    alphabet: str
    fold: bool
    bits: float


#: Fixed by the contract. Its `AKIA[A-Z0-9]+` of 20 characters or more and `[0-9a-f]+` of 24 or more say the length within the expression: what is shorter
#: can hold no match of its own, so the same spans remain, and the many short runs in words are no matches. A short assignment may, so it is matched first.
PATTERNS = (
    Pattern("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Pattern("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    Pattern("hex", r"(?<![0-9a-f])[0-9a-f]{24,}", 0, 24),
)
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CLASSES = (
    CharacterClass("entropy_hex", "0-9A-Fa-f", "0123456789abcdef", True, 3.0),
    CharacterClass("entropy_base64", "A-Za-z0-9+/_=-", f"{UPPER}{LOWER}{DIGITS}+/_=-", False, 3.7),
)
KINDS = tuple(x.kind for x in (*PATTERNS, *CLASSES))
#: Characters in a window, and in a piece of a long candidate.
WINDOW, PIECE = 20, 256
#: Compounds of letters, UUIDs, paths, alphabets in order, and what calls itself an example.
ALLOWED = (
    r"^[A-Za-z]+([_=/+-]+[A-Za-z]+)*[_=/+-]*$",
    r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}",
    r"^/?([a-z0-9_-]+/){3,}",
    r"abcdefghijklmnop|ABCDEFGHIJKLMNOP|0123456789",
    r"EXAMPLE|example",
)
#: 2 ** 20 * c * log2(c) for counts of a window.
WEIGHTS = [round(c * math.log2(c) * 2**20) if c else 0 for c in range(WINDOW + 1)]
#: Counts are kept as characters from this code on.
ZERO = 32


def most_weight(bits: float) -> int:
    """What the weights of a window's counts may sum to, if its entropy is to reach bits."""
    return math.floor(WINDOW * (math.log2(WINDOW) - bits) * 2**20)


def running(lengths: Column) -> Column:
    """Sums of an array up to and with each element. Blocks of root size, so that no array is copied as often as it has elements."""

    def added(xs: Column, start: Column) -> Column:
        return F.slice(F.aggregate(xs, F.array(start), lambda done, x: F.concat(done, F.array(F.element_at(done, -1) + x))), 2, F.size(xs))

    def by_block(xs: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(xs))).cast("int")
        blocks = F.transform(F.sequence(F.lit(1), F.size(xs), width), lambda at: F.slice(xs, at, width))
        return let(blocks, lambda bs: let(added(F.transform(bs, lambda b: F.aggregate(b, F.lit(0), lambda s, x: s + x)), F.lit(0)), lambda ends: F.flatten(F.transform(bs, lambda b, k: added(b, F.coalesce(F.get(ends, k - 1), F.lit(0)))))))

    return F.when(F.size(lengths) > 0, let(lengths, by_block)).otherwise(lengths)


def entropy_hull(text: Column, c: CharacterClass) -> Column:
    """(first, last): places in a candidate where its first window of the class's entropy starts and where the last one ends; null if there is none."""
    alphabet, weights, limit = F.lit(c.alphabet), F.array(*[F.lit(w) for w in WEIGHTS]), most_weight(c.bits)

    def counted(state: Column, ch: Column, by: int) -> Column:
        """The counts and their weight with one more, or one fewer, of a character."""

        def change(j: Column, n: Column) -> Column:
            return F.struct(F.overlay(state["counts"], F.char(n + ZERO + by), j, F.lit(1)).alias("counts"), (state["weight"] + F.get(weights, n + by) - F.get(weights, n)).alias("weight"))

        return let(F.instr(alphabet, ch), lambda j: let(F.ascii(F.substr(state["counts"], j, F.lit(1))) - ZERO, lambda n: change(j, n)))

    def slide(piece: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            def look(now: Column) -> Column:
                hot = (i >= WINDOW) & (now["weight"] <= limit)
                return F.struct(
                    now["counts"].alias("counts"),
                    now["weight"].alias("weight"),
                    F.when(hot, F.coalesce(acc["first"], i - WINDOW)).otherwise(acc["first"]).alias("first"),
                    F.when(hot, i).otherwise(acc["last"]).alias("last"),
                )

            left = F.when(i > WINDOW, counted(acc, F.substr(piece, i - WINDOW, F.lit(1)), -1)).otherwise(F.struct(acc["counts"].alias("counts"), acc["weight"].alias("weight")))
            return let(let(left, lambda state: counted(state, F.substr(piece, i, F.lit(1)), 1)), look)

        none = F.lit(None).cast("int")
        start = F.struct(F.lit(chr(ZERO) * len(c.alphabet)).alias("counts"), F.lit(0).cast("long").alias("weight"), none.alias("first"), none.alias("last"))
        return F.aggregate(F.sequence(F.lit(1), F.length(piece)), start, step)

    def pieces(parts: Column) -> Column:
        """Hulls of the pieces, each with the end of the one before it."""
        with_end = lambda p, k: F.concat(F.when(k > 0, F.right(F.get(parts, k - 1), F.lit(WINDOW - 1))).otherwise(F.lit("")), p)
        moved = lambda h, k: F.struct((h["first"] + k * PIECE - F.when(k > 0, WINDOW - 1).otherwise(0)).alias("first"), (h["last"] + k * PIECE - F.when(k > 0, WINDOW - 1).otherwise(0)).alias("last"))
        return F.transform(parts, lambda p, k: let(let(with_end(p, k), slide), lambda h: moved(h, k)))

    folded = F.lower(text) if c.fold else text
    cut_up = F.regexp_extract_all(folded, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    return let(let(cut_up, pieces), lambda hs: F.struct(F.array_min(F.transform(hs, lambda h: h["first"])).alias("first"), F.array_max(F.transform(hs, lambda h: h["last"])).alias("last")))


def _found(docs: DataFrame, kind: str, pattern: str, group: int, where: Column | None = None) -> DataFrame:
    """docs with columns <kind>_at and <kind>_ends of all matches, left to right, and <kind>_is, the texts of the group; none but where."""
    gaps, found, text = f"{kind}_gaps", f"{kind}_found", F.col("text")
    between = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    docs = docs.withColumn(gaps, between if where is None else F.when(where, between).otherwise(F.array().cast("array<int>")))
    some = F.size(gaps) > 1
    docs = docs.withColumn(found, F.when(some, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
    ends = running(F.transform(F.col(found), lambda m, k: F.get(F.col(gaps), k) + F.length(m)))
    docs = docs.withColumn(f"{kind}_ends", ends)
    docs = docs.withColumn(f"{kind}_at", F.zip_with(F.col(f"{kind}_ends"), F.col(found), lambda e, m: e - F.length(m)))
    named = F.col(found) if group == 0 else F.when(some, F.regexp_extract_all(text, F.lit(pattern), F.lit(group))).otherwise(F.array().cast("array<string>"))
    return docs.withColumn(f"{kind}_is", named).drop(gaps, found)


def _run(c: CharacterClass) -> str:
    return f"(?<![{c.characters}])[{c.characters}]{{{WINDOW},}}"


def _span(kind: str, start: Column, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.cast("int").alias("end"))


def _each(kind: str) -> Column:
    """Zipped matches of a kind."""
    return F.zip_with(F.zip_with(F.col(f"{kind}_at"), F.col(f"{kind}_ends"), lambda a, b: F.struct(a.alias("at"), b.alias("end"))), F.col(f"{kind}_is"), lambda x, s: F.struct(x["at"].alias("at"), x["end"].alias("end"), s.alias("s")))


def find(docs: DataFrame, allow: tuple[str, ...] = ALLOWED) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, base, added): arrays of spans (start, kind: a place in KINDS, end), in order; base by the patterns, added by entropy."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    assign, *runs = PATTERNS
    docs = _found(docs, assign.kind, assign.pattern, assign.group)
    # the last class holds all characters of the other kinds, which take no less of them: a text without its candidates is not read again
    *parts, widest = CLASSES
    docs = _found(docs, widest.kind, _run(widest), 0)
    some = F.size(f"{widest.kind}_at") > 0
    for p in runs:
        docs = _found(docs, p.kind, p.pattern, p.group, some)
    for c in parts:
        docs = _found(docs, c.kind, _run(c), 0, some)

    def long_enough(p: Pattern) -> Column:
        return F.transform(F.filter(_each(p.kind), lambda x: F.length(x["s"]) >= p.least), lambda x: _span(p.kind, x["at"], x["end"]))

    def hot(c: CharacterClass) -> Column:
        meant = F.filter(_each(c.kind), lambda x: ~F.lit(False) if not allow else ~x["s"].rlike("|".join(f"(?:{a})" for a in allow)))
        hulls = F.transform(meant, lambda x: F.struct(x["at"].alias("at"), entropy_hull(x["s"], c).alias("hull")))
        return F.transform(F.filter(hulls, lambda x: x["hull"]["first"].isNotNull()), lambda x: _span(c.kind, x["at"] + x["hull"]["first"], x["at"] + x["hull"]["last"]))

    return docs.select("doc_id", F.array_sort(F.concat(*map(long_enough, PATTERNS))).alias("base"), F.array_sort(F.concat(*map(hot, CLASSES))).alias("added"))


def written(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == KINDS.index(kind))).cast("long")


def redacted(text: Column, spans: Column, mask: str = "[secret]") -> Column:
    """text with a mask in place of what spans (in order) cover; spans that overlap count as one."""
    text = F.coalesce(text, F.lit(""))
    starts = F.filter(spans, lambda x: ~F.exists(spans, lambda y: (y["start"] < x["start"]) & (y["end"] >= x["start"])))
    ends = F.filter(F.transform(spans, lambda x: x["end"]), lambda e: ~F.exists(spans, lambda y: (y["start"] <= e) & (y["end"] > e)))
    # the merged spans' starts and ends in order; between an end and the next start lies what stays
    froms = F.concat(F.array(F.lit(0)), F.array_sort(F.array_distinct(ends)))
    tos = F.concat(F.array_sort(F.array_distinct(F.transform(starts, lambda x: x["start"]))), F.array(F.length(text)))
    return F.array_join(F.zip_with(froms, tos, lambda a, b: F.substr(text, a + 1, b - a)), mask)
