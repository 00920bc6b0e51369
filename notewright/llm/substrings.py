"""Removing passages that occur earlier in the corpus, by sharded automata of confirmed phrases.

A window is WINDOW consecutive words of one document. A word goes if a window that covers it has the same words as a
window that starts earlier: in a document of smaller id, or earlier in the same document.

1. Of each window the phrase of PHRASE words with the least hash is its anchor; equal windows have equal anchors. Units of documents
   ask, by hash, how often each of their anchors occurs in the corpus (`exchange`). Neighbouring windows of one anchor make a
   passage; a unit sends each distinct passage of an anchor that seems to recur, with the smallest id that has it, to its anchor's shard.
2. A shard confirms by their words which phrases recur, compiles an Aho-Corasick automaton of those, and streams the passages of all
   documents through it. Only windows that hold an occurrence go on. They are compared word by word; the smallest id that has each
   goes back to all units with the passage.
3. Each unit removes the words that later windows cover.

Equal passages of all units are one row before a shard sees them, so a passage that is everywhere makes no hot group. A phrase that
occurs more than HOT times, in ever other surroundings, would: its windows are passages of their own and are dealt by all their words, which
equal windows share. So a group of one anchor, or of one window, has at most HOT passages; a shard has those that its share of the text gives it.

Defined results: a null text has no words; rows of one id are different documents of which neither is earlier; a null id
comes after all others; repeated rows come out alike; other columns are ignored; an empty table gives an empty table.
"""

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewright.llm import exchange
from notewright.llm.lineage import table
from notewright.llm.words import U64, Words, joined, mixed, split, word_hashes

WINDOW, PHRASE = 20, 5
#: Occurrences above which an anchor's windows are dealt one by one; bytes of text to a shard of passages.
HOT, SHARD = 10_000, 6_000_000
LAST = np.iinfo(np.int64).max
A, B = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)


def _grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n words in a row, from each place on (those that leave the array are cut off), by doubling."""
    out, have, power, size = None, 0, h, 1
    while True:
        if n & size:
            if out is None:
                out, have = power, size
            else:
                m = max(0, len(h) - have - size + 1)
                out, have = mixed(out[:m] * A + power[have : have + m] * B + U64(size)), have + size
        if size * 2 > n:
            return out[: max(0, len(h) - n + 1)]
        m = max(0, len(power) - size)
        power, size = mixed(power[:m] * A + power[size : size + m]), size * 2


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """The least of n places from each place on."""
    size = 1
    while size * 2 <= n:
        x, size = np.minimum(x[:-size], x[size:]), size * 2
    return np.minimum(x[: len(x) - (n - size)], x[n - size :]) if n > size else x


def anchors(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows' first words, place of each one's anchor: the first phrase of least hash in it, the anchors' keys)."""
    doc = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    windows = np.flatnonzero(doc[: len(doc) - WINDOW + 1] == doc[WINDOW - 1 :]) if len(doc) >= WINDOW else np.zeros(0, np.int64)
    if not len(windows):
        return windows, windows, np.zeros(0, U64)
    with np.errstate(over="ignore"):
        gram = _grams(word_hashes(w), PHRASE)
    least = _least(gram, WINDOW - PHRASE + 1)[windows]
    at, open_ = np.full(len(windows), -1), np.arange(len(windows))
    for back in range(WINDOW - PHRASE + 1):
        hit = gram[windows[open_] + back] == least[open_]
        at[open_[hit]] = windows[open_[hit]] + back
        open_ = open_[~hit]
        if not len(open_):
            break
    with np.errstate(over="ignore"):
        return windows, at, mixed(gram[at] ^ A)


class Passages(NamedTuple):
    """Runs of windows with one anchor: first word, number of windows, words before the anchor, key, whether dealt alone."""

    start: np.ndarray
    windows: np.ndarray
    offset: np.ndarray
    key: np.ndarray
    alone: np.ndarray


def passages(windows: np.ndarray, at: np.ndarray, keys: np.ndarray, total: np.ndarray, most: int = HOT) -> Passages:
    """Those of anchors that occur more than once in the corpus. total: occurrences of each window's anchor; above `most` windows stand alone."""
    keep = total > 1
    windows, at, keys, hot = windows[keep], at[keep], keys[keep], total[keep] > most
    new = np.ones(len(windows), bool)
    new[1:] = (at[1:] != at[:-1]) | hot[1:]
    begin = np.flatnonzero(new)
    return Passages(windows[begin], np.diff(np.append(begin, len(windows))), at[begin] - windows[begin], keys[begin], hot[begin])


def _slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Runs of bytes as a column."""
    sizes = ends - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    take = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], sizes)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data[take])])


def _pieces(blob: bytes) -> Iterator[tuple[pa.RecordBatch, np.ndarray, Words]]:
    for rows in exchange.unpacked(blob):
        yield rows, rows.column("doc_id").fill_null(LAST).to_numpy(zero_copy_only=False), joined(split(rows.column("text"), lower=False))


def _keys(rows: Iterable[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """A unit's distinct anchors and how many occurrences of each it has."""
    found = []
    for b in rows:
        _, at, keys = anchors(joined(split(b.column("text"), lower=False)))
        found.append(keys[np.diff(at, prepend=-1) != 0])
    return np.unique(np.concatenate(found) if found else np.zeros(0, U64), return_counts=True)


#: A unit's passages, and, under place -1, its note to itself: which passage is where.
SENT = "unit long, place int, shard int, spread long, offset int, windows int, words binary, least long, n long"


def send(own: pa.Table, told: pa.Table, shards: int, hot: int = HOT) -> pa.Table:
    out, notes, row = [], [], 0
    if not own.num_rows:
        raise RuntimeError(exchange.CHANGED)
    blob = own.column("blob")[0].as_py()
    keys, _ = _keys(exchange.unpacked(blob))
    (total,) = exchange.values_of(told, len(keys), 1)
    for _, ids, w in _pieces(blob):
        windows, at, anchor = anchors(w)
        p = passages(windows, at, anchor, total[np.searchsorted(keys, anchor)], hot)
        doc = np.searchsorted(w.first, p.start, "right") - 1
        last = p.start + p.windows + WINDOW - 2
        words = _slices(w.data, w.starts[p.start], w.starts[last] + w.lengths[last])
        spread = p.key.copy()
        if p.alone.any():
            with np.errstate(over="ignore"):
                spread[p.alone] = mixed(_grams(word_hashes(w), WINDOW)[p.start[p.alone]])
        out.append(pa.table([words, pa.array(spread), pa.array(p.offset.astype(np.int32)), pa.array(p.windows.astype(np.int32)), pa.array(ids[doc])], ["words", "spread", "offset", "windows", "id"]))
        notes.append(np.stack([row + doc, p.start - w.first[doc], p.windows]))
        row += len(w.first) - 1
    every = pa.concat_tables(out) if out else None
    # the same words are one passage; units of the same rows, which have one number, count as often as there are
    if every is None or not every.num_rows:
        of, distinct, n, least = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    else:
        of = every.column("words").combine_chunks().dictionary_encode().indices.to_numpy()
        ids = every.column("id").to_numpy()
        order = np.argsort(of, kind="stable")
        begin = np.flatnonzero(np.diff(of[order], prepend=-1))
        distinct, n, least = order[begin], np.diff(np.append(begin, len(order))) * own.num_rows, np.minimum.reduceat(ids[order], begin)
    note = exchange.squeeze(of.astype(np.int64), *(np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*notes, strict=True)))
    m, unit = len(distinct), own.column("unit")[0].as_py()
    head = pa.table([pa.array([unit]), pa.array([-1], pa.int32()), pa.array([-1], pa.int32()), pa.array([0]), pa.array([0], pa.int32()), pa.array([len(of)], pa.int32()), pa.array([note], pa.binary()), pa.array([0]), pa.array([0])], SENT_NAMES)
    if not m:
        return head
    body = every.take(pa.array(distinct))
    spread = body.column("spread").to_numpy()
    shard = ((spread >> U64(32)) * U64(shards) >> U64(32)).astype(np.int32)
    rest = [pa.array(np.full(m, unit)), pa.array(np.arange(m, dtype=np.int32)), pa.array(shard), pa.array(spread.view(np.int64)), body.column("offset"), body.column("windows"), body.column("words"), pa.array(least), pa.array(n)]
    return pa.concat_tables([head, pa.table(rest, SENT_NAMES)])


SENT_NAMES = [c.split()[0] for c in SENT.split(", ")]


def confirmed(phrases: list[bytes], n: list[int]) -> list[bytes]:
    """Phrases, by their words, that occur more than once."""
    count: dict[bytes, int] = {}
    for p, k in zip(phrases, n, strict=True):
        count[p] = count.get(p, 0) + k
    return [p for p, k in count.items() if k > 1]


def hits(texts: list[bytes], phrases: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, place of its byte behind the phrase) of every occurrence of a phrase in a text, by an automaton."""
    import ahocorasick

    if not phrases:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    automaton = ahocorasick.Automaton()
    for p in phrases:
        automaton.add_word(" " + p.decode("latin-1") + " ", 0)
    automaton.make_automaton()
    # no word has a line feed in it, so no phrase goes from one text into the next
    stream = "".join(f" {t.decode('latin-1')} \n" for t in texts)
    ends = np.fromiter((end for end, _ in automaton.iter(stream)), np.int64)
    begins = np.concatenate([[0], np.cumsum([len(t) + 3 for t in texts])])
    text = np.searchsorted(begins, ends, "right") - 1
    return text, ends - begins[text] - 1


def decide(own: pa.Table) -> pa.Table:
    """Of a shard's passages, for those that hold windows which occur more than once: the smallest id that has each window, and the
    window's number in the shard."""
    texts, offsets, sizes = own.column("words").to_pylist(), own.column("offset").to_pylist(), own.column("windows").to_pylist()
    least, n = own.column("least").to_pylist(), own.column("n").to_pylist()
    w = split(pa.array(texts, pa.binary()).view(pa.string()), lower=False)
    starts, ends = w.starts, w.starts + w.lengths
    begins = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    first = w.first[:-1]
    at = first + np.array(offsets)
    phrases = [t[a:b] for t, a, b in zip(texts, (starts[at] - begins[:-1]).tolist(), (ends[at + PHRASE - 1] - begins[:-1]).tolist(), strict=True)]
    text, behind = hits(texts, confirmed(phrases, n))
    # a hit's words end where it ends: count the words that begin before
    last = np.searchsorted(starts, begins[text] + behind) - 1
    held = np.zeros(len(starts) + 1, np.int64)
    held[last - PHRASE + 1 + 1] = 1
    held = np.cumsum(held)
    numbers: dict[bytes, int] = {}
    smallest: list[int] = []
    times: list[int] = []
    of: list[list[int]] = []
    for k, (t, m) in enumerate(zip(texts, sizes, strict=True)):
        a, base, mine = int(first[k]), int(begins[k]), []
        some = (held[a + WINDOW - PHRASE + 1 : a + WINDOW - PHRASE + 1 + m] > held[a : a + m]).tolist()
        lows, highs = starts[a : a + m].tolist(), ends[a + WINDOW - 1 : a + WINDOW - 1 + m].tolist()
        for low, high, held_ in zip(lows, highs, some, strict=True):
            if not held_:
                mine.append(-1)
                continue
            number = numbers.setdefault(t[low - base : high - base], len(smallest))
            if number == len(smallest):
                smallest.append(least[k])
                times.append(n[k])
            else:
                smallest[number] = min(smallest[number], least[k])
                times[number] += n[k]
            mine.append(number)
        of.append(mine)
    shard, spread, words = [], [], []
    lesser, numbered = [], []
    for k, mine in enumerate(of):
        mine = [x if x >= 0 and times[x] > 1 else -1 for x in mine]
        if any(x >= 0 for x in mine):
            ids = [smallest[x] if x >= 0 else LAST for x in mine]
            lesser.append(ids if min(ids) != max(ids) else ids[:1])
            numbered.append(mine if mine[0] < 0 or mine != list(range(mine[0], mine[0] + len(mine))) else mine[:1])
            spread.append(k)
    kept = own.take(pa.array(spread, pa.int64()))
    return pa.table([kept.column("shard"), kept.column("h1"), kept.column("h2"), pa.array(lesser, pa.list_(pa.int64())), pa.array(numbered, pa.list_(pa.int32()))], ["shard", "h1", "h2", "lesser", "numbers"])


DECIDED = "shard int, h1 long, h2 long, lesser array<long>, numbers array<int>"


def removed(lengths: np.ndarray, ids: np.ndarray, note: pa.Table, answers: pa.Table) -> np.ndarray:
    """Whether each word of a unit goes. lengths: words of each text."""
    first = np.concatenate([[0], np.cumsum(lengths)])
    gone = np.zeros(int(first[-1]) + 1, np.int64)
    size = note.column("windows")[0].as_py()
    if size and answers.num_rows:
        of, row, start, windows = exchange.expand(note.column("words")[0].as_py(), size, *[np.int64] * 4)
        place = answers.column("place").to_numpy()
        which = np.full(int(of.max()) + 1, -1)
        which[place] = np.arange(len(place))
        keep = which[of] >= 0
        of, row, start, windows = which[of[keep]], row[keep], start[keep], windows[keep]
        # every window of every such passage: its text, its first word, and what its shard says of it
        inner = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
        of, row, start = np.repeat(of, windows), np.repeat(row, windows), np.repeat(start, windows) + inner
        least, _ = _spread(answers.column("lesser"), of, inner)
        number, short = _spread(answers.column("numbers"), of, inner)
        number = number.astype(np.int64) + np.where(short, inner, 0)
        number = np.where(number < 0, -1, number + (answers.column("shard").to_numpy().astype(np.int64)[of] << 32))
        later = (number >= 0) & (least < ids[row])
        order = np.lexsort((start, row, number))
        again = np.zeros(len(of), bool)
        again[order[1:]] = (number[order][1:] == number[order][:-1]) & (row[order][1:] == row[order][:-1]) & (number[order][1:] >= 0)
        go = first[row] + start
        go = go[later | again]
        np.add.at(gone, go, 1)
        np.add.at(gone, go + WINDOW, -1)
    return np.cumsum(gone[:-1]) > 0


def _spread(lists: pa.ChunkedArray, of: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(element `inner` of list `of`, or its only element, whether the list is that short)."""
    lists = lists.combine_chunks()
    values, sizes = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
    begin = np.cumsum(sizes) - sizes
    short = sizes[of] == 1
    return values[begin[of] + np.where(short, 0, inner)], short


def dedup_passages(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, n_words, n_removed, kept: the words left, joined by one space). hot: occurrences above which an anchor's
    windows are dealt one by one."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = exchange.all_bytes(docs)
    shards, ranges = size // SHARD + 16, exchange.ranges(size, 0.2)

    def ask(unit: int, part: int, rows: Iterator[pa.RecordBatch]) -> pa.Table:
        keys, n = _keys(rows)
        return exchange.questions(unit, part, keys, [n], ranges)

    packed = exchange.stored(docs, F.lit(0))
    told = exchange.tell(exchange.each(packed, ask, exchange.ASKED), [np.add]).select("unit", "shard", "size", "body")
    sent = packed.groupBy("unit").cogroup(told.groupBy("unit")).applyInArrow(lambda own, told: send(own, told, shards, hot), SENT)
    sent = table(sent, "passages")
    # a passage's name of 128 bits is worked out where it is needed: bytes that are noise are neither written nor exchanged with its words
    named = lambda rows: rows.withColumns({"h1": F.xxhash64("words", "spread"), "h2": F.xxhash64(F.lit(7), "spread", "words")})
    # equal passages of all units become one row within the shard's own partition
    once = sent.where("place >= 0").repartition("shard").groupBy("shard", "spread", "words", "offset", "windows").agg(F.min("least").alias("least"), F.sum("n").alias("n"))
    decided = named(once).groupBy("shard").applyInArrow(decide, DECIDED)
    back = named(sent.where("place >= 0")).select("unit", "place", "shard", "h1", "h2").join(decided, ["shard", "h1", "h2"]).select("unit", "place", "shard", F.lit(None).cast("int").alias("windows"), F.lit(None).cast("binary").alias("words"), "lesser", "numbers")
    notes = sent.where("place < 0").select("unit", "place", "shard", "windows", "words", F.lit(None).cast("array<long>").alias("lesser"), F.lit(None).cast("array<int>").alias("numbers"))

    def cut(own: pa.Table, mail: pa.Table) -> pa.Table:
        noted = mail.column("place").to_numpy() < 0
        if not own.num_rows or not noted.any():
            raise RuntimeError(exchange.CHANGED)
        note, answers = mail.filter(pa.array(noted)), mail.filter(pa.array(~noted))
        out: list[pa.Table] = []
        for blob in own.column("blob"):
            pieces = list(_pieces(blob.as_py()))
            goes = removed(np.concatenate([np.diff(w.first) for _, _, w in pieces]), np.concatenate([ids for _, ids, _ in pieces]), note, answers)
            at = 0
            for rows, _, w in pieces:
                stay = ~goes[at : at + len(w.starts)]
                at += len(w.starts)
                n, left = np.diff(w.first), np.concatenate([[0], np.cumsum(stay)])
                out.append(pa.table([rows.column("doc_id"), pa.array(n), pa.array(n - (left[w.first[1:]] - left[w.first[:-1]])), kept_words(w, stay)], ["doc_id", "n_words", "n_removed", "kept"]))
        return pa.concat_tables(out)

    return packed.groupBy("unit").cogroup(notes.union(back).groupBy("unit")).applyInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")


def kept_words(w: Words, stay: np.ndarray) -> pa.Array:
    kept = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if stay[a:b].all():
            kept.append(w.data[w.starts[a] : w.starts[b - 1] + w.lengths[b - 1]].tobytes() if b > a else b"")
        else:
            own = np.flatnonzero(stay[a:b]) + a
            kept.append(b" ".join(w.data[s : s + n].tobytes() for s, n in zip(w.starts[own].tolist(), w.lengths[own].tolist(), strict=True)))
    return pa.array(kept, pa.binary()).view(pa.string())
