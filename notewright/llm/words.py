"""Words of whole Arrow text columns, and hashes of words and shingles, without a Python object per word.

A word is a run of bytes other than space and 0x09-0x0D. Null texts have no words.
"""

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Keeps the first n bytes of a little-endian lane.
MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=U64)
#: Words beyond this many bytes are hashed one by one.
LONG_WORD = 256


class Words(NamedTuple):
    """data: bytes; word k covers data[starts[k] : starts[k] + lengths[k]]; text d has words first[d] to first[d + 1] - 1."""

    data: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    first: np.ndarray


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the offsets of its texts in them; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64, len(texts) + 1, 8 * texts.offset) if len(texts) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[at[0] : at[-1]], at - at[0]


def split(texts: pa.Array, lower: bool) -> Words:
    data, at = text_bytes(texts)
    if lower:
        data = LOWER[data]
    inside = ~SPACE[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edge = at[(at > 0) & (at < len(data))]
    begins[edge] = inside[edge]
    ends[edge - 1] = inside[edge - 1]
    starts = np.flatnonzero(begins)
    return Words(data, starts, np.flatnonzero(ends) + 1 - starts, np.searchsorted(starts, at))


def joined(w: Words) -> Words:
    """The same words with one space between neighbours, so that a run of words is a run of bytes."""
    if not len(w.starts):
        return w
    to = np.cumsum(w.lengths + 1) - w.lengths - 1
    out = np.full(int(to[-1] + w.lengths[-1]), 32, np.uint8)
    gap = np.zeros(len(out) + 1, bool)
    gap[to[1:] - 1] = True
    inside = np.zeros(len(w.data) + 1, np.int8)
    np.add.at(inside, w.starts, 1)
    np.add.at(inside, w.starts + w.lengths, -1)
    out[~gap[:-1]] = w.data[np.cumsum(inside[:-1], dtype=np.int8).view(bool)]
    return Words(out, to, w.lengths, w.first)


def lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one little-endian number."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    return np.ndarray((len(data) + 9,), "<u8", padded, 0, (1,))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def word_hashes(w: Words, seed: int = 0) -> np.ndarray:
    """64 bits for each word, the same for the same bytes in any batch."""
    view, n = lanes(w.data), len(w.starts)
    h = mixed(w.lengths.astype(U64) + U64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    who, at, left = np.arange(n), w.starts, w.lengths.copy()
    long = np.flatnonzero(left > LONG_WORD)
    if len(long):
        for k in long:
            h[k] = xxhash.xxh64_intdigest(w.data[w.starts[k] : w.starts[k] + w.lengths[k]].tobytes(), seed)
        who = np.flatnonzero(left <= LONG_WORD)
        at, left = at[who], left[who]
    while len(who):
        x = (h[who] ^ (view[at] & MASK[np.minimum(left, 8)])) * U64(0x9FB21C651E98DF25)
        h[who] = x ^ (x >> U64(29))
        more = left > 8
        who, at, left = who[more], at[more] + 8, left[more] - 8
    return mixed(h)


P1, P2, P3, P4, P5 = map(U64, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x << U64(n)) | (x >> U64(64 - n))


def _lane(x: np.ndarray) -> np.ndarray:
    return _turn(x * P2, 31) * P1


def xxh64(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 (a published, fixed function) of many byte runs at once."""
    with np.errstate(over="ignore"):
        view, n, s = lanes(data), len(starts), U64(seed)
        h = np.full(n, s + P5, U64)
        at, left = starts.copy(), lengths.copy()
        who = np.flatnonzero(left >= 32)
        if len(who):
            acc = [np.full(len(who), x, U64) for x in (s + P1 + P2, s + P2, s, s - P1)]
            on, pos, rest = np.arange(len(who)), at[who], left[who]
            while len(on):
                for k in range(4):
                    acc[k][on] = _turn(acc[k][on] + view[pos + 8 * k] * P2, 31) * P1
                pos, rest = pos + 32, rest - 32
                go = rest >= 32
                on, pos, rest = on[go], pos[go], rest[go]
            x = _turn(acc[0], 1) + _turn(acc[1], 7) + _turn(acc[2], 12) + _turn(acc[3], 18)
            for k in range(4):
                x = (x ^ _lane(acc[k])) * P1 + P4
            h[who] = x
            at[who] += left[who] & ~31
            left[who] &= 31
        h += lengths.astype(U64)
        who = np.flatnonzero(left >= 8)
        while len(who):
            h[who] = _turn(h[who] ^ _lane(view[at[who]]), 27) * P1 + P4
            at[who] += 8
            left[who] -= 8
            who = who[left[who] >= 8]
        who = np.flatnonzero(left >= 4)
        h[who] = _turn(h[who] ^ ((view[at[who]] & MASK[4]) * P1), 23) * P2 + P3
        at[who] += 4
        left[who] -= 4
        who = np.flatnonzero(left > 0)
        while len(who):
            h[who] = _turn(h[who] ^ ((view[at[who]] & MASK[1]) * P5), 11) * P1
            at[who] += 1
            left[who] -= 1
            who = who[left[who] > 0]
        h = (h ^ (h >> U64(33))) * P2
        h = (h ^ (h >> U64(29))) * P3
        return h ^ (h >> U64(32))


def portions(batches: Iterator[pa.RecordBatch], column: str, most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about that many bytes of text, so that memory has a bound; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.diff(text_bytes(batch.column(column))[1])
        part = (np.cumsum(sizes) - sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)
