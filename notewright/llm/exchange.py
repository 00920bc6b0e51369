"""Figures of keys over the whole corpus, told to every unit of text that has them.

An operator that needs, for every word or phrase of a text, a figure of the whole corpus deals its rows into units of text. A
unit asks once for each distinct key: its sorted keys go out in one message for each range of keys that it has any of, with as many
values as the operator adds up. A range adds up what all units sent and answers each. Keys travel as compressed planes of bytes.

There are as many ranges as the text needs for a range's keys to fit a task, and RANGES at least, so that small texts go the way of some 30 GB. A
message holds one key or more, so there are never more messages than keys, and both grow with the text alone; from some 30 TB on, where a unit has a
key or so in each range, a message is much like a row of a plain grouping by key.

Units are written to the shared folder once, and all that is said of a unit is said of what was written: an executor that is lost
changes none. A unit whose answers are not there fails, and no count goes to another text.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewright.llm.lineage import table
from notewright.llm.words import U64, portions, text_bytes

#: Bytes of text in a unit, and of a piece that is worked on at once, about.
UNIT, PIECE = 16_000_000, 2_000_000
#: Ranges of keys, at least; keys that all units send to a range, about.
RANGES, MOST_KEYS = 4096, 4_000_000
#: Bytes of text to a token, about; only the number of ranges depends on it.
TOKEN = 5

ASKED = "shard int, unit long, part int, size int, body binary"
TOLD = "unit long, part int, shard int, size int, body binary, stats array<long>"
CHANGED = "a unit's answers are not there"
Stats = Callable[[np.ndarray, list[np.ndarray]], list[int]]


def units(docs: DataFrame, part: Column, then: Callable[[int, int, list[pa.RecordBatch]], pa.Table], schema: str, most: int | None = None) -> DataFrame:
    """What `then` makes of each unit (its number, its part, its rows): rows of one part and of one scan's partition, in order."""
    keep, most = list(docs.columns), most or UNIT

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.RecordBatch]] = {}
        size: dict[int, int] = {}

        def emit(k: int) -> Iterator[pa.RecordBatch]:
            rows, size[k] = held.pop(k), 0
            yield from then(number(k, rows), k, rows).to_batches()

        for rows in portions(batches, "text", PIECE):
            kinds = rows.column("part").to_numpy(zero_copy_only=False)
            for k in np.unique(kinds).tolist():
                own = rows.filter(pa.array(kinds == k)).select(keep)
                held.setdefault(k, []).append(own)
                size[k] = size.get(k, 0) + own.get_total_buffer_size()
                if size[k] >= most:
                    yield from emit(k)
        for k in list(held):
            yield from emit(k)

    return docs.select(*keep, part.cast("int").alias("part")).mapInArrow(scan, schema)


def number(part: int, rows: list[pa.RecordBatch]) -> int:
    """The same for the same rows in the same order."""
    h = xxhash.xxh3_64(seed=part)
    for b in rows:
        data, at = text_bytes(b.column("text"))
        h.update(np.ascontiguousarray(data))
        h.update(np.ascontiguousarray(at))
        h.update(b.column("doc_id").fill_null(-1).to_numpy(zero_copy_only=False).tobytes())
    return h.intdigest() >> 1


def pack_rows(rows: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=5))) as out:
        for b in rows:
            out.write_batch(b)
    return sink.getvalue().to_pybytes()


def stored(docs: DataFrame, part: Column) -> DataFrame:
    """docs (doc_id, text) -> (unit, part, blob): the units' rows, written."""

    def keep(unit: int, k: int, rows: list[pa.RecordBatch]) -> pa.Table:
        return pa.table([pa.array([unit]), pa.array([k], pa.int32()), pa.array([pack_rows(rows)], pa.binary())], ["unit", "part", "blob"])

    # a file is looked at for its size after each unit, so that a group of rows that a task reads at once stays small
    small = {"parquet.block.size": 32 << 20, "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 2}
    return table(units(docs, part, keep, "unit long, part int, blob binary"), "units", **small)


def each(stored: DataFrame, then: Callable[[int, int, Iterator[pa.RecordBatch]], pa.Table], schema: str) -> DataFrame:
    """What `then` makes of each unit (its number, its part, its rows)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for unit, k, blob in zip(*b.columns, strict=True):
                yield from then(unit.as_py(), k.as_py(), unpacked(blob.as_buffer())).to_batches()

    return stored.select("unit", "part", "blob").mapInArrow(scan, schema)


def unpacked(blob: bytes | pa.Buffer) -> Iterator[pa.RecordBatch]:
    """The rows of a unit, piece by piece."""
    yield from pa.ipc.open_stream(blob)


def squeeze(*columns: np.ndarray) -> bytes:
    """Columns of 64-bit numbers as compressed planes of bytes: in sorted keys and small counts most planes hardly change."""
    planes = [np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T.ravel() for x in columns]
    return zstandard.ZstdCompressor(level=1).compress(np.concatenate(planes) if planes else b"")


def expand(body: bytes, size: int, *kinds: type) -> list[np.ndarray]:
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8)
    return [np.ascontiguousarray(data[8 * size * k : 8 * size * (k + 1)].reshape(8, size).T).view(kind).ravel() for k, kind in enumerate(kinds)]


def written(keys: np.ndarray, *values: np.ndarray) -> bytes:
    """Sorted distinct keys, as gaps, and values: bytes of the gaps that are below their mean's are noise and stay as they are."""
    planes = np.diff(keys, prepend=U64(0)).view(np.uint8).reshape(-1, 8).T
    noise = int(np.log2(float(keys[-1] - keys[0]) / len(keys) + 1)) // 8
    rest = np.concatenate([planes[noise:].ravel(), *(np.ascontiguousarray(v).view(np.uint8).reshape(-1, 8).T.ravel() for v in values)])
    return bytes([noise]) + planes[:noise].tobytes() + zstandard.ZstdCompressor(level=1).compress(rest)


def read(body: bytes, size: int, values: int) -> list[np.ndarray]:
    """The keys and values (int64) of a message."""
    noise = body[0]
    planes = np.concatenate([np.frombuffer(body, np.uint8, noise * size, 1), np.frombuffer(zstandard.ZstdDecompressor().decompress(body[1 + noise * size :]), np.uint8)]).reshape(-1, 8, size)
    gaps, *others = (np.ascontiguousarray(p.T) for p in planes)
    return [np.cumsum(gaps.view(U64).ravel(), dtype=U64), *(v.view(np.int64).ravel() for v in others)][: 1 + values]


def runs(keys: np.ndarray, shards: int) -> list[tuple[int, int, int]]:
    """(shard, from, to) of the ranges that sorted keys fall into."""
    bounds = np.searchsorted(((keys >> U64(32)) * U64(shards)) >> U64(32), np.arange(shards + 1, dtype=U64))
    return [(k, int(bounds[k]), int(bounds[k + 1])) for k in np.flatnonzero(np.diff(bounds)).tolist()]


def ranges(bytes_in_all: int, per_token: float) -> int:
    """Ranges for a text of that size, of which units send per_token keys for each token, about."""
    return max(RANGES, -(-int(bytes_in_all / TOKEN * per_token) // MOST_KEYS))


def questions(unit: int, part: int, keys: np.ndarray, values: list[np.ndarray], shards: int) -> pa.Table:
    """Messages of a unit: sorted distinct keys and the values (int64) that it adds to each."""
    parts = runs(keys, shards)
    bodies = [written(keys[a:b], *(v[a:b] for v in values)) for _, a, b in parts]
    return pa.table(
        [pa.array([k for k, _, _ in parts], pa.int32()), pa.array([unit] * len(parts), pa.int64()), pa.array([part] * len(parts), pa.int32()), pa.array([b - a for _, a, b in parts], pa.int32()), pa.array(bodies, pa.binary())],
        ["shard", "unit", "part", "size", "body"],
    )


def added(keys: list[np.ndarray], values: list[list[np.ndarray]], how: list[np.ufunc]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """(distinct keys, their values over all messages, of each message's keys the places among them)."""
    every = np.concatenate(keys)
    order = np.argsort(every, kind="stable")
    inner = every[order]
    new = np.concatenate([[True], inner[1:] != inner[:-1]])
    begin, of = np.flatnonzero(new), np.empty(len(every), np.int64)
    of[order] = np.cumsum(new) - 1
    total = [ufunc.reduceat(np.concatenate([v[c] for v in values])[order], begin) for c, ufunc in enumerate(how)]
    ends = np.cumsum([len(k) for k in keys])
    return inner[begin], total, np.split(of, ends[:-1])


def _read(asked: pa.Table, columns: int) -> tuple[list[np.ndarray], list[list[np.ndarray]]]:
    got = [read(b.as_py(), n, columns) for b, n in zip(asked.column("body"), asked.column("size").to_pylist(), strict=True)]
    return [g[0] for g in got], [g[1:] for g in got]


def tell(asked: DataFrame, how: list[np.ufunc], stats: Stats | None = None) -> DataFrame:
    """asked (ASKED) -> TOLD: of each message the keys' values over all messages, in the order of its keys. stats: figures of the distinct
    keys, in one row of each range."""
    names = ["unit", "part", "shard", "size"]

    def answer(asked: pa.Table) -> pa.Table:
        keys, values = _read(asked, len(how))
        known, total, of = added(keys, values, how)
        noted = [list(stats(known, total)) if stats else None] + [None] * (len(of) - 1)
        return pa.table([*(asked.column(c) for c in names), pa.array([squeeze(*(t[o] for t in total)) for o in of], pa.binary()), pa.array(noted, pa.list_(pa.int64()))], [*names, "body", "stats"])

    return asked.groupBy("shard").applyInArrow(answer, TOLD)


def values_of(told: pa.Table, size: int, columns: int) -> list[np.ndarray]:
    """A unit's values in the order of its keys, from the answers of all ranges; units of the same rows got the same ones."""
    order = np.unique(told.column("shard").to_numpy(), return_index=True)[1].tolist()
    sizes, bodies = told.column("size").to_pylist(), told.column("body")
    got = [expand(bodies[k].as_py(), sizes[k], *[np.int64] * columns) for k in order]
    out = [np.concatenate([g[c] for g in got]) if got else np.zeros(0, np.int64) for c in range(columns)]
    if len(out[0]) != size:
        raise RuntimeError(CHANGED)
    return out


def all_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
