"""Packing tokenised documents into training sequences: first-fit decreasing in randomised groups.

A document is its token ids and an end id. Whole stretches of the sequence length fill sequences of their own; what
is left over of each document is placed, longest first, in the first sequence of its group that has room, which a
tournament tree over the sequences' free room finds in logarithmic time. Groups are random and of bounded size, so any
source, length or repeated row spreads over them.

Defined results: a null or empty text is the end id alone; repeated rows are separate documents with separate places; a
null doc_id stays null; columns beyond doc_id and text are ignored; an empty table gives an empty table.
"""

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END = 1
ROOM = 2048
#: Documents in a group, about.
GROUP = 4096
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """Byte-level BPE ids. tiktoken does the work, being several times as fast over the same vocabulary; a text that
    its pattern can't take (millions of spaces in a row) goes to tokenizers. The ids are equal, as the tests show."""

    def __init__(self, vocabulary: str | None = None, ranks: str | None = None):
        import public_tokenizers
        import tiktoken

        self.vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
        with open(ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={"<|endoftext|>": len(table)})
        self.slow = None

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all")
        except ValueError:
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.vocabulary)
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


def first_fit_decreasing(sizes: np.ndarray, room: int = ROOM) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset in it) of each item. tree[k] is the largest free room below node k; leaf b is bin b."""
    leaves = 1 << max(0, int(len(sizes) - 1).bit_length())
    tree = [room] * (2 * leaves)
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for item in np.argsort(-sizes, kind="stable").tolist():
        size, node = int(sizes[item]), 1
        while node < leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        bins[item], offsets[item] = node - leaves, room - tree[node]
        tree[node] -= size
        while node > 1:
            node //= 2
            best = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best
    return bins, offsets


def pieces(docs: DataFrame, room: int = ROOM, vocabulary: str | None = None, ranks: str | None = None) -> DataFrame:
    """docs (doc_id, text, key...) -> each document's stretches of at most `room` ids."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = None
        for batch in batches:
            encode = encode or Encoder(vocabulary, ranks)
            rows: list[list[int]] = [[] for _ in range(5)]
            for k, text in enumerate(batch.column("text")):
                ids = np.append(encode(text.as_py()), np.uint32(END)).astype("<u4", copy=False)
                for start in range(0, len(ids), room):
                    part = ids[start : start + room]
                    for column, x in zip(rows, (k, start, len(part), zlib.crc32(part), len(ids)), strict=True):
                        column.append(x)
            own = pa.array(rows[0], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(own), batch.column("key").take(own), *(pa.array(x, pa.int64()) for x in rows[1:])], ["doc_id", "key", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.mapInArrow(scan, "doc_id long, key long, start long, length long, ids_crc32 long, doc_tokens long")


def pack(docs: DataFrame, room: int = ROOM, group: int = GROUP, seed: int = 7, vocabulary: str | None = None, ranks: str | None = None) -> DataFrame:
    """docs (doc_id, text) -> a row for each piece, with its sequence and its offset there."""
    groups = max(1, -(-docs.count() // group))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("n"))
    keyed = keyed.select("doc_id", "text", F.pmod(F.xxhash64("n", F.lit(seed)), F.lit(groups)).alias("key"))

    def place(table: pa.Table) -> pa.Table:
        length = table.column("length").to_numpy()
        full = length == room
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        bins, offset[~full] = first_fit_decreasing(length[~full], room)
        sequence[~full] = bins
        used = int(bins.max()) + 1 if len(bins) else 0
        sequence[full] = used + np.arange(int(full.sum()))
        key = table.column("key").to_numpy()
        return table.drop_columns(["key"]).append_column("sequence_id", pa.array((key << 32) + sequence)).append_column("offset", pa.array(offset))

    return pieces(keyed, room, vocabulary, ranks).groupBy("key").applyInArrow(place, SCHEMA)
