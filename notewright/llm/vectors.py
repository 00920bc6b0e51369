"""Reading vector columns as matrices, and dealing vectors out in blocks of bounded size."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sound(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def matrix(lists: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    values = lists.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(lists), -1) if len(lists) else values.reshape(0, 0)


def block(key: Column, blocks: Column | int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks) if isinstance(blocks, int) else blocks).cast("int")


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, ties to smaller ids."""
    return np.lexsort((ids, -scores))[:k]
