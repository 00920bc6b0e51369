"""Joins on time: the last earlier row, and overlapping intervals."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def asof_backward(left: DataFrame, right: DataFrame, on: str, by: list[str], take: list[str]) -> DataFrame:
    """left with the columns `take` of the last row of right, within `by`, whose `on` is not after left's.

    One sorted pass over the union of both sides: no range join, whatever the sizes.
    """
    row = F.struct(*[F.col(c) for c in left.columns])
    found = F.struct(*[F.col(c) for c in take])
    a = left.select(*by, F.col(on).alias("_at"), F.lit(1).alias("_side"), row.alias("_row"), F.lit(None).cast(right.select(found.alias("f")).schema["f"].dataType).alias("_found"))
    b = right.select(*by, F.col(on).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(left.select(row.alias("r")).schema["r"].dataType).alias("_row"), found.alias("_found"))
    last = F.last("_found", ignorenulls=True).over(W.partitionBy(*by).orderBy("_at", "_side").rowsBetween(W.unboundedPreceding, 0))
    joined = a.unionByName(b).withColumn("_last", last).where("_side = 1")
    return joined.select("_row.*", *[F.col(f"_last.{c}").alias(c) for c in take])


def buckets(start: Column, end: Column, origin: Column, hop: float, width: float) -> Column:
    """Numbers i >= 0 of the windows [origin + i * hop, + width) that the interval [start, end) overlaps."""
    low = F.greatest(F.floor((start - origin - width) / hop) + 1, F.lit(0).cast("long"))
    high = F.ceil((end - origin) / hop) - 1
    return F.when(high >= low, F.sequence(low, high))
