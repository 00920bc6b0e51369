"""Substring search by character trigrams.

`postings` is a table of the trigrams of each row's lower-case text. A needle's trigrams are looked up, the keys that have all of them are candidates, and the real
condition decides, so an index gives the rows that a scan gives. Only trigrams of ASCII characters are looked up (case folding of others depends on what is around them); a needle
without one is answered by a scan. `save` lays the table out by buckets of trigrams, so a search reads the buckets of its needle.
"""

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 256


def trigrams(text: Column) -> Column:
    """The distinct trigrams of a lower-case text."""
    low = F.lower(text)
    return F.when(F.length(low) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda k: F.substr(low, k, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def postings(rows: DataFrame, key: str, text: Column) -> DataFrame:
    """(gram, key) of all rows, once each."""
    return rows.select(F.col(key), F.explode(trigrams(F.coalesce(text, F.lit("")))).alias("gram")).distinct()


def bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def save(index: DataFrame, path: str) -> None:
    rows = index.withColumn("bucket", bucket(F.col("gram")))
    rows.repartition("bucket").sortWithinPartitions("bucket", "gram").write.mode("overwrite").partitionBy("bucket").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def wanted(needle: str) -> list[str]:
    """The trigrams that a text must have if a LIKE pattern's literal pieces are in it."""
    pieces = re.split("[%_]", needle.lower())
    return sorted({p[k : k + 3] for p in pieces for k in range(len(p) - 2) if p[k : k + 3].isascii()})


def candidates(index: DataFrame, key: str, needle: str) -> DataFrame | None:
    """The keys (key) whose texts may hold the needle, or None if its trigrams say nothing."""
    grams = wanted(needle)
    if not grams:
        return None
    found = index.where(F.col("gram").isin(grams))
    if "bucket" in index.columns:
        own = index.sparkSession.range(1).select(F.array_distinct(F.array(*[bucket(F.lit(g)) for g in grams]))).first()[0]
        found = found.where(F.col("bucket").isin(own))
    # a text has a trigram once, so its count tells whether all are there
    return found.groupBy(key).agg(F.count(F.lit(1)).alias("_grams")).where(F.col("_grams") == len(grams)).select(key)


def search(rows: DataFrame, index: DataFrame, key: str, needle: str, holds: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """holds(rows), for a condition `holds` that only rows whose text has the needle can meet; key: what index knows rows by."""
    some = candidates(index, key, needle)
    return holds(rows if some is None else rows.join(some, key, "left_semi"))
