"""A training corpus from raw documents: five stages, each written as Parquet and read again as the next one's input."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewright.llm import line_dedup, mixing, near_copies, packing, quality


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labelled rows outside the held-out fold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0)
    model = quality.train(docs, labels.select("doc_id", F.col("quality").alias("label")))
    return quality.keep(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the multi-line chunks that came before; n_chars follows the text."""
    row = F.struct(*docs.columns).alias("row")
    short = line_dedup.dedup_lines(docs.select("doc_id", "text", row))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return short.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest id. Candidates are the SimHash operator's links and shared MinHash
    bands; sets of five-word shingles, of a Jaccard index of 0.8 or more, decide."""
    return near_copies.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    row = F.struct(*docs.columns).alias("row")
    mixed = mixing.mix(docs.select("doc_id", "text", "source", row)).where("copies > 0")
    return mixed.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*[F.col("row")[c].alias(c) for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in training sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can't express the classifier, the fingerprints' links or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir. What lies between stages is written to the folder that executors share, and removed when
    the next stage has been written; only the last stage's input stays, for whoever reads the result."""
    from notewright.llm.lineage import drop, shared_folder

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base, before = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        if before:
            drop(spark, before)
        before = f"{base}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
