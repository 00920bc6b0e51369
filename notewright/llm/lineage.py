"""Cutting lineage through storage that all executors share."""

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints. Only a local session that names none, as in tests, gets a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint df, now."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def cut_and_count(df: DataFrame, which: Column | None = None) -> tuple[DataFrame, int]:
    """cut(df), and of how many rows a condition holds (all, if none is given), told by the same job."""
    seen = Observation()
    out = cut(df.observe(seen, F.count(F.lit(1) if which is None else F.when(which, 1)).alias("n")))
    return out, seen.get["n"] or 0


def table(df: DataFrame, name: str, **options: object) -> DataFrame:
    """df, written to the shared folder now and read from there."""
    to = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(compression="zstd", **options).parquet(to)
    return df.sparkSession.read.schema(df.schema).parquet(to)


def drop(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared storage that nothing reads any more."""
    to = spark._jvm.org.apache.hadoop.fs.Path(path)
    to.getFileSystem(spark._jsc.hadoopConfiguration()).delete(to, True)
