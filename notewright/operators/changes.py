"""Tables kept by key: the last writer wins, and a batch that comes twice changes nothing."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewright.shared import cut

BUCKETS = 64


def latest(rows: DataFrame, key: str, version: str) -> DataFrame:
    """Of each key the row of the highest version; of equal versions one and the same, however the rows are dealt out."""
    names = rows.columns
    best = F.max_by(F.struct(*names), F.struct(version, F.xxhash64(*[F.to_json(F.struct(c)) for c in names])))
    return rows.groupBy(F.col(key).alias("_key")).agg(best.alias("_row")).select("_row.*")


def merged(table: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """table after changes; what either lacks is null."""
    return latest(table.unionByName(changes, allowMissingColumns=True), key, version)


def apply(changes: DataFrame, path: str, key: str, version: str, buckets: int = BUCKETS) -> None:
    """changes into the table at path, which is laid out by buckets of its key: only those that change are read and written again. A run that is
    broken off and comes again gives the same table."""
    spark = changes.sparkSession
    new = changes.withColumn("bucket", F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int"))
    to = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not to.getFileSystem(spark._jsc.hadoopConfiguration()).exists(to):
        rows = latest(new, key, version)
    else:
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]
        old = spark.read.parquet(path).where(F.col("bucket").isin(touched))
        rows = merged(old, new, key, version)
    # written aside before files go
    rows = cut(rows)
    if not rows.isEmpty():
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def load(spark, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket")
