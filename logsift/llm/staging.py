"""Written intermediates in the cluster's shared checkpoint folder.

Lineage is cut by writing a Parquet table under ``spark.checkpoint.dir`` and
reading it back: every executor sees it, a lost executor loses nothing, and
a Python stage runs once (a reliable RDD checkpoint would run it twice).
The tables are removed when the session's JVM ends.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from logsift.session import ensure_checkpoint_dir


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{ensure_checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


#: For tables of large, already compressed values: the codec would only copy
#: them through off-heap buffers as large as a page.
PACKED = {"compression": "uncompressed"}


def materialise(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of finished jobs now (it
    acts when the driver's JVM collects its garbage)."""
    import gc
    gc.collect()
    spark._jvm.System.gc()
