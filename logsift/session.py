"""Spark session helpers.

The defaults here are what the operators assume: UTC session time, AQE on
(runtime coalescing and skew-join splitting), duplicate map keys resolved
last-wins (header maps), no web UI.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

_LOCAL: dict[str, str] = {}
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Generated methods above ~8 KB of bytecode are never JIT-compiled by the
    # JVM; falling back to per-operator code for those is faster than running
    # one huge interpreted method (wide header/trace projections hit this).
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str = "local[8]", shuffle_partitions: int = 8,
                app_name: str = "logsift", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def apply_session_defaults(spark: SparkSession) -> SparkSession:
    """Set the SQL confs the operators rely on, on an existing session."""
    for k, v in DEFAULT_CONF.items():
        if k.startswith("spark.sql."):
            spark.conf.set(k, v)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    ``spark.checkpoint.dir`` names it and is used as is.  Only a local master
    (tests, benchmarks) may go without: it gets a scratch folder that is
    removed with the session.  A cluster without a shared folder is an error,
    as a machine-local one would be invisible to the executors.
    """
    current = spark.conf.get("spark.checkpoint.dir", None) or \
        spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if current:
        spark.sparkContext.setCheckpointDir(current)
        return current
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    local = _LOCAL.get(spark.sparkContext.applicationId)
    if local is None:
        local = _LOCAL[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="logsift-ckpt-")
        jpath = spark._jvm.org.apache.hadoop.fs.Path(f"file://{local}")
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
        spark.sparkContext.setCheckpointDir(local)
    return local


def materialize(df, eager: bool = True):
    """Cut lineage by writing ``df`` to the reliable checkpoint folder.

    Used where a large intermediate feeds several branches (so it is not
    recomputed per branch) and to bound recovery work when executors are
    lost.  Never a local checkpoint: executor-local blocks die with the
    executor.  The table is compressed Parquet, of which each branch reads
    its own columns only; what Parquet cannot hold is checkpointed.
    """
    ensure_checkpoint_dir(df.sparkSession)
    names = [name.lower() for name in df.columns]
    if not eager or len(set(names)) < len(names) or any(t in df.schema.simpleString() for t in ("void", "interval")):
        return df.checkpoint(eager=eager)
    return written(df, "stage")


def ensure_parallelism(df, min_partitions: int | None = None):
    """Spread a scan whose splits are few *and* far from full.

    A small table stored as one file with one row group scans as a single
    task, and every row-wise stage after it (parsing, regex, hashing) would
    run single-threaded until the first shuffle.  A large table whose splits
    are already near ``maxPartitionBytes`` is left alone: more tasks come
    from its own splits, and a repartition would only add a shuffle.
    Filters and column pruning still reach the scan below the repartition.
    """
    spark = df.sparkSession
    want = min_partitions or spark.sparkContext.defaultParallelism
    have = df.rdd.getNumPartitions()
    if have >= want:
        return df
    try:
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        split = int(str(spark.conf.get("spark.sql.files.maxPartitionBytes", "134217728")).rstrip("b"))
    except Exception:  # noqa: BLE001 - estimates unavailable: be conservative
        return df
    if size >= have * split // 2:
        return df
    return df.repartition(want)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder in the shared checkpoint folder, removed when the
    session's JVM ends."""
    import uuid
    path = f"{ensure_checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def written(df, label: str):
    """``df`` as a compressed Parquet table in the shared checkpoint folder:
    the lineage is cut as by :func:`materialize`, wide texts take less disk.
    The shuffle files behind the table are removed once it is written; nothing
    else reads them, and they would pile up beside the tables until the
    driver's next garbage collection."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def shuffled_beyond(df, rows: int):
    """A written table for a join: above ``rows`` rows it is shuffled, below
    that its size decides.  Joins are planned by the size of files, and a few
    MB of compressed text may be far too much memory to broadcast."""
    return df if df.count() <= rows else df.hint("merge")
