"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings the operators count on at scale; all may be changed on a live session.
ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join partition even where a later aggregate would reuse its partitioning.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # A task's share is bounded in bytes, so its hash tables and sorts do not grow with the input; more input is more tasks.
    "spark.sql.files.maxPartitionBytes": "16m",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
}
# Shuffles begin with at least so many partitions, and adaptive execution joins them up to the advisory size.
INITIAL_PARTITIONS = 1000

_fallback: dict[str, str] = {}
_made: set[str] = set()


def tune(spark: SparkSession) -> SparkSession:
    for key, value in ADAPTIVE.items():
        spark.conf.set(key, value)
    partitions = max(INITIAL_PARTITIONS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(partitions))
    return spark


def build_session(master: str = "local[*]", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Local session for tests and the bench; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(master)
        .appName("lacuna")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it in spark.checkpoint.dir.

    Only a local session without that setting falls back to a temporary folder.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = context.applicationId
    if app not in _fallback:
        _fallback[app] = tempfile.mkdtemp(prefix="lacuna-")
    return _fallback[app]


def run_folder(spark: SparkSession) -> str:
    """Folder of this application below the shared one; removed by the JVM when the application ends."""
    folder = f"{shared_dir(spark)}/lacuna/{spark.sparkContext.applicationId}"
    if folder not in _made:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(conf)
        files.mkdirs(path)
        files.deleteOnExit(path)
        _made.add(folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the run folder; never reused, so reruns cannot read stale files."""
    return f"{run_folder(spark)}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Used where a result is read more than once or decides a join: later steps start from the files, a lost
    executor costs no recomputation, and Catalyst sees the real size instead of an estimate.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
