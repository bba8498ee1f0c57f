"""Incremental ingest: file streams with checkpoints, landings with a high-water mark per layer, durable state."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacuna.operators import resolve, spatial
from lacuna.operators.joins import sized

#: Keys and running values live in an embedded store on the executors' disks, whose changes go to the checkpoint; only
#: a bounded cache is held in memory.
DURABLE_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
}


@contextlib.contextmanager
def durable_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state as DURABLE_STATE says; a checkpoint made otherwise keeps its own way."""
    before = {k: spark.conf.get(k, None) for k in DURABLE_STATE}
    for k, v in DURABLE_STATE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def arrivals(spark: SparkSession, folder: str, schema: T.StructType, pattern: str, per_batch: int = 1000) -> DataFrame:
    """Stream of files landing in a folder."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", per_batch)
        .parquet(folder)
    )


def filter_since(rows: DataFrame, registered: str, since: str) -> DataFrame:
    """Rows registered after a date; works on batches and streams."""
    return rows.where(F.col(registered) > F.lit(since).cast("timestamp_ntz"))


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append everything that has arrived to a parquet folder, then stop. A rerun adds only new files."""
    with durable_state(stream.sparkSession):
        query = (
            stream.writeStream.format("parquet")
            .option("path", path)
            .option("checkpointLocation", checkpoint)
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _runs(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the finished runs: those whose marks were written to the end."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/marks")
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(at):
        return []
    names = [f.getPath().getName() for f in files.listStatus(at)]
    runs = [int(n.removeprefix("run=")) for n in names if n.startswith("run=")]
    return sorted(r for r in runs if _exists(spark, f"{path}/marks/run={r}/_SUCCESS"))


def _landed(spark: SparkSession, path: str, kind: str, runs: list[int], schema: T.StructType) -> DataFrame:
    if not runs:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/{kind}/run={r}" for r in runs])


def marks(spark: SparkSession, path: str, layer: T.DataType, registered: T.DataType, before: int | None = None) -> DataFrame:
    """(layer, mark): the latest registration that finished runs have taken of each layer."""
    schema = T.StructType([T.StructField("layer", layer), T.StructField("mark", registered)])
    runs = [r for r in _runs(spark, path) if before is None or r < before]
    return _landed(spark, path, "marks", runs, schema).groupBy("layer").agg(F.max("mark").alias("mark"))


def land(rows: DataFrame, layer: str, registered: str, path: str, run: int | None = None) -> int:
    """Take the rows of each layer that were registered after the layer's mark, then move the marks; gives the run's number.

    Rows go to `path`/rows/run=n first and the new marks to `path`/marks/run=n; a run counts once its marks stand. A run that
    broke off is done again from the same marks and overwrites what it left, so nothing is lost or comes twice. A layer
    without a mark is taken whole, but for rows without a registration, which no run takes. Rows without a layer are a layer.
    """
    spark = rows.sparkSession
    run = max(_runs(spark, path), default=-1) + 1 if run is None else run
    kinds = rows.schema[layer].dataType, rows.schema[registered].dataType
    held = sized(marks(spark, path, *kinds, before=run).select(F.col("layer").alias("_layer"), F.col("mark").alias("_mark")))
    since = rows.join(held, rows[layer].eqNullSafe(held["_layer"]), "left")
    fresh = since.where(F.col(registered).isNotNull() & (F.col("_mark").isNull() | (F.col(registered) > F.col("_mark"))))
    fresh.drop("_layer", "_mark").write.mode("overwrite").parquet(f"{path}/rows/run={run}")
    taken = spark.read.schema(rows.schema).parquet(f"{path}/rows/run={run}")
    moved = taken.groupBy(F.col(layer).alias("layer")).agg(F.max(registered).alias("mark"))
    moved.write.mode("overwrite").parquet(f"{path}/marks/run={run}")
    return run


def landed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of all finished runs."""
    return _landed(spark, path, "rows", _runs(spark, path), schema)


def land_stream(stream: DataFrame, layer: str, registered: str, path: str, checkpoint: str) -> None:
    """`land` for every batch of files that has arrived, then stop; a batch that is tried again keeps its number."""
    query = (
        stream.writeStream.foreachBatch(lambda batch, number: (land(batch, layer, registered, path, number), None)[1])
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def dedup_stream(stream: DataFrame, key: str) -> DataFrame:
    """First row per key, however late it or its copies come: every key seen stays in the state of the checkpoint.

    Rows without a key count as copies of each other. Run by `run_to_table`, the state lies on disk, not in memory.
    """
    return stream.dropDuplicates([key])


def species_state_stream(stream: DataFrame) -> DataFrame:
    """Running latest year per species (0 = year unknown)."""
    return stream.groupBy("ktsn").agg(F.max(F.coalesce("year", F.lit(0))).alias("last_year"))


def run_state_to_table(state: DataFrame, path: str, checkpoint: str) -> None:
    """Write changed states batch by batch; the latest batch per species is the current state."""

    def upsert(batch: DataFrame, batch_id: int) -> None:
        # Each batch owns a folder that a retry overwrites, so a repeated batch adds nothing.
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    with durable_state(state.sparkSession):
        query = (
            state.writeStream.foreachBatch(upsert)
            .option("checkpointLocation", checkpoint)
            .outputMode("update")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()


def current_state(spark: SparkSession, path: str) -> DataFrame:
    """Latest year per species over all state batches."""
    return spark.read.parquet(path).groupBy("ktsn").agg(F.max("last_year").alias("last_year"))


def resolve_stream(
    stream: DataFrame, lookup: DataFrame, overrides: DataFrame, sci: str, kor: str, index: spatial.RegionIndex | None = None,
    unknown: str = spatial.UNKNOWN_PROVINCE,
) -> DataFrame:
    """Arriving rows with the species their names mean and, given a cell index, the region that holds (lon, lat).

    Only stream–static joins: nothing waits for other rows, so the same function serves batches.
    """
    judged = resolve.judge(resolve.with_name_keys(stream, sci, kor), lookup, overrides).drop("sci_key", "kor_key")
    return judged if index is None else spatial.assign_region(judged, index, unknown)
