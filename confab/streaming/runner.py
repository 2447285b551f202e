"""Run a streaming plan over everything available and hand back what it wrote."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from confab.session import scratch_path


def stream_of(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table of ``folder`` as a stream of files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").option(
        "maxFilesPerTrigger", 64).parquet(folder)


@contextmanager
def keyed_state(spark: SparkSession):
    """Streams started inside keep their state in RocksDB, which processors with map state, lifetimes and timers need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def in_batches(rows: DataFrame, order: Column, batches: int, label: str) -> DataFrame:
    """A stored table as a stream of ``batches`` micro-batches, written one after the other, one a trigger.

    ``order`` says which part, from 0, a row belongs to. Every part is written by all cores, as the same number of files; where
    fewer tasks had rows, empty files make up the number, so a trigger takes exactly one part.
    """
    spark = rows.sparkSession
    path, files = scratch_path(spark, label), spark.sparkContext.defaultParallelism
    none = spark.createDataFrame([], rows.schema)
    for k in range(batches):
        rows.where(order == k).repartition(files).write.mode("append").parquet(path)
        for _ in range((k + 1) * files - len(spark.read.schema(rows.schema).parquet(path).inputFiles())):
            none.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)


def drain(stream: DataFrame) -> DataFrame:
    """Append-mode rows, through a file sink with a checkpoint in the shared folder."""
    spark = stream.sparkSession
    path = scratch_path(spark, "stream")
    q = (stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state")
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def drain_updates(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Latest version per key of an update-mode stream.

    Every micro-batch overwrites its own folder, so a repeated batch changes nothing.
    """
    spark = stream.sparkSession
    path = scratch_path(spark, "updates")

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={batch_id}")

    q = (stream.writeStream.foreachBatch(save).option("checkpointLocation", f"{path}/state").outputMode("update")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    rows = spark.read.parquet(f"{path}/out")
    cols = [c for c in rows.columns if c != "batch"]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*cols), "batch").alias("r")).select("r.*")


def split_sinks(stream: DataFrame, good: str, reject: str, status: str = "status") -> None:
    """Write rows whose status is ``ok`` and all others to two parquet folders, one scan per batch."""
    spark = stream.sparkSession

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        batch.where(F.col(status) == "ok").write.mode("overwrite").parquet(f"{good}/batch={batch_id}")
        batch.where(F.col(status) != "ok").write.mode("overwrite").parquet(f"{reject}/batch={batch_id}")
        batch.unpersist()

    q = (stream.writeStream.foreachBatch(save).option("checkpointLocation", scratch_path(spark, "split"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
