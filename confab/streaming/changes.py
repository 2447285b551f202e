"""Change streams merged by key: upserts with a reset per project, and names that reach earlier units of a live session.

Every micro-batch is reduced to one row per key and written to its own folder, so a repeated batch changes nothing; the table as of
now is one grouping over what was written. Nothing is rewritten and no state is held between batches but the checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery


def _latest(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), "seq").alias("r")).select("r.*")


def _resets(changes: DataFrame) -> DataFrame:
    """(project_id, since): the last change of a project that replaces all before it."""
    return changes.groupBy("project_id").agg(F.max(F.when(F.col("replace_existing"), F.col("seq"))).alias("since")).where("since is not null")


def write_upserts(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Run a stream of segment changes (with seq, the order of arrival, and replace_existing) into ``path`` until nothing is left."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        resets = _resets(batch)
        new = batch.join(resets, "project_id", "left").where(F.col("seq") >= F.coalesce("since", F.col("seq")))
        columns = [c for c in batch.columns if c != "replace_existing"]
        _latest(new, ["project_id", "segment_id"], columns).write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")
        resets.write.mode("overwrite").parquet(f"{path}/resets/batch={batch_id}")
        batch.unpersist()

    query = changes.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def upserted(spark: SparkSession, path: str, base: DataFrame) -> DataFrame:
    """The table ``base`` after all changes written so far, as one batch of all of them would leave it."""
    columns = base.columns
    since = spark.read.parquet(f"{path}/resets").groupBy("project_id").agg(F.max("since").alias("since"))
    new = spark.read.parquet(f"{path}/rows").join(since, "project_id", "left").where(F.col("seq") >= F.coalesce("since", F.col("seq")))
    kept = base.join(since, "project_id", "left_anti").withColumn("seq", F.lit(-1).cast("long"))
    return _latest(kept.select(*columns, "seq").unionByName(new.select(*columns, "seq")), ["project_id", "segment_id"], columns)


UNIT = ["session_id", "unit_id", "cluster", "confidence", "profile_id", "profile_score", "provisional", "run", "seq"]


def write_names(identified: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Run a stream of identified live units into ``path``; a name that comes late re-emits the earlier units of its naming period.

    ``identified`` is the output of ``live.online_identify``. Only sessions that get a name in a batch are read again.
    """
    spark = identified.sparkSession
    period = ["session_id", "cluster", "run"]

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        units = batch.where("not named").select(*UNIT)
        names = batch.where("named").select(*period, F.col("profile_id").alias("new_id"), F.col("profile_score").alias("new_score"), F.col("seq").alias("named_at"))
        earlier = units
        if batch_id > 0:
            stored = spark.read.schema(T.StructType([*units.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(f"{path}/rows").where(F.col("batch") < batch_id)
            earlier = earlier.unionByName(_latest(stored.join(F.broadcast(names.select("session_id").distinct()), "session_id", "left_semi").select(*UNIT), ["session_id", "unit_id"], UNIT))
        late = earlier.where("provisional").join(names, period).where(F.col("seq") < F.col("named_at")).select(
            "session_id", "unit_id", "cluster", "confidence", F.col("new_id").alias("profile_id"), F.col("new_score").alias("profile_score"),
            F.lit(False).alias("provisional"), "run", F.col("named_at").alias("seq"))
        units.unionByName(late).write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")
        batch.unpersist()

    query = identified.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def named_units(spark: SparkSession, path: str) -> DataFrame:
    """Every unit as it was last emitted."""
    return _latest(spark.read.parquet(f"{path}/rows").select(*UNIT), ["session_id", "unit_id"], UNIT).select(*UNIT[:-2])
