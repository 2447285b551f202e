"""Closing of live sessions: when event time has passed a session, its paragraphs are built and named by the voices' votes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from confab.operators.matching import cluster_identity_vote
from confab.operators.sequence import group_paragraphs
from confab.operators.voice_memory import bounded_evidence

MAX_MS, MAX_CHARS = 35_000, 520  # limits of the paragraphs of a live session
COLUMNS = ["session_id", "order", "segment_id", "start_ms", "end_ms", "text", "speaker_cluster", "profile_id", "profile_score"]


def closing_report(closed: DataFrame, segments: DataFrame, evidence: DataFrame, hints: DataFrame | None = None) -> DataFrame:
    """Paragraphs of the ``closed`` sessions, each with the profile its voice cluster was voted (NULL without a clear winner).

    ``segments``: session_id and the columns of segments with speaker_cluster; ``evidence``: the voice samples of the clusters,
    thinned to a bounded number each before they vote; ``hints``: (session_id, cluster, profile_id) as last seen live.
    """
    ids = closed.select("session_id").distinct()
    mine = segments.join(ids, "session_id", "left_semi").withColumnRenamed("session_id", "project_id")
    votes = cluster_identity_vote(bounded_evidence(evidence.join(ids, "session_id", "left_semi")), hints)
    named = votes.select("session_id", F.col("cluster").alias("speaker_cluster"), "profile_id", F.col("score").alias("profile_score"))
    paragraphs = group_paragraphs(mine, MAX_MS, MAX_CHARS).withColumnRenamed("project_id", "session_id").drop("speaker_profile_id")
    return paragraphs.join(named, ["session_id", "speaker_cluster"], "left").select(*COLUMNS)


def write_closings(closed: DataFrame, segments: DataFrame, evidence: DataFrame, path: str, checkpoint: str, hints: DataFrame | None = None) -> StreamingQuery:
    """Run a stream of closed sessions into ``path``: each batch writes the reports of its sessions to a folder of its own.

    ``segments`` and ``evidence`` are tables that hold what the sessions left until they closed.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        report = closing_report(batch.select("session_id"), segments, evidence, hints)
        report.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    query = closed.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def closings(spark: SparkSession, path: str) -> DataFrame:
    """All reports written so far."""
    return spark.read.parquet(path).select(*COLUMNS)
