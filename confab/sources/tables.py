"""Transcript tables: projects, segments, words, voice samples, profiles, job events.

The functions derive them from the given parquet tables with plain arithmetic, so that every
operator works on data that grows with its input.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, functions as F

from confab.functions.vectors import unit
from confab.operators.blocks import Scan, running
from confab.session import cut

WORD_BLOCK = 4_096  # words of one turn per block, a multiple of the 8-word fragments
PART_CHARS = 4_000_000  # text whose words one task sorts: some 100 MB as rows


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(texts: DataFrame) -> int | None:
    """How many parts the words of ``texts`` need so that no task sorts more than ``PART_CHARS``; none if one part a core is enough."""
    chars = texts.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    needed = -(-chars // PART_CHARS)
    return needed if needed > texts.sparkSession.sparkContext.defaultParallelism else None


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _timed_words(spark, sf_dir).drop("block")


def _timed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words with their block, by which they are partitioned."""
    conv = read(spark, sf_dir, "conversations")
    w = conv.select("conv_id", "turn", "role",
                    F.posexplode(F.split(F.trim("text"), r"\s+")).alias("pos", "word"))
    ends = F.col("word").rlike(r"[.!?]$")
    w = w.select(
        "conv_id", "turn", "role", "pos", "word",
        (120 + 60 * F.length("word")).cast("long").alias("dur"),
        F.when(F.col("pos") == 0, 300 * ((F.col("conv_id") * 7 + F.col("turn") * 5) % 9))
        .otherwise(0).alias("lead"),
        (80 + F.when(ends, 400 * ((F.col("conv_id") + F.col("turn") + F.col("pos")) % 6))
         .otherwise(0)).alias("tail"),
    )
    w = running(w, ["conv_id"], F.col("turn") * 1_000_000 + F.floor(F.col("pos") / WORD_BLOCK), ["turn", "pos"],
                [Scan("cum", F.col("lead") + F.col("dur") + F.col("tail"), "sum")], parts(conv), "block")
    seg_no = F.floor(F.col("pos") / 8).cast("long")
    return w.select(
        F.col("conv_id").alias("project_id"),
        (F.col("conv_id") * 100_000 + F.col("turn") * 10_000 + seg_no).alias("segment_id"),
        "turn", "pos", F.col("role").alias("speaker"), "word",
        (F.col("cum") - F.col("tail") - F.col("dur")).alias("start_ms"),
        (F.col("cum") - F.col("tail")).alias("end_ms"),
        (((60 + (F.col("conv_id") * 37 + F.col("turn") * 11 + F.col("pos") * 7) % 40)) / F.lit(100.0))
        .alias("probability"), "block",
    )


def segments(spark: SparkSession, sf_dir: str, w: DataFrame | None = None) -> DataFrame:
    """Eight-word fragments. A fragment lies in one block of words, so grouping by the block too keeps the words' partitioning."""
    w = _timed_words(spark, sf_dir) if w is None else w
    key = ["project_id", *(["block"] if "block" in w.columns else []), "segment_id", "turn", "speaker"]
    g = w.groupBy(*key).agg(
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))),
                                 lambda x: x["word"]), " ").alias("text"),
        F.round(F.avg("probability"), 4).alias("confidence"),
    )
    p, t, s = F.col("project_id"), F.col("turn"), F.col("segment_id")
    return g.select(
        "project_id", "segment_id", "turn", (s - p * 100_000).alias("segment_order"), "speaker",
        "start_ms", "end_ms", "text", "confidence",
        ((p + F.when(F.col("speaker") == "user", 1).otherwise(2)) % 10).alias("speaker_profile_id"),
        ((50 + (p * 13 + t * 29) % 50) / F.lit(100.0)).alias("speaker_match_confidence"),
        ((55 + (p * 17 + t * 23) % 45) / F.lit(100.0)).alias("speaker_confidence"),
        F.when(s % 11 == 0, "accepted").when(s % 11 == 1, "corrected").when(s % 11 == 2, "pending")
        .alias("review_state"),
        F.when(s % 7 == 0, "accepted").when(s % 7 == 1, "pending").alias("speaker_review_state"),
    )


def projects(spark: SparkSession, sf_dir: str, segs: DataFrame | None = None) -> DataFrame:
    segs = segments(spark, sf_dir) if segs is None else segs
    p = F.col("project_id")
    return segs.groupBy("project_id").agg(F.max("end_ms").alias("duration_ms")).select(
        "project_id", F.concat(F.lit("conv "), p).alias("name"), "duration_ms",
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(hours=p.cast("int")))
        .alias("updated_at"),
        F.when(p % 13 == 0, "transcribing").otherwise("completed").alias("status"),
        F.concat(F.lit("rec/"), p % 90, F.lit(".wav")).alias("media_path"),
    )


def markers(spark: SparkSession, sf_dir: str, segs: DataFrame | None = None) -> DataFrame:
    """One point per turn, shifted so that some points fall into pauses."""
    segs = segments(spark, sf_dir) if segs is None else segs
    return segs.groupBy("project_id", "turn").agg(F.min("start_ms").alias("first_ms")).select(
        "project_id", F.col("turn").alias("marker_id"),
        (F.col("first_ms") + (F.col("project_id") * 131 + F.col("turn") * 977) % 5000).alias("time_ms"),
    )


def label_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit mean vector per label of the given embeddings."""
    vec = array_to_vector(F.col("embedding").cast("array<double>"))
    return read(spark, sf_dir, "embeddings").groupBy(F.col("label").cast("long").alias("profile_id")).agg(
        Summarizer.mean(vec).alias("m")).select("profile_id", unit(vector_to_array("m")).alias("centroid"))


def voice_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voice samples around their label's centroid, from far off (vec_id % 5 = 0) to close."""
    v = F.col("vec_id")
    e = read(spark, sf_dir, "embeddings").withColumn("profile_id", F.col("label").cast("long"))
    pull = (v % 5).cast("double")
    near = F.zip_with("centroid", "embedding", lambda c, x: pull * c + x.cast("double"))
    return e.join(label_centroids(spark, sf_dir), "profile_id").select(
        v.alias("sample_id"), "profile_id", (v % 17).alias("source_project"), v.alias("source_segment"),
        (1500 * v).alias("start_ms"), (500 + (97 * v) % 9000).alias("duration_ms"),
        ((55 + (31 * v) % 45) / F.lit(100.0)).alias("confidence"), unit(near).alias("embedding"))


def voice_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One profile per label, threshold .64; one in seven is paused."""
    sizes = read(spark, sf_dir, "embeddings").groupBy(F.col("label").cast("long").alias("profile_id")).agg(
        F.count(F.lit(1)).alias("sample_count"), F.sum(500 + (97 * F.col("vec_id")) % 9000).alias("total_duration_ms"))
    return label_centroids(spark, sf_dir).join(sizes, "profile_id").select(
        "profile_id", F.concat(F.lit("Voz "), F.col("profile_id")).alias("name"), "centroid", "sample_count",
        "total_duration_ms", F.lit(0.64).cast("double").alias("match_threshold"),
        (F.col("profile_id") % 7 != 6).alias("enabled"))


def staged(spark: SparkSession, sf_dir: str, w: DataFrame | None = None) -> DataFrame:
    """The segments written once to the shared folder, for queries that read them several times."""
    return cut(segments(spark, sf_dir, w), "segments")


def staged_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(words(spark, sf_dir), "words")
