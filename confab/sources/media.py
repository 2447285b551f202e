"""Media files: listing, kinds and finding moved files again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

# Recognised extensions.
AUDIO = ("mp3", "wav", "m4a", "aac", "flac", "ogg", "opus")
VIDEO = ("mp4", "mov", "mkv", "avi", "webm", "m4v")


def list_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path, length, modification time; the content column is never read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(
        root).select("path", "length", F.col("modificationTime").alias("modified_at"))


def _base(path: Column) -> Column:
    return F.element_at(F.split(path, r"[\\/]"), -1)


def media_inventory(files: DataFrame) -> DataFrame:
    ext = F.lower(F.regexp_extract("path", r"\.([^.]*)$", 1))
    kind = F.when(ext.isin(*AUDIO), "audio").when(ext.isin(*VIDEO), "video")
    name = F.regexp_replace(_base(F.col("path")), r"\.[^.]+$", "")
    return files.withColumn("kind", kind).where(F.col("kind").isNotNull()).withColumn(
        "display_name", F.when(name == "", "Proyecto sin título").otherwise(name))


def relocate_missing_media(projects: DataFrame, inventory: DataFrame, limit: int = 5) -> DataFrame:
    """Up to ``limit`` files of the same case-folded name for every project whose file is gone."""
    gone = projects.select("project_id", "media_path").join(
        inventory.select(F.col("path").alias("media_path")), "media_path", "left_anti")
    best = F.row_number().over(W.partitionBy("base").orderBy("candidate"))  # the order depends on the path alone: limit first, then join
    same = inventory.select(F.lower(_base(F.col("path"))).alias("base"), F.col("path").alias("candidate")).withColumn(
        "rank", best).where(F.col("rank") <= limit)
    return gone.withColumn("base", F.lower(_base(F.col("media_path")))).where(F.col("base") != "").join(
        same, "base").drop("base")
