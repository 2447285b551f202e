"""Transcripts as text documents and portable bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from confab.functions.text import subtitle_time
from confab.operators.blocks import Scan, numbered, running, time_block
from confab.operators.sequence import subtitle_cues

PART_SIZE = 5_000
BUNDLE_VERSION = 1
FORMATS = ("txt", "csv", "json", "srt", "vtt")


def _csv(c: Column) -> Column:
    s = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(s.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def _documents(lines: DataFrame, separator: str) -> DataFrame:
    """Join numbered lines (project_id, rn, line) into parts of at most PART_SIZE lines; later parts begin with the separator."""
    parts = lines.groupBy("project_id", F.floor((F.col("rn") - 1) / PART_SIZE).alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("rn", "line"))).alias("x"))
    body = F.array_join(F.transform("x", lambda i: i["line"]), separator)
    return parts.select("project_id", "part", F.concat(F.when(F.col("part") > 0, separator).otherwise(""), body).alias("text"))


def render_transcripts(segments: DataFrame, fmt: str, line: int = 42, lines: int = 2) -> DataFrame:
    """(project_id, part, text): the document is the texts of its parts one after another, almost always one.

    Long recordings are cut into parts, so a document never has to fit one task.
    """
    if fmt not in FORMATS:
        raise ValueError(f"unknown export format: {fmt}")
    order = ["start_ms", "segment_order"]
    if fmt in ("srt", "vtt"):
        return _subtitles(segments, fmt, line, lines)
    s = numbered(segments, ["project_id"], time_block(), order)
    if fmt == "txt":
        who = F.when(F.col("speaker") != "", F.concat("speaker", F.lit(": "))).otherwise("")
        return _documents(s.select("project_id", "rn", F.concat(
            F.coalesce(who, F.lit("")), F.trim("text")).alias("line")), "\n\n")
    if fmt == "csv":
        row = F.concat_ws(",", *[_csv(F.col(c)) for c in ("start_ms", "end_ms", "speaker", "text")])
        d = _documents(s.select("project_id", "rn", row.alias("line")), "\r\n")
        return _closed(d, "start_ms,end_ms,speaker,text\r\n", "\r\n", s)
    cols = [c for c in segments.columns if c not in ("project_id", "media_url")]
    d = _documents(s.select("project_id", "rn", F.to_json(F.struct(*cols)).alias("line")), ",")
    head = F.concat(F.lit('{"version":1,"project":'), F.regexp_replace(F.to_json(F.struct(F.col("project_id").alias("id"))), r"\}$", ""), F.lit(',"segments":['))
    return _closed(d, head, "]}}", s)


def _closed(parts: DataFrame, head: Column | str, tail: str, lines: DataFrame) -> DataFrame:
    """The first part begins with ``head``, the last one ends with ``tail``."""
    n = lines.groupBy("project_id").agg(F.floor((F.max("rn") - 1) / PART_SIZE).alias("last"))
    head = F.lit(head) if isinstance(head, str) else head
    return parts.join(n, "project_id").select("project_id", "part", F.concat(
        F.when(F.col("part") == 0, head).otherwise(""), "text", F.when(F.col("part") == F.col("last"), tail).otherwise("")).alias("text"))


def _subtitles(segments: DataFrame, fmt: str, line: int, lines: int) -> DataFrame:
    cues = subtitle_cues(segments, line, lines)
    cues = running(cues, ["project_id"], time_block(), ["start_ms", "segment_order", "n"],
                   [Scan("rn", F.lit(1).cast("long"), "sum")])
    start = F.greatest(F.lit(0), "start_ms")
    end = F.greatest(start + 1, "end_ms")
    mark = "," if fmt == "srt" else "."
    times = F.concat(subtitle_time(start, mark), F.lit(" --> "), subtitle_time(end, mark), F.lit("\n"))
    who = F.when(F.col("speaker") != "", F.concat(F.lit("["), "speaker", F.lit("] "))).otherwise("")
    block = F.concat(F.col("rn").cast("string"), F.lit("\n"), times, F.coalesce(who, F.lit("")), F.trim("text")) \
        if fmt == "srt" else F.concat(times, F.trim("text"))
    d = _documents(cues.select("project_id", "rn", block.alias("line")), "\n\n")
    return _closed(d, "" if fmt == "srt" else "WEBVTT\n\n", "\n", cues)


def write_transcripts(rendered: DataFrame, path: str, fmt: str = "json", buckets: int = 64) -> None:
    """One row per document part, spread over hash buckets of the project; ``fmt`` is json, csv or text (the parts' text only)."""
    rows = rendered.withColumn("bucket", F.pmod(F.hash("project_id"), F.lit(buckets)))
    if fmt == "text":
        rows = rows.repartition("bucket").sortWithinPartitions("bucket", "project_id", "part").select("bucket", "text")
    rows.write.format(fmt).mode("overwrite").partitionBy("bucket").save(path)


def media_hashes(media: DataFrame) -> DataFrame:
    """path and sha256 of media rows (path, content). For ingest: a row's content must fit a task (below 2 GiB)."""
    return media.select("path", F.sha2("content", 256).alias("sha256"))


def _base(path: Column) -> Column:
    return F.element_at(F.split(path, r"[\\/]"), -1)


def bundle_manifest(projects: DataFrame, media: DataFrame) -> DataFrame:
    """Manifest rows: ``projects`` name their media by full path, ``media`` has path and sha256 as stored at ingest."""
    hashes = media.select(F.col("path").alias("media_path"), F.col("sha256").alias("media_sha256"), F.lit(True).alias("found")).dropDuplicates(["media_path"])
    j = projects.select("project_id", "media_path").join(hashes, "media_path", "left")
    return j.select("project_id", F.lit(BUNDLE_VERSION).alias("version"), F.coalesce("found", F.lit(False)).alias("media_included"),
                    F.when(F.col("found"), _base(F.col("media_path"))).alias("media_name"), "media_sha256")


def verify_bundle(manifest: DataFrame, received: DataFrame) -> DataFrame:
    """Check received media (project_id, name, sha256) against the manifest."""
    got = received.select("project_id", F.col("name").alias("media_name"), F.col("sha256").alias("sha"))
    j = manifest.join(got, ["project_id", "media_name"], "left")
    status = (F.when(F.col("version") > BUNDLE_VERSION, "newer_version")
              .when(F.col("media_included") & F.col("sha").isNull(), "media_missing")
              .when(F.col("media_included") & (F.col("sha") != F.col("media_sha256")), "hash_mismatch").otherwise("ok"))
    return j.select(F.col("project_id").alias("portable_source_id"), "media_name", status.alias("status"))


def import_names(projects: DataFrame, verified: DataFrame) -> DataFrame:
    ok = verified.where(F.col("status") == "ok").select(F.col("portable_source_id").alias("project_id"))
    return projects.join(ok, "project_id").select(
        F.uuid().alias("id"), F.concat("name", F.lit(" · importado")).alias("name"),
        F.col("project_id").alias("portable_source_id"))
