"""Documents and bundles."""

from pyspark.sql import functions as F

from confab.operators import export
from confab.plans.registry import query, sql
from confab.plans.sequence import cues
from confab.sources import tables


@query("export_txt", sql("ordered", """
    SELECT project_id, 0 AS part, string_agg(speaker || ': ' || trim(text), chr(10)||chr(10) ORDER BY rn) AS text
    FROM ordered GROUP BY project_id"""))
def export_txt(spark, sf):
    return export.render_transcripts(tables.segments(spark, sf), "txt")


@query("export_csv", sql("ordered", """
    SELECT project_id, 0 AS part, 'start_ms,end_ms,speaker,text' || chr(13)||chr(10) || string_agg(start_ms || ',' || end_ms || ',' || speaker || ',' ||
      CASE WHEN regexp_matches(text,'[,"]') THEN '"' || replace(text,'"','""') || '"' ELSE text END, chr(13)||chr(10) ORDER BY rn)
      || chr(13)||chr(10) AS text FROM ordered GROUP BY project_id"""))
def export_csv(spark, sf):
    return export.render_transcripts(tables.segments(spark, sf), "csv")


@query("export_json", sql("ordered", """
    SELECT project_id, 0 AS part, CAST(to_json(struct_pack(version := 1, project := struct_pack(id := project_id, segments := list(
      struct_pack(segment_id := segment_id, start_ms := start_ms, end_ms := end_ms, speaker := speaker, text := text) ORDER BY rn)))) AS VARCHAR) AS text
    FROM ordered GROUP BY project_id"""))
def export_json(spark, sf):
    s = tables.segments(spark, sf).select("project_id", "segment_id", "start_ms", "end_ms", "speaker", "text", "segment_order")
    out = export.render_transcripts(s, "json")
    return out.withColumn("text", F.regexp_replace("text", r',"segment_order":\d+', ""))


def subtitles(head: str, line: str, mark: str) -> str:
    """Numbered cue texts of a recording, joined by blank lines."""
    clock = "printf('%02d:%02d:%02d{m}%03d', {c}//3600000, {c}%3600000//60000, {c}%60000//1000, {c}%1000)"
    times = f"{clock.format(m=mark, c='start_ms')} || ' --> ' || {clock.format(m=mark, c='end_ms')} || chr(10)"
    return sql("segments", cues(42) + f""",
  numbered AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY start_ms, segment_order, n) AS rn, {times} AS times FROM cues)
  SELECT project_id, 0 AS part, {head} string_agg({line}, chr(10)||chr(10) ORDER BY rn) || chr(10) AS text FROM numbered GROUP BY project_id""")


@query("export_srt", subtitles("", "rn || chr(10) || times || '[' || speaker || '] ' || trim(text)", ","))
def export_srt(spark, sf):
    return export.render_transcripts(tables.segments(spark, sf), "srt")


@query("export_vtt", subtitles("'WEBVTT' || chr(10)||chr(10) ||", "times || trim(text)", "."))
def export_vtt(spark, sf):
    return export.render_transcripts(tables.segments(spark, sf), "vtt")


def media(spark, sf):
    name = F.concat(F.lit("d"), "doc_id", F.lit(".wav"))
    files = tables.read(spark, sf, "documents").select("doc_id", name.alias("name"), F.concat(F.lit("m/"), name).alias("path"), F.encode("text", "UTF-8").alias("content"))
    return files.select("doc_id", "name", "path", F.sha2("content", 256).alias("sha256"))


def bundled(spark, sf):
    """One project per document; its media file holds the document's bytes, for some it is missing."""
    p = tables.read(spark, sf, "documents").select(F.col("doc_id").alias("project_id"), F.concat(
        F.lit("m/"), F.when(F.col("lang") == "fr", "gone").otherwise("d"), "doc_id", F.lit(".wav")).alias("media_path"))
    return export.bundle_manifest(p, media(spark, sf).select("path", "sha256"))


@query("bundle_manifest", """
    SELECT doc_id AS project_id, 1 AS version, lang<>'fr' AS media_included, CASE WHEN lang<>'fr' THEN 'd' || doc_id || '.wav' END AS media_name,
      CASE WHEN lang<>'fr' THEN sha256(text) END AS media_sha256 FROM documents""")
def bundle_manifest(spark, sf):
    return bundled(spark, sf)


@query("verify_bundle", """
    SELECT doc_id AS portable_source_id, CASE WHEN lang<>'fr' THEN 'd' || doc_id || '.wav' END AS media_name,
      CASE WHEN doc_id%9=1 THEN 'newer_version' WHEN lang='fr' THEN 'ok' WHEN doc_id%9=2 THEN 'media_missing'
           WHEN doc_id%9=3 THEN 'hash_mismatch' ELSE 'ok' END AS status FROM documents""")
def verify_bundle(spark, sf):
    m, d = bundled(spark, sf), F.col("doc_id")
    m = m.withColumn("version", F.when(F.col("project_id") % 9 == 1, 2).otherwise(F.col("version")))
    received = media(spark, sf).select(
        d.alias("project_id"), F.when(d % 9 == 2, "lost").otherwise(F.col("name")).alias("name"),
        F.when(d % 9 == 3, F.sha2(F.lit("x"), 256)).otherwise(F.col("sha256")).alias("sha256"))
    return export.verify_bundle(m, received)
