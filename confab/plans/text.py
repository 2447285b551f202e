"""Text cleaning and review filters."""

from pyspark.sql import functions as F

from confab.functions import review, text
from confab.plans.registry import query, sql
from confab.sources import tables

# fold + stopword filter used by the check SQL for tokens
STOP_SQL = "[" + ",".join(f"'{w}'" for w in dict.fromkeys(text.STOPWORDS)) + "]"
TOKENS_SQL = (r"list_filter(list_transform(regexp_extract_all(text,'[\p{L}\p{N}_]{3,}'), "
              "lambda w: replace(strip_accents(lower(w)),'ß','ss')), lambda w: NOT list_contains(" + STOP_SQL + ", w))")


@query("sanitize_utf8", "SELECT doc_id, text || chr(65533) || chr(65533) AS clean FROM documents")
def sanitize(spark, sf):
    d = tables.read(spark, sf, "documents")
    raw = F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("FF80")))
    return d.select("doc_id", text.sanitize_utf8(raw).alias("clean"))


@query("repair_mojibake", sql("segments", """
    SELECT segment_id, text AS once, text AS twice, text AS clean FROM segments"""))
def mojibake(spark, sf):
    """Damage every text by one and two wrong decodings; the repair must give it back."""
    s = tables.segments(spark, sf)
    wrong = lambda c: F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")
    s = s.select("segment_id", wrong(F.col("text")).alias("once"), wrong(wrong(F.col("text"))).alias("twice"),
                 F.col("text").alias("clean"))
    return text.repair_mojibake(s, ["once", "twice", "clean"])


@query("text_change_report", """
    SELECT lang, count(*) AS texts,
           count(*) FILTER (WHERE position(chr(65533) IN text)>0 OR regexp_matches(text,'Ã|Â|â€|ðŸ|ƒ')) AS marked,
           count(*) FILTER (WHERE regexp_matches(text,'[ \\t]{2,}|\\t|\\n{3,}|^\\s|\\s$')) AS blanks
    FROM documents GROUP BY lang""".replace("\\\\", "\\"))
def change_report(spark, sf):
    d = tables.read(spark, sf, "documents")
    return d.groupBy("lang").agg(
        F.count(F.lit(1)).alias("texts"), F.count_if(text.mojibake_score(F.col("text")) > 0).alias("marked"),
        F.count_if(F.col("text").rlike(r"[ \t]{2,}|\t|\n{3,}|^\s|\s$")).alias("blanks"))


@query("topic_tokens", sql("segments", f"""
    SELECT project_id, segment_id, array_to_string({TOKENS_SQL},' ') AS tokens FROM segments"""))
def topic_tokens(spark, sf):
    s = tables.segments(spark, sf)
    return s.select("project_id", "segment_id", F.array_join(text.all_tokens(F.col("text")), " ").alias("tokens"))


@query("clock_columns", sql("segments", r"""
    SELECT segment_id,
      printf('%02d:%02d:%02d,%03d', start_ms//3600000, start_ms%3600000//60000, start_ms%60000//1000, start_ms%1000) AS srt,
      printf('%02d:%02d', start_ms//60000, start_ms%60000//1000) AS minutes,
      printf('%02d:%02d:%02d', start_ms*40//3600000, start_ms*40%3600000//60000, start_ms*40%60000//1000) AS long_clock,
      '00:00:00.000' AS clamped
    FROM segments""".replace("AS long_clock", "AS long_full")
    .replace("SELECT segment_id,", "SELECT * EXCLUDE (long_full, s40), CASE WHEN s40 >= 3600000 THEN long_full "
             "ELSE right(long_full,5) END AS short FROM (SELECT segment_id, start_ms*40 AS s40,") + ")"))
def clocks(spark, sf):
    s = tables.segments(spark, sf)
    ms = F.col("start_ms")
    return s.select("segment_id", text.subtitle_time(ms, ",").alias("srt"), text.minute_clock(ms).alias("minutes"),
                    text.short_clock(ms * 40).alias("short"), text.subtitle_time(-ms - 1, ".").alias("clamped"))


@query("clean_and_shorten", r"""
    WITH t AS (SELECT doc_id, trim(regexp_replace(text,'\s+',' ','g')) AS v,
                      regexp_replace(regexp_replace(text,'[ \t]+',' ','g'),'^\s+|\s+$','','g') AS c FROM documents),
    h AS (SELECT *, left(v,189) AS hd FROM t)
    SELECT doc_id,
      CASE WHEN length(v)<=190 THEN v ELSE left(v, greatest(40,
        CASE WHEN position(' ' IN reverse(hd))>0 THEN length(hd)-position(' ' IN reverse(hd)) ELSE -1 END)) || '…' END AS short,
      regexp_replace(left(regexp_replace(c,'\n{3,}',chr(10)||chr(10),'g'),440),'\s+$','') AS clean
    FROM h""")
def clean_shorten(spark, sf):
    d = tables.read(spark, sf, "documents")
    return d.select("doc_id", text.shorten(F.col("text"), 190).alias("short"),
                    text.clean_text(F.col("text"), 440).alias("clean"))


@query("replace_all", sql("segments", r"""
    SELECT segment_id, regexp_replace(text,'tion','T.ON','gi') AS text,
           len(regexp_extract_all(text,'(?i)tion')) AS replacements
    FROM segments WHERE regexp_matches(text,'(?i)tion')"""))
def replace_all(spark, sf):
    from confab.operators.catalog import replace_all as op

    return op(tables.segments(spark, sf), "tion", "T.ON").drop("project_id")


@query("insights_after_replace", sql("projects", """
    SELECT p.project_id FROM projects p
    WHERE NOT EXISTS (SELECT 1 FROM segments s WHERE s.project_id=p.project_id AND regexp_matches(s.text,'(?i)thatis'))"""))
def insights_after_replace(spark, sf):
    from confab.operators.catalog import drop_stale_insights, replace_all as op

    segs = tables.segments(spark, sf)
    insights = tables.projects(spark, sf, segs).select("project_id")
    return drop_stale_insights(insights, op(segs, "thatis", "that is"))


DONE = "IN ('accepted','corrected','ignored')"
TEXT_REVIEW = (f"(NOT coalesce(review_state {DONE},false) AND (coalesce(review_state='pending',false) "
               "OR coalesce(confidence<0.84,false)))")
VOICE_REVIEW = (f"(NOT coalesce(speaker_review_state {DONE},false) AND (coalesce(speaker_confidence<0.72,false) "
                "OR coalesce(speaker_match_confidence<0.72,false)))")


@query("review_flags", sql("segments", f"""
    SELECT segment_id, {TEXT_REVIEW} AS text_review, {VOICE_REVIEW} AS voice_review,
           {TEXT_REVIEW} OR {VOICE_REVIEW} AS any_review,
           CASE WHEN confidence<0.70 THEN 'critical' WHEN confidence<0.84 THEN 'warning' ELSE 'good' END AS tone
    FROM segments"""))
def review_flags(spark, sf):
    return tables.segments(spark, sf).select(
        "segment_id", review.needs_text_review().alias("text_review"),
        review.needs_speaker_review().alias("voice_review"), review.needs_review().alias("any_review"),
        review.confidence_tone(F.col("confidence")).alias("tone"))


@query("filter_segments", sql("segments", f"""
    SELECT segment_id, text FROM segments WHERE contains(lower(text), 'éa') AND ({TEXT_REVIEW} OR {VOICE_REVIEW})"""))
def filter_segments(spark, sf):
    return review.filter_segments(tables.segments(spark, sf), "ÉA", True).select("segment_id", "text")


@query("suspicious_text", sql("segments", """
    SELECT segment_id FROM segments WHERE regexp_matches(text,'[ÃÂ]') OR confidence<0.84"""))
def suspicious(spark, sf):
    return tables.segments(spark, sf).where(review.text_is_suspicious()).select("segment_id")
