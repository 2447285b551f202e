"""Joins on recording time and cut plans."""

from pyspark.sql import functions as F

from confab.operators import temporal
from confab.plans.registry import CTES, query, sql
from confab.plans.text import TEXT_REVIEW
from confab.functions import review
from confab.sources import tables

CTES["units"] = (("words",), """
    SELECT project_id, turn*1000+pos//11 AS unit_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms,
           'Hablante ' || ((turn+pos//11)%3+1) AS speaker, CAST((60+(project_id*3+turn*7+pos//11*5)%40)/100.0 AS DOUBLE)
             AS speaker_confidence, CASE WHEN (turn+pos//11)%3=0 THEN project_id%10 END AS speaker_profile_id,
           CASE WHEN (turn+pos//11)%3=0 THEN CAST(0.8 AS DOUBLE) END AS speaker_match_confidence, (turn+pos//11)%3 AS cluster
    FROM words GROUP BY project_id, turn, pos//11""")


def units(spark, sf):
    """Voice units cut differently from the segments: eleven words each."""
    u = F.floor(F.col("pos") / 11)
    w = tables.words(spark, sf).groupBy("project_id", "turn", u.alias("u")).agg(
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    c = (F.col("turn") + F.col("u")) % 3
    return w.select(
        "project_id", (F.col("turn") * 1000 + F.col("u")).alias("unit_id"), "start_ms", "end_ms",
        F.concat(F.lit("Hablante "), (c + 1)).alias("speaker"),
        ((60 + (F.col("project_id") * 3 + F.col("turn") * 7 + F.col("u") * 5) % 40) / F.lit(100.0))
        .alias("speaker_confidence"),
        F.when(c == 0, F.col("project_id") % 10).alias("speaker_profile_id"),
        F.when(c == 0, F.lit(0.8).cast("double")).alias("speaker_match_confidence"), c.alias("cluster"))


@query("transfer_speakers", sql("segments units", """
    WITH o AS (SELECT s.project_id, s.segment_id, u.speaker, u.speaker_profile_id, u.cluster, u.speaker_confidence,
                      u.speaker_match_confidence, u.unit_id, u.start_ms AS us,
                      least(s.end_ms,u.end_ms)-greatest(s.start_ms,u.start_ms) AS ov
               FROM segments s JOIN units u ON u.project_id=s.project_id AND u.start_ms<s.end_ms AND u.end_ms>s.start_ms),
    g AS (SELECT project_id, segment_id, speaker, speaker_profile_id, cluster, sum(ov) AS total,
                 round(sum(ov*speaker_confidence),6) AS w, max(struct_pack(a := -us, b := -unit_id)) AS f
          FROM o GROUP BY ALL),
    b AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY project_id, segment_id ORDER BY total DESC, w DESC, f DESC)=1),
    u1 AS (SELECT o.* FROM o JOIN b ON o.project_id=b.project_id AND o.segment_id=b.segment_id AND o.speaker=b.speaker
             AND o.speaker_profile_id IS NOT DISTINCT FROM b.speaker_profile_id AND o.cluster=b.cluster
           QUALIFY row_number() OVER (PARTITION BY o.project_id, o.segment_id ORDER BY ov DESC, us, unit_id)=1)
    SELECT s.project_id, s.segment_id, s.text, u1.speaker, u1.speaker_profile_id, u1.cluster,
           u1.speaker_confidence, u1.speaker_match_confidence,
           CASE WHEN s.speaker IS NOT DISTINCT FROM u1.speaker AND s.speaker_profile_id IS NOT DISTINCT FROM u1.speaker_profile_id
             AND s.speaker_confidence IS NOT DISTINCT FROM u1.speaker_confidence
             AND s.speaker_match_confidence IS NOT DISTINCT FROM u1.speaker_match_confidence
             THEN s.speaker_review_state END AS speaker_review_state
    FROM segments s JOIN u1 USING (project_id, segment_id)"""))
def transfer_speakers(spark, sf):
    out = temporal.transfer_speakers(tables.segments(spark, sf), units(spark, sf))
    return out.select("project_id", "segment_id", "text", "speaker", "speaker_profile_id", "cluster",
                      "speaker_confidence", "speaker_match_confidence", "speaker_review_state")


@query("locate_positions", sql("markers", """
    SELECT m.project_id, m.marker_id, m.time_ms,
      (SELECT max(segment_id) FROM segments s WHERE s.project_id=m.project_id AND s.start_ms<=m.time_ms AND m.time_ms<s.end_ms) AS active,
      coalesce((SELECT max(segment_id) FROM segments s WHERE s.project_id=m.project_id AND s.start_ms<=m.time_ms AND m.time_ms<s.end_ms),
               (SELECT arg_min(segment_id, start_ms) FROM segments s WHERE s.project_id=m.project_id AND s.start_ms>m.time_ms),
               (SELECT arg_max(segment_id, start_ms) FROM segments s WHERE s.project_id=m.project_id)) AS follow,
      (SELECT arg_min(segment_id, struct_pack(d := abs(start_ms-m.time_ms), o := segment_order)) FROM segments s
        WHERE s.project_id=m.project_id) AS nearest
    FROM markers m"""))
def locate_positions(spark, sf):
    s = tables.segments(spark, sf)
    return temporal.locate_positions(tables.markers(spark, sf, s), s)


CUTS = f"""WITH x AS (SELECT project_id, greatest(0,start_ms-150) AS start_ms, least(duration_ms,end_ms+150) AS end_ms
    FROM segments JOIN projects USING (project_id) WHERE {TEXT_REVIEW}),
  o AS (SELECT *, CASE WHEN start_ms <= max(end_ms) OVER (PARTITION BY project_id ORDER BY start_ms, end_ms
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM x WHERE end_ms>start_ms),
  i AS (SELECT *, sum(n) OVER (PARTITION BY project_id ORDER BY start_ms, end_ms) AS g FROM o),
  m AS (SELECT project_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM i GROUP BY project_id, g),
  k AS (SELECT project_id, coalesce(lag(end_ms) OVER w, 0) AS start_ms, start_ms AS end_ms FROM m
          WINDOW w AS (PARTITION BY project_id ORDER BY start_ms)
        UNION ALL SELECT p.project_id, coalesce((SELECT max(end_ms) FROM m WHERE m.project_id=p.project_id),0), duration_ms
        FROM projects p),
  kept AS (SELECT * FROM k WHERE end_ms-start_ms>=40) """


def cuts(spark, sf):
    """Cut out what needs a text review, with 150 ms around it."""
    s = tables.staged(spark, sf)
    return s.where(review.needs_text_review()).select(
        "project_id", (F.col("start_ms") - 150).alias("start_ms"), (F.col("end_ms") + 150).alias("end_ms")), \
        tables.projects(spark, sf, s).select("project_id", "duration_ms")


def clipped(spark, sf):
    x, p = cuts(spark, sf)
    return x.join(p, "project_id").select("project_id", F.greatest(F.lit(0), "start_ms").alias("start_ms"),
                                          F.least("duration_ms", "end_ms").alias("end_ms")), p


@query("merge_ranges", sql("projects", CUTS + "SELECT * FROM m"))
def merge_ranges(spark, sf):
    return temporal.merge_ranges(clipped(spark, sf)[0])


@query("complement_ranges", sql("projects", CUTS + "SELECT * FROM kept"))
def complement_ranges(spark, sf):
    x, p = clipped(spark, sf)
    return temporal.complement_ranges(temporal.merge_ranges(x), p)


@query("edit_plan_report", sql("projects", CUTS + """
    SELECT p.project_id, coalesce(r.n,0) AS removed, coalesce(k.t,0) AS remaining_ms,
           CASE WHEN k.t IS NULL THEN 'nothing_left' ELSE 'ok' END AS state
    FROM projects p LEFT JOIN (SELECT project_id, count(*) AS n FROM x GROUP BY 1) r USING (project_id)
    LEFT JOIN (SELECT project_id, CAST(sum(end_ms-start_ms) AS BIGINT) AS t FROM kept GROUP BY 1) k USING (project_id)"""))
def edit_plan_report(spark, sf):
    return temporal.edit_plan_report(*cuts(spark, sf))
