"""Extractive analysis."""

from pyspark.sql import functions as F

from confab.operators import insights
from confab.plans.registry import CTES, query, sql
from confab.plans.text import TOKENS_SQL
from confab.sources import tables

CTES["tokens"] = (("segments",), f"""
    SELECT project_id, segment_id, segment_order, start_ms, i AS pos, l[i] AS token FROM (
      SELECT *, unnest(range(1,len(l)+1)) AS i FROM (
        SELECT project_id, segment_id, segment_order, start_ms, {TOKENS_SQL} AS l FROM segments))""")
CTES["concepts"] = (("tokens",), """
    SELECT project_id, token, weight, rank FROM (SELECT *, row_number() OVER (PARTITION BY project_id
        ORDER BY weight DESC, seen) AS rank FROM (
      SELECT project_id, token, count(*) AS weight, min(segment_order*100000+pos) AS seen FROM tokens GROUP BY 1,2))
    WHERE rank<=12""")
CTES["scores"] = (("tokens",), """
    SELECT s.project_id, s.segment_id, s.segment_order,
           round(coalesce(x.w/sqrt(x.len),0) * CASE WHEN contains(text,'?') THEN 1.08 ELSE 1 END, 6) AS score
    FROM segments s LEFT JOIN (
      SELECT e.project_id, e.segment_order, sum(c) AS len,
             sum((1+ln(1+gf))*ln((n+1)/(df+0.5))) AS w
      FROM (SELECT project_id, segment_order, token, count(*) AS c FROM tokens GROUP BY ALL) e
      JOIN (SELECT project_id, token, count(*) AS gf, count(DISTINCT segment_order) AS df FROM tokens GROUP BY ALL) g
        USING (project_id, token)
      JOIN (SELECT project_id, count(*) AS n FROM segments GROUP BY 1) USING (project_id)
      GROUP BY e.project_id, e.segment_order) x USING (project_id, segment_order)""")
CAP = "upper(left(token,1)) || substr(token,2)"
#: The greedy choice as a walk down each project's ranking, one segment a step.
PICKS = """WITH RECURSIVE ranked AS (
      SELECT c.project_id, c.segment_order, c.score, coalesce(l, []) AS l,
             row_number() OVER (PARTITION BY c.project_id ORDER BY c.score DESC, c.segment_order DESC) AS r
      FROM scores c LEFT JOIN (SELECT project_id, segment_order, list(DISTINCT token) AS l FROM tokens GROUP BY ALL) USING (project_id, segment_order)),
    walk AS (
      SELECT project_id, CAST(0 AS BIGINT) AS r, CAST([] AS VARCHAR[][]) AS taken, CAST([] AS BIGINT[]) AS orders FROM ranked WHERE r=1
      UNION ALL
      SELECT project_id, r, CASE WHEN fits THEN list_append(taken, l) ELSE taken END,
             CASE WHEN fits THEN list_append(orders, segment_order) ELSE orders END
      FROM (SELECT w.project_id, k.r, taken, orders, l, segment_order, len(list_filter(taken, lambda c:
                len(list_intersect(c, l)) / greatest(1, len(list_distinct(list_concat(c, l)))) > 0.62))=0 AS fits
            FROM walk w JOIN ranked k ON k.project_id=w.project_id AND k.r=w.r+1 WHERE len(taken)<8)),
    picks AS (
      SELECT project_id, unnest(range(len(orders))) AS pick, unnest(orders) AS segment_order
      FROM (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY r DESC)=1)),
"""


def short_sql(limit: int) -> str:
    """A CTE ``short`` (project_id, segment_order, short) of the picked segments' shortened texts."""
    return rf"""short AS (
      SELECT project_id, segment_order, CASE WHEN length(v)<={limit} THEN v ELSE left(v, greatest(40, CASE WHEN position(' ' IN reverse(hd))>0
        THEN length(hd)-position(' ' IN reverse(hd)) ELSE -1 END)) || '…' END AS short
      FROM (SELECT *, left(v,{limit - 1}) AS hd FROM (
        SELECT project_id, segment_order, trim(regexp_replace(text,'\s+',' ','g')) AS v FROM segments JOIN picks USING (project_id, segment_order))))
"""


@query("transcript_stats", sql("projects", r"""
    SELECT project_id, CAST(sum(len(regexp_extract_all(text,'\S+'))) AS BIGINT) AS words, count(*) AS paragraphs,
           CAST(sum(len(regexp_extract_all(text,'\?'))) AS BIGINT) AS questions,
           CAST(round_even(sum(len(regexp_extract_all(text,'\S+')))/greatest(max(duration_ms)/60000.0,0.1),0) AS BIGINT)
             AS words_per_minute
    FROM segments JOIN projects USING (project_id) GROUP BY project_id"""))
def transcript_stats(spark, sf):
    s = tables.staged(spark, sf)
    return insights.transcript_stats(s, tables.projects(spark, sf, s))


@query("lexical_signals", sql("tokens", """
    SELECT project_id, 0 AS questions, count(*) FILTER (WHERE token IN ('that','avec','con')) AS agreements,
           count(*) FILTER (WHERE token IN ('der','des')) AS affection, count(*) FILTER (WHERE token IN ('tion','and')) AS tension
    FROM (SELECT project_id, token FROM tokens UNION ALL SELECT DISTINCT project_id, '' FROM segments) GROUP BY project_id"""))
def lexical_signals(spark, sf):
    """Word lists that occur in the given texts; the built-in lists are the default."""
    return insights.lexical_signals(tables.segments(spark, sf), {
        "agreements": ["that", "avec", "con"], "affection": ["der", "dés"], "tension": ["tion", "And"]})


@query("top_concepts", sql("concepts", f"SELECT project_id, rank, token, {CAP} AS label, weight FROM concepts"))
def top_concepts(spark, sf):
    return insights.top_concepts(insights.token_rows(tables.segments(spark, sf)))


@query("concept_edges", sql("concepts", """
    WITH d AS (SELECT DISTINCT t.project_id, t.segment_order, t.token FROM tokens t JOIN concepts c USING (project_id, token)),
    e AS (SELECT a.project_id, a.token AS source, b.token AS target, count(*) AS weight, min(a.segment_order) AS seen
          FROM d a JOIN d b ON a.project_id=b.project_id AND a.segment_order=b.segment_order AND a.token<b.token GROUP BY ALL)
    SELECT project_id, source, target, weight, rank FROM (SELECT *, row_number() OVER (PARTITION BY project_id
      ORDER BY weight DESC, seen, source, target) AS rank FROM e) WHERE rank<=18"""))
def concept_edges(spark, sf):
    s = tables.staged(spark, sf)
    return insights.concept_edges(s, insights.top_concepts(insights.token_rows(s)))


@query("chapters", sql("tokens projects", f"""
    WITH z AS (SELECT project_id, greatest(180000, least(600000, CAST(ceil(duration_ms/8) AS BIGINT))) AS size FROM projects),
    b AS (SELECT s.*, s.start_ms//size AS bucket FROM segments s JOIN z USING (project_id)),
    sp AS (SELECT project_id, bucket, arg_min(start_ms, segment_order) AS start_ms, arg_max(end_ms, segment_order) AS end_ms
           FROM b GROUP BY ALL),
    h AS (SELECT project_id, bucket, string_agg(text,' ' ORDER BY segment_order) AS head FROM (
            SELECT *, row_number() OVER (PARTITION BY project_id, bucket ORDER BY segment_order) AS n FROM b) WHERE n<=2 GROUP BY ALL),
    w AS (SELECT t.project_id, t.start_ms//size AS bucket, token, count(*) AS n, min(segment_order*100000+pos) AS seen
          FROM tokens t JOIN z USING (project_id) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY project_id, bucket ORDER BY n DESC, seen) AS r FROM w),
    ti AS (SELECT project_id, bucket, string_agg({CAP}, ' · ' ORDER BY r) AS title FROM r WHERE r<=3 GROUP BY ALL),
    hd AS (SELECT *, left(head,189) AS hd FROM h)
    SELECT project_id, bucket, coalesce(title, 'Parte ' || (bucket+1)) AS title, start_ms, end_ms,
      CASE WHEN length(head)<=190 THEN head ELSE left(head, greatest(40, CASE WHEN position(' ' IN reverse(hd))>0
        THEN length(hd)-position(' ' IN reverse(hd)) ELSE -1 END)) || '…' END AS description
    FROM sp JOIN hd USING (project_id, bucket) LEFT JOIN ti USING (project_id, bucket)"""))
def chapters(spark, sf):
    s = tables.staged(spark, sf)
    return insights.chapters(s, tables.projects(spark, sf, s))


@query("segment_scores", sql("scores", "SELECT project_id, segment_id, score FROM scores"))
def segment_scores(spark, sf):
    return insights.segment_scores(tables.staged(spark, sf)).select("project_id", "segment_id", "score")


@query("key_points", sql("scores", PICKS + short_sql(260) + f"""
    SELECT p.project_id, pick, s.segment_id, s.start_ms, s.end_ms, score,
           coalesce(title, 'Punto en ' || CAST(round_even(s.start_ms/60000.0,0) AS BIGINT) || ' min') AS title, short AS text
    FROM picks p JOIN scores USING (project_id, segment_order) JOIN segments s USING (project_id, segment_order)
    JOIN short USING (project_id, segment_order) LEFT JOIN (
      SELECT project_id, segment_order, string_agg({CAP}, ' · ' ORDER BY n DESC, seen) AS title FROM (
        SELECT project_id, segment_order, token, count(*) AS n, min(pos) AS seen FROM tokens GROUP BY project_id, segment_order, token
        QUALIFY row_number() OVER (PARTITION BY project_id, segment_order ORDER BY count(*) DESC, min(pos))<=3)
      GROUP BY ALL) USING (project_id, segment_order)"""))
def key_points(spark, sf):
    s = tables.staged(spark, sf)
    return insights.key_points(s, insights.pick_key_points(insights.segment_scores(s)))


@query("best_point", sql("scores", """
    SELECT project_id, segment_order, score FROM scores
    QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY score DESC, segment_order DESC)=1"""))
def best_point(spark, sf):
    """The first greedy pick, which plain SQL can express."""
    picks = insights.pick_key_points(insights.segment_scores(tables.staged(spark, sf)), 1)
    return picks.select("project_id", "segment_order", "score")


@query("extractive_summary", sql("scores", PICKS + short_sql(220) + """
    SELECT project_id, string_agg(short, ' ' ORDER BY segment_order) AS summary
    FROM picks JOIN short USING (project_id, segment_order) WHERE pick<5 GROUP BY project_id"""))
def extractive_summary(spark, sf):
    s = tables.staged(spark, sf)
    return insights.extractive_summary(s, insights.pick_key_points(insights.segment_scores(s)))


@query("audio_quality", """
    WITH f AS (SELECT user_id AS recording_id, value/500 AS rms, CASE WHEN value>250 THEN 2 ELSE 0 END AS clipped, 320 AS n FROM events),
    l AS (SELECT recording_id, quantile_cont(rms,0.18) AS noise, quantile_cont(rms,0.82) AS speech,
                 sum(clipped) AS clipped, sum(n) AS n FROM f GROUP BY 1),
    q AS (SELECT recording_id, avg((rms<greatest(0.0025,noise*1.25))::INT) AS silent FROM f JOIN l USING (recording_id) GROUP BY 1),
    d AS (SELECT *, 20*log10(greatest(noise,1e-6)) AS nd, 20*log10(greatest(speech,1e-6)) AS sd FROM l JOIN q USING (recording_id))
    SELECT recording_id, round(nd,1) AS noise_floor_db, round(sd,1) AS speech_level_db,
           round(clipped/n*100,3) AS clipping_percent, round(silent*100,1) AS silence_percent,
           CASE WHEN sd-nd<8 THEN 'strong' WHEN sd-nd<17 THEN 'speech' ELSE 'off' END AS recommended FROM d""")
def audio_quality(spark, sf):
    e = tables.read(spark, sf, "events").select(
        F.col("user_id").alias("recording_id"), (F.col("value") / 500).alias("rms"),
        F.when(F.col("value") > 250, 2).otherwise(0).alias("clipped"), F.lit(320).alias("n"))
    return insights.audio_quality(e)


@query("segment_confidence", sql("words", """
    WITH a AS (SELECT project_id, segment_id, avg(probability) AS p,
                      CASE segment_id%5 WHEN 0 THEN NULL WHEN 1 THEN 0.0 ELSE -(segment_id%7)/10.0 END AS lp
               FROM words GROUP BY 1,2)
    SELECT project_id, segment_id, round(p*0.75+0.25*exp(least(0.0,coalesce(nullif(CAST(lp AS DOUBLE),0.0),-2.0))),4) AS confidence
    FROM a"""))
def segment_confidence(spark, sf):
    w = tables.words(spark, sf)
    s = F.col("segment_id")
    acoustic = w.select("project_id", "segment_id").distinct().withColumn(
        "avg_logprob", F.when(s % 5 == 0, None).when(s % 5 == 1, F.lit(0.0)).otherwise(-(s % 7) / F.lit(10.0)))
    return insights.segment_confidence(w, acoustic)
