"""Notes about conversations, built from the conversations themselves as JSON, then grounded."""

from pyspark.sql import functions as F

from confab.operators import grounding as g, insights
from confab.plans.registry import CTES, query, sql
from confab.session import cut
from confab.sources import tables

CTES["notes"] = (("markers", "projects"), r"""
    SELECT c.conv_id AS project_id, c.turn, m.time_ms, p.status, lower(regexp_extract(trim(text),'^\S+')) AS word, regexp_extract(trim(text),'^\S+') AS raw
    FROM conversations c JOIN markers m ON m.project_id=c.conv_id AND m.marker_id=c.turn JOIN projects p ON p.project_id=c.conv_id""")
NEAR = """(SELECT arg_min(segment_id, struct_pack(d := abs(start_ms-({t})), o := segment_order)) FROM segments s WHERE s.project_id={a}.project_id)"""
FIRST = "(SELECT min(start_ms) FROM segments s WHERE s.project_id={a}.project_id)"


def raw(spark, sf):
    """(reports, notes, segments, projects): one JSON report and one JSON note per turn."""
    s = tables.staged(spark, sf)
    p = tables.projects(spark, sf, s)
    m = tables.markers(spark, sf, s)
    c = tables.read(spark, sf, "conversations").select(
        F.col("conv_id").alias("project_id"), "turn", F.regexp_extract(F.trim("text"), r"^\S+", 0).alias("raw"))
    c = c.join(m.withColumnRenamed("marker_id", "turn"), ["project_id", "turn"]).join(p.select("project_id", "status"), "project_id")
    t = F.col("turn")
    at = F.when(t == 3, F.lit("soon")).otherwise(F.col("time_ms").cast("string"))
    open_ = F.col("status") == "transcribing"
    item = F.struct(
        F.when(open_ | (t == 4), " ").otherwise(F.concat(F.lit("Punto  "), t)).alias("title"),
        F.concat(F.lit(" sobre "), "raw").alias("text"), at.alias("startMs"),
        F.when(t % 2 == 0, "").otherwise(F.concat(F.lit("desc "), t)).alias("description"))
    concept = F.struct(F.concat(F.lit(" "), F.when(t % 2 == 0, F.upper("raw")).otherwise(F.col("raw"))).alias("label"),
                       F.when(t == 2, "many").otherwise((t * 3 - 2).cast("string")).alias("weight"))
    rows = c.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("turn", "raw", item.alias("item"), concept.alias("concept")))).alias("x"))
    pick = lambda f: F.transform("x", lambda i: i[f])
    edges = F.transform("x", lambda i, k: F.struct(
        i["raw"].alias("source"), F.col("x")[(k + 1) % F.size("x")]["raw"].alias("target"), (k + 4).cast("string").alias("weight")))
    reports = rows.select("project_id", F.to_json(F.struct(
        pick("item").alias("keyPoints"), pick("item").alias("chapters"), pick("concept").alias("concepts"),
        edges.alias("conceptEdges"))).alias("payload"))
    event = F.struct(F.when(t == 1, "").otherwise(F.concat(F.lit("E"), t)).alias("title"),
                     F.when(t % 2 == 1, "").otherwise(F.concat(F.lit("d "), "raw")).alias("detail"), at.alias("startMs"))
    notes = c.select("project_id", t.alias("note"), F.to_json(F.struct(
        F.array(event, event, event).alias("keyEvents"), F.create_map(
            F.lit("questions"), t.cast("string"), F.lit("agreements"), (t - 3).cast("string"), F.lit("tensionMarkers"),
            F.when(t == 2, "x").otherwise("2")).alias("signals"))).alias("payload"))
    return g.parse(reports, g.REPORT_SCHEMA), g.parse(notes, g.NOTE_SCHEMA), s, p


@query("ground_points", sql("notes", f"""
    WITH a AS (SELECT *, CASE WHEN turn=3 THEN {FIRST.format(a='notes')} ELSE time_ms END AS t FROM notes),
    n AS (SELECT *, {NEAR.format(t='a.t', a='a')} AS seg FROM a),
    p AS (SELECT project_id, turn AS o, 'Punto ' || turn AS title, 'sobre ' || raw AS text, seg FROM n WHERE status<>'transcribing' AND turn<>4),
    e AS (SELECT n.project_id, n.turn*10+k AS o, CASE WHEN n.turn=1 THEN 'Punto clave' ELSE 'E' || n.turn END AS title,
            CASE WHEN n.turn%2=1 THEN s.text ELSE 'd ' || raw END AS text, seg
          FROM n JOIN segments s ON s.segment_id=seg CROSS JOIN (SELECT unnest([0,1]) AS k) WHERE n.project_id NOT IN (SELECT project_id FROM p))
    SELECT x.project_id, row_number() OVER (PARTITION BY x.project_id ORDER BY start_ms, o) AS rank, title, x.text, segment_id, start_ms, end_ms
    FROM (SELECT * FROM p UNION ALL SELECT * FROM e) x JOIN segments ON segment_id=seg"""))
def ground_points(spark, sf):
    reports, notes, s, _ = raw(spark, sf)
    return g.ground_points(reports, notes, s)


@query("ground_chapters", sql("notes", f"""
    WITH a AS (SELECT *, CASE WHEN turn=3 THEN {FIRST.format(a='notes')} ELSE time_ms END AS t FROM notes),
    n AS (SELECT *, {NEAR.format(t='a.t', a='a')} AS seg FROM a),
    c AS (SELECT n.project_id, s.start_ms, n.turn, CASE WHEN status='transcribing' OR n.turn=4 THEN 'Tramo de la conversación' ELSE 'Punto ' || n.turn END AS title,
            CASE WHEN n.turn%2=0 THEN s.text ELSE 'desc ' || n.turn END AS description FROM n JOIN segments s ON s.segment_id=seg),
    d AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY project_id, start_ms ORDER BY turn)=1)
    SELECT project_id, title, description, start_ms, greatest(start_ms, coalesce(lead(start_ms) OVER (PARTITION BY project_id ORDER BY start_ms), duration_ms)) AS end_ms
    FROM d JOIN projects USING (project_id)"""))
def ground_chapters(spark, sf):
    reports, _, s, p = raw(spark, sf)
    return g.ground_chapters(reports, s, p.select("project_id", "duration_ms"))


CONCEPTS = """WITH c AS (SELECT project_id, turn, CASE WHEN turn%2=0 THEN upper(raw) ELSE raw END AS label, lower(raw) AS folded,
      CASE WHEN turn=2 THEN 1 ELSE greatest(1,least(10,turn*3-2)) END AS weight FROM notes),
    f AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY project_id, folded ORDER BY turn)=1),
    k AS (SELECT project_id, 'concept-' || row_number() OVER (PARTITION BY project_id ORDER BY turn) AS id, folded, label, weight FROM f)"""


@query("ground_concepts", sql("notes", CONCEPTS + " SELECT project_id, id, label, weight FROM k"))
def ground_concepts(spark, sf):
    return g.ground_concepts(raw(spark, sf)[0]).drop("folded")


@query("ground_edges", sql("notes", CONCEPTS + """,
    e AS (SELECT project_id, turn, lower(raw) AS s, lower(coalesce(lead(raw) OVER w, first_value(raw) OVER w)) AS t, least(10,turn+4) AS weight FROM notes
          WINDOW w AS (PARTITION BY project_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
    SELECT e.project_id, a.id AS source, b.id AS target, arg_min(e.weight, turn) AS weight FROM e JOIN k a ON a.project_id=e.project_id AND a.folded=s
    JOIN k b ON b.project_id=e.project_id AND b.folded=t WHERE a.id<>b.id GROUP BY ALL"""))
def ground_edges(spark, sf):
    reports = raw(spark, sf)[0]
    return g.ground_edges(reports, g.ground_concepts(reports))


@query("note_signal_totals", sql("notes", """
    SELECT project_id, CAST(sum(turn) AS BIGINT) AS questions, CAST(sum(greatest(0,turn-3)) AS BIGINT) AS agreements, 0 AS "affectionMarkers",
           CAST(sum(CASE WHEN turn=2 THEN 0 ELSE 2 END) AS BIGINT) AS "tensionMarkers" FROM notes GROUP BY 1"""))
def note_signal_totals(spark, sf):
    return g.note_signal_totals(raw(spark, sf)[1])


def whole(spark, sf):
    """(reports, notes, segments, projects): one JSON report per project on its whole text, from F5 to F8; no notes.

    Beside ``raw``, whose check SQL fixes the first word of every turn.
    """
    s = insights.with_tokens(tables.segments(spark, sf))  # four operators read the words
    p = cut(tables.projects(spark, sf, s), "projects")
    top = cut(insights.top_concepts(insights.token_rows(s)), "concepts")
    points = insights.key_points(s, cut(insights.pick_key_points(insights.segment_scores(s)), "picks"))

    def listed(df, field, order, **values):
        item = F.struct(F.col(order).alias("o"), F.struct(*[F.col(c).cast("string").alias(k) for k, c in values.items()]).alias("i"))
        rows = df.groupBy("project_id").agg(F.array_sort(F.collect_list(item)).alias("x"))
        return rows.select("project_id", F.transform("x", lambda x: x["i"]).alias(field))

    parts = [listed(points, "keyPoints", "pick", title="title", text="text", startMs="start_ms"),
             listed(insights.chapters(s, p), "chapters", "bucket", title="title", description="description", startMs="start_ms"),
             listed(top, "concepts", "rank", label="label", weight="weight"),
             listed(insights.concept_edges(s, top), "conceptEdges", "rank", source="source", target="target", weight="weight")]
    reports = p.select("project_id")
    for part in parts:
        reports = reports.join(cut(part, "part"), "project_id", "left")
    payload = F.to_json(F.struct("keyPoints", "chapters", "concepts", "conceptEdges")).alias("payload")
    reports = cut(reports.select("project_id", payload), "reports")
    notes = p.where(F.lit(False)).select("project_id", F.lit(0).alias("note"), F.lit("{}").alias("payload"))
    return g.parse(reports, g.REPORT_SCHEMA), g.parse(notes, g.NOTE_SCHEMA), s, p


@query("ground_points_whole")
def ground_points_whole(spark, sf):
    reports, notes, s, _ = whole(spark, sf)
    return g.ground_points(reports, notes, s)


@query("ground_chapters_whole")
def ground_chapters_whole(spark, sf):
    reports, _, s, p = whole(spark, sf)
    return g.ground_chapters(reports, s, p.select("project_id", "duration_ms"))


@query("ground_concepts_whole")
def ground_concepts_whole(spark, sf):
    return g.ground_concepts(whole(spark, sf)[0]).drop("folded")


@query("ground_edges_whole")
def ground_edges_whole(spark, sf):
    reports = whole(spark, sf)[0]
    return g.ground_edges(reports, g.ground_concepts(reports))
