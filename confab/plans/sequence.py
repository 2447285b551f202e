"""Order-dependent operators."""

from pyspark.sql import functions as F

from confab.functions import review
from confab.operators import sequence as seq
from confab.operators.blocks import Scan, running
from confab.plans.registry import CTES, query, sql
from confab.session import cut
from confab.sources import tables

NUMBERED = """SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY start_ms, segment_order) AS rn FROM segments"""
CTES["ordered"] = (("segments",), NUMBERED)

PARAGRAPHS = r"""
  WITH RECURSIVE ft AS MATERIALIZED (
    SELECT *, trim(text) AS strip, length(trim(text)) AS len, length(text) AS raw_len,
      (CASE WHEN regexp_matches(trim(text), '^[,.;:!?…)\]}»”]') THEN 1 ELSE 0 END) AS closer,
      regexp_matches(trim(text), '[.!?…]["''»”)]*$') AS ends,
      greatest(0, coalesce(start_ms - lag(end_ms) OVER w, 0)) AS gap,
      (lag(speaker) OVER w IS DISTINCT FROM speaker OR lag(speaker_profile_id) OVER w IS DISTINCT FROM speaker_profile_id) AS chg
    FROM ordered WINDOW w AS (PARTITION BY project_id ORDER BY rn)),
  rec AS (
    SELECT project_id, rn, rn AS grp, start_ms AS st, len AS chars, raw_len AS raw, 0 AS tight, 1 AS held, closer AS lc, ends AS le
    FROM ft WHERE rn=1
    UNION ALL
    SELECT project_id, rn, CASE WHEN brk THEN rn ELSE grp END, CASE WHEN brk THEN start_ms ELSE st END,
      CASE WHEN brk THEN len ELSE chars+len END, CASE WHEN brk THEN raw_len ELSE raw+raw_len+1 END,
      CASE WHEN brk THEN 0 ELSE tight+lc END, CASE WHEN brk THEN 1 ELSE held+1 END, closer, ends
    FROM (SELECT f.*, r.grp, r.st, r.chars, r.raw, r.tight, r.held, r.lc, r.le,
            (f.chg OR f.gap>1800 OR f.end_ms-r.st>42000 OR r.chars+f.len+r.held-r.tight-f.closer>620
             OR (r.le AND (f.gap>=750 OR r.raw>=180))) AS brk
          FROM rec r JOIN ft f ON f.project_id=r.project_id AND f.rn=r.rn+1))
  , ws AS (SELECT ft.project_id, grp, string_agg(word || '@' || w.start_ms, ' ' ORDER BY rn, w.start_ms, w.end_ms) AS words
       FROM ft JOIN rec USING (project_id, rn) JOIN words w ON w.project_id=ft.project_id AND w.segment_id=ft.segment_id GROUP BY ALL),
  rs AS (SELECT project_id, grp, flatten(list(CASE WHEN segment_id%3=0 THEN ['r' || segment_id%2, 'x'] ELSE []::VARCHAR[] END ORDER BY rn)) AS l
       FROM ft JOIN rec USING (project_id, rn) GROUP BY ALL),
  rd AS (SELECT project_id, grp, array_to_string(list_filter(l, lambda v, i: list_position(l, v)=i), '|') AS reasons FROM rs)
  SELECT ft.project_id, any_value(ws.words) AS words, bool_or(ft.segment_id%9=0) AS speaker_provisional, arg_min(ft.speaker_profile_id+1, rn) AS speaker_cluster,
    any_value(reasons) || CASE WHEN round(min(confidence),4)<0.84 THEN CASE WHEN any_value(reasons)<>'' THEN '|' ELSE '' END || 'Parte del texto tiene confianza inferior al 84 %.' ELSE '' END AS review_reasons,
    arg_min(ft.segment_id, rn) AS segment_id,
    row_number() OVER (PARTITION BY ft.project_id ORDER BY min(rn))-1 AS "order",
    min(start_ms) AS start_ms, arg_max(end_ms, rn) AS end_ms, arg_min(speaker, rn) AS speaker,
    ltrim(string_agg(CASE WHEN closer=1 THEN '' ELSE ' ' END || strip, '' ORDER BY rn)) AS text,
    round(min(confidence),4) AS confidence, count(*) AS members,
    CASE WHEN bool_or(review_state='pending') THEN 'pending' WHEN bool_or(review_state='corrected') THEN 'corrected'
         WHEN count(review_state)=count(*) THEN 'accepted' END AS review_state
  FROM ft JOIN rec USING (project_id, rn) JOIN ws ON ws.project_id=ft.project_id AND ws.grp=rec.grp JOIN rd ON rd.project_id=ft.project_id AND rd.grp=rec.grp
  GROUP BY ft.project_id, rec.grp"""
PARAGRAPH = ["project_id", "segment_id", "order", "start_ms", "end_ms", "speaker", "text", "confidence", "members", "review_state",
             "speaker_provisional", "speaker_cluster"]


def paragraphs(spark, sf, **limits):
    """Segments with reasons, provisional voices and clusters, and their words."""
    w = tables.staged_words(spark, sf)
    i = F.col("segment_id")
    s = tables.segments(spark, sf, w).withColumns({
        "review_reasons": F.when(i % 3 == 0, F.array(F.concat(F.lit("r"), i % 2), F.lit("x"))), "speaker_provisional": i % 9 == 0,
        "speaker_cluster": F.col("speaker_profile_id") + 1})
    return seq.group_paragraphs(s, **limits, words=w.select("project_id", "segment_id", "word", "start_ms", "end_ms", "probability"))


def shown(p):
    return p.select(*PARAGRAPH, F.array_join("review_reasons", "|").alias("review_reasons"), F.array_join(F.transform(
        "words", lambda w: F.concat(w["word"], F.lit("@"), w["start_ms"])), " ").alias("words"))


@query("group_paragraphs", sql("ordered words", PARAGRAPHS))
def group_paragraphs(spark, sf):
    return shown(paragraphs(spark, sf))


@query("pack_chunks", sql("ordered", """
  WITH RECURSIVE rec AS (
    SELECT project_id, segment_id, rn, 0 AS chunk, length(text)+40 AS size, length(text)+40 AS cost FROM ordered WHERE rn=1
    UNION ALL
    SELECT o.project_id, o.segment_id, o.rn, r.chunk + CASE WHEN r.size+length(o.text)+40>1300 THEN 1 ELSE 0 END,
           CASE WHEN r.size+length(o.text)+40>1300 THEN length(o.text)+40 ELSE r.size+length(o.text)+40 END, length(o.text)+40
    FROM rec r JOIN ordered o ON o.project_id=r.project_id AND o.rn=r.rn+1)
  SELECT project_id, segment_id, chunk, cost FROM rec"""))
def pack_chunks(spark, sf):
    return seq.pack_chunks(tables.segments(spark, sf), 1_300)


@query("speaker_units", sql("segments", """
  WITH RECURSIVE w AS MATERIALIZED (
    SELECT w.*, row_number() OVER (PARTITION BY segment_id ORDER BY w.start_ms) AS rn,
      coalesce(lead(w.start_ms) OVER (PARTITION BY segment_id ORDER BY w.start_ms) - w.end_ms, 10000) AS pause
    FROM words w JOIN (SELECT segment_id FROM segments WHERE end_ms-start_ms>3400) USING (segment_id)),
  rec AS (
    SELECT project_id, segment_id, rn, 1 AS grp, start_ms AS st, start_ms, end_ms, pause, word FROM w WHERE rn=1
    UNION ALL
    SELECT w.project_id, w.segment_id, w.rn, CASE WHEN c THEN w.rn ELSE grp END, CASE WHEN c THEN w.start_ms ELSE st END,
           w.start_ms, w.end_ms, w.pause, w.word
    FROM (SELECT *, (end_ms-st>=3000 OR (end_ms-st>=1050 AND pause>=260)) AS c FROM rec) r
    JOIN w ON w.segment_id=r.segment_id AND w.rn=r.rn+1),
  u AS (SELECT project_id, segment_id, grp, min(start_ms) AS s, max(end_ms) AS e, count(*) AS n, string_agg(word, ' ' ORDER BY rn) AS t FROM rec GROUP BY ALL),
  v AS (SELECT *, lead(grp) OVER (PARTITION BY segment_id ORDER BY grp) IS NULL AS last,
               lag(grp) OVER (PARTITION BY segment_id ORDER BY grp) AS before FROM u),
  x AS (SELECT project_id, segment_id, CASE WHEN last AND before IS NOT NULL AND e-s<550 THEN before ELSE grp END AS g, grp, s, e, n, t FROM v),
  y AS (SELECT x.project_id, x.segment_id, g, min(s) AS start_ms, max(e) AS end_ms, CAST(sum(n) AS BIGINT) AS words,
               string_agg(t, ' ' ORDER BY x.grp) AS text FROM x GROUP BY ALL)
  SELECT project_id, segment_id, segment_id || '-voice-' || (row_number() OVER (PARTITION BY segment_id ORDER BY g)-1) AS unit_id,
         start_ms, end_ms, words, text FROM y
  UNION ALL SELECT s.project_id, s.segment_id, CAST(s.segment_id AS VARCHAR), s.start_ms, s.end_ms, count(*), trim(any_value(s.text))
  FROM segments s JOIN words USING (segment_id) WHERE s.end_ms-s.start_ms<=3400 GROUP BY ALL"""))
def speaker_units(spark, sf):
    w = tables.staged_words(spark, sf)
    return seq.speaker_units(tables.staged(spark, sf, w), w).select("project_id", "segment_id", "unit_id", "start_ms", "end_ms", "words", "text")


def cues(line: int) -> str:
    """Bodies of the WITH items up to ``cues``: words walk into lines of at most ``line`` characters, two lines are a cue, and a segment's time is shared by length."""
    return rf"""
  WITH RECURSIVE spoken AS MATERIALIZED (
    SELECT project_id, segment_id, segment_order, speaker, greatest(0, start_ms) AS s, greatest(greatest(0, start_ms) + 1, end_ms) AS e,
           list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS l FROM segments),
  walk AS (
    SELECT project_id, segment_id, 1 AS i, 0 AS line_no, length(l[1]) AS fill, l FROM spoken WHERE len(l) > 0
    UNION ALL
    SELECT project_id, segment_id, i + 1, line_no + CASE WHEN over THEN 1 ELSE 0 END, CASE WHEN over THEN length(l[i+1]) ELSE fill + 1 + length(l[i+1]) END, l
    FROM (SELECT *, fill + 1 + length(l[i+1]) > {line} AS over FROM walk WHERE i < len(l))),
  lined AS (SELECT project_id, segment_id, line_no, string_agg(l[i], ' ' ORDER BY i) AS t FROM walk GROUP BY 1, 2, 3),
  paired AS (SELECT project_id, segment_id, line_no//2 AS n, string_agg(t, chr(10) ORDER BY line_no) AS text FROM lined GROUP BY 1, 2, 3),
  placed AS (
    SELECT *, CAST(sum(length(text)) OVER (PARTITION BY project_id, segment_id ORDER BY n) AS BIGINT) - length(text) AS before,
           CAST(sum(length(text)) OVER (PARTITION BY project_id, segment_id) AS BIGINT) AS total,
           n = max(n) OVER (PARTITION BY project_id, segment_id) AS final FROM paired),
  timed AS (
    SELECT project_id, segment_id, segment_order, n, speaker, text, final, e, CAST(round_even(s + (e-s)*before/total, 0) AS BIGINT) AS start_ms,
           CAST(round_even(s + (e-s)*(before + greatest(1, length(text)))/total, 0) AS BIGINT) AS stop FROM placed JOIN spoken USING (project_id, segment_id)),
  cues AS (
    SELECT project_id, segment_id, segment_order, n, speaker, start_ms, greatest(start_ms + 1, CASE WHEN final THEN e ELSE stop END) AS end_ms, text FROM timed)"""


@query("subtitle_cues", sql("segments", cues(24) + " SELECT * FROM cues"))
def subtitle_cues(spark, sf):
    return seq.subtitle_cues(tables.segments(spark, sf), 24, 2)


CTES["labelled"] = (("segments",), """
    SELECT project_id, segment_id AS unit_id, start_ms, CASE WHEN segment_id%5=4 THEN NULL ELSE (segment_order*7//8)%3 END AS label,
           CASE WHEN segment_id%5=4 THEN NULL ELSE speaker_confidence END AS confidence,
           row_number() OVER (PARTITION BY project_id ORDER BY start_ms, segment_id) AS rn FROM segments""")
CTES["filled"] = (("labelled",), """
    SELECT project_id, unit_id, start_ms, rn, coalesce(last_value(label IGNORE NULLS) OVER (PARTITION BY project_id ORDER BY rn), 0) AS label,
           CASE WHEN label IS NULL THEN 0.5::DOUBLE ELSE confidence END AS confidence FROM labelled""")


def labelled(spark, sf):
    """Units whose every fifth label is missing."""
    gap = F.col("segment_id") % 5 == 4
    return tables.segments(spark, sf).select(
        "project_id", F.col("segment_id").alias("unit_id"), "start_ms",
        F.when(~gap, F.floor(F.col("segment_order") * 7 / 8) % 3).alias("label"),
        F.when(~gap, F.col("speaker_confidence")).alias("confidence"))


@query("fill_labels", sql("filled", "SELECT * EXCLUDE (rn) FROM filled"))
def fill_labels(spark, sf):
    return seq.fill_labels(labelled(spark, sf))


@query("smooth_labels", sql("filled", """
  WITH RECURSIVE a AS MATERIALIZED (SELECT *, lead(label) OVER (PARTITION BY project_id ORDER BY rn) AS nx FROM filled),
  rec AS (
    SELECT project_id, unit_id, start_ms, rn, label, confidence FROM a WHERE rn=1
    UNION ALL
    SELECT a.project_id, a.unit_id, a.start_ms, a.rn,
      CASE WHEN r.label=a.nx AND a.label<>a.nx AND coalesce(a.confidence,0)<0.75 THEN r.label ELSE a.label END,
      CASE WHEN r.label=a.nx AND a.label<>a.nx AND coalesce(a.confidence,0)<0.75 THEN least(0.7,a.confidence) ELSE a.confidence END
    FROM rec r JOIN a ON a.project_id=r.project_id AND a.rn=r.rn+1)
  SELECT project_id, unit_id, start_ms, label, confidence FROM rec"""))
def smooth_labels(spark, sf):
    return seq.smooth_labels(cut(seq.fill_labels(labelled(spark, sf)), "filled"))


DOUBTFUL = "(regexp_matches(text,'[ÃÂ]') OR confidence<0.84)"


@query("review_candidates", sql("segments", f"""
    SELECT project_id, segment_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY confidence, segment_order) AS rank
      FROM segments WHERE {DOUBTFUL}) JOIN (SELECT project_id, count(*) AS n FROM segments GROUP BY 1) USING (project_id)
    WHERE rank<=least(120,greatest(12,ceil(n*0.12)))"""))
def review_candidates(spark, sf):
    return seq.review_candidates(tables.segments(spark, sf), review.text_is_suspicious()).select(
        "project_id", "segment_id", "rank")


@query("accept_refinements", sql("segments", r"""
    SELECT segment_id, CASE WHEN t THEN 'R ' || text ELSE text END AS text, CASE WHEN t THEN nc ELSE confidence END AS confidence, t AS refined
    FROM (SELECT *, segment_id%4<>3 AND nc>=confidence-0.03 AS t FROM (
      SELECT *, round(0.70+(segment_id%23)/100.0,4)::DOUBLE AS nc FROM segments))"""))
def accept_refinements(spark, sf):
    s = tables.staged(spark, sf)
    i = F.col("segment_id")
    refined = s.select("project_id", "segment_id", F.when(i % 4 == 3, "").otherwise(F.concat(F.lit("R "), "text")).alias("text"),
                       F.round(0.70 + (i % 23) / F.lit(100.0), 4).alias("confidence"))
    return seq.accept_refinements(s, refined).select("segment_id", "text", "confidence", "refined")


@query("refined_words", sql("segments words", r"""
    WITH t AS (SELECT project_id, segment_id, start_ms, text, segment_id%4<>3 AND round(0.70+(segment_id%23)/100.0,4)::DOUBLE>=confidence-0.03 AS t FROM segments)
    SELECT w.project_id, w.segment_id, word, w.start_ms FROM words w JOIN t USING (segment_id) WHERE NOT t
    UNION ALL SELECT project_id, segment_id, 'R', start_ms FROM t WHERE t UNION ALL SELECT project_id, segment_id, 'neu', start_ms+100 FROM t WHERE t"""))
def refined_words(spark, sf):
    """The second recogniser gives two words for every segment it was asked about."""
    w = tables.staged_words(spark, sf)
    s, i = tables.staged(spark, sf, w), F.col("segment_id")
    refined = s.select("project_id", "segment_id", F.when(i % 4 == 3, "").otherwise("R neu").alias("text"), F.round(0.70 + (i % 23) / F.lit(100.0), 4).alias("confidence"))
    new = s.select("project_id", "segment_id", F.explode(F.array(F.struct(F.lit("R").alias("word"), F.col("start_ms")), F.struct(
        F.lit("neu").alias("word"), (F.col("start_ms") + 100).alias("start_ms")))).alias("w")).select("project_id", "segment_id", "w.*")
    return seq.refined_words(w.select("project_id", "segment_id", "word", "start_ms"), new, seq.accept_refinements(s, refined))


SPLIT = """
    WITH r AS (SELECT *, CASE WHEN review_state='pending' THEN length(text)//2 END AS pos FROM segments),
    c AS (SELECT *, least(length(text)-1, greatest(1,pos)) AS pt FROM r),
    d AS (SELECT *, coalesce(pos IS NOT NULL AND trim(left(text,pt))<>'' AND trim(substr(text,pt+1))<>'', false) AS ok,
                 CAST(floor(start_ms+(end_ms-start_ms)*(pt/length(text))+0.5) AS BIGINT) AS ms FROM c)"""


@query("split_records", sql("segments words", SPLIT + """
    SELECT w.project_id, CASE WHEN ok AND w.end_ms>ms THEN w.segment_id+1000000000 ELSE w.segment_id END AS segment_id, ok AND w.end_ms>ms AS right_half,
           CASE WHEN ok THEN ms END AS split_ms, word, pos AS at FROM (SELECT * EXCLUDE (pos) FROM d) JOIN words w USING (segment_id)"""))
def split_records(spark, sf):
    """Words after every segment pending review was cut in the middle, under the ids of the halves."""
    w = tables.staged_words(spark, sf)
    s = tables.staged(spark, sf, w)
    req = s.where(F.col("review_state") == "pending").select("project_id", "segment_id", F.floor(F.length("text") / 2).alias("position"))
    halves = cut(seq.split_segments(s, req, F.col("segment_id") + 1_000_000_000), "halves")
    moved = seq.words_after_split(w.select("project_id", "segment_id", "word", "end_ms", F.col("pos").alias("at")), halves)
    part = halves.select("project_id", "segment_id", (F.col("part") == 1).alias("right_half"), "split_ms")
    return moved.join(part, ["project_id", "segment_id"]).select("project_id", "segment_id", "right_half", "split_ms", "word", "at")


@query("merged_words", sql("ordered words", """
    WITH m AS (SELECT *, coalesce(review_state='corrected',false) AND NOT coalesce(lag(review_state) OVER w='corrected',false) AS req
      FROM ordered WINDOW w AS (PARTITION BY project_id ORDER BY rn)),
    n AS (SELECT m.*, coalesce(lag(req) OVER w,false) AS prv, lag(segment_id) OVER w AS pid FROM m WINDOW w AS (PARTITION BY project_id ORDER BY rn))
    SELECT w.project_id, CASE WHEN prv THEN pid ELSE w.segment_id END AS segment_id, word, pos, w.turn FROM words w JOIN n USING (segment_id)"""))
def merged_words(spark, sf):
    """Words after every corrected segment that follows none took the one after it."""
    w = tables.staged_words(spark, sf)
    s = tables.staged(spark, sf, w)
    wanted = F.coalesce(F.col("review_state") == "corrected", F.lit(False))
    req = running(s, ["project_id"], F.floor(F.col("segment_order") / 4_096), ["segment_order"], [Scan("after_one", wanted, "last", inclusive=False)])
    m = cut(seq.merge_segments(s, req.where(wanted & ~F.coalesce("after_one", F.lit(False))).select("project_id", "segment_id")), "merged")
    return seq.words_after_merge(w.select("project_id", "segment_id", "word", "pos", "turn"), m)


@query("split_segments", sql("segments", """
    WITH r AS (SELECT *, CASE WHEN review_state='pending' THEN length(text)//2 END AS pos FROM segments),
    c AS (SELECT *, least(length(text)-1, greatest(1,pos)) AS pt FROM r),
    d AS (SELECT *, coalesce(pos IS NOT NULL AND trim(left(text,pt))<>'' AND trim(substr(text,pt+1))<>'', false) AS ok,
                 CAST(floor(start_ms+(end_ms-start_ms)*(pt/length(text))+0.5) AS BIGINT) AS ms FROM c),
    e AS (SELECT project_id, segment_id, segment_order AS was, 0 AS part, start_ms, CASE WHEN ok THEN ms ELSE end_ms END AS end_ms,
                 CASE WHEN ok THEN trim(left(text,pt)) ELSE text END AS text, CASE WHEN NOT ok THEN review_state END AS review_state FROM d
          UNION ALL SELECT project_id, segment_id, segment_order, 1, ms, end_ms, trim(substr(text,pt+1)), NULL FROM d WHERE ok)
    SELECT project_id, segment_id, part, start_ms, end_ms, text, review_state,
           row_number() OVER (PARTITION BY project_id ORDER BY was, part)-1 AS segment_order FROM e"""))
def split_segments(spark, sf):
    """Every segment pending review is cut in the middle."""
    s = tables.staged(spark, sf)
    req = s.where(F.col("review_state") == "pending").select(
        "project_id", "segment_id", F.floor(F.length("text") / 2).alias("position"))
    return seq.split_segments(s, req, F.col("segment_id")).select("project_id", "segment_id", "part", "start_ms", "end_ms", "text",
                                             "review_state", "segment_order")


@query("split_words", sql("words", """
    SELECT w.project_id, w.segment_id, pos, CASE WHEN end_ms > m THEN 1 ELSE 0 END AS part FROM words w
    JOIN (SELECT segment_id, (min(start_ms)+max(end_ms))//2 AS m FROM words GROUP BY 1) USING (segment_id)"""))
def split_words(spark, sf):
    """Every segment's words are divided at the middle of its time."""
    w = tables.words(spark, sf)
    cuts = w.groupBy("project_id", "segment_id").agg(
        F.floor((F.min("start_ms") + F.max("end_ms")) / 2).alias("split_ms"))
    return seq.split_words(w, cuts).select("project_id", "segment_id", "pos", "part")


@query("merge_segments", sql("ordered", """
    WITH n AS (SELECT o.*, lead(segment_id) OVER w AS nid, lead(end_ms) OVER w AS ne, lead(text) OVER w AS nt, lead(confidence) OVER w AS nc,
        lead(review_state) OVER w AS nr, lead(speaker) OVER w AS ns, lead(speaker_profile_id) OVER w AS np,
        coalesce(review_state='corrected',false) AS req, coalesce(lag(review_state) OVER w='corrected',false) AS prv
      FROM ordered o WINDOW w AS (PARTITION BY project_id ORDER BY rn)),
    h AS (SELECT *, req AND nid IS NOT NULL AS hit, speaker IS NOT DISTINCT FROM ns AND speaker_profile_id IS NOT DISTINCT FROM np AS same FROM n)
    SELECT project_id, segment_id, row_number() OVER (PARTITION BY project_id ORDER BY segment_order)-1 AS segment_order,
      CASE WHEN hit THEN greatest(end_ms,ne) ELSE end_ms END AS end_ms, CASE WHEN hit THEN trim(text)||' '||trim(nt) ELSE text END AS text,
      CASE WHEN hit THEN least(confidence,nc) ELSE confidence END AS confidence,
      CASE WHEN hit THEN CASE WHEN review_state IS NOT NULL AND nr IS NOT NULL THEN
        CASE WHEN review_state='corrected' OR nr='corrected' THEN 'corrected' ELSE 'accepted' END END ELSE review_state END AS review_state,
      CASE WHEN hit AND NOT same THEN NULL ELSE speaker END AS speaker, hit AND NOT same AS speaker_provisional
    FROM h WHERE NOT prv"""))
def merge_segments(spark, sf):
    """Every corrected segment is joined with the one after it."""
    s = tables.staged(spark, sf)
    return seq.merge_segments(s, s.where(F.col("review_state") == "corrected").select("project_id", "segment_id")).select(
        "project_id", "segment_id", "segment_order", "end_ms", "text", "confidence", "review_state", "speaker",
        "speaker_provisional")


@query("free_generic_names", """
    WITH t AS (SELECT DISTINCT user_id AS n FROM events WHERE user_id>0),
    k AS (SELECT DISTINCT CAST(label AS BIGINT)+1 AS slot FROM embeddings),
    f AS (SELECT n, row_number() OVER (ORDER BY n) AS slot FROM (SELECT unnest(range(1, (SELECT count(*)+1 FROM t)
            + (SELECT max(slot) FROM k))) AS n) WHERE n NOT IN (SELECT n FROM t))
    SELECT slot, 'Hablante ' || n AS name FROM k JOIN f USING (slot)""")
def free_generic_names(spark, sf):
    """Taken names: one per user; wanted: one per voice label."""
    taken = tables.read(spark, sf, "events").select(F.concat(F.lit("hablante "), "user_id").alias("name")).distinct()
    wanted = tables.read(spark, sf, "embeddings").select((F.col("label").cast("long") + 1).alias("slot")).distinct()
    return seq.free_generic_names(taken, wanted)


@query("leader_cluster", sql("samples", """
  WITH RECURSIVE u AS MATERIALIZED (
    SELECT source_project AS project_id, sample_id, start_ms, duration_ms, embedding, row_number() OVER (PARTITION BY source_project ORDER BY start_ms) AS rn
    FROM samples),
  walk AS (
    SELECT project_id, rn, [embedding] AS voices, [1] AS sizes, CAST(1 AS BIGINT) AS cluster FROM u WHERE rn=1
    UNION ALL
    SELECT project_id, rn,
      CASE WHEN fresh THEN voices || [v]
           ELSE list_transform(voices, lambda c, i: CASE WHEN i=k THEN list_transform(moved, lambda x: x/greatest(sqrt(list_inner_product(moved, moved)), 1e-8)) ELSE c END) END,
      CASE WHEN fresh THEN sizes || [1] ELSE list_transform(sizes, lambda z, i: CASE WHEN i=k THEN z+1 ELSE z END) END,
      CASE WHEN fresh THEN len(voices)+1 ELSE k END
    FROM (SELECT *, list_transform(voices[k], lambda c, i: c + least(0.15, 1/(sizes[k]+1))*(v[i]-c)) AS moved FROM (
      SELECT *, len(voices)<8 AND duration_ms>=1000 AND list_max(near)<0.884 AS fresh, list_position(near, list_max(near)) AS k FROM (
        SELECT w.project_id, u.rn, voices, sizes, u.embedding AS v, duration_ms, list_transform(voices, lambda c: list_inner_product(c, u.embedding)) AS near
        FROM walk w JOIN u ON u.project_id=w.project_id AND u.rn=w.rn+1))))
  SELECT project_id, sample_id, start_ms, duration_ms, cluster FROM walk JOIN u USING (project_id, rn)"""))
def leader_cluster(spark, sf):
    u = tables.voice_samples(spark, sf).select(F.col("source_project").alias("project_id"), "sample_id", "start_ms",
                                               "duration_ms", "embedding")
    return seq.leader_cluster(u)
