"""Catalogue, set operations and reports."""

from pyspark.sql import functions as F

from confab.operators import catalog as cat
from confab.plans.registry import CTES, query, sql
from confab.plans.text import TEXT_REVIEW
from confab.session import cut, scratch_path
from confab.sources import media, tables


@query("nest_projects", sql("projects words", """
    SELECT p.project_id, p.name, 0 AS part, s.n AS segments, w.n AS words, s.first_text, s.last_text, w.first_word, w.last_word
    FROM projects p
    JOIN (SELECT project_id, count(*) AS n, arg_min(text, start_ms) AS first_text, arg_max(text, start_ms) AS last_text
          FROM segments GROUP BY 1) s USING (project_id)
    JOIN (SELECT project_id, count(*) AS n, arg_min(word, start_ms) AS first_word, arg_max(word, start_ms) AS last_word
          FROM words GROUP BY 1) w USING (project_id)"""))
def nest_projects(spark, sf):
    w = tables.staged_words(spark, sf)
    s = tables.staged(spark, sf, w)
    n = cat.nest_projects(tables.projects(spark, sf, s), s, w)
    last = lambda c: F.element_at(c, -1)
    return n.select(
        "project_id", "name", "part", F.size("segments").cast("long").alias("segments"),
        F.aggregate("segments", F.lit(0), lambda a, x: a + F.size(x["words"])).cast("long").alias("words"),
        F.col("segments")[0]["text"].alias("first_text"), last("segments")["text"].alias("last_text"),
        F.col("segments")[0]["words"][0]["text"].alias("first_word"),
        last(last("segments")["words"])["text"].alias("last_word"))


def nested(spark, sf):
    """Nested projects with an unknown review state and a missing order here and there."""
    w = tables.staged_words(spark, sf)
    s = tables.staged(spark, sf, w)
    i = F.col("segment_id")
    s = s.withColumn("review_state", F.when(i % 11 == 3, "maybe").otherwise(F.col("review_state")))
    return cat.nest_projects(tables.projects(spark, sf, s), s, w)


@query("flatten_segments", sql("segments", """
    SELECT project_id, segment_id, segment_order, text, start_ms, end_ms, review_state FROM segments"""))
def flatten_segments(spark, sf):
    return cat.flatten_projects(nested(spark, sf))[0].select(
        "project_id", "segment_id", "segment_order", "text", "start_ms", "end_ms", "review_state")


@query("flatten_words", sql("words", "SELECT project_id, segment_id, start_ms, end_ms, word AS text, probability FROM words"))
def flatten_words(spark, sf):
    return cat.flatten_projects(nested(spark, sf))[1]


@query("replace_project_segments", sql("projects", """
    SELECT s.project_id, segment_id, CASE WHEN status='transcribing' THEN 'N ' || text ELSE text END AS text
    FROM segments s JOIN projects USING (project_id)
    WHERE status<>'transcribing' OR turn>0 OR NOT EXISTS (SELECT 1 FROM segments x WHERE x.project_id=s.project_id AND x.turn>0)"""))
def replace_project_segments(spark, sf):
    """Unfinished projects come in again, without their opening turn."""
    s = tables.staged(spark, sf)
    open_ = tables.projects(spark, sf, s).where(F.col("status") == "transcribing").select("project_id")
    cols = s.select("project_id", "segment_id", "text", "turn")
    new = cols.join(open_, "project_id").where(F.col("turn") > 0).withColumn("text", F.concat(F.lit("N "), "text"))
    return cat.replace_project_segments(cols, new).drop("turn")


@query("align_schema", """
    SELECT event_id, user_id, event_type, NULL::VARCHAR AS stage, NULL::DOUBLE AS speed_x FROM events""")
def align_schema(spark, sf):
    old = tables.read(spark, sf, "events").select("event_id", "user_id", "event_type")
    new = spark.createDataFrame([], "event_id long, user_id long, event_type string, stage string, speed_x double")
    return cat.align_schema(old, new)


@query("delete_projects", sql("projects markers", """
    WITH d AS (SELECT project_id FROM projects WHERE status='transcribing')
    SELECT project_id, 'segments' AS "table", count(*) AS deleted FROM segments JOIN d USING (project_id) GROUP BY 1
    UNION ALL SELECT project_id, 'markers', count(*) FROM markers JOIN d USING (project_id) GROUP BY 1
    UNION ALL SELECT project_id, 'left_segments', count(*) FROM segments WHERE project_id NOT IN (SELECT project_id FROM d) GROUP BY 1"""))
def delete_projects(spark, sf):
    s = tables.staged(spark, sf)
    ids = tables.projects(spark, sf, s).where(F.col("status") == "transcribing")
    left, gone = cat.delete_projects(ids, segments=s, markers=tables.markers(spark, sf, s))
    rest = left["segments"].groupBy("project_id").agg(F.count(F.lit(1)).alias("deleted"))
    return gone.unionByName(rest.select("project_id", F.lit("left_segments").alias("table"), "deleted"))


UPSERTED = sql("projects", f"""
    WITH cur AS (SELECT project_id, segment_id, segment_order, text FROM segments),
    inc AS (SELECT project_id, segment_id, segment_order, 'U' || turn || ' ' || text AS text, turn AS seq,
                   status='transcribing' AND turn=1 AS rep FROM segments JOIN projects USING (project_id) WHERE {TEXT_REVIEW}),
    since AS (SELECT project_id, max(seq) FILTER (WHERE rep) AS since FROM inc GROUP BY 1),
    al AS (SELECT c.*, -1 AS seq FROM cur c LEFT JOIN since USING (project_id) WHERE since IS NULL
           UNION ALL SELECT i.* EXCLUDE (rep) FROM inc i JOIN since USING (project_id) WHERE seq>=coalesce(since,seq))
    SELECT project_id, segment_id, segment_order, text FROM al
    QUALIFY row_number() OVER (PARTITION BY project_id, segment_id ORDER BY seq DESC)=1""")


def reviewed_changes(spark, sf):
    """Reviewed texts arrive per turn; unfinished projects are replaced from their second turn on."""
    from confab.functions import review

    s = tables.staged(spark, sf)
    open_ = tables.projects(spark, sf, s).select("project_id", "status")
    inc = s.where(review.needs_text_review()).join(open_, "project_id").select(
        "project_id", "segment_id", "segment_order", F.concat(F.lit("U"), "turn", F.lit(" "), "text").alias("text"),
        F.col("turn").cast("long").alias("seq"), ((F.col("status") == "transcribing") & (F.col("turn") == 1)).alias("replace_existing"))
    return s.select("project_id", "segment_id", "segment_order", "text"), inc


@query("upsert_segments", UPSERTED)
def upsert_segments(spark, sf):
    return cat.upsert_segments(*reviewed_changes(spark, sf), tables.parts(tables.read(spark, sf, "conversations")))


@query("upsert_segments_stream", UPSERTED)
def upsert_segments_stream(spark, sf):
    """The same changes as a stream of five micro-batches."""
    from confab.streaming import changes
    from confab.streaming.runner import in_batches

    base, inc = reviewed_changes(spark, sf)
    path = scratch_path(spark, "upserts")
    changes.write_upserts(in_batches(cut(inc, "changes"), F.least(F.lit(4), F.col("seq")), 5, "changes"), f"{path}/table", f"{path}/state")
    return changes.upserted(spark, f"{path}/table", base)


@query("keep_versions", """
    SELECT user_id AS project_id, event_id AS version, age FROM (SELECT *, row_number() OVER (PARTITION BY user_id
      ORDER BY ts DESC, event_id DESC) AS age FROM events) WHERE age<=5""")
def keep_versions(spark, sf):
    v = tables.read(spark, sf, "events").select(F.col("user_id").alias("project_id"), F.col("event_id").alias("version"),
                                                F.col("ts").alias("created_at"), F.col("event_id").alias("seq"))
    return cat.keep_versions(v).select("project_id", "version", "age")


@query("restore_version", sql("projects", """
    SELECT s.project_id, segment_id, text FROM segments s"""))
def restore_version(spark, sf):
    """Damage unfinished projects after a snapshot; restoring gives every text back."""
    s = tables.staged(spark, sf).select("project_id", "segment_id", "segment_order", "start_ms", "text")
    ids = tables.projects(spark, sf).where(F.col("status") == "transcribing").select("project_id")
    versions = cat.snapshot(s.join(ids, "project_id", "left_semi"), F.lit("v1"))
    damaged = s.join(ids, "project_id", "left_anti").unionByName(
        s.join(ids, "project_id", "left_semi").withColumn("text", F.lit("?")))
    out = cat.restore_version(damaged, versions, ids.withColumn("version", F.lit("v1")))
    return out["segments"].select("project_id", "segment_id", "text")


@query("restore_version_records", sql("projects words", """
    WITH x AS (SELECT s.*, status, s.project_id%3=0 AS back FROM segments s JOIN projects USING (project_id)),
    w AS (SELECT segment_id, string_agg(word, ' ' ORDER BY start_ms, pos) AS words, string_agg('^' || word, ' ' ORDER BY start_ms, pos) AS neu FROM words GROUP BY 1)
    SELECT project_id, segment_id, CASE WHEN back THEN 'V ' || text ELSE text END AS text, CASE WHEN back THEN 'completed' ELSE status END AS status,
           CASE WHEN back THEN neu ELSE words END AS words FROM x JOIN w USING (segment_id)"""))
def restore_version_records(spark, sf):
    """Two of three projects keep what they have; the others go back to a version with other texts and words."""
    w = tables.staged_words(spark, sf).select("project_id", "segment_id", "start_ms", "pos", "word")
    s = tables.staged(spark, sf).select("project_id", "segment_id", "segment_order", "start_ms", "text")
    p = cut(tables.projects(spark, sf).select("project_id", "status"), "projects")
    old = cat.snapshot(s.withColumn("text", F.concat(F.lit("V "), "text")), F.lit("v1"), words=w.withColumn("word", F.concat(F.lit("^"), "word")))
    out = cat.restore_version(s, cut(old, "versions"), p.where(F.col("project_id") % 3 == 0).select("project_id", F.lit("v1").alias("version")), w, p)
    held = out["words"].groupBy("project_id", "segment_id").agg(F.array_join(F.transform(F.array_sort(
        F.collect_list(F.struct("start_ms", "pos", "word"))), lambda x: x["word"]), " ").alias("words"))
    return out["segments"].join(out["projects"], "project_id").join(held, ["project_id", "segment_id"]).select(
        "project_id", "segment_id", "text", "status", "words")


@query("recover_interrupted", """
    WITH j AS (SELECT user_id AS project_id, arg_max(event_type, event_id) AS t FROM events GROUP BY 1),
    k AS (SELECT project_id, CASE t WHEN 'click' THEN 'analyzing' WHEN 'view' THEN 'waiting_model' WHEN 'signup' THEN 'transcribing'
            WHEN 'purchase' THEN 'completed' ELSE 'paused' END AS state FROM j)
    SELECT project_id, CASE WHEN state IN ('completed','paused') THEN state ELSE 'failed' END AS state,
      CASE WHEN state NOT IN ('completed','paused') THEN 'INTERRUPTED' END AS error_code,
      CASE WHEN state='transcribing' THEN 'failed' ELSE state END AS status,
      CASE WHEN state='analyzing' THEN 'queued' ELSE state END AS queue_state FROM k""")
def recover_interrupted(spark, sf):
    e = tables.read(spark, sf, "events").groupBy(F.col("user_id").alias("project_id")).agg(
        F.max_by("event_type", "event_id").alias("t"))
    t = F.col("t")
    k = e.select("project_id", F.when(t == "click", "analyzing").when(t == "view", "waiting_model")
                 .when(t == "signup", "transcribing").when(t == "purchase", "completed").otherwise("paused").alias("state"))
    jobs, projects, queue = cat.recover_interrupted(
        k.withColumn("error_code", F.lit(None).cast("string")), k.withColumnRenamed("state", "status"),
        k.withColumn("state", F.when(F.col("state") == "analyzing", "running").otherwise(F.col("state"))))
    return jobs.join(projects, "project_id").join(queue.withColumnRenamed("state", "queue_state"), "project_id")


@query("reusable_projects", sql("projects", """
    SELECT lower(media_path) AS path, arg_max(project_id, updated_at) AS project_id FROM projects GROUP BY 1"""))
def reusable_projects(spark, sf):
    s = tables.staged(spark, sf)
    return cat.reusable_projects(tables.projects(spark, sf, s), s)


CTES["jobs"] = ((), """
    SELECT user_id AS project_id, arg_max(event_type, event_id) AS stage, max(event_id) AS processed_ms,
           CASE WHEN count(*)%3=0 THEN 0 ELSE count(*)*1000 END AS total_ms, round(max(value),2) AS percent FROM events GROUP BY 1""")
CTES["queue"] = (("projects",), """
    SELECT project_id, (project_id*7)%23 AS position, CASE project_id%5 WHEN 0 THEN 'running' WHEN 1 THEN 'queued' WHEN 2 THEN 'completed'
           WHEN 3 THEN 'failed' ELSE 'cancelled' END AS queue_state, updated_at AS created_at FROM projects""")


def queue(spark, sf, projects):
    p = F.col("project_id")
    return projects.select(
        "project_id", (p * 7 % 23).alias("position"), F.when(p % 5 == 0, "running").when(p % 5 == 1, "queued")
        .when(p % 5 == 2, "completed").when(p % 5 == 3, "failed").otherwise("cancelled").alias("queue_state"),
        F.col("updated_at").alias("created_at"))


@query("queue_view", sql("queue jobs", """
    SELECT q.project_id, q.position, q.queue_state, q.created_at, p.name, p.media_path, coalesce(j.processed_ms,0) AS processed_ms,
      coalesce(nullif(j.total_ms,0), p.duration_ms) AS total_ms, j.percent, j.stage,
      CASE queue_state WHEN 'running' THEN 0 WHEN 'queued' THEN 1 ELSE 2 END AS rank
    FROM queue q JOIN projects p USING (project_id) LEFT JOIN jobs j USING (project_id)"""))
def queue_view(spark, sf):
    p = tables.projects(spark, sf, tables.staged(spark, sf))
    n = F.count(F.lit(1))
    jobs = tables.read(spark, sf, "events").groupBy(F.col("user_id").alias("project_id")).agg(
        F.max_by("event_type", "event_id").alias("stage"), F.max("event_id").alias("processed_ms"),
        F.when(n % 3 == 0, 0).otherwise(n * 1000).alias("total_ms"), F.round(F.max("value"), 2).alias("percent"))
    return cat.queue_view(queue(spark, sf, p), p, jobs)


@query("queue_status", sql("queue", """
    SELECT count(*) FILTER (WHERE queue_state='running') AS running, count(*) FILTER (WHERE queue_state='queued') AS waiting,
      count(*) FILTER (WHERE queue_state='completed') AS completed, count(*) FILTER (WHERE queue_state IN ('failed','cancelled')) AS failed,
      greatest(0, 30-count(*) FILTER (WHERE queue_state='running')) AS available FROM queue"""))
def queue_status(spark, sf):
    return cat.queue_status(queue(spark, sf, tables.projects(spark, sf)), 30)


@query("apply_voice_names", sql("projects", """
    SELECT segment_id, CASE WHEN speaker='user' AND status='completed' THEN 'Voz ' || p.project_id ELSE speaker END AS speaker,
      CASE WHEN speaker='user' AND status='completed' THEN p.project_id+1000 ELSE speaker_profile_id END AS speaker_profile_id
    FROM segments JOIN projects p USING (project_id)"""))
def apply_voice_names(spark, sf):
    s = tables.staged(spark, sf)
    a = tables.projects(spark, sf, s).where(F.col("status") == "completed").select(
        "project_id", F.lit("user").alias("old_name"), F.concat(F.lit("Voz "), "project_id").alias("name"),
        (F.col("project_id") + 1000).alias("profile_id"))
    return cat.apply_voice_names(s, a).select("segment_id", "speaker", "speaker_profile_id")


@query("insights_if_current", sql("projects", """
    SELECT project_id, CASE WHEN status='completed' THEN 'local ' || name END AS insights FROM projects"""))
def insights_if_current(spark, sf):
    p = tables.projects(spark, sf, tables.staged(spark, sf))
    i = p.select("project_id", F.when(F.col("status") == "completed", F.col("updated_at")).otherwise(
        F.lit("2020-01-01").cast("timestamp_ntz")).alias("source_updated_at"), F.concat(F.lit("local "), "name").alias("insights"))
    return cat.insights_if_current(p, i).select("project_id", "insights")


@query("voice_catalog", sql("profiles segments", """
    WITH s AS (SELECT profile_id, count(DISTINCT source_project) AS source_projects, avg(confidence) AS sample_confidence FROM samples GROUP BY 1),
    r AS (SELECT speaker_profile_id AS profile_id, count(*) AS n, CAST(sum(greatest(0,end_ms-start_ms)) AS BIGINT) AS ms,
            count(DISTINCT project_id) AS pr, avg(speaker_match_confidence) FILTER (WHERE speaker_match_confidence BETWEEN 0.64 AND 1) AS m
          FROM segments GROUP BY 1),
    j AS (SELECT p.*, source_projects, sample_confidence, coalesce(n,0) AS recognized_segments, coalesce(ms,0) AS recognized_ms,
            coalesce(pr,0) AS recognized_projects, m AS match_confidence,
            CAST(round_even(100*(least(sample_count/24.0,1)*0.30+least(total_duration_ms/90000.0,1)*0.25+least(source_projects/3.0,1)*0.20
              +coalesce(greatest(0,least(1,(m-0.5)/0.4)),0)*0.25),0) AS BIGINT) AS score
          FROM profiles p JOIN s USING (profile_id) LEFT JOIN r USING (profile_id))
    SELECT profile_id, name, enabled, sample_count, total_duration_ms, source_projects, round(sample_confidence,6) AS sample_confidence,
      recognized_segments, recognized_ms, recognized_projects, round(match_confidence,6) AS match_confidence, score,
      CASE WHEN score>=78 THEN 'alta' WHEN score>=48 THEN 'buena' ELSE 'aprendiendo' END AS reliability FROM j"""))
def voice_catalog(spark, sf):
    v = tables.voice_samples(spark, sf)
    c = cat.voice_catalog(tables.voice_profiles(spark, sf), v, tables.segments(spark, sf))
    return c.withColumn("sample_confidence", F.round("sample_confidence", 6)).withColumn(
        "match_confidence", F.round("match_confidence", 6))


@query("speaker_count", sql("segments", """
    SELECT project_id, count(DISTINCT CASE WHEN segment_id%2=0 THEN 'p' || speaker_profile_id ELSE 's' || speaker END) AS speakers
    FROM segments GROUP BY 1"""))
def speaker_count(spark, sf):
    s = tables.segments(spark, sf)
    return cat.speaker_count(s.withColumn("speaker_profile_id", F.when(
        F.col("segment_id") % 2 == 0, F.col("speaker_profile_id"))))


@query("speaker_options", sql("segments profiles", """
    SELECT NULL::BIGINT AS project_id, 'profile:' || profile_id AS value, name, name || ' · perfil local' AS label FROM profiles WHERE enabled
    UNION ALL SELECT project_id, 'speaker:' || n, n, n FROM (
      SELECT DISTINCT project_id, speaker AS n FROM segments WHERE segment_id%2=1
      UNION SELECT DISTINCT project_id, 'Hablante 1' FROM segments UNION SELECT DISTINCT project_id, 'Hablante 2' FROM segments)"""))
def speaker_options(spark, sf):
    s = tables.staged(spark, sf)
    s = s.withColumn("speaker_profile_id", F.when(F.col("segment_id") % 2 == 0, F.col("speaker_profile_id")))
    return cat.speaker_options(s, tables.voice_profiles(spark, sf)).select("project_id", "value", "name", "label")


FOLD = "replace(strip_accents(lower({c})),'ß','ss')"
CTES["dictionary"] = ((), rf"""
    SELECT owner, key, word, age FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY seen DESC) AS age FROM (
      SELECT owner, lower(nw) AS key, arg_max(nw, pt) AS word, min(pt) AS seen FROM (
        SELECT role AS owner, (conv_id*10+turn)*100000+i AS pt, o[i] AS od, n[i] AS nw FROM (
          SELECT *, unnest(range(1,len(o)+1)) AS i FROM (
            SELECT role, conv_id, turn, regexp_extract_all(text,'[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}''’-]*') AS o,
              regexp_extract_all(replace(replace(replace(text,'tion','TION'),'é','e'),'ou','oux '),'[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}''’-]*') AS n
            FROM conversations) WHERE len(o)=len(n)))
      WHERE {FOLD.format(c='od')}<>{FOLD.format(c='nw')} AND length(nw)>=2 GROUP BY 1,2)) WHERE age<=300""")


def corrections(spark, sf):
    """Case and accent changes everywhere, a changed spelling at word ends."""
    c = tables.read(spark, sf, "conversations")
    after = F.replace(F.replace(F.replace("text", F.lit("tion"), F.lit("TION")), F.lit("é"), F.lit("e")), F.lit("ou"), F.lit("oux "))
    return c.select(F.col("role").alias("owner"), (F.col("conv_id") * 10 + F.col("turn")).alias("seq"),
                    F.col("text").alias("before"), after.alias("after"))


@query("learn_dictionary", sql("dictionary", "SELECT * FROM dictionary"))
def learn_dictionary(spark, sf):
    return cat.learn_dictionary(corrections(spark, sf))


@query("vocabulary_prompt", sql("dictionary", """
    SELECT owner, 'Acme, ' || owner || ', CT' || CASE WHEN string_agg(word, ', ' ORDER BY age DESC) IS NULL THEN ''
      ELSE ', ' || string_agg(word, ', ' ORDER BY age DESC) END AS prompt
    FROM (SELECT DISTINCT role AS owner FROM conversations) LEFT JOIN dictionary USING (owner) GROUP BY owner"""))
def vocabulary_prompt(spark, sf):
    owners = tables.read(spark, sf, "conversations").select(F.col("role").alias("owner")).distinct()
    existing = owners.withColumn("terms", F.concat(F.lit("Acme; ;"), "owner", F.lit("\n CT ,Acme")))
    return cat.vocabulary_prompt(existing, cat.learn_dictionary(corrections(spark, sf)))


@query("stale_evidence", sql("samples", """
    WITH b AS (SELECT DISTINCT source_project AS project_id, profile_id FROM samples),
    n AS (SELECT DISTINCT source_project AS project_id, profile_id FROM samples WHERE confidence>=0.75 AND duration_ms>4000),
    r AS (SELECT source_project AS project_id FROM samples GROUP BY 1 HAVING min(confidence)<0.56)
    SELECT * FROM b WHERE (project_id, profile_id) NOT IN (SELECT (project_id, profile_id) FROM n)
      AND project_id IN (SELECT project_id FROM n) AND project_id NOT IN (SELECT project_id FROM r)"""))
def stale_evidence(spark, sf):
    v = tables.voice_samples(spark, sf).withColumnRenamed("source_project", "project_id")
    now = v.where((F.col("confidence") >= 0.75) & (F.col("duration_ms") > 4000))
    rejected = v.groupBy("project_id").agg(F.min("confidence").alias("m")).where(F.col("m") < 0.56)
    return cat.stale_evidence(v, now, rejected)


FILES = """SELECT 'rec/' || project_id || '.' || CASE project_id%6 WHEN 0 THEN 'WAV' WHEN 1 THEN 'mp4' WHEN 2 THEN 'txt' WHEN 3 THEN 'opus'
    WHEN 4 THEN 'mkv' ELSE 'pdf' END AS path FROM projects"""


def files(projects):
    p = F.col("project_id")
    ext = F.when(p % 6 == 0, "WAV").when(p % 6 == 1, "mp4").when(p % 6 == 2, "txt").when(p % 6 == 3, "opus").when(
        p % 6 == 4, "mkv").otherwise("pdf")
    return projects.select(F.concat(F.lit("rec/"), p, F.lit("."), ext).alias("path"))


@query("media_inventory", sql("projects", f"""
    SELECT path, CASE WHEN regexp_matches(path,'(WAV|opus)$') THEN 'audio' ELSE 'video' END AS kind,
      regexp_extract(path,'rec/([0-9]+)',1) AS display_name FROM ({FILES}) WHERE NOT regexp_matches(path,'(txt|pdf)$')"""))
def media_inventory(spark, sf):
    return media.media_inventory(files(tables.projects(spark, sf)))


@query("relocate_missing_media", sql("projects", """
    WITH f AS (SELECT 'New/' || project_id || '/' || upper(media_path) AS path, project_id FROM projects
               UNION ALL SELECT media_path, project_id FROM projects WHERE status='completed'),
    g AS (SELECT project_id, media_path FROM projects WHERE media_path NOT IN (SELECT path FROM f))
    SELECT project_id, media_path, candidate, rank FROM (SELECT g.project_id, g.media_path, f.path AS candidate,
        row_number() OVER (PARTITION BY g.project_id ORDER BY f.path) AS rank
      FROM g JOIN f ON lower(regexp_extract(f.path,'[^/]*$'))=lower(regexp_extract(g.media_path,'[^/]*$'))) WHERE rank<=5"""))
def relocate_missing_media(spark, sf):
    p = tables.projects(spark, sf, tables.staged(spark, sf))
    moved = p.select(F.concat(F.lit("New/"), "project_id", F.lit("/"), F.upper("media_path")).alias("path"))
    there = p.where(F.col("status") == "completed").select(F.col("media_path").alias("path"))
    return media.relocate_missing_media(p, moved.unionByName(there))
