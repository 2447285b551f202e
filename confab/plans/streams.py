"""Streaming queries, drained over the given tables, and their batch twins."""

from pyspark.sql import functions as F

from confab.operators.blocks import Scan, running
from confab.plans import voice
from confab.plans.registry import CTES, query, sql
from confab.plans.sequence import PARAGRAPHS, paragraphs, shown
from confab.session import cut, scratch_path
from confab.sources import tables
from confab.streaming import changes, closing, jobs, live, recording
from confab.streaming.runner import drain, drain_updates, in_batches, keyed_state, stream_of


def chunks(df):
    i = F.col("event_id")
    return df.select(F.col("user_id").alias("session_id"), i.alias("chunk_id"),
                     F.col("ts").cast("timestamp").alias("ts"), (800 + (i * 37) % 4000).alias("samples"),
                     (F.col("value") / 2000).alias("rms"))


CTES["chunks"] = ((), """
    SELECT user_id AS session_id, event_id AS chunk_id, ts, 800+(event_id*37)%4000 AS samples, value/2000 AS rms FROM events""")


@query("ingest_chunks", sql("chunks", """
    SELECT session_id, count(*) AS chunks, CAST(sum(samples) AS BIGINT) AS samples, CAST(round_even(sum(samples)/16,0) AS BIGINT) AS duration_ms
    FROM chunks GROUP BY 1"""))
def ingest_chunks(spark, sf):
    """Every chunk arrives twice."""
    c = chunks(stream_of(spark, sf, "events")).withColumn("try", F.explode(F.array(F.lit(1), F.lit(2)))).drop("try")
    return drain_updates(recording.ingest_chunks(c), ["session_id"])


@query("validate_chunks", """
    SELECT user_id AS session_id, event_id AS chunk_id, CASE WHEN event_id%11=1 THEN 'bad_id' WHEN event_id%11 IN (2,3) THEN 'bad_base64'
      WHEN event_id%11=4 OR length(props)%2=1 THEN 'bad_size' ELSE 'ok' END AS status FROM events""")
def validate_chunks(spark, sf):
    i = F.col("event_id")
    good = F.base64(F.encode("props", "UTF-8"))
    pcm = F.when(i % 11 == 2, F.concat(F.lit("#"), F.substring(good, 2, 10_000))).when(
        i % 11 == 3, F.concat(good, F.lit("A"))).when(i % 11 == 4, "").otherwise(good)
    c = stream_of(spark, sf, "events").select(
        F.col("user_id").alias("session_id"), F.when(i % 11 == 1, -i).otherwise(i).alias("chunk_id"), pcm.alias("pcm_base64"))
    out = drain(recording.validate_chunks(c))
    return out.select("session_id", F.abs("chunk_id").alias("chunk_id"), "status")


CTES["arrivals"] = ((), """
    SELECT user_id AS session_id, event_id AS chunk_id, event_id*1000-((event_id*7919)%13)*40000*((event_id%5=0)::INT) AS ts_ms, 800+(event_id*37)%4000 AS samples,
      CASE WHEN event_id%17=1 THEN 'bad_size' ELSE 'ok' END AS status, event_id*4+again*(SELECT count(*) FROM events)+again AS arrival
    FROM events, (SELECT unnest([0,1]) AS again) WHERE again=0 OR event_id%3=0""")
VERDICTS = """
    WITH n AS (SELECT *, max(CASE WHEN status='ok' THEN ts_ms END) OVER (PARTITION BY session_id ORDER BY arrival) AS newest FROM arrivals),
    l AS (SELECT *, CASE WHEN status<>'ok' THEN status WHEN ts_ms<newest-300000 THEN 'late' ELSE 'ok' END AS v FROM n),
    d AS (SELECT *, CASE WHEN v='ok' AND row_number() OVER (PARTITION BY session_id, chunk_id, v ORDER BY arrival)>1 THEN 'duplicate' ELSE v END AS verdict FROM l)
    SELECT session_id, arrival, chunk_id, verdict, verdict='duplicate' AS duplicate,
      CAST(round_even(sum(CASE WHEN verdict='ok' THEN samples ELSE 0 END) OVER (PARTITION BY session_id ORDER BY arrival)/16,0) AS BIGINT) AS duration_ms FROM d"""


def arrivals(spark, sf):
    """Every third chunk arrives again, much later; some chunks are old, some refused."""
    e = tables.read(spark, sf, "events").select("event_id", "user_id")
    n, i = e.count(), F.col("event_id")
    old = F.when(i % 5 == 0, (i * 7919) % 13 * 40_000).otherwise(0)
    again = e.withColumn("again", F.explode(F.array(F.lit(0), F.lit(1)))).where((F.col("again") == 0) | (i % 3 == 0))
    return n, again.select(
        F.col("user_id").alias("session_id"), i.alias("chunk_id"), (i * 1000 - old).alias("ts_ms"), (800 + (i * 37) % 4000).cast("long").alias("samples"),
        F.when(i % 17 == 1, "bad_size").otherwise("ok").alias("status"), (i * 4 + F.col("again") * n + F.col("again")).cast("long").alias("arrival"))


@query("ingest_verdicts", sql("arrivals", VERDICTS))
def ingest_verdicts(spark, sf):
    """One answer per chunk over six micro-batches, most repeats in a later one than their chunk."""
    n, a = arrivals(spark, sf)
    with keyed_state(spark):
        return drain(recording.chunk_verdicts(in_batches(a, F.least(F.lit(5), F.floor(F.col("arrival") * 6 / (5 * n))), 6, "arrivals"), 300_000, None))


@query("ingest_verdicts_batch", sql("arrivals", VERDICTS))
def ingest_verdicts_batch(spark, sf):
    return recording.chunk_verdicts_batch(arrivals(spark, sf)[1], 300_000)


GATE = """
    SELECT session_id, chunk_id, CAST(round_even((e-samples)/16,0) AS BIGINT) AS offset_ms, CAST(round_even(e/16,0) AS BIGINT) AS duration_ms
    FROM (SELECT *, CAST(sum(samples) OVER (PARTITION BY session_id ORDER BY chunk_id) AS BIGINT) AS e FROM chunks) WHERE rms>=0.0015"""


@query("silence_gate", sql("chunks", GATE))
def silence_gate(spark, sf):
    return drain(recording.silence_gate(chunks(stream_of(spark, sf, "events")), None))


@query("silence_gate_batch", sql("chunks", GATE))
def silence_gate_batch(spark, sf):
    c = chunks(tables.read(spark, sf, "events"))
    r = running(c, ["session_id"], F.floor(F.col("chunk_id") / 65_536), ["chunk_id"], [Scan("e", F.col("samples"), "sum")])
    ms = lambda c: F.bround(c / 16).cast("long")
    return r.where(F.col("rms") >= recording.SILENT_RMS).select(
        "session_id", "chunk_id", ms(F.col("e") - F.col("samples")).alias("offset_ms"), ms(F.col("e")).alias("duration_ms"))


PHRASES = """
    WITH RECURSIVE n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY chunk_id) AS rn FROM chunks),
    rec AS (
      SELECT session_id, rn, 0 AS n0, 0 AS start, samples AS c, 0 AS sil, rms>=0.012 AS heard, samples>=23200 AS flush FROM n WHERE rn=1
      UNION ALL
      SELECT session_id, rn, n0, start, c, sil, heard, (heard AND c>=12480 AND sil>=3840) OR c>=23200 FROM (
        SELECT n.session_id, n.rn, CASE WHEN r.flush THEN n0+1 ELSE n0 END AS n0, CASE WHEN r.flush THEN start+c ELSE start END AS start,
          CASE WHEN r.flush THEN n.samples ELSE c+n.samples END AS c,
          CASE WHEN n.rms>=0.012 THEN 0 WHEN r.heard AND NOT r.flush THEN sil+n.samples WHEN r.flush THEN 0 ELSE sil END AS sil,
          n.rms>=0.012 OR (r.heard AND NOT r.flush) AS heard
        FROM rec r JOIN n ON n.session_id=r.session_id AND n.rn=r.rn+1))
    SELECT session_id, n0 AS phrase, start AS start_sample, c AS samples FROM rec WHERE flush"""


@query("phrase_segments", sql("chunks", PHRASES))
def phrase_segments(spark, sf):
    return drain(recording.phrase_segments(chunks(stream_of(spark, sf, "events")), idle_ms=None))


@query("phrase_segments_batch", sql("chunks", PHRASES))
def phrase_segments_batch(spark, sf):
    return recording.phrase_segments_batch(chunks(tables.read(spark, sf, "events")))


def job_events(df):
    """Job messages; most optional fields are missing most of the time."""
    i, t = F.col("event_id"), F.col("event_type")
    now_and_then = lambda k, c: F.when(i % k == 0, c)
    return df.select(
        F.col("user_id").alias("project_id"), i.alias("seq"), t.alias("state"), (i * 10).alias("processed_ms"),
        (i * 20).alias("total_ms"), F.when(t == "error", "E1").alias("error_code"), F.when(t == "error", "failed").alias("error_message"),
        now_and_then(3, F.col("value")).alias("progress_percent"), now_and_then(5, t).alias("stage"),
        now_and_then(7, F.concat(F.lit("p"), i)).alias("phase"), now_and_then(11, F.concat(F.lit("m"), i)).alias("message"),
        now_and_then(13, F.lit("CPU")).alias("device"), now_and_then(17, F.concat(F.lit("v"), i % 3)).alias("active_model"),
        now_and_then(2, (F.col("value") * 3)).alias("speed_x"), now_and_then(19, i * 3).alias("eta_ms"))


def last_of(expr, cond):
    return f"arg_max({expr}, event_id) FILTER (WHERE {cond})"


JOB_STATE = f"""
    SELECT user_id AS project_id, arg_max(event_type, event_id) AS state, max(event_id)*10 AS processed_ms, max(event_id)*20 AS total_ms,
      CASE WHEN arg_max(event_type, event_id)='error' THEN 'E1' END AS error_code,
      CASE WHEN arg_max(event_type, event_id)='error' THEN 'failed' END AS error_message,
      {last_of('value', 'event_id%3=0')} AS progress_percent, {last_of('event_type', 'event_id%5=0')} AS stage,
      {last_of("'p' || event_id", 'event_id%7=0')} AS phase, {last_of("'m' || event_id", 'event_id%11=0')} AS message,
      {last_of("'CPU'", 'event_id%13=0')} AS device, {last_of("'v' || event_id%3", 'event_id%17=0')} AS active_model,
      {last_of('value*3', 'event_id%2=0')} AS speed_x, {last_of('event_id*3', 'event_id%19=0')} AS eta_ms
    FROM events GROUP BY 1"""


@query("job_state", JOB_STATE)
def job_state(spark, sf):
    return jobs.job_state(job_events(tables.read(spark, sf, "events")))


@query("job_state_stream", JOB_STATE)
def job_state_stream(spark, sf):
    return drain_updates(jobs.job_state(job_events(stream_of(spark, sf, "events"))), ["project_id"])


STAGE_OF = {"click": "decoding", "view": "transcribing", "signup": "reviewing", "purchase": "diarizing", "error": "saving"}
RATES = """
    WITH e AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'decoding' WHEN 'view' THEN 'transcribing' WHEN 'signup' THEN 'reviewing'
        WHEN 'purchase' THEN 'diarizing' ELSE 'saving' END AS stage, event_id*8 AS processed_ms, CASE WHEN event_id%10=0 THEN 0 ELSE event_id*9+64 END AS total_ms,
        event_id*2+16 AS elapsed_ms FROM events),
    f AS (SELECT *, CASE WHEN total_ms>0 THEN round_even(processed_ms/total_ms*100,1) END AS ph, processed_ms/greatest(1,elapsed_ms) AS sp,
        CASE stage WHEN 'decoding' THEN 0.0 WHEN 'transcribing' THEN 18.0 WHEN 'reviewing' THEN 88.0 WHEN 'diarizing' THEN 94.0 ELSE 99.5 END::DOUBLE AS lo,
        CASE stage WHEN 'decoding' THEN 10.0 WHEN 'transcribing' THEN 88.0 WHEN 'reviewing' THEN 94.0 WHEN 'diarizing' THEN 99.5 ELSE 99.9 END::DOUBLE AS hi FROM e)
    SELECT event_id, stage, ph AS phase_percent, round_even(CASE WHEN ph IS NULL THEN lo ELSE lo+(hi-lo)*greatest(0,least(100,ph))/100 END,2) AS percent,
      round_even(sp,2) AS speed_x, CASE WHEN sp>0 THEN CAST(round_even(greatest(0,total_ms-processed_ms)/sp,0) AS BIGINT) END AS eta_ms FROM f"""


def progress(df):
    i = F.col("event_id")
    stage = None
    for event, name in STAGE_OF.items():
        stage = F.when(F.col("event_type") == event, name) if stage is None else stage.when(F.col("event_type") == event, name)
    e = df.select("event_id", stage.alias("stage"), (i * 8).alias("processed_ms"),
                  F.when(i % 10 == 0, 0).otherwise(i * 9 + 64).alias("total_ms"), (i * 2 + 16).alias("elapsed_ms"))
    return jobs.progress_rates(e).select("event_id", "stage", "phase_percent", "percent", "speed_x", "eta_ms")


@query("progress_rates", RATES)
def progress_rates(spark, sf):
    return progress(tables.read(spark, sf, "events"))


@query("progress_rates_stream", RATES)
def progress_rates_stream(spark, sf):
    return drain(progress(stream_of(spark, sf, "events")))


TYPE_SQL = "CASE event_type WHEN 'click' THEN 'job_started' WHEN 'view' THEN 'partial_segments' WHEN 'error' THEN 'job_failed' ELSE event_type END"


@query("route_events", f"""
    SELECT event_id, {TYPE_SQL} AS type FROM events WHERE event_type NOT IN ('click','view','error') OR (user_id=42 AND event_id%3<>0)""")
def route_events(spark, sf):
    t = F.col("event_type")
    e = stream_of(spark, sf, "events").select(
        "event_id", F.when(t == "click", "job_started").when(t == "view", "partial_segments").when(t == "error", "job_failed")
        .otherwise(t).alias("type"), F.when(F.col("event_id") % 3 != 0, F.col("user_id")).alias("project_id"))
    return drain(jobs.route_events(e, 42)).select("event_id", "type")


@query("evidence_log", """
    SELECT user_id AS project_id, event_type, '{"event_id":' || event_id || ',"kind":"' || event_type || '"}' AS payload FROM events""")
def evidence_log(spark, sf):
    e = stream_of(spark, sf, "events").select(
        F.col("user_id").alias("project_id"), "event_type", "event_id", F.col("event_type").alias("kind"), F.col("ts").alias("created_at"))
    return drain(jobs.evidence_log(e, ["event_id", "kind"])).drop("created_at")


@query("read_protocol_log", """
    SELECT CASE WHEN event_id%13=1 THEN 'invalid_json' WHEN event_id%13 IN (2,3) THEN 'missing_request' ELSE 'ok' END AS status,
      CASE WHEN event_id%13=1 THEN NULL WHEN event_id%13=2 THEN '' ELSE 'r' || event_id END AS request_id,
      CASE WHEN event_id%13 NOT IN (1,3) THEN event_type END AS action,
      CASE WHEN event_id%13<>1 THEN '{"user":' || user_id || '}' END AS payload FROM events""")
def read_protocol_log(spark, sf):
    """Events written as JSON lines first, some of them broken, then read back as a stream of text."""
    i = F.col("event_id")
    line = F.to_json(F.struct(
        F.when(i % 13 == 2, " ").otherwise(F.concat(F.lit("r"), i)).alias("requestId"),
        F.when(i % 13 != 3, F.col("event_type")).alias("action"), F.struct(F.col("user_id").alias("user")).alias("payload")))
    path = scratch_path(spark, "protocol")
    tables.read(spark, sf, "events").select(
        F.when(i % 13 == 1, F.concat(line, F.lit("}"))).otherwise(line).alias("value")).write.text(path)
    return drain(jobs.read_protocol_log(spark.readStream.text(path))).drop("rejected")


def live_units(df):
    return df.select(F.col("source_project").alias("session_id"), F.col("sample_id").alias("unit_id"), "duration_ms", "embedding")


@query("online_identify")
def online_identify(spark, sf):
    v = cut(tables.voice_samples(spark, sf), "live")
    path = v.inputFiles()[0].rsplit("/", 1)[0]
    s = spark.readStream.schema(v.schema).option("maxFilesPerTrigger", 64).parquet(path)
    return drain(live.online_identify(live_units(s), tables.voice_profiles(spark, sf), idle_ms=None))


@query("online_identify_batch")
def online_identify_batch(spark, sf):
    return live.online_identify_batch(live_units(tables.voice_samples(spark, sf)), tables.voice_profiles(spark, sf))


@query("relabel_provisional")
def relabel_provisional(spark, sf):
    u = live_units(tables.voice_samples(spark, sf))
    return live.relabelled(live.online_identify_batch(u, tables.voice_profiles(spark, sf)))


@query("relabel_stream")
def relabel_stream(spark, sf):
    """The rows of ``relabel_provisional`` from a stream: units come in five micro-batches, late names re-emit earlier units."""
    u = cut(live_units(tables.voice_samples(spark, sf)), "live")
    part = F.least(F.lit(4), F.floor(F.col("unit_id") * 5 / (u.agg(F.max("unit_id")).first()[0] + 1)))
    path = scratch_path(spark, "names")
    changes.write_names(live.online_identify(in_batches(u, part, 5, "units"), tables.voice_profiles(spark, sf), idle_ms=None), f"{path}/table", f"{path}/state")
    return changes.named_units(spark, f"{path}/table")


@query("close_session", sql("ordered words", PARAGRAPHS.replace("42000", "35000").replace("620", "520")))
def close_session(spark, sf):
    """Paragraphs of a finished live session use tighter limits; voices are voted on separately."""
    return shown(paragraphs(spark, sf, max_ms=35_000, max_chars=520))


LIVE_WORDS = 17  # recordings that the voice samples come from
BEGIN = 1_700_000_000_000  # Spark takes event times before 1970 as late


def live_segments(spark, sf):
    """Conversations as sessions whose speakers are voice clusters 0, 1 and 2."""
    s = tables.staged(spark, sf)
    return s.where(F.col("project_id") < LIVE_WORDS).withColumn("speaker_cluster", F.col("speaker_profile_id") % 3).withColumnRenamed("project_id", "session_id")


@query("closed_sessions", sql("segments", """
    SELECT project_id AS session_id, max(1700000000000+project_id*3600000+start_ms) AS last_ms, count(*) AS chunks FROM segments GROUP BY 1
    HAVING max(1700000000000+project_id*3600000+start_ms)+600000 <= (SELECT max(1700000000000+project_id*3600000+start_ms) FROM segments)"""))
def closed_sessions(spark, sf):
    """Conversations begin an hour apart; a session closes ten minutes after its last segment."""
    s = tables.staged(spark, sf).select(F.col("project_id").alias("session_id"), (BEGIN + F.col("project_id") * 3_600_000 + F.col("start_ms")).alias("ts_ms"))
    hours = s.agg(F.max("session_id")).first()[0] + 1
    with keyed_state(spark):
        return drain(recording.closed_sessions(in_batches(s, F.floor(F.col("session_id") * 5 / hours), 5, "moments"), 600_000))


@query("close_live_sessions")
def close_live_sessions(spark, sf):
    """Reports of sessions as they close: paragraphs named by the votes on their voice samples."""
    s = cut(live_segments(spark, sf), "live-segments")
    moments = s.select("session_id", (BEGIN + F.col("session_id") * 3_600_000 + F.col("start_ms")).alias("ts_ms"))
    end = spark.createDataFrame([(LIVE_WORDS, BEGIN + LIVE_WORDS * 3_600_000)], "session_id long, ts_ms long")
    path = scratch_path(spark, "closings")
    with keyed_state(spark):
        closed = recording.closed_sessions(in_batches(moments.unionByName(end), F.floor(F.col("session_id") / 4), 5, "moments"), 600_000)
        closing.write_closings(closed, s, voice.live(spark, sf), f"{path}/table", f"{path}/state")
    return closing.closings(spark, f"{path}/table")
