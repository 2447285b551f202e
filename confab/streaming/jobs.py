"""Job events: protocol log, routing, latest state, progress and the evidence log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Events that belong to one project.
PROJECT_EVENTS = ("job_started", "model_download_progress", "audio_extraction_progress", "transcription_progress",
                  "partial_segments", "job_paused", "job_completed", "job_cancelled", "job_failed")
# Share of the whole job, in percent, that each stage covers.
STAGES = {"decoding": (0.0, 10.0), "restoring": (10.0, 15.0), "language_detection": (15.0, 18.0), "transcribing": (18.0, 88.0),
          "reviewing": (88.0, 94.0), "diarizing": (94.0, 99.5), "saving": (99.5, 99.9)}
OVERWRITE = ("state", "processed_ms", "total_ms", "error_code", "error_message")
KEEP_LAST = ("progress_percent", "stage", "phase", "message", "device", "active_model", "speed_x", "eta_ms")


def read_protocol_log(lines: DataFrame) -> DataFrame:
    """Parse JSON lines (column ``value``); bad ones keep their text and say why."""
    # inside brackets the whole line must be one value: text after it makes the array invalid
    v = F.try_parse_json(F.concat(F.lit("["), "value", F.lit("]")))
    v = F.when(F.try_variant_get(v, "$[1]", "variant").isNull(), v)
    text = lambda p: F.trim(F.try_variant_get(v, p, "string"))
    request, action = text("$[0].requestId"), text("$[0].action")
    blank = (F.coalesce(request, F.lit("")) == "") | (F.coalesce(action, F.lit("")) == "")
    status = F.when(v.isNull(), "invalid_json").when(blank, "missing_request").otherwise("ok")
    return lines.select(
        status.alias("status"), request.alias("request_id"), action.alias("action"),
        F.to_json(F.try_variant_get(v, "$[0].payload", "variant")).alias("payload"),
        F.when(status != "ok", F.col("value")).alias("rejected"))


def route_events(events: DataFrame, project_id: int) -> DataFrame:
    """Project events pass only for the given project; all other types pass."""
    mine = F.coalesce(F.col("project_id") == project_id, F.lit(False))
    return events.where(~F.col("type").isin(*PROJECT_EVENTS) | mine)


def job_state(events: DataFrame) -> DataFrame:
    """Latest job row per project: five fields are overwritten, eight keep their last known value.

    Plain aggregates with ``seq`` as order, so the same plan serves a table and an update stream.
    """
    whole = F.max_by(F.struct(*OVERWRITE), "seq")
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in KEEP_LAST]
    out = events.groupBy("project_id").agg(whole.alias("w"), *last)
    return out.select("project_id", *[F.col(f"w.{c}").alias(c) for c in OVERWRITE], *KEEP_LAST)


def global_percent(stage: Column, phase_percent: Column) -> Column:
    out = None
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(100.0), phase_percent))
    for name, (lo, hi) in STAGES.items():
        value = F.when(phase_percent.isNull(), F.lit(lo)).otherwise(F.bround(lo + (hi - lo) * bounded / 100, 2))
        out = F.when(stage == name, value) if out is None else out.when(stage == name, value)
    return out


def progress_rates(events: DataFrame) -> DataFrame:
    """Speed, remaining time and end-to-end percent of progress events."""
    speed = F.col("processed_ms") / F.greatest(F.lit(1), "elapsed_ms")
    phase = F.when(F.col("total_ms") > 0, F.bround(F.col("processed_ms") / F.col("total_ms") * 100, 1))
    left = F.greatest(F.lit(0), F.col("total_ms") - F.col("processed_ms"))
    return events.select(
        "*", phase.alias("phase_percent"), global_percent(F.col("stage"), phase).alias("percent"),
        F.bround(speed, 2).alias("speed_x"), F.when(speed > 0, F.bround(left / speed).cast("long")).alias("eta_ms"))


def evidence_log(actions: DataFrame, payload: list[str]) -> DataFrame:
    """Append-only evidence rows with the named columns as JSON payload."""
    return actions.select("project_id", "event_type", F.to_json(F.struct(*payload)).alias("payload"), "created_at")
