"""Joins on recording time: overlap, point in interval, following, nearest, range union."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from confab.operators.blocks import Scan, running, time_block
from confab.session import cut

BUCKET_MS = 30_000


def overlaps(left: DataFrame, right: DataFrame, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Pairs of overlapping intervals of one project.

    Both sides are spread over the time buckets they touch and joined on (project, bucket); a
    pair is kept in the later of the two first buckets only, so no de-duplication is needed.
    ``left`` has project_id, l_start, l_end; ``right`` has project_id, r_start, r_end.
    """
    def spread(df, start, end, first):
        lo = F.floor(F.col(start) / bucket_ms)
        hi = F.floor((F.greatest(F.col(end), F.col(start) + 1) - 1) / bucket_ms)
        return df.withColumn(first, lo).withColumn("bucket", F.explode(F.sequence(lo, hi)))

    both = spread(left, "l_start", "l_end", "l_first").join(
        spread(right, "r_start", "r_end", "r_first"), ["project_id", "bucket"])
    overlap = F.least("l_end", "r_end") - F.greatest("l_start", "r_start")
    return both.where(F.col("bucket") == F.greatest("l_first", "r_first")).withColumn(
        "overlap", overlap).where(F.col("overlap") > 0).drop("bucket", "l_first", "r_first")


def transfer_speakers(segments: DataFrame, units: DataFrame) -> DataFrame:
    """Copy the speaker evidence of the best-overlapping group of units; text stays as it is.

    The earlier unit wins ties, then the smaller id (ids of any type).
    """
    voice = ["speaker", "speaker_confidence", "speaker_profile_id", "speaker_match_confidence", "cluster"]
    voice += [c for c in ("speaker_provisional", "speaker_cluster_index") if c in units.columns]
    left = segments.select("project_id", "segment_id", F.col("start_ms").alias("l_start"),
                           F.col("end_ms").alias("l_end"))
    right = units.select("project_id", "unit_id", F.col("start_ms").alias("r_start"),
                         F.col("end_ms").alias("r_end"), *[F.col(v).alias(f"new_{v}") for v in voice])
    pairs = overlaps(left, right)
    new = [f"new_{v}" for v in voice]
    group = ["project_id", "segment_id", "new_speaker", "new_speaker_profile_id", "new_cluster"]
    weight = F.col("overlap") * F.coalesce("new_speaker_confidence", F.lit(0.0))
    first = F.struct("r_start", "unit_id")
    votes = pairs.groupBy(*group).agg(
        F.sum("overlap").alias("total"), F.round(F.sum(weight), 6).alias("weight"),
        F.min(first).alias("first"),
        F.min_by(F.struct(*new), F.struct((-F.col("overlap")).alias("o"), first.alias("f"))).alias("unit"))
    best = votes.groupBy("project_id", "segment_id").agg(
        F.min_by("unit", F.struct((-F.col("total")).alias("t"), (-F.col("weight")).alias("w"), "first")).alias("unit"))
    joined = segments.join(best, ["project_id", "segment_id"], "left")
    hit = F.col("unit").isNotNull()
    changed = F.lit(False)
    for v in voice[:4]:
        changed = changed | ~F.col(v).eqNullSafe(F.col(f"unit.new_{v}"))
    keep = [c for c in segments.columns if c not in voice and c != "speaker_review_state"]
    return joined.select(
        *keep, F.when(hit & changed, F.lit(None)).otherwise(F.col("speaker_review_state")).alias("speaker_review_state"),
        *[F.when(hit, F.col(f"unit.new_{v}")).otherwise(F.col(v) if v in segments.columns else F.lit(None)).alias(v)
          for v in voice])


def locate_positions(positions: DataFrame, segments: DataFrame) -> DataFrame:
    """For every (project_id, marker_id, time_ms): active, followed and nearest segment.

    One union of both sides in time order carries the previous and the next segment to each
    point; segments starting at the same moment count once (the first listed).
    """
    first = segments.groupBy("project_id", "start_ms").agg(
        F.min_by(F.struct("segment_id", "start_ms", "end_ms"), "segment_order").alias("seg"))
    none = F.lit(None)
    a = first.select("project_id", F.col("start_ms").alias("t"), F.lit(0).alias("kind"), "seg",
                     none.cast("long").alias("marker_id"))
    b = positions.select("project_id", F.col("time_ms").alias("t"), F.lit(1).alias("kind"),
                         none.cast(first.schema["seg"].dataType).alias("seg"), "marker_id")
    seen = running(a.unionByName(b), ["project_id"], time_block("t"), ["t", "kind"],
                   [Scan("prev", F.col("seg"), "last"), Scan("next", F.col("seg"), "next")])
    p, n, t = F.col("prev"), F.col("next"), F.col("t")
    active = F.when(t < p["end_ms"], p["segment_id"])
    closer = F.when(p.isNull() | (n["start_ms"] - t < t - p["start_ms"]), n["segment_id"])
    return seen.where(F.col("kind") == 1).select(
        "project_id", "marker_id", t.alias("time_ms"), active.alias("active"),
        F.coalesce(active, n["segment_id"], p["segment_id"]).alias("follow"),
        F.coalesce(closer, p["segment_id"]).alias("nearest"))


def merge_ranges(ranges: DataFrame) -> DataFrame:
    """Union of (project_id, start_ms, end_ms) ranges; touching ranges merge, empty ones vanish."""
    r = ranges.where(F.col("end_ms") > F.col("start_ms")).select("project_id", "start_ms", "end_ms")
    order = ["start_ms", "end_ms"]
    r = running(r, ["project_id"], time_block(), order, [Scan("reach", F.col("end_ms"), "max", inclusive=False)])
    opens = F.when(F.col("reach").isNull() | (F.col("start_ms") > F.col("reach")), 1).otherwise(0)
    r = cut(r.select("project_id", *order, opens.alias("opens")), "ranges")  # read twice below
    r = running(r, ["project_id"], time_block(), order,
                [Scan("island", F.col("opens"), "sum")])
    return r.groupBy("project_id", "island").agg(
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).drop("island")


def complement_ranges(merged: DataFrame, durations: DataFrame, shortest: int = 40) -> DataFrame:
    """What is left of each project's [0, duration) once the merged ranges are cut out."""
    merged = cut(merged, "merged")
    held = running(merged, ["project_id"], time_block(), ["start_ms"],
                   [Scan("cursor", F.col("end_ms"), "last", inclusive=False)])
    before = held.select("project_id", F.coalesce("cursor", F.lit(0)).alias("s"), F.col("start_ms").alias("e"))
    last = merged.groupBy("project_id").agg(F.max("end_ms").alias("cursor"))
    after = durations.join(last, "project_id", "left").select(
        "project_id", F.coalesce("cursor", F.lit(0)).alias("s"), F.col("duration_ms").alias("e"))
    return before.unionByName(after).where(F.col("e") - F.col("s") >= shortest).select(
        "project_id", F.col("s").alias("start_ms"), F.col("e").alias("end_ms"))


def edit_plan_report(excluded: DataFrame, durations: DataFrame) -> DataFrame:
    """Removed ranges, remaining time and whether a project would be emptied by the cut."""
    clipped = excluded.join(durations, "project_id").select(
        "project_id", F.greatest(F.lit(0), "start_ms").alias("start_ms"),
        F.least("duration_ms", "end_ms").alias("end_ms"))
    kept = complement_ranges(merge_ranges(clipped), durations).groupBy("project_id").agg(
        F.sum(F.col("end_ms") - F.col("start_ms")).alias("remaining_ms"))
    removed = excluded.groupBy("project_id").agg(F.count(F.lit(1)).alias("removed"))
    return durations.join(removed, "project_id", "left").join(kept, "project_id", "left").select(
        "project_id", F.coalesce("removed", F.lit(0)).alias("removed"),
        F.coalesce("remaining_ms", F.lit(0)).alias("remaining_ms"),
        F.when(F.col("remaining_ms").isNull(), "nothing_left").otherwise("ok").alias("state"))
