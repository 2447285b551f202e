"""Voice memory: choosing, checking, learning and maintaining profile evidence."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from confab.functions.vectors import clip, dot, norm, unit
from confab.operators.blocks import numbered, time_block
from confab.operators.groups import matrix, per_group
from confab.operators.matching import top_profiles
from confab.operators.sequence import free_generic_names
from confab.session import cut

OBSERVATION_CAP = 24
PROFILE_CAP = 160
LIVE_CAP = 48
SHORTEST_MS = 1_300
TWO_SAMPLE_COHERENCE = 0.90
LEADERS = 4_096
PIVOTS, PAIR_BLOCK = 8, 1_024  # vectors from which angles are taken; profiles of a block
OBS = ["project_id", "cluster"]


# --- choosing samples ------------------------------------------------------------------------

def gate_samples(samples: DataFrame, min_confidence: float, width: int) -> DataFrame:
    """Add reject_reason (NULL = usable) and the unit vector of every sample."""
    e = F.col("embedding")
    bad = e.isNull() | (F.size(e) != width) | F.exists(e, lambda x: x.isNull() | F.isnan(x) | (
        F.abs(x) == float("inf"))) | (norm(e) < 1e-8)
    limit = max(0.6, min(0.92, min_confidence))
    reason = (F.when(bad, "invalidEmbedding")
              .when(F.coalesce("confidence", F.lit(0.0)) < limit, "lowConfidence")
              .when(~F.coalesce("learning_eligible", F.lit(True)), "paddedContext")
              .when(~F.coalesce("duration_ms", F.lit(0)).between(650, 8_000), "durationOutsideRange"))
    return samples.withColumn("reject_reason", reason).withColumn("embedding", F.when(~bad, unit(e)))


def temporally_diverse(samples: DataFrame, keys: list[str], limit: int = OBSERVATION_CAP) -> DataFrame:
    """At most ``limit`` samples per key, the best of each of ``limit`` stretches of time."""
    r = numbered(samples, keys, time_block(), ["start_ms", "sample_id"])
    n = samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    stretch = F.when(F.col("n") > limit, F.floor((F.col("rn") * limit - 1) / F.col("n"))).otherwise(F.col("rn"))
    cols = samples.columns
    best = F.max_by(F.struct(*cols), F.struct("confidence", F.least(F.col("duration_ms"), F.lit(6_000)), -F.col("rn")))
    return r.join(n, keys).withColumn("stretch", stretch).groupBy(*keys, "stretch").agg(best.alias("s")).select("s.*")


def dedupe_samples(samples: DataFrame) -> DataFrame:
    """One sample per (profile, project, segment), the most certain, then newest; unkeyed rows stay."""
    keyed = F.col("source_project").isNotNull() & F.col("source_segment").isNotNull()
    cols = samples.columns
    best = samples.where(keyed).groupBy("profile_id", "source_project", "source_segment").agg(F.max_by(
        F.struct(*cols), F.struct("confidence", "created_at", "sample_id")).alias("s")).select("s.*")
    return best.unionByName(samples.where(~keyed))


def round_robin_cap(samples: DataFrame, cap: int = PROFILE_CAP) -> DataFrame:
    """At most ``cap`` samples per profile, taken from its projects in turn, best first."""
    project = F.coalesce(F.col("source_project").cast("string"), F.lit("__none__"))
    inner = W.partitionBy("profile_id", "p").orderBy(
        F.desc("confidence"), F.desc(F.least(F.col("duration_ms"), F.lit(6_000))), F.desc("created_at"), F.desc("sample_id"))
    outer = W.partitionBy("profile_id").orderBy("turn", "p")
    # a project can give at most ``cap`` rows, so both windows are limited before their shuffles
    turned = samples.withColumn("p", project).withColumn("turn", F.row_number().over(inner)).where(F.col("turn") <= cap)
    return turned.withColumn("r", F.row_number().over(outer)).where(F.col("r") <= cap).drop("p", "turn", "r")


def sample_quality() -> Column:
    conf = F.coalesce("confidence", F.lit(0.0))
    match = F.coalesce(F.when(F.col("match_confidence") != 0, F.col("match_confidence")), conf)
    return match * 0.62 + conf * 0.28 + F.least(F.lit(1.0), F.coalesce("duration_ms", F.lit(0)) / 4_000) * 0.10


def best_per_bucket(observations: DataFrame, bucket_ms: int = 15_000) -> DataFrame:
    """Best live sample per (session, cluster, 15 s), earlier sample on ties."""
    o = observations.withColumn("bucket", F.floor(F.col("start_ms") / bucket_ms)).withColumn("quality", sample_quality())
    row = F.struct(*observations.columns, "bucket", "quality")
    return o.groupBy("session_id", "cluster", "bucket").agg(F.max_by(row, F.struct(
        "quality", -F.col("start_ms"), -F.col("sample_id"))).alias("s")).select("s.*")


def bounded_evidence(observations: DataFrame, cap: int = LIVE_CAP) -> DataFrame:
    """At most ``cap`` samples per cluster, each the nearest one left to an evenly spaced moment.

    The choice is made once over the whole recording.  A moment can only take one of the ``cap``
    samples nearest to it on either side, so those of every gap between two moments are enough:
    the choice sees a bounded number of rows and still gives the result of all of them.
    """
    key = ["session_id", "cluster"]
    best = cut(best_per_bucket(observations), "buckets")
    span = best.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("start_ms").alias("lo"), F.max("start_ms").alias("hi"))
    b = best.join(span, key)
    few = b.where(F.col("n") <= cap).select(*best.columns)
    step = (F.col("hi") - F.col("lo")) / (cap - 1)
    b = b.where(F.col("n") > cap).withColumn("cell", F.floor((F.col("start_ms") - F.col("lo")) / step))
    cell = W.partitionBy(*key, "cell")
    left = b.withColumn("r", F.row_number().over(cell.orderBy("start_ms", "sample_id"))).where(F.col("r") <= cap)
    right = b.withColumn("r", F.row_number().over(cell.orderBy(F.desc("start_ms"), "sample_id"))).where(F.col("r") <= cap)
    near = left.drop("r").unionByName(right.drop("r")).dropDuplicates([*key, "sample_id"])

    def choose(g):
        at, quality = g["start_ms"].to_numpy(float), g["quality"].to_numpy(float)
        free = np.ones(len(g), dtype=bool)
        picked = []
        for moment in np.linspace(g["lo"].iloc[0], g["hi"].iloc[0], cap):
            i = np.lexsort((at, -quality, np.where(free, np.abs(at - moment), np.inf)))[0]
            free[i] = False
            picked.append({"sample_id": int(g["sample_id"].iloc[i])})
        return picked

    ids = per_group(near.select(*key, "sample_id", "start_ms", "quality", "lo", "hi"), key, ["start_ms", "sample_id"],
                    choose, "sample_id long")
    return few.unionByName(best.join(ids, [*key, "sample_id"]).select(*best.columns))


# --- centroids -------------------------------------------------------------------------------

def _weights(g: pd.DataFrame) -> np.ndarray:
    return np.maximum(g["confidence"].to_numpy(float), 0.01) * np.clip(g["duration_ms"].to_numpy(float) / 1_000, 0.65, 6.0)


def _medoid(x: np.ndarray) -> np.ndarray:
    """Similarities to the sample that is closest to the others."""
    s = np.clip(x @ x.T, -1.0, 1.0)
    return s[int(np.argmax(np.round(np.median(s, axis=1), 12)))]  # equal up to rounding: the first


def _unit_mean(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    c = np.average(x, axis=0, weights=w)
    return c / max(float(np.linalg.norm(c)), 1e-8)


def robust_centroid(samples: DataFrame, keys: list[str], cap: int = OBSERVATION_CAP) -> DataFrame:
    """Per key: centroid of the coherent samples, their ids, the number given and the coherence.

    The samples come from :func:`temporally_diverse`, which limits a key to ``cap`` of them.
    """
    def one(g):
        if len(g) > cap:
            raise ValueError(f"more than {cap} samples in a group: choose them first")
        x = matrix(g["embedding"])
        near = _medoid(x)
        middle = float(np.median(near))
        mad = float(np.median(np.abs(near - middle)))
        keep = near >= max(0.45, middle - max(0.08, 2.5 * mad))
        if not keep.any():
            return [{"centroid": None, "kept": [], "given": len(g), "coherence": 0.0, "kept_ms": 0}]
        c = _unit_mean(x[keep], _weights(g)[keep])
        return [{"centroid": c.tolist(), "kept": g["sample_id"].to_numpy()[keep].tolist(), "given": len(g),
                 "coherence": float(np.median(np.clip(x[keep] @ c, -1, 1))),
                 "kept_ms": int(g["duration_ms"].to_numpy()[keep].sum())}]

    need = [*keys, "start_ms", "sample_id", "embedding", "confidence", "duration_ms"]
    return per_group(samples.select(*dict.fromkeys(need)), keys, ["start_ms", "sample_id"], one,
                     "centroid array<double>, kept array<long>, given long, coherence double, kept_ms long")


def profile_centroid(samples: DataFrame) -> DataFrame:
    """Profile memory: duplicates out, 160 samples in turn by project, soft-weighted centroid."""
    kept = round_robin_cap(dedupe_samples(samples))

    def one(g):
        x = matrix(g["embedding"])
        w = _weights(g) * np.square(np.clip((_medoid(x) - 0.25) / 0.75, 0.05, 1.0))
        return [{"centroid": _unit_mean(x, w).tolist(), "sample_count": len(g),
                 "total_duration_ms": int(g["duration_ms"].sum())}]

    return per_group(kept.select("profile_id", "sample_id", "embedding", "confidence", "duration_ms"), ["profile_id"],
                     ["sample_id"], one, "centroid array<double>, sample_count long, total_duration_ms long")


# --- learning --------------------------------------------------------------------------------

def gate_observations(observations: DataFrame, samples: DataFrame, profiles: DataFrame) -> DataFrame:
    """Add reject_reason and the robust centroid to (project_id, cluster) observations.

    ``samples`` are usable (gated) ones; they are limited to 24 per observation here.
    """
    chosen = cut(temporally_diverse(samples, OBS), "chosen")
    clear = chosen.groupBy(*OBS).agg(F.sum("duration_ms").alias("clear_ms"), F.count(F.lit(1)).alias("selected"))
    known = profiles.select(F.col("profile_id").alias("matched_profile_id"), "enabled", F.lit(True).alias("found"))
    robust = robust_centroid(chosen, OBS)
    o = observations.join(clear, OBS, "left").join(known, "matched_profile_id", "left").join(robust, OBS, "left")
    few = (F.coalesce("kept_ms", F.lit(0)) < SHORTEST_MS) | ((F.size("kept") >= 3) & (F.col("coherence") < 0.42))
    reason = (F.when(F.coalesce("clear_ms", F.lit(0)) < SHORTEST_MS, "insufficientClearAudio")
              .when(F.col("matched_profile_id").isNotNull() & F.col("found").isNull(), "profileNotFound")
              .when(~F.coalesce("enabled", F.lit(True)), "profilePaused")
              .when(F.col("centroid").isNull() | few, "insufficientClearAudio"))
    return o.withColumn("reject_reason", reason).drop("enabled", "found")


def resolve_profile(gated: DataFrame, samples: DataFrame, profiles: DataFrame) -> DataFrame:
    """Decide the profile of every accepted observation, or that none fits yet.

    status: matched, residual (may open a profile), or the reason of rejection.  For matched
    observations ``kept`` holds the samples to learn.
    """
    ok = cut(gated.where(F.col("reject_reason").isNull()), "gated")
    free = top_profiles(ok.where(F.col("matched_profile_id").isNull()), profiles, "centroid")
    thr = profiles.select(F.col("profile_id").alias("target"), F.col("match_threshold").alias("threshold"),
                          unit("centroid").alias("profile_vector"))
    free = free.withColumn("target", F.col("best_profile")).join(thr.drop("profile_vector"), "target", "left")
    need = F.greatest(F.least(F.lit(0.90), F.col("threshold") + 0.015), F.when(F.col("n_profiles") == 1, 0.72).otherwise(0.70))
    hit = F.coalesce((F.col("score") >= need) & (F.col("margin") >= 0.035), F.lit(False))
    base = [*OBS, "match_confidence", "centroid", "kept", "coherence"]
    residual = free.where(~hit).select(*base, F.lit(None).cast("long").alias("profile_id"), F.lit("residual").alias("status"),
                                       "score", "runner_up")
    targeted = free.where(hit).select(*base, "target").unionByName(
        ok.where(F.col("matched_profile_id").isNotNull()).select(*base, F.col("matched_profile_id").alias("target")))
    targeted = targeted.join(thr, "target")
    floor = F.greatest(F.lit(0.52), F.least(F.lit(0.90), F.col("threshold") + 0.015) - 0.03)
    s = targeted.select(*OBS, "profile_vector", floor.alias("floor"), F.explode("kept").alias("sample_id")).join(
        samples, [*OBS, "sample_id"])
    near = s.where(F.col("profile_vector").isNull() | (
        clip(dot("embedding", "profile_vector"), -1.0, 1.0) >= F.col("floor"))).drop("profile_vector", "floor")
    again = robust_centroid(near, OBS).select(
        *OBS, F.col("centroid").alias("c2"), F.col("kept").alias("k2"), F.col("coherence").alias("h2"), "kept_ms")
    m = targeted.join(again, OBS, "left")
    few = F.col("c2").isNull() | (F.coalesce("kept_ms", F.lit(0)) < SHORTEST_MS) | (
        (F.size("k2") >= 3) & (F.col("h2") < 0.42))
    own = clip(dot("c2", "profile_vector"), -1.0, 1.0)
    effective = F.least("match_confidence", own)  # least() skips a missing side
    required = F.least(F.lit(0.90), F.col("threshold") + 0.015)
    status = (F.when(few, "insufficientClearAudio")
              .when(effective.isNull() | (effective < required), "weakProfileMatch").otherwise("matched"))
    done = m.select(*OBS, effective.alias("match_confidence"), F.col("c2").alias("centroid"), F.col("k2").alias("kept"),
                    F.col("h2").alias("coherence"), F.when(status == "matched", F.col("target")).alias("profile_id"),
                    status.alias("status"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("double").alias("runner_up"))
    return done.unionByName(residual)


def new_profiles(residual: DataFrame, first_id: int = 1, threshold: float = 0.64, block: int = LEADERS) -> DataFrame:
    """Open profiles for observations no known voice fits; returns them with profile_id and opened.

    Observations are handled in (project_id, cluster) order as a sequence would: a later one joins the profile opened
    earlier that it fits, else opens its own; the profile vector is the opener's.  A round settles the next ``block``
    observations.  All later ones are then scored against the profiles opened in it, in one distributed pass, and carry
    their best and second best with them; so when their turn comes they have met every profile opened before them, and the
    answer does not depend on ``block``.
    """
    lone = (F.size("kept") == 2) & (F.col("coherence") < TWO_SAMPLE_COHERENCE)
    none = F.lit(None)
    rest = cut(residual.where(~lone).select(
        *OBS, "centroid", F.col("score").alias("known_best"), F.col("runner_up").alias("known_second"),
        none.cast("long").alias("own_id"), none.cast("double").alias("own_best"), none.cast("double").alias("own_second")), "residual")
    schema = "project_id long, cluster long, centroid array<double>, profile_id long, opened boolean"
    settled, next_id = None, first_id
    strict = min(0.90, threshold + 0.015)

    def settle(start: int):
        def run(batches):
            openers, n = None, 0
            for pdf in batches:
                vectors, ids, opened = matrix(pdf["centroid"]), [], []
                if openers is None:
                    openers = np.zeros((block, vectors.shape[1]))
                met = pdf[["known_best", "known_second", "own_best", "own_second"]].to_numpy(np.float64)
                for v, row, own in zip(vectors, met, pdf["own_id"]):
                    here = openers[:n] @ v
                    near = here.max() if n else -np.inf
                    earlier = not np.isnan(row[2]) and row[2] >= near
                    score = row[2] if earlier else near
                    others = np.concatenate([row[[0, 1, 3]] if earlier else row, here if earlier else np.delete(here, here.argmax()) if n else here])
                    others = others[~np.isnan(others)]
                    need = max(strict, 0.70 if len(others) else 0.72)
                    if score >= need and (not len(others) or score - others.max() >= 0.035):
                        ids.append(int(own) if earlier else start + int(here.argmax()))
                        opened.append(False)
                    else:
                        openers[n] = v
                        ids.append(start + n)
                        opened.append(True)
                        n += 1
                yield pdf.assign(profile_id=ids, opened=opened)[["project_id", "cluster", "centroid", "profile_id", "opened"]]

        return run

    while not rest.isEmpty():
        lead = rest.orderBy(*OBS).limit(block).coalesce(1).sortWithinPartitions(*OBS)
        lead = cut(lead.mapInPandas(settle(next_id), schema), "leaders")
        opened = lead.where("opened").select("profile_id", F.lit("").alias("name"), "centroid",
                                             F.lit(threshold).alias("match_threshold"), F.lit(True).alias("enabled"))
        settled = lead if settled is None else settled.unionByName(lead)
        next_id += lead.where("opened").count()
        later = top_profiles(rest.join(lead, OBS, "left_anti"), opened, "centroid")
        better = F.col("own_best").isNull() | (F.col("score") > F.col("own_best"))
        two = F.sort_array(F.filter(F.array("own_best", "own_second", "score", "runner_up"), lambda s: s.isNotNull()), asc=False)
        rest = cut(later.select(*OBS, "centroid", "known_best", "known_second", F.when(better, F.coalesce("best_profile", "own_id")).otherwise(F.col("own_id")).alias("own_id"),
                                F.get(two, F.lit(0)).alias("own_best"), F.get(two, F.lit(1)).alias("own_second")), "residual")
    if settled is None:
        return residual.sparkSession.createDataFrame([], schema)
    return settled


def name_new_profiles(opened: DataFrame, observations: DataFrame, profiles: DataFrame) -> DataFrame:
    """Suggested name (40 letters), or the next free generic one."""
    o = opened.where("opened").select(*OBS, "profile_id").join(
        observations.select(*OBS, F.trim("suggested_name").alias("suggested")), OBS, "left")
    generic = F.coalesce("suggested", F.lit("")).rlike("^(Hablante .*)?$")
    wanted = numbered(o.where(generic).withColumn("g", F.lit(0)), ["g"], F.floor(F.col("profile_id") / 4_096),
                      ["profile_id"], "slot").select("slot", "profile_id")
    named = wanted.join(free_generic_names(profiles.select("name"), wanted), ["slot", "profile_id"]).select("profile_id", "name")
    return named.unionByName(o.where(~generic).select("profile_id", F.left("suggested", F.lit(40)).alias("name")))


def learning_audit(gated_samples: DataFrame, chosen: DataFrame, resolved: DataFrame, gated: DataFrame) -> DataFrame:
    """Counts of samples received, eligible, selected and rejected by reason."""
    s = gated_samples.groupBy(F.coalesce("reject_reason", F.lit("eligible")).alias("item")).agg(F.count(F.lit(1)).alias("n"))
    all_ = gated_samples.agg(F.lit("received").alias("item"), F.count(F.lit(1)).alias("n"))
    sel = chosen.agg(F.lit("selected").alias("item"), F.count(F.lit(1)).alias("n"))
    obs = gated.where(F.col("reject_reason").isNotNull()).groupBy(
        F.concat(F.lit("observation:"), "reject_reason").alias("item")).agg(F.count(F.lit(1)).alias("n"))
    end = resolved.groupBy(F.concat(F.lit("status:"), "status").alias("item")).agg(F.count(F.lit(1)).alias("n"))
    return all_.unionByName(s).unionByName(sel).unionByName(obs).unionByName(end)


def evidence_audit(memory: DataFrame, learned: DataFrame, rejected: DataFrame) -> DataFrame:
    """(item, n): samples that repeat a learned (profile, project, segment), and samples of the memory that give way to the new ones."""
    keyed = learned.where(F.col("source_segment").isNotNull())
    once = keyed.select("profile_id", "source_project", "source_segment").distinct()
    count = lambda d: d.agg(F.count(F.lit(1)).alias("n"))
    twice = count(keyed).join(F.broadcast(count(once).withColumnRenamed("n", "m")))  # two rows of one number
    kept = replace_project_evidence(memory, learned, rejected).select("sample_id")
    gone = memory.join(kept, "sample_id", "left_anti")
    return twice.select(F.lit("duplicate").alias("item"), (F.col("n") - F.col("m")).alias("n")).unionByName(
        count(gone).select(F.lit("replaced").alias("item"), "n"))


def replace_project_evidence(memory: DataFrame, learned: DataFrame, rejected: DataFrame) -> DataFrame:
    """Sample table after a project was analysed again.

    Its old samples give way per (profile, project) to the new ones; where nothing of the project
    was rejected, its samples under other profiles go as well.
    """
    pair = ["profile_id", "source_project"]
    cols = memory.columns
    keyed = learned.where(F.col("source_segment").isNotNull()).groupBy(*pair, "source_segment").agg(F.min_by(
        F.struct(*cols), "sample_id").alias("s")).select("s.*").unionByName(learned.where(
            F.col("source_segment").isNull()).select(*cols))
    kept = memory.join(learned.select(*pair).distinct(), pair, "left_anti")
    whole = learned.select("source_project").distinct().join(rejected.select("source_project").distinct(), "source_project", "left_anti")
    return kept.join(whole, "source_project", "left_anti").select(*cols).unionByName(keyed.select(*cols))


# --- maintenance -----------------------------------------------------------------------------

def compare_profiles(pairs: DataFrame, profiles: DataFrame) -> DataFrame:
    """Similarity verdict for the given (source_id, target_id) pairs."""
    side = lambda p: profiles.select(
        F.col("profile_id").alias(f"{p}_id"), F.col("name").alias(f"{p}_name"), F.col("centroid").alias(f"{p}_vector"),
        F.col("match_threshold").alias(f"{p}_threshold"))
    j = pairs.where(F.col("source_id") != F.col("target_id")).join(side("source"), "source_id").join(side("target"), "target_id")
    similar = clip(dot("source_vector", "target_vector"), -1.0, 1.0)
    similar = F.when(F.col("source_vector").isNotNull() & F.col("target_vector").isNotNull(), similar)
    threshold = F.greatest("source_threshold", "target_threshold")
    verdict = F.when(similar.isNull(), "sin_datos").when(similar >= threshold + 0.08, "alta").when(
        similar >= threshold, "compatible").otherwise("baja")
    return j.select("source_id", "source_name", "target_id", "target_name", similar.alias("similarity"),
                    threshold.alias("threshold"), verdict.alias("verdict"))


def similar_profiles(profiles: DataFrame, threshold: float | None = None, pivots: int = PIVOTS, block: int = PAIR_BLOCK) -> tuple[DataFrame, dict[str, int]]:
    """(pairs, report): all pairs source_id < target_id of profiles whose similarity reaches the threshold, and how many block pairs were looked at.

    The threshold of a pair is ``threshold``, or the greater one of the two profiles'. Vectors of one width are compared. Angles obey
    the triangle inequality, so two profiles whose angles to some pivot differ by more than the widest allowed angle cannot be similar.
    Profiles are put into blocks by nearest pivot and angle to it; a block knows the least and greatest angle to every pivot, and a pair of blocks
    that is too far apart at any pivot is never multiplied. Pivots are some of the profiles themselves; any choice gives the same pairs.
    """
    p = profiles.where(F.col("centroid").isNotNull() & (F.size("centroid") > 0)).select(
        "profile_id", F.col("match_threshold").alias("own"), unit("centroid").alias("v"), F.size("centroid").alias("width"))
    p = cut(p.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x))), "unit_profiles")
    least = p.agg(F.min(F.lit(threshold) if threshold is not None else F.col("own"))).first()[0]
    schema = "source_id long, target_id long, similarity double, threshold double"
    if least is None:
        return p.sparkSession.createDataFrame([], schema), {"blocks": 0, "pairs": 0, "kept": 0}
    widest = math.acos(max(-1.0, min(1.0, least))) + 1e-9
    chosen = p.withColumn("nth", F.row_number().over(W.partitionBy("width").orderBy(F.xxhash64("profile_id"), "profile_id"))).where(F.col("nth") <= pivots)
    chosen = chosen.groupBy("width").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "v"))), lambda x: x["v"]).alias("pivots"))  # at most ``pivots`` vectors a width
    angles = F.transform("pivots", lambda q: F.acos(clip(dot("v", q), -1.0, 1.0)))
    p = p.join(F.broadcast(chosen), "width").withColumn("angles", angles).drop("pivots")
    home = F.array_position("angles", F.array_min("angles")) - 1
    p = cut(p.withColumn("home", home).withColumn("ring", F.floor(F.array_min("angles") / (widest / 4))), "pivot_angles")
    cells = p.groupBy("width", "home", "ring").agg(F.ceil(F.count(F.lit(1)) / block).alias("parts"))
    p = p.join(cells, ["width", "home", "ring"]).withColumn("part", F.pmod(F.xxhash64("profile_id", F.lit("part")), "parts"))
    p = cut(p.withColumn("block", F.struct("width", "home", "ring", "part")).select("profile_id", "own", "v", "angles", "block"), "profile_blocks")
    size = p.agg(F.max(F.size("angles"))).first()[0]
    get = lambda i: F.get("angles", F.lit(i))
    stats = cut(p.groupBy("block").agg(F.array(*[F.min(get(i)) for i in range(size)]).alias("lo"), F.array(*[F.max(get(i)) for i in range(size)]).alias("hi")), "block_angles")
    # blocks meet in bins of the widest angle at the first pivot: a similar pair's blocks share a bin or touch
    bins = F.explode(F.sequence(F.floor(F.get("lo", F.lit(0)) / widest).cast("int") - 1, F.floor(F.get("hi", F.lit(0)) / widest).cast("int") + 1))
    left = stats.select(F.col("block").alias("a"), F.col("lo").alias("alo"), F.col("hi").alias("ahi"), bins.alias("bin"))
    right = left.toDF("b", "blo", "bhi", "bin")
    near = F.forall(F.arrays_zip("alo", "ahi", "blo", "bhi"), lambda x: x["alo"].isNull() | (
        (x["alo"] - x["bhi"] <= widest) & (x["blo"] - x["ahi"] <= widest)))
    met = left.join(right, "bin").where((F.col("a.width") == F.col("b.width")) & (F.col("a") <= F.col("b")) & near).select("a", "b").distinct()
    met = cut(met.withColumn("pair", F.struct("a", "b")), "block_pairs")
    sides = met.select("pair", (F.col("a") == F.col("b")).alias("same"), F.explode(F.array(
        F.struct(F.col("a").alias("block"), F.lit(0).alias("side")), F.struct(F.col("b").alias("block"), F.lit(1).alias("side")))).alias("s"))
    rows = sides.select("pair", "same", "s.*").join(p.select("block", "profile_id", "own", "v"), "block").select("pair", "same", "side", "profile_id", "own", "v")

    def multiply(table: pa.Table) -> pa.Table:
        sides = [table.filter(pc.equal(table.column("side"), k)) for k in (0, 1)]
        one, other = (t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1) for t in sides)
        (x, y), (p, q) = ([t.column(c).to_numpy() for t in sides] for c in ("profile_id", "own"))
        product = np.clip(one @ other.T, -1.0, 1.0)
        limit = np.maximum(p[:, None], q[None, :]) if threshold is None else np.full(product.shape, threshold)
        once = x[:, None] < y[None, :] if table.column("same")[0].as_py() else x[:, None] != y[None, :]
        i, j = np.nonzero((product >= limit) & once)
        return pa.table([pa.array(c) for c in (np.minimum(x[i], y[j]), np.maximum(x[i], y[j]), product[i, j], limit[i, j])],
                        names=["source_id", "target_id", "similarity", "threshold"])

    n = stats.count()
    pairs = rows.groupBy("pair").applyInArrow(multiply, schema)  # at most two blocks
    return pairs, {"blocks": n, "pairs": n * (n + 1) // 2, "kept": met.count()}


def merge_roots(pairs: DataFrame) -> DataFrame:
    """(source_id, root_id, cycle): the end of every merge chain; of a cycle a->b->a the smallest member, with ``cycle`` true.

    Chains are followed by doubling, the least profile on the way with them. After as many doublings as give a way longer than the number of
    sources, only ways that run in circles still go on: their end lies on the circle, and the least profile on the way from there is the
    circle's. A source with several targets takes the smallest; a pair of a profile with itself says nothing.
    """
    steps = pairs.where("source_id <> target_id").groupBy("source_id").agg(F.min("target_id").alias("at"))
    state = cut(steps.select("source_id", "at", F.col("at").alias("least"), F.lit(True).alias("open")), "roots")
    way, n = 1, state.count()
    while True:
        further = state.select(F.col("source_id").alias("at"), F.col("at").alias("next"), F.col("least").alias("next_least"))
        j = state.join(further, "at", "left")
        state = cut(j.select("source_id", F.coalesce("next", "at").alias("at"), F.least("least", "next_least").alias("least"),  # least() skips a missing side
                             F.col("next").isNotNull().alias("open")), "roots")
        way *= 2
        if way > n or state.where("open").isEmpty():
            break
    circle = state.where("open")
    ends = state.select(F.col("source_id").alias("at"), F.col("least").alias("root_id"))
    circled = circle.join(ends, "at").select("source_id", "root_id", F.lit(True).alias("cycle"))
    straight = state.where("not open").select("source_id", F.col("at").alias("root_id"), F.lit(False).alias("cycle"))
    return cut(straight.unionByName(circled).where("source_id <> root_id"), "roots")


def merge_profiles(pairs: DataFrame, profiles: DataFrame, samples: DataFrame, segments: DataFrame) -> dict[str, DataFrame]:
    """Merge source into target profiles: new profiles, samples and segments tables, and a report."""
    roots = merge_roots(pairs).drop("cycle")
    to = roots.select(F.col("source_id").alias("profile_id"), "root_id")
    moved = samples.join(to, "profile_id", "left").withColumn("moved", F.col("root_id").isNotNull()).withColumn(
        "profile_id", F.coalesce("root_id", "profile_id")).drop("root_id")
    touched = roots.select(F.col("root_id").alias("profile_id")).distinct()
    rebuilt_from = moved.join(touched, "profile_id", "left_semi")
    kept = round_robin_cap(dedupe_samples(rebuilt_from.drop("moved")))
    centroids = profile_centroid(rebuilt_from.drop("moved"))
    names = profiles.select(F.col("profile_id").alias("root_id"), F.col("name").alias("root_name"))
    seg_to = roots.join(names, "root_id").select(F.col("source_id").alias("speaker_profile_id"), "root_id", "root_name")
    s = segments.join(seg_to, "speaker_profile_id", "left")
    new_segments = s.select(
        *[c for c in segments.columns if c not in ("speaker_profile_id", "speaker")],
        F.coalesce("root_id", "speaker_profile_id").alias("speaker_profile_id"), F.coalesce("root_name", "speaker").alias("speaker"))
    changed = s.where(F.col("root_id").isNotNull()).groupBy(F.col("root_id").alias("profile_id")).agg(
        F.count(F.lit(1)).alias("updated_segments"), F.count_distinct("project_id").alias("affected_projects"))
    counts = rebuilt_from.groupBy("profile_id").agg(F.count_if("moved").alias("moved_samples"), F.count(F.lit(1)).alias("combined"))
    last = profiles.join(to, "profile_id", "left").groupBy(F.coalesce("root_id", "profile_id").alias("profile_id")).agg(
        F.max("last_matched_at").alias("last_matched_at"))
    rest = profiles.join(to.select("profile_id"), "profile_id", "left_anti").drop("last_matched_at").join(last, "profile_id")
    new = centroids.select("profile_id", F.col("centroid").alias("c"), F.col("sample_count").alias("n"),
                           F.col("total_duration_ms").alias("ms"))
    new_profiles_ = rest.join(new, "profile_id", "left").select(
        *[c for c in profiles.columns if c not in ("centroid", "sample_count", "total_duration_ms")],
        F.coalesce("c", "centroid").alias("centroid"), F.coalesce("n", "sample_count").alias("sample_count"),
        F.coalesce("ms", "total_duration_ms").alias("total_duration_ms"))
    report = touched.join(counts, "profile_id", "left").join(centroids.select("profile_id", "sample_count"), "profile_id", "left").join(
        changed, "profile_id", "left").select(
        "profile_id", F.coalesce("moved_samples", F.lit(0)).alias("moved_samples"),
        (F.coalesce("combined", F.lit(0)) - F.coalesce("sample_count", F.lit(0))).alias("removed_samples"),
        F.coalesce("sample_count", F.lit(0)).alias("retained_samples"),
        F.coalesce("updated_segments", F.lit(0)).alias("updated_segments"),
        F.coalesce("affected_projects", F.lit(0)).alias("affected_projects"))
    untouched = moved.drop("moved").join(touched, "profile_id", "left_anti")
    return {"profiles": new_profiles_, "samples": untouched.unionByName(kept.select(*untouched.columns)),
            "segments": new_segments, "report": report}


def delete_profiles(ids: DataFrame, profiles: DataFrame, segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    gone = ids.select(F.col("profile_id").alias("speaker_profile_id"), F.lit(True).alias("gone")).distinct()
    s = segments.join(gone, "speaker_profile_id", "left")
    keep = [c for c in segments.columns if c not in ("speaker_profile_id", "speaker_match_confidence")]
    cleared = s.select(*keep, *[F.when(F.col("gone").isNull(), F.col(c)).alias(c)
                                for c in ("speaker_profile_id", "speaker_match_confidence")])
    return profiles.join(ids.select("profile_id").distinct(), "profile_id", "left_anti"), cleared


def update_profiles(profiles: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply (profile_id, new_name, new_enabled, new_threshold); blank names are refused."""
    c = changes.select("profile_id", F.left(F.trim("new_name"), F.lit(40)).alias("new_name"), "new_enabled",
                       clip(F.col("new_threshold"), 0.55, 0.86).alias("new_threshold"))
    j = profiles.join(c, "profile_id", "left")
    refused = F.coalesce(F.col("new_name") == "", F.lit(False))
    keep = [x for x in profiles.columns if x not in ("name", "enabled", "match_threshold")]

    def new(to: str, old: str) -> Column:
        return F.when(refused | F.col(to).isNull(), F.col(old)).otherwise(F.col(to)).alias(old)

    return j.select(*keep, new("new_name", "name"), new("new_enabled", "enabled"),
                    F.when(refused | F.col("new_threshold").isNull(), F.col("match_threshold")).otherwise(
                        F.col("new_threshold")).alias("match_threshold"), refused.alias("refused"))
