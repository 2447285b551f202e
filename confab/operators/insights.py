"""Extractive analysis of transcripts: statistics, concepts, chapters and key points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from confab.functions import text as tx
from confab.operators.blocks import Scan, running
from confab.session import cut

KEY_POINTS = 8
REDUNDANT = 0.62
FIRST_LOOK = 64


def not_blank(segments: DataFrame) -> DataFrame:
    return segments.where(F.col("text").rlike(r"(?U)\S"))


def with_tokens(segments: DataFrame) -> DataFrame:
    """The segments with their topic words as a written column, for callers that run several operators over them."""
    return cut(segments.withColumn("tokens", tx.all_tokens(F.col("text"))), "tokens")


def tokens_of(segments: DataFrame) -> Column:
    """The written topic words if :func:`with_tokens` has added them."""
    return F.col("tokens") if "tokens" in segments.columns else tx.all_tokens(F.col("text"))


def token_rows(segments: DataFrame) -> DataFrame:
    """(project_id, segment_id, segment_order, start_ms, pos, token), one row per topic word."""
    return not_blank(segments).select(
        "project_id", "segment_id", "segment_order", "start_ms",
        F.posexplode(tokens_of(segments)).alias("pos", "token"))


def transcript_stats(segments: DataFrame, projects: DataFrame) -> DataFrame:
    s = not_blank(segments).groupBy("project_id").agg(
        F.sum(F.regexp_count("text", F.lit(r"(?U)\S+"))).alias("words"),
        F.count(F.lit(1)).alias("paragraphs"),
        F.sum(F.regexp_count("text", F.lit(r"\?"))).alias("questions"),
        F.max_by("end_ms", "segment_order").alias("last_end"))
    minutes = F.greatest("duration_ms", "last_end") / 60_000
    return s.join(projects.select("project_id", "duration_ms"), "project_id").select(
        "project_id", "words", "paragraphs", "questions",
        F.bround(F.col("words") / F.greatest(minutes, F.lit(0.1))).cast("long").alias("words_per_minute"))


def lexical_signals(segments: DataFrame, lexicon: dict[str, list[str]] | None = None) -> DataFrame:
    """Counts of signal words per kind; the word lists are part of the program, so they broadcast."""
    lexicon = lexicon or {"agreements": tx.AGREEMENT, "affection": tx.AFFECTION, "tension": tx.TENSION}
    spark = segments.sparkSession
    rows = [(kind, tx.py_fold(w)) for kind, ws in lexicon.items() for w in ws]
    words = spark.createDataFrame(rows, "kind string, token string").distinct()
    hits = token_rows(segments).join(F.broadcast(words), "token").groupBy("project_id").agg(
        *[F.count_if(F.col("kind") == kind).alias(kind) for kind in lexicon])
    asked = not_blank(segments).groupBy("project_id").agg(
        F.sum(F.regexp_count("text", F.lit(r"\?"))).alias("questions"))
    return asked.join(hits, "project_id", "left").select(
        "project_id", "questions", *[F.coalesce(kind, F.lit(0)).alias(kind) for kind in lexicon])


def top_concepts(tokens: DataFrame, k: int = 12) -> DataFrame:
    """Most frequent tokens per project; the one seen first wins ties."""
    counted = tokens.groupBy("project_id", "token").agg(
        F.count(F.lit(1)).alias("weight"), F.min(F.struct("segment_order", "pos")).alias("seen"))
    rank = W.partitionBy("project_id").orderBy(F.desc("weight"), "seen")
    return counted.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select(
        "project_id", "rank", "token", capitalized(F.col("token")).alias("label"), "weight")


def capitalized(c: Column) -> Column:
    return F.concat(F.upper(F.left(c, F.lit(1))), F.lower(F.substr(c, F.lit(2))))


def concept_edges(segments: DataFrame, concepts: DataFrame, k: int = 18) -> DataFrame:
    """Pairs of a project's top concepts meeting in a segment; at most 66 pairs per segment."""
    sets = not_blank(segments).select("project_id", "segment_order", F.array_distinct(tokens_of(segments)).alias("tokens"))
    tops = concepts.groupBy("project_id").agg(F.collect_set("token").alias("tops"))
    present = sets.join(tops, "project_id").select(
        "project_id", "segment_order", F.array_sort(F.array_intersect("tokens", "tops")).alias("p")).where(
        F.size("p") >= 2)
    pairs = F.flatten(F.transform("p", lambda a, i: F.transform(
        F.slice("p", i + 2, F.size("p")), lambda b: F.struct(a.alias("source"), b.alias("target")))))
    counted = present.select("project_id", "segment_order", F.explode(pairs).alias("e")).groupBy(
        "project_id", "e.source", "e.target").agg(
        F.count(F.lit(1)).alias("weight"), F.min("segment_order").alias("seen"))
    rank = W.partitionBy("project_id").orderBy(F.desc("weight"), "seen", "source", "target")
    return counted.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).drop("seen")


def chapters(segments: DataFrame, projects: DataFrame) -> DataFrame:
    """Buckets of an eighth of the recording, 3 to 10 minutes, titled by their commonest words."""
    s = not_blank(segments)
    ends = s.groupBy("project_id").agg(F.max_by("end_ms", "segment_order").alias("last_end"))
    size = projects.join(ends, "project_id").select("project_id", F.greatest(F.lit(180_000), F.least(
        F.lit(600_000), F.ceil(F.greatest(F.lit(1), "duration_ms", "last_end") / 8))).alias("size"))
    s = s.join(size, "project_id").withColumn("bucket", F.floor(F.col("start_ms") / F.col("size")))
    key = ["project_id", "bucket"]
    spans = s.groupBy(*key).agg(F.min_by("start_ms", "segment_order").alias("start_ms"),
                                F.max_by("end_ms", "segment_order").alias("end_ms"))
    order = W.partitionBy(*key).orderBy("segment_order")
    heads = s.withColumn("n", F.row_number().over(order)).where(F.col("n") <= 2).groupBy(*key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), " ")
        .alias("head"))
    words = s.select(*key, "segment_order", F.posexplode(tokens_of(segments)).alias("pos", "token"))
    words = words.groupBy(*key, "token").agg(F.count(F.lit(1)).alias("n"),
                                             F.min(F.struct("segment_order", "pos")).alias("seen"))
    top = W.partitionBy(*key).orderBy(F.desc("n"), "seen")
    titles = words.withColumn("r", F.row_number().over(top)).where(F.col("r") <= 3).groupBy(*key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "token"))),
                                 lambda x: capitalized(x["token"])), " · ").alias("title"))
    return spans.join(heads, key).join(titles, key, "left").select(
        *key, F.coalesce("title", F.concat(F.lit("Parte "), F.col("bucket") + 1)).alias("title"),
        "start_ms", "end_ms", tx.shorten(F.col("head"), 190).alias("description"))


def segment_scores(segments: DataFrame) -> DataFrame:
    """Every segment's relevance inside its project, with its token set.

    Token statistics are aggregated before they are joined back, so a token common to a third of
    all rows travels as one row per project.
    """
    s = not_blank(segments).select("project_id", "segment_id", "segment_order",
                                   tokens_of(segments).alias("tokens"),
                                   F.col("text").contains("?").alias("asks"))
    n = s.groupBy("project_id").agg(F.count(F.lit(1)).alias("n"))
    each = s.select("project_id", "segment_order", F.explode("tokens").alias("token")).groupBy(
        "project_id", "segment_order", "token").agg(F.count(F.lit(1)).alias("c"))
    stats = each.groupBy("project_id", "token").agg(F.sum("c").alias("gf"), F.count(F.lit(1)).alias("df"))
    stats = stats.join(n, "project_id").select("project_id", "token", (
        (1 + F.log1p("gf")) * F.log((F.col("n") + 1) / (F.col("df") + 0.5))).alias("w"))
    sums = each.join(stats, ["project_id", "token"]).groupBy("project_id", "segment_order").agg(F.sum("w").alias("w"))
    score = F.coalesce(F.col("w") / F.sqrt(F.size("tokens")), F.lit(0.0)) * F.when(
        F.col("asks") & (F.size("tokens") > 0), 1.08).otherwise(1.0)
    return s.join(sums, ["project_id", "segment_order"], "left").join(n, "project_id").select(
        "project_id", "segment_id", "segment_order", "n", F.round(score, 6).alias("score"),
        F.array_distinct("tokens").alias("token_set"))


def _redundant(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b))) > REDUNDANT


def pick_key_points(scores: DataFrame, k: int = KEY_POINTS, look: int = FIRST_LOOK) -> DataFrame:
    """(project_id, pick, segment_order, score): greedy choice by score, later segment first on ties.

    Most projects fill their ``k`` points from the best ``look`` segments; that is a fold over a
    short array.  A project that does not is picked in ``k`` rounds over all its segments: each
    round takes the best one not redundant with those taken, which is the same greedy order.
    """
    scores = cut(scores, "scores")
    item = F.struct("score", "segment_order", "token_set")
    rank = W.partitionBy("project_id").orderBy(F.desc("score"), F.desc("segment_order"))
    best = scores.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= look)
    lists = best.groupBy("project_id").agg(
        F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("r", "score", "segment_order", "token_set")))
        .alias("items"))
    empty = F.filter(F.col("items"), lambda x: F.lit(False))
    taken = F.aggregate("items", empty, lambda acc, x: F.when(
        (F.size(acc) < k) & ~F.exists(acc, lambda c: _redundant(c["token_set"], x["token_set"])),
        F.concat(acc, F.array(x))).otherwise(acc))
    first = cut(lists.select("project_id", "n", taken.alias("taken")), "first-look")
    full = (F.size("taken") >= k) | (F.col("n") <= look)
    done = first.where(full).select("project_id", F.posexplode("taken").alias("pick", "x")).select(
        "project_id", "pick", F.col("x.segment_order").alias("segment_order"), F.col("x.score").alias("score"))
    rest = first.where(~full).select("project_id")
    if rest.isEmpty():
        return done
    pool = scores.join(rest, "project_id")
    chosen = None
    for step in range(k):
        alive = pool
        if chosen is not None:
            sets = chosen.groupBy("project_id").agg(F.collect_list(F.struct("segment_order", "token_set")).alias("c"))
            alive = pool.join(sets, "project_id", "left").where(~F.coalesce(F.exists("c", lambda c: (
                c["segment_order"] == F.col("segment_order")) | _redundant(c["token_set"], F.col("token_set"))),
                F.lit(False))).drop("c")
        won = alive.groupBy("project_id").agg(F.max_by(item, F.struct("score", "segment_order")).alias("x"))
        won = cut(won.select("project_id", F.lit(step).alias("pick"), "x.*"), "picked")
        chosen = won if chosen is None else chosen.unionByName(won)
    return done.unionByName(chosen.select("project_id", "pick", "segment_order", "score"))


def _segment_title(tokens: Column, start_ms: Column) -> Column:
    counted = F.transform(F.array_distinct(tokens), lambda t, i: F.struct(
        (-F.size(F.filter(tokens, lambda u: u == t))).alias("n"), i.alias("i"), t.alias("t")))
    top = F.transform(F.slice(F.array_sort(counted), 1, 3), lambda x: capitalized(x["t"]))
    fallback = F.concat(F.lit("Punto en "), F.bround(start_ms / 60_000).cast("long"), F.lit(" min"))
    return F.when(F.size(tokens) > 0, F.array_join(top, " · ")).otherwise(fallback)


def key_points(segments: DataFrame, picks: DataFrame) -> DataFrame:
    s = segments.select("project_id", "segment_order", "segment_id", "start_ms", "end_ms", "text", tokens_of(segments).alias("tokens"))
    return picks.join(s, ["project_id", "segment_order"]).select(
        "project_id", "pick", "segment_id", "start_ms", "end_ms", "score",
        _segment_title(F.col("tokens"), F.col("start_ms")).alias("title"),
        tx.shorten(F.col("text"), 260).alias("text"))


def extractive_summary(segments: DataFrame, picks: DataFrame) -> DataFrame:
    """The five best points in time order."""
    s = segments.select("project_id", "segment_order", tx.shorten(F.col("text"), 220).alias("t"))
    return picks.where(F.col("pick") < 5).join(s, ["project_id", "segment_order"]).groupBy("project_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("segment_order", "t"))), lambda x: x["t"]), " ")
        .alias("summary"))


def audio_quality(frames: DataFrame, exact: bool = True) -> DataFrame:
    """Noise floor, speech level, clipping and silence per recording from frame measurements.

    ``frames``: recording_id, rms (0..1), clipped (samples at full scale), n (samples).  Exact
    percentiles are read off running counts over the distinct values, cut into blocks of the value
    range, so that no recording's values meet in one task; ``exact=False`` uses a sketch.
    """
    key = ["recording_id"]
    sums = frames.groupBy(*key).agg(F.sum("clipped").alias("clipped"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("frames"))
    values = frames.groupBy(*key, "rms").agg(F.count(F.lit(1)).alias("c"))
    if exact:
        values = cut(values, "levels")
        ranked = running(values, key, F.floor(F.col("rms") * 4_096), ["rms"], [Scan("upto", F.col("c"), "sum")])
        at = lambda p: p * (F.col("frames") - 1)
        reach = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("rms")))
        picks = ranked.join(sums, key).groupBy(*key, "frames").agg(*[
            reach(f(at(p))).alias(f"{side}{name}") for name, p in (("noise", 0.18), ("speech", 0.82))
            for side, f in (("lo_", F.floor), ("hi_", F.ceil))])

        def level(name: str, p: float) -> Column:
            share = at(p) - F.floor(at(p))
            return (F.col(f"lo_{name}") + (F.col(f"hi_{name}") - F.col(f"lo_{name}")) * share).alias(name)

        levels = picks.select(*key, level("noise", 0.18), level("speech", 0.82)).join(sums, key)
    else:
        levels = frames.groupBy(*key).agg(F.percentile_approx("rms", 0.18, 10_000).alias("noise"),
                                          F.percentile_approx("rms", 0.82, 10_000).alias("speech")).join(sums, key)
    below = F.col("rms") < F.greatest(F.lit(0.0025), F.col("noise") * 1.25)
    quiet = values.join(levels.select(*key, "noise"), key).groupBy(*key).agg(
        (F.sum(F.when(below, F.col("c")).otherwise(0)) / F.sum("c")).alias("silent"))
    db = lambda c: 20 * F.log10(F.greatest(c, F.lit(1e-6)))
    apart = db(F.col("speech")) - db(F.col("noise"))
    return levels.join(quiet, "recording_id").select(
        "recording_id", F.round(db(F.col("noise")), 1).alias("noise_floor_db"),
        F.round(db(F.col("speech")), 1).alias("speech_level_db"),
        F.round(F.col("clipped") / F.col("n") * 100, 3).alias("clipping_percent"),
        F.round(F.col("silent") * 100, 1).alias("silence_percent"),
        F.when(apart < 8, "strong").when(apart < 17, "speech").otherwise("off").alias("recommended"))


def segment_confidence(words: DataFrame, acoustic: DataFrame) -> DataFrame:
    """.75 mean word probability + .25 exp(mean log-probability); 0 and NULL count as -2."""
    per = words.groupBy("project_id", "segment_id").agg(F.avg("probability").alias("p"))
    logprob = F.coalesce(F.nullif(F.col("avg_logprob"), F.lit(0.0)), F.lit(-2.0))
    heard = F.exp(F.least(F.lit(0.0), logprob))
    score = F.when(F.col("p").isNull(), heard).otherwise(F.col("p") * 0.75 + heard * 0.25)
    return acoustic.join(per, ["project_id", "segment_id"], "left").select(
        "project_id", "segment_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 4).alias("confidence"))
