"""Project catalogue: nesting, replacing, queues, versions, reports and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from confab.functions import text as tx
from confab.operators.blocks import BLOCK_MS, numbered, time_block
from confab.session import cut

PART_SIZE = 4_096
# Review states of a segment.
REVIEW_STATES = ("pending", "accepted", "corrected", "ignored")


# --- nesting -------------------------------------------------------------------------------

def nest_projects(projects: DataFrame, segments: DataFrame, words: DataFrame, part_size: int = PART_SIZE) -> DataFrame:
    """Projects with their ordered segments and words as nested arrays.

    A recording longer than ``part_size`` segments takes several rows (part 0, 1, ...), and an
    utterance's words are nested per ten minutes, so that no array grows with the key.
    """
    key = ["project_id", "segment_id"]
    starts = words.groupBy(*key).agg(F.min("start_ms").alias("s0"))  # so that every segment has a word part 0
    w = words.join(starts, key).withColumn("word_part", F.floor((F.col("start_ms") - F.col("s0")) / BLOCK_MS))
    w = w.groupBy(*key, "word_part").agg(F.array_sort(F.collect_list(
        F.struct("start_ms", "pos", "end_ms", F.col("word").alias("text"), "probability"))).alias("words"))
    cols = [c for c in segments.columns if c != "project_id"]
    s = numbered(segments, ["project_id"], time_block(), ["start_ms", "segment_order"])
    s = s.withColumn("part", F.floor((F.col("rn") - 1) / part_size)).join(w, key, "left")
    item = F.struct("rn", F.coalesce("word_part", F.lit(0)).alias("word_part"), *cols, "words")
    nested = s.groupBy("project_id", "part").agg(F.array_sort(F.collect_list(item)).alias("segments"))
    return projects.join(nested, "project_id", "left")


def flatten_projects(nested: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(segments, words) of nested projects; unknown review states become NULL, a missing order the segment's place in the project.

    A segment whose words fill several rows is emitted once, from the first of them.
    """
    s = nested.select("project_id", F.posexplode("segments").alias("i", "s"))
    known = lambda c: F.when(F.col(c).isin(*REVIEW_STATES), F.col(c))
    fields = nested.schema["segments"].dataType.elementType.names
    plain = [f for f in fields if f not in ("words", "segment_order", "review_state", "speaker_review_state", "rn",
                                            "word_part")]
    place = (F.col("s.rn") - 1 if "rn" in fields else F.col("i")).cast("long")
    once = s.where(F.col("s.word_part") == 0) if "word_part" in fields else s
    segments = once.select(
        "project_id", *[F.col(f"s.{f}").alias(f) for f in plain], F.coalesce("s.segment_order", place).alias("segment_order"),
        known("s.review_state").alias("review_state"), known("s.speaker_review_state").alias("speaker_review_state"))
    w = s.select("project_id", F.col("s.segment_id").alias("segment_id"), F.explode("s.words").alias("w"))
    words = w.select("project_id", "segment_id", "w.start_ms", "w.end_ms", "w.text", "w.probability")
    return segments, words


# --- writes expressed as new table contents --------------------------------------------------

def replace_project_segments(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    return existing.join(incoming.select("project_id").distinct(), "project_id", "left_anti").unionByName(incoming)


def write_by_bucket(df: DataFrame, path: str, buckets: int) -> None:
    """Replace the projects of ``df`` in a table of hash buckets; other projects of the touched buckets are written back unchanged."""
    spark = df.sparkSession
    bucketed = cut(df.withColumn("bucket", F.pmod(F.hash("project_id"), F.lit(buckets))), "incoming")
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        touched = [r["bucket"] for r in bucketed.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
        there = spark.read.parquet(path).where(F.col("bucket").isin(touched))
        kept = there.join(bucketed.select("project_id").distinct(), "project_id", "left_anti")
        bucketed = cut(bucketed.unionByName(kept.select(bucketed.columns)), "rewritten")
    bucketed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def align_schema(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """Add the columns of ``wanted`` that ``df`` lacks, as NULL."""
    return df.unionByName(wanted.limit(0), allowMissingColumns=True)


def delete_projects(ids: DataFrame, **children: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """(remaining tables, rows deleted per project and table)."""
    ids = ids.select("project_id").distinct()
    left = {name: df.join(ids, "project_id", "left_anti") for name, df in children.items()}
    gone = None
    for name, df in children.items():
        n = df.join(ids, "project_id", "left_semi").groupBy("project_id").agg(F.count(F.lit(1)).alias("deleted"))
        n = n.select("project_id", F.lit(name).alias("table"), "deleted")
        gone = n if gone is None else gone.unionByName(n)
    return left, gone


def replace_all(segments: DataFrame, query: str, replacement: str) -> DataFrame:
    """Segments changed by a literal, case-insensitive replace, with the number of replacements."""
    new, count = tx.replace_literal(F.col("text"), query, replacement)
    changed = segments.withColumn("replacements", count).where(F.col("replacements") > 0)
    return changed.select("project_id", "segment_id", new.alias("text"), "replacements")


def drop_stale_insights(insights: DataFrame, changed: DataFrame) -> DataFrame:
    return insights.join(changed.select("project_id").distinct(), "project_id", "left_anti")


def upsert_segments(current: DataFrame, incoming: DataFrame, partitions: int | None = None) -> DataFrame:
    """By id, incoming wins; projects whose batch says ``replace_existing`` are cleared first.

    ``incoming`` has the columns of ``current`` plus seq (arrival) and replace_existing.  Of a
    project's batches only those from its last replacing one on count. With ``partitions`` every shuffle of texts is dealt over
    that many, so that a task's sort does not grow with the table.
    """
    cols = current.columns
    dealt = lambda df, *keys: df if partitions is None else df.repartition(partitions, *keys)
    reset = incoming.groupBy("project_id").agg(F.max(F.when(F.col("replace_existing"), F.col("seq"))).alias("since"))
    kept = dealt(current, "project_id").join(reset.where(F.col("since").isNotNull()), "project_id", "left_anti").withColumn(
        "seq", F.lit(-1).cast("long"))
    new = dealt(incoming, "project_id").join(reset, "project_id").where(F.col("seq") >= F.coalesce("since", F.col("seq"))).select(*cols, "seq")
    both = kept.select(*cols, "seq").unionByName(new)
    return dealt(both, "project_id", "segment_id").groupBy("project_id", "segment_id").agg(F.max_by(F.struct(*cols), "seq").alias("r")).select("r.*")


def keep_versions(versions: DataFrame, n: int = 5) -> DataFrame:
    """The newest ``n`` snapshots per project; ``seq`` decides between equal times."""
    order = W.partitionBy("project_id").orderBy(F.desc("created_at"), F.desc("seq"))
    return versions.withColumn("age", F.row_number().over(order)).where(F.col("age") <= n)


def snapshot(segments: DataFrame, version: Column, part_size: int = PART_SIZE, words: DataFrame | None = None) -> DataFrame:
    """Version rows (project_id, version, part, segments): arrays of at most ``part_size``; with ``words`` every segment holds its own."""
    if words is not None:
        fields = [c for c in words.columns if c not in ("project_id", "segment_id")]
        held = words.groupBy("project_id", "segment_id").agg(F.array_sort(F.collect_list(F.struct("start_ms", *[c for c in fields if c != "start_ms"]))).alias("words"))
        segments = segments.join(held, ["project_id", "segment_id"], "left")
    cols = [c for c in segments.columns if c != "project_id"]
    s = numbered(segments, ["project_id"], time_block(), ["start_ms", "segment_order"])
    return s.groupBy("project_id", F.floor((F.col("rn") - 1) / part_size).alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("rn", *cols))).alias("segments")).withColumn("version", version)


def restore_version(segments: DataFrame, versions: DataFrame, wanted: DataFrame, words: DataFrame | None = None,
                    projects: DataFrame | None = None) -> dict[str, DataFrame]:
    """Bring back ``wanted`` (project_id, version): new segments, a snapshot of the old ones, evidence rows.

    With ``words`` the snapshot holds them and a version that has words gives them back (key ``words``); with ``projects`` the restored
    ones are completed (key ``projects``).
    """
    found = versions.join(wanted, ["project_id", "version"])
    back = found.select("project_id", F.explode("segments").alias("s")).select("project_id", "s.*").drop("rn")
    ids = found.select("project_id", "version").distinct()
    before = segments.join(ids.select("project_id"), "project_id", "left_semi")
    evidence = ids.select("project_id", F.lit("version_restored").alias("event_type"),
                          F.to_json(F.struct(F.col("version").alias("versionId"))).alias("payload"))
    out = {"segments": replace_project_segments(segments, back.select(*segments.columns)), "evidence": evidence}
    if words is None:
        out["snapshot"] = snapshot(before, F.lit("before-restore"))
    else:
        out["snapshot"] = snapshot(before, F.lit("before-restore"), words=words.join(ids.select("project_id"), "project_id", "left_semi"))
        if "words" in back.columns:
            mine = back.select("project_id", "segment_id", F.explode("words").alias("w")).select("project_id", "segment_id", "w.*")
            out["words"] = words.join(ids.select("project_id"), "project_id", "left_anti").unionByName(mine.select(*words.columns))
    if projects is not None:
        done = ids.select("project_id", F.lit(True).alias("restored"))
        out["projects"] = projects.join(done, "project_id", "left").withColumn(
            "status", F.when(F.col("restored"), "completed").otherwise(F.col("status"))).select(*projects.columns)
    return out


def recover_interrupted(jobs: DataFrame, projects: DataFrame, queue: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """State of the three tables after a stop: running work is failed or queued again."""
    cut = F.col("state").isin("analyzing", "waiting_model", "transcribing")
    jobs = jobs.select(
        *[c for c in jobs.columns if c not in ("state", "error_code")],
        F.when(cut, "failed").otherwise(F.col("state")).alias("state"),
        F.when(cut, "INTERRUPTED").otherwise(F.col("error_code")).alias("error_code"))
    stopped = F.when(F.col("status") == "transcribing", "failed").otherwise(F.col("status"))
    again = F.when(F.col("state") == "running", "queued").otherwise(F.col("state"))
    return jobs, projects.withColumn("status", stopped), queue.withColumn("state", again)


# --- reports ---------------------------------------------------------------------------------

def reusable_projects(projects: DataFrame, segments: DataFrame) -> DataFrame:
    """Latest usable project per normalised media path: completed, or holding a segment."""
    held = segments.select("project_id").distinct().withColumn("held", F.lit(True))
    path = F.lower(F.regexp_replace(F.regexp_replace("media_path", r"\\", "/"), r"/(\./)+|/{2,}", "/"))
    usable = projects.join(held, "project_id", "left").where((F.col("status") == "completed") | F.col("held"))
    return usable.groupBy(path.alias("path")).agg(
        F.max_by("project_id", F.struct("updated_at", "project_id")).alias("project_id"))


def queue_view(queue: DataFrame, projects: DataFrame, jobs: DataFrame) -> DataFrame:
    """Queue with project and job facts, in the order the queue is shown (column ``rank``)."""
    q = queue.join(projects.select("project_id", "name", "duration_ms", "media_path"), "project_id").join(
        jobs, "project_id", "left")
    total = F.when(F.col("total_ms") != 0, F.col("total_ms"))
    return q.select(
        "project_id", "position", "queue_state", "created_at", "name", "media_path",
        F.coalesce("processed_ms", F.lit(0)).alias("processed_ms"), F.coalesce(total, F.col("duration_ms")).alias("total_ms"),
        "percent", "stage", F.when(F.col("queue_state") == "running", 0).when(F.col("queue_state") == "queued", 1)
        .otherwise(2).alias("rank")).orderBy("rank", "position", "created_at", "project_id")


def queue_status(queue: DataFrame, slots: int) -> DataFrame:
    c = F.col("queue_state")
    running = F.count_if(c == "running")
    return queue.agg(
        running.alias("running"), F.count_if(c == "queued").alias("waiting"), F.count_if(c == "completed").alias("completed"),
        F.count_if(c.isin("failed", "cancelled")).alias("failed"),
        F.greatest(F.lit(0), F.lit(slots) - running).alias("available"))


def apply_voice_names(segments: DataFrame, assignments: DataFrame) -> DataFrame:
    """Rename a project's cluster: assignments hold project_id, old_name, name, profile_id."""
    a = assignments.select("project_id", F.col("old_name").alias("speaker"), F.col("name").alias("new_name"), "profile_id")
    j = segments.join(a, ["project_id", "speaker"], "left")
    return j.select(*[c for c in segments.columns if c not in ("speaker", "speaker_profile_id")],
                    F.coalesce("new_name", "speaker").alias("speaker"),
                    F.coalesce("profile_id", "speaker_profile_id").alias("speaker_profile_id"))


def insights_if_current(projects: DataFrame, insights: DataFrame) -> DataFrame:
    i = insights.select("project_id", F.col("source_updated_at").alias("updated_at"), "insights")
    return projects.join(i, ["project_id", "updated_at"], "left")


def reliability(samples: Column, duration: Column, projects: Column, match: Column) -> Column:
    part = lambda c, full: F.least(F.greatest(c, F.lit(0)) / full, F.lit(1.0))
    similar = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (match - 0.5) / 0.4)), F.lit(0.0))
    return F.bround(100 * (part(samples, 24.0) * 0.30 + part(duration, 90_000.0) * 0.25
                           + part(projects, 3.0) * 0.20 + similar * 0.25)).cast("long")


def voice_catalog(profiles: DataFrame, samples: DataFrame, segments: DataFrame) -> DataFrame:
    """Per profile: evidence, recognised segments and reliability.  Segments are pre-aggregated."""
    s = samples.groupBy("profile_id").agg(
        F.count_distinct("source_project").alias("source_projects"), F.avg("confidence").alias("sample_confidence"))
    limit = profiles.select("profile_id", "match_threshold")
    m = F.col("speaker_match_confidence")
    r = segments.withColumnRenamed("speaker_profile_id", "profile_id").join(limit, "profile_id").groupBy("profile_id").agg(
        F.count(F.lit(1)).alias("segments"),
        F.sum(F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms"))).alias("duration_ms"),
        F.count_distinct("project_id").alias("projects"),
        F.avg(F.when(m.between(F.col("match_threshold"), 1.0), m)).alias("match_confidence"))
    j = profiles.join(s, "profile_id", "left").join(r, "profile_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    score = reliability(F.col("sample_count"), F.col("total_duration_ms"), zero("source_projects"), F.col("match_confidence"))
    out = j.select(
        "profile_id", "name", "enabled", "sample_count", "total_duration_ms", zero("source_projects").alias("source_projects"),
        "sample_confidence", zero("segments").alias("recognized_segments"), zero("duration_ms").alias("recognized_ms"),
        zero("projects").alias("recognized_projects"), "match_confidence", score.alias("score"))
    return out.withColumn("reliability", F.when(F.col("score") >= 78, "alta").when(F.col("score") >= 48, "buena")
                          .otherwise("aprendiendo")).orderBy(F.desc("enabled"), F.lower("name"))


def speaker_count(segments: DataFrame) -> DataFrame:
    who = F.coalesce(F.struct(F.lit("profile").alias("k"), F.col("speaker_profile_id").cast("string").alias("v")),
                     F.lit(None))
    who = F.when(F.col("speaker_profile_id").isNotNull(), who).otherwise(
        F.struct(F.lit("name").alias("k"), F.coalesce("speaker", F.lit("None")).alias("v")))
    return segments.groupBy("project_id").agg(F.greatest(F.lit(1), F.count_distinct(who)).alias("speakers"))


# --- sets ------------------------------------------------------------------------------------

def speaker_options(segments: DataFrame, profiles: DataFrame) -> DataFrame:
    """Names to choose from: enabled profiles (project_id NULL) and each project's generic names."""
    p = profiles.where("enabled").select("profile_id", "name", F.lower(F.trim("name")).alias("k"))
    again = p.groupBy("k").agg((F.count(F.lit(1)) > 1).alias("twice"))
    known = p.join(again, "k").select(
        F.lit(None).cast("long").alias("project_id"), F.concat(F.lit("profile:"), "profile_id").alias("value"), "name",
        F.concat("name", F.lit(" · perfil local"), F.when(F.col("twice"), F.concat(
            F.lit(" · "), F.left(F.col("profile_id").cast("string"), F.lit(6)))).otherwise("")).alias("label"))
    seen = segments.where(F.col("speaker_profile_id").isNull() & (F.col("speaker") != "")).select(
        "project_id", F.col("speaker").alias("name"))
    defaults = segments.select("project_id").distinct().select(
        "project_id", F.explode(F.array(F.lit("Hablante 1"), F.lit("Hablante 2"))).alias("name"))
    generic = seen.unionByName(defaults).distinct().select(
        "project_id", F.concat(F.lit("speaker:"), "name").alias("value"), "name", F.col("name").alias("label"))
    number = F.regexp_extract("name", r"(\d+)$", 1).try_cast("long")
    return known.unionByName(generic).withColumn("sort_name", F.regexp_replace("name", r"\d+$", "")).withColumn(
        "sort_number", number)


DICTIONARY_WORD = r"[\p{L}\p{N}][\p{L}\p{N}'’-]*"


def learn_dictionary(corrections: DataFrame, newest: int = 300) -> DataFrame:
    """Words a person keeps correcting, per ``owner``.

    ``corrections``: owner, seq (sortable), before, after.  Only corrections with equally many
    words count; a change of case or accents alone teaches nothing.
    """
    words = lambda c: F.regexp_extract_all(F.col(c), F.lit(DICTIONARY_WORD), F.lit(0))
    c = corrections.select("owner", "seq", words("before").alias("old"), words("after").alias("new")).where(
        F.size("old") == F.size("new"))
    w = c.select("owner", "seq", F.posexplode(F.arrays_zip("old", "new")).alias("pos", "w")).where(
        (tx.fold(F.col("w.old")) != tx.fold(F.col("w.new"))) & (F.length("w.new") >= 2))
    at = F.struct("seq", "pos")
    d = w.groupBy("owner", F.lower("w.new").alias("key")).agg(
        F.max_by("w.new", at).alias("word"), F.min(at).alias("seen"))
    order = W.partitionBy("owner").orderBy(F.desc("seen"))
    return d.withColumn("age", F.row_number().over(order)).where(F.col("age") <= newest).drop("seen")


def vocabulary_prompt(existing: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Given terms first, then the learned words in the order learned, without repeats."""
    learned = dictionary.groupBy("owner").agg(F.transform(F.array_sort(F.collect_list(F.struct(
        (-F.col("age")).alias("o"), "word"))), lambda x: x["word"]).alias("learned"))
    given = F.filter(F.transform(F.split("terms", r"[,;\n]+"), lambda t: F.trim(t)), lambda t: t != "")
    return existing.join(learned, "owner", "left").select("owner", F.array_join(F.array_distinct(F.concat(
        given, F.coalesce("learned", F.array().cast("array<string>")))), ", ").alias("prompt"))


def stale_evidence(before: DataFrame, now: DataFrame, rejected: DataFrame) -> DataFrame:
    """(project_id, profile_id) that lost their evidence in a re-analysis without rejections."""
    key = ["project_id", "profile_id"]
    again = now.select("project_id").distinct().join(rejected.select("project_id").distinct(), "project_id", "left_anti")
    gone = before.select(*key).distinct().join(now.select(*key).distinct(), key, "left_anti")
    return gone.join(again, "project_id", "left_semi")
