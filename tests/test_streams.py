"""Streams over several micro-batches against their batch forms, with restarts and restated rules."""

import random

import pytest
from pyspark.sql import functions as F

from confab.operators import catalog, search, sequence, voice_memory as vm
from confab.streaming import changes, closing, live, recording
from confab.session import scratch_path
from confab.streaming.runner import drain, in_batches, keyed_state
from tests.test_cases import directions, segs


def lines(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def write(df, path):
    df.coalesce(1).write.mode("append").parquet(path)


def test_upserts_with_a_restart_in_the_middle(spark, tmp_path):
    rng = random.Random(3)
    base = spark.createDataFrame([(p, s, "old") for p in range(4) for s in range(5)], "project_id long, segment_id long, text string")
    rows = [(rng.randrange(4), rng.randrange(9), f"t{i}", i, rng.random() < .08) for i in range(90)]
    inc = spark.createDataFrame(rows, "project_id long, segment_id long, text string, seq long, replace_existing boolean")
    source, table, state = (str(tmp_path / n) for n in ("source", "table", "state"))
    for first, last in ((0, 3), (3, 6)):
        for k in range(first, last):
            write(inc.where(F.floor(F.col("seq") / 15) == k), source)
        stream = spark.readStream.schema(inc.schema).option("maxFilesPerTrigger", 1).parquet(source)
        changes.write_upserts(stream, table, state)
        seen = inc.where(F.col("seq") < 15 * last)
        assert lines(changes.upserted(spark, table, base)) == lines(catalog.upsert_segments(base, seen))
    assert any(r[4] for r in rows)


def test_late_names_with_a_restart_in_the_middle(spark, tmp_path):
    x = directions(3, 60, .25)
    rows = [(i % 2, i, 1500, [float(v) for v in r]) for i, r in enumerate(x)]
    u = spark.createDataFrame(rows, "session_id long, unit_id long, duration_ms long, embedding array<double>")
    p = spark.createDataFrame([(i, f"p{i}", [float(v) for v in directions(3, 3, .01)[i]], .64, True) for i in range(2)],
                              "profile_id long, name string, centroid array<double>, match_threshold double, enabled boolean")
    source, table, state = (str(tmp_path / n) for n in ("source", "table", "state"))
    for first, last in ((0, 4), (4, 30)):
        for k in range(first, last, 2 if first == 0 else 13):
            step = 2 if first == 0 else 13
            write(u.where((F.col("unit_id") >= 2 * k) & (F.col("unit_id") < 2 * (k + step))), source)
        stream = spark.readStream.schema(u.schema).option("maxFilesPerTrigger", 1).parquet(source)
        changes.write_names(live.online_identify(stream, p, idle_ms=None), table, state)
    want = live.relabelled(live.online_identify_batch(u, p))
    assert lines(changes.named_units(spark, table)) == lines(want)
    assert live.online_identify_batch(u, p).where("provisional and not named").count() > want.where("provisional").count()


def test_chunk_verdicts_across_batches_and_a_forgotten_session(spark):
    s = 1_000
    rows = [(1, 0, 0, 0, 1600, "ok"), (1, 1, 1, 1 * s, 1600, "ok"), (1, 2, 0, 0, 1600, "ok"), (1, 3, 2, 2 * s, 800, "bad_size"), (1, 4, 3, 100 * s, 1600, "ok"),
            (1, 5, 1, 1 * s, 1600, "ok"), (1, 6, 4, 99 * s, 1600, "ok"), (2, 7, 0, 5 * s, 160, "ok"), (1, 8, 3, 100 * s, 1600, "ok")]
    day = 1_700_000_000 * s  # Spark takes event times before 1970 as late
    rows = [(a, b, c, day + t, *x) for a, b, c, t, *x in rows]
    c = spark.createDataFrame(rows, "session_id long, arrival long, chunk_id long, ts_ms long, samples long, status string")
    want = [(0, "ok", 100), (1, "ok", 200), (2, "duplicate", 200), (3, "bad_size", 200), (4, "ok", 300), (5, "late", 300), (6, "ok", 400), (7, "ok", 10), (8, "duplicate", 400)]
    batch = recording.chunk_verdicts_batch(c, 60 * s)
    assert sorted((r.arrival, r.verdict, r.duration_ms) for r in batch.collect()) == want
    with keyed_state(spark):
        for idle in (None, 24 * 3600 * s):
            out = drain(recording.chunk_verdicts(in_batches(c, F.floor(F.col("arrival") / 2), 5, "chunks"), 60 * s, idle))
            assert lines(out) == lines(batch)
        late = spark.createDataFrame([(9, 0, 0, day + 10_000 * s, 16, "ok"), (1, 1, 0, day + 9_990 * s, 1600, "ok")], c.schema)
        again = c.withColumn("part", F.lit(0)).unionByName(late.withColumn("part", F.col("arrival") + 1))
        out = drain(recording.chunk_verdicts(in_batches(again, F.col("part"), 3, "chunks").drop("part"), 60 * s, 600 * s))
        assert {(r.chunk_id, r.verdict, r.duration_ms) for r in out.where("session_id = 1 and duration_ms = 100").collect()} == {(0, "ok", 100)}
        assert out.where("session_id = 1 and chunk_id = 0 and verdict = 'ok'").count() == 2  # the session was forgotten in between


def test_sessions_close_with_voted_names(spark, tmp_path):
    s = 1_000
    talk = segs(spark, [(0, 900, "Hola a todos", {"speaker_profile_id": 7}), (1000, 1900, "seguimos aquí.", {"speaker_profile_id": 7}), (5000, 6000, "Otra voz.", {"speaker_profile_id": 8})])
    talk = talk.withColumn("speaker_cluster", F.when(F.col("start_ms") < 5000, 1).otherwise(2).cast("long")).withColumnRenamed("project_id", "session_id")
    both = talk.unionByName(talk.withColumn("session_id", F.lit(2).cast("long")))
    votes = [(1, 1, i, 15_000 * i, 2000, .9, 5 if i else 6, .99 if not i else .81) for i in range(6)] + [(1, 2, 10, 0, 500, .9, 5, .9)]
    evidence = spark.createDataFrame(votes, "session_id long, cluster long, sample_id long, start_ms long, duration_ms long, confidence double, profile_id long, match_confidence double")
    moments = spark.createDataFrame([(1, 1 * s), (1, 5 * s), (2, 100 * s), (2, 200 * s), (3, 5_000 * s)], "session_id long, ts_ms long")
    path = str(tmp_path / "closings")
    with keyed_state(spark):
        closed = recording.closed_sessions(in_batches(moments, F.when(F.col("ts_ms") < 50 * s, 0).when(F.col("ts_ms") < 4_000 * s, 1).otherwise(2), 3, "moments"), 600 * s)
        closing.write_closings(closed, both, evidence, path, str(tmp_path / "state"))
    out = closing.closings(spark, path)
    assert lines(out) == lines(closing.closing_report(spark.createDataFrame([(1,), (2,)], "session_id long"), both, evidence))
    assert [(r.order, r.text, r.speaker_cluster, r.profile_id, r.profile_score and round(r.profile_score, 2)) for r in out.where("session_id = 1").orderBy("order").collect()] == [
        (0, "Hola a todos seguimos aquí.", 1, 5, .81), (1, "Otra voz.", 2, None, None)]


@pytest.mark.parametrize("seed", [1])
def test_smoothing_one_long_recording(spark, seed):
    rng = random.Random(seed)
    n = 100_000
    labels, sure = [rng.choice([0, 1, 1, 2]) if i % 1000 < 900 else i % 2 for i in range(n)], [rng.choice([None, 0.0, .3, .74, .74, .74, .9]) for _ in range(n)]
    rows = [(1, i, 700 * i, a, c) for i, (a, c) in enumerate(zip(labels, sure))]
    want, conf = list(labels), list(sure)
    for i in range(1, n - 1):
        if want[i - 1] == labels[i + 1] != labels[i] and (conf[i] or 0) < .75:
            want[i], conf[i] = want[i - 1], min(.7, conf[i] or .5)
    df = spark.createDataFrame(rows, "project_id long, unit_id long, start_ms long, label long, confidence double")
    got = sequence.smooth_labels(df).orderBy("unit_id").collect()
    assert [r.label for r in got] == want and [r.confidence for r in got] == conf


def test_merge_chains_and_circles(spark):
    pairs = [(1, 2), (2, 3), (3, 4), (8, 9), (20, 21), (21, 22), (22, 20), (30, 21), (31, 30), (40, 40), (50, 51), (51, 50), (60, 62), (60, 61)]
    p = spark.createDataFrame(pairs, "source_id long, target_id long")
    got = {r.source_id: (r.root_id, r.cycle) for r in vm.merge_roots(p).collect()}
    assert got == {1: (4, False), 2: (4, False), 3: (4, False), 8: (9, False), 21: (20, True), 22: (20, True), 30: (20, True), 31: (20, True), 51: (50, True), 60: (61, False)}
    chain = spark.createDataFrame([(i, i + 1) for i in range(300)], p.schema)
    assert {r.root_id for r in vm.merge_roots(chain).collect()} == {300}
    assert vm.merge_roots(p.where("false")).count() == 0


def test_similar_profiles_equal_all_pairs(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(size=(40, 1, 6)) + .15 * rng.normal(size=(40, 8, 6))]).reshape(-1, 6)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, [float(c) for c in 3 * v], .9 if i % 2 else .95) for i, v in enumerate(x)] + [(900, None, .9), (901, [1.0, 0.0], .5), (902, [1.0, 0.1], .5), (903, [0.0, 1.0], .5)]
    p = spark.createDataFrame(rows, "profile_id long, centroid array<double>, match_threshold double")
    s = x @ x.T
    for given in (None, .97):
        found, report = vm.similar_profiles(p.where("profile_id < 901"), given, block=16)
        want = {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if s[i, j] >= (given or max(rows[i][2], rows[j][2]))}
        assert {(r.source_id, r.target_id) for r in found.collect()} == want and len(want) > 100
        assert report["kept"] < report["pairs"] / 2  # most block pairs are discarded by angles
    assert {(r.source_id, r.target_id) for r in vm.similar_profiles(p)[0].where("source_id > 900").collect()} == {(901, 902)}
    assert vm.similar_profiles(p.where("false"))[0].count() == 0


def test_search_by_automaton_and_by_joins(spark, monkeypatch):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["casa", "ÁRBOL", "sol", "a%b_c", "luz", "de la"]) for _ in range(rng.randrange(1, 9))) for _ in range(300)]
    rows = [(i % 3, i // 3, i * 10 if i % 5 else None, t) for i, t in enumerate([*texts, None])]
    s = spark.createDataFrame(rows, "project_id long, segment_id long, start_ms long, text string")
    p = spark.createDataFrame([(0, 5), (1, 7), (2, 7)], "project_id long, updated_at int").withColumn("updated_at", F.timestamp_seconds("updated_at"))
    terms = spark.createDataFrame([(1, "árbol"), (1, "so"), (1, "so"), (2, "a%b"), (2, "e la c"), (3, "zzz"), (4, "l"), (4, "a"), (4, "sol luz")], "query_id int, term string")
    whole = search.search_many(s, p, terms, 20)
    out = lines(whole)
    assert whole.groupBy("query_id").count().where("count > 20").count() == 0 and "query_id=3" not in str(out)
    monkeypatch.setattr(search, "CELLS", 50)
    assert lines(search.search_many(s, p, terms, 20)) == out
    monkeypatch.setattr(search, "AUTOMATON_TERMS", 0)
    assert lines(search.search_many(s, p, terms, 20)) == out
    plain = []
    for q in (1, 2, 4):
        own = [t for i, t in [(r.query_id, r.term) for r in terms.collect()] if i == q]
        hit = [(-sum(t in (x or "").lower() for t in own), -[5, 7, 7][pid], st if st is not None else -1, sid, pid) for pid, sid, st, x in rows]
        plain += [(q, k + 1, h[3], h[4], -h[0]) for k, h in enumerate(sorted(h for h in hit if h[0])[:20])]
    assert sorted(map(tuple, whole.select("query_id", "rank", "segment_id", "project_id", "relevance").collect())) == plain
    assert search.search_many(s, p, terms.where("false")).count() == 0


def test_every_core_writes_a_batch_and_a_trigger_takes_one_batch(spark):
    rows = spark.range(400).select("id", F.when(F.col("id") < 300, 0).when(F.col("id") < 301, 1).otherwise(2).alias("part"))
    stream, seen = in_batches(rows, F.col("part"), 3, "parts"), []

    def look(batch, batch_id):
        files = {r.f for r in batch.select(F.input_file_name().alias("f")).distinct().collect()}
        seen.append((batch_id, {r.part for r in batch.select("part").distinct().collect()}, batch.count(), len(files)))

    q = stream.writeStream.foreachBatch(look).option("checkpointLocation", scratch_path(spark, "look")).trigger(availableNow=True).start()
    q.awaitTermination()
    cores = spark.sparkContext.defaultParallelism
    assert seen == [(0, {0}, 300, cores), (1, {1}, 1, 1), (2, {2}, 99, cores)]
