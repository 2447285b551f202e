"""Hand-made inputs with exact expectations, one small case per behaviour."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from confab.functions import privacy, review, text
from confab.operators import catalog, export, insights, matching, search, sequence, temporal, voice_memory as vm
from confab.sources import media
from confab.streaming import recording

SEG = ("project_id long, segment_id long, segment_order long, start_ms long, end_ms long, text string, speaker string, "
       "speaker_profile_id long, confidence double, speaker_confidence double, speaker_match_confidence double, "
       "review_state string, speaker_review_state string")


def segs(spark, rows):
    """rows: (start, end, text, {other columns})."""
    out = []
    for i, (s, e, t, *more) in enumerate(rows):
        x = {"project_id": 1, "segment_id": i, "segment_order": i, "start_ms": s, "end_ms": e, "text": t, "speaker": None,
             "speaker_profile_id": None, "confidence": None, "speaker_confidence": None, "speaker_match_confidence": None,
             "review_state": None, "speaker_review_state": None, **(more[0] if more else {})}
        out.append(tuple(x[c.split()[0]] for c in SEG.split(", ")))
    return spark.createDataFrame(out, SEG)


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_paragraphs_join_and_break(spark):
    p = sequence.group_paragraphs(segs(spark, [
        (0, 1800, "Esta es una idea"), (1900, 3600, "que continúa aquí"), (3700, 5100, "y termina ahora."),
        (7000, 8500, "Este es otro párrafo.")])).orderBy("order").collect()
    assert [(r.start_ms, r.end_ms, r.members) for r in p] == [(0, 5100, 3), (7000, 8500, 1)]
    assert p[0].text == "Esta es una idea que continúa aquí y termina ahora."


def test_paragraphs_break_on_speaker_and_length(spark):
    assert sequence.group_paragraphs(segs(spark, [
        (0, 900, "hola", {"speaker": "Ana"}), (900, 1500, "sí", {"speaker": "Luis"})])).count() == 2
    rows = [(i * 1000, i * 1000 + 1000, "texto repetido") for i in range(60)]
    p = sequence.group_paragraphs(segs(spark, rows), max_ms=10_000).collect()
    assert len(p) > 1 and sum(r.members for r in p) == 60
    assert all(r.end_ms - r.start_ms <= 10_000 for r in p)


def test_paragraph_confidence_is_the_lowest(spark):
    p = sequence.group_paragraphs(segs(spark, [
        (0, 500, "uno", {"confidence": 0.9}), (500, 900, "dos", {"confidence": 0.68})])).collect()
    assert len(p) == 1 and p[0].confidence == 0.68 and "84 %" in p[0].review_reasons[0]


def test_ignored_review_reads_as_accepted(spark):
    p = sequence.group_paragraphs(segs(spark, [(0, 500, "uno", {"review_state": "ignored"})])).first()
    assert p.review_state == "accepted"


def test_privacy(spark):
    t = "Escribe a ana@example.com o llama al 612 345 678. DNI 12345678Z."
    d = spark.createDataFrame([(1, t)], "id long, text string")
    assert sorted(r.kind for r in privacy.find_sensitive(d, ["id"]).collect()) == ["dni", "email", "phone"]
    assert d.select(privacy.redact(F.col("text")).alias("t")).first().t == (
        "Escribe a [CORREO] o llama al [TELÉFONO]. DNI [DOCUMENTO].")


def test_card_takes_one_separator_and_needs_the_checksum(spark):
    redact = lambda t: one(spark, privacy.redact(F.lit(t)))
    assert redact("paga 4111 1111 1111 1111 y ya") == "paga [TARJETA]y ya"
    assert redact("paga 4111 1111 1111 1112 y ya") == "paga 4111 1111 1111 1112 y ya"


def test_mask(spark):
    assert [one(spark, privacy.mask(F.lit(v))) for v in ("abcd", "abcdef")] == ["••••", "ab••ef"]


def test_mojibake(spark):
    d = spark.createDataFrame([("Â¿QuÃ© tal estÃ¡s?",), ("El continente es Ã�frica",), ("mÃ¡s €",), ("limpio",)], "t string")
    assert [r.t for r in text.repair_mojibake(d, ["t"]).collect()] == [
        "¿Qué tal estás?", "El continente es África", "mÃ¡s €", "limpio"]


def test_tokens(spark):
    tokens = lambda t: one(spark, text.all_tokens(F.lit(t)))
    assert tokens("La reunión está en el Ático, sí: están TODOS") == ["reunion", "atico", "estan"]


def test_fold_matches_python(spark):
    words = ["Ñandú", "STRASSE straße", "Ελλάδα", "Đức Việt", "ÇA", "naïve"]
    d = spark.createDataFrame([(w,) for w in words], "w string")
    got = d.select(text.fold(F.col("w")).alias("a"), text.fold_nfkd("w").alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got] == [text.py_fold(w) for w in words]


def test_clocks(spark):
    assert one(spark, text.subtitle_time(F.lit(3_723_456), ",")) == "01:02:03,456"
    assert one(spark, text.minute_clock(F.lit(3_723_456))) == "62:03"
    assert one(spark, text.short_clock(F.lit(3_723_456))) == "01:02:03"


def test_cues(spark):
    t = "Esta frase muy larga debe dividirse en varios subtítulos fáciles de leer"
    c = sequence.subtitle_cues(segs(spark, [(1000, 7000, t)]), 18, 1).orderBy("n").collect()
    assert len(c) >= 3 and c[0].start_ms == 1000 and c[-1].end_ms == 7000
    assert " ".join(r.text for r in c) == t and all(len(r.text) <= 18 for r in c)
    assert all(a.end_ms == b.start_ms for a, b in zip(c, c[1:]))


def test_srt_and_csv(spark):
    s = segs(spark, [(-1, 0, 'Hola, "mundo"', {"speaker": "Ana"})])
    assert export.render_transcripts(s, "srt").first().text == '1\n00:00:00,000 --> 00:00:00,001\n[Ana] Hola, "mundo"\n'
    assert export.render_transcripts(s, "vtt").first().text.startswith("WEBVTT\n\n00:00:00.000")
    assert export.render_transcripts(s, "csv").first().text.endswith('-1,0,Ana,"Hola, ""mundo"""\r\n')


@pytest.mark.parametrize("fmt", export.FORMATS)
def test_parts_of_a_long_export_join_to_the_whole(spark, monkeypatch, fmt):
    s = segs(spark, [(i * 1000, i * 1000 + 900, f"t{i}") for i in range(7)])
    whole = export.render_transcripts(s, fmt).collect()
    monkeypatch.setattr(export, "PART_SIZE", 3)
    parts = export.render_transcripts(s, fmt).orderBy("part").collect()
    assert len(whole) == 1 and [p.part for p in parts] == [0, 1, 2]
    assert "".join(p.text for p in parts) == whole[0].text
    if fmt == "json":
        assert len(json.loads(whole[0].text)["project"]["segments"]) == 7
    if fmt == "txt":
        assert whole[0].text == "\n\n".join(f"t{i}" for i in range(7))


def test_nesting_and_flattening_long_recordings(spark):
    """A segment of 25 minutes fills three word rows, five segments three parts; both come back whole."""
    from confab.operators import catalog

    s = segs(spark, [(0, 1_500_000, "long")] + [(1_500_000 + i * 1000, 1_500_900 + i * 1000, f"t{i}") for i in range(4)])
    s = s.withColumn("segment_order", F.lit(None).cast("long"))
    w = spark.createDataFrame([(1, 0, i, f"w{i}", i * 60_000 + 650_000 * (i > 4), i * 60_000 + 650_100, .9) for i in range(14)],
                              "project_id long, segment_id long, pos long, word string, start_ms long, end_ms long, probability double")
    p = spark.createDataFrame([(1, "one")], "project_id long, name string")
    nested = catalog.nest_projects(p, s, w, part_size=2)
    assert nested.count() == 3
    back, words = catalog.flatten_projects(nested)
    assert sorted(r.segment_order for r in back.collect()) == [0, 1, 2, 3, 4] and words.count() == 14


def test_bucket_writer_keeps_other_projects(spark, tmp_path):
    from confab.operators import catalog

    rows = lambda ids, t: spark.createDataFrame([(i, t) for i in ids], "project_id long, text string")
    path = str(tmp_path / "table")
    catalog.write_by_bucket(rows(range(20), "old"), path, 2)
    catalog.write_by_bucket(rows([3, 30], "new"), path, 2)
    got = {r.project_id: r.text for r in spark.read.parquet(path).collect()}
    assert got == {**{i: "old" for i in range(20)}, 3: "new", 30: "new"}


def test_bundles_of_projects_with_equal_file_names(spark):
    projects = spark.createDataFrame([(1, "a/x.wav"), (2, "b/x.wav"), (3, "c/x.wav")], "project_id long, media_path string")
    media = spark.createDataFrame([("a/x.wav", "h1"), ("b/x.wav", "h2")], "path string, sha256 string")
    got = sorted((r.project_id, r.media_included, r.media_name, r.media_sha256) for r in export.bundle_manifest(projects, media).collect())
    assert got == [(1, True, "x.wav", "h1"), (2, True, "x.wav", "h2"), (3, False, None, None)]


def test_speakers_from_units_with_text_ids(spark):
    s = segs(spark, [(0, 4000, "edited")])
    u = spark.createDataFrame([(1, "1-voice-0", 0, 2000, "Ana", .9, 1, .8, 0, True), (1, "1-voice-1", 2000, 4000, "Luis", .9, 2, .8, 1, False)],
                              "project_id long, unit_id string, start_ms long, end_ms long, speaker string, speaker_confidence double, speaker_profile_id long, "
                              "speaker_match_confidence double, cluster long, speaker_provisional boolean")
    r = temporal.transfer_speakers(s, u).first()
    assert (r.speaker, r.text, r.speaker_provisional) == ("Ana", "edited", True)


def test_ranges(spark):
    r = spark.createDataFrame([(1, 4000, 5000), (1, 1000, 3000), (1, 2500, 4500), (2, 1000, 2000), (2, 4000, 5000)],
                              "project_id long, start_ms long, end_ms long")
    m = temporal.merge_ranges(r)
    d = spark.createDataFrame([(1, 5000), (2, 6000)], "project_id long, duration_ms long")
    assert sorted(tuple(x) for x in m.collect()) == [(1, 1000, 5000), (2, 1000, 2000), (2, 4000, 5000)]
    assert sorted((x.start_ms, x.end_ms) for x in temporal.complement_ranges(m, d).where("project_id = 2").collect()) == [
        (0, 1000), (2000, 4000), (5000, 6000)]


def test_positions(spark):
    s = segs(spark, [(500, 1000, "a"), (1300, 2200, "b"), (3000, 4000, "c")])
    t = [700, 1100, 2500, 0, 9000, 3999, 4000]
    pos = spark.createDataFrame([(1, i, v) for i, v in enumerate(t)], "project_id long, marker_id long, time_ms long")
    got = {r.time_ms: r for r in temporal.locate_positions(pos, s).collect()}
    assert [got[v].active for v in t] == [0, None, None, None, None, 2, None]
    assert [got[v].follow for v in t] == [0, 1, 2, 0, 2, 2, 2]
    assert [got[v].nearest for v in (1100, 0, 9000)] == [1, 0, 2]


def test_transfer_keeps_edited_text(spark):
    s = segs(spark, [(0, 4000, "texto editado", {"review_state": "corrected", "speaker": "Hablante 1", "speaker_review_state": "accepted"})])
    u = spark.createDataFrame([(1, 1, 0, 4000, "Isabel", 0.9, None, None, 0)],
                              "project_id long, unit_id long, start_ms long, end_ms long, speaker string, speaker_confidence double, "
                              "speaker_profile_id long, speaker_match_confidence double, cluster long")
    r = temporal.transfer_speakers(s, u).first()
    assert (r.text, r.speaker, r.review_state, r.speaker_review_state) == ("texto editado", "Isabel", "corrected", None)


def test_fill_and_smooth(spark):
    rows = [(1, i, i * 1000, lab, c) for i, (lab, c) in enumerate(zip([0, 1, 0, None, 1], [.9, .58, .88, None, .82]))]
    u = spark.createDataFrame(rows, "project_id long, unit_id long, start_ms long, label long, confidence double")
    r = sequence.smooth_labels(sequence.fill_labels(u)).orderBy("unit_id").collect()
    assert [x.label for x in r] == [0, 0, 0, 0, 1] and r[1].confidence == .58 and r[3].confidence == .5


def test_smoothing_sees_its_own_results(spark):
    rows = [(1, i, i * 1000, lab, .6) for i, lab in enumerate([0, 1, 0, 1, 0])]
    u = spark.createDataFrame(rows, "project_id long, unit_id long, start_ms long, label long, confidence double")
    assert [x.label for x in sequence.smooth_labels(u).orderBy("unit_id").collect()] == [0] * 5


def test_review_filters(spark):
    s = segs(spark, [(0, 1, "a", {"confidence": .5, "review_state": "accepted", "speaker_confidence": .5}), (1, 2, "b", {"confidence": .5}), (2, 3, "c", {})])
    r = s.select(review.needs_text_review().alias("t"), review.needs_speaker_review().alias("v")).collect()
    assert [(x.t, x.v) for x in r] == [(False, True), (True, False), (False, False)]


def test_search_and_phrases(spark):
    s = segs(spark, [(0, 1, "La reunión trata sobre el presupuesto anual"), (1, 2, "otra cosa")])
    p = spark.createDataFrame([(1, "x", "m", 0)], "project_id long, name string, media_path string, updated_at long")
    assert [r.segment_id for r in search.search_transcripts(s, p, "presupuesto vacaciones").collect()] == [0]
    terms = spark.createDataFrame([(7, 0, "presupuesto anual"), (7, 1, "UPUES".lower()), (8, 0, "nada")], "query_id long, n int, term string")
    assert [(r.query_id, r.segment_id, r.relevance) for r in search.search_many(s, p, terms).collect()] == [(7, 0, 2)]


def test_citations(spark):
    ctx = spark.createDataFrame([(1, "s1", 1000, 4000, "uno")], "project_id long, segment_id string, start_ms long, end_ms long, text string")
    a = spark.createDataFrame([(1, 1, [("s1", ""), ("invented", "x")])],
                              "project_id long, answer_id long, citations array<struct<segment_id:string,excerpt:string>>")
    r = search.ground_citations(a, ctx).collect()
    assert [(x.segment_id, x.start_ms, x.end_ms, x.excerpt) for x in r] == [("s1", 1000, 4000, "uno")]


def test_upsert_replaces_then_accumulates(spark):
    cur = spark.createDataFrame([(1, 1, "old"), (1, 2, "old")], "project_id long, segment_id long, text string")
    inc = spark.createDataFrame([(1, 5, "a", 0, True), (1, 6, "b", 1, False), (1, 5, "c", 2, False)],
                                "project_id long, segment_id long, text string, seq long, replace_existing boolean")
    assert sorted((r.segment_id, r.text) for r in catalog.upsert_segments(cur, inc).collect()) == [(5, "c"), (6, "b")]


def test_merge_segments_never_invents_a_speaker(spark):
    s = segs(spark, [(0, 1000, "uno", {"speaker": "Ana", "confidence": .9, "review_state": "accepted"}),
                     (1000, 2000, "dos", {"speaker": "Luis", "confidence": .7, "review_state": "corrected"}), (2000, 3000, "tres")])
    req = spark.createDataFrame([(1, 0)], "project_id long, segment_id long")
    r = sequence.merge_segments(s, req).orderBy("segment_order").collect()
    assert [x.text for x in r] == ["uno dos", "tres"]
    assert (r[0].speaker, r[0].confidence, r[0].review_state, r[0].speaker_provisional) == (None, .7, "corrected", True)


def directions(k, n, noise=0.05, seed=3):
    rng = np.random.default_rng(seed)
    base = np.linalg.qr(rng.normal(size=(16, k)))[0].T
    x = np.repeat(base, n // k, axis=0) + rng.normal(size=(n, 16)) * noise
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def unit_rows(spark, x, project=1):
    return spark.createDataFrame([(project, i, i * 1000, 1500, [float(v) for v in r]) for i, r in enumerate(x)],
                                 "project_id long, unit_id long, start_ms long, duration_ms long, embedding array<double>")


def test_speaker_count(spark):
    d = unit_rows(spark, directions(3, 12)).unionByName(unit_rows(spark, directions(1, 6, .01), 2))
    assert {r.project_id: r.voices for r in matching.estimate_speaker_count(d).collect()} == {1: 3, 2: 1}


def test_kmeans_of_few_and_of_single_clusters(spark):
    d = unit_rows(spark, directions(4, 40, .2)).unionByName(unit_rows(spark, directions(1, 2, .3, 9), 2))
    one = matching.spherical_kmeans(d, 1).collect()
    assert len(one) == 42 and {(r.cluster, r.confidence) for r in one} == {(0, .86)}
    four = matching.spherical_kmeans(d, 4).collect()
    groups = [{r.cluster for r in four if r.project_id == 1 and r.unit_id // 10 == g} for g in range(4)]
    assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 4
    assert sorted(r.cluster for r in four if r.project_id == 2) == [0, 1]


def test_two_directions_pair_up(spark):
    r = matching.spherical_kmeans(unit_rows(spark, directions(2, 4, .01)), 2).orderBy("unit_id").collect()
    assert r[0].cluster == r[1].cluster != r[2].cluster == r[3].cluster and all(x.confidence >= .72 for x in r)


def test_profile_blocks_equal_one_matrix(spark):
    """Profiles and vectors of two widths, NULL vectors and one of a width that no profile has."""
    x, p = directions(4, 40, .4), directions(8, 8, .2, 5)
    vec = lambda v: [float(y) for y in v]
    rows = [(i, f"p{i}", vec(r), .64, True) for i, r in enumerate(p)] + [(100 + i, "narrow", vec(r[:5]), .64, True) for i, r in enumerate(p[:4])]
    prof = spark.createDataFrame(rows, "profile_id long, name string, centroid array<double>, match_threshold double, enabled boolean")
    extra = spark.createDataFrame([(1, 900, 0, 1, vec(p[2][:5])), (1, 901, 0, 1, None), (1, 902, 0, 1, [1.0, 2.0])],
                                  "project_id long, unit_id long, start_ms long, duration_ms long, embedding array<double>")
    u = unit_rows(spark, x).unionByName(extra)
    short = lambda v: None if v is None else round(v, 9)
    got = [sorted((r.unit_id, r.best_profile, short(r.score), short(r.runner_up), short(r.margin)) for r in matching.top_profiles(u, prof, matrix_bytes=b).collect())
           for b in (64 << 20, 3 * 16 * 8, 1)]
    assert got[0] == got[1] == got[2] and len(got[0]) == 43
    by = {r[0]: r for r in got[0]}
    assert by[900][1] == 102 and by[901][1:] == by[902][1:] == (None, None, None, None)


def test_new_profiles_do_not_depend_on_the_block(spark):
    """Sixty voices against the sequence written down, settled at once and in blocks of one, five and seven."""
    rng = np.random.default_rng(4)
    x = directions(12, 60, .5, 3)[rng.permutation(60)]
    x = np.vstack([x[:50], x[:10] + 0.01])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i // 3, i % 3, [float(v) for v in r], ["a", "b", "c"], .9, .3 if i % 4 else None, .1 if i % 8 else None) for i, r in enumerate(x)]
    d = spark.createDataFrame(rows, "project_id long, cluster long, centroid array<double>, kept array<string>, coherence double, score double, runner_up double")
    want, openers = [], []
    for i, v in enumerate(x):
        near = sorted(((float(v @ x[o]), -n) for n, o in enumerate(openers)), reverse=True)
        rivals = [s for s, _ in near[1:]] + [s for s in rows[i][5:7] if s is not None]
        fits = near and near[0][0] >= max(.655, .70 if rivals else .72) and (not rivals or near[0][0] - max(rivals) >= .035)
        if not fits:
            openers.append(i)
        want.append((i // 3, i % 3, 1 - near[0][1] if fits else len(openers), not fits))
    assert 5 < len(openers) < 60
    for block in (4_096, 1 + 4, 7, 23):
        assert sorted((r.project_id, r.cluster, r.profile_id, r.opened) for r in vm.new_profiles(d, block=block).collect()) == want


def test_one_peak_does_not_win_a_vote(spark):
    e = [(1, 1, 1, 1500, .9, .99)] + [(1, 1, 2, 1500, .9, .81)] * 5
    d = spark.createDataFrame(e, "session_id long, cluster long, profile_id long, duration_ms long, confidence double, match_confidence double")
    r = matching.cluster_identity_vote(d).first()
    assert r.profile_id == 2 and abs(r.score - .81) < 1e-9


def samples(spark, n, **fixed):
    x = {"project_id": 1, "cluster": 1, "confidence": .9, "duration_ms": 1000, **fixed}
    return spark.createDataFrame([(x["project_id"], x["cluster"], i, i * 1000, x["duration_ms"], x["confidence"]) for i in range(n)],
                                 "project_id long, cluster long, sample_id long, start_ms long, duration_ms long, confidence double")


def test_diverse_selection_spans_the_recording(spark):
    ids = sorted(r.sample_id for r in vm.temporally_diverse(samples(spark, 48), ["project_id", "cluster"]).collect())
    assert len(ids) == 24 and ids[0] <= 1 and ids[-1] >= 46


def test_profile_cap_takes_projects_in_turn(spark):
    rows = [(1, p, p * 100 + i, p * 100 + i, 1000, .9, 0) for p in range(7) for i in range(24)]
    d = spark.createDataFrame(rows, "profile_id long, source_project long, source_segment long, sample_id long, duration_ms long, confidence double, created_at long")
    kept = vm.round_robin_cap(vm.dedupe_samples(d)).collect()
    assert len(kept) == 160 and len({r.source_project for r in kept}) == 7


def test_bounded_evidence_covers_an_hour(spark):
    d = samples(spark, 3600).withColumnRenamed("project_id", "session_id").withColumn("match_confidence", F.lit(.8))
    at = sorted(r.start_ms for r in vm.bounded_evidence(d).collect())
    assert len(at) <= 48 and len({t // 15_000 for t in at}) > 35 and at[-1] - at[0] > 3_400_000


def test_bounded_evidence_equals_a_plain_greedy_choice(spark):
    rng = np.random.default_rng(1)
    at = np.unique(np.sort((rng.beta(1, 6, 400) * 3_600_000).astype(int)))
    rows = [(1, 1, i, int(t), 1000, float(rng.uniform(.5, 1)), .8) for i, t in enumerate(at)]
    d = spark.createDataFrame(rows, "session_id long, cluster long, sample_id long, start_ms long, duration_ms long, confidence double, match_confidence double")
    best = {r.sample_id: r for r in vm.best_per_bucket(d).collect()}
    left, want = dict(best), []
    for m in np.linspace(min(r.start_ms for r in best.values()), max(r.start_ms for r in best.values()), 20):
        i = min(left, key=lambda k: (abs(left[k].start_ms - m), -left[k].quality, left[k].start_ms))
        want.append(i)
        del left[i]
    assert sorted(r.sample_id for r in vm.bounded_evidence(d, 20).collect()) == sorted(want)


def test_merge_chains(spark):
    p = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (8, 9)], "source_id long, target_id long")
    assert {r.source_id: r.root_id for r in vm.merge_roots(p).collect()} == {1: 4, 2: 4, 3: 4, 8: 9}


def test_reliability(spark):
    score = one(spark, catalog.reliability(F.lit(32), F.lit(64_000), F.lit(4), F.lit(.94)))
    assert score >= 78


def test_recording_chunks(spark):
    rows = [(1, "AAAA"), (1, "not-base64"), (1, "AA=="), (1, ""), (-1, "AAAA"), (1, "AAA"), (1, "AAA=")]
    d = spark.createDataFrame(rows, "chunk_id long, pcm_base64 string")
    assert [r.status for r in recording.validate_chunks(d).collect()] == [
        "bad_size", "bad_base64", "bad_size", "bad_size", "bad_id", "bad_base64", "ok"]


def test_media_listing(spark, tmp_path):
    for n in ("a.WAV", "b.mp4", "notes.txt"):
        (tmp_path / n).write_bytes(b"x")
    r = media.media_inventory(media.list_files(spark, str(tmp_path))).collect()
    assert sorted((x.display_name, x.kind) for x in r) == [("a", "audio"), ("b", "video")]


def test_bucket_overwrite_touches_only_given_projects(spark, tmp_path):
    path = str(tmp_path / "t")
    old = spark.createDataFrame([(i, "old") for i in range(20)], "project_id long, text string")
    catalog.write_by_bucket(old, path, 4)
    bucket = F.pmod(F.hash("project_id"), F.lit(4))
    b = old.where("project_id = 3").select(bucket.alias("b")).first().b
    catalog.write_by_bucket(old.where(bucket == b).withColumn("text", F.lit("new")), path, 4)
    back = spark.read.parquet(path)
    assert back.count() == 20 and back.where("text = 'new'").select("bucket").distinct().count() == 1


def test_key_points_exact_path_equals_the_first_look(spark):
    rng = np.random.default_rng(2)
    words = ["casa", "perro", "gato", "mesa", "silla", "libro", "árbol", "coche"]
    rows = [(i * 1000, i * 1000 + 900, " ".join(rng.choice(words[: 3 + i % 4], 3))) for i in range(90)]
    scores = insights.segment_scores(segs(spark, rows))
    pick = lambda look: sorted((r.pick, r.segment_order) for r in insights.pick_key_points(scores, 8, look).collect())
    assert pick(90) == pick(4)
