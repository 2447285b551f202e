"""Queries over whole inputs, beside those whose check SQL fixes a part."""

import contextlib
import io
from collections import Counter

from pyspark.sql import functions as F

from confab.operators import insights, voice_memory as vm
from confab.plans import load
from confab.plans.voice import learning
from confab.sources import tables

SF = "/root/testdata/sf0.001"
QUERIES, _ = load()


def rows(spark, name):
    return QUERIES[name](spark, SF).collect()


def test_grounded_reports_hold_the_insights_of_whole_texts(spark):
    points, found = rows(spark, "key_points"), rows(spark, "ground_points_whole")
    assert Counter((r.project_id, r.title, r.segment_id) for r in found) == Counter((r.project_id, r.title, r.segment_id) for r in points)
    assert any(len(r.text.split()) > 3 for r in found)
    chapters = rows(spark, "chapters")
    assert {(r.project_id, r.start_ms, r.title) for r in rows(spark, "ground_chapters_whole")} == {(r.project_id, r.start_ms, r.title) for r in chapters}
    top = {(r.project_id, r.label, f"concept-{r.rank}", min(10, r.weight)) for r in rows(spark, "top_concepts")}
    concepts = rows(spark, "ground_concepts_whole")
    assert {(r.project_id, r.label, r.id, r.weight) for r in concepts} == top
    name = {(r.project_id, r.id): r.label.lower() for r in concepts}
    edges = {(r.project_id, name[r.project_id, r.source], name[r.project_id, r.target], r.weight) for r in rows(spark, "ground_edges_whole")}
    assert edges == {(r.project_id, r.source, r.target, min(10, r.weight)) for r in rows(spark, "concept_edges")}


def test_audit_counts_final_states(spark):
    audit = {r["item"]: r.n for r in rows(spark, "learning_audit_whole")}
    g, ok, profiles, _, gate = learning(spark, SF)
    states = Counter(f"status:{r.status}" for r in vm.resolve_profile(gate, ok, profiles).collect())
    assert states and {k: n for k, n in audit.items() if k.startswith("status:")} == states
    assert {k: n for k, n in audit.items() if not k.startswith("status:")} == {r["item"]: r.n for r in rows(spark, "learning_audit")}


def test_written_topic_words_are_not_found_again(spark):
    s = tables.segments(spark, SF)
    p, t = tables.projects(spark, SF, s), insights.with_tokens(s)
    assert t.where(F.size("tokens") > 0).count() > 0
    top = insights.top_concepts(insights.token_rows(s))
    forms = [lambda s: insights.top_concepts(insights.token_rows(s)), lambda s: insights.segment_scores(s), lambda s: insights.chapters(s, p),
             lambda s: insights.concept_edges(s, top)]
    for form in forms:
        assert Counter(map(str, form(s).collect())) == Counter(map(str, form(t).collect()))
    for form in forms[:2]:  # the others read concepts or projects, which are built from the texts
        plan = io.StringIO()
        with contextlib.redirect_stdout(plan):
            form(t).explain()
        assert "regexp_extract_all" not in plan.getvalue()


def test_words_and_upserts_are_dealt_over_parts_that_grow_with_the_text(spark, monkeypatch):
    few = [Counter(map(str, df.collect())) for df in (tables.segments(spark, SF), tables.words(spark, SF), QUERIES["upsert_segments"](spark, SF))]
    conv, cores = tables.read(spark, SF, "conversations"), spark.sparkContext.defaultParallelism
    assert tables.parts(conv) is None
    monkeypatch.setattr(tables, "PART_CHARS", conv.agg(F.sum(F.length("text"))).first()[0] // (2 * cores))
    n = tables.parts(conv)
    assert 2 * cores <= n <= 2 * cores + 1
    assert tables.segments(spark, SF).rdd.getNumPartitions() == n == QUERIES["upsert_segments"](spark, SF).rdd.getNumPartitions()
    assert few == [Counter(map(str, df.collect())) for df in (tables.segments(spark, SF), tables.words(spark, SF), QUERIES["upsert_segments"](spark, SF))]
