"""Tie analysis notes (JSON produced elsewhere) to the recording they describe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from confab.functions.text import clean_text
from confab.operators.temporal import locate_positions

_ITEM = "struct<title:string,text:string,detail:string,description:string,startMs:string>"
REPORT_SCHEMA = (f"struct<keyPoints:array<{_ITEM}>,chapters:array<{_ITEM}>,concepts:array<struct<label:string,weight:string>>,"
                 "conceptEdges:array<struct<source:string,target:string,weight:string>>>")
NOTE_SCHEMA = f"struct<keyEvents:array<{_ITEM}>,signals:map<string,string>>"
SIGNALS = ("questions", "agreements", "affectionMarkers", "tensionMarkers")


def parse(df: DataFrame, schema: str) -> DataFrame:
    """Replace the JSON text column ``payload`` by its fields; broken JSON gives NULL fields."""
    keys = [c for c in df.columns if c != "payload"]
    return df.select(*keys, F.from_json("payload", schema).alias("p")).select(*keys, "p.*")


def _items(df: DataFrame, field: str, first: int, keys: list[str]) -> DataFrame:
    return df.select(*keys, F.posexplode(F.slice(field, 1, first)).alias("n", "i")).where(F.col("i").isNotNull())


def _snap(items: DataFrame, segments: DataFrame) -> DataFrame:
    """Add the segment (s_id, s_start, s_end, s_text) starting nearest to each item's startMs."""
    firsts = segments.groupBy("project_id").agg(F.min_by("start_ms", "segment_order").alias("first_ms"))
    at = items.join(firsts, "project_id").select(
        "project_id", F.col("item_id").alias("marker_id"),
        F.coalesce(F.col("i.startMs").try_cast("long"), F.col("first_ms")).alias("time_ms"))
    near = locate_positions(at, segments).select("project_id", F.col("marker_id").alias("item_id"), F.col("nearest").alias("s_id"))
    s = segments.select("project_id", F.col("segment_id").alias("s_id"), F.col("start_ms").alias("s_start"),
                        F.col("end_ms").alias("s_end"), F.col("text").alias("s_text"))
    return items.join(near, ["project_id", "item_id"]).join(s, ["project_id", "s_id"])


def _or(c: Column, other: Column) -> Column:
    return F.when(c != "", c).otherwise(other)


def ground_points(reports: DataFrame, notes: DataFrame, segments: DataFrame) -> DataFrame:
    """Key points with their segment, in time order; without usable ones the notes' first events."""
    p = _items(reports, "keyPoints", 12, ["project_id"]).withColumn("item_id", F.col("n").cast("long"))
    title, text = clean_text(F.col("i.title"), 100), clean_text(F.col("i.text"), 440)
    p = _snap(p.where((title != "") & (text != "")), segments).select(
        "project_id", "item_id", title.alias("title"), text.alias("text"), "s_id", "s_start", "s_end")
    e = _items(notes, "keyEvents", 2, ["project_id", "note"]).join(
        p.select("project_id").distinct(), "project_id", "left_anti").withColumn("item_id", F.col("note") * 10 + F.col("n"))
    e = _snap(e, segments).select(
        "project_id", "item_id", _or(clean_text(F.col("i.title"), 100), F.lit("Punto clave")).alias("title"),
        _or(clean_text(F.col("i.detail"), 440), F.col("s_text")).alias("text"), "s_id", "s_start", "s_end")
    order = W.partitionBy("project_id").orderBy("s_start", "item_id")
    return p.unionByName(e).select(
        "project_id", F.row_number().over(order).alias("rank"), "title", "text", F.col("s_id").alias("segment_id"),
        F.col("s_start").alias("start_ms"), F.col("s_end").alias("end_ms"))


def ground_chapters(reports: DataFrame, segments: DataFrame, durations: DataFrame) -> DataFrame:
    """At most ten chapters at segment starts, each lasting to the next one or the end."""
    c = _snap(_items(reports, "chapters", 10, ["project_id"]).withColumn("item_id", F.col("n").cast("long")), segments)
    first = c.groupBy("project_id", "s_start").agg(F.min_by(F.struct(
        _or(clean_text(F.col("i.title"), 110), F.lit("Tramo de la conversación")).alias("title"),
        _or(clean_text(F.col("i.description"), 360), F.col("s_text")).alias("description")), "item_id").alias("c"))
    ends = segments.groupBy("project_id").agg(F.max_by("end_ms", "segment_order").alias("last_end")).join(
        durations, "project_id").select("project_id", F.greatest("duration_ms", "last_end").alias("total"))
    order = W.partitionBy("project_id").orderBy("s_start")
    return first.join(ends, "project_id").select(
        "project_id", "c.title", "c.description", F.col("s_start").alias("start_ms"),
        F.greatest("s_start", F.coalesce(F.lead("s_start").over(order), F.col("total"))).alias("end_ms"))


def _weight(c: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(10), F.coalesce(c.try_cast("int"), F.lit(1))))


def ground_concepts(reports: DataFrame) -> DataFrame:
    c = _items(reports, "concepts", 12, ["project_id"])
    label = clean_text(F.col("i.label"), 60)
    c = c.select("project_id", "n", label.alias("label"), F.lower(label).alias("folded"), _weight(F.col("i.weight")).alias("weight")).where(
        F.col("label") != "")
    first = c.groupBy("project_id", "folded").agg(F.min_by(F.struct("n", "label", "weight"), "n").alias("c"))
    order = W.partitionBy("project_id").orderBy("c.n")
    return first.select("project_id", F.concat(F.lit("concept-"), F.row_number().over(order)).alias("id"), "folded",
                        "c.label", "c.weight")


def ground_edges(reports: DataFrame, concepts: DataFrame) -> DataFrame:
    """Edges between known concepts, no loops, the first of equal directed pairs."""
    e = _items(reports, "conceptEdges", 20, ["project_id"]).select(
        "project_id", "n", F.lower(clean_text(F.col("i.source"), 60)).alias("s"), F.lower(clean_text(F.col("i.target"), 60)).alias("t"),
        _weight(F.col("i.weight")).alias("weight"))
    side = lambda a, b: concepts.select("project_id", F.col("folded").alias(a), F.col("id").alias(b))
    j = e.join(side("s", "source"), ["project_id", "s"]).join(side("t", "target"), ["project_id", "t"])
    return j.where(F.col("source") != F.col("target")).groupBy("project_id", "source", "target").agg(
        F.min_by("weight", "n").alias("weight"))


def note_signal_totals(notes: DataFrame) -> DataFrame:
    value = lambda k: F.greatest(F.lit(0), F.coalesce(
        F.try_element_at("signals", F.lit(k)).try_cast("long"), F.lit(0)))
    return notes.groupBy("project_id").agg(*[F.sum(value(k)).alias(k) for k in SIGNALS])
