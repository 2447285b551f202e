"""Mixing sources to target weights by exponential keys, built-in functions only.

Every source's target is its share of all words by weight, with no source above ``MOST`` times its own words; what a source cannot
take is shared again by weight. A source first gives complete epochs. The rest of its target is a weighted sample without replacement
(Efraimidis and Spirakis): every document draws an exponential key whose rate is its quality weight, documents are ordered by key, and
the running sum of their words is followed up to the rest of the target; the document at the boundary is taken if at least half of it
fits. Rows equal in id and text share a key and follow each other on that line, so the boundary may fall among them: then only as many
of them are taken as fit, numbered in a written table.

A hot source is not sorted as a whole: keys are counted in ``BUCKETS`` buckets per source, and only the bucket in which the target is
reached is ordered row by row. The outcome is one row per source (epochs, boundary bucket, boundary key and how many rows of that key),
so all other documents are taken or left where they lie.

Defined results: a null text has no words and follows its key; sources are ranked by code point with null last; a null, zero or
infinite quality weight counts as 1; of rows equal in id and text any may be the ones taken; documents without words come once for
every epoch and once more up to the boundary; a result column replaces a column of the same name; an empty table
gives an empty result. Keys depend on id and text alone, so reruns agree on how often each id and text is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from confab.llm.texts import fresh
from confab.session import cut

MOST = 3
WEIGHTS = (1, 2, 3)
BUCKETS = 4096
NUMBERED = 4_096  # rows of a boundary key that are numbered together
BROADCAST_SOURCES = 100_000  # rows of the source table that may go to every task


def word_count(text: Column) -> Column:
    """Number of runs of anything but ASCII white space."""
    spaced = F.translate(text, "\t\n\x0b\f\r", "     ")
    return F.coalesce(F.size(F.array_remove(F.split(spaced, " "), "")), F.lit(0)).cast("long")


def quality(text: Column, words: Column) -> Column:
    """Weight of a document: 1 where words have five characters on average, less the further they are from that."""
    return F.when(words > 0, 1 / (1 + F.abs(F.log((F.length(text) + 1) / (6.0 * words)))))


def exponential_key(doc_id: Column, text: Column, weight: Column) -> Column:
    """-ln(u) / weight with u from a hash of id and text."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.log(u) / F.when((weight > 0) & (weight < float("inf")), weight).otherwise(1.0)


def _bucket(key: Column) -> Column:
    return F.least(F.lit(BUCKETS - 1), F.floor((1 - F.exp(-key)) * BUCKETS)).cast("int")


def targets(sources: DataFrame, most: int = MOST, weights: tuple = WEIGHTS) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    A source is filled to its cap exactly if its cap per weight is below the common level; sources are visited by that ratio, so
    running sums of caps and of open weights give the level without repeated sharing.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((rank - 1) % len(weights) + 1).cast("int"))
    s = sources.withColumn("weight", weight).withColumn("cap", (most * F.col("source_size")).cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = F.sum("source_size").over(Window.partitionBy())
    full = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("level", (everything - full) / open_weight)
    # levels fall from the first source below its cap on, so the greatest of them is the first
    common = F.max(F.when(F.col("level") < F.col("cap") / F.col("weight"), F.col("level"))).over(Window.partitionBy())
    s = s.withColumn("common", common)
    return s.select("source", "source_size", F.when(F.col("common").isNull(), F.col("cap")).otherwise(
        F.least("cap", F.col("common") * F.col("weight"))).alias("target"))


def _keyed(docs: DataFrame, weight: Column | None) -> tuple[Column, Column]:
    words = word_count(F.col("text"))
    return words, exponential_key(F.col("doc_id"), F.col("text"), quality(F.col("text"), words) if weight is None else weight)


def _decided(slim: DataFrame, most: int, weights: tuple) -> DataFrame:
    """(source, source_size, target, epochs, edge, edge_key) of every source of (source, size, key) rows."""
    slim = slim.withColumn("bucket", _bucket(F.col("key")))
    counts = cut(slim.groupBy("source", "bucket").agg(F.sum("size").alias("size")), "mix_buckets")
    aims = targets(counts.groupBy("source").agg(F.sum("size").alias("source_size")), most, weights).withColumn(
        "epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    aims = cut(aims.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "mix_targets")
    a = aims.select(F.col("source").alias("s"), "rest")
    upto = F.sum("size").over(Window.partitionBy("source").orderBy("bucket"))
    edges = counts.withColumn("before", upto - F.col("size")).join(a, F.col("source").eqNullSafe(F.col("s"))).where(
        (F.col("before") <= F.col("rest")) & (F.col("before") + F.col("size") > F.col("rest"))).select("s", "bucket", "before", "rest")
    edges = cut(edges.withColumnRenamed("bucket", "edge"), "mix_edges")
    inside = slim.join(_small(edges), F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("edge"))).groupBy(
        "s", "key", "before", "rest").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows"), F.max("size").alias("one"))
    sum_before = F.coalesce(F.sum("size").over(Window.partitionBy("s").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = 2 * (F.col("rest") - (F.col("before") + sum_before))
    fit = F.when(F.col("one") > 0, F.floor((room + F.col("one")) / (2 * F.col("one")))).when(room >= 0, F.col("rows")).otherwise(0)
    last = inside.withColumn("fit", F.least("rows", fit.cast("long"))).where("fit > 0").groupBy(F.col("s").alias("t")).agg(
        F.max("key").alias("edge_key"), F.max_by("fit", "key").alias("edge_fit"), F.max_by("rows", "key").alias("edge_rows"))
    joined = aims.join(edges.select("s", "edge"), F.col("source").eqNullSafe(F.col("s")), "left").join(last, F.col("source").eqNullSafe(F.col("t")), "left")
    return cut(joined.select("source", "source_size", "target", "epochs", F.coalesce("edge", F.lit(BUCKETS)).alias("edge"),
                             F.coalesce("edge_key", F.lit(-1.0)).alias("edge_key"), F.coalesce("edge_fit", F.lit(0)).alias("edge_fit"),
                             F.coalesce("edge_rows", F.lit(0)).alias("edge_rows")), "mix_sources")


def _small(table: DataFrame) -> DataFrame:
    """The written source table, sent to every task if its counted rows allow."""
    return F.broadcast(table) if table.count() <= BROADCAST_SOURCES else table


def _copied(rows: DataFrame, key: str, of: dict, decided: DataFrame, out: str) -> DataFrame:
    """``rows`` beside their source's decision (columns named by ``of``) with ``out``, how often the mix takes each."""
    epochs, edge, edge_key, fit, equal = (F.col(of[c]) for c in ("epochs", "edge", "edge_key", "edge_fit", "edge_rows"))
    bucket = _bucket(F.col(key))
    taken = (bucket < edge) | ((bucket == edge) & (F.col(key) <= edge_key))
    if decided.where("edge_fit < edge_rows").isEmpty():
        return rows.withColumn(out, (epochs + F.when(taken, 1).otherwise(0)).cast("int"))
    parted = (bucket == edge) & (F.col(key) == edge_key) & (fit < equal)
    whole = rows.where(~parted).withColumn(out, (epochs + F.when(taken, 1).otherwise(0)).cast("int"))
    uid, block = fresh(rows.columns, "mix_uid"), fresh(rows.columns, "mix_block")
    some = cut(rows.where(parted).withColumn(uid, F.monotonically_increasing_id()), "mix_parted").withColumn(block, F.floor(F.col(uid) / NUMBERED))
    source = F.col(of["source"])
    counts = some.groupBy(source.alias("s"), F.col(block).alias("b")).agg(F.count(F.lit(1)).alias("n"))  # one boundary key per source
    up_to = Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("s", "b", F.coalesce(F.sum("n").over(up_to), F.lit(0)).alias("n")).toDF(
        *(own := [fresh(some.columns, f"mix_before_{c}") for c in "sbn"]))
    nth = F.col(own[2]) + F.row_number().over(Window.partitionBy(own[0], own[1]).orderBy(uid))
    some = some.join(before, source.eqNullSafe(F.col(own[0])) & (F.col(block) == F.col(own[1]))).withColumn(
        out, (epochs + F.when(nth <= fit, 1).otherwise(0)).cast("int"))
    return whole.unionByName(some.select(*whole.columns))


def _slim(docs: DataFrame, weight: Column | None) -> DataFrame:
    words, key = _keyed(docs, weight)
    return cut(docs.select("doc_id", "source", words.alias("size"), key.alias("key")), "mix_keys")


def plan(docs: DataFrame, weight: Column | None = None, most: int = MOST, weights: tuple = WEIGHTS) -> DataFrame:
    """doc_id, size, source_size, target, copies and taken of every row."""
    slim = _slim(docs, weight)
    decided = _decided(slim.select("source", "size", "key"), most, weights)
    of = {c: f"of_{c}" for c in decided.columns}
    rows = slim.join(_small(decided.toDF(*of.values())), F.col("source").eqNullSafe(F.col("of_source")))
    return _copied(rows, "key", of, decided, "copies").select(
        "doc_id", "size", F.col("of_source_size").alias("source_size"), F.col("of_target").alias("target"), F.col("copies").cast("long").alias("copies"),
        (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, weight: Column | None = None, most: int = MOST, weights: tuple = WEIGHTS) -> DataFrame:
    """Every row as often as the mix takes it; columns unchanged."""
    words, key = _keyed(docs, weight)
    decided = _decided(_slim(docs, weight).select("source", "size", "key"), most, weights)
    keep = docs.columns
    names = {c: fresh(keep, f"mix_{c}") for c in decided.columns}
    name = fresh(keep, "mix_key")
    rows = docs.withColumn(name, key).join(_small(decided.toDF(*names.values())), F.col("source").eqNullSafe(F.col(names["source"])))
    copies, one = fresh(rows.columns, "mix_copies"), fresh(rows.columns, "mix_copy")
    rows = _copied(rows, name, names, decided, copies)
    return rows.withColumn(one, F.explode(F.array_repeat(F.lit(1), F.col(copies)))).select(*[F.col(f"`{c}`") for c in keep])


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS size FROM documents),
k AS (
  SELECT *, -ln((('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || text), 1, 13))::BIGINT + CAST(0.5 AS DOUBLE)) / CAST(4503599627370496 AS DOUBLE))
            / coalesce(CASE WHEN size > 0 THEN 1 / (1 + abs(ln((length(text) + 1) / (CAST(6 AS DOUBLE) * size)))) END, 1) AS key FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM k GROUP BY source),
w AS (SELECT *, CAST(3 * source_size AS DOUBLE) AS cap, CAST(1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 AS DOUBLE) AS weight FROM s),
l AS (
  SELECT *, ((SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w WINDOW o AS (ORDER BY cap / weight, encode(source) NULLS LAST)),
t AS (
  SELECT source, source_size, least(cap, coalesce((SELECT max(level) FROM l WHERE level < cap / weight) * weight, cap)) AS target FROM l),
e AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
g AS (
  SELECT source, key, count(*) AS n, max(size) AS one, sum(sum(size)) OVER (PARTITION BY source ORDER BY key) - sum(size) AS before FROM k GROUP BY source, key),
f AS (
  SELECT g.source, g.key, e.source_size, e.target, e.epochs,
         CASE WHEN one > 0 THEN floor((2 * (e.target - e.epochs * e.source_size - before) + one) / (2 * one))
              WHEN before <= e.target - e.epochs * e.source_size THEN n ELSE 0 END AS fit
  FROM g JOIN e ON g.source IS NOT DISTINCT FROM e.source),
c AS (
  SELECT k.doc_id, k.size, f.source_size, f.target,
         f.epochs + CASE WHEN row_number() OVER (PARTITION BY k.source, k.key) <= f.fit THEN 1 ELSE 0 END AS copies
  FROM k JOIN f ON k.source IS NOT DISTINCT FROM f.source AND k.key = f.key)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, CAST(target AS DOUBLE) AS target,
       CAST(copies AS BIGINT) AS copies, CAST(size * copies AS BIGINT) AS taken
FROM c
"""
