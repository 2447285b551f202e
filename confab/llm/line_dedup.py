"""Deduplication of runs of lines by content-defined chunks, built-in functions only.

Every line has a hash, every pair of neighbouring lines a rolling hash; a chunk ends after a line whose rolling hash is lower than both
of its neighbours'. Such boundaries depend on four lines only, so they return to step after an insertion, and two of them are at least
two lines apart. A chunk of ``LINES`` or more lines that occurs again anywhere is removed except at its first place (smallest doc_id,
then position). Hashes only propose: the chunks of repeated hashes are grouped by their bytes before anything is removed.

The first pass moves hashes only (counted inside tasks before the shuffle, so a chunk that a third of all documents share is one row
per task); texts move only for chunks whose hash is repeated.

Defined results: a null text stays null; a text without a line break is one line; equal rows (id and text) are one place, so both keep
or lose a chunk; a null id comes after all others; a chunk of one line always stays, empty lines are lines; a text that loses all
chunks becomes empty; columns are unchanged but for ``text``; an empty table gives an empty result.

``dedupe`` leaves what no two boundaries enclose: short passages, and the edges of long ones. ``dedupe_passages`` removes these as well.
Its spans are the chunks and, from every line on and back from every line, the fewest lines of over ``LONG_WORDS`` words (a line counts as
one word at least). The spans inside a run of over ``LONG_WORDS`` words cover all of it and depend on nothing outside, so such a run, a
single line too, goes wherever an equal one stands at an earlier place, whatever is around it. Every line that goes has an equal one
earlier, so the text of a line is never lost altogether; runs of fewer words go as equal chunks only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from confab.llm.texts import fresh, let
from confab.session import cut

LINES = 2
LONG_WORDS = 50
SPAN = 1 << 31  # a span is first line * SPAN + number of lines
BROADCAST_ROWS = 1 << 20  # repeated hashes that may go to every task


def _values(lines: Column) -> Column:
    return F.transform(lines, lambda x: F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long"))


def _neighbours(x: Column, kind: str) -> Column:
    """(before, after) of every element."""
    none = F.array(F.lit(None).cast(kind))
    return F.zip_with(F.concat(none, F.slice(x, 1, F.size(x) - 1)), F.concat(F.slice(x, 2, F.size(x)), none),
                      lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _ends(values: Column) -> Column:
    """Positions (from 1) of the last lines of chunks, the text's last line included."""
    rolled = F.zip_with(_neighbours(values, "long"), values, lambda n, v: (n["a"] * 31 + v) % 4294967291)
    low = let(rolled, lambda r: F.zip_with(r, _neighbours(r, "long"), lambda x, n: F.coalesce((x < n["a"]) & (x < n["b"]), F.lit(False))))
    return F.concat(let(low, lambda w: F.filter(F.transform(F.slice(w, 1, F.size(w) - 1), lambda x, i: F.when(x, i + 1)), lambda x: x.isNotNull())), F.array(F.size(values)))


def chunks_of(text: Column) -> Column:
    """Array of (lines, chunk, hash) of a text."""

    def cuts(lines: Column, ends: Column) -> Column:
        return F.zip_with(F.concat(F.array(F.lit(0)), F.slice(ends, 1, F.size(ends) - 1)), ends, lambda a, b: let(
            F.array_join(F.slice(lines, a + 1, b - a), "\n"), lambda c: F.struct((b - a).alias("lines"), c.alias("chunk"), F.xxhash64(c).alias("hash"))))

    return let(F.split(text, "\n"), lambda lines: let(let(_values(lines), _ends), lambda ends: cuts(lines, ends)))


def _places(rows: DataFrame) -> DataFrame:
    each = rows.select("doc_id", "text_key", F.posexplode(chunks_of(F.col("text"))).alias("at", "c"))
    return each.where(F.col("c.lines") >= LINES).select("doc_id", "text_key", "at", "c.lines", "c.chunk", "c.hash")


def repeated(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, at): chunks to remove, by document and number of the chunk."""
    rows = docs.select(F.col("doc_id"), "text", F.xxhash64("text").alias("text_key")).where(F.col("text").isNotNull())
    place = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_key"), F.col("at"))
    places = _places(rows)
    often = cut(places.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash"), "chunk_hashes")
    few = often.count() <= BROADCAST_ROWS
    some = cut(places.join(F.broadcast(often) if few else often, "hash", "left_semi"), "chunk_places")
    heads = some.groupBy("hash", "chunk").agg(F.min(place).alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = some.join(heads, ["hash", "chunk"]).where(~place.eqNullSafe(F.col("head")))
    return again.select("doc_id", "text_key", "at").distinct()


def dedupe(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated chunks removed from ``text``; three more columns tell what went: n_lines, removed_lines, removed_chunks."""
    keep = [c for c in docs.columns if c.lower() not in ("n_lines", "removed_lines", "removed_chunks")]
    key, own, own_key, gone, left = (fresh(docs.columns, c) for c in ("text_key", "of_doc", "of_key", "gone", "left"))
    lost = cut(repeated(docs).groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("at")).alias("gone")), "chunk_removals")
    few = lost.count() <= BROADCAST_ROWS // 4
    lost = lost.toDF(own, own_key, gone)
    rows = docs.select(*[F.col(f"`{c}`") for c in keep]).withColumn(key, F.xxhash64("text"))
    both = rows.join(F.broadcast(lost) if few else lost, rows["doc_id"].eqNullSafe(lost[own]) & (rows[key] == lost[own_key]), "left")

    def kept(chunks: Column) -> Column:
        out = F.coalesce(F.col(gone), F.array().cast("array<int>"))
        flagged = F.transform(chunks, lambda c, i: F.struct(c["lines"].alias("lines"), c["chunk"].alias("chunk"), F.array_contains(out, i).alias("out")))
        zero = F.lit(0).cast("long")
        return let(flagged, lambda f: F.struct(
            F.array_join(F.transform(F.filter(f, lambda c: ~c["out"]), lambda c: c["chunk"]), "\n").alias("text"),
            F.aggregate(f, zero, lambda a, c: a + c["lines"]).alias("n_lines"),
            F.aggregate(f, zero, lambda a, c: a + F.when(c["out"], c["lines"]).otherwise(0)).alias("removed_lines"),
            F.size(F.filter(f, lambda c: c["out"])).cast("long").alias("removed_chunks")))

    done = both.withColumn(left, F.when(F.col("text").isNotNull(), let(chunks_of(F.col("text")), kept)))
    return done.select(*[F.col(f"{left}.text").alias("text") if c == "text" else F.col(f"`{c}`") for c in keep],
                       *[F.coalesce(F.col(f"{left}.{c}"), F.lit(0).cast("long")).alias(c) for c in ("n_lines", "removed_lines", "removed_chunks")])


def report(docs: DataFrame) -> DataFrame:
    """Digest of ``dedupe``: counts, and a hash of what is left of each text."""
    return dedupe(docs.select("doc_id", "text")).select("doc_id", "n_lines", "removed_lines", "removed_chunks", F.sha2("text", 256).alias("left_sha256"))


def _reach(words: Column) -> Column:
    """Number of lines from every line on that first exceeds LONG_WORDS words; 0 if the text ends before."""
    full = (LONG_WORDS + 1) * 64  # words * 64 + lines
    return F.transform(words, lambda w, i: let(
        F.aggregate(F.slice(words, i + 1, LONG_WORDS + 1), F.lit(0).cast("long"), lambda t, x: F.when(t >= full, t).otherwise(t + x * 64 + 1)),
        lambda t: F.when(t >= full, t % 64).otherwise(0)))


def _spans(lines: Column) -> Column:
    """Distinct spans of a text's lines."""

    def code(first: Column, n: Column, least: int) -> Column:
        return F.when(n >= least, first.cast("long") * SPAN + n)

    words = F.transform(lines, lambda x: F.greatest(F.regexp_count(x, F.lit(r"\S+")), F.lit(1)).cast("long"))
    on = let(words, lambda w: F.transform(let(w, _reach), lambda n, i: code(i, n, 1)))
    back = let(F.reverse(words), lambda w: F.transform(_reach(w), lambda n, i: code(F.size(w) - i - n, n, 1)))
    chunks = let(let(_values(lines), _ends), lambda ends: F.zip_with(
        F.concat(F.array(F.lit(0)), F.slice(ends, 1, F.size(ends) - 1)), ends, lambda a, b: code(a, b - a, LINES)))
    return F.array_distinct(F.filter(F.concat(on, back, chunks), lambda c: c.isNotNull()))


def _span_lines(lines: Column, span: Column) -> Column:
    return F.slice(lines, (F.shiftright(span, 31) + 1).cast("int"), (span % SPAN).cast("int"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, span): runs of lines that an equal one precedes."""
    rows = docs.select(F.col("doc_id"), "text", F.xxhash64("text").alias("text_key")).where(F.col("text").isNotNull())
    place = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_key"), F.col("span"))

    def places(whole: bool) -> DataFrame:
        def named(lines: Column, span: Column) -> Column:
            run = _span_lines(lines, span)
            return F.struct(span.alias("span"), F.xxhash64(run).alias("hash"), *([F.array_join(run, "\n").alias("run")] if whole else []))

        each = let(F.split("text", "\n"), lambda lines: F.transform(let(lines, _spans), lambda c: named(lines, c)))
        return rows.select("doc_id", "text_key", F.explode(each).alias("c")).select("doc_id", "text_key", "c.*")

    often = cut(places(False).groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash"), "span_hashes")
    few = often.count() <= BROADCAST_ROWS
    some = cut(places(True).join(F.broadcast(often) if few else often, "hash", "left_semi"), "span_places")
    heads = cut(some.groupBy("hash", "run").agg(F.min(place).alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1"), "span_heads")
    again = some.join(heads, ["hash", "run"]).where(~place.eqNullSafe(F.col("head")))
    return again.select("doc_id", "text_key", "span").distinct()


def dedupe_passages(docs: DataFrame) -> DataFrame:
    """``docs`` without the runs of lines that an equal one precedes; two more columns tell what went: n_lines, removed_lines."""
    keep = [c for c in docs.columns if c.lower() not in ("n_lines", "removed_lines")]
    key, own, own_key, gone, left = (fresh(docs.columns, c) for c in ("text_key", "of_doc", "of_key", "gone", "left"))
    lost = cut(repeated_spans(docs).groupBy("doc_id", "text_key").agg(F.collect_set("span").alias("gone")), "span_removals")
    few = lost.count() <= BROADCAST_ROWS // 4
    lost = lost.toDF(own, own_key, gone)
    rows = docs.select(*[F.col(f"`{c}`") for c in keep]).withColumn(key, F.xxhash64("text"))
    both = rows.join(F.broadcast(lost) if few else lost, rows["doc_id"].eqNullSafe(lost[own]) & (rows[key] == lost[own_key]), "left")
    out = F.flatten(F.transform(F.coalesce(F.col(gone), F.array().cast("array<bigint>")), lambda c: F.sequence(
        F.shiftright(c, 31).cast("int"), (F.shiftright(c, 31) + c % SPAN - 1).cast("int"))))

    def kept(lines: Column) -> Column:
        return let(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), out), lambda stay: F.struct(
            F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n").alias("text"),
            F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(stay)).cast("long").alias("removed_lines")))

    done = both.withColumn(left, F.when(F.col("text").isNotNull(), let(F.split("text", "\n"), kept)))
    return done.select(*[F.col(f"{left}.text").alias("text") if c == "text" else F.col(f"`{c}`") for c in keep],
                       *[F.coalesce(F.col(f"{left}.{c}"), F.lit(0).cast("long")).alias(c) for c in ("n_lines", "removed_lines")])


def report_passages(docs: DataFrame) -> DataFrame:
    """Digest of ``dedupe_passages``: counts, and a hash of what is left of each text."""
    return dedupe_passages(docs.select("doc_id", "text")).select("doc_id", "n_lines", "removed_lines", F.sha2("text", 256).alias("left_sha256"))


ORACLE = r"""
WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, i, lines[i] AS line, ('0x' || substr(md5(lines[i]), 1, 8))::BIGINT AS v FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM t)),
r AS (SELECT *, (lag(v) OVER w * 31 + v) % 4294967291 AS r FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
e AS (SELECT *, coalesce(r < lag(r) OVER w AND r < lead(r) OVER w, FALSE) AS ends FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
n AS (SELECT *, coalesce(sum(CAST(ends AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nth FROM e),
c AS (SELECT doc_id, nth, count(*) AS lines, string_agg(line, chr(10) ORDER BY i) AS chunk FROM n GROUP BY doc_id, nth),
p AS (SELECT *, lines >= 2 AND row_number() OVER (PARTITION BY chunk ORDER BY doc_id, nth) > 1 AS out FROM c),
g AS (SELECT doc_id, CAST(sum(lines) AS BIGINT) AS n_lines, CAST(coalesce(sum(lines) FILTER (WHERE out), 0) AS BIGINT) AS removed_lines,
             CAST(count(*) FILTER (WHERE out) AS BIGINT) AS removed_chunks,
             sha256(coalesce(string_agg(chunk, chr(10) ORDER BY nth) FILTER (WHERE NOT out), '')) AS left_sha256 FROM p GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(removed_lines, 0) AS removed_lines, coalesce(removed_chunks, 0) AS removed_chunks, left_sha256
FROM documents d LEFT JOIN g USING (doc_id)
"""
