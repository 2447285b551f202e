"""Transcript search, context retrieval and citation grounding."""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from confab.functions.text import query_terms
from confab.operators.blocks import numbered, time_block

MAX_TERMS = 16
AUTOMATON_TERMS, AUTOMATON_CHARS = 200_000, 4 << 20  # (query, term) rows and letters of terms that may go to every task
CELLS = 1 << 21  # (text, query) cells that a task looks at together


def search_transcripts(segments: DataFrame, projects: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """Segments holding any term of one query, most terms first; a sum of flags, no term join."""
    terms = list(dict.fromkeys(t for t in query.split() if len(t) >= 2))[:MAX_TERMS]
    if not terms:
        raise ValueError("the query has no term of two letters or more")
    low = F.lower("text")
    relevance = sum((low.contains(t.lower()).cast("int") for t in terms), F.lit(0))
    hits = segments.withColumn("relevance", relevance).where(F.col("relevance") > 0)
    p = projects.select("project_id", F.col("name").alias("project_name"), "media_path", "updated_at")
    return hits.join(p, "project_id").orderBy(
        F.desc("relevance"), F.desc("updated_at"), "start_ms", "segment_id").limit(limit).select(
        "segment_id", "project_id", "project_name", "media_path", "start_ms", "end_ms", "speaker", "text",
        "relevance")


def terms_of(queries: DataFrame) -> DataFrame:
    """(query_id, n, term): the first 16 distinct blank-separated terms, lower-cased."""
    parts = F.array_distinct(F.filter(F.split("query", r"(?U)\s+"), lambda t: F.length(t) >= 2))
    return queries.select("query_id", F.posexplode(F.slice(parts, 1, MAX_TERMS)).alias("n", "term")).select(
        "query_id", "n", F.lower("term").alias("term"))


def expanded_terms(queries: DataFrame, expansions: DataFrame) -> DataFrame:
    """Query words first, then their synonyms from a (term, synonym) table; 16 distinct in all."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("query"), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0)))
    own = queries.select("query_id", F.posexplode(words).alias("i", "term"))
    more = own.join(expansions.select("term", F.lower(F.trim("synonym")).alias("synonym")), "term").where(
        F.col("synonym") != "").select("query_id", F.lit(1).alias("g"), "i", F.col("synonym").alias("term"))
    both = own.select("query_id", F.lit(0).alias("g"), "i", "term").unionByName(more)
    first = both.groupBy("query_id", "term").agg(F.min(F.struct("g", "i", "term")).alias("at"))
    ranked = first.withColumn("n", F.row_number().over(W.partitionBy("query_id").orderBy("at")))
    return ranked.where(F.col("n") <= MAX_TERMS).select("query_id", "n", "term")


def search_many(segments: DataFrame, projects: DataFrame, terms: DataFrame, limit: int = 50) -> DataFrame:
    """Top segments per query: most terms held, then newest project, start and id; terms are literal lower-case text, one given twice counts twice.

    While the terms are few enough to be sent to every task (counted first), one automaton of all terms runs over every text, and a
    task keeps at most ``limit`` rows of a query at any time, so a term that occurs everywhere costs time but no rows. More terms meet
    the texts through an equi-join on substrings. Both give the same rows.
    """
    wanted = terms.where(F.length("term") > 0).select("query_id", "term")
    size = wanted.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.length("term")).alias("chars")).first()
    dated = segments.join(projects.select("project_id", "updated_at"), "project_id").select(
        "project_id", "segment_id", "start_ms", "updated_at", F.lower("text").alias("text"))
    few = size["rows"] <= AUTOMATON_TERMS and (size["chars"] or 0) <= AUTOMATON_CHARS
    scored = _by_automaton(dated, wanted, limit) if few else _by_grams(dated, wanted)
    rank = W.partitionBy("query_id").orderBy(F.desc("relevance"), F.desc("updated_at"), "start_ms", "segment_id", "project_id")
    return scored.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= limit).select(
        "query_id", "rank", "segment_id", "project_id", "relevance")


def _best(rows: dict[str, np.ndarray], limit: int) -> dict[str, np.ndarray]:
    """The first ``limit`` rows of every query in ranking order."""
    ids = [np.unique(rows[c], return_inverse=True)[1] for c in ("project_id", "segment_id")]
    by = np.lexsort((*ids, rows["start"], -rows["updated"], -rows["relevance"], rows["query"]))
    query = rows["query"][by]
    first = np.flatnonzero(np.append(True, query[1:] != query[:-1]))
    nth = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
    return {c: v[by[nth < limit]] for c, v in rows.items()}


def _by_automaton(dated: DataFrame, wanted: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` (query, segment) rows per query and task, by one pass of an automaton over the texts."""
    spark = dated.sparkSession
    pairs = wanted.orderBy("term").collect()  # counted by the caller
    queries = list(dict.fromkeys(r["query_id"] for r in pairs))
    number = {q: i for i, q in enumerate(queries)}
    holders: dict[str, list[int]] = {}
    for r in pairs:
        holders.setdefault(r["term"], []).append(number[r["query_id"]])
    offsets = np.cumsum([0, *map(len, holders.values())])
    shared = spark.sparkContext.broadcast((list(holders), offsets, np.array([q for h in holders.values() for q in h], np.int64)))

    def run(batches):
        words, off, of_term = shared.value
        many, n_queries = np.diff(off), len(queries)
        automaton = ahocorasick.Automaton()
        for i, word in enumerate(words):
            automaton.add_word(word, i)
        automaton.make_automaton()
        kept, least = None, np.zeros(n_queries, np.int64)  # least: relevance a further row must reach

        def take(batch, texts: list[int], found: list[int]) -> None:
            nonlocal kept, least
            times = many[found]
            at = np.repeat(off[:-1][found] - np.cumsum(times) + times, times) + np.arange(times.sum())
            cells, relevance = np.unique(np.repeat(texts, times) * n_queries + of_term[at], return_counts=True)
            text, query = np.divmod(cells, n_queries)
            text, query, relevance = (x[relevance >= least[query]] for x in (text, query, relevance))
            rows = {"query": query, "relevance": relevance, **{c: batch[c][text] for c in ("project_id", "segment_id", "start", "updated")}}
            kept = _best(rows if kept is None else {c: np.concatenate([kept[c], v]) for c, v in rows.items()}, limit)
            full = np.bincount(kept["query"], minlength=n_queries) >= limit
            last = np.zeros(n_queries, np.int64)
            last[kept["query"]] = kept["relevance"]  # rows are in ranking order, so the last one of a query stays
            least = np.where(full, last, 0)

        for whole in batches:
            batch = {c: whole.column(c).to_numpy(zero_copy_only=False) for c in ("project_id", "segment_id", "start", "updated")}
            texts, found, cells = [], [], 0
            for i, text in enumerate(whole.column("text").to_pylist()):
                held = {k for _, k in automaton.iter(text)} if text and words else ()
                texts += [i] * len(held)
                found += held
                cells += int(many[list(held)].sum()) if held else 0
                if cells > CELLS:
                    take(batch, texts, found)
                    texts, found, cells = [], [], 0
            if found:
                take(batch, texts, found)
        if kept is not None:
            yield pa.RecordBatch.from_arrays([pa.array(kept[c], schema.field(c).type) for c in schema.names], schema=schema)

    types = {f.name: f.dataType for f in dated.schema.fields}
    out = T.StructType([T.StructField("query", T.LongType()), T.StructField("project_id", types["project_id"]), T.StructField("segment_id", types["segment_id"]),
                        T.StructField("start", T.LongType()), T.StructField("updated", T.LongType()), T.StructField("relevance", T.LongType())])
    schema = to_arrow_schema(out)
    lowest = F.lit(-(1 << 63) + 1)
    slim = dated.select("project_id", "segment_id", F.coalesce(F.col("start_ms").cast("long"), lowest).alias("start"),
                        F.coalesce(F.unix_micros(F.col("updated_at").cast("timestamp")), lowest).alias("updated"), "text")
    names = spark.createDataFrame(list(enumerate(queries)), T.StructType([T.StructField("query", T.LongType()), wanted.schema["query_id"]]))
    return slim.mapInArrow(run, out).join(F.broadcast(names), "query").select(  # one row per query
        "query_id", "project_id", "segment_id", F.col("start").alias("start_ms"), F.col("updated").alias("updated_at"), "relevance")


def _by_grams(dated: DataFrame, wanted: DataFrame) -> DataFrame:
    """All (query, segment) rows, by joins.

    A term without blanks occurs in a text exactly where it occurs in one of the text's blank-separated words. Terms meet the
    distinct words through an equi-join on substrings of the terms' lengths; the matches then meet the segments on the word. A phrase
    is found by its first word and checked in the text. No pair of a text and a term apart from these is built.
    """
    key = ["project_id", "segment_id"]
    lexicon = wanted.select("term").distinct().withColumn("head", F.split(F.ltrim("term"), r"(?U)\s+")[0])
    heads = lexicon.select(F.col("head").alias("gram")).distinct()
    word_of = dated.select(*key, F.explode(F.array_distinct(F.split("text", r"(?U)\s+"))).alias("word"))
    lengths = heads.agg(F.collect_set(F.length("gram"))).scalar()
    sized = word_of.select("word").distinct().withColumn("lengths", lengths)
    grams = sized.select("word", F.explode(F.array_distinct(F.flatten(F.transform(
        F.filter("lengths", lambda n: n <= F.length("word")),
        lambda n: F.transform(F.sequence(F.lit(1), F.length("word") - n + 1),
                              lambda i: F.substring(F.col("word"), i, n)))))).alias("gram"))
    found = word_of.join(grams.join(heads, "gram"), "word").select(
        *key, F.col("gram").alias("head")).distinct().join(lexicon, "head")
    whole = found.where(F.col("term") == F.col("head")).select(*key, "term")
    phrases = found.where(F.col("term") != F.col("head")).join(dated.select(*key, "text"), key).where(
        F.col("text").contains(F.col("term"))).select(*key, "term")
    hits = whole.unionByName(phrases)
    scored = hits.join(wanted, "term").groupBy("query_id", *key).agg(F.count(F.lit(1)).alias("relevance"))
    return scored.join(dated.select(*key, "start_ms", "updated_at"), key)


def _indexed(segments: DataFrame) -> DataFrame:
    rows = numbered(segments, ["project_id"], time_block(), ["start_ms", "segment_order"])
    return rows.withColumn("idx", F.col("rn") - 1).drop("rn")


def rank_context(questions: DataFrame, indexed: DataFrame, top: int = 24) -> DataFrame:
    """(project_id, question_id, idx, score, rank): the best ``top`` segments per question.

    Scores come from an equi-join on shared terms.  Segments sharing none can only enter from
    the end of the project (later index first), so its last ``top`` rows complete the candidates.
    """
    asked = questions.select("project_id", "question_id", F.explode(query_terms(F.col("question"))).alias("term"))
    held = indexed.select("project_id", "idx", F.explode(query_terms(F.col("text"))).alias("term"))
    shared = asked.join(held, ["project_id", "term"]).groupBy("project_id", "question_id", "idx").agg(
        F.count(F.lit(1)).alias("score"))
    sizes = indexed.groupBy("project_id").agg(F.count(F.lit(1)).alias("n"))
    tail = questions.join(sizes, "project_id").select(
        "project_id", "question_id", F.explode(F.sequence(
            F.greatest(F.lit(0).cast("long"), F.col("n") - top), F.col("n") - 1)).alias("idx"),
        F.lit(0).cast("long").alias("score"))
    best = shared.unionByName(tail).groupBy("project_id", "question_id", "idx").agg(F.max("score").alias("score"))
    rank = W.partitionBy("project_id", "question_id").orderBy(F.desc("score"), F.desc("idx"))
    return best.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= top)


def select_context(questions: DataFrame, segments: DataFrame, limit: int = 32_000) -> DataFrame:
    """(project_id, question_id, segment_id, idx) of the context each question is answered from."""
    indexed = _indexed(segments)
    totals = indexed.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))
    asked = questions.join(totals, "project_id")
    rows = indexed.select("project_id", "idx", "segment_id", F.length("text").alias("len"))
    whole = asked.where(F.col("chars") <= limit).join(rows, "project_id")
    large = asked.where(F.col("chars") > limit)
    ranked = rank_context(large.select("project_id", "question_id", "question"), indexed)
    lists = ranked.groupBy("project_id", "question_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "score", "idx"))).alias("best"))  # at most 24 items
    n = F.col("n")

    def around(i):
        return F.sequence(F.greatest(F.lit(0).cast("long"), i - 1), F.least(n - 1, i + 1))

    # once ten indexes are chosen, the first row without a shared term ends the choice
    chosen = F.aggregate(
        "best",
        F.struct(F.array_distinct(F.array(F.lit(0).cast("long"), n - 1)).alias("keep"), F.lit(False).alias("done")),
        lambda acc, x: F.when(
            acc["done"] | ((x["score"] <= 0) & (F.size(acc["keep"]) >= 10)),
            F.struct(acc["keep"].alias("keep"), F.lit(True).alias("done")),
        ).otherwise(F.struct(F.array_union(acc["keep"], around(x["idx"])).alias("keep"), F.lit(False).alias("done"))),
        lambda acc: acc["keep"])
    picked = lists.join(large.select("project_id", "question_id", "n"), ["project_id", "question_id"]).select(
        "project_id", "question_id", F.explode(chosen).alias("idx"))
    kept = picked.join(rows, ["project_id", "idx"]).groupBy("project_id", "question_id").agg(
        F.array_sort(F.collect_list(F.struct("idx", "len", "segment_id"))).alias("items"))  # at most 74 items
    middle = lambda a: (F.size(a) / 2).cast("int")
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x["len"])
    trimmed = F.aggregate(
        "items", F.col("items"),
        lambda acc, _: F.when((total(acc) > limit) & (F.size(acc) > 4), F.concat(
            F.slice(acc, F.lit(1), middle(acc)),
            F.slice(acc, middle(acc) + 2, F.size(acc)))).otherwise(acc))
    cut = kept.select("project_id", "question_id", F.explode(trimmed).alias("x")).select(
        "project_id", "question_id", "x.segment_id", "x.idx")
    return whole.select("project_id", "question_id", "segment_id", "idx").unionByName(cut)


def ground_citations(answers: DataFrame, context: DataFrame) -> DataFrame:
    """Keep the first eight citations of an answer that point into its context."""
    cited = answers.select("project_id", "answer_id", F.posexplode(F.slice("citations", 1, 8)).alias("n", "c"))
    cited = cited.select("project_id", "answer_id", "n", F.col("c.segment_id").alias("segment_id"),
                         F.col("c.excerpt").alias("excerpt"))
    given = F.when(F.col("excerpt") != "", F.col("excerpt"))
    return cited.join(context, ["project_id", "segment_id"]).select(
        "project_id", "answer_id", "n", "segment_id", "start_ms", "end_ms",
        F.trim(F.left(F.coalesce(given, F.col("text")), F.lit(240))).alias("excerpt"))


def latest_per(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """First ``n`` rows per key; only n rows per key leave each map task."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(
        F.col("rank") <= n)
