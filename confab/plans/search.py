"""Search, context retrieval, citations and ordered lists."""

from pyspark.sql import functions as F

from confab.operators.blocks import numbered, time_block
from confab.operators import search
from confab.plans.registry import query, sql
from confab.sources import tables

WORDS = r"list_distinct(regexp_extract_all(lower({c}),'[\p{{L}}\p{{N}}_]{{3,}}'))"


@query("search_transcripts", sql("projects", """
    SELECT segment_id, project_id, p.name AS project_name, media_path, start_ms, end_ms, speaker, text, relevance
    FROM (SELECT s.*, (contains(lower(text),'tion'))::INT + (contains(lower(text),'éa'))::INT
                    + (contains(lower(text),'the'))::INT AS relevance FROM segments s) s
    JOIN projects p USING (project_id) WHERE relevance>0
    ORDER BY relevance DESC, updated_at DESC, start_ms, segment_id LIMIT 50"""))
def search_transcripts(spark, sf):
    s = tables.segments(spark, sf)
    return search.search_transcripts(s, tables.projects(spark, sf, s), "Tion ÉA x the")


def benchmark_queries(spark, sf):
    return tables.read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


RANKED = """
    , m AS (SELECT query_id, segment_id, count(*) AS relevance
            FROM terms JOIN segments ON contains(lower(text), term) GROUP BY query_id, segment_id)
    SELECT query_id, rank, segment_id, project_id, relevance FROM (
      SELECT query_id, segment_id, project_id, relevance, row_number() OVER (PARTITION BY query_id
        ORDER BY relevance DESC, updated_at DESC, start_ms, segment_id) AS rank
      FROM m JOIN segments USING (segment_id) JOIN projects USING (project_id)) WHERE rank<=50"""


@query("search_many", sql("projects", r"""
    WITH t0 AS (SELECT item_id AS query_id, list_filter(regexp_split_to_array(text,'\s+'), lambda t: length(t)>=2) AS l
                FROM benchmark),
    t1 AS (SELECT query_id, l[i] AS term, min(i) AS n FROM (SELECT *, unnest(range(1,len(l)+1)) AS i FROM t0) GROUP BY 1,2),
    terms AS (SELECT query_id, lower(term) AS term FROM t1
              QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n)<=16)""" + RANKED))
def search_many(spark, sf):
    """Every benchmark text is a query against every segment."""
    s = tables.staged(spark, sf)
    return search.search_many(s, tables.projects(spark, sf, s), search.terms_of(benchmark_queries(spark, sf)))


@query("concept_search", sql("projects", r"""
    WITH w AS (SELECT item_id AS query_id, regexp_extract_all(lower(text),'[\p{L}\p{N}_]{2,}') AS l FROM benchmark),
    x AS (SELECT query_id, l[i] AS term, l[i+1] AS synonym, i FROM (SELECT *, unnest(range(1,len(l)+1)) AS i FROM w)),
    e AS (SELECT term, min(synonym) AS synonym FROM x WHERE synonym IS NOT NULL GROUP BY term),
    own AS (SELECT query_id, term, min(i) AS i FROM x GROUP BY query_id, term),
    own2 AS (SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY i) AS i FROM own),
    al AS (SELECT query_id, 0 AS g, i, term FROM own2
           UNION ALL SELECT query_id, 1, i, synonym FROM own2 JOIN e USING (term)),
    f AS (SELECT query_id, term, min(g*100000+i) AS a FROM al GROUP BY query_id, term),
    terms AS (SELECT query_id, term FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY a, term)<=16)""" + RANKED))
def concept_search(spark, sf):
    """Synonyms come from a table: here the word that follows a word in the benchmark texts."""
    s, q = tables.staged(spark, sf), benchmark_queries(spark, sf)
    words = F.regexp_extract_all(F.lower("query"), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    pairs = q.select(words.alias("l")).select(F.explode(F.arrays_zip(
        F.col("l").alias("term"), F.slice("l", F.lit(2), F.size("l")).alias("synonym"))).alias("z"))
    expansions = pairs.select("z.term", "z.synonym").where(F.col("synonym").isNotNull()).groupBy("term").agg(
        F.min("synonym").alias("synonym"))
    return search.search_many(s, tables.projects(spark, sf, s), search.expanded_terms(q, expansions))


def questions(spark, sf):
    c = tables.read(spark, sf, "conversations").where(F.col("role") == "user")
    return c.select(F.col("conv_id").alias("project_id"), F.col("turn").alias("question_id"),
                    F.col("text").alias("question"))


@query("rank_context", sql("segments", f"""
    WITH ix AS (SELECT project_id, text, row_number() OVER (PARTITION BY project_id ORDER BY start_ms, segment_order)-1 AS idx
                FROM segments),
    q AS (SELECT conv_id AS project_id, turn AS question_id, {WORDS.format(c='text')} AS qt FROM conversations WHERE role='user'),
    s AS (SELECT project_id, question_id, idx, len(list_intersect(qt, {WORDS.format(c='text')})) AS score
          FROM q JOIN ix USING (project_id))
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id, question_id ORDER BY score DESC, idx DESC) AS rank
                   FROM s) WHERE rank<=24"""))
def rank_context(spark, sf):
    return search.rank_context(questions(spark, sf), search._indexed(tables.segments(spark, sf)))


@query("select_context", sql("segments", f"""
    WITH RECURSIVE ix AS MATERIALIZED (
      SELECT project_id, segment_id, text, length(text) AS size, row_number() OVER (PARTITION BY project_id ORDER BY start_ms, segment_order)-1 AS idx FROM segments),
    asked AS (SELECT project_id, turn AS question_id, {WORDS.format(c='c.text')} AS qt, n, chars FROM conversations c
              JOIN (SELECT project_id, count(*) AS n, sum(size) AS chars FROM ix GROUP BY 1) t ON t.project_id=c.conv_id WHERE role='user'),
    scored AS (SELECT project_id, question_id, idx, len(list_intersect(qt, {WORDS.format(c='text')})) AS score
               FROM asked JOIN ix USING (project_id) WHERE chars>1500),
    ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY project_id, question_id ORDER BY score DESC, idx DESC) AS rank FROM scored QUALIFY rank<=24),
    choice AS (
      SELECT project_id, question_id, n, 0 AS r, list_distinct([0, n-1]) AS keep, false AS done FROM asked WHERE chars>1500
      UNION ALL
      SELECT project_id, question_id, n, r+1, CASE WHEN stop THEN keep ELSE list_distinct(keep || [greatest(0, idx-1), idx, least(n-1, idx+1)]) END, stop
      FROM (SELECT c.*, k.idx, done OR (score<=0 AND len(keep)>=10) AS stop FROM choice c JOIN ranked k
            ON k.project_id=c.project_id AND k.question_id=c.question_id AND k.rank=c.r+1)),
    chosen AS (SELECT project_id, question_id, unnest(arg_max(keep, r)) AS idx FROM choice GROUP BY 1, 2),
    trimming AS (
      SELECT project_id, question_id, list({{'idx': idx, 'size': size, 'segment_id': segment_id}} ORDER BY idx) AS items
      FROM chosen JOIN ix USING (project_id, idx) GROUP BY 1, 2
      UNION ALL
      SELECT project_id, question_id, items[1:len(items)//2] || items[len(items)//2+2:] FROM trimming
      WHERE len(items)>4 AND list_sum(list_transform(items, lambda x: x.size))>1500),
    kept AS (SELECT project_id, question_id, unnest(arg_min(items, len(items))) AS item FROM trimming GROUP BY 1, 2)
    SELECT project_id, question_id, segment_id, idx FROM asked JOIN ix USING (project_id) WHERE chars<=1500
    UNION ALL SELECT project_id, question_id, item.segment_id, item.idx FROM kept"""))
def select_context(spark, sf):
    """A small limit, so that choosing and trimming both happen."""
    return search.select_context(questions(spark, sf), tables.staged(spark, sf), 1_500)


@query("ground_citations", sql("segments", """
    WITH a AS (SELECT conv_id AS project_id, turn AS answer_id, conv_id*100000+turn*10000 AS base FROM conversations),
    c AS (SELECT project_id, answer_id, base, unnest(range(0,8)) AS n FROM a),
    x AS (SELECT project_id, answer_id, n, CASE WHEN n=1 THEN -1 ELSE base+n*2 END AS segment_id,
                 CASE WHEN n%2=0 THEN '' ELSE 'cita ' || n END AS excerpt FROM c)
    SELECT x.project_id, answer_id, n, x.segment_id, start_ms, end_ms,
           trim(left(CASE WHEN excerpt='' THEN text ELSE excerpt END, 240)) AS excerpt
    FROM x JOIN segments s ON s.project_id=x.project_id AND s.segment_id=x.segment_id WHERE s.confidence>=0.75"""))
def ground_citations(spark, sf):
    """Ten citations per turn, some invented; the context is the clearer half of the segments."""
    base = F.col("conv_id") * 100_000 + F.col("turn") * 10_000
    cites = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda n: F.struct(
        F.when(n == 1, F.lit(-1)).otherwise(base + n * 2).alias("segment_id"),
        F.when(n % 2 == 0, F.lit("")).otherwise(F.concat(F.lit("cita "), n)).alias("excerpt")))
    answers = tables.read(spark, sf, "conversations").select(
        F.col("conv_id").alias("project_id"), F.col("turn").alias("answer_id"), cites.alias("citations"))
    context = tables.segments(spark, sf).where(F.col("confidence") >= 0.75).select(
        "project_id", "segment_id", "start_ms", "end_ms", "text")
    return search.ground_citations(answers, context)


@query("recent_projects", sql("projects", """
    SELECT project_id, name, duration_ms, updated_at, n AS segments FROM projects
    JOIN (SELECT project_id, count(*) AS n FROM segments GROUP BY 1) USING (project_id)
    ORDER BY updated_at DESC, project_id DESC LIMIT 12"""))
def recent_projects(spark, sf):
    s = tables.segments(spark, sf)
    n = s.groupBy("project_id").agg(F.count(F.lit(1)).alias("segments"))
    return tables.projects(spark, sf, s).select("project_id", "name", "duration_ms", "updated_at").orderBy(
        F.desc("updated_at"), F.desc("project_id")).limit(12).join(n, "project_id")


@query("latest_evidence", """
    SELECT user_id AS project_id, event_id, event_type, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events)
    WHERE rank<=20""")
def latest_evidence(spark, sf):
    e = tables.read(spark, sf, "events").select(F.col("user_id").alias("project_id"), "event_id", "event_type", "ts")
    return search.latest_per(e, ["project_id"], [F.desc("ts"), F.desc("event_id")], 20).drop("ts")


@query("markers_in_order", sql("markers", """
    SELECT project_id, marker_id, time_ms, rank FROM (SELECT *, row_number() OVER (PARTITION BY project_id
      ORDER BY time_ms, marker_id) AS rank FROM markers)"""))
def markers_in_order(spark, sf):
    """All markers; ranks come from blocks of recording time, so a project's list is never sorted in one task."""
    return numbered(tables.markers(spark, sf), ["project_id"], time_block("time_ms"), ["time_ms", "marker_id"], "rank")
