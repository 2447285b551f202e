"""Registry of queries and their check SQL, and the shared SQL for the derived tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from confab import session

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(session.configure(spark), sf_dir)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


# name -> (needed tables, body); written once, used as WITH items by the check SQL
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "words": ((), r"""
        SELECT conv_id AS project_id,
               conv_id*100000 + turn*10000 + CAST(floor(pos/8) AS BIGINT) AS segment_id,
               turn, pos, role AS speaker, word, cum-tail-dur AS start_ms, cum-tail AS end_ms,
               CAST((60+(conv_id*37+turn*11+pos*7)%40)/100.0 AS DOUBLE) AS probability
        FROM (SELECT *, CAST(sum(lead+dur+tail) OVER (PARTITION BY conv_id ORDER BY turn,pos
                                    ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum
              FROM (SELECT conv_id, turn, role, pos, word, CAST(120+60*length(word) AS BIGINT) AS dur,
                           CASE WHEN pos=0 THEN 300*((conv_id*7+turn*5)%9) ELSE 0 END AS lead,
                           80 + CASE WHEN regexp_matches(word,'[.!?]$')
                                     THEN 400*((conv_id+turn+pos)%6) ELSE 0 END AS tail
                    FROM (SELECT conv_id, turn, role, i-1 AS pos, l[i] AS word
                          FROM (SELECT *, unnest(range(1,len(l)+1)) AS i
                                FROM (SELECT conv_id, turn, role,
                                             regexp_split_to_array(trim(text),'\s+') AS l
                                      FROM conversations)))))"""),
    "segments": (("words",), r"""
        SELECT project_id, segment_id, turn, segment_id-project_id*100000 AS segment_order, speaker,
               min(start_ms) AS start_ms, max(end_ms) AS end_ms, string_agg(word,' ' ORDER BY pos) AS text,
               round(avg(probability),4) AS confidence,
               (project_id + CASE WHEN speaker='user' THEN 1 ELSE 2 END)%10 AS speaker_profile_id,
               CAST((50+(project_id*13+turn*29)%50)/100.0 AS DOUBLE) AS speaker_match_confidence,
               CAST((55+(project_id*17+turn*23)%45)/100.0 AS DOUBLE) AS speaker_confidence,
               CASE segment_id%11 WHEN 0 THEN 'accepted' WHEN 1 THEN 'corrected' WHEN 2 THEN 'pending' END
                 AS review_state,
               CASE segment_id%7 WHEN 0 THEN 'accepted' WHEN 1 THEN 'pending' END AS speaker_review_state
        FROM words GROUP BY project_id, segment_id, turn, speaker"""),
    "projects": (("segments",), r"""
        SELECT project_id, 'conv ' || project_id AS name, max(end_ms) AS duration_ms,
               TIMESTAMP '2024-01-01' + to_hours(project_id) AS updated_at,
               CASE WHEN project_id%13=0 THEN 'transcribing' ELSE 'completed' END AS status,
               'rec/' || (project_id%90) || '.wav' AS media_path
        FROM segments GROUP BY project_id"""),
    "markers": (("segments",), r"""
        SELECT project_id, turn AS marker_id,
               min(start_ms) + (project_id*131+turn*977)%5000 AS time_ms
        FROM segments GROUP BY project_id, turn"""),
    "centroids": ((), r"""
        SELECT profile_id, list(m / greatest(nn, 1e-8) ORDER BY d) AS centroid
        FROM (SELECT *, sqrt(sum(m*m) OVER (PARTITION BY profile_id)) AS nn
              FROM (SELECT profile_id, d, avg(embedding[d]) AS m
                    FROM (SELECT CAST(label AS BIGINT) AS profile_id, CAST(embedding AS DOUBLE[]) AS embedding,
                                 unnest(range(1,len(embedding)+1)) AS d FROM embeddings)
                    GROUP BY profile_id, d)) GROUP BY profile_id"""),
    "samples": (("centroids",), r"""
        SELECT sample_id, profile_id, sample_id%17 AS source_project, sample_id AS source_segment, 1500*sample_id AS start_ms,
               500+(97*sample_id)%9000 AS duration_ms, CAST((55+(31*sample_id)%45)/100.0 AS DOUBLE) AS confidence,
               list_transform(x, lambda y: y/greatest(sqrt(list_inner_product(x,x)),1e-8)) AS embedding
        FROM (SELECT vec_id AS sample_id, profile_id,
                     list_transform(range(1,len(e)+1), lambda i: (vec_id%5)*c[i]+e[i]) AS x
              FROM (SELECT vec_id, CAST(label AS BIGINT) AS profile_id, CAST(embedding AS DOUBLE[]) AS e, centroid AS c
                    FROM embeddings JOIN centroids ON profile_id=label))"""),
    "profiles": (("samples",), r"""
        SELECT profile_id, centroid, 'Voz ' || profile_id AS name, CAST(0.64 AS DOUBLE) AS match_threshold,
               profile_id%7<>6 AS enabled, n.sample_count, n.total_duration_ms
        FROM centroids JOIN (SELECT profile_id, count(*) AS sample_count, CAST(sum(duration_ms) AS BIGINT) AS total_duration_ms
                             FROM samples GROUP BY profile_id) n USING (profile_id)"""),
}


def sql(tables: str, body: str) -> str:
    """``body`` behind a WITH list holding the named derived tables and what they need."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in CTES[name][0]:
            add(need)
        if name not in order:
            order.append(name)

    for name in tables.split():
        add(name)
    items = [f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in order]
    body = body.strip()
    for head in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(head):
            return head + ",\n".join([*items, body[len(head):]])
    return "WITH " + ",\n".join(items) + "\n" + body if items else body
