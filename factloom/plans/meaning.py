"""Queries by meaning: the second pass of truth maintenance and nearest neighbours by a vector index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import checksums
from factloom.operators import facts, semantic, vectors
from factloom.plans.queries import COS, TEXT_FOLD, checkpoint
from factloom.sources import tables as src

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


#: Numbers of a stand-in embedding.
WIDTH = 64

# After the first pass: a vector for each statement, and the fold that retires the nearest held claim of a session.
SECOND_PASS = f"""{TEXT_FOLD},
first AS (SELECT session_id, old_claim_id, new_claim_id, edge_type FROM fold WHERE old_claim_id IS NOT NULL),
said AS (SELECT session_id, claim_id, source_turn_id, created_ts, 'user noted ' || left(min(value) OVER (PARTITION BY source_turn_id), {semantic.CONTEXT_CHARS}) AS said FROM notes),
words AS (SELECT said, unnest(regexp_extract_all(lower(said), '[a-z0-9]+')) AS word FROM (SELECT DISTINCT said FROM said)),
hashed AS (SELECT word, {checksums.crc32_sql("word")} AS h FROM (SELECT DISTINCT word FROM words)),
dims AS (SELECT said, h % {WIDTH} AS d, sum(CASE WHEN h >> 31 = 1 THEN 1 ELSE -1 END)::DOUBLE AS n FROM words JOIN hashed USING (word) GROUP BY ALL),
vecs AS (SELECT said, list_transform(range({WIDTH}), lambda d: coalesce(m[d], 0)) AS v FROM (SELECT said, map_from_entries(list((d, n))) AS m FROM dims GROUP BY said)),
laid2 AS (SELECT s.*, v.v, row_number() OVER (PARTITION BY session_id ORDER BY created_ts, claim_id) AS rn,
  (SELECT count(*) FROM first f WHERE f.new_claim_id = s.claim_id) > 0 AS answered,
  coalesce((SELECT list(f.old_claim_id) FROM first f WHERE f.new_claim_id = s.claim_id AND f.edge_type NOT IN ('blocked', 'contradicts')), []) AS ended FROM said s JOIN vecs v USING (said)),
second AS (
  SELECT session_id, rn, created_ts, claim_id AS new_claim_id, NULL::VARCHAR AS old_claim_id, NULL::DOUBLE AS score, [{{'id': claim_id, 'turn': source_turn_id, 'ts': created_ts, 'v': v}}] AS held FROM laid2 WHERE rn = 1
  UNION ALL
  SELECT session_id, rn, created_ts, claim_id, best.id, best.s, list_append(list_filter(still, lambda h: best IS NULL OR h.id <> best.id), {{'id': claim_id, 'turn': source_turn_id, 'ts': created_ts, 'v': v}})
  FROM (SELECT *, CASE WHEN NOT answered THEN list_reverse_sort(list_filter(list_transform(list_filter(still, lambda h: h.turn <> source_turn_id),
      lambda h: {{'s': round(list_dot_product(h.v, v) / sqrt(list_dot_product(h.v, h.v) * list_dot_product(v, v)), 6), 'ts': h.ts, 'id': h.id}}), lambda c: c.s >= {semantic.THRESHOLD}))[1] END AS best
    FROM (SELECT n.*, list_filter(s.held, lambda h: NOT list_contains(n.ended, h.id)) AS still FROM second s JOIN laid2 n ON n.session_id = s.session_id AND n.rn = s.rn + 1)))"""


@query(f"WITH RECURSIVE {SECOND_PASS} SELECT session_id, old_claim_id, new_claim_id, 'semantic_replace' AS edge_type, score AS identity_score, created_ts FROM second WHERE old_claim_id IS NOT NULL")
def d9_second_pass(spark, sf):
    """Claims of the notes that the first pass left alone, by the meaning of the turns that they come from."""
    claims = src.notes(spark, sf)
    turns = claims.groupBy(F.col("source_turn_id").alias("turn_id")).agg(F.min("value").alias("text"))
    rows = semantic.statements(claims.withColumn("text", F.col("value")), turns)
    return semantic.second_pass(rows, facts.supersede(claims), src.hash_embedder(WIDTH), checkpoint)


@query(f"""SELECT "query", id, score, "rank" FROM (
  SELECT a.vec_id AS "query", b.vec_id AS id, round({COS}, 6) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({COS}, 6) DESC, b.vec_id) AS "rank" FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)
WHERE "rank" <= 10""")
def j5_nearest_each(spark, sf):
    """The ten nearest of each hundredth vector among all others, by an index."""
    v = src.table(spark, sf, "embeddings")
    index = vectors.build(v.select(F.col("vec_id").alias("id"), "embedding"), checkpoint)
    asked = v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), "embedding")
    return vectors.nearest(asked, index, 10, checkpoint).select("query", "id", "score", F.col("rank").cast("long").alias("rank"))
