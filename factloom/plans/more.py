"""Further registered queries: the write path, the doors, packs, paths and indexes; each with SQL where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom import model
from factloom.functions import text as tx
from factloom.operators import context, facts, ingest, memory, rank, views
from factloom.plans.queries import ASK, C, CLAIM_ASK, FOLD, HYBRID, N6, NOW, TOOL_ASK, T, V, bm25_sql, checkpoint, episodes_sql, folded, hybrid_sql, session_claims, supplier_claims, validity
from factloom.plans.queries import TOOLS as TOOLS_SQL
from factloom.plans.queries import registry as tool_registry
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


REGISTRY = "(SELECT p_partkey AS id, p_brand AS source, p_type AS dataset FROM part)"


def registry(spark, sf):
    return src.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("source"), F.col("p_type").alias("dataset"))


@query(f"SELECT source, dataset, count(*) AS tools FROM {REGISTRY} GROUP BY ALL")
def a9_tool_counts(spark, sf):
    return src.tool_counts(registry(spark, sf))


@query(f"SELECT id FROM {REGISTRY} WHERE source = (SELECT min(p_brand) FROM part)")
def a9_load_tools(spark, sf):
    rows = registry(spark, sf)
    return src.load_tools(rows, rows.agg(F.min("source").alias("s")).first().s).select("id")


@query("SELECT l_orderkey, l_linenumber, epoch_us(o_orderdate) * 1000 + l_linenumber::BIGINT * 1000000000 AS ts FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def a11_retimed(spark, sf):
    rows = src.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.lit(0).cast("long").alias("ts"))
    times = src.table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (src.micros(F.col("o_orderdate")) * 1000).alias("ts"))
    return src.retimed(rows, times, "l_orderkey", ("ts",), "l_linenumber")


@query(f"WITH {T} SELECT turn_id, session_id FROM turns WHERE ts <= 3000000000")
def b5_turns_at(spark, sf):
    return views.turns_at(src.turns(spark, sf), F.lit(3_000_000_000)).select("turn_id", "session_id")


@query(f"WITH {V} SELECT claim_id FROM validity WHERE status = 'active' AND (predicate = 'purchase' OR confidence > 0.9)")
def b7_filtered(spark, sf):
    return views.filtered(validity(spark, sf)[0], (F.col("predicate") == "purchase") | (F.col("confidence") > 0.9)).select("claim_id")


@query(f"WITH {T}, own AS (SELECT DISTINCT session_id FROM turns WHERE namespace = 'ns1') SELECT DISTINCT session_id, CASE WHEN session_id IN (FROM own) THEN NULL ELSE 'namespace' END AS denied FROM turns")
def b9_denied(spark, sf):
    t = src.turns(spark, sf)
    return ingest.namespace_of(t, t, "ns1")


@query(f"""WITH {C}, c AS (SELECT * FROM claims), r AS (SELECT a.claim_id, b.claim_id AS earlier, row_number() OVER (PARTITION BY a.claim_id ORDER BY b.created_ts DESC, b.claim_id) AS rn
  FROM c a JOIN c b ON a.session_id = b.session_id AND a.subject = b.subject AND a.predicate = b.predicate AND a.claim_id <> b.claim_id) SELECT claim_id, earlier FROM r WHERE rn = 1""")
def c19_same_identity(spark, sf):
    rows = src.claims(spark, sf).withColumn("status", F.lit("active"))
    return views.same_identity(rows, rows)


@query(f"""WITH {V} SELECT claim_id, last_value(claim_id) OVER w AS head, count(*) OVER w - row_number() OVER (PARTITION BY session_id, subject, predicate ORDER BY created_ts, claim_id) AS steps
FROM validity WINDOW w AS (PARTITION BY session_id, subject, predicate ORDER BY created_ts, claim_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) QUALIFY steps > 0""")
def d14_forward(spark, sf):
    return views.forward(validity(spark, sf)[1], checkpoint)


@query(f"""WITH {V}, l AS (SELECT *, first_value(claim_id) OVER (PARTITION BY session_id, subject, predicate ORDER BY created_ts, claim_id) AS origin,
  row_number() OVER (PARTITION BY session_id, subject, predicate ORDER BY created_ts DESC, claim_id DESC) AS place FROM validity)
SELECT origin, place, CASE WHEN place = 1 THEN '* ' ELSE '  ' END || value || ' [' || status || '] <- ' || speaker || ': "' || value || '"' AS line FROM l""")
def d18_trace_text(spark, sf):
    rows, edges = validity(spark, sf)
    traced = views.trace(rows.withColumn("quote", F.col("value")), edges, checkpoint)
    return views.trace_text(traced).withColumn("place", F.col("place").cast("long"))


@query(f"""WITH {V}, {T}, t AS (SELECT count(*) AS turns, count(DISTINCT session_id) AS sessions FROM turns)
SELECT t.*, (SELECT count(*) FROM validity) AS claims, (SELECT count(DISTINCT session_id) FROM validity) AS sessions_with_claims, (SELECT count(*) FROM validity WHERE status = 'active') AS active,
  (SELECT count(*) FROM validity WHERE status = 'superseded') AS superseded, (SELECT count(*) FROM edges) AS edges FROM t""")
def f2_status(spark, sf):
    rows, edges = validity(spark, sf)
    return views.status_counts(src.turns(spark, sf), rows, edges)


def line_claims(spark, sf):
    """Lines as claims whose entity is their supplier and whose turn is their order."""
    o = src.table(spark, sf, "orders").select("o_orderkey", (src.micros(F.col("o_orderdate")) * 1000).alias("created_ts"))
    lines = src.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("s"), "l_suppkey").alias("entity_key"), F.col("l_returnflag").alias("predicate"))
    return lines.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat_ws("_", F.lit("cl"), "l_orderkey", "l_linenumber").alias("claim_id"), F.col("l_orderkey").alias("source_turn_id"), "entity_key", "predicate", "created_ts", F.lit("active").alias("status"))


@query("""SELECT 's' || l_suppkey AS entity, count(DISTINCT l_orderkey || '_' || l_linenumber) AS claims, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS predicates, min(epoch_us(o_orderdate)) * 1000 AS first_ts, max(epoch_us(o_orderdate)) * 1000 AS last_ts
FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1""")
def f19_entity_nodes(spark, sf):
    return views.entity_nodes(line_claims(spark, sf)).withColumn("predicates", F.array_join("predicates", ","))


@query("SELECT l_orderkey, l_linenumber, 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS ts FROM lineitem")
def g9_monotone(spark, sf):
    """Lines of an order that all have one time come to have one of their own each."""
    rows = src.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.lit(1000).cast("long").alias("ts"))
    return src.monotone(rows, "l_orderkey", "ts", ("l_linenumber",))


DOCS = "documents"


@query(f"WITH {bm25_sql(DOCS, 'doc_id', '0')} SELECT id AS doc_id, round(bm25, 6) AS bm25 FROM bm WHERE bm25 > 0")
def j3_postings(spark, sf):
    docs = src.table(spark, sf, "documents").select("doc_id", "text")
    size = docs.agg(F.count("*").alias("n"), F.avg(F.size(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))).alias("average")).first()
    return rank.search_postings(rank.postings(docs, "doc_id"), ASK, "doc_id", size.n, size.average).withColumn("bm25", F.round("bm25", 6))


@query("""WITH v AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 3)) AS s FROM embeddings)
SELECT vec_id AS event_id, round(s, 6) AS score FROM v ORDER BY round(s, 6) DESC, vec_id LIMIT 8""")
def j19_frames(spark, sf):
    v = src.table(spark, sf, "embeddings").withColumnRenamed("vec_id", "event_id")
    return rank.nearest(v, v.filter("event_id = 3").first().embedding, 8, "event_id")


@query(f"WITH {HYBRID} SELECT claim_id, 'bm25' AS channel, round(0.2 / (60.0 + row_number() OVER (PARTITION BY session_id ORDER BY bm25 DESC, created_ts, claim_id)), 9) AS share FROM hy "
       "UNION ALL SELECT claim_id, 'frequency', round(0.1 / (60.0 + row_number() OVER (PARTITION BY session_id ORDER BY frequency DESC, created_ts, claim_id)), 9) FROM hy")
def j11_explained(spark, sf):
    rows = rank.facts(src.claims(spark, sf).withColumn("status", F.lit("active")), CLAIM_ASK, explain="why")
    told = rows.select("claim_id", F.explode("why").alias("channel", "share")).filter("channel in ('bm25', 'frequency')")
    return told.withColumn("share", F.round("share", 9))


@query(f"""WITH {V}, e AS (SELECT new_claim_id AS claim_id, max(created_ts) AS ets FROM edges GROUP BY 1),
r AS (SELECT v.*, ets, row_number() OVER (PARTITION BY session_id ORDER BY confidence DESC, created_ts, claim_id) AS rn FROM validity v LEFT JOIN e USING (claim_id) WHERE status = 'active')
SELECT session_id, array_to_string(list(claim_id ORDER BY rn) FILTER (rn <= 3), ',') AS facts, coalesce(array_to_string(list(claim_id ORDER BY ets DESC, claim_id) FILTER (rn > 3 AND ets IS NOT NULL), ','), '') AS updates,
  count(*) FILTER (rn > 3 AND ets IS NULL) AS remaining FROM r GROUP BY session_id""")
def n1_digest_updates(spark, sf):
    rows, edges = validity(spark, sf)
    found = views.digest(rows.withColumn("importance", F.col("confidence")), edges)
    return found.select("session_id", F.array_join(F.transform("facts", lambda x: x["claim_id"]), ",").alias("facts"), F.array_join("updates", ",").alias("updates"), F.col("remaining").cast("long").alias("remaining"))


@query(f"WITH {N6} SELECT n.entity, count(DISTINCT 'cl_' || l_orderkey || '_' || l_linenumber) AS claims FROM n JOIN lineitem ON n.neighbour = 's' || l_suppkey WHERE n.entity IN ('s1', 's2') GROUP BY 1")
def n6_neighbour_claims(spark, sf):
    near = memory.neighbours(supplier_claims(spark, sf)).filter("entity in ('s1', 's2')")
    return memory.neighbour_claims(near, line_claims(spark, sf)).groupBy("entity").agg(F.count("*").alias("claims"))


@query(f"""WITH {T}, p AS (SELECT session_id, count(*) AS turns FROM turns GROUP BY 1) SELECT session_id, turns FROM p WHERE turns // 4 > 0""")
def l_due_sessions(spark, sf):
    return ingest.due(src.turns(spark, sf), every=4)


@query()
def c24_write(spark, sf):
    """The write path over all conversations; held against the rules one by one in tests/test_ingest.py."""
    out = ingest.write(src.turns(spark, sf))
    return out["events"].groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("session_id").alias("sessions"))


DOOR = "how many times did u12 login"


def tokens_at(column: str) -> str:
    return f"greatest(1, length({column}) // 4)"


@query(f"""WITH {episodes_sql(DOOR)}, {hybrid_sql(DOOR, 1)},
ranked AS (
  SELECT replace(session_id, 's', '') AS session_id, 'fact' AS kind, claim_id AS id, 1.0::DOUBLE AS w, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, claim_id) AS rk FROM hy
  UNION ALL SELECT session_id, 'turn', turn_id, 0.9::DOUBLE, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, turn_id) FROM ep),
fused AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, kind, id) AS place
  FROM (SELECT session_id, kind, id, round(w / (60 + rk), 12) AS score FROM ranked WHERE rk <= 50) QUALIFY place <= 50),
budget AS (SELECT least({model.MOST_ACROSS}, greatest(50, count(*))) AS n FROM fused WHERE place <= {model.PER_SESSION_K}),
laid AS (SELECT *, row_number() OVER (ORDER BY place <= {model.PER_SESSION_K} DESC, score DESC, kind, id, session_id) AS pos FROM fused),
hit AS (SELECT session_id, kind, id, round(score, 6) AS score, round(score / (SELECT max(l.score) FROM laid l), 4) AS norm FROM laid, budget WHERE pos <= n)
SELECT h.session_id, h.kind, h.id, h.score, h.norm, coalesce(c.source_trust < 0.4, false) AS quarantined,
  CASE WHEN regexp_matches(coalesce(c.text, t.text), '{tx.INSTRUCTION.replace("'", "''")}') THEN 'instruction' WHEN regexp_matches(coalesce(c.text, t.text), '{tx.PREFERENCE}') THEN 'preference' ELSE 'ephemeral' END AS durability,
  {tokens_at("coalesce(c.value, t.text)")} AS tokens
FROM hit h LEFT JOIN claims c ON c.claim_id = h.id LEFT JOIN turns t ON t.turn_id = h.id""")
def n10_query_door(spark, sf):
    """The answer over all sessions: what is served, how it may be trusted, and what it costs."""
    found = context.answer(session_claims(spark, sf), src.turns(spark, sf), DOOR, NOW).hits
    return found.select("session_id", "kind", "id", F.round("score", 6).alias("score"), "norm", "quarantined", "durability", "tokens")


@query(f"""WITH RECURSIVE {TOOLS_SQL}, terms AS (SELECT string_agg(term, ' ') AS memory FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(c_mktsegment), '[a-z0-9]+')) AS term FROM customer) WHERE length(term) > 1),
asks(run, weight, query) AS (SELECT 'query', 0.5::DOUBLE, '{TOOL_ASK}' UNION ALL SELECT 'memory', 0.3::DOUBLE, memory FROM terms),
q AS (SELECT run, weight, token, count(*) AS qc FROM (SELECT run, weight, unnest(regexp_extract_all(lower(query), '[a-z0-9]+')) AS token FROM asks) GROUP BY ALL),
tok AS (SELECT id, regexp_extract_all(lower(text), '[a-z0-9]+') AS tk FROM tools), corpus AS (SELECT count(*) AS n, avg(len(tk)) AS avgdl FROM tok),
post AS (SELECT run, weight, id, len(tk) AS dl, token, qc, len(list_filter(tk, lambda x: x = token))::DOUBLE AS tf FROM tok, q),
dfs AS (SELECT token, count(DISTINCT id) FILTER (tf > 0) AS df FROM post GROUP BY 1),
bm AS (SELECT run, weight, id, round(sum(CASE WHEN tf > 0 THEN qc * ln((n - df + 0.5) / (df + 0.5) + 1.0) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) ELSE 0 END), 12) AS bm25 FROM post JOIN dfs USING (token), corpus GROUP BY ALL),
r AS (SELECT id, weight / (60 + row_number() OVER (PARTITION BY run ORDER BY bm25 DESC, id)) AS share FROM bm)
SELECT id, round(sum(share), 6) AS score FROM r GROUP BY id ORDER BY round(sum(share), 12) DESC, id LIMIT 10""")
def n25_discover_tools(spark, sf):
    c = src.table(spark, sf, "customer")
    known = c.select(F.lit(0.5).alias("importance"), F.col("c_mktsegment").alias("text"))
    return context.discover_tools(tool_registry(spark, sf), TOOL_ASK, known).select("id", F.round("score", 6).alias("score"))



@query(f"""WITH {V}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id, value ORDER BY predicate LIKE '%preference%' DESC, confidence DESC, created_ts, claim_id) AS k FROM validity WHERE status = 'active')
SELECT session_id, substr('User context: ' || string_agg(value, '; ' ORDER BY predicate LIKE '%preference%' DESC, confidence DESC, created_ts, claim_id) || '.', 1, 600) AS instruction FROM r WHERE k = 1 GROUP BY session_id""")
def n24_instruction(spark, sf):
    return context.instruction(validity(spark, sf)[0].withColumn("importance", F.col("confidence")))


@query("""SELECT sha256('t' || c_custkey) AS token_hash, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE 'old' END AS principal, 'ns' || c_nationkey AS namespace, c_custkey % 3 = 0 AS can_write, CASE WHEN c_custkey % 2 = 0 THEN 7 ELSE 1 END::BIGINT AS created_ts FROM customer""")
def n18_registered(spark, sf):
    c = src.table(spark, sf, "customer").withColumns({"token": F.concat(F.lit("t"), "c_custkey"), "namespace": F.concat(F.lit("ns"), "c_nationkey"), "can_write": F.col("c_custkey") % 3 == 0})
    none = spark.createDataFrame([], "token_hash string, principal string, namespace string, can_write boolean, created_ts long")
    old = memory.registered_principals(none, c.withColumn("principal", F.lit("old")), 1)
    return memory.registered_principals(old, c.filter("c_custkey % 2 = 0").withColumn("principal", F.lit("new")), 7)


@query(f"WITH RECURSIVE {FOLD} SELECT session_id, 'drift_blocked' AS kind, old_claim_id AS target_id, new_claim_id AS detail, created_ts AS ts FROM made WHERE edge_type = 'blocked'")
def n19_drift_audit(spark, sf):
    return facts.drift_audit(folded(spark, sf))


#: The channels of facts under SQL: name, weight for a query that counts recency three times, and what is ranked.
CHANNELS = (
    ("entity", model.WEIGHTS["entity"], "greatest(CASE WHEN list_contains(words, subject) THEN 1.0 ELSE 0 END, CASE WHEN k % 9 = 0 THEN 1.0 ELSE 0 END, CASE WHEN k % 11 = 0 THEN 0.6 ELSE 0 END)"),
    ("temporal", model.WEIGHTS["temporal"] * 3, "recency"), ("bm25", model.WEIGHTS["bm25"], "bm25"), ("confidence", model.WEIGHTS["confidence"], "confidence"), ("frequency", model.WEIGHTS["frequency"], "frequency"),
    ("importance", model.WEIGHTS["importance"], "k % 10"), ("usage", model.WEIGHTS["usage"], "k % 7"), ("trust", model.WEIGHTS["trust"], "source_trust"), ("scope", model.WEIGHTS["scope"], f"CASE WHEN recency BETWEEN {NOW - 20 * model.DAY_NS} AND {NOW - 10 * model.DAY_NS} THEN 1 ELSE 0 END"),
    ("predicate_match", model.WEIGHTS["predicate"], "CASE WHEN predicate IN ('login', 'click') THEN 1 ELSE 0 END"), ("semantic", model.WEIGHTS["semantic"], "coalesce(CASE WHEN k % 5 <> 0 THEN (k % 17) / 17.0 END, 0)"),
)
SHARES = ", ".join(f"{w} / (60.0 + row_number() OVER (PARTITION BY session_id ORDER BY {c} DESC, created_ts, claim_id)) AS {n}" for n, w, c in CHANNELS)


@query(f"""WITH {C}, served AS (SELECT *, CAST(substr(claim_id, 4) AS BIGINT) AS k FROM claims WHERE CAST(substr(claim_id, 4) AS BIGINT) % 19 <> 0), {bm25_sql('served', 'claim_id', 'session_id', CLAIM_ASK)},
sch AS (SELECT served.*, bm25, {sorted(set(CLAIM_ASK.split()))} AS words, CASE WHEN k % 3 = 0 THEN created_ts - {5 * model.DAY_NS} ELSE valid_from_ts END AS recency, count(*) OVER (PARTITION BY session_id, subject, predicate) AS frequency FROM served JOIN bm ON bm.id = claim_id),
shares AS (SELECT session_id, claim_id, k, {SHARES} FROM sch),
placed AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY round({" + ".join(n for n, _, _ in CHANNELS)}, 12) DESC, claim_id) AS place FROM shares WHERE k % 13 <> 0)
SELECT session_id, claim_id, place, channel, round(share, 9) AS share FROM (UNPIVOT (SELECT * EXCLUDE (k) FROM placed) ON {", ".join(n for n, _, _ in CHANNELS)} INTO NAME channel VALUE share)""")
def j11_all_channels(spark, sf):
    """Every claim of each session by all eleven channels, with what each channel adds: superseded ones are no candidates, demoted ones are ranked and then left out."""
    k = F.substring("claim_id", 4, 20).cast("long")
    claims = src.claims(spark, sf).withColumns({
        "status": F.when(k % 19 == 0, "superseded").otherwise("confirmed"), "demoted": k % 13 == 0, "importance": k % 10 / 10.0, "usage": (k % 7).cast("double"), "similarity": F.when(k % 5 != 0, k % 17 / 17.0),
        "event_ts": F.when(k % 3 == 0, F.col("created_ts") - 5 * model.DAY_NS),
    })
    named = claims.select("claim_id", F.when(k % 9 == 0, "Login").otherwise("elsewhere").alias("entity_text"))
    scope = (NOW - 20 * model.DAY_NS, NOW - 10 * model.DAY_NS)
    ranked = rank.facts(claims, CLAIM_ASK, scope=scope, families=("login", "click"), semantic="similarity", explain="shares", entities=named, near=claims.filter(k % 11 == 0))
    placed = ranked.withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("score"), "claim_id")).cast("long"))
    return placed.select("session_id", "claim_id", "place", F.explode("shares").alias("channel", "share")).withColumn("share", F.round("share", 9))


@query(f"""WITH {src.NOTES_SQL}, n AS (SELECT *, CAST(replace(claim_id, 'cl_', '') AS BIGINT) AS k FROM notes), said AS (SELECT source_turn_id AS turn_id, string_agg(upper(value), '. ' ORDER BY k) AS text FROM n GROUP BY 1),
gone AS (SELECT source_turn_id AS turn_id, list(DISTINCT value ORDER BY length(value) DESC, value DESC) AS v FROM n WHERE k % 4 = 1 OR source_turn_id LIKE '%7' GROUP BY 1),
stays AS (SELECT s.turn_id, text, v FROM said s LEFT JOIN gone g USING (turn_id) WHERE s.turn_id IN (SELECT source_turn_id FROM n WHERE NOT (k % 4 = 1 OR source_turn_id LIKE '%7')))
SELECT turn_id, CASE WHEN v IS NULL THEN text ELSE regexp_replace(regexp_replace(regexp_replace(text, v[1], '[redacted]', 'gi'), coalesce(v[2], v[1]), '[redacted]', 'gi'), coalesce(v[3], v[1]), '[redacted]', 'gi') END AS text FROM stays""")
def n15_masked_turns(spark, sf):
    """Turns after some of their notes are forgotten: what those said is masked in any case of letters, longer notes first, and turns without notes go."""
    claims, k = src.notes(spark, sf), F.replace("claim_id", F.lit("cl_"), F.lit("")).cast("long")
    turns = claims.groupBy(F.col("source_turn_id").alias("turn_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), F.upper("value").alias("v")))), lambda x: x["v"]), ". ").alias("text"))  # at most three notes a turn
    targets = claims.filter((k % 4 == 1) | F.col("source_turn_id").endswith("7")).select("claim_id")
    return memory.forget({"claims": claims, "turns": turns}, targets, NOW)["turns"].select("turn_id", "text")
