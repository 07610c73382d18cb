"""Queries through a store with commits: replacement by key, leased extraction, vectors by content, the write path's rows, frames' groups, signals kept up from changes."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import context, facts, frames, ingest, signals, views
from factloom.plans.queries import C, DAY, EVENT_COUNTS, EVENT_KIND, NOW, O, ORACLE as STATED, T, TEXT_FOLD, V, checkpoint, extracted_sql, shared_dir, validity
from factloom.sources import cache, store as st, tables as src, work

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def new_store(spark: SparkSession) -> st.Store:
    return st.Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")


@query(f"""WITH {C}, n AS (SELECT claim_id, value, CAST(replace(claim_id, 'cl_', '') AS BIGINT) AS k FROM claims)
SELECT 1::BIGINT AS version, claim_id, value FROM n WHERE k % 2 = 0 UNION ALL SELECT 2, claim_id, value FROM n
UNION ALL SELECT 3, claim_id, CASE WHEN k % 10 = 0 THEN 'new ' || value ELSE value END FROM n UNION ALL SELECT 4, claim_id, CASE WHEN k % 10 = 0 THEN 'new ' || value ELSE value END FROM n WHERE k % 3 <> 0""")
def a19_versions(spark, sf):
    """Claims in a store that is appended to, replaced in by key, compacted and written anew; each version read as it was."""
    rows = src.claims(spark, sf).select("claim_id", "value", F.replace("claim_id", F.lit("cl_"), F.lit("")).cast("long").alias("k"))
    store = new_store(spark)
    store.commit({"claims": st.append(rows.filter("k % 2 = 0"), unique=("claim_id",))})
    store.commit({"claims": st.append(rows.filter("k % 2 <> 0"), unique=("claim_id",))})
    third = store.commit({"claims": st.replace(rows.filter("k % 10 = 0").withColumn("value", F.concat(F.lit("new "), "value")), "claim_id")})
    store.compact("claims")
    last = store.commit(lambda m: {"claims": st.overwrite(store.read_at(m, "claims").filter("k % 3 <> 0"))})
    read = lambda n, v: store.read("claims", v).select(F.lit(n).cast("long").alias("version"), "claim_id", "value")
    return read(1, 1).unionByName(read(2, 2)).unionByName(read(3, third)).unionByName(read(4, last))


EXTRACTED = f"ex AS ({extracted_sql()})"


@query(f"WITH {T}, {EXTRACTED} SELECT turn_id, CASE WHEN turn_id IN (SELECT turn_id FROM ex) THEN 'done' ELSE 'skipped' END AS status, 1::BIGINT AS attempts FROM turns")
def l_leased_extraction(spark, sf):
    """All turns through the table of work: leased, extracted, stored and ended."""
    turns, store = src.turns(spark, sf), new_store(spark)
    work.enqueue(store, turns)
    return work.drain(store, turns, "worker", 0, most=2**31 - 1).select("turn_id", "status", F.col("attempts").cast("long").alias("attempts"))


@query(f"""WITH {T}, {EXTRACTED} SELECT turn_id, source, sha256('hash-64' || chr(0) || text) AS key, 64::BIGINT AS n, embedded FROM (
  SELECT turn_id, 'turn' AS source, text, (SELECT count(DISTINCT text) FROM turns) AS embedded FROM turns UNION ALL SELECT turn_id, 'again', text, 0 FROM turns
  UNION ALL SELECT turn_id || '_' || ordinal, 'claim', value, (SELECT count(DISTINCT value) FROM ex WHERE value NOT IN (SELECT text FROM turns)) FROM ex)""")
def a15_cached_vectors(spark, sf):
    """Turns and claims embedded through one cache; the second run over the turns embeds nothing."""
    turns, store, embed = src.turns(spark, sf).select("turn_id", "text"), new_store(spark), src.hash_embedder()
    claims = facts.extract(src.turns(spark, sf)).select(F.concat_ws("_", "turn_id", F.col("ordinal").cast("string")).alias("turn_id"), F.col("value").alias("text"))
    parts = []
    for name, rows in (("turn", turns), ("again", turns), ("claim", claims)):
        got, fresh = cache.embedded(store, rows, embed, "hash-64")
        parts.append(got.select("turn_id", F.lit(name).alias("source"), cache.key("hash-64", F.col("text")).alias("key"), F.size("embedding").cast("long").alias("n"), F.lit(fresh).cast("long").alias("embedded")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# What the write path makes of what customers say: claims, and the edges of their slots by the fold of many values.
WRITTEN = f"""{src.SAYINGS_SQL}, {EXTRACTED.replace(T, src.SAYINGS_SQL)},
made AS (SELECT 'cl_' || left(sha256(concat_ws('|', e.turn_id, e.ordinal::VARCHAR, e.subject, e.predicate, e.value)), 12) AS claim_id, e.session_id AS session, e.turn_id AS source_turn_id,
  regexp_replace(regexp_replace(lower(e.subject), '^\\s+|\\s+$', '', 'g'), '\\s+', '_', 'g') AS subject, e.predicate, e.value, t.speaker, CASE t.speaker WHEN 'user' THEN 1.0 ELSE 0.5 END::DOUBLE AS source_trust, t.ts + e.ordinal AS created_ts
  FROM ex e JOIN turns t ON t.turn_id = e.turn_id WHERE trim(e.value) <> ''),
notes AS (SELECT *, session || '|' || subject || '|' || predicate AS session_id FROM made)"""
WRITE_FOLD = WRITTEN + TEXT_FOLD.removeprefix(src.NOTES_SQL)


@query(f"WITH RECURSIVE {WRITE_FOLD} SELECT old_claim_id, new_claim_id, edge_type, created_ts FROM fold WHERE old_claim_id IS NOT NULL")
def c24_written_edges(spark, sf):
    return ingest.write(src.sayings(spark, sf))["edges"].select("old_claim_id", "new_claim_id", "edge_type", "created_ts")


@query(f"""WITH RECURSIVE {WRITE_FOLD}, gone AS (SELECT DISTINCT old_claim_id FROM fold WHERE old_claim_id IS NOT NULL AND edge_type NOT IN ('blocked', 'contradicts'))
SELECT claim_id, session AS session_id, source_turn_id, subject, predicate, value, created_ts, CASE WHEN claim_id IN (FROM gone) THEN 'superseded' ELSE 'active' END AS status FROM notes""")
def c24_written_claims(spark, sf):
    return ingest.write(src.sayings(spark, sf))["claims"].select("claim_id", "session_id", "source_turn_id", "subject", "predicate", "value", "created_ts", "status")


STOP_LIST = "[" + ", ".join(f"'{x}'" for x in frames.STOPS) + "]"
PLACED = f"""s AS (SELECT *, list_distinct(list_filter(regexp_extract_all(lower(value), '[a-z0-9]+'), lambda w: NOT list_contains({STOP_LIST}, w))) AS words FROM stories),
pairs AS (SELECT a.session_id, a.turn_index AS a, b.turn_index AS b FROM s a JOIN s b ON a.session_id = b.session_id AND b.turn_index - a.turn_index BETWEEN 1 AND {frames.REACH}
  WHERE (a.entity = b.entity AND a.entity <> 'user') OR len(list_intersect(a.words, b.words)) >= 2),
ways AS (SELECT session_id, a, b FROM pairs UNION ALL SELECT session_id, b, a FROM pairs),
walk AS (SELECT session_id, turn_index AS start, turn_index AS met FROM s UNION SELECT w.session_id, w.start, p.b FROM walk w JOIN ways p ON p.session_id = w.session_id AND p.a = w.met),
homes AS (SELECT session_id, start AS turn_index, min(met) AS home FROM walk GROUP BY ALL),
kinds AS (SELECT s.*, {{}} AS kind FROM s),"""


#: The event type of a column named value: of the types whose signals it has most of, the first.
KIND = f"(SELECT {EVENT_KIND} FROM (SELECT {EVENT_COUNTS}))"

GROUPS = f"""{src.STORIES_SQL}, {PLACED.replace("{}", KIND)}
placed AS (SELECT k.*, h.home, count(*) OVER (PARTITION BY k.session_id, h.home) AS members FROM kinds k JOIN homes h USING (session_id, turn_index)),
drawn AS (SELECT l.session_id, l.turn_index, arg_min(o.home, (abs(o.turn_index - l.turn_index), o.turn_index)) AS drawn FROM placed l JOIN placed o
  ON o.session_id = l.session_id AND abs(o.turn_index - l.turn_index) <= {frames.NEAR} AND o.kind IS NOT NULL AND o.kind <> '{frames.PROVIDER}' WHERE l.kind = '{frames.PROVIDER}' AND l.members = 1 GROUP BY ALL),
settled AS (SELECT p.*, coalesce(d.drawn, p.home) AS event FROM placed p LEFT JOIN drawn d USING (session_id, turn_index)),
told AS (SELECT session_id, event, string_agg(value, ' ' ORDER BY turn_index, claim_id) AS value, string_agg(turn_id, ',' ORDER BY turn_index) AS turn_ids, min(confidence)::DOUBLE AS confidence,
  array_to_string(list_sort(list(DISTINCT entity)), ',') AS participants FROM settled GROUP BY ALL)"""


@query(f"WITH RECURSIVE {GROUPS} SELECT session_id, turn_ids, confidence, participants, event_type FROM (SELECT *, {KIND} AS event_type FROM told) WHERE event_type IS NOT NULL")
def n5_frame_groups(spark, sf):
    """The events of the stories: which turns speak of one, who takes part, and its type."""
    rows = frames.event_frames(src.stories(spark, sf), checkpoint)
    return rows.select("session_id", F.array_join("turn_ids", ",").alias("turn_ids"), "confidence", F.array_join("participants", ",").alias("participants"), "event_type")


NOISE_LIST = "[" + ", ".join(f"'{x}'" for x in context.TERM_NOISE) + "]"


@query(f"""WITH {src.NOTES_SQL}, w AS (SELECT session_id, (CAST(replace(claim_id, 'cl_', '') AS BIGINT) % 10) / 10.0 AS weight, unnest(list_distinct(regexp_extract_all(lower(value), '[a-z0-9]+'))) AS term FROM notes),
b AS (SELECT session_id, term, max(weight) AS weight FROM w WHERE length(term) > 1 AND NOT list_contains({NOISE_LIST}, term) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY weight DESC, term) AS rn FROM b)
SELECT session_id, string_agg(term, ' ' ORDER BY rn) AS terms FROM r WHERE rn <= {context.MOST_TERMS} GROUP BY session_id""")
def n24_structured_terms(spark, sf):
    """What each customer's notes say of them, as words that condition a search for tools."""
    claims = src.notes(spark, sf).withColumns({"status": F.lit("active"), "importance": F.replace("claim_id", F.lit("cl_"), F.lit("")).cast("long") % 10 / 10.0})
    return context.structured_terms(claims).select("session_id", F.array_join("terms", " ").alias("terms"))


# Chains of the notes' claims, one after another from the newest, by the fold of their slots: a small store within a large one is every customer.
CHAINS = f"""{TEXT_FOLD},
up AS (SELECT new_claim_id, arg_max(old_claim_id, (created_ts, old_claim_id)) AS old_claim_id FROM fold WHERE old_claim_id IS NOT NULL AND edge_type NOT IN ('blocked', 'contradicts') GROUP BY 1),
chain AS (SELECT claim_id AS head, claim_id, 0::BIGINT AS step FROM notes WHERE claim_id NOT IN (SELECT old_claim_id FROM up) UNION ALL SELECT c.head, u.old_claim_id, c.step + 1 FROM chain c JOIN up u ON u.new_claim_id = c.claim_id)"""


@query(f"WITH RECURSIVE {CHAINS} SELECT c.head, c.step, c.claim_id, n.value FROM chain c JOIN notes n USING (claim_id)")
def d17_chains_by_head(spark, sf):
    """Each claim that nothing replaced, with what it replaced, step by step."""
    claims = src.notes(spark, sf)
    edges = facts.supersede(claims).filter(~F.col("edge_type").isin("blocked", "contradicts"))
    return views.chains_by_head(claims.select("claim_id", "value"), edges, checkpoint).select("head", F.col("step").cast("long").alias("step"), "claim_id", "value")


def fed(spark: SparkSession, claims: DataFrame, edges: DataFrame, parts: int = 3) -> st.Store:
    """A store whose signals followed the log in so many stretches of time, each delivered twice."""
    edges = checkpoint(edges)
    store, changes = new_store(spark), checkpoint(signals.feed_of(claims, edges))
    first, last = changes.agg(F.min("seq"), F.max("seq")).first()
    stretch = lambda c: F.least(F.floor((F.col(c) - (first or 0)) / max(1, ((last or 0) - (first or 0)) // parts)), F.lit(parts - 1))
    for k in range(parts):
        for _ in range(2):
            signals.feed_claims(store, k, changes.filter(stretch("seq") == k))
            signals.feed_edges(store, k, edges.filter(stretch("created_ts") == k))
        signals.write_back(store, NOW)
    return store


@query(STATED["f8_importance"])
def f9_kept_importance(spark, sf):
    """Importance of all claims as written back while the log came in, stretch by stretch; nothing is computed anew from the whole."""
    return signals.metadata(fed(spark, *validity(spark, sf))).select("claim_id", F.round("importance", 6).alias("importance"))


@query(f"""WITH scores AS ({STATED["f8_importance"].replace("round(0.25", "(0.25").replace("5.0), 6) AS importance", "5.0)) AS importance, confidence, created_ts")}),
used AS (SELECT *, CASE WHEN k % 10 = 0 THEN 2 WHEN k % 5 = 0 THEN 1 ELSE 0 END::BIGINT AS access_count, CASE WHEN k % 5 = 0 THEN {NOW - 20 * DAY} ELSE 0 END AS seen FROM (SELECT *, CAST(substr(claim_id, 4) AS BIGINT) AS k FROM scores)),
u AS (SELECT *, round(0.4 * importance + 0.3 * access_count / (access_count + 3.0) + 0.2 / (1.0 + greatest(0.0, ({NOW} - greatest(created_ts, seen)) / {float(DAY)}) / 90.0) + 0.1 * confidence, 4) AS utility FROM used)
SELECT claim_id, access_count, utility, utility < 0.45 AND created_ts < {NOW - 10 * DAY} AND k % 4 <> 0 AS demoted FROM u""")
def f11_demoted(spark, sf):
    """Claims that are served, demoted by their utility, and partly brought back, in the store of signals."""
    claims, edges = validity(spark, sf)
    store = fed(spark, claims, edges)
    k = F.substring("claim_id", 4, 20).cast("long")
    served = claims.select("claim_id", F.lit(NOW - 20 * DAY).alias("ts")).filter(k % 5 == 0)
    signals.feed_access(store, 0, served)
    signals.feed_access(store, 1, served.filter(k % 10 == 0))
    signals.feed_access(store, 1, served)  # a batch that comes again, whatever it holds now
    signals.demote(store, NOW, 0.45, 10.0)
    signals.restore(store, claims.filter(k % 4 == 0))
    return signals.utility(signals.metadata(store), NOW).select("claim_id", "access_count", "utility", "demoted")


@query(f"""WITH {O}, narrowed AS (SELECT * REPLACE (subject || value AS subject) FROM order_claims),
slots AS (SELECT subject, predicate FROM narrowed GROUP BY ALL HAVING count(DISTINCT value) = 1),
g AS (SELECT subject, predicate, value, min(ROW(created_ts, claim_id))[2] AS canonical FROM narrowed JOIN slots USING (subject, predicate) GROUP BY ALL HAVING count(DISTINCT session_id) >= 3 AND count(*) >= 2)
SELECT claim_id, canonical AS consolidated_into, CASE WHEN claim_id = canonical THEN 0.9 ELSE 0.5 END::DOUBLE AS importance, coalesce(claim_id <> canonical, false) AS demoted FROM narrowed LEFT JOIN g USING (subject, predicate, value)""")
def n7_consolidated(spark, sf):
    """Values held in three sessions or more, written back: the first claim is raised, the others are demoted and name it."""
    rows = src.order_claims(spark, sf).withColumns({"subject": F.concat("subject", "value"), "confidence": F.lit(1.0), "status": F.lit("active"), "was": F.lit(None).cast("string"), "seq": F.col("created_ts")})
    store = new_store(spark)
    signals.feed_claims(store, 0, rows.select(*signals.CLAIM, "was", "seq"))
    signals.consolidate(store)
    return signals.metadata(store).select("claim_id", "consolidated_into", "importance", "demoted")


ENDS = r"^[\s\x0B\x{85}\p{Z}]+|[\s\x0B\x{85}\p{Z}]+$"


@query(f"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '{ENDS}', '', 'g') AS body FROM documents),
lines AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM d WHERE doc_id % 5 <> 4 AND body <> ''),
said AS (SELECT *, regexp_replace(line, '{ENDS}', '', 'g') AS said FROM lines),
kept AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS place, CASE WHEN doc_id % 5 = 3 THEN 'user' WHEN i % 3 = 1 THEN 'assistant' WHEN i % 3 = 2 THEN 'system' ELSE 'user' END AS speaker FROM said WHERE said <> ''),
told AS (SELECT doc_id, source, place, speaker, CASE WHEN i = 0 AND source IS NOT NULL AND source <> '' THEN 'Document context: ' || source || chr(10) ELSE '' END || upper(speaker[1]) || speaker[2:] || ' turn: ' || said AS text FROM kept
  UNION ALL SELECT doc_id, source, 0, 'user', CASE WHEN source IS NOT NULL AND source <> '' THEN 'Document context: ' || source || chr(10) ELSE '' END || 'Document turn: ' || body FROM d WHERE doc_id % 5 = 4 OR body = '')
SELECT 'doc:' || doc_id || ':' || place AS turn_id, speaker, text, (1704067200 + doc_id + place) * 1000000000 AS ts, coalesce(source, 'default') AS namespace FROM told""")
def a10_document_turns(spark, sf):
    """Documents as sessions in each of the shapes: their lines as a list of messages, as JSON of three forms, or the text as it is."""
    d = src.table(spark, sf, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    shape = F.when(src.bare(F.col("text")) == "", 4).otherwise(F.pmod("doc_id", F.lit(5)))
    role = lambda i: F.when(i % 3 == 1, " AI").when(i % 3 == 2, "developer").otherwise("user")
    lines = lambda f: F.transform(F.split("text", "\n"), f)
    content = (
        F.when(shape == 1, F.to_json(lines(lambda x, i: F.struct(role(i).alias("speaker"), F.array(F.struct(x.alias("text"))).alias("content")))))
        .when(shape == 2, F.to_json(F.struct(lines(lambda x, i: F.struct(role(i).alias("role"), F.lit(" ").alias("content"), x.alias("utterance"))).alias("turns"))))
        .when(shape == 3, F.to_json(F.struct(lines(lambda x, i: x).alias("conversation")))).when(shape == 4, F.col("text"))
    )
    docs = d.select(
        F.col("doc_id").cast("string").alias("id"), F.col("source").alias("user_id"), (F.col("doc_id") + 1704067200).cast("string").alias("timestamp"), F.col("source").alias("context"), content.alias("content"),
        F.when(shape == 0, lines(lambda x, i: F.struct(role(i).alias("role"), x.alias("content")))).alias("messages"),
    )
    return src.document_turns(docs).select("turn_id", "speaker", "text", "ts", "namespace")
