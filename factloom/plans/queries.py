"""Registered queries over the supplied tables, each with SQL that states the same where SQL can."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom import model
from factloom.functions import text as tx
from factloom.operators import bursts, context, facts, frames, memory, rank, semantic, views
from factloom.sources import tables as src
from factloom.streaming import stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

T, C, O = src.TURNS_SQL, src.CLAIMS_SQL, src.ORDER_CLAIMS_SQL
DAY = model.DAY_NS
NOW = 1706745600 * 1_000_000_000  # 2024-02-01
ASK = "the of and what is in the"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local master may use a temporary one."""
    found, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if not found and not context._jsc.sc().getCheckpointDir().isDefined():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="factloom-"))
    return found or context._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts lineage by the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


# Validity in slots of one value, the base of many queries.
V = f"""{C}, changed AS (
  SELECT * FROM (SELECT *, lag(value) OVER (PARTITION BY session_id, subject, predicate ORDER BY created_ts, claim_id) AS before FROM claims)
  WHERE before IS NULL OR before <> value),
validity AS (
  SELECT *, lead(created_ts) OVER w AS valid_until_ts, lead(claim_id) OVER w AS superseded_by,
    CASE WHEN lead(claim_id) OVER w IS NULL THEN 'active' ELSE 'superseded' END AS status
  FROM changed WINDOW w AS (PARTITION BY session_id, subject, predicate ORDER BY created_ts, claim_id)),
edges AS (SELECT claim_id AS old_claim_id, superseded_by AS new_claim_id, valid_until_ts AS created_ts FROM validity WHERE superseded_by IS NOT NULL)"""


def validity(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = facts.cardinality_validity(src.claims(spark, sf))
    return rows, facts.edges_of(rows)


# --- sources, scans ---


@query(f"WITH {V} SELECT claim_id, created_ts FROM validity WHERE session_id = 's3' AND status = 'active'")
def a3_active_claims(spark, sf):
    return views.active(validity(spark, sf)[0]).filter("session_id = 's3'").select("claim_id", "created_ts")


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS name, p_partkey AS created_at FROM part
UNION ALL SELECT p_partkey + 1000000000, upper(p_name), -1 FROM part WHERE p_partkey % 100 = 0""")
def a8_tool_upsert(spark, sf):
    p = src.table(spark, sf, "part")
    old = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_partkey").alias("created_at"))
    hit = p.filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), F.upper("p_name").alias("name"), F.lit(-1).cast("long").alias("created_at"))
    new = p.filter("p_partkey % 100 = 0").select((F.col("p_partkey") + 1000000000).alias("id"), F.upper("p_name").alias("name"), F.lit(-1).cast("long").alias("created_at"))
    return src.upsert(old, hit.unionByName(new))


@query("""WITH s AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y/%m/%d') ELSE strftime(o_orderdate, '%m/%d/%Y') END AS text FROM orders)
SELECT o_orderkey, epoch_us(CASE o_orderkey % 3 WHEN 0 THEN strptime(text, '%Y-%m-%d') WHEN 1 THEN strptime(text, '%Y/%m/%d') ELSE strptime(text, '%m/%d/%Y') END) * 1000 AS ns FROM s""")
def a12_parse_timestamp(spark, sf):
    o = src.table(spark, sf, "orders")
    day = F.col("o_orderdate")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.date_format(day, "yyyy-MM-dd")).when(F.col("o_orderkey") % 3 == 1, F.date_format(day, "yyyy/MM/dd")).otherwise(F.date_format(day, "MM/dd/yyyy"))
    zone = spark.conf.get("spark.sql.session.timeZone")
    ns = src.parse_timestamp(text)
    shift = F.unix_micros(F.to_timestamp(F.lit("1970-01-01"))) * 1000 if zone != "UTC" else F.lit(0)
    return o.select("o_orderkey", (ns - shift).alias("ns"))


@query(f"WITH {T} SELECT namespace, count(DISTINCT session_id) AS sessions, count(*) AS turns FROM turns GROUP BY namespace")
def a17_namespace_scan(spark, sf):
    return src.turns(spark, sf).groupBy("namespace").agg(F.count_distinct("session_id").alias("sessions"), F.count("*").alias("turns"))


@query("SELECT vec_id, len(embedding) AS n, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 5) AS total FROM embeddings")
def a14_vector_codec(spark, sf):
    rows = src.table(spark, sf, "embeddings").select("vec_id", src.decode_vector(src.encode_vector("embedding")).alias("embedding"))
    return rows.select("vec_id", F.size("embedding").cast("long").alias("n"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@query(f"WITH {T} SELECT turn_id, 'hash-64' AS model_version, 64::BIGINT AS n FROM turns")
def a16_embedding_backfill(spark, sf):
    rows = src.turns(spark, sf)
    embed = src.hash_embedder()
    have = rows.filter(F.crc32(F.col("turn_id").cast("binary")) % 2 == 0).select("turn_id", embed("text").alias("embedding"), F.lit("hash-64").alias("model_version"))
    return src.backfill(rows, have, embed, "hash-64", "turn_id", "text").select("turn_id", "model_version", F.size("embedding").cast("long").alias("n"))


# --- admission, predicates ---

WORDS = "list_filter(regexp_extract_all(lower(text), '[a-z'']+'), lambda x: NOT list_contains([" + ", ".join(f"'{x}'" for x in tx.FILLERS) + "], x))"


@query(f"""WITH {T} SELECT turn_id, CASE WHEN trim(regexp_replace(text, '\\s+', ' ', 'g')) = '' THEN 'empty'
  WHEN regexp_matches(text, '{tx.SILENCE}') THEN 'silence_marker' WHEN NOT regexp_matches(text, '[A-Za-z'']') THEN 'no_word_tokens'
  WHEN len({WORDS}) < 3 THEN 'only_' || len({WORDS}) || '_content_words' ELSE 'admitted' END AS reason FROM turns""")
def b1_admission(spark, sf):
    return src.turns(spark, sf).select("turn_id", tx.admission(F.col("text")).alias("reason"))


@query(f"""WITH {T} SELECT turn_id, CASE WHEN regexp_matches(text, '{tx.INSTRUCTION.replace("'", "''")}') THEN 'instruction'
  WHEN regexp_matches(text, '{tx.PREFERENCE}') THEN 'preference' ELSE 'ephemeral' END AS durability FROM turns""")
def b2_durability(spark, sf):
    return src.turns(spark, sf).select("turn_id", tx.durability(F.col("text")).alias("durability"))


AT = 1705276800 * 1_000_000_000  # 2024-01-15


@query(f"WITH {V} SELECT claim_id, subject, predicate, value FROM validity WHERE valid_from_ts <= {AT} AND (valid_until_ts IS NULL OR {AT} < valid_until_ts)")
def b4_as_of(spark, sf):
    return views.as_of(validity(spark, sf)[0], F.lit(AT)).select("claim_id", "subject", "predicate", "value")


@query(f"WITH {T} SELECT t.turn_id FROM turns t WHERE session_id IN (SELECT session_id FROM turns WHERE namespace = 'ns2')")
def b9_namespace(spark, sf):
    t = src.turns(spark, sf)
    return views.in_namespace(t, t, "ns2").select("turn_id")


@query(f"WITH {C} SELECT claim_id, source_trust, source_trust < 0.4 AS quarantined FROM claims")
def b12_quarantine(spark, sf):
    return src.claims(spark, sf).select("claim_id", "source_trust", (F.col("source_trust") < model.QUARANTINE).alias("quarantined"))


@query("""WITH f AS (SELECT l_orderkey, l_linenumber, concat_ws(',', CASE WHEN l_linenumber <> 7 AND l_quantity > 45 THEN 'triple' END, CASE WHEN l_linenumber = 7 THEN 'text' END,
  CASE WHEN l_discount >= 0.09 THEN 'confidence' END, CASE WHEN l_tax >= 0.07 OR l_tax = 0 THEN 'span' END) AS failures FROM lineitem) FROM f WHERE failures <> ''""")
def c1_rejected_facts(spark, sf):
    """Each rule is broken by some lines: a blank value, no triple and no text, too much confidence, a span that ends before it starts or has no end."""
    plain = F.col("l_linenumber") == 7
    rows = src.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(~plain, "user").alias("subject"), F.when(~plain, "bought").alias("predicate"), F.when(~plain, F.when(F.col("l_quantity") > 45, " ").otherwise("x")).alias("value"), F.when(~plain, "t").otherwise("").alias("text"),
        F.when(F.col("l_discount") >= 0.09, 1.5).otherwise(0.5).alias("confidence"), F.when(F.col("l_tax") >= 0.07, 5).when(F.col("l_tax") == 0, 1).alias("char_start"), F.when(F.col("l_tax") >= 0.07, 2).alias("char_end"), F.lit(9).alias("turn_length"),
    )
    return facts.validate(rows)[1].select("l_orderkey", "l_linenumber", F.array_join("failures", ",").alias("failures"))


@query("SELECT c_custkey, regexp_replace(regexp_replace(lower('  ' || c_name || '  X '), '^\\s+|\\s+$', '', 'g'), '\\s+', '_', 'g') AS subject FROM customer")
def c4_normalise_subject(spark, sf):
    return src.table(spark, sf, "customer").select("c_custkey", tx.normalise_subject(F.concat(F.lit("  "), "c_name", F.lit("  X "))).alias("subject"))


@query(f"WITH {O} SELECT year(make_timestamp(created_ts // 1000)) || '-Q' || quarter(make_timestamp(created_ts // 1000)) AS bin, count(*) AS n FROM order_claims GROUP BY 1")
def c5_temporal_bin(spark, sf):
    return src.order_claims(spark, sf).groupBy(tx.temporal_bin(F.col("created_ts")).alias("bin")).agg(F.count("*").alias("n"))


def extracted_sql() -> str:
    esc = lambda x: x.replace("'", "''")
    values = ", ".join("{'predicate': '%s', 'value': regexp_replace(regexp_replace(regexp_extract(tr, '%s', 1), '^\\s+|\\s+$', '', 'g'), '[.,;!?]+$', '')}" % (k, esc(x)) for x, k in tx.EXTRACTORS)
    admitted = f"trim(text) <> '' AND NOT regexp_matches(text, '{tx.SILENCE}') AND regexp_matches(text, '[A-Za-z'']') AND len({WORDS}) >= {tx.LEAST_CONTENT_WORDS}"
    return f"""WITH {T}, t AS (SELECT turn_id, session_id, text, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS tr FROM turns WHERE {admitted}),
x AS (SELECT *, list_filter([{values}], lambda f: f.value <> '') AS found, regexp_extract(tr, '[A-Z][a-z]+(?:\\s+[A-Z][a-z]+)*|[A-Z]{{2,}}', 0) AS name, regexp_replace(regexp_extract(tr, '^[^.!?\\n]*', 0), '^\\s+|\\s+$', '', 'g') AS head FROM t),
y AS (SELECT *, CASE WHEN len(found) > 0 THEN list_transform(found, lambda f: {{'subject': 'user', 'predicate': f.predicate, 'value': f.value, 'confidence': 0.5::DOUBLE}})
  ELSE [{{'subject': CASE WHEN name = '' THEN 'general' ELSE replace(lower(name), ' ', '_') END, 'predicate': 'observation', 'value': substr(CASE WHEN head <> '' THEN head ELSE tr END, 1, 200), 'confidence': 0.4::DOUBLE}}] END AS f FROM x),
z AS (SELECT turn_id, session_id, text, unnest(range(len(f))) AS ordinal, unnest(f) AS f FROM y),
w AS (SELECT *, CASE WHEN strpos(text, f.value) > 0 THEN strpos(text, f.value) - 1 WHEN strpos(lower(text), lower(f.value)) > 0 THEN strpos(lower(text), lower(f.value)) - 1 END AS a FROM z)
SELECT turn_id, session_id, ordinal::BIGINT AS ordinal, f.subject AS subject, f.predicate AS predicate, f.value AS value, f.confidence AS confidence, a::BIGINT AS char_start, (a + length(f.value))::BIGINT AS char_end FROM w"""


@query(extracted_sql())
def c7_extracted_facts(spark, sf):
    return facts.extract(src.turns(spark, sf)).withColumns({c: F.col(c).cast("long") for c in ("ordinal", "char_start", "char_end")})


@query(f"""WITH {T} SELECT turn_id, CASE WHEN strpos(text, 'the') > 0 THEN strpos(text, 'the') - 1 WHEN strpos(lower(text), 'the') > 0 THEN strpos(lower(text), 'the') - 1 END::BIGINT AS char_start FROM turns""")
def c11_char_span(spark, sf):
    return src.turns(spark, sf).select("turn_id", tx.char_span(F.col("text"), F.lit("the"))["char_start"].cast("long").alias("char_start"))


STOPS = "(" + ", ".join(f"'{x}'" for x in tx.ENTITY_STOPS) + ")"


# DuckDB's \\b knows ASCII words only, so other Latin letters become a digit there, which is in no name.
LATIN = r"[\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]"


@query(f"""WITH {T}, plain AS (SELECT turn_id, regexp_replace(text, '{LATIN}', '0', 'g') AS text FROM turns),
o AS (SELECT DISTINCT turn_id, unnest(regexp_extract_all(text, '{tx.ORGANISATION}', 0)) AS entity FROM plain),
l AS (SELECT DISTINCT turn_id, unnest(regexp_extract_all(text, '{tx.LOCATION}', 1)) AS entity FROM plain),
p AS (SELECT DISTINCT turn_id, unnest(regexp_extract_all(text, '{tx.PROPER_NOUN}', 1)) AS entity FROM plain),
m AS (FROM l WHERE entity NOT IN {STOPS} AND (turn_id, entity) NOT IN (FROM o))
SELECT *, 'organization' AS kind FROM o UNION ALL SELECT *, 'location' FROM m UNION ALL SELECT *, 'proper_noun' FROM p WHERE entity NOT IN {STOPS} AND (turn_id, entity) NOT IN (FROM o) AND (turn_id, entity) NOT IN (FROM m)""")
def c14_entities(spark, sf):
    return src.turns(spark, sf).select("turn_id", F.explode(tx.entities(F.col("text"))).alias("e")).select("turn_id", F.col("e.entity").alias("entity"), F.col("e.kind").alias("kind"))


@query(f"""WITH {V}, {T}, held AS (SELECT replace(session_id, 's', '') AS session_id, claim_id, created_ts FROM validity WHERE status = 'active')
SELECT session_id, 'claim' AS kind, claim_id AS id, created_ts AS ts FROM held
UNION ALL SELECT session_id, 'turn', turn_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, turn_id) AS rn FROM turns
  WHERE session_id NOT IN (SELECT session_id FROM held)) WHERE rn <= 3""")
def c15_projection(spark, sf):
    claims = validity(spark, sf)[0].withColumn("session_id", F.replace("session_id", F.lit("s"), F.lit("")))
    return views.projection(claims, src.turns(spark, sf), 3)


@query(f"WITH {C} SELECT subject, predicate, claim_id, value FROM (SELECT *, row_number() OVER (PARTITION BY subject, predicate ORDER BY created_ts DESC, claim_id) AS rn FROM claims) WHERE rn = 1")
def c16_latest_per_slot(spark, sf):
    return views.latest_per_slot(src.claims(spark, sf)).select("subject", "predicate", "claim_id", "value")


@query(f"""WITH {V} SELECT session_id, subject, count(*) AS facts, array_to_string(list_sort(list_filter(['click','error','login','purchase','refund','view'], lambda x: NOT list_contains(list(predicate), x))), ',') AS gaps
FROM validity WHERE status = 'active' GROUP BY session_id, subject""")
def c18_world_state(spark, sf):
    rows = views.world_state(validity(spark, sf)[0], ("click", "error", "login", "purchase", "refund", "view"))
    return rows.select("session_id", "subject", F.size("facts").cast("long").alias("facts"), F.array_join("gaps", ",").alias("gaps"))


@query(f"WITH {C} SELECT source_type, speaker, source_trust, count(*) AS n FROM claims GROUP BY ALL")
def c23_source_trust(spark, sf):
    return src.claims(spark, sf).groupBy("source_type", "speaker", "source_trust").agg(F.count("*").alias("n"))


# --- truth maintenance, lineage ---


@query(f"WITH {V} SELECT claim_id, coalesce(valid_until_ts, -1) AS valid_until_ts, superseded_by, status FROM validity")
def d1a_cardinality_validity(spark, sf):
    return validity(spark, sf)[0].select("claim_id", F.coalesce("valid_until_ts", F.lit(-1)).alias("valid_until_ts"), "superseded_by", "status")


def folded(spark, sf):
    kinds = ("click", "error", "login", "purchase", "refund", "view", "logout", "signup", "search")
    return facts.supersede(src.claims(spark, sf), kinds)


# One slot after another, claim by claim: what is held, newest first, and the edge that each claim makes.
FOLD = f"""{C}, laid AS (SELECT *, source_trust::DOUBLE AS trust, row_number() OVER (PARTITION BY session_id, subject, predicate ORDER BY created_ts, claim_id) AS rn FROM claims),
fold AS (
  SELECT session_id, subject, predicate, rn, created_ts, claim_id AS new_claim_id, NULL::VARCHAR AS old_claim_id, NULL::VARCHAR AS edge_type,
    [{{'id': claim_id, 'value': value, 'turn': source_turn_id, 'speaker': speaker, 'trust': trust}}] AS held FROM laid WHERE rn = 1
  UNION ALL
  SELECT session_id, subject, predicate, rn, created_ts, claim_id, old.id, kind,
    list_prepend({{'id': claim_id, 'value': value, 'turn': source_turn_id, 'speaker': speaker, 'trust': trust}}, CASE WHEN kind IN ('user_correction', 'assistant_confirm') THEN list_filter(held, lambda x: x.id <> old.id) ELSE held END)
  FROM (SELECT *, CASE WHEN old IS NULL THEN NULL WHEN speaker <> 'assistant' AND trust + 0.2::DOUBLE < old.trust THEN 'blocked' WHEN speaker = 'assistant' THEN 'assistant_confirm' WHEN old.speaker = 'user' THEN 'user_correction' ELSE 'contradicts' END AS kind
    FROM (SELECT n.*, f.held, list_filter(f.held, lambda x: x.value <> n.value AND x.turn <> n.source_turn_id)[1] AS old FROM fold f JOIN laid n ON n.session_id = f.session_id AND n.subject = f.subject AND n.predicate = f.predicate AND n.rn = f.rn + 1))),
made AS (SELECT session_id, subject, predicate, old_claim_id, new_claim_id, edge_type, created_ts FROM fold WHERE old_claim_id IS NOT NULL)"""


@query(f"WITH RECURSIVE {FOLD} FROM made")
def d1_supersession(spark, sf):
    return folded(spark, sf)


def listed(words) -> str:
    return "[" + ", ".join(f"'{x}'" for x in words) + "]"


# The rules of slots with many values: attributes, quantities and shared words; what each claim answers, and how.
SLOT_OF = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(padded, ' {x} ')" for x in triggers) + f" THEN '{k}'" for k, triggers in tx.ATTRIBUTES.items()) + " END"
TEXT_FOLD = f"""{src.NOTES_SQL}, w AS (SELECT *, regexp_extract_all(lower(value), '[a-z0-9]+') AS tk, list_distinct(list_filter(regexp_split_to_array(lower(trim(value)), '[\\s,;/]+'), lambda x: x <> '')) AS parts FROM notes),
x AS (SELECT *, ' ' || array_to_string(tk, ' ') || ' ' AS padded, list_distinct(list_filter(tk, lambda t: NOT list_contains({listed(tx.NOISE)}, t))) AS content FROM w),
laid AS (SELECT *, {SLOT_OF} AS slot, regexp_matches(value, '{tx.CLOSED_WINDOW}') AS closed, list_sort(list_filter(content, lambda t: NOT list_contains({listed(tx.QUANTITIES)}, t) AND NOT regexp_full_match(t, '[0-9]+'))) AS plain,
  row_number() OVER (PARTITION BY session_id ORDER BY created_ts, claim_id) AS rn FROM x),
me AS (SELECT *, {{'id': claim_id, 'value': lower(trim(value)), 'turn': source_turn_id, 'speaker': speaker, 'trust': source_trust, 'slot': slot, 'closed': closed, 'content': content, 'plain': plain, 'parts': parts}} AS own FROM laid),
fold AS (
  SELECT session_id, rn, created_ts, claim_id AS new_claim_id, NULL::VARCHAR AS old_claim_id, NULL::VARCHAR AS edge_type, [own] AS held FROM me WHERE rn = 1
  UNION ALL
  SELECT session_id, rn, created_ts, claim_id, old.id, kind, list_prepend(own, CASE WHEN kind IN ('refines', 'user_correction', 'assistant_confirm') THEN list_filter(held, lambda h: h.id <> old.id) ELSE held END)
  FROM (SELECT *, CASE WHEN old IS NULL THEN NULL WHEN edge IN ('user_correction', 'contradicts') AND own.trust + 0.2::DOUBLE < old.trust THEN 'blocked' ELSE edge END AS kind
    FROM (SELECT *, CASE WHEN len(own.parts) > 0 AND len(own.parts) < len(old.parts) AND list_has_all(old.parts, own.parts) THEN 'refines' WHEN own.speaker = 'assistant' THEN 'assistant_confirm' WHEN old.speaker = 'user' THEN 'user_correction' ELSE 'contradicts' END AS edge
      FROM (SELECT *, coalesce(CASE WHEN own.slot IS NOT NULL AND NOT own.closed THEN list_filter(others, lambda h: h.slot = own.slot AND NOT h.closed)[1] END,
          list_filter(others, lambda h: len(own.plain) > 0 AND h.plain = own.plain AND NOT (len(h.content) = len(own.content) AND list_has_all(h.content, own.content)))[1],
          list_filter(others, lambda h: len(list_intersect(h.content, own.content)) >= 2 AND len(list_intersect(h.content, own.content)) / len(list_distinct(h.content || own.content))::DOUBLE >= 0.3
            AND len(list_intersect(h.content, own.content)) / len(list_distinct(h.content || own.content))::DOUBLE = list_max(list_transform(others, lambda o: CASE WHEN len(list_intersect(o.content, own.content)) >= 2 THEN len(list_intersect(o.content, own.content)) / len(list_distinct(o.content || own.content))::DOUBLE ELSE 0 END)))[1]) AS old
        FROM (SELECT n.session_id, n.rn, n.created_ts, n.claim_id, n.own, f.held, list_filter(f.held, lambda h: h.turn <> n.own.turn AND h.value <> n.own.value) AS others FROM fold f JOIN me n ON n.session_id = f.session_id AND n.rn = f.rn + 1)))))"""


@query(f"WITH RECURSIVE {TEXT_FOLD} SELECT session_id, old_claim_id, new_claim_id, edge_type, created_ts FROM fold WHERE old_claim_id IS NOT NULL")
def d5_text_supersession(spark, sf):
    """Slots of many values: the rules of attributes, closed windows, quantities, shared words, refinement and trust."""
    return facts.supersede(src.notes(spark, sf)).select("session_id", "old_claim_id", "new_claim_id", "edge_type", "created_ts")


@query(f"WITH RECURSIVE {FOLD} SELECT edge_type, count(*) AS n FROM made GROUP BY edge_type")
def d7_trust_guard(spark, sf):
    return folded(spark, sf).groupBy("edge_type").agg(F.count("*").alias("n"))


@query("""WITH RECURSIVE v AS (SELECT label::VARCHAR AS grp, vec_id, embedding::DOUBLE[] AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings),
f AS (SELECT grp, rn, [{'id': vec_id, 'e': e}] AS held, NULL::BIGINT AS old_id, vec_id AS new_id, NULL::DOUBLE AS score FROM v WHERE rn = 1
  UNION ALL SELECT grp, rn, list_prepend({'id': vec_id, 'e': e}, CASE WHEN best.s >= 0.45 THEN list_filter(held, lambda x: x.id <> best.id) ELSE held END),
    CASE WHEN best.s >= 0.45 THEN best.id END, vec_id, CASE WHEN best.s >= 0.45 THEN round(best.s, 6) END
  FROM (SELECT n.*, f.held, list_reverse_sort(list_transform(f.held, lambda x: {'s': list_cosine_similarity(x.e, n.e), 'id': x.id}))[1] AS best FROM f JOIN v n ON n.grp = f.grp AND n.rn = f.rn + 1))
SELECT grp AS "group", old_id, new_id, score FROM f WHERE old_id IS NOT NULL""")
def d9_semantic_supersession(spark, sf):
    v = src.table(spark, sf, "embeddings")
    rows = v.select(F.col("label").cast("string").alias("group"), F.col("vec_id").alias("id"), F.col("vec_id").alias("ts"), F.col("vec_id").cast("string").alias("turn"), "embedding")
    return semantic.within_groups(rows, checkpoint, 0.45)


COS = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))"


@query(f"SELECT a.vec_id, round({COS}, 6) AS score FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b")
def d10_cosine(spark, sf):
    v = src.table(spark, sf, "embeddings")
    probe = [float(x) for x in v.filter("vec_id = 0").first().embedding]
    return v.select("vec_id", F.round(tx.cosine(F.col("embedding"), F.array(*[F.lit(x) for x in probe])), 6).alias("score"))


@query(f"WITH {V} SELECT claim_id, first_value(claim_id) OVER w AS origin, row_number() OVER w - 1 AS depth FROM validity WINDOW w AS (PARTITION BY session_id, subject, predicate ORDER BY created_ts, claim_id)")
def d12_lineage(spark, sf):
    rows, edges = validity(spark, sf)
    return views.trace(rows, edges, checkpoint).select("claim_id", "origin", F.col("depth").cast("long").alias("depth"))


@query(f"""WITH {V} SELECT e.old_claim_id, e.new_claim_id, o.value AS old_value, n.value AS new_value FROM edges e JOIN validity o ON o.claim_id = e.old_claim_id JOIN validity n ON n.claim_id = e.new_claim_id""")
def d15_pairs(spark, sf):
    rows, edges = validity(spark, sf)
    return views.pairs(edges, rows).select("old_claim_id", "new_claim_id", "old_value", "new_value")


@query(f"WITH {V} SELECT old_claim_id AS claim_id, new_claim_id AS superseded_by FROM edges")
def d11_superseded_by(spark, sf):
    return views.superseded_by(validity(spark, sf)[1])


@query(f"""WITH RECURSIVE {FOLD}, retired AS (SELECT old_claim_id FROM made WHERE edge_type NOT IN ('blocked', 'contradicts'))
SELECT old_claim_id, new_claim_id, o.value AS old_value, n.value AS new_value FROM made JOIN claims o ON o.claim_id = old_claim_id JOIN claims n ON n.claim_id = new_claim_id
WHERE edge_type = 'contradicts' AND old_claim_id NOT IN (FROM retired) AND new_claim_id NOT IN (FROM retired)""")
def d16_contradictions(spark, sf):
    edges = folded(spark, sf)
    claims = facts.with_status(src.claims(spark, sf), edges)
    return views.contradictions(edges, claims).select("old_claim_id", "new_claim_id", "old_value", "new_value")


@query(f"WITH {V} SELECT claim_id, 'superseded' AS status FROM validity WHERE superseded_by IS NOT NULL OR claim_id LIKE '%7' UNION ALL SELECT claim_id, 'active' FROM validity WHERE superseded_by IS NULL AND claim_id NOT LIKE '%7' UNION ALL SELECT 'new', 'active' FROM validity WHERE claim_id LIKE '%7'")
def c22_corrections(spark, sf):
    rows = validity(spark, sf)[0]
    wrong = rows.filter("claim_id like '%7'").select("claim_id", F.lit("-1").alias("value"), F.lit(NOW).alias("ts"))
    claims, edges = facts.corrected(rows, wrong)
    fresh = edges.select(F.col("new_claim_id").alias("claim_id"), F.lit(True).alias("fresh"))
    return claims.join(fresh, "claim_id", "left").select(F.when(F.col("fresh"), "new").otherwise(F.col("claim_id")).alias("claim_id"), "status")


# --- aggregates and signals ---


@query(f"WITH {V} SELECT count(*) AS claims, count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'superseded') AS superseded, count(DISTINCT session_id) AS sessions, count(DISTINCT subject) AS subjects FROM validity")
def f1_stats(spark, sf):
    return views.stats(validity(spark, sf)[0])


@query(f"""WITH {C} SELECT namespace, count(*) AS claims, count(*) FILTER (source_trust >= 0.7) AS high, count(*) FILTER (source_trust >= 0.4 AND source_trust < 0.7) AS medium,
  count(*) FILTER (source_trust < 0.4) AS low, count(DISTINCT session_id) AS sessions, round(avg((source_trust < 0.4)::INT), 3) AS quarantine_rate FROM claims GROUP BY namespace""")
def f3_trust_status(spark, sf):
    return views.trust_status(src.claims(spark, sf))


LABEL = "CASE WHEN {n} = 0 THEN 'stable' WHEN {n} <= 2 THEN 'evolving' ELSE 'volatile' END"


@query(f"""WITH {V}, news AS (SELECT subject, predicate, count(*) AS n FROM edges e JOIN validity v ON v.claim_id = e.new_claim_id GROUP BY ALL),
l AS (SELECT v.*, {LABEL.format(n="coalesce(n, 0)")} AS label FROM validity v LEFT JOIN news USING (subject, predicate) WHERE status = 'active')
SELECT claim_id, label, {NOW} - created_ts > (CASE label WHEN 'stable' THEN 365 WHEN 'evolving' THEN 90 ELSE 14 END)::BIGINT * {DAY} AS stale FROM l""")
def f4_staleness(spark, sf):
    rows, edges = validity(spark, sf)
    return views.staleness(rows, edges, F.lit(NOW)).select("claim_id", "label", "stale")


@query(f"""WITH {V}, c AS (SELECT o.subject, o.predicate, count(*) AS changes FROM edges e JOIN validity o ON o.claim_id = e.old_claim_id JOIN validity n ON n.claim_id = e.new_claim_id
  WHERE o.subject = n.subject AND o.predicate = n.predicate GROUP BY ALL),
l AS (SELECT subject, predicate, avg((valid_until_ts - valid_from_ts) / {float(DAY)}) AS life, max(created_ts) FILTER (status = 'active') AS current_since FROM validity GROUP BY ALL)
SELECT subject, predicate, coalesce(changes, 0) AS changes, {LABEL.format(n="coalesce(changes, 0)")} AS label, round(life, 4) AS life_days, current_since FROM l LEFT JOIN c USING (subject, predicate)""")
def f5_volatility(spark, sf):
    rows, edges = validity(spark, sf)
    return views.volatility(rows, edges).select("subject", "predicate", "changes", "label", F.round("life_days", 4).alias("life_days"), "current_since")


@query(f"WITH {V} SELECT predicate, count(*) AS n, {LABEL.format(n='count(*)')} AS label FROM (SELECT old_claim_id AS claim_id FROM edges UNION ALL SELECT new_claim_id FROM edges) JOIN validity USING (claim_id) GROUP BY predicate")
def f6_predicate_volatility(spark, sf):
    rows, edges = validity(spark, sf)
    return views.predicate_volatility(rows, edges)


@query(f"""WITH {O}, narrowed AS (SELECT * REPLACE (subject || value AS subject) FROM order_claims),
slots AS (SELECT subject, predicate FROM narrowed GROUP BY ALL HAVING count(DISTINCT value) = 1)
SELECT subject, predicate, value, count(DISTINCT session_id) AS sessions, count(*) AS members, min(ROW(created_ts, claim_id))[2] AS canonical, greatest(max(importance), 0.9) AS importance
FROM narrowed JOIN slots USING (subject, predicate) GROUP BY ALL HAVING count(DISTINCT session_id) >= 3 AND count(*) >= 2""")
def f7_consolidation(spark, sf):
    rows = src.order_claims(spark, sf)
    return views.consolidate(rows.withColumn("subject", F.concat("subject", "value")))


@query(f"""WITH {V}, live AS (SELECT * FROM validity WHERE status = 'active'), p AS (SELECT subject, predicate, count(*) AS peers FROM live GROUP BY ALL),
s AS (SELECT subject, count(DISTINCT session_id) AS sessions FROM validity GROUP BY subject),
d AS (SELECT l.*, peers, sessions, greatest(({NOW} - created_ts) / {float(DAY)}, 0.0) AS days,
  CASE WHEN claim_id IN (SELECT new_claim_id FROM edges) THEN 1.0 WHEN claim_id IN (SELECT old_claim_id FROM edges) THEN 0.0 ELSE 0.5 END AS role
  FROM live l LEFT JOIN p USING (subject, predicate) LEFT JOIN s USING (subject))
SELECT claim_id, round(0.25 / greatest(peers, 1) + 0.20 * role + 0.15 * confidence + 0.15 * exp(-days / 30.0) + 0.15 * least(1.0, days / 180.0) + 0.10 * least(1.0, sessions / 5.0), 6) AS importance FROM d""")
def f8_importance(spark, sf):
    rows, edges = validity(spark, sf)
    return views.importance(rows, edges, F.lit(NOW)).select("claim_id", F.round("importance", 6).alias("importance"))


UTIL = f"0.4 * confidence + 0.3 * (k % 7) / ((k % 7) + 3.0) + 0.2 / (1.0 + ({NOW} - created_ts) / {float(DAY)} / 90.0) + 0.1 * confidence"


@query(f"WITH {C}, u AS (SELECT claim_id, created_ts, {UTIL} AS u FROM (SELECT *, CAST(substr(claim_id, 4) AS BIGINT) AS k FROM claims)) SELECT claim_id, round(u, 6) AS utility, u < 0.35 AND {NOW} - created_ts > {30 * DAY} AS demote FROM u")
def f10_utility(spark, sf):
    rows = src.claims(spark, sf).withColumn("k", F.substring("claim_id", 4, 20).cast("long") % 7)
    age = (F.lit(NOW) - F.col("created_ts")) / float(DAY)
    u = views.utility(F.col("confidence"), F.col("k"), age / 1.0, F.col("confidence"))
    return rows.withColumn("u", u).select("claim_id", F.round("u", 6).alias("utility"), ((F.col("u") < 0.35) & ((F.lit(NOW) - F.col("created_ts")) > 30 * DAY)).alias("demote"))


@query("SELECT token, count(*) AS df, sum(n)::BIGINT AS total FROM (SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM documents) GROUP BY ALL) GROUP BY token")
def f12_corpus_stats(spark, sf):
    return rank.corpus_counts(src.table(spark, sf, "documents"))


@query(f"WITH {C} SELECT claim_id, count(*) OVER (PARTITION BY session_id, subject, predicate) AS frequency FROM claims")
def f13_slot_frequency(spark, sf):
    return src.claims(spark, sf).select("claim_id", F.count("*").over(Window.partitionBy("session_id", "subject", "predicate")).alias("frequency"))


@query(f"WITH {T} SELECT sum(greatest(1, length(text) // 4))::BIGINT AS tokens FROM turns")
def f15_tokens(spark, sf):
    return memory.tokens_saved(src.turns(spark, sf))


@query(f"WITH {C} SELECT subject AS claim_id, count(*) AS access_count, max(created_ts) AS last_accessed_ts FROM claims GROUP BY subject")
def f16_access(spark, sf):
    return memory.access_counts(src.claims(spark, sf).select(F.col("subject").alias("claim_id"), F.col("created_ts").alias("served_ts")))


@query(f"""WITH {C}, served AS (SELECT session_id, subject AS claim_id, created_ts FROM claims WHERE predicate = 'click'), cited AS (SELECT DISTINCT session_id, subject AS claim_id FROM claims)
SELECT session_id, claim_id, max(created_ts) AS last_served, max(created_ts) IS NOT NULL AS verified FROM cited LEFT JOIN served USING (session_id, claim_id) GROUP BY ALL""")
def f17_verify(spark, sf):
    c = src.claims(spark, sf).withColumn("claim_id", F.col("subject"))
    return memory.verified(c.select("session_id", "claim_id"), c.filter("predicate = 'click'").select("session_id", "claim_id", F.col("created_ts").alias("served_ts")))


# --- ordered computations ---


@query(f"WITH {T} SELECT turn_id, row_number() OVER (PARTITION BY session_id ORDER BY ts, turn_id) - 1 AS turn_index FROM turns")
def g4_turn_index(spark, sf):
    return memory.turn_index(src.turns(spark, sf)).select("turn_id", F.col("turn_index").cast("long").alias("turn_index"))


@query(f"WITH {T} SELECT turn_id, count(text) OVER w AS n_prior, coalesce(array_to_string(list(substr(text, 1, 500)) OVER w, '|'), '') AS prior FROM turns WINDOW w AS (PARTITION BY session_id ORDER BY ts, turn_id ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)")
def g2_prior_turns(spark, sf):
    return memory.prior_turns(src.turns(spark, sf)).select("turn_id", F.size("prior").cast("long").alias("n_prior"), F.array_join("prior", "|").alias("prior"))


@query(f"""WITH {T}, p AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, turn_id) AS i FROM turns)
SELECT a.turn_id AS centre, b.turn_id FROM p a JOIN p b ON a.session_id = b.session_id AND abs(a.i - b.i) <= 2 WHERE a.speaker = 'system'""")
def g3_context_window(spark, sf):
    t = src.turns(spark, sf)
    return memory.around(t, t.filter("speaker = 'system'")).select("centre", "turn_id")


# From claim to claim of a subject: past a burst if one starts there, else to the next.
BURSTS = f"""p AS (SELECT subject, predicate, created_ts, claim_id, row_number() OVER (PARTITION BY subject ORDER BY created_ts, claim_id) AS i FROM claims),
g AS (SELECT a.subject, a.i, max(b.i) AS j, count(DISTINCT b.predicate) AS kinds FROM p a JOIN p b ON a.subject = b.subject AND b.i >= a.i AND b.created_ts <= a.created_ts + {DAY} GROUP BY ALL),
walk AS (SELECT subject, 1::BIGINT AS i FROM p GROUP BY subject UNION ALL SELECT g.subject, CASE WHEN g.kinds >= 3 THEN g.j ELSE g.i END + 1 FROM walk w JOIN g ON g.subject = w.subject AND g.i = w.i),
inside AS (SELECT g.subject, g.i AS start, p.* EXCLUDE (subject) FROM walk JOIN g USING (subject, i) JOIN p ON p.subject = g.subject AND p.i BETWEEN g.i AND g.j WHERE kinds >= 3)"""


@query(f"""WITH RECURSIVE {C}, {BURSTS}, kinds AS (SELECT subject, start, string_agg(predicate, ',' ORDER BY first) AS predicates, count(*) AS k FROM (SELECT subject, start, predicate, min(i) AS first FROM inside GROUP BY ALL) GROUP BY ALL),
total AS (SELECT subject, count(DISTINCT predicate) AS n FROM p GROUP BY subject)
SELECT subject, min(created_ts) AS start_ts, max(created_ts) AS end_ts, count(*) AS n_claims, any_value(predicates) AS predicates, round(least(1.0, any_value(k) / any_value(n)::DOUBLE), 4) AS significance
FROM inside JOIN kinds USING (subject, start) JOIN total USING (subject) GROUP BY subject, start""")
def g5_bursts(spark, sf):
    return bursts.bursts(src.claims(spark, sf), checkpoint).select("subject", "start_ts", "end_ts", F.size("claim_ids").cast("long").alias("n_claims"), F.array_join("predicates", ",").alias("predicates"), "significance")


@query(f"""WITH {C} SELECT a.claim_id, count(DISTINCT b.predicate) AS kinds FROM claims a JOIN claims b ON a.subject = b.subject AND b.created_ts BETWEEN a.created_ts AND a.created_ts + {DAY}
GROUP BY a.claim_id HAVING count(DISTINCT b.predicate) >= 3""")
def g5_burst_candidates(spark, sf):
    return memory.burst_candidates(src.claims(spark, sf)).select("claim_id", F.col("kinds").cast("long").alias("kinds"))


# --- retrieval ---


def bm25_sql(rows: str, ident: str, part: str, ask: str = ASK, tag: str = "") -> str:
    counts = ", ".join(f"('{w}', {n})" for w, n in rank.query_tokens(ask).items())
    return f"""q{tag}(token, qc) AS (VALUES {counts}),
tok{tag} AS (SELECT {ident} AS id, {part} AS part, regexp_extract_all(lower(text), '[a-z0-9]+') AS tk FROM {rows}),
corpus{tag} AS (SELECT part, count(*) AS n, avg(len(tk)) AS avgdl FROM tok{tag} GROUP BY part),
post{tag} AS (SELECT id, part, len(tk) AS dl, token, len(list_filter(tk, lambda x: x = token))::DOUBLE AS tf, qc FROM tok{tag}, q{tag}),
dfs{tag} AS (SELECT part, token, count(*) AS df FROM post{tag} WHERE tf > 0 GROUP BY ALL),
bm{tag} AS (SELECT id, round(sum(CASE WHEN tf > 0 THEN qc * ln((n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5) + 1.0) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) ELSE 0 END), 12) AS bm25
  FROM post{tag} JOIN corpus{tag} USING (part) LEFT JOIN dfs{tag} USING (part, token) GROUP BY id)"""


@query(f"WITH {T}, {bm25_sql('turns', 'turn_id', 'session_id')} SELECT id AS turn_id, round(bm25, 6) AS bm25 FROM bm")
def j2_bm25(spark, sf):
    return rank.bm25(src.turns(spark, sf), ASK, "session_id").select("turn_id", F.round("bm25", 6).alias("bm25"))


@query(f"WITH {bm25_sql('documents', 'doc_id', '0')} SELECT id AS doc_id, round(bm25, 6) AS bm25 FROM bm ORDER BY bm.bm25 DESC, id LIMIT 15")
def j16_search_documents(spark, sf):
    docs = rank.bm25(src.table(spark, sf, "documents").select("doc_id", "text"), ASK)
    return docs.orderBy(F.desc("bm25"), "doc_id").limit(15).select("doc_id", F.round("bm25", 6).alias("bm25"))


@query(f"SELECT a.vec_id, round({COS}, 6) AS score FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 7) b ORDER BY score DESC, a.vec_id LIMIT 10")
def j5_nearest(spark, sf):
    v = src.table(spark, sf, "embeddings")
    return rank.nearest(v, v.filter("vec_id = 7").first().embedding, 10)


def any_sql(words) -> str:
    return "(" + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + ")"


@query("SELECT item_id, (CASE WHEN " + any_sql(tx.AGGREGATION_WORDS) + " THEN 50 WHEN " + any_sql(tx.TEMPORAL_WORDS) + " THEN 30 ELSE 15 END)::BIGINT AS depth, CASE "
       + " ".join(f"WHEN {any_sql(w)} THEN '{k}'" for w, _, k in reversed(tx.QUERY_FAMILIES)) + f" ELSE 'fact_recall' END AS kind, regexp_matches(lower(text), '{tx.HISTORY}') AS history FROM benchmark")
def j7_query_routing(spark, sf):
    t = F.col("text")
    return src.table(spark, sf, "benchmark").select("item_id", tx.query_depth(t).cast("long").alias("depth"), tx.query_type(t).alias("kind"), tx.history_intent(t).alias("history"))


def episodes_sql(ask: str) -> str:
    """Turns' ranks for a query: its words as written, and as the tokeniser cuts them."""
    words = "[" + ", ".join(f"'{x}'" for x in sorted({*ask.lower().split(), *rank.query_tokens(ask)})) + "]"
    return f"""{T}, {bm25_sql('turns', 'turn_id', 'session_id', ask)},
sc AS (SELECT turns.*, bm25, list_has_any(regexp_extract_all(lower(text), '[a-z0-9]+'), {words})::INT AS entity FROM turns JOIN bm ON bm.id = turn_id),
ep AS (SELECT *, round(0.25 / (60.0 + row_number() OVER (PARTITION BY session_id ORDER BY bm25 DESC, ts, turn_id))
  + 0.15 / (60.0 + row_number() OVER (PARTITION BY session_id ORDER BY entity DESC, ts, turn_id))
  + 0.1 / (60.0 + row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, turn_id)), 12) AS score FROM sc)"""


EPISODES = episodes_sql(ASK)


@query(f"WITH {EPISODES} SELECT session_id, turn_id, round(score, 6) AS score, rn AS place FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, turn_id) AS rn FROM ep) WHERE rn <= 3")
def j12_episodes(spark, sf):
    rows = rank.episodes(src.turns(spark, sf), ASK)
    return rank.top(rows, 3, [F.desc("score"), "turn_id"], "session_id").select("session_id", "turn_id", F.round("score", 6).alias("score"), F.col("rn").cast("long").alias("place"))


@query(f"""WITH RECURSIVE {EPISODES}, laid AS (SELECT session_id, turn_id, greatest(1, length(text) // 4) AS cost, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, turn_id) AS rn FROM ep),
packed AS (SELECT DISTINCT session_id, 0::BIGINT AS rn, 0::BIGINT AS used, [] ::VARCHAR[] AS ids FROM laid
  UNION ALL SELECT l.session_id, l.rn, CASE WHEN used + cost <= 60 THEN used + cost ELSE used END, CASE WHEN used + cost <= 60 THEN list_append(ids, turn_id) ELSE ids END FROM packed p JOIN laid l ON l.session_id = p.session_id AND l.rn = p.rn + 1)
SELECT session_id, used, array_to_string(ids, ',') AS ids FROM packed QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY rn DESC) = 1""")
def g7_packed_context(spark, sf):
    hits = rank.episodes(src.turns(spark, sf), ASK).withColumn("id", F.col("turn_id"))
    return memory.packed_context(hits, 60).select("session_id", F.col("used").cast("long").alias("used"), F.array_join("ids", ",").alias("ids"))


CLAIM_ASK = "latest purchase of u12 login"
def hybrid_sql(ask: str, times: int) -> str:
    """Claims' ranks for a query that counts recency so many times."""
    words = ", ".join(f"'{x}'" for x in sorted(set(ask.split())))
    channels = (("entity", "0.2"), ("valid_from_ts", f"(0.1 * {times})"), ("bm25", "0.2"), ("confidence", "0.1"), ("frequency", "0.1"), ("source_trust", "0.12"))
    total = " + ".join(f"{w} / (60.0 + row_number() OVER (PARTITION BY session_id ORDER BY {c} DESC, created_ts, claim_id))" for c, w in channels)
    return f"""{C}, {bm25_sql('claims', 'claim_id', 'session_id', ask, '_h')},
sch AS (SELECT claims.*, bm25, list_contains([{words}], subject)::INT AS entity, count(*) OVER (PARTITION BY session_id, subject, predicate) AS frequency
  FROM claims JOIN bm_h ON bm_h.id = claim_id),
hy AS (SELECT *, round({total}, 12) AS score FROM sch)"""


HYBRID = hybrid_sql(CLAIM_ASK, 3)


@query(f"WITH {HYBRID} SELECT session_id, claim_id, rn AS place FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, claim_id) AS rn FROM hy) WHERE rn <= 20")
def j11_hybrid(spark, sf):
    rows = rank.facts(src.claims(spark, sf).withColumn("status", F.lit("active")), CLAIM_ASK)
    return rank.top(rows, 20, [F.desc("score"), "claim_id"], "session_id").select("session_id", "claim_id", F.col("rn").cast("long").alias("place"))


def session_claims(spark, sf):
    return src.claims(spark, sf).withColumn("status", F.lit("active")).withColumn("session_id", F.replace("session_id", F.lit("s"), F.lit("")))


def hits(spark, sf):
    return rank.fuse_memory(rank.facts(session_claims(spark, sf), CLAIM_ASK), rank.episodes(src.turns(spark, sf), ASK), 5)


def fused_sql(ask: str, times: int, most: int) -> str:
    """Facts for a query and turns for ASK, fused; the most for a session."""
    return f"""{EPISODES}, {hybrid_sql(ask, times)},
ranked AS (
  SELECT replace(session_id, 's', '') AS session_id, 'fact' AS kind, claim_id AS id, 1.0::DOUBLE AS w, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, claim_id) AS rk FROM hy
  UNION ALL SELECT session_id, 'turn', turn_id, 0.9::DOUBLE, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, turn_id) FROM ep),
fused AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, kind, id) AS place
  FROM (SELECT session_id, kind, id, round(w / (60 + rk), 12) AS score FROM ranked WHERE rk <= {most}) QUALIFY place <= {most})"""


@query(f"WITH {fused_sql(ASK, 1, model.TOP_K)} SELECT session_id, kind, id, round(score, 6) AS score FROM fused")
def j13_fused_episodes(spark, sf):
    rows = rank.fuse_memory(rank.facts(session_claims(spark, sf), ASK), rank.episodes(src.turns(spark, sf), ASK), model.TOP_K)
    return rows.withColumn("score", F.round("score", 6))


@query(f"""WITH {fused_sql(CLAIM_ASK, 3, 5)}, budget AS (SELECT least({model.MOST_ACROSS}, greatest({model.TOP_K}, count(*))) AS n FROM fused WHERE place <= {model.PER_SESSION_K}),
laid AS (SELECT *, row_number() OVER (ORDER BY place <= {model.PER_SESSION_K} DESC, score DESC, kind, id, session_id) AS pos FROM fused)
SELECT session_id, kind, id, round(score, 6) AS score FROM laid, budget WHERE pos <= n""")
def j14_across_sessions(spark, sf):
    return rank.across(hits(spark, sf)).select("session_id", "kind", "id", F.round("score", 6).alias("score"))


# --- enrichment, governance, tools ---


@query(f"""WITH {V}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY confidence DESC, created_ts, claim_id) AS rn FROM validity WHERE status = 'active')
SELECT session_id, array_to_string(list(claim_id ORDER BY rn) FILTER (rn <= 3), ',') AS facts, count(*) FILTER (rn > 3) AS remaining FROM r GROUP BY session_id""")
def n1_digest(spark, sf):
    rows = views.digest(validity(spark, sf)[0].withColumn("importance", F.col("confidence")))
    return rows.select("session_id", F.array_join(F.transform("facts", lambda x: x["claim_id"]), ",").alias("facts"), F.col("remaining").cast("long").alias("remaining"))


# A subject's lines by tier, told one after another under the budget.
PROFILE = f"""{V}, live AS (SELECT * FROM validity WHERE status = 'active'), {BURSTS.replace("FROM claims)", "FROM live)")},
ch AS (SELECT subject, predicate, count(*) AS n FROM (SELECT old_claim_id AS claim_id FROM edges UNION ALL SELECT new_claim_id FROM edges) JOIN validity USING (claim_id) GROUP BY ALL),
b4 AS (SELECT e.new_claim_id AS claim_id, o.value AS was FROM edges e JOIN validity o ON o.claim_id = e.old_claim_id),
own AS (SELECT l.subject, l.claim_id, l.created_ts, l.confidence::DOUBLE AS weight, '[' || l.predicate || '] ' || l.value AS plain, was, coalesce(n, 0) AS n FROM live l LEFT JOIN ch USING (subject, predicate) LEFT JOIN b4 USING (claim_id)),
kinds AS (SELECT subject, start, predicate, min(i) AS i FROM inside GROUP BY ALL),
total AS (SELECT subject, count(DISTINCT predicate) AS k FROM p GROUP BY 1),
told AS (SELECT subject, start, string_agg(k.predicate || ' -> ' || live.value, ', ' ORDER BY k.predicate, live.value) AS changed, count(*) AS c FROM kinds k JOIN p USING (subject, i) JOIN live USING (subject, claim_id) GROUP BY ALL),
ids AS (SELECT subject, start, list(claim_id ORDER BY i) AS ids, min(created_ts) AS ts FROM inside GROUP BY ALL),
lines AS (
  SELECT subject, 1 AS tier, plain AS text, weight, created_ts AS ts, claim_id, [claim_id] AS ids FROM own WHERE n = 0 AND weight >= 0.8
  UNION ALL SELECT subject, 2, plain || coalesce(' (previously: ' || was || ')', ''), weight, created_ts, claim_id, [claim_id] FROM own WHERE n BETWEEN 1 AND 2
  UNION ALL SELECT subject, 4, '[life_event] Changes on ' || strftime(make_timestamp(ts // 1000), '%Y-%m-%d') || ': ' || changed, round(least(1.0, c / k::DOUBLE), 4), ts, '', ids FROM told JOIN ids USING (subject, start) JOIN total USING (subject)
  UNION ALL SELECT subject, 5, plain || ' (changed ' || n || ' times)', weight, created_ts, claim_id, [claim_id] FROM own WHERE n > 2),
laid AS (SELECT *, 4 * len(regexp_extract_all(text, '\\S+')) AS cost, row_number() OVER (PARTITION BY subject ORDER BY tier, weight DESC, ts, claim_id) AS rn FROM lines),
say AS (
  SELECT DISTINCT subject, 0::BIGINT AS rn, 0 AS tier, NULL::VARCHAR AS text, NULL::VARCHAR[] AS ids, 0::BIGINT AS used, []::VARCHAR[] AS said, 0 AS ended, false AS kept FROM laid
  UNION ALL SELECT l.subject, l.rn, l.tier, l.text, l.ids, CASE WHEN turn AND used + cost <= 60 THEN used + cost ELSE used END, CASE WHEN turn AND used + cost <= 60 THEN said || l.ids ELSE said END,
    CASE WHEN turn AND used + cost > 60 THEN l.tier ELSE ended END, turn AND used + cost <= 60
  FROM (SELECT s.used, s.said, s.ended, l.tier <> s.ended AND (l.tier = 4 OR NOT list_contains(s.said, l.ids[1])) AS turn, l.* FROM say s JOIN laid l ON l.subject = s.subject AND l.rn = s.rn + 1) l)"""


@query(f"WITH RECURSIVE {PROFILE} SELECT subject, tier::BIGINT AS tier, text, array_to_string(ids, ',') AS claim_ids, used FROM say WHERE kept")
def n2_profile(spark, sf):
    rows, edges = validity(spark, sf)
    lines = views.profile(rows.withColumn("importance", F.col("confidence")), edges, bursts.bursts(views.active(rows), checkpoint), 60)
    return lines.select("subject", F.col("tier").cast("long").alias("tier"), "text", F.array_join("claim_ids", ",").alias("claim_ids"), F.col("used").cast("long").alias("used"))


EVENT_KIND = "CASE " + " ".join(f"WHEN n{i} > 0 AND n{i} = greatest({', '.join(f'n{j}' for j in range(6))}) THEN '{k}'" for i, k in enumerate(tx.EVENT_SIGNALS)) + " END"
EVENT_COUNTS = ", ".join(" + ".join(f"contains(lower(value), '{s}')::INT" for s in v) + f" AS n{i}" for i, v in enumerate(tx.EVENT_SIGNALS.values()))


@query(f"WITH {src.STORIES_SQL} SELECT turn_id, {EVENT_KIND} AS kind FROM (SELECT turn_id, {EVENT_COUNTS} FROM stories)")
def n3_event_types(spark, sf):
    return src.stories(spark, sf).select("turn_id", tx.event_type(F.col("value")).alias("kind"))


@query()
def n5_event_frames(spark, sf):
    """Held against a plain loop over sessions in tests/test_frames.py: the groups are connected components."""
    rows = frames.event_frames(src.stories(spark, sf), checkpoint)
    return rows.select("session_id", "event_type", F.array_join("turn_ids", ",").alias("turn_ids"), "location", "time_expr", "amount", "item", "confidence", F.array_join("participants", ",").alias("participants"), F.array_join("missing", ",").alias("missing"))


N6 = "e AS (SELECT DISTINCT l_orderkey AS t, 's' || l_suppkey AS x FROM lineitem), n AS (SELECT DISTINCT a.x AS entity, b.x AS neighbour FROM e a JOIN e b USING (t) WHERE a.x <> b.x)"


def supplier_claims(spark, sf):
    return src.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("source_turn_id"), F.concat(F.lit("s"), "l_suppkey").alias("entity_key"))


@query(f"WITH {N6} SELECT * FROM n")
def n6_neighbours(spark, sf):
    return memory.neighbours(supplier_claims(spark, sf))


@query(f"""WITH {N6}, h1 AS (SELECT DISTINCT neighbour AS entity FROM n WHERE entity = 's1' AND neighbour <> 's1'),
h2 AS (SELECT DISTINCT neighbour AS entity FROM n WHERE entity IN (SELECT entity FROM h1) AND neighbour <> 's1' AND neighbour NOT IN (SELECT entity FROM h1))
SELECT 's1' AS entity, 0::BIGINT AS hop UNION ALL SELECT entity, 1 FROM h1 UNION ALL SELECT entity, 2 FROM h2""")
def n6_hops(spark, sf):
    edges = memory.neighbours(supplier_claims(spark, sf))
    start = spark.createDataFrame([("s1",)], "entity string")
    return memory.within_hops(edges, start, 2, checkpoint).select("entity", F.col("hop").cast("long").alias("hop"))


@query(f"""WITH {V}, gone AS (SELECT claim_id FROM validity WHERE subject = 'u3')
SELECT 'claims' AS part, count(*) AS n FROM validity WHERE subject <> 'u3' UNION ALL
SELECT 'edges', count(*) FROM edges WHERE old_claim_id NOT IN (FROM gone) AND new_claim_id NOT IN (FROM gone) UNION ALL SELECT 'decisions', count(*) FROM gone""")
def n15_forget(spark, sf):
    rows, edges = validity(spark, sf)
    store = memory.forget({"claims": rows, "edges": edges}, rows.filter("subject = 'u3'").select("claim_id"), NOW)
    parts = [store[k].agg(F.count("*").alias("n")).select(F.lit(k).alias("part"), "n") for k in ("claims", "edges", "decisions")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS rn FROM embeddings),
c AS (SELECT a.vec_id AS id, {COS} AS c, row_number() OVER (PARTITION BY a.vec_id ORDER BY b.vec_id DESC) AS k FROM r a JOIN r b ON a.label = b.label AND a.vec_id <> b.vec_id AND b.rn <= 101)
SELECT vec_id AS id, round(max(c) FILTER (k <= 100), 6) AS best, coalesce(round(max(c) FILTER (k <= 100), 6) < 0.15, false) AS anomalous FROM embeddings e LEFT JOIN c ON c.id = e.vec_id GROUP BY vec_id""")
def n17_anomalies(spark, sf):
    v = src.table(spark, sf, "embeddings").select(F.col("label").alias("group"), F.col("vec_id").alias("id"), "embedding")
    return memory.anomalies(v, v).select("id", "best", "anomalous")


@query("SELECT c_custkey, sha256('token' || c_custkey) AS token_hash, CASE WHEN c_custkey % 3 = 0 THEN 'p' || c_custkey END AS principal FROM customer")
def n18_principals(spark, sf):
    c = src.table(spark, sf, "customer")
    known = c.filter("c_custkey % 3 = 0").select(F.sha2(F.concat(F.lit("token"), F.col("c_custkey").cast("string")), 256).alias("token_hash"), F.concat(F.lit("p"), "c_custkey").alias("principal"))
    return memory.resolved_principals(c.select("c_custkey", F.concat(F.lit("token"), "c_custkey").alias("token")), known).select("c_custkey", "token_hash", "principal")


TOOLS = "tools AS (SELECT p_partkey AS id, 'name: ' || p_name || chr(10) || 'description: ' || p_brand || ' ' || p_type || chr(10) || 'server: parts' AS text FROM part)"


def registry(spark, sf):
    document = rank.tool_document(F.col("p_name"), F.concat_ws(" ", "p_brand", "p_type"), F.lit("parts"), F.lit(None).cast("string"))
    return src.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), document.alias("document"))


@query(f"WITH {TOOLS} SELECT id, text AS document FROM tools")
def n20_tool_documents(spark, sf):
    return registry(spark, sf)


TOOL_ASK = "small polished brass part"


@query(f"WITH {TOOLS}, {bm25_sql('tools', 'id', '0', TOOL_ASK)} SELECT id, rn AS place FROM (SELECT id, row_number() OVER (ORDER BY bm25 DESC, id) AS rn FROM bm) WHERE rn <= 10")
def n23_tools(spark, sf):
    rows = rank.tools(registry(spark, sf), TOOL_ASK)
    return rows.select("id", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "id")).cast("long").alias("place"))


@query(f"WITH {T} SELECT session_id, to_json(list({{'ts': ts, 'id': turn_id, 'text': text}} ORDER BY ts, turn_id))::VARCHAR AS items FROM turns GROUP BY session_id")
def n26_reader_items(spark, sf):
    return memory.reader_items(src.turns(spark, sf).withColumn("id", F.col("turn_id")))


@query(f"WITH {C} SELECT claim_id, len(list_intersect(['purchase','u12','nothing'], regexp_extract_all(lower(text), '[a-z0-9]+'))) / 3.0 AS overlap FROM claims ORDER BY overlap DESC, created_ts DESC, claim_id LIMIT 5")
def h9_pre_tool_context(spark, sf):
    rows = src.claims(spark, sf).withColumn("overlap", memory.keyword_context(F.lit("purchase u12 nothing")))
    return rows.orderBy(F.desc("overlap"), F.desc("created_ts"), "claim_id").limit(5).select("claim_id", "overlap")


@query("SELECT time_bucket(INTERVAL '6 hours', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def l1_stream_windows(spark, sf):
    """The stream's plan over the batch; the streaming run is tested against it."""
    rows = stream.event_windows(src.table(spark, sf, "events"))
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


# --- doors ---


@query()
def n9_working_context(spark, sf):
    rows = context.working_context(session_claims(spark, sf), src.turns(spark, sf), NOW)
    return rows.select("session_id", "query", F.array_join("entities", ",").alias("entities"), "used", F.array_join("ids", ",").alias("ids"))


@query(f"""WITH {V}, t AS (SELECT 'tu_' || event_id AS turn_id, 'Said ' || event_type || ' ' || CAST(floor(value) AS BIGINT) AS text FROM events)
SELECT claim_id, CASE WHEN strpos(t.text, v.value) > 0 THEN v.value END AS quote, superseded_by AS replaced_by FROM validity v JOIN t ON t.turn_id = v.source_turn_id""")
def n14_explain(spark, sf):
    rows, edges = validity(spark, sf)
    turns = src.claims(spark, sf).select(F.col("source_turn_id").alias("turn_id"), F.concat_ws(" ", F.lit("Said"), "predicate", "value").alias("text"), F.lit("user").alias("speaker"))
    return context.explained(rows, turns, edges).select("claim_id", "quote", "replaced_by")


@query(f"""WITH {V} SELECT first_id AS origin, string_agg(value || ' [' || status || ']', chr(10) ORDER BY created_ts, claim_id) AS chain
FROM (SELECT *, first_value(claim_id) OVER (PARTITION BY session_id, subject, predicate ORDER BY created_ts, claim_id) AS first_id FROM validity) GROUP BY first_id""")
def d13_chains(spark, sf):
    rows, edges = validity(spark, sf)
    return context.chain_text(views.trace(rows, edges, checkpoint))


@query("""WITH s AS (SELECT l_orderkey AS sentence_id, list('cl_' || l_partkey ORDER BY l_linenumber) AS ids FROM lineitem GROUP BY l_orderkey),
b AS (SELECT DISTINCT sentence_id FROM (SELECT sentence_id, unnest(ids) AS c FROM s) WHERE substr(c, 4)::BIGINT % 10 = 0)
SELECT sentence_id, sentence_id NOT IN (FROM b) AS accepted FROM s""")
def n13_citations(spark, sf):
    lines = src.table(spark, sf, "lineitem")
    s = lines.groupBy(F.col("l_orderkey").alias("sentence_id")).agg(F.collect_list(F.concat(F.lit("cl_"), "l_partkey")).alias("source_claim_ids"))
    known = src.table(spark, sf, "part").filter("p_partkey % 10 != 0").select(F.concat(F.lit("cl_"), "p_partkey").alias("claim_id"))
    good, bad = context.cited_sentences(s, known)
    return good.select("sentence_id", F.lit(True).alias("accepted")).unionByName(bad.select("sentence_id", F.lit(False).alias("accepted")))


@query("SELECT term, max(imp) AS importance FROM (SELECT DISTINCT p_partkey, (p_partkey % 97) / 97.0 AS imp, unnest(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z0-9]+')) AS term FROM part) WHERE length(term) > 1 GROUP BY term ORDER BY importance DESC, term LIMIT 24")
def n24_conditioning(spark, sf):
    p = src.table(spark, sf, "part")
    return context.conditioning_terms(p.select(((F.col("p_partkey") % 97) / 97.0).alias("importance"), F.concat_ws(" ", "p_name", "p_type").alias("text")))


def runs_sql() -> str:
    """The query's best facts; then the query with each of their first three subjects, ranked like it."""
    words = ", ".join(f"'{x}'" for x in sorted(set(CLAIM_ASK.split())))
    channels = (("entity", "0.2"), ("valid_from_ts", "(0.1 * 3)"), ("bm25", "0.2"), ("confidence", "0.1"), ("frequency", "0.1"), ("source_trust", "0.12"))
    total = " + ".join(f"{w} / (60.0 + row_number() OVER (PARTITION BY run, session_id ORDER BY {c} DESC, created_ts, claim_id))" for c, w in channels)
    return f"""{HYBRID}, one AS (SELECT claim_id, subject, score FROM hy ORDER BY hy.score DESC, claim_id LIMIT 10),
names AS (SELECT DISTINCT subject AS run FROM one WHERE subject IS NOT NULL ORDER BY run LIMIT 3),
rq AS (SELECT run, token, count(*) AS qc FROM (SELECT run, unnest(regexp_extract_all(lower('{CLAIM_ASK} ' || run), '[a-z0-9]+')) AS token FROM names) GROUP BY ALL),
rpost AS (SELECT run, id, part, len(tk) AS dl, token, qc, len(list_filter(tk, lambda x: x = token))::DOUBLE AS tf FROM tok_h, rq),
rdf AS (SELECT run, part, token, count(*) FILTER (tf > 0) AS df FROM rpost GROUP BY ALL),
rbm AS (SELECT run, id, round(sum(CASE WHEN tf > 0 THEN qc * ln((n - df + 0.5) / (df + 0.5) + 1.0) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) ELSE 0 END), 12) AS bm25 FROM rpost JOIN rdf USING (run, part, token) JOIN corpus_h USING (part) GROUP BY ALL),
rsc AS (SELECT claims.*, run, bm25, (list_contains([{words}], subject) OR subject = run)::INT AS entity, count(*) OVER (PARTITION BY run, session_id, subject, predicate) AS frequency FROM claims JOIN rbm ON rbm.id = claim_id),
rhy AS (SELECT run, claim_id, round({total}, 12) AS score FROM rsc),
rtop AS (SELECT claim_id, score FROM rhy QUALIFY row_number() OVER (PARTITION BY run ORDER BY score DESC, claim_id) <= 10)"""


@query(f"""WITH {runs_sql()} SELECT claim_id, round(max(u.score), 6) AS score FROM (SELECT claim_id, score FROM one UNION ALL FROM rtop) u GROUP BY claim_id ORDER BY max(u.score) DESC, claim_id LIMIT 20""")
def j15_expanded(spark, sf):
    claims = src.claims(spark, sf).withColumn("status", F.lit("active"))
    return context.expanded(claims, CLAIM_ASK).select("claim_id", F.round("score", 6).alias("score"))


@query(f"""WITH {EPISODES}, {HYBRID}, best AS (SELECT replace(session_id, 's', '') AS session_id FROM hy GROUP BY ALL HAVING max(score) >= 0.3),
u AS (SELECT replace(session_id, 's', '') AS session_id, 'fact' AS kind, claim_id AS id, score FROM hy
  UNION ALL SELECT session_id, 'turn', turn_id, bm25 FROM ep WHERE turn_id NOT IN (SELECT source_turn_id FROM claims) AND session_id NOT IN (FROM best))
SELECT session_id, kind, id, round(score, 6) AS score FROM u QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY u.score DESC, kind, id) <= 15""")
def j17_fallback(spark, sf):
    claims = src.claims(spark, sf).withColumn("status", F.lit("active")).withColumn("session_id", F.replace("session_id", F.lit("s"), F.lit("")))
    found = context.with_fallback(rank.facts(claims, CLAIM_ASK), rank.episodes(src.turns(spark, sf), ASK))
    return found.select("session_id", "kind", "id", F.round("score", 6).alias("score"))


@query(f"WITH {V} SELECT predicate, claim_id, created_ts FROM validity WHERE status = 'active'")
def c17_by_predicate(spark, sf):
    return views.by_predicate(validity(spark, sf)[0]).select("predicate", "claim_id", "created_ts")


@query(f"WITH {C} SELECT claim_id FROM claims WHERE predicate IN ('click', 'view')")
def b6_branch(spark, sf):
    return context.branch(src.claims(spark, sf), {"browsing": ("click", "view")}, "browsing").select("claim_id")
