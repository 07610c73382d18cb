"""Doors: what a client asks for, composed of the other operators. Reads never write; what they would log is returned."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom import model
from factloom.functions import text as tx
from factloom.operators import bursts, memory, rank, views

# Word lists of tool hooks and of query expansion.
SKIPPED_TOOLS = ("Read", "Glob", "Grep", "LS", "LSP", "TaskCreate", "TaskGet", "TaskList", "TaskUpdate", "TaskStop", "TaskOutput", "Monitor", "AskUserQuestion", "WebSearch", "WebFetch")
SKIPPED_COMMANDS = ("cd ", "ls", "pwd", "cat ", "head ", "tail ", "echo ", "grep ", "find ", "rg ", "which ", "type ", "git status", "git log", "git diff", "git show", "git branch")
KEYWORD_NOISE = (
    "the", "a", "an", "is", "are", "to", "for", "and", "or", "of", "in", "on", "at", "it", "my", "this", "that", "with", "from",
    "import", "def", "class", "return", "if", "else", "true", "false", "none", "self", "not",
)


class Answer(NamedTuple):
    """hits, with trust and quarantine; rows to append to the access log and the serve ledger."""

    hits: DataFrame
    served: DataFrame


def working_context(claims: DataFrame, turns: DataFrame, now: int, recent: int = 5, k: int = 50, budget: int = 2000) -> DataFrame:
    """The latest turns of each session as one text, their entities in order, and the facts and turns that the text retrieves, packed into the budget."""
    w = Window.partitionBy("session_id").orderBy(F.desc("ts"), "turn_id")
    last = turns.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= recent)
    names = F.flatten(F.collect_list(F.transform(tx.entities(F.coalesce("text", F.lit(""))), lambda x: F.lower(x["entity"]))))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(-F.col("rn"), "text"))), lambda x: x["text"]), " ")
    said = last.groupBy("session_id").agg(text.alias("query"), F.array_sort(F.array_distinct(names)).alias("entities"))
    asks = said.filter(F.trim("query") != "").select("session_id", "query")
    fused = rank.fuse_memory(rank.asked_facts(claims, asks, now), rank.asked_episodes(turns, asks), k)
    texts = claims.select("session_id", F.lit("fact").alias("kind"), F.col("claim_id").alias("id"), "text").unionByName(turns.select("session_id", F.lit("turn").alias("kind"), F.col("turn_id").alias("id"), "text"))
    packed = memory.packed_context(fused.join(texts, ["session_id", "kind", "id"]), budget)
    return said.join(packed, "session_id", "left").withColumn("used", F.coalesce("used", F.lit(0))).withColumn("ids", F.coalesce("ids", F.array().cast("array<string>")))


def expanded(claims: DataFrame, query: str, k: int = 20, subjects: int = 3) -> DataFrame:
    """The query's hits and those of the query with each of their first subjects in order; the best score of a claim holds."""
    first = rank.top(rank.facts(claims, query, part="session_id"), k // 2, [F.desc("score"), "claim_id"])
    names = [x.subject for x in first.select("subject").filter("subject is not null").distinct().orderBy("subject").limit(subjects).collect()]
    runs = [first.select("claim_id", "score")]
    for name in names:
        runs.append(rank.top(rank.facts(claims, f"{query} {name}", part="session_id"), k // 2, [F.desc("score"), "claim_id"]).select("claim_id", "score"))
    both = runs[0]
    for x in runs[1:]:
        both = both.unionByName(x)
    return both.groupBy("claim_id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "claim_id").limit(k)


def with_fallback(facts_ranked: DataFrame, turns_ranked: DataFrame, least: float = 0.3, k: int = 15) -> DataFrame:
    """Facts alone if their best score reaches the threshold, by session; else also turns that no such fact cites."""
    best = facts_ranked.groupBy("session_id").agg(F.max("score").alias("best"))
    f = facts_ranked.select("session_id", F.lit("fact").alias("kind"), F.col("claim_id").alias("id"), "score")
    rest = turns_ranked.join(facts_ranked.select(F.col("source_turn_id").alias("turn_id")).distinct(), "turn_id", "left_anti").join(best.filter(F.col("best") >= least), "session_id", "left_anti")
    t = rest.select("session_id", F.lit("turn").alias("kind"), F.col("turn_id").alias("id"), F.col("bm25").alias("score"))
    return rank.top(f.unionByName(t), k, [F.desc("score"), "kind", "id"], "session_id").drop("rn")


def answer(claims: DataFrame, turns: DataFrame, query: str, now: int, top_k: int | None = None) -> Answer:
    """The query door over all sessions: routing, ranking, shaping, trust, ledger rows."""
    lower = query.lower()
    depth = next((k for words, k in ((tx.AGGREGATION_WORDS, 50), (tx.TEMPORAL_WORDS, 30)) if any(x in lower for x in words)), 15)
    k = top_k or depth
    past = bool(re.search(tx.HISTORY, lower))
    families = tuple(sorted({f for words, names, _ in tx.QUERY_FAMILIES if any(x in lower for x in words) for f in names}))
    scope = rank.temporal_scope(query, now)
    fused = rank.fuse_memory(rank.facts(claims, query, past, scope, families), rank.episodes(turns, query), max(k, model.PER_SESSION_K))
    hits = rank.across(fused, k)
    said = [c for c in ("value",) if c in claims.columns]
    known = claims.select(F.col("claim_id").alias("id"), "source_trust", "text", F.col(said[0] if said else "text").alias("__cost"))
    known = known.unionByName(turns.select(F.col("turn_id").alias("id"), F.lit(None).cast("double").alias("source_trust"), "text", F.col("text").alias("__cost")))
    rows = known.join(F.broadcast(hits.withColumn("norm", F.round(F.col("score") / F.max("score").over(Window.partitionBy()), 4))), "id")  # at most MOST_ACROSS hits
    rows = rows.withColumn("quarantined", F.coalesce(F.col("source_trust") < model.QUARANTINE, F.lit(False)))
    rows = rows.withColumn("durability", tx.durability(F.coalesce("text", F.lit(""))))
    rows = rows.withColumn("tokens", F.greatest(F.lit(1), F.floor(F.length(F.coalesce("__cost", F.lit(""))) / 4)).cast("long")).drop("__cost")
    served = rows.filter("kind = 'fact'").select("session_id", F.col("id").alias("claim_id"), F.lit(query).alias("query"), F.lit(now).alias("served_ts"))
    return Answer(rows, served)


def token_report(hits: DataFrame) -> DataFrame:
    """Tokens of what was served, by kind and in all."""
    return hits.agg(
        F.coalesce(F.sum(F.when(F.col("kind") == "fact", F.col("tokens"))), F.lit(0)).alias("fact_tokens"), F.coalesce(F.sum(F.when(F.col("kind") == "turn", F.col("tokens"))), F.lit(0)).alias("episode_tokens"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("total_tokens"), F.count("*").alias("served_items"),
    )


# What a reader is told by the query's type.
HINTS = {
    "assistant_recall": "Answer based on what the assistant previously said, recommended, or did.",
    "preference": "State the user's preference directly. If preferences changed, use the most recent.",
    "temporal": "Pay attention to dates and time ordering in the facts.",
    "knowledge_update": "Facts may have changed over time. Answer based on the most recent active version.",
    "fact_recall": "Answer directly from the retrieved facts.",
}


def reader_hint(query: str) -> str:
    lower = query.lower()
    kinds = [k for words, _, k in tx.QUERY_FAMILIES if any(x in lower for x in words)]
    return HINTS[kinds[-1] if kinds else "fact_recall"]


def briefing(store: dict[str, DataFrame], session: str, now: int, checkpoint, query: str = "", vocabulary: tuple[str, ...] = (), k: int = 10) -> dict[str, DataFrame]:
    """What a client needs when a session starts, as DataFrames of that session: world state, digest, entity links, bursts, contradictions,
    and, with a query, hits with their trust and why they hold.

    store: turns, claims (with importance and source_trust), edges; metadata with entity keys is optional.
    """
    turns, claims = (store[x].filter(F.col("session_id") == session) for x in ("turns", "claims"))
    edges = store["edges"].join(claims.select(F.col("claim_id").alias("new_claim_id")), "new_claim_id", "left_semi")
    out = {
        "world_state": views.world_state(claims, vocabulary), "digest": views.digest(claims, edges), "life_events": served_events(bursts.bursts(views.active(claims), checkpoint)),
        "contradictions": views.contradictions(edges, claims),
    }
    if "metadata" in store:
        keyed = claims.select("claim_id", "source_turn_id").join(store["metadata"].select("claim_id", "entity_key"), "claim_id")
        out["entity_links"] = memory.neighbours(keyed)
    if query.strip():
        found = answer(claims, turns, query, now, k)
        facts = found.hits.filter("kind = 'fact'").select(F.col("id").alias("claim_id"))
        out |= {"hits": found.hits, "served": found.served, "why": explained(claims.join(facts, "claim_id", "left_semi"), turns, edges)}
    return out


def explained(claims: DataFrame, turns: DataFrame, edges: DataFrame) -> DataFrame:
    """Each claim with its turn, the quote that it was read from, and what replaced it."""
    said = turns.select(F.col("turn_id").alias("source_turn_id"), F.col("text").alias("turn_text"), "speaker")
    rows = claims.drop("speaker").join(said, "source_turn_id", "left").join(views.superseded_by(edges).withColumnRenamed("superseded_by", "replaced_by"), "claim_id", "left")
    span = tx.char_span(F.col("turn_text"), F.col("value"))
    return rows.withColumn("span", span).withColumn("quote", views.quote(F.col("turn_text"), F.col("span.char_start"), F.col("span.char_end"))).drop("span")


def chain_text(traced: DataFrame) -> DataFrame:
    """Each chain's steps as lines, oldest first."""
    step = F.struct(F.col("depth").alias("depth"), F.concat(F.col("value"), F.lit(" ["), F.col("status"), F.lit("]")).alias("line"))
    lines = F.transform(F.sort_array(F.collect_list(step)), lambda x: x["line"])
    return traced.groupBy("origin").agg(F.array_join(lines, "\n").alias("chain"))


def cited_sentences(sentences: DataFrame, claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sentences whose citations all exist, and those that cite nothing or something unknown."""
    cites = sentences.select("sentence_id", F.explode("source_claim_ids").alias("claim_id"))
    unknown = cites.join(claims.select("claim_id"), "claim_id", "left_anti").select("sentence_id")
    bad = unknown.unionByName(sentences.filter(F.size("source_claim_ids") == 0).select("sentence_id")).distinct()
    return sentences.join(bad, "sentence_id", "left_anti"), sentences.join(bad, "sentence_id", "left_semi")


def sentence_turn(sentences: DataFrame, claims: DataFrame) -> DataFrame:
    """The turn of each sentence's first citation."""
    return sentences.select("sentence_id", F.get("source_claim_ids", 0).alias("claim_id")).join(claims.select("claim_id", "source_turn_id"), "claim_id")


def conditioning_terms(facts: DataFrame, limit: int = 24) -> DataFrame:
    """Words of facts with the most important fact that has them."""
    words = facts.select("importance", F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("term")).filter(F.length("term") > 1)
    return words.groupBy("term").agg(F.max("importance").alias("importance")).orderBy(F.desc("importance"), "term").limit(limit)


# Words that tell nothing of what someone works on, and how many terms condition a search.
TERM_NOISE = (
    "a an and the of to for in on at by with from is are was were be been being "
    "i you he she it we they me my your our their this that these those as or if "
    "then than so do does did done have has had will would can could should may "
    "might must not no yes about into over under out up down off again earlier "
    "task worked working work used use using need needs want wants get got make "
    "please now today yesterday some any all more most"
).split()
MOST_TERMS = 24


def structured_terms(claims: DataFrame, entities: DataFrame | None = None, most: int = MOST_TERMS) -> DataFrame:
    """session_id, terms: the words of what a session's active claims say and name, each with its most important claim's weight, the weightiest first.

    claims: with importance (missing: 0.5); entities (claim_id, entity_text) add the names that claims were read with. A query plays no part. The words of a
    session are counted before they are ranked, so a rank sees each word once.
    """
    held = views.active(claims).select("session_id", "claim_id", F.coalesce("importance", F.lit(0.5)).alias("weight"), F.coalesce("value", F.lit("")).alias("said"))
    told = held.select("session_id", "weight", "said")
    if entities is not None:
        told = told.unionByName(held.select("session_id", "claim_id", "weight").join(entities.select("claim_id", F.col("entity_text").alias("said")), "claim_id").select("session_id", "weight", "said"))
    words = told.select("session_id", "weight", F.explode(F.array_distinct(tx.tokens(F.col("said")))).alias("term")).filter((F.length("term") > 1) & ~F.col("term").isin(*TERM_NOISE))
    best = rank.top(words.groupBy("session_id", "term").agg(F.max("weight").alias("weight")), most, [F.desc("weight"), "term"], "session_id")
    return best.groupBy("session_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rn", "term"))), lambda x: x["term"]).alias("terms"))


def retrieved_terms(hits: DataFrame, most: int = MOST_TERMS) -> list[str]:
    """Words of retrieved facts and turns (kind, id, score, text: some few rows), best hit first, in the order they are met."""
    out: dict[str, None] = {}
    for row in hits.orderBy(F.desc("score"), "kind", "id").select(tx.tokens(F.coalesce("text", F.lit(""))).alias("words")).collect():
        out.update((w, None) for w in row.words if len(w) > 1 and w not in TERM_NOISE)
    return list(out)[:most]


def instruction(claims: DataFrame, most: int = 600) -> DataFrame:
    """session_id, instruction: what a session's active claims say of the user, preferences first, then by importance, each value once, cut at so many characters."""
    value = F.trim(F.coalesce(F.nullif(F.col("value"), F.lit("")), F.col("text"), F.lit("")))
    rows = views.active(claims).select("session_id", value.alias("value"), F.coalesce(F.col("predicate").contains("preference"), F.lit(False)).alias("first"), F.coalesce("importance", F.lit(0.5)).alias("importance"), "created_ts", "claim_id").filter("value != ''")
    order = [F.desc("first"), F.desc("importance"), "created_ts", "claim_id"]
    once = rows.withColumn("rn", F.row_number().over(Window.partitionBy("session_id", F.lower("value")).orderBy(*order))).filter("rn = 1")
    placed = rank.top(once.drop("rn"), most, order, "session_id")  # no more values than characters
    said = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rn", "value"))), lambda x: x["value"]), "; ")
    return placed.groupBy("session_id").agg(F.substring(F.concat(F.lit("User context: "), said, F.lit(".")), 1, most).alias("instruction"))


def discover_tools(registry: DataFrame, query: str, facts: DataFrame | None = None, k: int = 10, mode: str = "text", vectors: dict[str, list[float]] | None = None, entities: DataFrame | None = None) -> DataFrame:
    """Tools for a query, conditioned on remembered facts if there are any.

    text: the facts' words are further channels. instruction: facts are a session's claims (of several, the first session counts), and what they say is put before the query. structured: of such claims, the weightiest words are further channels.
    retrieved: facts are hits for the query, and their words are.
    """
    if facts is None:
        return rank.tools(registry, query, "", k, vectors=vectors)
    if mode == "instruction":
        told = instruction(facts).orderBy("session_id").first()
        return rank.tools(registry, f"{told.instruction} {query}" if told else query, "", k, vectors=vectors)
    if mode == "structured":
        told = structured_terms(facts, entities).orderBy("session_id").first()
        return rank.tools(registry, query, " ".join(told.terms) if told else "", k, vectors=vectors)
    terms = retrieved_terms(facts) if mode == "retrieved" else [x.term for x in conditioning_terms(facts).collect()]
    return rank.tools(registry, query, " ".join(terms), k, vectors=vectors)


def skipped_hook(tool: Column, command: Column) -> Column:
    """Whether a tool call isn't worth remembering."""
    low = F.lower(F.trim(F.coalesce(command, F.lit(""))))
    starts = F.lit(False)
    for x in SKIPPED_COMMANDS:
        starts = starts | low.startswith(x)
    return F.coalesce(tool, F.lit("")).isin("", *SKIPPED_TOOLS) | tool.contains("memory_") | (tool.isin("Bash", "PowerShell") & starts)


def hook_keywords(text: Column) -> Column:
    """At most five words of a tool call, as first written."""
    words = F.filter(F.regexp_extract_all(text, F.lit("[a-zA-Z_][a-zA-Z0-9_]*"), F.lit(0)), lambda w: (F.length(w) > 2) & ~F.lower(w).isin(*KEYWORD_NOISE))
    first = F.filter(words, lambda w, i: F.array_position(F.transform(words, F.lower), F.lower(w)) == i + 1)
    return F.array_join(F.slice(first, 1, 5), " ")


CLAIM = "struct<subject:string,predicate:string,value:string,confidence:double>"
# The keys that replies are usually wrapped in, in the order in which they are looked for.
WRAPPERS = ("claims", "extracted_claims", "items", "list", "data")


def parsed_claims(raw: Column) -> Column:
    """Claims of a model's JSON reply: a list, an object that holds one under a usual key or under its only key, or a single claim; anything else gives none."""
    parsed = F.try_parse_json(raw)
    listed = F.try_variant_get(parsed, "$", f"array<{CLAIM}>")
    members = F.from_json(raw, "map<string,string>")
    wrapped = [F.try_variant_get(parsed, f"$.{k}", f"array<{CLAIM}>") for k in WRAPPERS]
    only = F.when(F.size(members) == 1, F.try_variant_get(F.try_parse_json(F.get(F.map_values(members), 0)), "$", f"array<{CLAIM}>"))
    single = F.try_variant_get(parsed, "$", CLAIM)
    found = F.coalesce(listed, *wrapped, only, F.when(single["value"].isNotNull(), F.array(single)))
    good = lambda x: (F.trim(x["subject"]) != "") & (F.trim(x["predicate"]) != "") & (F.trim(x["value"]) != "") & F.coalesce(x["confidence"].between(0, 1), F.lit(True))
    return F.filter(F.coalesce(found, F.array().cast(f"array<{CLAIM}>")), good)


def branch(claims: DataFrame, slots: dict[str, tuple[str, ...]], name: str | None) -> DataFrame:
    """Claims of a pack's branch; an unknown branch filters nothing."""
    return claims.filter(F.col("predicate").isin(*slots[name])) if name in slots else claims


def served_events(events: DataFrame, limit: int = 5) -> DataFrame:
    return rank.top(events, limit, [F.desc("significance"), F.desc("start_ts")], "subject")
