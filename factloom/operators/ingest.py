"""The write path: turns are admitted, facts extracted and validated, earlier facts retired, and what changed is told.

A store is a dict of DataFrames; write() returns a new one and leaves the old as it was. Extractors, embedders and listeners are callables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import text as tx
from factloom.operators import facts, memory

#: After so many turns of a session its views are due, after so many of all sessions the signals are. Fixed values.
SESSION_EVERY, ALL_EVERY = 10, 25
FACTS = "turn_id string, session_id string, ordinal int, subject string, predicate string, value string, text string, confidence double"


def admitted(turns: DataFrame) -> DataFrame:
    """Turns with the reason of their admission and how long they hold."""
    return turns.withColumns({"reason": tx.admission(F.col("text")), "durability": tx.durability(F.col("text"))})


def extract_with(turns: DataFrame, extractor: Callable[[dict], Iterable[dict]], prior: int = 8) -> DataFrame:
    """Facts that a callable finds in each turn (a dict of its columns and the texts of the turns before it). One that fails on a turn finds nothing there.

    The callable gives dicts of subject, predicate, value, text and confidence; it runs on the executors, batch by batch.
    """
    told = memory.prior_turns(turns, prior)

    def run(batches):
        import pandas as pd

        names = ["turn_id", "session_id", "ordinal", "subject", "predicate", "value", "text", "confidence"]
        for pdf in batches:
            rows = []
            for turn in pdf.to_dict("records"):
                try:
                    found = list(extractor(turn))
                except Exception:  # noqa: BLE001 -- any error of a callable: no facts of this turn
                    found = []
                for i, f in enumerate(found):
                    rows.append((turn["turn_id"], turn["session_id"], i, f.get("subject"), f.get("predicate"), f.get("value"), f.get("text"), f.get("confidence", 0.5)))
            yield pd.DataFrame(rows, columns=names).astype({"ordinal": "int32", "confidence": "float64"})

    return told.mapInPandas(run, FACTS)


def parsed_entities(raw: Column) -> Column:
    """Names and types of a model's entity list: a JSON list of objects, the entities of a JSON object, or lines such as "- Name (type)" after a marker."""
    kind = "array<struct<name:string,text:string,type:string>>"
    parsed = F.try_parse_json(raw)
    listed = F.coalesce(F.try_variant_get(parsed, "$", kind), F.try_variant_get(parsed, "$.entities", kind))
    objects = F.transform(listed, lambda x: F.struct(F.coalesce(x["name"], x["text"], F.lit("")).alias("name"), F.lower(F.coalesce(x["type"], F.lit("unknown"))).alias("type")))
    marked = F.regexp_extract(raw, r"(?s)ENTITIES:(.*)", 1)
    lines = F.split(F.when(marked != "", marked).otherwise(raw), "\n")
    line = r"^\s*[-*]?\s*(.+?)\s*\((\w+)\)\s*$"
    read = F.transform(F.filter(lines, lambda x: x.rlike(line)), lambda x: F.struct(F.trim(F.regexp_extract(x, line, 1)).alias("name"), F.lower(F.regexp_extract(x, line, 2)).alias("type")))
    return F.filter(F.coalesce(objects, F.when(parsed.isNull(), read), F.array().cast("array<struct<name:string,type:string>>")), lambda x: x["name"] != "")


def claims_of(found: DataFrame, turns: DataFrame) -> DataFrame:
    """Facts as they go to validation: with their turn's speaker, time and origin, the span of the value, and an id of their own."""
    said = turns.select("turn_id", "speaker", "source_type", F.col("ts").alias("turn_ts"), F.col("text").alias("turn_text"))
    rows = found.join(said, "turn_id")
    ident = F.concat(F.lit("cl_"), F.substring(F.sha2(F.concat_ws("|", "turn_id", F.col("ordinal").cast("string"), "subject", "predicate", "value", "text"), 256), 1, 12))
    span = tx.char_span(F.col("turn_text"), F.coalesce("value", F.lit("")))
    out = rows.select("*", ident.alias("claim_id"), span.alias("span"), (F.col("turn_ts") + F.col("ordinal")).alias("created_ts"))
    return out.select(
        "claim_id", "session_id", F.col("turn_id").alias("source_turn_id"), "subject", "predicate", "value", "text", "confidence", "speaker", "source_type", "created_ts",
        F.lit(None).cast("long").alias("valid_from_ts"), F.col("span.char_start").alias("char_start"), F.col("span.char_end").alias("char_end"), F.length("turn_text").alias("turn_length"),
    )


def write(turns: DataFrame, extractor: Callable[[dict], Iterable[dict]] | None = None, families: tuple[str, ...] = (), single_valued: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """What a log of turns becomes: turns with their status, claims with status and end, rejected facts, metadata, entities, edges and events.

    Without an extractor the patterns find the facts. Order within a slot is that of times and ids, so any partitioning gives the same.
    """
    seen = admitted(turns)
    taken = seen.filter("reason = 'admitted'")
    if extractor is None:
        found = facts.extract(taken).select("turn_id", "session_id", F.col("ordinal").cast("int").alias("ordinal"), "subject", "predicate", "value", F.lit(None).cast("string").alias("text"), "confidence")
    else:
        found = extract_with(taken, extractor)
    good, bad = facts.validate(claims_of(found, taken))
    stored = facts.insert(good, families, F.col("created_ts"))
    claims = stored["claims"].withColumn("source_trust", tx.source_trust(F.col("source_type"), F.col("speaker")))
    edges = facts.supersede(claims, single_valued)
    settled = facts.with_status(claims, edges)
    with_facts = claims.select(F.col("source_turn_id").alias("turn_id")).distinct().withColumn("__facts", F.lit(True))
    status = F.when(F.col("reason") != "admitted", "rejected").when(F.col("__facts"), "done").otherwise("skipped")
    logged = seen.join(with_facts, "turn_id", "left").withColumn("extraction_status", status).drop("__facts")
    out = {"turns": logged, "claims": settled, "rejected": bad, "metadata": stored["metadata"], "entities": stored["entities"], "edges": edges}
    return out | {"events": events(out)}


def events(store: dict[str, DataFrame]) -> DataFrame:
    """The change feed: kind, session_id, id and ts of turns added, facts created and retired."""
    turns = store["turns"].filter("reason = 'admitted'").select(F.lit("turn.added").alias("kind"), "session_id", F.col("turn_id").alias("id"), "ts")
    made = store["claims"].select(F.lit("claim.created").alias("kind"), "session_id", F.col("claim_id").alias("id"), F.col("created_ts").alias("ts"))
    gone = store["edges"].filter(~F.col("edge_type").isin("blocked", "contradicts")).select(F.lit("claim.superseded").alias("kind"), "session_id", F.col("old_claim_id").alias("id"), F.col("created_ts").alias("ts"))
    return turns.unionByName(made).unionByName(gone)


def due(turns: DataFrame, before: DataFrame | None = None, every: int = SESSION_EVERY) -> DataFrame:
    """session_id, turns: sessions whose number of turns passed a multiple of every with the new turns; their views are to be built again."""
    new = turns.groupBy("session_id").agg(F.count("*").alias("new"))
    old = new.select("session_id", F.lit(0).cast("long").alias("old")).limit(0) if before is None else before.groupBy("session_id").agg(F.count("*").alias("old"))
    both = new.join(old, "session_id", "left").withColumn("old", F.coalesce("old", F.lit(0)))
    return both.filter(F.floor((F.col("old") + F.col("new")) / every) > F.floor(F.col("old") / every)).select("session_id", (F.col("old") + F.col("new")).alias("turns"))


def pending(turns: DataFrame) -> DataFrame:
    """Turns that wait for extraction, oldest first within their session: what a deferred run takes up."""
    w = Window.partitionBy("session_id").orderBy("ts", "turn_id")
    return turns.filter(F.coalesce("extraction_status", F.lit("pending")) == "pending").withColumn("place", F.row_number().over(w))


def namespace_of(session: DataFrame, turns: DataFrame, namespace: str) -> DataFrame:
    """session_id, denied: whether a caller of the namespace may read each session."""
    own = turns.filter(F.col("namespace") == namespace).select("session_id").distinct().withColumn("__own", F.lit(True))
    return session.select("session_id").distinct().join(own, "session_id", "left").select("session_id", F.when(F.col("__own").isNull(), "namespace").alias("denied"))

