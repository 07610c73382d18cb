"""Writing facts and truth maintenance: validation, insertion, replacement of older facts, corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom import model
from factloom.functions import text as tx
from factloom.operators import slots


def failures() -> Column:
    """Names of the rules that a fact (subject, predicate, value, text, confidence, char_start, char_end, turn_length) breaks."""
    blank = lambda x: F.coalesce(F.trim(F.col(x)), F.lit("")) == ""
    structured = F.col("subject").isNotNull() | F.col("predicate").isNotNull() | F.col("value").isNotNull()
    start, end = F.col("char_start"), F.col("char_end")
    rules = (
        (structured & (blank("subject") | blank("predicate") | blank("value")), "triple"),
        (~structured & blank("text"), "text"),
        (F.col("confidence").isNull() | ~F.col("confidence").between(0, 1), "confidence"),
        ((start.isNull() != end.isNull()) | F.coalesce((start < 0) | (start > end) | (end > F.col("turn_length")), F.lit(False)), "span"),
    )
    return F.array_compact(F.array(*[F.when(bad, name) for bad, name in rules]))


def validate(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid facts, and rejected ones with their failures."""
    checked = facts.withColumn("failures", failures())
    return checked.filter(F.size("failures") == 0).drop("failures"), checked.filter(F.size("failures") > 0)


def insert(facts: DataFrame, families: tuple[str, ...], now: Column) -> dict[str, DataFrame]:
    """Claims, metadata and entities of validated facts. A predicate outside the vocabulary turns a triple into text."""
    known = F.col("predicate").isin(*families) if families else F.lit(True)
    subject = tx.normalise_subject(F.nullif(F.col("subject"), F.lit("")))
    whole = F.concat_ws(" ", subject, "predicate", "value")
    keep = F.col("predicate").isNotNull() & known
    rows = facts.withColumn("text", F.coalesce(F.nullif(F.col("text"), F.lit("")), whole))
    rows = rows.select(*[c for c in rows.columns if c not in ("subject", "predicate", "value")], F.when(keep, subject).alias("subject"), F.when(keep, F.col("predicate")).alias("predicate"), F.when(keep, F.col("value")).alias("value"))
    rows = rows.withColumn("created_ts", F.coalesce("created_ts", now)).withColumn("valid_from_ts", F.coalesce("valid_from_ts", "created_ts")).withColumn("status", F.lit("active"))
    found = rows.select("claim_id", F.explode(tx.entities(F.col("text"))).alias("e"))
    entities = found.select("claim_id", F.lower("e.entity").alias("entity_text"), F.col("e.kind").alias("entity_type")).distinct()
    first = F.lower(F.get(tx.entities(F.col("text")), 0)["entity"])
    metadata = rows.select("claim_id", F.coalesce("subject", first).alias("entity_key"), F.coalesce("predicate", F.lit("nl")).alias("predicate_family"), tx.temporal_bin(F.col("valid_from_ts")).alias("temporal_bin"), tx.source_trust(F.col("source_type"), F.col("speaker")).alias("source_trust"))
    return {"claims": rows, "metadata": metadata, "entities": entities}


def extract(turns: DataFrame) -> DataFrame:
    """Facts of admitted turns by the patterns, with their place in the turn."""
    rows = turns.filter(tx.admission(F.col("text")) == "admitted").select("turn_id", "session_id", F.col("text").alias("turn_text"), F.posexplode(tx.extracted(F.col("text"))).alias("ordinal", "f"))
    rows = rows.select("turn_id", "session_id", "ordinal", "f.*", "turn_text")
    return rows.select("*", tx.char_span(F.col("turn_text"), F.col("value")).alias("span")).select("turn_id", "session_id", "ordinal", "subject", "predicate", "value", "confidence", "span.char_start", "span.char_end")


def passthrough(turns: DataFrame, claims_col: str = "claims") -> DataFrame:
    """Facts that come with a turn, with defaults."""
    rows = turns.select("turn_id", "session_id", F.posexplode(claims_col).alias("ordinal", "f"))
    return rows.select("turn_id", "session_id", "ordinal", F.coalesce("f.subject", F.lit("user")).alias("subject"), F.coalesce("f.predicate", F.lit("user_fact")).alias("predicate"), F.col("f.value").alias("value"), F.coalesce("f.confidence", F.lit(0.9)).alias("confidence"))


SLOT = ("session_id", "subject", "predicate")


def cardinality_validity(claims: DataFrame) -> DataFrame:
    """Validity in slots that hold one value: a claim ends when a different one follows. Restated values are dropped first."""
    w = Window.partitionBy(*SLOT).orderBy("created_ts", "claim_id")
    changed = claims.withColumn("before", F.lag("value").over(w)).filter(F.col("before").isNull() | (F.col("before") != F.col("value"))).drop("before")
    after = F.lead(F.struct("created_ts", "claim_id")).over(w)
    rows = changed.withColumn("after", after)
    return rows.withColumn("valid_until_ts", F.col("after.created_ts")).withColumn("superseded_by", F.col("after.claim_id")).withColumn("status", F.when(F.col("after").isNull(), "active").otherwise("superseded")).drop("after")


def edges_of(validity: DataFrame) -> DataFrame:
    """Edges that a validity table stands for."""
    return validity.filter("superseded_by is not null").select("session_id", "subject", "predicate", F.col("claim_id").alias("old_claim_id"), F.col("superseded_by").alias("new_claim_id"), F.col("valid_until_ts").alias("created_ts"))


DECIDED = "session_id string, subject string, predicate string, old_claim_id string, new_claim_id string, edge_type string, created_ts long"


def supersede(claims: DataFrame, single_valued: tuple[str, ...] = ()) -> DataFrame:
    """Edges of all slots (blocked ones are for the audit).

    Order decides within a slot. Slots are dealt out by key and sorted, and each task streams through its slots; it holds the
    claims that the current slot still holds, indexed so that a claim is not compared with all of them.
    """
    columns = [*SLOT, "claim_id", "value", "source_turn_id", "speaker", "source_trust", "created_ts"]
    triples = claims.filter(F.col("subject").isNotNull() & F.col("predicate").isNotNull() & F.col("value").isNotNull()).select(*columns)
    dealt = triples.repartition(*SLOT).sortWithinPartitions(*SLOT, "created_ts", "claim_id")

    def run(batches):
        import pyarrow as pa

        key, held = None, None
        names = [*SLOT, "old_claim_id", "new_claim_id", "edge_type", "created_ts"]
        for batch in batches:
            out: list[dict] = []
            for new in batch.to_pylist():
                own = tuple(new[c] for c in SLOT)
                if own != key:
                    key, held = own, slots.Held(own[2] in single_valued)
                found = held.decide(new)
                if found:
                    out.append(dict(zip(SLOT, own, strict=True), **found))
            schema = pa.schema([(c, pa.int64() if c == "created_ts" else pa.string()) for c in names])
            yield pa.RecordBatch.from_pylist(out, schema)

    return dealt.mapInArrow(run, DECIDED)


def with_status(claims: DataFrame, edges: DataFrame) -> DataFrame:
    """Claims with the status and end that edges give them."""
    retired = edges.filter(~F.col("edge_type").isin("blocked", "contradicts")).groupBy(F.col("old_claim_id").alias("claim_id")).agg(F.max(F.struct("created_ts", "new_claim_id")).alias("by"))
    rows = claims.join(retired, "claim_id", "left")
    return rows.withColumn("status", F.when(F.col("by").isNull(), "active").otherwise("superseded")).withColumn("valid_until_ts", F.col("by.created_ts")).withColumn("superseded_by", F.col("by.new_claim_id")).drop("by")


def drift_audit(edges: DataFrame) -> DataFrame:
    """Audit rows of replacements that the trust guard refused: the claim that stays, and the one that would have retired it."""
    return edges.filter("edge_type = 'blocked'").select("session_id", F.lit("drift_blocked").alias("kind"), F.col("old_claim_id").alias("target_id"), F.col("new_claim_id").alias("detail"), F.col("created_ts").alias("ts"))


def corrected(claims: DataFrame, corrections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Claims after user corrections (claim_id, value, ts): the old ones superseded, new ones with full confidence; and the edges."""
    old = claims.join(corrections.select("claim_id", F.col("value").alias("new_value"), "ts"), "claim_id")
    new_id = F.concat(F.lit("cl_"), F.substring(F.sha2(F.concat_ws("|", "claim_id", "new_value", "ts"), 256), 1, 12))
    fresh = old.withColumn("old_claim_id", F.col("claim_id")).withColumn("claim_id", new_id).withColumn("value", F.col("new_value"))
    fresh = fresh.withColumn("confidence", F.lit(1.0)).withColumn("created_ts", F.col("ts")).withColumn("valid_from_ts", F.col("ts")).withColumn("status", F.lit("active"))
    edges = fresh.select(F.col("old_claim_id"), F.col("claim_id").alias("new_claim_id"), F.lit("user_correction").alias("edge_type"), F.col("ts").alias("created_ts"))
    hit = corrections.select("claim_id", F.lit(True).alias("hit"))
    kept = claims.join(hit, "claim_id", "left").withColumn("status", F.when(F.col("hit"), "superseded").otherwise(F.col("status"))).drop("hit")
    return kept.unionByName(fresh.select(*claims.columns)), edges


def dismissed(claims: DataFrame, ids: DataFrame) -> DataFrame:
    hit = ids.select("claim_id", F.lit(True).alias("hit"))
    return claims.join(hit, "claim_id", "left").withColumn("status", F.when(F.col("hit"), "dismissed_by_user").otherwise(F.col("status"))).drop("hit")
