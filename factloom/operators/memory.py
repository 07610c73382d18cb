"""Derived memory: bursts, event frames, entity graph, contexts, audit, forgetting, anomalies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom import model
from factloom.functions import text as tx

def burst_candidates(claims: DataFrame, window_ns: int = model.DAY_NS, least: int = 3) -> DataFrame:
    """Claims that could start a burst: a pure window, an upper bound of the fold."""
    w = Window.partitionBy("subject").orderBy("created_ts").rangeBetween(0, window_ns)
    return claims.withColumn("kinds", F.size(F.collect_set("predicate").over(w))).filter(F.col("kinds") >= least)


def neighbours(claims: DataFrame) -> DataFrame:
    """Entities stated in the same turn."""
    a = claims.select("source_turn_id", F.col("entity_key").alias("entity")).distinct()
    b = a.withColumnRenamed("entity", "neighbour")
    return a.join(b, "source_turn_id").filter("entity != neighbour").select("entity", "neighbour").distinct()


def within_hops(edges: DataFrame, start: DataFrame, hops: int, checkpoint=lambda df: df) -> DataFrame:
    """entity, hop for entities reached from start within so many hops, with the least number of hops."""
    reached = start.select("entity").distinct().withColumn("hop", F.lit(0))
    front = reached
    for hop in range(1, hops + 1):
        step = edges.join(front.select("entity"), "entity").select(F.col("neighbour").alias("entity")).distinct()
        front = checkpoint(step.join(reached.select("entity"), "entity", "left_anti").withColumn("hop", F.lit(hop)))
        reached = reached.unionByName(front)
    return reached


def neighbour_claims(edges: DataFrame, claims: DataFrame) -> DataFrame:
    """entity, claim_id: claims of each entity's neighbours."""
    return edges.join(claims.select(F.col("entity_key").alias("neighbour"), "claim_id"), "neighbour").select("entity", "claim_id").distinct()


def entity_path(edges: DataFrame, start: str, end: str, most: int = 5, checkpoint=lambda df: df) -> list[str] | None:
    """A shortest path between two entities, of equal ones the first in order; None beyond so many steps. The walk holds one way to each entity that it reached."""
    spark = edges.sparkSession
    front = spark.createDataFrame([(start, [start])], "entity string, path array<string>")
    reached = front
    for _ in range(most + 1):
        hit = reached.filter(F.col("entity") == end).first()
        if hit:
            return list(hit.path)
        step = edges.join(front, "entity").select(F.col("neighbour").alias("entity"), F.concat("path", F.array("neighbour")).alias("path"))
        front = checkpoint(step.join(reached.select("entity"), "entity", "left_anti").groupBy("entity").agg(F.min("path").alias("path")))
        reached = checkpoint(reached.unionByName(front))
    return None


def turn_index(turns: DataFrame) -> DataFrame:
    return turns.withColumn("turn_index", F.row_number().over(Window.partitionBy("session_id").orderBy("ts", "turn_id")) - 1)


def prior_turns(turns: DataFrame, n: int = 8, chars: int = 500) -> DataFrame:
    """Each turn with the texts of those before it."""
    w = Window.partitionBy("session_id").orderBy("ts", "turn_id").rowsBetween(-n, -1)
    return turns.withColumn("prior", F.collect_list(F.substring("text", 1, chars)).over(w))


def around(turns: DataFrame, ids: DataFrame, k: int = 2) -> DataFrame:
    """The turns at most k places from given ones: a few equal places each are joined, not a range."""
    placed = turn_index(turns)
    source = placed.join(ids.select("turn_id"), "turn_id", "left_semi").select("session_id", F.col("turn_id").alias("centre"), F.explode(F.sequence(F.col("turn_index") - k, F.col("turn_index") + k)).alias("turn_index"))
    return source.join(placed, ["session_id", "turn_index"])


def packed_context(hits: DataFrame, budget: int = 2000) -> DataFrame:
    """Hits of each session best first, skipping those that don't fit. Skipping depends on what was taken, so it is a fold over a sorted array, in the engine; the array's length is bounded by the budget."""
    cost = F.greatest(F.lit(1), F.floor(F.length("text") / 4)).cast("int")
    kind = [F.col("kind")] if "kind" in hits.columns else []
    item = F.struct((-F.col("score")).alias("order"), *kind, F.col("id").alias("id"), cost.alias("cost"))
    # room only shrinks: of hits of one cost, those taken are the first, and no more than fill the budget; so few of a session's hits can matter
    alike = Window.partitionBy("session_id", "__cost").orderBy(F.desc("score"), *kind, "id")
    likely = hits.withColumn("__cost", cost).withColumn("__rn", F.row_number().over(alike)).filter(F.col("__rn") * F.col("__cost") <= budget)
    rows = hits.select("session_id").distinct().join(likely.groupBy("session_id").agg(F.sort_array(F.collect_list(item)).alias("items")), "session_id", "left")
    rows = rows.withColumn("items", F.coalesce("items", F.array().cast(likely.select(F.array(item)).schema[0].dataType)))
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("ids"))

    def step(s, x):
        fits = s["used"] + x["cost"] <= budget
        return F.struct(F.when(fits, s["used"] + x["cost"]).otherwise(s["used"]).alias("used"), F.when(fits, F.concat(s["ids"], F.array(x["id"]))).otherwise(s["ids"]).alias("ids"))

    return rows.select("session_id", F.aggregate("items", start, step).alias("p")).select("session_id", F.col("p.used").alias("used"), F.col("p.ids").alias("ids"))


def tokens_saved(rows: DataFrame, text_col: str = "text") -> DataFrame:
    return rows.agg(F.sum(F.greatest(F.lit(1), F.floor(F.length(text_col) / 4))).alias("tokens"))


def access_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("claim_id").agg(F.count("*").alias("access_count"), F.max("served_ts").alias("last_accessed_ts"))


def verified(cited: DataFrame, served: DataFrame) -> DataFrame:
    """Whether each cited claim was served in the session, and when last."""
    last = served.groupBy("session_id", "claim_id").agg(F.max("served_ts").alias("last_served"))
    return cited.distinct().join(last, ["session_id", "claim_id"], "left").withColumn("verified", F.col("last_served").isNotNull())


def resolved_principals(tokens: DataFrame, principals: DataFrame) -> DataFrame:
    return tokens.withColumn("token_hash", F.sha2("token", 256)).join(principals, "token_hash", "left").drop("token")


def registered_principals(principals: DataFrame, new: DataFrame, now: int) -> DataFrame:
    """Principals (token_hash, principal, namespace, can_write, created_ts) with new ones (token, principal, namespace, can_write) added, or put in the place of one with their token. Tokens aren't kept."""
    fresh = new.select(F.sha2("token", 256).alias("token_hash"), "principal", "namespace", "can_write", F.lit(now).cast("long").alias("created_ts"))
    return principals.join(fresh.select("token_hash"), "token_hash", "left_anti").unionByName(fresh)


def anomaly_audit(found: DataFrame, now: int) -> DataFrame:
    """Audit rows of vectors that anomalies() flags; nothing is blocked."""
    return found.filter("anomalous").select(F.col("group").cast("string").alias("session_id"), F.lit("anomaly_flagged").alias("kind"), F.col("id").cast("string").alias("target_id"), F.lit(now).cast("long").alias("ts"))


def sentences_of(sentences: DataFrame) -> DataFrame:
    """claim_id, sentence_id for each citation."""
    return sentences.select(F.explode("source_claim_ids").alias("claim_id"), "sentence_id", "ordinal")


def forget(store: dict[str, DataFrame], targets: DataFrame, now: int) -> dict[str, DataFrame]:
    """A new store without the target claims (claim_id): no row of any table names or quotes them.

    Turns left without claims go; the forgotten values are masked in turns that stay; derived rows that cite a target go;
    the audit row keeps ids only.
    """
    ids = targets.select("claim_id").distinct()
    claims = store["claims"]
    gone = claims.join(ids, "claim_id", "left_semi")
    kept = claims.join(ids, "claim_id", "left_anti")
    out = dict(store, claims=kept)
    for name in ("metadata", "entities", "claim_vectors", "serve_log"):
        if name in store:
            out[name] = store[name].join(ids, "claim_id", "left_anti")
    if "edges" in store:
        a, b = (ids.withColumnRenamed("claim_id", x) for x in ("old_claim_id", "new_claim_id"))
        out["edges"] = store["edges"].join(a, "old_claim_id", "left_anti").join(b, "new_claim_id", "left_anti")
    if "turns" in store:
        touched = gone.groupBy(F.col("source_turn_id").alias("turn_id")).agg(F.collect_set("value").alias("__values"))
        orphans = touched.join(kept.select(F.col("source_turn_id").alias("turn_id")), "turn_id", "left_anti").select("turn_id")
        rest = store["turns"].join(orphans, "turn_id", "left_anti").join(touched, "turn_id", "left")
        # longer values first, so that none is left in part where another is within it
        longest = F.reverse(F.transform(F.array_sort(F.transform("__values", lambda v: F.struct(F.length(v).alias("n"), v.alias("v")))), lambda x: x["v"]))
        hide = F.aggregate(F.coalesce(longest, F.array().cast("array<string>")), F.col("text"), lambda t, v: F.when(v == "", t).otherwise(F.regexp_replace(t, F.concat(F.lit("(?iu)\\Q"), F.replace(v, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")), F.lit("[redacted]"))))
        out["turns"] = rest.withColumn("text", hide).drop("__values")
    for name, column in (("sentences", "source_claim_ids"), ("digests", "claim_ids"), ("life_events", "claim_ids"), ("frames", "claim_ids")):
        if name in store:
            key = store[name].columns[0]
            citing = store[name].select(key, F.explode(column).alias("claim_id")).join(ids, "claim_id", "left_semi").select(key).distinct()
            out[name] = store[name].join(citing, key, "left_anti")
    out["decisions"] = gone.select("session_id", F.lit("forget").alias("kind"), F.col("claim_id").alias("target_id"), F.lit(now).cast("long").alias("ts"))
    return out


#: Vectors of a group that one task scores.
SCORED = 1 << 16


def anomalies(new: DataFrame, reference: DataFrame, least: float = 0.15, most: int = 100) -> DataFrame:
    """New vectors whose best cosine with the newest references of their group is low; without references nothing can be judged.

    The newest are those of the highest ids. A vector is no reference of itself, so one more than needed is held for each group. A group's references come first
    to each task that has vectors of it, and those are scored as products of matrices; large groups are dealt out over several tasks, each with the references.
    A vector of another length than a reference, or of length zero, is like it by 0.
    """
    w = Window.partitionBy("group").orderBy(F.desc("id"))
    sizes = new.groupBy("group").agg(F.ceil(F.count("*") / SCORED).cast("int").alias("shares"))
    held = reference.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= most + 1).join(sizes, "group")
    held = held.select("group", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.col("rn").cast("int").alias("rn"), "id", F.col("embedding").cast("array<double>").alias("embedding"))
    whole = sizes.withColumnRenamed("group", "__group")
    rows = new.join(whole, F.col("group").eqNullSafe(F.col("__group"))).select("group", F.pmod(F.xxhash64("id"), F.col("shares")).cast("int").alias("share"), F.lit(1 << 30).alias("rn"), "id", F.col("embedding").cast("array<double>").alias("embedding"))
    dealt = held.unionByName(rows).repartition("group", "share").sortWithinPartitions("group", "share", "rn")
    schema = T.StructType([new.schema["group"], new.schema["id"], T.StructField("best", T.DoubleType())])

    def unit(rows_of: list):
        import numpy as np

        out = {}
        for n in {len(x) for x in rows_of if x is not None}:
            at = [i for i, x in enumerate(rows_of) if x is not None and len(x) == n]
            m = np.array([rows_of[i] for i in at], np.float64).reshape(len(at), n)
            norms = np.linalg.norm(m, axis=1)
            out[n] = (np.array(at), m / np.where(norms > 0, norms, 1)[:, None])
        return out

    def run(batches):
        import numpy as np
        import pyarrow as pa

        key, ids, vectors = object(), [], []
        for batch in batches:
            groups, shares, places, own, given = (c.to_pylist() for c in batch.columns)
            told = []
            i = 0
            while i < len(own):
                if (groups[i], shares[i]) != key:
                    key, ids, vectors = (groups[i], shares[i]), [], []
                if places[i] < 1 << 30:
                    ids.append(own[i])
                    vectors.append(given[i])
                    i += 1
                    continue
                j = i
                while j < len(own) and (groups[j], shares[j]) == key:
                    j += 1
                if ids:
                    scores = np.zeros((j - i, len(ids)))
                    known, asked = unit(vectors), unit(given[i:j])
                    for n in known.keys() & asked.keys():
                        scores[np.ix_(asked[n][0], known[n][0])] = asked[n][1] @ known[n][1].T
                    for k in range(j - i):
                        row = [s for s, x in zip(scores[k].tolist(), ids, strict=True) if x != own[i + k]][:most]
                        told.append((groups[i], own[i + k], round(max(row), 6) if row else None))
                else:
                    told += [(groups[i], own[k], None) for k in range(i, j)]
                i = j
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in told], t) for k, t in enumerate((batch.schema.field(0).type, batch.schema.field(3).type, pa.float64()))], names=schema.names)

    return dealt.mapInArrow(run, schema).withColumn("anomalous", F.coalesce(F.col("best") < least, F.lit(False)))


def reader_items(hits: DataFrame) -> DataFrame:
    """By session, a JSON list of the hits by time."""
    item = F.struct("ts", "id", "text")
    return hits.groupBy("session_id").agg(F.to_json(F.sort_array(F.collect_list(item))).alias("items"))


def keyword_context(query: Column) -> Column:
    """Share of the query's words that a claim's text has."""
    words = F.array_distinct(tx.tokens(query))
    return F.size(F.array_intersect(words, tx.tokens(F.col("text")))) / F.greatest(F.size(words), F.lit(1))
