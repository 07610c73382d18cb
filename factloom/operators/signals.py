"""Signals kept up from the change feed: importance, use, demotion and consolidation, in a store.

Tables of the store:
  signal_claims    the newest state of each claim, replaced by key
  signal_slots     subject, predicate, peers: servable claims of a slot
  signal_sessions  subject, session_id, claims: servable claims of a subject in a session
  signal_roles     claim_id, newer, older: edges that lead to a claim, and from it
  signal_access    claim_id, accesses, last_ts
  signal_metadata  claim_id, importance, demoted, consolidated_into: what is written back, replaced by key

The four in the middle are sums: a batch adds a row for each key it changed, aggregated before anything is shuffled, and a reader adds up. So a batch
costs what it holds, whatever the log's size, and a hot slot or subject is one row of each batch. write_back() folds sums that have come in many folders.
A feed's batches have rising numbers; one that comes again changes nothing, so a feed may be delivered more than once.

Odd rows: claims without subject or predicate count in no slot (their uniqueness is that of a single one) and are not consolidated, nor are those without
value; a batch may be empty; several changes of a claim in one batch count in the order of seq; edges and accesses of unknown claims wait until
the claim comes; further columns are left out; a missing confidence counts as 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom import model
from factloom.operators import views
from factloom.sources import store as st

#: Columns of a change: a claim's, with its status after (null: removed) and before (null: new), and the order of changes.
CLAIM = ("claim_id", "session_id", "subject", "predicate", "value", "confidence", "created_ts", "status")
SUMS = {"signal_slots": (("subject", "predicate"), ("peers",)), "signal_sessions": (("subject", "session_id"), ("claims",)), "signal_roles": (("claim_id",), ("newer", "older"))}
METADATA = "claim_id string, importance double, demoted boolean, consolidated_into string"


class Known(Exception):
    """A batch that the store has already."""


def given(store: st.Store, feed: str, batch: int, changes: dict[str, st.Change]) -> int | None:
    """Commits a feed's batch once; None if it, or a later one, is there."""

    def once(before: st.Manifest) -> dict[str, st.Change]:
        if before.marks.get(f"feed {feed}", -1) >= batch:
            raise Known
        return changes

    try:
        return store.commit(once, note=f"{feed} {batch}", marks={f"feed {feed}": batch})
    except Known:
        return None


def feed_claims(store: st.Store, batch: int, changes: DataFrame, feed: str = "claims") -> int | None:
    """Claims that are new, change their status or go: the columns of CLAIM, was (the status before), seq. All but the status of a claim stays as it was first."""
    serves = lambda c: F.coalesce(F.col(c).isin(*model.SERVABLE), F.lit(False)).cast("long")
    moved = changes.withColumn("__d", serves("status") - serves("was"))
    add = lambda *key, name: moved.groupBy(*key).agg(F.sum("__d").alias(name)).filter(F.col(name) != 0)
    newest = changes.groupBy("claim_id").agg(F.max_by(F.struct(*CLAIM[1:]), "seq").alias("__s")).select("claim_id", "__s.*")
    return given(store, feed, batch, {
        "signal_claims": st.replace(newest, "claim_id"), "signal_slots": st.append(add("subject", "predicate", name="peers")), "signal_sessions": st.append(add("subject", "session_id", name="claims")),
    })


def feed_edges(store: st.Store, batch: int, edges: DataFrame, feed: str = "edges") -> int | None:
    """Edges (old_claim_id, new_claim_id) that are new; with a column n, n = -1 takes one away."""
    n = F.col("n").cast("long") if "n" in edges.columns else F.lit(1).cast("long")
    ends = edges.select(F.explode(F.array(F.struct(F.col("new_claim_id").alias("claim_id"), n.alias("newer"), F.lit(0).cast("long").alias("older")), F.struct(F.col("old_claim_id").alias("claim_id"), F.lit(0).cast("long").alias("newer"), n.alias("older")))).alias("e")).select("e.*")
    return given(store, feed, batch, {"signal_roles": st.append(ends.groupBy("claim_id").agg(F.sum("newer").alias("newer"), F.sum("older").alias("older")))})


def feed_access(store: st.Store, batch: int, served: DataFrame, feed: str = "access") -> int | None:
    """Claims that were served (claim_id, ts); one that is served twice counts twice."""
    return given(store, feed, batch, {"signal_access": st.append(served.groupBy("claim_id").agg(F.count("*").alias("accesses"), F.max("ts").alias("last_ts")))})


def table(store: st.Store, at: st.Manifest, name: str, schema: str) -> DataFrame:
    """A table of the store, without rows where it has none yet."""
    return store.read_at(at, name) if name in at.tables else store.spark.createDataFrame([], schema)


def sums(store: st.Store, at: st.Manifest, name: str) -> DataFrame:
    """Added up, without what came to nothing."""
    key, adds = SUMS[name]
    rows = table(store, at, name, ", ".join([f"{c} string" for c in key] + [f"{c} long" for c in adds]))
    return rows.groupBy(*key).agg(*[F.sum(c).alias(c) for c in adds]).filter(" or ".join(f"{c} != 0" for c in adds))


def live(store: st.Store, at: st.Manifest) -> DataFrame:
    return views.active(table(store, at, "signal_claims", "claim_id string, session_id string, subject string, predicate string, value string, confidence double, created_ts long, status string"))


def scored(store: st.Store, at: st.Manifest, claims: DataFrame, now: int) -> DataFrame:
    """claims with their importance, from the sums."""
    spread = sums(store, at, "signal_sessions").groupBy("subject").agg(F.count("session_id").alias("sessions"))
    rows = claims.join(sums(store, at, "signal_slots"), ["subject", "predicate"], "left").join(spread, "subject", "left").join(sums(store, at, "signal_roles"), "claim_id", "left")
    role = F.when(F.col("newer") > 0, 1.0).when(F.col("older") > 0, 0.0).otherwise(0.5)
    return rows.select(*claims.columns, views.importance_score(F.col("peers"), role, F.col("confidence"), F.lit(now) - F.col("created_ts"), F.col("sessions")).alias("importance"))


def importance(store: st.Store, now: int, version: int | None = None) -> DataFrame:
    """What views.importance says of the whole log, from the sums: the columns of CLAIM and importance of servable claims."""
    at = store.manifest(version)
    return scored(store, at, live(store, at), now)


def touched(store: st.Store, at: st.Manifest, claims: DataFrame, seen: set[str]) -> DataFrame:
    """claim_id of claims whose signals folders not yet seen changed: their own, their slot's or their subject's."""
    fresh = {name: st.Manifest(at.version, {name: own}) for name in ("signal_claims", *SUMS) if (own := [x for x in at.tables.get(name, []) if x["path"] not in seen])}
    found = [claims.select("claim_id").limit(0)]
    if "signal_claims" in fresh:
        found.append(store.read_at(fresh["signal_claims"], "signal_claims").select("claim_id"))
    for name, key in (("signal_slots", ["subject", "predicate"]), ("signal_sessions", ["subject"]), ("signal_roles", ["claim_id"])):
        if name in fresh:
            found.append(claims.join(sums(store, fresh[name], name).select(*key).distinct(), key, "left_semi").select("claim_id"))
    ids = found[0]
    for x in found[1:]:
        ids = ids.unionByName(x)
    return ids.distinct()


def write_back(store: st.Store, now: int, whole: bool = False, most: int = 16) -> int:
    """Writes the importance of those claims whose signals changed since the last time, or of all servable ones: the score is as of now, and a consolidated claim's is its own again.

    Sums of over so many folders are folded to one in the same commit.
    """
    marks: dict = {}

    def change(at: st.Manifest) -> dict[str, st.Change]:
        claims, made = live(store, at), {}
        if not whole:
            claims = claims.join(touched(store, at, claims, set(at.marks.get("signals seen", []))), "claim_id", "left_semi")
        made["signal_metadata"] = changed_metadata(store, at, scored(store, at, claims, now).select("claim_id", F.col("importance").alias("__importance")), importance=F.col("__importance"))
        seen = {name: [x["path"] for x in at.tables.get(name, [])] for name in ("signal_claims", *SUMS)}
        for name in SUMS:
            if len(seen[name]) > most:
                rows = sums(store, at, name)
                made[name] = st.Change("overwrite", rows, entry=store.write_folder(name, rows))
                seen[name] = [made[name].entry["path"]]
        if len(seen["signal_claims"]) > most:
            rows = store.read_at(at, "signal_claims")
            made["signal_claims"] = st.Change("overwrite", rows, entry=store.write_folder("signal_claims", rows))
            seen["signal_claims"] = [made["signal_claims"].entry["path"]]
        marks["signals seen"] = sorted(x for own in seen.values() for x in own)
        return made

    return store.commit(change, note="write back", marks=marks)


def changed_metadata(store: st.Store, at: st.Manifest, rows: DataFrame, **columns) -> st.Change:
    """Metadata of the given claims with columns set (from rows' own, or from those held); the others as held, or as they are without any."""
    held = table(store, at, "signal_metadata", METADATA)
    both = rows.join(held, "claim_id", "left")
    default = {"importance": F.coalesce("importance", F.lit(0.5)), "demoted": F.coalesce("demoted", F.lit(False)), "consolidated_into": F.col("consolidated_into")}
    return st.replace(both.select("claim_id", *[columns.get(c, x).alias(c) for c, x in default.items()]), "claim_id")


def metadata(store: st.Store, version: int | None = None) -> DataFrame:
    """The columns of CLAIM, importance, access_count, last_accessed_ts, demoted, consolidated_into of servable claims, as last written back."""
    return metadata_at(store, store.manifest(version))


def metadata_at(store: st.Store, at: st.Manifest) -> DataFrame:
    used = table(store, at, "signal_access", "claim_id string, accesses long, last_ts long").groupBy("claim_id").agg(F.sum("accesses").alias("access_count"), F.max("last_ts").alias("last_accessed_ts"))
    rows = live(store, at).join(table(store, at, "signal_metadata", METADATA), "claim_id", "left").join(used, "claim_id", "left")
    return rows.withColumns({"importance": F.coalesce("importance", F.lit(0.5)), "demoted": F.coalesce("demoted", F.lit(False)), "access_count": F.coalesce("access_count", F.lit(0)).cast("long")})


def utility(rows: DataFrame, now: int) -> DataFrame:
    """metadata's rows with their utility; a claim is as old as its creation or last access, whichever is later."""
    days = F.greatest(F.lit(0.0), (F.lit(now) - F.greatest("created_ts", F.coalesce("last_accessed_ts", F.lit(0)))) / float(model.DAY_NS))
    return rows.withColumn("utility", F.round(views.utility(F.col("importance"), F.col("access_count").cast("double"), days, F.coalesce("confidence", F.lit(0.0))), 4))


def demote(store: st.Store, now: int, threshold: float = 0.35, least_days: float = 30.0) -> int:
    """Takes old claims of little use out of retrieval; restore() brings them back, and nothing is deleted."""

    def change(at: st.Manifest) -> dict[str, st.Change]:
        rows = utility(metadata_at(store, at), now)
        low = rows.filter(~F.col("demoted") & (F.col("created_ts") < now - int(least_days * model.DAY_NS)) & (F.col("utility") < threshold))
        return {"signal_metadata": changed_metadata(store, at, low.select("claim_id"), demoted=F.lit(True))}

    return store.commit(change, note="demote")


def restore(store: st.Store, ids: DataFrame) -> int:
    """Brings demoted claims (claim_id) back."""
    return store.commit(lambda at: {"signal_metadata": changed_metadata(store, at, ids.select("claim_id").distinct(), demoted=F.lit(False))}, note="restore")


def consolidate(store: st.Store, least_sessions: int = 3) -> int:
    """Values held in enough sessions and uncontested become facts: the first claim of each is raised and kept, the others are demoted, and all name the first.

    A group's members are rows that name it, never a list in one row.
    """

    def change(at: st.Manifest) -> dict[str, st.Change]:
        rows = metadata_at(store, at).filter("subject is not null and predicate is not null and value is not null")
        groups = views.consolidate(rows, least_sessions).select("subject", "predicate", "value", "canonical")
        members = rows.join(groups, ["subject", "predicate", "value"]).select("claim_id", "canonical")
        first = F.col("claim_id") == F.col("canonical")
        raised = F.when(first, F.greatest(F.coalesce("importance", F.lit(0.5)), F.lit(0.9))).otherwise(F.coalesce("importance", F.lit(0.5)))
        return {"signal_metadata": changed_metadata(store, at, members, importance=raised, demoted=~first, consolidated_into=F.col("canonical"))}

    return store.commit(change, note="consolidate")


def follow(changes: DataFrame, store: st.Store, checkpoint: str, feed: str = "claims"):
    """A stream of changes, fed batch by batch; started, with what is there now."""
    return changes.writeStream.foreachBatch(lambda rows, n: feed_claims(store, n, rows, feed)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def feed_of(claims: DataFrame, edges: DataFrame) -> DataFrame:
    """The changes that a decided log amounts to, in the order of time: each claim comes as active, and an edge that ends one comes with the newer claim. Columns: CLAIM, was, seq."""
    came = claims.withColumns({"status": F.lit("active"), "was": F.lit(None).cast("string"), "seq": F.col("created_ts")})
    last = edges.groupBy(F.col("old_claim_id").alias("claim_id")).agg(F.min("created_ts").alias("__ended"))
    went = claims.join(last, "claim_id").withColumns({"was": F.lit("active"), "status": F.lit("superseded"), "seq": F.col("__ended")})
    return came.select(*CLAIM, "was", "seq").unionByName(went.select(*CLAIM, "was", "seq"))
