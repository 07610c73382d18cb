"""Deferred extraction: a table of work in a store, taken up under leases.

A turn waits as pending; a worker leases some for a while and ends them as done, skipped or failed. A worker that dies lets its leases run out, and others take
its turns again. So a turn may be worked on twice, and what comes of it must not depend on that: claims are replaced by their id, which their
turn and place give. A failure puts a turn back to wait, twice as long each time, until its attempts are used up.
Every state of a turn is a row replaced by key, so workers that lease at once are told apart by the store's commits: the second looks again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import ingest
from factloom.sources import store as st

TABLE = "work"
SCHEMA = "turn_id string, session_id string, ts long, status string, attempts int, worker string, until_ms long, error string"
#: A lease's length, the first wait after a failure, and how often a turn is tried.
LEASE_MS, BACKOFF_MS, MOST_ATTEMPTS = 60_000, 1_000, 3
ENDED = ("done", "skipped", "failed")


def enqueue(store: st.Store, turns: DataFrame) -> int:
    """Turns (turn_id, session_id, ts) that are not known yet wait from now on; the version."""

    def change(before: st.Manifest) -> dict[str, st.Change]:
        rows = turns.select("turn_id", "session_id", "ts").dropDuplicates(["turn_id"]).filter("turn_id is not null")
        if TABLE in before.tables:
            rows = rows.join(store.read_at(before, TABLE).select("turn_id"), "turn_id", "left_anti")
        rows = rows.withColumns({"status": F.lit("pending"), "attempts": F.lit(0), "worker": F.lit(None).cast("string"), "until_ms": F.lit(0).cast("long"), "error": F.lit(None).cast("string")})
        return {TABLE: st.append(rows, unique=("turn_id",))}

    return store.commit(change, note="enqueue")


def ready(rows: DataFrame, now_ms: int) -> DataFrame:
    """Turns that wait and whose time has come, and those whose lease has run out."""
    return rows.filter(F.col("status").isin("pending", "leased") & (F.col("until_ms") <= now_ms))


def lease(store: st.Store, worker: str, most: int, now_ms: int, lease_ms: int = LEASE_MS) -> DataFrame:
    """The oldest turns that are ready, at most so many, leased to a worker. Turns whose attempts are used up by workers that died have failed."""

    def change(before: st.Manifest) -> dict[str, st.Change]:
        open_rows = ready(store.read_at(before, TABLE), now_ms)
        lost = open_rows.filter(F.col("attempts") >= MOST_ATTEMPTS).withColumns({"status": F.lit("failed"), "error": F.lit("lease ran out")})
        taken = open_rows.filter(F.col("attempts") < MOST_ATTEMPTS).orderBy("ts", "turn_id").limit(most)
        taken = taken.withColumns({"status": F.lit("leased"), "attempts": F.col("attempts") + 1, "worker": F.lit(worker), "until_ms": F.lit(now_ms + lease_ms).cast("long"), "error": F.lit(None).cast("string")})
        return {TABLE: st.replace(lost.unionByName(taken), "turn_id")}

    version = store.commit(change, note=f"lease {worker}")
    return store.read(TABLE, version).filter((F.col("status") == "leased") & (F.col("worker") == worker) & (F.col("until_ms") == now_ms + lease_ms))


def finish(store: st.Store, worker: str, ended: DataFrame, now_ms: int, also: dict[str, st.Change] | None = None, backoff_ms: int = BACKOFF_MS) -> int:
    """Ends a worker's turns (turn_id, outcome: done, skipped or failed, error), with changes to other tables in the same commit. Turns that the worker has no lease of any more are left as they are."""

    def change(before: st.Manifest) -> dict[str, st.Change]:
        held = store.read_at(before, TABLE).filter((F.col("status") == "leased") & (F.col("worker") == worker))
        rows = held.drop("error").join(ended.select("turn_id", "outcome", "error"), "turn_id")
        again = (F.col("outcome") == "failed") & (F.col("attempts") < MOST_ATTEMPTS)
        wait = F.when(again, F.lit(now_ms) + F.lit(backoff_ms) * F.pow(F.lit(2), F.col("attempts") - 1).cast("long")).otherwise(0)
        rows = rows.withColumns({"status": F.when(again, "pending").otherwise(F.col("outcome")), "until_ms": wait.cast("long"), "worker": F.lit(None).cast("string")})
        return {TABLE: st.replace(rows.select(*[c.split()[0] for c in SCHEMA.split(", ")]), "turn_id"), **(also or {})}

    return store.commit(change, note=f"finish {worker}")


def drain(store: st.Store, turns: DataFrame, worker: str, now_ms: int, extractor: Callable[[dict], Iterable[dict]] | None = None, most: int = 1_000_000) -> DataFrame:
    """One round of a worker: leases turns, extracts their facts, and stores claims and statuses in one commit; the work table after it."""
    taken = lease(store, worker, most, now_ms)
    out = ingest.write(turns.join(taken.select("turn_id"), "turn_id", "left_semi"), extractor)
    ended = out["turns"].select("turn_id", F.when(F.col("extraction_status") == "done", "done").otherwise("skipped").alias("outcome"), F.lit(None).cast("string").alias("error"))
    claims = out["claims"].select("claim_id", "session_id", "source_turn_id", "subject", "predicate", "value", "text", "confidence", "created_ts")
    finish(store, worker, ended, now_ms, {"claims": st.replace(claims, "claim_id")})
    return store.read(TABLE)
