"""Structured Streaming over turns and claims."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import text as tx
from factloom.operators import facts, slots
from factloom.sources import store as st


#: Folders that a log of claims is dealt into.
BUCKETS = 256


def event_windows(events: DataFrame, watermark: str = "1 day", size: str = "6 hours") -> DataFrame:
    """Counts and sums by event type and window of event time; rows later than the watermark are left out."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", watermark)
    return timed.groupBy(F.window("at", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def admitted(turns: DataFrame) -> DataFrame:
    """Stateless part of the write path: admission and durability, as a stream or a batch."""
    return turns.withColumn("reason", tx.admission(F.col("text"))).filter("reason = 'admitted'").withColumn("durability", tx.durability(F.col("text")))


def run_resolution(claims: DataFrame, store: st.Store, checkpoint: str, single_valued: tuple[str, ...], every: int = 16):
    """Appends each micro-batch to a log in a store and puts the edges of the slots that it touched in the place of their old ones.

    A slot's edges are folded from its whole log in time order, so a late row changes what it would have changed in time.
    The log's files are parted by BUCKETS of the slots' hash, and a batch reads those of its own slots only. Log and edges of a batch become visible in one
    commit that bears the batch's number, so a batch that comes again is left out. Each so many batches the log's newest folders become one, and those
    of so many as well, so a stream's life leaves few folders to list; the edges are written anew.
    """
    bucket = F.pmod(F.xxhash64(*facts.SLOT), F.lit(BUCKETS)).cast("int")
    none = {c: F.lit(None).cast(t) for c, t in (("old_claim_id", "string"), ("new_claim_id", "string"), ("edge_type", "string"), ("created_ts", "long"))}

    def step(batch: DataFrame, number: int) -> None:
        done = store.manifest()
        if int(done.marks.get("batch", -1)) >= number:
            return
        own = batch.withColumn("bucket", bucket)
        mine = [r.bucket for r in own.select("bucket").distinct().collect()]  # at most BUCKETS numbers
        whole = own
        if "log" in done.tables:
            whole = own.unionByName(store.read_at(done, "log").filter(F.col("bucket").isin(mine)))
        touched = batch.select(*facts.SLOT).distinct()
        edges = facts.supersede(whole.join(touched, list(facts.SLOT), "left_semi"), single_valued)
        edges = edges.unionByName(touched.withColumns(none))  # a slot without edges has a row that says so
        store.commit({"log": st.append(own, by=("bucket",)), "edges": st.replace_groups(edges, *facts.SLOT)}, note=f"batch {number}", marks={"batch": number})
        for k in (every, every * every):
            if number % k == k - 1:
                store.merge("log", every, ("bucket",))
        if number % every == every - 1:
            store.compact("edges")

    return claims.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_edges(store: st.Store) -> DataFrame:
    """The edges of each slot from its last batch."""
    return store.read("edges").filter("old_claim_id is not null")


EDGE = "session_id string, subject string, predicate string, old_claim_id string, new_claim_id string, edge_type string, created_ts long"


#: Where a stream's keyed state must lie: only this store has maps and timers.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
HELD_COLUMNS = {"claim_id": "string", "value": "string", "source_turn_id": "string", "speaker": "string", "source_trust": "double"}


def stateful_resolution(claims: DataFrame, single_valued: tuple[str, ...], delay: str = "1 hour", forget_ms: int | None = None, tick_ms: int = 1000) -> DataFrame:
    """Edges of a stream of claims, by keyed state and timers: the state of a slot is what it holds and what waits, so a batch reads no log.

    A claim waits until the watermark, so far behind the newest claim, has passed it; a timer then takes the slot's waiting claims up in the order of time. Claims that come in any order within
    the delay make the same edges as a batch over all of them; later ones are dropped, as by every watermark. Timers stand at whole ticks, so a slot is woken once a tick
    at most. With forget_ms, a slot of which nothing was said for so long forgets what it holds. Claims without time are left out.

    State: a map from numbers to held claims and one from (time, id) to waiting ones; a decision writes what it changes.
    """
    from pyspark.sql.streaming import StatefulProcessor

    if claims.sparkSession.conf.get(*STATE_STORE) != STATE_STORE[1]:
        raise ValueError("set {} to {}".format(*STATE_STORE))
    columns = list(HELD_COLUMNS)
    value = ", ".join(f"{c} {t}" for c, t in HELD_COLUMNS.items())

    class Resolution(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.held = handle.getMapState("held", "number long", f"created_ts long, {value}")
            self.waiting = handle.getMapState("waiting", "created_ts long, claim_id string", value)
            self.last = handle.getValueState("last", "ms long")
            self.cached = None  # the slot that was woken last, with its index

        def handleInputRows(self, key, rows, timerValues):
            for pdf in rows:
                for x in pdf[["created_ts", *columns]].to_dict("records"):
                    ts = int(x["created_ts"])
                    self.waiting.updateValue((ts, x["claim_id"]), tuple(x[c] for c in columns))
                    self.handle.registerTimer((ts // 1_000_000 // tick_ms + 1) * tick_ms)
            return iter(())

        def slot(self, key):
            if self.cached is None or self.cached[0] != key:
                stored = sorted((n[0], dict(zip(["created_ts", *columns], v, strict=True))) for n, v in self.held.iterator())
                self.cached = (key, slots.Held.of(stored, key[2] in single_valued))
            return self.cached[1]

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            import pandas as pd

            at = expiredTimerInfo.getExpiryTimeInMs()
            ready = sorted((k, v) for k, v in self.waiting.iterator() if k[0] < at * 1_000_000)
            if forget_ms is not None and self.last.exists():
                first = ready[0][0][0] // 1_000_000 if ready else at
                if first >= self.last.get()[0] + forget_ms:
                    self.held.clear()
                    self.last.clear()
                    self.cached = None
            rows = []
            for (ts, _), stored in ready:
                held = self.slot(key)
                found = held.decide(dict(zip(columns, stored, strict=True), created_ts=ts))
                if held.retired is not None:
                    self.held.removeKey((held.retired,))
                self.held.updateValue((held.count - 1,), (ts, *stored))
                self.waiting.removeKey((ts, stored[0]))
                if found:
                    rows.append((*key, found["old_claim_id"], found["new_claim_id"], found["edge_type"], found["created_ts"]))
            if ready and forget_ms is not None:
                last = ready[-1][0][0] // 1_000_000
                self.last.update((last,))
                self.handle.registerTimer(last + forget_ms)
            if rows:
                yield pd.DataFrame(rows, columns=[*facts.SLOT, "old_claim_id", "new_claim_id", "edge_type", "created_ts"])

        def close(self):
            self.cached = None

    triples = claims.filter("subject is not null and predicate is not null and value is not null and created_ts is not null and claim_id is not null").select(*facts.SLOT, "created_ts", *columns)
    timed = triples.withColumn("at", F.timestamp_micros(F.floor(F.col("created_ts") / 1000).cast("long"))).withWatermark("at", delay)
    return timed.groupBy(*facts.SLOT).transformWithStateInPandas(Resolution(), EDGE, "Append", "eventTime")


def publish(feed: DataFrame, listeners: dict[str, list], checkpoint: str):
    """Hands each micro-batch of a change feed (kind, ...) to the listeners of its kinds as a DataFrame. One that fails doesn't stop the others."""

    def step(batch: DataFrame, number: int) -> None:
        for kind, callables in listeners.items():
            own = batch.filter(F.col("kind") == kind)
            for f in callables:
                try:
                    f(own, number)
                except Exception as error:  # noqa: BLE001 -- a listener is any callable
                    failed.append((kind, number, error))

    failed: list = []
    query = feed.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    return query, failed
