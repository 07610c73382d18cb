"""Life events: claims of a subject that come close together and are of several kinds.

From each claim that is in no event yet, those within the window are looked at; if they are of enough kinds they are one event, and the scan goes on behind it. Which
claim starts an event so depends on those before it. In pieces: claims that could start an event are found by themselves; from each, a pointer leads to the first
such claim behind its window; where none lies within a window before one, it starts an event for certain; all others that start one are found by following
pointers from those, doubled each round. Time is cut into stretches of the window's length, and rows meet in those, so a subject that is spoken of all the
time is dealt out over its time.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom import model


def copied(rows: DataFrame, window: int, shifts: range) -> DataFrame:
    """Rows under their stretch of time and others near it; own: whether it is their own."""
    stretch = F.floor(F.col("ts") / window).cast("long")
    return rows.withColumn("__shift", F.explode(F.array(*[F.lit(x) for x in shifts]))).withColumn("stretch", stretch + F.col("__shift")).withColumn("own", F.col("__shift") == 0).drop("__shift")


def by_stretch(rows: DataFrame, columns: list[str], rule, schema: str) -> DataFrame:
    """rule(subject, lists of the columns, own) for each subject and stretch, in order of time; what two windows of one subject hold is held at once."""
    dealt = rows.select("subject", "stretch", "own", *columns).repartition("subject", "stretch").sortWithinPartitions("subject", "stretch", "ts", "id")

    def run(batches):
        import pyarrow as pa

        target = pa.schema([(c.split()[0], {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}[c.split()[1]]) for c in schema.split(", ")])
        key, held = None, [[] for _ in range(len(columns) + 1)]

        def close():
            return pa.RecordBatch.from_pylist([dict(zip(target.names, x, strict=True)) for x in rule(key[0], held[1:], held[0])], target) if key else None

        for batch in batches:
            for subject, stretch, *values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (subject, stretch) != key:
                    if (out := close()) is not None and out.num_rows:
                        yield out
                    key, held = (subject, stretch), [[] for _ in range(len(columns) + 1)]
                for x, v in zip(held, values, strict=True):
                    x.append(v)
        if (out := close()) is not None and out.num_rows:
            yield out

    return dealt.mapInArrow(run, schema)


def candidates(rows: DataFrame, window: int, least: int) -> DataFrame:
    """subject, ts, id of claims from which the window holds enough kinds. rows: subject, ts, id, kind."""

    def rule(subject, lists, own):
        ts, ids, kinds = lists
        counts: dict = {}
        end, out = 0, []
        for i in range(len(ts)):
            while end < len(ts) and ts[end] <= ts[i] + window:
                counts[kinds[end]] = counts.get(kinds[end], 0) + 1
                end += 1
            if own[i] and len(counts) >= least:
                out.append((subject, ts[i], ids[i]))
            counts[kinds[i]] -= 1
            if not counts[kinds[i]]:
                del counts[kinds[i]]
        return out

    return by_stretch(copied(rows, window, range(-1, 1)), ["ts", "id", "kind"], rule, "subject string, ts long, id string")


def pointers(found: DataFrame, window: int) -> DataFrame:
    """subject, ts, id, certain, to_ts, to_id: whether a candidate starts an event whatever was before, and the first candidate behind its window, if that is within another one."""

    def rule(subject, lists, own):
        ts, ids = lists
        out = []
        for i in range(len(ts)):
            if own[i]:
                k = bisect_right(ts, ts[i] + window)
                near = k < len(ts) and ts[k] <= ts[i] + 2 * window
                out.append((subject, ts[i], ids[i], i == 0 or ts[i] - ts[i - 1] > window, ts[k] if near else None, ids[k] if near else None))
        return out

    return by_stretch(copied(found, window, range(-2, 2)), ["ts", "id"], rule, "subject string, ts long, id string, certain boolean, to_ts long, to_id string")


def starts(steps: DataFrame, checkpoint) -> DataFrame:
    """subject, at (ts, id) of the candidates that start an event."""
    reached = checkpoint(steps.filter("certain").select("subject", F.struct("ts", "id").alias("at")))
    hops = checkpoint(steps.filter("to_ts is not null").select("subject", F.struct("ts", "id").alias("at"), F.struct(F.col("to_ts").alias("ts"), F.col("to_id").alias("id")).alias("to")))
    while not hops.isEmpty():
        further = reached.join(hops, ["subject", "at"]).select("subject", F.col("to").alias("at"))
        reached = checkpoint(reached.unionByName(further).distinct())
        onward = hops.select("subject", F.col("at").alias("to"), F.col("to").alias("beyond"))
        hops = checkpoint(hops.join(onward, ["subject", "to"]).select("subject", "at", F.col("beyond").alias("to")))
    return reached


def bursts(claims: DataFrame, checkpoint, window_ns: int = model.DAY_NS, least: int = 3) -> DataFrame:
    """subject, start_ts, end_ts, claim_ids, predicates (by first mention), significance (their share of the subject's kinds) of each life event.

    Claims without subject or time are in none; a missing predicate counts as an empty one.
    """
    kind: Column = F.coalesce(F.col("predicate"), F.lit(""))
    rows = claims.filter(F.col("subject").isNotNull() & F.col("created_ts").isNotNull()).select("subject", F.col("created_ts").alias("ts"), F.col("claim_id").alias("id"), kind.alias("kind"))
    steps = checkpoint(pointers(checkpoint(candidates(rows, window_ns, least)), window_ns))
    from_here = copied(starts(steps, checkpoint).select("subject", "at", F.col("at.ts").alias("ts")), window_ns, range(0, 2)).select("subject", "at", "stretch")
    place = F.floor(F.col("ts") / window_ns).cast("long")
    inside = rows.withColumn("stretch", place).join(from_here, ["subject", "stretch"]).filter((F.struct("ts", "id") >= F.col("at")) & (F.col("ts") <= F.col("at.ts") + window_ns))
    told = inside.groupBy("subject", "at").agg(F.sort_array(F.collect_list(F.struct("ts", "id", "kind"))).alias("rows"))
    kinds = rows.groupBy("subject").agg(F.count_distinct("kind").alias("kinds"))
    part = lambda c: F.transform("rows", lambda x: x[c])
    out = told.join(kinds, "subject").select("subject", F.col("at.ts").alias("start_ts"), F.array_max(part("ts")).alias("end_ts"), part("id").alias("claim_ids"), F.array_distinct(part("kind")).alias("predicates"), "kinds")
    return out.withColumn("significance", F.round(F.least(F.lit(1.0), F.size("predicates") / F.col("kinds")), 4)).drop("kinds")
