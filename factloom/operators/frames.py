"""Event frames: what several turns say about one event, with its place, time, amount and item.

A plan over whole tables, in five steps: each turn's type; turns that speak of one thing, looked at in chunks of a session; what they
connect; turns that only give a place, drawn to the nearest typed turn; and the slots of each group, by expressions.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import text as tx
from factloom.operators import graph

# Words, names and patterns of the slots.
STOPS = ("a", "an", "the", "i", "my", "for", "on", "at", "in", "to", "of", "and", "was", "is")
TRIVIAL = ("user", "patient", "i", "")
STORES = ("target", "walmart", "costco", "petco", "ikea", "trader", "safeway", "kroger", "publix", "aldi", "whole foods")
PLACE = r"\b(?:at|from|in)\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)"
NAME = r"[A-Z][a-z]{2,}"
CALENDAR = r"(?i)\b(?:Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday|January|February|March|April|May|June|July|August|September|October|November|December)\b"
CLOCK = r"(?i)\d{1,2}:\d{2}|\d{1,2}\s*(?:am|pm)|(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"
DURATION = r"(?i)\d+\s*(?:minute|hour|day|week|month|year|min|hr)"
AMOUNT = r"(?i)\$\s*[\d,.]+|\d+\s*(?:dollars?|cents?)"
TRIGGERS = {
    "purchase_redemption": (("coupon on ", "bought ", "purchased ", "redeemed "), r"(?i)\s*(at|from|for|last|on)\s.*$"),
    "education_milestone": (("degree in ", "studied ", "major in ", "enrolled in "), r"(?i)\s*(at|from|for)\s.*$"),
}
QUOTED = '"([^"]+)"'
TITLED = r"(?i)(?:named|called|titled)\s+(.+?)(?:\s+(?:by|from|on)\b|$)"
PROVIDER = "location_linked_action"
#: Turns apart that may speak of one event, and that a place may be drawn over. Fixed values.
REACH, NEAR = 5, 3
#: Places of a session that a task looks at together.
CHUNK = 1000


def some(value: Column) -> Column:
    """Null for an empty string."""
    return F.when(value != "", value)


def first(values: Column, rule) -> Column:
    """rule(value) of the first value that has one."""
    return F.get(F.filter(F.transform(values, rule), lambda x: x.isNotNull()), 0)


def content(value: Column) -> Column:
    return F.array_except(tx.tokens(value), tx.words_in(STOPS))


def location(values: Column) -> Column:
    """A capitalised name after a preposition, or a known store, of the first value with either; else any capitalised name that is no day or month."""
    names = lambda v: F.regexp_extract_all(v, F.lit(NAME), F.lit(0))

    def stated(v: Column) -> Column:
        place = some(F.regexp_extract(v, PLACE, 1))
        return F.when(~place.rlike("(?i)^(?:" + CALENDAR.removeprefix("(?i)") + ")"), place)

    def store(v: Column) -> Column:
        word = F.get(F.filter(F.split(F.lower(v), r"\s+"), lambda w: w.isin(*STORES)), 0)
        written = F.get(F.filter(names(v), lambda n: F.lower(n).startswith(word)), 0)
        return F.when(word.isNotNull(), F.coalesce(written, F.initcap(word)))

    def named(v: Column) -> Column:
        return F.get(F.filter(names(v), lambda n: ~n.rlike("^(?:" + CALENDAR + ")")), 0)

    return F.coalesce(first(values, lambda v: F.coalesce(stated(v), store(v))), first(values, named))


def time_of(values: Column) -> Column:
    precise = first(values, lambda v: F.coalesce(some(F.regexp_extract(v, CLOCK, 0)), some(F.regexp_extract(v, DURATION, 0))))
    return F.coalesce(precise, first(values, lambda v: some(F.regexp_extract(v, CALENDAR, 0))))


def amount(values: Column) -> Column:
    return first(values, lambda v: some(F.regexp_extract(v, AMOUNT, 0)))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def item(values: Column, kind: Column) -> Column:
    """What follows a trigger of the event's type, up to where it was or when; of artifacts, what is quoted or called something."""
    def after(triggers: tuple[str, ...], tail: str):
        def one(v: Column) -> Column:
            places = [(F.instr(F.lower(v), F.lit(x)), len(x)) for x in triggers]
            return F.coalesce(*[F.when(at > 0, some(trimmed(F.regexp_replace(trimmed(F.substring(v, at + n, F.length(v))), tail, "")))) for at, n in places])

        return one

    found = F.lit(None).cast("string")
    for name, rule in TRIGGERS.items():
        found = F.when(kind == name, first(values, after(*rule))).otherwise(found)
    artifact = first(values, lambda v: F.coalesce(some(F.regexp_extract(v, QUOTED, 1)), some(trimmed(F.regexp_extract(v, TITLED, 1)))))
    return F.when(kind == "named_artifact", artifact).otherwise(found)


def coreferent(batches):
    """Rows (session, place, home, members, said, link) of a stream of (session_id, chunk, turn_index, own, entity, value, words) in order: each own place of a chunk with what is said there, the
    least place of the chunk that it is tied to and how many are, and a link for each place of the chunk before that one of its own is tied to. What is held are the values of a chunk and
    the words of the last REACH places."""
    key, up, near, said = None, {}, [], {}  # near: (place, own, entities, sets of words), oldest first

    def top(x):
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def turn_done():
        """The last place against those before it."""
        place, own, entities, claims = near[-1]
        for other, other_own, others, before in near[:-1] if own else []:
            if place - other <= REACH and (entities & others or any(len(x & y) >= 2 for x in claims for y in before)):
                if not other_own:
                    yield key[0], place, None, None, None, other
                elif (a := top(other)) != (b := top(place)):
                    up[max(a, b)] = min(a, b)

    def chunk_done():
        if near:
            yield from turn_done()
        sizes = Counter(map(top, up))
        for place in up:
            yield key[0], place, top(place), sizes[top(place)], " ".join(said[place]), None

    for batch in batches:
        for session, chunk, place, own, entity, value, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (session, chunk) != key:
                yield from chunk_done()
                key, up, near, said = (session, chunk), {}, [], {}
            if not near or near[-1][0] != place:
                if near:
                    yield from turn_done()
                near = [x for x in near if place - x[0] <= REACH]
                near.append((place, own, set(), set()))
                if own:
                    up[place], said[place] = place, []
            if own and value is not None:
                said[place].append(value)
            if entity is not None:
                near[-1][2].add(entity)
            if words and len(words) > 1:
                near[-1][3].add(frozenset(words))
    yield from chunk_done()


def connected(claims: DataFrame, checkpoint) -> DataFrame:
    """session_id, turn_index, kind, home, alone: each turn's type, the least place that it is connected with, by turns at most REACH apart that name one entity or share two content words of a
    claim, and whether it is connected with none.

    A session is no unit of work: it is cut into chunks of CHUNK places, each row is dealt out once (the last REACH places also to the next chunk), and what is
    left of the whole are links between neighbouring chunks' groups.
    """
    place = F.col("turn_index")
    chunk = F.floor(place / CHUNK).cast("long")
    spread = F.when(F.pmod(place, F.lit(CHUNK)) >= CHUNK - REACH, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    entity = F.when(~F.coalesce("entity", F.lit("")).isin(*TRIVIAL), F.col("entity"))
    rows = claims.filter("session_id is not null and turn_index is not null").select("session_id", "turn_index", "claim_id", entity.alias("entity"), "value", F.explode(spread).alias("shift"))
    dealt = rows.select("session_id", (chunk + F.col("shift")).alias("chunk"), "turn_index", (F.col("shift") == 0).alias("own"), "entity", "value", "claim_id").repartition("session_id", "chunk").sortWithinPartitions("session_id", "chunk", "turn_index", "claim_id", "value").drop("claim_id")

    def run(batches):
        import pyarrow as pa

        made = coreferent(batches)
        while out := [x for _, x in zip(range(10_000), made, strict=False)]:
            session, place, home, members, said, link = map(list, zip(*out, strict=True))
            numbers = {n: pa.array(c, pa.int64()) for n, c in (("turn_index", place), ("home", home), ("members", members))}
            yield pa.RecordBatch.from_pydict({"session_id": pa.array(session, pa.string()), **numbers, "said": pa.array(said, pa.string()), "link": pa.array(link, pa.int64())})

    found = dealt.withColumn("words", content(F.col("value"))).mapInArrow(run, "session_id string, turn_index long, home long, members long, said string, link long")
    found = checkpoint(found.select("session_id", "turn_index", "home", "members", tx.event_type(F.col("said")).alias("kind"), "link"))
    homes = found.filter("link is null").select("session_id", "turn_index", "kind", "home", (F.col("members") == 1).alias("alone"))
    links = found.filter("link is not null").select("session_id", "turn_index", "link")
    if links.isEmpty():  # no session goes beyond a chunk's end
        return homes
    own = homes.select("session_id", "turn_index", "home")
    at = lambda c: F.struct(F.col("session_id").alias("s"), F.col(c).alias("i"))
    links = links.join(own, ["session_id", "turn_index"]).select("session_id", F.col("home").alias("b"), F.col("link").alias("turn_index"))
    links = links.join(own, ["session_id", "turn_index"]).select(at("home").alias("a"), at("b").alias("b")).distinct()
    far = graph.components(links, checkpoint).select(F.col("node.s").alias("session_id"), F.col("node.i").alias("home"), F.col("root.i").alias("first"))
    both = homes.join(far, ["session_id", "home"], "left")
    return checkpoint(both.select("session_id", "turn_index", "kind", F.coalesce("first", "home").alias("home"), (F.col("alone") & F.col("first").isNull()).alias("alone")))


def grouped_turns(own: DataFrame, checkpoint) -> DataFrame:
    """session_id, turn_index, home: each turn of claims (as for event_frames) with the first turn of its event."""
    placed = connected(own, checkpoint)
    # a turn that only gives a place goes to the nearest turn of another type; of two as near, to the earlier
    lone = placed.filter((F.col("kind") == PROVIDER) & F.col("alone")).select("session_id", F.col("turn_index").alias("from"), F.explode(F.sequence(F.col("turn_index") - NEAR, F.col("turn_index") + NEAR)).alias("turn_index"))
    drawn = lone.join(placed.filter(F.col("kind").isNotNull() & (F.col("kind") != PROVIDER)), ["session_id", "turn_index"])
    drawn = drawn.groupBy("session_id", F.col("from").alias("turn_index")).agg(F.min_by("home", F.struct(F.abs(F.col("turn_index") - F.col("from")), "turn_index")).alias("drawn"))
    return placed.join(drawn, ["session_id", "turn_index"], "left").select("session_id", "turn_index", F.coalesce("drawn", "home").alias("home"))


def event_frames(claims: DataFrame, checkpoint) -> DataFrame:
    """Frames of claims (session_id, turn_id, turn_index, claim_id, value, entity, confidence): the event's type, its turns and claims in order,
    slots, least confidence, participants and the names of missing slots. Groups without a type are none."""
    own = claims.select("session_id", "turn_id", F.col("turn_index").cast("long").alias("turn_index"), "claim_id", "value", "entity", F.col("confidence").cast("double").alias("confidence"))
    homes = grouped_turns(own, checkpoint)
    row = F.struct("turn_index", "claim_id", "turn_id", "value")
    groups = own.join(homes, ["session_id", "turn_index"]).groupBy("session_id", "home").agg(
        F.sort_array(F.collect_list(row)).alias("rows"), F.min("confidence").alias("confidence"), F.array_sort(F.collect_set(F.coalesce("entity", F.lit("")))).alias("participants")
    )
    part = lambda c: F.transform("rows", lambda x: x[c])
    told = groups.select("session_id", "confidence", "participants", F.array_distinct(part("turn_id")).alias("turn_ids"), part("claim_id").alias("claim_ids"), part("value").alias("values"))
    told = told.withColumn("event_type", tx.event_type(F.array_join("values", " "))).filter("event_type is not null")
    v = F.col("values")
    told = told.withColumns({"location": location(v), "time_expr": time_of(v), "amount": amount(v), "item": item(v, F.col("event_type"))})
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), c.removesuffix("_expr")) for c in ("location", "time_expr", "amount", "item")]))
    return told.select("session_id", "event_type", "turn_ids", "claim_ids", "location", "time_expr", "amount", "item", "confidence", "participants", missing.alias("missing"))
