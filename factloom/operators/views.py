"""Views over the claims log: projections, world state, lineage, signals, consolidation, digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom import model


def active(claims: DataFrame) -> DataFrame:
    return claims.filter(F.col("status").isin(*model.SERVABLE))


def valid_at(claims: DataFrame, t: Column) -> DataFrame:
    """Half-open validity; a missing bound is open."""
    since, until = F.col("valid_from_ts"), F.col("valid_until_ts")
    return claims.filter((since.isNull() | (since <= t)) & (until.isNull() | (t < until)))


def as_of(claims: DataFrame, t: Column) -> DataFrame:
    """The world at t: retired claims count too."""
    return valid_at(claims.filter(F.col("status").isin(*model.SERVABLE, "superseded")), t)


def in_namespace(rows: DataFrame, turns: DataFrame, namespace: str) -> DataFrame:
    return rows.join(turns.filter(F.col("namespace") == namespace).select("session_id").distinct(), "session_id", "left_semi")


def latest_per_slot(claims: DataFrame, slot: tuple[str, ...] = ("subject", "predicate")) -> DataFrame:
    w = Window.partitionBy(*slot).orderBy(F.desc("created_ts"), "claim_id")
    return claims.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def projection(claims: DataFrame, turns: DataFrame, k: int = 10) -> DataFrame:
    """Active claims of each session, or its latest k turns if it has none."""
    held = active(claims)
    w = Window.partitionBy("session_id").orderBy(F.desc("ts"), "turn_id")
    rest = turns.join(held.select("session_id").distinct(), "session_id", "left_anti").withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)
    return held.select("session_id", F.lit("claim").alias("kind"), F.col("claim_id").alias("id"), F.col("created_ts").alias("ts")).unionByName(
        rest.select("session_id", F.lit("turn").alias("kind"), F.col("turn_id").alias("id"), "ts")
    )


def world_state(claims: DataFrame, vocabulary: tuple[str, ...]) -> DataFrame:
    """Facts of each subject by predicate and time, and the predicates that it lacks."""
    fact = F.struct("predicate", "created_ts", "claim_id", "value")
    rows = active(claims).groupBy("session_id", "subject").agg(F.sort_array(F.collect_list(fact)).alias("facts"), F.collect_set("predicate").alias("filled"))
    known = F.array(*[F.lit(x) for x in vocabulary])
    return rows.select("session_id", "subject", "facts", F.array_sort(F.array_except(known, "filled")).alias("gaps"))


def quote(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, end - start)


def pairs(edges: DataFrame, claims: DataFrame) -> DataFrame:
    """Each edge with both claims."""
    old = claims.select(F.col("claim_id").alias("old_claim_id"), F.col("value").alias("old_value"), F.col("status").alias("old_status"))
    new = claims.select(F.col("claim_id").alias("new_claim_id"), F.col("value").alias("new_value"), F.col("status").alias("new_status"))
    return edges.join(old, "old_claim_id").join(new, "new_claim_id")


def contradictions(edges: DataFrame, claims: DataFrame) -> DataFrame:
    both = pairs(edges.filter("edge_type = 'contradicts'"), claims)
    return both.filter(F.col("old_status").isin(*model.SERVABLE) & F.col("new_status").isin(*model.SERVABLE))


def superseded_by(edges: DataFrame) -> DataFrame:
    """The latest claim that retired each claim."""
    return edges.groupBy(F.col("old_claim_id").alias("claim_id")).agg(F.max_by("new_claim_id", F.struct("created_ts", "new_claim_id")).alias("superseded_by"))


def lineage(edges: DataFrame, checkpoint) -> DataFrame:
    """claim_id, origin, depth: the oldest claim that each one goes back to and how many steps away it is.

    Pointer doubling: a round doubles the steps that each pointer spans, so chains of n claims take log2 n rounds. Edges that
    lead in a circle have no oldest claim: a circle is cut before its least claim, which is then the origin of all its claims and of
    the chains that hang on it. checkpoint(df) gives df cut from its plan; without that the plan would double each round.
    """
    w = Window.partitionBy("new_claim_id").orderBy(F.desc("created_ts"), F.desc("old_claim_id"))
    parent = edges.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select(F.col("new_claim_id").alias("claim_id"), F.col("old_claim_id").alias("up"), F.lit(1).cast("long").alias("steps"))
    first = checkpoint(parent)
    most = first.count()  # no chain is longer
    at, span = first, 1
    while True:
        above = at.select(F.col("claim_id").alias("up"), F.col("up").alias("further"), F.col("steps").alias("more"))
        grown = checkpoint(at.join(above, "up", "left").select("claim_id", F.coalesce("further", "up").alias("up"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("further").isNotNull().alias("moved")))
        if grown.filter("moved").isEmpty():
            return at.select("claim_id", F.col("up").alias("origin"), F.col("steps").alias("depth"))
        if span >= most:  # each pointer had already spanned more steps than any chain has, so those that move go round in circles
            break
        at, span = grown.drop("moved"), 2 * span
    # cut each circle at its least claim and walk again
    circle = grown.filter("moved").select(F.col("up").alias("claim_id")).distinct()
    ring = checkpoint(first.join(circle, "claim_id", "left_semi"))
    if ring.isEmpty():
        raise AssertionError("pointers move without a circle")
    names = checkpoint(_least_around(ring, checkpoint))
    cut = names.filter("claim_id = least").select("claim_id")
    return lineage(first.join(cut, "claim_id", "left_anti").select(F.col("up").alias("old_claim_id"), F.col("claim_id").alias("new_claim_id"), F.lit(0).cast("long").alias("created_ts")), checkpoint)


def _least_around(ring: DataFrame, checkpoint) -> DataFrame:
    """claim_id, least: the least claim of each circle (claim_id, up), by doubling the stretch that a claim looks over."""
    at = ring.select("claim_id", "up", F.least("claim_id", "up").alias("least"))
    most, span = ring.count(), 1
    while span < most:
        above = at.select(F.col("claim_id").alias("up"), F.col("up").alias("further"), F.col("least").alias("other"))
        at = checkpoint(at.join(above, "up").select("claim_id", F.col("further").alias("up"), F.least("least", "other").alias("least")))
        span *= 2
    return at.select("claim_id", "least")


def trace(claims: DataFrame, edges: DataFrame, checkpoint) -> DataFrame:
    """Claims with their lineage and, by chain, the place from the newest."""
    rows = claims.join(lineage(edges, checkpoint), "claim_id", "left").withColumn("origin", F.coalesce("origin", "claim_id")).withColumn("depth", F.coalesce("depth", F.lit(0)))
    w = Window.partitionBy("origin").orderBy(F.desc("depth"), "claim_id")
    return rows.withColumn("place", F.row_number().over(w))


def volatility_label(n: Column) -> Column:
    return F.when(n == 0, "stable").when(n <= 2, "evolving").otherwise("volatile")


def volatility(claims: DataFrame, edges: DataFrame) -> DataFrame:
    """By slot: number of changes, mean life of ended claims in days, days the current one has held until the log's last claim."""
    slot = ["subject", "predicate"]
    ends = claims.select("claim_id", *slot)
    inside = edges.select("old_claim_id", "new_claim_id").join(ends.withColumnRenamed("claim_id", "old_claim_id"), "old_claim_id").join(
        ends.select(F.col("claim_id").alias("new_claim_id"), *[F.col(x).alias(f"new_{x}") for x in slot]), "new_claim_id"
    )
    changes = inside.filter("subject = new_subject and predicate = new_predicate").groupBy(*slot).agg(F.count("*").alias("changes"))
    lives = claims.groupBy(*slot).agg(F.avg(F.when(F.col("valid_until_ts").isNotNull(), (F.col("valid_until_ts") - F.col("valid_from_ts")) / float(model.DAY_NS))).alias("life_days"), F.max(F.when(F.col("status").isin(*model.SERVABLE), F.col("created_ts"))).alias("current_since"))
    rows = lives.join(changes, slot, "left").withColumn("changes", F.coalesce("changes", F.lit(0)))
    return rows.withColumn("label", volatility_label(F.col("changes")))


def predicate_volatility(claims: DataFrame, edges: DataFrame) -> DataFrame:
    """By predicate, as a subject's profile counts it: each edge once for either end. The ends are unfolded, not joined by an OR."""
    ends = edges.select(F.explode(F.array("old_claim_id", "new_claim_id")).alias("claim_id"))
    return ends.join(claims.select("claim_id", "predicate"), "claim_id").groupBy("predicate").agg(F.count("*").alias("n")).withColumn("label", volatility_label(F.col("n")))


def staleness(claims: DataFrame, edges: DataFrame, now: Column, windows: tuple[int, int, int] = (365, 90, 14)) -> DataFrame:
    """Active claims older than their slot's window in days: stable, evolving, volatile."""
    news = edges.select(F.col("new_claim_id").alias("claim_id")).join(claims.select("claim_id", "subject", "predicate"), "claim_id").groupBy("subject", "predicate").agg(F.count("*").alias("n"))
    rows = active(claims).join(news, ["subject", "predicate"], "left").withColumn("label", volatility_label(F.coalesce("n", F.lit(0))))
    days = F.when(F.col("label") == "stable", windows[0]).when(F.col("label") == "evolving", windows[1]).otherwise(windows[2])
    return rows.withColumn("stale", (now - F.col("created_ts")) > days * model.DAY_NS)


def importance_score(peers: Column, role: Column, confidence: Column, age_ns: Column, sessions: Column) -> Column:
    """Weighted signals of uniqueness, role in edges, confidence (none counts as 0), recency, stability and spread over sessions."""
    days = F.greatest(age_ns / float(model.DAY_NS), F.lit(0.0))
    score = (
        0.25 / F.greatest(F.coalesce(peers, F.lit(0)), F.lit(1)) + 0.20 * role + 0.15 * F.coalesce(confidence, F.lit(0.0)) + 0.15 * F.exp(-days / 30.0)
        + 0.15 * F.least(F.lit(1.0), days / 180.0) + 0.10 * F.least(F.lit(1.0), F.coalesce(sessions, F.lit(0)) / 5.0)
    )
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))


def importance(claims: DataFrame, edges: DataFrame, now: Column) -> DataFrame:
    """importance_score of all active claims in one job; a subject's sessions are those with active claims."""
    live = active(claims)
    slot = live.groupBy("subject", "predicate").agg(F.count("*").alias("peers"))
    spread = live.groupBy("subject").agg(F.count_distinct("session_id").alias("sessions"))
    new = edges.select(F.col("new_claim_id").alias("claim_id"), F.lit(True).alias("is_new")).distinct()
    old = edges.select(F.col("old_claim_id").alias("claim_id"), F.lit(True).alias("is_old")).distinct()
    rows = live.join(slot, ["subject", "predicate"], "left").join(spread, "subject", "left").join(new, "claim_id", "left").join(old, "claim_id", "left")
    role = F.when(F.col("is_new"), 1.0).when(F.col("is_old"), 0.0).otherwise(0.5)
    return rows.withColumn("importance", importance_score(F.col("peers"), role, F.col("confidence"), now - F.col("created_ts"), F.col("sessions")))


def utility(importance: Column, access: Column, age_days: Column, confidence: Column) -> Column:
    return 0.4 * importance + 0.3 * access / (access + 3.0) + 0.2 / (1.0 + age_days / 90.0) + 0.1 * confidence


def consolidate(claims: DataFrame, least_sessions: int = 3) -> DataFrame:
    """Groups of one slot and value, held in enough sessions and uncontested: the first claim is canonical, others are demoted."""
    slot = claims.groupBy("subject", "predicate").agg(F.count_distinct("value").alias("values"))
    group = claims.groupBy("subject", "predicate", "value").agg(
        F.count_distinct("session_id").alias("sessions"), F.count("*").alias("members"), F.min(F.struct("created_ts", "claim_id")).alias("first"),
        F.max("importance").alias("most"),
    )
    kept = group.join(slot.filter("values = 1"), ["subject", "predicate"]).filter((F.col("sessions") >= least_sessions) & (F.col("members") >= 2))
    return kept.select("subject", "predicate", "value", "sessions", "members", F.col("first.claim_id").alias("canonical"), F.greatest(F.col("most"), F.lit(0.9)).alias("importance"))


def demoted(claims: DataFrame, groups: DataFrame) -> DataFrame:
    """The members of consolidated groups but the canonical one."""
    return claims.join(groups.select("subject", "predicate", "value", "canonical"), ["subject", "predicate", "value"]).filter("claim_id != canonical")


def digest(claims: DataFrame, edges: DataFrame | None = None, top: int = 3) -> DataFrame:
    """By session: the most important facts; updates, which are other active facts that replaced something, newest edge first; and how many facts are left."""
    w = Window.partitionBy("session_id").orderBy(F.desc("importance"), "created_ts", "claim_id")
    ranked = active(claims).withColumn("rn", F.row_number().over(w))
    if edges is None:
        ranked = ranked.withColumn("edge_ts", F.lit(None).cast("long"))
    else:
        last = edges.groupBy(F.col("new_claim_id").alias("claim_id")).agg(F.max("created_ts").alias("edge_ts"))
        ranked = ranked.join(last, "claim_id", "left")
    key, updated = F.col("rn") <= top, F.col("edge_ts").isNotNull()
    facts = F.sort_array(F.collect_list(F.when(key, F.struct("rn", "claim_id", "text"))))
    updates = F.transform(F.sort_array(F.collect_list(F.when(~key & updated, F.struct((-F.col("edge_ts")).alias("order"), "claim_id")))), lambda x: x["claim_id"])
    return ranked.groupBy("session_id").agg(facts.alias("facts"), updates.alias("updates"), F.sum(F.when(key | updated, 0).otherwise(1)).alias("remaining"))


def forward(edges: DataFrame, checkpoint) -> DataFrame:
    """claim_id, head, steps: the claim that each replaced one leads to in the end, by the latest edge out of each."""
    turned = edges.select(F.col("new_claim_id").alias("old_claim_id"), F.col("old_claim_id").alias("new_claim_id"), "created_ts")
    return lineage(turned, checkpoint).select("claim_id", F.col("origin").alias("head"), F.col("depth").alias("steps"))


def chains_by_head(claims: DataFrame, edges: DataFrame, checkpoint) -> DataFrame:
    """head, step and the claims' columns: every claim under the newest claim of its chain, so many steps from it. A claim that two replaced stands under the one that did so last."""
    taken = edges.groupBy("old_claim_id").agg(F.max_by("new_claim_id", F.struct("created_ts", "new_claim_id")).alias("new_claim_id"), F.max("created_ts").alias("created_ts"))
    led = forward(taken, checkpoint).select("claim_id", "head", "steps")
    return claims.join(led, "claim_id", "left").select(F.coalesce("head", "claim_id").alias("head"), F.coalesce("steps", F.lit(0)).alias("step"), *claims.columns)


def head_of(claims: DataFrame, edges: DataFrame, checkpoint, claim_id: str | None = None, slot: tuple[str, str] | None = None) -> DataFrame:
    """The chain (head, step, the claims' columns, oldest last) that a claim is in, or that the newest servable claim of a slot (subject, predicate) heads; nothing for what is unknown."""
    if claim_id is None:
        newest = latest_per_slot(active(claims).filter((F.col("subject") == slot[0]) & (F.col("predicate") == slot[1]))).select("claim_id")
    else:
        newest = claims.filter(F.col("claim_id") == claim_id).select("claim_id")
    rows = chains_by_head(claims, edges, checkpoint)
    heads = rows.join(newest, "claim_id", "left_semi").select("head").distinct()
    return rows.join(heads, "head", "left_semi").orderBy("step")


def same_identity(claims: DataFrame, of: DataFrame) -> DataFrame:
    """claim_id, earlier: for each of the given claims (claim_id, slot), the newest replaceable claim of its slot but itself."""
    slot = ["session_id", "subject", "predicate"]
    held = claims.filter(F.col("status").isin(*model.REPLACEABLE)).select(*slot, F.col("claim_id").alias("other"), F.col("created_ts").alias("ts"))
    w = Window.partitionBy(*slot).orderBy(F.desc("ts"), "other")
    newest = held.withColumn("rn", F.row_number().over(w)).filter("rn <= 2")  # the second counts where the first is the claim itself
    met = of.select("claim_id", *slot).join(newest, slot).filter("other != claim_id")
    return met.groupBy("claim_id").agg(F.min_by("other", "rn").alias("earlier"))


def filtered(claims: DataFrame, matcher: Column) -> DataFrame:
    """The active claims that a matcher, any condition, takes."""
    return active(claims).filter(matcher)


def turns_at(turns: DataFrame, t: Column) -> DataFrame:
    """Turns said by then."""
    return turns.filter(F.col("ts") <= t)


def by_predicate(claims: DataFrame) -> DataFrame:
    """Active claims, those of a predicate together and in order: a sort by ranges, so no predicate is gathered in one place."""
    return active(claims).orderBy("predicate", "created_ts", "claim_id")


def entity_nodes(claims: DataFrame) -> DataFrame:
    """entity, claims, predicates, first_ts, last_ts of active and superseded claims (claim_id, entity_key, predicate, created_ts, status)."""
    rows = claims.filter(F.col("status").isin(*model.SERVABLE, "superseded") & (F.coalesce("entity_key", F.lit("")) != ""))
    return rows.groupBy(F.col("entity_key").alias("entity")).agg(
        F.count_distinct("claim_id").alias("claims"), F.array_sort(F.collect_set("predicate")).alias("predicates"), F.min("created_ts").alias("first_ts"), F.max("created_ts").alias("last_ts")
    )


def status_counts(turns: DataFrame, claims: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of counts, as the status commands give: turns, sessions, claims, those with facts, active ones, edges."""
    t = turns.agg(F.count("*").alias("turns"), F.count_distinct("session_id").alias("sessions"))
    c = claims.agg(F.count("*").alias("claims"), F.count_distinct("session_id").alias("sessions_with_claims"), F.count_if(F.col("status").isin(*model.SERVABLE)).alias("active"), F.count_if(F.col("status") == "superseded").alias("superseded"))
    return t.crossJoin(c).crossJoin(edges.agg(F.count("*").alias("edges")))  # three rows of one


def trace_text(traced: DataFrame) -> DataFrame:
    """A line for each step of a chain, newest first: its place, value, status, who said it and the words it was read from."""
    mark = F.when(F.col("place") == 1, "* ").otherwise("  ")
    said = F.coalesce(F.concat(F.lit(" <- "), "speaker", F.lit(': "'), "quote", F.lit('"')), F.lit(""))
    return traced.select("origin", "place", F.concat(mark, "value", F.lit(" ["), "status", F.lit("]"), said).alias("line"))


PROFILE = "subject string, tier int, text string, claim_ids array<string>, cost int, used int"


def profile(claims: DataFrame, edges: DataFrame, events: DataFrame, budget: int = 500, cut: float = 0.8) -> DataFrame:
    """Lines of each subject under a budget, four tokens a word: stable and important claims, evolving ones with what they replaced, preferences, life events, volatile ones with their changes.

    A tier ends at its first line that doesn't fit and the next goes on with what is left; a claim is told once. Both depend on
    the lines before, so a subject's lines are folded in one task. Changes are counted for each subject and predicate, an edge once
    for either end. events: `bursts.bursts`.
    """
    slots = claims.select("claim_id", "subject", "predicate", "value")
    changes = edges.select(F.explode(F.array("old_claim_id", "new_claim_id")).alias("claim_id")).join(slots, "claim_id").groupBy("subject", "predicate").agg(F.count("*").alias("changes"))
    last = edges.groupBy(F.col("new_claim_id").alias("claim_id")).agg(F.max_by("old_claim_id", F.struct("created_ts", "old_claim_id")).alias("old"))
    before = last.join(slots.select(F.col("claim_id").alias("old"), F.col("value").alias("before")), "old").select("claim_id", "before")
    rows = active(claims).join(changes, ["subject", "predicate"], "left").join(before, "claim_id", "left").withColumn("changes", F.coalesce("changes", F.lit(0)))
    label = volatility_label(F.col("changes"))
    plain = F.concat(F.lit("["), F.col("predicate"), F.lit("] "), F.col("value"))
    tiers = F.array(
        F.when((label == "stable") & (F.col("importance") >= cut), F.struct(F.lit(1).alias("tier"), plain.alias("text"))),
        F.when(label == "evolving", F.struct(F.lit(2).alias("tier"), F.concat(plain, F.coalesce(F.concat(F.lit(" (previously: "), F.col("before"), F.lit(")")), F.lit(""))).alias("text"))),
        F.when(F.col("predicate") == "user_preference", F.struct(F.lit(3).alias("tier"), plain.alias("text"))),
        F.when(label == "volatile", F.struct(F.lit(5).alias("tier"), F.concat(plain, F.lit(" (changed "), F.col("changes").cast("string"), F.lit(" times)")).alias("text"))),
    )
    lines = rows.select("subject", F.explode(F.array_compact(tiers)).alias("x"), F.col("importance").cast("double").alias("weight"), "created_ts", "claim_id", F.array("claim_id").alias("claim_ids"))
    lines = lines.select("subject", "x.tier", "x.text", "weight", "created_ts", "claim_id", "claim_ids")
    told = F.explode("claim_ids").alias("claim_id")
    first = events.select("subject", "start_ts", told).join(slots.drop("subject"), "claim_id").join(claims.select("claim_id", "created_ts"), "claim_id")
    first = first.groupBy("subject", "start_ts", "predicate").agg(F.min_by("value", F.struct("created_ts", "claim_id")).alias("value"))
    changed = first.groupBy("subject", "start_ts").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("predicate", "value"))), lambda x: F.concat(x["predicate"], F.lit(" -> "), x["value"])), ", ").alias("changed"))
    day = F.date_format(F.date_from_unix_date((F.floor(F.col("start_ts") / model.DAY_NS)).cast("int")), "yyyy-MM-dd")
    life = events.join(changed, ["subject", "start_ts"]).join(active(claims).select("subject").distinct(), "subject", "left_semi").select(
        "subject", F.lit(4).alias("tier"), F.concat(F.lit("[life_event] Changes on "), day, F.lit(": "), F.col("changed")).alias("text"),
        F.col("significance").alias("weight"), F.col("start_ts").alias("created_ts"), F.lit("").alias("claim_id"), "claim_ids",
    )

    def fold(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values(["tier", "weight", "created_ts", "claim_id"], ascending=[True, False, True, True])
        out, used, told, ended = [], 0, set(), 0
        for tier, text, ids in zip(pdf["tier"], pdf["text"], pdf["claim_ids"], strict=True):
            if tier == ended or (tier != 4 and ids[0] in told):
                continue
            cost = 4 * len(text.split())
            if used + cost > budget:
                ended = tier
                continue
            used += cost
            told.update(ids)
            out.append((key[0], tier, text, list(ids), cost, used))
        return pd.DataFrame(out, columns=["subject", "tier", "text", "claim_ids", "cost", "used"])

    return lines.unionByName(life).groupBy("subject").applyInPandas(fold, PROFILE)


def stats(claims: DataFrame) -> DataFrame:
    return claims.agg(
        F.count("*").alias("claims"), F.count_if(F.col("status").isin(*model.SERVABLE)).alias("active"), F.count_if(F.col("status") == "superseded").alias("superseded"),
        F.count_distinct("session_id").alias("sessions"), F.count_distinct("subject").alias("subjects"),
    )


def trust_status(claims: DataFrame) -> DataFrame:
    trust = F.col("source_trust")
    return claims.groupBy("namespace").agg(
        F.count("*").alias("claims"), F.count_if(trust >= 0.7).alias("high"), F.count_if((trust >= 0.4) & (trust < 0.7)).alias("medium"), F.count_if(trust < 0.4).alias("low"),
        F.count_distinct("session_id").alias("sessions"), F.round(F.avg((trust < model.QUARANTINE).cast("double")), 3).alias("quarantine_rate"),
    )
