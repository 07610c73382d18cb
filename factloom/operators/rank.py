"""Retrieval: BM25, cosine, reciprocal rank fusion, hybrid ranking of claims, turns and tools."""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom import model
from factloom.functions import text as tx


def query_tokens(query: str) -> Counter:
    return Counter(re.findall("[a-z0-9]+", query.lower()))


def bm25(docs: DataFrame, query: str, part: str | None = None, text_col: str = "text", name: str = "bm25") -> DataFrame:
    """docs with a score against the query, repeated query words counted, corpus figures by part.

    The query is known when the plan is made, so each of its words is a column, and only a row of counts for each part
    is aggregated and joined back. Without part that is one row, read when the plan is made: the corpus is scanned
    for its figures and once more for the scores, and neither scan is shuffled.
    """
    words = query_tokens(query)
    rows = docs.withColumn("__tokens", tx.tokens(F.coalesce(F.col(text_col), F.lit(""))))
    for i, w in enumerate(words):
        rows = rows.withColumn(f"__tf{i}", F.size(F.filter("__tokens", _is(w))).cast("double"))
    rows = rows.withColumn("__dl", F.size("__tokens").cast("double")).drop("__tokens")
    counted = [F.count("*").alias("__n"), F.avg("__dl").alias("__avg"), *[F.count_if(F.col(f"__tf{i}") > 0).alias(f"__df{i}") for i in range(len(words))]]
    if part:
        both = rows.join(rows.groupBy(part).agg(*counted), part)
    else:  # one row for the whole corpus: its numbers become literals, and no join is left
        figures = rows.agg(*counted).first()
        both = rows.withColumns({c: F.lit(figures[c]).cast("double") for c in figures.asDict()})
    score = F.lit(0.0)
    for i, n in enumerate(words.values()):
        tf, df = F.col(f"__tf{i}"), F.col(f"__df{i}")
        idf = F.ln((F.col("__n") - df + 0.5) / (df + 0.5) + 1.0)
        norm = tf + model.BM25_K1 * (1.0 - model.BM25_B + model.BM25_B * F.col("__dl") / F.col("__avg"))
        score = score + F.when(tf > 0, float(n) * idf * tf * (model.BM25_K1 + 1.0) / norm).otherwise(0.0)
    return both.select(*docs.columns, F.round(score, 12).alias(name))


def corpus_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """token, df, total: documents with it and occurrences. A document gives each distinct word once and each word once, so one sum by word, combined before the shuffle, gives both."""
    found = tx.tokens(F.coalesce(F.col(text_col), F.lit("")))
    once = lambda d, n: lambda x: F.struct(x.alias("token"), F.lit(d).cast("long").alias("d"), F.lit(n).cast("long").alias("n"))
    rows = docs.select(found.alias("t")).select(F.explode(F.concat(F.transform(F.array_distinct("t"), once(1, 0)), F.transform("t", once(0, 1)))).alias("x"))
    return rows.groupBy("x.token").agg(F.sum("x.d").alias("df"), F.sum("x.n").alias("total"))


def _is(word: str):
    return lambda x: x == word


def fused(rows: DataFrame, channels: dict[str, float], part: str, order: list[str], name: str = "score", k: int = model.RRF_K, explain: str | None = None) -> DataFrame:
    """Reciprocal rank fusion. A rank is ordinal: equal scores keep the order of the given columns. All ranks share one partitioning.
    explain names a column for a map of what each channel adds."""
    total, shares = F.lit(0.0), []
    for c, weight in channels.items():
        share = weight / (float(k) + F.row_number().over(Window.partitionBy(part).orderBy(F.desc(c), *order)))
        shares += [F.lit(c), share]
        total = total + share
    out = rows.withColumn(name, F.round(total, 12))
    return out.withColumn(explain, F.create_map(*shares)) if explain else out


def fused_top(rows: DataFrame, channels: dict[str, float], order: list[str], k: int, name: str = "score", fuse: int = model.RRF_K) -> DataFrame:
    """The k best of a whole table by rank fusion, without ranking the table in one place.

    A row beyond place n of every channel scores at most the sum of weights / (fuse + n + 1), and the first k rows of the weightiest
    channel score at least its weight / (fuse + k); n is the least number that makes the first less than the second, so the best are among
    the channels' first n rows, which a distributed top-n gives. A row that isn't among a channel's first n has its place there
    counted over the table, in one pass.
    """
    n = max(k, math.ceil(sum(channels.values()) / max(channels.values()) * (fuse + k)) - fuse)
    ids = None
    for c in channels:
        own = rows.orderBy(F.desc(c), *order).limit(n).select(*order)
        ids = own if ids is None else ids.unionByName(own)
    found = rows.join(F.broadcast(ids.distinct()), order)  # at most n rows a channel
    held = [r.asDict() for r in found.select(*order, *channels).collect()]

    places: list[dict] = [{} for _ in held]
    for c in channels:
        ranked = sorted(range(len(held)), key=lambda i: tuple(held[i][o] for o in order))
        ranked.sort(key=lambda i: held[i][c], reverse=True)
        for place, i in enumerate(ranked[:n], 1):
            places[i][c] = place
    for c, counts in _ahead(rows, held, list(channels), order).items():
        for i, n_ahead in enumerate(counts):
            places[i].setdefault(c, n_ahead + 1)
    scores = [round(sum(w / (float(fuse) + places[i][c]) for c, w in channels.items()), 12) for i in range(len(held))]
    best = sorted(range(len(held)), key=lambda i: (-scores[i], *(held[i][o] for o in order)))[:k]
    kept = rows.sparkSession.createDataFrame([(*(held[i][o] for o in order), float(scores[i])) for i in best], ", ".join(f"`{o}` {rows.schema[o].dataType.simpleString()}" for o in order) + f", `{name}` double")
    return rows.join(F.broadcast(kept), order).orderBy(F.desc(name), *order)


def _ahead(rows: DataFrame, held: list[dict], channels: list[str], order: list[str]) -> dict[str, list[int]]:
    """For each channel, how many rows of the table come before each held row: every row looks up its place among the held ones, and only counts leave a task."""
    from bisect import bisect_right

    key = lambda c, r: (-r[c], *(r[o] for o in order))
    ranked = {c: sorted(range(len(held)), key=lambda i, c=c: key(c, held[i])) for c in channels}
    keys = {c: [key(c, held[i]) for i in own] for c, own in ranked.items()}

    def run(batches):
        import pyarrow as pa

        counts = {c: [0] * (len(own) + 1) for c, own in keys.items()}
        for batch in batches:
            columns = {n: batch.column(n).to_pylist() for n in batch.schema.names}
            ties = list(zip(*(columns[o] for o in order), strict=True))
            for c, own in keys.items():
                found = counts[c]
                for value, tie in zip(columns[c], ties, strict=True):
                    found[bisect_right(own, (-value, *tie))] += 1
        flat = [(c, i, n) for c, own in counts.items() for i, n in enumerate(own) if n]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in flat], pa.string()), pa.array([x[1] for x in flat], pa.int64()), pa.array([x[2] for x in flat], pa.int64())], names=["channel", "place", "n"])

    table = rows.select(*order, *[F.col(c).cast("double").alias(c) for c in channels if c not in order])
    found = table.mapInArrow(run, "channel string, place long, n long").groupBy("channel", "place").agg(F.sum("n").alias("n")).collect()  # at most a number for each held row and channel
    out = {}
    for c, own in ranked.items():
        at = {r.place: r.n for r in found if r.channel == c}
        total, ahead = 0, [0] * len(held)
        for place, i in enumerate(own):
            total += at.get(place, 0)
            ahead[i] = total
        out[c] = ahead
    return out


def reranked(hits: DataFrame, query: str, scorer, k: int, text_col: str = "text", order: tuple[str, ...] = ("id",)) -> DataFrame:
    """The first k hits in the order of a scorer, (query, texts) -> scores, the others after them as they were. Where the scorer fails, nothing changes."""
    first = hits.orderBy(F.desc("score"), *order).limit(k).collect()  # k rows
    try:
        given = [float(x) for x in scorer(query, [r[text_col] for r in first])]
    except Exception:  # noqa: BLE001 -- a scorer is any callable, and the ranking stands without it
        return hits.withColumn("rerank", F.lit(None).cast("double"))
    fields = ", ".join(f"`{o}` {hits.schema[o].dataType.simpleString()}" for o in order)
    told = hits.sparkSession.createDataFrame([(*(r[o] for o in order), x) for r, x in zip(first, given, strict=True)], f"{fields}, rerank double")
    return hits.join(F.broadcast(told), list(order), "left").orderBy(F.desc_nulls_last("rerank"), F.desc("score"), *order)


def postings(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """An index: token, key, tf and dl for each distinct word of each document, to be written once and sorted by token."""
    words = docs.select(F.col(key), tx.tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("t")).select(key, F.size("t").cast("double").alias("dl"), F.explode("t").alias("token"))
    return words.groupBy("token", key, "dl").agg(F.count("*").cast("double").alias("tf"))


def search_postings(index: DataFrame, query: str, key: str, n_docs: int, average: float) -> DataFrame:
    """BM25 of the documents that have a word of the query. Only those words' postings are read: the filter reaches the files."""
    counts = query_tokens(query)
    rows = index.filter(F.col("token").isin(*counts))
    df = rows.groupBy("token").agg(F.count("*").cast("double").alias("df"))  # a row for each word asked
    times = F.element_at(F.create_map(*[F.lit(x) for pair in counts.items() for x in pair]), F.col("token"))
    idf = F.ln((n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    norm = F.col("tf") + model.BM25_K1 * (1.0 - model.BM25_B + model.BM25_B * F.col("dl") / average)
    return rows.join(F.broadcast(df), "token").groupBy(key).agg(F.round(F.sum(times * idf * F.col("tf") * (model.BM25_K1 + 1.0) / norm), 12).alias("bm25"))


def top(rows: DataFrame, k: int, order: list, part: str | None = None) -> DataFrame:
    if part is None:
        return rows.orderBy(*order).limit(k)
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(part).orderBy(*order))).filter(F.col("rn") <= k)


def nearest(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    literal = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.select(id_col, F.round(tx.cosine(F.col(vector_col), literal), 6).alias("score"))
    return scored.orderBy(F.desc("score"), id_col).limit(k)


def episodes(turns: DataFrame, query: str, semantic: str | None = None) -> DataFrame:
    """Turns of each session by relevance, BM25, words in common and recency. A column of similarities is optional."""
    words = sorted(set(query_tokens(query)))
    raw = sorted(set(query.lower().split()) | set(words))
    hit = F.exists(tx.tokens(F.col("text")), lambda t: t.isin(*raw))
    rows = bm25(turns, query, "session_id").withColumn("entity", hit.cast("double")).withColumn("recency", F.col("ts").cast("double"))
    rows = rows.withColumn("semantic", F.col(semantic) if semantic else F.lit(0.0))
    weights = {c: w for c, w in model.EPISODE_WEIGHTS.items() if c != "semantic" or semantic}
    return fused(rows, weights, "session_id", ["ts", "turn_id"])


def facts(claims: DataFrame, query: str, include_superseded: bool = False, scope: tuple[int, int] | None = None, families: tuple[str, ...] = (), semantic: str | None = None, part: str = "session_id", weights_of: dict[str, float] = model.WEIGHTS, explain: str | None = None,
          entities: DataFrame | None = None, near: DataFrame | None = None) -> DataFrame:
    """Claims of each session by eleven channels; ranks are taken over all candidates, demoted ones are dropped after.

    entities (claim_id, entity_text) match claims that name a word or an entity of the query; near (claim_id), claims of the neighbours of
    its entities as `memory.neighbour_claims` gives them, count 0.6.

    Channels without a signal for this query are left out of the plan, so they cost no sort.
    """
    rows = claims if include_superseded else claims.filter(F.col("status").isin(*model.SERVABLE))
    words = sorted(set(query.lower().split()))
    rows = bm25(rows, query, part)
    subject = F.split(F.coalesce(F.col("subject"), F.lit("")), "_")
    rows = rows.withColumn("entity", F.forall(subject, lambda x: x.isin(*words)).cast("double"))
    if entities is not None:
        named = entities.filter(F.lower("entity_text").isin(*{*words, *query_names(query)})).select("claim_id").distinct().withColumn("__named", F.lit(1.0))
        rows = rows.join(named, "claim_id", "left").withColumn("entity", F.greatest("entity", F.coalesce("__named", F.lit(0.0)))).drop("__named")
    if near is not None:
        beside = near.select("claim_id").distinct().withColumn("__near", F.lit(0.6))
        rows = rows.join(beside, "claim_id", "left").withColumn("entity", F.greatest("entity", F.coalesce("__near", F.lit(0.0)))).drop("__near")
    recency = F.coalesce(F.col("event_ts"), F.col("valid_from_ts"), F.col("created_ts")) if "event_ts" in claims.columns else F.coalesce(F.col("valid_from_ts"), F.col("created_ts"))
    rows = rows.withColumn("temporal", recency.cast("double")).withColumn("trust", F.col("source_trust"))
    count = Window.partitionBy(part, F.coalesce(F.col("subject"), F.lit("")), F.coalesce(F.col("predicate"), F.lit("")))
    rows = rows.withColumn("frequency", F.count("*").over(count).cast("double"))
    weights = {c: w for c, w in weights_of.items() if c in ("entity", "temporal", "bm25", "confidence", "frequency", "importance", "usage", "trust") and (c in rows.columns)}
    kind = max((i for i, (w, _, _) in enumerate(tx.QUERY_FAMILIES) if any(x in query.lower() for x in w)), default=None)
    if kind is not None and tx.QUERY_FAMILIES[kind][2] in ("knowledge_update", "temporal"):
        weights["temporal"] *= 3
    if scope:
        rows = rows.withColumn("scope", recency.between(*scope).cast("double"))
        weights["scope"] = weights_of["scope"]
    if families:
        rows = rows.withColumn("predicate_match", F.col("predicate").isin(*families).cast("double"))
        weights["predicate_match"] = weights_of["predicate"]
    if semantic:
        rows = rows.withColumn("semantic", F.coalesce(F.col(semantic), F.lit(0.0)))
        weights["semantic"] = weights_of["semantic"]
    ranked = fused(rows, weights, part, ["created_ts", "claim_id"], explain=explain)
    return ranked.filter(~F.col("demoted")) if "demoted" in ranked.columns else ranked


def asked_bm25(docs: DataFrame, asks: DataFrame, key: str) -> DataFrame:
    """docs with a score against their session's own query (session_id, query). Queries are rows here, so words are joined, not columns."""
    words = docs.withColumn("__t", tx.tokens(F.coalesce(F.col("text"), F.lit("")))).select("session_id", key, F.size("__t").cast("double").alias("__dl"), "__t")
    figures = words.groupBy("session_id").agg(F.count("*").alias("__n"), F.avg("__dl").alias("__avg"))
    asked = asks.select("session_id", F.explode(tx.tokens(F.col("query"))).alias("token")).groupBy("session_id", "token").agg(F.count("*").alias("__qc"))
    tf = words.select("session_id", key, "__dl", F.explode("__t").alias("token")).groupBy("session_id", key, "__dl", "token").agg(F.count("*").alias("__tf"))
    hit = tf.join(asked, ["session_id", "token"]).withColumn("__df", F.count("*").over(Window.partitionBy("session_id", "token"))).join(figures, "session_id")
    idf = F.ln((F.col("__n") - F.col("__df") + 0.5) / (F.col("__df") + 0.5) + 1.0)
    norm = F.col("__tf") + model.BM25_K1 * (1.0 - model.BM25_B + model.BM25_B * F.col("__dl") / F.col("__avg"))
    score = hit.groupBy("session_id", key).agg(F.round(F.sum(F.col("__qc") * idf * F.col("__tf") * (model.BM25_K1 + 1.0) / norm), 12).alias("bm25"))
    return docs.join(score, ["session_id", key], "left").withColumn("bm25", F.coalesce("bm25", F.lit(0.0)))


def asked_episodes(turns: DataFrame, asks: DataFrame) -> DataFrame:
    """`episodes` with a query for each session."""
    raw = F.array_distinct(F.concat(F.split(F.lower("query"), r"\s+"), tx.tokens(F.col("query"))))
    rows = asked_bm25(turns, asks, "turn_id").join(asks.select("session_id", raw.alias("__raw")), "session_id")
    rows = rows.withColumn("entity", F.arrays_overlap(tx.tokens(F.col("text")), "__raw").cast("double")).withColumn("recency", F.col("ts").cast("double"))
    return fused(rows, {c: w for c, w in model.EPISODE_WEIGHTS.items() if c != "semantic"}, "session_id", ["ts", "turn_id"])


def asked_facts(claims: DataFrame, asks: DataFrame, now: int) -> DataFrame:
    """`facts` with a query for each session, which also tells whether the past counts, its window of time and its predicates."""
    names = F.flatten(F.array(*[F.when(tx.contains_any(F.lower("query"), w), tx.words_in(f)).otherwise(F.array().cast("array<string>")) for w, f, _ in tx.QUERY_FAMILIES]))
    told = asks.select(
        "session_id", F.split(F.lower("query"), r"\s+").alias("__words"), tx.history_intent(F.col("query")).alias("__past"), scope_of(F.col("query"), now).alias("__scope"), names.alias("__names"),
        F.when(tx.query_type(F.col("query")).isin("knowledge_update", "temporal"), 3.0).otherwise(1.0).alias("__times"),
    )
    rows = claims.join(told, "session_id").filter(F.col("status").isin(*model.SERVABLE) | F.col("__past"))
    rows = asked_bm25(rows, asks, "claim_id")
    rows = rows.withColumn("entity", F.forall(F.split(F.coalesce(F.col("subject"), F.lit("")), "_"), lambda x: F.array_contains("__words", x)).cast("double"))
    recency = F.coalesce(*[F.col(c) for c in ("event_ts", "valid_from_ts", "created_ts") if c in claims.columns])
    count = Window.partitionBy("session_id", F.coalesce(F.col("subject"), F.lit("")), F.coalesce(F.col("predicate"), F.lit("")))
    rows = rows.withColumn("temporal", recency.cast("double")).withColumn("trust", F.col("source_trust")).withColumn("frequency", F.count("*").over(count).cast("double"))
    rows = rows.withColumn("scope", F.coalesce(recency.between(F.col("__scope.since"), F.col("__scope.until")), F.lit(False)).cast("double"))
    rows = rows.withColumn("predicate_match", F.coalesce(F.array_contains("__names", F.col("predicate")), F.lit(False)).cast("double"))
    weights = {c: F.lit(w) for c, w in model.WEIGHTS.items() if c not in ("semantic", "scope", "predicate") and c in rows.columns}
    weights["temporal"] = weights["temporal"] * F.col("__times")
    weights["scope"] = F.when(F.col("__scope").isNotNull(), model.WEIGHTS["scope"]).otherwise(0.0)
    weights["predicate_match"] = F.when(F.size("__names") > 0, model.WEIGHTS["predicate"]).otherwise(0.0)
    ranked = fused(rows, weights, "session_id", ["created_ts", "claim_id"])
    return ranked.filter(~F.col("demoted")) if "demoted" in ranked.columns else ranked


def fuse_memory(facts_ranked: DataFrame, episodes_ranked: DataFrame, per_session: int | None = None) -> DataFrame:
    """Facts and turns of each session in one order; of each kind's ranking, position counts, facts slightly more. The most for a session are cut after fusing."""
    f = facts_ranked.select("session_id", F.lit("fact").alias("kind"), F.col("claim_id").alias("id"), "score", F.col("claim_id").alias("tie"))
    e = episodes_ranked.select("session_id", F.lit("turn").alias("kind"), F.col("turn_id").alias("id"), "score", F.col("turn_id").alias("tie"))
    w = Window.partitionBy("session_id", "kind").orderBy(F.desc("score"), "tie")
    both = f.unionByName(e).withColumn("rank", F.row_number().over(w))
    if per_session:
        both = both.filter(F.col("rank") <= per_session)
    weight = F.when(F.col("kind") == "fact", model.FACT_WEIGHT).otherwise(model.EPISODE_WEIGHT)
    both = both.select("session_id", "kind", "id", F.round(weight / (model.RRF_K + F.col("rank")), 12).alias("score"))
    return top(both, per_session, [F.desc("score"), "kind", "id"], "session_id").drop("rn") if per_session else both


def across(hits: DataFrame, top_k: int = model.TOP_K, reserved: int = model.PER_SESSION_K, most: int = model.MOST_ACROSS) -> DataFrame:
    """Each session's best hits first, then others; the budget grows with the reserved ones up to a fixed most. One pass over all sessions."""
    order = [F.desc("score"), "kind", "id"]
    ranked = hits.withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy(*order)))
    ranked = ranked.withColumn("kept", F.col("place") <= reserved)
    first = ranked.orderBy(F.desc("kept"), *order, "session_id").limit(most)  # few rows, so what follows needs no partitions
    laid = first.withColumns({"at": F.row_number().over(Window.orderBy(F.desc("kept"), *order, "session_id")), "n": F.sum(F.col("kept").cast("int")).over(Window.partitionBy())})
    return laid.filter(F.col("at") <= F.greatest(F.lit(top_k), F.col("n"))).drop("at", "n")


def temporal_scope(query: str, now_ns: int) -> tuple[int, int] | None:
    """The window in nanoseconds that a query names."""
    from datetime import UTC, datetime, timedelta

    q, now = query.lower(), datetime.fromtimestamp(now_ns / 1e9, UTC)
    day = {"day": 1, "week": 7, "month": 30, "year": 365}

    def span(start: timedelta, end: timedelta = timedelta(0)) -> tuple[int, int]:
        return int((now - start).timestamp() * 1e9), int((now - end).timestamp() * 1e9)

    for unit in ("day", "week", "month"):
        if m := re.search(rf"(?:last|past)\s+(\d+)\s+{unit}s?", q):
            return span(timedelta(days=int(m[1]) * day[unit]))
    for unit in ("week", "month", "year"):
        if re.search(rf"(?:last|past)\s+{unit}\b", q):
            return span(timedelta(days=day[unit]))
    if re.search(r"\byesterday\b", q):
        return span(timedelta(days=1))
    if re.search(r"\bthis\s+week\b", q):
        return span(timedelta(days=now.weekday()))
    for unit in ("week", "month", "day"):
        if m := re.search(rf"(\d+)\s+{unit}s?\s+ago", q):
            n = int(m[1])
            return span(timedelta(days=n * day[unit]), timedelta(days=max(n - 1, 0) * day[unit]))
    return None


def scope_of(query: Column, now_ns: int) -> Column:
    """since, until in nanoseconds: `temporal_scope` of a column of queries, batch by batch; null where a query names no time.

    As expressions the patterns would be put into every use of the result, above joins too, and be matched again for each row.
    """

    @F.pandas_udf("struct<since:long,until:long>")
    def windows(asked):
        import pandas as pd

        found = [temporal_scope(x or "", now_ns) or (None, None) for x in asked]
        return pd.DataFrame({"since": pd.array([x[0] for x in found], "Int64"), "until": pd.array([x[1] for x in found], "Int64")})

    scope = windows(query)
    return F.when(scope["since"].isNotNull(), scope)


def tool_document(name: Column, description: Column, server: Column, tags: Column) -> Column:
    some = lambda c, label: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{label}: "), c))
    return F.concat_ws("\n", F.concat(F.lit("name: "), name), some(description, "description"), some(tags, "domain"), some(server, "server"))


#: Channels of tool retrieval: of the query and, scaled by its weight, of the memory. Fixed values.
TOOL_WEIGHTS = {"query_semantic": 0.5, "query_bm25": 0.5, "memory_bm25": 0.3, "memory_semantic": 0.3, "memory_boost": 0.2}


def tools(registry: DataFrame, query: str, memory: str = "", k: int = 10, memory_weight: float = 1.0, vectors: dict[str, list[float]] | None = None) -> DataFrame:
    """Tools (id, document, and embedding if vectors are given) by BM25 and likeness to the query and, with memory text, to the memory.

    vectors: of "query" and "memory". A channel without a signal, all of its scores 0, takes no part.
    """
    rows, weights = bm25(registry, query, None, "document", "query_bm25"), {"query_bm25": TOOL_WEIGHTS["query_bm25"]}
    told = bool(memory) and memory_weight > 0
    if told:
        rows = bm25(rows, memory, None, "document", "memory_bm25")
        weights["memory_bm25"] = TOOL_WEIGHTS["memory_bm25"] * memory_weight
    extra = {}
    for name, vector in (vectors or {}).items():
        if name == "query" or told:
            extra[f"{name}_semantic"] = F.round(tx.cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in vector])), 12)
    if told:
        extra["memory_boost"] = F.size(F.array_intersect(tx.tokens(F.col("document")), tx.words_in(sorted(query_tokens(memory))))).cast("double")
    rows = rows.withColumns(extra)
    if extra:
        signal = rows.agg(*[F.max(F.col(c) != 0).alias(c) for c in extra]).first()  # one row
        weights |= {c: TOOL_WEIGHTS[c] * (1.0 if c.startswith("query") else memory_weight) for c in extra if signal[c]}
    return fused_top(rows, {c: weights[c] for c in TOOL_WEIGHTS if c in weights}, ["id"], k)


def query_names(query: str) -> list[str]:
    """Names of a query's entities, lower-cased: capitalised words, organisations with their suffix."""
    found = [m.group() for m in re.finditer(tx.ORGANISATION, query)] + [m[1] for p in (tx.LOCATION, tx.PROPER_NOUN) for m in re.finditer(p, query) if m[1] not in tx.ENTITY_STOPS]
    return sorted({x.lower() for x in found})
