"""The write path, its seams, and operators beside it."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from factloom import model
from factloom.operators import context, facts, ingest, memory, rank, views
from factloom.plans.queries import checkpoint
from factloom.sources import tables
from factloom.streaming import stream

TURNS = "turn_id string, session_id string, speaker string, text string, ts long, source_type string, namespace string"
SAID = ["I live in Berlin near the river", "um ok", "My name is Ada Lovelace", "I live in Munich near the river", "", "[silence]", "The weather turned cold today"]


def log(spark):
    return spark.createDataFrame([(f"t{i}", "s1" if i < 5 else "s2", "user", x, i * 10**9, "conversation", "ns") for i, x in enumerate(SAID)], TURNS)


def test_write_path(spark):
    out = ingest.write(log(spark))
    status = {r.turn_id: r.extraction_status for r in out["turns"].collect()}
    assert status == {"t0": "done", "t1": "rejected", "t2": "done", "t3": "done", "t4": "rejected", "t5": "rejected", "t6": "done"}
    claims = {r.source_turn_id: r for r in out["claims"].collect()}
    assert claims["t0"].status == "superseded" and claims["t0"].superseded_by == claims["t3"].claim_id and claims["t0"].valid_until_ts == claims["t3"].created_ts
    assert claims["t2"].value == "Ada Lovelace" and claims["t6"].predicate == "observation" and claims["t3"].source_trust == 1.0
    kinds = {r.kind: r["count"] for r in out["events"].groupBy("kind").count().collect()}
    assert kinds == {"turn.added": 4, "claim.created": len(claims), "claim.superseded": 1}
    again = {r.claim_id for r in ingest.write(log(spark).repartition(5))["claims"].collect()}
    assert again == {r.claim_id for r in claims.values()}


def test_an_extractor_that_fails_finds_nothing(spark):
    def extractor(turn):
        if "cold" in turn["text"]:
            raise ValueError
        yield {"subject": "User", "predicate": "says", "value": turn["text"][:5]}
        yield {"subject": "", "predicate": "p", "value": "v"}
        if len(turn["prior"]):
            yield {"text": f"after {len(turn['prior'])}", "confidence": 0.9}

    out = ingest.write(log(spark), extractor)
    assert out["rejected"].count() == 3
    got = sorted((r.source_turn_id, r.subject or "", r.text) for r in out["claims"].collect())
    assert got == [("t0", "user", "user says I liv"), ("t2", "", "after 1"), ("t2", "user", "user says My na"), ("t3", "", "after 2"), ("t3", "user", "user says I liv")]
    assert {r.turn_id: r.extraction_status for r in out["turns"].collect()}["t6"] == "skipped"


def test_entity_replies(spark):
    replies = ['[{"name": "Ada", "type": "Person"}, {"name": ""}]', '{"claims": [], "entities": [{"text": "Rome"}]}', "CLAIMS\nENTITIES:\n- Ada Lovelace (person)\nnoise\n* Rome (LOCATION)", "{}", "3", None]
    rows = spark.createDataFrame([(x,) for x in replies], "raw string").select(ingest.parsed_entities(F.col("raw")).alias("e")).collect()
    assert [[tuple(x) for x in r.e] for r in rows] == [[("Ada", "person")], [("Rome", "unknown")], [("Ada Lovelace", "person"), ("Rome", "location")], [], [], []]


CLAIM = "session_id string, subject string, predicate string, claim_id string, value string, source_turn_id string, speaker string, source_trust double, created_ts long"
SECOND = 1_000_000_000


def streamed(spark, tmp_path, batches, **options):
    """Edges of a stream that gets these batches one after another, then a late sign that time has gone on."""
    spark.conf.set(*stream.STATE_STORE)
    path = str(tmp_path / "in")
    name = f"edges_{random.randrange(10**9)}"
    for rows in [*batches, [("end", "u", "p", "end", "v", "tend", "user", 1.0, 10**9 * SECOND)], [("end", "u", "p", "end2", "v", "tend", "user", 1.0, 10**9 * SECOND + 1)]]:
        spark.createDataFrame(rows, CLAIM).coalesce(1).write.mode("append").parquet(path)
        source = spark.readStream.schema(CLAIM).parquet(path)
        q = stream.stateful_resolution(source, ("p",), **options).writeStream.format("parquet").option("path", str(tmp_path / name)).outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(300)
    return sorted(map(tuple, spark.read.parquet(str(tmp_path / name)).collect()))


def timed_claims(n, seed=3):
    rng = random.Random(seed)
    return [(f"s{i % 2}", "u", rng.choice("pq"), f"c{i:02}", rng.choice(["x y z", "x y w", "lives in A", "lives in B", "q"]), f"t{i}", rng.choice(["user", "assistant"]), rng.choice([0.35, 1.0]), (i + 1) * SECOND + i) for i in range(n)]


def test_stateful_stream_equals_the_fold_in_any_order(spark, tmp_path):
    """Rows within the delay may come in any order, over batches too."""
    rows = timed_claims(45)
    late = random.Random(7).sample(rows, 45)
    got = streamed(spark, tmp_path, [late[:15], late[15:30], late[30:]], delay="100 seconds")
    want = sorted(map(tuple, facts.supersede(spark.createDataFrame(rows, CLAIM), ("p",)).collect()))
    assert got == want and len(want) > 10


def test_rows_behind_the_watermark_are_dropped(spark, tmp_path):
    rows = timed_claims(20)
    batches = [rows[:2] + rows[12:], [("s0", "u", "p", "m", "w", "tm", "user", 1.0, 90 * SECOND)], rows[2:5]]  # the last is far behind
    got = streamed(spark, tmp_path, batches, delay="5 seconds")
    seen = spark.createDataFrame(batches[0] + batches[1], CLAIM)
    assert got == sorted(map(tuple, facts.supersede(seen, ("p",)).collect()))


def test_idle_slots_are_forgotten(spark, tmp_path):
    rows = [("s", "u", "p", f"c{i}", f"v{i}", f"t{i}", "user", 1.0, ts * SECOND) for i, ts in enumerate((1, 2, 50, 51))]
    got = streamed(spark, tmp_path, [rows], delay="1 second", forget_ms=20_000)
    assert [x[3:5] for x in got] == [("c0", "c1"), ("c2", "c3")]


def test_listeners(spark, tmp_path):
    feed = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "kind string, n long")
    feed.write.parquet(str(tmp_path / "in"))
    seen = []

    def broken(batch, number):
        raise RuntimeError

    query, failed = stream.publish(spark.readStream.schema(feed.schema).parquet(str(tmp_path / "in")), {"a": [broken, lambda b, n: seen.extend(r.n for r in b.collect())]}, str(tmp_path / "ck"))
    query.awaitTermination(60)
    assert sorted(seen) == [1, 3] and [x[0] for x in failed] == ["a"]


def test_due_and_pending(spark):
    turns = spark.createDataFrame([(f"t{i}", "a" if i < 12 else "b", i, None if i % 2 else "done") for i in range(20)], "turn_id string, session_id string, ts long, extraction_status string")
    assert [tuple(r) for r in ingest.due(turns).collect()] == [("a", 12)]
    assert [tuple(r) for r in ingest.due(turns.filter("ts >= 18"), turns.filter("ts < 18"), 8).collect()] == [("b", 8)]
    assert [r.turn_id for r in ingest.pending(turns).filter("session_id = 'b'").orderBy("place").collect()] == ["t13", "t15", "t17", "t19"]


def test_clock_and_packs(spark, tmp_path):
    rows = spark.createDataFrame([("s", 5, "a"), ("s", 5, "b"), ("s", 5, "c"), ("s", 6, "d"), ("s", 20, "e")], "p string, ts long, id string")
    assert {r.id: r.ts for r in tables.monotone(rows, "p", "ts", ("id",)).collect()} == {"a": 5, "b": 6, "c": 7, "d": 8, "e": 20}
    for name, pack in {"a": {"predicate_families": ["x", "y"], "single_valued": ["y"], "sub_slots": {"k": ["x"]}}, "b": {"predicate_families": ["y", "z"], "single_valued": [], "sub_slots": {"k": ["z"]}}}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps({"pack_id": name, **pack}, indent=1))
    packs = tables.read_packs(spark, str(tmp_path))
    assert tables.merged_pack(packs, ["a", "b"]) == {"id": "merged:a+b", "families": ("x", "y", "z"), "single_valued": ("y",), "sub_slots": {"k": ("z",)}}
    with pytest.raises(KeyError):
        tables.merged_pack(packs, ["a", "none"])
    assert model.weights_from("1,2,3")["temporal"] == 3 and model.weights_from("1,2") == model.WEIGHTS == model.weights_from("x,y,z")


def test_entity_paths(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "d"), ("a", "x"), ("x", "c"), ("q", "r")]
    edges = spark.createDataFrame(pairs + [(b, a) for a, b in pairs], "entity string, neighbour string")
    assert memory.entity_path(edges, "a", "d", checkpoint=checkpoint) == ["a", "b", "c", "d"]
    assert memory.entity_path(edges, "a", "a") == ["a"] and memory.entity_path(edges, "a", "q", 2) is None


def test_top_of_a_fusion_is_that_of_the_whole(spark):
    rng = random.Random(5)
    rows = [(i, float(rng.randint(0, 40)), float(rng.randint(0, 5))) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    weights = {"x": 0.5, "y": 0.3}
    places = {c: {r[0]: p for p, r in enumerate(sorted(rows, key=lambda r, k=k: (-r[k], r[0])), 1)} for k, c in ((1, "x"), (2, "y"))}
    score = {r[0]: round(sum(w / (60.0 + places[c][r[0]]) for c, w in weights.items()), 12) for r in rows}
    want = sorted(score, key=lambda i: (-score[i], i))[:10]
    got = rank.fused_top(df, weights, ["id"], 10).collect()
    assert [(r.id, r.score) for r in got] == [(i, score[i]) for i in want]
    assert rank.fused_top(df.limit(3), weights, ["id"], 10).count() == 3 and rank.fused_top(df.limit(0), weights, ["id"], 10).count() == 0


def test_rerank(spark):
    hits = spark.createDataFrame([("a", 3.0, "x"), ("b", 2.0, "yy"), ("c", 1.0, "zzz")], "id string, score double, text string")
    assert [r.id for r in rank.reranked(hits, "q", lambda q, texts: map(len, texts), 2).collect()] == ["b", "a", "c"]
    assert [r.id for r in rank.reranked(hits, "q", lambda q, texts: 1 / 0, 2).orderBy(F.desc("score")).collect()] == ["a", "b", "c"]


def test_briefing(spark):
    store = ingest.write(log(spark))
    store["claims"] = store["claims"].withColumn("importance", F.lit(0.5))
    told = context.briefing(store, "s1", 10**12, checkpoint, "where did I live before", ("user_fact", "user_goal"))
    assert told["digest"].first().updates == [] and {tuple(r.gaps) for r in told["world_state"].collect()} == {("user_goal",)}
    hits = told["hits"].collect()
    assert max(r.norm for r in hits) == 1.0 and all(r.tokens >= 1 for r in hits) and {r.kind for r in hits} == {"fact", "turn"}
    assert told["why"].count() == told["served"].count() == sum(r.kind == "fact" for r in hits)
    assert context.token_report(told["hits"]).first().total_tokens == sum(r.tokens for r in hits)
    assert context.reader_hint("what did you recommend") == context.HINTS["assistant_recall"] and context.reader_hint("x") == context.HINTS["fact_recall"]
    assert {r.denied for r in ingest.namespace_of(store["turns"], store["turns"], "other").collect()} == {"namespace"}
    assert views.forward(store["edges"], checkpoint).count() == 1


def test_tools_by_vectors_and_memory(spark):
    rows = [("a", "send an email", [1.0, 0.0]), ("b", "weather report", [0.0, 1.0]), ("c", "calendar of meetings", [0.7, 0.7])]
    registry = spark.createDataFrame(rows, "id string, document string, embedding array<double>")
    assert rank.tools(registry, "nothing known", vectors={"query": [0.0, 1.0]}).first().id == "b"
    got = rank.tools(registry, "send", "meetings calendar", vectors={"query": [1.0, 0.0], "memory": [0.0, 1.0]}).collect()
    place = {"query_semantic": "acb", "query_bm25": "abc", "memory_bm25": "cab", "memory_semantic": "bca", "memory_boost": "cab"}
    want = {i: round(sum(w / (61 + place[c].index(i)) for c, w in rank.TOOL_WEIGHTS.items()), 12) for i in "abc"}
    assert {r.id: r.score for r in got} == pytest.approx(want)
    claims = spark.createDataFrame([("1", "s", "likes", "tea", None, 0.2, 1, "active"), ("2", "s", "user_preference", "email", None, 0.1, 2, "active"), ("3", "s", "likes", "TEA", None, 0.9, 3, "active")], "claim_id string, session_id string, predicate string, value string, text string, importance double, created_ts long, status string")
    assert context.instruction(claims).first().instruction == "User context: email; TEA."
    assert context.instruction(claims, 20).first().instruction == "User context: email;"
    assert context.discover_tools(registry, "zzz", claims, mode="instruction").first().id == "a"


def test_entities_and_neighbours_lift_claims(spark):
    schema = "claim_id string, session_id string, subject string, predicate string, text string, status string, confidence double, source_trust double, valid_from_ts long, created_ts long"
    claims = spark.createDataFrame([(c, "s", x, "p", "word", "active", 0.5, 1.0, 1, 1) for c, x in (("a", "x"), ("b", "y"), ("c", "z"))], schema)
    names = spark.createDataFrame([("b", "alice")], "claim_id string, entity_text string")
    near = spark.createDataFrame([("c",)], "claim_id string")
    assert {"acme inc", "alice"} <= set(rank.query_names("Where does Alice work, at Acme Inc"))
    got = {r.claim_id: r.entity for r in rank.facts(claims, "where is Alice", entities=names, near=near).collect()}
    assert got == {"a": 0.0, "b": 1.0, "c": 0.6}
