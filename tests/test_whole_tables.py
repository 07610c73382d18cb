"""Registered queries use every row of their tables."""

from __future__ import annotations

import math
import random
from collections import defaultdict

from factloom.operators import context, rank, views
from factloom.plans import more, queries
from factloom.plans.queries import TOOL_ASK, registry

QUERIES = queries.QUERIES | more.QUERIES


def saved(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))


def test_entity_graph_has_every_order(spark, tmp_path):
    lines = [(1, 1), (1, 2), (2, 2), (2, 3), (3, 3), (3, 4), (4, 5), (13, 1), (13, 6), (20, 7), (20, 6), (20, 6), (21, 8), (21, 9)]
    saved(spark, tmp_path, "lineitem", lines, "l_orderkey long, l_suppkey long")
    orders = defaultdict(set)
    for order, supplier in lines:
        orders[order].add(f"s{supplier}")
    pairs = {(a, b) for x in orders.values() for a in x for b in x if a != b}
    assert sorted(map(tuple, QUERIES["n6_neighbours"](spark, str(tmp_path)).select("entity", "neighbour").collect())) == sorted(pairs)
    hops = {"s1": 0}
    for hop in (1, 2):
        hops |= {b: hop for a, b in pairs if hops.get(a) == hop - 1 and b not in hops}
    assert sorted(map(tuple, QUERIES["n6_hops"](spark, str(tmp_path)).select("entity", "hop").collect())) == sorted(hops.items())


def test_every_customer_conditions_discovery(spark, tmp_path):
    saved(spark, tmp_path, "customer", [(i, "plain" if i < 40 else "walnut") for i in range(60)], "c_custkey long, c_mktsegment string")
    parts = [(1, "plain shelf", "b", "t"), (2, "walnut shelf", "b", "t"), (3, "walnut walnut", "b", "t"), (4, "oak", "b", "t")]
    saved(spark, tmp_path, "part", parts, "p_partkey long, p_name string, p_brand string, p_type string")
    known = spark.createDataFrame([(0.5, "plain"), (0.5, "walnut")], "importance double, text string")
    want = context.discover_tools(registry(spark, str(tmp_path)), TOOL_ASK, known).collect()
    got = QUERIES["n25_discover_tools"](spark, str(tmp_path)).collect()
    assert [(r.id, r.score) for r in got] == [(r.id, round(r.score, 6)) for r in want]


def test_every_vector_is_scored_against_the_newest_of_its_group(spark, tmp_path):
    pick = random.Random(1)
    rows = [(i, 0 if i < 130 else 1, [pick.uniform(-1, 1) for _ in range(3)]) for i in range(140)] + [(140, 2, [1.0, 0.0, 0.0])]
    rows += [(200, 3, [1.0, 0.0, 0.0]), (201, 3, [0.0, 1.0, 0.0])]
    saved(spark, tmp_path, "embeddings", rows, "vec_id long, label int, embedding array<double>")

    def cosine(a, b):
        return sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))

    want = {}
    for i, group, v in rows:
        others = sorted((r for r in rows if r[1] == group and r[0] != i), reverse=True)[:100]
        best = max((round(cosine(v, r[2]), 6) for r in others), default=None)
        want[i] = (best, best is not None and best < 0.15)
    got = {r.id: (r.best, r.anomalous) for r in QUERIES["n17_anomalies"](spark, str(tmp_path)).collect()}
    assert got == want and got[140] == (None, False) and got[200] == (0.0, True)


CLAIMS = "claim_id string, session_id string, subject string, predicate string, value string, text string, source_turn_id string, status string, confidence double, source_trust double, valid_from_ts long, created_ts long"


def test_working_context_retrieves_and_packs_as_each_sessions_own_query(spark):
    claims = spark.createDataFrame([(f"c{s}{i}", f"s{s}", "berlin" if i % 3 else "tea", "user_fact", f"v{i}", f"berlin fact v{i} like tea" if i % 2 else f"v{i} other", "t", "superseded" if i == 4 else "active", i / 10, 1.0 - i / 20, i, i) for s in (1, 2) for i in range(8)], CLAIMS)
    said = {"s1": ["I live in Berlin", "my tea is cold", "updated fact v3"], "s2": ["before it was Munich", "plain words v4", " "], "s3": [" "]}
    turns = spark.createDataFrame([(f"t{s}{i}", s, x, i) for s, xs in said.items() for i, x in enumerate(xs)], "turn_id string, session_id string, text string, ts long")
    got = {r.session_id: r for r in context.working_context(claims, turns, 10, k=9, budget=20).collect()}
    for s in ("s1", "s2"):
        ask, one, own = " ".join(said[s]), claims.filter(f"session_id = '{s}'"), turns.filter(f"session_id = '{s}'")
        families = ("user_fact", "user_preference") if s == "s1" else ()
        fused = rank.fuse_memory(rank.facts(one, ask, s == "s2", None, families), rank.episodes(own, ask)).collect()
        text = {r.claim_id: r.text for r in one.collect()} | {r.turn_id: r.text for r in own.collect()}
        used, ids = 0, []
        for h in sorted(fused, key=lambda h: (-h.score, h.kind, h.id))[:9]:
            cost = max(1, len(text[h.id]) // 4)
            if used + cost <= 20:
                used, ids = used + cost, [*ids, h.id]
        assert (got[s].used, got[s].ids) == (used, ids) and ids
    assert got["s1"].entities == ["berlin"] and (got["s3"].used, got["s3"].ids) == (0, [])


def test_fusion_cuts_after_both_kinds_meet(spark):
    f = spark.createDataFrame([("s", f"c{i:02}", -float(i)) for i in range(12)], "session_id string, claim_id string, score double")
    e = spark.createDataFrame([("s", f"t{i:02}", -float(i)) for i in range(12)], "session_id string, turn_id string, score double")
    both = [(1.0 / (60 + i), "fact", f"c{i - 1:02}") for i in range(1, 13)] + [(0.9 / (60 + i), "turn", f"t{i - 1:02}") for i in range(1, 13)]
    want = {x[2] for x in sorted(both, key=lambda x: (-round(x[0], 12), *x[1:]))[:10]}
    assert {r.id for r in rank.fuse_memory(f, e, 10).collect()} == want and {x[0] for x in want} == {"c", "t"}


def test_profile_as_a_plain_loop(spark):
    long = " ".join(["word"] * 9)
    claims = [("a1", "job", "cook", 0.9, "active", 1), ("a2", "home", long, 0.85, "active", 2), ("a3", "car", "red", 0.82, "active", 3), ("b1", "city", "Rome", 0.3, "superseded", 1), ("b2", "city", "Bern", 0.4, "active", 4),
              ("p1", "user_preference", "tea", 0.5, "active", 5), ("v3", "mood", "calm", 0.7, "active", 8), ("v2", "mood", "sad", 0.1, "superseded", 7), ("v1", "mood", "glad", 0.1, "superseded", 6)]
    df = spark.createDataFrame([(i, "u", *x) for i, *x in claims], "claim_id string, subject string, predicate string, value string, importance double, status string, created_ts long")
    edges = spark.createDataFrame([("b1", "b2", 4), ("v1", "v2", 7), ("v2", "v3", 8)], "old_claim_id string, new_claim_id string, created_ts long")
    events = spark.createDataFrame([("u", 3, 5, ["a3", "p1"], 0.5)], "subject string, start_ts long, end_ts long, claim_ids array<string>, significance double")
    tiers = {1: [("[job] cook", ["a1"]), (f"[home] {long}", ["a2"]), ("[car] red", ["a3"])], 2: [("[city] Bern (previously: Rome)", ["b2"])], 3: [("[user_preference] tea", ["p1"])],
             4: [("[life_event] Changes on 1970-01-01: car -> red, user_preference -> tea", ["a3", "p1"])], 5: [("[mood] calm (changed 4 times)", ["v3"])]}
    for budget in (20, 40, 60, 100, 500):
        want, used = [], 0
        for tier, lines in tiers.items():
            for text, ids in lines:
                cost = 4 * len(text.split())
                if used + cost > budget:
                    break
                used += cost
                want.append((tier, text, ids, used))
        got = views.profile(df, edges, events, budget).collect()
        assert sorted((r.tier, r.text, r.claim_ids, r.used) for r in got) == sorted(want)
