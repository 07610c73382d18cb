"""Event frames against a plain statement of their rules: sessions one by one, turns one by one."""

from __future__ import annotations

import random
import re

from factloom.functions import text as tx
from factloom.operators import frames
from factloom.plans.queries import QUERIES, checkpoint
from factloom.sources import tables

SCHEMA = "session_id string, turn_id string, turn_index long, claim_id string, value string, entity string, confidence double"


def kind_of(text):
    counts = {k: sum(s in text.lower() for s in v) for k, v in tx.EVENT_SIGNALS.items()}
    best = max(counts.values())
    return next(k for k, n in counts.items() if n == best) if best else None


def same_event(a, b):
    topics = [{c["entity"] for c in t} - set(frames.TRIVIAL) for t in (a, b)]
    words = [[set(re.findall("[a-z0-9]+", c["value"].lower())) - set(frames.STOPS) for c in t] for t in (a, b)]
    return bool(topics[0] & topics[1]) or any(len(x & y) > 1 for x in words[0] for y in words[1])


def session_groups(turns):
    """turns: {place: claims}. Flood each event from its first turn, then move lone places."""
    home, kinds = {}, {p: kind_of(" ".join(c["value"] for c in t)) for p, t in turns.items()}
    for p in sorted(turns):
        front = [] if p in home else [p]
        while front:
            x = front.pop()
            if x not in home:
                home[x] = p
                front += [y for y in turns if abs(x - y) <= 5 and y not in home and same_event(turns[x], turns[y])]
    out = dict(home)
    for p in turns:
        if kinds[p] == "location_linked_action" and list(home.values()).count(home[p]) == 1:
            near = sorted((abs(p - y), y) for y in turns if 0 < abs(p - y) <= 3 and kinds[y] not in (None, "location_linked_action"))
            if near:
                out[p] = home[near[0][1]]
    groups = {}
    for p in sorted(turns):
        groups.setdefault(out[p], []).extend(turns[p])
    return [g for g in groups.values() if kind_of(" ".join(c["value"] for c in g))]


def plain(rows):
    sessions = {}
    for r in sorted(rows, key=lambda r: r["claim_id"]):
        sessions.setdefault(r["session_id"], {}).setdefault(r["turn_index"], []).append(r)
    return sorted((s, kind_of(" ".join(c["value"] for c in g)), tuple(c["claim_id"] for c in g), min(c["confidence"] for c in g), tuple(sorted({c["entity"] for c in g}))) for s, turns in sessions.items() for g in session_groups(turns))


def got(df):
    return sorted((r.session_id, r.event_type, tuple(r.claim_ids), r.confidence, tuple(r.participants)) for r in frames.event_frames(df, checkpoint).collect())


def test_groups_of_random_sessions(spark):
    rng, rows = random.Random(2), []
    for s in range(12):
        for i in range(rng.randint(1, 25)):
            for k in range(rng.choice([1, 1, 2])):
                value = rng.choice(tables.STORIES).replace("{n}", str(rng.randint(10, 14))).replace("{k}", "x")
                rows.append({"session_id": f"s{s}", "turn_id": f"t{s}_{i}", "turn_index": i * rng.choice([1, 1, 1]), "claim_id": f"c{s}_{i:02}_{k}", "value": value, "entity": rng.choice(["user", "user", "ann", "bob", ""]), "confidence": rng.randint(1, 9) / 10})
    want = plain(rows)
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(5)) == want and len(want) > 20


def test_registered_query_is_the_plain_loop(spark):
    rows = [r.asDict() for r in tables.stories(spark, "/root/testdata/sf0.001").collect()]
    turn = {r["claim_id"]: r["turn_id"] for r in rows}
    want = sorted((s, k, ",".join(turn[c] for c in ids), conf) for s, k, ids, conf, _ in plain(rows))
    found = QUERIES["n5_event_frames"](spark, "/root/testdata/sf0.001").collect()
    assert sorted((r.session_id, r.event_type, r.turn_ids, r.confidence) for r in found) == want and len({r.event_type for r in found}) >= 5


def test_slots(spark):
    said = {
        "bought a Sony camera from Walmart for $500 on Monday": ("Walmart", "mar", "$500", "a Sony camera"),
        "went to target and paid 20 dollars at 5 pm": ("Target", "5 pm", "20 dollars", None),
        "studied physics in May for 3 weeks": (None, "may", None, "physics in May"),
        'saw a movie titled Blue River from Ann': ("Ann", None, None, "Blue River"),
        'the book "Deep Sea" in Rome': ("Rome", None, None, "Deep Sea"),
        "scheduled a meeting with Bob in April": ("Bob", "apr", None, None),
    }
    rows = [(f"s{i}", f"t{i}", 0, f"c{i}", v, "user", 0.5) for i, v in enumerate(said)]
    found = {r.session_id: r for r in frames.event_frames(spark.createDataFrame(rows, SCHEMA), checkpoint).collect()}
    for i, (v, (place, time, money, thing)) in enumerate(said.items()):
        r = found[f"s{i}"]
        assert (r.location, (r.time_expr or "").lower() or None, r.amount, r.item) == (place, time, money, thing), v
        assert r.missing == [n for n, x in zip(("location", "time", "amount", "item"), (place, time, money, thing), strict=True) if x is None]


def test_sessions_longer_than_a_chunk(spark, monkeypatch):
    """Chains that go over the chunks' ends, and places that no claim has, give the groups of whole sessions; no pair of turns is written."""
    monkeypatch.setattr(frames, "CHUNK", 6)
    rng = random.Random(8)
    said = ["bought a walnut desk from Target", "the walnut desk cost 5 dollars", "went to Walmart near Boston", "nothing of note", "studied physics at Harvard", "studied physics again"]
    rows = [
        {"session_id": f"s{s}", "turn_id": f"t{s}_{i}", "turn_index": i, "claim_id": f"c{s}_{i:03}_{k}", "value": rng.choice(said), "entity": rng.choice(["user", "user", "ann", ""]), "confidence": rng.randint(1, 9) / 10}
        for s in range(3) for i in range(90) if rng.random() < 0.6 for k in range(rng.randint(1, 2))
    ]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)
    assert got(df) == plain(rows)
    groups = frames.connected(df, checkpoint).groupBy("session_id", "home").agg({"turn_index": "max"}).collect()
    assert any(r[2] - r.home > 12 for r in groups)
