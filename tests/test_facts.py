from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import bursts, facts, frames, memory, semantic, slots, views
from factloom.plans.queries import checkpoint
from factloom.sources import tables

SCHEMA = "session_id string, subject string, predicate string, claim_id string, value string, source_turn_id string, speaker string, source_trust double, created_ts long"


def rows(*said, predicate="user_fact"):
    """(value, speaker[, turn[, trust]])"""
    out = []
    for i, (value, speaker, *rest) in enumerate(said):
        turn = rest[0] if rest else f"t{i}"
        trust = rest[1] if len(rest) > 1 else {"user": 1.0, "assistant": 0.5}[speaker]
        out.append(dict(session_id="s", subject="user", predicate=predicate, claim_id=f"c{i}", value=value, source_turn_id=turn, speaker=speaker, source_trust=trust, created_ts=i))
    return out


def kinds(said, single=False):
    return [x["edge_type"] for x in slots.fold_slot(rows(*said), single)[1]]


@pytest.mark.parametrize(
    ("said", "want"),
    [
        ([("has two kids", "user"), ("has three kids", "user")], ["user_correction"]),
        ([("has two kids", "user"), ("has three kids", "assistant")], ["assistant_confirm"]),
        ([("has two kids", "user", "t"), ("has three dogs", "user", "t")], []),
        ([("likes coffee", "user"), ("likes coffee", "user")], []),
        ([("lives in Toronto Canada", "user"), ("favorite color is blue", "user")], []),
        ([("takes medication daily morning", "user"), ("takes medication daily night", "user")], ["user_correction"]),
        ([("favorite city Portland", "user"), ("favorite city Seattle", "user")], ["user_correction"]),
        ([("likes pizza", "user"), ("likes sushi", "user")], []),
        ([("lives in Toronto", "user"), ("lives in Vancouver", "user")], ["user_correction"]),
        ([("lives in Seattle", "assistant"), ("lives in Portland", "user")], ["contradicts"]),
        ([("lives in Portland", "user"), ("lives in Denver", "user", "t9", 0.35)], ["blocked"]),
        ([("lived in NYC from 2010 to 2015", "user"), ("lives in Boston", "user")], []),
        ([("walks the big dog daily", "user"), ("walks big dog", "user")], ["refines"]),
    ],
)
def test_rules(said, want):
    assert kinds(said) == want


def test_restated_values_retire_the_newest_first():
    found = slots.fold_slot(rows(("A", "user"), ("A", "user"), ("B", "user"), ("B", "user")), True)[1]
    assert [(x["new_claim_id"], x["old_claim_id"]) for x in found] == [("c2", "c1"), ("c3", "c0")]


def test_fold_in_spark_equals_fold_of_each_slot(spark):
    rng, all_rows, want = random.Random(1), [], []
    for s in range(6):
        said = [(rng.choice(["x y z", "x y w", "lives in A", "lives in B", "two cats here", "three cats here", "q"]), rng.choice(["user", "assistant"])) for _ in range(12)]
        own = [dict(r, session_id=f"s{s}", claim_id=f"s{s}{r['claim_id']}", predicate="one" if s % 2 else "many") for r in rows(*said)]
        want += [(x["old_claim_id"], x["new_claim_id"], x["edge_type"]) for x in slots.fold_slot(own, s % 2 == 1)[1]]
        all_rows += own
    rng.shuffle(all_rows)
    df = spark.createDataFrame(all_rows, SCHEMA)
    got = facts.supersede(df.repartition(3), ("one",)).collect()
    assert sorted((r.old_claim_id, r.new_claim_id, r.edge_type) for r in got) == sorted(want)
    done = facts.with_status(df, facts.supersede(df, ("one",)))
    retired = {a for a, _, k in want if k not in ("blocked", "contradicts")}
    assert {r.claim_id for r in done.filter("status = 'superseded'").collect()} == retired


def test_cardinality_form_equals_fold_without_repeats(spark):
    said = [(str(v), "user") for v in (1, 2, 3, 1, 4)]
    df = spark.createDataFrame(rows(*said), SCHEMA)
    lead = {(r.old_claim_id, r.new_claim_id) for r in facts.edges_of(facts.cardinality_validity(df)).collect()}
    assert lead == {(x["old_claim_id"], x["new_claim_id"]) for x in slots.fold_slot(rows(*said), True)[1]}


def test_lineage(spark):
    edges = spark.createDataFrame([(f"c{i}", f"c{i + 1}", i) for i in range(9)] + [("x", "y", 1)], "old_claim_id string, new_claim_id string, created_ts long")
    got = {r.claim_id: (r.origin, r.depth) for r in views.lineage(edges, checkpoint).collect()}
    assert got == {**{f"c{i}": ("c0", i) for i in range(1, 10)}, "y": ("x", 1)}


@pytest.mark.parametrize("most", [1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 17, 31, 33, 40])
def test_lineage_of_one_chain(spark, most):
    """A chain alone: the number of edges is the length of the longest chain."""
    edges = spark.createDataFrame([(f"{i:02}", f"{i + 1:02}", i) for i in range(most)], "old_claim_id string, new_claim_id string, created_ts long")
    assert {r.claim_id: (r.origin, r.depth) for r in views.lineage(edges, checkpoint).collect()} == {f"{i:02}": ("00", i) for i in range(1, most + 1)}


def test_lineage_of_chains_of_every_length(spark):
    """Chains of 1 to 40 edges beside each other and beside a circle."""
    rows = [(f"{n:02}-{i:02}", f"{n:02}-{i + 1:02}", i) for n in range(1, 41) for i in range(n)] + [("p", "q", 1), ("q", "r", 2), ("r", "p", 3)]
    edges = spark.createDataFrame(rows, "old_claim_id string, new_claim_id string, created_ts long")
    want = {f"{n:02}-{i:02}": (f"{n:02}-00", i) for n in range(1, 41) for i in range(1, n + 1)} | {"q": ("p", 1), "r": ("p", 2)}
    assert {r.claim_id: (r.origin, r.depth) for r in views.lineage(edges, checkpoint).collect()} == want


@pytest.mark.parametrize("loop", [["a", "b"], list("bcdea")])
def test_lineage_cuts_circles(spark, loop):
    ring = [(x, y, 1) for x, y in zip(loop, [*loop[1:], loop[0]], strict=True)]
    tail = [(loop[0], "t1", 5), ("t1", "t2", 6)]
    edges = spark.createDataFrame(ring + tail + [("x", "y", 1)], "old_claim_id string, new_claim_id string, created_ts long")
    up = {new: old for old, new, _ in ring + tail + [("x", "y", 1)] if new != min(loop)}
    want = {}
    for claim in up:
        at, steps = claim, 0
        while at in up:
            at, steps = up[at], steps + 1
        want[claim] = (at, steps)
    assert {r.claim_id: (r.origin, r.depth) for r in views.lineage(edges, checkpoint).collect()} == want


def test_long_chains_have_no_cap(spark):
    edges = spark.range(0, 300).selectExpr("cast(id as string) as old_claim_id", "cast(id + 1 as string) as new_claim_id", "id as created_ts")
    last = views.lineage(edges, checkpoint).filter("claim_id = '300'").first()
    assert (last.origin, last.depth) == ("0", 300)


def test_append_refuses_taken_doubled_and_missing_keys(spark):
    old, new = spark.createDataFrame([("a", 1)], "id string, n long"), spark.createDataFrame([("a", 2), ("b", 3), ("b", 4), ("c", 5), (None, 6)], "id string, n long")
    good, bad = tables.validated_append(old, new, "id")
    assert [r.n for r in good.collect()] == [5] and sorted(r.n for r in bad.collect()) == [2, 3, 4, 6] and good.columns == new.columns


def test_validation_and_insert(spark):
    schema = "claim_id string, subject string, predicate string, value string, text string, confidence double, char_start int, char_end int, turn_length int, created_ts long, valid_from_ts long, source_type string, speaker string"
    data = [("a", "My Dog", "user_fact", "barks", None, 0.5, 0, 3, 10, None, None, "conversation", "user"), ("b", "x", "", "v", None, 0.5, None, None, 9, None, None, "browser", "user"),
            ("c", None, None, None, "Alice went to Berlin", 0.9, None, None, 9, None, None, "browser", "user"), ("d", None, None, None, " ", 2.0, 5, 2, 9, None, None, "browser", "user"),
            ("e", "x", "unheard_of", "v", None, 0.5, None, None, 9, None, None, "tool_call", "user")]
    good, bad = facts.validate(spark.createDataFrame(data, schema))
    assert {r.claim_id: r.failures for r in bad.collect()} == {"b": ["triple"], "d": ["text", "confidence", "span"]}
    out = facts.insert(good, ("user_fact",), F.lit(7).cast("long"))
    claims = {r.claim_id: r for r in out["claims"].collect()}
    assert claims["a"].subject == "my_dog" and claims["a"].text == "my_dog user_fact barks" and claims["a"].valid_from_ts == 7
    assert claims["e"].subject is None and claims["e"].text == "x unheard_of v"
    meta = {r.claim_id: r for r in out["metadata"].collect()}
    assert meta["c"].entity_key == "berlin" and meta["c"].predicate_family == "nl" and meta["c"].source_trust == 0.35
    assert {(r.claim_id, r.entity_text) for r in out["entities"].collect()} >= {("c", "berlin"), ("c", "alice")}


def test_signals(spark):
    day = 86400 * 10**9
    for age, want in ((0, 0.655000), (30, 0.585182), (180, 0.655372)):
        c = spark.createDataFrame([("c", "s", "u", "p", 0.9, 0, "active")], "claim_id string, session_id string, subject string, predicate string, confidence double, created_ts long, status string")
        e = spark.createDataFrame([], "old_claim_id string, new_claim_id string")
        assert views.importance(c, e, F.lit(age * day)).first().importance == pytest.approx(want, abs=1e-6)
    for (imp, acc, age, conf), want in {(0.5, 0, 0, 0.9): 0.49, (0.5, 3, 90, 0.9): 0.54, (0.2, 0, 400, 0.3): 0.1467}.items():
        got = spark.range(1).select(views.utility(*[F.lit(float(x)) for x in (imp, acc, age, conf)]).alias("u")).first().u
        assert got == pytest.approx(want, abs=1e-4)


def slow_bursts(items, window, least):
    items, out, i = sorted(items), [], 0
    while i < len(items):
        group = list(itertools.takewhile(lambda x: x[0] <= items[i][0] + window, items[i:]))
        if len({x[2] for x in group}) >= least:
            out.append([x[1] for x in group])
            i += len(group)
        else:
            i += 1
    return out


def test_bursts(spark):
    rng = random.Random(3)
    items = [(rng.randrange(400), f"c{i:03}", rng.choice("abcd")) for i in range(120)]
    df = spark.createDataFrame([("u", *x) for x in items], "subject string, created_ts long, claim_id string, predicate string")
    got = [r.claim_ids for r in bursts.bursts(df, checkpoint, 9, 3).orderBy("start_ts").collect()]
    assert got == slow_bursts(items, 9, 3)
    starts = {r.claim_id for r in memory.burst_candidates(df, 9, 3).collect()}
    assert {g[0] for g in got} <= starts


def test_head_by_claim_or_slot(spark):
    claims = spark.createDataFrame([("a", "u", "p", "superseded", 1), ("b", "u", "p", "superseded", 2), ("c", "u", "p", "active", 3), ("x", "u", "q", "active", 1), ("y", "u", "p", "superseded", 1)], "claim_id string, subject string, predicate string, status string, created_ts long")
    edges = spark.createDataFrame([("a", "b", 2), ("b", "c", 3), ("y", "b", 2)], "old_claim_id string, new_claim_id string, created_ts long")
    for given in ({"claim_id": "a"}, {"claim_id": "c"}, {"slot": ("u", "p")}):
        got = [(r.head, r.step, r.claim_id) for r in views.head_of(claims, edges, checkpoint, **given).collect()]
        assert got[:2] == [("c", 0, "c"), ("c", 1, "b")] and sorted(got[2:]) == [("c", 2, "a"), ("c", 2, "y")]
    assert [r.claim_id for r in views.head_of(claims, edges, checkpoint, slot=("u", "q")).collect()] == ["x"]
    assert views.head_of(claims, edges, checkpoint, claim_id="none").count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_bursts_of_busy_and_quiet_subjects(spark, seed):
    """Ties, a subject that is never quiet, long gaps, windows of several lengths."""
    rng = random.Random(seed)
    items = {s: [(rng.randrange(-50, span), f"{s}{i:03}", rng.choice(kinds)) for i in range(n)] for s, span, n, kinds in (("a", 60, 150, "abcd"), ("b", 900, 150, "abc"), ("c", 30, 3, "abc"), ("d", 3, 40, "abcdefg"), ("e", 200, 60, "ab"))}
    df = spark.createDataFrame([(s, *x) for s, own in items.items() for x in own], "subject string, created_ts long, claim_id string, predicate string").repartition(3)
    for window, least in ((7, 3), (40, 2)):
        got = {}
        for r in bursts.bursts(df, checkpoint, window, least).orderBy("start_ts", F.col("claim_ids")[0]).collect():
            got.setdefault(r.subject, []).append(r.claim_ids)
        assert got == {s: x for s, own in items.items() if (x := slow_bursts(own, window, least))}


def test_few_hits_of_a_cost_can_be_packed(spark):
    rng = random.Random(4)
    hits = [(f"s{i % 3}", f"h{i:03}", round(rng.random(), 2), "x" * rng.randrange(0, 90)) for i in range(400)] + [("big", "b", 1.0, "x" * 999)]
    df = spark.createDataFrame(hits, "session_id string, id string, score double, text string")
    want = {}
    for s, i, score, text in sorted(hits, key=lambda h: (-h[2], h[1])):
        used, ids = want.setdefault(s, (0, []))
        cost = max(1, len(text) // 4)
        if used + cost <= 60:
            want[s] = (used + cost, [*ids, i])
    assert {r.session_id: (r.used, r.ids) for r in memory.packed_context(df, 60).collect()} == want


def test_anomalies_of_a_group_in_many_tasks(spark, monkeypatch):
    rng = random.Random(6)
    rows = [("hot" if i % 3 else f"g{i % 7}", i, [rng.uniform(-1, 1) for _ in range(3)]) for i in range(200)] + [("one", 900, [1.0, 0.0, 0.0]), ("odd", 901, [0.0, 0.0, 0.0]), ("odd", 902, [1.0, 1.0]), (None, 903, [1.0, 0.0, 0.0]), ("hot", 904, None)]
    df = spark.createDataFrame(rows, "group string, id long, embedding array<double>")
    whole = {r.id: (r.best, r.anomalous) for r in memory.anomalies(df, df, 0.9, 20).collect()}
    monkeypatch.setattr(memory, "SCORED", 10)
    assert {r.id: (r.best, r.anomalous) for r in memory.anomalies(df, df, 0.9, 20).collect()} == whole and len(whole) == len(rows)
    assert whole[900] == (None, False) and whole[901] == (0.0, True) and whole[903] == (None, False) and whole[904] == (0.0, True)


def test_forget_leaves_nothing(spark):
    claims = spark.createDataFrame([("a1", "s", "alice", "likes Tea", "t1"), ("a2", "s", "alice", "runs", "t2"), ("b1", "s", "bob", "swims", "t2")], "claim_id string, session_id string, subject string, value string, source_turn_id string")
    store = {
        "claims": claims,
        "turns": spark.createDataFrame([("t1", "alice likes tea"), ("t2", "alice RUNS, bob swims")], "turn_id string, text string"),
        "edges": spark.createDataFrame([("a1", "a2"), ("b1", "b1")], "old_claim_id string, new_claim_id string"),
        "sentences": spark.createDataFrame([("x", ["a1", "b1"]), ("y", ["b1"])], "sentence_id string, source_claim_ids array<string>"),
        "life_events": spark.createDataFrame([("l", ["a2"])], "event_id string, claim_ids array<string>"),
    }
    out = memory.forget(store, claims.filter("subject = 'alice'").select("claim_id"), 5)
    assert [r.claim_id for r in out["claims"].collect()] == ["b1"]
    assert [tuple(r) for r in out["turns"].collect()] == [("t2", "alice [redacted], bob swims")]
    assert out["edges"].count() == 1 and [r.sentence_id for r in out["sentences"].collect()] == ["y"] and out["life_events"].count() == 0
    assert out["decisions"].count() == 2


def test_event_frames(spark):
    said = ["bought a Sony camera from Walmart", "the Sony camera cost $500", "nothing at all", "studied physics at Harvard in 3 weeks"]
    df = spark.createDataFrame([("s", f"t{i}", i, f"c{i}", v, "user", 0.5 + i / 10) for i, v in enumerate(said)], "session_id string, turn_id string, turn_index long, claim_id string, value string, entity string, confidence double")
    got = {r.event_type: r for r in frames.event_frames(df, checkpoint).collect()}
    buy = got["purchase_redemption"]
    assert buy.claim_ids == ["c0", "c1"] and buy.item == "a Sony camera" and buy.amount == "$500" and buy.location == "Walmart" and buy.confidence == 0.5
    assert got["education_milestone"].item == "physics" and got["education_milestone"].time_expr == "3 week"


def test_semantic_supersession(spark):
    v = {0: [1.0, 0.0], 1: [0.9, 0.1], 2: [0.0, 1.0], 3: [0.95, 0.05]}
    df = spark.createDataFrame([("g", k, k, f"t{k}", x) for k, x in v.items()], "group string, id long, ts long, turn string, embedding array<double>")
    assert sorted((r.old_id, r.new_id) for r in semantic.within_groups(df, checkpoint).collect()) == [(0, 1), (1, 3)]


def test_hops(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "b"), ("c", "d"), ("d", "c")], "entity string, neighbour string")
    got = {r.entity: r.hop for r in memory.within_hops(e, spark.createDataFrame([("a",)], "entity string"), 2).collect()}
    assert got == {"a": 0, "b": 1, "c": 2}


def test_forgotten_values_of_any_characters(spark):
    values = ["été", r"a\Eb.c", "x.*", "$1", "\\"]
    claims = spark.createDataFrame([(f"c{i}", "s", "t1", v, i) for i, v in enumerate(values)] + [("k", "s", "t1", "stays", 9)], "claim_id string, session_id string, source_turn_id string, value string, created_ts long")
    turns = spark.createDataFrame([("t1", "s", "ÉTÉ | A\\eB.c | a\\Ebxc | x.* | xyz | $1 | stays")], "turn_id string, session_id string, text string")
    out = memory.forget({"claims": claims, "turns": turns}, claims.filter("claim_id != 'k'").select("claim_id"), 5)
    assert [r.text for r in out["turns"].collect()] == ["[redacted] | [redacted] | a[redacted]Ebxc | [redacted] | xyz | [redacted] | stays"]
