from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from factloom.operators import context, rank, memory, views

CLAIMS = "claim_id string, session_id string, subject string, predicate string, value string, text string, source_turn_id string, status string, confidence double, source_trust double, valid_from_ts long, valid_until_ts long, created_ts long"


def store(spark):
    rows = [("c1", "s1", "user", "user_fact", "Berlin", "user user_fact Berlin", "t1", "superseded", 0.9, 1.0, 1, 2, 1), ("c2", "s1", "user", "user_fact", "Munich", "user user_fact Munich", "t2", "active", 0.9, 1.0, 2, None, 2),
            ("c3", "s2", "user", "user_preference", "tea", "user user_preference tea", "t3", "active", 0.5, 0.35, 3, None, 3)]
    turns = [("t1", "s1", "user", "I live in Berlin", 1, "a"), ("t2", "s1", "user", "I live in Munich now", 2, "a"), ("t3", "s2", "user", "I like tea", 3, "b")]
    return spark.createDataFrame(rows, CLAIMS), spark.createDataFrame(turns, "turn_id string, session_id string, speaker string, text string, ts long, namespace string")


def test_past_is_served_only_if_asked_for(spark):
    claims, turns = store(spark)
    now = {r.id for r in context.answer(claims, turns, "where do I live", 10).hits.collect()}
    past = {r.id for r in context.answer(claims, turns, "where did I live previously", 10).hits.collect()}
    assert "c1" not in now and {"c1", "c2"} <= past


def test_untrusted_hits_are_quarantined_and_served_ones_logged(spark):
    claims, turns = store(spark)
    a = context.answer(claims, turns, "tea", 10)
    assert {r.id for r in a.hits.filter("quarantined").collect()} == {"c3"}
    cited = spark.createDataFrame([("s2", "c3"), ("s1", "c3")], "session_id string, claim_id string")
    assert {(r.session_id, r.verified) for r in memory.verified(cited, a.served).collect()} == {("s2", True), ("s1", False)}


def test_as_of(spark):
    claims, _ = store(spark)
    for t, want in ((1, {"c1"}), (2, {"c2"}), (3, {"c2", "c3"}), (0, set())):
        assert {r.claim_id for r in views.as_of(claims, F.lit(t)).collect()} == want


def test_namespace(spark):
    claims, turns = store(spark)
    assert {r.claim_id for r in views.in_namespace(claims, turns, "b").collect()} == {"c3"}


def test_explained(spark):
    claims, turns = store(spark)
    edges = spark.createDataFrame([("c1", "c2", 2)], "old_claim_id string, new_claim_id string, created_ts long")
    got = {r.claim_id: (r.quote, r.replaced_by) for r in context.explained(claims, turns, edges).collect()}
    assert got == {"c1": ("Berlin", "c2"), "c2": ("Munich", None), "c3": ("tea", None)}


def test_consolidation(spark):
    def run(values):
        df = spark.createDataFrame([(f"c{i}", f"s{i}", "u", "p", v, i, 0.5) for i, v in enumerate(values)], "claim_id string, session_id string, subject string, predicate string, value string, created_ts long, importance double")
        groups = views.consolidate(df, 3)
        return groups.collect(), views.demoted(df, groups).count()

    found, gone = run(["coffee"] * 3)
    assert found[0].canonical == "c0" and found[0].importance == 0.9 and gone == 2
    assert run(["berlin", "berlin", "munich"]) == ([], 0)


@pytest.mark.parametrize(("days", "changes", "stale"), [(100, 0, False), (400, 0, True), (30, 3, True), (30, 2, False)])
def test_staleness(spark, days, changes, stale):
    claims = spark.createDataFrame([(f"c{i}", "u", "p", "active" if i == changes else "superseded", 0) for i in range(changes + 1)], "claim_id string, subject string, predicate string, status string, created_ts long")
    edges = spark.createDataFrame([(f"c{i}", f"c{i + 1}") for i in range(changes)], "old_claim_id string, new_claim_id string")
    assert [r.stale for r in views.staleness(claims, edges, F.lit(days * 86400 * 10**9)).collect()] == [stale]


def test_hooks_and_replies(spark):
    calls = spark.createDataFrame([("Bash", "ls -la"), ("Bash", "make test"), ("Read", ""), ("memory_store", ""), (None, "")], "tool string, command string")
    assert [r.x for r in calls.select(context.skipped_hook(F.col("tool"), F.col("command")).alias("x")).collect()] == [True, False, True, True, True]
    assert spark.range(1).select(context.hook_keywords(F.lit("import the Parser from parser_tests of Foo bar bazz qux quux")).alias("x")).first().x == "Parser parser_tests Foo bar bazz"
    replies = ['[{"subject":"u","predicate":"p","value":"v","confidence":0.5}]', '{"claims":[{"subject":"u","predicate":"p","value":"w"}]}', '{"subject":"u","predicate":"p","value":"z"}', "oops", '[{"subject":"","predicate":"p","value":"v"}]']
    df = spark.createDataFrame([(r,) for r in replies], "raw string")
    assert [[c.value for c in r.x] for r in df.select(context.parsed_claims(F.col("raw")).alias("x")).collect()] == [["v"], ["w"], ["z"], [], []]


def test_citations(spark):
    s = spark.createDataFrame([("a", ["c1", "c2"]), ("b", ["zz"]), ("c", [])], "sentence_id string, source_claim_ids array<string>")
    claims, _ = store(spark)
    good, bad = context.cited_sentences(s, claims)
    assert [r.sentence_id for r in good.collect()] == ["a"] and {r.sentence_id for r in bad.collect()} == {"b", "c"}
    assert [(r.sentence_id, r.source_turn_id) for r in context.sentence_turn(s, claims).collect()] == [("a", "t1")]


def test_expanded_and_fallback(spark):
    claims, turns = store(spark)
    assert context.expanded(claims, "Munich").first().claim_id in {"c2", "c3"}
    from factloom.operators import rank

    got = context.with_fallback(rank.facts(claims, "tea"), rank.episodes(turns, "tea"))
    assert {(r.kind, r.id) for r in got.collect()} == {("fact", "c2"), ("fact", "c3"), ("turn", "t1")}


def test_modes_of_tool_conditioning(spark):
    tools = spark.createDataFrame([(1, "name: oak shelf"), (2, "name: tax report"), (3, "name: sail boat"), (4, "name: plain thing")], "id long, document string")
    claims = spark.createDataFrame([("s2", "c9", "sail", "active", 0.9, 1), ("s1", "c1", "files tax reports", "active", None, 1), ("s1", "c2", "oak", "superseded", 0.9, 2)], "session_id string, claim_id string, value string, status string, importance double, created_ts long")
    entities = spark.createDataFrame([("c1", "report")], "claim_id string, entity_text string")
    terms = {r.session_id: r.terms for r in context.structured_terms(claims, entities).collect()}
    assert terms == {"s1": ["files", "report", "reports", "tax"], "s2": ["sail"]}
    told = lambda df: [(r.id, r.score) for r in df.collect()]
    assert told(context.discover_tools(tools, "thing", claims, 4, "structured", entities=entities)) == told(rank.tools(tools, "thing", "files report reports tax", 4))
    hits = spark.createDataFrame([("fact", "a", 0.5, "the sail of my boat"), ("turn", "b", 0.9, "a boat and it")], "kind string, id string, score double, text string")
    assert context.retrieved_terms(hits) == ["boat", "sail"]
    assert told(context.discover_tools(tools, "thing", hits, 4, "retrieved")) == told(rank.tools(tools, "thing", "boat sail", 4))
    assert [r.id for r in context.discover_tools(tools, "thing", claims.limit(0), 1, "structured").collect()] == [4]
