from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from factloom.operators import memory, rank
from factloom.sources import tables as src

DOCS = [("d0", "cat user_fact sat on the mat"), ("d1", "dog user_fact played in the park"), ("d2", "cat user_fact chased a mouse")]


@pytest.mark.parametrize(("query", "want"), [("cat mat", [1.421752, 0.0, 0.490051]), ("cat cat mat", [1.882334, 0.0, 0.980102])])
def test_bm25(spark, query, want):
    rows = rank.bm25(spark.createDataFrame(DOCS, "id string, text string"), query).orderBy("id").collect()
    assert [r.bm25 for r in rows] == pytest.approx(want, abs=1e-6)


def test_ranks_are_ordinal(spark):
    df = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2), ("c", 0.9, 3)], "id string, s double, ts long")
    got = {r.id: r.score for r in rank.fused(df.withColumn("p", F.lit(0)), {"s": 1.0}, "p", ["ts"]).collect()}
    assert got == pytest.approx({"c": 1 / 61, "a": 1 / 62, "b": 1 / 63})


def test_fusion_weights(spark):
    f = spark.createDataFrame([("s", "f1", 2.0), ("s", "f2", 1.0)], "session_id string, claim_id string, score double")
    e = spark.createDataFrame([("s", "t1", 9.0), ("s", "t2", 8.0)], "session_id string, turn_id string, score double")
    got = {r.id: round(r.score, 8) for r in rank.fuse_memory(f, e).collect()}
    assert got == {"f1": 0.01639344, "f2": 0.01612903, "t1": 0.01475410, "t2": 0.01451613}


def test_across_keeps_each_session(spark):
    df = spark.createDataFrame([(f"s{s}", "turn", f"t{s}{i}", 1 / (61 + i)) for s in range(8) for i in range(3)], "session_id string, kind string, id string, score double")
    assert rank.across(df, 3).count() == 24
    two = df.filter("session_id in ('s0', 's1')")
    assert rank.across(two, 6).count() == 6


def test_partitioning_makes_no_difference(spark):
    turns = spark.createDataFrame([(f"t{i}", f"s{i % 3}", f"word{i % 4} the cat {i}", i) for i in range(40)], "turn_id string, session_id string, text string, ts long")
    want = sorted(map(tuple, rank.episodes(turns, "the cat word1").select("turn_id", "score").collect()))
    for n in (1, 7):
        assert sorted(map(tuple, rank.episodes(turns.repartition(n), "the cat word1").select("turn_id", "score").collect())) == want


def test_another_namespace_changes_nothing(spark):
    one = spark.createDataFrame([(f"t{i}", "s1", f"the cat {i}", i) for i in range(5)], "turn_id string, session_id string, text string, ts long")
    other = spark.createDataFrame([(f"x{i}", "s2", "the the cat", i) for i in range(5)], one.schema)
    a = sorted(map(tuple, rank.episodes(one, "cat 3").select("turn_id", "score").collect()))
    b = sorted(map(tuple, rank.episodes(one.union(other), "cat 3").filter("session_id = 's1'").select("turn_id", "score").collect()))
    assert a == b


def test_demoted_claims_take_part_in_ranks(spark):
    schema = "claim_id string, session_id string, subject string, predicate string, text string, status string, confidence double, source_trust double, valid_from_ts long, created_ts long, demoted boolean"
    df = spark.createDataFrame([("a", "s", "x", "p", "the cat", "active", 0.9, 1.0, 1, 1, True), ("b", "s", "y", "p", "dog", "active", 0.5, 1.0, 2, 2, False)], schema)
    both = {r.claim_id: r.score for r in rank.facts(df.drop("demoted"), "cat").collect()}
    kept = {r.claim_id: r.score for r in rank.facts(df, "cat").collect()}
    assert kept == {"b": both["b"]}


@pytest.mark.parametrize(("q", "days"), [("last 3 days", (3, 0)), ("past month", (30, 0)), ("2 weeks ago", (14, 7)), ("yesterday", (1, 0)), ("nothing", None)])
def test_temporal_scope(q, days):
    now = 1_700_000_000 * 10**9
    got = rank.temporal_scope(q, now)
    assert got == (None if days is None else tuple(now - d * 86400 * 10**9 for d in days))


def test_packed_context_skips(spark):
    df = spark.createDataFrame([("s", "a", 3.0, "x" * 40), ("s", "b", 2.0, "x" * 400), ("s", "c", 1.0, "x" * 20)], "session_id string, id string, score double, text string")
    assert memory.packed_context(df, 20).first().ids == ["a", "c"]


def test_tools_and_upsert(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"tools": [{"name": "send_email", "description": "send an email to a person"}, {"name": "weather", "inputSchema": {"a": 1}}]}')
    rows = src.tools_from_json(spark, str(tmp_path / "t.json"), "srv")
    assert {r.id for r in rows.collect()} == {"mcp:srv:send_email", "mcp:srv:weather"}
    docs = rows.select("id", rank.tool_document(F.col("name"), F.col("description"), F.col("server"), F.lit(None)).alias("document"))
    assert rank.tools(docs, "send an email to my teammate").first().id == "mcp:srv:send_email"
    old = spark.createDataFrame([("a", "x", 1)], "id string, name string, created_at long")
    new = spark.createDataFrame([("a", "y", 2), ("b", "z", 3)], old.schema)
    assert sorted(map(tuple, src.upsert(old, new).collect())) == [("a", "y", 1), ("b", "z", 3)]


@pytest.mark.parametrize(("text", "ns"), [("1700000000", 1700000000 * 10**9), ("1700000000000", 1700000000 * 10**9), ("2024-01-02", 1704153600 * 10**9), ("01/02/2024", 1704153600 * 10**9), ("2024-01-02T00:00:01Z", 1704153601 * 10**9), ("x", None)])
def test_timestamps(spark, text, ns):
    assert spark.createDataFrame([(text,)], "t string").select(src.parse_timestamp(F.col("t")).alias("n")).first().n == ns


def test_document_turns_and_vectors(spark):
    docs = spark.createDataFrame([("d", "u1", "2024-01-02", "ctx", [("user", "hi"), ("assistant", "yo")], None), ("e", None, "2024-01-02", None, [], "body")], "id string, user_id string, timestamp string, context string, messages array<struct<role:string,content:string>>, content string")
    got = {r.turn_id: (r.speaker, r.text, r.namespace) for r in src.document_turns(docs).collect()}
    assert got == {"doc:d:0": ("user", "Document context: ctx\nUser turn: hi", "u1"), "doc:d:1": ("assistant", "Assistant turn: yo", "u1"), "doc:e:0": ("user", "Document turn: body", "default")}
    v = spark.createDataFrame([([1.0, 2.5],), (None,)], "e array<float>")
    assert [r.x for r in v.select(src.decode_vector(src.encode_vector("e")).alias("x")).collect()] == [[1.0, 2.5], None]


SHAPES = {
    "[]": ["user|Document turn: []"],
    "[1, 2]": ["user|User turn: 1", "user|User turn: 2"],
    '{"turns": "no list"}': ['user|Document turn: {"turns": "no list"}'],
    '{"turns": {"a": 1}, "conversation": ["hi", null, " ", "yo"]}': ["user|User turn: hi", "user|User turn: yo"],
    '{"messages": [], "turns": ["unread"]}': ['user|Document turn: {"messages": [], "turns": ["unread"]}'],
    '{"messages": [{"speaker": " Bot ", "text": "a"}, {"role": "TOOL", "content": "b"}, {"role": "", "speaker": "model", "value": "c"}, {"role": "guest", "message": "d"}, {"role": 7, "utterance": "e"}]}':
        ["assistant|Assistant turn: a", "system|System turn: b", "assistant|Assistant turn: c", "user|User turn: d", "user|User turn: e"],
    '[{"content": [{"text": "x"}, {"text": "", "content": "y"}, {"image": 1}, "z", "  "]}, {"content": 5, "text": "t"}, {"b": 1, "a": "q"}]':
        ["user|User turn: x\ny\nz", "user|User turn: t", 'user|User turn: {"a":"q","b":1}'],
    '["", "later"]': ["user|User turn: later"],
    "not [json": ["user|Document turn: not [json"],
    " \u00a0 padded \u2003 ": ["user|Document turn: padded"],
    "": ["user|Document turn: "],
}


def test_session_shapes(spark):
    rows = [(str(i), None, None, None, x, "other") for i, x in enumerate(SHAPES)] + [("none", None, "never", None, None, None)]
    schema = "id string, user_id string, timestamp string, context string, content string, turn_id string"
    got = {}
    for r in src.document_turns(spark.createDataFrame(rows, schema)).collect():
        got.setdefault(r.session_id, []).append((int(r.turn_id.split(":")[2]), f"{r.speaker}|{r.text}"))
    assert {k: [x for _, x in sorted(v)] for k, v in got.items()} == {str(i): x for i, x in enumerate(SHAPES.values())} | {"none": ["user|Document turn: "]}


def test_messages_before_content_and_times(spark):
    long = [{"role": "user", "content": f"m{i}"} for i in range(2000)]
    rows = [("a", "u", "1704067200", "  about \n", '["unread"]', json.dumps(long)), ("b", "u", "x", "about", '["read"]', "no list"), ("c", "u", "1704067200", "about", "the text", "[]"), ("d", "u", "1704067200", "about", None, '[" ", "second"]')]
    got = {r.turn_id: r for r in src.document_turns(spark.createDataFrame(rows, "id string, user_id string, timestamp string, context string, content string, messages string")).collect()}
    assert len(got) == 2003 and got["doc:a:0"].text == "Document context: about\nUser turn: m0" and got["doc:a:1999"].text == "User turn: m1999"
    assert got["doc:a:1999"].ts == (1704067200 + 1999) * 10**9 and got["doc:b:0"].ts is None and got["doc:b:0"].text == "Document context: about\nUser turn: read"
    assert got["doc:c:0"].text == "Document context: about\nDocument turn: the text" and got["doc:d:0"].text == "User turn: second"  # the context goes with the first message, blank or not
    assert src.document_turns(spark.createDataFrame([], "id string, user_id string, timestamp string, context string, content string, messages array<string>")).count() == 0


def test_time_scopes_of_a_column(spark):
    now = 1_706_745_600 * 10**9
    asks = ["what did I say in the last 3 days", "past 2 weeks", "last month", "over the past year", "Yesterday I", "this week", "4 weeks ago", "1 day ago", "0 days ago", "2 months ago", "nothing", "last 99 month", "", "the last  12   days and yesterday"]
    got = {r.q: (r.s.since, r.s.until) if r.s else None for r in spark.createDataFrame([(x,) for x in asks], "q string").select("q", rank.scope_of(F.col("q"), now).alias("s")).collect()}
    assert got == {x: rank.temporal_scope(x, now) for x in asks}
