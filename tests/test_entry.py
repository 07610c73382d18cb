from __future__ import annotations

import duckdb
import pytest

import __spark_entry__
from factloom.operators import facts
from factloom.sources import store as st
from factloom.streaming import stream

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUICK = ["b1_admission", "c15_projection", "d1a_cardinality_validity", "d12_lineage", "f8_importance", "g5_burst_candidates", "j11_hybrid", "j12_episodes", "n15_forget", "n23_tools"]


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as from '{SF}/{t}.parquet'")
    want = con.execute(__spark_entry__.oracle_sql()[name])
    columns = [x[0] for x in want.description]
    got = __spark_entry__.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(str, map(tuple, got.select(*columns).collect()))) == sorted(map(str, want.fetchall()))


def test_stream_equals_batch(spark, tmp_path):
    schema = "session_id string, subject string, predicate string, claim_id string, value string, source_turn_id string, speaker string, source_trust double, created_ts long"
    rows = [(f"s{i % 3}", "u", "p", f"c{i:02}", str(i * 7 % 5), f"t{i}", "user", 1.0, i) for i in range(30)]
    late = rows[20:] + rows[:20]  # the first ten seconds come last
    for k in range(3):
        spark.createDataFrame(late[10 * k : 10 * k + 10], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    store = st.Store(spark, str(tmp_path / "store"))
    q = stream.run_resolution(source, store, str(tmp_path / "ck"), ("p",), every=2)
    q.awaitTermination(300)
    key = ("old_claim_id", "new_claim_id", "edge_type")
    got = sorted(map(tuple, stream.current_edges(store).select(*key).collect()))
    assert store.read("log").count() == 30 and len(store.manifest().tables["log"]) == 2 and store.manifest().marks == {"batch": 2}
    assert got == sorted(map(tuple, facts.supersede(spark.createDataFrame(rows, schema), ("p",)).select(*key).collect()))


def test_stream_windows(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    source = spark.readStream.schema(events.schema).parquet(f"{SF}/events.parquet*")
    q = stream.event_windows(source).writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = ("start", "event_type", "n")
    assert sorted(map(tuple, spark.table("windows").select(*key).collect())) == sorted(map(tuple, stream.event_windows(events).select(*key).collect()))
