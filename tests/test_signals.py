"""Signals kept up from the change feed, against what the whole log says."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from factloom import model
from factloom.operators import signals, views
from factloom.sources import store as st

CHANGE = "claim_id string, session_id string, subject string, predicate string, value string, confidence double, created_ts long, status string, was string, seq long"
EDGE = "old_claim_id string, new_claim_id string, n long"
NOW = 200 * model.DAY_NS


@pytest.fixture
def store(spark, tmp_path):
    return st.Store(spark, str(tmp_path / "store"))


class Log:
    """A log that changes at random, and the batches that tell so."""

    def __init__(self, seed: int):
        self.r, self.claims, self.edges, self.seq = random.Random(seed), {}, [], 0

    def batch(self, n: int):
        changes, edges = [], []
        for _ in range(n):
            self.seq += 1
            kind = self.r.random()
            if kind < 0.6 or not self.claims:
                i = f"c{self.seq}"
                row = [i, f"s{self.r.randrange(4)}", self.r.choice(["u", "v", None]), self.r.choice(["p", "q", None]), self.r.choice(["x", "y", None]), self.r.choice([0.2, 0.9, None]), self.seq * model.DAY_NS, "active"]
                changes.append((*row, None, self.seq))
                self.claims[i] = row
            elif kind < 0.9:
                row = self.claims[self.r.choice(sorted(self.claims))]
                was, row[7] = row[7], self.r.choice(["active", "confirmed", "superseded", "dismissed"])
                changes.append((*row, was, self.seq))
            else:
                row = self.claims.pop(self.r.choice(sorted(self.claims)))
                changes.append((*row[:7], None, row[7], self.seq))
            if len(self.claims) > 1 and self.r.random() < 0.4:
                edges.append((*self.r.sample(sorted(self.claims), 2), 1))
                self.edges.append(edges[-1])
        if self.edges and self.r.random() < 0.5:
            gone = self.edges.pop(self.r.randrange(len(self.edges)))
            edges.append((*gone[:2], -1))
        return changes, edges

    def whole(self, spark):
        claims = spark.createDataFrame([tuple(x) for x in self.claims.values()], CHANGE.split(", was")[0])
        return views.importance(claims, spark.createDataFrame(self.edges, EDGE), F.lit(NOW))


def scores(df):
    return {r.claim_id: pytest.approx(r.importance, abs=1e-12) for r in df.collect()}


@pytest.mark.parametrize("seed", [1])
def test_random_batches_equal_recomputation(spark, store, seed):
    log = Log(seed)
    for k in range(5):
        changes, edges = log.batch([12, 1, 20, 3, 8][k])
        told = spark.createDataFrame(changes, CHANGE), spark.createDataFrame(edges, EDGE)
        assert signals.feed_claims(store, k, told[0]) and signals.feed_edges(store, k, told[1])
        assert signals.feed_claims(store, k, told[0]) is None and signals.feed_edges(store, k, told[1]) is None  # delivered again
        want = scores(log.whole(spark))
        assert scores(signals.importance(store, NOW)) == want
        if k != 1:  # a batch that no write-back came after
            signals.write_back(store, NOW, most=2)
            assert scores(signals.metadata(store)) == want
    assert all(len(store.manifest().tables[x]) <= 3 for x in ("signal_claims", "signal_slots", "signal_sessions", "signal_roles"))


def claim(i, session, ts, value="x", subject="u", confidence=0.5, status="active"):
    return (f"c{i}", f"s{session}", subject, "p", value, confidence, ts, status, None, ts)


def test_only_touched_claims_are_written(spark, store):
    signals.feed_claims(store, 0, spark.createDataFrame([claim(1, 1, 1), claim(2, 1, 2), claim(3, 1, 3, subject="v"), claim(4, 1, 4, subject="w")], CHANGE))
    first = signals.write_back(store, NOW)
    signals.feed_claims(store, 1, spark.createDataFrame([claim(5, 2, 5)], CHANGE))
    signals.feed_edges(store, 0, spark.createDataFrame([("c9", "c3", 1)], EDGE))
    signals.write_back(store, 2 * NOW)
    folder = store.manifest().tables["signal_metadata"][-1]["path"]
    assert sorted(r.claim_id for r in spark.read.parquet(f"{store.path}/{folder}").collect()) == ["c1", "c2", "c3", "c5"]
    before, after = scores(signals.metadata(store, first)), scores(signals.metadata(store))
    assert before["c4"] == after["c4"].expected and before["c1"] != after["c1"].expected  # time alone writes nothing
    signals.write_back(store, 2 * NOW, whole=True)
    assert scores(signals.metadata(store)) == scores(signals.importance(store, 2 * NOW))


def test_use_and_demotion(spark, store):
    day = model.DAY_NS
    signals.feed_claims(store, 0, spark.createDataFrame([claim(1, 1, 1, confidence=0.1), claim(2, 1, 1, confidence=0.1), claim(3, 1, 190 * day, confidence=0.1), claim(4, 1, 1, confidence=None)], CHANGE))
    signals.feed_access(store, 0, spark.createDataFrame([("c2", 199 * day), ("c2", 100 * day), ("c7", 1)], "claim_id string, ts long"))
    assert signals.feed_access(store, 0, spark.createDataFrame([("c2", 199 * day)], "claim_id string, ts long")) is None
    got = {r.claim_id: r for r in signals.utility(signals.metadata(store), NOW).collect()}
    assert (got["c2"].access_count, got["c2"].last_accessed_ts, got["c1"].access_count, got["c1"].last_accessed_ts) == (2, 199 * day, 0, None)
    plain = lambda n, days, confidence: round(0.4 * 0.5 + 0.3 * n / (n + 3) + 0.2 / (1 + days / 90) + 0.1 * confidence, 4)
    assert got["c1"].utility == plain(0, 200, 0.1) and got["c2"].utility == plain(2, 1, 0.1) and got["c4"].utility == plain(0, 200, 0)
    signals.demote(store, NOW)
    gone = lambda: sorted(r.claim_id for r in signals.metadata(store).filter("demoted").collect())
    assert gone() == ["c1", "c4"]  # c2 was served, c3 is young
    signals.restore(store, spark.createDataFrame([("c1",), ("c1",)], "claim_id string"))
    signals.write_back(store, NOW, whole=True)
    assert gone() == ["c4"]


def test_consolidation(spark, store):
    rows = [claim(i, i, 10 - i, subject="v") for i in (1, 2, 3)] + [claim(i, i, i) for i in (4, 5, 6)] + [claim(7, 7, 7, value="y")] + [claim(i, i, i, value=None, subject="w") for i in (8, 9, 10)]
    rows += [claim(i, i, i, subject="z", status="superseded" if i == 13 else "active") for i in (11, 12, 13)]
    signals.feed_claims(store, 0, spark.createDataFrame(rows, CHANGE))
    signals.consolidate(store)
    got = {r.claim_id: (r.consolidated_into, r.demoted, r.importance) for r in signals.metadata(store).collect()}
    assert {k: v for k, v in got.items() if v != (None, False, 0.5)} == {"c3": ("c3", False, 0.9), "c2": ("c3", True, 0.5), "c1": ("c3", True, 0.5)}


def test_nothing(spark, store):
    none = spark.createDataFrame([], CHANGE)
    assert signals.metadata(store).count() == 0 and signals.importance(store, NOW).count() == 0
    signals.write_back(store, NOW)
    signals.demote(store, NOW)
    signals.consolidate(store)
    assert signals.feed_claims(store, 0, none) and signals.feed_edges(store, 0, none.selectExpr("claim_id old_claim_id", "claim_id new_claim_id"))
    signals.write_back(store, NOW)
    assert signals.metadata(store).count() == 0


def test_stream_of_changes(spark, store, tmp_path):
    log = Log(3)
    for k in range(3):
        spark.createDataFrame(log.batch(10)[0], CHANGE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    log.edges = []
    source = spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second finds nothing new
        signals.follow(source, store, str(tmp_path / "ck")).awaitTermination(300)
    assert store.manifest().marks["feed claims"] == 2 and scores(signals.importance(store, NOW)) == scores(log.whole(spark))
