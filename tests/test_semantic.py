"""The vector index, components and the second pass against plain loops."""

from __future__ import annotations

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from factloom.operators import graph, semantic, vectors
from factloom.plans.queries import checkpoint


def cosine(a, b):
    n = math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
    return round(sum(x * y for x, y in zip(a, b, strict=True)) / n, 6) if n else 0.0


def points(rng, n, width=8, clumps=12):
    heart = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(clumps)]
    out = [[x + rng.gauss(0, 0.25) for x in rng.choice(heart)] for _ in range(n)]
    return out + [out[0]] * 15 + [[0.0] * width, None, [1.0] * (width - 1)]


@pytest.mark.parametrize("cells", [1, 5, 40])
def test_similar_pairs_are_all_and_exact(spark, cells):
    rng = random.Random(cells)
    rows = [(i, f"g{rng.randrange(3)}", v) for i, v in enumerate(points(rng, 150))]
    index = vectors.build(spark.createDataFrame(rows, "id long, g string, embedding array<double>").repartition(4), checkpoint, cells)
    want = {(g, a, b, cosine(v, w)) for a, g, v in rows for b, h, w in rows if a < b and g == h and v and w and len(v) == len(w) == 8 and any(v) and any(w) and cosine(v, w) >= 0.88}
    got = [tuple(r) for r in vectors.similar(index, 0.88, ["g"]).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


@pytest.mark.parametrize(("cells", "k"), [(1, 3), (6, 10), (40, 4), (40, 500)])
def test_nearest_are_exact(spark, cells, k):
    rng = random.Random(9)
    rows = [(i, v) for i, v in enumerate(points(rng, 120))]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    index = vectors.build(df, checkpoint, cells)
    asked = [(i, v) for i, v in rows if i % 10 == 0 or v is None] + [(900, [1.0] * 8), (901, [0.0] * 8)]
    got = defaultdict(list)
    for r in vectors.nearest(spark.createDataFrame(asked, "query long, embedding array<double>"), index, k, checkpoint).orderBy("query", "rank").collect():
        got[r["query"]].append((r.id, r.score))
    want = {}
    for q, v in asked:
        if v and any(v) and len(v) == 8:
            want[q] = [(i, s) for s, i in sorted(((cosine(v, w), i) for i, w in rows if i != q and w and len(w) == 8 and any(w)), key=lambda x: (-x[0], x[1]))[:k]]
    assert got == want


def test_an_empty_index(spark):
    df = spark.createDataFrame([], "id long, embedding array<double>")
    index = vectors.build(df, checkpoint)
    assert vectors.similar(index, 0.5, []).count() == 0
    assert vectors.nearest(spark.createDataFrame([(1, [1.0])], "query long, embedding array<double>"), index, 3, checkpoint).count() == 0


def test_far_cells_are_not_looked_at(spark):
    """Clumps that lie far apart: a probe goes to its own cell, not to all."""
    rng = random.Random(2)
    rows = [(i, [1.0 * (k == i % 16) + rng.gauss(0, 0.01) for k in range(16)]) for i in range(320)]
    index = vectors.build(spark.createDataFrame(rows, "id long, embedding array<double>"), checkpoint, 16)
    wide, radii = math.acos(0.88), index.radii
    asked = vectors.probes(index.rows, index, ["id"], lambda angles, batch: angles <= radii + wide)
    assert asked.count() < 2 * len(rows)


def test_components_equal_union_find(spark):
    rng = random.Random(4)
    for n, m in ((60, 40), (60, 120), (200, 150)):
        pairs = [(f"n{rng.randrange(n):03}", f"n{rng.randrange(n):03}") for _ in range(m)] + [("hub", f"n{i:03}") for i in range(0, n, 7)] + [(f"z{i:03}", f"z{i + 1:03}") for i in range(30)]
        up = {}

        def top(x, up=up):
            while up.setdefault(x, x) != x:
                x = up[x]
            return x

        for a, b in pairs:
            if a != b:
                low, high = sorted((top(a), top(b)))
                up[high] = low
        got = {r.node: r.root for r in graph.components(spark.createDataFrame(pairs, "a string, b string"), checkpoint).collect()}
        assert got == {x: top(x) for x in up}
    assert graph.components(spark.createDataFrame([("a", "a")], "a string, b string"), checkpoint).count() == 0


def plain_pass(claims, edges, threshold):
    """claims: (session, id, turn, ts, {space: (vector, seeks)}), in order."""
    answered = {new for _, new, _ in edges}
    ends = defaultdict(list)
    for old, new, kind in edges:
        if kind not in ("blocked", "contradicts"):
            ends[new].append(old)
    held, out = [], []
    for c in sorted(claims, key=lambda c: (c[3], c[1])):
        session, own, turn, ts, spaces = c
        held = [h for h in held if h[1] not in ends[own]]
        found = []
        if own not in answered:
            for space, (v, seeks) in spaces.items():
                if seeks:
                    for h in held:
                        if h[0] == session and h[2] != turn and space in h[4]:
                            s = cosine(v, h[4][space][0])
                            if s >= threshold:
                                found.append((s, h[3], h[1]))
        if found:
            s, _, old = max(found)
            out.append((session, old, own, s))
            held = [h for h in held if h[1] != old]
        held.append(c)
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_second_pass_equals_a_plain_loop(spark, seed):
    rng = random.Random(seed)
    claims, edges = [], []
    for i in range(260):
        session = "hot" if rng.random() < 0.34 else f"s{rng.randrange(6)}"
        def vector():
            return [1.0, 0.0, 0.0] if rng.random() < 0.3 else [float(rng.randrange(-2, 3)) for _ in range(3)]
        plain = rng.random() < 0.2
        spaces = {"text": (vector(), plain)} | ({} if plain else {f"p:{rng.randrange(2)}": (vector(), True)})
        claims.append((session, f"c{i:03}", f"t{rng.randrange(150)}", rng.randrange(120), spaces))
    order = sorted(claims, key=lambda c: (c[3], c[1]))
    for k in range(20):
        a, b = sorted(rng.sample(range(len(order)), 2))
        if order[a][3] < order[b][3]:
            edges.append((order[a][1], order[b][1], rng.choice(["user_correction", "blocked", "contradicts"]), order[b][3]))
    rows = [(s, space, c, t, ts, seeks, v) for s, c, t, ts, spaces in claims for space, (v, seeks) in spaces.items()]
    df = spark.createDataFrame(rows, "session_id string, space string, claim_id string, source_turn_id string, created_ts long, seeks boolean, embedding array<double>").repartition(5)
    given = spark.createDataFrame(edges, "old_claim_id string, new_claim_id string, edge_type string, created_ts long")
    got = semantic.second_pass(df, given, None, checkpoint, 0.88, cells=7)
    assert sorted((r.session_id, r.old_claim_id, r.new_claim_id, r.identity_score) for r in got.collect()) == plain_pass(claims, [e[:3] for e in edges], 0.88)


def test_statements(spark):
    claims = spark.createDataFrame(
        [("s", "dog", "has_name", "a", "dog has_name Rex", "t1", 1), ("s", None, None, "b", "", "t2", 2), ("z", "cat", "has_name", "c", None, "t9", 3)],
        "session_id string, subject string, predicate string, claim_id string, text string, source_turn_id string, created_ts long",
    )
    turns = spark.createDataFrame([("t1", " my dog\nis Rex " + "x" * 300), ("t2", "it barks")], "turn_id string, text string")
    got = {(r.claim_id, r.space): (r.said, r.seeks) for r in semantic.statements(claims, turns).collect()}
    assert got == {("a", "p:has_name"): (("dog has_name my dog is Rex " + "x" * 300)[: 13 + 160], True), ("a", "text"): ("dog has_name Rex", False), ("b", "text"): ("it barks", True), ("c", "p:has_name"): ("cat has_name ", True)}


def test_equal_statements_meet_one_member(spark):
    """A third of a million equal vectors would be no million pairs: links are between different vectors only."""
    rows = spark.range(0, 3000).select(F.lit("s").alias("session_id"), F.lit("p").alias("space"), F.format_string("c%05d", "id").alias("claim_id"), F.col("id").cast("string").alias("source_turn_id"), F.col("id").alias("created_ts"), F.lit(True).alias("seeks"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    none = spark.createDataFrame([], "old_claim_id string, new_claim_id string, edge_type string, created_ts long")
    got = semantic.second_pass(rows, none, None, checkpoint).collect()
    assert sorted((r.old_claim_id, r.new_claim_id) for r in got) == [(f"c{i:05}", f"c{i + 1:05}") for i in range(2999)]


@pytest.mark.parametrize("block", [7, 40, 8192])
def test_blocks_give_what_all_pairs_give(spark, monkeypatch, block):
    """Blocks of cells, split cells and cells packed together: components and nearest rows are those of all pairs."""
    monkeypatch.setattr(vectors, "BLOCK", block)
    rng = random.Random(block)
    rows = [(i, f"g{rng.randrange(3)}", v) for i, v in enumerate(points(rng, 150))]
    index = vectors.build(spark.createDataFrame(rows, "id long, g string, embedding array<double>").repartition(4), checkpoint, 5)
    pairs, links = vectors.similar(index, 0.88, ["g"]).select("a", "b"), checkpoint(vectors.tied(index, 0.88, ["g"]))
    parts = lambda df: {(r.node, r.root) for r in graph.components(df, checkpoint).collect()}
    assert parts(links) == parts(pairs)
    assert links.count() <= pairs.count()
    got = defaultdict(list)
    for r in vectors.nearest(spark.createDataFrame(rows[::10], "query long, g string, embedding array<double>"), index, 6, checkpoint).orderBy("query", "rank").collect():
        got[r["query"]].append((r.id, r.score))
    good = [(i, v) for i, _, v in rows if v and any(v) and len(v) == 8]
    assert got == {q: [(i, s) for s, i in sorted(((cosine(v, w), i) for i, w in good if i != q), key=lambda x: (-x[0], x[1]))[:6]] for q, v in good if q % 10 == 0}


def test_dense_pairs_are_not_written_out(spark):
    """Nearly all of two million pairs reach the threshold: links and blocks stay as many as rows."""
    rng = random.Random(1)
    rows = [("s", "p", f"c{i:05}", f"t{i}", i, True, [1.0 + rng.random() for _ in range(6)]) for i in range(2000)]
    df = spark.createDataFrame(rows, "session_id string, space string, claim_id string, source_turn_id string, created_ts long, seeks boolean, embedding array<double>")
    index = vectors.build(df.withColumnRenamed("claim_id", "id"), checkpoint)
    assert vectors.tied(index, 0.45, ["session_id", "space"]).count() < 2 * len(rows)
    none = spark.createDataFrame([], "old_claim_id string, new_claim_id string, edge_type string, created_ts long")
    got = sorted((r.old_claim_id, r.new_claim_id) for r in semantic.second_pass(df, none, None, checkpoint, 0.45).collect())
    assert got == [(f"c{i:05}", f"c{i + 1:05}") for i in range(1999)]


@pytest.mark.parametrize("small", [0, 40, 512])
def test_sessions_held_whole_and_families_give_the_same(spark, monkeypatch, small):
    """Sessions on either side of SMALL; vectors of length zero, missing and of another width; a claim id that comes twice in a session."""
    monkeypatch.setattr(semantic, "SMALL", small)
    monkeypatch.setattr(semantic, "KINDS", 4 if small == 40 else 1024)
    rng = random.Random(5)
    claims, odd = [], [None, [0.0, 0.0, 0.0], [1.0, 0.0]]
    for i in range(200):
        session = "hot" if rng.random() < 0.4 else f"s{rng.randrange(8)}"
        vector = [float(rng.randrange(-2, 3)) for _ in range(3)]
        spaces = {"text": (vector, rng.random() < 0.3)} | ({f"p:{rng.randrange(2)}": (vector[::-1], True)} if rng.random() < 0.7 else {})
        claims.append((session, f"c{i:03}", f"t{rng.randrange(120)}", rng.randrange(90), {k: v for k, v in spaces.items() if any(v[0])}))
    order = sorted(claims, key=lambda c: (c[3], c[1]))
    edges = [(a[1], b[1], kind, b[3]) for a, b, kind in zip(order[::17], order[9::17], ["user_correction", "blocked", "refines"] * 4, strict=False) if a[3] < b[3]]
    rows = [(s, space, c, t, ts, seeks, v) for s, c, t, ts, spaces in claims for space, (v, seeks) in spaces.items()]
    rows += [("hot", "text", f"x{i}", f"tx{i}", 10 * i, True, v) for i, v in enumerate(odd * 3)]
    df = spark.createDataFrame(rows, "session_id string, space string, claim_id string, source_turn_id string, created_ts long, seeks boolean, embedding array<double>").repartition(5)
    given = spark.createDataFrame(edges, "old_claim_id string, new_claim_id string, edge_type string, created_ts long")
    got = semantic.second_pass(df, given, None, checkpoint, 0.88, cells=7)
    assert sorted((r.session_id, r.old_claim_id, r.new_claim_id, r.identity_score) for r in got.collect()) == plain_pass([c for c in claims if c[4]], [e[:3] for e in edges], 0.88)


def test_small_sessions_need_no_index(spark, monkeypatch):
    """Many sessions of few claims are dealt once: no index is built and no links are followed."""
    monkeypatch.setattr(semantic, "families", None)
    rows = spark.range(0, 3000).select(F.format_string("s%d", F.col("id") % 200).alias("session_id"), F.lit("p").alias("space"), F.format_string("c%05d", "id").alias("claim_id"), F.col("id").cast("string").alias("source_turn_id"), F.col("id").alias("created_ts"), F.lit(True).alias("seeks"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    none = spark.createDataFrame([], "old_claim_id string, new_claim_id string, edge_type string, created_ts long")
    got = semantic.second_pass(rows, none, None, checkpoint).collect()
    assert sorted((r.old_claim_id, r.new_claim_id) for r in got) == [(f"c{i:05}", f"c{i + 200:05}") for i in range(2800)]
