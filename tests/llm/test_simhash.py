from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from factloom.llm import components, simhash


def slow_fingerprint(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else ([" ".join(words)] if words else [])
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(items):
    """items: (id or None, fingerprint); the least id of each item's component."""
    parent = list(range(len(items)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(items)):
        for j in range(i):
            if bin(items[i][1] ^ items[j][1]).count("1") <= 4:
                parent[find(i)] = find(j)
    groups = {}
    for i, (doc, _) in enumerate(items):
        groups.setdefault(find(i), []).append(doc)
    return [min((d for d in groups[find(i)] if d is not None), default=None) for i in range(len(items))]


@pytest.mark.parametrize("text", ["", " \t\n", "a", "A b", "a b c d", "Ä É a b c D e F g", "x y z w " * 40, "é ü one two three four five"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) % (1 << 64) == slow_fingerprint(text)


def near(rng, base, n):
    return [base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(n)]


@pytest.mark.parametrize("hot", [4096, 3])
def test_links_connect_what_brute_force_does(spark, hot):
    rng = random.Random(5)
    values = [rng.getrandbits(64) for _ in range(60)]
    for base in values[:4]:
        values += near(rng, base, 25)
    values = sorted({simhash.signed(x) for x in values})
    found = components.labels(simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"), hot))
    roots = {r.node: r.root for r in found.collect()}
    expected = brute_components([(v, v % (1 << 64)) for v in values])
    assert [roots.get(v, v) for v in values] == expected


def test_what_the_pivot_table_discards(spark):
    """Of pairs that share a key, the table discards most that are no links, and never a link."""
    rng = random.Random(6)
    pairs = []
    for _ in range(3000):
        a = rng.getrandbits(64)
        far = rng.getrandbits(43) << 21  # the same lowest 21 bits, as two of six blocks ask
        pairs.append((simhash.signed(a), simhash.signed(a ^ far), False))
        pairs.append((simhash.signed(a), simhash.signed(near(rng, a, 1)[0]), True))
    df = spark.createDataFrame(pairs, "a long, b long, planted boolean")
    kept = simhash.near_by_pivots(simhash.pivot_table(F.col("a")), simhash.pivot_table(F.col("b")))
    rows = df.select("a", "b", "planted", kept.alias("kept"), simhash.verified(F.col("a"), F.col("b")).alias("link")).collect()
    for r in rows:
        assert r.link == (bin((r.a ^ r.b) % (1 << 64)).count("1") <= 4)
        assert r.kept or not r.link
    others = [r for r in rows if not r.planted and not r.link]
    discarded = sum(not r.kept for r in others) / len(others)
    assert len(others) > 2900 and discarded > 0.95


def test_a_hub_of_links_has_one_root(spark):
    links = spark.range(1, 3000).select(F.col("id").alias("a"), F.lit(0).cast("long").alias("b"))
    found = components.labels(links)
    assert found.count() == 3000 and {r.root for r in found.collect()} == {0}


def test_a_very_long_text():
    text = "one two Three four five six seven " * 60_000
    assert simhash.fingerprint(text) % (1 << 64) == simhash.fingerprint("one two three four five six seven " * 60_000) % (1 << 64)
    assert simhash.fingerprint(text[:700]) % (1 << 64) == slow_fingerprint(text[:700])


def corpus(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(12):
        body = rng.choices(words, k=120)
        rows += [" ".join(body)] * 3
        rows += [" ".join(body[:k] + ["new"] + body[k + 1 :]) for k in (3, 60, 119)]
    rows += ["", None, " ", "a", "A", "b c"]
    docs = [(i, t, "x") for i, t in enumerate(rows)] + [(4, rows[4], "x"), (None, rows[9], "y"), (None, "only null", "y")]
    return docs, spark.createDataFrame(docs, "doc_id long, text string, fp string")


def test_components(spark):
    docs, df = corpus(spark)
    expected = brute_components([(d, slow_fingerprint(t or "")) for d, t, _ in docs])
    want = sorted([(d, f"{slow_fingerprint(t or ''):016x}", c) for (d, t, _), c in zip(docs, expected, strict=True)], key=str)
    got = sorted([tuple(r) for r in simhash.components(df).select("doc_id", "fingerprint", "component_id").collect()], key=str)
    assert got == want
    assert any(c != d for d, _, c in want)


def test_one_of_each_group_stays(spark):
    docs, df = corpus(spark)
    groups = brute_components([(d, slow_fingerprint(t or "")) for d, t, _ in docs])
    got = simhash.deduplicated(df)
    assert got.columns == df.columns
    ids = [r.doc_id for r in got.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({g for g in groups if g is not None})
    assert ids.count(None) == 1


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.components(df).count() == 0
    assert simhash.deduplicated(df).count() == 0


def test_chain_has_one_root(spark):
    links = spark.range(0, 200).select((F.col("id") + 1).alias("a"), F.col("id").alias("b"))
    found = components.labels(links)
    assert found.count() == 201 and {r.root for r in found.collect()} == {0}
