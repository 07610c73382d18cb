"""Best-fit packing, the prefix trie and periodic runs against plain loops; odd rows of each."""

from __future__ import annotations

import bisect
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from factloom.llm import bestfit, periodic, scans, trie

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
LIBRARY.encode_special_tokens = True


# --- best-fit packing ---


def best_fit_decreasing(lengths, capacity):
    rooms, n = [], 0
    for x in sorted(lengths, reverse=True):
        k = bisect.bisect_left(rooms, x)
        if k == len(rooms):
            n += 1
            room = capacity
        else:
            room = rooms.pop(k)
        bisect.insort(rooms, room - x)
    return n


@pytest.mark.parametrize("seed", range(60))
def test_plan_holds_every_piece_once(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 30, 100, 2048])
    most = rng.choice([capacity // 10 + 1, capacity // 3 + 1, capacity])
    lengths = [rng.randint(1, most) for _ in range(rng.randint(0, 400))] + [rng.randint(1, capacity) for _ in range(rng.randint(0, 30))]
    plan, seen, numbers, held = bestfit.plan(Counter(lengths), capacity), Counter(), [], defaultdict(list)
    for n in lengths:
        numbers.append(seen[n])
        seen[n] += 1
    for n, s, at in zip(lengths, *plan.place(np.array(lengths, np.int64), np.array(numbers, np.int64)), strict=True):
        held[s].append((at, n))
    assert len(held) == plan.sequences
    for own in held.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= capacity and sum(3 * n > capacity for _, n in own) <= 2
    assert plan.sequences <= best_fit_decreasing(lengths, capacity)


def test_matching_gives_as_many_pairs_as_can_be():
    """Against every matching of small sets of large pieces."""

    def most_pairs(left):
        if len(left) < 2:
            return 0
        first, rest = left[0], left[1:]
        return max([most_pairs(rest)] + [1 + most_pairs(rest[:k] + rest[k + 1 :]) for k in range(len(rest)) if first + rest[k] <= 30])

    rng = random.Random(3)
    for _ in range(200):
        lengths = [rng.randint(11, 30) for _ in range(rng.randint(0, 7))]
        assert bestfit.plan(Counter(lengths), 30).sequences == len(lengths) - most_pairs(lengths)


def test_size_of_the_plan_is_bounded_by_the_capacity():
    few, many = (bestfit.plan({n: k * (1 + n % 7) for n in range(1, 2049)}) for k in (1000, 10**9))
    assert len(many.length) < 1.1 * len(few.length) < 5 * 2048


def test_packed(spark):
    texts = ["", "word " * 5000, "two words", None, "x" * 40, "word " * 2047, "ü 漢 😀"] + [f"text {i} of some words" for i in range(60)] + ["equal"] * 90
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(None, "no id", "c"), (3, "again", "c"), (3, "again", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, `offset` string").repartition(5)
    got, by_doc, by_sequence = bestfit.packed(df).collect(), defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    want = defaultdict(list)
    for i, t, _ in rows:
        ids = np.array([*LIBRARY.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        cut = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        want[i] += [(k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cut, cut[1:], strict=False))]
    assert {i: sorted((r.piece, r.start, r.length, r.ids_crc32) for r in x) for i, x in by_doc.items()} == {i: sorted(x) for i, x in want.items()}
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert len(by_sequence) <= best_fit_decreasing([x[2] for own in want.values() for x in own], 2048)
    assert bestfit.packed(df.filter(F.lit(False))).count() == 0


# --- running sums ---


def test_running_sums_over_many_tasks(spark):
    """A segment with a third of the rows lies in several tasks."""
    rng = random.Random(5)
    rows = [(7 if rng.random() < 0.34 else rng.randrange(-20, 20), rng.randrange(1000), rng.randrange(9)) for _ in range(900)]
    df = spark.createDataFrame(rows, "k long, at long, v int").repartition(3)
    got = scans.running_sums(df, ["k", "at", "v"], {"total": "v"}, "test", ["k", "at", "v"], segment="k")
    want, total = [], defaultdict(int)
    for k, at, v in sorted(rows):
        total[k] += v
        want.append((k, at, v, total[k]))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert got.select(F.spark_partition_id()).distinct().count() > 1
    whole = scans.running_sums(df, ["k", "at", "v"], {"total": "v"}, "test", ["k", "at", "v"]).agg(F.max("total")).first()[0]
    assert whole == sum(r[2] for r in rows)
    assert scans.running_sums(df.limit(0), ["k"], {"total": "v"}, "test", ["k"]).count() == 0


# --- prefix trie ---


def plain_trie(rows, rebuild):
    """Every prefix as a tuple of turns."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append(((turn is not None, turn or 0), hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32], len(text.encode())))
    own = {c: [x[1:] for x in sorted(own[c])] for c in own}
    convs = own
    if rebuild:
        convs = {}
        for c in own:
            h = zlib.crc32(str(c).encode()) % 9
            base = c - int(np.fmod(c, 5))
            convs[c] = own.get(base, [])[:h] + own[c][h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
        ends[tuple(convs[c])].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved, sizes = Counter(), Counter(), Counter()
    for p, own_members in members.items():
        for d in range(len(p) + 1):
            sizes[p[:d]] += 1
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(own_members) - 1) * (p[-1][1] if p else 0)
    place = {p: k for k, p in enumerate(sorted(members, key=lambda p: [x[0] for x in p]), 1)}
    return sorted(
        (min(m), len(p), -9 if not p else min(members[p[:-1]]), len(m), kids[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest(), place[p], place[p] + sizes[p] - 1)
        for p, m in members.items()
    )


def talks(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        hot = rng.random() < 0.34
        for turn in range(rng.randint(1, 12)):
            rows.append((c, turn, rng.choice(["user", "assistant", None]) if not hot else "user", "hello" if turn == 0 or hot else rng.choice(["a", "b", "ü", None, ""])))
    rows += [(3, None, "user", "first"), (3, None, None, "other"), (None, 1, "user", "nobody's"), (7, 2, "user", "twice"), (7, 2, "user", "twice"), (-3, 0, "user", "hello"), (502, 1, "user", "no base"), (901, 0, "user", "x" * 200_000)]
    rows += [(88_888, i, "user", "long") for i in range(700)] + [(88_889, i, "user", "long" if i < 650 else "other") for i in range(700)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("rebuild", [False, True])
def test_trie_equals_plain_loops(spark, tmp_path, rebuild):
    rows = talks(1, 120)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("node", F.lit("clash")).repartition(6)
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    got = trie.query(spark, str(tmp_path)) if rebuild else trie.trie(spark.read.parquet(str(tmp_path / "conversations.parquet")))
    assert sorted(tuple(-9 if x is None else x for x in r) for r in got.collect()) == plain_trie(rows, rebuild)


def test_trie_of_equal_turnless_and_no_conversations(spark, tmp_path):
    rows = [(c, 0, "user", "same") for c in range(40)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert sorted(tuple(-9 if x is None else x for x in r) for r in trie.query(spark, str(tmp_path)).collect()) == plain_trie(rows, True)
    con = duckdb.connect()
    con.execute(f"create view conversations as from '{tmp_path}/conversations.parquet/*.parquet'")
    assert sorted(tuple(-9 if x is None else x for x in r) for r in con.execute(trie.ORACLE).fetchall()) == plain_trie(rows, True)
    assert trie.trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_ends_are_hashed_in_pieces(spark, monkeypatch):
    ends = spark.range(0, 500).select(F.col("id").alias("conv_id"), F.lit(2).cast("long").alias("depth"), F.when(F.col("id") % 3 == 0, F.unhex(F.lit("AA"))).otherwise(F.unhex(F.lit("BB"))).alias("node"))
    monkeypatch.setattr(trie, "JOINED", 7)
    got = {bytes(r.node): r.ends_sha256 for r in trie.end_hashes(ends.repartition(4)).collect()}
    want = {k: hashlib.sha256(",".join(str(i) for i in range(500) if (i % 3 == 0) == (k == b"\xaa")).encode()).hexdigest() for k in (b"\xaa", b"\xbb")}
    assert got == want


# --- periodic runs ---


def smallest_period(x):
    border, k = [0] * len(x), 0
    for i in range(1, len(x)):
        while k and x[i] != x[k]:
            k = border[k - 1]
        k += x[i] == x[k]
        border[i] = k
    return len(x) - border[-1]


def plain_runs(w, words, periods):
    out = []
    for q in range(1, len(w) // periods + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if j > i and n >= max(words, periods * q) and smallest_period(w[i : i + n]) == q:
                out.append((i, n, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("seed", range(200))
def test_runs_equal_plain_loops(seed):
    rng, texts = random.Random(seed), []
    for _ in range(rng.randint(1, 5)):
        k = rng.choice([1, 2, 3, 5, 40])
        own = [rng.randrange(k) for _ in range(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            unit = [rng.randrange(k) for _ in range(rng.randint(1, 12))]
            own += (unit * rng.randint(1, 6))[: rng.randint(1, 60)] + [rng.randrange(k) for _ in range(rng.randint(0, 5))]
        texts.append(np.array(own, np.int64))
    words, periods, levels = rng.choice([2, 6, 24]), rng.choice([2, 3]), rng.choice([1, 2, 6])
    assert periodic.runs_of(texts, words, periods, levels) == [plain_runs(x.tolist(), words, periods) for x in texts]


def test_long_repetitions_cost_little():
    """n log n: every level of such texts changes, and none may cost as much as the text is long."""
    for text in (np.zeros(120_000, np.int64), np.tile(np.arange(40_000), 3), np.tile(np.arange(50), 2400)):
        assert len(periodic.runs_of([text])[0]) == 1


def test_periodic_query(spark, tmp_path):
    rng = random.Random(2)
    some = lambda n, k=30: " ".join(f"w{rng.randrange(k)}" for _ in range(n))
    texts = ["", None, " \t\n ", "a " * 30, "a b " * 12, "x " + "a b c " * 9 + "y", some(24), some(900, 3), "ü\xa0v\x0bw " * 40, some(50) + " " + "line one of text " * 7 + some(40), "b " * 5000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, some(rng.randint(1, 300))) for i in range(150)] + [(None, "a " * 40), (3, "a " * 30), (3, "a " * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit("clash"))
    df.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for i, t in rows:
        words = (t or "").encode().split()
        h, n = (zlib.crc32(str(i).encode()) if i is not None else 1), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        own = plain_runs(words, 24, 3)
        drop = {k for s, m, q in own for k in range(s + q, s + m)}
        best = sorted(own, key=lambda r: (-r[1] / r[2], r[0], r[2]))[:1]
        top = (*best[0], 1000 * best[0][1] // best[0][2]) if best else (None,) * 4
        listed = "".join(f"{s},{m},{q}\n" for s, m, q in own)
        text = b" ".join(w for k, w in enumerate(words) if k not in drop)
        want.append((i, len(own), *top, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text).hexdigest()))
    got = periodic.query(spark, str(tmp_path)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want)) and sum(r.n_runs > 0 for r in got) > 15
    assert {r.doc_id: r.text for r in periodic.collapsed(df.filter("doc_id = 5")).collect()} == {5: "x a b c y"}
    assert [tuple(x) for x in periodic.runs(df.filter("doc_id = 5")).first().runs] == [(1, 27, 3)]
    assert periodic.runs(df.filter(F.lit(False))).count() == 0
