from __future__ import annotations

import hashlib

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from factloom.llm import fingerprints as fp


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def texts():
    rng = np.random.default_rng(1)
    words = [f"w{i}é" for i in range(500)]
    base = [" ".join(rng.choice(words, 300)) for _ in range(8)]
    near = [b.replace(" ", "\n", 1).upper() for b in base] + [b + " tail end" for b in base] + [b[: len(b) // 2] for b in base]
    return base + near + ["", " ", "one", "one two three four five six", "x " * 40]


def test_likeness_estimates_jaccard():
    own = texts()
    s = fp.signatures(own, fp.Shingler(), fp.family(256))
    for i in range(len(own)):
        for j in range(i):
            a, b = shingles(own[i]), shingles(own[j])
            want = len(a & b) / len(a | b) if a | b else 1.0
            assert (s[i] == s[j]).mean() == pytest.approx(want, abs=0.15)


def test_a_text_has_one_signature_whatever_the_batch():
    own, shingler = texts(), fp.Shingler()
    whole = fp.signatures(own, shingler, fp.family())
    for i in (0, 5, 24, 25, 27):
        assert (fp.signatures([own[i]], fp.Shingler(), fp.family())[0] == whole[i]).all()


@pytest.mark.parametrize("parts", [1, 5])
def test_query(spark, tmp_path, parts):
    rows = [(3 * i, t) for i, t in enumerate(texts())] + [(1000, None)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, bucket string, role int")
    df.repartition(parts).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in fp.query(spark, str(tmp_path)).collect()}
    rows = sorted(((i, t or "") for i, t in rows), reverse=True)
    assert len(got) == len(rows)
    s = dict(zip([i for i, _ in rows], fp.signatures([t for _, t in rows], fp.Shingler(), fp.family()), strict=True))
    for (i, t), (j, u) in zip(rows, rows[1:] + rows[:1], strict=True):
        n = len(t) // 3
        e = t[: len(t) - n] + u[:n]
        own = fp.signatures([e], fp.Shingler(), fp.family())[0]
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), hashlib.sha256(e.encode()).hexdigest(), *fp.as_text(np.array([s[i], own])))
        assert (r.near_edited, r.near_next) == ((s[i] == own).mean(), (s[i] == s[j]).mean())


def test_odd_rows(spark):
    df = spark.createDataFrame([(5, "a b c"), (5, "a b c"), (None, "x"), (None, None)], "doc_id long, text string")
    assert fp.edit_probe(df).count() == 4
    assert fp.edit_probe(df.limit(1)).first().near_next == 1.0
    assert fp.edit_probe(df.limit(0)).count() == 0


def jaccard(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x | y else 0.0


def family_of_texts():
    rng = np.random.default_rng(4)
    words, out = [f"w{i}" for i in range(800)], []
    for _ in range(30):
        body = list(rng.choice(words, 200))
        out.append(" ".join(body))
        for k in range(int(rng.integers(0, 5))):
            near = list(body)
            for at in rng.integers(0, 200, int(rng.integers(1, 8))):
                near[at] = f"new{k}"
            out.append(" ".join(near))
    return out


def test_near_links_are_verified_and_few_are_missed(spark):
    own = texts() + family_of_texts()
    rows = [(i, t) for i, t in enumerate(own)] + [(500 + i, t) for i, t in enumerate(own[:3])] + [(7, own[1]), (None, own[0] + " z"), (None, None)]
    got = fp.near_links(spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, key string")).collect()
    text = {i: t for i, t in reversed(rows) if i is not None}
    by_key = {xxh64_intdigest((t or "").encode(), 42): t for _, t in rows}
    linked = set()
    for r in got:
        mine = by_key[r.key % (1 << 64)]
        assert mine != text[r.near_doc] and r.near_jaccard >= 0.8
        assert r.near_jaccard == pytest.approx(jaccard(mine, text[r.near_doc]))
        linked |= {mine, text[r.near_doc]}
    whole = sorted({t or "" for _, t in rows})
    want = {a for a in whole for b in whole if a != b and (x := jaccard(a, b)) >= 0.8 and x}
    assert linked <= want and len(want) > 40
    assert len(linked) >= 0.95 * len(want)
    assert fp.near_links(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_large_group_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(fp, "SHARE", 7)
    monkeypatch.setattr(fp, "BROADCAST", 3)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(base[:k] + [f"n{i}"] + base[k + 1 :])) for i, k in enumerate(range(5, 110))]
    got = fp.near_links(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) >= len(rows) - 2 and all(r.near_jaccard == pytest.approx(jaccard(rows[r.doc_id][1], rows[r.near_doc][1])) for r in got)


def slow_signature(text, hashes):
    """Minima in plain whole numbers."""
    base, whole = fp.BASE, 1 << 64
    out = [0xFFFFFFFF] * len(hashes.a)
    for s in shingles(text):
        raw = " ".join(s).encode()
        x = (sum(b * pow(base, i, whole) for i, b in enumerate(raw)) + len(raw)) * 0xFF51AFD7ED558CCD % whole
        x ^= x >> 32
        out = [min(m, (x * int(a) + int(b)) % whole >> 32) for m, a, b in zip(out, *hashes, strict=True)]
    return out


@pytest.mark.parametrize("part", [1 << 20, 50, 7])
def test_signatures_are_those_of_plain_numbers(monkeypatch, part):
    monkeypatch.setattr(fp, "PART", part)
    own, hashes = [*texts()[::3], "one two", "ΑΣ ΣΑΣ a b\u2003c\x1cd e f", "x" * 300, " lead a b c d e f "], fp.family(8)
    got = fp.signatures(own, fp.Shingler(), hashes)
    for i, t in enumerate(own):
        assert got[i].tolist() == slow_signature(t, hashes), t[:40]


def test_memory_of_a_very_long_text():
    import subprocess
    import sys

    code = """
import resource
from factloom.llm import fingerprints as fp
text = " ".join(f"w{i * 7919 % 100003}" for i in range(3_000_000))
base = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
shingler = fp.Shingler()
fp.signatures([text], shingler, fp.family())
fp.signatures(["a b c d e f g"], shingler, fp.family())
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - base) // 1024, len(shingler.powers))
"""
    grown, powers = map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split())
    assert grown < 400 and powers <= 1 << 23, (grown, powers)


def test_no_link_is_lost_and_classes_are_whole(spark, monkeypatch):
    """Without a band in common only the prefixes find the pairs; with bands, no class may fall apart. Pairs are made in small parts."""
    monkeypatch.setattr(fp.overlaps, "PAIRS", 5)
    monkeypatch.setattr(fp, "QUOTA", 1)
    own = family_of_texts() + texts()
    line = "this very line stands in each of them over and over"
    rng = np.random.default_rng(9)
    own += [f"{line} {' '.join(rng.choice([f'v{i}' for i in range(400)], 30))}" for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(own)] + [(1000 + i, t) for i, t in enumerate(own[::9])] + [(2000, None), (None, own[0] + " z")]
    whole = sorted({t or "" for _, t in rows})
    sets = [shingles(t) for t in whole]
    near = {(a, b) for a in range(len(whole)) for b in range(a) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    root = list(range(len(whole)))
    for _ in whole:
        for a, b in near:
            root[a] = root[b] = min(root[a], root[b])
    least = {}
    for i, t in rows:
        if i is not None:
            k = root[whole.index(t or "")]
            least[k] = min(least.get(k, i), i)
    linked = {whole[k] for pair in near for k in pair}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    plain = fp.banded
    for bands in (plain, lambda s: np.arange(fp.BANDS * len(s), dtype=np.uint64).reshape(len(s), -1) + np.uint64(hash(s.tobytes()) % (1 << 62))):
        monkeypatch.setattr(fp, "banded", bands)
        monkeypatch.setattr(fp, "BLOCK", 10 if bands is plain else 10**6)
        got = fp.edit_probe(df).collect()
        assert len(got) == len(rows)
        text = dict(rows)
        for r in got:
            t = text[r.doc_id] or ""
            assert (r.near_jaccard is not None) == (t in linked)
            assert r.near_class == least[root[whole.index(t)]]
    assert len(near) > 60


@pytest.mark.parametrize("threshold", [0.5, 0.8, 0.95])
def test_prefixes_share_what_near_sets_must(threshold):
    rng = np.random.default_rng(3)
    of = fp.overlaps.Prefixes(rng.choice(300, 40, False).astype(np.uint32), threshold)
    for _ in range(300):
        n = int(rng.integers(1, 200))
        a = set(rng.choice(300, n, False).tolist())
        b = set(list(a)[int(rng.integers(0, 1 + n // 4)) :]) | set(rng.choice(300, int(rng.integers(0, 1 + n // 6)), False).tolist())
        if b and len(a & b) >= threshold * len(a | b):
            x, y = (np.array(sorted(s), np.uint32) for s in (a, b))
            first = of(np.concatenate((x, y)), np.repeat([0, 1], [len(x), len(y)]))
            p, q = set(x[first[first < len(x)]].tolist()), set(y[first[first >= len(x)] - len(x)].tolist())
            assert len(p & q) >= 1 + min(len(a), len(b)) // fp.overlaps.WANTED


def test_a_dense_group_makes_no_rows_for_pairs(spark, monkeypatch):
    """Texts of which most pairs share a prefix and few are near: what is dealt and linked grows with the texts, not with their pairs."""
    from factloom.llm import common

    monkeypatch.setattr(fp, "banded", lambda s: np.arange(fp.BANDS * len(s), dtype=np.uint64).reshape(len(s), -1) + np.uint64(hash(s.tobytes()) % (1 << 62)))
    rng = np.random.default_rng(2)
    base, rows = [f"w{i}" for i in range(60)], []
    for i in range(150):
        body = list(base)
        for at in rng.integers(0, 60, 1 + i % 3):
            body[at] = f"n{i}"
        rows.append((i, " ".join(body)))
    sizes, plain = {}, common.written

    def written(df, name):
        out = plain(df, name)
        sizes[name] = max(sizes.get(name, 0), out.count())
        return out

    monkeypatch.setattr(common, "written", written)
    got = {r.doc_id: r for r in fp.near_rows(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = [shingles(t) for _, t in rows]
    near = {(a, b) for a in range(150) for b in range(150) if a != b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert {a for a, _ in near} == {i for i, r in got.items() if r.near_jaccard is not None} and len(near) > 30
    assert max(n for k, n in sizes.items() if not k.startswith("minhash-c")) < 150 * 20


def test_only_texts_that_may_be_near_come_with_their_sets_and_pairs_meet_once(spark, monkeypatch):
    """Texts with rare lines in common stand on many lists together; those too far apart are told by the lists, and two that are near meet in one cell."""
    from factloom.llm import common

    monkeypatch.setattr(fp, "banded", lambda s: np.arange(fp.BANDS * len(s), dtype=np.uint64).reshape(len(s), -1) + np.uint64(hash(s.tobytes()) % (1 << 62)))
    rng = np.random.default_rng(4)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    rows = []
    for _ in range(12):
        line = words(60)  # a fifth of each text
        rows += [" ".join(line + words(240)) for _ in range(6)]
    base = [words(300) for _ in range(5)]
    rows += [" ".join(b[: 290 + 5 * k] + words(3)) for b in base for k in range(2)]
    dealt, plain = {}, common.written

    def written(df, name):
        out = plain(df, name)
        if name == "minhash-cells":
            dealt[name] = [r.key for r in out.select("key").collect()]
        return out

    monkeypatch.setattr(common, "written", written)
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id for r in fp.near_rows(df).filter("near_jaccard is not null").collect()}
    keys = {i: r.key for i, r in enumerate(fp.named(df, "doc_id", "text").orderBy("doc_id").collect())}
    assert got == set(range(72, 82))
    assert sorted(dealt["minhash-cells"]) == sorted(keys[i] for i in got)
