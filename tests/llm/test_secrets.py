from __future__ import annotations

import hashlib
import re

from pyspark.sql import functions as F

from factloom.llm import secrets

PATTERNS = {
    "assign": (re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 24),
}

TEXTS = [
    "", None, "nothing here", "password = hunter22", "secret=token:abcdef123", "Api_Key: 'abc/def+==' TOKEN=short", "é token==abcdef ü passwd: \"x.y-z_1\"",
    "AKIA" + "A" * 15 + " AKIA" + "B" * 16 + "ü AKIAAKIA" + "C" * 20, "deadbeef" * 3 + " " + "a" * 23 + "g" + "0" * 30, "token=" + "ab12" * 10,
    "😀😀 secret: zzzzzzzz 😀 apikey=\x20\x20qqqqqq", "password password=aaaaaa,password=bbbbbb", "x" * 50000 + " token: abcdefgh", "-----BEGIN RSA PRIVATE KEY----- key ghp_" + "a1" * 20,
]


def slow(text):
    spans = []
    for no, (kind, (pattern, group, least)) in enumerate(PATTERNS.items()):
        spans += [(m.start(), no, kind, m.end()) for m in pattern.finditer(text or "") if len(m[group]) >= least]
    return sorted(spans)


def frame(spark):
    return spark.createDataFrame([(i, t, "b") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "c"), (None, TEXTS[5], None)], "doc_id long, text string, blob string")


def test_spans_match_a_plain_scan(spark, tmp_path):
    df = frame(spark)
    df.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in secrets.query(spark, str(tmp_path)).collect()}
    assert len(got) == len(TEXTS) + 1
    for i, t in enumerate(TEXTS):
        want = slow(t)
        base = ",".join(f"{k}:{a}:{b}" for a, _, k, b in want)
        assert [got[i][f"n_{k}"] for k in PATTERNS] == [sum(x[2] == k for x in want) for k in PATTERNS], t
        assert got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert [x for x in got[i].spans.split(",") if x.split(":")[0] in PATTERNS] == (base.split(",") if base else [])
    assert "pem:0:31" in got[13].spans and "forge:36:80" in got[13].spans


def test_only_unseen_pairs_are_scanned(spark):
    df = frame(spark)
    old = secrets.RULES[:2]
    ledger = secrets.update(df, None, old)
    assert ledger.count() == 2 * len({t or "" for t in TEXTS})
    todo = secrets.unseen(df, ledger, secrets.RULES)
    assert {tuple(r.todo) for r in todo.collect()} == {("hex@1", "pem@1", "forge@1")}
    assert secrets.unseen(df, ledger, old).count() == 0
    newer = (old[0]._replace(version=2), old[1])
    assert {tuple(r.todo) for r in secrets.unseen(df, ledger, newer).collect()} == {("assign@2",)}
    more = df.unionByName(spark.createDataFrame([(99, "token=abcdefgh", "z")], df.schema))
    assert secrets.unseen(more, ledger, old).count() == 1
    both = secrets.update(more, ledger, secrets.RULES)
    assert both.groupBy("blob", "rule").count().filter("count > 1").count() == 0
    found = secrets.findings(more, both, ["doc_id", "blob"][:1])
    assert found.filter("doc_id = 99").first().spans[0].stop == 14


def test_masking(spark):
    df = frame(spark).withColumn("n_chars", F.length("text").cast("long"))
    got = secrets.redacted(df)
    assert got.columns == df.columns and got.count() == df.count()
    rows = {r.doc_id: r for r in got.collect()}
    assert rows[3].text == "[SECRET]" and rows[3].n_chars == 8
    assert rows[9].text == "[SECRET]" and rows[2].text == "nothing here" and rows[1].text is None
    assert rows[10].text == "😀😀 [SECRET] 😀 [SECRET]"


def test_a_kept_ledger_is_scanned_once(spark, tmp_path, monkeypatch):
    df, path = frame(spark), str(tmp_path / "ledger")
    scanned = []
    own = secrets.scan
    monkeypatch.setattr(secrets, "scan", lambda todo, rules: scanned.append({(r.blob, k) for r in todo.collect() for k in r.todo}) or own(todo, rules))
    secrets.extend(df.filter("doc_id < 6"), path, secrets.RULES[:3])
    whole = secrets.extend(df, path)
    assert scanned[0] and scanned[1] and not scanned[0] & scanned[1]
    again = secrets.extend(df, path)
    assert scanned[2] == set() and again.count() == whole.count() == len(scanned[0] | scanned[1])
    once = secrets.findings(df, secrets.update(df), ["doc_id"])
    key = lambda x: sorted(map(str, x.collect()))
    assert key(secrets.findings(df, again, ["doc_id"])) == key(once)
    again.write.mode("append").parquet(str(tmp_path / "twice"))  # a batch written twice
    again.write.mode("append").parquet(str(tmp_path / "twice"))
    assert key(secrets.findings(df, secrets.read_ledger(spark, str(tmp_path / "twice")), ["doc_id"])) == key(once)


def test_many_matches_take_linear_time(spark):
    import time

    def took(n):
        text = " x ".join(f"token={i:08d}ü AKIA{'Z' * 16}{i:08d}" for i in range(n))
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.time()
        row = secrets.redacted(df).first()
        assert row.text == " x ".join(["[SECRET]ü [SECRET]"] * n)
        spans = secrets.findings(df, secrets.update(df), ["doc_id"]).first().spans
        assert [(x.start, x.stop) for x in spans if x.kind != "hex"] == sorted((a, b) for a, _, k, b in slow(text) if k != "hex")
        return time.time() - began

    took(300)
    few = took(4000)
    assert took(16000) < 8 * few + 4


def test_overlapping_spans_are_one_mask(spark):
    texts = ["token=" + "ab12" * 10 + " end", "secret=AKIA" + "Q" * 20 + "x", "a token=abcdef/" + "0" * 30 + "password=zzzzzz", "x" * 3_000_000 + " token=abcdefgh ü"]
    got = [r.text for r in secrets.redacted(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    for text, own in zip(texts, got, strict=True):
        hidden, at, want = sorted((a, b) for a, _, _, b in slow(text)), 0, ""
        while hidden:
            a, b = hidden.pop(0)
            while hidden and hidden[0][0] < b:
                b = max(b, hidden.pop(0)[1])
            want, at = want + text[at:a] + "[SECRET]", b
        assert own == want + text[at:]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert secrets.findings(df, secrets.update(df), ["doc_id"]).count() == 0
