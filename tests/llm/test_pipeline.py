from __future__ import annotations

import math
import random
import re
import unicodedata
import zlib
from collections import Counter

import __spark_entry__
import corpus_pipeline
import numpy as np
import public_tokenizers
from factloom.llm import common, toxicity
from test_models import slow_logit
from test_secrets import PATTERNS
from test_simhash import brute_components, slow_fingerprint
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = common.table(spark, SF, "documents")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "simhash_dedup", "secret_scan", "packing"]
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.written(stage(spark, docs, SF), name)
        assert docs.columns == columns
        left = docs.count()
        assert 0.5 * n < left <= n
        if name == "simhash_dedup":
            assert left < n and docs.select("doc_id").distinct().count() == left
        if name == "secret_scan":
            assert left == n
        n = left
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == n


def test_queries_are_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and {f"op{i}" for i in range(1, 11)} == {x.split("_")[0] for x in names if x.startswith("op")}


def test_empty(spark):
    docs = common.table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


MASKED = [*((p, g, n) for p, g, n in PATTERNS.values()), (re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----"), 0, 1), (re.compile(r"gh[opsu]_[A-Za-z0-9]{36,}"), 0, 40)]


def slow_redaction(text):
    hidden = sorted((m.start(), m.end()) for p, g, n in MASKED for m in p.finditer(text) if len(m[g]) >= n)
    out, at = "", 0
    while hidden:
        a, b = hidden.pop(0)
        while hidden and hidden[0][0] < b:
            b = max(b, hidden.pop(0)[1])
        out, at = out + text[at:a] + "[SECRET]", b
    return out + text[at:]


def planted():
    """(doc_id, text, lang, toxic): clean, toxic, copied, letterless, null, secret, repeated and very long documents."""
    rng = random.Random(12)
    plain, bad = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(500)], ["idiot", "scum", "clown"]
    rows = []

    def add(text, toxic=0, lang="en"):
        rows.append((len(rows), text, lang, toxic))
        return text

    for i in range(90):
        own = rng.choices(plain, k=rng.randint(30, 90))
        if i % 3 == 0:
            for at in rng.sample(range(len(own)), 4):
                own[at] = rng.choice(bad)
        add(" ".join(own), int(i % 3 == 0), rng.choice(["en", "de"]))
    for i in (1, 2, 4, 5):
        add(rows[i][1])
        words = rows[i][1].split()
        add(" ".join([*words[:-1], "zz"]))
    add("123 ... 456")
    add(None)
    add("")
    add("é")
    add(" ".join(rng.choices(plain, k=40)) + " password=hunter22 token: abcdefgh AKIA" + "B" * 20 + " " + "0f" * 20)
    add(" ".join(rng.choices(plain, k=30_000)))
    return rows


def test_run_is_brute_force(spark, tmp_path, monkeypatch):
    rows = planted()
    told = [(i, t, lang, "src", len(t or ""), "x", 1.5) for i, t, lang, _ in rows]
    told += [told[7], (None, " ".join(f"only{k}" for k in "abcdefghij"), "en", None, 3, None, None), (None, None, None, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, spans string, score double"
    spark.createDataFrame(told, schema).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, x) for i, _, _, x in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    monkeypatch.setattr(toxicity, "LEAST_BATCHES", 80)
    models, own = [], toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda *a: models.append(own(*a)) or models[-1])
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    model = models[0]
    left = [r for r in told if any(unicodedata.category(c)[0] == "L" for c in r[1] or "")]
    score = {t: 1 / (1 + math.exp(-(model.slope * slow_logit(model.parameters, t) + model.offset))) for t in {r[1] for r in left if len(r[1]) < 5000}}
    assert all(abs(x - 0.5) > 1e-3 for x in score.values())
    labelled = [r for r in rows if r[1] in score]
    score |= {r[1]: model.score(toxicity.Scorer(model.parameters)([r[1]]))[0] for r in left if len(r[1]) >= 5000}  # too long for the plain network
    left = [r for r in left if score[r[1]] < 0.5]
    assert sum(score[t] >= 0.5 for _, t, _, x in labelled if x) >= 27 and sum(score[t] >= 0.5 for _, t, _, x in labelled if not x) <= 3
    groups = brute_components([(r[0], slow_fingerprint(r[1])) for r in left])
    kept = {}
    for r, g in zip(left, groups, strict=True):
        if r[0] == g:
            kept.setdefault((r[0], slow_fingerprint(r[1])), r)
    texts = Counter(slow_redaction(r[1]) for r in kept.values())
    assert sum("[SECRET]" in t for t in texts) == 1 and len(kept) < len(left)
    ids = {r[0]: slow_redaction(r[1]) for r in kept.values()}
    assert {r.doc_id for r in got} == set(ids) and len(ids) == len(kept)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    for doc, text in ids.items():
        whole = np.array([*library.encode(text, add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted((r for r in got if r.doc_id == doc), key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(whole), zlib.crc32(whole[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(whole)
