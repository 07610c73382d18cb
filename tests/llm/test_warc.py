from __future__ import annotations

import hashlib

import pytest

from factloom.llm import warc

LONG = "é<p>" * 40


def pages(spark):
    rows = [(5, "http://a", LONG), (3, "http://b", LONG), (9, "http://c", LONG), (1, "http://d", "short"), (2, "http://e", "short"), (4, None, None), (6, "http://f", "x" * 5000), (7, "http://g", ""), (8, "http://h", "y" * 100), (10, "http://h", "y" * 100), (11, "http://i", "\r\n\r\nWARC/1.1")]
    return spark.createDataFrame([(*r, "clash", 0) for r in rows], "page_id long, url string, html string, digest string, size int")


@pytest.mark.parametrize("chunk", [7, 64, 1 << 18])
def test_round_trip(spark, tmp_path, chunk):
    df, path = pages(spark), str(tmp_path / "w")
    warc.write(df, path, chunk)
    got = {r.page_id: r for r in warc.read(spark, path).collect()}
    first = {}
    rows = sorted((r.page_id, (r.html or "").encode()) for r in df.collect())
    for page, body in rows:
        least = first.setdefault(body, page)
        want = ("revisit", least) if len(body) >= 100 and least != page else ("response", None)
        r = got.pop(page)
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(body), hashlib.sha256(body).hexdigest(), *want)
    assert not got
    assert max(len(r.data) for r in spark.read.parquet(path).filter("chunk_no > 0").collect()) <= chunk + 4


def test_odd_urls(spark, tmp_path):
    urls = {1: "http://a\r\nb", 2: "x\r\nWARC-Type: revisit\r\n\r\n", 3: " ", 4: "no colon", 5: ": a: b", 6: "\x00\x7f\t", 7: "http://ü/漢?q=1", 8: "%0D%0A", 9: None}
    rows = [(k, u, f"body {k}") for k, u in urls.items()]
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "w"))
    got = {r.page_id: r for r in warc.read(spark, str(tmp_path / "w")).collect()}
    for k, u, body in rows:
        assert got[k].url == "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in u or "")
        assert (got[k].record_type, got[k].payload_digest) == ("response", hashlib.sha256(body.encode()).hexdigest())


def test_a_long_payload_is_streamed(spark, tmp_path):
    body = "é<p>word</p>" * 400_000
    warc.write(spark.createDataFrame([(1, "u", body), (2, "v", body), (3, "w", "x")], "page_id long, url string, html string"), str(tmp_path / "w"))
    chunks = spark.read.parquet(str(tmp_path / "w"))
    assert chunks.filter("payload_in_chunk > 0").count() == -(-len(body.encode()) // warc.CHUNK) + 1
    got = {r.page_id: tuple(r) for r in warc.read(spark, str(tmp_path / "w")).drop("url").collect()}
    digest = hashlib.sha256(body.encode()).hexdigest()
    assert got[1] == (1, len(body.encode()), digest, "response", None) and got[2] == (2, len(body.encode()), digest, "revisit", 1)


def test_archive_is_plain_warc(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write(pages(spark), path, 50)
    data, seen = b"".join(warc.archive_bytes(spark, path)), 0
    while data:
        head, rest = data.split(b"\r\n\r\n", 1)
        size = int(warc.parse_header(head)["Content-Length"])
        assert rest[size : size + 4] == b"\r\n\r\n"
        data, seen = rest[size + 4 :], seen + 1
    assert seen == 11


def test_damage_is_found(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write(pages(spark), path)
    from pyspark.sql import functions as F

    bad = spark.read.parquet(path).withColumn("data", F.when(F.col("chunk_no") == 1, F.concat(F.lit(b"!"), F.col("data"))).otherwise(F.col("data")))
    bad.write.parquet(str(tmp_path / "bad"))
    with pytest.raises(Exception, match="damaged"):
        warc.read(spark, str(tmp_path / "bad")).collect()


def test_repeated_rows_and_empty(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", LONG), (1, "u", LONG), (None, "u", LONG)], "page_id long, url string, html string")
    warc.write(df, str(tmp_path / "w"))
    got = sorted((str(r.page_id), r.record_type, r.refers_to) for r in warc.read(spark, str(tmp_path / "w")).collect())
    assert got == [("1", "response", None), ("1", "response", None), ("None", "revisit", 1)]
    warc.write(df.limit(0), str(tmp_path / "e"))
    assert warc.read(spark, str(tmp_path / "e")).count() == 0


@pytest.mark.parametrize(("chunk", "lost"), [(1 << 18, 0), (1 << 18, 1), (50, 1), (50, 2)])
def test_a_lost_chunk_is_found(spark, tmp_path, chunk, lost):
    path = str(tmp_path / "w")
    warc.write(pages(spark), path, chunk)
    rows = spark.read.parquet(path)
    one = rows.filter("payload_in_chunk > 0").orderBy("n_chunks", ascending=False).first().record_id
    rows.filter(~((rows.record_id == one) & (rows.chunk_no == lost))).write.parquet(str(tmp_path / "less"))
    with pytest.raises(Exception, match="was due|is missing"):
        warc.read(spark, str(tmp_path / "less")).collect()


def test_payloads_stay_in_place(spark, tmp_path):
    """What is dealt by record are notes; no exchange carries the data of small records."""
    path = str(tmp_path / "w")
    warc.write(pages(spark), path)
    plan = warc.read(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(record_id" in plan and plan.count("MapInArrow noted") == 1
