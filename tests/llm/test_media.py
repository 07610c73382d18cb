from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import media


def slow_decode(image):
    """One frame, bit by bit."""
    rows, width, data = media.parse_frame(image)
    bits = "".join(f"{b:08b}" for b in data)
    codes = {f"{int(media.CODES[c]):0{n}b}": c for c, n in enumerate(media.LENGTHS)}
    out, at = [], 0
    for _ in range(rows * width):
        n = next(n for n in range(1, 17) if bits[at : at + n] in codes)
        c, at = codes[bits[at : at + n]], at + n
        v = int(bits[at : at + c] or "0", 2)
        at += c
        d = v if c == 0 or v >> (c - 1) else v - (1 << c) + 1
        k = len(out)
        left = 128 if k == 0 else out[k - width] if k % width == 0 else out[k - 1]
        out.append((left + d) % 256)
    assert set(bits[at:]) <= {"1"} and len(bits) - at < 8
    return bytes(out)


def payloads():
    rng = random.Random(4)
    return [b" " * 192, bytes(rng.randrange(256) for _ in range(192 * 17)), bytes([0, 255] * 96 * 8), b"a" * 192 * 8, b"\xff" * 192 * 9, bytes(range(192)) * 3]


def test_codes_leave_no_bit_of_ones_unused():
    assert sum(2.0**-n for n in media.LENGTHS) <= 1


@pytest.mark.parametrize("data", payloads())
def test_frames_are_lossless_and_plain_jpeg(data):
    frames, rate = media.parse_avi(media.encode_clips([data])[0])
    assert rate == media.RATE
    assert b"".join(map(slow_decode, frames)) == data


def test_clips_of_all_sizes_decode_together():
    data = payloads() * 3
    got = media.decode_clips(media.encode_clips(data))
    assert [b"".join(x.tobytes() for x in frames) for frames, _ in got] == data


def test_frames_of_any_number_at_once_give_the_same(monkeypatch):
    data = payloads()
    want = media.encode_clips(data)
    for n in (1, 2, 3):
        monkeypatch.setattr(media, "AT_ONCE", n)
        assert media.encode_clips(data) == want
        assert [b"".join(x.tobytes() for x in f) for f, _ in media.decode_clips(want)] == data


def test_memory_of_a_very_long_text():
    """Some ten times the text, not a hundred."""
    import subprocess
    import sys

    code = """
import resource
from factloom.llm import media
base = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
text = "".join(chr(97 + i * i % 23) for i in range(1000)) * 30_000
data = media.encode_clips([media.payload_of(text)])
for frames, rate in media.decode_clips(data):
    got = b"".join(x.tobytes() for x in frames)
assert got.rstrip() == text.encode()
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - base) // 1024)
"""
    grown = int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout)
    assert grown < 600, grown


def test_shots():
    a, b = np.full((8, 192), 10, np.uint8), np.full((8, 192), 200, np.uint8)
    assert media.shots([a, a, b, b, b, a])[0] == [0, 2, 5]
    assert media.shots([a])[0] == [0]


def test_query(spark, tmp_path):
    texts = ["", None, "short", "é" * 500, "x" * 30000, "short"]
    df = spark.createDataFrame([(i, t, b"z") for i, t in enumerate(texts)], "doc_id long, text string, media binary")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r for r in media.query(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        want = raw + b" " * (-len(raw) % 192 or (192 if not raw else 0))
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-16:]))
    assert rows[2][1:] == rows[5][1:] and rows[0][1:] == rows[1][1:]
    files = media.stored(df, ["doc_id"])
    assert {r.doc_id: hashlib.sha256(r.media).hexdigest() for r in files.collect()} == {k: r.media_sha256 for k, r in rows.items()}
    total = media.clips(files).groupBy("doc_id").agg(F.sum("n_frames").alias("n")).collect()
    assert {r.doc_id: r.n for r in total} == {0: 1, 1: 1, 2: 1, 3: 1, 4: 20, 5: 1}
    assert media.query(spark, str(tmp_path)).filter("false").count() == 0
