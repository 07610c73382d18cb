"""Token ids, files, packing and byte-level BPE against the libraries themselves."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from factloom.llm import bpe, packing, tokenfiles, tokens

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
LIBRARY.encode_special_tokens = True
RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
OTHER = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})

TEXTS = ["", "Hello world", "  two  spaces \n and\tmore ", "it's we'll I'd 'tis", "straße Ärger naïve 漢字 😀😀", "<|endoftext|> x", "a" * 3000, "ab" * 777 + "!" * 99, "x\0y z", "1234 5678, 90.", " lead", "trail ", "\n\n \n x", "word " * 900]


def fuzz(n, size):
    rng = random.Random(9)
    parts = ["a", "b", "th", " ", "  ", "\n", "\t", "é", "1", "'s", "'", ".", "\xa0", "\x1c", "ß", "你", "\0", "Z", "foo", " bar,", "½", "_"]
    return ["".join(rng.choices(parts, k=rng.randint(0, size))) for _ in range(n)]


def ids_of(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def test_encoder_equals_the_library():
    texts = TEXTS + fuzz(800, 30)
    got = tokens.Encoder().encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [ids_of(x) for x in texts]


def test_encoder_with_a_tiny_memory():
    own, texts = tokens.Encoder(), TEXTS + fuzz(200, 20)
    own.words = tokens.Memory(5)
    for x in texts * 2:
        assert np.frombuffer(own.encode([x])[0], "<u4").tolist() == ids_of(x)


def test_tree_codec_equals_tiktoken():
    own = bpe.TreeCodec()
    for x in TEXTS + fuzz(600, 40):
        ids = own.encode(x)
        assert ids == OTHER.encode_ordinary(x)
        assert own.decode(ids) == x.encode()


def test_memories_hold_short_words_only():
    own = bpe.TreeCodec()
    for i in range(40):
        text = f"{i}" + "xyz" * 7000
        assert own.encode(text) == OTHER.encode_ordinary(text)
    assert max(map(len, own.words), default=0) <= tokens.WORD_CHARS and max(map(len, own.pieces), default=0) <= tokens.WORD_CHARS
    library = tokens.Encoder()
    library.encode(["word " + "y" * 50_000])
    assert max(map(len, library.words), default=0) <= tokens.WORD_CHARS


def test_decoding_is_a_tree(monkeypatch):
    own = bpe.TreeCodec()
    ids = own.encode("word ü 漢 " * 700)
    whole = own.decode(ids)
    for leaf in (1, 2, 3, 1 << 20):
        monkeypatch.setattr(bpe, "LEAF_IDS", leaf)
        assert own.decode(ids) == whole == ("word ü 漢 " * 700).encode()
    assert own.decode([]) == b""


def test_very_long_texts(spark):
    rng = random.Random(4)
    words = [f"w{i}ü" for i in range(3000)]
    text = " ".join(rng.choices(words, k=300_000))
    df = spark.createDataFrame([(1, text), (2, "z" * 200_000), (3, "a")], "doc_id long, text string")
    got = {r.doc_id: r for r in bpe.round_trip(df).collect()}
    packs, want = packing.packed(df).collect(), {i: OTHER.encode_ordinary(t) for i, t in ((1, text), (2, "z" * 200_000), (3, "a"))}
    for i, ids in want.items():
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and got[i].decoded_sha256 == hashlib.sha256((text, "z" * 200_000, "a")[i - 1].encode()).hexdigest()
        whole = np.array([*ids, 0], "<u4")
        pieces = sorted((r.start, r.length, r.ids_crc32) for r in packs if r.doc_id == i)
        assert [x[2] for x in pieces] == [zlib.crc32(whole[a : a + n].tobytes()) for a, n, _ in pieces] and sum(x[1] for x in pieces) == len(whole)


def test_token_files_split_shared_ids(spark, tmp_path):
    """A third of the rows without id, a third with one id: ranges still hold about equal shares."""
    rows = [(None, f"t{i % 50} a") for i in range(400)] + [(7, f"u{i % 9} b c") for i in range(400)] + [(i, f"v{i}") for i in range(10, 410)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    path = str(tmp_path / "orc")
    tokenfiles.write(df, path)
    sizes = [r["count"] for r in spark.read.orc(path).groupBy("file_no").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2 * 1200 / 4
    got, at = tokenfiles.read(spark, path).orderBy("start").collect(), 0
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids)
        at += r.n_tokens
    assert sorted(len(r.ids) for r in got) == sorted(len(ids_of(t)) + 1 for _, t in rows)


def test_tiers_take_their_own_documents(monkeypatch):
    """A window is opened by its own tier; what fills it comes from no longer tier."""
    lengths = [600, 300, 150, 100, 40, 20, 10, 700, 5, 3]
    sequences = packing.pack(lengths)
    for s in sequences:
        total = sum(n for _, _, n in s)
        if total == 1024:
            assert s[0][2] > 512
    opened = [s[0][0] for s in sequences]
    assert opened[0] == 7 and opened[1] == 0


def test_any_tree_gives_the_same():
    own, rng = bpe.TreeCodec(), random.Random(1)
    for _ in range(150):
        data = "".join(rng.choice("abcdetho ") for _ in range(rng.randint(2, 60))).replace(" ", "").encode()
        if len(data) > 1:
            cut = rng.randrange(1, len(data))
            assert own.join(own.piece(data[:cut]), own.piece(data[cut:])) == own.leaf(data)


def frame(spark):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(100, None, None), (3, TEXTS[3], "again")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, ids string")


def test_bpe_query(spark, tmp_path):
    rows, df = frame(spark)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in bpe.query(spark, str(tmp_path)).collect())
    want = []
    for i, t, _ in rows:
        ids = OTHER.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)
    back = bpe.decoded(bpe.encoded(df, "doc_id"), "doc_id")
    assert {r.doc_id: bytes(r.bytes) for r in back.collect()} == {i: (t or "").encode() for i, t, _ in rows}


def test_token_files(spark, tmp_path):
    rows, df = frame(spark)
    path = str(tmp_path / "orc")
    tokenfiles.write(df.repartition(3), path)
    got, at = [tuple(r) for r in tokenfiles.checksums(spark, path).orderBy("doc_id", "start").collect()], 0
    for (doc, start, n, crc), (i, t, _) in zip(got, sorted(rows, key=lambda r: r[0]), strict=True):
        ids = np.array([*ids_of(t or ""), 0], "<u4")
        assert (doc, start, n, crc) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += n
    found = tokenfiles.lookup(spark, path, [4]).collect()
    assert [list(r.ids) for r in found] == [[*ids_of(TEXTS[4]), 0]]
    tokenfiles.write(df.limit(0), str(tmp_path / "none"))
    assert tokenfiles.checksums(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_pack(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([1, 2, 63, 64, 100, 512, 700, 1024, 1025, 5000]) for _ in range(rng.randint(0, 120))]
    sequences = packing.pack(lengths)
    covered = {}
    for s in sequences:
        total = sum(n for _, _, n in s)
        assert 0 < total <= packing.LONGEST and total & (total - 1) == 0
        for doc, start, n in s:
            assert n > 0
            covered.setdefault(doc, []).append((start, n))
    for doc, n in enumerate(lengths):
        at = 0
        for start, size in sorted(covered[doc]):
            assert start == at
            at += size
        assert at == n
    steps = packing.step_groups([sum(n for _, _, n in s) for s in sequences], 8)
    if steps:
        assert max(map(steps.count, set(steps))) <= 8


def test_packed(spark):
    rows, df = frame(spark)
    got = packing.packed(df.repartition(2)).collect()
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, t, _ in rows:
        ids = np.array([*ids_of(t or ""), 0], "<u4")
        for r in by_doc[i]:
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        assert sum(r.length for r in by_doc[i]) == len(ids) * sum(x[0] == i for x in rows)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert packing.packed(df.filter(F.lit(False))).count() == 0


def test_memory_is_asked_once_for_each_kind_of_word():
    class Asked(tokens.Memory):
        asked = 0

        def __getitem__(self, key):
            type(self).asked += 1
            return super().__getitem__(key)

    own, texts = tokens.Encoder(), ["ab cd ab cd " * 2000 + "ab", "", " x  y", "é\x1c \n", "a\0b c"]
    own.words = Asked()
    ids, sizes = own.arrays(texts, b"\0\0\0\0")
    assert Asked.asked < 100
    ends = np.cumsum(sizes)
    assert [ids[a:b].tolist() for a, b in zip([0, *ends[:-1]], ends, strict=True)] == [[*ids_of(x), 0] for x in texts]
