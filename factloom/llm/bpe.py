"""Byte-level BPE by rank file: monoid tree reduction.

A piece (a match of the split pattern) longer than LEAF bytes is cut in halves, which are
encoded recursively and joined. The join re-encodes a window of the last tokens on the left
and the first on the right and grows it until the tokens outside stay as they are. That is
decided by pairs: a token sequence is the encoding of its bytes exactly if each two
neighbours are the encoding of their joint bytes (no merge across a boundary can
precede one that the pair alone would show). Inside the window and outside it this holds already, so
two pairs at the window's edges prove the whole. Pieces of a text are never joined by
merges, so the text's ids are the concatenation of theirs. Decoding is the same tree: leaves of LEAF_IDS
ids are looked up, and halves concatenated upwards; all steps are associative, so any tree gives the same.

Null text: empty, no ids. Texts of any length; memory is bounded by a slice of texts
and the worker's memories, which hold words and pieces of at most WORD_CHARS characters. Repeated rows give equal
values; an empty table an empty result. Other columns of any name aren't read.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from itertools import chain

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import common
from .tokens import MATCH, PLAIN, WORD_CHARS, Memory, words_of

LEAF = 8
#: Ids that decoding joins at once, below the tree.
LEAF_IDS = 256
#: Remembered pairs of neighbours.
PAIRS = 1 << 18


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class TreeCodec:
    def __init__(self, path: str | None = None, pattern: str = public_tokenizers.PATTERN):
        self.ranks = read_ranks(path or public_tokenizers.path("byte_bpe_50k.tiktoken"))
        self.token = {v: k for k, v in self.ranks.items()}
        self.decimal = {v: str(v) for v in self.token}
        self.split = regex.compile(pattern)
        self.default_pattern = pattern == public_tokenizers.PATTERN
        self.words, self.pieces, self.pairs = Memory(), Memory(), {}

    def leaf(self, data: bytes) -> list[int]:
        """Plain merging: again and again the leftmost pair of least rank."""
        ranks = self.ranks
        if data in ranks:
            return [ranks[data]]
        parts = [data[i : i + 1] for i in range(len(data))]
        get, none = ranks.get, len(ranks)
        found = [get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while found:
            best = min(found)
            if best == none:
                break
            i = found.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del found[i]
            if i:
                found[i - 1] = get(parts[i - 1] + parts[i], none)
            if i < len(found):
                found[i] = get(parts[i] + parts[i + 1], none)
        return [ranks[x] for x in parts]

    def stable(self, a: int, b: int) -> bool:
        """Whether a followed by b is the encoding of their joint bytes."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            known = self.pairs[a, b] = self.leaf(self.token[a] + self.token[b]) == [a, b]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the concatenated bytes of two encodings."""
        if not left or not right:
            return left or right
        size = 1
        while True:
            a, b = left[-size:], right[:size]
            middle = self.leaf(b"".join(map(self.token.__getitem__, a + b)))
            if (size >= len(left) or self.stable(left[-size - 1], middle[0])) and (size >= len(right) or self.stable(middle[-1], right[size])):
                return left[:-size] + middle + right[size:]
            size *= 2

    def piece(self, data: bytes) -> list[int]:
        if len(data) <= LEAF or data in self.ranks:
            return self.leaf(data)
        middle = len(data) // 2
        return self.join(self.piece(data[:middle]), self.piece(data[middle:]))

    def pieces_of(self, text: str) -> list[str]:
        return (MATCH if self.default_pattern and PLAIN.fullmatch(text) else self.split).findall(text)

    def word(self, text: str) -> list[int]:
        """The ids of a text, piece by piece; short pieces are remembered."""
        out: list[int] = []
        for x in self.pieces_of(text):
            ids = self.pieces[x]
            if ids is None:
                ids = self.piece(x.encode())
                if len(x) <= WORD_CHARS:
                    self.pieces[x] = ids
            out += ids
        return out

    def encode(self, text: str) -> list[int]:
        words = words_of(text) if self.default_pattern else None
        if words is None:
            return self.word(text)
        known, long = self.words, []
        for x in set(words):
            if known[x] is None:
                known[x] = self.word(x)
                if len(x) > WORD_CHARS:
                    long.append(x)
        out = list(chain.from_iterable(map(known.__getitem__, words)))
        for x in long:
            del known[x]
        known.trim()
        self.pieces.trim()
        return out

    def decode(self, ids: list[int]) -> bytes:
        parts = [b"".join(map(self.token.__getitem__, ids[i : i + LEAF_IDS])) for i in range(0, len(ids), LEAF_IDS)]
        while len(parts) > 1:  # a level of the tree: neighbours concatenated
            parts = [b"".join(parts[i : i + 2]) for i in range(0, len(parts), 2)]
        return parts[0] if parts else b""


@functools.lru_cache(maxsize=2)
def codec(path: str | None = None) -> TreeCodec:
    return TreeCodec(path)


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """id and the whole text's ids."""

    def make():
        own = codec(vocabulary)
        return lambda texts: [pa.array([own.encode(x) for x in texts], pa.list_(pa.int32()))]

    return common.map_texts(docs, text_col, make, [T.StructField("ids", T.ArrayType(T.IntegerType()))], [id_col])


def decoded(rows: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """id and the bytes of a row's ids; null ids give no bytes."""
    schema = T.StructType([rows.schema[id_col], T.StructField("bytes", T.BinaryType())])

    def run(batches):
        own = codec(vocabulary)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.decode(x or []) for x in batch.column(1).to_pylist()], pa.binary())], names=schema.names)

    return rows.select(id_col, ids_col).mapInArrow(run, schema)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Digests of the ids and of the bytes decoded from them. Both steps are one narrow stage, so ids aren't stored."""
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]

    def make():
        own = codec(vocabulary)
        decimal = own.decimal.__getitem__

        def compute(texts):
            sizes, ids_sha, out_sha = [], [], []
            for x in texts:
                ids = own.encode(x)
                sizes.append(len(ids))
                ids_sha.append(hashlib.sha256(" ".join(map(decimal, ids)).encode()).hexdigest())
                out_sha.append(hashlib.sha256(own.decode(ids)).hexdigest())
            return pa.array(sizes, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(out_sha, pa.string())

        return compute

    return common.map_texts(docs, text_col, make, fields, [id_col])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(common.table(spark, sf_dir, "documents"))
