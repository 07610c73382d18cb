"""Packing: hierarchical multi-length packing of token ids into training sequences.

Tiers are the powers of two up to the longest context. A document longer than that gives
full sequences first; what remains is routed to the tier that it fills at least
half. Tiers are packed one after another, longest first: a window is opened by the longest document of its tier, its gap is
filled best-fit from the tiers below, at last by a cut piece, whose rest is routed anew. What is left at the end of a group is cut into
powers of two, largest first, so that no sequence needs padding.

Groups are consecutive runs of documents of one input split with about GROUP_TOKENS ids:
no shuffle, no key, so no skew; memory is bounded by a group and its last document.
Sequences of a group are dealt into step groups: sorted by length and dealt to and fro,
so that each step has about the same number of ids.

Null and empty texts are the end id alone. Repeated rows are packed as often as they
come. Sequence ids are unique, from the split's number and a count. An empty table gives
no rows. Other columns are not read.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, tokens

LONGEST = 1024
SHORTEST = 64
GROUP_TOKENS = 1 << 20
STEP_SEQUENCES = 64
END = b"\0\0\0\0"

SCHEMA = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens", "step_group")]
)


def tiers(longest: int = LONGEST, shortest: int = SHORTEST) -> list[int]:
    """Context sizes, longest first."""
    out = [longest]
    while out[-1] // 2 >= shortest:
        out.append(out[-1] // 2)
    return out


def pack(lengths: list[int], longest: int = LONGEST, shortest: int = SHORTEST) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length); every id of every document is in exactly one."""
    sizes = tiers(longest, shortest)
    done: list[list[tuple[int, int, int]]] = []
    waiting: dict[int, list[tuple[int, int, int]]] = {t: [] for t in sizes}  # by tier: (length, document, start), shortest first

    def tier(length: int) -> int:
        """The smallest context that holds it: it fills more than half of that, or it is of the smallest one."""
        return next((t for t in reversed(sizes) if t >= length), longest)

    for doc, n in enumerate(lengths):
        full = n // longest
        done += [[(doc, k * longest, longest)] for k in range(full)]
        if rest := n - full * longest:
            if rest in waiting:
                done.append([(doc, full * longest, rest)])
            else:
                waiting[tier(rest)].append((rest, doc, full * longest))
    for own in waiting.values():
        own.sort()
    for size in sizes:  # windows of a tier are opened by its own documents, longest first
        while waiting[size]:
            length, doc, start = waiting[size].pop()
            pieces, gap = [(doc, start, length)], size - length
            while gap:
                # the longest document that fits, from the largest tier that has one
                at, k = next(((t, k) for t in sizes if t <= size and waiting[t] and (k := bisect.bisect_right(waiting[t], (gap, 1 << 62, 0)))), (0, 0))
                if k:
                    length, doc, start = waiting[at].pop(k - 1)
                    pieces.append((doc, start, length))
                    gap -= length
                elif least := next((t for t in reversed(sizes) if waiting[t]), 0):  # none fits: a cut of the shortest fills the gap, the rest goes to its tier
                    length, doc, start = waiting[least].pop(0)
                    pieces.append((doc, start, gap))
                    bisect.insort(waiting[tier(length - gap)], (length - gap, doc, start + gap))
                    gap = 0
                else:
                    break
            if gap:  # the last of the group: cut into tiers
                done += split_last(pieces, size - gap)
            else:
                done.append(pieces)
    return done


def split_last(pieces: list[tuple[int, int, int]], total: int) -> list[list[tuple[int, int, int]]]:
    """The pieces cut into sequences whose lengths are powers of two, largest first."""
    out, at, used = [], 0, 0
    while total:
        room = size = 1 << (total.bit_length() - 1)
        sequence = []
        while room:
            doc, start, length = pieces[at]
            take = min(room, length - used)
            sequence.append((doc, start + used, take))
            room, used = room - take, used + take
            if used == length:
                at, used = at + 1, 0
        out.append(sequence)
        total -= size
    return out


def step_groups(lengths: list[int], step: int = STEP_SEQUENCES) -> list[int]:
    """A step for each sequence: by falling length, dealt to and fro."""
    groups = max(1, -(-len(lengths) // step))
    out = [0] * len(lengths)
    for rank, k in enumerate(sorted(range(len(lengths)), key=lambda k: -lengths[k])):
        turn, place = divmod(rank, groups)
        out[k] = place if turn % 2 == 0 else groups - 1 - place
    return out


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST, vocabulary: str | None = None) -> DataFrame:
    """A row for each piece: where it comes from, its checksum, the sequence it is in and the place there."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def emit(ids: list, encoded: list[bytes], first: int, first_step: int):
        sequences = pack([len(x) // 4 for x in encoded], longest)
        totals = [sum(p[2] for p in s) for s in sequences]
        steps = step_groups(totals)
        columns: list[list] = [[] for _ in SCHEMA]
        for k, pieces in enumerate(sequences):
            offset = 0
            for doc, start, length in pieces:
                whole = encoded[doc]
                row = (ids[doc], start, length, zlib.crc32(memoryview(whole)[4 * start : 4 * (start + length)]), len(whole) // 4, first + k, offset, totals[k], first_step + steps[k])
                for c, v in zip(columns, row, strict=True):
                    c.append(v)
                offset += length
        batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=SCHEMA.names)
        return batch, first + len(sequences), first_step + max(steps, default=-1) + 1

    def run(batches):
        encoder, base = tokens.encoder(vocabulary), TaskContext.get().partitionId() << 40
        sequence, step, ids, encoded, held = base, base, [], [], 0
        for batch in batches:
            for part in common.slices(batch, "text"):
                ids += part.column(0).to_pylist()
                fresh = [x + END for x in encoder.encode(common.texts_of(part, "text"))]
                encoded += fresh
                held += sum(map(len, fresh)) // 4
                if held >= GROUP_TOKENS:
                    out, sequence, step = emit(ids, encoded, sequence, step)
                    yield out
                    ids, encoded, held = [], [], 0
        if ids:
            yield emit(ids, encoded, sequence, step)[0]

    return source.mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(common.table(spark, sf_dir, "documents"))
