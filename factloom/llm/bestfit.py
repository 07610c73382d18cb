"""Best-fit packing with large-item matching: token ids into as few sequences as can be.

A document longer than the capacity is cut into pieces of the capacity, its first piece may be shorter; no other document is cut.
Pieces above a third of the capacity are large: no sequence holds three. Large ones are matched greedily, longest first with the
longest that fits beside it, which gives as many pairs as there can be. Smaller pieces, longest first, go where they fit best.

What is planned are lengths, not documents: pieces of one length are alike, and there are at most as many lengths as the capacity. So one
count for each length reaches the driver, and the plan that comes back, a list of steps "pieces number a to b of this length go to
sequences c to d, so many each, at this place", has a size that the capacity bounds, whatever the corpus holds. The packing is that of the
whole corpus, not of its partitions. Each piece then finds its step by its length and its number among the pieces of that length.

Numbers come from counts: tasks number their own pieces of each length, and the counts of the tasks before are added, joined by (task, length), so
that a length that a third of all pieces have is dealt out over all tasks. Texts are read once and never shuffled.

Null and empty texts are the end id alone. Repeated rows are packed as often as they come, rows without id under a null id. Very long texts
are encoded whole. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, tokens

CAPACITY = 2048
END = b"\0\0\0\0"

PIECES = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "piece", "start", "length", "ids_crc32", "task", "number")])


class Plan:
    """Steps in order of (length, first number): arrays length, first, sequence, each, offset. Sequences are numbered from 0 to sequences - 1."""

    def __init__(self, steps: list[tuple[int, int, int, int, int]], sequences: int):
        self.length, self.first, self.sequence, self.each, self.offset = np.array(sorted(steps), np.int64).reshape(-1, 5).T
        self.sequences = sequences

    def place(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces by their length and number."""
        at = np.empty(len(length), np.int64)
        for n in np.unique(length):
            low, high = np.searchsorted(self.length, [n, n + 1])
            own = length == n
            at[own] = low + np.searchsorted(self.first[low:high], number[own], "right") - 1
        past = number - self.first[at]
        return self.sequence[at] + past // self.each[at], self.offset[at] + past % self.each[at] * length


class Bins:
    """Sequences by the room they have left, as stretches of consecutive numbers."""

    def __init__(self):
        self.rooms: list[int] = []  # ascending
        self.stretches: dict[int, list[tuple[int, int]]] = {}  # room: (first sequence, how many)

    def add(self, room: int, first: int, count: int) -> None:
        if count and room:
            if room not in self.stretches:
                bisect.insort(self.rooms, room)
                self.stretches[room] = []
            self.stretches[room].append((first, count))

    def take(self, least: int) -> tuple[int, int, int] | None:
        """A stretch (room, first, count) of the least room that has so much; it is no longer held."""
        k = bisect.bisect_left(self.rooms, least)
        if k == len(self.rooms):
            return None
        room = self.rooms[k]
        first, count = self.stretches[room].pop()
        if not self.stretches[room]:
            del self.stretches[room], self.rooms[k]
        return room, first, count


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """The steps for so many pieces of each length; lengths from 1 to the capacity. Time and steps are bounded by the capacity, not by the counts."""
    steps: list[tuple[int, int, int, int, int]] = []
    left, used, bins, opened = Counter(counts), Counter(), Bins(), 0

    def put(length: int, pieces: int, sequence: int, each: int, offset: int) -> None:
        steps.append((length, used[length], sequence, each, offset))
        used[length] += pieces
        left[length] -= pieces

    large = sorted(n for n in counts if 3 * n > capacity)
    for a in reversed(large):  # the longest that is left, with the longest that fits beside it
        while left[a]:
            partners = [b for b in large[: bisect.bisect_right(large, capacity - a)] if left[b] > (b == a)]
            b = partners[-1] if partners else 0
            pairs = (left[a] // 2 if a == b else min(left[a], left[b])) if b else left[a]
            put(a, pairs, opened, 1, 0)
            if b:
                put(b, pairs, opened, 1, a)
            bins.add(capacity - a - b, opened, pairs)
            opened += pairs
    for n in sorted((n for n in counts if 3 * n <= capacity), reverse=True):
        while left[n]:
            room, first, held = bins.take(n) or (capacity, opened, -(-left[n] // (capacity // n)))
            opened = max(opened, first + held)
            each = room // n  # once it fits best somewhere, that is where it fits best again
            full = min(held, left[n] // each)
            if full:
                put(n, full * each, first, each, capacity - room)
                bins.add(room - each * n, first, full)
            rest = min(left[n], each - 1) if full < held else 0
            if rest:
                put(n, rest, first + full, rest, capacity - room)
                bins.add(room - rest * n, first + full, 1)
            bins.add(room, first + full + bool(rest), held - full - bool(rest))
    return Plan(steps, opened)


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """A row for each piece of a document with its checksum, the task that made it, and its number among that task's pieces of its length."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        encoder, task, seen = tokens.encoder(vocabulary), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            for part in common.slices(batch, "text"):
                columns: list[list] = [[] for _ in PIECES]
                for doc, raw in zip(part.column(0).to_pylist(), encoder.encode(common.texts_of(part, "text")), strict=True):
                    whole = memoryview(raw + END)
                    total, start, piece = len(whole) // 4, 0, 0
                    while start < total:
                        length = (total - start) % capacity or capacity
                        row = (doc, piece, start, length, zlib.crc32(whole[4 * start : 4 * (start + length)]), task, seen[length])
                        for c, v in zip(columns, row, strict=True):
                            c.append(v)
                        seen[length] += 1
                        start, piece = start + length, piece + 1
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=PIECES.names)

    return source.mapInArrow(run, PIECES)


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """A row for each piece: where it comes from, its checksum, the sequence that it is in and its place there."""
    rows = common.written(pieces(docs, id_col, text_col, capacity, vocabulary), "bestfit-pieces")
    counts = rows.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = common.written(counts.withColumn("before", before), "bestfit-counts")
    totals = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most one for each length up to the capacity
    steps = plan(totals, capacity)
    names = ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    schema = T.StructType([T.StructField(n, T.IntegerType() if n == "piece" else T.LongType()) for n in names])

    def run(batches):
        for batch in batches:
            own = pa.RecordBatch.from_pydict({n: batch.column(n) for n in names[:5]})
            sequence, offset = steps.place(batch.column("length").to_numpy(), batch.column("number").to_numpy())
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(1).cast(pa.int32()), *own.columns[2:], pa.array(sequence), pa.array(offset)], names=list(names))

    numbered = rows.join(counts.select("task", "length", "before"), ["task", "length"]).withColumn("number", F.col("number") + F.col("before"))
    return numbered.select(*names[:5], "number").mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(common.table(spark, sf_dir, "documents"))
