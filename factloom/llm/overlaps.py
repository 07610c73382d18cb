"""Candidates for all pairs of sets with a Jaccard index of at least a threshold: complete, by prefixes of ordered sets.

Sets hold 32-bit numbers; all are put in one order, and of a set of n the first n - ceil(t n) + l are its prefix, l = 1 + n // WANTED. Two sets
with an index of at least t share ceil(t n) numbers or more, n being either size, so they share at least the lesser l of them in
their prefixes; pairs that share fewer are none. Any order is right. Numbers that slices of texts have in common come last, the commonest
at the very end, so that prefixes hold rare numbers (HEAVY numbers at most are known by that, the rest stand in the order of a hash).

Tasks deal their prefixes by a number's upper byte (pages), packed as bytes. A page gives the lists of its numbers: the owners, if they don't
all have the same label (what is linked already needs no further link). Pairs are never rows. narrowed() drops sets that are on fewer lists than
a near one would share with them, orders the lists by length and takes each set from as many of the longest as it can do without: the first list that two near sets share
stays, so they meet there. Lists of the same sets are one. Where sets meet they are told by the numbers of their lists first (candidates()): pairs that share too few, or are met on
another list, need not be looked at, and only sets with such a partner come with all their numbers. A set's owner is told by 32 bits of its key; keys that share these are told apart when lists are joined with
the keys, and form a list themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Numbers whose place at the end of the order is known.
HEAVY = 1 << 16
#: A prefix is longer by one for so many numbers of a set.
WANTED = 40
#: Numbers that a task holds before it deals them, and cells of a matrix that are filled at once.
HELD, PAIRS = 1 << 20, 1 << 21
MIX = np.uint32(0x9E3779B1)
LOW = np.uint64(0xFFFFFFFF)


def common_numbers(numbers: np.ndarray) -> np.ndarray:
    """Of the numbers of distinct sets those that two or more have, each with its count below it."""
    found, counts = np.unique(numbers, return_counts=True)
    return (found[counts > 1].astype(np.int64) << 24) | np.minimum(counts[counts > 1], (1 << 24) - 1)


def heaviest(found: DataFrame, column: str = "common") -> np.ndarray:
    """The numbers that most sets have in common, the commonest last; HEAVY of them at most reach the driver."""
    rows = found.select(F.explode(column).alias("x")).groupBy(F.shiftright("x", 24).alias("number")).agg(F.sum(F.col("x").bitwiseAND((1 << 24) - 1)).alias("n"))
    return np.array([r.number for r in rows.orderBy(F.desc("n"), "number").limit(HEAVY).collect()][::-1], np.uint32)


class Prefixes:
    """__call__(numbers, owner) -> which numbers are in their sets' prefixes. Each owner's numbers are distinct; owners ascend from 0."""

    def __init__(self, heavy: np.ndarray, threshold: float):
        self.order = np.argsort(heavy)
        self.heavy, self.threshold = heavy[self.order], threshold

    def lengths(self, n: np.ndarray) -> np.ndarray:
        return np.minimum(n, n - np.ceil(self.threshold * n - 1e-9).astype(np.int64) + 1 + n // WANTED)

    def __call__(self, numbers: np.ndarray, owner: np.ndarray) -> np.ndarray:
        place = (numbers * MIX).astype(np.uint64)
        if len(self.heavy):
            at = np.minimum(np.searchsorted(self.heavy, numbers), len(self.heavy) - 1)
            place |= np.where(self.heavy[at] == numbers, self.order[at] + 1, 0).astype(np.uint64) << np.uint64(32)
        by = np.lexsort((place, owner))
        n = np.bincount(owner) if len(owner) else np.zeros(0, np.int64)
        nth = np.arange(len(owner)) - (np.cumsum(n) - n)[owner[by]]
        return by[nth < self.lengths(n)[owner[by]]]


PAGES = "page int, numbers binary, owners binary, named binary, labels binary"


class Dealer:
    """Collects numbers with their owners' short keys and labels (0: none) and gives them by pages."""

    def __init__(self):
        self.held, self.count = [], 0

    def add(self, numbers: np.ndarray, owners: np.ndarray, labels: np.ndarray) -> None:
        self.held.append((numbers, owners, labels))
        self.count += len(numbers)

    def dealt(self):
        if not self.count:
            return
        numbers, owners, labels = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held, self.count = [], 0
        _, first = np.unique(numbers.astype(np.uint64) << np.uint64(32) | owners, return_index=True)  # exact copies fall together
        numbers, owners, labels = numbers[first], owners[first], labels[first]
        bounds = np.searchsorted(numbers, np.arange(257, dtype=np.uint64) << np.uint64(24))
        rows: list[list] = [[] for _ in range(5)]
        for page, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            if a < b:
                own = np.flatnonzero(labels[a:b]) + a
                _, once = np.unique(owners[own], return_index=True)
                own = own[once]
                # the three lower bytes as planes: the upper of a sorted list hardly take room when they are compressed
                planes = numbers[a:b].astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].T
                row = (page, planes.tobytes(), owners[a:b].astype("<u4").tobytes(), owners[own].astype("<u4").tobytes(), labels[own].astype("<i8").tobytes())
                for c, v in zip(rows, row, strict=True):
                    c.append(v)
        types = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        whole = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names=["page", "numbers", "owners", "named", "labels"])
        for at in range(0, whole.num_rows, 32):
            yield whole.slice(at, 32)


def page_lists(numbers: np.ndarray, owners: np.ndarray, named: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and their owners, of numbers whose owners have unlike labels."""
    both = np.unique(numbers.astype(np.uint64) << np.uint64(32) | owners)
    number, owner = (both >> np.uint64(32)).astype(np.int64), (both & LOW).astype(np.int64)
    if not len(number):
        return number, owner
    named, once = np.unique(named, return_index=True)
    label = owner.copy()
    if len(named):
        at = np.minimum(np.searchsorted(named, owner), len(named) - 1)
        label = np.where(named[at] == owner, labels[once][at], label)
    new = np.concatenate(([True], number[1:] != number[:-1]))
    starts = np.flatnonzero(new)
    kept = (np.minimum.reduceat(label, starts) != np.maximum.reduceat(label, starts))[np.cumsum(new) - 1]
    return number[kept], owner[kept]


def lists(pages: DataFrame, partitions: int) -> DataFrame:
    """number, short of dealt pages: who is on the list of each number."""

    def run(batches):
        at, held = None, []

        def close():
            parts = [[np.frombuffer(x[k], t) for x in held] for k, t in ((1, "<u4"), (2, "<u4"), (3, "<i8"))]
            planes = [np.frombuffer(x[0], np.uint8).reshape(3, -1).astype(np.uint32) for x in held]
            numbers = np.concatenate([p[0] | p[1] << np.uint32(8) | p[2] << np.uint32(16) for p in planes])
            number, owner = page_lists(numbers, *map(np.concatenate, parts))
            for k in range(0, len(number), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(number[k : k + (1 << 16)] | at << 24, pa.int64()), pa.array(owner[k : k + (1 << 16)], pa.int64())], names=["number", "short"])

        for batch in batches:
            for page, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if page != at and held:
                    yield from close()
                    held = []
                at = page
                held.append(row)
        if held:
            yield from close()

    return pages.repartition(partitions, "page").sortWithinPartitions("page").mapInArrow(run, "number long, short long")


def narrowed(found: DataFrame, names: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """number, key, n: lists where all near sets with unlike roots meet, and how many are on each; and key, root, size, all, kept: of every set on them the numbers
    of all its lists and of those where it meets others. found: `lists`; names: key, short, size, root of every set."""
    wanted = (1 + F.floor(F.ceil(threshold * F.col("size") - 1e-9) / WANTED)).alias("wanted")
    rows = found.join(names, "short").select("number", "key", "root", "size", wanted)
    own = Window.partitionBy("key")  # no more rows than a prefix has numbers

    def unlike(x: DataFrame) -> DataFrame:
        counts = x.groupBy("number").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high"), F.bit_xor(F.xxhash64("key")).alias("one"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("two"))
        return counts.filter("low < high").select("number", "n", "one", "two")

    rows = common.written(rows.withColumn("k", F.count("*").over(own)).filter("k >= wanted").drop("k"), "overlaps-lists")
    whole = rows.join(unlike(rows).select("number", "n"), "number")
    rows = whole.withColumns({"k": F.count("*").over(own), "place": F.row_number().over(own.orderBy("n", "number"))})
    rows = rows.filter("k >= wanted").withColumn("meets", F.expr("place <= k - wanted + 1"))
    rows = rows.select("number", "key", "root", "size", "meets")
    alike = names.groupBy("short").agg(F.count("*").alias("n")).filter("n > 1").select("short")
    same = names.join(alike, "short").select((-1 - F.col("short")).alias("number"), "key", "root", "size", F.lit(True).alias("meets"))
    rows = common.written(rows.unionByName(same), "overlaps-kept")
    once = unlike(rows.filter("meets")).groupBy("n", "one", "two").agg(F.min("number").alias("number")).select("number", "n")
    members = common.written(rows.filter("meets").join(once, "number").select("number", "key", "n"), "overlaps-members")
    numbers = F.when(F.col("number") >= 0, (F.col("number") - (1 << 31)).cast("int"))
    told = rows.groupBy("key").agg(F.first("root").alias("root"), F.first("size").alias("size"), F.collect_list(numbers).alias("all"))
    meets = members.groupBy("key").agg(F.collect_list(numbers).alias("kept"))
    return members, told.join(meets, "key")


def in_cells(members: DataFrame, block: int) -> DataFrame:
    """number, low, high, own, key: members dealt to cells. A list is cut into blocks of about so many sets, and each two of them meet in a cell: a set goes n / block times to a list of n."""
    blocks = F.ceil(F.col("n") / block)
    rows = members.select("number", "key", F.pmod(F.xxhash64("key"), blocks).alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("other"))
    return rows.select("number", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "key")


CELL = ["number", "low", "high"]


def values(column: pa.Array) -> list:
    """A column's values; lists as arrays."""
    if not pa.types.is_list(column.type):
        return column.to_pylist()
    flat, at = column.flatten().to_numpy(), np.cumsum(column.value_lengths().to_numpy()).tolist()
    return [flat[a:b] for a, b in zip([0, *at[:-1]], at, strict=True)] if at else []


def by_cell(batches):
    """(cell, rows) of a stream sorted by CELL, the first columns; the rows are without them."""
    at, of = None, []
    for batch in batches:
        for number, low, high, *row in zip(*map(values, batch.columns), strict=True):
            if (number, low, high) != at:
                if len(of) > 1:
                    yield at, of
                at, of = (number, low, high), []
            of.append(row)
    if len(of) > 1:
        yield at, of


def shared(sets: list[np.ndarray]) -> np.ndarray:
    """How many numbers each two sets have in common, by matrix products."""
    m = len(sets)
    _, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column, row = (np.cumsum(count > 1) - 1)[at], np.repeat(np.arange(m), [len(x) for x in sets])
    several = count[at] > 1
    column, row = column[several], row[several]
    by = np.argsort(column, kind="stable")
    column, row = column[by], row[by]
    step = max(1, PAIRS // m)
    met = np.zeros((m, m), np.float64)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        a, b = np.searchsorted(column, (first, first + step))
        held = np.zeros((m, min(step, int(column[-1]) + 1 - first)), np.float32)
        held[row[a:b], column[a:b] - first] = 1
        met += held @ held.T  # counts below 2**24 are exact
    return met


def met_here(number: int, sides: np.ndarray, roots: np.ndarray, sizes: np.ndarray, lists_of: list[np.ndarray], kept: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which sets of a cell have a partner that they may be near to and meet on no list of a lesser number. Sets of one short key meet on their own list (of a number below 0)."""
    less = np.minimum(sizes[:, None], sizes[None, :])
    maybe = (roots[:, None] != roots[None, :]) & (less >= threshold * np.maximum(sizes[:, None], sizes[None, :]) - 1e-6)
    if sides.min() != sides.max():
        maybe &= sides[:, None] != sides[None, :]
    if number >= 0 and maybe.any():
        maybe &= shared([x[x < number] for x in kept]) == 0
        if maybe.any():
            maybe &= shared(lists_of) >= 1 + less // WANTED
    return maybe.any(axis=1)


def candidates(cells: DataFrame, told: DataFrame, partitions: int, threshold: float) -> DataFrame:
    """The rows of in_cells() whose sets have a partner to be looked at in that cell. told: of `narrowed`."""

    def run(batches):
        for cell, of in by_cell(batches):
            own, keys, roots, sizes, lists_of, kept = zip(*of, strict=True)
            numbers = [[x.view(np.uint32) ^ np.uint32(1 << 31) for x in c] for c in (lists_of, kept)]
            met = np.flatnonzero(met_here(cell[0], *(np.array(c) for c in (own, roots, sizes)), *numbers, threshold))
            columns = [[x] * len(met) for x in cell] + [[own[i] for i in met], [keys[i] for i in met]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[*CELL, "own", "key"])

    dealt = cells.join(told, "key").select(*CELL, "own", "key", "root", "size", "all", "kept").repartition(partitions, *CELL).sortWithinPartitions(*CELL, "key")
    return dealt.mapInArrow(run, "number long, low long, high long, own long, key long")


def cell_links(sets: list[np.ndarray], sides: np.ndarray, roots: np.ndarray, ranks: np.ndarray, threshold: float, quota: int) -> list[tuple[int, int, float]]:
    """Links (i, j, index) between near sets with unlike roots, and unlike sides if there are two, by a matrix product: all that hold them together,
    and with each set so many of its near ones, of least rank."""
    m = len(sets)
    sizes = np.array([len(x) for x in sets], np.int64)
    met = shared(sets)
    index = met / (sizes[:, None] + sizes[None, :] - met)
    near = (index >= threshold) & (roots[:, None] != roots[None, :])
    if sides.min() != sides.max():
        near &= sides[:, None] != sides[None, :]
    out, seen = [], np.zeros(m, bool)
    some = np.flatnonzero(near.any(axis=1))
    for start in some.tolist():
        todo = [] if seen[start] else [start]
        seen[start] = True
        while todo:
            x = todo.pop()
            further = np.flatnonzero(near[x] & ~seen).tolist()
            seen[further] = True
            out += [(x, y) for y in further]
            todo += further
    left = np.where(near[some], ranks[None, :], m)
    for _ in range(quota):
        least = left.argmin(axis=1)
        there = np.flatnonzero(left[np.arange(len(some)), least] < m)
        out += zip(some[there].tolist(), least[there].tolist(), strict=True)
        left[there, least[there]] = m
    return [(i, j, float(index[i, j])) for i, j in {(max(x), min(x)) for x in out}]
