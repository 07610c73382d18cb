"""Periodic runs of words: Crochemore's partition refinement by factor length.

Positions of a text are in one class at level l if the l words from there are equal. A class at level l whose neighbouring members are l apart
shows a square: the l words stand twice in a row, and they are no repetition of something shorter, else a nearer member would lie between.
Squares of one period at consecutive places are one run.

Level l + 1 splits the classes of level l by what follows: positions whose next position is in another class part. The first levels, where most
classes change, are made for all texts of a slice at once, by sorting; positions alone in their class can be in no square and are left out.
What remains are the repeated passages. They are refined text by text with the smaller-half strategy: of the parts that a class
falls into, all but the largest split their predecessors at the next level, so a position is moved at most log n times, and a level at which
nothing changes costs nothing. A run has at least three periods, so no level beyond a third of the text is needed.

The words are those between ASCII white space. A null or empty text has no words and no runs. Documents without id are looked at as they are. Repeated
rows give equal rows. Very long texts are handled whole, one at a time. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: A run has so many words and so many periods at least.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Levels made by sorting, for all texts of a slice at once.
SORTED_LEVELS = 6

Run = tuple[int, int, int]  # start, length, period


def stretches(places: np.ndarray, period: int, words: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> list[Run]:
    """Runs of a period from the ascending places of its squares."""
    cuts = np.flatnonzero(np.diff(places) != 1) + 1
    firsts, lasts = places[np.concatenate([[0], cuts])], places[np.concatenate([cuts, [len(places)]]) - 1]
    lengths = lasts - firsts + 2 * period
    long = lengths >= max(words, periods * period)
    return [(a, n, period) for a, n in zip(firsts[long].tolist(), lengths[long].tolist(), strict=True)]


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that brings equal keys together, equal ones in place, and where each group starts (and the end)."""
    order = np.argsort(keys, kind="stable")
    bounds = np.flatnonzero(np.diff(keys[order])) + 1
    return order, np.concatenate([[0], bounds, [len(keys)]]).astype(np.int64)


def refine(classes: list[list[int]], level: int, most: int) -> dict[int, list[int]]:
    """Places of squares by period, for the periods above a level up to most, from that level's classes of two or more ascending positions."""
    home: dict[int, int] = {}
    after: dict[int, int] = {}
    before: dict[int, int] = {}
    size: list[int] = []
    near: dict[int, list[int]] = defaultdict(list)  # distance: positions whose neighbour was so far; those that still have it at that level are squares
    for k, members in enumerate(classes):
        size.append(len(members))
        for i in members:
            home[i] = k
        for i, j in zip(members, members[1:], strict=False):
            after[i], before[j] = j, i
            near[j - i].append(i)
    # at first every class splits what precedes it, and so does every position that is alone
    splitters = [*classes, *([i + 1] for i in list(home) if i + 1 not in home)]
    found: dict[int, list[int]] = {}
    while splitters and level < most:
        level += 1
        parts: dict[int, dict[int, list[int]]] = {}  # class: splitter: positions that part from it
        for s, members in enumerate(splitters):
            for i in members:
                k = home.get(i - 1)
                if k is not None:
                    parts.setdefault(k, {}).setdefault(s, []).append(i - 1)
        splitters = []
        for k, groups in parts.items():
            rest = size[k] - sum(map(len, groups.values()))
            largest = max(groups, key=lambda s: len(groups[s]))
            stays = None if rest >= len(groups[largest]) else largest  # the largest part keeps the class
            if stays is not None and rest:
                gone = {i for members in groups.values() for i in members}
                i, kept = next(iter(groups[largest])), []
                while i in before:
                    i = before[i]
                while i is not None:
                    if i not in gone:
                        kept.append(i)
                    i = after.get(i)
                groups[-1] = kept
            for s, members in groups.items():
                if s == stays:
                    continue
                members.sort()
                splitters.append(members)
                size[k] -= len(members)
                for i in members:
                    a, b = before.pop(i, None), after.pop(i, None)
                    if a is not None:
                        if b is None:
                            del after[a]
                        else:
                            after[a] = b
                            near[b - a].append(a)
                    if b is not None:
                        if a is None:
                            del before[b]
                        else:
                            before[b] = a
                if len(members) == 1:
                    del home[members[0]]
                else:
                    new = len(size)
                    size.append(len(members))
                    for i in members:
                        home[i] = new
                    for i, j in zip(members, members[1:], strict=False):
                        after[i], before[j] = j, i
                        near[j - i].append(i)
        squares = {i for i in near.pop(level, ()) if after.get(i) == i + level}  # neighbours that moved together are listed again
        if squares:
            found[level] = sorted(squares)
    return found


def runs_of(texts: list[np.ndarray], words: int = LEAST_WORDS, periods: int = LEAST_PERIODS, levels: int = SORTED_LEVELS) -> list[list[Run]]:
    """For each text, given as numbers of its words, its runs by start, then period."""
    sizes = np.array([len(x) for x in texts], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1  # one place between texts, alone in its class
    out: list[list[Run]] = [[] for _ in texts]
    if not len(texts) or not sizes.max():
        return out
    place = np.concatenate([np.arange(a, a + n) for a, n in zip(starts, sizes, strict=True) if n >= words] or [np.zeros(0, np.int64)])
    if not len(place):
        return out
    rank = np.zeros(int(starts[-1] + sizes[-1] + 2), np.int64)  # class of each place, 0 where it is alone
    own = np.concatenate([x for x in texts if len(x) >= words])
    key = np.repeat(starts[sizes >= words], sizes[sizes >= words]) * (int(own.max()) + 1) + own
    for level in range(1, levels + 1):
        if level > 1:
            follows = rank[place + 1]
            there = follows > 0
            was = place
            place, key = place[there], rank[place[there]] * len(rank) + follows[there]
            rank[was] = 0
        if not len(place):
            return out
        order, bounds = grouped(key)
        many = np.repeat(np.diff(bounds) > 1, np.diff(bounds))
        number = np.repeat(np.arange(1, len(bounds)), np.diff(bounds))[many]
        by_class = place[order[many]]
        rank[by_class] = number
        place = np.sort(by_class)
        squares = by_class[:-1][(np.diff(by_class) == level) & (np.diff(number) == 0)]
        if len(squares):
            for start, length, period in stretches(np.sort(squares), level, words, periods):
                text = int(np.searchsorted(starts, start, "right")) - 1
                out[text].append((start - int(starts[text]), length, period))
    order, bounds = grouped(rank[place])
    held: dict[int, list[list[int]]] = defaultdict(list)
    by_class = place[order]
    text_of = (np.searchsorted(starts, by_class[bounds[:-1]], "right") - 1).tolist() if len(place) else []
    for text, a, b in zip(text_of, bounds[:-1].tolist(), bounds[1:].tolist(), strict=False):
        held[text].append((by_class[a:b] - starts[text]).tolist())
    for text, classes in held.items():
        most = int(sizes[text]) // periods
        if most > levels:
            for period, squares in refine(classes, levels, most).items():
                out[text] += stretches(np.array(squares), period, words, periods)
    return [sorted(x, key=lambda r: (r[0], r[2])) for x in out]


def kept(n: int, runs: list[Run]) -> np.ndarray | None:
    """Which of n words are in no run after its first period; None if all."""
    if not runs:
        return None
    keep = np.ones(n, bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return keep


def repeated(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words as this operator's query takes them: of every tenth document (by the crc32 of its id) the end is a repetition."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * (-(-(n - a) // p)))[: n - a]


def found(docs: DataFrame, id_col: str, text_col: str, fields: list[T.StructField], digest, rewrite=None) -> DataFrame:
    """doc_id and what digest(words, runs) gives for the fields, over all documents. rewrite(words, doc_id) may put other words in their place."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *fields])
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    arrow = [{"bigint": pa.int64(), "string": pa.string()}.get(f.dataType.simpleString()) or pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")])) for f in fields]

    def run(batches):
        for batch in batches:
            for part in common.slices(batch, "text"):
                ids = part.column(0).to_pylist()
                words = [x.encode().split() for x in common.texts_of(part, "text")]
                if rewrite:
                    words = [rewrite(w, i) for w, i in zip(words, ids, strict=True)]
                known: dict[bytes, int] = {}
                texts = [np.array([known.setdefault(w, len(known)) for w in x], np.int64) for x in words]
                rows = [digest(w, r) for w, r in zip(words, runs_of(texts), strict=True)]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=schema.names)

    return source.mapInArrow(run, schema)


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and its runs: an array of (start, length, period), in words."""
    kind = T.ArrayType(T.StructType([T.StructField(x, T.LongType()) for x in ("start", "length", "period")]))
    return found(docs, id_col, text_col, [T.StructField("runs", kind)], lambda w, r: ([dict(zip(("start", "length", "period"), x, strict=True)) for x in r],))


def collapsed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the text with each run cut to its first period; words are joined by one space."""

    def text(words, found_runs):
        keep = kept(len(words), found_runs)
        return (b" ".join(words if keep is None else [words[i] for i in np.flatnonzero(keep)]).decode(),)

    return found(docs, id_col, text_col, [T.StructField("text", T.StringType())], text)


DIGEST = [T.StructField(n, T.LongType()) for n in ("n_runs", "start", "length", "period", "exponent_milli")] + [T.StructField(n, T.StringType()) for n in ("runs_sha256", "collapsed_sha256")]


def digest(words: list[bytes], found_runs: list[Run]) -> tuple:
    top = max(found_runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    keep = kept(len(words), found_runs)
    text = b" ".join(words if keep is None else [words[i] for i in np.flatnonzero(keep)])
    listed = "".join(f"{a},{n},{q}\n" for a, n, q in found_runs)
    best = (*top, 1000 * top[1] // top[2]) if top else (None, None, None, None)
    return (len(found_runs), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text).hexdigest())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(common.table(spark, sf_dir, "documents"), "doc_id", "text", DIGEST, digest, repeated)


ORACLE = f"""WITH cut AS (
  SELECT doc_id, {common.crc32_sql("doc_id::VARCHAR")} AS h, list_filter(string_split_regex(coalesce(text, ''), '[ \\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
placed AS (SELECT doc_id, words, len(words) AS n, h % 10 = 0 AND len(words) > 0 AS odd, (h // 10) % greatest(len(words), 1) AS a, h // 10 AS g FROM cut),
spans AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM placed),
numbered AS (SELECT *, unnest(range(0, n)) AS i FROM spans),
w AS (SELECT doc_id, n, i, words[1 + CASE WHEN odd AND i >= a THEN a + (i - a) % p ELSE i END] AS word FROM numbered),
pairs AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND {LEAST_PERIODS} * (y.i - x.i) <= x.n),
islands AS (
  SELECT doc_id, q, min(i) AS s, count(*) + q AS len FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM pairs)
  GROUP BY doc_id, q, g HAVING count(*) + q >= greatest({LEAST_WORDS}, {LEAST_PERIODS} * q)),
runs AS (SELECT doc_id, s, len, min(q) AS q FROM islands GROUP BY doc_id, s, len),
told AS (
  SELECT doc_id, count(*) AS n_runs, list(struct_pack(s := s, len := len, q := q) ORDER BY len::DOUBLE / q DESC, s, q)[1] AS top,
    sha256(string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q)) AS runs_sha256 FROM runs GROUP BY doc_id),
dropped AS (SELECT DISTINCT w.doc_id, w.i FROM w JOIN runs r ON w.doc_id = r.doc_id AND w.i >= r.s + r.q AND w.i < r.s + r.len),
kept AS (SELECT w.doc_id, string_agg(w.word, ' ' ORDER BY w.i) AS text FROM w ANTI JOIN dropped d ON w.doc_id = d.doc_id AND w.i = d.i GROUP BY w.doc_id)
SELECT d.doc_id, coalesce(t.n_runs, 0) AS n_runs, t.top.s AS start, t.top.len AS length, t.top.q AS period, (1000 * t.top.len) // t.top.q AS exponent_milli,
  coalesce(t.runs_sha256, sha256('')) AS runs_sha256, sha256(coalesce(k.text, '')) AS collapsed_sha256
FROM cut d LEFT JOIN told t USING (doc_id) LEFT JOIN kept k USING (doc_id)"""
