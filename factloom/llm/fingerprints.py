"""Document fingerprints: MinHash over word shingles by universal hashing, in vectorised numpy.

A text is lower-cased and cut at white space; its shingles are SHINGLE consecutive words
(fewer words: all of them as one shingle; none: no shingle, all minima at their maximum).
A shingle's base is a polynomial hash of its bytes modulo 2**64; permutation k takes the upper
half of a_k * base + b_k. Likeness of two fingerprints is the share of equal minima, an
unbiased estimate of the Jaccard index of the shingle sets; two texts without words are alike.

near_rows() joins bands of the signatures in Spark: texts that share a band meet the band's head, the one of least
hash, and the Jaccard index of their sets of shingles is verified. So a large group of near copies is one class after work that is linear
in the texts. Bands miss some pairs, so the prefixes of the sets (overlaps) then bring all texts that are not in one class yet and may
be near together in cells, where they are compared by matrix products: any two texts that are near are in one class, and a text that is near any has a near one told. Exact copies are one text. A head that very many texts meet is dealt to as many tasks as SHARE asks.
The query's columns near_doc, near_jaccard (of the near texts that were looked at, the one of least id) and near_class (the least id that links lead to) come from it.

A text's name is its XXH64; two of a billion texts share one with a probability of some 3 in 100, and then take each other's links.

Null text: empty. Repeated rows: equal values; rows that share an id or have none keep their own. Very long texts are
hashed by parts. Texts without words have no links. Extra columns are not read. Empty table: empty.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from . import common, components, overlaps

PERMUTATIONS = 64
#: Bands of ROWS permutations each: a pair at the threshold shares none about once in 120.
BANDS, ROWS = 12, 5
#: Texts that meet one head in a task, and rows of a table that may be broadcast.
SHARE, BROADCAST = 1000, 1 << 20
#: Near texts of least id that a text tells of each cell, and texts of a block.
QUOTA, BLOCK = 1, 500
SHINGLE = 5
THRESHOLD = 0.8
SEED = 20240131
#: Odd, so that its powers can be inverted modulo 2**64.
BASE = 0x9E3779B97F4A7C15 | 1
#: Characters of a long text that are hashed at once.
PART = 1 << 20
BLANK = re.compile(r"\s")


class Family(NamedTuple):
    a: np.ndarray
    b: np.ndarray


def family(permutations: int = PERMUTATIONS, seed: int = SEED) -> Family:
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 1 << 64, (2, permutations), np.uint64)
    return Family(a | np.uint64(1), b)


class Shingler:
    """Polynomial prefix hashes need the powers of BASE and of its inverse; they are kept as far as a slice of texts, or a part of one, needs."""

    def __init__(self):
        self.powers = self.inverses = np.ones(1, np.uint64)

    def reserve(self, n: int) -> None:
        if len(self.powers) < n:
            n = 1 << n.bit_length()
            with np.errstate(over="ignore"):
                self.powers = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, BASE, np.uint64)])
                self.inverses = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, pow(BASE, -1, 1 << 64), np.uint64)])

    def __call__(self, words: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Base hashes of all shingles of texts cut into words, repeats included, and each text's first position among them (one more at the end)."""
        counts = np.array([len(x) for x in words], np.int64)
        n_shingles = np.where(counts > 0, np.maximum(counts - SHINGLE + 1, 1), 0)
        firsts = np.concatenate(([0], np.cumsum(n_shingles)))
        if not counts.sum():
            return np.zeros(0, np.uint64), firsts
        data = np.frombuffer(" ".join(" ".join(x) for x in words if x).encode(), np.uint8)
        self.reserve(len(data) + 1)
        blanks = np.flatnonzero(data == 32)
        starts, ends = np.concatenate(([0], blanks + 1)), np.concatenate((blanks, [len(data)]))
        with np.errstate(over="ignore"):
            prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(data * self.powers[: len(data)], dtype=np.uint64)))
            word = np.concatenate(([0], np.cumsum(counts)))[:-1]
            left = np.repeat(word - firsts[:-1], n_shingles) + np.arange(firsts[-1])
            right = left + np.repeat(np.minimum(counts, SHINGLE) - 1, n_shingles)
            a, b = starts[left], ends[right]
            x = (prefix[b] - prefix[a]) * self.inverses[a]
            x = (x + (b - a).astype(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
            x ^= x >> np.uint64(32)
        return x, firsts


def parts(text: str):
    """Lists of words whose shingles are together those of the text: a long text is cut at white space about every PART
    characters, and a part begins with the last words of the one before."""
    if len(text) <= PART:
        yield text.lower().split()
        return
    carried: list[str] = []
    at, given = 0, False
    while at < len(text):
        blank = BLANK.search(text, at + PART)
        end = blank.start() if blank else len(text)
        words = carried + text[at:end].lower().split()
        at = end
        if len(words) >= SHINGLE:
            yield words
            given = True
            words = words[1 - SHINGLE :]
        carried = words
    if not given:  # fewer words in all
        yield carried


def hashed(texts: list[str], shingler: Shingler):
    """Owners, base hashes and first positions. Short texts are handled together, long ones part by part."""
    long = [i for i, x in enumerate(texts) if len(x) > PART]
    short = [i for i, x in enumerate(texts) if len(x) <= PART]
    for owners, words in chain([(short, [x.lower().split() for x in map(texts.__getitem__, short)])], (([i], [w]) for i in long for w in parts(texts[i]))):
        yield np.array(owners, np.int64), *shingler(words)


def minima(pieces, n: int, hashes: Family) -> np.ndarray:
    out = np.full((n, len(hashes.a)), 0xFFFFFFFF, np.uint32)
    for owners, base, firsts in pieces:
        rows = np.flatnonzero(np.diff(firsts))
        if len(rows):
            own, at = owners[rows], firsts[rows]
            with np.errstate(over="ignore"):
                for k, (a, b) in enumerate(zip(*hashes, strict=True)):
                    out[own, k] = np.minimum(out[own, k], np.minimum.reduceat(((base * a + b) >> np.uint64(32)).astype(np.uint32), at))
    return out


def signatures(texts: list[str], shingler: Shingler, hashes: Family) -> np.ndarray:
    """Minima of each text's shingles under each permutation."""
    return minima(hashed(texts, shingler), len(texts), hashes)


def shingle_numbers(pieces) -> tuple[np.ndarray, np.ndarray]:
    """The sets of all texts: distinct upper halves of base hashes, and the text each is of, ascending by both."""
    found = [np.unique(np.repeat(owners, np.diff(firsts)).astype(np.uint64) << np.uint64(32) | base >> np.uint64(32)) for owners, base, firsts in pieces]
    whole = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
    return (whole & overlaps.LOW).astype(np.uint32), (whole >> np.uint64(32)).astype(np.int64)


def as_text(signature: np.ndarray) -> list[str]:
    return [x.tobytes().hex() for x in signature.astype(">u4")]


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by the first as many characters of the next document."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def with_next(docs: DataFrame, notes: DataFrame) -> DataFrame:
    """doc_id, text, role, bucket, note, key, near_doc, near_jaccard, near_class: rows dealt into id ranges and sorted by falling id, so that a row's next document
    follows it. The first row of the range below comes along as role 1, closing the ring at the lowest range. The notes on a
    document's texts travel in the same shuffle and come before it (note 0; documents: 1).

    What is gathered on the driver is two ids for each range. Equal ids are ordered by text; null ids come last.
    """
    spark = docs.sparkSession
    n = 4 * common.partitions(docs)
    cut = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10 * n).alias("cuts")).first().cuts or []
    cuts = np.unique(np.array(cut, np.int64))

    def bucket(ids) -> np.ndarray:
        out = np.zeros(len(ids), np.int64)
        known = ~ids.isna().to_numpy()
        out[known] = 1 + np.searchsorted(cuts, ids[known].to_numpy(np.int64), "right")
        return out

    @F.pandas_udf("int")
    def range_of(ids):
        import pandas as pd

        return pd.Series(bucket(ids).astype(np.int32))

    tops = {x.b: x.top for x in docs.select("doc_id", range_of("doc_id").alias("b")).groupBy("b").agg(F.max("doc_id").alias("top")).collect()}
    order = sorted(tops)
    reader = {b: order[(k + 1) % len(order)] for k, b in enumerate(order)}  # the range whose last row is followed by b's first

    @F.pandas_udf("array<int>")
    def ranges_of(ids):
        import pandas as pd

        own = bucket(ids)
        first = [b for b, x in zip(own, ids, strict=True)]
        return pd.Series([[b, reader[b]] if (pd.isna(x) and tops[b] is None) or x == tops[b] else [b] for b, x in zip(first, ids, strict=True)])

    # the smallest text among rows of equal id comes first, so more than one of them does no harm
    empty = [F.lit(None).cast(t).alias(c) for c, t in (("key", "long"), ("near_doc", "long"), ("near_jaccard", "double"), ("near_class", "long"))]
    own = docs.select("doc_id", "text", F.posexplode(ranges_of("doc_id")).alias("role", "bucket"), F.lit(1).alias("note"), *empty)
    said = notes.select("doc_id", F.lit("").alias("text"), F.lit(0).alias("role"), range_of("doc_id").alias("bucket"), F.lit(0).alias("note"), "key", "near_doc", "near_jaccard", "near_class")
    return own.unionByName(said).repartition(common.partitions(docs), "bucket").sortWithinPartitions("bucket", "role", F.desc_nulls_last("doc_id"), "note", "text")


QUERY_SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()), T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType()), T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType()), T.StructField("near_doc", T.LongType()), T.StructField("near_jaccard", T.DoubleType()), T.StructField("near_class", T.LongType())]
)


def edit_probe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text, how alike they and the next document's are, and the near document and class of near_rows()."""
    source = with_next(named(docs, id_col, text_col).drop("key"), near_rows(docs, THRESHOLD, id_col, text_col))

    def run(batches):
        shingler, hashes = Shingler(), family()

        def emit(rows):
            """All but the last row, which only follows."""
            own = signatures([x[1] for x in rows], shingler, hashes)
            new = [edited(x[1], y[1]) for x, y in zip(rows, rows[1:], strict=False)]
            other = signatures(new, shingler, hashes)
            columns = (
                [x[0] for x in rows[:-1]], [len(x[1]) for x in rows[:-1]], [hashlib.sha256(x.encode()).hexdigest() for x in new], as_text(own[:-1]), as_text(other),
                (own[:-1] == other).mean(axis=1), (own[:-1] == own[1:]).mean(axis=1), *([x[k] for x in rows[:-1]] for k in (2, 3, 4)),
            )
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        arrow = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("near_doc", pa.int64()), ("near_jaccard", pa.float64()), ("near_class", pa.int64())])
        held, closed, at, used, notes, noted = [], True, None, 0, {}, None
        for batch in batches:
            for part in common.slices(batch, "text"):
                for doc, text, role, bucket, note, key, near, jaccard, least in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if bucket != at:
                        held, closed, at, used, notes, noted = [], False, bucket, 0, {}, None
                    if closed:
                        continue
                    if note == 0:
                        if noted != (doc,):
                            notes, noted = {}, (doc,)
                        notes[key % (1 << 64)] = (near, jaccard, least)
                        continue
                    found = notes.get(xxh64_intdigest(text.encode(), 42)) if noted == (doc,) and role == 0 else None
                    held.append((doc, text, *(found or (None, None, doc))))
                    used += len(text)
                    closed = role == 1
                    if closed or len(held) > common.SLICE_ROWS or used > common.SLICE_BYTES:
                        if len(held) > 1:
                            yield emit(held)
                        held, used = held[-1:], len(text)

    return source.mapInArrow(run, QUERY_SCHEMA)


def banded(signature: np.ndarray) -> np.ndarray:
    s = signature[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS).astype(np.uint64)
    bands = np.zeros((len(s), BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(ROWS):
            bands = (bands ^ s[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
            bands ^= bands >> np.uint64(29)
        return bands * np.uint64(BANDS) + np.arange(BANDS, dtype=np.uint64)


def shingle_set(text: str, shingler: Shingler) -> np.ndarray:
    """Distinct base hashes, their upper halves: a set of 32-bit numbers."""
    found = [np.unique((shingler([w])[0] >> np.uint64(32)).astype(np.uint32)) for w in parts(text)]
    return np.unique(np.concatenate(found)) if len(found) > 1 else found[0]


def small(df: DataFrame) -> DataFrame:
    """A written table, broadcast if its checked size allows that."""
    return F.broadcast(df) if df.count() <= BROADCAST else df


def named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, key: the text's name."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("key"))


def near_rows(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key, near_doc, near_jaccard, near_class for documents whose text is near another or in several documents."""
    source = named(docs, id_col, text_col)

    def make():
        shingler, hashes = Shingler(), family()

        def compute(texts):
            pieces = list(hashed(texts, shingler))
            bands = banded(minima(pieces, len(texts), hashes)).view(np.int64)
            has = np.array([bool(x.strip()) for x in texts], bool)
            numbers, owner = shingle_numbers(pieces)
            firsts = dict(zip(reversed(texts), range(len(texts) - 1, -1, -1), strict=True))
            shared = overlaps.common_numbers(numbers[np.isin(owner, list(firsts.values()))])
            return [
                pa.array([list(b) if h else [] for b, h in zip(bands, has, strict=True)], pa.list_(pa.int64())), pa.array(np.bincount(owner, minlength=len(texts)), pa.int64()),
                pa.array([shared] + [[]] * (len(texts) - 1), pa.list_(pa.int64())),
            ]

        return compute

    longs = T.ArrayType(T.LongType())
    keyed = common.map_texts(source, "text", make, [T.StructField("bands", longs), T.StructField("size", T.LongType()), T.StructField("common", longs)], ["doc_id", "key"])
    keyed = common.written(keyed, "minhash")
    rows = keyed.select("doc_id", "key", F.explode("bands").alias("band"))
    heads = rows.groupBy("band").agg(F.min("key").alias("head"), F.max("key").alias("last")).filter("head != last").select("band", "head")
    heads = small(common.written(heads, "minhash-heads"))
    met = rows.join(heads, "band").filter("key != head").groupBy("key", "head").agg(F.min("doc_id").alias("doc_id"))
    links = verified(source, keyed, common.written(met, "minhash-met"), threshold)

    known = common.written(components.labels(links.select(F.col("key").alias("a"), F.col("head").alias("b")), "minhash-known"), "minhash-labels")
    texts = keyed.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("size").alias("size"), F.count("*").alias("n"))
    texts = texts.join(small(known), F.col("key") == F.col("node"), "left").withColumns({"short": F.col("key").bitwiseAND(0xFFFFFFFF), "root": F.coalesce("root", "key")}).drop("node")
    texts = common.written(texts, "minhash-texts")
    pages = prefixes(source.join(small(known), F.col("key") == F.col("node"), "left").select("key", "text", "root"), overlaps.heaviest(keyed), threshold)
    found = common.written(overlaps.lists(pages, common.partitions(source)), "minhash-lists")
    members, told = overlaps.narrowed(found, texts.filter("size > 0").select("key", "short", "size", "root"), threshold)
    cells = common.written(overlaps.candidates(overlaps.in_cells(members, BLOCK), told, common.partitions(source), threshold), "minhash-cells")
    links = common.written(links.unionByName(verified_in_cells(source, cells, texts.select("key", F.col("first").alias("doc_id"), "root"), threshold)), "minhash-all-links")
    roots = common.written(components.labels(links.select(F.col("key").alias("a"), F.col("head").alias("b")), "minhash-classes"), "minhash-roots")

    member = roots.join(texts.drop("root"), F.col("key") == F.col("node")).select("key", "root", "first")
    least = member.join(member.groupBy("root").agg(F.min("first").alias("near_class")), "root").select("key", "near_class")
    both = links.select("key", "near_doc", "near_jaccard").unionByName(links.select(F.col("head").alias("key"), F.col("doc_id").alias("near_doc"), "near_jaccard"))
    best = both.groupBy("key").agg(F.min(F.struct(F.col("near_doc").isNull(), "near_doc", (-F.col("near_jaccard")).alias("less"))).alias("x"))
    best = best.select("key", F.col("x.near_doc").alias("near_doc"), (-F.col("x.less")).alias("near_jaccard")).join(least, "key", "left")
    told = texts.join(best, "key", "left").filter("n > 1 or near_jaccard is not null").select("key", "near_doc", "near_jaccard", F.coalesce("near_class", "first").alias("near_class"))
    return keyed.select("doc_id", "key").join(small(common.written(told, "minhash-best")), "key").select("doc_id", "key", "near_doc", "near_jaccard", "near_class").distinct()


def near_links(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key, near_doc, near_jaccard, near_class for documents whose text is near another."""
    return near_rows(docs, threshold, id_col, text_col).filter("near_jaccard is not null")


def prefixes(texts: DataFrame, heavy: np.ndarray, threshold: float) -> DataFrame:
    """Pages of the texts' prefixes. texts: key, text, root (of the class that the text is in already, or null)."""

    def run(batches):
        shingler, of, dealer = Shingler(), overlaps.Prefixes(heavy, threshold), overlaps.Dealer()
        for batch in batches:
            for part in common.slices(batch, "text"):
                numbers, owner = shingle_numbers(list(hashed(common.texts_of(part, "text"), shingler)))
                first = of(numbers, owner)
                keys = part.column(0).to_numpy().astype(np.uint64) & overlaps.LOW
                roots = part.column(2).fill_null(0).to_numpy()
                dealer.add(numbers[first], keys[owner[first]], roots[owner[first]])
                if dealer.count >= overlaps.HELD:
                    yield from dealer.dealt()
        yield from dealer.dealt()

    return texts.mapInArrow(run, overlaps.PAGES)


def verified(source: DataFrame, keyed: DataFrame, met: DataFrame, threshold: float) -> DataFrame:
    """key, doc_id, head, near_doc, near_jaccard, written: of texts that meet heads (key, head, doc_id of one document with the text), those near them; near_doc has the head's text."""
    shares = met.groupBy("head").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("shares"))
    ids = keyed.join(small(common.written(shares, "minhash-shares")), F.col("key") == F.col("head")).groupBy("key", "shares").agg(F.min("doc_id").alias("doc_id"))
    first = common.written(ids, "minhash-first")
    head_rows = first.select("key", "doc_id", F.col("key").alias("head"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(0).alias("role"))
    member_rows = met.join(small(first.select(F.col("key").alias("head"), "shares")), "head")
    member_rows = member_rows.select("key", "doc_id", "head", F.pmod(F.xxhash64("key"), F.col("shares").cast("long")).cast("int").alias("share"), F.lit(1).alias("role"))
    wanted = common.written(head_rows.unionByName(member_rows), "minhash-wanted")
    found = source.alias("s").join(small(wanted).alias("w"), (F.col("s.key") == F.col("w.key")) & F.col("s.doc_id").eqNullSafe(F.col("w.doc_id")))
    found = found.select("s.key", "s.doc_id", "w.head", "w.share", "w.role", "s.text")

    def sets():
        shingler = Shingler()
        return lambda texts: [pa.array([shingle_set(x, shingler).tobytes() for x in texts], pa.binary())]

    keep = ["key", "doc_id", "head", "share", "role"]
    sets_of = common.map_texts(found, "text", sets, [T.StructField("shingles", T.BinaryType())], keep)
    dealt = sets_of.repartition(common.partitions(source), "head", "share").sortWithinPartitions("head", "share", "role", "doc_id")

    def verify(batches):
        at, own, head_id = None, np.zeros(0, np.uint32), None
        for batch in batches:
            out: list[tuple] = []
            for key, doc, head, share, role, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                other = np.frombuffer(raw, np.uint32)
                if role == 0:
                    if at != (head, share):
                        at, own, head_id = (head, share), other, doc
                    continue
                shared = len(np.intersect1d(own, other, assume_unique=True))
                jaccard = shared / (len(own) + len(other) - shared)
                if at == (head, share) and jaccard >= threshold:
                    out.append((key, doc, head, head_id, jaccard))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            types = [pa.int64()] * 4 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["key", "doc_id", "head", "near_doc", "near_jaccard"])

    return common.written(dealt.mapInArrow(verify, "key long, doc_id long, head long, near_doc long, near_jaccard double"), "minhash-links")


def verified_in_cells(source: DataFrame, cells: DataFrame, names: DataFrame, threshold: float) -> DataFrame:
    """Links as of `verified` between texts that are in a cell (cells: number, low, high, own, key) together and not in one class. names: key, doc_id, root of every text.

    Pairs exist only inside a cell's matrix, and what it gives is linear in its texts.
    """
    ends = common.written(cells.select("key").distinct().join(names, "key"), "minhash-ends")
    found = source.alias("s").join(small(ends).alias("w"), (F.col("s.key") == F.col("w.key")) & F.col("s.doc_id").eqNullSafe(F.col("w.doc_id"))).select("s.key", "s.doc_id", "w.root", "s.text")

    def sets():
        shingler = Shingler()
        return lambda texts: [pa.array([shingle_set(x, shingler).tobytes() for x in texts], pa.binary())]

    held = common.map_texts(found, "text", sets, [T.StructField("shingles", T.BinaryType())], ["key", "doc_id", "root"]).dropDuplicates(["key"])
    rows = cells.join(held, "key").select(*overlaps.CELL, "own", "key", "doc_id", "root", "shingles")
    dealt = rows.repartition(common.partitions(source), *overlaps.CELL).sortWithinPartitions(*overlaps.CELL, "key")

    def verify(batches):
        for _, of in overlaps.by_cell(batches):
            own, keys, docs, roots, raw = zip(*of, strict=True)
            ranks = np.empty(len(of), np.int64)
            ranks[sorted(range(len(of)), key=lambda i: (docs[i] is None, docs[i] or 0))] = np.arange(len(of))
            found = overlaps.cell_links([np.frombuffer(x, np.uint32) for x in raw], np.array(own), np.array(roots), ranks, threshold, QUOTA)
            columns = list(zip(*((keys[i], docs[i], keys[j], docs[j], x) for i, j, x in found), strict=True)) or [[]] * 5
            types = [pa.int64()] * 4 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["key", "doc_id", "head", "near_doc", "near_jaccard"])

    return common.written(dealt.mapInArrow(verify, "key long, doc_id long, head long, near_doc long, near_jaccard double").distinct(), "minhash-cell-links")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_probe(common.table(spark, sf_dir, "documents"))
