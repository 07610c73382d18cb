"""SimHash near-duplicates with pivot distance tables.

Fingerprint: A-Z lower-cased, words are runs without blanks, shingles are 4 consecutive words
(fewer words: all; none: fingerprint 0), hashed by XXH64 with seed 42; a bit is set if it is
set in over half of the hashes. Fingerprints that differ in at most DISTANCE bits are linked, and
a component is what links connect.

Links are sought between distinct fingerprints, so exact copies cost nothing. A table holds each
fingerprint's Hamming distances to PIVOTS reference fingerprints. By the triangle inequality a
pair whose distances to some reference differ by more than DISTANCE is no link; what this leaves is verified on the
bits. Comparing every pair of table rows would be quadratic, so rows first meet by blocks:
cut into k blocks, two linked fingerprints agree on at least k - DISTANCE of them, and each choice of
so many blocks is a key (complete, not approximate). k grows with the number of fingerprints.

A key with more than HOT fingerprints isn't joined with itself. Its members meet at stars
instead: two fingerprints differ in at most 4 bits exactly if some value is within 2 bits of
both, so each member gives the 2081 values within 2 bits, and those that share a value meet
the least of them. That is linear in the group's size and loses no link's component. Cells of pivot distances
can't split such a key: its members are near each other, so most fall into one cell or into neighbouring ones, whose
rows would have to meet all the same.

Pairs that meet, at keys or at stars, go through one test: the pivot table, then the bits.

Null text: no words. Null ids take part; a component's id is its smallest id that isn't null. Repeated rows get
equal results. Other columns aren't read by components() and pass through deduplicated(). Empty tables give
empty results.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from . import common, components as graph

SHINGLE = 4
SEED = 42
DISTANCE = 4
PIVOTS = 16
PIVOT_SEED = 7
HOT = 4096

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
#: Shingles whose bits are counted at once.
COUNTED = 1 << 16


def fingerprint(text: str) -> int:
    words = WORD.findall(text.encode().translate(LOWER))
    if len(words) < SHINGLE:
        hashes = [xxh64_intdigest(b" ".join(words), SEED)] if words else []
    else:
        hashes = [xxh64_intdigest(b" ".join(x), SEED) for x in zip(*(words[k:] for k in range(SHINGLE)), strict=False)]
    found = np.array(hashes, "<u8")
    total = np.zeros(64, np.int64)
    for i in range(0, len(found), COUNTED):
        part = found[i : i + COUNTED]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * total > len(found)).view("<i8")[0])


def fingerprinted(docs: DataFrame, keep: list[str], text_col: str = "text", name: str = "simhash") -> DataFrame:
    def make():
        return lambda texts: [pa.array([fingerprint(x) for x in texts], pa.int64())]

    return common.map_texts(docs, text_col, make, [T.StructField(name, T.LongType())], keep)


def blocks(n: int) -> int:
    """Blocks to cut fingerprints into, so that keys outnumber the fingerprints."""
    return DISTANCE + (2 if n < 1 << 23 else 3 if n < 1 << 29 else 4)


def block_masks(k: int) -> list[int]:
    edges = [round(64 * i / k) for i in range(k + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in itertools.pairwise(edges)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def pivot_table(fp: Column, pivots: int = PIVOTS) -> list[Column]:
    """Distances to the reference fingerprints, eight to a long."""
    rng = np.random.default_rng(PIVOT_SEED)
    references = [int(x) for x in rng.integers(-(1 << 63), (1 << 63) - 1, pivots, np.int64)]
    out = []
    for at in range(0, pivots, 8):
        packed = F.lit(0).cast("long")
        for i, r in enumerate(references[at : at + 8]):
            packed = packed.bitwiseOR(F.shiftleft(F.bit_count(fp.bitwiseXOR(F.lit(r))).cast("long"), 8 * i))
        out.append(packed.alias(f"pivots{at // 8}"))
    return out


def links(distinct: DataFrame, hot: int = HOT, pivots: int = PIVOTS) -> DataFrame:
    """Links a, b between distinct fingerprints (column fp); within hot keys, a spanning part of them."""
    k = blocks(distinct.count())
    masks = block_masks(k)
    choices = list(itertools.combinations(range(k), k - DISTANCE))
    key_masks = F.array(*[F.lit(signed(sum(masks[i] for i in c))) for c in choices])
    keyed = distinct.select("fp", *pivot_table(F.col("fp"), pivots), F.posexplode(key_masks).alias("choice", "mask"))
    keyed = keyed.withColumn("key", F.col("fp").bitwiseAND(F.col("mask"))).drop("mask")

    heavy = common.written(keyed.groupBy("choice", "key").agg(F.count("*").alias("n")).filter(F.col("n") > hot).drop("n"), "hot-keys")
    stars = None
    if not heavy.isEmpty():
        members = keyed.join(heavy, ["choice", "key"], "left_semi").select("fp").distinct()
        near = [1 << i for i in range(64)]
        near = [0, *near, *(a | b for a, b in itertools.combinations(near, 2))]
        around = members.select("fp", F.explode(F.array(*[F.lit(signed(x)) for x in near])).alias("flip"))
        around = around.select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("value"))
        centres = around.groupBy("value").agg(F.min("fp").alias("b"), F.count("*").alias("n")).filter("n > 1").drop("n")
        stars = around.join(centres, "value").filter("fp != b").select(F.col("fp").alias("a"), "b").distinct()
        keyed = keyed.join(heavy, ["choice", "key"], "left_anti")

    # a pair that agrees on more blocks shares several keys; it is taken at its first choice only
    a, b = keyed.alias("a"), keyed.alias("b")
    differ = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    first = F.array_position(F.array(*[differ.bitwiseAND(F.lit(signed(sum(masks[i] for i in c)))) == 0 for c in choices]), True) - 1
    met = (F.col("a.choice") == F.col("b.choice")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp"))
    if stars is None:
        met = met & (first == F.col("a.choice"))
    names = [f"pivots{x}" for x in range(-(-pivots // 8))]
    found = a.join(b, met & near_by_pivots([F.col(f"a.{x}") for x in names], [F.col(f"b.{x}") for x in names], pivots) & verified(F.col("a.fp"), F.col("b.fp")))
    found = found.select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
    if stars is None:
        return found
    table = [pivot_table(F.col(x), pivots) for x in ("a", "b")]
    return found.unionByName(stars.filter(near_by_pivots(*table, pivots) & verified(F.col("a"), F.col("b"))))


def near_by_pivots(own: list[Column], other: list[Column], pivots: int = PIVOTS) -> Column:
    """Whether no distance to a reference differs by more than DISTANCE: what the table leaves."""
    kept = F.lit(True)
    for x, (p, q) in enumerate(zip(own, other, strict=True)):
        for i in range(min(8, pivots - 8 * x)):
            a, b = (F.shiftright(y, 8 * i).bitwiseAND(F.lit(255).cast("long")) for y in (p, q))
            kept = kept & (F.abs(a - b) <= DISTANCE)
    return kept


def verified(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= DISTANCE


def component_table(fingerprints: DataFrame, hot: int = HOT) -> DataFrame:
    """fp, root, component_id for each distinct fingerprint of doc_id, fp; root is a fingerprint that names the component."""
    classes = common.written(fingerprints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "simhash-classes")
    roots = graph.labels(links(classes.select("fp"), hot), "simhash-links")
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = common.written(rooted, "simhash-roots")
    least = common.written(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")), "simhash-roots")  # so a giant root can be split in the join
    return rooted.join(least, "root").select("fp", "root", "component_id")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    own = common.written(fingerprinted(own, ["doc_id"], name="fp"), "simhash")
    found = own.join(component_table(own, hot), "fp")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """One document of each component, that with the smallest id (of rows with equal ids, one), all columns as they were."""
    fp, turn, kept = (common.free_name(docs, x) for x in ("fp", "turn", "kept"))
    own = common.written(fingerprinted(docs, docs.columns, text_col, fp), "simhash-docs")
    ids = own.select(F.col(id_col).alias("doc_id"), F.col(fp).alias("fp"))
    stay = component_table(ids, hot).join(ids.distinct(), "fp").filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    stay = stay.groupBy("root").agg(F.min("fp").alias("fp"), F.first("component_id").alias("id")).select(F.col("id").alias(kept), F.col("fp").alias(turn))
    found = own.join(stay, F.col(id_col).eqNullSafe(F.col(kept)) & (F.col(fp) == F.col(turn)), "left_semi")
    order = Window.partitionBy(id_col, fp).orderBy(text_col)
    return found.withColumn(turn, F.row_number().over(order)).filter(F.col(turn) == 1).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(common.table(spark, sf_dir, "documents"))
