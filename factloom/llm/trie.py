"""Conversation prefix trie: preorder intervals over distinct prefixes, by ranks and distributed prefix sums.

A node is a distinct sequence of first turns. It is named by its depth and a hash of the sequence, a polynomial over a prime of 127 bits
whose terms are digests of the turns: such hashes can be put together from parts, so a conversation's chain of prefixes is a running sum
over rows that are dealt out by ranges, and a very long conversation is shared by many tasks.

Distinct sequences are ranked in lexicographic order (of their turns' digests). A node comes into being with the first sequence that
goes through it, so (first sequence, depth) is preorder, and what lies below a node ends with the end of the last sequence that goes through it:
an interval. Leaves and saved bytes of a subtree are differences of two prefix sums over preorder. To be ranked, a sequence needs its turns only up to
the first that no other sequence shares.

The ends of a node are hashed in order of conversation id, from pieces that were joined where they lay: a node at which very many
conversations end streams through one task in bounded memory, since such a hash has one order.

Turns are ordered by their number, null first; turns of equal number by their digest; repeated rows are turns of their own. Null roles and texts count as empty. Rows without
conv_id belong to no conversation and are left out. Very long texts are digested where they are read and travel no further. An empty
table gives no nodes, not even a root. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, scans

#: Hashes: a prime, a base and the base's inverse.
PRIME = (1 << 127) - 1
BASE = int.from_bytes(hashlib.sha256(b"prefix trie").digest()[:15], "big")
INVERSE = pow(BASE, -1, PRIME)
#: What stands for the textless start of every conversation.
ROOT = b"\0" * 15 + b"\1"
#: Ids joined in a piece of a node's ends.
JOINED = 1 << 14


def digest(role: Column, text: Column) -> Column:
    """16 bytes that tell turns apart."""
    return F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))


def turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn_no (from 1), digest, bytes."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = conversations.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), digest(role, text).alias("digest"), F.octet_length(text).cast("long").alias("bytes"), F.monotonically_increasing_id().alias("place"), F.lit(1).alias("one")
    )
    return scans.running_sums(rows, ["conv_id", "turn", "digest", "place"], {"turn_no": "one"}, "trie-turns", ["conv_id", "digest", "bytes"], segment="conv_id")


def chains(rows: DataFrame, order: list[str]) -> DataFrame:
    """conv_id, depth, node, up, digest, bytes: the prefix that ends with each row, and the one before it. rows: conv_id, digest, bytes, those of order; the first of each conversation is its root."""
    source = scans.dealt(rows, order).select("conv_id", "digest", "bytes", "part")
    local_schema = T.StructType([*source.schema, T.StructField("row", T.LongType()), T.StructField("n", T.LongType()), T.StructField("hash", T.BinaryType())])

    def local(batches):
        last, n, value, row = None, 0, 0, 0
        for batch in batches:
            ns, values, start = [], [], row
            for conv, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if conv != last:
                    last, n, value = conv, 0, 0
                n, value, row = n + 1, (value * BASE + int.from_bytes(raw, "big")) % PRIME, row + 1
                ns.append(n)
                values.append(value.to_bytes(16, "big"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(range(start, row), pa.int64()), pa.array(ns, pa.int64()), pa.array(values, pa.binary())], names=local_schema.names)

    written = common.written(source.mapInArrow(local, local_schema), "trie-chains")

    def joined(a: tuple, b: tuple) -> tuple:
        value = (int.from_bytes(a[1], "big") * pow(BASE, b[0], PRIME) + int.from_bytes(b[1], "big")) % PRIME
        return a[0] + b[0], value.to_bytes(16, "big")

    before = scans.carried(written, "conv_id", ["n", "hash"], joined)
    schema = T.StructType([source.schema["conv_id"], T.StructField("depth", T.LongType()), T.StructField("node", T.BinaryType()), T.StructField("up", T.BinaryType()), source.schema["digest"], source.schema["bytes"]])

    def whole(batches):
        for batch in batches:
            depths, nodes, ups = [], [], []
            for conv, raw, part, n, value in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "digest", "part", "n", "hash")), strict=True):
                held = before.get(part)
                if held and held[0] == conv:
                    n, value = joined(held[1], (n, value))
                up = (int.from_bytes(value, "big") - int.from_bytes(raw, "big")) * INVERSE % PRIME
                depths.append(n - 1)
                nodes.append(value)
                ups.append(up.to_bytes(16, "big"))
            columns = [batch.column(0), pa.array(depths, pa.int64()), pa.array(nodes, pa.binary()), pa.array(ups, pa.binary()), batch.column(1), batch.column(2)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return common.written(written.mapInArrow(whole, schema), "trie-prefixes")


def end_hashes(ends: DataFrame) -> DataFrame:
    """depth, node, ends_sha256 of the ids (conv_id, depth, node) in ascending order, joined by commas."""
    source = scans.dealt(ends, ["depth", "node", "conv_id"]).select("depth", "node", "conv_id", "part")
    piece_schema = T.StructType([source.schema["depth"], source.schema["node"], source.schema["part"], T.StructField("piece", T.LongType()), T.StructField("ids", T.StringType())])

    def pieces(batches):
        key, held, done = None, [], 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*key, done, ",".join(held)), (pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.string()), strict=True)], names=piece_schema.names)

        for batch in batches:
            for depth, node, conv, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (key != (depth, node, part) or len(held) == JOINED):
                    yield flush()
                    held, done = [], done + 1
                key = (depth, node, part)
                held.append(str(conv))
        if held:
            yield flush()

    rows = source.mapInArrow(pieces, piece_schema).repartition("depth", "node").sortWithinPartitions("depth", "node", "part", "piece")
    schema = T.StructType([source.schema["depth"], source.schema["node"], T.StructField("ends_sha256", T.StringType())])

    def hashed(batches):
        key, state = None, None

        def done(keys):
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.binary()), pa.array([k[2] for k in keys], pa.string())], names=schema.names)

        for batch in batches:
            out = []
            for depth, node, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if key != (depth, node):
                    if state:
                        out.append((*key, state.hexdigest()))
                    key, state = (depth, node), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield done(out)
        if state:
            yield done([(*key, state.hexdigest())])

    return rows.mapInArrow(hashed, schema)


def ranked(prefixes: DataFrame, sequences: DataFrame) -> DataFrame:
    """conv_id, rank (from 1) of distinct sequences, given by a conversation (conv_id) each, in lexicographic order."""
    own = prefixes.join(sequences.select("conv_id"), "conv_id", "left_semi")
    lone = own.groupBy("depth", "node").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id")).filter("n = 1").groupBy("conv_id").agg(F.min("depth").alias("cut"))
    shared = own.join(lone, "conv_id", "left").filter(F.col("cut").isNull() | (F.col("depth") <= F.col("cut")))
    step = F.struct("depth", F.when(F.col("depth") == 0, "").otherwise(F.hex("digest")).alias("turn"))
    keys = shared.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(step)), lambda x: x["turn"]), "").alias("key"))
    keys = common.written(keys.withColumn("one", F.lit(1)), "trie-keys")
    return scans.running_sums(keys, ["key"], {"rank": "one"}, "trie-ranks", ["conv_id"])


def nodes(prefixes: DataFrame) -> DataFrame:
    """The trie's nodes from every conversation's prefixes: one row each, with its interval of preorder positions and what its subtree sums up to."""
    ends = common.written(prefixes.groupBy("conv_id").agg(F.max(F.struct("depth", "node")).alias("end")).select("conv_id", "end.depth", "end.node"), "trie-ends")
    sequences = ends.groupBy("depth", "node").agg(F.min("conv_id").alias("conv_id"))
    ranks = common.written(ranked(prefixes, sequences), "trie-sequences")
    every = prefixes.join(ranks, "conv_id", "left").groupBy("depth", "node").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("rank").alias("first"), F.max("rank").alias("last"), F.min("up").alias("up"), F.min("bytes").alias("bytes")
    )
    every = common.written(every, "trie-nodes")
    children = every.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up").alias("node")).agg(F.count("*").alias("n_children"))
    full = every.join(children, ["depth", "node"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    full = full.withColumns({"one": F.lit(1), "leaf": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("bytes")})
    keep = ["depth", "node", "up", "conv_id", "n_convs", "n_children", "first", "last", "leaf", "saved"]
    placed = common.written(scans.running_sums(full, ["first", "depth"], {"position": "one", "leaves": "leaf", "savings": "saved"}, "trie-preorder", keep), "trie-placed")
    close = placed.groupBy(F.col("first").alias("last")).agg(F.max(F.struct("position", "leaves", "savings")).alias("end"))
    parent = every.select((F.col("depth") + 1).alias("depth"), F.col("node").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    whole = placed.join(close, "last").join(parent, ["depth", "up"], "left").join(end_hashes(ends), ["depth", "node"], "left")
    return whole.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.col("n_children").cast("long").alias("n_children"),
        (F.col("end.leaves") - F.col("leaves") + F.col("leaf")).alias("n_leaves"), (F.col("end.savings") - F.col("savings") + F.col("saved")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"), "position", F.col("end.position").alias("end_position"),
    )


def prefixes_of(own: DataFrame) -> DataFrame:
    """The prefixes of conversations whose turns (conv_id, turn_no, digest, bytes) are given."""
    root = own.select("conv_id").distinct().select("conv_id", F.lit(-1).alias("source"), F.lit(0).cast("long").alias("turn_no"), F.lit(ROOT).alias("digest"), F.lit(0).cast("long").alias("bytes"))
    rows = own.select("conv_id", F.lit(1).alias("source"), "turn_no", "digest", "bytes").unionByName(root)
    return chains(rows, ["conv_id", "source", "turn_no"])


def trie(conversations: DataFrame, **columns: str) -> DataFrame:
    """The trie of a table of conversations as they are."""
    return nodes(prefixes_of(common.written(turns(conversations, **columns), "trie-own")))


#: The query's conversations begin with up to MOST_HEAD - 1 turns of the first of GROUP conversations.
GROUP, MOST_HEAD = 5, 9


def heads(conv: Column) -> Column:
    return F.crc32(conv.cast("string").cast("binary")) % MOST_HEAD


def rebuilt(own: DataFrame) -> DataFrame:
    """Prefixes of conversations that begin as the first one of their group does."""
    convs = own.select("conv_id").distinct()
    first = own.filter(F.col("turn_no") < MOST_HEAD).withColumnRenamed("conv_id", "base")
    given = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP).join(first, "base").filter(F.col("turn_no") <= heads(F.col("conv_id")))
    rest = own.filter(F.col("turn_no") > heads(F.col("conv_id")))
    root = convs.select("conv_id", F.lit(-1).alias("source"), F.lit(0).cast("long").alias("turn_no"), F.lit(ROOT).alias("digest"), F.lit(0).cast("long").alias("bytes"))
    part = lambda df, k: df.select("conv_id", F.lit(k).alias("source"), "turn_no", "digest", "bytes")
    return chains(common.written(root.unionByName(part(given, 0)).unionByName(part(rest, 1)), "trie-rebuilt"), ["conv_id", "source", "turn_no"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(rebuilt(common.written(turns(common.table(spark, sf_dir, "conversations")), "trie-own")))


ORACLE = f"""WITH own AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
told AS (SELECT conv_id, i, left(sha256(length(role) || ':' || role || text), 32) AS t, strlen(text) AS bytes FROM own),
convs AS (SELECT conv_id, conv_id - conv_id % {GROUP} AS base, {common.crc32_sql("s")} % {MOST_HEAD} AS h FROM (SELECT DISTINCT conv_id, conv_id::VARCHAR AS s FROM own)),
rows AS (
  SELECT c.conv_id, 0 AS source, t.i, t.t FROM convs c JOIN told t ON t.conv_id = c.base AND t.i <= c.h
  UNION ALL SELECT c.conv_id, 1, t.i, t.t FROM convs c JOIN told t ON t.conv_id = c.conv_id AND t.i > c.h),
sequences AS (SELECT c.conv_id, coalesce(list(r.t ORDER BY r.source, r.i) FILTER (r.t IS NOT NULL), []) AS s FROM convs c LEFT JOIN rows r USING (conv_id) GROUP BY c.conv_id),
prefixes AS (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM sequences),
sizes AS (SELECT t, any_value(bytes) AS bytes FROM told GROUP BY t),
grouped AS (
  SELECT list_slice(s, 1, d) AS p, d, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(s) = d), '')) AS ends_sha256
  FROM prefixes GROUP BY 1, 2),
kids AS (SELECT list_slice(p, 1, d - 1) AS p, count(*) AS n FROM grouped WHERE d > 0 GROUP BY 1),
nodes AS (
  SELECT g.*, coalesce(k.n, 0) AS n_children, (g.n_convs - 1) * coalesce(z.bytes, 0) AS saved, row_number() OVER (ORDER BY g.p) AS position
  FROM grouped g LEFT JOIN kids k ON k.p = g.p LEFT JOIN sizes z ON z.t = g.p[g.d]),
below AS (
  SELECT list_slice(p, 1, k) AS p, count(*) AS size, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END)::BIGINT AS leaves, sum(saved)::BIGINT AS saved
  FROM (SELECT *, unnest(range(0, d + 1)) AS k FROM nodes) GROUP BY 1)
SELECT n.conv_id, n.d AS depth, u.conv_id AS parent_conv_id, n.n_convs, n.n_children, b.leaves AS n_leaves, b.saved AS saved_tokens, n.ends_sha256, n.position, n.position + b.size - 1 AS end_position
FROM nodes n JOIN below b ON b.p = n.p LEFT JOIN nodes u ON n.d > 0 AND u.p = list_slice(n.p, 1, n.d - 1)"""
