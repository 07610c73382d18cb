"""Token-id files: ORC with integer run-length encoding, row indexes and Bloom filters.

Rows go into the files in ascending document id (ties by a hash of the text, null ids first), one ORC
file a range of ids; every row carries its start inside its file, and a reader adds the
token counts of the files before. A reader that wants one document prunes files and
stripes by their minimum and maximum, and row groups by the Bloom filter on doc_id; one
that wants a share of the corpus reads stripes in parallel.

Null and empty texts give the end id alone; repeated rows are written as often as they
come; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, tokens

END = b"\0\0\0\0"

OPTIONS = {
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.row.index.stride": "1000",
    "orc.create.index": "true",
    "orc.stripe.size": str(16 << 20),
    "compression": "snappy",
}

FILE_SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("file_no", T.IntegerType()), T.StructField("file_start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType(), False))]
)


#: Slices of texts encoded at once: the more words there are, the fewer kinds for each.
SLICES = 4


def id_array(ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """32-bit ids as a list array, without a copy for each id."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(ids.view("<i4")))


def write(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> None:
    """Writes one ORC file for each range of ids. The texts, not the longer ids, are shuffled."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # ids that very many rows share, or lack, are split by the texts' hashes, and equal texts by where they were read
    source = source.withColumns({"tie": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
    source = source.repartitionByRange(common.partitions(docs), "doc_id", "tie", "place").sortWithinPartitions("doc_id", "tie", "place")
    source = source.select("doc_id", F.spark_partition_id().alias("file_no"), "text")

    def run(batches):
        encoder, start = tokens.encoder(vocabulary), 0
        for batch in batches:
            for part in common.slices(batch, "text", SLICES):
                ids, sizes = encoder.arrays(common.texts_of(part, "text"), END)
                starts = start + np.cumsum(sizes) - sizes
                start += int(sizes.sum())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(starts), pa.array(sizes), id_array(ids, sizes)], names=FILE_SCHEMA.names)

    source.mapInArrow(run, FILE_SCHEMA).write.options(**OPTIONS).orc(path)


def file_starts(rows: DataFrame) -> np.ndarray:
    """Tokens before each file. Only a count for each file is gathered."""
    totals = {x.file_no: x.total for x in rows.groupBy("file_no").agg(F.sum("n_tokens").alias("total")).collect()}
    sizes = np.zeros(max(totals, default=-1) + 1, np.int64)
    for k, v in totals.items():
        sizes[k] = v
    return np.cumsum(sizes) - sizes


def map_files(spark: SparkSession, path: str, field: T.StructField, compute, where=None) -> DataFrame:
    """doc_id, start, n_tokens of written files and a field that compute(ids as a list array) gives."""
    rows = spark.read.schema(FILE_SCHEMA).orc(path)
    starts = file_starts(rows)
    schema = T.StructType([FILE_SCHEMA["doc_id"], T.StructField("start", T.LongType()), FILE_SCHEMA["n_tokens"], field])

    def run(batches):
        for batch in batches:
            doc, file_no, start, size, ids = batch.columns
            yield pa.RecordBatch.from_arrays([doc, pa.array(starts[file_no.to_numpy()] + start.to_numpy()), size, compute(ids)], names=schema.names)

    return (rows if where is None else rows.filter(where)).mapInArrow(run, schema)


def read(spark: SparkSession, path: str, where=None) -> DataFrame:
    """doc_id, start, n_tokens, ids of written files; a condition on doc_id reaches the ORC reader's statistics and Bloom filters."""
    return map_files(spark, path, FILE_SCHEMA["ids"], lambda ids: ids, where)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids as they come from the files."""

    def crc(ids: pa.ListArray) -> pa.Array:
        flat, ends = np.ascontiguousarray(ids.values.to_numpy(), "<i4"), ids.offsets.to_numpy()
        return pa.array([zlib.crc32(flat[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.int64())

    return map_files(spark, path, T.StructField("ids_crc32", T.LongType()), crc)


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The rows of some documents."""
    return read(spark, path, F.col("doc_id").isin(doc_ids))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.scratch(spark, "tokens")
    write(common.table(spark, sf_dir, "documents"), path)
    return checksums(spark, path)
