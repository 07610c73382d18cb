"""What the operators share: the shared folder, written intermediate tables, Arrow streaming.

Operators project the columns they name before anything else, so further columns of
any name neither collide nor travel. A null text counts as an empty one.
"""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes of text handled at once by Python code; a longer single text is handled whole.
SLICE_ROWS, SLICE_BYTES = 256, 1 << 20

#: Fold 0 of this many is held out by the learning operators.
FOLDS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). A local master without one gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    jvm = context._jsc.sc().getCheckpointDir()
    if not jvm.isDefined():
        context.setCheckpointDir(tempfile.mkdtemp(prefix="factloom-"))
        jvm = context._jsc.sc().getCheckpointDir()
    return jvm.get()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/factloom/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is something at a path of any store that Spark reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: later reads start from files, not from lineage."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of stored input for a task that shuffles it.
PARTITION_BYTES = 64 << 20


def partitions(df: DataFrame) -> int:
    """Tasks to deal df's rows to: by the size of the files that it reads, at least spark.sql.shuffle.partitions."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return least if size > 1 << 60 else max(least, -(-size // PARTITION_BYTES))  # beyond that the size is unknown


def free_name(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have, whatever its case."""
    taken, name = {c.lower() for c in df.columns}, f"__{base}"
    while name.lower() in taken:
        name += "_"
    return name


def held_out(id_col: str) -> F.Column:
    """Whether crc32 of the id's decimal text falls into fold 0; null ids are held out, so nothing is learned from them."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def slices(batch: pa.RecordBatch, text_col: str, times: int = 1):
    """Consecutive parts of a batch with at most SLICE_ROWS rows and, but for one row, SLICE_BYTES bytes of text, or so many times that."""
    column = batch.column(batch.schema.get_field_index(text_col))
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    start = used = 0
    for i, size in enumerate(sizes):
        if i > start and (i - start >= times * SLICE_ROWS or used + size > times * SLICE_BYTES):
            yield batch.slice(start, i - start)
            start, used = i, 0
        used += size
    if len(sizes) > start:
        yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, text_col: str) -> list[str]:
    return [x or "" for x in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]


def map_texts(df: DataFrame, text_col: str, make, fields: list[T.StructField], keep: list[str]) -> DataFrame:
    """The kept columns of df and, for each slice, the arrays that make()(texts) gives for the fields. One narrow stage."""
    schema = T.StructType([df.schema[c] for c in keep] + fields)
    source = df.select(*dict.fromkeys([*keep, text_col]))

    def run(batches):
        compute = make()
        for batch in batches:
            for part in slices(batch, text_col):
                arrays = compute(texts_of(part, text_col))
                yield pa.RecordBatch.from_arrays(
                    [part.column(part.schema.get_field_index(c)) for c in keep] + list(arrays),
                    names=[*keep, *(f.name for f in fields)],
                )

    return source.mapInArrow(run, schema)


def keep_texts(df: DataFrame, text_col: str, make) -> DataFrame:
    """The rows of df, all columns as they are, for which make()(texts) gives True."""

    def run(batches):
        compute = make()
        for batch in batches:
            for part in slices(batch, text_col):
                yield part.filter(pa.array(compute(texts_of(part, text_col)), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned crc32 of a string of ASCII characters: bytes are mixed in, 256 stands for a shift by one bit."""
    steps = f"flatten(list_transform(range(1, len(({text})) + 1), lambda k: [ascii(({text})[k])::BIGINT, 256, 256, 256, 256, 256, 256, 256, 256]))"
    mixed = "lambda c, v: CASE WHEN v < 256 THEN xor(c, v) ELSE xor(c >> 1, (c & 1) * 3988292384) END"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {steps}), {mixed}), 4294967295::BIGINT)"
