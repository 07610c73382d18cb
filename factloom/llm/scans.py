"""Running sums over a whole table in a given order, without a window that gathers a key in one task.

Rows are dealt out by ranges of the order and sorted there; each task sums up its own rows and writes them; one row of sums for each task
reaches the driver, which adds up what stands before each task; a second, narrow pass adds that. A segment may stretch over many tasks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common


def dealt(df: DataFrame, order: list[str]) -> DataFrame:
    """df in order: partition k, given as column part, comes before partition k + 1."""
    return df.repartitionByRange(common.partitions(df), *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())


def carried(rows: DataFrame, segment: str, sums: list[str], add: Callable[[tuple, tuple], tuple]) -> dict[int, tuple]:
    """part: (segment, sums) that the parts before hand on to it, where their last segment goes on in it. rows: part, row (number within), segment, running sums."""
    last = F.max_by(F.struct(*sums), "row").alias("sums")
    ends = rows.groupBy("part").agg(F.min(segment).alias("first"), F.max(segment).alias("last"), last).orderBy("part").collect()  # a row for each task
    out: dict[int, tuple] = {}
    held: tuple | None = None
    for x in ends:
        total = tuple(x["sums"])
        if held and held[0] == x["first"]:
            out[x["part"]] = held
            if x["first"] == x["last"]:
                total = add(held[1], total)
        held = (x["last"], total)
    return out


def running_sums(df: DataFrame, order: list[str], sums: dict[str, str], name: str, keep: list[str], segment: str | None = None) -> DataFrame:
    """The kept columns and, by name, sums of columns of whole numbers up to and with each row, from the start of its segment (a column of whole
    numbers that comes first in the order) or of the table."""
    source = df.withColumn("__segment", F.col(segment).cast("long") if segment else F.lit(0).cast("long"))
    source = dealt(source, order).select(*keep, "__segment", "part", *[F.col(c).cast("long").alias(n) for n, c in sums.items()])
    schema = T.StructType([*source.schema, T.StructField("row", T.LongType())])
    width = len(keep) + 2

    def local(batches):
        last, held, row = None, [0] * len(sums), 0
        for batch in batches:
            if not (n := batch.num_rows):
                continue
            own = batch.column(len(keep)).to_numpy()
            begins = np.ones(n, bool)
            begins[1:] = own[1:] != own[:-1]
            begins[0] = last is None or own[0] != last
            at = np.maximum.accumulate(np.where(begins, np.arange(n), -1))  # where the row's segment starts in this batch; -1: before it
            out = []
            for k in range(len(sums)):
                total = np.cumsum(batch.column(width + k).to_numpy())
                out.append(total - np.where(at > 0, total[np.maximum(at - 1, 0)], 0) + np.where(at < 0, held[k], 0))
            last, held = own[-1], [x[-1] for x in out]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *map(pa.array, out), pa.array(np.arange(row, row + n))], names=schema.names)
            row += n

    rows = common.written(source.mapInArrow(local, schema), name)
    before = carried(rows, "__segment", list(sums), lambda a, b: tuple(x + y for x, y in zip(a, b, strict=True)))
    result = T.StructType([*[source.schema[c] for c in keep], *[source.schema[c] for c in sums]])

    def whole(batches):
        for batch in batches:
            own, part = batch.column(len(keep)).to_numpy(), batch.column(len(keep) + 1).to_numpy()
            out = [batch.column(width + k).to_numpy().copy() for k in range(len(sums))]
            for p in np.unique(part).tolist():
                if p in before:
                    mine = (part == p) & (own == before[p][0])
                    for x, y in zip(out, before[p][1], strict=True):
                        x[mine] += y
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *map(pa.array, out)], names=result.names)

    return rows.mapInArrow(whole, result)
