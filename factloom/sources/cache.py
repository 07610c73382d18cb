"""Vectors by content: a text is embedded once for each model, whatever rows have it.

The key is the hash of model and text. Files are parted by the key's first byte, so a lookup reads the parts of its own keys; a run adds what was lacking in one commit.
Turns, claims, tools and frames can share a cache.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.sources import store as st

TABLE = "vectors"


def key(model: str, text: Column) -> Column:
    return F.sha2(F.concat(F.lit(model), F.lit("\0"), F.coalesce(text, F.lit(""))), 256)


def part(of: Column) -> Column:
    return F.conv(F.substring(of, 1, 2), 16, 10).cast("int")


def lacking(store: st.Store, texts: DataFrame, model: str) -> DataFrame:
    """Distinct (key, text) of texts that the cache has no vector of."""
    asked = texts.select(F.coalesce("text", F.lit("")).alias("text")).distinct().select(key(model, F.col("text")).alias("key"), "text")
    before = store.manifest()
    if TABLE not in before.tables:
        return asked
    parts = [r.part for r in asked.select(part(F.col("key")).alias("part")).distinct().collect()]  # at most 256
    held = store.read_at(before, TABLE).filter(F.col("part").isin(parts))
    return asked.join(held.select("key"), "key", "left_anti")


def embedded(store: st.Store, rows: DataFrame, embed: Callable[[str], Column], model: str, text_col: str = "text") -> tuple[DataFrame, int]:
    """The rows with a column embedding, and how many texts had to be embedded for that."""
    fresh = lacking(store, rows.select(F.col(text_col).alias("text")), model)
    made = fresh.select("key", F.lit(model).alias("model"), embed("text").alias("embedding"), part(F.col("key")).alias("part"))
    entry = store.write_folder(TABLE, made.repartition("part"), ("part",))
    new = store.spark.read.schema(made.schema).parquet(f"{store.path}/{entry['path']}")
    count = new.count()
    if count:
        # two runs may have embedded one text at once: rows are replaced by key, and either vector serves
        store.commit({TABLE: st.Change("replace", new, key=("key",), entry=entry)}, note=f"embed {model}")
    if TABLE not in store.manifest().tables:
        return rows.withColumn("embedding", F.lit(None).cast("array<float>")), 0
    vectors = store.read(TABLE).filter(F.col("model") == model).select(F.col("key").alias("__key"), "embedding")
    return rows.withColumn("__key", key(model, F.col(text_col))).join(vectors, "__key").drop("__key"), count
