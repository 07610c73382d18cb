"""The corpus pipeline: language ID, toxicity, SimHash near-dedup, secret scans, packing.

STAGES lists (name, function) in order; each function takes (spark, docs, sf_dir), and what it returns
is written as Parquet and read again as the next one's docs. All but the last return the columns of
documents. run() applies them to the documents table.

Rows may be odd in any column; the stages say what that gives. A null or letterless text is rejected by the first stage, one
without words among the learned ones is not toxic by itself. Rows of equal id and text are one document after the third
stage; rows without id count as documents and stay only where no member of their group has one. Very long texts are handled
whole. Columns beyond those of documents, of any name, pass through the first four stages. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import common, langid, packing, secrets, simhash, toxicity


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language that can be told."""
    return langid.keep_known(docs, langid.train(docs))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic, by a network trained on the labelled documents among them."""
    model = toxicity.train(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near copies."""
    return simhash.deduplicated(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked."""
    return secrets.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a packed sequence."""
    return packing.packed(docs)


STAGES = [("language_id", language), ("toxicity", clean), ("simhash_dedup", distinct), ("secret_scan", redact), ("packing", pack)]

#: Trained models and token ids are beyond SQL; tests hold the result against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = common.written(docs, f"pipeline-{name}")
    return docs
