"""WARC archives as a chunked record table.

An archive is the concatenation of the data of its rows, by record and chunk number: chunk 0 is
the record's header, the others hold at most CHUNK bytes of payload each, and the last ends with the
record's two line breaks. So a payload of any size is streamed as (record id, chunk number)
rows; neither writer nor reader holds a whole record in Python. Every chunk carries the SHA-256 of the payload so far,
which the reader recomputes as it goes.

Of records with equal payloads of at least REVISIT bytes the one with the least page id is the response and
the others are revisits without payload that name it. Equal payloads are found by
digest: the table of repeated digests comes from a pre-aggregated grouping of narrow rows and is written. Up to BROADCAST of them, a checked count, are broadcast; of more, payloads
pass through one shuffle, in which a digest of very many rows can be split. A page's html is one value of the given table and so whole in the engine until it is cut.

A reader recomputes sizes and digests where the chunks lie; only what it found, narrow rows, is brought together by record. Records of several payload
chunks, whose digest needs them in order, are the ones whose data is shuffled.

Control characters of a url, line breaks among them, are percent-encoded in the header, so that no url can end or
add a header field; the url is read back in that form.

Null payload: empty. Repeated rows with one page id give a record each; the first of equal rows is the response
only if its id is the least, so copies with that id are all responses. Null page ids sort after
others and are revisits if some page with an id has the payload. Empty tables give empty archives. Extra
columns aren't read.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

CHUNK = 1 << 18
#: Repeated digests that may be broadcast.
BROADCAST = 1 << 18
REVISIT = 100
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

SCHEMA = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("chunk_no", T.LongType()),
        T.StructField("n_chunks", T.LongType()),
        T.StructField("data", T.BinaryType()),
        T.StructField("payload_in_chunk", T.IntegerType()),
        T.StructField("digest_so_far", T.StringType()),
    ]
)


CONTROL = re.compile(r"[\x00-\x1f\x7f]")


def safe(url: str) -> str:
    return CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url)


def header(kind: str, page_id: int | None, url: str, size: int, digest: str, refers_to: int | None, payload_bytes: int) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {safe(url)}"]
    lines += ["Content-Type: text/html; charset=utf-8", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {payload_bytes}"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join([*lines, f"Content-Length: {size}", "", ""]).encode()


def parse_header(data: bytes) -> dict[str, str]:
    first, *lines = data.decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    return dict(x.split(": ", 1) for x in lines if x)


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """page_id, url, payload, digest, size, refers_to: what is to be written."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload").cast("long"))
    repeated = rows.filter(F.col("size") >= REVISIT).groupBy("digest").agg(F.min("page_id").alias("least"), F.count("*").alias("n"))
    repeated = common.written(repeated.filter("n > 1").select("digest", "least"), "warc-repeated")
    if repeated.count() <= BROADCAST:
        repeated = F.broadcast(repeated)  # payloads then stay where they are read
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("least")), F.col("least")).alias("refers_to")
    return rows.join(repeated, "digest", "left").select("page_id", "url", "payload", "digest", "size", refers)


def chunked(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Rows of the chunk table. The payload is cut by the engine before Python sees it; revisits have no payload chunk."""
    pieces = F.when(F.col("refers_to").isNotNull(), 0).otherwise(F.ceil(F.col("size") / chunk)).cast("int")
    cut = rows.withColumn("pieces", pieces).withColumn("no", F.explode(F.sequence(F.lit(0), F.col("pieces"))))
    part = F.when(F.col("no") > 0, F.substring("payload", (F.col("no") - 1) * chunk + 1, F.lit(chunk))).otherwise(F.lit(b""))
    cut = cut.select("page_id", "url", "digest", "size", "refers_to", F.monotonically_increasing_id().alias("serial"), "pieces", "no", part.alias("part"))

    def run(batches):
        running, record = hashlib.sha256(), ""
        for batch in batches:
            out: list[list] = [[] for _ in SCHEMA]
            held = 0
            for i in range(batch.num_rows):
                page, url, digest, size, refers, serial, pieces, no, part = (c[i].as_py() for c in batch.columns)
                if no == 0:
                    running, record = hashlib.sha256(), f"{serial:016x}"
                    data = header("response" if refers is None else "revisit", page, url, size if refers is None else 0, digest, refers, size)
                else:
                    running.update(part)
                    data = part
                if no == pieces:
                    data += b"\r\n\r\n"
                row = (record, no, pieces + 1, data, len(part), running.copy().hexdigest())
                for c, v in zip(out, row, strict=True):
                    c.append(v)
                held += len(data)
                if held > 4 << 20 or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.string()), strict=True)], names=SCHEMA.names)
                    out, held = [[] for _ in SCHEMA], 0

    return cut.mapInArrow(run, SCHEMA)


def write(pages: DataFrame, path: str, chunk: int = CHUNK, **columns: str) -> None:
    chunked(records(pages, **columns), chunk).write.parquet(path)


READ_SCHEMA = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
    ]
)


def number(text: str | None) -> int | None:
    digits = (text or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def record(fields: dict[str, str], size: int, digest: str) -> tuple:
    """A row of a record from its header and what its stored payload amounts to, which must agree."""
    if size != int(fields["Content-Length"]):
        raise ValueError("damaged record")
    kind, told = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if kind == "response" and digest != told:
        raise ValueError("payload and digest differ")
    return number(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], size if kind == "response" else int(fields["WARC-Payload-Length"]), told, kind, number(fields.get("WARC-Refers-To"))


ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
NOTED = T.StructType([T.StructField("record_id", T.StringType()), T.StructField("chunk_no", T.LongType()), T.StructField("n_chunks", T.LongType()), T.StructField("header", T.BinaryType()), T.StructField("size", T.LongType()), T.StructField("digest", T.StringType())])
EMPTY = hashlib.sha256().hexdigest()


def table(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], f.type) for k, f in enumerate(ARROW)], schema=ARROW)


def noted(batches):
    """What each chunk of a record with at most one payload chunk amounts to: the header's text, or the payload's size and digest."""
    for batch in batches:
        out = []
        for record_id, no, chunks, data, length, so_far in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if no + 1 == chunks and not data.endswith(b"\r\n\r\n"):
                raise ValueError("damaged record")
            found = hashlib.sha256(memoryview(data)[:length]).hexdigest() if no else EMPTY
            if found != so_far:
                raise ValueError("damaged chunk")
            out.append((record_id, no, chunks, data.removesuffix(b"\r\n\r\n") if not no else None, length, found))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.string()))], names=NOTED.names)


def paired(batches):
    """Records from such notes, sorted by record and chunk number."""
    fields, expected, at = {}, 0, None
    for batch in batches:
        out = []
        for record_id, no, chunks, head, size, digest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if no != expected or (no and record_id != at):
                raise ValueError(f"chunk {no} where {expected} was due")
            if no == 0:
                fields, at = parse_header(head), record_id
            expected = no + 1
            if expected == chunks:
                expected = 0
                out.append(record(fields, size if no else 0, digest))
        yield table(out)
    if expected:
        raise ValueError("a record's chunk is missing")


def streamed(batches):
    """Records of any number of chunks, sorted by record and chunk number, one chunk at a time."""
    fields, running, size, expected = {}, hashlib.sha256(), 0, 0
    for batch in batches:
        out = []
        for i in range(batch.num_rows):
            _, no, chunks, data, length, so_far = (c[i].as_py() for c in batch.columns)
            if no != expected:
                raise ValueError(f"chunk {no} where {expected} was due")
            if no == 0:
                fields, running, size = parse_header(data), hashlib.sha256(), 0
            else:
                running.update(memoryview(data)[:length])
                size += length
            if running.copy().hexdigest() != so_far:
                raise ValueError("damaged chunk")
            expected = no + 1
            if expected < chunks:
                continue
            expected = 0
            if not data.endswith(b"\r\n\r\n"):
                raise ValueError("damaged record")
            out.append(record(fields, size, running.hexdigest()))
        yield table(out)


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of an archive. Payload sizes and digests are recomputed from the stored chunks and must agree
    with the header; a revisit has those of its header.

    A record's chunks may lie in different splits of a file. Of records with at most one payload chunk only notes are dealt by record; of larger
    ones the chunks are, and pass through a task one by one.
    """
    rows = spark.read.schema(SCHEMA).parquet(path)
    notes = rows.filter("n_chunks <= 2").mapInArrow(noted, NOTED)
    brief = notes.repartition("record_id").sortWithinPartitions("record_id", "chunk_no").mapInArrow(paired, READ_SCHEMA)
    large = rows.filter("n_chunks > 2")
    return brief.unionByName(large.repartition(common.partitions(rows), "record_id").sortWithinPartitions("record_id", "chunk_no").mapInArrow(streamed, READ_SCHEMA))


def archive_bytes(spark: SparkSession, path: str):
    """The archive as a stream of bytes, for a client that wants one WARC file."""
    for row in spark.read.schema(SCHEMA).parquet(path).orderBy("record_id", "chunk_no").select("data").toLocalIterator():
        yield bytes(row.data)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.scratch(spark, "warc")
    write(common.table(spark, sf_dir, "pages"), path)
    return read(spark, path).drop("url")


ORACLE = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
  SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_digest FROM p
), m AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS least FROM d
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> least THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> least THEN least END AS refers_to
FROM m
"""
