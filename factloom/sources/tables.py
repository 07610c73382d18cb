"""Sources and sinks: stores of Parquet tables, adapters from the supplied tables, tool lists, timestamps, vectors."""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions import text as tx


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: Column) -> Column:
    """Microseconds of a timestamp without zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def load_store(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {x: spark.read.parquet(f"{path}/{x}") for x in names}


def save_store(store: dict[str, DataFrame], path: str, partition_by: dict[str, str] | None = None) -> None:
    """A new version of each table under a new path; readers of the old one aren't disturbed."""
    for name, df in store.items():
        by = (partition_by or {}).get(name)
        (df.write.partitionBy(by) if by else df.write).parquet(f"{path}/{name}")


def upgraded(df: DataFrame, schema: str) -> DataFrame:
    """Columns that an older version lacks are added as nulls; the order is the schema's."""
    wanted = T._parse_datatype_string(schema)
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted])


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as turns; the turn's number is its time in seconds."""
    rows = table(spark, sf_dir, "conversations")
    return rows.select(
        F.concat(F.lit("tu_"), F.col("conv_id"), F.lit("_"), F.col("turn")).alias("turn_id"), F.col("conv_id").cast("string").alias("session_id"),
        F.col("role").alias("speaker"), "text", (F.col("turn") * 1_000_000_000).alias("ts"), F.lit("conversation").alias("source_type"),
        F.concat(F.lit("ns"), F.col("conv_id") % 4).alias("namespace"),
    )


TURNS_SQL = """turns AS (
  SELECT 'tu_' || conv_id || '_' || turn AS turn_id, CAST(conv_id AS VARCHAR) AS session_id, role AS speaker, text,
    turn * 1000000000 AS ts, 'conversation' AS source_type, 'ns' || (conv_id % 4) AS namespace
  FROM conversations)"""


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as claims: a user's event type is a slot, the floor of its value what the claim says."""
    e = table(spark, sf_dir, "events")
    k = F.regexp_extract("props", "[0-9]+", 0).cast("long")
    ts = micros(F.col("ts")) * 1000
    kind = F.when(k % 3 == 0, "conversation").when(k % 3 == 1, "tool_call").otherwise("browser")
    speaker = F.when(k % 2 == 0, "user").otherwise("assistant")
    value = F.floor("value").cast("string")
    subject = F.concat(F.lit("u"), F.col("user_id"))
    return e.select(
        F.concat(F.lit("cl_"), F.col("event_id")).alias("claim_id"), F.concat(F.lit("s"), F.col("user_id") % 16).alias("session_id"),
        F.concat_ws(" ", subject, "event_type", value).alias("text"), subject.alias("subject"), F.col("event_type").alias("predicate"), value.alias("value"),
        ((k + 1) / 100.0).alias("confidence"), F.concat(F.lit("tu_"), F.col("event_id")).alias("source_turn_id"), ts.alias("created_ts"), ts.alias("valid_from_ts"),
        kind.alias("source_type"), speaker.alias("speaker"), F.concat(F.lit("ns"), F.col("user_id") % 4).alias("namespace"), tx.source_trust(kind, speaker).alias("source_trust"),
    )


CLAIMS_SQL = """raw AS (
  SELECT *, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events),
claims AS (
  SELECT 'cl_' || event_id AS claim_id, 's' || (user_id % 16) AS session_id,
    'u' || user_id || ' ' || event_type || ' ' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS text,
    'u' || user_id AS subject, event_type AS predicate, CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS value,
    (k + 1) / 100.0 AS confidence, 'tu_' || event_id AS source_turn_id, epoch_us(ts) * 1000 AS created_ts, epoch_us(ts) * 1000 AS valid_from_ts,
    CASE k % 3 WHEN 0 THEN 'conversation' WHEN 1 THEN 'tool_call' ELSE 'browser' END AS source_type,
    CASE k % 2 WHEN 0 THEN 'user' ELSE 'assistant' END AS speaker, 'ns' || (user_id % 4) AS namespace,
    CASE WHEN k % 3 = 2 THEN 0.35 WHEN k % 3 = 1 THEN 0.7 WHEN k % 2 = 1 THEN 0.5 ELSE 1.0 END AS source_trust
  FROM raw)"""


def order_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as claims with few distinct values: restatements, contested and uncontested slots."""
    o = table(spark, sf_dir, "orders")
    ts = micros(F.col("o_orderdate")) * 1000
    return o.select(
        F.concat(F.lit("cl_"), F.col("o_orderkey")).alias("claim_id"), F.concat(F.lit("s"), F.col("o_orderkey") % 32).alias("session_id"),
        F.concat(F.lit("c"), F.col("o_custkey") % 50).alias("subject"), F.col("o_orderstatus").alias("predicate"), F.col("o_orderpriority").alias("value"), ts.alias("created_ts"),
        ((F.col("o_orderkey") % 10) / 10.0).alias("importance"),
    )


ORDER_CLAIMS_SQL = """order_claims AS (
  SELECT 'cl_' || o_orderkey AS claim_id, 's' || (o_orderkey % 32) AS session_id, 'c' || (o_custkey % 50) AS subject, o_orderstatus AS predicate,
    o_orderpriority AS value, epoch_us(o_orderdate) * 1000 AS created_ts, (o_orderkey % 10) / 10.0 AS importance
  FROM orders)"""


#: What an order says as a turn, by its number: an event of each type and plain talk. {n}: a number, {k}: the order's priority.
STORIES = (
    "bought a walnut desk number {n} from Target for ${n}", "the walnut desk number {n} was paid at Costco on Monday", "drove to Denver on a long trip of {n} hours",
    "studied physics at Harvard in {n} weeks", 'watched a movie called "Blue River {n}" by night', "booked a dentist appointment for March at 10:{n}", "went to Walmart near Boston", "nothing of note {k}",
)


def stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as turns of their customers, each with one claim and a topic as its entity."""
    o = table(spark, sf_dir, "orders")
    n, kind = (F.col("o_orderkey") % 50 + 10).cast("string"), F.col("o_orderkey") % 8
    said = F.element_at(F.array(*[F.lit(x) for x in STORIES]), (kind + 1).cast("int"))
    said = F.replace(F.replace(said, F.lit("{n}"), n), F.lit("{k}"), F.col("o_orderpriority"))
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) - 1
    entity = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("topic"), F.col("o_orderkey") % 11)).otherwise("user")
    return o.select(
        F.concat(F.lit("s"), "o_custkey").alias("session_id"), F.concat(F.lit("tu_"), "o_orderkey").alias("turn_id"), place.cast("long").alias("turn_index"),
        F.concat(F.lit("cl_"), "o_orderkey").alias("claim_id"), said.alias("value"), entity.alias("entity"), ((F.col("o_orderkey") % 10 + 1) / 10.0).alias("confidence"),
    )


STORIES_SQL = "stories AS (SELECT 's' || o_custkey AS session_id, 'tu_' || o_orderkey AS turn_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS turn_index, 'cl_' || o_orderkey AS claim_id, replace(replace([" + ", ".join("'" + x.replace("'", "''") + "'" for x in STORIES) + """][o_orderkey % 8 + 1],
    '{n}', CAST(o_orderkey % 50 + 10 AS VARCHAR)), '{k}', o_orderpriority) AS value, CASE WHEN o_orderkey % 3 = 0 THEN 'topic' || (o_orderkey % 11) ELSE 'user' END AS entity, (o_orderkey % 10 + 1) / 10.0 AS confidence FROM orders)"""


#: What an order notes of its customer, by its number: facts that the rules of slots with many values meet. {c}: a city, {n}: a number word.
NOTES = (
    "lives in {c}", "moved to {c} last year", "works at {c} Bank", "has {n} small cats", "has small cats", "favourite colour of the house is {n}", "worked at {c} Bank from 2010 to 2015",
    "enjoys long evening walks near {c}", "long evening walks", "resides in {c}", "has 3 small cats", "enjoys long morning walks near {c}",
)
CITIES, NUMBERS = ("Oslo", "Rome", "Bern"), ("two", "three", "four")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as claims of one slot of many values for each customer; neighbouring orders share a turn."""
    o, ts = table(spark, sf_dir, "orders"), micros(F.col("o_orderdate")) * 1000
    pick = lambda values, n: F.element_at(F.array(*[F.lit(x) for x in values]), (n + 1).cast("int"))
    k = F.col("o_orderkey")
    value = F.replace(F.replace(pick(NOTES, k % len(NOTES)), F.lit("{c}"), pick(CITIES, F.col("o_custkey") % 2 + F.floor(k / 7) % 2)), F.lit("{n}"), pick(NUMBERS, F.floor(k / 5) % 3))
    speaker = F.when(k % 4 == 0, "assistant").otherwise("user")
    kind = F.when(k % 5 == 0, "browser").otherwise("conversation")
    return o.select(
        F.concat(F.lit("s"), "o_custkey").alias("session_id"), F.lit("user").alias("subject"), F.lit("noted").alias("predicate"), F.concat(F.lit("cl_"), k).alias("claim_id"), value.alias("value"),
        F.concat(F.lit("tu_"), F.floor(k / 3)).alias("source_turn_id"), speaker.alias("speaker"), tx.source_trust(kind, speaker).alias("source_trust"), ts.alias("created_ts"),
    )


def _picked(values: tuple[str, ...], n: str) -> str:
    return "[" + ", ".join(f"'{x}'" for x in values) + f"][{n} + 1]"


NOTES_SQL = f"""notes AS (SELECT 's' || o_custkey AS session_id, 'cl_' || o_orderkey AS claim_id,
  replace(replace({_picked(NOTES, f"o_orderkey % {len(NOTES)}")}, '{{c}}', {_picked(CITIES, "o_custkey % 2 + (o_orderkey // 7) % 2")}), '{{n}}', {_picked(NUMBERS, "(o_orderkey // 5) % 3")}) AS value,
  'tu_' || (o_orderkey // 3) AS source_turn_id, CASE WHEN o_orderkey % 4 = 0 THEN 'assistant' ELSE 'user' END AS speaker,
  (CASE WHEN o_orderkey % 5 = 0 THEN 0.35 WHEN o_orderkey % 4 = 0 THEN 0.5 ELSE 1.0 END)::DOUBLE AS source_trust, epoch_us(o_orderdate) * 1000 AS created_ts FROM orders)"""


#: What an order's customer says, by its number: sentences that the patterns read. {c}: a city, {n}: a number word.
SAYINGS = ("I live in {c}", "I prefer green tea", "I have {n} small cats", "I have 3 small cats", "I like long evening walks near {c}", "I like long morning walks near {c}", "My name is {c} Smith", "uh ok", "I lived in {c} from 2010 to 2015", "I prefer black tea.")


def sayings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as turns of their customers' sessions."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    pick = lambda values, n: F.element_at(F.array(*[F.lit(x) for x in values]), (n + 1).cast("int"))
    said = F.replace(F.replace(pick(SAYINGS, k % len(SAYINGS)), F.lit("{c}"), pick(CITIES, F.floor(k / 7) % 2)), F.lit("{n}"), pick(NUMBERS, F.floor(k / 5) % 3))
    return o.select(
        F.concat(F.lit("tu_"), k).alias("turn_id"), F.concat(F.lit("s"), "o_custkey").alias("session_id"), F.when(k % 4 == 0, "assistant").otherwise("user").alias("speaker"), said.alias("text"),
        (micros(F.col("o_orderdate")) * 1000).alias("ts"), F.lit("conversation").alias("source_type"), F.lit("default").alias("namespace"),
    )


SAYINGS_SQL = f"""turns AS (SELECT 'tu_' || o_orderkey AS turn_id, 's' || o_custkey AS session_id, CASE WHEN o_orderkey % 4 = 0 THEN 'assistant' ELSE 'user' END AS speaker,
  replace(replace({_picked(SAYINGS, f"o_orderkey % {len(SAYINGS)}")}, '{{c}}', {_picked(CITIES, "(o_orderkey // 7) % 2")}), '{{n}}', {_picked(NUMBERS, "(o_orderkey // 5) % 3")}) AS text, epoch_us(o_orderdate) * 1000 AS ts FROM orders)"""


#: What a session's messages may be called, where a message may keep its words, and who speaks under other names. Fixed values.
SESSION_KEYS = ("messages", "turns", "conversation")
MESSAGE_KEYS = ("content", "text", "message", "value", "utterance")
SPOKEN_BY = {"assistant": ("assistant", "ai", "bot", "model"), "system": ("system", "developer", "tool")}


def bare(text: Column) -> Column:
    """Without white space of any script at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def variant_kind(v: Column) -> Column:
    """STRING, ARRAY, OBJECT or another word; null for nothing."""
    return F.when(v.isNotNull() & ~F.is_variant_null(v), F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0))


def variant_text(v: Column) -> Column:
    """A string as it is, anything else as compact JSON with its keys in order, nothing as the empty text."""
    return F.coalesce(F.when(variant_kind(v) == "STRING", F.try_variant_get(v, "$", "string")).when(variant_kind(v).isNotNull(), F.to_json(v)), F.lit(""))


def variant_list(v: Column) -> Column:
    return F.when(variant_kind(v) == "ARRAY", F.try_variant_get(v, "$", "array<variant>"))


def field_of(v: Column, name: str) -> Column:
    return F.when(variant_kind(v) == "OBJECT", F.try_variant_get(v, f"$.{name}", "variant"))


def message_text(m: Column) -> Column:
    """A message's words: itself, or the first of its fields that is a list of parts or a text that is not blank; failing these, all of it as JSON."""

    def part(x: Column) -> Column:
        said = variant_text(field_of(x, "text"))
        return F.when(variant_kind(x) == "OBJECT", F.when(said != "", said).otherwise(variant_text(field_of(x, "content")))).otherwise(variant_text(x))

    words = []
    for key in MESSAGE_KEYS:
        held = field_of(m, key)
        said = variant_text(held)
        parts = F.filter(F.transform(variant_list(held), part), lambda x: bare(x) != "")
        words.append(F.when((variant_kind(held) == "STRING") & (bare(said) != ""), said).when(variant_kind(held) == "ARRAY", F.array_join(parts, "\n")))
    return F.coalesce(*words, variant_text(m))


def speaker_of(role: Column) -> Column:
    said = F.lower(bare(role))
    return F.when(said.isin(*SPOKEN_BY["assistant"]), "assistant").when(said.isin(*SPOKEN_BY["system"]), "system").otherwise("user")


def document_turns(docs: DataFrame) -> DataFrame:
    """Benchmark documents (id, user_id, timestamp, context, content, messages) as turns.

    messages is a list of records, or JSON text; without it, content may be JSON that is a list or has one under messages, turns or conversation. Blank
    messages are left out; the first one carries the context. A document without messages is one turn of its content. Nulls are empty texts; a null
    user_id is the default namespace; a timestamp that can't be read leaves ts null. Everything is an expression of the document's own row.
    """
    v = F.when(F.col("content").isNotNull(), F.try_parse_json("content"))
    listed = [variant_list(v), *[variant_list(field_of(v, k)) for k in SESSION_KEYS]]
    if "messages" in docs.columns:
        given = F.col("messages") if isinstance(docs.schema["messages"].dataType, T.StringType) else F.to_json("messages")
        listed.insert(0, variant_list(F.try_parse_json(given)))
    context, content = bare(F.coalesce("context", F.lit(""))), F.coalesce("content", F.lit(""))

    def read(m: Column, i: Column) -> Column:
        role, other = variant_text(field_of(m, "role")), variant_text(field_of(m, "speaker"))
        return F.struct(speaker_of(F.when(role != "", role).otherwise(other)).alias("speaker"), bare(message_text(m)).alias("said"), (i == 0).alias("first"))

    whole = F.array(F.struct(F.lit("user").alias("speaker"), bare(content).alias("said"), F.lit(True).alias("first")))
    rows = docs.select("id", "user_id", "timestamp", context.alias("__context"), whole.alias("__whole"), F.filter(F.transform(F.coalesce(*listed), read), lambda m: m["said"] != "").alias("__read"))
    empty = F.coalesce(F.size("__read") < 1, F.lit(True))
    rows = rows.select("id", "user_id", "timestamp", "__context", empty.alias("__empty"), F.posexplode(F.when(empty, F.col("__whole")).otherwise(F.col("__read"))).alias("i", "m"))
    head = F.when(F.col("m.first") & (F.col("__context") != ""), F.concat(F.lit("Document context: "), "__context", F.lit("\n"))).otherwise("")
    return rows.select(
        F.concat(F.lit("doc:"), F.col("id"), F.lit(":"), F.col("i")).alias("turn_id"), F.col("id").alias("session_id"), F.col("m.speaker").alias("speaker"),
        F.concat(head, F.when(F.col("__empty"), "Document").otherwise(F.initcap("m.speaker")), F.lit(" turn: "), F.col("m.said")).alias("text"),
        (parse_timestamp(F.col("timestamp")) + F.col("i").cast("long") * 1_000_000_000).alias("ts"), F.lit("conversation").alias("source_type"), F.coalesce("user_id", F.lit("default")).alias("namespace"),
    )


def parse_timestamp(text: Column) -> Column:
    """Nanoseconds: a number's magnitude tells seconds, milliseconds or nanoseconds; else ISO, year-month-day or month/day/year, UTC."""
    number = text.try_cast("double")
    scaled = F.when(number > 1e17, number).when(number > 1e11, number * 1e6).otherwise(number * 1e9).cast("long")
    formats = (None, "yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy")
    parsed = [F.try_to_timestamp(text, F.lit(f)) if f else F.try_to_timestamp(text) for f in formats]
    return F.when(number.isNotNull(), scaled).otherwise(F.unix_micros(F.coalesce(*parsed)) * 1000)


def tools_from_json(spark: SparkSession, path: str, server: str) -> DataFrame:
    """A tools/list document ({"tools": [...]} or a list) as registry rows; parameters stay JSON."""
    raw = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    kind = F.schema_of_variant("v")
    listed = F.when(kind.startswith("OBJECT"), F.variant_get("v", "$.tools", "array<variant>")).otherwise(F.try_variant_get("v", "$", "array<variant>"))
    rows = raw.select(F.explode(listed).alias("t"))
    name = F.variant_get("t", "$.name", "string")
    return rows.select(
        F.concat(F.lit(f"mcp:{server}:"), name).alias("id"), name.alias("name"), F.coalesce(F.try_variant_get("t", "$.description", "string"), F.lit("")).alias("description"),
        F.to_json(F.try_variant_get("t", "$.inputSchema", "variant")).alias("parameters"), F.lit(server).alias("server"),
    )


def upsert(old: DataFrame, new: DataFrame, key: str = "id", keep: tuple[str, ...] = ("created_at",)) -> DataFrame:
    """Rows of new replace those of old by key; columns in keep stay as first seen."""
    a, b = old.alias("a"), new.alias("b")
    columns = []
    for c in old.columns:
        first, then = (F.col(f"a.{c}"), F.col(f"b.{c}")) if c in keep else (F.col(f"b.{c}"), F.col(f"a.{c}"))
        columns.append(F.when(F.col(f"b.{key}").isNull(), F.col(f"a.{c}")).otherwise(F.coalesce(first, then) if c in keep else first).alias(c))
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer").select(*columns)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decode_vector(blob):
    """Little-endian count and 32-bit floats; null for a damaged blob."""
    import numpy as np
    import pandas as pd

    def one(x):
        if x is None or len(x) < 4 or struct.unpack_from("<I", x)[0] * 4 + 4 != len(x):
            return None
        return np.frombuffer(x, "<f4", offset=4)

    return pd.Series([one(x) for x in blob])


@F.pandas_udf(T.BinaryType())
def encode_vector(vector):
    import numpy as np
    import pandas as pd

    return pd.Series([None if x is None else struct.pack("<I", len(x)) + np.asarray(x, "<f4").tobytes() for x in vector])


def hash_embedder(size: int = 64):
    """A deterministic stand-in for an embedding model: words in signed buckets, unit length."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(text):
        import re
        import zlib

        import numpy as np
        import pandas as pd

        def one(x):
            v = np.zeros(size, np.float32)
            for w in re.findall("[a-z0-9]+", (x or "").lower()):
                h = zlib.crc32(w.encode())
                v[h % size] += 1 if h >> 31 else -1
            n = float(np.sqrt((v * v).sum()))
            return v / n if n else v

        return pd.Series([one(x) for x in text])

    return embed


def backfill(rows: DataFrame, vectors: DataFrame, embed, version: str, id_col: str, text_col: str) -> DataFrame:
    """Vectors of this version: those that exist, and new ones for rows without; each distinct text is embedded once."""
    have = vectors.filter(F.col("model_version") == version).select(id_col, "embedding", "model_version")
    lack = rows.select(id_col, F.col(text_col).alias("text")).join(have, id_col, "left_anti").withColumn("key", F.sha2(F.concat_ws("\0", F.lit(version), "text"), 256))
    fresh = lack.dropDuplicates(["key"]).select("key", embed("text").alias("embedding"))
    return have.unionByName(lack.join(fresh, "key").select(id_col, "embedding", F.lit(version).alias("model_version")))


def load_tools(registry: DataFrame, source: str | None = None, dataset: str | None = None) -> DataFrame:
    """Tools of a source and a dataset, of all without one, by id."""
    for name, value in (("source", source), ("dataset", dataset)):
        registry = registry if value is None else registry.filter(F.col(name) == value)
    return registry.orderBy("id")


def tool_counts(registry: DataFrame) -> DataFrame:
    return registry.groupBy("source", "dataset").agg(F.count("*").alias("tools"))


def retimed(rows: DataFrame, times: DataFrame, key: str, columns: tuple[str, ...], ordinal: str) -> DataFrame:
    """Rows with their times set to those of their source (key, ts), a second later for each place in it."""
    at = F.col("__ts") + F.col(ordinal).cast("long") * 1_000_000_000
    met = rows.join(times.select(key, F.col("ts").alias("__ts")), key, "left")
    return met.withColumns({c: F.coalesce(at, F.col(c)) for c in columns}).drop("__ts")


def monotone(rows: DataFrame, part: str, ts: str = "ts", order: tuple[str, ...] = ()) -> DataFrame:
    """Times made strictly increasing in the order of time and then of columns: one that isn't later than the one before is a nanosecond after it."""
    w = Window.partitionBy(part).orderBy(ts, *order)
    place = F.row_number().over(w)
    lead = F.max(F.col(ts) - F.col("__place")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("__place", place).withColumn("__lead", lead).withColumn(ts, F.col("__lead") + F.col("__place")).drop("__place", "__lead")


def read_packs(spark: SparkSession, path: str) -> dict[str, dict]:
    """Predicate packs of JSON files (id, families, single_valued, sub_slots), by id. Vocabularies are small."""
    schema = "pack_id string, id string, predicate_families array<string>, families array<string>, single_valued array<string>, sub_slots map<string, array<string>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).collect()
    return {
        (r.pack_id or r.id): {"families": tuple(r.predicate_families or r.families or ()), "single_valued": tuple(r.single_valued or ()), "sub_slots": {k: tuple(v) for k, v in (r.sub_slots or {}).items()}}
        for r in rows
    }


def merged_pack(packs: dict[str, dict], names: list[str]) -> dict:
    """Packs as one: families and single-valued predicates united in order, of sub-slots the later pack's; an unknown name is an error."""
    lacking = [x for x in names if x not in packs]
    if lacking:
        raise KeyError(f"no such packs: {', '.join(lacking)}")
    chosen = [packs[x] for x in names]
    out = {k: tuple(dict.fromkeys(v for p in chosen for v in p.get(k, ()))) for k in ("families", "single_valued")}
    slots = {k: v for p in chosen for k, v in p.get("sub_slots", {}).items()}
    return {"id": names[0] if len(names) == 1 else "merged:" + "+".join(names), **out, "sub_slots": slots}


def validated_append(existing: DataFrame, new: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """New rows with a key of their own, and those that are refused: their key is taken, missing, or another row of the batch has it too."""
    taken = existing.select(F.col(key).alias("__key")).union(new.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").select(key)).distinct()
    marked = new.join(taken.withColumn("__taken", F.lit(True)), F.col(key) == F.col("__key"), "left")
    refused = F.col(key).isNull() | F.coalesce("__taken", F.lit(False))
    return tuple(marked.filter(x).select(*new.columns) for x in (~refused, refused))
