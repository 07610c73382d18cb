"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Every version of every path is named by its content (SHA-256 of the text). The ledger has a row
for each blob and rule version that was scanned, with the spans found. An update scans only the pairs
of blob and rule version that the ledger lacks, each blob once however many paths and
versions hold it; findings are then joined back to all paths.

A rule is a pattern and a least length of one of its groups. Matches are leftmost and don't
overlap within a rule; spans count code points, their end is exclusive. Positions come from
cutting the text at the matches: the lengths of the parts between and of the matches add
up to them, in time linear in the text and its matches.

A kept ledger lives at a path that the caller names and keeps: extend() reads it, scans what it lacks and
appends that. A ledger row is true whatever became of the rest of its batch, for it names its content; so a batch
that a lost job left in part, or twice, does no harm.

Null text: empty. Repeated rows: a row each. Extra columns pass through redacted() and aren't read
otherwise. Empty tables give empty results. Texts may be of any length.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


class Rule(NamedTuple):
    kind: str
    version: int
    pattern: str
    group: int  # the group whose length counts
    least: int  # its least number of characters
    hint: str  # a pattern that each match holds, cheap to look for

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: In the order in which equal starts are listed.
RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, r"(?i:password|passwd|secret|token|api_?key)"),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20, r"AKIA[A-Z0-9]{16}"),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24, r"[0-9a-f]{24}"),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, r"PRIVATE KEY-----"),
    Rule("forge", 1, r"gh[opsu]_[A-Za-z0-9]{36,}", 0, 40, r"gh[opsu]_"),
)
BASE = ("assign", "access", "hex")
MASK = "[SECRET]"
SPANS = "array<struct<start:bigint,kind_no:int,kind:string,stop:bigint>>"


def blob(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


#: Members of an array that are folded at once; appending to an array copies it, so longer ones are folded block by block.
BLOCK = 128


def let(value: Column, use) -> Column:
    """use(value), the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def before(values: Column, start: Column, step, kind: str = "bigint") -> Column:
    """For each member, the associative step over those before it: a running sum or maximum, in time that is linear but for BLOCK."""

    def run(part: Column, at: Column) -> Column:
        state = F.struct(at.cast(kind).alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
        grown = F.aggregate(part, state, lambda s, x: F.struct(step(s["at"], x).cast(kind).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")))
        return grown["out"]

    def blocks(v: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int"))
        return F.transform(numbers, lambda i: F.slice(v, i * BLOCK + 1, F.lit(BLOCK)))

    def joined(parts: Column) -> Column:
        totals = F.transform(parts, lambda x: F.aggregate(x, start.cast(kind), lambda s, y: step(s, y).cast(kind)))
        return let(run(totals, start), lambda heads: F.flatten(F.transform(parts, lambda x, i: run(x, F.get(heads, i)))))

    return let(values, lambda v: F.when(F.size(v) > 0, let(blocks(v), joined)).otherwise(F.array().cast(f"array<{kind}>")))


def rule_spans(text: Column, rule: Rule, number: int) -> Column:
    """The spans of a rule in a text that isn't null."""
    pattern = F.lit(rule.pattern)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    counted = matches if rule.group == 0 else F.regexp_extract_all(text, pattern, F.lit(rule.group))
    pieces = F.transform(
        F.arrays_zip(matches.alias("m"), counted.alias("c"), F.split(text, rule.pattern, -1).alias("gap")),
        lambda x: F.struct(F.length(x["gap"]).cast("bigint").alias("gap"), F.coalesce(F.length(x["m"]), F.lit(0)).cast("bigint").alias("size"), F.length(x["c"]).alias("counted")),
    )

    def spans(p: Column) -> Column:
        at = before(F.transform(p, lambda x: x["gap"] + x["size"]), F.lit(0), lambda s, x: s + x)
        placed = F.transform(F.arrays_zip(p.alias("p"), at.alias("at")), lambda x: F.struct((x["at"] + x["p"]["gap"]).alias("start"), x["p"]["size"].alias("size"), x["p"]["counted"].alias("counted")))
        kept = F.filter(placed, lambda x: x["counted"] >= rule.least)
        return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), F.lit(number).alias("kind_no"), F.lit(rule.kind).alias("kind"), (x["start"] + x["size"]).alias("stop")))

    return F.when(text.rlike(rule.hint), let(pieces, spans).cast(SPANS)).otherwise(F.array().cast(SPANS))


def unseen(versions: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """blob, text, todo: each distinct content with rule versions it was not scanned by, and those."""
    named = versions.select(blob(F.col(text_col)).alias("blob"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    once = named.groupBy("blob").agg(F.first("text").alias("text"))
    keys = F.array(*[F.lit(r.key) for r in rules])
    if ledger is None:
        return once.select("blob", "text", keys.alias("todo"))
    seen = ledger.groupBy("blob").agg(F.collect_set("rule").alias("seen"))
    todo = F.array_except(keys, F.coalesce("seen", F.array().cast("array<string>")))
    return once.join(seen, "blob", "left").select("blob", "text", todo.alias("todo")).filter(F.size("todo") > 0)


def scan(todo: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows: blob, rule, spans."""
    found = [F.struct(F.lit(r.key).alias("rule"), F.when(F.array_contains("todo", r.key), rule_spans(F.col("text"), r, i)).alias("spans")) for i, r in enumerate(rules)]
    return todo.select("blob", F.inline(F.array(*found))).filter("spans is not null")


def update(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The ledger after scanning what it lacks. The new part is written to the shared folder."""
    new = common.written(scan(unseen(versions, ledger, rules, text_col), rules), "blob-ledger")
    return new if ledger is None else ledger.unionByName(new)


LEDGER = f"blob string, rule string, spans {SPANS}"


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger kept at a path, empty if there is none yet."""
    return spark.read.schema(LEDGER).parquet(path) if common.exists(spark, path) else spark.createDataFrame([], LEDGER)


def extend(versions: DataFrame, path: str, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """Scans the pairs of blob and rule version that the ledger at the path lacks, appends them, and returns it."""
    spark = versions.sparkSession
    new = scan(unseen(versions, read_ledger(spark, path) if common.exists(spark, path) else None, rules, text_col), rules)
    new.write.mode("append").parquet(path)
    return read_ledger(spark, path)


def by_blob(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob, spans of the given rule versions by start and kind, for blobs that have any."""
    current = ledger.filter(F.col("rule").isin([r.key for r in rules]) & (F.size("spans") > 0))
    # a row that was written twice gives the same spans twice
    rows = F.transform(F.collect_set(F.struct("rule", "spans")), lambda x: x["spans"])
    return current.groupBy("blob").agg(F.array_sort(F.flatten(rows)).alias("spans"))


def as_text(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])))


def findings(versions: DataFrame, ledger: DataFrame, keep: list[str], rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The kept columns of each version with the spans of its content."""
    named = versions.select(*keep, blob(F.col(text_col)).alias("blob"))
    found = common.written(by_blob(ledger, rules), "blob-findings")  # read from files, so a blob of very many paths can be split in the join
    return named.join(found, "blob", "left").withColumn("spans", F.coalesce("spans", F.array().cast(SPANS)))


def merged(spans: Column) -> Column:
    """Spans sorted by start as parts of the text that don't overlap: start, and stop of the part's longest reach."""

    def cut(own: Column) -> Column:
        reach = before(F.transform(own, lambda x: x["stop"]), F.lit(-1), F.greatest)
        # a span that starts before the reach of those before it goes on with their part
        opens = F.filter(F.arrays_zip(own.alias("x"), reach.alias("reach")), lambda x: x["x"]["start"] >= x["reach"])
        last = F.aggregate(own, F.lit(-1).cast("bigint"), lambda s, x: F.greatest(s, x["stop"]))

        def parts(o: Column) -> Column:
            return F.transform(o, lambda x, i: F.struct(x["x"]["start"].alias("start"), F.coalesce(F.get(o, i + 1)["reach"], last).alias("stop")))

        return let(opens, parts)

    return let(spans, cut)


def masked(text: Column, spans: Column, mask: str = MASK) -> Column:
    """The text with each span, or run of overlapping spans, replaced by the mask. In UTF-32 a code point's place is found without a search."""

    def keep(parts: Column) -> Column:
        starts = F.concat(F.transform(parts, lambda x: x["start"]), F.array(F.length(text).cast("bigint")))
        stops = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(parts, lambda x: x["stop"]))

        def pieces(wide: Column) -> Column:
            between = lambda x: F.decode(F.substring(wide, (4 * x["a"] + 1).cast("int"), (4 * (x["b"] - x["a"])).cast("int")), "UTF-32")
            return F.array_join(F.transform(F.arrays_zip(stops.alias("a"), starts.alias("b")), between), mask)

        return let(F.encode(text, "UTF-32"), pieces)

    return let(merged(spans), keep)


def redacted(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents with secrets masked; a column n_chars, if there is one, follows the text. All rows stay.

    Texts don't travel: only rows of contents with findings need spans, and those are matched by content.
    """
    spans, key = common.free_name(docs, "spans"), common.free_name(docs, "blob")
    ledger = update(docs, None, rules, text_col)
    found = common.written(by_blob(ledger, rules), "blob-findings").select(F.col("blob").alias(key), F.col("spans").alias(spans))
    rows = docs.withColumn(key, blob(F.col(text_col))).join(found, key, "left")
    out = {text_col: F.when(F.col(spans).isNotNull(), masked(F.col(text_col), F.col(spans))).otherwise(F.col(text_col))}
    names = []
    for c in docs.columns:
        if c == text_col:
            names.append(out[text_col].alias(c))
        elif c.lower() == length_col:
            kind = docs.schema[c].dataType
            names.append(F.when(F.col(spans).isNotNull(), F.length(out[text_col]).cast(kind)).otherwise(F.col(c)).alias(c))
        else:
            names.append(F.col(c))
    return rows.select(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' history in two steps over one kept ledger: the paths of the first half of the ids under the base rules, then all
    paths under all rules, which scans unseen contents whole and seen ones for the added rules alone. The ledger is
    new at each call, so that neither result nor cost depends on what ran before."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    path = common.scratch(spark, "blob-ledger")
    middle = docs.agg(((F.min("doc_id") + F.max("doc_id")) / 2).alias("m")).first().m
    if middle is not None:
        extend(docs.filter(F.col("doc_id") <= middle), path, tuple(r for r in RULES if r.kind in BASE))
    found = findings(docs, extend(docs, path), ["doc_id"])

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base = as_text(F.filter("spans", lambda x: x["kind"].isin(*BASE)))
    return found.select("doc_id", *map(count, BASE), F.sha2(base.cast("binary"), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"))


def oracle_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The query in DuckDB's SQL, without ledger: every text is scanned."""
    parts = []
    for no, r in enumerate(rules):
        p = "'" + r.pattern.replace("'", "''") + "'"
        parts.append(
            f"SELECT doc_id, {no} AS no, '{r.kind}' AS kind, {r.least} AS least, regexp_extract_all(t, {p}, 0) AS m,"
            f" regexp_extract_all(t, {p}, {r.group}) AS c, regexp_split_to_array(t, {p}) AS g FROM d"
        )
    found = " UNION ALL ".join(parts)
    base = ", ".join(f"'{k}'" for k in BASE)
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({found}),
i AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM f),
s AS (
  SELECT doc_id, no, kind, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS a, length(m[i]) AS n
  FROM i WHERE length(c[i]) >= least),
l AS (SELECT *, kind || ':' || a::BIGINT || ':' || (a + n)::BIGINT AS span FROM s)
SELECT d.doc_id, {counts}, sha256(coalesce(string_agg(span, ',' ORDER BY a, no) FILTER (kind IN ({base})), '')) AS base_sha256,
  coalesce(string_agg(span, ',' ORDER BY a, no), '') AS spans
FROM d LEFT JOIN l USING (doc_id) GROUP BY d.doc_id
"""
