"""The steps by which older stores reach the present schema. Each adds columns and tables; the fourth also gives claims a text of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.sources import store as st

# What each version of the schema added. Columns: table -> name -> (type, value of older rows). Version 2 and the rest of 12 are indexes.
COLUMNS = {
    1: {"metadata": {"importance": ("double", 0.5)}},
    3: {"turns": {"source_type": ("string", "conversation"), "source_metadata": ("string", None), "extraction_status": ("string", "pending")}},
    5: {"metadata": {"access_count": ("long", 0), "last_accessed_ts": ("long", None)}},
    6: {"metadata": {"demoted": ("boolean", False)}},
    7: {"metadata": {"consolidated": ("boolean", False), "consolidated_sources": ("string", None)}},
    8: {"digests": {"source_claim_ids": ("string", None)}},
    9: {"metadata": {"source_trust": ("double", 0.5)}},
    10: {"turns": {"namespace": ("string", "default")}},
}
TABLES = {
    3: {"turn_vectors": "turn_id string, embedding binary, model_version string, embedded_at long"},
    11: {"principals": "token_hash string, principal string, namespace string, can_write boolean, created_ts long"},
    12: {
        "tools": "id string, name string, description string, parameters_json string, returns_json string, server string, server_url string, domain_tags string, source string, dataset string, source_tool_id string, metadata_json string, created_at long, updated_at long",
        "tool_vectors": "tool_id string, model_version string, embedding binary, embedded_text string, created_at long",
    },
    13: {"serve_log": "event_id string, session_id string, claim_id string, query string, served_ts long"},
}
LATEST = 13


def with_text(claims: DataFrame) -> DataFrame:
    """Version 4: facts may be text alone; older claims, which all have a triple, get theirs from it."""
    if "text" in claims.columns:
        return claims
    return claims.withColumn("text", F.concat_ws(" ", "subject", "predicate", "value"))


def step(version: int):
    def run(store: st.Store, before: st.Manifest) -> dict[str, st.Change]:
        out: dict[str, DataFrame] = {}
        for name, columns in COLUMNS.get(version, {}).items():
            if name in before.tables:
                rows = store.read_at(before, name)
                fresh = {c: F.lit(value).cast(kind) for c, (kind, value) in columns.items() if c not in rows.columns}
                if fresh:
                    out[name] = rows.withColumns(fresh)
        if version == 4 and "claims" in before.tables and "text" not in store.read_at(before, "claims").columns:
            out["claims"] = with_text(store.read_at(before, "claims"))
        for name, schema in TABLES.get(version, {}).items():
            if name not in before.tables:
                out[name] = store.spark.createDataFrame([], schema)
        return {k: st.overwrite(v) for k, v in out.items()}

    return run


STEPS = [(n, step(n)) for n in range(1, LATEST + 1)]


def upgrade(store: st.Store) -> list[int]:
    """Takes a store to the present schema; the versions that it went through. One that is there already is left alone."""
    return store.migrate(STEPS)
