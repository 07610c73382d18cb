"""The data model: schemas, status sets and fixed values.

A store is a set of tables: turns, claims, edges, metadata, entities and tables derived from them. All times
are nanoseconds since the epoch, as longs; a missing triple is null.
"""

from __future__ import annotations

SERVABLE = ("active", "confirmed", "audited")
REPLACEABLE = ("active", "confirmed")
SPEAKERS = ("user", "assistant", "system")
SOURCES = ("conversation", "tool_call", "browser")

TURNS = "turn_id string, session_id string, speaker string, text string, ts long, source_type string, namespace string"
CLAIMS = (
    "claim_id string, session_id string, text string, subject string, predicate string, value string, confidence double,"
    " source_turn_id string, status string, created_ts long, valid_from_ts long, valid_until_ts long, event_ts long"
)
EDGES = "edge_id string, old_claim_id string, new_claim_id string, edge_type string, identity_score double, created_ts long"
METADATA = "claim_id string, entity_key string, predicate_family string, temporal_bin string, importance double, access_count long, last_accessed_ts long, demoted boolean, source_trust double"
DECISIONS = "session_id string, kind string, target_id string, detail string, ts long"

DAY_NS = 86_400 * 1_000_000_000

#: Trust by origin: user, tool, assistant, web page, anything else. Fixed values.
TRUST_USER, TRUST_TOOL, TRUST_ASSISTANT, TRUST_WEB, TRUST_OTHER = 1.0, 0.7, 0.5, 0.35, 0.5
QUARANTINE = 0.4
TRUST_MARGIN = 0.2

#: Rank fusion. Fixed values.
RRF_K = 60
WEIGHTS = {
    "semantic": 0.5, "entity": 0.2, "temporal": 0.1, "bm25": 0.2, "scope": 0.3, "predicate": 0.2,
    "confidence": 0.1, "frequency": 0.1, "importance": 0.15, "usage": 0.1, "trust": 0.12,
}


def weights_from(text: str | None) -> dict[str, float]:
    """Weights of a setting such as "0.5,0.2,0.1,0.2": for semantic, entity, temporal and the further ones in their order; fewer than three numbers, or none, leave all as they are."""
    try:
        given = [float(x) for x in (text or "").split(",")]
    except ValueError:
        return dict(WEIGHTS)
    return {k: given[i] if i < len(given) else w for i, (k, w) in enumerate(WEIGHTS.items())} if len(given) >= 3 else dict(WEIGHTS)


EPISODE_WEIGHTS = {"semantic": 0.5, "bm25": 0.25, "entity": 0.15, "recency": 0.1}
FACT_WEIGHT, EPISODE_WEIGHT = 1.0, 0.9
BM25_K1, BM25_B = 1.2, 0.75
TOP_K, PER_SESSION_K, MOST_ACROSS = 20, 3, 300

#: Predicate vocabularies. Fixed values.
PACKS = {
    "general": {
        "families": ("user_fact", "user_preference", "user_event", "user_relationship", "user_goal", "user_constraint", "context", "action", "observation", "metadata", "assistant_recommendation", "assistant_action"),
        "single_valued": (),
    },
    "events": {"families": (), "single_valued": ()},
}
