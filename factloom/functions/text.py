"""Text rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom import model as m

# Word lists and patterns of the rules.
FILLERS = ("uh", "um", "er", "hmm", "mhm", "mm", "ah", "ok", "okay", "yeah", "yes", "no", "right", "well", "so", "like")
SILENCE = r"(?i)^\s*\[(silence|noise|pause|inaudible|music)\]\s*$"
LEAST_CONTENT_WORDS = 3
INSTRUCTION = r"(?i)\b(always|never|must|should|don'?t|do not|make sure|be sure|remember to|from now on|going forward|every time|whenever|before you|after you)\b"
PREFERENCE = r"(?i)\b(prefer(s|red)?|favou?rite|i like|i love|i hate|i enjoy|i usually|i tend to)\b"
NOISE = (
    "the", "a", "an", "is", "was", "to", "for", "and", "or", "of", "in", "on", "at", "it", "my", "i", "me", "we", "up", "so", "no", "not",
    "but", "with", "has", "had", "be", "do", "did", "will", "been", "just", "very", "really", "also", "about", "some", "from", "that",
    "this", "more", "than", "each", "during",
)
QUANTITIES = (
    "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "couple", "few",
    "several", "many", "single", "both", "dozen", "hundred", "thousand",
)
ATTRIBUTES = {
    "residence": ("lives in", "live in", "living in", "moved to", "relocated to", "relocating to", "resides in", "reside in"),
    "employer": ("works at", "work at", "working at", "employed at", "employed by"),
}
CLOSED_WINDOW = r"(?is)\bfrom\b.+?\bto\b|\bbetween\b.+?\band\b|\b(until|till|up to)\b|\b(19|20)\d\d\b.*?\b(19|20)\d\d\b"
ORGANISATION = r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\s+(?:Inc|Corp|LLC|Ltd|Co|Foundation|University|Institute|Hospital|Group)\b"
LOCATION = r"(?:in|at|to|from|near|around)\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\b"
PROPER_NOUN = r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\b"
ENTITY_STOPS = (
    "I", "The", "This", "That", "These", "Those", "My", "Your", "His", "Her", "Its", "Our", "Their", "We", "He", "She", "It", "Not",
    "But", "And", "Or", "So", "If", "When", "Then", "Just", "Also", "Actually", "Really", "Very", "Well", "Yes", "No", "Ok", "Okay",
    "Sure", "Thanks", "Thank",
)
EXTRACTORS = (
    (r"(?:I|i) (?:prefer|like|love|enjoy|favor)\b(.+)", "user_preference"),
    (r"(?:I|i) (?:hate|dislike|avoid|don't like|can't stand)\b(.+)", "user_preference"),
    (r"(?:I|i) (?:am|'m)\b(.+)", "user_fact"),
    (r"(?:I|i) (?:have|'ve)\b(.+)", "user_fact"),
    (r"(?:I|i) (?:work|worked) (?:at|for)\b(.+)", "user_fact"),
    (r"(?:I|i) (?:live|lived) (?:in|at)\b(.+)", "user_fact"),
    (r"(?:I|i) (?:use|used|using)\b(.+)", "user_preference"),
    (r"(?:my|My) (?:name is|name's)\b(.+)", "user_fact"),
)
EVENT_SIGNALS = {
    "purchase_redemption": ("bought", "purchased", "redeemed", "coupon", "paid", "price", "$", "checkout", "receipt", "sale"),
    "travel_commute": ("commute", "drive", "drove", "flew", "traveled", "trip", "flight", "commuting", "transit"),
    "education_milestone": ("degree", "graduated", "enrolled", "studied", "university", "college", "school", "diploma", "major"),
    "named_artifact": ("playlist", "recipe", "book", "movie", "song", "show", "app", "podcast", "album"),
    "appointment": ("appointment", "meeting", "scheduled", "booked", "reservation", "visit", "check-up"),
    "location_linked_action": ("went to", "visited", "shopping at", "stopped by", "picked up from", "dropped off at"),
}
AGGREGATION_WORDS = ("how many", "list all", "all the", "every", "count", "summarize", "overview", "history", "timeline", "throughout", "across all")
TEMPORAL_WORDS = ("when", "last time", "first time", "how long ago", "most recent", "latest", "earliest")
QUERY_FAMILIES = (
    (("recommend", "suggest", "advise", "told me to", "assistant said", "assistant told", "you said", "you told", "you recommend", "did you", "remind me of", "remind me what"), ("assistant_recommendation", "assistant_action"), "assistant_recall"),
    (("prefer", "like", "want", "favorite", "enjoy", "hobby", "interest"), ("user_preference",), "preference"),
    (("when", "timeline", "order", "sequence", "date", "how long"), ("user_event",), "temporal"),
    (("changed", "updated", "used to", "switched", "current", "latest"), ("user_fact", "user_preference"), "knowledge_update"),
    (("goal", "plan", "trying to", "working on", "aim"), ("user_goal",), "fact_recall"),
)
HISTORY = r"\b(before|previously|used to|use to|formerly|former|earlier|prior|originally|in the past|history of|no longer)\b"


def words_in(values) -> Column:
    return F.array(*[F.lit(x) for x in values])


def contains_any(text: Column, needles) -> Column:
    found = F.lit(False)
    for x in needles:
        found = found | text.contains(x)
    return found


def tokens(text: Column) -> Column:
    """ASCII words of the lower-cased text, in order, repeats included."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def content_words(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z']+"), F.lit(0))
    return F.filter(words, lambda x: ~x.isin(*FILLERS))


def admission(text: Column) -> Column:
    """Why a turn is admitted or not."""
    n = F.size(content_words(text))
    return (
        F.when(F.coalesce(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit("")) == "", "empty")
        .when(text.rlike(SILENCE), "silence_marker")
        .when(~text.rlike("[A-Za-z']"), "no_word_tokens")
        .when(n < LEAST_CONTENT_WORDS, F.concat(F.lit("only_"), n.cast("string"), F.lit("_content_words")))
        .otherwise("admitted")
    )


def durability(text: Column) -> Column:
    return F.when(text.rlike(INSTRUCTION), "instruction").when(text.rlike(PREFERENCE), "preference").otherwise("ephemeral")


def normalise_subject(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"^\s+|\s+$", ""), r"\s+", "_")


def temporal_bin(ns: Column) -> Column:
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ns / (86_400 * 1_000_000_000)).cast("int"))
    return F.concat(F.year(day), F.lit("-Q"), F.quarter(day))


def char_span(text: Column, value: Column) -> Column:
    """Start and end of the value in the text, exactly or else in any case; nulls if absent."""
    exact = F.instr(text, value)
    start = F.when(value == "", F.lit(None)).when(exact > 0, exact - 1).when(F.instr(F.lower(text), F.lower(value)) > 0, F.instr(F.lower(text), F.lower(value)) - 1)
    return F.struct(start.alias("char_start"), (start + F.length(value)).alias("char_end"))


def entities(text: Column) -> Column:
    """Entities with types: organisations, then places, then other proper nouns; the first type of a name holds."""

    def typed(pattern: str, kind: str) -> Column:
        whole = kind == "organization"  # an organisation's name has its suffix
        names = F.array_distinct(F.regexp_extract_all(text, F.lit("(?U)" + pattern), F.lit(0 if whole else 1)))  # words of any script end words
        kept = names if whole else F.filter(names, lambda x: ~x.isin(*ENTITY_STOPS))
        return F.transform(kept, lambda x: F.struct(x.alias("entity"), F.lit(kind).alias("kind")))

    found = typed(ORGANISATION, "organization")
    for pattern, kind in ((LOCATION, "location"), (PROPER_NOUN, "proper_noun")):
        found = _added(found, typed(pattern, kind))
    return found


def _added(found: Column, fresh: Column) -> Column:
    return F.concat(found, F.filter(fresh, lambda x: ~F.exists(found, lambda y: y["entity"] == x["entity"])))


def extracted(text: Column) -> Column:
    """Facts that the patterns find; else one observation of the first sentence under the first capitalised name."""
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    found = []
    for pattern, predicate in EXTRACTORS:
        value = F.regexp_replace(F.regexp_replace(F.regexp_extract(trimmed, pattern, 1), r"^\s+|\s+$", ""), r"[.,;!?]+$", "")
        found.append(F.struct(F.lit("user").alias("subject"), F.lit(predicate).alias("predicate"), value.alias("value"), F.lit(0.5).alias("confidence")))
    facts = F.filter(F.array(*found), lambda x: x["value"] != "")
    name = F.regexp_extract(trimmed, r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*|[A-Z]{2,}", 0)
    topic = F.when(name == "", "general").otherwise(F.translate(F.lower(name), " ", "_"))
    first = F.regexp_replace(F.regexp_extract(trimmed, r"^[^.!?\n]*", 0), r"^\s+|\s+$", "")
    value = F.substring(F.when(first != "", first).otherwise(trimmed), 1, 200)
    rest = F.array(F.struct(topic.alias("subject"), F.lit("observation").alias("predicate"), value.alias("value"), F.lit(0.4).alias("confidence")))
    return F.when(trimmed == "", F.slice(facts, 1, 0)).when(F.size(facts) > 0, facts).otherwise(rest)


def event_type(text: Column) -> Column:
    """The type with most signals, the first of equals; null without any."""
    lower = F.lower(text)
    counts = {k: sum((lower.contains(s).cast("int") for s in v), F.lit(0)) for k, v in EVENT_SIGNALS.items()}
    most = F.greatest(*counts.values())
    found = F.lit(None).cast("string")
    for k in reversed(counts):
        found = F.when(counts[k] == most, k).otherwise(found)
    return F.when(most > 0, found)


def query_depth(query: Column) -> Column:
    lower = F.lower(query)
    return F.when(contains_any(lower, AGGREGATION_WORDS), 50).when(contains_any(lower, TEMPORAL_WORDS), 30).otherwise(15)


def query_type(query: Column) -> Column:
    """The last type whose words occur."""
    lower, found = F.lower(query), F.lit("fact_recall")
    for words, _, kind in QUERY_FAMILIES:
        found = F.when(contains_any(lower, words), kind).otherwise(found)
    return found


def query_predicates(query: Column) -> Column:
    lower, found = F.lower(query), F.array().cast("array<string>")
    for words, families, _ in QUERY_FAMILIES:
        found = F.when(contains_any(lower, words), F.array_union(found, words_in(families))).otherwise(found)
    return F.array_sort(found)


def history_intent(query: Column) -> Column:
    return F.lower(query).rlike(HISTORY)


def source_trust(source_type: Column, speaker: Column) -> Column:
    return (
        F.when(source_type == "browser", m.TRUST_WEB).when(source_type == "tool_call", m.TRUST_TOOL)
        .when(speaker == "assistant", m.TRUST_ASSISTANT).when(speaker == "user", m.TRUST_USER).otherwise(m.TRUST_OTHER)
    )


def cosine(a: Column, b: Column) -> Column:
    """0 for different lengths or a zero vector."""
    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(0.0)
