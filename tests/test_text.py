from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from factloom.functions import text as tx
from factloom.operators import context, slots


def one(spark, expr, *values):
    cols = [f"c{i}" for i in range(len(values))]
    df = spark.createDataFrame([values], ", ".join(f"{c} string" for c in cols))
    return df.select(expr(*[F.col(c) for c in cols]).alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "reason"),
    [("I prefer dark mode for my editor", "admitted"), ("", "empty"), ("  \n", "empty"), ("uh um ok yeah", "only_0_content_words"), ("[silence]", "silence_marker"), (" [Noise] ", "silence_marker"),
     ("ok yeah", "only_0_content_words"), ("I live in Toronto", "admitted"), ("123 456", "no_word_tokens")],
)
def test_admission(spark, text, reason):
    assert one(spark, tx.admission, text) == reason


@pytest.mark.parametrize(("text", "kind"), [("Always run tests", "instruction"), ("I like tea", "preference"), ("the sky", "ephemeral"), ("my favourite", "preference")])
def test_durability(spark, text, kind):
    assert one(spark, tx.durability, text) == kind


@pytest.mark.parametrize(("value", "slot"), [("lives in Toronto", "residence"), ("olives in oil", None), ("frameworks at work", None), ("works at Acme", "employer")])
def test_attribute(value, slot):
    assert slots.attribute(value) == slot


def test_closed_window():
    assert slots.CLOSED.search("lived in NYC from 2010 to 2015") and not slots.CLOSED.search("lives in Boston")


def test_entities_first_type_holds(spark):
    found = one(spark, tx.entities, "Alice went to Berlin with Acme Corp in Paris. The end")
    assert [(x.entity, x.kind) for x in found] == [("Acme Corp", "organization"), ("Berlin", "location"), ("Paris", "location"), ("Alice", "proper_noun")]


def test_extraction(spark):
    found = one(spark, tx.extracted, "I live in Toronto.")
    assert [(x.subject, x.predicate, x.value) for x in found] == [("user", "user_fact", "Toronto")]
    found = one(spark, tx.extracted, "The weather is nice today in downtown")
    assert [(x.subject, x.predicate) for x in found] == [("the", "observation")]


@pytest.mark.parametrize(("q", "past"), [("what did I use to like", True), ("before the move", True), ("current address", False), ("previously", True)])
def test_history(spark, q, past):
    assert one(spark, tx.history_intent, q) is past


def test_routing(spark):
    assert one(spark, tx.query_depth, "How many cats") == 50 and one(spark, tx.query_depth, "latest news") == 30 and one(spark, tx.query_depth, "cats") == 15
    assert one(spark, tx.query_type, "when did my plan change") == "fact_recall"
    assert one(spark, tx.query_predicates, "I want what you said") == ["assistant_action", "assistant_recommendation", "user_preference"]


def test_subject_span_and_event(spark):
    assert one(spark, tx.normalise_subject, "\t My  Dog ") == "my_dog"
    assert tuple(one(spark, tx.char_span, "Hello World", "world")) == (6, 11)
    assert one(spark, tx.char_span, "Hello", "x").char_start is None
    assert one(spark, tx.event_type, "bought a camera at checkout") == "purchase_redemption" and one(spark, tx.event_type, "nothing") is None


def test_an_organisation_is_one_entity(spark):
    text = "I met Acme Widgets Inc in Paris, not The University; Åke saw Bern and éAn"
    got = [tuple(x) for x in spark.createDataFrame([(text,)], "t string").select(tx.entities(F.col("t")).alias("e")).first().e]
    assert got == [("Acme Widgets Inc", "organization"), ("The University", "organization"), ("Paris", "location"), ("Bern", "proper_noun")]


def test_replies_in_any_wrapper(spark):
    one = '{"subject": "u", "predicate": "p", "value": "v", "confidence": 0.5}'
    good = [f"[{one}]", f'{{"claims": [{one}]}}', f'{{"data": [{one}]}}', f'{{"anything": [{one}]}}', one, f'{{"claims": [{one}], "entities": []}}']
    bad = ["{}", "[]", "nonsense", '{"claims": 3}', f'{{"x": [{one}], "y": 1}}', '[{"subject": " ", "predicate": "p", "value": "v"}]', "3", None]
    df = spark.createDataFrame([(x,) for x in good + bad], "raw string")
    got = [len(r.c) for r in df.select(context.parsed_claims(F.col("raw")).alias("c")).collect()]
    assert got == [1] * len(good) + [0] * len(bad)
