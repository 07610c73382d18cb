"""The index of a slot against a loop over all that it holds."""

from __future__ import annotations

import random
import time

import pytest

from factloom import model
from factloom.operators import slots


def plain_match(new, held, single):
    """held: newest first."""
    norm, turn = new["value"].strip().lower(), new["source_turn_id"]
    others = [x for x in held if x["source_turn_id"] != turn and x["value"].strip().lower() != norm]
    if single:
        return others[0] if others else None
    slot = slots.attribute(new["value"])
    if slot and not slots.CLOSED.search(new["value"]):
        for x in others:
            if slots.attribute(x["value"]) == slot and not slots.CLOSED.search(x["value"]):
                return x
    content = set(slots.words(new["value"])) - slots.NOISE
    plain = {x for x in content if x not in slots.QUANTITY and not x.isdigit()}
    best, most = None, 0.0
    for x in others:
        before = set(slots.words(x["value"])) - slots.NOISE
        if not content or not before:
            continue
        if plain and plain == {y for y in before if y not in slots.QUANTITY and not y.isdigit()} and content != before:
            return x
        shared = len(content & before)
        score = shared / len(content | before)
        if shared >= 2 and score >= 0.3 and score > most:
            best, most = x, score
    return best


def plain_fold(rows, single):
    held, out = [], []
    for new in rows:
        old = plain_match(new, held, single)
        if old is not None:
            kind = slots.edge_type(new, old)
            blocked = kind in ("user_correction", "contradicts") and new["source_trust"] + model.TRUST_MARGIN < old["source_trust"]
            out.append({"old_claim_id": old["claim_id"], "new_claim_id": new["claim_id"], "edge_type": "blocked" if blocked else kind, "created_ts": new["created_ts"]})
            if not blocked and kind != "contradicts":
                held.remove(old)
        held.insert(0, new)
    return held[::-1], out


PARTS = ["lives in Oslo", "moved to Rome", "works at Bank", "worked at Bank from 2010 to 2015", "likes", "tea", "green", "long walks", "3", "7", "many", "the", "of", "cats", "small", "dogs", "river", "evening", "", "  "]


def some_claims(seed, n, parts=PARTS):
    rng = random.Random(seed)
    most = rng.choice([1, 2, 4, 6])
    return [
        {"claim_id": f"c{i}", "value": rng.choice([" ", " ", ", "]).join(rng.choices(parts, k=rng.randint(0, most))), "source_turn_id": f"t{i // rng.choice([1, 2, 5])}", "speaker": rng.choice(["user", "assistant", "tool"]), "source_trust": rng.choice([0.35, 0.5, 1.0]), "created_ts": i}
        for i in range(n)
    ]


@pytest.mark.parametrize("seed", range(120))
def test_the_index_gives_what_a_loop_gives(seed):
    rows = some_claims(seed, 90 if seed % 3 else 250)
    for single in (False, True):
        assert slots.fold_slot(rows, single) == plain_fold(rows, single)


def test_a_slot_goes_on_from_what_it_held():
    rows = some_claims(5, 200)
    held, first = slots.fold_slot(rows[:120], False)
    again = slots.Held.of(list(enumerate(held, 7)), False)
    assert first + [x for x in map(again.decide, rows[120:]) if x] == plain_fold(rows, False)[1]


@pytest.mark.parametrize("kind", ["numbers", "common words", "one value", "restated", "different"])
def test_a_hundred_thousand_claims_of_a_slot_take_seconds(kind):
    rng = random.Random(1)
    say = {
        "numbers": lambda i: f"has {rng.randrange(10**6)} small cats", "common words": lambda i: f"enjoys long walks w{rng.randrange(10**6)} near river x{rng.randrange(10**6)}",
        "one value": lambda i: "likes green tea", "restated": lambda i: rng.choice(["likes green tea", "likes black tea", "drinks milk"]), "different": lambda i: f"a{i} b{rng.randrange(5000)} c{rng.randrange(5000)}",
    }[kind]
    rows = [{"claim_id": f"c{i}", "value": say(i), "source_turn_id": f"t{i}", "speaker": rng.choice(["user", "tool"]), "source_trust": rng.choice([0.35, 1.0]), "created_ts": i} for i in range(100_000)]
    began = time.time()
    slots.fold_slot(rows, False)
    assert time.time() - began < 60
    assert slots.fold_slot(rows[:600], False)[1] == plain_fold(rows[:600], False)[1]
