"""What a slot holds while its claims are taken in order, indexed so that a claim is not compared with all that is held.

Three rules find the claim that a new one answers: the newest open claim of its attribute; the newest that differs from it in numbers only;
the one that shares most words with it. Claims of the same value or turn are never answered.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict

from factloom import model
from factloom.functions import text as tx

NOISE, QUANTITY = frozenset(tx.NOISE), frozenset(tx.QUANTITIES)
CLOSED = re.compile(tx.CLOSED_WINDOW.removeprefix("(?is)"), re.I | re.S)
#: Least share of common words, and least number of them.
LEAST_SHARE, LEAST_SHARED = 0.3, 2


def words(value: str) -> list[str]:
    return re.findall("[a-z0-9]+", value.lower())


def attribute(value: str) -> str | None:
    padded = f" {' '.join(words(value))} "
    return next((k for k, triggers in tx.ATTRIBUTES.items() if any(f" {x} " in padded for x in triggers)), None)


def edge_type(new: dict, old: dict) -> str:
    fresh, before = ({x for x in re.split(r"[\s,;/]+", r["value"].strip().lower()) if x} for r in (new, old))
    if fresh and fresh < before:
        return "refines"
    if new["speaker"] == "assistant":
        return "assistant_confirm"
    return "user_correction" if old["speaker"] == "user" else "contradicts"


class Newest:
    """Numbered claims in groups; the newest of another group and turn is found without a look at the rest."""

    def __init__(self):
        self.groups: dict = {}  # group: claims by number, oldest first
        self.heap: list = []  # (-newest number, tie, group); entries that are no longer true are dropped when met

    def __bool__(self) -> bool:
        return bool(self.groups)

    def add(self, group, number: int, turn: str) -> None:
        self.groups.setdefault(group, {})[number] = turn
        heapq.heappush(self.heap, (-number, id(group), group))

    def remove(self, group, number: int) -> None:
        own = self.groups[group]
        last = next(reversed(own))
        del own[number]
        if not own:
            del self.groups[group]
        elif last == number:
            heapq.heappush(self.heap, (-next(reversed(own)), id(group), group))

    def other(self, group, turn: str) -> int | None:
        """The number of the newest claim of another group and another turn."""
        best, looked = None, []
        while self.heap and (best is None or -self.heap[0][0] > best):
            entry = heapq.heappop(self.heap)
            own = self.groups.get(entry[2])
            if own is None or next(reversed(own)) != -entry[0]:
                continue
            looked.append(entry)
            if entry[2] != group:
                found = next((n for n in reversed(own) if own[n] != turn), None)
                if found is not None and (best is None or found > best):
                    best = found
        for entry in dict.fromkeys(looked):
            heapq.heappush(self.heap, entry)
        return best


class Held:
    """The claims that a slot holds. single: it has one value at a time, so that the newest other claim is answered, whatever it says."""

    def __init__(self, single: bool):
        self.single, self.count = single, 0
        self.retired: int | None = None  # number of the claim that the last one took the place of
        self.claims: dict[int, dict] = {}
        self.all = Newest()  # by value
        self.open: dict[str, Newest] = defaultdict(Newest)  # by attribute, then value
        self.plain: dict[frozenset, Newest] = defaultdict(Newest)  # by words that are no numbers, then all words
        self.texts: dict[frozenset, Newest] = {}  # by all words, then value
        self.postings: dict[str, dict[int, dict[frozenset, int]]] = defaultdict(lambda: defaultdict(dict))  # word: number of words: texts by the number of their last claim

    @classmethod
    def of(cls, claims: list[tuple[int, dict]], single: bool) -> Held:
        """Claims with their numbers, in order; numbers go on after the last."""
        held = cls(single)
        for held.count, x in claims:
            held.add(x)
        return held

    def listed(self) -> list[dict]:
        """The claims as they were added, oldest first."""
        return [{k: v for k, v in x.items() if k != "index"} for x in self.claims.values()]

    def described(self, claim: dict) -> tuple:
        """Value, attribute (of an open claim), all words and those that are no numbers."""
        value = claim["value"]
        norm = value.strip().lower()
        if self.single:
            return norm, None, frozenset(), frozenset()
        slot = attribute(value)
        content = frozenset(words(value)) - NOISE
        return norm, slot if slot and not CLOSED.search(value) else None, content, frozenset(x for x in content if x not in QUANTITY and not x.isdigit())

    def add(self, claim: dict) -> None:
        number, turn = self.count, claim["source_turn_id"]
        norm, slot, content, plain = found = claim.get("index") or self.described(claim)
        self.count += 1
        self.claims[number] = claim | {"index": found}
        if self.single:
            self.all.add(norm, number, turn)
            return
        if slot:
            self.open[slot].add(norm, number, turn)
        if plain:
            self.plain[plain].add(content, number, turn)
        if content:
            self.texts.setdefault(content, Newest()).add(norm, number, turn)
            for w in content:
                own = self.postings[w][len(content)]
                own.pop(content, None)
                own[content] = number

    def remove(self, number: int) -> None:
        norm, slot, content, plain = self.claims.pop(number)["index"]
        if self.single:
            self.all.remove(norm, number)
            return
        if slot:
            self.open[slot].remove(norm, number)
        if plain:
            self.plain[plain].remove(content, number)
            if not self.plain[plain]:
                del self.plain[plain]
        if content:
            self.texts[content].remove(norm, number)
            if not self.texts[content]:
                del self.texts[content]
                for w in content:
                    del self.postings[w][len(content)][content]

    def match(self, new: dict) -> int | None:
        """The number of the claim that a new one answers."""
        turn = new["source_turn_id"]
        norm, slot, content, plain = new["index"]
        if self.single:
            return self.all.other(norm, turn)
        if slot and slot in self.open and (found := self.open[slot].other(norm, turn)) is not None:
            return found
        if plain and plain in self.plain and (found := self.plain[plain].other(content, turn)) is not None:
            return found
        return self.closest(norm, content, turn) if len(content) >= LEAST_SHARED else None

    def closest(self, norm: str, content: frozenset, turn: str) -> int | None:
        """The claim of the greatest share of common words; of equal ones the newest. Rare words are looked up first; a text met at a later word shares no more than the words left."""
        size, best, most = len(content), None, 0.0
        rare_first = sorted(content, key=lambda w: (sum(map(len, self.postings[w].values())) if w in self.postings else 0, w))
        seen: set[frozenset] = set()
        for k, w in enumerate(rare_first):
            left = size - k
            if left < LEAST_SHARED or left / size < max(most, LEAST_SHARE):
                break
            for length, texts in self.postings[w].items() if w in self.postings else ():
                shared = min(left, length)
                bound = shared / (size + length - shared)
                if shared < LEAST_SHARED or bound < max(most, LEAST_SHARE):
                    continue
                for text in reversed(texts):
                    if most >= bound and best is not None and (most > bound or texts[text] <= best):
                        break  # what follows is older, and shares no more
                    if text in seen:
                        continue
                    seen.add(text)
                    common = len(text & content)
                    score = common / len(text | content)
                    if common < LEAST_SHARED or score < LEAST_SHARE or score < most:
                        continue
                    found = self.texts[text].other(norm, turn)
                    if found is not None and (score > most or found > best):
                        best, most = found, score
        return best

    def decide(self, new: dict) -> dict | None:
        """Takes the slot's next claim and gives the decision on it."""
        new = new | {"index": self.described(new)}
        number, out, self.retired = self.match(new), None, None
        if number is not None:
            old = self.claims[number]
            kind = edge_type(new, old)
            blocked = kind in ("user_correction", "contradicts") and new["source_trust"] + model.TRUST_MARGIN < old["source_trust"]
            out = {"old_claim_id": old["claim_id"], "new_claim_id": new["claim_id"], "edge_type": "blocked" if blocked else kind, "created_ts": new["created_ts"]}
            if not blocked and kind != "contradicts":
                self.remove(number)
                self.retired = number
        self.add(new)
        return out


def fold_slot(rows: list[dict], single: bool) -> tuple[list[dict], list[dict]]:
    """What a slot holds after its claims in order, and a decision for each claim that answers an earlier one."""
    held = Held(single)
    out = [x for x in map(held.decide, rows) if x]
    return held.listed(), out
