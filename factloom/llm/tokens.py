"""Byte-level BPE ids by the tokenizers library, with a bounded memory of words.

A space that follows a non-blank character always starts a new match of the vocabulary's split
pattern: no alternative has a blank after a non-blank. So a text may be cut there, and each
word encoded by itself. A blank that stands between blanks (or a blank and the end)
belongs to a longer run; such texts go whole to the library. Words that a worker does not remember are
encoded many at a time, as one text: each then starts at the one token that begins with a space.
"""

from __future__ import annotations

import functools
import os
import re
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: Entries of a memory; a full one becomes the old generation and a new one starts. About 200 MB.
MEMORY = 500_000
#: Longer words are not remembered.
WORD_CHARS = 40
#: Words encoded as one text, and words of letters merged as one.
JOINED, TOGETHER = 1000, 32

#: Characters after a word's letters; none is a letter or a digit.
MARKS = ".,;:!?|%*&$#@()[]\"'-\n"
#: The vocabulary writes bytes as characters: printable ones of Latin-1 as they are, others from 256 on.
BYTES = {b: 256 + i for i, b in enumerate(x for x in range(256) if not (33 <= x <= 126 or 161 <= x <= 172 or x >= 174))}

RUN = re.compile(r"\s (?:\s|$)")
#: For words of these characters, MATCH cuts as public_tokenizers.PATTERN does.
PLAIN = re.compile(r"[ -~\nÀ-ÖØ-öø-ÿ]*")
MATCH = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\sA-Za-zÀ-ÖØ-öø-ÿ0-9]+|\s+(?!\S)|\s+")


class Memory(dict):
    """A dict that forgets what was not asked for since it last was full."""

    def __init__(self, size: int = MEMORY):
        super().__init__()
        self.size, self.old = size, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is not None:
            self[key] = found
        return found

    def lacking(self, keys: set) -> set:
        old = self.old
        return {x for x in keys if x not in self and x not in old}

    def trim(self) -> None:
        if len(self) > self.size:
            self.old = dict(self)
            self.clear()


def words_of(text: str) -> list[str] | None:
    """The text cut at single spaces, each with the space before it; None if a run of blanks forbids that."""
    if "\0" in text or RUN.search(text):
        return None
    return text.replace(" ", "\0 ").split("\0")


class Encoder:
    """encode(texts) -> for each text its ids as little-endian unsigned 32-bit bytes; arrays(texts) -> all of them and their counts."""

    def __init__(self, path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path or public_tokenizers.path("byte_bpe_50k.json"))
        self.library.encode_special_tokens = True
        self.tokenize = self.library.model.tokenize
        self.words = Memory()
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        self.opens[[v for k, v in vocabulary.items() if k[0] == "Ġ"]] = True
        crossing = any("Ġ" in k.lstrip("Ġ") and "Âł" not in k for k in vocabulary)  # Âł: the no-break space, no letter
        self.together = 1 if crossing or getattr(self.library.model, "ignore_merges", False) else TOGETHER

    def plain(self, texts: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def letters(self, words: list[str]) -> list[bytes]:
        """Ids of words of a space and letters, each one match of the split pattern: the library's model is asked directly, for many words at once.
        Merges don't cross into the next word's space where no entry of the vocabulary does (but for blanks)."""
        mapped = ["Ġ" + x[1:] if x.isascii() else x.encode().decode("latin-1").translate(BYTES) for x in words]
        found: list[int] = []
        for at in range(0, len(mapped), self.together):
            found += [x.id for x in self.tokenize("".join(mapped[at : at + self.together]))]
        return self.at_spaces(np.array(found, "<u4"), len(words))

    def at_spaces(self, ids: np.ndarray, n: int) -> list[bytes]:
        """The ids of n words that start with a space each."""
        if not n:
            return []
        raw, starts = ids.tobytes(), (4 * np.flatnonzero(self.opens[ids])).tolist()
        if len(starts) != n:
            raise AssertionError("a word has no token of its own that begins with a space")
        return [raw[a:b] for a, b in zip(starts, [*starts[1:], len(raw)], strict=True)]

    def fresh(self, words: set[str]) -> dict[str, bytes]:
        """Ids of words as words_of() cuts them. Letters and the marks after them are different matches."""
        known, out, cut, rest, whole = self.words, {}, [], [], []
        for word in words:
            head = word.rstrip(MARKS)
            if not head[1:].isalpha() or head[0] != " ":
                rest.append(word)
            elif head == word:
                whole.append(word)
            else:
                cut.append((word, head, word[len(head) :]))
        tails = {x[2] for x in cut}
        rest += [x for x in tails if known[x] is None and x not in words]
        joined = [x for x in rest if len(x) > 1 and x[0] == " " and not x[1].isspace()]
        alone = list(set(rest).difference(joined))
        out.update(zip(alone, self.plain(alone), strict=True))
        for at in range(0, len(joined), JOINED):
            part = joined[at : at + JOINED]
            ids = np.array(self.library.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids, "<u4")
            out.update(zip(part, self.at_spaces(ids, len(part)), strict=True))
        whole += {x[1] for x in cut if x[1] not in words and known[x[1]] is None}
        out.update(zip(whole, self.letters(whole), strict=True))
        for word, head, tail in cut:
            out[word] = (out.get(head) or known[head]) + (out.get(tail) or known[tail])
        return out

    def arrays(self, texts: list[str], end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, end after each, and how many each has. Arrow cuts the texts and finds the kinds of words, so that
        Python's memory is asked once for each kind; the ids of words are gathered by numpy."""
        known = self.words
        known.trim()
        n = len(texts)
        if not n:
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        cut = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        bounds, pieces = cut.offsets.to_numpy(), cut.values.dictionary_encode()
        kind, starts = pieces.indices.to_numpy(), bounds[:-1]
        follows = np.ones(len(kind), bool)
        follows[starts] = False
        first = pieces.dictionary.take(pa.array(kind[starts])).to_numpy(zero_copy_only=False).tolist()
        used = np.zeros(len(pieces.dictionary), bool)
        used[kind[follows]] = True
        after = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), pieces.dictionary.filter(pa.array(used)), pa.scalar(" ", pa.large_string())).to_numpy(zero_copy_only=False).tolist()
        # a blank before, between or after these: the text may have a run of blanks
        blank = np.zeros(len(used), bool)
        blank[np.flatnonzero(used)[[i for i, x in enumerate(after) if len(x) == 1 or x[1].isspace()]]] = True
        doubtful = np.unique(np.searchsorted(bounds, np.flatnonzero(blank[kind] & follows), "right") - 1).tolist()
        whole = [i for i in doubtful if RUN.search(texts[i])]
        fresh = self.fresh(known.lacking({*first, *after}))
        known.update(fresh)
        units = [*map(known.__getitem__, first), *map(known.__getitem__, after), *self.plain([texts[i] for i in whole]), end]
        for x in fresh:
            if len(x) > WORD_CHARS:
                del known[x]
        sizes = np.fromiter(map(len, units), np.int64, len(units)) // 4
        at, store = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(units), "<u4")
        unit = (n - 1 + np.cumsum(used))[kind]
        unit[starts] = np.arange(n)
        owner = np.repeat(np.arange(n), np.diff(bounds))
        if whole:
            instead = np.full(n, -1)
            instead[whole] = n + len(after) + np.arange(len(whole))
            unit[starts] = np.where(instead >= 0, instead, unit[starts])
            kept = ~follows | (instead[owner] < 0)
            unit, owner = unit[kept], owner[kept]
        if end:
            ends = np.searchsorted(owner, np.arange(n), "right")
            unit, owner = np.insert(unit, ends, len(units) - 1), np.insert(owner, ends, np.arange(n))
        size = sizes[unit]
        ids = store[np.repeat(at[unit] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        return ids, np.bincount(owner, size, n).astype(np.int64)

    def encode(self, texts: list[str]) -> list[bytes]:
        ids, sizes = self.arrays(texts)
        raw, ends = ids.tobytes(), (4 * np.cumsum(sizes)).tolist()
        return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


@functools.lru_cache(maxsize=2)
def encoder(path: str | None = None) -> Encoder:
    """One for each worker process and vocabulary file."""
    return Encoder(path)
