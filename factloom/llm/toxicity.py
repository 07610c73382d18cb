"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A text's lower-cased words are cut into overlapping windows of WINDOW words, STRIDE apart. A
word enters as the embedding of its hash beside the mean embedding of the hashes of its character trigrams; a
gated recurrent unit reads the window each way, attention pools its states, and a logistic unit scores the
window. A document's score is that of its highest window, calibrated on the training documents.

Training: at most about SAMPLE_POSITIVE and SAMPLE_NEGATIVE labelled documents of SAMPLE_BYTES in all (by a hash of the id;
parameters, the only bounds), never from the held-out fold; of texts with one id, the least. Labels belong to documents, so windows
are chosen in rounds: of a toxic document the one the network takes to be most toxic, of others the most toxic and some more. The
first choice is by the words' log-odds, which also start one dimension of the embeddings. Against learning documents by heart, each
document is left out of its words' counts, embeddings move by how many documents have them, and some words of a
window are dropped. Weights bring the sample back to the share of toxic documents among the labelled ones.

Scoring goes over all windows of whole texts, in one narrow stage; the broadcast model has a fixed size. A text
without words, null ones too, has the score of the lowest logit; of windows with equal logits either is the highest, and of words
equally toxic the first window is learned from. Rows labelled twice count as toxic if any label says so; null labels are left out. Without labels of both kinds every score is the share of toxic ones (0 if
none). Repeated rows get equal scores, empty tables an empty result. Other columns aren't read.
"""

from __future__ import annotations

import re
import zlib
from array import array
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SAMPLE_POSITIVE, SAMPLE_NEGATIVE = 1200, 2400
#: Bytes of text that the sample may have; documents beyond it, in the order of the ids' hashes, are left out.
SAMPLE_BYTES = 32 << 20
WINDOW, STRIDE = 24, 16
WORD_BUCKETS = GRAM_BUCKETS = 1 << 14
WORD_SIZE = GRAM_SIZE = 8
HIDDEN, ATTENTION = 8, 8
EPOCHS, BATCH, RATE = 8, 256, 0.01
#: A small sample is gone over more often, for so many batches in all.
LEAST_BATCHES = 300
#: Documents, besides its own, that a word's or trigram's embedding needs to move at half the rate: those of fewer tell documents apart, not labels.
SHRINK = 50_000.0
#: Spread of the embeddings at the start, and share of a window's words left out while learning.
SPREAD, DROPPED = 0.1, 0.1
#: Windows of a document without toxic label that an epoch learns from: the most toxic ones and others.
HARD, RANDOM = 3, 2
LOWEST = -12.0
SEED = 11
#: Words a worker remembers, and windows scored at once.
MEMORY, BLOCK = 150_000, 1024

WORD = re.compile(r"\w+")


class Words(NamedTuple):
    """Hashes of distinct words: a word bucket each, and the buckets of their character trigrams one after another."""

    bucket: np.ndarray
    grams: np.ndarray
    firsts: np.ndarray


def hashed(words: list[str]) -> Words:
    bucket, grams, sizes = array("i"), array("i"), array("i")
    crc = zlib.crc32
    for w in words:
        raw = w.encode()
        bucket.append(crc(raw) % WORD_BUCKETS)
        w = f"<{w}>"
        own = [crc(w[i : i + 3].encode()) % GRAM_BUCKETS for i in range(len(w) - 2)]
        grams.extend(own)
        sizes.append(len(own))
    return Words(np.array(bucket, np.int32), np.array(grams, np.int32), np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))))


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, first word (in the documents' joint list) and number of words of each window; documents without words have none."""
    count = np.where(lengths > 0, 1 + np.maximum(0, -(-(lengths - WINDOW) // STRIDE)), 0)
    doc = np.repeat(np.arange(len(lengths)), count)
    turn = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    base = np.cumsum(lengths) - lengths
    return doc, base[doc] + turn * STRIDE, np.minimum(WINDOW, lengths[doc] - turn * STRIDE)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def fresh_parameters(seed: int = SEED) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    size = WORD_SIZE + GRAM_SIZE

    def normal(*shape, scale):
        return rng.normal(0, scale, shape).astype(np.float32)

    p = {"words": normal(WORD_BUCKETS, WORD_SIZE, scale=SPREAD), "grams": normal(GRAM_BUCKETS, GRAM_SIZE, scale=SPREAD)}
    for way in "fb":
        p["x" + way] = normal(size, 3 * HIDDEN, scale=size**-0.5)
        p["c" + way] = np.zeros(3 * HIDDEN, np.float32)
        p["u" + way] = normal(HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5)
    p["a"], p["d"], p["v"] = normal(2 * HIDDEN, ATTENTION, scale=(2 * HIDDEN) ** -0.5), np.zeros(ATTENTION, np.float32), normal(ATTENTION, scale=1.0)
    p["w"], p["o"] = normal(2 * HIDDEN, scale=(2 * HIDDEN) ** -0.5), np.zeros(1, np.float32)
    return p


def inputs(p: dict[str, np.ndarray], words: Words) -> np.ndarray:
    sizes = np.diff(words.firsts)
    mean = np.add.reduceat(p["grams"][words.grams], words.firsts[:-1]) / sizes[:, None] if len(sizes) else np.zeros((0, GRAM_SIZE))
    return np.concatenate((p["words"][words.bucket], mean), axis=1).astype(np.float32)


def recur(projected: np.ndarray, u: np.ndarray, mask: np.ndarray, backward: bool, keep: list | None = None) -> np.ndarray:
    """States of a gated recurrent unit. projected: time x windows x 3 HIDDEN (update, reset, candidate); mask: time x windows x 1, None for no gaps."""
    steps, n, _ = projected.shape
    h = np.zeros((n, HIDDEN), np.float32)
    out = np.empty((steps, n, HIDDEN), np.float32)
    for t in range(steps - 1, -1, -1) if backward else range(steps):
        x, g = projected[t], h @ u
        zr = sigmoid(x[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
        z, r, own = zr[:, :HIDDEN], zr[:, HIDDEN:], g[:, 2 * HIDDEN :]
        c = np.tanh(x[:, 2 * HIDDEN :] + r * own)
        new = c + z * (h - c)
        if keep is not None:
            keep.append((t, h, z, r, c, own))
        h = new if mask is None else h + mask[t] * (new - h)
        out[t] = h
    return out


def recur_back(d_out: np.ndarray, u: np.ndarray, mask: np.ndarray, kept: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the projected inputs and of u."""
    steps, n, _ = d_out.shape
    dx, du, dh = np.zeros((steps, n, 3 * HIDDEN), np.float32), np.zeros_like(u), np.zeros((n, HIDDEN), np.float32)
    for t, h, z, r, c, own in reversed(kept):
        dh = dh + d_out[t]
        new = mask[t] * dh
        before = dh - new + new * z
        dc = new * (1 - z) * (1 - c * c)
        dz = new * (h - c) * z * (1 - z)
        dr = dc * own * r * (1 - r)
        dg = np.concatenate((dz, dr, dc * r), axis=1)
        dx[t] = np.concatenate((dz, dr, dc), axis=1)
        du += h.T @ dg
        dh = before + dg @ u.T
    return dx, du


def attend(p: dict[str, np.ndarray], states: np.ndarray, mask: np.ndarray | None):
    """Logits of windows from states, time x windows x 2 HIDDEN; and what the gradient needs."""
    mixed = np.tanh(states @ p["a"] + p["d"])
    score = mixed @ p["v"]
    if mask is not None:
        score = np.where(mask[:, :, 0] > 0, score, -1e9)
    weight = np.exp(score - score.max(axis=0))
    weight /= weight.sum(axis=0)
    pooled = (weight[:, :, None] * states).sum(axis=0)
    return pooled @ p["w"] + p["o"][0], (mixed, weight, pooled)


def gradients(p: dict[str, np.ndarray], words: Words, at: np.ndarray, mask: np.ndarray, label: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Of the weighted log loss. at: time x windows, numbers of words."""
    used, place = np.unique(at, return_inverse=True)
    place = place.reshape(at.shape)
    own = subset(words, used)
    table = inputs(p, own)
    x = table[place]
    kept: dict[str, list] = {"f": [], "b": []}
    states = np.concatenate([recur(x @ p["x" + k] + p["c" + k], p["u" + k], mask, k == "b", kept[k]) for k in "fb"], axis=2)
    logit, (mixed, share, pooled) = attend(p, states, mask)
    d_logit = ((sigmoid(logit) - label) * weight / weight.sum()).astype(np.float32)
    g = {"w": pooled.T @ d_logit, "o": d_logit.sum(keepdims=True)}
    d_pooled = d_logit[:, None] * p["w"]
    d_states = share[:, :, None] * d_pooled
    d_share = (states * d_pooled).sum(axis=2)
    d_score = share * (d_share - (share * d_share).sum(axis=0))
    g["v"] = np.einsum("tna,tn->a", mixed, d_score)
    d_mixed = d_score[:, :, None] * p["v"] * (1 - mixed * mixed)
    g["a"], g["d"] = np.einsum("tnh,tna->ha", states, d_mixed), d_mixed.sum(axis=(0, 1))
    d_states = d_states + d_mixed @ p["a"].T
    dx = np.zeros_like(x)
    for k, half in (("f", d_states[:, :, :HIDDEN]), ("b", d_states[:, :, HIDDEN:])):
        d_in, g["u" + k] = recur_back(half, p["u" + k], mask, kept[k])
        g["x" + k], g["c" + k] = np.einsum("tnd,tng->dg", x, d_in), d_in.sum(axis=(0, 1))
        dx += d_in @ p["x" + k].T
    d_table = np.zeros_like(table)
    np.add.at(d_table, place, dx)
    g["words"], g["grams"] = np.zeros_like(p["words"]), np.zeros_like(p["grams"])
    np.add.at(g["words"], own.bucket, d_table[:, :WORD_SIZE])
    sizes = np.diff(own.firsts)
    np.add.at(g["grams"], own.grams, np.repeat(d_table[:, WORD_SIZE:] / sizes[:, None], sizes, axis=0))
    return g


def subset(words: Words, rows: np.ndarray) -> Words:
    sizes = np.diff(words.firsts)[rows]
    firsts = np.concatenate(([0], np.cumsum(sizes)))
    at = np.repeat(words.firsts[rows] - firsts[:-1], sizes) + np.arange(firsts[-1])
    return Words(words.bucket[rows], words.grams[at], firsts)


class Model(NamedTuple):
    parameters: dict[str, np.ndarray] | None  # None: a constant score
    slope: float
    offset: float

    def score(self, logits: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * logits + self.offset)


class Scorer:
    """Highest window logits of texts; the projected inputs of frequent words are remembered."""

    def __init__(self, parameters: dict[str, np.ndarray]):
        self.p = parameters
        self.u = [parameters["u" + k] for k in "fb"]
        self.x = np.concatenate([parameters["x" + k] for k in "fb"], axis=1)
        self.c = np.concatenate([parameters["c" + k] for k in "fb"])
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.rows = np.empty((2 * MEMORY, 6 * HIDDEN), np.float32)

    def look_up(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        words = [words_of(x) for x in texts]
        if len(self.number) > MEMORY:
            self.forget()
        number = self.number
        new = [x for x in set().union(*words) if x not in number]
        if new:
            first, last = len(number), len(number) + len(new)
            number.update(zip(new, range(first, last), strict=True))
            if last > len(self.rows):  # one long text may bring more words than are remembered
                self.rows = np.concatenate((self.rows[:first], np.empty((len(new) + MEMORY, 6 * HIDDEN), np.float32)))
            self.rows[first:last] = inputs(self.p, hashed(new)) @ self.x + self.c
        flat = np.fromiter(chain.from_iterable(map(number.__getitem__, own) for own in words), np.int64)
        return flat, np.array([len(x) for x in words], np.int64)

    def window_logits(self, flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        doc, start, size = windows(lengths)
        out = np.empty(len(doc), np.float32)
        full = size == WINDOW
        steps = np.arange(WINDOW)[:, None]
        for complete in (True, False):
            chosen = np.flatnonzero(full == complete)
            for i in range(0, len(chosen), BLOCK):
                part = chosen[i : i + BLOCK]
                mask = None if complete else (steps < size[part])[:, :, None].astype(np.float32)
                at = flat[start[part] + (steps if complete else np.minimum(steps, size[part] - 1))]
                states = np.empty((WINDOW, len(part), 2 * HIDDEN), np.float32)
                for k in (0, 1):
                    self.recur(at, k, mask, states[:, :, HIDDEN * k : HIDDEN * (k + 1)])
                out[part] = attend(self.p, states, mask)[0]
        return doc, out

    def recur(self, at: np.ndarray, way: int, mask: np.ndarray | None, out: np.ndarray) -> None:
        """As the function of this name, with the halves of the sigmoids folded into the weights."""
        scale = np.repeat(np.float32([0.5, 0.5, 1.0]), HIDDEN)
        u = self.u[way] * np.float32(0.5)
        table = self.rows[:, 3 * HIDDEN * way : 3 * HIDDEN * (way + 1)]
        h = np.zeros((at.shape[1], HIDDEN), np.float32)
        for t in range(WINDOW - 1, -1, -1) if way else range(WINDOW):
            x, g = table[at[t]], h @ u
            zr = x[:, : 2 * HIDDEN] * scale[: 2 * HIDDEN]
            zr += g[:, : 2 * HIDDEN]
            np.tanh(zr, out=zr)
            own = g[:, 2 * HIDDEN :]
            c = zr[:, HIDDEN:] * own
            c += own
            c += x[:, 2 * HIDDEN :]
            np.tanh(c, out=c)
            new = h - c
            new *= zr[:, :HIDDEN]
            new += h
            new += c
            new *= np.float32(0.5)
            h = new if mask is None else h + mask[t] * (new - h)
            out[t] = h

    def __call__(self, texts: list[str]) -> np.ndarray:
        flat, lengths = self.look_up(texts)
        doc, logits = self.window_logits(flat, lengths)
        best = np.full(len(texts), LOWEST)
        np.maximum.at(best, doc, logits)
        return best


def besides(count: np.ndarray) -> np.ndarray:
    """Documents other than the one at hand: a count less its own."""
    return np.maximum(count - 1, 0)


def log_odds(toxic: np.ndarray, others: np.ndarray, n_toxic: float, n_others: float) -> np.ndarray:
    """Shrunk towards 0 where few documents have it and scaled to about one. Each count is less one, else a document's own rare words tell its label."""
    toxic, others = besides(toxic), besides(others)
    odds = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((others + 0.5) / (n_others + 1))
    seen = toxic + others
    return np.where(seen < 1, 0, np.clip(odds * seen / (seen + 4), -4, 4) / 4)


def fit(texts: list[str], labels: np.ndarray, share: float, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """share: of toxic documents among all labelled ones, which the sample need not have."""
    labels = np.asarray(labels, np.float32)
    n_toxic = float(labels.sum())
    if not 0 < n_toxic < len(labels):
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(None, 0.0, float(np.log(share / (1 - share))))
    rng, p = np.random.default_rng(seed), fresh_parameters(seed)
    number: dict[str, int] = {}
    parts = [np.array([number.setdefault(w, len(number)) for w in words_of(x)], np.int32) for x in texts]
    flat, lengths = np.concatenate(parts), np.array([len(x) for x in parts], np.int64)
    words = hashed(list(number))
    doc, start, size = windows(lengths)
    if not len(doc):
        return Model(None, 0.0, float(np.log(share / (1 - share))))

    # documents that have each word bucket or trigram bucket, by label; one document after another, so no list of all pairs is held
    with_word, with_gram = np.zeros((2, WORD_BUCKETS)), np.zeros((2, GRAM_BUCKETS))
    for own, label in zip(parts, labels, strict=True):
        used = np.unique(own)
        with_word[int(label), np.unique(words.bucket[used])] += 1
        with_gram[int(label), np.unique(subset(words, used).grams)] += 1
    p["words"][:, 0] = log_odds(with_word[1], with_word[0], n_toxic, len(labels) - n_toxic)
    p["grams"][:, 0] = log_odds(with_gram[1], with_gram[0], n_toxic, len(labels) - n_toxic)

    pace = {"words": with_word, "grams": with_gram}
    pace = {k: (besides(v.sum(axis=0)) / (besides(v.sum(axis=0)) + SHRINK)).astype(np.float32)[:, None] for k, v in pace.items()}

    weight = np.where(labels > 0, share / n_toxic, (1 - share) / (len(labels) - n_toxic)) * len(labels)
    first = p["words"][words.bucket[flat], 0]
    steps = np.arange(WINDOW)[:, None]
    at_all = (np.minimum(steps, size - 1) + start).astype(np.int32)
    rank = first[at_all].max(axis=0)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    count, per_epoch = 0, (n_toxic + (HARD + RANDOM) * (len(labels) - n_toxic)) / BATCH
    epochs = max(epochs, int(LEAST_BATCHES / per_epoch))
    for epoch in range(epochs):
        if epoch:
            rank = all_logits(p, words, flat, lengths)
        order = np.lexsort((-rank, doc))
        turn = np.arange(len(order)) - np.searchsorted(doc[order], doc[order], "left")
        toxic = labels[doc[order]] > 0
        drawn = rng.random(len(order)) < RANDOM / np.maximum(1, np.bincount(doc, minlength=len(labels))[doc[order]])
        chosen = order[np.where(toxic, turn < 1, (turn < HARD) | drawn)]
        rng.shuffle(chosen)
        for i in range(0, len(chosen), BATCH):
            part = chosen[i : i + BATCH]
            mask = (steps < size[part])[:, :, None].astype(np.float32)
            mask[rng.random(mask.shape) < DROPPED] = 0  # at least one word stays, below
            mask[0] = np.maximum(mask[0], mask.sum(axis=0) == 0)
            w = np.where(labels[doc[part]] > 0, weight[doc[part]], weight[doc[part]] / (HARD + RANDOM)).astype(np.float32)
            g = gradients(p, words, flat[at_all[:, part]], mask, labels[doc[part]], w)
            count += 1
            for k, v in g.items():
                m, s = moments[k]
                m += 0.1 * (v - m)
                s += 0.001 * (v * v - s)
                p[k] -= RATE * pace.get(k, 1) * (1 - epoch / epochs) * (m / (1 - 0.9**count)) / (np.sqrt(s / (1 - 0.999**count)) + 1e-8)
    best = np.full(len(labels), LOWEST)
    np.maximum.at(best, doc, all_logits(p, words, flat, lengths))
    slope, offset = calibrated(best, labels, weight)
    return Model(p, slope, offset)


def all_logits(p: dict[str, np.ndarray], words: Words, flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    scorer = Scorer(p)
    n = len(words.bucket)
    scorer.rows = np.empty((n, 6 * HIDDEN), np.float32)
    for i in range(0, n, 1 << 14):
        some = np.arange(i, min(n, i + (1 << 14)))
        scorer.rows[some] = inputs(p, subset(words, some)) @ scorer.x + scorer.c
    return scorer.window_logits(flat, lengths)[1]


def calibrated(logit: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a weighted logistic regression of the label on the logit, with a small ridge towards 1 and 0."""
    x = np.stack((logit, np.ones(len(logit))), axis=1)
    b, prior = np.array([1.0, 0.0]), np.array([1.0, 0.0])
    for _ in range(25):
        q = sigmoid(x @ b)
        grad = x.T @ (weight * (q - label)) + (b - prior)
        hess = (x * (weight * q * (1 - q))[:, None]).T @ x + np.eye(2)
        b = b - np.clip(np.linalg.solve(hess, grad), -2, 2)
    return max(float(b[0]), 1e-3), float(b[1])


def within(sizes: list[tuple], most: int) -> list:
    """Ids in order whose sizes add up to at most so much; one that would go beyond it is passed over."""
    kept, used = [], 0
    for name, size in sizes:
        if used + size <= most:
            kept.append(name)
            used += size
    return kept


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fits on a bounded sample; the driver holds that sample and the network."""
    known = labels.filter(F.col(label_col).isNotNull() & ~common.held_out(id_col))
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    count = {x.label: x.n for x in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    total, toxic = sum(count.values()), count.get(1, 0)
    if not total:
        return Model(None, 0.0, -100.0)
    space = 1 << 30
    limit = F.when(F.col("label") == 1, space * SAMPLE_POSITIVE // max(toxic, SAMPLE_POSITIVE)).otherwise(space * SAMPLE_NEGATIVE // max(total - toxic, SAMPLE_NEGATIVE))
    sample = known.filter(F.pmod(F.xxhash64("id"), F.lit(space)) < limit)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")  # bounded by the sample's size
    texts = common.written(rows.groupBy("id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")), "toxicity-sample")
    sizes = texts.select("id", F.octet_length("text").alias("n")).orderBy(F.xxhash64("id"), "id").collect()  # a row for each sampled document
    found = texts.filter(F.col("id").isin(within(sizes, SAMPLE_BYTES))).orderBy("id").collect()
    return fit([x.text for x in found], np.array([x.label for x in found]), toxic / total)


FIELDS = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]


def maker(docs: DataFrame, model: Model):
    """() -> (texts -> scores), for the workers."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = shared.value
        if own.parameters is None:
            return lambda texts: own.score(np.zeros(len(texts)))
        scorer = Scorer(own.parameters)
        return lambda texts: own.score(scorer(texts))

    return make


def scored(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """The kept columns, score and predicted."""
    score = maker(docs, model)

    def make():
        compute = score()

        def run(texts):
            found = compute(texts)
            return pa.array(found, pa.float64()), pa.array((found >= 0.5).astype(np.int32))

        return run

    return common.map_texts(docs, text_col, make, FIELDS, keep)


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The documents that are not predicted to be toxic."""
    score = maker(docs, model)

    def make():
        compute = score()
        return lambda texts: compute(texts) < 0.5

    return common.keep_texts(docs, text_col, make)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = train(docs, common.table(spark, sf_dir, "labels"))
    return scored(docs, model, ["doc_id"]).withColumn("held_out", common.held_out("doc_id"))
