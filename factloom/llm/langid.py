"""Language identification by multilingual mixture inference.

A language is a smoothed distribution over hashed character trigrams, learned from at most
about SAMPLE_DOCS whole labelled documents of it (chosen by a hash of the id, so the same ones at
every run). A document is a mixture: expectation-maximisation estimates the languages'
proportions from the likelihoods of its trigrams. The nested sets of its 1, 2, ... most
probable languages are then fitted again, and the set with the best log-likelihood less a penalty for
each further language is taken. Sets grow until no document's penalised likelihood can rise: none is above that of each trigram
under its best language. The predicted language has the largest proportion in that
set; the score is that proportion.

A text that is null or has no letter is `und` with score 0, and so is every text if nothing
is labelled. Ties go to the language first in the alphabet. Repeated rows give equal values; very long texts are handled
whole, an empty table gives an empty result, and other columns of any name aren't read.
The model is a table of languages x BUCKETS floats, whatever the input's size.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Bound of the training sample: about so many documents of each language.
SAMPLE_DOCS = 1000
BUCKETS = 1 << 15
SMOOTHING = 0.2
ROUNDS = 12
#: Log-likelihood that each further language must add, times the log of the number of trigrams.
PENALTY = 2.0
UNKNOWN = "und"

LETTER = regex.compile(r"\p{L}")


class Model(NamedTuple):
    languages: list[str]
    log_p: np.ndarray  # BUCKETS x languages


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all character trigrams of the lower-cased texts, each text between blanks, and the number of each text's."""
    padded = [f" {' '.join(x.lower().split())} " for x in texts]
    codes = np.frombuffer("".join(padded).encode("utf-32-le"), np.uint32)
    sizes = np.array([len(x) for x in padded], np.int64)
    if len(codes) < 3:
        return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    with np.errstate(over="ignore"):
        hashed = codes[:-2] * np.uint32(0x9E3779B1) + codes[1:-1] * np.uint32(0x85EBCA77) + codes[2:] * np.uint32(0xC2B2AE3D)
        hashed = ((hashed ^ (hashed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(17)
    inside = np.ones(len(codes), bool)
    ends = np.cumsum(sizes)
    inside[ends - 1] = False
    inside[np.maximum(ends - 2, 0)] = False
    return hashed[inside[:-2]].astype(np.int64), np.maximum(sizes - 2, 0)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Counts trigrams of a bounded sample on the executors; the driver gets a count vector for each language and task."""
    rows = docs.filter(~common.held_out(id_col) & F.col(lang_col).isNotNull())
    counts = {x.lang: x.n for x in rows.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).collect()}  # a row for each language
    if not counts:
        return Model([], np.zeros((BUCKETS, 0), np.float32))
    space = 1 << 30
    limits = {k: min(space, space * SAMPLE_DOCS // n) for k, n in counts.items()}
    limit = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])[F.col(lang_col)]
    sample = rows.filter(F.pmod(F.xxhash64(F.col(id_col)), F.lit(space)) < limit)
    sample = sample.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).repartition(8)
    schema = "lang string, counts binary"

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in common.slices(batch, "text"):
                for lang, text in zip(part.column(0).to_pylist(), common.texts_of(part, "text"), strict=True):
                    found = np.bincount(grams([text])[0], minlength=BUCKETS)
                    total[lang] = total[lang] + found if lang in total else found
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([x.astype(np.uint32).tobytes() for x in total.values()], pa.binary())], names=["lang", "counts"])

    languages = sorted(counts)
    table = np.full((BUCKETS, len(languages)), SMOOTHING)
    for x in sample.mapInArrow(run, schema).toLocalIterator():
        table[:, languages.index(x.lang)] += np.frombuffer(x.counts, np.uint32)
    return Model(languages, np.log(table / table.sum(axis=0)).astype(np.float32))


def mixtures(model: Model, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Predicted language, score and chosen number of languages of each text."""
    n, k = len(texts), len(model.languages)
    lang, score, chosen = [UNKNOWN] * n, np.zeros(n), np.zeros(n, np.int64)
    rows = [i for i, x in enumerate(texts) if LETTER.search(x)] if k else []
    if not rows:
        return lang, score, chosen
    gram, sizes = grams([texts[i] for i in rows])
    keys, weight = np.unique(np.repeat(np.arange(len(rows)), sizes) * BUCKETS + gram, return_counts=True)
    doc, gram, weight = keys // BUCKETS, keys % BUCKETS, weight.astype(np.float32)
    firsts = np.searchsorted(doc, np.arange(len(rows)))
    log_p = model.log_p[gram]
    top = log_p.max(axis=1)
    p = np.exp(log_p - top[:, None])
    fixed = np.add.reduceat(weight * top, firsts)
    total = np.add.reduceat(weight, firsts)

    def fit(share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
        for _ in range(rounds):
            part = p * share[doc]
            part *= (weight / part.sum(axis=1))[:, None]
            share = np.add.reduceat(part, firsts) / total[:, None]
        mixed = np.maximum((p * share[doc]).sum(axis=1), 1e-30)
        return share, fixed + np.add.reduceat(weight * np.log(mixed), firsts)

    share, _ = fit(np.full((len(rows), k), 1 / k, np.float32), ROUNDS)
    order = np.argsort(-share, axis=1, kind="stable")
    best = np.full(len(rows), -np.inf)
    final, count = np.zeros_like(share), np.zeros(len(rows), np.int64)
    for m in range(1, k + 1):
        if (fixed - PENALTY * (m - 1) * np.log(np.maximum(total, 2)) <= best).all():
            break
        start = np.full_like(share, 1e-12)
        np.put_along_axis(start, order[:, :m], np.maximum(np.take_along_axis(share, order[:, :m], axis=1), 1e-3), axis=1)
        start /= start.sum(axis=1, keepdims=True)
        own, likelihood = fit(start, 0 if m == 1 else ROUNDS // 3)
        likelihood = likelihood - PENALTY * (m - 1) * np.log(np.maximum(total, 2))
        better = likelihood > best
        best[better], final[better], count[better] = likelihood[better], own[better], m
    pick = final.argmax(axis=1)
    for i, r in enumerate(rows):
        lang[r], score[r], chosen[r] = model.languages[pick[i]], min(1.0, float(final[i, pick[i]])), count[i]
    return lang, score, chosen


FIELDS = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("n_languages", T.LongType())]


def predict(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x BUCKETS floats

    def make():
        def compute(texts):
            lang, score, chosen = mixtures(shared.value, texts)
            return pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(chosen, pa.int64())

        return compute

    return common.map_texts(docs, text_col, make, FIELDS, keep)


def keep_known(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Rejects documents whose language can't be told."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        return lambda texts: [x != UNKNOWN for x in mixtures(shared.value, texts)[0]]

    return common.keep_texts(docs, text_col, make)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    found = predict(docs, train(docs), ["doc_id"])
    return found.withColumn("held_out", common.held_out("doc_id"))
