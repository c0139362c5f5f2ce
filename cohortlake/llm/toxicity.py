"""Toxicity: non-negative positive-unlabelled learning of a word classifier."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlake.llm.common import map_batches, stored, text_slices
from cohortlake.llm.registry import query, table

#: Sample that the classifier is fitted on: confirmed examples and unlabelled texts at most, by the hash of their id.
MOST_POSITIVE, MOST_UNLABELLED = 4_000, 12_000
#: A word is a feature if so many texts of the sample hold it and its shares of confirmed and of unlabelled texts
#: lie so many standard deviations apart; so many features at most, those furthest apart.
LEAST_TEXTS, LEAST_DEVIATIONS, MOST_FEATURES = 8, 4.0, 5_000
FOLDS = 5
STEPS, RATE, RIDGE = 300, 0.05, 1e-4
#: Share of positives taken when no label tells it.
DEFAULT_PRIOR = 0.1

#: A-Z lower-cased; a-z and bytes from 0x80 stand for themselves; all else separates words.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def distinct_words(text: bytes | None) -> set[bytes]:
    return set(text.translate(_FOLD).split()) if text else set()


@dataclass
class Model:
    """Weights of words and a constant; the score is the logistic function of their sum."""

    weights: dict[bytes, float]
    constant: float

    def scores(self, texts: list) -> np.ndarray:
        get, total = self.weights.get, np.empty(len(texts))
        for i, t in enumerate(texts):
            total[i] = sum(get(w, 0.0) for w in sorted(distinct_words(t) & self.weights.keys()))
        return 1 / (1 + np.exp(-np.clip(total + self.constant, -30, 30)))


def risk_slopes(z: np.ndarray, is_p: np.ndarray, prior: float) -> tuple[np.ndarray, bool]:
    """The slope of the risk along each text's score ``z``, and whether the part of the negatives was below 0.

    The derivatives of the logistic losses l(+) and l(-) are s - 1 and s, and
    their difference is -1 for every score.
    """
    n_p, n_u = int(is_p.sum()), max(1, int((~is_p).sum()))
    s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    as_negative = np.logaddexp(0, z)
    if as_negative[~is_p].sum() / n_u - prior * as_negative[is_p].mean() >= 0:
        return np.where(is_p, -prior / n_p, s / n_u), False
    return np.where(is_p, prior * s / n_p, -s / n_u), True


def fitted(rows: list[np.ndarray], is_p: np.ndarray, names: list[bytes], prior: float) -> Model:
    """Minimise the class-prior-corrected risk with the correction for a negative part.

    ``rows`` holds the feature numbers of each text, ``is_p`` tells confirmed
    examples from unlabelled texts. The risk is ``prior * R_p(+)`` plus the
    risk of the unlabelled texts as negatives less ``prior * R_p(-)``, with the
    logistic loss. Where that second part falls below 0 the step goes up its
    gradient, so that the classifier does not learn the sample by heart.
    """
    if not is_p.any():
        return Model({}, -30.0)
    index = np.concatenate([np.empty(0, np.int32), *rows]).astype(np.int32)
    row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
    weights, constant = np.zeros(len(names)), 0.0
    m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for step in range(1, STEPS + 1):
        z = np.bincount(row, weights[index], len(rows)) + constant
        per_text, _ = risk_slopes(z, is_p, prior)
        grad = np.append(np.bincount(index, per_text[row], len(names)) + RIDGE * weights, per_text.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        weights, constant = weights - move[:-1], constant - move[-1]
    return Model(dict(zip(names, weights.tolist(), strict=True)), float(constant))


def fold(key: Column) -> Column:
    """crc32 of the id as text, modulo FOLDS; null ids are in no held-out fold."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(FOLDS)), F.lit(-1))


def sample(texts: DataFrame, most: int) -> DataFrame:
    """At most ``most`` different texts by a hash of key and text: the same whatever the partitioning.

    Only hashes are ranked; the texts then join the chosen ones.
    """
    hashed = texts.withColumn("_h", F.xxhash64("_key", "_text"))
    chosen = stored(hashed.select("_h").distinct().orderBy("_h").limit(most), "chosen")
    return hashed.join(chosen, "_h").dropDuplicates(["_h"]).select("_h", "_text")


def word_lists(texts: DataFrame, numbers: dict[bytes, int] | None) -> DataFrame:
    """Distinct words of each text, or, with ``numbers``, those words' numbers packed as 32-bit integers."""
    words = T.ArrayType(T.BinaryType()) if numbers is None else T.BinaryType()
    schema = T.StructType([T.StructField("p", T.BooleanType()), T.StructField("words", words)])
    shared = texts.sparkSession.sparkContext.broadcast(numbers)  # MOST_FEATURES words at most

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        known = shared.value
        for part, texts in text_slices(batch, 1):
            sets = [distinct_words(t) for t in texts]
            if known is None:
                lists = pa.array([sorted(s) for s in sets], pa.list_(pa.binary()))
            else:
                lists = pa.array([np.array(sorted(known[w] for w in s if w in known), np.int32).tobytes() for s in sets], pa.binary())
            yield {"p": part.column(0), "words": lists}

    return map_batches(texts.select("p", "_text"), schema, run)


def features(lists: DataFrame, n_p: int, n_u: int) -> list[bytes]:
    """The words that tell confirmed from unlabelled texts, the clearest first."""
    counted = lists.select("p", F.explode("words").alias("word")).groupBy("word").agg(
        F.count_if("p").alias("p"), F.count_if(~F.col("p")).alias("u"))
    share_p, share_u = F.col("p") / F.lit(float(max(1, n_p))), (F.col("u") + 0.5) / F.lit(float(n_u + 1))
    spread = F.sqrt(share_u * (1 - share_u) * F.lit(1 / max(1, n_p) + 1 / max(1, n_u)))
    apart = F.round(F.abs(share_p - share_u) / spread, 6)
    told = counted.where((F.col("p") + F.col("u") >= LEAST_TEXTS) & (F.col("u") <= n_u) & (share_u < 1)).withColumn("apart", apart)
    best = told.where(F.col("apart") >= LEAST_DEVIATIONS).orderBy(F.desc("apart"), "word").limit(MOST_FEATURES)
    return [bytes(r.word) for r in best.collect()]


def learned(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
            most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED) -> Model:
    """Fit the classifier on confirmed examples and unlabelled texts outside the held-out fold.

    The class prior is the share of positives among the labelled ids outside
    that fold. The sample is bounded by its two parameters; its words are
    counted in tasks, and the driver gets the features and one packed list of
    their numbers per text. A document with several labels counts as confirmed
    if one of them is 1. Null texts and null labels are left out, a null id
    is in no held-out fold; texts are read whole, repeated ones count once.
    Empty tables give a model without words.
    """
    outside = fold(F.col("_key")) != 0
    texts = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where("_text is not null").where(outside)
    known = (
        labels.select(F.col(key).alias("_key"), F.col(label).alias("_label")).where("_label is not null")
        .where(outside).groupBy("_key").agg(F.max("_label").alias("_label"))
    )
    count, toxic = known.agg(F.count(F.lit(1)), F.sum(F.when(F.col("_label") == 1, 1).otherwise(0))).first()
    prior = toxic / count if count else DEFAULT_PRIOR
    positive = sample(texts.join(stored(known.where("_label = 1"), "toxic"), "_key").select("_key", "_text"), most_positive)
    both = stored(positive.withColumn("p", F.lit(True)).union(sample(texts, most_unlabelled).withColumn("p", F.lit(False))), "sample")
    names = features(word_lists(both, None), *both.agg(F.count_if("p"), F.count_if(~F.col("p"))).first())
    lists = word_lists(both.orderBy("p", "_h"), {w: i for i, w in enumerate(names)}).toArrow()
    rows = [np.frombuffer(x.as_buffer(), np.int32) for x in lists["words"]]
    return fitted(rows, np.array(lists["p"].to_pylist(), bool), names, prior)


def toxicity_scores(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, held_out, score, predicted)`` of every document.

    Null and empty texts get the score of a text without known words, long
    texts are read whole, an empty table gives an empty result, and further
    columns are not read. Repeated rows are scored one by one. Without a confirmed example every score is
    about 0. The score is rounded to 12 places.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # MOST_FEATURES weights at most
    source = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    schema = T.StructType([source.schema["_key"], T.StructField("score", T.DoubleType())])

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for part, texts in text_slices(batch, 1):
            yield {"_key": part.column(0), "score": pa.array(np.round(shared.value.scores(texts), 12))}

    scored = map_batches(source, schema, run)
    return scored.select(
        F.col("_key").alias(key), (fold(F.col("_key")) == 0).alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


def held_out(key: object) -> bool:
    """The fold rule for one id, for tests."""
    return zlib.crc32(str(key).encode()) % FOLDS == 0


@query()
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity_scores(docs, learned(docs, table(spark, sf_dir, "labels")))
