"""Toxicity by non-negative positive-unlabelled learning.

Learned from confirmed toxic texts and unlabelled ones. With class prior p and a loss l of the margin g, the risk is
p E_pos[l(g)] + max(0, E_unl[l(-g)] - p E_pos[l(-g)]): the unlabelled texts stand in for clean ones after the toxic share
is taken out, and the estimate of the clean part is kept from going below zero. The classifier is linear in the presence
of words; the words are those whose shares in toxic and unlabelled texts differ most.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import in_fold

C = F.col
# ASCII punctuation parts words; A-Z become small. Other letters are folded by lower().
PARTS = str.maketrans({c: " " for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"})


def words_of(text: str | None) -> set[str]:
    return set((text or "").translate(PARTS).lower().split())


@dataclass
class Model:
    weights: dict[str, float]
    bias: float

    def score(self, text: str | None) -> float:
        found = self.weights.keys() & words_of(text)
        return float(1 / (1 + np.exp(-np.clip(self.bias + sum(self.weights[w] for w in sorted(found)), -30, 30))))


def fit(rows: list[list[int]], positive: np.ndarray, features: int, prior: float, steps: int = 300, rate: float = 0.1, decay: float = 1e-5):
    """Weights and bias by Adam on the non-negative risk; rows hold the features present in a text.

    The loss of a margin is the sigmoid one. As it has no scale of its own, the bias is then set so that the mean score
    of the unlabelled texts is the prior.
    """
    size = np.array([len(r) for r in rows], np.int64)
    column = np.fromiter((x for r in rows for x in r), np.int64, int(size.sum()))
    row = np.repeat(np.arange(len(rows)), size)
    theta, m, v = np.zeros(features + 1), np.zeros(features + 1), np.zeros(features + 1)
    theta[-1] = np.log(prior / (1 - prior))
    n_pos, n_unl = max(1, int(positive.sum())), max(1, int((~positive).sum()))
    sigmoid = lambda g: 1 / (1 + np.exp(-np.clip(g, -30, 30)))
    for t in range(1, steps + 1):
        p = sigmoid(theta[-1] + np.bincount(row, weights=theta[column], minlength=len(rows)))
        clean = p[~positive].sum() / n_unl - prior * p[positive].sum() / n_pos
        slope = p * (1 - p) * np.where(positive, -prior / n_pos, 0.0)
        if clean >= 0:
            slope += p * (1 - p) * np.where(positive, -prior / n_pos, 1 / n_unl)
        grad = np.append(np.bincount(column, weights=slope[row], minlength=features), slope.sum())
        grad[:-1] += decay * theta[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    margin = np.bincount(row, weights=theta[column], minlength=len(rows))[~positive]
    low, high = -30.0, 30.0
    for _ in range(60):
        theta[-1] = (low + high) / 2
        low, high = (low, theta[-1]) if len(margin) and sigmoid(margin + theta[-1]).mean() > prior else (theta[-1], high)
    return theta[:-1], float(theta[-1])


def train(docs: DataFrame, labels: DataFrame, parts: int = 4, held_part: int = 2, positives: int = 3000, unlabelled: int = 9000, words: int = 2000, least_z: float = 4.5) -> Model:
    """Learn from rows whose crc32(doc_id) modulo `parts` is not `held_part`.

    `positives` and `unlabelled` bound the sample: about so many texts of each kind, picked by a hash of doc_id. The prior
    is the toxic share of the labelled rows. Without a toxic row the model scores everything 0.
    """
    known = labels.select(C("doc_id").cast("bigint").alias("doc_id"), C("toxic").cast("int").alias("toxic")).where(~in_fold("doc_id", parts, held_part) & C("doc_id").isNotNull() & C("toxic").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, toxic = known.agg(F.count("*"), F.count_if(C("toxic") == 1)).first()
    texts = docs.select(C("doc_id").cast("bigint").alias("doc_id"), C("text").cast("string").alias("text")).where(~in_fold("doc_id", parts, held_part) & C("doc_id").isNotNull())
    many = docs.count()
    if not toxic or not many:
        return Model({}, -30.0)
    prior = min(0.9, max(1e-4, toxic / n))
    part = lambda salt, bound, total: F.pmod(F.xxhash64(F.lit(salt), "doc_id"), F.lit(1_000_003)) < int(1_000_003 * min(1.0, bound / total))
    as_words = F.pandas_udf(lambda text: pd.Series([sorted(words_of(t)) for t in text]), "array<string>")
    chosen = F.broadcast(known.where("toxic = 1").where(part("p", positives, toxic)).select("doc_id"))  # about `positives` ids
    pos = texts.join(chosen, "doc_id", "left_semi").select(F.lit(True).alias("positive"), as_words("text").alias("w"))
    unl = texts.where(part("u", unlabelled, many)).select(F.lit(False).alias("positive"), as_words("text").alias("w"))
    sample = cut(pos.unionByName(unl))
    n_pos, n_unl = sample.agg(F.count_if("positive"), F.count_if(~C("positive"))).first()
    if not n_pos or not n_unl:
        return Model({}, -30.0)
    a, b = C("a") / n_pos, C("b") / n_unl
    share = (C("a") + C("b")) / (n_pos + n_unl)
    z = (a - b) / F.sqrt(F.greatest(share * (1 - share), F.lit(1e-12)) * (1 / n_pos + 1 / n_unl))
    counted = sample.select("positive", F.explode("w").alias("word")).groupBy("word").agg(F.count_if("positive").alias("a"), F.count_if(~C("positive")).alias("b"))
    top = counted.where(C("a") + C("b") >= 5).withColumn("z", F.abs(z)).where(C("z") >= least_z).orderBy(C("z").desc(), "word").limit(words)
    number = {r["word"]: i for i, r in enumerate(top.collect())}
    if not number:
        return Model({}, -30.0)
    chosen = F.broadcast(sample.sparkSession.createDataFrame([(list(number),)], "top array<string>"))
    present = sample.crossJoin(chosen).select("positive", F.array_intersect("w", "top").alias("w")).collect()  # a bounded sample, a few words each
    weights, bias = fit([[number[w] for w in r["w"]] for r in present], np.array([r["positive"] for r in present], bool), len(number), prior)
    return Model(dict(zip(number, weights.tolist(), strict=True)), bias)


def score_column(docs: DataFrame, model: Model):
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most `words` weights

    @F.pandas_udf("double")
    def of(text: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(t) for t in text], dtype="float64")

    return of


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, parts: int = 4, held_part: int = 2, **bounds) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= threshold) of every whole text; labels, lang and source play no part in it.

    A null text scores as an empty one; repeated rows score alike; rows with a null doc_id are scored but not learned from
    and count as not held out; empty tables give an empty result (no labels: scores near 0); other columns are ignored.
    """
    of = score_column(docs, train(docs, labels, parts, held_part, **bounds))
    rows = docs.select(C("doc_id").cast("bigint").alias("doc_id"), in_fold("doc_id", parts, held_part).alias("held_out"), of(C("text").cast("string")).alias("score"))
    return rows.withColumn("predicted", (C("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **bounds) -> DataFrame:
    """The documents that score below the threshold, with the columns they came with.

    A null text scores as an empty one; repeated rows share their fate; without a known toxic text all stay; an empty table
    stays empty.
    """
    of = score_column(docs, train(docs, labels, **bounds))
    return docs.where(of(C("text").cast("string")) < threshold)
