"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of a fixed number of words that cover its whole text; only the document has a label. The
encoder turns each passage into h = tanh(x W + b), where x holds the mean of its words' byte classes and shapes, the mean
of learned vectors of its words (hashed to a table), its share of distinct words and its size. Gated attention weighs the
passages, a = softmax(w . (tanh(h V) * sigmoid(h U))), and a linear score reads the weighted sum of a document's passages.
All is trained together by Adam on the cross entropy, in numpy on the driver, on a bounded sample of labelled documents.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import in_fold, parts

C = F.col
PASSAGE = 64
AT_ONCE = 1024  # passages whose words are looked up together
BUCKETS, VECTOR, HIDDEN, GATE = 4096, 12, 24, 16
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# 0 small letters, 1 capitals, 2 digits, 3 first and 4 further bytes beyond ASCII, 5 control, then a class for each mark
CLASS = np.array([0 if 97 <= b <= 122 else 1 if 65 <= b <= 90 else 2 if 48 <= b <= 57 else 3 if b >= 192 else 4 if b >= 128 else 6 + PUNCTUATION.index(b) if b in PUNCTUATION else 5 for b in range(256)], np.int64)
CLASSES = 6 + len(PUNCTUATION)
FEATURES = CLASSES + 4  # and size, first letter a capital, all letters capitals, last byte a mark
SCORED = "doc_id bigint, held_out boolean, score double"


class _Numbers(dict):
    def __missing__(self, word):
        n = self[word] = len(self)
        return n


def word_rows(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Shape features and table bucket of each word."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    kind = CLASS[np.frombuffer(b"".join(words), np.uint8)]
    ends = np.cumsum(size)
    rows = np.zeros((len(words), FEATURES))
    rows[:, :CLASSES] = np.bincount(np.repeat(np.arange(len(words)), size) * CLASSES + kind, minlength=len(words) * CLASSES).reshape(-1, CLASSES)
    rows[:, CLASSES] = size
    rows[:, CLASSES + 1] = kind[ends - size] == 1
    rows[:, CLASSES + 2] = (rows[:, 1] > 1) & (rows[:, 0] == 0)
    rows[:, CLASSES + 3] = kind[ends - 1] >= 6
    return rows, np.fromiter((zlib.crc32(w) % BUCKETS for w in words), np.int64, len(words))


class Bags:
    """Passages of some documents: each passage's words (as rows of the distinct words), and each document's passages."""

    def __init__(self, texts: list[list[bytes]] | list[list[list[bytes]]]):
        """texts: for each document its passages, at least one, as words or as bytes that hold them; a passage may be empty."""
        own, passages = _Numbers(), [p.split() if isinstance(p, bytes) else p for t in texts for p in t]
        self.words = [np.fromiter(map(own.__getitem__, p), np.int64, len(p)) for p in passages]
        self.shape, self.bucket = word_rows(list(own))
        self.size = np.array([len(p) for p in passages], np.int64)
        self.first = np.cumsum([0, *(len(t) for t in texts)])  # of each document
        self.word = np.concatenate([*self.words, np.zeros(0, np.int64)])
        passage = np.repeat(np.arange(len(passages)), self.size)
        distinct = np.bincount(np.unique(passage * max(1, len(own)) + self.word) // max(1, len(own)), minlength=len(passages))
        self.extra = np.stack([distinct / np.maximum(1, self.size), np.log1p(self.size)], axis=1)

    def means(self, rows: np.ndarray) -> np.ndarray:
        """The mean over each passage of a row for each distinct word; 0 for a passage without words."""
        out = np.zeros((len(self.size), rows.shape[1]))
        full, ends = np.flatnonzero(self.size), np.cumsum(self.size)
        for i in range(0, len(full), AT_ONCE):  # a text of any length takes no more work space
            k = full[i : i + AT_ONCE]
            first = ends[k[0]] - self.size[k[0]]
            out[k] = np.add.reduceat(rows[self.word[first : ends[k[-1]]]], ends[k] - self.size[k] - first, axis=0) / self.size[k, None]
        return out


def passages_of(text: str | None, most: int | None = None) -> list[list[bytes]]:
    """The text's passages, with `most` only so many spread over it; an empty text is one empty passage."""
    words = (text or "").encode().split()
    out = [words[i : i + PASSAGE] for i in range(0, len(words), PASSAGE)] or [[]]
    return out if most is None or len(out) <= most else [out[i] for i in np.unique(np.linspace(0, len(out) - 1, most).astype(int))]


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    mean: np.ndarray  # of the shapes and extras
    scale: np.ndarray
    params: list[np.ndarray]  # table, W, b, V, U, w, c, d

    def forward(self, stats: np.ndarray, vectors: np.ndarray, first: np.ndarray):
        """Scores of the documents whose passages begin at `first`, with what the gradient needs."""
        _, W, b, V, U, w, c, d = self.params
        x = np.concatenate([(stats - self.mean) / self.scale, vectors], axis=1)
        h = np.tanh(x @ W + b)
        t, s = np.tanh(h @ V), sigmoid(h @ U)
        e = (t * s) @ w
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        e = np.exp(e - np.maximum.reduceat(e, first[:-1])[doc])
        a = e / np.add.reduceat(e, first[:-1])[doc]
        z = np.add.reduceat(a[:, None] * h, first[:-1], axis=0)
        return sigmoid(z @ c + d[0]), (x, h, t, s, a, z, doc)

    def gradients(self, bags: Bags, stats: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """The mean cross entropy and its slope in every parameter."""
        table, W, _, V, U, w, c, _ = self.params
        p, (x, h, t, s, a, z, doc) = self.forward(stats, bags.means(table[bags.bucket]), bags.first)
        loss = -np.mean(y * np.log(p + 1e-12) + (1 - y) * np.log(1 - p + 1e-12))
        g = (p - y) / len(y)
        dz = g[:, None] * c
        da = (dz[doc] * h).sum(axis=1)
        de = a * (da - np.add.reduceat(a * da, bags.first[:-1])[doc])
        dt, ds = de[:, None] * w * s * (1 - t * t), de[:, None] * w * t * s * (1 - s)
        dh = (a[:, None] * dz[doc] + dt @ V.T + ds @ U.T) * (1 - h * h)
        dx = (dh @ W.T)[:, -VECTOR:] / np.maximum(1, bags.size)[:, None]
        each, bucket = np.repeat(dx, bags.size, axis=0), bags.bucket[bags.word]
        dtable = np.stack([np.bincount(bucket, weights=each[:, k], minlength=BUCKETS) for k in range(VECTOR)], axis=1)
        return loss, [dtable, x.T @ dh, dh.sum(axis=0), h.T @ dt, h.T @ ds, (t * s).T @ de, z.T @ g, np.array([g.sum()])]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        bags = Bags([passages_of(t) for t in texts])
        wide = np.concatenate([bags.shape, self.params[0][bags.bucket]], axis=1)
        means = bags.means(wide)
        return self.forward(np.concatenate([means[:, :FEATURES], bags.extra], axis=1), means[:, FEATURES:], bags.first)[0]


def start(stats: np.ndarray, share: float, seed: int = 1) -> Model:
    rng = np.random.default_rng(seed)
    width = FEATURES + 2 + VECTOR
    shapes = [(BUCKETS, VECTOR), (width, HIDDEN), (HIDDEN,), (HIDDEN, GATE), (HIDDEN, GATE), (GATE,), (HIDDEN,), (1,)]
    params = [rng.normal(0, 0.5 / np.sqrt(s[0] if len(s) > 1 and s[0] < BUCKETS else 4), s) for s in shapes]
    params[2][:], params[7][:] = 0, np.log(share / (1 - share))
    return Model(stats.mean(axis=0), np.maximum(stats.std(axis=0), 0.05), params)


def fit(texts: list[list[bytes]], y: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.005, decay: float = 1e-4, seed: int = 1) -> Model:
    """A model of bags of passages and their labels 0 or 1, of which both occur."""
    bags = [Bags(texts[i : i + 256]) for i in range(0, len(texts), 256)]
    stats = np.concatenate([np.concatenate([b.means(b.shape), b.extra], axis=1) for b in bags])
    first = np.cumsum([0, *map(len, texts)])
    del bags
    model, rng = start(stats, float(np.clip(y.mean(), 0.01, 0.99)), seed), np.random.default_rng(seed + 1)
    m, v, n = [np.zeros_like(p) for p in model.params], [np.zeros_like(p) for p in model.params], 0
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for i in range(0, len(order), batch):
            at = order[i : i + batch]
            part = Bags([texts[k] for k in at.tolist()])
            rows = np.concatenate([np.arange(first[k], first[k + 1]) for k in at.tolist()])
            _, grads = model.gradients(part, stats[rows], y[at])
            n += 1
            for q, g, mm, vv in zip(model.params, grads, m, v, strict=True):
                g = g + decay * q if q.ndim == 2 else g
                mm += 0.1 * (g - mm)
                vv += 0.001 * (g * g - vv)
                q -= rate * (mm / (1 - 0.9**n)) / (np.sqrt(vv / (1 - 0.999**n)) + 1e-8)
    return model


def train(docs: DataFrame, labels: DataFrame, parts: int = 5, held_part: int = 0, texts: int = 4000, passages: int = 8) -> Model | float:
    """Learn from labelled documents whose crc32(doc_id) modulo `parts` is not `held_part`.

    The sample is bounded: about `texts` labelled documents, picked by a hash of doc_id, with up to `passages` passages
    spread over each. If the labels seen are all alike, or none, the share of ones (0.5 without any) stands for a model.
    """
    seen = lambda d: ~in_fold("doc_id", parts, held_part) & d["doc_id"].isNotNull()
    known = labels.select(C("doc_id").cast("bigint").alias("doc_id"), C("quality").cast("int").alias("quality"))
    known = known.where(seen(known) & C("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = docs.select(C("doc_id").cast("bigint").alias("doc_id"), C("text").cast("string").alias("text"))
    rows = rows.where(seen(rows))
    many = known.count()
    if not many:
        return 0.5
    chosen = known.where(F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(1_000_003)) < int(1_000_003 * min(1.0, texts / many)))
    spread = F.udf(lambda text: b"\n".join(b" ".join(p) for p in passages_of(text, passages)), "binary")  # on the sample alone
    sample = cut(rows.join(chosen, "doc_id").select("doc_id", "quality", spread("text").alias("passages"))).orderBy("doc_id", "passages").collect()
    y = np.array([r["quality"] for r in sample], float)
    if not len(y) or y.min() == y.max():
        return float(y[0]) if len(y) else 0.5
    return fit([bytes(r["passages"]).split(b"\n") for r in sample], y)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 5, held_part: int = 0, **bounds) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= threshold) of every whole text; labels, lang, source and doc_id play no part in a score.

    A null or empty text scores as one empty passage; a text of any length is read whole; repeated rows score alike; a null
    doc_id is scored, not learned from and not held out; an empty table gives an empty result; without labels of both
    kinds every text gets the share of ones among those seen, 0.5 without any; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, folds, held_part, **bounds))  # some hundred KB, whatever the data

    def run(batches):
        model = shared.value
        for batch in parts(batches, 1 << 20):
            texts = batch.column("text").to_pylist()
            score = model.scores(texts) if isinstance(model, Model) else np.full(len(texts), model)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score, pa.float64())], ["doc_id", "held_out", "score"])

    rows = docs.select(C("doc_id").cast("bigint").alias("doc_id"), in_fold("doc_id", folds, held_part).alias("held_out"), C("text").cast("string").alias("text"))
    return rows.mapInArrow(run, SCORED).withColumn("predicted", (C("score") >= threshold).cast("int"))
