"""Language identification by a byte convolutional network.

A text in lower case is cut into windows of fixed length that overlap by a filter's width, so that every byte sequence
of the whole text is seen. Filters of several widths run over the bytes of a window; the maximum of each filter over the
window feeds a softmax. The probabilities of a text are the mean over its windows, weighted by their bytes. The network
is trained in numpy on windows of a bounded sample of labelled texts; applying it adds up rows of per-byte-pair tables,
which are the filters' responses to one-hot bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import in_fold

C = F.col
WIDTHS = (2, 3, 4)
FILTERS = 32
WINDOW = 256
LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"


def windows_of(text: str, window: int = WINDOW) -> np.ndarray:
    """The whole text as rows of bytes, the last filled up with zeros."""
    data = np.frombuffer(text.lower().encode(), np.uint8)
    step = window - max(WIDTHS) + 1
    n = max(1, -(-(len(data) - max(WIDTHS) + 1) // step))
    padded = np.zeros((n - 1) * step + window, np.uint8)
    padded[: len(data)] = data
    return np.lib.stride_tricks.sliding_window_view(padded, window)[::step]


@dataclass
class Network:
    langs: list[str]
    filters: dict[int, np.ndarray]  # width -> (width, 256, filters)
    bias: np.ndarray
    dense: np.ndarray
    offset: np.ndarray

    def tables(self):
        """Responses to two bytes, for each width: the first pair, and the second pair or third byte, if any."""
        pair = lambda a, b: (a[:, None] + b[None]).reshape(-1, a.shape[1]).astype(np.float32)
        out = {}
        for w, f in self.filters.items():
            out[w] = (pair(f[0], f[1]), pair(f[2], f[3]) if w == 4 else f[2].astype(np.float32) if w == 3 else None)
        return out

    def pooled(self, x: np.ndarray, tables) -> np.ndarray:
        code = x.astype(np.intp)
        pairs = code[:, :-1] << 8 | code[:, 1:]
        parts = []
        for w, (first, second) in tables.items():
            t = x.shape[1] - w + 1
            h = np.take(first, pairs[:, :t], axis=0)
            if second is not None:
                h += np.take(second, pairs[:, 2 : 2 + t] if w == 4 else code[:, 2 : 2 + t], axis=0)
            parts.append(h.max(axis=1))
        return np.maximum(np.concatenate(parts, axis=1) + self.bias, 0)

    def probabilities(self, x: np.ndarray, tables, batch: int = 16) -> np.ndarray:
        out = [self.pooled(x[i : i + batch], tables) for i in range(0, len(x), batch)]
        z = np.concatenate(out) @ self.dense + self.offset
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def predict(self, text: str | None, tables) -> tuple[str, float]:
        if not text or not LETTER.search(text):
            return UNKNOWN, 0.0
        x = windows_of(text)
        weight = np.maximum(1, (x != 0).sum(axis=1))
        p = weight @ self.probabilities(x, tables) / weight.sum()
        return self.langs[int(p.argmax())], float(min(1.0, p.max()))


def fit(x: np.ndarray, y: np.ndarray, langs: list[str], epochs: int = 6, batch: int = 64, rate: float = 0.005, seed: int = 1) -> Network:
    """Adam on the cross entropy; half of the windows of a batch are shortened, so that short texts are known too."""
    rng = np.random.default_rng(seed)
    net = Network(langs, {w: rng.normal(0, 0.1, (w, 256, FILTERS)) for w in WIDTHS}, np.zeros(FILTERS * len(WIDTHS)), rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(langs))), np.zeros(len(langs)))
    params = [*net.filters.values(), net.bias, net.dense, net.offset]
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(order), batch):
            at = order[i : i + batch]
            xb, yb = x[at].copy(), y[at]
            short = rng.random(len(at)) < 0.5
            xb[(np.arange(x.shape[1]) >= rng.integers(12, x.shape[1], len(at))[:, None]) & short[:, None]] = 0
            pooled, where = [], []
            for w, f in net.filters.items():
                steps = x.shape[1] - w + 1
                h = sum(f[j].astype(np.float32)[xb[:, j : j + steps]] for j in range(w))
                best = h.argmax(axis=1)
                where.append(best)
                pooled.append(np.take_along_axis(h, best[:, None], axis=1)[:, 0])
            a = np.maximum(np.concatenate(pooled, axis=1) + net.bias, 0)
            z = a @ net.dense + net.offset
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(at)), yb] -= 1
            p /= len(at)
            back = (p @ net.dense.T) * (a > 0)
            grads, row, k = [], np.arange(len(at))[:, None], np.arange(FILTERS)[None]
            for n, (w, best) in enumerate(zip(net.filters, where)):
                g = np.zeros_like(net.filters[w])
                for j in range(w):
                    np.add.at(g[j], (xb[row, best + j], np.broadcast_to(k, best.shape)), back[:, n * FILTERS : (n + 1) * FILTERS])
                grads.append(g)
            grads += [back.sum(axis=0), a.T @ p, p.sum(axis=0)]
            t += 1
            for q, g, mm, vv in zip(params, grads, m, v, strict=True):
                mm *= 0.9
                mm += 0.1 * g
                vv *= 0.999
                vv += 0.001 * g * g
                q -= rate * (mm / (1 - 0.9**t)) / (np.sqrt(vv / (1 - 0.999**t)) + 1e-8)
    return net


# First and last code points of some scripts beyond Latin, for windows that are in no learned language.
SCRIPTS = ((0x370, 0x3FF), (0x400, 0x4FF), (0x530, 0x58F), (0x590, 0x5FF), (0x600, 0x6FF), (0x900, 0x97F), (0xE00, 0xE7F), (0x10A0, 0x10FF), (0x1200, 0x137F), (0x3040, 0x30FF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3))


def no_language(x: np.ndarray, seed: int = 2) -> np.ndarray:
    """Windows without a language, one from each given window: its letters in random order, random letters in their place, or words of another script."""
    rng, out = np.random.default_rng(seed), x.copy()
    for i, row in enumerate(out):
        letters = np.flatnonzero((row >= 97) & (row <= 122))
        if i % 3 == 0:
            row[letters] = rng.permutation(row[letters])
        elif i % 3 == 1:
            row[letters] = rng.integers(97, 123, len(letters))
        else:
            low, high = SCRIPTS[int(rng.integers(len(SCRIPTS)))]
            words = ["".join(c for c in map(chr, rng.integers(low, high + 1, int(rng.integers(1, 11)))) if c.isalpha()) for _ in range(60)]
            data = " ".join(words).lower().encode()[: len(row)]
            row[:] = 0
            row[: len(data)] = np.frombuffer(data, np.uint8)
    return out


def with_codes(x: np.ndarray, seed: int = 3) -> np.ndarray:
    """Copies of windows in which a key, number or name of random letters and digits covers some bytes: that alone makes no text foreign."""
    rng, out = np.random.default_rng(seed), x.copy()
    signs = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8)
    for row in out:
        n, used = int(rng.integers(8, 41)), max(1, int((row != 0).sum()))
        at = int(rng.integers(0, max(1, used - n)))
        row[at : at + n] = rng.choice(signs, len(row[at : at + n]))
    return out


def train(docs: DataFrame, parts: int = 3, held_part: int = 1, texts: int = 800, windows: int = 4, unknown: bool = False) -> Network | None:
    """Learn from text and lang of documents whose crc32(doc_id) modulo `parts` is not `held_part`.

    The sample is bounded: of each language about `texts` texts, picked by a hash of doc_id, with up to `windows` windows
    spread over each text. None without a labelled text. With `unknown` the network also learns, from a window made of
    every fourth one of the sample, what is in no language, and from every third that a code in a text is no sign of it.
    """
    known = docs.select(C("doc_id").cast("bigint").alias("doc_id"), C("text").cast("string").alias("text"), C("lang").cast("string").alias("lang"))
    known = known.where(~in_fold("doc_id", parts, held_part) & C("doc_id").isNotNull() & C("lang").isNotNull() & F.coalesce(F.length("text") > 0, F.lit(False)))
    share = known.groupBy("lang").agg((F.lit(1_000_003.0) * texts / F.count("*")).alias("share"))

    def pick(rows):
        for pdf in rows:
            out = []
            for doc, text, lang in zip(pdf["doc_id"], pdf["text"], pdf["lang"]):
                x = windows_of(text)
                for k in np.unique(np.linspace(0, len(x) - 1, windows).astype(int)):
                    out.append((doc, int(k), lang, x[k].tobytes()))
            yield pd.DataFrame(out, columns=["doc_id", "k", "lang", "window"])

    chosen = known.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < C("share"))  # a row for each language
    sample = cut(chosen.select("doc_id", "text", "lang").mapInPandas(pick, "doc_id bigint, k int, lang string, window binary")).orderBy("doc_id", "k", "window").collect()
    if not sample:
        return None
    langs = sorted({r["lang"] for r in sample})
    x = np.stack([np.frombuffer(r["window"], np.uint8) for r in sample])
    y = np.array([langs.index(r["lang"]) for r in sample])
    if unknown:
        none = no_language(x[::4])
        x, y, langs = np.concatenate([x, with_codes(x[::3]), none]), np.concatenate([y, y[::3], np.full(len(none), len(langs))]), [*langs, UNKNOWN]
    return fit(x, y, langs)


def prediction_column(docs: DataFrame, network: Network | None):
    shared = docs.sparkSession.sparkContext.broadcast(network)  # some hundred KB, whatever the data

    @F.pandas_udf("lang_pred string, score double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        net = shared.value
        tables = net.tables() if net else None
        for text in batches:
            out = [net.predict(t, tables) if net else (UNKNOWN, 0.0) for t in text]
            yield pd.DataFrame(out, columns=["lang_pred", "score"])

    return of


def identify(docs: DataFrame, parts: int = 3, held_part: int = 1, **bounds) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every whole text; lang, source and doc_id play no part in a prediction.

    A null text, or one without a letter, is `und` with score 0; so is every text if no row is labelled. Repeated rows get
    the same answer; a null doc_id is kept and not held out; an empty table gives an empty result; other columns are
    ignored.
    """
    of = prediction_column(docs, train(docs, parts, held_part, **bounds))
    rows = docs.select(C("doc_id").cast("bigint").alias("doc_id"), in_fold("doc_id", parts, held_part).alias("held_out"), of(C("text").cast("string")).alias("p"))
    return rows.select("doc_id", "held_out", "p.lang_pred", "p.score")


def drop_unknown(docs: DataFrame, limit: float = 0.6, least_chars: int = 128, **bounds) -> DataFrame:
    """The documents in a learned language, with the columns they came with.

    Null texts and texts without a letter go, and so do texts of which the network says with a probability above `limit`
    that they are in no language: letters without the order of words, or another script. A text under `least_chars`
    characters says too little for that and stays. Without any labelled text all go; repeated rows share their fate; an
    empty table stays empty.
    """
    p = prediction_column(docs, train(docs, unknown=True, **bounds))(C("text").cast("string"))
    unsure = (p["score"] <= limit) | (F.length("text") < least_chars)
    return docs.where((p["lang_pred"] != UNKNOWN) | ((p["score"] > 0) & unsure))
