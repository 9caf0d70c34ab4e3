"""Maximal periodic runs of words, by recompression.

The words of a block of documents are numbered and laid side by side, longest document first, parted by symbols that
occur once. The sequence is compressed in turns: a stretch of equal symbols becomes one symbol (block step), and of two
neighbours, the first from one half of the alphabet and the second from the other, a pair becomes one symbol (pair step).
Equal stretches are cut alike but for their edges, so two places are compared by climbing from level to level while their
symbols agree and descending again where they differ: a longest common extension, in either direction, reads a few
symbols a level and no word twice.

A run of period q that is at least four periods long holds three neighbouring points of the grid 0, q, 2q, ... at which a
word equals the one q further on. Only such points are extended; the sum of all grids is n/1 + n/2 + n/3 + ... points.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts, pick

C = F.col
FOUND = "doc_id bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
POWERS = 4  # a run holds at least so many periods
LEAST = 6  # and words
QUERIES_AT_ONCE = 1 << 16


class Grammar:
    """Levels of a sequence of numbers that is shortened by block and pair steps until no symbol occurs twice.

    symbols[h] is the sequence at level h; first[h][k] the place, one level below, of the first part of symbol k (with one
    entry beyond the last); up[h][k] the symbol one level above that holds symbol k; block[h] whether level h came from a
    block step. The first and the last number must occur once.
    """

    def __init__(self, numbers: np.ndarray):
        self.symbols, self.first, self.up, self.block = [numbers], [None], [], [False]
        self.ids, turn = int(numbers.max()) + 1, 0
        while int(np.bincount(self.symbols[-1]).max()) > 1:
            self._blocks()
            self._pairs(turn)
            turn += 1

    def _push(self, head: np.ndarray, symbols: np.ndarray, block: bool) -> None:
        n = len(self.symbols[-1])
        up = np.zeros(n, np.int32)
        up[head[1:]] = 1
        self.up.append(np.cumsum(up, dtype=np.int32))
        self.first.append(np.append(head, n).astype(np.int32))
        self.symbols.append(symbols)
        self.block.append(block)

    def _named(self, symbols: np.ndarray, at: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Symbols in which those at `at` become new ones, named by what they were and by `second`."""
        keys, name = np.unique(symbols[at].astype(np.int64) * (int(second.max()) + 1) + second, return_inverse=True)
        out = symbols.copy()
        out[at] = self.ids + name
        self.ids += len(keys)
        return out

    def _blocks(self) -> None:
        s = self.symbols[-1]
        head = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
        if len(head) == len(s):
            return
        length = np.diff(np.append(head, len(s)))
        at = np.flatnonzero(length > 1)
        self._push(head, self._named(s[head], at, length[at]), True)

    def _pairs(self, turn: int) -> None:
        s = self.symbols[-1]
        with np.errstate(over="ignore"):  # a coin for each symbol, another one each turn
            mixed = (s.astype(np.uint64) + np.uint64(turn * 0x632BE5AB + 1)) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        coin = (mixed >> np.uint64(40)) & np.uint64(1) == 1
        one, two = coin[:-1] & ~coin[1:], ~coin[:-1] & coin[1:]
        k = np.flatnonzero(one if np.count_nonzero(one) >= np.count_nonzero(two) else two)
        if not len(k):
            return
        keep = np.ones(len(s), bool)
        keep[k + 1] = False
        head = np.flatnonzero(keep)
        self._push(head, self._named(s[head], k - np.arange(len(k)), s[k + 1].astype(np.int64)), False)

    def extend(self, a: np.ndarray, b: np.ndarray, back: bool = False) -> np.ndarray:
        """How many symbols agree from a and b on, leftwards (a and b included) with `back`; a and b differ."""
        d, x, y = (-1 if back else 1), a.astype(np.int64), b.astype(np.int64)
        top, live = np.full(len(x), len(self.up), np.int64), np.arange(len(x))
        for h, up in enumerate(self.up):
            s, first, u, v = self.symbols[h], self.first[h + 1], x[live], y[live]
            same = s[u] == s[v]
            top[live[~same]] = h
            live, u, v = live[same], u[same], v[same]
            if not len(live):
                break
            p, q = up[u].astype(np.int64), up[v].astype(np.int64)
            left, right = (u - first[p] + 1, v - first[q] + 1) if back else (first[p + 1] - u, first[q + 1] - v)
            edge = (first[p + 1] - 1 == u) & (first[q + 1] - 1 == v) if back else (first[p] == u) & (first[q] == v)
            stays = ~edge & (left != right)  # in blocks of which different parts are left: they differ after the smaller part
            step = d * np.minimum(left, right)[stays]
            x[live[stays]], y[live[stays]], top[live[stays]] = u[stays] + step, v[stays] + step, h
            goes = ~stays
            live, beside = live[goes], d * ~edge[goes]
            x[live], y[live] = p[goes] + beside, q[goes] + beside
        order = np.argsort(-top, kind="stable")
        x, y, many = x[order], y[order], np.cumsum(np.bincount(top, minlength=len(self.up) + 1)[::-1])[::-1]
        for h in range(len(self.up), 0, -1):
            n, s, first = int(many[h]), self.symbols[h - 1], self.first[h]
            if not n:
                continue
            u, v = x[:n], y[:n]  # symbols of level h that differ
            p, q = (first[u + 1] - 1, first[v + 1] - 1) if back else (first[u], first[v])
            agreed = np.minimum(first[u + 1] - first[u], first[v + 1] - first[v]) if self.block[h] else 1
            step = d * np.where(s[p] == s[q], agreed, 0)
            x[:n], y[:n] = p + step, q + step
        out = np.empty_like(x)
        out[order] = x
        return np.abs(out - a)


def grid_hits(numbers: np.ndarray, period: int, stop: int) -> np.ndarray:
    """Points of the period's grid from which three neighbouring points each equal the next one."""
    x = numbers[:stop:period]
    equal = x[1:] == x[:-1]
    return np.flatnonzero(equal[2:] & equal[1:-1] & equal[:-2]) * period


def maximal_runs(numbers: np.ndarray, sizes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Rows (first, last + 1, smallest period) of all runs; documents of the given falling sizes begin at `starts`."""
    found = [np.zeros((0, 3), np.int64)]
    grammar, longest, low = None, int(sizes.max(initial=0)) // POWERS, 1
    while low <= longest:
        at, period = [], []
        for q in range(low, min(2 * low, longest + 1)):  # no period of a band is a multiple of another one
            n = int(np.searchsorted(-sizes, -max(LEAST, POWERS * q), side="right"))  # documents long enough
            if n:
                hits = grid_hits(numbers, q, int(starts[n - 1] + sizes[n - 1]))
                at.append(hits)
                period.append(np.full(len(hits), q, np.int64))
        low *= 2
        a, q = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (at, period))
        known = np.concatenate(found)
        known = known[np.argsort(known[:, 0], kind="stable")]
        for back in (1, 2):  # inside a run whose period divides q, q gives the same run again
            k = np.searchsorted(known[:, 0], a, side="right") - back
            fresh = k < 0
            first, last, p = known[np.maximum(k, 0)].T if len(known) else (a, a, q)
            fresh |= (a < first) | (a + q >= last) | (q % p != 0)
            a, q = a[fresh], q[fresh]
        if len(a) and grammar is None:
            grammar = Grammar(numbers)
        for i in range(0, len(a), QUERIES_AT_ONCE):
            u, p = a[i : i + QUERIES_AT_ONCE], q[i : i + QUERIES_AT_ONCE]
            last, first = u + p + grammar.extend(u, u + p), u - grammar.extend(u - 1, u + p - 1, back=True)
            runs = np.stack([first, last, p], axis=1)
            found.append(np.unique(runs[last - first >= np.maximum(LEAST, POWERS * p)], axis=0))
    runs = np.unique(np.concatenate(found), axis=0)
    return runs[np.append(True, (runs[1:, :2] != runs[:-1, :2]).any(axis=1))] if len(runs) else runs


class _Numbers(dict):
    def __missing__(self, word):
        n = self[word] = len(self)
        return n


def runs_of(documents: list[list[bytes]]) -> list[np.ndarray]:
    """For each list of words the rows (start, length, smallest period) of its runs, by start and period."""
    order = sorted(range(len(documents)), key=lambda i: -len(documents[i]))
    sizes = np.array([len(documents[i]) for i in order], np.int64)
    starts = np.cumsum(sizes + 1) - sizes
    numbers, own = np.empty(int(sizes.sum()) + len(sizes) + 1, np.int32), _Numbers()
    for i, at, n in zip(order, starts.tolist(), sizes.tolist(), strict=True):
        numbers[at : at + n] = np.fromiter(map(own.__getitem__, documents[i]), np.int32, n)
    edges = np.append(starts - 1, len(numbers) - 1)
    numbers[edges] = len(own) + np.arange(len(edges))
    runs = maximal_runs(numbers, sizes, starts)
    where = np.searchsorted(starts, runs[:, 0], side="right") - 1
    rows = np.stack([runs[:, 0] - starts[where], runs[:, 1] - runs[:, 0], runs[:, 2]], axis=1)
    rows, where = rows[(o := np.lexsort((rows[:, 2], rows[:, 0], where)))], where[o]
    cuts = np.searchsorted(where, np.arange(len(order) + 1))
    out: list[np.ndarray] = [rows[:0]] * len(documents)
    for k, i in enumerate(order):
        out[i] = rows[cuts[k] : cuts[k + 1]]
    return out


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words without those that a run holds after its first period, joined by one space."""
    if len(runs):
        depth = np.zeros(len(words) + 1, np.int64)
        np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
        np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]
    return b" ".join(words)


def find_runs(docs: DataFrame, rewrite=None) -> DataFrame:
    """doc_id, runs (structs of start, length and period, by start and period) and collapsed of every text.

    Words are parted by ASCII white space and numbered from 0; a run is a maximal stretch of smallest period q with at
    least max(6, 4q) words. `rewrite(doc_id, words)` may replace the words of a document first. A null or empty text has
    no words and no runs; a text of any length is handled whole, in work space that follows it; repeated rows and null
    doc_ids give a row each; an empty table gives an empty result; other columns are ignored.
    """

    def run(batches):
        for batch in parts(batches):
            ids = batch.column("doc_id").to_pylist()
            words = [(t or b"").split() for t in batch.column("text").cast(pa.binary()).to_pylist()]
            if rewrite:
                words = [rewrite(i, w) for i, w in zip(ids, words, strict=True)]
            runs = runs_of(words)
            rows = np.concatenate(runs)
            fields = pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(3)], ["start", "length", "period"])
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, runs)]).astype(np.int32)), fields)
            texts = pa.array([collapsed(w, r) for w, r in zip(words, runs, strict=True)], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), lists, texts], ["doc_id", "runs", "collapsed"])

    return pick(docs, doc_id="bigint", text="string").mapInArrow(run, FOUND)


def periodic_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's planted repetition: every tenth document, by crc32 of its id, ends in a repeated stretch."""
    h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def run_digests(docs: DataFrame, rewrite=periodic_tail) -> DataFrame:
    """One row per document: number of runs, the run of greatest exponent, and digests of all runs and of the collapsed text."""
    better = lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    kind = "struct<start:bigint,length:bigint,period:bigint>"
    found = find_runs(docs, rewrite).withColumn("best", F.aggregate("runs", F.lit(None).cast(kind), better))
    line = lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * C("best.length") / C("best.period")).cast("bigint").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2(C("collapsed"), 256).alias("collapsed_sha256"))
