"""Packing of tokenised documents into sequences of a fixed length.

Pieces are cut and counted on Spark; the driver only sees the histogram of piece lengths, which has at most `size` rows.
On it the configuration linear program (which multisets of lengths fill a sequence, and how often each is used) is
solved by multiplicative weights: a length's price falls as it gets covered, and the next configurations are the best
fillings under the prices, a knapsack solved by dynamic programming. Uses are rounded down to whole numbers at every step
and the rest is priced again; what fits no configuration any more is placed best fit, longest first. The plan maps the
k-th piece of a length to its sequence and offset, so every piece is placed on its own, wherever it lies.
"""

from __future__ import annotations

import functools
import json
import zlib
from array import array
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ..session import cut
from .bpe import BLOCK, WORDS, byte_names
from .common import Learned, encode_column, parts, pick, pieces_of

MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # ASCII marks without the apostrophe, which may begin a word
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, nth bigint"


CACHED = 250_000  # words of a generation; two generations of keys, ids and their overhead take about 100 MB


class LibraryEncoder:
    """The library's ids, chunk by chunk: 32-bit integers or, with `kind` "H", 16-bit ones.

    With `keep_space` (byte-level) texts are cut before spaces, and a chunk after the first is encoded with its space; a text
    in which a cut would part what belongs together (a space before more white space or a special token) goes to the
    library whole. Without, texts are cut at white space, which that kind of tokenizer drops. Each distinct chunk of a block
    of texts is encoded once. A chunk of Latin letters, with or without marks at its end, is one word, or a word and a run of
    marks, to any of these tokenizers: words go to the library's model as they are and are remembered for later blocks. Other byte-level chunks go
    there word by word, everything else through the whole chain.
    """

    def __init__(self, path: str, keep_space: bool, kind: str = "I", cached: int = CACHED):
        self.tokenizer, self.kind, self.keep_space = Tokenizer.from_file(path), kind, keep_space
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        self.lower = "Lowercase" in [n.get("type") for n in ((data.get("normalizer") or {}).get("normalizers") or [])]
        self.tokens_of, self.byte_name = self.tokenizer.model.tokenize, {b: c for c, b in byte_names().items()}
        self.lead = self.byte_name[32] if keep_space else ""
        self.words = Learned(self.word, cached)
        self.pattern = regex.compile(WORDS)

    @property
    def limit(self) -> int:
        """Words of a generation."""
        return self.words.limit

    @limit.setter
    def limit(self, value: int) -> None:
        self.words.limit = value

    def word(self, word: str) -> bytes:
        return array(self.kind, [t.id for t in self.tokens_of(word)]).tobytes()

    def whole(self, text: str) -> bytes:
        return array(self.kind, self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def letters(self, chunk: str) -> bytes | None:
        """Ids of Latin letters with a run of ASCII marks behind them; None for any other chunk."""
        body = chunk.rstrip(MARKS)
        if not body.isalpha():
            return None
        if body.isascii():
            if self.lower and not body.islower():
                return None
            word = self.lead + body
        elif max(body) < "\u0250" and (not self.lower or body.lower() == body):
            word = self.lead + body.encode().decode("latin-1").translate(self.byte_name)
        else:
            return None
        return self.words[word] if len(body) == len(chunk) else self.words[word] + self.words[chunk[len(body) :]]

    def head(self, text: str) -> bytes:
        """A byte-level chunk as it stands: its words, each to the model; one with a special token goes to the library."""
        if any(s in text for s in self.special):
            return self.whole(text)
        words, name = self.words, self.byte_name
        return b"".join([words[w.encode().decode("latin-1").translate(name)] for w in self.pattern.findall(text)])

    def spaced(self, chunk: str) -> bytes | None:
        """A chunk after a space; None if a text must not be cut before it."""
        if not chunk or chunk[0].isspace() or chunk.startswith(self.special):
            return None
        return self.letters(chunk) or self.head(" " + chunk)

    def plain(self, chunk: str) -> bytes:
        return (self.letters(chunk) or self.whole(chunk)) if chunk else b""

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        kind = f"<u{array(self.kind).itemsize}"
        if self.keep_space:
            return encode_column(texts, lambda c: [self.spaced(x) for x in c], lambda c: [self.head(x) for x in c], self.whole, kind=kind)
        return encode_column(texts, lambda c: [self.plain(x) for x in c], lower=self.lower, kind=kind)

    def encode(self, texts: list[str]) -> list[bytes]:
        return pieces_of(*self.encode_column(pa.array(texts, pa.string())))


@functools.lru_cache(maxsize=1)
def encoder_of(path: str, keep_space: bool, kind: str = "I") -> LibraryEncoder:
    """One per worker process, so that what it has learned serves later tasks."""
    return LibraryEncoder(path, keep_space, kind)


def cut_pieces(docs: DataFrame, vocabulary: str, size: int, end_id: int) -> DataFrame:
    """Pieces of every document with `part` and `nth`: the piece is the nth of its length in its part of the table."""

    def run(batches):
        encoder, part = encoder_of(vocabulary, True), TaskContext.get().partitionId()
        end, nth = end_id.to_bytes(4, "little"), np.zeros(size + 1, np.int64)
        for batch in parts(batches, BLOCK):
            rows = []
            ids, ends = encoder.encode_column(batch.column("text"))
            whole, ends = memoryview(ids.tobytes()), ends.tolist()
            for doc, i, j in zip(batch.column("doc_id").to_pylist(), ends[:-1], ends[1:], strict=True):
                data = bytes(whole[4 * i : 4 * j]) + end
                n, at, piece = j - i + 1, 0, 0
                while at < n:
                    length = (n - at) % size or size if at == 0 and n > size else min(size, n - at)
                    rows.append((doc, piece, at, length, zlib.crc32(data[4 * at : 4 * (at + length)]), part, int(nth[length])))
                    nth[length] += 1
                    at, piece = at + length, piece + 1
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in PIECES.split(", ")])

    return pick(docs, doc_id="bigint", text="string").mapInArrow(run, PIECES)


class Pricing:
    """Bounded knapsack by dynamic programming: the most valuable filling of every room, none of a length more often than it is left."""

    def __init__(self, lengths: list[int], gain: np.ndarray, left: list[int], size: int):
        self.lengths, n = lengths, len(lengths)
        best, took, last = np.zeros(size + 1), np.zeros((n, size + 1), np.int16), np.full((n + 1, size + 1), -1, np.int16)
        for j, (length, value, many) in enumerate(zip(lengths, gain.tolist(), left, strict=True)):
            last[j + 1], before = last[j], best
            for c in range(1, min(many, size // length) + 1):
                new = before[: size + 1 - c * length] + c * value
                better = new > best[c * length :]
                if not better.any():
                    break
                best = best.copy() if best is before else best
                best[c * length :][better] = new[better]
                took[j, c * length :][better], last[j + 1, c * length :][better] = c, j
        self.took, self.last = took.tolist(), last.tolist()  # copies of a length, and the greatest length in a filling of those up to it

    def filling(self, room: int) -> dict[int, int]:
        """The best filling: index of each length and how often it is in."""
        out, j = {}, len(self.lengths)
        while (k := self.last[j][room]) >= 0:
            out[k] = self.took[k][room]
            room, j = room - out[k] * self.lengths[k], k
        return out

    def around(self, first: int, size: int) -> dict[int, int]:
        """The best configuration that holds the length `first`."""
        out = self.filling(size - self.lengths[first])
        out[first] = out.get(first, 0) + 1
        return out


def best_filling(lengths: np.ndarray, gain: np.ndarray, size: int) -> dict[int, int]:
    """The multiset of lengths of at most `size` in all with the greatest sum of gains, any length as often as it fits."""
    return Pricing(lengths.tolist(), gain, [size] * len(lengths), size).filling(size)


@dataclass
class Plan:
    """For each row: pieces first <= k < last of a length go, `each` to a sequence, to sequences from `base` on, at `offset`."""

    size: int
    sequences: int = 0
    rows: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)
    placed: dict[int, int] = field(default_factory=dict)
    by_program: int = 0  # short pieces that the program placed

    def copy(self) -> Plan:
        return Plan(self.size, self.sequences, list(self.rows), dict(self.placed))

    def use(self, fill: list[tuple[int, int]], times: int) -> None:
        offset = 0
        for length, each in fill:
            first = self.placed.get(length, 0)
            self.placed[length] = first + each * times
            self.rows.append((length, first, first + each * times, each, self.sequences, offset))
            offset += length * each
        self.sequences += times

    def arrays(self):
        return [np.array(c, np.int64) for c in zip(*sorted(self.rows), strict=True)] if self.rows else [np.zeros(0, np.int64)] * 6


def program(plan: Plan, rest: dict[int, int], steps: int = 12, rate: float = 0.002, tilt: float = 0.1) -> dict[int, int]:
    """Cover the lengths by configurations; what fits none any more is given back.

    Multiplicative weights: the price of a token starts a little higher in long pieces, which keeps the short ones that fit
    anywhere for later, and falls by exp(-rate x share covered) as a length gets covered. A phase prices once, by one knapsack, and reads off
    the best configuration around each length; it is used as often, in whole numbers, as covers a `steps`-th of the
    scarcest length in it. Then the rest is priced anew.
    """
    need = dict(rest)
    while rest:
        lengths = sorted(rest)
        sizes, many = np.array(lengths, float), [rest[n] for n in lengths]
        share = np.array(many) / np.array([need[n] for n in lengths])
        pricing = Pricing(lengths, sizes * (1 + tilt * sizes / plan.size) * np.exp(rate * (share - 1)), many, plan.size)
        quota = [-(-need[n] // steps) for n in lengths]
        for first in range(len(lengths) - 1, -1, -1):
            if quota[first] <= 0 or not many[first]:
                continue
            fill = pricing.around(first, plan.size)
            times = min(many[k] // a for k, a in fill.items())
            if times:
                times = min(times, max(1, min(quota[k] // a for k, a in fill.items())))
                plan.use([(lengths[k], a) for k, a in fill.items()], times)
                for k, a in fill.items():
                    many[k] -= a * times
                    quota[k] -= a * times
        left = {n: c for n, c in zip(lengths, many, strict=True) if c}
        if left == rest:
            break
        rest = left
    return rest


def solve(histogram: dict[int, int], size: int) -> Plan:
    """A plan for the histogram. The number of its rows is bounded by `size` and the phases, which grow with the logarithm of the counts.

    Best fit takes what the program left. Best fit for everything replaces both only where it needs fewer sequences.
    """
    plan, rest = Plan(size), {n: c for n, c in histogram.items() if c and n < size}
    if histogram.get(size):
        plan.use([(size, 1)], histogram[size])
    plain = plan.copy()
    left = program(plan, rest)
    plan.by_program = sum(rest.values()) - sum(left.values())
    best_fit(plan, left)
    best_fit(plain, rest)
    return min(plan, plain, key=lambda p: p.sequences)


def best_fit(plan: Plan, rest: dict[int, int]) -> None:
    """Longest first, each into the fullest sequence that still has room; runs of equal sequences are handled at once."""
    groups: list[dict[tuple[tuple[int, int], ...], int]] = [{} for _ in range(plan.size + 1)]  # by room: filling -> how many
    rooms = np.zeros(plan.size + 1, np.int64)
    for length in sorted(rest, reverse=True):
        left = rest[length]
        while left:
            fit = np.flatnonzero(rooms[length:])
            if len(fit):
                room = length + int(fit[0])
                fill, many = next(iter(groups[room].items()))
                each = min(room // length, left)
                times = min(many, left // each)
                groups[room].pop(fill)
                if many > times:
                    groups[room][fill] = many - times
            else:
                room, fill = plan.size, ()
                each = min(room // length, left)
                times = left // each
                rooms[room] += times
            rooms[room] -= times
            new, now = room - length * each, (*fill, (length, each))
            groups[new][now] = groups[new].get(now, 0) + times
            rooms[new] += times
            left -= each * times
    for group in groups:
        for fill, many in group.items():
            plan.use(list(fill), many)


def pack(docs: DataFrame, vocabulary: str, size: int = 1024, end_id: int = 2) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset.

    A null text counts as empty, so it is one piece that holds the end id alone; a text of any length is encoded whole by one
    task and cut into pieces. Repeated rows are packed each on their
    own, ties between pieces of a length are broken by their place in the table, a null doc_id is kept, an empty table
    gives an empty result, and other columns are ignored.
    """
    pieces = cut(cut_pieces(docs, vocabulary, size, end_id))
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = docs.sparkSession.sparkContext.broadcast(solve(histogram, size).arrays())
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def place(batches):
        length, first, _, each, base, offset = plan.value
        span = int(first.max(initial=0)) + 1
        keys = length * span + first
        for batch in batches:
            n, k = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            row = np.searchsorted(keys, n * span + np.minimum(k, span - 1), side="right") - 1
            nth = k - first[row]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(base[row] + nth // each[row]), pa.array(offset[row] + nth % each[row] * n)], [*names, "sequence_id", "offset"])

    ranked = pieces.join(bases, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
