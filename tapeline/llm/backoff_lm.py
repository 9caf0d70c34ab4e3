"""Scoring of texts by a weighted backoff automaton over smoothed word bigrams.

The model. With c counts in the training texts, N their sum, V the distinct tokens and p0(w) = (c(w)+1) / (N+V+1),
p(w | h) = (c(h, w) + mu p0(w)) / (c(h) + mu): a Dirichlet prior around the unigrams, which sums to one over the V tokens
and one unknown. As an automaton: a state for the start and for each word; an arc h -> w of weight log10 p(w | h) for each
pair in the training texts; at each state a failure arc of weight log10(mu / (c(h) + mu)) to the root, whose arcs weigh
log10 p0(w). After reading w the state is that of w.

The work. Texts become blocks of word numbers once. A block sends each distinct word and pair, as a 64-bit hash with its
count in training texts, to one of many buckets; a bucket adds up and answers each block in the order asked. So a block
gets the part of the automaton that its texts can reach, of a size bound by the block, and walks its texts through it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import in_fold, parts

BLOCK_CHARS = 6 << 20
BUCKET_TOKENS = 1_000_000
BLOCKS = "block bigint, doc_ids array<bigint>, held array<boolean>, sizes array<bigint>, words binary, hashes binary"
ASKED = "bucket bigint, block bigint, kind int, hashes binary, counts binary"
TOLD = "block bigint, bucket bigint, kind int, totals binary, types bigint, mass bigint"


def _batch(schema: str, columns) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_())}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def small(numbers: np.ndarray) -> bytes:
    """Small numbers take few bytes on their way."""
    return zstandard.compress(np.ascontiguousarray(numbers, "<u4").tobytes(), 1)


def packed_totals(totals: np.ndarray) -> bytes:
    """Totals of any size."""
    return zstandard.compress(np.ascontiguousarray(totals, "<i8").tobytes(), 1)


def totals_of(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), "<i8")


def numbers_of(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), "<u4")


class _Numbers(dict):
    def __missing__(self, word):
        n = self[word] = len(self)
        return n


def blocks_of(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text, held) as blocks: words numbered within the block, and the hash of each number's word."""

    def run(batches):
        at = TaskContext.get().partitionId() << 32
        for batch in parts(batches, BLOCK_CHARS):
            numbers, words = _Numbers(), []
            for text in batch.column("text"):
                split = text.as_py().encode().lower().split()
                words.append(np.fromiter(map(numbers.__getitem__, split), "<u4", len(split)))
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, numbers), np.uint64, len(numbers))
            ids, held = batch.column("doc_id").to_pylist(), batch.column("held").to_pylist()
            yield _batch(BLOCKS, [[at], [ids], [held], [[len(w) for w in words]], [small(np.concatenate(words))], [hashes.tobytes()]])
            at += 1

    return docs.mapInArrow(run, BLOCKS)


class Block:
    """A block's texts as one sequence of symbols: word numbers, then `end` after each text; `start` is the state before each."""

    def __init__(self, sizes: list[int], held: list[bool], words: bytes, hashes: bytes):
        own = np.frombuffer(hashes, "<u8")
        self.start, self.end = len(own), len(own) + 1
        self.hashes = np.concatenate([own, np.array([0x5354415254, 0x454E44], np.uint64)])  # two fixed stand-ins
        size = np.array(sizes, np.int64)
        self.last = np.cumsum(size + 1) - 1  # places of the ends
        self.first = self.last - size
        self.symbols = np.full(int(self.last[-1]) + 1, self.end, np.int64)
        inside = np.ones(len(self.symbols), bool)
        inside[self.last] = False
        self.symbols[inside] = numbers_of(words)
        self.states = np.empty_like(self.symbols)
        self.states[1:] = self.symbols[:-1]
        self.states[self.first] = self.start
        self.training = np.repeat(~np.array(held, bool), size + 1)
        pairs, self.arc = np.unique(self.states * (self.end + 1) + self.symbols, return_inverse=True)
        self.arc_state, self.arc_symbol = pairs // (self.end + 1), pairs % (self.end + 1)

    def asked(self):
        """Per kind: the hashes of words (0) and pairs (1), and their counts in the block's training texts."""
        with np.errstate(over="ignore"):
            h = self.hashes * np.uint64(0x9E3779B97F4A7C15)
            pair = (h[self.arc_state] ^ (h[self.arc_state] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + self.hashes[self.arc_symbol]
            pair = (pair ^ (pair >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
            pair ^= pair >> np.uint64(29)
        count = lambda x, n: np.bincount(x[self.training], minlength=n).astype("<u4")
        return (self.hashes, count(self.symbols, self.end + 1)), (pair, count(self.arc, len(pair)))


def dealt(hashes: np.ndarray, buckets: int):
    """The order that puts hashes by bucket, and each bucket's first and last place in it."""
    bucket = ((hashes >> np.uint64(7)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    found, first = np.unique(bucket[order], return_index=True)
    return order, list(zip(found.tolist(), first.tolist(), [*first.tolist()[1:], len(order)], strict=True))


def ask(blocks: DataFrame, buckets: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):  # a block is work enough at a time
                row = batch.slice(i, 1).to_pylist()[0]
                block = Block(row["sizes"], row["held"], row["words"], row["hashes"])
                for kind, (hashes, counts) in enumerate(block.asked()):
                    order, spread = dealt(hashes, buckets)
                    hashes, counts = hashes[order], counts[order]
                    yield _batch(ASKED, [[b for b, _, _ in spread], [row["block"]] * len(spread), [kind] * len(spread), [hashes[i:j].tobytes() for _, i, j in spread], [small(counts[i:j]) for _, i, j in spread]])

    return blocks.mapInArrow(run, ASKED)


def add_up(asked: pa.Table) -> pa.Table:
    """One bucket: the total of every hash, told to each block that asked, and how many hashes of each kind occur, and how often."""
    out = []
    for kind in (0, 1):
        rows = [r for r in asked.to_pylist() if r["kind"] == kind]
        if not rows:
            continue
        each = [numbers_of(r["counts"]) for r in rows]
        hashes, counts = np.concatenate([np.frombuffer(r["hashes"], "<u8") for r in rows]), np.concatenate(each)
        own, where = np.unique(hashes, return_inverse=True)
        totals = np.bincount(where, weights=counts, minlength=len(own)).astype(np.int64)
        told, ends = totals[where], np.cumsum([len(e) for e in each]).tolist()
        for k, (r, i, j) in enumerate(zip(rows, [0, *ends], ends)):
            out.append((r["block"], r["bucket"], kind, packed_totals(told[i:j]), 0 if k else int((totals > 0).sum()), 0 if k else int(totals.sum())))
    return pa.Table.from_batches([_batch(TOLD, list(zip(*out, strict=True)))])


class Automaton:
    """The part of the backoff automaton that a block can reach."""

    def __init__(self, block: Block, words: np.ndarray, pairs: np.ndarray, n: int, v: int, mu: float):
        root = np.log10((words + 1.0) / (n + v + 1.0))
        seen = words.astype(float)
        seen[block.start] = words[block.end]  # each training text starts once and ends once
        failure = np.log10(mu / (seen + mu))
        state, symbol = block.arc_state, block.arc_symbol
        arc = np.log10((pairs + mu * 10.0 ** root[symbol]) / (seen[state] + mu))
        self.weight = np.where(pairs > 0, arc, failure[state] + root[symbol])
        self.root = root

    def walk(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of every text, by the automaton and by its root alone: weights along the path, added up left to right."""
        return np.add.reduceat(self.weight[block.arc], block.first), np.add.reduceat(self.root[block.symbols], block.first)


SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def score(docs: DataFrame, parts: int = 7, held_part: int = 2, mu: float = 300.0) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every text.

    The model learns from the texts whose crc32(doc_id) modulo `parts` is not `held_part`; a null doc_id counts as one of
    them. A null text counts as empty: its end alone. Repeated rows count and are scored each; an empty table gives an
    empty result; other columns are ignored. Words are told apart by 64-bit hashes.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), in_fold("doc_id", parts, held_part).alias("held"))
    blocks = cut(blocks_of(rows))
    tokens = blocks.agg(F.coalesce(F.sum(F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x + 1)), F.lit(0)).alias("n")).first()["n"]
    buckets = max(1, -(-tokens // BUCKET_TOKENS))
    told = cut(ask(blocks, buckets).groupBy("bucket").applyInArrow(add_up, TOLD))
    n, v = (int(x or 0) for x in told.where("kind = 0").agg(F.sum("mass"), F.sum("types")).first())

    def walk(block_rows: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for row in block_rows.to_pylist():
            block, totals = Block(row["sizes"], row["held"], row["words"], row["hashes"]), []
            by_kind = {k: sorted((a for a in answers.to_pylist() if a["kind"] == k), key=lambda a: a["bucket"]) for k in (0, 1)}
            for kind, (hashes, _) in enumerate(block.asked()):
                order, _ = dealt(hashes, buckets)
                total = np.empty(len(order), np.int64)
                total[order] = np.concatenate([totals_of(a["totals"]) for a in by_kind[kind]])
                totals.append(total)
            model, base = Automaton(block, *totals, n, v, mu).walk(block)
            known = np.add.reduceat((totals[0][block.symbols] > 0).astype(np.int64), block.first)
            size = block.last - block.first + 1
            out.append(_batch(SCORES, [row["doc_ids"], row["held"], size, known, np.full(len(size), n), base, model]))
        return pa.Table.from_batches(out, schema=_batch(SCORES, [[]] * 7).schema)

    return blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(walk, SCORES)


# The same model in SQL, for small tables.
ORACLE = """WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w,
    coalesce(xor(4294967295, list_reduce(list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT)),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))), 4294967295)) % 7 = 2, false) AS held_out,
    row_number() OVER () AS r FROM documents),
tok AS (SELECT r, held_out, unnest(list_append(w, chr(10))) AS t, unnest(list_prepend(chr(13), w)) AS h FROM docs),
uni AS (SELECT t, count(*) AS c FROM tok WHERE NOT held_out GROUP BY t),
tot AS (SELECT coalesce(sum(c), 0) AS n, count(*) AS v FROM uni),
big AS (SELECT h, t, count(*) AS c FROM tok WHERE NOT held_out GROUP BY h, t),
hist AS (SELECT h, count(*) AS c FROM tok WHERE NOT held_out GROUP BY h),
p AS (SELECT tok.r, uni.c AS known, (coalesce(uni.c, 0) + 1e0) / (tot.n + tot.v + 1) AS p0, coalesce(big.c, 0) AS j, coalesce(hist.c, 0) AS s
  FROM tok CROSS JOIN tot LEFT JOIN uni ON uni.t = tok.t LEFT JOIN hist ON hist.h = tok.h LEFT JOIN big ON big.h = tok.h AND big.t = tok.t),
s AS (SELECT r, count(*) AS n_tokens, count(known) AS n_known, sum(log10(p0)) AS base_score, sum(log10((j + {mu} * p0) / (s + {mu}))) AS score FROM p GROUP BY r)
SELECT doc_id, held_out, n_tokens, n_known, CAST(tot.n AS BIGINT) AS train_tokens, round(base_score, 6) AS base_score, round(score, 6) AS score
FROM docs JOIN s USING (r) CROSS JOIN tot"""
