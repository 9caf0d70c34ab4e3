"""Token ids in a binary format: canonical, length-limited Huffman codes in independent blocks.

Layout of a token file (a folder): `header` holds the code length of every id that occurs, which determines the
canonical code; `blocks` holds records of about 260,000 ids: shard and place in it, document ids and lengths, the
payload, and the bit offset of every 256th id. A record is read without any other, and its checkpoints are decoded side
by side with one table lookup per id. Records are ordered by shard and place, and documents in them by doc_id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ..session import cut
from .common import parts, pick
from .bpe import BLOCK
from .packing import encoder_of

STEP = 256  # ids between checkpoints
RECORD = 1 << 18  # ids after which a record is closed; a record holds whole documents
LIMIT = 16  # bits of the longest code, or more where ids outnumber the codes
BLOCKS = "shard int, seq bigint, start bigint, n_ids bigint, doc_ids array<bigint>, lengths array<bigint>, checkpoints array<bigint>, payload binary"


def kind_of(vocabulary: str) -> str:
    """Two bytes an id where all ids of the vocabulary fit."""
    return "<u2" if Tokenizer.from_file(vocabulary).get_vocab_size() <= 1 << 16 else "<u4"


def tokenise(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned integers of the kind of `kind_of`), the end id last."""
    width = int(kind_of(vocabulary)[-1])

    def run(batches):
        encoder = encoder_of(vocabulary, False, "H" if width == 2 else "I")
        for batch in parts(batches, BLOCK):
            ids, ends = encoder.encode_column(batch.column("text"))
            data = np.insert(ids, ends[1:], end_id).astype(f"<u{width}")  # the end id after each text
            offsets = ((ends + np.arange(len(ends))) * width).astype(np.int32)
            encoded = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), encoded], ["doc_id", "ids"])

    return pick(docs, doc_id="bigint", text="string").mapInArrow(run, "doc_id bigint, ids binary")


def counts_of(tokens: DataFrame, kind: str) -> dict[int, int]:
    """How often each id occurs: at most a row for each id of the vocabulary."""

    def run(batches):
        for batch in batches:
            n = np.bincount(np.frombuffer(b"".join(batch.column("ids").to_pylist()), kind))
            ids = np.flatnonzero(n)
            n = n[ids]
            yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), pa.array(n.astype(np.int64))], ["id", "n"])

    return {r["id"]: r["n"] for r in tokens.mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()}


def code_lengths(counts: dict[int, int], limit: int = LIMIT) -> dict[int, int]:
    """Optimal code lengths of at most `limit` bits: package-merge."""
    ids = sorted(counts, key=lambda i: (counts[i], i))
    n = len(ids)
    if n < 2:
        return dict.fromkeys(ids, 1)
    limit = max(limit, (n - 1).bit_length())
    leaf = np.array([counts[i] for i in ids], np.float64)
    levels, packages = [], np.zeros(0)
    for _ in range(limit):
        both = np.concatenate([leaf, packages])
        order = np.argsort(both, kind="stable")
        levels.append(order < n)
        both = both[order]
        packages = both[: len(both) // 2 * 2].reshape(-1, 2).sum(axis=1)
    length, take = np.zeros(n, np.int64), 2 * n - 2
    for is_leaf in reversed(levels):
        leaves = int(is_leaf[:take].sum())
        length[:leaves] += 1
        take = 2 * (take - leaves)
    return dict(zip(ids, length.tolist(), strict=True))


class Code:
    """The canonical code of given lengths, with its tables for encoding and decoding."""

    def __init__(self, lengths: dict[int, int]):
        order = sorted(lengths, key=lambda i: (lengths[i], i))
        self.width = max(lengths.values(), default=1)
        self.bits, self.codes = (np.zeros(max(order, default=0) + 1, kind) for kind in (np.int64, np.uint64))
        self.symbol, self.length = np.zeros(1 << self.width, "<u4"), np.ones(1 << self.width, np.uint8)
        code = before = 0
        for i in order:
            n = lengths[i]
            code <<= n - before
            before = n
            self.bits[i], self.codes[i] = n, code
            at, span = code << self.width - n, 1 << self.width - n
            self.symbol[at : at + span], self.length[at : at + span] = i, n
            code += 1

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Payload, most significant bit first, and the bit offset of every STEP-th id."""
        bits = self.bits[ids]
        end = np.cumsum(bits)
        at = end - bits
        word = at >> 5
        # each code lies in the 64 bits that start at the 32-bit word of its first bit
        placed = self.codes[ids] << (64 - (at & 31) - bits).astype(np.uint64)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        both, word = np.bitwise_or.reduceat(placed, first), word[first]
        out = np.zeros(int(word[-1]) + 2, np.uint32)
        out[word] = both >> np.uint64(32)
        out[word + 1] |= (both & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        return out.astype(">u4").tobytes()[: (int(end[-1]) + 7) // 8], at[::STEP]

    def decode(self, payloads: list[bytes], checkpoints: list[np.ndarray], sizes: list[int]) -> np.ndarray:
        """The ids of several records one after the other; all checkpoints advance side by side."""
        half = np.frombuffer(b"".join(payloads) + bytes(8 + sum(map(len, payloads)) % 2), ">u2").astype(np.uint64)
        data = half[:-3] << np.uint64(48) | half[1:-2] << np.uint64(32) | half[2:-1] << np.uint64(16) | half[3:]  # the 64 bits from each second byte on
        base = np.cumsum([0, *map(len, payloads)])[:-1] * 8
        first = np.cumsum([0, *sizes])[:-1]
        at = np.concatenate([c + b for c, b in zip(checkpoints, base, strict=True)])
        to = np.concatenate([np.arange(0, n, STEP) + f for n, f in zip(sizes, first, strict=True)])
        many = np.concatenate([np.minimum(STEP, n - np.arange(0, n, STEP)) for n in sizes])
        order = np.argsort(-many, kind="stable")
        at, to, many = at[order], to[order], many[order]
        out, drop = np.zeros(int(sum(sizes)), "<u4"), np.uint64(64 - self.width)
        lives = np.searchsorted(-many, -np.arange(int(many[0])), side="left").tolist()
        for k, live in enumerate(lives):
            p = at[:live]
            peek = (data[p >> 4] << (p & 15).astype(np.uint64)) >> drop
            out[to[:live] + k] = self.symbol[peek]
            p += self.length[peek]
        return out


def write_tokens(docs: DataFrame, vocabulary: str, path: str, end_id: int = 1) -> None:
    """Tokenise `docs` and write them as a token file under `path`."""
    spark = docs.sparkSession
    tokens = cut(tokenise(docs, vocabulary, end_id))
    kind = kind_of(vocabulary)
    width, lengths = int(kind[-1]), code_lengths(counts_of(tokens, kind))
    if max(lengths.values(), default=1) > 24:
        raise ValueError("codes longer than 24 bits are not supported")
    spark.createDataFrame([(int(i), int(n)) for i, n in lengths.items()], "id bigint, bits int").coalesce(1).write.parquet(f"{path}/header")
    code = spark.sparkContext.broadcast(Code(lengths))

    def records(batches):
        shard, seq, start = TaskContext.get().partitionId(), 0, 0
        held, size = [], 0

        def close():
            ids = np.frombuffer(b"".join(x for _, x in held), kind)
            payload, at = code.value.encode(ids)
            columns = [shard], [seq], [start], [len(ids)], [[d for d, _ in held]], [[len(x) // width for _, x in held]], [at.tolist()], [payload]
            kinds = pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in BLOCKS.split(", ")])

        for batch in batches:
            for doc, data in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                held.append((doc, data))
                size += len(data) // width
                if size >= RECORD:
                    yield close()
                    held, seq, start, size = [], seq + 1, start + size, 0
        if held:
            yield close()

    ordered = tokens.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    ordered.mapInArrow(records, BLOCKS).write.parquet(f"{path}/blocks")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids (binary: little-endian unsigned 32-bit integers)."""
    code = spark.sparkContext.broadcast(Code({r["id"]: r["bits"] for r in spark.read.parquet(f"{path}/header").collect()}))
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    ahead = F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1))  # one row of two numbers for each file
    bases = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", F.coalesce(ahead, F.lit(0)).alias("base"))

    def run(batches):
        for whole in batches:
            for i in range(whole.num_rows):  # a record is work enough at a time
                batch = whole.slice(i, 1)
                lengths = np.array(batch.column("lengths")[0].as_py(), np.int64)
                ids = code.value.decode([batch.column("payload")[0].as_py()], [np.array(batch.column("checkpoints")[0].as_py(), np.int64)], [int(lengths.sum())])
                end = np.cumsum(lengths)
                begin, data = end - lengths, ids.tobytes()
                start = begin + batch.column("start")[0].as_py() + batch.column("base")[0].as_py()
                out = [data[4 * a : 4 * b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_ids").flatten(), pa.array(start), pa.array(out, pa.binary())], ["doc_id", "start", "ids"])

    return blocks.join(F.broadcast(bases), "shard").mapInArrow(run, "doc_id bigint, start bigint, ids binary")


def round_trip(docs: DataFrame, vocabulary: str, path: str, end_id: int = 1) -> DataFrame:
    """Write the token file, read it back: doc_id, start, n_tokens, ids_crc32 from what was read.

    A null text counts as empty, so its document is the end id alone. Repeated rows are stored each; rows with one doc_id
    follow each other in the order of their ids; null doc_ids come first; an empty table gives an empty file and result.
    """
    write_tokens(docs, vocabulary, path, end_id)
    read = read_tokens(docs.sparkSession, path)
    return read.select("doc_id", "start", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
