"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WHITESPACE = re.compile(r"\s")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, cast; other columns of the input, whatever their names, play no part."""
    return df.select(*[F.col(f"`{c}`").cast(kind).alias(c) for c, kind in columns.items()])


def fold_of(id_column: str, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; null for a null id."""
    return F.crc32(F.col(f"`{id_column}`").cast("string").cast("binary")) % parts


def in_fold(id_column: str, parts: int, part: int) -> Column:
    """Whether a row belongs to the held-out fold; a null id does not."""
    return F.coalesce(fold_of(id_column, parts) == part, F.lit(False))


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch, null as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


def spans(texts, limit: int = 1 << 21):
    """Index ranges of consecutive texts of about `limit` characters, so that work space follows the limit and one text."""
    i = size = 0
    for j, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield i, j
            i, size = j, 0
        size += len(t)
    if i < len(texts):
        yield i, len(texts)


def parts(batches, limit: int = 1 << 21, name: str = "text"):
    """The batches cut into smaller ones of about `limit` bytes of text (a longer text is one of its own), before any becomes Python objects."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False)
        i = held = 0
        for j, n in enumerate(size.tolist()):
            if held and held + n > limit:
                yield batch.slice(i, j - i)
                i, held = j, 0
            held += n
        if i < batch.num_rows:
            yield batch.slice(i)


P1, P2, P3, P4, P5 = map(np.uint64, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))  # fixed by xxh64


def turned(h: np.ndarray, bits: int) -> np.ndarray:
    return h << np.uint64(bits) | h >> np.uint64(64 - bits)


def xxh64_many(raw: bytes, at: np.ndarray, size: np.ndarray, seed: int = 0) -> np.ndarray:
    """xxh64 of the pieces raw[at : at + size], those below 32 bytes by numpy, all at once."""
    data = np.frombuffer(raw + bytes(8), np.uint8)
    lane = lambda kind: np.ndarray(len(raw) + 1, kind, data, strides=(1,))
    by8, by4, by1 = lane("<u8"), lane("<u4"), data
    h = size.astype(np.uint64) + np.uint64(seed) + P5
    for k in range(0, 24, 8):
        i = np.flatnonzero(size >= k + 8)
        h[i] = turned(h[i] ^ turned(by8[at[i] + k] * P2, 31) * P1, 27) * P1 + P4
    i = np.flatnonzero(size & 4)
    h[i] = turned(h[i] ^ by4[at[i] + (size[i] & ~7)].astype(np.uint64) * P1, 23) * P2 + P3
    for k in range(3):
        i = np.flatnonzero(size & 3 > k)
        h[i] = turned(h[i] ^ by1[at[i] + (size[i] & ~3) + k].astype(np.uint64) * P5, 11) * P1
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    h ^= h >> np.uint64(32)
    for i in np.flatnonzero(size >= 32).tolist():
        h[i] = xxhash.xxh64_intdigest(raw[at[i] : at[i] + size[i]], seed)
    return h


class Words:
    """The words of some texts, one after the other: A-Z small, parted by ASCII white space, null as empty."""

    def __init__(self, texts: list[str | None]):
        words = [(t or "").encode().lower().split() for t in texts]
        self.raw = b" ".join([b" ".join(w) for w in words if w])
        self.count = np.fromiter(map(len, words), np.int64, len(words))
        self.first = np.cumsum(self.count) - self.count  # the number of each text's first word
        gaps = np.flatnonzero(np.frombuffer(self.raw, np.uint8) == 32)
        self.begin, self.end = (np.append(0, gaps + 1), np.append(gaps, len(self.raw))) if self.raw else (gaps, gaps)


def encode_column(texts: pa.Array, many, head=None, whole=None, lower=False, kind="<u4") -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, null as empty, one after the other, and where each text's begin (with the end of the last).

    Arrow cuts the texts into chunks and numbers the distinct ones; `many(chunks) -> list of bytes` encodes each of these
    once, and numpy lays the ids out in the order of the texts. Without `head`, texts are cut at ASCII white space, which is
    dropped (A-Z small before with `lower`). With it they are cut before spaces: `many` encodes chunks with the space before
    them and says None of one before which a text must not be cut, `head(chunks)` encodes first chunks as they stand, and
    `whole(text)` a text that can't be cut.
    """
    texts, n = pc.fill_null(texts, ""), len(texts)
    lists = pc.split_pattern(texts, " ") if head else pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    offsets, numbered = lists.offsets.to_numpy().astype(np.int64), lists.values.dictionary_encode()
    chunks, codes = numbered.dictionary.to_pylist(), numbered.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    ids = many(chunks)
    if head:
        uncut = np.fromiter((x is None for x in ids), bool, len(ids))[codes]
        uncut[offsets[:-1]] = False
        uncut = np.unique(np.searchsorted(offsets, np.flatnonzero(uncut), side="right") - 1)
        first = head([chunks[c] for c in codes[offsets[:-1]].tolist()])
        codes[offsets[:-1]] = len(ids) + np.arange(n)
        for i in uncut.tolist():
            first[i] = whole(texts[i].as_py())
            codes[offsets[i] + 1 : offsets[i + 1]] = len(ids) + n
        ids = [x or b"" for x in ids] + first + [b""]
    flat = np.frombuffer(b"".join(ids), kind)
    size = np.fromiter(map(len, ids), np.int64, len(ids)) // flat.itemsize
    at, many_of = np.cumsum(size) - size, size[codes]
    ends = np.cumsum(many_of)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(at[codes] - (ends - many_of), many_of)], np.append(0, ends)[offsets]


def pieces_of(ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """What `encode_column` gives, as bytes for each text."""
    data, width = ids.tobytes(), ids.itemsize
    return [data[width * i : width * j] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


class Learned(dict):
    """What `learn` says of each key, asked once while the key stays in use: of two generations the older one goes when the newer is full. Keys longer than `longest` are not kept."""

    def __init__(self, learn, limit: int, longest: int = 64):
        super().__init__()
        self.learn, self.limit, self.longest, self.old = learn, limit, longest, {}

    def __missing__(self, key):
        if len(key) > self.longest:
            return self.learn(key)
        value = self.old.get(key)
        if value is None:
            value = self.learn(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
