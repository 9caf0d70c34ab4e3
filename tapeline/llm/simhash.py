"""SimHash fingerprints and near-duplicate groups by meet-in-the-middle ball hashing.

Two fingerprints within an even radius r have a variant within r/2 of both. Every distinct fingerprint that shares enough
of its bits with another one emits all its variants within r/2 and the variants are shuffled. All fingerprints that meet at a variant lie within r of each other,
so linking each of them to the smallest one keeps every group together without emitting its pairs; a variant gathers at
most as many distinct fingerprints as a ball of r/2 holds (65 for r = 2).
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut
from .common import Words, pick, xxh64_many
from .components import components

C = F.col
BLOCK = 1 << 15  # shingles counted at a time


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The 64-bit fingerprint of a text, signed; 0 without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    width = min(width, len(words))
    joined = b" ".join(words)
    length = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(length + 1) - 1
    first, last = (end - length)[: len(words) - width + 1].tolist(), end[width - 1 :].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, len(first), BLOCK):
        h = np.fromiter((digest(joined[a:b], seed) for a, b in zip(first[i : i + BLOCK], last[i : i + BLOCK])), np.uint64)
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(first), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(words: Words, width: int = 3, seed: int = 42) -> np.ndarray:
    """`fingerprint` of many texts at once, signed."""
    out, full = np.zeros(len(words.count), np.int64), np.flatnonzero(words.count)
    if not len(full):
        return out
    count, first = words.count[full], words.first[full]
    many = np.maximum(1, count - width + 1)
    ends = np.cumsum(many)
    begin = np.arange(ends[-1]) + np.repeat(first - (ends - many), many)
    last = np.minimum(begin + width, np.repeat(first + count, many)) - 1
    at = words.begin[begin]
    h = xxh64_many(words.raw, at, words.end[last] - at, seed)
    parts = -(-many // 255)  # a byte counts 255 shingles at most
    at_part = np.cumsum(parts) - parts
    cuts = np.repeat(ends - many, parts) + 255 * (np.arange(parts.sum()) - np.repeat(at_part, parts))
    ones = np.empty((len(full), 8, 8), np.int64)
    for bit in range(8):
        sums = np.add.reduceat(h >> np.uint64(bit) & np.uint64(0x0101010101010101), cuts)
        ones[:, :, bit] = np.add.reduceat(sums.astype("<u8").view(np.uint8).reshape(-1, 8), at_part, axis=0, dtype=np.int64)
    out[full] = np.packbits(ones.reshape(-1, 64) * 2 > many[:, None], axis=1, bitorder="little").view("<i8")[:, 0]
    return out


def fingerprint_column(width: int = 3, seed: int = 42):
    @F.pandas_udf("bigint")
    def of(text: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, width, seed) for t in text], dtype="int64")

    return of


def variants(radius: int) -> list[int]:
    """Masks of at most radius/2 bits as signed 64-bit integers."""
    if radius < 0 or radius % 2:
        raise ValueError("radius must be even")
    masks = [sum(1 << b for b in bits) for n in range(radius // 2 + 1) for bits in combinations(range(64), n)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def close(prints: DataFrame, radius: int) -> DataFrame:
    """The distinct fingerprints that share two blocks of bits with another one. Of radius + 2 blocks two fingerprints within the radius share two at least, so no other fingerprint has a link."""
    ends = [64 * i // (radius + 2) for i in range(radius + 3)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(ends, ends[1:])]
    masks = [m - (1 << 64) if m >> 63 else m for m in (a | b for a, b in combinations(blocks, 2))]
    keys = F.array(*[F.xxhash64(F.lit(n), C("fp").bitwiseAND(F.lit(m).cast("bigint"))) for n, m in enumerate(masks)])
    met = prints.select("fp", F.explode(keys).alias("key"))
    shared = met.groupBy("key").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low <> high").select("key")
    return met.join(shared, "key", "left_semi").select("fp").distinct()


def link(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (a, b) between distinct fingerprints of column `fp`: linear in their number, with the same components as all links."""
    masks = F.array(*[F.lit(m).cast("bigint") for m in variants(radius)])
    met = close(prints, radius).select("fp", F.explode(masks).alias("mask")).select("fp", C("fp").bitwiseXOR(C("mask")).alias("variant"))
    low = F.min("fp").over(W.partitionBy("variant"))
    pairs = met.select(C("fp").alias("a"), low.alias("b")).where(C("a") != C("b"))
    return pairs.where(F.bit_count(C("a").bitwiseXOR(C("b"))) <= radius).distinct()


def group(prints: DataFrame, radius: int = 2) -> DataFrame:
    """fp, component_id (smallest doc_id of its component) for rows (doc_id, fp). Ids that are all null give null."""
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    first = cut(first)
    roots = components(link(first.select("fp"), radius), "a", "b")
    rooted = first.join(roots, C("fp") == C("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rooted.join(lowest, "root").select("fp", "component_id")


def hexadecimal(c: Column) -> Column:
    return F.lower(F.lpad(F.hex(c), 16, "0"))


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint, component_id of every row.

    A null text counts as empty: fingerprint zero, linked like any other. Repeated rows fall into one group; a null
    doc_id is never the smallest, and a group of null ids alone has a null component; an empty table gives an empty
    result; other columns are ignored.
    """
    prints = cut(pick(docs, doc_id="bigint", text="string").select("doc_id", fingerprint_column(width, seed)("text").alias("fp")))
    return prints.join(group(prints, radius), "fp").select("doc_id", hexadecimal(C("fp")).alias("fingerprint"), "component_id")


def rows_of(docs: DataFrame, prints: DataFrame, kept: DataFrame, of) -> DataFrame:
    """The rows of documents that `kept` names by distinct (doc_id, fp); `prints` has both of every row, `of` makes a text's fp."""
    same = lambda *keys: [docs[k].eqNullSafe(C(f"kept.{k}")) for k in keys]
    repeated = cut(prints.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    single = docs.join(kept.select("doc_id").distinct().hint("shuffle_hash").alias("kept"), same("doc_id"), "left_semi")  # no sort of texts
    if repeated.isEmpty():
        return single
    fp = "fp_" + "_".join(docs.columns)  # a name that no column has
    again = docs.join(repeated.alias("kept"), same("doc_id"), "left_semi").withColumn(fp, of(C("text").cast("string")))
    again = again.join(kept.alias("kept"), [again["doc_id"].eqNullSafe(C("kept.doc_id")), again[fp] == C("kept.fp")], "left_semi")
    return single.join(repeated.alias("kept"), same("doc_id"), "left_anti").unionByName(again.dropDuplicates(["doc_id", fp]).drop(fp))


def keep_first(docs: DataFrame, width: int = 3, radius: int = 2, seed: int = 42) -> DataFrame:
    """The documents without all but the one with the smallest doc_id of each group, with the columns they came with.

    Rows that share a doc_id are told apart by their fingerprints; of equal ones a single row stays. Null and empty texts are
    one group; an empty table stays empty. No text is compared:
    `nearcopies.drop_near_copies` is the filter for a corpus.
    """
    of = fingerprint_column(width, seed)
    prints = cut(pick(docs, doc_id="bigint", text="string").select("doc_id", of("text").alias("fp")))
    kept = cut(prints.join(group(prints, radius), "fp").where(C("doc_id").eqNullSafe(C("component_id"))).select("doc_id", "fp").distinct())
    return rows_of(docs, prints, kept, of)
