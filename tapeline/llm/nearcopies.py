"""Near copies by the similarity of their word shingles, for filtering a corpus.

Candidates come from SimHash groups: the fingerprints of `simhash`, linked at two or fewer differing bits; each text
meets the first one of its group. Texts that are near by words but not within two bits are found by MinHash bands over
sets of five-word shingles: two sets with Jaccard similarity s share one of `bands` keys of `rows` minima with
probability 1 - (1 - s^rows)^bands, 0.994 at s = 0.8. A set counts a shingle once, so texts that repeat one line meet
there only if their other lines agree as well. A document goes only if its exact Jaccard similarity to a document that
stays is high enough; the outcome is that of going through the documents by doc_id.

In the first round the documents of a key are compared with its first CENTRES ones alone, so that a key of n near copies
costs about n comparisons; what is not near to any of those that stay goes on to the next round without them, and meets
twice as many.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut
from .common import Words, parts, pick, xxh64_many
from .simhash import fingerprints, group, rows_of

C = F.col
BLOCK = 1 << 8  # shingles hashed by all functions at a time
CENTRES = 8  # documents of a key that the others are compared with in the first round; twice as many in each later one
MOST = 8  # times CENTRES in a round, at most
LAST = (1 << 63) - 1
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes; a text of fewer words is one shingle, one without words has none."""
    words = (text or "").encode().lower().split()
    width = min(width, len(words))
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(words) - width + 1
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = (h ^ (h >> np.uint64(29))) * FACTOR + w[k : k + n]
    h = (h ^ (h >> np.uint64(32))) * FACTOR
    return np.unique(h ^ (h >> np.uint64(29)))


def shingle_sets(texts: list[str | None], words: Words, width: int = 5) -> list[np.ndarray]:
    """`shingles` of many texts at once."""
    w = xxh64_many(words.raw, words.begin, words.end - words.begin)
    n = max(0, len(w) - width + 1)
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = (h ^ (h >> np.uint64(29))) * FACTOR + w[k : k + n]
    h = (h ^ (h >> np.uint64(32))) * FACTOR
    h ^= h >> np.uint64(29)
    out = []
    for text, first, count in zip(texts, words.first.tolist(), words.count.tolist(), strict=True):
        if count < width:
            out.append(shingles(text, width))
            continue
        found = np.sort(h[first : first + count - width + 1])
        new = np.empty(len(found), bool)
        new[0] = True
        np.not_equal(found[1:], found[:-1], out=new[1:])
        out.append(found[new])
    return out


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether the Jaccard similarity of two shingle sets is at least `least`."""
    small, large = sorted((len(a), len(b)))
    if small < least * large:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (small + large - both)


def factors(bands: int, rows: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 32, bands * rows, dtype=np.uint32) | np.uint32(1)


def band_keys(found: np.ndarray, by: np.ndarray, rows: int, held: np.ndarray) -> list[int]:
    """One signed key for each band of `rows` minima under the hash functions `by`; `held` is work space of BLOCK rows."""
    low, short = np.full(len(by), ~np.uint32(0)), (found >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(short), BLOCK):
        some = short[i : i + BLOCK, None]
        np.minimum(low, np.multiply(some, by, out=held[: len(some)]).min(axis=0), out=low)
    data, size = low.tobytes(), rows * low.itemsize
    keys = [xxhash.xxh64_intdigest(data[4 * i : 4 * i + size], i) for i in range(0, len(by), rows)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def set_id(found: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes())).astype(np.int64))


def set_id_column(width: int):
    @F.pandas_udf("bigint")
    def of(text: pd.Series) -> pd.Series:
        return pd.Series([set_id(shingles(t, width)) for t in text], dtype="int64")

    return of


def sketches(docs: DataFrame, width: int, bands: int, rows: int, seed: int) -> DataFrame:
    """doc_id, text, fp (the identity of the shingle set), its band keys and the SimHash fingerprint of the text."""

    def run(batches):
        by = factors(bands, rows, seed)
        held = np.empty((BLOCK, len(by)), np.uint32)
        for batch in parts(batches):
            texts = batch.column("text").to_pylist()
            words = Words(texts)
            fp, keys = [], []
            for found in shingle_sets(texts, words, width):
                fp.append(set_id(found))
                keys.append(band_keys(found, by, rows, held))
            columns = [batch.column("doc_id"), batch.column("text"), pa.array(fp, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(fingerprints(words), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text", "fp", "keys", "print"])

    return pick(docs, doc_id="bigint", text="string").mapInArrow(run, "doc_id bigint, text string, fp bigint, keys array<bigint>, print bigint")


def simhash_pairs(prints: DataFrame, first: DataFrame) -> DataFrame:
    """fp, low: the sets of each SimHash group with the set that comes first in it."""
    groups = group(prints.select("doc_id", C("print").alias("fp"))).select(C("fp").alias("print"), F.coalesce("component_id", "fp").alias("group"))
    member = prints.select("fp", "print").join(groups, "print").select("fp", "group").distinct().join(first.select("fp", place()), "fp")
    low = member.groupBy("group").agg(F.min("place").alias("place")).select("group", C("place.fp").alias("low"))
    return member.join(low, "group").where("fp <> low").select("fp", "low").distinct()


def compare(pairs: DataFrame, texts: DataFrame, width: int, least: float) -> DataFrame:
    """fp, low and whether their texts are near, for pairs (fp, low)."""

    def run(batches):
        for part in parts(parts(batches, name="low_text")):
            low, low_text = part.column("low").to_numpy(), part.column("low_text")
            new = np.append(True, low[1:] != low[:-1])
            sets_of = lambda column: shingle_sets(x := column.to_pylist(), Words(x), width)
            held = sets_of(low_text.filter(pa.array(new)))
            near = [similar(found, held[k], least) for found, k in zip(sets_of(part.column("text")), (np.cumsum(new) - 1).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("fp"), part.column("low"), pa.array(near, pa.bool_())], ["fp", "low", "near"])

    lows = texts.select(C("fp").alias("low"), C("text").alias("low_text"))
    return pairs.join(texts, "fp").join(lows, "low").select("fp", "low", "text", "low_text").mapInArrow(run, "fp bigint, low bigint, near boolean")


def place():
    return F.struct(ahead(), "fp").alias("place")


def ahead():
    return F.coalesce("first", F.lit(LAST)).alias("first")


def candidates(member: DataFrame, most: int) -> DataFrame:
    """fp, low: each set with the first `most` ones of its keys that come before it, a pair once however many keys it has."""
    centres = member.where(C("rank") <= most).groupBy("key").agg(F.collect_list(F.struct(C("fp").alias("low"), C("rank").alias("ahead"))).alias("centres"))
    before = F.transform(F.filter("centres", lambda c: c["ahead"] < C("rank")), lambda c: c["low"])
    lows = member.where("rank > 1").join(centres, "key").select("fp", before.alias("lows")).groupBy("fp").agg(F.collect_set("lows").alias("lows"))
    return lows.select("fp", F.explode(F.array_distinct(F.flatten("lows"))).alias("low"))


def removed(prints: DataFrame, first: DataFrame, width: int, least: float) -> list[DataFrame]:
    """Tables of the sets (fp) that are near to a set that stays and comes before them, by the smallest doc_id."""
    paired = simhash_pairs(prints, first).select(F.explode(F.array("fp", "low")).alias("fp"), F.xxhash64("fp", "low").alias("key"))
    keyed = first.select("fp", ahead(), F.explode("keys").alias("key")).unionByName(paired.join(first.select("fp", ahead()), "fp"))
    by_key = W.partitionBy("key").orderBy("first", "fp")
    rank = F.row_number().over(by_key)
    member = cut(keyed.withColumns({"rank": rank, "more": F.lead("fp").over(by_key).isNotNull()}).where("rank > 1 or more").drop("more"))
    one = member.select("fp", "first").distinct().hint("shuffle_hash")  # of equal sets the text of the first one
    texts = cut(prints.select("fp", C("doc_id").alias("first"), "text").withColumn("first", ahead()).join(one, ["fp", "first"], "left_semi").groupBy("fp").agg(F.first("text").alias("text")))
    tested, gone, most = None, [], CENTRES
    while not member.isEmpty():
        pairs = candidates(member, most)
        new = cut(compare(pairs if tested is None else pairs.join(tested, ["fp", "low"], "left_anti"), texts, width, least))
        tested = new if tested is None else tested.unionByName(new)
        alive = member.groupBy("fp").agg(F.max("rank").alias("rank"))  # a set of which all that come before it have been tested is free
        near = cut(tested.where("near").join(alive.select(C("fp").alias("low")), "low", "left_semi").select("fp", "low"))
        stay = alive.where(C("rank") <= most).select("fp").join(near, "fp", "left_anti")
        out = near.join(stay.select(C("fp").alias("low")), "low", "left_semi").select("fp").distinct()
        decided = cut(stay.withColumn("out", F.lit(False)).unionByName(out.withColumn("out", F.lit(True))))
        gone.append(decided.where("out").select("fp"))
        member = cut(member.join(decided, "fp", "left_anti").withColumn("rank", rank))
        most = min(2 * most, MOST * CENTRES)
    return gone


def drop_near_copies(docs: DataFrame, width: int = 5, least: float = 0.8, bands: int = 45, rows: int = 10, seed: int = 42) -> DataFrame:
    """The documents without those whose shingles have a Jaccard similarity of `least` or more to a document that stays.

    Of two near copies the one with the smaller doc_id stays, a null doc_id comes last. Rows that share a doc_id are told
    apart by their shingle sets; of equal ones a single row stays. Texts without words, null ones among them, are equal; an
    empty table stays empty. The columns are those the documents came with.
    """
    prints = cut(sketches(docs, width, bands, rows, seed))
    first = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.first("keys").alias("keys")))
    kept = first.select(C("first").alias("doc_id"), "fp")
    if gone := removed(prints, first, width, least):
        kept = kept.join(functools.reduce(DataFrame.unionByName, gone), "fp", "left_anti")
    return rows_of(docs, prints, cut(kept.select("doc_id", "fp")), set_id_column(width))
