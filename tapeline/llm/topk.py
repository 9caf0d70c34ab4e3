"""Exhaustive top-k by integer inner product, term at a time.

Queries and candidates meet in blocks. In a block of candidates every term (component) has a posting list of the
candidates with a weight; a query's terms scatter weight times weight into a dense array of scores, one term after the
other. The k best of the block are selected by partition, and the bests of all blocks are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut

C = F.col
TOP = "query_row bigint, query_id bigint, vec_id bigint, score bigint"


def finite(c: Column) -> Column:
    """Not null, and no component null or not finite."""
    inf = float("inf")
    return F.coalesce(c.isNotNull() & F.forall(c, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < inf), F.lit(False))), F.lit(False))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of unequal length filled up with zeros."""
    rows = column.combine_chunks()
    size = np.diff(rows.offsets.to_numpy())
    out = np.zeros((len(rows), int(size.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < size[:, None]] = rows.flatten().to_numpy(zero_copy_only=False)
    return out


def postings(weights: np.ndarray):
    """Per term: the candidates with a weight and the weights; of a term that most have, a dense list without candidates."""
    for column in np.ascontiguousarray(weights.T):
        at = np.flatnonzero(column)
        yield (None, column) if 2 * len(at) > len(column) else (at, column[at])


def accumulate(queries: np.ndarray, candidates: np.ndarray, group: int = 16):
    """Scores of every query with all candidates, some queries at a time."""
    terms = min(queries.shape[1], candidates.shape[1])
    queries, candidates = queries[:, :terms], candidates[:, :terms]
    most = max(1, terms) * int(np.abs(queries).max(initial=0)) * int(np.abs(candidates).max(initial=0))
    if most >= 1 << 63:
        raise ValueError("scores do not fit 64 bits")
    kind = np.int32 if most < 1 << 31 else np.int64
    queries, lists = queries.astype(kind), list(postings(candidates.astype(kind)))
    for i in range(0, len(queries), group):
        part = queries[i : i + group]
        scores = np.zeros((len(part), len(candidates)), kind)
        for term, (at, weight) in enumerate(lists):
            rows = np.flatnonzero(part[:, term])
            if not len(rows) or not len(weight):
                continue
            add = part[rows, term, None] * weight
            if at is not None:
                scores[rows[:, None], at] += add
            elif len(rows) == len(part):
                scores += add
            else:
                scores[rows] += add
        yield from scores


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    at = np.arange(len(scores))
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return at[np.lexsort((ids[at], -scores[at].astype(np.int64)))][:k]


def search(vectors: DataFrame, every: int = 20, k: int = 20, scale: int = 64, query_rows: int = 4096, candidate_rows: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: for the rows whose vec_id is a multiple of `every`, the k best among all other rows.

    Components become floor(scale * x). Vectors that are null or hold null or non-finite components, and rows with a null
    vec_id, take no part. Rows that repeat a vec_id are rows of their own, as queries and as candidates; missing
    components of shorter vectors count as zero; an empty table gives an empty result; other columns are ignored.
    """
    of = C("embedding").cast("array<double>")
    rows = vectors.select(C("vec_id").cast("bigint").alias("vec_id"), of.alias("x")).where(C("vec_id").isNotNull() & finite(C("x")))
    weights = F.transform("x", lambda v: F.floor(v * scale).cast("bigint"))
    rows = cut(rows.select("vec_id", weights.alias("w"), F.monotonically_increasing_id().alias("row")))
    n, m = rows.agg(F.count("*"), F.count_if(C("vec_id") % every == 0)).first()
    blocks, groups = max(1, -(-n // candidate_rows)), max(1, -(-m // query_rows))
    deal = lambda parts: F.pmod(F.xxhash64("row"), F.lit(parts))
    each = lambda parts: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint")))
    queries = rows.where(C("vec_id") % every == 0).withColumn("q", deal(groups)).withColumn("c", each(blocks))
    candidates = rows.withColumn("c", deal(blocks)).withColumn("q", each(groups))

    def meet(q: pa.Table, c: pa.Table) -> pa.Table:
        if not q.num_rows or not c.num_rows:
            return pa.table({f.split()[0]: pa.array([], pa.int64()) for f in TOP.split(", ")})
        ids, own = c.column("vec_id").to_numpy(), c.column("row").to_numpy()
        order = np.argsort(own)
        out = []
        for scores, row in zip(accumulate(matrix(q.column("w")), matrix(c.column("w"))), q.column("row").to_pylist(), strict=True):
            at = order[min(int(np.searchsorted(own[order], row)), len(own) - 1)]
            keep = best(scores, ids, k + 1)
            out.append([x for x in keep if own[x] != row][:k] if own[at] == row else keep[:k])
            out[-1] = (ids[out[-1]], scores[out[-1]])
        size = [len(s) for _, s in out]
        repeat = lambda name: np.repeat(q.column(name).to_numpy(), size)
        columns = repeat("row"), repeat("vec_id"), np.concatenate([i for i, _ in out]), np.concatenate([s for _, s in out]).astype(np.int64)
        return pa.table({f.split()[0]: pa.array(x, pa.int64()) for f, x in zip(TOP.split(", "), columns, strict=True)})

    tops = queries.groupBy("q", "c").cogroup(candidates.groupBy("q", "c")).applyInArrow(meet, TOP)
    rank = F.row_number().over(W.partitionBy("query_row").orderBy(C("score").desc(), "vec_id"))
    return tops.withColumn("rank", rank).where(C("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS w, row_number() OVER () AS r FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, q.r, c.vec_id, CAST(list_inner_product(q.w, c.w) AS BIGINT) AS score FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM
  (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20"""
