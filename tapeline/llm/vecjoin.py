"""Exact near-duplicate join of vectors by cosine, as a metric range join.

On unit vectors a cosine of at least t is a distance of at most r = sqrt(2 - 2t). Pivots partition the vectors: each one
is at home in the cell of its nearest pivot. A vector v at home at pivot h can be within r of one at home at pivot p only
if d(v, p) - d(v, h) <= 2r (triangle inequality) and v lies within r of the plane between h and p; it visits the cells for
which both hold. Each cell then compares its residents with all vectors in it on its own, so every link of a resident is
found in its home cell. Exact copies are one vector with a count. A cell emits a count per vector and one edge to the
smallest member of the group it saw, never the pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .components import components
from .topk import finite

C = F.col
CELL = 4096  # vectors of a label to a pivot
PIVOTS = 256  # at most: the pivots are broadcast
RESIDENTS, PRESENT = 2048, 8192  # vectors of a large cell that meet in one task
SEEN = "rep bigint, links bigint, root bigint"
PLACED = "rep bigint, n bigint, label string, size int, cell int, home boolean, x array<double>"


def dense(column, size: int) -> np.ndarray:
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), size)


def place(reps: DataFrame, pivots: np.ndarray, radius: float) -> DataFrame:
    """Every vector at home in one cell and as a visitor in those that it may have links in."""
    between = np.sqrt(((pivots[:, None] - pivots[None]) ** 2).sum(axis=2))
    shared = reps.sparkSession.sparkContext.broadcast((pivots, between))

    def run(batches):
        pivots, between = shared.value
        for batch in batches:
            for size in np.unique(batch.column("size").to_numpy()).tolist():
                part = batch.filter(pa.array(batch.column("size").to_numpy() == size))
                x = dense(part.column("x"), size)
                u = np.zeros((len(x), max(size, pivots.shape[1])))
                u[:, :size] = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
                p = np.zeros((len(pivots), u.shape[1]))
                p[:, : pivots.shape[1]] = pivots
                square = np.maximum(0, (u * u).sum(axis=1)[:, None] + (p * p).sum(axis=1) - 2 * u @ p.T)
                home = square.argmin(axis=1)
                least, gap = square[np.arange(len(u)), home][:, None], between[home]
                plane = np.divide(square - least, 2 * gap, out=np.zeros_like(square), where=gap > 0)
                visits = (np.sqrt(square) - np.sqrt(least) <= 2 * radius + 1e-9) & (plane <= radius + 1e-9)
                visits[np.arange(len(u)), home] = True
                row, cell = np.nonzero(visits)
                taken = part.take(pa.array(row))
                names = ["rep", "n", "label", "size"]
                yield pa.RecordBatch.from_arrays([*(taken.column(c) for c in names), pa.array(cell.astype(np.int32)), pa.array(home[row] == cell), taken.column("x")], [*names, "cell", "home", "x"])

    return reps.select("rep", "n", "label", "size", "x").mapInArrow(run, PLACED)


def unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the groups of the pairs (a, b) in `root`, where every place names a smaller or equal one."""
    while len(a):
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root[:] = root[root]


def join_cell(rows: pa.Table, threshold: float) -> pa.Table:
    """Links of the residents with everything present, and the group that each vector belongs to here."""
    size = rows.column("size")[0].as_py()
    rep, n = rows.column("rep").to_numpy(), rows.column("n").to_numpy()
    resident = rows.column("as_resident").to_numpy(zero_copy_only=False).astype(bool)
    x = dense(rows.column("x"), size)
    norm = np.sqrt((x * x).sum(axis=1))
    here, there = np.flatnonzero(resident), np.flatnonzero(~resident)
    ids, place = np.unique(rep, return_inverse=True)
    root, links = np.arange(len(ids)), np.zeros(len(here), np.int64)
    step = max(1, (1 << 20) // max(1, len(there)))
    for i in range(0, len(here), step):
        at = here[i : i + step]
        near = (x[at] @ x[there].T) / (norm[at, None] * norm[there]) >= threshold
        near &= rep[at, None] != rep[there]
        links[i : i + step] = near @ n[there]
        a, b = np.nonzero(near)
        unite(root, place[at[a]], place[there[b]])
    count = np.zeros(len(ids), np.int64)
    count[place[here]] = links
    told = (root != np.arange(len(ids))) | (count > 0)
    return pa.table({"rep": ids[told], "links": count[told], "root": ids[root[told]]})


def near_duplicates(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row.

    Rows are compared if their labels are equal and not null and their vectors equally long; a vector that is null, zero,
    or holds null or non-finite components links with nothing and is its own component. Rows that repeat an id are rows
    of their own. A null vec_id is never the smallest; among null ids alone the component is null, and kept says so. An
    empty table gives an empty result; other columns are ignored.
    """
    radius = math.sqrt(2 - 2 * threshold)
    rows = vectors.select(C("vec_id").cast("bigint").alias("vec_id"), C("label").cast("string").alias("label"), C("embedding").cast("array<double>").alias("x"))
    zero = F.forall("x", lambda v: v == 0)
    fit = F.coalesce(C("label").isNotNull() & finite(C("x")) & ~zero, F.lit(False))
    kept = (C("vec_id").eqNullSafe(C("component_id"))).alias("kept")
    alone = rows.where(~fit).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), C("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    rows = rows.where(fit)
    reps = rows.groupBy("label", "x").agg(F.min("vec_id").alias("low"), F.count("*").alias("n"))
    reps = cut(reps.select("label", "x", F.size("x").alias("size"), "low", "n", F.monotonically_increasing_id().alias("rep")))
    most = reps.groupBy("label").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).first()["n"]
    pivots = reps.orderBy(F.xxhash64("rep")).limit(min(PIVOTS, max(1, -(-most // CELL)))).select("x").collect()
    unit = np.zeros((len(pivots) or 1, max((len(p["x"]) for p in pivots), default=1)))
    for u, p in zip(unit, pivots):
        u[: len(p["x"])] = np.array(p["x"]) / np.linalg.norm(p["x"])
    placed = cut(place(reps, np.unique(unit, axis=0), radius))
    cell = ["label", "size", "cell"]
    parts = placed.groupBy(*cell).agg(F.ceil(F.count_if("home") / RESIDENTS).alias("by_home"), F.ceil(F.count("*") / PRESENT).alias("by_all"))
    sized = placed.join(parts, cell).where("by_home > 0")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), C(n) - 1))
    deal = lambda n: F.pmod(F.xxhash64("rep"), C(n))
    residents = sized.where("home").withColumn("h", deal("by_home")).withColumn("p", each("by_all")).withColumn("as_resident", F.lit(True))
    present = sized.withColumn("p", deal("by_all")).withColumn("h", each("by_home")).withColumn("as_resident", F.lit(False))
    seen = cut(residents.unionByName(present).groupBy(*cell, "h", "p").applyInArrow(lambda t: join_cell(t, threshold), SEEN))
    links = seen.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(seen, "rep", "root")
    known = reps.join(links, "rep", "left").join(roots, C("rep") == C("node"), "left")
    known = known.select("label", "x", "low", (F.coalesce("links", F.lit(0)) + C("n") - 1).alias("n_links"), F.coalesce("root", "rep").alias("root"))
    lowest = known.groupBy("root").agg(F.min("low").alias("component_id"))
    found = rows.join(known.join(lowest, "root").select("label", "x", "n_links", "component_id"), ["label", "x"])
    return found.select("vec_id", "n_links", "component_id", kept).unionByName(alone)


ORACLE = """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.93e0),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
n AS (SELECT a, count(*) AS n FROM e GROUP BY a), c AS (SELECT a, min(b) AS c FROM r GROUP BY a)
SELECT d.vec_id, coalesce(n.n, 0) AS n_links, c.c AS component_id, d.vec_id = c.c AS kept
FROM embeddings d JOIN c ON c.a = d.vec_id LEFT JOIN n ON n.a = d.vec_id"""
