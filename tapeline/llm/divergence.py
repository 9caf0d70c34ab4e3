"""How far the sources of a language lie apart in their words, by Gustavson's row accumulation.

The counts form a sparse matrix of groups (language, source) by terms. Cut by terms into blocks of a bounded number of
entries, each block is handled on its own: its entries are indexed by term, and each group scatters the entries of its
terms through that index into one dense accumulator over its peers, so that no pair of postings is ever written out. The
accumulators of all blocks are added up.

A smoothed share is not zero where the count is: with z a group's share of an absent term, the distance of two groups is
  sum |p - r| = V |z_p - z_r| + sum over terms of either (|p - z_r| - |z_p - z_r|) + (|z_p - r| - |z_p - z_r|)
              + sum over common terms (|p - r| - |p - z_r| - |z_p - r| + |z_p - z_r|).
Only the last sum needs common terms. The middle ones need the values of one group against a single number of the other,
which sorted values with prefix sums answer for all peers at once.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut
from .common import parts

C = F.col
# Terms are of ASCII letters and all beyond ASCII; A-Z become small and every other byte parts terms (the contract's fixed pattern).
TERM_BYTES = bytes(b | 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 32 for b in range(256))
COUNTS = "lang string, source string, term string, count bigint, docs bigint"
SUMS = "lang string, source string, peer string, value bigint"
SCALE = 1_000_000_000  # a fixed value of the contract, as are the next two
PRIOR = 5
LEAST_DOCS = 30
BLOCK_ENTRIES = 100_000
TILE = 1000  # groups whose accumulators a task makes
HELD = 300_000  # distinct (lang, source, term) that a task holds before it passes them on
PAIRS_AT_ONCE = 1 << 21


def group_rows(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(C(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])


def term_counts(rows: DataFrame) -> DataFrame:
    """lang, source, term, its occurrences and the documents that hold it: added up in the tasks, then over all."""

    def run(batches):
        count: dict[tuple[str, str], Counter] = {}
        holds: dict[tuple[str, str], Counter] = {}

        def out():
            for (lang, source), terms in count.items():
                docs = holds[lang, source]
                columns = [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(list(terms), pa.binary()).cast(pa.string()),
                           pa.array(list(terms.values()), pa.int64()), pa.array([docs[t] for t in terms], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "count", "docs"])

        for batch in parts(batches):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for text, lang, source in zip(texts, batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True):
                found = text.translate(TERM_BYTES).split()
                count.setdefault((lang, source), Counter()).update(found)
                holds.setdefault((lang, source), Counter()).update(set(found))
            if sum(map(len, count.values())) > HELD:
                yield from out()
                count, holds = {}, {}
        yield from out()

    return rows.mapInArrow(run, COUNTS).groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def share(count: str, total: str, terms: str):
    """1 + floor(SCALE (count + PRIOR) / (total + PRIOR terms)) in 64 bits, exact for totals below 2 ** 48: by way of SCALE = 32000 x 31250."""
    part, whole = f"({count} + {PRIOR})", f"({total} + {PRIOR} * {terms})"
    return F.expr(f"CAST(1 + 31250 * ((32000 * {part}) div {whole}) + (31250 * ((32000 * {part}) % {whole})) div {whole} AS BIGINT)")


def kept_counts(docs: DataFrame, least_docs: int = LEAST_DOCS) -> tuple[DataFrame, DataFrame]:
    """The counts of kept terms, and every (lang, source) with `total`, `lang_total`, `terms` and `absent` (an absent term's share; null without terms)."""
    rows = group_rows(docs)
    counts = cut(term_counts(rows))
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("lang_count")).where(C("docs") >= least_docs)
    entries = cut(counts.drop("docs").join(kept.drop("docs"), ["lang", "term"]))
    totals = entries.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    langs = entries.groupBy("lang", "term").agg(F.first("lang_count").alias("n")).groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count("*").alias("terms"))
    zero = lambda c: F.coalesce(C(c), F.lit(0)).alias(c)
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", zero("total"), zero("lang_total"), zero("terms"))
    absent = F.when(C("terms") > 0, share("0", "total", "terms"))
    return entries, cut(groups.withColumn("absent", absent))


def accumulate(term: np.ndarray, group: np.ndarray, p: np.ndarray, absent: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For each group of `rows` and every peer the sum of |p - r| - |absent - absent| over the terms of a block.

    Entries are (term, group, p), with terms and groups numbered; int64 throughout.
    """
    index = np.argsort(term, kind="stable")  # the term-major index
    at = np.searchsorted(term[index], np.arange(int(term.max(initial=-1)) + 2))
    peer_of, share_of = group[index], p[index]
    by_group = np.lexsort((p, group))
    cuts = np.searchsorted(group[by_group], np.arange(len(absent) + 1))
    # one value against all of a group's: sorted shares and their prefix sums
    own = [p[by_group[i:j]] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
    sums = [np.append(0, np.cumsum(x)) for x in own]

    def against(g, z):
        x, s = own[g], sums[g]
        k = np.searchsorted(x, z)
        return (z * k - s[k]) + (s[-1] - s[k] - z * (len(x) - k)) - len(x) * np.abs(z - absent[g])

    out = np.zeros((len(rows), len(absent)), np.int64)
    for n, g in enumerate(rows.tolist()):
        line, z = out[n], absent[g]
        line += against(g, absent)
        mine = by_group[cuts[g] : cuts[g + 1]]
        size = at[term[mine] + 1] - at[term[mine]]
        ends = np.cumsum(size)
        i = 0
        while i < len(mine):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PAIRS_AT_ONCE, side="right")))
            many = size[i:j]
            place = np.arange(int(many.sum())) + np.repeat(at[term[mine[i:j]]] - (np.cumsum(many) - many), many)
            peer, r, x = peer_of[place], share_of[place], np.repeat(p[mine[i:j]], many)
            base = absent[peer]
            np.add.at(line, peer, np.abs(x - r) - np.abs(x - base) - np.abs(z - r) + np.abs(z - base))
            i = j
    for o in range(len(absent)):
        if len(own[o]):
            out[:, o] += against(o, absent[rows])
    return out


def pair_distances(entries: DataFrame, groups: DataFrame, block_entries: int = BLOCK_ENTRIES, tile: int = TILE) -> DataFrame:
    """lang, source, peer and value for all ordered pairs of different sources of a language."""
    blocks = max(1, -(-entries.count() // block_entries))
    most = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 1
    tiles = -(-most // tile)
    each = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    numbered = groups.select("lang", "source", "terms", "absent", F.pmod(F.xxhash64("source"), F.lit(tiles)).cast("int").alias("own"))
    right = numbered.select("*", each(blocks, "block")).select("*", each(tiles, "tile"))
    shares = entries.join(groups.select("lang", "source", "total", "terms"), ["lang", "source"]).select("lang", "source", "term", share("count", "total", "terms").alias("p"))
    left = shares.select("*", F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int").alias("block")).select("*", each(tiles, "tile"))

    def run(key, entries: pa.Table, groups: pa.Table) -> pa.Table:
        names = groups.column("source").to_pylist()
        order = sorted(range(len(names)), key=lambda i: names[i])
        names = pa.array([names[i] for i in order], pa.string())
        rows = np.flatnonzero(groups.column("own").to_numpy()[order] == key[2].as_py())
        terms = groups.column("terms").to_numpy()[order]
        if not len(rows):
            return pa.table([[], [], [], []], schema=empty)
        absent = np.zeros(len(names), np.int64) if not terms[0] else groups.column("absent").to_numpy()[order].astype(np.int64)
        term = pc.dictionary_encode(entries.column("term").combine_chunks()).indices.to_numpy(zero_copy_only=False).astype(np.int64)
        group = pc.index_in(entries.column("source"), names).to_numpy().astype(np.int64)
        value = accumulate(term, group, entries.column("p").to_numpy().astype(np.int64), absent, rows)
        if key[1].as_py() == 0:  # what all terms would give if absent from both, once
            value += terms[0] * np.abs(absent[rows][:, None] - absent[None])
        a, b = np.repeat(rows, len(names)), np.tile(np.arange(len(names)), len(rows))
        other = a != b
        lang = pa.array([key[0].as_py()] * int(other.sum()), pa.string())
        return pa.table([lang, names.take(pa.array(a[other])), names.take(pa.array(b[other])), pa.array(value.ravel()[other])], schema=empty)

    empty = pa.schema([("lang", pa.string()), ("source", pa.string()), ("peer", pa.string()), ("value", pa.int64())])
    keys = ["lang", "block", "tile"]
    partial = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, SUMS)
    return partial.groupBy("lang", "source", "peer").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = 50) -> DataFrame:
    """lang, source, part, item, value and rank: a group's distances to its language's other sources, and its most over-used terms.

    A null text, lang or source counts as ''. Repeated rows count each; ties go to the smaller item; a language without a
    kept term gives distances of 0 and no terms, an only source no pairs, an empty table an empty result. A long text
    counts whole; other columns are ignored.
    """
    entries, groups = kept_counts(docs, least_docs)
    pairs = pair_distances(entries, groups).select("lang", "source", F.lit("pair").alias("part"), C("peer").alias("item"), "value")
    rates = entries.join(groups.drop("absent"), ["lang", "source"]).select("lang", "source", "term", share("count", "total", "terms").alias("p"), share("lang_count", "lang_total", "terms").alias("q"))
    over = rates.where("p > q").select("lang", "source", F.lit("term").alias("part"), C("term").alias("item"), (C("p") - C("q")).alias("value"))
    order = W.partitionBy("lang", "source").orderBy(C("value").desc(), "item")
    ranked = lambda d: d.withColumn("rank", F.row_number().over(order))
    return ranked(pairs).unionByName(ranked(over).where(C("rank") <= top))  # Spark keeps the first `top` of a group before it shuffles


ORACLE = r"""WITH docs AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
tok AS (SELECT r, lang, source, unnest(w) AS t FROM docs),
kept AS (SELECT lang, t, count(*) AS n FROM tok GROUP BY lang, t HAVING count(DISTINCT r) >= {least}),
ks AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, CAST(sum(n) AS HUGEINT) AS n FROM kept GROUP BY lang),
own AS (SELECT lang, source, t, count(*) AS c FROM tok SEMI JOIN kept USING (lang, t) GROUP BY ALL),
grp AS (SELECT d.lang, d.source, coalesce(sum(o.c), 0) AS n FROM (SELECT DISTINCT lang, source FROM docs) d LEFT JOIN own o ON o.lang = d.lang AND o.source = d.source GROUP BY ALL),
full_rows AS (SELECT g.lang, g.source, k.t, coalesce(o.c, 0) AS c,
    CAST(1 + (1000000000::HUGEINT * (coalesce(o.c, 0) + 5)) // (g.n + 5 * s.v) AS BIGINT) AS p, CAST(1 + (1000000000::HUGEINT * (k.n + 5)) // (s.n + 5 * s.v) AS BIGINT) AS q
  FROM grp g JOIN kept k ON k.lang = g.lang JOIN ks s ON s.lang = g.lang LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source AND o.t = k.t),
dist AS (SELECT a.lang, a.source, b.source AS item, CAST(sum(abs(a.p - b.p)) AS BIGINT) AS value FROM full_rows a JOIN full_rows b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(d.value, 0) AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN dist d ON d.lang = a.lang AND d.source = a.source AND d.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, t AS item, p - q AS value FROM full_rows WHERE c > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM (FROM pairs UNION ALL FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {top}"""
