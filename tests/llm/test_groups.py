"""Near-duplicate groups, vector links, components and top-k against brute force."""

import itertools
import math
import random

import numpy as np
import pytest
import xxhash
from helpers import SCHEMA, awkward, documents, rows

from tapeline.llm import simhash, topk, vecjoin
from tapeline.llm.components import components


def roots(nodes, edges):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(500, i) for i in range(501, 560)]
    loose = [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(90)]
    edges = [*chain, *star, *loose, *star[:5], (7, 7)]
    rng.shuffle(edges)
    df = spark.createDataFrame([*edges, (None, 3), (4, None)], "a bigint, b bigint")
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    assert rows(components(df, "a", "b")) == sorted(roots(nodes, [e for e in edges if e[0] != e[1]]).items(), key=repr)
    assert components(df.where("a > 10000"), "a", "b").count() == 0


def brute_print(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def brute_groups(docs):
    """(doc_id, hexadecimal fingerprint, component) by comparing all pairs of fingerprints."""
    prints = [(d, brute_print(t)) for d, t in docs]
    own = {p for _, p in prints}
    root = roots(own, [(a, b) for a, b in itertools.combinations(own, 2) if (a ^ b).bit_count() <= 2])
    low = {}
    for d, p in prints:
        if d is not None:
            low[root[p]] = min(d, low.get(root[p], d))
    return [(d, f"{p:016x}", low.get(root[p])) for d, p in prints]


def near_texts(n=60, seed=2):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    out = []
    for i in range(n):
        if out and rng.random() < 0.4:
            text = rng.choice(out).split()
            if rng.random() < 0.6:
                text[rng.randrange(len(text))] = rng.choice(words)
            out.append(" ".join(text))
        else:
            out.append(" ".join(rng.choice(words) for _ in range(rng.randint(200, 400))))
    return out


@pytest.mark.parametrize("table", ["awkward", "near"])
def test_simhash_groups(spark, table):
    docs = awkward(spark) if table == "awkward" else documents(spark, near_texts())
    want = brute_groups([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert rows(simhash.near_duplicates(docs)) == sorted(want, key=repr)
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    firsts = {(d, p) for d, p, c in want if d == c}
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == sorted((d is None, d or 0) for d, _ in firsts)


def test_simhash_empty_and_radius(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    assert simhash.keep_first(spark.createDataFrame([], SCHEMA)).count() == 0
    assert len(simhash.variants(2)) == 65 and len(simhash.variants(4)) == 1 + 64 + 2016
    with pytest.raises(ValueError):
        simhash.variants(3)


def test_simhash_links_join_all_within_the_radius(spark):
    base = [0x0123456789ABCDEF, -1, 0]
    prints = {p ^ (1 << a) ^ (1 << b) for p in base for a in range(0, 20, 3) for b in range(0, 20, 3)} | set(base)
    df = spark.createDataFrame([(p,) for p in prints], "fp bigint")
    mask = (1 << 64) - 1
    links = [(a, b) for a, b in itertools.combinations(prints, 2) if ((a ^ b) & mask).bit_count() <= 2]
    got = {r["node"]: r["root"] for r in components(simhash.link(df), "a", "b").collect()}
    assert {n: got.get(n, n) for n in prints} == roots(prints, links)


VECTORS = "vec_id bigint, embedding array<float>, label int, n bigint, x string, cell int"


def vectors(spark, seed=4):
    rng, out = np.random.default_rng(seed), []
    centres = rng.normal(size=(6, 12))
    for i in range(150):
        v = centres[i % 6] + rng.normal(size=12) * rng.choice([0.05, 0.12, 0.3])
        out.append((i, v.astype(np.float32).tolist(), i % 2))
    out += [(200 + i, out[0][1], 0) for i in range(40)]
    out += [(300, [2 * x for x in out[1][1]], 1), (301, None, 1), (302, [0.0] * 12, 1), (303, [float("nan")] * 12, 1), (304, [None] * 12, 1)]
    out += [(305, [float("inf")] * 12, 1), (306, out[1][1], None), (307, [1.0, 2.0], 1), (308, [1.0, 2.1], 1), (309, [], 1), (None, out[2][1], 0), (5, out[5][1], 1)]
    return spark.createDataFrame([(*r, 9, "own", 3) for r in out], VECTORS), out


def sound(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute_links(table, t=0.93):
    nodes, edges, links = range(len(table)), [], [0] * len(table)
    fit = [sound(v) and any(v) and lab is not None for _, v, lab in table]
    for a, b in itertools.combinations(nodes, 2):
        (_, u, k), (_, v, m) = table[a], table[b]
        if fit[a] and fit[b] and k == m and len(u) == len(v):
            u, v = (np.array(x, np.float32).astype(float) for x in (u, v))
            if u @ v / (np.linalg.norm(u) * np.linalg.norm(v)) >= t:
                edges.append((a, b))
                links[a] += 1
                links[b] += 1
    root, low = roots(nodes, edges), {}
    for n in nodes:
        if table[n][0] is not None:
            low[root[n]] = min(table[n][0], low.get(root[n], table[n][0]))
    return [(table[n][0], links[n], low.get(root[n]), table[n][0] == low.get(root[n])) for n in nodes]


@pytest.mark.parametrize("cell,residents,present", [(4096, 2048, 8192), (7, 5, 6)])
def test_vector_links(spark, monkeypatch, cell, residents, present):
    for name, value in (("CELL", cell), ("RESIDENTS", residents), ("PRESENT", present)):
        monkeypatch.setattr(vecjoin, name, value)
    df, table = vectors(spark)
    want = brute_links(table)
    assert sum(w[1] > 0 for w in want) > 60 and len({w[2] for w in want}) > 10
    assert rows(vecjoin.near_duplicates(df)) == sorted(want, key=repr)
    assert vecjoin.near_duplicates(df.where("vec_id > 9999")).count() == 0


def brute_top(table, k):
    own = [(i, v, [math.floor(64 * float(np.float32(x))) for x in e]) for i, (v, e, _) in enumerate(table) if v is not None and sound(e)]
    out = []
    for i, v, w in own:
        if v % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(w, x)), u) for j, u, x in own if j != i)
            out += [(v, r, u, -s) for r, (s, u) in enumerate(scored[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("k,block", [(20, 4096), (7, 16), (500, 50)])
def test_top_k(spark, k, block):
    df, table = vectors(spark)
    assert rows(topk.search(df, k=k, query_rows=block, candidate_rows=block)) == brute_top(table, k)
    assert topk.search(df.where("vec_id > 9999")).count() == 0


def test_postings_are_exact_for_sparse_and_large_weights():
    rng = np.random.default_rng(0)
    q, c = rng.integers(-9, 9, (40, 30)), rng.integers(-9, 9, (70, 30)) * (rng.random((70, 30)) < 0.2)
    assert np.array_equal(np.stack(list(topk.accumulate(q, c))), q @ c.T)
    big = q * (1 << 26)
    assert np.array_equal(np.stack(list(topk.accumulate(big, c))), big @ c.T)
    with pytest.raises(ValueError):
        list(topk.accumulate(q * (1 << 40), c * (1 << 40)))
