"""Periodic runs, quality classifier and source divergence against brute force, finite differences, SQL and held-out labels."""

import hashlib
import os
import random
import zlib
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from helpers import SCHEMA, TEXTS, awkward, documents, rows

from check import compare
from tapeline.llm import divergence, quality, runs

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")


def brute_runs(w):
    out = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(6, 4 * q):
                out.setdefault((s, i + q), q)
    return sorted(((s, e - s, q) for (s, e), q in out.items()), key=lambda r: (r[0], r[2]))


def words_lists(seed, trials):
    rng = random.Random(seed)
    for _ in range(trials):
        w = [b"%d" % rng.randint(0, rng.choice([0, 1, 1, 2, 7])) for _ in range(rng.choice([0, 1, 5, 6, 20, 60, 150]))]
        if w and rng.random() < 0.6:
            a = rng.randrange(len(w))
            p = rng.randint(1, max(1, len(w) // 5))
            w = w[:a] + [w[a + i % min(p, len(w) - a)] for i in range(len(w) - a)]
        yield w


def test_runs_of_blocks_equal_brute_force():
    lists, found = list(words_lists(5, 300)), 0
    for i in range(0, len(lists), 7):
        block = lists[i : i + 7]
        for w, r in zip(block, runs.runs_of(block), strict=True):
            assert [tuple(x) for x in r.tolist()] == brute_runs(w)
            found += len(r)
    assert found > 100


def test_fibonacci_words_and_nested_runs():
    a, b = [b"0"], [b"0", b"1"]
    while len(b) < 1500:
        a, b = b, b + a
    nested = ([b"x", b"y"] * 6 + [b"z"]) * 5
    for w in (b, nested, [b"w"] * 3000, b * 2):
        assert [tuple(x) for x in runs.runs_of([w])[0].tolist()] == brute_runs(w)


def test_extensions_equal_plain_comparison():
    rng = np.random.default_rng(3)
    body = np.concatenate([rng.integers(0, 3, 400), np.tile(rng.integers(0, 3, 7), 30), rng.integers(0, 2, 300)])
    numbers = np.concatenate([[90], body, [91]]).astype(np.int32)
    grammar, n = runs.Grammar(numbers), len(numbers)
    a, b = rng.integers(1, n - 1, 4000), rng.integers(1, n - 1, 4000)
    a, b = a[a != b], b[a != b]
    plain = lambda i, j, d: next(k for k in range(n) if numbers[i + d * k] != numbers[j + d * k])
    low, high = np.minimum(a, b), np.maximum(a, b)
    assert grammar.extend(low, high).tolist() == [plain(i, j, 1) for i, j in zip(low, high, strict=True)]
    assert grammar.extend(low, high, back=True).tolist() == [plain(i, j, -1) for i, j in zip(low, high, strict=True)]
    assert np.bincount(grammar.symbols[-1]).max() == 1 and len(grammar.symbols) > 5


def digest_row(doc_id, text):
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(found), *best, None if best[0] is None else 1000 * best[1] // best[2],
            sha("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_run_digests_of_awkward_tables(spark):
    planted = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0][:8]
    extra = [(i, " ".join(f"w{k % 97}" for k in range(50 + 30 * i))) for i in planted]
    extra += [(1000 + k, b" ".join(w).decode()) for k, w in enumerate(words_lists(9, 40))]
    docs = awkward(spark).unionByName(documents(spark, [], extra))
    short = docs.where("length(text) < 20000 or text is null")
    want = [digest_row(r["doc_id"], r["text"]) for r in short.collect()]
    assert rows(runs.run_digests(short)) == sorted(want, key=repr) and sum(w[1] for w in want) > 10
    long = runs.find_runs(docs.where("length(text) >= 20000")).collect()
    assert len(long) == 1 and [tuple(r) for r in long[0]["runs"]] == [(0, 25000, 10)] and long[0]["collapsed"].endswith("over")
    assert rows(runs.run_digests(docs.limit(0))) == []


@needs_tables
def test_run_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = [digest_row(r["doc_id"], r["text"]) for r in docs.collect()]
    assert rows(runs.run_digests(docs)) == sorted(want, key=repr)


def test_quality_gradients_equal_finite_differences():
    texts = [quality.passages_of(t) for t in ("Some words here!! " * 50, "", "one two three " * 70, "A! B? c" * 3)]
    y, bags = np.array([1.0, 0, 1, 0]), quality.Bags(texts)
    stats = np.concatenate([bags.means(bags.shape), bags.extra], axis=1)
    model = quality.start(stats, 0.5)
    _, grads = model.gradients(bags, stats, y)
    rng = np.random.default_rng(0)
    for q, g in zip(model.params, grads, strict=True):
        spots = np.flatnonzero(np.abs(g.ravel()) > 1e-9)
        assert len(spots)
        for k in rng.choice(spots, min(6, len(spots)), replace=False):
            keep, step = q.ravel()[k], 1e-5
            loss = []
            for d in (step, -step):
                q.reshape(-1)[k] = keep + d
                loss.append(model.gradients(bags, stats, y)[0])
            q.reshape(-1)[k] = keep
            assert abs((loss[0] - loss[1]) / (2 * step) - g.ravel()[k]) < 1e-6 + 1e-4 * abs(g.ravel()[k])


def graded(spark, n=400):
    """Good texts of words, and bad ones in which one passage of many is shouted junk."""
    rng, out, labels = random.Random(2), [], []
    for i in range(n):
        w = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(100, 500))]
        bad = i % 4 == 0
        if bad:
            at = rng.randrange(0, len(w) - 70)
            w[at : at + 70] = [x.upper() + "!!" for x in w[at : at + 70]]
        out.append((i, " ".join(w)))
        labels.append((i, 0 if bad else 1, 0, "own"))
    return documents(spark, [], out), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int, text string")


def test_quality_held_out_and_attention(spark):
    docs, labels = graded(spark)
    got = quality.quality(docs.unionByName(awkward(spark).selectExpr("doc_id + 5000 as doc_id", *docs.columns[1:])), labels).collect()
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 5000]
    assert len(held) > 40 and np.mean([r["predicted"] == (r["doc_id"] % 4 != 0) for r in held]) > 0.95
    assert len(got) == 400 + awkward(spark).count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert all(not r["held_out"] for r in got if r["doc_id"] is None)


def test_quality_without_labels_or_rows(spark):
    docs, labels = awkward(spark), spark.createDataFrame([(0, 1), (1, 1), (3, None)], "doc_id bigint, quality int")
    assert {r["score"] for r in quality.quality(docs, labels.limit(0)).collect()} == {0.5}
    assert {r["score"] for r in quality.quality(docs, labels.where("quality = 1")).collect()} == {1.0}
    assert quality.quality(docs.limit(0), labels).collect() == []


@needs_tables
@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="test tables absent")
def test_quality_query_on_held_out_labels(spark):
    from tapeline.llm.queries import op12_quality
    sf = "/root/testdata/sf0.01"
    known = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [r for r in op12_quality(spark, sf).collect() if r["held_out"] and known.get(r["doc_id"]) is not None]
    assert len(held) > 30 and np.mean([r["predicted"] == known[r["doc_id"]] for r in held]) > 0.95


def brute_audit(docs, least=30, top=50):
    groups, langs = {}, {}
    for text, lang, source in docs:
        terms = [t for t in (text or "").encode().translate(divergence.TERM_BYTES).decode().split(" ") if t]
        groups.setdefault((lang or "", source or ""), Counter()).update(terms)
        langs.setdefault(lang or "", (Counter(), Counter()))
        langs[lang or ""][0].update(terms)
        langs[lang or ""][1].update(set(terms))
    out = []
    for lang, (count, df) in langs.items():
        kept = [t for t in count if df[t] >= least]
        own = {s: c for (l, s), c in groups.items() if l == lang}

        def share(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}

        q, p = share(count), {s: share(c) for s, c in own.items()}
        for s in own:
            pairs = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in own if o != s))
            over = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if own[s][t] and p[s][t] > q[t])[:top]
            for part, items in (("pair", pairs), ("term", over)):
                out += [(lang, s, part, item, -v, k) for k, (v, _, item) in enumerate(items, 1)]
    return sorted(out, key=repr)


def corpus(spark):
    rng, out = random.Random(4), []
    for i in range(300):
        lang, source = rng.choice(["en", "en", "de", None, "xx"]), rng.choice(["a", "b", "é", "", None, "s%d" % rng.randint(0, 6)])
        words = [rng.choice(["the", "The", "of", "naïve", "w%d" % rng.randint(0, 3), "x-y", "q" + source if source else "z", "東京"]) for _ in range(rng.randint(0, 30))]
        out.append((i, None if i % 50 == 0 else " ".join(words) if lang != "xx" else "12 345", lang, source))
    return out


def test_divergence_equals_brute_force(spark):
    table = corpus(spark)
    docs = spark.createDataFrame([(i, t, l, s, 1, "own", 7, 3, "own") for i, t, l, s in table], SCHEMA)
    want = brute_audit([(t, l, s) for _, t, l, s in table], 10, 5)
    assert rows(divergence.audit(docs, 10, 5)) == want and {r[2] for r in want} == {"pair", "term"}
    assert any(r[4] == 0 for r in want if r[0] == "xx")  # a language without a kept term
    entries, groups = divergence.kept_counts(docs, 10)
    whole = rows(divergence.pair_distances(entries, groups))
    assert whole == rows(divergence.pair_distances(entries, groups, block_entries=7, tile=2))
    assert [(r[0], r[1], r[2], r[3]) for r in whole] == sorted(((r[0], r[1], r[3], r[4]) for r in want if r[2] == "pair"), key=repr)
    assert rows(divergence.audit(awkward(spark), 1)) == brute_audit([(t, "en", "s") for t in [*TEXTS, TEXTS[5], TEXTS[5], "null id", None]], 1)
    assert rows(divergence.audit(docs.limit(0))) == []


@needs_tables
def test_divergence_query_equals_sql(spark):
    from tapeline.llm.queries import ORACLES, QUERIES
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    msg, _, _, ok = compare(spark, con, SF, "op13_divergence", QUERIES["op13_divergence"], ORACLES["op13_divergence"])
    assert ok, msg
