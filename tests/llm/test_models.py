"""Learned operators: the language model against its definition, classifiers by held-out accuracy, and the pipeline."""

import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import SCHEMA, awkward, documents, rows

import corpus_pipeline
from tapeline.llm import backoff_lm, langid, toxicity
from tapeline.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")


def fold(doc, parts):
    return zlib.crc32(str(doc).encode()) % parts if doc is not None else None


def brute_scores(docs, mu):
    texts = [(d, fold(d, 7) == 2, (t or "").encode().lower().split()) for d, t in docs]
    uni, big, hist = Counter(), Counter(), Counter()
    for _, held, w in texts:
        if not held:
            path = [b"\r", *w, b"\n"]
            uni.update(path[1:])
            hist.update(path[:-1])
            big.update(zip(path, path[1:]))
    n, v, out = sum(uni.values()), len(uni), []
    for d, held, w in texts:
        path = [b"\r", *w, b"\n"]
        p0 = {t: (uni[t] + 1) / (n + v + 1) for t in path[1:]}
        base = sum(math.log10(p0[t]) for t in path[1:])
        model = sum(math.log10((big[h, t] + mu * p0[t]) / (hist[h] + mu)) for h, t in zip(path, path[1:]))
        out.append((d, held, len(path) - 1, sum(uni[t] > 0 for t in path[1:]), n, base, model))
    return out


@pytest.mark.parametrize("chars,tokens", [(12 << 20, 1_500_000), (50, 40)])
def test_language_model(spark, monkeypatch, chars, tokens):
    monkeypatch.setattr(backoff_lm, "BUCKET_TOKENS", tokens)
    monkeypatch.setattr(backoff_lm, "BLOCK_CHARS", chars)
    extra = [(100 + i, f"the fox {'and the dog' if i % 3 else 'or a cat'} ran") for i in range(30)]
    docs = documents(spark, extra=[*extra, (100, extra[0][1]), (None, "the fox")])
    want = sorted(brute_scores([(r["doc_id"], r["text"]) for r in docs.collect()], 100.0), key=repr)
    got = rows(backoff_lm.score(docs, mu=100.0))
    assert [g[:5] for g in got] == [w[:5] for w in want] and any(w[1] for w in want)
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9)
    assert backoff_lm.score(spark.createDataFrame([], SCHEMA)).count() == 0


def test_model_sums_to_one():
    block = backoff_lm.Block([3, 2], [False, False], backoff_lm.small(np.array([0, 1, 0, 1, 2])), np.array([11, 12, 13], "<u8").tobytes())
    words, pairs = (c.astype(np.int64) for _, c in block.asked())
    n, v, mu = int(words.sum()), int((words > 0).sum()), 5.0
    p0 = {t: (words[t] + 1) / (n + v + 1) for t in range(block.end + 1) if words[t]}
    seen = words[0]  # of the state of word 0
    joint = {int(t): int(c) for h, t, c in zip(block.arc_state, block.arc_symbol, pairs) if h == 0}
    known = sum((joint.get(t, 0) + mu * p) / (seen + mu) for t, p in p0.items())
    assert math.isclose(known + mu / (n + v + 1) / (seen + mu), 1)


LANGS = {"xx": "badu kelo mirra tonso", "yy": "śćię czasz ptrzy kwąt", "zz": "the thing with whole shout"}


def labelled(spark, n=240, seed=6):
    rng, out = random.Random(seed), []
    for i in range(n):
        lang = rng.choice(list(LANGS))
        out.append((i, " ".join(rng.choice(LANGS[lang].split()) for _ in range(rng.randint(3, 200))), lang, "s", 1, "own", 7, 3, "own"))
    return spark.createDataFrame(out, SCHEMA)


def test_language_id(spark):
    docs = labelled(spark)
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    got = langid.identify(docs).collect()
    assert all(r["held_out"] == (fold(r["doc_id"], 3) == 1) and 0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    assert len(got) == 240 and sum(truth[r["doc_id"]] == r["lang_pred"] for r in held) >= 0.97 * len(held)


def test_language_id_edge_cases(spark):
    got = langid.identify(awkward(spark)).collect()
    assert len(got) == awkward(spark).count()
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in got if r["doc_id"] in (0, 1, 2, 8))
    assert len({(r["lang_pred"], r["score"]) for r in got if r["doc_id"] == 5}) == 1
    assert langid.identify(spark.createDataFrame([], SCHEMA)).count() == 0
    kept = langid.drop_unknown(awkward(spark))
    assert kept.columns == awkward(spark).columns and {r["doc_id"] for r in kept.collect()}.isdisjoint({0, 1, 2, 8})


def test_windows_cover_the_text():
    for n in (0, 1, 3, 4, 255, 256, 257, 509, 510, 5000):
        x = langid.windows_of("".join(chr(97 + i % 26) for i in range(n)))
        grams = {bytes(row[i : i + 4]) for row in x for i in range(langid.WINDOW - 3)}
        text = bytes(97 + i % 26 for i in range(n))
        assert all(text[i : i + 4] in grams for i in range(n - 3)) and (n < 4 or len(x) == max(1, -(-(n - 3) // 253)))


def test_tables_equal_the_filters():
    rng = np.random.default_rng(0)
    net = langid.fit(rng.integers(0, 256, (64, langid.WINDOW)).astype(np.uint8), rng.integers(0, 2, 64), ["a", "b"], epochs=1)
    x = rng.integers(0, 256, (3, langid.WINDOW)).astype(np.uint8)
    parts = [sum(f[j][x[:, j : langid.WINDOW - w + 1 + j]] for j in range(w)).max(axis=1) for w, f in net.filters.items()]
    assert np.allclose(net.pooled(x, net.tables()), np.maximum(np.concatenate(parts, axis=1) + net.bias, 0), atol=1e-4)


BAD = ["vile", "rotten", "filth"]


def spiced(spark, n=900, seed=8):
    rng, words = random.Random(seed), [f"w{i}" for i in range(400)]
    docs, labels = [], []
    for i in range(n):
        text, toxic = [rng.choice(words) for _ in range(rng.randint(5, 120))], int(rng.random() < 0.15)
        if toxic:
            for _ in range(3):
                text[rng.randrange(len(text))] = rng.choice(BAD).upper() + "!"
            text.append(rng.choice(BAD))
        docs.append((i, " ".join(text), "en", "s", 1, "own", 7, 3, "own"))
        if rng.random() < 0.6:
            labels.append((i, 1, toxic, "own"))
    truth = {d[0]: any(b in d[1].lower() for b in BAD) for d in docs}
    return spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([*labels, (None, 1, 1, "own"), (3, 1, None, "own")], "doc_id bigint, quality int, toxic int, text string"), truth


def test_toxicity(spark):
    docs, labels, truth = spiced(spark)
    got = toxicity.toxicity(docs, labels).collect()
    assert all(r["held_out"] == (fold(r["doc_id"], 4) == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(truth[r["doc_id"]] == r["predicted"] for r in held) >= 0.98 * len(held)
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    left = {r["doc_id"] for r in kept.collect()}
    assert sum(truth[d] for d in left) <= 0.05 * sum(truth.values()) and sum(not truth[d] for d in left) >= 0.99 * sum(not t for t in truth.values())


def test_toxicity_edge_cases(spark):
    docs, labels, _ = spiced(spark, 300)
    both = awkward(spark)
    got = toxicity.toxicity(both, labels.limit(0)).collect()
    assert len(got) == both.count() and all(r["predicted"] == 0 for r in got)
    assert toxicity.toxicity(both.limit(0), labels).count() == 0
    got = toxicity.toxicity(docs.unionByName(awkward(spark)), labels).collect()
    assert len(got) == 300 + awkward(spark).count()


def test_risk_is_kept_from_going_below_zero():
    rows = [[0]] * 40 + [[]] * 40 + [[0]] * 2  # unlabelled texts hold fewer of the toxic word than the prior says
    positive = np.array([True] * 40 + [False] * 42)
    weights, bias = toxicity.fit(rows, positive, 1, prior=0.3)
    assert np.isfinite(weights).all() and weights[0] > 0 and 1 / (1 + math.exp(-bias)) <= 0.3


@needs_tables
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_sql(spark, name):
    import duckdb
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLES[name]).df()
    keys = [c for c in sorted(got.columns) if got[c].dtype != float]
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    got, want = (d.sort_values(keys).reset_index(drop=True) for d in (got, want))
    for c in got.columns:
        assert (np.isclose(got[c], want[c]) if got[c].dtype == float else got[c] == want[c]).all(), c


@needs_tables
def test_pipeline_equals_brute_force(spark):
    """Every stage on the rows that its predecessor kept: texts scored one by one, near copies by five-word Jaccard similarity in the order of doc_id."""
    from test_nearcopies import one_by_one
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    toxic = {r["doc_id"] for r in toxicity.toxicity(docs, labels).where("predicted = 1").collect()}
    first = docs.where(~docs["doc_id"].isin(list(toxic) or [-1]))
    network = langid.train(first, unknown=True)
    tables = network.tables()
    text = {r["doc_id"]: r["text"] or "" for r in first.collect()}
    said = {r["doc_id"]: network.predict(r["text"], tables) for r in first.collect()}
    known = {d for d, (lang, p) in said.items() if lang != "und" or 0 < p and (p <= 0.6 or len(text[d]) < 128)}
    left = [(r["doc_id"], r["text"]) for r in first.collect() if r["doc_id"] in known]
    kept = {left[i][0] for i in one_by_one(left)}
    got = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in got.collect()} == kept and 0 < len(kept) < len(left) < docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language_id", "simhash_near_dedup", "best_fit_packing"]


def spoken(spark, n=240):
    """Texts of two languages, some labelled."""
    rng, out = random.Random(6), []
    stems = {"aa": ["the", "and", "ing", "tion", "er", "th", "ou"], "bb": ["der", "ung", "sch", "ein", "keit", "ich", "zu"]}
    for i in range(n):
        lang = rng.choice(["aa", "bb"])
        text = " ".join("".join(rng.choices(stems[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(20, 200)))
        out.append((i, text, lang if i % 5 else None, "s", 1, "own", 7, 3, "own"))
    return spark.createDataFrame(out, SCHEMA)


def test_language_stage_rejects_what_is_in_no_language(spark):
    clean, rng = spoken(spark), random.Random(7)
    shuffled = ["".join(rng.sample(t, len(t))) for t in (r["text"] for r in clean.limit(8).collect())]
    letters = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(80)) for _ in range(8)]
    greek = [" ".join("".join(chr(rng.randint(0x3B1, 0x3C9)) for _ in range(rng.randint(2, 9))) for _ in range(60)) for _ in range(4)]
    thai = [" ".join("".join(chr(rng.randint(0xE01, 0xE2E)) for _ in range(rng.randint(2, 9))) for _ in range(60)) for _ in range(4)]
    none = [None, "", "12 34", "..."]
    rows = [(1000 + i, t, "aa", "s", 1, "own", 7, 3, "own") for i, t in enumerate([*shuffled, *letters, *greek, *thai, *none])]
    both = clean.unionByName(spark.createDataFrame([(*r[:2], None, *r[3:]) for r in rows], SCHEMA))
    kept = langid.drop_unknown(both)
    left = {r["doc_id"] for r in kept.collect()}
    assert kept.columns == both.columns
    assert len([i for i in range(240) if i in left]) >= 238 and len([i for i in left if i >= 1000]) <= 1
    assert langid.drop_unknown(clean.limit(0)).count() == 0 and langid.drop_unknown(clean.withColumn("lang", clean["lang"].substr(9, 1)).where("lang is null")).count() == 0


def test_filters_of_empty_and_awkward_tables(spark):
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert toxicity.drop_toxic(awkward(spark).limit(0), labels).count() == 0
    assert toxicity.drop_toxic(awkward(spark), labels).count() == awkward(spark).count()  # nothing toxic is known


def test_network_gradient_descends(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(97, 101, (120, 64)).astype(np.uint8)
    x[:60, ::2] = 120
    y = np.repeat([0, 1], 60)
    net = langid.fit(x, y, ["a", "b"], epochs=12)
    assert (net.probabilities(x, net.tables()).argmax(axis=1) == y).mean() > 0.97
