"""The pipeline's near-copy stage against going through the documents one by one."""

import random

import corpus_pipeline
import numpy as np
import pytest
import xxhash
from helpers import SCHEMA, awkward, documents

from tapeline.llm import common, nearcopies, simhash


def shingle_set(text, width=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def one_by_one(docs, least=0.8):
    """Indexes of the (doc_id, text) that stay."""
    stay = []
    for i in sorted(range(len(docs)), key=lambda i: (docs[i][0] is None, docs[i][0] or 0)):
        s = shingle_set(docs[i][1])
        if all(s != t and len(s & t) < least * len(s | t) for t in (shingle_set(docs[j][1]) for j in stay)):
            stay.append(i)
    return stay


def stage(spark, docs):
    return corpus_pipeline.drop_near_duplicates(spark, docs, "")


def changed(rng, text, words, share):
    return " ".join(rng.choice(words) if rng.random() < share else w for w in text.split())


@pytest.mark.parametrize("centres", [8, 1])
def test_planted_near_copies_go(spark, monkeypatch, centres):
    monkeypatch.setattr(nearcopies, "CENTRES", centres)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(2000)]
    base = [" ".join(rng.choices(words, k=rng.randint(100, 300))) for _ in range(40)]
    texts = [changed(rng, base[0], words, 0.02) for _ in range(12)] + base  # a family whose base is not its first
    texts += [changed(rng, t, words, share) for t in base for share in (0.005, 0.01, 0.015, 0.06)]
    want = one_by_one(list(enumerate(texts)))
    assert len(base) < len(want) < len(texts) - 70
    assert sorted(r["doc_id"] for r in stage(spark, documents(spark, texts)).collect()) == want


def test_awkward_rows(spark):
    docs = awkward(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = stage(spark, docs)
    assert got.columns == docs.columns
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in got.collect()))) == sorted(repr(rows[i]) for i in one_by_one(rows))
    assert stage(spark, spark.createDataFrame([], SCHEMA)).count() == 0


def test_texts_with_one_dominant_shingle_stay(spark):
    """Their fingerprints are equal, since one shingle makes up most of each text; the rest of the texts differs."""
    rng = random.Random(4)
    texts = ["x " * 80 + " ".join(f"w{rng.randrange(2000)}" for _ in range(30)) for _ in range(20)]
    assert len({simhash.fingerprint(t) for t in texts}) == 1
    texts += [texts[3] + " more", "x " * 200 + texts[5]]
    assert sorted(r["doc_id"] for r in stage(spark, documents(spark, texts)).collect()) == one_by_one(list(enumerate(texts))) == list(range(20))


def test_simhash_groups_find_candidates(spark):
    rng = random.Random(5)
    base = [" ".join(f"w{rng.randrange(5000)}" for _ in range(3000)) for _ in range(3)]
    texts = base + [t + " end" for t in base] + [" ".join(["same"] * 50 + [f"z{i}"]) for i in range(3)]
    docs = documents(spark, texts)
    assert simhash.fingerprint(texts[6]) == simhash.fingerprint(texts[7])
    got = sorted(r["doc_id"] for r in nearcopies.drop_near_copies(docs, bands=0).collect())  # no MinHash key at all
    near = [i for i in range(3) if (simhash.fingerprint(texts[i]) ^ simhash.fingerprint(texts[i + 3])).bit_count() <= 2]
    assert near and got == [i for i in one_by_one(list(enumerate(texts))) if i < 3 or i > 5] + [i + 3 for i in range(3) if i not in near]


def test_sketches_of_many_texts_equal_those_of_each(spark):
    rng = random.Random(6)
    texts = [None, "", " ", "a", "A  B\tc\x0bd\x1ce é Ü", "x" * 31, "x" * 32 + " y", "x " * 700, "\x00 \x00 b"]
    texts += [" ".join("".join(rng.choices("abcé", k=rng.randint(1, 40))) for _ in range(rng.randint(1, 600))) for _ in range(60)]
    for some in (texts, [None], []):
        words = common.Words(some)
        assert simhash.fingerprints(words).tolist() == [simhash.fingerprint(t) for t in some]
        assert all(map(np.array_equal, nearcopies.shingle_sets(some, words), map(nearcopies.shingles, some)))
        assert common.xxh64_many(words.raw, words.begin, words.end - words.begin, 7).tolist() == [xxhash.xxh64_intdigest(w, 7) for t in some for w in (t or "").encode().lower().split()]


def test_only_fingerprints_that_share_blocks_emit_variants(spark):
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(300)]
    near = {b ^ (1 << i) ^ (1 << j) for b in base[:100] for i, j in [rng.sample(range(64), 2)]}
    signed = [p - (1 << 64) if p >> 63 else p for p in {*base, *near}]
    prints = spark.createDataFrame([(p,) for p in signed], "fp bigint")
    kept = {r["fp"] & (1 << 64) - 1 for r in simhash.close(prints, 2).collect()}
    assert near | {*base[:100]} <= kept and len(kept) < 210
    assert len(simhash.link(prints).collect()) == 100


def test_unlike_texts_of_a_key_take_few_rounds(spark, monkeypatch):
    rng, rounds, of = random.Random(8), [], nearcopies.candidates
    monkeypatch.setattr(nearcopies, "candidates", lambda *a: rounds.append(1) or of(*a))
    texts = [" ".join([f"a{i}" for i in range(60)] + [f"w{rng.randrange(5000)}" for _ in range(40)]) for _ in range(100)]
    got = nearcopies.drop_near_copies(documents(spark, [*texts, texts[70] + " end"]), bands=6, rows=1)
    assert sorted(r["doc_id"] for r in got.collect()) == list(range(100))
    assert 2 <= len(rounds) <= 5
