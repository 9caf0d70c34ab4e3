"""Encoders, packing and token files against the tokenizers library."""

import hashlib
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from helpers import SCHEMA, awkward, documents, rows
from tokenizers import Tokenizer

from tapeline.llm import bpe, packing, tokenfile, wordpiece
from tapeline.session import shared_path

BYTE, WORD, PIECE = (P.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))


def noise(n, seed=3):
    rng = random.Random(seed)
    letters = [*"abcdeABCΣσ  \n\t\x0b\x1c\x85  'sdlm't!!,.$%&0123456789é́ñßüö中文🙂‍﻿\x00<|>İẞ", "<|endoftext|>", "<|startoftext|>", "  ", "'re", " the", " \n", "　", "²"]
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def library(path, texts):
    return [e.ids for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def packed(ids):
    return np.array(ids, "<u4").tobytes()


def test_trie_equals_library_on_noise():
    texts, t = noise(2000), bpe.TrieTokenizer(BYTE)
    assert t.encode(texts) == [packed(i) for i in library(BYTE, texts)]
    plain = Tokenizer.from_file(BYTE)
    assert [t.decode(e) for e in t.encode(texts[:300])] == [plain.decode(i, skip_special_tokens=False) for i in library(BYTE, texts[:300])]


@pytest.mark.parametrize("path,keep", [(BYTE, True), (WORD, False)])
def test_cached_encoder_equals_library(path, keep):
    texts, encoder = noise(2000, 4), packing.encoder_of(path, keep)
    assert encoder.encode(texts) == [packed(i) for i in library(path, texts)]
    old, encoder.limit = encoder.limit, 10  # the cache is cleared on the way
    assert [encoder.encode([t])[0] for t in texts[:200]] == [packed(i) for i in library(path, texts[:200])]
    encoder.limit = old


def test_round_trip_digests(spark):
    docs = awkward(spark)
    pairs = [(r["doc_id"], r["text"]) for r in docs.collect()]
    ids = library(BYTE, [t for _, t in pairs])
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = sorted([(d, len(i), sha(packed(i)), sha((t or "").encode())) for (d, t), i in zip(pairs, ids)], key=repr)
    assert rows(bpe.round_trip_digests(docs, BYTE)) == want
    assert rows(bpe.encode_decode(docs, BYTE).select("doc_id", "decoded")) == sorted([(d, t or "") for d, t in pairs], key=repr)
    assert bpe.round_trip_digests(spark.createDataFrame([], SCHEMA), BYTE).count() == 0


def pieces(docs, size, end):
    out = []
    for d, i in zip([d for d, _ in docs], library(BYTE, [t for _, t in docs])):
        i = [*i, end]
        cuts = [0, len(i)] if len(i) <= size else sorted({0, *range(len(i), 0, -size)})
        out += [(d, p, a, b - a, zlib.crc32(packed(i[a:b]))) for p, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    return out


@pytest.mark.parametrize("size", [16, 1024])
def test_packing_places_every_piece_once(spark, size):
    docs = awkward(spark)
    got = packing.pack(docs, BYTE, size=size)
    want = pieces([(r["doc_id"], r["text"]) for r in docs.collect()], size, 2)
    assert rows(got.select("doc_id", "piece", "start", "length", "ids_crc32")) == sorted(want, key=repr)
    by = defaultdict(list)
    for r in got.collect():
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for run in by.values():
        run.sort()
        assert [o for o, _ in run] == [sum(n for _, n in run[:k]) for k in range(len(run))] and sum(n for _, n in run) <= size
    assert len(by) <= 1.1 * sum(w[3] for w in want) / size + 2
    assert packing.pack(spark.createDataFrame([], SCHEMA), BYTE).count() == 0


def check_plan(lengths, size=1024):
    plan = packing.solve(Counter(lengths), size)
    used, placed = np.zeros(plan.sequences, int), 0
    for length, first, last, each, base, _ in zip(*plan.arrays()):
        k = np.arange(last - first)
        np.add.at(used, base + k // each, length)
        placed += len(k)
    assert placed == len(lengths) and used.max(initial=0) <= size
    return plan.sequences


def test_configuration_program_is_near_its_bound():
    rng = np.random.default_rng(0)
    lengths = np.clip(rng.lognormal(6, 0.9, 60_000).astype(int), 1, 1024).tolist()
    assert check_plan(lengths) <= 1.01 * sum(lengths) / 1024 + 1
    assert check_plan([600] * 5000) == 5000
    assert check_plan([512] * 4001) == 2001
    assert check_plan([1024] * 7 + [1] * 3) == 8
    assert check_plan([]) == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="test tables absent")
@pytest.mark.parametrize("times", [1, 10, 47])
def test_program_places_the_pieces_of_the_tables(times):
    """On real lengths: nine tenths of the short pieces by the program, and never more sequences than best fit alone."""
    import pyarrow.parquet as pq
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()
    lengths = Counter(n for d in packing.encoder_of(BYTE, True).encode([t or "" for t in texts]) for n in [1024] * ((len(d) // 4 + 1) // 1024) + [(len(d) // 4 + 1) % 1024] if n)
    lengths = {n: c * times for n, c in lengths.items()}
    plan, plain = packing.solve(lengths, 1024), packing.Plan(1024)
    packing.best_fit(plain, lengths)
    short = sum(c for n, c in lengths.items() if n < 1024)
    assert plan.by_program >= 0.9 * short and plan.sequences <= plain.sequences
    assert check_plan([n for n, c in lengths.items() for _ in range(c)]) == plan.sequences


def test_best_filling_is_a_knapsack_optimum():
    lengths, gain = np.array([3, 5, 7]), np.array([1.0, 2.0, 3.1])
    fill = packing.best_filling(lengths, gain, 12)
    best = max(a + 2 * b + 3.1 * c for a in range(5) for b in range(3) for c in range(2) if 3 * a + 5 * b + 7 * c <= 12)
    assert abs(sum(gain[k] * n for k, n in fill.items()) - best) < 1e-9


@pytest.mark.parametrize("n,symbols", [(1, 1), (5, 1), (3000, 2), (50_000, 30_000), (1030, 300)])
def test_huffman_round_trip(n, symbols):
    ids = (np.minimum(np.random.default_rng(n).zipf(1.3, n), symbols) - 1).astype("<u4")
    lengths = tokenfile.code_lengths(dict(Counter(ids.tolist())))
    assert sum(2.0**-x for x in lengths.values()) <= 1 and max(lengths.values()) <= 16
    code = tokenfile.Code(lengths)
    payload, at = code.encode(ids)
    assert np.array_equal(code.decode([payload, payload], [at, at], [n, n]), np.concatenate([ids, ids]))


def test_package_merge_is_optimal_under_the_limit():
    assert max(tokenfile.code_lengths({i: 2**i for i in range(30)}).values()) == 16
    assert sorted(tokenfile.code_lengths({1: 1, 2: 1, 3: 2, 4: 4}).values()) == [1, 2, 3, 3]
    assert sorted(tokenfile.code_lengths({1: 1, 2: 1, 3: 2, 4: 4}, limit=2).values()) == [2, 2, 2, 2]


def test_token_file_reads_back(spark):
    docs = awkward(spark)
    pairs = sorted([(r["doc_id"], r["text"]) for r in docs.collect()], key=lambda p: (p[0] is not None, p[0] or 0))
    ids = [[*i, 1] for i in library(WORD, [t for _, t in pairs])]
    got = sorted(tokenfile.round_trip(docs, WORD, shared_path(spark, "tokens")).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [d for d, _ in pairs]
    assert sorted((r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((len(i), zlib.crc32(packed(i))) for i in ids)
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist()
    empty = tokenfile.round_trip(spark.createDataFrame([], SCHEMA), WORD, shared_path(spark, "tokens"))
    assert empty.count() == 0


def greedy(word, pieces):
    n = at = 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return -1
        at, n = end, n + 1
    return n


def test_word_piece_counts_equal_longest_match():
    own = wordpiece.pieces_of(PIECE)
    automaton, known, rng = wordpiece.Automaton(own), set(own), random.Random(5)
    words = ["▁" + "".join(rng.choice("thequickabcérst中x.,9") for _ in range(rng.randint(1, 14))) for _ in range(5000)]
    assert [automaton.count(w) for w in words] == [greedy(w, known) for w in words]
    small = ["a", "abcd", "bc", "b", "cde", "abcdefg", "f"]
    tiny = wordpiece.Automaton(small)
    words = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    assert [tiny.count(w) for w in words] == [greedy(w, set(small)) for w in words]


def test_token_counts(spark):
    known, want = set(wordpiece.pieces_of(PIECE)), []
    for r in awkward(spark).collect():
        words = (r["text"] or "").encode().split()
        n = [greedy("▁" + w.decode(), known) for w in words]
        want.append((r["doc_id"], len(words), sum(x if x >= 0 else 1 for x in n), sum(x < 0 for x in n)))
    assert rows(wordpiece.token_counts(awkward(spark), PIECE)) == sorted(want, key=repr)
    assert wordpiece.token_counts(documents(spark, []), PIECE).count() == 0
