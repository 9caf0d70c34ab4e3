"""Byte-level BPE by prefix-sharing tries.

The distinct words of a block of texts go into one trie of bytes. A depth-first walk gives every node the last token of
its prefix's encoding: it is the one token ending there that is compatible with the last token of the prefix it leaves.
The encoding of a word is read off by stepping back over the last tokens, and a prefix that many words share is
encoded once. Two neighbouring tokens are compatible if the merges, applied to their bytes alone, give those two tokens.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import encode_column, parts, pick, pieces_of

BLOCK = 8 << 20  # bytes of text whose chunks are told apart together

# The word pattern of the byte-level pre-tokenizer: a fixed value of the vocabulary's format.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_names() -> dict[str, int]:
    """The format's printable stand-in of every byte."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Token bytes, ids and merge ranks of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        names, model = byte_names(), data["model"]
        raw = lambda s: bytes(names[c] for c in s)
        self.ids = {raw(s): i for s, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        self.bytes_of = {i: b for b, i in self.ids.items()} | {i: s.encode() for s, i in self.special.items()}
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = (raw(s) for s in (pair.split(" ") if isinstance(pair, str) else pair))
            self.merges[self.ids[left], self.ids[right]] = (rank, self.ids[left + right])
        self.single = [self.ids[bytes([b])] for b in range(256)]
        self.compatible: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        self._suffixes()
        self.flat = np.frombuffer(b"".join(self.bytes_of[i] for i in sorted(self.bytes_of)), np.uint8)
        numbers = np.array(sorted(self.bytes_of), np.int64)
        self.size_of = np.zeros(int(numbers[-1]) + 1, np.int64)
        self.size_of[numbers] = [len(self.bytes_of[i]) for i in numbers.tolist()]
        self.at = np.cumsum(self.size_of) - self.size_of

    def _suffixes(self) -> None:
        """An automaton over the tokens' bytes: `ending[state]` are the tokens (id, length) that end there, longest first."""
        self.goto: dict[int, int] = {}
        parent, byte, own = [0], [0], [None]
        for data, token in self.ids.items():
            state = 0
            for b in data:
                to = self.goto.get(state << 8 | b)
                if to is None:
                    to = self.goto[state << 8 | b] = len(parent)
                    parent.append(state)
                    byte.append(b)
                    own.append(None)
                state = to
            own[state] = (token, len(data))
        depth = [0] * len(parent)
        for state in range(1, len(parent)):
            depth[state] = depth[parent[state]] + 1
        self.fail, self.ending = [0] * len(parent), [()] * len(parent)
        self.step: dict[int, int] = {}  # transitions taken so far, failures resolved
        for state in np.argsort(depth, kind="stable").tolist()[1:]:
            if parent[state]:
                self.fail[state] = self.next(self.fail[parent[state]], byte[state])
            rest = self.ending[self.fail[state]]
            self.ending[state] = (own[state], *rest) if own[state] else rest

    def next(self, state: int, byte: int) -> int:
        key = state << 8 | byte
        if (found := self.step.get(key)) is None:
            at = state
            while (found := self.goto.get(at << 8 | byte)) is None and at:
                at = self.fail[at]
            if len(self.step) > 500_000:
                self.step.clear()
            found = self.step[key] = found or 0
        return found

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the tokens one after the other."""
        size = self.size_of[ids]
        return self.flat[np.arange(int(size.sum())) + np.repeat(self.at[ids] - (np.cumsum(size) - size), size)]

    def merge(self, data: bytes) -> list[int]:
        """The merges, lowest rank first, on a short piece; used only on pairs of tokens."""
        ids = [self.single[b] for b in data]
        while len(ids) > 1:
            rank, at, new = min(((*self.merges[p], i) for i, p in enumerate(zip(ids, ids[1:])) if p in self.merges), default=(0, 0, -1), key=lambda m: (m[0], m[2]))
            if new < 0:
                break
            ids[new : new + 2] = [at]
        return ids

    def is_whole(self, token: int) -> bool:
        if (found := self.whole.get(token)) is None:
            found = self.whole[token] = self.merge(self.bytes_of[token]) == [token]
        return found

    def fits(self, left: int, right: int) -> bool:
        if (found := self.compatible.get(left << 32 | right)) is None:
            if len(self.compatible) > 1_000_000:
                self.compatible.clear()
            found = self.compatible[left << 32 | right] = self.merge(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return found


class Trie:
    """Distinct words as a trie, kept as its depth-first order: sorted, a word leaves the path of its predecessor where their common prefix ends."""

    def __init__(self, words):
        self.words = sorted(words)

    def encode(self, v: Vocabulary) -> dict[bytes, bytes]:
        """Every word's ids as little-endian 32-bit integers."""
        out, sizes = {}, v.size_of.tolist()
        last, states, before = [], [0], b""  # last token and automaton state of every prefix on the path
        step, ending, compatible = v.step, v.ending, v.compatible
        for word in self.words:
            n, most = 0, min(len(before), len(word))
            if before[:most] == word[:most]:
                n = most
            else:
                while before[n] == word[n]:
                    n += 1
            del last[n:], states[n + 1 :]
            state = states[n]
            for end in range(n, len(word)):
                found = step.get(state << 8 | word[end])
                state = v.next(state, word[end]) if found is None else found
                states.append(state)
                for token, length in ending[state]:
                    if length <= end:
                        left = last[end - length]
                        fits = compatible.get(left << 32 | token)
                        if fits or fits is None and v.fits(left, token):
                            last.append(token)
                            break
                    elif v.is_whole(token):
                        last.append(token)
                        break
            before, at, tokens = word, len(word), []
            while at:
                tokens.append(last[at - 1])
                at -= sizes[tokens[-1]]
            tokens.reverse()
            out[word] = array("I", tokens).tobytes()
        return out


class TrieTokenizer:
    """Texts to ids and back."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.words = regex.compile(WORDS)
        special = sorted(self.vocabulary.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.known: dict[str, bytes] = {}  # words encoded lately; a bounded cache
        self.starts = tuple(special)

    def _encode_new(self, chunks: list[str]) -> list[bytes]:
        """Words that were not met lately go into one trie; special tokens stand as they are."""
        find, special = self.words.findall, self.special
        parts = [[c] if special is None or "<" not in c else special.split(c) for c in chunks]
        words = [find(p[0]) for p in parts]
        more = {i: [find(x) if k % 2 == 0 else x for k, x in enumerate(p)] for i, p in enumerate(parts) if len(p) > 1}
        if len(self.known) > 300_000:
            self.known = {}
        known = self.known
        new = set(itertools.chain.from_iterable(words)).union(*(w for p in more.values() for w in p[::2])) - known.keys()
        of = {w.encode(): w for w in new}
        for data, ids in Trie(of).encode(self.vocabulary).items():
            known[of[data]] = ids
        get, token = known.__getitem__, self.vocabulary.special
        out = [b"".join(map(get, w)) for w in words]
        for i, p in more.items():
            out[i] = b"".join(token[x].to_bytes(4, "little") if k % 2 else b"".join(map(get, x)) for k, x in enumerate(p))
        return out

    def _spaced(self, chunks: list[str]) -> list[bytes | None]:
        """Chunks with a space before them; None for those before which a text must not be cut."""
        cut = [bool(c) and not c[0].isspace() and not c.startswith(self.starts) for c in chunks]
        ids = iter(self._encode_new([" " + c for c, ok in zip(chunks, cut) if ok]))
        return [next(ids) if ok else None for ok in cut]

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return encode_column(texts, self._spaced, self._encode_new, lambda text: self._encode_new([text])[0])

    def encode(self, texts: list[str]) -> list[bytes]:
        return pieces_of(*self.encode_column(pa.array(texts, pa.string())))

    def decode(self, ids: bytes) -> str:
        return self.decode_all([ids])[0]

    def decode_all(self, encoded: list[bytes]) -> list[str]:
        ids = np.frombuffer(b"".join(encoded), "<u4")
        data, size = self.vocabulary.decode(ids).tobytes(), self.vocabulary.size_of[ids]
        ends = np.append(0, np.cumsum(size))[np.cumsum([0, *(len(e) // 4 for e in encoded)])].tolist()
        return [data[i:j].decode("utf-8", "replace") for i, j in zip(ends, ends[1:])]


@functools.lru_cache(maxsize=2)
def tokenizer_of(path: str) -> TrieTokenizer:
    """One per worker process, so that what it has learned serves later tasks."""
    return TrieTokenizer(path)


def encode_decode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit integers) and decoded text of every text.

    A null text counts as empty and an empty text has no ids; ids of repeated rows are equal; a null doc_id is kept; an
    empty table gives an empty result; other columns are ignored, whatever their names.
    """

    def run(batches):
        tokenizer = tokenizer_of(vocabulary)
        for batch in parts(batches, BLOCK):
            encoded = pieces_of(*tokenizer.encode_column(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(encoded, pa.binary()), pa.array(tokenizer.decode_all(encoded), pa.string())], ["doc_id", "ids", "decoded"])

    return pick(docs, doc_id="bigint", text="string").mapInArrow(run, "doc_id bigint, ids binary, decoded string")


def round_trip_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens and the sha256 digests of ids and decoded text; digests are taken where the ids are."""

    def run(batches):
        tokenizer = tokenizer_of(vocabulary)
        for batch in parts(batches, BLOCK):
            encoded = pieces_of(*tokenizer.encode_column(batch.column("text")))
            digest = [hashlib.sha256(e).hexdigest() for e in encoded]
            back = [hashlib.sha256(t.encode()).hexdigest() for t in tokenizer.decode_all(encoded)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(e) // 4 for e in encoded], pa.int64()), pa.array(digest), pa.array(back)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return pick(docs, doc_id="bigint", text="string").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
