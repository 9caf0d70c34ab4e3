"""Greedy word-piece counts in linear time, without building the pieces.

A trie of the vocabulary gets failure links: where a string can't be extended, its longest pieces are popped from the
front and the link leads to the node of what remains. How many pieces that pops is known beforehand, so one pass over a
word's characters adds up the length of its greedy longest-match segmentation.
"""

from __future__ import annotations

import functools

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .common import pick, spans, texts_of

MARK = "▁"  # the vocabulary's sign for the start of a word


def pieces_of(path: str) -> list[str]:
    """The ordinary pieces of a sentencepiece vocabulary."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    skip = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not skip(i)]


class Automaton:
    """Nodes are prefixes of pieces. `link` is where a node fails to (-1: nowhere), `popped` the pieces that this pops."""

    def __init__(self, pieces: list[str]):
        self.arcs: list[dict[str, int]] = [{}]
        whole = [False]
        for p in pieces:
            node = 0
            for c in p:
                if (to := self.arcs[node].get(c)) is None:
                    to = self.arcs[node][c] = len(self.arcs)
                    self.arcs.append({})
                    whole.append(False)
                node = to
            whole[node] = node > 0
        self.link, self.popped = [-1] * len(whole), [0] * len(whole)
        level = [0]
        while level:  # breadth first: a link leads to a shorter string
            below = []
            for parent in level:
                for c, node in self.arcs[parent].items():
                    below.append(node)
                    if whole[node]:
                        self.link[node], self.popped[node] = 0, 1
                        continue
                    at, n = self.link[parent], self.popped[parent]
                    while at >= 0 and c not in self.arcs[at]:
                        n += self.popped[at]
                        at = self.link[at]
                    if at >= 0:
                        self.link[node], self.popped[node] = self.arcs[at][c], n
            level = below

    def count(self, word: str) -> int:
        """Pieces of the word's greedy segmentation; -1 if it has none."""
        node = n = 0
        for c in word:
            while (to := self.arcs[node].get(c)) is None:
                if self.link[node] < 0:
                    return -1
                n += self.popped[node]
                node = self.link[node]
            node = to
        while node:
            if self.link[node] < 0:
                return -1
            n += self.popped[node]
            node = self.link[node]
        return n


class Counter(dict):
    """Word -> (tokens, unknown words); a word without segmentation is one unknown token."""

    def __init__(self, automaton: Automaton, limit: int = 500_000):
        self.automaton, self.limit = automaton, limit

    def __missing__(self, word: bytes) -> int:
        if len(self) > self.limit:
            self.clear()
        n = self.automaton.count(MARK + word.decode())
        self[word] = n = n if n >= 0 else 1 << 32 | 1  # unknown words are counted in the upper half
        return n


@functools.lru_cache(maxsize=2)
def counter_of(path: str) -> Counter:
    return Counter(Automaton(pieces_of(path)))


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown: greedy word pieces of every whole text, words parted by ASCII white space.

    A null text counts as empty: zeros. Repeated rows are counted each, a null doc_id is kept, an empty table gives an
    empty result; other columns are ignored.
    """

    def run(batches):
        counter = counter_of(vocabulary)
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), texts_of(batch)
            for i, j in spans(texts):
                words = [t.encode().split() for t in texts[i:j]]
                total = [sum(map(counter.__getitem__, w)) for w in words]
                yield pa.RecordBatch.from_arrays([pa.array(ids[i:j], pa.int64()), pa.array(map(len, words), pa.int64()), pa.array([t & 0xFFFFFFFF for t in total], pa.int64()), pa.array([t >> 32 for t in total], pa.int64())], ["doc_id", "n_words", "n_tokens", "n_unknown"])

    return pick(docs, doc_id="bigint", text="string").mapInArrow(run, "doc_id bigint, n_words bigint, n_tokens bigint, n_unknown bigint")
