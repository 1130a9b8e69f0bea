"""Token counts with a linear longest-match automaton.

The vocabulary is a trie of byte strings. Each node has a failure link and the number of pieces that greedy longest matching has
certainly cut off when it fails there: both are computed once, in breadth-first order, from the parent's. A word is then read
once, byte by byte; failing adds the node's count and follows its link, and no piece is ever built. A word is matched with a
space before it, so that pieces with a leading space begin words and others continue them.

Each distinct word of a task is matched once; the counts are kept in a bounded cache of the worker.

Defined cases: a null or wordless text has no tokens; a word that the vocabulary can't spell is one unknown token; a text of any
length is counted whole, in linear time; there are no ties, the longest match is one; repeated rows each get a row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from prosa.llm.common import worker_cache


def bytes_of_alphabet() -> dict[str, int]:
    """The printable characters that byte-level vocabularies write for the 256 bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def byte_level_vocabulary(path: str) -> list[bytes]:
    """The pieces, as bytes, of a tokenizer file with a byte-level model."""
    alphabet = bytes_of_alphabet()
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    return [bytes(map(alphabet.__getitem__, piece)) for piece in vocabulary if all(c in alphabet for c in piece)]


class Automaton:
    """children: node * 256 + byte -> node; fail: the node to go on from, -1 if none; popped: pieces cut off when failing."""

    def __init__(self, vocabulary):
        children: dict[int, int] = {}
        parent, by, final = [0], [0], [False]
        for piece in vocabulary:
            node = 0
            for b in piece:
                key = node << 8 | b
                if key not in children:
                    children[key] = len(parent)
                    parent.append(node)
                    by.append(b)
                    final.append(False)
                node = children[key]
            final[node] = node > 0
        fail, popped = [-1] * len(parent), [0] * len(parent)
        below: list[list[int]] = [[] for _ in parent]
        for v in range(1, len(parent)):
            below[parent[v]].append(v)
        todo = deque(below[0])
        while todo:
            v = todo.popleft()
            todo.extend(below[v])
            if final[v]:
                fail[v], popped[v] = 0, 1
                continue
            u = parent[v]
            at, n = fail[u], popped[u]
            while at >= 0 and (at << 8 | by[v]) not in children:
                n, at = n + popped[at], fail[at]
            if at >= 0:
                fail[v], popped[v] = children[at << 8 | by[v]], n
        self.children, self.fail, self.popped = children, fail, popped

    def count(self, word: bytes) -> int:
        """Pieces of greedy longest matching; 0 if the vocabulary can't spell the word."""
        children, fail, popped = self.children, self.fail, self.popped
        node = n = 0
        for b in word:
            while (following := children.get(node << 8 | b)) is None:
                if fail[node] < 0:
                    return 0
                n += popped[node]
                node = fail[node]
            node = following
        while node:
            if fail[node] < 0:
                return 0
            n += popped[node]
            node = fail[node]
        return n


def automaton_of(path: str) -> Automaton:
    cache = worker_cache("automata")
    if path not in cache:
        cache[path] = Automaton(byte_level_vocabulary(path))
    return cache[path]


def count_tokens(docs: DataFrame, vocabulary: str, cached_words: int = 500_000) -> DataFrame:
    """doc_id, n_words, n_tokens and n_unknown, a row per document."""

    def scan(batches):
        automaton, known = automaton_of(vocabulary), worker_cache(f"token counts {vocabulary}")
        for batch in batches:
            words_of, tokens, unknown = [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                words = (text or b"").split()
                try:
                    counts = list(map(known.__getitem__, words))
                except KeyError:
                    if len(known) > cached_words:
                        known.clear()
                    for w in set(words):
                        if w not in known:
                            known[w] = automaton.count(b" " + w)
                    counts = list(map(known.__getitem__, words))
                missing = counts.count(0)
                words_of.append(len(words))
                tokens.append(sum(counts) + missing)
                unknown.append(missing)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in (words_of, tokens, unknown))], names=["doc_id", "n_words", "n_tokens", "n_unknown"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scan, "doc_id long, n_words long, n_tokens long, n_unknown long")
