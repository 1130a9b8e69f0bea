import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from prosa.llm import katz


def words_of(text):
    return [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\n", " ").replace("\t", " ").split(" ") if w] + ["</end>"]


class Brute:
    """Katz back-off over dicts."""

    def __init__(self, texts, order, most=5):
        self.order, self.counts = order, [None] + [Counter() for _ in range(order)]
        for t in texts:
            w = words_of(t)
            for m in range(1, order + 1):
                padded = ["<s>"] * (m - 1) + w
                self.counts[m].update(tuple(padded[i : i + m]) for i in range(len(w)))
        self.factors = [None] + [katz.discounts(np.array([sum(c == r for c in self.counts[m].values()) for r in range(1, most + 2)]), most) for m in range(1, order + 1)]
        self.n, self.v = sum(self.counts[1].values()), len(self.counts[1])
        self.followers = {}
        for m in range(2, order + 1):
            for g, c in self.counts[m].items():
                self.followers.setdefault(g[:-1], []).append((g[-1], c))
        self.alpha = {}

    def cut(self, m, c):
        return c * (self.factors[m][c] if c < len(self.factors[m]) else 1.0)

    def p(self, context, w):
        m = len(context) + 1
        if m == 1:
            freed = self.n - sum(self.cut(1, c) for c in self.counts[1].values())
            below = self.n + (0 if freed > 1e-9 else 1)
            c = self.counts[1][w,]
            return self.cut(1, c) / below if c else (freed if freed > 1e-9 else 1.0) / below if self.n else 1.0
        own = self.followers.get(context)
        if not own:
            return self.p(context[1:], w)
        total, kept = sum(c for _, c in own), sum(self.cut(m, c) for _, c in own)
        below = total + (0 if total - kept > 1e-9 * total else 1)
        c = self.counts[m][(*context, w)]
        if c:
            return self.cut(m, c) / below
        if context not in self.alpha:
            self.alpha[context] = (below - kept) / below / (1 - sum(self.p(context[1:], x) for x, _ in own))
        return self.alpha[context] * self.p(context[1:], w)

    def score(self, text):
        w, s = words_of(text), 0.0
        padded = ["<s>"] * (self.order - 1) + w
        for i, x in enumerate(w):
            s += math.log10(self.p(tuple(padded[i : i + self.order - 1]), x))
        return s


def corpus(n, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words[min(59, int(rng.expovariate(0.12)))] for _ in range(rng.randint(0, 40)))) for i in range(n)]
    return [*rows, (n, None), (n + 1, "W1 w1\tW2\nunseen word here"), (3, "repeated id"), (3, "repeated id"), (None, "w1 w2")]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_equal_a_plain_model(spark, order):
    rows = corpus(150)
    options = katz.KatzOptions(order=order, block_tokens=500, bucket_tokens=100)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 as score", "'x' as block").repartition(3)
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    brute = Brute([t for i, t in rows if not held(i)], order)
    want = Counter()
    for i, t in rows:
        w = words_of(t)
        base = sum(math.log10((brute.counts[1][x,] + 1) / (brute.n + brute.v + 1)) for x in w)
        want[i, held(i), len(w), sum(brute.counts[1][x,] > 0 for x in w), brute.n, round(base, 6), round(brute.score(t), 6)] += 1
    got = katz.score_documents(docs, options).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got) == want


def test_probabilities_of_every_context_sum_to_one():
    """Over all training tokens and the unknown one; corpora without valid Good-Turing discounts included."""
    for n, order in ((150, 2), (60, 3), (3, 2)):
        brute = Brute([t for _, t in corpus(n)], order)
        tokens = [g[0] for g in brute.counts[1]] + ["<unknown>"]
        for context in [(), *list(brute.followers)[:200], *[("never",) * (order - 1)]]:
            if len(context) < order:
                assert sum(brute.p(context, w) for w in tokens) == pytest.approx(1.0, abs=1e-9)


def test_no_training_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = katz.KatzOptions(folds=1, held_out=0)
    row = katz.score_documents(docs, none).first()
    assert (row.held_out, row.n_tokens, row.train_tokens, row.base_score, row.score) == (True, 3, 0, 0.0, 0.0)
    assert katz.score_documents(docs.limit(0)).count() == 0


def test_a_very_long_text(spark):
    """A text of several blocks' size is one block and scored whole."""
    rng = random.Random(3)
    long = " ".join(f"w{rng.randint(0, 300)}" for _ in range(30_000))
    rows = [(0, long), (1, "w1 w2 w3"), (4, "w5 " * 50)]
    brute = Brute([t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2], 2)
    got = {r.doc_id: r for r in katz.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), katz.KatzOptions(block_tokens=1000, bucket_tokens=5000)).collect()}
    assert got[0].n_tokens == 30_001 and all(got[i].score == pytest.approx(brute.score(t), rel=1e-9) for i, t in rows)
