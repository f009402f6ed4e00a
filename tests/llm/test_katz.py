"""Katz back-off against plain Python: probabilities of orders 2 and 3, and that they sum to one after every history."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import katz
from millrace.llm.katz import DISCOUNTED, SPARE, discounts

END = "\0end"


class Plain:
    def __init__(self, texts, order):
        self.order, self.count, self.followers = order, Counter(), defaultdict(set)
        for t in texts:
            for h, w in self.tokens(t):
                for k in range(len(h) + 1):
                    self.count[h[len(h) - k :] + (w,)] += 1
                    self.followers[h[len(h) - k :]].add(w)
        self.n = sum(c for g, c in self.count.items() if len(g) == 1)
        self.history = Counter({(END,): len(texts)})
        for g, c in self.count.items():
            if g[-1] != END:
                self.history[g] += c
        self.d = {k: discounts(np.array([sum(c == r for g, c in self.count.items() if len(g) == k) for r in range(1, DISCOUNTED + 2)])) for k in range(1, order + 1)}

    def tokens(self, text):
        words = [*(text or "").lower().split(), END]
        for i, w in enumerate(words):
            yield tuple([END, *words[:i]][-(self.order - 1) :]), w

    def reduced(self, g):
        c = self.count[g]
        return c * (self.d[len(g)][c] if c <= DISCOUNTED else 1)

    def p(self, h, w):
        if not h:
            if self.count[(w,)]:
                return self.reduced((w,)) / (self.n + SPARE)
            return (SPARE + sum(c - self.reduced(g) for g, c in list(self.count.items()) if len(g) == 1)) / (self.n + SPARE)
        if self.count[h + (w,)]:
            return self.reduced(h + (w,)) / (self.history[h] + SPARE)
        return self.weight(h) * self.p(h[1:], w)

    def weight(self, h):
        if not self.history[h]:
            return 1.0
        left = (SPARE + sum(self.count[h + (w,)] - self.reduced(h + (w,)) for w in self.followers[h])) / (self.history[h] + SPARE)
        return left / (1 - sum(self.p(h[1:], w) for w in self.followers[h]))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    words = ["a", "b", "c", "dd", "ee", "rare1", "rare2"]
    pick = lambda: rng.choices(words, [30, 20, 10, 5, 3, 1, 1])[0]
    out = [(k, " ".join(pick() for _ in range(rng.randint(0, 25)))) for k in range(60)]
    return out + [(100, None), (101, ""), (102, "a b unseen c new"), (103, "a a a a a"), (103, "a a a a a"), (104, "unseen new unseen")]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores(spark, texts, order):
    train = [t for k, t in texts if k % 3]
    model = Plain(train, max(order, 1)) if order > 1 else None
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3)
    found = katz.score(docs, F.col("doc_id") % 3 != 0, order).collect()
    assert len(found) == len(texts)
    if order == 1:
        assert all(math.isfinite(r.score) and r.score < 0 for r in found)
        return
    want = {(k, t): sum(math.log10(model.p(h, w)) for h, w in model.tokens(t)) for k, t in texts}
    by = defaultdict(list)
    for k, t in texts:
        by[k, len(list(model.tokens(t)))].append(want[k, t])
    for r in found:
        assert any(math.isclose(r.score, x, rel_tol=1e-9) for x in by[r.doc_id, r.n_tokens])
    vocabulary = [g[0] for g in model.count if len(g) == 1] + ["never seen"]
    histories = {h[len(h) - k :] for _, t in texts for h, _ in model.tokens(t) for k in range(len(h) + 1)}
    assert len(histories) > 10
    for h in histories:
        assert math.isclose(sum(model.p(h, w) for w in vocabulary), 1, abs_tol=1e-9)


def test_no_training_rows_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    assert {(r.doc_id, r.score, r.n_known, r.train_tokens) for r in katz.score(docs, F.lit(False)).collect()} == {(1, 0.0, 0, 0), (2, 0.0, 0, 0)}
    assert katz.score(docs.limit(0), F.lit(True)).collect() == []
