"""Small parts against plain Python: the segmentation search, the FTRL updates, and disclosure by co-occurrence."""

import itertools
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from millrace.llm import pieces, pii, quality


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.pieces(pieces.MODEL)


def test_segmentations_against_all(vocabulary):
    rng = random.Random(6)
    words = {pieces.MARK + "".join(rng.choice("thein▁a漢") for _ in range(rng.randint(0, 8))).replace(pieces.MARK, pieces._INNER) for _ in range(80)} | {"▁▁", "▁", "▁the", "the"}
    words = sorted(words)
    for word, ids in zip(words, vocabulary.encode_sorted(words), strict=True):
        best, want = -math.inf, None
        for cut in itertools.product([0, 1], repeat=len(word) - 1):
            ends = [k + 1 for k, c in enumerate(cut) if c] + [len(word)]
            spans = list(zip([0, *ends[:-1]], ends, strict=True))
            score, out = 0.0, []
            for a, b in spans:
                piece = word[a:b]
                if piece in vocabulary.score:
                    score += vocabulary.score[piece][0]
                    out.append(vocabulary.score[piece][1])
                elif b - a == 1:
                    score += vocabulary.unknown
                    out += [vocabulary.byte[x] for x in {pieces._INNER: pieces.MARK, pieces.MARK: " "}.get(piece, piece).encode()]
                else:
                    break
            else:
                key = (score, [b - a for a, b in reversed(spans)])
                if want is None or key > best:
                    best, want = key, out
        assert ids == want, word


def test_words_alone_or_together(vocabulary):
    words = sorted({"▁" + "".join(random.Random(k).choice("abdehint") for _ in range(1 + k % 9)) for k in range(200)})
    assert vocabulary.encode_sorted(words) == [vocabulary.encode_sorted([w])[0] for w in words]


def test_ftrl_against_plain_updates():
    rng = random.Random(3)
    examples = []
    for _ in range(40):
        index = sorted(rng.sample(range(1, 60), rng.randint(0, 8)))
        examples.append((np.array([0, *index], dtype=np.int32), np.array([1.0, *(rng.random() for _ in index)], dtype=np.float32), rng.randint(0, 1)))
    model = quality.ftrl(examples, passes=3)
    z, n, rate = defaultdict(float), defaultdict(float), defaultdict(lambda: 20.0, {0: 0.1})

    def weight(i):
        return 0.0 if abs(z[i]) <= 1e-4 else -(z[i] - math.copysign(1e-4, z[i])) / ((0.01 + math.sqrt(n[i])) / rate[i] + 1e-5)

    order = np.random.Generator(np.random.PCG64(7))
    for _ in range(3):
        for k in order.permutation(len(examples)):
            index, value, label = examples[k]
            w = [weight(i) for i in index]
            p = 1 / (1 + math.exp(-sum(a * float(v) for a, v in zip(w, value, strict=True))))
            for i, v, a in zip(index, value, w, strict=True):
                g = (p - label) * float(v)
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / rate[i]
                z[i] += g - sigma * a
                n[i] += g * g
    assert math.isclose(model.bias, weight(0), rel_tol=1e-6)
    assert all(math.isclose(model.weights[i], weight(i), rel_tol=1e-4, abs_tol=1e-6) for i in range(1, 60))


def test_disclosure_against_plain_counts(spark):
    rng = random.Random(9)
    fill = [f"w{k}x" for k in range(3000)]
    texts = []
    for k in range(120):
        c = rng.randrange(6)
        extra = [f"secret{c}"] * (rng.random() < 0.9) + [f"often{c % 3}"] * (rng.random() < 0.8)
        texts.append(" ".join([*rng.sample(fill, 12), *extra, f"user{c}@mail.example", *rng.sample(fill, 12)]))
    texts += [" ".join(rng.sample(fill, 20)) + (" often1" if k < 10 else "") for k in range(300)] + texts[:15]
    distinct = set(texts)
    entities, terms = {}, {}
    for t in distinct:
        words = t.split()
        entities[t] = {f"email:{w}" for w in words if "@" in w}
        terms[t] = {w for w in words if "@" not in w}
    n = len(distinct)
    n_c, n_t, n_ct = defaultdict(int), defaultdict(int), defaultdict(int)
    for t in distinct:
        for w in terms[t]:
            n_t[w] += 1
        for c in entities[t]:
            n_c[c] += 1
            for w in terms[t]:
                n_ct[c, w] += 1
    want = {}
    for (c, w), x in n_ct.items():
        share = 1 + math.log2(x / n_t[w]) / math.log2((n + 1) / n_c[c])
        if x >= pii.SUPPORT and share >= pii.GENERALISE:
            want[c, w] = share
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    found = {(r.c, r.t): r.share for r in pii.disclosing(docs).collect()}
    assert set(found) == set(want) and all(math.isclose(found[k], want[k], rel_tol=1e-9) for k in want) and len(want) >= 6
    by_id = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    for i, t in enumerate(texts):
        own = {w: s for (c, w), s in want.items() if c in entities[t]}
        new = " ".join("[EMAIL]" if "@" in w else "" if own.get(w, 0) >= pii.REMOVE else "[GENERAL]" if w in own else w for w in t.split())
        assert by_id[i] == new


def test_a_labelled_sample_is_bounded_in_rows_and_bytes(spark):
    from millrace.llm._jobs import labelled_sample

    docs = spark.createDataFrame([(k, "x" * 100) for k in range(60)] + [(3, "a" * 100), (60, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(61)] + [(5, None), (7, 0)], "doc_id bigint, good int")
    every = {r.doc_id: (r.label, r.text) for r in labelled_sample(docs, labels, "good", 4, 2, 1000).collect()}
    assert len(every) > 30 and every.get(3, (1, "a" * 100)) == (1, "a" * 100)
    assert len(labelled_sample(docs, labels, "good", 4, 2, 10).collect()) == 10
    few = {r.doc_id for r in labelled_sample(docs, labels, "good", 4, 2, 1000, 1050).collect()}
    assert 10 <= len(few) <= 11 and few <= set(every)
