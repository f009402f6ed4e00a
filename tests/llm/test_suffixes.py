import hashlib
import random
from collections import defaultdict

from unittest import mock

import pytest

from millrace.llm import suffixes
from millrace.llm.suffixes import WIDTH, dedup, repeated, suffix_array


def brute(docs):
    seen = defaultdict(int)
    data = [(t or "").encode() for _, t in docs]
    for b in data:
        for i in range(len(b) - WIDTH + 1):
            seen[b[i : i + WIDTH]] += 1
    out = []
    for (doc_id, _), b in zip(docs, data, strict=True):
        gone = bytearray(len(b))
        for i in range(len(b) - WIDTH + 1):
            if seen[b[i : i + WIDTH]] > 1:
                gone[i : i + WIDTH] = b"\x01" * WIDTH
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((doc_id, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_suffix_array():
    rng = random.Random(3)
    for n in [0, 1, 2, 5, 9, 40, 300]:
        for k in (1, 2, 3, 20):
            s = [rng.randrange(k) for _ in range(n)]
            assert suffix_array(s) == sorted(range(n), key=lambda i: s[i:])  # noqa: B023
    s = [0, 1] * 200 + [1, 0] * 100
    assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


@pytest.mark.parametrize("hot", [suffixes.HOT, 3])
def test_against_brute_force(spark, hot):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefé ü") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = [prose(60) for _ in range(4)]
    docs = [(i, prose(rng.randint(1, 120))) for i in range(40)]
    docs += [(100 + i, prose(20) + passages[i % 4][i : 250 + 7 * i] + prose(30)) for i in range(30)]
    docs += [(200, None), (201, ""), (202, "a" * 500), (203, "ab" * 300), (204, "x" * 199), (205, "x" * 199)]
    docs += [docs[3], (206, docs[5][1]), (207, passages[0] * 3), (208, prose(3000))]
    docs += [(300 + i, prose(2)[:9] + passages[0][:150] + prose(2 + i % 7)[: 60 + i] + passages[1][100:290]) for i in range(40)]
    found = dedup(spark.createDataFrame(docs, "doc_id bigint, text string"), hot)
    assert sorted(tuple(r) for r in found.collect()) == brute(docs)


def test_windows_of_snippets():
    rng = random.Random(8)
    text = lambda n, k=26: bytes(rng.randrange(97, 97 + k) for _ in range(n))
    common = text(260)
    bodies = [text(20) + common, text(7) + common + text(30), common[30:235], text(300), text(250, 1), text(230, 1), text(240, 2), b"xy" * 110, text(3) + b"xy" * 105]
    seen = defaultdict(int)
    for b in bodies:
        for i in range(len(b) - WIDTH + 1):
            seen[b[i : i + WIDTH]] += 1
    want = [[seen[b[i : i + WIDTH]] > 1 for i in range(len(b) - WIDTH + 1)] for b in bodies]
    assert [x.tolist() for x in repeated(bodies)] == want


def test_the_suffix_order_decides():
    common = b"".join(b"%d word " % k for k in range(60))
    with mock.patch.object(suffixes, "suffix_array", lambda s: list(range(len(s)))[::-1]):  # a wrong order, in which equal suffixes are no neighbours
        wrong = repeated([common, b"other bytes " * 20, b"before " + common])
    assert sum(x.sum() for x in wrong) < sum(x.sum() for x in repeated([common, b"other bytes " * 20, b"before " + common]))


def test_empty_table(spark):
    assert dedup(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


@pytest.mark.parametrize("many", [150, 600])
def test_rows_of_the_rounds_grow_with_the_snippets(spark, many, monkeypatch):
    """Texts around one long passage, some of them edited in it: groups far above the bound, rounds that make few rows for each snippet."""
    rng = random.Random(many)
    text = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    passage = text(420)
    docs = [(k, text(rng.randint(0, 150)) + (passage if k % 5 else passage[:200] + str(k) + passage[200 + len(str(k)) :]) + text(rng.randint(0, 150))) for k in range(many)]
    made, real = [], suffixes.merged
    monkeypatch.setattr(suffixes, "merged", lambda sent: (made.append((sent.count(), sent.select("row", "blk", "c").distinct().count())), real(sent))[1])
    found = dedup(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4), 20)
    assert sorted(tuple(r) for r in found.collect()) == brute(docs)
    assert len(made) >= 3 and all(rows <= 6 * many for rows, _ in made) and sum(rows for rows, _ in made) <= 36 * many


def test_pieces_with_the_same_bytes_are_one(spark):
    body = lambda c, n: bytes([c]) * n
    rows = [(1, k, 5, 10 + k, 3, body(97, 210), k, -1, 70) for k in range(4)] + [(1, None, 5, 20, 3, body(97, 210), 0, -1, 70), (2, 7, 5, 30, 4, body(97, 210), 0, -1, 70), (2, 8, 6, 31, 3, body(98, 200), 2, 0, 80)]
    one, answers = suffixes.merged(spark.createDataFrame(rows, suffixes.SENT))
    assert sorted((r.h, r.o, r.row is None) for r in one.collect()) == [(5, 3, True), (5, 4, False), (6, 3, False)]
    assert sorted((r.blk, r.row, r.c, r.first, bytes(r.bits)) for r in answers.collect()) == [(1, k, 10 + k, k, b"\xff\xe0") for k in range(4)]


def test_all_bits(spark):
    import numpy as np
    from pyspark.sql import functions as F

    got = {r.id: bytes(r.b) for r in spark.range(1, 140).select("id", suffixes._all_bits(F.col("id")).alias("b")).collect()}
    assert got == {n: np.packbits(np.ones(n, dtype=bool)).tobytes() for n in range(1, 140)}
