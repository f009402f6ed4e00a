"""Very long texts, and rewriting of many and overlapping spans against plain Python."""

import random

from pyspark.sql import functions as F

from millrace.llm import decontam, pieces, pii, quality, toxicity

DOC = "doc_id bigint, text string"


def replaced(text, spans):
    out, at = [], 0
    for start, kind, end in spans:
        out += [text[at:start] if start > at else "", pii.TAGS[kind]]
        at = max(at, end)
    return "".join(out) + text[at:]


def test_rewriting_against_plain_python(spark):
    rng = random.Random(5)
    rows = []
    for k in range(60):
        text = "".join(rng.choice("ab é漢\n\U0001f600") for _ in range(rng.randint(0, 700)))
        many = rng.choice([0, 1, 3, 40, 300])
        spans = sorted((a, rng.randint(0, 5), min(len(text), a + rng.randint(1, 30))) for a in (rng.randint(0, max(len(text) - 1, 0)) for _ in range(many if text else 0)))
        rows.append((k, text, spans))
    df = spark.createDataFrame(rows, "k int, text string, spans array<struct<start:int,kind:int,end:int>>")
    got = {r.k: r.new for r in df.select("k", pii.rewritten(F.col("text"), F.col("spans")).alias("new")).collect()}
    assert got == {k: replaced(t, s) for k, t, s in rows}


def test_running_maxima(spark):
    rng = random.Random(6)
    for n in (0, 1, 127, 128, 129, 1000):
        values = [rng.randint(0, 10**6) for _ in range(n)]
        got = spark.createDataFrame([(values,)], "w array<int>").select(pii.running(F.col("w"), pii._most, F.greatest)).first()[0]
        assert got == [max(values[: k + 1]) for k in range(n)]


def test_a_text_with_very_many_addresses(spark):
    text = "a@b.cd x " * 50_000
    docs = spark.createDataFrame([(1, text), (2, "é" * 300_000 + " 10.0.0.1")], DOC)
    got = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert got == {1: "[EMAIL] x " * 50_000, 2: "é" * 300_000 + " [IP]"}


def test_names_of_two_characters_are_terms(spark):
    rows = [(k, f"王小 writes about topic{k} and thing{k % 7} from li@ex.org today{k}") for k in range(6)] + [(100 + k, f"plain words {k} about topic{k}") for k in range(40)]
    got = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(rows, DOC)).collect()}
    assert all("王小" not in got[k] and "[EMAIL]" in got[k] for k in range(6)) and got[100] == rows[6][1]


def test_long_texts_of_the_other_operators(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    bench = " ".join(word() for _ in range(30))
    long = " ".join(word() for _ in range(120_000))
    docs = spark.createDataFrame([(1, f"{long} {bench} {long}"), (2, long), (3, "short text")], DOC)
    hits = {r.doc_id: r for r in decontam.judged(decontam.scan(docs, spark.createDataFrame([(9, bench)], "item_id bigint, text string"))).collect()}
    assert hits[1].n_hit == 30 and hits[1].n_words == 240_030 and hits[2].n_hit == 0
    labels = spark.createDataFrame([(2, 1, 0), (3, 0, 1)], "doc_id bigint, quality int, toxic int")
    for module in (quality, toxicity):
        scores = {r.doc_id: r.score for r in module.score(docs, module.fit(docs, labels)).collect()}
        assert set(scores) == {1, 2, 3} and all(0 <= s <= 1 for s in scores.values())
    assert {r.doc_id: r.decoded for r in pieces.decode(pieces.encode(docs)).collect()} == {r.doc_id: r.text for r in docs.collect()}
