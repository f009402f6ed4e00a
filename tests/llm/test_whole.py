"""What the operators do with all of their input: cases that a cut would lose."""

import math

import numpy as np
import pyarrow as pa

from millrace.llm import decontam, katz, pii, toxicity
from millrace.llm._text import slices


def test_pii_terms_of_large_and_templated_input(spark):
    fill = lambda k, n: " ".join(f"w{(k * 7919 + i * 104729) % 99991}x" for i in range(n))
    rows = []
    # a name in 20 phrasings beside its address, in 80 documents
    rows += [f"{fill(k, 30)} p{k % 20}q quillfeather r{k % 20}s quill@post.example {fill(k + 500, 30)}" for k in range(80)]
    # a fixed signature line, the name far from the address
    rows += [f"{fill(k + 1000, 40)} yours truly ambrosine {'- ' * 60} desk of sales amb@post.example" for k in range(60)]
    # one text in many copies is no evidence
    rows += ["once upon zanzibarish times copy@post.example wrote this line and nothing else"] * 50
    # and so are near copies of it
    rows += [f"{fill(9000, 60)} near@post.example end{k}" for k in range(5)]
    rows += [fill(k + 5000, 60) for k in range(400)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string").repartition(3)
    texts = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert all("quillfeather" not in texts[k] for k in range(80)) and all("ambrosine" not in texts[k] for k in range(80, 140))
    assert all("zanzibarish" in texts[k] for k in range(140, 190)) and all(fill(9000, 60) in texts[k] for k in range(190, 195))


def test_lm_back_off_weight_of_a_very_frequent_history(spark):
    k = 2_000_000
    docs = spark.createDataFrame([(1, "a b " * k), (2, "a zz")], "doc_id bigint, text string")
    found = {r.doc_id: r.score for r in katz.score(docs, docs.doc_id == 1, order=2).collect()}
    # counts: a k, b k, end 1; the discount of a single occurrence is 0.01 for words and pairs
    weight = (0.5 / (k + 0.5)) / (1 - k / (2 * k + 1.5))
    first, unknown, end = 0.01 / 1.5, (0.5 + 0.99) / (2 * k + 1.5), 0.01 / (2 * k + 1.5)
    assert math.isclose(found[2], math.log10(first) + math.log10(weight * unknown) + math.log10(end), rel_tol=1e-9)


def test_toxicity_gate_misses_nothing_that_the_decoder_handles():
    calls = []

    class Recorder(toxicity.Channel):
        def decode(self, word):
            calls.append(word)
            return word

    words = [w for c in toxicity.LEET for w in (f"{c}diot", f"id{c}ot", f"idio{c}", f"idio{c}{c}", f"{c}-x", f"x_{c}_y", f"{c}9é", f"é{c}")]
    words += ["\u00e9\u00e9\u00e9t", "\u54c8\u54c8\u54c8", "\U00010400" * 3, "idiooot", "i d i o t", "\u00e9.t.\u00e9.t", "a_b_c_d", "id10t", "hello!", "\u201cquoted\u201d", "plain"]
    texts = [t for w in words for t in (w, f"{w} people here", f"what a {w}", f"you {w}, go")] + ["", None]
    decoded = []
    for t in texts:
        calls.clear()
        Recorder({}).restore(t or "")
        decoded.append(bool(calls))
    together = np.concatenate([toxicity.disguised(p) for p in slices(pa.array(texts, pa.string()))])
    alone = [bool(toxicity.disguised(next(slices(pa.array([t], pa.string()))))[0]) for t in texts]
    for flags in (together, alone):
        assert not [t for t, want, f in zip(texts, decoded, flags, strict=True) if want and not f]
    assert not together[texts.index("plain")] and sum(decoded) > 400


def test_toxicity_language_model_counts_all_documents(spark):
    docs = spark.createDataFrame([(k, f"word{'abcdefghij'[k % 10]} same") for k in range(50)] + [(99, "xylophonist")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id bigint, toxic int")
    assert "xylo" in toxicity.fit(docs, labels).counts


def test_benchmark_rows_without_id_contaminate(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "other words here"), (3, "named item text")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(None, "alpha beta gamma delta"), (7, "named item text"), (None, None)], "item_id bigint, text string")
    found = {r.doc_id: (len(r.hits), r.items, r.contaminated) for r in decontam.judged(decontam.scan(docs, bench)).collect()}
    assert found == {1: (1, [], True), 2: (0, [], False), 3: (1, ["7"], True)}
