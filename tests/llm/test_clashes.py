"""SQL of the registered queries, columns of any name, empty tables, and the pipeline with its stages."""

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace.llm import decontam, embeddings, jaccard, katz, pieces, pii, quality, suffixes, toxicity
from millrace.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
DOC = "doc_id bigint, text string"


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    want = con.execute(SQL[name])
    columns = sorted(d[0] for d in want.description)
    order = [[d[0] for d in want.description].index(c) for c in columns]
    rows = sorted(tuple(r[k] for k in order) for r in want.fetchall())
    found = QUERIES[name](spark, SF)
    assert sorted(found.columns) == columns and sorted(tuple(r) for r in found.select(*columns).collect()) == rows


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with every name that an operator uses itself."""
    names = "n_words hits items row __id __h id h blk rows n m text2 spans more ids n_tokens label token class order part keys totals __deal c t d1 first component score".split()
    texts = [("one two three four five six seven " * 4, 1), ("one two three four five six seven " * 4, 2), (None, 3), ("", 4), ("mail a.b@c.de and 10.0.0.1 now", 5), ("other words that are not the same at all here", 6)]
    rows = [(i, t, *(f"{c}{i}" for c in names)) for t, i in texts]
    return spark.createDataFrame(rows, f"{DOC}, " + ", ".join(f"`{c}` string" for c in names))


def test_columns_of_any_name(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (6, 1, 0), (5, 0, 0)], "doc_id bigint, quality int, toxic int")
    bench = spark.createDataFrame([(1, "other words that are not the same at all here")], "item_id bigint, text string")
    model = quality.fit(odd, labels)
    everything = {r.doc_id: r for r in odd.collect()}
    for out, ids in (
        (jaccard.keep_one(odd), {1, 3, 4, 5, 6}), (decontam.drop_contaminated(odd, bench), {1, 2, 3, 4, 5}), (decontam.cut_spans(odd, bench), {1, 2, 3, 4, 5, 6}), (pii.sanitise(odd), {1, 2, 3, 4, 5, 6}),
        (quality.filter_documents(odd, model, 0.0), {1, 2, 3, 4, 5, 6}),
    ):
        assert out.columns == odd.columns
        rows = {r.doc_id: r for r in out.collect()}
        assert set(rows) == ids
        assert all(r[c] == everything[i][c] for i, r in rows.items() for c in odd.columns if c != "text")
    assert {r.doc_id: r.text for r in pii.sanitise(odd).collect()}[5] == "mail [EMAIL] and [IP] now"
    assert {r.doc_id: r.text for r in decontam.cut_spans(odd, bench).collect()}[6] == ""
    encoded = pieces.decode(pieces.encode(odd))
    assert encoded.columns.count("ids") == 1 and {r.doc_id: r.decoded for r in encoded.collect()} == {i: r.text for i, r in everything.items()}
    for run in (jaccard.groups, pii.spans, suffixes.dedup, lambda d: katz.score(d, F.lit(True)), lambda d: toxicity.score(d, toxicity.fit(d, labels)), lambda d: decontam.scan(d, bench)):
        assert {r.doc_id for r in run(odd).collect()} == set(everything)


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([], DOC), spark.createDataFrame([], "item_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    some = spark.createDataFrame([(1, "a b"), (None, None)], DOC)
    vectors = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    model, toxic = quality.fit(docs, labels), toxicity.fit(docs, labels)
    runs = (
        lambda d: quality.score(d, model), lambda d: toxicity.score(d, toxic), lambda d: decontam.drop_contaminated(d, bench), lambda d: decontam.cut_spans(d, bench), jaccard.keep_one, jaccard.groups, pii.sanitise,
        suffixes.dedup, lambda d: katz.score(d, F.lit(True)), pieces.encode,
    )
    for run in runs:
        assert run(docs).collect() == []
        assert len(run(some).collect()) == 2
    assert embeddings.links(vectors).collect() == []
    assert {r.score for r in quality.score(some, model).collect()} == {0.5}


def test_benchmark_in_several_blocks(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    judged = lambda most: sorted((r.doc_id, r.n_words, r.n_hit, tuple(r.items), r.contaminated) for r in decontam.judged(decontam.scan(docs, bench, keep=["doc_id"], most=most)).collect())
    assert judged(300) == judged(decontam.BLOCK_BYTES)


def test_windows_that_share_a_hash(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from millrace.llm._text import slices

    monkeypatch.setattr(decontam, "gram_hashes", lambda words, width: np.zeros(max(len(words) - width + 1, 0), dtype=np.uint64))
    windows = decontam.Windows.of([("a", "red green"), ("b", "blue green")], 2)
    _, _, bounds, hit, items = windows.hits(next(slices(pa.array(["a blue green b", "red green", "green red"]))))
    assert hit.tolist() == [False, True, True, False, True, True, False, False] and items == {0: {"b"}, 1: {"a"}}


    windows = decontam.Windows.of([(k, t) for k, t in zip("abcdef", ["red green", "blue green"] * 3, strict=True)] + [(None, "red green")], 2)
    *_, items = windows.hits(next(slices(pa.array(["a blue green b", "red green", "green red"]))))
    assert items == {0: {"b", "d", "f"}, 1: {"a", "c", "e"}}


def test_items_without_an_id_are_dealt_over_the_blocks(spark):
    rng = __import__("random").Random(1)
    text = lambda: " ".join(rng.choice(["ab", "cd", "ef", "gh"]) + str(rng.randint(0, 99)) for _ in range(20))
    items = [(None if k % 2 else k, text()) for k in range(40)]
    bench = spark.createDataFrame([*items, (None, None), (7, "")], "item_id bigint, text string")
    sizes = [sum(len(g[0]) for g in w.by_length.values()) for w in decontam.blocks(bench, 13, most=300)]
    assert len(sizes) > 5 and max(sizes) < sum(sizes) / 2
    docs = spark.createDataFrame([(k, f"x {t} y") for k, (_, t) in enumerate(items)], DOC)
    for most in (300, 1 << 20):
        found = decontam.judged(decontam.scan(docs, bench, most=most)).collect()
        assert {r.doc_id: (r.n_hit, r["items"]) for r in found} == {k: (20, [] if i is None else [str(i)]) for k, (i, _) in enumerate(items)}


def test_bytes_of_a_block():
    rng = __import__("random").Random(2)
    items = [(k, " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(400))) for k in range(200)]
    windows = decontam.Windows.of(items, 13)
    size = len(windows.words) + sum(a.nbytes for g in windows.by_length.values() for a in g)
    assert size < 7 * sum(len(t) for _, t in items) and len(windows.by_length[13][0]) == 200 * 388


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    left, columns = docs, docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, left, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns, name
        rows = out.collect()
        before = {r.doc_id: r for r in left.collect()}
        assert len({r.doc_id for r in rows}) == len(rows) and {r.doc_id for r in rows} <= set(before)
        if name == "n-gram Jaccard join":
            comp = {r.doc_id: r.component_id for r in jaccard.groups(left.select("doc_id", "text")).collect()}
            assert {r.doc_id for r in rows} == set(comp.values())
        if name == "benchmark decontamination":
            bad = {r.doc_id for r in decontam.judged(decontam.scan(left, spark.read.parquet(f"{SF}/benchmark.parquet"), keep=["doc_id"])).where("contaminated").collect()}
            assert {r.doc_id for r in rows} == set(before) - bad
        if name in ("PII", "SentencePiece encoding and decoding"):
            assert len(rows) == len(before)
        left = spark.createDataFrame(rows, out.schema)
    assert sorted(map(str, corpus_pipeline.run(spark, SF).collect())) == sorted(map(str, rows))
    assert {r.doc_id: r.decoded for r in pieces.decode(left).collect()} == {r.doc_id: r.text for r in rows}
