"""The registered queries against plain Python, on the smallest provided tables and on rows with nulls, copies and long texts."""

import hashlib
import math
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest

from millrace.llm import decontam, embeddings, jaccard, katz, pieces, pii
from millrace.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [
    (9001, None), (9002, ""), (9003, "  \t\n"), (9004, "one"), (9004, "one"), (9005, "mail a.b@c.de, a@b 10.0.0.256 10.0.0.25 +49 (30) 1234-5678 4111 1111 1111 1111"),
    (9006, "x@y.z@q.rs.tu 1.2.3.4.5.6.7.8 +1+2 345 678 901 4111-1111-1111-1112 00004111111111111111"), (9007, "Ünï cödé wörds " * 300), (9008, "Ünï cödé wörds " * 300), (9009, "lone \U0001f600 mark ▁ <0x41> </s>"),
]


@pytest.fixture(scope="module")
def docs(spark):
    found = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    return found + ODD


@pytest.fixture(scope="module")
def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3).cache()


def components(nodes, pairs):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


@pytest.mark.parametrize(("width", "num"), [(3, 90), (5, 80)])
def test_jaccard(docs, frame, width, num):
    sets = []
    for _, t in docs:
        w = words(t)
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    pairs = [
        (docs[i][0], docs[j][0]) for i in range(len(docs)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])
    ]
    comp = components({d for d, _ in docs}, pairs)
    want = sorted((d, len(s), comp[d]) for (d, _), s in zip(docs, sets, strict=True))
    assert sorted(tuple(r) for r in jaccard.groups(frame, width, (num, 100)).collect()) == want


def test_decontamination(spark, docs, frame):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut = lambda t: word.findall((t or "").translate(LOWER))
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").unionByName(spark.createDataFrame([(77, "one"), (78, None), (79, "")], "item_id bigint, text string"))
    windows = defaultdict(set)
    for item, t in bench.collect():
        w = cut(t)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i : i + n])].add(item)
    want = []
    for d, t in docs:
        w, hit, items = cut(t), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if found := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    items |= found
        want.append((d, len(w), len(hit), sorted(map(str, items)), bool(hit) and 20 * len(hit) >= len(w)))
    found = decontam.judged(decontam.scan(frame, bench, keep=["doc_id"])).select("doc_id", "n_words", "n_hit", "items", "contaminated")
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)


def base_spans(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m.group() if c.isdigit()]
        luhn = sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(reversed(digits)))
        if 12 <= len(digits) <= 19 and luhn % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_pii(docs, frame):
    names = pii.KINDS
    want = []
    for d, t in docs:
        s = base_spans(t or "")
        text = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in s)
        want.append((d, *(sum(k == x for _, k, _ in s) for x in range(4)), hashlib.sha256(text.encode()).hexdigest()))
    from pyspark.sql import functions as F

    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("bigint")
    found = pii.spans(frame).select("doc_id", *(count(k) for k in range(4)), F.sha2(pii.named(F.col("spans")), 256))
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)


def test_lm_base_score_and_normalisation(docs, frame):
    from millrace.llm._jobs import fold
    from pyspark.sql import functions as F

    fold_of = lambda d: crc32(str(d).encode()) % 7
    c = Counter()
    for d, t in docs:
        if fold_of(d) != 2:
            c.update([*words(t), None])
    total, kinds = sum(c.values()), len(c)
    want = {}
    for d, t in docs:
        w = [*words(t), None]
        want.setdefault((d, len(w)), (fold_of(d) == 2, sum(c[x] > 0 for x in w), total, sum(math.log10((c[x] + 1) / (total + kinds + 1)) for x in w)))
    rows = katz.score(frame, fold(F.col("doc_id"), 7) != 2).collect()
    assert len(rows) == len(docs)
    for r in rows:
        held, known, n, base = want[r.doc_id, r.n_tokens]
        assert (r.held_out, r.n_known, r.train_tokens) == (held, known, n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
        assert r.score < 0 and math.isfinite(r.score)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_embeddings(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    rows += [(90001, None), (90002, []), (90003, [0.0] * len(rows[0][1])), (90004, [float("nan")] * len(rows[0][1])), (90005, rows[0][1]), (90006, [2 * x for x in rows[1][1]])]
    good = [(i, np.array(v, dtype=float)) for i, v in rows if v and np.isfinite(v).all() and np.any(v)]
    unit = np.stack([v / np.linalg.norm(v) for _, v in good])
    cos = unit @ unit.T
    ids = [i for i, _ in good]
    pairs = [(ids[i], ids[j]) for i in range(len(ids)) for j in range(i) if cos[i, j] >= 0.95]
    n = Counter(x for p in pairs for x in p)
    comp = components({i for i, _ in rows}, pairs)
    found = embeddings.links(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).select("vec_id", "n_links", "component_id", "kept").collect()
    assert sorted(tuple(r) for r in found) == sorted((i, n[i], comp[i], comp[i] == i) for i, _ in rows)


def test_chat(spark):
    source = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    turns = defaultdict(list)
    for r in source:
        turns[r.conv_id].append((r.turn, r.role, r.text or ""))
    turns[-1] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    want = []
    for c, t in turns.items():
        t.sort()
        loss = "".join(x for _, r, x in t if r == "assistant")
        want.append((c, len(t), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in t).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    found = QUERIES["op2_chat_formatting"](spark, SF).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)


def test_pieces_round_trip(docs, frame):
    out = pieces.decode(pieces.encode(frame)).select("doc_id", "decoded").collect()
    key = lambda r: (r[0], r[1] or "")
    assert sorted((tuple(r) for r in out), key=key) == sorted(docs, key=key)


@pytest.mark.parametrize(("name", "label", "modulus", "least"), [("op6_quality_classifier", "quality", 4, 0.75), ("op1_toxicity", "toxic", 5, 0.75)])
def test_classifiers_held_out(spark, name, label, modulus, least):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").where(f"{label} is not null").collect()}
    rows = QUERIES[name](spark, sf).collect()
    assert all(0 <= r.score <= 1 for r in rows)
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert sum(a == b for a, b in held) >= least * len(held) > 0


@pytest.mark.parametrize("run", [jaccard.groups, pii.spans, pieces.encode])
def test_empty_tables(spark, run):
    assert run(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
