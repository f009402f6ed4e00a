"""Whitening, centroid clustering and mixing against plain numpy and Python, on given and on odd rows."""

import hashlib
import math
import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import _lattice, _order, centroids, mixing, whitening

SF = "/root/testdata/sf0.001"
VEC = "vec_id bigint, embedding array<double>, q string, width string, n string, place string"


def lattice(v, offset=0):
    return [math.floor(64 * c) + offset for c in v]


def frame(spark, rows, schema=VEC):
    more = schema.count(",") - 1
    return spark.createDataFrame([(i, v, *["x"] * more) for i, v in rows], schema).repartition(3)


@pytest.fixture(scope="module")
def vectors():
    rng = random.Random(4)
    rows = [(k, [rng.gauss(0, 1) * (1 + j) for j in range(6)]) for k in range(60)]
    rows += [(100 + k, rows[0][1]) for k in range(40)]  # one vector holds a third of all rows
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1]), (200, None), (201, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (202, [math.nan] * 6), (203, [math.inf] * 6), (204, []), (205, [1e300] * 6)]
    return rows


# ---- packed vectors


def test_packed_and_back(spark):
    values = [[0.0, 1.0], [2.0, -2.0], [1.99, -2.0], [512.0, 0.0], [-512.0, 0.01], [600.5, 3.0], [1e9, -1e9], [-1e16, 5.0], [3.0], []]
    out = _lattice.packed(frame(spark, enumerate(values))).toArrow()
    got = {}
    for batch in out.to_batches():
        for _, at, x in _lattice.unpacked(batch):
            for k, row in zip(at, x, strict=True):
                got[batch.column("vec_id")[int(k)].as_py()] = row.tolist()
    assert got == {k: lattice(v) for k, v in enumerate(values)}
    assert len(set(zip(out["width"].to_pylist(), out["q"].to_pylist(), strict=True))) == len({tuple(lattice(v)) for v in values})


def test_exact_sums():
    x = np.array([[2**61, -(2**61)], [2**61, -5], [2**61, 7]], dtype=np.int64)
    assert _lattice.sums(x) == [3 * 2**61, -(2**61) + 2] and _lattice.sums(x, np.array([3, 1, 1])) == [5 * 2**61, -3 * 2**61 + 2]
    assert _lattice.squares(x).tolist() == [2 * 2**122, 2**122 + 25, 2**122 + 49]


# ---- op11


def plain_whitening(rows, kept=16, offset=1_000_000):
    good = [(i, lattice(v, offset)) for i, v in rows if v and all(c is not None and math.isfinite(c) and abs(c) < 2**55 for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in good}), dtype=np.int64)
    n, total = len(fit), fit.sum(axis=0)
    y = (n * fit - total) / n
    e, v = np.linalg.eigh(y.T @ y / n)
    e, v = e[::-1][:kept], v[:, ::-1][:, :kept]
    out = []
    for i, x in good:
        exact = n * np.array(x) - total
        out += [(i, k + 1, n, int((exact * exact).sum()), w, s) for k, (w, s) in enumerate(zip(exact / n @ v / np.sqrt(e), e / np.trace(y.T @ y / n), strict=True))]
    return out


def compared(found, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3], abs(r[4]))
    found, want = sorted(map(tuple, found), key=key), sorted(want, key=key)
    assert [r[:4] for r in found] == [r[:4] for r in want] and found
    signs = defaultdict(set)
    for a, b in zip(found, want, strict=True):
        assert math.isclose(abs(a[4]), abs(b[4]), rel_tol=1e-8, abs_tol=1e-9) and math.isclose(a[5], b[5], rel_tol=1e-9)
        if abs(b[4]) > 1e-6:
            signs[a[1]].add(a[4] * b[4] > 0)
    assert all(len(s) == 1 for s in signs.values())
    assert len({r[6] for r in found}) == 1 and 0 <= found[0][6] < 1e-9


def test_whitening_of_the_given_vectors(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    compared(whitening.op11_embedding_whitening(spark, SF).collect(), plain_whitening(rows))


def test_whitening_of_odd_rows(spark, vectors):
    compared(whitening.whiten(frame(spark, vectors)).collect(), plain_whitening(vectors))
    assert {r.component for r in whitening.whiten(frame(spark, vectors), components=2).collect()} == {1, 2}


def test_merging_blocks_changes_nothing(spark, vectors):
    """More tasks than FAN, so that triangles and moments are merged in several rounds."""
    many = frame(spark, vectors).repartition(40)
    packed = _lattice.packed(many).where("width = 6").select("width", "q").distinct().repartition(40)
    x = np.array(sorted({tuple(lattice(v)) for _, v in vectors if v and len(v) == 6 and all(c is not None and abs(c) < 1e9 for c in v)}))
    n, total = len(x), x.sum(axis=0)
    r = whitening.triangles(packed, {6: (n, total)}, 0)[6]
    y = (n * x - total) / n
    assert np.allclose(r.T @ r, y.T @ y, rtol=1e-12)
    rng = np.random.default_rng(2)
    blocks = [rng.standard_normal((k, 3)) + 50 for k in (4, 1, 9, 30)]
    one = [np.concatenate([[3, len(b)], b.mean(axis=0), ((b - b.mean(axis=0)).T @ (b - b.mean(axis=0))).ravel()]).tobytes() for b in blocks]
    m, whole = np.frombuffer(whitening._joined(one)), np.vstack(blocks)
    assert m[1] == 44 and np.allclose(m[2:5], whole.mean(axis=0)) and np.allclose(m[5:].reshape(3, 3) / 44, np.cov(whole.T, bias=True), rtol=1e-12)


@pytest.mark.parametrize("shape", [(1, 1), (3, 3), (2, 5), (9, 4), (40, 33), (64, 64)])
def test_jacobi(shape):
    a = np.random.default_rng(shape[0]).standard_normal(shape) * np.logspace(0, -9, shape[1])
    sigma, v = whitening.jacobi(a)
    assert np.allclose(v.T @ v, np.eye(shape[1]), atol=1e-13)
    want = np.linalg.svd(a, compute_uv=False)
    assert np.allclose(sigma[: len(want)], want, rtol=1e-9, atol=1e-15 * want[0]) and (np.diff(sigma) <= 0).all()
    assert np.allclose(np.linalg.norm(a @ v, axis=0), sigma, rtol=1e-9, atol=1e-14 * want[0])


def test_rounds_hold_every_pair_once():
    for d in (2, 3, 7, 8):
        pairs = [(a, b) for p, q in whitening.rounds(d) for a, b in zip(p.tolist(), q.tolist(), strict=True)]
        assert sorted(pairs) == [(a, b) for a in range(d) for b in range(a + 1, d)]
        assert all(len({*p.tolist(), *q.tolist()}) == 2 * len(p) for p, q in whitening.rounds(d))


def test_whitening_without_variance(spark):
    assert whitening.whiten(frame(spark, [])).collect() == [] and whitening.whiten(frame(spark, [(1, None), (2, [])])).collect() == []
    one = whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert sorted(map(tuple, one)) == [(i, c, 1, 0, None, None, None) for i in (1, 2) for c in (1, 2)]
    flat = {(r.vec_id, r.component): r for r in whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [3.0, 2.0]), (3, [0.5])])).collect()}
    assert math.isclose(flat[1, 1].whitened, -1) and math.isclose(flat[2, 1].whitened, 1) and flat[1, 1].explained == 1 and flat[1, 1].identity_error < 1e-12
    assert flat[1, 2].whitened is None and flat[1, 2].explained == 0 and flat[3, 1].n == 1 and flat[3, 1].whitened is None


# ---- op12


def plain_clusters(rows, k=16, times=3, width=64):
    good = [(i, lattice(v)) for i, v in rows if v and len(v) == width and all(c is not None and math.isfinite(c) and abs(c) < 2**55 for c in v)]
    hashed = sorted((x for x in good if x[0] is not None), key=lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), np.array(r[1], dtype="<i2").tobytes() if max(map(abs, r[1])) > 127 else np.array(r[1], dtype="<i1").tobytes()))
    points = [x for _, x in [*hashed, *(x for x in good if x[0] is None)][:k]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, p, strict=True)), c) for c, p in enumerate(points))

    for _ in range(times):
        own = defaultdict(list)
        for _, x in good:
            own[nearest(x)[1]].append(x)
        points = [[sum(col) // len(own[c]) for col in zip(*own[c], strict=True)] if c in own else p for c, p in enumerate(points)]
    found = [(i, *reversed(nearest(x))) for i, x in good]
    inertia = Counter()
    for _, c, d in found:
        inertia[c] += d
    name = lambda c: hashlib.sha256(",".join(map(str, points[c])).encode()).hexdigest()
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), name(c)) for i, c, d in found), key=str)


def test_clusters_of_the_given_vectors(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert sorted(map(tuple, centroids.op12_centroid_clustering(spark, SF).collect()), key=str) == plain_clusters(rows)


def test_clusters_of_odd_rows(spark, vectors, monkeypatch):
    want = plain_clusters(vectors, 5, 3, 6)
    run = lambda: sorted(map(tuple, centroids.cluster(frame(spark, vectors), k=5, width=6).collect()), key=str)
    assert run() == want
    assert any(r[0] is None for r in want) and sum(r[0] == 7 for r in want) == 3
    fewer = [(1, [1.0] * 6), (2, [5.0] * 6), (3, [5.0] * 6)]
    assert sorted(map(tuple, centroids.cluster(frame(spark, fewer), k=16, width=6).collect()), key=str) == plain_clusters(fewer, 16, 3, 6)
    assert centroids.cluster(frame(spark, [])).collect() == []


def test_a_common_vector_is_dealt_over_several_keys(spark):
    rows = [(k, [float(k % 7 == 0), 1.0]) for k in range(7000)]
    out = centroids.cluster(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(3), k=2, width=2)
    got = {r.vec_id: (r.cluster, r.distance) for r in out.collect()}
    assert len(got) == 7000 and len({got[k] for k in range(0, 7000, 7)}) == 1 and len({got[k] for k in range(1, 7000, 7)}) == 1


def test_nearest_is_exact_for_large_numbers():
    points = [[2**40, 0], [2**40 + 1, 0], [-(2**61), 2**61]]
    c = centroids.Centroids(points)
    x = np.array([[2**40 + 1, 1], [2**40, 3], [2**61, -(2**61)], [0, 0]], dtype=np.int64)
    first, away = c.nearest(x)
    want = [min((sum((int(a) - b) ** 2 for a, b in zip(r, p, strict=True)), k) for k, p in enumerate(points)) for r in x]
    assert [(int(d), int(k)) for k, d in zip(first, away, strict=True)] == want


# ---- op13


def plain_targets(size, weight, budget, most=3):
    free, rest = {s for s in size if size[s]}, budget
    while True:
        level = Fraction(rest, sum(weight[s] for s in free)) if free else 0
        above = {s for s in free if level * weight[s] > most * size[s]}
        if not above:
            return {s: float(level * weight[s]) if s in free else float(most * size[s]) for s in size}
        free -= above
        rest -= sum(most * size[s] for s in above)


def plain_mix(rows, weights=(1, 2, 3), most=3, share=1.0):
    """Rows (doc_id, source, text); words by single characters, queues as lists."""
    docs = [(i, s, len("".join(c if c not in " \t\n\x0b\f\r" else " " for c in t or "").split(" ")) - (("".join(c if c not in " \t\n\x0b\f\r" else " " for c in t or "")).split(" ")).count(""), t) for i, s, t in rows]
    names = sorted({s for _, s, *_ in docs}, key=lambda s: (s is None, s or ""))
    size = {s: sum(n for _, x, n, _ in docs if x == s) for s in names}
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    whole = sum(size.values())
    budget = min(int(whole * share), most * whole)
    goal = plain_targets(size, weight, budget, most)
    entries = []
    for rank, s in enumerate(names):
        queue = sorted(((hashlib.md5(f"{'' if i is None else i}:{hashlib.md5((t or '').encode()).hexdigest()}".encode()).hexdigest(), k) for k, (i, x, n, t) in enumerate(docs) if x == s and n), key=lambda r: (r[0], docs[r[1]][0] or 0))
        at = 0
        for _ in range(most):
            for _, k in queue:
                n, cut = docs[k][2], math.floor(goal[s])
                for a, b in [(at, cut), (cut, at + n)] if at < cut < at + n else [(at, at + n)]:
                    entries.append((b / goal[s], rank, a, k, b - a))
                at += n
    taken, used = Counter(), 0
    for *_, k, n in sorted(entries):
        new = min(n, budget - used)
        taken[k] += new
        used += new
    return [(i, n, size[s], goal[s], taken[k]) for k, (i, s, n, _) in enumerate(docs)]


def found_mix(spark, rows, **how):
    schema = "doc_id bigint, source string, text string, size string, target string, rank string, row string, key string"
    return mixing.mix(spark.createDataFrame([(*r, *["x"] * 5) for r in rows], schema).repartition(3), **how).collect()


def test_mix_of_the_given_documents(spark):
    rows = [(r.doc_id, r.source, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = sorted(plain_mix(rows))
    out = mixing.op13_mixing(spark, SF).collect()
    assert sorted(map(tuple, out)) == want
    assert sum(r.taken for r in out) == sum(r.size for r in out) and all(r.taken <= 3 * r.size for r in out)
    assert sorted(map(tuple, mixing.op13_mixing(spark, SF).collect())) == want  # again


ODD = [
    (1, "a", "w " * 900), (2, "a", "x\ty"), (3, "b", "only three words"), (4, "c", None), (5, "c", ""), (6, None, "null source has words"), (7, "", " \n "), (8, "Z", "upper case\x0bcomes\ffirst"),
    (8, "Z", "upper case\x0bcomes\ffirst"), (None, "é", "accented source " * 40), (9, "é", "nb sp"), *((k, "hot", f"word {k} " * (k % 5)) for k in range(20, 60)),
]


def test_mix_of_odd_rows(spark):
    out = found_mix(spark, ODD)
    key = lambda r: str(tuple(r))
    assert sorted((tuple(r) for r in out), key=key) == sorted(plain_mix(ODD), key=key)
    goal = {r.doc_id: r.target for r in out}
    assert goal[3] == 9 and goal[4] == goal[7] == 0  # three times its size; no words
    for how in ({"share": 0.3}, {"share": 2.5}, {"share": 9.0}, {"weights": (5, 1)}, {"most": 1}):
        assert sorted((tuple(r) for r in found_mix(spark, ODD, **how)), key=key) == sorted(plain_mix(ODD, **how), key=key), how


def test_sources_come_near_their_targets(spark):
    rng = random.Random(9)
    rows = [(k, f"s{min(k % 30, 9)}", "w " * (5000 if rng.random() < 0.02 else rng.randint(0, 60))) for k in range(900)]
    out = found_mix(spark, rows)
    source, taken, goal = {i: s for i, s, _ in rows}, Counter(), {}
    for r in out:
        taken[source[r.doc_id]] += r.taken
        goal[source[r.doc_id]] = r.target
    assert all(-1 < taken[s] - goal[s] <= len(goal) for s in goal)
    assert mixing.mix(spark.createDataFrame([], "doc_id bigint, source string, text string")).collect() == []
    assert [r.taken for r in found_mix(spark, [(1, "a", None), (2, None, "")])] == [0, 0]


def test_the_mix_is_in_order_and_ends_at_the_budget(spark):
    placed, budget = mixing.queued(spark.createDataFrame(ODD, "doc_id bigint, source string, text string"))
    rows = sorted(mixing.mixed(placed, budget).collect(), key=lambda r: r.before)
    assert [r.finish for r in rows] == sorted(r.finish for r in rows) and sum(r.taken for r in rows) == budget
    assert all(a.before + a.taken == b.before for a, b in zip(rows, rows[1:], strict=False))


def test_running_sums(spark):
    rng = random.Random(1)
    rows = [(rng.choice("abc"), rng.randint(0, 9), rng.randint(0, 5)) for _ in range(300)]
    out = _order.running(spark.createDataFrame(rows, "k string, o bigint, v bigint").repartition(5), [F.col("k").asc(), F.col("o").asc(), F.col("v").asc()], "v").collect()
    at, want = 0, []
    for k, o, v in sorted(rows):
        want.append((k, o, v, at))
        at += v
    assert sorted((r.k, r.o, r.v, r.before) for r in out) == sorted(want)


# ---- op9


def test_codes_do_not_depend_on_their_company():
    from millrace.llm import embeddings

    x = np.random.default_rng(3).standard_normal((300, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tables = embeddings.Tables(64, 9, 12)
    whole = tables.codes(x)
    for some in ([0], [5, 17, 299], range(100)):
        for t in (1, 7, 12):
            assert (tables.codes(x[list(some)], t) == whole[list(some), :t]).all()


def test_links_of_near_vectors_are_counted_once(spark):
    """Clusters of near vectors meet in many tables, and one vector holds a third of all rows."""
    from millrace.llm import embeddings

    rng = np.random.default_rng(11)
    centres = rng.standard_normal((12, 24))
    rows = [(k, (centres[k % 12] + 0.08 * rng.standard_normal(24)).tolist()) for k in range(240)]
    rows += [(1000 + k, rows[0][1]) for k in range(120)]
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = {i: int(n) for (i, _), n in zip(rows, (x @ x.T >= 0.95).sum(axis=1) - 1, strict=True)}
    found = embeddings.links(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)).collect()
    assert {r.vec_id: r.n_links for r in found} == want and len({r.component_id for r in found}) == 12
