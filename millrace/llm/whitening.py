"""Embedding whitening by a one-sided Jacobi SVD of a triangle that blockwise QR makes of the centred rows.

Vectors become whole numbers x = floor(scale * entry) + offset, packed in few bytes. The fit list is each different x once.
Sums over it are exact; every task turns its centred rows (n * x - S) / n into one triangle by QR, block after block, and triangles
are stacked and factored again in a tree, so that one of width times width numbers reaches the driver whatever the number of rows. Plane
rotations then make the triangle's columns orthogonal: the accumulated rotations are the components, the lengths of the columns are the
standard deviations times the root of n. No covariance is formed, so small deviations keep their digits.

The covariance of the whitened fit list is measured by a pass of its own, with moments that tasks centre before multiplying and merge
exactly.

Defined results: rows whose vector is null, holds null or non-finite entries, or entries of 2^62 and more after scaling, go. Vectors of different
lengths are whitened among those of their own length; vectors without entries have no component and so no row. A component without
variance (to double precision) has a null ``whitened``, explains 0 and is left out of ``identity_error``, which is null where no
component has any. ``explained`` is null where nothing varies. A component's sign makes its largest entry positive. Repeated rows, rows
without an id and equal ids each give their own rows. No rows give none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._jobs import discard, table, written
from ._lattice import LARGEST, largest, packed, squares, unpacked
from ._lattice import sums as exact_sums

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: Blocks that are merged in one task.
FAN = 16
_PART = "width int, block bigint, value binary"


def centred(x: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    """n * x - S, exact: in 64 bits where they suffice, else with Python's whole numbers."""
    if n * largest(x) + largest(total) >= LARGEST:
        x, total = x.astype(object), total.astype(object)
    return x * n - total


def rounds(d: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Every pair of d columns once, in rounds of pairs that share no column."""
    ring = list(range(d + d % 2))
    half, out = len(ring) // 2, []
    for _ in range(len(ring) - 1):
        pairs = [(min(a, b), max(a, b)) for a, b in zip(ring[:half], reversed(ring[half:]), strict=True) if max(a, b) < d]
        out.append((np.array([a for a, _ in pairs], dtype=np.int64), np.array([b for _, b in pairs], dtype=np.int64)))
        ring = [ring[0], ring[-1], *ring[1:-1]]
    return out


def jacobi(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Singular values, falling, and right singular vectors (columns) of a matrix, by rotations of its columns."""
    d = r.shape[1]
    a, v = np.array(r, dtype=np.float64), np.eye(d)
    plan = rounds(d) if d > 1 else []
    for _ in range(sweeps):
        turned = False
        for p, q in plan:
            x, y = a[:, p], a[:, q]
            alpha, beta, gamma = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            some = np.abs(gamma) > 4e-16 * np.sqrt(alpha) * np.sqrt(beta)
            if not some.any():
                continue
            turned = True
            p, q, alpha, beta, gamma = p[some], q[some], alpha[some], beta[some], gamma[some]
            with np.errstate(over="ignore"):  # an infinite quotient turns by nothing
                zeta = (beta - alpha) / (2 * gamma)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = 1 / np.hypot(1.0, t)
            s = c * t
            for m in (a, v):
                x, y = m[:, p], m[:, q]
                m[:, p], m[:, q] = c * x - s * y, s * x + c * y
        if not turned:
            break
    sigma = np.linalg.norm(a, axis=0)
    order = np.argsort(-sigma, kind="stable")
    v = v[:, order]
    return sigma[order], v * np.where(v[np.abs(v).argmax(axis=0), np.arange(d)] < 0, -1.0, 1.0)


def _binary(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


def merged(parts: DataFrame, combine: Callable[[list[bytes], int], bytes]) -> dict[int, bytes]:
    """One value for each width of ``parts`` (width, block, value): ``FAN`` neighbouring blocks become one until one is left."""

    def stack(group: pa.Table) -> pa.Table:
        rows = sorted(zip(group["block"].to_pylist(), group["value"].to_pylist(), strict=True))
        return pa.table({"width": group["width"][:1], "block": pa.array([rows[0][0] // FAN], pa.int64()), "value": _binary([combine([v for _, v in rows], group["width"][0].as_py())])})

    parts = written(parts)
    while True:
        last = (parts.agg(F.max("block")).first()[0] or 0) == 0
        if last and parts.groupBy("width").count().where("count > 1").isEmpty():
            break
        after = written(parts.groupBy("width", F.floor(F.col("block") / FAN).alias("__b")).applyInArrow(stack, _PART))
        discard(parts)
        parts = after
    out = {r.width: bytes(r.value) for r in parts.collect()}
    discard(parts)
    return out


def triangles(fit: DataFrame, totals: dict[int, tuple[int, np.ndarray]], offset: int) -> dict[int, np.ndarray]:
    """R of the centred rows of ``fit`` (width, q) for each width."""

    def factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for w, _, q in unpacked(batch):
                if w:
                    n, total = totals[w]
                    rows = centred(q + offset, n, total).astype(np.float64) / n
                    held[w] = np.linalg.qr(np.vstack([held[w], rows]) if w in held else rows, mode="r")
        block = TaskContext.get().partitionId()
        if held:
            yield pa.record_batch([pa.array(list(held), pa.int32()), pa.array([block] * len(held), pa.int64()), _binary([r.tobytes() for r in held.values()])], names=["width", "block", "value"])

    def again(values: list[bytes], w: int) -> bytes:
        return np.linalg.qr(np.vstack([np.frombuffer(v).reshape(-1, w) for v in values]), mode="r").tobytes()

    return {w: np.frombuffer(value).reshape(-1, w) for w, value in merged(fit.mapInArrow(factor, _PART), again).items()}


def _joined(values: list[bytes], _: int = 0) -> bytes:
    """Moments (count, means, centred products) of several blocks as those of all their rows."""
    n, mean, product = 0.0, None, None
    for v in values:
        m = np.frombuffer(v)
        c = int(m[0])
        k, mu, p = m[1], m[2 : 2 + c], m[2 + c :].reshape(c, c)
        if mean is None:
            n, mean, product = k, mu, p
        else:
            delta = mu - mean
            product = product + p + np.outer(delta, delta) * (n * k / (n + k))
            mean = mean + delta * (k / (n + k))
            n += k
    return np.concatenate([[len(mean), n], mean, product.ravel()]).tobytes()


class Whitener:
    """What a fit list says of one length: its size n, exact sums S, components (columns), their deviations and shares."""

    def __init__(self, n: int, total: np.ndarray, r: np.ndarray, components: int):
        sigma, v = jacobi(r)
        rank = sigma > sigma[0] * max(n, len(sigma)) * np.finfo(np.float64).eps if sigma[0] > 0 else np.zeros(len(sigma), dtype=bool)
        variance, kept = (sigma**2) / n, min(components, len(total))
        self.n, self.total, self.v = n, total, v[:, :kept]
        self.deviation, self.varies = np.where(rank, sigma, 1.0)[:kept] / np.sqrt(n), rank[:kept]
        self.explained = np.where(rank, variance, 0.0)[:kept] / variance.sum() if variance.sum() > 0 else None

    def whitened(self, exact: np.ndarray) -> np.ndarray:
        """Projections of rows n * x - S, each over its component's deviation."""
        return (exact.astype(np.float64) / self.n) @ self.v / self.deviation


def fit(vectors: DataFrame, components: int = COMPONENTS, offset: int = OFFSET) -> tuple[dict[int, Whitener], dict[int, float | None]]:
    """For each length of the packed vectors (width, q): what whitens it, and the largest error of the whitened covariance."""
    once = written(vectors.select("width", "q").distinct())

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = {}, {}
        for batch in batches:
            for w, _, q in unpacked(batch):
                new = exact_sums(q + offset)
                n[w], total[w] = n.get(w, 0) + len(q), [a + b for a, b in zip(total[w], new, strict=True)] if w in total else new
        for w in n:
            some = range(w)
            yield pa.record_batch([pa.array([w] * w, pa.int32()), pa.array(some, pa.int32()), pa.array([n[w]] * w, pa.int64()), pa.array([Decimal(t) for t in total[w]], pa.decimal128(38, 0))], names=["width", "dim", "n", "s"])

    totals: dict[int, tuple[int, list[int]]] = {}
    sums = once.mapInArrow(add, "width int, dim int, n bigint, s decimal(38,0)").groupBy("width", "dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    for r in sums.orderBy("width", "dim").collect():
        totals.setdefault(r.width, (r.n, []))[1].append(int(r.s))
    if not totals:
        discard(once)
        return {}, {}
    exact = {w: (n, np.array(s, dtype=np.int64 if max(map(abs, s)) < LARGEST else object)) for w, (n, s) in totals.items()}
    found = {w: Whitener(*exact[w], r, components) for w, r in triangles(once, exact, offset).items()}

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, bytes] = {}
        for batch in batches:
            for w, _, q in unpacked(batch):
                if w and found[w].varies.any():
                    white = found[w].whitened(centred(q + offset, found[w].n, found[w].total))[:, found[w].varies]
                    mean = white.mean(axis=0)
                    rest = white - mean
                    new = np.concatenate([[len(mean), len(white)], mean, (rest.T @ rest).ravel()]).tobytes()
                    held[w] = _joined([held[w], new]) if w in held else new
        if held:
            yield pa.record_batch([pa.array(list(held), pa.int32()), pa.array([TaskContext.get().partitionId()] * len(held), pa.int64()), _binary(list(held.values()))], names=["width", "block", "value"])

    error: dict[int, float | None] = dict.fromkeys(found)
    for w, value in merged(once.mapInArrow(moments, _PART), _joined).items():
        m = np.frombuffer(value)
        c = int(m[0])
        error[w] = float(np.abs(m[2 + c :].reshape(c, c) / m[1] - np.eye(c)).max())
    discard(once)
    return found, error


def whiten(rows: DataFrame, components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """(vec_id, component, n, deviation decimal, whitened, explained, identity_error): a row for each row (vec_id, embedding) and component."""
    vectors = packed(rows, scale)
    found, error = fit(vectors, components, offset)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w, at, q in unpacked(batch):
                if not w:
                    continue
                own = found[w]
                exact = centred(q + offset, own.n, own.total)
                square, k = squares(exact), len(own.varies)
                deviation = pa.array(square).cast(pa.decimal128(38, 0)) if square.dtype != object else pa.array([Decimal(v) if v < 10**38 else None for v in square.tolist()], pa.decimal128(38, 0))
                repeat, white = pa.array(np.repeat(np.arange(len(at)), k)), own.whitened(exact)
                share = np.zeros(k) if own.explained is None else own.explained
                size = len(at) * k
                yield pa.record_batch(
                    [
                        batch.column("vec_id").take(pa.array(at)).take(repeat), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))), pa.array(np.full(size, own.n, dtype=np.int64)), deviation.take(repeat),
                        pa.array(white.ravel(), mask=~np.tile(own.varies, len(at))), pa.array(np.tile(share, len(at)), mask=np.full(size, own.explained is None)),
                        pa.array(np.full(size, error[w] or 0.0), mask=np.full(size, error[w] is None)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return vectors.mapInArrow(apply, "vec_id bigint, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deviation beyond 64 bits (possible from some 10^9 different vectors on) is null here; the operator has it as a decimal."""
    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))
