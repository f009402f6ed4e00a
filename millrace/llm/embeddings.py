"""Embedding near-duplicates: Euclidean p-stable hashing in several tables, then exact cosine checks.

Equal vectors are one class with a weight. Every class is normalised and hashed by quantised Gaussian projections
into ``tables`` buckets; members of a bucket are compared by cosine in double precision. A pair is counted in the first
table that brings it together (the buckets of linked members in the tables before are computed again from their vectors, number for number
as at first), so counts add up without a list of pairs, and a bucket hands on a spanning forest instead of its pairs. Vectors travel as they
came, floats in four bytes, once for each table: bytes are linear in the tables. A bucket with more than ``BUCKET`` members is dealt out in pairs of blocks that cover all its
pairs, so no task holds more than two blocks.

Number of tables and projections follow from the number of vectors: at the threshold a pair is missed by all tables
with a chance below ``MISS``, and a vector meets about ``STRANGERS`` unrelated ones in a table.

Defined results: vectors that are null, empty, zero or hold null or non-finite parts link with nothing, nor do vectors of different
lengths; each such row is its own component. Rows without an id link like others; a component without any id has a
null name. Repeated rows are vectors of their own, linked to each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._components import components, forest
from ._jobs import released, small_batches, table, written

THRESHOLD = 0.95
MISS, STRANGERS = 1e-3, 8
#: Members of a bucket that are compared in one piece.
BUCKET = 2048
#: A vector with more than one row in so many is dealt over several keys when ids are joined back.
PIECES = 2000
#: Width of a quantisation step, in units of the normalised vectors; near the best for cosine 0.95.
STEP = 2.0


def collision(distance: float, step: float = STEP) -> float:
    """Chance that two vectors at this distance share one quantised projection."""
    c = step / distance
    return math.erf(c / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * c) * (1 - math.exp(-c * c / 2))


def plan(n: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """Projections for each table, and tables."""
    near, far = collision(math.sqrt(2 - 2 * threshold)), collision(math.sqrt(2))
    k = max(4, math.ceil(math.log(max(n, 1) / STRANGERS + 1) / -math.log(far)))
    return k, math.ceil(math.log(MISS) / math.log(1 - near**k))


class Tables:
    """Projections of all tables for vectors of one length; the same on every executor."""

    def __init__(self, width: int, k: int, tables: int, seed: int = 5):
        random = np.random.Generator(np.random.PCG64([seed, width]))
        self.a = random.standard_normal((width, k * tables))
        self.b = random.uniform(0, STEP, k * tables)
        self.m = random.integers(1, 2**62, k * tables, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.k, self.tables = k, tables

    def codes(self, x: np.ndarray, tables: int | None = None) -> np.ndarray:
        """One 64-bit bucket for each vector and table (or each of the first ``tables``), the same whatever other vectors and tables are computed with it."""
        tables = self.tables if tables is None else tables
        sums = np.tile(self.b[: self.k * tables], (len(x), 1))
        for j in range(x.shape[1]):  # one entry after the other: products of matrices would round by their shapes
            sums += x[:, j : j + 1] * self.a[j, : self.k * tables]
        step = np.floor(sums / STEP).astype(np.int64).view(np.uint64)
        mixed = (step * self.m[: self.k * tables]).reshape(len(x), tables, self.k)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        return np.bitwise_xor.reduce(mixed ^ (mixed >> np.uint64(32)), axis=2)


@lru_cache(4)
def projections(width: int, k: int, tables: int) -> Tables:
    return Tables(width, k, tables)


def _normalised(raw: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), dtype=kind).reshape(len(raw), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # very large and very small parts neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(embedding):
    """Whether a vector can link at all."""
    good = ~F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(embedding) > 0) & good & F.exists(embedding, lambda x: x != 0), F.lit(False))


def links(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``rows`` (vec_id, embedding)."""
    single = rows.schema["embedding"].dataType.simpleString() == "array<float>"
    kind = "<f4" if single else "<f8"
    rows = small_batches(rows).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("embedding"))
    valid = rows.where(usable("embedding"))
    classes = written(
        valid.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight")).withColumn("cls", F.monotonically_increasing_id())
    )
    distinct, n = classes.agg(F.count("*"), F.coalesce(F.sum("weight"), F.lit(0))).first()
    k, tables = plan(distinct, threshold)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("embedding")
            width = lists.value_lengths().to_numpy(zero_copy_only=False)
            for d in np.unique(width):
                own = batch.filter(pa.array(width == d))
                raw = own.column("embedding").flatten().to_numpy().reshape(len(own), d).astype(kind)
                vectors = [x.tobytes() for x in raw]
                for part in range(0, len(own), 256):
                    some = projections(int(d), k, tables).codes(_normalised(vectors[part : part + 256], kind)).view(np.int64)
                    m = len(some)
                    repeat = np.repeat(np.arange(m), tables)
                    yield pa.record_batch(
                        [
                            pa.array(np.tile(np.arange(tables), m).astype(np.int32)), pa.array(np.full(m * tables, d, dtype=np.int32)), pa.array(some.ravel()),
                            own.column("cls").slice(part, m).take(pa.array(repeat)), own.column("weight").slice(part, m).take(pa.array(repeat)),
                            pa.array(vectors[part : part + m], pa.binary()).take(pa.array(repeat)),
                        ],
                        names=["t", "width", "code", "cls", "weight", "vector"],
                    )

    dealt = classes.select("cls", "weight", "embedding").mapInArrow(released(hashed), "t int, width int, code bigint, cls bigint, weight bigint, vector binary")
    key = ["t", "width", "code"]
    crowded = dealt.groupBy(*key).count().where(F.col("count") > BUCKET).select(*key, F.ceil(F.col("count") * 2 / BUCKET).cast("int").alias("s"))
    block = F.pmod(F.xxhash64("cls"), F.col("s")).cast("int")
    pairs = (
        dealt.join(crowded, key, "left").withColumn("s", F.coalesce("s", F.lit(1))).withColumn("blk", block)
        .withColumn("other", F.explode(F.expr("sequence(0, s - 1)")))
        .select(*key, F.least("blk", "other").alias("one"), F.greatest("blk", "other").alias("two"), "blk", "cls", "weight", "vector")
    )
    keys = [*key, "one", "two"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, keys):
            if group.num_rows > 1:
                yield from _compared(group, threshold, kind, k, tables)

    found = written(pairs.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(released(compare), "u bigint, v bigint, n bigint"))
    counts = found.where("n > 0").groupBy(F.col("u").alias("cls")).agg(F.sum("n").alias("n"))
    parts = components(found.where("n = 0").select("u", "v")).select(F.col("node").alias("cls"), "component")
    known = classes.join(counts, "cls", "left").join(parts, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    least = known.groupBy("component").agg(F.min("rep").alias("component_id"))
    most = max(n // PIECES, 1000)
    pieces = F.ceil(F.col("weight") / most).cast("int")
    common = classes.where(F.col("weight") > most).select("embedding", pieces.alias("pieces"))  # at most PIECES vectors have so many rows
    dealt_ids = valid.join(F.broadcast(common), "embedding", "left").withColumn("piece", F.pmod(F.xxhash64("vec_id"), F.coalesce("pieces", F.lit(1))).cast("int"))
    known = known.join(least, "component").select("embedding", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece"))
    linked = dealt_ids.join(known, ["embedding", "piece"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~usable("embedding")).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys in batches sorted by them; a run may span batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in columns)
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        cut = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            if held and a > 0:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)


def _compared(group: pa.Table, threshold: float, kind: str, projected: int, tables: int) -> Iterator[pa.RecordBatch]:
    """Links of one bucket (or pair of blocks) that no earlier table has: weighted counts, and a spanning forest with n = 0."""
    t, one, two = (group[c][0].as_py() for c in ("t", "one", "two"))
    cls, weight, blk = (group[c].to_numpy() for c in ("cls", "weight", "blk"))
    order = np.argsort(cls, kind="stable")
    x = _normalised(group["vector"].to_pylist(), kind)[order]
    cls, weight, blk = cls[order], weight[order], blk[order]
    left, right = (np.arange(len(cls)),) * 2 if one == two else (np.flatnonzero(blk == one), np.flatnonzero(blk == two))
    a, b = np.nonzero(x[left] @ x[right].T >= threshold)
    a, b = left[a], right[b]
    keep = a < b if one == two else np.ones(len(a), dtype=bool)
    a, b = a[keep], b[keep]
    if t and len(a):
        linked = np.unique(np.concatenate([a, b]))
        table_ = projections(x.shape[1], projected, tables)
        code = np.concatenate([table_.codes(x[linked[part : part + 256]], t) for part in range(0, len(linked), 256)])
        one_, two_ = np.searchsorted(linked, a), np.searchsorted(linked, b)
        keep = np.ones(len(a), dtype=bool)
        for part in range(0, len(a), 200_000):
            keep[part : part + 200_000] = ~(code[one_[part : part + 200_000]] == code[two_[part : part + 200_000]]).any(axis=1)
        a, b = a[keep], b[keep]
    if not len(a):
        return
    n = np.bincount(a, weights=weight[b], minlength=len(cls)) + np.bincount(b, weights=weight[a], minlength=len(cls))
    some = np.flatnonzero(n)
    u, v = forest(cls[a], cls[b])
    yield pa.record_batch(
        [pa.array(np.concatenate([cls[some], u])), pa.array(np.concatenate([cls[some], v])), pa.array(np.concatenate([n[some].astype(np.int64), np.zeros(len(u), dtype=np.int64)]))],
        names=["u", "v", "n"],
    )


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(table(spark, sf_dir, "embeddings"))


OP9_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v),
p AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) >= 0.95),
r AS (SELECT x AS node, x AS root FROM p UNION SELECT p.y, r.root FROM r JOIN p ON p.x = r.node),
m AS (SELECT node, min(root) AS comp FROM r GROUP BY node),
n AS (SELECT x, count(*) AS n FROM p GROUP BY x)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, CAST(coalesce(m.comp, vec_id) AS BIGINT) AS component_id, coalesce(m.comp, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN n ON n.x = vec_id LEFT JOIN m ON m.node = vec_id
"""
