"""Centroid clustering by weighted deduplication: equal quantised vectors are one vector with a multiplicity.

Vectors become whole numbers (entry times scale, rounded down), packed in few bytes. Lloyd's rounds run over the distinct vectors and
add weight times vector in whole numbers, so sums and the floors of sum / count are exact and do not depend on the order of rows. Tasks send
one partial sum for each centroid and entry. At the end the assignments are joined back to the ids by the packed vector; a
vector with more than one row in ``PIECES`` is dealt over several keys (at most ``PIECES`` vectors are that common, which bounds the
broadcast that says so), so no key has more rows than that.

Defined results: rows whose vector is null, has another length, holds null or non-finite entries, or entries of 2^62 and more after scaling, go.
Start centroids are the rows with the least SHA-256 of ``<seed>:<vec_id>``; of equal ids the least packed vector comes first, rows without an id
come last. Fewer rows than ``k`` give as many centroids. Ties go to the smaller number, an empty centroid stays where it is. Repeated rows count
as often as they come and each give a row. A distance beyond 64 bits, and a sum with one, is null. No rows give none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._jobs import discard, table, written
from ._lattice import LARGEST, largest, packed, squares, sums, unpacked

K, ROUNDS, SCALE, WIDTH, SEED = 16, 3, 64, 64, "1"
#: A vector with more than one row in so many is dealt over several keys.
PIECES = 2000


class Centroids:
    """Centroids as exact whole numbers."""

    def __init__(self, points: list[list[int]]):
        self.points = points
        self.matrix = np.array(points, dtype=np.int64).reshape(len(points), len(points[0]) if points else 0)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid of each row, and the squared distance as a whole number."""
        c = self.matrix
        top = max(largest(x), largest(c), 1.0)
        if 8 * top * top * max(x.shape[1], 1) < 2**53:  # then the products in floating point are exact
            f, g = x.astype(np.float64), c.astype(np.float64)
            away = (f * f).sum(axis=1)[:, None] - 2 * (f @ g.T) + (g * g).sum(axis=1)
            away = away.astype(np.int64)
        else:
            away = np.stack([squares(x.astype(object) - p.astype(object)) if top >= 2**30 else squares(x - p) for p in c], axis=1)
        first = away.argmin(axis=1)
        return first, away[np.arange(len(x)), first]

    def moved(self, total: dict[int, tuple[int, list[int]]]) -> Centroids:
        return Centroids([[s // total[k][0] for s in total[k][1]] if k in total else p for k, p in enumerate(self.points)])

    def digest(self, k: int) -> str:
        return hashlib.sha256(",".join(map(str, self.points[k])).encode()).hexdigest()


def started(vectors: DataFrame, k: int, seed: str) -> Centroids:
    """The ``k`` vectors with the least hash of seed and id, in the order of the hashes."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select("width", "q", key.alias("h")).orderBy(F.col("h").asc_nulls_last(), "q").limit(k).collect()
    return Centroids([np.frombuffer(bytes(r.q), dtype=f"<i{len(r.q) // r.width}").tolist() if r.width else [] for r in rows])


def totals(classes: DataFrame, centroids: Centroids) -> dict[int, tuple[int, list[int]]]:
    """Rows and exact sums of the vectors nearest to each centroid; centroids without any are left out."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[int, list[int]] = {}
        for batch in batches:
            weight = batch.column("weight").to_numpy()
            for _, at, x in unpacked(batch):
                first, _ = centroids.nearest(x)
                for c in np.unique(first).tolist():
                    own = weight[at[first == c]]
                    new = [int(own.sum()), *sums(x[first == c], own)]
                    out[c] = [a + b for a, b in zip(out[c], new, strict=True)] if c in out else new
        for c, values in out.items():
            yield pa.record_batch([pa.array([c] * len(values), pa.int32()), pa.array(range(len(values)), pa.int32()), pa.array([Decimal(v) for v in values], pa.decimal128(38, 0))], names=["cluster", "at", "s"])

    rows = classes.select("width", "q", "weight").mapInArrow(add, "cluster int, at int, s decimal(38,0)").groupBy("cluster", "at").agg(F.sum("s").alias("s")).orderBy("cluster", "at").collect()
    out: dict[int, list[int]] = {}
    for r in rows:
        out.setdefault(r.cluster, []).append(int(r.s))
    return {c: (v[0], v[1:]) for c, v in out.items()}


def assigned(classes: DataFrame, centroids: Centroids) -> DataFrame:
    """``classes`` (width, q, weight) with cluster and distance."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, at, x in unpacked(batch):
                first, away = centroids.nearest(x)
                some = pa.array(at)
                distance = pa.array(away) if away.dtype != object else pa.array([int(d) if d < 1 << 63 else None for d in away], pa.int64())
                yield pa.record_batch([batch.column("q").take(some), batch.column("weight").take(some), pa.array(first.astype(np.int32)), distance], names=["q", "weight", "cluster", "distance"])

    return classes.select("width", "q", "weight").mapInArrow(apply, "q binary, weight bigint, cluster int, distance bigint")


def cluster(rows: DataFrame, k: int = K, times: int = ROUNDS, scale: int = SCALE, width: int = WIDTH, seed: str = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept row of ``rows`` (vec_id, embedding)."""
    spark = rows.sparkSession
    vectors = packed(rows, scale, width)
    classes = written(vectors.groupBy("width", "q").agg(F.count("*").alias("weight")))
    centroids = started(vectors, k, seed)
    for _ in range(times):
        centroids = centroids.moved(totals(classes, centroids))
    found = written(assigned(classes, centroids))
    discard(classes)
    inertia = F.when(F.count("distance") == F.count("*"), F.sum(F.col("distance").cast("decimal(20,0)") * F.col("weight").cast("decimal(18,0)")))
    each = found.groupBy("cluster").agg(F.sum("weight").alias("n"), inertia.alias("s")).collect()
    n, whole = sum(r.n for r in each), None if any(r.s is None for r in each) else sum(int(r.s) for r in each)
    fits = lambda v: int(v) if v is not None and v < 1 << 63 else None
    named = spark.createDataFrame(
        [(r.cluster, fits(r.s), fits(whole), centroids.digest(r.cluster)) for r in each], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    )  # at most k rows
    most = max(n // PIECES, 1000)
    pieces = F.ceil(F.col("weight") / most).cast("int")
    common = found.where(F.col("weight") > most).select("q", pieces.alias("pieces"))
    ids = vectors.join(F.broadcast(common), "q", "left").select("vec_id", "q", F.pmod("place", F.coalesce("pieces", F.lit(1))).cast("int").alias("piece"))
    answers = found.select("q", "cluster", "distance", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece"))
    return ids.join(answers, ["q", "piece"]).join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """Long tables of (row, entry, value) and (centroid, entry, value); each round is one assignment and one update."""
    parts = [
        """v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "e AS (SELECT r, unnest(range(64)) AS i, unnest(x) AS a FROM v)",
        """c0 AS (SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x FROM (SELECT sha256('1:' || CAST(vec_id AS VARCHAR)) AS h, x FROM v ORDER BY h NULLS LAST, x LIMIT 16))""",
        "k0 AS (SELECT c, unnest(range(64)) AS i, unnest(x) AS b FROM c0)",
    ]
    for t in range(ROUNDS + 1):
        parts.append(
            f"""a{t} AS (SELECT r, c, d FROM (SELECT r, c, CAST(sum((a - b) * (a - b)) AS BIGINT) AS d FROM e JOIN k{t} ON e.i = k{t}.i GROUP BY r, c)
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)"""
        )
        if t < ROUNDS:
            parts.append(
                f"""s{t} AS (SELECT c, i, CAST(sum(a) AS BIGINT) AS s, count(*) AS n FROM e JOIN a{t} ON e.r = a{t}.r GROUP BY c, i),
k{t + 1} AS (SELECT k.c, k.i, coalesce((s - ((s % n) + n) % n) // n, b) AS b FROM k{t} k LEFT JOIN s{t} s ON s.c = k.c AND s.i = k.i)"""
            )
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
FROM a{ROUNDS} a JOIN v ON v.r = a.r JOIN (SELECT c, sha256(string_agg(CAST(b AS VARCHAR), ',' ORDER BY i)) AS h FROM k{ROUNDS} GROUP BY c) k ON k.c = a.c"""


OP12_SQL = _sql()
