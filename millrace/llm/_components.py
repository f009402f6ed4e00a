"""Connected components as DataFrame joins: in each round every node joins its neighbour with the smallest salted hash.

Each partition first keeps a spanning forest of its own edges, so what is joined never exceeds the nodes a partition
knows. Rounds shrink the graph by a constant share whatever its shape; a hub's rows meet in partial aggregates and in
joins that Spark can split. Every round is written to the shared folder. Once at most ``FEW`` edges are left, whatever the
graph was, their forest is its last round: rounds over so little would cost the driver its memory in jobs, plans and tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._jobs import written

#: Edges (of 16 bytes) that one task finishes; more are shrunk by rounds first.
FEW = 16_384


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its component) that span the same components as the edges (a, b)."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    one, two = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        x, y = label[one], label[two]
        open_ = x != y
        if not open_.any():
            break
        np.minimum.at(label, np.maximum(x, y)[open_], np.minimum(x, y)[open_])
        while (label[label] != label).any():
            label = label[label]
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    u, v = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    for batch in batches:
        u, v = forest(np.concatenate([u, batch.column(0).to_numpy()]), np.concatenate([v, batch.column(1).to_numpy()]))
    yield pa.record_batch([pa.array(u), pa.array(v)], names=["u", "v"])


def _moved(rows: DataFrame, parent: DataFrame, c: str) -> DataFrame:
    """``rows`` with the nodes in column ``c`` replaced by their parents (k, to), where they have one."""
    return rows.join(parent, F.col(c) == F.col("k"), "left").withColumn(c, F.coalesce("to", c)).drop("k", "to")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that an edge (u, v; bigint) touches; a component is named by its smallest node.

    Null ends and loops are no edges; no edges give no rows.
    """
    edges = written(edges.select("u", "v").where("u <> v").mapInArrow(_forests, "u bigint, v bigint"))
    label = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("p", F.col("node"))
    k = 0
    while left := edges.count():
        k += 1
        if left <= FEW:
            parent = written(edges.coalesce(1).mapInArrow(_forests, "u bigint, v bigint").select(F.col("u").alias("k"), F.col("v").alias("to")))
            label = _moved(label, parent, "p")
            break
        hashed = lambda c: F.xxhash64(F.lit(k), c)  # noqa: E731, B023
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.struct(hashed("v").alias("h"), "v")).alias("m"))
        parent = written(least.where(F.col("m.h") < hashed("u")).select(F.col("u").alias("k"), F.col("m.v").alias("to")))
        renamed = edges
        for c in ("u", "v"):
            renamed = _moved(renamed, parent, c)
        edges = written(renamed.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct().mapInArrow(_forests, "u bigint, v bigint"))
        label = _moved(label, parent, "p")
    label = written(label)
    return label.join(label.groupBy("p").agg(F.min("node").alias("component")), "p").select("node", "component")
