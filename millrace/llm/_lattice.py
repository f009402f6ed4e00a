"""Vectors as whole numbers: every entry times a scale, rounded down, and packed in as few bytes as the vector needs.

Equal vectors have equal bytes, so the packed form is a key. Reading back gives matrices of 64-bit numbers; sums that might
leave 64 bits are taken with Python's whole numbers, so they are exact whatever the entries are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._jobs import small_batches

#: Entries from here on have no 64-bit whole number; vectors that hold one are left out.
LARGEST = float(1 << 62)


def packed(rows: DataFrame, scale: int = 64, width: int | None = None) -> DataFrame:
    """(vec_id, width, q, place) of the rows (vec_id, embedding) whose vector is whole: not null, without null or non-finite
    entries, of ``width`` entries if that is given. q: the packed vector; place: the row's number in its task."""
    kind = rows.schema["embedding"].dataType.simpleString()
    rows = small_batches(rows).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast(kind if kind in ("array<float>", "array<double>") else "array<double>").alias("embedding"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            ids, lists = batch.column("vec_id"), batch.column("embedding")
            length = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            scaled = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale  # a null entry is no number
            with np.errstate(invalid="ignore"):
                bad = np.concatenate([[0], np.cumsum(~(np.abs(scaled) < LARGEST))])
            start = np.concatenate([[0], np.cumsum(length)])
            keep = lists.is_valid().to_numpy(zero_copy_only=False) & (bad[start[1:]] == bad[start[:-1]])
            if width is not None:
                keep &= length == width
            for w in np.unique(length[keep]).tolist():
                at = np.flatnonzero(keep & (length == w))
                whole = np.floor(scaled[start[at][:, None] + np.arange(w)])
                size = np.ones(len(at), dtype=np.int64)
                if w:
                    low, high = whole.min(axis=1), whole.max(axis=1)
                    for s in (1, 2, 4):
                        size[(high > 2 ** (8 * s - 1) - 1) | (low < -(2 ** (8 * s - 1)))] = 2 * s
                for s in np.unique(size).tolist():
                    own = at[size == s]
                    data = whole[size == s].astype(f"<i{s}").tobytes()
                    offsets = pa.py_buffer((np.arange(len(own) + 1) * (s * w)).astype(np.int32).tobytes())
                    yield pa.record_batch(
                        [ids.take(pa.array(own)), pa.array(np.full(len(own), w, dtype=np.int32)), pa.BinaryArray.from_buffers(pa.binary(), len(own), [None, offsets, pa.py_buffer(data)]), pa.array(own + seen)],
                        names=["vec_id", "width", "q", "place"],
                    )
            seen += batch.num_rows

    return rows.mapInArrow(pack, "vec_id bigint, width int, q binary, place bigint")


def unpacked(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(width, places in the batch, whole numbers of 64 bits) for each width and size of its packed vectors."""
    width, q = batch.column("width").to_numpy(), batch.column("q")
    length = pc.binary_length(q).to_numpy(zero_copy_only=False)
    for w, n in sorted(set(zip(width.tolist(), length.tolist(), strict=True))):
        at = np.flatnonzero((width == w) & (length == n))
        data = b"".join(q.take(pa.array(at)).to_pylist())
        yield w, at, np.frombuffer(data, dtype=f"<i{n // w}").reshape(len(at), w).astype(np.int64) if w else np.zeros((len(at), 0), dtype=np.int64)


def largest(x: np.ndarray) -> float:
    return float(np.abs(x.astype(np.float64)).max(initial=0.0))


def sums(x: np.ndarray, weight: np.ndarray | None = None) -> list[int]:
    """Exact sums of the columns, each row as often as its weight says."""
    rows = float(len(x) if weight is None else weight.sum())
    if largest(x) * rows >= LARGEST:
        x = x.astype(object)
    return [int(v) for v in (x.sum(axis=0) if weight is None else (x * weight[:, None]).sum(axis=0))]


def squares(x: np.ndarray) -> np.ndarray:
    """Exact sums of the squares of each row, as 64-bit or Python's whole numbers."""
    if largest(x) ** 2 * max(x.shape[1], 1) >= LARGEST:
        x = x.astype(object)
    return (x * x).sum(axis=1) if x.shape[1] else np.zeros(len(x), dtype=np.int64)
