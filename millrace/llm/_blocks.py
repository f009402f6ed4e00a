"""Blocks of documents, and exact counts of their keys over the whole corpus.

A block is about ``BLOCK_BYTES`` of text, dealt by a hash of the rows; equal rows are dealt over all blocks. Each block
sends every different 64-bit key it holds once, with its own count, to the key's range of the key space; there the
counts are summed and the totals go back to the blocks that asked, in the order they sent. So a key that a third of
all rows hold travels once from each block, no task sees more than a block or a range, and nothing passes through the
driver.

``BLOCKS_TO_A_RANGE`` blocks' worth of keys meet in one range, so there are far fewer ranges than blocks. A block sends
one row to each range it has keys for: rows never exceed the different keys of the blocks, and what is sent grows with
the text alone. On executors with more memory raise ``BLOCK_BYTES``: rows then carry more keys each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._jobs import released, released_table, small_batches

BLOCK_BYTES = 4 << 20
BLOCKS_TO_A_RANGE = 4
Keys = Callable[[pa.Table], tuple[np.ndarray, np.ndarray]]


def blocks(docs: DataFrame, *more: Column) -> tuple[DataFrame, int]:
    """(blk, rows): the rows (doc_id, text, *more) of ``docs`` in compressed pieces, dealt by block, and the number of blocks."""
    size = small_batches(docs).agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n = max(2, -(-size // BLOCK_BYTES))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in batches:
            h = batch.column("__deal").to_numpy()
            same = np.argsort(h, kind="stable")
            new = np.ones(len(h), dtype=bool)
            new[1:] = h[same][1:] != h[same][:-1]
            at = np.empty(len(h), dtype=np.int64)
            # equal rows go to one block after the other; they are alike, so it does not matter which goes where
            at[same] = (h[same] % n + np.arange(len(h)) - np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))) % n
            order = np.argsort(at, kind="stable")
            names, start = np.unique(at[order], return_index=True)
            rows = batch.drop_columns(["__deal"])
            pieces = []
            for a, b in zip(start, np.append(start[1:], len(at)), strict=True):
                out = pa.BufferOutputStream()
                with pa.ipc.new_stream(out, rows.schema, options=options) as writer:
                    writer.write_batch(rows.take(pa.array(order[a:b])))
                pieces.append(out.getvalue().to_pybytes())
            yield pa.record_batch([pa.array(names, pa.int32()), pa.array(pieces, pa.binary())], names=["blk", "rows"])

    rows = docs.select(F.xxhash64("doc_id", "text").alias("__deal"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)
    return rows.mapInArrow(released(pack), "blk int, rows binary").repartition(n, "blk"), n


def opened(table: pa.Table) -> pa.Table:
    """The rows of one block, in an order that does not depend on the run (by doc_id, then text)."""
    found = pa.concat_tables(pa.ipc.open_stream(x).read_all() for x in table["rows"].to_pylist())
    return found.sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()


def range_count(n: int) -> int:
    return max(1, -(-n // BLOCKS_TO_A_RANGE))


def cuts(keys: np.ndarray, n: int) -> np.ndarray:
    """Where each of ``n`` equal ranges of the key space begins in sorted keys (n + 1 long)."""
    width = (1 << 64) // n + 1
    return np.append(np.searchsorted(keys, np.array([i * width for i in range(n)], dtype=np.uint64)), len(keys))


def packed(key: np.ndarray) -> bytes:
    """Sorted keys as steps, in as few bytes for each as hold them all; a low byte that is always zero is left out."""
    low = 8 if not (key & np.uint64(255)).any() else 0
    step = np.diff(key >> np.uint64(low), prepend=np.uint64(0))
    raw = step.astype("<u8").view(np.uint8).reshape(-1, 8)
    width = max(1, (int(step[1:].max(initial=0)).bit_length() + 7) // 8)
    return np.ascontiguousarray(raw[:, :width]).tobytes() + key[:1].tobytes() + bytes([low])


def unpacked(data: bytes, n: int) -> np.ndarray:
    raw = np.zeros((n, 8), dtype=np.uint8)
    width = (len(data) - 9) // n
    raw[:, :width] = np.frombuffer(data[:-9], dtype=np.uint8).reshape(n, width)
    low = np.uint64(data[-1])
    step = raw.view("<u8").ravel().astype(np.uint64)
    step[0] = np.frombuffer(data[-9:-1], dtype=np.uint64)[0] >> low
    return np.cumsum(step, dtype=np.uint64) << low


def planes(x: np.ndarray) -> bytes:
    """Whole numbers from 0 up, byte by byte in as many bytes as the largest needs: long runs of zeros, which Spark's shuffle compresses."""
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unplanes(data: bytes) -> np.ndarray:
    width = data[0]
    raw = np.zeros(((len(data) - 1) // width, 8), dtype=np.uint8)
    raw[:, :width] = np.frombuffer(data, dtype=np.uint8, offset=1).reshape(width, -1).T
    return raw.view("<i8").ravel()


SENT = "part int, blk int, keys binary, counts binary"


def sent(part_rows: list[int], blk: int, pieces: list[tuple[bytes, bytes]]) -> pa.Table:
    return pa.table({
        "part": pa.array(part_rows, pa.int32()), "blk": pa.array([blk] * len(part_rows), pa.int32()),
        "keys": pa.array([k for k, _ in pieces], pa.binary()), "counts": pa.array([c for _, c in pieces], pa.binary()),
    })


def cut_up(blk: int, key: np.ndarray, values: Callable[[slice], bytes], n: int) -> pa.Table:
    """Sorted keys of a block with what ``values`` packs for each stretch of them, one row for each of ``n`` ranges that gets any."""
    cut = cuts(key, n)
    parts = [k for k in range(n) if cut[k + 1] > cut[k]]
    spans = [slice(cut[k], cut[k + 1]) for k in parts]
    return sent(parts, blk, [(packed(key[s]), values(s)) for s in spans])


def met(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What blocks sent to a range, in block order, which makes every run alike: the rows; where each row's keys begin;
    the order that sorts all keys; which of them are the first of their kind in it; and the sorted keys."""
    table = table.sort_by("blk")
    size = [(len(x) - 1) // x[0] for x in table["counts"].to_pylist()]
    keys = np.concatenate([unpacked(x, n) for x, n in zip(table["keys"].to_pylist(), size, strict=True)])
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    first = np.ones(len(keys), dtype=bool)
    first[1:] = ordered[1:] != ordered[:-1]
    return table, np.cumsum([0, *size]), order, first, ordered


BACK = "blk int, part int, totals binary, owned binary"


def counted(rows: DataFrame, n: int, keys: Keys) -> DataFrame:
    """(blk, part, totals, owned): for each block and range, the corpus totals of the keys that ``keys`` finds in the block, in key order.

    ``keys`` gives sorted different keys and their counts within the block; it must give the same keys whenever it
    sees the same rows, whatever their order. ``owned`` has a bit for each key: one block owns each key.
    """
    ranges = range_count(n)

    def send(table: pa.Table) -> pa.Table:
        key, count = keys(opened(table))
        return cut_up(table["blk"][0].as_py(), key, lambda s: planes(count[s]), ranges)

    def add(table: pa.Table) -> pa.Table:
        table, cut, order, first, _ = met(table)
        total, first = summed(np.concatenate([unplanes(x) for x in table["counts"].to_pylist()]), order, first)
        return answered(table, cut, total, first)

    return rows.groupBy("blk").applyInArrow(released_table(send), SENT).groupBy("part").applyInArrow(released_table(add), BACK)


def summed(values: np.ndarray, order: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Total of each key beside every place that sent it, and which place stands for it, both in the order sent."""
    start = np.flatnonzero(first)
    total = np.add.reduceat(values[order], start) if len(start) else values[:0]
    out, own = np.empty_like(values), np.empty(len(values), dtype=bool)
    out[order] = np.repeat(total, np.diff(np.append(start, len(values))))
    own[order] = first
    return out, own


def answered(table: pa.Table, cut: np.ndarray, total: np.ndarray, own: np.ndarray) -> pa.Table:
    spans = [slice(cut[i], cut[i + 1]) for i in range(len(table))]
    return pa.table({
        "blk": table["blk"], "part": table["part"], "totals": pa.array([planes(total[s]) for s in spans], pa.binary()),
        "owned": pa.array([np.packbits(own[s]).tobytes() for s in spans], pa.binary()),
    })


def totals(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Totals and owner marks that came back to a block, in the order of its keys."""
    rows = sorted(zip(table["part"].to_pylist(), table["totals"].to_pylist(), table["owned"].to_pylist(), strict=True))
    count = [unplanes(x) for _, x, _ in rows]
    own = [np.unpackbits(np.frombuffer(x, dtype=np.uint8), count=len(c)).astype(bool) for (_, _, x), c in zip(rows, count, strict=True)]
    return np.concatenate([np.zeros(0, dtype=np.int64), *count]), np.concatenate([np.zeros(0, dtype=bool), *own])


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted different values, by one sort."""
    values = np.sort(values)
    new = np.ones(len(values), dtype=bool)
    new[1:] = values[1:] != values[:-1]
    return values[new]


def gathered(pieces: Iterator[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different keys of all pieces, with how often each comes."""
    found = [x for x in pieces if len(x)]
    if not found:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    return np.unique(np.concatenate(found), return_counts=True)
