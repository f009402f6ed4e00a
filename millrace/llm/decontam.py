"""Benchmark decontamination: a broadcast hash set of normalised test n-grams against the token windows of the training texts.

A-Z is lower-cased and words are runs of digits, letters and bytes beyond ASCII. An item gives every window of
``width`` consecutive words, or itself whole when it has fewer (but some). Document windows of the same lengths are
hashed from prefix sums, looked up, and every hit is compared word for word before it counts. The benchmark goes
out in blocks of bounded size (usually one). Each has a pass over the rows, whose results are written before the next block goes out, so what is
broadcast or held by a worker does not grow with it.

Defined results: null and empty texts have no words, are never contaminated, and name no items. An item without
words (null, empty, marks only) has no window; one without id hits but names no item. Items that share a window are all
named; repeated item rows count once. Repeated documents are judged alike, each on its own. Columns of ``docs`` named
n_words, hits or items are replaced by ``scan``; ``drop_contaminated`` and ``cut_spans`` leave all columns as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._jobs import discard, released, small_batches, table, written
from ._text import ALNUM, LOWER, Slice, gram_hashes, slices, word_hashes

WIDTH = 13
#: Bytes of the benchmark's text that one broadcast is made of; its windows take about six times as much.
BLOCK_BYTES = 8 << 20
#: A document is contaminated when its hit words are at least one in so many.
ONE_IN = 20
FILTER_BITS = 20


@dataclass
class Windows:
    """The windows of one block of items in flat arrays: about 24 bytes for each, and the items' words once.

    ``words`` holds every item's words joined by blanks; a window is a piece of it. By length: sorted ``hashes`` of the different windows,
    where each begins and ends in ``words``, and the numbers of its items (``items[first[k]:first[k + 1]]``) in ``names``.
    """

    words: bytes
    names: list[str]
    by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    maybe: dict[int, np.ndarray]

    @classmethod
    def of(cls, items: list[tuple[str | None, str | None]], width: int) -> Windows:
        names = sorted({str(k) for k, _ in items if k is not None})
        number = {k: n for n, k in enumerate(names)}
        pieces, size = [], 0
        found: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]] = {}
        for part in slices(pa.array([t for _, t in items], pa.large_string())):
            hashes, start, end, bounds = word_hashes(part, ALNUM)
            folded = LOWER[part.data].tobytes()
            for i in range(part.n):
                first, last = int(bounds[i]), int(bounds[i + 1])
                length = min(width, last - first)
                if not length:
                    continue
                pieces.append(b" ".join(folded[a:b] for a, b in zip(start[first:last].tolist(), end[first:last].tolist(), strict=True)) + b" ")
                ends = np.cumsum(end[first:last] - start[first:last] + 1) + size - 1  # of each word in ``words``
                begins = np.append(size, ends[:-1] + 1)
                grams = gram_hashes(hashes[first:last], length)
                item = items[part.first + i][0]
                own = np.full(len(grams), -1 if item is None else number[str(item)], dtype=np.int32)
                found.setdefault(length, []).append((grams, begins[: len(grams)].astype(np.int64), ends[length - 1 :].astype(np.int64), own))
                size += len(pieces[-1])
        words = b"".join(pieces)
        by_length, maybe = {}, {}
        for length in list(found):
            parts = found.pop(length)
            hashes, begin, end, item = (np.concatenate(c) for c in zip(*parts, strict=True))
            del parts
            order = np.argsort(hashes, kind="stable")
            hashes, begin, end, item = hashes[order], begin[order], end[order], item[order]
            group = np.arange(len(hashes))
            for k in (np.flatnonzero(hashes[1:] == hashes[:-1]) + 1).tolist():  # the same window of several items, or two windows with one hash
                other = k - 1
                while other >= 0 and hashes[other] == hashes[k]:
                    if words[begin[group[other]] : end[group[other]]] == words[begin[k] : end[k]]:
                        group[k] = group[other]
                        break
                    other -= 1
            kept, own = np.unique(group, return_inverse=True)
            pairs = np.unique(own[item >= 0] * np.int64(len(names) + 1) + item[item >= 0])
            first = np.searchsorted(pairs // (len(names) + 1), np.arange(len(kept) + 1))
            by_length[length] = (hashes[kept], begin[kept], end[kept], first, (pairs % (len(names) + 1)).astype(np.int32))
            maybe[length] = np.zeros(1 << FILTER_BITS, dtype=bool)
            maybe[length][(by_length[length][0] >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        return cls(words, names, by_length, maybe)

    def hits(self, part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, dict[int, set[str]]]:
        """start and end byte of each word, per-document bounds, whether it is hit, and the items of each document."""
        hashes, start, end, bounds = word_hashes(part, ALNUM)
        change = np.zeros(len(hashes) + 1, dtype=np.int32)
        items: dict[int, set[str]] = {}
        folded = None
        for length, (known, begin, finish, first, item) in self.by_length.items():
            grams = gram_hashes(hashes, length)
            at = np.flatnonzero(self.maybe[length][(grams >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
            if not len(at):
                continue
            spot = np.minimum(np.searchsorted(known, grams[at]), len(known) - 1)
            same = known[spot] == grams[at]
            at, spot = at[same], spot[same]
            doc = np.searchsorted(bounds, at, side="right") - 1
            inside = at + length <= bounds[doc + 1]
            for i, k, d in zip(at[inside].tolist(), spot[inside].tolist(), doc[inside].tolist(), strict=True):
                if folded is None:
                    folded = LOWER[part.data].tobytes()
                own = b" ".join(folded[start[j] : end[j]] for j in range(i, i + length))
                while k < len(known) and known[k] == grams[i]:
                    if own == self.words[begin[k] : finish[k]]:
                        change[i] += 1
                        change[i + length] -= 1
                        items.setdefault(d, set()).update(self.names[x] for x in item[first[k] : first[k + 1]].tolist())
                        break
                    k += 1
        return start, end, bounds, np.cumsum(change)[:-1] > 0, items


def blocks(benchmark: DataFrame, width: int = WIDTH, most: int = BLOCK_BYTES) -> Iterator[Windows]:
    """The benchmark's windows in blocks of about ``most`` bytes of text; each block is all the driver ever holds. Items without an id are dealt by their text."""
    size = benchmark.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n = max(1, -(-size // most))
    for k in range(n):
        rows = benchmark.where(F.pmod(F.xxhash64(F.coalesce(F.col("item_id").cast("string"), "text")), F.lit(n)) == k).select(F.col("item_id").cast("string"), "text").collect()
        yield Windows.of([(r[0], r[1]) for r in rows], width)


FOUND = "n_words bigint, hits array<struct<first: int, last: int>>, items array<string>"
NEW = ("n_words", "hits", "items")


def _found(docs: DataFrame, benchmark: DataFrame, width: int, most: int, keep: list[str] | None = None) -> DataFrame:
    """(row, n_words, hits, items): every row of ``docs`` with all its columns (or ``keep``) in ``row``, so that no names clash; text comes too."""
    out = small_batches(docs).select(F.struct(*(keep if keep is not None else ["*"])).alias("row"), F.col("text").cast("string").alias("text"))
    kind = out.schema["row"].dataType.simpleString()
    shared = None
    for k, windows in enumerate(blocks(benchmark, width, most)):
        if shared is not None:  # one block lives at a time: what the one before found is written
            before, out = out if k > 1 else None, written(out)
            shared.destroy()
            if before is not None:
                discard(before)
        shared = docs.sparkSession.sparkContext.broadcast(windows)
        out = out.mapInArrow(released(_scanner(shared, k == 0)), f"row {kind}, text string, {FOUND}")
    return out


def scan(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, keep: list[str] | None = None, most: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` (columns ``keep``; all by default) with n_words, the maximal runs of hit words (numbers, last excluded) and the items found.

    One scan for each block of the benchmark and no shuffle.
    """
    stay = [c for c in (keep if keep is not None else docs.columns) if c.lower() not in NEW]
    return _found(docs, benchmark, width, most, stay or ["text"]).select(*(F.col("row")[c].alias(c) for c in stay), *NEW)


def _scanner(shared, first: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = shared.value
        for batch in batches:
            for part in slices(batch.column("text")):
                rows = batch.slice(part.first, part.n)
                start, _, bounds, hit, items = windows.hits(part)
                found = [items.get(i, set()) for i in range(part.n)]
                if not first:  # join what earlier blocks found
                    hit = hit.copy()
                    for i, (runs, names) in enumerate(zip(rows.column("hits").to_pylist(), rows.column("items").to_pylist(), strict=True)):
                        for run in runs:
                            hit[bounds[i] + run["first"] : bounds[i] + run["last"]] = True
                        found[i] = found[i] | set(names)
                    rows = rows.drop_columns(["n_words", "hits", "items"])
                padded = np.zeros(len(hit) + part.n + 1, dtype=np.int8)  # one gap between documents
                place = np.arange(len(hit)) + np.searchsorted(bounds[1:], np.arange(len(hit)), side="right") + 1
                padded[place] = hit
                edge = np.flatnonzero(np.diff(padded)) + 1
                one, two = edge[0::2], edge[1::2]
                owner = np.searchsorted(bounds[1:] + np.arange(1, part.n + 1), one, side="left") if part.n else one
                base = bounds[owner] + owner + 1
                cuts = np.searchsorted(owner, np.arange(part.n + 1))
                runs = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays([pa.array(one - base, pa.int32()), pa.array(two - base, pa.int32())], ["first", "last"]))
                yield pa.record_batch(
                    [*rows.columns, pa.array(np.diff(bounds), pa.int64()), runs, pa.array([sorted(x) for x in found], pa.list_(pa.string()))],
                    names=[*rows.schema.names, "n_words", "hits", "items"],
                )

    return run


def judged(found: DataFrame) -> DataFrame:
    """n_hit and contaminated beside what ``scan`` gives."""
    hit = F.aggregate("hits", F.lit(0).cast("bigint"), lambda total, x: total + (x["last"] - x["first"]).cast("bigint"))
    return found.withColumn("n_hit", hit).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * ONE_IN >= F.col("n_words")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, most: int = BLOCK_BYTES) -> DataFrame:
    """The documents that are not contaminated, with their columns."""
    return judged(_found(docs, benchmark, width, most)).where(~F.col("contaminated")).select("row.*")


def cut_spans(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, most: int = BLOCK_BYTES) -> DataFrame:
    """All documents, every run of hit words cut from their texts (the marks between its words too)."""
    found = _found(docs, benchmark, width, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column("text")):
                rows = batch.slice(part.first, part.n)
                start, end, bounds = part.tokens(ALNUM)
                texts: list[str | None] = []
                for i, hits in enumerate(rows.column("hits").to_pylist()):
                    if not hits:
                        texts.append(rows.column("text")[i].as_py())
                        continue
                    out, at = [], part.starts[i]
                    for x in hits:
                        out.append(part.data[at : start[bounds[i] + x["first"]]].tobytes())
                        at = end[bounds[i] + x["last"] - 1]
                    out.append(part.data[at : part.ends[i]].tobytes())
                    texts.append(b"".join(out).decode())
                yield pa.record_batch([rows.column("row"), pa.array(texts, pa.string())], names=["row", "text"])

    cut = found.mapInArrow(run, f"row {found.schema['row'].dataType.simpleString()}, text string")
    return cut.select(*(F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"]))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated",
    )


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bi AS (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM bi),
ln AS (SELECT DISTINCT n FROM bw),
di AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ln WHERE len(w) >= n),
hits AS (SELECT di.doc_id, bw.item_id, di.n, di.i FROM di JOIN bw ON bw.n = di.n AND bw.s = array_to_string(di.w[di.i:di.i + di.n - 1], ' ')),
pos AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS l FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
