"""Quality classifier: hashed word n-grams, follow-the-regularised-leader, sparse dot products.

A text is cut into runs of word bytes (letters, digits, everything beyond ASCII) and runs of other marks; the
features are the hashed runs and pairs of neighbouring runs, modulo a power of two, each counting its share of the
text. The model is logistic regression trained by FTRL-proximal updates on a bounded sample of labelled rows; a
score is the sparse dot product of a text's features with the weights. labels, lang, source and ids are never
features.

Defined results: null and empty texts have no features and score the bias alone. Repeated rows give repeated
results. With no usable labelled row every text scores 0.5.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._jobs import discard, fold, labelled_sample, release, released, small_batches, table
from ._text import ALNUM, BYTE_EXACT, NON_SPACE, Slice, gram_hashes, slices, span_hash, prefix_sums, _BASE

#: Weights of the model: 2**BITS.
BITS = 20
#: Documented bound on the labelled rows that the model is fitted on.
TRAIN_ROWS = 12_000
#: predicted is 1 from this score on (the contract of op6).
THRESHOLD = 0.7
MARKS = NON_SPACE & ~ALNUM
MARKS[:0x20] = False


def features(part: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Hashed feature of every run and every pair of runs, and per-document bounds; feature 0 is no feature."""
    words, marks = part.tokens(ALNUM), part.tokens(MARKS)
    start = np.concatenate([words[0], marks[0]])
    end = np.concatenate([words[1], marks[1]])
    order = np.argsort(start, kind="stable")
    start, end = start[order], end[order]
    bounds = words[2] + marks[2]
    hashes = span_hash(prefix_sums(BYTE_EXACT[part.data], _BASE), start, end, _BASE)
    pairs = np.zeros(len(hashes), dtype=np.uint64)
    pairs[:-1] = gram_hashes(hashes, 2) if len(hashes) > 1 else 0
    out = np.empty(2 * len(hashes), dtype=np.int64)
    out[0::2] = (hashes >> np.uint64(64 - BITS)).astype(np.int64)
    out[1::2] = (pairs >> np.uint64(64 - BITS)).astype(np.int64)
    last = bounds[1:][np.diff(bounds) > 0] - 1
    out[2 * last + 1] = 0  # a pair never crosses documents
    return out, 2 * bounds


@dataclass
class QualityModel:
    weights: np.ndarray
    bias: float

    def scores(self, part: Slice) -> np.ndarray:
        index, bounds = features(part)
        total = np.zeros(len(index) + 1)
        np.cumsum(self.weights[index], out=total[1:])
        size = np.diff(bounds)
        margin = self.bias + (total[bounds[1:]] - total[bounds[:-1]]) / np.maximum(size, 1)
        return 1 / (1 + np.exp(-np.clip(margin, -35, 35)))


def ftrl(examples: list[tuple[np.ndarray, np.ndarray, int]], passes: int = 4, alpha: float = 20.0, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-5) -> QualityModel:
    """FTRL-proximal over sparse examples (feature numbers, values, label). The bias is feature 0, with value 1.

    Examples are few (see TRAIN_ROWS) and short in features, so this runs where the sample is.
    """
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    rate = lambda index: np.where(index == 0, 0.1, alpha)

    def weights(zi: np.ndarray, ni: np.ndarray, ai: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta * 0.01 + np.sqrt(ni)) / ai + l2))

    order = np.random.Generator(np.random.PCG64(7))
    for _ in range(passes if examples else 0):
        for k in order.permutation(len(examples)):
            index, value, label = examples[k]
            zi, ni, ai = z[index], n[index], rate(index)
            w = weights(zi, ni, ai)
            g = (1 / (1 + np.exp(-np.clip(w @ value, -35, 35))) - label) * value
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ai
            z[index] = zi + g - sigma * w
            n[index] = ni + g * g
    out, bias = np.empty(1 << BITS, dtype=np.float32), 0.0
    for at in range(0, 1 << BITS, 1 << 16):  # by parts: the driver holds no temporary arrays of the model's size
        part = slice(at, at + (1 << 16))
        w = weights(z[part], n[part], rate(np.arange(at, at + (1 << 16))))
        if at == 0:
            bias, w[0] = float(w[0]), 0
        out[part] = w
    return QualityModel(out, bias)


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features with their values (share of the text) of every labelled row."""
    for batch in batches:
        for part in slices(batch.column("text")):
            index, bounds = features(part)
            out_index, out_value = [], []
            for i in range(part.n):
                one, count = np.unique(index[bounds[i] : bounds[i + 1]], return_counts=True)
                keep = one > 0
                out_index.append(one[keep].astype(np.int32))
                out_value.append((count[keep] / max(bounds[i + 1] - bounds[i], 1)).astype(np.float32))
            yield pa.record_batch(
                [pa.array([x.tobytes() for x in out_index], pa.binary()), pa.array([x.tobytes() for x in out_value], pa.binary()), batch.column("label").slice(part.first, part.n).cast(pa.int32())],
                names=["i", "v", "label"],
            )


def _compare(a: tuple[np.ndarray, np.ndarray, int], b: tuple[np.ndarray, np.ndarray, int]) -> int:
    """Order of examples by length, label, then the bytes of their features; no keys are kept for all of them."""
    x, y = (len(a[0]), a[2]), (len(b[0]), b[2])
    if x == y:
        x, y = a[0].tobytes(), b[0].tobytes()
    return (x > y) - (x < y)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 4, held_out: int = 2, rows: int = TRAIN_ROWS) -> QualityModel:
    """Fit on at most ``rows`` labelled rows outside the held-out fold (a bounded sample; see the README)."""
    sample = labelled_sample(docs, labels, label, modulus, held_out, rows)
    examples = []
    for row in small_batches(sample).mapInArrow(released(_sparse), "i binary, v binary, label int").toLocalIterator():
        index = np.frombuffer(row["i"], dtype=np.int32)
        value = np.frombuffer(row["v"], dtype=np.float32)
        examples.append((np.append(np.int32(0), index), np.append(np.float32(1), value), row["label"]))
    examples.sort(key=functools.cmp_to_key(_compare))  # the same order on every run
    model = ftrl(examples)
    examples.clear()
    discard(sample)
    release()
    return model


def score(docs: DataFrame, model: QualityModel, keep: str = "doc_id") -> DataFrame:
    """(doc_id, score) of every row of ``docs``, in one scan."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = QualityModel(*shared.value)
        for batch in batches:
            found = [own.scores(part) for part in slices(batch.column("text"))]
            yield pa.record_batch([batch.column(keep), pa.array(np.concatenate(found) if found else np.zeros(0))], names=[keep, "score"])

    return small_batches(docs).select(keep, "text").mapInArrow(released(run), f"{keep} bigint, score double")


def filter_documents(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = QualityModel(*shared.value)
        for batch in batches:
            for part in slices(batch.column("text")):
                yield batch.slice(part.first, part.n).filter(pa.array(own.scores(part) >= threshold))

    return small_batches(docs).mapInArrow(released(run), docs.schema)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select(
        "doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
