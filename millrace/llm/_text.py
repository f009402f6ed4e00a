"""Vectorised text kernels shared by the llm operators.

Everything here works on one Arrow slice inside a Spark task: UTF-8 bytes in one
numpy buffer, a separator byte between documents, and polynomial prefix sums
modulo 2**64 from which the hash of any span is one subtraction and one product.
Null texts count as empty texts throughout.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text that a kernel handles at once; longer single texts are handled alone and whole.
SLICE_BYTES = 1 << 18


def random_u64(n: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 2**63, n, dtype=np.uint64) * U64(2) + U64(1)


def fold_case() -> np.ndarray:
    """Byte table that lower-cases A-Z and leaves every other byte."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


LOWER = fold_case()
#: Word bytes of the word rules: everything but space and 0x09-0x0D; and digits, letters and bytes from 0x80 up.
NON_SPACE = np.ones(256, dtype=bool)
NON_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_BYTE = random_u64(256, 11)
BYTE_EXACT = _BYTE
BYTE_FOLDED = _BYTE[LOWER]
_BASE, _BASE_WORD = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers_to(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, base, dtype=U64)
    up[0] = 1
    down = np.full(n, U64(pow(int(base), -1, 2**64)), dtype=U64)
    down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least; a process keeps those of one slice, longer texts make their own."""
    usual = SLICE_BYTES + (SLICE_BYTES >> 1)
    if n > usual:
        return _powers_to(base, n)
    if int(base) not in _powers:
        _powers[int(base)] = _powers_to(base, usual)
    return _powers[int(base)]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection that spreads every bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def prefix_sums(values: np.ndarray, base: np.uint64) -> np.ndarray:
    out = np.zeros(len(values) + 1, dtype=U64)
    np.cumsum(values * powers(base, len(values) + 1)[0][: len(values)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: np.uint64) -> np.ndarray:
    """Hash of each span [start, end) of the values behind ``sums``; spans of other lengths differ too."""
    raw = (sums[end] - sums[start]) * powers(base, len(sums))[1][start]
    return mix(raw + (end - start).astype(U64) * U64(0x2545F4914F6CDD1D))


class Slice:
    """Some documents of a batch: bytes with one space after each document, and where each one lies."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.first = first  # row in the batch of the first document
        self.n = len(offsets) - 1
        lengths = np.diff(offsets)
        self.data = np.insert(data[offsets[0] : offsets[-1]], offsets[1:] - offsets[0], 0x20)
        self.ends = np.cumsum(lengths + 1) - 1
        self.starts = self.ends - lengths
        self.lengths = lengths

    def raw(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()

    def tokens(self, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end byte of every maximal run of word bytes, and the first token of each document (n + 1 long)."""
        inside = np.zeros(len(self.data) + 1, dtype=np.int8)
        inside[1:] = is_word[self.data]
        inside[self.ends + 1] = 0
        edge = np.flatnonzero(np.diff(inside))
        start, end = edge[0::2], edge[1::2]
        return start, end, np.append(np.searchsorted(start, self.starts), len(start))


def slices(column: pa.Array | pa.ChunkedArray, most: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a string column into pieces of about ``most`` bytes at document boundaries; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, at, body = column.buffers()
    offsets = np.frombuffer(at, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None and body.size else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1)
        yield Slice(data, offsets[first : last + 1], first)
        first = last


def word_hashes(part: Slice, is_word: np.ndarray, table: np.ndarray = BYTE_FOLDED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every word of the slice; start, end and per-document bounds as ``Slice.tokens`` gives them."""
    start, end, bounds = part.tokens(is_word)
    return span_hash(prefix_sums(table[part.data], _BASE), start, end, _BASE), start, end, bounds


def byte_windows(part: Slice, width: int, table: np.ndarray = BYTE_EXACT) -> np.ndarray:
    """Hash of the ``width`` bytes from every position of the slice; windows may cross documents, callers mask them."""
    n = len(part.data) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    sums = prefix_sums(table[part.data], _BASE)
    return mix((sums[width:] - sums[:n]) * powers(_BASE, len(sums))[1][:n])


def gram_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive word hashes (over document boundaries too: callers mask those)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    sums = prefix_sums(words, _BASE_WORD)
    return mix((sums[width:] - sums[:n]) * powers(_BASE_WORD, len(sums))[1][:n] + U64(width))


def per_document(bounds: np.ndarray) -> np.ndarray:
    """Document number of every token."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def sums_by_document(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, dtype=np.float64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def code_points_before(part: Slice) -> np.ndarray:
    """Code points that start before each byte position (one more entry than bytes)."""
    out = np.zeros(len(part.data) + 1, dtype=np.int64)
    np.cumsum((part.data & 0xC0) != 0x80, out=out[1:])
    return out


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
