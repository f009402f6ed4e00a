"""SentencePiece encoding and decoding by shared-prefix Viterbi.

A text is marked (every space becomes the word mark, one more stands before the text) and cut into marked words: a run
of marks and what follows up to the next mark; no piece of the vocabulary crosses that border. The distinct marked
words of a batch are sorted, which lays their trie out in depth-first order: a word keeps the forward scores of the
prefix it shares with the word before it, with the pieces that may still go on there, and only the rest is searched
anew. The best segmentation maximises the sum of the pieces' scores; a character that is no piece costs more than any
normal piece and is written as bytes.

The scores are the model file's own. In a file made by byte-pair merging they are merge ranks and no log
probabilities: the best sum is then well defined, decodes to the same text, but is not what replaying the merges gives
(and has more ids, about 15 % on prose).

Decoding gives the text back exactly: marks within a text are written as bytes and so stay marks, and a space that no
piece covers is written as its byte. Bytes that are no UTF-8, which only foreign ids give, decode to U+FFFD.

Defined results: null texts have null ids and decode to null; empty texts have no ids and decode to empty texts.
Ties go to the segmentation whose last piece is longest, then so on backwards. Texts of any length are encoded whole.
Other columns stay; one of the new column's name is replaced.
"""

from __future__ import annotations

import hashlib
import math
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._jobs import released, small_batches, table
from ._text import _BASE, BYTE_EXACT, prefix_sums, slices, span_hash

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: The word mark, and how much worse than the worst piece an uncovered character scores.
MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Encoded words that a Python worker remembers, and ids that are decoded in one piece.
KNOWN_WORDS, DECODED = 60_000, 200_000

#: Stands for a mark inside a text while words are searched; UTF-8 text cannot hold it and no vocabulary has it.
_INNER = "\ud800"
#: Bytes of text whose words are sorted together.
SLICE = 1 << 20
_BYTES = re.compile(r"<0x([0-9A-F]{2})>$")


class Pieces:
    """Vocabulary of one model file: a trie of its pieces with their scores, byte pieces, and a search that shares prefixes."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.score: dict[str, tuple[float, int]] = {}
        self.byte = [0] * 256
        bytes_of: list[bytes] = []
        worst = 0.0
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if m := _BYTES.match(piece):
                self.byte[int(m[1], 16)] = i
                bytes_of.append(bytes([int(m[1], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                bytes_of.append(b"")
            else:
                score = model.get_score(i)
                if score > -1e8:
                    worst = min(worst, score)
                self.score[piece] = (score, i)
                bytes_of.append(piece.replace(MARK, " ").encode())
        self.unknown = worst - UNKNOWN_PENALTY
        #: A node maps characters to nodes, and "" to the (score, id) of the piece that ends there.
        self.trie: dict = {}
        for piece, hit in self.score.items():
            node = self.trie
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = hit
        self.single = {p: hit for p, hit in self.score.items() if len(p) == 1}
        self.pool = np.frombuffer(b"".join(bytes_of), dtype=np.uint8)
        self.size = np.array([len(x) for x in bytes_of], dtype=np.int64)
        self.offset = np.append(0, np.cumsum(self.size))[:-1]
        self.known: dict[bytes, bytes] = {}

    def encode_sorted(self, words: list[str]) -> list[list[int]]:
        """Ids of each marked word; ``words`` are sorted, so that neighbours share forward scores.

        steps[e] has, after e characters, the score of their best segmentation, where its last piece starts and its number
        (-1: a character written as bytes), and the starts from which a piece may still go on, with their nodes and scores.
        """
        out, before = [], ""
        root, single, unknown, inf = self.trie, self.single, self.unknown, math.inf
        steps: list[tuple[float, int, int, list]] = [(0.0, 0, -1, [])]
        for word in words:
            shared = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                shared += 1
            del steps[shared + 1 :]
            score, _, _, open_ = steps[-1]
            e = shared
            for c in word[shared:] if shared else word:
                on = []
                node = root.get(c)
                hit = single.get(c)
                if hit is not None:
                    top, at, found = score + hit[0], e, hit[1]
                else:
                    top, at, found = score + unknown, e, -1
                for before_e in reversed(open_):  # from the latest start to the earliest, so that of equal sums the longest piece stays
                    if (further := before_e[1].get(c)) is not None:
                        on.append((before_e[0], further, before_e[2]))
                        if (hit := further.get("")) is not None and (total := before_e[2] + hit[0]) >= top:
                            top, at, found = total, before_e[0], hit[1]
                on.reverse()
                if node is not None:
                    on.append((e, node, score))
                e += 1
                score, open_ = top, on
                steps.append((top, at, found, on))
            ids, end = [], len(word)
            while end:
                _, at, found, _ = steps[end]
                if found < 0:
                    ids.extend(self.byte[b] for b in reversed({_INNER: MARK, MARK: " "}.get(word[at], word[at]).encode()))
                else:
                    ids.append(found)
                end = at
            ids.reverse()
            out.append(ids)
            before = word
        return out

    def ids(self, words: list[bytes]) -> list[bytes]:
        """Ids (int32, as bytes) of distinct words, in the order given; a text's first word comes behind the byte 0xFF."""
        known = self.known
        new = [w for w in words if w not in known]
        if new:
            if len(known) + len(new) > KNOWN_WORDS:
                known = {w: known[w] for w in words if w in known}
            marked = sorted(((MARK + w[1:].decode().replace(MARK, _INNER).replace(" ", MARK)) if w[0] == 0xFF else w.decode().replace(MARK, _INNER).replace(" ", MARK), w) for w in new)
            for (_, w), ids in zip(marked, self.encode_sorted([m for m, _ in marked]), strict=True):
                known[w] = array("i", ids).tobytes()
            self.known = known if len(known) <= KNOWN_WORDS else {}
        return [known[w] for w in words]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> Iterator[bytes]:
        """The bytes behind each list of ids; ``bounds`` tells where each begins (n + 1 long)."""
        first = 0
        while first + 1 < len(bounds):
            last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + DECODED, side="right")) - 1)
            own = ids[bounds[first] : bounds[last]]
            size = self.size[own]
            end = np.cumsum(size)
            at = np.repeat(self.offset[own] - end + size, size)
            at += np.arange(len(at))
            data = self.pool[at].tobytes()
            end = np.append(0, end)[bounds[first : last + 1] - bounds[first]].tolist()
            for a, b in zip(end[:-1], end[1:], strict=True):
                yield data[a + 1 : b] if b > a and data[a] == 0x20 else data[a:b]
            first = last


@lru_cache(2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def encode_column(column: pa.Array, vocabulary: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a string column, and where each row's begin (n + 1 long); nulls have none."""
    parts, bounds, base = [], [np.zeros(1, dtype=np.int64)], 0
    for part in slices(column, SLICE):
        # a word begins at each space that follows no space, and at each text's first byte
        data = part.data
        space = data == 0x20
        space[part.ends] = False
        opens = np.zeros(len(data), dtype=bool)
        opens[1:] = space[1:] & ~space[:-1]
        lead = part.starts[part.lengths > 0]
        opens[lead] = True
        start = np.flatnonzero(opens)
        nxt = np.append(start[1:], len(data))
        doc = np.searchsorted(part.ends, start, side="right")
        end = np.minimum(nxt, part.ends[doc])
        first = np.zeros(len(data) + 1, dtype=bool)
        first[lead] = True
        first = first[start]
        hashes = span_hash(prefix_sums(BYTE_EXACT[data], _BASE), start, end, _BASE) ^ np.where(first, np.uint64(0x5851F42D4C957F2D), np.uint64(0))
        _, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        raw = data.tobytes()
        words = [b"\xff" + raw[a:b] if f else raw[a:b] for a, b, f in zip(start[at].tolist(), end[at].tolist(), first[at].tolist(), strict=True)]
        ids = vocabulary.ids(words)
        size = np.array([len(x) >> 2 for x in ids], dtype=np.int64)
        offset = np.append(0, np.cumsum(size))
        pool = np.frombuffer(b"".join(ids), dtype=np.int32)
        count = size[inverse]
        total = np.append(0, np.cumsum(count))
        source = np.repeat(offset[inverse] - total[:-1], count)
        source += np.arange(total[-1])
        parts.append(pool[source])
        per = np.append(np.searchsorted(start, part.starts), len(start))
        bounds.append(base + total[per[1:]])
        base += total[-1]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32), np.concatenate(bounds)


def _null_mask(column: pa.Array) -> np.ndarray | None:
    return column.is_null().to_numpy(zero_copy_only=False) if column.null_count else None


def _fields(rows: DataFrame, to: str, kind: str) -> tuple[list[str], str]:
    """Columns that stay beside the new one, and the schema of both."""
    stay = [f for f in rows.schema if f.name.lower() != to.lower()]
    return [f.name for f in stay], ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in stay), f"`{to}` {kind}"])


def encode(docs: DataFrame, column: str = "text", to: str = "ids", vocabulary: str = MODEL) -> DataFrame:
    """``docs`` with one more column ``to``: the ids of ``column``. One scan, no shuffle."""
    stay, schema = _fields(docs, to, "array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(vocabulary)
        for batch in batches:
            texts = batch.column(column)
            ids, bounds = encode_column(texts, own)
            nulls = _null_mask(texts)
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()), mask=None if nulls is None else pa.array(nulls))
            yield pa.record_batch([*(batch.column(c) for c in stay), lists], names=[*stay, to])

    return small_batches(docs).mapInArrow(released(run), schema)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of an array column and where each row's begin; null rows have none."""
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
    return column.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(size))


def decode(rows: DataFrame, column: str = "ids", to: str = "decoded", vocabulary: str = MODEL) -> DataFrame:
    """``rows`` with one more column ``to``: the text behind the ids of ``column``."""
    stay, schema = _fields(rows, to, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(vocabulary)
        for batch in batches:
            lists = batch.column(column)
            texts = [x.decode("utf-8", "replace") for x in own.decode(*_lists(lists))]
            yield pa.record_batch([*(batch.column(c) for c in stay), pc.if_else(lists.is_null(), None, pa.array(texts, pa.string()))], names=[*stay, to])

    return small_batches(rows).mapInArrow(released(run), schema)


RESULT = "doc_id bigint, n_tokens bigint, n_bytes_tokens bigint, ids_sha256 string, text_sha256 string, decoded_sha256 string"


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: number of ids, of byte ids among them, digests of the ids (little-endian int32), of the text and of what the ids decode to."""
    names = [x.split()[0] for x in RESULT.split(", ")]
    types = [pa.string() if n.endswith("sha256") else pa.int64() for n in names]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(MODEL)
        low, high = min(own.byte), max(own.byte)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            ids, bounds = _lists(batch.column("ids"))
            in_bytes = np.append(0, np.cumsum((ids >= low) & (ids <= high)))[bounds]
            raw, at = ids.astype("<i4").tobytes(), (4 * bounds).tolist()
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            out = [
                batch.column("doc_id"), np.diff(bounds), np.diff(in_bytes), [sha(raw[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)],
                [sha(t) for t in texts], [sha(t) for t in own.decode(ids, bounds)],
            ]
            yield pa.record_batch([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(out, types, strict=True)], names=names)

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint"), "text")
    return encode(docs).mapInArrow(released(digest), RESULT)
