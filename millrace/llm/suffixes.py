"""Suffix-array dedup: remove every byte that a repeated string of ``WIDTH`` bytes covers.

1. Every window of WIDTH bytes names the smallest hash among its 64-byte strings, so equal windows name the same one
   at the same place; a run of windows that name one place is a snippet. Blocks count snippets and named strings over all documents.
2. Equal snippets are one: all windows of a snippet that comes twice repeat. Where different snippets name the same
   string, they meet in a group; the rest of the corpus holds no repeated window.
3. The snippets of some groups are cut into phrases at places that their bytes decide, the phrases' suffix array is
   built by linear grouping (``suffix_array``), and the common prefixes of its neighbours are measured. A window is whole
   phrases, with less than a phrase before them and behind. Windows with the same bytes before and behind, in the array's
   order, repeat exactly where the common prefix with a neighbour covers the phrases. (Windows without any border, in
   monotonous text, are compared whole.)
4. A group of more than ``HOT`` snippets is split by more of the bytes around the named string: half of what its windows
   do not share yet, to the right where a window has them there and else to the left. So each window goes to one smaller
   group, with all windows equal to it; after eight rounds at most the windows of a group are equal. Pieces with the same bytes
   become one, as equal snippets do in step 2: their windows repeat.

The suffix array: suffixes are grouped by their first symbol; groups are taken in descending order, and the members' nearest
places before them that are in lower groups (previous-smaller pointers) rise within their own group by how many members point to
them. When all groups are taken, each holds the suffixes of one Lyndon prefix. A pass in ascending order then puts
every suffix behind those of its group that it follows, since what follows its Lyndon prefix is already in place.

Defined results: null and empty texts have no bytes. Matches never cross documents; overlapping matches and matches
in one document count; windows are judged on the input. Repeated rows repeat each other. Named strings, and whole
snippets, are told by 63-bit hashes.
"""

from __future__ import annotations

import functools
import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._blocks import blocks, counted, distinct, opened, totals
from ._jobs import released, released_tables, table, written
from ._text import _BASE, BYTE_EXACT, Slice, byte_windows, mix, prefix_sums, slices, span_hash

WIDTH, GRAM = 200, 64
#: Different snippets of one group (of 336 bytes at most each); larger groups are split by more bytes.
HOT = 500
#: Bytes of snippets in one suffix array.
TOGETHER = 1 << 18
_TOP = np.uint64(1 << 63)
_SALT = np.uint64(0xD1B54A32D192ED03)
PHRASE_CONTEXT = 4


def suffix_array(s: list[int]) -> list[int]:
    """Suffix array of ``s`` by linear grouping of Lyndon prefixes; symbols are any whole numbers."""
    n = len(s)
    members: list[list[int]] = []
    number = {}
    for c in sorted(set(s)):
        number[c] = len(members)
        members.append([])
    of = [number[c] for c in s]
    for i, g in enumerate(of):
        members[g].append(i)
    lower = list(range(-1, len(members) - 1))  # the next lower group of each
    higher = list(range(1, len(members) + 1))
    if members:
        higher[-1] = -1
    taken = bytearray(n)
    before = list(range(-1, n - 1))  # nearest place before that is not taken, as far as known
    g = len(members) - 1
    while g >= 0:
        own = [i for i in members[g] if of[i] == g]
        members[g] = own
        for i in own:
            taken[i] = 1
        times: dict[int, int] = {}
        for i in own:
            p = before[i]
            while p >= 0 and taken[p]:
                p = before[p]
            q = before[i]
            before[i] = p
            while q > p:  # shorten the way for later
                further = before[q]
                before[q] = p
                q = further
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        split: dict[int, dict[int, list[int]]] = {}
        for p, k in times.items():
            split.setdefault(of[p], {}).setdefault(k, []).append(p)
        for old, by_times in split.items():
            at = old
            for k in sorted(by_times):
                new = len(members)
                members.append(by_times[k])
                for p in by_times[k]:
                    of[p] = new
                up = higher[at]
                lower.append(at)
                higher.append(up)
                higher[at] = new
                if up >= 0:
                    lower[up] = new
                at = new
        g = lower[g]
    # place of every group's first suffix, in ascending order of groups
    first = 0
    while first < len(members) and lower[first] >= 0:
        first = lower[first]
    slot, rank, place, g, k = [0] * len(members), [0] * len(members), 0, (first if members else -1), 0
    while g >= 0:
        slot[g], rank[g] = place, k
        place, k = place + sum(of[i] == g for i in members[g]), k + 1
        g = higher[g]
    # what follows a Lyndon prefix is the next suffix that is smaller: the next place of no higher group
    after: list[list[int] | None] = [None] * (n + 1)
    stack: list[int] = []
    for i in range(n - 1, -1, -1):
        own_rank = rank[of[i]]
        while stack and rank[of[stack[-1]]] > own_rank:
            stack.pop()
        j = stack[-1] if stack else n
        if after[j] is None:
            after[j] = [i]
        else:
            after[j].append(i)
        stack.append(i)
    order = [0] * n
    # suffixes that are Lyndon words themselves come first in their groups
    for i in after[n] or ():
        order[slot[of[i]]] = i
        slot[of[i]] += 1
    for r in range(n):
        for i in after[order[r]] or ():
            order[slot[of[i]]] = i
            slot[of[i]] += 1
    return order


def snippets(part: Slice) -> tuple[np.ndarray, ...]:
    """Runs of windows that name one string: first window, how many, the named place; its hash, and the hash of all their bytes and where the place lies in them."""
    n = len(part.data)
    span = WIDTH - GRAM + 1
    empty = tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    if n < WIDTH:
        return empty
    grams = byte_windows(part, GRAM)
    packed = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    size = -(-len(packed) // span) * span
    grid = np.full(size, np.uint64(0xFFFFFFFFFFFFFFFF))
    grid[: len(packed)] = packed
    grid = grid.reshape(-1, span)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - WIDTH + 1
    named = (np.minimum(right[:windows], left[span - 1 : span - 1 + windows]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    start = np.arange(windows)
    doc = np.minimum(np.searchsorted(part.ends, start, side="left"), part.n - 1)
    start = start[start + WIDTH <= part.ends[doc]]
    if not len(start):
        return empty
    named = named[start]
    change = np.flatnonzero((np.diff(named) != 0) | (np.diff(start) != 1)) + 1
    first, last = start[np.append(0, change)], start[np.append(change - 1, len(start) - 1)]
    place = named[np.append(0, change)]
    whole = span_hash(prefix_sums(BYTE_EXACT[part.data], _BASE), first, last + WIDTH, _BASE)
    return first, last - first + 1, place, mix(grams[place]) | _TOP, mix(whole + (place - first).astype(np.uint64) * _SALT) & ~_TOP


def _keys(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    found = [np.concatenate(snippets(part)[3:]) for part in slices(rows["text"])]
    return np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *found]), return_counts=True)


def covered(n: int, windows: np.ndarray) -> np.ndarray:
    """Which of n bytes the windows that begin at these places cover."""
    change = np.zeros(n + 1, dtype=np.int32)
    np.add.at(change, windows, 1)
    np.add.at(change, windows + WIDTH, -1)
    return np.cumsum(change)[:n] > 0


def _verdict(data: np.ndarray, windows: np.ndarray) -> tuple[int, int, int, str]:
    gone = covered(len(data), windows)
    runs = int(np.count_nonzero(np.diff(np.concatenate([[False], gone]).astype(np.int8)) == 1))
    return len(data), int(gone.sum()), runs, hashlib.sha256(data[~gone].tobytes()).hexdigest()


def _windows(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """All windows of runs that begin at ``first``."""
    return np.repeat(first - np.append(0, np.cumsum(many)[:-1]), many) + np.arange(many.sum())


VERDICT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
JUDGED = f"kind int, blk int, row bigint, h bigint, c bigint, o int, body binary, runs binary, {VERDICT}"
_TYPES = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "string": pa.string()}
_JUDGED = pa.schema([(x.split()[0], _TYPES[x.split()[1]]) for x in JUDGED.split(", ")])


def _made(kind: int, rows: list[tuple], *names: str) -> pa.Table:
    """Rows of JUDGED with these columns; the others are null."""
    columns = dict(zip(names, zip(*rows, strict=True), strict=True)) if rows else {}
    n = len(rows)
    return pa.table([pa.array([kind] * n, pa.int32()) if f.name == "kind" else pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _JUDGED], schema=_JUDGED)


def _judge(rows: pa.Table, back: pa.Table) -> pa.Table:
    """Of one block. Kind 0: documents that need nothing more; 1: documents with open snippets; 2: snippets of groups."""
    blk, rows = rows["blk"][0].as_py(), opened(rows)
    parts = [(part, snippets(part)) for part in slices(rows["text"])]
    key = distinct(np.concatenate([np.zeros(0, dtype=np.uint64), *(np.concatenate(x[3:]) for _, x in parts)]))
    total, owned = totals(back)
    done, waiting, sent = [], [], {}
    ids = rows["doc_id"].to_pylist()
    for part, (first, many, place, h, c) in parts:
        at_c = np.searchsorted(key, c)
        n_h, n_c, mine = total[np.searchsorted(key, h)], total[at_c], owned[at_c]
        doc = np.searchsorted(part.ends, first, side="right")
        cut = np.searchsorted(doc, np.arange(part.n + 1))
        grouped = np.flatnonzero(n_h > n_c)
        for k in grouped.tolist():
            if mine[k] and int(c[k]) not in sent:  # one of equal snippets stands for all
                row = part.first + int(doc[k]) if n_c[k] == 1 else None
                sent[int(c[k])] = (blk, row, int(h[k].view(np.int64)), int(c[k].view(np.int64)), int(place[k] - first[k]), part.data[first[k] : first[k] + many[k] - 1 + WIDTH].tobytes())
        for i in range(part.n):
            own = slice(cut[i], cut[i + 1])
            begin = first[own] - part.starts[i]
            sure = n_c[own] > 1
            open_ = ~sure & (n_h[own] > n_c[own])
            row = part.first + i
            if open_.any():
                runs = np.stack([begin, many[own], np.where(sure, -1, c[own].view(np.int64))], axis=1)[sure | open_]
                waiting.append((blk, row, ids[row], part.raw(i), runs.astype(np.int64).tobytes()))
            else:
                data = part.data[part.starts[i] : part.ends[i]]
                done.append((ids[row], *_verdict(data, _windows(begin[sure], many[own][sure]))))
    names = [x.split()[0] for x in VERDICT.split(", ")]
    return pa.concat_tables([_made(0, done, *names), _made(1, waiting, "blk", "row", "doc_id", "body", "runs"), _made(2, list(sent.values()), "blk", "row", "h", "c", "o", "body")])


def _least(values: np.ndarray) -> list[np.ndarray]:
    """Minima of all stretches whose length is a power of two."""
    out, step = [values], 1
    while 2 * step <= len(values):
        out.append(np.minimum(out[-1][:-step], out[-1][step:]))
        step *= 2
    return out


def repeated(bodies: list[bytes]) -> list[np.ndarray]:
    """For each snippet, which of its windows stand in another place of these snippets."""
    part = next(slices(pa.array(bodies, pa.large_binary()).view(pa.large_string()), most=1 << 62))
    data, starts, ends = part.data, part.starts, part.ends
    sums = prefix_sums(BYTE_EXACT[data], _BASE)
    # phrases: borders where a hash of the four bytes before says so
    word = np.zeros(len(data) + 1, dtype=np.uint32)
    for k in range(PHRASE_CONTEXT):
        word[PHRASE_CONTEXT:] |= data[k : len(data) - PHRASE_CONTEXT + 1 + k].astype(np.uint32) << np.uint32(8 * k)
    border = np.flatnonzero((word * np.uint32(0x9E3779B1)) >> np.uint32(28) == 0)
    owner = np.minimum(np.searchsorted(ends, border, side="left"), part.n - 1)
    inside = (border - PHRASE_CONTEXT >= starts[owner]) & (border <= ends[owner])
    border, owner = border[inside], owner[inside]
    many = ends - starts - WIDTH + 1
    window = _windows(starts, many)
    out = np.zeros(len(window), dtype=bool)
    first = np.searchsorted(border, window + PHRASE_CONTEXT)
    some = np.flatnonzero((border[np.minimum(first, len(border) - 1)] <= window + WIDTH) & (first < len(border))) if len(border) else np.zeros(0, dtype=np.int64)
    if len(some):
        last = np.append(owner[1:] != owner[:-1], True)
        phrase = np.flatnonzero(~last)
        _, symbol = np.unique(span_hash(sums, border[phrase], border[np.minimum(phrase + 1, len(border) - 1)], _BASE), return_inverse=True)
        s = np.zeros(len(border), dtype=np.int64)
        s[phrase] = symbol + len(border)
        s[last] = np.arange(np.count_nonzero(last))  # each snippet ends in a symbol of its own, below all phrases
        order = np.array(suffix_array(s.tolist()), dtype=np.int64)
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        one, two = order[:-1], order[1:]
        same, length = np.arange(len(one)), np.zeros(len(one), dtype=np.int64)
        while len(same):
            same = same[s[one[same] + length[same]] == s[two[same] + length[same]]]
            length[same] += 1
        common = _least(border[one + length] - border[one])
        # windows with the same bytes before their first border and behind their last one, in the order of the array
        final = np.searchsorted(border, window[some] + WIDTH, side="right") - 1
        at, end = border[first[some]], border[final]
        around = mix(span_hash(sums, window[some], at, _BASE) ^ mix(span_hash(sums, end, window[some] + WIDTH, _BASE) + _SALT))
        place = rank[first[some]]
        by = np.lexsort((place, around))
        pair = np.flatnonzero(around[by][1:] == around[by][:-1])
        a, b = place[by][pair], place[by][pair + 1]
        level = np.frexp((b - a).astype(np.float64))[1] - 1
        reach = np.zeros(len(pair), dtype=np.int64)
        for k in np.unique(level):
            own = level == k
            reach[own] = np.minimum(common[k][a[own]], common[k][b[own] - (1 << k)])
        hit = by[pair], by[pair + 1]
        good = reach >= (end - at)[hit[0]]
        out[some[hit[0][good]]] = out[some[hit[1][good]]] = True
    rest = np.setdiff1d(np.arange(len(window)), some, assume_unique=True)
    if len(rest):
        _, back, times = np.unique(span_hash(sums, window[rest], window[rest] + WIDTH, _BASE), return_inverse=True, return_counts=True)
        out[rest] = times[back] > 1
    return np.split(out, np.cumsum(many)[:-1])


#: A snippet, or some of its windows: they begin at ``first`` in it, the named string at o in body, and all windows of the
#: group share the bytes from ``a`` to ``b`` counted from there.
SENT = "blk int, row bigint, h bigint, c bigint, o int, body binary, first int, a int, b int"
_SENT = pa.schema([(x.split()[0], _TYPES[x.split()[1]]) for x in SENT.split(", ")])
FOUND = "blk int, row bigint, c bigint, first int, bits binary"


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Open snippets with the windows that repeat; rows come sorted by h, and groups are taken together up to TOGETHER bytes."""
    held: list[tuple] = []
    size, last = 0, None

    def flush() -> pa.RecordBatch:
        blk, row, _, c, body, first = zip(*held, strict=True)
        bits = repeated(list(body))
        open_ = [k for k, r in enumerate(row) if r is not None and bits[k].any()]
        return pa.record_batch(
            [pa.array([blk[k] for k in open_], pa.int32()), pa.array([row[k] for k in open_], pa.int64()), pa.array([c[k] for k in open_], pa.int64()),
             pa.array([first[k] for k in open_], pa.int32()), pa.array([np.packbits(bits[k]).tobytes() for k in open_], pa.binary())],
            names=["blk", "row", "c", "first", "bits"],
        )

    for batch in batches:
        for r in zip(*(batch.column(k).to_pylist() for k in ("blk", "row", "h", "c", "body", "first")), strict=True):
            if size > TOGETHER and r[2] != last:
                yield flush()
                held, size = [], 0
            held.append(r)
            size, last = size + len(r[4]), r[2]
    if held:
        yield flush()


def _narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each snippet's windows in groups that share half of the bytes that they did not share yet."""
    for batch in batches:
        out = []
        for blk, row, h, c, o, body, first, a, b in zip(*(batch.column(k).to_pylist() for k in _SENT.names), strict=True):
            many, right = len(body) - WIDTH + 1, -(-(WIDTH - b + a) // 2)
            left = WIDTH - b + a - right + 1
            cut = min(max(o + b + right - WIDTH, 0), many)  # windows from here on have so many bytes on the right
            for w0, w1, x, y in ((cut, many, a, b + right), (0, cut, a - left, b)):
                if w1 > w0:
                    digest = hashlib.blake2b(body[o + x : o + y], digest_size=8, key=(h & 0xFFFFFFFFFFFFFFFF).to_bytes(8, "little") + (x & 0xFFFF).to_bytes(2, "little")).digest()
                    out.append((blk, row, int.from_bytes(digest, "little", signed=True), c, o - w0, body[w0 : w1 - 1 + WIDTH], first + w0, x, y))
        if out:
            yield pa.record_batch([pa.array(list(v), f.type) for v, f in zip(zip(*out, strict=True), _SENT, strict=True)], schema=_SENT)


def _finish(waiting: pa.Table, found: pa.Table) -> pa.Table:
    bits: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = defaultdict(list)
    for row, c, first, b in zip(*(found[k].to_pylist() for k in ("row", "c", "first", "bits")), strict=True):
        bits[row, c].append((first, np.flatnonzero(np.unpackbits(np.frombuffer(b, dtype=np.uint8)))))
    out = []
    for row, doc_id, body, raw in zip(*(waiting[k].to_pylist() for k in ("row", "doc_id", "body", "runs")), strict=True):
        windows = [np.zeros(0, dtype=np.int64)]
        for begin, many, c in np.frombuffer(raw, dtype=np.int64).reshape(-1, 3).tolist():
            if c == -1:
                windows.append(begin + np.arange(many))
            windows += [begin + first + at for first, at in bits.get((row, c), ())]
        out.append((doc_id, *_verdict(np.frombuffer(body, dtype=np.uint8), np.concatenate(windows))))
    names = [x.split()[0] for x in VERDICT.split(", ")]
    return _made(0, out, *names).select(names)


def _all_bits(n: Column) -> Column:
    """``n`` ones as packed bits."""
    last = F.element_at(F.array(*(F.lit(f"{0xFF00 >> k & 0xFF:02X}" if k else "") for k in range(8))), (n % 8 + 1).cast("int"))
    return F.unhex(F.concat(F.repeat(F.lit("FF"), F.floor(n / 8).cast("int")), last))


def merged(sent: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of SENT, of rows with the same bytes one that needs no answer; and the answers of those rows, all of whose windows repeat. Bytes are compared, not hashes."""
    key = ["h", "o", "body"]
    alone = F.col("__n") == 1
    rest = [c for c in _SENT.names if c not in key]
    classes = written(sent.groupBy(*key).agg(F.count("*").alias("__n"), F.first(F.struct(*rest)).alias("x")))
    several = classes.where(~alone).select(*key)
    answers = sent.where("row is not null").join(several, key, "left_semi").select("blk", "row", "c", "first", _all_bits(F.octet_length("body") - (WIDTH - 1)).alias("bits"))
    one = classes.select(*key, F.col("x.blk").alias("blk"), F.when(alone, F.col("x.row")).alias("row"), *(F.col("x")[c].alias(c) for c in rest if c not in ("blk", "row")))
    return one.select(*_SENT.names), answers


def groups(sent: DataFrame, hot: int) -> tuple[DataFrame, list[DataFrame]]:
    """Snippets in groups of at most ``hot``, as rows of SENT; and the answers of pieces of larger groups that came more than once.

    Windows of one row begin at different distances from the named string, so they differ: a row that is alone in its group repeats nothing and goes.
    What is the same in many snippets is one row from the round on that cuts it free, so rounds make at most a few rows for each snippet.
    """
    parts, equal = [], []
    while True:
        sizes = written(sent.groupBy("h").count().where("count > 1"))
        large = sizes.where(F.col("count") > hot)
        parts.append(sent.join(sizes.where(F.col("count") <= hot), "h", "left_semi"))
        if large.isEmpty():
            return functools.reduce(DataFrame.unionByName, parts), equal
        rest = sent.join(large, "h", "left_semi")
        parts.append(rest.where(F.col("b") - F.col("a") >= WIDTH))  # different windows with one hash
        sent, answers = merged(written(rest.where(F.col("b") - F.col("a") < WIDTH).select(*_SENT.names).mapInArrow(released(_narrowed), SENT)))
        equal.append(answers)


def dedup(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row of ``docs`` (doc_id, text)."""
    rows, n = blocks(docs)
    back = counted(rows, n, _keys)
    judged = written(rows.groupBy("blk").cogroup(back.groupBy("blk")).applyInArrow(released_tables(_judge), JUDGED))
    sent = judged.where("kind = 2").select("blk", "row", "h", "c", "o", "body", F.lit(0).alias("first"), F.lit(0).alias("a"), F.lit(GRAM).alias("b"))
    grouped, equal = groups(sent, hot)
    found = grouped.repartition("h").sortWithinPartitions("h").mapInArrow(released(_grouped), FOUND)
    found = functools.reduce(DataFrame.unionByName, [found, *equal])
    last = judged.where("kind = 1").select("blk", "row", "doc_id", "body", "runs").groupBy("blk").cogroup(found.groupBy("blk")).applyInArrow(released_tables(_finish), VERDICT)
    names = [x.split()[0] for x in VERDICT.split(", ")]
    return judged.where("kind = 0").select(*names).unionByName(last)


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))
