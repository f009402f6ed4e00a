"""Language model scores: Katz back-off n-grams with Good-Turing discounts, counted over all training documents.

For every order the counts of all n-grams are summed in ranges of the key space (``_blocks``) and written: the n-gram
tables, in one partition for each range. Each block of documents gets back the counts of what it holds. From order 3 on
a block does not send what it knows: an n-gram with an unseen part has count 0, and one with a part that stands once in
the training texts and in no other text has count 1 (it is tallied, but in no table, as nothing can ask for it). An n-gram seen
r times after history h has the probability d(r) r / (c(h) + SPARE). Any other word takes its probability after the
shorter history times a(h), recursively down to single words; a(h) is the weight that makes the probabilities after h
sum to one exactly: a(h) = left(h) / (1 - sum over the words seen after h of their probability after the shorter
history), where left(h) = (SPARE + what the discounts take) / (c(h) + SPARE) is summed as such, never as a difference
from one. Weights are made for the histories that a text without all its n-grams in the tables asks for, from the
whole tables; they are written too. A word seen r times has d(r) r / (N + SPARE), and all unknown words together have
what is left.

Good-Turing discounts apply up to five occurrences, for each order from its own counts of counts; where those give none
between 0 and 1, absolute discounting with D = N1 / (N1 + 2 N2) takes their place. SPARE keeps some mass back for every
history, also where all its n-grams are too frequent to be discounted. A text's first word comes after the end mark,
which closes every text; histories do not reach beyond it. N-grams are told by 56-bit hashes.

Defined results: null and empty texts are the end mark alone. Rows without doc_id are training rows. Repeated rows
count as often as they come. Without training rows every text scores 0. Texts of any length are scored whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._blocks import answered, blocks, cut_up, cuts, met, opened, packed, planes, range_count, summed, unplanes
from ._jobs import discard, fold, released_table, released_tables, table, written
from ._text import NON_SPACE, mix, slices, word_hashes

ORDER = 3
DISCOUNTED = 5
SPARE = 0.5
END = np.uint64(0xEA09E667F3BCC900)
#: The lowest byte of a key stays empty, which keeps what is shuffled small.
_KEY = np.uint64(0xFFFFFFFFFFFFFF00)
_NEXT = np.uint64(0x9FB21C651E98DF25)


def _tokens(part: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Word keys of all rows of a block, each row closed by the end mark, and where each row begins."""
    words, sizes = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
    for piece in slices(part["text"]):
        hashes, _, _, bounds = word_hashes(piece, NON_SPACE)
        n = np.diff(bounds)
        out = np.full(len(hashes) + len(n), END, dtype=np.uint64)
        out[np.arange(len(hashes)) + np.repeat(np.arange(len(n)), n)] = hashes & _KEY
        words.append(out)
        sizes.append(n + 1)
    return np.concatenate(words), np.append(0, np.cumsum(np.concatenate(sizes)))


class Grams:
    """The n-grams of one block. For order k, key[k] has the different ones, sorted; at[k][i] is the number there of the one that ends
    with token i, and past[k][i] the number of its history in key[k - 1]; both -1 where there is none."""

    def __init__(self, part: pa.Table, order: int):
        words, self.bounds = _tokens(part)
        self.train = np.repeat(part["train"].to_numpy().astype(bool), np.diff(self.bounds))
        self.key, self.at, self.past = {}, {}, {}
        first = self.bounds[:-1]
        self.key[1], self.at[1] = np.unique(words, return_inverse=True)
        end = int(np.searchsorted(self.key[1], END))
        for k in range(2, order + 1):
            before = np.empty_like(self.at[k - 1])
            before[1:] = self.at[k - 1][:-1]
            before[first] = end if k == 2 else -1
            valid = np.flatnonzero(before >= 0)
            own, inverse = np.unique(mix(self.key[k - 1][before[valid]] * _NEXT + words[valid]) & _KEY, return_inverse=True)
            self.key[k], self.past[k], self.at[k] = own, before, np.full(len(words), -1)
            self.at[k][valid] = inverse

    def place(self, k: int) -> np.ndarray:
        """A token that each n-gram of order ``k`` ends with."""
        out = np.zeros(len(self.key[k]), dtype=np.int64)
        there = np.flatnonzero(self.at[k] >= 0)
        out[self.at[k][there]] = there
        return out


SENT = "order int, part int, blk int, keys binary, counts binary, alone bigint"
TABLE = "order int, blk int, part int, totals binary, owned binary, keys binary, tally array<bigint>"
_TABLE = pa.schema([("order", pa.int32()), ("blk", pa.int32()), ("part", pa.int32()), ("totals", pa.binary()), ("owned", pa.binary()), ("keys", pa.binary()), ("tally", pa.list_(pa.int64()))])


def _with_order(table: pa.Table, k: int) -> pa.Table:
    return table.add_column(0, "order", pa.array([k] * len(table), pa.int32()))


def _pieces(own: Grams, k: int, blk: int, ranges: int, send: np.ndarray | slice = slice(None), alone: int = 0) -> pa.Table:
    """A block's n-grams of one order for their ranges: twice the training count, and 1 more where a text that is not for training has it."""
    there = own.at[k] >= 0
    train, other = own.at[k][there & own.train], own.at[k][there & ~own.train]
    value = 2 * np.bincount(train, minlength=len(own.key[k]))
    value[other] |= 1
    value = value[send]
    out = _with_order(cut_up(blk, own.key[k][send], lambda s: planes(value[s]), ranges), k)
    return out.append_column("alone", pa.array([alone] * bool(len(out)) + [0] * (len(out) - 1), pa.int64()))


def _tally(counts: np.ndarray) -> list[int]:
    """How many different n-grams there are, their occurrences, and how many occur 1, 2, .. DISCOUNTED + 1 times."""
    own = counts[counts > 0]
    return [len(own), int(own.sum()), *(int((own == r).sum()) for r in range(1, DISCOUNTED + 2))]


def _counting(order: int, ranges: int):
    def send(part: pa.Table) -> pa.Table:
        blk = part["blk"][0].as_py()
        own = Grams(opened(part), order)
        return pa.concat_tables([_pieces(own, k, blk, ranges) for k in range(1, order + 1)])

    return send


class Known:
    """Totals of a block's n-grams by order, as far as they came back: total[k], asked[k] (by any text that is not for training), owned[k]
    (this block stands for it). Number -1 is none."""

    def __init__(self, own: Grams, back: pa.Table, order: int):
        self.own, self.total, self.asked, self.owned = own, {}, {}, {}
        orders = back["order"].to_numpy()
        for k in range(1, order + 1):
            value, owned = _answers(back.filter(pa.array(orders == k)))
            total, asked = value >> 1, (value & 1) > 0
            if k > 2:
                send, count = self.to_send(k)
                for x, y in ((count, total), (flag := np.zeros(len(send), dtype=bool), asked), (mine := np.ones(len(send), dtype=bool), owned)):
                    x[send] = y
                total, asked, owned = count, flag, mine
            self.total[k], self.asked[k], self.owned[k] = np.append(total, 0), np.append(asked, False), owned

    def to_send(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Which n-grams of order ``k`` a range must count, and the counts of the others."""
        place = self.own.place(k)
        parts = self.own.past[k][place], self.own.at[k - 1][place]
        seen, alone = (self.total[k - 1][parts[0]] > 0) & (self.total[k - 1][parts[1]] > 0), np.zeros(len(place), dtype=bool)
        for x in parts:
            alone |= (self.total[k - 1][x] == 1) & ~self.asked[k - 1][x]
        send = seen & ~alone
        if len(send) and not send.any():
            send[0] = True  # every block answers for itself
        return send, (seen & alone).astype(np.int64)


def _counting_more(k: int, ranges: int):
    def send(docs: pa.Table, back: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.schema([("order", pa.int32()), ("part", pa.int32()), ("blk", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("alone", pa.int64())]).empty_table()
        blk = docs["blk"][0].as_py()
        own = Grams(opened(docs), k)
        go, count = Known(own, back, k - 1).to_send(k)
        return _pieces(own, k, blk, ranges, np.flatnonzero(go), int(count[~go].sum()))

    return send


def _summing(part: pa.Table) -> pa.Table:
    """Of one order and range: totals for every block that asked, in its order of keys; and the table with its tally (blk -1)."""
    k = part["order"][0].as_py()
    part, cut, order, first, keys = met(part)
    sent = np.concatenate([unplanes(x) for x in part["counts"].to_pylist()])
    count, own = summed(sent >> 1, order, first)
    asked, _ = summed(sent & 1, order, first)
    back = _with_order(answered(part, cut, 2 * count + (asked > 0), own), k)
    every = count[order][first]
    seen = every > 0
    tally, alone = _tally(every), sum(part["alone"].to_pylist())
    for i in (0, 1, 2):
        tally[i] += alone
    one = {
        "order": [k], "blk": [-1], "part": [part["part"][0].as_py()], "totals": [planes(every[seen])], "owned": [b""],
        "keys": [packed(keys[first][seen]) if seen.any() else b""], "tally": [tally],
    }
    back = pa.table([back[f.name] if f.name in back.schema.names else pa.nulls(len(back), f.type) for f in _TABLE], schema=_TABLE)
    return pa.concat_tables([back, pa.table(one, schema=_TABLE)])


def discounts(times: np.ndarray) -> np.ndarray:
    """Discount factors of counts 0..DISCOUNTED from how many n-grams occur 1, 2, .. DISCOUNTED + 1 times; the first is unused."""
    n = np.append(0.0, times.astype(np.float64))
    k = DISCOUNTED
    absolute = n[1] / (n[1] + 2 * n[2]) if n[1] > 0 else 0.5
    out = np.ones(k + 1)
    for r in range(1, k + 1):
        good = 0.0
        if n[r] > 0 and n[1] > 0 and n[r + 1] > 0:
            tail = (k + 1) * n[k + 1] / n[1]
            good = ((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail) if tail < 1 else 0.0
        out[r] = good if 0 < good < 1 else 1 - min(absolute, 0.99) / r
    return out


@dataclass
class Katz:
    """Probabilities from counts and from the tallies of each order's n-grams."""

    tallies: list[list[int]]

    def __post_init__(self):
        self.types, self.tokens = self.tallies[0][:2]
        self.factors = {k: discounts(np.array(t[2:])) for k, t in enumerate(self.tallies, 1)}
        few = np.arange(1, DISCOUNTED + 1)
        lost = float(((1 - self.factors[1][1:]) * few * np.array(self.tallies[0][2 : DISCOUNTED + 2])).sum())
        self.unknown = (SPARE + lost) / (self.tokens + SPARE)

    def _discounted(self, count: np.ndarray, k: int) -> np.ndarray:
        return count * np.where(count <= DISCOUNTED, self.factors[k][np.minimum(count, DISCOUNTED)], 1.0)

    def seen(self, count: np.ndarray, history: np.ndarray, k: int) -> np.ndarray:
        """Probability of n-grams of order ``k``; a word that is not in the table has its share of the unknown."""
        if k == 1:
            return np.where(count > 0, self._discounted(count, 1) / (self.tokens + SPARE), self.unknown)
        return self._discounted(count, k) / (history + SPARE)

    def taken(self, count: np.ndarray, k: int) -> np.ndarray:
        """What the discount leaves for back-off; zero, not a rounded difference, where there is no discount."""
        return count - self._discounted(count, k)


FOUND = "order int, blk int, part int, keys binary, values binary, asked binary, docs binary, waits binary"
_FOUND = pa.schema([("order", pa.int32()), ("blk", pa.int32()), ("part", pa.int32()), *((c, pa.binary()) for c in ("keys", "values", "asked", "docs", "waits"))])


def _stream(data: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, data.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(data)
    return out.getvalue().to_pybytes()


def _judging(order: int, ranges: int, model: Katz):
    """Of one block: its documents' scores short of back-off weights, with the histories they wait for (one row); and for each
    order and range what the block's own n-grams add to the histories that anyone asks for, and which ones it asks for itself."""

    def run(docs: pa.Table, back: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _FOUND.empty_table()
        blk, docs = docs["blk"][0].as_py(), opened(docs)
        own = Grams(docs, order)
        known = Known(own, back, order)
        total, asked, owned = known.total, known.asked, known.owned
        count = {k: total[k][own.at[k]] for k in range(1, order + 1)}
        past = {k: total[k - 1][own.past[k]] for k in range(2, order + 1)}
        n = len(own.bounds) - 1
        row = np.repeat(np.arange(n), np.diff(own.bounds))
        value = model.seen(count[1], None, 1)
        done = np.ones(len(value), dtype=np.int64)  # highest order that knows the token
        for k in range(2, order + 1):
            value = np.where(count[k] > 0, model.seen(count[k], past[k], k), value)
            done = np.where(count[k] > 0, k, done)
        add = lambda x: np.add.reduceat(x, own.bounds[:-1])
        base = np.log10((count[1] + 1) / (model.tokens + model.types + 1))
        result = pa.table({
            "doc_id": docs["doc_id"], "held_out": pa.array(~own.train[own.bounds[:-1]]), "n_tokens": np.diff(own.bounds), "n_known": add((count[1] > 0).astype(np.int64)),
            "base": add(base), "score": add(np.log10(value)),
        })
        waits, pieces, asks = [], [], 0
        for k in range(2, order + 1):
            some = np.flatnonzero((done < k) & (past[k] > 0))
            mine = np.zeros(len(own.key[k - 1]), dtype=bool)
            mine[own.past[k][some]] = True
            number = np.cumsum(mine) - 1
            many = int(mine.sum())
            pair, times = np.unique(row[some] * max(many, 1) + number[own.past[k][some]], return_counts=True)
            waits.append(pa.table({"row": pair // max(many, 1), "ask": asks + pair % max(many, 1), "n": times}))
            asks += many
            # each different training n-gram adds to its history once, in the block that owns it
            place = own.place(k)[owned[k] & (total[k][:-1] > 0)]
            place = place[asked[k - 1][own.past[k][place]]]
            to = own.past[k][place]
            shorter = model.seen(count[k - 1][place], past[k - 1][place] if k > 2 else None, k - 1)
            taken = np.bincount(to, weights=model.taken(count[k][place], k), minlength=len(mine))
            lower = np.bincount(to, weights=shorter, minlength=len(mine))
            send = np.flatnonzero(mine | (lower > 0))
            key, cut = own.key[k - 1][send], cuts(own.key[k - 1][send], ranges)
            parts = [p for p in range(ranges) if cut[p + 1] > cut[p]]
            spans = [slice(cut[p], cut[p + 1]) for p in parts]
            m = len(parts)
            pieces.append(pa.table(
                [pa.array([k] * m, pa.int32()), pa.array([blk] * m, pa.int32()), pa.array(parts, pa.int32()), pa.array([packed(key[s]) for s in spans], pa.binary()),
                 pa.array([_stream(pa.table({"c": total[k - 1][send[s]], "taken": taken[send[s]], "lower": lower[send[s]]})) for s in spans], pa.binary()),
                 pa.array([np.packbits(mine[send[s]]).tobytes() for s in spans], pa.binary()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary())],
                schema=_FOUND,
            ))
        whole = pa.table(
            [pa.array([0], pa.int32()), pa.array([blk], pa.int32()), pa.array([-1], pa.int32()), *(pa.nulls(1, pa.binary()) for _ in range(3)), pa.array([_stream(result)], pa.binary()),
             pa.array([_stream(pa.concat_tables(waits)) if waits else None], pa.binary())],
            schema=_FOUND,
        )
        return pa.concat_tables([whole, *pieces])

    return run


def _answers(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Totals and owner marks of one order that came back to a block, in the order of its keys."""
    found = sorted(zip(rows["part"].to_pylist(), rows["totals"].to_pylist(), rows["owned"].to_pylist(), strict=True))
    value = [unplanes(x) for _, x, _ in found]
    own = [np.unpackbits(np.frombuffer(x, dtype=np.uint8), count=len(v)).astype(bool) for (_, _, x), v in zip(found, value, strict=True)]
    return np.concatenate([np.zeros(0, dtype=np.int64), *value]), np.concatenate([np.zeros(0, dtype=bool), *own])


WEIGHTS = "order int, blk int, part int, weights binary, keys binary"


def _weighing(part: pa.Table) -> pa.Table:
    """log10 of the back-off weights of the histories of one order and range: for the blocks that ask, and as a table (blk -1)."""
    part = part.sort_by("blk")
    values = [pa.ipc.open_stream(x).read_all() for x in part["values"].to_pylist()]
    part = part.append_column("counts", pa.array([planes(v["c"].to_numpy()) for v in values], pa.binary()))
    part, cut, order, first, keys = met(part)
    joined = pa.concat_tables(values)
    taken, lower = (summed(joined[c].to_numpy(), order, first)[0] for c in ("taken", "lower"))
    weight = np.log10((SPARE + taken) / (joined["c"].to_numpy() + SPARE) / (1 - lower))
    out = []
    for i, asked in enumerate(part["asked"].to_pylist()):
        own = weight[cut[i] : cut[i + 1]]
        out.append(own[np.unpackbits(np.frombuffer(asked, dtype=np.uint8), count=len(own)).astype(bool)].tobytes())
    return pa.table({
        "order": pa.array([part["order"][0].as_py()] * (len(out) + 1), pa.int32()), "blk": pa.array([*part["blk"].to_pylist(), -1], pa.int32()),
        "part": pa.array([*part["part"].to_pylist(), part["part"][0].as_py()], pa.int32()),
        "weights": pa.array([*out, weight[order][first].tobytes()], pa.binary()), "keys": pa.array([None] * len(out) + [packed(keys[first])], pa.binary()),
    })


SCORED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def _finishing(whole: pa.Table, weights: pa.Table) -> pa.Table:
    out = []
    rows = sorted(zip(*(weights[c].to_pylist() for c in ("order", "part", "weights")), strict=True))
    weight = np.concatenate([np.zeros(0), *(np.frombuffer(w, dtype=np.float64) for *_, w in rows)])
    for docs, waits in zip(whole["docs"].to_pylist(), whole["waits"].to_pylist(), strict=True):
        docs = pa.ipc.open_stream(docs).read_all()
        waits = pa.ipc.open_stream(waits).read_all() if waits else pa.table({"row": np.zeros(0, dtype=np.int64), "ask": np.zeros(0, dtype=np.int64), "n": np.zeros(0, dtype=np.int64)})
        more = np.bincount(waits["row"].to_numpy(), weights=waits["n"].to_numpy() * weight[waits["ask"].to_numpy()], minlength=len(docs))
        out.append(pa.table({
            "doc_id": docs["doc_id"], "held_out": docs["held_out"], "n_tokens": docs["n_tokens"], "n_known": docs["n_known"], "base_score": docs["base"],
            "score": docs["score"].to_numpy() + more[: len(docs)],
        }))
    if not out:
        return pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]).empty_table()
    return pa.concat_tables(out)


def ngram_tables(rows: DataFrame, n: int, order: int = ORDER) -> tuple[DataFrame, Katz]:
    """Written tables of all orders up to ``order`` (see TABLE: blk -1 is the table, the others answer blocks), and the model's constants."""
    ranges = range_count(n)
    summed_ = lambda pieces: written(pieces.groupBy("order", "part").applyInArrow(released_table(_summing), TABLE))
    tables = summed_(rows.groupBy("blk").applyInArrow(released_table(_counting(min(order, 2), ranges)), SENT))
    for k in range(3, order + 1):
        back = tables.where("blk >= 0").select("order", "blk", "part", "totals", "owned")
        tables = tables.unionByName(summed_(rows.groupBy("blk").cogroup(back.groupBy("blk")).applyInArrow(released_tables(_counting_more(k, ranges)), SENT)))
    found = {(k, i): x for k, i, x in tables.where("blk = -1").select("order", F.posexplode("tally")).groupBy("order", "pos").agg(F.sum("col")).collect()}
    return tables, Katz([[found.get((k, i), 0) for i in range(DISCOUNTED + 3)] for k in range(1, order + 1)])


def score(docs: DataFrame, train: Column, order: int = ORDER) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``; ``train`` tells training rows."""
    rows, n = blocks(docs, F.coalesce(train, F.lit(True)).alias("train"))
    tables, model = ngram_tables(rows, n, order)
    back = tables.where("blk >= 0").select("blk", "part", "totals", "owned", "order")
    found = written(rows.groupBy("blk").cogroup(back.groupBy("blk")).applyInArrow(released_tables(_judging(order, range_count(n), model)), FOUND))
    discard(back)
    weights = written(found.where("part >= 0").groupBy("order", "part").applyInArrow(released_table(_weighing), WEIGHTS))
    whole = found.where("part = -1").select("blk", "docs", "waits")
    scored = whole.groupBy("blk").cogroup(weights.where("blk >= 0").groupBy("blk")).applyInArrow(released_tables(_finishing), SCORED)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("bigint").alias("train_tokens"), "base_score", "score")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fold(F.col("doc_id"), 7) != 2)
