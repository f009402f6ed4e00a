"""Joins of changelogs in streams: inner and left outer joins of several inputs, whose results are retracted and replaced as rows come.

Every input carries row kinds: +I and +U put a row, -U and -D take one back; inputs without kinds only put rows. The first input is the base.
Each base row goes with the matching rows of every other input: a required one (inner) holds it back until there is a match, an optional one
(left outer) gives nulls until then. Rows match while their keys are equal and their event times differ by ``retention`` at most. State is kept by
key and input, and a timer on event time removes each row when the watermark is ``retention`` past it, so state is bounded by
what came within that time.

The result is a changelog too: of each micro-batch, what changed for a key: -U and +U where a base row got another image, +I and -D otherwise, numbered
by ``seq`` within the key, and dated (``changed``) by the latest input row of the key in that micro-batch, so a second join may follow in the same query.
Rows travel and rest as JSON texts, which give back every type exactly; Python touches no values.

Defined results: rows with a null in their key match nothing (optional inputs then give nulls at once). Rows without a time go. Equal rows count as often as they
came; taking back a row that is not there (or no longer) does nothing. Rows behind the watermark are dropped.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from millrace.sources.upserts import EXACT
from millrace.streaming.jobs import DELAY

PUT = ("+I", "+U")


@dataclass(frozen=True)
class Side:
    """An input: its stream, its key columns, the column of its event time, its columns in the result (theirs to ours, all by default).

    ``watermarked`` says that the stream has a watermark on ``ts`` already, as the result of another join has.
    """

    rows: DataFrame
    key: Sequence[str]
    ts: str
    columns: Mapping[str, str] | None = None
    required: bool = True
    kind: str | None = None
    watermarked: bool = False

    def out(self) -> dict[str, str]:
        return dict(self.columns) if self.columns is not None else {c: c for c in self.rows.columns if c not in ("kind", "seq", "changed")}

    def tagged(self, number: int, delay: str) -> DataFrame:
        rows = self.rows if self.watermarked else self.rows.withWatermark(self.ts, delay)
        kind = F.lit("+I") if self.kind is None else F.col(self.kind)
        keys = [F.col(c).cast("string").alias(f"k{i}") for i, c in enumerate(self.key)]
        return rows.select(*keys, F.lit(number).alias("side"), kind.alias("kind"), F.col(self.ts).alias("ts"), F.unix_micros(self.ts).alias("at"), F.to_json(F.struct(*self.out()), EXACT).alias("row"))


class Joined(StatefulProcessor):
    """State of a key: for each input, how often each row is there and its event time in microseconds."""

    def __init__(self, required: Sequence[bool], retention_us: int):
        self.required, self.retention = list(required), retention_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = [handle.getMapState(f"side{k}", "row string", "n bigint, at bigint") for k in range(len(self.required))]

    def _images(self, base: str, n: int, at: int, sides: list[dict[str, tuple[int, int]]]) -> Counter:
        """Joined images of one base row, with how often each is there."""
        choices = []
        for k, rows in enumerate(sides[1:], 1):
            near = [(row, m) for row, (m, when) in rows.items() if abs(when - at) <= self.retention]
            if not near and self.required[k]:
                return Counter()
            choices.append(near or [(None, 1)])
        out: Counter = Counter()
        for parts in itertools.product(*choices):
            times = n
            for _, m in parts:
                times *= m
            out[base, *(row for row, _ in parts)] += times
        return out

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        moved, times, last = [Counter() for _ in self.held], [{} for _ in self.held], None
        for r in rows:
            moved[r.side][r.row] += 1 if r.kind in PUT else -1
            times[r.side][r.row] = max(r.at, times[r.side].get(r.row, r.at))
            last = r if last is None or r.at > last.at else last
        if any(k is None for k in key):
            before, after = [{} for _ in self.held], [{row: (n, times[0][row]) for row, n in moved[0].items() if n > 0}, *({} for _ in self.held[1:])]
        else:
            before = [{k[0]: (v[0], v[1]) for k, v in s.iterator()} for s in self.held]
            after = [dict(side) for side in before]
            due = set()
            for k, changes in enumerate(moved):
                for row, n in changes.items():
                    have, at = before[k].get(row, (0, times[k][row]))
                    if have + n > 0:
                        after[k][row] = (have + n, max(at, times[k][row]))
                        if after[k][row] != before[k].get(row):
                            self.held[k].updateValue((row,), after[k][row])
                            due.add(-(-(after[k][row][1] + self.retention + 1) // 1000))
                    elif row in after[k]:
                        del after[k][row]
                        self.held[k].removeKey((row,))
            for ms in due:
                self.handle.registerTimer(ms)
        bases = sorted(set(before[0]) | set(after[0])) if any(moved[1:]) else sorted(moved[0])
        seq = 0
        for base in bases:
            was = self._images(base, *before[0][base], before) if base in before[0] else Counter()
            now = self._images(base, *after[0][base], after) if base in after[0] else Counter()
            gone, new = list((was - now).elements()), list((now - was).elements())
            both = min(len(gone), len(new))
            for kind, image in [*itertools.chain(*((("-U", a), ("+U", b)) for a, b in zip(gone, new, strict=False))), *(("-D", a) for a in gone[both:]), *(("+I", b) for b in new[both:])]:
                yield Row(kind=kind, seq=seq, changed=last.ts, **{f"r{k}": text for k, text in enumerate(image)})
                seq += 1

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        limit = expiredTimerInfo.getExpiryTimeInMs() * 1000
        for side in self.held:
            for row, (_, at) in list(side.iterator()):
                if at + self.retention < limit:
                    side.removeKey(row)
        return iter([])

    def close(self) -> None:
        pass


def changelog_join(*sides: Side, retention: float, delay: str = DELAY) -> DataFrame:
    """(kind, seq, changed, columns of all sides): the first side is the base; ``retention`` is in seconds. The RocksDB state store is needed."""
    n = len(sides[0].key)
    if any(len(s.key) != n for s in sides):
        raise ValueError("the sides' keys differ in length")
    if sides[0].required is False:
        raise ValueError("the base is always required")
    tagged = reduce(DataFrame.unionByName, (s.tagged(k, delay) for k, s in enumerate(sides)))
    processor = Joined([s.required for s in sides], round(retention * 1_000_000))
    schema = "kind string, seq int, changed timestamp, " + ", ".join(f"r{k} string" for k in range(len(sides)))
    found = tagged.groupBy(*(f"k{i}" for i in range(n))).transformWithState(processor, schema, "Append", "EventTime", eventTimeColumnName="changed")
    parsed = found.select("kind", "seq", "changed", *(F.from_json(f"r{k}", s.rows.select(*s.out()).schema, EXACT).alias(f"r{k}") for k, s in enumerate(sides)))
    return parsed.select("kind", "seq", "changed", *(F.col(f"r{k}")[c].alias(name) for k, s in enumerate(sides) for c, name in s.out().items()))
