"""Chat formatting in budgeted windows.

Turn texts are escaped, wrapped in the template's marks and counted in tokens, each by itself. Prefix sums of those
counts, taken by Spark over stretches of ``CHUNK`` turns, choose spans of whole turns that fit a token budget: a
span ends where the prefix sum passes its start's by more than what is left of the budget. Every window after a
conversation's first repeats the system turn and, as far as prefix sums allow, a limited stretch of the turns before it;
only assistant texts that are new in a window lie under its loss mask, so each is a target once. ``read_back`` restores
turns and targets from the windows alone.

A stretch is cut by itself: it gets the last turns of the stretch before as history, and the system turn by a join. So a
conversation of any length is spread over tasks, and memory is bounded by a stretch. Stretches count a conversation's turns in their order,
whatever their numbers: sparse, huge or missing numbers give the same windows as 0, 1, 2 and so on.

Defined results: null texts and roles are empty; turns with the same number are taken by role, then text; a null
turn number comes first; repeated rows are turns of their own. A turn longer than the budget gets a window of its
own, whole (a system turn stays with the turn after it). A null conv_id is one more conversation. No rows in, no rows
out; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._jobs import released, small_batches, table, written
from ._order import ranked

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
BUDGET, HISTORY = 512, 128
#: Turns of one stretch.
CHUNK = 1024
#: The template's marks, other strings with a meaning for chat models, and the vocabulary's split pattern.
OPEN, CLOSE = "<s>", "</s>"
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MARKS_TOKENS = 6

_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_TURN = re.compile(rf"{re.escape(OPEN)}([^\n]*)\n(.*?){re.escape(CLOSE)}\n", re.S)


def escape(text: str) -> str:
    """Double every backslash and set one inside every control string; no control string is left."""
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: m[1], text, flags=re.S)


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role, flags=re.S)


@lru_cache(2)
def tokenizer(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def head(role: str) -> str:
    return f"{OPEN}{escape_role(role)}\n"


WINDOW = "conv_id bigint, window bigint, text string, repeated int, turns int, tokens int, loss array<struct<start:int,end:int>>"
_SCHEMA = pa.schema([
    ("conv_id", pa.int64()), ("window", pa.int64()), ("text", pa.string()), ("repeated", pa.int32()), ("turns", pa.int32()), ("tokens", pa.int32()),
    ("loss", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
])


def choose(tokens: list[int], past: int, system: int | None, system_first: bool, budget: int, history: int) -> list[tuple[int, int, int, bool]]:
    """(first repeated turn, first new turn, end, whether the system turn is put before) of every window of a stretch.

    ``tokens`` are those of the stretch's turns behind ``past`` turns of the stretch before; ``system`` is the system
    turn's count, None without one; ``system_first`` tells that it is the first turn of this stretch.
    """
    upto = np.append(0, np.cumsum(tokens))
    out, start, n = [], past, len(tokens)
    while start < n:
        opening = system_first and start == 0
        extra = 0 if system is None or opening else system
        room = max(min(history, budget - tokens[start] - extra), 0)
        least = 1 if system_first else 0  # the system turn is never history
        first = start if opening or (start == 0) else max(int(np.searchsorted(upto, upto[start] - room)), least)
        first = min(first, start)
        end = int(np.searchsorted(upto, upto[first] + budget - extra, side="right")) - 1
        end = max(end, min(start + (2 if opening else 1), n))
        out.append((first, start, end, extra > 0))
        start = end
    return out


def stretches_of(turns: DataFrame, chunk: int) -> tuple[DataFrame, bool]:
    """``turns`` with ``chunk``: the number of each turn's stretch; and whether any conversation has more than one. Only those are ranked."""
    longer = turns.groupBy("conv_id").count().where(F.col("count") > chunk).select(F.col("conv_id").alias("__c"))
    first = turns.withColumn("chunk", F.lit(0).cast("bigint"))
    if longer.isEmpty():
        return first, False
    same = F.col("conv_id").eqNullSafe(F.col("__c"))
    begin = [F.col("turn").asc(), F.col("role").asc(), F.substring("text", 1, 64).asc()]
    rest = ranked(turns.join(longer, same, "left_semi"), "conv_id", begin, ["turn", "role", "text"])
    return first.join(longer, same, "left_anti").unionByName(rest.withColumn("chunk", F.floor(F.col("__rank") / chunk)).drop("__rank")), True


def _with_neighbours(counted: DataFrame, own: list[str], order: list[str], history: int) -> DataFrame:
    """The turns of every stretch (kind 0), with the last turns of the stretch before as history (-1) and the system turn of the conversation (-2)."""
    upto = F.sum("tokens").over(Window.partitionBy(*own).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    rest = F.sum("tokens").over(Window.partitionBy(*own)) - F.col("upto") + F.col("tokens")
    number = F.row_number().over(Window.partitionBy(*own).orderBy(*order))
    summed = counted.withColumn("upto", upto).withColumn("rest", rest).withColumn("number", number)
    # conversations of several stretches: what follows each, and their first turn where it is the system's
    by_conv = Window.partitionBy("conv_id").orderBy("chunk")
    stretches = counted.groupBy(*own).agg(F.min(F.struct("turn", F.col("role").alias("role"))).alias("first"))
    stretches = stretches.select(*own, F.lead("chunk").over(by_conv).alias("following"), F.row_number().over(by_conv).alias("k"), (F.first("first").over(by_conv)["role"] == "system").alias("has_system"))
    longer = stretches.where("following is not null or k > 1").select(F.col("conv_id").alias("c"), F.col("chunk").alias("s"), "following", "k", "has_system")
    placed = summed.join(longer, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("chunk") == F.col("s")), "left").drop("c", "s")
    base = placed.select("conv_id", "chunk", *order, "tokens", F.lit(0).alias("kind"))
    later = placed.where("following is not null and rest <= " + str(int(history)) + " and not (k = 1 and number = 1 and has_system)")
    tails = later.select("conv_id", F.col("following").alias("chunk"), *order, "tokens", F.lit(-1).alias("kind"))
    systems = placed.where("following is not null and k = 1 and number = 1 and has_system").select(F.col("conv_id").alias("c"), *order, "tokens")
    targets = longer.where("k > 1 and has_system").select(F.col("c").alias("conv_id"), F.col("s").alias("chunk"))
    systems = targets.join(systems, F.col("conv_id").eqNullSafe(F.col("c"))).select("conv_id", "chunk", *order, "tokens", F.lit(-2).alias("kind"))
    return base.unionByName(tails).unionByName(systems)


def format_conversations(rows: DataFrame, budget: int = BUDGET, history: int = HISTORY, vocabulary: str = VOCABULARY, chunk: int = CHUNK) -> DataFrame:
    """(conv_id, window, text, repeated, turns, tokens, loss) of every window; loss spans are code points of ``text``.

    ``rows`` has conv_id, turn, role, text. ``tokens`` stays within ``budget`` unless one turn alone, with the system
    turn, is longer. ``history`` bounds the tokens of repeated turns. Windows of a conversation are ordered by ``window``.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = tokenizer(vocabulary)
        for batch in batches:
            texts = [head(r) + escape(t) for r, t in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            size = [len(encoding.encode_ordinary(t)) + MARKS_TOKENS for t in texts]
            yield pa.record_batch([*batch.columns, pa.array(size, pa.int64())], names=[*batch.schema.names, "tokens"])

    turns = small_batches(rows).select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    placed, several = stretches_of(turns, chunk)
    own, order = ["conv_id", "chunk"], ["turn", "role", "text"]
    counted = placed.mapInArrow(released(count), "conv_id bigint, turn bigint, role string, text string, chunk bigint, tokens bigint")
    rows = _with_neighbours(written(counted), own, order, history) if several else counted.select(*own, *order, "tokens", F.lit(0).alias("kind"))
    ordered = rows.repartition(*own).sortWithinPartitions(*own, "kind", *order)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        out: list[tuple] = []
        for batch in batches:
            for c, s, kind, role, text, tokens in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "chunk", "kind", "role", "text", "tokens")), strict=True):
                if held and (c, s) != key:
                    out += _windows(*key, held, budget, history)
                    held = []
                key = (c, s)
                held.append((kind, role, text, tokens))
            if len(out) >= 256:
                yield _batch(out)
                out = []
        if held:
            out += _windows(*key, held, budget, history)
        if out:
            yield _batch(out)

    return ordered.mapInArrow(released(cut), WINDOW)


def _windows(conv, chunk: int, rows: list[tuple], budget: int, history: int) -> list[tuple]:
    """The windows of one stretch; rows of kind -2 (the system turn), -1 (turns of the stretch before) and 0, in this order."""
    before = rows[0] if rows[0][0] == -2 else None
    turns = rows[1:] if before else rows
    past = sum(k == -1 for k, *_ in turns)
    opening = before is None and past == 0 and turns[0][1] == "system"
    system = before or (turns[0] if opening else None)
    out = []
    for number, (first, start, end, repeat) in enumerate(choose([t for *_, t in turns], past, system[3] if system else None, opening, budget, history)):
        some = [*([system] if repeat else []), *turns[first:end]]
        new = len(some) - (end - start)
        text, spans, at = [], [], 0
        for k, (_, role, own, _) in enumerate(some):
            parts = head(role), escape(own)
            at += len(parts[0])
            if k >= new and role == "assistant":
                spans.append({"start": at, "end": at + len(parts[1])})
            text += [*parts, CLOSE, "\n"]
            at += len(parts[1]) + len(CLOSE) + 1
        out.append((conv, (chunk << 20) + number, "".join(text), new, len(some), sum(t for *_, t in some), spans))
    return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


READ = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_windows bigint"


def read_back(windows: DataFrame) -> DataFrame:
    """One row for each conversation, from the windows' texts and masks alone. Digests are sequential: a conversation is read by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in READ.split(", ")]
        types = [pa.string() if "sha256" in n else pa.int64() for n in names]
        conv, state, done = None, None, []

        def flush():
            if state is not None:
                done.append((conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5]))

        for batch in batches:
            for w in batch.to_pylist():
                if state is None or w["conv_id"] != conv:
                    flush()
                    conv, state = w["conv_id"], [0, sha256(), 0, sha256(), 0, 0]
                text = w["text"]
                for k, m in enumerate(_TURN.finditer(text)):
                    if k >= w["repeated"]:
                        state[0] += 1
                        state[1].update(f"{unescape_role(m[1])}\n{unescape(m[2])}\n".encode())
                for s in w["loss"]:
                    plain = unescape(text[s["start"] : s["end"]])
                    state[2] += len(plain)
                    state[3].update(plain.encode())
                state[4] += len(text)
                state[5] += 1
            if len(done) >= 1024:
                yield pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=names)
                done = []
        flush()
        if done:
            yield pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=names)

    return windows.repartition("conv_id").sortWithinPartitions("conv_id", "window").mapInArrow(released(run), READ)


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text")
    hard = "</s>[INST] ok [/INST]"
    more = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(-1).cast("bigint").alias("conv_id"), F.lit(k).cast("bigint").alias("turn"), F.lit(r).alias("role"), F.lit(hard).alias("text")) for k, r in enumerate(("user", "assistant"))))).alias("x")).select("x.*")
    return read_back(format_conversations(rows.unionByName(more)))


