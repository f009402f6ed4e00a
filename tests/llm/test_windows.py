"""Budgeted chat windows: budget, history, the system turn and masks against a plain reading of the rules, and long conversations in stretches."""

import random

import pytest

from millrace.llm import chat


def conversations(seed):
    rng = random.Random(seed)
    rows = []
    for c in range(12):
        roles = (["system"] if c % 3 else []) + ["user", "assistant"] * rng.randint(1, 30)
        rows += [(c, k, r, "".join(rng.choice(["ab ", "</s>", "\\", "é", "\n", "word "]) for _ in range(rng.choice([1, 5, 20, 300 if k == 7 else 40])))) for k, r in enumerate(roles)]
    return rows + [(50, 0, "user", None), (50, 1, None, "x"), (51, None, "assistant", "first"), (51, 5, "user", "last"), (None, 0, "user", "lost"), (None, 0, "assistant", "found"), (52, 3, "user", "same"), (52, 3, "user", "same")]


@pytest.mark.parametrize(("budget", "history", "chunk"), [(128, 40, 1024), (128, 40, 8), (64, 0, 4)])
def test_windows(spark, budget, history, chunk):
    rows = conversations(budget)
    count = lambda role, text: len(chat.tokenizer(chat.VOCABULARY).encode_ordinary(chat.head(role) + chat.escape(text))) + chat.MARKS_TOKENS
    found = chat.format_conversations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"), budget, history, chunk=chunk).collect()
    by = {}
    for w in found:
        by.setdefault(w.conv_id, []).append(w)
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    wanted = {c: [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=key)] for c in {r[0] for r in rows}}
    assert set(by) == set(wanted)
    for c, turns in wanted.items():
        new, targets = [], []
        for j, w in enumerate(sorted(by[c], key=lambda w: w.window)):
            own = [(chat.unescape_role(m[1]), chat.unescape(m[2])) for m in chat._TURN.finditer(w.text)]
            assert len(own) == w.turns and w.tokens == sum(count(*t) for t in own)
            repeated, fresh = own[: w.repeated], own[w.repeated :]
            assert fresh
            system = [turns[0]] if turns[0][0] == "system" and j else []
            assert repeated[: len(system)] == system
            past = repeated[len(system) :]
            assert not past or new[len(new) - len(past) :] == past  # the turns just before, in order
            assert sum(count(*t) for t in past) <= history
            alone = count(*fresh[0]) + sum(count(*t) for t in system)
            assert w.tokens <= budget or len(fresh) == 1 and not past or (j == 0 and len(fresh) == 2 and fresh[0][0] == "system")
            if chunk > 1000:  # as much history as fits, and no room left for the next turn
                room = min(history, budget - alone)
                start = len(new)
                least = 1 if turns[0][0] == "system" else 0
                if j and start - len(past) - 1 >= least:
                    assert sum(count(*t) for t in past) + count(*turns[start - len(past) - 1]) > max(room, 0)
                after = start + len(fresh)
                if after < len(turns):
                    assert w.tokens + count(*turns[after]) > budget
            targets += [chat.unescape(w.text[x.start : x.end]) for x in w.loss]
            assert len(w.loss) == sum(r == "assistant" for r, _ in fresh)
            new += fresh
        assert new == turns and targets == [t for r, t in turns if r == "assistant"]


def test_escaping_round_trip():
    rng = random.Random(1)
    parts = [*chat.CONTROL, "\\", "\n", "n", "<s", ">", "[INST", "é", "x", "\\n"]
    for _ in range(500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        assert chat.unescape(chat.escape(text)) == text and chat.unescape_role(chat.escape_role(text)) == text
        assert not any(c in chat.escape(text) for c in chat.CONTROL) and "\n" not in chat.escape_role(text)


def test_no_rows(spark):
    assert chat.format_conversations(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).collect() == []


@pytest.mark.parametrize("chunk", [1024, 8])
def test_numbers_of_turns_only_give_their_order(spark, chunk):
    """Huge, negative, sparse, equal and missing numbers give the windows of 0, 1, 2 and so on."""
    schema = "conv_id bigint, turn bigint, role string, text string, tokens string, chunk string, number string, __rank string"
    turns = [("user" if k % 2 else "assistant", f"text {k:03} " * (1 + k % 7)) for k in range(40)]
    plain = [(1, k, r, t) for k, (r, t) in enumerate(turns)]
    ways = {
        "huge": lambda k: 10**18 + k, "negative": lambda k: -(2**63) + 3 * k, "sparse": lambda k: 2000 * k, "ends": lambda k: (2**63 - 1) - 7 * (40 - k), "pairs": lambda k: k // 2,
    }
    run = lambda rows: sorted(tuple(w) for w in chat.format_conversations(spark.createDataFrame([(*r, *["x"] * 4) for r in rows], schema).repartition(3), 128, 40, chunk=chunk).collect())
    want = run(plain)
    assert len(want) > 3
    for name, number in ways.items():
        assert run([(1, number(k), r, t) for _, k, r, t in plain]) == want, name
    same = sorted((r, t) for r, t in turns)  # without numbers, or with one for all, role and text give the order
    want = run([(1, k, r, t) for k, (r, t) in enumerate(same)])
    assert run([(1, None, r, t) for r, t in turns]) == want and run([(1, 5, r, t) for r, t in turns]) == want


def test_ranks_over_many_ranges(spark):
    from pyspark.sql import functions as F

    from millrace.llm import _order

    rng = random.Random(2)
    rows = [(rng.choice([1, 2, None] + [7] * 9), rng.randint(0, 30), rng.choice("ab")) for _ in range(500)]
    found = _order.ranked(spark.createDataFrame(rows, "k bigint, o bigint, v string").repartition(6), "k", [F.col("o").asc()], ["o", "v"]).collect()
    for k in (1, 2, 7, None):
        own = sorted((r["__rank"], r.o, r.v) for r in found if r.k == k)
        assert own == [(i, *x) for i, x in enumerate(sorted((o, v) for kk, o, v in rows if kk == k))]
