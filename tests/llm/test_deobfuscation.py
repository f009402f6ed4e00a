"""The noisy channel: disguised and plain words, and the search against all paths."""

import inspect
import itertools
import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from millrace.llm.toxicity import DISGUISED, ORDER, Channel, _character_grams, _class, fit

PROSE = """
you are a stupid idiot and a bad loser so go home now please it is so good and very good of you to say so
the bad weather was bad for the stupid plan and the idiot left it at home the loser lost all the money
good people do good things and bad people do bad things it is a good idea to think before you speak
he said that the new player plays songs on his phone the third and the fourth of may are free days
this text is about nothing at all but it has many words in it so that a model of letters can learn them
some words come again and again good bad stupid idiot loser home people things idea weather money
"""


@pytest.fixture(scope="module")
def channel():
    batch = pa.record_batch([pa.array([PROSE] * 20 + ["the 1st 2nd 4th of 1990 and route 66 or a4 paper b12 and c3po x86"] * 2)], names=["text"])
    counts = next(_character_grams(iter([batch])))
    return Channel(dict(zip(counts["gram"].to_pylist(), counts["n"].to_pylist(), strict=True)))


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("you st00pid 1diot", "you stupid idiot"), ("what a b@d idea", "what a bad idea"), ("sooo gooood", "so good"), ("s t u p i d", "stupid"), ("i.d.i.o.t", "idiot"), ("b4d weather", "bad weather"),
        ("l0ser", "loser"), ("stup!d", "stupid"), ("$tupid", "stupid"), ("loooser", "loser"), ("s-t-u-p-i-d people", "stupid people"), ("you i d i 0 t", "you idiot"),
    ],
)
def test_disguised_words(channel, given, want):
    assert channel.restore(given) == want


@pytest.mark.parametrize("text", ["MP3 and B2B 4th", "the 1st of May 1990", "good money", "A4 paper", "see pages 12-15", "it is x86", "www.x.org", "", "9 3 4 5 1"])
def test_plain_words_stay(channel, text):
    assert channel.restore(text) == text


def test_best_path_against_all_paths(channel):
    rng = random.Random(4)
    for _ in range(60):
        word = "".join(rng.choice("stupid10@$o .-") for _ in range(rng.randint(1, 6)))
        best = -math.inf
        for path in itertools.product(*channel.lattice(word)):
            cost, past = math.log(DISGUISED), "^"
            for x, p in path:
                cost += p
                if x == " ":
                    cost, past = cost + channel.next(past, "$"), "^"
                elif x:
                    cost, past = cost + channel.next(past, _class(x)), (past + _class(x))[-(ORDER - 1) :]
            best = max(best, cost + channel.next(past, "$"))
        assert math.isclose(channel.best(word)[0], best, rel_tol=1e-12)


def test_the_character_model_sums_to_one(channel):
    symbols = {g[-1] for g in channel.counts}
    for past in ("", "^", "^b", "sto", "oo#", "zzz"):
        assert math.isclose(sum(channel.chance(past + c) for c in symbols) + (500 - len(symbols)) * channel.chance(past + "\0"), 1, rel_tol=1e-9)


def test_every_gram_is_counted():
    """Also beyond 400,000 different ones (the former bound on what the decoder gets): over one alphabet of symbols, and equal to a plain count."""
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice("abcé1ñж中_ .") for _ in range(rng.randint(1, 9))) for _ in range(200)) for _ in range(30)] + [None, "", "7 12", "²x"]
    want = Counter()
    for t in texts:
        for w in re.findall(r"[^\W_]+", (t or "").lower()):
            if any(_class(c) != "#" for c in w):
                marked = "^" + "".join(map(_class, w)) + "$"
                want.update(marked[i : i + k] for k in range(1, ORDER + 1) for i in range(len(marked) - k + 1) if marked[i : i + k] != "^")
    got = next(_character_grams(iter([pa.record_batch([pa.array(texts)], names=["text"])])))
    assert dict(zip(got["gram"].to_pylist(), got["n"].to_pylist(), strict=True)) == want
    assert {_class(c) for c in map(chr, range(0x3000)) if c.isalnum()} <= set("abcdefghijklmnopqrstuvwxyz#*")
    assert "limit(" not in inspect.getsource(fit)
