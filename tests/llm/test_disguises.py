"""Disguised toxic words against the model that is fitted to the provided documents: the decoder changes the score, and plain text stays."""

import pyarrow as pa
import pytest

from millrace.llm import toxicity

SF = "/root/testdata/sf0.01"
LEET = {"o": "0", "i": "1", "e": "3", "a": "@", "s": "$"}


@pytest.fixture(scope="module")
def model(spark):
    return toxicity.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))


@pytest.fixture(scope="module")
def channel(model):
    return toxicity.Channel(model.counts)


class Off:
    """No decoding."""

    def restore(self, text):
        return text


def disguises(word):
    yield "".join(LEET.get(c, c) for c in word)
    yield "".join(LEET.get(c, c) if k == next((j for j, x in enumerate(word) if x in LEET), -1) else c for k, c in enumerate(word))
    yield " ".join(word)
    yield ".".join(word)
    yield word[:2] + word[2] * 4 + word[3:]


def test_disguised_words_change_the_score(model, channel):
    plain = [w for w in ("trash", "clown", "idiot", "worthless", "moron", "pathetic", "loser", "disgusting", "stupid") if model.scores(pa.array([w]), Off())[0] >= toxicity.THRESHOLD]
    assert len(plain) >= 6
    texts = [f"The second part of the report says that you are a {d} and nothing more." for w in plain for d in disguises(w)]
    with_, without = model.scores(pa.array(texts), channel), model.scores(pa.array(texts), Off())
    flipped = (with_ >= toxicity.THRESHOLD) & (without < toxicity.THRESHOLD)
    assert flipped.sum() >= 20 and flipped.sum() >= 0.8 * (without < toxicity.THRESHOLD).sum()
    assert not (with_ < without - 1e-12).any()


PLAIN = [
    "write to user@mail.com or o.k@x1.co.uk", "in the 1990s", "the 4th of May", "page 3a of 12", "www.x0rg.org/l33t", "see https://a1b2.com/i00?q=1", "MP3 and x86 on A4", "lines 12-15", "b12", "100km or 5pm", "Item 7b, 2nd floor", "10.0.0.1", "+49 30 1234567", "4111 1111 1111 1111",
]


@pytest.mark.parametrize("text", PLAIN)
def test_plain_text_stays(channel, text):
    assert channel.restore(text) == text


def test_the_gate_misses_nothing_that_the_decoder_changes(channel):
    from millrace.llm._text import slices

    texts = [*PLAIN, *(f"x {d} y" for w in ("trash", "idiot", "bad", "it") for d in disguises(w + "x")), "b a d", "1 2 3", "a b", "i.d.i", "€uro", "a_b_c"]
    flags = [bool(f) for part in slices(pa.array(texts, pa.large_string())) for f in toxicity.disguised(part)]
    assert all(flag or channel.restore(t) == t for flag, t in zip(flags, texts, strict=True))
