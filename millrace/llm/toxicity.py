"""Toxicity: noisy-channel deobfuscation, then a lexicon score of the restored text.

Where a text holds words that look disguised (leet characters inside a word, a letter three times or more in a row,
letters set apart one by one), a Viterbi search decodes the lattice of what was meant: a character stands for itself or
for a letter it looks like, a repeated letter or a mark between letters may be left out, a gap between single letters
may be left out or end a word. Paths are weighed by the channel and by a character language model (Witten-Bell
interpolation of orders 1 to ORDER, counted over all documents: a to z with and without accents, digits as one symbol and
all other letters as one, so that the n-grams are fewer than 30**ORDER however much text there is, and none is left out). The best path takes the word's
place where it is likelier, with the prior chance DISGUISED, than the word as written. Addresses, numbers with a short suffix and short
names with a number (4th, 1990s, MP3) are never decoded. The restored text is scored with word beginnings that the labelled sample shows to be significantly more common in toxic texts than
chance allows.

Defined results: null and empty texts score the floor and are predicted 0. Texts of any length are scored whole.
Repeated rows score alike; copies in the sample count once for each different context. Without toxic labels every
text scores the floor. labels, lang, source and ids are never inputs of a score.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._blocks import distinct
from ._jobs import discard, fold, labelled_sample, released, small_batches, table
from ._text import _BASE, BYTE_FOLDED, Slice, mix, prefix_sums, slices, span_hash

#: Documented bound on the labelled rows that the lexicon is fitted on.
TRAIN_ROWS = 12_000
THRESHOLD = 0.5
FLOOR = 0.02
#: Share of toxic texts among the labelled texts that hold a word beginning, from which it counts as toxic.
PURE = 0.97
ORDER = 4
#: What a character of a disguised word may stand for, besides itself.
LEET = {
    "0": "ou", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "li", "+": "t", "€": "e", "£": "l", "¡": "i", "(": "c", "<": "c",
}
#: The channel. Chance that a word that looks so is disguised at all; log probabilities then of a letter for itself, a stand-in, a
#: letter left out of a run of three or more or of a pair, a mark left out, a stand-in left out, a gap left out or ending a word.
DISGUISED = 0.01
#: Digits that end a word seldom stand for letters.
SAME, STANDS, ENDS, REPEATED, DOUBLED, MARK, IDLE, CLOSED, OPEN = (math.log(p) for p in (0.9, 0.3, 0.01, 0.5, 0.02, 0.5, 0.01, 0.7, 0.3))
#: Log probability of one digit among ten, and of one mark within a word as written.
#: Digits within words are never rarer than LEAST, also where the documents have none.
DIGIT, SYMBOL, LEAST = math.log(0.1), math.log(1e-4), 0.02
GAPS = " .-_*"
#: Symbols that a character may be, for the shortest histories.
SYMBOLS = 500

_LETTER = np.zeros(256, dtype=bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True
#: Bytes of words with stand-ins, and those that may end a word after a letter.
_STAND = np.zeros(256, dtype=bool)
_STAND[[ord(c) for c in LEET if ord(c) < 128]] = _STAND[0x30:0x3A] = True
_TAIL = np.zeros(256, dtype=bool)
_TAIL[[ord(c) for c in "0123456789@$"]] = True
_WIDE_STANDS = [np.frombuffer(c.encode(), dtype=np.uint8) for c in LEET if ord(c) >= 128]
_NAME = _LETTER.copy()
_NAME[0x30:0x3A] = _NAME[ord("_")] = True
_GAP = np.zeros(256, dtype=bool)
_GAP[[ord(c) for c in " .-_*"]] = True
_SPACED = re.compile(r"(?<!\w)\w(?:[ ._*\-]\w){3,}(?!\w)")
#: Addresses of mail and web, which are never decoded.
_ADDRESS = re.compile(r"([\w.%+-]+@[\w-]+(?:\.[\w-]+)+|(?:https?://|www\.)[^\s<>\"]+)", re.I)
#: Numbers with a short suffix, and short names with a number, are plain: 4th, 1990s, 3a, MP3, x86.
_NUMBERED = re.compile(r"\d+(?:[.,]\d+)*[^\W\d_]{1,3}|[^\W\d_]{1,3}\d+")
_WORD = re.compile(r"[\w@$!|+€£¡(<]+")
_ALPHA = re.compile(r"[^\W\d_]")
_REPEAT = re.compile(r"([^\W\d_])\1\1")
_INNER = re.compile(r"[0-9@$!|+€£¡(<](?=.*[^\W\d_])|[^\W\d_][0-9@$]{1,2}$")


def _class(c: str) -> str:
    """Symbol of a character in the model: a to z, # for digits, * for all other letters."""
    if "a" <= c <= "z":
        return c
    if c.isdigit():
        return "#"
    base = unicodedata.normalize("NFKD", c)[:1].lower()
    return base if "a" <= base <= "z" else "*"


#: The model's symbols by number: 0 lies between words, which begin with ^ and end with $.
_SYMBOLS = "\0^$#*abcdefghijklmnopqrstuvwxyz"
_NUMBER = {c: k for k, c in enumerate(_SYMBOLS)}


@dataclass
class Channel:
    """Viterbi decoder of disguised words; counts holds character n-grams of every order up to ORDER, of words between ^ and $."""

    counts: dict[str, int]
    known: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        self.total: Counter[str] = Counter()
        self.kinds: Counter[str] = Counter()
        for gram, n in self.counts.items():
            self.total[gram[:-1]] += n
            self.kinds[gram[:-1]] += 1
        self.logs: dict[str, float] = {}

    def chance(self, gram: str) -> float:
        """Probability of the n-gram's last character after the others."""
        lower = self.chance(gram[1:]) if len(gram) > 1 else 1 / SYMBOLS
        total = self.total.get(gram[:-1], 0)
        if not total:
            return lower
        kinds = self.kinds[gram[:-1]]
        return (self.counts.get(gram, 0) + kinds * lower) / (total + kinds)

    def next(self, past: str, c: str) -> float:
        gram = past + c
        got = self.logs.get(gram)
        if got is None:
            if len(self.logs) > 200_000:
                self.logs.clear()
            chance = self.chance(gram)
            self.logs[gram] = got = math.log(max(chance, LEAST) if c == "#" else chance)
        return got

    def as_written(self, word: str) -> float:
        past, cost = "^", math.log(1 - DISGUISED)
        for c in word:
            if c in GAPS:
                cost += self.next(past, "$")
                past = "^"
            elif c.isalnum():
                cost += self.next(past, _class(c)) + (DIGIT if c.isdigit() else 0.0)
                past = (past + _class(c))[-(ORDER - 1) :]
            else:
                cost += SYMBOL
        return cost + self.next(past, "$")

    def lattice(self, word: str) -> Iterator[list[tuple[str, float]]]:
        """For each character what may have been meant and its cost: a character, "" (left out), or a space (the end of a word)."""
        runs = [len(m[0]) for m in re.finditer(r"(.)\1*", word, re.S) for _ in m[0]]
        before, tail = "", len(word.rstrip("0123456789"))
        for k, (c, run) in enumerate(zip(word, runs, strict=True)):
            if c in GAPS:
                options = [("", CLOSED), (" ", OPEN)]
            else:
                options = [(x, STANDS if k < tail else ENDS) for x in LEET.get(c, "")]
                if c.isalpha():
                    options.append((c, SAME))
                elif c.isdigit():
                    options.append((c, DIGIT))
                else:
                    options.append(("", IDLE if c in LEET else MARK))
                if c == before:
                    options.append(("", REPEATED if run > 2 or not c.isalpha() else DOUBLED))
            yield options
            before = c

    def best(self, word: str) -> tuple[float, str]:
        """The likeliest path and its cost: a dynamic programme over the last characters meant, linear in the word's length."""
        states: dict[str, tuple[float, tuple | None]] = {"^": (math.log(DISGUISED), None)}
        for options in self.lattice(word):
            new: dict[str, tuple[float, tuple | None]] = {}
            for past, (cost, path) in states.items():
                for x, p in options:
                    if x == "":
                        key, total, step = past, cost + p, path
                    elif x == " ":
                        key, total, step = "^", cost + p + self.next(past, "$"), (" ", path)
                    else:
                        own = _class(x)
                        key, total, step = (past + own)[-(ORDER - 1) :], cost + p + self.next(past, own), (x, path)
                    if total > new.get(key, (-math.inf,))[0]:
                        new[key] = (total, step)
            states = new
        cost, path = max(((v[0] + self.next(k, "$"), v[1]) for k, v in states.items()), key=lambda x: x[0])
        letters = []
        while path:
            letters.append(path[0])
            path = path[1]
        return cost, "".join(reversed(letters))

    def decode(self, word: str) -> str:
        """The likeliest plain words behind ``word`` (lower case), or itself where it is likelier as written."""
        if (found := self.known.get(word)) is not None:
            return found
        cost, out = self.best(word)
        out = out if out and cost > self.as_written(word) else word
        if len(self.known) > 50_000:
            self.known.clear()
        self.known[word] = out
        return out

    def restore(self, text: str) -> str:
        """The text with disguised words decoded; addresses and numbers with a suffix stay as they are."""
        if "@" not in text and "://" not in text and "www." not in text.lower():
            return self._restore(text)
        return "".join(x if k % 2 else self._restore(x) for k, x in enumerate(_ADDRESS.split(text)))

    def _restore(self, text: str) -> str:
        text = _SPACED.sub(lambda m: self._kept(m[0]) if _ALPHA.search(m[0]) else m[0], text)

        def one(m: re.Match) -> str:
            word = m[0]
            looks = (_REPEAT.search(word) and len(set(word.lower())) > 1) or _INNER.search(word)
            return self._kept(word) if looks and not _NUMBERED.fullmatch(word) else word

        return _WORD.sub(one, text)

    def _kept(self, word: str) -> str:
        low = word.lower()
        out = self.decode(low)
        return word if out == low else out


def disguised(part: Slice) -> np.ndarray:
    """Which documents may hold what ``Channel.restore`` decodes: a test over bytes that misses none; the decoder makes it exact."""
    d = part.data
    letter, stand = _LETTER[d], _STAND[d]
    flag = np.zeros(len(d), dtype=bool)
    at = np.arange(len(d), dtype=np.int32)
    wide = d >= 0x80
    some_wide = wide.any()
    for code in _WIDE_STANDS if some_wide else ():
        end = len(d) - len(code) + 1
        found = np.ones(max(end, 0), dtype=bool)
        for k, x in enumerate(code):
            found &= d[k : end + k] == x
        stand[np.flatnonzero(found) + len(code) - 1] = True
    # a stand-in with a letter after it in the same word; a digit, @ or $ right after a letter
    outside = np.maximum.accumulate(np.where(letter | stand | _NAME[d], -1, at))
    last = np.maximum.accumulate(np.where(stand, at, -1))
    flag[1:] |= letter[1:] & (last[:-1] > outside[1:])
    flag[1:] |= letter[:-1] & _TAIL[d[1:]]
    # the same letter of one to four bytes three times over
    for size in (1, 2, 3, 4) if some_wide else (1,):
        if len(d) < 3 * size:
            break
        own = (wide if size > 1 else letter & ~wide)[size:]
        same = np.append(0, np.cumsum((d[size:] == d[:-size]) & own, dtype=np.int32))
        flag[: len(d) - 3 * size + 1] |= same[2 * size :] - same[: -2 * size] == 2 * size
    # four single letters set apart, character by character; ASCII names around them, in the same document, rule it out
    lead = np.flatnonzero((d & 0xC0) != 0x80)
    name, gap, plain = _NAME[d[lead]], _GAP[d[lead]], _NAME[d[lead]] & (d[lead] < 0x80)
    n = len(lead) - 6
    if n > 0:
        apart = name[:n].copy()
        for k in range(1, 7):
            apart &= (gap if k % 2 else name)[k : n + k]
        before, after = np.append(False, plain[:-1]), np.append(plain[1:], False)
        first, last = np.searchsorted(lead, part.starts), np.searchsorted(lead, part.ends) - 1
        before[first[first < len(lead)]] = False
        after[last[last >= 0]] = False
        apart &= ~before[:n]
        # a longer row of letters goes on with a gap; its end is looked at where it is
        apart &= ~after[6 : n + 6]
        flag[lead[:n][apart]] = True
    total = np.append(0, np.cumsum(flag, dtype=np.int32))
    return total[part.ends] > total[part.starts]


def restored(column: pa.Array, channel: Channel) -> pa.Array:
    """The column with disguised words decoded; texts without any keep their bytes."""
    column = column.cast(pa.large_string()).fill_null("")
    found = [disguised(part) for part in slices(column)]
    mask = pa.array(np.concatenate(found) if found else np.zeros(0, dtype=bool))
    texts = [channel.restore(t) for t in column.filter(mask).to_pylist()]
    return pc.replace_with_mask(column, mask, pa.array(texts, pa.large_string()))


# -- lexicon over word beginnings ------------------------------------------------------------------------------------

PREFIXES = (4, 5, 6, 7)


def beginnings(part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes (one row for each kind: beginnings by length, then whole words) of every word; 0 where a word is too short.

    Also the hash of the six bytes before each word, and the documents' bounds.
    """
    start, end, bounds = part.tokens(_LETTER)
    sums = prefix_sums(BYTE_FOLDED[part.data], _BASE)
    out = np.zeros((len(PREFIXES) + 1, len(start)), dtype=np.uint64)
    for k, n in enumerate(PREFIXES):
        ok = end - start >= n
        out[k, ok] = span_hash(sums, start[ok], start[ok] + n, _BASE)
    ok = end - start >= 3
    out[-1, ok] = mix(span_hash(sums, start[ok], end[ok], _BASE) + np.uint64(1))
    return out, span_hash(sums, np.maximum(start - 6, 0), start, _BASE), bounds


@dataclass
class ToxicityModel:
    counts: dict[str, int]
    grams: np.ndarray  # sorted hashes
    strength: np.ndarray

    def scores(self, column: pa.Array, channel: Channel) -> np.ndarray:
        parts = []
        maybe = np.zeros(1 << 20, dtype=bool)
        maybe[(self.grams >> np.uint64(44)).astype(np.int64)] = True
        for part in slices(restored(column, channel)):
            hashes, _, bounds = beginnings(part)
            safe = np.full(part.n, 0.0)
            if len(self.grams):
                kind, word = np.nonzero(maybe[(hashes >> np.uint64(44)).astype(np.int64)])
                own = hashes[kind, word]
                at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
                hit = self.grams[at] == own
                best = np.zeros(hashes.shape[1])
                np.maximum.at(best, word[hit], self.strength[at[hit]])
                some = np.flatnonzero(best)
                np.add.at(safe, np.searchsorted(bounds, some, side="right") - 1, np.log1p(-best[some]))
            parts.append(1 - (1 - FLOOR) * np.exp(safe))
        return np.concatenate(parts) if parts else np.zeros(0)


def _log_tail(a: np.ndarray, b: np.ndarray, rate: float) -> np.ndarray:
    """Upper bound (Chernoff) on the log chance of a or more out of a + b at this rate."""
    share = a / (a + b)
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = share * np.log(share / rate) + np.where(share < 1, (1 - share) * np.log((1 - share) / (1 - rate)), 0.0)
    return np.where(share > rate, -(a + b) * kl, 0.0)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 5, held_out: int = 0, rows: int = TRAIN_ROWS) -> ToxicityModel:
    """Language model from all documents; lexicon from at most ``rows`` labelled rows outside the held-out fold (a bounded sample)."""
    sample = labelled_sample(docs, labels, label, modulus, held_out, rows)
    counts = sample.groupBy().agg(F.count_if(F.col("label") == 1).alias("a"), F.count("*").alias("n")).first()
    grams = small_batches(docs).select("text").mapInArrow(released(_character_grams), "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    letters = dict(zip(grams["gram"], grams["n"].tolist(), strict=True))
    shared = sample.sparkSession.sparkContext.broadcast(letters)

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        channel = Channel(shared.value)
        for batch in batches:
            for part in slices(restored(batch.column("text"), channel)):
                hashes, before, bounds = beginnings(part)
                doc = np.tile(np.searchsorted(bounds, np.arange(len(before)), side="right"), len(hashes)).astype(np.uint64)
                g = hashes.ravel()
                # once for each document, with the context of its first place there: copies share it
                _, first = np.unique(mix(g + doc * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
                first = first[g[first] > 0]
                pairs = np.unique(np.stack([g[first], np.tile(before, len(hashes))[first]]), axis=1)
                yield pa.record_batch([pa.array(pairs[0].astype(np.int64)), pa.array(pairs[1].astype(np.int64))], names=["g", "c"])

    toxic = (
        sample.where("label = 1").select("text").mapInArrow(contexts, "g bigint, c bigint")
        .groupBy("g").agg(F.count_distinct("c").alias("a")).where("a >= 3").toPandas()
    )
    hashes = toxic["g"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(hashes)
    hashes, a = hashes[order], toxic["a"].to_numpy(dtype=np.float64)[order]
    if not len(hashes):
        discard(sample)
        return ToxicityModel(letters, np.zeros(0, dtype=np.uint64), np.zeros(0))
    known = sample.sparkSession.sparkContext.broadcast(hashes)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        channel, total = Channel(shared.value), np.zeros(len(known.value), dtype=np.int64)
        for batch in batches:
            for part in slices(restored(batch.column("text"), channel)):
                own = beginnings(part)
                doc = np.searchsorted(own[2], np.arange(own[0].shape[1]), side="right") - 1
                for g in own[0]:
                    at = np.minimum(np.searchsorted(known.value, g), len(total) - 1)
                    hit = known.value[at] == g
                    one = distinct(at[hit] * part.n + doc[hit]) // part.n  # once for each document
                    total += np.bincount(one, minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], names=["k", "b"])

    seen = sample.where("label = 0").select("text").mapInArrow(clean, "k bigint, b bigint").groupBy("k").agg(F.sum("b").alias("b")).toPandas()
    b = np.zeros(len(hashes))
    b[seen["k"].to_numpy(dtype=np.int64)] = seen["b"].to_numpy(dtype=np.float64)
    discard(sample)
    rate = max(counts["a"], 1) / max(counts["n"], 1)
    tail = _log_tail(a, b, rate)
    share = a / (a + b + 1)
    sure = (tail + math.log(len(a)) < math.log(0.05)) & (a >= PURE * (a + b))
    hint = (tail < math.log(0.01)) & (share > 0.5) & ~sure
    strength = np.where(sure, share, np.where(hint, 0.15, 0.0))
    return ToxicityModel(letters, hashes[strength > 0], strength[strength > 0])


def _numbers(points: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Symbol numbers of code points, by a table of the process that is filled as characters come (255: not seen yet)."""
    found = known[points]
    if (found == 255).any():
        for p in np.unique(points[found == 255]).tolist():
            c = chr(p)
            known[p] = _NUMBER[_class(c)] if c.isalnum() else 0
        found = known[points]
    return found


def _character_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, n): every n-gram of words (letters and digits, with one letter at least) of the texts in lower case."""
    size = len(_SYMBOLS)
    total = [np.zeros(size**k, dtype=np.int64) for k in range(1, ORDER + 1)]
    known = np.full(0x110000, 255, dtype=np.uint8)
    for batch in batches:
        for part in slices(batch.column("text")):
            points = np.frombuffer(part.data.tobytes().decode().lower().encode("utf-32-le"), dtype=np.uint32)
            x = np.concatenate([[0], _numbers(points, known), [0]]).astype(np.uint8)
            edge = np.flatnonzero(np.diff((x > 0).view(np.int8)))
            start, end = edge[0::2] + 1, edge[1::2] + 1
            letters = np.append(0, np.cumsum(x > _NUMBER["#"], dtype=np.int32))
            some = letters[end] > letters[start]
            start, length = start[some], (end - start)[some]
            # the words one after another, each between ^ and $
            to = np.cumsum(length + 2) - length - 2
            own = np.full(int((length + 2).sum()), 0, dtype=np.int64)
            at = np.arange(int(length.sum())) + np.repeat(start - (np.cumsum(length) - length), length)
            inner = np.ones(len(own), dtype=bool)
            inner[to] = inner[to + length + 1] = False
            own[inner] = x[at]
            own[to], own[to + length + 1] = _NUMBER["^"], _NUMBER["$"]
            ends = own == _NUMBER["$"]
            code, whole = own, np.ones(len(own), dtype=bool)  # whole: the n-gram lies within one word
            total[0] += np.bincount(code[own != _NUMBER["^"]], minlength=size)
            for k in range(2, ORDER + 1):
                code, whole = code[:-1] * size + own[k - 1 :], whole[:-1] & ~ends[k - 2 : len(own) - 1]
                total[k - 1] += np.bincount(code[whole], minlength=size**k)
    grams, numbers = [], []
    for k, counts in enumerate(total, 1):
        some = np.flatnonzero(counts)
        grams += ["".join(_SYMBOLS[d] for d in row) for row in np.stack([some // size**i % size for i in range(k - 1, -1, -1)], axis=1).tolist()]
        numbers.append(counts[some])
    yield pa.record_batch([pa.array(grams, pa.string()), pa.array(np.concatenate(numbers))], names=["gram", "n"])


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score) of every row of ``docs``, in one scan."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        channel = Channel(shared.value.counts)
        for batch in batches:
            yield pa.record_batch([batch.column("doc_id"), pa.array(shared.value.scores(batch.column("text"), channel))], names=["doc_id", "score"])

    return small_batches(docs).select("doc_id", "text").mapInArrow(released(run), "doc_id bigint, score double")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
