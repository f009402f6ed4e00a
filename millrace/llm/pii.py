"""Personal data: patterns for the protected entities, and information-theoretic sanitisation of the terms that reveal them.

DataFrame functions only. Four kinds of entity are found by pattern. For each entity c and each term t of the documents that
hold it, the corpus gives the pointwise mutual information PMI(c; t) = log2(p(c, t) / (p(c) p(t))); a term that only ever comes with
the entity reaches IC(c) = -log2 p(c), the entity's own information. The share PMI / IC is the term's disclosure. In the documents
that hold c, terms whose disclosure reaches ``GENERALISE`` are generalised, those that reach ``REMOVE`` removed.

p(c), p(c, t) and p(t) are shares of the different texts, so copies of one text are no evidence. A term needs ``SUPPORT``
different texts together with the entity, however many there are, which must also have that many different least hashes of
three words in a row: near copies share that hash as often as they share such threes. Either of two hash functions will do.
So an entity that stands in fewer different texts discloses nothing by its terms.

Texts stay where they are: only the words of texts with entities are shuffled, then the places of the terms that are
candidates, and the hashes of all texts. Entities and terms are paired only where both stand in ``SUPPORT`` texts with entities. The few
documents with disclosing terms are broadcast to the scan that marks them while they are small (``BROADCAST_BYTES``).

Defined results: null texts are empty. Texts of any length are handled whole. Repeated rows count as rows and give
equal results. Base spans are never changed by what the method adds; added spans lie outside them. Other columns stay.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._jobs import table, written

KINDS = ("email", "ip", "card", "phone", "term", "general")
TAGS = tuple("" if k == "term" else f"[{k.upper()}]" for k in KINDS)
GENERALISE, REMOVE = 0.85, 0.95
SUPPORT = 3
#: Bytes (as JSON) of terms, entities, copies or added spans that are broadcast at most; more are joined by a shuffle.
BROADCAST_BYTES = 32 << 20
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The contract's patterns, in forms that never search a run of characters twice: a match can begin only where a run
#: begins or the match before ended, and what cannot give back characters does not try to.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_TERM = "[^0-9]"
_BLOCK = 128


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, evaluated once for each row however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0), lambda s, v: s + v)


def _most(x: Column) -> Column:
    return F.coalesce(F.array_max(x), F.lit(0))


def running(widths: Column, total: Callable[[Column], Column] = _total, both: Callable[[Column, Column], Column] = lambda a, b: a + b) -> Column:
    """Running totals (or maxima) of an array, by blocks so that long arrays cost little more than their length."""
    whole = lambda i: F.floor(i / _BLOCK).cast("int")

    def blocked(w: Column) -> Column:
        n = whole(F.size(w) + (_BLOCK - 1))
        sums = F.transform(F.sequence(F.lit(0), n - 1), lambda b: total(F.slice(w, b * _BLOCK + 1, F.lit(_BLOCK))))
        before = lambda s: F.transform(F.sequence(F.lit(0), n - 1), lambda b: total(F.slice(s, F.lit(1), b)))
        return let(sums, lambda s: let(before(s), lambda p: F.transform(w, lambda _, i: both(F.get(p, whole(i)), total(F.slice(w, whole(i) * _BLOCK + 1, i % _BLOCK + 1))))))

    return let(widths, lambda w: F.when(F.size(w) > 0, blocked(w)).otherwise(F.array().cast("array<int>")))


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of the leftmost non-overlapping matches, in code points, end exclusive."""
    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("p"))

    def placed(x: Column) -> Column:
        m, p = x["m"], x["p"]
        ends = running(F.zip_with(F.slice(p, F.lit(1), F.size(m)), m, lambda a, b: F.length(a) + F.length(b)))

        def one(e: Column) -> Column:
            return F.transform(m, lambda v, i: F.struct((F.get(e, i) - F.length(v)).alias("start"), F.get(e, i).alias("end"), v.alias("value")))

        return let(ends, one)

    return let(found, placed)


def _valid(kind: str, v: Column) -> Column:
    digits = F.regexp_replace(v, "[^0-9]", "")
    if kind == "ip":
        return v.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def entity(kind: str, v: Column) -> Column:
    """The protected entity behind a match: the same address or number however it is written."""
    return F.concat(F.lit(kind + ":"), F.lower(v) if kind in ("email", "ip") else F.regexp_replace(v, "[^0-9]", ""))


def base_spans(text: Column) -> Column:
    """array<struct<start, kind, end, value>>, sorted by start, then kind (number in KINDS)."""
    maybe = {
        "email": (EMAIL, F.contains(text, F.lit("@"))),
        "ip": (IP, text.rlike(r"[0-9]\.[0-9]")),
        "card": (CARD, text.rlike(r"[0-9](?:[ -]?[0-9]){11}")),
        "phone": (PHONE, F.contains(text, F.lit("+"))),
    }
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    parts = []
    for k, (kind, (pattern, guard)) in enumerate(maybe.items()):
        good = F.filter(matches(text, pattern), lambda x: _valid(kind, x["value"]))  # noqa: B023
        spans = F.transform(good, lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), x["end"].alias("end"), entity(kind, x["value"]).alias("value")))
        parts.append(F.when(guard, spans).otherwise(none))
    return F.array_sort(F.concat(*parts))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def _keys(docs: DataFrame) -> DataFrame:
    """``docs`` with text never null and two columns that tell its rows apart by content."""
    return docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("__id", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63)))).withColumn("__h", F.xxhash64("text"))


def _likeness(text: Column) -> Column:
    """Two least hashes of three words in a row: the same for copies, and for two texts as often as they share such threes."""
    least = lambda w, k: F.array_min(F.transform(w, lambda t, i: F.xxhash64(F.lit(k), t, F.get(w, i + 1), F.get(w, i + 2))))
    return let(words(text), lambda w: F.struct(least(w, 0).alias("a"), least(w, 1).alias("b")))


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, __id, __h, spans, entities) of every row: base spans without their values, and the entities. Written."""
    found = _keys(docs.select("doc_id", "text")).select("doc_id", "__id", "__h", base_spans(F.col("text")).alias("b"))
    return written(
        found.select(
            "doc_id", "__id", "__h", F.transform("b", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))).alias("spans"),
            F.array_distinct(F.transform("b", lambda x: x["value"])).alias("entities"),
        )
    )


def _terms(text: Column, base: Column) -> Column:
    """Different terms of a text outside its base spans: words that are no mere numbers."""
    outside = F.when(F.size(base) == 0, text).otherwise(rewritten(text, base, [" "] * len(KINDS)))
    return F.filter(F.array_distinct(words(outside)), lambda t: t.rlike(_TERM))


def entity_texts(docs: DataFrame) -> DataFrame:
    """(__h, like, terms, entities) of the different texts that hold entities. Written."""
    rows = _keys(docs.select("doc_id", "text")).select("__h", "text", base_spans(F.col("text")).alias("b")).where(F.size("b") > 0)
    entities = F.array_distinct(F.transform("b", lambda x: x["value"]))
    found = rows.select("__h", F.struct(_likeness(F.col("text")).alias("like"), _terms(F.col("text"), F.col("b")).alias("terms"), entities.alias("entities")).alias("x"))
    return written(found.groupBy("__h").agg(F.first("x").alias("x")).select("__h", "x.*"))


def _small(rows: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    size = rows.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))).cast("bigint"))).first()[0] or 0
    return F.broadcast(rows) if size <= most else rows


def _frequencies(docs: DataFrame, terms: DataFrame, copies: DataFrame) -> DataFrame:
    """(t, n_t): in how many different texts each of ``terms`` stands; a text in m copies counts 1 / m in each."""
    rows = _keys(docs.select("doc_id", "text")).select("__h", F.explode(_terms(F.col("text"), base_spans(F.col("text")))).alias("t"))
    return rows.join(_small(terms), "t").join(_small(copies), "__h", "left").groupBy("t").agg(F.round(F.sum(1 / F.coalesce("m", F.lit(1)))).cast("bigint").alias("n_t"))


def disclosing(docs: DataFrame) -> DataFrame | None:
    """(c, t, share): terms that reveal an entity, with the share of the entity's information they give away. Written; None without any."""
    seen = entity_texts(docs)
    texts = written(_keys(docs.select("doc_id", "text")).groupBy("__h").agg(F.count("*").alias("m")))
    n = texts.count()
    entities = written(seen.select(F.explode("entities").alias("c")).groupBy("c").agg(F.count("*").alias("n_c")).where(F.col("n_c") >= SUPPORT))
    held = seen.select("__h", "like", F.explode("entities").alias("c")).join(_small(entities), "c")
    stood = seen.join(held.select("__h").distinct(), "__h", "left_semi").select("__h", F.explode("terms").alias("t"))
    common = written(stood.groupBy("t").agg(F.count("*").alias("n")).where(F.col("n") >= SUPPORT).select("t"))
    pairs = held.join(stood.join(_small(common), "t"), "__h").select("c", "n_c", "like", "t")
    often = written(pairs.groupBy("c", "t").agg(F.first("n_c").alias("n_c"), F.count("*").alias("n_ct")).where(F.col("n_ct") >= SUPPORT))
    if often.isEmpty():
        return None
    rare = _frequencies(docs, often.select("t").distinct(), texts.where("m > 1"))
    share = 1 + F.log2(F.least(F.lit(1.0), F.col("n_ct") / F.col("n_t"))) / F.log2(F.lit(n + 1) / F.col("n_c"))
    likely = written(often.join(rare, "t").select("c", "t", share.alias("share")).where(F.col("share") >= GENERALISE))
    unlike = pairs.join(_small(likely), ["c", "t"]).groupBy("c", "t", "share").agg(F.count_distinct("like.a").alias("a"), F.count_distinct("like.b").alias("b"))
    found = written(unlike.where(F.greatest("a", "b") >= SUPPORT).select("c", "t", "share"))
    return None if found.isEmpty() else found


def added(docs: DataFrame, found: DataFrame, reveal: DataFrame) -> DataFrame:
    """(__id, __h, more): spans of disclosing terms in the documents that hold their entity, outside the base spans. Written."""
    mine = found.where(F.size("entities") > 0).select("__id", "__h", "spans", F.explode("entities").alias("c")).join(reveal, "c")
    mine = written(mine.groupBy("__id", "__h").agg(F.first("spans").alias("spans"), F.collect_set(F.when(F.col("share") >= REMOVE, F.col("t"))).alias("drop"), F.collect_set("t").alias("t")))
    rows = _keys(docs.select("doc_id", "text")).select("__id", "__h", "text").join(_small(mine), ["__id", "__h"])
    hits = F.filter(
        matches(F.col("text"), WORD),
        lambda x: F.array_contains("t", F.lower(x["value"])) & ~F.exists("spans", lambda s: (s["start"] < x["end"]) & (s["end"] > x["start"])),
    )
    spans = F.transform(hits, lambda x: F.struct(x["start"].alias("start"), F.when(F.array_contains("drop", F.lower(x["value"])), F.lit(4)).otherwise(F.lit(5)).alias("kind"), x["end"].alias("end")))
    return written(rows.select("__id", "__h", spans.alias("more")).dropDuplicates(["__id", "__h"]))


_NONE = "array<struct<start:int,kind:int,end:int>>"


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, __id, __h, spans, more) of every row of ``docs`` (doc_id, text): base spans, and those that the method adds."""
    found = find(docs)
    reveal = disclosing(docs)
    out = found.select("doc_id", "__id", "__h", "spans")
    none = F.array().cast(_NONE)
    if reveal is None:
        return out.withColumn("more", none)
    return out.join(added(docs, found, reveal), ["__id", "__h"], "left").withColumn("more", F.coalesce("more", none))


def named(x: Column) -> Column:
    """kind:start:end of every span, joined by commas."""
    kind = lambda s: F.get(F.array(*map(F.lit, KINDS)), s["kind"])
    return F.array_join(F.transform(x, lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def rewritten(text: Column, all_spans: Column, by: Sequence[str] = TAGS) -> Column:
    """The text with every span replaced by its tag (removed terms by nothing); overlapping spans are replaced in order of their starts."""
    tags = F.array(*map(F.lit, by))

    def cut(x: Column) -> Column:
        chunks, own = x["chunks"], x["own"]

        def between(a: Column, b: Column) -> Column:
            one, two = F.floor(a / 64).cast("int"), F.floor((b - 1) / 64).cast("int")
            return F.when(b > a, F.substring(F.array_join(F.slice(chunks, one + 1, two - one + 1), ""), a % 64 + 1, b - a)).otherwise(F.lit(""))

        def joined(upto: Column) -> Column:
            """Pieces between the spans, each from the furthest end before it, with the spans' tags."""
            before = F.concat(F.array(F.lit(0)), F.slice(upto, F.lit(1), F.size(upto) - 1))
            pieces = F.zip_with(own, before, lambda s, at: F.concat(between(at, s["start"]), F.get(tags, s["kind"])))
            return F.concat(F.array_join(pieces, ""), between(F.element_at(upto, -1), F.length(text)))

        return let(running(F.transform(own, lambda s: s["end"]), _most, F.greatest), joined)

    parts = F.struct(F.regexp_extract_all(text, F.lit("(?s).{1,64}"), F.lit(0)).alias("chunks"), all_spans.alias("own"))
    return F.when(F.size(all_spans) == 0, text).otherwise(let(parts, cut))


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with sanitised texts; null texts stay null, all other columns are kept, whatever their names."""
    text = F.coalesce("text", F.lit(""))
    bare = lambda b: F.transform(b, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63))).alias("__id"), F.xxhash64(text).alias("__h"), F.col("text"), bare(base_spans(text)).alias("spans"))
    reveal = disclosing(docs)
    if reveal is None:
        rows = rows.withColumn("more", F.array().cast(_NONE))
    else:
        rows = rows.join(_small(added(docs, find(docs), reveal)), ["__id", "__h"], "left")
    own = F.array_sort(F.concat("spans", F.coalesce("more", F.array().cast(_NONE))))
    new = rows.select("row", F.when(F.size(own) > 0, rewritten(F.col("text"), own)).otherwise(F.col("text")).alias("new"))
    return new.select(*(F.col("new").alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint"), "text")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("bigint")
    return spans(docs).select(
        "doc_id", *(count(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:4])), F.sha2(named(F.col("spans")), 256).alias("base_sha256"),
        named(F.array_sort(F.concat("spans", "more"))).alias("spans"),
    )
