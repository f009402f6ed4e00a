"""Mixing sources to target weights by weighted fair queueing.

Sources share a budget of words by weight; a source's target stops at ``most`` times its size, and what it leaves is shared again among the others
until no target is above its bound. Each source's documents are shuffled (by a digest of id and text, so reruns agree) and queued, the
whole queue once more for every repetition that the target asks for. A document's virtual finish time is the number of its source's words up to
its end, divided by the source's target: all sources reach 1 where their targets end. The one document of a source that runs over
this end is queued as two pieces, so that a long document does not shift its source's share. All entries are then range-sorted by virtual
finish time, and the mix ends where the budget does; the piece at the end gives its first words only. So each source takes its
target, rounded down, and at most as many words more as there are sources; nothing is taken more often than ``most`` times.

Only narrow rows move (ids, sizes, digests; never texts), each running sum is one range exchange with the sums of its ranges as offsets,
and no key gathers its rows: a source with most of the documents lies over as many ranges as it needs.

Defined results: null texts have no words. Documents without words, and sources without any, take nothing; such a source's target is 0. Sources without
a name are one source, the last. Repeated rows are documents of their own. A budget above ``most`` times all words counts as that. No rows give none.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._jobs import table, written
from ._order import running

WEIGHTS, MOST = (1, 2, 3), 3
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of a table of sources that may be broadcast.
SMALL = 32 << 20
_WIDE = "decimal(38,0)"


def sizes(text: Column) -> Column:
    """Number of words; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sources: DataFrame, budget: int, most: int) -> DataFrame:
    """``sources`` (size, weight) with ``target``: the budget by weight, at most ``most`` times the size, the excess shared again until none is above."""
    bound, free, before = F.col("size") * most, F.col("size") > 0, None
    while True:
        weight, capped = sources.agg(F.sum(F.when(free, F.col("weight"))), F.sum(F.when(~free, bound))).first()
        rest = budget - (capped or 0)
        if not weight or weight == before:
            share = F.lit(rest).cast("double") * F.col("weight") / F.lit(weight or 1).cast("double")
            return sources.withColumn("target", F.when(free, share).otherwise(bound.cast("double")))
        # The level rest / weight only rises, so what was above it stays above it, and the last level tells who is free.
        free = (F.col("size") > 0) & (F.lit(rest).cast(_WIDE) * F.col("weight") <= bound.cast(_WIDE) * F.lit(weight))
        before = weight


def queued(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, share: float = 1.0) -> tuple[DataFrame, int]:
    """Documents (row, doc_id, size, source_size, target, rank, key, before) with the words of their source before them in its queue, and the budget."""
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), sizes(F.col("text")).alias("size"),
        F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit("")).cast("binary"))).cast("binary")).alias("key"),
    )
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()))
    named = rows.groupBy("source").agg(F.sum("size").alias("size")).withColumn("one", F.lit(1).cast("bigint"))
    named = running(named, [F.col("source").asc_nulls_last()], "one").select("source", "size", F.col("before").alias("rank"))
    weight = F.element_at(F.array(*(F.lit(int(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("bigint")
    named = running(named, [F.col("rank").asc()], "size").select("source", F.col("size"), "rank", F.col("before").alias("start"), weight.alias("weight"))
    named = written(named)
    whole = named.agg(F.sum("size")).first()[0] or 0
    budget = min(int(whole * share), whole * most)
    found = targets(named, budget, most).select(F.col("source").alias("__s"), F.col("size").alias("source_size"), "target", "rank", "start")
    heavy = named.agg(F.sum(F.coalesce(F.octet_length("source"), F.lit(0)) + 64)).first()[0] or 0
    joined = rows.join(F.broadcast(found) if heavy <= SMALL else found, F.col("source").eqNullSafe(F.col("__s")))
    placed = running(joined.drop("source", "__s"), [F.col(c).asc() for c in ("rank", "key", "doc_id", "size")], "size")
    return placed.withColumn("before", F.col("before") - F.col("start")).drop("start"), budget


def mixed(placed: DataFrame, budget: int, most: int = MOST) -> DataFrame:
    """The mix in order of virtual finish time: (row, doc_id, turn, skip, taken, finish, before), turn counting repetitions from 0.

    skip: words of the document before the piece; before: words of the mix before it.
    """
    turns = F.least(F.ceil(F.col("target") / F.col("source_size")), F.lit(most)).cast("int")
    entries = placed.where("size > 0 and target > 0").withColumn("turn", F.explode(F.sequence(F.lit(0), turns - 1)))
    entries = entries.withColumn("first", F.col("turn") * F.col("source_size") + F.col("before")).withColumn("last", F.col("first") + F.col("size"))
    goal = F.floor("target")
    piece = lambda a, b: F.struct(a.alias("begin"), b.alias("end"))
    first, last = F.col("first"), F.col("last")
    pieces = F.inline(F.when((first < goal) & (goal < last), F.array(piece(first, goal), piece(goal, last))).otherwise(F.array(piece(first, last))))
    entries = entries.select("row", "doc_id", "rank", "turn", "target", "first", pieces)
    entries = entries.select("row", "doc_id", "rank", "turn", "begin", (F.col("begin") - F.col("first")).alias("skip"), (F.col("end") - F.col("begin")).alias("words"), (F.col("end").cast("double") / F.col("target")).alias("finish"))
    found = running(entries, [F.col(c).asc() for c in ("finish", "rank", "begin")], "words").where(F.col("before") < budget)
    return found.select("row", "doc_id", "turn", "skip", F.least("words", F.lit(budget) - F.col("before")).alias("taken"), "finish", "before")


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, share: float = 1.0) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document of ``docs`` (doc_id, source, text)."""
    placed, budget = queued(docs, weights, most, share)
    placed = written(placed)
    taken = mixed(placed, budget, most).groupBy("row").agg(F.sum("taken").alias("taken"))
    return placed.join(taken, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS key FROM documents),
s AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) AS rank, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w
    FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source)),
t AS (SELECT CAST(sum(source_size) AS BIGINT) AS whole FROM s),
o AS (SELECT *, whole - coalesce(sum(3 * source_size) OVER (p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest, sum(w) OVER (p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws, row_number() OVER p AS place
    FROM s, t WHERE source_size > 0 WINDOW p AS (ORDER BY source_size / w, rank)),
f AS (SELECT place, rest, ws FROM o WHERE CAST(rest AS HUGEINT) * w <= CAST(3 * source_size AS HUGEINT) * ws ORDER BY place LIMIT 1),
g AS (SELECT s.*, CASE WHEN o.place >= f.place THEN CAST(f.rest AS DOUBLE) * s.w / CAST(f.ws AS DOUBLE) ELSE CAST(3 * s.source_size AS DOUBLE) END AS target FROM s LEFT JOIN o ON o.rank = s.rank LEFT JOIN f ON true),
q AS (SELECT d.*, source_size, target, rank, sum(size) OVER (PARTITION BY rank ORDER BY key, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
e AS (SELECT *, turn * source_size + upto - size AS first, turn * source_size + upto AS last, CAST(floor(target) AS BIGINT) AS goal
    FROM (SELECT *, unnest(range(CAST(least(ceil(target / source_size), 3) AS BIGINT))) AS turn FROM q WHERE size > 0 AND target > 0)),
p AS (SELECT r, rank, target, first AS a, CASE WHEN first < goal AND goal < last THEN goal ELSE last END AS b FROM e
    UNION ALL SELECT r, rank, target, goal, last FROM e WHERE first < goal AND goal < last),
m AS (SELECT r, b - a AS size, sum(b - a) OVER (ORDER BY CAST(b AS DOUBLE) / target, rank, a ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - (b - a) AS start FROM p),
k AS (SELECT r, sum(least(size, whole - start)) AS taken FROM m, t WHERE start < whole GROUP BY r)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM q LEFT JOIN k ON k.r = q.r
"""
