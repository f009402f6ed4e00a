"""N-gram Jaccard join: exact similarity join of shingle sets by indexed prefixes and set relations.

Every document becomes the set of its ``width``-word shingles; equal sets are one set. Shingles are ordered by how many
documents hold them, rarest first (exact counts over all documents, see ``_blocks``; shingles outside a fixed part of
the hash space are not counted and come last). Two sets that link share one of the first ``n - ceil(t * n) + 1`` of
either, so only those positions of a set enter the index, and only those that a second document may hold.

An index list (all sets with one shingle) is cut into blocks by set size, and its entries carry their positions. A link
of x and y (x not the larger) that meets at their first common shingle, at positions i and j, has
``min(n_x - i, n_y - j) >= t / (1 + t) * (n_x + n_y)``. So x stands at a shallow position, and blocks without a
shallow entry are skipped, as are entries too deep for the shallowest one of their block.

1. In each block one set leads (a shallow one), and every other entry is checked against it, word for word.
2. What the checks link makes components. A block whose other entries lie in one component is settled and skipped.
3. In the blocks left over one set leads again: the overlap of every other set with it is computed once, and the answer
   for two members follows from what each differs by from the leader, since |s ^ t| = |e_s| + |e_t| - 2 |e_s & e_t| for the
   differences e_s, e_t. Members of one component are skipped; sets far from the leader are led by another, and reach
   across only where the triangle inequality of the Jaccard distance allows a link.

Only checked links join sets, so components never grow by chance. A leader's entries, and blocks left over, are dealt out
in pieces of at most ``GROUP`` shingles. Sets are compared by 64-bit hashes of their shingles and named by 64 bits;
equal sets are told by 128 bits.

Defined results: null, empty and blank texts have the empty set and link with nothing; with fewer words than
``width`` the whole sequence is the one shingle. Repeated rows are equal sets. A row without doc_id takes the
component of the rows it equals or links with; a component without any doc_id has a null name. Empty tables give no
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._blocks import blocks, counted, gathered, opened, totals
from ._components import components, forest
from ._jobs import released, released_tables, table, written
from ._text import NON_SPACE, Slice, gram_hashes, mix, slices, word_hashes
from .embeddings import grouped

WIDTH = 5
#: Similarity from which sets link, as a fraction of whole numbers.
SIMILARITY = (80, 100)
#: Shingles of so large a share of the hash space come first in the order and are counted: this times (1 - similarity).
COUNTED = 2.5
#: Shingles of the sets that are compared in one piece (one larger set goes alone).
GROUP = 400_000
_D1, _D2 = np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0xABC98388FB8FAC03)
_SET = np.uint64(0x6A09E667F3BCC908)


def shingles(part: Slice, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The sets of a slice's documents, one after the other and each sorted, and where each begins."""
    words, _, _, bounds = word_hashes(part, NON_SPACE)
    n = np.diff(bounds)
    grams = gram_hashes(words, width)
    at = np.arange(len(grams))
    doc = np.searchsorted(bounds, at, side="right") - 1
    inside = at + width <= bounds[doc + 1] if len(at) else np.zeros(0, dtype=bool)
    value, owner = [grams[inside]], [doc[inside]]
    for length in range(1, width):
        few = np.flatnonzero(n == length)
        if len(few):
            value.append(gram_hashes(words, length)[bounds[few]])
            owner.append(few)
    v, d = np.concatenate(value), np.concatenate(owner)
    order = np.lexsort((v, d))
    v, d = v[order], d[order]
    new = np.ones(len(v), dtype=bool)
    new[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
    v, d = v[new], d[new]
    return v, np.searchsorted(d, np.arange(part.n + 1))


def _sets(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The sets of all rows of a block, and where each begins."""
    values, sizes = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
    for part in slices(table["text"]):
        v, b = shingles(part, width)
        values.append(v)
        sizes.append(np.diff(b))
    return np.concatenate(values), np.append(0, np.cumsum(np.concatenate(sizes)))


def _digests(v: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for salt in (_D1, _D2):
        sums = np.zeros(len(v) + 1, dtype=np.uint64)
        np.cumsum(mix(v ^ salt), out=sums[1:])
        out.append(mix(sums[bounds[1:]] - sums[bounds[:-1]] + salt).view(np.int64))
    return out[0], out[1]


def size_class(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """Class of a set's size; sizes of linked sets are in the same class or in neighbouring ones."""
    edges, top = [1], int(n.max(initial=1))
    while edges[-1] <= top:
        edges.append(max(edges[-1] + 1, edges[-1] * den // num + 1))
    return np.searchsorted(np.array(edges), n, side="right")


def _counted(v: np.ndarray, num: int, den: int) -> np.ndarray:
    return (v & np.uint64(0xFFFF)).astype(np.int64) * den < 65536 * COUNTED * (den - num)


def _keys(part: pa.Table, width: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one block: its sets and where each begins, their digests, which shingles are counted; and the keys to count: those, and the sets."""
    v, bounds = _sets(part, width)
    d1, d2 = _digests(v, bounds)
    asked = _counted(v, num, den)
    key, count = gathered([v[asked], mix(d1.view(np.uint64) + _SET)])
    return v, bounds, d1, d2, asked, key, count


FOUND = "doc_id bigint, h bigint, n bigint, d1 bigint, d2 bigint, token bigint, class int, guest boolean, place bigint, body string"
_FOUND = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("token", pa.int64()), ("class", pa.int32()), ("guest", pa.bool_()), ("place", pa.int64()), ("body", pa.string())])


def _made(rows: int, **columns) -> pa.Table:
    made = {k: x.cast(_FOUND.field(k).type) if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, _FOUND.field(k).type) for k, x in columns.items()}
    return pa.table([made[f.name] if f.name in made else pa.nulls(rows, f.type) for f in _FOUND], schema=_FOUND)


def _indexed(width: int, num: int, den: int):
    """Rows of a block: its documents (no token, no body); index entries of the sets it owns (token); and those sets' texts (body)."""

    def run(docs: pa.Table, back: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _made(0)
        docs = opened(docs)
        v, bounds, d1, d2, asked, key, _ = _keys(docs, width, num, den)
        n = np.diff(bounds)
        total, owned = totals(back)
        df = np.full(len(v), 1 << 40)  # uncounted shingles follow all others and always enter
        df[asked] = total[np.searchsorted(key, v[asked])]
        _, once = np.unique(d1, return_index=True)
        mine = np.zeros(len(n), dtype=bool)  # one document stands for all equal sets
        mine[once] = owned[np.searchsorted(key, mix(d1[once].view(np.uint64) + _SET))]
        owner = np.repeat(np.arange(len(n)), n)
        some = np.flatnonzero(mine[owner])
        order = some[np.lexsort((v[some], df[some], owner[some]))]
        rank = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
        prefix = n - -(-n * num // den) + 1
        enters = (rank < prefix[owner[order]]) & (df[order] > 1) & (n[owner[order]] * (den - num) >= num)  # smaller sets link with equal sets only
        entry, place = order[enters], rank[enters]
        doc = owner[entry]
        c = size_class(n, num, den)[doc].astype(np.int32)
        one = _made(len(n), doc_id=docs["doc_id"], h=docs["h"], n=n, d1=d1, d2=d2)
        two = _made(  # in the block of the own class, and as a guest in that of the next smaller one
            2 * len(entry), n=np.tile(n[doc], 2), d1=np.tile(d1[doc], 2), token=np.tile(v[entry].view(np.int64), 2),
            guest=np.repeat([False, True], len(entry)), place=np.tile(place, 2), **{"class": np.concatenate([c, c - 1])},
        )
        sent = np.unique(doc)
        three = _made(len(sent), n=n[sent], d1=d1[sent], body=docs["text"].take(pa.array(sent)))
        return pa.concat_tables([one, two, three])

    return run


def link_forest(sets: list[np.ndarray], num: int, den: int, settled: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges that, with what is ``settled`` (a number for each set), span the same components as all links among these sets.

    Sets are sorted and not empty. By leaders and differences, see above.
    """
    size = np.array([len(s) for s in sets])
    label = np.arange(len(sets)) if settled is None else np.unique(settled, return_inverse=True)[1]
    edges: list[tuple[int, int]] = []
    plus, minus = den + num, den - num

    def join(i: int, j: int) -> None:
        if label[i] != label[j]:
            edges.append((i, j))
            label[label == label[j]] = label[i]

    pool = np.argsort(size, kind="stable")[::-1]
    while len(pool) > 1:
        lead = pool[0]
        flat = np.concatenate([sets[i] for i in pool])
        start = np.append(0, np.cumsum(size[pool]))
        at = np.searchsorted(sets[lead], flat)
        common = sets[lead][np.minimum(at, size[lead] - 1)] == flat
        seen = np.append(0, np.cumsum(common))
        inter = seen[start[1:]] - seen[start[:-1]]
        apart = size[pool] + size[lead] - 2 * inter
        union = size[pool] + size[lead] - inter
        for k in np.flatnonzero(apart * plus <= (size[pool] + size[lead]) * minus):
            join(lead, pool[k])
        near = np.flatnonzero(2 * apart <= union)  # at Jaccard distance 1/2 at most
        if len(np.unique(label[pool[near]])) > 1:
            _by_differences(near, pool, sets, size, lead, flat, start, common, apart, label, join, plus, minus)
        rest = np.flatnonzero(2 * apart > union)
        if len(rest):  # members near the border of the leader's reach may link with sets just beyond it
            far = apart / np.maximum(union, 1)
            reach = 1 - num / den + 1e-9
            ring = rest[far[rest] <= 0.5 + reach]
            border = near[far[near] >= 0.5 - reach]
            for r in pool[ring]:
                for b in pool[border]:
                    if label[r] != label[b] and min(size[r], size[b]) * den >= max(size[r], size[b]) * num:
                        both = len(np.intersect1d(sets[r], sets[b], assume_unique=True))
                        if (size[r] + size[b] - 2 * both) * plus <= (size[r] + size[b]) * minus:
                            join(b, r)
        pool = pool[rest]
    return edges


def _by_differences(near, pool, sets, size, lead, flat, start, common, apart, label, join, plus, minus) -> None:
    """Links among the sets near one leader, from what each has beyond the leader and what it lacks."""
    rows, tokens = [], []
    for k in near:
        own = flat[start[k] : start[k + 1]]
        has = common[start[k] : start[k + 1]]
        lacks = np.setdiff1d(sets[lead], own, assume_unique=True)
        tokens += [own[~has], lacks ^ _D1]  # shingles lacked are told from shingles added
        rows.append(np.full(len(own) - int(has.sum()) + len(lacks), k))
    row, token = np.concatenate(rows), np.concatenate(tokens)
    _, at, times = np.unique(token, return_inverse=True, return_counts=True)
    shared = times[at] > 1
    row, at = np.searchsorted(near, row[shared]), at[shared]
    _, at = np.unique(at, return_inverse=True)
    width = int(at.max(initial=-1)) + 1
    names, counts = np.unique(label[pool[near]], return_counts=True)
    main = names[np.argmax(counts)]
    open_ = np.flatnonzero(label[pool[near]] != main)
    e, n = apart[near], size[pool[near]]
    by_column = np.argsort(at, kind="stable")
    row, at = row[by_column], at[by_column]
    for part in range(0, len(open_), 512):
        some = open_[part : part + 512]
        both = np.zeros((len(some), len(near)), dtype=np.float32)
        for c in range(0, width, 2048):
            lo, hi = np.searchsorted(at, [c, c + 2048])
            grid = np.zeros((len(near), min(2048, width - c)), dtype=np.float32)
            grid[row[lo:hi], at[lo:hi] - c] = 1
            both += grid[some] @ grid.T
        linked = (e[some][:, None] + e[None, :] - 2 * both) * plus <= (n[some][:, None] + n[None, :]) * minus
        for k, i in enumerate(some):
            for j in near[np.flatnonzero(linked[k])]:
                join(pool[near[i]], pool[j])


def _checked(width: int, num: int, den: int):
    """Links (u, v) of leaders with their entries; rows come sorted by leader and piece, the leader's own first in each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, own = None, np.zeros(0, dtype=np.uint64)
        for batch in batches:
            v, bounds = _sets(batch, width)
            u, d1 = batch.column("lead").to_numpy(), batch.column("d1").to_numpy()
            found = []
            for k in range(batch.num_rows):
                s = v[bounds[k] : bounds[k + 1]]
                if u[k] == d1[k]:
                    lead, own = u[k], s
                elif lead == u[k] and len(s) and len(own):
                    both = np.count_nonzero(own[np.minimum(np.searchsorted(own, s), len(own) - 1)] == s)
                    if both * den >= (len(s) + len(own) - both) * num:
                        found.append(k)
            yield pa.record_batch([pa.array(u[found]), pa.array(d1[found])], names=["u", "v"])

    return run


def _compared(width: int, num: int, den: int, keys: list[str]):
    """Links (u, v) among the sets of blocks left over, without those that are settled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, keys):
            v, bounds = _sets(group, width)
            at = np.flatnonzero(np.diff(bounds) > 0)
            d1 = group["d1"].to_numpy()
            found = link_forest([v[bounds[i] : bounds[i + 1]] for i in at], num, den, group["settled"].to_numpy()[at])
            if found:
                i, j = np.array(found).T
                u, w = forest(d1[at[i]], d1[at[j]])
                yield pa.record_batch([pa.array(u), pa.array(w)], names=["u", "v"])

    return run


def _pieces(total: Column) -> Column:
    return F.ceil(total / GROUP).cast("int")


def links(entries: DataFrame, bodies: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(node, component) of every set that links with another, from index entries and the texts of the sets."""
    share = num / (num + den)
    need = lambda n, least: share * (n + least) - 1e-6
    reach = F.col("n") - F.col("place")
    lead = ~F.col("guest") & (reach >= need(F.col("n"), F.col("n")))
    blocks_ = (
        entries.groupBy("token", "class")
        .agg(F.min(F.when(lead, F.col("d1"))).alias("lead"), F.min(F.when(lead, F.col("n"))).alias("least"), F.max(F.when(lead, reach)).alias("reach"), F.min("d1").alias("a"), F.max("d1").alias("b"))
        .where("lead is not null and a < b").drop("a", "b")
    )
    may = (reach >= need(F.col("n"), F.col("least"))) & (F.col("reach") >= need(F.col("n"), F.col("least")))
    members = written(entries.join(blocks_, ["token", "class"]).where((F.col("d1") != F.col("lead")) & may).select("token", "class", "lead", "d1", "n"))
    pairs = members.groupBy("lead", "d1").agg(F.first("n").alias("n"))
    split = pairs.groupBy("lead").agg(_pieces(F.sum("n")).alias("s"))
    leaders = split.select("lead", F.col("lead").alias("d1"), F.explode(F.expr("sequence(0, s - 1)")).alias("piece"), F.lit(0).alias("later"))
    others = pairs.join(split, "lead").select("lead", "d1", F.pmod(F.xxhash64("d1"), F.col("s")).cast("int").alias("piece"), F.lit(1).alias("later"))
    texts = bodies.select("d1", F.col("body").alias("text"))
    order = ["lead", "piece", "later"]
    sorted_ = leaders.unionByName(others).join(texts, "d1").repartition("lead", "piece").sortWithinPartitions(*order)
    checked = written(sorted_.mapInArrow(released(_checked(width, num, den)), "u bigint, v bigint"))
    parts = written(components(checked))

    settled = F.coalesce("component", "d1")
    known = members.select("token", "class", "d1", "n").join(parts, F.col("d1") == F.col("node"), "left").select("token", "class", "d1", "n", settled.alias("settled"))
    open_ = known.groupBy("token", "class").agg(F.min("settled").alias("a"), F.max("settled").alias("b"), F.sum(F.xxhash64("d1") % (1 << 40)).alias("who"), F.count("*").alias("many"), F.sum("n").alias("size")).where("a < b")
    once = open_.groupBy("who", "many").agg(F.min(F.struct("token", "class", "size")).alias("x")).select("x.*")  # blocks of the same sets need one look
    group = once.select("token", "class", F.ceil(2 * F.col("size") / GROUP).cast("int").alias("s"))
    left = known.join(group, ["token", "class"]).withColumn("piece", F.pmod(F.xxhash64("d1"), F.col("s")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, s - 1)")))
    keys = ["token", "class", "one", "two"]
    dealt = left.select("token", "class", F.least("piece", "other").alias("one"), F.greatest("piece", "other").alias("two"), "d1", "settled").join(texts, "d1").repartition(*keys).sortWithinPartitions(*keys)
    more = written(dealt.mapInArrow(released(_compared(width, num, den, keys)), "u bigint, v bigint"))
    out = parts if more.isEmpty() else components(parts.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more))
    return out


def _members(docs: DataFrame, width: int, similarity: tuple[int, int]) -> DataFrame:
    """(doc_id, h, n, component, component_id) of every row; h is the hash of its text, component a name that is null for empty sets only."""
    num, den = similarity
    rows, n = blocks(docs, F.xxhash64("text").alias("h"))
    back = counted(rows, n, lambda part: _keys(part, width, num, den)[5:])
    found = written(rows.groupBy("blk").cogroup(back.groupBy("blk")).applyInArrow(released_tables(_indexed(width, num, den)), FOUND))
    sets = found.where("token is null and body is null").select("doc_id", "h", "n", "d1", "d2")
    entries = found.where("token is not null").select("token", "class", "guest", "place", "n", "d1")
    linked = links(entries, found.where("body is not null").select("d1", "body"), width, num, den).withColumnRenamed("node", "d1")
    named = sets.where("n > 0").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep")).join(linked, "d1", "left").withColumn("component", F.coalesce("component", "d1"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    known = named.join(least, "component").select("d1", "d2", "n", "component", "component_id")
    return sets.join(known, ["d1", "d2", "n"], "left").select("doc_id", "h", "n", "component", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def groups(docs: DataFrame, width: int = WIDTH, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text)."""
    return _members(docs, width, similarity).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, width: int = WIDTH, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """Of every group of near-duplicates the row with the smallest doc_id (of several, that with the least hash of its text), with all its columns.

    Rows with empty sets are no duplicates of each other. Rows equal in doc_id and text stay once; rows without doc_id all stay.
    """
    found = _members(docs, width, similarity).where("doc_id is not null")
    first = found.where("n > 0").groupBy("component").agg(F.min(F.struct("doc_id", "h")).alias("x")).select(F.col("x.doc_id").alias("id"), F.col("x.h").alias("h"))
    kept = written(first.unionByName(found.where("n = 0").select(F.col("doc_id").alias("id"), "h").distinct()))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.xxhash64("text").alias("h"), F.struct("*").alias("row"))
    once = rows.join(kept, ["id", "h"]).groupBy("id", "h").agg(F.first("row").alias("row"))
    return once.unionByName(rows.where("id is null")).select("row.*")


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"), 3, (90, 100))


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s FROM w),
f AS (SELECT s, row_number() OVER (ORDER BY s) AS id, len(s) AS n FROM (SELECT DISTINCT s FROM g WHERE len(s) > 0)),
e AS (SELECT id, n, unnest(s) AS t FROM f),
k AS (SELECT id, n, t, row_number() OVER (PARTITION BY id ORDER BY df, t) AS pos FROM (SELECT *, count(*) OVER (PARTITION BY t) AS df FROM e)),
a AS (SELECT id, n, t FROM k WHERE pos <= n - (9 * n + 9) // 10 + 1),
c AS (SELECT DISTINCT x.id AS x, y.id AS y, x.n + y.n AS total FROM a x JOIN a y ON x.t = y.t AND x.id < y.id),
p AS (SELECT x, y FROM (SELECT x, y, total, count(*) AS both_ FROM c JOIN e d ON d.id = x JOIN e h ON h.id = y AND h.t = d.t GROUP BY ALL) WHERE 100 * both_ >= 90 * (total - both_)),
q AS (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
r AS (SELECT x AS node, x AS root FROM q UNION SELECT q.y, r.root FROM r JOIN q ON q.x = r.node),
m AS (SELECT node, min(root) AS comp FROM r GROUP BY node),
l AS (SELECT g.doc_id, g.s, coalesce(m.comp, f.id) AS comp FROM g JOIN f ON g.s = f.s LEFT JOIN m ON m.node = f.id),
o AS (SELECT comp, min(doc_id) AS component_id FROM l GROUP BY comp),
z AS (SELECT DISTINCT s, component_id FROM l JOIN o USING (comp))
SELECT g.doc_id, CAST(len(g.s) AS BIGINT) AS n_shingles, CAST(CASE WHEN len(g.s) > 0 THEN z.component_id ELSE g.doc_id END AS BIGINT) AS component_id
FROM g LEFT JOIN z ON z.s = g.s
"""
