"""N-gram Jaccard join by a grouped prefix join.

1. Each text becomes its set of distinct n-word shingles, as 64-bit hashes. Texts with one
   set are one class, and a class is represented by its smallest doc_id.
2. A sketch of 2**18 counters, over all texts, orders hashes by how often they occur (ties
   by value): rare ones first. Two sets of similarity t or more share a hash among the first
   n - ceil(t * n) + 1 of each, whatever the order is.
3. Classes with identical prefixes and sizes collapse into a group; only the group's leader
   puts its prefix into the index, and of it the hashes that occur again (a filter of fixed
   size knows them, and few more).
4. Group pairs that share a prefix hash are filtered by size and by position (how many hashes
   can still agree after the first shared one).
5. Pairs left are expanded to members. A bitmap of each set, about two bits a shingle, bounds
   what a pair can share from above; pairs that it leaves are verified on the whole sets, so
   that few sets are dealt out.

Steps 4 and 5 are done twice. First each hash's leaders meet one pivot only, the leader that
has the hash earliest, and a group's members meet their leader; links found give provisional
components. Then pairs of different components meet, so that a group of thousands of near
copies, which links up in the first round, never becomes all its pairs - and no link between
components is missed.

Defined results: null and empty texts have an empty set and are linked with nothing; texts
with fewer words than n have one shingle, the whole sequence; rows with one doc_id are one
document (linked where any of its texts is); a null doc_id is linked with nothing and has a
null component; other columns are ignored by join(), kept by deduplicate().
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lantern.llm.batches import counted, fold_rows, map_rows
from lantern.llm.suffixes import bitmap, flagged
from lantern.llm.wordhash import SPACE, U, Words, lowered, mixed
from lantern.plans.components import components
from lantern.session import released, table, written

SKETCH_BITS = 18
#: Bits of the filter of repeated hashes (16 MB), at most; 16 for each hash up to there. A
#: filter too full for the input lets more pass, which later steps sort out.
FILTER_BITS = 27
FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def shingles(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted inside each text, and each text's first."""
    w = Words([lowered(t) for t in texts], SPACE)
    h, count = w.hashes(), np.diff(w.first)
    x = np.zeros(max(len(h) - n + 1, 0), dtype=np.uint64)
    for j in range(n):
        x += h[j : len(x) + j] * FACTORS[j]
    inside = w.doc[: len(x)] == w.doc[n - 1 :] if len(x) else np.zeros(0, dtype=bool)
    value, doc = [mixed(x[inside])], [w.doc[: len(x)][inside]]
    for d in np.nonzero((count > 0) & (count < n))[0]:
        own = h[w.first[d] : w.first[d + 1]]
        value.append(mixed((own * np.array(FACTORS[: len(own)])).sum(keepdims=True, dtype=np.uint64) + U(len(own))))
        doc.append(np.array([d]))
    value, doc = np.concatenate(value), np.concatenate(doc)
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.ones(len(value), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    return value[new], np.searchsorted(doc[new], np.arange(len(texts) + 1))


def sketch(docs: DataFrame, n: int) -> np.ndarray:
    """How many sets hold a hash with these low bits: 2**18 counters, whatever the input."""
    def step(state, b):
        state += np.bincount((shingles(b["text"], n)[0] & U((1 << SKETCH_BITS) - 1)).astype(np.int64), minlength=len(state))
    start = lambda: np.zeros(1 << SKETCH_BITS, dtype=np.int64)
    finish = lambda s: [(i, int(s[i])) for i in np.nonzero(s)[0].tolist()]
    rows = fold_rows(docs.select("text"), start, step, finish, "i int, n long").groupBy("i").agg(F.sum("n").alias("n"))
    got = rows.toArrow()
    out = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
    out[got.column("i").to_numpy()] = got.column("n").to_numpy()
    return out


def long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return n - -(-percent * n // 100) + 1


def bitmaps(value: np.ndarray, first: np.ndarray) -> list[bytes]:
    """A set's bitmap: 64-bit words, a power of two of them and at least a 32nd of the set's
    size, with a bit for the low bits of each hash."""
    size = np.diff(first)
    words = np.maximum(1, 1 << np.ceil(np.log2(np.maximum(size, 1) / 32)).astype(np.int64).clip(0))
    begin = np.concatenate([[0], np.cumsum(words)])
    doc = np.repeat(np.arange(len(size)), size)
    out = np.zeros(begin[-1], dtype=np.uint64)
    at = begin[doc] + ((value >> U(6)).astype(np.int64) & (words[doc] - 1))
    np.bitwise_or.at(out, at, U(1) << (value & U(63)))
    return [out[b:e].tobytes() for b, e in zip(begin[:-1], begin[1:])]


def most_shared(a: bytes, n_a: int, b: bytes, n_b: int) -> int:
    """An upper bound of what two sets share, by their bitmaps: a bit that only one has is a
    hash that only it has. The longer bitmap is folded to the length of the other."""
    x, y = (np.frombuffer(z, dtype=np.uint64) for z in (a, b))
    length = min(len(x), len(y))
    x, y = (np.bitwise_or.reduce(z.reshape(-1, length), axis=0) for z in (x, y))
    return min(n_a - int(np.bitwise_count(x & ~y).sum()), n_b - int(np.bitwise_count(y & ~x).sum()))


def prefixes(docs: DataFrame, n: int, percent: int, counts: np.ndarray) -> DataFrame:
    """doc_id, n, d1, d2 (digest of the set), p1, p2 (of the prefix), prefix, bits."""
    shared = docs.sparkSession.sparkContext.broadcast(counts.astype(np.int32))  # 1 MB
    def rows(b):
        value, first = shingles(b["text"], n)
        bits = bitmaps(value, first)
        size = np.diff(first)
        doc = np.repeat(np.arange(len(size)), size)
        order = np.lexsort((value, shared.value[(value & U((1 << SKETCH_BITS) - 1)).astype(np.int64)], doc))
        value = value[order]
        length = np.where(size > 0, prefix_length(size, percent), 0)
        taken = np.arange(len(value)) - first[doc] < length[doc]
        sums = []
        for x in (value, np.where(taken, value, U(0))):
            for salt in (1, 2):
                s = np.concatenate([[U(0)], np.cumsum(np.where(x == 0, x, mixed(x + U(salt))), dtype=np.uint64)])
                sums.append(long(s[first[1:]] - s[first[:-1]]))
        signed = long(value)
        return zip(b["doc_id"], size.tolist(), *(s.tolist() for s in sums), (signed[f : f + k] for f, k in zip(first, length)), bits)
    return map_rows(docs.select("doc_id", "text"), rows, "doc_id long, n int, d1 long, d2 long, p1 long, p2 long, prefix array<long>, bits binary")


def repeated(sets: DataFrame, flags: Broadcast) -> DataFrame:
    """(g, n, pos, token): the hashes of prefixes (doc_id, n, prefix) that flags hold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.diff(b.column("prefix").offsets.to_numpy())
            token = b.column("prefix").flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(size)), size)
            pos = np.arange(len(token)) - (np.cumsum(size) - size)[row]
            at = np.nonzero(flagged(flags.value, token))[0]
            g, n = (b.column(c).to_numpy(zero_copy_only=False)[row[at]] for c in ("doc_id", "n"))
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(n, pa.int32()), pa.array(pos[at], pa.int32()), pa.array(token[at], pa.int64())], names=["g", "n", "pos", "token"])

    return sets.mapInArrow(run, "g long, n int, pos int, token long")


def may_link(percent: int) -> Column:
    """Size and position filter of the pair x, y whose shared hash is at x.pos, y.pos."""
    nx, ny = F.col("x.n"), F.col("y.n")
    needed = F.ceil(percent * (nx + ny) / F.lit(100.0 + percent) - 1e-9)
    return (
        (100 * F.least(nx, ny) >= percent * F.greatest(nx, ny))
        & (nx - F.col("x.pos") >= needed) & (ny - F.col("y.pos") >= needed)
    )


def size_class(n: Column, percent: int) -> Column:
    """Sizes of similar sets are in one class or in neighbouring ones."""
    return F.floor(F.ln(n.cast("double")) / F.lit(math.log(100 / percent)) + 1e-9).cast("int")


def ids_of(pairs: DataFrame) -> DataFrame:
    """doc_id: the documents of pairs, broadcast if they are few."""
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    return counted(written(ids, "ids"))


def joined(pairs: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
    """pairs (a, b) with columns of the documents' sets, named a_... and b_..."""
    for x in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("doc_id").alias(x), *(F.col(c).alias(f"{x}_{c}") for c in columns)), x)
    return pairs


def verified(pairs: DataFrame, bits: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) of doc_ids whose whole sets are similar enough. bits: doc_id, n and
    bitmap of each set."""
    met = written(pairs.distinct(), "pairs")
    bits = bits.join(ids_of(met), "doc_id", "left_semi")
    def able(r):
        for a, b, na, nb, x, y in zip(*(r[c] for c in ("a", "b", "a_n", "b_n", "a_bits", "b_bits"))):
            most = most_shared(x, na, y, nb)
            if 100 * most >= percent * (na + nb - most):
                yield a, b
    pairs = written(map_rows(joined(met, bits, "n", "bits"), able, "a long, b long", text="a_bits").distinct(), "pairs")
    released(met)
    ids = ids_of(pairs)
    def rows(b):
        value, first = shingles(b["text"], n)
        return zip(b["doc_id"], (long(value)[f:e] for f, e in zip(first[:-1], first[1:])))
    sets = map_rows(docs.select("doc_id", "text").join(ids, "doc_id", "left_semi"), rows, "doc_id long, s array<long>")
    sets = written(sets, "sets")
    both = joined(pairs, sets, "s").withColumn("same", F.size(F.array_intersect("a_s", "b_s")))
    out = written(both.filter(100 * F.col("same") >= percent * (F.size("a_s") + F.size("b_s") - F.col("same"))).select("a", "b"), "links")
    released(pairs, sets)
    return out


def labelled(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """nodes (rep, ...) with c, their component by now."""
    return nodes.join(found.withColumnRenamed("id", "rep"), "rep", "left").withColumn("c", F.coalesce("component", "rep")).drop("component")


def join(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id: a row for each row of docs. Texts are linked from
    percent hundredths of Jaccard similarity of their n-word shingle sets."""
    docs = docs.select("doc_id", "text")
    sets = written(prefixes(docs, n, percent, sketch(docs, n)), "prefixes")
    known = F.col("doc_id").isNotNull()
    slim = sets.filter("n > 0").drop("prefix", "bits")  # prefixes are read where they are, never dealt out
    bits = sets.filter("n > 0").filter(known).select("doc_id", "n", "bits")
    classes = written(slim.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep")), "classes")
    reps = classes.select("d1", "d2", F.col("rep").alias("doc_id")).filter("rep IS NOT NULL")
    first = written(slim.filter(known).join(reps, ["d1", "d2", "doc_id"], "left_semi").select("p1", "p2", "n", F.col("doc_id").alias("rep")).distinct(), "first")
    group = ["p1", "p2", "n"]
    leaders = written(first.groupBy(*group).agg(F.min("rep").alias("leader"), F.count(F.lit(1)).alias("members")), "leaders")
    members = written(first.join(leaders.filter("members > 1"), group).select("leader", "rep", "n"), "members")
    # A hash that one text has leads nowhere; most are such. Counts are sums and pivots are
    # minima: no task sees a frequent hash's whole list. With their places, hashes are dealt
    # out only where the filter of repeated ones lets them pass; the few that pass by chance
    # have no partner below.
    again = written(sets.select(F.explode("prefix").alias("x")).groupBy("x").count().filter("count > 1").select("x"), "again")
    held = min(FILTER_BITS, max(16, (16 * again.count()).bit_length()))
    flags = docs.sparkSession.sparkContext.broadcast(bitmap(again, held))
    released(again)
    index = repeated(sets.filter(known).select("doc_id", "n", "prefix"), flags)
    index = written(index.join(leaders.select(F.col("leader").alias("g"), "n"), ["g", "n"], "left_semi").dropDuplicates(["token", "g", "n"]), "index")
    flags.destroy()
    tokens = index.groupBy("token").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("pos", "n", "g")).alias("pivot"), F.min("n").alias("low"))
    shared = written(index.join(tokens.filter("k > 1"), "token").drop("k"), "shared")
    released(index)

    # Round one: leaders meet the hash's pivot, members their leader.
    x = shared.select(F.struct("n", "pos").alias("x"), F.struct(F.col("pivot.n").alias("n"), F.col("pivot.pos").alias("pos")).alias("y"), "g", F.col("pivot.g").alias("p"))
    stars = x.filter((F.col("g") != F.col("p")) & may_link(percent)).select(F.least("g", "p").alias("a"), F.greatest("g", "p").alias("b"))
    stars = stars.unionByName(members.filter("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")))
    links = verified(stars, bits, docs, n, percent)
    found = written(components(links), "found")

    # Round two: what meets in a hash or a group across components.
    alone = leaders.select("leader").distinct().join(members.select("leader").distinct(), "leader", "left_anti")
    everyone = members.select("leader", "rep").unionByName(alone.select("leader", F.col("leader").alias("rep")))
    label = labelled(everyone, found)
    spread = label.groupBy("leader").agg(F.min("c").alias("c0"), F.max("c").alias("c1"))
    most = F.floor((F.col("n") - F.col("pos")) * (100.0 + percent) / percent - F.col("n") + 1e-9)  # largest partner
    open_rows = shared.filter(most >= F.col("low")).join(spread.withColumnRenamed("leader", "g"), "g").select("token", "g", "n", "pos", "c0", "c1")
    mixed_tokens = open_rows.groupBy("token").agg(F.min("c0").alias("lo"), F.max("c1").alias("hi")).filter("lo <> hi").select("token")
    rows = written(open_rows.join(mixed_tokens, "token", "left_semi"), "open")
    # The larger of a pair meets the other's size class and the one above, so that rows of a
    # frequent hash are compared with rows of like size only.
    x = rows.withColumn("class", size_class(F.col("n"), percent))
    y = rows.withColumn("class", F.explode(F.array(size_class(F.col("n"), percent), size_class(F.col("n"), percent) + 1)))
    apart = (F.col("x.c0") != F.col("y.c0")) | (F.col("x.c1") != F.col("x.c0")) | (F.col("y.c1") != F.col("y.c0"))
    larger = F.struct("x.n", "x.g") > F.struct("y.n", "y.g")
    across = x.alias("x").join(y.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.class") == F.col("y.class")) & larger & apart & may_link(percent))
    across = across.select(F.col("x.g").alias("gx"), F.col("y.g").alias("gy")).distinct()
    inside = spread.filter("c0 <> c1").select(F.col("leader").alias("gx"), F.col("leader").alias("gy"))
    gx, gy = label.select(F.col("leader").alias("gx"), F.col("rep").alias("a"), F.col("c").alias("ca")), label.select(F.col("leader").alias("gy"), F.col("rep").alias("b"), F.col("c").alias("cb"))
    rest = across.unionByName(inside).join(gx, "gx").join(gy, "gy").filter("ca <> cb AND a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = verified(rest, bits, docs, n, percent)

    reached = labelled(classes.filter("rep IS NOT NULL"), found).select("d1", "d2", F.col("n").alias("size"), "c")
    if not more.isEmpty():
        # What round two links are round one's components: its links are theirs.
        c = lambda end: label.select(F.col("rep").alias(end), F.col("c").alias(f"c_{end}")).distinct()
        between = more.join(c("a"), "a").join(c("b"), "b").select(F.col("c_a").alias("a"), F.col("c_b").alias("b"))
        further = written(components(between), "found").select(F.col("id").alias("c"), "component")
        reached = reached.join(further, "c", "left").withColumn("c", F.coalesce("component", "c")).drop("component")
    out = sets.select("doc_id", "n", "d1", "d2").join(reached, ["d1", "d2"], "left")
    component = F.when(F.col("n") > 0, F.coalesce("c", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(known, component).alias("component_id"))


def deduplicate(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs whose doc_id is their component's smallest; rows of one doc_id all stay
    or all go."""
    got = join(docs, n, percent)
    gone = got.filter(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct()
    return docs.join(counted(written(gone, "gone")), "doc_id", "left_anti")


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"), n=4, percent=85)


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] for i in range(1, len(w) - 2)]) END AS s FROM d),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n
    HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT s.doc_id, len(s)::BIGINT AS n_shingles, least(s.doc_id, coalesce(m, s.doc_id)) AS component_id FROM s
LEFT JOIN (SELECT a, min(b) AS m FROM r GROUP BY a) ON s.doc_id = a
"""
