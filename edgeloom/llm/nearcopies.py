"""The exact part of operator 9's near-duplicates: Jaccard similarity of word shingles.

Two texts are near copies where their sets of ``shingle``-word runs have a
Jaccard similarity of four fifths or more.  ``simhash`` gives candidates; the
fingerprints of such texts may lie 20 bits apart, so what it can't reach is found
by the pigeonhole principle on the sets themselves.  In any order that is the
same for all sets, two such sets of n <= m members have their first common one
among the first n/9 + 1 of the smaller and the first m/5 + 1 of the larger: each
text is keyed by those, and no pair is missed.  The order puts runs that many
texts of a sample hold last, which changes the work only, not the result.

Where such sets first meet, what is left of both must still hold the common
members, and their fingerprints differ in 10 bits on the average (standard
deviation 3), so pairs at over ``FARTHEST`` bits are none: that rules out most
before any set is read again, and sets are made only of the texts that are left.

The members of a key are first held against at most three of it: the least, the
one with the fewest rarer runs and one by hash, which links a large group of
copies in proportion to its size.  Of what that leaves in different components,
texts stay that share as many keys as near copies must (what one lacks of the
other can't fill the rest of its prefix).  Their prefixes are made anew, in an
order by what all of them hold: runs of one component alone come first and make
no key, so texts with enough of their own meet nothing, and the rest is compared
in full.  Texts that are much alike, but not by four fifths, hang together in no
component and have few runs of their own still make pairs in the square of their number.

Edge cases: texts are told apart by a 64-bit hash; null texts are like each
other, and so are texts without words; fewer words than a shingle are one
shingle; words are as in ``simhash``; rows may repeat; an empty table gives none.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.llm.common import majority, materialize, short_batches, small_batches, spare
from edgeloom.llm.components import components

#: Texts of the sample, and how many of its frequent runs a worker knows.
SAMPLE, MOST_COMMON = 10_000, 200_000
#: Bits in which fingerprints of near copies may differ: five standard deviations more than they do at four fifths.
FARTHEST = 24
#: Rows of two numbers that a broadcast may hold; more are joined by a shuffle.
MOST_BROADCAST = 2_000_000


def shingles(text: str | None, shingle: int = 5) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles; a text without words has the one of no word."""
    words = (text or "").encode().lower().split()
    runs = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(0)), dtype=np.uint64).view(np.int64))


def prefix(hashes: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first members of a set: all but four fifths of them, and one more; ``common`` ones, by count, come last."""
    take = len(hashes) - -(-4 * len(hashes) // 5) + 1
    if not len(common):
        return hashes[:take]
    at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
    rank = np.where(common[at] == hashes, counts[at], 0)
    return hashes[np.argsort(rank, kind="stable")[:take]]


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(node, n, hashes) of (node, text): 32 bits of each shingle's hash."""

    def run(batches):
        for batch in small_batches(batches):
            found = [np.unique(shingles(t, shingle).astype(np.int32)) for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends)), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))], names=["node", "n", "hashes"])

    return short_batches(texts).mapInArrow(run, "node long, n int, hashes array<int>")


def _prefixes(texts: DataFrame, shingle: int, common, whole: bool = False) -> DataFrame:
    """(node, n, simhash, hashes) of (node, text): the size of the set, its fingerprint and its prefix (or all of it)."""

    def run(batches):
        for batch in small_batches(batches):
            sizes, prints, found = [], [], []
            for t in batch.column(1).to_pylist():
                h = shingles(t, shingle)
                sizes.append(len(h))
                prints.append(majority(h.view(np.uint64)))
                found.append(h if whole else prefix(h, *common.value))
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), pa.array(np.array(prints, np.uint64).view(np.int64)), lists], names=["node", "n", "simhash", "hashes"])

    return short_batches(texts).mapInArrow(run, "node long, n int, simhash long, hashes array<long>")


def _common(texts: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The runs that three or more texts of the sample hold, sorted, and their counts."""
    every = max(1, texts.count() // SAMPLE)
    some = texts.where(F.pmod(F.xxhash64("node"), F.lit(every)) == 0)
    none = some.sparkSession.sparkContext.broadcast((np.array([], np.int64), np.array([], np.int64)))
    counts = _prefixes(some, shingle, none, whole=True).select(F.explode("hashes").alias("h")).groupBy("h").count().where("count >= 3")
    found = counts.orderBy(F.desc("count"), "h").limit(MOST_COMMON).toArrow().sort_by("h")
    return found["h"].to_numpy(), found["count"].to_numpy()


def small(rows: DataFrame) -> DataFrame:
    """Written ``rows`` of a few numbers, to be broadcast if they are few enough."""
    rows = materialize(rows, "small")
    return F.broadcast(rows) if rows.count() <= MOST_BROADCAST else rows  # at most 32 MB


def links(texts: DataFrame, shingle: int = 5, candidates=None) -> DataFrame:
    """(a, b) with a < b of (node, text): near copies, enough of them to connect all that there are."""
    common = texts.sparkSession.sparkContext.broadcast(_common(texts, shingle))  # at most MOST_COMMON pairs of numbers
    # copies of a text meet here, before their keys are dealt out
    first_of = [F.first(c).alias(c) for c in ("n", "simhash", "hashes")]
    prefixes = materialize(_prefixes(texts, shingle, common).groupBy("node").agg(*first_of), "prefixes")
    keyed, key = prefixes.select("node", "n", "simhash", F.posexplode("hashes").alias("at", "key")), Window.partitionBy("key")
    member, turn = F.struct("node", "n", "at", "simhash"), F.xxhash64("node", "key")
    two = F.struct(F.min_by(member, F.struct("at", turn)).over(key).alias("low"), F.max_by(member, turn).over(key).alias("high"))
    members = keyed.withColumn("least", F.min(member).over(key)).withColumn("size", F.count(F.lit(1)).over(key)).withColumn("two", two).where("size > 1")
    centres = F.when(F.col("size") > 2, F.array_distinct(F.array("least", "two.low", "two.high"))).otherwise(F.array("least"))
    members = materialize(members.select("key", "node", "n", "at", "simhash", "size", centres.alias("centres")), "members")
    pair = [F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")]

    tried = members.select(F.struct("node", "n", "at", "simhash").alias("x"), F.explode(F.expr("filter(centres, c -> c.node <> node)")).alias("y")).where(_alike("x.", "y.")).select(*pair)
    tried = (tried if candidates is None else tried.unionAll(candidates(prefixes.select("node", "simhash")))).distinct()
    tried = materialize(tried, "pairs")
    nodes = small(tried.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    sets = materialize(_sets(texts.join(nodes, "node", "left_semi").dropDuplicates(["node"]), shingle), "sets")
    first = _held(tried, sets)

    # centres have met all of their keys' members, and so have those of two
    left = members.where("size > 2 and not array_contains(centres.node, node)").select("key", "node", "n", "at", "simhash")
    left = left.join(small(components(first).toDF("node", "root")), "node", "left").withColumn("root", F.coalesce("root", "node"))
    left = left.withColumn("low", F.min("root").over(key)).withColumn("high", F.max("root").over(key)).where("low < high").drop("low", "high")
    left = materialize(left, "left")
    x, y = left.alias("x"), left.alias("y")
    met = (F.col("x.key") == F.col("y.key")) & F.expr("x.root <> y.root")
    left = x.join(y, met & _near("x.", "y."), "left_semi")
    left = materialize(left.withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("node"))), "left")
    x, y = left.alias("x"), left.alias("y")
    # near copies share so many keys of their prefixes at least, and each of them has stayed for both
    many = F.expr("9 * (least(x.c, y.c) - 1 - greatest(x.n, y.n) div 5 + greatest(x.n, y.n)) >= 4 * (x.n + y.n)")
    still = materialize(x.join(y, met & many & _alike("x.", "y."), "left_semi").select("node", "root").distinct(), "still")
    if still.isEmpty():
        return first
    still = small(still)
    held = texts.join(still.select("node"), "node", "left_semi").dropDuplicates(["node"])
    sets = materialize(_prefixes(held, shingle, common, whole=True), "sets")
    keys = materialize(_rare(sets.join(still, "node")), "keys")
    x, y = keys.alias("x"), keys.alias("y")
    met = (F.col("x.key") == F.col("y.key")) & F.expr("x.root <> y.root and (x.n < y.n or x.n = y.n and x.node < y.node)") & _alike("x.", "y.")
    return first.unionAll(_held(materialize(x.join(y, met).select(*pair).distinct(), "pairs"), sets)).distinct()


def _near(x: str, y: str) -> Column:
    """Whether sets of sizes ``n`` may be near copies by these and their fingerprints."""
    n, m = f"{x}n", f"{y}n"
    return F.expr(f"5 * least({n}, {m}) >= 4 * greatest({n}, {m}) and bit_count({x}simhash ^ {y}simhash) <= {FARTHEST}")


def _alike(x: str, y: str) -> Column:
    """Whether such sets that first meet at places ``at`` may hold enough in common."""
    n, m = f"{x}n", f"{y}n"
    return F.expr(f"9 * least({n} - {x}at, {m} - {y}at) >= 4 * ({n} + {m})") & _near(x, y)


def _held(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The distinct written ``pairs`` (a, b) that are near copies by their ``sets``."""
    a, b = (sets.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("hashes").alias(f"h{x}")) for x in "ab")
    both = pairs.join(a, "a").join(b, "b").where("5 * least(na, nb) >= 4 * greatest(na, nb)")
    return materialize(both.where("9 * size(array_intersect(ha, hb)) >= 4 * (na + nb)").select("a", "b"), "links")


def _rare(sets: DataFrame) -> DataFrame:
    """(key, node, n, at, simhash, root): each set's prefix where runs of one ``root`` alone come first, then those that few sets hold.

    The former make no key: a set that has enough of them meets nothing.
    """
    runs = sets.select("node", "n", "simhash", "root", F.explode("hashes").alias("h"))
    shared = runs.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("h", "c")
    ranked = runs.join(shared, "h").groupBy("node", "n", "simhash", "root").agg(F.sort_array(F.collect_list(F.struct("c", "h"))).alias("s"))
    ranked = ranked.withColumn("own", F.expr("n - size(s)")).where("own <= n div 5")
    return ranked.select(F.posexplode(F.expr("slice(s, 1, n div 5 + 1 - own)")).alias("i", "k"), "node", "n", "own", "simhash", "root").select(F.col("k.h").alias("key"), "node", "n", F.expr("own + i").alias("at"), "simhash", "root")


def dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 5, candidates=None) -> DataFrame:
    """One document of each component of near copies: that with the least id (null ids last, then the least text hash).

    ``candidates`` makes pairs to check first, (a, b), from (node, simhash).
    """
    mark, other, gone = spare(docs, "_node", "_id", "_gone")
    tagged = docs.withColumn(mark, F.xxhash64(F.col(text_column)))
    texts = tagged.select(F.col(mark).alias("node"), F.col(text_column).alias("text"))
    roots = components(links(texts, shingle, candidates))
    rows = tagged.groupBy(F.col(id_column).alias("id"), F.col(mark).alias("node")).agg(F.count(F.lit(1)).alias("c"))
    rows = materialize(rows.join(roots, "node", "left").select("id", "node", "c", F.coalesce("root", "node").alias("root")), "rows")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "node")
    best = rows.groupBy("root").agg(F.min(order).alias("k"), F.count(F.lit(1)).alias("rows")).where("rows > 1").select("root", "k")
    lost = rows.join(best, "root").where(~(F.col("id").eqNullSafe(F.col("k.id")) & (F.col("node") == F.col("k.node")))).select("id", "node")
    same = F.col(id_column).eqNullSafe(F.col(other)) & (F.col(mark) == F.col(gone))
    left = tagged.join(small(lost.toDF(other, gone)), same, "left_anti")
    again = small(rows.where("c > 1").select("id", "node").toDF(other, gone))
    kept = left.join(again, same, "left_anti").unionAll(left.join(again, same, "left_semi").dropDuplicates([id_column, mark]))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
