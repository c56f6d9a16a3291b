"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, verified distances.

A fingerprint holds a bit for each of the 64 where over half of the hashes of a
text's 3-word shingles have it.  Two fingerprints within ``distance`` bits agree
on all but ``distance`` of ``blocks`` blocks, so each fingerprint is keyed by
every choice of ``blocks - distance`` blocks, pairs meet in an equi-join and the
Hamming distance is verified.

A key shared by many fingerprints would emit all pairs.  Members of such a key
are linked another way, as exact as the join: two of them are within two bits
just when some value is within one bit of both, so each member is keyed by its
one-bit changes outside the shared blocks and joined to the least member there.
No more than 65 fingerprints meet at a value, so nothing grows with the group.

Edge cases: null and empty texts have fingerprint zero and link like any other;
texts of one or two words hash as one shingle; rows may repeat; the component id
is the least non-null id reachable (null if there is none).
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm import nearcopies
from edgeloom.llm.common import majority, materialize, short_batches, small_batches, spare
from edgeloom.llm.components import components

#: Seed of the shingle hash (fixed by the contract).
SEED = 42
#: A key with more fingerprints than this is not paired but linked through one-bit changes.
HOT_KEY = 24


def fingerprint(text: str | None, shingle: int = 3) -> int:
    words = (text or "").encode().lower().split()  # bytes: A-Z and [\x20\x09-\x0D] only
    if not words:
        return 0
    runs = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    return majority(np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(SEED)), dtype=np.uint64))


def fingerprints(docs: DataFrame, text_column: str = "text", shingle: int = 3) -> DataFrame:
    """``docs`` without its text, plus ``simhash`` (the 64 bits as a signed long)."""
    kept = [c for c in docs.columns if c.lower() not in (text_column.lower(), "simhash")]
    text = spare(docs, "_text")[0]

    def run(batches):
        for batch in small_batches(batches):
            texts = batch.column(batch.num_columns - 1).to_pylist()
            made = np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made)], names=[*batch.schema.names[:-1], "simhash"])

    data = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text_column).alias(text))
    return short_batches(data).mapInArrow(run, docs.select(*[F.col(f"`{c}`") for c in kept], F.lit(0).cast("long").alias("simhash")).schema)


def masks(blocks: int, distance: int) -> list[int]:
    """The 64-bit masks of every choice of ``blocks - distance`` blocks, as signed longs."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    each = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(blocks)]
    return [(m - (1 << 64) if m >> 63 else m) for m in (sum(c) for c in combinations(each, blocks - distance))]


def links(prints: DataFrame, distance: int = 2, blocks: int = 5, hot_key: int = HOT_KEY) -> DataFrame:
    """(a, b) with a < b: links between distinct fingerprints that connect all pairs within ``distance`` bits.

    Every pair that shares a key of at most ``hot_key`` members is a row.  Among
    members of a larger key each row is a true link, and pairs within reach are
    connected through the least member at a common value.
    """
    if distance not in (1, 2):
        raise ValueError("distance is 1 or 2")
    each = masks(blocks, distance)
    keyed = prints.select("simhash", F.posexplode(F.array(*[F.col("simhash").bitwiseAND(F.lit(m)) for m in each])).alias("c", "key"))
    keyed = materialize(keyed, "keys")
    hot = keyed.groupBy("c", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_key).select("c", "key")
    hot = materialize(hot, "hot")
    cold = keyed.join(hot, ["c", "key"], "left_anti")
    a, b = cold.select("c", "key", F.col("simhash").alias("a")), cold.select("c", "key", F.col("simhash").alias("b"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    pairs = a.join(b, ["c", "key"]).where(near).select("a", "b")
    if hot.isEmpty():
        return pairs.distinct()
    mask = F.element_at(F.array(*[F.lit(m) for m in each]), F.col("c") + 1)
    bit = "shiftleft(1L, i)"
    free = f"filter(sequence(0, 63), i -> (m & {bit}) = 0)"
    members = keyed.join(hot, ["c", "key"], "left_semi").withColumn("m", mask)
    if distance == 2:
        at = f"concat(array(named_struct('i', -1, 'v', simhash)), transform({free}, i -> named_struct('i', -1, 'v', simhash ^ {bit})))"
    else:  # two that differ in bit i alone are equal without it
        at = f"transform({free}, i -> named_struct('i', i, 'v', simhash & ~{bit}))"
    spread = members.select("simhash", F.inline(F.expr(at))).distinct()
    least = spread.groupBy("i", "v").agg(F.min("simhash").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    stars = spread.join(least, ["i", "v"]).where("least < simhash").select(F.col("least").alias("a"), F.col("simhash").alias("b"))
    return pairs.unionAll(stars).distinct()


def grouped(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 3, distance: int = 2, blocks: int = 5) -> DataFrame:
    """``docs`` without its text, plus ``simhash`` and ``component_id`` (least id of the component); columns of these names are replaced."""
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != "component_id"])
    rows = materialize(fingerprints(docs, text_column, shingle), "simhash")
    prints = rows.groupBy("simhash").agg(F.min(id_column).alias("least")).select("simhash", "least")
    roots = components(links(prints.select("simhash"), distance, blocks))
    named = prints.join(roots, prints.simhash == roots.node, "left").select("simhash", "least", F.coalesce("root", "simhash").alias("root"))
    named = materialize(named, "roots")
    owner = named.groupBy("root").agg(F.min("least").alias("component_id"))
    class_of = named.join(owner, "root").select("simhash", "component_id")
    # One print may belong to a third of all rows: these are a few bytes each, and AQE splits them.
    return rows.join(class_of, "simhash")


def candidates(prints: DataFrame, distance: int = 2, blocks: int = 5) -> DataFrame:
    """(a, b) of written (node, simhash): nodes of equal or close fingerprints, each print's nodes by way of its least one."""
    least = materialize(prints.groupBy("simhash").agg(F.min("node").alias("least")), "least")
    equal = prints.join(least, "simhash").where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    near = links(least.select("simhash"), distance, blocks).toDF("x", "y")
    for end, name in (("x", "a"), ("y", "b")):
        near = near.join(least.select(F.col("simhash").alias(end), F.col("least").alias(name)), end)
    return equal.unionAll(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))


def dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 3, distance: int = 2, blocks: int = 5, similar: bool = False) -> DataFrame:
    """One document of each component: that with the least id (null ids last, then the least text hash).

    With ``similar``, texts are linked where the Jaccard similarity of their
    shingle sets is four fifths or more: fingerprints within ``distance`` bits
    give the first candidates, ``nearcopies`` adds those that lie further apart,
    and all are held against their fingerprints and then checked exactly.
    """
    if similar:
        return nearcopies.dedup(docs, id_column, text_column, shingle, lambda prints: candidates(prints, distance, blocks))
    mark, other, kept_mark = spare(docs, "_hash", "_id", "_kept")
    tagged = docs.withColumn(mark, F.xxhash64(F.col(text_column)))
    light = tagged.select(F.col(id_column).alias("id"), F.col(mark).alias("hash"), F.col(text_column).alias("text"))
    rows = grouped(light, "id", "text", shingle, distance, blocks)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "hash")).alias("k")
    # components of rows that have no id at all are told apart by their print
    kept = rows.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("simhash"))).agg(first).select("k.id", "k.hash")
    some = tagged.join(kept.select(F.col("id").alias(other), F.col("hash").alias(kept_mark)).distinct(), F.col(id_column).eqNullSafe(F.col(other)) & (F.col(mark) == F.col(kept_mark)), "left_semi")
    return some.dropDuplicates([id_column, mark]).select(*[F.col(f"`{c}`") for c in docs.columns])


def report(docs: DataFrame) -> DataFrame:
    rows = grouped(docs.select("doc_id", "text"))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("simhash")), 16, "0").alias("fingerprint"), "component_id")
