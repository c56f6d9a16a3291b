"""Mixing sources to target weights by entropy balancing.

Sizes are words, runs of ``[^\\x20\\x09-\\x0D]``.  Each source gets a token
target.  Among all document rates w in [0, 2] that meet the targets, those of
least relative entropy to the corpus are w = min(2, exp(lambda * size)), with
one multiplier a source.  Safeguarded Newton steps solve the convex dual for all
sources at once, each step one grouped sum over the (source, size) histogram.

Rates become copies without chance: classes of equal source and size take their
shares of the running total in order of size, a few single copies then close
what is left of each source's target, and a class spreads its copies over its
documents in the order of a hash.  Reruns agree.

A class may hold a third of all rows, so it is dealt over buckets of about
``BUCKET`` rows, by hash, and a bucket that repeats of one row have made larger
by row number: those rows are all alike, so it doesn't matter which is which.
Buckets are counted before any document is ranked, so ``docs`` is read several
times, and should be a table, or written.

Edge cases: null and empty texts have size 0 and take nothing; a null source is
a source of its own, last in order; repeated rows count each; an empty table
gives an empty result; other columns pass through (names that this module adds,
``size source_size target copies``, are replaced).  Sums of fractions are decimal,
so they don't depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.llm.common import materialize

#: Weights by a source's place in code point order, repeating (fixed by the contract).
WEIGHTS = (3, 1, 2)
#: Tokens of the mix as a share of all tokens, and the most copies of a document or source.
SHARE, MOST = 1.5, 2
#: Rows of a bucket of a class of equal source and size.
BUCKET = 100_000
#: Single copies by which a source's total is closed in on its target.
TOUCHES = 3


def size_of(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")


def source_key(source: Column) -> Column:
    """A key without nulls that sorts by code point with null last."""
    return F.coalesce(F.concat(F.lit("0"), source.cast("string")), F.lit("1"))


def targets(sources: DataFrame, share: float = SHARE, most: int = MOST, weights: tuple = WEIGHTS) -> DataFrame:
    """(_key, source_size, docs) plus ``target``: weighted shares, none above ``most`` times its source's size.

    The excess goes back by weight until none is above.  Sources reach their
    limits in the order of limit over weight, so the level at which the rest
    share equally by weight follows from running sums.  The windows hold a row a
    source, never documents.
    """
    by_name, by_limit = Window.orderBy("_key"), Window.orderBy("_ratio", "_key")
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    got = sources.withColumn("_weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1))
    got = got.withColumn("_limit", F.col("source_size") * most).withColumn("_ratio", F.col("_limit") / F.col("_weight"))
    total, weight = F.sum("source_size").over(whole), F.sum("_weight").over(whole)
    got = got.withColumn("_level", (total * share - F.coalesce(F.sum("_limit").over(before), F.lit(0))) / (weight - F.coalesce(F.sum("_weight").over(before), F.lit(0))))
    reached = F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_key", "_level"))
    level = F.min(reached).over(whole)["_level"]
    return got.withColumn("target", F.coalesce(F.least(F.col("_limit").cast("double"), level * F.col("_weight")), F.col("_limit").cast("double"))).drop("_weight", "_limit", "_ratio", "_level")


def solve(classes: DataFrame, sources: DataFrame, most: int = MOST, most_steps: int = 60, tolerance: float = 1e-9) -> DataFrame:
    """Sources with their multiplier ``_lambda``: sum of n * size * min(most, exp(lambda * size / scale)) is the target.

    ``classes`` has (_key, size, n).  With r the target over the source's size,
    rates at lambda = scale * ln(r) (r < 1) or 0 stay within the target, those at
    0 or scale * ln(most) reach it: a bracket that holds for any sizes of 1 or more.
    """
    live = sources.where("target > 0")
    r, scale = F.col("target") / F.col("source_size"), F.col("source_size") / F.col("docs")
    state = live.select(
        "_key", "target", "source_size", scale.alias("_scale"),
        F.when(r < 1, scale * F.log(r)).otherwise(0.0).alias("_low"), F.when(r < 1, 0.0).otherwise(scale * F.log(F.lit(float(most)))).alias("_high"),
        F.when(r < 1, F.log(r)).otherwise(F.least(F.log(r), scale * F.log(F.lit(float(most))))).alias("_lambda"),
    )
    state = materialize(state, "dual")
    x = F.col("size") / F.col("_scale")
    rate = rate_of(F.col("_lambda"), x, most)
    for _ in range(most_steps):
        tokens = F.col("n") * F.col("size")
        at = classes.where("size > 0").join(state, "_key").groupBy("_key").agg(
            exact_sum(tokens * rate).alias("_f"), exact_sum(F.when(rate < most, tokens * x * rate).otherwise(0.0)).alias("_slope"),
            *[F.first(c).alias(c) for c in ("target", "source_size", "_scale", "_low", "_high", "_lambda")],
        )
        gap = F.col("_f") - F.col("target")
        at = at.withColumn("_gap", F.abs(gap) / F.col("target")).withColumn("_low", F.when(gap < 0, F.col("_lambda")).otherwise(F.col("_low"))).withColumn("_high", F.when(gap >= 0, F.col("_lambda")).otherwise(F.col("_high")))
        newton = F.col("_lambda") - F.try_divide(F.col("_f") - F.col("target"), F.col("_slope"))
        inside = (newton > F.col("_low")) & (newton < F.col("_high"))
        done = F.col("_gap") <= tolerance
        nxt = F.when(done, F.col("_lambda")).when(inside, newton).otherwise((F.col("_low") + F.col("_high")) / 2)
        at = materialize(at.withColumn("_next", nxt), "dual")
        state = at.withColumn("_lambda", F.col("_next")).select(*state.columns)
        # a bracket closed to the last digits has converged as far as doubles go
        left = at.where((F.col("_gap") > tolerance) & (F.col("_high") - F.col("_low") > 1e-12 * (F.abs("_low") + F.abs("_high"))))
        if left.isEmpty():
            break
    return state


def exact_sum(value: Column) -> Column:
    """A sum of doubles that is the same in any order."""
    return F.sum(value.cast("decimal(28,9)")).cast("double")


def rate_of(multiplier: Column, x: Column, most: int) -> Column:
    return F.when(multiplier * x >= F.log(F.lit(float(most))) - 1e-12, float(most)).otherwise(F.exp(multiplier * x))


def allot(classes: DataFrame, state: DataFrame, most: int = MOST, touches: int = TOUCHES) -> DataFrame:
    """(_key, size, n, k): the copies of each class, whole numbers of at most ``most`` a document."""
    run = Window.partitionBy("_key").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    w = rate_of(F.col("_lambda"), F.col("size") / F.col("_scale"), most)
    got = classes.where("size > 0").join(state, "_key").withColumn("_share", F.col("n") * w)
    got = got.withColumn("_upto", F.sum("_share").over(run))
    upto, before = F.floor(F.col("_upto") + 0.5), F.floor(F.col("_upto") - F.col("_share") + 0.5)
    got = got.withColumn("k", F.greatest(F.lit(0), F.least(F.col("n") * most, upto - before)).cast("long")).select("_key", "size", "n", "k", "target")
    for _ in range(touches):
        got = materialize(got, "classes")
        gap = got.groupBy("_key").agg((F.first("target") - F.sum(F.col("size") * F.col("k"))).alias("_gap"))
        can = F.when(F.col("_gap") > 0, F.col("k") < F.col("n") * most).otherwise(F.col("k") > 0) & (F.col("size") < 2 * F.abs("_gap"))
        pick = got.join(gap, "_key").where(can).groupBy("_key").agg(F.min(F.struct(F.abs(F.col("size") - F.abs("_gap")).alias("off"), "size")).alias("p"), F.first("_gap").alias("_gap"))
        pick = pick.select(F.col("_key"), F.col("p.size").alias("size"), F.signum("_gap").cast("long").alias("_step"))
        got = got.join(pick, ["_key", "size"], "left").withColumn("k", F.col("k") + F.coalesce("_step", F.lit(0))).drop("_step")
    return got.select("_key", "size", "n", "k")


def mix(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", share: float = SHARE, most: int = MOST, weights: tuple = WEIGHTS, bucket: int = BUCKET) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``copies`` (0 to ``most``)."""
    added = ("size", "source_size", "target", "copies")
    kept = [F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in added]
    return _mixed(docs, id_column, text_column, source_column, share, most, weights, bucket).select(*kept, *added)


def _mixed(docs: DataFrame, id_column: str, text_column: str, source_column: str, share: float, most: int, weights: tuple, bucket: int) -> DataFrame:
    """(row, size, source_size, target, copies), the row's own columns in one struct, apart from all names used here."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    of = F.col("row").getField
    keyed = rows.select("row", source_key(of(source_column)).alias("_key"), size_of(of(text_column)).alias("size"), F.xxhash64(of(id_column), of(text_column)).alias("_hash"), of(id_column).alias("_id"))
    classes = materialize(keyed.groupBy("_key", "size").agg(F.count(F.lit(1)).alias("n")), "histogram")
    # at most a row for every `bucket` documents
    large = classes.where(F.col("n") > bucket).select("_key", "size", F.ceil(F.col("n") / bucket).alias("_cuts"))
    keyed = keyed.join(F.broadcast(large), ["_key", "size"], "left").withColumn("_salt", F.pmod("_hash", F.coalesce("_cuts", F.lit(1)))).drop("_cuts")
    count = F.count(F.lit(1)).alias("m")
    buckets = materialize(keyed.groupBy("_key", "size", "_salt").agg(count), "buckets")
    crowded = buckets.where(F.col("m") > 4 * bucket).select("_key", "size", "_salt", F.ceil(F.col("m") / bucket).alias("_cuts"))
    if crowded.isEmpty():
        keyed, buckets = keyed.withColumn("_turn", F.lit(0).cast("long")), buckets.withColumn("_turn", F.lit(0).cast("long"))
    else:
        turn = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.coalesce("_cuts", F.lit(1)))
        keyed = keyed.join(F.broadcast(crowded), ["_key", "size", "_salt"], "left").withColumn("_turn", turn).drop("_cuts")
        buckets = materialize(keyed.groupBy("_key", "size", "_salt", "_turn").agg(count), "buckets")
    sources = classes.groupBy("_key").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("docs"))
    sources = materialize(targets(sources, share, most, weights), "targets")
    shares = allot(classes, solve(classes, sources, most), most)
    # whole-number shares of the class for each of its buckets, in order
    run = Window.partitionBy("_key", "size").orderBy("_salt", "_turn").rowsBetween(Window.unboundedPreceding, 0)
    dealt = buckets.join(shares, ["_key", "size"], "left").withColumns({"n": F.coalesce("n", F.lit(1)), "k": F.coalesce("k", F.lit(0))}).withColumn("_upto", F.sum("m").over(run))
    dealt = dealt.withColumn("_k", F.expr("cast(cast(k as decimal(19,0)) * _upto div n as long) - cast(cast(k as decimal(19,0)) * (_upto - m) div n as long)")).join(sources.select("_key", "source_size", "target"), "_key")
    dealt = materialize(dealt.select("_key", "size", "_salt", "_turn", "m", "_k", "source_size", "target"), "dealt")
    at = ["_key", "size", "_salt", "_turn"]
    place = F.row_number().over(Window.partitionBy(*at).orderBy("_hash", "_id"))
    ranked = keyed.join(dealt, at).withColumn("_place", place)
    copies = F.expr("cast(_k div m + if(_place <= _k % m, 1, 0) as int)")
    return ranked.select("row", "size", "source_size", "target", copies.alias("copies"))


def take(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", share: float = SHARE, most: int = MOST, weights: tuple = WEIGHTS, bucket: int = BUCKET) -> DataFrame:
    """The mix itself: each document as often as its copies say."""
    mixed = _mixed(docs, id_column, text_column, source_column, share, most, weights, bucket)
    return mixed.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def report(docs: DataFrame) -> DataFrame:
    mixed = mix(docs.select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")
