"""Benchmark decontamination by a broadcast hash set of normalised n-grams.

Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing
A-Z.  Every run of ``n`` consecutive words of an item is a window; an item of
fewer words, but at least one, is a single window.  All windows of a document
are hashed inside the explode's generated code, probed against the broadcast
set, and each hit is verified word by word, so hash collisions change nothing.

Edge cases: null and empty texts have no words and no hits; null item texts
have no windows; repeated documents are separate rows; null ids are kept; an
empty benchmark leaves every document clean; other columns are untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.common import lower_ascii, materialize

#: What splits words once A-Z are lower-cased (fixed by the contract).
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Windows, and bytes of them and their item ids, that a broadcast may hold; a larger set is probed block by block.
MOST_WINDOWS, MOST_BYTES = 1_000_000, 128 << 20


def words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(text), SEPARATORS), "")


def benchmark_windows(benchmark: DataFrame, n: int = 8) -> DataFrame:
    """(k, window, hash, items): each distinct window of k words and the item ids that hold it."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w"))
    items = items.where(F.size("w") > 0).withColumn("k", F.least(F.size("w"), F.lit(n)))
    each = items.select("item", "k", F.explode(F.expr("transform(sequence(0, size(w) - k), i -> slice(w, i + 1, k))")).alias("window"))
    return each.groupBy("k", "window").agg(F.collect_set("item").alias("items")).withColumn("hash", F.expr("xxhash64(window)"))


def _probe(docs: DataFrame, windows: DataFrame, sizes: list[int]) -> DataFrame:
    """One row per hit (and one without a hit per document): _row, _n, pos, k, items."""

    def key(k: int) -> str:
        # an array hashes like its elements in turn, so this equals xxhash64(window)
        return f"if(_pos + {k} <= _n, xxhash64({', '.join(f'get(_w, _pos + {j})' for j in range(k))}), null)"

    at = docs.select("*", F.posexplode_outer("_w").alias("_pos", "_word"))
    if len(sizes) == 1:
        probes = at.withColumn("_k", F.lit(sizes[0])).withColumn("_hash", F.expr(key(sizes[0])))
    else:
        probes = at.select("*", F.inline(F.array(*[F.struct(F.lit(k).alias("_k"), F.expr(key(k)).alias("_hash")) for k in sizes])))
    # two inequalities: an equality of arrays would become a join key, built for every window rather than for hits
    hit = (F.col("_hash") == F.col("hash")) & F.expr("_k <= k and _k >= k and slice(_w, _pos + 1, _k) <= window and slice(_w, _pos + 1, _k) >= window")
    found = probes.join(F.broadcast(windows), hit, "left")
    return found.where("k is not null or coalesce(_pos, 0) = 0")


def _scan(docs: DataFrame, benchmark: DataFrame, n: int, text_column: str, kept: list[str], most_windows: int) -> DataFrame:
    """(_kept, n_words, n_hit, item_ids, spans), the columns ``kept`` in one struct, apart from all names used here.

    The hits of a document meet in one row; they are no more than its words
    times the window sizes, so no group grows with the corpus.
    """
    windows = materialize(benchmark_windows(benchmark, n), "windows")
    held = F.octet_length(F.concat_ws(" ", "window")) + F.octet_length(F.concat_ws(" ", "items")) + 16 * (F.col("k") + F.size("items"))
    sizes, count, size = windows.agg(F.sort_array(F.collect_set("k")), F.count(F.lit(1)), F.coalesce(F.sum(held), F.lit(0))).first()
    base = docs.select(F.monotonically_increasing_id().alias("_row"), F.struct(*[F.col(f"`{c}`") for c in kept], F.lit(0).alias("_")).alias("_kept"), words(F.col(text_column)).alias("_w"))
    base = base.withColumn("_n", F.size("_w"))
    if not count:
        none = F.array().cast("array<struct<start:int,length:int>>")
        return base.select("_kept", F.col("_n").cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("item_ids"), none.alias("spans"))
    blocks = max(-(-count // most_windows), -(-size // MOST_BYTES))
    if blocks > 1:  # rows need one number in every block's scan
        base = materialize(base, "words")
    hits = None
    for b in range(blocks):
        part = windows.where(F.pmod("hash", F.lit(blocks)) == b) if blocks > 1 else windows
        found = _probe(base, part, sizes)
        found = found.select("_row", "_kept", "_n", F.when(F.col("k").isNotNull(), F.struct(F.col("_pos").alias("start"), F.col("k").alias("length"))).alias("span"), "items")
        hits = found if hits is None else hits.unionAll(found)
    one = hits.groupBy("_row").agg(F.first("_kept").alias("_kept"), F.max("_n").alias("_n"), F.sort_array(F.collect_set("span")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("item_ids"))
    covered = """aggregate(spans, named_struct('upto', 0, 'sum', 0),
        (a, s) -> named_struct('upto', greatest(a.upto, s.start + s.length), 'sum', a.sum + greatest(0, s.start + s.length - greatest(a.upto, s.start))),
        a -> cast(a.sum as long))"""
    return one.select("_kept", F.col("_n").cast("long").alias("n_words"), F.expr(covered).alias("n_hit"), "item_ids", "spans")


def scan(docs: DataFrame, benchmark: DataFrame, n: int = 8, text_column: str = "text", most_windows: int = MOST_WINDOWS) -> DataFrame:
    """``docs`` without its text, plus n_words, n_hit, item_ids (sorted strings) and spans (start, length in words)."""
    kept = [c for c in docs.columns if c.lower() not in (text_column.lower(), "n_words", "n_hit", "item_ids", "spans")]
    return _scan(docs, benchmark, n, text_column, kept, most_windows).select(*[F.col("_kept").getField(c).alias(c) for c in kept], "n_words", "n_hit", "item_ids", "spans")


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 8, least_items: int = 2, text_column: str = "text", remove: str = "documents", most_windows: int = MOST_WINDOWS) -> DataFrame:
    """Documents without contamination.

    ``remove="documents"`` drops documents with windows of ``least_items`` or
    more items.  ``remove="spans"`` keeps every document and cuts the hit words
    (with the separators before them) out of its text.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove is 'documents' or 'spans'")
    got, of = _scan(docs, benchmark, n, text_column, docs.columns, most_windows), F.col("_kept").getField
    if remove == "documents":
        return got.where(F.size("item_ids") < least_items).select(*[of(c).alias(c) for c in docs.columns])
    # raw words, and what stands before each of them; the last has the tail after it
    raw = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    got = got.withColumn("_raw", F.regexp_extract_all(of(text_column), F.lit(f"({raw})"), F.lit(1)))
    tail = F.regexp_extract(of(text_column), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*\z", 0)
    keep = F.expr("filter(_raw, (x, i) -> not exists(spans, s -> i >= s.start and i < s.start + s.length))")
    text = F.when(F.size("spans") == 0, of(text_column)).otherwise(F.concat(F.array_join(keep, ""), tail))
    return got.select(*[(text if c == text_column else of(c)).alias(c) for c in docs.columns])


def report(docs: DataFrame, benchmark: DataFrame, n: int = 8, least_items: int = 2) -> DataFrame:
    got = scan(docs.select("doc_id", "text"), benchmark, n)
    return got.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.size("item_ids") >= least_items).alias("contaminated"),
    )
