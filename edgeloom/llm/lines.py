"""Line dedup by site-relative frequency.

A line is boilerplate of its host where more than ``ratio`` of the host's pages
hold it, and ``least_pages`` of them at least: what one or two pages hold is no
boilerplate, however few the host has.  Hosts of all sizes are judged alike.

The lines of each page are extracted once and written to the shared folder.
Counts combine before the shuffle, so a host or line of a third of all rows is
no burden.  Each boilerplate line of a host stands on more than ``ratio`` of its
pages, so there are fewer of them than a page's mean number of distinct lines
over ``ratio``: they fit in one row a host, whatever its pages.  Pages of the
hosts that hold more than a thousandth of all pages, of which there are fewer
than a thousand, meet that row under ``SALTS`` salts.

Edge cases: null and empty pages have no lines; pages without a host (null or
relative URLs) share the empty one; repeated rows count as pages each; an empty
table gives no rows; other columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.common import materialize

#: Salts of a large host, and the share of all pages that makes a host large.
SALTS, LARGE = 128, 1000
#: What is no text, what breaks lines, and what is markup inside a line.
NO_TEXT = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<title\b.*?</title\s*>|<!--.*?-->"
BREAKS = r"(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|table|tr|nav|article|section|header|footer|body|html|head|main|aside|pre|blockquote|hr)\b[^>]*>"
MARKUP = r"<[^>]*>"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def lines_of(html: Column) -> Column:
    """The lines of the visible text, broken at every block's edge, without space at their ends."""
    t = F.regexp_replace(F.coalesce(html, F.lit("")), NO_TEXT, " ")
    t = F.regexp_replace(F.regexp_replace(t, BREAKS, "\n"), MARKUP, "")
    return F.array_remove(F.split(F.trim(t), r"[ \t\r\f\x0B]*\n\s*"), "")


def boilerplate(pages: DataFrame, totals: DataFrame, ratio: float = 0.1, least_pages: int = 3) -> DataFrame:
    """(host, drop): the hashes of each host's boilerplate lines, from (host, lines) and (host, pages)."""
    line = pages.select("host", F.explode(F.array_distinct("lines")).alias("line"))
    # two hashes tell lines apart; the lines themselves needn't be dealt out
    seen = line.groupBy("host", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    common = seen.where(F.col("n") >= least_pages).join(totals, "host").where(F.col("n") > ratio * F.col("pages"))
    return common.groupBy("host").agg(F.collect_set(F.concat_ws(".", "a", "b")).alias("drop"))


def drop_lines(pages: DataFrame, ratio: float = 0.1, least_pages: int = 3, url_column: str = "url", html_column: str = "html") -> DataFrame:
    """``pages`` without its html, plus host, n_lines, n_dropped and clean_text."""
    added = ("host", "n_lines", "n_dropped", "clean_text")
    kept = [c for c in pages.columns if c.lower() not in (html_column.lower(), *added)]
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in kept], F.lit(0).alias("_")).alias("_kept"), host_of(F.col(url_column)).alias("host"), lines_of(F.col(html_column)).alias("lines"))
    rows = materialize(rows, "lines")
    totals = materialize(rows.groupBy("host").agg(F.count(F.lit(1)).alias("pages")), "hosts")
    everything = totals.agg(F.sum("pages")).first()[0] or 0
    large = totals.where(F.col("pages") * LARGE > everything).select("host", F.lit(True).alias("_large"))  # under LARGE rows
    drop = boilerplate(rows, totals, ratio, least_pages).join(F.broadcast(large), "host", "left")
    salts = F.when(F.col("_large"), F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    drop = drop.select("host", "drop", F.explode(salts).alias("_salt"))
    salted = rows.join(F.broadcast(large), "host", "left").withColumn("_salt", F.when(F.col("_large"), F.pmod(F.xxhash64("lines"), F.lit(SALTS).cast("long"))).otherwise(F.lit(0).cast("long"))).drop("_large")
    met = salted.join(drop, ["host", "_salt"], "left")
    # a hash set first leaves the page's own boilerplate lines, then each line is held against those few
    name = "concat_ws('.', xxhash64(x), xxhash64(1, x))"
    met = met.withColumn("_gone", F.when(F.col("drop").isNotNull(), F.expr(f"array_intersect(transform(lines, x -> {name}), drop)")))
    keep = F.when(F.coalesce(F.size("_gone"), F.lit(0)) <= 0, F.col("lines")).otherwise(F.expr(f"filter(lines, x -> not array_contains(_gone, {name}))"))
    met = met.withColumn("_keep", keep)
    return met.select(
        *[F.col("_kept").getField(c).alias(c) for c in kept], "host", F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("_keep")).cast("long").alias("n_dropped"), F.array_join("_keep", "\n").alias("clean_text"),
    )


def report(pages: DataFrame) -> DataFrame:
    got = drop_lines(pages.select("page_id", "url", "html"))
    return got.select("page_id", "host", "n_lines", "n_dropped", F.sha2("clean_text", 256).alias("text_sha256"))
