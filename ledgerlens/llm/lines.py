"""Boilerplate lines by their frequency within a site.

Pages are grouped by host.  A line that stands on more than `most` of a host's pages, and on at least `least_pages`
of them, is boilerplate there and is dropped from every page of that host.  A line counts once for each page that
has it, however often it is repeated on it.

Lines are counted by a 128-bit hash, after map-side combining, so neither texts nor the pages of a host are
gathered; only lines that reach `least_pages` go on.  As a line is boilerplate only above a share of the host's pages,
a host has at most 1 / `most` times as many such lines as its pages have on average.  While all of them are few they
are sent to the pages, which are cleaned in place; beyond, the pages' lines are matched with them and pages
and cuts are merged by key.  Both ways give the same rows.

Defined results: lines are separated by a line feed and compared as they stand; empty lines are never dropped; null
hosts form one host; a null text has no lines and stays null; repeated rows count as pages; ties at the ratio
stay; other columns pass through whatever their names, and the added column replaces one of its name; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.shared import BROADCAST_KEYS, unused
from ledgerlens.scratch import written


def _hashes(value: str | Column, prefix: str) -> list[Column]:
    return [F.xxhash64(F.lit(seed), value).alias(f"{prefix}{seed}") for seed in (1, 2)]


def boilerplate(pages: DataFrame, host: str, text: str, most: float, least_pages: int) -> DataFrame:
    """Rows (host, line1, line2, pages, ratio): the hashes of boilerplate lines."""
    each = pages.select(F.col(host).cast("string").alias("host"), F.explode(F.array_distinct(F.split(text, "\\n"))).alias("line")).where("line <> ''")
    counts = each.select("host", *_hashes("line", "line")).groupBy("host", "line1", "line2").agg(F.count("*").alias("pages")).where(F.col("pages") >= least_pages)
    totals = written(pages.select(F.col(host).cast("string").alias("of")).groupBy("of").agg(F.count("*").alias("total")))
    ratio = F.col("pages") / F.col("total")
    joined = written(counts).join(totals, F.col("host").eqNullSafe(F.col("of")))
    return joined.select("host", "line1", "line2", "pages", ratio.alias("ratio")).where(F.col("ratio") > most)


def drop_boilerplate(pages: DataFrame, host: str = "host", text: str = "text", most: float = 0.05, least_pages: int = 3, dropped: str = "dropped_lines") -> DataFrame:
    """`pages` with boilerplate lines taken out of `text`, and their number in `dropped`."""
    pages = pages.drop(*[c for c in pages.columns if c.lower() == dropped.lower()])
    found = written(boilerplate(pages, host, text, most, least_pages).select("host", "line1", "line2"))
    few = found.count() <= BROADCAST_KEYS
    marked, cut = (_few_cuts if few else _merged_cuts)(pages, found, host, text)
    rest = F.array_join(F.filter(F.split(text, "\\n"), lambda line, i: ~F.array_contains(cut, i)), "\n")
    cleaned = F.when(F.coalesce(F.size(cut), F.lit(0)) == 0, F.col(text)).otherwise(rest)
    return marked.select(*[cleaned.alias(c) if c == text else F.col(c) for c in pages.columns], F.when(cut.isNull(), 0).otherwise(F.size(cut)).alias(dropped))


def _few_cuts(pages: DataFrame, found: DataFrame, host: str, text: str) -> tuple[DataFrame, Column]:
    """Pages, each with the places of its boilerplate lines, by sending every host's boilerplate to the pages."""
    of, firsts, whole, name = unused(pages.columns, "_host", "_firsts", "_bad", "_cut")
    each = found.groupBy(F.col("host").alias(of)).agg(F.collect_set("line1").alias(firsts), F.collect_list(F.struct("line1", "line2")).alias(whole))
    joined = pages.join(F.broadcast(each), F.col(host).cast("string").eqNullSafe(F.col(of)), "left")
    # the sets are compared by hash tables; only lines of a page that has some are looked up one by one
    lines = F.split(text, "\\n")
    hit = F.array_intersect(F.transform(lines, lambda x: F.xxhash64(F.lit(1), x)), firsts)
    bad = lambda x: (x != "") & F.array_contains(whole, F.struct(F.xxhash64(F.lit(1), x).alias("line1"), F.xxhash64(F.lit(2), x).alias("line2")))
    places = F.filter(F.transform(lines, lambda x, i: F.when(bad(x), i)), lambda i: i.isNotNull())
    return joined.withColumn(name, F.when(F.size(hit) > 0, places)).drop(of, firsts, whole), F.col(name)


def _merged_cuts(pages: DataFrame, found: DataFrame, host: str, text: str) -> tuple[DataFrame, Column]:
    """The same by matching the lines of the pages, and by merging pages and cuts."""
    key = [F.col(host).cast("string").alias("host"), *_hashes(F.col(text), "page")]
    lines = pages.select(*key, F.posexplode(F.split(text, "\\n")).alias("pos", "line")).where("line <> ''")
    lines = lines.select("host", "page1", "page2", "pos", *_hashes("line", "line"))
    same = F.col("host").eqNullSafe(F.col("host_of")) & (F.col("line1") == F.col("l1")) & (F.col("line2") == F.col("l2"))
    hit = lines.join(found.select(F.col("host").alias("host_of"), F.col("line1").alias("l1"), F.col("line2").alias("l2")), same, "left_semi")
    # pages of one host with equal texts lose the same lines, so the text's hash serves as their key
    cut = written(hit.groupBy("host", "page1", "page2").agg(F.collect_set("pos").alias("cut")))
    own = unused(pages.columns, "_h", "_page1", "_page2", "_host", "_p1", "_p2", "_cut")
    h, page1, page2, of, p1, p2, name = own
    cut = cut.select(F.col("host").alias(of), F.col("page1").alias(p1), F.col("page2").alias(p2), F.col("cut").alias(name))
    marked = pages.select("*", F.col(host).cast("string").alias(h), *[c.alias(n) for c, n in zip(_hashes(F.col(text), "page"), (page1, page2))])
    joined = marked.join(cut.hint("merge"), F.col(h).eqNullSafe(F.col(of)) & (F.col(page1) == F.col(p1)) & (F.col(page2) == F.col(p2)), "left")
    return joined, F.col(name)
