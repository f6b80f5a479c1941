"""Links of pages: where they lead, down to the block that holds the place they name.

A link's path is resolved by folding its segments over those of its page's folder; its page
is found by an equi-join on that path. A fragment names an element; the block it leads to is
the one that the element lies in, else the first one after its start: an as-of join, done as
a window over anchors and blocks of a page in one order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources import pages as P


def split_fragment(href: Column) -> tuple[Column, Column]:
    """What stands before and after the first #; no fragment is null."""
    at = F.locate("#", href)
    return F.when(at > 0, F.substring(href, F.lit(1), at - 1)).otherwise(href), F.when(at > 0, F.substring(href, at + 1, F.length(href)))


def resolve(base: Column, href: Column) -> Column:
    """The path that a relative href leads to from a page of path `base`; null where it leads nowhere inside.

    Percent signs are decoded; what has a scheme, begins with a slash or holds a backslash is
    refused, and so is a path that climbs out of the root or is the root itself.
    """
    path = split_fragment(href)[0]
    path = F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    refused = (path == "") | path.contains("://") | path.startswith("/") | path.contains("\\")
    named = lambda a: F.filter(a, lambda s: ~s.isin("", "."))
    folder = F.slice(F.split(base, "/"), F.lit(1), F.size(F.split(base, "/")) - 1)
    none = F.lit(None).cast("array<string>")
    walked = F.aggregate(
        F.concat(named(folder), named(F.split(path, "/"))),
        F.array().cast("array<string>"),
        lambda at, s: F.when(at.isNull() | ((s == "..") & (F.size(at) <= 0)), none).when(s == "..", F.slice(at, F.lit(1), F.size(at) - 1)).otherwise(F.concat(at, F.array(s))),
    )
    return F.when(~refused, F.nullif(F.array_join(walked, "/"), F.lit("")))


def links(pages: DataFrame, path: str = "path", html: str = "html") -> DataFrame:
    """Every link of every page in page order: path, ordinal (from 0), href."""
    starts = F.filter(F.regexp_extract_all(pages[html], F.lit(P._possessive(P.TOKEN)), F.lit(0)), lambda t: t.rlike(r"(?i)^<a[ \t\n\f\r/]"))
    found = pages.select(pages[path].alias("path"), F.posexplode(starts).alias("ordinal", "token"))
    names = F.transform(F.regexp_extract_all("token", F.lit(P.ATTRIBUTE), F.lit(1)), F.lower)
    value = F.get(F.regexp_extract_all("token", F.lit(P.ATTRIBUTE), F.lit(2)), F.array_position(names, "href").cast("int") - 1)
    found = found.select("path", "ordinal", F.regexp_replace(value, "^[\"']|[\"']$", "").alias("href")).where("href IS NOT NULL")
    return found.withColumn("href", P.decoded("href"))


def anchors(pages: DataFrame, path: str = "path", html: str = "html") -> DataFrame:
    """Every named element of every page with the block it leads to: path, fragment, block (its ordinal; null after the last).

    The first element of a name counts. An element in no block leads to the next one that
    begins after it.
    """
    rows = P.placed(P.tokens(pages, path, html)).select("page", "id", "n", "id_attr", "shut", F.col("block.kind").alias("kind"), F.col("block.at").alias("at"))
    named = rows.where("NOT shut AND id_attr IS NOT NULL").groupBy("page", "id", "id_attr").agg(F.min(F.struct("n", "kind", "at")).alias("first"))
    named = named.select("page", F.col("id").alias("path"), F.col("id_attr").alias("fragment"), "first.n", "first.kind", "first.at")
    blocks = P.page_blocks(pages, path, html, places=True).select("page", "ordinal", "place", "kind", "at")
    inside = named.join(blocks.select("page", "kind", "at", F.col("ordinal").alias("own")), ["page", "kind", "at"], "left")
    both = inside.select("page", "path", "fragment", "n", "own", F.lit(None).cast("int").alias("ordinal"))
    both = both.unionByName(blocks.select("page", F.col("place").alias("n"), "ordinal"), allowMissingColumns=True)
    after = Window.partitionBy("page").orderBy("n").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    found = both.withColumn("next", F.first("ordinal", ignorenulls=True).over(after)).where("fragment IS NOT NULL")
    return found.select("path", "fragment", F.coalesce("own", "next").alias("block"))


def references(pages: DataFrame, path: str = "path", html: str = "html") -> DataFrame:
    """Every link with where it leads: path, ordinal, href, target (a page's path, null outside), fragment, found (whether there is such a page), block.

    A link of a fragment alone stays in its page. block is null where the page has no such
    name. Paths of pages are unlike each other.
    """
    all_links = links(pages, path, html)
    before, fragment = split_fragment(F.col("href"))
    all_links = all_links.withColumn("target", F.when(before == "", F.col("path")).otherwise(resolve(F.col("path"), F.col("href")))).withColumn("fragment", fragment)
    known = pages.select(pages[path].alias("target"), F.lit(True).alias("found")).distinct()
    named = anchors(pages, path, html).select(F.col("path").alias("target"), "fragment", "block")
    out = all_links.join(known, "target", "left").join(named, ["target", "fragment"], "left")
    return out.select("path", "ordinal", "href", "target", "fragment", F.coalesce("found", F.lit(False)).alias("found"), "block")


def back_links(references: DataFrame) -> DataFrame:
    """How many links, from how many pages, lead to each page and block: target, block, n_links, n_pages."""
    led = references.where("found").groupBy("target", "block", "path").agg(F.count("*").alias("n"))
    return led.groupBy("target", "block").agg(F.sum("n").alias("n_links"), F.count("*").alias("n_pages"))
