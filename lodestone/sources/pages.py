"""Typed text blocks of web pages, from the pages' tags as rows.

A page is cut into tokens (tags, comments, text), one row each, numbered in page order.
What a parser keeps on a stack is asked of windows over that order: how deep a token lies in
elements of a kind, which one of them is nearest, which run between block tags it is in.

End tags without a start are ignored, start tags without an end part blocks but hold
nothing. Headings, paragraphs, cells and items end where the next block, cell or item begins.
"""

from __future__ import annotations

import html
import unicodedata
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from lodestone.functions.text import nfc

# What a tag's block is called, tags whose text isn't shown, tags that part blocks.
KINDS = {"p": "paragraph", "pre": "code", "figcaption": "caption", "caption": "caption", "li": "list_item", "dt": "list_item", "dd": "list_item"} | {f"h{i}": "heading" for i in range(1, 7)}
HIDDEN = ("title", "template", "noscript")
LISTS = ("ul", "ol", "dl")
ITEMS = ("li", "dt", "dd")
HOLDERS = ("html", "body", "div", "section", "article", "main", "header", "footer", "nav", "aside", *LISTS, "table", "figure", "form", "address", "blockquote")
PARTS = (*KINDS, *HOLDERS, "thead", "tbody", "tfoot", "tr", "td", "th", "hr")

_VALUES = """"[^"]*"|'[^']*'"""
#: Comments; scripts and styles with what they hold; tags and declarations; text.
TOKEN = rf"""(?is)<!--.*?(?:-->|\z)|<(?:script|style)(?:[ \t\n\f\r/](?:[^>"']+|{_VALUES})*)?>.*?(?:</(?:script|style)[ \t\n\f\r]*>|\z)|<[/a-z!?](?:[^>"']+|{_VALUES})*>|[^<]+|<"""
NAME = "^</?([A-Za-z][A-Za-z0-9:-]*)"
ATTRIBUTE = rf"""([^ \t\n\f\r=>/"'<]+)[ \t\n\f\r]*=[ \t\n\f\r]*({_VALUES}|[^ \t\n\f\r"'>]+)"""


@F.arrow_udf(StringType())
def decoded(texts: pa.Array) -> pa.Array:
    """Character references as characters, for which Spark has no function."""
    return pa.array([x and html.unescape(x) for x in texts.to_pylist()], pa.string())


@F.arrow_udf(ArrayType(ArrayType(StringType())))
def composed_rows(rows: pa.Array) -> pa.Array:
    """Cells of tables in composed form, as functions.text.nfc gives texts."""
    return pa.array([x and [[unicodedata.normalize("NFC", c) for c in r] for r in x] for x in rows.to_pylist()], rows.type)


def _collapse(c: Column) -> Column:
    """White space of any kind as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(c, r"[\s\x0B\x1C-\x1F\x85\p{Z}]+", " "))


def _possessive(pattern: str) -> str:
    """The same language without a stack frame for each step of a long tag."""
    return pattern.replace("""(?:[^>"']+|"[^"]*"|'[^']*')*""", """(?:[^>"']++|"[^"]*+"|'[^']*+')*+""")


def tokens(df: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page (a number for each row of df), id, n, text (null for tags), tag, shut (an end tag), id_attr, alt; all of a page in one task.

    Comments, and tags that neither part blocks nor have an id, are left out.
    """
    whole = df.select(df[id_col].alias("id"), df[html_col].alias("html")).withColumn("page", F.monotonically_increasing_id())
    cut = whole.select("page", "id", F.posexplode(F.regexp_extract_all("html", F.lit(_possessive(TOKEN)), F.lit(0))).alias("n", "t"))
    cut = cut.withColumn("tag", F.lower(F.regexp_extract("t", NAME, 1))).withColumn("shut", F.col("t").startswith("</"))
    named = (F.col("tag") != "") & ~F.col("shut") & F.col("t").contains("=")
    cut = cut.withColumn("names", F.when(named, F.transform(F.regexp_extract_all("t", F.lit(ATTRIBUTE), F.lit(1)), F.lower)))
    cut = cut.withColumn("values", F.when(named, F.regexp_extract_all("t", F.lit(ATTRIBUTE), F.lit(2))))
    value = lambda name: F.regexp_replace(F.get("values", F.array_position("names", name).cast("int") - 1), "^[\"']|[\"']$", "")
    cut = cut.withColumn("id_attr", F.nullif(value("id"), F.lit(""))).withColumn("alt", value("alt"))
    text = (F.col("tag") == "") & ~F.col("t").rlike("^<[/!?]")
    cut = cut.where(text | F.col("tag").isin(*PARTS, *HIDDEN, "br", "img") | F.col("id_attr").isNotNull())
    cut = cut.select("page", "id", "n", F.when(text, F.col("t")).alias("text"), "tag", "shut", "id_attr", "alt")
    # decoded where the tokens are cut: it would lose the partitioning by page later on
    return cut.withColumn("text", decoded("text")).withColumn("id_attr", decoded("id_attr")).withColumn("alt", decoded("alt")).repartition("page")


def matched(rows: DataFrame, paired: tuple[str, ...]) -> DataFrame:
    """Rows with turn: 1 for a start tag that has an end, -1 for the end of such a one, else 0; end tags get their start's id_attr and n as open_id and open_at.

    Tags of one name nest among themselves: a start at a depth is ended by the next end at that depth.
    """
    own = Window.partitionBy("page", "tag").orderBy("n")
    step = F.when(F.col("tag").isin(*paired), F.when(F.col("shut"), -1).otherwise(1)).otherwise(0)
    rows = rows.withColumn("sum", F.sum(step).over(own))
    rows = rows.withColumn("depth", F.col("sum") - F.least(F.lit(0), F.min("sum").over(own)))
    before = F.coalesce(F.lag("depth").over(own), F.lit(0))
    rows = rows.withColumn("level", F.when(step == -1, before).otherwise(F.col("depth")))
    pair = Window.partitionBy("page", "tag", "level").orderBy("n")
    up = (step == 1) & F.coalesce(F.lead("shut").over(pair), F.lit(False))
    turn = F.when(up, 1).when((step == -1) & (F.col("level") > 0), -1).otherwise(0)
    rows = rows.withColumn("open_id", F.when(step == -1, F.lag("id_attr").over(pair)).otherwise(F.col("id_attr")))
    rows = rows.withColumn("open_at", F.when(turn == -1, F.lag("n").over(pair))).withColumn("turn", turn)
    return rows.drop("sum", "depth", "level")


def _nearest(rows: DataFrame, name: str, which: Column) -> DataFrame:
    """The nearest element that a row lies in, of those that start where `which` holds (its own start counts), as a struct."""
    level = Window.partitionBy("page", f"{name}_depth").orderBy("n")
    begins = F.when(which, F.struct("n", "id_attr", "holder_depth"))
    return rows.withColumn(name, F.when(F.col(f"{name}_depth") > 0, F.last(begins, ignorenulls=True).over(level)))


def placed(rows: DataFrame) -> DataFrame:
    """Each row with the block it belongs to: block (kind: table, item or run; at: where it begins), row_at, cell_at, and its surroundings."""
    page = Window.partitionBy("page").orderBy("n")
    tag = F.col("tag")
    rows = matched(rows, (*HOLDERS, *HIDDEN))
    starts = F.col("turn") == 1
    kinds = {"hidden": tag.isin(*HIDDEN), "quote": tag == "blockquote", "table": tag == "table", "list": tag.isin(*LISTS), "holder": tag.isin(*HOLDERS)}
    rows = rows.withColumns({f"{k}_depth": F.sum(F.when(which, F.col("turn")).otherwise(0)).over(page) for k, which in kinds.items()})
    state = lambda which, value: F.last(F.when(which, value), ignorenulls=True)
    outer = state((tag == "table") & starts & (F.col("table_depth") == 1), F.col("n")).over(page)
    parts = tag.isin(*PARTS)
    heading = tag.rlike("^h[1-6]$") & ~F.col("shut") & F.col("id_attr").isNotNull()
    top = F.col("table_depth") == 1
    cell = F.struct("n", F.when(tag.isin("td", "th") & ~F.col("shut"), F.col("n")).alias("at"))
    rows = rows.withColumns({
        "outer": F.when(F.col("table_depth") > 0, outer),
        "row_at": state(top & (tag == "tr") & ~F.col("shut"), F.col("n")).over(page),
        "cell": state(top & tag.isin("td", "th", "tr"), cell).over(page),
        "run": F.sum(parts.cast("int")).over(page),
        "head": F.coalesce(state(parts, F.when(~F.col("shut") & tag.isin(*KINDS), tag).otherwise("")).over(page), F.lit("")),
        "heading_id": state(heading, F.col("id_attr")).over(page.rowsBetween(Window.unboundedPreceding, -1)),
    })
    # rows and cells before the table are an earlier one's
    rows = rows.withColumn("row_at", F.when(F.col("row_at") > F.col("outer"), F.col("row_at"))).withColumn("cell_at", F.when(F.col("cell.n") > F.col("outer"), F.col("cell.at")))
    rows = _nearest(rows, "list", kinds["list"] & starts)
    # an item ends at its list's next item tag, or with the list: its state before each row, a list's end being a row of it
    item = F.struct(F.when(~F.col("shut"), F.col("n")).alias("n"), F.col("id_attr"))
    ends = kinds["list"] & (F.col("turn") == -1)
    rows = rows.withColumn("of_list", F.when(ends, F.col("open_at")).otherwise(F.col("list.n")))
    of_list = Window.partitionBy("page", "of_list").orderBy("n")
    before = state(tag.isin(*ITEMS), item).over(of_list.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("before", F.when(F.col("of_list").isNotNull(), before))
    rows = rows.withColumn("item", F.when(F.col("list").isNotNull(), F.when(tag.isin(*ITEMS), item).otherwise(F.col("before"))))
    begun = tag.isin(*ITEMS) & ~F.col("shut") & F.col("id_attr").isNotNull() & F.col("list").isNotNull()
    ended = (tag.isin(*ITEMS) | ends) & F.col("before.n").isNotNull() & F.col("before.id_attr").isNotNull()
    named = kinds["holder"] & F.col("open_id").isNotNull()
    rows = rows.withColumn("named_depth", F.sum(F.when(named, F.col("turn")).otherwise(0) + begun.cast("int") - ended.cast("int")).over(page))
    rows = _nearest(rows, "named", (named & starts) | begun)
    in_item = F.col("item.n").isNotNull() & (F.col("holder_depth") == F.col("list.holder_depth")) & F.col("head").isin("", "p", *ITEMS)
    block = (
        F.when(F.col("outer").isNotNull() & (F.col("head") != "caption"), F.struct(F.lit("table").alias("kind"), F.col("outer").alias("at")))
        .when(in_item, F.struct(F.lit("item").alias("kind"), F.col("item.n").alias("at")))
        .otherwise(F.struct(F.lit("run").alias("kind"), F.col("run").cast("int").alias("at")))
    )
    rows = rows.withColumn("block", block)
    in_table = F.col("block.kind") == "table"
    return rows.withColumn("row_at", F.when(in_table, F.coalesce("row_at", F.lit(-1)))).withColumn("cell_at", F.when(in_table, F.col("cell_at")))


def page_blocks(df: DataFrame, id_col: str = "page_id", html: str = "html", places: bool = False) -> DataFrame:
    """A row for each block of each page: id_col, ordinal, type, level (of headings), fragment, text, rows (of tables).

    An item's text is its own and its paragraphs', what else lies in it follows; a table is
    one block, cells parted by tabs, rows that aren't blank by newlines; text of a table
    outside its cells and its caption is left out. A block of images alone is a figure with
    their alternative texts. fragment is the block's own id, else the first within it, else
    that of the nearest element around it, else of the last heading.

    With places, four more columns: page, place (the number of the token that it begins with),
    and kind and at, which name the block as placed() does.

    A null page has no blocks. Each row of df is a page, repeated rows too. One shuffle, by page.
    """
    rows = placed(tokens(df, id_col, html))
    tag = F.col("tag")
    text = F.col("text").isNotNull()
    begins = ~F.col("shut") & (F.col("id_attr").isNotNull() | tag.isin("td", "th", "tr", *KINDS))
    # a run has the ids of its own tag and of what lies in its text, not of what it lies in
    begins = begins & ((F.col("block.kind") != "run") | ~tag.isin(*HOLDERS, "hr"))
    rows = rows.where("hidden_depth = 0").where(text | tag.isin("br", "img") | begins)
    part = F.when(text, F.col("text")).when(tag == "br", " ").otherwise("")
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", c.alias("x")))), lambda x: x["x"]), "")
    cells = rows.groupBy("page", "id", "block", "row_at", "cell_at").agg(
        joined(part).alias("text"), joined(F.when(tag == "img", F.concat(F.lit(" "), F.coalesce("alt", F.lit(""))))).alias("alts"), F.max(tag == "img").alias("image"),
        F.min(F.when(F.col("id_attr").isNotNull(), F.struct("n", F.col("id_attr").alias("x")))).alias("own"), F.min(F.struct("n", "head", "quote_depth", F.col("named.id_attr").alias("named_id"), "heading_id")).alias("first"),
    )
    cells = cells.withColumn("text", _collapse(F.col("text"))).withColumn("alts", _collapse(F.col("alts")))
    inside = F.col("block.kind") != "table"
    lines = cells.groupBy("page", "id", "block", "row_at").agg(
        F.transform(F.array_sort(F.collect_list(F.when(inside | F.col("cell_at").isNotNull(), F.struct(F.coalesce("cell_at", F.lit(0)).alias("n"), "text", "alts")))), lambda x: F.struct(x["text"].alias("text"), x["alts"].alias("alts"))).alias("cells"),
        F.max("image").alias("image"), F.min("own").alias("own"), F.min("first").alias("first"),
    )
    lines = lines.withColumn("line", F.array_join(F.transform("cells", lambda x: x["text"]), "\t")).withColumn("alts", F.array_join(F.filter(F.transform("cells", lambda x: x["alts"]), lambda x: x != ""), " "))
    cells_of = F.transform("cells", lambda x: x["text"])
    blocks = lines.groupBy("page", "id", "block").agg(
        F.array_sort(F.collect_list(F.struct("row_at", "line", "alts", cells_of.alias("cells")))).alias("lines"), F.max("image").alias("image"), F.min("own").alias("own"), F.min("first").alias("first")
    )
    body = F.array_join(F.filter(F.transform("lines", lambda x: x["line"]), lambda x: F.trim(F.translate(x, "\t", " ")) != ""), "\n")
    alts = F.array_join(F.filter(F.transform("lines", lambda x: x["alts"]), lambda x: x != ""), " ")
    blocks = blocks.withColumn("body", body).where("body <> '' OR image")
    only_image = F.col("body") == ""
    kind, head = F.col("block.kind"), F.col("first.head")
    named = reduce(lambda out, k: out.when(head == k, KINDS[k]), [k for k in KINDS if k != "p"], F.when(kind == "table", "table").when(kind == "item", "list_item"))
    typed = named.when(F.col("first.quote_depth") > 0, "blockquote").when(head == "p", "paragraph").otherwise("other")
    order = Window.partitionBy("page").orderBy(F.when(kind == "run", F.col("first.n")).otherwise(F.col("block.at")), "block")
    return blocks.withColumn("ordinal", F.row_number().over(order) - 1).select(
        F.col("id").alias(id_col),
        "ordinal",
        F.when(only_image, "figure").otherwise(typed).alias("type"),
        F.when(~only_image & (kind == "run") & head.rlike("^h[1-6]$"), F.substring(head, 2, 1).cast("int")).alias("level"),
        F.coalesce("own.x", "first.named_id", "first.heading_id").alias("fragment"),
        nfc(F.when(only_image, alts).otherwise(F.col("body"))).alias("text"),
        composed_rows(F.when(kind == "table", F.filter(F.transform("lines", lambda x: x["cells"]), lambda x: F.size(x) > 0))).alias("rows"),
        *((F.col("page"), F.when(kind == "run", F.col("first.n")).otherwise(F.col("block.at")).alias("place"), kind.alias("kind"), F.col("block.at").alias("at")) if places else ()),
    )
