"""Blocks of pages: random trees written as pages against a walk over the trees, and pages that are no trees."""

import html
import random
import unicodedata

from lodestone.sources import pages as P
from pyspark.sql import functions as F

FIELDS = ("type", "level", "fragment", "text", "rows")


class Tree:
    """A random page and, from the same choices, the blocks it has."""

    def __init__(self, seed):
        self.r, self.ids, self.words, self.heading, self.blocks = random.Random(seed), 0, 0, None, []
        self.html = "<!DOCTYPE html><html><body>" + self.container([], False, 0) + "</body></html>"

    def attribute(self):
        """An id for an element, or none, and how it is written."""
        name = None
        if self.r.random() < 0.3:
            self.ids += 1
            name = f"i{self.ids}"
        return name, (self.r.choice([f' id="{name}"', f" class=x ID='{name}'", f" data-id=no id = {name}"]) if name else self.r.choice(["", ' class="a > b"', ' title="id=q"']))

    def inline(self):
        """html, text, first id, alternative texts."""
        k = self.r.randint(0, 5)
        self.words += 1
        if k == 0:
            name, a = self.attribute()
            return f"<b{a}>w{self.words}</b>", f"w{self.words}", name, []
        if k == 1:
            return "<br/>", " ", None, []
        if k == 2:
            return f'<img alt="A &amp; {self.words}" src=x>', "", None, [f"A & {self.words}"]
        if k == 3:
            return "<!-- <p>no --><script>if (a < b) '<p>'</script>", "", None, []
        text = self.r.choice([" é́ ", " & ", "\n x < y ", f" word{self.words} ", "1&2;"])
        return html.escape(text, quote=False), text, None, []

    def run(self, most=4):
        parts = [self.inline() for _ in range(self.r.randint(0, most))]
        return "".join(x[0] for x in parts), "".join(x[1] for x in parts), next((x[2] for x in parts if x[2]), None), [a for x in parts for a in x[3]]

    def emit(self, kind, text, fragment, alts, level=None, rows=None):
        clean = lambda x: " ".join(x.split())
        text = text if rows is not None else clean(text)
        if not text and alts:
            kind, text, level = "figure", clean(" ".join(alts)), None
        elif not text:
            return
        self.blocks.append({"type": kind, "level": level, "fragment": fragment or self.heading, "text": text, "rows": rows})

    def container(self, above, quote, depth):
        out = []
        for _ in range(self.r.randint(1, 4)):
            body, text, first, alts = self.run()
            self.emit("blockquote" if quote else "other", text, first or (above[-1] if above else None), alts)
            out += [body, self.block(above, quote, depth + 1)]
        return "".join(out)

    def block(self, above, quote, depth, kinds=("p", "h", "pre", "hr")):
        kind = self.r.choice([*kinds, "div", "ul", "table", "blockquote"] if depth < 4 else kinds)
        if kind == "hr":
            return "<hr>"
        name, a = self.attribute()
        inside = [*above, name] if name else above
        if kind in ("p", "h", "pre"):
            body, text, first, alts = self.run()
            tag = f"h{self.r.randint(1, 6)}" if kind == "h" else kind
            level = int(tag[1]) if kind == "h" else None
            fragment = name or first or (above[-1] if above else None)
            self.emit({"p": "blockquote" if quote else "paragraph", "h": "heading", "pre": "code"}[kind], text, fragment, alts, level)
            if kind == "h" and name:
                self.heading = name
            return f"<{tag}{a}>{body}</{tag}>"
        if kind in ("div", "blockquote"):
            tag = self.r.choice(["div", "section", "article"]) if kind == "div" else kind
            return f"<{tag}{a}>{self.container(inside, quote or kind == 'blockquote', depth)}</{tag}>"
        return self.table(name, a, above) if kind == "table" else self.list(a, inside, quote, depth)

    def list(self, a, inside, quote, depth):
        tag, out = self.r.choice(["ul", "ol"]), []
        for _ in range(self.r.randint(1, 3)):
            name, b = self.attribute()
            here = [*inside, name] if name else inside
            body, texts, firsts, alts = [], [], [], []
            at, heading = len(self.blocks), self.heading
            for _ in range(self.r.randint(1, 3)):
                x, text, first, more = self.run(2)
                p = self.r.random() < 0.3
                body.append(f"<p>{x}</p>" if p else x)
                texts.append(text)
                firsts.append(first)
                alts += more
                if depth < 3 and self.r.random() < 0.4:
                    body.append(self.block(here, quote, depth + 1, ("h", "pre", "hr")) if self.r.random() < 0.5 else self.list("", here, quote, depth + 1))
            later, self.blocks = self.blocks[at:], self.blocks[:at]
            now, self.heading = self.heading, heading
            first = name or next((x for x in firsts if x), None) or (inside[-1] if inside else None)
            self.emit("list_item", "".join(texts), first, alts)
            self.blocks, self.heading = self.blocks + later, now
            out.append(f"<li{b}>{''.join(body)}" + self.r.choice(["</li>", ""]))
        return f"<{tag}{a}>{''.join(out)}</{tag}>"

    def table(self, name, a, above):
        rows, first, out, alts = [], None, [], []
        for _ in range(self.r.randint(1, 3)):
            cells, row = [], []
            for _ in range(self.r.randint(1, 3)):
                own, b = self.attribute()
                body, text, inner, more = self.run(3)
                first = first or own or inner
                alts += more
                cells.append(" ".join(text.split()))
                row.append(f"<td{b}>" + self.r.choice([body, f"<p>{body}</p>"]) + self.r.choice(["</td>", ""]))
            rows.append(cells)
            out.append("<tr>" + "".join(row) + self.r.choice(["</tr>", ""]))
        text = "\n".join(x for x in ("\t".join(r) for r in rows) if x.strip())
        fragment = name or first or (above[-1] if above else None)
        if text or alts:
            self.emit("table", text, fragment, alts, rows=rows)
        return f"<table{a}>{''.join(out)}</table>"


def shown(rows):
    out = {}
    for r in rows:
        out.setdefault(r["page_id"], []).append({k: r[k] for k in FIELDS} | {"ordinal": r["ordinal"]})
    return {k: [{f: x[f] for f in FIELDS} for x in sorted(v, key=lambda x: x["ordinal"])] for k, v in out.items()}


def test_random_trees(spark):
    trees = [Tree(i) for i in range(250)]
    df = spark.createDataFrame([(i, t.html) for i, t in enumerate(trees)], "page_id long, html string").withColumn("tag", F.lit("clash")).withColumn("n", F.lit("clash"))
    got = shown(P.page_blocks(df.repartition(5)).collect())
    for i, tree in enumerate(trees):
        want = [x | {"text": unicodedata.normalize("NFC", x["text"]), "rows": x["rows"] and [[unicodedata.normalize("NFC", c) for c in r] for r in x["rows"]]} for x in tree.blocks]
        assert got.get(i, []) == want, tree.html
    assert sum(len(t.blocks) for t in trees) > 1500


def blocks(spark, *pages):
    got = shown(P.page_blocks(spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")).collect())
    return [[(b["type"], b["text"]) for b in got.get(i, [])] for i in range(len(pages))]


def test_pages_that_are_no_trees(spark):
    got = blocks(
        spark,
        "<head><title>t</title></head><body id=top><h2>Head&amp;er</h2><p>One<br>two <b>three<p>Four<ul><li>x<li>y</ul><script>var a='<p>'</script><table><tr><td>c</table></body>",
        "<p>a<![foo[x]]>b<![ >c<!DOCTYPE html>",
        "<head><title>t</title><body><p>Hi",
        "a</div>b</p><div>c<blockquote>d</div>e",
        "<p>open <a href='x>never closed",
        "<title>never shut <p>x",
        "text <!-- never shut <p>x",
        "",
        None,
        "<table><tr><td>a<table><tr><td>b</table>c<td>d</table><dl><dt>t<dd>d</dl>",
        "<p>x<noscript><p>no</p></noscript>y",
    )
    assert got[0] == [("heading", "Head&er"), ("paragraph", "One two three"), ("paragraph", "Four"), ("list_item", "x"), ("list_item", "y"), ("table", "c")]
    assert got[1] == [("paragraph", "abc")] and got[2] == [("other", "t"), ("paragraph", "Hi")] or got[2] == [("paragraph", "Hi")]
    assert got[3] == [("other", "a"), ("other", "b"), ("other", "c"), ("other", "d"), ("other", "e")]
    assert got[4][0][1].startswith("open") and got[6] == [("other", "text")] and got[7] == got[8] == []
    assert ("paragraph", "x") in got[5]
    assert got[9] == [("table", "abc\td"), ("list_item", "t"), ("list_item", "d")]
    assert "no" not in " ".join(x for _, x in got[10])


def test_long_and_deep_pages(spark):
    deep = "<div class=a>" * 3000 + "<p>down" + "</div>" * 3000
    wide = "<p " + " ".join(f"a{i}='{i}'" for i in range(20_000)) + " id=z>attributes"
    long = "<p>" + "x<i>y</i> " * 60_000
    got = shown(P.page_blocks(spark.createDataFrame([(1, deep), (2, wide), (3, long), (3, long)], "page_id long, html string")).collect())
    assert [b["text"] for b in got[1]] == ["down"] and got[2][0]["fragment"] == "z" and got[2][0]["text"] == "attributes"
    assert [len(b["text"]) for b in got[3]] == [60_000 * 3 - 1] * 2


def test_one_shuffle_by_page(spark):
    df = spark.createDataFrame([(1, "<p>x")], "page_id long, html string")
    plan = P.page_blocks(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1
