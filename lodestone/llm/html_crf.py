"""Main text of web pages by a linear-chain conditional random field.

A page is a sequence of leaf blocks: text between the borders that block elements and their
ends make. Features are the tags and class or id words of a block's ancestors, and what
its text looks like. The field labels each block main or other; Viterbi finds the best
labelling. It is trained on labelled pages: those whose markup marks the article itself
(`article`, `main`). They are also shown without that markup, so that text, neighbours and
the rest of the ancestors carry weight too.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

# Tags by what they do to the text around them; any other tag stands within a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html"
    " legend li listing main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
SILENT = frozenset("script style noscript template iframe select textarea title canvas audio video".split())
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
OTHER = frozenset("nav header footer aside form menu dialog".split())
LISTS = frozenset("ul ol li dl dt dd table tbody tr td th".split())
SECTIONS = frozenset("body div section article main aside nav header footer form td".split())
#: Words of a class, id or role that name a part of the page which is no article, and those that name readers' comments.
OTHER_WORD = re.compile(r"(^|[-_])(ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|notice|menu|nav\w*|sidebar|footer|header|share|social|related|breadcrumbs?|popup|modal|newsletter|subscribe|login)([-_]|$)")
COMMENT_WORD = re.compile(r"(^|[-_])(comments?|comment\w*|respond|reviews?|disqus\w*|replies|reactions|discussion|talkback)([-_]|$)")
#: Words that tell a state, or the head of an article, and name no part.
STATE_WORD = re.compile(r"^(no|has|with|without|is|not|hide|show|enable|disable)[-_]|[-_](open|opened|closed|on|off|enabled|disabled|visible|hidden|active|fixed)$|^(entry|post|article|story)[-_]header$")

#: Bits of a feature's number, the most pages to train on, passes over them, step and decay.
BITS, TRAIN_PAGES, PASSES, STEP, DECAY = 14, 160, 30, 0.5, 1e-4
#: Where weights start, against (above 0) and for: parts that training pages may lack, as reader comments, are known by name and place.
PRIOR = {"other-word": 3.0, "of-article:False": 2.0, "of-article:True": -3.0}
#: Characters of the longest page to train on.
TRAIN_CHARS = 200_000
#: Ancestors with words, from the block up, whose words are features, and words taken of each.
NEAR, WORDS = 4, 16


class Node:
    """An open element. What its ancestors mean for it is set by `settle`."""

    __slots__ = ("tag", "words", "above", "named", "comments", "text", "linked", "holds", "outer", "part", "other", "main", "tags", "near", "section")

    def __init__(self, tag: str, words: str, above: Node | None):
        self.tag, self.words, self.above = tag, words.split(), above
        parts = [x for x in self.words if not STATE_WORD.search(x)]
        self.named = any(OTHER_WORD.search(x) for x in parts)
        self.comments = any(COMMENT_WORD.search(x) for x in parts)

    def label(self) -> str:
        """The tag; a list or table that is mostly links is another thing than one of text."""
        return f"{self.tag}-linked" if self.tag in LISTS and 2 * self.linked > self.text else self.tag


def lineage(blocks: list[tuple[Node | None, str, int]]) -> list[Node]:
    """The blocks' elements and all above them, parents first."""
    seen: set[int] = set()
    out: list[Node] = []
    for node, _, _ in blocks:
        chain = []
        while node is not None and id(node) not in seen:
            seen.add(id(node))
            chain.append(node)
            node = node.above
        out += reversed(chain)
    return out


def settle(blocks: list[tuple[Node | None, str, int]], bare: bool = False) -> None:
    """Sets what each element is in its page; bare: as if no tag marked an article.

    The page's article is the outermost `article` or `main` with the most text. Names of
    parts don't count for it and what is above it; without one, for what holds over half of
    the text, or over nine tenths if it is named for comments. Linear in the page.
    """
    nodes = lineage(blocks)
    for node in nodes:
        node.text = node.linked = 0
        node.holds = node.tag in ("html", "body")
        node.outer = not bare and node.tag in ("article", "main")
    for node, text, linked in blocks:
        if node:
            node.text += len(text)
            node.linked += linked
    total = sum(len(text) for _, text, _ in blocks)
    for node in reversed(nodes):
        if node.above:
            node.above.text += node.text
            node.above.linked += node.linked
    within: set[int] = set()
    article = None
    for node in nodes:
        up = node.above
        if up and id(up) in within:
            within.add(id(node))
        elif node.outer:
            within.add(id(node))
            if article is None or node.text > article.text:
                article = node
    if article is None:
        for node in nodes:
            node.holds |= node.text * (10 if node.comments else 2) > total * (9 if node.comments else 1)
    else:
        up = article.above
        while up:
            up.holds, up = True, up.above
    for node in nodes:
        up = node.above
        if node is article:
            node.part = node.other = False
            node.main = True
            own = named = False
        else:
            # the head of the article is its own
            inside = bool(up and up.main)
            named = not node.holds and (node.comments or node.named and not node.outer and not (inside and node.tag == "header"))
            own = named or not node.holds and node.tag in OTHER and not (inside and node.tag == "header")
            node.part = own or bool(up and up.part)
            node.other = named or bool(up and up.other)
            node.main = not node.part and (node.outer or inside)
        tags, node.near = (up.tags, up.near) if up else (frozenset(), ())
        silent = node.holds or bare and node.tag in ("article", "main")
        if not silent:
            label = f"in:{node.label()}"
            tags = tags if label in tags or node.tag not in BLOCK else tags | {label}
            if node.words and node is not article:
                node.near = ((tuple(f"word:{x}" for x in node.words[:WORDS])), *node.near)[:NEAR]
        node.tags = tags
        node.section = node if up is None or node.tag in SECTIONS else up.section


class Leaves(HTMLParser):
    """Leaf blocks of a page: (innermost element, text, characters in links)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[Node] = []
        self.open: Counter = Counter()
        self.silent = 0
        self.blocks: list[tuple[Node | None, str, int]] = []
        self.parts: list[str] = []
        self.linked = 0
        self.node: Node | None = None

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.blocks.append((self.node, text, self.linked))
        self.parts, self.linked = [], 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCK:
            self.flush()
        elif tag == "br":
            self.parts.append(" ")
        if tag in ENDS_P:
            self._close("p", ENDS_P - {"p"} | {"li", "td"})
        elif tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            self._close(tag, {"ul", "ol", "dl", "table"})
        if tag not in VOID:
            names = dict(attrs)
            words = f"{names.get('class') or ''} {names.get('id') or ''} {names.get('role') or ''}".lower().strip()
            self.stack.append(Node(tag, words, self.stack[-1] if self.stack else None))
            self.open[tag] += 1
            self.silent += tag in SILENT

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _pop(self) -> str:
        tag = self.stack.pop().tag
        self.open[tag] -= 1
        self.silent -= tag in SILENT
        return tag

    def _close(self, tag: str, walls: frozenset | set) -> None:
        if not self.open[tag]:
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i].tag == tag:
                while len(self.stack) > i:
                    self._pop()
                return
            if self.stack[i].tag in walls:
                return

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
        if self.open[tag]:
            while self._pop() != tag:
                pass

    def handle_data(self, data: str) -> None:
        if self.silent or self.cdata_elem:
            return
        if not self.parts and data.strip():
            self.node = self.stack[-1] if self.stack else None
        self.parts.append(data)
        if self.open["a"]:
            self.linked += len(data)

    def parse_html_declaration(self, i: int) -> int:
        """Marked sections and other declarations of any form are comments."""
        if self.rawdata.startswith("<!--", i):
            return self.parse_comment(i)
        return self.parse_bogus_comment(i)

    def unended(self) -> None:
        """At the page's end: a tag or comment that isn't ended is no text."""
        if not self.cdata_elem and re.match(r"<[a-zA-Z/!?]", self.rawdata):
            self.rawdata = ""


def leaves(html: str | None) -> list[tuple[Node | None, str, int]]:
    parser = Leaves()
    parser.feed(html or "")
    parser.unended()
    parser.close()
    parser.flush()
    return parser.blocks


def features(blocks: list[tuple[Node | None, str, int]], bare: bool = False, mute: bool = False) -> list[np.ndarray]:
    """Feature numbers of each block; bare: without the tags that mark the article; mute: without those of the text."""
    out = []
    numbers: dict[str, int] = {}

    def number(x: str) -> int:
        got = numbers.get(x)
        if got is None:
            got = numbers[x] = zlib.crc32(x.encode()) & (1 << BITS) - 1
        return got

    settle(blocks, bare)
    total = sum(len(text) for _, text, _ in blocks)
    marked = any(node and node.main for node, _, _ in blocks)
    for node, text, linked in blocks:
        n = len(text)
        found = {"bias"}
        if marked:
            found.add(f"of-article:{bool(node and node.main)}")
        if not mute:
            found |= {f"len:{min(n.bit_length(), 10)}", f"link:{round(4 * linked / n) if n else 0}", f"end:{text[-1] in '.!?…:'}", f"commas:{min(text.count(','), 3)}", f"first:{text[0].isupper()}"}
            found.add(f"mark:{any(c in text for c in '©®|»·')}")
        if node:
            if not mute:
                section = node.section
                found |= {f"share:{4 * section.text // max(total, 1)}", f"links:{round(4 * section.linked / max(section.text, 1))}"}
            if not (bare and node.tag in ("article", "main")):
                found.add(f"parent:{node.label()}")
            found.update(node.tags, *node.near)
            if node.other:
                found.add("other-word")
        out.append(np.array(sorted({number(x) for x in found}), np.int64))
    return out


def labels(blocks: list[tuple[Node | None, str, int]]) -> list[int] | None:
    """1 for blocks within the article that no inner part takes out, else 0; None if the page has no such markup."""
    settle(blocks)
    out = [int(bool(node and node.main)) for node, _, _ in blocks]
    return out if any(out) else None


class Field:
    """Weights of a two-label chain: by feature and label, and by pair of labels."""

    def __init__(self):
        self.w = np.zeros((1 << BITS, 2))
        for x, against in PRIOR.items():
            self.w[zlib.crc32(x.encode()) & (1 << BITS) - 1] = against, -against
        self.t = np.zeros((3, 2))  # from label 0, from label 1, from the start

    def scores(self, feats: list[np.ndarray]) -> np.ndarray:
        return np.array([self.w[f].sum(0) for f in feats])

    def viterbi(self, feats: list[np.ndarray]) -> list[int]:
        if not feats:
            return []
        s = self.scores(feats)
        best, back = s[0] + self.t[2], []
        for row in s[1:]:
            step = best[:, None] + self.t[:2]
            back.append(step.argmax(0))
            best = step.max(0) + row
        path = [int(best.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return path[::-1]

    def gradient(self, feats: list[np.ndarray], gold: list[int], gw: np.ndarray, gt: np.ndarray) -> None:
        """Adds the gradient of the labelling's log probability."""
        s, n = self.scores(feats), len(feats)
        fore, hind = np.zeros((n, 2)), np.zeros((n, 2))
        fore[0] = s[0] + self.t[2]
        for i in range(1, n):
            fore[i] = s[i] + np.logaddexp(fore[i - 1][0] + self.t[0], fore[i - 1][1] + self.t[1])
        for i in range(n - 2, -1, -1):
            both = s[i + 1] + hind[i + 1]
            hind[i] = np.logaddexp(self.t[:2, 0] + both[0], self.t[:2, 1] + both[1])
        total = np.logaddexp(*fore[-1])
        p = np.exp(fore + hind - total)
        for i, f in enumerate(feats):
            gw[f] -= p[i]
            gw[f, gold[i]] += 1
        gt[2] -= p[0]
        gt[2, gold[0]] += 1
        for i in range(1, n):
            gt[:2] -= np.exp(fore[i - 1][:, None] + self.t[:2] + (s[i] + hind[i])[None, :] - total)
            gt[gold[i - 1], gold[i]] += 1


def fit(pages: list[str], passes: int = PASSES) -> Field:
    """Trains on labelled pages, each whole, bare and mute, by AdaGrad over the full gradient.

    Bare ones teach text and other ancestors, mute ones keep those from drowning the markup.
    """
    data = []
    for html in pages:
        blocks = leaves(html)
        if blocks and (gold := labels(blocks)):
            data += [(features(blocks, *view), gold) for view in ((False, False), (True, False), (False, True))]
    field, prior = Field(), Field().w
    hw, ht = np.full_like(field.w, 1e-8), np.full_like(field.t, 1e-8)
    for _ in range(passes if data else 0):
        gw, gt = -DECAY * (field.w - prior), -DECAY * field.t
        for feats, gold in data:
            field.gradient(feats, gold, gw, gt)
        hw += gw**2
        ht += gt**2
        field.w += STEP * gw / np.sqrt(hw)
        field.t += STEP * gt / np.sqrt(ht)
    return field


def train(pages: DataFrame, html: str = "html", id_col: str = "page_id", most: int = TRAIN_PAGES) -> Field:
    """A field trained on at most `most` labelled pages of at most TRAIN_CHARS characters, those of the smallest hashes of the id."""
    marked = pages.where(pages[html].rlike("(?i)<(article|main)[\\s>]") & (F.length(html) <= TRAIN_CHARS)).select(pages[html].alias("html"), F.xxhash64(pages[id_col]).alias("h"))
    # the hashes first, so that tasks don't send pages that aren't taken
    last = marked.select("h").distinct().orderBy("h").limit(most).agg(F.max("h")).first()[0]
    if last is None:
        return fit([])
    rows = marked.where(F.col("h") <= last).limit(2 * most).collect()
    return fit([r["html"] for r in sorted(rows, key=lambda r: (r["h"], r["html"]))[:most]])


def main_text(html: str | None, field: Field) -> str:
    blocks = leaves(html)
    return "\n".join(b[1] for b, keep in zip(blocks, field.viterbi(features(blocks)), strict=True) if keep)


def extract(df: DataFrame, field: Field, html: str = "html", id_col: str = "page_id", carry: tuple[str, ...] = ("url",)) -> DataFrame:
    """The main text of every row's whole page: id_col, the columns in `carry`, text, n_chars.

    A null, empty or blockless page has an empty text. Null ids and repeated rows stay as
    they are; an empty table gives an empty table; other columns are not carried and may
    have any name. Pages may be of any length and need not be well-formed.
    """
    kept = {f"c{i}": name for i, name in enumerate([id_col, *carry])}
    kinds = ", ".join(f"{k} {df.schema[name].dataType.simpleString()}" for k, name in kept.items())

    def run(batch: pa.RecordBatch) -> dict:
        got = [main_text(x, field) for x in batch.column(0).to_pylist()]
        return {k: batch.column(i + 1) for i, k in enumerate(kept)} | {"text": got, "n_chars": [len(x) for x in got]}

    out = map_rows(df.select(df[html].alias("html"), *[df[name].alias(k) for k, name in kept.items()]), run, f"{kinds}, text string, n_chars bigint")
    return out.select(*[F.col(k).alias(name) for k, name in kept.items()], "text", "n_chars")
