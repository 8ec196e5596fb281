"""HTML extraction by composite text density.

A page becomes a tree, from which what is no article by its tag, or by the words of its class, id
or role, is cut off. Each node's density is its characters per tag, adjusted for the characters and
tags that are links; its density sum is that of its children's densities. The subtree with the
largest sum is the article. The smallest density on the path from it up to the body is the
threshold: elsewhere, a node that reaches it adds the subtree with the largest sum beneath it.

Pages are independent: there is no shuffle, and a task holds a batch of pages, or one page however long.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import steps

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that an opened one of these kinds ends, up to the elements that hold them.
ENDS = {
    **dict.fromkeys(BLOCKS - set("body caption dd dt head html li optgroup option tbody td tfoot th thead tr".split()), ({"p"}, {"table", "td", "th", "button", "caption"})),
    "li": ({"li", "p"}, {"ul", "ol", "menu", "dir", "table", "td", "th"}),
    **dict.fromkeys(("dd", "dt"), ({"dd", "dt", "p"}, {"dl", "table", "td", "th"})),
    **dict.fromkeys(("option", "optgroup"), ({"option"}, {"select", "datalist"})),
    **dict.fromkeys(("td", "th"), ({"td", "th"}, {"table", "tr"})),
    "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}),
    **dict.fromkeys(("tbody", "thead", "tfoot"), ({"tbody", "thead", "tfoot"}, {"table"})),
    "body": ({"head"}, set()),
}
#: Never part of an article.
DROPPED = frozenset("head title script style noscript template iframe object embed applet svg canvas audio video map nav menu footer aside form button input select textarea datalist dialog search".split())
#: Marks of what surrounds articles, as words of class, id and role.
AROUND = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense banner banners sponsor sponsored promo promos promotion "
    "cookie cookies consent gdpr notice notices alert popup popups modal overlay newsletter subscribe subscription signup paywall "
    "sidebar sidebars rail widget widgets complementary menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager toolbar topbar skip search login "
    "header masthead footer contentinfo copyright share sharing social related recommended recommendations form".split()
)
#: Marks of what readers wrote.
READERS = frozenset("comment comments commentlist disqus respond reply replies discussion".split())
#: Elements that an article's heart is known by: what holds one is no surrounding, whatever its marks.
HEART = frozenset("main h1".split())

_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])|[^A-Za-z]+")
_TAG = re.compile(r"<(?:[A-Za-z/!?]|$)")


def whole_tags(html: str) -> str:
    """html without a comment or tag that its end cuts off."""
    comment = html.rfind("<!--")
    if comment >= 0 and html.find("-->", comment) < 0:
        html = html[:comment]
    tag = html.rfind("<")
    return html[:tag] if tag >= 0 and html.find(">", tag) < 0 and _TAG.match(html, tag) else html


class Page(HTMLParser):
    """The page's nodes in their order: parent, tag, marks, and texts (node, text), in which None stands for the edge of a block."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.parent, self.tags, self.marks = [-1], [""], [frozenset()]
        self.open, self.pieces = [0], []
        self.feed(whole_tags(html))
        self.close()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        ended, holders = ENDS.get(tag, (set(), set()))
        for depth in range(len(self.open) - 1, 0, -1):
            name = self.tags[self.open[depth]]
            if name in ended:
                self.close_to(depth)
            elif name in holders:
                break
        if tag in BLOCKS:
            self.pieces.append((self.open[-1], None))
        elif tag == "br":
            self.pieces.append((self.open[-1], " "))
        told = " ".join(v for k, v in attrs if v and k in ("class", "id", "role"))
        self.parent.append(self.open[-1])
        self.tags.append(tag)
        self.marks.append(frozenset(w.lower() for w in _CAMEL.split(told)) if told else frozenset())
        if tag not in VOID:
            self.open.append(len(self.tags) - 1)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # a slash means nothing in HTML

    def handle_endtag(self, tag: str) -> None:
        for depth in range(len(self.open) - 1, 0, -1):
            if self.tags[self.open[depth]] == tag:
                self.close_to(depth)
                return
        if tag == "br":
            self.pieces.append((self.open[-1], " "))

    def close_to(self, depth: int) -> None:
        for node in reversed(self.open[depth:]):
            if self.tags[node] in BLOCKS:
                self.pieces.append((node, None))
        del self.open[depth:]

    def handle_data(self, data: str) -> None:
        self.pieces.append((self.open[-1], data))


def kept_nodes(page: Page) -> list[bool]:
    """Which nodes are left once surroundings and readers' words are cut off with all that is in them."""
    n = len(page.tags)
    heart, article = [tag in HEART for tag in page.tags], [False] * n  # in the subtree; beneath the node
    for k in range(n - 1, 0, -1):  # children follow their parents
        up = page.parent[k]
        heart[up] = heart[up] or heart[k]
        article[up] = article[up] or article[k] or page.tags[k] in ("article", "main")
    alone = page.tags.count("article") == 1
    kept, inside = [True] * n, [False] * n
    for k in range(1, n):
        up, tag, marks = page.parent[k], page.tags[k], page.marks[k]
        inside[k] = inside[up] or tag in ("article", "main")
        if tag == "form":
            gone = not (heart[k] or article[k])  # some pages are one form
        elif tag == "header":
            gone = not inside[k] and not article[k]
        else:
            gone = tag in DROPPED
        if tag not in ("html", "body"):
            gone = gone or (bool(marks & READERS) and not heart[k])
            gone = gone or (bool(marks & AROUND) and not (heart[k] or article[k] or (tag == "article" and alone)))
        kept[k] = kept[up] and not gone
    return kept


def densities(parent: list[int], tags: list[str], chars: list[int], body: int) -> list[float]:
    """Composite text density of each node: characters per tag, weighed by how few of both are links.

    The nodes' own characters are given; counts include what is beneath them, and a count of 0 counts as 1.
    """
    n = len(tags)
    count, links = list(chars), [tag == "a" for tag in tags]
    linked = [0] * n
    number, anchors = [0] * n, [0] * n
    within = [False] * n
    for k in range(n):
        within[k] = links[k] or (k > 0 and within[parent[k]])
        linked[k] = chars[k] if within[k] else 0
    for k in range(n - 1, 0, -1):
        up = parent[k]
        count[up] += count[k]
        linked[up] += linked[k]
        number[up] += number[k] + 1
        anchors[up] += anchors[k] + links[k]
    whole = linked[body] / max(1, count[body])
    out = []
    for c, lc, t, lt in zip(count, linked, number, anchors, strict=True):
        base = math.log(c / max(1, c - lc) * lc + whole * c + math.e)
        inner = c / max(1, lc) * max(1, t) / max(1, lt)
        # a base near 1 and an inner part below 1 are both of nodes that are links and little else
        out.append(c / max(1, t) * max(0.0, math.log(inner) / math.log(base)) if c and base > 1 and inner > 0 else c / max(1, t) if c else 0.0)
    return out


def article_nodes(page: Page) -> list[bool]:
    """Which nodes belong to the article."""
    kept, n = kept_nodes(page), len(page.tags)
    # a parent that is cut off leaves no child, so what is left is a tree
    index = [k for k in range(n) if kept[k]]
    new = {k: i for i, k in enumerate(index)}
    parent, tags = [new.get(page.parent[k], -1) for k in index], [page.tags[k] for k in index]
    chars = [0] * len(index)
    for node, text in page.pieces:
        if text and kept[node]:
            chars[new[node]] += sum(map(len, text.split()))
    body = next((i for i, tag in enumerate(tags) if tag == "body"), 0)
    dense = densities(parent, tags, chars, body)
    size = len(index)
    sums, best = [0.0] * size, list(range(size))
    for k in range(size - 1, 0, -1):
        sums[parent[k]] += dense[k]
    for k in range(size - 1, 0, -1):  # best[k]: the node of the largest sum in k's subtree, the outermost of equals
        up = parent[k]
        if sums[best[k]] > sums[best[up]] or (sums[best[k]] == sums[best[up]] and best[up] != up and best[k] < best[up]):
            best[up] = best[k]
    chosen = [False] * size
    top = best[body]
    path = [top]
    while path[-1] != body and parent[path[-1]] >= 0:
        path.append(parent[path[-1]])
    # markup that names the article says where it ends
    named = [k for k in path if tags[k] == "article"] or [k for k in path if tags[k] == "main"]
    chosen[named[-1] if named else top] = True
    least = min(dense[k] for k in path)
    reached = [False] * size
    for k in range(body, size):
        up = parent[k]
        chosen[k] = chosen[k] or (up >= body and chosen[up])
        reached[k] = (k == body or (up >= 0 and reached[up])) and dense[k] >= least and dense[k] > 0
        if reached[k] and not named:
            chosen[best[k]] = True
    for k in range(1, size):
        chosen[k] = chosen[k] or chosen[parent[k]]
    out = [False] * n
    for i, k in enumerate(index):
        out[k] = chosen[i]
    return out


def main_text(html: str) -> str:
    """The text of a page's article: white space is one space, blocks stand apart by an empty line."""
    page = Page(html)
    chosen, blocks, here = article_nodes(page), [], []
    for node, text in page.pieces:
        if text is None:
            if here:
                blocks.append(here)
                here = []
        elif chosen[node]:
            here.append(text)
    blocks.append(here)
    return "\n\n".join(b for b in (" ".join("".join(parts).split()) for parts in blocks) if b)


def html_extraction(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages, with text (the article; empty if there is none) and n_chars (its code points) in place of html.

    Null and empty pages have an empty text; a page without markup is its own article. Tags that are
    missing, crossed or cut off are read as browsers do. Repeated rows are each returned, no rows
    give no rows; other columns pass, but for ones named text or n_chars, which are replaced. Of
    equal density sums the outermost, then the first node counts.
    """
    rest = [c for c in pages.columns if c not in (html, "text", "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, html):
            texts = [main_text(h) if h else "" for h in batch.column(html).to_pylist()]
            columns = [*(batch.column(c) for c in rest), pa.array(texts, pa.large_string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*rest, "text", "n_chars"])

    kinds = pages.select(*rest).schema
    return pages.select(*rest, html).mapInArrow(run, kinds.add("text", "string").add("n_chars", "long"))


def op12_html_extraction(spark, sf_dir: str) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages."""
    return html_extraction(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", F.col("html")))
