"""Main text of web pages: each page scores its containers, each host votes on their paths, and the winning path is extracted.

A path is the chain of tags and classes from the root to a container, with runs of digits generalised, so that pages from one
template share it. Every page votes for its best container; Spark adds the votes by host (partial counts meet, so a host with a
third of all pages costs no more), and each page is read again with its host's winner, or its own best container where it lacks that.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are left out by tag, role and the
words in class and id. Inline mark-up is dropped; a block's white space is one space; blocks are joined by a line feed.

Defined cases: a null or empty page has an empty text; unclosed and stray tags are tolerated as browsers do; without a host
(no ://) pages vote together; ties between paths go to the higher score, then the first in order; white space is what Unicode calls so. An open element
keeps only its own step of the path, so memory and time are linear in a page's length however deep it nests. Only url, html and the named columns are read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sized, stored, table
from .url_filters import host_of

TAG = re.compile(r"<(?:!--(?:.*?-->|.*\Z)|[!?][^>]*+>|(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>)", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
RAW = ("script", "style", "noscript", "template", "title", "textarea", "iframe", "xmp", "noembed", "noframes")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("article body div main section td blockquote center".split())
LEFT_OUT = frozenset("nav header footer aside form script style noscript template svg button select textarea iframe dialog menu head object canvas search".split())
LEFT_OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())
LEFT_OUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal "
    "overlay sidebar aside menu nav navbar navigation breadcrumb breadcrumbs header masthead footer comment comments commentlist disqus respond replies discussion "
    "share sharing social related recommended newsletter subscribe subscription signup login paywall pagination pager widget toolbar skip search".split()
)
#: Tags that a new one of the first set closes, as far as the nearest of the bounds.
CLOSES = {
    **{t: ({"p"}, {"table", "body", "button"}) for t in BLOCKS if t not in ("body", "html", "head", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "option")},
    "li": ({"li", "p"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt", "p"}, {"dl"}), "dt": ({"dd", "dt", "p"}, {"dl"}), "option": ({"option"}, {"select"}),
    "td": ({"td", "th", "p"}, {"table", "tr"}), "th": ({"td", "th", "p"}, {"table", "tr"}), "tr": ({"tr", "td", "th", "p"}, {"table"}),
    **{t: ({"tbody", "thead", "tfoot", "tr", "td", "th", "p"}, {"table"}) for t in ("tbody", "thead", "tfoot")}, "body": ({"head"}, set()),
}
SPACE = re.compile(r"\s+")


class Node:
    """An open element: its own step of the path, its parent, and what it hands down to its children."""

    __slots__ = ("tag", "step", "up", "out", "inside", "linked", "box", "at")

    def __init__(self, tag: str, step: str, up: Node | None, out: bool):
        self.tag, self.step, self.up, self.out = tag, step, up, out
        self.inside, self.linked, self.box, self.at = (up.inside, up.linked or tag == "a", up.box, up.at) if up else (False, False, None, 0)

    def path(self) -> str:
        steps, node = [], self
        while node:
            steps.append(node.step)
            node = node.up
        return "".join(reversed(steps))


class Container:
    """A container: how much text it holds outside of links and in them, and how much of each is in no smaller container."""

    __slots__ = ("node", "parent", "plain", "linked", "direct", "score")

    def __init__(self, node: Node):
        self.node, self.parent, self.plain, self.linked, self.direct, self.score = node, node.box, 0, 0, 0, 0.0


def left_out(tag: str, attributes: str) -> tuple[bool, str]:
    """Whether the element is no part of an article; its classes, generalised."""
    out, classes = tag in LEFT_OUT, ""
    for m in ATTRIBUTE.finditer(attributes) if attributes else ():
        value = html.unescape(m[2] or m[3] or m[4] or "").lower()
        name = m[1].lower()
        if name == "role":
            out |= value in LEFT_OUT_ROLES
        elif tag not in ("html", "body", "article", "main"):
            out |= not LEFT_OUT_WORDS.isdisjoint(re.split(r"[^a-z]+", value))
        if name == "class":
            classes = ".".join(sorted(re.sub(r"\d+", "#", value).split()))
    return out, classes


def walk(page: str, text, opened, blocked) -> None:
    """Calls text(innermost element, piece) for text, opened(node) for elements and blocked() at the edges of blocks."""
    stack = [Node("", "", None, False)]
    at, n = 0, len(page)
    n_open: Counter = Counter()  # of each tag; a tag that is not open need not be looked for

    def push(node: Node) -> None:
        stack.append(node)
        n_open[node.tag] += 1

    def close(k: int) -> None:
        for node in stack[k:]:
            n_open[node.tag] -= 1
            if node.tag in BLOCKS:
                blocked()
        del stack[k:]

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            text(stack[-1], page[at:])
            break
        m = TAG.match(page, lt)
        if m is None:
            text(stack[-1], page[at : lt + 1])
            at = lt + 1
            continue
        if lt > at:
            text(stack[-1], page[at:lt])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            k = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0) if n_open[tag] else 0
            if k:
                close(k)
            elif tag in BLOCKS:
                blocked()
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag == "br":
            text(stack[-1], " ")
        if tag in CLOSES:
            shut, bounds = CLOSES[tag]
            k, left = None, sum(n_open[t] for t in shut)
            for i in range(len(stack) - 1, 0, -1):
                if not left or stack[i].tag in bounds:
                    break
                if stack[i].tag in shut:
                    k, left = i, left - 1
                elif tag not in ("li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "option") and stack[i].tag in BLOCKS:
                    break
            if k is not None:
                close(k)
        if tag in BLOCKS:
            blocked()
        attributes = m[3] if m[2] else m[6]
        if tag in VOID or tag not in BLOCKS and tag not in LEFT_OUT and not attributes and tag != "a":
            if tag not in VOID:
                push(Node(tag, "", stack[-1], stack[-1].out))
            continue
        out, classes = left_out(tag, attributes)
        step = "/" + tag + (f".{classes}" if classes else "") if tag in BLOCKS else ""
        node = Node(tag, step, stack[-1], stack[-1].out or out)
        if attributes.rstrip().endswith("/") and tag not in BLOCKS:
            continue
        opened(node)
        push(node)
    close(1)


def best_path(page: str) -> tuple[str, float]:
    """The path of the article around the container with the highest score, and the score.

    A container scores the text of the blocks right in it, and half of what is one level deeper; text in links counts against it. From the best
    one the path climbs to the outermost article, or where there is none through main and such containers whose other text is not mainly in links;
    outside main it must also be mainly right in the container and at most half of what is held so far, so that boxes beside a body stay out.
    """
    found: list[Container] = []

    def opened(node: Node) -> None:
        if node.tag in CONTAINERS:
            node.box = Container(node)
            found.append(node.box)

    def text(node: Node, piece: str) -> None:
        if node.out or node.box is None or not (n := len(piece.strip())):
            return
        if node.linked:
            node.box.linked += n
        else:
            node.box.direct += n

    walk(page, text, opened, lambda: None)
    for c in found:
        own = c.direct - c.linked
        c.score += own
        if c.parent:
            c.parent.score += own / 2
    for c in reversed(found):  # what is inside comes later, so sums are complete when they are handed up
        c.plain += c.direct
        if c.parent:
            c.parent.plain += c.plain
            c.parent.linked += c.linked
    first = max(found, key=lambda c: c.score, default=None)
    if first is None or first.score <= 0:
        return "", 0.0
    best = at = first
    while (at := at.parent) is not None:
        if not at.node.out and (at.node.tag == "article" or best.node.tag not in ("article", "main") and grown(best, at)):
            best = at
    return best.node.path(), first.score


def grown(inner: Container, outer: Container) -> bool:
    """Whether outer, which is no article, holds more of the article than inner: text beside it that is not mainly links."""
    rest = outer.plain - inner.plain
    if 4 * (outer.linked - inner.linked) > rest:
        return False
    return outer.node.tag == "main" or 2 * rest <= inner.plain and 2 * outer.direct >= rest


def main_text(page: str, path: str) -> str | None:
    """The blocks inside the elements with this path; None if the page has none. The path of nothing takes the whole page."""
    blocks: list[str] = []
    now: list[str] = []
    met = [path == ""]

    def opened(node: Node) -> None:
        # at is how much of path the steps so far spell, and below zero once they differ
        if node.step:
            node.at = node.at + len(node.step) if node.at >= 0 and path.startswith(node.step, node.at) else -1
        if not node.out and node.at == len(path) and node.tag in CONTAINERS:
            node.inside = met[0] = True

    def text(node: Node, piece: str) -> None:
        if (node.inside or path == "") and not node.out:
            now.append(piece)

    def blocked() -> None:
        if now:
            if b := SPACE.sub(" ", html.unescape("".join(now))).strip():
                blocks.append(b)
            now.clear()

    walk(page, text, opened, blocked)
    blocked()
    return "\n".join(blocks) if met[0] else None


def votes(page: Column) -> Column:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([best_path(x or "") for x in batch], columns=["path", "score"])

    return F.pandas_udf(run, "path string, score double")(page)


def extracted(page: Column, path: Column) -> Column:
    def one(page: str | None, path: str | None) -> str:
        got = main_text(page or "", path) if path else None
        return main_text(page or "", best_path(page or "")[0]) or "" if got is None else got

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for pages, paths in batches:
            yield pd.Series([one(a, b) for a, b in zip(pages, paths, strict=True)], dtype=object)

    return F.pandas_udf(run, "string")(page, path)


def winners(pages: DataFrame) -> DataFrame:
    """_host and its winning _path, one row for each host that has any; pages needs url and html."""
    v = pages.select(host_of(F.col("url")).alias("_host"), votes(F.col("html")).alias("v"))
    tally = v.where("v.path <> ''").groupBy("_host", F.col("v.path").alias("_path")).agg(F.count("*").alias("n"), F.sum(F.floor("v.score")).alias("s"))
    best = tally.groupBy("_host").agg(F.min(F.struct(-F.col("n"), -F.col("s"), F.col("_path"))).alias("m"))
    return stored(best.select("_host", F.col("m._path").alias("_path")), "host-paths")


def with_main_text(pages: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns of pages, text and n_chars."""
    won = winners(pages)
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), host_of(F.col("url")).alias("_host"), F.col("html").alias("_html"))
    rows = rows.join(sized(won), "_host", "left")  # beyond the broadcast size both sides are shuffled and AQE splits hot hosts
    return rows.select("_row", extracted(F.col("_html"), F.col("_path")).alias("text")).select("_row.*", "text", F.char_length("text").cast("long").alias("n_chars"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_main_text(table(spark, sf_dir, "pages"), ["page_id", "url"])
