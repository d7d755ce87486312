"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree of styles: a node is the chain of
block elements (tag and classes) that leads to it. A node that holds text is as
important as its contents are diverse over the pages that have it (entropy, 1
if all differ, 0 if all agree); an inner node is as important as its children
and the ways in which they follow each other, weighted by pages. A single block
is as important as its text is rare among the pages that have its node (its
self-information, of which the entropy is the mean). Branches and blocks of low
importance are cut from every page, inside articles too, as are those whose
markup says by tag, or by a class as a whole, that they are no content. Where a page has an article, what lies
outside it stays only if the tree finds it diverse. Pages with the same blocks
count once, so that copies of a page are no evidence against its text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, stored, table

#: Branches below this importance go, where at least so many pages of the host have them.
LEAST_IMPORTANCE, LEAST_PAGES = 0.2, 4
#: Blocks outside a page's article stay at this importance of their node, where at least LEAST_PAGES pages have it.
OUTSIDE_IMPORTANCE = 0.5
#: Share of a node's own presentation in its importance; the rest is its children's.
PRESENTATION = 0.1
#: Marks (of 40 bytes at most) of low branches and blocks and of diverse nodes that are broadcast; beyond, they are joined to the pages that have them.
BROADCAST_BRANCHES = 200_000
#: Nesting that the tree tells apart; what is nested deeper belongs to the node at this depth.
DEPTH = 64
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var img wbr".split())
_NOISE = frozenset("head title script style noscript template nav header footer aside menu dialog iframe object svg canvas button select textarea input label fieldset".split())
_NOISE_WORDS = frozenset(
    "nav navbar navigation menu header footer sidebar aside notice notices cookie cookies consent banner ad ads advert adverts advertisement sponsor sponsored promo promotion"
    " share sharing social comment comments reply replies respond disqus breadcrumb breadcrumbs related recommended newsletter subscribe popup modal overlay pagination pager toolbar login search widget".split()
)
#: What a class says of a noise word before it: its place or form, not another thing.
_TAILS = frozenset("list left right top bottom box bar wrap wrapper container section block area item inner slot unit links buttons icons form thread posts main".split())
#: A class that begins so says what its element has, not what it is.
_HAS = frozenset("with has no without is show hide".split())
_MAIN = frozenset(("article", "main"))
_HEADINGS = frozenset(f"h{i}" for i in range(1, 7))
#: Where a block lies: outside articles, in one, or in a heading of one.
OUTSIDE, INSIDE, HEADING = 0, 1, 2
_PART = re.compile(r"[^a-z0-9]+")
_ROOT = 0


def noise_class(token: str) -> bool:
    """Whether a class, id or role names something that is no content: by its last part, but for tails like `-list` or `-12`."""
    parts = [w for w in _PART.split(token) if w]
    if len(parts) > 1 and parts[0] in _HAS:
        return False
    while len(parts) > 1 and (parts[-1] in _TAILS or parts[-1].isdigit()):
        parts.pop()
    return bool(parts) and parts[-1] in _NOISE_WORDS


class Page(HTMLParser):
    """Blocks of a page: [node, texts, in an article, in a form], and for each node what follows below it, in order.

    A node is a hash of the chain of block elements that leads to it.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, bool, int, bool]] = [("", _ROOT, False, OUTSIDE, False)]
        self.above: dict[int, int] = {}
        self.depth = {_ROOT: 0}
        self.blocks: list[list] = []
        self.below: dict[int, list[int]] = {}
        self.open = False

    def parse_html_declaration(self, i: int) -> int:
        try:
            return super().parse_html_declaration(i)
        except AssertionError:  # an unknown section: a comment up to the next bracket
            end = self.rawdata.find(">", i)
            return end + 1 if end >= 0 else len(self.rawdata)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        own = [w for k, v in attrs if k in ("class", "id", "role") for w in (v or "").lower().split()]
        inline = tag in _INLINE
        if not inline:
            self.open = self.open and tag in _VOID and tag not in ("br", "hr")
        if tag in _VOID or (inline and not own):
            return
        if not inline and self.stack[-1][0] in ("p", "li" if tag == "li" else "p"):
            self.stack.pop()
        _, above, noise, main, form = self.stack[-1]
        main = max(main, HEADING if main and tag in _HEADINGS else INSIDE if tag in _MAIN else OUTSIDE)
        noise = noise or (tag in _NOISE and not (main and tag == "header")) or (tag not in ("html", "body", "main") and main != HEADING and any(map(noise_class, own)))
        if inline:  # no block of its own, so that words stay whole
            self.stack.append((tag, above, noise, main, form))
            return
        node = above
        if self.depth[above] < DEPTH:
            node = int.from_bytes(hashlib.blake2b(f"{above} {tag} {' '.join(sorted(set(own)))}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)
            self.above[node], self.depth[node] = above, self.depth[above] + 1
            children = self.below.setdefault(above, [])
            if not children or children[-1] != node:
                children.append(node)
        self.stack.append((tag, node, noise, main, form or tag == "form"))

    def handle_endtag(self, tag: str) -> None:
        if tag in _VOID:
            self.open = self.open and tag not in ("br", "hr")
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                self.open = self.open and tag in _INLINE
                return
            if tag in _INLINE and self.stack[i][0] not in _INLINE:
                return

    def handle_data(self, data: str) -> None:
        _, node, noise, main, form = self.stack[-1]
        if noise:
            return
        if self.open:
            self.blocks[-1][1].append(data)
        else:
            self.blocks.append([node, [data], main, form])
            self.open = True

    def chain(self, node: int) -> list[int]:
        """A node and the nodes above it, but for the root."""
        out = []
        while node != _ROOT:
            out.append(node)
            node = self.above[node]
        return out


def parsed(html: str | None) -> tuple[list[tuple[int, str, int]], Page]:
    """((node, text, place: OUTSIDE, INSIDE or HEADING) of each block that isn't noise by its markup, the page).

    Forms are noise, unless all text is in them: then the page is wrapped in one.
    """
    page = Page()
    page.feed(html if isinstance(html, str) else "")
    page.close()
    blocks = [(p, " ".join("".join(parts).split()), main, form) for p, parts, main, form in page.blocks]
    blocks = [b for b in blocks if b[1]]
    outside = [b[:3] for b in blocks if not b[3]]
    return outside or [b[:3] for b in blocks], page


def _digest(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def _block(node: int, text: str) -> str:
    """The mark of a single block."""
    return f"{node} {_digest(text)}"


def _rich(node: int) -> str:
    """The mark of a diverse node outside articles."""
    return f"+{node}"


def extracted(html: str | None, marks: frozenset[str] | set[str]) -> str:
    """The text of the blocks of a page that are not low, by the marks of its host: low branches, low blocks, diverse nodes.

    Headings of an article stay. Other blocks of an article go with a low branch
    only, never by how many pages share their text alone: the more near copies of an
    article a host has, or pages of one outline, the more they would share. On a
    page with text in an article, blocks outside articles need a diverse node, and
    go where their own text is low.
    """
    blocks, page = parsed(html)
    article, low, out = any(place for _, _, place in blocks), {}, []
    for p, t, place in blocks:
        if p not in low:
            low[p] = any(str(x) in marks for x in page.chain(p))
        outside = (not article or _rich(p) in marks) and _block(p, t) not in marks
        if place == HEADING or (not low[p] and (place == INSIDE or outside)):
            out.append(t)
    return " ".join(out)


_STYLES = "host long, node long, kind string, feature string, page string, chain array<long>, main boolean"


def _styles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each node of a page: whether it has text, and a hash of its text or of what follows below it; and one for each different block."""
    for pdf in batches:
        out = []
        for host, html in zip(pdf["host"], pdf["html"], strict=True):
            blocks, page = parsed(html)
            texts: dict[int, list[str]] = {}
            inside = {}
            for p, t, main in blocks:
                texts.setdefault(p, []).append(t)
                inside[p] = bool(main)
            mark = _digest("\n".join(f"{p}\t{t}" for p, t, _ in blocks))
            for p, own in texts.items():
                out.append((host, p, "content", _digest("\n".join(own)), mark, page.chain(p), inside[p]))
                out += [(host, p, "block", _digest(t), mark, None, None) for t in dict.fromkeys(own)]
            out += [(host, p, "presentation", _digest(" ".join(map(str, own))), mark, None, None) for p, own in page.below.items()]
        yield pd.DataFrame(out, columns=["host", "node", "kind", "feature", "page", "chain", "main"])


def style_tree(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From pages (host, html): (host, node, pages, importance, main) of each node of each host's tree, and (host, node, feature, n, importance) of blocks on several pages.

    host is a number. Pages of a host with the same blocks count once, whatever
    surrounds these, and so do repeated rows. A null html has no nodes; an empty
    table gives empty trees.
    """
    rows = pages.select("host", "html").mapInPandas(_styles, _STYLES)
    grouped = rows.distinct().groupBy("host", "node", "kind", "feature").agg(F.count("*").alias("n"), F.first("chain").alias("chain"), F.max("main").alias("main"))
    shares = stored(grouped, "shares")
    nodes = shares.where("kind <> 'block'").groupBy("host", "node", "kind").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("nlogn"), F.first("chain").alias("chain"), F.max("main").alias("main"))
    entropy = F.when(F.col("m") == 1, 1.0).otherwise((F.log("m") - F.col("nlogn") / F.col("m")) / F.log("m"))
    nodes = stored(nodes.select("host", "node", "kind", "m", entropy.alias("own"), "chain", "main"), "styles")
    content = (
        nodes.where("kind = 'content'")
        .select("host", F.explode("chain").alias("node"), "m", "own", (F.col("main") | F.lit(False)).alias("main"))
        .groupBy("host", "node")
        .agg(F.max("m").alias("pages"), (F.sum(F.col("own") * F.col("m")) / F.sum("m")).alias("content"), F.min("main").alias("main"))
    )
    shown = nodes.where("kind = 'presentation'").select("host", "node", F.col("own").alias("shown"))
    importance = F.coalesce((1 - PRESENTATION) * F.col("content") + PRESENTATION * F.col("shown"), "content")
    tree = content.join(shown, ["host", "node"], "left").select("host", "node", "pages", importance.alias("importance"), "main")
    repeated = shares.where((F.col("kind") == "block") & (F.col("n") >= LEAST_PAGES)).join(nodes.where("kind = 'content'").select("host", "node", "m"), ["host", "node"])
    return tree, repeated.select("host", "node", "feature", "n", ((F.log("m") - F.log("n")) / F.log("m")).alias("importance"))


def extract(pages: DataFrame) -> DataFrame:
    """pages (url, html, any others) with `text`, the main text of each page.

    Character references are decoded, white space inside a block becomes one
    space, blocks are joined in page order by one space; inline elements never
    split a block. A null or empty html gives the empty text; pages without a url
    share the empty host. Repeated rows give the same text each, an empty table
    none. A column of this name is replaced; rows and other columns stay.
    """
    small_batches(pages.sparkSession)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[^:]*://([^/?#]*)", 1))
    pages = pages.withColumn("__host", F.xxhash64(host))
    tree, repeated = style_tree(pages.select(F.col("__host").alias("host"), "html"))
    known, is_low, node = tree.where(F.col("pages") >= LEAST_PAGES), F.col("importance") < LEAST_IMPORTANCE, F.col("node").cast("string")
    rich = known.where((F.col("importance") >= OUTSIDE_IMPORTANCE) & ~F.col("main"))
    low = known.where(is_low).select("host", node.alias("mark")).union(rich.select("host", F.concat(F.lit("+"), node)))
    low = stored(low.union(repeated.where(is_low).select("host", F.concat(node, F.lit(" "), "feature"))), "branches")
    if low.limit(BROADCAST_BRANCHES + 1).count() <= BROADCAST_BRANCHES:
        branches: dict[int, set[str]] = {}
        for h, mark in low.collect():
            branches.setdefault(h, set()).add(mark)
        shared = pages.sparkSession.sparkContext.broadcast(branches)

        def texts(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for hosts, htmls in batches:
                yield pd.Series([extracted(h, shared.value.get(o, frozenset())) for o, h in zip(hosts, htmls, strict=True)], dtype=object)

        return pages.withColumn("text", F.pandas_udf(_series2(texts), "string")("__host", "html")).drop("__host")
    own = pages.withColumn("__page", F.xxhash64("__host", "html"))
    seen = own.select("__page", "__host", "html").dropDuplicates(["__page", "__host"]).mapInPandas(_paths, "__page long, host long, mark string")
    cut = seen.join(low, ["host", "mark"]).groupBy("__page").agg(F.collect_set("mark").alias("__low"))

    def texts_of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for htmls, lows in batches:
            yield pd.Series([extracted(h, frozenset(c) if c is not None else frozenset()) for h, c in zip(htmls, lows, strict=True)], dtype=object)

    out = own.join(cut, "__page", "left")
    return out.withColumn("text", F.pandas_udf(_series2(texts_of), "string")("html", "__low")).drop("__page", "__low", "__host")


def _series2(run):
    def texts(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        return run(batches)

    return texts


def _paths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for page, host, html in zip(pdf["__page"], pdf["__host"], pdf["html"], strict=True):
            blocks, own = parsed(html)
            found = {x for p, t, _ in blocks for x in (_rich(p), _block(p, t), *map(str, own.chain(p)))}
            out += [(page, host, x) for x in sorted(found)]
        yield pd.DataFrame(out, columns=["__page", "host", "mark"])


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
