"""Main text of web pages by removal of each site's templates.

1. Every page is parsed into elements. Each element's subtree (tags and text) in the main content has a hash, block or inline.
2. Spark counts, for each host, in how many different pages a subtree occurs. Pages whose main content is the
   same count once: copies of one article are no template.
3. Subtrees that recur across many pages of their host, of one section of it, or at a place of the page where most of
   what stands recurs, are deleted; so are elements that by their tag, role or class aren't main text. What is left of the
   article (or main element, or body) is read block by block. An inline element goes only if nothing else stands beside it.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .shared import kept

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template iframe object svg math canvas audio video".split())
_UNSEEN = _RAW | {"head", "title"}
_DROP = _RAW | frozenset("head title nav footer aside form button select textarea menu dialog".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption legend".split()
)
#: An end tag that may be left out: these start tags close an open element of the same kind.
_SELF = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr"}, "th": {"tr"}, "option": {"select"}}
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar toolbar".split())
_CLASSES = frozenset(
    "ad ads advert advertisement adsense banner breadcrumb breadcrumbs byline-share comment comments consent cookie cookies disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo related respond share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
#: Readers' comments, which may be longer than the text and hold articles of their own.
_REPLIES = frozenset("comment comments disqus respond".split())
#: Parts of a class name that says how a page is laid out, not what the element is: "no-sidebar", "has-menu".
_LAYOUT = frozenset("no non not has with without is layout enabled disabled open closed collapsed wrapper".split())
_SPACE = re.compile(r"\s+")
_COMMENT_END = re.compile(r"--!?>")
_MARKUP = re.compile(r"<[A-Za-z/!?]")
_TOKEN = re.compile(r"[a-z0-9]+")
_DIGITS = re.compile(r"[0-9]+")


class Node:
    __slots__ = ("attributes", "children", "hash", "tag", "text_size")

    def __init__(self, tag: str, attributes: dict[str, str] | None = None):
        self.tag, self.attributes, self.children, self.hash, self.text_size = tag, attributes or {}, [], 0, 0


class _Builder(HTMLParser):
    """Elements and texts of a page; end tags may be missing. The whole page is fed at once."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.open = [self.root]
        self.named: dict[str, int] = {}  # open elements by tag

    def _drop(self, i: int) -> None:
        for x in self.open[i:]:
            self.named[x.tag] -= 1
        del self.open[i:]

    def _close(self, names: frozenset | set, within: frozenset | set) -> None:
        """Close the nearest open element named so, unless one named in within lies between."""
        for n in names:
            if self.named.get(n):
                break
        else:
            return
        for i in range(len(self.open) - 1, 0, -1):
            tag = self.open[i].tag
            if tag in names:
                self._drop(i)
                return
            if tag in within:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _BLOCK:
            self._close({"p"}, _BLOCK - {"p"})
        if tag in _SELF:
            self._close({"td", "th"} if tag in ("td", "th") else {"dt", "dd"} if tag in ("dt", "dd") else {tag}, _SELF[tag])
        if tag == "body":
            self._close({"head"}, set())
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in _VOID:
            self.open.append(node)
            self.named[tag] = self.named.get(tag, 0) + 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID and self.open[-1].tag == tag:
            self._drop(len(self.open) - 1)

    def handle_endtag(self, tag: str) -> None:
        if not self.named.get(tag):
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                self._drop(i)
                return
            if tag not in _BLOCK and self.open[i].tag in _BLOCK:
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)

    def parse_comment(self, i: int, report: int = 1) -> int:
        """The end of a comment, which may be short (``<!-->``) or never closed: then it takes the rest of the page."""
        end = _COMMENT_END.search(self.rawdata, i + 2 if self.rawdata.startswith(("<!-->", "<!--->"), i) else i + 4)
        return end.end() if end else len(self.rawdata)


def parse(html: str | None) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    if _MARKUP.match(builder.rawdata):  # a tag that the end of the page cuts off
        builder.rawdata = ""
    builder.close()
    _hash(builder.root)
    return builder.root


def _below(root: Node) -> list[Node]:
    """All elements, parents first; no recursion, however deep the page."""
    out = [root]
    for node in out:
        out.extend(x for x in node.children if isinstance(x, Node))
    return out


def _hash(root: Node) -> None:
    for node in reversed(_below(root)):
        parts, size = [node.tag], 0
        for x in node.children:
            if isinstance(x, Node):
                parts.append(str(x.hash))
                size += x.text_size
            elif text := _SPACE.sub(" ", x).strip():
                parts.append(text)
                size += len(text)
        node.hash = int.from_bytes(hashlib.blake2b("\x00".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
        node.text_size = 0 if node.tag in _UNSEEN else size


def _classed(node: Node, listed: frozenset) -> bool:
    """Has its class or id a name with a listed part? Names that speak of the page's layout don't count."""
    a = node.attributes
    for name in f"{a.get('class', '')} {a.get('id', '')}".lower().split():
        parts = _TOKEN.findall(name)
        if not listed.isdisjoint(parts) and _LAYOUT.isdisjoint(parts):
            return True
    return False


def _named(node: Node, inside: bool, much: float) -> bool:
    """Is it site furniture by its tag, role, class or id? inside: below an article or main element.

    Forms and elements with such a role or class aren't if they hold much of the text, but for readers' comments.
    """
    if node.tag != "form" and (node.tag in _DROP or node.tag == "header" and not inside):
        return True
    a = node.attributes
    if node.tag in ("html", "body", "article", "main") or not a and node.tag != "form":
        return False
    if "hidden" in a or a.get("aria-hidden") == "true" or _classed(node, _REPLIES):
        return True
    return node.text_size <= much and (node.tag == "form" or a.get("role", "").lower() in _ROLES or _classed(node, _CLASSES))


def contents(root: Node) -> list[Node]:
    """The elements that hold the main text: outermost articles that aren't comments, or main, or the body.

    They are looked for outside site furniture first, then also in elements that only by role or class are furniture.
    """
    wanted = (lambda n: n.tag == "article", lambda n: n.tag == "main" or n.attributes.get("role") == "main")
    for much in (float("inf"), -1.0):
        for is_wanted in wanted:
            found, stack = [], [root]
            while stack:
                node = stack.pop()
                if is_wanted(node):
                    if not _classed(node, _CLASSES if much > 0 else _REPLIES):
                        found.append(node)
                    continue
                if not _named(node, False, much):
                    stack.extend(x for x in reversed(node.children) if isinstance(x, Node))
            if any(x.text_size for x in found):
                return found
    return [root]


#: Cells, items and headings recur as text does ("Yes", "Notes"): they go by their counts or with what holds them, not by place.
_NO_PLACE = frozenset("td th tr li dt dd option h1 h2 h3 h4 h5 h6 caption legend figcaption".split())
#: Values of slot that are no place: the page itself, a section of the host, an element without a place.
_PAGE, _SECTION, _NOWHERE = 0, 1, 2


def _countable(tops: list[Node]) -> dict[int, int]:
    """Hashes of all subtrees of the main content (see contents()) that have text, and the place (slot) of each block or element with
    attributes: tags and classes from the content down, and its position beside its siblings if that is one of the first
    or last two."""
    found: dict[int, int] = {}
    stack = [(top, 0) for top in reversed(tops)]
    while stack:
        parent, path = stack.pop()
        children = [x for x in parent.children if isinstance(x, Node)]
        below = []
        for i, node in enumerate(children):
            if not node.text_size:
                continue
            here = zlib.crc32(f"{node.tag}.{_DIGITS.sub('#', node.attributes.get('class', ''))}/".encode("utf-8", "surrogatepass"), path)
            if node.tag not in ("html", "body"):
                edge = i if i < 2 else i - len(children) if len(children) - i <= 2 else 9
                placed = (node.tag in _BLOCK or node.attributes) and node.tag not in _NO_PLACE
                found.setdefault(node.hash, 3 + zlib.crc32(b"%d" % edge, here) if placed else _NOWHERE)
            below.append((node, here))
        stack.extend(reversed(below))
    return found


def blocks(root: Node, templates: frozenset[int] | set[int]) -> list[str]:
    """The text blocks of the main content in page order.

    Blocks that are templates or furniture go with all they hold. Inline ones are part of the text around them: they go
    only if nothing else with a letter or digit stands in their block.
    """
    out: list[str] = []
    held: list[tuple[str, bool]] = []

    def flush() -> None:
        if held:
            weak = any(w for _, w in held) and not any(c.isalnum() for t, w in held if not w for c in t)
            if not weak and (text := _SPACE.sub(" ", "".join(t for t, _ in held)).strip()):
                out.append(text)
            held.clear()

    for top in contents(root):
        inside, much = top.tag != "#root", top.text_size / 2
        stack: list = [(top, False)]
        while stack:
            x, weak = stack.pop()
            if x is None:
                flush()
                continue
            if isinstance(x, str):
                held.append((x, weak))
                continue
            edge = x.tag in _BLOCK
            if x is not top and (x.hash in templates or _named(x, inside, much)):
                if edge or x.tag in _DROP or "hidden" in x.attributes:
                    if edge:
                        flush()
                    continue
                weak = True
            if x.tag == "br":
                held.append((" ", weak))
                continue
            if edge:
                flush()
                stack.append((None, weak))
            stack.extend((y, weak) for y in reversed(x.children))
        flush()
    return out


def _root_hash(tops: list[Node]) -> int:
    return hash(tuple(n.hash for n in tops)) & (1 << 62) - 1


def _host(url: str = "url"):
    return F.coalesce(F.lower(F.regexp_extract(F.col(url).cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _section(url: str = "url"):
    """The first part of the path, if another follows."""
    return F.coalesce(F.regexp_extract(F.col(url).cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)/", 1), F.lit(""))


def templates(pages: DataFrame, min_pages: int, min_share: float, place_share: float) -> DataFrame:
    """_host, node (hash) and n (pages that hold it) of the subtrees to delete; pages: _host, _section, html."""

    def subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "html"):
                rows = []
                for host, section, html in zip(*(part.column(c).to_pylist() for c in ("_host", "_section", "html")), strict=True):
                    tops = contents(parse(html))
                    main = _root_hash(tops)
                    rows += [(host, 0, main, _PAGE, section), (host, section, main, _SECTION, section)]
                    rows += [(host, node, main, slot, section) for node, slot in _countable(tops).items()]
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["_host", "node", "main", "slot", "section"])

    rows = pages.mapInArrow(subtrees, "_host long, node long, main long, slot long, section long")
    once = rows.groupBy("_host", "node", "main").agg(F.min("slot").alias("slot"), F.min("section").alias("section"))
    seen = once.groupBy("_host", "node").agg(F.count("*").alias("n"), F.min("slot").alias("slot"), F.min("section").alias("section"), F.max("section").alias("last"))
    # what recurs has a row of its own; the rest is only summed by place
    often = kept(seen.groupBy("_host", "slot", F.when(F.col("n") >= min_pages, F.col("node")).alias("node")).agg(F.sum("n").alias("n"), F.min("section").alias("section"), F.max("last").alias("last")))
    known = often.where("node is not null")
    totals = known.where(F.col("slot") == _PAGE).select("_host", F.col("n").alias("total"))
    sections = known.where(F.col("slot") == _SECTION).select("_host", F.col("node").alias("section"), F.col("node").alias("last"), F.col("n").alias("within"))
    places = often.where(F.col("slot") > _NOWHERE).groupBy("_host", "slot").agg(F.sum("n").alias("all"), F.sum(F.when(F.col("node").isNotNull(), F.col("n"))).alias("recurring"))
    both = known.where(F.col("slot") >= _NOWHERE).join(totals, "_host", "left").join(sections, ["_host", "section", "last"], "left").join(places, ["_host", "slot"], "left")
    much = (F.col("n") >= min_share * F.col("total")) | (F.col("n") >= min_share * F.col("within")) | (F.col("recurring") >= place_share * F.col("all"))
    return both.where(much).select("_host", "node", "n")


def _listed(pages: DataFrame, found: DataFrame) -> DataFrame:
    """pages with the column templates: those among a page's own subtrees, so that no list grows with a host.

    A subtree on very many pages meets them by a broadcast: there are 100,000 of those at most, as each takes its share of
    all rows. Pages go by page_id, url and a hash of the html.
    """
    keyed = pages.withColumn("_page", F.xxhash64("page_id", "url", "html"))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "html"):
                trees = [_countable(contents(parse(html))) for html in part.column("html").to_pylist()]
                times = np.array([len(t) for t in trees])
                held = [part.column(c).to_numpy(zero_copy_only=False).repeat(times) for c in ("_page", "_host")]
                yield pa.RecordBatch.from_arrays([*map(pa.array, held), pa.array([node for t in trees for node in t], pa.int64())], names=["_page", "_host", "node"])

    rows = kept(keyed.select("_page", "_host", "html").mapInArrow(own, "_page long, _host long, node long").distinct())
    many = rows.count() // 100_000
    hot, rest = found.where(F.col("n") > many).select("_host", "node"), found.where(F.col("n") <= many).select("_host", "node")
    marked = rows.join(F.broadcast(hot), ["_host", "node"], "left_semi").union(rows.join(rest, ["_host", "node"], "left_semi").select(rows.columns))
    lists = marked.groupBy("_page").agg(F.collect_list("node").alias("templates"))
    return keyed.join(lists, "_page", "left")


#: Templates of all hosts that are broadcast; 16 bytes each.
BROADCAST_NODES = 1 << 20


def extract_main_text(pages: DataFrame, min_pages: int = 10, min_share: float = 0.3, place_share: float = 0.5, broadcast_nodes: int = BROADCAST_NODES) -> DataFrame:
    """page_id, url, text, n_chars of every row: the main text, blocks joined by two line feeds, and its code points.

    A subtree is a template if it occurs in min_pages or more different pages of its host, and besides in min_share
    of the host's pages, or only in one section (first part of the url's path) and in min_share of that, or at a place
    of the page (tags, classes, position) of whose subtrees place_share recur in min_pages or more. The last two don't
    fall as the host grows. The host is that of the url; a null or odd url counts as host ''. Hosts, sections and
    subtrees go by 64-bit hashes, places by 32 bits. Null, empty and textless pages give an empty text; very long
    pages are read whole; repeated rows get equal results; an empty table gives an empty result; further columns are
    ignored. Up to broadcast_nodes templates are sent to all tasks, and pages stay where they are; beyond that each
    page is joined with its own.
    """
    pages = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), F.xxhash64(_host()).alias("_host"))
    found = kept(templates(pages.select("_host", F.xxhash64(_section()).alias("_section"), "html"), min_pages, min_share, place_share))
    small = found.count() <= broadcast_nodes
    shared = None
    if small:
        pairs = found.select("_host", "node").toArrow()
        host, node = (pairs[c].to_numpy() for c in ("_host", "node"))
        order = np.argsort(host, kind="stable")
        shared = pages.sparkSession.sparkContext.broadcast((host[order], node[order]))
    else:
        pages = _listed(pages, found)
    kind = {f.name: f.dataType.simpleString() for f in pages.schema.fields}

    def lists(part: pa.RecordBatch) -> Iterator[frozenset[int]]:
        if not small:
            yield from (frozenset(x or ()) for x in part.column("templates").to_pylist())
            return
        hosts, nodes = shared.value
        have: dict[int, frozenset[int]] = {}
        for h in part.column("_host").to_pylist():
            if h not in have:
                a, b = np.searchsorted(hosts, [h, h + 1]) if h < (1 << 63) - 1 else (np.searchsorted(hosts, h), len(hosts))
                have[h] = frozenset(nodes[a:b].tolist())
            yield have[h]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "html"):
                texts = ["\n\n".join(blocks(parse(html), own)) for html, own in zip(part.column("html").to_pylist(), lists(part), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(np.array([len(t) for t in texts], np.int64))], names=["page_id", "url", "text", "n_chars"])

    columns = ["page_id", "url", "html", "_host" if small else "templates"]
    return pages.select(*columns).mapInArrow(read, f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars long")
