"""Main text of web pages by removal of what recurs on a site."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, named, small, texts_in_arrow, write_down

# Element names as HTML defines them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table "
    "tbody tfoot thead title tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements a start tag closes when one is open, and where the search for it ends.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"),
          "option": ("option",)}
FENCE = frozenset("ul ol dl table tbody thead tfoot tr article section main body html div".split())

#: Elements that are never part of the article.
NEVER = frozenset(
    "head title script style noscript template nav footer aside form button input select option textarea iframe noembed "
    "noframes object svg canvas video audio map dialog menu xmp".split())
#: Words of a class or id that may tell the same of any other element; the second group only outside of an article. They
#: decide where a name holds nothing else but words of place and form; any other name is a hint that needs recurrence.
MARKED = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent "
    "gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup sidebar widget "
    "menu nav navbar navigation breadcrumb breadcrumbs footer comment comments respond reply replies disqus share sharing "
    "social related recommended pagination pager login".split())
MARKED_OUTSIDE = frozenset("header masthead topbar toolbar search".split())
FORM_WORDS = frozenset(
    "area article bar block body bottom box button buttons col column container content div entry flex footer fixed form grid "
    "group head heading holder inner item items js label large layout left link links list main mobile outer page panel "
    "placeholder post region right row section site slot small sticky strip thread title top unit wrap wrapper zone".split())
COMMENTS = frozenset("comment comments respond reply replies disqus".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
#: Containers of which one inside an article is deleted if it recurs; outside of it any element is.
CONTAINERS = frozenset("div section ul ol dl table figure details center fieldset hgroup".split())

#: A subtree recurs if it stands on this many different pages of a host, however many the host has.
PAGES = 4

_TAG = re.compile(r"<(?:(?P<comment>!--)|(?P<other>[!?])|(?P<end>/)?(?P<name>[a-zA-Z][^\s/>]*)"
                  r"(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>)")
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass
class Node:
    tag: str
    start: int
    named: bool          # its name says that it is no content
    named_outside: bool  # the same, unless it is in an article
    hinted: bool         # a part of its name does
    comments: bool       # its name says that it holds comments
    end: int = -1
    hash: int = 0
    parts: list[bytes] = field(default_factory=list)


def _names(rest: str) -> tuple[bool, bool, bool, bool]:
    """What class, id and role say of an element: see ``Node``."""
    if "=" not in rest:
        return False, False, False, False
    named = outside = hinted = comments = False
    for name, a, b, c in _ATTRIBUTE.findall(rest):
        value = a or b or c
        if name.lower() == "role":
            named |= value.strip().lower() in ROLES
            continue
        for token in value.split():
            words = {w.lower() for w in _WORDS.findall(token)}
            telling = words & (MARKED | MARKED_OUTSIDE)
            if telling:
                hinted = True
                if words <= MARKED | MARKED_OUTSIDE | FORM_WORDS:
                    named |= bool(telling & MARKED)
                    outside = True
                    comments |= bool(telling & COMMENTS)
    return named, outside, hinted, comments


def parse(page: str) -> list[str | Node]:
    """A page as a flat list: texts, and for each element its node where it starts; ``end`` is the place after it.

    Tags are matched as browsers do in what concerns text: raw elements, void ones, implied ends of paragraphs and list
    items, end tags without a start. A subtree's hash covers its tags and its text without differences of white space.
    """
    import xxhash

    flat: list[str | Node] = []
    open_: list[Node] = []

    def text(piece: str) -> None:
        if piece and not piece.isspace():
            piece = html.unescape(piece) if "&" in piece else piece
            flat.append(piece)
            if open_:
                open_[-1].parts.append(" ".join(piece.split()).encode("utf-8", "replace"))
        elif piece:
            flat.append(" ")

    def close(depth: int) -> None:
        while len(open_) > depth:
            node = open_.pop()
            node.end = len(flat)
            if node.parts:
                node.hash = xxhash.xxh64_intdigest(b"\0".join([node.tag.encode("utf-8", "replace"), *node.parts])) >> 1
                if open_:
                    open_[-1].parts.append(node.hash.to_bytes(8, "little"))
            node.parts = []

    def close_open(names, fence) -> None:
        for k in range(len(open_) - 1, -1, -1):
            if open_[k].tag in names:
                close(k)
                return
            if open_[k].tag in fence:
                return

    at, end = 0, len(page)
    while at < end:
        found = _TAG.search(page, at)
        if not found:
            # A tag cut off by the end of the page is no text.
            cut = re.compile(r"<[a-zA-Z/!?]").search(page, at)
            text(page[at:cut.start()] if cut else page[at:])
            break
        text(page[at:found.start()])
        at = found.end()
        if found["comment"]:
            stop = page.find("-->", at)
            at = end if stop < 0 else stop + 3
            continue
        if found["other"]:
            stop = page.find(">", at)
            at = end if stop < 0 else stop + 1
            continue
        tag = found["name"].lower()
        if found["end"]:
            for k in range(len(open_) - 1, -1, -1):
                if open_[k].tag == tag:
                    close(k)
                    break
            continue
        if tag in BLOCK:
            close_open(("p",), FENCE)
        if tag in CLOSES:
            close_open(CLOSES[tag], FENCE - set(CLOSES[tag]))
        node = Node(tag, len(flat), *_names(found["rest"]))
        flat.append(node)
        if tag in VOID or (found["rest"].endswith("/") and tag in ("svg", "path")):
            node.end = len(flat)
        elif tag in RAW:
            stop = re.compile(f"</{re.escape(tag)}", re.I).search(page, at)
            node.end = len(flat)
            if stop is None:
                break
            close_tag = page.find(">", stop.end())
            at = end if close_tag < 0 else close_tag + 1
        else:
            open_.append(node)
    close(0)
    return flat


@dataclass
class Page:
    """A parsed page, the element that holds its article, and the places of elements that no name deletes."""

    flat: list[str | Node]
    root: str | None = None
    kept: frozenset[int] = frozenset()

    def removed(self, node: Node, inside: bool, recurring: frozenset[int]) -> bool:
        if node.tag in NEVER:
            return True
        again = node.hash in recurring and node.tag not in ("html", "body", "main", "article")
        if again and (not inside or node.tag in CONTAINERS or node.hinted):
            return True
        if node.start in self.kept or node.tag in HEADINGS or node.tag in ("html", "body", "main"):
            return False
        # Inside an article a name alone decides about boxes, not about its paragraphs.
        if inside:
            return node.named and (node.tag in CONTAINERS or node.tag == "article")
        return node.named or node.named_outside or node.tag == "header"


def _walk(page: Page, recurring: frozenset[int], root: str | None) -> Iterator[tuple[str, int, str | Node, bool]]:
    """What is left of a page in order: ``(kind, place, text or node, inside an article)``; kinds are text, start, end and
    gone."""
    ends: list[Node] = []
    inside, k, flat = 0, 0, page.flat
    while k < len(flat):
        while ends and ends[-1].end <= k:
            node = ends.pop()
            inside -= node.tag == root
            yield "end", node.start, node, inside > 0
        item = flat[k]
        if isinstance(item, str):
            yield "text", k, item, inside > 0
            k += 1
            continue
        if page.removed(item, inside > 0, recurring):
            yield "gone", k, item, inside > 0
            k = max(item.end, k + 1)
            continue
        inside += item.tag == root
        yield "start", k, item, inside > 0
        ends.append(item)
        k += 1
    while ends:
        node = ends.pop()
        inside -= node.tag == root
        yield "end", node.start, node, inside > 0


def _plan(flat: list[str | Node], recurring: frozenset[int]) -> Page:
    """Find the article: ``article`` elements, else ``main``, else none, which means the whole page.

    No name deletes an element that holds most of the article's text, except for comments, which may be longer than it. If
    names would leave neither of the two elements they do not count for what holds one.
    """
    page = Page(flat)

    def holder() -> str | None:
        found = {item.tag for kind, _, item, _ in _walk(page, recurring, None) if kind == "start"}
        return "article" if "article" in found else "main" if "main" in found else None

    page.root = holder()
    named = [n for n in flat if not isinstance(n, str) and (n.named or n.named_outside)]
    if not named:
        return page
    if page.root is None:
        tops = list(accumulate((not isinstance(n, str) and n.tag in ("article", "main") for n in flat), initial=0))
        page.kept = frozenset(n.start for n in named if tops[n.end] > tops[n.start])
        page.root = holder() if page.kept else None
    depth = [0] * (len(flat) + 1)  # how many elements of the article are open before each place
    for kind, _, item, _ in _walk(page, recurring, page.root):
        if kind == "start" and item.tag == page.root:
            depth[item.start + 1] += 1
            depth[item.end] -= 1
    depth, known = list(accumulate(depth)), page.kept
    page.kept = known | frozenset(n.start for n in named if page.root is None or depth[n.start] > 0)
    # Characters of the article before each place, with what only names would delete.
    before = [0] * (len(flat) + 1)
    for kind, place, item, inside in _walk(page, recurring, page.root):
        if kind == "text" and (inside or page.root is None):
            before[place + 1] = len(item)
    before = list(accumulate(before))
    page.kept = known | frozenset(n.start for n in named if not n.comments and n.end > n.start
                                  and 2 * (before[n.end] - before[n.start]) > before[-1])
    return page


def subtrees(page: str) -> set[int]:
    """Hashes of the block elements of a page that may be part of a site's template."""
    flat = parse(page)
    plan = _plan(flat, frozenset())
    out, upto = set(), 0  # upto: the end of the article's elements so far
    for k, item in enumerate(flat):
        if isinstance(item, str) or not item.hash:
            continue
        if item.tag == plan.root and k >= upto and not plan.removed(item, False, frozenset()):
            upto = item.end
        if item.tag in CONTAINERS or (item.tag in BLOCK and (k >= upto or item.hinted)):
            out.add(item.hash)
    return out


def main_text(page: str, recurring: frozenset[int] = frozenset()) -> str:
    """The blocks of a page's article, white space as single blanks, two line feeds between blocks."""
    plan = _plan(parse(page), recurring)
    blocks: list[str] = []
    now: list[str] = []
    header = heading = 0

    def end_block() -> None:
        if words := "".join(now).split():
            blocks.append(" ".join(words))
        now.clear()

    for kind, _, item, inside in _walk(plan, recurring, plan.root):
        if kind == "text":
            if (inside or plan.root is None) and (not header or heading):
                now.append(item)
            continue
        if item.tag in BLOCK:
            end_block()
        elif item.tag in ("br", "td", "th"):
            now.append(" ")
        if kind == "gone":
            continue
        step = 1 if kind == "start" else -1
        header += step * (item.tag == "header")
        heading += step * (item.tag in HEADINGS)
    end_block()
    return "\n\n".join(blocks)


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pages, hosts, hashes = [], [], []
        for page, host, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            found = subtrees(text.as_py() or "")
            pages += [page] * len(found)
            hosts += [host] * len(found)
            hashes += found
        yield pa.RecordBatch.from_arrays([pa.array(pages, pa.int64()), pa.array(hosts, pa.int64()),
                                          pa.array(hashes, pa.int64())], names=["page", "host", "subtree"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(t.as_py() or "", frozenset(r.as_py() or ())) for t, r in zip(batch.column(2), batch.column(3))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                                          pa.array([len(t) for t in texts], pa.int64())],
                                         names=["page_id", "url", "text", "n_chars"])


def extract_main_text(pages: DataFrame, least_pages: int = PAGES) -> DataFrame:
    """One row per row of ``pages`` (``page_id, url, html``): ``page_id, url, text, n_chars``.

    Element subtrees are hashed and counted per host; those on at least ``least_pages`` different pages of
    a host are the site's template and are deleted, besides the elements that never are content. Copies of a page count once. Inside an article only containers are deleted for recurring: its paragraphs
    and headings are what the article says. Null pages are empty, a null address is a host of its own; rows that repeat
    give equal texts; other columns are not read. An empty table gives an empty result.

    Counts combine map-side, so a host with a third of all pages costs a row per task and subtree. The subtrees to
    delete travel to the pages that hold them, never all of a host's to each page.
    """
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1)), F.lit(""))
    page = F.xxhash64(host, F.coalesce("html", F.lit("")))
    read = texts_in_arrow(pages).select(page.alias("page"), F.xxhash64(host).alias("host"), "html")
    found = read.mapInArrow(_subtrees, "page long, host long, subtree long").distinct()
    found = write_down(found, "html-subtrees")
    template = found.groupBy("host", "subtree").agg(F.count("*").alias("n")).filter(F.col("n") >= int(least_pages))
    template = template.select("host", "subtree")
    held = found.join(small(write_down(template, "html-template")), ["host", "subtree"], "left_semi")
    held = write_down(held.groupBy("page").agg(F.collect_list("subtree").alias("gone")), "html-gone")
    key = free_name(["page_id", "url", "html", "gone"], "page")
    full = pages.select("page_id", "url", "html", page.alias(key)).join(small(held), key, "left")
    kind = {f.name: f.dataType.simpleString() for f in full.schema}
    return full.select(named("page_id"), "url", "html", "gone").mapInArrow(
        _texts, f"page_id {kind['page_id']}, url string, text string, n_chars long")
