"""Main text of web pages by site template removal.

Every page is parsed once into a tree, and the tree into the text blocks of its regions: its articles, or the whole page if
it has none. With each block go the hashes of the subtrees it lies in that might be template: hashes of their words and,
outside the article, of their shape (tags, classes and the shapes below, words left out). Spark counts on how many different
pages of a registered domain each hash occurs, so hosts with few pages borrow from the others of their domain, and tells
each page which of its own hashes recur. The html itself stays where it is.

What a recurring hash does depends on where it stands. On a page without an article, recurring blocks go at the start and at
the end, up to the first and from the last that is the page's own; recurring boxes (div, ul, table, ...) and shapes go anywhere.
Within an article a subtree counts only with its place, first or last of its siblings, and only a box goes by the common
count: a paragraph must open or close nearly all articles of its host. So a quotation, a licence line or an introduction
that some articles share stays. Elements that never hold an article go by tag, role and name.

Words protect what they make up: an element with nearly all of a region's words is no template, and where nearly all of an
article recurs, its pages are near copies of one another and keep it.
"""

from __future__ import annotations

import hashlib
import html
import pickle
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowkit.llm.common import checkpoint
from flowkit.llm.url_reputation import domain_of, host_of

#: A subtree is template when it is on MIN_PAGES different pages of the domain. A paragraph that opens or closes articles must
#: be on STRICT_PAGES of its host, and on STRICT_SHARE of them.
MIN_PAGES, STRICT_PAGES, STRICT_SHARE = 4, 10, 0.9
#: Recurring subtrees stay if less than this part of an article would be left. A shape outside an article tells of template
#: only below this part of the page's words.
LEAST_OWN, MOST_SHAPE = 1 / 6, 1 / 5
#: Template hashes of all sites that are broadcast at most, 8 bytes each and their sites' names.
BROADCAST_HASHES = 1 << 18
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*>|[^<]+|<", re.S)
_RAW_END = {t: re.compile(rf"</{t}\s*>|\Z", re.I) for t in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_NEVER = frozenset("nav footer aside form button select option dialog menu script style textarea noscript template iframe svg head title".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: Class or id tokens that name a container outside the article, and those that do so inside it as well.
_NAMES = re.compile(r"(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookie\w*|consent|gdpr|notices?|alert|newsletter|subscribe\w*|popup|modal|sidebar\w*|side-bar|menu\w*|nav|navbar|navigation|breadcrumbs?|pagination|header|masthead|footer|social|share|sharing|related|recommended|comments?|comment-?list|disqus|replies|respond|login|search|widget\w*|toolbar|skip-?link)(?:[-_](?:box|bar|area|list|section|container|wrapper|notice|banner|block|form|links?|left|right|top|bottom))?", re.I)
#: Inside an article, parts of class or id tokens of boxes, and tokens that count as they are.
_INSIDE_PARTS = frozenset("ad ads advert adverts advertisement adsense comments commentlist disqus newsletter promo promos promotion sponsor sponsored subscribe".split())
_INSIDE = re.compile(r"(?:cookie-?\w*|sidebar|comment-?list|respond|share|social|related)", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_BOXES = frozenset("div section ul ol dl table details figure aside form header footer nav menu address".split())
_CONTAINERS = frozenset("div section ul ol dl table details figure header footer p span".split())
_ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


@dataclass
class Element:
    tag: str
    never: bool = False
    article: bool = False
    inside: bool = False  # an article
    named: bool = False  # as something that is no article
    label: str = ""  # class and id
    children: list = field(default_factory=list)
    digest: bytes = b""
    shape: bytes = b""
    chars: int = 0  # of words, without those of elements that never hold an article
    holds: bool = False  # an article or a title


def _names_inside(token: str, tag: str) -> bool:
    return bool(_INSIDE.fullmatch(token)) or any(x.lower() in _INSIDE_PARTS for x in _PART.findall(token) if tag in _BOXES or x == token)


def _element(tag: str, attributes: str, inside: bool) -> Element:
    e = Element(tag, tag in _NEVER or tag == "header" and not inside, tag in ("article", "main"), inside)
    if not attributes or tag in ("html", "body", "article", "main"):
        return e
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            tokens = value.split()
            e.label += " " + " ".join(sorted(tokens)) if name == "class" else ""
            if tag in _CONTAINERS:
                e.named = e.named or any(_names_inside(t, tag) if inside else _NAMES.fullmatch(t) for t in tokens)
        elif name == "role" and value.lower() in _ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            e.never = True
    return e


def parse(page: str) -> Element:
    """The element tree; an open p ends where HTML ends it, unmatched end tags are ignored."""
    root = Element("html")
    stack = [root]
    inside = 0
    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.match(page, at)
        at = m.end()
        if m[2] is None:
            s = m[0]
            if s[0] != "<" or len(s) == 1:
                stack[-1].children.append(s)
            continue
        tag = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    inside -= sum(e.article for e in stack[k:])
                    del stack[k:]
                    break
                if tag in _INLINE and stack[k].tag not in _INLINE:
                    break
            continue
        if tag in _CLOSES_P or tag in ("li", "dt", "dd", "tr", "td", "th"):
            shut = ("p",) if tag in _CLOSES_P else (tag, "p")
            k = len(stack) - 1
            while k > 0 and (stack[k].tag in _INLINE or stack[k].tag in shut):
                k -= 1
            if k + 1 < len(stack) and any(e.tag in shut for e in stack[k + 1 :]):
                first = next(i for i in range(k + 1, len(stack)) if stack[i].tag in shut)
                del stack[first:]
        e = _element(tag, m[3] or "", inside > 0)
        stack[-1].children.append(e)
        if tag in _RAW_END:
            at = _RAW_END[tag].search(page, at).end()
        elif tag not in _VOID and not (m[3] or "").endswith("/"):
            stack.append(e)
            inside += e.article
    return root


def _walk(e: Element) -> Iterator[Element]:
    """Every element, parents before their children."""
    stack = [e]
    while stack:
        e = stack.pop()
        yield e
        stack.extend(c for c in e.children if not isinstance(c, str))


def _digest(root: Element) -> None:
    """Sets digest, shape, chars and holds of every element, the innermost first."""
    for e in reversed(list(_walk(root))):
        h = hashlib.blake2b(e.tag.encode(), digest_size=8)
        shape = hashlib.blake2b(f"{e.tag}{e.label}".encode(), digest_size=8, person=b"shape")
        last = b""
        for c in e.children:
            if isinstance(c, str):
                h.update(c.encode("utf-8", "replace"))
                e.chars += sum(map(len, c.split()))
                continue
            h.update(c.digest)
            e.chars += 0 if c.never else c.chars
            e.holds = e.holds or c.article or c.tag == "h1" or c.holds
            if c.shape != last and c.tag not in _INLINE:  # a list has one shape whatever its length
                shape.update(last := c.shape)
        e.digest, e.shape = h.digest(), shape.digest()


def _shaped(e: Element) -> bool:
    """Whether the shape says something: a paragraph's does not."""
    return not e.inside and not e.holds and (bool(e.label) and e.tag in _CONTAINERS and e.tag not in ("p", "span") or e.never)


def _regions(root: Element) -> list[Element]:
    """What holds the page's own words: a main with one article at most, else the articles, else the whole page."""
    found: list[Element] = []
    stack = [root]
    while stack:
        e = stack.pop()
        if e.never:
            continue
        if e.article:
            inner = sum(c.tag == "article" for c in _walk(e)) - (e.tag == "article")
            if e.tag == "article" or inner <= 1:
                found.append(e)
                continue
        stack.extend(c for c in reversed(e.children) if not isinstance(c, str))
    return found or [root]


@dataclass
class Block:
    """A text block with the hash of its words and those of subtrees that make it template: at the edges, anywhere, by shape."""

    text: str
    chars: int
    words: int
    edge: tuple[int, ...] = ()
    box: tuple[int, ...] = ()
    shape: tuple[int, ...] = ()


#: What tells the hashes of one digest in different places apart.
_MARKS = {mark: int.from_bytes(hashlib.blake2b(mark.encode(), digest_size=8).digest(), "big", signed=True) for mark in ("edge", "box", "shape", "first", "last")}


def _marked(digest: bytes, mark: str, strict: bool = False) -> int:
    """A hash of a digest and where it stands; odd ones are strict."""
    return (int.from_bytes(digest, "big", signed=True) ^ _MARKS[mark]) & -2 | strict


def _words(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True) & -2


def _places(e: Element) -> dict[int, str]:
    """The first and the last child that is a block with words, by id; text beside them leaves none at that end."""
    own = [c for c in e.children if (c.strip() if isinstance(c, str) else not c.never and not c.named and c.chars)]
    if len(own) < 2:
        return {}
    ends = {id(c): mark for c, mark in ((own[0], "first"), (own[-1], "last")) if not isinstance(c, str) and c.tag not in _INLINE}
    return ends


def _blocks(top: Element) -> list[Block]:
    """The blocks of a region in page order, without elements that never hold an article or are named as something else."""
    blocks: list[Block] = []
    words: list[str] = []

    held: list[tuple] = [((), (), ())]  # what the words stand in

    def end() -> None:
        if own := html.unescape("".join(words)).split():
            blocks.append(Block(text := " ".join(own), len(text) - len(own) + 1, _words(text), *held[0]))
        words.clear()

    todo: list[tuple] = [(top, (), (), ())]
    while todo:
        e, *marks = todo.pop()
        if e is None:
            end()
            continue
        if isinstance(e, str):
            words.append(e)
            held[0] = marks if e.strip() else held[0]
            continue
        if e.tag == "br":
            words.append(" ")
            continue
        if e.tag not in _INLINE:
            end()
            todo.append((None,))
        places = _places(e) if e.article or e.inside else {}
        for c in reversed(e.children):
            edge, box, shape = marks
            if not isinstance(c, str):
                small = not c.article and not c.holds
                if c.never or c.named and small and c.chars <= (1 - LEAST_OWN) * top.chars:
                    if c.tag not in _INLINE:
                        todo.append((None,))
                    continue
                if c.chars and small and c.tag not in _INLINE and c.chars <= (1 - LEAST_OWN) * top.chars:
                    if not c.inside:
                        edge = (*edge, _marked(c.digest, "edge"))
                        box = (*box, _marked(c.digest, "box")) if c.tag in _BOXES else box
                        if _shaped(c) and c.chars <= MOST_SHAPE * top.chars:
                            shape = (*shape, _marked(c.shape, "shape"))
                    elif id(c) in places:
                        box = (*box, _marked(c.digest, places[id(c)], c.tag not in _BOXES))
            todo.append((c, edge, box, shape))
    end()
    return blocks


def page_blocks(page: str) -> tuple[int, list[list[Block]]]:
    """What tells the page from others, its headings or else all its words, and the blocks of its regions."""
    root = parse(page)
    _digest(root)
    heads = hashlib.blake2b(digest_size=8)
    named = [c.digest for c in _walk(root) if c.tag == "h1"]
    heads.update(b"".join(named or [root.digest]))
    return int.from_bytes(heads.digest(), "big", signed=True), [_blocks(top) for top in _regions(root)]


def hashes_of(regions: list[list[Block]]) -> set[int]:
    return {h for blocks in regions for b in blocks for h in (b.words, *b.edge, *b.box, *b.shape)}


def joined(regions: list[list[Block]], template: Iterable[int] = ()) -> str:
    """The blocks that are not template, joined by two newlines."""
    template, out = frozenset(template), []
    for blocks in regions:
        blocks = [b for b in blocks if template.isdisjoint(b.shape)]
        own = [k for k, b in enumerate(blocks) if template.isdisjoint(b.edge)]
        kept = [b for b in (blocks[own[0] : own[-1] + 1] if own else []) if template.isdisjoint(b.box)]
        whole, unlike = sum(b.chars for b in blocks), sum(b.chars for b in blocks if b.words not in template)
        if min(unlike, sum(b.chars for b in kept)) < LEAST_OWN * whole:
            kept = blocks
        out += [b.text for b in kept]
    return "\n\n".join(out)


def main_text(page: str, template: Iterable[int] = ()) -> str:
    """The article's blocks, joined by two newlines."""
    return joined(page_blocks(page)[1], template)


def parsed_pages(pages: DataFrame, with_blocks: bool = False) -> DataFrame:
    """host, domain, page and hashes of every page; with_blocks adds row, page_id, url and blocks. The rows are checkpointed,
    so row stays."""
    kept = "page_id, url, blocks".split(", ") if with_blocks else []
    kind = pages.schema["page_id"].dataType.simpleString()

    def parse_all(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                found = [page_blocks(x) for x in part.column(2).to_pylist()]
                columns = [part.column(3), part.column(4), pa.array([x for x, _ in found], pa.int64()), pa.array([list(hashes_of(r)) for _, r in found], pa.list_(pa.int64()))]
                if kept:
                    packed = [zlib.compress(pickle.dumps([[(b.text, b.chars, b.words, b.edge, b.box, b.shape) for b in blocks] for blocks in regions], 5), 1) for _, regions in found]
                    columns += [part.column(0), part.column(1), pa.array(packed, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["host", "domain", "page", "hashes", *kept])

    rows = _rows(pages).mapInArrow(parse_all, "host string, domain string, page long, hashes array<long>" + f", page_id {kind}, url string, blocks binary" * with_blocks)
    return checkpoint(rows.select(F.monotonically_increasing_id().alias("row"), "*") if with_blocks else rows)


def _rows(pages: DataFrame) -> DataFrame:
    host = host_of(F.col("url"))
    return pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host"), domain_of(host).alias("domain"))


def _recurring(parsed: DataFrame, min_pages: int = MIN_PAGES, strict_pages: int = STRICT_PAGES, strict_share: float = STRICT_SHARE) -> DataFrame:
    """site and hash: the hashes that recur on different pages of a domain, or strict ones of a host. Copies count once."""
    strict = F.col("hash").bitwiseAND(F.lit(1)) == 1
    each = parsed.select("host", "domain", "page", F.explode("hashes").alias("hash"))
    each = each.select(F.when(strict, F.col("host")).otherwise(F.col("domain")).alias("site"), "hash", "page").distinct()
    counts = each.groupBy("site", "hash").agg(F.count(F.lit(1)).alias("n"))
    total = parsed.select(F.col("host").alias("site"), "page").distinct().groupBy("site").agg(F.count(F.lit(1)).alias("pages"))
    common = counts.where(~strict & (F.col("n") >= min_pages)).select("site", "hash")
    opening = counts.where(strict & (F.col("n") >= max(min_pages, strict_pages))).join(total, "site").where(F.col("n") >= strict_share * F.col("pages"))
    return common.unionByName(opening.select("site", "hash"))


def site_templates(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """site and hash of the template subtrees of all domains and hosts."""
    return _recurring(parsed_pages(pages), min_pages)


def extract_text(pages: DataFrame, min_pages: int = MIN_PAGES, broadcast_hashes: int = BROADCAST_HASHES) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    Null html counts as empty and gives an empty text. A page without an article gives all that is left of its body.
    Pages with a null url share the empty host. Repeated pages give rows each; other columns are ignored.

    Up to broadcast_hashes template hashes of all sites are broadcast, and the html is read again where it is. More of them
    are joined to the parsed blocks of each page, which then travel in its place.
    """
    templates = checkpoint(_recurring(parsed_pages(pages), min_pages))
    page_id = pages.schema["page_id"].dataType.simpleString()
    if templates.count() <= broadcast_hashes:
        by_site: dict[str, set[int]] = {}
        for r in templates.collect():
            by_site.setdefault(r.site, set()).add(r.hash)
        sent = pages.sparkSession.sparkContext.broadcast(by_site)

        def texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sites, none = sent.value, frozenset()
            for b in batches:
                for k in range(0, b.num_rows, 256):
                    part = b.slice(k, 256)
                    found = [main_text(x, sites.get(h, none) | sites.get(d, none)) for x, h, d in zip(*(part.column(c).to_pylist() for c in (2, 3, 4)), strict=True)]
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.string())], names=["page_id", "url", "text"])

        rows = _rows(pages)
    else:
        parsed = parsed_pages(pages, True)
        strict = F.col("hash").bitwiseAND(F.lit(1)) == 1
        asked = parsed.select("row", "host", "domain", F.explode("hashes").alias("hash")).withColumn("site", F.when(strict, F.col("host")).otherwise(F.col("domain")))
        own = asked.join(templates, ["site", "hash"]).groupBy("row").agg(F.collect_list("hash").alias("template"))
        rows = parsed.join(own, "row", "left").select("page_id", "url", "blocks", "template")

        def texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for k in range(0, b.num_rows, 256):
                    part = b.slice(k, 256)
                    regions = ([[Block(*x) for x in blocks] for blocks in pickle.loads(zlib.decompress(data))] for data in part.column(2).to_pylist())
                    found = [joined(r, t or ()) for r, t in zip(regions, part.column(3).to_pylist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.string())], names=["page_id", "url", "text"])

    found = rows.mapInArrow(texts, f"page_id {page_id}, url string, text string")
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
