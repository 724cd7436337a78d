"""Main text of web pages by wrapper induction.

A page's DOM is folded to a skeleton in which neighbours of one kind are one repeated node. For each host the skeleton of
most pages is the reference; every other skeleton of the host is aligned with it by simple tree matching, and what stands
at one node of the reference is compared over the host's different pages. Constant nodes are template: a text that most
pages have there, and every text of a node whose texts come from a small set. A node whose texts are links is a menu. The
varying nodes are content, wherever they stand.

Among varying nodes alone, what the page says of them decides: an element that is named as advert, form, reader comment or
the like isn't content. Only on pages of hosts that have no wrapper, as they have few pages, the mark of an article is
needed to tell what else isn't.
"""

from __future__ import annotations

import functools
import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import bounded, in_chunks, materialise, records, utf8

#: A text is template at a node if it stands there in this share of a host's different pages, and in this many at least.
SHARE = 0.6
LEAST = 5
#: A node that as many pages have is template if its texts repeat: different ones are at most this share of all.
VARIETY = 0.2
#: A node outside an article is a menu if this share of its texts are links.
LINKS = 0.6
EVERY = 0

#: Element kinds.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base col embed hr input link meta param source track".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset("head nav footer aside form script style noscript template iframe svg canvas object embed button select option textarea dialog menu video audio title xmp noembed noframes map link meta input".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table article section div main body html".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())


_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""[\s/]*(?:(>)|([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)(?:"|\Z)|'([^']*)(?:'|\Z)|([^\s>"'][^\s>]*)?))?)""")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Words of class and id names. An element is chrome if one of its names consists of such words, at least
#: one of the first kind among them; a name with any other word says nothing.
CHROME = frozenset(
    """nav navbar navigation menu menus breadcrumb breadcrumbs masthead banner footer sidebar aside widget widgets ad ads advert adverts
    advertisement advertisements advertising adsense sponsor sponsored sponsors promo promotion promotions cookie cookies consent gdpr notice notices alert popup
    modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations teaser
    teasers comment comments commentlist respond reply replies disqus discussion responses pagination pager toolbar search skip
    copyright legal disclaimer hidden""".split()
)
#: Inside an article's own tag, and for elements in the text, fewer words count; for those that hold prose, adverts alone.
ARTICLE_CHROME = frozenset("ad ads advert adverts promo sponsor sponsored related teaser teasers comment comments reply replies response responses".split())
INLINE_CHROME = frozenset("ad ads advert adverts advertisement advertisements sponsor sponsored promo cookie cookies notice notices newsletter share sharing hidden".split())
PROSE_CHROME = frozenset("ad ads advert adverts advertisement advertisements sponsor sponsored hidden".split())
STRUCTURE = frozenset(
    """post page site main global top bottom left right center list lists box section wrap wrapper wrapping container area block bar inner
    outer content item items thread form widget slot unit zone group panel row col column header entry article user reader primary
    secondary fixed sticky mobile desktop links link button buttons icon icons toggle posts articles stories author text body meta
    date title count holder layout sr only visually sub mini side google""".split()
)
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th figcaption caption".split())
_DIGITS = re.compile(r"\d+")
ITEMS = frozenset(CLOSES) | frozenset(x for v in CLOSES.values() for x in v)


def attributes(page: str, pos: int) -> tuple[dict[str, str], int]:
    """The attributes from a place inside a tag on, and the place after the tag; each character is looked at once or twice."""
    found: dict[str, str] = {}
    match = _ATTRIBUTE.match
    while m := match(page, pos):
        pos = m.end()
        if m[1]:
            break
        name = m[2]
        if name in KEPT or name.lower() in KEPT:
            found.setdefault(name.lower(), m[3] or m[4] or m[5] or "")
    else:
        pos = len(page)
    return found, pos


KEPT = frozenset("class id role hidden aria-hidden style".split())


_PART = re.compile(r"[a-z]+")


@functools.lru_cache(maxsize=20_000)
def chrome(names: str, words: frozenset = CHROME) -> bool:
    """Whether one of an element's names says that it is no content."""
    for name in names.split():
        parts = set(_PART.findall(name.lower()))
        if parts & words and parts <= words | CHROME | STRUCTURE:
            return True
    return False


def unseen(found: dict[str, str]) -> bool:
    return "hidden" in found or found.get("aria-hidden") == "true" or found.get("role", "").lower() in ROLES or bool(_UNSEEN.search(found.get("style", "")))


class Node:
    """An element; what its ancestors say about it is handed down when it is made."""

    __slots__ = ("tag", "names", "children", "parent", "item", "slot", "off", "heading", "headed", "article", "main")

    def __init__(self, tag: str, found: dict[str, str], parent: Node | None, off: bool = False):
        self.tag, self.parent, self.children, self.slot, self.names = tag, parent, [], -1, ""
        if parent is None:
            self.item = None
            self.off = self.heading = self.headed = self.article = self.main = False
            return
        # the nearest element around it that may end a list item or a cell, or keep one open
        self.item = parent if parent.tag in ITEMS or parent.tag in SCOPES else parent.item
        if found:
            self.names = f"{found.get('class', '')} {found.get('id', '')}".strip()
            off = off or unseen(found)
        names, bare = self.names, tag in ("html", "body", "main")
        self.heading = parent.heading or tag in HEADINGS
        self.headed = parent.headed
        inside = parent.article or parent.main
        parts = set(_PART.findall(names.lower())) if names and not bare else ()
        if tag == "header" or "header" in parts and tag not in PROSE and parts <= STRUCTURE:
            if inside:
                self.headed = True
            else:
                off = True
        elif tag in DROPPED or parts and chrome(names, ARTICLE_CHROME if tag == "article" else PROSE_CHROME if tag in PROSE else CHROME):
            off = True
        self.off = parent.off or off
        self.article = parent.article or tag == "article"
        self.main = parent.main or tag == "main" or found.get("role", "").lower() == "main"

    def never(self) -> bool:
        """Whether its texts are never content; an article's header keeps its headings."""
        return self.off or self.headed and not self.heading

    def label(self) -> str:
        if not self.names:
            return self.tag
        name = re.sub(r"[(),]", "", f"{self.tag}.{_DIGITS.sub('', self.names)}")
        return name if len(name) <= 80 else f"{name[:40]}~{xxhash.xxh3_64_hexdigest(name.encode('utf-8', 'surrogatepass'))}"


class Block:
    """A text of a page: the element it stands in, its words joined by blanks, and how much of it is linked."""

    __slots__ = ("node", "parts", "text", "linked", "list")

    def __init__(self, node: Node):
        self.node, self.parts, self.text, self.linked, self.list = node, [], "", 0, None

    def is_link(self) -> bool:
        return self.linked > LINKS * sum(map(len, self.parts))


def parse(page: str) -> tuple[Node, list[Block]]:
    """The tree of block elements and the texts in page order. Inline elements belong to the text around them.

    The time is in proportion to the page's length, whatever its markup.
    """
    root = node = Node("#root", {}, None)
    open_: Counter = Counter()
    pos, links, size = 0, 0, len(page)
    blocks: list[Block] = []
    block = None
    hidden: list | None = None  # an inline element that isn't seen: [tag, how many of it are open, the element around it]

    def leave(upto: Node) -> None:
        """Close the open elements up to and with one."""
        nonlocal node, hidden, links
        while True:
            open_[node.tag] -= 1
            if hidden and hidden[2] is node:
                hidden = None
            at, node = node, node.parent
            if at is upto:
                break
        links = 0

    while pos < size:
        at = page.find("<", pos)
        at = size if at < 0 else at
        after = page[at + 1 : at + 2]
        while at < size and not (after.isascii() and after.isalpha() or after in ("/", "!", "?") and after):  # a sign, not a tag
            at = page.find("<", at + 1)
            at = size if at < 0 else at
            after = page[at + 1 : at + 2]
        if at > pos and not hidden:
            text = page[pos:at]
            if block is None and not text.isspace():
                block = Block(node)
                blocks.append(block)
            if block is not None:
                block.parts.append(text)
                if links:
                    block.linked += len(text)
        pos = at
        if at >= size:
            break
        if after == "!" and page.startswith("<!--", at):
            end = page.find("-->", at + 2)
            pos = size if end < 0 else end + 3
            continue
        closing = after == "/"
        m = _NAME.match(page, at + 1 + closing)
        if not m:
            end = page.find(">", at)
            pos = size if end < 0 else end + 1
            continue
        tag = m[0].lower()
        found, pos = attributes(page, m.end())
        if tag in INLINE:
            if tag == "br":
                if block is not None:
                    block.parts.append(" ")
                continue
            if tag == "a":
                links = max(0, links + (-1 if closing else 1))
            if hidden:
                if hidden[0] == tag:
                    hidden[1] += -1 if closing else 1
                    if not hidden[1]:
                        hidden = None
            elif not closing and found and tag not in VOID_INLINE and (unseen(found) or chrome(f"{found.get('class', '')} {found.get('id', '')}", INLINE_CHROME)):
                hidden = [tag, 1, node]
            continue
        block = None
        if closing:
            if open_[tag] > 0:
                up = node
                while up.tag != tag:
                    up = up.parent
                leave(up)
            continue
        if node.tag == "p":
            leave(node)
        if tag in CLOSES and any(open_[x] > 0 for x in CLOSES[tag]):
            up = node if node.tag in ITEMS or node.tag in SCOPES else node.item
            while up is not None and up.tag not in SCOPES and up.tag not in CLOSES[tag]:
                up = up.item
            if up is not None and up.tag in CLOSES[tag]:
                leave(up)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, pos)
            pos = end.end() if end else size
            continue
        if tag in VOID:
            continue
        links = 0
        child = Node(tag, found, node, bool(hidden))
        node.children.append(child)
        open_[tag] += 1
        node = child
    for b in blocks:
        b.text = " ".join(html.unescape("".join(b.parts)).split())
    return root, [b for b in blocks if b.text]


VOID_INLINE = frozenset("br img wbr".split())


def fold(root: Node) -> str:
    """The skeleton: labels in preorder with brackets; neighbours of one label are one node, their children in one list.

    Sets each element's slot, the number of its skeleton node.
    """
    out: list[str] = []
    count = 0
    stack: list = [[root]]
    while stack:
        nodes = stack.pop()
        if isinstance(nodes, str):
            out.append(nodes)
            continue
        for n in nodes:
            n.slot = count
        count += 1
        out.append(nodes[0].label())
        runs: list[list[Node]] = []
        last = None
        for c in (c for n in nodes for c in n.children):
            label = c.label()
            if runs and label == last:
                runs[-1].append(c)
            else:
                runs.append([c])
            last = label
        if runs:
            out.append("(")
            stack.append(")")
            for run in reversed(runs[1:]):
                stack += [run, ","]
            stack.append(runs[0])
    return "".join(out)


def unfold(skeleton: str) -> tuple[list[str], list[list[int]]]:
    """(labels, children) of a skeleton, by slot."""
    labels: list[str] = []
    children: list[list[int]] = []
    open_: list[int] = []
    for token in re.findall(r"[(),]|[^(),]+", skeleton):
        if token == "(":
            open_.append(len(labels) - 1)
        elif token == ")":
            open_.pop()
        elif token != ",":
            if open_:
                children[open_[-1]].append(len(labels))
            labels.append(token)
            children.append([])
    return labels, children


class Matching:
    """Simple tree matching of two trees of (labels, children by slot): the most nodes that match with order and ancestors kept.

    Subtrees of one shape are compared once, equal ones match whole, and children are aligned a row of the table at a time,
    so it is exact for trees of any size and depth.
    """

    def __init__(self, a: tuple[list[str], list[list[int]]], b: tuple[list[str], list[list[int]]]):
        self.trees, numbers = (a, b), {}
        self.label: list[str] = []
        self.kids: list[tuple[int, ...]] = []
        self.size: list[int] = []
        self.shapes = []
        for labels, children in self.trees:
            shapes = [0] * len(labels)
            for slot in range(len(labels) - 1, -1, -1):  # children have larger numbers
                key = labels[slot], tuple(shapes[c] for c in children[slot])
                if key not in numbers:
                    numbers[key] = len(self.label)
                    self.label.append(key[0])
                    self.kids.append(key[1])
                    self.size.append(1 + sum(self.size[c] for c in key[1]))
                shapes[slot] = numbers[key]
            self.shapes.append(shapes)
        self.weights: dict[tuple[int, int], int] = {}

    def weight(self, x: int, y: int) -> int:
        """The most matching nodes of two shapes; 0 if their roots don't match."""
        return self.size[x] if x == y else self.weights.get((x, y), 0)

    def weigh(self, x: int, y: int) -> None:
        stack = [(x, y)]
        while stack:
            x, y = stack[-1]
            if x == y or (x, y) in self.weights:
                stack.pop()
                continue
            if self.label[x] != self.label[y]:
                self.weights[x, y] = 0
                stack.pop()
                continue
            of: dict[str, list[int]] = {}
            for j in set(self.kids[y]):
                of.setdefault(self.label[j], []).append(j)
            todo = [(i, j) for i in set(self.kids[x]) for j in of.get(self.label[i], ()) if i != j and (i, j) not in self.weights]
            if todo:
                stack += todo
                continue
            self.weights[x, y] = 1 + int(self.scores(self.kids[x], self.kids[y])[-1])
            stack.pop()

    def scores(self, xs: tuple[int, ...], ys: tuple[int, ...]) -> np.ndarray:
        """The best alignment of all of xs with each beginning of ys."""
        rows: dict[int, np.ndarray] = {}
        best = np.zeros(len(ys) + 1, np.int64)
        for x in xs:
            if x not in rows:
                rows[x] = np.array([self.weight(x, y) for y in ys], np.int64)
            best[1:] = np.maximum.accumulate(np.maximum(best[1:], best[:-1] + rows[x]))
        return best

    def aligned(self, xs: tuple[int, ...], ys: tuple[int, ...]) -> list[tuple[int, int]]:
        """The places that the best alignment pairs, found by halving, so that no table is kept."""
        out, stack = [], [(0, len(xs), 0, len(ys))]
        while stack:
            a, b, c, d = stack.pop()
            while a < b and c < d and xs[a] == ys[c]:  # equal subtrees at either end belong together
                out.append((a, c))
                a, c = a + 1, c + 1
            while a < b and c < d and xs[b - 1] == ys[d - 1]:
                b, d = b - 1, d - 1
                out.append((b, d))
            if a >= b or c >= d:
                continue
            if b - a == 1:
                weights = [self.weight(xs[a], y) for y in ys[c:d]]
                if max(weights):
                    out.append((a, c + weights.index(max(weights))))
                continue
            middle = (a + b) // 2
            before, after = self.scores(xs[a:middle], ys[c:d]), self.scores(xs[middle:b][::-1], ys[c:d][::-1])[::-1]
            cut = c + int((before + after).argmax())
            stack += [(a, middle, c, cut), (middle, b, cut, d)]
        return out

    def pairs(self) -> list[tuple[int, int]]:
        """The matched (slot, slot)."""
        (_, left), (_, right) = self.trees
        shapes, others = self.shapes
        out = []
        self.weigh(shapes[0], others[0])
        stack = [(0, 0)] if self.weight(shapes[0], others[0]) else []
        while stack:
            x, y = stack.pop()
            out.append((x, y))
            xs, ys = left[x], right[y]
            if shapes[x] == others[y]:
                stack += zip(xs, ys, strict=True)
            else:
                stack += [(xs[i], ys[j]) for i, j in self.aligned(tuple(shapes[i] for i in xs), tuple(others[j] for j in ys))]
        return out


@functools.lru_cache(maxsize=2048)
def aligned(skeleton: str, reference: str) -> dict[int, int]:
    """slot of the skeleton -> slot of the reference, for the nodes that match."""
    return dict(Matching(unfold(skeleton), unfold(reference)).pairs())


def _hash(text: str) -> int:
    """Never ``EVERY``, which stands for all texts of a node."""
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63) or 1


def constant_or_menu(root: Node, blocks: list[Block], reference: str, template: frozenset) -> list[bool]:
    """For each text whether the host's wrapper says that it isn't content."""
    slots = aligned(fold(root), reference)
    constant = {(s, h) for s, h, excepted in template if not excepted}
    menus = {s for s, _, excepted in template if excepted}

    def off(b: Block) -> bool:
        slot = slots.get(b.node.slot, -1)
        if slot in menus and not (b.node.article or b.node.main):
            return True
        return (slot, EVERY) in constant or (slot, _hash(b.text)) in constant

    return [off(b) for b in blocks]


def link_lists(blocks: list[Block]) -> set[int]:
    """The lists, by identity, all of whose texts are links."""
    lists: dict[int, bool] = {}
    for b in blocks:
        node = b.node
        while node is not None and node.tag not in ("ul", "ol"):
            node = node.parent
        if node is not None:
            lists[id(node)] = lists.get(id(node), True) and b.is_link()
            b.list = id(node)
    return {n for n, links in lists.items() if links}


def content(page: str, reference: str | None = None, template: frozenset = frozenset()) -> str:
    """The page's main text; template: (slot of the reference, hash of the text or ``EVERY``, whether articles are excepted).

    Without a wrapper the page's own marks decide: texts of articles, else of ``main``, else all, without lists of nothing
    but links if there is other text.
    """
    root, blocks = parse(page)
    if reference is not None:
        off = constant_or_menu(root, blocks, reference, template)
        return "\n".join(b.text for b, gone in zip(blocks, off, strict=True) if not gone and not b.node.never())
    kept = [b for b in blocks if not b.node.never()]
    for inside in (lambda n: n.article, lambda n: n.main):
        if any(inside(b.node) for b in kept):
            kept = [b for b in kept if inside(b.node)]
            break
    else:
        menus = link_lists(kept)
        kept = [b for b in kept if b.list not in menus] or kept
    return "\n".join(b.text for b in kept)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(utf8(url), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A page's skeleton, a hash of its text, and (slot, hash, is link) of its texts; a slot's repeated texts count once."""
    schema = pa.schema([("host", pa.string()), ("skeleton", pa.string()), ("page", pa.int64()), ("slots", pa.list_(pa.int32())), ("hashes", pa.list_(pa.int64())), ("links", pa.list_(pa.int32()))])

    def rows():
        for host, page in records(batches, "host", "html"):
            root, blocks = parse(page)
            skeleton = fold(root)
            texts = sorted({(b.node.slot, _hash(b.text)): int(b.is_link()) for b in blocks}.items())
            if texts:
                yield host, skeleton, _hash("".join(b.text for b in blocks if not b.node.never())), [k[0] for k, _ in texts], [k[1] for k, _ in texts], [x for _, x in texts]

    yield from in_chunks(rows(), schema, 512)


def _aligned_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``first`` is 1 for one text of each page and slot."""
    schema = pa.schema([("host", pa.string()), ("slot", pa.int32()), ("hash", pa.int64()), ("link", pa.int32()), ("first", pa.int32())])

    def rows():
        for host, skeleton, reference, slots, hashes, links in records(batches, "host", "skeleton", "reference", "slots", "hashes", "links"):
            at, seen = aligned(skeleton, reference), set()
            for s, h, x in zip(slots, hashes, links, strict=True):
                if s in at:
                    yield host, at[s], h, x, int(at[s] not in seen)
                    seen.add(at[s])

    yield from in_chunks(rows(), schema, 8192)


def induce(pages: DataFrame, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """(host, reference, template array<struct<slot, hash, excepted>>) for hosts that have constant nodes or menus.

    Pages with the same text count once, so that copies make nothing constant. A host has fewer template entries than
    1 / share times the texts of a page, and its nodes.
    """
    outlines = pages.select(host_of(F.col("url")).alias("host"), utf8(F.col("html")).alias("html"))
    outlines = materialise(outlines.mapInArrow(_outline, "host string, skeleton string, page long, slots array<int>, hashes array<long>, links array<int>"))
    outlines = outlines.groupBy("host", "page").agg(F.first(F.struct("skeleton", "slots", "hashes", "links")).alias("x")).select("host", "x.*")
    kinds = outlines.groupBy("host", "skeleton").agg(F.count("*").alias("n"))
    hosts = kinds.groupBy("host").agg(F.max_by("skeleton", F.struct("n", "skeleton")).alias("reference"), F.sum("n").alias("pages"))
    hosts = materialise(hosts.filter(F.col("pages") >= least))
    texts = outlines.join(bounded(hosts), "host").select("host", "skeleton", "reference", "slots", "hashes", "links")
    texts = texts.mapInArrow(_aligned_texts, "host string, slot int, hash long, link int, first int")
    counts = materialise(texts.groupBy("host", "slot", "hash").agg(F.count("*").alias("n"), F.sum("link").alias("links"), F.sum("first").alias("firsts")))
    sizes = hosts.select("host", "pages")
    constant = counts.filter(F.col("n") >= least).join(sizes, "host").filter(F.col("n") >= share * F.col("pages")).select("host", "slot", "hash", F.lit(False).alias("excepted"))
    nodes = counts.groupBy("host", "slot").agg(F.count("*").alias("kinds"), F.sum("n").alias("texts"), F.sum("links").alias("links"), F.sum("firsts").alias("firsts")).join(sizes, "host")
    repeats = (F.col("firsts") >= least) & (F.col("firsts") >= share * F.col("pages")) & (F.col("kinds") <= VARIETY * F.col("texts"))
    nodes = nodes.select("host", "slot", F.lit(EVERY).cast("long").alias("hash"), (~repeats).alias("excepted"), (repeats | (F.col("links") > LINKS * F.col("texts"))).alias("is_off"))
    found = constant.unionByName(nodes.filter("is_off").drop("is_off"))
    found = found.groupBy("host").agg(F.collect_list(F.struct("slot", "hash", "excepted")).alias("template"))
    return hosts.select("host", "reference").join(found, "host")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def rows():
        for page_id, url, page, reference, template in records(batches, "page_id", "url", "html", "reference", "template"):
            text = content(page, reference, frozenset((t["slot"], t["hash"], t["excepted"]) for t in template or ()))
            yield page_id, url, text, len(text)

    yield from in_chunks(rows(), schema, 512)


def extract_text(pages: DataFrame, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    Defined cases: null, empty and text-free html gives the empty text. A null url or one without a host belongs to the
    empty host. Repeated rows give a row each. Unclosed and misnested elements end where the next ones force them to; an
    unclosed tag, comment, script or style hides the rest. Depth and length of a page are not limited. An empty table gives
    an empty result. Columns other than page_id, url and html are not read.
    """
    wrappers = materialise(induce(pages, share, least))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host_of(F.col("url")).alias("host"), utf8(F.col("html")).alias("html"))
    dressed = pages.join(bounded(wrappers), "host", "left").select("page_id", "url", "html", "reference", "template")
    return dressed.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
